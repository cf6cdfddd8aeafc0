"""Mixing sources to target weights by Sainte-Lague apportionment.

Targets share 150 % of all words by weight, none above twice its source. Blocks of BLOCK_WORDS words are seats: sources
get integer quotas by the highest quotients target / (2 k + 1), and so do the shards of a source, by their sizes.
A shard is a line of its documents in seeded order, twice over, cut into blocks; a seeded permutation of the blocks
picks the shard's quota, and a document takes what the picked blocks cover of it. The permutation is three seeded turns
with a prime stride and, between them, two exchanges of each block with the one whose number differs by a seeded mask,
where there is such a block.

Scale: a source of any size is spread over shards of about SHARD_WORDS words or SHARD_ROWS documents, whichever makes
more shards, so a line of documents is one window of bounded size. Words are counted twice, once for the tables of
sources and shards and once in the rows that are returned, so that no text is staged; the kept columns are shuffled
once, by the pair of numbers by which a line is ordered and meets its shard. The tables of sources and shards hold a row
each and are joined, never collected; the shards of a source, a row for some millions of words, are ranked in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import WORD, read, sealed, stage

WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 16
SHARD_WORDS = 1 << 22
SHARD_ROWS = 1 << 15
STRIDES = (2147483647, 1000000007, 1999999973)  # primes above any number of blocks, so that each permutes them
TURNS = ("turn", "mask", "turn2", "mask2", "turn3")
SEED = "mix"


def seeded(*parts: Column) -> Column:
    """32 bits of an MD5 of the seed and the parts (null: empty)."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(SEED), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))), 1, 8), 16, 10).cast("long")


def apportion(df: DataFrame, group: list[str], key: str, votes: str, seats: str) -> DataFrame:
    """Adds quota: the seats of each row of a group by highest quotients votes / (2 k + 1), ties by key, null last.

    With x the exact share of n rows in t seats, the quota lies within x * n / (2 t) + 1 of x, so seats below that
    range are given at once and only the quotients inside it are ranked. Votes are not null; rows without votes win
    nothing, a group without any votes or seats has quotas of 0, rows of equal votes and key may swap. The rows of a
    group are ranked in one task (a few quotients a row): sources, or the shards of one source, some 10^6 of them.
    """
    own = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    all_ = F.sum(votes).over(own)
    x = F.when(all_ > 0, F.col(votes) * F.col(seats) / all_).otherwise(F.lit(0.0))
    df = df.withColumn("x_", x).withColumn("m_", F.ceil(F.col("x_") * F.count("*").over(own) / (2 * F.greatest(F.col(seats), F.lit(1)))) + 1)
    df = df.withColumn("low_", F.greatest(F.floor("x_") - F.col("m_"), F.lit(0)).cast("long")).withColumn("left_", F.col(seats) - F.sum("low_").over(own))
    df = df.withColumn("k_", F.explode(F.sequence(F.col("low_"), (F.floor("x_") + F.col("m_") + 1).cast("long"))))
    ranked = df.withColumn("rank_", F.row_number().over(own.orderBy((F.col(votes) / (2 * F.col("k_") + 1)).desc(), F.col(key).asc_nulls_last())))
    won = F.count_if((F.col("rank_") <= F.col("left_")) & (F.col(votes) > 0))
    kept = [c for c in df.columns if c[-1] != "_"]
    return ranked.groupBy(*kept).agg((F.first("low_") + won).alias("quota"))


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size), a row a source.

    A null source is the last one; sources without words have targets of 0; an empty table gives no rows. All sources
    are ranked in one task, a row each, so this holds for some 10^6 of them.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    all_, fill = Window.partitionBy(), Window.orderBy(F.col("full_"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    s = sizes.withColumn("weight_", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("double"))
    s = s.withColumn("cap_", most * F.col("source_size")).withColumn("full_", F.col("cap_") / F.col("weight_"))
    s = s.withColumn("budget_", share * F.sum("source_size").over(all_))
    s = s.withColumn("spent_", F.coalesce(F.sum("cap_").over(before), F.lit(0.0))).withColumn("rest_", F.sum("weight_").over(all_) - F.coalesce(F.sum("weight_").over(before), F.lit(0.0)))
    # the level is reached among the sources that fill up first: where all from here on, at this one's level, suffice
    level = F.when(F.col("spent_") + F.col("full_") * F.col("rest_") >= F.col("budget_"), (F.col("budget_") - F.col("spent_")) / F.col("rest_"))
    s = s.withColumn("level_", F.first(level, ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return s.select("source", "source_size", F.least("cap_", F.coalesce(F.col("level_") * F.col("weight_"), F.col("cap_"))).alias("target"))


def permuted(b: Column, blocks: Column, draws: tuple[Column, ...]) -> Column:
    """The place of block b of 0 .. blocks - 1 in the seeded permutation; draws below blocks, in the order of TURNS."""
    first, mask, second, mask2, third = draws
    turned = lambda x, stride, by: (x * F.lit(stride) + by) % blocks
    swapped = lambda x, m: F.when(x.bitwiseXOR(m) < blocks, x.bitwiseXOR(m)).otherwise(x)
    return turned(swapped(turned(swapped(turned(b, STRIDES[0], first), mask), STRIDES[1], second), mask2), STRIDES[2], third)


def covered(start: Column, end: Column) -> Column:
    """Words of [start, end) that lie in picked blocks."""
    size, blocks, quota = F.lit(BLOCK_WORDS), F.col("blocks"), F.col("quota")
    picked = lambda b: permuted(b, blocks, tuple(map(F.col, TURNS))) < quota
    part = lambda b: F.when(picked(b), F.least(end, (b + 1) * size) - F.greatest(start, b * size)).otherwise(F.lit(0))
    span = F.sequence(F.floor(start / size), F.floor((end - 1) / size))
    return F.when(end > start, F.aggregate(span, F.lit(0).cast("long"), lambda a, b: a + part(b).cast("long"))).otherwise(F.lit(0).cast("long"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken, source of every row, and the columns of keep.

    size counts the words of the whole text (null: 0). A null source is a source, in the last place. taken counts
    repeats, at most twice the size. Rows of one id and text may swap places and are otherwise independent. Other
    columns are ignored, whatever their names; an empty table gives no rows, texts without words give zeros.
    """
    text = F.col(text_col).cast("string")
    full = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("tie"), F.struct(F.lit(0).alias("_"), *keep).alias("keep_"))
    full = full.withColumn("deal", seeded(F.lit("shard"), F.coalesce(F.col("doc_id").cast("string"), F.col("tie"))))
    rows = stage(full.select("source", "size", "deal"), "sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    targets = source_targets(sources.select("source", "source_size"))
    seats = targets.withColumn("seats", F.round(F.sum("target").over(Window.partitionBy()) / BLOCK_WORDS).cast("long"))
    quotas = apportion(seats, [], "source", "target", "seats").select(F.col("source").alias("of"), "source_size", "target", F.col("quota").alias("seats"))
    shards = F.greatest(F.ceil(F.col("source_size") / SHARD_WORDS), F.ceil(F.col("docs") / SHARD_ROWS))
    quotas = quotas.join(sources.select(F.col("source").alias("of_"), "docs"), F.col("of").eqNullSafe(F.col("of_"))).select("of", "source_size", "target", "seats", shards.alias("shards"))
    quotas = stage(quotas.withColumn("number", F.row_number().over(Window.orderBy(F.col("of").asc_nulls_last()))), "quotas")
    deal = lambda df: df.join(quotas, F.col("source").eqNullSafe(F.col("of"))).withColumn("shard", F.col("deal") % F.col("shards")).drop("of", "deal")
    shards = deal(rows).groupBy("number", "source", "seats", "shard").agg(F.sum("size").alias("shard_size"))
    shards = apportion(shards, ["number"], "shard", "shard_size", "seats")
    blocks = F.greatest(F.ceil(2 * F.col("shard_size") / BLOCK_WORDS), F.lit(1)).cast("long")
    shards = shards.select(F.col("number").alias("of_number"), F.col("source").alias("of"), F.col("shard").alias("at"), "shard_size", blocks.alias("blocks"), "quota")
    shards = shards.withColumns({t: seeded(F.lit(t), F.col("of"), F.col("at")) % F.col("blocks") for t in TURNS})
    line = Window.partitionBy("number", "shard").orderBy(seeded(F.lit("order"), F.col("doc_id")), "doc_id", "tie").rowsBetween(Window.unboundedPreceding, 0)
    placed = deal(full).withColumn("end", F.sum("size").over(line)).withColumn("start", F.col("end") - F.col("size"))
    placed = placed.join(shards, (F.col("number") == F.col("of_number")) & (F.col("shard") == F.col("at")))
    taken = covered(F.col("start"), F.col("end")) + covered(F.col("start") + F.col("shard_size"), F.col("end") + F.col("shard_size"))
    return sealed(placed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source", *(F.col("keep_")[c].alias(c) for c in keep)))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


def _sql_place() -> str:
    swapped = lambda x, m: f"(CASE WHEN xor({x}, {m}) < blocks THEN xor({x}, {m}) ELSE {x} END)"
    turned = lambda x, stride, by: f"(({x} * {stride}::BIGINT + {by}) % blocks)"
    return turned(swapped(turned(swapped(turned("b", STRIDES[0], "turn"), "mask"), STRIDES[1], "turn2"), "mask2"), STRIDES[2], "turn3")


_PLACE = _sql_place()
OP5_SQL = f"""
WITH rows_ AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size, md5(coalesce(text, '')) AS tie FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS docs FROM rows_ GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS cap FROM src),
f AS (SELECT *, cap / weight AS full_, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM w),
g AS (SELECT *, coalesce(sum(cap) OVER b, 0) AS spent, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS rest FROM f
      WINDOW b AS (ORDER BY full_, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT arg_min((budget - spent) / rest, full_) AS lev FROM (SELECT * FROM g WHERE spent + full_ * rest >= budget ORDER BY full_, source NULLS LAST LIMIT 1)),
t AS (SELECT source, source_size, docs, least(cap, coalesce(lev * weight, cap)) AS target FROM g, lv),
s1 AS (SELECT *, CAST(round(sum(target) OVER () / {BLOCK_WORDS}) AS BIGINT) AS seats, sum(target) OVER () AS tv, count(*) OVER () AS n FROM t),
s2 AS (SELECT *, CASE WHEN tv > 0 THEN target * seats / tv ELSE 0 END AS x FROM s1),
s3 AS (SELECT *, ceil(x * n / (2 * greatest(seats, 1))) + 1 AS m FROM s2),
s4 AS (SELECT *, CAST(greatest(floor(x) - m, 0) AS BIGINT) AS low FROM s3),
s5 AS (SELECT *, unnest(range(low, CAST(floor(x) + m + 2 AS BIGINT))) AS k, seats - sum(low) OVER () AS lft FROM s4),
s6 AS (SELECT *, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, source NULLS LAST) AS rk FROM s5),
q AS (SELECT source AS of_, source_size, target, any_value(low) + count(*) FILTER (rk <= lft AND target > 0) AS seats, greatest(CAST(ceil(source_size / {SHARD_WORDS}.0) AS BIGINT), CAST(ceil(docs / {SHARD_ROWS}.0) AS BIGINT)) AS shards FROM s6 GROUP BY source, source_size, docs, target),
d AS (SELECT r.*, q.*, CAST(concat('0x', substr(md5(concat('{SEED}:shard:', coalesce(CAST(doc_id AS VARCHAR), tie))), 1, 8)) AS BIGINT) % shards AS shard FROM rows_ r JOIN q ON r.source IS NOT DISTINCT FROM q.of_),
h AS (SELECT source, seats, shard, CAST(sum(size) AS BIGINT) AS shard_size FROM d GROUP BY source, seats, shard),
h1 AS (SELECT *, sum(shard_size) OVER o AS tv, count(*) OVER o AS n FROM h WINDOW o AS (PARTITION BY source)),
h2 AS (SELECT *, CASE WHEN tv > 0 THEN shard_size * seats / CAST(tv AS DOUBLE) ELSE 0 END AS x FROM h1),
h3 AS (SELECT *, ceil(x * n / (2 * greatest(seats, 1))) + 1 AS m FROM h2),
h4 AS (SELECT *, CAST(greatest(floor(x) - m, 0) AS BIGINT) AS low FROM h3),
h5 AS (SELECT *, unnest(range(low, CAST(floor(x) + m + 2 AS BIGINT))) AS k, seats - sum(low) OVER (PARTITION BY source) AS lft FROM h4),
h6 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY shard_size / CAST(2 * k + 1 AS DOUBLE) DESC, shard) AS rk FROM h5),
c AS (SELECT source AS of2, shard AS sh, shard_size, any_value(low) + count(*) FILTER (rk <= lft AND shard_size > 0) AS quota, greatest(CAST(ceil(2 * shard_size / {BLOCK_WORDS}.0) AS BIGINT), 1) AS blocks FROM h6 GROUP BY source, shard, shard_size),
c2 AS (SELECT *, {', '.join(f"CAST(concat('0x', substr(md5(concat('{SEED}:{t}:', coalesce(of2, ''), ':', CAST(sh AS VARCHAR))), 1, 8)) AS BIGINT) % blocks AS {t}" for t in TURNS)} FROM c),
p AS (SELECT d.*, CAST(sum(size) OVER (PARTITION BY source, shard ORDER BY CAST(concat('0x', substr(md5(concat('{SEED}:order:', coalesce(CAST(doc_id AS VARCHAR), ''))), 1, 8)) AS BIGINT), doc_id, tie ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e FROM d),
p2 AS (SELECT p.*, p.e - p.size AS s, c2.* FROM p JOIN c2 ON p.source IS NOT DISTINCT FROM c2.of2 AND p.shard = c2.sh),
two AS (SELECT *, unnest([s, s + shard_size]) AS a, unnest([e, e + shard_size]) AS z FROM p2)
SELECT doc_id, size, source_size, target, CAST(sum(coalesce(list_sum(list_transform(range(a // {BLOCK_WORDS}, CASE WHEN z > a THEN (z - 1) // {BLOCK_WORDS} + 1 ELSE a // {BLOCK_WORDS} END),
  lambda b: CASE WHEN {_PLACE} < quota THEN least(z, (b + 1) * {BLOCK_WORDS}) - greatest(a, b * {BLOCK_WORDS}) ELSE 0 END)), 0)) AS BIGINT) AS taken, source
FROM two GROUP BY doc_id, tie, s, size, source_size, target, source
"""
