"""Quality rules with risk-controlled cutoffs.

Each rule rejects a document whose statistic exceeds a cutoff. On a labelled holdout, per stratum and rule, a cutoff
is admissible when an exact binomial test shows that it rejects fewer than ALPHA / (rules) of the good documents:
P(Bin(n, a) <= rejected) <= DELTA / (strata * rules), a Bonferroni correction; cutoffs are tested from the loosest to
the strictest and testing stops at the first that fails, which needs no further correction. So with probability
1 - DELTA no stratum loses more than ALPHA of its good documents to the rules. Of the admissible cutoffs the rule
takes the one that separates bad from good documents best, the loosest of equals. A rule with no admissible cutoff in
a stratum (too few labels) rejects nothing there.

Scale: one pass over the texts; what is shuffled has a few numbers for each document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import read, stage
from .text_metrics import base_statistics

ALPHA = 0.02
DELTA = 0.05
#: Cutoffs of every rule, loosest first; fixed before any label is seen.
CUTOFFS = (0.5, 0.4, 0.3, 0.25, 0.2, 0.16, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02)
RULES = ("symbol_share", "upper_share", "dup_line_share", "repeat_share")


def binomial_tail(k: Column, n: Column, p: Column) -> Column:
    """P(Bin(n, p) <= k) for 0 < p < 1 and integers 0 <= k < n: the largest term by logarithms, the rest relative to it."""
    k, n = k.cast("double"), n.cast("double")
    to = lambda a: F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    log_term = F.aggregate(to(k), F.lit(0.0), lambda a, i: a + F.log((n - k + i) / i)) + k * F.log(p) + (n - k) * F.log(1 - p)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(a: Column, i: Column) -> Column:
        j = k - i + 1
        term = a["term"] * j * (1 - p) / ((n - j + 1) * p)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    return F.exp(log_term + F.log(F.aggregate(to(k), start, add, lambda a: a["sum"])))


def choose_cutoffs(labelled: DataFrame, alpha: float, delta: float) -> DataFrame:
    """(stratum, cutoffs map) from rows of stratum, good and the rules' statistics.

    A null stratum is one. Rules without a proved cutoff are not in a stratum's map, strata without labels have no row.
    Rows that repeat count each; an empty table gives no rows. Ties of gain go to the looser cutoff.
    """
    values = labelled.select("stratum", "good", F.explode(F.map_from_arrays(F.array(*map(F.lit, RULES)), F.array(*RULES))).alias("rule", "value"))
    spared = F.size(F.filter(F.array(*map(F.lit, CUTOFFS)), lambda c: F.col("value") <= c))  # so many of the loosest cutoffs spare it
    levels = values.groupBy("stratum", "rule", spared.alias("spared")).agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    hit = lambda c: F.sum(F.when(F.col("spared") <= F.col("at"), F.col(c)).otherwise(0))
    levels = levels.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(len(CUTOFFS) - 1))))
    counts = levels.groupBy("stratum", "rule", "at").agg(F.sum("good").alias("n"), F.sum("bad").alias("n_bad"), hit("good").alias("k"), hit("bad").alias("k_bad"))
    strata = labelled.agg(F.count_distinct(F.coalesce("stratum", F.lit(""))).alias("strata"))
    a = F.lit(alpha / len(RULES))
    tested = counts.crossJoin(strata).withColumn("ok", F.when((F.col("n") > 0) & (F.col("k") < F.col("n") * a), binomial_tail(F.col("k"), F.col("n"), a) <= F.lit(delta / len(RULES)) / F.col("strata")).otherwise(F.lit(False)))
    so_far = Window.partitionBy("stratum", "rule").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    admitted = tested.withColumn("ok", F.min("ok").over(so_far)).where("ok")
    gain = F.try_divide(F.col("k_bad"), F.col("n_bad")) - F.col("k") / F.col("n")
    best = admitted.groupBy("stratum", "rule").agg(F.max_by("at", F.struct(F.coalesce(F.round(gain, 9), F.lit(-1.0)), -F.col("at"))).alias("at"))
    return best.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", F.get(F.array(*map(F.lit, CUTOFFS)), F.col("at")).alias("cutoff")))).alias("cutoffs"))


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """Statistics and verdict of every row of docs, with the rules' statistics.

    A null text counts as empty. Rows without words or with under 20 words, or with over 30 % of their words in
    repeated windows, fail the base rules. A null stratum is a stratum of its own. Labels with a null doc_id or
    quality are unused; repeated labels each count. Without labels only the base rules reject. Repeated rows and
    ids each give a row; other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(stratum_col).alias("stratum"), F.col(text_col).alias("text"))
    stats = base_statistics(rows)
    share = lambda part, whole: F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole).cast("double")), F.lit(0.0))
    stats = stats.withColumn("n_lines", F.size("lines_").cast("long")).withColumn("n_upper", F.regexp_count("text_", F.lit(r"\p{Lu}")).cast("long"))
    stats = stats.select("doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
    stats = stage(stats, "statistics")
    stats = stats.withColumn("symbol_share", share("n_symbols", "word_chars")).withColumn("upper_share", share("n_upper", "word_chars")).withColumn("dup_line_share", share("n_dup_lines", "n_lines")).withColumn("repeat_share", share("n_repeat_words", "n_words"))
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    stats = stats.withColumn("base_failed", base)
    good = labels.select(F.col("doc_id"), (F.col("quality") == 1).alias("good")).where("doc_id is not null and good is not null")
    cutoffs = choose_cutoffs(stats.join(good, "doc_id").where("not base_failed"), alpha, delta).withColumnRenamed("stratum", "of")
    judged = stats.join(cutoffs, F.col("stratum").eqNullSafe(F.col("of")), "left")
    over = [F.coalesce(F.col(rule) > F.try_element_at("cutoffs", F.lit(rule)), F.lit(False)) for rule in RULES]
    failed = over[0] | over[1] | over[2] | over[3]
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~failed).alias("kept"), *(c.alias(f"over_{r}") for r, c in zip(RULES, over)))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def _oracle() -> str:
    cutoffs = ", ".join(f"({i}, {c!r}::DOUBLE)" for i, c in enumerate(CUTOFFS))
    rules = " UNION ALL ".join(f"SELECT stratum, good, '{r}' AS rule, {r} AS value FROM known" for r in RULES)
    a = repr(ALPHA / len(RULES)) + "::DOUBLE"
    over = " OR ".join(f"coalesce({r} > (SELECT max(cutoff) FROM chosen c WHERE c.rule = '{r}' AND c.stratum IS NOT DISTINCT FROM t.stratum), false)" for r in RULES)
    each = ", ".join(f"coalesce({r} > (SELECT max(cutoff) FROM chosen c WHERE c.rule = '{r}' AND c.stratum IS NOT DISTINCT FROM t.stratum), false) AS over_{r}" for r in RULES)
    share = lambda x, y: f"coalesce({x}::DOUBLE / nullif({y}, 0), 0)"
    return rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS n, doc_id, lang AS stratum, coalesce(text, '') AS text FROM documents),
w AS MATERIALIZED (SELECT n, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
win AS (SELECT n, unnest(range(1, len(w) - 6)) AS i, w FROM w WHERE len(w) >= 8),
win2 AS (SELECT n, i, count(*) OVER (PARTITION BY n, array_to_string(w[i:i + 7], ' ')) AS c FROM win),
rep AS (SELECT n, count(DISTINCT i + k) AS n_repeat_words FROM win2, (SELECT unnest(range(0, 8)) AS k) WHERE c > 1 GROUP BY n),
ln AS (SELECT n, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln FROM d),
t AS MATERIALIZED (SELECT *, {share('n_symbols', 'word_chars')} AS symbol_share, {share('n_upper', 'word_chars')} AS upper_share, {share('n_dup_lines', 'n_lines')} AS dup_line_share, {share('n_repeat_words', 'n_words')} AS repeat_share, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM (
  SELECT d.n, doc_id, stratum, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: len(x))), 0) AS BIGINT) AS word_chars, len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ln) - len(list_distinct(ln)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(ln) AS n_lines, len(regexp_extract_all(text, '\p{{Lu}}')) AS n_upper
  FROM d JOIN w USING (n) JOIN ln USING (n) LEFT JOIN rep USING (n))),
known AS MATERIALIZED (SELECT t.*, quality = 1 AS good FROM t JOIN labels USING (doc_id) WHERE NOT base_failed AND quality IS NOT NULL),
val AS ({rules}),
cut(lv, cutoff) AS (VALUES {cutoffs}),
cnt AS MATERIALIZED (SELECT stratum, rule, lv, cutoff, count(*) FILTER (good) AS n, count(*) FILTER (NOT good) AS nb, count(*) FILTER (good AND value > cutoff) AS k, count(*) FILTER (NOT good AND value > cutoff) AS kb, (SELECT count(DISTINCT coalesce(stratum, '')) FROM known) AS strata FROM val, cut GROUP BY ALL),
tail AS (SELECT stratum, rule, lv, sum(exp(lp)) AS p FROM (
  SELECT *, sum(step) OVER (PARTITION BY stratum, rule, lv ORDER BY j) AS lp FROM (SELECT stratum, rule, lv, j, CASE WHEN j = 0 THEN n * ln(1 - {a}) ELSE ln((n - j + 1)::DOUBLE / j) + ln({a} / (1 - {a})) END AS step FROM (SELECT *, unnest(range(0, k + 1)) AS j FROM cnt WHERE n > 0 AND k < n * {a}))) GROUP BY ALL),
ok AS (SELECT cnt.*, bool_and(coalesce(p <= {DELTA / len(RULES)!r}::DOUBLE / strata, false)) OVER (PARTITION BY cnt.stratum, cnt.rule ORDER BY cnt.lv) AS ok FROM cnt LEFT JOIN tail ON cnt.stratum IS NOT DISTINCT FROM tail.stratum AND cnt.rule = tail.rule AND cnt.lv = tail.lv),
chosen AS MATERIALIZED (SELECT stratum, rule, cutoff FROM (SELECT *, row_number() OVER (PARTITION BY stratum, rule ORDER BY coalesce(round(kb::DOUBLE / nullif(nb, 0) - k::DOUBLE / n, 9), -1) DESC, lv) AS r FROM ok WHERE ok) WHERE r = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({over}) AS kept, {each} FROM t"""


OP1_SQL = _oracle()
