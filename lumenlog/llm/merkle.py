"""A Merkle manifest of a data set: a tree of digests for each source, one over the sources' roots, a proof for each row.

Bottom-up: nodes of a tree in order, every ARITY of them hashed into their parent, until one is left. Top-down: the root's
proof is empty, each child puts its siblings before the proof that its parent hands down. Both work on persisted tables
of groups: a group holds the ARITY ** BAND neighbours below one node, and with them the BAND levels between, so that
a tree of n rows takes log(n) / log(81) tables and as many joins of children with parents, each 81 times smaller than
the one before. Groups are of bounded size whatever a source holds.

Places in a tree come from a range-partitioned sort of the staged digests: a row's place in its partition, and the sum of
what earlier partitions hold of its tree (a table of partitions and trees). No task sees a whole source, and nothing
but the largest tree's size reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import crc32_sql, read, sealed, stage

ARITY = 3
BAND = 4  # levels between persisted tables
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SIBLINGS = "array<struct<l:string,r:string>>"


def sha(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_of(*fields: Column) -> Column:
    """Digest of fields as text, each '-' if null, else its UTF-8 byte count, ':' and itself."""
    texts = [f.cast("string") for f in fields]
    return sha(*(F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts))


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Staged rows with pos (from 0) and total of their tree, by tree and order."""
    line = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("at_", F.monotonically_increasing_id())
    line = stage(line.withColumn("part_", F.shiftright("at_", 33)), "in-order", clean=True)
    parts = line.groupBy("tree", "part_").agg(F.min("at_").alias("first_"), F.count("*").alias("n_"))
    before = Window.partitionBy("tree").orderBy("part_")
    parts = parts.select("tree", "part_", (F.sum("n_").over(before) - F.col("n_") - F.col("first_")).alias("shift_"), F.sum("n_").over(Window.partitionBy("tree")).alias("total"))
    return line.join(parts, ["tree", "part_"]).withColumn("pos", F.col("at_") + F.col("shift_")).drop("at_", "part_", "shift_")


def _above(level: Column) -> Column:
    """The digests of a level's parents."""
    last = F.floor((F.size(level) - 1) / ARITY).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: sha(F.array_join(F.slice(level, i * ARITY + 1, ARITY), "")))


def _levels(groups: DataFrame) -> DataFrame:
    """Adds l0 .. l<BAND>: the digests of a group level by level; a tree with one node left stays as it is."""
    out = groups.withColumn("l0", F.transform("nodes", lambda x: x["digest"]))
    for j in range(BAND):
        now, left = F.col(f"l{j}"), F.ceil(F.col("total") / ARITY**j)
        out = sealed(out.withColumn(f"l{j + 1}", F.when(left > 1, _above(now)).otherwise(now)))
    return out


def build(nodes: DataFrame, name: str) -> list[DataFrame]:
    """Persisted groups, from the leaves up, of nodes (tree, pos, total, digest and others): tree, pos, total, rest, nodes, l0 .., top.

    pos is the group's place among the groups of its tree, rest how many nodes its tree has above the group's levels.
    """
    bands: list[DataFrame] = []
    while True:
        width = ARITY**BAND
        others = [c for c in nodes.columns if c not in ("tree", "pos", "total", "digest")]
        node = F.struct("pos", "digest", *others)
        groups = nodes.groupBy("tree", "total", F.floor(F.col("pos") / width).alias("group_")).agg(F.sort_array(F.collect_list(node)).alias("nodes"))
        groups = groups.select("tree", F.col("group_").alias("pos"), "total", F.ceil(F.col("total") / width).alias("rest"), "nodes")
        bands.append(stage(_levels(groups).withColumn("top", F.element_at(f"l{BAND}", 1)), f"{name}-{len(bands)}", clean=True))
        above = bands[-1].where("rest > 1").select("tree", "pos", F.col("rest").alias("total"), F.col("top").alias("digest"))
        if not above.limit(1).count():
            return bands
        nodes = above


def _siblings(place: Column) -> Column:
    """The siblings of the node above place on each level of its group that is hashed into another."""
    found = []
    for j in range(BAND):
        at = F.floor(place / ARITY**j).cast("int")
        first, row = at - at % ARITY, F.col(f"l{j}")
        part = lambda start, n, row=row: F.array_join(F.slice(row, start + 1, n), "")
        here = F.struct(part(first, at - first).alias("l"), part(at + 1, first + ARITY - 1 - at).alias("r"))
        found.append(F.when(F.ceil(F.col("total") / ARITY**j) > 1, F.array(here)).otherwise(F.array().cast(SIBLINGS)))
    return F.concat(*found)


def push(bands: list[DataFrame], tops: DataFrame) -> DataFrame:
    """A row a leaf: tree, the columns of its node, its proof, and what tops (tree, proof and others) hands down."""
    handed = [c for c in tops.columns if c != "tree"]
    others = [c for c in handed if c != "proof"]
    below = None
    for k in range(len(bands) - 1, -1, -1):
        ended = bands[k].where("rest = 1").select("tree", "pos").join(tops, "tree")
        above = ended if below is None else ended.unionByName(below.select("tree", "pos", *handed))
        rows = bands[k].join(above.withColumnRenamed("proof", "rest_of_proof"), ["tree", "pos"]).drop("pos")
        rows = rows.withColumn("node_", F.explode("nodes"))
        proof = F.concat(_siblings(F.col("node_.pos") % ARITY**BAND), F.col("rest_of_proof"))
        below = rows.select("tree", "node_.*", proof.alias("proof"), *others)
        if k:
            below = stage(below, f"proofs-{k}", clean=True)
    return below


def manifest(docs: DataFrame, claimed: Column, id_col: str = "doc_id", tree_col: str = "source", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    claimed is the digest that a reader of the row computes (null: the leaf); it is folded with the row's proof into
    folded_root, verified is whether that is root. Rows of a tree ascend by id, null first, rows of one id by digest, equal
    ones in any order. A null tree is a tree, the first. Nulls in fields are '-'. Other columns are ignored, whatever
    their names; an empty table gives no rows.
    """
    tree = F.when(F.col(tree_col).isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(tree_col).cast("string")))
    leaf = leaf_of(*map(F.col, fields))
    rows = docs.select(tree.alias("tree"), F.col(id_col).alias("doc_id"), leaf.alias("digest"), claimed.alias("claimed"), F.monotonically_increasing_id().alias("row_"))
    rows = placed(stage(rows, "leaves"), ["doc_id", "digest", "row_"]).drop("row_")
    leaves = build(rows, "tree")
    roots = leaves[0].where("rest = 1").select("tree", "top")
    for band in leaves[1:]:
        roots = roots.union(band.where("rest = 1").select("tree", "top"))
    roots = roots.select(F.lit("").alias("of_"), F.col("tree").alias("name"), F.col("top").alias("digest")).withColumnRenamed("of_", "tree")
    forest = build(placed(stage(roots, "roots"), ["name"]), "forest")
    root = forest[-1].where("rest = 1").select("tree", F.array().cast(SIBLINGS).alias("proof"), F.col("top").alias("root"))
    tops = stage(push(forest, root).select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "root", "proof"), "tops", clean=True)
    out = push(leaves, tops)
    folded = F.aggregate("proof", F.coalesce("claimed", "digest"), lambda h, s: sha(s["l"], h, s["r"]))
    out = sealed(out.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", sha(F.array_join(F.transform("proof", lambda s: F.concat(s["l"], s["r"])), "")).alias("proof_sha256"), folded.alias("folded_root")))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    struck = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return manifest(read(spark, sf_dir, "documents"), F.when(struck, leaf_of(*map(F.col, FIELDS[:-1]), tampered)))


def _field(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE concat(strlen(CAST({column} AS VARCHAR)), ':', CAST({column} AS VARCHAR)) END"


_LEAF = f"sha256(concat({', '.join(map(_field, FIELDS))}))"
_BAD = f"sha256(concat({', '.join(map(_field, FIELDS[:-1]))}, {_field("replace(text, chr(10), '')")}))"
_UP = f"list_transform(range(0, len(l), {ARITY}), lambda i: sha256(array_to_string(l[i + 1 : i + {ARITY}], '')))"
OP12_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, source, {_LEAF} AS leaf, CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN {_BAD} END AS bad FROM documents),
lined AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS nth FROM leaves),
tree AS (SELECT source, 0 AS level, list(leaf ORDER BY nth) AS l FROM lined GROUP BY source
  UNION ALL SELECT source, level + 1, {_UP} FROM tree WHERE len(l) > 1),
roots AS (SELECT source, l[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM tree WHERE len(l) = 1),
forest AS (SELECT 0 AS level, list(subroot ORDER BY place) AS l FROM roots
  UNION ALL SELECT level + 1, {_UP} FROM forest WHERE len(l) > 1),
steps AS (
  SELECT r.doc_id, r.source, r.nth, t.level AS k, CAST(r.nth // CAST(pow({ARITY}, t.level) AS BIGINT) AS BIGINT) AS p, t.l FROM lined r JOIN tree t ON r.source IS NOT DISTINCT FROM t.source AND len(t.l) > 1
  UNION ALL SELECT r.doc_id, r.source, r.nth, 1000 + f.level, CAST(o.place // CAST(pow({ARITY}, f.level) AS BIGINT) AS BIGINT), f.l FROM lined r JOIN roots o ON r.source IS NOT DISTINCT FROM o.source JOIN forest f ON len(f.l) > 1),
sides AS (SELECT source, nth, k, array_to_string(l[p - p % {ARITY} + 1 : p], '') AS a, array_to_string(l[p + 2 : p - p % {ARITY} + {ARITY}], '') AS z FROM steps),
proofs AS (SELECT source, nth, list({{'a': a, 'z': z}} ORDER BY k) AS proof FROM sides GROUP BY source, nth),
start AS (SELECT r.*, coalesce(proof, []) AS proof FROM lined r LEFT JOIN proofs q ON r.source IS NOT DISTINCT FROM q.source AND r.nth = q.nth),
fold AS (SELECT source, nth, 0 AS k, coalesce(bad, leaf) AS h, proof FROM start
  UNION ALL SELECT source, nth, k + 1, sha256(concat(proof[k + 1].a, h, proof[k + 1].z)), proof FROM fold WHERE k < len(proof))
SELECT s.doc_id, s.leaf, o.subroot, (SELECT l[1] FROM forest WHERE len(l) = 1) AS root, sha256(array_to_string(list_transform(s.proof, lambda x: concat(x.a, x.z)), '')) AS proof_sha256,
  f.h AS folded_root, f.h = (SELECT l[1] FROM forest WHERE len(l) = 1) AS verified
FROM start s JOIN roots o ON s.source IS NOT DISTINCT FROM o.source JOIN fold f ON s.source IS NOT DISTINCT FROM f.source AND s.nth = f.nth AND f.k = len(s.proof)
"""
