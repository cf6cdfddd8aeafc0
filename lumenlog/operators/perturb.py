"""Graph perturbations and the share of edges they lose, swept over strengths and seeds in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.functions import scalars as S
from lumenlog.sources.staging import stage

AUGMENTATIONS = ("subgraph", "edge_drop", "node_drop", "attr_mask")
STRENGTHS = (0.05, 0.1, 0.2, 0.3)
SEEDS = (42, 17, 1234)


def settings(edges: DataFrame, ps=STRENGTHS, seeds=SEEDS) -> DataFrame:
    """edges once for each strength and seed."""
    each = F.explode(F.array(*(F.struct(F.lit(float(p)).alias("p"), F.lit(s).alias("seed")) for p in ps for s in seeds)))
    return edges.select("*", each.alias("set_")).select(*edges.columns, "set_.p", "set_.seed")


def _draw(*parts):
    return S.hash_below(F.col("p"), F.col("seed").cast("string"), *parts)


def edge_drop(swept: DataFrame) -> DataFrame:
    """Adds kept: false for edges that a seeded draw drops."""
    return swept.withColumn("kept", ~_draw(F.lit(":"), F.col("src_kc").cast("string"), F.lit(">"), F.col("dst_kc").cast("string")))


def node_drop(swept: DataFrame) -> DataFrame:
    """Adds kept: false for edges with an end that a seeded draw of the nodes drops; a node draws by its id alone."""
    gone = [_draw(F.lit(":"), F.col(c).cast("string")) for c in ("src_kc", "dst_kc")]
    return swept.withColumn("kept", ~gone[0] & ~gone[1])


def attr_mask(swept: DataFrame) -> DataFrame:
    """Attributes of drawn edges are masked; every edge is kept."""
    masked = _draw(F.lit("m"), F.col("src_kc").cast("string"), F.lit(">"), F.col("dst_kc").cast("string"))
    return swept.withColumn("weight", F.when(~masked, F.col("weight"))).withColumn("source", F.when(masked, "masked").otherwise(F.col("source"))).withColumn("kept", F.lit(True))


def lost_share(perturbed: DataFrame, name: str) -> DataFrame:
    """fold, augmentation, p, seed, ddr: distinct edges lost over distinct edges."""
    by = perturbed.groupBy("fold", "p", "seed", "src_kc", "dst_kc").agg(F.bool_or("kept").alias("kept"))
    return by.groupBy("fold", "p", "seed").agg(F.avg(F.when(F.col("kept"), 0.0).otherwise(1.0)).alias("ddr")).select("fold", F.lit(name).alias("augmentation"), "p", "seed", "ddr")


def _hash(digits: int, *parts) -> Column:
    """A whole number from the first hexadecimal digits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(*(x.cast("string") for x in parts))), 1, digits), 16, 10).cast("long")


def growth(edges: DataFrame, seeds=SEEDS) -> DataFrame:
    """(fold, seed, kc, start_, from_, time_): when a seeded growth over the undirected graph reaches each node.

    An edge takes a seeded time to pass. Growth begins at the node of least seeded draw and, where a component is full,
    again at the least of the rest; from_ is where it began, start_ that node's draw, time_ the first passage from there.
    All graphs and seeds grow in the same rounds: a frontier join of each node's best time with its edges, as many rounds
    as the longest quickest way has edges.
    """
    each = F.explode(F.array(*map(F.lit, seeds))).alias("seed")
    ends = edges.where("src_kc <> dst_kc").select("fold", F.least("src_kc", "dst_kc").alias("a"), F.greatest("src_kc", "dst_kc").alias("b")).distinct().select("fold", "a", "b", each)
    took = ends.withColumn("took", _hash(7, F.col("seed"), F.lit(":"), F.col("a"), F.lit("-"), F.col("b")) + 1)
    both = stage(took.select("fold", "seed", F.col("a").alias("kc"), F.col("b").alias("to"), "took").union(took.select("fold", "seed", F.col("b"), F.col("a"), "took")), "passages")
    nodes = edges.select("fold", F.explode(F.array("src_kc", "dst_kc")).alias("kc")).distinct().select("fold", "kc", each)
    now = nodes.select("fold", "seed", "kc", F.struct(_hash(8, F.col("seed"), F.lit(":"), F.col("kc")).alias("start_"), F.col("kc").alias("from_"), F.lit(0).cast("long").alias("time_")).alias("s"))
    now, mark = stage(now, "growth"), None
    while True:
        said = now.agg(F.sum("s.start_"), F.sum("s.time_"), F.sum("s.from_")).first()
        if said == mark:
            return now.select("fold", "seed", "kc", "s.*")
        mark = said
        passed = now.join(both, ["fold", "seed", "kc"]).select("fold", "seed", F.col("to").alias("kc"), F.struct("s.start_", "s.from_", (F.col("s.time_") + F.col("took")).alias("time_")).alias("s"))
        now = stage(now.union(passed).groupBy("fold", "seed", "kc").agg(F.min("s").alias("s")), "growth")


def kept_nodes(edges: DataFrame, ps=STRENGTHS, seeds=SEEDS) -> DataFrame:
    """(fold, p, seed, kc): the first ceil((1 - p) n) nodes that growth reaches, at least one.

    A graph's nodes, at most twice its edge cap, are ranked together.
    """
    line = Window.partitionBy("fold", "seed").orderBy("start_", "from_", "time_", "kc")
    ranked = growth(edges, seeds).withColumn("rank_", F.row_number().over(line)).withColumn("n_", F.count("*").over(Window.partitionBy("fold", "seed")))
    ranked = ranked.withColumn("p", F.explode(F.array(*(F.lit(float(p)) for p in ps))))
    return ranked.where(F.col("rank_") <= F.greatest(F.lit(1), F.ceil(F.round((1 - F.col("p")) * F.col("n_"), 9)))).select("fold", "p", "seed", "kc")


def subgraph(edges: DataFrame, ps=STRENGTHS, seeds=SEEDS) -> DataFrame:
    """settings(edges) with kept: false for edges with an end that a seeded growth does not reach in time."""
    nodes = kept_nodes(edges, ps, seeds)
    out = settings(edges, ps, seeds)
    for end, name in (("src_kc", "a_"), ("dst_kc", "b_")):
        out = out.join(nodes.select("fold", "p", "seed", F.col("kc").alias(end), F.lit(True).alias(name)), ["fold", "p", "seed", end], "left")
    return out.withColumn("kept", F.col("a_").isNotNull() & F.col("b_").isNotNull()).drop("a_", "b_")


def sweep(edges: DataFrame, augmentations=AUGMENTATIONS, ps=STRENGTHS, seeds=SEEDS) -> DataFrame:
    swept, out = settings(edges, ps, seeds), None
    by_name = {"edge_drop": edge_drop, "node_drop": node_drop, "attr_mask": attr_mask}
    for name in augmentations:
        if name not in AUGMENTATIONS:
            raise ValueError(f"unknown augmentation {name}")
        part = lost_share(subgraph(edges, ps, seeds) if name == "subgraph" else by_name[name](swept), name)
        out = part if out is None else out.unionByName(part)
    return out


def summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("augmentation", "p").agg(F.avg("ddr").alias("ddr_mean"), F.coalesce(F.stddev_samp("ddr"), F.lit(0.0)).alias("ddr_std"), F.count("*").alias("n"))
