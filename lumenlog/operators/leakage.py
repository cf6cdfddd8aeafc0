"""Leakage of held-out evidence into inferred graphs; one row a fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graphs import transitions
from .splits import in_order


def ecr_flag(tagged: DataFrame) -> DataFrame:
    """1 where a learner of the fold is in two splits."""
    users = tagged.groupBy("fold", "user_id").agg(F.count_distinct("split").alias("n"))
    return users.groupBy("fold").agg(F.max(F.when(F.col("n") > 1, 1.0).otherwise(0.0)).alias("ecr_flag"))


def ecr_overlap(edges: DataFrame, held: DataFrame) -> DataFrame:
    """Share of edges with a held-out transition or an item that held-out rows tag with both ends; held may be what steps gives."""
    moved = transitions(held, ["fold"]).select("fold", "src_kc", "dst_kc", F.lit(True).alias("moved"))
    q = held.select("fold", "item_id", F.col("kc_id").alias("src_kc")).distinct()
    ends = edges.select("fold", "src_kc", "dst_kc").distinct()
    # only pairs of an edge are asked for, so the edge meets its source's items and then its destination's
    other = q.select("fold", "item_id", F.col("src_kc").alias("dst_kc"))
    shared = ends.join(q, ["fold", "src_kc"]).join(other, ["fold", "item_id", "dst_kc"], "left_semi").select("fold", "src_kc", "dst_kc").distinct().withColumn("shared", F.lit(True))
    joined = edges.join(moved, ["fold", "src_kc", "dst_kc"], "left").join(shared, ["fold", "src_kc", "dst_kc"], "left")
    return joined.groupBy("fold").agg(F.avg(F.when(F.col("moved") | F.col("shared"), 1.0).otherwise(0.0)).alias("ecr_overlap"))


def eoc(edges: DataFrame, test: DataFrame) -> DataFrame:
    """sqrt(2 + 2 r^2) of edge weight and the mean test outcome of both ends; 0 where r is undefined."""
    means = test.groupBy("fold", "kc_id").agg(F.avg("correct").alias("y"))
    ends = edges.join(means.select("fold", F.col("kc_id").alias("src_kc"), F.col("y").alias("a")), ["fold", "src_kc"]).join(means.select("fold", F.col("kc_id").alias("dst_kc"), F.col("y").alias("b")), ["fold", "dst_kc"])
    y = (F.col("a") + F.col("b")) / 2
    s = ends.withColumn("y", y).groupBy("fold").agg(F.count("*").alias("n"), F.stddev_pop("weight").alias("sw"), F.stddev_pop("y").alias("sy"), F.corr("weight", "y").alias("r"))
    sound = (F.col("n") >= 2) & (F.col("sw") > 1e-12) & (F.col("sy") > 1e-12)
    return s.select("fold", F.when(sound, F.sqrt(2 + 2 * F.col("r") * F.col("r"))).otherwise(F.lit(0.0)).alias("eoc"))


def tbvr(train: DataFrame, edges: DataFrame, train_ratio: float = 0.7) -> DataFrame:
    """Share of positions after each learner's cutoff that end or begin a transition kept as an edge."""
    if not 0 < train_ratio < 1:
        raise ValueError("train_ratio must lie between 0 and 1")
    order = in_order(["fold"])
    rows = train.select("fold", "user_id", F.col("kc_id").alias("src_kc"), F.lead("kc_id").over(order).alias("dst_kc"), (F.row_number().over(order) - 1).alias("i"), F.count("*").over(Window.partitionBy("fold", "user_id")).alias("n"))
    kept = edges.select("fold", "src_kc", "dst_kc").distinct().withColumn("kept", F.lit(True))
    rows = rows.join(kept, ["fold", "src_kc", "dst_kc"], "left").withColumn("r", F.coalesce("kept", F.lit(False)))
    before = F.coalesce(F.lag("r").over(Window.partitionBy("fold", "user_id").orderBy("i")), F.lit(False))
    rows = rows.withColumn("hit", F.col("r") | before).where(F.col("i") >= F.floor(F.lit(train_ratio) * F.col("n")))
    return rows.groupBy("fold").agg(F.avg(F.when(F.col("hit"), 1.0).otherwise(0.0)).alias("tbvr"))


def leakage_row(tagged: DataFrame, pre: DataFrame, sim: DataFrame, train_ratio: float = 0.7) -> DataFrame:
    edges = pre.select("fold", "src_kc", "dst_kc", "weight").union(sim.select("fold", "src_kc", "dst_kc", "weight"))
    parts = [ecr_overlap(edges, tagged.where("split <> 'train'")), eoc(edges, tagged.where("split = 'test'")), tbvr(tagged.where("split = 'train'"), pre, train_ratio)]
    out = ecr_flag(tagged)
    for part in parts:
        out = out.join(part, "fold", "left")
    return out.select("fold", "ecr_flag", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("ecr_overlap", "eoc", "tbvr")))
