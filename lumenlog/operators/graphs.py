"""Graphs of knowledge components inferred from interactions; keys (such as fold) lead every grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.sources.logs import tasks as tasks_of
from lumenlog.sources.staging import stage

from .ranking import first_rows
from .splits import in_order


def q_matrix(log: DataFrame, keys: list[str]) -> DataFrame:
    return log.select(*keys, "item_id", "kc_id").distinct()


def steps(log: DataFrame, keys: list[str], tasks: int | None = None) -> DataFrame:
    """user_id, item_id, kc_id and next_kc, the component of the learner's next row; tasks share the log where they are told."""
    if tasks:
        log = log.repartition(tasks, "user_id")
    return log.select(*keys, "user_id", "item_id", "kc_id", F.lead("kc_id").over(in_order(keys)).alias("next_kc"))


def transitions(log: DataFrame, keys: list[str], tasks: int | None = None) -> DataFrame:
    """(keys, src_kc, dst_kc, support): counts of consecutive different components of a learner; log may be what steps gives.

    More tasks than those of a shuffle, where they are told, share the pairs before they are counted.
    """
    nxt = F.col("next_kc") if "next_kc" in log.columns else F.lead("kc_id").over(in_order(keys))
    pairs = log.select(*keys, F.col("kc_id").alias("src_kc"), nxt.alias("dst_kc")).where("dst_kc is not null and src_kc <> dst_kc")
    if tasks and tasks > int(log.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        pairs = pairs.repartition(tasks, *keys, "src_kc", "dst_kc")
    return pairs.groupBy(*keys, "src_kc", "dst_kc").agg(F.count("*").alias("support"))


def prerequisites(counts: DataFrame, keys: list[str], quantile: float = 0.9, top_k: int = 10, max_edges: int = 5000, source: str = "train_only") -> DataFrame:
    """Edges whose support reaches the exact quantile, the top_k of each source, at most max_edges of each key.

    The least support is 1 for up to 10 pairs, else the quantile, 2 at least. Where no pair reaches it the 200 of
    highest support stand in. Weight is support over the largest support kept. counts is a pair table, far smaller
    than the log; its statistics are joined to it rather than recomputed.
    """
    stats = counts.groupBy(*keys).agg(F.count("*").alias("n_"), F.ceil(F.percentile("support", F.lit(quantile))).alias("q_"), F.max("support").alias("max_"))
    least = F.when(F.col("n_") > 10, F.greatest(F.lit(2), F.col("q_"))).otherwise(F.lit(1))
    df = counts.join(F.broadcast(stats), keys) if keys else counts.crossJoin(F.broadcast(stats))  # a row a key
    by = lambda *cols: Window.partitionBy(*cols) if cols else Window.partitionBy(F.lit(0))
    order = [F.desc("support"), "src_kc", "dst_kc"]
    reached = df.where(F.col("support") >= least)
    spare = df.where(F.col("max_") < least).withColumn("r_", F.row_number().over(by(*keys).orderBy(*order))).where("r_ <= 200").drop("r_")
    kept = reached.unionByName(spare)
    if (spread := tasks_of(counts)) > int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        kept = kept.repartition(spread, *keys, "src_kc")
    kept = kept.withColumn("r_", F.row_number().over(by(*keys, "src_kc").orderBy(*order[:1], "dst_kc"))).where(F.col("r_") <= top_k)
    kept = stage(first_rows(kept.drop("r_"), keys, [("support", False), ("src_kc", True)], ["dst_kc"], max_edges), "strongest")  # max_edges rows a key
    tops = kept.groupBy(*keys).agg(F.greatest(F.max("support"), F.lit(1)).alias("top_"))
    kept = kept.join(F.broadcast(tops), keys) if keys else kept.crossJoin(F.broadcast(tops))  # a row a key
    return kept.select(*keys, "src_kc", "dst_kc", "support", (F.col("support").cast("double") / F.col("top_")).alias("weight"), F.lit(source).alias("source"))


LIST = 256  # components of an item that are one list
LINES = 1 << 17  # lists that one task counts


def similarities(q: DataFrame, keys: list[str], method: str = "jaccard", threshold: float = 0.1, source: str = "train_only") -> DataFrame:
    """Edges in both directions between components that share items, by Jaccard or pointwise mutual information.

    Each component of an item is sent, by component, a list of the item's other components after it, those of most items
    first; so each pair is told once, as one number of a list, and counted where it arrives. Where the Jaccard index
    reaches the threshold, so does the share of the larger component's items: other pairs go before they meet the size
    of the smaller one.
    """
    if method not in ("jaccard", "pmi"):
        raise ValueError(f"unknown method {method}")
    q = stage(q, "q")
    sizes = q.groupBy(*keys, "kc_id").agg(F.count("*").alias("n"))
    line = Window.partitionBy(*keys, "item_id").orderBy(F.desc("n"), "kc_id")
    ranked = q.where("item_id is not null and kc_id is not null").join(sizes, [*keys, "kc_id"]).withColumn("at", F.row_number().over(line) - 1)
    ranked = ranked.select(*keys, "item_id", F.col("kc_id").alias("src_kc"), F.col("n").alias("n1"), "at", F.floor(F.col("at") / LIST).alias("part"))
    lists = ranked.groupBy(*keys, "item_id", F.col("part").alias("of")).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "src_kc"))), lambda x: x["src_kc"]).alias("list"))
    after = F.when(F.col("of") == F.col("part"), F.expr(f"slice(list, int(at % {LIST} + 2), {LIST})")).otherwise(F.col("list"))
    lines = ranked.join(lists, [*keys, "item_id"]).where("of >= part").select(*keys, "src_kc", "n1", after.alias("list")).where(F.size("list") > 0)
    tasks = max(int(q.sparkSession.conf.get("spark.sql.shuffle.partitions")), q.count() // LINES)
    told = lines.repartition(tasks, *keys, "src_kc").select(*keys, "src_kc", "n1", F.explode("list").alias("dst_kc"))
    inter = told.groupBy(*keys, "src_kc", "n1", "dst_kc").agg(F.count("*").alias("inter"))
    if method == "jaccard":
        inter = inter.where(F.col("inter") >= F.col("n1") * (threshold * (1 - 1e-9)))
    inter = inter.join(sizes.select(*keys, F.col("kc_id").alias("dst_kc"), F.col("n").alias("n2")), [*keys, "dst_kc"])
    if method == "jaccard":
        weight = F.col("inter").cast("double") / (F.col("n1") + F.col("n2") - F.col("inter"))
    else:
        items = q.groupBy(*keys).agg(F.count_distinct("item_id").alias("items"))
        inter = inter.join(F.broadcast(items), keys) if keys else inter.crossJoin(F.broadcast(items))  # a row a key
        weight = F.log(F.col("inter").cast("double") * F.col("items") / (F.col("n1") * F.col("n2")))
    ends = F.explode(F.array(F.struct("src_kc", "dst_kc"), F.struct(F.col("dst_kc").alias("src_kc"), F.col("src_kc").alias("dst_kc")))).alias("e")
    kept = inter.withColumn("weight", weight).where(F.col("weight") >= threshold).select(*keys, ends, F.col("inter").alias("support"), "weight")
    return kept.select(*keys, "e.src_kc", "e.dst_kc", "support", "weight", F.lit(source).alias("source"))


def graph_stats(pre: DataFrame, sim: DataFrame, q: DataFrame, keys: list[str]) -> DataFrame:
    n = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    kcs = q.groupBy(*keys).agg(F.count_distinct("kc_id").alias("n_kcs"))
    out = kcs.join(n(pre, "n_prerequisite_edges"), keys, "left").join(n(sim, "n_similarity_edges"), keys, "left")
    return out.select(*keys, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_prerequisite_edges", "n_similarity_edges")), "n_kcs")


def both_ways(edges: DataFrame, keys: list[str]) -> DataFrame:
    return edges.select(*keys, "src_kc", "dst_kc").union(edges.select(*keys, F.col("dst_kc").alias("src_kc"), F.col("src_kc").alias("dst_kc")))


def adjacency(edges: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    """Sparse symmetrised matrix (i, j, w) over dense ids, rows summing to 1, an empty diagonal."""
    dense = both_ways(edges, keys)
    for end, name in (("src_kc", "i"), ("dst_kc", "j")):
        dense = dense.join(ids.select(*keys, F.col("kc_id").alias(end), F.col("dense").alias(name)), [*keys, end])
    cells = dense.where("i <> j").groupBy(*keys, "i", "j").agg(F.count("*").cast("double").alias("c"))
    return cells.select(*keys, "i", "j", (F.col("c") / F.sum("c").over(Window.partitionBy(*keys, "i"))).alias("w"))
