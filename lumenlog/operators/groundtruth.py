"""Inferred graphs against an expert one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.functions import scalars as S
from lumenlog.sources.staging import stage

from .sequences import dense_ids

TOP_K = (200, 500, 800, 1200, 1800, 2500, 3500, 5000)


def by_strength(edges: DataFrame) -> list[Column]:
    """The order of inferred edges: by support, else by weight, strongest first, ties by ids; by ids alone without either."""
    strength = next((c for c in ("support", "weight") if c in edges.columns), None)
    return [*([F.desc(strength)] if strength else []), F.col("src_kc"), F.col("dst_kc")]


def ranked(inferred: DataFrame, most: int) -> DataFrame:
    """The strongest `most` edges with rank_ from 1: each task keeps its own strongest, so one task ranks `most` rows."""
    order = by_strength(inferred)
    first = inferred.orderBy(*order).limit(max(0, most))
    return first.withColumn("rank_", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def align(expert: DataFrame, train: DataFrame) -> DataFrame:
    """Expert edges with status: matched, or missing_src, missing_dst, missing_both among the train components."""
    known = train.select("kc_id").distinct()
    for end, flag in (("src_kc", "has_src"), ("dst_kc", "has_dst")):
        expert = expert.join(known.select(F.col("kc_id").alias(end), F.lit(True).alias(flag)), end, "left")
    a, b = F.col("has_src").isNotNull(), F.col("has_dst").isNotNull()
    status = F.when(a & b, "matched").when(a, "missing_dst").when(b, "missing_src").otherwise("missing_both")
    return expert.select("src_kc", "dst_kc", status.alias("status"))


def alignment_report(aligned: DataFrame) -> DataFrame:
    """One row: expert edges by status and the share of matched ones (0 without edges)."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    n = aligned.agg(*map(count, ("matched", "missing_src", "missing_dst", "missing_both")), F.count("*").alias("n"))
    return n.select("matched", "missing_src", "missing_dst", "missing_both", S.ratio(F.col("matched").cast("double"), F.col("n")).alias("alignment_rate"))


def top_edges(inferred: DataFrame, ks) -> DataFrame:
    """(top_k, src_kc, dst_kc): the first k edges for each k, a row an edge and k."""
    each = ranked(inferred, max(ks)).withColumn("top_k", F.explode(F.array(*(F.lit(k) for k in ks))))
    return each.where("rank_ <= top_k").select("top_k", "src_kc", "dst_kc").distinct()


def _per_k(ks, expert: DataFrame) -> DataFrame:
    return expert.select("src_kc", "dst_kc").distinct().select(F.explode(F.array(*(F.lit(k) for k in ks))).alias("top_k"), "src_kc", "dst_kc")


def edge_overlap(inferred: DataFrame, expert: DataFrame, ks) -> DataFrame:
    """top_k, n_inferred_truncated, n_expert_edges, edge_precision, edge_recall, edge_f1."""
    both = top_edges(inferred, ks).withColumn("i", F.lit(1)).join(_per_k(ks, expert).withColumn("e", F.lit(1)), ["top_k", "src_kc", "dst_kc"], "full")
    n = both.groupBy("top_k").agg(F.count("i").alias("ni"), F.count("e").alias("ne"), F.count_if(F.col("i").isNotNull() & F.col("e").isNotNull()).alias("hit"))
    p, r = S.ratio(F.col("hit").cast("double"), F.col("ni")), S.ratio(F.col("hit").cast("double"), F.col("ne"))
    return n.select("top_k", F.col("ni").alias("n_inferred_truncated"), F.col("ne").alias("n_expert_edges"), p.alias("edge_precision"), r.alias("edge_recall"), S.f1(p, r).alias("edge_f1"))


def direction_agreement(inferred: DataFrame, expert: DataFrame, ks) -> DataFrame:
    """Of the unordered pairs in both graphs, the share with the same directions."""

    def ways(df: DataFrame, name: str) -> DataFrame:
        pairs = df.where("src_kc <> dst_kc").select("top_k", F.least("src_kc", "dst_kc").alias("a"), F.greatest("src_kc", "dst_kc").alias("b"), (F.col("src_kc") < F.col("dst_kc")).alias("up"))
        return pairs.groupBy("top_k", "a", "b").agg(F.struct(F.bool_or("up").alias("up"), F.bool_or(~F.col("up")).alias("down")).alias(name))

    both = ways(top_edges(inferred, ks), "x").join(ways(_per_k(ks, expert), "y"), ["top_k", "a", "b"])
    return both.groupBy("top_k").agg(F.count("*").alias("n_pairs"), F.avg(F.when(F.col("x") == F.col("y"), 1.0).otherwise(0.0)).alias("direction_agreement"))


def node_jaccard(inferred: DataFrame, expert: DataFrame, ks) -> DataFrame:
    nodes = lambda df, name: df.select("top_k", F.explode(F.array("src_kc", "dst_kc")).alias("kc")).distinct().withColumn(name, F.lit(1))
    both = nodes(top_edges(inferred, ks), "i").join(nodes(_per_k(ks, expert), "e"), ["top_k", "kc"], "full")
    return both.groupBy("top_k").agg(F.avg(F.when(F.col("i").isNotNull() & F.col("e").isNotNull(), 1.0).otherwise(0.0)).alias("node_jaccard"))


def reachable(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, src_kc, dst_kc): all pairs of different nodes with a path, on cyclic graphs too.

    Nodes are numbered within their key and what a node reaches is a line of 64-bit words, a row a node and word that is
    not empty. A round joins each node with the words of all nodes that it reaches and unites them by bits, so paths
    double in length and the rounds are logarithmic in the longest shortest path. No table between rounds is larger
    than nodes times words; pairs are made once, at the end.
    """
    edges = stage(edges.select(*keys, "src_kc", "dst_kc").where("src_kc <> dst_kc").distinct(), "graph")
    nodes = edges.select(*keys, F.explode(F.array("src_kc", "dst_kc")).alias("kc_id"))
    ids = stage(dense_ids(nodes, "kc_id", keys), "numbers")
    end = lambda kc, name: ids.select(*keys, F.col("kc_id").alias(kc), F.col("dense").alias(name))
    numbered = edges.join(end("src_kc", "u"), [*keys, "src_kc"]).join(end("dst_kc", "v"), [*keys, "dst_kc"])
    united = lambda df: df.groupBy(*keys, "u", "w").agg(F.bit_or("bits").alias("bits"))
    known = stage(united(numbered.select(*keys, "u", F.floor(F.col("v") / 64).alias("w"), F.expr("shiftleft(1L, cast(v % 64 as int))").alias("bits"))), "words")
    reached = lambda: known.select(*keys, "u", "w", F.explode(F.expr("filter(sequence(0, 63), k -> getbit(bits, k) = 1)")).alias("k_")).select(*keys, "u", (F.col("w") * 64 + F.col("k_")).alias("v"))
    n = None
    while (now := known.agg(F.sum(F.bit_count("bits"))).first()[0]) != n:
        n = now
        further = reached().join(known.select(*keys, F.col("u").alias("v"), "w", "bits"), [*keys, "v"]).select(*keys, "u", "w", "bits")
        known = stage(united(known.union(further)), "words")
    pairs = reached().where("u <> v").join(end("src_kc", "u"), [*keys, "u"]).join(end("dst_kc", "v"), [*keys, "v"])
    return pairs.select(*keys, "src_kc", "dst_kc")


def reachability(inferred: DataFrame, expert: DataFrame, ks) -> DataFrame:
    """top_k, reachability_precision, reachability_recall, reachability_f1: both graphs' paths are sought in the same rounds."""
    both = top_edges(inferred, ks).withColumn("i_", F.lit(True)).unionByName(_per_k(ks, expert).withColumn("i_", F.lit(False)))
    pairs = reachable(both, ["top_k", "i_"]).groupBy("top_k", "src_kc", "dst_kc").agg(F.bool_or("i_").alias("i"), F.bool_or(~F.col("i_")).alias("e"))
    n = pairs.groupBy("top_k").agg(F.count_if("i").alias("ni"), F.count_if("e").alias("ne"), F.count_if(F.col("i") & F.col("e")).alias("hit"))
    p, r = S.ratio(F.col("hit").cast("double"), F.col("ni")), S.ratio(F.col("hit").cast("double"), F.col("ne"))
    return n.select("top_k", p.alias("reachability_precision"), r.alias("reachability_recall"), S.f1(p, r).alias("reachability_f1"))


def overlap_metrics(inferred: DataFrame, expert: DataFrame, ks) -> DataFrame:
    out = edge_overlap(inferred, expert, ks)
    for part in (direction_agreement(inferred, expert, ks).drop("n_pairs"), reachability(inferred, expert, ks), node_jaccard(inferred, expert, ks)):
        out = out.join(part, "top_k", "left")
    return out.withColumn("direction_agreement", F.coalesce("direction_agreement", F.lit(0.0)))


def hits_at_k(inferred: DataFrame, expert: DataFrame, ks) -> DataFrame:
    """k, directed_hits, undirected_hits, directed_precision (of the undirected hits), directed_recall (of expert rows).

    Each of the first k edges counts by itself, so both directions of a pair are two undirected hits.
    """
    directed = expert.select("src_kc", "dst_kc").distinct().withColumn("d", F.lit(1))
    pairs = expert.select(F.least("src_kc", "dst_kc").alias("a"), F.greatest("src_kc", "dst_kc").alias("b")).distinct().withColumn("u", F.lit(1))
    each = top_edges(inferred, ks).join(directed, ["src_kc", "dst_kc"], "left").withColumn("a", F.least("src_kc", "dst_kc")).withColumn("b", F.greatest("src_kc", "dst_kc")).join(pairs, ["a", "b"], "left")
    n = each.groupBy("top_k").agg(F.count("d").alias("directed_hits"), F.count("u").alias("undirected_hits"))
    rows = expert.agg(F.count("*").alias("rows"))
    return n.crossJoin(F.broadcast(rows)).select(F.col("top_k").alias("k"), "directed_hits", "undirected_hits", S.ratio(F.col("directed_hits").cast("double"), F.col("undirected_hits")).alias("directed_precision"), S.ratio(F.col("directed_hits").cast("double"), F.col("rows")).alias("directed_recall"))  # rows is one row


def disagreement(inferred: DataFrame, expert: DataFrame, n: int = 20, top_k: int = 800, names: DataFrame | None = None) -> DataFrame:
    """category, rank, src_kc, dst_kc, src_name, dst_name, score: the first n edges of only one graph, and turned ones.

    The inferred graph is its strongest top_k edges. An edge whose opposite the other graph has counts as one that the
    other lacks and also as wrong_direction. Inferred edges score their support, else their weight, else 0; expert ones their
    confidence_score, 1 where the table has none. names: (kc_id, name); a component without a name shows its id.
    """
    both = ["src_kc", "dst_kc"]
    strength = F.coalesce(*(F.col(c).cast("double") for c in ("support", "weight") if c in inferred.columns), F.lit(0.0))
    i = ranked(inferred, top_k).select(*both, strength.alias("score")).groupBy(*both).agg(F.max("score").alias("score"))
    trust = F.col("confidence_score").cast("double") if "confidence_score" in expert.columns else F.lit(1.0)
    e = expert.select(*both, trust.alias("score"))
    known = e.select(*both).distinct()
    back = known.select(F.col("dst_kc").alias("src_kc"), F.col("src_kc").alias("dst_kc"))
    parts = {
        "inferred_only": i.join(known, both, "left_anti"),
        "expert_only": e.join(i.select(*both), both, "left_anti"),
        "wrong_direction": i.join(known, both, "left_anti").join(back, both, "left_semi"),
    }
    out = None
    for name, part in parts.items():
        part = part.select(F.lit(name).alias("category"), *both, "score")
        out = part if out is None else out.union(part)
    order = Window.partitionBy("category").orderBy(F.desc("score"), *both)
    out = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    for end, name in (("src_kc", "src_name"), ("dst_kc", "dst_name")):
        if names is None:
            out = out.withColumn(name, F.col(end).cast("string"))
        else:
            out = out.join(names.select(F.col("kc_id").alias(end), F.col("name").alias(name)), end, "left").withColumn(name, F.coalesce(name, F.col(end).cast("string")))
    return out.select("category", "rank", *both, "src_name", "dst_name", "score")
