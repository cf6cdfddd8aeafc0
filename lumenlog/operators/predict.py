"""Diagnostic predictors: six channels of smoothed train rates, blended by fixed weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.functions import scalars as S

from .graphs import both_ways
from .ranking import first_rows

ALPHA = 5.0
CHANNELS = ("global", "kc", "item", "user", "graph", "freq")
#: Weights of the channels by model.
WEIGHTS = {
    "bkt": {"global": 0.15, "kc": 0.85},
    "dkt": {"global": 0.20, "kc": 0.35, "item": 0.20, "user": 0.25},
    "simplekt": {"global": 0.15, "kc": 0.45, "item": 0.40},
    "akt": {"global": 0.15, "kc": 0.35, "item": 0.25, "user": 0.15, "freq": 0.10},
    "gkt": {"global": 0.15, "kc": 0.45, "graph": 0.40},
    "gikt": {"global": 0.10, "kc": 0.30, "item": 0.30, "graph": 0.30},
    "skt": {"global": 0.10, "kc": 0.38, "item": 0.10, "graph": 0.42},
    "dygkt": {"global": 0.10, "kc": 0.33, "item": 0.05, "user": 0.22, "graph": 0.30},
    "dgekt": {"global": 0.08, "kc": 0.30, "item": 0.27, "graph": 0.35},
}
GRAPH_MODELS = tuple(m for m, w in WEIGHTS.items() if "graph" in w)


def rates(train: DataFrame, key: str, alpha: float = ALPHA) -> DataFrame:
    """(fold, key, rate, n): outcomes smoothed towards the fold's mean."""
    by = train.groupBy("fold", key).agg(F.sum("correct").alias("s"), F.count("*").alias("n"))
    g = by.groupBy("fold").agg((F.sum("s") / F.sum("n")).alias("g"))
    return by.join(F.broadcast(g), "fold").select("fold", key, ((F.col("s") + alpha * F.col("g")) / (F.col("n") + alpha)).alias("rate"), "n")  # a row a fold


def neighbour_rates(edges: DataFrame, kc_rates: DataFrame) -> DataFrame:
    """(fold, kc_id, rate): mean rate of a component's neighbours, reciprocal edges counted twice."""
    near = both_ways(edges, ["fold"]).join(kc_rates.select("fold", F.col("kc_id").alias("dst_kc"), "rate"), ["fold", "dst_kc"])
    return near.groupBy("fold", F.col("src_kc").alias("kc_id")).agg(F.avg("rate").alias("rate"))


def graph_rates(pre: DataFrame, sim: DataFrame, kc_rates: DataFrame, own_rates: DataFrame | None = None) -> DataFrame:
    """The graph channel: similarity's value before the prerequisites'; without any edge the components' own rates.

    kc_rates are the neighbours' rates; own_rates, where they differ, those of the rows that a model may see.
    """
    a, b = (neighbour_rates(e, kc_rates) for e in (pre, sim))
    both = a.withColumnRenamed("rate", "a").join(b.withColumnRenamed("rate", "b"), ["fold", "kc_id"], "full").select("fold", "kc_id", F.coalesce("b", "a").alias("rate"))
    bare = (kc_rates if own_rates is None else own_rates).join(both.select("fold").distinct(), "fold", "left_anti").select("fold", "kc_id", "rate")
    return both.union(bare)


def channels(train: DataFrame, rows: DataFrame, graph: DataFrame | None, keep_n: bool = False) -> DataFrame:
    """rows with the six channels; a key that train lacks gets the global mean, as does graph where none is given.

    keep_n: n stays, the train rows of the component (null: none). The component is met last, so rows of one are
    together when their scores are counted.
    """
    g = train.groupBy("fold").agg(F.avg("correct").alias("global"))
    kc = rates(train, "kc_id")
    top = kc.groupBy("fold").agg(F.greatest(F.max("n"), F.lit(1)).alias("top"))
    out = rows.join(F.broadcast(g.join(top, "fold")), "fold")  # a row a fold
    for name, key in (("user", "user_id"), ("item", "item_id")):
        out = out.join(rates(train, key).select("fold", key, F.col("rate").alias(name)), ["fold", key], "left")
    out = out.join(kc.select("fold", "kc_id", F.col("rate").alias("kc"), "n"), ["fold", "kc_id"], "left")
    if graph is None:
        out = out.withColumn("graph", F.lit(None).cast("double"))
    else:
        out = out.join(graph.select("fold", "kc_id", F.col("rate").alias("graph")), ["fold", "kc_id"], "left")
    for name in ("kc", "item", "user", "graph"):
        out = out.withColumn(name, F.coalesce(name, "global"))
    freq = 0.5 * F.col("global") + 0.5 * F.coalesce("n", F.lit(0)) / F.col("top")
    return out.withColumn("freq", freq).drop("top", *([] if keep_n else ["n"]))


def blend(model: str):
    """y_prob of a model over the channels, to nine decimals, so that equal inputs tie in any engine."""
    weights = WEIGHTS[model]
    total = sum(weights.values())
    return F.round(S.clip(sum((F.lit(w) * F.col(c) for c, w in weights.items()), F.lit(0.0)) / total), 9)


def sample(pred: DataFrame, most: int = 5000) -> DataFrame:
    """The first rows of each fold and model, by learner and order; only rows of the learner at the end are ranked."""
    return first_rows(pred, ["fold", "model"], [("user_id", True)], ["seq", "item_id", "kc_id"], most)


def predictions(features: DataFrame, models: tuple[str, ...] = tuple(WEIGHTS)) -> DataFrame:
    """fold, user_id, item_id, kc_id, seq, y_true, model, y_prob: all models in one pass over the features; seq and stratum where features have them."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), blend(m).alias("y_prob")) for m in models)))
    own = ["fold", "user_id", "item_id", "kc_id", *(c for c in ("seq", "stratum") if c in features.columns)]
    return features.select(*own, F.col("correct").alias("y_true"), each.alias("p")).select(*own, "y_true", "p.model", "p.y_prob")
