"""AUC, accuracy and log loss by group, and their summaries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.functions import scalars as S
from lumenlog.sources.staging import stage

from .ranking import hash_rank


BUCKETS = 4096


def metrics(pred: DataFrame, keys: list[str], eps: float = 1e-4) -> DataFrame:
    """keys, n, auc (tie-aware; null for one class), acc, nll.

    Rows are summed by score, scores are ranked inside BUCKETS ranges of the score, and the ranges before add their
    counts, so no task ranks a whole group.
    """
    p = S.clip(F.col("y_prob"), eps)
    y = F.col("y_true")
    loss = -(y * F.log(p) + (1 - y) * F.log(1 - p))
    by = pred.groupBy(*keys, "y_prob").agg(F.count("*").alias("n"), F.sum("y_true").alias("pos"), F.sum(loss).alias("loss"), F.sum(((F.col("y_prob") >= 0.5) == (y == 1)).cast("long")).alias("right"))
    neg = F.col("n") - F.col("pos")
    sums = lambda df, *by: df.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("n", "pos", "won", "loss", "right")))
    before = lambda *part, order: F.sum(neg).over(Window.partitionBy(*part).orderBy(order)) - neg
    by = by.withColumn("bucket_", F.floor(F.col("y_prob") * BUCKETS))
    ranges = sums(by.withColumn("won", F.col("pos") * (before(*keys, "bucket_", order="y_prob") + neg / 2)), *keys, "bucket_")
    s = sums(ranges.withColumn("won", F.col("won") + F.col("pos") * before(*keys, order="bucket_")), *keys)
    auc = F.when((F.col("pos") > 0) & (neg > 0), F.col("won") / (F.col("pos") * neg))
    return s.select(*keys, "n", auc.alias("auc"), (F.col("right") / F.col("n")).alias("acc"), (F.col("loss") / F.col("n")).alias("nll"))


def strata_of(train: DataFrame, bins=S.STRATA) -> DataFrame:
    """(fold, kc_id, n_train_interactions, stratum)."""
    n = train.groupBy("fold", "kc_id").agg(F.count("*").alias("n_train_interactions"))
    return n.withColumn("stratum", S.stratum(F.col("n_train_interactions"), bins))


def strata_metrics(pred: DataFrame, strata: DataFrame, eps: float = 1e-15) -> DataFrame:
    """Metrics of fold, model and stratum; components without train rows are left out."""
    name = F.col("stratum")
    strata = strata.withColumn("stratum", F.when(name.rlike("user|item"), F.raise_error(F.lit("strata are of components only")).cast("string")).otherwise(name))
    return metrics(pred.join(strata.select("fold", "kc_id", "stratum"), ["fold", "kc_id"]), ["fold", "model", "stratum"], eps)


def fold_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    means = [F.avg(c).alias(c) for c in ("auc", "acc", "nll")]
    return rows.groupBy(*keys).agg(F.count_distinct("fold").alias("n_folds"), F.sum("n").alias("n_eval"), *means)


def fold_report(rows: DataFrame, keys: list[str], n: int = 1000, seed: int = 42) -> DataFrame:
    """fold_summary with bootstrap intervals of each mean, and the first fold's status and note where rows tell them; rows have a metric row a fold."""
    out = fold_summary(rows, keys)
    told = [F.min_by(c, "fold").alias(c) for c in ("status", "note") if c in rows.columns]
    if told:
        out = out.join(rows.groupBy(*keys).agg(*told), keys)
    for c in ("auc", "acc", "nll"):
        ci = bootstrap_ci(rows, keys, c, n, seed).select(*keys, F.col("ci_low").alias(f"{c}_ci_low"), F.col("ci_high").alias(f"{c}_ci_high"))
        out = out.join(ci, keys, "left")
    return out


def leakage_mean(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of the four leakage metrics over folds."""
    return rows.groupBy(*keys).agg(*(F.avg(c).alias(c) for c in ("ecr_flag", "ecr_overlap", "eoc", "tbvr")))


def cold_start_mean(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Unweighted means over folds and strata, and all rows that they tell of."""
    return rows.groupBy(*keys).agg(*(F.avg(c).alias(c) for c in ("auc", "acc", "nll")), F.sum("n").alias("n"))


def reported(rows: DataFrame, construction: str = "train_only") -> DataFrame:
    """Rows that reports show: a data set that is neither null nor blank, one graph construction where rows tell it."""
    rows = rows.where(F.trim("dataset") != "")
    return rows.where(F.trim("graph_construction") == construction) if "graph_construction" in rows.columns else rows


def ablation(train_only: DataFrame, full_log: DataFrame) -> DataFrame:
    """Mean AUC and accuracy by graph, and the mean of the paired differences by fold."""
    a = train_only.select("fold", "model", F.col("auc").alias("a"), F.col("acc").alias("b"))
    both = a.join(full_log.select("fold", "model", F.col("auc").alias("c"), F.col("acc").alias("d")), ["fold", "model"])
    return both.groupBy("model").agg(F.avg("a").alias("auc_train_only"), F.avg("c").alias("auc_full_log"), F.avg("b").alias("acc_train_only"), F.avg("d").alias("acc_full_log"), F.avg(F.col("c") - F.col("a")).alias("delta_auc"), F.avg(F.col("d") - F.col("b")).alias("delta_acc"))


def bootstrap_ci(rows: DataFrame, keys: list[str], value: str, n: int = 1000, seed: int = 42) -> DataFrame:
    """keys, mean, ci_low, ci_high, n: 2.5 and 97.5 % of the means of n resamples of each group, with replacement.

    A group's values are numbered in hash order; in each resample each row draws one number by a hash of seed,
    resample and its own number. So a resample is an aggregation, and a group may have any size. Nulls are left out; no
    value gives nulls and one gives itself.
    """
    x = F.col(value).cast("double")
    held = rows.where(x.isNotNull()).select(*keys, x.alias("x_"))
    own = stage(hash_rank(held, keys, F.md5(F.round(F.col("x_") * 1e9).cast("long").cast("string")), "x_"), "ranked")
    drawn = own.select(*keys, "rank_", "n_", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("resample_"))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "resample_", "rank_")), 1, 8), 16, 10).cast("long") % F.col("n_")
    met = drawn.select(*keys, "resample_", draw.alias("rank_")).join(own.select(*keys, "rank_", "x_"), [*keys, "rank_"])
    means = met.groupBy(*keys, "resample_").agg(F.avg("x_").alias("m_"))
    ends = means.groupBy(*keys).agg(F.percentile("m_", F.lit(0.025)).alias("ci_low"), F.percentile("m_", F.lit(0.975)).alias("ci_high"))
    whole = rows.groupBy(*keys).agg(F.avg(x).alias("mean"), F.count(x).alias("n"))
    return whole.join(ends, keys, "left").select(*keys, "mean", "ci_low", "ci_high", "n")


def bootstrap_ci_drawn(rows: DataFrame, keys: list[str], value: str, n: int = 1000, seed: int = 42) -> DataFrame:
    """bootstrap_ci with NumPy's seeded draws, one task a group; for groups of a row a fold and seed (a handful). Nulls are left out; no value gives
    nulls and one gives itself.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[value].dropna().sort_values().to_numpy()
        low = high = mean = None
        if len(x):
            mean = float(x.mean())
            draws = np.random.default_rng(seed).choice(x, (n, len(x))).mean(1) if len(x) > 1 else x
            low, high = (float(np.quantile(draws, q)) for q in (0.025, 0.975))
        return pdf.iloc[:1][keys].assign(mean=mean, ci_low=low, ci_high=high, n=len(x))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    return rows.groupBy(*keys).applyInPandas(run, f"{kinds}, mean double, ci_low double, ci_high double, n long")
