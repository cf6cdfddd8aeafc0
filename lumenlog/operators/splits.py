"""Learner splits: train, valid and test for every fold at once."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import hash_rank

RATIOS = (0.7, 0.1, 0.2)


def fold_seeds(base: int = 42, n_folds: int = 1, seeds: list[int] | None = None) -> list[int]:
    if seeds:
        return list(seeds)
    if n_folds < 1:
        raise ValueError("at least one fold")
    return [base + i for i in range(n_folds)]


def _checked(ratios) -> None:
    if not math.isclose(sum(ratios), 1.0):
        raise ValueError("ratios must sum to 1")


def assign(users: DataFrame, seeds: list[int], ratios=RATIOS) -> DataFrame:
    """(fold, user_id, split): users in seeded hash order, the first shares to train and valid, the rest to test."""
    _checked(ratios)
    folds = F.explode(F.array(*(F.struct(F.lit(i).alias("fold"), F.lit(s).alias("seed")) for i, s in enumerate(seeds))))
    each = users.select("user_id").distinct().select("user_id", folds.alias("f")).select("user_id", "f.fold", "f.seed")
    ranked = hash_rank(each, ["fold"], F.md5(F.concat_ws(":", F.col("seed").cast("string"), F.col("user_id").cast("string"))), "user_id")
    train, valid = F.floor(F.col("n_") * F.lit(ratios[0])), F.floor(F.col("n_") * F.lit(ratios[1]))
    split = F.when(F.col("rank_") < train, "train").when(F.col("rank_") < train + valid, "valid").otherwise("test")
    return ranked.select("fold", "user_id", split.alias("split"))


def assign_shuffled(users: DataFrame, seeds: list[int], ratios=RATIOS) -> DataFrame:
    """The reference's seeds: NumPy's shuffle of the sorted users, one task a fold; for numbers of users that fit there."""
    _checked(ratios)

    def run(pdf):
        import numpy as np

        ids = np.sort(pdf["user_id"].to_numpy())
        np.random.default_rng(int(pdf["seed"].iloc[0])).shuffle(ids)
        a, b = int(len(ids) * ratios[0]), int(len(ids) * ratios[1])
        return pdf.iloc[: len(ids)][["fold"]].assign(user_id=ids, split=["train"] * a + ["valid"] * b + ["test"] * (len(ids) - a - b))

    folds = F.explode(F.array(*(F.struct(F.lit(i).alias("fold"), F.lit(s).alias("seed")) for i, s in enumerate(seeds))))
    each = users.select("user_id").distinct().select("user_id", folds.alias("f")).select("user_id", "f.fold", "f.seed")
    return each.groupBy("fold").applyInPandas(run, "fold int, user_id long, split string")


def marked(log: DataFrame, assigned: DataFrame, tasks: int | None = None) -> DataFrame:
    """log with each row's folds_, a (fold, split) of each fold its learner is in; tasks share the join where they are told."""
    own = assigned.groupBy("user_id").agg(F.collect_list(F.struct("fold", "split")).alias("folds_"))
    if tasks:
        log, own = log.repartition(tasks, "user_id"), own.repartition(tasks, "user_id")
    return log.join(own, "user_id")


def folded(rows: DataFrame) -> DataFrame:
    """A row a fold of what marked gives."""
    return rows.select("*", F.explode("folds_").alias("f_")).select(*(c for c in rows.columns if c != "folds_"), "f_.fold", "f_.split")


def tag(log: DataFrame, assigned: DataFrame, tasks: int | None = None) -> DataFrame:
    return folded(marked(log, assigned, tasks))


def split_stats(tagged: DataFrame) -> DataFrame:
    return tagged.groupBy("fold", "split").agg(F.count_distinct("user_id").alias("n_learners"), F.count("*").alias("n_interactions"))


def user_overlap(tagged: DataFrame) -> DataFrame:
    """Users of a fold in more than one split; empty when the split is sound."""
    return tagged.groupBy("fold", "user_id").agg(F.count_distinct("split").alias("n_splits")).where("n_splits > 1")


def temporal_violations(tagged: DataFrame) -> DataFrame:
    """Users whose earlier split ends after the later one begins, for train and valid, valid and test."""
    at = lambda f, s, name: f(F.when(F.col("split") == s, F.col("timestamp"))).alias(name)
    t = tagged.groupBy("fold", "user_id").agg(at(F.max, "train", "train_max"), at(F.min, "valid", "valid_min"), at(F.max, "valid", "valid_max"), at(F.min, "test", "test_min"))
    return t.where("train_max > valid_min or valid_max > test_min").select("fold", "user_id")


def train_only(tagged: DataFrame) -> DataFrame:
    """One row: whether a table is evidence of one fold's train rows alone (a null fold is a value)."""
    fold = F.count_distinct(F.coalesce(F.col("fold").cast("string"), F.lit("null")))
    return tagged.agg((fold == 1).alias("one_fold"), F.coalesce(F.bool_and(F.lower("split") == "train"), F.lit(True)).alias("train_rows"))


def in_order(keys: list[str]):
    return Window.partitionBy(*keys, "user_id").orderBy("timestamp", "seq")
