"""Logistic heads over the channels, fitted to their optimum for all folds and models at once."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.functions import scalars as S
from lumenlog.sources.staging import stage

from .predict import CHANNELS, WEIGHTS

INPUTS = (*CHANNELS, "one_")


def _used(model: str) -> np.ndarray:
    """Which inputs a model has: its channels and the constant."""
    return np.array([c == "one_" or c in WEIGHTS[model] for c in INPUTS])


def _met(rows: DataFrame, weights: dict[tuple[int, str], np.ndarray]) -> tuple[DataFrame, Column]:
    """Rows by model with the weights w_ of their fold, and the chance of a right answer; inputs that rows lack are 0."""
    table = rows.sparkSession.createDataFrame([(fold, model, w.tolist()) for (fold, model), w in weights.items()], "fold int, model string, w_ array<double>")
    rows = rows.withColumn("one_", F.lit(1.0))
    rows = rows.withColumns({c: F.lit(0.0) for c in INPUTS if c not in rows.columns})
    z = sum((F.get("w_", F.lit(i)) * F.col(c) for i, c in enumerate(INPUTS)), F.lit(0.0))
    return rows.join(F.broadcast(table), "fold"), 1 / (1 + F.exp(-z))  # a row a fold and model


def fit_heads(train: DataFrame, models: tuple[str, ...], l2: float = 1e-4, rounds: int = 30, slope: float = 1e-9) -> dict[tuple[int, str], np.ndarray]:
    """Weights by fold and model that minimise the mean log loss plus l2 / 2 times the squared weights but the constant's.

    A round is one pass over train, which is staged: for all folds and models it sums slopes and curvatures, a row a fold
    and model, and the driver takes a Newton step, half of it again and again where the loss would rise.
    """
    train = stage(train.select("fold", "correct", *(c for c in CHANNELS if c in train.columns)), "channels")
    folds = [r.fold for r in train.select("fold").distinct().collect()]
    weights = {(fold, model): np.zeros(len(INPUTS)) for fold in folds for model in models}
    best: dict[tuple[int, str], tuple[float, np.ndarray, np.ndarray]] = {}
    ridge = l2 * np.array([c != "one_" for c in INPUTS])
    upper = np.triu_indices(len(INPUTS))
    for _ in range(rounds):
        rows, p = _met(train, weights)
        y, own = F.col("correct").cast("double"), [F.col(c).cast("double") for c in INPUTS]
        q = F.greatest(F.least(p, F.lit(1 - 1e-15)), F.lit(1e-15))
        rows = rows.withColumn("p_", p).withColumn("loss_", -(y * F.log(q) + (1 - y) * F.log(1 - q)))
        error, bend = F.col("p_") - y, F.col("p_") * (1 - F.col("p_"))
        sums = [F.sum(error * x).alias(f"g{i}") for i, x in enumerate(own)] + [F.sum(bend * own[i] * own[j]).alias(f"h{k}") for k, (i, j) in enumerate(zip(*upper))]
        steepest, after = 0.0, {}
        for r in rows.groupBy("fold", "model").agg(F.count("*").alias("n"), F.sum("loss_").alias("loss"), *sums).collect():
            key, use = (r.fold, r.model), np.flatnonzero(_used(r.model))
            w = weights[key]
            loss = r.loss / r.n + (ridge * w * w).sum() / 2
            if key in best and loss > best[key][0] + 1e-12:  # too far: half way back
                after[key] = best[key][1] + (w - best[key][1]) / 2
                steepest = max(steepest, 1.0)
                continue
            g = np.array([r[f"g{i}"] for i in range(len(INPUTS))]) / r.n + ridge * w
            h = np.zeros((len(INPUTS), len(INPUTS)))
            h[upper] = [r[f"h{k}"] for k in range(len(upper[0]))]
            h = (h + np.triu(h, 1).T) / r.n + np.diag(ridge)
            best[key] = (loss, w, g)
            step = np.zeros(len(INPUTS))
            step[use] = np.linalg.lstsq(h[np.ix_(use, use)], g[use], rcond=None)[0]
            after[key] = w - step
            steepest = max(steepest, np.abs(g[use]).max())
        weights = after
        if steepest < slope:
            break
    return {key: w for key, (_, w, _) in best.items()}


def heads_scored(rows: DataFrame, weights: dict[tuple[int, str], np.ndarray]) -> DataFrame:
    """fold, user_id, item_id, kc_id, seq, y_true, model, y_prob of rows by all models."""
    met, p = _met(rows, weights)
    return met.select("fold", "user_id", "item_id", "kc_id", "seq", F.col("correct").alias("y_true"), "model", F.round(S.clip(p, 1e-9), 9).alias("y_prob"))


def fitted_head(train: DataFrame, rows: DataFrame, models: str | tuple[str, ...], l2: float = 1e-4, rounds: int = 30) -> DataFrame:
    """What heads_scored gives for rows with heads fitted on train."""
    return heads_scored(rows, fit_heads(train, (models,) if isinstance(models, str) else models, l2, rounds))
