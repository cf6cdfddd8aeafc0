"""The audit of one data set, stage by stage, into tables that a second run replaces."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.operators import dags, graphs, leakage, metrics, perturb, predict, sequences, splits
from lumenlog.plans.audit import FOLD, Audit
from lumenlog.sources import raw, sinks

STAGES = {
    "split_stats": lambda a: splits.split_stats(a.tagged),
    "e_pre": lambda a: a.pre,
    "e_sim": lambda a: a.sim,
    "graph_stats": lambda a: graphs.graph_stats(a.pre, a.sim, graphs.q_matrix(a.train, FOLD), FOLD),
    "leakage": lambda a: leakage.leakage_row(a.tagged, a.pre, a.sim),
    "dag_audit": lambda a: dags.audit(a.pre),
    "pruning_log": lambda a: dags.prune_log(a.pre),
    "ddr": lambda a: a.sweep,
    "ddr_summary": lambda a: perturb.summary(a.sweep).join(metrics.bootstrap_ci(a.sweep, ["augmentation", "p"], "ddr").select("augmentation", "p", "ci_low", "ci_high"), ["augmentation", "p"]),
    "fold_results": lambda a: metrics.metrics(a.predicted, ["fold", "model"]),
    "fold_summary": lambda a: metrics.fold_report(metrics.metrics(a.predicted, ["fold", "model"]), ["model"]),
    "predictions_sample": lambda a: predict.sample(a.predicted),
    "cold_start": lambda a: metrics.strata_metrics(a.predicted, metrics.strata_of(a.train)),
    "sequences": lambda a: sequences.packed(a.tagged, sequences.dense_ids(a.train, "item_id", FOLD), sequences.dense_ids(a.train, "kc_id", FOLD)),
    "adjacency": lambda a: graphs.adjacency(a.pre, sequences.dense_ids(a.train, "kc_id", FOLD), FOLD),
}


def finished(spark: SparkSession, path: str, dataset: str) -> bool:
    """Whether a stage's table holds the data set."""
    try:
        return not spark.read.parquet(path).where(F.col("dataset") == dataset).isEmpty()
    except AnalysisException as gone:
        if gone.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return False


def prepare(spark: SparkSession, config: dict, dataset: str, out: str, limit_rows: int | None = None, force: bool = False) -> DataFrame:
    """The canonical log of a configured data set, read from out where an earlier run wrote it."""
    path = f"{out}/interactions"
    if force or not finished(spark, path, dataset):
        log = raw.load_raw(spark, config, limit_rows)
        sinks.write_partitions(log.withColumn("dataset", F.lit(dataset)), path, ["dataset"])
    log = spark.read.parquet(path).where(F.col("dataset") == dataset).drop("dataset")
    return log.withColumn("seq", F.struct("item_id", "kc_id", "correct"))


def run(log: DataFrame, dataset: str, out: str, stages: Iterable[str] = tuple(STAGES), force: bool = True) -> None:
    """Writes each stage's table under out, partitioned by data set; other data sets' partitions stay.

    Without force, stages whose table holds the data set are skipped.
    """
    due = [name for name in stages if force or not finished(log.sparkSession, f"{out}/{name}", dataset)]
    a = Audit(log).settled() if due else None
    for name in due:
        sinks.write_partitions(STAGES[name](a).withColumn("dataset", F.lit(dataset)), f"{out}/{name}", ["dataset"])
