"""Sinks that a second run of the same data set leaves unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .raw import files_in


def replace_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the keys that new brings, and new; columns that one side lacks are null."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def write_partitions(df: DataFrame, path: str, keys: list[str]) -> None:
    """Replaces just the partitions that df has rows of."""
    df.write.partitionBy(*keys).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.repartition(1).write.mode("overwrite").option("header", True).csv(path)


def audit_rows(edges: DataFrame, dataset: str, edge_type: str) -> DataFrame:
    """Provenance of train-only edges, keyed by data set, fold and edge type; an edge of another source fails the query."""
    own = F.coalesce(F.col("source") == "train_only", F.lit(False)).alias("train_only_flag")
    return guarded(edges.select(F.lit(dataset).alias("dataset"), "fold", F.lit(edge_type).alias("edge_type"), "src_kc", "dst_kc", F.lit("train").alias("source_fold"), own))


def guarded(rows: DataFrame) -> DataFrame:
    """Audit rows whose train_only_flag is true; one that is not, or is null, fails the query."""
    wrong = F.raise_error(F.lit("audit rows must have train_only_flag true")).cast("boolean")
    return rows.withColumn("train_only_flag", F.when(F.col("train_only_flag"), F.lit(True)).otherwise(wrong))


def append_audit_rows(rows: DataFrame, path: str) -> None:
    """Guarded audit rows, replacing those of the same data set and edge type."""
    write_partitions(guarded(rows), path, ["dataset", "edge_type"])


def write_matrix(cells: DataFrame, path: str) -> None:
    """A sparse matrix as its cells (i, j, w), a folder a fold."""
    cells.write.partitionBy("fold").mode("overwrite").parquet(path)


def artefact_index(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """(section, path, length) of the files that a run wrote, by section; files of Spark's own are left out."""
    out = None
    for section, folder in folders.items():
        part = files_in(spark, folder).where(~F.col("path").rlike(r"/[_.][^/]*$")).select(F.lit(section).alias("section"), "path", "length")
        out = part if out is None else out.union(part)
    return out


def write_json(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).repartition(1).write.mode("overwrite").text(path)
