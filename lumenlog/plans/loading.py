"""Registered queries that write raw logs, edges and tables to the shared folder and load them as a user would."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.functions import scalars as S
from lumenlog.operators import bkt, graphs, sequences, splits
from lumenlog.plans import audit
from lumenlog.plans.audit import FOLD, rounded, single
from lumenlog.plans.oracle import LOGS, ORACLE_SQL as SQL, PARTS, r6, sql, _FOLDS, _id
from lumenlog.sources import logs, raw, sinks
from lumenlog.sources.staging import place


def _csv(df: DataFrame, name: str, header: bool = True, sep: str = ",") -> str:
    """df as a folder of CSV files, written by all tasks."""
    path = f"{place(df.sparkSession, name)}.csv"
    df.write.option("header", header).option("sep", sep).csv(path)
    return path


def raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _csv(audit.raw_rows(spark, sf_dir), "raw")
    return raw.load_raw(spark, {"raw_interactions_file": path, "schema_mapping": audit.MAPPING, "preprocess": {"correct_mode": "binary_only"}}, ids="md5")


def raw_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed sequences in two files, learners with odd and with even ids."""
    packed = audit.packed_sequences(spark, sf_dir)
    files = [_csv(packed.where(F.col("uid").cast("long") % 2 == odd), "sequences") for odd in (0, 1)]
    return raw.load_raw(spark, {"raw_format": "xes_sequence", "raw_sequence_files": files}, ids="md5")


def raw_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matrix without header, nations as learners: one small file, since its lines are numbered."""
    nations = logs.table(spark, sf_dir, "nation").coalesce(1).sortWithinPartitions("n_nationkey")
    wide = _csv(nations.select(F.col("n_nationkey") % 2, F.col("n_regionkey") % 2), "matrix", header=False)
    info = _csv(spark.createDataFrame([("a", "x", 7), ("b", "y", 9)], "a string, b string, c int").coalesce(1).sortWithinPartitions("c"), "items", header=False, sep="\t")
    return raw.load_raw(spark, {"raw_format": "synthetic", "raw_interactions_file": wide, "raw_info_file": info}, ids="md5")


def canonical_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw.load_interactions(spark, _csv(logs.events_single(spark, sf_dir).select(*logs.CANONICAL), "canonical"))


def log_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two data sets written together, then one of them again with fewer rows."""
    path = place(spark, "interactions")
    log = logs.events_single(spark, sf_dir).select(*logs.CANONICAL).withColumn("dataset", F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd"))
    sinks.write_partitions(log, path, ["dataset"])
    sinks.write_partitions(log.where("dataset = 'odd' and correct = 1"), path, ["dataset"])
    return spark.read.parquet(path)


def audit_rows_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows of both edge types, those of one appended twice."""
    path, a = place(spark, "audit"), audit.multi(spark, sf_dir)
    for edges, kind in ((a.pre, "E_pre"), (a.sim, "E_sim"), (a.pre, "E_pre")):
        sinks.append_audit_rows(sinks.audit_rows(edges, "events_multi", kind), path)
    return spark.read.parquet(path)


def edges_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges through a CSV, and none from a path where nothing was written."""
    path = place(spark, "edges")
    sinks.write_csv(single(spark, sf_dir).pre, path)
    return rounded(raw.load_edges(spark, path).union(raw.load_edges(spark, place(spark, "nothing"))), "weight")


def json_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, stats = place(spark, "stats"), splits.split_stats(single(spark, sf_dir).tagged)
    sinks.write_json(stats, path)
    return spark.read.schema(stats.schema).json(path)


def matrix_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, a = place(spark, "matrix"), single(spark, sf_dir)
    sinks.write_matrix(graphs.adjacency(a.pre, sequences.dense_ids(a.train, "kc_id", FOLD), FOLD), path)
    return rounded(spark.read.parquet(path), "w")


def expert_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expert edges between nations by name, with scores that are no numbers and names without an id."""
    nation = logs.table(spark, sf_dir, "nation")
    end = lambda key, name: nation.select(F.col("n_nationkey").alias(key), F.concat(F.lit(" "), F.col("n_name")).alias(name))
    key = F.col("c_custkey")
    rows = logs.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("a"), ((F.col("c_nationkey") + key) % 25).alias("b"), F.when(key % 7 == 0, "x").otherwise(F.concat(F.lit("0."), (key % 10).cast("string"))).alias("Prerequisite_avg"))
    named = rows.join(end("a", "Exercise_A"), "a").join(end("b", "Exercise_B"), "b")
    names = nation.where("n_nationkey % 5 <> 0").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("kc_id"))
    return raw.load_expert_dag(named, names)


def expert_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expert edges by id as text: ids that are none are dropped, weights that are none are 1."""
    key = F.col("c_custkey")
    weight = F.when(key % 4 == 0, F.lit(None)).when(key % 4 == 1, F.lit("n/a")).otherwise(F.concat(F.lit("0."), (key % 10).cast("string")))
    return raw.load_expert_dag(logs.table(spark, sf_dir, "customer").select(F.when(key % 6 == 0, "x").otherwise(key.cast("string")).alias("src_kc"), F.col("c_nationkey").cast("string").alias("dst_kc"), weight.alias("weight")))


def clipped_sigmoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.table(spark, sf_dir, "customer").select("c_custkey", F.round(S.sigmoid(F.col("c_acctbal").cast("double") / 100), 9).alias("p"))


QUERIES = {
    "raw_log": raw_log,
    "raw_sequences": raw_sequences,
    "raw_matrix": raw_matrix,
    "canonical_load": canonical_load,
    "log_written": log_written,
    "audit_rows_written": audit_rows_written,
    "edges_loaded": edges_loaded,
    "json_written": json_written,
    "matrix_written": matrix_written,
    "expert_by_name": expert_by_name,
    "expert_by_id": expert_by_id,
    "clipped_sigmoid": clipped_sigmoid,
    "split_by_seed": lambda s, d: splits.assign(single(s, d).log, splits.fold_seeds(7, 2)),
    "bkt_strings": lambda s, d: bkt.outcomes(single(s, d).train, FOLD),
}

_FIVE = "user_id, item_id, kc_id, timestamp, correct"
_AUDIT = "SELECT 'events_multi' AS dataset, fold, '{0}' AS edge_type, src_kc, dst_kc, 'train' AS source_fold, true AS train_only_flag FROM {1}"
ORACLE_SQL = {
    "raw_log": SQL["normalise_raw"],
    "raw_sequences": SQL["seq_expand"],
    "raw_matrix": f"SELECT {_id('CAST(n_nationkey AS VARCHAR)')} AS user_id, {_id('CAST(pos AS VARCHAR)')} AS item_id, {_id('CAST(7 + 2 * pos AS VARCHAR)')} AS kc_id, CAST(pos AS BIGINT) AS timestamp, CAST(CASE pos WHEN 0 THEN n_nationkey ELSE n_regionkey END % 2 AS BIGINT) AS correct FROM nation, (SELECT unnest([0, 1]) AS pos)",
    "canonical_load": f"SELECT {_FIVE} FROM ({LOGS['single']})",
    "log_written": f"SELECT {_FIVE}, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS dataset FROM ({LOGS['single']}) WHERE user_id % 2 = 0 OR correct = 1",
    "audit_rows_written": sql("multi", "pre sim", f"{_AUDIT.format('E_pre', 'pre')} UNION ALL {_AUDIT.format('E_sim', 'sim')}"),
    "edges_loaded": sql("single", "pre", r6("SELECT * FROM pre", "src_kc dst_kc support weight", "weight")),
    "json_written": sql("single", "tagged", "SELECT fold, split, count(DISTINCT user_id) AS n_learners, count(*) AS n_interactions FROM tagged GROUP BY ALL"),
    "matrix_written": SQL["adjacency_norm"],
    "expert_by_name": "SELECT CAST(a.n_nationkey AS BIGINT) AS src_kc, CAST(b.n_nationkey AS BIGINT) AS dst_kc, CAST('0.' || (c_custkey % 10) AS DOUBLE) AS confidence_score FROM customer JOIN nation a ON a.n_nationkey = c_nationkey JOIN nation b ON b.n_nationkey = (c_nationkey + c_custkey) % 25 WHERE c_custkey % 7 <> 0 AND c_custkey % 10 >= 5 AND a.n_nationkey % 5 <> 0 AND b.n_nationkey % 5 <> 0",
    "expert_by_id": "SELECT CAST(c_custkey AS BIGINT) AS src_kc, CAST(c_nationkey AS BIGINT) AS dst_kc, CASE WHEN c_custkey % 4 < 2 THEN 1.0::DOUBLE ELSE CAST('0.' || (c_custkey % 10) AS DOUBLE) END AS confidence_score FROM customer WHERE c_custkey % 6 <> 0",
    "clipped_sigmoid": "SELECT c_custkey, round(greatest(least(1 / (1 + exp(-greatest(least(CAST(c_acctbal AS DOUBLE) / 100, 50.0::DOUBLE), -50.0::DOUBLE))), 1 - 1e-9::DOUBLE), 1e-9::DOUBLE), 9) AS p FROM customer",
    "split_by_seed": f"WITH log AS ({LOGS['single']}) {PARTS['assign'][1].replace(_FOLDS, '(0, 7), (1, 8)')}".replace("SELECT fold, user_id, CASE", "SELECT CAST(fold AS INT) AS fold, user_id, CASE", 1),
    "bkt_strings": sql("single", "tr", "SELECT fold, kc_id, outcomes, count(*) AS n FROM (SELECT fold, kc_id, user_id, string_agg(CAST(correct AS VARCHAR), '' ORDER BY timestamp, seq) AS outcomes FROM tr GROUP BY ALL HAVING count(*) >= 4) GROUP BY ALL"),
}
