"""Readers of raw logs. All raw columns are read as strings and cast with try_cast, never inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlog.functions import scalars as S

from .staging import stage

Mapping = dict[str, str | Sequence[str]]


def read_csv(spark: SparkSession, path: str | list[str], header: bool = True, sep: str = ",") -> DataFrame:
    """A CSV as strings, empty cells null."""
    return spark.read.option("header", header).option("inferSchema", False).option("sep", sep).csv(path)


def files_in(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, length) of a folder's files whose name fits the pattern; no content is read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder).select("path", "length")


def _found(read, path: str) -> DataFrame:
    """What read() gives; a path that is not there is FileNotFoundError."""
    try:
        return read()
    except AnalysisException as gone:
        if gone.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(path) from gone


def numbered(df: DataFrame, name: str = "row") -> DataFrame:
    """The rows of one file with their number from 0: rows are numbered inside the file's blocks, blocks before add theirs."""
    lines = stage(df.select("*", F.col("_metadata.file_block_start").alias("block_"), F.monotonically_increasing_id().alias("line_")), "lines")
    counts = lines.groupBy("block_").agg(F.count("*").alias("n_"))
    before = counts.select("block_", (F.sum("n_").over(Window.partitionBy(F.lit(0)).orderBy("block_")) - F.col("n_")).alias("before_"))  # a row a block
    own = F.row_number().over(Window.partitionBy("block_").orderBy("line_")) - 1
    return lines.withColumn("own_", own).join(before, "block_").withColumn(name, F.col("before_") + F.col("own_")).drop("block_", "line_", "own_", "before_")


def mapped_columns(mapping: Mapping) -> list[str]:
    out: list[str] = []
    for names in mapping.values():
        for name in [names] if isinstance(names, str) else names:
            if name not in out:
                out.append(name)
    return out


def raw_filters(df: DataFrame, mapping: Mapping, binary_only: bool = False, needs_kc: bool = False) -> DataFrame:
    """binary_only keeps numeric 0 and 1 where one column is mapped; needs_kc keeps rows with some component."""
    if binary_only and isinstance(mapping["correct"], str):
        df = df.where(F.col(mapping["correct"]).try_cast("double").isin(0.0, 1.0))
    if needs_kc:
        names = mapping["kc_id"]
        df = df.where(F.coalesce(*([F.col(names)] if isinstance(names, str) else map(F.col, names))).isNotNull())
    return df


def normalise(df: DataFrame, mapping: Mapping, ids: str = "blake2b") -> DataFrame:
    """Raw columns to the canonical five. ids: blake2b (63 bits of the digest) or md5 (built in, SQL can repeat it).

    A null or blank id, a time that is none, or an outcome that is not binary fails the query.
    """
    missing = [c for c in mapped_columns(mapping) if c not in df.columns]
    if missing or set(mapping) != {"user_id", "item_id", "kc_id", "timestamp", "correct"}:
        raise ValueError(f"mapping and columns disagree: {missing or sorted(mapping)}")
    text = {k: S.first_filled([v] if isinstance(v, str) else list(v)) for k, v in mapping.items()}
    encode = S.stable_id_md5 if ids == "md5" else S.stable_id
    id_of = lambda c: encode(F.regexp_replace(S.needed_id(c), r"\.0$", ""))
    return df.select(*(id_of(text[k]).alias(k) for k in ("user_id", "item_id", "kc_id")), S.parse_timestamp(text["timestamp"]).alias("timestamp"), S.parse_correct(text["correct"]).alias("correct"))


def expand_sequences(df: DataFrame, encode=S.stable_id) -> DataFrame:
    """Comma-packed sequences to interactions; the columns uid, questions, concepts, responses, timestamps[, selectmasks]."""
    if "selectmasks" not in df.columns:
        df = df.withColumn("selectmasks", F.lit(None).cast("string"))
    lists = {c: S.split_list(F.col(c)) for c in ("questions", "concepts", "responses", "timestamps", "selectmasks")}
    df = df.select("uid", *(v.alias(k) for k, v in lists.items()))
    n = F.least(*(F.size(c) for c in ("questions", "concepts", "responses", "timestamps")))
    rows = df.withColumn("n", n).select("uid", "n", "selectmasks", F.posexplode(F.arrays_zip("questions", "concepts", "responses", "timestamps")).alias("pos", "e")).where("pos < n")
    mask = F.get("selectmasks", F.col("pos"))
    e = F.col("e")
    kept = rows.where(F.coalesce(mask == "1", F.lit(True))).where((e["questions"] != "-1") & (e["concepts"] != "-1") & (e["timestamps"] != "-1") & e["responses"].isin("0", "1"))
    return kept.select(encode(F.col("uid")).alias("user_id"), encode(e["questions"]).alias("item_id"), encode(e["concepts"]).alias("kc_id"), S.millis_to_seconds(e["timestamps"]).alias("timestamp"), e["responses"].cast("long").alias("correct"))


def unpivot_responses(df: DataFrame, user: str, items: list[str], item_kcs: DataFrame, encode=S.stable_id) -> DataFrame:
    """A row per learner with a column per item, and a table (pos, kc) of the items, to interactions in item order."""
    long = df.select(F.col(user).alias("user"), F.posexplode(F.array(*map(F.col, items))).alias("pos", "correct"))
    return long.join(item_kcs, "pos").select(encode(F.col("user").cast("string")).alias("user_id"), encode(F.col("pos").cast("string")).alias("item_id"), encode(F.col("kc").cast("string")).alias("kc_id"), F.col("pos").cast("long").alias("timestamp"), F.col("correct").cast("long").alias("correct"))


def interaction_path(spark: SparkSession, config: dict) -> str:
    """The configured file, else the first CSV of the raw folder by name."""
    if config.get("raw_interactions_file"):
        return config["raw_interactions_file"]
    folder = config["raw_path"]
    first = _found(lambda: files_in(spark, folder, "*.csv"), folder).agg(F.min("path")).first()[0]
    if first is None:
        raise FileNotFoundError(f"no CSV files under {folder}")
    return first


def _interactions(spark: SparkSession, config: dict, most: int | None, ids: str) -> DataFrame:
    mapping = config["schema_mapping"]
    path = interaction_path(spark, config)
    df = _found(lambda: read_csv(spark, path), path)
    df = df.select(*(c for c in mapped_columns(mapping) if c in df.columns))
    df = raw_filters(df, mapping, binary_only=config.get("preprocess", {}).get("correct_mode") == "binary_only", needs_kc=True)
    return normalise(df if most is None else df.limit(most), mapping, ids)


def _matrix(spark: SparkSession, config: dict, most: int | None, ids: str) -> DataFrame:
    """A header-less CSV, a row a learner and a column an item, and a TSV whose third column is each item's component."""
    wide, info = config["raw_interactions_file"], config["raw_info_file"]
    rows = numbered(_found(lambda: read_csv(spark, wide, header=False), wide), "learner")
    kcs = numbered(_found(lambda: read_csv(spark, info, header=False, sep="\t"), info), "pos").select(F.col("pos").cast("int").alias("pos"), F.col("_c2").cast("long").alias("kc"))
    rows = rows if most is None else rows.where(F.col("learner") < most)
    return unpivot_responses(rows, "learner", [c for c in rows.columns if c != "learner"], kcs, S.stable_id if ids == "blake2b" else S.stable_id_md5)


def _sequences(spark: SparkSession, config: dict, most: int | None, ids: str) -> DataFrame:
    paths = list(config.get("raw_sequence_files") or [])
    if not paths:
        raise ValueError("raw_sequence_files must be configured for packed sequences")
    df = None
    for path in paths:
        part = expand_sequences(_found(lambda path=path: read_csv(spark, path), path), S.stable_id if ids == "blake2b" else S.stable_id_md5)
        df = part if df is None else df.union(part)
    return df if most is None else df.limit(most)


#: The raw formats of the configuration; any other is a CSV with a row an interaction.
FORMATS = {"xes_sequence": _sequences, "synthetic": _matrix}


def load_raw(spark: SparkSession, config: dict, limit_rows: int | None = None, ids: str = "blake2b") -> DataFrame:
    """The canonical five of a configured raw log; an error where nothing is usable.

    limit_rows keeps the first rows that pass the filters (of a matrix, the first learners), as they are scanned.
    """
    df = FORMATS.get(config.get("raw_format"), _interactions)(spark, config, limit_rows, ids)
    if df.isEmpty():
        raise ValueError("no usable interactions found")
    return df


def load_interactions(spark: SparkSession, path: str) -> DataFrame:
    """Canonical parquet or CSV with the five columns as longs; a row that is not binary fails the query."""
    df = read_csv(spark, path) if path.endswith(".csv") else spark.read.parquet(path)
    names = ("user_id", "item_id", "kc_id", "timestamp", "correct")
    if missing := [c for c in names if c not in df.columns]:
        raise ValueError(f"columns are missing: {missing}")
    df = df.select(*(F.col(c).cast("long").alias(c) for c in names))
    bad: Column = F.raise_error(F.concat(F.lit("correct is not binary: "), F.coalesce(F.col("correct").cast("string"), F.lit("null"))))
    return df.withColumn("correct", F.when(F.col("correct").isin(0, 1), F.col("correct")).otherwise(bad.cast("long")))


def load_expert_dag(df: DataFrame, names: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """Expert edges src_kc, dst_kc, confidence_score from an integer table, or by names with a table (name, kc_id)."""
    if {"Exercise_A", "Exercise_B", "Prerequisite_avg"} <= set(df.columns):
        if names is None:
            raise ValueError("a table by name needs the name table")
        score = F.col("Prerequisite_avg").try_cast("double")
        rows = df.where(score >= threshold).select(F.trim("Exercise_A").alias("a"), F.trim("Exercise_B").alias("b"), score.alias("confidence_score"))
        ends = [names.select(F.col("name").alias(c), F.col("kc_id").alias(k)) for c, k in (("a", "src_kc"), ("b", "dst_kc"))]
        return rows.join(ends[0], "a").join(ends[1], "b").select("src_kc", "dst_kc", "confidence_score")
    if {"src_kc", "dst_kc"} <= set(df.columns):
        score = next((c for c in ("confidence_score", "confidence", "weight", "Prerequisite_avg") if c in df.columns), None)
        value = F.coalesce(F.col(score).try_cast("double"), F.lit(1.0)) if score else F.lit(1.0)
        return df.select(F.col("src_kc").try_cast("long").alias("src_kc"), F.col("dst_kc").try_cast("long").alias("dst_kc"), value.alias("confidence_score")).dropna(subset=["src_kc", "dst_kc"])
    raise ValueError("neither an integer nor a named edge table")


#: Data sets that bring an expert graph of their own.
WITH_EXPERT_GRAPH = ("junyi", "xes3g5m")


def has_expert_graph(dataset: str) -> bool:
    return dataset.lower() in WITH_EXPERT_GRAPH


def load_ground_truth(spark: SparkSession, folder: str, dataset: str) -> DataFrame:
    """The expert graph of a data set, folder/<dataset>/<dataset>_dag.csv."""
    path = f"{folder}/{dataset}/{dataset}_dag.csv"
    return _found(lambda: read_csv(spark, path), path)


def load_q_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(item_id, kc_id) of a Parquet file or folder, or of a CSV."""
    df = _found(lambda: read_csv(spark, path) if path.endswith(".csv") else spark.read.parquet(path), path)
    return df.select(F.col("item_id").cast("long").alias("item_id"), F.col("kc_id").cast("long").alias("kc_id"))


def kc_map(names: DataFrame, column: str, encode=S.stable_id) -> DataFrame:
    """(name, kc_id): the id of each distinct component name, as normalise gives it."""
    text = F.trim(F.col(column).cast("string"))
    return names.select(text.alias("name")).where("name <> ''").distinct().select("name", encode(F.col("name")).alias("kc_id"))


def load_kc_map(spark: SparkSession, path: str) -> DataFrame:
    """(name, kc_id) of a JSON object from names to ids."""
    text = _found(lambda: spark.read.option("wholetext", True).text(path), path)
    return text.select(F.explode(F.from_json("value", "map<string,bigint>")).alias("name", "kc_id"))


EDGES = T.StructType([T.StructField("src_kc", T.LongType()), T.StructField("dst_kc", T.LongType()), T.StructField("support", T.LongType()), T.StructField("weight", T.DoubleType())])


def load_edges(spark: SparkSession, path: str) -> DataFrame:
    """Edges of a CSV; no file gives an empty table."""
    try:
        df = _found(lambda: read_csv(spark, path), path)
    except FileNotFoundError:
        return spark.createDataFrame([], EDGES)
    return df.select(*(F.col(f.name).try_cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in EDGES))
