"""Helpers shared by the corpus operators: staged tables and connected components."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the word contract, as a regular expression class body.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def crc32_sql(text: str) -> str:
    """DuckDB SQL of the unsigned CRC-32 of an ASCII text (null: null)."""
    bits = "list_reduce(list_prepend(xor(c, b), repeat([0::BIGINT], 8)), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"CASE WHEN {text} IS NOT NULL THEN xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda a: CAST(ascii(a) AS BIGINT))), lambda c, b: {bits}), 4294967295) END"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="stages-")


def scratch(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one only where that is unset and all tasks run on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _own_folder()
    return f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}"


#: Spark's setting that ends a query's shuffle files with the query.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str, narrow: bool = False, clean: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back, which cuts its lineage and survives lost executors.

    narrow: a table of a few numbers a row, dealt to an eighth of the shuffle partitions before it is written; what
    makes its rows keeps all its tasks. clean: the shuffle files that the table was made from go when it is written.
    """
    spark = df.sparkSession
    if narrow:
        df = df.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, str(clean or before == "true").lower())
    try:
        df.write.option("compression", "zstd").parquet(path)  # texts that are staged stay until the application ends
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete the files of staged tables that nothing yet to be computed reads.

    What was made of them must have been written. A table without files is left alone.
    """
    for table in tables:
        spark = table.sparkSession
        jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            if f"{spark.sparkContext.applicationId}/" not in folder:
                raise ValueError(f"{folder} is not a staged table's folder")
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
            path.getFileSystem(conf).delete(path, True)


def sealed(df: DataFrame) -> DataFrame:
    """df behind a one-row generator, so that filters on its columns are not rewritten into their long expressions."""
    return df.select(F.explode(F.array(F.struct(*(F.col(f"`{c}`") for c in df.columns)))).alias("row_")).select("row_.*")


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Connected components of an undirected edge table, as (node, component), component the smallest node.

    Alternating large-star and small-star rounds; each round is two hash aggregations and two joins over a
    table no longer than the edge table, staged in the shared folder in place of the last round's. Rows with a null
    end or equal ends are ignored. The smallest node of a component is not listed (its component is itself); an empty edge table
    gives an empty result.
    """
    u, v = F.col(src).cast("long"), F.col(dst).cast("long")
    now = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where(u.isNotNull() & v.isNotNull()).where("u <> v").distinct()
    now = stage(now, "edges", narrow=True)
    mark = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", "m")).distinct()
        last, now = now, stage(small, "star", narrow=True, clean=True)
        forget(last)
        said = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if said == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = said
