"""Interaction logs: user_id, item_id, kc_id, timestamp, correct, and an order column that breaks ties of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CANONICAL = ("user_id", "item_id", "kc_id", "timestamp", "correct")
EVENT_TYPES = ("click", "purchase", "refund", "search", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str):
    return F.unix_micros(F.col(ts).cast("timestamp"))


ROWS = 1 << 19  # of a log, that one task sorts


def tasks(rows: DataFrame) -> int:
    """How many tasks share a table: those of a shuffle, more where one would get over ROWS rows. rows are counted, so they should be a file's."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // ROWS)


def events_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with one component each: the component is a class of the item id."""
    item = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select("user_id", item.alias("item_id"), (item % 20).alias("kc_id"), micros("ts").alias("timestamp"), (F.col("value") < 20).cast("long").alias("correct"), F.col("event_id").alias("seq"))


def events_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items tagged with many components: the component is the dense rank of the event type."""
    item = F.get_json_object("props", "$.k").cast("long")
    events = table(spark, sf_dir, "events")
    kinds = events.select("event_type").distinct()
    ids = kinds.join(kinds.select(F.col("event_type").alias("lower_")), F.col("lower_") < F.col("event_type"), "left").groupBy("event_type").agg(F.count("lower_").alias("kc_id"))
    return events.join(F.broadcast(ids), "event_type").select("user_id", item.alias("item_id"), "kc_id", micros("ts").alias("timestamp"), (F.col("value") < 20).cast("long").alias("correct"), F.col("event_id").alias("seq"))


def orders_log(spark: SparkSession, sf_dir: str, component: str = "l_suppkey") -> DataFrame:
    """Order lines as interactions of customers with parts; seq holds the rest of the order of equal dates."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    n = tasks(lines)
    both = lines.repartition(n, "l_orderkey").join(orders.select("o_orderkey", "o_custkey").repartition(n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    seq = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.floor(F.col("l_extendedprice") * 100).alias("cents"), F.floor("l_quantity").alias("quantity"), "l_returnflag")
    return both.select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), F.col(component).alias("kc_id"), micros("l_shipdate").alias("timestamp"), (F.col("l_returnflag") != "R").cast("long").alias("correct"), seq.alias("seq"))
