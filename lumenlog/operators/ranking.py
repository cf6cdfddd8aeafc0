"""Ranks and first rows without one sort of everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.sources.staging import stage


def hash_rank(df: DataFrame, keys: list[str], order: Column, tie: str) -> DataFrame:
    """Adds rank_ (from 0) and n_ within keys by a hexadecimal hash and tie.

    Rows are ranked inside buckets of the hash's first three digits; the buckets before add their counts, a table of
    4096 rows a key.
    """
    df = df.withColumn("hash_", order).withColumn("bucket_", F.substring("hash_", 1, 3))
    counts = df.groupBy(*keys, "bucket_").agg(F.count("*").alias("c_"))
    line = Window.partitionBy(*keys).orderBy("bucket_")
    counts = counts.select(*keys, "bucket_", (F.sum("c_").over(line) - F.col("c_")).alias("before_"), F.sum("c_").over(Window.partitionBy(*keys)).alias("n_"))
    own = F.row_number().over(Window.partitionBy(*keys, "bucket_").orderBy("hash_", tie)) - 1
    return df.withColumn("own_", own).join(counts, [*keys, "bucket_"]).withColumn("rank_", F.col("before_") + F.col("own_")).drop("hash_", "bucket_", "own_", "before_")


BUCKETS = 4096


def _cut(rows: DataFrame, keys: list[str], value: str, left: DataFrame) -> DataFrame:
    """(keys, cut_, need_): of each key the value where its first need_ rows by value end, and how many rows at that value belong to them.

    Values are counted in BUCKETS ranges between the least and the greatest; the range that holds the last row is cut
    again until it is one value. Each round ranks BUCKETS counts a key.
    """
    ends = rows.groupBy(*keys).agg(F.min(value).alias("lo_"), F.max(value).alias("hi_"))
    range_ = stage(ends.join(left, keys), "range")
    span = range_.agg(F.max(F.col("hi_") - F.col("lo_"))).first()[0] or 0
    while True:
        width = F.floor((F.col("hi_") - F.col("lo_")) / BUCKETS) + 1
        inside = rows.join(range_, keys).where(F.col(value).between(F.col("lo_"), F.col("hi_")))
        counts = inside.groupBy(*keys, "lo_", "hi_", "need_", F.floor((F.col(value) - F.col("lo_")) / width).alias("bucket_")).agg(F.count("*").alias("n_"))
        line = Window.partitionBy(*keys).orderBy("bucket_")
        counts = counts.withColumn("to_", F.sum("n_").over(line)).withColumn("last_", F.max("bucket_").over(Window.partitionBy(*keys)))
        ends_here = ((F.col("to_") >= F.col("need_")) & (F.col("to_") - F.col("n_") < F.col("need_"))) | ((F.col("bucket_") == F.col("last_")) & (F.col("to_") < F.col("need_")))
        low = F.col("lo_") + F.col("bucket_") * width
        found = counts.where(ends_here).select(*keys, low.alias("low_"), F.least("hi_", low + width - 1).alias("high_"), (F.col("need_") - F.col("to_") + F.col("n_")).alias("need_"))
        range_ = stage(found.withColumnRenamed("low_", "lo_").withColumnRenamed("high_", "hi_"), "range")
        if span < BUCKETS:
            return range_.select(*keys, F.col("lo_").alias("cut_"), "need_")
        span //= BUCKETS


def first_rows(df: DataFrame, keys: list[str], by: list[tuple[str, bool]], rest: list, most: int) -> DataFrame:
    """The first `most` rows of each key, ordered by whole-number columns (name, whether ascending), then by rest.

    No task ranks a key's rows: counts of ranges of the first column's values say where the last row falls, rows before
    are kept as they are, those at that value go on to the next column, and only what is equal in all of these is
    ranked by rest. Keys of at most `most` rows pass untouched. Nulls in the columns of `by` are not allowed.
    """
    if most < 1:
        return df.where("false")
    names = df.columns
    own = keys or ["all_"]
    rows = stage(df if keys else df.withColumn("all_", F.lit(0)), "to-rank")
    sizes = stage(rows.groupBy(*own).agg(F.count("*").alias("rows_")), "sizes")
    left = sizes.where(F.col("rows_") > most).select(*own, F.lit(most).cast("long").alias("need_"))
    if left.isEmpty():
        return rows.select(*names)
    out = rows.join(sizes.where(F.col("rows_") <= most), own, "left_semi").select(*names)
    rows = rows.join(left, own, "left_semi")
    for name, ascending in by:
        rows = rows.withColumn("value_", F.col(name).cast("long") if ascending else -F.col(name).cast("long"))
        cut = _cut(rows, own, "value_", left)
        met = rows.join(cut, own)
        out = out.union(met.where("value_ < cut_").select(*names))
        rows = met.where("value_ = cut_").select(*[c for c in rows.columns if c != "value_"])
        left = cut.select(*own, "need_")
    line = Window.partitionBy(*own).orderBy(*(rest or [F.lit(0)]))
    last = rows.join(left, own).withColumn("rank_", F.row_number().over(line)).where(F.col("rank_") <= F.col("need_"))
    return out.union(last.select(*names))
