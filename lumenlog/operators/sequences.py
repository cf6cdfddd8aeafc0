"""Dense ids and packed sequences for sequence models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.sources.staging import stage


def dense_ids(train: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """(keys, column, dense): rank from 0 of the distinct values of a fold's train rows.

    Values are dealt to tasks by range and ranked inside them; the ranges before add their counts, a row a task and key.
    """
    ids = train.select(*keys, column).distinct().repartitionByRange(*keys, column)
    ids = stage(ids.withColumn("part_", F.spark_partition_id()), "ids")  # written once, so that a task's range stays the same
    line = Window.partitionBy(*keys).orderBy("part_")
    counts = ids.groupBy(*keys, "part_").agg(F.count("*").alias("n_"))
    before = counts.select(*keys, "part_", (F.sum("n_").over(line) - F.col("n_")).alias("before_"))
    own = F.row_number().over(Window.partitionBy(*keys, "part_").orderBy(column)) - 1
    return ids.withColumn("own_", own).join(before, [*keys, "part_"]).select(*keys, column, (F.col("before_") + F.col("own_")).alias("dense"))


def vocabulary_sizes(items: DataFrame, kcs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_questions, n_concepts): the sizes that a sequence model needs, from the dense ids."""
    sizes = [ids.groupBy(*keys).agg((F.max("dense") + 1).alias(name)) for ids, name in ((items, "n_questions"), (kcs, "n_concepts"))]
    return sizes[0].join(sizes[1], keys, "full").select(*keys, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_questions", "n_concepts")))


def packed(tagged: DataFrame, items: DataFrame, kcs: DataFrame, most: int = 200) -> DataFrame:
    """fold, uid, questions, concepts, responses, selectmasks, timestamps: each learner's last rows, padded to `most`.

    Ids and timestamps are padded with -1, responses and selectmasks with 0.
    Rows with an id that train lacks go; learners with under two rows go. fold is 0 for train, 1 for valid, -1 for test.
    A learner's rows are one array, as the sequences that are asked for.
    """
    rows = tagged.join(items.select("fold", "item_id", F.col("dense").alias("q")), ["fold", "item_id"]).join(kcs.select("fold", "kc_id", F.col("dense").alias("c")), ["fold", "kc_id"])
    last = Window.partitionBy("fold", "user_id").orderBy(F.desc("timestamp"), F.desc("seq"))
    rows = rows.withColumn("back", F.row_number().over(last)).where(F.col("back") <= most)
    seqs = rows.groupBy("fold", "split", "user_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("at"), "q", "c", "correct"))).alias("s")).where(F.size("s") >= 2)
    pad = lambda values, fill: F.array_join(F.concat(values, F.array_repeat(F.lit(fill), F.lit(most) - F.size("s"))), ",")
    text = lambda field: F.transform("s", lambda x: x[field].cast("string"))
    tag = F.when(F.col("split") == "train", 0).when(F.col("split") == "valid", 1).otherwise(-1)
    return seqs.select(
        F.col("fold").alias("split_fold"), tag.alias("fold"), F.col("user_id").alias("uid"), pad(text("q"), "-1").alias("questions"), pad(text("c"), "-1").alias("concepts"),
        pad(F.transform("s", lambda x: F.when(x["correct"] == 1, "1.0").otherwise("0.0")), "0").alias("responses"),
        pad(F.transform("s", lambda x: F.lit("1")), "0").alias("selectmasks"),
        pad(F.transform("s", lambda x, i: i.cast("string")), "-1").alias("timestamps"),
    )
