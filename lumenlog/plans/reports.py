"""Reports of a run as lines of text, made by expressions where the tables lie and written as text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlog.operators import dags, graphs, metrics, sequences, splits
from lumenlog.plans import audit, pipeline
from lumenlog.plans.audit import FOLD, parts, single
from lumenlog.plans.oracle import LOGS, ORACLE_SQL as SQL, cold_mean, sql
from lumenlog.sources import logs, raw, sinks
from lumenlog.sources.staging import place


def shown(df: DataFrame, name: str) -> Column:
    """A cell's text: three decimals, whole numbers with commas, -- for nothing."""
    kind, cell = df.schema[name].dataType, F.col(name)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        text = F.format_number(cell, 3)
    elif isinstance(kind, (T.LongType, T.IntegerType, T.ShortType)):
        text = F.format_number(cell, 0)
    else:
        text = cell.cast("string")
    return F.coalesce(text, F.lit("--"))


def table_lines(df: DataFrame, order: list[str]) -> DataFrame:
    """(block, place, line): a Markdown table, block 0 its head, block 1 its rows, whose place is the row's order."""
    bar = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    key = F.to_json(F.struct(*(F.lpad(F.col(c).cast("string"), 12, "0").alias(c) if isinstance(df.schema[c].dataType, (T.LongType, T.IntegerType)) else F.col(c).cast("string").alias(c) for c in order)))
    head = df.sparkSession.createDataFrame([(0, "0", "| " + " | ".join(df.columns) + " |"), (0, "1", "|" + "---|" * len(df.columns))], "block int, place string, line string")
    return head.union(df.select(F.lit(1).alias("block"), key.alias("place"), bar([shown(df, c) for c in df.columns]).alias("line")))


def cold_start_lines(means: DataFrame, dataset: str) -> DataFrame:
    """(block, place, line) of the cold-start report: a line a model."""
    number = lambda c: F.format_number(c, 3)
    line = F.concat(F.lit(f"- {dataset} / "), "model", F.lit(": mean AUC="), number("auc"), F.lit(", ACC="), number("acc"), F.lit(", NLL="), number("nll"), F.lit(", n="), F.format_number("n", 0))
    return means.select(F.lit(1).alias("block"), F.col("model").alias("place"), line.alias("line"))


def dag_lines(rows: DataFrame) -> DataFrame:
    """(block, place, line) of the audit of graphs: a section a fold."""
    told = F.array(*(F.concat(F.lit(f"- {name}: "), F.col(c).cast("string")) for name, c in (("nodes", "n_nodes"), ("edges_raw", "n_edges_raw"), ("edges_final", "n_edges"), ("edges_pruned", "n_edges_pruned"), ("cycles_before", "n_cycles_before"), ("cycles_after", "n_cycles_after"), ("topo_sort_passed", "topo_sort_passed"))))
    lines = F.concat(F.array(F.concat(F.lit("## Fold "), F.col("fold").cast("string"))), told, F.array(F.lit("")))
    each = rows.select("fold", F.posexplode(lines).alias("at", "line"))
    return each.select(F.lit(1).alias("block"), F.format_string("%08d-%02d", F.col("fold"), F.col("at")).alias("place"), "line")


def report(title: str, sections: list[tuple[str, DataFrame]]) -> DataFrame:
    """(section, block, place, line) of all sections under a title; ordered by the first three columns it reads from top to bottom."""
    spark = sections[0][1].sparkSession
    heads = [(0, 0, "", f"# {title}"), *((k, -1, "", f"## {name}") for k, (name, _) in enumerate(sections, 1))]
    out = spark.createDataFrame(heads, "section int, block int, place string, line string")
    for k, (_, lines) in enumerate(sections, 1):
        out = out.union(lines.select(F.lit(k).alias("section"), "block", "place", "line"))
    return out


def write_report(lines: DataFrame, path: str) -> None:
    """A report as text files that read on from one to the next, ordered by tasks of ranges."""
    lines.orderBy("section", "block", "place").select("line").write.mode("overwrite").text(path)


def run_report(spark: SparkSession, out: str, dataset: str, names: tuple[str, ...] = ("split_stats", "graph_stats", "fold_summary", "cold_start")) -> DataFrame:
    """The report of a data set's tables that a run wrote under out, those that are there."""
    order = {"split_stats": ["fold", "split"], "graph_stats": ["fold"], "fold_summary": ["model"], "cold_start": ["model", "stratum", "fold"]}
    sections = []
    for name in names:
        if pipeline.finished(spark, f"{out}/{name}", dataset):
            table = spark.read.parquet(f"{out}/{name}").where(F.col("dataset") == dataset).drop("dataset")
            sections.append((name, table_lines(table, order[name])))
    if not sections:
        raise ValueError(f"no tables of {dataset} under {out}")
    return report(f"Audit of {dataset}", sections)


def run_with_report(log: DataFrame, dataset: str, out: str, stages=tuple(pipeline.STAGES), force: bool = True) -> DataFrame:
    """Runs stages of the audit and writes the report of what is then there to out/reports/<data set>."""
    pipeline.run(log, dataset, out, stages, force)
    lines = run_report(log.sparkSession, out, dataset)
    write_report(lines, f"{out}/reports/{dataset}")
    return lines


def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's tables, written, read again and reported."""
    return run_with_report(logs.events_single(spark, sf_dir), "events_single", place(spark, "run"), ("split_stats", "graph_stats"))


def run_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """split_stats of two data sets that one folder holds, the first one run twice."""
    out, log = place(spark, "run"), logs.events_single(spark, sf_dir)
    for dataset, rows in (("all", log), ("even", log.where("user_id % 2 = 0")), ("all", log)):
        pipeline.run(rows, dataset, out, ("split_stats",), force=dataset == "even")
    return spark.read.parquet(f"{out}/split_stats")


def cold_start_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = parts(spark, sf_dir).settled(ordered=False)
    means = metrics.cold_start_mean(audit._cold(a), ["model"])
    return report("Cold-Start KC Diagnostic", [("parts", cold_start_lines(audit.rounded(means, "auc", "acc", "nll"), "parts"))])


def q_matrix_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place(spark, "q-matrix")
    graphs.q_matrix(audit.multi(spark, sf_dir).log, []).write.parquet(path)
    return raw.load_q_matrix(spark, path)


def ground_truth_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expert graph of a data set by its name."""
    folder = place(spark, "truth")
    audit.expert_dag(single(spark, sf_dir).log).write.option("header", True).csv(f"{folder}/junyi/junyi_dag.csv")
    return raw.load_expert_dag(raw.load_ground_truth(spark, folder, "junyi"))


def kc_map_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of nations to ids, through a JSON object."""
    path = place(spark, "kc-map")
    ids = raw.kc_map(logs.table(spark, sf_dir, "nation"), "n_name", audit.S.stable_id_md5)
    ids.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("name", "kc_id")))).alias("value")).write.text(path)
    return raw.load_kc_map(spark, path)


def first_learners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten learners of a matrix without header."""
    nations = logs.table(spark, sf_dir, "nation").coalesce(1).sortWithinPartitions("n_nationkey")
    wide, info = place(spark, "matrix"), place(spark, "items")
    nations.select(F.col("n_nationkey") % 2, F.col("n_regionkey") % 2).write.csv(wide)
    spark.createDataFrame([("a", "x", 7), ("b", "y", 9)], "a string, b string, c int").coalesce(1).sortWithinPartitions("c").write.option("sep", "\t").csv(info)
    return raw.load_raw(spark, {"raw_format": "synthetic", "raw_interactions_file": wide, "raw_info_file": info}, 10, "md5")


def raw_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw log of nations found by its folder, as the first CSV by name."""
    folder = place(spark, "raw-folder")
    rows = logs.table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("who"), F.col("n_name").alias("what"), F.col("n_regionkey").alias("skill_id"), F.col("n_nationkey").alias("at"), (F.col("n_nationkey") % 2).alias("ok"))
    rows.coalesce(1).write.option("header", True).csv(folder)
    return raw.load_raw(spark, {"raw_path": folder, "schema_mapping": audit.MAPPING | {"kc_id": "skill_id"}}, ids="md5")


def artefacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data sets and sections of what two sinks wrote, from the index of files."""
    folders = {name: place(spark, name) for name in ("stats", "log")}
    log = single(spark, sf_dir)
    sinks.write_partitions(splits.split_stats(log.tagged), folders["stats"], ["fold"])
    sinks.write_partitions(log.log.withColumn("parity", F.col("user_id") % 2), folders["log"], ["parity"])
    return sinks.artefact_index(spark, folders).select("section", F.regexp_extract("path", "(fold|parity)=([0-9]+)", 0).alias("part")).distinct()


def shuffled_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many learners the published shuffle gives each split, and how many of them are in none or in two."""
    a = single(spark, sf_dir)
    own = splits.assign_shuffled(a.log, list(audit.SEEDS))
    both = a.log.select("user_id").distinct().join(own.groupBy("user_id").agg(F.count("*").alias("folds"), F.count_distinct("fold").alias("kinds")), "user_id", "left")
    wrong = both.agg(F.count_if(~F.coalesce((F.col("folds") == len(audit.SEEDS)) & (F.col("kinds") == len(audit.SEEDS)), F.lit(False))).alias("misplaced"))
    return own.groupBy("fold", "split").agg(F.count("*").alias("n_learners")).crossJoin(F.broadcast(wrong))  # one row


QUERIES = {f.__name__: f for f in (audit_report, run_tables, cold_start_report, q_matrix_loaded, ground_truth_loaded, kc_map_loaded, first_learners, raw_folder, artefacts, shuffled_split)}

_ID = SQL["stable_id_md5"].partition("c_name, ")[2].partition(" AS id")[0]
_id = lambda text: _ID.replace("c_name", text)
_STATS = SQL["split_stats"].replace(LOGS["orders"], LOGS["single"])
_N = lambda c, d: f"format('{{:,.{d}f}}', CAST({c} AS DOUBLE))"
_COUNT = lambda c: f"format('{{:,}}', CAST({c} AS BIGINT))"
_HEADS = "SELECT 0 AS section, 0 AS block, '' AS place, '# {0}' AS line"
_GRAPH = SQL["graph_stats"].replace(LOGS["multi"], LOGS["single"])
ORACLE_SQL = {
    "run_tables": f"SELECT *, 'all' AS dataset FROM ({_STATS}) UNION ALL SELECT *, 'even' AS dataset FROM ({SQL['split_stats'].replace(LOGS['orders'], f'SELECT * FROM ({LOGS["single"]}) WHERE user_id % 2 = 0')})",
    "audit_report": f"""{_HEADS.format('Audit of events_single')} UNION ALL SELECT * FROM (VALUES (1, -1, '', '## split_stats'), (2, -1, '', '## graph_stats'),
  (1, 0, '0', '| fold | split | n_learners | n_interactions |'), (1, 0, '1', '|---|---|---|---|'), (2, 0, '0', '| fold | n_prerequisite_edges | n_similarity_edges | n_kcs |'), (2, 0, '1', '|---|---|---|---|')) UNION ALL
SELECT 1, 1, concat('{{"fold":"', lpad(CAST(fold AS VARCHAR), 12, '0'), '","split":"', split, '"}}'), concat('| ', fold, ' | ', split, ' | ', {_COUNT('n_learners')}, ' | ', {_COUNT('n_interactions')}, ' |') FROM ({_STATS}) UNION ALL
SELECT 2, 1, concat('{{"fold":"', lpad(CAST(fold AS VARCHAR), 12, '0'), '"}}'), concat('| ', fold, ' | ', {_COUNT('n_prerequisite_edges')}, ' | ', {_COUNT('n_similarity_edges')}, ' | ', {_COUNT('n_kcs')}, ' |') FROM ({_GRAPH})""",
    "cold_start_report": f"""{_HEADS.format('Cold-Start KC Diagnostic')} UNION ALL SELECT 1, -1, '', '## parts' UNION ALL
SELECT 1, 1, model, concat('- parts / ', model, ': mean AUC=', {_N('auc', 3)}, ', ACC=', {_N('acc', 3)}, ', NLL=', {_N('nll', 3)}, ', n=', {_COUNT('n')}) FROM ({cold_mean()})""",
    "q_matrix_loaded": sql("multi", "log", "SELECT DISTINCT item_id, kc_id FROM log"),
    "ground_truth_loaded": sql("single", "expert", "SELECT src_kc, dst_kc, 1::DOUBLE AS confidence_score FROM expert"),
    "kc_map_loaded": f"SELECT n_name AS name, {_id('n_name')} AS kc_id FROM nation",
    "first_learners": f"SELECT {_id('CAST(n_nationkey AS VARCHAR)')} AS user_id, {_id('CAST(pos AS VARCHAR)')} AS item_id, {_id('CAST(7 + 2 * pos AS VARCHAR)')} AS kc_id, CAST(pos AS BIGINT) AS timestamp, CAST(CASE pos WHEN 0 THEN n_nationkey ELSE n_regionkey END % 2 AS BIGINT) AS correct FROM nation, (SELECT unnest([0, 1]) AS pos) WHERE n_nationkey < 10",
    "raw_folder": f"SELECT {_id('CAST(n_regionkey AS VARCHAR)')} AS user_id, {_id('n_name')} AS item_id, {_id('CAST(n_regionkey AS VARCHAR)')} AS kc_id, CAST(n_nationkey AS BIGINT) AS timestamp, CAST(n_nationkey % 2 AS BIGINT) AS correct FROM nation",
    "artefacts": f"SELECT 'log' AS section, concat('parity=', p) AS part FROM (SELECT DISTINCT user_id % 2 AS p FROM ({LOGS['single']})) UNION ALL SELECT 'stats', concat('fold=', f) FROM (SELECT unnest([0, 1, 2]) AS f)",
    "shuffled_split": f"SELECT fold, split, CAST(CASE split WHEN 'train' THEN floor(n * 0.7::DOUBLE) WHEN 'valid' THEN floor(n * 0.1::DOUBLE) ELSE n - floor(n * 0.7::DOUBLE) - floor(n * 0.1::DOUBLE) END AS BIGINT) AS n_learners, 0 AS misplaced FROM (SELECT count(DISTINCT user_id) AS n FROM ({LOGS['single']})), (SELECT unnest([0, 1, 2]) AS fold), (SELECT unnest(['train', 'valid', 'test']) AS split)",
}
