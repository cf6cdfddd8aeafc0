"""The audit pipeline's tables: written by data set, replaced by a second run."""

from lumenlog.plans import pipeline, reports
from lumenlog.sources import logs


def test_runs_replace_their_data_set(spark, tmp_path):
    log, out = logs.events_single(spark, "/root/testdata/sf0.001"), str(tmp_path / "tables")
    stages = ("e_pre", "leakage", "dag_audit", "ddr_summary", "adjacency")
    for dataset in ("one", "two", "two"):
        pipeline.run(log, dataset, out, stages)
    for name in stages:
        counts = {r["dataset"]: r["count"] for r in spark.read.parquet(f"{out}/{name}").groupBy("dataset").count().collect()}
        assert set(counts) == {"one", "two"} and counts["one"] == counts["two"] > 0
    before = spark.read.parquet(f"{out}/e_pre").count()
    pipeline.run(log.limit(50), "two", out, stages, force=False)  # nothing is left to do
    assert spark.read.parquet(f"{out}/e_pre").count() == before
    lines = reports.run_with_report(log, "two", out, ("split_stats", "leakage"), force=False)
    text = [r.value for r in spark.read.text(f"{out}/reports/two").collect()]
    ordered = [r.line for r in lines.orderBy("section", "block", "place").collect()]
    assert sorted(text) == sorted(ordered) and ordered[:3] == ["# Audit of two", "## split_stats", "| fold | split | n_learners | n_interactions |"] and len(ordered) == 13
    (tmp_path / "a.csv").write_text("who,what,skill,at,ok\nu,i,k,5,1\nv,j,l,6,0\n")
    config = {"raw_path": str(tmp_path), "schema_mapping": {"user_id": "who", "item_id": "what", "kc_id": "skill", "timestamp": "at", "correct": "ok"}}
    assert pipeline.prepare(spark, config, "three", out).count() == 2
    (tmp_path / "a.csv").write_text("who,what,skill,at,ok\nu,i,k,5,1\n")
    assert pipeline.prepare(spark, config, "three", out).count() == 2 and pipeline.prepare(spark, config, "three", out, force=True).count() == 1
