"""Findings of round 4: what failed before."""

import datetime

import duckdb

from lumenlog.operators import metrics, predict
from lumenlog.plans import audit, reports
from lumenlog.plans.registry import ORACLE_SQL

SF = "/root/testdata/sf0.001"


def strata_of_all_models(spark):
    """Metrics by stratum of every model's predictions, by the plain operators, as a frame."""
    a = audit.parts(spark, SF)
    return metrics.strata_metrics(a.predictions(), metrics.strata_of(a.train)).toPandas()


def test_cold_start_report_tells_every_model(spark):
    """A line a model, those of graphs included, with the means of its strata."""
    means = strata_of_all_models(spark).groupby("model").agg({"auc": "mean", "acc": "mean", "nll": "mean", "n": "sum"})
    lines = {r.place: r.line for r in reports.cold_start_report(spark, SF).where("block = 1").collect()}
    assert set(lines) == set(predict.WEIGHTS)
    assert lines == {m: f"- parts / {m}: mean AUC={r.auc:.3f}, ACC={r.acc:.3f}, NLL={r.nll:.3f}, n={int(r.n):,}" for m, r in means.iterrows()}


def test_strata_metrics_has_every_model(spark):
    """A row a fold, model and stratum, those of graphs included."""
    expected = strata_of_all_models(spark)
    rows = lambda found: sorted((r.fold, r.model, r.stratum, r.n, *(None if x is None or x != x else round(x, 6) for x in (r.auc, r.acc, r.nll))) for r in found)
    got = rows(audit.QUERIES["strata_metrics"](spark, SF).collect())
    assert {r[1] for r in got} == set(predict.WEIGHTS)
    assert got == rows(expected.itertuples())


def test_ecr_overlap_holds_out_valid_and_test(spark, tmp_path):
    """Ten learners with an edge each that no other learner shows: one is in valid and two are in test, so three edges in ten are told of."""
    lines = [(u, n, 100 * u + n, 2 * u + n, 10.0, 1.0, "N", datetime.datetime(2020, 1, 1 + n)) for u in range(10) for n in (0, 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, l_returnflag string, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(u, u) for u in range(10)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.fold: r.ecr_overlap for r in audit.QUERIES["ecr_overlap"](spark, str(tmp_path)).collect()}
    assert got == {0: 0.3, 1: 0.3, 2: 0.3}
    duck = duckdb.connect()
    for name in ("lineitem", "orders"):
        duck.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    assert dict(duck.execute(ORACLE_SQL["ecr_overlap"]).fetchall()) == got
