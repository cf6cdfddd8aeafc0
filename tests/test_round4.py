"""Findings of round 3: what failed before."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lumenlog.operators import graphs, metrics
from lumenlog.plans import audit
from lumenlog.sources import logs


def shuffled(spark, make):
    """The rows of make() and the records that its jobs shuffled."""
    sc = spark.sparkContext
    store = sc._jsc.sc().statusStore()

    def told():
        stages = store.stageList(None, False, False, sc._gateway.new_array(spark._jvm.double, 0), None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}

    before = told()
    rows = make()
    return rows, sum(n for key, n in told().items() if key not in before)


@pytest.mark.parametrize("method, threshold", [("jaccard", 0.05), ("jaccard", 0.3), ("pmi", -10.0)])
def test_similarities_send_lists_not_pairs(spark, monkeypatch, method, threshold):
    """Every pair of components is told, by lists of bounded length, and far fewer records than pairs are shuffled."""
    monkeypatch.setattr(graphs, "LIST", 16, raising=False)
    rnd = random.Random(3)
    held = {(rnd.randrange(2), item, kc) for item in range(30) for kc in rnd.sample(range(400), rnd.choice([1, 2, 40, 90]))}
    rows = [*held, (0, 7, None), (None, 1, 2), (1, None, 3), (1, None, 4)]
    q = spark.createDataFrame(rows, "fold int, item_id long, kc_id long")
    got, sent = shuffled(spark, lambda: graphs.similarities(q, ["fold"], method, threshold).collect())
    items = {(f, k): {i for g, i, c in rows if (g, c) == (f, k)} for f, _, k in rows}
    count = {f: len({i for g, i, _ in rows if g == f and i is not None}) for f in (0, 1)}
    expected = {}
    for (f, a), x in items.items():
        for (g, b), y in items.items():
            both = len((x & y) - {None})
            if f is not None and f == g and None not in (a, b) and a != b and both:
                weight = both / (len(x) + len(y) - both) if method == "jaccard" else math.log(both * count[f] / (len(x) * len(y)))
                if weight >= threshold:
                    expected[f, a, b] = (both, pytest.approx(weight))
    assert {(r.fold, r.src_kc, r.dst_kc): (r.support, r.weight) for r in got} == expected and len(got) == len(expected)
    pairs = sum(n * (n - 1) for n in ((sum((f, i) == (g, j) for g, j, _ in held)) for f, i in {(f, i) for f, i, _ in held}))
    if method == "jaccard":
        assert sent < pairs / 3


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["transitions", "rates_item", "cold_strata", "e_pre_orders"])
def test_tasks_follow_the_log(spark, monkeypatch, name):
    """Where a shuffle's tasks would get too many rows more tasks share them, with the same result."""
    rows = lambda df: sorted(map(tuple, df.collect()))
    expected = rows(audit.QUERIES[name](spark, SF))
    monkeypatch.setattr(logs, "ROWS", 500, raising=False)
    lines = logs.table(spark, SF, "lineitem").count()
    got, plans = audit.QUERIES[name](spark, SF), []
    a = audit.parts(spark, SF) if name == "cold_strata" else audit.orders(spark, SF)
    plans.append((a.tagged if name in ("rates_item", "cold_strata") else graphs.transitions(a.tagged_steps, ["fold"], a.tasks))._jdf.queryExecution().executedPlan().toString())
    assert rows(got) == expected and lines // 500 > 4
    assert f", {lines // 500})" in plans[0]


def test_cold_start_reads_no_order_and_keeps_its_rows(spark):
    """Strata by the component's channel are those of strata_of, from a staged log without order columns."""
    a = audit.parts(spark, SF)
    models = audit.MODELS_WITHOUT_GRAPH
    expected = metrics.strata_metrics(a.predictions(models=models), metrics.strata_of(a.train))
    b = audit.parts(spark, SF).settled(ordered=False)
    assert not {"seq", "timestamp"} & set(b.tagged.columns)
    rows = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select("fold", "model", "stratum", "n", F.coalesce("auc", F.lit(-1.0)), "acc", "nll").collect())
    cold, sent = shuffled(spark, lambda: rows(audit._cold(b, models)))
    assert cold == rows(expected) and cold


def test_steps_are_the_transitions_of_each_split(spark):
    """Next components over the whole log, counted by split, are those counted within the split."""
    a = audit.orders(spark, SF).stepped()
    rows = lambda df: sorted(map(tuple, df.collect()))
    for split in ("train", "valid"):
        assert rows(graphs.transitions(a.tagged_steps.where(F.col("split") == split), ["fold"])) == rows(graphs.transitions(a.split(split), ["fold"]))
