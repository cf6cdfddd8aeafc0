"""Every registered audit query against its oracle on the smallest tables."""

import math
from hashlib import blake2b

import duckdb
import pytest

from lumenlog.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{round(v, 6) + 0.0:.6f}"
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(value(row[c]) for c in columns) for row in df.collect())
    found = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(value(row[i]) for i in at) for row in found.fetchall())


def no_cycle(rows):
    return all(r.n_cycles_after == 0 and r.topo_sort_passed and r.n_edges <= r.n_edges_raw - r.n_edges_pruned for r in rows)


#: What must hold of the results of queries that SQL cannot express; their operators have tests of their own.
CHECKS = {
    "dag_audit": no_cycle,
    "dag_prune": lambda rows: all(r.reason == "cycle_prune_lowest_confidence" for r in rows) and len({(r.fold, r.src_kc, r.dst_kc) for r in rows}) == len(rows),
    "stable_id_blake2b": lambda rows: all(r.id == int.from_bytes(blake2b(r.n_name.encode(), digest_size=8).digest(), "big") & (2**63 - 1) for r in rows),
    "bkt_fit": lambda rows: all(r.nll <= r.nll_start and all(0.05 <= p <= 0.95 for p in (r.p_init, r.p_learn, r.p_guess, r.p_slip)) for r in rows),
    "bkt_predict": lambda rows: all(0 < r.y_prob < 1 for r in rows),
    "backend_runs": lambda rows: {(r.model, r.status) for r in rows} == {("bkt", "classical_bkt_em"), ("dkt", "recurrent_tracing"), ("dkt", "diagnostic")} and len(rows) == 9,
    "logistic_head": lambda rows: {r.status for r in rows} == {"trained_leakage_head"} and all(0 < r.auc < 1 and r.n > 0 for r in rows),
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert rows and CHECKS[name](rows)


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["fold", "src_kc", "dst_kc", "support", "weight", "source"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
