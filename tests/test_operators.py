"""Small fixtures with known results, and properties against plain Python."""

import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenlog.functions import scalars as S
from lumenlog.operators import bkt, dags, graphs, groundtruth, leakage, metrics, perturb, ranking, sequences, splits, tracing
from lumenlog.operators.head import fitted_head
from lumenlog.plans.audit import Audit
from lumenlog.sources import logs, raw, sinks
from lumenlog.sources.staging import stage

EDGE = "fold int, src_kc long, dst_kc long, support long, weight double, source string"
LOG = "fold int, split string, user_id long, item_id long, kc_id long, timestamp long, seq long, correct long"


def edges(spark, rows):
    return spark.createDataFrame([(0, a, b, 1, w, "t") for a, b, w in rows], EDGE)


def log(spark, rows):
    return spark.createDataFrame([(0, s, u, i, k, t, t, y) for s, u, i, k, t, y in rows], LOG)


def one(df):
    (row,) = df.collect()
    return row


def test_cycle_prune_and_audit(spark):
    df = edges(spark, [(1, 2, 0.9), (2, 3, 0.8), (3, 1, 0.1), (3, 4, 0.7)])
    assert [(r.src_kc, r.dst_kc, r.reason) for r in dags.prune_log(df).collect()] == [(3, 1, "cycle_prune_lowest_confidence")]
    row = one(dags.audit(df))
    assert (row.n_nodes, row.n_edges_raw, row.n_edges_pruned, row.n_edges, row.n_roots, row.n_leaves) == (4, 4, 1, 3, 1, 1)
    assert (row.n_cycles_before, row.n_cycles_after, row.topo_sort_passed) == (1, 0, True)


PAIRS = st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), max_size=20)


@given(PAIRS)
@settings(max_examples=60, deadline=None)
def test_pruning_leaves_an_order(pairs):
    weights = [float((a * 7 + b * 3) % 5) for a, b in pairs]
    gone = set(dags.pruned(pairs, weights))
    order = {n: i for i, n in enumerate(dags.Graph([p for i, p in enumerate(pairs) if i not in gone]).order())}
    assert all(order[a] < order[b] for i, (a, b) in enumerate(pairs) if i not in gone)
    assert not dags.representative_cycles([p for i, p in enumerate(pairs) if i not in gone])
    if not dags.representative_cycles(pairs):
        assert not gone


@given(PAIRS)
@settings(max_examples=60, deadline=None)
def test_each_cycle_is_one(pairs):
    known = set(pairs)
    for ring in dags.representative_cycles(pairs):
        assert all(e in known for e in zip(ring, ring[1:] + ring[:1]))


def test_disruption_of_two_edges_with_the_known_draws():
    # Bernoulli draws of the published two-edge graph: nodes sorted, one vector a seed
    expected = {0.05: (0.0, 0.0), 0.1: (0.0, 0.0), 0.2: (1 / 6, 1 / 3), 0.3: (1 / 6, 1 / 3)}
    for p, (by_edge, by_node) in expected.items():
        e = [np.mean(np.random.default_rng(s).random(2) < p) for s in (42, 17, 1234)]
        n = [float((np.random.default_rng(s).random(2) < p).any()) for s in (42, 17, 1234)]
        assert np.mean(e) == pytest.approx(by_edge) and np.mean(n) == pytest.approx(by_node)


def test_lost_share(spark):
    df = perturb.settings(edges(spark, [(1, 2, 1.0), (2, 3, 1.0)]), (0.3,), (1,))
    assert one(perturb.lost_share(df.withColumn("kept", F.lit(True)), "x")).ddr == 0
    assert one(perturb.lost_share(df.withColumn("kept", F.lit(False)), "x")).ddr == 1
    assert one(perturb.lost_share(perturb.attr_mask(df), "x")).ddr == 0
    with pytest.raises(ValueError):
        perturb.sweep(edges(spark, [(1, 2, 1.0)]), ("other",))


def test_growth_is_by_first_passage(spark):
    rnd = random.Random(8)
    path = [(i, i + 1, 1.0) for i in range(9)]
    web = [(0, rnd.randrange(100, 130), rnd.randrange(100, 130)) for _ in range(60)] + [(0, 200, 201), (0, 201, 202)]
    df = edges(spark, path).union(spark.createDataFrame([(1, a, b, 1, 1.0, "t") for _, a, b in web], EDGE))
    kept = {}
    for r in perturb.kept_nodes(df).collect():
        kept.setdefault((r.fold, r.p, r.seed), set()).add(r.kc)
    assert len(kept) == 2 * 4 * 3
    reach = {(r.fold, r.seed, r.kc): (r.start_, r.from_, r.time_) for r in perturb.growth(df).collect()}
    for fold, pairs in ((0, [(a, b) for a, b, _ in path]), (1, [(a, b) for _, a, b in web])):
        nodes = {x for pair in pairs for x in pair}
        for (k, p, seed), own in kept.items():
            if k != fold:
                continue
            assert len(own) == max(1, math.ceil(round((1 - p) * len(nodes), 9)))
            order = sorted(nodes, key=lambda x: (*reach[fold, seed, x], x))
            assert own == set(order[: len(own)])
            begun = set()
            for x in order:  # each node begins a component or is next to one reached earlier
                near = {b for a, b in pairs if a == x} | {a for a, b in pairs if b == x}
                assert near & begun or (reach[fold, seed, x][1] == x and reach[fold, seed, x][2] == 0)
                begun.add(x)
    lost = perturb.sweep(df, ("subgraph",)).where("p = 0.3 and fold = 0").collect()
    assert all(r.ddr == pytest.approx(1 - 6 / 9) for r in lost)


def test_stable_ids(spark):
    got = spark.createDataFrame([("0",), ("1",), (None,)], "x string").select(S.stable_id(F.col("x")).alias("i")).collect()
    assert [r.i for r in got] == [300471914551172981, 8573800373938698102, None]


def test_splits(spark):
    users = spark.range(30).select(F.col("id").alias("user_id"))
    rows = splits.assign(users, [42, 43]).collect()
    for fold in (0, 1):
        sizes = {s: sum(r.fold == fold and r.split == s for r in rows) for s in ("train", "valid", "test")}
        assert sizes == {"train": 21, "valid": 3, "test": 6}
    assert splits.fold_seeds(42, 3) == [42, 43, 44] and splits.fold_seeds(1, 5, [7, 11]) == [7, 11]
    with pytest.raises(ValueError):
        splits.assign(users, [1], (0.5, 0.1, 0.1))
    shuffled = splits.assign_shuffled(users, [42]).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in shuffled} == {"train": 21, "valid": 3, "test": 6}


def test_guards(spark):
    a = log(spark, [("train", 1, 1, 1, 5, 1), ("valid", 1, 1, 1, 3, 1), ("test", 2, 1, 1, 1, 0)])
    assert [(r.user_id, r.n_splits) for r in splits.user_overlap(a).collect()] == [(1, 2)]
    assert [r.user_id for r in splits.temporal_violations(a).collect()] == [1]
    assert one(splits.train_only(a)) == (True, False)
    assert one(leakage.ecr_flag(a)).ecr_flag == 1.0


@pytest.mark.parametrize("supports,least", [([1, 1, 3], 1), ([1] * 9 + [2, 5], 2), ([1] * 11, None)])
def test_least_support_branches(spark, supports, least):
    counts = spark.createDataFrame([(0, 2 * i, 2 * i + 1, s) for i, s in enumerate(supports)], "fold int, src_kc long, dst_kc long, support long")
    kept = sorted(r.support for r in graphs.prerequisites(counts, ["fold"]).collect())
    # with no pair at the least support, the pairs of highest support stand in
    assert kept == sorted(s for s in supports if least is None or s >= least)


def test_top_k_and_ties(spark):
    counts = spark.createDataFrame([(0, 1, d, 5) for d in (4, 2, 3)], "fold int, src_kc long, dst_kc long, support long")
    assert sorted(r.dst_kc for r in graphs.prerequisites(counts, ["fold"], top_k=2).collect()) == [2, 3]


def test_similarity(spark):
    q = spark.createDataFrame([(0, 1, 1), (0, 1, 2), (0, 2, 1), (0, 3, 2), (0, 3, 3)], "fold int, item_id long, kc_id long")
    got = {(r.src_kc, r.dst_kc): r.weight for r in graphs.similarities(q, ["fold"]).collect()}
    assert got == {(1, 2): pytest.approx(1 / 3), (2, 1): pytest.approx(1 / 3), (2, 3): 0.5, (3, 2): 0.5}
    pmi = {(r.src_kc, r.dst_kc): r.weight for r in graphs.similarities(q, ["fold"], "pmi", -9).collect()}
    assert pmi[1, 2] == pytest.approx(math.log(1 * 3 / (2 * 2)))
    with pytest.raises(ValueError):
        graphs.similarities(q, ["fold"], "cosine")


def test_leakage(spark):
    held = log(spark, [("test", 1, 1, 10, 1, 1), ("test", 1, 2, 20, 2, 0)])
    assert one(leakage.ecr_overlap(edges(spark, [(10, 20, 1.0)]), held)).ecr_overlap == 1.0
    assert one(leakage.ecr_overlap(edges(spark, [(20, 10, 1.0)]), held)).ecr_overlap == 0.0
    train = log(spark, [("train", 1, i, k, i, 1) for i, k in enumerate((10, 20, 10, 20))])
    assert one(leakage.tbvr(train, edges(spark, [(10, 20, 1.0)]), 0.5)).tbvr == 1.0
    with pytest.raises(ValueError):
        leakage.tbvr(train, edges(spark, []), 1.0)
    test = log(spark, [("test", 1, 1, 1, 1, 1), ("test", 1, 1, 2, 2, 1), ("test", 1, 1, 3, 3, 0), ("test", 1, 1, 4, 4, 0)])
    assert one(leakage.eoc(edges(spark, [(1, 2, 1.0), (3, 4, 0.5)]), test)).eoc == pytest.approx(2.0)
    assert one(leakage.eoc(edges(spark, [(1, 2, 1.0)]), test)).eoc == 0.0


@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 4)), min_size=1, max_size=30))
@settings(max_examples=8, deadline=None)
def test_auc_is_the_share_of_pairs(spark, rows):
    df = spark.createDataFrame([(0, y, p / 4) for y, p in rows], "g int, y_true int, y_prob double")
    got = one(metrics.metrics(df, ["g"])).auc
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    if not pos or not neg:
        assert got is None
    else:
        assert got == pytest.approx(np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg]))


def test_strata_gaps(spark):
    n = spark.createDataFrame([(x,) for x in (19, 20, 21, 99, 100, 101, 499, 500, 501)], "n int")
    got = [r.s for r in n.select(S.stratum(F.col("n")).alias("s")).collect()]
    assert got == ["very_cold", "out_of_range", "cold", "cold", "out_of_range", "warm", "warm", "out_of_range", "hot"]
    closed = [r.s for r in n.select(S.stratum(F.col("n"), S.CLOSED_STRATA).alias("s")).collect()]
    assert closed == ["very_cold", "cold", "cold", "cold", "warm", "warm", "warm", "hot", "hot"]


def test_bootstrap(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", 3.0), ("c", None)], "k string, v double")
    got = {r.k: r for r in metrics.bootstrap_ci(df, ["k"], "v").collect()}
    assert got["a"].ci_low <= got["a"].mean <= got["a"].ci_high
    assert (got["b"].ci_low, got["b"].ci_high) == (3.0, 3.0) and got["c"].mean is None


def test_expert_comparison(spark):
    inferred = spark.createDataFrame([(1, 2, 3), (3, 4, 2), (5, 6, 1)], "src_kc long, dst_kc long, support long")
    expert = spark.createDataFrame([(1, 2), (4, 3), (7, 8)], "src_kc long, dst_kc long")
    row = one(groundtruth.hits_at_k(inferred, expert, (2,)))
    assert (row.directed_hits, row.undirected_hits, row.directed_precision) == (1, 2, 0.5) and row.directed_recall == pytest.approx(1 / 3)
    both = spark.createDataFrame([(1, 2, 3), (2, 1, 2)], "src_kc long, dst_kc long, support long")
    row = one(groundtruth.hits_at_k(both, both.drop("support"), (2,)))
    assert (row.directed_hits, row.undirected_hits, row.directed_precision) == (2, 2, 1.0)
    got = {(r.category, r["rank"], r.src_kc, r.dst_kc, r.score) for r in groundtruth.disagreement(inferred, expert).collect()}
    assert got == {("inferred_only", 1, 3, 4, 2.0), ("inferred_only", 2, 5, 6, 1.0), ("expert_only", 1, 4, 3, 1.0), ("expert_only", 2, 7, 8, 1.0), ("wrong_direction", 1, 3, 4, 2.0)}
    names = spark.createDataFrame([(5, "five")], "kc_id long, name string")
    trusted = expert.withColumn("confidence_score", F.col("src_kc") / 10)
    got = {(r.category, r["rank"], r.src_name, r.dst_name, r.score) for r in groundtruth.disagreement(inferred, trusted, 1, 3, names).collect()}
    assert got == {("inferred_only", 1, "3", "4", 2.0), ("expert_only", 1, "7", "8", 0.7), ("wrong_direction", 1, "3", "4", 2.0)}
    assert {r.category for r in groundtruth.disagreement(inferred, expert, top_k=1).collect()} == {"expert_only"}
    by_weight = inferred.select("src_kc", "dst_kc", (-F.col("support")).alias("weight"))
    assert [r.src_kc for r in groundtruth.ranked(by_weight, 2).orderBy("rank_").collect()] == [5, 3] and groundtruth.ranked(inferred, 0).isEmpty()
    report = one(groundtruth.alignment_report(groundtruth.align(expert, spark.createDataFrame([(1,), (2,), (4,)], "kc_id long"))))
    assert (report.matched, report.missing_src, report.missing_dst, report.missing_both) == (1, 0, 1, 1) and report.alignment_rate == pytest.approx(1 / 3)
    same = one(groundtruth.overlap_metrics(inferred, inferred.drop("support"), (3,)))
    assert (same.edge_f1, same.direction_agreement, same.reachability_f1, same.node_jaccard) == (1, 1, 1, 1)


@pytest.mark.parametrize("name,pairs", [("chain", [(i, i + 1) for i in range(150)]), ("ring", [(i, (i + 1) % 4) for i in range(4)])])
def test_reachability(spark, name, pairs):
    df = spark.createDataFrame([(0, a, b) for a, b in pairs], "fold int, src_kc long, dst_kc long")
    n = groundtruth.reachable(df, ["fold"]).count()
    assert n == (151 * 150 // 2 if name == "chain" else 12)


def test_parsers(spark):
    rows = [("True", 1), (" false ", 0), ("1.0", 1), ("0", 0), ("2", None), (None, None)]
    got = spark.createDataFrame([(a,) for a, _ in rows], "x string").select(S.try_correct(F.col("x")).alias("y")).collect()
    assert [r.y for r in got] == [b for _, b in rows]
    times = spark.createDataFrame([("12.9",), ("2020-01-01 00:00:10",)], "x string")
    assert [r.t for r in times.select(S.parse_timestamp(F.col("x")).alias("t")).collect()] == [12, 1577836810]
    with pytest.raises(Exception, match="not a timestamp"):
        spark.createDataFrame([("soon",)], "x string").select(S.parse_timestamp(F.col("x"))).collect()


def test_sequences_expand(spark):
    df = spark.createDataFrame([("u", "1,2,-1,4", "5, 6,-1,8", "1,0,-1,2", "1600000000000,1600000001500,-1,1", "1,1"), (None, None, None, None, None, None)], "uid string, questions string, concepts string, responses string, timestamps string, selectmasks string")
    got = raw.expand_sequences(df).orderBy("timestamp").collect()
    assert [(r.timestamp, r.correct) for r in got] == [(1600000000, 1), (1600000001, 0)]
    assert raw.expand_sequences(df.drop("selectmasks")).count() == 2
    assert [r.kc_id for r in got] == [r.i for r in spark.createDataFrame([("5",), ("6",)], "x string").select(S.stable_id(F.col("x")).alias("i")).collect()]


def test_packing(spark):
    a = log(spark, [("train", 1, 7, 3, 1, 1), ("train", 1, 9, 4, 2, 0), ("test", 2, 9, 3, 1, 1)])
    maps = [sequences.dense_ids(a.where("split = 'train'"), c, ["fold"]) for c in ("item_id", "kc_id")]
    (row,) = sequences.packed(a, *maps, most=4).collect()
    assert (row.questions, row.concepts, row.responses, row.selectmasks, row.timestamps) == ("0,1,-1,-1", "0,1,-1,-1", "1.0,0.0,0,0", "1,1,0,0", "0,1,-1,-1")
    assert tuple(one(sequences.vocabulary_sizes(*maps, ["fold"]))) == (0, 2, 2)
    many = spark.range(1000).select(F.lit(0).alias("fold"), (F.col("id") * 7).alias("item_id"))
    assert sequences.dense_ids(many.union(many), "item_id", ["fold"]).where("item_id = 7 * dense").count() == 1000


def test_replace_is_idempotent(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "dataset string, n int")
    new = spark.createDataFrame([("b", 3)], "dataset string, n int")
    once = sinks.replace_rows(old, new, ["dataset"])
    assert sorted(map(tuple, sinks.replace_rows(once, new, ["dataset"]).collect())) == sorted(map(tuple, once.collect())) == [("a", 1), ("b", 3)]
    path = str(tmp_path / "t")
    for df in (old, new, new):
        sinks.write_partitions(df, path, ["dataset"])
    assert sorted((r.dataset, r.n) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 3)]


def test_readers(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text("who,what,a,b,at,ok\n280.0,x,,k,10,1\n280,x,j,k,11,0\n1,x,,,12,true\n")
    df = raw.read_csv(spark, str(path))
    mapping = {"user_id": "who", "item_id": "what", "kc_id": ["a", "b"], "timestamp": "at", "correct": "ok"}
    got = raw.normalise(raw.raw_filters(df, mapping, binary_only=True, needs_kc=True), mapping).collect()
    assert len(got) == 2 and got[0].user_id == got[1].user_id and got[0].kc_id != got[1].kc_id
    with pytest.raises(ValueError):
        raw.normalise(df, mapping | {"user_id": "nobody"})
    named = spark.createDataFrame([(" p ", "q", "0.7"), ("q", "p", "0.4"), ("q", "z", "0.9")], "Exercise_A string, Exercise_B string, Prerequisite_avg string")
    ids = spark.createDataFrame([("p", 1), ("q", 2)], "name string, kc_id long")
    assert [tuple(r) for r in raw.load_expert_dag(named, ids).collect()] == [(1, 2, 0.7)]
    assert raw.load_edges(spark, str(tmp_path / "none.csv")).count() == 0
    blank = spark.createDataFrame([(" ", "x", "k", "k", "1", "1")], "who string, what string, a string, b string, at string, ok string")
    with pytest.raises(Exception, match="an id is missing"):
        raw.normalise(blank, mapping).collect()


def test_load_raw(spark, tmp_path):
    (tmp_path / "b.csv").write_text("who,what,skill,at,ok\n9,9,9,9,1\n")
    (tmp_path / "a.csv").write_text("who,what,skill,at,ok\nu,i,k,5,1\nu,i,,6,1\nu,j,k,7,2\nv,i,k,8,0\n")
    config = {"raw_path": str(tmp_path), "schema_mapping": {"user_id": "who", "item_id": "what", "kc_id": "skill", "timestamp": "at", "correct": "ok"}, "preprocess": {"correct_mode": "binary_only"}}
    assert raw.interaction_path(spark, config).endswith("a.csv")
    assert sorted((r.timestamp, r.correct) for r in raw.load_raw(spark, config).collect()) == [(5, 1), (8, 0)]
    assert raw.load_raw(spark, config, 1).count() == 1
    (tmp_path / "none.csv").write_text("who,what,skill,at,ok\nu,i,,6,1\n")
    with pytest.raises(ValueError):
        raw.load_raw(spark, config | {"raw_interactions_file": str(tmp_path / "none.csv")})
    for wrong in ({"raw_interactions_file": str(tmp_path / "gone.csv")}, {"raw_path": str(tmp_path / "gone")}):
        with pytest.raises(FileNotFoundError):
            raw.load_raw(spark, config | wrong)
    (tmp_path / "m.txt").write_text("1,0\n0,0\n1,1\n")
    (tmp_path / "info.txt").write_text("a\tb\t4\na\tb\t5\n")
    matrix = {"raw_format": "synthetic", "raw_interactions_file": str(tmp_path / "m.txt"), "raw_info_file": str(tmp_path / "info.txt")}
    ids = {r.x: r.i for r in spark.createDataFrame([(str(k),) for k in range(6)], "x string").select("x", S.stable_id(F.col("x")).alias("i")).collect()}
    expected = [(ids[str(u)], ids[str(i)], ids[str(4 + i)], i, y) for u, row in enumerate([(1, 0), (0, 0), (1, 1)]) for i, y in enumerate(row)]
    assert sorted(map(tuple, raw.load_raw(spark, matrix).collect())) == sorted(expected)
    assert raw.load_raw(spark, matrix, 2).count() == 4
    (tmp_path / "s.csv").write_text('uid,questions,concepts,responses,timestamps\nu,"1,2","3,3","1,0","1000,2000"\n')
    packed = {"raw_format": "xes_sequence", "raw_sequence_files": [str(tmp_path / "s.csv")] * 2}
    assert raw.load_raw(spark, packed).count() == 4 and raw.load_raw(spark, packed, 3).count() == 3
    with pytest.raises(ValueError):
        raw.load_raw(spark, {"raw_format": "xes_sequence"})


def test_side_tables(spark, tmp_path):
    (tmp_path / "q.csv").write_text("item_id,kc_id\n1,2\n")
    assert [tuple(r) for r in raw.load_q_matrix(spark, str(tmp_path / "q.csv")).collect()] == [(1, 2)]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "d_dag.csv").write_text("src_kc,dst_kc\n1,2\n")
    assert raw.load_expert_dag(raw.load_ground_truth(spark, str(tmp_path), "d")).count() == 1
    with pytest.raises(FileNotFoundError):
        raw.load_ground_truth(spark, str(tmp_path), "e")
    assert raw.has_expert_graph("Junyi") and not raw.has_expert_graph("other")
    names = spark.createDataFrame([(" 0 ",), ("0",), ("",), (None,)], "n string")
    assert [tuple(r) for r in raw.kc_map(names, "n").collect()] == [("0", 300471914551172981)]
    (tmp_path / "map.json").write_text('{"a": 1, "b": 2}')
    assert sorted(map(tuple, raw.load_kc_map(spark, str(tmp_path / "map.json")).collect())) == [("a", 1), ("b", 2)]


def test_sinks(spark, tmp_path):
    good = edges(spark, [(1, 2, 1.0)]).withColumn("source", F.lit("train_only"))
    path = str(tmp_path / "audit")
    for _ in range(2):
        sinks.append_audit_rows(sinks.audit_rows(good, "d", "E_pre"), path)
    assert spark.read.parquet(path).count() == 1
    with pytest.raises(Exception, match="train_only_flag"):
        sinks.audit_rows(good.withColumn("source", F.lit("full_log")), "d", "E_pre").collect()
    cells = spark.createDataFrame([(0, 1, 2, 0.5)], "fold int, i long, j long, w double")
    sinks.write_matrix(cells, str(tmp_path / "matrix"))
    assert spark.read.parquet(str(tmp_path / "matrix")).select("i", "j", "w").collect() == [(1, 2, 0.5)]
    index = sinks.artefact_index(spark, {"matrix": str(tmp_path / "matrix"), "audit": path}).collect()
    assert {r.section for r in index} == {"matrix", "audit"} and all(r.path.endswith(".parquet") and r.length for r in index)


def test_belief_is_brought_through_train(spark):
    train = log(spark, [("train", 1, 1, 1, t, y) for t, y in enumerate((1, 0, 1))] + [("train", 2, 1, 2, 1, 0)])
    held = log(spark, [("test", 1, 1, 1, 9, 1), ("test", 1, 1, 1, 10, 0), ("test", 3, 1, 1, 1, 1), ("test", 1, 1, 2, 1, 1)])
    params = spark.createDataFrame([(0, 1, 0.3, 0.2, 0.1, 0.25)], "fold int, kc_id long, p_init double, p_learn double, p_guess double, p_slip double")

    def walk(outcomes):
        know, out = 0.3, []
        for y in outcomes:
            right = know * 0.75 + (1 - know) * 0.1
            out.append(right)
            after = know * 0.75 / right if y else know * 0.25 / (1 - right)
            know = after + (1 - after) * 0.2
        return out

    got = {(r.user_id, r.kc_id, r.pos): r.y_prob for r in bkt.predict(held, params, ["fold"], train).collect()}
    own = walk((1, 0, 1, 1, 0))
    expected = {(1, 1, 0): own[3], (1, 1, 1): own[4], (3, 1, 0): 0.3 * 0.75 + 0.7 * 0.1, (1, 2, 0): 0.5}
    assert got == {k: pytest.approx(v) for k, v in expected.items()}
    assert {r.y_prob for r in bkt.predict(held.where("kc_id = 2"), params, ["fold"], default=0.4).collect()} == {0.4}


def test_fitted_head_is_the_optimum(spark):
    rnd = np.random.default_rng(5)
    x = np.round(rnd.random((120, 3)), 3)
    y = (rnd.random(120) < 1 / (1 + np.exp(-(3 * x[:, 0] - 2 * x[:, 1])))).astype(int)
    rows = [(0, i, i, i, i, int(y[i]), *map(float, x[i])) for i in range(120)]
    df = spark.createDataFrame(rows, "fold int, user_id long, item_id long, kc_id long, seq long, correct long, global double, kc double, graph double")
    got = [r.y_prob for r in fitted_head(df, df, "gkt", l2=0.01).orderBy("seq").collect()]
    a, w = np.column_stack([x, np.ones(120)]), np.zeros(4)
    for _ in range(50):  # Newton steps on the mean log loss with a penalty on all but the constant
        p = 1 / (1 + np.exp(-a @ w))
        ridge = 0.01 * np.array([1, 1, 1, 0])
        w -= np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) / 120 + np.diag(ridge), a.T @ (p - y) / 120 + ridge * w)
    assert got == pytest.approx(list(1 / (1 + np.exp(-a @ w))), abs=1e-8)
    both = fitted_head(df, df.withColumn("freq", F.lit(0.3)), ("gkt", "dgekt"), l2=0.01).where("model = 'gkt'").orderBy("seq").collect()
    assert [r.y_prob for r in both] == pytest.approx(got, abs=1e-8)


def test_runs_switch_between_head_and_blend(spark):
    a = Audit(logs.events_single(spark, "/root/testdata/sf0.001")).settled()
    kinds = {(m, h): one(a.run_model(m, h)[0].select("status").distinct()).status for m, h in (("gkt", True), ("gkt", False), ("bkt", True))}
    assert kinds == {("gkt", True): "trained_leakage_head", ("gkt", False): "diagnostic", ("bkt", True): "diagnostic"}
    assert {r["count"] for r in a.run_model("bkt", cap=7)[1].groupBy("fold").count().collect()} == {7}


def test_bkt_fit_beats_its_start(spark):
    rnd, rows = random.Random(3), []
    for user in range(40):
        know = rnd.random() < 0.3
        for t in range(6):
            rows.append(("train", user, 1, 1, t, int(rnd.random() < (0.9 if know else 0.25))))
            know = know or rnd.random() < 0.3
    row = one(bkt.fit(log(spark, rows), ["fold"]))
    assert row.n_obs == 240 and row.nll <= row.nll_start


def plain_loss(p, text):
    """Negative log likelihood of one outcome string, walked by hand."""
    know, total = p[0], 0.0
    for c in text:
        right = know * (1 - p[3]) + (1 - know) * p[2]
        chance = right if c == "1" else 1 - right
        total -= math.log(chance)
        after = know * ((1 - p[3]) if c == "1" else p[3]) / chance
        know = after + (1 - after) * p[1]
    return total


def walks(text, p):
    """COUNTS of one outcome string by summing over all moments at which the component may be learned."""
    steps, out, whole = len(text), np.zeros(8), 0.0
    for since in range(steps + 1):  # known from step `since` on; steps: never
        chance = p[0] if since == 0 else (1 - p[0]) * (1 - p[1]) ** (min(since, steps) - 1) * (p[1] if since < steps else 1)
        if since == steps:
            chance = (1 - p[0]) * (1 - p[1]) ** (steps - 1)
        own = np.zeros(8)
        own[0], own[1] = since == 0, 1
        own[2], own[3] = 0 < since < steps, min(since, steps - 1)
        for t, c in enumerate(text):
            right = 1 - p[3] if t >= since else p[2]
            chance *= right if c == "1" else 1 - right
            own[5 if t < since else 7] += 1
            own[4] += t < since and c == "1"
            own[6] += t >= since and c == "0"
        out, whole = out + chance * own, whole + chance
    return out / whole, -math.log(whole)


def test_expected_counts_are_sums_over_all_walks():
    rnd = np.random.default_rng(1)
    texts = ["".join(rnd.choice(["0", "1"], n)) for n in (1, 2, 5, 9, 9, 4)]
    params = rnd.uniform(0.1, 0.9, (len(texts), 4))
    got = bkt.expected(params, list(bkt.blocks(texts)))
    for row, text, p in zip(got, texts, params):
        counts, loss = walks(text, p)
        assert row[:8] == pytest.approx(counts) and row[8] == pytest.approx(loss) == pytest.approx(plain_loss(p, text))
    assert bkt.losses(params, texts).diagonal() == pytest.approx(got[:, 8])
    slopes = bkt.scores(got[:, :8], params)
    for k in range(4):
        step = np.eye(4)[k] * 1e-6
        assert slopes[:, k] == pytest.approx([(plain_loss(p - step, t) - plain_loss(p + step, t)) / 2e-6 for t, p in zip(texts, params)], rel=1e-4, abs=1e-4)


def test_rounds_never_lose_likelihood_and_reach_the_best_of_a_fine_grid(spark):
    rnd, strings = random.Random(7), []
    for kc, (init, learn, guess, slip) in enumerate(((0.3, 0.2, 0.2, 0.1), (0.6, 0.4, 0.3, 0.3), (0.1, 0.1, 0.1, 0.05))):
        for _ in range(150):
            know, text = rnd.random() < init, ""
            for _ in range(rnd.randrange(4, 9)):
                text += str(int(rnd.random() < ((1 - slip) if know else guess)))
                know = know or rnd.random() < learn
            strings.append((str(kc), text, 1))
    df = spark.createDataFrame(strings, "group string, outcomes string, n long").repartition(3)
    start = spark.createDataFrame([(str(k), list(bkt.START)) for k in range(3)], "group string, p array<double>")
    state, before = start.selectExpr("group", "p", "double('inf') AS loss", "p AS tries", "true AS falls"), {}
    for _ in range(6):
        state = stage(bkt.likelier_round(df, state), "round")
        now = {r.group: r.loss for r in state.collect()}
        assert all(now[g] <= before.get(g, math.inf) + 1e-9 for g in now)
        before = now
    state, last = start, {}
    for _ in range(4):
        state = stage(bkt.em_round(df, state.select("group", "p"), "p", "next", "loss").selectExpr("group", "next AS p", "loss"), "em")
        now = {r.group: r.loss for r in state.collect()}
        assert all(now[g] <= last.get(g, math.inf) + 1e-9 for g in now)
        last = now
    points = np.array(list(itertools.product(np.linspace(0.05, 0.95, 10), repeat=4)))
    for g in before:
        fine = bkt.losses(points, [t for k, t, _ in strings if k == g]).sum(1).min()
        assert before[g] <= fine * (1 + 1e-4)


def test_recurrent_gradient_is_the_slope():
    rnd = np.random.default_rng(0)
    w = tracing.drawn(5, 1, 0.6, 4)
    kc, y = rnd.integers(0, 5, (7, 6)), rnd.integers(0, 2, (7, 6))
    y[4:, 0], y[6:, 2] = -1, -1
    slopes = []
    for i in range(len(w.flat)):
        step = np.eye(1, len(w.flat), i)[0] * 1e-6
        slopes.append((tracing.gradient(tracing.Weights(5, 4, w.flat + step), kc, y)[1] - tracing.gradient(tracing.Weights(5, 4, w.flat - step), kc, y)[1]) / 2e-6)
    assert tracing.gradient(w, kc, y)[0].flat == pytest.approx(slopes, abs=1e-6)


def test_recurrent_tracing_learns_and_repeats_itself(spark):
    rnd, rows = random.Random(2), []
    for user in range(90):  # a learner's outcomes follow from the first ones, which rates of components do not tell
        able, split = rnd.random() < 0.5, ("train", "train", "valid", "test")[user % 4]
        for t in range(12):
            kc = 99 if split == "test" and t == 11 else rnd.randrange(4)
            rows.append((0, split, user, t, kc, t, int(rnd.random() < (0.9 if able else 0.15)), t))
    tagged = spark.createDataFrame(rows, "fold int, split string, user_id long, item_id long, kc_id long, timestamp long, correct long, seq long")
    ids = sequences.dense_ids(tagged.where("split = 'train'"), "kc_id", ["fold"])
    runs = [sorted((r.user_id, r.item_id, r.y_prob, r.y_true) for r in tracing.traced(tagged, ids, steps=25).collect()) for _ in range(2)]
    held = [r for r in rows if r[1] != "train"]
    assert [x[:2] for x in runs[0]] == sorted((r[2], r[3]) for r in held)
    assert [x[2] for x in runs[0]] == pytest.approx([x[2] for x in runs[1]], abs=1e-6)
    late = [(p, y) for _, t, p, y in runs[0] if t >= 4]
    wins = [(a > b) + (a == b) / 2 for a, x in late if x for b, y in late if not y]
    assert sum(wins) / len(wins) > 0.75


def test_backend_switch(spark):
    a = Audit(logs.events_single(spark, "/root/testdata/sf0.001"))
    for model, backend in (("akt", "trained"), ("dkt", "unheard")):
        with pytest.raises(ValueError):
            a.run_backend(model, backend)
    assert one(a.run_backend("dkt")[0].select("status").distinct()).status == "diagnostic"



@pytest.mark.parametrize("most", [1, 7, 40, 1000])
def test_first_rows_are_those_of_a_sort(spark, monkeypatch, most):
    monkeypatch.setattr(ranking, "BUCKETS", 5)
    rnd = random.Random(most)
    rows = [(k, rnd.choice((-3, 0, 2, 2, 2, 10**9 + rnd.randrange(50))), rnd.randrange(4), i) for k in range(4) for i in range((0, 3, 60, 200)[k])]
    rows += [(9, 5, 1, i) for i in range(60)]  # all alike but for the last column
    df = spark.createDataFrame(rows, "key int, a long, b int, c long")
    first = lambda rows: sorted(rows, key=lambda r: (-r[1], r[2], r[3]))[:most]
    got = ranking.first_rows(df, ["key"], [("a", False), ("b", True)], ["c"], most).collect()
    assert sorted(map(tuple, got)) == sorted(x for k in (1, 2, 3, 9) for x in first([r for r in rows if r[0] == k]))
    got = ranking.first_rows(df, [], [("a", False), ("b", True)], ["c", "key"], most).collect()
    assert sorted(map(tuple, got)) == sorted(sorted(rows, key=lambda r: (-r[1], r[2], r[3], r[0]))[:most])


def test_the_strongest_edges_beyond_the_cap(spark):
    rnd = random.Random(1)
    rows = [(a, b, rnd.randrange(3, 9)) for a in range(60) for b in range(60) if a != b]
    got = graphs.prerequisites(spark.createDataFrame(rows, "src_kc long, dst_kc long, support long"), [], 0.0, 100, 1500)
    assert sorted((r.src_kc, r.dst_kc, r.support) for r in got.collect()) == sorted(sorted(rows, key=lambda r: (-r[2], r[0], r[1]))[:1500])
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


def plain_closure(pairs):
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    found = set()
    for start in out:
        seen, ahead = set(), [start]
        while ahead:
            for b in out.get(ahead.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    ahead.append(b)
        found |= {(start, b) for b in seen if b != start}
    return found


def test_closure_of_a_chain_and_of_dense_cycles(spark):
    rnd = random.Random(5)
    chain = [(i * 7, (i + 1) * 7) for i in range(150)]
    dense = [(a, b) for a in range(80) for b in range(80) if rnd.random() < 0.2]
    loose = [(rnd.randrange(90), rnd.randrange(90)) for _ in range(100)]
    rows = [(k, a, b) for k, pairs in enumerate((chain, dense, loose)) for a, b in pairs]
    got = groundtruth.reachable(spark.createDataFrame(rows, "fold int, src_kc long, dst_kc long"), ["fold"]).collect()
    assert len(got) == len(set(got))
    for k, pairs in enumerate((chain, dense, loose)):
        assert {(r.src_kc, r.dst_kc) for r in got if r.fold == k} == plain_closure([(a, b) for a, b in pairs if a != b])


def test_layers_point_forward(spark):
    rnd = random.Random(6)
    rows = [(k, min(a, b), max(a, b)) for k in range(2) for a, b in ((rnd.randrange(20), rnd.randrange(20)) for _ in range(40)) if a != b]
    df = spark.createDataFrame(rows, "fold int, src_kc long, dst_kc long")
    layer = {(r.fold, r.kc_id): r.layer for r in dags.layers(df, ["fold"]).collect()}
    assert set(layer) == {(k, x) for k, a, b in rows for x in (a, b)}
    assert all(layer[k, a] < layer[k, b] for k, a, b in rows)
    assert all(n == 0 or any(layer[k, a] == n - 1 for j, a, b in rows if (j, b) == (k, x)) for (k, x), n in layer.items())
    with pytest.raises(ValueError):
        dags.layers(df.union(spark.createDataFrame([(0, 50, 51), (0, 51, 50)], df.schema)), ["fold"])
    assert dags.layers(df.where("false"), ["fold"]).count() == 0


def test_resampled_intervals_are_those_of_draws(spark):
    rnd = np.random.default_rng(3)
    rows = [(k, float(x)) for k, n in ((0, 40), (1, 5), (2, 1)) for x in rnd.normal(k, 1, n)] + [(0, None), (3, None)]
    df = spark.createDataFrame(rows, "fold int, v double")
    got = {r.fold: r for r in metrics.bootstrap_ci(df, ["fold"], "v", n=600).collect()}
    drawn = {r.fold: r for r in metrics.bootstrap_ci_drawn(df, ["fold"], "v", n=600).collect()}
    assert (got[3].ci_low, got[3]["mean"], got[3].n) == (None, None, 0) and got[2].ci_low == pytest.approx(got[2].ci_high) == pytest.approx(got[2]["mean"])
    for k in (0, 1):
        assert got[k]["mean"] == pytest.approx(drawn[k]["mean"]) and got[k].n == drawn[k].n
        width = drawn[k].ci_high - drawn[k].ci_low
        assert abs(got[k].ci_low - drawn[k].ci_low) < 0.15 * width and abs(got[k].ci_high - drawn[k].ci_high) < 0.15 * width
