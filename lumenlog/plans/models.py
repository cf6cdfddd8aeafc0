"""Queries of fitted and recurrent models, and the SQL of what they compute at given parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenlog.operators import bkt, sequences, tracing
from lumenlog.plans.audit import FOLD, rounded, single
from lumenlog.plans.oracle import blends, ddr, scores, sql

EM_ROUNDS = 3
TRACER_WIDTH = 2


def bkt_em_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bkt.em_rounds(single(spark, sf_dir).train, FOLD, EM_ROUNDS), *bkt.NAMES, "nll")


def fixed_weights(n: int) -> tracing.Weights:
    """Weights by formula, for a recurrent pass that SQL can repeat."""
    w = tracing.Weights(n, TRACER_WIDTH)
    for j in range(TRACER_WIDTH):
        w.into[:, j] = [((3 * i + 5 * j) % 7 - 3) / 10 for i in range(2 * n)]
        w.turn[:, j] = [((i + 2 * j) % 3 - 1) / 5 for i in range(TRACER_WIDTH)]
        w.shift[j] = 0.05 * (j + 1)
        w.out[:, j] = [((2 * k + j) % 5 - 2) / 5 for k in range(n)]
    w.bias[:] = [(k % 4 - 1.5) / 5 for k in range(n)]
    return w


def tracer_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held rows foretold by a recurrent pass with fixed weights."""
    a = single(spark, sf_dir)
    ids = sequences.dense_ids(a.train, "kc_id", FOLD)
    seqs = tracing.sequences_of(a.held, ids)
    sizes = {r.fold: r.n for r in sequences.vocabulary_sizes(ids.withColumnRenamed("kc_id", "item_id"), ids, FOLD).selectExpr("fold", "n_concepts + 1 AS n").collect()}  # a row a fold
    return rounded(tracing.scored(seqs, {fold: fixed_weights(n) for fold, n in sizes.items()}).drop("item_id", "model"), "y_prob")


def backend_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of trained models beside a blend's, as the backend switch gives them."""
    a, out = single(spark, sf_dir).settled(), None
    for model, backend in (("bkt", "trained"), ("dkt", "trained"), ("dkt", "diagnostic")):
        rows, _ = a.run_backend(model, backend)
        out = rows if out is None else out.union(rows)
    return rounded(out, "auc", "acc", "nll")


def _em_sql() -> str:
    """EM_ROUNDS rounds over outcome strings: beliefs forward, scaled chances of what follows backward, expected counts."""
    s = "SELECT fold, kc_id, outcomes, count(*) AS n FROM (SELECT fold, kc_id, user_id, string_agg(CAST(correct AS VARCHAR), '' ORDER BY timestamp, seq) AS outcomes FROM tr GROUP BY ALL HAVING count(*) >= 4) GROUP BY ALL"
    start = ", ".join(f"{v}::DOUBLE AS {c}" for v, c in zip(bkt.START, "algz"))
    parts = [f"s AS MATERIALIZED ({s})", f"q0 AS (SELECT DISTINCT fold, kc_id, {start}, 0::DOUBLE AS nll FROM s)"]
    y = "(substr(outcomes, t, 1) = '1')"
    known, not_known = f"CASE WHEN {y} THEN 1 - z ELSE z END", f"CASE WHEN {y} THEN g ELSE 1 - g END"
    key = "fold, kc_id, outcomes"
    clip = lambda n, d, old: f"CASE WHEN {d} > 0 THEN least(greatest({n} / {d}, {bkt.BOUNDS[0]}), {bkt.BOUNDS[1]}) ELSE {old} END"
    for k in range(EM_ROUNDS):
        step = f"(k * ({known}) / (k * ({known}) + (1 - k) * ({not_known})))"
        parts += [
            f"f{k} AS (SELECT {key}, n, a, l, g, z, 1 AS t, a AS k FROM s JOIN q{k} USING (fold, kc_id) UNION ALL SELECT {key}, n, a, l, g, z, t + 1, {step} + (1 - {step}) * l FROM f{k} WHERE t < length(outcomes))",
            f"x{k} AS MATERIALIZED (SELECT *, {known} AS kn, {not_known} AS un, k * ({known}) + (1 - k) * ({not_known}) AS c, {step} AS post, {y} AS y FROM f{k})",
            f"b{k} AS (SELECT {key}, length(outcomes) AS t, 1::DOUBLE AS bk, 1::DOUBLE AS bu FROM s UNION ALL SELECT {key}, b{k}.t - 1, kn * bk / c, l * kn * bk / c + (1 - l) * un * bu / c FROM b{k} JOIN x{k} USING (fold, kc_id, outcomes, t) WHERE b{k}.t > 1)",
            f"e{k} AS (SELECT fold, kc_id, a, l, g, z, sum(n) FILTER (t = 1) AS d1, sum(n * post * bk) FILTER (t = 1) AS n1, sum(n * (1 - post) * l * bk) FILTER (t < length(outcomes)) AS n2, sum(n * (1 - post) * bu) FILTER (t < length(outcomes)) AS d2,"
            f" sum(n * (1 - post) * bu) FILTER (y) AS n3, sum(n * (1 - post) * bu) AS d3, sum(n * post * bk) FILTER (NOT y) AS n4, sum(n * post * bk) AS d4, -sum(n * ln(c)) AS nll FROM x{k} JOIN b{k} USING (fold, kc_id, outcomes, t) GROUP BY ALL)",
            f"q{k + 1} AS MATERIALIZED (SELECT fold, kc_id, {clip('n1', 'd1', 'a')} AS a, {clip('n2', 'd2', 'l')} AS l, {clip('coalesce(n3, 0)', 'd3', 'g')} AS g, {clip('coalesce(n4, 0)', 'd4', 'z')} AS z, nll FROM e{k})",
        ]
    columns = ", ".join(f"round({c}, 6) AS {name}" for c, name in zip("algz", bkt.NAMES))
    return sql("single", "tr", f"SELECT fold, kc_id, {columns}, round(nll, 6) AS nll FROM q{EM_ROUNDS}", ",\n".join(parts))


def _tracer_sql() -> str:
    """The recurrent pass along each learner's held rows, a state of two numbers."""
    into = lambda j: f"((3 * (2 * kc + y) + {5 * j}) % 7 - 3) / 10.0::DOUBLE"
    turn = lambda i, j: (i + 2 * j) % 3 / 5 - 0.2
    state = lambda j: f"tanh({into(j)} + h0 * {turn(0, j)}::DOUBLE + h1 * {turn(1, j)}::DOUBLE + {0.05 * (j + 1)}::DOUBLE)"
    out = lambda j: f"((2 * kc + {j}) % 5 - 2) / 5.0::DOUBLE"
    chance = f"1 / (1 + exp(-(h0 * {out(0)} + h1 * {out(1)} + (kc % 4 - 1.5::DOUBLE) / 5)))"
    lined = "r AS MATERIALIZED (SELECT e.fold, e.user_id, e.kc_id, seq, correct AS y, coalesce(dense, top + 1) AS kc, row_number() OVER (PARTITION BY e.fold, e.user_id, e.split ORDER BY timestamp, seq) AS t FROM (SELECT * FROM tagged WHERE split <> 'train') e LEFT JOIN dense_kc d USING (fold, kc_id) JOIN (SELECT fold, max(dense) AS top FROM dense_kc GROUP BY fold) m ON e.fold = m.fold)"
    walk = f"w AS (SELECT *, 0::DOUBLE AS h0, 0::DOUBLE AS h1 FROM r WHERE t = 1 UNION ALL SELECT r.*, {state(0)}, {state(1)} FROM (SELECT fold, user_id, t AS b, kc, y, h0, h1 FROM w) w JOIN r ON r.fold = w.fold AND r.user_id = w.user_id AND r.t = w.b + 1)"
    walk = walk.replace("2 * kc + y", "2 * w.kc + w.y")
    return sql("single", "tagged dense_kc", f"SELECT fold, user_id, kc_id, CAST(seq AS VARCHAR) AS seq, y AS y_true, round(round({chance}, 9), 6) AS y_prob FROM w", f"{lined},\n{walk}")


def resampled(name: str, body: str, keys: str, value: str) -> str:
    """Tables that end in <name>: keys, lo and hi, the interval of resampled means of a value of body."""
    return f"""{name}o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY md5(CAST(CAST(round(x * 1000000000::DOUBLE) AS BIGINT) AS VARCHAR)), x) - 1 AS rk, count(*) OVER (PARTITION BY {keys}) AS size FROM (SELECT {keys}, {value} AS x FROM ({body}) WHERE {value} IS NOT NULL)),
{name}d AS (SELECT {keys}, b, CAST(concat('0x', substr(md5(concat('42:', b, ':', rk)), 1, 8)) AS BIGINT) % size AS rk FROM {name}o, (SELECT unnest(range(1, 1001)) AS b)),
{name} AS (SELECT {keys}, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM (SELECT {keys}, b, avg(x) AS m FROM {name}d JOIN {name}o USING ({keys}, rk) GROUP BY {keys}, b) GROUP BY {keys})"""


def _report_sql() -> str:
    folds = scores(f"({blends('ch')})", "fold, model")
    names = ("auc", "acc", "nll")
    tables = ",\n".join([f"f AS MATERIALIZED ({folds})", *(resampled(f"r{c}", "SELECT * FROM f", "model", c) for c in names)])
    columns = ", ".join(f"round(avg({c}), 6) AS {c}, round(any_value(r{c}.lo), 6) AS {c}_ci_low, round(any_value(r{c}.hi), 6) AS {c}_ci_high" for c in names)
    joins = " ".join(f"JOIN r{c} USING (model)" for c in names)
    return sql("single", "ch", f"SELECT 'events_single' AS dataset, model, 'train_only' AS graph_construction, count(DISTINCT fold) AS n_folds, CAST(sum(n) AS BIGINT) AS n_eval, 'diagnostic' AS status, concat('fold ', min(fold)) AS note, {columns} FROM f {joins} GROUP BY model", tables)


def _ddr_sql() -> str:
    body = " UNION ALL ".join(f"({ddr(k)})" for k in ("edge_drop", "node_drop", "attr_mask"))
    tables = f"s AS MATERIALIZED ({body}),\n{resampled('ci', 'SELECT * FROM s', 'augmentation, p', 'ddr')}"
    return sql("single", "pre", "SELECT augmentation, p, round(avg(ddr), 6) AS mean, round(any_value(lo), 6) AS ci_low, round(any_value(hi), 6) AS ci_high, count(*) AS n FROM s JOIN ci USING (augmentation, p) GROUP BY augmentation, p", tables)


_TABLES = "e AS MATERIALIZED (SELECT DISTINCT fold, least(src_kc, dst_kc) AS a, greatest(src_kc, dst_kc) AS b, seed, CAST(concat('0x', substr(md5(concat(seed, ':', least(src_kc, dst_kc), '-', greatest(src_kc, dst_kc))), 1, 7)) AS BIGINT) + 1 AS took FROM pre, (SELECT unnest([42, 17, 1234]) AS seed) WHERE src_kc <> dst_kc)"
GROWTH = f"""{_TABLES},
both_ AS MATERIALIZED (SELECT fold, seed, a AS kc, b AS to_, took FROM e UNION ALL SELECT fold, seed, b, a, took FROM e),
st AS (SELECT fold, seed, kc, {{'h': CAST(concat('0x', substr(md5(concat(seed, ':', kc)), 1, 8)) AS BIGINT), 'k': kc, 'd': 0::BIGINT}} AS s, 0 AS it FROM (SELECT fold, src_kc AS kc FROM pre UNION SELECT fold, dst_kc FROM pre), (SELECT unnest([42, 17, 1234]) AS seed)
  UNION ALL SELECT fold, seed, kc, list_sort(list(s))[1] AS s, it + 1 FROM (SELECT fold, seed, kc, s, it FROM st UNION ALL SELECT st.fold, st.seed, to_, {{'h': s.h, 'k': s.k, 'd': s.d + took}}, it FROM st JOIN both_ USING (fold, seed, kc)) WHERE it < 40 GROUP BY fold, seed, kc, it),
rk AS (SELECT fold, seed, kc, row_number() OVER (PARTITION BY fold, seed ORDER BY s, kc) AS rk, count(*) OVER (PARTITION BY fold, seed) AS n FROM st WHERE it = 40),
keep AS MATERIALIZED (SELECT fold, p, seed, kc FROM rk, (SELECT unnest([0.05::DOUBLE, 0.1, 0.2, 0.3]) AS p) WHERE rk <= greatest(1, ceil(round((1 - p) * n, 9))))"""
_GROWN = """SELECT x.fold, 'subgraph' AS augmentation, ps.p, sd.seed, avg(CASE WHEN a.kc IS NULL OR b.kc IS NULL THEN 1.0::DOUBLE ELSE 0 END) AS ddr
  FROM (SELECT DISTINCT fold, src_kc, dst_kc FROM pre) x CROSS JOIN (SELECT unnest([0.05::DOUBLE, 0.1, 0.2, 0.3]) AS p) ps CROSS JOIN (SELECT unnest([42, 17, 1234]) AS seed) sd
  LEFT JOIN keep a ON a.fold = x.fold AND a.p = ps.p AND a.seed = sd.seed AND a.kc = src_kc LEFT JOIN keep b ON b.fold = x.fold AND b.p = ps.p AND b.seed = sd.seed AND b.kc = dst_kc GROUP BY x.fold, ps.p, sd.seed"""


def _summary_sql() -> str:
    body = " UNION ALL ".join(f"({ddr(k)})" for k in ("edge_drop", "node_drop", "attr_mask")) + f" UNION ALL ({_GROWN})"
    return sql("single", "pre", f"SELECT augmentation, p, round(avg(ddr), 6) AS ddr_mean, round(coalesce(stddev_samp(ddr), 0), 6) AS ddr_std, count(*) AS n FROM ({body}) GROUP BY augmentation, p", GROWTH)


def _layers_sql() -> str:
    """The longest path that ends in a node, over all lengths of paths."""
    up = "up AS MATERIALIZED (SELECT DISTINCT fold, src_kc, dst_kc FROM pre WHERE src_kc < dst_kc)"
    walk = "w AS (SELECT fold, src_kc AS kc_id, 0 AS layer FROM up UNION SELECT w.fold, dst_kc, layer + 1 FROM w JOIN up ON up.fold = w.fold AND src_kc = kc_id)"
    return sql("single", "pre", "SELECT fold, kc_id, max(layer) AS layer FROM w GROUP BY fold, kc_id", f"{up},\n{walk}")


QUERIES = {"bkt_em_rounds": bkt_em_rounds, "tracer_filter": tracer_filter, "backend_runs": backend_runs}
ORACLE_SQL = {"bkt_em_rounds": _em_sql(), "tracer_filter": _tracer_sql(), "fold_report": _report_sql(), "ddr_bootstrap": _ddr_sql(), "dag_layers": _layers_sql(), "ddr_summary": _summary_sql(), "ddr_subgraph": sql("single", "pre", f"SELECT fold, augmentation, p, seed, round(ddr, 6) AS ddr FROM ({_GROWN})", GROWTH)}
