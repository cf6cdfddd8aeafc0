"""DuckDB SQL that must give the rows of the registered queries; parts are common table expressions by name."""

from __future__ import annotations

from lumenlog.operators.predict import ALPHA, GRAPH_MODELS, WEIGHTS

SEEDS, QUANTILE, TOP_K, MAX_EDGES, KS = (42, 43, 44), 0.9, 5, 5000, (5, 20, 50)

ITEM = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
LOGS = {
    "single": f"SELECT user_id, {ITEM} AS item_id, {ITEM} % 20 AS kc_id, epoch_us(ts) AS timestamp, CAST(value < 20 AS BIGINT) AS correct, event_id AS seq FROM events",
    "multi": f"SELECT user_id, {ITEM} AS item_id, kc_id, epoch_us(ts) AS timestamp, CAST(value < 20 AS BIGINT) AS correct, event_id AS seq FROM events JOIN (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS BIGINT) AS kc_id FROM (SELECT DISTINCT event_type FROM events)) USING (event_type)",
}
_SEQ = "concat_ws(':', lpad(CAST(l_orderkey AS VARCHAR), 12, '0'), lpad(CAST(l_linenumber AS VARCHAR), 12, '0'), lpad(CAST(l_partkey AS VARCHAR), 12, '0'), lpad(CAST(l_suppkey AS VARCHAR), 12, '0'), lpad(CAST(CAST(floor(l_extendedprice * 100) AS BIGINT) AS VARCHAR), 12, '0'), lpad(CAST(CAST(floor(l_quantity) AS BIGINT) AS VARCHAR), 12, '0'), l_returnflag)"
for _name, _kc in (("orders", "l_suppkey"), ("parts", "l_partkey")):
    LOGS[_name] = f"SELECT o_custkey AS user_id, l_partkey AS item_id, {_kc} AS kc_id, epoch_us(l_shipdate) AS timestamp, CAST(l_returnflag <> 'R' AS BIGINT) AS correct, {_SEQ} AS seq FROM lineitem JOIN orders ON l_orderkey = o_orderkey"

_FOLDS = ", ".join(f"({i}, {s})" for i, s in enumerate(SEEDS))


def transitions(rows: str, fold: str) -> str:
    return f"SELECT {fold}src_kc, dst_kc, count(*) AS support FROM (SELECT {fold}kc_id AS src_kc, lead(kc_id) OVER (PARTITION BY {fold}user_id ORDER BY timestamp, seq) AS dst_kc FROM {rows}) WHERE dst_kc IS NOT NULL AND src_kc <> dst_kc GROUP BY ALL"


def prerequisites(counts: str, fold: str, source: str, most: int = MAX_EDGES) -> str:
    part = f"PARTITION BY {fold.rstrip(', ')} " if fold else ""
    join = f"JOIN (SELECT {fold}{{}} FROM {counts} GROUP BY ALL) USING (fold)" if fold else f"CROSS JOIN (SELECT {{}} FROM {counts})"
    stats = join.format(f"CASE WHEN count(*) > 10 THEN greatest(2, CAST(ceil(quantile_cont(support, {QUANTILE})) AS BIGINT)) ELSE 1 END AS least_, max(support) AS max_")
    return f"""SELECT {fold}src_kc, dst_kc, support, CAST(support AS DOUBLE) / greatest(max(support) OVER ({part}), 1) AS weight, '{source}' AS source FROM (
  SELECT *, row_number() OVER ({part}ORDER BY support DESC, src_kc, dst_kc) AS g FROM (
    SELECT *, row_number() OVER (PARTITION BY {fold}src_kc ORDER BY support DESC, dst_kc) AS r FROM (
      SELECT *, row_number() OVER ({part}ORDER BY support DESC, src_kc, dst_kc) AS a FROM {counts} {stats}) WHERE support >= least_ OR (max_ < least_ AND a <= 200)) WHERE r <= {TOP_K}) WHERE g <= {most}"""


def similarities(q: str, fold: str, source: str, method: str = "jaccard", threshold: float = 0.1) -> str:
    on = "AND a.fold = b.fold" if fold else ""
    fa = "a.fold, " if fold else ""
    using = f"USING ({fold}{{}})"
    weight = "CAST(inter AS DOUBLE) / (n1 + n2 - inter)" if method == "jaccard" else "ln(CAST(inter AS DOUBLE) * items / (n1 * n2))"
    items = "" if method == "jaccard" else (f"JOIN (SELECT {fold}count(DISTINCT item_id) AS items FROM {q} GROUP BY ALL) USING (fold)" if fold else f"CROSS JOIN (SELECT count(DISTINCT item_id) AS items FROM {q})")
    size = lambda end, n: f"JOIN (SELECT {fold}kc_id AS {end}, count(*) AS {n} FROM {q} GROUP BY ALL) {using.format(end)}"
    return f"SELECT {fold}src_kc, dst_kc, inter AS support, {weight} AS weight, '{source}' AS source FROM (SELECT {fa}a.kc_id AS src_kc, b.kc_id AS dst_kc, count(*) AS inter FROM {q} a JOIN {q} b ON a.item_id = b.item_id {on} AND a.kc_id <> b.kc_id GROUP BY ALL) {size('src_kc', 'n1')} {size('dst_kc', 'n2')} {items} WHERE {weight} >= {threshold}"


def neighbours(edges: str, rates: str) -> str:
    return f"SELECT fold, kc_id, avg(rate) AS rate FROM (SELECT fold, src_kc AS kc_id, dst_kc AS other FROM {edges} UNION ALL SELECT fold, dst_kc, src_kc FROM {edges}) e JOIN (SELECT fold, kc_id AS other, rate FROM {rates}) USING (fold, other) GROUP BY ALL"


def rate(key: str, name: str) -> str:
    return f"SELECT fold, {key}, (sum(correct) + {ALPHA} * any_value(g)) / (count(*) + {ALPHA}) AS {name}, count(*) AS n FROM tr JOIN g USING (fold) GROUP BY fold, {key}"


def graph_channel(pre: str, sim: str, rates: str = "rate_kc") -> str:
    return f"SELECT fold, kc_id, coalesce(b.rate, a.rate) AS rate FROM ({neighbours(pre, rates)}) a FULL JOIN ({neighbours(sim, rates)}) b USING (fold, kc_id) UNION ALL SELECT fold, kc_id, rate FROM rate_kc WHERE fold NOT IN (SELECT fold FROM {pre} UNION SELECT fold FROM {sim})"


def channels(graph: str) -> str:
    return f"""SELECT ev.*, g.g AS "global", coalesce(k.rate, g.g) AS kc, coalesce(i.item, g.g) AS item, coalesce(u.usr, g.g) AS "user", coalesce(gr.rate, g.g) AS graph, 0.5::DOUBLE * g.g + 0.5::DOUBLE * coalesce(k.n, 0) / top AS freq
  FROM ev JOIN g USING (fold) JOIN (SELECT fold, greatest(max(n), 1) AS top FROM rate_kc GROUP BY fold) USING (fold)
  LEFT JOIN rate_kc k USING (fold, kc_id) LEFT JOIN ({rate('item_id', 'item')}) i USING (fold, item_id) LEFT JOIN ({rate('user_id', 'usr')}) u USING (fold, user_id) LEFT JOIN {graph} gr USING (fold, kc_id)"""


def blend(model: str, table: str) -> str:
    sum_ = " + ".join(f"{w!r}::DOUBLE * \"{c}\"" for c, w in WEIGHTS[model].items())
    total = sum(WEIGHTS[model].values())
    return f"SELECT fold, user_id, item_id, kc_id, seq, correct AS y_true, '{model}' AS model, round(greatest(least((0.0::DOUBLE + {sum_}) / {total!r}::DOUBLE, 0.9999::DOUBLE), 0.0001::DOUBLE), 9) AS y_prob FROM {table}"


def blends(table: str, models=tuple(WEIGHTS)) -> str:
    return " UNION ALL ".join(blend(m, table) for m in models)


def scores(pred: str, keys: str, eps: str = "0.0001") -> str:
    p = f"greatest(least(y_prob, 1 - {eps}::DOUBLE), {eps}::DOUBLE)"
    return f"""SELECT {keys}, count(*) AS n, CASE WHEN sum(y_true) > 0 AND sum(y_true) < count(*) THEN (sum(CASE WHEN y_true = 1 THEN ar END) - sum(y_true) * (sum(y_true) + 1) / 2.0::DOUBLE) / (CAST(sum(y_true) AS DOUBLE) * (count(*) - sum(y_true))) END AS auc,
  avg(CASE WHEN (y_prob >= 0.5) = (y_true = 1) THEN 1.0::DOUBLE ELSE 0 END) AS acc, avg(-CASE WHEN y_true = 1 THEN ln({p}) ELSE ln(1 - {p}) END) AS nll
  FROM (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY y_prob) + (count(*) OVER (PARTITION BY {keys}, y_prob) - 1) / 2.0::DOUBLE AS ar FROM {pred}) GROUP BY {keys}"""


def below(p: str, *parts: str) -> str:
    return f"CAST(concat('0x', substr(md5(concat({', '.join(parts)})), 1, 8)) AS BIGINT) < floor({p} * 4294967296.0::DOUBLE)"


def ddr(kind: str) -> str:
    ends = ["src_kc", "'>'", "dst_kc"]
    gone = {
        "edge_drop": below("p", "seed", "':'", *ends),
        "node_drop": f"({below('p', 'seed', chr(39) + ':' + chr(39), 'src_kc')} OR {below('p', 'seed', chr(39) + ':' + chr(39), 'dst_kc')})",
        "attr_mask": "false",
    }[kind]
    return f"SELECT fold, '{kind}' AS augmentation, p, seed, avg(CASE WHEN {gone} THEN 1.0::DOUBLE ELSE 0 END) AS ddr FROM pre, (SELECT unnest([0.05::DOUBLE, 0.1, 0.2, 0.3]) AS p) ps, (SELECT unnest([42, 17, 1234]) AS seed) ss GROUP BY ALL"


#: name: (names it needs, SQL)
PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "assign": (("log",), f"""SELECT fold, user_id, CASE WHEN rk < floor(n * 0.7::DOUBLE) THEN 'train' WHEN rk < floor(n * 0.7::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'valid' ELSE 'test' END AS split
  FROM (SELECT fold, user_id, row_number() OVER (PARTITION BY fold ORDER BY md5(concat(seed, ':', user_id)), user_id) - 1 AS rk, count(*) OVER (PARTITION BY fold) AS n
        FROM (SELECT DISTINCT user_id FROM log) u, (VALUES {_FOLDS}) f(fold, seed))"""),
    "tagged": (("log", "assign"), "SELECT * FROM log JOIN assign USING (user_id)"),
    "tr": (("tagged",), "SELECT * FROM tagged WHERE split = 'train'"),
    "ev": (("tagged",), "SELECT * FROM tagged WHERE split <> 'train'"),
    "te": (("tagged",), "SELECT * FROM tagged WHERE split = 'test'"),
    "q": (("tr",), "SELECT DISTINCT fold, item_id, kc_id FROM tr"),
    "qf": (("log",), "SELECT DISTINCT item_id, kc_id FROM log"),
    "cn": (("tr",), transitions("tr", "fold, ")),
    "cnf": (("log",), transitions("log", "")),
    "pre": (("cn",), prerequisites("cn", "fold, ", "train_only")),
    "pre30": (("cn",), prerequisites("cn", "fold, ", "train_only", 30)),
    "pref": (("cnf",), prerequisites("cnf", "", "full_log")),
    "sim": (("q",), similarities("q", "fold, ", "train_only")),
    "simf": (("qf",), similarities("qf", "", "full_log")),
    "pre3": (("pref",), "SELECT * FROM pref, (SELECT unnest([0, 1, 2]) AS fold)"),
    "sim3": (("simf",), "SELECT * FROM simf, (SELECT unnest([0, 1, 2]) AS fold)"),
    "edges": (("pre", "sim"), "SELECT fold, src_kc, dst_kc, weight FROM pre UNION ALL SELECT fold, src_kc, dst_kc, weight FROM sim"),
    "g": (("tr",), "SELECT fold, avg(correct) AS g FROM tr GROUP BY fold"),
    "rate_kc": (("tr", "g"), rate("kc_id", "rate")),
    "rate_item": (("tr", "g"), rate("item_id", "rate")),
    "graph": (("pre", "sim", "rate_kc"), graph_channel("pre", "sim")),
    "pooled": (("log",), f"SELECT fold, kc_id, (sum(correct) + {ALPHA} * any_value(g)) / (count(*) + {ALPHA}) AS rate FROM log, (SELECT avg(correct) AS g FROM log), (SELECT unnest([0, 1, 2]) AS fold) GROUP BY fold, kc_id"),
    "graph3": (("pre3", "sim3", "rate_kc", "pooled"), graph_channel("pre3", "sim3", "pooled")),
    "ch": (("ev", "g", "rate_kc", "graph"), channels("graph")),
    "ch3": (("ev", "g", "rate_kc", "graph3"), channels("graph3")),
    "strata": (("tr",), "SELECT fold, kc_id, n AS n_train_interactions, CASE WHEN n > -1 AND n <= 19 THEN 'very_cold' WHEN n > 20 AND n <= 99 THEN 'cold' WHEN n > 100 AND n <= 499 THEN 'warm' WHEN n > 500 AND n <= 10000000 THEN 'hot' ELSE 'out_of_range' END AS stratum FROM (SELECT fold, kc_id, count(*) AS n FROM tr GROUP BY ALL)"),
    "ecr_flag": (("tagged",), "SELECT fold, max(CASE WHEN n > 1 THEN 1.0::DOUBLE ELSE 0 END) AS ecr_flag FROM (SELECT fold, user_id, count(DISTINCT split) AS n FROM tagged GROUP BY ALL) GROUP BY fold"),
    "eoc": (("te",), ""),
    "kcs": (("log",), "SELECT DISTINCT kc_id AS k FROM log"),
    "expert": (("kcs",), "SELECT CASE WHEN k % 3 = 0 THEN k + 1 ELSE k END AS src_kc, CASE WHEN k % 3 = 0 THEN k ELSE k + 1 END AS dst_kc FROM kcs WHERE k + 1 IN (SELECT k FROM kcs)"),
    "inf": (("pre",), "SELECT src_kc, dst_kc, support, row_number() OVER (ORDER BY support DESC, src_kc, dst_kc) AS rk FROM pre WHERE fold = 0"),
    "ks": ((), f"SELECT unnest({list(KS)}) AS top_k"),
    "ti": (("inf", "ks"), "SELECT top_k, src_kc, dst_kc FROM inf, ks WHERE rk <= top_k"),
    "tx": (("expert", "ks"), "SELECT top_k, src_kc, dst_kc FROM expert, ks"),
    "dense_item": (("tr",), "SELECT fold, item_id, CAST(row_number() OVER (PARTITION BY fold ORDER BY item_id) - 1 AS BIGINT) AS dense FROM (SELECT DISTINCT fold, item_id FROM tr)"),
    "dense_kc": (("tr",), "SELECT fold, kc_id, CAST(row_number() OVER (PARTITION BY fold ORDER BY kc_id) - 1 AS BIGINT) AS dense FROM (SELECT DISTINCT fold, kc_id FROM tr)"),
}


def overlap(edges: str, held: str) -> str:
    return f"""SELECT fold, avg(CASE WHEN m.src_kc IS NOT NULL OR s.src_kc IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) AS ecr_overlap FROM {edges} e
  LEFT JOIN ({transitions(held, 'fold, ')}) m USING (fold, src_kc, dst_kc)
  LEFT JOIN (SELECT DISTINCT a.fold, a.kc_id AS src_kc, b.kc_id AS dst_kc FROM (SELECT DISTINCT fold, item_id, kc_id FROM {held}) a JOIN (SELECT DISTINCT fold, item_id, kc_id FROM {held}) b ON a.fold = b.fold AND a.item_id = b.item_id AND a.kc_id <> b.kc_id) s USING (fold, src_kc, dst_kc) GROUP BY fold"""


def eoc(edges: str) -> str:
    mean = "SELECT fold, kc_id AS {}, avg(correct) AS {} FROM te GROUP BY ALL"
    return f"""SELECT fold, CASE WHEN count(*) >= 2 AND stddev_pop(weight) > 1e-12 AND stddev_pop((a + b) / 2) > 1e-12 THEN sqrt(2 + 2 * power(corr(weight, (a + b) / 2), 2)) ELSE 0.0::DOUBLE END AS eoc
  FROM {edges} JOIN ({mean.format('src_kc', 'a')}) USING (fold, src_kc) JOIN ({mean.format('dst_kc', 'b')}) USING (fold, dst_kc) GROUP BY fold"""


TBVR = """SELECT fold, avg(CASE WHEN r OR coalesce(pr, false) THEN 1.0::DOUBLE ELSE 0 END) AS tbvr FROM (SELECT *, lag(r) OVER (PARTITION BY fold, user_id ORDER BY i) AS pr FROM (
  SELECT t.*, p.src_kc IS NOT NULL AS r FROM (SELECT fold, user_id, kc_id, lead(kc_id) OVER w AS nx, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY fold, user_id) AS n FROM tr WINDOW w AS (PARTITION BY fold, user_id ORDER BY timestamp, seq)) t
  LEFT JOIN (SELECT DISTINCT fold, src_kc, dst_kc FROM pre) p ON p.fold = t.fold AND p.src_kc = t.kc_id AND p.dst_kc = t.nx)) WHERE i >= floor(0.7::DOUBLE * n) GROUP BY fold"""


def needed(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for name in names:
        for x in [*needed(PARTS[name][0] if name in PARTS else ()), name]:
            if x not in out:
                out.append(x)
    return out


def sql(log: str, parts: str, body: str, recursive: str = "") -> str:
    """The named parts and what they need, over a log, before a query."""
    names = needed(tuple(parts.split()))
    with_ = [f"{n} AS MATERIALIZED ({LOGS[log] if n == 'log' else PARTS[n][1]})" for n in names]
    if recursive:
        with_.append(recursive)
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(with_) + f"\n{body}"


def r6(body: str, columns: str, *rounded: str) -> str:
    """The columns of a query, some to six decimals."""
    names = [f"round({c}, 6) AS {c}" if c in rounded else c for c in columns.split()]
    return f"SELECT {', '.join(names)} FROM ({body})"


EDGE = "fold src_kc dst_kc support weight source"
REACH = "SELECT top_k, src_kc, dst_kc FROM {} WHERE src_kc <> dst_kc UNION SELECT r.top_k, r.src_kc, e.dst_kc FROM {} r JOIN {} e ON r.top_k = e.top_k AND r.dst_kc = e.src_kc"
_RI, _RE = f"ri AS ({REACH.format('ti', 'ri', 'ti')})", f"re AS ({REACH.format('tx', 're', 'tx')})"
REACHED = "SELECT top_k, count(i) AS ni, count(e) AS ne, count(CASE WHEN i = 1 AND e = 1 THEN 1 END) AS hit FROM (SELECT *, 1 AS i FROM ri WHERE src_kc <> dst_kc) FULL JOIN (SELECT *, 1 AS e FROM re WHERE src_kc <> dst_kc) USING (top_k, src_kc, dst_kc) GROUP BY top_k"


def prf(counts: str, name: str) -> str:
    p, r = "coalesce(hit::DOUBLE / nullif(ni, 0), 0)", "coalesce(hit::DOUBLE / nullif(ne, 0), 0)"
    return f"SELECT top_k, ni, ne, {p} AS {name}_precision, {r} AS {name}_recall, coalesce(2 * {p} * {r} / nullif({p} + {r}, 0), 0) AS {name}_f1 FROM ({counts})"


EDGE_HITS = "SELECT top_k, count(i) AS ni, count(e) AS ne, count(CASE WHEN i = 1 AND e = 1 THEN 1 END) AS hit FROM (SELECT *, 1 AS i FROM ti) FULL JOIN (SELECT *, 1 AS e FROM tx) USING (top_k, src_kc, dst_kc) GROUP BY top_k"
_WAYS = "SELECT top_k, least(src_kc, dst_kc) AS a, greatest(src_kc, dst_kc) AS b, bool_or(src_kc < dst_kc) AS up, bool_or(src_kc > dst_kc) AS down FROM {} WHERE src_kc <> dst_kc GROUP BY ALL"
DIRECTION = f"SELECT top_k, count(*) AS n_pairs, avg(CASE WHEN x.up = y.up AND x.down = y.down THEN 1.0::DOUBLE ELSE 0 END) AS direction_agreement FROM ({_WAYS.format('ti')}) x JOIN ({_WAYS.format('tx')}) y USING (top_k, a, b) GROUP BY top_k"
_NODES = "SELECT DISTINCT top_k, unnest([src_kc, dst_kc]) AS kc, 1 AS {} FROM {}"
NODES = f"SELECT top_k, avg(CASE WHEN i = 1 AND e = 1 THEN 1.0::DOUBLE ELSE 0 END) AS node_jaccard FROM ({_NODES.format('i', 'ti')}) FULL JOIN ({_NODES.format('e', 'tx')}) USING (top_k, kc) GROUP BY top_k"

DISAGREE = """SELECT category, rank, src_kc, dst_kc, CASE WHEN src_kc BETWEEN 0 AND 18 AND src_kc % 2 = 0 THEN 'kc ' || src_kc ELSE CAST(src_kc AS VARCHAR) END AS src_name, CASE WHEN dst_kc BETWEEN 0 AND 18 AND dst_kc % 2 = 0 THEN 'kc ' || dst_kc ELSE CAST(dst_kc AS VARCHAR) END AS dst_name, score
FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, src_kc, dst_kc) AS rank FROM (
  SELECT 'inferred_only' AS category, src_kc, dst_kc, support::DOUBLE AS score FROM inf WHERE rk <= 30 AND (src_kc, dst_kc) NOT IN (SELECT (src_kc, dst_kc) FROM expert)
  UNION ALL SELECT 'expert_only', src_kc, dst_kc, (src_kc % 4) / 4.0::DOUBLE FROM expert WHERE (src_kc, dst_kc) NOT IN (SELECT (src_kc, dst_kc) FROM inf WHERE rk <= 30)
  UNION ALL SELECT 'wrong_direction', src_kc, dst_kc, support::DOUBLE FROM inf WHERE rk <= 30 AND (dst_kc, src_kc) IN (SELECT (src_kc, dst_kc) FROM expert) AND (src_kc, dst_kc) NOT IN (SELECT (src_kc, dst_kc) FROM expert))) WHERE rank <= 20"""


def _stats(name: str) -> str:
    nulls = " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in ("user_id", "item_id", "kc_id", "timestamp", "correct"))
    return f"SELECT '{name if name == 'orders' else 'events_' + name}' AS dataset, count(DISTINCT user_id) AS n_learners, count(DISTINCT item_id) AS n_items, count(DISTINCT kc_id) AS n_kcs, count(*) AS n_interactions, {nulls} AS missing_total, round(count(*)::DOUBLE / count(DISTINCT user_id), 6) AS avg_sequence_length FROM ({LOGS[name]})"


def _id(text: str) -> str:
    return f"CAST(concat('0x', substr(md5({text}), 1, 15)) AS BIGINT)"


def _padded(values: str, fill: str = "-1", n: int = 50) -> str:
    return f"array_to_string(list_concat({values}, list_transform(range({n} - len(s)), lambda z: '{fill}')), ',')"


BKT_RIGHT = "(k * 0.8::DOUBLE + (1 - k) * 0.2::DOUBLE)"
#: Beliefs k before each outcome of s, by the parameters 0.25, 0.25, 0.2, 0.2.
BKT_WALK = f"""r AS (SELECT user_id, kc_id, pos, before, y, 0.25::DOUBLE AS k FROM s WHERE pos = 0 UNION ALL
  SELECT s.user_id, s.kc_id, s.pos, s.before, s.y, greatest(least(a + (1 - a) * 0.25::DOUBLE, 1 - 1e-9::DOUBLE), 1e-9::DOUBLE)
  FROM (SELECT *, CASE WHEN y = 1 THEN k * 0.8::DOUBLE / {BKT_RIGHT} ELSE k * 0.2::DOUBLE / (1 - {BKT_RIGHT}) END AS a FROM r) r JOIN s ON s.user_id = r.user_id AND s.kc_id = r.kc_id AND s.pos = r.pos + 1)"""
_GOT = "auc acc nll"
WITHOUT_GRAPH = tuple(m for m in WEIGHTS if m not in GRAPH_MODELS)


def cold(models=tuple(WEIGHTS)) -> str:
    return scores(f"(SELECT * FROM ({blends('ch', models)}) JOIN strata USING (fold, kc_id))", "fold, model, stratum", "1e-15")


def cold_mean(models=tuple(WEIGHTS)) -> str:
    return sql("parts", "ch strata", r6(f"SELECT model, avg(auc) AS auc, avg(acc) AS acc, avg(nll) AS nll, CAST(sum(n) AS BIGINT) AS n FROM ({cold(models)}) GROUP BY model", f"model {_GOT} n", *_GOT.split()))


LEAK = f"SELECT fold, ecr_flag, coalesce(ecr_overlap, 0) AS ecr_overlap, coalesce(eoc, 0) AS eoc, coalesce(tbvr, 0) AS tbvr FROM ecr_flag LEFT JOIN ({overlap('edges', 'ev')}) USING (fold) LEFT JOIN ({eoc('edges')}) USING (fold) LEFT JOIN ({TBVR}) USING (fold)"
_MASK = ("(seq % 3 = 0)", "fold, user_id")
ORACLE_SQL = {
    "log_events_single": LOGS["single"],
    "log_events_multi": LOGS["multi"],
    "log_orders": f"SELECT * EXCLUDE (seq) FROM ({LOGS['orders']})",
    "dataset_stats": " UNION ALL ".join(map(_stats, ("single", "multi", "orders"))),
    "missing_report": f"SELECT {', '.join(f'count(*) FILTER ({c} IS NULL) AS {c}' for c in ('user_id', 'item_id', 'kc_id', 'timestamp', 'correct'))} FROM ({LOGS['orders']})",
    "split_assign": sql("single", "assign", "SELECT fold, user_id, split FROM assign"),
    "split_stats": sql("orders", "tagged", "SELECT fold, split, count(DISTINCT user_id) AS n_learners, count(*) AS n_interactions FROM tagged GROUP BY ALL"),
    "user_overlap": sql("single", "log", "SELECT 0 AS fold, user_id, count(DISTINCT CASE WHEN seq % 3 = 0 THEN 'train' ELSE 'test' END) AS n_splits FROM log GROUP BY ALL HAVING count(DISTINCT CASE WHEN seq % 3 = 0 THEN 'train' ELSE 'test' END) > 1"),
    "temporal_order_violations": sql("single", "log", "SELECT 0 AS fold, user_id FROM log GROUP BY user_id HAVING max(timestamp) FILTER (seq % 3 = 0) > min(timestamp) FILTER (seq % 3 = 1) OR max(timestamp) FILTER (seq % 3 = 1) > min(timestamp) FILTER (seq % 3 = 2)"),
    "train_only_guard": sql("single", "tagged", "SELECT count(DISTINCT fold) = 1 AS one_fold, bool_and(split = 'train') AS train_rows FROM tagged WHERE fold = 1"),
    "q_matrix": sql("multi", "q", "SELECT fold, item_id, kc_id FROM q"),
    "transitions": sql("orders", "cn", "SELECT fold, src_kc, dst_kc, support FROM cn"),
    "e_pre_train": sql("single", "pre", r6("SELECT * FROM pre", EDGE, "weight")),
    "e_pre_orders": sql("orders", "pre", r6("SELECT * FROM pre", EDGE, "weight")),
    "e_pre_capped": sql("single", "pre30", r6("SELECT * FROM pre30", EDGE, "weight")),
    "e_pre_fulllog": sql("single", "pref", r6("SELECT * FROM pref", EDGE[5:], "weight")),
    "e_sim_jaccard": sql("multi", "sim", r6("SELECT * FROM sim", EDGE, "weight")),
    "e_sim_pmi": sql("multi", "q", r6(similarities("q", "fold, ", "train_only", "pmi", -10.0), EDGE, "weight")),
    "e_sim_orders": sql("orders", "qf", r6(similarities("qf", "", "train_only", threshold=0.02), EDGE[5:], "weight")),
    "graph_stats": sql("multi", "pre sim q", "SELECT fold, coalesce(a, 0) AS n_prerequisite_edges, coalesce(b, 0) AS n_similarity_edges, n_kcs FROM (SELECT fold, count(DISTINCT kc_id) AS n_kcs FROM q GROUP BY fold) LEFT JOIN (SELECT fold, count(*) AS a FROM pre GROUP BY fold) USING (fold) LEFT JOIN (SELECT fold, count(*) AS b FROM sim GROUP BY fold) USING (fold)"),
    "ecr_flag": sql("single", "ecr_flag", "SELECT * FROM ecr_flag"),
    "ecr_overlap": sql("orders", "pre3 ev", r6(overlap("pre3", "ev"), "fold ecr_overlap", "ecr_overlap")),
    "eoc": sql("single", "pre te", r6(eoc("pre"), "fold eoc", "eoc")),
    "tbvr": sql("single", "pre tr", r6(TBVR, "fold tbvr", "tbvr")),
    "leakage_row": sql("multi", "edges ecr_flag ev te tr", r6(LEAK, "fold ecr_flag ecr_overlap eoc tbvr", "ecr_overlap", "eoc", "tbvr")),
    "leakage_mean": sql("multi", "edges ecr_flag ev te tr", r6(f"SELECT avg(ecr_flag) AS ecr_flag, avg(ecr_overlap) AS ecr_overlap, avg(eoc) AS eoc, avg(tbvr) AS tbvr FROM ({LEAK})", "ecr_flag ecr_overlap eoc tbvr", "ecr_flag", "ecr_overlap", "eoc", "tbvr")),
    "rates_kc": sql("single", "rate_kc", r6("SELECT * FROM rate_kc", "fold kc_id rate n", "rate")),
    "rates_item": sql("orders", "rate_item", r6("SELECT * FROM rate_item", "fold item_id rate n", "rate")),
    "graph_rates": sql("multi", "graph", r6("SELECT * FROM graph", "fold kc_id rate", "rate")),
    **{f"pred_{m}": sql("single", "ch", r6(blend(m, "ch"), "fold user_id item_id kc_id seq y_true model y_prob", "y_prob")) for m in WEIGHTS},
    "metrics_fold": sql("single", "ch", r6(scores(f"({blends('ch')})", "fold, model"), f"fold model n {_GOT}", *_GOT.split())),
    "metrics_orders": sql("orders", "ch", r6(scores(f"({blends('ch', WITHOUT_GRAPH)})", "fold, model"), f"fold model n {_GOT}", *_GOT.split())),
    "cold_strata": sql("parts", "strata", "SELECT fold, kc_id, n_train_interactions, stratum FROM strata"),
    "strata_metrics": sql("parts", "ch strata", r6(cold(), f"fold model stratum n {_GOT}", *_GOT.split())),
    "cold_start_mean": cold_mean(WITHOUT_GRAPH),
    "model_runs": sql("single", "ch ch3", r6(" UNION ALL ".join(f"SELECT *, '{kind}' AS graph_construction, 'diagnostic' AS status FROM ({scores('(' + blend('gkt', table) + ')', 'fold, model')})" for table, kind in (("ch", "train_only"), ("ch3", "full_log"))), f"fold model n {_GOT} graph_construction status", *_GOT.split())),
    "prediction_sample": sql("single", "ch", r6(f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fold, model ORDER BY user_id, seq, item_id, kc_id) AS r FROM ({blends('ch', WITHOUT_GRAPH)})) WHERE r <= 100", "fold user_id item_id kc_id seq y_true model y_prob", "y_prob")),
    "reported_rows": "SELECT o_orderkey, o_orderpriority AS dataset, 'train_only ' AS graph_construction FROM orders WHERE o_orderkey % 3 = 1 AND o_orderkey % 2 = 0",
    "fold_summary": sql("single", "ch", r6(f"SELECT model, count(DISTINCT fold) AS n_folds, CAST(sum(n) AS BIGINT) AS n_eval, avg(auc) AS auc, avg(acc) AS acc, avg(nll) AS nll FROM ({scores(f'({blends(chr(99) + chr(104))})', 'fold, model')}) GROUP BY model", f"model n_folds n_eval {_GOT}", *_GOT.split())),
    "ablation_delta": sql("single", "ch ch3", r6(f"SELECT model, avg(a.auc) AS auc_train_only, avg(b.auc) AS auc_full_log, avg(a.acc) AS acc_train_only, avg(b.acc) AS acc_full_log, avg(b.auc - a.auc) AS delta_auc, avg(b.acc - a.acc) AS delta_acc FROM ({scores('(' + blends('ch', GRAPH_MODELS) + ')', 'fold, model')}) a JOIN ({scores('(' + blends('ch3', GRAPH_MODELS) + ')', 'fold, model')}) b USING (fold, model) GROUP BY model", "model auc_train_only auc_full_log acc_train_only acc_full_log delta_auc delta_acc", "auc_train_only", "auc_full_log", "acc_train_only", "acc_full_log", "delta_auc", "delta_acc")),
    "labels_auc_by_lang": r6(scores("(SELECT lang, CAST(quality AS BIGINT) AS y_true, round(n_chars / (n_chars + 1000.0::DOUBLE), 9) AS y_prob FROM labels JOIN documents USING (doc_id))", "lang"), f"lang n {_GOT}", *_GOT.split()),
    "dag_degree": sql("single", "pre", "SELECT fold, count(*) AS n_nodes, any_value(n_edges) AS n_edges, count(*) FILTER (i = 0) AS n_roots, count(*) FILTER (o = 0) AS n_leaves FROM (SELECT fold, kc, max(o) AS o, max(i) AS i FROM (SELECT fold, src_kc AS kc, 1 AS o, 0 AS i FROM pre UNION ALL SELECT fold, dst_kc, 0, 1 FROM pre) GROUP BY ALL) JOIN (SELECT fold, count(*) AS n_edges FROM pre GROUP BY fold) USING (fold) GROUP BY fold"),
    **{f"ddr_{k}": sql("single", "pre", r6(ddr(k), "fold augmentation p seed ddr", "ddr")) for k in ("edge_drop", "node_drop", "attr_mask")},
    "ddr_summary": sql("single", "pre", r6(f"SELECT augmentation, p, avg(ddr) AS ddr_mean, coalesce(stddev_samp(ddr), 0) AS ddr_std, count(*) AS n FROM ({' UNION ALL '.join(f'({ddr(k)})' for k in ('edge_drop', 'node_drop', 'attr_mask'))}) GROUP BY ALL", "augmentation p ddr_mean ddr_std n", "ddr_mean", "ddr_std")),
    "gt_align": sql("single", "expert tr", "SELECT src_kc, dst_kc, CASE WHEN a AND b THEN 'matched' WHEN a THEN 'missing_dst' WHEN b THEN 'missing_src' ELSE 'missing_both' END AS status FROM (SELECT *, src_kc IN (SELECT kc_id FROM tr WHERE fold = 0) AS a, dst_kc IN (SELECT kc_id FROM tr WHERE fold = 0) AS b FROM (SELECT * FROM expert UNION ALL VALUES (3, 999), (998, 3), (997, 996)))"),
    "gt_overlap_at_k": sql("single", "ti tx", r6(f"SELECT * EXCLUDE (ni, ne), ni AS n_inferred_truncated, ne AS n_expert_edges FROM ({prf(EDGE_HITS, 'edge')})", "top_k n_inferred_truncated n_expert_edges edge_precision edge_recall edge_f1", "edge_precision", "edge_recall", "edge_f1")),
    "gt_direction": sql("single", "ti tx", r6(DIRECTION, "top_k n_pairs direction_agreement", "direction_agreement")),
    "gt_node_jaccard": sql("single", "ti tx", r6(NODES, "top_k node_jaccard", "node_jaccard")),
    "gt_reachability": sql("single", "ti tx", r6(prf(REACHED, "reachability"), "top_k reachability_precision reachability_recall reachability_f1", "reachability_precision", "reachability_recall", "reachability_f1"), f"{_RI}, {_RE}"),
    "gt_reachable_pairs": sql("single", "pre", "SELECT fold, src_kc, dst_kc FROM rp WHERE src_kc <> dst_kc", "rp AS (SELECT fold, src_kc, dst_kc FROM pre UNION SELECT r.fold, r.src_kc, e.dst_kc FROM rp r JOIN pre e ON r.fold = e.fold AND r.dst_kc = e.src_kc)"),
    "gt_overlap_metrics": sql("single", "ti tx", r6(f"SELECT a.*, a.ni AS n_inferred_truncated, a.ne AS n_expert_edges, coalesce(direction_agreement, 0) AS direction_agreement, reachability_precision, reachability_recall, reachability_f1, node_jaccard FROM ({prf(EDGE_HITS, 'edge')}) a LEFT JOIN ({DIRECTION}) USING (top_k) LEFT JOIN ({prf(REACHED, 'reachability')}) USING (top_k) LEFT JOIN ({NODES}) USING (top_k)", "top_k n_inferred_truncated n_expert_edges edge_precision edge_recall edge_f1 direction_agreement reachability_precision reachability_recall reachability_f1 node_jaccard", "edge_precision", "edge_recall", "edge_f1", "direction_agreement", "reachability_precision", "reachability_recall", "reachability_f1", "node_jaccard"), f"{_RI}, {_RE}"),
    "gt_hits_at_k": sql("single", "ti expert", r6("SELECT top_k AS k, d AS directed_hits, u AS undirected_hits, coalesce(d::DOUBLE / nullif(u, 0), 0) AS directed_precision, coalesce(d::DOUBLE / nullif((SELECT count(*) FROM expert), 0), 0) AS directed_recall FROM (SELECT top_k, count(*) FILTER ((src_kc, dst_kc) IN (SELECT (src_kc, dst_kc) FROM expert)) AS d, count(*) FILTER ((src_kc, dst_kc) IN (SELECT (src_kc, dst_kc) FROM expert UNION SELECT (dst_kc, src_kc) FROM expert)) AS u FROM ti GROUP BY top_k)", "k directed_hits undirected_hits directed_precision directed_recall", "directed_precision", "directed_recall")),
    "gt_disagreement": sql("single", "inf expert", DISAGREE),
    "gt_alignment_report": sql("single", "expert tr", "SELECT count(*) FILTER (a AND b) AS matched, count(*) FILTER (b AND NOT a) AS missing_src, count(*) FILTER (a AND NOT b) AS missing_dst, count(*) FILTER (NOT a AND NOT b) AS missing_both, round(count(*) FILTER (a AND b)::DOUBLE / count(*), 6) AS alignment_rate FROM (SELECT *, src_kc IN (SELECT kc_id FROM tr WHERE fold = 0) AS a, dst_kc IN (SELECT kc_id FROM tr WHERE fold = 0) AS b FROM (SELECT * FROM expert UNION ALL VALUES (3, 999), (998, 3), (997, 996)))"),
    "seq_expand": f"SELECT {_id('CAST(user_id AS VARCHAR)')} AS user_id, {_id('CAST(item_id AS VARCHAR)')} AS item_id, {_id('CAST(kc_id AS VARCHAR)')} AS kc_id, (timestamp // 1000) // 1000 AS timestamp, correct FROM ({LOGS['single']}) WHERE seq % 7 <> 0 AND seq % 5 <> 0",
    "seq_pack": sql("single", "tagged dense_item dense_kc", f"""SELECT fold AS split_fold, CASE split WHEN 'train' THEN 0 WHEN 'valid' THEN 1 ELSE -1 END AS fold, user_id AS uid,
  {_padded("list_transform(s, lambda x: CAST(x.q AS VARCHAR))")} AS questions, {_padded("list_transform(s, lambda x: CAST(x.c AS VARCHAR))")} AS concepts, {_padded("list_transform(s, lambda x: CASE WHEN x.y = 1 THEN '1.0' ELSE '0.0' END)", "0")} AS responses,
  {_padded("list_transform(s, lambda x: '1')", "0")} AS selectmasks, {_padded("list_transform(range(len(s)), lambda x: CAST(x AS VARCHAR))")} AS timestamps
  FROM (SELECT fold, split, user_id, list({{'q': q, 'c': c, 'y': correct}} ORDER BY back DESC) AS s FROM (
    SELECT t.*, i.dense AS q, k.dense AS c, row_number() OVER (PARTITION BY t.fold, t.user_id ORDER BY timestamp DESC, seq DESC) AS back FROM tagged t JOIN dense_item i USING (fold, item_id) JOIN dense_kc k USING (fold, kc_id)) WHERE back <= 50 GROUP BY fold, split, user_id) WHERE len(s) >= 2"""),
    "vocabulary_sizes": sql("single", "tr", "SELECT fold, count(DISTINCT item_id) AS n_questions, count(DISTINCT kc_id) AS n_concepts FROM tr GROUP BY fold"),
    "dense_maps": sql("orders", "dense_item", "SELECT fold, item_id, dense FROM dense_item"),
    "adjacency_norm": sql("single", "pre dense_kc", r6("SELECT fold, i, j, c / sum(c) OVER (PARTITION BY fold, i) AS w FROM (SELECT fold, a.dense AS i, b.dense AS j, count(*)::DOUBLE AS c FROM (SELECT fold, src_kc, dst_kc FROM pre UNION ALL SELECT fold, dst_kc, src_kc FROM pre) JOIN (SELECT fold, kc_id AS src_kc, dense FROM dense_kc) a USING (fold, src_kc) JOIN (SELECT fold, kc_id AS dst_kc, dense FROM dense_kc) b USING (fold, dst_kc) WHERE a.dense <> b.dense GROUP BY ALL)", "fold i j w", "w")),
    "upsert_replace": "SELECT c_mktsegment AS dataset, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN count(*) FILTER (c_acctbal > 0) ELSE count(*) END AS n, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 2 ELSE 1 END AS version FROM customer GROUP BY c_mktsegment",
    "parse_correct": "SELECT o_orderkey, CAST(CASE o_orderkey % 7 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 0 WHEN 6 THEN 1 END AS BIGINT) AS correct FROM orders",
    "parse_timestamp": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE CAST(floor(epoch(o_orderdate)) AS BIGINT) END AS timestamp FROM orders",
    "stable_id_md5": f"SELECT c_name, {_id('c_name')} AS id FROM customer",
    "normalise_raw": f"SELECT {_id('CAST(o_custkey AS VARCHAR)')} AS user_id, {_id('trim(o_orderpriority)')} AS item_id, {_id(chr(67) + 'ASE WHEN o_orderkey % 3 = 0 THEN ' + repr('none') + ' ELSE o_orderstatus END')} AS kc_id, o_orderkey AS timestamp, CAST(o_orderkey % 2 = 0 AS BIGINT) AS correct FROM orders WHERE o_orderkey % 5 <> 0",
    "wide_unpivot": f"SELECT {_id('CAST(c_custkey AS VARCHAR)')} AS user_id, {_id('CAST(pos AS VARCHAR)')} AS item_id, {_id('CAST(pos % 2 AS VARCHAR)')} AS kc_id, CAST(pos AS BIGINT) AS timestamp, CAST(CASE pos WHEN 0 THEN c_custkey % 2 WHEN 1 THEN c_nationkey % 2 ELSE CAST(c_acctbal > 0 AS BIGINT) END AS BIGINT) AS correct FROM customer, (SELECT unnest([0, 1, 2]) AS pos)",
    "audit_rows": sql("single", "pre", "SELECT 'events_single' AS dataset, fold, 'E_pre' AS edge_type, src_kc, dst_kc, 'train' AS source_fold, true AS train_only_flag FROM pre"),
    "bkt_replay": sql("single", "log", f"SELECT user_id, kc_id, pos - before AS pos, y AS y_true, round(CASE WHEN kc_id % 4 = 0 THEN m ELSE {BKT_RIGHT} END, 6) AS y_prob FROM r, (SELECT avg(correct) AS m FROM log WHERE seq % 3 <> 0) WHERE pos >= before", f"""s AS (SELECT user_id, kc_id, correct AS y, CAST(row_number() OVER (PARTITION BY user_id, kc_id ORDER BY seq % 3 = 0, timestamp, seq) - 1 AS INT) AS pos, CAST(count(*) FILTER (seq % 3 <> 0) OVER (PARTITION BY user_id, kc_id) AS INT) AS before FROM log),
{BKT_WALK}"""),
    "bkt_filter": sql("single", "log", f"SELECT user_id, kc_id, pos, y AS y_true, round({BKT_RIGHT}, 6) AS y_prob FROM r", f"""s AS (SELECT user_id, kc_id, correct AS y, CAST(row_number() OVER (PARTITION BY user_id, kc_id ORDER BY timestamp, seq) - 1 AS INT) AS pos, 0 AS before FROM log),
{BKT_WALK}"""),
}
