"""Secret scans over a trigram inverted index.

From each rule's regular expression a Boolean query over lower-cased trigrams is derived: alternatives, each a set of
trigrams that a match cannot do without. The index holds postings (trigram, document) for the trigrams that some
query asks for; intersecting them gives each rule's candidate documents, on which the expression is run. A rule with
an alternative that has no mandatory trigram is run on every document.

Scale: built-in functions only. Postings are pairs of ids and short strings; the rule table is broadcast, its size
being that of the rule set. Texts meet their candidate rules in one join by id, and matching needs no more shuffles.
"""

from __future__ import annotations

import re._constants as kinds_of
import re._parser as regex_tree
from itertools import product
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read, sealed

MOST_STRINGS = 64  # of a query's exact strings before they are turned into trigrams


class Rule(NamedTuple):
    kind: str
    pattern: str
    least: int  # code points of the group
    group: int
    base: bool = False


#: The base kinds first, in the order of the contract. The two runs are stated with their least length,
#: which finds what filtering all runs by length finds: no part of a run that is too short is long enough. An
#: assignment with a short value takes its text from later matches, so there the length is tested afterwards.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 20, 0, True),
    Rule("hex", r"[0-9a-f]{24,}", 24, 0, True),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", 40, 0),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 15, 0),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35}", 39, 0),
    Rule("pay", r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}", 24, 0),
    Rule("signed", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 35, 0),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 27, 0),
)

#: What redaction takes besides a match: of a private key all up to its END line, or the lines of base64 and headers
#: that follow where it has none.
BODIES = {"pem": r"(?:(?:(?!-----(?:BEGIN|END) )[\s\S])*+-----END [A-Z ]{0,40}PRIVATE KEY-----|(?:\s*(?:(?:Proc-Type|DEK-Info): [^\r\n]*+|[A-Za-z0-9+/=]{16,}+|[A-Za-z0-9+/]++={1,2}+)(?=\s|$))*+)"}  # possessive: no stack for long texts

Query = frozenset  # of alternatives, each a frozenset of trigrams; an empty alternative asks for nothing
_ALL: Query = frozenset([frozenset()])


def _all_of(a: Query, b: Query) -> Query:
    both = frozenset(x | y for x, y in product(a, b))
    return both if len(both) <= MOST_STRINGS else max(a, b, key=lambda q: min(map(len, q)))


def _of_strings(strings: set[str]) -> Query:
    return frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _exact(op, arg) -> set[str] | None:
    """The strings that a part of an expression stands for, where they are few."""
    if op is kinds_of.LITERAL:
        return {chr(arg).lower()}
    if op is kinds_of.IN and all(o is kinds_of.LITERAL for o, _ in arg) and len(arg) <= 8:
        return {chr(a).lower() for _, a in arg}
    if op is kinds_of.SUBPATTERN:
        return _exact_sequence(arg[-1])
    if op is kinds_of.BRANCH:
        parts = [_exact_sequence(x) for x in arg[1]]
        return set().union(*parts) if all(p is not None for p in parts) else None
    if op in (kinds_of.MAX_REPEAT, kinds_of.MIN_REPEAT) and arg[1] <= 8:
        inner, out = _exact_sequence(arg[2]), set()
        if inner is None or len(inner) ** arg[1] > MOST_STRINGS:
            return None
        for n in range(arg[0], arg[1] + 1):
            out |= {"".join(x) for x in product(inner, repeat=n)}
        return out
    return None


def _exact_sequence(items) -> set[str] | None:
    out = {""}
    for op, arg in items:
        part = _exact(op, arg)
        if part is None or len(out) * len(part) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in part}
    return out


def _query(items) -> Query:
    out, run = _ALL, {""}
    for op, arg in items:
        part = _exact(op, arg)
        if part is not None and len(run) * len(part) <= MOST_STRINGS:
            run = {a + b for a in run for b in part}
            continue
        out, run = _all_of(out, _of_strings(run)), {""}
        if part is not None:
            run = part
        elif op is kinds_of.SUBPATTERN:
            out = _all_of(out, _query(arg[-1]))
        elif op is kinds_of.BRANCH:
            out = _all_of(out, frozenset().union(*map(_query, arg[1])))
        elif op in (kinds_of.MAX_REPEAT, kinds_of.MIN_REPEAT) and arg[0]:
            out = _all_of(out, _query(arg[2]))
    return _all_of(out, _of_strings(run))


def trigram_query(pattern: str) -> Query:
    """Alternatives of lower-cased trigrams, one of which every match holds in full; one that is empty: scan all."""
    query = _query(regex_tree.parse(pattern))
    return _ALL if frozenset() in query else query


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, kinds): for each key of docs (key, text) the indexed rules that a text of the key may match.

    Null and empty texts hold no trigrams and have no row; rows that repeat a key share one; no rules or rows give none.
    """
    rows = [(rule.kind, at, gram, len(grams)) for rule in rules for at, grams in enumerate(sorted(map(sorted, trigram_query(rule.pattern)))) for gram in grams]
    asked = docs.sparkSession.createDataFrame(rows, "kind string, alternative int, gram string, need int")
    low = F.col("low")
    held = F.array_compact(F.array(*(F.when(F.contains(low, F.lit(g)), F.lit(g)) for g in sorted({r[2] for r in rows})))) if rows else F.array().cast("array<string>")
    postings = docs.select("key", F.lower("text").alias("low")).select("key", F.explode(held).alias("gram"))
    met = postings.join(F.broadcast(asked), "gram").groupBy("key", "kind", "alternative").agg(F.count_distinct("gram").alias("have"), F.first("need").alias("need"))
    return met.where("have = need").groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def _with_spans(df: DataFrame, rule: Rule, at: int, wanted: Column) -> DataFrame:
    """Adds spans_<kind>: structs of start, at, end (code points, end exclusive) of the leftmost matches.

    Offsets are running sums of the lengths between and of the matches, kept for every root-th match.
    """
    none = F.array().cast("array<string>")
    text, m, p, add, step, ends = F.col("text"), *(F.col(f"{x}_") for x in ("match", "piece", "add", "step", "ends"))
    df = df.withColumn("match_", F.when(wanted, F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))).otherwise(none))
    df = df.withColumn("piece_", F.when(F.size(m) > 0, F.split(text, rule.pattern, -1)).otherwise(none))
    if rule.group:
        df = df.withColumn("held_", F.when(F.size(m) > 0, F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))).otherwise(none))
    else:
        df = df.withColumn("held_", m)
    empty = F.array().cast("array<bigint>")
    until = lambda a, b: F.when(b >= a, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
    total = lambda array, a, b: F.aggregate(until(a, b), F.lit(0).cast("long"), lambda s, j: s + F.get(array, j))
    df = df.withColumn("add_", F.transform(m, lambda x, i: (F.length(x) + F.length(F.get(p, i))).cast("long")))
    df = df.withColumn("step_", F.ceil(F.sqrt(F.size(m))).cast("int"))
    df = df.withColumn("sums_", F.when(F.size(m) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(m) - 1) / step).cast("int")), lambda c: total(add, c * step, F.least(c * step + step, F.size(add)) - 1))).otherwise(empty))
    df = df.withColumn("ends_", F.transform("sums_", lambda x, c: total(F.col("sums_"), F.lit(0), c - 1)))

    def span(x: Column, i: Column) -> Column:
        chunk = F.floor(i / step).cast("int")
        start = F.get(ends, chunk) + total(add, chunk * step, i - 1) + F.length(F.get(p, i))
        return F.struct(start.alias("start"), F.lit(at).alias("at"), (start + F.length(x)).alias("end"))

    spans = F.filter(F.transform(m, span), lambda x, i: F.length(F.get(F.col("held_"), i)) >= rule.least)
    return df.withColumn(f"spans_{rule.kind}", F.when(F.size(m) > 0, spans).otherwise(F.array().cast("array<struct<start:bigint,at:int,end:bigint>>"))).drop("match_", "piece_", "held_", "add_", "step_", "sums_", "ends_")


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, spans_<kind> of each rule, and the columns of keep, one row per input row.

    Spans are the leftmost non-overlapping matches of a rule over the whole text whose group is long enough. A null
    text counts as empty. Null and repeated ids are matched each by its own text. Other columns are ignored,
    whatever their names; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.struct(F.lit(0).alias("_"), *keep).alias("keep_"))
    indexed = tuple(r for r in rules if trigram_query(r.pattern) != _ALL)
    rows = rows.withColumn("key", F.coalesce(F.col("doc_id").cast("string"), F.md5(F.col("text").cast("binary"))))  # null ids are dealt out by text
    df = rows.join(candidates(rows, indexed), "key", "left")
    for at, rule in enumerate(rules):
        wanted = F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False)) if rule in indexed else F.lit(True)
        df = _with_spans(df, rule, at, wanted)
    return sealed(df.select("doc_id", "text", *(f"spans_{r.kind}" for r in rules), *(F.col("keep_")[c].alias(c) for c in keep)))


def joined_spans(rules: tuple[Rule, ...], base: bool) -> Column:
    """kind:start:end of the spans by start, then by the order of the rules, joined by commas."""
    names = F.array(*(F.lit(r.kind) for r in rules))
    own = F.sort_array(F.flatten(F.array(*(F.col(f"spans_{r.kind}") for r in rules if r.base or not base))))
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", F.get(names, s["at"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The result of find_secrets with what its rules match in text replaced by the rule's name in brackets, rule after rule.

    Texts without spans, empty ones too, stay as they are; rows may repeat; no rows give none.
    Rules of BODIES come first, as others would break up what follows their matches.
    """
    for rule in sorted(rules, key=lambda r: r.kind not in BODIES):
        long_enough = rule.pattern.replace("-]+)", f"-]{{{rule.least},}})") if rule.group else rule.pattern
        found = found.withColumn("text", F.when(F.size(f"spans_{rule.kind}") > 0, F.regexp_replace("text", long_enough + BODIES.get(rule.kind, ""), f"[{rule.kind}]")).otherwise(F.col("text")))
    return found


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(read(spark, sf_dir, "documents"))
    n = lambda kind: F.size(f"spans_{kind}").cast("long").alias(f"n_{kind}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined_spans(RULES, True).cast("binary"), 256).alias("base_sha256"), joined_spans(RULES, False).alias("spans"))


def _oracle() -> str:
    """The same spans by splitting each text at a rule's matches and summing lengths."""
    parts = []
    for at, rule in enumerate(RULES):
        rx = rule.pattern.replace("'", "''")
        parts.append(f"""SELECT n, {at} AS pos, '{rule.kind}' AS kind, {str(rule.base).lower()} AS base, unnest(list_filter(list_transform(range(1, len(m) + 1), lambda i: {{'s': list_sum(list_transform(p[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0), 'e': len(m[i]), 'g': len(g[i])}}), lambda x: x.g >= {rule.least})) AS x
  FROM (SELECT n, regexp_extract_all(text, '{rx}') AS m, regexp_extract_all(text, '{rx}', {rule.group}) AS g, regexp_split_to_array(text, '{rx}') AS p FROM d WHERE regexp_matches(text, '{rx}'))""")
    n = lambda kind: f"count(*) FILTER (kind = '{kind}') AS n_{kind}"
    text = "kind || ':' || CAST(CAST(x.s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(x.s + x.e AS BIGINT) AS VARCHAR)"
    return f"""WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
s AS ({" UNION ALL ".join(parts)}),
a AS (SELECT n, {n('assign')}, {n('access')}, {n('hex')}, string_agg({text}, ',' ORDER BY x.s, pos) FILTER (base) AS b, string_agg({text}, ',' ORDER BY x.s, pos) AS spans FROM s GROUP BY n)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (n)"""


OP8_SQL = _oracle()
