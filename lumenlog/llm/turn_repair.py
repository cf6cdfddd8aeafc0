"""Repair of conversations: the cheapest edits after which roles read `(s?(ua)+)?` by their initials.

A forward Viterbi pass over the turns of each conversation carries, for each of four grammar states (nothing yet, after s,
after u, after a), the least (cost, audit string); a layer is a turn, closed by at most two inserts, since no state is
further from another. A running digest of the repaired turns goes along with each state.

A conversation is streamed in the order of its turns and never gathered: rows are dealt by conversation, sorted (on disk
where they must be) and walked in batches. What a state holds is bounded but for its audit, a letter an edit,
which is part of the result: of two audits only their order and the few inserts by which one goes beyond the other are
kept, which later edits cannot change otherwise, and the letters are shared between states in pieces.
The digest of a whole conversation can only be computed along it, so its rows meet in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import crc32_sql, read

DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: The states that each next role may follow.
BEFORE = {"s": (START,), "u": (START, SYSTEM, ASSISTANT), "a": (USER,)}
AFTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
NAMES = {"u": "user", "a": "assistant"}
PIECE = 4096  # letters of an audit that are copied when one is added
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
ROW = ("conv_id", "turn", "role", "text", "gone", "blank", "duplicate", "truncated")


class Path:
    """A state's best edits: cost, (rank, rest) that order its audit among the states', the audit in pieces, the digest."""

    __slots__ = ("cost", "rank", "rest", "pieces", "tail", "digest")

    def __init__(self, cost, rank, rest, pieces, tail, digest):
        self.cost, self.rank, self.rest, self.pieces, self.tail, self.digest = cost, rank, rest, pieces, tail, digest

    def key(self) -> tuple[int, int, str]:
        return self.cost, self.rank, self.rest

    def audit(self) -> str:
        out, pieces = [self.tail], self.pieces
        while pieces:
            pieces, piece = pieces
            out.append(piece)
        return "".join(reversed(out))


def stepped(path: Path, edit: str, cost: int, said: str | None, first: bool) -> Path:
    """The path after one more edit, which leaves the turn `said`, if any."""
    pieces, tail = ((path.pieces, path.tail), "") if len(path.tail) >= PIECE else (path.pieces, path.tail)
    digest = path.digest
    if said is not None:
        digest = digest.copy()
        digest.update((said if first else "\n" + said).encode())
    return Path(path.cost + cost, path.rank, path.rest + edit, pieces, tail + edit, digest)


def closed(paths: list[Path | None]) -> list[Path | None]:
    """A layer after its inserts; ranks are made anew.

    Audits of different ranks differ at a letter that both have, so whatever follows leaves their order; those of one rank
    begin alike and go on with their rests.
    """
    for _ in range(2):
        for initial in ("u", "a"):
            for state in BEFORE[initial]:
                path, to = paths[state], AFTER[initial]
                if path and (not paths[to] or (path.cost + INSERT, path.rank, path.rest + "I") < paths[to].key()):
                    paths[to] = stepped(path, "I", INSERT, NAMES[initial] + ":", state == START)
    rank, stem, was = -1, None, None
    for path in sorted((p for p in paths if p), key=lambda p: (p.rank, p.rest)):
        if path.rank != was or not path.rest.startswith(stem):
            rank, stem, was = rank + 1, path.rest, path.rank
        path.rank, path.rest = rank, path.rest[len(stem) :]
    return paths


def begun() -> list[Path | None]:
    return closed([Path(0, 0, "", None, "", hashlib.sha256()), None, None, None])


def advanced(paths: list[Path | None], role: str, text: str, faulty: bool, truncated: bool) -> list[Path | None]:
    """The layer after one turn. faulty turns can only be deleted, truncated ones cost more when they stay."""
    moves: list[list[tuple]] = [[], [], [], []]
    for state, path in enumerate(paths):
        if path:
            moves[state].append((path.cost + DELETE, path.rank, path.rest + "D", state, None))
            if not faulty:
                more, initial = TRUNCATED * truncated, role[:1]
                if state in BEFORE.get(initial, ()):
                    moves[AFTER[initial]].append((path.cost + more, path.rank, path.rest + "K", state, role))
                to = "a" if state == USER else "u"
                moves[AFTER[to]].append((path.cost + REROLE + more, path.rank, path.rest + "R", state, NAMES[to]))
    out: list[Path | None] = [None] * 4
    for state, options in enumerate(moves):
        if options:
            cost, _, rest, source, said = min(options, key=lambda m: m[:3])
            path = paths[source]
            out[state] = stepped(path, rest[-1], cost - path.cost, None if said is None else f"{said}:{text}", source == START)
    return closed(out)


class Conversation:
    """What is known of a conversation while its turns pass by in order."""

    def __init__(self) -> None:
        self.paths, self.initial = begun(), None
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = None

    def add(self, turn: int | None, role: str, text: str, blank: bool, duplicate: bool, truncated: bool) -> None:
        if turn is not None and turn != self.last:
            self.first = turn if self.turns == 0 else self.first
            self.last, self.turns = turn, self.turns + 1
        duplicate, truncated = duplicate and not blank, truncated and not blank and not duplicate
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in ("su", "ua", "au")
        self.initial = role[:1]
        self.paths = advanced(self.paths, role, text, blank or duplicate, truncated)

    def result(self) -> tuple:
        best = min((self.paths[s] for s in (START, ASSISTANT) if self.paths[s]), key=Path.key)
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, best.cost, best.audit(), best.digest.hexdigest()


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a conversation from rows in order, of which those that are gone only say that it exists."""
    now, walk, done = None, None, []

    def flushed() -> pa.RecordBatch:
        columns = list(zip(*done))
        kinds = [pa.int64()] * 7 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in RESULT.split(", ")])

    for batch in batches:
        for conv, turn, role, text, gone, *faults in zip(*(batch.column(c).to_pylist() for c in ROW)):
            if walk is None or conv != now:
                if walk:
                    done.append((now, *walk.result()))
                now, walk = conv, Conversation()
            if not gone:
                walk.add(turn, role, text, *faults)
        if done:
            yield flushed()
            done = []
    if walk:
        done.append((now, *walk.result()))
        yield flushed()


def with_faults(turns: DataFrame) -> DataFrame:
    """Adds blank (no character but white space), duplicate (role and text were seen earlier) and truncated (does not end in . ! or ?).

    turns has conv_id, turn, role, text (not null) and gone; rows are dealt by conversation.
    """
    last = F.substring(F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    same = Window.partitionBy("conv_id", "role", "text", "gone").orderBy(F.asc_nulls_first("turn"))
    dealt = turns.repartition("conv_id").withColumn("duplicate", F.row_number().over(same) > 1)
    return dealt.withColumn("blank", last == "").withColumn("truncated", ~last.isin("", ".", "!", "?"))


def repair(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation.

    turns: conv_id, turn, role, text and, where rows may only stand for their conversation, gone. Null roles and texts are one
    space. Turns are taken by turn (null first), ties by role and text, bytewise; equal rows are repeats. A null
    conv_id is a conversation, a turn with an empty role cannot be kept as it is. Other columns are ignored; an empty table gives no rows, a conversation all of whose rows
    are gone zeros, an empty audit and the digest of nothing.
    """
    rows = turns if "gone" in turns.columns else turns.withColumn("gone", F.lit(False))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = with_faults(rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), text("role"), text("text"), "gone"))
    return rows.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text").select(*ROW).mapInArrow(_walked, RESULT)


def repaired_turns(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the turns that the audits of repair leave, in order of place.

    Roles alternate from the first user on, so an inserted or changed role follows from its place. Null roles and texts
    are one space, a null conv_id is a conversation.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    line = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    rows = turns.select("conv_id", "turn", text("role"), text("text")).select(F.col("conv_id").alias("of_"), F.row_number().over(line).alias("nth_"), "role", "text")
    edits = audits.select("conv_id", F.posexplode(F.split("audit", "")).alias("at_", "edit")).where("edit <> ''")
    order = Window.partitionBy("conv_id").orderBy("at_")
    edits = edits.withColumn("nth_", F.count_if(F.col("edit") != "I").over(order)).withColumn("place", F.count_if(F.col("edit") != "D").over(order))
    own = (F.col("edit") != "I") & F.col("conv_id").eqNullSafe(F.col("of_")) & (edits["nth_"] == rows["nth_"])
    kept = edits.where("edit <> 'D'").join(rows, own, "left").drop("nth_", "of_")
    system = F.max(F.when((F.col("place") == 1) & (F.col("edit") == "K") & F.col("role").startswith("s"), 1).otherwise(0)).over(Window.partitionBy("conv_id"))
    role = F.when(F.col("edit") == "K", F.col("role")).when((F.col("place") - system) % 2 == 1, "user").otherwise("assistant")
    return kept.select("conv_id", "place", "edit", role.alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns with faults by crc32(conv_id:turn) % 20: 0 gone, 1 without text, 2 without [.!?], 3 twice, 4 said by the user. Nulls are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(draw == 1, "").when(draw == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    times = F.explode(F.array_repeat(F.lit(1), F.when(draw == 3, 2).otherwise(1)))
    return conversations.select("conv_id", "turn", F.when(draw == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), (draw == 0).alias("gone"), times.alias("times_"))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(read(spark, sf_dir, "conversations")))


def _sql_layers() -> tuple[str, str, str]:
    """SQL of one turn's layer and its inserts from p0 .. p3, structures (c, a, t) of cost, audit and repaired turns."""
    best = lambda *options: f"list_sort(list_filter([{', '.join(options)}], lambda o: o IS NOT NULL))[1]"
    said = lambda x, first, role, text: f"concat({x}.t, {'' if first else 'chr(10), '}{role}, ':', {text})"
    step = lambda x, edit, cost, t, when="true": f"CASE WHEN {x} IS NOT NULL AND {when} THEN {{'c': {x}.c + {cost}, 'a': concat({x}.a, '{edit}'), 't': {t}}} END"
    stays = "NOT faulty"

    def moves(state: int) -> list[str]:
        initial = {SYSTEM: "s", USER: "u", ASSISTANT: "a"}.get(state)
        out = [step(f"p{state}", "D", DELETE, f"p{state}.t")]
        for before in BEFORE.get(initial, ()):
            x = f"p{before}"
            out.append(step(x, "K", "more", said(x, before == START, "role", "text"), f"{stays} AND substr(role, 1, 1) = '{initial}'"))
            if initial != "s":
                out.append(step(x, "R", f"{REROLE} + more", said(x, before == START, f"'{NAMES[initial]}'", "text"), stays))
        return out

    insert = lambda x, first, role: step(x, "I", INSERT, said(x, first, f"'{role}'", "''"))
    layer = ", ".join(f"{best(*moves(k))} AS n{k}" for k in range(4))
    once = f"n0, n1, {best('n2', insert('n0', True, 'user'), insert('n1', False, 'user'), insert('n3', False, 'user'))} AS n2, n3"
    return layer, once, best("n3", insert("n2", False, "assistant"))


_LAYER, _ONCE, _TWICE = _sql_layers()
_NONE = "CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR))"
_DRAW = crc32_sql("concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' '))")
_LAST = r"regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1)"
OP11_SQL = f"""
WITH RECURSIVE drawn AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_DRAW} % 20 AS d FROM conversations),
hurt AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy FROM drawn WHERE d <> 0),
lined AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM hurt),
seen AS (SELECT *, {_LAST} AS z, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, concat(substr(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1, 1), substr(role, 1, 1)) AS pair FROM lined),
marked AS (SELECT *, z = '' AS blank, again AND z <> '' AS duplicate, z NOT IN ('', '.', '!', '?') AND NOT again AS truncated FROM seen),
turns AS (SELECT *, blank OR duplicate AS faulty, CASE WHEN truncated THEN {TRUNCATED} ELSE 0 END AS more FROM marked),
ids AS (SELECT DISTINCT conv_id FROM conversations),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'a': '', 't': ''}} AS p0, {_NONE} AS p1, {{'c': CAST({INSERT} AS BIGINT), 'a': 'I', 't': 'user:'}} AS p2, {{'c': CAST({2 * INSERT} AS BIGINT), 'a': 'II', 't': concat('user:', chr(10), 'assistant:')}} AS p3 FROM ids
  UNION ALL SELECT conv_id, i, n0, n1, n2, {_TWICE} FROM (SELECT conv_id, i, {_ONCE} FROM (
    SELECT w.conv_id, r.i, {_LAYER} FROM walk w JOIN turns r ON w.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = w.i + 1))),
ends AS (SELECT conv_id, list_sort(list_filter([p0, p3], lambda o: o IS NOT NULL))[1] AS e FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS r FROM walk) WHERE r = 1),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
  count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY conv_id)
SELECT x.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  e.c AS cost, e.a AS audit, sha256(e.t) AS repaired_sha256
FROM ends x LEFT JOIN counts k ON x.conv_id IS NOT DISTINCT FROM k.conv_id
"""
