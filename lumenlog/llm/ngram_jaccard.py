"""N-gram Jaccard join over a token-group matrix.

Documents become sets of word shingles (tokens). Documents with equal sets form a class and only the class's smallest
id goes on. All tokens are put in one order, the corpus's commonest last, and a set's prefix is so long that two linked
sets share at least SHARED tokens of their prefixes. Similar documents are partitioned into groups: a token's anchor
is the smallest id that has it in its prefix, and a document joins the anchor that most of its prefix points to. The
token-group matrix holds the union of the members' prefixes; a document whose overlap with a group's union is below
what a link needs is not compared with that group. The others are sent to the group, where the overlap with the union
of the whole sets is bounded in the same way before the members are opened. Results are exact: no link is lost and
no cap is set; which tokens count as common only changes the cost.

Scale: the corpus-wide shuffles are of the classes' prefix tokens with ids; a token's least and largest id and its count
are aggregated before they meet its rows, so a token that many sets share is summed up first and joined after. Blocks
hold at most BLOCK_DOCS documents or BLOCK_TOKENS tokens; a group of any size is spread over blocks that share its most
central document, and what that document does not tie together is checked against the other blocks. The common tokens
that are broadcast number COMMON at most. Shuffle files go when the table made from them is written, and a table of
tokens when the next one is. Two parts still grow faster than the input where many sets differ but share tokens that
their prefixes cannot avoid: (document, group) rows of such a token, and loose documents times blocks of one group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import components, forget, read, stage

SHARED = 16
COMMON = 1 << 19
COUNTED = 1 << 21  # tokens that a task counts at once
BLOCK_DOCS = 1024
BLOCK_TOKENS = 500_000
SLAB_BYTES = 1 << 18
DEALT_BYTES = 1 << 24  # of the sets that a batch of dealt rows holds

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so invertible modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += _U(32)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: xor-shifts and odd multipliers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers


def _word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of a slab of texts laid end to end, and the number of words before each text."""
    space = _IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    edge[-1] = True
    before = np.empty(len(data), bool)
    before[1:] = space[:-1]
    before[:1] = True
    after = np.empty(len(data), bool)
    after[:-1] = space[1:]
    after[-1:] = True
    first = np.flatnonzero(~space & (before | edge[:-1]))
    last = np.flatnonzero(~space & (after | edge[1:])) + 1
    up, down = _powers_to(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER[data] + _U(1)) * up[: len(data)], out=total[1:])
    words = _mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64))
    return words, np.searchsorted(first, starts)


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its width-word shingles (one for a shorter text, none for no words)."""
    for at in range(0, len(texts), 500):
        yield from _shingle_sets(texts.slice(at, 500), width)


def _shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    texts = texts.cast(pa.large_string()).fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, places, content = texts.buffers()
    offsets = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(content, np.uint8) if content is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLAB_BYTES, "right")) - 1)
        to = min(to, len(texts))
        slab = data[offsets[at] : offsets[to]]
        starts = offsets[at:to] - offsets[at]
        if len(slab):
            words, cuts = _word_hashes(slab, starts)
        else:
            words, cuts = np.zeros(0, np.uint64), np.zeros(to - at, np.int64)
        cuts = np.append(cuts, len(words))
        whole = np.full(max(0, len(words) - width + 1), width, np.uint64)
        for j in range(width):
            whole = _mix(whole ^ words[j : j + len(whole)]) + _U(j)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if b - a >= width:
                yield np.unique(whole[a : b - width + 1])
            elif b > a:
                one = np.full(1, b - a, np.uint64)
                for j in range(b - a):
                    one = _mix(one ^ words[a + j : a + j + 1]) + _U(j)
                yield one
            else:
                yield np.zeros(0, np.uint64)
        at = to


def prefix(u: np.ndarray, common: np.ndarray, num: int, den: int) -> np.ndarray:
    """The first tokens of a set in the global order: any two linked sets share min(SHARED, needed) of theirs.

    A link needs an overlap of o = ceil(num / den * size) with either set; the first tokens in common then lie within
    the first size - o + SHARED of both.
    """
    o = -(-num * len(u) // den)
    most = len(u) - o + min(SHARED, o)
    if len(common):
        at = np.minimum(np.searchsorted(common, u), len(common) - 1)
        late = common[at] == u
        u = np.concatenate([u[~late], u[late]])
    return u[:most]


def needed(n: Column, num: int, den: int) -> Column:
    """Prefix tokens that a set of n tokens shares with every set that it is linked with, the smallest such set's too."""
    smallest = F.ceil(n * num / den)
    return F.least(F.lit(SHARED), F.ceil(smallest * num / den))


def digests(u: np.ndarray) -> tuple[int, int]:
    """Two 64-bit digests of a set."""
    sums = np.add.reduce(_mix(u)), np.bitwise_xor.reduce(_mix(u ^ _U(0xD1342543DE82EF95)))
    return tuple(int(x.astype(np.uint64).view(np.int64)) for x in sums)


def _profiles(width: int):
    """Rows of each document (n, two digests of its set), and rows without one: n -1, a token, and how many sets have it.

    A token is told for every COUNTED tokens of a task in which two sets have it.
    """
    names = ["doc_id", "n", "k1", "k2"]

    def told(held: list[np.ndarray]) -> pa.RecordBatch:
        tokens, counts = np.unique(np.concatenate(held), return_counts=True)
        tokens, counts = tokens[counts > 1], counts[counts > 1]
        return pa.RecordBatch.from_arrays([pa.nulls(len(tokens), pa.int64()), pa.array(np.full(len(tokens), -1)), pa.array(tokens.view(np.int64)), pa.array(counts.astype(np.int64))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            n, k1, k2 = [], [], []
            for u in shingle_sets(batch.column(1), width):
                n.append(len(u))
                for k, d in zip((k1, k2), digests(u)):
                    k.append(d)
                held.append(u)
                size += len(u)
                if size >= COUNTED:
                    yield told(held)
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(k, pa.int64()) for k in (n, k1, k2))], names)
        if held:
            yield told(held)

    return run


def _prefixed(shared, width: int, num: int, den: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    common = shared.value
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            sets = list(shingle_sets(part.column(1), width))
            own = [prefix(u, common, num, den) for u in sets]
            ends, keys = np.cumsum([0, *map(len, own)]), np.array([digests(u) for u in sets], np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(own).view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys[:, 0]), pa.array(keys[:, 1]), lists], ["doc_id", "k1", "k2", "tokens"])


def common_tokens(counts: DataFrame) -> np.ndarray:
    """At most COMMON of the commonest tokens of (token, n), those from some power of two upwards, in order."""
    sizes = counts.groupBy(F.floor(F.log2("n")).alias("power")).agg(F.count("*").alias("tokens")).orderBy(F.desc("power")).collect()  # 63 rows at most
    total, least = 0, None
    for power, tokens in sizes:
        total += tokens
        if total > COMMON:
            break
        least = power
    if least is None:
        return np.zeros(0, np.uint64)
    rows = counts.where(F.col("n") >= 2**least).select("token").toArrow().column(0)  # eight bytes a token on the driver
    return np.sort(rows.to_numpy().view(np.uint64))


def _dealt(width: int):
    """A row with the document's set for each place it goes to: (class, text, places, k1, k2), of rows of one id only those with these digests."""
    names = ["grp", "block", "chunk", "role", "blocks", "doc_id", "tokens"]

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]

    def told(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                rows, size = [], 0
                for doc, places, *keys, u in zip(*(part.column(k).to_pylist() for k in (0, 2, 3, 4)), shingle_sets(part.column(1), width)):
                    if digests(u) != tuple(keys):
                        continue
                    packed = u.tobytes()
                    for place in places:
                        rows.append((*(place[k] for k in names[:5]), doc, packed))
                        size += len(packed)
                        if size >= DEALT_BYTES:  # a centre goes to every block of its group
                            yield told(rows)
                            rows, size = [], 0
                yield told(rows)

    return run


class _Block:
    """Members of a block: their tokens, postings, star groups with token unions, and a union-find over links."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int):
        self.num, self.den, self.m = num, den, len(sets)
        self.sizes = np.array([len(x) for x in sets], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.union, self.ids = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(self.ids, kind="stable")
        self.owner = np.repeat(np.arange(self.m), self.sizes)[order]
        self.at = np.concatenate([[0], np.cumsum(np.bincount(self.ids, minlength=len(self.union)))])
        self.root = list(range(self.m))

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def tokens(self, i: int) -> np.ndarray:
        return self.ids[self.starts[i] : self.starts[i + 1]]

    def links(self, ids: np.ndarray, size: int) -> np.ndarray:
        """Members linked with a set of the given size whose known tokens are ids."""
        lo, n = self.at[ids], self.at[ids + 1] - self.at[ids]
        spots = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        both = np.bincount(self.owner[spots], minlength=self.m)
        return np.flatnonzero(self.den * both >= self.num * (size + self.sizes - both))

    def least(self, size):
        """The smallest overlap with a group's union that leaves room for a link."""
        return -(-self.num * size // self.den)

    def close(self) -> None:
        star = np.full(self.m, -1)
        for i in range(self.m):
            if star[i] < 0:
                near = self.links(self.tokens(i), int(self.sizes[i]))
                star[i] = i
                star[near[star[near] < 0]] = i
                for j in near.tolist():
                    self.root[self.find(j)] = self.find(i)
        hubs = star == np.arange(self.m)
        need = self.least(self.sizes)
        for hub in np.unique(star[~hubs]).tolist():
            roots = np.array([self.find(i) for i in range(self.m)])
            others = np.flatnonzero(~hubs & (roots != roots[hub]))
            if not len(others):
                continue
            held = np.zeros(len(self.union), bool)
            for j in np.flatnonzero(star == hub).tolist():
                held[self.tokens(j)] = True
            bound = np.add.reduceat(held[self.ids].astype(np.int64), self.starts[:-1])
            for i in others[bound[others] >= need[others]].tolist():
                if self.find(i) != self.find(hub):
                    for j in self.links(self.tokens(i), int(self.sizes[i])).tolist():
                        self.root[self.find(j)] = self.find(i)

    def probe(self, u: np.ndarray) -> np.ndarray:
        spot = np.minimum(np.searchsorted(self.union, u), len(self.union) - 1)
        ids = spot[self.union[spot] == u]
        if len(ids) < self.least(len(u)):
            return ids[:0]
        return self.links(ids, len(u))


def _opened(num: int, den: int):
    """Edges of a block (kind 0: a and b are connected) and what its centre leaves loose (kind 1: document a of group b)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["role", "doc_id"], kind="stable")
        sets = [np.frombuffer(x, np.uint64) for x in pdf["tokens"]]
        roles, docs, chunk, grp = pdf["role"].to_numpy(), pdf["doc_id"].to_numpy(), pdf["chunk"].iloc[0], pdf["grp"].iloc[0]
        m = int((roles < 2).sum())
        out: list[tuple[int, int, int]] = []
        if m:
            block = _Block(sets[:m], num, den)
            block.close()
            roots = [block.find(i) for i in range(m)]
            low: dict[int, int] = {}
            for i, r in enumerate(roots):
                low[r] = min(low.get(r, docs[i]), docs[i])
            if chunk == 0:
                out += [(0, docs[i], low[r]) for i, r in enumerate(roots) if docs[i] != low[r]]
                if pdf["blocks"].iloc[0] > 1:
                    out += [(1, docs[i], grp) for i, r in enumerate(roots) if roles[0] != 0 or r != roots[0]]
            for i in range(m, len(sets)):
                out += [(0, docs[i], x) for x in {low[roots[j]] for j in block.probe(sets[i]).tolist()} if x != docs[i]]
        return pd.DataFrame(out, columns=["kind", "a", "b"]).astype("int64")

    return run


def _open(texts: DataFrame, classes: DataFrame, members: DataFrame, queries: DataFrame, width: int, num: int, den: int, name: str) -> DataFrame:
    """members: doc_id, grp, block, blocks, role (0 the centre, 1 others); queries: doc_id, grp, block."""
    chunks = queries.groupBy("grp", "block").agg(F.ceil(F.count("*") / F.lit(BLOCK_DOCS)).alias("chunks"))
    places = members.join(chunks, ["grp", "block"], "left").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("chunks", F.lit(1)).cast("long") - 1))).select("doc_id", "grp", "block", "chunk", "role", "blocks")
    asked = queries.join(chunks, ["grp", "block"]).select("doc_id", "grp", "block", F.pmod(F.xxhash64("doc_id"), "chunks").alias("chunk"), F.lit(2).alias("role"), F.lit(1).cast("long").alias("blocks"))
    to = places.union(asked).groupBy("doc_id").agg(F.collect_list(F.struct("grp", "block", "chunk", "role", "blocks")).alias("places"))
    to = to.join(classes.select(F.col("node").alias("doc_id"), "rep", "k1", "k2"), "doc_id").withColumnRenamed("doc_id", "node")
    dealt = texts.join(to, texts.doc_id == to.rep).select("node", "text", "places", "k1", "k2").mapInArrow(_dealt(width), "grp long, block long, chunk long, role int, blocks long, doc_id long, tokens binary")
    return stage(dealt.groupBy("grp", "block", "chunk").applyInPandas(_opened(num, den), "kind long, a long, b long"), name, clean=True)


def jaccard_components(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of the graph that links documents when den * |A and B| >= num * |A or B| over their shingle sets.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased; a set holds the distinct shingles of
    `shingle` words, the whole sequence for fewer words. Returns (doc_id, n_shingles, component_id): one row per
    input row. Null, empty and blank texts have n_shingles 0 and link with nothing. A null id keeps its row with
    its n_shingles and a null component. Rows that repeat an id are compared each by its own text and placed each in
    its own component, whose id is the smallest of its rows'. Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    both = stage(texts.mapInArrow(_profiles(shingle), "doc_id long, n long, k1 long, k2 long"), "profiles")
    base = both.where("n >= 0")
    classes = base.where("n > 0 and doc_id is not null").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep"))
    classes = stage(classes.withColumn("node", F.monotonically_increasing_id()), "classes", narrow=True, clean=True)  # an id may stand for several classes
    common = common_tokens(both.where("n < 0").groupBy(F.col("k1").alias("token")).agg(F.sum("k2").alias("n")))

    shared = docs.sparkSession.sparkContext.broadcast(common)
    rows = texts.where("doc_id is not null").mapInArrow(partial(_prefixed, shared, shingle, num, den), "doc_id long, k1 long, k2 long, tokens array<long>")
    # one document a class goes on, before its tokens are dealt out; from here to the links doc_id is the class's number
    own = classes.select(F.col("rep").alias("doc_id"), "k1", "k2", "node")
    rows = rows.join(own, ["doc_id", "k1", "k2"]).select(F.col("node").alias("doc_id"), F.explode("tokens").alias("token"))
    rows = stage(rows, "prefixes", clean=True)
    ends = lambda df: df.groupBy("token").agg(F.min("doc_id").alias("anchor"), F.max("doc_id").alias("far"), F.count("*").alias("cnt")).where("anchor <> far").drop("far")
    met = stage(rows.join(ends(rows).select("token"), "token", "left_semi"), "met", clean=True)
    forget(rows)
    # a document that shares fewer tokens with all others together is linked with none
    able = met.groupBy("doc_id").agg(F.count("*").alias("tokens")).join(classes.select(F.col("node").alias("doc_id"), "n", needed(F.col("n"), num, den).alias("need")), "doc_id")
    again = met.join(able.where("tokens >= need").drop("tokens"), "doc_id")
    hits = stage(again.join(ends(again), "token"), "hits", clean=True)
    forget(met)

    votes = hits.groupBy("doc_id", "n", "need", "anchor").agg(F.count("*").alias("votes"), F.sum("cnt").alias("central"))
    group = votes.groupBy("doc_id", "n", "need").agg(F.max_by("anchor", F.struct("votes", -F.col("anchor"))).alias("grp"), F.sum("central").alias("central"))
    group = stage(group, "groups", narrow=True, clean=True)
    matrix = hits.select("doc_id", "token").join(group.select("doc_id", "grp", "need"), "doc_id")
    union = matrix.groupBy("token", "grp").agg(F.count("*").alias("members"))
    several = union.groupBy("token").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo <> hi").select("token")
    inside = matrix.join(union.where("members > 1").select("token", "grp"), ["token", "grp"]).groupBy("doc_id", "grp", "need").agg(F.count("*").alias("overlap"))
    active = inside.where("overlap >= need").select("doc_id")
    other = union.join(several, "token").select("token", F.col("grp").alias("other"))
    across = matrix.join(other, "token").where("other < grp").groupBy("doc_id", F.col("other").alias("grp"), "need").agg(F.count("*").alias("overlap"))
    probes = stage(across.where("overlap >= need").select("doc_id", "grp"), "probes", narrow=True, clean=True)

    asked = probes.select("grp").distinct().withColumn("asked", F.lit(True))
    placed = group.join(active.withColumn("active", F.lit(True)), "doc_id", "left").join(asked, "grp", "left").where("active or asked")
    placed = stage(placed.select("doc_id", "n", "grp", "central", "asked"), "placed", narrow=True, clean=True)
    forget(hits)
    sizes = placed.groupBy("grp").agg(F.count("*").alias("m"), F.bool_or(F.coalesce("asked", F.lit(False))).alias("asked"), F.greatest(F.ceil(F.count("*") / F.lit(BLOCK_DOCS)), F.ceil(F.sum("n") / F.lit(BLOCK_TOKENS))).alias("blocks"), F.max_by("doc_id", F.struct("central", -F.col("doc_id"))).alias("centre"))
    live = sizes.where("m > 1 or asked").select("grp", "blocks", "centre")
    placed = placed.select("doc_id", "grp").join(live, "grp")
    centres = placed.where("doc_id = centre").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("doc_id", "grp", "block", "blocks", F.lit(0).alias("role"))
    others = placed.where("doc_id <> centre").select("doc_id", "grp", F.pmod(F.xxhash64("doc_id"), "blocks").alias("block"), "blocks", F.lit(1).alias("role"))
    members = stage(centres.union(others), "members", narrow=True, clean=True)
    split = members.select("grp", "block", "blocks").distinct()
    queries = probes.join(split, "grp").select("doc_id", "grp", "block")
    found = _open(texts, classes, members, queries, shingle, num, den, "links")
    loose = found.where("kind = 1").select(F.col("a").alias("doc_id"), F.col("b").alias("grp"))
    edges = found.where("kind = 0").select("a", "b")
    if not loose.isEmpty():
        own = members.where("role = 1").select("doc_id", "grp", F.col("block").alias("own"))
        queries = loose.join(own, ["doc_id", "grp"]).join(split, "grp").where("block <> own").select("doc_id", "grp", "block")
        edges = edges.union(_open(texts, classes, members, queries, shingle, num, den, "loose").where("kind = 0").select("a", "b"))
    roots = components(edges, "a", "b")
    named = classes.join(roots, "node", "left").withColumn("root", F.coalesce("component", "node"))
    named = named.join(named.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("n", "k1", "k2", "component_id")
    placed = base.where("n > 0").join(named, ["n", "k1", "k2"], "left").select("doc_id", "n", "component_id")
    # texts without words have no class and meet nothing
    placed = placed.union(base.where("n = 0").select("doc_id", "n", F.col("doc_id")))
    return placed.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"), shingle=3, num=90, den=100)


OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS m FROM r GROUP BY x) USING (doc_id)
"""
