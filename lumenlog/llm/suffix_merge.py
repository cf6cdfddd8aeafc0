"""Removal of byte strings that documents with a smaller id hold too, by a distributed merge sort of suffixes.

A string of `size` bytes is known by an anchor inside it: the place whose GRAM bytes have the least hash, the leftmost of
these. Equal strings have their anchors at the same place, so only suffixes that begin at anchors are sorted, about one
for 18 bytes. A suffix stands for all strings (windows) of its anchor, a line of neighbours, and brings the bytes before
its anchor that these reach.

Each task cuts its documents into blocks, sorts a block's suffixes and sends them as front-coded runs: how many bytes a
suffix shares with the one before it, and the rest. A range is a class of suffixes by a hash of their first GRAM bytes,
within it runs are in byte order. The task of a range leaves out suffixes whose first GRAM bytes no other document
shows there and merges what is left with a loser tree, whose players carry the length of the prefix that they share
with the last winner; it only reads bytes beyond it. The prefixes between neighbours of the merged order, and those of
the bytes before the anchors, say which windows are equal; no pair of documents is made.

Scale: what is sent grows with the bytes (about 3.5 bytes a byte before compression, one suffix a string would be 50);
equal suffixes of a block's documents are sent once, so a passage that a third of all documents hold arrives once a
block. A range holds about RANGE_BYTES bytes' suffixes, the number of ranges follows the table's bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read, stage

SIZE = 50
GRAM = 16
BLOCK = 12 << 20  # bytes of text that are one run
SLICE = 1 << 18  # bytes of text whose anchors are sought at once
STEP = 1 << 15  # rows that are compared at once
SENT = 4 << 20  # bytes of runs that are sent at once
RANGE_BYTES = 4 << 20
PLACE = 23  # bits of a place in a block
MIX = tuple(map(np.uint64, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)))
HITS = pa.schema([("run", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("h64", pa.int64())])
RUNS = pa.schema([("range", pa.int32()), ("run", pa.int64()), ("blob", pa.binary())])


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on."""
    words = np.ndarray((len(b) - 7,), "<u8", b, strides=(1,))
    h = words[:-8] * MIX[0] + words[8:] * MIX[1]
    h ^= h >> np.uint64(32)
    h *= MIX[2]
    return h


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, by doubling."""
    size = 1
    while size * 2 <= width:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return np.minimum(v[: len(v) - (width - size)], v[width - size :]) if width > size else v


def anchored(b: np.ndarray, starts: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """(piece, anchor, low, high, hash): lines of windows of a common anchor; windows begin low to high bytes before it.

    b holds the pieces at starts, of lengths, and at least size bytes after the last one.
    """
    counts = np.maximum(lengths - size + 1, 0)
    p = np.arange(counts.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts)
    h = gram_hashes(b)
    mask = np.uint64((1 << PLACE) - 1)
    places = sliding_min((h & ~mask) | np.arange(len(h), dtype=np.uint64), size - GRAM + 1)
    at = (places[p] & mask).astype(np.int64)
    new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
    n = np.diff(np.r_[new, len(at)])
    anchor, high = at[new], at[new] - p[new]
    return np.repeat(np.arange(len(starts)), counts)[new], anchor, high - n + 1, high, h[anchor]


def shared_prefixes(rows: np.ndarray) -> np.ndarray:
    """How many leading bytes each row shares with the one before it; the first: 0."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        out[1:] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return out


def planes(values: np.ndarray) -> bytes:
    """64-bit numbers byte by byte of all, so that high bytes compress."""
    return values.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def front_coded(right: np.ndarray, left: np.ndarray, low: np.ndarray, high: np.ndarray, ids: np.ndarray, begin: np.ndarray) -> bytes:
    """A sorted run: shared prefix and rest of each suffix, the bytes before its anchor, its windows and its place."""
    size, n = right.shape[1], len(right)
    shared = np.minimum(shared_prefixes(right), size - low)
    column = np.arange(size)
    rest = right[(column >= shared[:, None]) & (column < (size - low)[:, None])]
    before = left[np.arange(left.shape[1]) < high[:, None]]
    head = np.array([n], np.int64).tobytes() + b"".join(x.astype(np.uint8).tobytes() for x in (shared, low, high))
    return zstandard.ZstdCompressor(level=3).compress(head + rest.tobytes() + before.tobytes() + planes(ids) + planes(begin))


def decoded(blob: bytes, size: int) -> tuple[np.ndarray, ...]:
    """(right, left, low, high, ids, begin, shared) of a run."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n = int(raw[:8].view(np.int64)[0])
    shared, low, high = (raw[8 + k * n : 8 + (k + 1) * n].astype(np.int64) for k in range(3))
    at, column = 8 + 3 * n, np.arange(size)
    right, own = np.zeros((n, size), np.uint8), column >= shared[:, None]
    rest = own & (column < (size - low)[:, None])
    right[rest] = raw[at : (at := at + int(rest.sum()))]
    row = np.maximum.accumulate(np.where(own, np.arange(n, dtype=np.int32)[:, None], 0), axis=0)  # the last row that gave this byte itself
    right = np.take_along_axis(right, row, 0)
    left = np.zeros((n, size - GRAM), np.uint8)
    before = np.arange(size - GRAM) < high[:, None]
    left[before] = raw[at : (at := at + int(before.sum()))]
    numbers = [raw[at + k * 8 * n : at + (k + 1) * 8 * n].reshape(8, n).T.copy().view("<i8").ravel() for k in range(2)]
    return right, left, low, high, *numbers, shared


def joined(ids: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Lines of windows as fewer, longer ones where they touch."""
    order = np.lexsort((start, ids))
    ids, start, end = ids[order], start[order], (start + n)[order]
    new = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (start[1:] > end[:-1])]) if len(ids) else np.zeros(0, np.int64)
    return ids[new], start[new], np.maximum.reduceat(end, new) - start[new] if len(new) else end


def suffix_rows(pieces: list[tuple[int, int, int, bytes]], owners: np.ndarray, ranges: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of pieces as rows of bytes that sort by range, suffix, what is before it, windows and owner; the places of their anchors.

    A row: 4 bytes of range, the suffix and the bytes before the anchor, backwards, as far as its windows reach, low,
    high, 4 bytes of owner.
    """
    lengths, offsets = (np.array(x, np.int64) for x in zip(*((len(x[3]), x[2]) for x in pieces)))
    starts = size + np.cumsum(lengths) - lengths
    b = np.frombuffer(bytes(size) + b"".join(x[3] for x in pieces) + bytes(size + 16), np.uint8)
    piece, anchor, low, high, h = anchored(b, starts, lengths, size)
    reach = size - GRAM
    rows = np.zeros((len(piece), size + reach + 10), np.uint8)
    rows[:, :4] = ((((h * MIX[0]) >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(">u4").view(np.uint8).reshape(-1, 4)
    rows[:, 4 : 4 + size] = np.where(np.arange(size) < (size - low)[:, None], b[anchor[:, None] + np.arange(size)], 0)
    rows[:, 4 + size : -6] = np.where(np.arange(reach) < high[:, None], b[anchor[:, None] - 1 - np.arange(reach)], 0)
    rows[:, -6], rows[:, -5] = low, high
    rows[:, -4:] = owners[piece].astype(">u4").view(np.uint8).reshape(-1, 4)
    return rows, anchor - starts[piece] + offsets[piece]


def sorted_runs(pieces: list[tuple[int, int, int, bytes]], run: int, ranges: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(range, blob) of a block of pieces (id, hash of the text, offset, bytes); ids and hits of the block have range -1 - run % 1024."""
    pieces = sorted(pieces, key=lambda x: (x[0], x[2]))
    ids, hashes = (np.array([x[k] for x in pieces], np.int64) for k in range(2))
    owners = np.searchsorted(ids, ids)  # pieces of one document are one
    ends = np.cumsum([len(x[3]) for x in pieces])
    cuts = np.unique(np.searchsorted(ends, np.arange(0, ends[-1], SLICE)))
    held, begins = bytearray(), []  # grows in place, so the block's rows are held once
    for lo, hi in zip(cuts, [*cuts[1:], len(pieces)]):
        part, begin = suffix_rows(pieces[lo:hi], owners[lo:hi], ranges, size)
        held += part.reshape(-1).data
        begins.append(begin)
    begin, rows = np.concatenate(begins), np.frombuffer(held, np.uint8).reshape(-1, part.shape[1])
    n = len(rows)
    order = np.argsort(rows.view(f"S{rows.shape[1]}").ravel(), kind="stable")  # rows stay where they are
    begin = begin[order]
    owner = rows[:, -4:][order].view(">u4").ravel().astype(np.int64)
    lead = np.ones(n, bool)
    for lo in range(1, n, STEP):
        near = rows[:, :-4][order[lo - 1 : lo + STEP]]
        lead[lo : lo + STEP] = (near[1:] != near[:-1]).any(1)
    leads = np.flatnonzero(lead)
    copy = owner > np.repeat(owner[leads], np.diff(np.r_[leads, n]))  # of equal suffixes those of the first document are sent
    low, high = rows[:, -6][order].astype(np.int64), rows[:, -5][order].astype(np.int64)
    hit_ids, hit_start, hit_n = joined(ids[owner[copy]], (begin - high)[copy], (high - low + 1)[copy])
    own = np.flatnonzero(owners == np.arange(len(ids)))
    yield -1 - run % 1024, np.r_[len(own), len(hit_ids), ids[own], hashes[own], hit_ids, hit_start, hit_n].astype(np.int64).tobytes()
    keep = np.flatnonzero(~copy)
    of = rows[:, :4][order[keep]].view(">u4").ravel()
    cuts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else []
    for lo, hi in zip(cuts, [*cuts[1:], len(of)]):
        k = keep[lo:hi]
        at = order[k]
        yield int(of[lo]), front_coded(rows[:, 4 : 4 + size][at], rows[:, 4 + size : -6][at], low[k], high[k], ids[owner[k]], begin[k])


def runs_of(ranges: int, size: int):
    """A function over batches of (doc_id, text, h64) that sends sorted runs, block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 24, 0
        block: list[tuple[int, int, int, bytes]] = []
        held, seen = 0, set()

        def flushed() -> Iterator[pa.RecordBatch]:
            rows, held_ = [], 0
            for row in sorted_runs(block, first + made, ranges, size):
                rows.append(row)
                held_ += len(row[1])
                if held_ >= SENT:
                    yield batch_of(rows)
                    rows, held_ = [], 0
            if rows:
                yield batch_of(rows)

        def batch_of(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.int32()), pa.array([first + made] * len(rows), pa.int64()), pa.array([x for _, x in rows], pa.binary())], schema=RUNS)

        for batch in batches:
            for doc, text, h in zip(*(c.to_pylist() for c in batch.columns)):
                if block and doc in seen:  # a run knows its documents by their ids
                    yield from flushed()
                    made, block, held, seen = made + 1, [], 0, set()
                seen.add(doc)
                for at in range(0, len(text) - size + 1, SLICE):  # windows that begin in [at, at + SLICE)
                    piece = text[at : at + SLICE + size - 1]
                    block.append((doc, h, at, piece))
                    held += len(piece)
                    if held >= BLOCK:
                        yield from flushed()
                        made, block, held, seen = made + 1, [], 0, {doc}
        if block:
            yield from flushed()

    return run


def merged(runs: list[tuple[list[list[int]], list[int]]], size: int) -> tuple[list[int], list[int]]:
    """Runs (keys as 64-bit words, prefixes shared with the one before) as one: which run gives the next key, and how
    many bytes that shares with the one before it.

    A loser tree over the runs' first keys. Each holds the length of the prefix that it shares with the last winner
    which passed it: of two, the one that shares more is less and the other's length stays true; only for equal
    lengths bytes are read, from there on.
    """
    words, k = len(runs[0][0][0]), 1 << (len(runs) - 1).bit_length()
    at, keys = [0] * len(runs), [r[0][0] for r in runs] + [None] * (k - len(runs))
    loser, lost = [0] * k, [0] * k

    def play(a: int, ha: int, b: int, hb: int) -> tuple[int, int, int, int]:
        """Winner and its length, loser and its length."""
        if ha != hb or ha < 0:
            return (a, ha, b, hb) if ha >= hb else (b, hb, a, ha)
        x, y, w = keys[a], keys[b], ha >> 3
        while w < words and x[w] == y[w]:
            w += 1
        if w == words:
            return (a, ha, b, size) if a < b else (b, hb, a, size)
        m = (w << 3) + ((64 - (x[w] ^ y[w]).bit_length()) >> 3)
        return (a, ha, b, m) if x[w] < y[w] else (b, hb, a, m)

    best = [(0, 0)] * k + [(i, 0 if i < len(runs) else -1) for i in range(k)]
    for node in range(k - 1, 0, -1):
        (a, ha), (b, hb) = best[2 * node], best[2 * node + 1]
        *won, loser[node], lost[node] = play(a, ha, b, hb)
        best[node] = tuple(won)
    cur, h = best[1]
    order, shared = [], []
    for _ in range(sum(len(r[0]) for r in runs)):
        order.append(cur)
        shared.append(h)
        mine, lengths = runs[cur]
        at[cur] = now = at[cur] + 1
        if now < len(mine):
            keys[cur], h = mine[now], lengths[now]
        else:
            h = -1
        node = (cur + k) >> 1
        while node:
            other = lost[node]
            if other > h:
                cur, loser[node] = loser[node], cur
                lost[node], h = h, other
            elif other == h and h >= 0:
                x, rival, w = keys[cur], loser[node], h >> 3
                y = keys[rival]
                while w < words and x[w] == y[w]:
                    w += 1
                if w == words:
                    lost[node] = size
                    if rival < cur:
                        cur, loser[node] = rival, cur
                else:
                    lost[node] = (w << 3) + ((64 - (x[w] ^ y[w]).bit_length()) >> 3)
                    if y[w] < x[w]:
                        cur, loser[node] = rival, cur
            node >>= 1
    return order, shared


def as_words(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of big-endian 64-bit words."""
    padded = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    padded[:, : rows.shape[1]] = rows
    return padded.view(">u8").astype(np.uint64)


def repeated_windows(blobs: list[bytes], size: int) -> tuple[np.ndarray, ...]:
    """(run, id, start, n): lines of windows that a document with a smaller id holds too, from a range's runs."""
    parts = [decoded(x, size) for x in blobs]
    right, left, low, high, ids, begin, shared = (np.concatenate(x) for x in zip(*parts))
    run = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    words = as_words(right)
    mark = words[:, 0] * MIX[0] + words[:, 1] * MIX[1]
    order = np.argsort(mark, kind="stable")
    groups = np.flatnonzero(np.r_[True, mark[order][1:] != mark[order][:-1]])
    several = np.minimum.reduceat(ids[order], groups) != np.maximum.reduceat(ids[order], groups)
    alive = np.zeros(len(mark), bool)
    alive[order] = np.repeat(several, np.diff(np.r_[groups, len(mark)]))
    left_in, firsts = [], np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    for lo, hi in zip(firsts, [*firsts[1:], len(run)]):
        k = np.flatnonzero(alive[lo:hi])
        if len(k):
            prefix = [0, *np.minimum.reduceat(shared[lo : lo + k[-1] + 1], k[:-1] + 1).tolist()] if len(k) > 1 else [0]
            left_in.append((lo + k, words[lo + k].tolist(), prefix))
    if not left_in:
        return (np.zeros(0, np.int64),) * 4
    turn, prefix = merged([(w, p) for _, w, p in left_in], size)
    turn, prefix = np.array(turn), np.array(prefix)
    place = np.zeros(len(turn), np.int64)
    place[np.argsort(turn, kind="stable")] = np.concatenate([x for x, _, _ in left_in])
    left, low, high, ids, begin, run = (x[place] for x in (left, low, high, ids, begin, run))
    by_left = np.lexsort(as_words(left).T[::-1])
    prefix_left = shared_prefixes(left[by_left])
    n, reach = len(place), size - GRAM
    hit, class_left = np.zeros((n, reach + 3), bool), np.zeros(n, np.int64)
    for d in range(reach + 1):  # windows that begin d bytes before their anchors
        at = np.flatnonzero((low <= d) & (high >= d))
        if len(at):
            class_left[by_left] = np.cumsum(prefix_left < d)
            key = np.cumsum(prefix < size - d)[at] * (n + 1) + class_left[at]
            by = np.argsort(key, kind="stable")
            sizes = np.diff(np.r_[np.flatnonzero(np.r_[True, key[by][1:] != key[by][:-1]]), len(at)])
            of = ids[at][by]
            least = np.repeat(np.minimum.reduceat(of, np.cumsum(sizes) - sizes), sizes)
            hit[at[by][of > least], reach - d + 1] = True
    turns = np.diff(hit.astype(np.int8), axis=1)
    (row, one), (_, two) = np.nonzero(turns == 1), np.nonzero(turns == -1)
    return run[row], ids[row], begin[row] - (reach - one), two - one


def merge_range(size: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        blobs, runs = table["blob"].to_pylist(), np.array(table["run"].to_pylist(), np.int64)
        if key[0].as_py() < 0:  # documents of the runs, and hits inside them
            out = []
            for run_id, blob in zip(runs, blobs):
                raw = np.frombuffer(blob, np.int64)
                (docs, hits), raw = raw[:2], raw[2:]
                own, found = raw[: 2 * docs].reshape(2, docs), raw[2 * docs :].reshape(3, hits)
                out.append(pa.table([np.full(docs, run_id), own[0], pa.nulls(docs, pa.int64()), pa.nulls(docs, pa.int64()), own[1]], schema=HITS))
                out.append(pa.table([np.full(hits, run_id), *found, pa.nulls(hits, pa.int64())], schema=HITS))
            return pa.concat_tables(out)
        order = np.argsort(runs, kind="stable")  # the same rows after a retry, in whichever order runs arrive
        at, ids, start, n = repeated_windows([blobs[i] for i in order], size)
        return pa.table([runs[order][at], ids, start, n, pa.nulls(len(at), pa.int64())], schema=HITS)

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) from (doc_id, text, spans of removed bytes)."""
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            kept, end, removed, count = hashlib.sha256(), 0, 0, 0
            for lo, hi in sorted((s["start"], s["end"]) for s in spans or ()):
                if lo > end or not count:
                    kept.update(text[end:lo])
                    count += 1
                    end = lo
                removed += max(0, hi - end)
                end = max(end, hi)
            kept.update(text[end:])
            rows.append((len(text), removed, count, kept.hexdigest()))
        numbers = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *numbers, pa.array([r[3] for r in rows], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """(doc_id, h64, spans): bytes [start, end) of rows that a string of `size` bytes covers which a smaller id holds too.

    Rows are known by id and a 64-bit hash of their text. Rows of one id do not match each other; rows without an id or
    with a text of fewer than size bytes take no part. Spans of a row may overlap.
    """
    if not 2 * GRAM <= size <= 255:
        raise ValueError(f"size is {2 * GRAM} to 255 bytes")
    spark = docs.sparkSession
    rows = _rows(docs, id_col, text_col)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), total // RANGE_BYTES)
    runs = rows.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= size)).mapInArrow(runs_of(ranges, size), "range int, run long, blob binary")
    found = stage(runs.groupBy("range").applyInArrow(merge_range(size), "run long, doc_id long, start long, n long, h64 long"), "windows", clean=True)
    own = found.where("n is null").select("run", "doc_id", "h64")
    span = F.struct("start", (F.col("start") + F.col("n") + size - 1).alias("end"))
    hits = found.where("n is not null").groupBy("run", "doc_id").agg(F.collect_set(span).alias("spans"))
    return hits.join(own, ["run", "doc_id"]).groupBy("doc_id", "h64").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.cast("binary").alias("text"), F.xxhash64(text).alias("h64"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row, without the bytes that repeated_spans finds.

    A null text is empty. Rows that repeat an id are judged each by its own text, against other ids. A null id is kept
    whole and removes nothing. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    rows = _rows(docs, id_col, text_col)
    spans = stage(repeated_spans(docs, id_col, text_col, size), "spans", clean=True)
    joined_ = rows.join(spans, ["doc_id", "h64"], "left").select("doc_id", "text", "spans")
    return joined_.mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"))


OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT r, doc_id, s, b[s + 1 : s + {SIZE}] AS x FROM (SELECT r, doc_id, b, unnest(range(0, octet_length(b) - {SIZE - 1})) AS s FROM d WHERE doc_id IS NOT NULL)),
f AS (SELECT x, min(doc_id) AS low FROM w GROUP BY x HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT r, s, s > lag(s) OVER (PARTITION BY r ORDER BY s) + {SIZE} AS gap FROM w JOIN f USING (x) WHERE doc_id > low),
line AS (SELECT r, s, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY s) AS g FROM hit),
span AS (SELECT r, min(s) AS a, max(s) + {SIZE} AS z FROM line GROUP BY r, g),
cut AS (SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS q FROM span),
kept AS (SELECT r, string_agg(hex(b[q + 1 : a]), '' ORDER BY a) AS k, max(z) AS z, sum(z - a) AS n, count(*) AS m FROM cut JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(m, 0) AS BIGINT) AS n_spans,
  sha256(unhex(concat(coalesce(k, ''), hex(b[coalesce(z, 0) + 1 : ])))) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
