"""Byte-level BPE: encoding by a lazily determinised finite-state transducer, streaming decoding.

A token sequence is the BPE encoding of its bytes exactly when each neighbouring pair is the encoding of its own
bytes. The transducer reads bytes and follows, for every place where a token may have begun, the one valid encoding
up to that place; a state is the last token emitted and these alternatives (tokens held back, bytes of the token in
progress). A token is emitted once all alternatives share it. An alternative lives only while its bytes begin some
token, so the lookahead is bounded by the longest token. States and their transitions are made when first needed
and forgotten together when too many are held.

Scale: no shuffle. Each task holds the vocabulary, the states and a cache of pre-tokens, all bounded.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import partial
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read

WORDS = 1 << 20  # pre-tokens that a task keeps; a quarter as many states and three eighths as many pairs of tokens
ROWS = 250

#: The white space of the pre-token pattern (Unicode White_Space).
WHITE = r"\t-\r \x85\xa0  -     　"


def load_ranks(lines: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 token and rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines())}


class Transducer:
    """The transducer of one vocabulary. Tokens in progress are nodes of the trie of all tokens (0: none begun)."""

    def __init__(self, ranks: dict[bytes, int], words: int = WORDS):
        self.most_states, self.most_pairs = words // 4, words * 3 // 8
        self.ranks = ranks
        self.bytes = {rank: token for token, rank in ranks.items()}
        nodes: dict[bytes, int] = {b"": 0}
        for token in ranks:
            for n in range(1, len(token) + 1):
                nodes.setdefault(token[:n], len(nodes))
        inner = {token[:n] for token in ranks for n in range(len(token))}
        #: node << 8 | byte to the child's node, its token (-1: none), and whether longer tokens pass through it
        self.child = {nodes[text[:-1]] << 8 | text[-1]: (node, ranks.get(text, -1), text in inner) for text, node in nodes.items() if node}
        self.pairs: dict[int, bool] = {}
        self.forget()

    def forget(self) -> None:
        self.number: dict = {}
        self.shared: dict = {}  # equal alternatives of different states are one object
        self.states: list = []
        self.delta: dict[int, int | tuple[int, tuple[int, ...]]] = {}  # state << 8 | byte to state, and what is emitted
        self.start = self.state(-1, (((), 0),))

    def state(self, last: int, open_: tuple) -> int:
        key = (last, open_)
        at = self.number.get(key)
        if at is None:
            at = self.number[key] = len(self.states)
            self.states.append(key)
        return at

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b by rank ends in exactly a, b."""
        left, right, rank = self.bytes[a], self.bytes[b], self.ranks.get
        if left + right in self.ranks:
            known = False
        else:
            parts = [bytes((x,)) for x in left + right]
            cost = [rank(x + y, 1 << 60) for x, y in zip(parts, parts[1:])]
            while cost:
                best = min(cost)
                if best == 1 << 60:
                    break
                i = cost.index(best)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del cost[i]
                if i:
                    cost[i - 1] = rank(parts[i - 1] + parts[i], 1 << 60)
                if i < len(cost):
                    cost[i] = rank(parts[i] + parts[i + 1], 1 << 60)
            known = len(parts) == 2 and parts[0] == left
        if len(self.pairs) >= self.most_pairs:
            self.pairs.clear()
        self.pairs[a << 32 | b] = known
        return known

    def step(self, at: int, byte: int) -> int | tuple[int, tuple[int, ...]]:
        last, open_ = self.states[at]
        kept, done = [], None
        child, pairs = self.child.get, self.pairs.get
        for held, node in open_:
            found = child(node << 8 | byte)
            if found is None:
                continue
            node, rank, inner = found
            if rank >= 0 and done is None:
                before = held[-1] if held else last
                if before >= 0:
                    known = pairs(before << 32 | rank)
                    if known or known is None and self.fits(before, rank):
                        done = (*held, rank)
                else:
                    done = (*held, rank)
            if inner:
                kept.append((held, node))
        kept.append((done, 0))
        n, first = 0, kept[0][0]
        if len(kept) == 1:
            n = len(first)
        elif first:
            for n in range(len(first) + 1):
                if n == len(first) or any([len(held) == n or held[n] != first[n] for held, _ in kept]):
                    break
        one = self.shared.setdefault
        if not n:
            kept = [one(x, x) for x in kept]
            to: int | tuple = self.state(last, tuple(kept))
        else:
            kept = [one(x, x) for x in [(held[n:], node) for held, node in kept]]
            # the last token only matters where an alternative has none of its own
            to = (self.state(first[n - 1] if any([not held for held, _ in kept]) else -2, tuple(kept)), first[:n])
        self.delta[at << 8 | byte] = to
        return to

    def encode_all(self, words: list[bytes]) -> Iterator[list[int]]:
        """Tokens of each pre-token, in turn. What a word shares with the one before it is not read again."""
        out: list[int] = []
        trail, before = [(self.start, 0)], b""
        for data in words:
            n = 0
            for x, y in zip(before, data):
                if x != y:
                    break
                n += 1
            if len(self.states) > self.most_states:
                self.forget()
                trail, n = [(self.start, 0)], 0
            del trail[n + 1 :]
            at, size = trail[n]
            del out[size:]
            get = self.delta.get
            for byte in data[n:]:
                move = get(at << 8 | byte)
                if move is None:
                    if len(self.states) > 2 * self.most_states:  # within a very long pre-token; the trail is then of no use
                        key = self.states[at]
                        self.forget()
                        trail, at, get = [], self.state(*key), self.delta.get
                    move = self.step(at, byte)
                if move.__class__ is int:
                    at = move
                else:
                    at, tokens = move
                    out += tokens
                trail.append((at, len(out)))
            yield [*out, *self.states[at][1][-1][0]]
            before = data
            if len(trail) != len(data) + 1:
                out, trail, before = [], [(self.start, 0)], b""

    def encode(self, data: bytes) -> list[int]:
        return next(self.encode_all([data]))


class Utf8Machine:
    """Incremental UTF-8: bytes in any cuts to text; the state is the unfinished sequence, broken ones give U+FFFD."""

    def __init__(self):
        self.held = b""

    @staticmethod
    def unfinished(data: bytes) -> int:
        """Bytes at the end of data that begin a sequence which more bytes may finish."""
        for n in range(1, min(3, len(data)) + 1):
            lead = data[-n]
            if lead >= 0xC0:
                need = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                second = data[-n + 1] if n > 1 else None
                low = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, 0x80)
                high = {0xED: 0x9F, 0xF4: 0x8F}.get(lead, 0xBF)
                return n if n < need and 0xC2 <= lead <= 0xF4 and (second is None or low <= second <= high) else 0
            if lead < 0x80:
                return 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data) - self.unfinished(data)
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        held, self.held = self.held, b""
        return held.decode("utf-8", "replace")


_made: dict = {}


def _once(key, make):
    """What make() gives, kept for the tasks that a Python worker runs one after another."""
    if key not in _made:
        _made[key] = make()
    return _made[key]


def _encoder(lines: bytes, pattern: str, words: int = WORDS):
    import regex

    split = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]")).findall
    return Transducer(load_ranks(lines), words), {}, split


def _encoded(shared, pattern: str, most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """known: pre-token to the bytes of its int32 tokens; at `most` entries all are forgotten."""
    machine, known, split = _once(("encode", pattern, most, len(shared.value), hash(shared.value)), partial(_encoder, shared.value, pattern, most))
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            texts = [split(text or "") for text in part.column(part.num_columns - 1).to_pylist()]
            words = set().union(*texts)
            fresh = words.difference(known)
            if len(known) + len(fresh) > most:
                known.clear()
                fresh = words
            order = sorted(word.encode() for word in fresh)
            for word, ids in zip(order, machine.encode_all(order)):
                known[word.decode()] = array("i", ids).tobytes()
            out, ends = [], [0]
            for found in texts:
                out.append(b"".join(map(known.__getitem__, found)))
                ends.append(ends[-1] + len(out[-1]) // 4)
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(out), np.int32)))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids], [*part.schema.names[:-1], "ids"])


def encode(docs: DataFrame, lines: bytes, pattern: str, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", words: int = WORDS) -> DataFrame:
    """The columns of keep and ids, the tokens of each whole text.

    lines: the rank file's content. Each match of pattern is encoded separately; special tokens' strings are
    ordinary text. A null or empty text gives no tokens. Rows may repeat; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lines)  # the vocabulary, whatever the corpus's size
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(partial(_encoded, shared, pattern, words), f"{kinds}, ids array<int>")


class _Tokens:
    """Strings of all tokens end to end, to gather those of a run of tokens at once."""

    def __init__(self, strings: dict[int, bytes]):
        table = sorted(strings.items())
        self.size = np.zeros(table[-1][0] + 1, np.int64)
        self.size[[rank for rank, _ in table]] = [len(token) for _, token in table]
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.data = np.frombuffer(b"".join(token for _, token in table), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        if not size.all():
            raise ValueError("a token id that the vocabulary lacks")
        ends = np.cumsum(size)
        return self.data[np.repeat(self.start[ids] - ends + size, size) + np.arange(ends[-1] if len(ids) else 0)].tobytes()


def _decoded(shared, chunk: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = _once(("decode", len(shared.value), hash(shared.value)), lambda: _Tokens({rank: token for token, rank in load_ranks(shared.value).items()}))
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            texts = []
            for ids in part.column(part.num_columns - 1):
                ids = ids.values.to_numpy(zero_copy_only=False) if ids.is_valid else np.zeros(0, np.int32)
                machine = Utf8Machine()
                texts.append("".join([*(machine.feed(table.bytes_of(ids[i : i + chunk])) for i in range(0, len(ids), chunk)), machine.close()]))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "decoded"])


def decode(tokens: DataFrame, lines: bytes, chunk: int = 4096) -> DataFrame:
    """Adds decoded, the text of the column ids, which must come last; null ids give an empty text.

    Tokens are decoded as a stream, chunk at a time; bytes that are not UTF-8 give U+FFFD. A token id outside the
    vocabulary is an error.
    """
    shared = tokens.sparkSession.sparkContext.broadcast(lines)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema.fields)
    return tokens.mapInArrow(partial(_decoded, shared, chunk), f"{kinds}, decoded string")


def _both(shared, pattern: str, most: int, chunk: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _decoded(shared, chunk, _encoded(shared, pattern, most, batches))


def round_trip(docs: DataFrame, lines: bytes, pattern: str, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", chunk: int = 4096, words: int = WORDS) -> DataFrame:
    """encode and then decode in one pass of the tasks, so that a task needs one Python worker and one set of caches.

    The columns of keep, ids and decoded of every row; a null or empty text has no ids and decodes to an empty one. Rows
    that repeat are each encoded; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lines)
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(partial(_both, shared, pattern, words, chunk), f"{kinds}, ids array<int>, decoded string")


def vocabulary(path: str) -> bytes:
    """The rank file, read on the driver; it is sent to the tasks, so executors need no copy."""
    with open(path, "rb") as file:
        return file.read()


def _digested(shared, pattern: str, most: int, chunk: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The round trip's ids and texts, told by their digests."""
    decimal = _once(("decimal", len(shared.value), hash(shared.value)), lambda: _Tokens({rank: b"%d," % rank for rank in load_ranks(shared.value).values()}))
    for batch in _both(shared, pattern, most, chunk, batches):
        n, of_ids, of_text = [], [], []
        for ids, text in zip(batch.column(1), batch.column(2)):
            ids = ids.values.to_numpy(zero_copy_only=False)
            n.append(len(ids))
            digest = sha256()
            for at in range(0, len(ids), chunk):
                part = decimal.bytes_of(ids[at : at + chunk])
                digest.update(part if at + chunk < len(ids) else part[:-1])
            of_ids.append(digest.hexdigest())
            of_text.append(sha256(text.as_buffer()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def digests(docs: DataFrame, lines: bytes, pattern: str, chunk: int = 4096, words: int = WORDS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of docs, from its round trip.

    A null text is an empty one: no tokens, digests of nothing. Rows are judged each by itself, whatever their ids; other
    columns are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lines)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_digested, shared, pattern, words, chunk), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(read(spark, sf_dir, "documents"), vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
