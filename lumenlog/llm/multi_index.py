"""Embedding near-duplicates by an inverted multi-index.

Unit vectors are split in halves; each half has its own codebook, and the product of the two forms a grid of cells.
Every vector is indexed in its cell. A query walks the cells in order of distance by the multi-sequence algorithm
(a heap over the two sorted lists of half distances) as far as the target recall asks: the walk's length is set on a
bounded sample, by vectors planted at exactly the least similarity. Every pair that meets is verified in double
precision. A pair is found when either vector's walk visits the other's cell, so links are symmetric.

Scale: equal vectors become one class before any join. The grid grows with the rows, up to an eighth of the sample's
vectors in each codebook. Centroids are numbered along their main direction, and TILE x TILE cells make a tile: a query
is sent once to each tile that its walk enters, in the width its table has, and meets there only the cells it walks. Tiles
are cut into blocks of BLOCK members by BLOCK queries, so no task holds more, and a block gives counts and a spanning
forest of its links, never its pairs. Codebooks are broadcast up to BOOK_NUMBERS numbers; vectors of lengths beyond share
one cell, which finds all their links.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import components, read, stage

SAMPLE_ROWS = 20_000  # codebooks and the walk's length are fitted on this many vectors at most
SAMPLE_NUMBERS = 4_000_000  # and on this many components at most
BOOK_NUMBERS = 4_000_000  # of all codebooks together
PER_CELL = 64
TILE = 4
BLOCK = 1024
CHUNK = 1024  # vectors that are compared with the centroids at once
TARGET_RECALL = 0.995


def _fit(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k-means centroids of the rows of x, from evenly spaced rows."""
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = (-2 * x @ centres.T + (centres**2).sum(1)).argmin(1)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    spread = centres - centres.mean(0)
    return centres[np.argsort(spread @ np.linalg.svd(spread, full_matrices=False)[2][0], kind="stable")]  # neighbours have near numbers


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)


def walk(first: np.ndarray, second: np.ndarray, most: int) -> list[int]:
    """The `most` nearest cells of the grid in order of distance: the multi-sequence traversal."""
    a, b = np.argsort(first, kind="stable").tolist(), np.argsort(second, kind="stable").tolist()
    d, e = first.tolist(), second.tolist()
    heap, pushed, out = [(d[a[0]] + e[b[0]], 0, 0)], {(0, 0)}, []
    while heap and len(out) < most:
        _, i, j = heapq.heappop(heap)
        out.append(a[i] * len(e) + b[j])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in pushed:
                pushed.add((x, y))
                heapq.heappush(heap, (d[a[x]] + e[b[y]], x, y))
    return out


def fit(sample: np.ndarray, rows_per_label: float, cosine: float, recall: float, seed: int = 7) -> tuple[np.ndarray, np.ndarray, int]:
    """Codebooks of both halves and the length of the walk that meets the recall for pairs at exactly `cosine`."""
    half = sample.shape[1] // 2
    k = int(min(max(2, len(sample) // 8), max(2, np.ceil(np.sqrt(rows_per_label / PER_CELL)))))
    books = _fit(sample[:, :half], k), _fit(sample[:, half:], k)
    x = sample[:1000]
    g = np.random.default_rng(seed).standard_normal(x.shape)
    g -= (g * x).sum(1, keepdims=True) * x
    size = np.linalg.norm(g, axis=1, keepdims=True)
    y = cosine * x + np.sqrt(1 - cosine**2) * g / np.where(size == 0, 1, size)
    at = [_distances(part, book).argmin(1) for part, book in ((y[:, :half], books[0]), (y[:, half:], books[1]))]
    rank = []
    for i, (a, b) in enumerate(zip(_distances(x[:, :half], books[0]), _distances(x[:, half:], books[1]))):
        rank.append(np.searchsorted(np.sort(b), a[at[0][i]] + b[at[1][i]] - a).sum() + 1)  # cells that are nearer, and this one
    return *books, int(np.ceil(np.quantile(rank, recall)))


def _units(raws: list[bytes], dim: int) -> np.ndarray:
    """Unit vectors in double precision from the bytes of float or double components."""
    kind = np.float32 if len(raws[0]) == 4 * dim else np.float64
    x = np.frombuffer(b"".join(raws), kind).reshape(-1, dim).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every row's number, label and id, and for vectors that can be compared their length, digest and components."""
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
    for batch in batches:
        rows = []
        kind = np.float32 if pa.types.is_float32(batch.schema.field(2).type.value_type) else np.float64
        for vec, label, values in zip(*(batch.column(i) for i in range(3))):
            row = (vec.as_py(), label.as_py(), None, None, None)
            if values.is_valid and label.is_valid and not values.values.null_count:
                x = values.values.to_numpy(zero_copy_only=False).astype(kind)
                if len(x) and np.isfinite(x).all() and x.any():
                    raw = x.tobytes()
                    row = (*row[:2], len(x), hashlib.md5(_units([raw], len(x)).tobytes()).digest(), raw)
            rows.append(row)
        columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, kinds)]
        yield pa.RecordBatch.from_arrays([*columns, batch.column(3)], ["row", "label", "dim", "digest", "raw", "vec_id"])


def tile_of(cell: np.ndarray, second: int) -> np.ndarray:
    """The tile of cells of a grid whose second codebook has `second` centroids."""
    return cell // second // TILE * -(-second // TILE) + cell % second // TILE


def _celled(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each vector's own cell and tile, its walk and the tiles that it enters; without a codebook all is one cell."""
    for batch in batches:
        own, tile = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int32)
        walks, tiles = [[0]] * batch.num_rows, [[0]] * batch.num_rows
        dims = batch.column(batch.schema.names.index("dim")).to_numpy()
        raws = batch.column(batch.schema.names.index("raw"))
        for dim in np.unique(dims).tolist():
            if dim in shared.value:
                one, two, most = shared.value[dim]
                every = np.flatnonzero(dims == dim)
                for at in (every[i : i + CHUNK] for i in range(0, len(every), CHUNK)):
                    x = _units([raws[int(i)].as_py() for i in at], dim)
                    for i, a, b in zip(at.tolist(), _distances(x[:, : dim // 2], one), _distances(x[:, dim // 2 :], two)):
                        walks[i] = walk(a, b, most)
                        entered = tile_of(np.array(walks[i]), len(two))
                        own[i], tile[i], tiles[i] = walks[i][0], entered[0], np.unique(entered).tolist()
        lists = [pa.array(x, pa.list_(pa.int32())) for x in (walks, tiles)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own), pa.array(tile), *lists], [*batch.schema.names, "cell", "tile", "walk", "tiles"])


def _forest(i: np.ndarray, j: np.ndarray, n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """For the bipartite graph of the pairs (i, j), the smallest position each node is connected to."""
    left, right = np.arange(n), np.full(m, n + m)
    while True:
        was = left.copy()
        np.minimum.at(right, j, left[i])
        np.minimum.at(left, i, right[j])
        if (was == left).all():
            return left, right


def _verified(cosine: float):
    """Rows (kind 0: vector a has b more links; kind 1: a and b are connected)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m, q = pdf[pdf["role"] == 0], pdf[pdf["role"] == 1]
        out: list[np.ndarray] = [np.zeros((0, 3), np.int64)]
        if len(m) and len(q):
            dim = int(pdf["dim"].iloc[0])
            x, y = (_units(part["raw"].tolist(), dim) for part in (q, m))
            cells = m["cell"].to_numpy()
            walked, owner = np.concatenate(q["walk"].tolist()), np.repeat(np.arange(len(q)), q["walk"].map(len))
            met = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for cell in np.unique(cells).tolist():
                here, asking = np.flatnonzero(cells == cell), owner[walked == cell]
                a, b = np.nonzero(x[asking] @ y[here].T >= cosine)
                met.append((asking[a], here[b]))
            i, j = (np.concatenate(part) for part in zip(*met))
            (qi, mi), (qw, mw) = ((part["rep"].to_numpy() for part in (q, m)), (part["weight"].to_numpy() for part in (q, m)))
            other = qi[i] != mi[j]
            i, j = i[other], j[other]
            if len(i):
                counts = np.zeros(len(q), np.int64)
                np.add.at(counts, i, mw[j])
                out.append(np.stack([np.zeros_like(qi), qi, counts], 1)[counts > 0])
                asked, back = np.unique(q["cell"].to_numpy(), return_inverse=True)
                seen = np.array([np.isin(asked, w) for w in m["walk"]])
                once = ~seen[j, back[i]]  # the member's own walk doesn't come by the query's cell
                counts = np.zeros(len(m), np.int64)
                np.add.at(counts, j[once], qw[i[once]])
                out.append(np.stack([np.zeros_like(mi), mi, counts], 1)[counts > 0])
                left, right = _forest(i, j, len(q), len(m))
                for ids, to in ((qi, left), (mi, right)):
                    tied = to < len(q)
                    out.append(np.stack([np.ones(tied.sum(), np.int64), ids[tied], qi[to[tied]]], 1))
        return pd.DataFrame(np.concatenate(out), columns=["kind", "a", "b"]).astype("int64")

    return run


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, recall: float = TARGET_RECALL, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per input row: vec_id, n_links, component_id (smallest id reachable), kept (vec_id = component_id).

    Vectors are compared when their labels are equal and not null and their lengths are equal. A vector that is
    null, empty, zero, or holds a null or non-finite component links with nothing: n_links 0, its own component.
    Rows are compared each by its own vector, whatever their ids: equal vectors link with each other, also under one id,
    and so does a row whose id is null, which has a null component and kept itself. Other columns are ignored; an empty
    table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("embedding"), F.col(id_col).cast("long").alias("vec_id"))
    units = stage(rows.mapInArrow(_unit, "row long, label long, dim int, digest binary, raw binary, vec_id long"), "units")  # written, so that numbers stay the same
    named = units.where("digest is not null")
    classes = named.groupBy("label", "dim", "digest").agg(F.min("row").alias("rep"), F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    classes = stage(classes, "classes")
    sizes = classes.groupBy("dim").agg((F.count("*") / F.count_distinct("label")).alias("n")).orderBy(F.desc("n"), "dim").collect()  # a row a length of vectors
    picked = named.join(classes.select("label", "dim", "digest", F.col("rep").alias("row"), "weight"), ["label", "dim", "digest", "row"])
    books, room = {}, BOOK_NUMBERS
    for dim, n in sizes:
        most = min(SAMPLE_ROWS, SAMPLE_NUMBERS // dim)
        if dim > 1 and most > 1 and room > 0:
            some = picked.where(F.col("dim") == dim).orderBy(F.xxhash64("row"), "row").limit(most).select("raw").collect()
            if len(some) > 1:
                books[dim] = fit(_units([x[0] for x in some], dim), n, cosine, recall)
                room -= books[dim][0].size + books[dim][1].size
    shared = spark.sparkContext.broadcast(books)  # BOOK_NUMBERS and one length's codebooks at most
    kinds = "label long, dim int, rep long, weight long, raw binary"
    celled = picked.select("label", "dim", F.col("row").alias("rep"), "weight", "raw").mapInArrow(partial(_celled, shared), f"{kinds}, cell int, tile int, walk array<int>, tiles array<int>")
    celled = stage(celled, "cells")

    key = ["label", "dim", "tile"]
    asked = celled.select("label", "dim", "rep", "weight", "raw", "cell", "walk", F.explode("tiles").alias("tile"))
    held = celled.groupBy(key).agg(F.count("*").alias("held"))
    asking = celled.select("label", "dim", F.explode("tiles").alias("tile")).groupBy(key).agg(F.count("*").alias("asking"))
    cut = held.join(asking, key).select(*key, F.ceil(F.col("held") / BLOCK).alias("mb"), F.ceil(F.col("asking") / BLOCK).alias("qb"))
    to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    draw = lambda n: F.pmod(F.xxhash64("rep", F.lit(n)), F.col(n))
    members = celled.join(cut, key).withColumn("m", draw("mb")).withColumn("q", to("qb")).select(*key, "m", "q", F.lit(0).alias("role"), "rep", "weight", "raw", "cell", "walk")
    queries = asked.join(cut, key).withColumn("q", draw("qb")).withColumn("m", to("mb")).select(*key, "m", "q", F.lit(1).alias("role"), "rep", "weight", "raw", "cell", "walk")
    found = stage(members.union(queries).groupBy(*key, "m", "q").applyInPandas(_verified(cosine), "kind long, a long, b long"), "found")
    counts = found.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("more"))
    roots = components(found.where("kind = 1").select("a", "b"), "a", "b")
    told = classes.join(counts, "rep", "left").join(roots, classes.rep == roots.node, "left").select("label", "dim", "digest", "least", F.coalesce("component", "rep").alias("root"), (F.coalesce("more", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    told = told.join(told.groupBy("root").agg(F.min("least").alias("component")), "root").drop("root", "least")
    out = units.select("vec_id", "label", "dim", "digest").join(told, ["label", "dim", "digest"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"), cosine=0.93)


#: All pairs of a label; the index finds them all on the tables that this is run on.
OP10_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS MATERIALIZED (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda z: z * z)))) AS e FROM v),
l AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_inner_product(a.e, b.e) >= 0.93),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, least(vec_id, coalesce(m, vec_id)) = vec_id AS kept FROM embeddings LEFT JOIN (SELECT x AS vec_id, count(*) AS n FROM l GROUP BY x) USING (vec_id) LEFT JOIN (SELECT x AS vec_id, min(y) AS m FROM r GROUP BY x) USING (vec_id)
"""
