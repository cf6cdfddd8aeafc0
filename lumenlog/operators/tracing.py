"""A recurrent tracing model, trained by synchronous data-parallel steps: tasks sum gradients, the driver moves the weights.

A learner's hidden state foretells each outcome from the component asked, then takes in component and outcome:
p = sigmoid(state . out[kc] + bias[kc]), state = tanh(in[2 kc + outcome] + state . turn + shift). All folds are trained in
the same passes. A pass is one job over staged blocks of sequences: each task adds up its blocks' gradients, some tasks
add up the tasks', and FAN rows of weights reach the driver. The weights are 3 x components x width numbers a
fold, which the driver and each task hold; that bounds the components, not the learners.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.sources.staging import stage

WIDTH = 16
CHUNK = 200  # outcomes that gradients run back through
BLOCK = 256  # sequences that are walked at once
FAN = 16
BUCKETS = 1000  # of scores, by which the early stop ranks the valid rows
DECAY = (0.9, 0.999)
SCORED = "user_id long, fold int, item_id array<long>, kc_id array<long>, seq array<string>, y array<int>, p array<double>"


class Weights:
    """One fold's weights as views of one vector, so that steps and sums are of vectors."""

    def __init__(self, n: int, width: int, flat: np.ndarray | None = None):
        shapes = {"into": (2 * n, width), "turn": (width, width), "shift": (width,), "out": (n, width), "bias": (n,)}
        sizes = [int(np.prod(s)) for s in shapes.values()]
        self.n, self.width, self.flat = n, width, np.zeros(sum(sizes)) if flat is None else flat
        for (name, shape), start, size in zip(shapes.items(), np.cumsum([0, *sizes]), sizes):
            setattr(self, name, self.flat[start : start + size].reshape(shape))


def drawn(n: int, seed: int, mean: float, width: int = WIDTH) -> Weights:
    """Small seeded weights; without any state a component is foretold by the mean outcome."""
    w = Weights(n, width)
    w.flat[:] = np.random.default_rng(seed).normal(0, 0.1, len(w.flat))
    mean = min(max(mean, 1e-3), 1 - 1e-3)
    w.bias[:] = np.log(mean / (1 - mean))
    return w


def padded(rows: list[list[int]], fill: int) -> np.ndarray:
    """Lists as the columns of a matrix, fill after the end."""
    out = np.full((max(map(len, rows)), len(rows)), fill, np.int64)
    for column, row in enumerate(rows):
        out[: len(row), column] = row
    return out


def foretold(w: Weights, kc: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chances (steps, sequences) of right outcomes and the states before them (steps + 1, ..); y is -1 after a sequence's end."""
    states, chances = np.zeros((len(kc) + 1, kc.shape[1], w.width)), np.zeros(kc.shape)
    for t in range(len(kc)):
        chances[t] = 1 / (1 + np.exp(-((states[t] * w.out[kc[t]]).sum(1) + w.bias[kc[t]])))
        states[t + 1] = np.tanh(w.into[2 * kc[t] + np.maximum(y[t], 0)] + states[t] @ w.turn + w.shift)
    return chances, states


def gradient(w: Weights, kc: np.ndarray, y: np.ndarray) -> tuple[Weights, float]:
    """Gradient of the summed log loss of a block, and that loss."""
    chances, states = foretold(w, kc, y)
    live = y >= 0
    p = np.clip(chances, 1e-12, 1 - 1e-12)
    loss = -float(np.log(np.where(y == 1, p, 1 - p))[live].sum())
    error = np.where(live, chances - y, 0.0)
    g, back = Weights(w.n, w.width), np.zeros((kc.shape[1], w.width))
    for t in range(len(kc) - 1, -1, -1):
        inner = back * (1 - states[t + 1] ** 2)
        np.add.at(g.into, 2 * kc[t] + np.maximum(y[t], 0), inner)
        g.turn += states[t].T @ inner
        g.shift += inner.sum(0)
        np.add.at(g.out, kc[t], error[t][:, None] * states[t])
        np.add.at(g.bias, kc[t], error[t])
        back = inner @ w.turn.T + error[t][:, None] * w.out[kc[t]]
    return g, loss


def sequences_of(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(fold, user_id, split, kc, y, item_id, kc_id, seq): learners' rows in order, kc as dense ids; components that train lacks share the last, n."""
    known = ids.groupBy("fold").agg(F.max("dense").alias("top"))
    rows = rows.join(ids.select("fold", "kc_id", "dense"), ["fold", "kc_id"], "left").join(F.broadcast(known), "fold")  # a row a fold
    row = F.struct("timestamp", "seq", F.coalesce("dense", F.col("top") + 1).cast("long").alias("kc"), F.col("correct").cast("int").alias("y"), "item_id", "kc_id")
    by = rows.groupBy("fold", "user_id", "split").agg(F.sort_array(F.collect_list(row)).alias("s"))
    part = lambda c: F.transform("s", lambda x: x[c]).alias(c)
    return by.select("fold", "user_id", "split", part("kc"), part("y"), part("item_id"), part("kc_id"), F.transform("s", lambda x: x["seq"].cast("string")).alias("seq"))


def blocks_of(seqs: DataFrame) -> DataFrame:
    """(fold, split, kc, y): pieces of at most CHUNK rows of train and valid sequences."""
    at = F.explode(F.sequence(F.lit(1), F.size("kc"), F.lit(CHUNK)))
    cut = seqs.where("split <> 'test'").withColumn("at_", at)
    return cut.select("fold", "split", F.slice("kc", F.col("at_"), CHUNK).alias("kc"), F.slice("y", F.col("at_"), CHUNK).alias("y"))


def _passes(weights):
    """A function over batches of pieces: for each fold the gradient and loss of train rows, and a histogram of valid scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("fold", "split", "kc", "y"))))
            rows.sort(key=lambda r: (r[0], r[1], len(r[2])))
            at = 0
            while at < len(rows):
                fold, split = rows[at][:2]
                part = [r for r in rows[at : at + BLOCK] if r[:2] == (fold, split)]
                at += len(part)
                w = weights.value[fold]
                kc, y = padded([r[2] for r in part], 0), padded([r[3] for r in part], -1)
                own = sums.setdefault(fold, np.zeros(len(w.flat) + 2 + 2 * BUCKETS))
                if split == "train":
                    g, loss = gradient(w, kc, y)
                    own[: len(w.flat)] += g.flat
                    own[len(w.flat)] += loss
                    own[len(w.flat) + 1] += (y >= 0).sum()
                else:
                    p, _ = foretold(w, kc, y)
                    bucket = np.minimum((p * BUCKETS).astype(int), BUCKETS - 1)
                    for label in (0, 1):
                        own[len(w.flat) + 2 + label * BUCKETS :][:BUCKETS] += np.bincount(bucket[y == label], minlength=BUCKETS)
        yield pa.RecordBatch.from_pydict({"fold": pa.array(list(sums), pa.int32()), "sums": pa.array([v.tobytes() for v in sums.values()], pa.binary())})

    return run


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x) for x in table["sums"].to_pylist())
    return pa.table({"fold": table["fold"][:1].cast(pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})


def ranked(negative: np.ndarray, positive: np.ndarray) -> float:
    """AUC of a histogram of scores, those of one bucket tied; 0.5 without both classes."""
    before = np.cumsum(negative) - negative
    both = negative.sum() * positive.sum()
    return float((positive * (before + negative / 2)).sum() / both) if both else 0.5


def train(blocks: DataFrame, sizes: dict[int, tuple[int, float]], seed: int = 42, steps: int = 60, rate: float = 0.05, patience: int = 8, width: int = WIDTH) -> tuple[dict[int, Weights], list[dict[int, tuple[float, float]]]]:
    """Weights by fold and, step by step, (mean loss, valid AUC) by fold. sizes: components and mean outcome of each fold.

    Each step is a pass over all pieces and a move by Adam. A fold ends when its valid AUC has not risen by 1e-4 for
    `patience` steps and keeps the weights of its best step. The same pieces and seed give the same weights but for the
    order in which tasks' sums are added.
    """
    spark = blocks.sparkSession
    now = {fold: drawn(n, seed + 97 * fold, mean, width) for fold, (n, mean) in sizes.items()}
    moments = {fold: [np.zeros_like(w.flat), np.zeros_like(w.flat)] for fold, w in now.items()}
    best = {fold: (-1.0, w, 0) for fold, w in now.items()}
    told = []
    for step in range(1, steps + 1):
        sent = spark.sparkContext.broadcast(now)
        own = blocks.where(F.col("fold").isin(list(now))).mapInArrow(_passes(sent), "fold int, sums binary")
        part = F.spark_partition_id() % FAN
        rows = own.withColumn("part", part).groupBy("fold", "part").applyInArrow(_added, "fold int, sums binary").collect()
        sent.destroy()
        told.append({})
        for fold in list(now):
            w = now[fold]
            sums = np.sum([np.frombuffer(r.sums) for r in rows if r.fold == fold], axis=0)
            size = len(w.flat)
            auc = ranked(sums[size + 2 : size + 2 + BUCKETS], sums[size + 2 + BUCKETS :])
            told[-1][fold] = (float(sums[size] / max(1, sums[size + 1])), auc)
            if auc > best[fold][0] + 1e-4:
                best[fold] = (auc, w, step)
            elif step - best[fold][2] >= patience:
                del now[fold]
                continue
            g = sums[:size] / max(1, sums[size + 1])
            m, v = moments[fold]
            m += (1 - DECAY[0]) * (g - m)
            v += (1 - DECAY[1]) * (g * g - v)
            move = rate * (m / (1 - DECAY[0] ** step)) / (np.sqrt(v / (1 - DECAY[1] ** step)) + 1e-8)
            now[fold] = Weights(w.n, w.width, w.flat - move)
        if not now:
            break
    return {fold: w for fold, (_, w, _) in best.items()}, told


def _scored(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {c: batch.column(c) for c in ("user_id", "fold", "item_id", "kc_id", "seq", "y")}
            fold, kc, y = (batch.column(c).to_pylist() for c in ("fold", "kc", "y"))
            order = sorted(range(len(kc)), key=lambda i: (fold[i], len(kc[i])))
            out: list = [None] * len(kc)
            at = 0
            while at < len(order):
                part = [i for i in order[at : at + BLOCK] if fold[i] == fold[order[at]]]
                at += len(part)
                p, _ = foretold(weights.value[fold[part[0]]], padded([kc[i] for i in part], 0), padded([y[i] for i in part], -1))
                for column, i in enumerate(part):
                    out[i] = p[: len(kc[i]), column].tolist()
            yield pa.RecordBatch.from_pydict({**columns, "p": pa.array(out, pa.list_(pa.float64()))})

    return run


def scored(seqs: DataFrame, weights: dict[int, Weights], model: str = "dkt") -> DataFrame:
    """fold, user_id, item_id, kc_id, seq, y_true, model, y_prob of the rows of sequences, each foretold from the learner's rows before it."""
    sent = seqs.sparkSession.sparkContext.broadcast(weights)
    out = seqs.select("user_id", "fold", "kc", "item_id", "kc_id", "seq", "y").mapInArrow(_scored(sent), SCORED)
    each = out.select("fold", "user_id", F.explode(F.arrays_zip("item_id", "kc_id", "seq", "y", "p")).alias("e"))
    return each.select("fold", "user_id", "e.item_id", "e.kc_id", "e.seq", F.col("e.y").cast("long").alias("y_true"), F.lit(model).alias("model"), F.round("e.p", 9).alias("y_prob"))


def traced(tagged: DataFrame, ids: DataFrame, model: str = "dkt", **settings) -> DataFrame:
    """What scored gives for all held rows, with weights trained on the train rows and stopped by the valid ones.

    tagged has fold and split; ids numbers the components that train has. A learner's rows are one array.
    """
    seqs = stage(sequences_of(tagged, ids), "sequences")
    blocks = stage(blocks_of(seqs), "pieces")
    mean = tagged.where("split = 'train'").groupBy("fold").agg(F.avg("correct").alias("mean"))
    sizes = {r.fold: (int(r.n), float(r["mean"])) for r in ids.groupBy("fold").agg((F.max("dense") + 2).alias("n")).join(mean, "fold").collect()}  # a row a fold
    weights, _ = train(blocks, sizes, **settings)
    return scored(seqs.where("split <> 'train'"), weights, model)
