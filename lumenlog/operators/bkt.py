"""Bayesian knowledge tracing: four parameters a component, fitted by likelihood, and the belief along each learner."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.sources.staging import stage

NAMES = ("p_init", "p_learn", "p_guess", "p_slip")
START = (0.25, 0.25, 0.2, 0.2)
BOUNDS = (0.05, 0.95)
GRID = (0.1, 0.35, 0.6, 0.85)
CELLS = 1 << 20  # outcomes that are walked at once
ROUNDS = 24
TOLERANCE = 1e-5
DAMPING = (1e-4, 1e-2, 0.1, 1.0, 10.0)  # of a scoring step, for three of the points that a round tries
#: Expected counts of a component, numerator and denominator of each parameter, and its negative log likelihood.
COUNTS = ("init_n", "init_d", "learn_n", "learn_d", "guess_n", "guess_d", "slip_n", "slip_d", "nll")

UPPER = np.triu_indices(4)
WIDTH = len(COUNTS) + len(UPPER[0])


def outcomes(train: DataFrame, keys: list[str], least: int = 4) -> DataFrame:
    """(keys, kc_id, outcomes, n): the distinct outcome strings of learners on a component and how many show each."""
    by = train.groupBy(*keys, "kc_id", "user_id").agg(F.sort_array(F.collect_list(F.struct("timestamp", "seq", "correct"))).alias("s")).where(F.size("s") >= least)
    text = F.array_join(F.transform("s", lambda x: x["correct"].cast("string")), "")
    return by.groupBy(*keys, "kc_id", text.alias("outcomes")).agg(F.count("*").alias("n"))


def blocks(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, lengths, outcomes) of strings of falling length, about CELLS outcomes at a time, -1 after a string's end."""
    lengths = np.array([len(t) for t in texts])
    order, at = np.argsort(-lengths, kind="stable"), 0
    while at < len(order):
        longest = max(1, int(lengths[order[at]]))
        part = order[at : at + max(1, CELLS // longest)]
        y = np.full((longest, len(part)), -1, np.int8)
        for column, i in enumerate(part):
            y[: lengths[i], column] = np.frombuffer(texts[i].encode(), np.uint8) - ord("0")
        yield part, lengths[part], y
        at += len(part)


def losses(params: np.ndarray, texts: list[str]) -> np.ndarray:
    """Negative log likelihoods (points, strings) of each string at each row of params."""
    init, learn, guess, slip = (params[:, k, None] for k in range(4))
    out = np.zeros((len(params), len(texts)))
    for part, lengths, y in blocks(texts):
        know = np.repeat(init, len(part), 1)
        for t in range(len(y)):
            live = int(np.searchsorted(-lengths, -t, "left"))  # strings of more than t outcomes come first
            hit, before = y[t, :live] == 1, know[:, :live]
            right = before * (1 - slip) + (1 - before) * guess
            p = np.clip(np.where(hit, right, 1 - right), 1e-9, 1 - 1e-9)
            out[:, part[:live]] -= np.log(p)
            after = before * np.where(hit, 1 - slip, slip) / p
            know[:, :live] = np.clip(after + (1 - after) * learn, 1e-9, 1 - 1e-9)
    return out


def expected(params: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """COUNTS of each string of blocks at its own parameters (strings, 4), by one forward and one backward walk."""
    out = np.zeros((len(params), len(COUNTS)))
    for part, lengths, y in parts:
        init, learn, guess, slip = params[part].T
        steps, know = len(y), init.copy()
        post, chance, own = np.zeros(y.shape), np.ones(y.shape), np.zeros((len(part), len(COUNTS)))
        for t in range(steps):
            live = int(np.searchsorted(-lengths, -t, "left"))
            hit, k = y[t, :live] == 1, know[:live]
            known, not_known = np.where(hit, 1 - slip[:live], slip[:live]), np.where(hit, guess[:live], 1 - guess[:live])
            chance[t, :live] = k * known + (1 - k) * not_known
            post[t, :live] = k * known / chance[t, :live]
            know[:live] = post[t, :live] + (1 - post[t, :live]) * learn[:live]
        if_known, if_not = np.ones(len(part)), np.ones(len(part))  # of the outcomes after t, scaled by their chance
        for t in range(steps - 1, -1, -1):
            live = int(np.searchsorted(-lengths, -t, "left"))
            hit, k, u = y[t, :live] == 1, post[t, :live] * if_known[:live], (1 - post[t, :live]) * if_not[:live]
            own[:live, 4] += u * hit
            own[:live, 5] += u
            own[:live, 6] += k * ~hit
            own[:live, 7] += k
            known, not_known = np.where(hit, 1 - slip[:live], slip[:live]), np.where(hit, guess[:live], 1 - guess[:live])
            gain, stay = known * if_known[:live] / chance[t, :live], not_known * if_not[:live] / chance[t, :live]
            if t:
                before = 1 - post[t - 1, :live]
                own[:live, 2] += before * learn[:live] * gain
                own[:live, 3] += before * (learn[:live] * gain + (1 - learn[:live]) * stay)
            else:
                own[:live, 0], own[:live, 1] = k, 1
            if_known[:live], if_not[:live] = gain, learn[:live] * gain + (1 - learn[:live]) * stay
        own[:, 8] = -np.log(chance).sum(0)
        out[part] = own
    return out


def _sums(batches: Iterator[pa.RecordBatch], of) -> Iterator[pa.RecordBatch]:
    """of(batch) gives numbers (strings, width); they are summed, by counts n, over the strings of a component in a batch."""
    for batch in batches:
        n, group = np.array(batch.column("n").to_pylist(), float), batch.column("group").dictionary_encode()
        sums = np.zeros((len(group.dictionary), 0))
        if len(n):
            order = np.argsort(group.indices.to_numpy(), kind="stable")
            index = group.indices.to_numpy()[order]
            sums = np.add.reduceat((of(batch) * n[:, None])[order], np.flatnonzero(np.r_[True, index[1:] != index[:-1]]))
        width = sums.shape[1]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1) * width, pa.int32()), pa.array(sums.ravel()))
        yield pa.RecordBatch.from_arrays([group.dictionary, lists], ["group", "sums"])


def _grid_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    points = grid()
    yield from _sums(batches, lambda b: losses(points, b.column("outcomes").to_pylist()).T)


def _expected_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _sums(batches, lambda b: expected(np.array(b.column("p").to_pylist(), float).reshape(-1, 4), list(blocks(b.column("outcomes").to_pylist()))))


def grid() -> np.ndarray:
    return np.array([START, *product(GRID, repeat=4)])


def grid_start(strings: DataFrame) -> DataFrame:
    """(group, p): the point of the grid where each component's likelihood is highest, START among them, ties by order."""
    each = strings.select("group", "outcomes", "n").mapInArrow(_grid_sums, "group string, sums array<double>")
    by = each.select("group", F.posexplode("sums").alias("point", "loss")).groupBy("group", "point").agg(F.sum("loss").alias("loss"))
    points = F.array(*(F.array(*map(F.lit, map(float, p))) for p in grid()))
    return by.groupBy("group").agg(F.min(F.struct("loss", "point"))["point"].alias("point")).select("group", F.get(points, F.col("point")).alias("p"))


def counted(strings: DataFrame, state: DataFrame, at: str) -> DataFrame:
    """state (group, ..) with COUNTS at the parameters of column `at`: one pass over the strings, one aggregation.

    Strings of one component are walked by whichever tasks hold them; state, a row a component, is joined to them.
    """
    met = strings.join(state.select("group", F.col(at).alias("p")), "group").select("group", "outcomes", "n", "p")
    sums = met.mapInArrow(_expected_sums, "group string, sums array<double>")
    sums = sums.groupBy("group").agg(*(F.sum(F.col("sums")[k]).alias(c) for k, c in enumerate(COUNTS)))
    return state.drop(*COUNTS).join(sums, "group")


def improved(at: str):
    """The parameters that the expected counts make likeliest, inside BOUNDS; without any chance to learn, guess or slip the old ones."""
    part = lambda k, c: F.when(F.col(f"{c}_d") > 0, F.least(F.greatest(F.col(f"{c}_n") / F.col(f"{c}_d"), F.lit(BOUNDS[0])), F.lit(BOUNDS[1]))).otherwise(F.col(at)[k])
    return F.array(*(part(k, c) for k, c in enumerate(("init", "learn", "guess", "slip"))))


def em_round(strings: DataFrame, state: DataFrame, at: str, to: str, loss: str) -> DataFrame:
    """state with column `to`, the parameters after one round of expectation and maximisation from `at`, and the loss at `at`."""
    out = counted(strings, state, at)
    return out.select(*(F.col(c) for c in state.columns if c not in (to, loss)), improved(at).alias(to), F.col("nll").alias(loss))


def scores(counts: np.ndarray, params: np.ndarray) -> np.ndarray:
    """The gradient of each row's log likelihood, which expected counts give at the parameters they were counted at."""
    n, d = counts[:, 0:8:2], counts[:, 1:8:2]
    return n / params - (d - n) / (1 - params)


def _tried_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of COUNTS and the upper half of the scores' products, at each point of tries."""

    def of(batch: pa.RecordBatch) -> np.ndarray:
        parts, out = list(blocks(batch.column("outcomes").to_pylist())), []
        points = np.array(batch.column("tries").to_pylist(), float).reshape(batch.num_rows, -1, 4)
        for k in range(points.shape[1]):
            counts = expected(points[:, k], parts)
            g = scores(counts, points[:, k])
            out += [counts, g[:, UPPER[0]] * g[:, UPPER[1]]]
        return np.concatenate(out, 1)

    yield from _sums(batches, of)


def likelier(points: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """The likeliest of a component's points, its loss, and the points to try next, the likeliest first among them.

    sums has a row a point. What is tried: the step of expectation and maximisation, thrice that, once and three
    times more of the last step, and scoring steps (the inverse of the summed products of scores times their sum) and
    twice these, each with more damping, along what no bound holds.
    """
    at = int(sums[:, 8].argmin())
    p, counts = points[at], sums[at]
    n, d = counts[0:8:2], counts[1:8:2]
    inside = lambda x: np.clip(x, *BOUNDS)
    em = inside(np.where(d > 0, n / np.where(d > 0, d, 1), p))
    g, b = scores(counts[None, :8], p[None])[0], np.zeros((4, 4))
    b[UPPER] = counts[len(COUNTS) :]
    b = b + np.triu(b, 1).T
    free = np.flatnonzero(~(((p <= BOUNDS[0]) & (g < 0)) | ((p >= BOUNDS[1]) & (g > 0))))
    tries = [p, em, inside(p + 3 * (em - p)), inside(2 * p - points[0]), inside(4 * p - 3 * points[0])]
    for damping in DAMPING:
        step, own = np.zeros(4), b[np.ix_(free, free)]
        if len(free):
            step[free] = np.linalg.solve(own + np.diag(damping * np.diag(own) + 1e-9), g[free])
        tries += [inside(p + step), inside(p + 2 * step)]
    return p, float(counts[8]), np.array(tries)


def _next_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        groups, before = batch.column("group"), batch.column("loss").to_numpy(zero_copy_only=False)
        got = [likelier(np.array(t).reshape(-1, 4), np.array(s).reshape(-1, WIDTH)) for t, s in zip(batch.column("tries").to_pylist(), batch.column("sums").to_pylist())]
        loss = np.array([g[1] for g in got], float)
        falls = ~(before - loss <= TOLERANCE * np.maximum(1, np.abs(loss)))
        columns = [groups, pa.array([g[0].tolist() for g in got], pa.list_(pa.float64())), pa.array(loss), pa.array([g[2].ravel().tolist() for g in got], pa.list_(pa.float64())), pa.array(falls)]
        yield pa.RecordBatch.from_arrays(columns, ["group", "p", "loss", "tries", "falls"])


def likelier_round(strings: DataFrame, state: DataFrame) -> DataFrame:
    """state (group, p, loss, tries, falls) after one pass over the strings, at all points of tries.

    The points of a component are joined to its strings, wherever they lie; tasks sum what their strings expect, and
    the sums, a row a component and number, are summed again.
    """
    met = strings.join(state.select("group", "tries"), "group").select("group", "outcomes", "n", "tries")
    each = met.mapInArrow(_tried_sums, "group string, sums array<double>").select("group", F.posexplode("sums").alias("k", "v"))
    sums = each.groupBy("group", "k").agg(F.sum("v").alias("v")).groupBy("group").agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("sums"))
    sums = sums.select("group", F.transform("sums", lambda x: x["v"]).alias("sums"))
    both = state.select("group", "loss", "tries").join(sums, "group")
    return both.select("group", "loss", "tries", "sums").mapInArrow(_next_tries, "group string, p array<double>, loss double, tries array<double>, falls boolean")


def fit(train: DataFrame, keys: list[str], least_obs: int = 30, rounds: int = ROUNDS) -> DataFrame:
    """keys, kc_id, p_init, p_learn, p_guess, p_slip, nll, nll_start, n_obs of components with enough observations.

    All components at once, from the best point of a coarse grid. A round takes the expected counts and the scores of
    all strings at a few points a component and keeps the likeliest, which is never less likely than the one before;
    the step of expectation and maximisation is always tried. Components whose loss falls by less than TOLERANCE of
    itself leave. No group holds a component's strings.
    """
    name = F.concat_ws(":", *(F.col(c).cast("string") for c in (*keys, "kc_id")))
    strings = stage(outcomes(train, keys).withColumn("group", name), "outcomes")
    sizes = strings.groupBy("group", *keys, "kc_id").agg(F.sum(F.length("outcomes") * F.col("n")).alias("n_obs")).where(F.col("n_obs") >= least_obs)
    strings = stage(strings.join(sizes.select("group"), "group", "left_semi").select("group", "outcomes", "n"), "enough")
    start = F.array(*map(F.lit, START))
    state = grid_start(strings).select("group", "p", F.lit(float("inf")).alias("loss"), F.concat("p", start).alias("tries"), F.lit(True).alias("falls"))
    state = stage(state, "bkt-start")
    first = stage(counted(strings, state.select("group", start.alias("start")), "start").select("group", F.col("nll").alias("nll_start")), "bkt-first")
    ended = None
    for _ in range(rounds):
        state = stage(likelier_round(strings, state), "bkt-round")
        now = state.where("not falls").select("group", "p", "loss")
        ended = now if ended is None else ended.unionByName(now)
        state = state.where("falls")
        if state.isEmpty():
            break
    ended = ended.unionByName(state.select("group", "p", "loss"))
    return sizes.join(ended, "group").join(first, "group").select(*keys, "kc_id", *(F.col("p")[k].alias(c) for k, c in enumerate(NAMES)), F.col("loss").alias("nll"), "nll_start", "n_obs")


def em_rounds(train: DataFrame, keys: list[str], rounds: int) -> DataFrame:
    """keys, kc_id, the parameters after so many rounds from START, and nll, the loss before the last of them."""
    name = F.concat_ws(":", *(F.col(c).cast("string") for c in (*keys, "kc_id")))
    strings = stage(outcomes(train, keys).withColumn("group", name), "outcomes")
    state = strings.select("group", *keys, "kc_id").distinct().withColumn("p", F.array(*map(F.lit, START)))
    for _ in range(rounds):
        state = stage(em_round(strings.select("group", "outcomes", "n"), state, "p", "p_", "nll").withColumn("p", F.col("p_")).drop("p_"), "bkt-em")
    return state.select(*keys, "kc_id", *(F.col("p")[k].alias(c) for k, c in enumerate(NAMES)), "nll")


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds p, the probability of a right answer before each outcome of s. All sequences of a batch go one step at a time."""
    for batch in batches:
        column = lambda name: batch.column(batch.schema.names.index(name))  # noqa: E731, B023
        seqs = column("s")
        sizes = seqs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        y = seqs.flatten().to_numpy(zero_copy_only=False)
        know, learn, guess, slip, mean = (column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("p_init", "p_learn", "p_guess", "p_slip", "mean"))
        starts = np.cumsum(sizes) - sizes
        order = np.argsort(-sizes, kind="stable")
        out, longest = np.zeros(len(y)), sizes[order]
        for t in range(int(sizes.max()) if len(sizes) else 0):
            live = order[: np.searchsorted(-longest, -t, "left")]  # sequences of more than t outcomes
            at = starts[live] + t
            right = know[live] * (1 - slip[live]) + (1 - know[live]) * guess[live]
            out[at] = right
            hit = y[at] == 1
            p = np.clip(np.where(hit, right, 1 - right), 1e-9, 1 - 1e-9)
            after = know[live] * np.where(hit, 1 - slip[live], slip[live]) / p
            know[live] = np.clip(after + (1 - after) * learn[live], 1e-9, 1 - 1e-9)
        out = np.where(np.isnan(out), np.repeat(mean, sizes), out)  # components without parameters
        probs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(out))
        yield pa.RecordBatch.from_arrays([*batch.columns, probs], [*batch.schema.names, "p"])


def predict(rows: DataFrame, params: DataFrame, keys: list[str], train: DataFrame | None = None, default: float | None = None) -> DataFrame:
    """keys, user_id, kc_id, pos, y_true, y_prob: each learner's outcomes on a component foretold before it is seen.

    train: rows that each learner's belief is brought through first. params has the four parameters by keys and kc_id; a
    component without is foretold by train's mean outcome of the keys, by `default` without train (0.5 if none).
    A learner's rows on one component are one array; tasks walk the arrays of a batch side by side.
    """
    own = [*keys, "user_id", "kc_id", "timestamp", "seq", "correct"]
    each = rows.select(*own, F.lit(1).alias("held"))
    if train is not None:
        each = each.union(train.select(*own, F.lit(0)))
    seqs = each.groupBy(*keys, "user_id", "kc_id").agg(F.sort_array(F.collect_list(F.struct("held", "timestamp", "seq", "correct"))).alias("s"), F.count_if(F.col("held") == 0).cast("int").alias("before"))
    seqs = seqs.where(F.size("s") > F.col("before")).withColumn("s", F.transform("s", lambda x: x["correct"].cast("int")))
    seqs = seqs.join(params.select(*keys, "kc_id", "p_init", "p_learn", "p_guess", "p_slip"), [*keys, "kc_id"], "left")
    if train is None:
        seqs = seqs.withColumn("mean", F.lit(0.5 if default is None else default))
    else:
        mean = train.groupBy(*keys).agg(F.avg("correct").alias("mean"))
        seqs = seqs.join(F.broadcast(mean), keys, "left").withColumn("mean", F.coalesce("mean", F.lit(0.5)))  # a row a fold
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in seqs.schema.fields)
    walked = seqs.mapInArrow(_walked, f"{kinds}, p array<double>")
    out = walked.select(*keys, "user_id", "kc_id", "before", F.posexplode(F.arrays_zip(F.col("s").alias("y"), F.col("p").alias("p"))).alias("at", "e")).where("at >= before")
    return out.select(*keys, "user_id", "kc_id", (F.col("at") - F.col("before")).alias("pos"), F.col("e.y").cast("long").alias("y_true"), F.col("e.p").alias("y_prob"))
