"""Quality scores by Bradley-Terry ranking.

Every labelled good document is preferred to every bad one; P(good over bad) = sigmoid(w . (x_good - x_bad)). The
weights minimise the logistic loss of seeded preference pairs. Features are counts of a text's surface and the shares of
its words in BUCKETS hashed buckets. The threshold is the quantile of all training rows' scores at the share of bad ones;
the score is sigmoid(w . x - threshold + logit(CUT)), so that it is at least CUT exactly at the threshold and above.

Scale: features are built-in column expressions on whole texts, one pass; what is shuffled is an id and a number for each
document, to meet its label. Fitting reads at most SAMPLE_ROWS labelled documents, drawn by a hash of their ids, one row
an id, and PAIRS pairs; the threshold is taken over all training rows, to a rank of one in RANKS.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read, sealed, stage
from .text_metrics import count_of, with_words

SAMPLE_ROWS = 20_000
PAIRS = 50_000
AT_ONCE = 2_000
RANKS = 100_000
BUCKETS = 128
CUT = 0.3
FEATURES = ("length", "symbols", "bars", "bangs", "upper", "digits", "repeats", "distinct", "long_words", "lines")


def bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def features(df: DataFrame, text_col: str, **more: Column) -> DataFrame:
    """Adds the features of each whole text, all finite, 0 for an empty text but for distinct (1); more may use words_."""
    df = with_words(df, text_col).withColumns(more)
    text, words = F.col("text_"), F.col("words_")
    df = df.withColumn("size_", F.size("words_").cast("double"))
    chars, size = F.greatest(F.length(text), F.lit(1)).cast("double"), F.greatest("size_", F.lit(1.0))
    df = df.withColumn("same_", F.size(F.filter(words, lambda w, i: F.coalesce(F.get(words, i - 1) == w, F.lit(False)))).cast("double"))
    root = lambda part: F.sqrt(part / chars)  # noqa: E731  shares near 0 count for more
    return sealed(
        df.withColumn("length", F.log1p("size_"))
        .withColumn("symbols", root(count_of(text, "#*$%&<>")))
        .withColumn("bars", root(count_of(text, "|")))
        .withColumn("bangs", root(count_of(text, "!")))
        .withColumn("upper", root(F.regexp_count(text, F.lit(r"\p{Lu}"))))
        .withColumn("digits", root(count_of(text, "0123456789")))
        .withColumn("repeats", F.sqrt(F.col("same_") / size))
        .withColumn("distinct", F.greatest(F.size(F.array_distinct(words)), F.lit(1)) / size)
        .withColumn("long_words", F.least(F.length(text) / size, F.lit(40.0)) / 40)
        .withColumn("lines", root(count_of(text, "\n")))
        .drop("text_", "words_", "size_", "same_")
    )


def fit(x: np.ndarray, y: np.ndarray, seed: int = 11, rounds: int = 30) -> np.ndarray:
    """Weights of the features and buckets; zeros where only one class is known."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    w = np.zeros(x.shape[1])
    if not len(good) or not len(bad):
        return w
    draw = np.random.default_rng(seed)
    scale = x.std(0)
    scale[scale == 0] = 1
    l2 = np.where(np.arange(len(w)) < len(FEATURES), 1e-3, 3e-2)  # words are many and each tells little
    better, worse = draw.choice(good, PAIRS), draw.choice(bad, PAIRS)
    for _ in range(rounds):  # Newton steps on the mean logistic loss
        gradient, hessian = l2 * w, np.diag(l2)
        for at in range(0, PAIRS, AT_ONCE):  # the driver holds the differences of these pairs only
            d = (x[better[at : at + AT_ONCE]] - x[worse[at : at + AT_ONCE]]) / scale
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
            gradient -= p @ d / PAIRS
            hessian += (d * (p * (1 - p))[:, None]).T @ d / PAIRS
        move = np.linalg.solve(hessian, gradient)
        w -= move / max(1.0, np.abs(move).max())
        if np.abs(move).max() < 1e-6:
            break
    return w / scale


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def known_quality(labels: DataFrame) -> DataFrame:
    """(doc_id, quality): the lowest label of each id that is not held out."""
    known = labels.where("doc_id is not null and quality is not null").where(~held_out())
    return known.groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column's bucket numbers as shares of BUCKETS buckets."""
    for batch in batches:
        shares = []
        for found in batch.column(batch.num_columns - 1):
            n = np.bincount(found.values.to_numpy(zero_copy_only=False), minlength=BUCKETS).astype(float)
            shares.append(n / max(1.0, n.sum()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(shares, pa.list_(pa.float64()))], [*batch.schema.names[:-1], "shares"])


def train(docs: DataFrame, known: DataFrame, sample: int = SAMPLE_ROWS) -> np.ndarray:
    """Weights from the labelled rows of at most `sample` ids, one row an id."""
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # at most `sample` ids
    x = features(rows, "text", buckets_=F.transform("words_", bucket)).select("doc_id", "quality", F.array(*FEATURES).alias("x"), "buckets_")
    x = x.mapInArrow(_counted, "doc_id long, quality int, x array<double>, shares array<double>")
    one = x.groupBy("doc_id").agg(F.min(F.struct("quality", "x", "shares")).alias("row")).orderBy("doc_id")
    got = one.select("row.quality", F.concat("row.x", "row.shares").alias("x")).toArrow()
    flat = got.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False) if len(got) else np.zeros(0)
    return fit(flat.reshape(len(got), len(FEATURES) + BUCKETS), got.column("quality").to_numpy())


def cut_at(scored: DataFrame, known: DataFrame) -> float:
    """The middle between the scores around the quantile of the training rows' scores at the share of bad ones.

    Exact up to RANKS training rows, beyond that to a rank of one in RANKS. 0 where one class has no row, or no row is there.
    """
    rows = scored.join(known, "doc_id").select("raw_", "quality")
    n, bad = rows.agg(F.count("*"), F.count_if(F.col("quality") == 0)).first()
    if not bad or bad == n:
        return 0.0
    below, above = rows.agg(F.percentile_approx("raw_", [bad / n, min(1.0, (bad + 1) / n)], RANKS)).first()[0]
    return (below + above) / 2


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, and the columns of keep.

    A null text is empty and is scored like any text; a null id is not held out. Labels with a null id or quality are
    unused, the lowest of several labels of an id is used; of rows that repeat a labelled id one trains and all count
    for the threshold. Scores equal to the threshold are CUT and predict 1. With labels of one class only, every score
    is CUT. Other columns are ignored; an empty table gives no rows.
    """
    known = stage(known_quality(labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality")), "known")
    weights = train(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), known)
    row = docs.select(F.col(id_col).alias("doc_id_"), F.col(text_col).alias("input_"), F.struct(F.lit(0).alias("_"), *keep).alias("keep_"))
    table = F.array(*(F.lit(float(w)) for w in weights[len(FEATURES) :]))
    lexical = F.aggregate("words_", F.lit(0.0), lambda a, w: a + F.get(table, bucket(w))) / F.greatest(F.size("words_"), F.lit(1))
    x = features(row, "input_", lexical_=lexical)
    raw = sum((F.col(f) * F.lit(float(w)) for f, w in zip(FEATURES, weights)), F.col("lexical_"))
    x = stage(x.select("doc_id_", "keep_", raw.alias("raw_")), "scores")
    threshold = cut_at(x.select(F.col("doc_id_").cast("long").alias("doc_id"), "raw_"), known)
    over = F.greatest(F.least(F.col("raw_") - F.lit(threshold), F.lit(500.0)), F.lit(-500.0))
    # one division, so that a raw value at the threshold gives CUT itself
    score = F.when(over == 0, F.lit(CUT)).otherwise(F.lit(CUT) / (F.lit(CUT) + F.lit(1 - CUT) * F.exp(-over)))
    x = x.withColumn("score_", score)
    return x.select(F.col("doc_id_").alias("doc_id"), held_out("doc_id_").alias("held_out"), F.col("score_").alias("score"), (F.col("score_") >= CUT).cast("int").alias("predicted"), *(F.col("keep_")[c].alias(c) for c in keep))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
