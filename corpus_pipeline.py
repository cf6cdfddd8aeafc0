"""Corpus pipeline: stages over documents, each a function of (spark, docs, sf_dir) that returns a DataFrame.

All stages but the last return the columns of documents. Each works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.llm import byte_bpe, mixing, ngram_jaccard, preference_quality, secret_scan
from lumenlog.llm.shared import forget, read, stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the preference ranking predicts to be good; the rejected go.

    Null and empty texts are scored like any other; each row is judged by itself, so rows that repeat share a fate.
    Without labels of both classes nothing is rejected.
    """
    scored = preference_quality.quality_scores(docs, read(spark, sf_dir, "labels"), keep=COLUMNS[1:])
    return scored.where("predicted = 1").select(*COLUMNS)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates (five-word shingles, similarity 0.8), the first row of it.

    Rows are told apart by a number of their own, so null ids are compared too, and rows that repeat an id or a whole
    row are told from each other. Texts without words are linked with nothing and all stay.
    """
    rows = stage(docs.select(F.monotonically_increasing_id().alias("row_"), *COLUMNS), "numbered")  # written, so that numbers stay the same
    placed = ngram_jaccard.jaccard_components(rows, shingle=5, num=80, den=100, id_col="row_")
    dropped = placed.where("component_id <> doc_id").select(F.col("doc_id").alias("row_"))
    return rows.join(dropped, "row_", "left_anti").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, what the secret scan finds replaced by the rule's name; a null text becomes an empty one."""
    found = secret_scan.find_secrets(docs, keep=COLUMNS[2:4])
    return secret_scan.redact(found).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: taken / size times, the fraction by a seeded draw of each document.

    Texts without words are taken once. Rows of one id draw alike.
    """
    mixed = mixing.mix(docs, keep=("text", "lang", "n_chars"))
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(F.lit(1.0))
    draw = mixing.seeded(F.lit("copies"), F.col("doc_id")) / F.lit(float(1 << 32))
    copies = F.floor(times + draw).cast("int")
    return mixed.withColumn("copy_", F.explode(F.array_repeat(F.lit(1), copies))).select(*COLUMNS)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with a digest of what they decode to; a null or empty text has no tokens."""
    import public_tokenizers

    lines = byte_bpe.vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    decoded = byte_bpe.round_trip(docs, lines, public_tokenizers.PATTERN, keep=("doc_id", "lang", "source"), words=1 << 18)  # small caches: the tasks' workers serve other stages too
    return decoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_distinct),
    ("secret scans", redact_secrets),
    ("mixing sources", mix_sources),
    ("byte-level BPE", encode_tokens),
]

#: SQL can express neither the fitted classifier nor the encoder; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each stage's table written to the shared folder and read again.

    A stage's table goes when the next one is written, so that at most two are held.
    """
    docs = read(spark, sf_dir, "documents").select(*COLUMNS)
    for at, (_, function) in enumerate(STAGES):
        before, docs = docs, function(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{at}", clean=True)
            if at:
                forget(before)
    return docs
