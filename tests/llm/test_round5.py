"""The pipeline's disk, which its check found too much: what failed before."""

import random
import re
from pathlib import Path

import pytest

from lumenlog.llm import mixing, ngram_jaccard
from lumenlog.llm.shared import forget, scratch, stage


def staged(spark) -> set[Path]:
    return set(Path(scratch(spark).removeprefix("file://")).glob("*"))


def test_mix_stages_no_text_and_shuffles_it_once(spark):
    rnd = random.Random(3)
    text = lambda: " ".join(f"{rnd.getrandbits(64):x}" for _ in range(600))
    docs = spark.createDataFrame([(i if i % 9 else None, text(), "abc"[i % 3] if i % 7 else None) for i in range(200)], "doc_id long, text string, source string")
    before = staged(spark)
    mixed = mixing.mix(docs, keep=("text",))
    plan = mixed._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert len(re.findall(r"\(\d+\) Exchange\nInput[^\n]*_text#", plan)) == 1
    assert mixed.count() == 200 and {r.text for r in mixed.collect()} == {r.text for r in docs.collect()}
    assert sum(f.stat().st_size for d in staged(spark) - before for f in d.glob("*.parquet")) < 100_000  # the texts have 2 MB


def test_tables_of_tokens_go_when_they_have_been_used(spark):
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join(words + [f"x{i}"] * (i % 3))) for i in range(30)] + [(99, "quite another text of some words")], "doc_id long, text string")
    before = staged(spark)
    found = {r.doc_id: r.component_id for r in ngram_jaccard.jaccard_components(docs, shingle=3, num=90, den=100).collect()}
    assert found == {i: 0 for i in range(30)} | {99: 99}
    left = [d.name.split("-")[0] for d in staged(spark) - before]
    assert not {"prefixes", "met", "hits", "edges"} & set(left) and left.count("star") == 1


def test_only_staged_tables_are_forgotten(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/given")
    with pytest.raises(ValueError):
        forget(spark.read.parquet(f"{tmp_path}/given"))
    assert spark.read.parquet(f"{tmp_path}/given").count() == 5
    before = staged(spark)
    some = stage(spark.range(5), "some")
    assert all(f.endswith(".zstd.parquet") for f in some.inputFiles())
    forget(some)
    assert staged(spark) == before
