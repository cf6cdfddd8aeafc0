"""The pipeline's stages on the smallest tables, each against a brute-force version of its decision."""

import collections
import hashlib
import math
import re

import corpus_pipeline
import duckdb
import pytest

from lumenlog.llm import queries
from lumenlog.llm.mixing import mix
from lumenlog.llm.preference_quality import quality_scores

SF = "/root/testdata/sf0.001"


def shingles(text, n=5):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def test_stages(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [documents]
    for _, function in corpus_pipeline.STAGES:
        tables.append(corpus_pipeline.stage(function(spark, tables[-1], SF), "test"))
    for table in tables[1:-1]:
        assert table.columns == list(corpus_pipeline.COLUMNS)
    start, good, distinct, clean, mixed = ({r.doc_id: r for r in t.collect()} for t in tables[:5])
    scored = {r.doc_id for r in quality_scores(documents, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
    assert set(good) == scored and len(good) < len(start)
    sets = {i: shingles(r.text) for i, r in good.items()}
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {i: min(x, y) if r in (x, y) else r for i, r in root.items()}
    assert sorted(root[i] for i in distinct) == sorted(set(root.values()))  # one of each component
    assert set(clean) == set(distinct)
    secret = re.compile(r"[0-9a-f]{24,}|AKIA[A-Z0-9]{16,}")
    for i, r in clean.items():
        assert not secret.search(r.text) and r.n_chars == len(r.text)
        if not re.search(r"(?i)token|secret|passw|key|AKIA|[0-9a-f]{24,}", distinct[i].text):
            assert r.text == distinct[i].text
    taken = {r.doc_id: (r.size, r.taken) for r in mix(tables[3]).collect()}
    times = collections.Counter(r.doc_id for r in tables[4].collect())
    for i, r in clean.items():
        size, took = taken[i]
        draw = int(hashlib.md5(f"mix:copies:{i}".encode()).hexdigest()[:8], 16) / 2**32
        assert times[i] == (math.floor(took / size + draw) if size else 1) and size == len(re.findall("[^\x20\x09-\x0d]+", r.text))
    last = tables[-1].collect()
    assert len(last) == tables[4].count()
    for r in last:
        assert r.decoded_sha256 == hashlib.sha256(mixed[r.doc_id].text.encode()).hexdigest() and r.n_tokens == len(r.ids)
    assert corpus_pipeline.run(spark, SF).count() == len(last)


def test_stages_take_odd_rows(spark, tmp_path):
    """Nulls anywhere, repeated ids and rows, blank texts, clashing columns, and tables without rows."""
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(1, text, "en", "a", 5, "x"), (1, text, "en", "a", 5, "x"), (1, text + " more", None, None, None, None), (None, text, None, "a", None, None), (None, None, None, None, None, None), (2, "", "de", "b", 0, None), (3, " \n", "de", None, 2, None), (4, "key AKIA" + "A" * 20, None, "b", None, None), (4, "quite another text", None, "b", None, None)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, component_id string"
    odd = spark.createDataFrame(rows, kinds)
    labels = spark.createDataFrame([(1, 1, 0, "x"), (2, 0, None, "x"), (None, None, None, None)], "doc_id long, quality int, toxic int, text string")
    for name, table in (("documents", odd), ("labels", labels)):
        table.write.parquet(f"{tmp_path}/full/{name}.parquet")
        table.limit(0).write.parquet(f"{tmp_path}/empty/{name}.parquet")
    distinct = corpus_pipeline.keep_distinct(spark, odd, "").collect()
    assert sorted(str(r.doc_id) for r in distinct if r.text and "word1 " in r.text) in (["1"], ["None"]) and len(distinct) == 6
    clean = corpus_pipeline.redact_secrets(spark, odd, "").collect()
    assert len(clean) == len(rows) and sum(r.text == "key [access]" for r in clean) == 1 and all(r.n_chars == len(r.text) for r in clean)
    for sf in ("full", "empty"):
        out = corpus_pipeline.run(spark, f"{tmp_path}/{sf}").collect()
        assert all(r.n_tokens == len(r.ids) for r in out) and (sf == "full" or not out)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracles(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "labels", "embeddings"):
        duck.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    found = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    text = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    assert sorted(tuple(text(r[c]) for c in names) for r in df.collect()) == sorted(tuple(map(text, r)) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_rows(spark, name):
    df = queries.QUERIES[name](spark, SF)
    table = "pages" if name.startswith(("op6", "op7")) else "embeddings" if name.startswith("op10") else "documents"
    assert df.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
