"""Findings of round 3: what failed before."""

import random
import tracemalloc

import numpy as np

from lumenlog.llm import suffix_merge, url_filter


def test_words_of_the_corpus_do_not_hang_on_its_size(spark, monkeypatch):
    """A word on enough sites stays whole, however many pairs of site and word there are."""
    monkeypatch.setattr(url_filter, "MOST_WORDS", 1, raising=False)
    urls = [f"http://s{i}.site{chr(97 + i)}.net/{word}/" for word in ("winter", "window", "twins") for i in range(4)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert {r.verdict for r in url_filter.filter_urls(df).collect()} == {"allow"}


def test_url_scores_are_those_of_one_model_of_all_words(spark):
    """Joins of names, parts and words give what a model that holds every word gives."""
    rnd = random.Random(5)
    bits = ["win", "ter", "pills", "club", "x", "zq", "news", "ads", "winter", "s", "casino", "ad", "tips", "library"]
    name = lambda: "".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 4)))
    names = [name() for _ in range(40)]
    urls = [f"http://{rnd.choice(names)}.{rnd.choice(names)}{rnd.randrange(3)}.Net/{rnd.choice(names)}/{name().upper()}-{rnd.choice(names)}" for _ in range(400)]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls + urls[:50] + [None, "", "http://"])], "page_id long, url string")
    got = url_filter.filter_urls(df).collect()
    sites: dict[str, set[str]] = {}
    for r in got:
        for word in set(url_filter._NAME.findall(f"{r.host}/{r.path}".lower())):
            sites.setdefault(word, set()).add(".".join(r.host.split(".")[-2:]))
    model = url_filter.train({w: len(s) for w, s in sites.items() if len(w) > 2 and len(s) >= url_filter.LEAST_SITES})
    assert len(got) == 453 and len(model.own) > 5
    for r in got:
        assert abs(r.score - url_filter.score(r.host, r.path, model)) < 1e-9


def test_a_block_of_suffixes_is_held_once():
    """Sorting a block takes no second copy of its rows."""
    rnd = np.random.default_rng(1)
    pieces = [(i, i, 0, rnd.integers(97, 123, 20_000, np.uint8).tobytes()) for i in range(600)]
    rows = sum(len(suffix_merge.suffix_rows([p], np.zeros(1, np.int64), 64, 50)[0]) for p in pieces[:20]) * 30
    tracemalloc.start()
    for _ in suffix_merge.sorted_runs(pieces, 0, 64, 50):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.7 * rows * 94 + 25e6, (peak, rows * 94)
