"""The corpus operators on small fixtures: brute force, round trips, and rows that are null, empty, long or repeated."""

import base64
import collections
import hashlib
import html
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlog.llm import byte_bpe, license_scan, mixing, multi_index, ngram_jaccard, preference_quality, quality_rules, secret_scan, shared, site_style, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, component_id string, score string"
WORD = "[^\x20\x09-\x0d]+"
ODD = ["", None, " \n\t", "word", "a b", "x " * 4000, "é汉😀 ü z\x1c", "A\x0bB\x0cC\rD", "#*$%&|<> ### | |"]


def docs(spark, texts, start=0):
    """Documents with columns whose names clash with results, and nulls in the others."""
    rows = [(start + i, t, ("en", None)[i % 2], ("b", "a", None)[i % 3], None, "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words_of(text):
    return re.findall(WORD, text or "")


def prose(rnd, n, vocabulary=60):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


def near_copies(seed, families=6, copies=6, n=60):
    rnd, out = random.Random(seed), []
    for _ in range(families):
        base = prose(rnd, n, 5000).split()
        for _ in range(copies):
            text = list(base)
            for _ in range(rnd.randrange(6)):
                text[rnd.randrange(n)] = f"n{rnd.randrange(9999)}"
            out.append(" ".join(text))
    passage = prose(rnd, 50, 5000)
    out += [f"{prose(rnd, 40, 5000)} {passage}" for _ in range(8)] + out[:3] + [out[0].upper()]
    rnd.shuffle(out)
    return out


def brute_components(texts, ids, width, num, den):
    sets = {}
    for i, t in zip(ids, texts):
        w = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and den * both >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("seed,width,num,den", [(1, 3, 90, 100), (2, 5, 80, 100), (3, 1, 50, 100), (4, 3, 90, 100)])
def test_jaccard_components(spark, seed, width, num, den):
    texts = near_copies(seed) + ODD
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.jaccard_components(docs(spark, texts), width, num, den).collect()}
    assert got == brute_components(texts, range(len(texts)), width, num, den)


def test_jaccard_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "BLOCK_DOCS", 4)
    monkeypatch.setattr(ngram_jaccard, "COMMON", 64)
    texts = near_copies(9, families=3, copies=14)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.jaccard_components(docs(spark, texts), 3, 80, 100).collect()}
    assert got == brute_components(texts, range(len(texts)), 3, 80, 100)


def test_jaccard_odd_rows(spark):
    df = docs(spark, ["a b c d", "a b c d"]).union(docs(spark, ["a b c d", "p q r s"], 1)).withColumn("doc_id", F.when(F.col("text") != "p q r s", F.col("doc_id")))
    rows = ngram_jaccard.jaccard_components(df, 3, 90, 100).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows if r.doc_id is not None) == [(0, 0), (1, 0), (1, 0)]
    assert [(r.n_shingles, r.component_id) for r in rows if r.doc_id is None] == [(2, None)]
    assert ngram_jaccard.jaccard_components(df.limit(0)).count() == 0


def test_prefixes_share_tokens():
    rnd = np.random.default_rng(5)
    common = np.sort(rnd.integers(0, 1 << 62, 40).astype(np.uint64))
    for _ in range(300):
        n = int(rnd.integers(1, 80))
        a = np.unique(np.concatenate([rnd.integers(0, 1 << 62, n).astype(np.uint64), common[: n // 3]]))
        b = np.unique(np.concatenate([a[rnd.random(len(a)) > 0.1], rnd.integers(0, 1 << 62, int(rnd.integers(0, 4))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= 80 * (len(a) + len(b) - both):
            met = len(np.intersect1d(*(ngram_jaccard.prefix(x, common, 80, 100) for x in (a, b))))
            for x in (a, b):
                smallest = math.ceil(len(x) * 80 / 100)
                assert met >= min(ngram_jaccard.SHARED, math.ceil(smallest * 80 / 100))


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5), (None, 3)], "src long, dst long")
    got = {r.node: r.component for r in shared.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}
    assert shared.components(edges.limit(0)).count() == 0


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return byte_bpe.vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


def test_bpe_is_the_librarys(spark, vocabulary):
    tiktoken = pytest.importorskip("tiktoken")
    lines, pattern = vocabulary
    ranks = byte_bpe.load_ranks(lines)
    known = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(4)
    texts = ODD + ["<|endoftext|> it's 123", "a" * 5000, " 　 \x85x"] + ["".join(rnd.choice("aabeinotsrh  \n\té汉字1!ABC'") for _ in range(rnd.randrange(80))) for _ in range(300)]
    rows = {r.doc_id: r for r in byte_bpe.digests(docs(spark, texts), lines, pattern).collect()}
    for i, text in enumerate(texts):
        ids = known.encode_ordinary(text or "")
        assert (rows[i].n_tokens, rows[i].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()), text
        assert rows[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert byte_bpe.digests(docs(spark, []), lines, pattern).count() == 0
    two = byte_bpe.decode(byte_bpe.encode(docs(spark, texts), lines, pattern), lines, chunk=3)
    assert {r.doc_id: r.decoded for r in two.collect()} == {i: t or "" for i, t in enumerate(texts)}


def test_transducer_forgets_and_goes_on(vocabulary):
    lines, _ = vocabulary
    whole = byte_bpe.Transducer(byte_bpe.load_ranks(lines))
    words = sorted({prose(random.Random(i), 3, 90).replace(" ", "").encode() for i in range(300)} | {b"ab" * 400})
    expected = list(whole.encode_all(words))
    assert list(byte_bpe.Transducer(byte_bpe.load_ranks(lines), 60).encode_all(words)) == expected


def test_small_ranks():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"aa": 259}
    machine = byte_bpe.Transducer(ranks)

    def slow(data):
        parts = [bytes([x]) for x in data]
        while len(parts) > 1:
            best, at = min((ranks.get(x + y, 1 << 30), i) for i, (x, y) in enumerate(zip(parts, parts[1:])))
            if best == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    rnd = random.Random(1)
    for _ in range(500):
        data = bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(1, 14)))
        assert machine.encode(data) == slow(data)
    assert byte_bpe.load_ranks(base64.b64encode(b"ab") + b" 256\n") == {b"ab": 256}


@pytest.mark.parametrize("raw", ["aé汉😀".encode() * 3, b"\xff\xe6\xb1a\xf0\x9f", b"\xed\xa0\x80x\xc0\xaf"])
def test_utf8_machine_at_every_cut(raw):
    machine = byte_bpe.Utf8Machine()
    assert "".join(machine.feed(bytes([b])) for b in raw) + machine.close() == raw.decode("utf-8", "replace")


def test_quality_base_statistics(spark):
    rnd = random.Random(2)
    texts = ODD + ["a b c d e f g h " * 5, "l1\nl1\n \nl2\nl1", prose(rnd, 200, 3), prose(rnd, 200, 2)] + [prose(rnd, 30) for _ in range(20)]
    df = docs(spark, texts)
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    for row in quality_rules.quality_rules(df, labels).collect():
        text = texts[row.doc_id] or ""
        w = words_of(text)
        seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
        lines = [x for x in text.split("\n") if re.search(WORD, x)]
        assert row[1:6] == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
        assert row.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
        assert row.kept == (not row.base_failed)  # too few labels for any cutoff
    assert quality_rules.quality_rules(df.limit(0), labels).count() == 0


def test_binomial_tail_is_exact(spark):
    rows = [(0, 50, 0.1), (3, 100, 0.05), (20, 900, 0.03), (0, 1, 0.5), (40, 4000, 0.02)]
    got = spark.createDataFrame(rows, "k long, n long, p double").select(quality_rules.binomial_tail(F.col("k"), F.col("n"), F.col("p"))).collect()
    for (k, n, p), row in zip(rows, got):
        assert row[0] == pytest.approx(sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)), rel=1e-6)


def test_cutoffs_control_the_risk(spark):
    rnd = random.Random(8)
    rows = [("en", True, rnd.random() * 0.03, 0.0, 0.0, 0.0) for _ in range(4000)] + [("en", False, 0.3 + rnd.random() * 0.2, 0.0, 0.0, 0.0) for _ in range(300)] + [("de", True, 0.0, 0.0, 0.0, 0.0)] * 30
    df = spark.createDataFrame(rows, "stratum string, good boolean, " + ", ".join(f"{r} double" for r in quality_rules.RULES))
    got = {r.stratum: r.cutoffs for r in quality_rules.choose_cutoffs(df, 0.02, 0.05).collect()}
    assert got["en"]["symbol_share"] == 0.3 or 0.03 <= got["en"]["symbol_share"] <= 0.3
    assert "de" not in got


def test_license_scan(spark):
    texts = ODD + ["Prose here.\nReleased under the MIT License.\nMore.", "licensed under the apache license version 2 0", "Licensed under CC BY-NC 4.0.", "Licensed by nobody at all under the sun.", license_scan.TEMPLATES[2][1]]
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs(spark, texts)).collect()}
    assert [got[i].license for i in range(len(ODD), len(texts))] == ["MIT", "Apache-2.0", "CC-BY-NC-4.0", None, "MIT"]
    assert all(got[i].license is None and got[i].similarity == 0 for i in range(len(ODD)))
    for name, text in license_scan.TEMPLATES:
        size = len(license_scan.template_bigrams(text))
        low, high = license_scan.size_bounds(size, 0.8)
        assert 2 * min(low, size) / (low + size) >= 0.8 - 1e-9 > 2 * (low - 1) / (low - 1 + size)
        assert 2 * size / (high + size) >= 0.8 - 1e-9 > 2 * size / (high + 1 + size)
    assert license_scan.scan_licenses(docs(spark, [])).count() == 0


def test_notices_are_found_among_other_words(spark):
    wrapped = lambda text: "\n * ".join(re.findall(r".{1,30}(?:\s|$)", text))
    names = [n for n, _ in license_scan.TEMPLATES]
    texts = [f"Some code here.\n{wrapped(t)}\nint main() and {prose(random.Random(1), 300)}" for _, t in license_scan.TEMPLATES]
    texts += ["2020 Jane Doe. Licensed under CC BY 4.0.", f"{prose(random.Random(2), 200)} Licensed under CC BY 4.0. {prose(random.Random(3), 200)}", "Licensed under nobody. " * 50]
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs(spark, texts)).collect()}
    for i, name in enumerate(names):
        assert name in got[i].licenses.split(",") and got[i].similarity == 1
    assert [got[len(names) + i].license for i in range(3)] == ["CC-BY-4.0", "CC-BY-4.0", None]


def fill(capacity, weight, budget):
    got, open_ = dict.fromkeys(capacity, 0.0), set(capacity)
    while budget > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        share = {s: budget * weight[s] / total for s in open_}
        budget = 0.0
        for s in sorted(open_):
            take = min(share[s], capacity[s] - got[s])
            got[s] += take
            budget += share[s] - take
        open_ = {s for s in open_ if capacity[s] - got[s] > 1e-9}
    return got


def test_mixing(spark):
    rnd = random.Random(6)
    texts = [prose(rnd, rnd.randrange(1, 400)) for _ in range(150)] + ODD
    df = docs(spark, texts)
    rows = mixing.mix(df).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(df.repartition(3)).collect()))
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    for r in rows:
        assert r.size == len(words_of(texts[r.doc_id])) and 0 <= r.taken <= 2 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    order = ["a", "b", None]
    expected = fill({str(s): 2.0 * sizes[s] for s in order}, dict(zip(map(str, order), (5, 2, 1))), 1.5 * sum(sizes.values()))
    for s in order:
        assert target[s] == pytest.approx(expected[str(s)]) and abs(taken[s] - target[s]) <= 2 * mixing.BLOCK_WORDS
    assert mixing.mix(docs(spark, [])).count() == 0
    assert [r.taken for r in mixing.mix(docs(spark, [None, ""])).collect()] == [0, 0]


def test_blocks_are_permuted(spark):
    draws = [F.lit(d) for d in (3, 77, 12, 40, 9)]
    for n in (1, 2, 97, 131072):
        own = [d % n for d in draws]
        places = spark.range(n).select("id", mixing.permuted(F.col("id"), F.lit(n), own).alias("at")).cache()
        assert places.select("at").distinct().count() == n and tuple(places.agg(F.min("at"), F.max("at")).first()) == (0, n - 1)
        if n == 131072:  # the first places are no run or lattice of blocks
            picked = sorted(r.id for r in places.where("at < 1000").collect())
            assert len({b - a for a, b in zip(picked, picked[1:])}) > 20


def test_many_empty_texts_are_many_shards(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_ROWS", 20)
    df = docs(spark, [None, "", "a b c"] * 60)
    rows = mixing.mix(df).collect()
    assert len(rows) == 180 and all(0 <= r.taken <= 2 * r.size for r in rows)
    assert sum(r.taken for r in rows) == pytest.approx(1.5 * sum(r.size for r in rows), abs=2 * mixing.BLOCK_WORDS)


def test_apportionment_is_highest_quotients(spark):
    rnd = random.Random(5)
    for n, seats in ((1, 7), (5, 3), (9, 40), (20, 400)):
        votes = {i: float(rnd.randrange(1, 1000)) for i in range(n)}
        df = spark.createDataFrame([(k, v, seats) for k, v in votes.items()], "key int, votes double, seats long")
        got = {r.key: r.quota for r in mixing.apportion(df, [], "key", "votes", "seats").collect()}
        expected = dict.fromkeys(votes, 0)
        for _ in range(seats):
            expected[min(votes, key=lambda k: (-votes[k] / (2 * expected[k] + 1), k))] += 1
        assert got == expected


def test_url_parts_and_rules(spark):
    urls = ["http://a.example.org/es/x", "https://example.org/en/1?q", "http://X.Com/fr/", "http://x.com/de/a", "http://y.org", None, "nothing", "http://b.net/p?u=://z#f", "ftp://notorg/x", "http://casinowin.net/", "http://m.cheap-pills.net/a", "http://tiontion.net/en/5"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df).collect()}
    assert got[0] == ("a.example.org", "/es/x", "example.org/es/", "block") and got[1][2:] == ("example.org/en/1", "block")
    assert got[2] == ("x.com", "/fr/", "com/fr/", "allow") and got[3][2:] == ("com/de/", "block")
    assert got[4] == ("y.org", "", None, "allow") and got[5] == got[6] == ("", "", None, "allow")
    assert got[7][:3] == ("b.net", "/p", None) and got[8][2] is None
    assert [got[i][3] for i in (9, 10, 11)] == ["block", "block", "allow"]
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_segmentation():
    model = url_filter.train({})
    assert url_filter.segment("cheappillsonline", model) == ["cheap", "pills", "online"]
    assert url_filter.segment("zqxzqx", model) == ["zqxzqx"] and url_filter.segment("", model) == []


@pytest.mark.parametrize("seed", range(3))
def test_segmentation_and_score_are_the_best_of_all(seed):
    """Of all splits of a name the cheapest, and the score from the counts of the example names."""
    rnd = random.Random(seed)
    model = url_filter.train({"casinos": 9, "winter": 30, "pill": 4, "ter": 3})

    def price(parts):
        return sum(model.cost[w] if w in model.cost else model.unknown * len(w) for w in parts)

    for _ in range(60):
        name = "".join(rnd.choice(["win", "ter", "pills", "club", "x", "zq", "news", "ads", "winter", "s"]) for _ in range(rnd.randrange(1, 4)))[:12]
        cuts = [[name[a:b] for a, b in zip((0, *at), (*at, len(name)))] for n in range(len(name)) for at in itertools.combinations(range(1, len(name)), n)]
        got = url_filter.segment(name, model)
        assert "".join(got) == name
        if name not in model.own:
            assert price(got) == pytest.approx(min(map(price, cuts)))
    block, allow = ([w for site in sites for w in site.split()] for sites in (url_filter.BLOCK_SITES, url_filter.ALLOW_SITES))
    known = set(block) | set(allow)
    odds = lambda w: math.log((block.count(w) + 1) / (len(block) + len(known)) / ((allow.count(w) + 1) / (len(allow) + len(known))))
    expected = math.log(0.4 / 0.6) + odds("casino") + odds("library") + odds("pills")
    assert url_filter.score("www.casino-library.com", "/pills/zq", model) == pytest.approx(expected)


def test_words_of_the_corpus_stay_whole(spark):
    clean = ["winter", "window", "between", "alphabet", "population", "together", "hotel", "both", "twins", "uploads"]
    urls = [f"http://s{i}.site{chr(97 + i)}.net/{word}/" for word in clean for i in range(4)]
    urls += [f"http://onlinecasino.{end}/" for end in ("com", "net", "info", "biz")] + ["http://casinowinter.net/", "http://winterwindow.net/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(df).collect()}
    assert [got[i] for i in range(len(urls))] == ["allow"] * 40 + ["block"] * 5 + ["allow"]


PAGES = "page_id long, url string, html string, text string"


def test_main_text(spark):
    body = "<nav>menu</nav><div class='ad'>buy</div><article><header><h1>T &amp; t</h1></header><p>One <b>t</b>wo<p>three\n four<br>five<aside>no</aside><script>var x='</p>'</script></article><div id='comments'><p>c</p></div><footer>f</footer>"
    loose = "<div class='content'><p>Own {0}</p></div><div><p>Same everywhere</p></div>"
    rows = [(0, "http://a.org/1", f"<html><head><title>x</title></head><body>{body}</body></html>", None), (1, None, None, None), (2, "http://a.org/2", "", None), (3, "http://a.org/3", "plain text", None), (4, "x", "<p>a < b &lt; c <em>d", None)]
    rows += [(10 + i, "http://B.org/x", loose.format(i), None) for i in range(10)]
    rows += [(30, "http://c.org/", "<div class='page has-sidebar'><div class=sidebar>s</div><main><p>kept</main></div>", None), (31, "http://c.org/", "<p>only</p><div id=comments><article class=comment>no</article></div><div role=complementary>no</div>", None)]
    got = {r.page_id: r for r in site_style.main_texts(spark.createDataFrame(rows, PAGES)).collect()}
    assert (got[30].text, got[31].text) == ("kept", "only")
    assert got[0].text == "T & t One two three four five" and got[0].n_chars == len(got[0].text)
    assert [got[i].text for i in (1, 2, 3, 4)] == ["", "", "plain text", "a < b < c d"]
    assert [got[10 + i].text for i in range(10)] == [f"Own {i}" for i in range(10)]
    assert site_style.main_texts(spark.createDataFrame([], PAGES)).count() == 0


@pytest.mark.parametrize("name", ["book review", "product-reviews", "comments-off post", "search results side"])
def test_names_do_not_empty_a_page(name):
    html = f"<nav>Home</nav><p>Hi</p><section class='{name}'><p>The body of the text, all of it.</p><div class='comments'>Nice</div></section><div class='ad'>Buy</div><footer>x</footer>"
    assert [b.text for b in site_style.page_blocks(html)[0]] == ["Hi", "The body of the text, all of it."]
    article = f"<article>The text.</article><section class='{name}'><p>{'Other words. ' * 20}</p></section>"
    assert [b.text for b in site_style.page_blocks(article)[0]] == ["The text."]


@pytest.mark.parametrize("name", ["comments", "comment-list", "cookie-notice", "cookies", "gdpr-banner", "post comments"])
def test_remarks_and_notices_go_whatever_their_length(name):
    page = f"<p>Ten words of a post.</p><div class='{name}'>{'<p>A remark that goes on.</p>' * 80}</div>"
    assert [b.text for b in site_style.page_blocks(page)[0]] == ["Ten words of a post."]


def test_many_low_branches_are_sent_by_page(spark, monkeypatch):
    rows = [(i % 30, f"http://a{i % 3}.org/{i}", f"<div><p>Own {i} words</p></div><div><p>Same on site {i % 3}</p></div>", None) for i in range(30)] * 2 + [(None, None, None, None)] * 2
    df = spark.createDataFrame(rows, PAGES)
    few = sorted(site_style.main_texts(df).collect(), key=str)
    monkeypatch.setattr(site_style, "FEW_LOW", 0)
    assert sorted(site_style.main_texts(df).collect(), key=str) == few and len(few) == 62
    assert {r.text for r in few} == {f"Own {i} words" for i in range(30)} | {""}


def test_pages_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in site_style.main_texts(pages).collect()}
    for r in pages.collect():
        inside = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        assert got[r.page_id] == " ".join(html.unescape(re.sub("<[^>]+>", lambda m: "" if re.match("</?b>", m[0]) else " ", inside)).split())


def test_articles_are_pruned_and_not_the_only_text(spark):
    page = "<article><p>Own {0}</p><div><p>The same notice</p></div></article><div><p>Outside {0}</p></div><div><p>Again outside</p></div>"
    rows = [(i, f"http://a.org/{i}", page.format(i), None) for i in range(12)]
    rows += [(20, "http://b.org/", "<article><p>Teaser</p></article><div><p>The body</p></div>", None)]
    rows += [(30 + i, f"http://c.org/?session={i}", "<article><p>One page</p></article>", None) for i in range(12)]
    got = {r.page_id: r.text for r in site_style.main_texts(spark.createDataFrame(rows, PAGES)).collect()}
    assert [got[i] for i in range(12)] == [f"Own {i} Outside {i}" for i in range(12)]
    assert got[20] == "Teaser The body" and {got[30 + i] for i in range(12)} == {"One page"}


#: The contract's expressions; a group too short is found and dropped.
BASE = {"assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), "access": ("AKIA[A-Z0-9]+", 0, 20), "hex": ("[0-9a-f]+", 0, 24)}


def test_secrets(spark):
    rnd = random.Random(3)
    pieces = ["token=", "PASSWORD: ", "api_key = '", "secret", "passwd", "abcdef", "AKIA", "ABCDEFGHIJKLMNOPQRST", "0123456789abcdef", "é", "😀", " ", '"', ":", "=", "x"]
    texts = ODD + ["".join(rnd.choice(pieces) for _ in range(rnd.randrange(40))) for _ in range(300)] + [" ".join(f"token=abcdef{i}" for i in range(500)), "secret=token:abcdefgh", "ghp_" + "z" * 36]
    found = secret_scan.find_secrets(docs(spark, texts))
    got = found.select("doc_id", secret_scan.joined_spans(secret_scan.RULES, True).alias("base"), secret_scan.joined_spans(secret_scan.RULES, False).alias("all"))
    for row in got.collect():
        spans = []
        for at, (kind, (pattern, group, least)) in enumerate(BASE.items()):
            spans += [(m.start(), at, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, texts[row.doc_id] or "") if len(m[group]) >= least]
        assert row.base == ",".join(s[2] for s in sorted(spans)), texts[row.doc_id]
        assert set(filter(None, row.base.split(","))) <= set(row.all.split(","))
    clean = {r.doc_id: r.text for r in secret_scan.redact(found).collect()}
    assert clean[len(texts) - 1] == "[forge]" and "token=abcdef4" not in clean[len(texts) - 3]
    assert secret_scan.find_secrets(docs(spark, [])).count() == 0


def test_private_keys_are_redacted_whole(spark):
    head, body, end = "-----BEGIN RSA PRIVATE KEY-----", "\n".join(["MIIEowIBAAKCAQEAabcd" * 3] * 30), "-----END RSA PRIVATE KEY-----"
    texts = [f"a\n{head}\n{body}\nab==\n{end}\nb", f"a\n{head}\n{body}\nab==\nb c", f"{head} and {head}\n{body}\n{end} c", head + " long text" * 20000, f"{head}\n{body * 50}\n{end}"]
    found = secret_scan.find_secrets(docs(spark, texts))
    clean = {r.doc_id: r.text for r in secret_scan.redact(found).collect()}
    assert [clean[i] for i in range(5)] == ["a\n[pem]\nb", "a\n[pem]\nb c", "[pem] and [pem] c", "[pem]" + " long text" * 20000, "[pem]"]


def test_trigram_queries():
    assert secret_scan.trigram_query("[0-9a-f]{24,}") == frozenset([frozenset()])
    assert secret_scan.trigram_query("AKIA[A-Z0-9]{16,}") == frozenset([frozenset({"aki", "kia"})])
    assert frozenset({"tok", "oke", "ken"}) in secret_scan.trigram_query(secret_scan.RULES[0].pattern)
    for rule in secret_scan.RULES:
        assert len(secret_scan.trigram_query(rule.pattern)) <= secret_scan.MOST_STRINGS


def test_preference_quality(spark):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in preference_quality.quality_scores(documents, labels).collect()}
    known = {r.doc_id: r.quality for r in labels.collect()}
    held = [i for i in known if got[i].held_out]
    assert np.mean([got[i].predicted == known[i] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    odd = preference_quality.quality_scores(docs(spark, ODD).withColumn("doc_id", F.when(F.col("doc_id") > 2, F.col("doc_id"))), labels.limit(0)).collect()
    assert len(odd) == len(ODD) and {r.predicted for r in odd} == {1}
    assert preference_quality.quality_scores(docs(spark, []), labels).count() == 0


def plain_features(text):
    text = text or ""
    w, n = words_of(text), max(1, len(text))
    share = lambda characters: math.sqrt(sum(text.count(c) for c in characters) / n)
    size = max(1, len(w))
    same = sum(a == b for a, b in zip(w, w[1:]))
    upper = sum(c.isupper() for c in text)
    return [math.log1p(len(w)), share("#*$%&<>"), share("|"), share("!"), math.sqrt(upper / n), share("0123456789"), math.sqrt(same / size), max(1, len(set(w))) / size, min(len(text) / size, 40) / 40, share("\n")]


def test_quality_scores_are_recomputed(spark):
    """Features, weights, threshold and scores in NumPy; ties at the threshold, repeated rows and ids, clashing labels."""
    rnd = random.Random(8)
    texts = [prose(rnd, rnd.randrange(5, 60)) + (" !!" * (i % 3 == 0) * 5) + " |" * (i % 7) for i in range(120)] + ODD
    df = docs(spark, texts).union(docs(spark, texts[:4]))
    labels = spark.createDataFrame([(i, int(i % 3 > 0), "x", 1) for i in range(120)] + [(5, 1, "x", 1), (None, 1, "x", 1), (7, None, "x", 1)], "doc_id long, quality int, text string, score int")
    got = preference_quality.quality_scores(df, labels, keep=("score",)).collect()
    assert len(got) == len(texts) + 4 and got[0].score != "clash"
    words = sorted({w for t in texts for w in words_of(t)})
    of = {r.w: r.b for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", preference_quality.bucket(F.col("w")).alias("b")).collect()}
    x = []
    for t in texts:
        n = np.bincount([of[w] for w in words_of(t)], minlength=preference_quality.BUCKETS).astype(float) if words_of(t) else np.zeros(preference_quality.BUCKETS)
        x.append([*plain_features(t), *(n / max(1, n.sum()))])
    x = np.array(x)
    train = [i for i in range(120) if zlib.crc32(str(i).encode()) % 5]
    y = np.array([int(i % 3 > 0) for i in train])
    raw = x @ preference_quality.fit(x[train], y)
    counted = sorted([raw[i] for i in train] + [raw[i] for i in train if i < 4])
    bad = int((y == 0).sum()) + sum(i % 3 == 0 for i in train if i < 4)
    expected = 0.3 / (0.3 + 0.7 * np.exp(-(raw - (counted[bad - 1] + counted[bad]) / 2)))
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r[2] == pytest.approx(expected[r.doc_id], abs=1e-6)
    same = preference_quality.quality_scores(docs(spark, ["a b c"] * 40), spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")).collect()
    assert {(r.score, r.predicted) for r in same} == {(0.3, 1)}


VECTORS = "vec_id long, embedding array<float>, label int, kept string"


def test_near_duplicates(spark):
    rnd = np.random.default_rng(4)
    base = rnd.standard_normal((40, 16))
    rows = []
    for i in range(700):
        v = base[i % 40] + rnd.standard_normal(16) * (0.05, 0.3, 1.0)[i % 3]
        rows.append((i, [float(x) for x in v.astype(np.float32)], i % 3 if i % 50 else None))
    rows += [(1000 + k, rows[7][1], rows[7][2]) for k in range(5)]
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, [None] * 16, 1), (2004, [1.0, 2.0], 1), (2005, [2.0, 4.0], 1), (2006, [], 1), (None, rows[7][1], rows[7][2])]
    df = spark.createDataFrame([(*r, "clash") for r in rows], VECTORS)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in multi_index.near_duplicates(df).collect()}
    sound = [r for r in rows if r[1] and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    links = {r[0]: set() for r in rows}
    for a in sound:
        for b in sound:
            if a[0] != b[0] and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                    links[a[0]].add(b[0])
    found, there = sum(got[i][0] for i in links if i is not None), sum(map(len, links.values()))
    assert 0.99 * there <= found <= there
    for i in (2000, 2001, 2002, 2003, 2006):
        assert got[i] == (0, i, True)
    assert got[2005] == (1, 2004, False) and got[None][1:] == (None, None)
    if found == there:
        for i in links:
            assert i is None or got[i][0] == len(links[i])
    assert multi_index.near_duplicates(df.limit(0)).count() == 0


def test_near_duplicates_over_many_cells(spark, monkeypatch):
    """A grid of many cells, walks that leave most of it out, blocks that cut tiles; recall against all pairs."""
    monkeypatch.setattr(multi_index, "PER_CELL", 8)
    monkeypatch.setattr(multi_index, "BLOCK", 100)
    lengths = []
    fitted = multi_index.fit
    monkeypatch.setattr(multi_index, "fit", lambda *a: lengths.append(fitted(*a)) or lengths[-1])
    rnd = np.random.default_rng(9)
    base = rnd.standard_normal((400, 32))
    x = base[rnd.integers(0, 400, 4000)] + rnd.standard_normal((4000, 32)) * rnd.choice([0.1, 0.28, 1.0], (4000, 1))
    rows = [(i, [float(c) for c in v], i % 2) for i, v in enumerate(x)]
    got = {r.vec_id: r for r in multi_index.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.93) & (np.arange(4000)[:, None] % 2 == np.arange(4000) % 2) & ~np.eye(4000, dtype=bool)
    found, there = np.array([got[i].n_links for i in range(4000)]), near.sum(1)
    assert (found <= there).all() and found.sum() >= 0.97 * there.sum() > 0
    (one, two, most), = lengths
    assert len(one) * len(two) > 150 and most < len(one) * len(two)
    whole = [i for i in range(4000) if found[i] == there[i]]
    assert all(got[i].component_id <= min([i, *np.flatnonzero(near[i])]) for i in whole)


def test_walk_is_in_order_of_distance():
    rnd = np.random.default_rng(2)
    a, b = rnd.random(7), rnd.random(5)
    cells = multi_index.walk(a, b, 20)
    grid = (a[:, None] + b[None]).reshape(-1)
    assert np.allclose(np.sort(grid)[:20], grid[cells]) and len(set(cells)) == 20
