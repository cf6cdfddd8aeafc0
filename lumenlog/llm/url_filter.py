"""URL filters: rules on host and path, else a naive Bayes verdict on segmented names.

Names run together in hosts and paths are split by a unigram Viterbi search: of all splits, the one whose words have
the highest product of probabilities, unknown stretches paying for each letter. A multinomial naive Bayes model then
scores the words of host and path.

The split's words are the example words and the corpus's own: what stands alone on LEAST_SITES sites at least, so that
winter is no win. A name that is made of example words only is none of them, however many sites have it.

Scale: each word is counted once a site over all pages, and none is left out for the size of the corpus. Tasks hold the
example words alone, which are parameters of fixed size. Distinct names that hold one of these meet the corpus's words by
a join of their parts, and rows meet the weights of their names by joins.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import partial
from math import log
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read, stage

#: The contract's rules as (rule, verdict).
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))

#: Example names of sites, whose words train the model; a site's words stand apart here.
BLOCK_SITES = (
    "casino bonus", "cheap meds online", "diet pills", "best bets", "sports betting tips", "poker room", "online poker",
    "slots jackpot", "lucky slots", "ad tracker", "click ads", "pop ads", "link farm", "seo spam", "viagra pharmacy",
    "pharma pills", "payday loan", "fast loans", "easy cash loan", "free porn", "adult cams", "adult movies", "sex chat", "xxx videos", "hot dating", "replica watch",
    "fake rolex", "crack warez", "free keygen", "torrent crack", "win prize", "free gift win", "bonus money", "get rich quick", "crypto bonus", "weight loss pills",
    "malware download", "phishing login", "escort girls", "gambling bet", "roulette win", "bingo bonus", "hack cheats", "traffic bot", "track pixel",
)
ALLOW_SITES = (
    "daily news", "world news", "city library", "public library", "open science", "science journal", "state university", "school district", "health center",
    "museum art", "art history", "cooking recipes", "garden club", "travel guide", "weather map", "book review", "music lessons", "film archive", "local history",
    "national park", "research institute", "medical center", "law review", "data lab", "code forum", "linux wiki", "help docs", "online course", "free library",
    "community blog", "family blog", "photo blog", "sport club", "football club", "tech blog", "game review", "job board", "city council", "animal rescue", "bird watch",
    "track field club", "farm market", "best books", "history of science", "home garden", "mail archive", "language school", "study guide",
)
PRIOR = 0.4  # of block
LEAST_SITES = 3  # that have a word of the corpus standing alone
IGNORED = frozenset("www com net org html htm php index http https".split())
_NAME = re.compile(r"[a-z]+")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a url; both empty for null or without ://."""
    known = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 1), F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 2)
    low = F.translate(rest[0], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(known, low).otherwise(F.lit("")), F.when(known, rest[1]).otherwise(F.lit(""))


def matching_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest rule whose host is the host or a parent of it and whose path begins the path, else null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, begin = rule.partition("/")
        out = F.when(((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(f"/{begin}")), F.lit(rule)).otherwise(out)
    return out


class Model(NamedTuple):
    cost: dict[str, float]  # of a known word: minus its log probability
    unknown: float  # of a letter outside known words
    weight: dict[str, float]  # log odds of block for a word
    bias: float
    longest: int  # letters of a known word
    own: frozenset[str]  # words of the corpus, which stay whole
    total: int  # of all words' counts


def _made_of(name: str, words: set[str]) -> bool:
    """Whether a name is a row of words of three letters or more."""
    ends = [True] + [False] * len(name)
    for end in range(3, len(name) + 1):
        ends[end] = any(ends[start] and name[start:end] in words for start in range(end - 2))
    return ends[-1]


def train(counts: dict[str, int], block: tuple[str, ...] = BLOCK_SITES, allow: tuple[str, ...] = ALLOW_SITES, rest: tuple[int, int | None] = (0, None)) -> Model:
    """counts: on how many sites each word stands alone in the corpus's hosts and paths.

    rest: all counts of own words that are not given, and the least of them.
    """
    of = [Counter(w for site in sites for w in site.split()) for sites in (block, allow)]
    words = sorted(set(of[0]) | set(of[1]))
    own = frozenset(w for w in counts if len(w) > 2 and not _made_of(w, set(words)))
    often = {w: counts[w] for w in own} | {w: counts.get(w, 0) + 10 for w in words}
    total = sum(often.values()) + rest[0]
    least = min(often.values()) if rest[1] is None else min(rest[1], *often.values())
    cost = {w: -log(n / total) for w, n in often.items()}
    sizes = [sum(c.values()) + len(words) for c in of]
    weight = {w: log((of[0][w] + 1) / sizes[0]) - log((of[1][w] + 1) / sizes[1]) for w in words}
    # a letter costs more than any word, so no known word is left for a part of it and a letter
    return Model(cost, 1 - log(least / total), weight, log(PRIOR / (1 - PRIOR)), max(map(len, cost)), own, total)


def segment(name: str, model: Model) -> list[str]:
    """The likeliest split of a run of letters; unknown stretches stay whole."""
    if name in model.own:
        return [name]
    best: list[tuple[float, int, bool]] = [(0.0, 0, False)]
    for end in range(1, len(name) + 1):
        choice = (best[end - 1][0] + model.unknown, end - 1, False)
        for start in range(max(0, end - model.longest), end):
            price = model.cost.get(name[start:end])
            if price is not None and best[start][0] + price < choice[0]:
                choice = (best[start][0] + price, start, True)
        best.append(choice)
    out: list[str] = []
    end, known = len(name), True
    while end:
        _, start, word = best[end]
        if out and not word and not known:
            out[-1] = name[start:end] + out[-1]
        else:
            out.append(name[start:end])
        end, known = start, word
    return out[::-1]


def name_weight(name: str, model: Model) -> float:
    """Log odds of block that a name adds; short words inside an unknown name are chance hits."""
    return sum(model.weight.get(w, 0.0) for w in segment(name, model) if len(w) > 2)


def score(host: str, path: str, model: Model) -> float:
    """Log odds of block."""
    return model.bias + sum(name_weight(name, model) for part in (host, path) for name in _NAME.findall(part.lower()) if name not in IGNORED)


def _own(words: frozenset[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (word, sites), words that are not made of the example words."""
    for batch in batches:
        yield batch.filter(pa.array([not _made_of(w, words) for w in batch.column(0).to_pylist()], pa.bool_()))


def _weighed(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, weight) of (name, parts), parts the corpus's words that lie in the name."""
    for batch in batches:
        out = []
        for name, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            cost = {p["word"]: -log(p["sites"] / model.total) for p in parts}
            out.append(name_weight(name, model._replace(cost=model.cost | cost, longest=max(model.longest, *map(len, cost)) if cost else model.longest)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["name", "weight"])


def site_words(rows: DataFrame) -> DataFrame:
    """(word, sites) of each word that stands alone in host or path on LEAST_SITES sites, a site the last two names of a host."""
    site = F.substring_index("host", ".", -2).alias("site")
    words = F.explode(F.array_distinct(F.split(F.lower(F.concat_ws("/", "host", "path")), "[^a-z]+"))).alias("word")
    counts = rows.select(site, words).where(F.length("word") > 2).distinct().groupBy("word").agg(F.count("*").alias("sites"))
    return counts.where(F.col("sites") >= LEAST_SITES)


def name_weights(names: DataFrame, own: DataFrame, model: Model) -> DataFrame:
    """(name, weight) of distinct names as the corpus's own words (word, sites) part them; the corpus's own words weigh nothing."""
    sizes = [r[0] for r in own.select(F.length("word")).distinct().sort("length(word)").collect()]  # lengths of words
    names = names.join(own.select(F.col("word").alias("name")), "name", "left_anti")
    at = names.select("name", F.explode(F.sequence(F.lit(1), F.length("name"))).alias("at"))
    parts = at.select("name", "at", F.explode(F.array(*map(F.lit, sizes)).cast("array<int>")).alias("size")).where(F.col("at") + F.col("size") <= F.length("name") + 1)
    parts = parts.select("name", F.substring("name", F.col("at"), F.col("size")).alias("word")).distinct().join(own, "word").select("name", F.struct("word", "sites").alias("part"))
    each = parts.union(names.select("name", F.lit(None).cast(parts.schema["part"].dataType))).groupBy("name").agg(F.collect_list("part").alias("parts"))
    return each.mapInArrow(partial(_weighed, model), "name string, weight double").where("weight <> 0")


def url_scores(rows: DataFrame) -> tuple[DataFrame, Column, float]:
    """(host, path, weight) of distinct urls that names weigh on, which rows may be among them, and the score of all others.

    Only a name that holds an example word has a weight.
    """
    plain = train({})
    counts = stage(site_words(rows), "words")
    own = stage(counts.mapInArrow(partial(_own, frozenset(plain.weight)), "word string, sites long"), "own-words")
    rest = own.agg(F.sum("sites"), F.min("sites")).first()
    model = train({r.word: r.sites for r in counts.where(F.col("word").isin(*plain.weight)).collect()}, rest=(rest[0] or 0, rest[1]))  # example words
    named = "|".join(sorted(w for w in plain.weight if len(w) > 2))
    lower = F.lower(F.concat_ws("/", "host", "path"))
    urls = rows.where(lower.rlike(named)).select("host", "path").distinct()
    names = F.filter(F.regexp_extract_all(lower, F.lit("([a-z]+)"), F.lit(1)), lambda name: name.rlike(named) & ~name.isin(*IGNORED))
    urls = urls.select("host", "path", F.posexplode(names).alias("at", "name"))
    weights = name_weights(urls.select("name").distinct(), own, model)
    met = urls.join(weights, "name").groupBy("host", "path").agg(F.sort_array(F.collect_list(F.struct("at", "weight"))).alias("w"))
    return met.select("host", "path", F.aggregate("w", F.lit(0.0), lambda a, x: a + x["weight"]).alias("weight")), lower.rlike(named), model.bias


def filter_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and score (log odds of block) of every row.

    Null urls and urls without :// have an empty host and path, no rule, and are allowed by the model's prior.
    Repeated rows each give a row; other columns are ignored; an empty table gives no rows.
    """
    host, path = split_url(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    weights, among, bias = url_scores(rows)
    rows = rows.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    met = rows.where(among).join(weights, ["host", "path"], "left").select(*rows.columns, "weight")
    scored = met.union(rows.where(~among).withColumn("weight", F.lit(None).cast("double"))).withColumn("score", F.lit(bias) + F.coalesce("weight", F.lit(0.0)))
    ruled = F.create_map(*(F.lit(x) for rule in rules for x in rule))
    verdict = F.coalesce(F.try_element_at(ruled, F.col("rule")), F.when(F.col("score") > 0, F.lit("block")).otherwise(F.lit("allow")))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages"))
