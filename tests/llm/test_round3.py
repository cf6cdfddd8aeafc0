"""Conversation repair, Merkle manifest and suffix merge on small fixtures: brute force, SQL, and odd rows."""

import hashlib
import itertools
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlog.llm import merkle, multi_index, ngram_jaccard, suffix_merge, turn_repair

DOCS = "doc_id long, text string, lang string, source string, n_chars long, root string, spans string"
TURNS = "conv_id long, turn long, role string, text string, cost long, gone_ string"


def same_rows(spark, got, sql, **tables):
    """Whether the rows of a DataFrame are those of DuckDB SQL over the given DataFrames."""
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    result = con.sql(sql)
    names = sorted(got.columns)
    assert sorted(result.columns) == names
    order = [list(result.columns).index(n) for n in names]
    want = [tuple(r[k] for k in order) for r in result.fetchall()]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r[n] for n in names)) for r in got.collect())


# conversations


def least_repair(turns):
    """(cost, audit, repaired) of (role, text, faulty, truncated) turns, by trying all edits, at most two inserts in a place."""
    best = None
    for inserts in itertools.product(range(3), repeat=len(turns) + 1):
        for edits in itertools.product("DKR", repeat=len(turns)):
            cost, audit, said, ok = 3 * sum(inserts), "", [], True
            for k in range(len(turns) + 1):
                for _ in range(inserts[k]):
                    audit += "I"
                    said.append(("a" if said and said[-1][0] == "u" else "u", ""))
                if k == len(turns):
                    break
                role, text, faulty, truncated = turns[k]
                audit += edits[k]
                if edits[k] == "D":
                    cost += 4
                    continue
                ok &= not faulty
                cost += 3 * truncated
                after = "a" if said and said[-1][0] == "u" else "u"
                if edits[k] == "R":
                    cost += 3
                    said.append((after, text))
                else:
                    ok &= role != ""
                    said.append((role[:1], text, role))
            initials = "".join(s[0] for s in said)
            rest = initials[1:] if initials[:1] == "s" else initials
            ok &= initials == "" or (rest != "" and rest == "ua" * (len(rest) // 2))
            if ok and (best is None or (cost, audit) < best[:2]):
                names = {"u": "user", "a": "assistant"}
                best = cost, audit, "\n".join(f"{s[2] if len(s) > 2 else names[s[0]]}:{s[1]}" for s in said)
    return best


@pytest.mark.parametrize("seed", range(4))
def test_repairs_are_the_cheapest_of_all(seed):
    rnd = random.Random(seed)
    for _ in range(12):
        turns = [(rnd.choice(("user", "assistant", "system", "tool", "")), rnd.choice(("a.", "b")), rnd.random() < 0.2, rnd.random() < 0.3) for _ in range(rnd.randrange(5))]
        paths = turn_repair.begun()
        for turn in turns:
            paths = turn_repair.advanced(paths, *turn)
        best = min((paths[s] for s in (turn_repair.START, turn_repair.ASSISTANT) if paths[s]), key=turn_repair.Path.key)
        cost, audit, text = least_repair(turns)
        assert (best.cost, best.audit(), best.digest.hexdigest()) == (cost, audit, hashlib.sha256(text.encode()).hexdigest())


def test_long_audits_are_kept_in_pieces():
    paths = turn_repair.begun()
    for k in range(20_000):
        paths = turn_repair.advanced(paths, "user", f"{k}.", False, False)
    best = min((paths[s] for s in (turn_repair.START, turn_repair.ASSISTANT)), key=turn_repair.Path.key)
    assert best.audit() == "KR" * 10_000 and best.cost == 30_000
    assert max(len(p.rest) for p in paths if p) <= 2


def odd_turns(spark):
    rnd = random.Random(5)
    rows = [(c, rnd.choice((None, *range(9))) if c % 3 == 0 else t, rnd.choice(("user", "assistant", "system", None, "")), rnd.choice(("Yes.", "No", "", None, " \t", "é?", "Long " * 900 + "!")), 7, None) for c in range(60) for t in range(rnd.randrange(1, 8))]
    rows += [(None, 1, "user", "A.", 0, None), (None, None, "assistant", "B.", 0, None), (None, None, None, None, None, None), (77, 2, "user", "X.", 1, None), (77, 2, "user", "X.", 1, None)]
    return spark.createDataFrame(rows, TURNS)


def test_repair_is_the_sqls(spark):
    turns = odd_turns(spark)
    same_rows(spark, turn_repair.repair(turn_repair.damaged(turns)), turn_repair.OP11_SQL, conversations=turns)
    empty = turns.where("false")
    assert turn_repair.repair(turn_repair.damaged(empty)).count() == 0


def test_conversations_of_dropped_turns_are_kept(spark):
    gone = next(c for c in range(999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = turn_repair.repair(turn_repair.damaged(spark.createDataFrame([(gone, 0, "user", "A.", 0, None)], TURNS))).first()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repaired_turns_have_the_digest(spark):
    turns = turn_repair.damaged(odd_turns(spark)).where("not gone").drop("gone", "times_")
    fixed = turn_repair.repair(turns).persist()
    rows = turn_repair.repaired_turns(turns, fixed).collect()
    for r in fixed.collect():
        own = sorted((x for x in rows if x.conv_id == r.conv_id), key=lambda x: x.place)
        assert [x.place for x in own] == list(range(1, len(own) + 1))
        assert hashlib.sha256("\n".join(f"{x.role}:{x.text}" for x in own).encode()).hexdigest() == r.repaired_sha256


# Merkle manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)))


def tree_proofs(leaves):
    """The root and each leaf's list of (left, right) siblings, by walking the whole tree."""
    level, proofs, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for k, p in enumerate(at):
            first = p - p % 3
            proofs[k].append(("".join(level[first:p]), "".join(level[p + 1 : first + 3])))
        level = [sha(*level[i : i + 3]) for i in range(0, len(level), 3)]
        at = [p // 3 for p in at]
    return level[0], proofs


def brute_manifest(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[3], []).append(r)
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    of, out = {}, []
    for s in names:
        trees[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        of[s] = tree_proofs([leaf(r, r[1]) for r in trees[s]])
    root, tops = tree_proofs([of[s][0] for s in names])
    for s, top in zip(names, tops):
        for r, proof in zip(trees[s], of[s][1]):
            proof = proof + top
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            h = leaf(r, r[1].replace("\n", "") if bad else r[1])
            for a, z in proof:
                h = sha(a, h, z)
            out.append((r[0], leaf(r, r[1]), of[s][0], root, sha(*(a + z for a, z in proof)), h, h == root))
    return out


def manifest_of(spark, df):
    struck = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    claimed = F.when(struck, merkle.leaf_of(*map(F.col, merkle.FIELDS[:-1]), F.replace(F.col("text"), F.lit("\n"), F.lit(""))))
    return merkle.manifest(df, claimed)


@pytest.mark.parametrize("n,band", [(1, 4), (3, 4), (300, 4), (700, 4)])
def test_manifest(spark, n, band):
    rnd = random.Random(n)
    rows = [(rnd.choice((None, i, i, i // 2)), rnd.choice((None, "", "a\nb", "é汉\n", "x " * 5000, "same")), rnd.choice((None, "en")), "hot" if i % 3 == 0 else rnd.choice((None, "", "a", "b", "é", f"s{i % 40}")), rnd.choice((None, i)), "clash", "clash") for i in range(n)]
    rows += rows[:2]  # equal rows
    df = spark.createDataFrame(rows, DOCS)
    got = manifest_of(spark, df).persist()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute_manifest(rows)))
    if n == 300:
        same_rows(spark, got, merkle.OP12_SQL, documents=df)
    if n > 3:
        assert {r.verified for r in got.collect()} == {True, False}


def test_manifest_of_nothing(spark):
    assert manifest_of(spark, spark.createDataFrame([], DOCS)).count() == 0


# suffix merge


def brute_removal(docs, size=50):
    low = {}
    for d, t in docs:
        for i in range(len(t) - size + 1):
            if d is not None:
                low[t[i : i + size]] = min(d, low.get(t[i : i + size], d))
    out = []
    for d, t in docs:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - size + 1):
            if d is not None and low[t[i : i + size]] < d:
                gone[i : i + size] = True
        spans = int(gone[:1].sum() + (np.diff(gone.astype(int)) == 1).sum())
        out.append((d, len(t), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return out


def shared_texts(seed, n=120):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(2, 8))) for _ in range(300)]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 120))) for _ in range(30)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rnd.randrange(4)):
            text, at = rnd.choice(base), rnd.randrange(200)
            parts.append(text[at : at + rnd.randrange(20, 400)] if rnd.random() < 0.7 else text)
        out.append(" ".join(parts) + "x" * (rnd.random() < 0.1) * rnd.randrange(40, 200))
    return out


@pytest.mark.parametrize("seed,size", [(1, 50), (2, 50), (3, 32), (4, 90)])
def test_repeats_over_small_runs(monkeypatch, seed, size):
    monkeypatch.setattr(suffix_merge, "SLICE", 700)
    docs = [(i, t.encode()) for i, t in enumerate(shared_texts(seed, 80))]
    ranges, hits = {}, []
    for run in range(9):
        pieces = [(d, 0, at, t[at : at + 700 + size - 1]) for d, t in docs if d % 9 == run for at in range(0, len(t) - size + 1, 700)]
        for r, blob in suffix_merge.sorted_runs(pieces, run, 5, size):
            if r < 0:
                raw = np.frombuffer(blob, np.int64)
                hits += [tuple(x) for x in raw[2 + 2 * raw[0] :].reshape(3, -1).T]
            else:
                ranges.setdefault(r, []).append(blob)
    for blobs in ranges.values():
        hits += [tuple(x) for x in np.array(suffix_merge.repeated_windows(blobs, size)[1:]).T]
    for (d, t), want in zip(docs, brute_removal(docs, size)):
        gone = np.zeros(len(t), bool)
        for i, start, n in hits:
            if i == d:
                gone[start : start + n + size - 1] = True
        assert hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest() == want[4]


@pytest.mark.parametrize("runs", [1, 2, 3, 6, 13])
def test_loser_tree(runs):
    rnd = random.Random(runs)
    sets = [sorted(bytes(rnd.choice(b"ab") if rnd.random() < 0.9 else 0 for _ in range(rnd.randrange(16, 50))).ljust(50, b"\0") for _ in range(rnd.randrange(1, 40))) for _ in range(runs)]
    rows = [np.frombuffer(b"".join(s), np.uint8).reshape(-1, 50) for s in sets]
    order, shared = suffix_merge.merged([(suffix_merge.as_words(r).tolist(), suffix_merge.shared_prefixes(r).tolist()) for r in rows], 50)
    at, out = [0] * runs, []
    for k in order:
        out.append(sets[k][at[k]])
        at[k] += 1
    assert out == sorted(itertools.chain(*sets))
    assert shared == suffix_merge.shared_prefixes(np.frombuffer(b"".join(out), np.uint8).reshape(-1, 50)).tolist()


def test_front_coding_is_undone():
    pieces = [(i, 0, 5, t.encode()) for i, t in enumerate(shared_texts(8, 30)) if len(t) >= 50]
    rows, begin = suffix_merge.suffix_rows(pieces, np.arange(len(pieces)), 1, 50)
    order = np.argsort(rows.view(f"S{rows.shape[1]}").ravel())
    right, left, low, high = rows[order, 4:54], rows[order, 54:-6], rows[order, -6].astype(int), rows[order, -5].astype(int)
    blob = suffix_merge.front_coded(right, left, low, high, np.arange(len(order)), begin[order])
    for got, want in zip(suffix_merge.decoded(blob, 50), (right, left, low, high, np.arange(len(order)), begin[order])):
        assert np.array_equal(got, want)


def test_remove_repeats(spark):
    texts = shared_texts(7) + ["", None, "x" * 49, "x" * 300, "\0" * 120, "\0" * 49 + "a" + "\0" * 60, "é" * 3000]
    rows = [(i, t, None, None, None, "clash", "clash") for i, t in enumerate(texts)]
    rows += rows[:5] + [(3, texts[8], *rows[0][2:]), (None, texts[9], *rows[0][2:]), (None, None, *rows[0][2:]), (2, texts[20], *rows[0][2:]), (2, texts[21], *rows[0][2:])]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    got = suffix_merge.remove_repeats(df).persist()
    want = brute_removal([(r[0], (r[1] or "").encode()) for r in rows])
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    same_rows(spark, got, suffix_merge.OP13_SQL, documents=df)
    assert suffix_merge.remove_repeats(df.where("false")).count() == 0


# rows that repeat an id


def row_components(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def test_texts_under_one_id_are_compared_each_by_itself(spark):
    rnd = random.Random(4)
    word = lambda: f"w{rnd.randrange(4000)}"
    base = [[word() for _ in range(n)] for n in (14, 3000, 60, 61, 200)]
    rows = [(5, base[0]), (5, base[1]), (9, [*base[0], "more"]), (7, [*base[1], "more"]), (3, base[2]), (3, base[3]), (2, [*base[3], "end"]), (8, base[2]), (8, base[4]), (None, base[4]), (1, base[4]), (8, base[4]), (6, []), (6, base[0])]
    texts = [" ".join(w) for _, w in rows]
    sets = [{tuple(w[k : k + 3]) for k in range(len(w) - 2)} for _, w in rows]
    linked = [(a, b) for a in range(len(rows)) for b in range(a) if rows[a][0] is not None and rows[b][0] is not None and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    roots = row_components(len(rows), linked)
    least = {r: min(rows[i][0] for i in range(len(rows)) if roots[i] == r and rows[i][0] is not None) for r in set(roots) if any(roots[i] == r and rows[i][0] is not None for i in range(len(rows)))}
    want = [(rows[i][0], len(sets[i]), None if rows[i][0] is None else least[roots[i]]) for i in range(len(rows))]
    df = spark.createDataFrame([(r[0], t, None, None, None, "x", "y") for r, t in zip(rows, texts)], DOCS).repartition(3)
    got = ngram_jaccard.jaccard_components(df, 3, 80, 100).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_vectors_under_one_id_are_compared_each_by_itself(spark):
    rnd = np.random.default_rng(6)
    base = rnd.standard_normal((8, 12))
    rows = [(int(rnd.integers(0, 25)) if i % 9 else None, base[i % 8] + rnd.standard_normal(12) * (0.03, 0.15, 1.0)[i % 3], i % 2) for i in range(120)]
    rows += [(1, base[0], 0), (1, base[0], 0), (1, base[1], 0), (2, base[0] * 2, 0), (30, base[0], 1)]
    unit = np.array([v / np.linalg.norm(v) for _, v, _ in rows])
    near = unit @ unit.T >= 0.93
    linked = [(a, b) for a in range(len(rows)) for b in range(a) if rows[a][2] == rows[b][2] and near[a, b]]
    roots, links = row_components(len(rows), linked), [0] * len(rows)
    for pair in linked:
        for i in pair:
            links[i] += 1
    want = []
    for i, (vec, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if roots[j] == roots[i] and rows[j][0] is not None]
        want.append((vec, links[i], None if vec is None else min(ids), None if vec is None else vec == min(ids)))
    df = spark.createDataFrame([(i, [float(x) for x in v], label) for i, v, label in rows], "vec_id long, embedding array<double>, label int").repartition(3)
    assert sorted(map(repr, map(tuple, multi_index.near_duplicates(df).collect()))) == sorted(map(repr, want))
