"""Quality ranking, periodic runs and spelling variants against brute force and held-out accuracy."""

from __future__ import annotations

import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docweir.llm import periodic_runs, quality, queries, spelling
from docweir.llm.words import words_of
from tests.llm import brute

SMALL, SF = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
CLASHES = {"_id": 1, "_text": 2, "_words": 3, "word": 4, "n": 5, "key": 6, "row": 7, "col": 8, "_x": 9, "_good": 10, "t": 11}


def table(spark, rows, clash=False):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({k: F.lit(v) for k, v in CLASHES.items()}) if clash else df


# 11 quality


def prose(rng, n):
    return " ".join(f"{rng.choice('abcdefgh')}{rng.choice('aeiou')}{rng.randrange(300):x}".rstrip("0123456789") or "w" for _ in range(n)) + "."


def spoilt(rng, n):
    kind = rng.randrange(3)
    if kind == 0:
        return " ".join([f"Word{rng.randrange(9)}"] * n)
    if kind == 1:
        return prose(rng, n).upper().replace(" ", "!! ")
    return " ".join(w + rng.choice(["###", "%%%", "$$$"]) for w in prose(rng, n).split())


def marked(spark, seed=1, n=600):
    rng = random.Random(seed)
    rows = [(i, (prose if i % 4 else spoilt)(rng, rng.randrange(20, 90))) for i in range(n)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, n, 2)] + [(None, 1), (3, None), (8, 1)], "doc_id long, quality int")
    return rows, labels


def test_quality_of_texts_not_learnt_from(spark):
    rows, labels = marked(spark)
    odd = [(None, "x"), (5, rows[5][1]), (6, rows[6][1]), (9001, None), (9002, ""), (9003, " \n"), (9004, "a " * 200_000), (9005, "!!!")]
    docs = table(spark, rows + odd, clash=True)
    model = quality.fit(docs, labels, quality.learnt_rows())
    got = quality.score(docs, model)
    assert got.columns == [*docs.columns, "score"]
    found = got.collect()
    assert len(found) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in found)
    by_id = collections.defaultdict(set)
    for r in found:
        by_id[r.doc_id].add(r.score)
    assert all(len(x) == 1 for i, x in by_id.items()), "equal texts score alike"
    right = [(s >= quality.THRESHOLD) == (i % 4 > 0) for i, (s,) in ((i, by_id[i]) for i in range(600)) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(right) > 100 and np.mean(right) > 0.97
    again = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, labels, quality.learnt_rows())).collect()}
    assert all(again[i] in x for i, x in by_id.items())


def test_quality_without_labels_or_rows(spark):
    rows, _ = marked(spark, n=20)
    docs, none = table(spark, rows), spark.createDataFrame([], "doc_id long, quality int")
    one_kind = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    for labels in (none, one_kind):
        scores = {round(r.score, 9) for r in quality.score(docs, quality.fit(docs, labels, quality.learnt_rows())).collect()}
        assert scores == {quality.THRESHOLD}
    model = quality.fit(table(spark, []), one_kind, quality.learnt_rows())
    assert quality.score(table(spark, []), model).count() == 0


def test_held_out_labels_never_change_the_model(spark):
    rows, labels = marked(spark)
    docs = table(spark, rows)
    turned = labels.withColumn("quality", F.when(quality.learnt_rows(), F.col("quality")).otherwise(1 - F.col("quality")))
    a, b = (quality.fit(docs, x, quality.learnt_rows()) for x in (labels, turned))
    assert (a.weights == b.weights).all() and (a.at, a.spread) == (b.at, b.spread)


def test_quality_learns_from_every_labelled_row(spark):
    """Any one training row moves the model, in shares far smaller than the table, and the threshold is the whole table's."""
    rows, labels = marked(spark, n=200)
    docs = table(spark, rows)
    model = quality.fit(docs, labels, quality.learnt_rows(), share=10)
    texts = dict(rows)
    usable = labels.where(quality.learnt_rows()).where("quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q"))
    known = {r.doc_id: r.q for r in usable.collect() if r.doc_id in texts}
    strengths = np.sort(quality.features(pa.array([texts[i] for i in known])).astype(np.float32).astype(float) @ model.weights)
    at = strengths[int(np.ceil((1 - sum(known.values()) / len(known)) * len(known) - 1e-9)) - 1]
    assert abs(at - model.at) < 1e-6
    for i in sorted(known)[::40]:
        fewer = quality.fit(docs, labels.where(F.col("doc_id") != i), quality.learnt_rows(), share=10)
        assert not np.allclose(fewer.weights, model.weights, atol=1e-9)


def test_pairs_hold_every_text():
    x = np.eye(50)
    w = quality.train_on_all(x[:45], x[45:], pairs=10)
    assert (w[:45] > 0).all() and (w[45:] < 0).all()


def test_pairwise_training_is_logistic_regression_on_differences():
    rng = np.random.default_rng(3)
    good, bad = rng.normal(0.4, 1, (300, 3)), rng.normal(0, 1, (200, 3))
    w = quality.train(good, bad, seed=5, pairs=4000)
    pick = np.random.default_rng(5)
    x = good[pick.integers(300, size=4000)] - bad[pick.integers(200, size=4000)]
    v = np.zeros(3)
    for _ in range(4000):    # plain gradient descent on the same loss
        p = 1 / (1 + np.exp(x @ v))
        v -= 0.5 * (-(x * p[:, None]).mean(axis=0) + 1e-3 * v)
    assert np.allclose(w, v, atol=1e-6)


def plain_features(text):
    """Some of the features, by counting."""
    w, raw = brute.words(text), (text or "").encode()
    letters = sum(c >= 128 or chr(c).isalpha() for c in raw)
    windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    return {"upper": sum(65 <= c <= 90 for c in raw) / max(1, letters), "digit": sum(48 <= c <= 57 for c in raw) / max(1, len(raw)),
            "repeats_last": sum(a == b for a, b in zip(w, w[1:])) / max(1, len(w)),
            "repeated_words": 1 - len(set(w)) / len(w) if w else 0,
            "top_word": max(collections.Counter(w).values(), default=0) / max(1, len(w)),
            "repeated_windows": 1 - len(set(windows)) / len(windows) if windows else 0,
            "long_words": sum(len(x.encode()) >= 25 for x in w) / max(1, len(w))}


def test_features_of_each_text_stand_alone():
    rng = random.Random(8)
    texts = [None, "", " ", "A", "a b a b a b a b", "Über 12 !!x", "x" * 30 + " y", *(prose(rng, k) for k in range(1, 30)), "end\n", "no space"]
    got = quality.features(pa.array(texts))
    assert got.shape == (len(texts), quality.WIDTH) and np.isfinite(got).all()
    for i, text in enumerate(texts):
        assert (quality.features(pa.array([text], pa.string()))[0] == got[i]).all(), repr(text)
        for name, x in plain_features(text).items():
            assert got[i][quality.SHARES.index(name)] == pytest.approx(x), (name, text)


def test_quality_query_on_held_out_documents(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op11_quality"](spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) for i, r in got.items())
    right = [got[i].predicted == q for i, q in labels.items() if q is not None and got[i].held_out]
    assert len(right) > 50 and np.mean(right) > 0.95


# 12 periodic runs


def plain_lyndon(s):
    out = []
    for i in range(len(s)):
        j = i + 1
        while j < len(s) and s[i:] < s[j:]:
            j += 1
        out.append(j - i)
    return out


def plain_runs(s, least=12):
    found = set()
    for q in range(1, len(s) // 2 + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            n = j + q - i
            if n >= max(2 * q, least) and not any(all(s[x] == s[x + p] for x in range(i, i + n - p)) for p in range(1, q)):
                found.add((i, n, q))
            i = max(i, j) + 1
    return sorted(found)


def some_sequence(rng):
    k, n = rng.choice([1, 2, 2, 3, 4, 9]), rng.randrange(0, 46)
    s = [rng.randrange(k) for _ in range(n)]
    if n and rng.random() < 0.5:
        p = rng.randrange(1, n + 1)
        s = [s[i % p] for i in range(n)]
        for _ in range(rng.randrange(3)):
            s[rng.randrange(n)] = rng.randrange(k)
    return s


def test_lyndon_arrays_and_runs():
    rng = random.Random(1)
    for _ in range(3000):
        s = some_sequence(rng)
        assert periodic_runs.lyndon_array(s) == plain_lyndon(s)
        for least in (1, 7, 12):
            assert periodic_runs.runs_of(s, least) == plain_runs(s, least)


def test_stretches_lose_no_run():
    rng = random.Random(2)
    for _ in range(300):
        parts = [some_sequence(rng) for _ in range(rng.randrange(1, 6))]
        hashed = words_of(pa.array([" ".join(map(str, s)) for s in parts]))
        found = collections.defaultdict(list)
        for i, a, b in periodic_runs._stretches(hashed.hashes, hashed.bounds, 6, 12):
            a, b = a - int(hashed.bounds[i]), b - int(hashed.bounds[i])
            found[i] += [(a + x, n, q) for x, n, q in plain_runs(parts[i][a:b])]
        for i, s in enumerate(parts):
            assert sorted(found[i]) == plain_runs(s)


def plain_row(doc_id, text):
    w = brute.words(text)
    if doc_id is not None:
        h, n = zlib.crc32(str(doc_id).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(w)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = min(((-n, s, q) for s, n, q in runs), default=None)
    first = (best[1], -best[0], best[2], -1000 * best[0] // best[2]) if best else (None,) * 4
    if best:
        first = (*first[:3], 1000 * first[1] // first[2])
    return (doc_id, len(runs), *first, brute.sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
            brute.sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_runs_query(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{x}" for x in some_sequence(rng))) for i in range(400)]
    rows += [(i, prose(rng, rng.randrange(1, 80))) for i in range(400, 600)]
    rows += [(900, None), (901, ""), (902, " \t"), (None, "a b " * 9), (None, None), (1, rows[1][1]), (1, rows[1][1]),
             (903, "é ü " * 20 + "x"), (904, "one\x0btwo\x0c" * 7), (905, "a " * 3000), (906, "A a " * 11)]
    table(spark, rows, clash=True).write.parquet(f"{tmp_path}/documents.parquet")
    got = collections.Counter(map(tuple, queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()))
    assert got == collections.Counter(plain_row(*r) for r in rows)
    table(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.QUERIES["op12_periodic_runs"](spark, f"{tmp_path}/none").count() == 0


def test_runs_query_on_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect() if len(r.text or "") < 6000]
    got = {r.doc_id: tuple(r) for r in queries.QUERIES["op12_periodic_runs"](spark, SMALL).collect()}
    assert all(got[i] == plain_row(i, t) for i, t in docs)


def test_runs_keep_columns_and_long_texts(spark):
    long = " ".join(f"v{k}" for k in range(40_000))
    docs = table(spark, [(1, long + " " + long), (2, long), (None, "z " * 50_000)], clash=True)
    got = periodic_runs.find_runs(docs, n_words="n")
    assert set(docs.columns) <= set(got.columns)
    rows = {r.doc_id: r for r in got.collect()}
    assert [tuple(x) for x in rows[1].runs] == [(0, 80_000, 40_000)] and rows[1].kept_text == long and rows[1].n == 80_000
    assert rows[2].runs == [] and [tuple(x) for x in rows[None].runs] == [(0, 50_000, 1)] and rows[None].kept_text == "z"


# 13 spelling variants


def plain_edits(a, b):
    """Levenshtein distance by the whole table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, above = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


def plain_groups(counts, ratio=5):
    near = {w: [v for v in counts if abs(len(v) - len(w)) < 2 and plain_edits(w, v) == 1] for w in counts}
    form = {}
    for w in counts:
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= ratio * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


def some_vocabulary(rng, n):
    counts = {}
    for _ in range(n):
        w = "".join(rng.choice("abetozéÿ×") for _ in range(rng.randrange(1, 7)))
        counts[w] = rng.choice([5, 6, 30, 31, 160, 900, 6000, 40_000])
    return counts


@pytest.mark.parametrize("tile", [2, 50, 20_000])
def test_variants_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(spelling, "TILE", tile)
    counts = some_vocabulary(random.Random(tile), 260)
    rows = [(w, n - 1) for w, n in counts.items()] + [(w, 1) for w in counts] + [(None, 7)]
    got = spelling.group_variants(spark.createDataFrame(rows, "word string, n long"))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(counts) and set(found) == plain_groups(counts)


def test_trie_meets_every_pair_once():
    rng = random.Random(9)
    words = list(some_vocabulary(rng, 150)) + ["", "zz" * 200, "zz" * 200 + "a"]
    trie, met = spelling.Trie(words, 0), collections.Counter()
    for w in words:
        for leaf, same in trie.reach(spelling.vector(w), 0):
            for v in leaf:
                if (not same or w < v) and spelling.one_edit(w, v):
                    met[frozenset((w, v))] += 1
    want = {frozenset((a, b)) for a in words for b in words if len(a) <= 200 and len(b) <= 200 and plain_edits(a, b) == 1}
    want.add(frozenset(words[-2:]))
    assert set(met) == want and set(met.values()) == {1}


def test_chains_of_forms(spark):
    counts = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aabbbb": 3125, "abbbbb": 15_625, "qqqqqq": 5}
    got = spelling.group_variants(spark.createDataFrame(list(counts.items()), "word string, n long"))
    assert {r.word: r.root for r in got.collect()} == {w: "abbbbb" if w != "qqqqqq" else w for w in counts}
    assert spelling.group_variants(spark.createDataFrame([], "word string, n long")).count() == 0


def plain_count(rows):
    counts = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def test_spelling_query(spark, tmp_path):
    rng = random.Random(11)
    stock = ["".join(rng.choice("abcdenoéÉ") for _ in range(rng.randrange(5, 9))) for _ in range(60)]
    rows = []
    for i in range(300):
        words = [rng.choice(stock[:rng.choice([3, 60])]) for _ in range(rng.randrange(1, 60))]
        words = [w[:k] + w[k + 1:] if rng.random() < 0.03 and (k := rng.randrange(len(w))) else w for w in words]
        rows.append((i, rng.choice([" ", ", ", "1", "Ā", "\n"]).join(w.title() if rng.random() < 0.1 else w for w in words)))
    rows += [(500, None), (501, ""), (502, "1 2"), (None, "letters " * 9), (3, rows[3][1]), (3, rows[3][1]), (503, "x" * 5000), (504, "longword " * 5000)]
    table(spark, rows, clash=True).write.parquet(f"{tmp_path}/documents.parquet")
    found = [tuple(r) for r in queries.QUERIES["op13_spelling"](spark, str(tmp_path)).collect()]
    want = plain_groups(plain_count(rows))
    assert len(found) == len(want) and set(found) == want
    table(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.QUERIES["op13_spelling"](spark, f"{tmp_path}/none").count() == 0


def test_counting_in_small_parts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD_WORDS", 3)
    docs = table(spark, [(i, f"alpha beta w{i}rest gamma" * 2) for i in range(40)])
    got = {r.word: r.n for r in spelling.count_words(docs, "[a-z]", 4).collect()}
    assert got == {"alpha": 40, "beta": 80, "gamma": 40, "gammaalpha": 40, "rest": 80}
