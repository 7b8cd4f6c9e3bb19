"""The corpus operators against brute force, libraries, round trips and held-out accuracy."""

from __future__ import annotations

import collections
import datetime as dt
import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from docweir.llm import (exact_dedup, filters, jaccard_join, joins, language, mixing, neighbours, pseudonyms,
                         substring_dedup, token_counts, tokens, toxicity)
from docweir.llm.queries import QUERIES
from docweir.llm.words import words_of
from tests.llm import brute

SMALL, SF = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names the operators use themselves.
CLASHES = {"row": 1, "sig": 2, "center": 3, "size": 4, "_key": 5, "digest": 6, "key": 7, "pos": 8, "bucket": 9, "n": 10,
           "kept": 11, "text_sha256": 12, "word": 13, "_suspect": 14, "_salt": 15, "rank": 16, "weight": 17}


def table(spark, rows, clash=False):
    df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)
    return df.withColumns({k: F.lit(v) for k, v in CLASHES.items()}) if clash else df


def some_words(rng, n, of=400):
    return " ".join(f"w{rng.randrange(of)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd():
    """Null, empty and blank texts, ties, odd white space, short and very long texts, copies; unique ids."""
    rng = random.Random(5)
    long = some_words(rng, 60_000, 5000)
    texts = [None, "", "   \n\t ", "one", "One", "a b c d", "A b\tc\x0bd", "a b c d e", "a b c d e f", "ONE", long, long,
             long + " end", "x" * 50_000, "é ß İ   z", "a b c d e"] + [some_words(rng, 80)] * 30
    return [(i * 3, t, f"s{i % 4}" if i % 5 else None) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def family():
    """Mutants of one text, some of them linked only over others, and texts that share one passage."""
    rng = random.Random(3)
    base = [f"b{i}" for i in range(130)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(12)):
            w[rng.randrange(len(w))] = f"m{rng.randrange(10 ** 6)}"
        rows.append(" ".join(w))
    chain = [f"c{i}" for i in range(120)]
    for i in range(12):    # each differs from the next by a little, the ends by a lot
        chain = [*chain[3:], *(f"d{i}.{j}" for j in range(3))]
        rows.append(" ".join(chain))
    passage = [f"p{i}" for i in range(70)]
    for i in range(60):
        rows.append(" ".join([*passage, *(f"u{i}.{j}" for j in range(rng.randrange(5, 60)))]))
    rng.shuffle(rows)
    return [(i, t, f"s{i % 3}") for i, t in enumerate(rows)]


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# 1 exact dedup


def test_exact_groups(spark, odd):
    rows = [*odd, (None, "lone", "s"), (None, "one", "s"), (None, None, "s"), (9, "one", "s"), (9, "one", "s")]
    got = exact_dedup.exact_groups(table(spark, rows, clash=True))
    assert collections.Counter(map(tuple, got.collect())) == brute.exact([(i, t) for i, t, _ in rows])
    assert exact_dedup.exact_groups(empty(spark)).count() == 0


@pytest.mark.parametrize("words", [1, 1 << 22])
def test_deduplicate_with_any_filter_size(spark, odd, words):
    """A full filter only sends more rows to the exact comparison."""
    rows = [*odd, (9, "one", "s"), (9, "one", "s"), (None, "lone", "s")]
    docs = table(spark, rows, clash=True)
    got = exact_dedup.deduplicate(docs, max_words=words)
    assert got.columns == docs.columns
    want = brute.exact([(i, t) for i, t, _ in rows])
    assert collections.Counter((r.doc_id, brute.sha(r.text)) for r in got.collect()) == collections.Counter(
        {(i, d): n for (i, _, _, kept, d), n in want.items() if kept})
    assert exact_dedup.deduplicate(empty(spark)).count() == 0


def test_filters_never_miss(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("key"))
    twice = keys.union(keys.limit(300))
    assert twice.where(~filters.filter_of(twice, 5300).test(F.col("key"))).count() == 0
    passed = {r.key for r in keys.where(filters.repeat_filter(twice, 5300).test(F.col("key"))).collect()}
    repeated = {r.key for r in twice.groupBy("key").count().where("count > 1").collect()}
    assert repeated <= passed and len(passed) < 600


# 2 pseudonyms

KEY = b"a key for tests"


def test_permutation_is_one():
    for size in (1, 2, 3, 10, 97, 1000):
        assert sorted(pseudonyms.permute(i, size, KEY, "t") for i in range(size)) == list(range(size))


@pytest.mark.parametrize("text,kind", [
    ("4111 1111 1111 1111", "card"), ("+1 (743) 555-3824", "phone"), ("(743) 555-3824", "phone"), ("192.168.0.255", "ip"),
    ("2024-02-29", "date"), ("29.02.2024", "date"), ("12/31/1999", "date"), ("GB82 WEST 1234 5698 7654 32", "iban"),
    ("123-45-6789", "ssn"), ("jo.ann_7@mail8.example.com", "email")])
def test_pseudonyms_keep_format_and_check(text, kind):
    new, spans = pseudonymised = pseudonyms.pseudonymise(f"see {text}, then", KEY)
    assert [s[2] for s in spans] == [kind] and text not in new and pseudonymised == pseudonyms.pseudonymise(f"see {text}, then", KEY)
    again, spans = pseudonyms.pseudonymise(new, KEY)
    assert [s[2] for s in spans] == [kind], "a pseudonym passes the same check"
    if kind not in ("ip",):
        assert [c.isdigit() for c in new] == [c.isdigit() for c in f"see {text}, then"]
    assert new != pseudonyms.pseudonymise(f"see {text}, then", b"another key")[0]


def test_pseudonyms_link_layouts_and_leave_the_rest():
    digits = {"".join(c for c in pseudonyms.pseudonymise(t, KEY)[0] if c.isdigit())
              for t in ("4111111111111111", "4111-1111-1111-1111", "4111 1111 1111 1111")}
    assert len(digits) == 1
    dates = [pseudonyms.pseudonymise(t, KEY)[0] for t in ("2024-02-29", "29.02.2024")]
    assert dt.date.fromisoformat(dates[0]) == dt.datetime.strptime(dates[1], "%d.%m.%Y").date()
    for text in ("4111 1111 1111 1112", "2023-02-29", "300.1.2.3", "version 1.2", "GB83 WEST 1234 5698 7654 32", "000-12-3456", ""):
        assert pseudonyms.pseudonymise(text, KEY) == (text, [])


@pytest.mark.parametrize("text,number", [
    ("4111 1111 1111 1111 12/27", "4111 1111 1111 1111"), ("4111111111111111 123", "4111111111111111"),
    ("order 12 4111 1111 1111 1111", "4111 1111 1111 1111"), ("2024-02-29 4111 1111 1111 1111", "4111 1111 1111 1111"),
    ("DE89 3704 0044 0532 0130 00 BIC COBADEFF", "DE89 3704 0044 0532 0130 00"),
    ("NL91 ABNA 0417 1643 00 EUR 50", "NL91 ABNA 0417 1643 00"), ("AB12 NL91 ABNA 0417 1643 00", "NL91 ABNA 0417 1643 00"),
    ("x4111111111111111y 5", "4111111111111111"), ("743-555-3824 99", "743-555-3824"), ("12 743-555-3824", "743-555-3824"), ("12 743 555 3824", "743 555 3824")])
def test_pseudonyms_beside_other_groups(text, number):
    new, spans = pseudonyms.pseudonymise(f"see {text}, then", KEY)
    assert number not in new and number in [f"see {text}, then"[a:b] for a, b, _ in spans]


def test_replace_private(spark, odd):
    docs = table(spark, [*odd, (None, "mail a@b.example", "s")], clash=True)
    got = pseudonyms.replace_private(docs, KEY)
    assert got.columns == [*docs.columns, "found"] and got.count() == docs.count()
    assert {(r.doc_id, r.text) for r in got.where("size(found) = 0").collect()} == {(i, t) for i, t, _ in odd}
    assert pseudonyms.replace_private(empty(spark), KEY).count() == 0


# 3 Jaccard join


@pytest.mark.parametrize("name", ["odd", "family"])
def test_near_groups(spark, request, name, monkeypatch):
    rows = request.getfixturevalue(name)
    monkeypatch.setattr(jaccard_join, "TILE", 16)
    got = jaccard_join.near_groups(table(spark, rows, clash=True)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.near([(i, t) for i, t, _ in rows])
    assert len(got) == len(rows)


def test_near_groups_of_sparse_chains(spark, monkeypatch):
    """Small trees of copies of copies from many seeds: some members of a family have balls of their own."""
    monkeypatch.setattr(jaccard_join, "TILE", 4)
    rows = []
    for seed in range(300):
        rng = random.Random(seed)
        tree = [[f"s{seed}.{i}" for i in range(rng.randrange(60, 160))]]
        for i in range(rng.randrange(4, 24)):
            w = list(rng.choice(tree))
            for j in range(rng.randrange(1, 5)):
                w[rng.randrange(len(w))] = f"s{seed}.m{i}.{j}"
            tree.append(w)
        rows += [" ".join(w) for w in tree]
    random.Random(0).shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id)
           for r in jaccard_join.near_groups(table(spark, [(i, t, "s") for i, t in enumerate(rows)])).collect()}
    want = brute.near(list(enumerate(rows)))
    assert {i for i in want if got[i] != want[i]} == set()


def test_near_groups_nulls_and_repeats(spark):
    rows = [(None, "a b c", "s"), (5, "a b c", "s"), (5, "a b c", "s"), (None, "x y", "s"), (7, None, "s"), (None, None, "s")]
    got = collections.Counter(map(tuple, jaccard_join.near_groups(table(spark, rows)).collect()))
    assert got == {(None, 1, 5): 1, (5, 1, 5): 2, (None, 1, None): 1, (7, 0, 7): 1, (None, 0, None): 1}
    assert jaccard_join.near_groups(empty(spark)).count() == 0


def test_keep_one(spark, family):
    docs = table(spark, family, clash=True)
    got = jaccard_join.keep_one(docs)
    assert got.columns == docs.columns
    want = {i for i, (_, root) in brute.near([(i, t) for i, t, _ in family]).items() if i == root}
    assert {r.doc_id for r in got.collect()} == want


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(i, i + 1) for i in range(500, 560)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = jaccard_join.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == {x: find(x) for x in root if find(x) != x}


# 4 mixing


def place(seed=0):
    return lambda i: int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:13], 16)


@pytest.mark.parametrize("bucket", [1, 8, 1024])
def test_mixing(spark, odd, family, bucket, monkeypatch):
    monkeypatch.setattr(mixing, "_BUCKET", bucket)
    rows = [*((i, t, s) for i, t, s in odd), *((10_000 + i, t, f"t{i % 7}") for i, t, _ in family)]
    docs = table(spark, rows, clash=True)
    got = {r.doc_id: (r["size"], r.source_size, r.target, r.taken) for r in mixing.plan(docs).collect()}
    want = brute.mixed([(i, s, t) for i, t, s in rows], place())
    assert got.keys() == want.keys()
    for i in got:
        assert got[i][:2] == want[i][:2] and got[i][3] == want[i][3] and math.isclose(got[i][2], want[i][2])
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    times = collections.Counter(r.doc_id for r in mixed.select("doc_id").collect())
    assert all(times[i] * want[i][0] == want[i][3] for i in want)


def test_mixing_edges(spark):
    assert mixing.plan(empty(spark)).count() == 0 and mixing.mix(empty(spark)).count() == 0
    blank = mixing.plan(table(spark, [(1, None, None), (2, "", "a"), (None, " ", "a")])).collect()
    assert [(r["size"], r.target, r.taken) for r in blank] == [(0, 0.0, 0)] * 3
    twice = mixing.plan(table(spark, [(1, "a b", "x")] * 2)).collect()
    assert [r.taken for r in twice] == [2, 2]


def test_attach_beyond_the_broadcast_size(spark):
    large = spark.range(1000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 5).alias("k"), "id")
    small = large.groupBy("k").agg(F.count("*").alias("c"))
    for rows in (6, joins.SMALL_ROWS + 1):
        got = joins.attach(large, small, "k", F.col("id"), rows).agg(F.count("c"), F.sum("c")).first()
        assert got[0] == 1000 and got[1] == sum(r.c ** 2 for r in small.collect())


# 5 toxicity


def test_toxicity_held_out(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(3000):
        toxic = rng.random() < 0.12
        w = some_words(rng, rng.randrange(20, 200)).split()
        for _ in range(rng.randrange(1, 4) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["Vile!", "rotten", "stinking,"]))
        rows.append((i, " ".join(w), "s"))
        if rng.random() < 0.5:
            labels.append((i, int(toxic)))
    docs = table(spark, rows, clash=True)
    weights = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), toxicity.confirmed_rows())
    got = {r.doc_id: r.score for r in toxicity.score(docs, weights).collect()}
    held = [(got[i] >= 0.3, y) for i, y in labels if __import__("zlib").crc32(str(i).encode()) % 4 == 2]
    hits = sum(p and y for p, y in held)
    assert hits >= 0.9 * sum(y for _, y in held) and hits >= 0.9 * sum(p for p, _ in held)


def test_toxicity_edges(spark, odd):
    docs = table(spark, [*odd, (None, "x", "s")], clash=True)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    weights = toxicity.fit(docs, none, toxicity.confirmed_rows())
    got = toxicity.score(docs, weights)
    assert got.columns == [*docs.columns, "score"] and all(0 <= r.score <= 1 for r in got.collect())
    assert toxicity.score(empty(spark), weights).count() == 0
    labels = spark.createDataFrame([(None, 1), (3, None), (0, 1), (0, 0), (3, 1), (6, 0)], "doc_id long, toxic int")
    assert np.isfinite(toxicity.fit(docs, labels, toxicity.confirmed_rows())).all()
    assert np.isfinite(toxicity.fit(empty(spark), labels, toxicity.confirmed_rows())).all()


# 6 language


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit("clash"))
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = language.fit(docs, rest != 1)
    got = language.identify(docs.where(rest == 1), *model).select("lang", "lang_pred", "score").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got) and all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark, odd):
    docs = table(spark, [*odd, (1, "12 34 -- !", "s"), (None, "abc", "s")], clash=True)
    model = language.fit(docs, F.lit(True))
    got = language.identify(docs, *model).collect()
    assert {r.lang_pred for r in got if not any(c.isalpha() for c in r.text or "")} == {language.UNKNOWN}
    assert {r.lang_pred for r in got if any(c.isalpha() for c in r.text or "")} == {"en"}
    names, prototypes = language.fit(empty(spark), F.lit(True))
    assert names == [] and {r.lang_pred for r in language.identify(docs, names, prototypes).collect()} == {"und"}
    assert language.identify(empty(spark), *model).count() == 0


def test_language_bundle_is_the_sum_of_bound_letters():
    vectors, letters = language.bundles(pa.array(["Ab", None, "a-B c"]), 64)
    space, a, b, c = language.letter_vectors(np.array([0x110000, 97, 98, 99]), 64).astype(int)

    def gram(x, y, z):
        return np.roll(x, 2) * np.roll(y, 1) * z

    assert (vectors[0] == gram(space, a, b) + gram(a, b, space)).all() and letters.tolist() == [2, 0, 3]
    assert (vectors[2] == gram(space, a, space) + gram(a, space, b) + gram(space, b, space) + gram(b, space, c)
            + gram(space, c, space)).all()


# 7 token counts

WORDS_JSON = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, odd, file, tmp_path):
    path = public_tokenizers.path(file)
    extra = [(None, "<|endoftext|> A<|startoftext|>b  <|ENDOFTEXT|>", "s"), (None, "é ́x\ń", "s"), (0, None, "s"), (0, None, "s")]
    rows = [*odd, *extra]
    got = token_counts.token_counts(table(spark, rows, clash=True), path, str(tmp_path / "cache")).collect()
    if file.endswith(".json"):
        own = Tokenizer.from_file(path)
        count = lambda t: len(own.encode(t or "", add_special_tokens=False).ids)
    else:
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t or ""))
    want = collections.Counter((i, len((t or "").encode()), count(t), count(t) > 2048) for i, t, _ in rows)
    assert collections.Counter(map(tuple, got)) == want


def test_token_cache_is_used_and_grows(spark, tmp_path):
    cache = str(tmp_path / "cache")
    first = table(spark, [(1, "one two", "s"), (2, "one  two", "s"), (3, "three", "s")])
    assert [r.n_tokens for r in token_counts.token_counts(first, WORDS_JSON, cache).orderBy("doc_id").collect()] == [2, 2, 1]
    assert spark.read.parquet(cache).count() == 2
    # A changed stored count shows that nothing is encoded again.
    told = spark.read.parquet(cache).withColumn("n_tokens", F.lit(77).cast("long"))
    told.write.parquet(other := str(tmp_path / "other"))
    more = table(spark, [(4, "one two", "s"), (5, "four five", "s")])
    assert [r.n_tokens for r in token_counts.token_counts(more, WORDS_JSON, other).orderBy("doc_id").collect()] == [77, 2]
    assert spark.read.parquet(other).count() == 3
    assert token_counts.token_counts(empty(spark), WORDS_JSON, str(tmp_path / "none")).count() == 0


# 8 substring dedup


def test_remove_repeats(spark, odd, family):
    rng = random.Random(8)
    passage = some_words(rng, 57, 10 ** 6)
    rows = [*odd, *((1000 + i, t, s) for i, t, s in family),
            *((2000 + i, f"{some_words(rng, rng.randrange(90))} {passage} {some_words(rng, rng.randrange(90))}", "s") for i in range(40)),
            (3000, " ".join(passage.split()[:49]), "s"), (3001, "same " * 120, "s"), (3002, "same " * 70, "s")]
    got = substring_dedup.remove_repeats(table(spark, rows, clash=True)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, brute.sha(r.kept_text)) for r in got} == brute.cut([(i, t) for i, t, _ in rows])
    assert len(got) == len(rows) and all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)


def test_remove_repeats_nulls_and_repeats(spark):
    text = some_words(random.Random(9), 60, 10 ** 6)
    rows = [(None, text, "s"), (1, text, "s"), (1, text, "s"), (1, text + " x", "s"), (2, text, "s")]
    got = collections.Counter((r.doc_id, r.n_removed) for r in substring_dedup.remove_repeats(table(spark, rows)).collect())
    assert got == {(None, 0): 1, (1, 0): 3, (2, 60): 1}
    assert substring_dedup.remove_repeats(empty(spark)).count() == 0


# 9 neighbours


@pytest.mark.parametrize("block", [7, 64])
def test_neighbours(spark, block):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(150, 12)).astype(np.float32)
    v[40:60] = v[0]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(200, None), (201, [0.0] * 12), (202, [float("nan")] * 12), (203, [None] + [1.0] * 11), (204, [float("inf")] * 12),
             (None, v[3].tolist()), (205, [1.0, 2.0]), (220, [3.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({k: F.lit(1) for k in ("id", "v", "q", "dim", "qb")})
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0, 9, query_block=block, candidate_block=2 * block).collect()
    exact = v.astype(np.float64)
    want = {}
    for q in range(0, 150, 20):
        score = exact @ exact[q]
        order = sorted((i for i in range(150) if i != q), key=lambda i: (-round(score[i], 12), i))[:9]
        want |= {(q, k + 1): i for k, i in enumerate(order)}
    assert {(r.query_id, r.rank): r.vec_id for r in got if r.query_id < 150} == want
    assert all(math.isclose(r.score, exact[r.query_id] @ exact[r.vec_id]) for r in got if r.query_id < 150)
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got if r.query_id >= 150] == [(220, 1, 205, 5.0)]
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 20 == 0, 9).count() == 0


# 10 byte-pair encoding

BYTES_JSON = public_tokenizers.path("byte_bpe_50k.json")


def test_codec_equals_the_library():
    own, library = tokens.ByteBpe(BYTES_JSON), Tokenizer.from_file(BYTES_JSON)
    rng = random.Random(10)
    parts = [" ", "  ", "\n", "\t", "a", "th", "ing", "'s", "'ll", "1", "23", "é", "中文", "\U0001f642", "́", "\x1c", "\x85",
             " ", "​", "<|endoftext|>", "<|endo", "...", "a" * 30, "\r\n", "\x00", "İ", " the", "Ġ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(3000)] + ["z" * 20_000, "ab" * 9000]
    texts += ["x" + chr(c) + " y" for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        packed = own.encode(text)
        assert np.frombuffer(packed, np.uint32).tolist() == want.ids, repr(text)
        assert own.decode(packed) == text


def test_encode_and_decode(spark, odd, monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_BYTES", 10_000)
    docs = table(spark, [*odd, (None, "<|endoftext|>", "s"), (0, None, "s")], clash=True)
    coded = tokens.encode(docs, BYTES_JSON, decoded="decoded")
    assert coded.columns == [*docs.columns, "ids", "decoded"]
    library = Tokenizer.from_file(BYTES_JSON)
    for r in coded.withColumn("sha", tokens.ids_digest("ids")).collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == (r.text or "")
        assert r.sha == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    back = tokens.decode(coded.select("doc_id", F.col("text").alias("was"), "ids"), BYTES_JSON)
    assert all(r.text == (r.was or "") for r in back.collect())
    assert tokens.decode(spark.createDataFrame([(None,), ([247],)], "ids array<int>"), BYTES_JSON).collect()[1].text == \
        library.decode([247], skip_special_tokens=False)
    assert tokens.encode(empty(spark), BYTES_JSON).count() == 0


# queries and pipeline


def test_word_fingerprints():
    words = words_of(pa.array(["A b", None, "", "a  B\n", "b"]), lower=True)
    assert words.counts().tolist() == [2, 0, 0, 2, 1] and (words.hashes[:2] == words.hashes[2:4]).all()
    fingerprints, at = words.windows(2)
    assert at.tolist() == [0, 2] and fingerprints[0] == fingerprints[1]


@pytest.mark.parametrize("n", range(1, 11))
def test_every_operator_has_one_query_over_all_rows(spark, n):
    names = [q for q in QUERIES if q.startswith(f"op{n}_")]
    assert len(names) == 1
    got = QUERIES[names[0]](spark, SMALL)
    if n == 9:
        vectors = spark.read.parquet(f"{SMALL}/embeddings.parquet")
        assert got.count() == 20 * vectors.where("vec_id % 20 = 0").count()
    else:
        docs = spark.read.parquet(f"{SMALL}/documents.parquet")
        assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())


@pytest.mark.parametrize("name,version", [("op3_jaccard_join", brute.near), ("op8_substring_dedup", brute.cut)])
def test_queries_equal_brute_force(spark, name, version):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    columns = {"op3_jaccard_join": ["n_shingles", "component_id"], "op8_substring_dedup": ["n_words", "n_removed", "kept_sha256"]}
    got = QUERIES[name](spark, SMALL).collect()
    assert {r.doc_id: tuple(r[c] for c in columns[name]) for r in got} == version(docs)


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    weights = toxicity.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"), toxicity.confirmed_rows())
    clean = [(r.doc_id, r.text, r.source) for r in toxicity.score(docs, weights).where("score < 0.3").collect()]
    stays = {i for (i, _, _, kept, _) in brute.exact([(i, t) for i, t, _ in clean]) if kept}
    clean = [x for x in clean if x[0] in stays]
    stays = {i for i, (_, root) in brute.near([(i, t) for i, t, _ in clean]).items() if i == root}
    clean = [x for x in clean if x[0] in stays]
    plan = brute.mixed([(i, s, t) for i, t, s in clean], place())
    library, want = Tokenizer.from_file(BYTES_JSON), {}
    for i, t, _ in clean:
        size, _, _, taken = plan[i]
        if size and taken:
            want[i] = (taken // size, library.encode(t, add_special_tokens=False).ids)
    got = collections.defaultdict(list)
    for r in corpus_pipeline.run(spark, SMALL).collect():
        assert r.decoded == (r.text or "")
        if brute.words(r.text):
            got[r.doc_id].append(r.ids)
    assert {i: (len(x), x[0]) for i, x in got.items()} == want


def test_pipeline_stages_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        got = stage(spark, empty(spark), str(tmp_path))
        assert got.columns[:5] == empty(spark).columns and got.count() == 0
