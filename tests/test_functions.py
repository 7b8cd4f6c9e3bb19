"""Golden vectors of the Column functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from docweir.functions import checkdigit as c, formatting as f, scores, similarity, text as t
from docweir.operators import gates


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text,digit", [("D23145890", 7), ("740812", 2), ("120415", 9), ("L898902C3", 6),
                                        ("1", 7), ("01", 3), ("001", 1), ("<<<", 0)])
def test_check_digit(spark, text, digit):
    assert value(spark, c.check_digit(F.lit(text))) == digit
    assert value(spark, c.check_digit(F.lit(text), len(text))) == digit


def test_check_digit_illegal_is_null(spark):
    assert value(spark, c.check_digit(F.lit("AB-1"))) is None


@pytest.mark.parametrize("text,digit,ok", [("D23145890", "7", True), ("D23145890", "8", False), ("<<<", "<", True),
                                           ("A<<", "<", False), ("A", "X", False)])
def test_verify_check_digit(spark, text, digit, ok):
    assert value(spark, c.verify_check_digit(F.lit(text), F.lit(digit))) is ok


@pytest.mark.parametrize("raw,kind,day", [("740812", "birth", dt.date(1974, 8, 12)), ("050301", "birth", dt.date(2005, 3, 1)),
                                          ("300101", "expiry", dt.date(2030, 1, 1)), ("991399", "birth", None), ("74O812", "birth", None)])
def test_zone_date(spark, raw, kind, day):
    assert value(spark, c.zone_date(F.lit(raw), kind, F.lit("2026-01-01").cast("date"))) == day


@pytest.mark.parametrize("raw,ok,birth,sex", [("31503950012345", True, dt.date(1995, 3, 15), "M"), ("42003920012345", True, dt.date(1992, 3, 20), "F"),
                                              ("33213950012345", False, None, "M"), ("91503950012345", False, None, None), ("123", False, None, None)])
def test_decode_pinfl(spark, raw, ok, birth, sex):
    got = value(spark, c.decode_pinfl(F.lit(raw)))
    assert (got["structure_valid"], got["birth_date"], got["sex"], got["checksum_verified"]) == (ok, birth, sex, False)


def test_transliteration(spark):
    assert value(spark, t.normalize_apostrophes(F.lit("'‘’`´ʼ′"))) == "ʻ" * 7
    assert value(spark, t.latin_to_cyrillic(F.lit("Shohruh"))) == "Шоҳруҳ"
    assert value(spark, t.latin_to_cyrillic(F.lit("O'zbekiston Shchedrin NGong"))) == "Ўзбекистон Щедрин НГонг"
    assert value(spark, t.cyrillic_to_latin(F.lit("Ғафур Щукин Жўра"))) == "Gʻafur Shchukin Joʻra"
    assert value(spark, t.to_mrz_name(F.lit("GʻOFUROV"), F.lit("SHOHRUH"), F.lit("AKMAL"))) == "GOFUROV<<SHOHRUH<AKMAL"
    assert value(spark, t.title_case_name(F.lit("  o'g'il   BOLA "))) == "Oʻgʻil Bola"


@pytest.mark.parametrize("raw,width,line", [("ABC", 10, "ABC<<<<<<<"), ("AB CD", 5, "AB<CD"), ("AB!@#CD", 5, "ABCD<"), ("A" * 50, 44, "A" * 44)])
def test_normalize_line(spark, raw, width, line):
    assert value(spark, t.normalize_line(F.lit(raw), width)) == line


@pytest.mark.parametrize("raw,out", [("héßü Ў ﬁ", "HESSUУFI"), ("½ Ünïcode-й", "12UNICODEИ"), ("漢字 abc", "ABC")])
def test_norm_for_grounding(spark, raw, out):
    assert value(spark, t.norm_for_grounding(F.lit(raw))) == out


@pytest.mark.parametrize("reply,body", [('```json\n{"a": 1}\n```', '{"a": 1}'), ('text {"a": "}"} tail', '{"a": "}"}'), ("[1, 2]", None),
                                        ("none", None), ('{"a": ', None)])
def test_extract_json(spark, reply, body):
    assert value(spark, t.extract_json(F.lit(reply))) == body


@pytest.mark.parametrize("fn,raw,out", [
    (f.date_uz, "1995-03-15", "15-mart, 1995-yil"), (f.date_ru, "15.03.1995", "15 марта 1995 г."), (f.date_uz_short, "15/3/1995", "15.03.1995"),
    (f.date_iso, "5.3.1995", "1995-03-05"), (f.date_uz, "bad", "bad"), (f.pinfl_spaced, "31503950012345", "3 1503 9500 1234 5"),
    (f.pinfl_spaced, "123", "123"), (f.amount_words, "1500000", "bir million besh yuz ming"), (f.amount_words, "21", "yigirma bir"),
    (f.amount_words, "1000", "ming"), (f.amount_words, "0", "nol"), (f.amount_words, "1 234,5", "o'n ikki ming uch yuz qirq besh"),
    (f.amount_words, "x", "x"), (f.amount_words, "1000000000000", None), (f.initials, "Aliyev Sh Akmal", "Aliyev S.A."), (f.initials, "One", "One"),
    (f.upper_uz, "o'g'il", "OʻGʻIL"), (f.default_blank, " ", f.BLANK), (f.cyrillic, "ALIYEV", "АЛИЙЕВ")])
def test_formatting(spark, fn, raw, out):
    assert value(spark, fn(F.lit(raw))) == out


def test_softmax_and_energy(spark):
    logits = F.array(*[F.lit(x) for x in (2.0, 1.0, 0.0)])
    assert abs(sum(value(spark, scores.softmax(logits))) - 1) < 1e-12
    assert abs(value(spark, scores.free_energy(logits)) + 2.4076059644443806) < 1e-12


def test_bbox_round_trip(spark):
    matrix = F.array(*[F.lit(float(x)) for x in (1, 0, 10, 0, 1, 20, 0, 0, 1)])
    assert value(spark, scores.map_bbox_to_original(F.array(*[F.lit(x) for x in (10, 20, 30, 50)]), matrix)) == [0, 0, 20, 30]
    assert value(spark, scores.map_bbox_to_original(F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(4)), F.lit(None).cast("array<double>"))) == [1, 2, 3, 4]


@pytest.mark.parametrize("a,b", [("kitten", "sitting"), ("ALIYEV", "ALIEV"), ("", ""), ("A", "")])
def test_fuzz_ratio_is_indel(spark, a, b):
    def lcs(x, y):
        row = [0] * (len(y) + 1)
        for ch in x:
            new = [0]
            for j, other in enumerate(y):
                new.append(row[j] + 1 if ch == other else max(new[-1], row[j + 1]))
            row = new
        return row[-1]
    want = 100.0 if not a and not b else 200.0 * lcs(a, b) / (len(a) + len(b))
    assert value(spark, similarity.fuzz_ratio(F.lit(a), F.lit(b))) == pytest.approx(want)


def test_partial_ratio_equals_brute_force(spark):
    import random
    rng = random.Random(5)
    pairs = [("".join(rng.choice("ABC") for _ in range(rng.randint(1, 6))), "".join(rng.choice("ABCD") for _ in range(rng.randint(1, 14)))) for _ in range(150)]

    def lcs(x, y):
        row = [0] * (len(y) + 1)
        for ch in x:
            new = [0]
            for j, other in enumerate(y):
                new.append(row[j] + 1 if ch == other else max(new[-1], row[j + 1]))
            row = new
        return row[-1]

    def best(s, l):
        windows = {l[max(0, e - len(s)):min(e, len(l))] for e in range(1, len(l) + len(s))}
        return max(200.0 * lcs(s, w) / (len(s) + len(w)) for w in windows if w)

    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", similarity.fuzz_partial_ratio(F.col("a"), F.col("b")).alias("v")).collect()
    for r in got:
        s, l = sorted((r["a"], r["b"]), key=len)
        want = max(best(s, l), best(l, s)) if len(s) == len(l) else best(s, l)
        assert r["v"] == pytest.approx(want), (r["a"], r["b"])


@pytest.mark.parametrize("text,signals", [("31503950012345", 1), ("AB 1234567", 1), ("L898902C3 31503950012345", 0), ("AUTO 31503950012345", 1), ("plain", 0)])
def test_pii_signals(spark, text, signals):
    assert len(value(spark, gates.pii_signals(F.lit(text)))) == signals


def test_specimen_inside_word_silences_only_in_loose_mode(spark):
    assert value(spark, gates.pii_signals(F.lit("AUTO 31503950012345"), whole_token=False)) == []


@pytest.mark.parametrize("logits,ood,reason", [([9, 1, .5, .2, .1, .1, 0], False, ""), ([4, 3.95, .1, .1, .1, .1, 0], True, "below confidence floor"),
                                               ([0, 0, 0, 0, 0, 0, 9], True, "unknown class")])
def test_ood_decision(spark, logits, ood, reason):
    df = spark.createDataFrame([([float(x) for x in logits],)], "logits array<double>")
    row = gates.ood_decision(df).first()
    assert (row["is_ood"], row["reason"]) == (ood, reason)


def test_ood_decision_rejects_wrong_length(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "logits array<double>")
    with pytest.raises(Exception, match="does not match"):
        gates.ood_decision(df).collect()


def test_comparison_form_of_every_code_point(spark):
    """The table against the decomposition of whole strings, with no Python in the plan."""
    import unicodedata
    points = [chr(n) for n in range(1, 0x110000) if not 0xD800 <= n < 0xE000]
    rows = ["".join(points[k:k + 37]) for k in range(0, len(points), 37)] + ["Straße ½ kg ㎏", "e\u0301\u0327x", "\u0483й", "가나 ①② 𝐀𝟙 ﬃ"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")

    def plain(text):
        bare = "".join(x for x in unicodedata.normalize("NFKD", text) if not unicodedata.combining(x)).upper()
        return "".join(x for x in bare if "A" <= x <= "Z" or "0" <= x <= "9" or "\u0400" <= x <= "\u04ff")

    out = df.select("t", t.norm_for_grounding(F.col("t")).alias("n"))
    assert [(r.t, r.n) for r in out.collect() if r.n != plain(r.t)] == []
    assert "Python" not in out._jdf.queryExecution().toString() and "ArrowEval" not in out._jdf.queryExecution().toString()
