"""Zone parsing and repair: published examples, safety properties, identities."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from catalog import inputs
from docweir.operators import merge, mrz, repair

def today():
    return F.lit("2026-01-01").cast("date")


TD1 = ["I<UTOD231458907<<<<<<<<<<<<<<<", "7408122F1204159UTO<<<<<<<<<<<6", "ERIKSSON<<ANNA<MARIA<<<<<<<<<<"]
TD3 = ["P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<", "L898902C36UTO7408122F1204159ZE184226B<<<<<10"]
WEIGHTS, ALPHA = (7, 3, 1), "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digit(s):
    return sum((0 if ch == "<" else ALPHA.index(ch)) * WEIGHTS[i % 3] for i, ch in enumerate(s)) % 10


def zones(spark, docs):
    df = spark.createDataFrame(docs, "doc_id string, lines array<string>")
    out = mrz.parse_mrz(df, today()).collect()
    return {r["doc_id"]: r for r in out}


def by_path(row):
    return {f["path"]: f for f in row["fields"]}


def test_published_examples(spark):
    got = zones(spark, [("td1", TD1), ("td3", TD3), ("bad", ["x"])])
    for key, number in (("td1", "D23145890"), ("td3", "L898902C3")):
        f = by_path(got[key])
        assert got[key]["all_valid"] and not got[key]["warnings"]
        assert (f["documents.0.doc_number"]["value"], f["person.birth_date"]["value"], f["documents.0.expiry_date"]["value"],
                f["person.sex"]["value"], f["person.nationality"]["value"]) == (number, "1974-08-12", "2012-04-15", "F", "UTO")
        assert f["person.name.patronymic_latin"]["value"] == "Maria"
        assert f["person.name.surname_cyrillic"]["source"] == "derived"
    assert not got["bad"]["found"] and "line count: 1" in got["bad"]["reason"]


def test_forged_number_fails_the_composite(spark):
    forged = "L898902C4"
    line = forged + str(digit(forged)) + TD3[1][10:]
    row = zones(spark, [("f", [TD3[0], line])])["f"]
    assert not row["all_valid"] and any("umumiy nazorat" in w for w in row["warnings"])


def test_all_filler_date_is_never_validated(spark):
    line2 = "<<<<<<0F1204159UTO<<<<<<<<<<<"
    row = zones(spark, [("x", [TD1[0], line2 + "0", TD1[2]])])["x"]
    birth = by_path(row)["person.birth_date"]
    assert birth["value"] is None and not birth["validated"]


def fix(spark, rows):
    df = spark.createDataFrame(rows, "name string, raw string, cd string, conf array<double>")
    return [r["correction"] for r in repair.repair_long(df, "conf").select("correction").collect()]


def test_repair_examples(spark):
    weak = [0.99] * 9
    weak[6] = 0.10
    a, b, c, d, e = fix(spark, [("doc_number", "D2314589O", "7", None), ("birth_date", "74O812", "2", None), ("doc_number", "L89890ZC3", "6", None),
                                ("doc_number", "L89890ZC3", "6", weak), ("doc_number", "D23145890", "<", None)])
    assert a["value"] == "D23145890" and b["value"] == "740812"
    assert c["valid"] and c["ambiguous"] and not c["corroborated"]
    assert d["value"] == "L898902C3" and d["corroborated"] and not d["ambiguous"]
    assert not e["valid"] and e["value"] == "D23145890"


def brute(raw, cd, charset):
    table = {}
    for x, y in repair.CONFUSION_PAIRS:
        table.setdefault(x, set()).add(y)
        table.setdefault(y, set()).add(x)
    options = [sorted(o for o in table.get(ch, ()) if charset is None or o in charset) for ch in raw]
    if digit(raw) == int(cd):
        return [raw]
    for k in (1, 2, 3):
        found = []
        for places in itertools.combinations([i for i, o in enumerate(options) if o], k):
            for chars in itertools.product(*[options[i] for i in places]):
                s = list(raw)
                for i, ch in zip(places, chars):
                    s[i] = ch
                if digit("".join(s)) == int(cd):
                    found.append("".join(s))
        if found:
            return found
    return []


def test_candidates_equal_brute_force_in_order(spark):
    rng = random.Random(3)
    rows = [("doc_number" if n % 2 else "birth_date", "".join(rng.choice("0O1I5S8BAX<7" if n % 2 else "0123456789O") for _ in range(9 if n % 2 else 6)),
             str(rng.randint(0, 9)), None) for n in range(120)] + [("doc_number", "<<<<<<<<<", "5", None), ("doc_number", "WWWWWWWW8", "3", None)]
    df = spark.createDataFrame(rows, "name string, raw string, cd string, conf array<double>")
    got = df.select("*", repair.repair_candidates(F.col("raw"), F.col("cd"), repair.confusion_map_for(F.col("name"))).alias("c")).collect()
    for r in got:
        want = brute(r["raw"], r["cd"], repair.DIGITS if r["name"] == "birth_date" else None)
        assert [x["value"] for x in r["c"]] == want, r


def test_never_wrong_and_trusted(spark):
    """Detectable errors are either repaired rightly or not trusted; ambiguity is active."""
    rng = random.Random(1234)
    table = repair.confusions()
    rows, truth = [], []
    for original in ("D23145890", "L898902C3", "AA1234567", "AB9876543", "C01234567", "KA7654321", "M12345678"):
        for _ in range(40):
            places = rng.sample([i for i, ch in enumerate(original) if ch in table], 2)
            s = list(original)
            for i in places:
                s[i] = rng.choice(table[original[i]])
            s = "".join(s)
            if digit(s) != digit(original):
                rows.append(("doc_number", s, str(digit(original)), None))
                truth.append(original)
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "k int, name string, raw string, cd string, conf array<double>")
    out = {r["k"]: r["correction"] for r in repair.repair_long(df, "conf").collect()}
    trusted = [out[k] for k in out if out[k]["valid"] and not out[k]["ambiguous"] and (out[k]["edits"] == 0 or out[k]["corroborated"])]
    assert len(rows) > 100 and not trusted
    assert any(c["ambiguous"] for c in out.values())


def test_single_error_recovery_with_confidence(spark):
    table, rows, truth = repair.confusions(), [], []
    for original in ("D23145890", "L898902C3", "AA1234567", "AB9876543"):
        for i, ch in enumerate(original):
            for other in table.get(ch, ""):
                conf = [0.99] * 9
                conf[i] = 0.2
                rows.append((len(rows), "doc_number", original[:i] + other + original[i + 1:], str(digit(original)), conf))
                truth.append(original)
    df = spark.createDataFrame(rows, "k int, name string, raw string, cd string, conf array<double>")
    good = 0
    for r in repair.repair_long(df, "conf").collect():
        c = r["correction"]
        good += c["value"] == truth[r["k"]] and c["valid"] and not c["ambiguous"] and (c["edits"] == 0 or c["corroborated"])
    assert good / len(rows) > 0.75


def test_parse_of_synthesised_zones_is_identity(spark):
    sf = "/root/testdata/sf0.001"
    z = mrz.zone_fields(inputs.mrz_clean(spark, sf), mrz.TD1, today())
    rows = mrz.explode_fields(z.filter("all_valid"), "doc_id", "doc_no", "pinfl", "birth")
    bad = rows.filter(((F.col("path") == "documents.0.doc_number") & (F.col("value") != F.col("doc_no")))
                      | ((F.col("path") == "person.pinfl") & (F.col("value") != F.col("pinfl")))
                      | ((F.col("path") == "person.birth_date") & (F.col("value") != F.date_format("birth", "yyyy-MM-dd"))))
    assert z.filter("not all_valid").count() == 0 and bad.count() == 0 and rows.count() > 0


def test_merge_equals_pairwise_fold(spark):
    levels = [(0.5, False), (0.8, False), (0.5, True), (0.9, True)]
    rows, want = [], {}
    for n, combo in enumerate(itertools.product(range(4), repeat=4)):
        current = None
        for stage, level in enumerate(combo):
            conf, ok = levels[level]
            rows.append((n, "p", str(stage), conf, ok, stage))
            if current is None or (not current[1] and (ok or conf > current[0])):
                current = (conf, ok, str(stage))
        want[n] = current[2]
    df = spark.createDataFrame(rows, "doc_id int, path string, value string, confidence double, validated boolean, stage_rank int")
    assert {r["doc_id"]: r["value"] for r in merge.merge_fields(df.repartition(7)).collect()} == want


@pytest.mark.parametrize("layout", [mrz.TD1, mrz.TD3])
def test_composite_offsets(layout):
    assert [mrz.composite_offset(layout, n) for n in layout.repaired] == ([0, 25, 32] if layout is mrz.TD1 else [0, 10, 17, 24])
