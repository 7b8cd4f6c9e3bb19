"""Label rules, grounding, containment and the cascade."""

from pyspark.sql import functions as F

from docweir.operators import grounding, merge, rules
from docweir.plans import cascade

LINES = ["O'ZBEKISTON RESPUBLIKASI", "Familiyasi: ALIYEV", "Ismi: SHOHRUH", "Otasining ismi: AKMAL O'G'LI", "Tug'ilgan sanasi: 15.03.1995",
         "Tug'ilgan joyi: Toshkent shahri", "JSHSHIR 31503950012345", "Seriya AA1234567", "Berilgan sana: 10.01.2020",
         "Amal qilish muddati: 10.01.2030", "Jinsi: M"]


def lines_df(spark, docs):
    return spark.createDataFrame([(d, n + 1, t) for d, ls in docs.items() for n, t in enumerate(ls)], "doc_id string, line_no int, text string")


def mapped(spark, docs, **kw):
    out = {}
    for r in rules.map_by_rules(lines_df(spark, docs), **kw).collect():
        out.setdefault(r["doc_id"], {})[r["path"]] = r["value"]
    return out


def test_labels(spark):
    got = mapped(spark, {"id": LINES, "ru": ["Фамилия: КАРИМОВ", "Дата рождения: 01.02.1980"], "below": ["Familiyasi", "ALIYEV"],
                         "bare": ["random", "31503950012345"], "split": ["x AB", "1234567 y"], "junk": ["####", "?????", "   "]})
    a = got["id"]
    assert a["person.name.surname_latin"] == "ALIYEV" and a["person.birth_date"] == "1995-03-15"
    assert a["person.pinfl"] == "31503950012345" and a["documents.0.doc_number"] == "AA1234567" and a["person.sex"] == "M"
    assert a["documents.0.issue_date"] == "2020-01-10" and a["documents.0.expiry_date"] == "2030-01-10"
    assert got["ru"]["person.name.surname_latin"] == "КАРИМОВ" and got["ru"]["person.birth_date"] == "1980-02-01"
    assert got["below"]["person.name.surname_latin"] == "ALIYEV"
    assert got["bare"]["person.pinfl"] == "31503950012345"
    assert got["split"]["documents.0.doc_number"] == "AB\n1234567"
    assert "junk" not in got


def test_whole_word_labels(spark):
    docs = {"d": ["Surname: SMITH"]}
    assert "person.name.given_name_latin" in mapped(spark, docs)["d"]
    assert "person.name.given_name_latin" not in mapped(spark, docs, whole_word=True)["d"]


def test_grounding(spark):
    values = spark.createDataFrame([
        ("d", "person.pinfl", "31503950012345"), ("d", "person.pinfl2", "31503950012346"), ("d", "person.birth_date", "1995-03-15"),
        ("d", "documents.0.issue_date", "2001-01-01"), ("d", "person.address", "Toshkent shahari"), ("d", "person.phone", None),
        ("d", "person.birth_place", "Buxoro")], "doc_id string, path string, value string")
    texts = spark.createDataFrame([("d", "JSHSHIR 31503950012345 tug 15.03.1995\nToshkent shahri")], "doc_id string, text string")
    got = {r["path"]: (r["accepted"], r["value"]) for r in grounding.keep_grounded(grounding.ground(values, texts)).collect()}
    assert got == {"person.pinfl": (True, "31503950012345"), "person.pinfl2": (False, None), "person.birth_date": (True, "1995-03-15"),
                   "documents.0.issue_date": (False, None), "person.address": (True, "Toshkent shahari"), "person.phone": (True, None),
                   "person.birth_place": (False, None)}


def test_vision_reply_drops_illegible(spark):
    df = spark.createDataFrame([("d", '{"values": {"a": "1", "b": "2", "c": null}, "legible": {"b": false}}')], "doc_id string, reply string")
    assert {(r["path"], r["value"]) for r in grounding.parse_reply(df).collect()} == {("a", "1"), ("c", None)}


def test_contamination_equals_brute_force(spark):
    """Long, short, repeated and boilerplate passages; one text shared by many documents."""
    import random
    rng = random.Random(11)

    def words(n):
        return " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(2, 6))) for _ in range(n))
    passages = [(n, words(rng.randint(1, 40))) for n in range(40)] + [(100, "ab"), (101, "É-cole"), (102, words(30))]
    passages.append((103, passages[-1][1]))
    docs = []
    for n in range(60):
        parts = [words(20)] + ([passages[n % len(passages)][1].upper()] if n % 2 else []) + [words(15)]
        docs.append((n, "".join(parts) if n % 4 == 1 else " / ".join(parts)))
    docs += [(1000 + n, "header " + passages[-1][1] + " footer") for n in range(30)]
    d = spark.createDataFrame(docs, "doc_id int, text string")
    p = spark.createDataFrame(passages, "item_id int, text string")

    def norm(s):
        import unicodedata
        s = "".join(ch for ch in unicodedata.normalize("NFKD", s) if not unicodedata.combining(ch)).upper()
        return "".join(ch for ch in s if ch.isascii() and ch.isalnum())
    want = {(a, b) for a, x in docs for b, y in passages if norm(y) in norm(x)}
    for limit in (64 << 20, 0):  # broadcast and shuffled variants
        got = [(r["doc_id"], r["item_id"]) for r in grounding.contamination(d, p, broadcast_bytes=limit).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_cascade_end_to_end(spark):
    docs = {"d1": LINES + ["I<UTOD231458907<<<<<<<<<<<<<<<", "7408122F1204159UTO<<<<<<<<<<<6", "ERIKSSON<<ANNA<MARIA<<<<<<<<<<"], "d2": ["nothing here"]}
    replies = spark.createDataFrame([("d1", '{"person.address": "Toshkent shahri", "person.phone": "998901234567", "person.pinfl": "31503950012345"}')],
                                    "doc_id string, reply string")
    out = cascade.cascade(lines_df(spark, docs), replies, F.lit("2026-01-01").cast("date"))
    fields = {(r["doc_id"], r["path"]): r for r in out.fields.collect()}
    assert fields["d1", "documents.0.doc_number"]["value"] == "D23145890" and fields["d1", "documents.0.doc_number"]["validated"]
    assert fields["d1", "person.birth_place"]["source"] == "ocr_visual"
    assert fields["d1", "person.address"]["source"] == "llm_text"
    assert ("d1", "person.phone") not in fields          # not in the text
    rows = {r["doc_id"]: r for r in out.documents.collect()}
    assert rows["d1"]["stages_used"] == ["L0_mrz", "L1_rules", "L2_llm_text"]
    assert "person.phone" in rows["d1"]["needs_review"] and rows["d1"]["status"] == "review_needed"
    assert rows["d2"]["overall_confidence"] == 0 and len(rows["d2"]["needs_review"]) == 19
    warnings = {(r["doc_id"], r["warning"]) for r in out.warnings.collect()}
    assert any("muddati tugagan" in w for _, w in warnings) and any("topilmadi" in w for _, w in warnings)


def test_nested_round_trip(spark):
    rows = [("a", "person.name.surname_latin", "X", 0.5, "mrz", False), ("a", "documents.0.doc_number", "Y", 0.9, "mrz", True)]
    df = spark.createDataFrame(rows, "doc_id string, path string, value string, confidence double, source string, validated boolean")
    back = merge.flatten_result(merge.unflatten(df)).filter("value is not null")
    assert {(r["path"], r["value"], r["validated"]) for r in back.collect()} == {("person.name.surname_latin", "X", False), ("documents.0.doc_number", "Y", True)}


def test_cascade_keeps_education_and_rejected_answers(spark):
    docs = {"1": ["Familiyasi: KARIMOV", "Universitet: TOSHKENT UNIVERSITETI"], "2": ["Universitet: BOSHQA"]}
    replies = spark.createDataFrame([("1", '{"person.pinfl": "31503950012345"}')], "doc_id string, reply string")
    types = spark.createDataFrame([("1", "diploma_supplement"), ("2", "id_front")], "doc_id string, doc_type string")
    out = cascade.cascade(lines_df(spark, docs), replies, F.lit("2026-01-01").cast("date"), doc_types=types)
    education = out.fields.filter(F.col("path").startswith("education.") & F.col("value").isNotNull())
    assert {r.doc_id for r in education.collect()} == {"1"}
    review = {r.doc_id: r.needs_review for r in out.documents.collect()}
    assert any(p.startswith("education.") for p in review["1"]) and not any(p.startswith("education.") for p in review["2"])
    asked = {(r.doc_id, p) for r in out.requests.collect() for p in r.fields}
    assert {p for d, p in asked if d == "1"} >= set(review["1"]) - {"documents.0.doc_number"}
    assert [(r.doc_id, r.path) for r in out.rejected.collect()] == [("1", "person.pinfl")]
