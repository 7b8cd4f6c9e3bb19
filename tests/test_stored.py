"""Sources, sinks, redaction, files, templates and key state."""

import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from docweir.operators import evaluation, files, grounding, privacy, routing, scan, templates as tpl
from docweir.sources import tables

KEY = "MDEyMzQ1Njc4OWFiY2RlZjAxMjM0NTY3ODlhYmNkZWY="


def test_extractions_round_trip_and_tamper(spark, tmp_path):
    df = spark.createDataFrame([("j1", "secret"), ("j2", "other")], "job_id string, payload string")
    tables.write_extractions(df, str(tmp_path / "x"), KEY)
    stored = spark.read.parquet(str(tmp_path / "x"))
    assert all(b"secret" not in bytes(r["data_encrypted"]) for r in stored.collect())
    assert {r["payload"] for r in tables.read_extractions(spark, str(tmp_path / "x"), KEY).collect()} == {"secret", "other"}
    moved = tables.decrypt_extractions(stored.withColumn("job_id", F.lit("j9")), KEY)
    assert all(r["payload"] is None and r["error"] for r in moved.collect())
    wrong = tables.decrypt_extractions(stored, "ZmVkY2JhOTg3NjU0MzIxMGZlZGNiYTk4NzY1NDMyMTA=")
    assert all(r["payload"] is None for r in wrong.collect())


def test_readers(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "id_visual_zone.v1.txt").write_text("old")
    (tmp_path / "p" / "id_visual_zone.v12.txt").write_text(" new \n")
    (tmp_path / "p" / "README.md").write_text("x")
    prompts = tables.read_prompts(spark, str(tmp_path / "p"))
    assert {(r["name"], r["version"], r["text"]) for r in routing.latest_prompts(prompts).drop("error").collect()} == {("id_visual_zone", 12, "new")} or \
        {r["version"] for r in prompts.collect()} == {1, 12}
    pinned = routing.latest_prompts(prompts, {"id_visual_zone": 3}).first()
    assert pinned["version"] is None and "has no v3" in pinned["error"]

    cases = [{"id": "a", "note": "", "input_text": "Familiya ALIYEV", "requested": ["x"], "expected": {"x": "ALIYEV", "y": None}},
             {"id": "b", "note": "", "input_text": "t", "requested": ["subjects"], "expected": {"subjects": [{"name": "Fizika", "grade": None}]}}]
    (tmp_path / "c.jsonl").write_text("\n".join(json.dumps(c) for c in cases) + "\n\n")
    df = tables.read_eval_cases(spark, str(tmp_path / "c.jsonl"))
    values = evaluation.expected_values(df.select(F.col("id").alias("doc_id"), "expected"))
    assert {(r["doc_id"], r["path"], r["value"]) for r in values.collect()} == {
        ("a", "x", "ALIYEV"), ("a", "y", None), ("b", "subjects.0.name", "Fizika"), ("b", "subjects.0.grade", None)}
    checked = grounding.ground(values, df.select(F.col("id").alias("doc_id"), F.col("input_text").alias("text")))
    assert checked.filter("not accepted").count() == 1

    (tmp_path / "l.json").write_text(json.dumps({"doc_id": 1, "page": 0, "line_no": 1, "text": "x", "box": [[3, 4], [9, 4], [9, 8], [2, 8]], "confidence": 0.5}))
    assert tables.read_ocr_lines(spark, str(tmp_path / "l.json")).first()["bbox"] == [2, 4, 9, 8]
    (tmp_path / "u.bin").write_bytes(b"%PDF-1")
    up = tables.read_uploads(spark, str(tmp_path), "*.bin")
    good, bad = files.validate_uploads(up, 100)
    assert good.first()["mime"] == "application/pdf" and bad.count() == 0


def test_sinks(spark, tmp_path):
    cache = spark.createDataFrame([("t0", "k1", "{}", "2024-01-01 00:00:00"), ("t1", "k2", "{}", "2024-03-01 00:00:00")],
                                  "tenant string, cache_key string, value string, e string").withColumn("expires_at", F.col("e").cast("timestamp")).drop("e")
    tables.write_cache(cache, str(tmp_path / "cache"))
    assert os.path.isdir(tmp_path / "cache" / "tenant=t0")
    assert [r["cache_key"] for r in tables.read_cache(spark, str(tmp_path / "cache"), F.lit("2024-02-01").cast("timestamp")).collect()] == ["k2"]
    docs = spark.createDataFrame([("j", 1, "text", "2024-01-01")], "job_id string, template_id int, text string, c string").withColumn(
        "created_at", F.col("c").cast("timestamp")).drop("c")
    tables.write_documents(docs, str(tmp_path / "docs"))
    assert str(spark.read.parquet(str(tmp_path / "docs")).first()["expires_at"])[:10] == "2024-03-31"
    tables.write_jsonl(docs.select("job_id"), str(tmp_path / "meta"))
    assert spark.read.json(str(tmp_path / "meta")).count() == 1
    users = spark.createDataFrame([("u", "e", "user", True, None)], tables.TABLES["users"])
    users.write.parquet(str(tmp_path / "users"))
    assert tables.read_table(spark, "users", str(tmp_path / "users")).schema == tables.TABLES["users"]


def test_redaction(spark):
    text = "mail a.b@x.uz tel 998901234567 id 31503950012345 no AA1234567 key sk-abcdefghijkl99\nP<UTOERIKSSON<<ANNA<MARIA<<<<<<<<\n1995-03-15 tug'ilgan\n1995-03-15 kun"
    out = spark.range(1).select(privacy.redact_text(F.lit(text)).alias("t")).first()["t"]
    assert out == ("mail <EMAIL> tel <PHONE> id <PINFL> no <DOCNO> key <APIKEY>\n<MRZ>\n<DATE> tug'ilgan\n1995-03-15 kun")


def test_redact_json_with_repeated_keys(spark):
    bodies = ['{"password":"x1y","password":"x2y"}', '[{"a":1,"a":2.50},{"Token":"zz9"}]',
              '{"surname":"Doe","q":{"a":null,"a":"free \\"text\\""},"t\\u006fken":77}', '{"a": {"surname": "Roe", ', "plain"]
    got = [r.t for r in spark.createDataFrame([(b,) for b in bodies], "b string").select(
        privacy.redact_json(F.col("b")).alias("t")).collect()]
    assert got == ['{"password": "<REDACTED>", "password": "<REDACTED>"}', '[{"a": 1, "a": 2.50}, {"Token": "<REDACTED>"}]',
                   '{"surname": "<REDACTED>", "q": {"a": null, "a": "free \\"text\\""}, "token": "<REDACTED>"}', '{"a": {"surname": "<REDACTED>", ', "plain"]


def test_redact_text_that_is_almost_json(spark):
    """A comma too many, missing ends, single quotes and noise: sensitive keys still lose their values."""
    bodies = ['{"password": "x1y", "n": 5,}', '{"a": [{"token": 77}, {"surname": true, "b": false}', '{"password": "x1y" "n": 31503950012345}',
              '[note] call 31503950012345 now', '{"password": null, "address": {"city": "T"}, "pinfl": [1, "31503950012345"],}', '{"password": "x1y', '{]}:,"a"', '{"secret": tr}']
    got = [r["t"] for r in spark.createDataFrame([(k, b) for k, b in enumerate(bodies)], "k int, b string").orderBy("k").select(
        privacy.redact_json(F.col("b")).alias("t")).collect()]
    assert got[0] == '{"password": "<REDACTED>", "n": 5, }' and got[1] == '{"a": [{"token": "<REDACTED>"}, {"surname": "<REDACTED>", "b": false}'
    assert "x1y" not in got[2] and got[3] == "[note]call <PINFL> now"
    assert got[4] == '{"password": null, "address": {"city": "T"}, "pinfl": [1, "<PINFL>"], }' and all(isinstance(x, str) for x in got)
    assert got[5] == '{"password": "<REDACTED>"' and got[7] == '{"secret": "<REDACTED>"}'


@pytest.mark.parametrize("depth", range(1, 11))
def test_both_forms_of_json_redaction_agree(spark, depth):
    body = {"token": "t", "x": 1.5, "pinfl": 12, "ok": True, "none": None, "list": ["a", {"email": "e"}]}
    for k in range(depth):
        body = {"deeper": body, "token": k} if k % 2 else [body, "s", 3]
    text = json.dumps(body)
    pieces = "".join(x["plain"] if x["plain"] is not None else json.dumps(x["text"]) for x in privacy._pieces(text))
    variant = spark.range(1).select(privacy.redact_json(F.lit(text)).alias("t")).first()["t"]
    assert json.loads(pieces) == json.loads(variant)


def test_redact_json_depth(spark):
    deep = {"a": "x"}
    for _ in range(30):
        deep = {"n": deep}
    body = json.dumps({"Passport": 7, "list": ["31503950012345"], "deep": deep, "address": {"city": "T"}})
    out = json.loads(spark.range(1).select(privacy.redact_json(F.lit(body)).alias("t")).first()["t"])
    assert out["Passport"] == "<REDACTED>" and out["list"] == ["<PINFL>"] and out["address"] == {"city": "T"}
    assert "<TRUNCATED>" in json.dumps(out["deep"])


def _zip(members):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return b.getvalue()


def test_formats_and_archives(spark):
    rows = [("docx", _zip({"word/document.xml": "x"})), ("docm", _zip({"word/document.xml": "x", "word/vbaProject.bin": "y"})), ("zip", _zip({"a": "b"})),
            ("unknown", b"PK\x03\x04garbage"), ("rtf", b"{\\rtf1"), ("doc", bytes.fromhex("d0cf11e0a1b11ae1")), ("html", b"  <HTML>"), ("unknown", b"plain")]
    df = spark.createDataFrame([(n, bytearray(b)) for n, b in rows], "want string, content binary")
    assert all(r["want"] == r["format"] for r in files.detect_format(df).collect())
    bad = spark.createDataFrame([("up", bytearray(_zip({"../x": "1"}))), ("bomb", bytearray(_zip({"z": "0" * 2_000_000}))), ("ok", bytearray(rows[0][1]))], "n string, content binary")
    got = {r["n"]: r["reasons"] for r in files.archive_safety(bad).collect()}
    assert got == {"up": ["path traversal"], "bomb": ["suspicious compression ratio"], "ok": []}


def test_image_quality(spark):
    white, checks = bytes([255]) * (64 * 64), bytes((255 if (x // 4 + y // 4) % 2 else 0) for y in range(64) for x in range(64))
    df = spark.createDataFrame([("white", 64, 64, 1, bytearray(white)), ("checks", 64, 64, 1, bytearray(checks))],
                               "n string, height int, width int, channels int, data binary")
    got = {r["n"]: r for r in files.image_quality(df).collect()}
    assert got["white"]["blur_score"] == 0 and len(got["white"]["glare_regions"]) == 16
    assert got["checks"]["blur_score"] > 60 and abs(got["checks"]["brightness"] - 127.5) < 1


def test_templates(spark):
    t = spark.createDataFrame([(1, "A {{ person.pinfl|pinfl_spaced }} {{ extra.x|default('none') }} {{ s.name }}{%tr for s in education.subjects %}"),
                               (2, "{{ person.middle_name }} {{ open ")], "template_id int, text string")
    spec = {r["template_id"]: r for r in tpl.template_spec(t).collect()}
    assert spec[1]["required"] == ["person.pinfl"] and spec[1]["extra"] == ["x"] and spec[1]["loops"] == ["education.subjects"]
    assert spec[2]["unknown"] == ["person.middle_name"] and spec[2]["unbalanced"]
    assert tpl.unknown_variables(t).first()["suggestion"] == "person.name.patronymic_latin"


def test_empty_render_leaves_fill_in_lines(spark):
    t = spark.createDataFrame([(1, "N {{ person.pinfl }} {{ extra.y|default('') }}{% if person.sex == 'F' %}a{% else %}b{% endif %}")], "template_id int, text string")
    f = spark.createDataFrame([(7, "person.pinfl", None)], "doc_id int, path string, value string")
    pairs = spark.createDataFrame([(7, 1)], "doc_id int, template_id int")
    out = tpl.render(t, tpl.contexts(f), pairs)
    assert out.first()["text"] == "N ____________ b" and tpl.dangling_tags(out).count() == 0


def _calls(spark, rows):
    return spark.createDataFrame([(n, k, p, o, t) for n, (k, p, o, t) in enumerate(rows)], "call_id long, key_id string, provider string, outcome string, s long") \
        .withColumn("ts", F.timestamp_seconds(F.lit(1700000000) + F.col("s"))).drop("s")


def test_key_health_and_breaker_states(spark):
    rows = [("k", "p", "unavailable", t) for t in (0, 1, 2, 3, 4, 5)] + [("k", "p", "bad_request", 6), ("k", "p", "quota", 7), ("k", "p", "unavailable", 4000), ("k", "p", "ok", 4001)]
    health = {r["call_id"]: r for r in routing.key_health(_calls(spark, rows)).collect()}
    assert [health[n]["failures"] for n in range(10)] == [1, 2, 3, 4, 5, 6, 6, 7, 1, 0]
    assert health[5]["cooldown_s"] == 64 and health[7]["cooldown_s"] == 3600 and health[9]["state"] == "healthy"
    opened = {r["call_id"]: r["open"] for r in routing.circuit_breaker(_calls(spark, [r for r in rows if r[2] != "bad_request"])).collect()}
    assert [opened[n] for n in range(9)] == [False] * 4 + [True, True, True, False, False]


@pytest.mark.parametrize("targets", [0, 100_000])
def test_exact_quantiles_equal_percentile(spark, monkeypatch, targets):
    """Skewed, constant, tiny, negative and infinite values, null groups and values, with and without a broadcast."""
    import numpy as np
    monkeypatch.setattr(scan, "SMALL_TARGETS", targets)
    rng = np.random.default_rng(1)
    groups = {"skew": [0.0] * 20000 + [float(x) ** 3 for x in range(15000)] + [1e12], "pair": [1.0, 2.0], "one": [7.5], "same": [3.25] * 500,
              "tiny": [-0.0, 0.0, 5e-324, -5e-324, 1e-300], "close": [1.0 + k * 2.0 ** -50 for k in range(300)],
              "signs": rng.normal(0, 1e3, 4000).tolist(), "wide": (10.0 ** rng.uniform(-300, 300, 3000)).tolist(), None: [4.0, 5.0, 9.0]}
    rows = [(g, v) for g, values in groups.items() for v in values] + [("pair", None), ("nothing", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    qs = [0.0, 0.02, 0.5, 0.75, 0.98, 1.0]
    out = scan.exact_quantiles(df, ["g"], "v", qs)
    got = {(r["g"], r["q"]): r["value"] for r in out.collect()}
    want = {(r["g"], q): r["p"][k] for r in df.groupBy("g").agg(F.percentile("v", qs).alias("p")).collect() if r["p"] for k, q in enumerate(qs)}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-12, abs=0) for k in want)
    assert "Window" not in out._jdf.queryExecution().toString()
    every = {r["q"]: r["value"] for r in scan.exact_quantiles(df, [], "v", [0.5]).collect()}
    assert every[0.5] == df.agg(F.percentile("v", F.lit(0.5))).first()[0]


def test_running_total_with_equal_times(spark):
    rows = [(n, "k", 1700000000 + n // 5, n % 3) for n in range(500)]
    df = spark.createDataFrame(rows, "id long, k string, s long, v long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["id"]: r["t"] for r in scan.running_total(df, ["k"], ["ts", "id"], "v", "t").collect()}
    total = 0
    for n, *_rest, v in rows:
        assert got[n] == total
        total += v
