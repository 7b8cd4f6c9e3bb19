"""The physical plans the operators are meant to have."""

import __spark_entry__ as entry

from catalog import inputs
from docweir.operators import routing, grounding, merge, rules

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_zone_evaluation_needs_no_shuffle_or_python(spark):
    from docweir.operators import mrz
    from pyspark.sql import functions as F
    df = spark.read.parquet(f"{SF}/customer.parquet").select(F.col("c_custkey").alias("doc_id"), F.array("c_name", "c_name", "c_name").alias("lines"))
    text = plan(mrz.zone_fields(df, mrz.TD1, inputs.today()))
    assert "Exchange" not in text and "Python" not in text


def test_merge_aggregates_before_the_shuffle(spark):
    df = spark.createDataFrame([(1, "p", "v", 0.5, True, 0)], "doc_id int, path string, value string, confidence double, validated boolean, stage_rank int")
    text = plan(merge.merge_fields(df))
    assert text.count("Exchange hashpartitioning") == 1 and "partial_min_by" in text and "Window" not in text


def test_label_rules_join_by_key_only(spark):
    lines = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "cast(doc_id as int) as line_no", "text")
    text = plan(rules.map_by_rules(lines))
    assert "NestedLoop" not in text and "Cartesian" not in text and "Python" not in text


def test_scan_reads_only_needed_columns(spark):
    text = plan(entry.queries()["usage_rollup"](spark, SF))
    assert "ReadSchema: struct<ts:" in text and "props" not in text


def test_no_cartesian_product_anywhere(spark):
    for name in ("map_by_rules", "ground_exact", "contamination", "eligible_providers", "missing_fields", "render_text", "budget_gate", "key_health"):
        text = plan(entry.queries()[name](spark, SF))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_exact_grounding_keeps_similarity_out(spark):
    v = spark.createDataFrame([(1, "p", "v")], "doc_id int, path string, value string")
    t = spark.createDataFrame([(1, "text")], "doc_id int, text string")
    assert plan(grounding.ground(v, t, None)).count("ArrowEvalPython") <= 2


def test_state_machines_need_one_exchange(spark):
    """Calls are dealt by range once, before they are written; both passes only read."""
    calls = spark.range(50).selectExpr("id AS call_id", "timestamp_seconds(id) AS ts", "'k' AS key_id", "'p' AS provider", "'unavailable' AS outcome")
    for fold in (routing.key_health, routing.circuit_breaker):
        text = plan(fold(calls))
        assert "Exchange" not in text and "Window" not in text and "Sort" not in text


def test_template_variables_are_not_joined_with_their_templates(spark):
    """Both sides would grow with the templates, and compress so well that Spark would send one to every executor."""
    from docweir.operators import templates as tpl
    t = spark.range(20).selectExpr("id AS template_id", "'{{ s.name }} {{ person.x }}{%tr for s in education.subjects %}' AS text")
    assert "Join" not in plan(tpl.classify_variables(t))
    text = plan(tpl.template_spec(t))
    assert "SortMergeJoin" in text and "Broadcast" not in text
    kinds = {(r.path, r.kind) for r in tpl.classify_variables(t).collect()}
    assert kinds == {("s.name", "loop"), ("person.x", "unknown")}


def test_many_unknown_names_are_not_broadcast(spark, monkeypatch):
    from docweir.operators import templates as tpl
    t = spark.range(30).selectExpr("id AS template_id", "'{{ person.middle_name }} {{ thing.n' || id || ' }}' AS text")
    few = {tuple(r) for r in tpl.unknown_variables(t).collect()}
    monkeypatch.setattr(tpl, "MOST_BROADCAST", 3)
    many = tpl.unknown_variables(t)
    assert "SortMergeJoin" in plan(many) and {tuple(r) for r in many.collect()} == few and len(few) == 60


def test_files_are_packed_and_listed_once_for_their_format(spark):
    """Two branches over the same files packed and listed each of them several times."""
    text = plan(entry.queries()["archive_format"](spark, SF))
    assert text.count("ArrowEvalPython [") == 2 and "Union" not in text


def test_rare_signs_are_looked_for_in_uncommon_characters_only(spark):
    """The class of rare signs costs a test for each of them and character, so common characters never meet it."""
    import unicodedata
    from pyspark.sql import functions as F
    from docweir.functions.text import norm_for_grounding
    texts = ["Ünïcode é" * 50, "№ 5 ½ été ß ㎏ x", "Ёлка №12 ™", "plain text", "", "ﬁne ⅷ Ⅻ " + "a" * 999, "日本 ㍿ \U0001d54f"]

    def brute(t):
        bare = "".join(x for x in unicodedata.normalize("NFKD", t) if not unicodedata.combining(x)).upper()
        return "".join(x for x in bare if x.isascii() and x.isalnum() or 0x400 <= ord(x) < 0x500)

    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", norm_for_grounding(F.col("t")).alias("n"))
    assert all(r.n == brute(r.t) for r in df.collect())
    assert "RLIKE(regexp_replace(" in plan(df)


def test_contamination_compares_written_candidates(spark):
    """Texts were brought into comparison form again in every filter above their second reading."""
    found = entry.queries()["contamination"](spark, SF)
    assert not any("/documents.parquet" in f for f in found.inputFiles())


def test_usual_signs_are_dropped_by_a_table(spark):
    """A class that matches at every blank cost more than the rest of the comparison form."""
    from pyspark.sql import functions as F
    from docweir.functions.text import norm_for_grounding
    df = spark.createDataFrame([("«Ça va?» – “oui”… a_b\u0301 c\x00d",), ("a-b c!",)], "t string").select("t", norm_for_grounding(F.col("t")).alias("n"))
    assert [r.n for r in df.collect()] == ["CAVAOUIABCD", "ABC"]
    assert "[^A-Z0-9]+" not in plan(df) and "«" in plan(df)


def test_label_rules_look_at_each_line_once(spark):
    """Two branches over the labels and three over the lines derived and tested every line again."""
    lines = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "cast(doc_id as int) as line_no", "text")
    assert not any("/documents.parquet" in f for f in rules.map_by_rules(lines).inputFiles())


def test_whole_words_are_searched_plainly_first(spark):
    """A pattern for each label and line cost more than all else; the plain search refuses almost every line."""
    lines = spark.createDataFrame([("d", 1, "passport no AA1234567"), ("d", 2, "nothing")], "doc_id string, line_no int, text string")
    hits = rules.label_hits(lines, whole_word=True)
    text = hits._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Contains(") >= 25 or "AND RLIKE(" in text
    assert {(r.path, r.tail) for r in hits.collect()} == {("documents.0.doc_number", "AA1234567")}


def test_label_hits_normalise_each_line_once(spark):
    """The filter that Spark puts before an inner inline tested every label again, each on a line normalised anew."""
    rows = [("d", 1, "Familiyasi: ALIYEV"), ("d", 2, "JINSI:"), ("d", 3, "xyz"), ("d", 4, None), ("d", 5, "")]
    lines = spark.createDataFrame(rows, "doc_id string, line_no int, text string")
    for whole_word in (False, True):
        hits = rules.label_hits(lines, whole_word=whole_word)
        assert hits._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
        assert {tuple(r) for r in hits.collect()} == {("d", 1, "person.name.surname_latin", "ALIYEV"), ("d", 2, "person.sex", "")}


def test_cascade_reads_its_lines_once(spark):
    """Zones, rules, texts and the list of documents each derived the lines again."""
    from docweir.plans import cascade
    lines = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "1 AS line_no", "substr(text, 1, 200) AS text")
    out = cascade.cascade(lines, None, inputs.today())
    for part in (out.fields, out.documents, out.warnings, out.requests):
        assert not any("/documents.parquet" in f for f in part.inputFiles())


def test_redaction_report_replaces_each_pattern_once(spark):
    """Every count began again from the whole text, so eight patterns took 28 replacements."""
    from docweir.functions.patterns import REDACTIONS
    from docweir.operators import privacy
    df = spark.createDataFrame([("a", "AB1234567 31503950012345 a@b.uz +998901234567"), ("a", ""), ("b", None)], "k string, t string")
    report = privacy.redaction_report(df, "t", "k")
    assert report._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") <= len(REDACTIONS)
    assert {r.label[0]: r.hits for r in report.collect() if r.k == "a"} == dict(zip("01234567", [1, 1, 0, 0, 1, 1, 0, 0]))
