"""Queries over golden-set comparison, classifier scores, geometry and image gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs as i
from catalog.ctes import q, sql, sql_list
from catalog.registry import register
from docweir import messages as msg
from docweir.functions import scores
from docweir.operators import evaluation as ev, gates
from docweir.schema import DOCUMENT_TYPES

CMP = """SELECT g.doc_id, g.path, g.value AS want, a.value AS got, g.value IS NOT DISTINCT FROM a.value AS correct,
  g.value IS DISTINCT FROM a.value AND coalesce(a.validated, FALSE) AS fv FROM golden g LEFT JOIN actual a USING (doc_id, path)"""
DOCS = "SELECT doc_id, count(*) AS total, count(*) FILTER (correct) AS correct, count(*) FILTER (fv) AS fv FROM cmp GROUP BY doc_id"


def _cmp(spark, d):
    return ev.compare_golden(i.golden(spark, d), i.actual(spark, d))


@register("compare_golden", sql("SELECT doc_id, path, want, coalesce(got, '') AS got, correct, fv AS false_validated FROM cmp", "golden", "actual", cmp=CMP))
def _(spark, d):
    return _cmp(spark, d).select("doc_id", "path", "want", F.coalesce("got", F.lit("")).alias("got"), "correct", "false_validated")


@register("extraction_metrics", sql("""
SELECT count(*) AS documents, round(sum(correct) / sum(total), 6) AS field_exact_match, round(avg(CASE WHEN correct = total THEN 1.0 ELSE 0 END), 6) AS zero_touch_rate,
  round(avg(CASE WHEN status IN ('bad_quality', 'unknown_doc_type') THEN 1.0 ELSE 0 END), 6) AS reject_rate, round(sum(fv) / sum(total), 6) AS false_validated_rate,
  round(avg(CASE WHEN list_contains(stages_used, 'L3_vlm') THEN 1.0 ELSE 0 END), 6) AS l3_usage_rate, round(avg(llm_cost_usd), 6) AS cost_per_document,
  round(CAST((SELECT avg(CASE WHEN fv THEN 1.0 ELSE 0 END) FROM cmp WHERE want IS NOT NULL) AS DOUBLE), 6) AS llm_rejection_rate
FROM docs JOIN results USING (doc_id)""", "golden", "actual", "results", cmp=CMP, docs=DOCS))
def _(spark, d):
    c = _cmp(spark, d)
    checked = c.select(F.col("want").alias("value"), (~F.col("false_validated")).alias("accepted"))
    m = ev.extraction_metrics(c, i.results(spark, d), checked)
    return m.select(*[F.col(x) if x == "documents" else F.round(x, 6).alias(x) for x in m.columns])


@register("per_field_accuracy", sql("SELECT path, count(*) AS n, round(avg(CASE WHEN correct THEN 1.0 ELSE 0 END), 6) AS accuracy FROM cmp GROUP BY path", "golden", "actual", cmp=CMP))
def _(spark, d):
    return ev.per_field_accuracy(_cmp(spark, d)).withColumn("accuracy", F.round("accuracy", 6))


@register("false_validated", sql("SELECT doc_id, path, got FROM cmp WHERE fv", "golden", "actual", cmp=CMP))
def _(spark, d):
    return ev.false_validated(_cmp(spark, d)).select("doc_id", "path", "got")


@register("worst_cases", sql("SELECT doc_id, total - correct AS wrong FROM docs ORDER BY wrong DESC, doc_id LIMIT 10", "golden", "actual", cmp=CMP, docs=DOCS))
def _(spark, d):
    return ev.worst_cases(_cmp(spark, d))


@register("latency_quantiles", sql("""
SELECT provider, round(quantile_cont(latency_ms::DOUBLE, 0.5::DOUBLE), 6) AS p50, round(quantile_cont(latency_ms::DOUBLE, 0.95::DOUBLE), 6) AS p95 FROM calls GROUP BY provider""", "calls"))
def _(spark, d):
    return ev.latency_quantiles(i.calls(spark, d), "latency_ms", ["provider"]).select("provider", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@register("regression_gate", sql("""
SELECT round(a, 6) AS after, round(b, 6) AS before, a < b - 0.01 AS regressed FROM (SELECT avg(CASE WHEN correct THEN 1.0::DOUBLE ELSE 0 END) AS a,
  avg(CASE WHEN path <> 'documents.0.doc_number' AND correct OR path = 'documents.0.doc_number' THEN 1.0::DOUBLE ELSE 0 END) AS b FROM cmp)""", "golden", "actual", cmp=CMP))
def _(spark, d):
    c = _cmp(spark, d)
    after = ev.extraction_metrics(c, i.results(spark, d))
    before = c.agg(F.avg((F.col("correct") | (F.col("path") == "documents.0.doc_number")).cast("double")).alias("field_exact_match"))
    g = ev.regression_gate(after, before)
    return g.select(F.round("after", 6).alias("after"), F.round("before", 6).alias("before"), "regressed")


# --- classifier scores ------------------------------------------------------------------

M = {
    "mx": "SELECT *, list_max(logits) AS top, list_sum(list_transform(logits, lambda x: exp(x - list_max(logits)))) AS s FROM logits",
    "sc": "SELECT *, list_position(logits, top) - 1 AS predicted, 1 / s AS conf, -(top + ln(s)) AS energy FROM mx",
}


@register("softmax", sql("SELECT image_id, array_to_string(list_transform(logits, lambda x: printf('%.5f', exp(x - top) / s)), ',') AS probs FROM mx", "logits", **M))
def _(spark, d):
    return i.logits(spark, d).select("image_id", F.array_join(F.transform(scores.softmax(F.col("logits")), lambda x: F.format_string("%.5f", x)), ",").alias("probs"))


@register("free_energy", sql("SELECT image_id, round(energy, 6) AS energy FROM sc", "logits", **M))
def _(spark, d):
    return i.logits(spark, d).select("image_id", F.round(scores.free_energy(F.col("logits")), 6).alias("energy"))


@register("ood_decision", sql(f"""
SELECT image_id, {sql_list(DOCUMENT_TYPES)}[predicted + 1] AS predicted, round(conf, 6) AS confidence, CASE WHEN predicted = 6 THEN 'unknown class' WHEN conf < 0.3 THEN 'below confidence floor'
  WHEN energy > -3.0 THEN 'energy above ceiling' ELSE '' END AS reason FROM sc""", "logits", **M))
def _(spark, d):
    out = gates.ood_decision(i.logits(spark, d), min_confidence=0.3, max_energy=-3.0)
    return out.select("image_id", "predicted", F.round("confidence", 6).alias("confidence"), "reason")


def _predicted(spark, d):
    return i.logits(spark, d).withColumn("predicted", scores.top_class(F.col("logits")))


@register("confusion_matrix", sql("SELECT label, CAST(predicted AS INT) AS predicted, count(*) AS n FROM sc GROUP BY 1, 2", "logits", **M))
def _(spark, d):
    return ev.confusion_matrix(_predicted(spark, d))


F1 = """SELECT c, tp, fp, fn, CASE WHEN tp = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1 FROM (SELECT c, count(*) FILTER (label = c AND predicted = c) AS tp,
  count(*) FILTER (label <> c AND predicted = c) AS fp, count(*) FILTER (label = c AND predicted <> c) AS fn FROM sc, (SELECT unnest(range(7)) AS c) GROUP BY c)"""


@register("per_class_f1", sql("SELECT CAST(c AS INT) AS c, tp, fp, fn, round(f1, 6) AS f1 FROM f1", "logits", **M, f1=F1))
def _(spark, d):
    return ev.per_class_f1(_predicted(spark, d), 7).withColumn("f1", F.round("f1", 6))


@register("macro_f1", sql("SELECT round(avg(f1), 6) AS macro_f1 FROM f1", "logits", **M, f1=F1))
def _(spark, d):
    return ev.macro_f1(_predicted(spark, d), 7).select(F.round("macro_f1", 6).alias("macro_f1"))


@register("calibrate_thresholds", sql("""
SELECT round(quantile_cont(conf, 0.02::DOUBLE), 6) AS min_confidence, round(quantile_cont(energy, 0.98::DOUBLE), 6) AS max_energy FROM sc WHERE label <> 6""", "logits", **M))
def _(spark, d):
    c = ev.calibrate_thresholds(i.logits(spark, d), 6)
    return c.select(F.round("min_confidence", 6).alias("min_confidence"), F.round("max_energy", 6).alias("max_energy"))


@register("ood_catch_rate", sql("SELECT round(avg(CASE WHEN energy > -3.0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS caught FROM sc WHERE label = 6", "logits", **M))
def _(spark, d):
    return ev.ood_catch_rate(i.logits(spark, d), 6, -3.0).select(F.round("caught", 6).alias("caught"))


@register("score_logits", sql("""
SELECT vec_id, label, CAST(list_position(l, list_max(l)) - 1 AS INT) AS predicted FROM (SELECT vec_id, label, list_transform(range(7), lambda k:
  list_sum(list_transform(list_filter(embedding, lambda x, i: (i - 1) % 7 = k), lambda x: CAST(x AS DOUBLE)))) AS l FROM embeddings)"""))
def _(spark, d):
    def factory():
        def model(batch):
            return [[float(sum(v[k::7])) for k in range(7)] for v in batch]
        return model
    e = i.table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    return ev.score_logits(e, factory, "embedding", 7).select("vec_id", "label", scores.top_class(F.col("logits")).alias("predicted"))


@register("split_train_val", sql("""
SELECT vec_id, label, CASE WHEN CAST('0x' || substr(md5('0:' || vec_id), 1, 8) AS BIGINT) % 100 < 15 THEN 'val' ELSE 'train' END AS split FROM embeddings"""))
def _(spark, d):
    return ev.split_train_val(i.table(spark, d, "embeddings").select("vec_id", "label"), "vec_id")


@register("stage_timing_summary", sql("""
SELECT 'ocr' AS stage, count(*) AS n, CAST(sum(100 + doc_id % 50) AS BIGINT) AS ms, round(avg(100 + doc_id % 50), 6) AS avg_ms, CAST(max(100 + doc_id % 50) AS INT) AS max_ms, 1.0 AS used_rate FROM persons
UNION ALL SELECT 'L0_mrz', count(*), CAST(sum(5 + doc_id % 3) AS BIGINT), round(avg(5 + doc_id % 3), 6), CAST(max(5 + doc_id % 3) AS INT), round(avg(CASE WHEN doc_id % 4 <> 0 THEN 1.0 ELSE 0 END), 6) FROM persons""", "persons"))
def _(spark, d):
    s = ev.stage_timing_summary(i.results(spark, d))
    return s.withColumns({"avg_ms": F.round("avg_ms", 6), "used_rate": F.round("used_rate", 6)})


@register("eval_case_audit", sql("""
SELECT 'set-' || (doc_id % 4) AS "set", count(*) AS cases, count(*) FILTER (doc_id % 8 = 0) AS null_cases, 0 AS blank_inputs, count(*) FILTER (doc_id % 8 = 5) AS ungrounded,
  count(*) >= 3 AND count(*) FILTER (doc_id % 8 = 0) >= 1 AND count(*) FILTER (doc_id % 8 = 5) = 0 AS usable FROM persons GROUP BY 1""", "persons"))
def _(spark, d):
    from docweir.operators import grounding
    k = F.col("doc_id")
    value = F.when(k % 8 == 0, F.lit("null")).when(k % 8 == 5, F.lit('"99999999999999"')).otherwise(F.concat(F.lit('"'), "pinfl", F.lit('"')))
    cases = i.persons(spark, d).select(
        F.concat(F.lit("set-"), (k % 4).cast("string")).alias("set"), "doc_id", F.concat(F.lit("JSHSHIR "), "pinfl").alias("input_text"),
        (k % 8 == 0).alias("has_null"), F.concat(F.lit('{"person.pinfl": '), value, F.lit(', "subjects": [{"name": "JSHSHIR", "grade": null}]}')).alias("expected"))
    values = ev.expected_values(cases.select("set", "doc_id", "expected"))
    checked = grounding.ground(values, cases.select("doc_id", F.col("input_text").alias("text")), None)
    return ev.eval_case_audit(cases, checked)


# --- quality, geometry --------------------------------------------------------------------

def _images(spark, d):
    k = F.col("p_partkey")
    return i.table(spark, d, "part").select(
        "p_partkey", (k % 130).cast("double").alias("blur_score"), (k % 256).cast("double").alias("brightness"), (k % 90).cast("double").alias("contrast"),
        (k % 401).cast("int").alias("estimated_dpi"), F.lit(1000).alias("width"), F.lit(600).alias("height"),
        F.array(F.array(F.lit(0), F.lit(0), (k % 300).cast("int"), F.lit(100)), F.array(F.lit(5), F.lit(5), F.lit(105), (5 + k % 200).cast("int"))).alias("glare_regions"),
        (k % 17 == 0).alias("moire_detected"))


_r = msg.QUALITY


@register("quality_gate", sql(f"""
SELECT p_partkey, array_to_string(r, '|') AS reasons, len(r) = 0 AS is_acceptable FROM (SELECT p_partkey, list_filter([CASE WHEN k % 130 < 60 THEN {q(_r['blur'])} END,
  CASE WHEN k % 256 < 60 THEN {q(_r['dark'])} WHEN k % 256 > 215 THEN {q(_r['bright'])} END, CASE WHEN k % 90 < 25 THEN {q(_r['contrast'])} END,
  CASE WHEN (k % 300) * 100 + 100 * (k % 200) > 36000 THEN {q(_r['glare'])} END, CASE WHEN k % 401 < 200 THEN {q(_r['dpi'])} END,
  CASE WHEN k % 17 = 0 THEN {q(_r['moire'])} END], lambda x: x IS NOT NULL) AS r FROM (SELECT p_partkey, p_partkey AS k FROM part))"""))
def _(spark, d):
    return gates.quality_gate(_images(spark, d)).select("p_partkey", F.array_join("reasons", "|").alias("reasons"), "is_acceptable")


@register("admit_images", sql("""
SELECT CASE WHEN q THEN 'bad_quality' WHEN k % 5 = 0 THEN 'unknown_doc_type' ELSE 'admitted' END AS status, count(*) AS n FROM (SELECT p_partkey AS k, p_partkey % 130 < 60 OR p_partkey % 256 < 60
  OR p_partkey % 256 > 215 OR p_partkey % 90 < 25 OR (p_partkey % 300) * 100 + 100 * (p_partkey % 200) > 36000 OR p_partkey % 401 < 200 OR p_partkey % 17 = 0 AS q FROM part) GROUP BY 1"""))
def _(spark, d):
    from docweir.plans import cascade
    images = _images(spark, d).withColumn("doc_type", F.when(F.col("p_partkey") % 5 == 0, "unknown").otherwise("id_front"))
    yes, no = cascade.admit(images)
    return yes.withColumn("status", F.lit("admitted")).select("status").unionByName(no.select("status")).groupBy("status").agg(F.count("*").alias("n"))


@register("map_bbox_to_original", sql("""
SELECT l_orderkey, l_linenumber, l_quantity, CAST(trunc((x1 - 5) / 2) AS INT) AS x1, CAST(trunc((y1 - 7) / 4) AS INT) AS y1, CAST(trunc((x1 + 105) / 2) AS INT) AS x2, CAST(trunc((y1 + 53) / 4) AS INT) AS y2
FROM (SELECT l_orderkey, l_linenumber, l_quantity, CAST(l_quantity AS INT) * 10 AS x1, l_linenumber * 40 AS y1 FROM lineitem)"""))
def _(spark, d):
    x, y = F.col("l_quantity").cast("int") * 10, F.col("l_linenumber") * 40
    matrix = F.array(*[F.lit(float(v)) for v in (2, 0, 5, 0, 4, 7, 0, 0, 1)])
    b = scores.map_bbox_to_original(F.array(x, y, x + 110, y + 60), matrix)
    out = i.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", b.alias("b"))
    return out.select("l_orderkey", "l_linenumber", "l_quantity", *[F.get("b", F.lit(k)).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))])


@register("bbox_to_relative", sql("""
SELECT doc_id, line_no, '2 ' || printf('%.6f', 100.0 / 1012) || ' ' || printf('%.6f', ((line_no - 1) * 20 + 9.0) / 638) || ' ' || printf('%.6f', 200.0 / 1012) || ' ' || printf('%.6f', 18.0 / 638) AS label_row FROM ocr_lines""", "ocr_lines"))
def _(spark, d):
    boxes = i.ocr_lines(spark, d).withColumn("cls", F.lit(2))
    return ev.label_rows(boxes, F.lit(1012), F.lit(638)).select("doc_id", "line_no", "label_row")
