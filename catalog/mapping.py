"""Queries that map lines to fields, check evidence, and merge candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs as i, routing as routing_queries
from catalog.ctes import q, sql, sql_list
from catalog.registry import register
from catalog.routing import signals_sql
from catalog.scalars import apostrophes, comparable, strip
from catalog.zones import TD1_FIELDS
from docweir import messages as msg
from docweir.operators import grounding, merge, mrz, rules
from docweir.plans import answering, cascade
from docweir.session import scratch_path
from docweir.schema import DOCUMENT_PATHS, EXACT_MATCH_PATHS, PERSON_PATHS

# --- label rules --------------------------------------------------------------

_labels = ", ".join(
    f"({q(path)}, {q(label)}, {rank})" for path in rules.LABELS
    for rank, label in enumerate(rules.ordered_labels(path)))

WB = r"(?:^|[^\p{L}\p{N}_])"


def coerce_sql() -> str:
    r = "raw"
    def ex(e, pat, g=1):
        return f"regexp_extract({e}, {q(pat)}, {g})"
    iso = ex(r, r"\b(\d{4}-\d{2}-\d{2})\b")
    dm = r"\b(\d{1,2})[.\-/](\d{1,2})[.\-/](\d{4})\b"
    date = (f"CASE WHEN {iso} <> '' THEN {iso} WHEN {ex(r, dm, 3)} <> '' THEN {ex(r, dm, 3)} || '-' || "
            f"lpad({ex(r, dm, 2)}, 2, '0') || '-' || lpad({ex(r, dm, 1)}, 2, '0') ELSE '' END")
    free = f"regexp_replace(regexp_replace({r}, '\\s{{2,}}', ' ', 'g'), '^[ :;.\\-]+|[ :;.\\-]+$', '', 'g')"
    sex = ex(f"upper({r})", WB + r"([MFМЖ])(?:$|[^\p{L}\p{N}_])")
    no = ex("upper(raw)", r"\b([A-Z]{2}\s?\d{6,8})\b")
    pin = ex("replace(raw, ' ', '')", r"\b(\d{14})\b")
    year = ex(r, r"\b((?:19|20)\d{2})\b")
    return (f"NULLIF(CASE WHEN ends_with(path, '_date') THEN {date} WHEN path = 'person.pinfl' THEN {pin} "
            f"WHEN path = 'documents.0.doc_number' THEN replace({no}, ' ', '') "
            f"WHEN path = 'person.sex' THEN translate({sex}, 'МЖ', 'MF') "
            f"WHEN path = 'education.graduation_year' THEN {year} "
            f"WHEN length({free}) > 1 THEN {apostrophes(free)} ELSE '' END, '')")


RULE_CTES = {
    "labels": f"SELECT path, label, rank, lower({apostrophes('label')}) AS nl FROM (VALUES {_labels}) AS t(path, label, rank)",
    "low": f"SELECT *, {strip(f'lower({apostrophes(chr(116) + chr(101) + chr(120) + chr(116))})')} AS low FROM ocr_lines",
    "hit0": "SELECT doc_id, line_no, text, low, path, label, nl, row_number() OVER (PARTITION BY doc_id, line_no, path ORDER BY rank) AS rn "
            "FROM low JOIN labels ON contains(low, nl)",
    "hit": f"SELECT doc_id, line_no, path, {strip('ltrim(substr(text, strpos(low, nl) + length(label)), ' + q(rules.LABEL_EDGE) + ')')} AS tail "
           "FROM hit0 WHERE rn = 1",
    "rawv": f"SELECT h.doc_id, h.line_no, h.path, {strip('CASE WHEN tail <> ' + q('') + ' THEN tail ELSE n.text END')} AS raw FROM hit h LEFT JOIN ocr_lines n "
            "ON n.doc_id = h.doc_id AND n.line_no = h.line_no + 1",
    "vals": f"SELECT doc_id, line_no, path, 0 AS fb, {coerce_sql()} AS value FROM rawv "
            r"UNION ALL SELECT doc_id, line_no, 'person.pinfl', 1, NULLIF(regexp_extract(replace(text, ' ', ''), '\b(\d{14})\b', 1), '') FROM ocr_lines "
            r"UNION ALL SELECT doc_id, line_no, 'documents.0.doc_number', 1, NULLIF(replace(regexp_extract(upper(text), '\b([A-Z]{2}\s?\d{6,8})\b', 1), ' ', ''), '') FROM ocr_lines",
    "rulev": "SELECT doc_id, path, arg_min(value, fb * 1000000 + line_no) AS value FROM vals WHERE value IS NOT NULL GROUP BY doc_id, path",
}


@register("map_by_rules", sql("SELECT doc_id, path, value FROM rulev", "ocr_lines", **RULE_CTES))
def _(spark, d):
    return rules.map_by_rules(i.ocr_lines(spark, d))


# Whole words: what stands before the first such label is empty or ends in no word character.
_word = r"[\p{L}\p{M}\p{N}\p{Pc}]"
_edge = "'(?s)^((?:.*?[^' || substr('" + _word + "', 2) || ')??)' || regexp_escape(nl) || '(?:[^' || substr('" + _word + "', 2) || '|$)'"
WHOLE_CTES = dict(
    {k: RULE_CTES[k] for k in ("labels", "low")},
    held="SELECT * FROM low JOIN labels ON contains(low, nl)",
    hit0=f"SELECT doc_id, line_no, text, low, path, label, nl, row_number() OVER (PARTITION BY doc_id, line_no, path ORDER BY rank) AS rn "
         f"FROM held WHERE regexp_matches(low, {_edge})",
    hit=f"SELECT doc_id, line_no, path, {strip(f'ltrim(substr(text, length(regexp_extract(low, {_edge}, 1)) + 1 + length(label)), ' + q(rules.LABEL_EDGE) + ')')} AS tail "
        "FROM hit0 WHERE rn = 1",
    **{k: v for k, v in RULE_CTES.items() if k not in ("labels", "low", "hit0", "hit")})


@register("map_by_rules_whole_word", sql("SELECT doc_id, path, value FROM rulev", "ocr_lines", **WHOLE_CTES))
def _(spark, d):
    return rules.map_by_rules(i.ocr_lines(spark, d), whole_word=True)


@register("label_hits", sql("SELECT path, count(*) AS n, count(*) FILTER (tail = '') AS below FROM hit GROUP BY path",
                            "ocr_lines", **RULE_CTES))
def _(spark, d):
    return rules.label_hits(i.ocr_lines(spark, d)).groupBy("path").agg(
        F.count("*").alias("n"), F.count_if(F.col("tail") == "").alias("below"))


@register("read_ocr_lines", sql("SELECT doc_id, line_no, text, 0 AS x1, (line_no - 1) * 20 AS y1, 200 AS x2, (line_no - 1) * 20 + 18 AS y2 FROM ocr_lines", "ocr_lines"))
def _(spark, d):
    from docweir.functions.scores import polygon_bbox
    y = (F.col("line_no") - 1) * 20
    poly = F.array(F.array(F.lit(0), y), F.array(F.lit(200), y), F.array(F.lit(200), y + 18), F.array(F.lit(0), y + 18))
    out = i.ocr_lines(spark, d).select("doc_id", "line_no", "text", polygon_bbox(poly).alias("b"))
    return out.select("doc_id", "line_no", "text", *[F.get("b", F.lit(k)).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))])


# --- replies and grounding ------------------------------------------------------

REPLY_CTES = {
    "kv": "SELECT doc_id, unnest(json_keys(body)) AS path, body FROM replies WHERE doc_id % 11 <> 0",
    "parsed": "SELECT doc_id, path, json_extract_string(body, '$.\"' || path || '\"') AS value FROM kv",
}


@register("parse_reply", sql("SELECT doc_id, path, coalesce(value, '') AS value FROM parsed", "replies", **REPLY_CTES))
def _(spark, d):
    return grounding.parse_reply(i.replies(spark, d)).withColumn("value", F.coalesce("value", F.lit("")))


@register("parse_vision_reply", sql("""
SELECT doc_id, unnest(CASE WHEN doc_id % 2 = 0 THEN ['person.pinfl'] ELSE ['person.name.surname_latin', 'person.pinfl'] END) AS path,
  unnest(CASE WHEN doc_id % 2 = 0 THEN [pinfl] ELSE [surname, pinfl] END) AS value FROM persons""", "persons"))
def _(spark, d):
    legible = F.when(F.col("doc_id") % 2 == 0, "false").otherwise("true")
    body = F.concat(F.lit('{"values": {"person.name.surname_latin": "'), "surname", F.lit('", "person.pinfl": "'), "pinfl",
                    F.lit('"}, "legible": {"person.name.surname_latin": '), legible, F.lit("}}"))
    return grounding.parse_reply(i.persons(spark, d).select("doc_id", body.alias("reply")))


def ground_sql() -> dict[str, str]:
    dig = r"regexp_replace({}, '[^0-9]', '', 'g')"
    iso = "regexp_full_match(value, '[0-9]{4}-[0-9]{2}-[0-9]{2}')"
    def key(y, m, d):
        return f"CAST({y} AS INT) || '-' || CAST({m} AS INT) || '-' || CAST({d} AS INT)"
    ymd = r"regexp_extract_all(text, '\d{4}[-./]\d{1,2}[-./]\d{1,2}')"
    dmy = r"regexp_extract_all(text, '\d{1,2}[-./]\d{1,2}[-./]\d{4}')"
    part = "regexp_extract(x, '^(\\d+)[-./](\\d+)[-./](\\d+)$', {})"
    run = r"regexp_extract_all(text, '\b\d{8}\b')"
    return {
        "ev": f"SELECT doc_id, {comparable('text')} AS hn, {dig.format('text')} AS hd, list_concat(list_concat("
              f"list_transform({ymd}, lambda x: {key(part.format(1), part.format(2), part.format(3))}), "
              f"list_transform({dmy}, lambda x: {key(part.format(3), part.format(2), part.format(1))})), "
              f"list_transform({run}, lambda x: {key('substr(x,1,4)', 'substr(x,5,2)', 'substr(x,7,2)')})) AS hs FROM doc_text",
        "vv": f"SELECT *, {comparable('value')} AS vn, {dig.format('value')} AS vd FROM parsed",
        "chk": f"""SELECT doc_id, path, value, CASE WHEN coalesce({strip('value')}, '') = '' THEN 'blank' WHEN {iso} THEN 'date'
              WHEN path IN ({', '.join(q(p) for p in EXACT_MATCH_PATHS)}) OR vd = value THEN 'id' ELSE 'text' END AS kind,
              hn, hd, hs, vn, vd FROM vv LEFT JOIN ev USING (doc_id)""",
        "okv": f"""SELECT doc_id, path, value, kind, CASE kind WHEN 'blank' THEN TRUE
              WHEN 'date' THEN list_contains(hs, {key('substr(value,1,4)', 'substr(value,6,2)', 'substr(value,9,2)')})
                OR contains(hd, substr(value, 9, 2) || substr(value, 6, 2) || substr(value, 3, 2))
                OR contains(hd, substr(value, 3, 2) || substr(value, 6, 2) || substr(value, 9, 2))
              WHEN 'id' THEN CASE WHEN vd <> '' THEN vd ELSE vn END <> '' AND contains(CASE WHEN vd = value THEN hd ELSE hn END, CASE WHEN vd <> '' THEN vd ELSE vn END)
              ELSE vn = '' OR contains(hn, vn) END AS accepted FROM chk""",
        # Windows of the longer text as long as the shorter one, cut off at the ends; the edit distance only bounds the score from above.
        "pairs": """SELECT doc_id, path, CASE WHEN length(vn) <= length(hn) THEN vn ELSE hn END AS needle, CASE WHEN length(vn) <= length(hn) THEN hn ELSE vn END AS hay
              FROM chk WHERE kind = 'text' AND vn <> '' AND hn <> '' AND NOT contains(hn, vn)""",
        "windows": """SELECT doc_id, path, needle, substr(hay, greatest(0, e - length(needle)) + 1, least(e, length(hay)) - greatest(0, e - length(needle))) AS w
              FROM (SELECT *, unnest(range(1, length(hay) + length(needle))) AS e FROM pairs)""",
        "fuzzy": """SELECT DISTINCT doc_id, path FROM (
              SELECT *, list_reduce(string_split(needle, ''), lambda r, c: list_transform(range(1, length(w) + 2), lambda k: CASE WHEN k = 1 THEN 0 ELSE list_max(
                list_transform(range(2, k + 1), lambda t: greatest(r[t], r[t - 1] + CASE WHEN substr(w, t - 1, 1) = c THEN 1 ELSE 0 END))) END),
                list_transform(range(0, length(w) + 1), lambda k: 0)) AS r
              FROM windows WHERE levenshtein(needle, w) <= 0.1 * (length(needle) + length(w))) WHERE 200.0 * r[-1] / (length(needle) + length(w)) >= 90""",
        "okf": "SELECT okv.* EXCLUDE (accepted), accepted OR f.doc_id IS NOT NULL AS accepted FROM okv LEFT JOIN fuzzy f ON f.doc_id = okv.doc_id AND f.path = okv.path",
    }


GROUND_CTES = dict(REPLY_CTES, **ground_sql())


@register("ground_exact", sql("""
SELECT doc_id, path, accepted, CASE WHEN accepted THEN '' WHEN kind = 'date' THEN 'date not present in the recognised text'
  WHEN kind = 'id' THEN 'identifier not found verbatim in the recognised text' ELSE 'value not supported by the recognised text' END AS reason
FROM okv""", "replies", "doc_text", **GROUND_CTES))
def _(spark, d):
    checked = grounding.ground(grounding.parse_reply(i.replies(spark, d)), merge.ocr_text(i.ocr_lines(spark, d)), None)
    return checked.select("doc_id", "path", "accepted", F.coalesce("reason", F.lit("")).alias("reason"))


@register("ground", sql(f"""
SELECT doc_id, path, accepted, CASE WHEN accepted THEN coalesce(value, '') ELSE '' END AS value, CASE WHEN accepted THEN '' ELSE chr(39) || path || {q(msg.REJECTED[0])} ||
  CASE kind WHEN 'date' THEN 'date not present in the recognised text' WHEN 'id' THEN 'identifier not found verbatim in the recognised text'
    ELSE 'value not supported by the recognised text' END || {q(msg.REJECTED[1])} END AS warning FROM okf""", "replies", "doc_text", **GROUND_CTES))
def _(spark, d):
    checked = grounding.keep_grounded(grounding.ground(grounding.parse_reply(i.replies(spark, d)), merge.ocr_text(i.ocr_lines(spark, d))))
    return checked.select("doc_id", "path", "accepted", F.coalesce("value", F.lit("")).alias("value"), F.coalesce("warning", F.lit("")).alias("warning"))


@register("rejection_rate", sql(
    "SELECT path, count(*) AS asserted, avg(CASE WHEN accepted THEN 0.0 ELSE 1.0 END) AS rejection_rate FROM okv WHERE value IS NOT NULL GROUP BY path",
    "replies", "doc_text", **GROUND_CTES))
def _(spark, d):
    checked = grounding.ground(grounding.parse_reply(i.replies(spark, d)), merge.ocr_text(i.ocr_lines(spark, d)), None)
    return grounding.rejection_rate(checked, "path")


@register("contamination", sql(f"""
SELECT doc_id, item_id FROM (SELECT doc_id, {comparable('text')} AS h FROM documents) JOIN
 (SELECT item_id, {comparable('text')} AS n FROM benchmark) ON n <> '' AND contains(h, n)"""))
def _(spark, d):
    return grounding.contamination(i.table(spark, d, "documents"), i.table(spark, d, "benchmark"))


# --- cross checks -----------------------------------------------------------------

@register("cross_check", sql(f"""
SELECT doc_id, 'pinfl' AS key, {q(msg.ZONES_DIFFER)} || 'pinfl): ''' || pinfl || ''' / ''' || substr(pinfl, 1, 13) || CAST((doc_id + 1) % 10 AS VARCHAR) || '''' AS warning
FROM persons WHERE doc_id % 4 = 0 UNION ALL
SELECT doc_id, 'surname', {q(msg.ZONES_DIFFER)} || 'surname): ''' || surname || ''' / ''' || other || '''' FROM (
 SELECT *, CASE WHEN doc_id % 3 = 0 THEN surname || '''s' WHEN doc_id % 3 = 1 THEN reverse(surname) ELSE lower(surname) END AS other FROM persons)
WHERE doc_id % 3 = 1 AND surname <> other""", "persons"))
def _(spark, d):
    p, k = i.persons(spark, d), F.col("doc_id")
    other = F.when(k % 3 == 0, F.concat("surname", F.lit("'s"))).when(k % 3 == 1, F.reverse("surname")).otherwise(F.lower("surname"))
    bad = F.when(k % 4 == 0, F.concat(F.substring("pinfl", 1, 13), ((k + 1) % 10).cast("string"))).otherwise(F.col("pinfl"))

    def pair(a, b):
        return p.select("doc_id", F.inline(F.array(
            F.struct(F.lit("surname").alias("key"), a.alias("value")),
            F.struct(F.lit("pinfl").alias("key"), b.alias("value")))))
    out = merge.cross_check(pair(F.col("surname"), F.col("pinfl")), pair(other, bad))
    return out.select("doc_id", "key", "warning")


def _zone_field_rows(spark, d):
    lines = mrz.mrz_candidates(i.ocr_lines(spark, d))
    return mrz.explode_fields(mrz.parse_mrz(lines, i.today()), "doc_id")


_face = {"face": "SELECT doc_id, array_to_string(list_slice(ls, 1, len(ls) - 3), chr(10)) AS text FROM doc_lines"}


@register("mrz_in_visual", sql(f"""
SELECT doc_id, k AS key, value, {q(msg.NOT_ON_FACE[0])} || k || {q(msg.NOT_ON_FACE[1])} AS warning FROM (
 SELECT doc_id, CASE path WHEN 'documents.0.doc_number' THEN 'doc_number' ELSE 'surname' END AS k, value FROM zf
 WHERE path IN ('documents.0.doc_number', 'person.name.surname_latin')) JOIN face USING (doc_id)
WHERE NOT contains(upper(text), upper(value))""", "mrz_ocr", "doc_lines", **TD1_FIELDS, **_face))
def _(spark, d):
    lines = i.ocr_lines(spark, d)
    return merge.mrz_in_visual(_zone_field_rows(spark, d), merge.ocr_text(lines.filter(~mrz.is_zone_line(F.col("text")))))


# --- merging ----------------------------------------------------------------------

def candidates(spark, d):
    """Competing values: four stages per field with arithmetic confidences."""
    g = i.golden(spark, d)
    stage = F.explode(F.array(*[F.lit(x) for x in range(4)]))
    k = F.col("doc_id")
    return g.withColumn("stage_rank", stage).select(
        "doc_id", "path", F.concat("value", F.lit("/"), F.col("stage_rank").cast("string")).alias("value"),
        (((k * 7 + F.col("stage_rank") * 13) % 10) / 10).alias("confidence"),
        ((k + F.col("stage_rank") * 3) % 7 == 0).alias("validated"), "stage_rank")


CANDS = """SELECT doc_id, path, value || '/' || s AS value, ((doc_id * 7 + s * 13) % 10) / 10 AS confidence,
  (doc_id + s * 3) % 7 = 0 AS validated, s AS stage_rank FROM golden, (SELECT unnest(range(4)) AS s)"""
MERGED = """SELECT doc_id, path, value, confidence, validated, stage_rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, path
  ORDER BY validated DESC, CASE WHEN validated THEN 0 ELSE -confidence END, stage_rank) AS rn FROM cands) WHERE rn = 1"""


@register("merge_fields", sql("SELECT * FROM merged", "golden", cands=CANDS, merged=MERGED))
def _(spark, d):
    return merge.merge_fields(candidates(spark, d))


_core = sql_list(PERSON_PATHS + DOCUMENT_PATHS)
SUMMARY = f"""SELECT doc_id, overall_confidence, array_to_string(list_filter({_core}, lambda p: NOT coalesce(list_contains(done, p), FALSE)), '|') AS needs_review
 FROM (SELECT doc_id, avg(confidence) AS overall_confidence, list(path) FILTER (confidence >= 0.75) AS done FROM merged GROUP BY doc_id)"""


@register("overall_confidence", sql("SELECT doc_id, overall_confidence FROM summary", "golden", cands=CANDS, merged=MERGED, summary=SUMMARY))
def _(spark, d):
    return merge.review_summary(merge.merge_fields(candidates(spark, d))).select("doc_id", "overall_confidence")


@register("needs_review", sql("SELECT doc_id, needs_review, 'review_needed' AS status FROM summary", "golden", cands=CANDS, merged=MERGED, summary=SUMMARY))
def _(spark, d):
    return merge.review_summary(merge.merge_fields(candidates(spark, d))).select(
        "doc_id", F.array_join("needs_review", "|").alias("needs_review"), "status")


@register("unresolved_request", sql("""SELECT doc_id, r AS request, array_to_string(list_slice(fs, 5 * r + 1, 5 * r + 5), '|') AS fields FROM (
  SELECT doc_id, fs, unnest(range((len(fs) + 4) // 5)) AS r FROM (SELECT doc_id, list_filter(string_split(needs_review, '|'), lambda x: x <> '') AS fs FROM summary))""",
                                    "golden", cands=CANDS, merged=MERGED, summary=SUMMARY))
def _(spark, d):
    open_ = merge.review_summary(merge.merge_fields(candidates(spark, d)))
    asked = open_.select("doc_id", F.posexplode(merge.unresolved_requests(F.col("needs_review"), 5)).alias("request", "fields"))
    return asked.select("doc_id", F.col("request").cast("bigint").alias("request"), F.array_join("fields", "|").alias("fields"))


@register("review_queue", sql("""
SELECT doc_id, path, band, CASE band WHEN 'doubtful' THEN 0 WHEN 'uncertain' THEN 1 ELSE 2 END AS band_rank FROM (SELECT doc_id, path,
  CASE WHEN validated OR confidence >= 0.9 THEN 'confident' WHEN confidence >= 0.7 THEN 'uncertain' ELSE 'doubtful' END AS band FROM merged)
ORDER BY band_rank, doc_id, path""", "golden", cands=CANDS, merged=MERGED))
def _(spark, d):
    return merge.review_queue(merge.merge_fields(candidates(spark, d))).select("doc_id", "path", "band", "band_rank")


@register("merge_pages", sql("""SELECT doc_id, path, value, confidence, validated FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, path
  ORDER BY validated DESC, CASE WHEN validated THEN 0 ELSE -confidence END, stage_rank) AS rn FROM cands WHERE (doc_id + stage_rank) % 3 <> 0) WHERE rn = 1""",
    "golden", cands=CANDS))
def _(spark, d):
    pages = candidates(spark, d).withColumnRenamed("stage_rank", "page").withColumn(
        "value", F.when((F.col("doc_id") + F.col("page")) % 3 == 0, " ").otherwise(F.col("value")))
    return merge.merge_pages(pages).select("doc_id", "path", "value", "confidence", "validated")


def _page_rows(spark, d):
    k = F.col("doc_id")
    p = i.persons(spark, d).select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("page"))
    return p.select("doc_id", "page",
                    F.when((k + F.col("page")) % 2 == 0, F.array(F.lit("L1_rules"), F.lit("L0_mrz")))
                    .otherwise(F.array(F.lit("L2_llm_text"))).alias("stages_used"),
                    F.when(k % 3 == 0, F.array(F.lit("b"), F.lit("a"))).otherwise(
                        F.array(F.lit("a"), F.concat(F.lit("p"), F.col("page").cast("string")))).alias("warnings"))


@register("merge_page_summaries", sql("""
SELECT doc_id, 'L0_mrz|L1_rules|L2_llm_text' AS stages, CASE WHEN doc_id % 3 = 0 THEN 'b|a' ELSE 'a|p0|p1' END AS warnings FROM persons""", "persons"))
def _(spark, d):
    out = merge.merge_page_summaries(_page_rows(spark, d))
    return out.select("doc_id", F.array_join("stages_used", "|").alias("stages"), F.array_join("warnings", "|").alias("warnings"))


@register("append_warnings", sql("""
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'a|b|c' ELSE 'a|b|d' END AS warnings FROM persons""", "persons"))
def _(spark, d):
    more = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("b"), F.lit("c"))).otherwise(F.array(F.lit("d"), F.lit("a")))
    return i.persons(spark, d).select("doc_id", F.array_join(merge.append_warnings(
        F.array(F.lit("a"), F.lit("b")), more), "|").alias("warnings"))


@register("keys_in_both_zones", sql("""
SELECT doc_id, path FROM golden WHERE doc_id % 3 <> 0 INTERSECT SELECT doc_id, path FROM actual""", "golden", "actual"))
def _(spark, d):
    return merge.keys_in_both(i.golden(spark, d).filter("doc_id % 3 <> 0"), i.actual(spark, d))


# --- nested form --------------------------------------------------------------------

def _nested(spark, d):
    g = i.actual(spark, d).withColumn("confidence", F.lit(0.5)).withColumn("source", F.lit("mrz"))
    return merge.unflatten(g)


@register("unflatten", sql("""
SELECT doc_id, coalesce(max(CASE WHEN path = 'person.name.surname_latin' THEN value END), '') AS surname,
  coalesce(max(CASE WHEN path = 'documents.0.doc_number' THEN value END), '') AS doc_no,
  coalesce(max(CASE WHEN path = 'person.pinfl' THEN value END), '') AS pinfl, 'ocr_visual' AS phone_source FROM actual GROUP BY doc_id""", "actual"))
def _(spark, d):
    return _nested(spark, d).select(
        "doc_id", F.col("person.name.surname_latin.value").alias("surname"), F.coalesce(F.get("documents", F.lit(0))["doc_number"]["value"], F.lit("")).alias("doc_no"),
        F.coalesce("person.pinfl.value", F.lit("")).alias("pinfl"), F.col("person.phone.source").alias("phone_source"))


@register("flatten_result", sql("""
SELECT p.doc_id, path, coalesce(value, '') AS value FROM (SELECT doc_id, unnest(""" + sql_list(
    PERSON_PATHS + DOCUMENT_PATHS + ["education.institution", "education.degree", "education.speciality", "education.speciality_code",
                                     "education.graduation_year", "education.diploma_number", "education.gpa"]) +
    """) AS path FROM persons) p LEFT JOIN actual a USING (doc_id, path)""", "persons", "actual"))
def _(spark, d):
    return merge.flatten_result(_nested(spark, d)).select("doc_id", "path", F.coalesce("value", F.lit("")).alias("value"))


def _listed(spark, d):
    """Two documents and up to three subjects for each person, with a second and worse reading of some."""
    k = F.col("doc_id")

    def row(path, value, confidence=0.9):
        return F.struct(F.lit(path).alias("path"), value.cast("string").alias("value"), F.lit(confidence).alias("confidence"))
    rows = [row("documents.1.doc_number", F.reverse("doc_no")), row("documents.0.doc_number", F.col("doc_no")),
            row("documents.0.doc_number", F.lit("misread"), 0.4), row("education.subjects.10.name", F.concat(F.lit("s10-"), "surname")),
            row("education.subjects.2.name", F.concat(F.lit("s2-"), "surname")), row("education.subjects.2.grade", k % 6),
            row("education.subjects.2.grade", k % 6 + 1, 0.3), row("person.name.surname_latin", F.col("surname")), row("person.unknown", F.lit("x"))]
    third = F.when(k % 2 == 0, F.array(row("education.subjects.0.name", F.concat(F.lit("s0-"), "surname")))).otherwise(
        F.slice(F.array(rows[0]), 1, 0))
    return i.persons(spark, d).select("doc_id", F.inline(F.concat(F.array(*rows), third))).withColumns({"source": F.lit("mrz"), "validated": F.lit(False)})


@register("unflatten_lists", sql("""
SELECT doc_id, doc_no || '|' || reverse(doc_no) AS numbers, CASE WHEN doc_id % 2 = 0 THEN 's0-' || surname || '|' ELSE '' END || 's2-' || surname || '|s10-' || surname AS subjects,
  CASE WHEN doc_id % 2 = 0 THEN '-|' ELSE '' END || (doc_id % 6) || '|-' AS grades, surname FROM persons""", "persons"))
def _(spark, d):
    def values(items, leaf):
        return F.array_join(F.transform(items, lambda x: F.coalesce(x[leaf]["value"], F.lit("-"))), "|")
    return merge.unflatten(_listed(spark, d)).select(
        "doc_id", values(F.col("documents"), "doc_number").alias("numbers"), values(F.col("education.subjects"), "name").alias("subjects"),
        values(F.col("education.subjects"), "grade").alias("grades"), F.col("person.name.surname_latin.value").alias("surname"))


@register("flatten_lists", sql("""
SELECT * FROM (SELECT doc_id, unnest(['documents.0.doc_number', 'documents.1.doc_number', 'person.name.surname_latin', 'education.subjects.' || b || '.name',
  'education.subjects.' || (b + 1) || '.name', 'education.subjects.' || b || '.grade', CASE WHEN b = 1 THEN 'education.subjects.0.name' END]) AS path,
  unnest([doc_no, reverse(doc_no), surname, 's2-' || surname, 's10-' || surname, CAST(doc_id % 6 AS VARCHAR), CASE WHEN b = 1 THEN 's0-' || surname END]) AS value
FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS b FROM persons)) WHERE path IS NOT NULL""", "persons"))
def _(spark, d):
    return merge.flatten_result(merge.unflatten(_listed(spark, d))).where("value IS NOT NULL").select("doc_id", "path", "value")


@register("get_field", sql("SELECT doc_id, value FROM actual WHERE path = 'documents.0.doc_number'", "actual"))
def _(spark, d):
    return merge.get_field(_nested(spark, d), "documents.0.doc_number")


# --- whole cascade ----------------------------------------------------------------

CASCADE_CTES = dict(
    TD1_FIELDS, **RULE_CTES, **GROUND_CTES, **_face,
    allc="SELECT doc_id, path, value, confidence, validated, 0 AS st FROM zf WHERE path IN (" + ", ".join(q(p) for p in PERSON_PATHS + DOCUMENT_PATHS) + ") "
         "UNION ALL SELECT doc_id, path, value, 0.80, FALSE, 1 FROM rulev WHERE path IN (" + ", ".join(q(p) for p in PERSON_PATHS + DOCUMENT_PATHS) + ")",
    m1="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, path ORDER BY validated DESC, CASE WHEN validated THEN 0 ELSE -confidence END, st) AS rn FROM allc) WHERE rn = 1",
    asked="SELECT d.doc_id, p.path FROM (SELECT DISTINCT doc_id FROM ocr_lines) d, (SELECT unnest(" + _core + ") AS path) p "
          "ANTI JOIN (SELECT doc_id, path FROM m1 WHERE coalesce(value, '') <> '' AND confidence >= 0.75) r ON r.doc_id = d.doc_id AND r.path = p.path",
    allm="SELECT doc_id, path, value, confidence, validated, st FROM m1 UNION ALL SELECT doc_id, path, value, 0.70, FALSE, 2 FROM okf JOIN asked USING (doc_id, path) "
         "WHERE accepted AND coalesce(value, '') <> ''",
    m2="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, path ORDER BY validated DESC, CASE WHEN validated THEN 0 ELSE -confidence END, st) AS rn FROM allm) WHERE rn = 1",
    asked3="SELECT * FROM (SELECT a.doc_id, a.path, count(*) OVER (PARTITION BY a.doc_id) AS n FROM asked a ANTI JOIN "
           "(SELECT doc_id, path FROM m2 WHERE coalesce(value, '') <> '' AND confidence >= 0.75) r ON r.doc_id = a.doc_id AND r.path = a.path) WHERE n >= 3",
    seen="SELECT doc_id, 'person.phone' AS path, phone AS value FROM image_replies UNION ALL SELECT doc_id, 'person.address', address FROM image_replies WHERE address IS NOT NULL",
    allv="SELECT doc_id, path, value, confidence, validated, st FROM m2 UNION ALL SELECT doc_id, path, value, 0.65, FALSE, 3 FROM seen JOIN asked3 USING (doc_id, path)",
    m3="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, path ORDER BY validated DESC, CASE WHEN validated THEN 0 ELSE -confidence END, st) AS rn FROM allv "
       "WHERE doc_id % 9 NOT IN (1, 4)) WHERE rn = 1",
)
#: The cascade where answers are paid for: documents marked synthetic that look real are refused, and half of the pictures get no answer.
PAID_CTES = dict(
    {"sent": f"SELECT doc_id FROM doc_text WHERE doc_id % 5 IN (0, 1) OR len({signals_sql('text')}) = 0"},
    **CASCADE_CTES | {"allm": CASCADE_CTES["allm"].replace("FROM okf JOIN", "FROM okf SEMI JOIN sent USING (doc_id) JOIN")})


def summary_sql(told: str = "replies", policy: bool = False) -> str:
    """One row for each document; ``told`` names the documents that got an answer to their text."""
    refused = "CASE WHEN NOT EXISTS (SELECT 1 FROM sent t WHERE t.doc_id = s.doc_id) AND a.doc_id IS NOT NULL THEN 'L2_refused_policy' END" if policy else "NULL"
    return f"""
SELECT doc_id, s.overall_confidence, array_to_string(list_filter({_core}, lambda p: NOT coalesce(list_contains(s.done, p), FALSE)), '|') AS needs_review,
  CASE WHEN len(s.done) = 19 THEN 'ok' ELSE 'review_needed' END AS status, array_to_string(list_filter(['L0_mrz', CASE WHEN l1.doc_id IS NOT NULL THEN 'L1_rules' END,
   CASE WHEN l2.doc_id IS NOT NULL THEN 'L2_llm_text' END, CASE WHEN l3.doc_id IS NOT NULL THEN 'L3_vlm' END, {refused}], lambda x: x IS NOT NULL), '|') AS stages
FROM (SELECT doc_id, avg(confidence) FILTER (coalesce(value, '') <> '') AS overall_confidence, list(path) FILTER (coalesce(value, '') <> '' AND confidence >= 0.75) AS done FROM m3 GROUP BY doc_id) s
LEFT JOIN (SELECT DISTINCT doc_id FROM m1 WHERE st = 1) l1 USING (doc_id) LEFT JOIN (SELECT DISTINCT doc_id FROM asked SEMI JOIN {told} USING (doc_id)) l2 USING (doc_id)
LEFT JOIN (SELECT DISTINCT doc_id FROM asked3 SEMI JOIN image_replies USING (doc_id)) l3 USING (doc_id) LEFT JOIN (SELECT DISTINCT doc_id FROM asked) a USING (doc_id)
UNION ALL SELECT doc_id, 0.0, '', CASE doc_id % 9 WHEN 1 THEN 'bad_quality' ELSE 'unknown_doc_type' END, '' FROM persons WHERE doc_id % 9 IN (1, 4)"""


def _cascade(spark, d):
    return cascade.cascade(i.ocr_lines(spark, d), i.replies(spark, d), i.today(), image_replies=i.image_replies(spark, d),
                           turned_away=i.turned_away(spark, d))


def echo(call):
    """A stand-in for a model: it answers what the request hints at, and fails without a hint."""
    if call["hint"] is None:
        raise ValueError("no answer")
    return {"reply": call["hint"], "tokens_in": len(call["user_text"]), "tokens_out": len(call["hint"]), "cost_micros": len(call["hint"])}


def _paid(spark, d):
    """The whole cascade with paid answers; the ledger starts empty."""
    ledger = answering.CallLedger(spark, scratch_path(spark, "docweir-ledger"))
    dims = routing_queries.providers(spark)
    text_tiers, image_tiers = dims.where("provider <> 'provider-0'"), dims.where("provider = 'provider-0'")

    def asker(hints, tiers, **more):
        def ask(requests, texts):
            hinted = requests.join(hints.withColumnRenamed("reply", "hint"), "doc_id", "left").withColumn(
                "contains_real_pii", F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") % 5 == 1))
            return answering.answer(hinted, texts, routing_queries.prompts(spark, d), tiers, echo, ledger, i.now(), **more)
        return ask
    return cascade.cascade(i.ocr_lines(spark, d), None, i.today(), turned_away=i.turned_away(spark, d),
                           answer_text=asker(i.replies(spark, d), text_tiers),
                           answer_image=asker(i.image_replies(spark, d), image_tiers, task="vision"))


_cascade_inputs = ("mrz_ocr", "ocr_lines", "doc_lines", "doc_text", "replies", "image_replies")


@register("cascade_fields", sql("SELECT doc_id, path, value, confidence, validated FROM m3", *_cascade_inputs, **CASCADE_CTES))
def _(spark, d):
    return _cascade(spark, d).fields.select("doc_id", "path", "value", "confidence", "validated")


@register("cascade_summary", sql(summary_sql(), *_cascade_inputs, **CASCADE_CTES))
def _(spark, d):
    return _cascade(spark, d).documents.select(
        "doc_id", "overall_confidence", F.array_join("needs_review", "|").alias("needs_review"), "status",
        F.array_join("stages_used", "|").alias("stages"))


@register("cascade_answered", sql(f"""
SELECT u.*, CAST(coalesce(x.c, 0) AS BIGINT) AS cost_micros FROM ({summary_sql("sent", True)}) u LEFT JOIN (SELECT doc_id, sum(c) AS c FROM (
  SELECT doc_id, length(reply) AS c FROM replies SEMI JOIN sent USING (doc_id) SEMI JOIN asked USING (doc_id)
  UNION ALL SELECT doc_id, length(reply) FROM image_replies SEMI JOIN asked3 USING (doc_id)) WHERE doc_id % 9 NOT IN (1, 4) GROUP BY doc_id) x USING (doc_id)""",
    *_cascade_inputs, **PAID_CTES))
def _(spark, d):
    return _paid(spark, d).documents.select(
        "doc_id", "overall_confidence", F.array_join("needs_review", "|").alias("needs_review"), "status",
        F.array_join("stages_used", "|").alias("stages"), "cost_micros")


@register("cascade_not_sent", sql("""
SELECT doc_id, 'marked synthetic but looks real' AS reason FROM (SELECT DISTINCT doc_id FROM asked) ANTI JOIN sent USING (doc_id) WHERE doc_id % 9 NOT IN (1, 4)
UNION ALL SELECT doc_id, 'call failed' FROM (SELECT DISTINCT doc_id FROM asked3) ANTI JOIN image_replies USING (doc_id) WHERE doc_id % 9 NOT IN (1, 4)""",
    *_cascade_inputs, **PAID_CTES))
def _(spark, d):
    return _paid(spark, d).not_sent.select("doc_id", F.split("reason", ":")[0].alias("reason"))


@register("cascade_usage", sql("""
SELECT provider, count(*) AS calls, count(*) FILTER (ok) AS answered, CAST(sum(CASE WHEN ok THEN n ELSE 0 END) AS BIGINT) AS cost_micros FROM (
  SELECT CASE WHEN doc_id % 5 IN (0, 1) THEN 'provider-2' ELSE 'provider-1' END AS provider, TRUE AS ok, length(reply) AS n FROM replies SEMI JOIN sent USING (doc_id)
    SEMI JOIN asked USING (doc_id) WHERE doc_id % 9 NOT IN (1, 4)
  UNION ALL SELECT 'provider-0', r.doc_id IS NOT NULL, length(r.reply) FROM (SELECT DISTINCT doc_id FROM asked3) a LEFT JOIN image_replies r ON r.doc_id = a.doc_id
    WHERE a.doc_id % 9 NOT IN (1, 4)) GROUP BY provider""", *_cascade_inputs, **PAID_CTES))
def _(spark, d):
    return _paid(spark, d).usage.groupBy("provider").agg(
        F.count("*").alias("calls"), F.count_if(F.col("outcome") == "ok").alias("answered"), F.coalesce(F.sum("cost_micros"), F.lit(0)).alias("cost_micros"))


@register("cascade_warnings", sql(f"""
SELECT * FROM (SELECT doc_id, w AS warning FROM (SELECT doc_id, unnest(warnings) AS w FROM zw) UNION ALL
SELECT doc_id, {q(msg.EXPIRED)} FROM m3 WHERE path = 'documents.0.expiry_date' AND value < '2026-01-01' UNION ALL
SELECT doc_id, {q(msg.BIRTH_IN_FUTURE)} FROM m3 WHERE path = 'person.birth_date' AND value > '2026-01-01' UNION ALL
SELECT doc_id, {q(msg.EXPIRY_BEFORE_ISSUE)} FROM m3 e JOIN m3 s USING (doc_id) WHERE e.path = 'documents.0.expiry_date' AND s.path = 'documents.0.issue_date' AND e.value <= s.value UNION ALL
SELECT doc_id, {q(msg.ISSUED_BEFORE_BIRTH)} FROM m3 e JOIN m3 s USING (doc_id) WHERE e.path = 'documents.0.issue_date' AND s.path = 'person.birth_date' AND e.value < s.value UNION ALL
SELECT doc_id, {q(msg.NOT_ON_FACE[0])} || k || {q(msg.NOT_ON_FACE[1])} FROM (SELECT doc_id, CASE path WHEN 'documents.0.doc_number' THEN 'doc_number' ELSE 'surname' END AS k, value FROM zf
 WHERE path IN ('documents.0.doc_number', 'person.name.surname_latin')) JOIN face USING (doc_id) WHERE NOT contains(upper(text), upper(value))) WHERE doc_id % 9 NOT IN (1, 4)""",
    *_cascade_inputs, **CASCADE_CTES))
def _(spark, d):
    return _cascade(spark, d).warnings.select("doc_id", "warning")
