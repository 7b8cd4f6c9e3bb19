"""Queries over redaction, jobs, corrections, retention and encryption."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs as i
from catalog.ctes import q, sql, sql_list
from catalog.registry import register
from docweir.operators import lifecycle, merge, privacy
from docweir.schema import CANONICAL_PATHS
from docweir.sources import tables

# --- redaction ------------------------------------------------------------------------

_RE2 = [
    (r"\b\d{14}\b", "<PINFL>"), (r"\b[A-Z]{2}\s?\d{6,8}\b", "<DOCNO>"), (r"P<[A-Z]{3}[A-Z0-9<]{20,}", "<MRZ>"),
    (r"(?m)^[A-Z0-9<]{28,44}$", "<MRZ>"),
    (r"\b[\p{L}\p{M}\p{N}_.+-]+@[\p{L}\p{M}\p{N}_-]+\.[\p{L}\p{M}\p{N}_.]+\b", "<EMAIL>"),
]


def redact_sql(e: str) -> str:
    out = e
    for pattern, label in _RE2:
        out = f"regexp_replace({out}, {q(pattern)}, {q(label)}, 'g')"
    for _ in range(2):  # neighbours are consumed, so touching numbers need a second pass
        out = f"regexp_replace({out}, '(^|[^0-9])(?:\\+998|998)?\\d{{9}}([^0-9]|$)', '\\1<PHONE>\\2', 'g')"
    out = f"regexp_replace({out}, '\\b(?:sk|AIza)[A-Za-z0-9_\\-]{{12,}}\\b', '<APIKEY>', 'g')"
    # A date counts only when its line names a birth after it.
    head = "regexp_extract(l, '(?i)^(.*)(?:tug|birth|рожд)', 1)"
    line = f"regexp_replace({head}, '\\b\\d{{4}}-\\d{{2}}-\\d{{2}}\\b', '<DATE>', 'g') || substr(l, length({head}) + 1)"
    return f"array_to_string(list_transform(string_split({out}, chr(10)), lambda l: {line}), chr(10))"


@register("redact_text", sql(f"SELECT doc_id, md5({redact_sql('text')}) AS h FROM documents"))
def _(spark, d):
    return i.table(spark, d, "documents").select("doc_id", F.md5(privacy.redact_text(F.col("text"))).alias("h"))


_note = "text || chr(10) || 'call +998901234567 or a.b+c@mail.example.uz, key sk-abcdefghijkl1234 ' || '1990-01-02 birth' || chr(10) || '2001-02-03 x'"


@register("redact_identity_text", sql(f"SELECT doc_id, {redact_sql('text')} AS text FROM (SELECT doc_id, {_note} AS text FROM doc_text)", "doc_text"))
def _(spark, d):
    t = merge.ocr_text(i.ocr_lines(spark, d))
    note = F.lit("\ncall +998901234567 or a.b+c@mail.example.uz, key sk-abcdefghijkl1234 1990-01-02 birth\n2001-02-03 x")
    return t.select("doc_id", privacy.redact_text(F.concat("text", note)).alias("text"))


@register("redact_conversations", sql(f"SELECT conv_id, turn, {redact_sql('text')} AS text FROM conversations"))
def _(spark, d):
    return i.table(spark, d, "conversations").select("conv_id", "turn", privacy.redact_text(F.col("text")).alias("text"))


@register("redaction_report", sql("""
SELECT CASE WHEN doc_id % 7 = 0 THEN 'no id' ELSE 'id' END AS source, label, CAST(sum(n) AS BIGINT) AS hits, count(*) FILTER (n > 0) AS rows_hit FROM (
 SELECT doc_id, unnest(['0<PINFL>', '1<DOCNO>', '2<MRZ>', '3<MRZ>', '4<EMAIL>', '5<PHONE>', '6<APIKEY>', '7<DATE>']) AS label,
  unnest([len(regexp_extract_all(t0, '\\b\\d{14}\\b')), len(regexp_extract_all(t1, '\\b[A-Z]{2}\\s?\\d{6,8}\\b')), 0,
   len(regexp_extract_all(t2, '(?m)^[A-Z0-9<]{28,44}$')), 0, 0, 0, 0]) AS n FROM (SELECT *, regexp_replace(t1, '\\b[A-Z]{2}\\s?\\d{6,8}\\b', '<DOCNO>', 'g') AS t2
  FROM (SELECT doc_id, text AS t0, regexp_replace(text, '\\b\\d{14}\\b', '<PINFL>', 'g') AS t1 FROM doc_text))) GROUP BY 1, 2""", "doc_text"))
def _(spark, d):
    t = merge.ocr_text(i.ocr_lines(spark, d)).withColumn("source", F.when(F.col("doc_id") % 7 == 0, "no id").otherwise("id"))
    return privacy.redaction_report(t, "text", "source")


@register("redaction_report_documents")
def _(spark, d):
    return privacy.redaction_report(i.table(spark, d, "documents"), "text", "source")


@register("redact_map", sql("SELECT doc_id, '<REDACTED>' AS surname, 'id <PINFL>' AS note, sex AS sex FROM persons", "persons"))
def _(spark, d):
    m = F.create_map(F.lit("Surname"), F.col("surname"), F.lit("note"), F.concat(F.lit("id "), "pinfl"), F.lit("sex"), F.col("sex"))
    out = i.persons(spark, d).select("doc_id", privacy.redact_map(m).alias("m"))
    return out.select("doc_id", *[F.element_at("m", F.lit(k)).alias(a) for k, a in (("Surname", "surname"), ("note", "note"), ("sex", "sex"))])


@register("redact_json", sql(
    """SELECT doc_id, '{"doc": {"Surname": "<REDACTED>", "notes": ["id <PINFL>", 7]}, "pinfl": null, "token": "<REDACTED>"}' AS body FROM persons""", "persons"))
def _(spark, d):
    body = F.concat(F.lit('{"doc": {"Surname": "'), "surname", F.lit('", "notes": ["id '), "pinfl",
                    F.lit('", 7]}, "pinfl": null, "token": '), F.col("doc_id").cast("string"), F.lit("}"))
    return i.persons(spark, d).select("doc_id", privacy.redact_json(body).alias("body"))


_SECRETS = {"key-1": "sk-verysecret", "key-2": "short", "key-3": "AIzaAnother"}


@register("redact_secrets", sql("""
SELECT event_id, 'call ' || event_type || CASE event_id % 3 WHEN 0 THEN ' <redacted:key-1>' WHEN 1 THEN ' short' ELSE ' <redacted:key-3><redacted:key-3>' END AS line FROM events"""))
def _(spark, d):
    e = i.table(spark, d, "events")
    k = F.col("event_id") % 3
    line = F.concat(F.lit("call "), "event_type", F.when(k == 0, " sk-verysecret").when(k == 1, " short").otherwise(" AIzaAnotherAIzaAnother"))
    return privacy.redact_secrets(e.select("event_id", line.alias("line")), "line", _SECRETS)


_secret = "'sk-' || md5(c_custkey || '')"


@register("redact_secrets_table", sql(f"""
SELECT o_orderkey, 'order ' || CASE o_orderkey % 4 WHEN 0 THEN 'clean ' || o_orderstatus
  WHEN 1 THEN 'by <redacted:c' || o_custkey || '>' WHEN 2 THEN 'by <redacted:long-c' || o_custkey || '>,<redacted:c' || o_custkey || '>'
  ELSE '<redacted:c' || o_custkey || '><redacted:c' || o_custkey || '> ' || substr('sk-' || md5(o_custkey || ''), 1, 30) END AS line FROM orders"""))
def _(spark, d):
    """Two secrets for each customer, one the beginning of the other, in lines about orders."""
    def secret(key):
        return F.concat(F.lit("sk-"), F.md5(key.cast("string").cast("binary")))

    c, key = i.table(spark, d, "customer"), F.col("c_custkey")
    name = F.concat(F.lit("c"), key.cast("string"))
    secrets = c.select(name.alias("key_id"), secret(key).alias("secret")).unionByName(
        c.select(F.concat(F.lit("long-"), name).alias("key_id"), F.concat(secret(key), F.lit("/x")).alias("secret")))
    k, s = F.col("o_orderkey") % 4, secret(F.col("o_custkey"))
    line = (F.when(k == 0, F.concat(F.lit("clean "), "o_orderstatus")).when(k == 1, F.concat(F.lit("by "), s))
            .when(k == 2, F.concat(F.lit("by "), s, F.lit("/x,"), s)).otherwise(F.concat(s, s, F.lit(" "), F.substring(s, 1, 30))))
    orders = i.table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("order "), line).alias("line"))
    return privacy.redact_secrets(orders, "line", secrets)


@register("find_unreserved_ids", sql("""
SELECT doc_id, pinfl AS run FROM persons WHERE doc_id % 7 <> 0 AND NOT (substr(pinfl, 1, 1) IN ('3', '5') AND ends_with(pinfl, '12345'))""", "persons"))
def _(spark, d):
    return privacy.find_unreserved_ids(i.ocr_lines(spark, d), "text", "doc_id")


# --- jobs -----------------------------------------------------------------------------

@register("jobs_with_uploads", sql("""
SELECT j.job_id, coalesce(n, 0) AS n_uploads, CAST(coalesce(b, 0) AS BIGINT) AS bytes FROM jobs j LEFT JOIN (SELECT job_id, count(*) AS n, sum(size) AS b FROM uploads GROUP BY job_id) USING (job_id)""", "jobs", "uploads"))
def _(spark, d):
    return lifecycle.jobs_with_uploads(i.jobs(spark, d), i.uploads(spark, d)).select("job_id", "n_uploads", "bytes")


@register("job_view", sql("""
SELECT job_id, status AS stage_label, CASE WHEN job_id % 4 = 0 THEN '' ELSE 'person.phone' END AS needs_review, CASE WHEN job_id % 4 = 0 THEN '' ELSE '{"n":' || job_id || '}' END AS result FROM jobs""", "jobs"))
def _(spark, d):
    jobs = i.jobs(spark, d)
    ex = jobs.filter("job_id % 4 <> 0").select("job_id", F.to_json(F.struct(F.col("job_id").alias("n"))).alias("payload"),
                                               F.array(F.lit("person.phone")).alias("needs_review"), F.array().cast("array<string>").alias("warnings"))
    stored = tables.encrypt_extractions(ex, KEY)
    opened = tables.decrypt_extractions(stored, KEY).withColumnRenamed("payload", "result")
    out = lifecycle.job_view(jobs, opened)
    return out.select("job_id", "stage_label", F.array_join("needs_review", "|").alias("needs_review"), F.coalesce("result", F.lit("")).alias("result"))


KEY = "MDEyMzQ1Njc4OWFiY2RlZjAxMjM0NTY3ODlhYmNkZWY="


@register("extraction_round_trip", sql("""
SELECT doc_id AS job_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE pinfl END AS payload, doc_id % 3 = 0 AS failed FROM persons""", "persons"))
def _(spark, d):
    p = i.persons(spark, d).select(F.col("doc_id").alias("job_id"), F.col("pinfl").alias("payload"))
    stored = tables.encrypt_extractions(p, KEY)
    k = F.col("job_id") % 9
    # Every third blob is tampered with: wrong version, cut, or moved to another job.
    bad = stored.withColumn("data_encrypted", F.when(k == 0, F.concat(F.unhex(F.lit("02")), F.expr("substring(data_encrypted, 2)")))
                            .when(k == 3, F.expr("substring(data_encrypted, 1, 20)")).otherwise(F.col("data_encrypted"))) \
        .withColumn("job_id", F.when(k == 6, F.col("job_id") + 1000000).otherwise(F.col("job_id")))
    out = tables.decrypt_extractions(bad, KEY)
    return out.select(F.when(F.col("job_id") >= 1000000, F.col("job_id") - 1000000).otherwise(F.col("job_id")).alias("job_id"),
                      F.coalesce("payload", F.lit("")).alias("payload"), F.col("error").isNotNull().alias("failed"))


LATEST = "SELECT job_id, path, arg_max(value, (ts, seq)) AS value FROM corrections GROUP BY job_id, path"


@register("latest_corrections", sql("SELECT * FROM latest", "corrections", latest=LATEST))
def _(spark, d):
    return lifecycle.latest_corrections(i.corrections(spark, d)).select("job_id", "path", "value")


_jf = f"SELECT job_id, unnest({sql_list(CANONICAL_PATHS)}) AS path FROM jobs"


def _job_fields(spark, d):
    return i.jobs(spark, d).select("job_id", F.explode(F.array(*[F.lit(p) for p in CANONICAL_PATHS])).alias("path")).select(
        "job_id", "path", F.lit("old").alias("value"), F.lit("mrz").alias("source"), F.lit(0.98).alias("confidence"), F.lit(True).alias("validated"))


@register("apply_corrections", sql("""
SELECT f.job_id, f.path, coalesce(l.value, 'old') AS value, CASE WHEN l.value IS NULL THEN 'mrz' ELSE 'manual' END AS source, CASE WHEN l.value IS NULL THEN 0.98 ELSE 1.0 END AS confidence,
  l.value IS NULL AS validated FROM jf f LEFT JOIN latest l USING (job_id, path)""", "corrections", "jobs", latest=LATEST, jf=_jf))
def _(spark, d):
    return lifecycle.apply_corrections(_job_fields(spark, d), i.corrections(spark, d))


@register("remaining_review", sql("SELECT job_id, path FROM jf EXCEPT SELECT job_id, path FROM corrections", "corrections", "jobs", jf=_jf))
def _(spark, d):
    return lifecycle.remaining_review(_job_fields(spark, d).select("job_id", "path"), i.corrections(spark, d))


@register("too_many_files", sql("SELECT job_id, count(*) AS files FROM uploads GROUP BY job_id HAVING count(*) > 4", "uploads"))
def _(spark, d):
    return lifecycle.too_many_files(i.uploads(spark, d))


@register("pages_per_file", sql("SELECT job_id, n, size, row_number() OVER (PARTITION BY job_id ORDER BY storage_key, size) <= 4 AS accepted FROM uploads", "uploads"))
def _(spark, d):
    return lifecycle.page_limit(i.uploads(spark, d)).select("job_id", "n", "size", "accepted")


# --- retention ------------------------------------------------------------------------

_SWEEP = "TIMESTAMP '1998-06-01'"


def _child(name: str) -> str:
    return (f"SELECT '{name}' AS \"table\", job_id, storage_key, 'expired' AS reason FROM {{0}} WHERE expires_at < {_SWEEP} UNION ALL "
            f"SELECT '{name}', job_id, storage_key, 'cascade' FROM {{0}} WHERE expires_at >= {_SWEEP} AND job_id IN (SELECT job_id FROM jobs WHERE expires_at < {_SWEEP})")


MANIFEST = (f"SELECT 'jobs' AS \"table\", job_id, '' AS storage_key, 'expired' AS reason FROM jobs WHERE expires_at < {_SWEEP} UNION ALL "
            + _child("uploads").format("uploads") + " UNION ALL " + _child("documents").format("gen_docs"))


def _sweep(spark, d):
    return lifecycle.retention_sweep(i.jobs(spark, d), i.uploads(spark, d), i.gen_docs(spark, d), F.lit("1998-06-01").cast("timestamp"))


@register("retention_sweep", sql("SELECT * FROM manifest", "jobs", "uploads", "gen_docs", manifest=MANIFEST))
def _(spark, d):
    return _sweep(spark, d)


@register("retention_counts", sql("SELECT \"table\", count(*) AS removed FROM manifest WHERE reason = 'expired' GROUP BY 1", "jobs", "uploads", "gen_docs", manifest=MANIFEST))
def _(spark, d):
    return lifecycle.retention_counts(_sweep(spark, d))


@register("erase_jobs", sql("""
SELECT 'uploads' AS part, count(*) AS left_rows, 0 AS orphans FROM uploads WHERE job_id % 10 <> 0 UNION ALL
SELECT 'documents', count(*), 0 FROM gen_docs WHERE job_id % 10 <> 0""", "uploads", "gen_docs"))
def _(spark, d):
    ids = i.jobs(spark, d).filter("job_id % 10 = 0")
    left, _m = lifecycle.erase(ids, {"uploads": i.uploads(spark, d), "documents": i.gen_docs(spark, d)})
    def row(n):
        return left[n].agg(F.lit(n).alias("part"), F.count("*").alias("left_rows"), F.count_if(F.col("job_id") % 10 == 0).alias("orphans"))
    return row("uploads").unionByName(row("documents"))


@register("erase_manifest", sql("""
SELECT 'uploads' AS "table", job_id, storage_key, 'erased' AS reason FROM uploads WHERE job_id % 10 = 0 UNION ALL SELECT 'documents', job_id, storage_key, 'erased' FROM gen_docs WHERE job_id % 10 = 0""", "uploads", "gen_docs"))
def _(spark, d):
    ids = i.jobs(spark, d).filter("job_id % 10 = 0")
    return lifecycle.erase(ids, {"uploads": i.uploads(spark, d), "documents": i.gen_docs(spark, d)})[1]


@register("latest_consent", sql("""
SELECT o_custkey AS user_id, 'v' || (o_orderkey % 3) AS version, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS consent_id FROM orders GROUP BY 1, 2"""))
def _(spark, d):
    c = i.table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.concat(F.lit("v"), (F.col("o_orderkey") % 3).cast("string")).alias("version"),
                                           F.col("o_orderkey").alias("consent_id"), F.col("o_orderdate").alias("granted_at"))
    return lifecycle.latest_consent(c).select("user_id", "version", "consent_id")
