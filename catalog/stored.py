"""Queries that write stored data and read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs as i
from catalog import routing as routing_queries
from catalog.ctes import sql
from catalog.privacy import KEY
from catalog.registry import register
from catalog.routing import CACHE, PROMPTS
from docweir.operators import routing
from docweir.session import scratch_path
from docweir.sources import tables


def _folder(spark, name):
    return scratch_path(spark, f"docweir-stored/{name}")


@register("uploads_round_trip", sql("SELECT 4 AS files, CAST(sum(octet_length(encode(replace(html, chr(10), ' ')))) + count(*) AS BIGINT) AS bytes, count(*) AS lines FROM pages"))
def _(spark, d):
    """Pages written as four files, read as uploads."""
    path = _folder(spark, "uploads")
    i.table(spark, d, "pages").select(F.translate("html", "\n", " ").alias("html")).repartition(4).write.text(path)
    up = tables.read_uploads(spark, path, "part-*")
    lines = F.length(F.col("content").cast("string")) - F.length(F.translate(F.col("content").cast("string"), "\n", ""))
    return up.agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.sum(lines.cast("long")).alias("lines"))


@register("eval_cases_round_trip", sql("""
SELECT 'case-' || doc_id AS id, 'line ' || chr(10) || '"' || surname || '"' AS input_text, doc_id % 3 AS requested, surname, CASE WHEN doc_id % 2 = 0 THEN pinfl ELSE '' END AS pinfl FROM persons""", "persons"))
def _(spark, d):
    path, k = _folder(spark, "cases"), F.col("doc_id")
    cases = i.persons(spark, d).select(
        F.concat(F.lit("case-"), k.cast("string")).alias("id"), F.lit("made").alias("note"),
        F.concat(F.lit('line \n"'), "surname", F.lit('"')).alias("input_text"), F.array_repeat(F.lit("a"), (k % 3).cast("int")).alias("requested"),
        F.struct("surname", F.when(k % 2 == 0, F.col("pinfl")).alias("pinfl")).alias("expected"))
    tables.write_jsonl(cases, path)
    read = tables.read_eval_cases(spark, path)
    return read.select("id", "input_text", F.size("requested").cast("long").alias("requested"), F.get_json_object("expected", "$.surname").alias("surname"),
                       F.coalesce(F.get_json_object("expected", "$.pinfl"), F.lit("")).alias("pinfl"))


@register("prompts_round_trip", sql("SELECT name, max(version) AS version, arg_max(text, version) AS text FROM prompts GROUP BY name", prompts=PROMPTS))
def _(spark, d):
    """The newest prompt of each name as a file of its own."""
    path = _folder(spark, "prompts")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for r in routing.latest_prompts(routing_queries.prompts(spark, d)).collect():    # a row for each prompt name
        file = hadoop.Path(f"{path}/{r['name']}.v{r['version']}.txt")
        stream = file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(file)
        stream.write(bytearray(f"{r['text']}\n".encode()))
        stream.close()
    return tables.read_prompts(spark, path)


@register("stored_jobs", sql("SELECT CAST(job_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS user_id, status, strftime(created_at, '%Y-%m-%d') AS created, strftime(expires_at, '%Y-%m-%d') AS expires FROM jobs", "jobs"))
def _(spark, d):
    path = _folder(spark, "jobs")
    i.jobs(spark, d).select(F.col("job_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("user_id"), "status",
                            F.col("created_at").cast("timestamp").alias("created_at"), F.col("expires_at").cast("timestamp").alias("expires_at")).write.parquet(path)
    read = tables.read_table(spark, "jobs", path)
    return read.where("doc_type IS NULL").select("id", "user_id", "status", F.date_format("created_at", "yyyy-MM-dd").alias("created"),
                                                 F.date_format("expires_at", "yyyy-MM-dd").alias("expires"))


@register("stored_usage", sql("SELECT provider, model, count(*) AS calls, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, round(sum(cost_micros / 1e6), 6) AS cost_usd FROM calls GROUP BY provider, model", "calls"))
def _(spark, d):
    path = _folder(spark, "usage")
    i.calls(spark, d).select(F.col("call_id").cast("string").alias("id"), "provider", "model", "task", F.col("tokens_in").cast("int").alias("tokens_in"),
                             F.col("tokens_out").cast("int").alias("tokens_out"), (F.col("cost_micros") / 1e6).alias("cost_usd"),
                             F.col("latency_ms").cast("int").alias("latency_ms"), F.col("ts").alias("created_at")).write.parquet(path)
    return tables.read_table(spark, "llm_usage", path).groupBy("provider", "model").agg(
        F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"))


@register("stored_extractions", sql("SELECT doc_id AS job_id, pinfl AS payload, '' AS error FROM persons UNION ALL SELECT doc_id + 1000000, surname, '' FROM persons", "persons"))
def _(spark, d):
    """Two appends of sealed payloads, opened again."""
    path, p = _folder(spark, "extractions"), i.persons(spark, d)
    tables.write_extractions(p.select(F.col("doc_id").alias("job_id"), F.col("pinfl").alias("payload")), path, KEY)
    tables.write_extractions(p.select((F.col("doc_id") + 1000000).alias("job_id"), F.col("surname").alias("payload")), path, KEY)
    return tables.read_extractions(spark, path, KEY).select("job_id", "payload", F.coalesce("error", F.lit("")).alias("error"))


@register("stored_cache", sql("""
SELECT cache_key, 't' || (m % 2) AS tenant, CASE WHEN m % 4 = 0 THEN 'new ' ELSE 'old ' END || m AS value FROM entries WHERE m % 4 IN (0, 1)""", **CACHE))
def _(spark, d):
    """Entries written twice for a part of the keys, the later ones with a later expiry; some have expired."""
    path, m = _folder(spark, "cache"), F.col("m")
    keys = routing_queries.cache_requests(spark, d).groupBy("cache_key").agg(F.max("conv_id").alias("m"))

    def entries(word, expires):
        return keys.select("cache_key", F.concat(F.lit("t"), (m % 2).cast("string")).alias("tenant"), F.concat(F.lit(word), m.cast("string")).alias("value"),
                           expires.cast("timestamp").alias("expires_at"), "m")
    old = entries("old ", F.when(m % 4 == 1, F.lit("2024-02-03")).otherwise(F.lit("2024-01-20")))
    tables.write_cache(old.unionByName(old).drop("m"), path)
    tables.write_cache(entries("new ", F.lit("2024-02-05")).where("m % 4 = 0").drop("m"), path)
    compacted = _folder(spark, "cache-compact")
    tables.compact_cache(spark, path, compacted, i.now())
    return tables.read_cache(spark, compacted, i.now()).select("cache_key", "tenant", "value")


@register("stored_documents", sql("SELECT job_id, template_id, storage_key, strftime(created_at + INTERVAL 90 DAY, '%Y-%m-%d') AS expires FROM gen_docs", "gen_docs"))
def _(spark, d):
    path = _folder(spark, "documents")
    tables.write_documents(i.gen_docs(spark, d).drop("expires_at").withColumn("created_at", F.col("created_at").cast("timestamp")), path)
    return spark.read.parquet(path).select("job_id", F.col("template_id").cast("long").alias("template_id"), "storage_key",
                                           F.date_format("expires_at", "yyyy-MM-dd").alias("expires"))
