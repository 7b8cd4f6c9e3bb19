"""Streaming queries run to completion over the given tables, with batch SQL twins."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from catalog import inputs as i
from catalog.ctes import sql
from catalog.registry import register
from catalog.routing import BREAKER, HEALTH
from catalog.zones import TD1_FIELDS
from docweir.session import scratch_path
from docweir.streaming import jobs


def stream(spark, d, name):
    """A given table as a file stream."""
    schema = i.table(spark, d, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


def call_stream(spark, d):
    return i.calls_of(stream(spark, d, "events"))


def run(spark, df, name, mode="append"):
    """Run a streaming DataFrame over what is there and read its output back."""
    out = scratch_path(spark, f"docweir-streams/{name}")
    jobs.write_batches(df, f"{out}/rows", f"{out}/checkpoint", mode=mode).awaitTermination()
    return jobs.read_batches(spark, f"{out}/rows").drop("batch_id")


@register("stream_extract", sql(
    "SELECT doc_id, path, coalesce(value, '') AS value, confidence FROM zf", "mrz_ocr", **TD1_FIELDS))
def _(spark, d):
    """The lines of every document come in three pieces, each in batches of its own; the last line tells their number."""
    src, out = scratch_path(spark, "docweir-streams/lines"), scratch_path(spark, "docweir-streams/extract")
    counted = i.ocr_lines(spark, d).select("doc_id", "line_no", "text", F.count("*").over(Window.partitionBy("doc_id")).alias("_n"))
    piece = F.least(F.lit(2), F.floor(F.col("line_no") * 3 / (F.col("_n") + 1)))
    pieces = counted.select("doc_id", "line_no", "text", F.when(F.col("line_no") == F.col("_n"), F.col("_n")).alias("n_lines"),
                            F.timestamp_seconds(F.lit(1704067200) + 60 * F.col("line_no")).alias("ts"), piece.alias("piece"))
    pieces.repartition(3, "piece").write.partitionBy("piece").parquet(src)
    lines = spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", 1).parquet(src)
    jobs.stream_extract(lines, f"{out}/rows", f"{out}/checkpoint", i.today()).awaitTermination()
    return jobs.read_batches(spark, f"{out}/rows").select("doc_id", "path", F.coalesce("value", F.lit("")).alias("value"), "confidence")


@register("dedupe_retries", sql("SELECT DISTINCT sha256(user_id || '/' || event_type || '/' || strftime(ts, '%Y-%m-%d')) AS cache_key FROM events"))
def _(spark, d):
    e = stream(spark, d, "events").select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.sha2(F.concat_ws("/", F.col("user_id").cast("string"), "event_type", F.date_format("ts", "yyyy-MM-dd")), 256).alias("cache_key"))
    return run(spark, jobs.dedupe_retries(e), "dedupe").select("cache_key")


_mark = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


@register("upload_rate", sql(f"""
SELECT user_id, strftime(s, '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM (SELECT user_id, date_trunc('hour', ts) AS s FROM events)
GROUP BY user_id, s HAVING count(*) > 1 AND s + INTERVAL 1 HOUR <= {_mark}"""))
def _(spark, d):
    e = stream(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return run(spark, jobs.upload_rate(e, 1), "rate").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n")


@register("upload_rate_sliding", sql(f"""
SELECT user_id, strftime(s, '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM (SELECT user_id, time_bucket(INTERVAL 20 MINUTE, ts) - to_minutes(20 * unnest(range(3))) AS s FROM events)
GROUP BY user_id, s HAVING count(*) > 1 AND s + INTERVAL 1 HOUR <= {_mark}"""))
def _(spark, d):
    e = stream(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return run(spark, jobs.upload_rate(e, 1, slide="20 minutes"), "sliding").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n")


@register("spend_by_day", sql(f"""
SELECT strftime(day, '%Y-%m-%d') AS day, c AS cost_micros, c >= 2400000 AS near_limit, c >= 3000000 AS over_limit FROM (SELECT CAST(ts AS DATE) AS day, CAST(sum(cost_micros) AS BIGINT) AS c FROM calls GROUP BY 1)
WHERE day + INTERVAL 1 DAY <= {_mark}""", "calls"))
def _(spark, d):
    return run(spark, jobs.spend_by_day(call_stream(spark, d), 3_000_000), "day").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@register("spend_by_month", sql("SELECT strftime(date_trunc('month', ts), '%Y-%m') AS month, CAST(sum(cost_micros) AS BIGINT) AS cost_micros FROM calls GROUP BY 1", "calls"))
def _(spark, d):
    out = scratch_path(spark, "docweir-streams/month")
    jobs.write_batches(jobs.spend_by_month(call_stream(spark, d)), f"{out}/rows", f"{out}/checkpoint", mode="update").awaitTermination()
    days = jobs.latest_of_batches(spark, f"{out}/rows", "day")
    return jobs.months_of(days).select(F.date_format("month", "yyyy-MM").alias("month"), "cost_micros")


def _thirds(spark, d, name):
    """The call log in three spans of time (rows without a time first), three files each; one span makes one micro-batch."""
    src = scratch_path(spark, f"docweir-streams/{name}-in")
    c = i.calls(spark, d).withColumn("_s", F.unix_micros("ts"))
    cuts = c.approxQuantile("_s", [1 / 3, 2 / 3], 0.01)
    span = F.when(F.col("_s") >= cuts[1], 2).when(F.col("_s") >= cuts[0], 1).otherwise(0)
    for k in range(3):
        c.where(span == k).drop("_s").repartition(3).write.mode("append").parquet(src)
    return spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", 3).option("latestFirst", False).parquet(src)


@register("stream_key_health", sql("SELECT call_id, c AS failures FROM f", "calls", **HEALTH))
def _(spark, d):
    out = scratch_path(spark, "docweir-streams/health")
    jobs.stream_key_health(_thirds(spark, d, "health"), f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return jobs.read_batches(spark, f"{out}/rows").select("call_id", "failures")


@register("stream_circuit_breaker", sql("SELECT call_id, c AS failures, c >= 5 AS open FROM f", "calls", **BREAKER))
def _(spark, d):
    out = scratch_path(spark, "docweir-streams/breaker")
    jobs.stream_circuit_breaker(_thirds(spark, d, "breaker"), f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return jobs.read_batches(spark, f"{out}/rows").select("call_id", "failures", "open")


@register("expire_stream", sql("""
SELECT storage_key, count(*) AS copies FROM uploads WHERE expires_at < (SELECT max(created_at) FROM uploads) GROUP BY storage_key, job_id, expires_at""", "uploads"))
def _(spark, d):
    return run(spark, jobs.expire_stream(i.uploads_of(stream(spark, d, "lineitem"))), "expire").select("storage_key", "copies")


@register("job_progress", sql("""
SELECT user_id AS job_id, CASE arg_max(event_type, (ts, event_id)) WHEN 'purchase' THEN 'ok' WHEN 'error' THEN 'failed' ELSE 'extracting' END AS status,
  arg_max(event_type, (ts, event_id)) IN ('purchase', 'error') AS terminal FROM events GROUP BY user_id"""))
def _(spark, d):
    kind = F.col("event_type")
    e = stream(spark, d, "events").select(
        F.col("user_id").alias("job_id"), F.when(kind == "purchase", "ok").when(kind == "error", "failed").otherwise("extracting").alias("status"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))
    out = scratch_path(spark, "docweir-streams/progress")
    jobs.write_batches(jobs.job_progress(e), f"{out}/rows", f"{out}/checkpoint", mode="update").awaitTermination()
    return jobs.latest_of_batches(spark, f"{out}/rows", "job_id", ["ts", "seq"]).select("job_id", "status", "terminal")


@register("review_sessions", sql("""
SELECT job_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS corrections FROM (SELECT *, sum(CASE WHEN ts < prev + INTERVAL 30 MINUTE THEN 0 ELSE 1 END) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS g
 FROM (SELECT user_id AS job_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events))
GROUP BY job_id, g HAVING max(ts) + INTERVAL 30 MINUTE <= """ + _mark))
def _(spark, d):
    e = stream(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"))
    return run(spark, jobs.review_sessions(e), "sessions").select("job_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "corrections")
