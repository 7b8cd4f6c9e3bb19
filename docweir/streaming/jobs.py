"""Structured Streaming forms of the stateful behaviours (ST1-ST9).

Windowed and deduplicating jobs use watermarks.  The failure state machines run
in ``foreachBatch``: every micro-batch is folded by the distributed scan of the
batch operator, starting from a small carried state, so a hot key never sits in
one Python group.  Outputs and carried state are written per batch id, which
makes a retried batch overwrite itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from docweir.operators import merge, mrz, routing
from docweir.schema import STAGE_RANK
from docweir.session import materialise
from docweir.streaming import assembly
from docweir.streaming.assembly import whole_documents

# Job statuses after which nothing more follows.
TERMINAL = ["ok", "review_needed", "failed", "bad_quality", "unknown_doc_type"]


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_batches(stream: DataFrame, out: str, checkpoint: str,
                  transform: Callable[[DataFrame, int], DataFrame] | None = None,
                  mode: str = "append") -> StreamingQuery:
    """Write every micro-batch to ``out/batch_id=N``, replacing it when retried."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        rows = batch if transform is None else transform(batch, batch_id)
        rows.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint) \
        .foreachBatch(sink).trigger(availableNow=True).start()


def read_batches(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out)


def stream_extract(lines: DataFrame, out: str, checkpoint: str, today: Column, wait: str = "1 hour",
                   delay: str = "10 minutes") -> StreamingQuery:
    """Zone fields of documents, each once it is whole.

    Lines with ``ts`` and ``n_lines`` may come in any batches (``assembly.whole_documents``
    says when a document is whole, and that one without an end is taken as it is
    after ``wait``); without those columns each batch holds whole documents.
    """
    ranks = F.create_map(*[F.lit(x) for kv in STAGE_RANK.items() for x in kv])
    pieces = {"ts", "n_lines"} <= set(lines.columns)
    if pieces:
        lines = whole_documents(lines, wait, delay)

    def extract(batch: DataFrame, _batch_id: int) -> DataFrame:
        if pieces:    # written once, as the plan below reads it more than once and state must step on only once
            batch = materialise(batch, "whole-documents")
        zones = mrz.parse_mrz(mrz.mrz_candidates(batch), today).filter("found")
        rows = mrz.explode_fields(zones, "doc_id").withColumn("stage_rank", F.element_at(ranks, F.col("source")))
        return merge.merge_fields(rows).drop("stage_rank")

    return write_batches(lines, out, checkpoint, extract)


def dedupe_retries(requests: DataFrame, key: str = "cache_key", ts: str = "ts", ttl: str = "7 days") -> DataFrame:
    """Drop requests whose identical content was seen within the cache lifetime."""
    return requests.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([key])


def upload_rate(uploads: DataFrame, limit: int, by: str = "user_id", ts: str = "ts", width: str = "1 hour",
                slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """(by, start, end, n) of windows with more uploads than allowed."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    counts = uploads.withWatermark(ts, delay).groupBy(w, by).agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") > limit).select(by, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


def spend_by_day(calls: DataFrame, daily_micros: int, delay: str = "10 minutes") -> DataFrame:
    """(day, cost_micros, near_limit, over_limit) once a day is complete."""
    days = calls.withWatermark("ts", delay).groupBy(F.window("ts", "1 day")).agg(F.sum("cost_micros").alias("cost_micros"))
    return days.select(F.to_date("window.start").alias("day"), "cost_micros",
                       (F.col("cost_micros") >= 0.8 * daily_micros).alias("near_limit"),
                       (F.col("cost_micros") >= daily_micros).alias("over_limit"))


def spend_by_month(calls: DataFrame, delay: str = "2 days") -> DataFrame:
    """(month, day, cost_micros), updated as calls arrive; for update mode.

    Only days that may still change are in the state; ``months_of`` adds the days up.
    Calls more than ``delay`` behind the newest do not count any more.
    """
    days = calls.withWatermark("ts", delay).groupBy(F.window("ts", "1 day")).agg(F.sum("cost_micros").alias("cost_micros"))
    day = F.to_date("window.start")
    return days.select(F.trunc(day, "month").alias("month"), day.alias("day"), "cost_micros")


def months_of(days: DataFrame) -> DataFrame:
    """(month, cost_micros) from the newest row of each day."""
    return days.groupBy("month").agg(F.sum("cost_micros").alias("cost_micros"))


def _machine(calls: DataFrame, key: str, fold: Callable[[DataFrame, DataFrame | None], DataFrame], ignored: list[str],
             out: str, checkpoint: str, forget: str) -> StreamingQuery:
    """Fold every micro-batch from the carried counts; the folded batch is written once and the next counts derive from it.

    What is carried is one row for each key with a bearing call in the last
    ``forget`` of event time, so keys that are not used any more leave the state.
    """
    state_path = f"{out}-state"

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = f"{state_path}/batch_id={batch_id - 1}"
        carry = spark.read.parquet(before) if batch_id > 0 and _exists(spark, before) else None
        fold(batch, carry).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        folded = spark.read.parquet(f"{out}/batch_id={batch_id}")
        order, bears = F.struct("ts", "call_id"), ~F.col("outcome").isin(ignored)
        stated = F.col("retry_after").cast("double") if "retry_after" in folded.columns else F.lit(None).cast("double")
        state = folded.groupBy(key).agg(
            F.max_by(F.struct(F.col("outcome").alias("kind"), "ts", stated.alias("retry_after")), F.when(bears, order)).alias("_l"),
            F.max_by("failures", order).alias("failures"), F.max("ts").alias("_seen"))
        state = state.select(key, "_l.*", "failures", "_seen")
        if carry is not None:
            # Keys without a call in this batch, and last bearing calls of keys that only had bad requests.
            older = carry.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}_") for c in ("kind", "ts", "retry_after", "failures", "_seen")])
            both = state.withColumn("_in", F.lit(True)).join(older, F.col(key).eqNullSafe(F.col("_k")), "full")
            known = F.col("_in")
            state = both.select(
                F.when(known, F.col(key)).otherwise(F.col("_k")).alias(key),
                *[F.when(known & F.col("kind").isNotNull(), F.col(c)).otherwise(F.col(f"_{c}_")).alias(c) for c in ("kind", "ts", "retry_after")],
                F.when(known, F.col("failures")).otherwise(F.col("_failures_")).alias("failures"),
                F.greatest("_seen", "__seen_").alias("_seen"))
        newest = state.agg(F.max("_seen")).first()[0]
        if newest is not None:
            state = state.where(F.coalesce(F.col("_seen") >= F.lit(newest) - F.expr(f"INTERVAL {forget}"), F.lit(True))
                                | (F.col("kind") == "invalid_key"))
        state.write.mode("overwrite").parquet(f"{state_path}/batch_id={batch_id}")

    return calls.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()


def stream_key_health(calls: DataFrame, out: str, checkpoint: str, forget: str = "7 days") -> StreamingQuery:
    """Key state after each call, continued across micro-batches that arrive in time order.

    ``forget`` should be longer than any cool-down; invalid keys are never forgotten.
    """
    return _machine(calls, "key_id", routing.key_health, ["bad_request"], out, checkpoint, forget)


def stream_circuit_breaker(calls: DataFrame, out: str, checkpoint: str, forget: str = "7 days") -> StreamingQuery:
    """Breaker state after each call, continued across micro-batches that arrive in time order."""
    return _machine(calls, "provider", routing.circuit_breaker, [], out, checkpoint, forget)


def expire_stream(uploads: DataFrame) -> DataFrame:
    """Uploads past their expiry; the newest upload is the clock (expiry minus 24 h)."""
    seen = uploads.withWatermark("expires_at", "24 hours 1 milliseconds")
    return seen.groupBy("storage_key", "job_id", "expires_at").agg(F.count("*").alias("copies"))


def job_progress(statuses: DataFrame, wait: str = "1 day", delay: str = "10 minutes") -> DataFrame:
    """Latest status per job with its terminal flag; for update mode (``assembly.job_progress``)."""
    return assembly.job_progress(statuses, TERMINAL, wait, delay)


def _numbers(spark: SparkSession, path: str, name: str) -> list[int]:
    """Batch ids for which ``path`` has a folder ``name=<id>``."""
    if not _exists(spark, path):
        return []
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    listed = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)
    names = [f.getPath().getName() for f in listed]
    return sorted(int(n[len(name) + 1:]) for n in names if n.startswith(f"{name}="))


def latest_of_batches(spark: SparkSession, out: str, key: str, order: list[str] | None = None) -> DataFrame:
    """The newest version of every key an update-mode job wrote: largest ``order``, else latest batch.

    Reads the newest summary that ``sum_up`` has written and only the batches after it.
    """
    base = _numbers(spark, f"{out}-summary", "upto")
    batches = [n for n in _numbers(spark, out, "batch_id") if not base or n > base[-1]]
    parts = [spark.read.parquet(f"{out}/batch_id={n}").withColumn("_batch", F.lit(n)) for n in batches[:1]]
    if len(batches) > 1:
        parts = [spark.read.option("basePath", out).parquet(*[f"{out}/batch_id={n}" for n in batches]).withColumnRenamed("batch_id", "_batch")]
    if base:
        parts.append(spark.read.parquet(f"{out}-summary/upto={base[-1]}").withColumn("_batch", F.lit(base[-1])))
    df = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    rest = [c for c in df.columns if c not in (key, "_batch")]
    by = F.struct(*(order or []), "_batch")
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), by).alias("r")).select(key, "r.*")


def sum_up(spark: SparkSession, out: str, key: str, order: list[str] | None = None) -> None:
    """Write the newest version of every key up to now, so that readers need not open the batches before."""
    batches = _numbers(spark, out, "batch_id")
    if batches:
        latest_of_batches(spark, out, key, order).write.mode("overwrite").parquet(f"{out}-summary/upto={batches[-1]}")


def review_sessions(corrections: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """(job_id, start, end, corrections) bursts of manual corrections."""
    s = corrections.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "job_id").agg(F.count("*").alias("corrections"))
    return s.select("job_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "corrections")


