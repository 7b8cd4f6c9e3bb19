"""Jobs, corrections, retention and erasure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from docweir.functions.text import stage_label
from docweir.schema import string_array


def latest_corrections(corrections: DataFrame, tie: str = "seq") -> DataFrame:
    """Last manual value per (job_id, path)."""
    return corrections.groupBy("job_id", "path").agg(
        F.max_by(F.struct("value", "ts"), F.struct("ts", tie)).alias("c")).select("job_id", "path", "c.*")


def apply_corrections(fields: DataFrame, corrections: DataFrame) -> DataFrame:
    """Upsert manual values into existing fields; unknown paths are ignored."""
    c = latest_corrections(corrections).select("job_id", "path", F.col("value").alias("_v"), F.lit(True).alias("_hit"))
    out = fields.join(c, ["job_id", "path"], "left")
    hit = F.coalesce("_hit", F.lit(False))
    return (out.withColumn("value", F.when(hit, F.col("_v")).otherwise(F.col("value")))
            .withColumn("source", F.when(hit, "manual").otherwise(F.col("source")))
            .withColumn("confidence", F.when(hit, 1.0).otherwise(F.col("confidence")))
            .withColumn("validated", F.when(hit, False).otherwise(F.col("validated")))
            .drop("_v", "_hit"))


def remaining_review(review: DataFrame, corrections: DataFrame) -> DataFrame:
    """(job_id, path) still open: needs review minus corrected."""
    return review.join(corrections.select("job_id", "path").distinct(), ["job_id", "path"], "left_anti")


def jobs_with_uploads(jobs: DataFrame, uploads: DataFrame) -> DataFrame:
    """Every job with its upload count and size; jobs without uploads keep zeros."""
    totals = uploads.groupBy("job_id").agg(F.count("*").alias("n_uploads"), F.sum("size").alias("bytes"))
    return jobs.join(totals, "job_id", "left").withColumns({
        "n_uploads": F.coalesce("n_uploads", F.lit(0)), "bytes": F.coalesce("bytes", F.lit(0))})


def job_view(jobs: DataFrame, extractions: DataFrame) -> DataFrame:
    """What a client sees of a job: label, result and its review lists."""
    return (jobs.join(extractions, "job_id", "left")
            .withColumn("stage_label", stage_label(F.col("status")))
            .withColumn("needs_review", F.coalesce("needs_review", string_array([])))
            .withColumn("warnings", F.coalesce("warnings", string_array([]))))


def too_many_files(uploads: DataFrame, limit: int = 4) -> DataFrame:
    """Jobs that hold more files than one job may."""
    return uploads.groupBy("job_id").agg(F.count("*").alias("files")).filter(F.col("files") > limit)


def page_limit(pages: DataFrame, limit: int = 4, order: tuple[str, ...] = ("storage_key", "size")) -> DataFrame:
    """Every page with its place among those of its job, and whether it is within the limit (T5).

    Surplus pages stay in the result, marked; nothing is dropped.
    """
    place = F.row_number().over(Window.partitionBy("job_id").orderBy(*order))
    return pages.withColumn("page_no", place).withColumn("accepted", F.col("page_no") <= limit)


def _manifest(df: DataFrame, table: str, reason: str) -> DataFrame:
    key = F.col("storage_key") if "storage_key" in df.columns else F.lit("")
    return df.select(F.lit(table).alias("table"), "job_id", key.alias("storage_key"), F.lit(reason).alias("reason"))


def retention_sweep(jobs: DataFrame, uploads: DataFrame, documents: DataFrame, now: Column) -> DataFrame:
    """Deletion manifest: own expiry first, then rows whose job goes (a row without an expiry goes with its job).

    Nothing is deleted here: the manifest drives an idempotent delete outside.
    """
    gone = jobs.filter(F.col("expires_at") < now)
    parts = [_manifest(gone, "jobs", "expired")]
    for name, child in (("uploads", uploads), ("documents", documents)):
        parts.append(_manifest(child.filter(F.col("expires_at") < now), name, "expired"))
        live = child.filter(~F.coalesce(F.col("expires_at") < now, F.lit(False)))
        parts.append(_manifest(live.join(gone.select("job_id"), "job_id", "left_semi"), name, "cascade"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def retention_counts(manifest: DataFrame) -> DataFrame:
    """Rows removed by their own expiry, per table."""
    return manifest.filter("reason = 'expired'").groupBy("table").agg(F.count("*").alias("removed"))


def erase(job_ids: DataFrame, tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Remaining tables after erasing jobs, and the manifest of erased objects."""
    ids = job_ids.select("job_id").distinct()
    left = {name: df.join(ids, "job_id", "left_anti") for name, df in tables.items()}
    manifest = None
    for name, df in tables.items():
        part = _manifest(df.join(ids, "job_id", "left_semi"), name, "erased")
        manifest = part if manifest is None else manifest.unionByName(part)
    return left, manifest


def latest_consent(consents: DataFrame) -> DataFrame:
    """Newest consent per user and version."""
    rest = [c for c in consents.columns if c not in ("user_id", "version")]
    return consents.groupBy("user_id", "version").agg(
        F.max_by(F.struct(*rest), F.struct("granted_at", *[c for c in ("consent_id",) if c in rest])).alias("c")) \
        .select("user_id", "version", "c.*")
