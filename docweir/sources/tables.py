"""Readers and writers of stored data (SRC1-SRC5, SNK1-SNK5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from docweir.functions.scores import polygon_bbox
from docweir.functions.text import strip

KEY_VERSION = "01"


def _aes_key(key_b64: str) -> Column:
    return F.unbase64(F.lit(key_b64.replace("-", "+").replace("_", "/")))


def encrypt_extractions(df: DataFrame, key_b64: str, payload: str = "payload") -> DataFrame:
    """Replace ``payload`` by ``data_encrypted``: version byte, nonce, ciphertext, tag.

    The job id is the authenticated context, so a blob moved to another job does
    not open.
    """
    blob = F.aes_encrypt(F.col(payload).cast("binary"), _aes_key(key_b64), F.lit("GCM"), F.lit("DEFAULT"),
                         F.lit("").cast("binary"), F.col("job_id").cast("string").cast("binary"))
    return df.withColumn("data_encrypted", F.concat(F.unhex(F.lit(KEY_VERSION)), blob)).drop(payload)


def decrypt_extractions(df: DataFrame, key_b64: str, payload: str = "payload") -> DataFrame:
    """Open stored blobs; a wrong version, key, job or altered byte gives NULL and ``error``."""
    known = F.hex(F.substring("data_encrypted", 1, 1)) == KEY_VERSION
    plain = F.when(known, F.try_aes_decrypt(
        F.expr("substring(data_encrypted, 2)"), _aes_key(key_b64), F.lit("GCM"), F.lit("DEFAULT"),
        F.col("job_id").cast("string").cast("binary"))).cast("string")
    out = df.withColumn(payload, plain)
    return out.withColumn("error", F.when(~F.coalesce(known, F.lit(False)), "unknown ciphertext version")
                          .when(F.col(payload).isNull(), "decryption failed (wrong key or tampered data)")).drop("data_encrypted")


def write_extractions(df: DataFrame, path: str, key_b64: str) -> None:
    encrypt_extractions(df, key_b64).write.mode("append").parquet(path)


def read_extractions(spark: SparkSession, path: str, key_b64: str) -> DataFrame:
    return decrypt_extractions(spark.read.parquet(path), key_b64)


def read_uploads(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length, content) of every uploaded file."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option(
        "recursiveFileLookup", "true").load(path).select("path", "length", "content")


OCR_LINES = "doc_id bigint, page int, line_no int, text string, box array<array<int>>, confidence double"


def read_ocr_lines(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Recognised lines; the polygon becomes its enclosing box."""
    df = spark.read.schema(OCR_LINES).format(fmt).load(path)
    return df.withColumn("bbox", polygon_bbox(F.col("box"))).drop("box")


EVAL_CASES = "id string, note string, input_text string, requested array<string>, expected string"


def read_eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases from JSON lines, ``expected`` kept as JSON text; bad lines fail."""
    return spark.read.schema(EVAL_CASES).option("mode", "FAILFAST").json(path)


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """(name, version, text) from files ``<name>.v<N>.txt``; other names are ignored."""
    name = F.regexp_extract("_metadata.file_name", r"^([a-z0-9_]+)\.v(\d+)\.txt$", 1)
    version = F.regexp_extract("_metadata.file_name", r"^([a-z0-9_]+)\.v(\d+)\.txt$", 2)
    df = spark.read.text(path, wholetext=True).select(
        name.alias("name"), version.try_cast("int").alias("version"), strip(F.col("value")).alias("text"))
    return df.filter(F.col("name") != "")


_TS, _S = T.TimestampType(), T.StringType()
_LIST = T.ArrayType(T.StringType())


def _table(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


# The stored tables and their columns.
TABLES: dict[str, T.StructType] = {
    "users": _table(("id", _S), ("email", _S), ("role", _S), ("is_active", T.BooleanType()), ("created_at", _TS)),
    "consents": _table(("id", _S), ("user_id", _S), ("version", _S), ("text_hash", _S), ("allows_third_party", T.BooleanType()),
                       ("allows_training_use", T.BooleanType()), ("ip", _S), ("granted_at", _TS)),
    "jobs": _table(("id", _S), ("user_id", _S), ("status", _S), ("doc_type", _S), ("error_code", _S), ("error_message", _S),
                   ("stages_used", _LIST), ("llm_cost_usd", T.DoubleType()), ("created_at", _TS), ("completed_at", _TS), ("expires_at", _TS)),
    "uploads": _table(("id", _S), ("job_id", _S), ("storage_key", _S), ("mime", _S), ("size", T.IntegerType()), ("sha256", _S),
                      ("expires_at", _TS), ("created_at", _TS)),
    "extractions": _table(("id", _S), ("job_id", _S), ("data_encrypted", T.BinaryType()), ("overall_confidence", T.DoubleType()),
                          ("needs_review", _LIST), ("warnings", _LIST), ("model_versions", T.MapType(_S, _S)), ("reviewed_at", _TS),
                          ("reviewed_by", _S), ("created_at", _TS)),
    "templates": _table(("id", _S), ("owner_id", _S), ("name", _S), ("original_format", _S), ("storage_key", _S), ("spec", _S),
                        ("output_formats", _LIST), ("version", T.IntegerType()), ("is_published", T.BooleanType()),
                        ("is_public", T.BooleanType()), ("created_at", _TS)),
    "documents": _table(("id", _S), ("job_id", _S), ("template_id", _S), ("storage_key", _S), ("format", _S), ("missing_fields", _LIST),
                        ("created_at", _TS), ("expires_at", _TS)),
    "llm_usage": _table(("id", _S), ("job_id", _S), ("provider", _S), ("model", _S), ("task", _S), ("tokens_in", T.IntegerType()),
                        ("tokens_out", T.IntegerType()), ("cost_usd", T.DoubleType()), ("latency_ms", T.IntegerType()), ("created_at", _TS)),
    "audit_log": _table(("id", _S), ("actor_id", _S), ("action", _S), ("resource_type", _S), ("resource_id", _S), ("ip", _S),
                        ("user_agent", _S), ("created_at", _TS)),
}


def read_table(spark: SparkSession, name: str, path: str | None = None, jdbc: dict[str, str] | None = None) -> DataFrame:
    """One stored table from parquet, or over JDBC with the caller's options.

    For large tables pass ``partitionColumn``/``lowerBound``/``upperBound``/
    ``numPartitions`` so that the read is parallel.
    """
    if jdbc is not None:
        df = spark.read.format("jdbc").options(dbtable=name, **jdbc).load()
        return df.select(*[F.col(f.name) for f in TABLES[name].fields if f.name in df.columns])
    return spark.read.schema(TABLES[name]).parquet(path)


def _newest(entries: DataFrame) -> DataFrame:
    """One entry for each tenant and key: the one that expires last, of equals the larger value."""
    rest = [c for c in entries.columns if c not in ("tenant", "cache_key")]
    order = F.struct(*[F.col(c) for c in ("expires_at", "value")])
    return entries.groupBy("tenant", "cache_key").agg(F.max_by(F.struct(*rest), order).alias("_e")).select(
        "tenant", "cache_key", "_e.*").select(*entries.columns)


def write_cache(df: DataFrame, path: str) -> None:
    """Append answers (tenant, cache_key, value, expires_at), one folder per tenant and one entry for each key.

    Earlier entries of a key stay in their files; ``read_cache`` gives the newest, and
    ``compact_cache`` writes the newest ones anew.
    """
    _newest(df).write.mode("append").partitionBy("tenant").parquet(path)


def read_cache(spark: SparkSession, path: str, now: Column) -> DataFrame:
    """Live cache entries, the newest of each key; the tenant filter of a caller prunes folders."""
    return _newest(spark.read.parquet(path)).filter(F.col("expires_at") > now)


def compact_cache(spark: SparkSession, path: str, to: str, now: Column) -> None:
    """Write the live entries of ``path`` to a new folder ``to``, one for each key."""
    read_cache(spark, path, now).write.mode("errorifexists").partitionBy("tenant").parquet(to)


def write_documents(df: DataFrame, path: str, days: int = 90) -> None:
    """Rendered documents per template, with their expiry."""
    df.withColumn("expires_at", F.col("created_at") + F.make_dt_interval(F.lit(days))) \
        .write.mode("append").partitionBy("template_id").parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)
