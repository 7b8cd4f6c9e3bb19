"""Registered queries of the corpus operators, each over its whole table, and their DuckDB SQL."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweir.llm import (exact_dedup, jaccard_join, language, mixing, neighbours, periodic_runs, pseudonyms, quality, spelling,
                         substring_dedup, token_counts, tokens, toxicity)
from docweir.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn
    return add


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@_query("""
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
""")
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_documents(spark, sf_dir))


@_query()
def op2_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents with pseudonyms; the key of this query is public, a real one is not."""
    docs = pseudonyms.replace_private(_documents(spark, sf_dir).select("doc_id", "text"), b"example key of the query")

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return docs.select("doc_id", F.size("found").cast("long").alias("n_found"), *map(count, pseudonyms.KINDS), "text")


@_query()
def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_groups(_documents(spark, sf_dir))


@_query("""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT AS place
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size, 3 * source_size AS cap,
         1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM s),
r AS (
  SELECT *, coalesce(sum(cap) OVER before, 0) AS clamped, sum(weight) OVER onward AS free,
         (SELECT sum(source_size) FROM s) AS total, cap / weight AS ratio,
         row_number() OVER (ORDER BY cap / weight, weight, source) AS k
  FROM w WINDOW before AS (ORDER BY cap / weight, weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                onward AS (ORDER BY cap / weight, weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
l AS (SELECT arg_min((total - clamped)::DOUBLE / free::DOUBLE, k) AS level FROM r
      WHERE weight * ((total - clamped)::DOUBLE / free::DOUBLE) <= cap),
t AS (
  SELECT source, source_size, least(weight * coalesce(level, cap), cap)::DOUBLE AS target FROM w LEFT JOIN l ON true),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
x AS (
  SELECT d.doc_id, d.size, e.source_size, e.target, e.whole, e.target - e.whole * e.source_size AS more,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY place, d.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN 2 * upto - size <= 2 * more THEN 1 ELSE 0 END))::BIGINT AS taken FROM x
""")
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


@_query()
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights = toxicity.fit(docs, labels, toxicity.confirmed_rows())
    scored = toxicity.score(docs.select("doc_id", "text"), weights)
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).alias("held_out"),
                         "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@_query()
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    names, prototypes = language.fit(docs, F.coalesce(rest != 1, F.lit(False)))
    found = language.identify(docs.select("doc_id", "text"), names, prototypes)
    return found.select("doc_id", (rest == 1).alias("held_out"), "lang_pred", "score")


@_query()
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache of its own in the shared folder."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return token_counts.token_counts(docs, public_tokenizers.path("word_bpe_49k.json"), scratch_path(spark, "token-cache"))


@_query("""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w),
h AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i + 49 <= len(w) THEN md5(array_to_string(w[i:i + 49], ' ')) END AS h FROM p),
m AS (SELECT *, CASE WHEN h IS NOT NULL AND min(doc_id) OVER (PARTITION BY h) < doc_id THEN i END AS starts FROM h),
c AS (SELECT doc_id, i, word,
             coalesce(max(starts) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) > 0 AS gone
      FROM m),
k AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed,
             sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
       coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id
""")
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeats(_documents(spark, sf_dir))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@_query("""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""")
def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return neighbours.nearest(vectors, F.col("vec_id") % 20 == 0, 20)


@_query()
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    coded = tokens.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), decoded="decoded")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        tokens.ids_digest("ids").alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@_query()
def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), quality.learnt_rows())
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (~quality.learnt_rows() & F.col("doc_id").isNotNull()).alias("held_out"),
                         "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: in a tenth of the documents the words from some place on repeat a period, both given by the CRC-32 of the id.

    A row without an id stays as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    n, g = F.size("_words").cast("long"), F.floor(h / 10)
    a = g % F.greatest(n, F.lit(1).cast("long"))
    p = 1 + F.floor((n - a) / (3 + g % 8))
    planted = F.concat(F.slice("_words", F.lit(1), a.cast("int")),
                       F.transform(F.sequence(a, n - 1), lambda i: F.element_at("_words", (a + (i - a) % p + 1).cast("int"))))
    chosen = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("_words"))
    return chosen.select("doc_id", F.when(F.size("_words") > 0, F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))


@_query()
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(with_planted_runs(_documents(spark, sf_dir)))
    # The longest run; of equals the one that starts first, then the one of smaller period.
    order = F.transform("runs", lambda r: F.struct((-r["length"]).alias("length"), r["start"].alias("start"), r["period"].alias("period")))
    best = F.array_min(order)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        (-F.col("best.length")).alias("length"), F.col("best.period").alias("period"),
        F.floor(-1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("kept_text").cast("binary"), 256).alias("collapsed_sha256"))


def lost_letters(doc_id) -> Callable[[bytes], bytes]:
    """Changes a lower-cased run (Latin-1) of a document: one in 199 loses a letter, as the CRC-32 of ``id:run`` tells."""
    if doc_id is None:
        return lambda run: run
    begun = zlib.crc32(f"{doc_id}:".encode())

    def change(run: bytes) -> bytes:
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), begun)
        return run if h % 199 else run[:h % len(run)] + run[h % len(run) + 1:]
    return change


@_query()
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.count_words(_documents(spark, sf_dir), "[A-Za-z\u00C0-\u00FF]", 6, edit=lost_letters)
    return spelling.group_variants(words.where("n >= 5"))
