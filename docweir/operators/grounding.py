"""Evidence checks of model answers against the source text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from docweir import messages as msg
from docweir.functions import patterns as p
from docweir.functions.similarity import partial_at_least
from docweir.functions.text import digits, extract_json, let, norm_for_grounding, strip
from docweir.schema import EXACT_MATCH_PATHS, is_empty
from docweir.session import materialise

REASON_DATE = "date not present in the recognised text"
REASON_ID = "identifier not found verbatim in the recognised text"
REASON_TEXT = "value not supported by the recognised text"


def _triples(text: Column, pattern: str, order: tuple[int, int, int]) -> Column:
    """Dates of one shape as 'y-m-d' keys without leading zeros."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def key(hit: Column) -> Column:
        parts = F.split(hit, "[-./]")
        return F.concat_ws("-", *[F.get(parts, F.lit(k)).cast("int").cast("string") for k in order])

    return F.transform(hits, key)


def date_tokens(text: Column) -> Column:
    """Every date of a text in any accepted shape, as comparable keys."""
    runs = F.transform(F.regexp_extract_all(text, F.lit(p.DATE_RUN), F.lit(1)), lambda r: F.concat_ws(
        "-", *[F.substring(r, a, n).cast("int").cast("string") for a, n in ((1, 4), (5, 2), (7, 2))]))
    return F.array_distinct(F.concat(_triples(text, p.DATE_YMD, (0, 1, 2)),
                                     _triples(text, p.DATE_DMY, (2, 1, 0)), runs))


def evidence(texts: DataFrame, text: str = "text") -> DataFrame:
    """Per document: comparison form, digits and date keys, computed once."""
    t = F.col(text)
    return texts.select("doc_id", norm_for_grounding(t).alias("_norm"), digits(t).alias("_digits"),
                        date_tokens(t).alias("_dates"))


def ground(values: DataFrame, texts: DataFrame, threshold: float | None = 90) -> DataFrame:
    """Adds ``accepted`` and ``reason`` to (doc_id, path, value).

    The exact tests decide almost every row inside the JVM; of the values they
    cannot decide, only those of which a piece stands in the text go to Python.
    ``threshold=None`` leaves the fuzzy step out.
    """
    value = strip(F.col("value"))
    v = (values.withColumn("_v", value)
         .withColumn("_vnorm", norm_for_grounding(F.col("_v")))
         .withColumn("_vdigits", digits(F.col("_v"))))
    joined = v.join(evidence(texts), "doc_id", "left")
    blank = is_empty(F.col("_v"))
    is_date = F.col("_v").rlike(r"^\d{4}-\d{2}-\d{2}$")
    y, m, d = [F.substring("_v", a, n) for a, n in ((1, 4), (6, 2), (9, 2))]
    key = F.concat_ws("-", *[x.try_cast("int").cast("string") for x in (y, m, d)])
    yy = F.substring("_v", 3, 2)
    date_ok = (F.array_contains("_dates", key)
               | F.contains(F.col("_digits"), F.concat(d, m, yy))
               | F.contains(F.col("_digits"), F.concat(yy, m, d)))
    numeric = (F.col("_vdigits") == F.col("_v"))
    strict = F.col("path").isin(EXACT_MATCH_PATHS) | numeric
    needle = F.when(F.col("_vdigits") != "", F.col("_vdigits")).otherwise(F.col("_vnorm"))
    hay = F.when(numeric, F.col("_digits")).otherwise(F.col("_norm"))
    strict_ok = (needle != "") & F.contains(hay, needle)
    text_ok = (F.col("_vnorm") == "") | F.contains(F.col("_norm"), F.col("_vnorm"))

    decided = (joined
               .withColumn("_kind", F.when(blank, "blank").when(is_date, "date")
                           .when(strict, "id").otherwise("text"))
               .withColumn("_ok", F.coalesce(
                   F.when(F.col("_kind") == "blank", F.lit(True))
                   .when(F.col("_kind") == "date", date_ok)
                   .when(F.col("_kind") == "id", strict_ok).otherwise(text_ok), F.lit(False))))
    if threshold is not None:
        open_case = ~F.col("_ok") & (F.col("_kind") == "text")
        near = partial_at_least(F.when(open_case, F.col("_vnorm")),
                                F.when(open_case, F.coalesce("_norm", F.lit(""))), threshold)
        decided = decided.withColumn("_ok", F.col("_ok") | F.coalesce(near, F.lit(False)))
    reason = (F.when(F.col("_ok"), F.lit(None).cast("string"))
              .when(F.col("_kind") == "date", REASON_DATE)
              .when(F.col("_kind") == "id", REASON_ID).otherwise(REASON_TEXT))
    return decided.withColumn("accepted", F.col("_ok")).withColumn("reason", reason).drop(
        "_v", "_vnorm", "_vdigits", "_norm", "_digits", "_dates", "_kind", "_ok")


def keep_grounded(checked: DataFrame) -> DataFrame:
    """Rejected values become NULL with a warning; nothing is dropped."""
    warning = F.concat(F.lit("'"), "path", F.lit(msg.REJECTED[0]), "reason", F.lit(msg.REJECTED[1]))
    return (checked.withColumn("warning", F.when(~F.col("accepted"), warning))
            .withColumn("value", F.when(F.col("accepted"), F.col("value"))))


def rejection_rate(checked: DataFrame, *by: str) -> DataFrame:
    """Share of asserted (non-null) values that the text does not support."""
    asserted = checked.filter(F.col("value").isNotNull())
    rate = F.avg(F.when(F.col("accepted"), 0.0).otherwise(1.0)).alias("rejection_rate")
    return asserted.groupBy(*by).agg(F.count("*").alias("asserted"), rate)


def parse_reply(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Model replies to long (doc_id, path, value).

    A reply that nests ``values`` and ``legible`` loses the fields it marked
    illegible; NULL values are kept so that callers can count them.
    """
    def entries(j: Column) -> Column:
        values = F.from_json(F.coalesce(F.get_json_object(j, "$.values"), j), "map<string,string>")
        legible = F.from_json(F.get_json_object(j, "$.legible"), "map<string,boolean>")
        return let(legible, lambda ok: F.filter(F.map_entries(values), lambda e: F.coalesce(
            F.try_element_at(ok, e["key"]), F.lit(True))))

    found = let(extract_json(F.col(reply)), entries)
    # The outer form keeps the optimizer from evaluating the replies a second
    # time in an inferred non-empty filter.
    return replies.select("doc_id", F.inline_outer(found)).filter(F.col("key").isNotNull()).select(
        "doc_id", F.col("key").alias("path"), "value")


def _fingerprint_udf(gram: int, window: int):
    """Window minima of hashed character n-grams (winnowing).

    Any two strings that share a run of ``gram + window - 1`` characters share
    at least one fingerprint, because the shared windows choose the same minimum.
    """
    def fingerprints(batch: pd.Series) -> pd.Series:
        import numpy as np
        base = 1099511628211

        def one(text):
            if text is None or len(text) < gram + window - 1:
                return []
            codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
            with np.errstate(over="ignore"):
                h = rolled(codes)
                h ^= h >> np.uint64(31)
                h *= np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            low = h    # minima of a stretch twice as long each time, at last of two that overlap
            size = 1
            while 2 * size <= window:
                low, size = np.minimum(low[:-size], low[size:]), 2 * size
            if size < window:
                low = np.minimum(low[:len(low) - window + size], low[window - size:])
            changes = np.flatnonzero(low[1:] != low[:-1]) + 1
            return np.unique(low[np.concatenate(([0], changes))]).astype(np.int64)

        def rolled(codes):
            """Polynomial hashes of ``gram`` characters: stretches doubled, one character more where the bit is set."""
            h, size, power = codes, 1, base
            for bit in bin(gram)[3:]:
                h = h[:-size] * np.uint64(power) + h[size:]
                size, power = 2 * size, power * power % (1 << 64)
                if bit == "1":
                    h = h[:-1] * np.uint64(base) + codes[size:]
                    size, power = size + 1, power * base % (1 << 64)
            return h if gram > 1 else h.copy()

        return batch.map(one)

    return F.pandas_udf(fingerprints, "array<bigint>")


def _small(df: DataFrame, size: Column, limit: int) -> bool:
    """Whether the summed size of ``df`` stays within ``limit`` (runs a count)."""
    total = df.agg(F.sum(size).alias("n")).first()["n"]
    return total is None or total <= limit


def contamination(documents: DataFrame, passages: DataFrame, gram: int = 16,
                  window: int = 16, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """(doc_id, item_id): passages whose comparison form occurs in a document.

    Long passages meet documents through winnowing fingerprints: one fingerprint
    per distinct passage, the one the fewest documents carry, is enough to find
    every document that contains it.  Passages too short for a fingerprint are
    looked up among the n-grams of their own length.  Candidate pairs are then
    verified by containment; copies of a passage are checked once.

    Document text is read twice and never shuffled as long as the passage side
    is measured to be small; above ``broadcast_bytes`` the same joins shuffle.
    The second reading brings only documents with a candidate into comparison
    form, and writes it, so that no filter works it out again for each pair.
    """
    shortest = gram + window - 1
    items = passages.select("item_id", norm_for_grounding(F.col("text")).alias("needle")) \
        .filter(F.col("needle") != "")
    needles = items.select("needle").distinct()
    docs = documents.select("doc_id", norm_for_grounding(F.col("text")).alias("hay"))
    mark = _fingerprint_udf(gram, window)

    own = materialise(needles.filter(F.length("needle") >= shortest).select(
        "needle", F.explode(mark(F.col("needle"))).alias("mark")), "passage-marks")
    keys = own.select("mark").distinct()
    if _small(keys, F.lit(16), broadcast_bytes):
        keys = F.broadcast(keys)
    wanted = materialise(docs.select("doc_id", F.explode(mark(F.col("hay"))).alias("mark"))
                         .join(keys, "mark", "left_semi"), "document-marks")
    counts = wanted.groupBy("mark").agg(F.count("*").alias("n"))
    rarest = own.join(counts, "mark", "left").groupBy("needle").agg(
        F.min_by(F.struct("mark", "n"), F.struct(F.coalesce("n", F.lit(0)), "mark")).alias("m"))
    pairs = wanted.join(rarest.filter(F.col("m.n").isNotNull()).select(
        "needle", F.col("m.mark").alias("mark")), "mark").select("doc_id", "needle")
    pairs = materialise(pairs, "candidate-pairs")
    if _small(pairs, F.length("needle") + 16, broadcast_bytes):
        pairs = F.broadcast(pairs)
        met = F.broadcast(pairs.select("doc_id").distinct())
    else:
        met = pairs.select("doc_id").distinct()
    read = documents.select("doc_id", "text").join(met, "doc_id", "left_semi")
    met_docs = materialise(read.select("doc_id", norm_for_grounding(F.col("text")).alias("hay")), "candidate-documents")
    found = met_docs.join(pairs, "doc_id").filter(F.contains("hay", "needle")).select("doc_id", "needle")

    # At most ``shortest - 1`` distinct lengths exist below the fingerprint size.
    short = needles.filter(F.length("needle") < shortest)
    sizes = sorted(r["n"] for r in short.groupBy(F.length("needle").alias("n")).agg(F.lit(1)).collect())
    if sizes:
        grams = docs.select("doc_id", F.explode(F.array_distinct(_spans(sizes))).alias("needle"))
        if _small(short, F.length("needle") + 16, broadcast_bytes):
            short = F.broadcast(short)
        found = found.unionByName(grams.join(short, "needle", "left_semi"))
    return found.join(items, "needle").select("doc_id", "item_id")


def _spans(sizes: list[int]) -> Column:
    """Every substring of ``hay`` with one of the given lengths."""
    def of_size(n: int) -> Column:
        def cut(at: Column) -> Column:
            return F.substring(F.col("hay"), at, F.lit(n))

        return F.transform(F.sequence(F.lit(1), F.greatest(F.length("hay") - n + 1, F.lit(1))), cut)

    return F.flatten(F.array(*[of_size(n) for n in sizes]))
