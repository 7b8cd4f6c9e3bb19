"""Exact dedup: two-pass Bloom filtering.

Pass one sets the bits of every text's hash in a filter whose counts saturate at
two.  A hash whose bits were all set by more than one row may be repeated; all
others surely are not.  Pass two lets the sure ones straight through and shuffles
only the rest, whose digests are then compared exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweir.llm.filters import MAX_WORDS, KeyFilter, repeat_filter
from docweir.session import materialise

DIGEST = "text_sha256"


def digest(text: str = "text") -> Column:
    """SHA-256 of a text in UTF-8, in lowercase hex; null counts as empty."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


def _suspects(digests: DataFrame, max_words: int) -> KeyFilter:
    keys = digests.select(F.xxhash64(DIGEST).alias("key"))
    return repeat_filter(keys, keys.count(), max_words)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", max_words: int = MAX_WORDS) -> DataFrame:
    """One row for each row of ``docs``: its group of equal texts and whether it stays.

    Columns: ``doc_id, keep_id, group_size, kept, text_sha256``.  Texts are equal
    when identical; null counts as empty; the largest id stays.  A null id loses
    to any other; if a group has only null ids, one of its rows stays.  Of rows
    that repeat both id and text exactly one stays.  Other columns of ``docs`` are
    not read, so their names cannot clash.  An empty table gives an empty result.

    A hot text costs one partial row for each task; its rows then meet the group's
    one row in a join whose sides are plain exchanges, which adaptive execution
    splits.
    """
    rows = materialise(docs.select(F.col(id_col).alias("doc_id"), digest(text).alias(DIGEST)), "exact-dedup")
    suspect = _suspects(rows, max_words).test(F.xxhash64(DIGEST))
    flagged = rows.withColumn("_suspect", suspect)
    alone = flagged.where(~F.col("_suspect")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), DIGEST)

    # One row for each different (digest, id); almost always that is one row of docs.
    own = materialise(flagged.where("_suspect").groupBy(DIGEST, "doc_id").agg(F.count("*").alias("_n")), "exact-dedup")
    groups = own.groupBy(DIGEST).agg(F.max("doc_id").alias("keep_id"), F.sum("_n").alias("group_size"))
    # The join has a key of its own, so that both sides are exchanged for it and a hot digest can be split.
    groups = groups.select(F.reverse(DIGEST).alias("_key"), "keep_id", "group_size")
    joined = (own.withColumn("_key", F.reverse(DIGEST)).join(groups, "_key")
              .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
              .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)))
    return alone.unionByName(joined.select("doc_id", "keep_id", "group_size", "kept", DIGEST))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text: str = "text", max_words: int = MAX_WORDS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    The rule is that of ``exact_groups``.  Texts that surely occur once are not
    shuffled.
    """
    marked = docs.withColumn("__digest", digest(text))
    filter_ = _suspects(marked.select(F.col("__digest").alias(DIGEST)), max_words)
    marked = marked.withColumn("__suspect", filter_.test(F.xxhash64("__digest")))
    alone = marked.where(~F.col("__suspect")).drop("__digest", "__suspect")
    rest = marked.where("__suspect").drop("__suspect")
    # Without the text: of each digest the id that stays.
    keep = (rest.select(F.col(id_col).alias("__id"), F.col("__digest").alias("__d"))
            .groupBy("__d").agg(F.max("__id").alias("__keep")))
    stays = (rest.join(keep, (F.col("__digest") == F.col("__d")) & F.col(id_col).eqNullSafe(F.col("__keep")), "left_semi")
             .dropDuplicates(["__digest", id_col]).drop("__digest"))
    return alone.unionByName(stays)
