"""Mixing sources to target weights: capped water-filling.

Every source's target is its weight times a common level, but at most
``max_epochs`` times its size; the level rises until the targets add up to the
mix.  Documents are then taken whole ``floor(target / size of source)`` times,
and a seeded sample of them once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweir.llm.joins import attach
from docweir.llm.words import WORD
from docweir.session import materialise

#: Bits of a document's place in its source's sampling order.
_BITS = 52
#: About so many documents of a source fall into one bucket of that order.
_BUCKET = 1024


def size_of(text: str = "text") -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def place_of(id_col: str, seed: int) -> Column:
    """A document's seeded place, an integer of 52 bits."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """Number the sources by code point, null last, from 0, in range parts."""
    parts = materialise(sources.repartitionByRange(8, F.col("source").asc_nulls_last())
                        .withColumn("_part", F.spark_partition_id()), "mix-sources")
    before, offset = 0, F.lit(0).cast("long")
    for row in sorted(parts.groupBy("_part").count().collect()):  # one row for each of the 8 parts
        offset = F.when(F.col("_part") == row[0], F.lit(before).cast("long")).otherwise(offset)
        before += row[1]
    order = Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last())
    return parts.withColumn("rank", F.row_number().over(order) - 1 + offset).drop("_part")


def water_level(sources: DataFrame, total: int) -> float:
    """The level at which ``least(weight * level, cap)`` adds up to ``total``.

    Each round clamps the sources that are above their caps and shares the rest
    anew; only three sums leave the executors.
    """
    level = -1.0
    while True:
        over = F.col("weight") * F.lit(level) > F.col("cap")
        clamped, free = sources.agg(F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0)),
                                    F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0))).first()
        if not free:
            return level
        risen = (total - clamped) / free
        if risen == level:
            return level
        level = risen


def _shares(rows: DataFrame, weights: tuple[int, ...], max_epochs: int) -> tuple[DataFrame, int, int]:
    """One row for each source: target, whole repetitions, and where in its sampling order the fractional one ends.

    ``rows`` has ``__source, __size, __place``.  Also: the number of sources, and
    the bits of a place that make its bucket.
    """
    sources = materialise(rows.groupBy(F.col("__source").alias("source")).agg(
        F.sum("__size").alias("source_size"), F.count("*").alias("_n")), "mix-sources")
    many, total, most = sources.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0)),
                                    F.coalesce(F.max("_n"), F.lit(0))).first()
    turn = F.array(*[F.lit(w) for w in weights])
    weighed = (_ranked(sources).withColumn("weight", F.get(turn, (F.col("rank") % len(weights)).cast("int")))
               .withColumn("cap", F.col("source_size") * max_epochs))
    level = water_level(weighed, total)
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    shares = (weighed.withColumn("target", F.least(F.col("weight") * F.lit(level), F.col("cap").cast("double")))
              .withColumn("whole", F.floor(epochs))
              .withColumn("more", F.col("target") - F.col("whole") * F.col("source_size"))
              .select("source", "source_size", "target", "whole", "more"))

    bits = max(0, (most // _BUCKET).bit_length())
    sums = rows.groupBy(F.col("__source").alias("source"), _bucket(bits).alias("bucket")).agg(
        F.sum("__size").alias("words"))
    line = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = (attach(sums.withColumn("upto", F.sum("words").over(line)), shares.select("source", "more"),
                   "source", F.col("bucket"), many)
            .where((F.col("upto") > F.col("more")) & (F.col("upto") - F.col("words") <= F.col("more")))
            .select("source", F.col("bucket").alias("end"), (F.col("upto") - F.col("words")).alias("before")))
    return materialise(attach(shares, ends, "source", F.lit(0), many), "mix-shares"), many, bits


def _bucket(bits: int) -> Column:
    return F.shiftright("__place", _BITS - bits)


def _dealt(rows: DataFrame, shares: DataFrame, many: int, bits: int) -> DataFrame:
    """``rows`` with its source's share (a struct ``__share``) and ``__repeats``.

    Only the documents of the one bucket in which a source's sample ends are put
    in order; all others are taken or left by their bucket alone.
    """
    packed = shares.select(F.col("source").alias("__source"), F.struct(*shares.columns[1:]).alias("__share"))
    joined = attach(rows, packed, "__source", F.col("__place"), many)
    within = _bucket(bits).eqNullSafe(F.col("__share.end"))
    order = Window.partitionBy("__source").orderBy("__place", "__size").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    upto = F.col("__share.before") + F.sum("__size").over(order)
    last = joined.where(within).withColumn("__extra", 2 * upto - F.col("__size") <= 2 * F.col("__share.more"))
    rest = joined.where(~within).withColumn("__extra", F.coalesce(_bucket(bits) < F.col("__share.end"), F.lit(False)))
    return (last.unionByName(rest)
            .withColumn("__repeats", (F.col("__share.whole") + F.col("__extra").cast("int")).cast("long"))
            .drop("__extra"))


def _narrow(docs: DataFrame, seed: int, id_col: str, source: str, text: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source).cast("string").alias("__source"),
                       size_of(text).alias("__size"), place_of(id_col, seed).alias("__place"))
    return materialise(rows, "mix-sizes")


def plan(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 0,
         id_col: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """How often the mix takes each document.

    Columns: ``doc_id, source, size, source_size, target, repeats, taken``; one row
    for each row of ``docs``.  Sources by code point, null (a source like any
    other) last, weigh ``weights`` in turn, repeating; the mix is as large as the
    corpus.  ``target`` is the source's, in words; ``taken`` is ``size * repeats``.
    A source's taken words differ from its target by at most one document.  Null
    and empty texts have size 0 and are taken like any other.  The sample depends
    on ``seed`` and the ids alone; rows of equal id are ordered by size.  Other
    columns of ``docs`` are not read.  An empty table gives an empty result.
    """
    rows = _narrow(docs, seed, id_col, source, text)
    dealt = _dealt(rows, *_shares(rows, weights, max_epochs))
    return dealt.select("doc_id", F.col("__source").alias("source"), F.col("__size").alias("size"),
                        "__share.source_size", "__share.target", F.col("__repeats").alias("repeats"),
                        (F.col("__size") * F.col("__repeats")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 0,
        id_col: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mix itself: every row of ``docs`` as often as ``plan`` says, all columns kept.

    Texts are shuffled only where a source's sample ends (about a thousand
    documents of each source).
    """
    shares = _shares(_narrow(docs, seed, id_col, source, text), weights, max_epochs)
    rows = docs.withColumns({"__source": F.col(source).cast("string"), "__size": size_of(text),
                             "__place": place_of(id_col, seed)})
    dealt = _dealt(rows, *shares).where(F.col("__repeats") > 0)
    return (dealt.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__repeats"))))
            .select(*docs.columns))
