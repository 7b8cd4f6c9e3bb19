"""Ordered scans that no single task has to carry: running totals, exact quantiles (state machines: ``folds``).

A window ordered over a whole key puts the key's rows into one task.  Here rows
are range-partitioned on (key, order), which cuts even a single hot key into
even parts; totals are reduced per part, a window runs over the few part rows of
a key, and only a part is scanned row by row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from docweir.session import materialise

PART, AT = "_part", "_at"


def ordered_parts(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows with the number of their range part and their own place, both monotone in (keys, order).

    The place is unique, so rows with equal or null keys and orders stay apart.
    The rows are written once, because later steps join on part and place and a
    second sampling could draw other boundaries.
    """
    if PART in df.columns:
        return df
    columns = [F.col(c) for c in [*keys, *order]]
    ranged = df.repartitionByRange(*columns).sortWithinPartitions(*columns)
    return materialise(ranged.withColumns({PART: F.spark_partition_id(), AT: F.monotonically_increasing_id()}), "ordered-parts")


def _joined(left: DataFrame, right: DataFrame, keys: list[str], exact: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``, nulls equal, and on ``exact``, which are never null."""
    other = right.select(*[F.col(k).alias(f"_r_{k}") for k in [*keys, *exact]],
                         *[c for c in right.columns if c not in {*keys, *exact}])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    for k in exact:
        on = on & (F.col(k) == F.col(f"_r_{k}"))
    return left.join(other, on, how).drop(*[f"_r_{k}" for k in [*keys, *exact]])


def _before(keys: list[str], order: str) -> Window:
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def running_total(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over earlier rows of the same key.

    ``value`` should be integral so that the order of addition cannot matter.
    Part and place stay in the result, for a further scan in the same order.
    """
    rows = ordered_parts(df, keys, order)
    totals = rows.groupBy(*keys, PART).agg(F.sum(value).alias("_t"))
    prefix = totals.withColumn("_p", F.coalesce(F.sum("_t").over(_before(keys, PART)), F.lit(0))).drop("_t")
    summed = rows.withColumn("_i", F.coalesce(F.sum(value).over(_before([*keys, PART], AT)), F.lit(0)))
    return _joined(summed, prefix, keys, [PART]).withColumn(out, F.col("_p") + F.col("_i")).drop("_p", "_i")


def _ordered_bits(value: Column) -> Column:
    """Doubles as whole numbers in the same order; NaN above all, both zeros alike."""
    @F.arrow_udf("long")
    def bits(column: pa.Array) -> pa.Array:
        x = column.to_numpy(zero_copy_only=False).astype(float) + 0.0
        raw = np.where(np.isnan(x), np.nan, x).view(np.int64)
        return pa.array(np.where(raw < 0, raw ^ np.int64(0x7FFFFFFFFFFFFFFF), raw), pa.int64(), mask=column.is_null().to_numpy(zero_copy_only=False))
    return bits(value.cast("double"))


def _found(items: Column, rank: Column) -> Column:
    """The first of sorted (b, n, low, high) whose running count passes ``rank``, with the count before it."""
    none = F.struct(F.lit(None).cast("long").alias("b"), F.lit(0).cast("long").alias("before"), F.lit(None).cast("double").alias("low"),
                    F.lit(None).cast("double").alias("high"))

    def step(acc: Column, x: Column) -> Column:
        hit = acc["b"].isNull() & (acc["before"] + x["n"] > rank)
        return F.struct(F.when(hit, x["b"]).otherwise(acc["b"]).alias("b"),
                        F.when(hit | acc["b"].isNotNull(), acc["before"]).otherwise(acc["before"] + x["n"]).alias("before"),
                        F.when(hit, x["low"]).otherwise(acc["low"]).alias("low"), F.when(hit, x["high"]).otherwise(acc["high"]).alias("high"))
    return F.aggregate(items, none, step)


#: Bits of a value that one pass tells apart, and targets (one for each group and rank) that may be sent to every executor.
RADIX, SMALL_TARGETS = 16, 100_000


def exact_quantiles(df: DataFrame, by: list[str], value: str, qs: list[float]) -> DataFrame:
    """(by…, q, value): linear-interpolated quantiles, exact at any size; null values do not count.

    Radix selection: rows are counted by the leading bits of their values, which
    tells the bits in which each wanted rank lies; the next pass counts only rows
    with those bits, by the bits that follow.  It ends as soon as every bracket holds
    a single value, at the latest after four passes.  Counts of a pass are at most
    2**16 for each group and rank; no window and no task sees the rows of a group.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    rows = materialise(rows.withColumn("_k", _ordered_bits(F.col("_v"))), "quantile-values")
    held = [f"_g{k}" for k in range(len(by))]
    ranks = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.lit(s).alias("upper"), F.lit(q).alias("_q")) for q in qs for s in (False, True)]))
    done, open_, shift = None, None, 64
    while True:
        shift -= RADIX
        bucket = F.shiftright("_k", shift)
        if open_ is None:
            part = rows.withColumn("_p", F.lit(0).cast("long"))
        else:
            wanted = open_.select(*[F.col(b).alias(h) for b, h in zip(by, held)], F.col("_p").alias("_w")).distinct()
            wanted = F.broadcast(wanted) if open_.count() <= SMALL_TARGETS else wanted
            on = F.shiftright("_k", shift + RADIX) == F.col("_w")
            for b, h in zip(by, held):
                on = on & F.col(b).eqNullSafe(F.col(h))
            part = rows.join(wanted, on).withColumnRenamed("_w", "_p").drop(*held)
        counts = part.groupBy(*by, "_p", bucket.alias("b")).agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
        listed = materialise(counts.groupBy(*by, "_p").agg(F.array_sort(F.collect_list(F.struct("b", "n", "low", "high"))).alias("_items"),
                                                          F.sum("n").alias("_n")), "quantile-counts")
        if open_ is None:
            targets = listed.select(*by, "_items", "_n", ranks.alias("_r")).select(
                *by, "_items", "_r.q", "_r.upper", (F.col("_r._q") * (F.col("_n") - 1)).alias("_pos"))
            targets = targets.withColumn("_rank", F.when(F.col("upper"), F.ceil("_pos")).otherwise(F.floor("_pos")).cast("long"))
        else:
            own = listed.select(*[F.col(b).alias(h) for b, h in zip(by, held)], F.col("_p").alias("_w"), "_items")
            on = F.col("_p") == F.col("_w")
            for b, h in zip(by, held):
                on = on & F.col(b).eqNullSafe(F.col(h))
            targets = open_.join(own, on).drop("_w", *held)
        found = targets.withColumn("_f", _found(F.col("_items"), F.col("_rank"))).select(
            *by, "q", "upper", "_pos", F.col("_f.b").alias("_p"), (F.col("_rank") - F.col("_f.before")).alias("_rank"),
            F.col("_f.low").alias("_low"), F.col("_f.high").alias("_high"))
        found = materialise(found, "quantile-targets")
        settled = F.col("_low").eqNullSafe(F.col("_high"))
        ready = found.where(settled if shift else F.lit(True)).select(*by, "q", "upper", "_pos", F.col("_low").alias("_x"))
        done = ready if done is None else done.unionByName(ready)
        open_ = found.where(~settled).drop("_low", "_high")
        if not shift or not open_.head(1):
            break
    low, high = F.max(F.when(~F.col("upper"), F.col("_x"))), F.max(F.when(F.col("upper"), F.col("_x")))
    ends = done.groupBy(*by, "q", "_pos").agg(low.alias("_a"), high.alias("_z"))
    between = F.when(F.col("_a") == F.col("_z"), F.col("_a")).otherwise(F.col("_a") + (F.col("_z") - F.col("_a")) * (F.col("_pos") - F.floor("_pos")))
    return ends.select(*by, "q", between.alias("value"))
