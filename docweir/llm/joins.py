"""Joins of a large table with a table of one row for each key, whatever the key's share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A table of at most so many narrow rows (about 10 MB) may be sent to every executor.
SMALL_ROWS = 100_000


def attach(large: DataFrame, small: DataFrame, key: str, spread: Column, rows: int, salts: int = 16) -> DataFrame:
    """Left join on ``key``, nulls equal.

    ``rows`` is the counted size of ``small``.  Up to ``SMALL_ROWS`` it is
    broadcast; beyond that every key of it is repeated ``salts`` times and the
    large side is dealt over them by ``spread``, so that no key makes one task.
    """
    if rows <= SMALL_ROWS:
        right = F.broadcast(small.withColumnRenamed(key, "__key"))
        return large.join(right, F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key")
    right = (small.withColumnRenamed(key, "__key")
             .withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))))
    left = large.withColumn("__deal", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    on = F.col(key).eqNullSafe(F.col("__key")) & (F.col("__deal") == F.col("__salt"))
    return left.join(right, on, "left").drop("__key", "__salt", "__deal")
