"""Bloom filters of bounded size over 64-bit keys.

A key owns one 64-bit word of the filter and one bit in each quarter of it.  The
filter never exceeds ``max_words`` words (32 MB by default, held once on the
driver and on each executor); past that size it only lets more keys through, and
whoever uses it checks those keys exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweir.llm.words import mix

MAX_WORDS = 1 << 22


def _place(keys: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of each key, and its four bits (an array of four columns)."""
    h = mix(keys.view(np.uint64))
    word = (h % np.uint64(words)).astype(np.int64)
    g = mix(h)
    bits = np.stack([((g >> np.uint64(8 * j)) & np.uint64(15)) + np.uint64(16 * j) for j in range(4)], axis=1)
    return word, bits


def _merged(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted bit places (word * 64 + bit) as distinct words with their bits."""
    if not len(places):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = places >> 6
    start = np.flatnonzero(np.diff(word, prepend=word[0] - 1))
    mask = np.bitwise_or.reduceat(np.uint64(1) << (places & 63).astype(np.uint64), start)
    return word[start], mask.view(np.int64)


def _counted(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each task: the bits its keys set, and the bits that two or more of its keys set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, bits = _place(batch.column(0).to_numpy(zero_copy_only=False), words)
            place, times = np.unique((word[:, None] * 64 + bits.astype(np.int64)).ravel(), return_counts=True)
            seen, once = _merged(place)
            twice = np.zeros(len(seen), np.int64)
            again, mask = _merged(place[times > 1])
            twice[np.searchsorted(seen, again)] = mask
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(once), pa.array(twice)],
                                             names=["word", "once", "twice"])
    return run


class KeyFilter:
    """Answers "perhaps" or "surely not" for keys; built once, sent to every executor."""

    def __init__(self, spark, words: np.ndarray):
        self._shared = spark.sparkContext.broadcast(words)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """The same for an array of keys, inside a task."""
        filled = self._shared.value
        word, bits = _place(keys, len(filled))
        return (((filled[word][:, None] >> bits) & np.uint64(1)) == 1).all(axis=1)

    def test(self, key: Column) -> Column:
        """Whether the key is perhaps in the filter; null keys are not."""
        own = self

        @F.pandas_udf("boolean")
        def perhaps(k):
            return pd.Series(own.holds(k.to_numpy(np.int64)))
        return perhaps(F.coalesce(key, F.lit(0).cast("long"))) & key.isNotNull()


def _size(rows: int, max_words: int) -> int:
    return min(max_words, max(64, 1 << (max(rows, 1) // 2).bit_length()))


def _filled(df: DataFrame, column: str, words: int) -> np.ndarray:
    got = df.select("word", column).where(F.col(column) != 0).toPandas()
    filled = np.zeros(words, np.uint64)
    filled[got["word"].to_numpy(np.int64)] = got[column].to_numpy(np.int64).view(np.uint64)
    return filled


def filter_of(keys: DataFrame, rows: int, max_words: int = MAX_WORDS) -> KeyFilter:
    """A filter of every key in the one long column of ``keys``."""
    words = _size(rows, max_words)
    marked = keys.where(F.col(keys.columns[0]).isNotNull()).mapInArrow(_counted(words), "word long, once long, twice long")
    held = marked.groupBy("word").agg(F.bit_or("once").alias("once"))
    return KeyFilter(keys.sparkSession, _filled(held, "once", words))


def repeat_filter(keys: DataFrame, rows: int, max_words: int = MAX_WORDS) -> KeyFilter:
    """A filter of the bits that more than one row set: every repeated key passes it.

    Tasks count their own keys; the counts saturate at two, so they merge in any
    order.  A word gets at most one row from a batch of rows.
    """
    words = _size(rows, max_words)
    marked = keys.where(F.col(keys.columns[0]).isNotNull()).mapInArrow(_counted(words), "word long, once long, twice long")

    def add(acc: Column, x: Column) -> Column:
        return F.struct(acc["once"].bitwiseOR(x["once"]).alias("once"),
                        acc["twice"].bitwiseOR(x["twice"]).bitwiseOR(acc["once"].bitwiseAND(x["once"])).alias("twice"))

    zero = F.struct(F.lit(0).cast("long").alias("once"), F.lit(0).cast("long").alias("twice"))
    merged = (marked.groupBy("word").agg(F.collect_list(F.struct("once", "twice")).alias("parts"))
              .select("word", F.aggregate("parts", zero, add)["twice"].alias("twice")))
    return KeyFilter(keys.sparkSession, _filled(merged, "twice", words))
