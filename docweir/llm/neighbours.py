"""Nearest neighbours by a block matrix join.

Queries and candidates are dealt into blocks of bounded size; each pair of blocks
is one tile.  In a tile the int8 product of the quantised vectors gives every
inner product up to a bound of its own; candidates whose upper bound misses the
k-th best lower bound are out, the others are computed again from the original
vectors in double precision.  The tiles' best lists are merged by bounded heaps.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

#: Rows of a block of queries and of candidates.
QUERY_BLOCK = 4096
CANDIDATE_BLOCK = 8192
_STRIP = 256        # queries of a tile that are scored at once
_PAIRS = 1 << 18    # surviving pairs that are computed again at once


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, every component finite, not all zero."""
    v = vector.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Int8 values (held as float32, in which their products are exact), scale, length and length of what was rounded away."""
    scale = np.abs(vectors).max(axis=1) / 127.0
    whole = np.rint(vectors / scale[:, None])
    rest = np.sqrt(((vectors - whole * scale[:, None]) ** 2).sum(axis=1))
    return whole.astype(np.float32), scale, np.sqrt((vectors ** 2).sum(axis=1)), rest


def tile_best(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int):
    """The ``k`` best candidates of every query of a tile: positions of queries, candidate ids, scores.

    |<q, c> - <q', c'>| <= |q - q'| |c| + |q'| |c - c'| for the rounded q', c';
    |q'| is at most |q| + |q - q'|.
    """
    q8, q_scale, q_len, q_rest = quantise(q)
    c8, c_scale, c_len, c_rest = quantise(c)
    # Products of int8 values add up exactly in float32 up to 2**24: over 1,040 components at a time.
    parts = range(0, q.shape[1], 1024)
    for at in range(0, len(q), _STRIP):
        strip = slice(at, at + _STRIP)
        score = sum((q8[strip, p:p + 1024] @ c8[:, p:p + 1024].T).astype(np.float64) for p in parts)
        score *= q_scale[strip, None]
        score *= c_scale[None, :]
        error = (q_rest[strip, None] * c_len[None, :]
                 + (q_len[strip] + q_rest[strip])[:, None] * c_rest[None, :]) * (1 + 1e-9) + 1e-12
        own = q_ids[strip, None] == c_ids[None, :]
        low = np.where(own, -np.inf, score - error)
        if k < low.shape[1]:
            least = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k]
        else:
            least = np.full(len(low), -np.inf)
        rows, found = np.nonzero((score + error >= least[:, None]) & ~own)
        exact = np.empty(len(rows))
        for i in range(0, len(rows), _PAIRS):
            part = slice(i, i + _PAIRS)
            exact[part] = (q[at + rows[part]] * c[found[part]]).sum(axis=1)
        order = np.lexsort((c_ids[found], -exact, rows))
        rows, found, exact = rows[order], found[order], exact[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = rank < k
        yield at + rows[keep], c_ids[found[keep]], exact[keep]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


_BEST = StructType([StructField("query_id", LongType()), StructField("ids", ArrayType(LongType())),
                    StructField("scores", ArrayType(DoubleType()))])


def nearest(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector: str = "embedding",
            query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """The ``k`` nearest other rows of every row for which ``is_query`` holds, by inner product in double precision.

    Columns: ``query_id, rank (from 1), vec_id, score``; fewer rows where there are
    fewer candidates.  Ties go to the smaller id.  Rows with a null id, and vectors
    that are null, zero or hold null or non-finite components, take no part; a
    query meets candidates of its own number of components.  Rows of one id are
    one vector seen several times to a query of another id, and none of them is a
    candidate of their own query; a query id that repeats is answered once, from
    the row with the largest vector.  Other columns are not read.  An empty table
    gives an empty result.

    A tile holds one block of each side, whatever the size of the table: more
    rows make more tiles.  Each query is sent once to every candidate block, and
    each candidate once to every query block.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"),
                          is_query.alias("asks")).where(F.col("id").isNotNull() & usable(F.col("v")))
    sizes = rows.agg(F.count("*"), F.count(F.when(F.col("asks"), 1))).first()
    c_blocks = max(1, -(-sizes[0] // candidate_block))
    q_blocks = max(1, -(-sizes[1] // query_block))
    rows = rows.withColumn("dim", F.size("v"))

    def numbers(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def dealt(n: int) -> Column:
        return F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")

    asking = rows.where("asks").groupBy("id").agg(F.max(F.struct("dim", "v")).alias("m")).select("id", "m.v", "m.dim")
    queries = asking.select("id", "v", "dim", F.lit(True).alias("q"), dealt(q_blocks).alias("qb"),
                            numbers(c_blocks).alias("cb"))
    candidates = rows.select("id", "v", "dim", F.lit(False).alias("q"), numbers(q_blocks).alias("qb"),
                             dealt(c_blocks).alias("cb"))

    def tile(table: pa.Table) -> pa.Table:
        asks = table.column("q").to_numpy().astype(bool)
        dim = table.column("dim")[0].as_py()
        ids, v = table.column("id").to_numpy(), _matrix(table.column("v"), dim)
        out = {"query_id": [], "ids": [], "scores": []}
        if asks.any() and not asks.all():
            q_ids = ids[asks]
            for at, found, score in tile_best(q_ids, v[asks], ids[~asks], v[~asks], k):
                cuts = np.flatnonzero(np.diff(at)) + 1
                if len(at):
                    out["query_id"] += q_ids[at[np.r_[0, cuts]]].tolist()
                    out["ids"] += np.split(found, cuts)
                    out["scores"] += np.split(score, cuts)
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()),
                         "ids": pa.array(out["ids"], pa.list_(pa.int64())),
                         "scores": pa.array(out["scores"], pa.list_(pa.float64()))})

    tiles = queries.unionByName(candidates).groupBy("dim", "qb", "cb").applyInArrow(tile, _BEST)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by query: one heap of at most ``k`` entries at a time."""
        heap, current = [], None

        def done():
            best = sorted(((s, -i) for s, i in heap), key=lambda x: (-x[0], x[1]))
            return pa.RecordBatch.from_pydict({
                "query_id": pa.array([current] * len(best), pa.int64()),
                "rank": pa.array(range(1, len(best) + 1), pa.int32()),
                "vec_id": pa.array([i for _, i in best], pa.int64()),
                "score": pa.array([s for s, _ in best], pa.float64())})

        for batch in batches:
            for query, ids, scores in zip(*(batch.column(c).to_pylist() for c in ("query_id", "ids", "scores"))):
                if query != current:
                    if current is not None:
                        yield done()
                    heap, current = [], query
                for i, s in zip(ids, scores):
                    if len(heap) < k:
                        heapq.heappush(heap, (s, -i))
                    elif (s, -i) > heap[0]:
                        heapq.heapreplace(heap, (s, -i))
                    else:
                        break
        if current is not None:
            yield done()

    return (tiles.repartition("query_id").sortWithinPartitions("query_id")
            .mapInArrow(merged, "query_id long, rank int, vec_id long, score double"))
