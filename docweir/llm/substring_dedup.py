"""Substring dedup by fixed-block anchors.

Reference texts are indexed by blocks of ``BLOCK`` words that do not overlap; every
rolling window of ``BLOCK`` words probes the index.  Two blocks fit into a window of
``WINDOW`` words less one, so each repeated window holds a whole block of its
reference.  Hits are extended to maximal repeats: every window around a hit is
compared by its own fingerprint, and runs of repeated windows are one span.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweir.llm.filters import filter_of
from docweir.llm.words import Words, slices, words_of
from docweir.session import materialise

WINDOW = 50
BLOCK = 25
#: Bits of a place's number that stand below its block's fingerprint in one long.
_LOW = 15


def _row(id_col: str, text: str) -> Column:
    """Names a row by its id and text; rows that repeat both share it and fare alike."""
    return F.xxhash64(F.lit(8), F.col(id_col), F.coalesce(F.col(text), F.lit("")))


def _local(words: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts that own places, and the places counted within them."""
    owner = words.owner(at)
    return owner, at - words.bounds[owner]


def _blocks(window: int, block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Every rolling block, in as few bytes as will do.

    ``key`` has 47 bits of the block's fingerprint, a bit that is 0 where it is one
    of its text's reference blocks, and the low bits of its place; ``high`` has the
    place's other bits, nearly always 0.  Blocks that meet by chance in 47 bits only
    cost a comparison later.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words = words_of(part.column("text"))
            print_, at = words.windows(block)
            owner, pos = _local(words, at)
            long = words.counts()[owner] >= window
            print_, owner, pos = print_[long], owner[long], pos[long].astype(np.uint64)
            probe = (pos % np.uint64(block) != 0).astype(np.uint64)
            key = ((print_ >> np.uint64(17)) << np.uint64(_LOW + 1)) | (probe << np.uint64(_LOW)) | (pos & np.uint64((1 << _LOW) - 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), part.column("doc_id").take(pa.array(owner)),
                 pa.array((pos >> np.uint64(_LOW)).astype(np.int32))], names=["key", "doc", "high"])
    return run


def _starts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]])


def _hits(blocks: DataFrame) -> DataFrame:
    """Places whose block is a reference block somewhere and stands under two different ids or more.

    Sorted by key, reference blocks come first; a task carries at most the places
    of one id from one batch to the next, however many rows share a block.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried, last, state = None, None, "dead"
        for batch in batches:
            if not batch.num_rows:
                continue
            key, doc, high = (batch.column(c).to_numpy() for c in ("key", "doc", "high"))
            if carried is not None:
                key, doc, high = (np.concatenate([a, b]) for a, b in zip(carried, (key, doc, high)))
            block = key >> (_LOW + 1)
            start = _starts(block)
            indexed = ((key[start] >> _LOW) & 1) == 0
            shared = np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start)
            if carried is None and block[0] == last:    # goes on with what the last batch decided
                indexed[0], shared[0] = state == "hit", True
            hit = indexed & shared
            last, carried = block[-1], None
            state = "hit" if hit[-1] else "open" if indexed[-1] else "dead"
            if state == "open":
                carried = [x[start[-1]:] for x in (key, doc, high)]
            found = np.repeat(hit, np.diff(start, append=len(key)))
            if found.any():
                pos = (high[found].astype(np.int64) << _LOW) | (key[found] & ((1 << _LOW) - 1))
                yield pa.RecordBatch.from_arrays([pa.array(doc[found]), pa.array(pos.astype(np.int32))], names=["at", "pos"])

    dealt = blocks.repartition(F.shiftright("key", _LOW + 1)).sortWithinPartitions("key")
    return dealt.mapInArrow(run, "at long, pos int")


def _with_texts(docs: DataFrame, places: DataFrame, work, schema: str) -> DataFrame:
    """Brings texts and the places of their ``at`` together and hands them to ``work``.

    ``docs`` has ``at, row, doc_id, text``, ``places`` has ``at, pos``.  ``work``
    gets a list of (row, doc_id, text, places), one for each row of ``docs``, its
    places sorted.  Batches are cut between values of ``at``; a task holds one
    batch and the texts and places of one of them.
    """
    texts = docs.select("at", F.lit(-1).alias("pos"), "row", "doc_id", "text")
    nothing = [F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in ("row", "doc_id", "text")]
    both = texts.unionByName(places.select("at", "pos", *nothing))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def finished(table: pa.Table) -> Iterator[pa.RecordBatch]:
            at, pos = table.column("at").to_numpy(), table.column("pos").to_numpy()
            own = np.flatnonzero(pos < 0)
            rows, docs_, texts_ = (table.column(c).take(pa.array(own)).to_pylist() for c in ("row", "doc_id", "text"))
            start = _starts(at)
            end = np.r_[start[1:], len(at)]
            group = np.searchsorted(start, own, side="right") - 1
            begin = start + np.bincount(group, minlength=len(start))    # texts come before places
            yield from work([(rows[i], docs_[i], texts_[i], pos[begin[g]:end[g]]) for i, g in enumerate(group)])

        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.column("at").to_numpy()
            cut = int(_starts(at)[-1])
            if held and (cut or held[-1].column("at")[0].as_py() != at[0]):
                yield from finished(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            elif cut:
                yield from finished(pa.Table.from_batches([batch.slice(0, cut)]))
            held.append(batch.slice(cut))
        if held:
            yield from finished(pa.Table.from_batches(held))

    return both.repartition("at").sortWithinPartitions("at", "pos").mapInArrow(run, schema)


def _text_slices(groups: list, limit: int = 2 << 20) -> Iterator[list]:
    part, size = [], 0
    for g in groups:
        part.append(g)
        size += len(g[2])
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part


def _windows(window: int, block: int):
    """The fingerprint of every window that holds a hit."""
    def work(groups: list) -> Iterator[pa.RecordBatch]:
        for part in _text_slices(groups):
            words = words_of(pa.array([g[2] for g in part], pa.string()))
            key, at = words.windows(window)
            if not len(at):
                continue
            hit = np.zeros(len(words.hashes) + 1, np.int64)
            for i, g in enumerate(part):
                hit[words.bounds[i] + g[3][g[3] < words.bounds[i + 1] - words.bounds[i]] + 1] = 1
            before = np.cumsum(hit)
            near = before[at + window - block + 1] > before[at]
            key, at = key[near], at[near]
            owner, pos = _local(words, at)
            row, doc = (np.array([g[j] for g in part], np.int64)[owner] for j in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(doc), pa.array(row),
                                              pa.array(pos.astype(np.int32))], names=["key", "doc", "row", "pos"])
    return work


def _repeats(windows: DataFrame) -> DataFrame:
    """Windows that also start in a text with a smaller id: in order of id, all but those of a key's first text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, smallest = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, doc = batch.column("key").to_numpy(), batch.column("doc").to_numpy()
            start = _starts(key)
            first = doc[start].copy()
            if key[0] == last:
                first[0] = smallest
            last, smallest = key[-1], first[-1]
            again = doc > np.repeat(first, np.diff(start, append=len(key)))
            if again.any():
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(again)) for c in ("row", "pos")], names=["at", "pos"])

    return (windows.repartition("key").sortWithinPartitions("key", "doc")
            .mapInArrow(run, "at long, pos int"))


def _covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of ``n`` words are in a window that begins at one of these places."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + window, n), -1)
    return np.cumsum(edge[:n]) > 0


def _kept(window: int):
    names = ["doc_id", "n_words", "n_removed", "spans", "kept_text"]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def work(groups: list) -> Iterator[pa.RecordBatch]:
        for part in _text_slices(groups):
            out: list[list] = [[] for _ in names]
            for _, doc, text, starts in part:
                words = text.encode().split()
                gone = _covered(len(words), starts, window)
                edges = np.flatnonzero(np.diff(np.r_[0, gone, 0])).reshape(-1, 2)
                kept = b" ".join([words[i] for i in np.flatnonzero(~gone)]).decode()
                values = (doc, len(words), int(gone.sum()), [{"start": int(a), "end": int(b)} for a, b in edges], kept)
                for column, value in zip(out, values):
                    column.append(value)
            arrays = [*(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], kind),
                      pa.array(out[4], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "doc_id long, n_words long, n_removed long, spans array<struct<start: long, end: long>>, kept_text string"
    return work, schema


def repeated_windows(docs: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """(at, pos): every window of ``docs`` (``row, doc_id, text``) that also starts in a text with a smaller id; ``at`` is its ``row``."""
    known = docs.where("doc_id IS NOT NULL")
    blocks = known.select("doc_id", "text").mapInArrow(_blocks(window, block), "key long, doc long, high int")
    hits = materialise(_hits(blocks), "substring-hits")
    ids = hits.select("at").distinct()
    texts = known.where(filter_of(ids, ids.count()).test(F.col("doc_id"))).withColumn("at", F.col("doc_id"))
    windows = _with_texts(texts, hits, _windows(window, block), "key long, doc long, row long, pos int")
    return materialise(_repeats(windows), "substring-repeats")


def remove_repeats(docs: DataFrame, window: int = WINDOW, block: int = BLOCK, id_col: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """Cut every word that a repeated window covers.

    Columns: ``doc_id, n_words, n_removed, spans, kept_text``; one row for each row
    of ``docs``.  ``spans`` are the maximal runs of removed words (from, to; the end
    is not in it), ``kept_text`` the other words, unchanged, joined by one space.
    A window is ``window`` consecutive words of one whole text; it is repeated if
    its words also start somewhere in a text with a smaller id.  Windows are judged
    on the input.  Null counts as empty; texts with fewer words keep them all.  A
    row with a null id (ids are whole numbers) is before or after no other: it loses nothing and takes
    nothing.  Rows of equal ids do not count as smaller; rows that repeat both id
    and text fare alike.  Other columns are not read.  ``block`` may be at most
    half of ``window + 1``.  An empty table gives an empty result.
    """
    if 2 * block > window + 1:
        raise ValueError("a window must hold a whole block at any offset")
    docs = docs.select(_row(id_col, text).alias("row"), F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))
    repeats = repeated_windows(docs, window, block)
    rows = repeats.select("at").distinct()
    touched = F.col("doc_id").isNotNull() & filter_of(rows, rows.count()).test(F.col("row"))
    marked = docs.withColumn("_touched", touched)
    work, schema = _kept(window)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            none = np.zeros(0, np.int64)
            yield from work([(0, d, t, none) for d, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist())])

    untouched = marked.where(~F.col("_touched")).select("doc_id", "text").mapInArrow(whole, schema)
    return untouched.unionByName(_with_texts(marked.where("_touched").withColumn("at", F.col("row")), repeats, work, schema))
