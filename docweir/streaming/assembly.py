"""Keyed state with a life time: documents whose lines arrive in pieces (ST1), and the progress of jobs (ST8)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# State stores with several column families and timers need this provider.
STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER_CONF = "spark.sql.streaming.stateStore.providerClass"


#: Groups that documents are dealt to by hash: a call of a group costs milliseconds however few lines it brings.
GROUPS = 1 << 14


class _Assembly(StatefulProcessor):
    """Keeps the lines of the open documents of one group; no document's lines outlive it or its timer."""

    def __init__(self, wait_ms: int, id_type: str):
        self._wait_ms, self._id_type = wait_ms, id_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._held = handle.getValueState("held", f"ids array<{self._id_type}>, n_lines array<bigint>, last array<bigint>, due array<bigint>, "
                                                  "sizes array<bigint>, numbers array<bigint>, texts array<string>")

    def _open(self) -> dict:
        """Open documents: id to [n_lines, time of the latest line, when the timer goes off, lines]."""
        if not self._held.exists():
            return {}
        ids, n_lines, last, due, sizes, numbers, texts = self._held.get()
        docs, at = {}, 0
        for doc, n, ms, when, size in zip(ids, n_lines, last, due, sizes):
            docs[doc] = [n, ms, when, dict(zip(numbers[at:at + size], texts[at:at + size]))]
            at += size
        return docs

    def _keep(self, docs: dict) -> None:
        """One timer for a group, at the earliest time that one of its documents is due."""
        if not docs:
            self._held.clear()
            return
        lines = [d[3] for d in docs.values()]
        self._held.update((list(docs), *[[d[k] for d in docs.values()] for k in range(3)], [len(x) for x in lines],
                           [n for x in lines for n in x], [t for x in lines for t in x.values()]))
        self._handle.registerTimer(min(d[2] for d in docs.values()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        docs, seen, mark = self._open(), {}, timerValues.getCurrentWatermarkInMs()
        for part in rows:
            told = [-1 if n != n or n is None else int(n) for n in part["n_lines"].tolist()]
            for ms, line_no, doc, n, text in sorted(zip(part["ms"].tolist(), part["line_no"].tolist(), part["doc_id"].tolist(), told,
                                                        part["text"].tolist()), key=lambda x: x[:2]):
                d = docs.get(doc)
                if d is None:
                    d = docs[doc] = [-1, 0, 0, {}]
                seen[doc] = d
                d[0] = max(d[0], n)
                if ms > d[1] or not d[2]:
                    d[1] = max(d[1], ms)
                    d[2] = max(d[1], mark) + self._wait_ms
                d[3][int(line_no)] = None if text is None or text != text else str(text)
        whole = {doc: docs.pop(doc) for doc, d in seen.items() if 0 <= d[0] <= len(d[3])}
        self._keep(docs)
        if whole:
            yield self._told(whole, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Timers of earlier batches go off too; only documents that are due by then are given out."""
        docs, now = self._open(), expiredTimerInfo.getExpiryTimeInMs()
        due = {doc: docs.pop(doc) for doc, d in list(docs.items()) if d[2] <= max(now, timerValues.getCurrentWatermarkInMs())}
        if due:
            self._keep(docs)
            yield self._told(due, False)

    def _told(self, docs: dict, whole: bool) -> pd.DataFrame:
        out = [(doc, n, d[3][n]) for doc, d in docs.items() for n in sorted(d[3])]
        return pd.DataFrame({"doc_id": [x[0] for x in out], "line_no": [x[1] for x in out], "text": [x[2] for x in out], "whole": [whole] * len(out)})

    def close(self) -> None:
        pass


def whole_documents(lines: DataFrame, wait: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Stream of (doc_id, line_no, text, whole), all lines of a document at once.

    ``lines``: doc_id, line_no, text, ts, and n_lines, the number of lines of the
    document, null until some line (an end marker, say) tells it.  A document is
    given out when it has all its lines, in whatever order and batches they came.
    If nothing of it arrives for ``wait`` of event time, what there is is given out
    with ``whole`` false and forgotten.  A line that comes twice counts once, the
    later text stands.  Lines without a document, number or time are dropped, and
    so are those that come more than ``delay`` behind the newest line.

    Documents are dealt by hash to ``GROUPS`` groups, whose open documents share a state.
    """
    wait_ms = _millis(lines.sparkSession, wait)
    usable = lines.where("doc_id IS NOT NULL AND line_no IS NOT NULL AND ts IS NOT NULL").select(
        "doc_id", F.col("line_no").cast("long").alias("line_no"), "text", F.col("n_lines").cast("long").alias("n_lines"), "ts",
        F.unix_millis("ts").alias("ms")).withWatermark("ts", delay)
    id_type = lines.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {id_type}, line_no long, text string, whole boolean"
    dealt = usable.withColumn("_group", F.pmod(F.xxhash64("doc_id"), F.lit(GROUPS)).cast("int"))
    return dealt.groupBy("_group").transformWithStateInPandas(
        _Assembly(wait_ms, id_type), outputStructType=shape, outputMode="Append", timeMode="EventTime")


def _millis(spark: SparkSession, wait: str) -> int:
    """An interval in milliseconds; also turns to the state provider that timers need."""
    spark.conf.set(_PROVIDER_CONF, STATE_PROVIDER)
    return int(spark.sql(f"SELECT unix_millis(timestamp_millis(0) + INTERVAL {wait})").first()[0])


class _Progress(StatefulProcessor):
    """Keeps the latest status of an open job; a job that ends or falls silent leaves the store."""

    def __init__(self, wait_ms: int, terminal: list[str]):
        self._wait_ms, self._terminal = wait_ms, set(terminal)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._latest = handle.getValueState("latest", "ms long, seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for part in rows:
            for x in zip(part["ms"], part["seq"], part["status"], part["ts"]):
                if best is None or x[:2] > best[:2]:
                    best = x
        known = tuple(self._latest.get()) if self._latest.exists() else None
        if known is not None and known >= tuple(int(x) for x in best[:2]):
            return
        terminal = best[2] in self._terminal
        if terminal:
            self._latest.clear()
        else:
            self._latest.update((int(best[0]), int(best[1])))
            self._handle.registerTimer(max(int(best[0]), timerValues.getCurrentWatermarkInMs()) + self._wait_ms)
        yield pd.DataFrame({"job_id": [key[0]], "status": [best[2]], "ts": [best[3]], "seq": [int(best[1])], "terminal": [terminal]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self._latest.exists() and self._latest.get()[0] + self._wait_ms <= expiredTimerInfo.getExpiryTimeInMs():
            self._latest.clear()
        return iter(())

    def close(self) -> None:
        pass


def job_progress(statuses: DataFrame, terminal: list[str], wait: str = "1 day", delay: str = "10 minutes") -> DataFrame:
    """Stream of (job_id, status, ts, seq, terminal): a row whenever a batch brings a later status of a job; for update mode.

    ``statuses``: job_id, status, ts, seq.  Only open jobs are in the state, and those
    only until nothing was heard of them for ``wait``; readers take the row of largest
    (ts, seq), so a status that comes late to a job that has left does no harm.
    """
    wait_ms = _millis(statuses.sparkSession, wait)
    usable = statuses.where("job_id IS NOT NULL AND ts IS NOT NULL").select(
        "job_id", "status", "ts", F.coalesce(F.col("seq").cast("long"), F.lit(0)).alias("seq"), F.unix_millis("ts").alias("ms")).withWatermark("ts", delay)
    shape = f"job_id {statuses.schema['job_id'].dataType.simpleString()}, status string, ts timestamp, seq long, terminal boolean"
    return usable.groupBy("job_id").transformWithStateInPandas(
        _Progress(wait_ms, terminal), outputStructType=shape, outputMode="Update", timeMode="EventTime")
