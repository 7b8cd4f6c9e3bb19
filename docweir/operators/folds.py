"""Counts of failures folded in time order, block by block (W12, ST5, ST6).

Calls are range-partitioned on (key, time) once and written.  A first pass reads
each part in order and reduces it to what it does to a count it does not know yet;
only a part's first key can have begun in an earlier part, so there are at most two
such rows for each piece of a part.  The driver runs over those in order; a second
pass replays every part from its start.  A hot key is just many parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

from docweir.operators import scan

#: Counts from here on are forgotten alike, whatever the machine.
ALIKE = 9
_CARRY = "@carried"


class Call(NamedTuple):
    kind: str | None
    micros: int | None
    retry_after: float | None
    count: int | None = None    # of a carried row


class State(NamedTuple):
    count: int = 0
    last: Call | None = None    # the last call that bears on the key


class Machine(NamedTuple):
    """When a count is forgotten before a call, and which outcomes leave the key as it is.

    ``wait(last, count)`` gives the seconds after which the count is forgotten, or
    None for never; it is the same for every count of ``ALIKE`` or more.
    """
    wait: Callable[[Call, int], float | None]
    ignored: frozenset[str] = frozenset()

    def step(self, state: State, call: Call) -> State:
        count, last = state
        if call.kind == _CARRY:
            return State(call.count, last)
        if last is not None and last.micros is not None and call.micros is not None:
            wait = self.wait(last, count)
            if wait is not None and call.micros - last.micros >= wait * 1e6:
                count = 0
        if call.kind in self.ignored:
            return State(count, last)
        return State(0 if call.kind == "ok" else count + 1, call)


class Piece:
    """What the rows of one key in one piece of a part do to a state from before them."""

    def __init__(self, machine: Machine, head=(), last=None, table=None, grows: bool = True):
        self._machine, self.head, self.last, self.grows = machine, list(head), last, grows
        self.table = list(table) if table is not None else list(range(ALIKE + 1))

    def add(self, call: Call) -> None:
        ignored = self._machine.ignored
        if self.last is None:
            # Before the first call that bears on the key, only the latest ignored one can matter.
            if self.head and self.head[-1].kind in ignored and call.kind in ignored:
                call = max(self.head.pop(), call, key=lambda c: float("-inf") if c.micros is None else c.micros)
            self.head.append(call)
            if call.kind not in ignored and call.kind != _CARRY:
                self.last = call
            return
        before = self.table
        if len(set(before)) == 1:
            after = self._machine.step(State(before[0], self.last), call)
            self.table = [after.count] * len(before)
        else:
            steps = [self._machine.step(State(c, self.last), call) for c in before]
            self.table, after = [s.count for s in steps], steps[0]
        self.last = after.last
        self.grows = self.grows and self.table[-1] >= before[-1]

    def apply(self, state: State) -> State:
        for call in self.head:
            state = self._machine.step(state, call)
        if self.last is None:
            return state
        over = state.count - ALIKE if self.grows and state.count > ALIKE else 0
        return State(self.table[min(state.count, ALIKE)] + over, self.last)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[object, list[Call], bool]]]]:
    """(place of the first row, rows) of every piece of a part, batch by batch; a piece goes on under the same place.

    A row is its key, its calls and whether it was carried: a carried row stands for
    its last call, if any, and then its count.
    """
    begun = before = None
    for batch in batches:
        keys, places, *rest = (batch.column(c).to_pylist() for c in ("_key", scan.AT, "_kind", "_micros", "_retry", "_count"))
        rows, at = [], 0
        for k, (key, kind, micros, retry, count) in enumerate(zip(keys, *rest)):
            place = places[k]
            if before is None or place != before + 1 or place >> 33 != before >> 33:
                if rows:
                    yield begun, rows
                rows, begun = [], place
            before = place
            calls = [] if count is not None and kind is None else [Call(kind, micros, retry)]
            rows.append((key, calls + ([Call(_CARRY, None, None, count)] if count is not None else []), count is not None))
        if rows:
            yield begun, rows


def fold(calls: DataFrame, key: str, order: list[str], machine: Machine, carry: DataFrame | None = None,
         retry_after: str | None = None) -> DataFrame:
    """``calls`` with ``failures`` after each call and ``in_force``: the last bearing outcome, null if its count is forgotten or there is none.

    Calls of a key go in order of ``ts`` (null first) and the columns ``order``; null
    keys are a key of their own.  ``carry`` (key, kind, ts, retry_after, failures)
    holds the last bearing call and the count of keys from an earlier batch.
    """
    now = calls.select("*", F.lit(1).alias("_rank"), F.col("outcome").alias("_kind"),
                       (F.col(retry_after) if retry_after else F.lit(None)).cast("double").alias("_retry"),
                       F.lit(None).cast("long").alias("_count"))
    if carry is not None:
        blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in calls.schema.fields if f.name not in (key, "ts")]
        now = now.unionByName(carry.select(
            key, *blank, "ts", F.lit(0).alias("_rank"), F.col("kind").alias("_kind"),
            F.col("retry_after").cast("double").alias("_retry"), F.col("failures").cast("long").alias("_count")))
    stamped = now.withColumn("_micros", F.unix_micros(F.col("ts").cast("timestamp")))
    rows = scan.ordered_parts(stamped, [key], ["_rank", "ts", *order]).withColumn("_key", F.col(key))
    call = StructType([StructField("kind", StringType()), StructField("micros", LongType()),
                       StructField("retry_after", DoubleType()), StructField("count", LongType())])
    shape = StructType([StructField("place", LongType()), StructField("nth", LongType()), StructField("key", calls.schema[key].dataType),
                        StructField("head", ArrayType(call)), StructField("last", call), StructField("table", ArrayType(LongType())),
                        StructField("grows", BooleanType())])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        place_of = key_of = piece = None

        def told(nth: int) -> None:
            out.append({"place": place_of, "nth": nth, "key": key_of, "head": [c._asdict() for c in piece.head],
                        "last": piece.last and piece.last._asdict(), "table": piece.table, "grows": piece.grows})
        first = True
        for place, found in _pieces(batches):
            for own, calls_, _ in found:
                if place != place_of or own != key_of:
                    # Of the keys of a piece, the first and the last can go on elsewhere.
                    if piece is not None and (first or place != place_of):
                        told(0 if first else 1)
                    first = place != place_of
                    place_of, key_of, piece = place, own, Piece(machine)
                for c in calls_:
                    piece.add(c)
        if piece is not None:
            told(0 if first else 1)
        yield pa.RecordBatch.from_pylist(out, schema=arrow_shape)

    arrow_shape = to_arrow_schema(shape)
    # At most two short rows for each piece of a part, so their number is that of the tasks that read parts.
    reduced = rows.select("_key", scan.AT, "_kind", "_micros", "_retry", "_count").mapInArrow(reduce, shape).collect()
    starts, known, state = {}, None, State()
    for r in sorted(reduced, key=lambda r: (r["place"], r["nth"])):
        own = Piece(machine, (Call(*c) for c in r["head"]), r["last"] and Call(*r["last"]), r["table"], r["grows"])
        start = state if r["nth"] == 0 and known == (r["key"],) else State()
        if r["nth"] == 0:
            starts[r["place"]] = start
        known, state = (r["key"],), own.apply(start)

    names = calls.columns
    schema = StructType([*calls.schema.fields, StructField("failures", LongType()), StructField("in_force", StringType())])

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place_of, key_of, state = None, None, State()
        held: list[pa.RecordBatch] = []
        counts, forces, stays = [], [], []

        def watched() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held.append(batch)
                yield batch
        for place, found in _pieces(watched()):
            for own, calls_, carried in found:
                if place != place_of:
                    place_of, key_of, state = place, own, starts[place]
                elif own != key_of:
                    key_of, state = own, State()
                for c in calls_:
                    state = machine.step(state, c)
                counts.append(state.count)
                forces.append(state.last.kind if state.count and state.last else None)
                stays.append(not carried)
            if held and len(counts) == held[0].num_rows:
                batch = held.pop()
                columns = [batch.column(c) for c in names] + [pa.array(counts, pa.int64()), pa.array(forces, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names).filter(pa.array(stays, pa.bool_()))
                counts, forces, stays = [], [], []
    return rows.mapInArrow(replay, schema)
