"""Documents that arrive line by line: whole ones once, the rest by the timer, and no state left behind."""

from __future__ import annotations

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from catalog import inputs as i
from docweir.streaming import assembly, jobs

START = dt.datetime(2024, 1, 1)
SCHEMA = "doc_id long, line_no int, text string, n_lines int, ts timestamp"


@pytest.fixture
def piecewise(spark, tmp_path):
    """Runs one batch after another through a job, restarting it each time, and returns the newest progress."""
    src, cp = f"{tmp_path}/src", f"{tmp_path}/cp"
    os.makedirs(src)

    def feed(rows, start):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        query = start(spark.readStream.schema(SCHEMA).parquet(src), cp)
        query.awaitTermination()
        return query.lastProgress["stateOperators"][0]["numRowsTotal"]
    return feed


def line(doc, no, minutes, of=None, text=None):
    return (doc, no, text or f"{doc}/{no}", of, START + dt.timedelta(minutes=minutes))


def test_each_line_in_a_batch_of_its_own(spark, tmp_path, piecewise):
    out = f"{tmp_path}/out"

    def start(stream, cp):
        return jobs.write_batches(assembly.whole_documents(stream), out, cp)

    assert piecewise([line(1, 2, 0), line(2, 1, 0), (None, 1, "x", None, START), (5, None, "x", 1, START)], start) == 2
    assert piecewise([line(1, 2, 1, text="later text"), line(1, 1, 1)], start) == 2
    assert piecewise([line(1, 3, 2, of=3), line(3, 1, 2, of=1)], start) == 1, "whole documents leave the state"
    assert piecewise([line(2, 2, 50)], start) == 1, "a new line puts the timer off"
    assert piecewise([line(9, 1, 115, of=1)], start) == 1, "an earlier timer does not count"
    assert piecewise([line(9, 1, 300, of=1)], start) == 0
    got = {(r.doc_id, r.line_no): (r.text, r.whole) for r in jobs.read_batches(spark, out).collect()}
    assert got == {(1, 1): ("1/1", True), (1, 2): ("later text", True), (1, 3): ("1/3", True), (3, 1): ("3/1", True),
                   (9, 1): ("9/1", True), (2, 1): ("2/1", False), (2, 2): ("2/2", False)}


def test_fields_do_not_depend_on_batches(spark, tmp_path, piecewise):
    lines = i.ocr_lines(spark, "/root/testdata/sf0.001").where("doc_id < 12").select("doc_id", "line_no", "text")
    rows = [tuple(r) for r in lines.collect()]
    most = {}
    for doc, no, _ in rows:
        most[doc] = max(no, most.get(doc, 0))
    out, today = f"{tmp_path}/out", i.today()

    def start(stream, cp):
        return jobs.stream_extract(stream, out, cp, today)

    for piece in range(3):
        batch = [(d, n, t, most[d] if n == most[d] else None, START + dt.timedelta(seconds=n)) for d, n, t in rows if n % 3 == piece]
        left = piecewise(batch, start)
    assert left == 0
    spark.createDataFrame(rows, lines.schema).write.parquet(f"{tmp_path}/whole")
    jobs.stream_extract(spark.readStream.schema(lines.schema).parquet(f"{tmp_path}/whole"), f"{tmp_path}/out2", f"{tmp_path}/cp2",
                        today).awaitTermination()
    a, b = ({(r.doc_id, r.path, r.value, r.confidence) for r in jobs.read_batches(spark, o).collect()} for o in (out, f"{tmp_path}/out2"))
    assert a and a == b


def test_state_of_jobs_stays_flat(spark, tmp_path):
    """A hundred batches of new jobs, most of which end, some of which fall silent; results read with and without a summary."""
    src, out, cp = (f"{tmp_path}/{x}" for x in ("src", "out", "cp"))
    os.makedirs(src)
    schema, rows = "job_id long, status string, ts timestamp, seq long", []
    for k in range(100):
        at = START + dt.timedelta(hours=k)
        new = [(10 * k + j, "extracting", at + dt.timedelta(seconds=j), 0) for j in range(4)]
        new += [(10 * k + j, "ok", at + dt.timedelta(seconds=30), 1) for j in range(3)] + [(10 * k, "extracting", at, 0), (None, "ok", at, 0)]
        rows += new
        path = f"{src}/{k:03d}.json"
        with open(path, "w") as f:
            f.writelines(json.dumps({"job_id": j, "status": s, "ts": t.isoformat(), "seq": q}) + "\n" for j, s, t, q in new)
        os.utime(path, (1_600_000_000 + k, 1_600_000_000 + k))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(src)
        sizes = []
        query = jobs.write_batches(jobs.job_progress(stream, wait="5 hours"), out, cp, mode="update")
        query.awaitTermination()
        sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len(sizes) >= 99 and max(sizes) <= 16, sizes
    want = {}
    for j, s, t, q in rows:
        if j is not None and (t, q) >= want.get(j, (dt.datetime.min, 0))[:2]:
            want[j] = (t, q, s)
    plain = {r.job_id: (r.ts, r.seq, r.status) for r in jobs.latest_of_batches(spark, out, "job_id", ["ts", "seq"]).collect()}
    assert plain == want
    jobs.sum_up(spark, out, "job_id", ["ts", "seq"])
    last = jobs.latest_of_batches(spark, out, "job_id", ["ts", "seq"])
    assert {r.job_id: (r.ts, r.seq, r.status) for r in last.collect()} == want
    assert "batch_id=" not in " ".join(last.inputFiles())


def test_machines_continue_and_repeat(spark, tmp_path):
    """Three batches, the last of them run twice: the same counts as one fold over all calls."""
    from docweir.operators import routing
    schema = "call_id long, ts timestamp, key_id string, provider string, outcome string, retry_after double"
    kinds = ["unavailable", "bad_request", "rate_limited", "ok", "unavailable", "quota", "invalid_key", "unavailable"]
    rows = [(n, START + dt.timedelta(seconds=n * (1 + n % 40)) if n % 17 else None, f"k{n % 3}" if n % 11 else None, "p", kinds[n % 8 if n % 5 else 0], 3.0 if n % 2 else 0.0)
            for n in range(240)]
    rows.sort(key=lambda r: (r[1] is not None, r[1]))
    # Rows without a time come first in the fold of all, so the first batch has them.
    out = f"{tmp_path}/out"
    for batch, (a, b) in enumerate(((0, 90), (90, 91), (91, 240), (91, 240))):
        number = min(batch, 2)
        src = f"{tmp_path}/src{batch}"
        spark.createDataFrame(rows[a:b], schema).write.parquet(src)
        held = []

        class Once:
            """Stands for a stream of one batch with a given number."""
            writeStream = property(lambda self: self)

            def foreachBatch(self, sink):
                held.append(sink)
                return self

            def __getattr__(self, name):
                return lambda *a, **k: self
        jobs.stream_key_health(Once(), out, f"{tmp_path}/cp")
        held[0](spark.read.parquet(src), number)
    got = {r.call_id: (r.failures, r.state) for r in jobs.read_batches(spark, out).collect()}
    want = {r.call_id: (r.failures, r.state) for r in routing.key_health(spark.createDataFrame(rows, schema)).collect()}
    assert got == want and len(got) == 240


def test_many_documents_share_few_calls(spark, tmp_path, monkeypatch):
    """The state has at most one row for each group, with documents of one group finished, open and timed out apart."""
    monkeypatch.setattr(assembly, "GROUPS", 2)
    src, out, cp = (f"{tmp_path}/{x}" for x in ("src", "out", "cp"))
    os.makedirs(src)

    def feed(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        query = jobs.write_batches(assembly.whole_documents(spark.readStream.schema(SCHEMA).parquet(src)), out, cp)
        query.awaitTermination()
        return query.lastProgress["stateOperators"][0]["numRowsTotal"]

    assert feed([line(d, 1, d) for d in range(40)]) == 2
    assert feed([line(d, 2, 40, of=2) for d in range(0, 40, 2)]) == 2
    assert feed([line(99, 1, 90, of=1)]) == 2, "documents fall due one after another"
    assert feed([line(99, 1, 500, of=1)]) == 0
    got = {}
    for r in jobs.read_batches(spark, out).where("doc_id < 40").collect():
        got.setdefault(r.doc_id, []).append((r.line_no, r.text, r.whole))
    assert {d: sorted(x) for d, x in got.items()} == {d: [(1, f"{d}/1", d % 2 == 0)] + [(2, f"{d}/2", True)] * (d % 2 == 0) for d in range(40)}
