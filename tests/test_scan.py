"""Ordered scans with null and repeated keys and times, against a plain loop."""

import datetime as dt
import itertools
import random

import pytest

from docweir.operators import folds, routing, scan


def _rows():
    rng = random.Random(6)
    start = dt.datetime(2024, 1, 1)
    out = []
    for i in range(400):
        ts = None if rng.random() < 0.1 else start + dt.timedelta(seconds=rng.randrange(0, 4000))
        out.append((i // 2, ts, rng.choice([None, "a", "b"]), rng.choice(["ok", "unavailable", "unavailable", "rate_limited", "bad_request"]),
                    rng.choice([None, None, 7.0])))
    for i in range(40):    # a run of failures that goes on far beyond the back-off limit
        out.append((1000 + i, start + dt.timedelta(hours=2, seconds=i), "c", "unavailable", None))
    return out


@pytest.fixture(scope="module")
def calls(spark):
    return spark.createDataFrame(_rows(), "call_id long, ts timestamp, key_id string, outcome string, retry_after double")


def _in_order(rows):
    return sorted(rows, key=lambda r: (r["_part"], r["_at"]))


def test_running_total_keeps_every_row(spark, calls):
    from pyspark.sql import functions as F
    got = scan.running_total(calls.withColumn("one", F.lit(1)), ["key_id"], ["ts", "call_id"], "one", "before").collect()
    assert len(got) == 440
    for key, rows in itertools.groupby(sorted(_in_order(got), key=lambda r: r.key_id or ""), key=lambda r: r.key_id or ""):
        assert [r.before for r in rows] == list(range(sum((r.key_id or "") == key for r in got)))


def _plain_health(rows):
    """(call_id, ts, failures, state) of one key's calls in order, as a key pool would record them."""
    out, count, last = [], 0, None
    for r in rows:
        if last is not None and last.outcome not in ("ok", "invalid_key") and None not in (r.ts, last.ts):
            wait = {"rate_limited": last.retry_after or 30, "quota": 3600}.get(last.outcome, min(2 ** min(count, 9), 300))
            if (r.ts - last.ts).total_seconds() >= wait:
                count = 0
        count = 0 if r.outcome == "ok" else count + (r.outcome != "bad_request")
        if r.outcome != "bad_request":
            last = r
        names = {"invalid_key": "invalid", "quota": "quota_exhausted", "rate_limited": "rate_limited", "unavailable": "cooling"}
        out.append((r.call_id, r.ts, count, names.get(last.outcome, "healthy") if last and count else "healthy"))
    return out


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_key_health_is_a_sequential_fold(spark, calls, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        # Ids are made unique, so that the order is one and only.
        rows = spark.createDataFrame([(n, *r[1:]) for n, r in enumerate(_rows())], calls.schema)
        got = routing.key_health(rows).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    want = []
    for key in (None, "a", "b", "c"):
        own = [r for r in got if r.key_id == key]
        want += _plain_health(sorted(own, key=lambda r: (r.ts is not None, r.ts, r.call_id)))
    assert sorted(map(repr, ((r.call_id, r.ts, r.failures, r.state) for r in got))) == sorted(map(repr, want))
    assert len(got) == 440 and max(w[2] for w in want) == 40


def test_pieces_chain_from_any_start():
    """What a piece tells about itself, applied to any state, is the fold over its calls."""
    rng = random.Random(12)
    for machine in (routing.HEALTH_MACHINE, routing.BREAKER_MACHINE):
        for _ in range(1500):
            calls, now = [], 0
            for _ in range(rng.randrange(0, 9)):
                now += rng.choice([1, 2, 30, 31, 119, 121, 300, 3600, 5000]) * 1_000_000
                calls.append(folds.Call(rng.choice(["ok", "bad_request", "quota", "rate_limited", "invalid_key"] + ["unavailable"] * 6),
                                        None if rng.random() < 0.1 else now, rng.choice([None, 0.0, 40.0])))
            piece = folds.Piece(machine)
            for c in calls:
                piece.add(c)
            for count in (*range(12), 40):
                last = rng.choice([None, folds.Call(rng.choice(["ok", "unavailable", "quota", "rate_limited"]), rng.choice([None, 0]), 7.0)])
                state = folds.State(count, last)
                want = state
                for c in calls:
                    want = machine.step(want, c)
                assert piece.apply(state) == want


