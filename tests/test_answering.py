"""Paid answers: every call once, whatever fails, and every request answered, refused or told of."""

from __future__ import annotations

import collections
import json
import os
import types

import pytest
from pyspark.sql import functions as F

from docweir.plans import answering

def now():
    return F.lit("2024-02-01").cast("timestamp")


@pytest.fixture
def paid(tmp_path):
    """A completion function that writes down each call it is paid for, and the list of those calls."""
    book = f"{tmp_path}/book"
    os.makedirs(book)

    def complete(call):
        with open(f"{book}/{os.getpid()}", "a") as f:
            f.write(json.dumps(call["call_id"]) + "\n")
        if call.get("hint") == "error":
            raise ValueError("provider said no")
        if call.get("hint") == "crash" and os.path.exists(f"{book}/crashing"):
            os._exit(9)
        return {"reply": f"r:{call.get('user_text')}", "tokens_in": 3, "tokens_out": 2, "cost_micros": 10}

    def made():
        return collections.Counter(json.loads(x) for n in os.listdir(book) if n != "crashing" for x in open(f"{book}/{n}"))
    complete.book = book
    return complete, made


def calls(spark, rows):
    return spark.createDataFrame(rows, "call_id string, hint string")


def test_a_repeated_run_makes_no_call_twice(spark, tmp_path, paid):
    complete, made = paid
    ledger = answering.CallLedger(spark, f"{tmp_path}/ledger")
    rows = calls(spark, [(f"c{k}", "crash" if k == 7 else "error" if k == 3 else None) for k in range(20)])
    open(f"{complete.book}/crashing", "w").close()
    with pytest.raises(Exception):
        ledger.pay(rows, complete, tasks=2).collect()
    os.remove(f"{complete.book}/crashing")
    before = made()
    assert max(before.values()) == 1 and before["c7"] == 1
    found = {r.call_id: r.outcome for r in ledger.pay(rows, complete, tasks=3).collect()}
    after = made()
    assert found == {f"c{k}": "unknown" if k == 7 else "failed" if k == 3 else "ok" for k in range(20)}
    assert all(n == 1 for c, n in after.items() if c != "c3"), "only a call that failed is made again"
    again = answering.CallLedger(spark, f"{tmp_path}/ledger", repeat_unknown=True)
    assert {r.outcome for r in again.pay(rows.where("call_id <> 'c3'"), complete).collect()} == {"ok"}
    assert made()["c7"] == 2 and sum(made().values()) - sum(after.values()) == 1


def test_speculation_is_refused():
    session = types.SimpleNamespace(conf={"spark.speculation": "true"})
    with pytest.raises(ValueError):
        answering.CallLedger(session, "/nowhere")


def dimensions(spark):
    providers = spark.createDataFrame([("cheap", "m1", 0, False, False, False, False), ("safe", "m2", 1, True, False, False, False)],
                                      "provider string, model string, pref int, allows_real_pii boolean, supports_vision boolean, "
                                      "data_used_for_training boolean, breaker_open boolean")
    prompts = spark.createDataFrame([("id_visual_zone", 1, "read"), ("id_visual_zone", 2, "read well")], "name string, version int, text string")
    return prompts, providers


def test_requests_are_answered_once_or_refused(spark, tmp_path, paid):
    complete, made = paid
    prompts, providers = dimensions(spark)
    rows = [(1, 0, ["a"], False, False), (2, 0, ["a"], False, False), (3, 0, ["a"], True, False), (4, 0, ["a"], None, False),
            (5, 0, ["a"], False, True), (6, 0, ["a"], False, False), (7, 0, ["b"], False, False), (1, 1, ["b"], False, False)]
    requests = spark.createDataFrame(rows, "doc_id long, request int, fields array<string>, contains_real_pii boolean, has_images boolean")
    texts = spark.createDataFrame([(1, "same"), (2, "same"), (3, "real"), (4, "who knows"), (5, "picture"), (6, "id 12345678901234"), (7, "other")],
                                  "doc_id long, text string")
    ledger = answering.CallLedger(spark, f"{tmp_path}/ledger")
    out = answering.answer(requests, texts, prompts, providers, complete, ledger, now())
    replies = {(r.doc_id, r.request): (r.reply, r.cost_micros) for r in out.replies.collect()}
    assert replies == {(1, 0): ("r:same", 10), (2, 0): ("r:same", 0), (3, 0): ("r:real", 10), (4, 0): ("r:who knows", 10),
                       (7, 0): ("r:other", 10), (1, 1): ("r:same", 10)}
    assert sum(made().values()) == 5
    refused = {r.doc_id: r.reason for r in out.refused.collect()}
    assert refused[5] == answering.NO_PROVIDER and refused[6].startswith("marked synthetic but looks real") and len(refused) == 2
    usage = out.usage.collect()
    assert len(usage) == 5 and {u.prompt_version for u in usage} == {"id_visual_zone.v2"} and sum(u.cost_micros for u in usage) == 50

    # The same requests later: the ledger answers, and what a cache holds is not even looked up there.
    key = next(u.call_id for u in usage)
    cache = spark.createDataFrame([(key, '{"from": "cache"}'), ("stale", "{}")], "cache_key string, value string").withColumn(
        "expires_at", F.lit("2024-03-01").cast("timestamp"))
    later = answering.answer(requests, texts, prompts, providers, complete, ledger, now(), cache=cache)
    assert sum(made().values()) == 5
    assert sorted(u.cache_hit for u in later.usage.collect()) == [False] * 4 + [True]
    assert {r.reply for r in later.replies.collect()} >= {'{"from": "cache"}'}


def test_budget_and_failed_calls(spark, tmp_path, paid):
    complete, made = paid
    prompts, providers = dimensions(spark)
    requests = spark.createDataFrame([(k, 0, ["a"], True, "error" if k == 0 else None) for k in range(12)],
                                     "doc_id long, request int, fields array<string>, contains_real_pii boolean, hint string")
    texts = spark.createDataFrame([(k, f"t{k}") for k in range(12)], "doc_id long, text string")
    out = answering.answer(requests, texts, prompts, providers, complete, answering.CallLedger(spark, f"{tmp_path}/ledger"), now(),
                           budget_micros=50, price=F.lit(10))
    reasons = collections.Counter(r.reason for r in out.refused.collect())
    assert reasons[answering.OVER_BUDGET] == 7 and sum(made().values()) == 5
    assert out.replies.count() + sum(reasons.values()) == 12
    empty = answering.answer(requests.limit(0), texts, prompts, providers, complete, answering.CallLedger(spark, f"{tmp_path}/l2"), now())
    assert empty.replies.count() == empty.usage.count() == empty.refused.count() == 0
