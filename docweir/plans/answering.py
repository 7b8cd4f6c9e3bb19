"""The paid step of the cascade: open requests to replies, usage, cost and refusals.

request -> provider -> policy -> prompt and schema -> cache -> budget -> one call for
each distinct miss -> ledger -> replies.  Everything but the calls is a plan that may
be retried at will.  A call is written to the ledger before it is made and again
when it has answered, by the task that makes it, so a task that runs again reads
what was paid for instead of paying once more.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from docweir.operators import gates, routing, scan, templates
from docweir.session import materialise

#: What a completion function returns, as far as it knows: the reply, tokens and cost.
REPLY = StructType([StructField("call_id", StringType()), StructField("outcome", StringType()), StructField("reply", StringType()),
                    StructField("tokens_in", LongType()), StructField("tokens_out", LongType()),
                    StructField("cost_micros", LongType()), StructField("latency_ms", LongType())])
NO_PROVIDER, OVER_BUDGET = "no provider may serve the request", "budget used up"


class CallLedger:
    """Which calls were begun and which have answered, one small file each in a folder that all executors share.

    A call that was begun and never answered (its worker died in between) may have
    been paid for: it is reported as ``unknown`` and only made again with
    ``repeat_unknown``.  A call that raised an error is ``failed`` and may be made
    again by a later run.  Tasks must not run twice at the same time.
    """

    def __init__(self, spark: SparkSession, path: str, repeat_unknown: bool = False):
        if spark.conf.get("spark.speculation", "false").lower() == "true":
            raise ValueError("paid calls need spark.speculation to be off")
        self.path, self._repeat = path.rstrip("/"), repeat_unknown

    def _file(self, call_id: str, kind: str) -> tuple:
        from pyarrow import fs
        system, base = fs.FileSystem.from_uri(self.path)
        name = hashlib.sha256(call_id.encode()).hexdigest()
        return system, f"{base}/{kind}/{name[:2]}", f"{base}/{kind}/{name[:2]}/{name}.json"

    def _read(self, call_id: str, kind: str) -> dict | None:
        system, _, file = self._file(call_id, kind)
        if not system.get_file_info(file).is_file:
            return None
        with system.open_input_stream(file) as f:
            return json.loads(f.read())

    def _write(self, call_id: str, kind: str, row: dict) -> None:
        system, folder, file = self._file(call_id, kind)
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{file}.part") as f:
            f.write(json.dumps(row).encode())
        system.move(f"{file}.part", file)

    def settle(self, call: dict, complete: Callable[[dict], dict]) -> dict:
        """The reply to one call: from the ledger if it is there, else paid for and written down."""
        call_id = call["call_id"]
        known = self._read(call_id, "replies")
        if known is not None:
            return known
        if not self._repeat and self._read(call_id, "begun") is not None:
            return {"call_id": call_id, "outcome": "unknown"}
        self._write(call_id, "begun", {"call_id": call_id, "at": time.time()})
        start = time.time()
        try:
            row = {"outcome": "ok", **complete(call)}
        except Exception as error:
            system, _, file = self._file(call_id, "begun")
            system.delete_file(file)
            return {"call_id": call_id, "outcome": "failed", "reply": None, "error": str(error)}
        row = {"call_id": call_id, "latency_ms": int(1000 * (time.time() - start)), **row}
        self._write(call_id, "replies", row)
        return row

    def pay(self, calls: DataFrame, complete: Callable[[dict], dict], tasks: int | None = None) -> DataFrame:
        """One row (``REPLY``) for each row of ``calls``, whose ``call_id`` is unique; all their columns go to ``complete``."""
        own, names = self, REPLY.names

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [own.settle(call, complete) for call in batch.to_pylist()]
                yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in rows], schema=shape)

        shape = pa.schema([(f.name, pa.string() if isinstance(f.dataType, StringType) else pa.int64()) for f in REPLY.fields])
        dealt = calls.repartition(tasks, "call_id") if tasks else calls.repartition("call_id")
        return materialise(dealt.mapInArrow(run, REPLY), "paid-replies")


@dataclass(frozen=True)
class Answers:
    """``replies`` (doc_id, request, reply, cost_micros) with one row for each answered request; ``usage`` one row for each
    call made or read from the ledger, and for each cache hit; ``refused`` (doc_id, request, reason)."""
    replies: DataFrame
    usage: DataFrame
    refused: DataFrame


def answer(requests: DataFrame, texts: DataFrame, prompts: DataFrame, providers: DataFrame, complete: Callable[[dict], dict],
           ledger: CallLedger, now: Column, cache: DataFrame | None = None, budget_micros: int | None = None,
           price: Column | None = None, task: str = "text_mapping", tenant: Column | None = None, tasks: int | None = None) -> Answers:
    """Answer ``requests`` (doc_id, request, fields and, if known, doc_type, contains_real_pii, has_images, hint).

    ``texts`` (doc_id, text) is what a request shows; ``providers`` a dimension of
    ``routing.first_provider`` with a ``model``.  A request goes to the most
    preferred provider that may have it, and is refused if there is none or the
    policy forbids it; an unknown ``contains_real_pii`` counts as real.  Equal
    requests share one call.  Of the misses, in the order of their keys, those are
    made that begin within ``budget_micros`` at the estimated ``price`` (micro-dollars,
    over the columns of a call).  A call's cost stands at its smallest request.
    """
    blank = {"doc_type": "string", "contains_real_pii": "boolean", "has_images": "boolean", "hint": "string"}
    asked = requests.withColumns({c: F.lit(None).cast(t) for c, t in blank.items() if c not in requests.columns})
    asked = routing.prompt_for(asked.withColumn("task", F.lit(task)), prompts).withColumnRenamed("text", "_prompt")
    asked = asked.join(texts.select("doc_id", "text"), "doc_id", "left")
    asked = asked.withColumns({
        "request_id": F.concat_ws("/", "doc_id", "request"), "system": F.coalesce("_prompt", F.lit("")),
        "user_text": F.coalesce("text", F.lit("")), "schema": templates.request_schema(F.col("fields"))})
    routed = routing.first_provider(asked, providers)
    none = routed.where("provider IS NULL").select("doc_id", "request", F.coalesce("error", F.lit(NO_PROVIDER)).alias("reason"))
    judged = gates.pii_gate(routed.where("provider IS NOT NULL"), providers)
    judged = judged.withColumn("reason", F.coalesce("error", "reason"))
    models = providers.select("provider", F.col("model") if "model" in providers.columns else F.col("provider").alias("model"))
    payload = F.concat_ws("\n", "system", "schema", "user_text")
    sent = judged.where("reason IS NULL").join(models, "provider").withColumn("cache_key", routing.cache_key(
        F.col("provider"), F.col("model"), F.concat_ws(".v", "name", F.col("version").cast("string")), payload,
        F.lit("-") if tenant is None else tenant))
    sent = materialise(sent.select("doc_id", "request", "cache_key", "provider", "model", "task", "system", "user_text", "schema",
                                   F.concat_ws(".v", "name", F.col("version").cast("string")).alias("prompt_version"), "hint"), "requests")
    refused = none.unionByName(judged.where("reason IS NOT NULL").select("doc_id", "request", "reason"))

    if cache is None:
        looked = sent.withColumns({"value": F.lit(None).cast("string"), "outcome": F.lit("miss")})
    else:
        looked = materialise(routing.cache_lookup(sent, cache, now), "looked-up")
    calls = routing.calls_to_make(looked).drop("value", "outcome").withColumnRenamed("cache_key", "call_id")
    if budget_micros is not None:
        dear = calls.withColumn("_cost", F.coalesce(price if price is not None else F.lit(0), F.lit(0)).cast("long"))
        counted = scan.running_total(dear.withColumn("_all", F.lit(0)), ["_all"], ["call_id"], "_cost", "_before")
        counted = materialise(counted.withColumn("_in", F.col("_before") < budget_micros).drop("_all", "_before", "_cost", scan.PART, scan.AT), "budget")
        calls = counted.where("_in").drop("_in")
        late = counted.where("NOT _in").select(F.col("call_id").alias("cache_key"))
        refused = refused.unionByName(looked.where("outcome = 'miss'").join(late, "cache_key", "left_semi").select(
            "doc_id", "request", F.lit(OVER_BUDGET).alias("reason")))
    paid = ledger.pay(calls, complete, tasks)

    answered = paid.where("outcome = 'ok'").select(F.col("call_id").alias("cache_key"), F.col("reply"), "cost_micros")
    first = looked.where("outcome = 'miss'").groupBy("cache_key").agg(F.min(F.struct("doc_id", "request")).alias("_first"))
    new = looked.where("outcome = 'miss'").join(answered.join(first, "cache_key"), "cache_key").select(
        "doc_id", "request", "reply", F.when(F.struct("doc_id", "request") == F.col("_first"), F.coalesce("cost_micros", F.lit(0)))
        .otherwise(0).cast("long").alias("cost_micros"))
    hits = looked.where("outcome = 'hit'").select("doc_id", "request", F.col("value").alias("reply"), F.lit(0).cast("long").alias("cost_micros"))
    made = calls.select("call_id", "provider", "model", "task", "prompt_version").join(paid.drop("reply"), "call_id").withColumn(
        "cache_hit", F.lit(False))
    free = looked.where("outcome = 'hit'").select(
        F.col("cache_key").alias("call_id"), "provider", "model", "task", "prompt_version", F.lit("ok").alias("outcome"),
        *[F.lit(0).cast("long").alias(c) for c in ("tokens_in", "tokens_out", "cost_micros", "latency_ms")], F.lit(True).alias("cache_hit"))
    failed = looked.where("outcome = 'miss'").join(paid.where("outcome <> 'ok'").select(
        F.col("call_id").alias("cache_key"), F.concat(F.lit("call "), "outcome").alias("reason")), "cache_key").select("doc_id", "request", "reason")
    return Answers(new.unionByName(hits), made.unionByName(free), refused.unionByName(failed))

