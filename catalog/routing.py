"""Queries over provider policy, cache, budgets, usage, prompts, and key health."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs as i
from catalog.ctes import sql
from catalog.registry import register
from catalog.scalars import collapse
from docweir.operators import gates, routing

# --- personal-data signals and gate -------------------------------------------------

_spec = "regexp_matches({0}, '(^|[^A-Za-z0-9])(" + "|".join(gates.SPECIMENS) + ")([^A-Za-z0-9]|$)')"


def signals_sql(e: str) -> str:
    return (f"CASE WHEN {_spec.format(e)} THEN [] ELSE list_filter(["
            f"CASE WHEN regexp_matches({e}, '\\b\\d{{14}}\\b') THEN '14-digit identifier (PINFL pattern)' END, "
            f"CASE WHEN regexp_matches({e}, '\\b[A-Z]{{2}}\\s?\\d{{7}}\\b') THEN 'document number pattern' END, "
            f"CASE WHEN regexp_matches({e}, 'P<[A-Z]{{3}}[A-Z<]{{10,}}') THEN 'passport MRZ header' "
            f"WHEN len(regexp_extract_all({e}, '(?m)^[A-Z0-9<]{{28,44}}$')) >= 2 THEN 'multiple MRZ-shaped lines' END], lambda x: x IS NOT NULL) END")


@register("pii_signals", sql(
    f"SELECT doc_id, array_to_string({signals_sql('text')}, '|') AS signals FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN text || ' UTO' ELSE text END AS text FROM doc_text)",
    "doc_text"))
def _(spark, d):
    from docweir.operators import merge
    t = merge.ocr_text(i.ocr_lines(spark, d)).withColumn("text", F.when(
        F.col("doc_id") % 10 == 3, F.concat("text", F.lit(" UTO"))).otherwise(F.col("text")))
    return t.select("doc_id", F.array_join(gates.pii_signals(F.col("text")), "|").alias("signals"))


@register("pii_signals_documents", sql(
    f"SELECT source, sum(len({signals_sql('text')})) AS signals, count(*) AS n FROM documents GROUP BY source"))
def _(spark, d):
    return i.table(spark, d, "documents").groupBy("source").agg(
        F.sum(F.size(gates.pii_signals(F.col("text")))).alias("signals"), F.count("*").alias("n"))


def providers(spark):
    """Capability dimension: name, policy flags, prices, preference."""
    return spark.createDataFrame([
        ("provider-0", 0, True, True, False, 0.15, 0.60, False),
        ("provider-1", 1, False, True, True, 0.0, 0.0, False),
        ("provider-2", 2, True, False, False, 0.10, 0.40, False)],
        "provider string, pref int, allows_real_pii boolean, supports_vision boolean, "
        "data_used_for_training boolean, price_in double, price_out double, breaker_open boolean")


PROVIDERS = ("SELECT * FROM (VALUES ('provider-0', 0, TRUE, TRUE, FALSE, 0.15::DOUBLE, 0.60::DOUBLE), ('provider-1', 1, FALSE, TRUE, TRUE, 0.0::DOUBLE, 0.0::DOUBLE), "
             "('provider-2', 2, TRUE, FALSE, FALSE, 0.10::DOUBLE, 0.40::DOUBLE)) AS t(provider, pref, real_ok, vision, training, price_in, price_out)")


def requests(spark, d):
    k = F.col("doc_id")
    return i.persons(spark, d).select(
        k.alias("request_id"), F.concat(F.lit("provider-"), (k % 3).cast("string")).alias("provider"),
        F.lit("map the text").alias("system"),
        F.when(k % 4 == 0, F.concat(F.lit("id "), "pinfl")).otherwise(F.concat(F.lit("name "), "surname")).alias("user_text"),
        (k % 11 == 0).alias("has_images"), F.when(k % 5 != 0, k % 5 == 1).alias("contains_real_pii"),
        F.when(k % 13 == 0, "vision").otherwise("text_mapping").alias("task"))


REQUESTS = """SELECT doc_id AS request_id, 'provider-' || (doc_id % 3) AS provider, CASE WHEN doc_id % 4 = 0 THEN 'id ' || pinfl ELSE 'name ' || surname END AS user_text,
  doc_id % 11 = 0 AS has_images, doc_id % 5 IN (0, 1) AS is_real, CASE WHEN doc_id % 13 = 0 THEN 'vision' ELSE 'text_mapping' END AS task FROM persons"""


@register("pii_gate", sql("""
SELECT request_id, CASE WHEN reason = '' THEN 'send' ELSE 'refuse' END AS decision, reason FROM (
SELECT request_id, CASE WHEN real_ok THEN '' WHEN is_real AND training THEN 'tier not cleared: submitted data may be used for model training'
  WHEN is_real THEN 'tier not cleared for real personal data' WHEN has_images THEN 'images are always treated as real personal data'
  WHEN user_text LIKE 'id %' THEN 'marked synthetic but looks real: 14-digit identifier (PINFL pattern)' ELSE '' END AS reason
FROM requests JOIN providers USING (provider))""", "persons", requests=REQUESTS, providers=PROVIDERS))
def _(spark, d):
    out = gates.pii_gate(requests(spark, d), providers(spark))
    return out.select("request_id", "decision", F.coalesce("reason", F.lit("")).alias("reason"))


_elig = ("requests r JOIN providers p ON (NOT is_real OR real_ok) AND (NOT (has_images OR task = 'vision') OR vision)")


@register("eligible_providers", sql(
    f"SELECT request_id, p.provider, pref FROM {_elig}", "persons", requests=REQUESTS, providers=PROVIDERS))
def _(spark, d):
    return routing.eligible_providers(requests(spark, d).drop("provider"), providers(spark)).select("request_id", "provider", "pref")


@register("first_provider", sql(
    f"SELECT request_id, arg_min(p.provider, pref) AS provider FROM {_elig} GROUP BY request_id", "persons", requests=REQUESTS, providers=PROVIDERS))
def _(spark, d):
    return routing.first_provider(requests(spark, d).drop("provider"), providers(spark)).select("request_id", "provider")


def keys(spark, d):
    """Key state as the call log left it."""
    c = i.calls(spark, d).groupBy("key_id", "provider").agg(
        F.max_by("outcome", F.struct("ts", "call_id")).alias("last"), F.max("ts").alias("last_used_at"))
    wait = F.when(F.col("last") == "quota", 3600).when(F.col("last") == "ok", 0).otherwise(30)
    return c.select("key_id", "provider", "last_used_at",
                    F.when(F.col("last") == "ok", "healthy").otherwise("cooling").alias("state"),
                    F.timestamp_micros(F.unix_micros("last_used_at") + wait.cast("bigint") * 1000000).alias("available_at"),
                    (F.substring("key_id", 5, 1).cast("int") % 2 == 0).alias("allows_real_pii"))


KEYS = """SELECT key_id, provider, max(ts) AS last_used_at, max(ts) + CASE arg_max(outcome, (ts, call_id)) WHEN 'quota' THEN INTERVAL 3600 SECOND
  WHEN 'ok' THEN INTERVAL 0 SECOND ELSE INTERVAL 30 SECOND END AS available_at, arg_max(outcome, (ts, call_id)) = 'ok' AS healthy, CAST(substr(key_id, 5, 1) AS INT) % 2 = 0 AS real_ok FROM calls GROUP BY key_id, provider"""
KEYS_NOW = "2024-01-30 23:30:00"


@register("acquire_key", sql(f"""
SELECT request_id, coalesce((SELECT arg_min(key_id, (last_used_at, key_id)) FROM keys k WHERE k.provider = r.provider AND (healthy OR available_at <= TIMESTAMP '{KEYS_NOW}')
  AND (NOT is_real OR real_ok)), '') AS key_id FROM requests r""", "persons", "calls", requests=REQUESTS, keys=KEYS))
def _(spark, d):
    return routing.acquire_key(requests(spark, d), keys(spark, d), F.lit(KEYS_NOW).cast("timestamp")).select(
        "request_id", F.coalesce("key_id", F.lit("")).alias("key_id"))


@register("lru_rank", sql(
    "SELECT key_id, provider, row_number() OVER (PARTITION BY provider ORDER BY last_used_at, key_id) AS lru_rank FROM keys", "calls", keys=KEYS))
def _(spark, d):
    return routing.lru_rank(keys(spark, d)).select("key_id", "provider", "lru_rank")


# --- cache ------------------------------------------------------------------------------

def cache_requests(spark, d):
    c = i.table(spark, d, "conversations")
    tenant = F.concat(F.lit("t"), (F.col("conv_id") % 2).cast("string"))
    return c.select("conv_id", "turn", routing.cache_key(
        F.lit("router"), F.lit("cascade"), F.lit("id_visual_zone.v1"), F.col("text"), tenant).alias("cache_key"))


_key = (f"'llmcache:v1:t' || (conv_id % 2) || ':' || sha256(concat_ws(chr(0), 'router', 'cascade', 'id_visual_zone.v1', 't' || (conv_id % 2), {collapse('text')}))")
CACHE = {
    "cr": f"SELECT conv_id, turn, {_key} AS cache_key FROM conversations",
    "entries": "SELECT cache_key, max(conv_id) AS m FROM cr GROUP BY cache_key",
    "looked": "SELECT conv_id, turn, cache_key, coalesce(m % 3 = 0, FALSE) AS hit, m FROM cr JOIN entries USING (cache_key)",
}


def cache_table(spark, d):
    """A third of all keys live, a third expired, a third unreadable."""
    m = F.col("m")
    return cache_requests(spark, d).groupBy("cache_key").agg(F.max("conv_id").alias("m")).select(
        "cache_key", F.when(m % 3 == 2, F.concat(F.lit('{"broken'), m.cast("string"))).otherwise(
            F.concat(F.lit('{"m": '), m.cast("string"), F.lit("}"))).alias("value"),
        F.when(m % 3 == 1, F.lit("2024-01-30")).otherwise(F.lit("2024-02-05")).cast("timestamp").alias("expires_at"))


@register("cache_key", sql("SELECT conv_id, turn, cache_key FROM cr", cr=CACHE["cr"]))
def _(spark, d):
    return cache_requests(spark, d)


@register("cache_lookup", sql(
    "SELECT conv_id, turn, CASE WHEN hit THEN 'hit' ELSE 'miss' END AS outcome, CASE WHEN hit THEN '{\"m\": ' || m || '}' ELSE '' END AS value FROM looked", **CACHE))
def _(spark, d):
    out = routing.cache_lookup(cache_requests(spark, d), cache_table(spark, d), i.now())
    return out.select("conv_id", "turn", "outcome", F.coalesce("value", F.lit("")).alias("value"))


@register("cache_stats", sql(
    "SELECT conv_id % 2 AS tenant, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) AS hit_rate, count(DISTINCT CASE WHEN NOT hit THEN cache_key END) AS stores FROM looked GROUP BY 1", **CACHE))
def _(spark, d):
    out = routing.cache_lookup(cache_requests(spark, d), cache_table(spark, d), i.now())
    out = out.withColumn("tenant", F.col("conv_id") % 2)
    return routing.cache_stats(out, "tenant", stored=routing.calls_to_make(out))


@register("calls_to_make", sql("SELECT DISTINCT cache_key FROM looked WHERE NOT hit", **CACHE))
def _(spark, d):
    out = routing.cache_lookup(cache_requests(spark, d), cache_table(spark, d), i.now())
    return routing.calls_to_make(out).select("cache_key")


# --- money -------------------------------------------------------------------------------

_price = "tokens_in / 1e6 * price_in + tokens_out / 1e6 * price_out"


@register("estimate_cost", sql(
    f"SELECT provider, model, round(sum({_price}), 6) AS cost, count(*) AS n FROM calls JOIN providers USING (provider) GROUP BY provider, model",
    "calls", providers=PROVIDERS))
def _(spark, d):
    p = providers(spark).select("provider", "price_in", "price_out")
    return i.calls(spark, d).join(F.broadcast(p), "provider").groupBy("provider", "model").agg(
        F.round(F.sum(routing.estimate_cost(F.col("tokens_in"), F.col("tokens_out"), F.col("price_in"), F.col("price_out"))), 6).alias("cost"),
        F.count("*").alias("n"))


_before = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
SPEND = f"""SELECT *, coalesce(sum(cost_micros) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, call_id {_before}), 0) AS spent_day,
  coalesce(sum(cost_micros) OVER (PARTITION BY date_trunc('month', ts) ORDER BY ts, call_id {_before}), 0) AS spent_month FROM calls"""


@register("running_spend", sql("SELECT call_id, CAST(spent_day AS BIGINT) AS spent_day, CAST(spent_month AS BIGINT) AS spent_month FROM spend", "calls", spend=SPEND))
def _(spark, d):
    return routing.running_spend(i.calls(spark, d)).select("call_id", "spent_day", "spent_month")


@register("budget_gate", sql("""
SELECT call_id, ok AND spent_month < 60000000 AS accepted, least(spent_day, 3000000) >= 2400000 AS near_limit FROM (
 SELECT *, coalesce(sum(CASE WHEN ok THEN cost_micros ELSE 0 END) OVER (PARTITION BY date_trunc('month', ts) ORDER BY ts, call_id """ + _before + """), 0) AS spent_month
 FROM (SELECT * EXCLUDE (spent_month), spent_day < 3000000 AS ok FROM spend))""", "calls", spend=SPEND))
def _(spark, d):
    return routing.budget_gate(i.calls(spark, d), 3_000_000, 60_000_000).select("call_id", "accepted", "near_limit")


@register("usage_rollup", sql("""
SELECT coalesce(provider, '*') AS provider, coalesce(model, '*') AS model, coalesce(task, '*') AS task, coalesce(day, '*') AS day, count(*) AS calls, CAST(sum(cost_micros) AS BIGINT) AS cost_micros,
  CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, round(avg(latency_ms), 6) AS avg_latency_ms
FROM (SELECT *, strftime(ts, '%Y-%m-%d') AS day FROM calls) GROUP BY ROLLUP (provider, model, task, day)""", "calls"))
def _(spark, d):
    out = routing.usage_rollup(i.calls(spark, d))
    return out.select(*[F.coalesce(c, F.lit("*")).alias(c) for c in ("provider", "model", "task", "day")], "calls", "cost_micros",
                      "tokens_in", "tokens_out", F.round("avg_latency_ms", 6).alias("avg_latency_ms"))


STATE = ("CASE {0} WHEN 'ok' THEN 'healthy' WHEN 'invalid_key' THEN 'invalid' WHEN 'quota' THEN 'quota_exhausted' "
         "WHEN 'rate_limited' THEN 'rate_limited' WHEN 'unavailable' THEN 'cooling' ELSE 'healthy' END")


@register("key_report", sql(f"""
SELECT * EXCLUDE (bearing), {STATE.format("bearing")} AS state FROM (
SELECT provider, key_id, count(*) FILTER (outcome = 'ok') AS requests, count(*) FILTER (outcome NOT IN ('ok', 'bad_request')) AS failures,
  CAST(sum(CASE WHEN outcome = 'ok' THEN cost_micros ELSE 0 END) AS BIGINT) AS cost_micros, arg_max(outcome, (ts, call_id)) AS last_outcome,
  arg_max(outcome, (ts, call_id)) FILTER (outcome <> 'bad_request') AS bearing FROM calls GROUP BY provider, key_id)""", "calls"))
def _(spark, d):
    return routing.key_report(i.calls(spark, d))


# --- failure state machines ------------------------------------------------------------

_bears = "CASE WHEN {0}outcome = 'bad_request' THEN {1} ELSE {2} END"
_over = """f.lk NOT IN ('ok', 'invalid_key') AND o.ts >= f.lts + to_microseconds(CAST(1000000 * CASE f.lk WHEN 'quota' THEN 3600
  WHEN 'rate_limited' THEN coalesce(nullif(f.lr, 0), 30) ELSE least(pow(2, least(f.c, 9)), 300) END AS BIGINT))"""
HEALTH = {
    "o": "SELECT *, row_number() OVER (PARTITION BY key_id ORDER BY ts, call_id) AS rn FROM calls",
    "f": f"""SELECT key_id, rn, call_id, outcome, retry_after, CASE WHEN outcome IN ('ok', 'bad_request') THEN 0 ELSE 1 END AS c,
        {_bears.format("", "NULL", "outcome")} AS lk, {_bears.format("", "NULL", "ts")} AS lts, {_bears.format("", "NULL", "retry_after")} AS lr FROM o WHERE rn = 1
      UNION ALL SELECT o.key_id, o.rn, o.call_id, o.outcome, o.retry_after, CASE WHEN o.outcome = 'ok' THEN 0
        ELSE CASE WHEN o.outcome = 'bad_request' THEN 0 ELSE 1 END + CASE WHEN {_over} THEN 0 ELSE f.c END END,
        {_bears.format("o.", "f.lk", "o.outcome")}, {_bears.format("o.", "f.lts", "o.ts")}, {_bears.format("o.", "f.lr", "o.retry_after")}
        FROM f JOIN o ON o.key_id = f.key_id AND o.rn = f.rn + 1""",
}


@register("key_health", sql(f"""
SELECT call_id, c AS failures, CASE WHEN c = 0 THEN 'healthy' ELSE {STATE.format("lk")} END AS state,
  CAST(CASE outcome WHEN 'quota' THEN 3600 WHEN 'rate_limited' THEN coalesce(nullif(retry_after, 0), 30) WHEN 'unavailable' THEN least(pow(2, least(c, 9)), 300) ELSE 0 END AS DOUBLE) AS cooldown_s
FROM f""", "calls", **HEALTH))
def _(spark, d):
    return routing.key_health(i.calls(spark, d)).select("call_id", "failures", "state", "cooldown_s")


BREAKER = {
    "o": "SELECT *, row_number() OVER (PARTITION BY provider ORDER BY ts, call_id) AS rn FROM calls",
    "f": """SELECT provider, rn, call_id, ts, CASE WHEN outcome = 'ok' THEN 0 ELSE 1 END AS c FROM o WHERE rn = 1
      UNION ALL SELECT o.provider, o.rn, o.call_id, o.ts, CASE WHEN o.outcome = 'ok' THEN 0 ELSE 1 + CASE WHEN f.c >= 5 AND o.ts >= f.ts + INTERVAL 120 SECOND THEN 0 ELSE f.c END END
        FROM f JOIN o ON o.provider = f.provider AND o.rn = f.rn + 1""",
}


@register("circuit_breaker", sql("SELECT call_id, c AS failures, c >= 5 AS open FROM f", "calls", **BREAKER))
def _(spark, d):
    return routing.circuit_breaker(i.calls(spark, d)).select("call_id", "failures", "open")


# --- outcomes and prompts ----------------------------------------------------------------

@register("classify_outcome", sql("""
SELECT event_id, CASE WHEN s < 400 THEN 'ok' WHEN s IN (401, 403) THEN 'invalid_key' WHEN s = 429 AND b THEN 'quota' WHEN s = 429 THEN 'rate_limited'
  WHEN s = 400 THEN 'bad_request' ELSE 'unavailable' END AS outcome, CASE WHEN s = 429 AND NOT b AND event_id % 2 = 0 THEN 45.0 ELSE -1.0 END AS retry_after
FROM (SELECT event_id, [200, 401, 429, 400, 503][event_id % 5 + 1] AS s, event_id % 3 = 0 AS b FROM events)"""))
def _(spark, d):
    k = F.col("event_id")
    status = F.get(F.array(*[F.lit(x) for x in (200, 401, 429, 400, 503)]), (k % 5).cast("int"))
    body = F.when(k % 3 == 0, "Quota Exceeded for the period").otherwise("slow down")
    retry = F.when(k % 2 == 0, "45").otherwise("soon")
    x = i.table(spark, d, "events").select("event_id", gates.classify_outcome(status, body, retry).alias("x"))
    return x.select("event_id", "x.outcome", F.coalesce("x.retry_after", F.lit(-1.0)).alias("retry_after"))


def prompts(spark, d):
    """Prompt versions derived from parts: the name by brand, the version by size."""
    p = i.table(spark, d, "part")
    return p.select(F.when(F.col("p_partkey") % 3 == 0, "diploma_extract").when(F.col("p_partkey") % 3 == 1, "id_visual_zone")
                    .otherwise("vision_fallback").alias("name"), "p_partkey",
                    (F.col("p_partkey") % 997).cast("int").alias("version"), F.col("p_name").alias("text")) \
        .groupBy("name", "version").agg(F.min_by("text", "p_partkey").alias("text"))


PROMPTS = """SELECT name, version, arg_min(p_name, p_partkey) AS text FROM (SELECT CASE p_partkey % 3 WHEN 0 THEN 'diploma_extract' WHEN 1 THEN 'id_visual_zone' ELSE 'vision_fallback' END AS name,
  CAST(p_partkey % 997 AS INT) AS version, p_name, p_partkey FROM part) GROUP BY name, version"""


@register("latest_prompts", sql("SELECT name, max(version) AS version, arg_max(text, version) AS text FROM prompts GROUP BY name", prompts=PROMPTS))
def _(spark, d):
    return routing.latest_prompts(prompts(spark, d)).select("name", "version", "text")


@register("prompt_for", sql("""
SELECT job_id, l.name, l.version FROM (SELECT job_id, CASE WHEN status = 'ok' THEN 'diploma_extract' ELSE 'id_visual_zone' END AS name FROM jobs) j
JOIN (SELECT name, CASE WHEN name = 'id_visual_zone' THEN 1 ELSE max(version) END AS version FROM prompts GROUP BY name) l USING (name)""", "jobs", prompts=PROMPTS))
def _(spark, d):
    docs = i.jobs(spark, d).select("job_id", F.when(F.col("status") == "ok", "diploma_supplement").otherwise("id_front").alias("doc_type"))
    return routing.prompt_for(docs, prompts(spark, d), {"id_visual_zone": 1}).select("job_id", "name", "version")
