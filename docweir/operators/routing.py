"""Provider routing, response cache, budgets and usage
(J5-J7, J16, W5-W8, W12, P14, A9-A12, ST5/ST6 batch forms)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docweir.functions.text import normalize_input
from docweir.operators import folds, scan

CACHE_NAMESPACE = "llmcache:v1"
CACHE_TTL_SECONDS = 7 * 24 * 3600


def cache_key(provider: Column, model: Column, prompt_version: Column, payload: Column,
              tenant: Column) -> Column:
    """Content-addressed key: digest of everything that determines the answer."""
    parts = F.concat_ws("\0", provider, model, prompt_version, tenant, normalize_input(payload))
    return F.concat_ws(":", F.lit(CACHE_NAMESPACE), tenant, F.sha2(parts, 256))


def cache_lookup(requests: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """Adds ``value`` and ``outcome`` (hit/miss) to requests by ``cache_key``.

    Expired and unreadable entries are misses.  Identical requests share one key;
    the newest live entry answers them.
    """
    live = cache.filter(F.col("expires_at") > now).filter(F.try_parse_json("value").isNotNull())
    newest = live.groupBy("cache_key").agg(F.max_by("value", "expires_at").alias("value"))
    return requests.join(newest, "cache_key", "left").withColumn(
        "outcome", F.when(F.col("value").isNotNull(), "hit").otherwise("miss"))


def calls_to_make(looked_up: DataFrame) -> DataFrame:
    """One paid call per distinct missing key: that of the smallest request."""
    rest = [c for c in looked_up.columns if c != "cache_key"]
    first = looked_up.filter("outcome = 'miss'").groupBy("cache_key").agg(F.min(F.struct(*rest)).alias("_r"))
    return first.select("cache_key", "_r.*").select(*looked_up.columns)


def cache_stats(looked_up: DataFrame, *by: str, stored: DataFrame | None = None) -> DataFrame:
    """Hits, misses, their rate and, from the entries written (``stored``, with the columns ``by``), the stores."""
    hits, misses = F.count_if(F.col("outcome") == "hit"), F.count_if(F.col("outcome") == "miss")
    looked = looked_up.groupBy(*by).agg(hits.alias("hits"), misses.alias("misses"))
    if stored is None:
        looked = looked.withColumn("stores", F.lit(0).cast("long"))
    else:
        kept = stored.groupBy(*by).agg(F.count("*").alias("stores"))
        looked = (looked.join(kept, list(by), "full") if by else looked.crossJoin(kept)).fillna(0, ["hits", "misses", "stores"])
    rate = F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col("hits") + F.col("misses")), F.lit(0.0))
    return looked.withColumn("hit_rate", rate)


def eligible_providers(requests: DataFrame, providers: DataFrame) -> DataFrame:
    """(request…, provider, pref) for every provider that may serve a request.

    A provider is expanded to the (real data, vision) needs it can serve, so the
    policy becomes an equi-join with a dimension of a few rows per provider.
    """
    flags = [(r, v) for r in (True, False) for v in (True, False)]
    needs = F.array_compact(F.array(*[
        F.when((F.lit(not r) | F.col("allows_real_pii")) & (F.lit(not v) | F.col("supports_vision"))
               & ~F.col("breaker_open"), F.struct(F.lit(r).alias("_real"), F.lit(v).alias("_vision")))
        for r, v in flags]))
    serves = providers.select("provider", "pref", F.inline(needs))
    asked = requests.withColumn("_real", F.coalesce("contains_real_pii", F.lit(True))).withColumn(
        "_vision", F.coalesce(F.col("has_images"), F.lit(False)) | (F.col("task") == "vision"))
    return asked.join(serves, ["_real", "_vision"]).drop("_real", "_vision")


def first_provider(requests: DataFrame, providers: DataFrame) -> DataFrame:
    """The most preferred eligible provider per request; NULL when none is.

    The preference is folded into the dimension, so requests never multiply.
    """
    flags = [(r, v) for r in (True, False) for v in (True, False)]
    needs = F.array_compact(F.array(*[
        F.when((F.lit(not r) | F.col("allows_real_pii")) & (F.lit(not v) | F.col("supports_vision"))
               & ~F.col("breaker_open"), F.struct(F.lit(r).alias("_real"), F.lit(v).alias("_vision")))
        for r, v in flags]))
    best = providers.select("provider", "pref", F.inline(needs)).groupBy("_real", "_vision").agg(
        F.min_by("provider", F.struct("pref", "provider")).alias("provider"))
    asked = requests.withColumn("_real", F.coalesce("contains_real_pii", F.lit(True))).withColumn(
        "_vision", F.coalesce(F.col("has_images"), F.lit(False)) | (F.col("task") == "vision"))
    return asked.join(F.broadcast(best), ["_real", "_vision"], "left").drop("_real", "_vision")


def acquire_key(requests: DataFrame, keys: DataFrame, now: Column) -> DataFrame:
    """Least recently used healthy key of the provider of each request.

    ``keys``: provider, key_id, state, available_at, last_used_at, allows_real_pii.
    """
    cooled = F.col("state").isin("rate_limited", "quota_exhausted", "cooling") & (F.col("available_at") <= now)
    usable = keys.filter((F.col("state") == "healthy") | cooled)
    need = F.when(F.col("allows_real_pii"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))
    best = usable.select("provider", "key_id", "last_used_at", F.explode(need).alias("_real")) \
        .groupBy("provider", "_real").agg(F.min_by("key_id", F.struct("last_used_at", "key_id")).alias("key_id"))
    asked = requests.withColumn("_real", F.coalesce("contains_real_pii", F.lit(True)))
    return asked.join(best, ["provider", "_real"], "left").drop("_real")


def lru_rank(keys: DataFrame) -> DataFrame:
    """Keys of each provider ranked by last use (keys are credentials: few per provider)."""
    from pyspark.sql import Window
    w = Window.partitionBy("provider").orderBy("last_used_at", "key_id")
    return keys.withColumn("lru_rank", F.row_number().over(w))


def estimate_cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Dollars for a call at per-million-token prices."""
    return tokens_in / 1_000_000 * price_in + tokens_out / 1_000_000 * price_out


def _dated(calls: DataFrame, order: list[str]) -> DataFrame:
    """Calls in time-ordered parts with their UTC day and month, both monotone in time."""
    parts = scan.ordered_parts(calls, [], order)
    return parts.withColumns({"day": F.to_date("ts"), "month": F.date_trunc("month", "ts").cast("date")})


def running_spend(calls: DataFrame) -> DataFrame:
    """Adds spend before each call in its day and month (UTC), in micro-dollars."""
    order = ["ts", "call_id"]
    by_day = scan.running_total(_dated(calls, order), ["day"], order, "cost_micros", "spent_day")
    return scan.running_total(by_day, ["month"], order, "cost_micros", "spent_month").drop(scan.PART, scan.AT)


def budget_gate(calls: DataFrame, daily_micros: int, monthly_micros: int) -> DataFrame:
    """Adds ``accepted`` and ``near_limit`` as a sequential budget guard would.

    Spend never falls, so once a day's running total reaches the limit every
    later call of that day is refused: a prefix sum is exact.  The monthly pass
    runs over the calls the daily pass let through.
    """
    order = ["ts", "call_id"]
    by_day = scan.running_total(_dated(calls, order), ["day"], order, "cost_micros", "spent_day")
    marked = by_day.withColumn("_ok", F.col("spent_day") < daily_micros).withColumn(
        "_cost", F.when(F.col("_ok"), F.col("cost_micros")).otherwise(F.lit(0)))
    by_month = scan.running_total(marked, ["month"], order, "_cost", "spent_month")
    return (by_month.withColumn("accepted", F.col("_ok") & (F.col("spent_month") < monthly_micros))
            .withColumn("near_limit", F.least("spent_day", F.lit(daily_micros)) >= 0.8 * daily_micros)
            .drop("_ok", "_cost", scan.PART, scan.AT))


def usage_rollup(calls: DataFrame) -> DataFrame:
    """Cost, tokens and latency at provider / model / task / day levels and in total."""
    return calls.withColumn("day", F.date_format("ts", "yyyy-MM-dd")).rollup("provider", "model", "task", "day").agg(
        F.count("*").alias("calls"), F.sum("cost_micros").alias("cost_micros"),
        F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"),
        F.avg("latency_ms").alias("avg_latency_ms"))


def key_report(calls: DataFrame) -> DataFrame:
    """Requests, failures, cost and state per provider and key; never a secret.

    The state is that of the last call that changed it: a bad request does not, and
    is no failure of the key.  Waits that are over meanwhile are for the reader to judge.
    """
    ok, bears = F.col("outcome") == "ok", F.col("outcome") != "bad_request"
    order = F.struct("ts", "call_id")
    out = calls.drop("secret").groupBy("provider", "key_id").agg(
        F.count_if(ok).alias("requests"), F.count_if(~ok & bears).alias("failures"),
        F.sum(F.when(ok, F.col("cost_micros")).otherwise(0)).alias("cost_micros"),
        F.max_by("outcome", order).alias("last_outcome"), F.max_by("outcome", F.when(bears, order)).alias("_bearing"))
    return out.withColumn("state", key_state(F.col("_bearing"))).drop("_bearing")


def key_state(in_force: Column) -> Column:
    """State of a key whose last bearing outcome is ``in_force``; null means none."""
    return (F.when(in_force.isNull() | (in_force == "ok"), "healthy").when(in_force == "invalid_key", "invalid")
            .when(in_force == "quota", "quota_exhausted").when(in_force == "rate_limited", "rate_limited").otherwise("cooling"))


# --- key health and circuit breaker -----------------------------------------------

# Cool-down seconds per failure kind, back-off and breaker limits.
QUOTA_SECONDS, RATE_SECONDS, BACKOFF_LIMIT = 3600, 30, 300
BREAKER_THRESHOLD, BREAKER_SECONDS = 5, 120


def _health_wait(last: folds.Call, count: int) -> float | None:
    """Seconds until a key recovers from its last failure; a stated wait counts for rate limits, and zero is not stated."""
    if last.kind in ("ok", "invalid_key"):
        return None
    if last.kind == "quota":
        return QUOTA_SECONDS
    if last.kind == "rate_limited":
        return last.retry_after or RATE_SECONDS
    return min(2 ** min(count, folds.ALIKE), BACKOFF_LIMIT)


def _breaker_wait(last: folds.Call, count: int) -> float | None:
    return BREAKER_SECONDS if count >= BREAKER_THRESHOLD else None


HEALTH_MACHINE = folds.Machine(_health_wait, frozenset(["bad_request"]))
BREAKER_MACHINE = folds.Machine(_breaker_wait)


def key_health(calls: DataFrame, carry: DataFrame | None = None) -> DataFrame:
    """Adds ``failures``, ``state``, ``cooldown_s`` (what this call sets) and ``in_force`` after each call.

    A cool-down that is over resets the count before the call is recorded; success
    resets it; a bad request changes nothing else, and the state stays that of the
    call before it, or healthy if its wait is over.  A rate limit with a positive
    ``retry_after`` (seconds, if the table has that column) waits so long, every
    other failure its own time.  ``carry`` continues from an earlier batch.
    """
    stated = "retry_after" if "retry_after" in calls.columns else None
    out = folds.fold(calls, "key_id", ["call_id"], HEALTH_MACHINE, carry, stated)
    kind = F.col("outcome")
    wait = F.coalesce(F.when(F.col(stated) > 0, F.col(stated)), F.lit(float(RATE_SECONDS))) if stated else F.lit(float(RATE_SECONDS))
    backoff = F.least(F.pow(F.lit(2), F.least("failures", F.lit(folds.ALIKE))), F.lit(BACKOFF_LIMIT))
    return out.withColumn("state", key_state(F.col("in_force"))).withColumn(
        "cooldown_s", F.when(kind.isin("ok", "bad_request", "invalid_key"), 0).when(kind == "quota", QUOTA_SECONDS)
        .when(kind == "rate_limited", wait).otherwise(backoff).cast("double"))


def circuit_breaker(calls: DataFrame, carry: DataFrame | None = None) -> DataFrame:
    """Adds ``failures`` (the whole count) and ``open`` per provider after each call."""
    out = folds.fold(calls, "provider", ["call_id"], BREAKER_MACHINE, carry)
    return out.withColumn("open", F.col("failures") >= BREAKER_THRESHOLD)


# --- prompts ------------------------------------------------------------------------

def latest_prompts(prompts: DataFrame, pins: dict[str, int] | None = None) -> DataFrame:
    """Highest version per prompt name, or the pinned one.

    A pin on a version that does not exist keeps the name with an error text.
    """
    pins = pins or {}
    best = prompts.groupBy("name").agg(
        F.max_by(F.struct("version", "text"), "version").alias("best"),
        *[F.max(F.when((F.col("name") == n) & (F.col("version") == v), F.struct("version", "text"))).alias(f"_pin_{n}")
          for n, v in pins.items()])
    chosen, error = F.col("best"), F.lit(None).cast("string")
    for n, v in pins.items():
        mine = F.col("name") == n
        chosen = F.when(mine, F.col(f"_pin_{n}")).otherwise(chosen)
        error = F.when(mine & F.col(f"_pin_{n}").isNull(), F.lit(f"prompt {n} has no v{v}")).otherwise(error)
    return best.select("name", chosen.alias("c"), error.alias("error")).select("name", "c.version", "c.text", "error")


def prompt_name(doc_type: Column) -> Column:
    """Prompt for a document type; the identity prompt is the cautious default."""
    return F.when(F.lower(doc_type).contains("diploma"), "diploma_extract").otherwise("id_visual_zone")


def prompt_for(documents: DataFrame, prompts: DataFrame, pins: dict[str, int] | None = None) -> DataFrame:
    """Adds prompt name, version and text by document type; a missing prompt is an error row."""
    chosen = latest_prompts(prompts, pins)
    out = documents.withColumn("name", prompt_name(F.col("doc_type"))).join(chosen, "name", "left")
    return out.withColumn("error", F.when(F.col("version").isNull() & F.col("error").isNull(), F.concat(
        F.lit("no prompt named "), "name")).otherwise(F.col("error")))
