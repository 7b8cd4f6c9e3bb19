"""Predicates that accept, refuse or band rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docweir import messages as msg
from docweir.functions import patterns as p, scores
from docweir.functions.text import digits
from docweir.schema import DOCUMENT_TYPES, string_array


def present(*items: Column) -> Column:
    """Array of the non-null items, in order."""
    return F.array_compact(F.array(*items))


def date_logic_warnings(birth: Column, issue: Column, expiry: Column, today: Column) -> Column:
    return present(
        F.when(F.year(birth) < 1900, F.lit(msg.BIRTH_BEFORE_1900)),
        F.when(birth > today, F.lit(msg.BIRTH_IN_FUTURE)),
        F.when(issue < birth, F.lit(msg.ISSUED_BEFORE_BIRTH)),
        F.when(expiry <= issue, F.lit(msg.EXPIRY_BEFORE_ISSUE)),
        F.when(expiry < today, F.lit(msg.EXPIRED)))


def confidence_band(validated: Column, confidence: Column) -> Column:
    return (F.when(validated | (confidence >= 0.9), "confident")
            .when(confidence >= 0.7, "uncertain").otherwise("doubtful"))


# Published specimen identities that must not raise a signal.
SPECIMENS = ["L898902C3", "D23145890", "ERIKSSON", "UTO"]


def pii_signals(text: Column, whole_token: bool = True) -> Column:
    """Signals of real identity data in a text; a specimen silences all of them.

    ``whole_token=False`` matches specimens inside longer words too.
    """
    alternatives = "|".join(SPECIMENS)
    specimen = text.rlike(rf"(?<![A-Za-z0-9])(?:{alternatives})(?![A-Za-z0-9])"
                          if whole_token else f"(?:{alternatives})")
    passport = text.rlike(p.PASSPORT_SIGNAL)
    lines = F.size(F.regexp_extract_all(text, F.lit(p.MRZ_LINE_SIGNAL), F.lit(0)))
    signals = present(
        F.when(text.rlike(p.PINFL_SIGNAL), "14-digit identifier (PINFL pattern)"),
        F.when(text.rlike(p.DOC_NUMBER_SIGNAL), "document number pattern"),
        F.when(passport, "passport MRZ header").when(lines >= 2, "multiple MRZ-shaped lines"))
    return F.when(text.isNull() | specimen, string_array([])).otherwise(signals)


def pii_gate(requests: DataFrame, providers: DataFrame) -> DataFrame:
    """Policy decision per request and the provider it is meant for.

    ``requests``: request_id, provider, system, user_text, has_images,
    contains_real_pii (NULL counts as real).  ``providers`` is a small
    dimension.  Adds ``decision`` (send/refuse) and ``reason``; refused rows
    stay in the output so the caller can route them to quarantine.
    """
    caps = providers.select("provider", "allows_real_pii", "data_used_for_training")
    joined = requests.join(caps, "provider", "left")
    cleared = F.coalesce(F.col("allows_real_pii"), F.lit(False))
    real = F.coalesce(F.col("contains_real_pii"), F.lit(True))
    found = F.when(~real & ~cleared, pii_signals(F.concat_ws("\n", "system", "user_text")))
    out = joined.withColumn("_signals", found)
    reason = (F.when(real & ~cleared & F.coalesce("data_used_for_training", F.lit(True)),
                     "tier not cleared: submitted data may be used for model training")
              .when(real & ~cleared, "tier not cleared for real personal data")
              .when(F.coalesce("has_images", F.lit(False)) & ~cleared,
                    "images are always treated as real personal data")
              .when(F.size("_signals") > 0, F.concat(
                  F.lit("marked synthetic but looks real: "), F.array_join("_signals", "; "))))
    return (out.withColumn("reason", reason)
            .withColumn("decision", F.when(F.col("reason").isNull(), "send").otherwise("refuse"))
            .drop("_signals", "allows_real_pii", "data_used_for_training"))


def quality_gate(df: DataFrame, blur_min: float = 60.0, dpi_min: int = 200) -> DataFrame:
    """Adds ``reasons`` and ``is_acceptable`` from image metrics.

    Needs blur_score, brightness, contrast, estimated_dpi, width, height,
    glare_regions (array of boxes) and moire_detected.
    """
    q = msg.QUALITY
    glare = F.aggregate("glare_regions", F.lit(0).cast("bigint"), lambda acc, b: acc + (
        (F.get(b, F.lit(2)) - F.get(b, F.lit(0))).cast("bigint")
        * (F.get(b, F.lit(3)) - F.get(b, F.lit(1)))))
    reasons = present(
        F.when(F.col("blur_score") < blur_min, F.lit(q["blur"])),
        F.when(F.col("brightness") < 60, F.lit(q["dark"]))
         .when(F.col("brightness") > 215, F.lit(q["bright"])),
        F.when(F.col("contrast") < 25, F.lit(q["contrast"])),
        F.when(glare > F.lit(0.06) * F.col("height") * F.col("width"), F.lit(q["glare"])),
        F.when(F.col("estimated_dpi") < dpi_min, F.lit(q["dpi"])),
        F.when(F.col("moire_detected"), F.lit(q["moire"])))
    return df.withColumn("reasons", reasons).withColumn("is_acceptable", F.size("reasons") == 0)


def ood_decision(df: DataFrame, logits: str = "logits", min_confidence: float = 0.60,
                 max_energy: float = -2.0, classes: list[str] | None = None) -> DataFrame:
    """Adds doc_type, predicted, confidence, energy, is_ood and reason.

    The unknown class is tested first, then the softmax floor, then the energy
    ceiling.  A score vector whose length differs from the class list fails the
    job, because every name would be wrong.
    """
    names = classes or DOCUMENT_TYPES
    x = F.col(logits)
    guarded = F.when(F.size(x) == len(names), x).otherwise(F.raise_error(
        F.concat(F.lit("score vector length does not match the class list: "),
                 F.size(x).cast("string"))).cast("array<double>"))
    out = (df.withColumn("_scores", guarded)
           .withColumn("predicted", F.get(string_array(names), scores.top_class(F.col("_scores"))))
           .withColumn("confidence", F.array_max(scores.softmax(F.col("_scores"))))
           .withColumn("energy", scores.free_energy(F.col("_scores"))).drop("_scores"))
    reason = (F.when(F.col("predicted") == "unknown", "unknown class")
              .when(F.col("confidence") < min_confidence, "below confidence floor")
              .when(F.col("energy") > max_energy, "energy above ceiling"))
    return (out.withColumn("reason", F.coalesce(reason, F.lit("")))
            .withColumn("is_ood", F.col("reason") != "")
            .withColumn("doc_type", F.when(F.col("is_ood"), "unknown").otherwise(F.col("predicted"))))


def check_for_injection(text: Column) -> Column:
    """Sorted dangerous identifiers found inside template tags."""
    inside = F.concat(F.regexp_extract_all(text, F.lit(p.TAG), F.lit(1)),
                      F.regexp_extract_all(text, F.lit(p.TAG), F.lit(2)))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(
        inside, lambda e: F.regexp_extract_all(e, F.lit(p.INJECTION), F.lit(0))))))


def count_of(text: Column, token: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(token), F.lit("")))) / len(token)) \
        .cast("int")


def unbalanced_tags(text: Column) -> Column:
    return count_of(text, "{{") != count_of(text, "}}")


def publishable(required: Column) -> Column:
    return F.size(required) > 0


def format_supported(requested: Column, formats: Column) -> Column:
    return F.array_contains(formats, requested)


def classify_outcome(status: Column, body: Column, retry_after: Column) -> Column:
    """Provider response to (outcome, retry_after seconds)."""
    outcome = (F.when(status < 400, "ok").when(status.isin(401, 403), "invalid_key")
               .when((status == 429) & body.rlike("(?i)quota|exhaust|exceeded"), "quota")
               .when(status == 429, "rate_limited").when(status == 400, "bad_request")
               .otherwise("unavailable"))
    return F.struct(outcome.alias("outcome"),
                    F.when(outcome == "rate_limited", retry_after.try_cast("double"))
                    .alias("retry_after"))


def is_numeric_identifier(c: Column) -> Column:
    return (F.length(c) > 0) & (digits(c) == c)
