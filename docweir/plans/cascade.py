"""The whole-document composition: zone, label rules, model replies, merge, checks.

Each stage contributes candidate rows to one long table; a single aggregation
picks the winners.  Later stages see only what earlier ones left open, so the
paid step is asked for as little as possible.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from docweir import messages as msg
from docweir.operators import gates, grounding, merge, mrz, rules
from docweir.plans.answering import Answers
from docweir.session import materialise
from docweir.schema import STAGE_RANK, is_empty, string_array


@dataclass(frozen=True)
class CascadeConfig:
    threshold: float = 0.75
    use_rules: bool = True
    use_replies: bool = True
    fuzzy_threshold: float | None = 90
    rule_confidence: float = 0.80
    text_confidence: float = 0.70
    image_confidence: float = 0.65
    image_min_unresolved: int = 3
    exclude_mrz_lines: bool = True
    whole_word_labels: bool = False
    materialise: bool = True


@dataclass(frozen=True)
class CascadeResult:
    """``fields`` long, ``documents`` one row each, ``warnings`` long, ``requests`` asked for."""
    fields: DataFrame
    documents: DataFrame
    warnings: DataFrame
    requests: DataFrame
    rejected: DataFrame | None = None
    usage: DataFrame | None = None
    not_sent: DataFrame | None = None


#: Takes batched requests (doc_id, request, fields) and texts (doc_id, text), and answers them (``answering.answer``).
Answerer = Callable[[DataFrame, DataFrame], Answers]


def _ranked(df: DataFrame) -> DataFrame:
    ranks = F.create_map(*[F.lit(x) for kv in STAGE_RANK.items() for x in kv])
    return df.withColumn("stage_rank", F.element_at(ranks, F.col("source")))


def _as_candidates(values: DataFrame, source: str, confidence: float) -> DataFrame:
    return values.select(
        "doc_id", "path", "value", F.lit(confidence).alias("confidence"), F.lit(source).alias("source"),
        F.lit(False).alias("validated"), string_array([]).alias("alternatives"),
        F.lit(None).cast("string").alias("note"))


def zone_stage(lines: DataFrame, today: Column) -> DataFrame:
    """One row per document that shows a zone, with its fields and warnings."""
    return mrz.parse_mrz(mrz.mrz_candidates(lines), today).filter("found")


def open_requests(merged: DataFrame, documents: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, fields): everything a document still lacks, in schema order; diplomas have education fields too."""
    done = merged.filter(merge.resolved(threshold)).groupBy("doc_id").agg(
        F.collect_set("path").alias("_done"))
    kind = F.coalesce("doc_type", F.lit("")) if "doc_type" in documents.columns else None
    open_ = documents.join(done, "doc_id", "left").select("doc_id", F.array_except(
        merge.paths_for(kind), F.coalesce("_done", string_array([]))).alias("fields"))
    return open_.filter(F.size("fields") > 0)


def cascade(lines: DataFrame, replies: DataFrame | None, today: Column,
            config: CascadeConfig = CascadeConfig(), image_replies: DataFrame | None = None,
            doc_types: DataFrame | None = None, turned_away: DataFrame | None = None,
            answer_text: Answerer | None = None, answer_image: Answerer | None = None) -> CascadeResult:
    """Run all stages over ``lines`` (doc_id, line_no, text).

    ``answer_text`` and ``answer_image`` pay for answers where ``replies`` and
    ``image_replies`` are not given; ``usage`` then has their calls, ``documents``
    their ``cost_micros`` and ``not_sent`` (doc_id, request, reason) what was refused
    or failed.  ``turned_away`` (doc_id, status) are documents refused before
    recognition (see ``admit``); they are documents without fields.

    ``doc_types`` (doc_id, doc_type) opens the education fields of diplomas.
    ``requests`` has all open fields, in batches of at most 25 (doc_id, request,
    fields); ``rejected`` the answers that the text does not bear out.

    ``replies`` and ``image_replies`` (doc_id, reply) hold what a model answered
    to the requests, read back from where they were written: a paid call never
    sits inside a plan that may be retried.
    """
    if turned_away is not None:
        lines = lines.join(turned_away.select("doc_id"), "doc_id", "left_anti")
    # Every stage reads the lines, and several the texts of documents.
    lines = lines.select("doc_id", "line_no", "text")
    if config.materialise:
        lines = materialise(lines, "lines")
    texts = merge.ocr_text(lines)
    if config.materialise:
        texts = materialise(texts, "texts")
    documents = texts.select("doc_id")
    if doc_types is not None:
        documents = documents.join(doc_types.select("doc_id", "doc_type"), "doc_id", "left")
    kind = F.coalesce("doc_type", F.lit("")) if doc_types is not None else None
    rejected = None
    # Zones and the free stages feed several later branches; writing each once
    # keeps the plans short and survives the loss of an executor.
    zones = zone_stage(lines, today).select("doc_id", "fields", "warnings")
    if config.materialise:
        zones = materialise(zones, "zones")
    zone_rows = mrz.explode_fields(zones, "doc_id")
    allowed = F.array_contains(merge.paths_for(kind), F.col("path"))
    stages = zones.select("doc_id", F.lit(0).alias("n"), F.lit("L0_mrz").alias("stage"))
    pool = _ranked(zone_rows)
    if config.use_rules:
        found = rules.map_by_rules(lines, config.whole_word_labels)
        found = (found if doc_types is None else found.join(documents, "doc_id")).filter(allowed)
        pool = pool.unionByName(_ranked(_as_candidates(found, "ocr_visual", config.rule_confidence)))
    first = merge.merge_fields(pool)
    if config.materialise:
        first = materialise(first, "free-stages")
    stages = stages.unionByName(first.filter("source = 'ocr_visual'").select(
        "doc_id", F.lit(1).alias("n"), F.lit("L1_rules").alias("stage")).distinct())
    requests = open_requests(first, documents, config.threshold)
    batched = requests.select("doc_id", F.posexplode(merge.unresolved_requests(F.col("fields"))).alias("request", "fields"))
    merged, paid = first, []
    if config.use_replies and replies is None and answer_text is not None:
        paid.append(answer_text(batched, texts))
        replies = paid[-1].replies
    if config.use_replies and replies is not None:
        answered = _answers(grounding.parse_reply(replies), requests)
        checked = grounding.ground(answered, texts, config.fuzzy_threshold)
        rejected = checked.filter(~F.col("accepted"))
        kept = checked.filter(F.col("accepted") & ~is_empty(F.col("value")))
        merged = merge.merge_fields(merged.unionByName(_ranked(
            _as_candidates(kept, "llm_text", config.text_confidence))))
        stages = stages.unionByName(requests.join(replies.select("doc_id"), "doc_id", "left_semi").select(
            "doc_id", F.lit(2).alias("n"), F.lit("L2_llm_text").alias("stage")))
    if image_replies is not None or answer_image is not None:
        if config.materialise:
            merged = materialise(merged, "text-stages")
        left = open_requests(merged, documents, config.threshold).filter(
            F.size("fields") >= config.image_min_unresolved)
        if image_replies is None:
            paid.append(answer_image(left.select("doc_id", F.lit(0).alias("request"), "fields"), texts))
            image_replies = paid[-1].replies
        seen = _answers(grounding.parse_reply(image_replies), left).filter(~is_empty(F.col("value")))
        merged = merge.merge_fields(merged.unionByName(_ranked(
            _as_candidates(seen, "vlm", config.image_confidence))))
        stages = stages.unionByName(left.join(image_replies.select("doc_id"), "doc_id", "left_semi").select(
            "doc_id", F.lit(3).alias("n"), F.lit("L3_vlm").alias("stage")))

    usage = not_sent = costs = refusals = None
    for answers in paid:
        usage = answers.usage if usage is None else usage.unionByName(answers.usage)
        not_sent = answers.refused if not_sent is None else not_sent.unionByName(answers.refused)
        cost = answers.replies.select("doc_id", "cost_micros")
        costs = cost if costs is None else costs.unionByName(cost)
    if not_sent is not None:
        policy = ~F.col("reason").startswith("call ")
        refusals = not_sent.select("doc_id", F.when(policy, msg.REFUSED_BY_POLICY).otherwise(msg.LOCAL_ONLY).alias("warning")).distinct()
        stages = stages.unionByName(not_sent.where(policy).select(
            "doc_id", F.lit(4).alias("n"), F.lit("L2_refused_policy").alias("stage")).distinct())
    used = stages.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_set(
        F.struct("n", "stage"))), lambda s: s["stage"]).alias("stages_used"))
    typed = merged if doc_types is None else merged.join(documents, "doc_id", "left")
    reviewed = merge.review_summary(typed, config.threshold, kind).drop("doc_type")
    summary = documents.join(reviewed, "doc_id", "left").join(used, "doc_id", "left")
    summary = (summary
               .withColumn("overall_confidence", F.coalesce("overall_confidence", F.lit(0.0)))
               .withColumn("needs_review", F.coalesce("needs_review", merge.paths_for(kind)))
               .withColumn("status", F.coalesce("status", F.lit("review_needed")))
               .withColumn("stages_used", F.coalesce("stages_used", string_array([]))))
    if costs is None:
        summary = summary.withColumn("cost_micros", F.lit(0).cast("long"))
    else:
        summary = summary.join(costs.groupBy("doc_id").agg(F.sum("cost_micros").alias("cost_micros")), "doc_id", "left").fillna(
            0, ["cost_micros"])
    if turned_away is not None:
        none = turned_away.select("doc_id", "status").withColumns({
            "overall_confidence": F.lit(0.0), "needs_review": string_array([]), "stages_used": string_array([]), "cost_micros": F.lit(0).cast("long")})
        summary = summary.unionByName(none, allowMissingColumns=True)
    told = warnings(zones, zone_rows, merged, lines, today, config)
    if refusals is not None:
        told = told.unionByName(refusals)
    return CascadeResult(merged, summary, told, batched, rejected, usage, not_sent)


def _answers(parsed: DataFrame, requests: DataFrame) -> DataFrame:
    """Reply rows for fields that were asked for."""
    asked = requests.select("doc_id", F.explode("fields").alias("path"))
    return parsed.join(asked, ["doc_id", "path"], "left_semi")


def warnings(zones: DataFrame, zone_rows: DataFrame, merged: DataFrame, lines: DataFrame,
             today: Column, config: CascadeConfig) -> DataFrame:
    """(doc_id, warning) from the zone, the date logic and the tamper check."""
    def date_of(path: str) -> Column:
        return F.max(F.when(F.col("path") == path, F.try_to_date("value", "yyyy-MM-dd")))

    own = zones.select("doc_id", F.explode("warnings").alias("warning"))
    dates = merged.groupBy("doc_id").agg(
        date_of("person.birth_date").alias("b"), date_of("documents.0.issue_date").alias("i"),
        date_of("documents.0.expiry_date").alias("e"))
    logic = dates.select("doc_id", F.explode(gates.date_logic_warnings(
        F.col("b"), F.col("i"), F.col("e"), today)).alias("warning"))
    face = lines.filter(~mrz.is_zone_line(F.col("text"))) if config.exclude_mrz_lines else lines
    tamper = merge.mrz_in_visual(zone_rows, merge.ocr_text(face)).select("doc_id", "warning")
    return own.unionByName(logic).unionByName(tamper)


def admit(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split images into admitted and refused before any recognition is paid for.

    Needs the columns of ``gates.quality_gate`` and, optionally, ``doc_type``.
    """
    judged = gates.quality_gate(images)
    kind = F.col("doc_type") if "doc_type" in images.columns else F.lit(None).cast("string")
    status = (F.when(~F.col("is_acceptable"), "bad_quality")
              .when(kind == "unknown", "unknown_doc_type"))
    judged = judged.withColumn("status", status)
    return (judged.filter(F.col("status").isNull()).drop("status"),
            judged.filter(F.col("status").isNotNull()))
