"""Golden-set evaluation, classifier metrics and calibration
(J11, A4-A8, A13-A17, A20, T3, M3, M8)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from docweir.functions import scores
from docweir.operators import scan


def compare_golden(golden: DataFrame, actual: DataFrame) -> DataFrame:
    """One row per expected field: got, correct, false_validated."""
    a = actual.select("doc_id", "path", F.col("value").alias("got"), "validated")
    out = golden.withColumnRenamed("value", "want").join(a, ["doc_id", "path"], "left")
    correct = F.col("got").eqNullSafe(F.col("want"))
    return (out.withColumn("correct", correct)
            .withColumn("false_validated", ~correct & F.coalesce("validated", F.lit(False))))


def document_scores(compared: DataFrame) -> DataFrame:
    return compared.groupBy("doc_id").agg(
        F.count("*").alias("total"), F.count_if("correct").alias("correct"),
        F.count_if("false_validated").alias("false_validated"))


def extraction_metrics(compared: DataFrame, results: DataFrame, checked: DataFrame | None = None) -> DataFrame:
    """One row of corpus metrics.

    zero_touch counts documents without a wrong field; rejects are documents of
    bad quality or unknown type; l3 usage looks at the stages a document used.
    ``checked`` (with ``accepted``) supplies the rejection rate of model answers.
    """
    per_doc = document_scores(compared).join(results, "doc_id", "left")
    metrics = per_doc.agg(
        F.count("*").alias("documents"),
        (F.sum("correct") / F.sum("total")).alias("field_exact_match"),
        F.avg((F.col("correct") == F.col("total")).cast("double")).alias("zero_touch_rate"),
        F.avg(F.coalesce(F.col("status").isin("bad_quality", "unknown_doc_type"), F.lit(False)).cast("double"))
        .alias("reject_rate"),
        (F.sum("false_validated") / F.sum("total")).alias("false_validated_rate"),
        F.avg(F.coalesce(F.array_contains("stages_used", "L3_vlm"), F.lit(False)).cast("double")).alias("l3_usage_rate"),
        F.avg(F.coalesce("llm_cost_usd", F.lit(0.0))).alias("cost_per_document"))
    if checked is None:
        return metrics.withColumn("llm_rejection_rate", F.lit(0.0))
    rate = checked.filter(F.col("value").isNotNull()).agg(
        F.coalesce(F.avg((~F.col("accepted")).cast("double")), F.lit(0.0)).alias("llm_rejection_rate"))
    return metrics.join(rate)


def per_field_accuracy(compared: DataFrame) -> DataFrame:
    return compared.groupBy("path").agg(F.count("*").alias("n"),
                                        F.avg(F.col("correct").cast("double")).alias("accuracy"))


def false_validated(compared: DataFrame) -> DataFrame:
    """Wrong and marked verified: any row here blocks a release."""
    return compared.filter("false_validated")


def worst_cases(compared: DataFrame, k: int = 10) -> DataFrame:
    """The k documents with the most wrong fields (a report, hence a top-k)."""
    wrong = document_scores(compared).withColumn("wrong", F.col("total") - F.col("correct"))
    return wrong.orderBy(F.col("wrong").desc(), "doc_id").limit(k).select("doc_id", "wrong")


def latency_quantiles(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Exact p50 and p95."""
    q = scan.exact_quantiles(df, by, value, [0.5, 0.95])
    return q.groupBy(*by).agg(F.max(F.when(F.col("q") == 0.5, F.col("value"))).alias("p50"),
                              F.max(F.when(F.col("q") == 0.95, F.col("value"))).alias("p95"))


def regression_gate(metrics: DataFrame, baseline: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """One row: whether exact match fell by more than the tolerance (both inputs have one row)."""
    b = baseline.select(F.col("field_exact_match").alias("before"))
    return metrics.select(F.col("field_exact_match").alias("after")).join(b).withColumn(
        "regressed", F.col("after") < F.col("before") - tolerance)


def confusion_matrix(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def per_class_f1(df: DataFrame, classes: int, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """tp, fp, fn and F1 of every class, absent classes included; F1 is 0 when tp is 0."""
    m = confusion_matrix(df, label, predicted)
    both = m.select("n", F.inline(F.array(
        F.struct(F.col("label").alias("c"), F.lit(True).alias("is_label")),
        F.struct(F.col("predicted").alias("c"), F.lit(False).alias("is_label")))), (F.col("label") == F.col("predicted")).alias("hit"))
    counts = both.groupBy("c").agg(
        F.coalesce(F.sum(F.when(F.col("hit") & F.col("is_label"), F.col("n"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(~F.col("hit") & ~F.col("is_label"), F.col("n"))), F.lit(0)).alias("fp"),
        F.coalesce(F.sum(F.when(~F.col("hit") & F.col("is_label"), F.col("n"))), F.lit(0)).alias("fn"))
    every = df.sparkSession.range(classes).select(F.col("id").cast("int").alias("c"))
    full = every.join(counts, "c", "left").na.fill(0, ["tp", "fp", "fn"])
    return full.withColumn("f1", F.when(F.col("tp") == 0, 0.0).otherwise(
        2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))))


def macro_f1(df: DataFrame, classes: int, label: str = "label", predicted: str = "predicted") -> DataFrame:
    return per_class_f1(df, classes, label, predicted).agg(F.avg("f1").alias("macro_f1"))


def calibrate_thresholds(df: DataFrame, unknown: int, logits: str = "logits", label: str = "label") -> DataFrame:
    """min_confidence and max_energy that let 98 % of known documents pass."""
    known = df.filter(F.col(label) != unknown).select(
        F.array_max(scores.softmax(F.col(logits))).alias("p"), scores.free_energy(F.col(logits)).alias("e"))
    low = scan.exact_quantiles(known, [], "p", [0.02]).select(F.col("value").alias("min_confidence"))
    high = scan.exact_quantiles(known, [], "e", [0.98]).select(F.col("value").alias("max_energy"))
    return low.join(high)


def ood_catch_rate(df: DataFrame, unknown: int, max_energy: float, logits: str = "logits", label: str = "label") -> DataFrame:
    """Share of unknown documents above the energy ceiling."""
    e = scores.free_energy(F.col(logits))
    return df.filter(F.col(label) == unknown).agg(F.avg((e > max_energy).cast("double")).alias("caught"))


def stage_timing_summary(results: DataFrame) -> DataFrame:
    """Milliseconds and usage per stage over all documents."""
    t = results.select(F.inline("timings"))
    return t.groupBy("stage").agg(F.count("*").alias("n"), F.sum("ms").alias("ms"), F.avg("ms").alias("avg_ms"),
                                  F.max("ms").alias("max_ms"), F.avg(F.col("used").cast("double")).alias("used_rate"))


def eval_case_audit(cases: DataFrame, checked: DataFrame) -> DataFrame:
    """Per evaluation set: cases, null cases, ungrounded values and whether the set is usable.

    ``cases``: set, id, input_text, has_null; ``checked``: set, id, path, accepted.
    """
    bad = checked.filter(~F.col("accepted")).groupBy("set").agg(F.count("*").alias("ungrounded"))
    sets = cases.groupBy("set").agg(
        F.count("*").alias("cases"), F.count_if("has_null").alias("null_cases"),
        F.count_if(F.trim("input_text") == "").alias("blank_inputs"))
    out = sets.join(bad, "set", "left").na.fill(0, ["ungrounded"])
    return out.withColumn("usable", (F.col("cases") >= 3) & (F.col("null_cases") >= 1)
                          & (F.col("blank_inputs") == 0) & (F.col("ungrounded") == 0))


def expected_values(cases: DataFrame, expected: str = "expected") -> DataFrame:
    """Scalar and table expectations as (…, path, value); rows of a table by position."""
    keys = [c for c in cases.columns if c != expected]
    e = F.col(expected)
    rows = F.from_json(F.get_json_object(e, "$.subjects"), "array<map<string,string>>")
    scalars = F.map_entries(F.map_filter(F.from_json(e, "map<string,string>"), lambda k, v: k != "subjects"))
    table = F.flatten(F.transform(F.coalesce(rows, F.array().cast("array<map<string,string>>")), lambda m, n: F.transform(
        F.map_entries(m), lambda x: F.struct(
            F.concat(F.lit("subjects."), n.cast("string"), F.lit("."), x["key"]).alias("key"), x["value"].alias("value")))))
    return cases.select(*keys, F.inline(F.concat(scalars, table))).withColumnRenamed("key", "path")


def split_train_val(df: DataFrame, key: str, percent: int = 15, seed: int = 0) -> DataFrame:
    """Adds ``split`` from a digest of the key: stable under repartitioning and reruns, and the same in any engine."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))
    place = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 100
    return df.withColumn("split", F.when(place < percent, "val").otherwise("train"))


def score_logits(df: DataFrame, model_factory: Callable[[], Callable[[list], list]], features: str,
                 classes: int) -> DataFrame:
    """Adds ``logits`` by a model opened once per task.

    ``model_factory()`` returns a function from a list of inputs to a list of
    score vectors.  A vector of the wrong length fails the job.
    """
    schema = T.StructType(df.schema.fields + [T.StructField("logits", T.ArrayType(T.DoubleType()))])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for batch in batches:
            if model is None:
                model = model_factory()
            out = [list(map(float, v)) for v in model(batch[features].tolist())]
            for vector in out:
                if len(vector) != classes:
                    raise ValueError(f"model returned {len(vector)} scores for {classes} classes")
            yield batch.assign(logits=out)

    return df.mapInPandas(score, schema)


def label_rows(boxes: DataFrame, width: Column, height: Column) -> DataFrame:
    """Detector label text per box (M9)."""
    return boxes.withColumn("label_row", scores.bbox_to_relative(F.col("bbox"), width, height, F.col("cls")))
