"""Merging competing values and moving between nested and long form
(W1, A1, A2, J2-J4, N16, T1, T2, U1-U7, X1-X3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docweir import messages as msg
from docweir.functions.similarity import fuzz_ratio
from docweir.functions.text import norm_for_compare
from docweir.operators.gates import confidence_band
from docweir.schema import (CANONICAL_PATHS, DOCUMENT_PATHS, EDUCATION_PATHS, FIELD,
                            KNOWN_PATHS, PERSON_PATHS, STAGE_RANK, SUBJECT_LEAVES, is_empty,
                            string_array)

THRESHOLD = 0.75
BAND_RANK = {"doubtful": 0, "uncertain": 1, "confident": 2}


def known_paths(spark: SparkSession) -> DataFrame:
    """Canonical paths and their bracket aliases, without duplicates."""
    return spark.createDataFrame([(p,) for p in KNOWN_PATHS], "path string")


def ocr_text(lines: DataFrame) -> DataFrame:
    """Document text: its lines in order, joined by a line feed."""
    return lines.groupBy("doc_id").agg(F.expr(
        "listagg(text, '\\n') within group (order by line_no)").alias("text"))


def merge_fields(candidates: DataFrame, keys: tuple[str, ...] = ("doc_id", "path"),
                 rank: str = "stage_rank") -> DataFrame:
    """One winning value per key.

    A validated value wins, the earliest stage first; otherwise the highest
    confidence wins and ties keep the earlier stage, then the smaller value.  One aggregation whose
    partial step keeps a single row per key and task, so repeated candidates
    for a hot key never travel.
    """
    rest = [c for c in candidates.columns if c not in keys]
    order = F.struct(
        F.when(F.col("validated"), 0).otherwise(1).alias("a"),
        F.when(F.col("validated"), F.lit(0.0)).otherwise(-F.col("confidence")).alias("b"),
        F.col(rank).alias("c"), F.col("value").alias("d"))
    best = F.min_by(F.struct(*rest), order).alias("_best")
    return candidates.groupBy(*keys).agg(best).select(*keys, "_best.*")


def resolved(threshold: float = THRESHOLD) -> Column:
    return ~is_empty(F.col("value")) & (F.col("confidence") >= threshold)


def paths_for(doc_type: Column | None = None) -> Column:
    """Schema-ordered paths of a document; education only for diploma types."""
    core = string_array(PERSON_PATHS + DOCUMENT_PATHS)
    if doc_type is None:
        return core
    return F.when(doc_type.contains("diploma"), string_array(CANONICAL_PATHS)).otherwise(core)


def review_summary(fields: DataFrame, threshold: float = THRESHOLD,
                   doc_type: Column | None = None) -> DataFrame:
    """Per document: overall_confidence, needs_review (schema order) and status."""
    filled = F.when(~is_empty(F.col("value")), F.col("confidence"))
    sums = fields.groupBy("doc_id").agg(
        F.coalesce(F.sum(filled) / F.count(filled), F.lit(0.0)).alias("overall_confidence"),
        F.collect_set(F.when(resolved(threshold), F.col("path"))).alias("_done"),
        *([] if doc_type is None else [F.first("doc_type", ignorenulls=True).alias("doc_type")]))
    out = sums.withColumn("needs_review", F.array_except(paths_for(doc_type), "_done"))
    return out.withColumn("status", F.when(F.size("needs_review") > 0, "review_needed")
                          .otherwise("ok")).drop("_done")


def unresolved_requests(needs_review: Column, limit: int = 25) -> Column:
    """All open fields in schema order, as requests of at most ``limit`` fields each."""
    starts = F.filter(F.sequence(F.lit(0), F.size(needs_review), F.lit(limit)), lambda at: at < F.size(needs_review))
    return F.transform(starts, lambda at: F.slice(needs_review, at + 1, limit))


def review_queue(fields: DataFrame) -> DataFrame:
    """Fields ordered for the reviewer: doubtful, uncertain, confident."""
    ranks = F.create_map(*[F.lit(x) for kv in BAND_RANK.items() for x in kv])
    banded = fields.withColumn("band", confidence_band(F.col("validated"), F.col("confidence")))
    return banded.withColumn("band_rank", F.element_at(ranks, F.col("band"))) \
        .orderBy("band_rank", "doc_id", "path")


def merge_pages(pages: DataFrame) -> DataFrame:
    """Best field over the pages of a document; empty values never replace one."""
    usable = pages.filter(~is_empty(F.col("value")))
    return merge_fields(usable, rank="page")


def merge_page_summaries(pages: DataFrame) -> DataFrame:
    """Union of stages (sorted) and warnings (first occurrence order) per document.

    Distinct entries are reduced before they are collected, so the collected
    arrays are bounded by the distinct stages and warnings of one document.
    """
    stages = pages.select("doc_id", F.explode("stages_used").alias("s")).groupBy("doc_id").agg(
        F.array_sort(F.collect_set("s")).alias("stages_used"))
    each = pages.select("doc_id", "page", F.posexplode("warnings").alias("pos", "w"))
    first = each.groupBy("doc_id", "w").agg(F.min(F.struct("page", "pos")).alias("at"))
    warnings = first.groupBy("doc_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("at", "w"))), lambda x: x["w"]).alias("warnings"))
    return stages.join(warnings, "doc_id", "left").withColumn(
        "warnings", F.coalesce("warnings", string_array([])))


def append_warnings(have: Column, more: Column) -> Column:
    """Append without duplicates, order kept."""
    return F.concat(have, F.array_except(more, have))


def cross_check(zone: DataFrame, visual: DataFrame, threshold: int = 85) -> DataFrame:
    """Discrepancies between two readings of the same keys (doc_id, key, value).

    Numbers must agree exactly; texts may differ up to the similarity threshold.
    Only unequal texts reach the similarity UDF.
    """
    a = zone.select("doc_id", "key", F.col("value").alias("a"), norm_for_compare(F.col("value")).alias("na"))
    b = visual.select("doc_id", "key", F.col("value").alias("b"), norm_for_compare(F.col("value")).alias("nb"))
    both = a.join(b, ["doc_id", "key"]).filter(
        (F.col("na") != "") & (F.col("nb") != "") & (F.col("na") != F.col("nb")))
    numeric = F.col("na").rlike("^[0-9]+$") | F.col("nb").rlike("^[0-9]+$")
    score = fuzz_ratio(F.when(~numeric, F.col("na")), F.when(~numeric, F.col("nb")))
    scored = both.withColumn("numeric", numeric).withColumn("score", score)
    return scored.filter(F.col("numeric") | (F.col("score") < threshold)).select(
        "doc_id", "key", "a", "b", F.concat(
            F.lit(msg.ZONES_DIFFER), "key", F.lit("): '"), "a", F.lit("' / '"), "b",
            F.lit("'")).alias("warning"))


def keys_in_both(zone: DataFrame, visual: DataFrame, *keys: str) -> DataFrame:
    """Distinct ``keys`` (doc_id and path, if none are named) that two readings both have, nulls equal (U4)."""
    keys = keys or ("doc_id", "path")
    return zone.select(*keys).intersect(visual.select(*keys))


def mrz_in_visual(fields: DataFrame, texts: DataFrame) -> DataFrame:
    """Zone surname and number that do not occur in the rest of the document text.

    ``texts`` (doc_id, text) should leave the zone lines themselves out.
    """
    keys = F.create_map(F.lit("person.name.surname_latin"), F.lit("surname"),
                        F.lit("documents.0.doc_number"), F.lit("doc_number"))
    wanted = (fields.withColumn("key", F.try_element_at(keys, F.col("path")))
              .filter(F.col("key").isNotNull() & (F.col("source") == "mrz")
                      & ~is_empty(F.col("value"))))
    missing = wanted.join(texts.select("doc_id", F.upper("text").alias("_t")), "doc_id").filter(
        ~F.contains(F.col("_t"), F.upper("value")))
    return missing.select("doc_id", "key", "value", F.concat(
        F.lit(msg.NOT_ON_FACE[0]), "key", F.lit(msg.NOT_ON_FACE[1])).alias("warning"))


# --- nested <-> long ---------------------------------------------------------

def _positions(fields: Column, start: str) -> Column:
    """The positions of a list that a map of fields knows, in order."""
    own = F.filter(F.map_keys(fields), lambda p: F.startswith(p, F.lit(start)))
    at = F.transform(own, lambda p: F.split_part(F.substr(p, F.lit(len(start) + 1)), F.lit("."), F.lit(1)).cast("int"))
    return F.array_sort(F.array_distinct(at))


def _nested(get) -> dict[str, Column]:
    """Nested result columns, each leaf built by ``get(path)``, a path being text or a column."""
    def group(paths: list[str], prefix: str) -> list[Column]:
        return [get(p).alias(p[len(prefix):]) for p in paths]

    def items(start: str, leaves: list[str]) -> Column:
        return F.transform(_positions(F.col("_m"), start), lambda i: F.struct(*[
            get(F.concat(F.lit(start), i.cast("string"), F.lit(f".{leaf}"))).alias(leaf) for leaf in leaves]))

    names = [p for p in PERSON_PATHS if p.startswith("person.name.")]
    person = F.struct(
        F.struct(*group(names, "person.name.")).alias("name"),
        *[get(p).alias(p[len("person."):]) for p in PERSON_PATHS if p not in names])
    found = items("documents.", [p.split(".")[-1] for p in DOCUMENT_PATHS])
    return {"person": person,
            # A result always has a document, if only an empty one.
            "documents": F.when(F.size(found) > 0, found).otherwise(F.array(F.struct(*group(DOCUMENT_PATHS, "documents.0.")))),
            "education": F.struct(*group(EDUCATION_PATHS, "education."), items("education.subjects.", SUBJECT_LEAVES).alias("subjects"))}


_LISTED = (r"^(?:documents\.(?:0|[1-9][0-9]{0,5})\.(?:" + "|".join(p.split(".")[-1] for p in DOCUMENT_PATHS)
           + r")|education\.subjects\.(?:0|[1-9][0-9]{0,5})\.(?:" + "|".join(SUBJECT_LEAVES) + "))$")


def unflatten(fields: DataFrame) -> DataFrame:
    """Long fields to one nested row per document; absent paths are empty fields.

    ``documents.<n>.…`` and ``education.subjects.<n>.…`` become lists in the order of
    their positions, gaps closed.  Of a path that comes several times the value
    stands that ``merge_fields`` picks (the source tells the stage).  Unknown paths
    are left out.
    """
    leaf = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in fields.columns
                      else F.lit(None).cast(f.dataType).alias(f.name) for f in FIELD.fields])
    known = fields.filter(F.col("path").isin(PERSON_PATHS + EDUCATION_PATHS) | F.col("path").rlike(_LISTED))
    ranks = F.create_map(*[F.lit(x) for kv in STAGE_RANK.items() for x in kv])
    rows = known.select("doc_id", "path", leaf.alias("field")).select(
        "doc_id", "path", "field", F.coalesce("field.validated", F.lit(False)).alias("validated"),
        F.coalesce("field.confidence", F.lit(0.0)).alias("confidence"), F.col("field.value").alias("value"),
        F.coalesce(F.try_element_at(ranks, F.col("field.source")), F.lit(9)).alias("stage_rank"))
    grouped = merge_fields(rows).groupBy("doc_id").agg(F.map_from_entries(
        F.collect_list(F.struct("path", "field"))).alias("_m"))
    blank = F.struct(*[
        (string_array([]) if f.name == "alternatives" else
         F.lit({"confidence": 0.0, "source": "ocr_visual", "validated": False}.get(f.name)))
        .cast(f.dataType).alias(f.name) for f in FIELD.fields])

    def get(path: str | Column) -> Column:
        return F.coalesce(F.try_element_at("_m", F.lit(path) if isinstance(path, str) else path), blank)

    return grouped.select("doc_id", *[c.alias(n) for n, c in _nested(get).items()])


def flatten_result(results: DataFrame) -> DataFrame:
    """Nested rows to the long field table, repeated documents and subjects by position."""
    def entries(prefix: str, paths: list[str], root: Column) -> list[Column]:
        out = []
        for p in paths:
            leaf = root
            for part in p[len(prefix):].split("."):
                leaf = leaf[part]
            out.append(F.struct(F.lit(p).alias("path"), leaf.alias("field")))
        return out

    def listed(items: Column, start: str, leaves: list[str]) -> Column:
        return F.flatten(F.transform(items, lambda x, i: F.array(*[F.struct(
            F.concat(F.lit(start), i.cast("string"), F.lit(f".{leaf}")).alias("path"), x[leaf].alias("field")) for leaf in leaves])))

    education = F.array(*entries("education.", EDUCATION_PATHS, F.col("education")))
    if "subjects" in results.schema["education"].dataType.names:
        education = F.concat(education, listed(F.coalesce(F.col("education.subjects"), F.slice(F.col("education.subjects"), 1, 0)),
                                               "education.subjects.", SUBJECT_LEAVES))
    every = F.concat(F.array(*entries("person.", PERSON_PATHS, F.col("person"))),
                     listed(F.col("documents"), "documents.", [p.split(".")[-1] for p in DOCUMENT_PATHS]),
                     F.when(F.col("education").isNotNull(), education).otherwise(F.slice(education, 1, 0)))
    return results.select("doc_id", F.inline(every)).select("doc_id", "path", "field.*")


def get_field(results: DataFrame, path: str) -> DataFrame:
    """(doc_id, value) of one dotted path of the nested form; NULL when absent."""
    node = None
    for part in path.split("."):
        if node is None:
            node = F.col(part)
        elif part.isdigit():
            node = F.get(node, F.lit(int(part)))
        else:
            node = node[part]
    return results.select("doc_id", node["value"].alias("value"))
