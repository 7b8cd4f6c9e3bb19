"""Canonical field model.

The working format is the long table
``fields(doc_id, path, value, confidence, source, validated, alternatives, note)``:
merging, review, evaluation, corrections and rendering are joins and
aggregations on ``(doc_id, path)``.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

FIELD = T.StructType([
    T.StructField("value", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("source", T.StringType()),
    T.StructField("bbox", T.ArrayType(T.IntegerType())),
    T.StructField("validated", T.BooleanType()),
    T.StructField("alternatives", T.ArrayType(T.StringType())),
    T.StructField("note", T.StringType()),
])

# Field sources, document types and result statuses.
FIELD_SOURCES = ["mrz", "ocr_visual", "llm_text", "vlm", "barcode", "manual", "derived"]
DOCUMENT_TYPES = ["passport_bio", "id_front", "id_back", "diploma",
                  "diploma_supplement", "birth_certificate", "unknown"]
STATUSES = ["ok", "review_needed", "bad_quality", "unknown_doc_type", "failed"]

# The canonical field paths, in schema order.
PERSON_PATHS = [
    "person.name.surname_latin", "person.name.given_name_latin",
    "person.name.patronymic_latin", "person.name.surname_cyrillic",
    "person.name.given_name_cyrillic", "person.name.patronymic_cyrillic",
    "person.birth_date", "person.birth_place", "person.sex",
    "person.nationality", "person.citizenship", "person.pinfl",
    "person.address", "person.phone",
]
DOCUMENT_PATHS = [
    "documents.0.doc_number", "documents.0.doc_series",
    "documents.0.issuing_authority", "documents.0.issue_date",
    "documents.0.expiry_date",
]
EDUCATION_PATHS = [
    "education.institution", "education.degree", "education.speciality",
    "education.speciality_code", "education.graduation_year",
    "education.diploma_number", "education.gpa",
]
SUBJECT_LEAVES = ["name", "hours", "credits", "grade"]
CANONICAL_PATHS = PERSON_PATHS + DOCUMENT_PATHS + EDUCATION_PATHS
ALIAS_PATHS = [p.replace("documents.0", "documents[0]") for p in DOCUMENT_PATHS]
KNOWN_PATHS = sorted(set(CANONICAL_PATHS + ALIAS_PATHS))

# Paths the machine-readable zone can supply, and paths whose
# value must be found verbatim.
MRZ_BACKED = [
    "person.birth_date", "person.sex", "person.nationality",
    "person.citizenship", "person.pinfl", "person.name.surname_latin",
    "person.name.given_name_latin", "documents.0.doc_number",
    "documents.0.expiry_date",
]
EXACT_MATCH_PATHS = [
    "person.pinfl", "documents.0.doc_number", "documents.0.doc_series",
    "education.diploma_number",
]

# Stage order used to break merge ties: an earlier stage keeps its value.
STAGE_RANK = {"mrz": 0, "derived": 0, "ocr_visual": 1, "llm_text": 2, "vlm": 3}


def is_empty(value: Column) -> Column:
    """True when a field value is null or blank."""
    return F.coalesce(F.trim(value), F.lit("")) == ""


def string_array(values: list[str]) -> Column:
    """A literal array<string>, typed even when empty."""
    if not values:
        return F.array().cast("array<string>")
    return F.array(*[F.lit(v) for v in values])


def field_struct(path: Column | str, value: Column, confidence: Column | float,
                 source: Column | str, validated: Column | bool = False,
                 alternatives: Column | None = None, note: Column | None = None) -> Column:
    """One entry of the long field table as a struct Column."""
    def as_col(x):
        return x if isinstance(x, Column) else F.lit(x)

    return F.struct(
        as_col(path).alias("path"),
        value.cast("string").alias("value"),
        as_col(confidence).cast("double").alias("confidence"),
        as_col(source).alias("source"),
        as_col(validated).cast("boolean").alias("validated"),
        (string_array([]) if alternatives is None else alternatives).alias("alternatives"),
        (F.lit(None) if note is None else note).cast("string").alias("note"),
    )
