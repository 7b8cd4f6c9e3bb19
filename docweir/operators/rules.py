"""Label rules over recognised lines.

Every line is tested against the printed labels inside one projection: per
path a CASE chain finds the longest label the line contains, so no join with
the label table is needed.  Only label lines without a value look at the line
below, through an equi-join on (doc_id, line_no) that spreads even a very long
document evenly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docweir.functions import patterns as p
from docweir.functions.text import normalize_apostrophes, rule_norm, strip
from docweir.session import materialise

# The printed labels that introduce each field.
LABELS: dict[str, list[str]] = {
    "person.name.surname_latin": ["familiya", "familiyasi", "фамилия", "surname", "last name"],
    "person.name.given_name_latin": ["ism", "ismi", "имя", "given name", "first name", "name"],
    "person.name.patronymic_latin": ["otasining ismi", "sharifi", "отчество", "patronymic"],
    "person.birth_date": ["tug'ilgan sana", "tugilgan sana", "tug'ilgan sanasi",
                          "дата рождения", "date of birth", "born"],
    "person.birth_place": ["tug'ilgan joy", "tugilgan joy", "tug'ilgan joyi",
                           "место рождения", "place of birth"],
    "person.pinfl": ["jshshir", "jshshr", "pinfl", "пинфл", "жшшир",
                     "personal number", "shaxsiy raqam"],
    "person.address": ["manzil", "yashash manzili", "адрес", "address", "residence"],
    "person.sex": ["jinsi", "jins", "пол", "sex", "gender"],
    "person.nationality": ["millati", "национальность", "nationality"],
    "person.citizenship": ["fuqaroligi", "гражданство", "citizenship"],
    "documents.0.doc_number": ["seriya", "raqam", "seriya raqami", "номер", "серия",
                               "document no", "passport no", "no"],
    "documents.0.issue_date": ["berilgan sana", "berilgan", "дата выдачи", "date of issue"],
    "documents.0.expiry_date": ["amal qilish muddati", "amal qiladi", "срок действия",
                                "date of expiry", "valid until"],
    "documents.0.issuing_authority": ["kim tomonidan berilgan", "bergan organ", "кем выдан",
                                      "issuing authority", "authority"],
    "education.institution": ["oliy ta'lim muassasasi", "universitet", "institut",
                              "учреждение", "institution", "university"],
    "education.speciality": ["mutaxassislik", "yo'nalish", "специальность", "speciality", "major"],
    "education.degree": ["daraja", "malaka", "bakalavr", "magistr", "степень", "degree"],
    "education.diploma_number": ["diplom raqami", "reg. №", "registratsiya raqami", "diploma no"],
    "education.graduation_year": ["bitirgan yili", "tamomlagan", "год окончания",
                                  "graduation year"],
}
LABEL_EDGE = " :;.-—\t"
RULE_CONFIDENCE = 0.80


def ordered_labels(path: str) -> list[str]:
    """Longest first: otherwise a short label would match inside a longer one."""
    return sorted(LABELS[path], key=len, reverse=True)


def _plain(label: str) -> str:
    return label.replace("'", "ʻ").lower().strip()


def _matches(low: Column, label: str, whole_word: bool) -> Column:
    if not whole_word:
        return F.contains(low, F.lit(_plain(label)))
    # The pattern costs many times the plain search, which almost every line fails.
    return F.contains(low, F.lit(_plain(label))) & low.rlike(rf"(?U)(?<!\w)\Q{_plain(label)}\E(?!\w)")


def _place(low: Column, label: str, whole_word: bool) -> Column:
    """Zero-based place where the label starts."""
    if not whole_word:
        return F.instr(low, _plain(label)) - 1
    before = F.regexp_extract(low, rf"(?Us)^(.*?)(?<!\w)\Q{_plain(label)}\E(?!\w)", 1)
    return F.length(before)


def _hit(path: str, low: Column, whole_word: bool) -> Column:
    """Struct(path, end) of the first label of ``path`` that the line contains."""
    chain = None
    for label in ordered_labels(path):
        found = F.struct(F.lit(path).alias("path"),
                         (_place(low, label, whole_word) + len(label)).alias("end"))
        test = _matches(low, label, whole_word)
        chain = F.when(test, found) if chain is None else chain.when(test, found)
    return chain


def coerce(path: Column, raw: Column) -> Column:
    """Canonical form of a raw fragment for its field; NULL when it has none."""
    raw = strip(raw)
    upper = F.upper(raw)
    iso = F.regexp_extract(raw, p.RULE_ISO, 0)
    day, month, year = [F.regexp_extract(raw, p.RULE_DATE, g) for g in (1, 2, 3)]
    dotted = F.when(year != "", F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")))
    date = F.when(iso != "", iso).otherwise(dotted)
    pinfl = F.regexp_extract(F.translate(raw, " ", ""), p.RULE_PINFL, 1)
    number = F.translate(F.regexp_extract(upper, p.RULE_DOC_NUMBER, 1), " ", "")
    sex = F.translate(F.regexp_extract(upper, p.RULE_SEX, 1), "МЖ", "MF")
    year_only = F.regexp_extract(raw, p.RULE_YEAR, 1)
    free = F.regexp_replace(F.regexp_replace(raw, r"(?U)\s{2,}", " "), r"^[ :;.\-]+|[ :;.\-]+$", "")
    text = F.when(F.length(free) > 1, normalize_apostrophes(free))
    value = (F.when(path.endswith("_date"), date).when(path == "person.pinfl", pinfl)
             .when(path == "documents.0.doc_number", number).when(path == "person.sex", sex)
             .when(path == "education.graduation_year", year_only).otherwise(text))
    return F.nullif(value, F.lit(""))


def _with_hits(lines: DataFrame, whole_word: bool) -> DataFrame:
    """(doc_id, line_no, text, hits): the labels of each line, array<struct(path, end)>."""
    low = lines.select("doc_id", "line_no", "text", rule_norm(F.col("text")).alias("_low"))
    # One column for each path keeps the tests in generated code; an array function around them would not.
    each = [f"_h{k}" for k in range(len(LABELS))]
    tested = low.select("doc_id", "line_no", "text", *[
        _hit(path, F.col("_low"), whole_word).alias(name) for name, path in zip(each, LABELS)])
    return tested.select("doc_id", "line_no", "text", F.array_compact(F.array(*each)).alias("hits"))


def _tails(hits: DataFrame) -> DataFrame:
    tail = F.ltrim(F.expr("substring(text, end + 1)"), F.lit(LABEL_EDGE))
    # An inner inline is preceded by a filter on its array, which would test every label again, each on a line normalised anew.
    each = hits.select("doc_id", "line_no", "text", F.inline_outer("hits")).filter(F.col("path").isNotNull())
    return each.select("doc_id", "line_no", "path", strip(tail).alias("tail"))


def label_hits(lines: DataFrame, whole_word: bool = False) -> DataFrame:
    """(doc_id, line_no, path, tail): text after the label, empty when there is none."""
    return _tails(_with_hits(lines, whole_word))


def _next_line(rows: DataFrame, lines: DataFrame, column: str) -> DataFrame:
    below = lines.select("doc_id", (F.col("line_no") - 1).alias("line_no"),
                         F.col("text").alias(column))
    return rows.join(below, ["doc_id", "line_no"], "left")


def map_by_rules(lines: DataFrame, whole_word: bool = False) -> DataFrame:
    """(doc_id, path, value): the first line that yields a value per field.

    ``lines`` has doc_id, dense line_no and text.  A personal number or document
    number without any label is taken from the first line that holds one.
    """
    # Four branches look at the lines, so what they need of each is worked out once and written.
    shown = _with_hits(lines, whole_word).withColumns(_shapes())
    shown = materialise(shown, "label-lines")
    hits = _tails(shown)
    inline = hits.filter(F.col("tail") != "").withColumnRenamed("tail", "raw")
    below = _next_line(hits.filter(F.col("tail") == "").drop("tail"), shown, "raw")
    found = inline.unionByName(below).select(
        "doc_id", "line_no", "path", coerce(F.col("path"), F.col("raw")).alias("value")) \
        .withColumn("fallback", F.lit(0))
    every = found.unionByName(_by_shape(shown).withColumn("fallback", F.lit(1)))
    # Without a value there is no rank; a filter here would work out every value twice.
    rank = F.when(F.col("value").isNotNull(), F.struct("fallback", "line_no"))
    best = every.groupBy("doc_id", "path").agg(F.min_by("value", rank).alias("value"))
    return best.filter(F.col("value").isNotNull())


def _shapes() -> dict[str, Column]:
    """Per line: the personal number and the document number by shape (else empty), and whether a number may go on below."""
    upper = F.upper("text")
    number = F.regexp_extract(upper, p.RULE_DOC_NUMBER, 1)
    # Either number needs six digits, either end two capitals: most lines fail the plain test.
    digits = F.col("text").rlike(r"(?U)\d")
    return {"_pinfl": F.when(digits, F.regexp_extract(F.translate("text", " ", ""), p.RULE_PINFL, 1)),
            "_number": F.when(digits, F.regexp_replace(number, " ", "")),
            "_open": upper.rlike(r"(?U)\b[A-Z]{2}$")}


def unlabelled(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, path, value) found by shape alone.

    A document number may break across two lines after its letters, so a line
    that ends in two capitals is also read together with the one below it.
    """
    return _by_shape(lines.select("doc_id", "line_no", "text").withColumns(_shapes()))


def _by_shape(shown: DataFrame) -> DataFrame:
    same = shown.select("doc_id", "line_no", F.inline(F.array(
        F.struct(F.lit("person.pinfl").alias("path"), F.col("_pinfl").alias("value")),
        F.struct(F.lit("documents.0.doc_number").alias("path"), F.col("_number").alias("value")))))
    same = same.filter(F.col("value") != "")
    open_end = shown.filter(F.col("_open") & (F.coalesce("_number", F.lit("")) == "")).select("doc_id", "line_no", "text")
    broken = _next_line(open_end, shown, "below").select(
        "doc_id", "line_no", F.lit("documents.0.doc_number").alias("path"),
        F.regexp_replace(F.regexp_extract(F.upper(F.concat_ws("\n", "text", "below")),
                                          p.RULE_DOC_NUMBER, 1), " ", "").alias("value"))
    return same.unionByName(broken.filter(F.col("value") != ""))
