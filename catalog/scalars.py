"""Queries over scalar functions: normalisation, transliteration, formatting."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs as i
from catalog.ctes import q, sql, sql_list
from catalog.registry import register
from docweir import messages as msg
from docweir.functions import formatting as f, text as t
from docweir.operators import gates, merge
from docweir.schema import KNOWN_PATHS

COMMA = t.TURNED_COMMA
# White space as RE2 spells it.
WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def apostrophes(e: str) -> str:
    return f"translate({e}, {q(t.APOSTROPHES)}, {q(COMMA * len(t.APOSTROPHES))})"


def to_cyrillic(e: str) -> str:
    out = apostrophes(e)
    for latin, cyr in t.LATIN_GROUPS:
        for a, b in {latin.upper(): cyr.upper(), latin.capitalize(): cyr.capitalize(), latin: cyr}.items():
            out = f"replace({out}, {q(a)}, {q(b)})"
    return (f"translate({out}, {q(t.LATIN_SINGLE + t.LATIN_SINGLE.upper() + COMMA)}, "
            f"{q(t.CYRILLIC_SINGLE + t.CYRILLIC_SINGLE.upper() + 'ъ')})")


def to_latin(e: str) -> str:
    out = e
    for cyr, latin in t.CYRILLIC_MANY.items():
        out = f"replace(replace({out}, {q(cyr)}, {q(latin)}), {q(cyr.upper())}, {q(latin[:1].upper() + latin[1:])})"
    return (f"translate({out}, {q(t.CYRILLIC_ONE + t.CYRILLIC_ONE.upper())}, "
            f"{q(t.LATIN_ONE + t.LATIN_ONE.upper())})")


def collapse(e: str) -> str:
    return f"trim(regexp_replace({e}, '{WS}+', ' ', 'g'), ' ')"


def strip(e: str) -> str:
    return f"regexp_replace({e}, '^{WS}+|{WS}+\\z', '', 'g')"


def up(e: str) -> str:
    """Upper case with the sharp s written out, as the JVM and Python do."""
    return f"upper(replace({e}, 'ß', 'SS'))"


def title(e: str) -> str:
    return (f"array_to_string(list_transform(string_split({collapse(apostrophes(e))}, ' '), "
            f"lambda w: {up('substr(w, 1, 1)')} || lower(substr(w, 2))), ' ')")


def display(e: str) -> str:
    return collapse(f"replace({e}, '<', ' ')")


def _text(name, fn, expr):
    """A function over whole document texts; the result is compared by digest."""
    @register(name, f"SELECT doc_id, md5({expr}) AS h FROM documents")
    def query(spark, d):
        return i.table(spark, d, "documents").select("doc_id", F.md5(fn(F.col("text"))).alias("h"))


_text("norm_apostrophes", t.normalize_apostrophes, apostrophes("text"))
_text("latin_to_cyrillic", t.latin_to_cyrillic, to_cyrillic("text"))
_text("cyrillic_to_latin", lambda c: t.cyrillic_to_latin(t.latin_to_cyrillic(c)),
      to_latin(to_cyrillic("text")))
_text("title_case_name", t.title_case_name, title("text"))
_text("normalize_input", t.normalize_input, collapse("text"))
_text("norm_for_compare", t.norm_for_compare, "regexp_replace(" + up('text') + ", '[^A-Z0-9]', '', 'g')")
_text("rule_norm", t.rule_norm, strip(f"lower({apostrophes('text')})"))
_text("digits_only", t.digits,
      r"regexp_replace(text, '[^\p{Nd}\x{b2}\x{b3}\x{b9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}]', '', 'g')")
_text("filter_upper_uz", f.upper_uz, up(apostrophes('text')))
_text("filter_lower_uz", f.lower_uz, f"lower({apostrophes('text')})")


def comparable(e: str) -> str:
    """Marks dropped, upper, A-Z 0-9 and Cyrillic; decomposition by character map."""
    body = e
    for ch, folded in t._FOLD_MANY.items():
        if ord(ch) < 0x400:    # the given tables have none of the others
            body = f"replace({body}, {q(ch)}, {q(folded)})"
    ones, to = "".join(t._FOLD_ONE) + t._FOLD_GONE, "".join(t._FOLD_ONE.values())
    return f"regexp_replace(translate({body}, {q(ones)}, {q(to)}), " r"'[^A-Z0-9\x{0400}-\x{04ff}]', '', 'g')"


_text("norm_for_grounding", t.norm_for_grounding, comparable("text"))


@register("mrz_to_display", sql(f"SELECT doc_id, {display('l3')} AS shown FROM mrz_clean", "mrz_clean"))
def _(spark, d):
    return i.mrz_clean(spark, d).select("doc_id", t.mrz_to_display(F.col("l3")).alias("shown"))


_fold = "regexp_replace(translate(upper({}), '{}''', ''), '[^\\p{{L}}\\p{{N}}]', '<', 'g')"


@register("to_mrz_name", sql(
    "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN s ELSE s || '<<' || g END AS line FROM (SELECT doc_id, "
    + _fold.format(to_latin("surname || ' Oʻgʻ''li'"), COMMA) + " AS s, "
    + _fold.format(to_latin(to_cyrillic("given")), COMMA) + " AS g FROM persons)", "persons"))
def _(spark, d):
    given = F.when(F.col("doc_id") % 3 == 0, "").otherwise(t.latin_to_cyrillic(F.col("given")))
    return i.persons(spark, d).select("doc_id", t.to_mrz_name(
        F.concat("surname", F.lit(" Oʻgʻ'li")), given, F.lit(None).cast("string")).alias("line"))


@register("full_name", sql(
    "SELECT doc_id, concat_ws(' ', surname, NULLIF(CASE WHEN doc_id % 4 = 0 THEN '' ELSE given END, ''), "
    "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'X' END) AS full_name FROM persons", "persons"))
def _(spark, d):
    k = F.col("doc_id")
    return i.persons(spark, d).select("doc_id", t.full_name(
        F.col("surname"), F.when(k % 4 == 0, "").otherwise(F.col("given")),
        F.when(k % 3 != 0, "X")).alias("full_name"))


def line_sql(e: str, width: int) -> str:
    return (f"rpad(regexp_replace(replace(upper({strip(e)}), ' ', '<'), '[^A-Z0-9<]', '', 'g'), "
            f"{width}, '<')")


@register("normalize_line", sql(
    f"SELECT doc_id, line_no, {line_sql('text', 30)} AS line FROM ocr_lines", "ocr_lines"))
def _(spark, d):
    return i.ocr_lines(spark, d).select("doc_id", "line_no",
                                        t.normalize_line(F.col("text"), 30).alias("line"))


@register("norm_lines", sql(
    "SELECT doc_id, CASE WHEN len(ls) = 13 THEN array_to_string(list_transform(ls, lambda x: "
    f"rpad(replace(upper({strip('x')}), ' ', '<'), 30, '<')), '|') ELSE '' END AS lines FROM doc_lines",
    "doc_lines"))
def _(spark, d):
    lines = i.ocr_lines(spark, d).groupBy("doc_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))),
                    lambda x: x["text"]).alias("ls"))
    return lines.select("doc_id", F.coalesce(
        F.array_join(t.norm_lines(F.col("ls"), 13, 30), "|"), F.lit("")).alias("lines"))


@register("extract_json", sql(
    "SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '' ELSE body END AS body FROM replies", "replies"))
def _(spark, d):
    return i.replies(spark, d).select("doc_id", F.coalesce(
        t.extract_json(F.col("reply")), F.lit("")).alias("body"))


@register("ocr_text", sql("SELECT doc_id, text FROM doc_text", "doc_text"))
def _(spark, d):
    return merge.ocr_text(i.ocr_lines(spark, d))


@register("stage_label", sql(
    "SELECT job_id, CASE s " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in t.STAGE_LABELS.items())
    + " ELSE s END AS label FROM (SELECT job_id, CASE WHEN job_id % 7 < 6 THEN "
    + sql_list(t.STAGE_LABELS) + "[job_id % 7 + 1] ELSE status END AS s FROM jobs)", "jobs"))
def _(spark, d):
    names = F.array(*[F.lit(s) for s in t.STAGE_LABELS])
    s = F.when(F.col("job_id") % 7 < 6, F.get(names, (F.col("job_id") % 7).cast("int"))) \
        .otherwise(F.col("status"))
    return i.jobs(spark, d).select("job_id", t.stage_label(s).alias("label"))


# --- formatting filters over order dates and amounts -------------------------

def _order_dates(spark, d):
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    raw = (F.when(k % 5 == 0, "not a date").when(k % 5 == 1, F.date_format(day, "d/M/yyyy"))
           .when(k % 5 == 2, F.date_format(day, "dd.MM.yyyy"))
           .when(k % 5 == 3, F.concat(F.lit("31.02."), F.date_format(day, "yyyy")))
           .otherwise(F.date_format(day, "yyyy-MM-dd")))
    return i.table(spark, d, "orders").select("o_orderkey", raw.alias("raw"))


_dates = """SELECT o_orderkey, CASE WHEN k = 0 THEN 'not a date'
  WHEN k = 1 THEN day(d) || '/' || month(d) || '/' || year(d) WHEN k = 2 THEN strftime(d, '%d.%m.%Y')
  WHEN k = 3 THEN '31.02.' || year(d) ELSE strftime(d, '%Y-%m-%d') END AS raw,
  CASE WHEN k IN (0, 3) THEN NULL ELSE d END AS d
FROM (SELECT o_orderkey, o_orderkey % 5 AS k, o_orderdate AS d FROM orders)"""


def _date_filter(name, fn, expr):
    @register(name, sql(f"SELECT o_orderkey, coalesce({expr}, raw) AS shown FROM dates", dates=_dates))
    def query(spark, d):
        return _order_dates(spark, d).select("o_orderkey", fn(F.col("raw")).alias("shown"))


_date_filter("filter_date_uz", f.date_uz,
             f"day(d) || '-' || {sql_list(f.MONTHS_UZ)}[month(d)] || ', ' || year(d) || '-yil'")
_date_filter("filter_date_uz_short", f.date_uz_short, "strftime(d, '%d.%m.%Y')")
_date_filter("filter_date_ru", f.date_ru,
             f"day(d) || ' ' || {sql_list(f.MONTHS_RU)}[month(d)] || ' ' || year(d) || ' г.'")
_date_filter("filter_date_iso", f.date_iso, "strftime(d, '%Y-%m-%d')")


@register("as_date", sql("SELECT o_orderkey, coalesce(strftime(d, '%Y-%m-%d'), '') AS day FROM dates",
                         dates=_dates))
def _(spark, d):
    return _order_dates(spark, d).select("o_orderkey", F.coalesce(
        F.date_format(f.as_date(F.col("raw")), "yyyy-MM-dd"), F.lit("")).alias("day"))


@register("filter_pinfl_spaced", sql(
    "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN substr(pinfl, 2) ELSE substr(pinfl, 1, 1) || ' ' || "
    "substr(pinfl, 2, 4) || ' ' || substr(pinfl, 6, 4) || ' ' || substr(pinfl, 10, 4) || ' ' || "
    "substr(pinfl, 14, 1) END AS shown FROM persons", "persons"))
def _(spark, d):
    raw = F.when(F.col("doc_id") % 4 == 0, F.expr("substring(pinfl, 2)")).otherwise(F.col("pinfl"))
    return i.persons(spark, d).select("doc_id", f.pinfl_spaced(raw).alias("shown"))


def words3(n: str) -> str:
    return (f"concat_ws(' ', CASE WHEN {n} // 100 > 1 THEN {sql_list(f.ONES)}[CAST({n} // 100 AS INT) + 1] || ' yuz' "
            f"WHEN {n} // 100 = 1 THEN 'yuz' END, NULLIF({sql_list(f.TENS)}[CAST({n} % 100 // 10 AS INT) + 1], ''), "
            f"NULLIF({sql_list(f.ONES)}[CAST({n} % 10 AS INT) + 1], ''))")


_amount = ("concat_ws(' ', " + ", ".join(
    f"CASE WHEN n // {size} % 1000 > 0 THEN trim({'CASE WHEN n // 1000 % 1000 = 1 THEN ' + q('') + ' ELSE ' if size == 1000 else ''}"
    f"{words3(f'(n // {size} % 1000)')}{' END' if size == 1000 else ''} || ' {label}') END"
    for size, label in f.SCALES) + ")")


@register("filter_amount_words", sql(
    f"SELECT l_orderkey, l_linenumber, n, CASE WHEN n = 0 THEN 'nol' ELSE {_amount} END AS words FROM ("
    "SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice) AS BIGINT) * CASE l_linenumber % 4 WHEN 0 "
    "THEN 1 WHEN 1 THEN 1000003 WHEN 2 THEN 0 ELSE 97 END AS n FROM lineitem)"))
def _(spark, d):
    k = F.col("l_linenumber") % 4
    n = F.floor("l_extendedprice").cast("bigint") * F.when(k == 0, 1).when(k == 1, 1000003) \
        .when(k == 2, 0).otherwise(97)
    return i.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", n.cast("bigint").alias("n"),
        f.amount_words(n.cast("bigint").cast("string")).alias("words"))


@register("filter_initials", sql(
    "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN surname WHEN doc_id % 5 = 1 THEN '' ELSE surname || ' ' || "
    "substr(given, 1, 1) || '.O.' END AS shown FROM persons", "persons"))
def _(spark, d):
    k = F.col("doc_id")
    raw = F.when(k % 5 == 0, F.col("surname")).when(k % 5 == 1, "  ").otherwise(
        F.concat("surname", F.lit("  "), F.lower("given"), F.lit(" o'g'li")))
    return i.persons(spark, d).select("doc_id", f.initials(raw).alias("shown"))


@register("filter_cyrillic", sql(f"SELECT doc_id, {to_cyrillic('surname')} AS shown FROM persons", "persons"))
def _(spark, d):
    return i.persons(spark, d).select("doc_id", f.cyrillic(F.col("surname")).alias("shown"))


@register("filter_latin", sql(f"SELECT doc_id, {to_latin(to_cyrillic('surname'))} AS shown FROM persons", "persons"))
def _(spark, d):
    return i.persons(spark, d).select("doc_id", f.latin(f.cyrillic(F.col("surname"))).alias("shown"))


@register("filter_default", sql(
    f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN {q(f.BLANK)} ELSE surname || ' {COMMA}' END AS shown FROM persons",
    "persons"))
def _(spark, d):
    raw = F.when(F.col("doc_id") % 3 == 0, F.lit("  ")).otherwise(F.concat("surname", F.lit(" '")))
    return i.persons(spark, d).select("doc_id", f.default_blank(raw).alias("shown"))


# --- date logic, bands, known paths -----------------------------------------

@register("date_logic_warnings", sql(f"""
SELECT o_orderkey, array_to_string(list_filter([
  CASE WHEN year(birth) < 1900 THEN {q(msg.BIRTH_BEFORE_1900)} END,
  CASE WHEN birth > DATE '1997-01-01' THEN {q(msg.BIRTH_IN_FUTURE)} END,
  CASE WHEN issue < birth THEN {q(msg.ISSUED_BEFORE_BIRTH)} END,
  CASE WHEN expiry <= issue THEN {q(msg.EXPIRY_BEFORE_ISSUE)} END,
  CASE WHEN expiry < DATE '1997-01-01' THEN {q(msg.EXPIRED)} END], lambda x: x IS NOT NULL), '|') AS warnings
FROM (SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 50 = 0 THEN DATE '1890-05-05' ELSE o_orderdate END AS DATE) AS birth,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE DATE '1995-06-01' + CAST(o_custkey % 400 AS INT) END AS issue,
  DATE '1996-01-01' + CAST(o_orderkey % 500 AS INT) AS expiry FROM orders)"""))
def _(spark, d):
    k = F.col("o_orderkey")
    o = i.table(spark, d, "orders").select(
        "o_orderkey",
        F.when(k % 50 == 0, F.lit("1890-05-05").cast("date")).otherwise(
            F.col("o_orderdate").cast("date")).alias("birth"),
        F.when(k % 3 != 0, F.date_add(F.lit("1995-06-01").cast("date"),
                                      (F.col("o_custkey") % 400).cast("int"))).alias("issue"),
        F.date_add(F.lit("1996-01-01").cast("date"), (k % 500).cast("int")).alias("expiry"))
    return o.select("o_orderkey", F.array_join(gates.date_logic_warnings(
        F.col("birth"), F.col("issue"), F.col("expiry"), F.lit("1997-01-01").cast("date")), "|")
        .alias("warnings"))


@register("confidence_band", sql("""
SELECT doc_id, path, CASE WHEN validated OR c >= 0.9 THEN 'confident' WHEN c >= 0.7 THEN 'uncertain' ELSE 'doubtful' END AS band
FROM (SELECT *, CAST(doc_id % 101 AS DOUBLE) / 100 AS c FROM actual)""", "actual"))
def _(spark, d):
    a = i.actual(spark, d).withColumn("confidence", (F.col("doc_id") % 101).cast("double") / 100)
    return a.select("doc_id", "path", gates.confidence_band(
        F.col("validated"), F.col("confidence")).alias("band"))


@register("known_paths_used", sql(f"""
SELECT path, count(*) AS n FROM (SELECT replace(path, 'documents.0', 'documents[0]') AS path FROM corrections
 UNION ALL SELECT path FROM corrections) WHERE path IN ({', '.join(q(p) for p in KNOWN_PATHS)}) GROUP BY path""",
    "corrections"))
def _(spark, d):
    c = i.corrections(spark, d).select("path")
    both = c.unionByName(c.select(F.replace("path", F.lit("documents.0"), F.lit("documents[0]"))
                                  .alias("path")))
    known = merge.known_paths(spark)
    return both.join(F.broadcast(known), "path", "left_semi").groupBy("path").agg(
        F.count("*").alias("n"))
