"""Queries over template analysis, rendering and subject tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from catalog import inputs as i
from catalog.ctes import q, sql, sql_list
from catalog.registry import register
from catalog.scalars import to_cyrillic
from docweir import messages as msg
from docweir.functions import formatting as fmt
from docweir.operators import gates, templates as tpl
from docweir.schema import KNOWN_PATHS

VARS = {
    "v0": r"SELECT template_id, unnest(raws) AS raw, unnest(range(len(raws))) AS seq FROM (SELECT template_id, regexp_extract_all(text, '\{\{\s*([^}]+?)\s*\}\}', 1) AS raws FROM template_texts)",
    "v1": "SELECT template_id, CAST(seq AS INT) AS seq, raw, list_transform(string_split(raw, '|'), lambda x: trim(x)) AS ps FROM v0",
    "v": "SELECT template_id, seq, raw, ps[1] AS path, list_slice(ps, 2, 99) AS filters, NOT contains(array_to_string(list_slice(ps, 2, 99), ' '), 'default') AS required, "
         "regexp_extract(ps[1], '^([^.\\[]*)', 1) AS root FROM v1 WHERE ps[1] <> '' AND NOT regexp_matches(ps[1], '^[%#]')",
    "k": r"SELECT v.*, CASE WHEN list_contains(regexp_extract_all(t.text, '\{%\s*(?:tr\s+)?for\s+(\w+)\s+in\s+([\w.\[\]]+)', 1), root) THEN 'loop' "
         "WHEN root IN ('today', 'doc_type', 'now') THEN 'builtin' WHEN root = 'extra' THEN 'extra' WHEN replace(path, '[0]', '.0') NOT IN ("
         + ", ".join(q(p) for p in KNOWN_PATHS) + ") THEN 'unknown' WHEN required THEN 'required' ELSE 'optional' END AS kind FROM v JOIN template_texts t USING (template_id)",
}


@register("template_vars", sql("SELECT template_id, seq, path, array_to_string(filters, '|') AS filters, required FROM v", "template_texts", **VARS))
def _(spark, d):
    return tpl.template_vars(i.template_texts(spark, d)).select("template_id", "seq", "path", F.array_join("filters", "|").alias("filters"), "required")


@register("template_loops", sql(r"""
SELECT template_id, array_to_string(regexp_extract_all(text, '\{%\s*(?:tr\s+)?for\s+(\w+)\s+in\s+([\w.\[\]]+)', 1), ',') AS aliases,
  array_to_string(regexp_extract_all(text, '\{%\s*(?:tr\s+)?for\s+(\w+)\s+in\s+([\w.\[\]]+)', 2), ',') AS sources FROM template_texts""", "template_texts"))
def _(spark, d):
    loops = tpl.loops(F.col("text"))
    return i.template_texts(spark, d).select("template_id", F.array_join(F.transform(loops, lambda x: x["alias"]), ",").alias("aliases"),
                                             F.array_join(F.transform(loops, lambda x: x["source"]), ",").alias("sources"))


@register("template_conditionals", sql(r"SELECT template_id, array_to_string(regexp_extract_all(text, '\{%\s*if\s+(.+?)\s*%\}', 1), ',') AS conditions FROM template_texts", "template_texts"))
def _(spark, d):
    return i.template_texts(spark, d).select("template_id", F.array_join(tpl.conditionals(F.col("text")), ",").alias("conditions"))


@register("unknown_filters", sql("SELECT DISTINCT template_id, f AS filter FROM (SELECT template_id, trim(string_split(unnest(filters), '(')[1]) AS f FROM v) WHERE f NOT IN ("
                                 + ", ".join(q(x) for x in list(fmt.FILTERS) + ["default"]) + ")", "template_texts", **VARS))
def _(spark, d):
    return tpl.unknown_filters(tpl.template_vars(i.template_texts(spark, d)))


def _names(kind: str, e: str = "path") -> str:
    return f"coalesce(array_to_string(list_sort(list_distinct(list({e}) FILTER (kind = '{kind}'))), ','), '')"


SPEC = (f"SELECT template_id, {_names('required')} AS required, {_names('optional')} AS optional, {_names('extra', 'regexp_replace(path, ' + q('^[^.]*[.]') + ', ' + q('') + ')')} AS extra, "
        f"{_names('unknown')} AS unknown FROM k GROUP BY template_id")


@register("template_spec", sql("SELECT * FROM spec", "template_texts", **VARS, spec=SPEC))
def _(spark, d):
    s = tpl.template_spec(i.template_texts(spark, d))
    return s.select("template_id", *[F.array_join(c, ",").alias(c) for c in ("required", "optional", "extra", "unknown")])


@register("publishable", sql("SELECT template_id, required <> '' AS publishable, template_id % 2 = 0 AS pdf_ok FROM spec", "template_texts", **VARS, spec=SPEC))
def _(spark, d):
    s = tpl.template_spec(i.template_texts(spark, d))
    formats = F.when(F.col("template_id") % 2 == 0, F.array(F.lit("docx"), F.lit("pdf"))).otherwise(F.array(F.lit("docx")))
    return s.select("template_id", gates.publishable(F.col("required")).alias("publishable"), gates.format_supported(F.lit("pdf"), formats).alias("pdf_ok"))


@register("check_for_injection", sql(r"""
SELECT template_id, array_to_string(list_sort(list_distinct(flatten(list_transform(list_concat(regexp_extract_all(text, '(?s)\{\{(.*?)\}\}|\{%(.*?)%\}', 1), regexp_extract_all(text, '(?s)\{\{(.*?)\}\}|\{%(.*?)%\}', 2)),
  lambda e: regexp_extract_all(e, '__class__|__mro__|__subclasses__|__globals__|\bself\b|\bconfig\b|\brequest\b'))))), ',') AS hits FROM template_texts""", "template_texts"))
def _(spark, d):
    return i.template_texts(spark, d).select("template_id", F.array_join(gates.check_for_injection(F.col("text")), ",").alias("hits"))


@register("unbalanced_tags", sql("SELECT template_id, (length(text) - length(replace(text, '{{', ''))) <> (length(text) - length(replace(text, '}}', ''))) AS unbalanced FROM template_texts", "template_texts"))
def _(spark, d):
    return i.template_texts(spark, d).select("template_id", gates.unbalanced_tags(F.col("text")).alias("unbalanced"))


@register("unknown_variables", sql("SELECT DISTINCT template_id, path, CASE path WHEN 'person.middle_name' THEN 'person.name.patronymic_latin' ELSE '' END AS suggestion FROM k WHERE kind = 'unknown'", "template_texts", **VARS))
def _(spark, d):
    return tpl.unknown_variables(i.template_texts(spark, d)).select("template_id", "path", F.coalesce("suggestion", F.lit("")).alias("suggestion"))


# --- rendering ------------------------------------------------------------------------

def fields(spark, d):
    sex = i.persons(spark, d).select("doc_id", F.lit("person.sex").alias("path"), F.col("sex").alias("value"))
    return i.golden(spark, d).unionByName(sex).withColumn("value", F.when(
        (F.col("doc_id") % 4 == 0) & (F.col("path") == "person.pinfl"), F.lit(" ")).otherwise(F.col("value")))


def pairs(spark, d):
    return i.persons(spark, d).select("doc_id", F.explode(F.array(
        (F.col("doc_id") % 6).cast("int"), ((F.col("doc_id") + 1) % 6).cast("int"))).alias("template_id"))


PAIRS = "SELECT doc_id, CAST(unnest([doc_id % 6, (doc_id + 1) % 6]) AS INT) AS template_id FROM persons"


def extras(spark, d):
    k = F.col("doc_id")
    return i.persons(spark, d).select("doc_id", F.map_from_arrays(
        F.array(F.lit("today"), F.lit("salary")), F.array(F.lit("2026-01-01"), (k * 1000).cast("string"))).alias("extra"))


_REQ = {t: sorted({m.split("|")[0].strip() for m in re.findall(r"\{\{\s*([^}]+?)\s*\}\}", text)
                   if "default" not in m and m.split("|")[0].strip() in KNOWN_PATHS}) for t, text in i.TEMPLATES.items()}
REQ = "SELECT * FROM (VALUES " + ", ".join(f"({t}, {q(p)})" for t, ps in _REQ.items() for p in ps) + ") AS t(template_id, path)"
_has = "('person.name.surname_latin', 'person.birth_date', 'documents[0].doc_number', 'person.sex')"


def _required(spark):
    s = tpl.template_spec(i.templates(spark))
    return s.select("template_id", F.explode("required").alias("path"))


@register("missing_fields", sql(f"SELECT template_id, doc_id, path FROM pairs JOIN req USING (template_id) WHERE path NOT IN {_has} AND NOT (path = 'person.pinfl' AND doc_id % 4 <> 0)", "persons", pairs=PAIRS, req=REQ))
def _(spark, d):
    return tpl.missing_fields(_required(spark), fields(spark, d), pairs(spark, d))


@register("filled_fields", sql(f"SELECT template_id, doc_id, string_agg(path, ',' ORDER BY path) AS filled FROM pairs JOIN req USING (template_id) WHERE path IN {_has} OR (path = 'person.pinfl' AND doc_id % 4 <> 0) GROUP BY template_id, doc_id",
                               "persons", pairs=PAIRS, req=REQ))
def _(spark, d):
    req = _required(spark)
    missing = tpl.missing_fields(req, fields(spark, d), pairs(spark, d)).groupBy("template_id", "doc_id").agg(F.collect_set("path").alias("m"))
    every = pairs(spark, d).join(req, "template_id").groupBy("template_id", "doc_id").agg(F.collect_set("path").alias("r"))
    out = every.join(missing, ["template_id", "doc_id"], "left")
    return out.select("template_id", "doc_id", F.array_join(tpl.filled_fields(F.col("r"), F.coalesce("m", F.array().cast("array<string>"))), ",").alias("filled")).filter("filled <> ''")


@register("build_context", sql(f"""
SELECT doc_id, surname, CASE WHEN doc_id % 4 = 0 THEN {q(fmt.BLANK)} ELSE pinfl END AS pinfl, '2026-01-01' AS today, CAST(doc_id * 1000 AS VARCHAR) AS salary FROM persons""", "persons"))
def _(spark, d):
    c = tpl.contexts(fields(spark, d), extras(spark, d))
    return c.select("doc_id", *[F.element_at("ctx", F.lit(k)).alias(a) for k, a in (
        ("person.name.surname_latin", "surname"), ("person.pinfl", "pinfl"), ("today", "today"), ("extra.salary", "salary"))])


_iso = "strftime({}, '%Y-%m-%d')"
_PATH = {"person.name.surname_latin": "surname", "person.birth_date": _iso.format("birth"), "documents[0].doc_number": "doc_no", "person.sex": "sex",
         "person.pinfl": f"(CASE WHEN doc_id % 4 = 0 THEN {q(fmt.BLANK)} ELSE pinfl END)", "today": "'2026-01-01'", "extra.salary": "CAST(doc_id * 1000 AS VARCHAR)"}


def _words_sql(e: str) -> str:
    from catalog.scalars import _amount
    return f"(SELECT CASE WHEN n = 0 THEN 'nol' ELSE {_amount} END FROM (SELECT CAST({e} AS BIGINT) AS n))"


def _date_sql(e: str, shape: str) -> str:
    return f"(CASE WHEN try_cast({e} AS DATE) IS NULL THEN {e} ELSE {shape.format(f'try_cast({e} AS DATE)')} END)"


_FILTER = {
    "date_uz": lambda e: _date_sql(e, "day({0}) || '-' || " + sql_list(fmt.MONTHS_UZ) + "[month({0})] || ', ' || year({0}) || '-yil'"),
    "date_ru": lambda e: _date_sql(e, "day({0}) || ' ' || " + sql_list(fmt.MONTHS_RU) + "[month({0})] || ' ' || year({0}) || ' г.'"),
    "date_uz_short": lambda e: _date_sql(e, "strftime({0}, '%d.%m.%Y')"), "date_iso": lambda e: e,
    "upper_uz": lambda e: f"upper({e})", "cyrillic": to_cyrillic, "initials": lambda e: e, "shout": lambda e: e,
    "pinfl_spaced": lambda e: f"(CASE WHEN length(regexp_replace({e}, '[^0-9]', '', 'g')) = 14 THEN regexp_replace({e}, '^(.)(.{{4}})(.{{4}})(.{{4}})(.)$', '\\1 \\2 \\3 \\4 \\5') ELSE {e} END)",
    "amount_words": _words_sql,
}


def render_sql(text: str) -> str:
    """One literal template as a SQL expression over a person row."""
    out, at = [], 0
    block = re.compile(r"\{%tr for s in [\w.]+ %\}\{\{ s\.name \}\}(?P<loop>\{%tr endfor %\})|\{% if ([\w.]+) == '(\w)' %\}(.*?)\{% else %\}(.*?)\{% endif %\}|\{\{\s*([^}]+?)\s*\}\}", re.S)
    for m in block.finditer(text):
        out.append(q(text[at:m.start()]))
        at = m.end()
        if m["loop"]:
            out.append("(CASE WHEN doc_id % 3 = 0 THEN '' ELSE surname || given END)")
            continue
        if m.group(2):
            out.append(f"(CASE WHEN {_PATH[m.group(2)]} = {q(m.group(3))} THEN {q(m.group(4))} ELSE {q(m.group(5))} END)")
            continue
        parts = [x.strip() for x in m.group(6).split("|")]
        default = next((re.match(r"default\('?(.*?)'?\)$", f).group(1) for f in parts[1:] if f.startswith("default")), None)
        e = _PATH.get(parts[0], q(default if default is not None else ("" if parts[0].startswith("extra.") else fmt.BLANK)))
        for f in parts[1:]:
            if not f.startswith("default"):
                e = _FILTER[f](e)
        out.append(e)
    out.append(q(text[at:]))
    return " || ".join(out)


RENDER = "SELECT template_id, doc_id, CASE template_id " + " ".join(f"WHEN {t} THEN {render_sql(x)}" for t, x in i.TEMPLATES.items()) + " END AS text FROM pairs JOIN persons USING (doc_id)"


def _rendered(spark, d):
    subjects = F.transform(F.array("surname", "given"), lambda x: F.create_map(F.lit("name"), x))
    rows = i.persons(spark, d).select("doc_id", F.when(F.col("doc_id") % 3 != 0, subjects).alias("subjects"))
    ctx = tpl.contexts(fields(spark, d), extras(spark, d)).join(rows, "doc_id")
    return tpl.render(i.templates(spark), ctx, pairs(spark, d), "subjects")


@register("render_text", sql("SELECT * FROM rendered", "persons", pairs=PAIRS, rendered=RENDER))
def _(spark, d):
    return _rendered(spark, d)


@register("render_conditional", sql("""SELECT doc_id, 'Xodim ' || CASE WHEN sex = 'F' THEN 'parvarish ta''tiliga' ELSE 'mehnat ta''tiliga' END || ' chiqadi.' AS text FROM persons""", "persons"))
def _(spark, d):
    body = F.lit("Xodim {% if person.sex == 'F' %}parvarish ta'tiliga{% else %}mehnat ta'tiliga{% endif %} chiqadi.")
    return tpl.contexts(fields(spark, d)).select("doc_id", tpl.render_conditionals(body, F.col("ctx")).alias("text"))


@register("render_loop_rows", sql("""
SELECT doc_id, 'Fan|' || CASE WHEN doc_id % 3 = 0 THEN '' ELSE surname || ':180;' || given || CASE WHEN doc_id % 2 = 0 THEN ':____________;' ELSE ':90$;' END END AS text FROM persons""", "persons"))
def _(spark, d):
    k = F.col("doc_id")

    def row(name, hours):
        return F.map_from_arrays(F.array(F.lit("name"), F.lit("hours")), F.array(name, hours))
    subjects = F.when(k % 3 == 0, F.array().cast("array<map<string,string>>")).otherwise(F.array(
        row(F.col("surname"), F.lit("180")), row(F.col("given"), F.when(k % 2 != 0, "90$"))))
    body = F.lit("Fan|{%tr for s in education.subjects %}{{ s.name }}:{{ s.hours }};{%tr endfor %}")
    return i.persons(spark, d).select("doc_id", tpl.render_loops(body, subjects).alias("text"))


@register("dangling_tags", sql("SELECT template_id, doc_id FROM rendered WHERE (contains(text, '{{') OR contains(text, '{%'))", "persons", pairs=PAIRS, rendered=RENDER))
def _(spark, d):
    return tpl.dangling_tags(_rendered(spark, d)).select("template_id", "doc_id")


@register("template_tokens", sql(r"""
SELECT template_id, length(regexp_replace(text, '\{\{\s*([^}]+?)\s*\}\}', '', 'g')) AS literal_chars, len(regexp_extract_all(text, '\{\{\s*([^}]+?)\s*\}\}')) AS variables FROM template_texts""", "template_texts"))
def _(spark, d):
    t = tpl.tokens(i.template_texts(spark, d))
    return t.groupBy("template_id").agg(F.sum(F.coalesce(F.length("literal"), F.lit(0))).alias("literal_chars"), F.count("path").alias("variables"))


@register("missing_warning", sql(f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE (doc_id % 3) || {q(msg.MISSING_REQUIRED)} END AS warning FROM persons", "persons"))
def _(spark, d):
    m = F.slice(F.array(F.lit("a"), F.lit("b")), F.lit(1), (F.col("doc_id") % 3).cast("int"))
    return i.persons(spark, d).select("doc_id", F.coalesce(tpl.missing_warning(m), F.lit("")).alias("warning"))


# --- tables and schemas -----------------------------------------------------------------

@register("parse_subject_table", sql("""
SELECT doc_id, CAST(n AS INT) AS row_no, name, coalesce(hours, '') AS hours, coalesce(credits, '') AS credits, coalesce(grade, '') AS grade FROM (
 SELECT doc_id, 0 AS n, surname AS name, '180' AS hours, CASE WHEN doc_id % 2 = 0 THEN '6' END AS credits, 'a''lo' AS grade FROM persons WHERE doc_id % 5 <> 0
 UNION ALL SELECT doc_id, 1, given, '90', '3', NULL FROM persons WHERE doc_id % 5 <> 0 UNION ALL SELECT doc_id, 2, given, '90', '3', 'yaxshi' FROM persons WHERE doc_id % 5 <> 0)""", "persons"))
def _(spark, d):
    k = F.col("doc_id")
    head = F.when(k % 3 == 0, "Baho | Fan nomi | Soat | Kredit").otherwise("Fan nomi | Soat | Kredit | Baho")

    def line(name, hours, credits, grade):
        return F.when(k % 3 == 0, F.concat_ws(" | ", grade, name, hours, credits)).otherwise(F.concat_ws(" | ", name, hours, credits, grade))
    six = F.when(k % 2 == 0, "6").otherwise("")
    body = F.concat_ws("\n", F.lit("ILOVA"), head, line(F.col("surname"), F.lit("180"), six, F.lit("a'lo")), line(F.col("given"), F.lit("90"), F.lit("3"), F.lit("")),
                       head, line(F.col("given"), F.lit("90"), F.lit("3"), F.lit("yaxshi")), line(F.lit("JAMI"), F.lit("360"), F.lit("12"), F.lit("")),
                       line(F.lit(""), F.lit("1"), F.lit("1"), F.lit("x")))
    text = F.when(k % 5 == 0, F.concat_ws("\n", F.lit("ILOVA"), head)).otherwise(body)
    out = tpl.parse_subject_table(i.persons(spark, d).select("doc_id", text.alias("text")))
    return out.select("doc_id", "row_no", "name", *[F.coalesce(c, F.lit("")).alias(c) for c in ("hours", "credits", "grade")])


@register("request_schema", sql("""
SELECT doc_id, '{"type":"object","properties":{"' || a || '":{"type":["string","null"]},"person.phone":{"type":["string","null"]}},"required":["' || a || '","person.phone"],"additionalProperties":false}' AS schema
FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'person.pinfl' ELSE 'person.address' END AS a FROM persons)""", "persons"))
def _(spark, d):
    a = F.when(F.col("doc_id") % 2 == 0, "person.pinfl").otherwise("person.address")
    return i.persons(spark, d).select("doc_id", tpl.request_schema(F.array(a, F.lit("person.phone"))).alias("schema"))
