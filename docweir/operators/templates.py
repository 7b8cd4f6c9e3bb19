"""Template analysis and text mail-merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from docweir import messages as msg
from docweir.functions import formatting as fmt, patterns as p
from docweir.functions.similarity import fuzz_ratio
from docweir.functions.text import collapse, let, strip
from docweir.operators import gates
from docweir.schema import KNOWN_PATHS, is_empty, string_array
from docweir.session import materialise

# Names the renderer supplies, and the namespace of typed-in values.
BUILTINS = ["today", "doc_type", "now"]
USER_ROOT = "extra"
# Most distinct unknown names whose suggestions are broadcast.
MOST_BROADCAST = 100_000
# Leaf names authors use for canonical ones.
SYNONYMS = {
    "middle_name": "patronymic", "father_name": "patronymic", "otchestvo": "patronymic",
    "last_name": "surname", "first_name": "given_name", "familiya": "surname",
    "ism": "given_name", "dob": "birth_date", "jshshir": "pinfl",
}


def template_vars(templates: DataFrame) -> DataFrame:
    """(template_id, seq, raw, path, filters, required) per variable tag, in order."""
    return _variables(templates).drop("_aliases")


def _variables(templates: DataFrame) -> DataFrame:
    """``template_vars`` with ``_aliases``, the loop names of the template, found once for all its tags."""
    tags = F.regexp_extract_all("text", F.lit(p.VARIABLE), F.lit(1))
    raws = templates.select("template_id", F.posexplode(let(
        F.transform(loops(F.col("text")), lambda x: x["alias"]),
        lambda names: F.transform(tags, lambda raw: F.struct(raw.alias("raw"), names.alias("names"))))).alias("seq", "_tag")).select(
        "template_id", "seq", F.col("_tag.raw").alias("raw"), F.col("_tag.names").alias("_aliases"))
    parts = F.transform(F.split("raw", r"\|"), strip)
    out = raws.withColumn("_p", parts).select(
        "template_id", "seq", "raw", "_aliases", F.get("_p", F.lit(0)).alias("path"),
        F.slice("_p", F.lit(2), F.greatest(F.size("_p"), F.lit(1))).alias("filters"))
    keep = (F.col("path") != "") & ~F.col("path").rlike("^[%#]")
    return out.filter(keep).withColumn(
        "required", ~F.contains(F.array_join("filters", " "), F.lit("default")))


def loops(text: Column) -> Column:
    """array<struct<alias,source>> of loop tags."""
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(p.LOOP), F.lit(1)).alias("alias"),
                        F.regexp_extract_all(text, F.lit(p.LOOP), F.lit(2)).alias("source"))


def conditionals(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(p.CONDITIONAL), F.lit(1))


def filter_name(f: Column) -> Column:
    return strip(F.regexp_extract(f, r"^([^(]*)", 1))


def unknown_filters(variables: DataFrame) -> DataFrame:
    """(template_id, filter) that no function implements."""
    used = variables.select("template_id", F.explode("filters").alias("f")).select(
        "template_id", filter_name(F.col("f")).alias("filter"))
    registry = list(fmt.FILTERS) + ["default"]
    return used.filter((F.col("filter") != "") & ~F.col("filter").isin(registry)).distinct()


def classify_variables(templates: DataFrame) -> DataFrame:
    """Adds ``kind`` to every variable: required, optional, extra, builtin, loop or unknown.

    The loop names of a template go along with its variables, so nothing is joined.
    """
    v = _variables(templates)
    root = F.regexp_extract("path", r"^([^.\[]*)", 1)
    known = F.replace("path", F.lit("[0]"), F.lit(".0")).isin(KNOWN_PATHS) | F.col("path").isin(KNOWN_PATHS)
    kind = (F.when(F.array_contains("_aliases", root), "loop").when(root.isin(BUILTINS), "builtin")
            .when(root == USER_ROOT, "extra").when(~known, "unknown")
            .when(F.col("required"), "required").otherwise("optional"))
    return v.withColumn("kind", kind).drop("_aliases")


def template_spec(templates: DataFrame) -> DataFrame:
    """Per template: sorted distinct required, optional, extra and unknown names, loops, conditions."""
    v = classify_variables(templates)

    def names(kind: str, c: Column) -> Column:
        return F.array_sort(F.collect_set(F.when(F.col("kind") == kind, c)))

    groups = v.groupBy("template_id").agg(
        names("required", F.col("path")).alias("required"), names("optional", F.col("path")).alias("optional"),
        names("extra", F.regexp_replace("path", r"^[^.]*\.", "")).alias("extra"),
        names("unknown", F.col("path")).alias("unknown"))
    shape = templates.select(
        "template_id", F.transform(loops(F.col("text")), lambda x: x["source"]).alias("loops"),
        conditionals(F.col("text")).alias("conditionals"),
        gates.unbalanced_tags(F.col("text")).alias("unbalanced"),
        gates.check_for_injection(F.col("text")).alias("injection"))
    empty = string_array([])
    # Both sides grow with the templates and compress so well that Spark would broadcast one.
    out = shape.join(groups.hint("merge"), "template_id", "left")
    return out.withColumns({c: F.coalesce(c, empty) for c in ("required", "optional", "extra", "unknown")})


def suggest_paths(paths: DataFrame, minimum: float = 70.0) -> DataFrame:
    """(path, suggestion): best canonical path for each unknown one, NULL below the bar.

    Unknown paths come from templates, so there are few of them; each is scored
    against the 31 known leaves.
    """
    leaf = F.regexp_extract("path", r"([^.\[]+)(?:\[[^.]*)?$", 1)
    table = F.create_map(*[F.lit(x) for kv in SYNONYMS.items() for x in kv])
    target = F.coalesce(F.try_element_at(table, leaf), leaf)
    leaves = sorted({k.split(".")[-1]: k for k in KNOWN_PATHS}.items())
    options = F.array(*[F.struct(F.lit(a).alias("leaf"), F.lit(b).alias("known")) for a, b in leaves])
    scored = paths.select("path").distinct().withColumn("_t", target).select("path", "_t", F.inline(options)) \
        .withColumn("score", fuzz_ratio(F.col("_t"), F.col("leaf")))
    w = Window.partitionBy("path").orderBy(F.col("score").desc(), "known")
    best = scored.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    return best.select("path", F.when(F.col("score") >= minimum, F.replace(
        "known", F.lit("documents.0"), F.lit("documents[0]"))).alias("suggestion"))


def unknown_variables(templates: DataFrame) -> DataFrame:
    """(template_id, path, suggestion) for names the schema cannot supply.

    Suggestions are broadcast while there are few names (counted); more meet their
    templates by name.
    """
    unknown = classify_variables(templates).filter("kind = 'unknown'").select("template_id", "path").distinct()
    names = materialise(unknown.select("path").distinct(), "unknown-paths")
    suggested = suggest_paths(names)
    few = names.count() <= MOST_BROADCAST
    return unknown.join(F.broadcast(suggested) if few else suggested.hint("merge"), "path", "left")


def missing_fields(required: DataFrame, fields: DataFrame, pairs: DataFrame) -> DataFrame:
    """(template_id, doc_id, path) required but without a value.

    ``required``: template_id, path; ``pairs``: the (doc_id, template_id) to check.
    """
    need = pairs.join(required, "template_id").withColumn(
        "_path", F.replace("path", F.lit("[0]"), F.lit(".0")))
    filled = fields.filter(~is_empty(F.col("value"))).select("doc_id", F.col("path").alias("_path"))
    return need.join(filled, ["doc_id", "_path"], "left_anti").select("template_id", "doc_id", "path")


def filled_fields(required: Column, missing: Column) -> Column:
    return F.array_sort(F.array_except(required, missing))


def contexts(fields: DataFrame, extras: DataFrame | None = None) -> DataFrame:
    """(doc_id, ctx): map of path to display text; typed-in values also under ``extra.``.

    A path without a value renders as a fill-in line.
    """
    known = fields.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct(
        F.replace("path", F.lit("documents.0"), F.lit("documents[0]")),
        fmt.default_blank(F.col("value"))))).alias("ctx"))
    if extras is None:
        return known
    named = F.transform_keys("extra", lambda k, v: F.concat(F.lit(USER_ROOT + "."), k))
    return known.join(extras.withColumn("_n", named), "doc_id", "left").select("doc_id", F.when(
        F.col("extra").isNull(), F.col("ctx")).otherwise(_overlaid(F.col("ctx"), F.col("extra"), F.col("_n"))).alias("ctx"))


def _overlaid(base: Column, extra: Column, named: Column) -> Column:
    kept = F.map_filter(base, lambda k, v: ~F.map_contains_key(extra, k))
    return F.map_concat(kept, F.map_filter(extra, lambda k, v: ~k.startswith("extra.")), named)


def _default_of(filters: Column) -> Column:
    """Literal inside default('…') or default(0); NULL when there is no default."""
    first = F.get(F.filter(filters, lambda f: f.startswith("default")), F.lit(0))
    return F.regexp_replace(F.regexp_extract(first, r"(?s)^default\((.*)\)$", 1), r"^'|'$", "")


def apply_filters(value: Column, filters: Column) -> Column:
    """Apply named formatting functions from left to right."""
    def step(acc: Column, f: Column) -> Column:
        chain = None
        for name, fn in fmt.FILTERS.items():
            test = f == name
            chain = F.when(test, fn(acc)) if chain is None else chain.when(test, fn(acc))
        return chain.otherwise(acc)

    return F.aggregate(F.transform(filters, filter_name), value, step)


def tokens(templates: DataFrame) -> DataFrame:
    """(template_id, seq, literal, path, filters): text cut at its variable tags."""
    marked = F.split(F.regexp_replace("text", p.VARIABLE, "\u0001V$1\u0001"), "\u0001")
    pieces = templates.select("template_id", F.posexplode(marked).alias("seq", "piece"))
    is_var = F.col("piece").startswith("V") & (F.col("seq") % 2 == 1)
    parts = F.transform(F.split(F.expr("substring(piece, 2)"), r"\|"), strip)
    return pieces.select(
        "template_id", "seq", F.when(~is_var, F.col("piece")).alias("literal"),
        F.when(is_var, F.get(parts, F.lit(0))).alias("path"),
        F.when(is_var, F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1)))).alias("filters"))


def render_conditionals(text: Column, ctx: Column) -> Column:
    """Resolve ``{% if path == 'X' %}a{% else %}b{% endif %}`` from left to right."""
    block = (r"(?s)\{%\s*if\s+([\w.\[\]]+)\s*==\s*'([^']*)'\s*%\}(.*?)"
             r"(?:\{%\s*else\s*%\}(.*?))?\{%\s*endif\s*%\}")
    found = F.regexp_extract_all(text, F.lit(block), F.lit(0))

    def step(acc: Column, b: Column) -> Column:
        path, want = F.regexp_extract(b, block, 1), F.regexp_extract(b, block, 2)
        yes, no = F.regexp_extract(b, block, 3), F.regexp_extract(b, block, 4)
        return F.replace(acc, b, F.when(F.try_element_at(ctx, path) == want, yes).otherwise(no))

    return F.aggregate(found, text, step)


def render_loops(text: Column, rows: Column) -> Column:
    """Repeat ``{%tr for s in … %}body{%tr endfor %}`` once per subject row.

    ``rows`` is array<map<string,string>>; an empty array leaves nothing.
    """
    block = r"(?s)\{%\s*(?:tr\s+)?for\s+(\w+)\s+in\s+[\w.\[\]]+\s*%\}(.*?)\{%\s*(?:tr\s+)?endfor\s*%\}"
    found = F.regexp_extract_all(text, F.lit(block), F.lit(0))

    def step(acc: Column, b: Column) -> Column:
        body = F.regexp_extract(b, block, 2)
        tags = F.regexp_extract_all(body, F.lit(p.VARIABLE), F.lit(1))

        def one(row: Column) -> Column:
            return F.aggregate(tags, body, lambda t, tag: F.regexp_replace(
                t, F.concat(F.lit(r"\{\{\s*\Q"), tag, F.lit(r"\E\s*\}\}")),
                F.regexp_replace(F.coalesce(F.try_element_at(row, F.regexp_replace(tag, r"^\w+\.", "")),
                                            F.lit(fmt.BLANK)), r"([\\$])", r"\\$1")))

        return F.replace(acc, b, F.array_join(F.transform(rows, one), ""))

    return F.aggregate(found, text, step)


def render(templates: DataFrame, ctx: DataFrame, pairs: DataFrame, rows: str | None = None) -> DataFrame:
    """(template_id, doc_id, text): each requested (doc_id, template_id) pair rendered.

    The template text joins the document row by its id and is filled in place, so
    there is no shuffle per tag.
    """
    out = ctx.join(pairs, "doc_id").join(templates.select("template_id", F.col("text").alias("_t")), "template_id")
    if rows is not None:
        out = out.withColumn("_t", render_loops(F.col("_t"), F.coalesce(
            F.col(rows), F.array().cast("array<map<string,string>>"))))
    out = out.withColumn("_t", render_conditionals(F.col("_t"), F.col("ctx")))
    cut = F.split(F.regexp_replace("_t", p.VARIABLE, "\u0001$1\u0001"), "\u0001")

    def piece(x: Column, n: Column) -> Column:
        parts = F.transform(F.split(x, r"\|"), strip)

        def shown(ps: Column) -> Column:
            filters = F.slice(ps, F.lit(2), F.greatest(F.size(ps), F.lit(1)))
            own = F.try_element_at(F.col("ctx"), F.get(ps, F.lit(0)))
            value = F.coalesce(own, _default_of(filters), F.when(
                F.get(ps, F.lit(0)).startswith("extra."), F.lit("")).otherwise(F.lit(fmt.BLANK)))
            return let(F.struct(value.alias("v"), F.filter(
                filters, lambda f: ~f.startswith("default")).alias("f")),
                lambda s: F.when(F.size(s["f"]) == 0, s["v"]).otherwise(apply_filters(s["v"], s["f"])))

        return F.when(n % 2 == 0, x).otherwise(let(parts, shown))

    return out.select("template_id", "doc_id", F.array_join(F.transform(cut, piece), "").alias("text"))


def dangling_tags(rendered: DataFrame) -> DataFrame:
    """Rendered rows that still hold a tag."""
    return rendered.filter(F.col("text").rlike(r"\{\{|\{%"))


def missing_warning(missing: Column) -> Column:
    return F.when(F.size(missing) > 0, F.concat(F.size(missing).cast("string"), F.lit(msg.MISSING_REQUIRED)))


# --- subject tables --------------------------------------------------------------------

# Header words of a subject table per column, and words of total rows.
SUBJECT_HEADERS = {
    "name": ["fan nomi", "название дисциплины", "subject"],
    "hours": ["soat", "часы", "hours", "yuklama"],
    "credits": ["kredit", "кредит", "credits", "ects"],
    "grade": ["baho", "оценка", "grade", "ball"],
}
TOTAL_WORDS = ["jami", "итого", "total", "всего"]


def parse_subject_table(df: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, row_no, name, hours, credits, grade) from ``a | b | c`` lines.

    The first header row decides which column is what; repeated headers, totals
    and rows without a name are dropped, empty cells are NULL, repeated subjects
    stay.  A table without a header gives no rows.
    """
    def cells(line: Column) -> Column:
        return F.transform(F.split(line, r"\|"), collapse)

    def column_of(head: Column, name: str) -> Column:
        words = string_array(SUBJECT_HEADERS[name])
        hit = F.filter(F.transform(head, lambda c, n: F.when(F.array_contains(words, F.lower(c)), n)),
                       lambda n: n.isNotNull())
        return F.get(hit, F.lit(0))

    def is_header(row: Column) -> Column:
        words = string_array([w for ws in SUBJECT_HEADERS.values() for w in ws])
        return F.size(F.filter(row, lambda c: F.array_contains(words, F.lower(c)))) >= 2

    rows = F.filter(F.transform(F.split(text, "\n"), cells), lambda r: F.size(r) >= 2)

    def table(rs: Column) -> Column:
        head = F.get(F.filter(rs, is_header), F.lit(0))
        places = F.struct(*[column_of(head, n).alias(n) for n in SUBJECT_HEADERS])

        def body(at: Column) -> Column:
            def entry(r: Column, n: Column) -> Column:
                return F.struct(n.alias("row_no"), *[F.nullif(F.get(r, at[c]), F.lit("")).alias(c)
                                                     for c in SUBJECT_HEADERS])
            data = F.filter(rs, lambda r: ~is_header(r))
            return F.filter(F.transform(data, entry), lambda s: s["name"].isNotNull() & ~F.lower(s["name"]).isin(TOTAL_WORDS))

        return let(places, body)

    return df.select("doc_id", F.inline(let(rows, table)))


def request_schema(fields: Column) -> Column:
    """JSON schema text a model must answer with: every field string or null."""
    prop = F.lit('{"type":["string","null"]}')
    props = F.array_join(F.transform(fields, lambda f: F.concat(F.lit('"'), f, F.lit('":'), prop)), ",")
    names = F.array_join(F.transform(fields, lambda f: F.concat(F.lit('"'), f, F.lit('"'))), ",")
    return F.concat(F.lit('{"type":"object","properties":{'), props, F.lit('},"required":['), names,
                    F.lit('],"additionalProperties":false}'))
