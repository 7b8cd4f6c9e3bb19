"""Queries over machine-readable zones: check digits, parsing, repair, fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs as i
from catalog.ctes import ALPHA, q, sql, verify, wsum
from catalog.registry import register
from catalog.scalars import display, line_sql, title, to_cyrillic
from docweir import messages as msg
from docweir.functions import checkdigit as c, text as t
from docweir.operators import mrz, repair

CONF = {ch: alts for ch, alts in repair.confusions().items()}
CONF_VALUES = ", ".join(f"('{a}', '{b}')" for a, alts in sorted(CONF.items()) for b in alts)
CONFUSION = f"SELECT * FROM (VALUES {CONF_VALUES}) AS t(f, c)"
VAL = f"(CASE WHEN {{0}} = '<' THEN 0 ELSE strpos('{ALPHA}', {{0}}) - 1 END)"


# --- scalars ------------------------------------------------------------------

@register("char_value", sql(f"""
SELECT ch, count(*) AS n, CAST(min(CASE WHEN ch = '<' THEN 0 WHEN regexp_full_match(ch, '[0-9A-Z]')
  THEN strpos('{ALPHA}', ch) - 1 ELSE -1 END) AS INT) AS value
FROM (SELECT unnest(string_split(upper(text), '')) AS ch FROM ocr_lines) WHERE ch <> '' GROUP BY ch""", "ocr_lines"))
def _(spark, d):
    chars = i.ocr_lines(spark, d).select(F.explode(F.split(F.upper("text"), "")).alias("ch"))
    return chars.filter("ch <> ''").groupBy("ch").agg(F.count("*").alias("n")).withColumn(
        "value", F.coalesce(c.char_value(F.col("ch")), F.lit(-1)).cast("int"))


@register("check_digit", sql(
    f"SELECT doc_id, CAST({wsum('doc_no')} AS INT) AS a, CAST({wsum('pinfl')} AS INT) AS b, "
    f"CAST({wsum('l1')} AS INT) AS c FROM mrz_ocr", "mrz_ocr"))
def _(spark, d):
    return i.mrz_ocr(spark, d).select(
        "doc_id", c.check_digit(F.col("doc_no"), 9).alias("a"), c.check_digit(F.col("pinfl"), 14).alias("b"),
        c.check_digit(F.col("l1")).alias("c"))


@register("verify_check_digit", sql(
    f"SELECT doc_id, {verify('substr(l1, 6, 9)', 'substr(l1, 15, 1)')} AS number_ok, "
    f"{verify('substr(l2, 1, 6)', 'substr(l2, 7, 1)')} AS birth_ok, "
    f"{verify('substr(l2, 19, 11)', 'substr(l2, 20, 1)')} AS filler_ok FROM mrz_ocr", "mrz_ocr"))
def _(spark, d):
    def cut(col, a, n):
        return F.substring(col, a, n)
    return i.mrz_ocr(spark, d).select(
        "doc_id", c.verify_check_digit(cut("l1", 6, 9), cut("l1", 15, 1), 9).alias("number_ok"),
        c.verify_check_digit(cut("l2", 1, 6), cut("l2", 7, 1), 6).alias("birth_ok"),
        c.verify_check_digit(cut("l2", 19, 11), cut("l2", 20, 1)).alias("filler_ok"))


_zd = ("CASE WHEN regexp_full_match({0}, '[0-9]{{6}}') THEN strftime(try_cast({1} || substr({0}, 1, 2) || '-' || "
       "substr({0}, 3, 2) || '-' || substr({0}, 5, 2) AS DATE), '%Y-%m-%d') END")
_birth_century = "(CASE WHEN CAST(substr({0}, 1, 2) AS INT) > 26 THEN '19' ELSE '20' END)"


def zone_birth(e):
    return _zd.format(e, _birth_century.format(e))


def zone_expiry(e):
    return _zd.format(e, "'20'")


@register("zone_dates", sql(
    f"SELECT doc_id, coalesce({zone_birth('b')}, '') AS birth, coalesce({zone_expiry('e')}, '') AS expiry FROM "
    "(SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '991399' ELSE substr(l2, 1, 6) END AS b, substr(l2, 9, 6) AS e FROM mrz_ocr)",
    "mrz_ocr"))
def _(spark, d):
    b = F.when(F.col("doc_id") % 9 == 0, "991399").otherwise(F.substring("l2", 1, 6))
    z = i.mrz_ocr(spark, d)
    return z.select(
        "doc_id",
        F.coalesce(F.date_format(c.zone_date(b, "birth", i.today()), "yyyy-MM-dd"), F.lit("")).alias("birth"),
        F.coalesce(F.date_format(c.zone_date(F.substring("l2", 9, 6), "expiry", i.today()), "yyyy-MM-dd"),
                   F.lit("")).alias("expiry"))


_pinfl_raw = ("CASE WHEN doc_id % 8 = 0 THEN '9' || substr(pinfl, 2) WHEN doc_id % 8 = 1 THEN substr(pinfl, 1, 3) || '13' || "
              "substr(pinfl, 6) WHEN doc_id % 8 = 2 THEN substr(pinfl, 3) ELSE pinfl END")


@register("decode_pinfl", sql("""
SELECT doc_id, birth IS NOT NULL AS structure_valid, coalesce(strftime(birth, '%Y-%m-%d'), '') AS birth_date,
  CASE WHEN NOT ok OR century IS NULL THEN '' WHEN substr(p, 1, 1) IN ('1', '3', '5') THEN 'M' ELSE 'F' END AS sex,
  CASE WHEN birth IS NULL THEN '' ELSE substr(p, 8, 2) END AS region_code,
  CASE WHEN NOT ok THEN 'PINFL must be exactly 14 digits'
       WHEN century IS NULL THEN 'unknown century/sex marker: ' || substr(p, 1, 1)
       WHEN birth IS NULL THEN 'invalid birth date encoded in PINFL' ELSE '' END AS errors
FROM (SELECT *, CASE WHEN ok AND century IS NOT NULL THEN try_cast(century || substr(p, 6, 2) || '-' || substr(p, 4, 2)
   || '-' || substr(p, 2, 2) AS DATE) END AS birth FROM (
  SELECT doc_id, p, regexp_full_match(p, '[0-9]{14}') AS ok, CASE WHEN substr(p, 1, 1) IN ('1', '2') THEN '18'
    WHEN substr(p, 1, 1) IN ('3', '4') THEN '19' WHEN substr(p, 1, 1) IN ('5', '6') THEN '20' END AS century
  FROM (SELECT doc_id, """ + _pinfl_raw + """ AS p FROM persons)))""", "persons"))
def _(spark, d):
    k = F.col("doc_id")
    p = (F.when(k % 8 == 0, F.expr("concat('9', substring(pinfl, 2))"))
         .when(k % 8 == 1, F.expr("concat(substring(pinfl, 1, 3), '13', substring(pinfl, 6))"))
         .when(k % 8 == 2, F.expr("substring(pinfl, 3)")).otherwise(F.col("pinfl")))
    info = i.persons(spark, d).select("doc_id", c.decode_pinfl(p).alias("x"))
    return info.select("doc_id", "x.structure_valid",
                       F.coalesce(F.date_format("x.birth_date", "yyyy-MM-dd"), F.lit("")).alias("birth_date"),
                       F.coalesce("x.sex", F.lit("")).alias("sex"),
                       F.coalesce("x.region_code", F.lit("")).alias("region_code"),
                       F.array_join("x.errors", "; ").alias("errors"))


# --- parsing ------------------------------------------------------------------

def _slot_sql(layout: mrz.Layout, name: str) -> str:
    s = layout.slots[name]
    return f"substr(n{s.line}, {s.start}, {s.width})"


def _parse_sql(layout: mrz.Layout) -> str:
    comp = " || ".join(f"substr(n{n}, {a}, {w})" for n, a, w in layout.composite)
    cn, cp = layout.composite_digit
    checks = {n: verify(_slot_sql(layout, n), f"substr(n{s.line}, {s.digit}, 1)")
              for n, s in layout.slots.items() if s.digit}
    checks["composite"] = verify(f"({comp})", f"substr(n{cn}, {cp}, 1)")
    errors = ", ".join(f"CASE WHEN NOT {v} THEN 'check digit failed: {n}' END" for n, v in checks.items())
    order = [n for n in list(layout.slots) + ["composite"] if n in checks]
    errors = ", ".join(f"CASE WHEN NOT {checks[n]} THEN 'check digit failed: {n}' END" for n in order)
    cols = ", ".join(f"{_slot_sql(layout, n)} AS {n}" for n in layout.slots)
    return (f"SELECT doc_id, {cols}, array_to_string(list_filter([{errors}], lambda x: x IS NOT NULL), '|') AS errors "
            f"FROM zn")


def _norm_cte(source: str, layout: mrz.Layout) -> str:
    cols = ", ".join(f"{line_sql(f'l{n}', layout.width)} AS n{n}" for n in range(1, layout.count + 1))
    return f"SELECT *, {cols} FROM {source}"


def _parse(df, layout):
    out = mrz.parse_zone(df, layout)
    return out.select("doc_id", *[F.element_at("fields", F.lit(n))["raw"].alias(n) for n in layout.slots],
                      F.array_join("errors", "|").alias("errors"))


@register("parse_td1", sql(_parse_sql(mrz.TD1), "mrz_ocr", zn=_norm_cte("mrz_ocr", mrz.TD1)))
def _(spark, d):
    return _parse(i.mrz_ocr(spark, d), mrz.TD1)


def td3_ocr(spark, d):
    """Two-line zones with a glyph error in the personal number of every sixth person."""
    bad = F.overlay("l2", F.translate(F.substring("l2", 31, 1), i.SMALLEST_FROM, i.SMALLEST_TO), 31, 1)
    return i.mrz_td3(spark, d).withColumn("l2", F.when(F.col("doc_id") % 6 == 0, bad).otherwise(F.col("l2"))) \
        .withColumn("lines", F.array("l1", "l2"))


TD3_OCR = (f"SELECT * EXCLUDE (l2), CASE WHEN doc_id % 6 = 0 THEN substr(l2, 1, 30) || translate(substr(l2, 31, 1), "
           f"'{i.SMALLEST_FROM}', '{i.SMALLEST_TO}') || substr(l2, 32) ELSE l2 END AS l2 FROM mrz_td3")


@register("parse_td3", sql(_parse_sql(mrz.TD3), "mrz_td3", t3=TD3_OCR, zn=_norm_cte("t3", mrz.TD3)))
def _(spark, d):
    return _parse(td3_ocr(spark, d), mrz.TD3)


# --- repair -------------------------------------------------------------------

@register("confusions", sql(
    "SELECT c AS ch, count(*) AS n FROM (SELECT unnest(string_split(l1, '')) AS f FROM mrz_ocr) JOIN conf USING (f) GROUP BY c",
    "mrz_ocr", conf=CONFUSION))
def _(spark, d):
    chars = i.mrz_ocr(spark, d).select(F.explode(F.split("l1", "")).alias("from_ch"))
    return chars.join(F.broadcast(repair.confusion_table(spark)), "from_ch") \
        .groupBy(F.col("to_ch").alias("ch")).agg(F.count("*").alias("n"))


def _alts_sql(charset: str) -> str:
    return (f"coalesce((SELECT string_agg(o, '' ORDER BY o) FROM (SELECT ch AS o WHERE strpos('{charset}', ch) > 0 "
            f"UNION SELECT c FROM conf WHERE f = ch AND strpos('{charset}', c) > 0)), ch)")


@register("alternatives_for", sql(
    f"SELECT ch, n, {_alts_sql(ALPHA + '<')} AS any_ch, {_alts_sql('0123456789')} AS digit_ch FROM "
    "(SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(l1, '')) AS ch FROM mrz_ocr) WHERE ch <> '' GROUP BY ch)",
    "mrz_ocr", conf=CONFUSION))
def _(spark, d):
    chars = i.mrz_ocr(spark, d).select(F.explode(F.split("l1", "")).alias("ch")).filter("ch <> ''") \
        .groupBy("ch").agg(F.count("*").alias("n"))
    return chars.select("ch", "n", F.array_join(repair.alternatives_for(F.col("ch")), "").alias("any_ch"),
                        F.array_join(repair.alternatives_for(F.col("ch"), repair.DIGITS), "").alias("digit_ch"))


def zone_parts(spark, d):
    """Long repair input (doc_id, name, raw, cd, conf) from the misread zones."""
    z = i.mrz_ocr(spark, d)

    def part(name, slot):
        line = f"l{slot.line}"
        return F.struct(F.lit(name).alias("name"), F.substring(line, slot.start, slot.width).alias("raw"),
                        F.substring(line, slot.digit, 1).alias("cd"),
                        (F.col("char_conf") if name == "doc_number" else F.lit(None))
                        .cast("array<double>").alias("conf"))
    return z.select("doc_id", "true_doc_no", F.inline(F.array(
        *[part(n, mrz.TD1.slots[n]) for n in mrz.TD1.repaired])))


PARTS = """SELECT doc_id, true_doc_no, name, raw, cd, digits FROM (
 SELECT doc_id, true_doc_no, 'doc_number' AS name, substr(l1, 6, 9) AS raw, substr(l1, 15, 1) AS cd, FALSE AS digits FROM mrz_ocr
 UNION ALL SELECT doc_id, true_doc_no, 'birth_date', substr(l2, 1, 6), substr(l2, 7, 1), TRUE FROM mrz_ocr
 UNION ALL SELECT doc_id, true_doc_no, 'expiry_date', substr(l2, 9, 6), substr(l2, 15, 1), TRUE FROM mrz_ocr)"""


def repair_ctes(parts: str = PARTS, key: str = "doc_id, name") -> dict[str, str]:
    """Brute-force candidate search as joins over single-character edits."""
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in key.split(","))
    keys = ", ".join(f"a.{k.strip()}" for k in key.split(","))
    return {
        "conf": CONFUSION,
        "parts": parts,
        "need": f"SELECT *, (CAST(cd AS INT) - {wsum('raw')} + 10) % 10 AS need FROM parts WHERE regexp_full_match(cd, '[0-9]')",
        "pos": f"SELECT {key}, raw, need, digits, CAST(unnest(range(1, length(raw) + 1)) AS INT) AS p FROM need WHERE need <> 0",
        "edits": f"""SELECT {key}, raw, need, p, c, (([7, 3, 1][(p - 1) % 3 + 1]
            * ({VAL.format('c')} - {VAL.format('substr(raw, p, 1)')})) % 10 + 10) % 10 AS d
            FROM pos JOIN conf ON f = substr(raw, p, 1) WHERE NOT digits OR regexp_full_match(c, '[0-9]')""",
        "k1": f"SELECT {key}, raw, [p] AS ps, [c] AS cs, substr(raw, 1, p - 1) || c || substr(raw, p + 1) AS v FROM edits WHERE d = need",
        "open2": f"SELECT e.* FROM edits e ANTI JOIN k1 USING ({key})",
        "k2": f"""SELECT {keys}, a.raw, [a.p, b.p] AS ps, [a.c, b.c] AS cs, substr(a.raw, 1, a.p - 1) || a.c ||
            substr(a.raw, a.p + 1, b.p - a.p - 1) || b.c || substr(a.raw, b.p + 1) AS v
            FROM open2 a JOIN open2 b ON {on} AND a.p < b.p WHERE (a.d + b.d) % 10 = a.need""",
        "open3": f"SELECT e.* FROM open2 e ANTI JOIN k2 USING ({key})",
        "k3": f"""SELECT {keys}, a.raw, [a.p, b.p, x.p] AS ps, [a.c, b.c, x.c] AS cs, substr(a.raw, 1, a.p - 1) || a.c ||
            substr(a.raw, a.p + 1, b.p - a.p - 1) || b.c || substr(a.raw, b.p + 1, x.p - b.p - 1) || x.c || substr(a.raw, x.p + 1) AS v
            FROM open3 a JOIN open3 b ON {on} AND a.p < b.p JOIN open3 x ON {on.replace('b.', 'x.')} AND b.p < x.p
            WHERE (a.d + b.d + x.d) % 10 = a.need""",
        "cands": f"""SELECT {key}, raw, CAST([] AS INT[]) AS ps, CAST([] AS VARCHAR[]) AS cs, raw AS v FROM need WHERE need = 0
            UNION ALL SELECT * FROM k1 UNION ALL SELECT * FROM k2 UNION ALL SELECT * FROM k3""",
        "ranked": f"""SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY ps, cs) AS rk,
            count(*) OVER (PARTITION BY {key}) AS n FROM cands""",
        "fixes": f"""SELECT p.*, coalesce(r.v, p.raw) AS value, r.v IS NOT NULL AS valid, coalesce(r.n > 1, FALSE) AS ambiguous,
            coalesce(len(r.ps), 0) AS edits, coalesce(l.vs, CAST([] AS VARCHAR[])) AS cands
            FROM parts p LEFT JOIN (SELECT * FROM ranked WHERE rk = 1) r USING ({key})
            LEFT JOIN (SELECT {key}, list(v ORDER BY ps, cs) AS vs FROM cands GROUP BY {key}) l USING ({key})""",
    }


@register("repair_candidates", sql(
    "SELECT doc_id, name, v AS candidate, len(ps) AS edits, array_to_string(ps, ',') AS positions, rk FROM ranked",
    "mrz_ocr", **repair_ctes()))
def _(spark, d):
    parts = zone_parts(spark, d)
    found = repair.repair_candidates(F.col("raw"), F.col("cd"), repair.confusion_map_for(F.col("name")))
    x = parts.select("doc_id", "name", F.posexplode(found).alias("pos", "x"))
    return x.select("doc_id", "name", F.col("x.value").alias("candidate"), F.size("x.ps").alias("edits"),
                    F.array_join(F.col("x.ps").cast("array<string>"), ",").alias("positions"),
                    (F.col("pos") + 1).alias("rk"))


@register("repair_field", sql("""
SELECT doc_id, name, value, valid, ambiguous, CAST(edits AS INT) AS edits, array_to_string(cands, ',') AS candidates,
  valid AND NOT ambiguous AND edits = 0 AS trusted FROM fixes""", "mrz_ocr", **repair_ctes()))
def _(spark, d):
    out = repair.repair_long(zone_parts(spark, d))
    x = F.col("correction")
    return out.select("doc_id", "name", "correction.value", "correction.valid", "correction.ambiguous",
                      "correction.edits", F.array_join(x["candidates"], ",").alias("candidates"),
                      repair.trustworthy(x).alias("trusted"))


_costs = dict(repair_ctes(), costed="""
SELECT c.*, list_sum(list_transform(ps, lambda p: CASE WHEN doc_id % 5 = 0 AND doc_id % 2 = 0
   AND p = 1 + doc_id % 9 THEN 0.2 ELSE 0.99 END)) AS cost FROM cands c WHERE name = 'doc_number'""",
    rc="""SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cost, ps, cs) AS rk,
   lead(cost) OVER (PARTITION BY doc_id ORDER BY cost, ps, cs) AS next FROM costed""")


@register("repair_by_confidence", sql("""
SELECT p.doc_id, coalesce(v, p.raw) AS value, v IS NOT NULL AS valid,
  coalesce(next IS NOT NULL AND NOT cost < next - 1e-9, FALSE) AS ambiguous,
  coalesce(len(ps) > 0 AND list_min(list_transform(ps, lambda p: doc_id % 5 = 0 AND doc_id % 2 = 0
     AND p = 1 + doc_id % 9)), FALSE) AS corroborated
FROM (SELECT * FROM parts WHERE name = 'doc_number') p LEFT JOIN (SELECT * FROM rc WHERE rk = 1) r USING (doc_id)""",
    "mrz_ocr", **_costs))
def _(spark, d):
    parts = zone_parts(spark, d).filter("name = 'doc_number'")
    return repair.repair_long(parts, "conf").select(
        "doc_id", "correction.value", "correction.valid", "correction.ambiguous", "correction.corroborated")


@register("trustworthy_share", sql("""
SELECT name, count(*) AS n, count(*) FILTER (valid AND NOT ambiguous AND edits = 0) AS trusted,
  count(*) FILTER (ambiguous) AS ambiguous FROM fixes GROUP BY name""", "mrz_ocr", **repair_ctes()))
def _(spark, d):
    out = repair.repair_long(zone_parts(spark, d))
    x = F.col("correction")
    return out.groupBy("name").agg(F.count("*").alias("n"), F.count_if(repair.trustworthy(x)).alias("trusted"),
                                   F.count_if(x["ambiguous"]).alias("ambiguous"))


@register("repair_audit", sql("""
SELECT doc_id, name, raw AS original, value, ambiguous FROM fixes WHERE value <> raw OR ambiguous""",
    "mrz_ocr", **repair_ctes()))
def _(spark, d):
    return repair.audit(repair.repair_long(zone_parts(spark, d))).select(
        "doc_id", "name", "correction.original", "correction.value", "correction.ambiguous")


def _res(layout: mrz.Layout, name: str, e: str) -> str:
    return wsum(e, mrz.composite_offset(layout, name))


def composite_ctes(layout: mrz.Layout, zone: str) -> dict[str, str]:
    """Options per field, all combinations, and the single one that fits."""
    out = {}
    for n in layout.repaired:
        out[f"o_{n}"] = (f"SELECT doc_id, v AS {n}, {_res(layout, n, 'v')} AS r_{n} FROM (SELECT doc_id, unnest(CASE WHEN ambiguous "
                         f"THEN cands ELSE [value] END) AS v FROM fixes WHERE name = '{n}')")
    blank = {}
    for line in range(1, layout.count + 1):
        e = f"n{line}"
        for n in layout.repaired:
            s = layout.slots[n]
            if s.line == line:
                e = f"(substr({e}, 1, {s.start - 1}) || '{'<' * s.width}' || substr({e}, {s.start + s.width}))"
        blank[line] = e
    comp = " || ".join(f"substr({blank[n]}, {a}, {w})" for n, a, w in layout.composite)
    cn, cp = layout.composite_digit
    out["zc"] = (f"SELECT doc_id, {wsum(f'({comp})')} AS base, try_cast(substr(n{cn}, {cp}, 1) AS INT) AS want FROM {zone}")
    amb = "SELECT doc_id, count(*) FILTER (ambiguous) AS na, product(CASE WHEN ambiguous THEN len(cands) ELSE 1 END) AS np FROM fixes GROUP BY doc_id"
    out["amb"] = amb
    joins = " ".join(f"JOIN o_{n} USING (doc_id)" for n in layout.repaired)
    total = " + ".join(f"r_{n}" for n in layout.repaired)
    out["sols"] = (f"SELECT doc_id, {', '.join(layout.repaired)} FROM zc JOIN amb USING (doc_id) {joins} "
                   f"WHERE na > 0 AND (base + {total}) % 10 = want")
    out["single"] = "SELECT *, count(*) OVER (PARTITION BY doc_id) AS ns FROM sols"
    case = " ".join(f"WHEN '{n}' THEN s.{n}" for n in layout.repaired)
    out["final"] = (f"SELECT f.* EXCLUDE (value, ambiguous), CASE WHEN f.ambiguous AND s.doc_id IS NOT NULL THEN CASE f.name {case} END ELSE f.value END AS value, "
                    f"f.ambiguous AND s.doc_id IS NULL AS ambiguous, f.ambiguous AND s.doc_id IS NOT NULL AS won "
                    f"FROM fixes f LEFT JOIN (SELECT * FROM single WHERE ns = 1) s USING (doc_id)")
    out["trust"] = "SELECT *, valid AND NOT ambiguous AND (edits = 0 OR won) AS trusted FROM final"
    return out


TD1_CTES = dict(zn=_norm_cte("mrz_ocr", mrz.TD1), **repair_ctes(), **composite_ctes(mrz.TD1, "zn"))

_t3parts = " UNION ALL ".join(
    f"SELECT doc_id, '{n}' AS name, substr(n{s.line}, {s.start}, {s.width}) AS raw, substr(n{s.line}, {s.digit}, 1) AS cd, "
    f"{'TRUE' if n in repair.DIGIT_FIELDS else 'FALSE'} AS digits FROM zn"
    for n, s in ((n, mrz.TD3.slots[n]) for n in mrz.TD3.repaired))
TD3_CTES = dict(t3=TD3_OCR, zn=_norm_cte("t3", mrz.TD3), **repair_ctes(_t3parts), **composite_ctes(mrz.TD3, "zn"))


@register("resolve_composite", sql(
    "SELECT doc_id, name, value, ambiguous, trusted FROM trust", "mrz_ocr", **TD1_CTES))
def _(spark, d):
    out = mrz.repair_zone(i.mrz_ocr(spark, d), mrz.TD1)
    rows = [F.struct(F.lit(n).alias("name"), F.col(f"fix_{n}").alias("x")) for n in mrz.TD1.repaired]
    long = out.select("doc_id", F.inline(F.array(*rows)))
    return long.select("doc_id", "name", "x.value", "x.ambiguous", repair.trustworthy(F.col("x")).alias("trusted"))


# --- fields -------------------------------------------------------------------

@register("split_names", sql(
    "SELECT doc_id, surname, given, CASE WHEN doc_id % 2 = 0 THEN 'OGLI X' ELSE '' END AS patronymic FROM persons",
    "persons"))
def _(spark, d):
    p = i.persons(spark, d)
    line = F.rpad(F.concat("surname", F.lit("<<"), "given",
                           F.when(F.col("doc_id") % 2 == 0, "<OGLI<X").otherwise("")), 39, "<")
    return p.select("doc_id", mrz.split_names(line).alias("x")).select("doc_id", "x.*")


def _name_rows(latin_given="given") -> str:
    """Six name entries per document as SQL."""
    def row(path, value, conf, source):
        return (f"SELECT doc_id, 'person.name.{path}' AS path, {value} AS value, {conf} AS confidence, '{source}' AS source, "
                f"FALSE AS validated, '' AS alternatives, '' AS note FROM nm")
    rows = []
    for stem, e in (("surname", "surname"), ("given_name", "given"), ("patronymic", "patronymic")):
        shown = f"NULLIF({title(e)}, '')"
        rows.append(row(f"{stem}_latin", shown, f"CASE WHEN {shown} IS NULL THEN 0.0 ELSE 0.95 END", "mrz"))
        rows.append(row(f"{stem}_cyrillic", to_cyrillic(shown), f"CASE WHEN {shown} IS NULL THEN 0.0 ELSE 0.75 END", "derived"))
    return " UNION ALL ".join(rows)


@register("build_name", sql("SELECT * FROM (" + _name_rows() + ")", "persons", nm=(
    "SELECT doc_id, surname, given, CASE WHEN doc_id % 2 = 0 THEN 'OGLI X' ELSE '' END AS patronymic FROM persons")))
def _(spark, d):
    p = i.persons(spark, d)
    line = F.rpad(F.concat("surname", F.lit("<<"), "given",
                           F.when(F.col("doc_id") % 2 == 0, "<OGLI<X").otherwise("")), 39, "<")
    rows = p.select("doc_id", mrz.split_names(line).alias("x")).select(
        "doc_id", F.inline(mrz.name_fields(F.col("x"))))
    return flat(rows)


def flat(rows):
    """Field rows with arrays and nulls as text, for comparison."""
    return rows.withColumn("alternatives", F.array_join("alternatives", "|")) \
        .withColumn("note", F.coalesce("note", F.lit("")))


def fields_sql(layout: mrz.Layout) -> dict[str, str]:
    """CTE ``zf``: all field entries of a zone, after repair."""
    names = layout.slots["names"]
    nat, sex = layout.slots["nationality"], layout.slots["sex"]
    td1 = layout is mrz.TD1
    out = {}
    out["nm"] = (f"SELECT doc_id, {display('ns[1]')} AS surname, coalesce(g[1], '') AS given, "
                 f"array_to_string(list_slice(g, 2, 99), ' ') AS patronymic FROM (SELECT doc_id, ns, list_filter(string_split("
                 f"coalesce(array_to_string(list_slice(ns, 2, 99), '<<'), ''), '<'), lambda x: x <> '') AS g FROM (SELECT doc_id, "
                 f"string_split(substr(n{names.line}, {names.start}, {names.width}), '<<') AS ns FROM zn))")
    wide = ", ".join(f"max(CASE WHEN name = '{n}' THEN {c} END) AS {n}_{a}" for n in layout.repaired
                     for c, a in (("value", "v"), ("trusted", "t")))
    out["w"] = f"SELECT doc_id, {wide} FROM trust GROUP BY doc_id"
    pin = f"regexp_replace({'personal_number_v' if not td1 else _slot_sql(layout, 'optional1')}, '[^0-9]', '', 'g')"
    sexe = f"substr(n{sex.line}, {sex.start}, 1)"
    nate = display(f"substr(n{nat.line}, {nat.start}, {nat.width})")
    out["z2"] = (f"SELECT *, {pin} AS pin, {zone_birth('birth_date_v')} AS b, {zone_expiry('expiry_date_v')} AS e, "
                 f"CASE WHEN {sexe} IN ('M', 'F') THEN {sexe} END AS sx, NULLIF({nate}, '') AS nat FROM zn JOIN w USING (doc_id)")
    out["z3"] = ("SELECT *, length(pin) = 14 AND substr(pin, 1, 1) BETWEEN '1' AND '6' AND try_cast(CASE substr(pin, 1, 1) WHEN '1' THEN '18' WHEN '2' "
                 "THEN '18' WHEN '3' THEN '19' WHEN '4' THEN '19' ELSE '20' END || substr(pin, 6, 2) || '-' || substr(pin, 4, 2) || '-' || "
                 "substr(pin, 2, 2) AS DATE) IS NOT NULL AS pok FROM z2")
    def entry(path, value, trusted):
        return (f"SELECT doc_id, '{path}' AS path, {value} AS value, CASE WHEN {trusted} THEN 0.98 ELSE 0.4 END AS confidence, "
                f"'mrz' AS source, {trusted} AND {value} IS NOT NULL AS validated, '' AS alternatives, '' AS note FROM z3")
    surep = "pok" if td1 else "pok AND personal_number_t"
    out["zf"] = " UNION ALL ".join([
        _name_rows(),
        f"SELECT f.doc_id, 'documents.0.doc_number' AS path, CASE WHEN f.value <> f.raw AND NOT trusted THEN coalesce(NULLIF({display('f.raw')}, ''), {display('f.value')}) "
        f"ELSE {display('f.value')} END AS value, CASE WHEN trusted THEN 0.98 ELSE 0.4 END AS confidence, 'mrz' AS source, trusted AS validated, "
        f"CASE WHEN f.value <> f.raw AND NOT trusted THEN array_to_string(list_transform(cands, lambda c: {display('c')}), '|') ELSE '' END AS alternatives, "
        f"CASE WHEN f.value <> f.raw AND NOT trusted THEN {q(msg.UNVERIFIED_REPAIR)} ELSE '' END AS note FROM trust f WHERE name = 'doc_number'",
        entry("documents.0.expiry_date", "e", "expiry_date_t"), entry("person.birth_date", "b", "birth_date_t"),
        entry("person.sex", "sx", "(sx IS NOT NULL)"), entry("person.nationality", "nat", "TRUE"),
        entry("person.citizenship", "nat", "TRUE"),
        f"SELECT doc_id, 'person.pinfl' AS path, pin AS value, CASE WHEN {surep} THEN 0.9 ELSE 0.4 END AS confidence, 'mrz' AS source, FALSE AS validated, "
        f"'' AS alternatives, CASE WHEN pok THEN '' WHEN NOT substr(pin, 1, 1) BETWEEN '1' AND '6' THEN 'unknown century/sex marker: ' || substr(pin, 1, 1) "
        f"ELSE 'invalid birth date encoded in PINFL' END AS note FROM z3 WHERE length(pin) = 14"])
    comp = " || ".join(f"substr(f{n}, {a}, {w})" for n, a, w in layout.composite)
    lines = {}
    for n in range(1, layout.count + 1):
        e = f"n{n}"
        for name in layout.repaired:
            s = layout.slots[name]
            if s.line == n:
                e = f"(substr({e}, 1, {s.start - 1}) || {name}_v || substr({e}, {s.start + s.width}))"
        lines[n] = e
    out["z4"] = f"SELECT *, {', '.join(f'{e} AS f{n}' for n, e in lines.items())} FROM z3"
    cn, cp = layout.composite_digit
    amb = ", ".join(
        f"(SELECT CASE WHEN ambiguous THEN {q(msg.AMBIGUOUS_FIELD[0] + n + msg.AMBIGUOUS_FIELD[1])} || array_to_string(list_slice(cands, 1, 3), ', ') || "
        f"{q(msg.AMBIGUOUS_FIELD[2])} END FROM trust t WHERE t.doc_id = z4.doc_id AND name = '{n}')" for n in layout.repaired)
    rep = ", ".join(
        f"(SELECT CASE WHEN value <> raw THEN {q(msg.REPAIRED + n + ': ' + chr(39))} || raw || ''' -> ''' || value || ''' [' || CASE WHEN ambiguous THEN 'ambiguous' "
        f"ELSE 'repaired' END || ']' END FROM trust t WHERE t.doc_id = z4.doc_id AND name = '{n}')" for n in layout.repaired)
    pinw = ""
    if td1:
        psex = "CASE WHEN substr(pin, 1, 1) IN ('1', '3', '5') THEN 'M' ELSE 'F' END"
        pb = ("CASE substr(pin, 1, 1) WHEN '1' THEN '18' WHEN '2' THEN '18' WHEN '3' THEN '19' WHEN '4' THEN '19' ELSE '20' END || substr(pin, 6, 2) || '-' "
              "|| substr(pin, 4, 2) || '-' || substr(pin, 2, 2)")
        pinw = (f"CASE WHEN pok AND sx IS NOT NULL AND {psex} <> sx THEN {q(msg.PINFL_SEX)} END, "
                f"CASE WHEN pok AND b IS NOT NULL AND {pb} <> b THEN {q(msg.PINFL_BIRTH)} END, ")
    out["zw"] = (f"SELECT doc_id, list_filter([{amb}, {pinw} CASE WHEN NOT {verify(f'({comp})', f'substr(f{cn}, {cp}, 1)')} THEN {q(msg.COMPOSITE_FAILED)} END, "
                 f"{rep}], lambda x: x IS NOT NULL) AS warnings FROM z4")
    return out


TD1_FIELDS = dict(TD1_CTES, **fields_sql(mrz.TD1))
TD3_FIELDS = dict(TD3_CTES, **fields_sql(mrz.TD3))


@register("zone_fields_td1", sql("SELECT * FROM zf", "mrz_ocr", **TD1_FIELDS))
def _(spark, d):
    return flat(mrz.explode_fields(mrz.zone_fields(i.mrz_ocr(spark, d), mrz.TD1, i.today()), "doc_id"))


@register("zone_fields_td3", sql("SELECT * FROM zf", "mrz_td3", **TD3_FIELDS))
def _(spark, d):
    return flat(mrz.explode_fields(mrz.zone_fields(td3_ocr(spark, d), mrz.TD3, i.today()), "doc_id"))


@register("zone_warnings_td1", sql("SELECT doc_id, array_to_string(warnings, '|') AS warnings FROM zw", "mrz_ocr", **TD1_FIELDS))
def _(spark, d):
    return mrz.zone_fields(i.mrz_ocr(spark, d), mrz.TD1, i.today()).select(
        "doc_id", F.array_join("warnings", "|").alias("warnings"))


@register("zone_warnings_td3", sql("SELECT doc_id, array_to_string(warnings, '|') AS warnings FROM zw", "mrz_td3", **TD3_FIELDS))
def _(spark, d):
    return mrz.zone_fields(td3_ocr(spark, d), mrz.TD3, i.today()).select(
        "doc_id", F.array_join("warnings", "|").alias("warnings"))


@register("pinfl_consistency", sql(f"""
SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN {q(msg.PINFL_SEX)} ELSE '' END AS sex_warning,
  CASE WHEN doc_id % 6 = 1 THEN {q(msg.PINFL_BIRTH)} ELSE '' END AS birth_warning FROM persons""", "persons"))
def _(spark, d):
    k = F.col("doc_id")
    sex = F.when(k % 4 == 1, F.translate("sex", "MF", "FM")).otherwise(F.col("sex"))
    birth = F.when(k % 6 == 1, F.date_add("birth", 1)).otherwise(F.col("birth"))
    w = mrz.pinfl_consistency(F.lit(True), c.decode_pinfl(F.col("pinfl")), sex, birth)
    return i.persons(spark, d).select("doc_id", F.coalesce(w[0], F.lit("")).alias("sex_warning"),
                                      F.coalesce(w[1], F.lit("")).alias("birth_warning"))


@register("zone_field_value", sql("""
SELECT doc_id, value, confidence, validated, alternatives FROM zf WHERE path = 'documents.0.doc_number'""",
    "mrz_ocr", **TD1_FIELDS))
def _(spark, d):
    out = mrz.repair_zone(i.mrz_ocr(spark, d), mrz.TD1)
    x = F.col("fix_doc_number")
    f = mrz.zone_field("documents.0.doc_number", t.mrz_to_display(x["value"]), repair.trustworthy(x), x)
    return out.select("doc_id", f.alias("f")).select(
        "doc_id", "f.value", "f.confidence", "f.validated", F.array_join("f.alternatives", "|").alias("alternatives"))


@register("parse_mrz_dispatch", sql("""
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 4 = 1 THEN 'TD1' WHEN doc_id % 4 = 2 THEN 'TD3' ELSE 'TD1' END AS format,
  doc_id % 4 <> 0 AS found, CASE WHEN doc_id % 4 = 0 THEN 'unexpected MRZ line count: 1 (expected 2 or 3)' ELSE '' END AS reason
FROM persons""", "persons"))
def _(spark, d):
    k = F.col("doc_id")
    a = i.mrz_clean(spark, d).select("doc_id", F.col("lines").alias("a"))
    b = i.mrz_td3(spark, d).select("doc_id", F.col("lines").alias("b"))
    both = a.join(b, "doc_id").select("doc_id", F.when(k % 4 == 0, F.slice("a", 1, 1)).when(
        k % 4 == 2, F.col("b")).otherwise(F.concat("a", F.array(F.lit("  ")))).alias("lines"))
    out = mrz.parse_mrz(both, i.today())
    return out.select("doc_id", F.coalesce("format", F.lit("")).alias("format"), "found",
                      F.coalesce("reason", F.lit("")).alias("reason"))


@register("mrz_candidates", sql(
    "SELECT doc_id, 'I<' || substr(l1, 3) || '|' || l2 || '|' || l3 AS lines FROM mrz_ocr", "mrz_ocr"))
def _(spark, d):
    return mrz.mrz_candidates(i.ocr_lines(spark, d)).select("doc_id", F.array_join("lines", "|").alias("lines"))


@register("synth_identities", sql(
    "SELECT doc_id, sex, doc_no, surname, given, pinfl, l1, l2, l3 FROM mrz_clean", "mrz_clean"))
def _(spark, d):
    return i.mrz_clean(spark, d).select("doc_id", "sex", "doc_no", "surname", "given", "pinfl", "l1", "l2", "l3")


@register("corrupt_mrz", sql("SELECT doc_id, true_doc_no, l1, l2 FROM mrz_ocr", "mrz_ocr"))
def _(spark, d):
    return i.mrz_ocr(spark, d).select("doc_id", "true_doc_no", "l1", "l2")


@register("repair_study", sql("""
SELECT CASE WHEN doc_id % 5 = 0 THEN 'hit' ELSE 'clean' END AS cohort, count(*) AS n,
  count(*) FILTER (raw <> true_doc_no AND edits = 0 AND valid) AS collisions,
  count(*) FILTER (value = true_doc_no AND trusted) AS recovered,
  count(*) FILTER (value <> true_doc_no AND trusted) AS wrong_trusted
FROM trust WHERE name = 'doc_number' GROUP BY 1""", "mrz_ocr", **TD1_CTES))
def _(spark, d):
    z = mrz.repair_zone(i.mrz_ocr(spark, d), mrz.TD1)
    x, true = F.col("fix_doc_number"), F.col("true_doc_no")
    ok = repair.trustworthy(x)
    return z.groupBy(F.when(F.col("doc_id") % 5 == 0, "hit").otherwise("clean").alias("cohort")).agg(
        F.count("*").alias("n"),
        F.count_if((x["original"] != true) & (x["edits"] == 0) & x["valid"]).alias("collisions"),
        F.count_if((x["value"] == true) & ok).alias("recovered"),
        F.count_if((x["value"] != true) & ok).alias("wrong_trusted"))
