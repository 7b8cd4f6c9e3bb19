"""Check-digit driven repair of zone fields.

A field is at most 14 characters, so its whole candidate search fits in one
row: the possible single-character edits form a small array, each with the
change it makes to the check digit modulo ten, and candidates are the edit sets
whose changes add up to what is missing.  The search is a projection, needs no
shuffle, and runs only for rows whose digit fails as read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from docweir.functions.checkdigit import ALPHABET, WEIGHTS, check_digit
from docweir.functions.text import let

# Glyph pairs that recognisers confuse.
CONFUSION_PAIRS = [
    ("0", "O"), ("0", "D"), ("0", "Q"), ("O", "D"), ("O", "Q"),
    ("1", "I"), ("1", "L"), ("I", "L"), ("2", "Z"), ("5", "S"), ("8", "B"),
    ("6", "G"), ("4", "A"), ("7", "T"), ("9", "G"), ("U", "V"), ("M", "N"),
    ("K", "X"), ("C", "G"), ("C", "O"), ("E", "F"), ("R", "P"), ("3", "8"),
]
# Fields that may only hold digits or only letters.
DIGIT_FIELDS = ["birth_date", "expiry_date"]
LETTER_FIELDS = ["nationality", "issuing_state"]

DIGITS = "0123456789"
LETTERS = ALPHABET[10:]

CORRECTION = ("struct<original:string,value:string,valid:boolean,ambiguous:boolean,"
              "edits:int,corroborated:boolean,candidates:array<string>,positions:array<int>>")


def confusions(charset: str | None = None) -> dict[str, str]:
    """Character -> its confusable characters, sorted, restricted to ``charset``."""
    table: dict[str, set[str]] = {}
    for a, b in CONFUSION_PAIRS:
        table.setdefault(a, set()).add(b)
        table.setdefault(b, set()).add(a)
    allowed = {ch: sorted(x for x in others if charset is None or x in charset)
               for ch, others in table.items()}
    return {ch: "".join(others) for ch, others in allowed.items() if others}


def alternatives_for(ch: Column, charset: str | None = None) -> Column:
    """Characters that may stand at this place, the read one included, sorted."""
    entries = [F.lit(x) for kv in confusions(charset).items() for x in kv]
    others = F.coalesce(F.try_element_at(F.create_map(*entries), ch), F.lit(""))
    kept = ch if charset is None else F.when(F.instr(F.lit(charset), ch) > 0, ch).otherwise("")
    options = F.array_sort(F.filter(F.split(F.concat(kept, others), ""), lambda x: x != ""))
    return F.when(F.size(options) == 0, F.array(ch)).otherwise(options)


def confusion_table(spark) -> DataFrame:
    """The confusion dimension (from_ch, to_ch, delta) as a small DataFrame."""
    value = {ch: i % 10 for i, ch in enumerate(ALPHABET)}
    rows = [(a, b, (value[b] - value[a]) % 10)
            for a, others in sorted(confusions().items()) for b in others]
    return spark.createDataFrame(rows, "from_ch string, to_ch string, delta int")


def confusion_map(charset: str | None = None) -> Column:
    """Map character -> confusable characters as a literal."""
    return F.create_map(*[F.lit(x) for kv in confusions(charset).items() for x in kv])


def confusion_map_for(field: Column) -> Column:
    """The map that fits a field name, so that one search expression serves all fields."""
    return (F.when(field.isin(DIGIT_FIELDS), confusion_map(DIGITS))
            .when(field.isin(LETTER_FIELDS), confusion_map(LETTERS)).otherwise(confusion_map()))


def _edits(raw: Column, table: Column) -> Column:
    """array<struct<p,c,d>>: place, new character, change modulo ten; ordered by (p, c)."""
    weights = F.array(*[F.lit(w) for w in WEIGHTS])

    def value(ch: Column) -> Column:
        return F.greatest(F.instr(F.lit(ALPHABET), ch) - 1, F.lit(0))

    def at(p: Column) -> Column:
        def options(ch: Column) -> Column:
            others = F.filter(F.split(F.coalesce(F.try_element_at(table, ch), F.lit("")), ""),
                              lambda x: x != "")
            return F.transform(others, lambda c: F.struct(
                p.alias("p"), c.alias("c"),
                F.pmod(F.get(weights, (p - 1) % 3) * (value(c) - value(ch)), F.lit(10)).alias("d")))

        return let(F.substring(raw, p, F.lit(1)), options)

    return F.flatten(F.transform(F.sequence(F.lit(1), F.length(raw)), at))


def _put(text: Column, edit: Column) -> Column:
    return F.overlay(text, edit["c"], edit["p"], F.lit(1))


def _one(raw: Column, edits: Column, need: Column) -> Column:
    return F.transform(F.filter(edits, lambda e: e["d"] == need), lambda e: F.struct(
        F.array(e["p"]).alias("ps"), F.array(e["c"]).alias("cs"), _put(raw, e).alias("value")))


def _two(raw: Column, edits: Column, need: Column) -> Column:
    def second(e: Column) -> Column:
        rest = F.filter(edits, lambda f: (f["p"] > e["p"]) & ((e["d"] + f["d"]) % 10 == need))
        return F.transform(rest, lambda f: F.struct(
            F.array(e["p"], f["p"]).alias("ps"), F.array(e["c"], f["c"]).alias("cs"),
            _put(_put(raw, e), f).alias("value")))

    return F.array_sort(F.flatten(F.transform(edits, second)))


def _three(raw: Column, edits: Column, need: Column) -> Column:
    def second(e: Column) -> Column:
        def third(f: Column) -> Column:
            rest = F.filter(edits, lambda g: (g["p"] > f["p"])
                            & ((e["d"] + f["d"] + g["d"]) % 10 == need))
            return F.transform(rest, lambda g: F.struct(
                F.array(e["p"], f["p"], g["p"]).alias("ps"),
                F.array(e["c"], f["c"], g["c"]).alias("cs"),
                _put(_put(_put(raw, e), f), g).alias("value")))

        return F.flatten(F.transform(F.filter(edits, lambda f: f["p"] > e["p"]), third))

    return F.array_sort(F.flatten(F.transform(edits, second)))


def repair_candidates(raw: Column, cd: Column, table: Column | None = None,
                      max_edits: int = 3) -> Column:
    """All substitutions that satisfy the digit at the smallest number of edits.

    array<struct<ps,cs,value>> in the order of places, then replacements; zero
    edits give one entry with empty ``ps``; no solution gives an empty array.
    """
    element = "array<struct<ps:array<int>,cs:array<string>,value:string>>"
    nothing = F.array().cast(element)

    def search(edits: Column) -> Column:
        need = F.pmod(cd.cast("int") - check_digit(raw), F.lit(10))

        def wider(found: Column, more: Callable[[], Column]) -> Column:
            return let(found, lambda x: F.when(F.size(x) > 0, x).otherwise(more()))

        steps = [_one, _two, _three][:max_edits]

        def run(i: int) -> Column:
            found = steps[i](raw, edits, need)
            return found if i + 1 == len(steps) else wider(found, lambda: run(i + 1))

        return run(0) if steps else nothing

    unchanged = F.array(F.struct(F.array().cast("array<int>").alias("ps"),
                                 F.array().cast("array<string>").alias("cs"),
                                 raw.alias("value")))
    return (F.when(~F.coalesce(cd.rlike("^[0-9]$"), F.lit(False)), nothing)
            .when(check_digit(raw) == cd.cast("int"), unchanged)
            .otherwise(let(_edits(raw, confusion_map() if table is None else table), search)).cast(element))


def choose(raw: Column, candidates: Column, conf: Column | None = None) -> Column:
    """Pick among tied candidates; returns the correction struct."""
    usable = F.lit(False) if conf is None else F.coalesce(
        F.size(conf) == F.length(raw), F.lit(False))

    def cost(ps: Column) -> Column:
        if conf is None:
            return F.lit(0.0)
        return F.when(usable, F.aggregate(
            ps, F.lit(0.0), lambda acc, p: acc + F.get(conf, p - 1))).otherwise(F.lit(0.0))

    def weak(ps: Column) -> Column:
        if conf is None:
            return F.lit(False)
        return usable & F.forall(ps, lambda p: F.get(conf, p - 1) < 0.5)

    def decide(ranked: Column) -> Column:
        first, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
        edits = F.coalesce(F.size(first["ps"]), F.lit(0))
        solved = F.size(ranked) > 0
        cheaper = (usable & (F.size(ranked) > 1)
                   & (first["cost"] < second["cost"] - 1e-9))
        return F.struct(
            raw.alias("original"),
            F.coalesce(first["value"], raw).alias("value"),
            solved.alias("valid"),
            F.coalesce((F.size(ranked) > 1) & ~cheaper, F.lit(False)).alias("ambiguous"),
            edits.alias("edits"),
            F.coalesce((edits > 0) & weak(first["ps"]), F.lit(False)).alias("corroborated"),
            F.transform(ranked, lambda r: r["value"]).alias("candidates"),
            F.coalesce(first["ps"], F.array().cast("array<int>")).alias("positions"))

    ranked = F.array_sort(F.transform(candidates, lambda c: F.struct(
        cost(c["ps"]).alias("cost"), c["ps"].alias("ps"), c["cs"].alias("cs"),
        c["value"].alias("value"))))
    return let(ranked, decide).cast(CORRECTION)


def repair_field(raw: Column, cd: Column, table: Column | None = None,
                 conf: Column | None = None, max_edits: int = 3) -> Column:
    return choose(raw, repair_candidates(raw, cd, table, max_edits), conf)


def trustworthy(c: Column) -> Column:
    """Only an unedited match, or an edit with independent evidence, is trusted."""
    return c["valid"] & ~c["ambiguous"] & ((c["edits"] == 0) | c["corroborated"])


def changed(c: Column) -> Column:
    return c["value"] != c["original"]


def describe(name: Column, c: Column) -> Column:
    """Audit text of one correction."""
    tag = F.when(c["ambiguous"], "ambiguous").otherwise("repaired")
    return F.concat(name, F.lit(": '"), c["original"], F.lit("' -> '"), c["value"],
                    F.lit("' ["), tag, F.lit("]"))


def residue(value: Column, offset: Column) -> Column:
    """Weighted residue of a candidate placed at ``offset`` of the composite."""
    res = F.transform(F.split(value, ""), lambda ch: F.greatest(
        F.instr(F.lit(ALPHABET), ch) - 1, F.lit(0)))
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    return F.aggregate(F.transform(res, lambda v, i: v * F.get(weights, (i + offset) % 3)),
                       F.lit(0), lambda a, b: a + b) % 10


_PARTIAL = "array<struct<n:int,v:array<string>>>"


def resolve_composite(fixes: Column, offsets: list[int], blanked: Column, digit: Column) -> Column:
    """The one combination of candidate values that satisfies the composite digit.

    ``fixes`` is an array of corrections, ``offsets`` where each stands in the
    composite, ``blanked`` the composite source with those fields replaced by
    filler.  Returns array<string>; NULL when none or several combinations fit.

    Only the residue of the fields so far matters, so fields are folded over ten
    residues, each with the number of combinations that lead to it (none, one or
    several) and, while it is one, their values: exact for any number of
    candidates, in ten entries.
    """
    options = F.transform(fixes, lambda c, i: F.struct(
        F.get(F.array(*[F.lit(o) for o in offsets]), i).alias("at"),
        F.when(c["ambiguous"], c["candidates"]).otherwise(F.array(c["value"])).alias("vs")))
    need = F.pmod(digit.try_cast("int") - check_digit(blanked), F.lit(10))
    start = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda r: F.struct(
        F.when(r == 0, 1).otherwise(0).alias("n"), F.array().cast("array<string>").alias("v"))).cast(_PARTIAL)
    folded = F.aggregate(options, start, _extend)
    end = F.get(folded, need)
    return F.when(F.coalesce(digit.rlike("^[0-9]$"), F.lit(False)) & (end["n"] == 1), end["v"])


def _extend(partial: Column, option: Column) -> Column:
    """Ten residues with one more field: every way to split a residue between what was and the field."""
    scored = F.transform(option["vs"], lambda v: F.struct(residue(v, option["at"]).alias("r"), v.alias("v")))
    tens = F.sequence(F.lit(0), F.lit(9))

    def own(s: Column) -> Column:
        return F.transform(tens, lambda r: let(F.filter(s, lambda x: x["r"] == r), lambda hit: F.struct(
            F.least(F.size(hit), F.lit(2)).alias("n"), F.get(hit, F.lit(0))["v"].alias("v"))))

    def joined(field: Column) -> Column:
        def ways(r: Column) -> Column:
            return F.filter(F.transform(partial, lambda p, a: let(F.get(field, F.pmod(r - a, F.lit(10))), lambda o: F.struct(
                (p["n"] * o["n"]).alias("n"), F.concat(p["v"], F.array(o["v"])).alias("v")))), lambda w: w["n"] > 0)

        return F.transform(tens, lambda r: let(ways(r), lambda w: F.struct(
            F.least(F.aggregate(w, F.lit(0), lambda acc, x: acc + x["n"]), F.lit(2)).alias("n"),
            F.coalesce(F.get(w, F.lit(0))["v"], F.array().cast("array<string>")).alias("v")))).cast(_PARTIAL)

    return let(own(scored), joined)


def apply_solution(correction: Column, solution: Column, index: Column) -> Column:
    """Replace an ambiguous correction by its composite-backed value."""
    won = solution.isNotNull() & correction["ambiguous"]
    return F.struct(
        correction["original"].alias("original"),
        F.when(won, F.get(solution, index)).otherwise(correction["value"]).alias("value"),
        correction["valid"].alias("valid"),
        (correction["ambiguous"] & ~won).alias("ambiguous"),
        correction["edits"].alias("edits"),
        (correction["corroborated"] | won).alias("corroborated"),
        correction["candidates"].alias("candidates"),
        correction["positions"].alias("positions"))


def repair_long(df: DataFrame, conf: str | None = None) -> DataFrame:
    """Repair a long table (…, name, raw, cd); adds ``correction``."""
    found = repair_candidates(F.col("raw"), F.col("cd"), confusion_map_for(F.col("name")))
    return df.withColumn("correction", choose(
        F.col("raw"), found, None if conf is None else F.col(conf)))


def audit(corrected: DataFrame) -> DataFrame:
    """Rows a reviewer must see: changed or ambiguous fields."""
    c = F.col("correction")
    return corrected.filter(changed(c) | c["ambiguous"])
