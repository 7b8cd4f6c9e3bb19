"""Machine-readable zones: parse, repair, and emit canonical fields."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from docweir import messages as msg
from docweir.functions import text as t
from docweir.functions.checkdigit import decode_pinfl, verify_check_digit, zone_date
from docweir.operators import repair
from docweir.schema import field_struct, string_array

HIGH, LOW, NAME, DERIVED = 0.98, 0.40, 0.95, 0.75


@dataclass(frozen=True)
class Slot:
    """One fixed-width field: line, start (1-based), width, place of its digit."""
    line: int
    start: int
    width: int
    digit: int | None = None


@dataclass(frozen=True, eq=False)
class Layout:
    """Fixed values of a zone format."""
    name: str
    count: int
    width: int
    slots: dict[str, Slot]
    repaired: tuple[str, ...]
    composite: tuple[tuple[int, int, int], ...]      # (line, start, width)
    composite_digit: tuple[int, int]                 # (line, place)


TD1 = Layout(
    "TD1", 3, 30,
    {"doc_code": Slot(1, 1, 2), "issuing_state": Slot(1, 3, 3),
     "doc_number": Slot(1, 6, 9, 15), "optional1": Slot(1, 16, 15),
     "birth_date": Slot(2, 1, 6, 7), "sex": Slot(2, 8, 1),
     "expiry_date": Slot(2, 9, 6, 15), "nationality": Slot(2, 16, 3),
     "optional2": Slot(2, 19, 11), "names": Slot(3, 1, 30)},
    ("doc_number", "birth_date", "expiry_date"),
    ((1, 6, 25), (2, 1, 7), (2, 9, 7), (2, 19, 11)), (2, 30))

TD3 = Layout(
    "TD3", 2, 44,
    {"doc_code": Slot(1, 1, 2), "issuing_state": Slot(1, 3, 3), "names": Slot(1, 6, 39),
     "doc_number": Slot(2, 1, 9, 10), "nationality": Slot(2, 11, 3),
     "birth_date": Slot(2, 14, 6, 20), "sex": Slot(2, 21, 1),
     "expiry_date": Slot(2, 22, 6, 28), "personal_number": Slot(2, 29, 14, 43)},
    ("doc_number", "birth_date", "expiry_date", "personal_number"),
    ((2, 1, 10), (2, 14, 7), (2, 22, 22)), (2, 44))


def _line(lines: Column, n: int) -> Column:
    return F.get(lines, F.lit(n - 1))


def _cut(lines: Column, slot: Slot) -> Column:
    return F.substring(_line(lines, slot.line), slot.start, slot.width)


def _digit(lines: Column, slot: Slot) -> Column:
    return F.substring(_line(lines, slot.line), slot.digit, 1)


def _composite(lines: Column, layout: Layout) -> tuple[Column, Column]:
    source = F.concat(*[F.substring(_line(lines, n), start, width)
                        for n, start, width in layout.composite])
    n, place = layout.composite_digit
    return source, F.substring(_line(lines, n), place, 1)


def composite_offset(layout: Layout, field: str) -> int:
    """Where a field starts inside the composite source."""
    slot, at = layout.slots[field], 0
    for line, start, width in layout.composite:
        if line == slot.line and start <= slot.start < start + width:
            return at + slot.start - start
        at += width
    raise KeyError(field)


def parse_zone(df: DataFrame, layout: Layout, lines: str = "lines") -> DataFrame:
    """Cut fixed-width fields and verify every digit, without any repair.

    Adds ``format, ok, errors`` and ``fields``: map name -> {raw, check_digit, valid}.
    """
    norm = F.col("_norm")
    entries, errors = [], []
    for name, slot in layout.slots.items():
        raw = _cut(norm, slot)
        digit = _digit(norm, slot) if slot.digit else F.lit(None).cast("string")
        valid = verify_check_digit(raw, digit, slot.width) if slot.digit else F.lit(True)
        entries.append((name, raw, digit, valid))
    source, digit = _composite(norm, layout)
    entries.append(("composite", source, digit, verify_check_digit(source, digit)))
    for name, _, _, valid in entries:
        errors.append(F.when(~valid, F.lit(f"check digit failed: {name}")))
    wrong_count = F.array(F.lit(f"{layout.name} requires exactly {layout.count} lines"))
    found = F.col("_norm").isNotNull()
    pairs = F.map_from_arrays(
        F.array(*[F.lit(e[0]) for e in entries]),
        F.array(*[F.struct(e[1].alias("raw"), e[2].alias("check_digit"), e[3].alias("valid"))
                  for e in entries]))
    return (df.withColumn("_norm", t.norm_lines(F.col(lines), layout.count, layout.width))
            .withColumn("format", F.lit(layout.name))
            .withColumn("errors", F.when(found, F.array_compact(F.array(*errors)))
                        .otherwise(wrong_count))
            .withColumn("fields", F.when(found, pairs))
            .withColumn("ok", F.size("errors") == 0)
            .drop("_norm"))


def split_names(names: Column) -> Column:
    """SURNAME<<GIVEN<PATRONYMIC to a struct of three display parts."""
    parts = F.split(names, "<<", 2)
    givens = F.filter(F.split(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), "<"),
                      lambda g: g != "")
    return F.struct(
        t.mrz_to_display(F.get(parts, F.lit(0))).alias("surname"),
        F.coalesce(F.get(givens, F.lit(0)), F.lit("")).alias("given"),
        F.array_join(F.slice(givens, F.lit(2), F.greatest(F.size(givens), F.lit(1))), " ")
        .alias("patronymic"))


def name_fields(parts: Column) -> Column:
    """Array of six name entries: Latin as read, Cyrillic derived; none is ever validated."""
    read = F.array(*[F.struct(F.lit(stem).alias("stem"), parts[part].alias("raw")) for part, stem in (
        ("surname", "surname"), ("given", "given_name"), ("patronymic", "patronymic"))])

    def entries(r: Column) -> Column:
        def both(shown: Column) -> Column:
            sure = shown.isNotNull()
            return F.array(
                field_struct(F.concat(F.lit("person.name."), r["stem"], F.lit("_latin")), shown,
                             F.when(sure, NAME).otherwise(0.0), F.lit("mrz")),
                field_struct(F.concat(F.lit("person.name."), r["stem"], F.lit("_cyrillic")),
                             t.latin_to_cyrillic(shown), F.when(sure, DERIVED).otherwise(0.0), F.lit("derived")))

        return repair.let(F.when(r["raw"] != "", t.title_case_name(r["raw"])), both)

    return F.flatten(F.transform(read, entries))


def zone_field(path: str, value: Column, valid: Column,
               correction: Column | None = None) -> Column:
    """Field entry of a zone value.

    A repair without independent evidence shows what was read and offers the
    repair as an alternative.  ``validated`` needs a value: an all-filler field
    proves nothing.
    """
    value = F.nullif(value, F.lit(""))
    sure = valid & value.isNotNull()
    confidence = F.when(valid, HIGH).otherwise(LOW)
    if correction is None:
        return field_struct(path, value, confidence, "mrz", sure)
    doubt = repair.changed(correction) & ~repair.trustworthy(correction)
    return field_struct(
        path,
        F.when(doubt, F.coalesce(F.nullif(t.mrz_to_display(correction["original"]), F.lit("")),
                                 value)).otherwise(value),
        F.when(doubt, LOW).otherwise(confidence), "mrz", sure & ~doubt,
        F.when(doubt, F.transform(correction["candidates"], t.mrz_to_display))
        .otherwise(string_array([])),
        F.when(doubt, F.lit(msg.UNVERIFIED_REPAIR)))


def _overwrite(lines: Column, slot: Slot, value: Column) -> Column:
    return F.transform(lines, lambda x, i: F.when(
        i == slot.line - 1, F.overlay(x, value, slot.start, slot.width)).otherwise(x))


def _repaired(lines: Column, layout: Layout, conf: Column | None, body) -> Column:
    """Bind normalised lines, corrections and the composite solution in turn.

    ``body`` receives (zone lines after repair, array of corrections).  Every step
    is a lambda binding over an array of fields, so the search appears once in
    the expression however many fields there are and however often a later step
    looks at an earlier one.
    """
    names, let = layout.repaired, repair.let

    def parts(norm: Column) -> Column:
        return F.array(*[F.struct(
            F.lit(n).alias("name"), _cut(norm, layout.slots[n]).alias("raw"),
            _digit(norm, layout.slots[n]).alias("cd"),
            (F.lit(None) if conf is None else F.try_element_at(conf, F.lit(n))).cast("array<double>").alias("conf"))
            for n in names])

    def correct(part: Column) -> Column:
        return repair.repair_field(part["raw"], part["cd"], repair.confusion_map_for(part["name"]),
                                   None if conf is None else part["conf"])

    def solution(norm: Column, fixes: Column) -> Column:
        blanked = norm
        for n in names:
            slot = layout.slots[n]
            blanked = _overwrite(blanked, slot, F.lit("<" * slot.width))

        def solve(blank: Column) -> Column:
            source, digit = _composite(blank, layout)
            return repair.resolve_composite(
                fixes, [composite_offset(layout, n) for n in names], source, digit)

        return F.when(F.exists(fixes, lambda c: c["ambiguous"]), let(blanked, solve))

    def final(norm: Column, fixes: Column) -> Column:
        out = norm
        for k, n in enumerate(names):
            out = _overwrite(out, layout.slots[n], F.get(fixes, F.lit(k))["value"])
        return out

    return let(
        F.transform(lines, lambda x: t.normalize_line(x, layout.width)),
        lambda norm: let(F.transform(parts(norm), correct), lambda fixes: let(
            solution(norm, fixes), lambda won: let(
                F.transform(fixes, lambda c, i: repair.apply_solution(c, won, i)),
                lambda done: let(final(norm, done), lambda zone: body(zone, done))))))


def repair_zone(df: DataFrame, layout: Layout, lines: str = "lines",
                conf: str | None = None) -> DataFrame:
    """Repair the digit-protected fields and resolve ties by the composite digit.

    Adds ``zone`` (normalised lines after repair), one ``fix_<field>`` struct per
    repaired field and ``composite_ok``.  ``conf`` may name a map column
    field -> array<double> with a confidence per character.
    """
    def body(zone: Column, fixes: Column) -> Column:
        source, digit = _composite(zone, layout)
        return F.struct(zone.alias("zone"), verify_check_digit(source, digit).alias("composite_ok"),
                        *[F.get(fixes, F.lit(k)).alias(f"fix_{n}") for k, n in enumerate(layout.repaired)])

    c = None if conf is None else F.col(conf)
    return df.withColumn("_z", _repaired(F.col(lines), layout, c, body)).select(
        *df.columns, "_z.*")


@functools.cache
def _zone_column(layout: Layout, with_conf: bool, gateway: int) -> Column:
    """The zone evaluation over the columns ``_lines``, ``_today`` and ``_conf``.

    Building a few thousand expression nodes takes seconds in Python, so each
    layout is built once per driver process (``gateway`` names its JVM).
    """
    today = F.col("_today")

    def body(zone: Column, fixes: Column) -> Column:
        fix = {n: F.get(fixes, F.lit(k)) for k, n in enumerate(layout.repaired)}
        carrier = (fix["personal_number"]["value"] if "personal_number" in fix
                   else _cut(zone, layout.slots["optional1"]))
        number = t.digits(carrier)
        parts = F.struct(
            zone_date(fix["birth_date"]["value"], "birth", today).alias("birth"),
            zone_date(fix["expiry_date"]["value"], "expiry", today).alias("expiry"),
            split_names(_cut(zone, layout.slots["names"])).alias("names"),
            F.regexp_extract(_cut(zone, layout.slots["sex"]), "^[MF]$", 0).alias("sex"),
            t.mrz_to_display(_cut(zone, layout.slots["nationality"])).alias("nation"),
            number.alias("pinfl"), decode_pinfl(number).alias("decoded"),
            _all_valid(zone, layout).alias("valid"))
        return repair.let(parts, lambda x: _evaluated(zone, fixes, fix, x, layout))

    return _repaired(F.col("_lines"), layout, F.col("_conf") if with_conf else None, body)


def zone_fields(df: DataFrame, layout: Layout, today: Column, lines: str = "lines",
                conf: str | None = None) -> DataFrame:
    """Whole zone evaluation per document.

    Adds ``found, format, fields`` (array of field entries), ``corrections``,
    ``warnings``, ``ambiguous_fields``, ``all_valid``, ``zone`` and ``doc_type``.
    """
    column = _zone_column(layout, conf is not None, id(SparkContext._gateway))
    inputs = df.withColumns({"_lines": F.col(lines), "_today": today,
                             **({"_conf": F.col(conf)} if conf else {})})
    return inputs.withColumn("_z", column).select(
        *df.columns, F.lit(layout.name).alias("format"), F.lit(True).alias("found"),
        F.lit("id_card" if layout is TD1 else "passport").alias("doc_type"), "_z.*")


def _all_valid(zone: Column, layout: Layout) -> Column:
    """Struct(fields, composite): whether every field digit and the composite hold."""
    fields = F.lit(True)
    for slot in layout.slots.values():
        if slot.digit:
            fields = fields & verify_check_digit(_cut(zone, slot), _digit(zone, slot))
    source, digit = _composite(zone, layout)
    return F.struct(fields.alias("fields"),
                    verify_check_digit(source, digit).alias("composite"))


def _evaluated(zone: Column, fixes: Column, fix: dict[str, Column], x: Column, layout: Layout) -> Column:
    names = F.array(*[F.lit(n) for n in layout.repaired])
    has_pinfl = F.length(x["pinfl"]) == 14
    pinfl_sure = x["decoded"]["structure_valid"]
    if "personal_number" in fix:
        pinfl_sure = pinfl_sure & repair.trustworthy(fix["personal_number"])
    number = repair.let(fix["doc_number"], lambda c: zone_field(
        "documents.0.doc_number", t.mrz_to_display(c["value"]), repair.trustworthy(c), c))
    entries = F.array(
        number,
        zone_field("documents.0.expiry_date", F.date_format(x["expiry"], "yyyy-MM-dd"),
                   repair.trustworthy(fix["expiry_date"])),
        zone_field("person.birth_date", F.date_format(x["birth"], "yyyy-MM-dd"),
                   repair.trustworthy(fix["birth_date"])),
        zone_field("person.sex", x["sex"], x["sex"] != ""),
        zone_field("person.nationality", x["nation"], F.lit(True)),
        zone_field("person.citizenship", x["nation"], F.lit(True)),
        F.when(has_pinfl, field_struct(
            "person.pinfl", x["pinfl"], F.when(pinfl_sure, 0.9).otherwise(0.4), "mrz",
            False, None, F.nullif(F.array_join(x["decoded"]["errors"], "; "), F.lit("")))))

    def per_field(text) -> Column:
        return F.array_compact(F.transform(fixes, lambda c, i: text(F.get(names, i), c)))

    doubts = per_field(lambda n, c: F.when(c["ambiguous"], F.concat(
        F.lit(msg.AMBIGUOUS_FIELD[0]), n, F.lit(msg.AMBIGUOUS_FIELD[1]),
        F.array_join(F.slice(c["candidates"], 1, 3), ", "), F.lit(msg.AMBIGUOUS_FIELD[2]))))
    own = [F.when(~x["valid"]["composite"], F.lit(msg.COMPOSITE_FAILED))]
    if layout is TD1:
        own = pinfl_consistency(has_pinfl, x["decoded"], x["sex"], x["birth"]) + own
    repaired = per_field(lambda n, c: F.when(
        repair.changed(c), F.concat(F.lit(msg.REPAIRED), repair.describe(n, c))))
    return F.struct(
        zone.alias("zone"),
        F.array_compact(F.concat(name_fields(x["names"]), entries)).alias("fields"),
        per_field(lambda n, c: F.when(c["ambiguous"], n)).alias("ambiguous_fields"),
        F.concat(doubts, F.array_compact(F.array(*own)), repaired).alias("warnings"),
        per_field(lambda n, c: F.when(repair.changed(c) | c["ambiguous"], F.struct(
            n.alias("name"), c.alias("correction")))).alias("corrections"),
        (x["valid"]["fields"] & x["valid"]["composite"]).alias("all_valid"))


def pinfl_consistency(present: Column, decoded: Column, sex: Column,
                      birth: Column) -> list[Column]:
    """Warnings when the personal number contradicts the zone."""
    ok = present & decoded["structure_valid"]
    return [F.when(ok & (sex != "") & (decoded["sex"] != sex), F.lit(msg.PINFL_SEX)),
            F.when(ok & (decoded["birth_date"] != birth), F.lit(msg.PINFL_BIRTH))]


def parse_mrz(df: DataFrame, today: Column, lines: str = "lines",
              conf: str | None = None) -> DataFrame:
    """Dispatch on line count: three lines TD1, two TD3, anything else not found."""
    cleaned = df.withColumn(lines, F.filter(
        F.transform(F.col(lines), t.strip), lambda x: x != ""))
    n = F.size(lines)
    td1 = zone_fields(cleaned.filter(n == 3), TD1, today, lines, conf)
    td3 = zone_fields(cleaned.filter(n == 2), TD3, today, lines, conf)
    none = (cleaned.filter(~n.isin(2, 3)).withColumn("found", F.lit(False))
            .withColumn("reason", F.concat(F.lit("unexpected MRZ line count: "),
                                           F.size(lines).cast("string"),
                                           F.lit(" (expected 2 or 3)"))))
    return (td1.unionByName(td3, allowMissingColumns=True)
            .unionByName(none, allowMissingColumns=True))


def is_zone_line(text: Column) -> Column:
    """Lines that look like a zone: at least 28 characters, two fillers, no punctuation."""
    s = as_zone_text(text)
    # Upper case lengthens only what is not ASCII: a short plain line needs no pattern.
    may = (F.length(text) >= 28) | (F.octet_length(text) > F.length(text))
    fillers = F.length(s) - F.length(F.replace(s, F.lit("<"), F.lit("")))
    return may & (F.length(s) >= 28) & (fillers >= 2) & s.rlike(r"^[\p{L}\p{N}<]+$")


def as_zone_text(text: Column) -> Column:
    return F.translate(F.upper(t.strip(text)), " ", "<")


def mrz_candidates(lines: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, lines): the last three zone-shaped lines of each document.

    The rank filter becomes a group limit before the shuffle, so even a document
    with very many lines sends three rows per task.
    """
    zone = lines.filter(is_zone_line(F.col(text))).select(
        "doc_id", "line_no", as_zone_text(F.col(text)).alias("text"))
    newest = Window.partitionBy("doc_id").orderBy(F.col("line_no").desc())
    last = zone.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= 3)
    return last.groupBy("doc_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"])
        .alias("lines"))


def explode_fields(df: DataFrame, *keys: str) -> DataFrame:
    """Long field table from the ``fields`` array."""
    # The outer form keeps the optimizer from inferring a non-empty filter and
    # pushing a second copy of the zone evaluation below the projection.
    return df.select(*keys, F.inline_outer("fields")).filter(F.col("path").isNotNull())
