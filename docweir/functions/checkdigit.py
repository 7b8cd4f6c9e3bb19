"""Mod-10 check digits, zone dates and personal identification numbers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The repeating weights and the value of each zone character.
WEIGHTS = (7, 3, 1)
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Only the value modulo ten matters to a check digit, so every character can be
# replaced by one decimal digit: A=10 -> 0, B=11 -> 1, filler -> 0.
_MOD10 = "".join(str(i % 10) for i in range(len(ALPHABET)))


def char_value(c: Column) -> Column:
    """0-9, A-Z as 10-35, filler as 0; NULL for any other character."""
    up = F.upper(c)
    return (F.when(up == "<", F.lit(0))
            .when(up.rlike(r"^[0-9A-Z]$"), F.instr(F.lit(ALPHABET), up) - 1))


def to_residues(c: Column) -> Column:
    """Replace each zone character by its value modulo ten."""
    return F.translate(F.upper(c), ALPHABET[10:] + "<", _MOD10[10:] + "0")


def weighted_sum(c: Column, width: int, offset: int = 0) -> Column:
    """Weighted residue of a fixed-width string placed at ``offset``, modulo ten.

    Unrolled over the width so that it stays inside generated code.
    """
    res = to_residues(c)
    total = F.lit(0)
    for i in range(width):
        digit = F.ascii(F.substring(res, i + 1, 1)) - F.lit(48)
        total = total + digit * F.lit(WEIGHTS[(offset + i) % 3])
    return total % 10


def check_digit(c: Column, width: int | None = None) -> Column:
    """Check digit of a zone string; NULL when it holds an illegal character."""
    legal = c.rlike(r"^[0-9A-Za-z<]*$")
    if width is not None:
        return F.when(legal, weighted_sum(c, width))
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    terms = F.transform(
        F.filter(F.split(to_residues(c), ""), lambda ch: ch != ""),
        lambda ch, i: ch.cast("int") * F.get(weights, i % 3))
    return F.when(legal, F.aggregate(terms, F.lit(0), lambda a, b: a + b) % 10)


def verify_check_digit(c: Column, digit: Column, width: int | None = None) -> Column:
    """Whether ``digit`` belongs to ``c``; filler is right only for an all-filler field."""
    return (F.when(digit == "<", c.rlike("^<*$"))
            .when(digit.rlike("^[0-9]$"),
                  F.coalesce(check_digit(c, width) == digit.cast("int"), F.lit(False)))
            .otherwise(F.lit(False)))


def zone_date(c: Column, kind: str, today: Column) -> Column:
    """YYMMDD to DATE: expiry in 20xx, birth pivoted on the current two-digit year."""
    yy = F.substring(c, 1, 2)
    if kind == "expiry":
        century = F.lit("20")
    else:
        century = F.when(yy.cast("int") > F.year(today) % 100, "19").otherwise("20")
    return F.when(c.rlike("^[0-9]{6}$"),
                  F.try_to_date(F.concat(century, c), "yyyyMMdd"))


# Century and sex encoded in the first digit.
MARKERS = {"1": ("18", "M"), "2": ("18", "F"), "3": ("19", "M"),
           "4": ("19", "F"), "5": ("20", "M"), "6": ("20", "F")}


def decode_pinfl(c: Column) -> Column:
    """Structure of a 14-digit personal number.

    The final control digit is not verified: its algorithm is not published, so
    this never makes a value ``validated``.
    """
    marker = F.substring(c, 1, 1)

    def lookup(position: int) -> Column:
        entries = [F.lit(x) for k, v in MARKERS.items() for x in (k, v[position])]
        return F.try_element_at(F.create_map(*entries), marker)

    well_formed = F.coalesce(c.rlike(r"^[0-9]{14}$"), F.lit(False))
    century, sex = lookup(0), lookup(1)
    birth = F.when(well_formed & century.isNotNull(), F.try_to_date(
        F.concat(century, F.substring(c, 6, 2), F.substring(c, 4, 2), F.substring(c, 2, 2)),
        "yyyyMMdd"))
    error = (F.when(~well_formed, F.lit("PINFL must be exactly 14 digits"))
             .when(century.isNull(), F.concat(F.lit("unknown century/sex marker: "), marker))
             .when(birth.isNull(), F.lit("invalid birth date encoded in PINFL")))
    return F.struct(
        birth.isNotNull().alias("structure_valid"),
        F.lit(False).alias("checksum_verified"),
        birth.alias("birth_date"),
        F.when(well_formed, sex).alias("sex"),
        F.when(birth.isNotNull(), F.substring(c, 8, 2)).alias("region_code"),
        F.when(error.isNotNull(), F.array(error)).otherwise(
            F.array().cast("array<string>")).alias("errors"))
