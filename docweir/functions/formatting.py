"""Document-formatting functions usable in templates and on columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from docweir.functions import text as t

# Month names and number words of the rendered documents.
MONTHS_UZ = ["yanvar", "fevral", "mart", "aprel", "may", "iyun", "iyul",
             "avgust", "sentabr", "oktabr", "noyabr", "dekabr"]
MONTHS_RU = ["января", "февраля", "марта", "апреля", "мая", "июня", "июля",
             "августа", "сентября", "октября", "ноября", "декабря"]
ONES = ["", "bir", "ikki", "uch", "to'rt", "besh", "olti", "yetti", "sakkiz", "to'qqiz"]
TENS = ["", "o'n", "yigirma", "o'ttiz", "qirq", "ellik", "oltmish", "yetmish",
        "sakson", "to'qson"]
SCALES = [(10**9, "milliard"), (10**6, "million"), (1000, "ming"), (1, "")]
BLANK = "____________"


def _pick(words: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(w) for w in words]), index)


def as_date(c: Column) -> Column:
    """First of ISO, dotted and slashed day-first dates that parses, else NULL."""
    s = t.strip(c)
    shapes = [(r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
              (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"),
              (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy")]
    return F.coalesce(*[F.when(s.rlike(shape), F.try_to_date(s, pattern))
                        for shape, pattern in shapes])


def _or_echo(formatted: Column, c: Column) -> Column:
    return F.coalesce(formatted, c, F.lit(""))


def date_uz(c: Column) -> Column:
    d = as_date(c)
    return _or_echo(F.concat(F.day(d).cast("string"), F.lit("-"),
                             _pick(MONTHS_UZ, F.month(d) - 1), F.lit(", "),
                             F.year(d).cast("string"), F.lit("-yil")), c)


def date_uz_short(c: Column) -> Column:
    return _or_echo(F.date_format(as_date(c), "dd.MM.yyyy"), c)


def date_ru(c: Column) -> Column:
    d = as_date(c)
    return _or_echo(F.concat(F.day(d).cast("string"), F.lit(" "),
                             _pick(MONTHS_RU, F.month(d) - 1), F.lit(" "),
                             F.year(d).cast("string"), F.lit(" г.")), c)


def date_iso(c: Column) -> Column:
    return _or_echo(F.date_format(as_date(c), "yyyy-MM-dd"), c)


def upper_uz(c: Column) -> Column:
    return F.coalesce(F.upper(t.normalize_apostrophes(c)), F.lit(""))


def lower_uz(c: Column) -> Column:
    return F.coalesce(F.lower(t.normalize_apostrophes(c)), F.lit(""))


def pinfl_spaced(c: Column) -> Column:
    d = t.digits(c)
    return F.when(F.length(d) == 14, F.regexp_replace(
        d, "^(.)(.{4})(.{4})(.{4})(.)$", "$1 $2 $3 $4 $5")).otherwise(
        F.coalesce(c, F.lit("")))


def _below_thousand(n: int) -> str:
    """Words of 0..999; the empty string for zero."""
    hundreds, rest = divmod(n, 100)
    head = "" if hundreds == 0 else "yuz" if hundreds == 1 else f"{ONES[hundreds]} yuz"
    return " ".join(w for w in (head, TENS[rest // 10], ONES[rest % 10]) if w)


def amount_words(c: Column) -> Column:
    """Whole amounts in Uzbek words; NULL from one trillion up.

    The words of 0..999 are a constant array, so a row costs four lookups.
    """
    said = F.split(F.lit("|".join(_below_thousand(n) for n in range(1000))), r"\|")
    number = F.translate(t.strip(c), " ,", "").try_cast("double")

    def words(n: Column) -> Column:
        parts = []
        for size, label in SCALES:
            count = (F.floor(n / size) if size == 10**9 else F.floor(n / size) % 1000).cast("int")
            text = F.get(said, count)
            if size == 1000:
                text = F.when(count == 1, F.lit("")).otherwise(text)
            parts.append(F.when(count > 0, F.trim(F.concat(text, F.lit(" " + label)))))
        return F.concat_ws(" ", *parts)

    def spoken(n: Column) -> Column:
        return (F.when(n.isNull(), F.coalesce(c, F.lit("")))
                .when(F.abs(n) >= 1e12, F.lit(None).cast("string"))
                .when(F.abs(n) < 1, F.lit("nol")).when(n < 0, F.lit(""))
                .otherwise(words(n.cast("bigint"))))

    return t.let(number, spoken)


def initials(c: Column) -> Column:
    parts = F.filter(F.split(t.collapse(c), " "), lambda p: p != "")
    rest = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1))),
                       lambda p: F.upper(F.substring(p, 1, 1)))
    first = F.coalesce(F.get(parts, F.lit(0)), F.lit(""))
    return F.when(F.size(parts) > 1, F.concat(
        first, F.lit(" "), F.array_join(rest, "."), F.lit("."))).otherwise(first)


def cyrillic(c: Column) -> Column:
    return F.coalesce(t.latin_to_cyrillic(c), F.lit(""))


def latin(c: Column) -> Column:
    return F.coalesce(t.cyrillic_to_latin(c), F.lit(""))


def default_blank(c: Column, blank: str = BLANK) -> Column:
    """Fill-in line for an empty value; apostrophes normalised otherwise."""
    empty = F.coalesce(t.strip(c), F.lit("")) == ""
    return F.when(empty, F.lit(blank)).otherwise(t.normalize_apostrophes(c))


FILTERS = {
    "date_uz": date_uz, "date_uz_short": date_uz_short, "date_ru": date_ru,
    "date_iso": date_iso, "upper_uz": upper_uz, "lower_uz": lower_uz,
    "cyrillic": cyrillic, "latin": latin, "pinfl_spaced": pinfl_spaced,
    "amount_words": amount_words, "initials": initials,
}
