"""String normalisation and transliteration as Column expressions."""

from __future__ import annotations

import unicodedata
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, functions as F

TURNED_COMMA = "ʻ"

# Apostrophe look-alikes that all mean U+02BB.
APOSTROPHES = "'‘’`´ʼ′"

# Uzbek Latin letter groups and their Cyrillic letters, longest
# first; upper- and title-case spellings follow by rule.
LATIN_GROUPS = [
    ("shch", "щ"), ("oʻ", "ў"), ("gʻ", "ғ"), ("ch", "ч"), ("sh", "ш"),
    ("yo", "ё"), ("yu", "ю"), ("ya", "я"), ("ts", "ц"), ("ng", "нг"),
]
# Single Latin letters and their Cyrillic letters.
LATIN_SINGLE = "abdefghijklmnopqrstuvxyz"
CYRILLIC_SINGLE = "абдефгҳижклмнопқрстувхйз"

# Cyrillic letters written with one Latin letter, and those
# written with none or several.
CYRILLIC_ONE = "абвгдезийкқлмнопрстуфхҳэы"
LATIN_ONE = "abvgdeziykqlmnoprstufxhei"
CYRILLIC_MANY = {
    "ғ": "gʻ", "ё": "yo", "ж": "j", "ў": "oʻ", "ц": "ts", "ч": "ch",
    "ш": "sh", "щ": "shch", "ъ": "ʻ", "ь": "", "ю": "yu", "я": "ya",
}

# What Python and Spark users both call white space, spelled out so that the
# JVM and RE2 agree on it.
WHITESPACE = (r"[\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}"
              r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(c, rf"^{WHITESPACE}+|{WHITESPACE}+\z", "")


def normalize_apostrophes(c: Column) -> Column:
    return F.translate(c, APOSTROPHES, TURNED_COMMA * len(APOSTROPHES))


def latin_to_cyrillic(c: Column) -> Column:
    out = normalize_apostrophes(c)
    for latin, cyrillic in LATIN_GROUPS:
        spellings = {latin.upper(): cyrillic.upper(),
                     latin[0].upper() + latin[1:]: cyrillic[0].upper() + cyrillic[1:],
                     latin: cyrillic}
        for spelling, letters in spellings.items():
            out = F.replace(out, F.lit(spelling), F.lit(letters))
    return F.translate(out, LATIN_SINGLE + LATIN_SINGLE.upper() + TURNED_COMMA,
                       CYRILLIC_SINGLE + CYRILLIC_SINGLE.upper() + "ъ")


def cyrillic_to_latin(c: Column) -> Column:
    out = c
    for letter, latin in CYRILLIC_MANY.items():
        title = latin[:1].upper() + latin[1:]
        out = F.replace(out, F.lit(letter), F.lit(latin))
        out = F.replace(out, F.lit(letter.upper()), F.lit(title))
    return F.translate(out, CYRILLIC_ONE + CYRILLIC_ONE.upper(),
                       LATIN_ONE + LATIN_ONE.upper())


def collapse(c: Column) -> Column:
    """Runs of white space become one blank; the ends are trimmed."""
    return F.trim(F.regexp_replace(c, rf"{WHITESPACE}+", " "))


def mrz_to_display(c: Column) -> Column:
    return collapse(F.translate(c, "<", " "))


def to_mrz_name(surname: Column, given: Column, patronymic: Column) -> Column:
    """Name line of a machine-readable zone: SURNAME<<GIVEN<PATRONYMIC."""
    def fold(c: Column) -> Column:
        upper = F.upper(cyrillic_to_latin(F.coalesce(c, F.lit(""))))
        bare = F.translate(upper, TURNED_COMMA + "'", "")
        return F.regexp_replace(bare, r"[^\p{L}\p{N}]", "<")

    def filled(c: Column) -> Column:
        return F.when(c != "", c)

    givens = F.concat_ws("<", filled(fold(given)), filled(fold(patronymic)))
    return F.when(givens == "", fold(surname)).otherwise(
        F.concat(fold(surname), F.lit("<<"), givens))


def title_case_name(c: Column) -> Column:
    """First character of each word upper, the rest lower; keeps Oʻ and Gʻ."""
    words = F.split(collapse(normalize_apostrophes(c)), " ")
    return F.array_join(
        F.transform(words, lambda w: F.concat(
            F.upper(F.substring(w, 1, 1)),
            F.lower(F.substring(w, F.lit(2), F.length(w))))), " ")


def full_name(surname: Column, given: Column, patronymic: Column) -> Column:
    return F.concat_ws(" ", *[F.nullif(x, F.lit("")) for x in (surname, given, patronymic)])


def normalize_line(c: Column, width: int) -> Column:
    """Exact-width line over the alphabet A-Z 0-9 <."""
    upper = F.translate(F.upper(strip(c)), " ", "<")
    return F.rpad(F.regexp_replace(upper, "[^A-Z0-9<]", ""), width, "<")


def norm_lines(lines: Column, count: int, width: int) -> Column:
    """Exact-width lines without alphabet check; NULL when the count differs."""
    return F.when(F.size(lines) == count, F.transform(
        lines, lambda x: F.rpad(F.translate(F.upper(strip(x)), " ", "<"), width, "<")))


def normalize_input(c: Column) -> Column:
    """White-space-insensitive, case-preserving form used in cache keys."""
    return collapse(c)


def norm_for_compare(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def digits(c: Column) -> Column:
    """Keep decimal digits, superscripts and subscripts included."""
    return F.regexp_replace(
        c, r"[^\p{Nd}\x{b2}\x{b3}\x{b9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}]", "")


def rule_norm(c: Column) -> Column:
    return strip(F.lower(normalize_apostrophes(c)))


# Blocks with characters that stand for Latin letters, digits or Cyrillic.
_FOLD_BLOCKS = [(0x30, 0x233), (0x2B0, 0x2E3), (0x400, 0x4FF), (0x1C80, 0x1C8F), (0x1D2C, 0x1DBF), (0x1E00, 0x1EFF), (0x2070, 0x20A8),
                (0x2100, 0x218F), (0x2460, 0x24FF), (0x2C60, 0x2C7F), (0x3200, 0x33FF), (0xA640, 0xA69F), (0xA7F2, 0xA7F9), (0xFB00, 0xFB06),
                (0xFF10, 0xFF5A), (0x10780, 0x107BA), (0x1D400, 0x1D7FF), (0x1E030, 0x1E08F), (0x1F100, 0x1F1FF), (0x1FBF0, 0x1FBF9)]
_FOLD_KEPT = r"A-Z0-9\x{0400}-\x{04ff}"


def _fold_table() -> tuple[dict[str, str], dict[str, str], str]:
    """Characters with one comparison character, those with several, and those of the kept class with none.

    The compatibility decomposition of a character, without marks and in upper case,
    does not depend on its neighbours, so a table of single characters is exact.
    """
    one, many, none = {}, {}, []
    for first, last in _FOLD_BLOCKS:
        for ch in map(chr, range(first, last + 1)):
            parts = [x for x in unicodedata.normalize("NFKD", ch) if unicodedata.combining(x) == 0]
            shown = "".join(x for x in "".join(parts).upper() if x.isascii() and x.isalnum() or 0x400 <= ord(x) < 0x500)
            if len(shown) > 1:
                many[ch] = shown
            elif shown and shown != ch:
                one[ch] = shown
            elif not shown and 0x400 <= ord(ch) < 0x500:
                none.append(ch)
    return one, many, "".join(none)


_FOLD_ONE, _FOLD_MANY, _FOLD_GONE = _fold_table()
_RARE = "".join(ch for ch in _FOLD_MANY if ch != "ß")
# Signs that stand for nothing; a table drops them for less than a class that matches at every blank.
_PLAIN_GONE = "".join(ch for ch in map(chr, range(0x80)) if not ch.isalnum())
_SIGNS_GONE = "".join(ch for first, last in ((0x80, 0xFF), (0x2B0, 0x36F), (0x2000, 0x206F)) for ch in map(chr, range(first, last + 1))
                      if ch not in _FOLD_ONE and ch not in _FOLD_MANY)
# ASCII, letters of Latin-1 and Cyrillic: none of them becomes several characters, but sharp s.
_COMMON = r"\x00-\x7f\x{c0}-\x{ff}\x{400}-\x{4ff}"


def norm_for_grounding(c: Column) -> Column:
    """Comparison form: marks dropped, upper, A-Z 0-9 and Cyrillic kept, of any script, inside the JVM.

    Plain ASCII (as many bytes as characters) needs a short table only.  Sharp s, the one common
    letter that becomes two, is replaced; only texts whose other characters hold one of
    the rare signs that become several (fractions, units, numbered lists) are cut up,
    common stretches whole, and looked up; then one ``translate``, which also drops
    blanks and usual signs, and one class drops what is left.
    """
    spread = F.replace(c, F.lit("ß"), F.lit("SS"))
    table = F.create_map(*[F.lit(x) for ch in _RARE for x in (ch, _FOLD_MANY[ch])])
    each = F.regexp_extract_all(spread, F.lit(rf"(?s)[{_COMMON}]+|."), F.lit(0))
    spelled = F.array_join(F.transform(each, lambda part: F.when(F.length(part) > 1, part).otherwise(
        F.coalesce(F.try_element_at(table, part), part))), "")
    # A class of many scattered signs costs a test for each, so common characters are dropped before it is asked.
    unusual = F.regexp_replace(spread, f"[{_COMMON}]+", "")
    known = F.when((unusual != "") & unusual.rlike(f"[{_RARE}]"), spelled).otherwise(spread)
    shown = F.translate(known, "".join(_FOLD_ONE) + _FOLD_GONE + _PLAIN_GONE + _SIGNS_GONE, "".join(_FOLD_ONE.values()))
    plain = F.translate(c, ascii_lowercase + _PLAIN_GONE, ascii_uppercase)
    return F.when(F.octet_length(c) == F.length(c), plain).otherwise(
        F.regexp_replace(shown, f"[^{_FOLD_KEPT}]+", ""))


def strip_fences(c: Column) -> Column:
    """Drop the code-fence markers a model wraps JSON in."""
    return strip(F.regexp_replace(strip(c), r"(?dm)^```(?:json)?|```$", ""))


def let(value: Column, body) -> Column:
    """Bind a Column once and use it many times inside ``body``.

    Without the binding every use would repeat the whole expression, and plans
    built from such uses grow exponentially with the number of steps.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def extract_json(c: Column) -> Column:
    """The JSON object inside a model reply as JSON text, NULL when there is none.

    A text that parses but is no object is final; only text that does not parse
    is cut from its first to its last brace and tried again.
    """
    def inner(bare: Column) -> Column:
        first = F.instr(bare, "{")
        last = F.length(bare) - F.instr(F.reverse(bare), "}") + 1
        return F.when((first > 0) & (last > first) & F.contains(bare, F.lit("}")),
                      F.substring(bare, first, last - first + 1))

    def kind(text: Column) -> Column:
        return F.schema_of_variant(F.try_parse_json(text))

    def parsed(bare: Column) -> Column:
        return let(kind(bare), lambda k: F.when(k.startswith("OBJECT"), bare).when(
            k.isNull(), let(inner(bare), lambda cut: F.when(
                kind(cut).startswith("OBJECT"), cut))))

    return let(strip_fences(c), parsed)


# Progress labels shown per job status.
STAGE_LABELS = {
    "queued": "Navbatda",
    "preprocessing": "Rasm tayyorlanmoqda",
    "classifying": "Hujjat turi aniqlanmoqda",
    "extracting": "Ma'lumotlar o'qilmoqda",
    "validating": "Tekshirilmoqda",
    "done": "Tayyor",
}


def stage_label(status: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for kv in STAGE_LABELS.items() for x in kv])
    return F.coalesce(F.try_element_at(labels, status), status)
