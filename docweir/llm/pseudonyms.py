"""Personal data: format-preserving Feistel pseudonyms.

A number or date that passes its check is replaced by another of the same layout
that passes it too.  The replacement is a keyed permutation of all valid values of
that kind and size, so equal values get equal pseudonyms in every document,
however they are spaced, and different values different ones.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
import string
from collections.abc import Callable, Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from docweir.llm.words import slices

ROUNDS = 10
KINDS = ("email", "iban", "ip", "date", "card", "ssn", "phone")

_PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![A-Za-z])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{2,4}[ .-]?[0-9]{2,4}"
             r"(?:[ .-]?[0-9]{2,4})?(?![0-9])|\+[0-9]{7,15}(?![0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}([-./])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-./])[0-9]{1,2}\2[0-9]{4})(?![0-9]|[./-][0-9])",
}
_COMPILED = {kind: re.compile(pattern) for kind, pattern in _PATTERNS.items()}
#: Kinds whose groups may stand beside other numbers or words, so that a part of a run can be the number.
_SPLIT = {"iban": r"[A-Z]{2}[0-9]{2}", "card": r"[0-9]", "phone": r"[+(0-9]"}
_INSIDE = {kind: string.digits + string.ascii_letters * (kind == "iban") for kind in _SPLIT}
_STARTS = {kind: re.compile(rf"(?<![{_INSIDE[kind]}]){first}") for kind, first in _SPLIT.items()}
_LONGEST = 67    # characters of 34 with a space between any two
_IBAN_SIZES = {country: n for n, countries in {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
    27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC",
    32: "LC"}.items() for country in countries.split()}
_NETWORK = re.compile(r"4(?:.{12}|.{15}|.{18})|(?:5[1-5]|2[2-7]).{14}|3[47].{13}|6.{15,18}|3[0689].{12}")
_NANP = re.compile(r"(?:1[ .-])?(?:[0-9]{3}[ .-]|\([0-9]{3}\)[ .-]?)[0-9]{3}[ .-][0-9]{4}")
_FIRST_DAY, _LAST_DAY = dt.date(1800, 1, 1).toordinal(), dt.date(2199, 12, 31).toordinal()


def permute(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of ``range(size)``: a Feistel network over pairs of digits of base ceil(sqrt(size)).

    Values that land beyond ``size`` go round again until one is within.
    """
    if size < 2:
        return value
    base = isqrt(size - 1) + 1
    width = (base.bit_length() + 7) // 8 + 8
    name = hashlib.blake2b(f"{tweak}:{size}".encode(), key=key[:64], digest_size=32).digest()
    while True:
        left, right = divmod(value, base)
        for turn in range(ROUNDS):
            block = hashlib.shake_256(name + bytes([turn]) + right.to_bytes(width, "big")).digest(width)
            left, right = right, (left + int.from_bytes(block, "big")) % base
        value = left * base + right
        if value < size:
            return value


def luhn_digit(payload: str) -> str:
    """The check digit that completes a card number."""
    total = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(payload)))
    return str(-total % 10)


def _filled(layout: str, digits: str) -> str:
    """The layout with its digits replaced in turn."""
    rest = iter(digits)
    return "".join(next(rest) if c in string.digits else c for c in layout)


def _digits(text: str) -> str:
    return "".join(c for c in text if c in string.digits)


def _characters(text: str, key: bytes, tweak: str) -> str:
    """Letters and digits permuted as one number of mixed base; all other characters stay."""
    sets = [next((s for s in (string.ascii_lowercase, string.ascii_uppercase, string.digits) if c in s), "") for c in text]
    value, size = 0, 1
    for c, own in zip(text, sets):
        if own:
            value, size = value * len(own) + own.index(c), size * len(own)
    value = permute(value, size, key, tweak + "".join(s[:1] or c for c, s in zip(text, sets)))
    out = []
    for c, own in zip(reversed(text), reversed(sets)):
        if own:
            value, place = divmod(value, len(own))
            c = own[place]
        out.append(c)
    return "".join(reversed(out))


def _email(text: str, key: bytes) -> str | None:
    name, _, host = text.lower().rpartition("@")
    owner, dot, top = host.rpartition(".")
    return f"{_characters(name, key, 'name')}@{_characters(owner, key, 'host')}{dot}{top}"


def _iban_check(country: str, account: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in account + country + "00")) % 97


def _iban(text: str, key: bytes) -> str | None:
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or int(plain[2:4]) != _iban_check(plain[:2], plain[4:]):
        return None
    account = _characters(plain[4:], key, f"iban{plain[:2]}")
    rest = iter(f"{plain[:2]}{_iban_check(plain[:2], account):02d}{account}")
    return "".join(c if c == " " else next(rest) for c in text)


def _card(text: str, key: bytes) -> str | None:
    plain = _digits(text)
    if luhn_digit(plain[:-1]) != plain[-1]:
        return None
    n = len(plain) - 2    # the first digit names the network, the last one checks
    payload = plain[0] + str(permute(int(plain[1:-1]), 10 ** n, key, "card" + plain[0])).zfill(n)
    return _filled(text, payload + luhn_digit(payload))


def _ssn(text: str, key: bytes) -> str | None:
    area, group, serial = map(int, text.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    own = area - 1 - (area > 666)
    value = permute((own * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, key, "ssn")
    rest, serial = divmod(value, 9999)
    own, group = divmod(rest, 99)
    return f"{own + 1 + (own >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _phone(text: str, key: bytes) -> str | None:
    plain = _digits(text)
    if not 9 <= len(plain) <= 15 or (text[0] != "+" and not 10 <= len(plain) <= 11):
        return None
    code = ""
    if text[0] == "+":    # the country code stays where a separator shows where it ends
        code = re.match(r"\+([0-9]{1,3})(?=[^0-9])|\+", text)[1] or plain[:1]
    rest = plain[len(code):]
    return _filled(text, code + str(permute(int(rest), 10 ** len(rest), key, "phone" + code)).zfill(len(rest)))


def _ip(text: str, key: bytes) -> str | None:
    parts = [int(x) for x in text.split(".")]
    if max(parts) > 255:
        return None
    value = permute(int.from_bytes(bytes(parts), "big"), 1 << 32, key, "ip")
    return ".".join(map(str, value.to_bytes(4, "big")))


def _date(text: str, key: bytes) -> str | None:
    parts = re.split(r"([-./])", text)
    a, mark, b, _, c = parts
    try:
        if len(a) == 4:
            order, day = "ymd", dt.date(int(a), int(b), int(c))
        else:
            order = "mdy" if mark == "/" and int(a) <= 12 < int(b) else "dmy"
            day = dt.date(int(c), *((int(a), int(b)) if order == "mdy" else (int(b), int(a))))
    except ValueError:
        return None
    if not _FIRST_DAY <= day.toordinal() <= _LAST_DAY:
        return None
    new = dt.date.fromordinal(_FIRST_DAY + permute(day.toordinal() - _FIRST_DAY, _LAST_DAY - _FIRST_DAY + 1, key, "date"))
    written = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
    return mark.join(written[x] for x in order)


_REPLACE: dict[str, Callable[[str, bytes], str | None]] = {
    "email": _email, "iban": _iban, "card": _card, "ssn": _ssn, "phone": _phone, "ip": _ip, "date": _date}


def _usual(kind: str, part: str) -> bool:
    """Whether a part has the size or layout that its country or network gives such numbers."""
    if kind == "iban":
        return len(part.replace(" ", "")) == _IBAN_SIZES.get(part[:2])
    return (_NETWORK if kind == "card" else _NANP).fullmatch(_digits(part) if kind == "card" else part) is not None


def _parts(kind: str, text: str, start: int, end: int, last: int) -> list[tuple[int, int]]:
    """Where a number of this kind may stand that begins in a run: the whole run, then parts of usual size, then any others.

    A part begins and ends where groups do.  Nothing but its layout tells a phone
    number, so one that begins within a run has a usual layout or another
    separator before it than inside.
    """
    found, inside = [], _INSIDE[kind]
    for m in _STARTS[kind].finditer(text, start, end):
        a = m.start()
        for b in range(a + 8, min(last, a + _LONGEST) + 1):
            if text[b - 1] in inside and (b == len(text) or text[b] not in inside) and _COMPILED[kind].fullmatch(text, a, b):
                usual = _usual(kind, text[a:b])
                if kind != "phone" or a == start or usual or text[a - 1] not in text[a:b]:
                    found.append(((a, b) != (start, end), not usual, a, -b))
    return [(a, -b) for _, _, a, b in sorted(found)]


def _numbers(kind: str, text: str, key: bytes, taken: list[tuple[int, int, str, str]], at: int = 0,
             last: int | None = None) -> Iterator[tuple[int, int, str, str]]:
    """Valid numbers of one kind from ``at`` to ``last``, outside of what is taken."""
    last = len(text) if last is None else last
    while m := _COMPILED[kind].search(text, at, last):
        at = m.end()
        for a, b in _parts(kind, text, *m.span(), last) if kind in _SPLIT else [m.span()]:
            if not any(x < b and a < y for x, y, _, _ in taken) and (new := _REPLACE[kind](text[a:b], key)) is not None:
                yield from _numbers(kind, text, key, taken, m.start(), a)    # what stands before the part
                yield a, b, kind, new
                at = b
                break


def pseudonymise(text: str, key: bytes) -> tuple[str, list[tuple[int, int, str]]]:
    """A text with every valid value replaced, and the spans (start, end, kind) that were.

    Where patterns overlap, the earlier kind in ``KINDS`` has it.  Where an IBAN,
    card or phone number stands beside other groups, every part of the run is tried.
    """
    spans: list[tuple[int, int, str, str]] = []
    for kind in KINDS:
        if kind == "email" and "@" not in text:
            continue
        spans += list(_numbers(kind, text, key, spans))
    if not spans:
        return text, []
    spans.sort()
    parts, at = [], 0
    for a, b, _, new in spans:
        parts += [text[at:a], new]
        at = b
    return "".join([*parts, text[at:]]), [s[:3] for s in spans]


def replace_private(docs: DataFrame, key: bytes, text: str = "text", found: str = "found") -> DataFrame:
    """``docs`` with the pseudonymised text in place, and what was replaced in ``found``.

    ``found`` is an array of (start, end, kind) in characters of the original text.
    E-mail addresses, IBANs (ISO 7064), card numbers (Luhn), US social security
    numbers, telephone numbers, IPv4 addresses and calendar dates from 1800 to 2199
    are replaced if valid; anything else stays as it is.  Null stays null with
    nothing found.  All rows and columns are kept (``found`` replaces a column of
    its name).  Whole texts are read; nothing is shuffled; an empty table gives an
    empty result.  ``key`` must be kept secret and the same for all tables to be
    linked.
    """
    span = StructType([StructField("start", IntegerType()), StructField("end", IntegerType()),
                       StructField("kind", StringType())])
    kept = [f for f in docs.schema.fields if f.name != found]
    schema = StructType([*kept, StructField(found, ArrayType(span))])
    rows = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            new, spans = [], []
            for x in part.column(text).to_pylist():
                y, s = (None, []) if x is None else pseudonymise(x, key)
                new.append(y)
                spans.append([{"start": a, "end": b, "kind": k} for a, b, k in s])
            columns = [pa.array(new, pa.string()) if f.name == text else part.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, rows)], names=schema.names)
    return docs.mapInArrow(run, schema)
