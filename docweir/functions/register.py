"""Exposes the Column functions to SQL as temporary functions.

Each function becomes a SQL function with the same expression, so a query text
is planned exactly like the DataFrame form; nothing runs in Python.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession, functions as F

from docweir.functions import checkdigit as c, formatting as f, text as t

# Name -> (Column function of ``value``, SQL return type).
FUNCTIONS: dict[str, tuple[Callable[[Column], Column], str]] = {
    **{name: (fn, "STRING") for name, fn in f.FILTERS.items()},
    "as_date": (f.as_date, "DATE"),
    "default_blank": (f.default_blank, "STRING"),
    "normalize_apostrophes": (t.normalize_apostrophes, "STRING"),
    "latin_to_cyrillic": (t.latin_to_cyrillic, "STRING"),
    "cyrillic_to_latin": (t.cyrillic_to_latin, "STRING"),
    "mrz_to_display": (t.mrz_to_display, "STRING"),
    "title_case_name": (t.title_case_name, "STRING"),
    "normalize_input": (t.normalize_input, "STRING"),
    "norm_for_compare": (t.norm_for_compare, "STRING"),
    "digits_only": (t.digits, "STRING"),
    "rule_norm": (t.rule_norm, "STRING"),
    "extract_json": (t.extract_json, "STRING"),
    "stage_label": (t.stage_label, "STRING"),
    "char_value": (c.char_value, "INT"),
    "check_digit": (c.check_digit, "INT"),
    "decode_pinfl": (c.decode_pinfl, "STRUCT<structure_valid: BOOLEAN, checksum_verified: BOOLEAN, birth_date: DATE, "
                                     "sex: STRING, region_code: STRING, errors: ARRAY<STRING>>"),
}

_PARTS = re.compile(r"'(?:[^'\\]|\\.)*'|[(),]|[^'(),]+", re.S)


def _arrows(sql: str) -> str:
    """Spell lambdas as ``(x, y) -> body``: Spark prints them as a function call."""
    out: list[list[str]] = [[""]]
    heads: list[str] = []
    for part in _PARTS.findall(sql):
        if part == "(":
            name = re.search(r"(lambdafunction)?$", out[-1][-1]).group(0)
            if name:
                out[-1][-1] = out[-1][-1][:-len(name)]
            heads.append(name)
            out.append([""])
        elif part == ")":
            args, name = out.pop(), heads.pop()
            if name:
                # A printed lambda lists its body first and its variables last.
                names = [a.strip() for a in args[1:]]
                head = names[0] if len(names) == 1 else f"({', '.join(names)})"
                text = f"{head} -> {args[0]}"
            else:
                text = f"({','.join(args)})"
            out[-1][-1] += text
        elif part == "," and heads:
            out[-1].append("")
        else:
            out[-1][-1] += part
    return out[0][0]


def register_functions(spark: SparkSession, prefix: str = "") -> list[str]:
    """Create the temporary SQL functions; returns their names."""
    names = []
    for name, (fn, returns) in FUNCTIONS.items():
        body = _arrows(spark._jsparkSession.expression(fn(F.col("value"))._jc).sql())
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}(value STRING) RETURNS {returns} RETURN {body}")
        names.append(prefix + name)
    return names
