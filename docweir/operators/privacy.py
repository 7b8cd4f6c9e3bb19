"""Redaction and personal-data reports."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from docweir.functions.patterns import REDACTIONS
from docweir.session import materialise

# Keys whose values are personal data wherever they appear.
SENSITIVE_KEYS = [
    "pinfl", "jshshir", "doc_number", "document_number", "passport", "surname",
    "given_name", "patronymic", "birth_date", "birth_place", "address", "phone",
    "email", "value", "secret", "api_key", "token", "password", "authorization",
]
REDACTED, TRUNCATED, MAX_DEPTH = "<REDACTED>", "<TRUNCATED>", 8


def redact_text(c: Column) -> Column:
    """Replace personal data, the most specific pattern first."""
    out = c
    for pattern, label in REDACTIONS:
        out = F.regexp_replace(out, pattern, label)
    return out


def redaction_hits(c: Column) -> Column:
    """array<struct<label,hits>>: matches per pattern, each on what earlier ones left."""
    out, left = [], c
    for n, (pattern, label) in enumerate(REDACTIONS):
        out.append(F.struct(F.lit(f"{n}{label}").alias("label"),
                            F.size(F.regexp_extract_all(left, F.lit(pattern), F.lit(0))).alias("hits")))
        left = F.regexp_replace(left, pattern, label)
    return F.array(*out)


def redaction_report(df: DataFrame, text: str, *by: str) -> DataFrame:
    """Hits per pattern and group; counting happens before the shuffle."""
    # One projection a pattern: a text used twice is not worked out again from the first.
    left, counts = df.select(*by, F.col(text).alias("_left")), []
    for n, (pattern, label) in enumerate(REDACTIONS):
        left = left.select(*by, *counts, F.size(F.regexp_extract_all("_left", F.lit(pattern), F.lit(0))).alias(f"_n{n}"),
                           F.regexp_replace("_left", pattern, label).alias("_left"))
        counts.append(f"_n{n}")
    hits = left.select(*by, F.inline(F.array(*[F.struct(
        F.lit(f"{n}{label}").alias("label"), F.col(f"_n{n}").alias("hits")) for n, (_, label) in enumerate(REDACTIONS)])))
    return hits.groupBy(*by, "label").agg(F.sum("hits").alias("hits"),
                                          F.count_if(F.col("hits") > 0).alias("rows_hit"))


def redact_map(m: Column) -> Column:
    """Redact a map<string,string>: sensitive keys entirely, other values by text."""
    keys = F.array(*[F.lit(k) for k in SENSITIVE_KEYS])
    return F.transform_values(m, lambda k, v: F.when(
        F.array_contains(keys, F.lower(k)) & v.isNotNull(), F.lit(REDACTED)).otherwise(redact_text(v)))


#: Kinds of values that a sensitive key hides: how a variant's schema and how JSON text show them.
HIDDEN_KINDS = {
    "string": ("STRING", r'"(?:[^"\\]|\\.)*(?:"|\Z)'),
    "whole": (r"BIGINT|DECIMAL\(\d+,0\)", r"-?\d+(?![\w.+-])"),
    "flag": ("BOOLEAN", r"(?:true|false)(?!\w)"),
}
_HIDDEN_SCHEMA = "^(?:" + "|".join(schema for schema, _ in HIDDEN_KINDS.values()) + ")$"
_TOKEN = re.compile("|".join(f"(?P<{name}>{shape})" for name, (_, shape) in HIDDEN_KINDS.items())
                    + r"|(?P<literal>(?:null|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)(?!\w))|(?P<open>[{\[])|(?P<shut>[}\]])|(?P<mark>[,:])|(?P<space>\s+)"
                    r"|(?P<bare>(?:[^\s{}\[\],:\"]|\s+(?=[^\s{}\[\],:\"]))+|\")", re.S)


def _quoted(text: Column) -> Column:
    """A string as JSON text."""
    listed = F.to_json(F.array(text))
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


def _redacted(node: Column, depth: int) -> Column:
    """JSON text of a redacted variant; objects and lists share one expression per level."""
    if depth > MAX_DEPTH:
        return F.lit(f'"{TRUNCATED}"')
    kind = F.schema_of_variant(node)
    is_object, is_list = kind.startswith("OBJECT"), kind.startswith("ARRAY")
    member = "array<struct<key:string,value:variant>>"
    members = F.when(is_object, F.map_entries(node.try_cast("map<string,variant>")).cast(member)).otherwise(
        F.transform(node.try_cast("array<variant>"), lambda x: F.struct(
            F.lit(None).cast("string").alias("key"), x.alias("value"))))
    names = F.array(*[F.lit(k) for k in SENSITIVE_KEYS])

    def shown(m: Column) -> Column:
        private = F.array_contains(names, F.lower(m["key"])) & F.schema_of_variant(m["value"]).rlike(_HIDDEN_SCHEMA)
        value = F.when(F.coalesce(private, F.lit(False)), F.lit(f'"{REDACTED}"')).otherwise(_redacted(m["value"], depth + 1))
        return F.concat(F.when(m["key"].isNotNull(), F.concat(_quoted(m["key"]), F.lit(": "))).otherwise(""), value)

    inner = F.array_join(F.transform(members, shown), ", ")
    return (F.when(is_object | is_list, F.concat(F.when(is_object, "{").otherwise("["), inner,
                                                 F.when(is_object, "}").otherwise("]")))
            .when(kind == "STRING", _quoted(redact_text(node.try_cast("string"))))
            .otherwise(F.to_json(node)))


def _decoded(token: str) -> str:
    try:
        return json.loads(token, strict=False)
    except ValueError:    # a broken escape or a missing end
        return token[1:].removesuffix('"')


def _pieces(body: str | None) -> list[dict] | None:
    """Text that begins as a JSON object or array, token by token: ``plain`` stands, ``text`` and ``bare`` are still to be redacted by content.

    Tokens are judged as they come, so text that breaks JSON's rules (a comma too
    many, an end that is missing) still loses what stands under sensitive keys.
    """
    if body is None:
        return None
    out: list[dict] = []
    keys: list[str | None] = []     # the key in force in each open container; None in a list or before a key
    names: list[bool] = []          # whether the next string of each open container is a key
    beyond = 0                      # containers open inside a part that is cut off

    def tell(kind: str, token: str) -> None:
        out.append({"plain": None, "text": None, "bare": None} | {kind: token})

    for match in _TOKEN.finditer(body):
        kind, token = match.lastgroup, match.group()
        if beyond:
            beyond += (kind == "open") - (kind == "shut")
        elif kind == "mark":
            if names and token == ",":
                names[-1], keys[-1] = keys[-1] is not None or names[-1], None
            elif names:
                names[-1] = False
            tell("plain", f"{token} ")
        elif kind == "shut":
            if names:
                names.pop()
                keys.pop()
            tell("plain", token)
        elif kind in ("string", "bare") and names and names[-1]:
            keys[-1] = _decoded(token) if kind == "string" else token.strip(" '")
            tell("plain", json.dumps(keys[-1], ensure_ascii=False))
        elif (kind in HIDDEN_KINDS or kind == "bare") and keys and (keys[-1] or "").lower() in SENSITIVE_KEYS:
            tell("plain", f'"{REDACTED}"')
        elif kind != "space" and len(names) > MAX_DEPTH:
            tell("plain", f'"{TRUNCATED}"')
            beyond = int(kind == "open")
        elif kind == "open":
            names.append(token == "{")
            keys.append(None)
            tell("plain", token)
        elif kind == "string":
            tell("text", _decoded(token))
        elif kind != "space":
            tell("bare" if kind == "bare" else "plain", token)
    return out


def _json_pieces(bodies: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([(name, pa.string()) for name in ("plain", "text", "bare")]))
    return pa.array([_pieces(x.as_py()) for x in bodies], kind)


def redact_json(c: Column) -> Column:
    """Redact nested JSON text, by key name and by content.

    Scalars under a sensitive key become ``<REDACTED>``; anything below eight
    levels becomes ``<TRUNCATED>``, so one expression per level is all it takes.
    Keys come out in the order a variant keeps them (sorted).  What begins as an object
    or array but is no variant (repeated keys, too large, not quite JSON) is read
    token by token in Python, for those rows only, and keeps its order.  Other text
    that is not JSON is redacted as text.
    """
    node = F.try_parse_json(c)
    cut = F.arrow_udf(_json_pieces, "array<struct<plain:string,text:string,bare:string>>")
    pieces = cut(F.when(node.isNull() & c.rlike(r"\A\s*[\[{]"), c))
    parsed = F.array_join(F.transform(pieces, lambda x: F.coalesce(
        x["plain"], F.when(x["text"].isNotNull(), _quoted(redact_text(x["text"]))), redact_text(x["bare"]))), "")
    return F.when(node.isNull(), F.coalesce(parsed, redact_text(c))).otherwise(_redacted(node, 0))


#: Characters by which a secret is found, and the fewest it has.
SEED = 7
#: Secrets that may be sent to every executor (some megabytes), and words of the filter that stands for more of them (2 MB).
SMALL_SECRETS = 100_000
FILTER_WORDS = 1 << 18


def _seeds(text: str) -> np.ndarray:
    """A fingerprint for every ``SEED`` characters of a text, in order."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    h = np.zeros(max(0, len(codes) - SEED + 1), np.uint64)
    for k in range(SEED):
        h = h * np.uint64(1099511628211) + codes[k:k + len(h)]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _places(texts: list[str | None], found) -> Iterator[tuple[int, int, int]]:
    """(row, place, fingerprint) where ``found`` says that a secret may begin; what runs over a text's end is for the caller to notice."""
    plain = [t or "" for t in texts]
    begins = np.cumsum([0, *(len(t) for t in plain)])
    marks = _seeds("".join(plain))
    at = np.flatnonzero(found(marks))
    for p, row in zip(at.tolist(), (np.searchsorted(begins, at, side="right") - 1).tolist()):
        yield row, p - int(begins[row]), int(marks[p].view(np.int64))


def _labelled(text: str, hits: list[tuple[int, int, str]]) -> str:
    """A text with its hits (place, length, key) replaced by labels: longer secrets first, each from left to right."""
    taken: list[tuple[int, int, str]] = []
    free = np.ones(len(text), bool)
    for at, size, key in sorted(hits, key=lambda h: (-h[1], h[2], h[0])):
        if free[at:at + size].all():
            free[at:at + size] = False
            taken.append((at, size, key))
    out, done = [], 0
    for at, size, key in sorted(taken):
        out += [text[done:at], f"<redacted:{key}>"]
        done = at + size
    return "".join([*out, text[done:]])


def redact_secrets(df: DataFrame, text: str, secrets: dict[str, str] | DataFrame) -> DataFrame:
    """Replace known key material (over six characters) by its label ``<redacted:key_id>``.

    ``secrets`` maps key ids to secrets, or is a table (key_id, secret) of any size.
    The result is that of replacing one secret after the other, longer ones first
    (of equal ones the smaller key id), where labels are not searched again.  Null
    texts stay null; null and short secrets count for nothing.

    Texts are searched for the first seven characters of all secrets at once, so
    the plan does not depend on their number.  Up to ``SMALL_SECRETS`` (counted) go
    to every executor and nothing is shuffled; beyond that a filter of fixed size
    picks places that may begin a secret, and only those meet the table.
    """
    if isinstance(secrets, dict):
        known = [(k, v) for k, v in secrets.items() if v and len(v) >= SEED]
    else:
        usable = secrets.where(F.length("secret") >= SEED).groupBy("secret").agg(F.min(F.col("key_id").cast("string")).alias("key_id"))
        usable = materialise(usable, "secrets")
        if usable.count() > SMALL_SECRETS:
            return _redact_from_table(df, text, usable)
        known = [(r["key_id"], r["secret"]) for r in usable.collect()]
    by_seed: dict[str, list[tuple[str, str]]] = {}
    for key, secret in known:
        by_seed.setdefault(secret[:SEED], []).append((secret, key))
    marks = np.sort(np.array([_seeds(s)[0] for s in by_seed], np.uint64))
    shared = df.sparkSession.sparkContext.broadcast((by_seed, marks))

    def found(own: np.ndarray) -> np.ndarray:
        held = shared.value[1]
        return held[np.minimum(np.searchsorted(held, own), len(held) - 1)] == own if len(held) else np.zeros(len(own), bool)

    @F.arrow_udf("string")
    def redacted(column: pa.Array) -> pa.Array:
        texts, hits = column.to_pylist(), {}
        for row, at, _ in _places(texts, found):
            own = texts[row]
            for secret, key in shared.value[0].get(own[at:at + SEED], ()):
                if own.startswith(secret, at):
                    hits.setdefault(row, []).append((at, len(secret), key))
        for row, own in hits.items():
            texts[row] = _labelled(texts[row], own)
        return pa.array(texts, pa.string())
    return df.withColumn(text, redacted(F.col(text)))


def _redact_from_table(df: DataFrame, text: str, secrets: DataFrame) -> DataFrame:
    """The same with secrets that meet their places in a join; ``secrets`` are unique."""
    spark = df.sparkSession
    rows = materialise(df.withColumn("_row", F.monotonically_increasing_id()), "texts-with-secrets")
    seed = F.arrow_udf(lambda c: pa.array([int(_seeds(s)[0].view(np.int64)) for s in c.to_pylist()], pa.int64()), "long")
    marked = materialise(secrets.withColumn("mark", seed(F.substring("secret", 1, SEED))), "secret-marks")
    longest = marked.agg(F.max(F.length("secret"))).first()[0]
    word = F.col("mark").bitwiseAND(FILTER_WORDS - 1)
    bit = F.expr("shiftleft(1L, CAST(shiftrightunsigned(mark, 40) & 63 AS INT))")
    words = marked.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toPandas()
    filled = np.zeros(FILTER_WORDS, np.uint64)
    filled[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast(filled)

    def found(own: np.ndarray) -> np.ndarray:
        bits = shared.value[(own & np.uint64(FILTER_WORDS - 1)).astype(np.int64)]
        return ((bits >> ((own >> np.uint64(40)) & np.uint64(63))) & np.uint64(1)) == 1

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("_row").to_pylist(), batch.column(text).to_pylist()
            got = [(ids[r], at, mark, texts[r][at:at + longest]) for r, at, mark in _places(texts, found) if at + SEED <= len(texts[r])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*got) if got else ([],) * 4, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["_row", "at", "mark", "tail"])

    met = rows.select("_row", text).mapInArrow(places, "_row long, at long, mark long, tail string").join(marked, "mark")
    hits = met.where(F.startswith("tail", "secret")).groupBy("_row").agg(
        F.collect_list(F.struct("at", F.length("secret").alias("size"), "key_id")).alias("_hits"))

    @F.arrow_udf("string")
    def redacted(column: pa.Array, own: pa.Array) -> pa.Array:
        return pa.array([t if not h else _labelled(t, [(x["at"], x["size"], x["key_id"]) for x in h])
                         for t, h in zip(column.to_pylist(), own.to_pylist())], pa.string())
    joined = rows.join(hits, "_row", "left")
    return joined.withColumn(text, F.when(F.col("_hits").isNull(), F.col(text)).otherwise(redacted(F.col(text), F.col("_hits")))).select(*df.columns)


def find_unreserved_ids(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """14-digit runs outside the reserved synthetic range, one row each."""
    runs = df.select(*keys, F.explode(F.regexp_extract_all(
        F.col(text), F.lit(r"(?U)\b\d{14}\b"), F.lit(0))).alias("run"))
    return runs.filter(~(F.col("run").rlike("^[35]") & F.col("run").endswith("12345")))
