"""Language identification by hyperdimensional profiles.

Every letter owns a random vector of -1 and 1 drawn from its code point.  An n-gram
is its letters' vectors, each permuted by its place (a cyclic shift) and bound by
multiplication; a text is the bundle (sum) of its n-grams.  A language's prototype
is the bundle of the unit vectors of its texts, and a text belongs to the prototype
with the largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweir.llm.words import mix, slices

DIMENSIONS = 1024
GRAM = 3
#: Most texts (expected) that the prototypes are bundled from.
TRAINING_TEXTS = 50_000
#: Where a text is null or has no letter.
UNKNOWN = "und"
_BREAK = 0x110000    # stands for everything between two words
_TEXTS = 128         # texts that are bundled at once


def letter_vectors(points: np.ndarray, dimensions: int) -> np.ndarray:
    """The vectors of code points, one in each row, as int8 -1 and 1."""
    lanes = -(-dimensions // 64)
    seeds = mix(points.astype(np.uint64) * np.uint64(0x100000001B3))[:, None] + np.arange(lanes, dtype=np.uint64)[None, :]
    bits = np.unpackbits(mix(seeds.ravel()).view(np.uint8)).reshape(len(points), -1)[:, :dimensions]
    return (bits.astype(np.int8) << 1) - 1


def _letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts with one break between words; the number of each one's text; how many letters a text has."""
    words = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}]+", " ")
    padded = pc.binary_join_element_wise("", words, "", " ")    # a space before and after each text
    points = np.frombuffer("".join(padded.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    sizes = pc.utf8_length(padded).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(texts)), sizes)
    points[points == 32] = _BREAK
    double = np.zeros(len(points), bool)
    double[1:] = (points[1:] == _BREAK) & (points[:-1] == _BREAK) & (owner[1:] == owner[:-1])
    points, owner = points[~double], owner[~double]
    return points, owner, np.bincount(owner[points != _BREAK], minlength=len(texts))


def bundles(texts: pa.Array, dimensions: int = DIMENSIONS, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """One vector for each text, as float32, and how many letters the text has."""
    points, owner, letters = _letters(texts)
    alphabet, code = np.unique(points, return_inverse=True)
    place = len(points) - gram + 1
    out = np.zeros((len(texts), dimensions), np.float32)
    if place <= 0:
        return out, letters
    grams = np.zeros(place, np.int64)
    for j in range(gram):
        grams = grams * len(alphabet) + code[j:place + j]
    whole = owner[:place] == owner[gram - 1:]
    kinds, kind = np.unique(grams[whole], return_inverse=True)
    base, vectors, rest = letter_vectors(alphabet, dimensions), np.ones((len(kinds), dimensions), np.int8), kinds.copy()
    for j in range(gram):    # the last letter is not shifted, the one before by one place, and so on
        vectors *= np.roll(base, j, axis=1)[rest % len(alphabet)]
        rest //= len(alphabet)
    vectors = vectors.astype(np.float32)
    owner = owner[:place][whole]
    for at in range(0, len(texts), _TEXTS):
        a, b = np.searchsorted(owner, [at, at + _TEXTS])
        used, number = np.unique(kind[a:b], return_inverse=True)
        n = min(_TEXTS, len(texts) - at)
        times = np.bincount((owner[a:b] - at) * len(used) + number, minlength=n * len(used)).reshape(n, len(used))
        out[at:at + n] = times.astype(np.float32) @ vectors[used]
    return out, letters


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1))
    return rows / np.where(length > 0, length, 1)[:, None]


def fit(docs: DataFrame, learns: Column, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS,
        sample: int = TRAINING_TEXTS, id_col: str = "doc_id") -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and their unit prototypes, from the rows for which ``learns`` holds.

    Rows with a null language, or a text without letters, teach nothing.  At most
    ``sample`` texts (expected; chosen by a hash of the id) are bundled.  Each
    batch of rows sends one vector for each of its languages.
    """
    taught = docs.where(learns & F.col(lang).isNotNull())
    n = taught.count()
    place = F.pmod(F.xxhash64(F.lit(11), F.col(id_col)), F.lit(1 << 30))
    taught = taught.where(place < int(min(1.0, sample / max(1, n)) * (1 << 30)))

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            vectors, letters = bundles(part.column("text"), dimensions)
            names, number = np.unique(np.array(part.column("lang").to_pylist(), object), return_inverse=True)
            unit = _unit(vectors)
            sums = np.zeros((len(names), dimensions))
            np.add.at(sums, number, unit * (letters > 0)[:, None])
            yield pa.RecordBatch.from_pydict({"lang": pa.array(names.tolist(), pa.string()),
                                              "v": pa.array(list(sums), pa.list_(pa.float64()))})

    parts = taught.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).mapInArrow(
        bundle, "lang string, v array<double>")
    spread = parts.select("lang", F.posexplode("v").alias("place", "x")).groupBy("lang", "place").agg(F.sum("x").alias("x"))
    model = spread.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "x"))).alias("v")).select(
        "lang", F.col("v.x").alias("v")).orderBy("lang").collect()    # one row for each language
    names = [r["lang"] for r in model if any(r["v"])]
    return names, _unit(np.array([r["v"] for r in model if any(r["v"])]).reshape(len(names), dimensions))


def identify(docs: DataFrame, names: list[str], prototypes: np.ndarray, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the cosine with that language's prototype (at least 0).

    Only the text enters.  A text that is null or has no letter, and every text
    where nothing was learnt, is ``und`` with score 0.  Of languages with equal
    cosines the first by name wins.  All rows and columns are kept (the two replace
    columns of their names).  An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast((names, prototypes))

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def nearest(texts: pa.Array) -> pa.Array:
        own, basis = shared.value
        found, scores = [], []
        for part in slices(iter([pa.record_batch([texts], ["t"])]), "t"):
            vectors, letters = bundles(part.column("t"), basis.shape[1])
            if not own:
                found += [UNKNOWN] * part.num_rows
                scores += [0.0] * part.num_rows
                continue
            cosine = _unit(vectors) @ basis.T
            best = cosine.argmax(axis=1)
            found += [own[i] if n else UNKNOWN for i, n in zip(best, letters)]
            scores += np.where(letters > 0, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0).tolist()
        return pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(scores, pa.float64())],
                                          ["lang_pred", "score"])
    return (docs.withColumn("__found", nearest(F.col(text)))
            .withColumns({"lang_pred": F.col("__found.lang_pred"), "score": F.col("__found.score")}).drop("__found"))
