"""Quality by Bradley-Terry pairwise ranking.

A document's strength is a linear function of what its text looks like.  The model
is learnt from preference pairs (a good text, a bad text): the probability that the
first is preferred is the logistic function of the difference of strengths, so
training is logistic regression on differences of features.  The strengths of the
training texts then give the threshold: the quantile that leaves as large a share
above it as there are good texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweir.llm.words import distinct, raw_bytes, slices, words_of
from docweir.operators import scan
from docweir.session import materialise

#: Texts (expected) of each label in one model's share of the training rows, and least pairs of them.
SHARE = 8000
PAIRS = 40_000
#: Score at the threshold strength.
THRESHOLD = 0.7

_UPPER, _LOWER, _DIGIT, _STOP, _MARK, _SPACE, _LINE, _WIDE = range(8)
_KIND = np.full(256, _WIDE, np.uint8)
_KIND[:128] = _MARK
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[10] = _LINE
_KIND[65:91], _KIND[97:123], _KIND[48:58] = _UPPER, _LOWER, _DIGIT
_KIND[[ord(c) for c in ".,;:'\"-()?"]] = _STOP

SHARES = ("upper", "digit", "stop", "mark", "line", "wide", "no_letter_first", "marked_end", "shouted_end", "repeats_last",
          "repeated_words", "top_word", "repeated_windows", "long_words")
WIDTH = 3 * len(SHARES) + 4


def features(texts: pa.Array) -> np.ndarray:
    """One row of ``WIDTH`` numbers for each whole text; null counts as empty.

    Shares (of bytes, words or windows of five words) enter as they are, as square
    roots and saturated, so that both traces and amounts count; then come the
    logarithm of the number of words, its square, the mean length of a word and
    whether there is a word at all.
    """
    raw, ends = raw_bytes(texts)
    n, kind = len(ends) - 1, _KIND[raw]
    owner = np.repeat(np.arange(n), np.diff(ends))
    of_kind = np.bincount(owner * 8 + kind, minlength=8 * n).reshape(n, 8).astype(float)
    size = np.maximum(np.diff(ends), 1)
    inside = (kind != _SPACE) & (kind != _LINE)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = ends[1:-1][(ends[1:-1] > 0) & (ends[1:-1] < len(raw))]
    first[cut], last[cut - 1] = inside[cut], inside[cut - 1]

    def of_words(where: np.ndarray) -> np.ndarray:
        return np.bincount(owner[where], minlength=n).astype(float)

    starts, stops = np.flatnonzero(first), np.flatnonzero(last)
    words = of_words(starts)
    held = np.maximum(words, 1)
    letters = of_kind[:, _UPPER] + of_kind[:, _LOWER] + of_kind[:, _WIDE]
    found = words_of(texts)
    own = np.repeat(np.arange(n), found.counts())
    again = (found.hashes[1:] == found.hashes[:-1]) & (own[1:] == own[:-1])
    packed = np.sort((own.astype(np.uint64) << np.uint64(44)) | (found.hashes >> np.uint64(20)))
    begin = np.flatnonzero(np.r_[True, packed[1:] != packed[:-1]]) if len(packed) else np.zeros(0, np.int64)
    times = np.diff(begin, append=len(packed))
    whose = (packed[begin] >> np.uint64(44)).astype(np.int64)
    most = np.zeros(n)
    np.maximum.at(most, whose, times)
    windows, at = found.windows(5)
    seen = found.owner(at)
    different = distinct((seen.astype(np.uint64) << np.uint64(44)) | (windows >> np.uint64(20))) >> np.uint64(44)
    n_windows = np.bincount(seen, minlength=n)
    shares = np.stack([
        of_kind[:, _UPPER] / np.maximum(letters, 1), *(of_kind[:, k] / size for k in (_DIGIT, _STOP, _MARK, _LINE)),
        of_kind[:, _WIDE] / np.maximum(letters, 1),
        of_words(starts[~np.isin(kind[starts], (_UPPER, _LOWER, _WIDE))]) / held,
        of_words(stops[kind[stops] == _MARK]) / held,
        of_words(stops[kind[stops] == _UPPER]) / held,
        np.bincount(own[1:][again], minlength=n) / held,
        1 - np.bincount(whose, minlength=n) / held, most / held,
        1 - np.bincount(different.astype(np.int64), minlength=n) / np.maximum(n_windows, 1),
        of_words(starts[(stops - starts) >= 24]) / held], axis=1)
    shares[words == 0, -4] = shares[words == 0, -3] = 0
    shares[n_windows == 0, -2] = 0
    many = np.log1p(words) / 10
    return np.concatenate([shares, np.sqrt(shares), np.minimum(1, 25 * shares),
                           np.stack([many, many * many, (letters / held) / 20, (words > 0).astype(float)], axis=1)], axis=1)


def train(good: np.ndarray, bad: np.ndarray, seed: int = 0, pairs: int = PAIRS, decay: float = 1e-3,
          rounds: int = 25) -> np.ndarray:
    """Weights of the features from ``pairs`` seeded preference pairs of the two tables of features.

    Minimises the mean of ``log(1 + exp(-w . (x_good - x_bad)))`` plus
    ``decay / 2 * |w|^2`` by Newton's method; differences have no bias.
    """
    if not len(good) or not len(bad):
        return np.zeros(good.shape[1])
    rng = np.random.default_rng(seed)
    return _newton(good[rng.integers(len(good), size=pairs)] - bad[rng.integers(len(bad), size=pairs)], decay, rounds)


def train_on_all(good: np.ndarray, bad: np.ndarray, seed: int = 0, pairs: int = PAIRS, decay: float = 1e-3,
                 rounds: int = 25) -> np.ndarray:
    """``train`` on seeded pairs among which every text of both tables is, whatever their number."""
    if not len(good) or not len(bad):
        return np.zeros(good.shape[1])
    rng, pairs = np.random.default_rng(seed), max(pairs, len(good), len(bad))

    def shuffled(n: int) -> np.ndarray:
        return np.concatenate([rng.permutation(n) for _ in range(-(-pairs // n))])[:pairs]
    return _newton(good[shuffled(len(good))] - bad[shuffled(len(bad))], decay, rounds)


def _newton(x: np.ndarray, decay: float, rounds: int) -> np.ndarray:
    """Weights that make the differences ``x`` of preferred and other texts likeliest."""
    pairs, width = x.shape
    w = np.zeros(width)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(x @ w, -30, 30)))
        slope = -(x * p[:, None]).mean(axis=0) + decay * w
        bend = (x * (p * (1 - p))[:, None]).T @ x / pairs + decay * np.eye(width)
        step = np.linalg.solve(bend, slope)
        w -= step * min(1.0, 10 / max(1e-9, float(np.abs(step).max())))
        if float(np.abs(step).max()) < 1e-6:
            break
    return w


class Model:
    """Weights, the strength at the threshold, and how fast scores change around it."""

    def __init__(self, weights: np.ndarray, at: float, spread: float):
        self.weights, self.at, self.spread = weights, at, spread

    def scores(self, table: np.ndarray) -> np.ndarray:
        """Scores in 0 to 1 for rows of features; a text at the threshold strength has ``THRESHOLD``."""
        x = (table @ self.weights - self.at) / self.spread + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, learns: Column, id_col: str = "doc_id", text: str = "text",
        label: str = "quality", share: int = SHARE, seed: int = 0) -> Model:
    """Learn from all labelled rows of ``docs`` for which ``learns`` holds.

    ``learns`` is asked before any label is read.  An id with several labels is good
    only if all of them say so.  The rows are dealt by a hash of their id to as many
    models as give each about ``share`` texts of the commoner label; of the rarer
    one each text goes to as many models as it takes to balance them.  The models learn in
    tasks of their own, from pairs among which all their texts are, and their weights
    are averaged.  The threshold is the exact quantile of the strengths of all
    labelled training rows that leaves the share of good ones above.  Without texts
    of both labels no preference is known: all strengths are equal and every score
    is ``THRESHOLD``.  Rows without an id are not learnt from.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_good")).where(
        "_id IS NOT NULL AND _good IS NOT NULL").groupBy("_id").agg(F.min("_good").alias("_good"))
    rows = docs.where(learns & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))

    def describe(batches):
        for part in slices(batches, "_text"):
            table = features(part.column("_text")).astype(np.float32)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(table.ravel()), WIDTH).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([part.column("_id"), flat], names=["_id", "_x"])

    # Texts stay where they are; what travels to the labels is a few numbers for each, and neither side is sent to all.
    id_type = docs.schema[id_col].dataType.simpleString()
    described = rows.mapInArrow(describe, f"_id {id_type}, _x array<float>")
    marked = materialise(described.join(known.hint("merge"), "_id"), "quality-features")
    n_good, n_known = marked.agg(F.coalesce(F.sum(F.col("_good").cast("long")), F.lit(0)), F.count("*")).first()
    if not 0 < n_good < n_known:
        return Model(np.zeros(WIDTH), 0.0, 1.0)
    models = -(-max(n_good, n_known - n_good) // share)
    times = [min(models, max(1, models * share // n)) for n in (n_known - n_good, n_good)]
    times = [1 if 2 * n > n_known else t for n, t in zip((n_known - n_good, n_good), times)]
    first = F.xxhash64(F.lit(seed + 1), F.col("_id"))
    copies = F.sequence(F.lit(0), F.when(F.col("_good") == 1, times[1] - 1).otherwise(times[0] - 1))
    dealt = marked.select("*", F.explode(F.transform(copies, lambda k: F.pmod(F.pmod(first, F.lit(models)) + k, F.lit(models)).cast("int"))).alias("_model"))

    def learn(table: pa.Table) -> pa.Table:
        number = table.column("_model")[0].as_py()
        order = np.argsort(table.column("_id").to_numpy(), kind="stable")
        x = table.column("_x").combine_chunks().flatten().to_numpy().reshape(-1, WIDTH).astype(float)[order]
        good = table.column("_good").to_numpy()[order] == 1
        w = train_on_all(x[good], x[~good], seed + number)
        return pa.table({"at": np.arange(WIDTH), "w": w, "n": np.full(WIDTH, float(min(good.sum(), (~good).sum())))})

    learnt = dealt.groupBy("_model").applyInArrow(learn, "at long, w double, n double").where("n > 0")
    # Decimals add up to the same sum in any order.
    mean = learnt.groupBy("at").agg(F.sum((F.col("w") * F.col("n")).cast("decimal(38,12)")).cast("double").alias("w"), F.sum("n").alias("n")).toPandas()
    weights = np.zeros(WIDTH)
    weights[mean["at"].to_numpy()] = mean["w"].to_numpy() / mean["n"].to_numpy()

    strength = F.aggregate(F.zip_with("_x", F.array(*map(F.lit, weights.tolist())), lambda x, w: x.cast("double") * w),
                           F.lit(0.0), lambda a, b: a + b)
    # Ranks from 0, so that no strength is interpolated between two texts.
    ranks = [(min(n_known, max(1, int(np.ceil(q * n_known - 1e-9)))) - 1) / max(1, n_known - 1) for q in (1 - n_good / n_known, 0.05, 0.95)]
    found = scan.exact_quantiles(marked.select(F.lit(0).alias("_all"), strength.alias("_s")), ["_all"], "_s", sorted(set(ranks))).collect()
    value = {r["q"]: r["value"] for r in found}
    at = [value[q] for q in ranks]
    return Model(weights, float(at[0]), max(1e-6, float(at[2] - at[1]) / 6))


def score(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with the quality (0 to 1) of each whole text; null counts as empty.

    Only the text enters.  All rows and columns are kept (``column`` replaces one of
    that name); equal texts score alike; texts of any length are described whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def quality(texts: pa.Array) -> pa.Array:
        out = [shared.value.scores(features(part.column("t"))) for part in slices(iter([pa.record_batch([texts], ["t"])]), "t")]
        return pa.array(np.concatenate(out) if out else np.zeros(0))
    return docs.withColumn(column, quality(F.col(text)))


def learnt_rows(id_col: str = "doc_id") -> Column:
    """Rows whose labels may be learnt: CRC-32 of the id as text, modulo 4, is not 2; rows without an id are not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 != 2, F.lit(False))
