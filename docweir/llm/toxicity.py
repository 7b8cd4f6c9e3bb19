"""Toxicity by non-negative positive-unlabelled learning.

The only labels that training sees are confirmed toxic texts; all other training
texts are unlabelled.  The risk of calling a clean text toxic is estimated as the
unlabelled risk less the part that the class prior says is due to toxic texts, and
is not allowed to fall below zero.  Several linear classifiers are trained with
numpy, each in a task of its own on its own bounded sample; their weights are
averaged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweir.llm.words import distinct, slices, words_of
from docweir.session import materialise

#: Hashed words that a text can hold.
FEATURES = 1 << 18
#: Most texts (expected) of each kind in one classifier's sample, and the classifiers.
SAMPLE = 6000
CLASSIFIERS = 3


#: Beside whole words, so many first bytes of them are features, for languages that build words on stems.
_HEADS = (None, 4, 5, 6, 7, 8)


def _present(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed words and word beginnings of each text: text numbers and features, sorted.

    Letters A-Z fold to a-z; ASCII punctuation counts as white space.
    """
    plain = pc.replace_substring_regex(pc.fill_null(texts, ""), r"[!-/:-@\[-`{-~]+", " ")
    found = []
    for head in _HEADS:
        words = words_of(plain, lower=True, head=head)
        owner = np.repeat(np.arange(len(texts)), words.counts())
        found.append(owner * FEATURES + (words.hashes % np.uint64(FEATURES)).astype(np.int64))
    both = distinct(np.concatenate(found))
    return both // FEATURES, both % FEATURES


def _sums(weight: np.ndarray, owner: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, weight[feature], n)


def train(texts: pa.Array, positive: np.ndarray, prior: float, epochs: int = 200, rate: float = 0.3,
          decay: float = 1e-3, least_z: float = 5.0) -> tuple[np.ndarray, np.ndarray, float]:
    """One linear classifier: features, their weights, and the bias.

    Minimises ``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))`` with the logistic
    loss; where the second part is negative its gradient is turned round, which
    keeps the classifier from explaining single texts.  Only features whose share
    among the toxic texts differs from that among the unlabelled by ``least_z``
    standard errors are used.
    """
    n, p = len(texts), positive.astype(bool)
    n_p, n_u = max(1, int(p.sum())), max(1, int((~p).sum()))

    def parts():
        """Texts and features of a slice of the sample at a time: all of them at once would fill a worker."""
        begin = 0
        for part in slices(iter([pa.record_batch([texts], ["t"])]), "t"):
            owner, feature = _present(part.column("t"))
            yield owner + begin, feature
            begin += part.num_rows

    in_p, in_u = np.zeros(FEATURES), np.zeros(FEATURES)
    for owner, feature in parts():
        in_p += np.bincount(feature[p[owner]], minlength=FEATURES)
        in_u += np.bincount(feature[~p[owner]], minlength=FEATURES)
    error = np.sqrt((in_p + in_u + 1) / max(1, n) * (1 / n_p + 1 / n_u))
    kept = np.flatnonzero(np.abs(in_p / n_p - in_u / n_u) >= least_z * error)
    number = np.full(FEATURES, -1)
    number[kept] = np.arange(len(kept))
    pairs = [(owner[number[feature] >= 0], number[feature[number[feature] >= 0]]) for owner, feature in parts()]
    owner = np.concatenate([x for x, _ in pairs] or [np.zeros(0, np.int64)])
    feature = np.concatenate([x for _, x in pairs] or [np.zeros(0, np.int64)])
    width = max(1, len(kept))
    w, b = np.zeros(width), float(np.log(prior / (1 - prior)))
    w_seen, b_seen = np.full(width, 1e-6), 1e-6
    for _ in range(epochs):
        score = _sums(w, owner, feature, n) + b
        toxic = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        loss_minus = np.logaddexp(0, score)
        clean_risk = loss_minus[~p].sum() / n_u - prior * loss_minus[p].sum() / n_p
        pull = np.where(p, prior * (toxic - 1) / n_p, 0.0)
        clean = np.where(p, -prior * toxic / n_p, toxic / n_u)
        slope = pull + clean if clean_risk >= 0 else -clean
        g = np.bincount(feature, slope[owner], width) + decay * w
        g_b = slope.sum()
        w_seen += g * g
        b_seen += g_b * g_b
        w -= rate * g / np.sqrt(w_seen)
        b -= rate * g_b / np.sqrt(b_seen)
    return kept, w[:len(kept)], b


def fit(docs: DataFrame, labels: DataFrame, learns: Column, id_col: str = "doc_id", text: str = "text",
        label: str = "toxic", sample: int = SAMPLE, classifiers: int = CLASSIFIERS, seed: int = 0) -> np.ndarray:
    """Train on the rows of ``docs`` for which ``learns`` holds; the weights of all features, and the bias last.

    ``learns`` is asked before any label is read.  An id with several labels counts
    as toxic if one of them says so.  The class prior is the share of toxic among
    the labelled training rows.  Without a toxic row the classifier knows nothing
    and only holds the prior (0.01).  ``sample`` bounds, in expectation, the toxic
    and the unlabelled texts of one classifier.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_toxic")).where(
        "_id IS NOT NULL AND _toxic IS NOT NULL").groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    narrow = docs.where(learns).select(F.col(id_col).alias("_id"))
    known = materialise(known.join(narrow, "_id", "left_semi"), "toxicity-labels")
    n_toxic, n_known = known.agg(F.coalesce(F.sum("_toxic"), F.lit(0)), F.count("*")).first()
    weights = np.zeros(FEATURES + 1)
    prior = min(0.5, max(0.01, n_toxic / max(1, n_known)))
    weights[-1] = np.log(prior / (1 - prior))
    if not n_toxic:
        return weights
    n_all = narrow.count()

    place = F.pmod(F.xxhash64(F.lit(seed), F.col("_id")), F.lit(1 << 30))
    room = sample * classifiers
    toxic = known.where("_toxic = 1").where(place < int(min(1.0, room / n_toxic) * (1 << 30))).select("_id")
    texts = docs.where(learns).select(F.col(id_col).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    # The ids of the sample are few (its size is bounded), the texts stay where they are.
    confirmed = texts.join(F.broadcast(toxic), "_id").withColumn("_p", F.lit(True))
    other = texts.where(F.pmod(F.xxhash64(F.lit(seed + 1), F.col("_id")), F.lit(1 << 30))
                        < int(min(1.0, 2 * room / max(1, n_all)) * (1 << 30))).withColumn("_p", F.lit(False))
    groups = confirmed.unionByName(other).withColumn(
        "_group", F.pmod(F.xxhash64(F.lit(seed + 2), F.col("_id")), F.lit(classifiers)).cast("int"))

    def learn(frame: pa.Table) -> pa.Table:
        texts_, p = frame.column("_text").combine_chunks(), frame.column("_p").to_numpy().astype(bool)
        order = np.lexsort((p, frame.column("_id").to_numpy()))
        kept, w, b = train(texts_.take(pa.array(order)), p[order], prior)
        return pa.table({"feature": np.r_[kept, FEATURES], "weight": np.r_[w, b]})

    learnt = groups.groupBy("_group").applyInArrow(learn, "feature long, weight double")
    mean = learnt.groupBy("feature").agg((F.sum("weight") / classifiers).alias("weight")).toPandas()
    weights[-1] = 0.0
    weights[mean["feature"].to_numpy()] = mean["weight"].to_numpy()
    return weights


def score(docs: DataFrame, weights: np.ndarray, text: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with the probability that each whole text is toxic; null counts as empty.

    Only the text enters.  All rows and columns are kept (``column`` replaces one of
    that name); equal texts score alike; an empty text scores by the bias.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.arrow_udf("double")
    def toxic(texts: pa.Array) -> pa.Array:
        w = shared.value
        out = []
        for part in slices(iter([pa.record_batch([texts], ["t"])]), "t"):
            owner, feature = _present(part.column("t"))
            out.append(1 / (1 + np.exp(-np.clip(_sums(w, owner, feature, part.num_rows) + w[-1], -30, 30))))
        return pa.array(np.concatenate(out) if out else np.zeros(0))
    return docs.withColumn(column, toxic(F.col(text)))


def confirmed_rows(id_col: str = "doc_id") -> Column:
    """Rows whose labels may be learnt: CRC-32 of the id as text, modulo 4, is not 2; rows without an id are not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 != 2, F.lit(False))
