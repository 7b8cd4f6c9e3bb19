"""N-gram Jaccard join by multiple-global-order filtering.

A text's set holds the 53-bit fingerprints of its distinct shingles.  Two sets
whose Jaccard similarity reaches the threshold share a token among the first few
of both under *every* order of all tokens.  Several orders are used at once; each
puts tokens that many texts hold last (a sketch of bounded size tells which) and
breaks ties by a hash of its own.  Only pairs that survive the intersection of all
these filters are verified on whole sets.

Groups of near copies are never expanded into pairs.  Texts that share minimum
tokens with the most typical text of their bucket are verified against that one
text and, if linked, stand behind it as a ball.  The filters then run between
balls.  As Jaccard distance is a metric, one verification of two centres settles
most pairs of balls; what it leaves open is settled by comparing the members of
the two balls in tiles, which report links and not pairs.  Tiles also settle
families: single texts near a typical one that are not linked to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweir.llm.filters import KeyFilter, filter_of
from docweir.llm.words import distinct, keys, mix, slices, words_of
from docweir.session import materialise

WORDS = 5
THRESHOLD = 80          # per cent
ORDERS = 3
GUIDES = 5              # minimum tokens by which typical texts are found
SKETCH_BITS = 22        # the sketch has 2**22 counters, whatever the corpus
TILE = 512              # texts on each side of a tile
FAMILY = 0.5            # distance up to which a text is of a typical text's family
_ROWS = 1024            # texts in a slice: their numbers fit the 11 bits above a token
_SEEDS = keys(21, ORDERS + GUIDES + 8)
_ALMOST = 1e-9


class Sets:
    """Token sets of several texts: ``tokens[bounds[i]:bounds[i + 1]]``, sorted."""

    def __init__(self, tokens: np.ndarray, bounds: np.ndarray):
        self.tokens, self.bounds = tokens, bounds
        self.sizes = np.diff(bounds)
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)

    def of(self, i: int) -> np.ndarray:
        return self.tokens[self.bounds[i]:self.bounds[i + 1]]

    def signatures(self) -> np.ndarray:
        """One 64-bit fingerprint for each set; 0 only for empty ones."""
        total = np.zeros(len(self.sizes), np.uint64)
        np.add.at(total, self.owner, mix(self.tokens ^ _SEEDS[-1]))
        return np.where(self.sizes > 0, mix(total + self.sizes.astype(np.uint64)) | np.uint64(1), 0).view(np.int64)


def sets_of(texts: pa.Array, words: int = WORDS) -> Sets:
    """Shingle sets of at most ``_ROWS`` texts; with fewer words, a text's whole sequence is its one shingle."""
    found = words_of(texts, lower=True)
    tokens, at = found.windows(words)
    owner = found.owner(at)
    few = np.flatnonzero((found.counts() > 0) & (found.counts() < words))
    if len(few):
        own = [found.hashes[found.bounds[i]:found.bounds[i + 1]] for i in few]
        whole = np.array([(h * _SEEDS[:len(h)]).sum(dtype=np.uint64) + np.uint64(len(h)) for h in own], np.uint64)
        tokens, owner = np.concatenate([tokens, mix(whole)]), np.concatenate([owner, few])
    packed = distinct((owner.astype(np.uint64) << np.uint64(53)) | (tokens >> np.uint64(11)))
    owner = (packed >> np.uint64(53)).astype(np.int64)
    return Sets(packed & np.uint64((1 << 53) - 1), np.searchsorted(owner, np.arange(len(texts) + 1)))


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.RecordBatch, Sets]]:
    for part in slices(batches, "text", rows=_ROWS):
        yield part, sets_of(part.column("text"), words)


def _sketch(docs: DataFrame, words: int) -> Broadcast:
    """How common the tokens of each bucket are: 0, or the log of their excess over the mean."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for _, sets in _sets(batches, words):
            total += np.bincount((sets.tokens >> np.uint64(53 - SKETCH_BITS)).astype(np.int64), minlength=len(total))
        often = np.flatnonzero(total >= max(4, int(3 * total.mean())))
        yield pa.RecordBatch.from_arrays([pa.array(often), pa.array(total[often])], names=["bucket", "n"])

    sums = materialise(docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")),
                       "jaccard-sketch")
    common = np.zeros(1 << SKETCH_BITS, np.uint8)
    usual = max(2.0, 3 * float(sums.agg(F.sum("n")).first()[0] or 0) / len(common))
    above = sums.where(F.col("n") >= 2 * usual).toPandas()
    excess = np.floor(np.log2(above["n"].to_numpy(float) / usual))
    common[above["bucket"].to_numpy(np.int64)] = np.minimum(excess, 31).astype(np.uint8)
    return docs.sparkSession.sparkContext.broadcast(common)


def _common(sets: Sets, sketch: Broadcast) -> np.ndarray:
    return sketch.value[(sets.tokens >> np.uint64(53 - SKETCH_BITS)).astype(np.int64)]


def _classes(docs: DataFrame, sketch: Broadcast, words: int) -> DataFrame:
    """For each row: size and signature of its set, share of rare tokens, minimum token under each guide order."""
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sets(batches, words):
            held, start = sets.sizes > 0, sets.bounds[:-1][sets.sizes > 0]
            rare = np.zeros(len(held))
            np.add.at(rare, sets.owner, _common(sets, sketch) == 0)
            least = np.zeros((len(held), GUIDES), np.int64)
            for g in range(GUIDES if len(start) else 0):
                least[held, g] = np.minimum.reduceat(mix(sets.tokens ^ _SEEDS[ORDERS + g]), start).view(np.int64)
            guides = pa.FixedSizeListArray.from_arrays(pa.array(least.ravel()), GUIDES).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sets.sizes), pa.array(sets.signatures()),
                 pa.array(rare / np.maximum(sets.sizes, 1)), guides],
                names=["doc_id", "n", "sig", "rare", "guides"])

    return docs.mapInArrow(describe, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, sig long, "
                                     "rare double, guides array<long>")


def _texts(docs: DataFrame, held: KeyFilter, words: int) -> DataFrame:
    """(sig, text), one row for each signature that the filter lets through, written to the shared folder."""
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sets(batches, words):
            sig = sets.signatures()
            at = np.flatnonzero(held.holds(sig) & (sig != 0))
            yield pa.RecordBatch.from_arrays([pa.array(sig[at]), part.column("text").take(pa.array(at))], names=["sig", "text"])

    return materialise(docs.select("text").mapInArrow(pick, "sig long, text string").dropDuplicates(["sig"]), "jaccard-texts")


def _either(pairs: DataFrame) -> KeyFilter:
    """A filter of all signatures in pairs ``a, b``."""
    own = pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).distinct()
    return filter_of(own, own.count())


def _plain(column: str) -> Column:
    """A join key that no earlier exchange is dealt by, so that adaptive execution can split both sides."""
    return F.shiftleft(F.col(column), 1).bitwiseXOR(F.shiftrightunsigned(F.col(column), 63))


def _verify(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """Pairs ``a, b`` of signatures with the size of the intersection and of the union of their whole sets."""
    right = texts.select(F.col("sig").alias("b"), F.col("text").alias("text_b"))
    left = texts.select(F.col("sig").alias("a"), F.col("text").alias("text_a"))
    both = pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for part in slices(batches, "text_b", rows=_ROWS):
            a = part.column("a").to_numpy()
            new = np.array([i for i in range(len(a)) if a[i] not in known and (i == 0 or a[i] != a[i - 1])], np.int64)
            if len(known) + len(new) > 64:
                known.clear()
                new = np.flatnonzero(np.diff(a, prepend=~a[0]))
            own = sets_of(part.column("text_a").take(pa.array(new)), words)
            known.update((int(a[i]), own.of(j).copy()) for j, i in enumerate(new))
            sets = sets_of(part.column("text_b"), words)
            shared = np.array([len(np.intersect1d(known[int(x)], sets.of(i), assume_unique=True)) for i, x in enumerate(a)])
            size = np.array([len(known[int(x)]) for x in a])
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(shared),
                                              pa.array(size + sets.sizes - shared)], names=["a", "b", "shared", "either"])
            for x in list(known)[:-1]:
                del known[x]

    return both.mapInArrow(compare, "a long, b long, shared long, either long")


def _linked(threshold: int) -> Column:
    return 100 * F.col("shared") >= threshold * F.col("either")


def _far() -> Column:
    return 1 - F.col("shared") / F.col("either")


def _guided(kinds: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b): a text ``b`` and the most typical text ``a`` of a bucket they share under two guide orders or more."""
    # The guide's number makes the seventh of its bits, so that orders do not meet.
    bucket = F.posexplode("guides").alias("g", "token")
    rows = (kinds.select("sig", "n", "rare", bucket)
            .withColumn("bucket", F.xxhash64("g", "token")).drop("g", "token"))
    typical = (rows.groupBy("bucket").agg(F.min(F.struct("rare", "n", "sig")).alias("first"), F.count("*").alias("many"))
               .where("many > 1").select(F.col("bucket").alias("_b"), "first"))
    met = rows.withColumn("_key", _plain("bucket")).join(
        typical.select(_plain("_b").alias("_key"), F.col("first.sig").alias("a"), F.col("first.n").alias("n_a")), "_key")
    near = (100 * F.least("n", "n_a") >= threshold * F.greatest("n", "n_a")) & (F.col("a") != F.col("sig"))
    return met.where(near).groupBy("a", F.col("sig").alias("b")).agg(F.count("*").alias("times")).where("times > 1")


_PREFIX = "token long, center long, lo int, hi int, rest int, single boolean"
_NAMES = ["token", "center", "lo", "hi", "rest", "single"]


def _prefixes(docs: DataFrame, sketch: Broadcast, words: int, threshold: int,
              aside: KeyFilter | None = None) -> DataFrame:
    """The first tokens of every set under each order, for the centre its text stands behind.

    ``docs`` has ``text`` and, where texts may stand behind others, ``center`` and
    ``single`` (whether the centre has no other member).  Rows: the token's 48-bit
    place in the order, with the number of the order in the two lowest bits, the centre, sizes of
    the smallest and largest set, and the most tokens that any of them has from
    here on.  ``aside`` are signatures that are left out (they come another way).
    """
    centered = "center" in docs.columns

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sets(batches, words):
            sizes = sets.sizes
            center = part.column("center").to_numpy() if centered else sets.signatures()
            single = part.column("single").to_numpy(zero_copy_only=False) if centered else np.ones(len(center), bool)
            open_ = sizes > 0
            if not centered:    # equal sets need only come once
                open_ &= ~aside.holds(center) & np.isin(np.arange(len(center)), np.unique(center, return_index=True)[1])
            pick = open_[sets.owner]
            tokens, owner = sets.tokens[pick], sets.owner[pick]
            if not len(tokens):
                continue
            common = _common(sets, sketch)[pick].astype(np.uint64) << np.uint64(48)
            above = owner.astype(np.uint64) << np.uint64(53)
            # So many of the first tokens: with none of them shared, the rest is below the threshold.
            reach = (sizes - (threshold * sizes + 99) // 100 + 1)[owner]
            place = np.arange(len(tokens)) - np.searchsorted(owner, np.arange(len(sizes)))[owner]
            near = place < reach
            held, rest = owner[near], (sizes[owner] - place)[near]
            for k in range(ORDERS):
                order = np.sort(above | common | (mix(tokens ^ _SEEDS[k]) >> np.uint64(16)))[near]
                token = ((order & np.uint64((1 << 48) - 1)) << np.uint64(2)) | np.uint64(k)
                columns = (token.view(np.int64), center[held], sizes[held], sizes[held], rest, single[held])
                yield _combined(*columns) if centered else _batch(*columns)

    return docs.mapInArrow(emit, _PREFIX)


def _batch(token, center, lo, hi, rest, single) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(token), pa.array(center), *(pa.array(x.astype(np.int32)) for x in (lo, hi, rest)), pa.array(single)],
        names=_NAMES)


def _combined(token, center, lo, hi, rest, single) -> pa.RecordBatch:
    """One row for each (token, centre)."""
    order = np.lexsort((center, token))
    token, center, lo, hi, rest, single = (x[order] for x in (token, center, lo, hi, rest, single))
    start = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (center[1:] != center[:-1])]) if len(token) else order
    if len(start) < len(token):
        lo, hi, rest = (f.reduceat(x, start) for f, x in ((np.minimum, lo), (np.maximum, hi), (np.maximum, rest)))
        token, center, single = token[start], center[start], single[start]
    return _batch(token, center, lo, hi, rest, single)


def _shared_tokens(rows: DataFrame) -> DataFrame:
    """Of prefix rows, those whose token stands in the prefixes of two centres or more, one for each (token, centre).

    Rows come sorted, so a task only carries the last token's last centre from one
    batch to the next, however many rows a token has.
    """
    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried, known_shared = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in _NAMES]
            if carried is not None:
                columns = [np.concatenate([c, x]) for c, x in zip(carried, columns)]
            merged = _combined(*columns)
            token = merged.column("token").to_numpy()
            several = np.zeros(len(token), bool)
            same = token[1:] == token[:-1]
            several[1:] |= same
            several[:-1] |= same
            if known_shared:
                several |= token == token[0]
            # The last (token, centre) may go on in the next batch.
            carried = [merged.column(n).to_numpy(zero_copy_only=False)[-1:] for n in _NAMES]
            known_shared = bool(several[-1])
            several[-1] = False
            if several.any():
                yield merged.filter(pa.array(several))
        if carried is not None and known_shared:
            yield _batch(*carried)

    return rows.repartition("token").sortWithinPartitions("token", "center").mapInArrow(reduce, _PREFIX)


def _candidates(shared: DataFrame, family: DataFrame, threshold: int) -> DataFrame:
    """Pairs of centres that share such a token under every order, at places where the threshold is still in reach.

    Two single texts that already met at the shared token before are not paired
    again: where their prefixes run alike they meet once.  Texts of one family
    (sig, family), all of them single, and the ball of its typical text are not
    paired at all.
    """
    shared = shared.join(family.withColumnRenamed("sig", "center"), "center", "left").withColumn(
        "family", F.coalesce("family", "center")).select(*shared.columns, "family")
    kind = F.col("token") % 4
    # The shared token before this one in the same prefix; balls have many prefixes and so none.
    before = F.lag("token").over(Window.partitionBy("center", kind).orderBy(F.col("rest").desc(), "token"))
    shared = shared.withColumn("before", F.when(F.col("single"), before)).drop("single")
    left = shared.select("token", *(F.col(c).alias(f"{c}_a") for c in shared.columns[1:]))
    right = shared.select(F.col("token").alias("_t"), *(F.col(c).alias(f"{c}_b") for c in shared.columns[1:]))
    # shared tokens >= t / (1 + t) * (sum of both sizes)
    need = threshold * (F.col("lo_a") + F.col("lo_b"))
    within = ((F.col("center_a") < F.col("center_b")) & (F.col("family_a") != F.col("family_b"))
              & (F.col("before_a").isNull() | F.col("before_b").isNull() | (F.col("before_a") != F.col("before_b")))
              & (100 * F.col("hi_a").cast("long") >= threshold * F.col("lo_b"))
              & (100 * F.col("hi_b").cast("long") >= threshold * F.col("lo_a"))
              & ((100 + threshold) * F.col("rest_a").cast("long") >= need)
              & ((100 + threshold) * F.col("rest_b").cast("long") >= need))
    met = left.join(right, (F.col("token") == F.col("_t")) & within)
    return (met.groupBy(F.col("center_a").alias("a"), F.col("center_b").alias("b"))
            .agg(F.bit_or(F.pow(F.lit(2), kind).cast("int")).alias("orders"))
            .where(F.col("orders") == (1 << ORDERS) - 1).select("a", "b"))


def _doubtful(doubt: DataFrame, balls: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """Members of pairs of balls whose centres do not settle whether members link: (a, sig) of the larger and of the other ball."""
    slack = 1 - threshold / 100 + _ALMOST
    radius = balls.groupBy("center").agg(F.max("far").alias("radius"))
    right = (doubt.join(balls.select(F.col("center").alias("b"), "sig", F.col("far").alias("own")), "b")
             .join(radius.select(F.col("center").alias("a"), "radius"), "a")
             .where(F.col("far") - F.col("own") - F.col("radius") <= slack).select("a", "sig").distinct())
    left = balls.select(F.col("center").alias("a"), "sig").join(doubt.select("a").distinct(), "a", "left_semi")
    return left, right


def _tiles(left: DataFrame, right: DataFrame, texts: DataFrame, threshold: int, words: int) -> DataFrame:
    """Links that join whatever texts (a, sig) on the left and right of the same ``a`` are linked.

    A tile holds ``TILE`` texts of either side at most.  It finds every link between
    them but reports only those that join groups not yet joined in it, so its
    result is never larger than its input.
    """
    counts = left.groupBy("a").agg(F.count("*").alias("lefts")).join(right.groupBy("a").agg(F.count("*").alias("rights")), "a")

    def chunks(n: str) -> Column:
        return F.ceil(F.col(n) / TILE).cast("long")

    def deal(n: str) -> Column:
        return F.pmod(F.xxhash64("sig"), chunks(n))

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), chunks(n) - 1))

    sides = (left.join(counts, "a").select("a", "sig", F.lit(True).alias("left"), deal("lefts").alias("row"), every("rights").alias("col"))
             .unionByName(right.join(counts, "a").select("a", "sig", F.lit(False).alias("left"), every("lefts").alias("row"),
                                                         deal("rights").alias("col"))))
    placed = sides.join(texts, "sig")

    def links(table: pa.Table) -> pa.Table:
        on_left = table.column("left").to_numpy(zero_copy_only=False).astype(bool)
        sig = table.column("sig").to_numpy()
        l_text, r_text = (table.column("text").filter(pa.array(x)).combine_chunks() for x in (on_left, ~on_left))
        l_sig, r_sig = sig[on_left], sig[~on_left]
        root = {int(x): int(x) for x in sig}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        found = []
        for at in range(0, len(l_sig), _ROWS):
            base = sets_of(l_text.slice(at, _ROWS), words)
            order = np.argsort(base.tokens, kind="stable")
            tokens, owner = base.tokens[order], base.owner[order]
            for to in range(0, len(r_sig), _ROWS):
                other = sets_of(r_text.slice(to, _ROWS), words)
                for i in range(len(other.sizes)):
                    own = other.of(i)
                    a, b = np.searchsorted(tokens, own), np.searchsorted(tokens, own, side="right")
                    hit = a < b
                    if not hit.any():
                        continue
                    a, n = a[hit], (b - a)[hit]
                    flat = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
                    both = np.bincount(owner[flat], minlength=len(base.sizes))
                    for j in np.flatnonzero(100 * both >= threshold * (base.sizes + len(own) - both)):
                        x, y = int(l_sig[at + j]), int(r_sig[to + i])
                        u, v = find(x), find(y)
                        if u != v:
                            root[u] = v
                            found.append((x, y))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return placed.groupBy("a", "row", "col").applyInArrow(links, "a long, b long")


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): the smallest node that each node of the links ``a, b`` reaches.

    Alternates large and small stars until nothing changes; every round is two
    exchanges of the links and is written to the shared folder.
    """
    stars = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                        .where("u <> v").distinct(), name)

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(
            F.col("u").alias("_u"), F.least("m", "u").alias("m"))
        met = both.withColumn("_key", _plain("u")).join(least.withColumn("_key", _plain("_u")), "_key")
        if large:
            out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
                least.select(F.col("_u").alias("u"), F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    def state(edges: DataFrame):
        return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()

    before = None
    while True:
        now = state(stars)
        if now == before:
            break
        before = now
        stars = materialise(star(star(stars, True), False), name)
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))


def links(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """The sets of ``docs`` (``doc_id, text``), and verified links between different sets that keep all components whole.

    The first frame has ``doc_id, n, sig`` for each row; the second pairs ``a, b``
    of signatures.  Every pair of sets at the threshold is connected by them.
    """
    sketch = _sketch(docs, words)
    rows = materialise(_classes(docs, sketch, words), "jaccard-sets")
    kinds = materialise(rows.where("n > 0").groupBy("sig").agg(
        F.first("n").alias("n"), F.first("rare").alias("rare"), F.first("guides").alias("guides")), "jaccard-classes")

    guided = materialise(_guided(kinds, threshold), "jaccard-guided")
    held = _either(guided)
    texts = _texts(docs, held, words)
    met = materialise(_verify(guided, texts, words).withColumn("far", _far()), "jaccard-near")
    behind = met.where(_linked(threshold)).groupBy("b").agg(F.min(F.struct("far", "a")).alias("c")).select(
        F.col("b").alias("sig"), F.col("c.a").alias("center"), F.col("c.far").alias("far"))
    behind = materialise(behind, "jaccard-behind")
    centers = behind.select(F.col("center").alias("sig"), "center", F.lit(0.0).alias("far")).distinct()

    # Texts that the filter holds back surely were in no such pair and are their own centres; it let through all of texts.
    alone = _prefixes(docs.select("text"), sketch, words, threshold, held)
    # Single texts near a typical one without a link to it: they are compared with its ball and with each other in tiles.
    # A text with a ball of its own is in no family, as its ball would be in no tile; it meets others in the token join.
    placed_else = behind.select(F.col("sig").alias("b")).unionByName(centers.select(F.col("sig").alias("b")))
    family = materialise(met.where(F.col("far") <= FAMILY).join(placed_else, "b", "left_anti")
                         .groupBy("b").agg(F.min(F.struct("far", "a")).alias("c"))
                         .select(F.col("b").alias("sig"), F.col("c.a").alias("family")), "jaccard-family")
    leads = centers.select("sig", F.lit(True).alias("leads"))
    placed = texts.join(behind, "sig", "left").join(leads, "sig", "left").select(
        "text", F.coalesce("center", "sig").alias("center"), (F.col("center").isNull() & F.col("leads").isNull()).alias("single"))
    others = _prefixes(placed, sketch, words, threshold)
    shared = materialise(_shared_tokens(alone.unionByName(others)), "jaccard-tokens")
    pairs = materialise(_candidates(shared, family, threshold), "jaccard-pairs")
    more = _texts(docs, _either(pairs), words)
    judged = materialise(_verify(pairs, more, words).withColumn("far", _far()), "jaccard-judged")

    balls = behind.unionByName(centers)
    radius = balls.groupBy("center").agg(F.max("far").alias("radius"), F.count("*").alias("many"))
    sides = judged.where(~_linked(threshold)).select("a", "b", "far")
    for side in ("a", "b"):
        sides = (sides.join(radius.select(F.col("center").alias(side), F.col("radius").alias(f"r_{side}"),
                                          F.col("many").alias(f"many_{side}")), side, "left")
                 .fillna({f"r_{side}": 0.0, f"many_{side}": 1}))
    open_ = sides.where((F.col("r_a") + F.col("r_b") > 0)
                        & (F.col("far") <= 1 - threshold / 100 + F.col("r_a") + F.col("r_b") + _ALMOST))
    swap = F.col("many_a") < F.col("many_b")
    doubt = materialise(open_.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"),
                                     F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"), "far"), "jaccard-doubt")
    single = doubt.select(F.col("b").alias("sig"), F.col("b").alias("center"), F.lit(0.0).alias("far")).distinct()
    every_ball = balls.unionByName(single).groupBy("center", "sig").agg(F.min("far").alias("far"))
    all_texts = texts.unionByName(more).dropDuplicates(["sig"])
    found = behind.select(F.col("sig").alias("a"), F.col("center").alias("b")).unionByName(
        judged.where(_linked(threshold)).select("a", "b"))
    if doubt.head(1):
        found = found.unionByName(_tiles(*_doubtful(doubt, every_ball, threshold), all_texts, threshold, words))
    if family.head(1):
        own = family.select(F.col("family").alias("a"), "sig")
        typical = own.select("a", F.col("a").alias("sig")).distinct()
        ball = behind.select(F.col("center").alias("a"), "sig").join(own.select("a").distinct(), "a", "left_semi")
        found = found.unionByName(_tiles(own.unionByName(typical).unionByName(ball), own, texts, threshold, words))
    return rows.select("doc_id", "n", "sig"), materialise(found, "jaccard-links")


def near_groups(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD, id_col: str = "doc_id",
                text: str = "text") -> DataFrame:
    """Which rows reach each other over links of at least ``threshold`` per cent Jaccard similarity.

    Columns: ``doc_id, n_shingles, component_id``; one row for each row of ``docs``.
    A-Z fold to a-z; a set holds the distinct shingles of ``words`` words of the
    whole text; a text with fewer words has its whole sequence as one shingle.
    Null texts and texts without words have no shingles and are linked with
    nothing.  ``component_id`` is the smallest id in reach, the own included; null
    ids count for nothing, and a component of null ids alone has a null one.  Equal
    sets are always linked; rows of equal ids are kept.  Other columns are not
    read.  An empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows, found = links(docs, words, threshold)
    roots = components(found, "jaccard-components")
    placed = (rows.where("n > 0").withColumn("_key", _plain("sig"))
              .join(roots.select(_plain("node").alias("_key"), "root"), "_key", "left")
              .select("doc_id", "n", F.coalesce("root", "sig").alias("root")))
    placed = materialise(placed, "jaccard-placed")
    least = placed.groupBy("root").agg(F.min("doc_id").alias("component_id")).select(_plain("root").alias("_key"), "component_id")
    linked = placed.withColumn("_key", _plain("root")).join(least, "_key").select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id")
    empty = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(empty)


def keep_one(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD, id_col: str = "doc_id",
             text: str = "text") -> DataFrame:
    """The rows of ``docs`` without those that reach a smaller id, with all their columns.

    Ids name documents: rows of one id stay or go together.  Rows with a null id go
    if a row with an id is in reach.  Texts that surely stay are not shuffled.
    """
    groups = materialise(near_groups(docs, words, threshold, id_col, text), "jaccard-groups")
    gone = groups.where("component_id IS NOT NULL AND NOT doc_id <=> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    held = filter_of(gone.select(F.xxhash64("__gone").alias("key")), gone.count())
    marked = docs.withColumn("__maybe", held.test(F.xxhash64(F.col(id_col))))
    rest = marked.where("__maybe").join(gone, F.col(id_col).eqNullSafe(F.col("__gone")), "left_anti")
    return marked.where(~F.col("__maybe")).unionByName(rest).drop("__maybe")
