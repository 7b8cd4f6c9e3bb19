"""Spelling variants: words one edit apart, found in a trie of letter-group counts.

A word is described by how often it uses each group of letters.  Inserting a letter
raises one count by one, deleting lowers one, replacing does both or neither, so the
vectors of two words one edit apart differ by a surplus of at most one and a deficit
of at most one.  Words stand in a trie whose levels are the successive counts; a
depth-first search carries that budget and what it finds at a leaf is verified.

Of two words with different vectors the one that is smaller at the first difference
is the visitor, so that each pair is met once.  The upper levels of the trie are the
key by which Spark deals words: each word lies in its own subtree and visits those
that its budget can reach.  Subtrees that are still too large are cut into tiles.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweir.llm.words import slices
from docweir.session import materialise

#: Letters, from common to rare: the first have groups of their own, the others share the rest.
_LETTERS = "etaoinshrdlcumwfgypbvkjxqz"
ALONE, GROUPS = 16, 20
_GROUP = {c: k if k < ALONE else ALONE + k % (GROUPS - ALONE) for k, c in enumerate(_LETTERS)}
#: Words of a tile on either side, and different words that a counting task holds before it hands them on.
TILE = 20_000
HELD_WORDS = 200_000
_PAIRS = "word string, n_near long, best_n long, best string"


def vector(word: str) -> tuple[int, ...]:
    """Counts of the letter groups; characters outside a-z share groups by their code point."""
    counts = [0] * GROUPS
    for c in word:
        counts[_GROUP.get(c, ALONE + ord(c) % (GROUPS - ALONE))] += 1
    return tuple(counts)


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point leads from one word to the other."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) == len(b)):] == b[k + 1:]


class Trie:
    """Words by the counts from level ``top`` on; a branch with one vector is a leaf at once."""

    def __init__(self, words: list[str], top: int):
        self.root, self._top = None, top
        leaves: dict[tuple[int, ...], list[str]] = {}
        for w in words:
            leaves.setdefault(vector(w), []).append(w)
        self.root = self._grown(list(leaves.items()), top)

    def _grown(self, leaves: list, level: int):
        if len(leaves) == 1:
            return leaves[0]
        children: dict[int, list] = {}
        for leaf in leaves:
            children.setdefault(leaf[0][level], []).append(leaf)
        return {c: self._grown(x, level + 1) for c, x in children.items()}

    def reach(self, own: tuple[int, ...], used: int) -> Iterator[tuple[list[str], bool]]:
        """Word lists of the leaves within the budget, and whether the leaf has this very vector.

        ``used`` tells how much of the budget the levels above took: nothing (0),
        the surplus (1), or surplus and deficit (2).  The surplus comes first.
        """
        open_ = [(self.root, self._top, used)]
        while open_:
            node, level, state = open_.pop()
            if type(node) is tuple:
                for have, want in zip(node[0][level:], own[level:]):
                    if have != want:
                        if have - want == (1, -1, 0)[state]:
                            state += 1
                        else:
                            state = -1
                            break
                if state >= 0:
                    yield node[1], state == 0
                continue
            want = own[level]
            if want in node:
                open_.append((node[want], level + 1, state))
            if state == 0 and want + 1 in node:
                open_.append((node[want + 1], level + 1, 1))
            elif state == 1 and want - 1 in node:
                open_.append((node[want - 1], level + 1, 2))


def count_words(docs: DataFrame, pattern: str, least: int, id_col: str = "doc_id", text: str = "text",
                edit: Callable[[object], Callable[[bytes], bytes]] | None = None) -> DataFrame:
    """(word, n): the runs of letters of every whole text and how often they occur; A-Z fold to a-z.

    ``pattern`` is a class of Latin-1 characters, in bytes of Latin-1.  ``edit``, if
    given, makes for each row's id a function that changes each run (as Latin-1
    bytes; equal runs of a row change alike).  Words of fewer than ``least`` code
    points are left out; null texts have none.
    """
    # Runs shorter than any word can come from are not looked at: an edit does not lengthen a run.
    runs = re.compile(rb"%s{%d,}" % (pattern.encode("latin-1"), least))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def told() -> pa.RecordBatch:
            words = [w.decode("latin-1") for w in held]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(held.values()), pa.int64())],
                                              names=["word", "n"])
        for part in slices(batches, "_text"):
            ids = part.column("_id").to_pylist() if edit else [None] * part.num_rows
            for i, whole in zip(ids, part.column("_text").to_pylist()):
                if not whole:
                    continue
                found = runs.findall(whole.encode("latin-1", "replace").lower())
                if edit:
                    change = edit(i)
                    for w, n in Counter(found).items():
                        w = change(w)
                        if len(w) >= least:
                            held[w] += n
                else:
                    held.update(found)
                if len(held) >= HELD_WORDS:
                    yield told()
                    held.clear()
        if held:
            yield told()

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _depth(words: DataFrame) -> int:
    """Levels of the trie that make the key: the fewest after which no subtree holds more words than a tile, if any do."""
    @F.udf("array<int>")
    def counts(word):
        return list(vector(word))

    vectors = materialise(words.select(counts("word").alias("v")), "spelling-vectors")
    for depth in range(3, GROUPS, 2):
        largest = vectors.groupBy(F.slice("v", 1, depth)).count().agg(F.max("count")).first()[0]
        if (largest or 0) <= TILE:
            return depth
    return GROUPS


def _visits(depth: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each word in its own subtree, and as a visitor in those that a surplus, or a surplus and then a deficit, reach."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, words, ns, used = [], [], [], []
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                own = list(vector(word)[:depth])
                met = [(own, 0)]
                for g in range(depth):
                    more = own[:g] + [own[g] + 1] + own[g + 1:]
                    met.append((more, 1))
                    met += [(more[:h] + [more[h] - 1] + more[h + 1:], 2) for h in range(g + 1, depth) if more[h]]
                for key, state in met:
                    keys.append(bytes(min(c, 255) for c in key) if max(key) < 255 else repr(key).encode())
                    words.append(word)
                    ns.append(n)
                    used.append(state)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(words, pa.string()), pa.array(ns, pa.int64()),
                                              pa.array(used, pa.int32())], names=["key", "word", "n", "used"])
    return run


def near_words(words: DataFrame) -> DataFrame:
    """For each of ``words`` (word, n; words unique) that has near words: ``word, n_near, best_n, best``.

    Near words are exactly one edit apart; ``best`` is the near word of largest
    ``n``, of equals the smallest in code-point order.
    """
    depth = _depth(words)
    visits = materialise(words.mapInArrow(_visits(depth), "key binary, word string, n long, used int"), "spelling-visits")
    sizes = visits.groupBy("key").agg(F.count_if(F.col("used") == 0).alias("own"), F.count("*").alias("every"))
    sizes = sizes.where("own > 0").select(F.col("key").alias("_key"), F.ceil(F.col("own") / TILE).cast("long").alias("cols"),
                                          F.ceil(F.col("every") / (4 * TILE)).cast("long").alias("rows"))

    def deal(parts: str) -> Column:
        return F.pmod(F.xxhash64("word"), F.col(parts))

    def every(parts: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1))

    placed = visits.join(sizes, F.col("key") == F.col("_key"))
    # A tile has the words of one part of a subtree, and one part of those that visit it (its own words among them).
    owners = placed.where("used = 0").select("key", "word", "n", F.lit(-1).alias("used"), deal("cols").alias("col"), every("rows").alias("row"))
    guests = placed.select("key", "word", "n", "used", every("cols").alias("col"), deal("rows").alias("row"))

    def search(table: pa.Table) -> pa.Table:
        words_, ns, used = (table.column(c).to_pylist() for c in ("word", "n", "used"))
        n_of = dict(zip(words_, ns))
        own = [w for w, u in zip(words_, used) if u < 0]
        near: dict[str, list] = {}

        def meet(a: str, b: str) -> None:
            seen = near.get(a)
            n = n_of[b]
            if seen is None:
                near[a] = [1, n, b]
            else:
                seen[0] += 1
                if n > seen[1] or (n == seen[1] and b < seen[2]):
                    seen[1], seen[2] = n, b

        if own:
            trie = Trie(own, depth)
            for w, u in zip(words_, used):
                if u < 0:
                    continue
                for leaf, same in trie.reach(vector(w), u):
                    for other in leaf:
                        if (not same or w < other) and one_edit(w, other):
                            meet(w, other)
                            meet(other, w)
        rows = list(near.values())
        return pa.table({"word": pa.array(list(near), pa.string()), "n_near": pa.array([x[0] for x in rows], pa.int64()),
                         "best_n": pa.array([x[1] for x in rows], pa.int64()), "best": pa.array([x[2] for x in rows], pa.string())})

    # One column names a tile, so that the tiles of one subtree are dealt apart.
    tile = F.concat_ws("/", F.hex("key"), "row", "col").alias("tile")
    met = owners.unionByName(guests).select("word", "n", "used", tile).groupBy("tile").applyInArrow(search, _PAIRS)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def group_variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """Words (word, n) with their forms: ``word, form, root, n, n_near, form_n``.

    A word's form is its near word of largest ``n`` if that is at least ``ratio``
    times its own, else null; ``root`` follows forms to the last one.  Rows with a
    null word are dropped; of repeated words the counts are added.  Words may hold
    any characters.  An empty table gives an empty result.
    """
    if ratio < 2:
        raise ValueError("forms must be more frequent than their variants")
    words = materialise(words.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").cast("long").alias("n")), "spelling-words")
    near = near_words(words).withColumnRenamed("word", "_word")
    led = F.col("best_n") >= ratio * F.col("n")
    rows = materialise(words.join(near, F.col("word") == F.col("_word"), "left").select(
        "word", F.when(led, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(led, F.col("best_n")).alias("form_n")), "spelling-forms")
    # Each form is at least ``ratio`` times as frequent, so no chain is longer than the logarithm of the largest count.
    most, least = rows.agg(F.max("n"), F.min("n")).first()
    longest = int(math.log(max(most or 1, 1) / max(least or 1, 1)) / math.log(ratio)) + 1
    hops = rows.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(max(0, longest - 1).bit_length()):
        onward = hops.select(F.col("word").alias("_at"), F.col("root").alias("_to"))
        hops = materialise(hops.join(onward, F.col("root") == F.col("_at"), "left").select(
            "word", F.coalesce("_to", "root").alias("root")), "spelling-roots")
    ends = hops.select(F.col("word").alias("_at"), F.col("root").alias("_root"))
    return rows.join(ends, F.col("word") == F.col("_at"), "left").select(
        "word", "form", F.coalesce("_root", "word").alias("root"), "n", "n_near", "form_n")
