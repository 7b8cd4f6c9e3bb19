"""Periodic runs of words, from Lyndon arrays.

A run is a maximal stretch of words with smallest period q that holds at least two
periods.  Every run starts, somewhere in its first period, a Lyndon root that is
the longest Lyndon word at its place under the order of words or under the reverse
order.  The longest Lyndon words come from the first phase of a grouping suffix
sorter: suffixes start in groups by their first word; groups are taken from the
highest down, and each lifts the suffixes just before its members into new groups
whose common prefix (their Lyndon word so far) is longer by its own.  A group's
prefix is final when its turn comes.  Roots are then extended to both sides by
longest common extensions.

Before that, stretches that surely hold no run are cut out: in a run of twelve
words or more every word lies in some six consecutive words that occur twice in it.
What remains of ordinary text is next to nothing, and no run is lost or shortened.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from docweir.llm.words import raw_bytes, slices, words_of

#: Fewest words of a run.
LEAST = 12
_RUN = StructType([StructField(x, LongType(), False) for x in ("start", "length", "period")])


def lyndon_array(ranks: list[int]) -> list[int]:
    """Length of the longest Lyndon word that starts at each place; the end counts as smaller than every symbol.

    ``groups`` holds the members a group ever had (those that moved on are passed
    over), ``prefix`` the length of its common prefix, ``below`` and ``above`` the
    order of the groups.  ``left`` leads from a place to the nearest one at or
    before it whose group is still to come.
    """
    n = len(ranks)
    symbols = sorted(set(ranks))
    number = {s: k for k, s in enumerate(symbols)}
    own = [number[s] for s in ranks]
    groups: list[list[int]] = [[] for _ in symbols]
    for i, g in enumerate(own):
        groups[g].append(i)
    size = [len(x) for x in groups]
    prefix = [1] * len(groups)
    below = list(range(-1, len(groups) - 1))
    above = [*range(1, len(groups)), -1]
    longest, left = [1] * n, list(range(n))
    g = len(groups) - 1
    while g >= 0:
        reach = prefix[g]
        members = [i for i in groups[g] if own[i] == g] if len(groups[g]) != size[g] else groups[g]
        for i in members:
            longest[i] = reach
            left[i] = i - 1
        times: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and left[j] != j:
                if left[j] >= 0 and left[left[j]] != left[j]:
                    left[j] = left[left[j]]
                j = left[j]
            left[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        # More repeats of the group's prefix sort higher, so they are lifted first and end up above the others.
        lifted: dict[tuple[int, int], list[int]] = {}
        for j, k in times.items():
            lifted.setdefault((k, own[j]), []).append(j)
        for k, old in (lifted if len(lifted) < 2 else sorted(lifted, reverse=True)):
            moved = lifted[k, old]
            if len(moved) == size[old]:
                prefix[old] += k * reach
                continue
            new = len(groups)
            groups.append(moved)
            size.append(len(moved))
            size[old] -= len(moved)
            prefix.append(prefix[old] + k * reach)
            over = above[old]
            above.append(over)
            below.append(old)
            above[old] = new
            if over >= 0:
                below[over] = new
            for j in moved:
                own[j] = new
        g = below[g]
    return longest


def _ahead(codes: bytes, i: int, j: int, width: int) -> int:
    """Symbols that stand equal from places ``i < j`` on."""
    n, step, at = len(codes) // width, 8, 0
    while j + at < n:
        step = min(step, n - j - at)
        if codes[(i + at) * width:(i + at + step) * width] == codes[(j + at) * width:(j + at + step) * width]:
            at += step
            step *= 2
        elif step == 1:
            break
        else:
            step = max(1, step // 2)
    return at


def _behind(codes: bytes, i: int, j: int, width: int) -> int:
    """Symbols that stand equal before places ``i < j``."""
    step, at = 8, 0
    while i - at > 0:
        step = min(step, i - at)
        if codes[(i - at - step) * width:(i - at) * width] == codes[(j - at - step) * width:(j - at) * width]:
            at += step
            step *= 2
        elif step == 1:
            break
        else:
            step = max(1, step // 2)
    return at


def runs_of(symbols: list, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least ``least`` symbols, sorted; exact for any hashable, ordered symbols."""
    number = {s: k for k, s in enumerate(sorted(set(symbols)))}
    ranks = [number[s] for s in symbols]
    n, codes, found = len(ranks), np.array(ranks, "<u4").tobytes(), set()
    for order in (ranks, [-x for x in ranks]):
        ends: dict[int, tuple[int, int]] = {}
        for i, q in enumerate(lyndon_array(order)):
            j = i + q
            if j >= n or (ranks[i] != ranks[j] and (i == 0 or ranks[i - 1] != ranks[j - 1])):
                # Equal to neither side: nothing to extend, unless the root ends the text.
                if not (j == n and i > 0 and ranks[i - 1] == ranks[j - 1]):
                    continue
            begin, end = ends.get(q, (0, 0))
            if begin <= i and j <= end:
                continue    # a root of the run found last for this period
            start = i - _behind(codes, i, j, 4)
            stop = j + (_ahead(codes, i, j, 4) if j < n else 0)
            if stop - start >= 2 * q:
                ends[q] = (start, stop)
                if stop - start >= least:
                    found.add((start, stop - start, q))
    return sorted(found)


def _stretches(hashes: np.ndarray, bounds: np.ndarray, window: int, least: int) -> Iterator[tuple[int, int, int]]:
    """(text, from, to) of stretches outside which no run of ``least`` words lies; equal words have equal hashes.

    ``window`` is half of ``least``: a run is at least its period and that many words
    longer than one period, so each of its words lies in a window that its period repeats.
    """
    begins, ends = bounds[:-1], bounds[1:]
    text = np.arange(len(begins))
    for _ in range(4):
        keep = ends - begins >= least
        text, begins, ends = text[keep], begins[keep], ends[keep]
        sizes = ends - begins
        if not len(sizes):
            return
        total, starts = int(sizes.sum()), np.cumsum(sizes) - sizes
        at = np.repeat(begins - starts, sizes) + np.arange(total)
        piece = np.repeat(np.arange(len(sizes)), sizes)
        summed = np.zeros(max(0, total - window + 1), np.uint64)
        for k in range(window):
            summed += hashes[at[k:k + len(summed)]] * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) % 2 ** 64)
        whole = piece[:len(summed)] == piece[window - 1:]
        place = np.flatnonzero(whole)
        bits = np.uint64(max(1, int(len(sizes)).bit_length()))
        packed = (piece[place].astype(np.uint64) << (np.uint64(64) - bits)) | (summed[place] >> bits)
        ordered = np.sort(packed)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if not len(twice):
            return
        spot = np.minimum(np.searchsorted(twice, packed), len(twice) - 1)
        place = place[twice[spot] == packed]
        covered = np.zeros(total + 1, np.int32)
        np.add.at(covered, place, 1)
        np.add.at(covered, place + window, -1)
        inside = np.cumsum(covered[:-1]) > 0
        edge = np.flatnonzero(np.r_[True, (inside[1:] != inside[:-1]) | (piece[1:] != piece[:-1])])
        stop = np.r_[edge[1:], total]
        held = inside[edge]
        edge, stop = edge[held], stop[held]
        same = len(edge) == len(sizes) and int((stop - edge).sum()) == total
        text, begins, ends = text[piece[edge]], at[edge], at[stop - 1] + 1
        if same:
            break
    for k in np.flatnonzero(ends - begins >= least):
        yield int(text[k]), int(begins[k]), int(ends[k])


def find_runs(docs: DataFrame, text: str = "text", runs: str = "runs", kept: str = "kept_text", n_words: str = "n_words",
              least: int = LEAST) -> DataFrame:
    """``docs`` with the runs of words of each whole text and the text without repeats.

    Words are ``[^\\x20\\x09-\\x0D]+``; null counts as empty.  ``runs`` is an array of
    (start, length, period) in numbers of words, by start, then period: every
    stretch of at least ``least`` words and two periods that has that smallest
    period and that no neighbouring word extends.  ``kept`` has the words outside
    runs and the first period of each run, joined by one space (a word that any run
    covers after its first period goes); ``n_words`` counts the words before.
    Columns of those three names are replaced, all others and all rows stay,
    repeated ones too; an empty table gives an empty result.  Nothing is shuffled;
    a worker holds one slice of texts, or one longer text.
    """
    fields = [f for f in docs.schema.fields if f.name not in (runs, kept, n_words)]
    schema = StructType([*fields, StructField(runs, ArrayType(_RUN)), StructField(kept, StringType()),
                         StructField(n_words, LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            raw, ends = raw_bytes(part.column(text))
            words = [raw[a:b].tobytes().split() for a, b in zip(ends[:-1], ends[1:])]
            hashed = words_of(part.column(text))
            found: dict[int, list[tuple[int, int, int]]] = {}
            for i, a, b in _stretches(hashed.hashes, hashed.bounds, least // 2, least):
                base = a - int(hashed.bounds[i])
                own = runs_of(words[i][base:base + b - a], least)
                if own:
                    found.setdefault(i, []).extend((base + s, n, q) for s, n, q in own)
            texts, counts = [], [len(w) for w in words]
            for i, w in enumerate(words):
                if i in found:
                    stays = bytearray(b"\1") * len(w)
                    for s, n, q in found[i]:
                        stays[s + q:s + n] = bytes(n - q)
                    w = list(compress(w, stays))
                texts.append(b" ".join(w))
            every = [sorted(found.get(i, ())) for i in range(len(words))]
            flat = np.array([x for own in every for x in own], np.int64).reshape(-1, 3)
            items = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], names=list(_RUN.names))
            offsets = pa.array(np.cumsum([0, *map(len, every)]).astype(np.int32))
            columns = [part.column(f.name) for f in fields]
            columns += [pa.ListArray.from_arrays(offsets, items), pa.array(texts, pa.binary()).cast(pa.string()),
                        pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)
    return docs.mapInArrow(run, schema)
