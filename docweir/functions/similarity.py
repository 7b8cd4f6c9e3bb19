"""Indel similarity (M4, M5) as Arrow-batched UDFs.

``fuzz_ratio`` is 200 * LCS / (len(a) + len(b)); a substitution therefore costs
two, unlike Levenshtein distance.  ``fuzz_partial_ratio`` is the best ratio of
the shorter string against any window of the longer one; ``partial_at_least``
decides whether that reaches a threshold.  Callers filter the exact cases away
first, so only a residue of rows reaches Python.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F


def _lcs_kernel():
    def lcs(a: str, b: str) -> int:
        """Longest common subsequence length, one machine word row per character."""
        masks: dict[str, int] = {}
        for i, ch in enumerate(a):
            masks[ch] = masks.get(ch, 0) | (1 << i)
        full = (1 << len(a)) - 1
        row = full
        for ch in b:
            hit = row & masks.get(ch, 0)
            row = ((row + hit) | (row - hit)) & full
        return len(a) - row.bit_count()

    return lcs


def fuzz_ratio(a: Column, b: Column) -> Column:
    lcs = _lcs_kernel()

    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        def one(x, y):
            if x is None or y is None:
                return None
            size = len(x) + len(y)
            return 100.0 if size == 0 else 200.0 * lcs(x, y) / size

        return pd.Series([one(x, y) for x, y in zip(left, right)], dtype="float64")

    return F.pandas_udf(ratio, "double")(a, b)


def fuzz_partial_ratio(a: Column, b: Column) -> Column:
    lcs = _lcs_kernel()

    def partial(left: pd.Series, right: pd.Series) -> pd.Series:
        def best(short, long):
            n, top, chars = len(short), 0.0, set(short)
            for end in range(1, len(long) + n):
                window = long[max(0, end - n):min(end, len(long))]
                # A window whose outer characters do not occur in the needle
                # cannot beat the one without them.
                if window[-1] not in chars and end <= len(long):
                    continue
                bound = 200.0 * min(n, len(window)) / (n + len(window))
                if bound <= top:
                    continue
                top = max(top, 200.0 * lcs(short, window) / (n + len(window)))
                if top == 100.0:
                    break
            return top

        def one(x, y):
            if x is None or y is None:
                return None
            if not x or not y:
                return 100.0 if x == y else 0.0
            if len(x) == len(y):
                return max(best(x, y), best(y, x))
            return best(x, y) if len(x) < len(y) else best(y, x)

        return pd.Series([one(x, y) for x, y in zip(left, right)], dtype="float64")

    return F.pandas_udf(partial, "double")(a, b)


def _seeds(needle: Column, size: Column, errors: Column) -> Column:
    """``needle`` in ``errors + 1`` pieces, one of which every window within so many errors holds whole."""
    pieces = errors + 1

    def at(k: Column) -> Column:
        return F.floor(k * size / pieces).cast("int")

    return F.transform(F.sequence(F.lit(0), errors), lambda k: F.substr(needle, at(k) + 1, at(k + 1) - at(k)))


def partial_at_least(a: Column, b: Column, threshold: float) -> Column:
    """Whether ``fuzz_partial_ratio(a, b)`` is at least ``threshold``; null if either is.

    A score of t leaves at most ``2 n (1 - t / 100)`` characters of a needle of length
    n and its window unmatched.  Cut into one piece more, the needle has a piece that
    the window holds unharmed, so texts with none of the pieces are refused inside
    the JVM, and of the others only windows around a piece are compared.
    """
    lcs = _lcs_kernel()
    slack = 2 * (1 - threshold / 100)
    short = F.when(F.length(a) <= F.length(b), a).otherwise(b)
    long = F.when(F.length(a) <= F.length(b), b).otherwise(a)
    size = F.length(short)
    errors = F.floor(size * F.lit(slack) + 1e-9).cast("int")
    seeded = F.exists(_seeds(short, size, errors), lambda piece: F.contains(long, piece))
    # Of two strings of one length either may be the needle; both have the same pieces' number, so both are asked.
    both = F.length(a) == F.length(b)
    open_ = (size > 0) & (seeded | (both & F.exists(_seeds(long, size, errors), lambda piece: F.contains(short, piece))))

    def reaches(needle: str, hay: str) -> bool:
        n, size_ = len(needle), len(hay)
        most = int(n * slack + 1e-9)
        starts: set[int] = set()
        for k in range(most + 1):
            lo, hi = k * n // (most + 1), (k + 1) * n // (most + 1)
            piece, p = needle[lo:hi], hay.find(needle[lo:hi])
            if not piece:    # more errors than characters: any window may do
                starts.update(range(1 - n, size_))
                break
            while p >= 0:
                starts.update(range(p - lo - most, p - lo + most + 1))
                if p - lo - most <= 0:
                    starts.update(range(-most, 1))
                p = hay.find(piece, p + 1)
        for s in starts:
            window = hay[max(0, s):max(0, s + n)]
            if window and s < size_:
                whole = n + len(window)
                if 200.0 * min(n, len(window)) / whole >= threshold and 200.0 * lcs(needle, window) / whole >= threshold:
                    return True
        return False

    def decide(left: pd.Series, right: pd.Series) -> pd.Series:
        def one(x, y):
            if x is None or y is None:
                return False
            return reaches(x, y) or (len(x) == len(y) and reaches(y, x))
        return pd.Series([one(x, y) for x, y in zip(left, right)], dtype="bool")

    near = F.pandas_udf(decide, "boolean")(F.when(open_, short), F.when(open_, long))
    return (F.when(a.isNull() | b.isNull(), F.lit(None).cast("boolean"))
            .when(size == 0, F.lit(threshold <= 0) | (F.length(long) == 0)).when(open_, near).otherwise(F.lit(threshold <= 0)))
