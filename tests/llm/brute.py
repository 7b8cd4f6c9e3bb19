"""Plain Python versions of the corpus operators, for small inputs."""

from __future__ import annotations

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text) -> str:
    return hashlib.sha256((text or "").encode()).hexdigest()


def words(text) -> list[str]:
    return WORD.findall(text or "")


def exact(docs) -> collections.Counter:
    """(doc_id, keep_id, group_size, kept, digest), with exactly one kept row in each group."""
    groups = collections.defaultdict(list)
    for i, text in docs:
        groups[text or ""].append(i)
    out = collections.Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        stays = False
        for i in ids:
            first = i == keep and not stays
            stays |= first
            out[i, keep, len(ids), first, sha(text)] += 1
    return out


def shingles(text, n: int = 5) -> set:
    w = words((text or "").translate(_LOWER))
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def near(docs, threshold: int = 80) -> dict:
    """doc_id -> (set size, smallest reachable id); ids are unique and not null."""
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    held = collections.defaultdict(list)
    for i in sorted(sets):
        common = collections.Counter(e for s in sets[i] for e in held[s])
        for e, both in common.items():
            if 100 * both >= threshold * (len(sets[i]) + len(sets[e]) - both):
                a, b = find(i), find(e)
                root[max(a, b)] = min(a, b)
        for s in sets[i]:
            held[s].append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


def mixed(docs, place, weights=(1, 2, 3), most=3) -> dict:
    """doc_id -> (size, source_size, target, taken) for (doc_id, source, text); ids are unique."""
    size = {i: len(words(t)) for i, _, t in docs}
    source = {i: s for i, s, _ in docs}
    total = collections.Counter()
    for i in size:
        total[source[i]] += size[i]
    order = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + [s for s in total if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, clamped = {}, set()
    while True:
        left = sum(total.values()) - sum(most * total[s] for s in clamped)
        free = sum(weight[s] for s in total if s not in clamped)
        level = left / free if free else 0
        over = {s for s in total if s not in clamped and weight[s] * level > most * total[s]}
        if not over:
            break
        clamped |= over
    target = {s: float(most * total[s]) if s in clamped else weight[s] * level for s in total}
    out = {}
    for s in total:
        whole = int(target[s] // total[s]) if total[s] else 0
        more, upto = target[s] - whole * total[s], 0
        for i in sorted((i for i in size if source[i] == s), key=lambda i: (place(i), size[i])):
            upto += size[i]
            out[i] = (size[i], total[s], target[s], size[i] * (whole + (2 * upto - size[i] <= 2 * more)))
    return out


def cut(docs, window: int = 50) -> dict:
    """doc_id -> (words, removed, digest of what is kept); ids are unique."""
    first = {}
    own = {i: words(t) for i, t in docs}
    for i in sorted(own):
        for p in range(len(own[i]) - window + 1):
            first.setdefault(tuple(own[i][p:p + window]), i)
    out = {}
    for i, w in own.items():
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p:p + window])] < i:
                gone.update(range(p, p + window))
        out[i] = (len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))
    return out
