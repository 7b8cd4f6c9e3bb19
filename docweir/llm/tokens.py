"""Byte-pair encoding by per-prefix dynamic programming.

For every prefix of a word there is exactly one token that its encoding can end
with.  It is found among the vocabulary's tokens that are suffixes of the prefix
(an automaton yields them in one pass): the one that starts the word, or that is
compatible with the last token of the shorter prefix before it.  The stored last
tokens are back-pointers; following them from the end gives the ids.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from docweir.llm.words import slices

# Fixed values of byte-level vocabularies: white space as their splitting rule
# knows it, the splitting rule, and the printable bytes, which stand for themselves.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

#: Bytes of encoded words that a Python worker keeps during a task, over all its memos, and pairs of tokens it has compared.
MEMO_BYTES = 64 << 20
MEMO_PAIRS = 250_000
#: What an entry of a memo takes beside its word and ids: two object heads and the dictionary's slot, with room to grow.
_ENTRY = 200


class _Memo(dict):
    """Packed ids of words, each encoded when first asked for; ``room`` is told of every entry."""

    def __init__(self, encode, before: str, room):
        super().__init__()
        self._encode, self._before, self._room = encode, before, room

    def __missing__(self, word: str) -> bytes:
        packed = self._encode(self._before + word)
        if len(word) <= 64:
            self._room(_ENTRY + 2 * len(word) + len(packed))
            self[word] = packed
        return packed


def byte_letters() -> list[str]:
    """The character that stands for each byte; the others follow from 256 on."""
    others = iter(range(256, 512))
    shown = set(PRINTABLE)
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


class ByteBpe:
    """Encoder and decoder for a byte-level vocabulary file (``model.vocab``, ``model.merges``)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model, letters = whole["model"], byte_letters()
        vocab: dict[str, int] = model["vocab"]
        self._rank: dict[tuple[int, int], int] = {}
        halves: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, both = vocab[a], vocab[b], vocab[a + b]
            self._rank[left, right] = rank
            halves.setdefault(both, (left, right, rank))
        self._right = {t: self._spine(t, halves, 1) for t in vocab.values()}
        self._left = {t: self._spine(t, halves, 0) for t in vocab.values()}
        self._table = {b: letter for b, letter in enumerate(letters)}
        back = {letter: b for b, letter in enumerate(letters)}
        self.special = {x["content"]: x["id"] for x in whole.get("added_tokens", [])}
        self.bytes_of = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        self._suffixes = ahocorasick.Automaton()
        for text, token in vocab.items():
            if text in self.special:
                continue
            self.bytes_of[token] = bytes(back[c] for c in text)
            if token not in halves or self.agree(*halves[token][:2], halves[token][2]):
                self._suffixes.add_word(text, (len(text), token))
        self._suffixes.make_automaton()
        for text, token in self.special.items():
            self.bytes_of[token] = text.encode()
        marks = "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True))
        self._marks = regex.compile(f"({marks})") if marks else None
        self._pieces = regex.compile(SPLIT)
        # A stretch of text between white space, with the one space before it: no piece crosses its ends.
        self._stretches = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]")
        # Where splitting at every space and line end would not give such stretches.
        self._odd_space = re.compile(rf"[ \n][{SPACE}]|[{SPACE}]\n|^[ \n]|[ \n]\Z")
        self._words, self._spaced = _Memo(self._stretch, "", self._room), _Memo(self._stretch, " ", self._room)
        self._agrees: list[dict[int, bool]] = [{} for _ in self.bytes_of]
        self._pairs = self._held = 0

    def _room(self, more: int) -> None:
        if self._held + more > MEMO_BYTES:
            self._words.clear()
            self._spaced.clear()
            self._held = 0
        self._held += more

    def forget(self) -> None:
        """Drop what was learnt from texts."""
        self._words.clear()
        self._spaced.clear()
        for row in self._agrees:
            row.clear()
        self._pairs = self._held = 0

    @staticmethod
    def _spine(token: int, halves: dict[int, tuple[int, int, int]], side: int) -> list[tuple[int, int]]:
        """The tokens along one edge of a token, smallest first, each with the rank of the merge that makes it."""
        spine = []
        while token in halves:
            spine.append((token, halves[token][2]))
            token = halves[token][side]
        spine.append((token, -1))
        return spine[::-1]

    def agree(self, a: int, b: int, before: int = 1 << 60) -> bool:
        """Whether merging leaves the border between ``a`` and ``b`` alone until rank ``before``.

        Walks the tokens that touch the border in the order in which merging makes
        them.  A merge across it happens if its rank comes while both its parts
        are there; of two merges of equal rank the one further left goes first.
        """
        left, right, i, j = self._right[a], self._left[b], 0, 0
        while True:
            grows_left = left[i + 1][1] if i + 1 < len(left) else before
            grows_right = right[j + 1][1] if j + 1 < len(right) else before
            across = self._rank.get((left[i][0], right[j][0]))
            made = max(left[i][1], right[j][1])
            if across is not None and made <= across < min(before, grows_left) and across <= grows_right:
                return False
            if i + 1 == len(left) and j + 1 == len(right):
                return True
            if j + 1 == len(right) or (i + 1 < len(left) and grows_left <= grows_right):
                i += 1
            else:
                j += 1

    def _compatible(self, a: int, b: int) -> bool:
        if self._pairs >= MEMO_PAIRS:
            for row in self._agrees:
                row.clear()
            self._pairs = 0
        self._pairs += 1
        known = self._agrees[a][b] = self.agree(a, b)
        return known

    def word(self, piece: str) -> list[int]:
        """Ids of one piece of the splitting rule."""
        text = piece.encode("utf-8").decode("latin-1").translate(self._table)
        n, agrees = len(text), self._agrees
        last, size = [-1] * (n + 1), [0] * (n + 1)
        for end, (length, token) in self._suffixes.iter(text):
            end += 1
            if size[end]:
                continue
            if length != end:
                before = last[end - length]
                if before < 0:
                    continue
                known = agrees[before].get(token)
                if known is None:
                    known = self._compatible(before, token)
                if not known:
                    continue
            last[end] = token
            size[end] = length
        ids = []
        while n:
            ids.append(last[n])
            n -= size[n]
        return ids[::-1]

    def _stretch(self, text: str) -> bytes:
        """Packed ids of a stretch: split by the rule, each piece encoded."""
        body = text[1:] if text[:1] == " " else text
        if body.isalpha():
            return array("I", self.word(text)).tobytes()
        if body[:-1].isalpha() and body[-1] in ".,;:!?":
            return array("I", self.word(text[:-1]) + self.word(text[-1])).tobytes()
        ids = array("I")
        for piece in self._pieces.findall(text):
            ids.extend(self.word(piece))
        return ids.tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, packed as unsigned 32-bit integers."""
        packed: list[bytes] = []
        for part in self._marks.split(text) if self._marks else [text]:
            if part in self.special:
                packed.append(array("I", [self.special[part]]).tobytes())
            elif self._odd_space.search(part):
                packed += map(self._words.__getitem__, self._stretches.findall(part))
            elif part:
                for line in part.split("\n"):
                    first, *rest = line.split(" ")
                    packed.append(self._words[first])
                    packed += map(self._spaced.__getitem__, rest)
                    packed.append(self._words["\n"])
                packed.pop()
        return b"".join(packed)

    def decode(self, packed: bytes) -> str:
        """The text of packed ids; bytes that are not UTF-8 become U+FFFD."""
        table = self.bytes_of
        return b"".join([table[i] for i in array("I", packed)]).decode("utf-8", "replace")


_loaded: dict[str, ByteBpe] = {}


def codec(path: str) -> ByteBpe:
    """The codec of a vocabulary file, loaded when a task first asks for it."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def _packed_lists(packed: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(x) // 4 for x in packed)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def encode(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with the ids of each whole text in a column ``ids`` (array of int).

    Null counts as empty and has no ids.  The vocabulary's special strings inside a
    text become their ids; none are added.  With ``decoded``, a column of that
    name has the text that the ids decode to.  All columns and rows are kept;
    ``ids`` and ``decoded`` replace columns of those names.  An empty table gives
    an empty result.  A text of any length is one pass; a worker's memory is the
    text, its ids and a bounded memo of words.  Nothing is shuffled.
    """
    kept = [f for f in docs.schema.fields if f.name not in (ids, decoded)]
    schema = StructType([*kept, StructField(ids, ArrayType(IntegerType()))]
                        + ([StructField(decoded, StringType())] if decoded else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        try:
            for batch in slices(batches, text):
                packed = [own.encode(x or "") for x in batch.column(text).to_pylist()]
                columns = [batch.column(f.name) for f in kept] + [_packed_lists(packed)]
                if decoded:
                    columns.append(pa.array([own.decode(x) for x in packed], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        finally:    # a worker that goes on to tasks of other stages keeps nothing of this one
            own.forget()
            _loaded.pop(vocabulary, None)
    return docs.mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``df`` with the text of each row's ids; null ids give the empty text."""
    kept = [f for f in df.schema.fields if f.name != text]
    schema = StructType([*kept, StructField(text, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in batches:
            texts = [own.decode(array("I", x or []).tobytes()) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + [pa.array(texts, pa.string())],
                                             names=schema.names)
    return df.mapInArrow(run, schema)


def ids_digest(ids: str = "ids"):
    """SHA-256 (lowercase hex) of a row's ids as little-endian unsigned 32-bit integers."""
    @F.arrow_udf("string")
    def digest(column: pa.Array) -> pa.Array:
        flat = pc.list_flatten(column).cast(pa.int32()).to_numpy(zero_copy_only=False).astype("<u4").tobytes()
        ends = np.cumsum([0, *pc.fill_null(pc.list_value_length(column), 0).to_pylist()]) * 4
        return pa.array([hashlib.sha256(flat[a:b]).hexdigest() for a, b in zip(ends[:-1], ends[1:])])
    return digest(F.col(ids))
