"""Byte-level BPE encoding and decoding with a public vocabulary file.

Method: a contiguous rank array.  A short word is a list of part boundaries and
a list of the ranks of adjacent parts; the smallest rank is searched, its
boundary deleted and the two neighbouring ranks refreshed, until no pair has a
rank.  Words above ``LONG_WORD`` bytes use a heap over linked parts, which merges
in the same order, so a text without spaces costs n log n and not n squared.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from quillgraph.llm.textkit import as_bytes

#: Fixed value: the pattern that cuts a text into words before the merges.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Bytes from which a word takes the heap.
LONG_WORD = 96

#: Words whose ids a worker remembers, and the longest (in characters) that it does.
CACHE_WORDS, CACHE_CHARS = 400_000, 48

_NONE = 1 << 60


def _letters() -> dict[str, int]:
    """Byte of each letter in a byte-level vocabulary: printable Latin-1 stands for itself,
    the remaining bytes follow in order from code point 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Vocabulary, merges and added tokens of one tokenizer file."""

    def __init__(self, content: bytes):
        spec, letters = json.loads(content), _letters()
        raw = lambda token: bytes(letters[c] for c in token)
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items() if all(c in letters for c in t)}
        self.ranks = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[raw(left), raw(right)] = rank
        self.byte_ranks = {left + right: rank for (left, right), rank in self.ranks.items() if len(left) == len(right) == 1}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added = {text: np.uint32(i).tobytes() for text, i in added.items()}
        self.pieces: list[bytes] = [b""] * (max([*self.ids.values(), *added.values()]) + 1)
        for token, i in [*self.ids.items(), *((t.encode(), i) for t, i in added.items())]:
            self.pieces[i] = token
        self.words = regex.compile(PRE_TOKEN)
        longest_first = sorted(added, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if added else None
        self.cache: dict[str, bytes] = {}

    def _short(self, word: bytes) -> list[bytes]:
        bounds = list(range(len(word) + 1))
        pair = lambda i: self.ranks.get(
            (word[bounds[i]: bounds[i + 1]], word[bounds[i + 1]: bounds[i + 2]]), _NONE)
        byte_rank = self.byte_ranks.get
        ranks = [byte_rank(word[i: i + 2], _NONE) for i in range(len(word) - 1)]
        while ranks and (least := min(ranks)) < _NONE:
            at = ranks.index(least)
            del bounds[at + 1], ranks[at]
            if at:
                ranks[at - 1] = pair(at - 1)
            if at < len(ranks):
                ranks[at] = pair(at)
        return [word[a:b] for a, b in zip(bounds, bounds[1:])]

    def _long(self, word: bytes) -> list[bytes]:
        size = len(word)
        end, before = list(range(1, size + 1)), list(range(-1, size - 1))
        alive, heap = [True] * size, []

        def offer(i: int) -> None:
            j = end[i]
            if j < size and (rank := self.ranks.get((word[i:j], word[j: end[j]]), _NONE)) < _NONE:
                heapq.heappush(heap, (rank, i, j, end[j]))

        for i in range(size - 1):
            offer(i)
        while heap:
            _, i, j, k = heapq.heappop(heap)
            if not alive[i] or not (j < size and alive[j]) or end[i] != j or end[j] != k:
                continue  # one of the two parts has changed since
            alive[j], end[i] = False, k
            if k < size:
                before[k] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < size:
            out.append(word[i: end[i]])
            i = end[i]
        return out

    def _word(self, word: str) -> bytes:
        data = word.encode("utf-8")
        parts = self._short(data) if len(data) <= LONG_WORD else self._long(data)
        packed = np.array([self.ids[p] for p in parts], dtype="<u4").tobytes()
        if len(word) <= CACHE_CHARS:
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            self.cache[word] = packed
        return packed

    def _plain(self, text: str) -> bytes:
        get, make = self.cache.get, self._word
        return b"".join([get(w) or make(w) for w in self.words.findall(text)])

    def encode(self, text: str) -> bytes:
        """Ids of the text as little-endian unsigned 32-bit integers."""
        if self.split is None or not any(t in text for t in self.added):
            return self._plain(text)
        return b"".join(self.added.get(p) or self._plain(p) for p in self.split.split(text) if p)

    def decode(self, packed: bytes) -> str:
        """Text of packed ids; unknown ids give nothing, broken UTF-8 the replacement character."""
        pieces, size = self.pieces, len(self.pieces)
        ids = np.frombuffer(packed, dtype="<u4")
        if len(ids) and int(ids.max()) >= size:
            ids = ids[ids < size]
        return b"".join(map(pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _codec(content: bytes) -> Codec:
    return Codec(content)


def _shared(df: DataFrame, path: str):
    """The vocabulary file (its size does not depend on the data), read by the driver and shared once."""
    with open(path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, path: str, text: str = "text", into: str = "token_ids") -> DataFrame:
    """Add the packed ids of every whole text: four bytes a token, little-endian.

    Null and empty texts give no ids (an empty value).  Every row keeps its place and
    columns; a column that is already called ``into`` is replaced.  Equal texts give equal ids.
    """
    vocabulary = _shared(docs, path)

    @F.arrow_udf("binary")
    def packed(texts: pa.Array) -> pa.Array:
        codec = _codec(vocabulary.value)
        return pa.array([codec.encode(t.decode("utf-8", "replace")) if t else b"" for t in as_bytes(texts)], pa.binary())

    # Marked so that the planner does not repeat it inside expressions built on the ids.
    return docs.withColumn(into, packed.asNondeterministic()(F.col(text)))


def decode(tokens: DataFrame, path: str, ids: str = "token_ids", into: str = "decoded") -> DataFrame:
    """Add the text of packed ids; null gives the empty text, ``into`` is replaced if it exists."""
    vocabulary = _shared(tokens, path)

    @F.arrow_udf("string")
    def plain(packed: pa.Array) -> pa.Array:
        codec = _codec(vocabulary.value)
        return pa.array([codec.decode(p) if p else "" for p in packed.to_pylist()], pa.string())

    return tokens.withColumn(into, plain(F.col(ids)))


def token_count(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")
