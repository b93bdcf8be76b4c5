"""Words and hashes of whole batches of texts, in numpy.

A word is a run of bytes other than 0x20 and 0x09-0x0D; as these are ASCII,
cutting UTF-8 bytes and cutting code points give the same words.  Work arrays
cover one slice of a batch at a time, so memory follows ``SLICE_BYTES``, not the
length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: A word as a pattern for Java, Python and RE2 alike.
WORD = r"[^\x20\x09-\x0D]+"

#: Text handled at a time in a worker; its hashes just need powers up to 2**18.
SLICE_BYTES = (1 << 18) - 64

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser that spreads every input bit over the output."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


@lru_cache(maxsize=8)
def _byte_table(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed * 1_000_003 + 17))


def _multiplier(seed: int) -> int:
    """An odd number of 64 bits, fixed by the seed."""
    return int(mix(np.array([seed * 7_919 + 3], dtype=_U))[0]) | 1


_POWERS: dict[int, np.ndarray] = {}


def _powers(multiplier: int, size: int) -> np.ndarray:
    """Powers of an odd number modulo 2**64; those for slices are kept, longer ones made for the call."""
    kept = _POWERS.get(multiplier)
    if kept is None or len(kept) < size:
        kept = np.full(max(1 << 18, size), multiplier, dtype=_U)
        kept[0] = 1
        kept = np.multiply.accumulate(kept)
        if size <= 1 << 18:
            _POWERS[multiplier] = kept
    return kept


def _scales(multiplier: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64."""
    return _powers(multiplier, size), _powers(pow(multiplier, -1, 1 << 64), size)


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """Hash of each run ``values[start:end]``; equal runs get equal hashes wherever they lie."""
    multiplier = _multiplier(seed)
    power, inverse = _scales(multiplier, len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=_U)
    np.cumsum(values * power[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


class Words:
    """The words of a list of texts given as bytes; None counts as empty.

    ``bounds[d]:bounds[d + 1]`` are the words of text ``d``.
    """

    def __init__(self, texts: list[bytes | None], lower: bool = False):
        parts = [t or b"" for t in texts]
        joined = b"\n".join(parts) + b"\n"
        self.data = np.frombuffer(joined.lower() if lower else joined, dtype=np.uint8)  # bytes.lower: A-Z only
        word = ~_SPACE[self.data]
        turn = np.flatnonzero(word[1:] != word[:-1]) + 1
        if len(word) and word[0]:
            turn = np.concatenate([[0], turn])
        self.starts, self.ends = turn[0::2], turn[1::2]  # the last byte is a separator
        sizes = np.array([len(p) + 1 for p in parts], dtype=np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.bounds = np.searchsorted(self.starts, self.offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts())

    def hashes(self, seed: int = 0) -> np.ndarray:
        out = np.empty(len(self), dtype=_U)
        table, at = _byte_table(seed), 0
        while at < len(self):
            base = self.starts[at]
            to = max(at + 1, int(np.searchsorted(self.ends, base + SLICE_BYTES, side="right")))
            starts, ends = self.starts[at:to] - base, self.ends[at:to] - base
            out[at:to] = run_hashes(table[self.data[base: base + ends[-1]]], starts, ends, seed)
            at = to
        return out

    def shingles(self, size: int, seed: int = 0, short_whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all ``size``-word windows, in order, and the text each belongs to.

        With ``short_whole`` a text of fewer words (but any) gives one window of all its words.
        """
        counts, hashes = self.counts(), self.hashes(seed)
        windows = np.maximum(counts - size + 1, 0)
        if short_whole:
            windows = np.where((windows == 0) & (counts > 0), 1, windows)
        owner = np.repeat(np.arange(len(counts)), windows)
        first = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        starts = self.bounds[owner] + first
        ends = np.minimum(starts + size, self.bounds[owner + 1])
        return run_hashes(hashes, starts, ends, seed + 101), owner


def slices(texts: list[bytes | None]) -> Iterator[slice]:
    """Cuts of a batch into neighbouring texts of about ``SLICE_BYTES`` together."""
    start = total = 0
    for i, text in enumerate(texts):
        total += len(text or b"")
        if total >= SLICE_BYTES:
            yield slice(start, i + 1)
            start, total = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type)
    return column.cast(pa.large_binary() if large else pa.binary()).to_pylist()


def unique_per_owner(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each owner, by owner and then value."""
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    if len(values) == 0:
        return values, owner
    new = np.concatenate([[True], (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])])
    return values[new], owner[new]


def spread(df: DataFrame) -> DataFrame:
    """Use every core even if the table has few files."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
