"""Fixed-size summaries of a whole table that every task may hold.

Both are merged by shuffling the tasks' pieces by segment, never by sending
them to the driver; only the merged table, whose size is a parameter, is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quillgraph.llm.textkit import as_bytes, partitions, slices

SEGMENT = 1 << 16
FLUSH = 1 << 20

#: Cells of a frequency table (16 MB) and bits of a membership filter (16 MB) at most; smaller inputs
#: get smaller tables, of two cells a word and 16 bits a key.
CELLS = 1 << 24
BITS = 1 << 27
WORD_BYTES = 6   # rough size of a word with its space
KEY_BITS = 16


def _fitting(wanted: int, most: int) -> int:
    """The power of two from ``wanted`` on, one segment at least."""
    return max(SEGMENT, min(1 << max(wanted - 1, 0).bit_length(), most))


def pack_offsets(offsets: np.ndarray) -> bytes:
    """Sorted offsets below ``SEGMENT`` as steps, low bytes before high bytes, which compresses well."""
    return np.diff(offsets, prepend=0).astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()


def unpack_offsets(packed: bytes) -> np.ndarray:
    steps = np.frombuffer(packed, np.uint8).reshape(2, -1).T.copy().view("<u2").ravel()
    return np.cumsum(steps.astype(np.int64))


def by_segment(cells: np.ndarray, *values: np.ndarray, size: int = SEGMENT) -> Iterator[tuple]:
    """Cut sorted cell numbers (and what belongs to them) at the borders of segments of ``size`` cells."""
    if len(cells):
        cut = np.flatnonzero(np.diff(cells // size)) + 1
        for part in zip(np.split(cells, cut), *(np.split(v, cut) for v in values)):
            yield (int(part[0][0] // size), part[0] % size, *part[1:])


def merged(parts: DataFrame, dtype: type, add: Callable[[np.ndarray, dict], None],
           finish: Callable[[np.ndarray], bytes], size: int = SEGMENT) -> DataFrame:
    """(segment, bits): the pieces of each segment added up, one segment in memory at a time."""
    names = [n for n in parts.columns if n != "segment"]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, cells = None, np.zeros(size, dtype)
        done = lambda: pa.RecordBatch.from_arrays(
            [pa.array([current], pa.int32()), pa.array([finish(cells)], pa.binary())], names=["segment", "bits"])
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in names]
            for segment, *piece in zip(batch.column("segment").to_pylist(), *columns):
                if segment != current:
                    if current is not None:
                        yield done()
                    current, cells = segment, np.zeros(size, dtype)
                add(cells, dict(zip(names, piece)))
        if current is not None:
            yield done()

    return parts.repartition(partitions(parts), "segment").sortWithinPartitions("segment").mapInArrow(
        merge, "segment int, bits binary")


def gather(segments: DataFrame, count: int, width: int) -> bytes:
    """The merged table as one value of ``count * width`` bytes, its size fixed by the caller."""
    out = np.zeros((count, width), np.uint8)
    for batch in segments.toArrow().to_batches():
        for segment, bits in zip(batch.column("segment").to_pylist(), batch.column("bits")):
            out[segment] = np.frombuffer(bits.as_buffer(), np.uint8)
    return out.tobytes()


def frequency_codes(texts: DataFrame, hashes: Callable[[list[bytes | None]], np.ndarray], cells: int | None = None) -> bytes:
    """One byte per cell: 0 if no hash of any text fell there, else 1 + 8 log2(count), up to 255.

    The count of a cell is at least that of each hash in it, so code 1 means: once at most.
    The number of cells follows the bytes of the texts, if it is not given.
    """
    if cells is None:
        size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
        cells = _fitting(2 * int(size) // WORD_BYTES, CELLS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def sent() -> pa.RecordBatch:
            numbers, counts = np.unique(np.concatenate(held) & np.uint64(cells - 1), return_counts=True)
            rows = [(s, pack_offsets(o), c.astype("<u4").tobytes()) for s, o, c in by_segment(numbers.astype(np.int64), counts)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))],
                                              names=["segment", "at", "n"])

        for batch in batches:
            column = as_bytes(batch.column("text"))
            for cut in slices(column):
                held.append(hashes(column[cut]))
                total += len(held[-1])
                if total >= FLUSH:
                    yield sent()
                    held, total = [], 0
        if total:
            yield sent()

    def add(sums: np.ndarray, piece: dict) -> None:
        sums[unpack_offsets(piece["at"])] += np.frombuffer(piece["n"], "<u4").astype(np.int64)

    def finish(sums: np.ndarray) -> bytes:
        with np.errstate(divide="ignore"):
            codes = np.where(sums > 0, 1 + 8 * np.log2(sums), 0)
        return np.minimum(codes, 255).astype(np.uint8).tobytes()

    parts = texts.select("text").mapInArrow(count, "segment int, at binary, n binary")
    return gather(merged(parts, np.int64, add, finish), cells // SEGMENT, SEGMENT)


def codes_of(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return table[hashes & np.uint64(len(table) - 1)]


class Membership:
    """Filter by a bitmap of key hashes: never leaves out a key that is there."""

    def __init__(self, keys: DataFrame, key: Column, bits: int | None = None, hashed: bool = False):
        """``hashed``: the key is a number whose remainder by the number of bits is its cell; else it is hashed."""
        bits = bits or _fitting(KEY_BITS * keys.count(), BITS)
        hashed = keys.select(F.pmod(key if hashed else F.xxhash64(key), F.lit(bits)).alias("cell"))

        def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, total = [], 0

            def sent() -> pa.RecordBatch:
                rows = [(s, pack_offsets(o)) for s, o in by_segment(np.unique(np.concatenate(held)))]
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary()))], names=["segment", "at"])

            for batch in batches:
                held.append(batch.column("cell").to_numpy())
                total += len(held[-1])
                if total >= FLUSH:
                    yield sent()
                    held, total = [], 0
            if total:
                yield sent()

        def add(cells: np.ndarray, piece: dict) -> None:
            cells[unpack_offsets(piece["at"])] = True

        parts = hashed.mapInArrow(pieces, "segment int, at binary")
        whole = gather(merged(parts, bool, add, lambda c: np.packbits(c, bitorder="little").tobytes()), bits // SEGMENT, SEGMENT // 8)
        self.bits = bits
        self.shared = keys.sparkSession.sparkContext.broadcast(whole)

    def has(self, key: Column) -> Column:
        """True for every key that is there, and for few others."""
        shared = self.shared

        @F.arrow_udf("boolean")
        def found(cells: pa.Array) -> pa.Array:
            at = cells.to_numpy(zero_copy_only=False)
            table = np.frombuffer(shared.value, np.uint8)
            return pa.array((table[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

        return found(F.pmod(F.xxhash64(key), F.lit(self.bits)))
