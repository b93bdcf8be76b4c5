"""Substring dedup: words inside passages that occur more than once in the corpus.

A window is a fixed number of consecutive words.  The first pass counts window
hashes in a count-min sketch; the sketches of the tasks merge by adding, so every
estimate is at least the true count.  The second pass sends only windows that are
estimated twice or more to an exact grouping by 96 hash bits; a window that truly
repeats is never missed.  Within a task, windows that meet there are settled on
the spot and sent on once, so a passage held by a third of all documents gives
one row per task and not one per copy.

The merged sketch is one bit per cell ("counted twice or more").  It has
``ROWS`` times twice as many cells as there are windows, at most ``MOST_BITS`` in all
(128 MB); beyond that, more windows go to the exact grouping, and none is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quillgraph.llm.sketches import Membership, by_segment, gather, merged
from quillgraph.llm.textkit import Words, as_bytes, mix, partitions, slices, spread
from quillgraph.session import materialise

WINDOW_WORDS = 35
ROWS = 2
MOST_BITS = 1 << 30
RANGES = 256               # in which the sketch is sent and merged, whatever its width
FLUSH = 1 << 19            # windows that a task counts before it sends them on
SETTLE = 1 << 18           # candidate windows that meet within a task
ROWS_OUT = 1 << 14         # rows of one Arrow batch to the JVM
WORD_BYTES = 6             # rough size of a word with its space, for the sketch's width

_U = np.uint64


def _cells(hashes: np.ndarray, width: int) -> list[np.ndarray]:
    """One cell per row of the sketch, from 32 bits of the hash each."""
    return [((hashes if r == 0 else mix(hashes + _U(r))) >> _U(32)) * _U(width) >> _U(32) for r in range(ROWS)]


def _windows(texts: list[bytes | None], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of every window, the text it belongs to and the number of its first word."""
    words = Words(texts)
    first, owner = words.shingles(size, 11, short_whole=False)
    second, _ = words.shingles(size, 12, short_whole=False)
    starts = np.searchsorted(owner, np.arange(len(texts)))
    return first, (second >> _U(32)).astype(np.uint32), owner, np.arange(len(owner)) - starts[owner]


def _steps(sorted_cells: np.ndarray) -> bytes:
    """Cells of a range as steps of 32 bits, low bytes before high bytes, which compresses well."""
    return np.diff(sorted_cells, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_steps(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(packed, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64))


def _range_cells(width: int) -> int:
    """Cells of a range, a multiple of 8."""
    return -(-ROWS * width // (8 * RANGES)) * 8


def _sketch_rows(hashes: np.ndarray, width: int) -> pa.RecordBatch:
    rows = []
    for row, cells in enumerate(_cells(hashes, width)):
        cells, counts = np.unique((cells + _U(row * width)).astype(np.uint32), return_counts=True)   # MOST_BITS is below 2**32
        rows += [(s, _steps(at[~many]), _steps(at[many])) for s, at, many in by_segment(cells, counts > 1, size=_range_cells(width))]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], names=["segment", "once", "more"])


def repeated_cells(docs: DataFrame, width: int, size: int) -> DataFrame:
    """Merged sketch: (segment, bits) by range, a bit for each cell counted twice or more."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            for cut in slices(texts):
                held.append(Words(texts[cut]).shingles(size, 11, short_whole=False)[0])
                total += len(held[-1])
                if total >= FLUSH:
                    yield _sketch_rows(np.concatenate(held), width)
                    held, total = [], 0
        if total:
            yield _sketch_rows(np.concatenate(held), width)

    def add(counts: np.ndarray, piece: dict) -> None:
        one = _from_steps(piece["once"])
        counts[one] = np.minimum(counts[one] + 1, 2)
        counts[_from_steps(piece["more"])] = 2

    parts = docs.select("text").mapInArrow(count, "segment int, once binary, more binary")
    return merged(parts, np.uint8, add, lambda counts: np.packbits(counts > 1, bitorder="little").tobytes(), _range_cells(width))


def _width(docs: DataFrame) -> int:
    total = docs.select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    return max(1 << 16, min(2 * int(total) // WORD_BYTES, MOST_BITS // ROWS))


def _bitmap(docs: DataFrame, width: int, size: int) -> bytes:
    """The merged sketch as one bitmap; its size is bounded by ``MOST_BITS``."""
    return gather(repeated_cells(docs, width, size), RANGES, _range_cells(width) // 8)


_HITS = pa.schema([("h1", pa.int64()), ("rest", pa.int64()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("settled", pa.binary())])


def _settle(h1, h2, docs, marks, pos) -> Iterator[pa.RecordBatch]:
    """Rows to send on for one flush of candidate windows; ``rest`` is h2 and the place plus one.

    A window met once goes on with its place; one met more often goes on once, with place
    0, and its places come back as one row per document.  Rows keep the order of the
    documents, in which neighbours have most in common and compress best.
    """
    order = np.lexsort((h2, h1))
    new = np.concatenate([[True], (np.diff(h1[order]) != 0) | (np.diff(h2[order]) != 0)])
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, len(h1))) > 1
    alone, twice = np.sort(order[first[~many]]), order[first[many]]
    local = order[many[np.cumsum(new) - 1]]
    by_doc = local[np.lexsort((pos[local], marks[local], docs[local]))]
    edge = np.flatnonzero((np.diff(docs[by_doc]) != 0) | (np.diff(marks[by_doc]) != 0)) + 1
    groups = np.split(by_doc, edge) if len(by_doc) else []
    heads = np.array([g[0] for g in groups], dtype=np.int64)
    rest = (h2.astype(np.int64) << 32)
    none = np.zeros(len(twice), np.int64)
    batch = pa.RecordBatch.from_arrays([
        pa.array(np.concatenate([h1[alone].view(np.int64), h1[twice].view(np.int64), docs[heads]])),
        pa.array(np.concatenate([rest[alone] | (pos[alone] + 1), rest[twice], np.zeros(len(heads), np.int64)])),
        pa.array(np.concatenate([docs[alone], none, docs[heads]])),
        pa.array(np.concatenate([marks[alone], none, marks[heads]])),
        pa.array([None] * (len(alone) + len(twice)) + [pos[g].astype("<i4").tobytes() for g in groups], pa.binary())], schema=_HITS)
    for start in range(0, batch.num_rows, ROWS_OUT):
        yield batch.slice(start, ROWS_OUT)


def repeated_places(docs: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """Places (doc_id, mark, settled) of all windows whose words also start elsewhere.

    ``settled`` holds word numbers as 32-bit integers; a document may have several rows.
    """
    width = _width(docs)
    sketch = docs.sparkSession.sparkContext.broadcast(_bitmap(docs, width, size))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(sketch.value, np.uint8)
        held, total = [], 0
        for batch in batches:
            ids = batch.column("doc_id").fill_null(0).to_numpy()
            marks = batch.column("mark").to_numpy()
            texts = as_bytes(batch.column("text"))
            for cut in slices(texts):
                h1, h2, owner, pos = _windows(texts[cut], size)
                keep = np.ones(len(h1), bool)
                for row, cells in enumerate(_cells(h1, width)):
                    cells = cells + _U(row * width)
                    keep &= (bits[cells >> _U(3)] >> (cells & _U(7)).astype(np.uint8) & 1).astype(bool)
                at = np.flatnonzero(keep)
                held.append((h1[at], h2[at], ids[cut][owner[at]], marks[cut][owner[at]], pos[at]))
                total += len(at)
                if total >= SETTLE:
                    yield from _settle(*(np.concatenate(x) for x in zip(*held)))
                    held, total = [], 0
        if total:
            yield from _settle(*(np.concatenate(x) for x in zip(*held)))

    sent = docs.mapInArrow(candidates, "h1 bigint, rest bigint, doc_id bigint, mark bigint, settled binary")
    dealt = sent.repartition(partitions(docs), "h1").withColumns({
        "_h2": F.shiftright("rest", 32), "pos": (F.col("rest").bitwiseAND(F.lit(0xFFFFFFFF)) - 1).cast("int")})
    times = F.when(F.col("settled").isNotNull(), 0).when(F.col("pos") < 0, 2).otherwise(1)
    met = dealt.withColumn("_total", F.sum(times).over(Window.partitionBy("h1", "_h2"))).filter(
        F.col("settled").isNotNull() | ((F.col("_total") > 1) & (F.col("pos") >= 0)))
    return met.select("doc_id", "mark", "pos", "settled")


def remove_repeats(docs: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """Remove every word covered by a window that also starts elsewhere in the corpus.

    Returns doc_id, text (the kept words joined by one space), n_words and n_removed of
    every row.  Null texts have no words; a text shorter than a window stays whole;
    of repeated rows none is spared, as each repeats the other.  Other columns are
    left out.
    """
    docs = spread(docs.select("doc_id", "text")).withColumns({
        "mark": F.xxhash64(F.coalesce("text", F.lit("")), F.col("doc_id").isNull()), "_id": F.coalesce("doc_id", F.lit(0))})
    found = materialise(repeated_places(docs, size).groupBy(F.col("doc_id").alias("_id"), "mark").agg(
        F.collect_list(F.when(F.col("pos") >= 0, F.col("pos"))).alias("single"),
        F.collect_list("settled").alias("settled")))
    # Only documents with a repeated window (and few others) are moved to meet their places.
    key = F.struct("_id", "mark")
    marked = docs.withColumn("_near", Membership(found, key).has(key))
    joined = marked.filter("_near").join(found, ["_id", "mark"], "left").select("doc_id", "text", "single", "settled")
    others = marked.filter("not _near").select("doc_id", "text", F.lit(None).cast("array<int>").alias("single"),
                                               F.lit(None).cast("array<binary>").alias("settled"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64())])
        for batch in batches:
            out = [batch.column("doc_id"), [], [], []]
            for text, single, settled in zip(as_bytes(batch.column("text")), batch.column("single").to_pylist(), batch.column("settled").to_pylist()):
                words = (text or b"").split()   # bytes.split cuts at exactly these six characters
                kept = words
                if single or settled:
                    starts = np.frombuffer(b"".join([np.array(single, "<i4").tobytes(), *settled]), "<i4")
                    step = np.bincount(starts, minlength=len(words) + 1)[: len(words)] > 0
                    turns = np.cumsum(step.astype(np.int64))
                    before = np.concatenate([np.zeros(size, np.int64), turns])[: len(words)]
                    kept = [w for w, gone in zip(words, (turns - before > 0).tolist()) if not gone]
                out[1].append(b" ".join(kept).decode("utf-8", "replace"))
                out[2].append(len(words))
                out[3].append(len(words) - len(kept))
            yield pa.RecordBatch.from_arrays([out[0], pa.array(out[1], pa.string()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())], schema=schema)

    return joined.unionByName(others).mapInArrow(cut, "doc_id bigint, text string, n_words bigint, n_removed bigint")
