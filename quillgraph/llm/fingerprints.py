"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range and the
``LEAST`` smallest, so sketches of parts merge into that of their union, a short text
is kept whole, and a small document can be looked for in a much larger one: two
sketches are compared below the hash up to which both are complete, so the shares
estimate likeness and containment without bias from the sizes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quillgraph.llm.textkit import Words, as_bytes, partitions, slices, unique_per_owner

SHINGLE_WORDS = 5

#: One of so many hashes is kept: 16 hexadecimal digits for every fourth word, less than the words themselves.
FRACTION = 4
#: So many of the smallest hashes are kept in any case.
LEAST = 64


def sketches(texts: list[bytes | None], size: int = SHINGLE_WORDS, fraction: int = FRACTION) -> list[np.ndarray]:
    """Sorted kept hashes of each text; none for a text without words."""
    out: list[np.ndarray] = []
    limit = np.uint64((1 << 64) // fraction)
    for cut in slices(texts):
        hashes, owner = Words(texts[cut]).shingles(size)
        hashes, owner = unique_per_owner(hashes, owner)
        count = cut.stop - cut.start
        first = np.searchsorted(owner, np.arange(count))
        keep = (hashes < limit) | (np.arange(len(owner)) - first[owner] < LEAST)  # those of an owner are in order
        hashes, owner = hashes[keep], owner[keep]
        out += np.split(hashes, np.searchsorted(owner, np.arange(1, count)))
    return out


def _complete(sketch: np.ndarray, fraction: int) -> np.uint64:
    """The hash up to which a sketch has all hashes of its text."""
    if len(sketch) < LEAST:
        return np.uint64((1 << 64) - 1)
    return max(np.uint64((1 << 64) // fraction - 1), sketch[LEAST - 1])


def likeness(a: np.ndarray, b: np.ndarray, fraction: int = FRACTION) -> tuple[float, float]:
    """Jaccard similarity of two sketches, and the larger containment; empty ones are alike.

    Containment is 0 if the smaller one has no hash below the mark where both are complete.
    """
    if len(a) == 0 or len(b) == 0:
        same = float(len(a) == len(b))
        return same, same
    both = min(_complete(a, fraction), _complete(b, fraction))
    a, b = a[a <= both], b[b <= both]
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / max(len(a) + len(b) - shared, 1), shared / max(min(len(a), len(b)), 1)


def to_text(sketch: np.ndarray) -> str:
    return sketch.astype(">u8").tobytes().hex()


def fingerprint(docs: DataFrame, text: str = "text", into: str = "fingerprint",
                size: int = SHINGLE_WORDS, fraction: int = FRACTION) -> DataFrame:
    """Add the sketch of every whole text: its kept hashes in order, 16 hex digits each.

    Null and empty texts get the empty string; equal texts get equal fingerprints.
    """
    @F.arrow_udf("string")
    def marks(texts: pa.Array) -> pa.Array:
        return pa.array([to_text(s) for s in sketches(as_bytes(texts), size, fraction)], pa.string())

    return docs.withColumn(into, marks(F.col(text)))


def merge(fingerprints: list[str], fraction: int = FRACTION) -> str:
    """Sketch of the texts together (shingles across their borders are not in any of them)."""
    each = [np.frombuffer(bytes.fromhex(f), dtype=">u8").astype(np.uint64) for f in fingerprints]
    whole = reduce(np.union1d, each, np.empty(0, np.uint64))
    keep = whole < np.uint64((1 << 64) // fraction)
    keep[:LEAST] = True
    return to_text(whole[keep])


_FIRST = -(1 << 63)  # a null id comes first


def _buckets(docs: DataFrame, wanted: int) -> tuple[list[int], dict[int, int]]:
    """Ids at which a new bucket begins, and for each bucket with rows the first id after it.

    Brings one number per bucket to the driver, never one per document.
    """
    key = docs.select(F.coalesce("doc_id", F.lit(_FIRST)).alias("k"))
    cuts = sorted({int(x) for x in key.approxQuantile("k", [i / wanted for i in range(1, wanted)], 0.1 / wanted)})
    firsts = {r["b"]: r["k"] for r in key.groupBy(_bucket(F.col("k"), cuts).alias("b")).agg(F.min("k").alias("k")).collect()}
    used = sorted(firsts)
    return cuts, {b: firsts[used[(i + 1) % len(used)]] for i, b in enumerate(used)}


def _bucket(key: Column, cuts: list[int]) -> Column:
    """Number of cuts that are not above the key."""
    edges = np.array(cuts, dtype=np.int64)

    @F.arrow_udf("int")
    def number(keys: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(edges, keys.to_numpy(zero_copy_only=False), side="right").astype(np.int32))

    return number(key)


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text) dealt by range of the id and sorted, each range closed by the first row of the next.

    Columns: bucket, guest (True for that closing row), k (the id; null first), text.
    A table written once could be read in order as well; this moves every text once.
    """
    docs = docs.select("doc_id", "text")
    wanted = max(4 * partitions(docs), 1)
    cuts, following = _buckets(docs, wanted)
    keyed = docs.withColumn("k", F.coalesce("doc_id", F.lit(_FIRST)))
    own = keyed.withColumns({"bucket": _bucket(F.col("k"), cuts), "guest": F.lit(False)})
    after = docs.sparkSession.createDataFrame(sorted(following.items()), "bucket int, k bigint")
    closing = keyed.join(F.broadcast(after), "k").withColumn("guest", F.lit(True))  # one row per bucket
    return (own.unionByName(closing).repartition(partitions(docs), "bucket")
            .sortWithinPartitions("bucket", "guest", "k", "text"))


_OUT = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, contained_edited double, contained_next double")
_OUT_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
    ("contained_edited", pa.float64()), ("contained_next", pa.float64())])


def edited_pairs(docs: DataFrame, size: int = SHINGLE_WORDS, fraction: int = FRACTION) -> DataFrame:
    """Fingerprint each text, its edited text and the next document's, and compare them.

    The edited text replaces the last floor(n/2) code points by the first as many of
    the next document in ascending order of doc_id, after the last the first.  Null
    texts are empty; a null id comes first; rows of one id follow in order of text.
    near_* is the Jaccard similarity of the sketches, contained_* the containment;
    equal texts give 1, a text without words and one with words 0.
    """
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []   # the last row of the previous batch, if its next is not known yet
        for batch in batches:
            held += zip(batch.column("bucket").to_pylist(), batch.column("guest").to_pylist(),
                        batch.column("doc_id").to_pylist(), [(t or b"").decode("utf-8", "replace") for t in as_bytes(batch.column("text"))])
            pairs = [(a[2], a[3], b[3]) for a, b in zip(held, held[1:]) if not a[1] and a[0] == b[0]]
            held = held[-1:]
            if not pairs:
                continue
            edited = [own[: len(own) - len(own) // 2] + after[: len(own) // 2] for _, own, after in pairs]
            marks = sketches([t.encode() for _, t, _ in pairs], size, fraction)
            marks_edited = sketches([t.encode() for t in edited], size, fraction)
            marks_next = [*marks[1:], None]
            rows = []
            for i, (doc, own, after) in enumerate(pairs):
                if i + 1 == len(pairs) or pairs[i + 1][1] != after:
                    marks_next[i] = sketches([after.encode()], size, fraction)[0]
                near, far = likeness(marks[i], marks_edited[i], fraction), likeness(marks[i], marks_next[i], fraction)
                near = (1.0, 1.0) if own == edited[i] else near
                far = (1.0, 1.0) if own == after else far
                rows.append((doc, len(own), hashlib.sha256(edited[i].encode()).hexdigest(), to_text(marks[i]),
                             to_text(marks_edited[i]), near[0], far[0], near[1], far[1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows), _OUT_ARROW)], schema=_OUT_ARROW)

    return with_next(docs).mapInArrow(compare, _OUT)
