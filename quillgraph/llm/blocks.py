"""Numbered blocks of documents, and numbers packed into binary cells.

A task numbers the documents it reads in blocks; what it sends away carries the block and
the place in it, and comes back to the block after a join elsewhere.  A block never
spans tasks, so its number stays valid once the table that holds it has been written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from quillgraph.llm.textkit import partitions

#: Documents of a block at most, so that a place takes 16 bits.
BLOCK_DOCS = 1 << 16


def block_numbers() -> Iterator[int]:
    """Numbers of this task's blocks, which no other task has."""
    number = TaskContext.get().partitionId() << 32
    while True:
        yield number
        number += 1


def pack(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary cell for every count: that many of the values, in order."""
    offsets = (np.concatenate([[0], np.cumsum(counts)]) * values.itemsize).astype(np.int32)
    data = np.ascontiguousarray(values).tobytes()
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])


def unpack(column: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of all cells of a binary column without nulls, and how many each cell has."""
    _, offsets, data = column.cast(pa.binary()).buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset: column.offset + len(column) + 1]
    held = b"" if data is None else data.slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes()
    return np.frombuffer(held, dtype), np.diff(ends) // np.dtype(dtype).itemsize


def closed(parts: DataFrame, sums: dict[str, type], add: Callable[[dict[str, np.ndarray], pa.RecordBatch], None],
           finish: Callable[[pa.RecordBatch, dict[str, np.ndarray]], pa.RecordBatch], schema: str) -> DataFrame:
    """Bring rows back to their block and finish its documents.

    Rows with a null ``slot`` hold what to ``add`` to the sums of the block's places; rows
    with a slot are its documents, which ``finish`` turns into results once all is added.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, {}
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(blocks)) + 1, [len(blocks)]]).tolist()
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if blocks[a] != current:
                    current, held = blocks[a], {n: np.zeros(BLOCK_DOCS, t) for n, t in sums.items()}
                part = batch.slice(a, b - a)
                document = pc.is_valid(part.column("slot"))
                if document.false_count:
                    add(held, part.filter(pc.invert(document)))
                if document.true_count:
                    mine = part.filter(document)
                    at = mine.column("slot").to_numpy(zero_copy_only=False)
                    yield finish(mine, {n: x[at] for n, x in held.items()})

    ordered = parts.repartition(partitions(parts), "block").sortWithinPartitions("block", F.col("slot").asc_nulls_first())
    return ordered.mapInArrow(run, schema)
