"""N-gram Jaccard join through a token-group matrix.

Documents are sets of word shingles.  Similar sets (equal smallest hash) form groups
of bounded size; of each group its token union and sizes are kept, and a document
opens a group only if the union can hold enough of its shingles.

1. Equal sets become one node, named by the smallest doc_id.
2. Two sets above the threshold share two shingles of their prefixes (the rarest
   shingles, two more than may be missing).  Shingles that lie in one prefix only
   are dropped; nodes without any other have no link.
3. The groups compare their own members; leaders of groups cut from one large class are
   compared again.  What is connected so far is one component.
4. The token-group matrix (shingle, group) of prefix shingles that still lie in
   several components names the groups of larger components that a node may open: sizes,
   places in the prefixes and the number of shared shingles must allow it.  The stored union
   of a group's shingles then bounds the overlap, and only if it suffices is the group opened
   and its members compared.
5. First every shingle offers only its group of the largest component, which joins the parts
   of a class of near copies; what is in several components after that asks all groups.

Links inside a component cannot change the result and are not looked for, so a class
of thousands of near copies costs one comparison with its group each, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillgraph.llm.linking import connected
from quillgraph.llm.scratch import Scratch
from quillgraph.llm.sketches import codes_of, frequency_codes
from quillgraph.llm.textkit import Words, as_bytes, partitions, run_hashes, slices, spread, unique_per_owner
from quillgraph.session import materialise

GROUP_NODES = 128       # members of a group, about
GROUP_QUERIES = 256     # documents that open a group in one task, about
UNION_TEXTS = 16        # texts of a group whose sets are held at a time
COLUMNS = 1 << 13       # shingles of a comparison held as a dense block
SEED = 31


def _sets(texts: list[bytes | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, by text and hash."""
    return unique_per_owner(*Words(texts, lower=True).shingles(size, SEED))


def _by_rarity(hashes: np.ndarray, owner: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Order by owner, then rarity, then hash."""
    key = (owner.astype(np.uint64) << np.uint64(40)) | (code.astype(np.uint64) << np.uint64(32)) | (hashes >> np.uint64(32))
    order = np.argsort(key)
    tied = key[order]
    if owner.size and (owner[-1] >= 1 << 24 or (tied[1:] == tied[:-1]).any()):   # rarely: the whole hashes decide
        order = np.lexsort((hashes, code, owner))
    return order


def shingle_table(docs: DataFrame, size: int, percent: int, scratch: Scratch) -> DataFrame:
    """Per row: set size, two hashes of the set, its smallest hash, and its prefix, rarest first."""
    codes = scratch.share(docs, frequency_codes(docs, lambda t: _sets(t, size)[0]))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(codes.value, np.uint8)
        for batch in batches:
            texts, at = as_bytes(batch.column("text")), 0
            for cut in slices(texts):
                hashes, owner = _sets(texts[cut], size)
                count = cut.stop - cut.start
                bounds = np.searchsorted(owner, np.arange(count + 1))
                n = np.diff(bounds)
                keys = [run_hashes(hashes, bounds[:-1], bounds[1:], s).view(np.int64) for s in (1, 2)]
                order = _by_rarity(hashes, owner, codes_of(table, hashes))
                prefix = np.minimum(n - (n * percent + 99) // 100 + 2, n)
                rank = np.arange(len(owner)) - np.repeat(bounds[:-1], n)
                chosen = hashes[order][rank < np.repeat(prefix, n)].view(np.int64)
                low = np.zeros(count, np.int64)
                low[n > 0] = hashes[bounds[:-1][n > 0]].view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(at, count), pa.array(n), *map(pa.array, keys), pa.array(low),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(prefix)]).astype(np.int32)), pa.array(chosen))],
                    names=["doc_id", "n", "k1", "k2", "low", "prefix"])
                at += count

    return docs.mapInArrow(measure, "doc_id bigint, n bigint, k1 bigint, k2 bigint, low bigint, prefix array<bigint>")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, as block-wise products of membership matrices."""
    out = np.zeros((len(left), len(right)))
    sets = [*left, *right]
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = times[column] > 1
    row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [start, start + COLUMNS])
        block = np.zeros((len(sets), COLUMNS), np.float32)
        block[row[a:b], column[a:b] - start] = 1
        out += block[: len(left)] @ block[len(left):].T
    return out


def _linked(shared: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    return (shared > 0) & (100 * shared >= percent * (left[:, None] + right[None, :] - shared))


def _split(texts: list[bytes | None], size: int) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for cut in slices(texts):
        hashes, owner = _sets(texts[cut], size)
        out += np.split(hashes, np.searchsorted(owner, np.arange(1, cut.stop - cut.start)))
    return out


_LED = pa.schema([("node", pa.int64()), ("leader", pa.int64())])


def _grouped(nodes: DataFrame) -> DataFrame:
    """(node, low, gid, chunks): nodes of equal ``low``, cut into groups of about ``GROUP_NODES``."""
    counts = nodes.groupBy("low").agg(F.ceil(F.count("*") / GROUP_NODES).alias("chunks"))
    return nodes.join(counts, "low").select("node", "low", "chunks", F.xxhash64(
        "low", F.pmod(F.xxhash64(F.lit(5), "node"), F.col("chunks"))).alias("gid"))


def _within(groups: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, leader): each member of a group and the best linked member of its component there."""
    several = groups.groupBy("gid").agg(F.count("*").alias("_n")).filter("_n > 1").select("gid")

    def compare(table: pa.Table) -> pa.Table:
        ids = table.column("node").to_numpy()
        sets = _split(as_bytes(table.column("text")), size)
        n = np.array([len(s) for s in sets])
        linked = _linked(overlaps(sets, sets), n, n, percent)
        degree, label = linked.sum(axis=1), np.full(len(ids), -1)
        for i in np.lexsort((ids, -degree)):
            if label[i] < 0:
                edge = np.array([i])
                label[i] = i
                while len(edge):
                    edge = np.flatnonzero(linked[edge].any(axis=0) & (label < 0))
                    label[edge] = i
        return pa.Table.from_arrays([pa.array(ids), pa.array(ids[label])], schema=_LED)

    members = texts.join(groups.join(several, "gid").select("node", "gid"), "node")
    return members.groupBy("gid").applyInArrow(compare, "node bigint, leader bigint")


def _unions(groups: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """(gid, shingles): the union of each group's sets as sorted hashes of 64 bits, packed."""
    def join(table: pa.Table) -> pa.Table:
        union = np.zeros(0, np.uint64)
        for batch in table.to_batches(UNION_TEXTS):
            union = np.union1d(union, np.concatenate(_split(as_bytes(batch.column("text")), size)))
        return pa.table({"gid": table.column("gid").slice(0, 1), "shingles": pa.array([union.tobytes()], pa.binary())})

    return groups.select("gid", "node").join(texts, "node").groupBy("gid").applyInArrow(join, "gid bigint, shingles binary")


def _bounded(asked: DataFrame, unions: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The questions (node, gid) whose group's union holds enough of the node's shingles."""
    def fits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        union, current = None, None
        for batch in batches:
            gids, packed = batch.column("gid").to_pylist(), batch.column("shingles")
            sets = _split(as_bytes(batch.column("text")), size)
            keep = []
            for i, gid in enumerate(gids):
                if gid != current or packed[i].is_valid:
                    current, union = gid, np.frombuffer(packed[i].as_buffer(), np.uint64)
                if not packed[i].is_valid and 100 * int(np.isin(sets[i], union, assume_unique=True).sum()) >= percent * len(sets[i]):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(keep, pa.int32())), batch.column("gid").take(pa.array(keep, pa.int32()))],
                                             names=["node", "gid"])

    # A group of many questions is dealt into parts, each with the union once.
    parts = asked.groupBy("gid").agg(F.ceil(F.count("*") / GROUP_QUERIES).cast("int").alias("parts"))
    heads = unions.join(parts, "gid").select(
        "gid", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("bigint").alias("node"), F.lit(None).cast("string").alias("text"), "shingles")
    rows = asked.join(parts, "gid").select("gid", F.pmod(F.xxhash64(F.lit(9), "node"), F.col("parts")).cast("int").alias("part"), "node").join(
        texts, "node").select("gid", "part", "node", "text", F.lit(None).cast("binary").alias("shingles"))
    ordered = heads.unionByName(rows).repartition(partitions(asked), "gid", "part").sortWithinPartitions(
        "gid", "part", F.col("node").asc_nulls_first())
    return ordered.mapInArrow(fits, "node bigint, gid bigint")


def _across(marked: DataFrame, groups: DataFrame, texts: DataFrame, size: int, percent: int, best: bool, scratch: Scratch) -> DataFrame:
    """(a, b): links between components, found by opening groups through the token-group matrix.

    With ``best`` every shingle offers one group only, that of its largest component.
    """
    # Of two components the smaller one's members ask, the larger one's groups are opened.
    rank = F.struct("comp_size", "comp")
    ends = marked.groupBy("token").agg(F.min(rank).alias("_lo"), F.max(rank).alias("_hi")).filter("_lo < _hi")
    rows = scratch.cut(marked.join(ends, "token").withColumns({"asks": rank < F.col("_hi"), "held": rank > F.col("_lo")}).drop("_lo", "_hi"))
    cell = F.struct(rank.alias("top"), F.col("gid").alias("open"))
    matrix = rows.filter("held").groupBy("token", F.col("gid").alias("open")).agg(
        F.min("n").alias("n_min"), F.max("n").alias("n_max"), F.max("rest").alias("rest_max"), F.max(rank).alias("top"))
    if best:
        first = rows.filter("held").groupBy("token").agg(F.max(cell).alias("_b")).select("token", F.col("_b.open").alias("open"))
        matrix = matrix.join(first, ["token", "open"], "leftsemi")
    # The least overlap that a link with a member of allowed size needs; the second shared shingle leaves one place less.
    least = F.greatest("n_min", F.call_function("div", F.col("n") * percent + 99, F.lit(100)))
    need = F.call_function("div", (F.col("n") + least) * percent + (99 + percent), F.lit(100 + percent))
    may = ((F.col("n_max") * 100 >= F.col("n") * percent) & (F.col("n_min") * percent <= 100 * F.col("n")) & (F.col("top") > rank)
           & (F.least("rest", "rest_max") >= need - 1))
    asked = scratch.cut(rows.filter("asks").join(matrix, "token").filter(may).groupBy("node", F.col("open").alias("gid")).agg(
        F.count("*").alias("_shared"), F.min(need).alias("_need")).filter("_shared >= least(2, _need)").select("node", "gid"))
    opened = groups.join(asked.select("gid").distinct(), "gid", "leftsemi")
    asked = scratch.cut(_bounded(asked, scratch.cut(_unions(opened, texts, size)), texts, size, percent))
    parts = asked.groupBy("gid").agg(F.ceil(F.count("*") / GROUP_QUERIES).cast("int").alias("parts"))
    comps = groups.select("node", "comp")
    queries = asked.join(parts, "gid").select(
        "gid", F.pmod(F.xxhash64(F.lit(9), "node"), F.col("parts")).cast("int").alias("part"), "node", F.lit(True).alias("asks"))
    members = groups.join(parts, "gid").select(
        "gid", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "node", F.lit(False).alias("asks"))
    both = queries.unionByName(members).join(comps, "node").join(texts, "node")

    def search(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        ids = table.column("node").to_numpy()
        comp = table.column("comp").to_numpy()
        sets = _split(as_bytes(table.column("text")), size)
        q, m = np.flatnonzero(asks), np.flatnonzero(~asks)
        out = []
        if len(q) and len(m):
            n = np.array([len(s) for s in sets])
            linked = _linked(overlaps([sets[i] for i in q], [sets[i] for i in m]), n[q], n[m], percent)
            linked &= comp[q][:, None] != comp[m][None, :]
            for i, hits in zip(q, linked):
                found = m[hits]
                out += [(ids[i], ids[j]) for j in found[np.unique(comp[found], return_index=True)[1]]]
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return scratch.cut(both.groupBy("gid", "part").applyInArrow(search, "a bigint, b bigint"))


def components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    Words are lower-cased in A-Z; a text of fewer words than ``size`` is one shingle.  Two
    documents link when ``100 * intersection >= percent * union``; the component is the
    smallest doc_id reachable by links.  Null and empty texts have no shingles and stay
    alone; rows without doc_id link with nothing and have no component; rows of one
    doc_id are one document, linked by what any of its texts is linked to.
    """
    scratch = Scratch()
    docs = spread(docs.select("doc_id", "text"))
    sets = materialise(shingle_table(docs, size, percent, scratch))
    usable = sets.filter("n > 0 and doc_id is not null")
    nodes = usable.groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.any_value("n").alias("n"), F.any_value("prefix").alias("prefix"))
    tokens = nodes.select("node", "n", F.posexplode("prefix").alias("_i", "token")).select("node", "n", "token", (F.col("n") - F.col("_i")).alias("rest"))
    repeated = tokens.groupBy("token").agg(F.min("node").alias("_a"), F.max("node").alias("_b")).filter("_a <> _b").select("token")
    rows = scratch.cut(tokens.join(repeated, "token"))
    lows = usable.groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.any_value("low").alias("low"))
    wanted = scratch.cut(rows.select("node").distinct().join(lows, "node").groupBy("node").agg(F.min("low").alias("low")))
    near = scratch.members(wanted, F.col("node"))
    texts = scratch.cut(docs.filter(F.col("doc_id").isNotNull()).filter(near.has(F.col("doc_id"))).withColumnRenamed("doc_id", "node")
                        .join(wanted.select("node"), "node", "leftsemi").dropDuplicates(["node", "text"]))

    groups = scratch.cut(_grouped(wanted))
    level, links = groups, None
    while True:
        led = scratch.cut(_within(level, texts, size, percent))
        found = led.filter("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b"))
        links = found if links is None else links.unionByName(found)
        chunked = level.filter("chunks > 1")
        kept = chunked.join(led.filter("node <> leader").select("node"), "node", "left_anti")
        before, after = chunked.count(), kept.count()
        if after in (0, before):
            break
        level = scratch.cut(_grouped(kept.select("node", "low")))
    for best in (True, False):
        so_far = connected(links, scratch)
        placed = scratch.cut(groups.select("node", "gid").join(so_far, "node", "left").select(
            "node", "gid", F.coalesce("component", "node").alias("comp")))
        sized = placed.join(placed.groupBy("comp").agg(F.count("*").alias("comp_size")), "comp")
        marked = scratch.cut(rows.select("token", "node", "n", "rest").join(sized, "node"))
        links = links.unionByName(_across(marked, placed, texts, size, percent, best, scratch))

    # Rows of one document with different sets, and equal sets, belong together.
    own = usable.join(nodes.select("k1", "k2", "node"), ["k1", "k2"])
    alike = scratch.cut(own.select(F.col("doc_id").alias("a"), F.col("node").alias("b")).filter("a <> b"))
    named = connected(links.unionByName(alike))
    scratch.clear()
    return sets.select("doc_id", F.col("n").alias("n_shingles")).join(
        named.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
