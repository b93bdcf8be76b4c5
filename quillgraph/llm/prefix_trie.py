"""Conversation prefix trie, built by adaptive radix trees over sorted keys.

A turn's id has a fixed width of 16 bytes, big-endian: 96 bits of the SHA-256 of its role
and text, then the bytes of its text as a 32-bit number.  A conversation's key is the
ids of its turns in a row, so a prefix of d turns is a prefix of 16 d bytes, and sorted
keys hold every subtree in one piece.

1. Turns become ids where they lie; only ids move.  Every conversation becomes one row of ids
   and takes its first ones from the base of its family.
2. Keys are dealt by range of (key, conv_id), so a prefix shared by a third of all
   conversations, or one conversation with as many copies, is spread over the ranges.
3. A task walks over its sorted keys in blocks.  Each block becomes one adaptive radix
   tree (nodes of 4, 16, 48 and 256 children, compressed paths).  Only byte depths that
   are whole turns emit nodes.
4. A node that goes beyond its block emits a part.  How many turns a block's first and last
   key share with the neighbours tells which children, leaves and texts are counted
   elsewhere, so parts add up without any list of members.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quillgraph.llm.textkit import partitions
from quillgraph.session import discard, materialise

WIDTH = 16
#: Conversations of a family, and hash values of borrowed turns (0 to 8).
FAMILY, BORROWED = 5, 9
#: Bytes of keys in one block, about.
BLOCK_BYTES = 1 << 20


def turn_id(role: Column, text: Column) -> Column:
    """Id of a turn as 32 hexadecimal digits; null role or text counts as empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    size = F.octet_length(text)
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.concat(F.substring(F.sha2(whole, 256), 1, 24), F.lpad(F.lower(F.hex(size.cast("long"))), 8, "0"))


def borrowed(conv_id: Column) -> Column:
    """How many turns a conversation takes from the base of its family."""
    return F.crc32(conv_id.cast("string").cast("binary")) % BORROWED


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, key): every conversation's key after it took its first turns from its base.

    Turns are ordered by turn, null first; equal turns by their id.  Rows without conv_id belong
    to no conversation and are left out; a repeated row is one more turn.  A conversation is
    one row.  The remainder of a negative conv_id is negative, as in SQL.
    """
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    turns = conversations.filter("conv_id is not null").select(
        base.alias("base"), F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("t"), turn_id(F.col("role"), F.col("text")).alias("id"))
    # Structs sort by their fields, nulls first.
    own = turns.groupBy("base", "conv_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("t", "id"))), lambda x: x["id"]).alias("ids"))
    first = own.filter("conv_id = base").select("base", F.slice("ids", 1, BORROWED - 1).alias("given"))
    h = borrowed(F.col("conv_id")).cast("int")
    given = F.slice(F.coalesce("given", F.array().cast("array<string>")), F.lit(1), h)
    rest = F.slice("ids", h + 1, F.greatest(F.size("ids"), F.lit(1)))
    return own.join(first, "base", "left").select("conv_id", F.unhex(F.array_join(F.concat(given, rest), "")).alias("key"))


class _Leaf:
    """The conversations of one key."""

    __slots__ = ("count", "least", "first", "last")

    def __init__(self, least: int, at: int):
        self.count, self.least, self.first, self.last = 0, least, at, at


class Node:
    """Inner node: a compressed path, perhaps a key that ends here, and children by their next byte.

    Children lie in parallel sorted lists up to 4 and 16 entries, then behind an index of 256
    slots into a list of up to 48, then in a list of 256.
    """

    __slots__ = ("path", "leaf", "kind", "labels", "children")

    def __init__(self, path: bytes):
        self.path, self.leaf, self.kind, self.labels, self.children = path, None, 4, bytearray(), []

    def child(self, byte: int) -> Node | None:
        if self.kind <= 16:
            at = self.labels.find(byte)
            return self.children[at] if at >= 0 else None
        if self.kind == 48:
            at = self.labels[byte]
            return self.children[at - 1] if at else None
        return self.children[byte]

    def put(self, byte: int, node: Node) -> None:
        """Set the child of a byte, growing the layout where it is full."""
        if self.kind <= 16:
            at = self.labels.find(byte)
            if at >= 0:
                self.children[at] = node
                return
            if len(self.children) < self.kind:
                at = sum(x < byte for x in self.labels)
                self.labels.insert(at, byte)
                self.children.insert(at, node)
                return
            if self.kind == 4:
                self.kind = 16
            else:
                index = bytearray(256)
                for i, label in enumerate(self.labels):
                    index[label] = i + 1
                self.kind, self.labels = 48, index
            self.put(byte, node)
        elif self.kind == 48:
            if not self.labels[byte]:
                if len(self.children) == 48:
                    direct = [None] * 256
                    for label, at in enumerate(self.labels):
                        if at:
                            direct[label] = self.children[at - 1]
                    self.kind, self.labels, self.children = 256, bytearray(), direct
                    return self.put(byte, node)
                self.children.append(node)
                self.labels[byte] = len(self.children)
            else:
                self.children[self.labels[byte] - 1] = node
        else:
            self.children[byte] = node

    def items(self) -> list[tuple[int, Node]]:
        """Children with their bytes."""
        if self.kind <= 16:
            return list(zip(self.labels, self.children))
        if self.kind == 48:
            return [(byte, self.children[at - 1]) for byte, at in enumerate(self.labels) if at]
        return [(byte, child) for byte, child in enumerate(self.children) if child is not None]


class RadixTree:
    """Adaptive radix tree over byte keys of any length; equal keys share a leaf."""

    def __init__(self):
        self.root = Node(b"")

    def leaf(self, key: bytes, least: int, at: int) -> _Leaf:
        """The leaf of a key, made where it is new."""
        node, depth, parent = self.root, 0, None
        while True:
            path = node.path
            shared = len(path) if key.startswith(path, depth) else len(os.path.commonprefix([path, key[depth: depth + len(path)]]))
            if shared < len(path):   # the key leaves the compressed path
                upper = Node(path[:shared])
                node.path = path[shared + 1:]
                upper.put(path[shared], node)
                if parent is None:
                    self.root = upper
                else:
                    parent.put(key[depth - 1], upper)
                node = upper
            depth += shared
            if depth == len(key):
                node.leaf = node.leaf or _Leaf(least, at)
                return node.leaf
            following = node.child(key[depth])
            if following is None:
                below = Node(key[depth + 1:])
                below.leaf = _Leaf(least, at)
                node.put(key[depth], below)
                return below.leaf
            parent, node, depth = node, following, depth + 1


_SUMS = ("n_convs", "n_children", "n_leaves", "weight", "texts")
_TYPES = [("block", pa.int32(), "int"), ("part", pa.int32(), "int"), ("node", pa.binary(), "binary"), ("parent", pa.binary(), "binary"),
          ("open", pa.bool_(), "boolean"), ("conv_id", pa.int64(), "bigint"), ("depth", pa.int64(), "bigint"),
          ("parent_conv_id", pa.int64(), "bigint"), *[(n, pa.int64(), "bigint") for n in _SUMS], ("ends", pa.string(), "string")]
_MARK = 16   # bytes of a node's digest
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def _marks(key: bytes, turns: int) -> list[bytes]:
    """Digests of the prefixes of 0 to ``turns`` turns; each follows from the one before."""
    out = [bytes(_MARK)]
    for d in range(turns):
        out.append(hashlib.blake2b(out[-1] + key[d * WIDTH: (d + 1) * WIDTH], digest_size=_MARK).digest())
    return out


def shared_turns(a: bytes, b: bytes) -> int:
    return len(os.path.commonprefix([a, b])) // WIDTH


class _Place:
    """A tree node on the way from byte ``start`` to ``end``, and the sums of what lies below it."""

    __slots__ = ("node", "start", "end", "up", "left", "right", "n", "least", "first", "leaves", "weight", "texts", "fresh", "any", "rows")

    def __init__(self, node: Node, start: int, end: int, up: int | None, left: bool, right: bool):
        self.node, self.start, self.end, self.up, self.left, self.right = node, start, end, up, left, right
        self.n, self.least, self.first, self.leaves, self.weight, self.texts = 0, None, None, 0, 0, 0
        self.fresh, self.any, self.rows = 0, False, []   # children that begin in this block, and whether there are any at all

    def take(self, other: _Place | _Leaf) -> None:
        count = other.count if isinstance(other, _Leaf) else other.n
        self.n += count
        self.least = other.least if self.least is None else min(self.least, other.least)
        self.first = other.first if self.first is None else min(self.first, other.first)


def _places(tree: RadixTree, low: bytes, high: bytes) -> list[_Place]:
    """All tree nodes, every node before those below it; ``left`` and ``right`` mark the ways of the lowest and highest key."""
    out, todo = [], [(tree.root, 0, b"", None, True, True)]
    while todo:
        node, start, label, up, left, right = todo.pop()
        path = label + node.path
        left, right = left and low.startswith(path, start), right and high.startswith(path, start)
        out.append(_Place(node, start, start + len(path), up, left, right))
        at, end = len(out) - 1, start + len(path)
        todo += [(child, end, bytes([byte]), at, left, right) for byte, child in node.items()]
    return out


def block_rows(keys: list[bytes], ids: list[int], before: int, after: int) -> list[tuple]:
    """Trie nodes of one block of sorted (key, id): rows from ``node`` on, as in the table of parts.

    ``before`` and ``after`` are the turns that the first key shares with the key before
    the block and the last with the one behind it, -1 where there is none.  Nodes of the first
    or last key down to these depths are open: their row is a part and has its digest, its
    ends as text.  Other rows are final; the digest of the parent is given if that is open.
    """
    tree, leaf, key = RadixTree(), None, None
    for at, (k, c) in enumerate(zip(keys, ids)):
        if k != key:
            key, leaf = k, tree.leaf(k, c, at)
        leaf.count, leaf.last = leaf.count + 1, at
    left, right = _marks(keys[0], before), _marks(keys[-1], after)
    places = _places(tree, keys[0], keys[-1])

    for place in reversed(places):   # from below
        if place.node.leaf is not None:
            place.take(place.node.leaf)
        sample = keys[place.first]
        least_depth = 0 if place.up is None else place.start // WIDTH + 1
        for d in range(place.end // WIDTH, least_depth - 1, -1):   # only whole turns
            back, on = place.left and d <= before, place.right and d <= after
            size = int.from_bytes(sample[d * WIDTH - 4: d * WIDTH], "big") if d else 0
            place.leaves += not place.any and not on
            place.weight += place.n * size
            place.texts += 0 if back else size
            place.rows.append((d, back, on, place.fresh, place.leaves, place.weight, place.texts))
            place.fresh, place.any = int(not back), True
        if place.up is not None:
            above = places[place.up]
            above.take(place)
            for name in ("leaves", "weight", "texts", "fresh"):
                setattr(above, name, getattr(above, name) + getattr(place, name))
            above.any |= place.any

    out, tops = [], []               # from above, so that parents are known
    for place in places:
        parent = (None, None) if place.up is None else tops[place.up]   # conv_id, digest if open
        for d, back, on, fresh, leaves, weight, texts in reversed(place.rows):
            is_open = back or on
            mark = left[d] if back else right[d] if on else None
            here = place.node.leaf if d * WIDTH == place.end else None
            ends = None if here is None else ",".join(map(str, ids[here.first: here.last + 1]))
            if not is_open:
                ends = _NO_ENDS if ends is None else hashlib.sha256(ends.encode()).hexdigest()
            out.append((mark, parent[1], is_open, place.least, d, parent[0], place.n, fresh, leaves, weight, texts, ends))
            parent = (place.least, mark)
        tops.append(parent)
    return out


def _edges(dealt: DataFrame) -> DataFrame:
    """(block, before, after): turns that a block shares with its neighbours; one row a block, however many keys it has."""
    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[bytes, bytes]] = {}
        for batch in batches:
            for block, key in zip(batch.column("block").to_pylist(), batch.column("key").to_pylist()):
                low, high = found.get(block, (key, key))
                found[block] = (min(low, key), max(high, key))
        yield pa.RecordBatch.from_arrays([
            pa.array(found, pa.int32()), pa.array([v[0] for v in found.values()], pa.binary()),
            pa.array([v[1] for v in found.values()], pa.binary())], names=["block", "low", "high"])

    @F.arrow_udf("int")
    def turns(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([-1 if x is None or y is None else shared_turns(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.int32())

    both = dealt.select("block", "key").mapInArrow(ends, "block int, low binary, high binary").groupBy("block").agg(
        F.min("low").alias("low"), F.max("high").alias("high"))
    order = Window.orderBy("block")
    near = both.select("block", "low", "high", F.lag("high").over(order).alias("_before"), F.lead("low").over(order).alias("_after"))
    return near.select("block", turns("_before", "low").alias("before"), turns("high", "_after").alias("after"))


def _hashed_ends(opened: DataFrame) -> DataFrame:
    """(node, ends_sha256) of open nodes with ends: their texts in order, hashed as they pass by."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        result = lambda: pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([digest.hexdigest()])], names=["node", "ends_sha256"])
        for batch in batches:
            for mark, text in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist()):
                if mark != node:
                    if node is not None:
                        yield result()
                    node, digest = mark, hashlib.sha256(text.encode())
                else:
                    digest.update(b"," + text.encode())
        if node is not None:
            yield result()

    parts = opened.filter("ends is not null").select("node", "block", "part", "ends")
    return parts.repartition(partitions(parts), "node").sortWithinPartitions("node", "block", "part").mapInArrow(
        run, "node binary, ends_sha256 string")


def trie_nodes(keyed: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Nodes of the trie of (conv_id, key): one row for each distinct prefix of whole turns.

    Columns as in ``prefix_nodes``.  Repeated rows are one member each.  Without any row there is no
    node.  The ids of one key's conversations are hashed in ascending order by one task, which holds
    one block of them at a time.
    """
    keyed = materialise(keyed)
    ranges = partitions(keyed)
    dealt = materialise(keyed.repartitionByRange(ranges, "key", "conv_id").withColumn("block", F.spark_partition_id()))
    discard(keyed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, size, block, part, before, edge = [], [], 0, None, 0, -1, -1

        def flush(after: int) -> pa.RecordBatch:
            rows = [(block, part, *r) for r in block_rows(keys, ids, before, after)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t, _) in zip(zip(*rows), _TYPES)], names=[n for n, _, _ in _TYPES])

        for batch in batches:
            for b, k, c, first, last in zip(*(batch.column(n).to_pylist() for n in ("block", "key", "conv_id", "before", "after"))):
                if keys and (b != block or size >= block_bytes):
                    shared = shared_turns(keys[-1], k) if b == block else edge
                    yield flush(shared)
                    part, before = (part + 1, shared) if b == block else (0, first)
                    keys, ids, size = [], [], 0
                elif not keys:
                    before = first
                block, edge = b, last
                keys.append(k)
                ids.append(c)
                size += len(k) + 8
        if keys:
            yield flush(edge)

    sorted_keys = dealt.join(F.broadcast(_edges(dealt)), "block").repartition(ranges, "block").sortWithinPartitions("block", "key", "conv_id")
    parts = materialise(sorted_keys.mapInArrow(run, ", ".join(f"{n} {t}" for n, _, t in _TYPES)))
    discard(dealt)

    opened, final = parts.filter("open"), parts.filter("not open")
    merged = opened.groupBy("node").agg(
        F.min("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"),
        *[F.sum(n).alias(n) for n in _SUMS]).join(_hashed_ends(opened), "node", "left")
    merged = materialise(merged.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NO_ENDS))))
    saved = (F.col("weight") - F.col("texts")).alias("saved_tokens")
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves")

    names = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    top = merged.join(names, "parent", "left").select(*columns, saved, "ends_sha256")
    # The children of an open node find its name in their own block, so that none gathers all of them.
    own = opened.select("block", "part", "node").join(merged.select("node", F.col("conv_id").alias("_name")), "node").withColumnRenamed("node", "parent")
    below = final.filter("parent is not null").join(own, ["block", "part", "parent"]).withColumn("parent_conv_id", F.col("_name"))
    rest = final.filter("parent is null")
    last = [F.col("ends").alias("ends_sha256")]
    return top.unionByName(below.select(*columns, saved, *last)).unionByName(rest.select(*columns, saved, *last))


def prefix_nodes(conversations: DataFrame) -> DataFrame:
    """The prefix trie of the rebuilt conversations, one row per node.

    conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children,
    n_leaves, saved_tokens (bytes of texts that members share with another, over the subtree) and
    ends_sha256.  Odd rows as in ``rebuilt``; other columns than conv_id, turn, role and text are left out.
    """
    return trie_nodes(rebuilt(conversations))
