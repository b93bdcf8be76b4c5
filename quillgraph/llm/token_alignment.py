"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how often.

Tokenizer A is a byte-level vocabulary file of the tokenizers library, B a sentencepiece model
with byte fallback; both see the text behind one space.  Two token occurrences whose
byte ranges overlap are a link.

1. A task encodes its documents, links their tokens, and holds the links of a block of
   documents as inverted pair bitmaps: for every id pair one compressed bitmap per
   multiplicity plane.  Plane k has the documents in which bit k of the pair's number of links
   is set.  A plane is a sorted list of 16-bit places or a bitmap, whichever is smaller.
2. Blocks hold different documents, so the OR of a pair's bitmaps over all blocks is their
   union and its popcount the sum of theirs: what moves to a pair is one small row a block,
   however many documents hold it.  Popcounts weighted by 2**k give the number of links.
3. Postings return scores: a pair's count, and whether no other pair of its B id has
   more, go back with its bitmaps to the blocks, where they are added up per document.

Texts are read once; only bitmaps move.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillgraph.llm.blocks import BLOCK_DOCS, block_numbers, closed, pack, unpack
from quillgraph.llm.bpe import PRE_TOKEN, _letters as byte_letters
from quillgraph.llm.textkit import as_bytes, slices, spread
from quillgraph.session import materialise

#: Links that a task holds before it closes a block, about.
BLOCK_LINKS = 1 << 22
#: Bits of an id of B inside a pair.
ID_BITS = 24

#: Fixed value: the piece model's sign for a space.
SPACE_SIGN = "▁"


class Tokenizers:
    """Both tokenizers, and the bytes of every id."""

    def __init__(self, content_a: bytes, content_b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"   # one core per task
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(content_a.decode("utf-8"))
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        letters = byte_letters()
        entries = self.a.get_vocab(with_added_tokens=True)
        raw = lambda token: bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.bytes_a = self._table({i: raw(t) for t, i in entries.items()})
        self.ranked = self._ranked(json.loads(content_a), letters)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=content_b)
        pieces = {}
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            pieces[i] = bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(SPACE_SIGN, " ").encode()
        self.bytes_b = self._table(pieces)
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        if max(len(self.bytes_a), len(self.bytes_b)) > 1 << (ID_BITS - 1):
            raise ValueError(f"a vocabulary has more than {1 << (ID_BITS - 1)} entries")
        # How an id reads at the start of a group and inside it.
        self.texts = [s + str(i).encode() for t, signs in ((self.bytes_a, (b";", b",")), (self.bytes_b, (b"|", b",")))
                      for s in signs for i in range(len(t))]

    @staticmethod
    def _table(entries: dict[int, bytes]) -> list[bytes]:
        out = [b""] * (max(entries) + 1)
        for i, token in entries.items():
            out[i] = token
        return out

    @staticmethod
    def _ranked(spec: dict, letters: dict[str, int]):
        """The same vocabulary as an encoder by ranks, several times faster, or None.

        It gives equal ids where a pair's rank is the id that it makes: plain byte-level
        words, no normalisation, and the k-th merge makes the k-th entry after the bytes.
        """
        import tiktoken

        model, cut = spec["model"], spec.get("pre_tokenizer") or {}
        added = {t["content"] for t in spec["added_tokens"]}
        tokens = {t: i for t, i in model["vocab"].items() if t not in added}
        pairs = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        plain = (spec.get("normalizer") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True)
                 and not cut.get("add_prefix_space") and not model.get("ignore_merges"))
        if not plain or any(c not in letters for t in tokens for c in t):
            return None
        if sorted(tokens.values()) != list(range(len(tokens))) or any(tokens.get(p) != 256 + k for k, p in enumerate(pairs)):
            return None
        ranks = {bytes(letters[c] for c in t): i for t, i in tokens.items()}
        return tiktoken.Encoding("a", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[bytes | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of every text; none where the text is empty or its bytes do not come back."""
        plain = [t.decode("utf-8", "replace") if t else "" for t in texts]
        if self.ranked is not None:
            a = [self.ranked.encode_ordinary(" " + t) for t in plain]
        else:
            a = [e.ids for e in self.a.encode_batch([" " + t for t in plain], add_special_tokens=False)]
        b = self.b.encode(plain, num_threads=1)
        none = np.zeros(0, np.int32)
        for i, text in enumerate(texts):
            whole = b" " + text if text else None
            same = whole is not None and self._joined(self.bytes_a, a[i]) == whole == self._joined(self.bytes_b, b[i])
            a[i], b[i] = (np.array(a[i], np.int32), np.array(b[i], np.int32)) if same else (none, none)
        return a, b

    @staticmethod
    def _joined(table: list[bytes], ids: list[int]) -> bytes:
        return b"".join(map(table.__getitem__, ids))


@lru_cache(maxsize=1)
def _tokenizers(content_a: bytes, content_b: bytes) -> Tokenizers:
    return Tokenizers(content_a, content_b)


class Aligned:
    """Groups and links of a list of texts."""

    def __init__(self, both: Tokenizers, texts: list[bytes | None]):
        a, b = both.encode(texts)
        self.both = both
        self.n_a, self.n_b = (np.array([len(x) for x in side], np.int64) for side in (a, b))
        self.ids_a, self.ids_b = (np.concatenate(side).astype(np.int64) for side in (a, b))
        # Both sides cover the same bytes of every text, so ends in the joined texts can be compared.
        self.ends_a, self.ends_b = np.cumsum(both.sizes_a[self.ids_a]), np.cumsum(both.sizes_b[self.ids_b])
        self.tops = np.concatenate([[0], self.ends_a])[np.cumsum(self.n_a)]   # byte where each text ends
        ends = np.concatenate([self.ends_a, self.ends_b])
        ends.sort(kind="stable")   # two sorted runs
        twice = np.concatenate([ends[1:] == ends[:-1], [False]])[: len(ends)]
        self.cuts, ends = ends[twice], ends[~twice]   # an overlap is what lies between two neighbouring ends
        self.link_a = self.ids_a[np.searchsorted(self.ends_a, ends)]
        self.link_b = self.ids_b[np.searchsorted(self.ends_b, ends)]
        self.n_groups = np.diff(np.searchsorted(self.cuts, self.tops, side="right"), prepend=0)
        self.n_links = np.diff(np.searchsorted(ends, self.tops, side="right"), prepend=0)

    def groups(self) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3``: the ids of each group, for every text."""
        group_a, group_b = np.searchsorted(self.cuts, self.ends_a), np.searchsorted(self.cuts, self.ends_b)
        before_b = np.searchsorted(group_b, group_a)                 # B tokens of earlier groups
        before_a = np.searchsorted(group_a, group_b, side="right")   # A tokens up to this group
        later = lambda g: np.diff(g, prepend=-1) == 0                # not the first of its side in the group
        size_a, size_b = len(self.both.bytes_a), len(self.both.bytes_b)
        code = np.empty(len(group_a) + len(group_b), np.int64)
        code[np.arange(len(group_a)) + before_b] = self.ids_a + later(group_a) * size_a
        code[np.arange(len(group_b)) + before_a] = self.ids_b + later(group_b) * size_b + 2 * size_a
        parts = list(map(self.both.texts.__getitem__, code.tolist()))
        stops = np.cumsum(self.n_a + self.n_b).tolist()
        return [b"".join(parts[i:j])[1:] for i, j in zip([0, *stops], stops)]


def planes(pair: np.ndarray, slot: np.ndarray, width: int) -> pa.RecordBatch:
    """Bitmaps of the links (pair, place of the document): rows pair, plane, n, fresh, bits.

    ``n`` is the popcount of the plane, ``fresh`` that of its documents which no lower plane
    has, so that the sum over the planes is the number of documents.
    """
    key = np.sort((pair << 16) | slot)
    first = np.flatnonzero(np.diff(key, prepend=-1))
    times = np.diff(np.append(first, len(key)))
    pair, slot = key[first] >> 16, (key[first] & 0xFFFF).astype("<u2")
    low = times & -times
    columns = [[], [], [], [], []]
    for plane in range(int(times.max()).bit_length() if len(times) else 0):
        at = np.flatnonzero(times >> plane & 1)
        own, begin = np.unique(pair[at], return_index=True)
        n = np.diff(np.append(begin, len(at)))
        bits = pack(slot[at], n)
        if (dense := 2 * n >= width).any():   # a bitmap of all places is smaller than their list
            cells = bits.to_pylist()
            for i in np.flatnonzero(dense):
                map_ = np.zeros(8 * width, np.uint8)
                map_[slot[at[begin[i]: begin[i] + n[i]]]] = 1
                cells[i] = np.packbits(map_, bitorder="little").tobytes()
            bits = pa.array(cells, pa.binary())
        fresh = np.add.reduceat((low[at] == 1 << plane).astype(np.int64), begin)
        for column, values in zip(columns, (own, np.full(len(own), plane, np.int32), n, fresh, bits)):
            column.append(values)
    joined = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns[:4]]
    return pa.RecordBatch.from_arrays([
        pa.array(joined[0], pa.int64()), pa.array(joined[1], pa.int32()), pa.array(joined[2], pa.int64()), pa.array(joined[3], pa.int64()),
        pa.concat_arrays(columns[4]) if columns[4] else pa.array([], pa.binary())], names=["pair", "plane", "n", "fresh", "bits"])


_ROWS = [("block", pa.int64(), "bigint"), ("slot", pa.int32(), "int"), ("doc_id", pa.int64(), "bigint"),
         ("n_a", pa.int64(), "bigint"), ("n_b", pa.int64(), "bigint"), ("n_groups", pa.int64(), "bigint"), ("n_links", pa.int64(), "bigint"),
         ("groups", pa.string(), "string"), ("width", pa.int32(), "int"), ("pair", pa.int64(), "bigint"), ("plane", pa.int32(), "int"),
         ("n", pa.int64(), "bigint"), ("fresh", pa.int64(), "bigint"), ("bits", pa.binary(), "binary")]
_TEXT, _SHA = "text", "sha256"
ROWS_OUT = 1 << 15


def _rows(count: int, **columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [columns[n] if n in columns else pa.nulls(count, t) for n, t, _ in _ROWS], names=[n for n, _, _ in _ROWS])


def postings(docs: DataFrame, path_a: str, path_b: str, groups: str = _TEXT, block_links: int = BLOCK_LINKS) -> DataFrame:
    """Documents (slot is given) and inverted pair bitmaps (pair is given) of every block.

    ``groups`` of a document is the text of its groups, or with "sha256" the hash of that
    text (empty where there are no tokens).  Reads ``doc_id`` and ``text`` only.
    """
    contents = []
    for path in (path_a, path_b):   # vocabulary files: their size does not depend on the data
        with open(path, "rb") as file:
            contents.append(file.read())
    shared = docs.sparkSession.sparkContext.broadcast(contents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, numbers = _tokenizers(*shared.value), block_numbers()
        block, used, links, held = next(numbers), 0, 0, []

        def close() -> Iterator[pa.RecordBatch]:
            width = -(-used // 8)
            found = planes(*(np.concatenate(x) for x in zip(*held)), width)
            for at in range(0, found.num_rows, ROWS_OUT):
                part = found.slice(at, ROWS_OUT)
                yield _rows(part.num_rows, block=pa.array(np.full(part.num_rows, block)), width=pa.array(np.full(part.num_rows, width, np.int32)),
                            **{n: part.column(n) for n in part.schema.names})

        for batch in batches:
            texts, ids = as_bytes(batch.column("text")), batch.column("doc_id")
            for cut in slices(texts):
                found = Aligned(both, texts[cut])
                count = len(found.n_a)
                if used + count > BLOCK_DOCS or links >= block_links:
                    yield from close()
                    block, used, links, held = next(numbers), 0, 0, []
                owner = np.repeat(np.arange(count), found.n_links)
                held.append(((found.link_a << ID_BITS) | found.link_b, owner + used))
                text = [g if groups == _TEXT else hashlib.sha256(g).hexdigest() if g else "" for g in found.groups()]
                yield _rows(
                    count, block=pa.array(np.full(count, block)), slot=pa.array(np.arange(used, used + count), pa.int32()),
                    doc_id=ids.slice(cut.start, count).cast(pa.int64()), groups=pa.array(text, pa.string()),
                    **{n: pa.array(getattr(found, n)) for n in ("n_a", "n_b", "n_groups", "n_links")})
                used += count
                links += len(found.link_a)
        if held:
            yield from close()

    return spread(docs.select("doc_id", "text")).mapInArrow(run, ", ".join(f"{n} {t}" for n, _, t in _ROWS))


def pair_table(found: DataFrame) -> DataFrame:
    """(pair, id_a, id_b, n_docs, n_links, best) of all postings; best: no pair of this id_b has more links.

    The table has at most one row for each pair of vocabulary entries; the highest counts are
    one number for each id of B, which is the size of a vocabulary and is broadcast.
    """
    counts = found.filter("pair is not null").groupBy("pair").agg(
        F.sum("fresh").alias("n_docs"), F.sum(F.expr("shiftleft(n, plane)")).alias("n_links")).select(
        "pair", F.shiftright("pair", ID_BITS).alias("id_a"), F.col("pair").bitwiseAND(F.lit((1 << ID_BITS) - 1)).alias("id_b"), "n_docs", "n_links")
    counts = materialise(counts)
    highest = counts.groupBy("id_b").agg(F.max("n_links").alias("_most"))
    return counts.join(F.broadcast(highest), "id_b").select(
        "pair", "id_a", "id_b", "n_docs", "n_links", (F.col("n_links") == F.col("_most")).alias("best"))


def _add(sums: dict[str, np.ndarray], part: pa.RecordBatch) -> None:
    n, plane, count = (part.column(c).to_numpy() for c in ("n", "plane", "count"))
    best, width = part.column("best").to_numpy(zero_copy_only=False), part.column("width").to_numpy()
    dense = 2 * n >= width
    if not dense.all():
        few = pa.array(~dense)
        slots, sizes = unpack(part.column("bits").filter(few), "<u2")
        _score(sums, slots, *(np.repeat(x[~dense], sizes) for x in (plane, count, best)))
    for i in np.flatnonzero(dense):
        bits = np.unpackbits(np.frombuffer(part.column("bits")[int(i)].as_buffer(), np.uint8), bitorder="little")
        _score(sums, np.flatnonzero(bits), plane[i], count[i], best[i])


def _score(sums: dict[str, np.ndarray], slots: np.ndarray, plane: np.ndarray, count: np.ndarray, best: np.ndarray) -> None:
    times = np.left_shift(1, plane).astype(np.int64)
    np.add.at(sums["count_sum"], slots, times * count)
    np.add.at(sums["n_best"], slots, times * best)


_RESULT = pa.schema([("doc_id", pa.int64()), *[(n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], ("groups", pa.string())])


def align(docs: DataFrame, path_a: str, path_b: str, groups: str = _TEXT, block_links: int = BLOCK_LINKS) -> DataFrame:
    """Alignment of every document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    n_best counts the links whose pair has the most links of its B id in all documents, ties
    included; count_sum adds up the counts of the pairs of all links.  Null and empty texts, and texts
    whose bytes a tokenizer does not give back, have no tokens: zeros and empty groups.
    Repeated rows are documents of their own and count each; every row gives one.  Other
    columns are left out.  Very long texts are encoded whole, in a block of their own size.
    """
    found = materialise(postings(docs, path_a, path_b, groups, block_links))
    pairs = pair_table(found).select("pair", F.col("n_links").alias("count"), "best")
    scored = found.filter("pair is not null").select("block", "pair", "plane", "n", "width", "bits").join(
        pairs.hint("merge"), "pair").drop("pair")   # the pairs of all documents have no size that could be broadcast
    parts = found.filter("slot is not null").select(
        "block", "slot", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups").unionByName(scored, allowMissingColumns=True)

    def finish(mine: pa.RecordBatch, sums: dict[str, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array(sums[f.name]) if f.name in sums else mine.column(f.name).cast(f.type) for f in _RESULT], schema=_RESULT)

    return closed(parts, {"n_best": np.int64, "count_sum": np.int64}, _add, finish,
                  "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups string")
