"""Class-based n-gram language model with exchange clustering of words.

P(w | before) = L * P(class of w | the two classes before) * P(w | class of w) + (1 - L) * P(w)

1. Every distinct word of the training texts is counted (a table that grows with the corpus).
2. Words form units: the end of a text, each of the ``FREQUENT`` most frequent words, and all other
   words by their last three bytes.  So every word has a class, seen or not, and a task can
   hold the classes of all units.
3. Exchange clustering on the likelihood of the class bigrams.  The ``CORE`` most frequent
   units are exchanged one by one over the table of their bigrams, whose size is fixed.
   Then every unit looks at its counts next to each class over the whole corpus and goes to the class
   where they add most; half of the units move at a time, on all executors at once.
4. Class trigrams are counted over the whole corpus and smoothed towards bigrams and
   unigrams.  A word's emission is its count less an absolute discount; what the discount
   takes from the words of a class is the emission of its unknown words.
5. Scoring: a task scores what it knows (ends and frequent words); occurrences of other words
   go, one row per word and block of documents, to the word's count and come back as sums.

Tables that every task holds have fixed sizes: ``FREQUENT`` words, the class of each unit, class trigrams.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quillgraph.llm.blocks import BLOCK_DOCS, block_numbers, closed, pack, unpack
from quillgraph.llm.sketches import SEGMENT, by_segment, gather, merged, pack_offsets, unpack_offsets
from quillgraph.llm.textkit import Words, as_bytes, mix, slices, spread
from quillgraph.session import discard, materialise

FOLDS, HELD_OUT = 7, 2
CLASSES = 64               # class 0 is the end of a text
FREQUENT = 1 << 16         # words that are units of their own
ENDINGS = 1 << 14          # units of all other words
CORE = 1 << 10             # units that are exchanged one by one
SWEEPS = 12                # over the core, at most
ROUNDS = 3                 # over all units: the first places those outside the core
MIX = 0.95                 # weight of the class model
PRIOR = 16.0               # counts that the lower order is worth
FLUSH = 1 << 22            # tokens that a task holds
SEED = 61

UNITS = 1 + FREQUENT + ENDINGS
NONE = 255                 # class of a unit that has none yet
_U = np.uint64
#: Stands for the end of a text among the hashes of words.
END = 0x0E4D_0F7E_9715_0001


def held_out(doc_id: Column) -> Column:
    """Whether the text is kept from training; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def _endings(words: Words) -> np.ndarray:
    """Number of the ending (last three bytes at most) of every word."""
    data, out = words.data, np.zeros(len(words), dtype=_U)
    for back in (1, 2, 3):
        at = words.ends - back
        out = (out << _U(8)) | np.where(at >= words.starts, data[np.maximum(at, 0)], 0).astype(_U)
    return (mix(out + _U(SEED)) % _U(ENDINGS)).astype(np.int64)


class Tokens(NamedTuple):
    """Tokens of a list of texts: every word, and an end after each text."""

    hashes: np.ndarray
    endings: np.ndarray   # -1 for an end
    owner: np.ndarray


def tokens(texts: list[bytes | None]) -> Tokens:
    words = Words(texts, lower=True)
    owner = words.owners()
    size = len(words) + len(texts)
    hashes, endings, owners = np.full(size, END, dtype=_U), np.full(size, -1), np.empty(size, np.int64)
    at = np.arange(len(words)) + owner
    hashes[at], endings[at], owners[at] = words.hashes(SEED), _endings(words), owner
    owners[words.bounds[1:] + np.arange(len(texts))] = np.arange(len(texts))
    return Tokens(hashes, endings, owners)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, ending, n): how often each word, and the end, occurs in the texts; a word is 64 bits of hash."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def sent() -> pa.RecordBatch:
            hashes, endings = (np.concatenate(x) for x in zip(*held))
            found, at, n = np.unique(hashes, return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(found.view(np.int64)), pa.array(endings[at].astype(np.int32)), pa.array(n)], names=["word", "ending", "n"])

        for batch in batches:
            texts = as_bytes(batch.column("text"))
            for cut in slices(texts):
                held.append(tokens(texts[cut])[:2])
                total += len(held[-1][0])
                if total >= FLUSH:
                    yield from _small(sent())
                    held, total = [], 0
        if total:
            yield from _small(sent())

    return docs.select("text").mapInArrow(count, "word bigint, ending int, n bigint").groupBy("word").agg(
        F.max("ending").alias("ending"), F.sum("n").alias("n"))


def _small(batch: pa.RecordBatch, rows: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


class Frequent(NamedTuple):
    """The most frequent words: sorted hashes, and the unit and count of each."""

    hashes: np.ndarray
    unit: np.ndarray
    n: np.ndarray


def frequent_words(counts: DataFrame) -> Frequent:
    rows = counts.filter(F.col("ending") >= 0).orderBy(F.desc("n"), "word").limit(FREQUENT).select("word", "n").toArrow()
    words = rows.column("word").to_numpy().view(_U)
    order = np.argsort(words)
    return Frequent(words[order], (1 + np.arange(len(words)))[order], rows.column("n").to_numpy()[order])


def _units(found: Tokens, frequent: Frequent) -> tuple[np.ndarray, np.ndarray]:
    """Unit of every token, and its place among the frequent words (-1 if it is none)."""
    unit = np.where(found.endings < 0, 0, 1 + FREQUENT + found.endings)
    place = np.full(len(unit), -1)
    if len(frequent.hashes):
        at = np.minimum(np.searchsorted(frequent.hashes, found.hashes), len(frequent.hashes) - 1)
        hit = (frequent.hashes[at] == found.hashes) & (found.endings >= 0)
        place[hit] = at[hit]
        unit[hit] = frequent.unit[at[hit]]
    return unit, place


def _sums(docs: DataFrame, cells: int, places: Callable[[list[bytes | None]], np.ndarray]) -> DataFrame:
    """(segment, bits): how often each cell is named, over the texts; int64 counts by segment of ``SEGMENT`` cells."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(cells, np.int64), [], 0
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            for cut in slices(texts):
                held.append(places(texts[cut]))
                size += len(held[-1])
                if size >= FLUSH:
                    total += np.bincount(np.concatenate(held), minlength=cells)
                    held, size = [], 0
        if size:
            total += np.bincount(np.concatenate(held), minlength=cells)
        at = np.flatnonzero(total)
        rows = [(s, pack_offsets(o), _narrow(n)) for s, o, n in by_segment(at, total[at])]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))],
                                             names=["segment", "at", "n"])

    def add(sums: np.ndarray, piece: dict) -> None:
        sums[unpack_offsets(piece["at"])] += _wide(piece["n"])

    parts = docs.select("text").mapInArrow(count, "segment int, at binary, n binary")
    return merged(parts, np.int64, add, lambda sums: sums.astype("<i8").tobytes())


def _narrow(n: np.ndarray) -> bytes:
    """Counts as planes of bytes, low bytes first, which compresses well."""
    return n.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _wide(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, np.uint8).reshape(8, -1).T.copy().view("<i8").ravel()


def _whole(segments: DataFrame, cells: int) -> np.ndarray:
    """All cells, their number fixed by the caller, on the driver."""
    return np.frombuffer(gather(segments, -(-cells // SEGMENT), 8 * SEGMENT), "<i8")[:cells]


def _phi(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange_core(pairs: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Classes of the core units from their bigram counts, unit 0 (the end) alone in class 0.

    Each unit in turn leaves its class and enters the one that raises the likelihood of
    the class bigrams most; of equals the lowest.  Ends when a sweep moves no unit.
    """
    size, pairs = len(pairs), pairs.astype(float)
    own = np.where(np.arange(size) == 0, 0, 1 + (np.arange(size) - 1) % (classes - 1))
    at = np.eye(classes)[own]
    right, left = pairs @ at, pairs.T @ at          # counts before and behind each class
    table = at.T @ right
    for _ in range(sweeps):
        moved = 0
        for w in range(1, size):
            r, l, twice, old = right[w].copy(), left[w].copy(), pairs[w, w], own[w]
            if r.sum() + l.sum() == 0:
                continue
            r[old] -= twice                          # bigrams of the unit with itself stay aside
            l[old] -= twice
            table[old] -= r
            table[:, old] -= l
            table[old, old] -= twice
            rows, columns = table.sum(1), table.sum(0)
            gain = (_phi(table + r).sum(1) - _phi(table).sum(1) + _phi(table + l[:, None]).sum(0) - _phi(table).sum(0)
                    - _phi(rows + r.sum() + twice) + _phi(rows) - _phi(columns + l.sum() + twice) + _phi(columns))
            diagonal = np.diag(table)
            gain += (_phi(diagonal + r + l + twice) - _phi(diagonal + r) - _phi(diagonal + l) + _phi(diagonal))
            new = 1 + int(np.argmax(gain[1:]))
            table[new] += r
            table[:, new] += l
            table[new, new] += twice
            if new != old:
                moved += 1
                own[w] = new
                right[:, old] -= pairs[:, w]
                right[:, new] += pairs[:, w]
                left[:, old] -= pairs[w]
                left[:, new] += pairs[w]
        if not moved:
            break
    return own


def best_classes(right: np.ndarray, left: np.ndarray, own: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The class where each unit's counts add most to the likelihood, all others staying where they are.

    ``right[u, c]`` and ``left[u, c]`` count what follows and what comes before a unit by class; ``own`` is its class
    now (``NONE``: not placed yet), ``table`` the counts of class bigrams.  Class 0 is never entered.
    """
    rows, columns = table.sum(1), table.sum(0)
    base_right, base_left = _phi(table).sum(1), _phi(table).sum(0)
    out = own.copy()
    for u in range(len(own)):
        r, l = right[u], left[u]
        n_r, n_l = r.sum(), l.sum()
        if n_r + n_l == 0:
            continue
        follow, come = np.flatnonzero(r), np.flatnonzero(l)
        some_right, some_left = table[:, follow], table[come]
        gain = ((_phi(some_right + r[follow]) - _phi(some_right)).sum(1) + (_phi(some_left + l[come][:, None]) - _phi(some_left)).sum(0)
                - _phi(rows + n_r) + _phi(rows) - _phi(columns + n_l) + _phi(columns))
        k = own[u]
        if k != NONE:   # in its own class the unit is already counted
            gain[k] = (base_right[k] - _phi(np.maximum(table[k] - r, 0)).sum() + base_left[k] - _phi(np.maximum(table[:, k] - l, 0)).sum()
                       - _phi(rows[k]) + _phi(np.maximum(rows[k] - n_r, 0)) - _phi(columns[k]) + _phi(np.maximum(columns[k] - n_l, 0)))
        out[u] = 1 + int(np.argmax(gain[1:]))
    return out


def _exchange(docs: DataFrame, frequent: Frequent, classes: np.ndarray, number: int) -> np.ndarray:
    """One round over all units: their counts by class over the corpus, then the best class of each."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((frequent, classes))
    per_unit = 2 * CLASSES

    def places(texts: list[bytes | None]) -> np.ndarray:
        frequent, classes = shared.value
        unit, _ = _units(tokens(texts), frequent)
        own = classes[unit].astype(np.int64)
        before, after = np.concatenate([[0], unit[:-1]]), unit        # what comes before the first token is an end
        class_before, class_after = np.concatenate([[0], own[:-1]]), own
        right, left = class_after != NONE, class_before != NONE
        return np.concatenate([before[right] * per_unit + class_after[right], after[left] * per_unit + CLASSES + class_before[left]])

    cells = UNITS * per_unit
    found = materialise(_sums(docs, cells, places))
    units = SEGMENT // per_unit

    def split(segment: int, bits: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = np.full(units, NONE, np.uint8)
        part = shared.value[1][segment * units: (segment + 1) * units]
        own[: len(part)] = part
        counts = np.frombuffer(bits, "<i8").reshape(units, 2, CLASSES).astype(float)
        return counts[:, 0], counts[:, 1], own

    def bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((CLASSES, CLASSES))
        for batch in batches:
            for segment, bits in zip(batch.column("segment").to_pylist(), batch.column("bits").to_pylist()):
                right, _, own = split(segment, bits)
                np.add.at(table, own[own != NONE], right[own != NONE])
        yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()], pa.binary())], names=["bits"])

    tables = found.mapInArrow(bigrams, "bits binary").toArrow().column("bits").to_pylist()
    table = sum((np.frombuffer(t).reshape(CLASSES, CLASSES) for t in tables), np.zeros((CLASSES, CLASSES)))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment, bits in zip(batch.column("segment").to_pylist(), batch.column("bits").to_pylist()):
                right, left, own = split(segment, bits)
                turn = (np.arange(units) + number) % 2 == 0
                chosen = best_classes(right, left, own, table)
                new = np.where((own == NONE) | turn, chosen, own)
                new = np.where(own == 0, 0, new).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([new.tobytes()], pa.binary())], names=["segment", "bits"])

    count = -(-cells // SEGMENT)
    packed = found.mapInArrow(choose, "segment int, bits binary").toArrow()
    out = np.full(count * units, NONE, np.uint8)
    for segment, bits in zip(packed.column("segment").to_pylist(), packed.column("bits").to_pylist()):
        out[segment * units: (segment + 1) * units] = np.frombuffer(bits, np.uint8)
    discard(found)
    shared.destroy()
    return np.where(out[:UNITS] == NONE, classes, out[:UNITS]).astype(np.uint8)


class Model(NamedTuple):
    """Classes and probabilities; ``counts`` is the table of all words and stays on the cluster."""

    counts: DataFrame
    frequent: Frequent
    classes: np.ndarray       # of each unit; units without any context are in class 1
    transitions: np.ndarray   # P(c | the two classes before), by before, before, c
    sizes: np.ndarray         # tokens of each class
    unknown: np.ndarray       # emission of unknown words of each class
    discount: float
    total: int
    distinct: int
    ends: int


def _transitions(counts: np.ndarray) -> np.ndarray:
    """Smoothed P(c3 | c1, c2) from the counts of class trigrams."""
    two, one = counts.sum(0), counts.sum((0, 1))
    single = (one + PRIOR / len(one)) / (one.sum() + PRIOR)
    double = (two + PRIOR * single) / (two.sum(1, keepdims=True) + PRIOR)
    return (counts + PRIOR * double) / (counts.sum(2, keepdims=True) + PRIOR)


def _classes_before(own: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the two tokens before each token; before a text there are ends only."""
    first = np.concatenate([[0], own[:-1]])
    second = np.concatenate([[0], first[:-1]])
    second[np.flatnonzero(np.diff(owner, prepend=-1))] = 0
    return second, first


def fit(docs: DataFrame) -> Model:
    """Learn from all texts of ``docs`` (null counts as empty; repeated rows are texts of their own)."""
    docs = spread(docs.select("text"))
    counts = materialise(word_counts(docs))
    frequent = frequent_words(counts)
    least = int(frequent.n.min()) if len(frequent.n) else 0
    last = frequent.hashes.view(np.int64)[frequent.n == least].max() if len(frequent.n) else 0
    word = F.col("ending") >= 0
    once = counts.agg(
        F.sum("n").alias("total"), F.count("*").alias("distinct"), F.count_if(word & (F.col("n") == 1)).alias("one"),
        F.count_if(word & (F.col("n") == 2)).alias("two"), F.sum(F.when(~word, F.col("n"))).alias("ends")).first()
    discount = once["one"] / (once["one"] + 2 * once["two"]) if once["one"] and once["two"] else 0.5
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def core_pairs(texts: list[bytes | None]) -> np.ndarray:
        unit, _ = _units(tokens(texts), shared.value)
        before = np.concatenate([[0], unit[:-1]])
        near = (before < CORE) & (unit < CORE)
        return before[near] * CORE + unit[near]

    classes = np.full(UNITS, NONE, np.uint8)
    classes[:CORE] = exchange_core(_whole(_sums(docs, CORE * CORE, core_pairs), CORE * CORE).reshape(CORE, CORE), CLASSES)
    for number in range(ROUNDS):
        classes = _exchange(docs, frequent, classes, number)
    classes = np.where(classes == NONE, 1, classes).astype(np.uint8)
    placed = docs.sparkSession.sparkContext.broadcast(classes)

    def trigrams(texts: list[bytes | None]) -> np.ndarray:
        found = tokens(texts)
        own = placed.value[_units(found, shared.value)[0]].astype(np.int64)
        second, first = _classes_before(own, found.owner)
        return (second * CLASSES + first) * CLASSES + own

    three = _whole(_sums(docs, CLASSES ** 3, trigrams), CLASSES ** 3).reshape((CLASSES,) * 3).astype(float)
    placed.destroy()
    shared.destroy()

    # Distinct words of each class: those of an ending are the words that are not frequent.
    ranked = (F.col("n") > least) | ((F.col("n") == least) & (F.col("word") <= int(last)))
    rare = counts.filter(word & ~ranked).groupBy("ending").agg(F.count("*").alias("n")).toArrow()
    words = np.bincount(classes[frequent.unit], minlength=CLASSES).astype(float)
    np.add.at(words, classes[1 + FREQUENT + rare.column("ending").to_numpy()], rare.column("n").to_numpy())
    sizes = three.sum((0, 1))
    unknown = np.where(sizes > 0, discount * words / np.maximum(sizes, 1), 1.0)
    return Model(counts, frequent, classes, _transitions(three), sizes, unknown, discount,
                 int(once["total"] or 0), int(once["distinct"]), int(once["ends"] or 0))


_ROWS = [("block", pa.int64(), "bigint"), ("slot", pa.int32(), "int"), ("doc_id", pa.int64(), "bigint"), ("held_out", pa.bool_(), "boolean"),
         ("n_tokens", pa.int64(), "bigint"), ("n_known", pa.int64(), "bigint"), ("base_score", pa.float64(), "double"), ("score", pa.float64(), "double"),
         ("word", pa.int64(), "bigint"), ("class", pa.int32(), "int"), ("slots", pa.binary(), "binary"), ("before", pa.binary(), "binary")]
_SENT = [("block", pa.int64(), "bigint"), ("slots", pa.binary(), "binary"), ("sums", pa.binary(), "binary")]


def _rows(count: int, **columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [columns[n] if n in columns else pa.nulls(count, t) for n, t, _ in _ROWS], names=[n for n, _, _ in _ROWS])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Score every text: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words (A-Z in lower case) and one end; null and empty texts are an end alone.
    ``base_score`` is the add-one unigram model, ``score`` the class model, both log10 of
    the whole text's probability.  Unknown words are one event of each class.  Repeated rows and
    equal texts score alike; a null doc_id stays null.  Without training texts nothing is known,
    and every token of the base has probability 1.  Other columns are left out.
    """
    spark = docs.sparkSession
    total, distinct = model.total, model.distinct
    floor = total + distinct + 1
    light = model._replace(counts=None)
    shared = spark.sparkContext.broadcast(light)

    def known(m: Model, n: np.ndarray, own: np.ndarray, way: np.ndarray) -> np.ndarray:
        """Probability of tokens of count n (0: unknown) and class own after transition probability ``way``."""
        size = np.maximum(m.sizes[own], 1)
        given = np.where(n > 0, np.where(own == 0, 1.0, (n - m.discount) / size), m.unknown[own])
        alone = np.where(n > 0, (n + 1) / floor, 1 / (floor * CLASSES))
        return MIX * way * given + (1 - MIX) * alone

    def first_look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, numbers = shared.value, block_numbers()
        block, used, size, held = next(numbers), 0, 0, []

        def close() -> Iterator[pa.RecordBatch]:
            word, own, slot, before = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((slot, word))
            word, own, slot, before = word[order], own[order], slot[order], before[order]
            begin = np.flatnonzero(np.diff(word, prepend=word[0] + 1 if len(word) else 0))
            n = np.diff(np.append(begin, len(word)))
            step = 1 << 15
            for at in range(0, len(begin), step):
                some, counts = begin[at: at + step], n[at: at + step]
                a, b = int(some[0]), int(some[-1] + counts[-1])
                yield _rows(len(some), block=pa.array(np.full(len(some), block)), word=pa.array(word[some]), **{"class": pa.array(own[some].astype(np.int32))},
                            slots=pack(slot[a:b].astype("<u2"), counts), before=pack(before[a:b].astype("<u2"), counts))

        for batch in batches:
            texts = as_bytes(batch.column("text"))
            for cut in slices(texts):
                found, count = tokens(texts[cut]), cut.stop - cut.start
                if used + count > BLOCK_DOCS or size >= FLUSH:
                    yield from close()
                    block, used, size, held = next(numbers), 0, 0, []
                unit, place = _units(found, m.frequent)
                own = m.classes[unit].astype(np.int64)
                second, first = _classes_before(own, found.owner)
                here = (place >= 0) | (found.endings < 0)
                n = np.where(place >= 0, m.frequent.n[place] if len(m.frequent.n) else 0, m.ends)[here]
                way = m.transitions[second[here], first[here], own[here]]
                owner = found.owner[here]
                away = ~here
                held.append((found.hashes[away].view(np.int64), own[away], found.owner[away] + used, (second * CLASSES + first)[away]))
                sums = lambda x: pa.array(np.bincount(owner, x, count))
                yield _rows(
                    count, block=pa.array(np.full(count, block)), slot=pa.array(np.arange(used, used + count), pa.int32()),
                    doc_id=batch.column("doc_id").slice(cut.start, count), held_out=batch.column("held_out").slice(cut.start, count),
                    n_tokens=pa.array(np.bincount(found.owner, minlength=count)), n_known=pa.array(np.bincount(owner, n > 0, count).astype(np.int64)),
                    base_score=sums(np.log10((n + 1) / floor)), score=sums(np.log10(known(m, n, own[here], way))))
                used += count
                size += len(found.hashes)
        if held:
            yield from close()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Occurrences of words whose count is known now, added up by block and place before they go back."""
        m, held, size = shared.value, [], 0

        def sent() -> Iterator[pa.RecordBatch]:
            block, slot, base, own, count = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((slot, block))
            block, slot = block[order], slot[order]
            new = (np.diff(block, prepend=-1) != 0) | (np.diff(slot, prepend=-1) != 0)
            at = np.flatnonzero(new)
            sums = np.stack([np.add.reduceat(x[order], at) for x in (base, own, count)], 1)
            block, slot = block[at], slot[at]
            begin = np.flatnonzero(np.diff(block, prepend=-1))
            n = np.diff(np.append(begin, len(block)))
            yield pa.RecordBatch.from_arrays([pa.array(block[begin]), pack(slot.astype("<u2"), n), pack(sums.ravel(), 3 * n)],
                                             names=[x for x, _, _ in _SENT])

        for batch in batches:
            slots, each = unpack(batch.column("slots"), "<u2")
            before, _ = unpack(batch.column("before"), "<u2")
            n = np.repeat(batch.column("n").fill_null(0).to_numpy(), each)
            own = np.repeat(batch.column("class").to_numpy(), each)
            way = m.transitions.reshape(-1, CLASSES)[before, own]
            held.append((np.repeat(batch.column("block").to_numpy(), each), slots.astype(np.int64), np.log10((n + 1) / floor),
                         np.log10(known(m, n, own, way)), (n > 0).astype(float)))
            size += len(slots)
            if size >= FLUSH // 4:
                yield from sent()
                held, size = [], 0
        if size:
            yield from sent()

    source = spread(docs.select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id"))))
    found = materialise(source.mapInArrow(first_look, ", ".join(f"{n} {t}" for n, _, t in _ROWS)))
    words = found.filter("word is not null").select("block", "word", "class", "slots", "before")
    met = words.join(model.counts.select("word", "n"), "word", "left").select("block", "class", "slots", "before", "n")
    back = met.mapInArrow(look, ", ".join(f"{n} {t}" for n, _, t in _SENT))
    parts = found.filter("slot is not null").select(
        "block", "slot", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score").unionByName(back, allowMissingColumns=True)

    def add(sums: dict[str, np.ndarray], part: pa.RecordBatch) -> None:
        slots, _ = unpack(part.column("slots"), "<u2")
        values = unpack(part.column("sums"), "<f8")[0].reshape(-1, 3)
        for i, name in enumerate(("base_score", "score", "n_known")):
            np.add.at(sums[name], slots, values[:, i])

    out = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                     ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def finish(mine: pa.RecordBatch, sums: dict[str, np.ndarray]) -> pa.RecordBatch:
        plus = lambda n: mine.column(n).to_numpy() + sums[n]
        return pa.RecordBatch.from_arrays([
            mine.column("doc_id"), mine.column("held_out"), mine.column("n_tokens"), pa.array(plus("n_known").astype(np.int64)),
            pa.array(np.full(mine.num_rows, total)), pa.array(plus("base_score")), pa.array(plus("score"))], schema=out)

    return closed(parts, {"base_score": np.float64, "score": np.float64, "n_known": np.float64}, add, finish,
                  "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def perplexity(scored: DataFrame) -> DataFrame:
    """(held_out, n_tokens, base_perplexity, perplexity): per token, over all texts of each fold."""
    per = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(
        F.sum("n_tokens").alias("n_tokens"), per("base_score").alias("base_perplexity"), per("score").alias("perplexity"))
