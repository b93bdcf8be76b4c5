"""Language model, prefix trie and token alignment against plain Python, with odd rows."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
from quillgraph.llm import class_lm, prefix_trie, token_alignment
from quillgraph.llm.bpe import _letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


# Prefix trie

def _conversations(seed):
    """A first turn in half of the conversations, copies, gaps in conv_id, nulls, empty and long texts, long conversations."""
    rng, rows = random.Random(seed), []
    for conv in range(-12, 260):
        kind = rng.random()
        for turn in range(rng.choice([0, 1, 1, 2, 3, 5, 12])):
            text = "common" if kind < 0.5 and turn < 3 else rng.choice(["a", "b", "cé", None, "", "x" * 300, f"r{rng.random()}"])
            rows.append((conv, turn if rng.random() < 0.97 or turn else None, rng.choice(["user", None]) if kind > 0.8 else "user", text))
    rows = list({r[:2]: r for r in rows}.values())
    return rows + [(1000, t, "user", f"long {t}") for t in range(60)] + [(1001, t, "user", f"long {t}") for t in range(70)] + [(None, 0, "user", "lost")]


@pytest.mark.parametrize("seed, block", [(0, 1), (1, 200), (2, 1 << 20)])
def test_trie_equals_brute_force(spark, seed, block):
    rows = _conversations(seed)
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, key string").repartition(3)
    found = prefix_trie.trie_nodes(prefix_trie.rebuilt(table), block).select(*NODE).collect()
    assert len(found) == len(set(map(tuple, found)))
    assert set(map(tuple, found)) == brute.trie(rows)


def test_trie_of_copies_crosses_blocks(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 2000, 5) for t in range(3)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = prefix_trie.trie_nodes(prefix_trie.rebuilt(table), 500).select(*NODE).collect()
    assert set(map(tuple, found)) == brute.trie(rows)


def test_trie_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_nodes(empty).count() == 0
    assert prefix_trie.prefix_nodes(spark.createDataFrame([(None, 1, "user", "x")], empty.schema)).count() == 0


def test_radix_tree_layouts_grow():
    """All keys come back, also where a node has 256 children and where one key begins another."""
    rng = random.Random(4)
    keys = sorted({bytes([i]) + b"same" * (i % 3) for i in range(256)} | {bytes(rng.randrange(4) for _ in range(rng.randint(0, 9))) for _ in range(400)})
    tree = prefix_trie.RadixTree()
    for i, key in enumerate(keys):
        tree.leaf(key, i, i).count += 1
    found, todo, kinds = {}, [(tree.root, b"")], set()
    while todo:
        node, before = todo.pop()
        whole = before + node.path
        kinds.add(node.kind)
        if node.leaf:
            found[whole] = (node.leaf.least, node.leaf.count)
        assert node.leaf or len(node.items()) > 1   # paths are compressed
        todo += [(child, whole + bytes([byte])) for byte, child in node.items()]
    assert found == {key: (i, 1) for i, key in enumerate(keys)}
    assert {4, 256} <= kinds
    node = prefix_trie.Node(b"")
    for n, byte in enumerate(rng.sample(range(256), 256), 1):
        node.put(byte, prefix_trie.Node(bytes([byte])))
        assert node.kind == next(k for k in (4, 16, 48, 256) if n <= k)
        assert sorted(b for b, _ in node.items()) == sorted(c.path[0] for _, c in node.items())
    assert all(node.child(b).path == bytes([b]) for b in range(256))


# Token alignment

TEXTS = ["", None, "a", "  lots   of  spaces\n\n\tx", "<|endoftext|> <s> </s> <unk> x", "a ▁ b", "\x00é你好\U0001f600 ", "x" * 5000, " ", "Ünïcödé wörds 12345",
         "plain words that both know", "plain words that both know"]


@pytest.fixture(scope="module")
def aligned_rows():
    rng = random.Random(3)
    more = [" ".join("".join(rng.choice("abcdeéo") for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    return [*enumerate(TEXTS + more), (3, "again"), (3, "again"), (None, "no id"), (None, None)]


def _brute_alignment(rows):
    a, b, letters = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), _letters()
    a.encode_special_tokens = True
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    each = []
    for _, text in rows:
        left = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + (text or ""), add_special_tokens=False).ids]
        right = [(i, piece(i)) for i in b.encode(text or "")]
        whole = (" " + text).encode() if text else None
        same = all(b"".join(x for _, x in side) == whole for side in (left, right))
        each.append((left, right, *brute.overlaps(left, right)) if same else ([], [], [], []))
    counts = Counter(link for *_, links in each for link in links)
    docs = Counter(link for *_, links in each for link in set(links))
    best = defaultdict(int)
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    result = [(doc, len(left), len(right), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), ";".join(groups))
              for (doc, _), (left, right, groups, links) in zip(rows, each)]
    return result, {k: (docs[k], n, n == best[k[1]]) for k, n in counts.items()}


@pytest.mark.parametrize("block_links", [40, 1 << 22])
def test_alignment_equals_brute_force(spark, aligned_rows, block_links):
    table = spark.createDataFrame([(*r, 1) for r in aligned_rows], "doc_id long, text string, n_a int").repartition(3)
    expected, _ = _brute_alignment(aligned_rows)
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
    found = token_alignment.align(table, A, B, block_links=block_links).select(*columns).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, expected))
    hashed = token_alignment.align(table, A, B, groups="sha256", block_links=block_links).select("doc_id", "groups").collect()
    assert sorted(map(repr, map(tuple, hashed))) == sorted(repr((r[0], brute.sha(r[-1]) if r[-1] else "")) for r in expected)


def test_pair_counts(spark, aligned_rows):
    table = spark.createDataFrame(aligned_rows, "doc_id long, text string").repartition(3)
    pairs = token_alignment.pair_table(token_alignment.postings(table, A, B, block_links=300)).collect()
    assert {(p.id_a, p.id_b): (p.n_docs, p.n_links, p.best) for p in pairs} == _brute_alignment(aligned_rows)[1]


def test_alignment_of_nothing(spark):
    assert token_alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0


def test_planes_list_every_document_once():
    rng = np.random.default_rng(2)
    pair, slot = rng.integers(0, 9, 4000), np.minimum(rng.integers(0, 400, 4000), rng.integers(0, 400, 4000))
    found = token_alignment.planes(pair, slot, 50).to_pydict()
    times = Counter(zip(pair.tolist(), slot.tolist()))
    read = Counter()
    for p, plane, n, bits in zip(*(found[c] for c in ("pair", "plane", "n", "bits"))):
        places = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")) if 2 * n >= 50 else np.frombuffer(bits, "<u2")
        assert len(places) == n
        for s in places.tolist():
            read[p, s] += 1 << plane
    assert read == times
    assert sum(found["fresh"]) == len(times)


# Language model

def _tokens(text):
    return [*brute.words(brute.lower(text)), None]


def _language(rng, n):
    """Two kinds of words that take turns, so that a class says what kind follows."""
    return " ".join(rng.choice("abcdefgh" if i % 2 else "stuvwxyz") + rng.choice("aeiou") for i in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(6)
    rows = [(i, _language(rng, rng.randint(0, 60))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "AA aa Aa"), (203, "only here once"), (None, "ba sa"), (None, None), (204, "x" * 20_000), (205, rows[3][1]), (3, rows[3][1])]
    return rows, spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double").repartition(3).cache()


@pytest.fixture(scope="module")
def scored(corpus):
    model = class_lm.fit(corpus[1].filter(~class_lm.held_out(F.col("doc_id"))))
    return model, class_lm.score(corpus[1], model).collect()


def _out(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 7 == 2


def test_unigram_base_equals_brute_force(corpus, scored):
    rows, _ = corpus
    counts = Counter(t for d, text in rows if not _out(d) for t in _tokens(text))
    total, distinct = sum(counts.values()), len(counts)
    expected = []
    for d, text in rows:
        own = _tokens(text)
        base = sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in own)
        expected.append((d, _out(d), len(own), sum(counts[t] > 0 for t in own), total, base))
    key = lambda r: repr((r[:5], round(r[5], 6)))
    assert sorted(map(key, expected)) == sorted(key(tuple(r)[:6]) for r in scored[1])


def test_class_model_equals_plain_python(corpus, scored):
    """The score again from the model's tables, token by token."""
    rows, _ = corpus
    model, found = scored
    counts = Counter(t for d, text in rows if not _out(d) for t in _tokens(text))
    total, distinct = sum(counts.values()), len(counts)
    expected = []
    for d, text in rows:
        one = class_lm.tokens([(text or "").encode()])
        own = model.classes[class_lm._units(one, model.frequent)[0]]
        logs, before = 0.0, (0, 0)
        for c, t in zip(own, _tokens(text)):
            n = counts[t]
            emission = 1.0 if t is None else (n - model.discount) / model.sizes[c] if n else model.unknown[c]
            alone = (n + 1) / (total + distinct + 1) if n else 1 / (total + distinct + 1) / class_lm.CLASSES
            logs += math.log10(class_lm.MIX * model.transitions[before[0], before[1], c] * emission + (1 - class_lm.MIX) * alone)
            before = (before[1], c)
        expected.append(repr((d, round(logs, 5))))
    assert sorted(expected) == sorted(repr((r.doc_id, round(r.score, 5))) for r in found)


def test_class_model_is_a_distribution(corpus, scored):
    """After every pair of classes, all known words, the end and the unknown words of all classes have probability 1."""
    rows, _ = corpus
    model, _ = scored
    words = Counter(t for d, text in rows if not _out(d) for t in _tokens(text) if t is not None)
    one = class_lm.tokens([" ".join(words).encode()])
    own = model.classes[class_lm._units(one, model.frequent)[0]][:-1]
    n = np.array(list(words.values()), float)
    emission = np.bincount(own, (n - model.discount) / model.sizes[own], class_lm.CLASSES) + model.unknown
    emission[0] = 1.0
    seen = model.sizes > 0
    assert np.allclose(emission[seen], 1)
    assert np.allclose(model.transitions.sum(2), 1)


def test_class_model_beats_unigrams_on_held_out_texts(corpus, scored):
    held = [r for r in scored[1] if r.held_out and r.n_tokens > 1]
    assert held and sum(r.score for r in held) > 0.97 * sum(r.base_score for r in held)


def test_exchange_finds_planted_classes():
    rng, size = np.random.default_rng(0), 41
    kind = np.concatenate([[0], 1 + np.arange(size - 1) % 2])
    pairs = np.zeros((size, size))
    for _ in range(20_000):
        a = rng.integers(1, size)
        b = rng.choice(np.flatnonzero(kind == 3 - kind[a]))
        pairs[a, b] += 1
    own = class_lm.exchange_core(pairs, 3)
    assert own[0] == 0 and len(set(zip(own[1:], kind[1:]))) == 2


def test_best_class_is_the_likeliest():
    """The gain of a move equals the likelihood of the whole table after it, for units without bigrams among themselves."""
    rng = np.random.default_rng(1)
    table = rng.integers(0, 50, (5, 5)).astype(float)
    right, left = np.zeros((4, 5)), np.zeros((4, 5))
    right[:, 0], left[:, 0] = rng.integers(1, 6, (2, 4))   # contexts in class 0, which no unit enters

    def likelihood(t):
        phi = lambda x: float((x * np.log(np.maximum(x, 1))).sum())
        return phi(t) - phi(t.sum(1)) - phi(t.sum(0))

    def placed(u, k):
        out = table.copy()
        out[k] += right[u]
        out[:, k] += left[u]
        return likelihood(out)

    chosen = class_lm.best_classes(right, left, np.full(4, class_lm.NONE, np.uint8), table)
    for u in range(4):
        assert chosen[u] == max(range(1, 5), key=lambda k: placed(u, k))


def test_model_without_texts(spark, corpus):
    model = class_lm.fit(corpus[1].limit(0))
    found = class_lm.score(corpus[1], model).collect()
    assert len(found) == len(corpus[0])
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 and math.isfinite(r.score) for r in found)
    assert class_lm.score(corpus[1].limit(0), model).count() == 0
