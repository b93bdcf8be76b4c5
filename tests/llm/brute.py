"""Plain Python versions of the pipeline operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(value):
    return hashlib.sha256(value if isinstance(value, bytes) else value.encode()).hexdigest()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, size):
    w = words(lower(text))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < size else frozenset(zip(*[w[i:] for i in range(size)]))


def rule_counts(text):
    w = words(text)
    seen = Counter(zip(w, w[1:], w[2:]))
    covered = {j + k for j in range(len(w) - 2) if seen[w[j], w[j + 1], w[j + 2]] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    symbols = sum((text or "").count(s) for s in "#*$%&|<>")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered), failed


def base_secrets(text):
    text = text or ""
    name = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    spans = [(m.start(), 0, m.end()) for m in name.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(spans)]


def components(docs, size, percent):
    """docs: (doc_id, text) pairs; doc_id -> smallest reachable doc_id."""
    docs = [(i, shingles(t, size)) for i, t in docs if i is not None]
    root = {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(docs):
        for j, b in docs[:k]:
            shared = len(a & b)
            if shared and 100 * shared >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in docs}


def windows_removed(docs, size):
    """Per document (n_words, n_removed, kept text); docs: texts."""
    cut = [words(t) for t in docs]
    seen = Counter(tuple(w[j: j + size]) for w in cut for j in range(len(w) - size + 1))
    out = []
    for w in cut:
        gone = {k for j in range(len(w) - size + 1) if seen[tuple(w[j: j + size])] > 1 for k in range(j, j + size)}
        out.append((len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def lines_kept(docs, percent):
    """Texts without the lines that have an earlier similar line; docs: texts in order."""
    earlier, out = [], []
    for text in docs:
        if text is None:
            out.append(None)
            continue
        kept = []
        for line in text.split("\n"):
            w = frozenset(words(lower(line)))
            again = bool(w) and any(100 * len(w & v) >= percent * len(w | v) for v in earlier)
            if w:
                earlier.append(w)
            if not again:
                kept.append(line)
        out.append("\n".join(kept))
    return out


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """sizes: source -> words (None allowed); source -> target."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, stopped = share * sum(sizes.values()), set()
    while True:
        open_weight = sum(w for s, w in weight.items() if s not in stopped)
        rate = (total - sum(most * sizes[s] for s in stopped)) / open_weight if open_weight else 0
        new = {s for s in order if s not in stopped and rate * weight[s] > most * sizes[s]}
        if not new:
            return {s: most * sizes[s] if s in stopped else rate * weight[s] for s in order}
        stopped |= new


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def trie(rows):
    """Nodes of the rebuilt conversations of rows (conv_id, turn, role, text), as tuples in the operator's order of columns."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(v, key=lambda t: t[:2])] for c, v in turns.items()}
    built = {}
    for conv, own in turns.items():
        h = zlib.crc32(str(conv).encode()) % 9
        built[conv] = tuple(turns.get(conv - int(math.fmod(conv, 5)), [])[:h] + own[h:])
    members, children = defaultdict(set), defaultdict(set)
    for conv, way in built.items():
        for d in range(len(way) + 1):
            members[way[:d]].add(conv)
            if d:
                children[way[: d - 1]].add(way[:d])
    out, below = set(), {}
    for way in sorted(members, key=len, reverse=True):
        size = len(way[-1][1].encode()) if way else 0
        below[way] = (sum(below[k][0] for k in children[way]) or 1,
                      (len(members[way]) - 1) * size + sum(below[k][1] for k in children[way]))
        ends = ",".join(str(c) for c in sorted(members[way]) if built[c] == way)
        out.add((min(members[way]), len(way), min(members[way[:-1]]) if way else None, len(members[way]), len(children[way]), *below[way], sha(ends)))
    return out


def overlaps(a, b):
    """Groups and links of two tokenizations of the same bytes, each a list of (id, bytes)."""
    def ranges(tokens):
        at = 0
        for i, token in tokens:
            yield i, at, at + len(token)
            at += len(token)

    a, b = list(ranges(a)), list(ranges(b))
    links = [(i, j) for i, s, e in a for j, t, f in b if s < f and t < e]
    groups, low = [], 0
    for cut in sorted({e for _, _, e in a} & {f for _, _, f in b}):
        groups.append("|".join(",".join(str(i) for i, _, e in side if low < e <= cut) for side in (a, b)))
        low = cut
    return groups, links
