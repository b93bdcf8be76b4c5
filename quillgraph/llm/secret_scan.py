"""Secrets in texts, found through a trigram inverted index.

From each rule's pattern a Boolean query over trigrams is derived that every
match must satisfy.  A batch of documents is one index segment: postings list the
documents that hold each trigram any rule asks for, the query is answered by
intersecting and uniting postings, and only the remaining candidates run the
pattern.  A rule without a mandatory trigram (the hexadecimal one) scans all texts.
"""

from __future__ import annotations

import re
import re._parser as sre  # the standard library's own parse of a pattern
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quillgraph.llm.textkit import as_bytes, slices


@dataclass(frozen=True)
class Rule:
    """A pattern and what its matches must fulfil: ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The base kinds, in their listed order.  Letters of the assignment's
# name come in either case; `[0-9a-f]{24,}` matches what `[0-9a-f]+` of 24 or more does.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)

# Public formats of well-known credentials.
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b"),
    Rule("chat_bot", r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("payment", r"\b[sr]k_(?:live|test)_[A-Za-z0-9]{16,}\b"),
    Rule("map_key", r"\bAIza[A-Za-z0-9_-]{35}"),
    Rule("web_token", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"\b[a-z][a-z0-9+.-]{1,10}://[^\s/:@]{1,64}:[^\s/:@]{3,64}@"),
)

#: Most strings that an exactly known part of a pattern may stand for.
MOST_STRINGS = 64

# A query is True (anything may match), a trigram, or ("and" | "or", tuple of queries).


def _join(kind: str, parts: list) -> object:
    if kind == "and":
        parts = [p for p in parts if p is not True]
        if not parts:
            return True
    elif any(p is True for p in parts):
        return True
    parts = list(dict.fromkeys(parts))
    return parts[0] if len(parts) == 1 else (kind, tuple(parts))


def _of_strings(strings: set[str]) -> object:
    """What a text holds if it holds one of the strings, ignoring the case of A-Z."""
    return _join("or", [_join("and", [s[i: i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _class(items: list) -> set[str] | None:
    letters: set[str] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            letters.add(chr(arg))
        elif op is sre.RANGE and arg[1] - arg[0] < 12:
            letters.update(map(chr, range(arg[0], arg[1] + 1)))
        else:
            return None
    letters = {c.lower() for c in letters}
    return letters if len(letters) <= 6 and all(c.isascii() for c in letters) else None


def _analyse(items) -> tuple[set[str] | None, object]:
    """The finite set of strings that the items match, if known, and their query."""
    exact: set[str] = {""}
    whole, found = True, []
    for op, arg in items:
        strings, query = None, True
        if op is sre.LITERAL and chr(arg).isascii():
            strings = {chr(arg).lower()}
        elif op is sre.AT or op is sre.ASSERT or op is sre.ASSERT_NOT:
            strings = {""}
        elif op is sre.IN:
            strings = _class(arg)
        elif op is sre.SUBPATTERN:
            strings, query = _analyse(arg[3])
        elif op is sre.BRANCH:
            sides = [_analyse(side) for side in arg[1]]
            if all(s is not None for s, _ in sides):
                strings = set().union(*(s for s, _ in sides))
            query = _join("or", [q if s is None else _of_strings(s) for s, q in sides])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, inner = arg
            strings, query = _analyse(inner)
            if strings is not None and most == 1 and least == 0:
                strings = strings | {""}
            elif not (least == most == 1):
                query = _join("and", [query, _of_strings(strings)]) if least and strings is not None else (query if least else True)
                strings = None
        if strings is not None and len(exact) * len(strings) <= MOST_STRINGS:
            exact = {a + b for a in exact for b in strings}
            continue
        found += [_of_strings(exact), query if strings is None else _of_strings(strings)]
        exact, whole = {""}, False
    if whole:
        return exact, _of_strings(exact)
    return None, _join("and", [*found, _of_strings(exact)])


def trigram_query(pattern: str) -> object:
    """Trigrams, in lower case, that every text with a match of ``pattern`` holds."""
    return _analyse(sre.parse(pattern))[1]


def _leaves(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(_leaves, query[1]))


class Scanner:
    """The rules with their queries, and the number of each trigram they ask for."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r, re.compile(r.pattern, re.ASCII), trigram_query(r.pattern)) for r in rules]
        self.grams = sorted(set().union(*(_leaves(q) for _, _, q in self.rules)))
        self.wanted = np.zeros(1 << 24, dtype=np.uint16)
        for i, gram in enumerate(self.grams):
            a, b, c = gram.encode()
            self.wanted[a << 16 | b << 8 | c] = i + 1

    def postings(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        """Sorted document numbers for each trigram that the rules ask for."""
        joined = np.frombuffer(b"\n".join(texts).lower() + b"\n\n", dtype=np.uint8).astype(np.int32)
        number = self.wanted[joined[:-2] << 16 | joined[1:-1] << 8 | joined[2:]]
        at = np.flatnonzero(number)
        ends = np.cumsum([len(t) + 1 for t in texts])
        pairs = np.unique(number[at].astype(np.int64) * len(texts) + np.searchsorted(ends, at, side="right"))
        gram, doc = pairs // len(texts), pairs % len(texts)
        cut = np.searchsorted(gram, np.arange(1, len(self.grams) + 2))
        return {g: doc[cut[i]: cut[i + 1]] for i, g in enumerate(self.grams)}

    def candidates(self, query, postings: dict[str, np.ndarray], size: int) -> np.ndarray:
        if query is True:
            return np.arange(size)
        if isinstance(query, str):
            return postings[query]
        out = None
        for part in query[1]:
            docs = self.candidates(part, postings, size)
            if out is None:
                out = docs
            else:
                out = np.intersect1d(out, docs, True) if query[0] == "and" else np.union1d(out, docs)
        return out

    def scan(self, texts: list[bytes]) -> list[list[dict]]:
        """Spans of each text by start and then rule, in code points, end exclusive."""
        postings, found = self.postings(texts), [[] for _ in texts]
        plain: dict[int, str] = {}
        for order, (rule, pattern, query) in enumerate(self.rules):
            for d in self.candidates(query, postings, len(texts)).tolist():
                text = plain.get(d)
                if text is None:
                    text = plain[d] = texts[d].decode("utf-8", "replace")
                for m in pattern.finditer(text):
                    if len(m.group(rule.group)) >= rule.least:
                        found[d].append((m.start(), order, m.end()))
        return [[{"kind": self.rules[o][0].kind, "start": s, "end": e} for s, o, e in sorted(spans)] for spans in found]


@lru_cache(maxsize=4)
def _scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED, text: str = "text",
                 into: str = "secrets") -> DataFrame:
    """Add the secret spans of every whole text as an array of (kind, start, end).

    Null and empty texts have no spans.  Rows and other columns stay; a column that
    is already called ``into`` is replaced.  Spans of different kinds may overlap.
    """
    @F.arrow_udf("array<struct<kind:string,start:bigint,end:bigint>>")
    def spans(texts: pa.Array) -> pa.Array:
        scanner, plain, out = _scanner(rules), [t or b"" for t in as_bytes(texts)], []
        for cut in slices(plain):
            out += scanner.scan(plain[cut])
        return pa.array(out, _SPANS)

    return docs.withColumn(into, spans(F.col(text)))


def spans_text(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
