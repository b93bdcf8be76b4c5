"""Splitting document text into chunks, sentences and batches.

Each splitter works inside the document's row with array functions, so a split
needs no shuffle and no group ever gathers more than one document.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from quillgraph.functions.arrays import bind, dot, explode_indexed
from quillgraph.functions.text import WS, block_id, count_tokens, strip, tokens

DEFAULT_MAX_TOKENS = 1024
DEFAULT_MIN_TOKENS = 384
MAX_TOKENS_RANGE = (128, 32_768)

# Where a chunk may end, where a relation sentence ends, where an
# overlong sentence may be cut, and the semantic splitter's punctuation by rank.
CUT_AFTER = r"[.!?;。！？；]|\n\n"
SENTENCE_END = r"(?<=[。！？!?；;\n])"
SEGMENT_MARKS = "，,、：:"
RANKED_PUNCTUATION = [
    "\n\n", "\n", "。", "！", "？", "；", "…", ". ", "! ", "? ", "; ", "... ", ", ", "、",
]
PROTECTED_TAG = r"<(img|table|code)[^>]*>(?s:.*?)</\1>"

Tokenizer = Callable[[str], list[str]]


def normalize_chunk_settings(max_tokens: int | None = None,
                             min_tokens: int | None = None) -> tuple[int, int]:
    low, high = MAX_TOKENS_RANGE
    top = DEFAULT_MAX_TOKENS if max_tokens is None else int(max_tokens)
    bottom = DEFAULT_MIN_TOKENS if min_tokens is None else int(min_tokens)
    if not low <= top <= high:
        raise ValueError(f"max_tokens must lie in {low}..{high}")
    if not 1 <= bottom < top:
        raise ValueError("min_tokens must be at least 1 and below max_tokens")
    return top, bottom


def _check_limits(max_tokens: int, min_tokens: int = 0) -> None:
    if max_tokens < 1 or not 0 <= min_tokens <= max_tokens:
        raise ValueError("max_tokens must be at least 1 and min_tokens lie in 0..max_tokens")


def _token_array(text: Column, tokenizer: Tokenizer | None) -> Column:
    """Tokens that tile the text: built in, or from a user's Python tokenizer."""
    if tokenizer is None:
        return tokens(text)

    @F.pandas_udf("array<string>")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda value: tokenizer(value or ""))

    return run(text)


def _token_windows(toks: Column, max_tokens: int, min_tokens: int, overlap: int) -> Column:
    """Spans (first token, token after the last) chosen greedily from the left."""
    n = F.size(toks)
    state = F.struct(
        F.lit(0).alias("start"),
        F.array().cast("array<struct<s:int,e:int>>").alias("spans"),
    )

    def step(acc: Column, _: Column) -> Column:
        full = F.least(acc.start + max_tokens, n)
        window = F.slice(toks, acc.start + 1, F.lit(max_tokens))
        marks = F.transform(window, lambda t: t.rlike(CUT_AFTER))
        # Tokens up to the window's last mark; the window's own length if it has none.
        cut = full - acc.start - F.greatest(
            F.array_position(F.reverse(marks), True).cast("int") - 1, F.lit(0))
        end = F.when(full >= n, full).otherwise(bind(
            cut, lambda c: F.when(c >= min_tokens, acc.start + c).otherwise(full)))
        grown = bind(end, lambda e: F.struct(
            F.when(e - overlap > acc.start, e - overlap).otherwise(e).alias("start"),
            F.array_append(acc.spans, F.struct(acc.start.alias("s"), e.alias("e"))).alias("spans"),
        ))
        return F.when(acc.start >= n, acc).otherwise(grown)

    pace = max(1, min_tokens - overlap)
    steps = F.sequence(F.lit(0), F.ceil(n / pace).cast("int") + 1)
    return F.aggregate(steps, state, step, lambda s: s.spans)


def _explode_chunks(df: DataFrame, pieces: str, doc_key: str) -> DataFrame:
    """One row per piece with ordinal, block id, stripped text and token count."""
    return (
        explode_indexed(df, pieces, "_pos", "_piece")
        .withColumn("ordinal", F.col("_pos") + 1)
        .withColumn("text", strip(F.col("_piece")))
        .withColumn("bid", block_id(F.col(doc_key), F.col("ordinal"), F.col("text")))
        .withColumn("n_tokens", count_tokens(F.col("text")))
        .drop("_pos", "_piece")
    )


def split_by_tokens(docs: DataFrame, max_tokens: int = DEFAULT_MAX_TOKENS,
                    min_tokens: int = DEFAULT_MIN_TOKENS, overlap: int = 0,
                    tokenizer: Tokenizer | None = None, doc_key: str = "doc_id") -> DataFrame:
    """Windows of at most ``max_tokens``, ended after the last sentence mark if
    that leaves at least ``min_tokens``."""
    _check_limits(max_tokens, min_tokens)
    pieces = bind(_token_array(F.col("text"), tokenizer), lambda toks: F.transform(
        _token_windows(toks, max_tokens, min_tokens, overlap),
        lambda w: F.array_join(F.slice(toks, w.s + 1, w.e - w.s), "")))
    staged = docs.withColumn("_pieces", pieces).drop("text")
    return _explode_chunks(staged, "_pieces", doc_key)


def split_by_separator(docs: DataFrame, sep: str = "</end>", keep: bool = False,
                       max_tokens: int = DEFAULT_MAX_TOKENS,
                       tokenizer: Tokenizer | None = None, doc_key: str = "doc_id") -> DataFrame:
    """Chunks between separators; a chunk over ``max_tokens`` continues in further chunks."""
    _check_limits(max_tokens)
    last = lambda parts: F.element_at(parts, -1) == ""
    ended = lambda parts: F.transform(parts, lambda p, i: F.when(
        i < F.size(parts) - 1, F.concat(p, F.lit(sep))).otherwise(p)) if keep else parts
    whole = bind(F.split(F.col("text"), rf"\Q{sep}\E", -1), lambda parts: F.when(
        last(parts), F.slice(ended(parts), F.lit(1), F.size(parts) - 1)).otherwise(ended(parts)))
    if tokenizer is not None:
        return _split_parts_with(docs, whole, max_tokens, tokenizer, doc_key)

    def pieces(toks: Column) -> Column:
        last = F.greatest(F.ceil(F.size(toks) / max_tokens).cast("int") - 1, F.lit(0))
        return F.transform(
            F.sequence(F.lit(0), last),
            lambda k: F.array_join(F.slice(toks, k * max_tokens + 1, F.lit(max_tokens)), ""))

    # A part of at most max_tokens characters cannot exceed max_tokens tokens.
    cut = lambda part: F.when(F.length(part) <= max_tokens, F.array(part)).otherwise(
        bind(tokens(part), pieces))
    staged = (
        docs.withColumn("_parts", whole)
        .withColumn("_pieces", F.flatten(F.transform("_parts", cut)))
        .drop("text", "_parts")
    )
    return _explode_chunks(staged, "_pieces", doc_key)


def _split_parts_with(docs: DataFrame, parts: Column, max_tokens: int,
                      tokenizer: Tokenizer, doc_key: str) -> DataFrame:
    """Separator split with a Python tokenizer, which returns each document's pieces."""

    @F.pandas_udf("array<string>")
    def pieces(batch: pd.Series) -> pd.Series:
        def cut(items: list[str]) -> list[str]:
            out: list[str] = []
            for item in items:
                toks = tokenizer(item)
                out += [item] if len(toks) <= max_tokens else [
                    "".join(toks[i:i + max_tokens]) for i in range(0, len(toks), max_tokens)]
            return out

        return batch.map(lambda items: cut(list(items)))

    return _explode_chunks(docs.withColumn("_pieces", pieces(parts)).drop("text"), "_pieces", doc_key)


def split_by_similarity(sentences: DataFrame, threshold: float = 0.80, max_tokens: int = 2000,
                        min_tokens: int = 500, doc_key: str = "doc_id") -> DataFrame:
    """Chunks of sentences (doc, pos, text, n_tokens, embedding) with similar neighbours.

    Neighbour similarity is an equi-join on (document, position), spread evenly
    whatever a document's length.  A chunk ends at the first dissimilar pair once
    it holds ``min_tokens``, else at its best-ranked punctuation, else at the
    window's end; the window breathes by a fifth with the chunk number.
    """
    _check_limits(max_tokens, min_tokens)
    key = F.col(doc_key)
    following = sentences.select(
        key.alias("_doc"), (F.col("pos") - 1).alias("_pos"), F.col("embedding").alias("_next"))
    rank = F.coalesce(
        *[F.when(F.col("text").endswith(mark), F.lit(i)) for i, mark in enumerate(RANKED_PUNCTUATION)],
        F.lit(len(RANKED_PUNCTUATION)))
    scored = (
        sentences.join(following, (key == F.col("_doc")) & (F.col("pos") == F.col("_pos")), "left")
        .select(key, F.struct(
            "pos", F.col("n_tokens").cast("int").alias("n"),
            F.coalesce(dot("embedding", "_next") < threshold, F.lit(False)).alias("brk"), rank.alias("rank"), "text",
        ).alias("_s"))
    )
    docs = scored.groupBy(doc_key).agg(F.array_sort(F.collect_list("_s")).alias("_all"))
    state = F.struct(
        F.lit(0).alias("start"), F.lit(0).alias("used"), F.lit(0).alias("full"),
        F.array().cast("array<struct<s:int,e:int>>").alias("spans"))

    def step(rows: Column, total: Column, full: Column, acc: Column) -> Column:
        number = F.size(acc.spans) + 1
        limit = F.floor(max_tokens * (1 + 0.2 * (number % 3 - 1))).cast("int")
        # Up to the sentence that passes the limit at the latest; those without tokens do not count.
        reach = F.coalesce(F.get(full, acc.full + int(max_tokens * 1.2)), F.size(rows))
        ahead = F.slice(rows, acc.start + 1, reach - acc.start)
        # Walk the window once: tokens so far, last fitting place, first break, best mark.
        seed = F.struct(
            F.lit(0).alias("i"), F.lit(0).alias("sum"), F.lit(0).alias("fit"), F.lit(0).alias("brk"),
            F.lit(len(RANKED_PUNCTUATION)).alias("rank"), F.lit(0).alias("mark"))

        def walk(w: Column, s: Column) -> Column:
            size, place = w.sum + s.n, w.i + 1
            fits = (size <= limit) & (w.fit == w.i)
            enough = fits & (size >= min_tokens)
            better = enough & (s["rank"] <= w["rank"]) & (s["rank"] < len(RANKED_PUNCTUATION))
            return F.struct(
                place.alias("i"), size.alias("sum"),
                F.when(fits, place).otherwise(w.fit).alias("fit"),
                F.when(enough & s.brk & (w.brk == 0), place).otherwise(w.brk).alias("brk"),
                F.when(better, s["rank"]).otherwise(w["rank"]).alias("rank"),
                F.when(better, place).otherwise(w.mark).alias("mark"))

        length = bind(F.aggregate(ahead, seed, walk), lambda v: F.when(v.brk > 0, v.brk).when(
            v.mark > 0, v.mark).otherwise(F.greatest(v.fit, F.lit(1))))
        tail = total - acc.used <= min_tokens
        last = F.size(rows)
        end = F.when(tail, last).otherwise(F.least(acc.start + length, last))
        grown = bind(end, lambda e: F.struct(
            e.alias("start"),
            (acc.used + F.aggregate(
                F.slice(rows, acc.start + 1, e - acc.start), F.lit(0), lambda a, s: a + s.n)).alias("used"),
            (acc.full + F.size(F.filter(
                F.slice(rows, acc.start + 1, e - acc.start), lambda s: s.n > 0))).alias("full"),
            F.array_append(acc.spans, F.struct(acc.start.alias("s"), e.alias("e"))).alias("spans")))
        return F.when(acc.start >= last, acc).otherwise(grown)

    # Places of the sentences that have tokens.
    places = lambda rows: F.filter(F.transform(rows, lambda s, i: F.when(s.n > 0, i)), lambda i: i.isNotNull())
    spans = bind(F.col("_all"), lambda rows: bind(
        F.aggregate(rows, F.lit(0), lambda a, s: a + s.n),
        lambda total: bind(places(rows), lambda full: F.aggregate(
            F.sequence(F.lit(0), F.size(rows)), state,
            lambda acc, _: step(rows, total, full, acc), lambda s: s.spans))))
    return (
        docs.withColumn("_spans", spans)
        .transform(explode_indexed, "_spans", "_i", "_w")
        .withColumn("_part", F.slice(F.col("_all"), F.col("_w.s") + 1, F.col("_w.e") - F.col("_w.s")))
        .withColumn("ordinal", F.col("_i") + 1)
        .withColumn("text", F.array_join(F.transform("_part", lambda s: s.text), ""))
        .withColumn("n_sentences", F.size("_part"))
        .withColumn("n_tokens", F.aggregate("_part", F.lit(0), lambda a, s: a + s.n))
        .withColumn("bid", block_id(key, F.col("ordinal"), F.col("text")))
        .select(doc_key, "ordinal", "bid", "text", "n_sentences", "n_tokens")
    )


def protect_tags(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace image, table and code elements by numbered marks; ``tags`` keeps them."""
    pieces = F.split(F.col(text), PROTECTED_TAG, -1)
    return (
        docs.withColumn("tags", F.regexp_extract_all(F.col(text), F.lit(PROTECTED_TAG), F.lit(0)))
        .withColumn("_pieces", pieces)
        .withColumn(text, F.array_join(F.transform("_pieces", lambda p, i: F.when(
            i < F.size("tags"), F.concat(p, F.lit("__TAG_"), i.cast("string"), F.lit("__"))).otherwise(p)), ""))
        .drop("_pieces")
    )


def restore_tags(chunks: DataFrame, text: str = "text") -> DataFrame:
    """Put the elements of ``tags`` back into every chunk that mentions them."""
    marked = F.transform("tags", lambda t, i: F.struct(t.alias("tag"), i.alias("i")))
    restored = F.aggregate(
        marked, F.col(text),
        lambda acc, m: F.replace(acc, F.concat(F.lit("__TAG_"), m.i.cast("string"), F.lit("__")), m.tag))
    return chunks.withColumn(text, restored).drop("tags")


def route_splitter(docs: DataFrame, routing: dict[str, set[str]], ext: str = "ext") -> DataFrame:
    """Name the splitter family of each document by its extension.

    Unlisted extensions use the first family that has any extension at all.
    """
    default = next((family for family, exts in routing.items() if exts), None)
    label = F.lit(default)
    for family, exts in reversed(list(routing.items())):
        label = F.when(F.col(ext).isin(sorted(exts)), F.lit(family)).otherwise(label)
    return docs.withColumn("splitter", label)


def split_routed(docs: DataFrame, routing: dict[str, set[str]],
                 splitters: dict[str, Callable[[DataFrame, int, int], DataFrame]],
                 max_tokens: int | None = None, min_tokens: int | None = None) -> DataFrame:
    """Run each family's splitter on its own documents, with the checked chunk settings."""
    top, bottom = normalize_chunk_settings(max_tokens, min_tokens)
    labelled = route_splitter(docs, routing)
    parts = [
        split(labelled.filter(F.col("splitter") == family), top, bottom) for family, split in splitters.items()
    ]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged


def _as_column(value: int | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def split_long_segment(segment: Column, max_chars: int | Column) -> Column:
    """Pieces of an overlong sentence, cut behind a comma-like mark in the second half."""
    max_chars = _as_column(max_chars)
    half = F.floor(max_chars / 2).cast("int")
    state = F.struct(segment.alias("rest"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, _: Column) -> Column:
        window = F.left(acc.rest, max_chars + 1)
        before = F.regexp_extract(window, rf"(?s)^(.*)[{SEGMENT_MARKS}]", 1)
        marked = window.rlike(rf"[{SEGMENT_MARKS}]") & (F.length(before) >= half)
        size = F.when(marked, F.length(before) + 1).otherwise(max_chars)
        cut = bind(size, lambda n: F.struct(
            F.substr(acc.rest, n + 1).alias("rest"),
            F.array_append(acc.out, F.left(acc.rest, n)).alias("out")))
        return F.when(F.length(acc.rest) > max_chars, cut).otherwise(acc)

    steps = F.sequence(F.lit(0), F.ceil(F.length(segment) / F.greatest(half, F.lit(1))).cast("int"))
    return F.aggregate(
        steps, state, step,
        lambda s: F.when(s.rest != "", F.array_append(s.out, s.rest)).otherwise(s.out))


def relation_batches(text: Column, max_chars: int | Column = 2000) -> Column:
    """Sentence-aligned batches of at most ``max_chars`` characters (one more after a comma cut)."""
    max_chars = _as_column(max_chars)
    sentences = F.filter(F.split(strip(text), SENTENCE_END, -1), lambda s: s != "")
    parts = F.flatten(F.transform(sentences, lambda s: F.when(
        F.length(s) > max_chars, split_long_segment(s, max_chars)).otherwise(F.array(s))))
    state = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))

    def step(acc: Column, part: Column) -> Column:
        full = (acc.cur != "") & (F.length(acc.cur) + F.length(part) > max_chars)
        return F.struct(
            F.when(full, F.array_append(acc.out, strip(acc.cur))).otherwise(acc.out).alias("out"),
            F.when(full, part).otherwise(F.concat(acc.cur, part)).alias("cur"))

    return F.aggregate(parts, state, step, lambda s: F.when(
        strip(s.cur) != "", F.array_append(s.out, strip(s.cur))).otherwise(s.out))


def split_relation_text(chunks: DataFrame, max_chars: int = 2000) -> DataFrame:
    """One row per relation batch of each chunk (``batch_no`` from 0)."""
    return (
        chunks.withColumn("_batches", relation_batches(F.col("text"), max_chars))
        .drop("text")
        .transform(explode_indexed, "_batches", "batch_no", "text")
    )


SENTENCE_ENDS = r".!?\n。！？；;"


def sentences(text: Column, ends: str = SENTENCE_ENDS) -> Column:
    """Sentences with their end mark, for co-occurrence."""
    # Cut behind every mark; what follows the last one may be empty.
    return F.filter(F.split(text, rf"(?<=[{ends}])"), lambda s: s != "")


def batch_items(df: DataFrame, keys: list[str], order: list[str], size: int = 20) -> DataFrame:
    """Number ordered items within ``keys`` and batch them by ``size``.

    ``keys`` name one chunk or text batch, whose item list is bounded.
    """
    ranked = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn("item_no", ranked).withColumn("item_batch", F.floor(F.col("item_no") / size).cast("int"))
