"""Evidence: highlight terms per chunk and their places in documents."""

from __future__ import annotations

import heapq
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from quillgraph.functions.arrays import bind, explode_indexed, first_seen
from quillgraph.functions.containment import contains_join
from quillgraph.functions.text import WS_CHARS, fold, is_highlightable, normalize_ws, preview, strip
from quillgraph.operators.chunking import SENTENCE_ENDS
from quillgraph.operators.entities import nest_entities

MIN_ANCHOR_CHARS = 16
TERM_KINDS = ("entity_terms", "relation_terms", "evidence_terms")
SPANS = "array<struct<start:int,end:int>>"


def nest_relations(rel: DataFrame) -> DataFrame:
    """Each chunk's relations as one ordered array; a chunk bounds its size."""
    fields = ["source", "target", "relation", "context", "weight"]
    return rel.groupBy("doc_id", "bid").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rel_idx", *fields))),
        lambda r: F.struct(*[r[f].alias(f) for f in fields])).alias("relations"))


def legacy_entities(chunks: DataFrame, chunk_entities: DataFrame, labels: DataFrame) -> DataFrame:
    """For chunks without stored entities, the document's labelled names found in them."""
    bare = chunks.join(chunk_entities.select("doc_id", "bid"), ["doc_id", "bid"], "left_anti").select(
        "doc_id", "bid", "ordinal", fold(F.col("text")).alias("_text"))
    names = labels.filter(is_highlightable(F.col("name"))).select(
        "doc_id", "name", "label", "first_pos", fold(F.col("name")).alias("_name"))
    found = contains_join(bare, names, ["doc_id"], ["bid"], "_text", "_name")
    pos = F.row_number().over(Window.partitionBy("doc_id", "bid").orderBy("first_pos", "name")) - 1
    return found.select(
        "doc_id", "bid", "ordinal", pos.alias("pos"), "name", F.col("label").alias("type"))


def highlight_sources(chunks: DataFrame, chunk_entities: DataFrame, rel: DataFrame) -> DataFrame:
    """Each chunk with its entities and relations, and the signature of all that its highlights depend on."""
    return signed_sources(nested_sources(chunks, chunk_entities, rel))


def nested_sources(chunks: DataFrame, chunk_entities: DataFrame, rel: DataFrame) -> DataFrame:
    """Each chunk with its ``entities`` and ``relations`` as arrays, null where there are none."""
    return (
        chunks.select("doc_id", "bid", "ordinal", "text")
        .join(nest_entities(chunk_entities), ["doc_id", "bid"], "left")
        .join(nest_relations(rel), ["doc_id", "bid"], "left"))


def signed_sources(nested: DataFrame) -> DataFrame:
    """:func:`highlight_sources` of :func:`nested_sources`."""
    ents = F.coalesce("entities", F.array().cast("array<struct<name:string,type:string>>"))
    rels = F.coalesce("relations", F.array().cast(
        "array<struct<source:string,target:string,relation:string,context:string,weight:double>>"))
    signature = F.sha2(F.to_json(F.struct("text", "entities", "relations")).cast("binary"), 256)
    return nested.withColumn("entities", ents).withColumn("relations", rels).withColumn("signature", signature)


def build_highlights(sources: DataFrame) -> DataFrame:
    """The entity, relation and evidence terms that occur in each chunk, in first-seen order.

    Extracted names come before relation ends.  All work happens in the chunk's own row.
    """
    field = lambda name: F.transform("relations", lambda r: r[name])
    ends = F.flatten(F.transform("relations", lambda r: F.array(r["source"], r["target"])))

    def present(terms: Column, entity: bool = False) -> Column:
        clean = first_seen(F.transform(terms, lambda t: F.nullif(strip(t), F.lit(""))))
        return bind(fold(F.col("text")), lambda text: F.filter(clean, lambda t: (
            F.contains(text, fold(t)) & (is_highlightable(t) if entity else F.lit(True)))))

    return (
        sources.withColumn("entity_terms", present(F.concat(F.transform("entities", lambda e: e["name"]), ends), True))
        .withColumn("relation_terms", present(field("relation")))
        .withColumn("evidence_terms", present(field("context")))
        .drop("entities", "relations")
    )


def highlight_index(chunks: DataFrame, chunk_entities: DataFrame, rel: DataFrame) -> DataFrame:
    """Signature and the entity, relation and evidence terms that occur in each chunk."""
    return build_highlights(highlight_sources(chunks, chunk_entities, rel))


def refresh_highlights(stored: DataFrame, chunks: DataFrame, chunk_entities: DataFrame, rel: DataFrame) -> DataFrame:
    """The index of the present chunks with ``reused``: stored rows where the signature is unchanged, built rows elsewhere.

    Terms are looked for only in chunks without a stored signature.  Rows of chunks that are gone are left out;
    a stored row takes the chunk's present ordinal and text.  A chunk meets its stored rows by its own key, so the
    sources are worked out once and stay where they were put together.
    """
    return refresh_sources(stored, highlight_sources(chunks, chunk_entities, rel))


def refresh_sources(stored: DataFrame, sources: DataFrame) -> DataFrame:
    """:func:`refresh_highlights` of chunks whose sources are put together already."""
    kept = stored.select("doc_id", "bid", F.struct("signature", *TERM_KINDS).alias("_s")).groupBy("doc_id", "bid").agg(
        F.collect_list("_s").alias("_kept"))
    same = F.get(F.filter("_kept", lambda s: s["signature"] == F.col("signature")), F.lit(0))
    marked = build_highlights(sources.join(kept, ["doc_id", "bid"], "left").withColumn("_same", same).drop("_kept"))
    reused = F.col("_same").isNotNull()
    return marked.select(
        "doc_id", "bid", "signature", "ordinal", "text",
        *[F.when(reused, F.col("_same")[kind]).otherwise(F.col(kind)).alias(kind) for kind in TERM_KINDS],
        reused.alias("reused"))


def highlight_stats(marked: DataFrame) -> DataFrame:
    return marked.groupBy("doc_id").agg(
        F.count("*").alias("total_blocks"),
        F.count(F.when(F.col("reused"), 1)).alias("reused_blocks"),
        F.count(F.when(~F.col("reused"), 1)).alias("rebuilt_blocks"))


def evidence_terms(refs: DataFrame, highlights: DataFrame) -> DataFrame:
    """Terms to mark for the blocks of each request (request_id, kind, term).

    ``at`` gives the first-seen order.  Requests are (request_id, doc_id, bid) rows.
    """
    rows = refs.select("request_id", "doc_id", "bid").distinct().join(
        highlights.select("doc_id", "bid", "ordinal", *TERM_KINDS), ["doc_id", "bid"])
    tagged = lambda kind: F.transform(
        kind, lambda t, i: F.struct(F.lit(kind).alias("kind"), t.alias("term"), i.alias("i")))
    all_terms = F.flatten(F.array(*[tagged(kind) for kind in TERM_KINDS]))
    return (
        rows.withColumn("_t", all_terms).drop(*TERM_KINDS)
        .transform(explode_indexed, "_t", "_p", "_x")
        .groupBy("request_id", "_x.kind", "_x.term").agg(F.min(F.struct("ordinal", "_x.i")).alias("at")))


def inferred_terms(refs: DataFrame, source_blocks: DataFrame, view: dict[str, DataFrame]) -> DataFrame:
    """Terms for blocks without an index: names, ends, relations and texts that touch them."""
    asked = refs.select("request_id", F.col("doc_id").alias("graph_id"), F.col("bid").alias("source_block")).distinct()
    term = lambda kind, col: F.struct(F.lit(kind).alias("kind"), F.col(col).alias("term"))
    nodes = asked.join(source_blocks.select(
        "graph_id", "node", F.col("bid").alias("source_block")), ["graph_id", "source_block"]).select(
        "request_id", F.lit("entity_terms").alias("kind"), F.col("node").alias("term"))
    # A chunk's terms are made distinct before they meet the requests: its links repeat them.
    terms = view["links"].select("graph_id", "source_block", F.explode(F.array(
        term("entity_terms", "source"), term("entity_terms", "target"), term("relation_terms", "relation"),
        term("evidence_terms", "context"))).alias("_t")).select("graph_id", "source_block", "_t.*").distinct()
    links = asked.join(terms, ["graph_id", "source_block"]).select("request_id", "kind", "term")
    return nodes.unionByName(links).filter(strip(F.col("term")) != "").distinct()


def resolve_evidence(refs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks behind the references (request_id, doc_id, bid, evidence, score), previewed.

    ``occurrence`` counts earlier chunks of the document with the same text.
    """
    text_key = F.sha1(normalize_ws(F.col("text")).cast("binary"))
    same = Window.partitionBy("doc_id", "_key").orderBy("ordinal")
    numbered = chunks.withColumn("_key", text_key).withColumn("occurrence", F.row_number().over(same) - 1)
    return refs.join(numbered, ["doc_id", "bid"]).select(
        "request_id", "doc_id", "bid", "ordinal", F.coalesce("evidence", F.lit("")).alias("evidence"), "score",
        preview(F.col("text")).alias("preview"), "occurrence")


# -- character ranges ---------------------------------------------------------

class _Folded:
    """Folded form of a text, and the raw offset behind each of its characters (``at``, if any has moved)."""

    def __init__(self, raw: str):
        self.at = None
        plain = " ".join(raw.split())
        # Nothing moves if blanks stand alone; only these two letters change their length or by their neighbours.
        if len(plain) == len(raw) and "\u0130" not in raw and "\u03a3" not in raw:
            self.text = plain.lower()
            return
        points = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), "<u4")
        kinds, which = np.unique(points, return_inverse=True)   # each kind of character is looked at once
        forms = [" " if chr(k).isspace() else chr(k).lower() for k in kinds.tolist()]
        blank = np.array([f == " " for f in forms], bool)[which]
        kept = np.flatnonzero(~(blank & np.concatenate([[True], blank])[:-1]))
        if len(kept) and blank[kept[-1]]:
            kept = kept[:-1]
        sizes = np.array([len(f) for f in forms], np.int64)
        letters = np.frombuffer("".join(forms).encode("utf-32-le", "surrogatepass"), "<u4")
        own = sizes[which[kept]]
        self.at = np.repeat(kept, own)
        step = np.arange(len(self.at)) - np.repeat(np.cumsum(own) - own, own)
        picked = letters[np.repeat((np.cumsum(sizes) - sizes)[which[kept]], own) + step]
        self.text = picked.tobytes().decode("utf-32-le", "surrogatepass")

    def range(self, begin: int, size: int) -> tuple[int, int]:
        if self.at is None:
            return begin, begin + size
        return int(self.at[begin]), int(self.at[begin + size - 1]) + 1


def _chunk_ranges(raw: str, blocks: list[str]) -> list[dict | None]:
    doc, cursor, out = _Folded(raw), 0, []
    for block in blocks:
        wanted = _Folded(block).text
        place = -1
        if wanted:
            place = doc.text.find(wanted, cursor)
            place = doc.text.find(wanted) if place < 0 else place
        if place >= 0:
            cursor = place + len(wanted)
        else:
            for wanted in (_Folded(s).text for s in _anchors(block)):
                if (place := doc.text.find(wanted)) >= 0:
                    break
        begin, end = doc.range(place, len(wanted)) if place >= 0 else (None, None)
        out.append({"start": begin, "end": end})
    return out


def _anchors(block: str) -> list[str]:
    """Sentences of sixteen characters or more, longest first."""
    cut = (s.strip(WS_CHARS) for s in re.split(rf"(?<=[{SENTENCE_ENDS}])", block))
    return sorted((s for s in cut if len(s) >= MIN_ANCHOR_CHARS), key=len, reverse=True)


def locate_chunks(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Character range of each chunk in its document, null if it cannot be found.

    Chunks are sought from the end of the one before, then anywhere, then by
    their longest sentence of at least sixteen characters.
    """

    @F.pandas_udf(SPANS)
    def run(text: pd.Series, blocks: pd.Series) -> pd.Series:
        return pd.Series([_chunk_ranges(t or "", list(b)) for t, b in zip(text, blocks)])

    # Anchors are cut where a chunk is not found, so only the texts are sent.
    lists = chunks.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "bid", "text"))).alias("_c"))
    field = lambda name: F.transform("_c", lambda c: c[name])
    return (
        docs.select("doc_id", "text").join(lists, "doc_id")
        .withColumn("_spans", run("text", field("text")))
        .select("doc_id", F.arrays_zip(field("ordinal").alias("ordinal"), field("bid").alias("bid"), F.col("_spans").alias("span")).alias("_z"))
        .transform(explode_indexed, "_z", "_p", "_r")
        .select("doc_id", "_r.ordinal", "_r.bid", "_r.span.start", "_r.span.end")
    )


def _sweep(ranges: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Cover of the ranges (start, end, rank): every place belongs to the lowest rank over it.

    One pass over the ends of the ranges, with the open ranges in a heap by rank.
    """
    out: list[tuple[int, int, int]] = []
    waiting, active = sorted(ranges), []
    places = sorted({p for start, end, _ in ranges for p in (start, end)})
    at = 0
    for here, there in zip(places, places[1:]):
        while at < len(waiting) and waiting[at][0] == here:
            heapq.heappush(active, (waiting[at][2], waiting[at][1]))
            at += 1
        while active and active[0][1] <= here:
            heapq.heappop(active)
        if not active:
            continue
        rank = active[0][0]
        if out and out[-1][1:] == (here, rank):
            out[-1] = (out[-1][0], there, rank)
        else:
            out.append((here, there, rank))
    return out


def _term_ranges(raw: str, terms: list[dict]) -> list[dict]:
    doc, ranges = _Folded(raw), []
    ordered = sorted(terms, key=lambda t: (-t["priority"], -len(t["term"]), t["term"], t["kind"]))
    kinds: list[str] = []   # one rank per occurrence, so that neighbours of one term stay apart
    for item in ordered:
        wanted = _Folded(item["term"]).text
        place = doc.text.find(wanted) if wanted else -1
        while place >= 0:
            ranges.append((*doc.range(place, len(wanted)), len(kinds)))
            kinds.append(item["kind"])
            place = doc.text.find(wanted, place + len(wanted))
    return [{"start": start, "end": end, "kind": kinds[rank]} for start, end, rank in _sweep(ranges)]


def locate_terms(chunks: DataFrame, terms: DataFrame) -> DataFrame:
    """Non-overlapping ranges of the terms (doc_id, bid, term, kind, priority) in each chunk.

    Higher priority first, then longer terms; later ones keep what is still free.
    """

    @F.pandas_udf("array<struct<start:int,end:int,kind:string>>")
    def run(text: pd.Series, items: pd.Series) -> pd.Series:
        return pd.Series([_term_ranges(t or "", list(i)) for t, i in zip(text, items)])

    lists = terms.groupBy("doc_id", "bid").agg(
        F.collect_set(F.struct("term", "kind", "priority")).alias("_t"))
    return (
        chunks.select("doc_id", "bid", "text").join(lists, ["doc_id", "bid"])
        .withColumn("_m", run("text", "_t")).drop("_t")
        .transform(explode_indexed, "_m", "match_no", "_x")
        .select("doc_id", "bid", "match_no", "_x.start", "_x.end", "_x.kind",
                F.substring(F.col("text"), F.col("_x.start") + 1, F.col("_x.end") - F.col("_x.start")).alias("matched"))
    )
