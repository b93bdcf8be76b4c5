"""Vector and hybrid retrieval for whole tables of questions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from quillgraph.functions.arrays import bind, dot
from quillgraph.functions.containment import contains_join
from quillgraph.functions.text import prepare_embedding_text, preview
from quillgraph.operators.communities import ordered_index, with_communities
from quillgraph.operators.graph import put_titles

EMBED_BATCH = 32
EMBED_WINDOW = 512
DEFAULT_DIM = 64
LINK_CAP = 8
SUMMARY_LINK_CAP = 20
DEFAULT_TOP_K, DEFAULT_THRESHOLD, DEFAULT_MAX_RELATIONS = 1, 0.3, 20
UNFINISHED_STATES = ["thinking", "streaming"]

Embedder = Callable[[list[str]], list[list[float]]]
Scorer = Callable[[list[str], list[str]], list[float]]


# -- embedding ----------------------------------------------------------------

def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{IsHan}|[\p{L}\p{N}&&[^\p{IsHan}]]+"), F.lit(0))


def hashed_term_vector(text: Column, dim: int = DEFAULT_DIM) -> Column:
    """Offline embedding: term counts in ``dim`` hash buckets, scaled to length one."""
    bucket = lambda t: (F.conv(F.substring(F.md5(t.cast("binary")), 1, 8), 16, 10).cast("long") % dim).cast("int")
    # Removing a number from an array of integers is one plain loop; a filter would call an expression for each term.
    counts = bind(F.transform(_terms(text), bucket), lambda bs: F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda d: (F.size(bs) - F.size(F.array_remove(bs, d))).cast("double")))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return bind(counts, lambda v: bind(norm(v), lambda n: F.transform(
        v, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)))))


def embed_chunks(chunks: DataFrame, embedder: Embedder | None = None, dim: int = DEFAULT_DIM,
                 batch: int = EMBED_BATCH, window: int = EMBED_WINDOW) -> DataFrame:
    """Add a unit ``embedding`` of each chunk's whole prepared text; blank chunks are rejected.

    A user's embedder is called on ``batch`` texts at a time.  A text longer than ``window``
    characters is embedded window by window, and the vectors are averaged by length.
    """
    prepared = chunks.withColumn("_text", prepare_embedding_text(F.col("text"))).filter(F.col("_text") != "")
    if embedder is None:
        return prepared.withColumn("embedding", hashed_term_vector(F.col("_text"), dim)).drop("_text")

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            cuts = [[text[i:i + window] for i in range(0, len(text), window)] for text in part]
            pieces = [piece for cut in cuts for piece in cut]
            vectors = [v for at in range(0, len(pieces), batch) for v in embedder(pieces[at:at + batch])]
            done, at = [], 0
            for cut in cuts:
                weights = np.array([len(piece) for piece in cut], dtype=float)
                block = np.array(vectors[at:at + len(cut)], dtype=float)
                done.append((weights @ block / weights.sum()).tolist())
                at += len(cut)
            yield pd.Series(done)

    unit = bind(F.col("_raw"), lambda v: bind(
        F.sqrt(dot(v, v)), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x))))
    return prepared.withColumn("_raw", run("_text")).withColumn("embedding", unit).drop("_text", "_raw")


# -- vector search ------------------------------------------------------------

def vector_top_k(queries: DataFrame, vectors: DataFrame, k: int, key: str = "doc_id",
                 salts: int = 1) -> DataFrame:
    """The ``k`` nearest vectors of each query within the query's own document.

    Every vector and every query is sent once; the adaptive skew rule splits the
    vectors of a huge document, and the rank filter keeps only each task's best
    before the last shuffle.  A small question table is broadcast by the planner
    instead.  ``salts`` deals each document's vectors further and repeats its
    queries as often, for a table of few huge documents.
    """
    left, asked, at = vectors, queries.select("query_id", key, F.col("embedding").alias("_q")), [key]
    if salts > 1:
        left = left.withColumn("_salt", F.pmod(F.xxhash64("bid"), F.lit(salts)).cast("int"))
        asked = asked.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        at = [key, "_salt"]
    scored = left.join(asked, at).withColumn(
        "distance", 1.0 - dot("embedding", "_q")).drop("embedding", "_q", "_salt")
    order = Window.partitionBy("query_id").orderBy("distance", "bid")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def token_overlap(question: Column, text: Column) -> Column:
    """Default rerank score: share of the question's terms that the text has."""
    return bind(F.array_distinct(_terms(question)), lambda q: F.when(F.size(q) == 0, F.lit(0.0)).otherwise(
        F.size(F.array_intersect(q, _terms(text))) / F.size(q)))


def rerank(hits: DataFrame, scorer: Scorer | None = None, top_k: int | None = None) -> DataFrame:
    """Order each query's hits (question, text, distance) by score, best first."""
    if scorer is None:
        score = token_overlap(F.col("question"), F.col("text"))
    else:
        @F.pandas_udf("double")
        def run(question: pd.Series, text: pd.Series) -> pd.Series:
            return pd.Series(scorer(question.tolist(), text.tolist()))

        score = run("question", "text")
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "distance", "bid")
    ranked = hits.withColumn("rerank_score", score).withColumn("rank", F.row_number().over(order))
    return ranked if top_k is None else ranked.filter(F.col("rank") <= top_k)


# -- graph side ---------------------------------------------------------------

def link_query_entities(questions: DataFrame, nodes: DataFrame, cap: int = LINK_CAP) -> DataFrame:
    """Nodes of the question's graph named in the question, longest names first."""
    names = nodes.select("graph_id", "node")
    asked = questions.select("query_id", "graph_id", "question")
    found = contains_join(asked, names, ["graph_id"], ["query_id"], "question", "node")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.length("node")), "node")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= cap).select(
        "query_id", "graph_id", "node", "rank")


def linked_from_responses(responses: DataFrame, questions: DataFrame, nodes: DataFrame,
                          cap: int = LINK_CAP) -> DataFrame:
    """Entities a model chose (``payload`` JSON per request id), kept if the graph has them."""
    chosen = responses.select(
        F.col("request_id").alias("query_id"),
        F.posexplode_outer(F.from_json(F.get_json_object("payload", "$.entities"), "array<string>")).alias("pos", "node"))
    known = chosen.join(questions.select("query_id", "graph_id"), "query_id").join(
        nodes.select("graph_id", "node"), ["graph_id", "node"], "left_semi")
    order = Window.partitionBy("query_id").orderBy("pos")
    return known.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= cap).select(
        "query_id", "graph_id", "node", "rank")


def community_relations(linked: DataFrame, communities: DataFrame, edges: DataFrame,
                        threshold: float = DEFAULT_THRESHOLD, top_n: int = DEFAULT_MAX_RELATIONS) -> DataFrame:
    """Heaviest edges inside the communities of each question's entities.

    The best ``top_n`` of every community pair are taken before questions come
    in, so a community's edges are not repeated per question.
    """
    chosen = linked.join(communities, ["graph_id", "node"]).select("query_id", "graph_id", "community_id").distinct()
    strong = with_communities(edges.filter(F.coalesce("weight", F.lit(0.5)) >= threshold), communities)
    best = [F.desc("weight"), F.col("source"), F.col("target")]
    if top_n > 0:
        pair = Window.partitionBy("graph_id", "source_community", "target_community").orderBy(*best)
        strong = strong.withColumn("_r", F.row_number().over(pair)).filter(F.col("_r") <= top_n).drop("_r")
    end = lambda name: chosen.withColumnRenamed("community_id", f"{name}_community")
    inside = strong.join(end("source"), ["graph_id", "source_community"]).join(
        end("target"), ["query_id", "graph_id", "target_community"], "left_semi")
    inside = inside.drop("source_community", "target_community")
    if top_n <= 0:
        down = inside.withColumn("_down", -F.col("weight"))
        ranked = ordered_index(down, ["query_id"], [F.col("_down"), F.col("source"), F.col("target")], "rank")
        return ranked.drop("_down").withColumn("rank", F.col("rank") + 1)
    order = Window.partitionBy("query_id").orderBy(*best)
    return inside.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_n)


def format_relations(edges: DataFrame) -> DataFrame:
    """Add the sentence form of each relation."""
    return edges.withColumn("sentence", F.concat(
        F.lit("Edge from "), F.col("source"), F.lit(" to "), F.col("target"),
        F.lit(", Relation: "), F.coalesce("label", F.lit("Unknown")),
        F.lit(", context:"), F.coalesce("title", F.lit("No Context")),
        F.lit(", weight:"), F.coalesce("weight", F.lit(0.5)).cast("string")))


def clean_history(messages: DataFrame, drop_system: bool = False) -> DataFrame:
    """Finished turns only; the older screen also leaves out system turns."""
    keep = ~F.coalesce(F.col("state"), F.lit("")).isin(UNFINISHED_STATES)
    if drop_system:
        keep = keep & (F.col("role") != "system")
    return messages.filter(keep)


def assemble_context(questions: DataFrame, relations: DataFrame, hits: DataFrame,
                     history: DataFrame | None = None,
                     template: str = "{{query}}\n{{relation}}\n{{context}}") -> DataFrame:
    """Fill the question template with its relations and chunks; attach trimmed history.

    The list of one question is bounded by the retrieval limits.
    """
    listed = lambda df, text, into: df.groupBy("query_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", F.col(text).alias("t")))), lambda r: r.t), "\n").alias(into))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    filled = (
        questions.select("query_id", "question")
        .join(listed(relations, "sentence", "_relation"), "query_id", "left")
        .join(listed(hits, "text", "_context"), "query_id", "left"))
    prompt = F.lit(template)
    for mark, value in (("query", "question"), ("relation", "_relation"), ("context", "_context")):
        prompt = F.replace(prompt, F.lit("{{" + mark + "}}"), blank(value))
    out = filled.withColumn("prompt", prompt).drop("_relation", "_context")
    if history is None:
        return out
    turns = history.groupBy("query_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "role", "content"))),
        lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("history"))
    return out.join(turns, "query_id", "left")


def hybrid_retrieve(questions: DataFrame, nodes: DataFrame, edges: DataFrame, communities: DataFrame,
                    vectors: DataFrame, top_k: int = DEFAULT_TOP_K, threshold: float = DEFAULT_THRESHOLD,
                    max_relations: int = DEFAULT_MAX_RELATIONS, titles: DataFrame | None = None) -> dict[str, DataFrame]:
    """Graph and vector context of every question (query_id, graph_id, question).

    With ``titles`` the edges are those of ``graph.keyed_edges``, and only the relations
    that a question keeps get their titles.
    """
    linked = link_query_entities(questions, nodes)
    kept = community_relations(linked, communities, edges, threshold, max_relations)
    relations = format_relations(kept if titles is None else put_titles(kept, titles))
    asked = embed_chunks(questions.withColumn("text", F.col("question"))).select(
        "query_id", F.col("graph_id").alias("doc_id"), "embedding")
    hits = vector_top_k(asked, vectors, top_k).join(questions.select("query_id", "question"), "query_id")
    ordered = rerank(hits, top_k=top_k)
    return {
        "linked": linked, "relations": relations, "hits": ordered,
        "contexts": assemble_context(questions, relations, ordered),
    }


def build_citations(hits: DataFrame, linked: DataFrame, view: dict[str, DataFrame]) -> DataFrame:
    """Citation rows per question: four chunks, two nodes and two heaviest links.

    ``view`` comes from :func:`graph_view`.  Evidence blocks of a cited node or
    link are found by its ``graph_key`` in the evidence tables.
    """
    cite = lambda kind, graph_kind, number, ident, label, text: [
        F.lit(kind).alias("type"), F.lit(graph_kind).alias("graph_kind"), number.alias("number"),
        ident.alias("id"), label.alias("label"), text.alias("preview")]
    sources = hits.filter(F.col("rank") <= 4).select("query_id", *cite(
        "source", "", F.col("rank"), F.concat(F.lit("source-"), F.col("bid")),
        F.concat(F.lit("原文片段 "), F.col("rank").cast("string")), preview(F.col("text"))),
        F.lit("").alias("terms"))
    per = lambda *order: F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    node_rows = (
        linked.select("query_id", "graph_id", F.col("node").alias("id"))
        .join(view["nodes"], ["graph_id", "id"])
        .withColumn("number", per("rank", "first_pos", "id")).filter(F.col("number") <= 2)
        .select("query_id", *cite(
            "graph", "node", F.col("number"), F.concat(F.lit("graph-node-"), F.col("id")), F.col("name"),
            F.concat(F.lit("图谱实体 · "), F.col("entity_type"))), F.col("name").alias("terms")))
    names = linked.select("query_id", "graph_id", "node")
    touching = lambda end: view["links"].join(names.withColumnRenamed("node", end), ["graph_id", end])
    shape = ["query_id", "id", "source", "target", "relation", "context", "weight", "at"]
    link_rows = (
        touching("source").select(*shape).unionByName(touching("target").select(*shape)).distinct()
        .withColumn("number", per(F.desc("weight"), "at", "id")).filter(F.col("number") <= 2)
        .select("query_id", *cite(
            "graph", "edge", F.col("number"), F.concat(F.lit("graph-edge-"), F.col("id")),
            F.concat_ws(" · ", "source", "relation", "target"), preview(F.col("context"))),
            F.concat_ws("|", "source", "target", "relation").alias("terms")))
    return sources.unionByName(node_rows).unionByName(link_rows)


def order_session_requests(requests: DataFrame) -> DataFrame:
    """Turn of each request in its session and document, in arrival order.

    Sessions of any length are numbered by range partitions.
    """
    return ordered_index(
        requests, ["session_id", "doc_id"], [F.col("arrived_at"), F.col("request_id")], "turn")
