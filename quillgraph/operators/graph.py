"""Graph tables built from relations: edges, nodes, evidence, degrees, sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillgraph.functions.text import UNKNOWN_LABEL, edge_id
from quillgraph.operators.entities import ORDER_STRIDE

MANUAL_ORIGIN = "manual"
EXTRACTED_ORIGIN = "extracted"


def with_edge_ids(rel: DataFrame) -> DataFrame:
    """Fill ``edit_id``: the explicit one, else a digest of the relation and its place."""
    derived = edge_id(
        F.col("bid"), F.col("rel_idx"), F.col("source"), F.col("target"), F.col("relation"), F.col("context"))
    return rel.withColumn("edit_id", F.coalesce("edit_id", derived))


def _text_key(doc_id: str, bid: str, text: str) -> Column:
    """Digest that stands for a chunk's text while rows are grouped; nulls are values of their own."""
    return F.unhex(F.sha1(F.to_json(F.struct(
        F.col(doc_id).alias("d"), F.col(bid).alias("b"), F.sha1(F.col(text).cast("binary")).alias("t"))).cast("binary")))


def _with_texts(rows: DataFrame, given: DataFrame, into: str) -> DataFrame:
    """Put the texts of ``given`` (_text, text) in place of the keys in ``rows``.

    The relations of a sentence all quote it, so its text is sent once for its chunk, not once
    for each of them.  One text a key lets the planner leave this join out where nothing reads the text.
    """
    texts = given.distinct().groupBy("_text").agg(F.first("text").alias(into))
    return rows.join(texts, "_text", "left").drop("_text")


def _quoted(rel: DataFrame) -> DataFrame:
    return rel.select(_text_key("doc_id", "bid", "context").alias("_text"), F.col("context").alias("text"))


def _grouped_edges(identified: DataFrame, text: str, into: str) -> DataFrame:
    at = F.col("ordinal").cast("long") * ORDER_STRIDE + F.col("rel_idx")
    # One maximum an attribute: those that nothing reads are neither worked out nor sent.
    last = lambda value, name: F.max_by(value, F.struct("ordinal", "rel_idx")).alias(name)
    return identified.groupBy(F.col("doc_id").alias("graph_id"), "source", "target").agg(
        last("edit_id", "edge_id"), last("relation", "label"), last(text, into),
        last(F.coalesce("weight", F.lit(0.5)), "weight"), last("bid", "bid"), last("origin", "origin"),
        F.min(at).alias("first_at"))


def keyed_edges(rel: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with the key ``_text`` of their title, and the titles by that key, for :func:`put_titles`.

    For work that moves all edges and shows few: the texts are sent once, to those that are left.
    """
    return _grouped_edges(with_edge_ids(rel).withColumn("_text", _text_key("doc_id", "bid", "context")), "_text", "_text"), _quoted(rel)


def put_titles(edges: DataFrame, texts: DataFrame) -> DataFrame:
    """Put the titles of :func:`keyed_edges` in place of their keys."""
    return _with_texts(edges, texts, "title")


def build_edges(rel: DataFrame) -> DataFrame:
    """One edge per ordered pair; the last relation in chunk order gives its attributes.

    Relations that are dealt by document are grouped where they are.
    """
    return _grouped_edges(with_edge_ids(rel), "context", "title").select(
        "graph_id", "source", "target", "edge_id", "label", "title", "weight", "bid", "origin", "first_at")


def endpoints(edges: DataFrame, *extra: str) -> DataFrame:
    """Both ends of every edge as (graph_id, node, role) rows, in one scan."""
    ends = F.array(
        F.struct(F.col("source").alias("node"), F.lit(0).alias("role")),
        F.struct(F.col("target").alias("node"), F.lit(1).alias("role")))
    return edges.select("graph_id", *extra, F.explode(ends).alias("_n")).select("graph_id", *extra, "_n.*")


def build_nodes(edges: DataFrame, labels: DataFrame | None, include_isolated: bool = False) -> DataFrame:
    """Edge endpoints with their labels; on request also labelled names without edges.

    Work that reads the names alone gives no ``labels``, so none are sent.
    """
    if labels is None:
        return endpoints(edges).select("graph_id", "node").distinct().withColumn("label", F.lit(UNKNOWN_LABEL))
    ends = endpoints(edges).select(
        "graph_id", "node", F.lit(None).cast("string").alias("label"), F.lit(True).alias("_used"))
    named = labels.select(F.col("doc_id").alias("graph_id"), F.col("name").alias("node"), "label",
                          F.lit(include_isolated).alias("_used"))
    return (
        ends.unionByName(named).groupBy("graph_id", "node")
        .agg(F.max("label").alias("label"), F.max("_used").alias("_used"))
        .filter("_used")
        .select("graph_id", "node", F.coalesce("label", F.lit(UNKNOWN_LABEL)).alias("label"))
    )


def rebuild_from_state(labels: DataFrame, rel: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (isolated ones included) and edges after an edit."""
    edges = build_edges(rel)
    return build_nodes(edges, labels, include_isolated=True), edges


def node_source_blocks(rel: DataFrame) -> DataFrame:
    """Chunks that mention each endpoint, to be read in ``ordinal`` order."""
    ends = rel.select(
        F.col("doc_id").alias("graph_id"), "bid", "ordinal",
        F.explode(F.array("source", "target")).alias("node"))
    return ends.groupBy("graph_id", "node", "bid").agg(F.min("ordinal").alias("ordinal"))


def _occurrences(rel: DataFrame, *keys: str) -> DataFrame:
    """Distinct evidence of the relations."""
    return rel.groupBy(
        F.col("doc_id").alias("graph_id"), "source", "target", F.col("relation").alias("label"),
        F.col("bid").alias("source_block"), F.col("context").alias("evidence"), F.coalesce("weight", F.lit(0.5)).alias("score"), *keys,
    ).agg(F.min(F.struct("ordinal", "rel_idx")).alias("at"))


def edge_evidence(edges: DataFrame, rel: DataFrame) -> DataFrame:
    """Evidence rows of each edge in ``at`` order, with the relation's origin.

    Occurrences of the same relation name are taken in the edge's direction, else
    reversed, else from the edge itself.
    """
    key = ["graph_id", "source", "target", "label"]
    found = _occurrences(rel)
    groups = rel.groupBy(
        F.col("doc_id").alias("graph_id"), "source", "target", F.col("relation").alias("label")
    ).agg(F.min_by(F.coalesce("origin", F.lit(EXTRACTED_ORIGIN)), F.struct("ordinal", "rel_idx")).alias("_origin"))
    back = groups.select(
        "graph_id", F.col("source").alias("target"), F.col("target").alias("source"), "label",
        F.col("_origin").alias("_back_origin"))
    located = (
        edges.join(groups, key, "left").join(back, key, "left")
        .withColumn("_forward", F.col("_origin").isNotNull() | F.col("_back_origin").isNull())
        .select(
            "graph_id", F.col("source").alias("edge_source"), F.col("target").alias("edge_target"), "label",
            F.when(F.col("_forward"), F.col("source")).otherwise(F.col("target")).alias("source"),
            F.when(F.col("_forward"), F.col("target")).otherwise(F.col("source")).alias("target"),
            F.coalesce("_origin", "_back_origin", "origin", F.lit(EXTRACTED_ORIGIN)).alias("origin"),
            F.col("bid").alias("_own_block"), F.col("title").alias("_own_text"), F.col("weight").alias("_own_score"))
    )
    own = F.col("source_block").isNull()
    return located.join(found, key, "left").select(
        "graph_id", F.col("edge_source").alias("source"), F.col("edge_target").alias("target"), "label", "at",
        F.coalesce("source_block", "_own_block").alias("source_block"),
        F.when(own, F.col("_own_text")).otherwise(F.col("evidence")).alias("evidence"),
        F.when(own, F.col("_own_score")).otherwise(F.col("score")).alias("score"), "origin",
    ).filter(F.col("source_block").isNotNull())


def graph_view(labels: DataFrame, rel: DataFrame, revision: int = 0) -> dict[str, DataFrame]:
    """Multi-edge view: nodes, links, and the evidence rows shared by equal links.

    Labelled names come first (``rank`` 0, by first position), then endpoints
    without a label in order of appearance (``rank`` 1).
    """
    identified = with_edge_ids(rel)
    at = F.col("ordinal").cast("long") * ORDER_STRIDE + F.col("rel_idx")
    ends = rel.select(F.col("doc_id").alias("graph_id"), F.explode(F.array(
        F.struct(F.col("source").alias("id"), (at * 2).alias("first_pos")),
        F.struct(F.col("target").alias("id"), (at * 2 + 1).alias("first_pos")))).alias("_n"))
    named = labels.select(F.col("doc_id").alias("graph_id"), F.col("name").alias("id"), "label",
                          F.lit(0).alias("rank"), "first_pos")
    unnamed = ends.select("graph_id", "_n.id", F.lit(None).cast("string").alias("label"),
                          F.lit(1).alias("rank"), "_n.first_pos")
    nodes = named.unionByName(unnamed).groupBy("graph_id", "id").agg(
        F.min(F.struct("rank", "first_pos")).alias("_o"), F.max("label").alias("label"))
    links = identified.select(
        F.col("doc_id").alias("graph_id"), F.col("edit_id").alias("id"), "source", "target", "relation",
        "context", F.col("context").alias("evidence"), F.col("bid").alias("source_block"),
        F.coalesce("weight", F.lit(0.5)).alias("weight"), F.coalesce("weight", F.lit(0.5)).alias("score"),
        F.coalesce("origin", F.lit(EXTRACTED_ORIGIN)).alias("origin"), at.alias("at"))
    return {
        "nodes": nodes.select(
            "graph_id", F.col("id"), F.col("id").alias("name"),
            F.coalesce("label", F.lit(UNKNOWN_LABEL)).alias("entity_type"),
            "_o.rank", "_o.first_pos", F.lit(revision).alias("revision")),
        "links": links,
        "evidence": _occurrences(identified, "edit_id").select(
            "graph_id", "source", "target", "label", "source_block", "evidence", "score",
            F.col("edit_id").alias("edge_id"), "at"),
    }


def degrees(edges: DataFrame) -> DataFrame:
    """In plus out degree; a self-loop counts twice."""
    return endpoints(edges).groupBy("graph_id", "node").agg(F.count("*").alias("degree"))


def primary_entities(edges: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` nodes of highest degree per graph, first seen first among equals.

    The rank filter becomes a per-partition group limit before the shuffle, so a
    huge graph sends only candidates to its ranking task.
    """
    seen = F.min(F.col("first_at") * 2 + F.col("role"))
    counted = endpoints(edges, "first_at").groupBy("graph_id", "node").agg(
        F.count("*").alias("degree"), seen.alias("_seen"))
    order = Window.partitionBy("graph_id").orderBy(F.desc("degree"), "_seen", "node")
    return counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).drop("_seen")


def sample_entities(labels: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """At most ``n`` names per document, drawn by a seeded hash."""
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("name")).cast("binary"))
    order = Window.partitionBy("doc_id").orderBy("_draw", "name")
    return (
        labels.select("doc_id", "name", draw.alias("_draw"))
        .withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= n)
        .select("doc_id", "name")
    )


def entity_type_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("graph_id", "label").agg(F.count("*").alias("n"))


def undirected_projection(edges: DataFrame) -> DataFrame:
    """The stronger edge of each unordered pair (``a`` <= ``b``)."""
    rest = [c for c in edges.columns if c != "graph_id"]
    return (
        edges.groupBy("graph_id", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"))
        .agg(F.max_by(F.struct(*rest), F.struct("weight", "source")).alias("_e"))
        .select("graph_id", "a", "b", "_e.*")
    )


def node_sizes(scores: DataFrame, score: str = "score") -> DataFrame:
    """Scores mapped linearly to sizes 3 to 30; all 3 when they are equal."""
    value = F.greatest(F.col(score), F.lit(0.0))
    span = scores.groupBy("graph_id").agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    ratio = F.when(F.col("_hi") > F.col("_lo"), (value - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    return scores.join(span, "graph_id").withColumn("size", F.round(3.0 + ratio * 27.0, 2)).drop("_lo", "_hi")


def degree_size(degree: Column) -> Column:
    raw = 2.0 + F.sqrt(F.greatest(degree, F.lit(0)).cast("double")) / 2.0
    return F.round(F.greatest(F.lit(2.5), F.least(F.lit(14.0), raw)), 2)


def neighbour_counts(edges: DataFrame) -> DataFrame:
    """Distinct neighbours of each node, itself excepted."""
    both = edges.filter("source <> target").select("graph_id", F.explode(F.array(
        F.struct(F.col("source").alias("node"), F.col("target").alias("other")),
        F.struct(F.col("target").alias("node"), F.col("source").alias("other")))).alias("_p"))
    return both.select("graph_id", "_p.*").distinct().groupBy("graph_id", "node").agg(
        F.count("*").alias("degree"))


def hub_nodes(degree_rows: DataFrame, mode: str = "share") -> DataFrame:
    """Hubs: degree above 0.3 of the maximum (``share``), or at least the value at
    the 20 % rank and above 3 (``rank``).

    The rank value is read from a histogram of degrees, which stays small however
    many nodes a graph has.
    """
    if mode == "share":
        top = degree_rows.groupBy("graph_id").agg(F.max("degree").alias("_top"))
        return degree_rows.join(top, "graph_id").filter(F.col("degree") > F.col("_top") * 0.3).drop("_top")
    if mode != "rank":
        raise ValueError("mode must be 'share' or 'rank'")
    histogram = degree_rows.groupBy("graph_id", "degree").agg(F.count("*").alias("_n"))
    down = Window.partitionBy("graph_id").orderBy(F.desc("degree"))
    everything = Window.partitionBy("graph_id")
    threshold = (
        histogram.withColumn("_seen", F.sum("_n").over(down))
        .withColumn("_total", F.sum("_n").over(everything))
        .filter(F.col("_seen") > F.floor(F.col("_total") * 0.2))
        .groupBy("graph_id").agg(F.max("degree").alias("_threshold")))
    return degree_rows.join(threshold, "graph_id").filter(
        (F.col("degree") >= F.col("_threshold")) & (F.col("degree") > 3)).drop("_threshold")


def graph_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Each key with its status: added, removed, changed or same."""
    attrs = [c for c in old.columns if c not in keys]
    pack = lambda df, name: df.select(*keys, F.struct(*attrs).alias(name))
    status = (
        F.when(F.col("_old").isNull(), "added")
        .when(F.col("_new").isNull(), "removed")
        .when(F.col("_old").eqNullSafe(F.col("_new")), "same")
        .otherwise("changed"))
    both = pack(old, "_old").join(pack(new, "_new"), keys, "full_outer").withColumn("status", status)
    sides = [F.col(f"_{side}.{a}").alias(f"{side}_{a}") for a in attrs for side in ("old", "new")]
    return both.select(*keys, "status", *sides)
