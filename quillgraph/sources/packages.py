"""Graphs as node-link JSON, and checks of transfer packages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

PACKAGE_SCHEMA = "quillgraph.transfer"
PACKAGE_VERSION = 1
MAX_FILES = 2_000
MAX_BYTES = 250 * 1024 * 1024
STATE_KEYS = ("kg_triplet", "bidirectional_mapping", "current_G", "Bolts")

_NODE = "struct<id:string,title:string,group:string>"
_EDGE = "struct<source:string,target:string,edit_id:string,label:string,title:string,weight:double>"


def export_node_link(nodes: DataFrame, edges: DataFrame, per_document: int = 50_000) -> DataFrame:
    """Node-link JSON per graph (graph_id, part, json).

    A graph of up to ``per_document`` nodes and edges is one document; a larger
    one is spread over several documents of that size, which import as one graph.
    """
    items = nodes.select(
        "graph_id",
        F.struct(F.col("node").alias("id"), F.col("label").alias("title"),
                 F.col("label").alias("group")).alias("n"),
        F.lit(None).cast(_EDGE).alias("e"),
    ).unionByName(edges.select(
        "graph_id",
        F.lit(None).cast(_NODE).alias("n"),
        F.struct("source", "target", F.col("edge_id").alias("edit_id"), "label", "title", "weight").alias("e"),
    ))
    parts = items.groupBy("graph_id").agg(F.ceil(F.count("*") / per_document).alias("_parts"))
    spread = items.join(parts, "graph_id").withColumn(
        "part", F.pmod(F.xxhash64("n", "e"), F.col("_parts")).cast("int"))
    return spread.groupBy("graph_id", "part").agg(
        F.to_json(F.struct(
            F.lit(True).alias("directed"), F.lit(False).alias("multigraph"),
            F.array_sort(F.collect_list("n")).alias("nodes"),
            F.array_sort(F.collect_list("e")).alias("edges"),
        )).alias("json"))


def _parsed(documents: DataFrame) -> DataFrame:
    shape = f"nodes array<{_NODE}>, edges array<{_EDGE}>, links array<{_EDGE}>"
    return documents.select("graph_id", F.from_json("json", shape).alias("g")).withColumn(
        "links", F.coalesce("g.edges", "g.links"))


def import_node_link(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and rejects of node-link documents with either edge key."""
    parsed = _parsed(documents)
    nodes = parsed.filter(F.col("links").isNotNull()).select("graph_id", F.explode("g.nodes").alias("n")).select(
        "graph_id", F.col("n.id").alias("node"), F.coalesce("n.group", "n.title").alias("label"))
    edges = parsed.select("graph_id", F.explode("links").alias("e")).select(
        "graph_id", "e.source", "e.target", F.col("e.edit_id").alias("edge_id"), "e.label", "e.title", "e.weight")
    rejects = parsed.filter(F.col("links").isNull()).select(
        "graph_id", F.lit("missing_edges").alias("reject_reason"))
    return nodes, edges, rejects


_MANIFEST = (
    "schema string, version int, base_name string, original_filename string, "
    "files struct<original:string,source_text:string,processed_text:string,graph_pages:array<string>>, "
    "state map<string,string>"
)


def validate_packages(packages: DataFrame, schema: str = PACKAGE_SCHEMA,
                      version: int = PACKAGE_VERSION) -> DataFrame:
    """First broken rule of each package, or null.

    ``packages``: package_id, manifest JSON, members array<struct<name,size>>.
    """
    names = F.transform("members", lambda m: m["name"])
    unsafe_path = lambda p: (
        (F.coalesce(p, F.lit("")) == "") | p.startswith("/") | F.contains(p, F.lit("\\"))
        | F.array_contains(F.split(p, "/"), F.lit(".."))
    )
    unsafe_leaf = lambda p: (
        (F.coalesce(p, F.lit("")) == "") | p.rlike(r"[/\\]") | p.isin(".", "..")
    )
    pages = F.col("m.files.graph_pages")
    listed = F.array_compact(F.concat(
        F.array("m.files.original", "m.files.source_text", "m.files.processed_text"),
        F.coalesce(pages, F.array().cast("array<string>"))))
    leaf = lambda p: F.element_at(F.split(p, "/"), -1)
    reason = (
        F.when(F.size("members") > MAX_FILES, "too_many_files")
        .when(F.aggregate("members", F.lit(0).cast("long"), lambda a, m: a + m["size"]) > MAX_BYTES, "too_large")
        .when(F.exists(names, unsafe_path), "unsafe_member")
        .when(~F.array_contains(names, F.lit("manifest.json")), "missing_manifest")
        .when(F.col("m").isNull() | F.col("m.schema").isNull(), "broken_manifest")
        .when((F.col("m.schema") != schema) | (F.col("m.version") != version)
              | F.col("m.version").isNull(), "unsupported_version")
        .when(unsafe_leaf(F.col("m.base_name")), "unsafe_base_name")
        .when(unsafe_leaf(F.col("m.original_filename")), "unsafe_file_name")
        .when((F.size(listed) < 3) | F.exists(listed, unsafe_path), "unsafe_member")
        .when(F.size(F.array_except(listed, names)) > 0, "missing_member")
        .when(F.col("m.state").isNull() | F.exists(
            F.array(*[F.lit(k) for k in STATE_KEYS]),
            lambda k: ~F.map_contains_key(F.col("m.state"), k)), "missing_state")
        .when(F.exists(pages, lambda p: ~p.startswith("graph/")), "unsafe_page")
        .when(F.exists(pages, lambda p: ~F.lower(leaf(p)).endswith(".html")), "bad_page_type")
        .when(~F.exists(F.coalesce(pages, F.array().cast("array<string>")),
                        lambda p: leaf(p) == F.concat(F.col("m.base_name"), F.lit(".html"))), "missing_main_page")
    )
    return (
        packages.withColumn("m", F.from_json("manifest", _MANIFEST))
        .select("package_id", F.col("m.base_name").alias("base_name"), reason.alias("reject_reason"))
    )
