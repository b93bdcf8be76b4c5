"""Filters and searches over stored graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillgraph.functions.ranking import fuzzy_score, search_form


def _shown_weight(weight: Column) -> Column:
    """A missing or zero weight counts as 0.5."""
    return F.coalesce(F.nullif(weight, F.lit(0.0)), F.lit(0.5))


def filter_graph(nodes: DataFrame, edges: DataFrame, types: list[str] | None = None, min_weight: float = 0.5,
                 keep: DataFrame | None = None, collapsed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Visible nodes and edges under type, focus, weight and collapse filters."""
    shown = nodes.filter(F.col("label").isin(types)) if types else nodes
    if keep is not None:
        shown = shown.join(keep, ["graph_id", "node"], "left_semi")
    ids = shown.select("graph_id", "node")
    links = edges.filter(_shown_weight(F.col("weight")) >= min_weight)
    for end in ("source", "target"):
        links = links.join(ids.withColumnRenamed("node", end), ["graph_id", end], "left_semi")
    if collapsed is not None:
        links = links.join(collapsed, ["graph_id", "edge_id"], "left_anti")
    return shown, links


def focus_neighbourhood(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """The selected nodes and everything one edge away."""
    pick = lambda end, other: edges.join(
        selected.withColumnRenamed("node", end), ["graph_id", end], "left_semi"
    ).select("graph_id", F.col(other).alias("node"))
    return (
        selected.select("graph_id", "node")
        .unionByName(pick("source", "target")).unionByName(pick("target", "source")).distinct())


def collapse_hubs(edges: DataFrame, hubs: DataFrame, keep: int = 3) -> DataFrame:
    """Edges hidden because they are not among a hub's ``keep`` heaviest.

    Only the heaviest few of each hub are ranked, which the planner prunes before
    the shuffle; the hidden rest follows by an anti join.
    """
    touch = edges.select("graph_id", "edge_id", "weight", F.explode(F.array_distinct(
        F.array("source", "target"))).alias("node")).join(hubs.select("graph_id", "node"), ["graph_id", "node"], "left_semi")
    order = Window.partitionBy("graph_id", "node").orderBy(F.desc(F.coalesce("weight", F.lit(0.0))), "edge_id")
    kept = touch.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= keep)
    return (
        touch.join(kept.select("graph_id", "node", "edge_id"), ["graph_id", "node", "edge_id"], "left_anti")
        .select("graph_id", "edge_id").distinct())


def search_graph(nodes: DataFrame, edges: DataFrame, term: str, limit: int = 80) -> DataFrame:
    """Nodes, then edges, whose label holds the term; at most ``limit`` per graph."""
    wanted = term.lower().strip()
    hits = nodes.filter(F.contains(F.lower("node"), F.lit(wanted))).select(
        "graph_id", F.lit("node").alias("kind"), F.col("node").alias("id"), F.col("node").alias("label"),
        F.lit(0).alias("_k"))
    if wanted:
        hits = hits.unionByName(edges.filter(F.contains(F.lower("label"), F.lit(wanted))).select(
            "graph_id", F.lit("edge").alias("kind"), F.col("edge_id").alias("id"), "label", F.lit(1).alias("_k")))
    order = Window.partitionBy("graph_id").orderBy("_k", "label", "id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).drop("_k")


def prefix_search(nodes: DataFrame, term: str, limit: int = 8) -> DataFrame:
    """Nodes whose name starts with a term of at least two characters."""
    wanted = term.strip().lower()
    hits = nodes.filter(F.lower("node").startswith(wanted) & F.lit(len(wanted) >= 2))
    order = Window.partitionBy("graph_id").orderBy("node")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def fuzzy_rank(names: DataFrame, query: str | Column, name: str = "name", wide: bool = True) -> DataFrame:
    """Add the fuzzy ``score`` of each name for the query."""
    asked = query if isinstance(query, Column) else F.lit(query)
    return (
        names.withColumn("_name", search_form(F.col(name), wide))
        .withColumn("_query", search_form(asked, wide))
        .withColumn("score", fuzzy_score(F.col("_name"), F.col("_query")))
        .drop("_name", "_query"))


def rank_communities(entries: DataFrame, members: DataFrame, query: str, entity_type: str = "",
                     wide: bool = True) -> DataFrame:
    """Directory entries with their search rank: own names first, then members."""
    score = lambda df, col, into: fuzzy_rank(df, query, col, wide).withColumnRenamed("score", into)
    own = score(score(entries, "representative", "_rep"), "community_name", "_name")
    inside = fuzzy_rank(members, query, "node", wide).groupBy("graph_id", "community_id").agg(
        F.max("score").alias("_member"))
    primary = F.greatest("_rep", "_name")
    member = F.coalesce("_member", F.lit(-1))
    rank = (
        F.when(primary >= 0, primary + 2000).when(member >= 0, member + 1000).otherwise(F.lit(-1)))
    if not query.strip():
        rank = F.lit(0)
    if entity_type:
        rank = F.when(F.col("entity_type") == entity_type, rank).otherwise(F.lit(-1))
    return own.join(inside, ["graph_id", "community_id"], "left").withColumn("rank", rank).drop(
        "_rep", "_name", "_member")


def find_edges(edges: DataFrame, hints: DataFrame) -> DataFrame:
    """The edge each hint (hint_id, graph_id, id, source, target, relation) means.

    By id, else by both ends in either direction, or by the one end given, with
    the relation name if there is one.  Blank fields are null.
    """
    base = edges.select(
        "*", F.least("source", "target").alias("_lo"), F.greatest("source", "target").alias("_hi"))
    asked = hints.select(
        "hint_id", "graph_id", F.col("id").alias("_id"), F.col("source").alias("_s"),
        F.col("target").alias("_t"), F.col("relation").alias("_rel"),
        F.least("source", "target").alias("_ql"), F.greatest("source", "target").alias("_qh"))
    named = F.col("_rel").isNull() | (F.col("_rel") == F.col("label"))
    same = base["graph_id"] == asked["graph_id"]
    both = F.col("_s").isNotNull() & F.col("_t").isNotNull()
    ways = [
        (0, base.join(asked, same & (F.col("edge_id") == F.col("_id")))),
        (1, base.join(asked.filter(both), same & (F.col("_lo") == F.col("_ql")) & (F.col("_hi") == F.col("_qh"))).filter(named)),
        (1, base.join(asked.filter(F.col("_s").isNotNull() & F.col("_t").isNull()), same & (F.col("source") == F.col("_s"))).filter(named)),
        (1, base.join(asked.filter(F.col("_s").isNull() & F.col("_t").isNotNull()), same & (F.col("target") == F.col("_t"))).filter(named)),
    ]
    found = None
    for priority, way in ways:
        rows = way.select("hint_id", F.lit(priority).alias("_p"), *[base[c] for c in edges.columns])
        found = rows if found is None else found.unionByName(rows)
    # One minimum an attribute: those that nothing reads do not take part in the joins.
    order = F.struct("_p", "first_at", "edge_id")
    return found.groupBy("hint_id").agg(*[F.min_by(c, order).alias(c) for c in edges.columns])
