"""Queries over graph construction, analytics, communities and graph search."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillgraph.operators import analytics, communities, graph, graph_query
from quillgraph.plans import sql
from quillgraph.plans.registry import query
from quillgraph.plans.tables import Tables
from quillgraph.session import materialise


def _md5(col: str) -> object:
    return F.md5(F.col(col).cast("binary"))


# -- construction -------------------------------------------------------------

@query("top_entities_by_language", sql.using("mentions", "deg", "labels") + """
    , d AS (SELECT l.label AS lang, g.node, sum(degree)::BIGINT AS degree, count(*) AS n_documents
            FROM deg g JOIN labels l ON l.doc_id = g.graph_id AND l.name = g.node GROUP BY 1, 2)
    SELECT lang, node, degree, n_documents, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY lang ORDER BY degree DESC, node) AS rank FROM d) WHERE rank <= 20""")
def top_entities_by_language(t: Tables) -> DataFrame:
    """Flagship: chunks, entities, relations, edges and degrees of all documents at once."""
    from pyspark.sql import Window

    named = t.nodes.select("graph_id", "node", F.col("label").alias("lang"))
    totals = graph.degrees(t.edges).join(named, ["graph_id", "node"]).groupBy("lang", "node").agg(
        F.sum("degree").alias("degree"), F.count("*").alias("n_documents"))
    order = Window.partitionBy("lang").orderBy(F.desc("degree"), "node")
    return totals.withColumn("rank", F.row_number().over(order)).filter("rank <= 20")


@query("edges", sql.using("edges") + """
    SELECT graph_id, source, target, edge_id, label, md5(title) AS digest, weight, bid, first_at FROM edges""")
def edges(t: Tables) -> DataFrame:
    return t.edges.select("graph_id", "source", "target", "edge_id", "label", _md5("title").alias("digest"), "weight", "bid", "first_at")


@query("nodes", sql.using("nodes") + "SELECT graph_id, node, label FROM nodes")
def nodes(t: Tables) -> DataFrame:
    return t.nodes


@query("rebuilt_graph", sql.using("labels", "edges") + """
    SELECT doc_id AS graph_id, name AS node, label, (doc_id, name) IN (SELECT (graph_id, source) FROM edges)
           OR (doc_id, name) IN (SELECT (graph_id, target) FROM edges) AS connected FROM labels""")
def rebuilt_graph(t: Tables) -> DataFrame:
    all_nodes, built = graph.rebuild_from_state(t.labels, t.dealt_relations)
    ends = graph.endpoints(built).select("graph_id", "node").distinct().withColumn("connected", F.lit(True))
    return all_nodes.join(ends, ["graph_id", "node"], "left").withColumn("connected", F.coalesce("connected", F.lit(False)))


@query("edge_ids", sql.using("rel") + f"SELECT bid, rel_idx, {sql.edge_id()} AS edge_id FROM rel")
def edge_ids(t: Tables) -> DataFrame:
    return graph.with_edge_ids(t.relations).select("bid", "rel_idx", F.col("edit_id").alias("edge_id"))


@query("node_source_blocks", sql.using("rel") + """
    SELECT doc_id AS graph_id, node, bid, min(ordinal) AS ordinal FROM (
      SELECT doc_id, source AS node, bid, ordinal FROM rel UNION ALL SELECT doc_id, target, bid, ordinal FROM rel)
    GROUP BY ALL""")
def node_source_blocks(t: Tables) -> DataFrame:
    return graph.node_source_blocks(t.dealt_relations)


@query("edge_evidence", sql.using("edges", "rel") + """
    , o AS (SELECT DISTINCT doc_id AS graph_id, source, target, relation AS label, bid, context, weight FROM rel),
    back AS (SELECT graph_id, source, target, label, edge_id FROM edges WHERE md5(edge_id) < '8'),
    e AS (SELECT graph_id, CASE WHEN md5(edge_id) < '8' THEN target ELSE source END AS source,
                 CASE WHEN md5(edge_id) < '8' THEN source ELSE target END AS target, label FROM edges)
    SELECT e.graph_id, e.source, e.target, bid AS source_block, md5(context) AS digest, weight AS score FROM e
    JOIN o ON e.graph_id = o.graph_id AND e.label = o.label AND (
      (e.source = o.source AND e.target = o.target)
      OR (e.source = o.target AND e.target = o.source AND NOT EXISTS (
            SELECT 1 FROM o f WHERE f.graph_id = e.graph_id AND f.source = e.source AND f.target = e.target AND f.label = e.label)))""")
def edge_evidence(t: Tables) -> DataFrame:
    # Half of the edges are turned round, so their evidence is found reversed.
    flip = F.md5(F.col("edge_id").cast("binary")) < "8"
    turned = t.edges.withColumns({
        "source": F.when(flip, F.col("target")).otherwise(F.col("source")),
        "target": F.when(flip, F.col("source")).otherwise(F.col("target"))})
    found = graph.edge_evidence(turned, t.dealt_relations)
    return found.select("graph_id", "source", "target", "source_block", _md5("evidence").alias("digest"), "score")


@query("view_nodes", sql.using("labels", "edges") + """
    SELECT doc_id AS graph_id, name AS id, CASE WHEN label = 'en' THEN '未知标签' ELSE label END AS entity_type
    FROM labels WHERE label <> 'en' OR EXISTS (SELECT 1 FROM edges e WHERE e.graph_id = doc_id AND (e.source = name OR e.target = name))""")
def view_nodes(t: Tables) -> DataFrame:
    # English labels are withheld: those names appear only as unlabelled endpoints.
    view = graph.graph_view(t.labels.filter("label <> 'en'"), t.dealt_relations)
    return view["nodes"].select("graph_id", "id", "entity_type")


@query("view_links", sql.using("rel") + f"""
    SELECT doc_id AS graph_id, {sql.edge_id()} AS id, source, target, bid AS source_block, weight, origin FROM rel""")
def view_links(t: Tables) -> DataFrame:
    return graph.graph_view(t.labels, t.relations)["links"].select(
        "graph_id", "id", "source", "target", "source_block", "weight", "origin")


@query("view_evidence", sql.using("rel") + f"""
    SELECT DISTINCT doc_id AS graph_id, source, target, bid AS source_block, {sql.edge_id()} AS edge_id, weight AS score FROM rel""")
def view_evidence(t: Tables) -> DataFrame:
    return graph.graph_view(t.labels, t.dealt_relations)["evidence"].select(
        "graph_id", "source", "target", "source_block", "edge_id", "score")


@query("degrees", sql.using("deg") + "SELECT graph_id, node, degree FROM deg")
def degrees(t: Tables) -> DataFrame:
    return graph.degrees(t.edges)


@query("supply_degrees", sql.using("sdeg") + "SELECT graph_id, node, degree FROM sdeg")
def supply_degrees(t: Tables) -> DataFrame:
    return graph.degrees(t.supply_edges)


@query("primary_entities", sql.using("ends") + """
    SELECT graph_id, node, degree, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY degree DESC, seen, node) AS rank FROM (
        SELECT graph_id, node, count(*) AS degree, min(first_at * 2 + role) AS seen FROM ends GROUP BY graph_id, node))
    WHERE rank <= 5""")
def primary_entities(t: Tables) -> DataFrame:
    return graph.primary_entities(t.edges)


@query("sampled_entities", sql.using("labels") + """
    SELECT doc_id, name FROM (
      SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY md5('42|' || name), name) AS r FROM labels) WHERE r <= 5""")
def sampled_entities(t: Tables) -> DataFrame:
    return graph.sample_entities(t.labels, 5)


@query("entity_type_counts", sql.using("nodes") + "SELECT graph_id, label, count(*) AS n FROM nodes GROUP BY 1, 2")
def entity_type_counts(t: Tables) -> DataFrame:
    return graph.entity_type_counts(t.nodes)


@query("undirected_projection", sql.using("trade") + """
    SELECT graph_id, a, b, source, target, weight FROM (
      SELECT *, least(source, target) AS a, greatest(source, target) AS b,
        row_number() OVER (PARTITION BY graph_id, least(source, target), greatest(source, target) ORDER BY weight DESC, source DESC) AS r
      FROM trade) WHERE r = 1""")
def undirected_projection(t: Tables) -> DataFrame:
    return graph.undirected_projection(t.trade_edges).select("graph_id", "a", "b", "source", "target", "weight")


@query("node_sizes", sql.using("sdeg") + """
    SELECT graph_id, node, round(3.0::DOUBLE + (degree - lo)::DOUBLE / (hi - lo) * 27.0::DOUBLE, 2) AS size
    FROM sdeg, (SELECT min(degree) AS lo, max(degree) AS hi FROM sdeg)""")
def node_sizes(t: Tables) -> DataFrame:
    scored = graph.degrees(t.supply_edges).withColumn("score", F.col("degree").cast("double"))
    return graph.node_sizes(scored).select("graph_id", "node", "size")


@query("degree_sizes", sql.using("deg") + """
    SELECT graph_id, node, round(greatest(2.5::DOUBLE, least(14.0::DOUBLE, 2.0::DOUBLE + sqrt(degree) / 2)), 2) AS size FROM deg""")
def degree_sizes(t: Tables) -> DataFrame:
    return graph.degrees(t.edges).select("graph_id", "node", graph.degree_size(F.col("degree")).alias("size"))


@query("hub_nodes_by_share", sql.using("deg") + """
    SELECT graph_id, node, degree FROM (SELECT *, max(degree) OVER (PARTITION BY graph_id) AS top FROM deg)
    WHERE degree > 0.3 * top""")
def hub_nodes_by_share(t: Tables) -> DataFrame:
    return graph.hub_nodes(graph.degrees(t.edges), "share")


_NEIGHBOURS = """
    , nb AS (SELECT graph_id, node, count(DISTINCT other) AS degree FROM (
        SELECT graph_id, source AS node, target AS other FROM edges UNION ALL SELECT graph_id, target, source FROM edges)
      WHERE node <> other GROUP BY 1, 2)"""
_RANK_HUBS = _NEIGHBOURS + """
    , hubs AS (SELECT graph_id, node, degree FROM (
        SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY degree DESC) - 1 AS i, count(*) OVER (PARTITION BY graph_id) AS n FROM nb) x
      WHERE degree >= (SELECT max(degree) FILTER (WHERE i = floor(n * 0.2)) FROM (
        SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY degree DESC) - 1 AS i, count(*) OVER (PARTITION BY graph_id) AS n FROM nb) y
        WHERE y.graph_id = x.graph_id) AND degree > 3)"""


@query("hub_nodes_by_rank", sql.using("edges") + _RANK_HUBS + "SELECT graph_id, node, degree FROM hubs")
def hub_nodes_by_rank(t: Tables) -> DataFrame:
    return graph.hub_nodes(graph.neighbour_counts(t.edges), "rank")


@query("graph_diff", sql.using("supply") + """
    , o AS (SELECT source, target, weight FROM supply WHERE weight > 20),
    n AS (SELECT source, target, CASE WHEN weight > 60 THEN weight + 1 ELSE weight END AS weight FROM supply WHERE weight < 80)
    SELECT coalesce(o.source, n.source) AS source, coalesce(o.target, n.target) AS target,
      CASE WHEN o.source IS NULL THEN 'added' WHEN n.source IS NULL THEN 'removed'
           WHEN o.weight = n.weight THEN 'same' ELSE 'changed' END AS status, o.weight AS old_weight, n.weight AS new_weight
    FROM o FULL JOIN n ON o.source = n.source AND o.target = n.target""")
def graph_diff(t: Tables) -> DataFrame:
    base = t.supply_edges.select("source", "target", "weight")
    new = base.filter("weight < 80").withColumn("weight", F.when(F.col("weight") > 60, F.col("weight") + 1).otherwise(F.col("weight")))
    return graph.graph_diff(base.filter("weight > 20"), new, ["source", "target"])


# -- iterative analytics ------------------------------------------------------

def _walk(steps: int) -> str:
    """PageRank written out step by step."""
    parts = [
        "t AS (SELECT source, target, weight / sum(weight) OVER (PARTITION BY source) AS p FROM trade)",
        "v AS (SELECT source AS node FROM trade UNION SELECT target FROM trade)",
        "c AS (SELECT count(*) AS n FROM v)",
        "r0 AS (SELECT node, 1.0::DOUBLE / n AS rank FROM v, c)"]
    for i in range(1, steps + 1):
        parts.append(f"""
            r{i} AS (SELECT v.node, 0.85::DOUBLE * (coalesce(s.s, 0) + l.lost / n) + 0.15::DOUBLE / n AS rank
                FROM v LEFT JOIN (SELECT target, sum(rank * p) AS s FROM r{i - 1} JOIN t ON source = node GROUP BY target) s
                ON s.target = v.node, c,
                (SELECT coalesce(sum(rank), 0) AS lost FROM r{i - 1} WHERE node NOT IN (SELECT source FROM t)) l)""")
    return ", " + ", ".join(parts) + f" SELECT 0 AS graph_id, node, round(rank, 6) AS rank FROM r{steps}"


@query("pagerank", sql.using("trade") + _walk(10))
def pagerank(t: Tables) -> DataFrame:
    return analytics.pagerank(t.trade_edges, iterations=10, tol=0.0).withColumn("rank", F.round("rank", 6))


@query("betweenness")
def betweenness(t: Tables) -> DataFrame:
    return analytics.betweenness(t.edges).withColumn("score", F.round("score", 9))


@query("supply_betweenness")
def supply_betweenness(t: Tables) -> DataFrame:
    return analytics.betweenness(t.supply_edges).withColumn("score", F.round("score", 9))


@query("connected_components", sql.using("edges", "ends") + """
    , bothways AS (SELECT graph_id, source AS a, target AS b FROM edges UNION SELECT graph_id, target, source FROM edges),
    reach AS (SELECT * FROM (
      WITH RECURSIVE r(graph_id, node, start) AS (
        SELECT DISTINCT graph_id, node, node FROM ends
        UNION SELECT r.graph_id, w.b, r.start FROM r JOIN bothways w ON w.graph_id = r.graph_id AND w.a = r.node
              WHERE w.b > r.start)
      SELECT * FROM r))
    SELECT graph_id, node, min(start) AS component FROM reach GROUP BY graph_id, node""")
def connected_components(t: Tables) -> DataFrame:
    return analytics.connected_components(t.edges)


@query("supply_components", sql.using("sends") + """
    SELECT graph_id, min(node) AS component, count(DISTINCT node) AS n_nodes FROM sends GROUP BY graph_id""")
def supply_components(t: Tables) -> DataFrame:
    """At the checked scales every supplier shares parts with the others: one component."""
    return analytics.connected_components(t.supply_edges).groupBy("graph_id", "component").agg(
        F.count("*").alias("n_nodes"))


@query("louvain")
def louvain(t: Tables) -> DataFrame:
    return analytics.louvain(t.edges)


@query("modularity", sql.using("trade", "tcomm") + """
    , k AS (SELECT node, sum(weight) AS k FROM (
        SELECT source AS node, weight FROM trade UNION ALL SELECT target, weight FROM trade) GROUP BY node),
    m AS (SELECT sum(weight) AS m FROM trade),
    inner_w AS (SELECT sum(weight) AS w FROM trade JOIN tcomm a ON a.node = source JOIN tcomm b ON b.node = target
                WHERE a.community_id = b.community_id),
    s AS (SELECT sum(tot * tot) AS sq FROM (SELECT community_id, sum(k) AS tot FROM k JOIN tcomm USING (node) GROUP BY 1))
    SELECT 0 AS graph_id, round(w / m - sq / (4 * m * m), 6) AS q FROM inner_w, m, s""")
def modularity(t: Tables) -> DataFrame:
    return analytics.modularity(t.trade_edges, t.trade_communities).withColumn("q", F.round("q", 6))


# -- communities --------------------------------------------------------------

@query("community_sizes", sql.using("comm") + """
    SELECT graph_id, community_id, count(*) AS size FROM comm GROUP BY 1, 2""")
def community_sizes(t: Tables) -> DataFrame:
    return communities.community_sizes(t.communities)


@query("community_min_sizes", sql.using("nodes", "edges") + """
    , g AS (SELECT graph_id, count(*) AS n FROM nodes GROUP BY 1), e AS (SELECT graph_id, count(*) AS m FROM edges GROUP BY 1)
    SELECT graph_id, greatest(1, least(n, ceil((n + 2.0::DOUBLE * m / n) * 5 / 100)))::BIGINT AS auto_size, 20 AS custom_size
    FROM g JOIN e USING (graph_id)""")
def community_min_sizes(t: Tables) -> DataFrame:
    counts = t.nodes.groupBy("graph_id").agg(F.count("*").alias("n")).join(
        t.edges.groupBy("graph_id").agg(F.count("*").alias("m")), "graph_id")
    return counts.select(
        "graph_id", communities.community_min_size(F.col("n"), F.col("m"), "auto").alias("auto_size"),
        communities.community_min_size(F.col("n"), F.col("m")).alias("custom_size"))


@query("paging_enabled", sql.using("comm") + """
    SELECT graph_id, count(*) AS n_communities, max(size) AS largest, count(*) > 1 AND max(size) >= 3 AS paging
    FROM (SELECT graph_id, community_id, count(*) AS size FROM comm GROUP BY 1, 2) GROUP BY graph_id""")
def paging_enabled(t: Tables) -> DataFrame:
    return communities.paging_enabled(t.communities, 3)


_REPS = """
    , reps AS (SELECT c.graph_id, community_id, arg_max(c.node, lpad(degree::VARCHAR, 12, '0') || c.node) AS rep, count(*) AS size
               FROM {comm} c JOIN {deg} d ON c.graph_id = d.graph_id AND c.node = d.node GROUP BY 1, 2)"""


@query("community_representatives", sql.using("scomm", "sdeg") + _REPS.format(comm="scomm", deg="sdeg") + """
    SELECT graph_id, community_id, rep AS representative, size FROM reps""")
def community_representatives(t: Tables) -> DataFrame:
    return communities.community_representatives(t.supply_communities, graph.degrees(t.supply_edges))


@query("community_subgraph", sql.using("edges", "comm") + """
    SELECT e.graph_id, edge_id, a.community_id FROM edges e
    JOIN comm a ON a.graph_id = e.graph_id AND a.node = source JOIN comm b ON b.graph_id = e.graph_id AND b.node = target
    WHERE a.community_id = b.community_id""")
def community_subgraph(t: Tables) -> DataFrame:
    return communities.community_subgraph(t.edges, t.communities).select("graph_id", "edge_id", "community_id")


@query("community_overview", sql.using("supply", "scomm", "sdeg") + _REPS.format(comm="scomm", deg="sdeg") + """
    , x AS (SELECT s.*, a.community_id AS ca, b.community_id AS cb, ra.rep AS rsa, rb.rep AS rsb
            FROM supply s JOIN scomm a ON a.node = s.source JOIN scomm b ON b.node = s.target
            JOIN reps ra ON ra.community_id = a.community_id JOIN reps rb ON rb.community_id = b.community_id
            WHERE a.community_id <> b.community_id),
    y AS (SELECT least(ca, cb) AS community_a, greatest(ca, cb) AS community_b,
                 CASE WHEN ca > cb THEN rsb ELSE rsa END AS source, CASE WHEN ca > cb THEN rsa ELSE rsb END AS target,
                 x.source AS evidence_source, x.target AS evidence_target, weight,
                 (least(x.source, x.target) = least(rsa, rsb) AND greatest(x.source, x.target) = greatest(rsa, rsb)) AS direct FROM x)
    SELECT community_a, community_b, source, target, evidence_source, evidence_target, weight FROM (
      SELECT *, row_number() OVER (PARTITION BY community_a, community_b ORDER BY direct DESC, weight DESC, evidence_source DESC, evidence_target DESC) AS r
      FROM y) WHERE r = 1""")
def community_overview(t: Tables) -> DataFrame:
    _, crossing = communities.community_overview(
        t.supply_edges, t.supply_communities, graph.degrees(t.supply_edges), 3)
    return crossing.select("community_a", "community_b", "source", "target", "evidence_source", "evidence_target", "weight")


@query("community_directory", sql.using("comm", "deg", "nodes", "rel") + _REPS.format(comm="comm", deg="deg") + """
    , entries AS (SELECT r.graph_id, community_id, '社区' || community_id AS community_name, rep AS representative, size, n.label AS entity_type
                  FROM reps r JOIN nodes n ON n.graph_id = r.graph_id AND n.node = rep WHERE size >= 3),
    blocks AS (SELECT doc_id AS graph_id, node, bid, min(ordinal) AS ordinal FROM (
        SELECT doc_id, source AS node, bid, ordinal FROM rel UNION ALL SELECT doc_id, target, bid, ordinal FROM rel) GROUP BY ALL)
    SELECT e.*, 'member' AS kind, c.node AS item, NULL::INT AS ordinal FROM entries e
    JOIN comm c ON c.graph_id = e.graph_id AND c.community_id = e.community_id
    UNION ALL SELECT e.*, 'source_block', b.bid, b.ordinal FROM entries e
    JOIN blocks b ON b.graph_id = e.graph_id AND b.node = e.representative""")
def community_directory(t: Tables) -> DataFrame:
    entries, members = communities.community_directory(t.communities, graph.degrees(t.edges), t.nodes, 3)
    return communities.directory_listing(entries, members, graph.node_source_blocks(t.dealt_relations))


@query("community_members", sql.using("comm") + """
    SELECT graph_id, community_id, node FROM comm
    QUALIFY count(*) OVER (PARTITION BY graph_id, community_id) >= 3""")
def community_members(t: Tables) -> DataFrame:
    _, members = communities.community_directory(t.communities, graph.degrees(t.edges), t.nodes, 3)
    return members


@query("clustered_coordinates")
def clustered_coordinates(t: Tables) -> DataFrame:
    return communities.clustered_coordinates(t.supply_communities, graph.neighbour_counts(t.supply_edges))


# -- graph queries ------------------------------------------------------------

@query("filtered_graph", sql.using("edges", "nodes") + """
    SELECT e.graph_id, e.edge_id FROM edges e
    JOIN nodes s ON s.graph_id = e.graph_id AND s.node = e.source JOIN nodes d ON d.graph_id = e.graph_id AND d.node = e.target
    WHERE weight >= 0.5 AND s.label IN ('en', 'fr') AND d.label IN ('en', 'fr') AND length(e.source) > 9 AND length(e.target) > 9
      AND e.label <> 'x' AND md5(edge_id) >= '2'""")
def filtered_graph(t: Tables) -> DataFrame:
    keep = t.nodes.filter("length(node) > 9").select("graph_id", "node")
    hidden = t.edges.filter(F.md5(F.col("edge_id").cast("binary")) < "2").select("graph_id", "edge_id")
    _, links = graph_query.filter_graph(t.nodes, t.edges, ["en", "fr"], 0.5, keep, hidden)
    return links.select("graph_id", "edge_id")


@query("focus_neighbourhood", sql.using("ends", "edges") + """
    , sel AS (SELECT graph_id, min(node) AS node FROM ends GROUP BY 1)
    SELECT graph_id, node FROM sel UNION
    SELECT e.graph_id, target FROM edges e JOIN sel s ON s.graph_id = e.graph_id AND s.node = e.source UNION
    SELECT e.graph_id, source FROM edges e JOIN sel s ON s.graph_id = e.graph_id AND s.node = e.target""")
def focus_neighbourhood(t: Tables) -> DataFrame:
    selected = t.nodes.groupBy("graph_id").agg(F.min("node").alias("node"))
    return graph_query.focus_neighbourhood(t.edges, selected)


@query("collapsed_hubs", sql.using("edges") + _RANK_HUBS + """
    , touch AS (SELECT graph_id, edge_id, weight, unnest(CASE WHEN source = target THEN [source] ELSE [source, target] END) AS node FROM edges)
    SELECT DISTINCT graph_id, edge_id FROM (
      SELECT t.*, row_number() OVER (PARTITION BY t.graph_id, t.node ORDER BY weight DESC, edge_id) AS r
      FROM touch t JOIN hubs h ON h.graph_id = t.graph_id AND h.node = t.node) WHERE r > 3""")
def collapsed_hubs(t: Tables) -> DataFrame:
    hubs = graph.hub_nodes(graph.neighbour_counts(t.edges), "rank")
    return graph_query.collapse_hubs(t.edges, hubs)


@query("searched_graph", sql.using("nodes", "edges") + """
    , h AS (SELECT graph_id, 'node' AS kind, node AS id, node AS label, 0 AS k FROM nodes WHERE contains(lower(node), 'on')
            UNION ALL SELECT graph_id, 'edge', edge_id, label, 1 FROM edges WHERE contains(lower(label), 'on'))
    SELECT graph_id, kind, id, label, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY k, label, id) AS rank FROM h) WHERE rank <= 80""")
def searched_graph(t: Tables) -> DataFrame:
    return graph_query.search_graph(t.nodes, t.edges, " ON ")


@query("prefix_search", sql.using("nodes") + """
    SELECT graph_id, node, label, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY node) AS rank FROM nodes WHERE starts_with(lower(node), 'er')) WHERE rank <= 8""")
def prefix_search(t: Tables) -> DataFrame:
    return graph_query.prefix_search(t.nodes, "Er")


_SCORE = """CASE WHEN {n} = '{q}' THEN 1000 WHEN starts_with({n}, '{q}') THEN 900 - length({n})
    WHEN contains({n}, '{q}') THEN 800 - (instr({n}, '{q}') - 1)
    WHEN regexp_matches({n}, '{r}') THEN 600 - (length(regexp_extract({n}, '{r}')) - 1) ELSE -1 END"""


def _score(name: str, asked: str) -> str:
    return _SCORE.format(n=name, q=asked, r="^" + "".join(f"[^{c}]*{c}" for c in asked))


@query("fuzzy_ranked_names", sql.using("gaz") + f"""
    SELECT type, name, {_score('name', 'ation')} AS score FROM gaz""")
def fuzzy_ranked_names(t: Tables) -> DataFrame:
    return graph_query.fuzzy_rank(t.gazetteer, " A-tion ").select("type", "name", "score")


@query("ranked_communities", sql.using("comm", "deg", "nodes") + _REPS.format(comm="comm", deg="deg") + f"""
    , m AS (SELECT graph_id, community_id, max({_score('node', 'ation')}) AS ms FROM comm GROUP BY 1, 2),
    s AS (SELECT r.graph_id, r.community_id, greatest({_score('rep', 'ation')}, -1) AS own, ms, n.label
          FROM reps r JOIN m ON m.graph_id = r.graph_id AND m.community_id = r.community_id
          JOIN nodes n ON n.graph_id = r.graph_id AND n.node = rep WHERE size >= 3)
    SELECT graph_id, community_id, CASE WHEN label <> 'en' THEN -1 WHEN own >= 0 THEN own + 2000 WHEN ms >= 0 THEN ms + 1000 ELSE -1 END AS rank FROM s""")
def ranked_communities(t: Tables) -> DataFrame:
    entries, members = communities.community_directory(t.communities, graph.degrees(t.edges), t.nodes, 3)
    return graph_query.rank_communities(entries, members, "ation", "en").select("graph_id", "community_id", "rank")


@query("found_edges", sql.using("edges") + """
    , first AS (SELECT * FROM edges QUALIFY row_number() OVER (PARTITION BY graph_id ORDER BY first_at DESC) = 1)
    SELECT 'id-' || graph_id AS hint_id, edge_id FROM first
    UNION ALL SELECT 'ends-' || f.graph_id, arg_min(e.edge_id, e.first_at) FROM first f JOIN edges e ON e.graph_id = f.graph_id
      AND ((e.source = f.source AND e.target = f.target) OR (e.source = f.target AND e.target = f.source)) GROUP BY f.graph_id
    UNION ALL SELECT 'from-' || f.graph_id, arg_min(e.edge_id, e.first_at) FROM first f JOIN edges e ON e.graph_id = f.graph_id
      AND e.source = f.source GROUP BY f.graph_id""")
def found_edges(t: Tables) -> DataFrame:
    # The edges are read once for the hints and once for each way to look them up.
    known = materialise(t.edges.select("graph_id", "source", "target", "edge_id", "label", "first_at"))
    last = known.groupBy("graph_id").agg(F.max_by(F.struct("edge_id", "source", "target"), "first_at").alias("e"))
    none = F.lit(None).cast("string")
    hint = lambda kind, ident, s, d, r: F.struct(
        F.concat(F.lit(kind), F.col("graph_id").cast("string")).alias("hint_id"), ident.alias("id"), s.alias("source"),
        d.alias("target"), r.alias("relation"))
    hints = last.select("graph_id", F.explode(F.array(
        hint("id-", F.col("e.edge_id"), none, none, none),
        hint("ends-", none, F.col("e.target"), F.col("e.source"), F.lit("co-occurs")),
        hint("from-", F.lit("gone"), F.col("e.source"), none, none))).alias("h")).select("graph_id", "h.*")
    return graph_query.find_edges(known, hints).select("hint_id", "edge_id")
