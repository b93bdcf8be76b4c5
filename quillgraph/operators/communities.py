"""Communities of a partitioned graph: sizes, representatives, overview, layout."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillgraph.functions.arrays import bind
from quillgraph.session import materialise

DEFAULT_MIN_SIZE = 20
DEFAULT_PERCENT = 5.0
GOLDEN_ANGLE = math.pi * (3.0 - math.sqrt(5.0))


def normalize_pagination(mode: str = "custom", min_size: int = DEFAULT_MIN_SIZE,
                         percent: float = DEFAULT_PERCENT) -> tuple[str, int, float]:
    mode = str(mode).strip().lower()
    if mode not in {"custom", "auto"}:
        raise ValueError("mode must be 'custom' or 'auto'")
    if not 1 <= int(min_size) <= 1_000_000:
        raise ValueError("min_size must lie in 1..1000000")
    if not 0.1 <= float(percent) <= 100:
        raise ValueError("percent must lie in 0.1..100")
    return mode, int(min_size), float(percent)


def community_min_size(nodes: Column, edges: Column, mode: str = "custom",
                       min_size: int = DEFAULT_MIN_SIZE, percent: float = DEFAULT_PERCENT) -> Column:
    """Smallest community worth its own page; in auto mode it grows with the graph."""
    mode, min_size, percent = normalize_pagination(mode, min_size, percent)
    if mode == "custom":
        return F.lit(min_size).cast("long")
    n = F.greatest(nodes, F.lit(0)).cast("long")
    e = F.greatest(edges, F.lit(0)).cast("long")
    scaled = F.ceil((n + 2.0 * e / n) * percent / 100.0)
    return F.when(n == 0, F.lit(min_size).cast("long")).otherwise(
        F.greatest(F.lit(1).cast("long"), F.least(n, scaled)))


def community_sizes(communities: DataFrame) -> DataFrame:
    return communities.groupBy("graph_id", "community_id").agg(F.count("*").alias("size"))


def paging_enabled(communities: DataFrame, min_size: int = DEFAULT_MIN_SIZE) -> DataFrame:
    """Per graph: community count, largest size, and whether pages are split."""
    return community_sizes(communities).groupBy("graph_id").agg(
        F.count("*").alias("n_communities"), F.max("size").alias("largest"),
    ).withColumn("paging", (F.col("n_communities") > 1) & (F.col("largest") >= min_size))


def with_communities(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """Edges with the community of both ends."""
    source = communities.select("graph_id", F.col("node").alias("source"), F.col("community_id").alias("source_community"))
    target = communities.select("graph_id", F.col("node").alias("target"), F.col("community_id").alias("target_community"))
    return edges.join(source, ["graph_id", "source"]).join(target, ["graph_id", "target"])


def community_subgraph(edges: DataFrame, communities: DataFrame, community_id: int | None = None) -> DataFrame:
    """Edges inside their community: of one community, or of all at once."""
    chosen = communities if community_id is None else communities.filter(F.col("community_id") == community_id)
    inner = with_communities(edges, chosen).filter(F.col("source_community") == F.col("target_community"))
    return inner.withColumnRenamed("source_community", "community_id").drop("target_community")


def community_representatives(communities: DataFrame, degree_rows: DataFrame) -> DataFrame:
    """Each community's size and its node of highest (degree, name)."""
    joined = communities.join(degree_rows, ["graph_id", "node"], "left")
    order = F.struct(F.coalesce("degree", F.lit(0).cast("long")), "node")
    return joined.groupBy("graph_id", "community_id").agg(
        F.max_by("node", order).alias("representative"), F.count("*").alias("size"))


def _listed(reps: DataFrame, min_size: int) -> DataFrame:
    """Communities of at least ``min_size``, or every one where a graph has none."""
    largest = reps.groupBy("graph_id").agg(F.max("size").alias("_largest"))
    return reps.join(largest, "graph_id").filter(
        (F.col("size") >= min_size) | (F.col("_largest") < min_size)).drop("_largest")


def community_overview(edges: DataFrame, communities: DataFrame, degree_rows: DataFrame,
                       min_size: int = DEFAULT_MIN_SIZE) -> tuple[DataFrame, DataFrame]:
    """Overview graph: representatives, and one edge per connected community pair.

    The edge between the two representatives comes first, else the heaviest
    crossing edge; its true ends stay as evidence.
    """
    reps = _listed(community_representatives(communities, degree_rows), max(1, int(min_size)))
    side = lambda name: reps.select(
        "graph_id", F.col("community_id").alias(f"{name}_community"), F.col("representative").alias(f"{name}_rep"))
    crossing = (
        with_communities(edges, communities)
        .filter(F.col("source_community") != F.col("target_community"))
        .join(side("source"), ["graph_id", "source_community"])
        .join(side("target"), ["graph_id", "target_community"])
    )
    flipped = F.col("source_community").cast("string") > F.col("target_community").cast("string")
    low, high = F.col("source_community"), F.col("target_community")
    direct = F.array_sort(F.array("source", "target")) == F.array_sort(F.array("source_rep", "target_rep"))
    attrs = [c for c in edges.columns if c not in {"graph_id", "source", "target"}]
    pick = F.struct(
        F.col("source").alias("evidence_source"), F.col("target").alias("evidence_target"), *attrs)
    order = F.struct(direct, F.col("weight"), F.col("source"), F.col("target"))
    best = crossing.groupBy(
        "graph_id",
        F.when(flipped, high).otherwise(low).alias("community_a"),
        F.when(flipped, low).otherwise(high).alias("community_b"),
        F.when(flipped, F.col("target_rep")).otherwise(F.col("source_rep")).alias("source"),
        F.when(flipped, F.col("source_rep")).otherwise(F.col("target_rep")).alias("target"),
    ).agg(F.max_by(pick, order).alias("_e"))
    return reps, best.select("graph_id", "community_a", "community_b", "source", "target", "_e.*")


def community_directory(communities: DataFrame, degree_rows: DataFrame, nodes: DataFrame,
                        min_size: int = DEFAULT_MIN_SIZE) -> tuple[DataFrame, DataFrame]:
    """Directory entries of the large communities, and their members as rows.

    The representative's source blocks are its rows in ``node_source_blocks``;
    :func:`directory_listing` puts entries, members and blocks together.
    """
    reps = community_representatives(communities, degree_rows).filter(F.col("size") >= max(1, int(min_size)))
    kinds = nodes.select("graph_id", F.col("node").alias("representative"), F.col("label").alias("entity_type"))
    entries = reps.join(kinds, ["graph_id", "representative"], "left").select(
        "graph_id", "community_id",
        F.concat(F.lit("社区"), F.col("community_id").cast("string")).alias("community_name"),
        "representative", "size", F.coalesce("entity_type", F.lit("未分类")).alias("entity_type"))
    members = communities.join(reps.select("graph_id", "community_id"), ["graph_id", "community_id"], "left_semi")
    return entries, members


def directory_listing(entries: DataFrame, members: DataFrame, blocks: DataFrame) -> DataFrame:
    """The whole directory: each entry with its members and its representative's source blocks, one ``item`` a row.

    ``kind`` is 'member' or 'source_block'; blocks are to be read in ``ordinal`` order, members have none.
    A community can hold a whole graph, so its lists stay rows.
    """
    listed = entries.join(members.select("graph_id", "community_id", F.col("node").alias("item")), ["graph_id", "community_id"])
    told = entries.join(
        blocks.select("graph_id", F.col("node").alias("representative"), F.col("bid").alias("item"), "ordinal"),
        ["graph_id", "representative"])
    return listed.select(*entries.columns, F.lit("member").alias("kind"), "item", F.lit(None).cast("int").alias("ordinal")).unionByName(
        told.select(*entries.columns, F.lit("source_block").alias("kind"), "item", "ordinal"))


def ordered_index(df: DataFrame, keys: list[str], order: list[Column], into: str) -> DataFrame:
    """Number the rows of each key from 0 in the given order, without one task per key.

    Rows are range-partitioned by key and order and written once; each partition
    numbers its own part of a key and adds the rows of the parts before it.
    """
    spread = df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_part", F.spark_partition_id())
    fixed = materialise(spread)
    local = Window.partitionBy(*keys, "_part").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = fixed.groupBy(*keys, "_part").agg(F.count("*").alias("_n")).select(
        *keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        fixed.withColumn("_local", F.row_number().over(local) - 1)
        .join(parts, [*keys, "_part"])
        .withColumn(into, F.col("_local") + F.col("_before"))
        .drop("_part", "_local", "_before")
    )


def _shelf_classes(sizes: DataFrame) -> DataFrame:
    """Where the communities of each size start on the shelves of their graph.

    Communities of one size share a diameter, so a whole size class is placed by
    arithmetic; a graph has few distinct sizes, and only those are walked in turn.
    """
    diameter = F.greatest(F.lit(90.0), F.sqrt(F.col("size").cast("double")) * 29.0) * 2.0
    classes = sizes.groupBy("graph_id", "size").agg(F.count("*").alias("m")).withColumn("d", diameter)
    graphs = classes.groupBy("graph_id").agg(
        F.greatest(F.lit(420.0), F.sqrt(F.sum(F.col("m") * F.pow(F.col("d") + 70.0, F.lit(2.0))))).alias("width"),
        F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("neg"), "m", "d"))).alias("classes"))
    start = F.struct(
        F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("h"),
        F.array().cast("array<struct<size:bigint,d:double,x:double,y:double,first:bigint,per_row:bigint,next_y:double>>")
        .alias("out"))

    def place(acc: Column, c: Column) -> Column:
        step = c.d + 70.0
        fit = lambda room: F.greatest(F.floor((room + 70.0) / step), F.lit(0).cast("long"))
        # Communities that still fit on the current shelf, then on every following one.
        first = F.when(acc.x > 0, F.least(c.m, fit(F.col("width") - acc.x))).otherwise(
            F.least(c.m, F.greatest(fit(F.col("width")), F.lit(1).cast("long"))))
        per_row = F.greatest(fit(F.col("width")), F.lit(1).cast("long"))

        def finish(f: Column) -> Column:
            left = c.m - f
            shelves = F.ceil(left / per_row)
            last = left - (shelves - 1) * per_row
            height = F.when(f > 0, F.greatest(acc.h, c.d)).otherwise(acc.h)
            below = acc.y + height + 70.0
            item = F.struct(
                (-c.neg).alias("size"), c.d.alias("d"), acc.x.alias("x"), acc.y.alias("y"),
                f.alias("first"), per_row.alias("per_row"), below.alias("next_y"))
            return F.struct(
                F.when(shelves > 0, last * step).otherwise(acc.x + f * step).alias("x"),
                F.when(shelves > 0, below + (shelves - 1) * step).otherwise(acc.y).alias("y"),
                F.when(shelves > 0, c.d).otherwise(height).alias("h"),
                F.array_append(acc.out, item).alias("out"))

        return bind(first, finish)

    return graphs.select("graph_id", F.explode(
        F.aggregate("classes", start, place, lambda s: s.out)).alias("_c")).select("graph_id", "_c.*")


def clustered_coordinates(communities: DataFrame, degree_rows: DataFrame,
                          sizes: DataFrame | None = None) -> DataFrame:
    """Closed-form positions: communities on shelves by size, members on a golden spiral.

    ``degree_rows`` are undirected neighbour degrees; ``sizes`` (graph_id, node,
    size) are drawing sizes, 3 by default.
    """
    counted = community_sizes(communities)
    ranked = ordered_index(
        counted.withColumn("_id", F.col("community_id").cast("string")),
        ["graph_id", "size"], [F.col("_id")], "_i")
    shelf = ranked.join(_shelf_classes(counted), ["graph_id", "size"])
    later = F.col("_i") - F.col("first")
    on_first = F.col("_i") < F.col("first")
    step = F.col("d") + 70.0
    x = F.when(on_first, F.col("x") + F.col("_i") * step).otherwise(F.pmod(later, F.col("per_row")) * step)
    y = F.when(on_first, F.col("y")).otherwise(F.col("next_y") + F.floor(later / F.col("per_row")) * step)
    centres = shelf.select(
        "graph_id", "community_id", (x + F.col("d") / 2).alias("_cx"), (y + F.col("d") / 2).alias("_cy"))
    members = communities.join(degree_rows, ["graph_id", "node"], "left").withColumn(
        "_down", -F.coalesce("degree", F.lit(0).cast("long")))
    if sizes is None:
        members = members.withColumn("_size", F.lit(3.0))
    else:
        members = members.join(
            sizes.select("graph_id", "node", F.col("size").alias("_size")), ["graph_id", "node"], "left",
        ).withColumn("_size", F.coalesce("_size", F.lit(3.0)))
    placed = ordered_index(members, ["graph_id", "community_id"], [F.col("_down"), F.col("node")], "_k")
    means = members.groupBy("graph_id", "community_id").agg(F.avg("_size").alias("_mean"))
    spacing = F.greatest(F.lit(15.0), F.col("_mean") * 2.2 + 7.0)
    radius = spacing * F.sqrt(F.col("_k").cast("double"))
    angle = F.col("_k") * F.lit(GOLDEN_ANGLE)
    raw = (
        placed.join(means, ["graph_id", "community_id"]).join(centres, ["graph_id", "community_id"])
        .select("graph_id", "community_id", "node",
                (F.col("_cx") + radius * F.cos(angle)).alias("_x"),
                (F.col("_cy") + radius * F.sin(angle)).alias("_y"))
    )
    mean = raw.groupBy("graph_id").agg(
        F.avg("_x").alias("_mx"), F.avg("_y").alias("_my"), F.count("*").alias("_n"),
        F.min("_x").alias("_x0"), F.max("_x").alias("_x1"), F.min("_y").alias("_y0"), F.max("_y").alias("_y1"))
    reach = F.greatest(
        F.col("_x1") - F.col("_mx"), F.col("_mx") - F.col("_x0"),
        F.col("_y1") - F.col("_my"), F.col("_my") - F.col("_y0"))
    extent = F.greatest(F.lit(360.0), F.sqrt(F.col("_n").cast("double")) * 54.0)
    scale = F.greatest(F.lit(1.0), extent / F.when(reach > 0, reach).otherwise(1.0))
    return raw.join(mean, "graph_id").select(
        "graph_id", "community_id", "node",
        F.round((F.col("_x") - F.col("_mx")) * scale, 3).alias("x"),
        F.round((F.col("_y") - F.col("_my")) * scale, 3).alias("y"))
