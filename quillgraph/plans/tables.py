"""The given tables, and the graphs the registered queries derive from them."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillgraph.operators import chunking, entities, evidence, graph, relations
from quillgraph.session import materialise

LINE_TOKENS = 32_768
DEALT_PAIRS = 250_000


def only_graph(key: str) -> Column:
    """Graph id 0 taken from a column: a literal would be folded out of join keys."""
    return (F.col(key) * 0).cast("int").alias("graph_id")


class Tables:
    """Lazy access to the tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        # Rows dealt by document also meet by longer keys where they are.
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _spread(self, df: DataFrame) -> DataFrame:
        """Text work is CPU-bound: use every core even if the files have few row groups."""
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

    @cached_property
    def documents(self) -> DataFrame:
        return self._spread(self.read("documents").select("doc_id", "lang", "source", "text"))

    @cached_property
    def pages(self) -> DataFrame:
        return self._spread(self.read("pages"))

    @cached_property
    def conversations(self) -> DataFrame:
        return self.read("conversations")

    @cached_property
    def events(self) -> DataFrame:
        return self.read("events")

    @cached_property
    def embeddings(self) -> DataFrame:
        return self.read("embeddings")

    # Term graph: one graph per document, lines as chunks, rare long words as entities.
    # Mentions and relations are stored tables of a knowledge base; they are written
    # once here as well, instead of being worked out again by every use in a plan.

    @cached_property
    def chunks(self) -> DataFrame:
        return self._split(self.documents)

    @staticmethod
    def _split(docs: DataFrame) -> DataFrame:
        return chunking.split_by_separator(docs.select("doc_id", "lang", "text"), "\n", max_tokens=LINE_TOKENS)

    @cached_property
    def gazetteer(self) -> DataFrame:
        return entities.term_gazetteer(self.documents)

    @cached_property
    def names(self) -> DataFrame:
        """The gazetteer, stored."""
        return materialise(self.gazetteer)

    @cached_property
    def _held(self) -> tuple[Broadcast | None, DataFrame | None, DataFrame | None]:
        """The names, the documents whose chunks are linked in their rows, and those that need a join instead.

        Rows of one chunk count together, so documents without an id, or that share one, are joined by chunk; all
        are where the names are too many to be held.
        """
        names = entities.hold_names(self.names)
        if names is None:
            return None, None, self.documents
        ids = materialise(self.read("documents").groupBy("doc_id").count().filter("count > 1 or doc_id is null").select(
            F.col("doc_id").alias("_id")))
        if ids.isEmpty():
            return names, self.documents, None
        same = F.col("doc_id").eqNullSafe(F.col("_id"))
        return names, self.documents.join(ids, same, "left_anti"), self.documents.join(ids, same, "left_semi")

    @cached_property
    def _parts(self) -> tuple[DataFrame | None, DataFrame | None]:
        """Chunks with their entities and relations, and the documents that need a join instead."""
        names, alone, joined = self._held
        return None if alone is None else materialise(relations.linked_chunks(self._split(alone), names)), joined

    @cached_property
    def nested_sources(self) -> DataFrame:
        """What the highlights of every chunk depend on, put together in the row that reads its text."""
        names, alone, joined = self._held
        rows = [] if alone is None else [relations.linked_sources(
            relations.linked_chunks(self._split(alone), names, whole=True))]
        if joined is not None:
            rows.append(evidence.nested_sources(
                self._split(joined), entities.first_mentions(self._joined_mentions), self._joined_relations))
        return rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])

    @cached_property
    def sources(self) -> DataFrame:
        return evidence.signed_sources(self.nested_sources)

    @cached_property
    def _joined_mentions(self) -> DataFrame:
        return materialise(entities.mentions(self._split(self._held[2]), self.names))

    @cached_property
    def _joined_relations(self) -> DataFrame:
        return relations.unnest_relations(materialise(
            relations.nested_relations_baseline(self._split(self._held[2]), self._joined_mentions)))

    @cached_property
    def _dealt(self) -> DataFrame | None:
        """The linked chunks dealt by document, so that work on its rows needs no further shuffle.

        About ``DEALT_PAIRS`` relations go to a task, whose sorts then stay in memory.
        """
        linked = self._parts[0]
        if linked is None:
            return None
        pairs = linked.agg(F.sum(F.size("source"))).first()[0] or 0
        least = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return linked.repartition(max(least, -(-pairs // DEALT_PAIRS)), "doc_id")

    def _both(self, linked: DataFrame | None, unnest: Callable[[DataFrame], DataFrame],
              joined: Callable[[], DataFrame]) -> DataFrame:
        if linked is None:
            return joined()
        rows = unnest(linked)
        return rows if self._held[2] is None else rows.unionByName(joined())

    @cached_property
    def chunk_entities(self) -> DataFrame:
        return self._both(self._parts[0], entities.unnest_entities, lambda: entities.first_mentions(self._joined_mentions))

    @cached_property
    def relations(self) -> DataFrame:
        return self._both(self._parts[0], relations.unnest_linked, lambda: self._joined_relations)

    @cached_property
    def dealt_relations(self) -> DataFrame:
        """The relations dealt by document, for work that groups or joins them."""
        return self._both(self._dealt, relations.unnest_linked, lambda: self._joined_relations)

    @cached_property
    def dealt_entities(self) -> DataFrame:
        return self._both(self._dealt, entities.unnest_entities, lambda: entities.first_mentions(self._joined_mentions))

    @cached_property
    def labels(self) -> DataFrame:
        return entities.build_entity_labels(self.dealt_entities)

    @cached_property
    def edges(self) -> DataFrame:
        return graph.build_edges(self.dealt_relations)

    @cached_property
    def nodes(self) -> DataFrame:
        return graph.build_nodes(self.edges, self.labels)

    @cached_property
    def communities(self) -> DataFrame:
        """A simple partition of the term graphs: nodes by name length."""
        return graph.endpoints(self.edges).select("graph_id", "node").distinct().withColumn(
            "community_id", (F.length("node") % 5).cast("long"))

    # Part-supplier graph: one large graph.

    @cached_property
    def supply_edges(self) -> DataFrame:
        return self.read("lineitem").groupBy("l_suppkey", "l_partkey").agg(
            F.sum("l_quantity").alias("weight")
        ).select(
            only_graph("l_suppkey"),
            F.concat(F.lit("S"), F.col("l_suppkey")).alias("source"),
            F.concat(F.lit("P"), F.col("l_partkey")).alias("target"),
            F.concat_ws("-", F.lit("edge"), "l_suppkey", "l_partkey").alias("edge_id"),
            F.lit("supplies").alias("label"), F.lit("").alias("title"), "weight",
            (F.col("l_suppkey") * 1_000_000_000 + F.col("l_partkey")).alias("first_at"))

    @cached_property
    def supply_communities(self) -> DataFrame:
        """A simple partition of the part-supplier graph: by last digit of the key."""
        return graph.endpoints(self.supply_edges).select("graph_id", "node").distinct().withColumn(
            "community_id", (F.substring("node", 2, 20).cast("long") % 7))

    # Nation trade graph: 25 nodes, weights relative to the busiest pair.

    @cached_property
    def trade_edges(self) -> DataFrame:
        customers = self.read("customer").select("c_custkey", F.col("c_nationkey").alias("buyer"))
        suppliers = self.read("supplier").select("s_suppkey", F.col("s_nationkey").alias("seller"))
        nations = self.read("nation").select("n_nationkey", "n_name")
        sales = (
            self.read("lineitem").select("l_orderkey", "l_suppkey", (
                F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
            .join(self.read("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(customers, F.col("o_custkey") == F.col("c_custkey"))
            .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
            .groupBy("buyer", "seller").agg(F.sum("revenue").alias("revenue")))
        top = sales.select(F.max("revenue")).scalar()
        name = lambda key, into: nations.select(F.col("n_nationkey").alias(key), F.col("n_name").alias(into))
        return (
            sales.join(name("buyer", "source"), "buyer").join(name("seller", "target"), "seller")
            .select(
                only_graph("buyer"), "source", "target",
                F.concat_ws("-", "source", "target").alias("edge_id"), F.lit("buys from").alias("label"),
                F.lit("").alias("title"), F.round(F.col("revenue") / top, 6).alias("weight"),
                (F.col("buyer") * 1000 + F.col("seller")).cast("long").alias("first_at")))

    @cached_property
    def trade_communities(self) -> DataFrame:
        nations = self.read("nation")
        return nations.select(
            only_graph("n_nationkey"), F.col("n_name").alias("node"),
            F.col("n_regionkey").cast("long").alias("community_id"))

    @cached_property
    def stage_events(self) -> DataFrame:
        return stage_events(self.events)


def stage_events(events: DataFrame) -> DataFrame:
    """One job per user with three stages; works on a table or a stream."""
    names = F.array(*[F.lit(s) for s in (
        "entity_extraction", "relationship_extraction", "knowledge_fusion")])
    return events.select(
        F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("seq"),
        F.get(names, (F.col("event_id") % 3).cast("int")).alias("stage"),
        (F.length("props") + F.col("event_id") % 50).cast("int").alias("completed"),
        F.lit(60).alias("total"), F.col("value").alias("item_seconds"))
