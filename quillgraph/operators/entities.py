"""Entities per chunk: extraction plug-in, offline baseline, normalisation, labels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F

from quillgraph.functions.arrays import explode_indexed
from quillgraph.functions.text import UNKNOWN_LABEL, strip
from quillgraph.operators.chunking import sentences

Extractor = Callable[[list[str]], list[list[tuple[str, str]]]]

HELD_NAMES = 1 << 24    # names that every task may hold by their hashes, 8 bytes each; a longer list is joined
ORDER_STRIDE = 1 << 32  # first_pos = chunk ordinal * stride + position in the chunk; positions are 32-bit


def extract_entities(chunks: DataFrame, extractor: Extractor) -> DataFrame:
    """Run a user's extractor over batches of chunk texts.

    A result that is not a list of pairs fails its own chunk only.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = extractor(batch["text"].tolist())
            good = [isinstance(item, (list, tuple)) for item in found]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "bid": batch["bid"], "ordinal": batch["ordinal"],
                "entities": [
                    [{"name": n, "type": t} for n, t in item] if ok else None
                    for item, ok in zip(found, good)],
                "error": [None if ok else "not_a_list" for ok in good],
            })

    kind = chunks.schema["doc_id"].dataType.simpleString()
    return chunks.select("doc_id", "bid", "ordinal", "text").mapInPandas(
        run, f"doc_id {kind}, bid string, ordinal int, "
             "entities array<struct<name:string,type:string>>, error string")


def term_gazetteer(docs: DataFrame, min_len: int = 8, min_df: int = 2,
                   label: str = "lang") -> DataFrame:
    """Offline gazetteer: long words in at least ``min_df`` documents of their language (label, name, doc_freq)."""
    words = docs.select("doc_id", label, F.array_distinct(
        long_words(F.col("text"), min_len)).alias("_w"))
    return (
        words.transform(explode_indexed, "_w", "_p", "name")
        .groupBy(label, "name").agg(F.count("*").alias("doc_freq"))
        .filter(F.col("doc_freq") >= min_df)
        .withColumnRenamed(label, "type")
    )


def long_words(text: Column, min_len: int) -> Column:
    # Only the first letter of a run is tried, not every rest of a shorter word.
    return F.regexp_extract_all(F.lower(text), F.lit(rf"(?<!\p{{L}})\p{{L}}{{{min_len},}}+"), F.lit(0))


def mentions(chunks: DataFrame, gazetteer: DataFrame, min_len: int = 8, label: str = "lang") -> DataFrame:
    """Gazetteer words of each chunk with sentence number and place in the sentence.

    Only word rows cross the join, never the chunk text; a frequent word's rows
    are filtered by the join and split by the adaptive skew rule if they pile up.
    The names of a partition are looked up by hash, so the many words need no sort.
    """
    per_sentence = F.transform(sentences(F.col("text")), lambda s: long_words(s, min_len))
    words = F.flatten(F.transform(per_sentence, lambda ws, i: F.transform(
        ws, lambda w, j: F.struct(i.alias("sent"), j.alias("pos"), w.alias("name")))))
    return (
        chunks.select("doc_id", "bid", "ordinal", F.col(label).alias("type"), words.alias("_w"))
        .transform(explode_indexed, "_w", "_p", "w")
        .select("doc_id", "bid", "ordinal", "type", "w.sent", "w.pos", "w.name")
        .join(gazetteer.select("type", "name").hint("shuffle_hash"), ["type", "name"], "left_semi")
    )


def name_key(kind: Column | str, name: Column | str) -> Column:
    return F.xxhash64(kind, name)


def hold_names(gazetteer: DataFrame) -> Broadcast | None:
    """The sorted keys of all names for :func:`~quillgraph.operators.relations.linked_chunks`; nothing if they are too many."""
    named = gazetteer.filter(F.col("type").isNotNull())
    if named.count() > HELD_NAMES:
        return None
    keys = named.select(name_key("type", "name").alias("key")).toArrow().column("key").to_numpy()
    return gazetteer.sparkSession.sparkContext.broadcast(np.sort(keys).tobytes())


def extract_entities_baseline(chunks: DataFrame, gazetteer: DataFrame, min_len: int = 8,
                              label: str = "lang") -> DataFrame:
    """Entities of each chunk found by dictionary (doc_id, bid, ordinal, pos, name, type)."""
    return first_mentions(mentions(chunks, gazetteer, min_len, label))


def first_mentions(mention_rows: DataFrame) -> DataFrame:
    """Distinct entities of each chunk; ``pos`` numbers them from 0 by first mention."""
    chunk = Window.partitionBy("doc_id", "bid", "ordinal").orderBy("_met")
    # One shuffle by chunk serves the grouping, the window and what is nested or joined by chunk.
    return (
        mention_rows.repartition("doc_id", "bid").groupBy("doc_id", "bid", "ordinal", "name")
        .agg(F.min("type").alias("type"), F.min(F.col("sent").cast("long") * ORDER_STRIDE + F.col("pos")).alias("_met"))
        .select("doc_id", "bid", "ordinal", (F.row_number().over(chunk) - 1).alias("pos"), "name", "type")
    )


def normalise_entities(raw: DataFrame, items: str = "items") -> DataFrame:
    """Entity lists as models write them, to (…, pos, name, type) rows.

    ``items`` is a JSON array of objects, pairs or bare strings.  Blank names go,
    and the first entry of each name in the chunk stays.
    """
    some = lambda *values: F.coalesce(*[F.nullif(v, F.lit("")) for v in values])

    def entry(e: Column) -> Column:
        pair = F.from_json(e, "array<string>")
        is_obj, is_pair = e.startswith("{"), e.startswith("[")
        name = (
            F.when(is_obj, some(F.get_json_object(e, "$.name"), F.get_json_object(e, "$.entity")))
            .when(is_pair, F.get(pair, F.lit(0))).otherwise(e))
        kind = (
            F.when(is_obj, some(F.get_json_object(e, "$.type"), F.get_json_object(e, "$.label")))
            .when(is_pair, some(F.get(pair, F.lit(1)))))
        return F.struct(
            strip(F.coalesce(name, F.lit(""))).alias("name"),
            strip(F.coalesce(kind, F.lit(UNKNOWN_LABEL))).alias("type"))

    listed = F.filter(
        F.transform(F.from_json(items, "array<string>"), entry), lambda e: e["name"] != "")
    return (
        raw.withColumn("_all", listed)
        .withColumn("_names", F.transform("_all", lambda e: e["name"]))
        .withColumn("_kept", F.filter("_all", lambda e, i: F.array_position(F.col("_names"), e["name"]) == i + 1))
        .drop(items, "_all", "_names")
        .transform(explode_indexed, "_kept", "pos", "_e")
        .select("*", F.col("_e.name").alias("name"), F.col("_e.type").alias("type"))
        .drop("_e")
    )


def unnest_entities(linked: DataFrame) -> DataFrame:
    """The rows of :func:`first_mentions` from :func:`~quillgraph.operators.relations.linked_chunks`."""
    return linked.select("doc_id", "bid", "ordinal", "names", "type").transform(
        explode_indexed, "names", "pos", "name").select("doc_id", "bid", "ordinal", "pos", "name", "type")


def build_entity_labels(chunk_entities: DataFrame) -> DataFrame:
    """Label of each name in a document: the first one seen in chunk order."""
    at = F.struct("ordinal", "pos")
    return chunk_entities.groupBy("doc_id", "name").agg(
        F.min_by("type", at).alias("label"),
        F.min(F.col("ordinal").cast("long") * ORDER_STRIDE + F.col("pos")).alias("first_pos"),
    )


def entities_by_label(labels: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Names under each label, to be read in ``first_pos`` order; ``wanted`` selects labels."""
    rows = labels.select("doc_id", "label", "first_pos", "name")
    return rows if wanted is None else rows.join(wanted, wanted.columns, "left_semi")


def label_of(names: DataFrame, labels: DataFrame) -> DataFrame:
    """Label of each (doc_id, name); unknown names get the default label."""
    known = labels.select("doc_id", "name", "label")
    return names.join(known, ["doc_id", "name"], "left").withColumn(
        "label", F.coalesce("label", F.lit(UNKNOWN_LABEL)))


def nest_entities(chunk_entities: DataFrame) -> DataFrame:
    """Each chunk's entities as one ordered array; a chunk bounds its size."""
    item = F.struct("pos", "name", "type")
    return chunk_entities.groupBy("doc_id", "bid").agg(F.transform(
        F.array_sort(F.collect_list(item)), lambda e: F.struct(e["name"], e["type"])).alias("entities"))
