"""Relations: request planning, validation, deduplication, fusion."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F

from quillgraph.functions.arrays import explode_indexed
from quillgraph.functions.text import strip
from quillgraph.operators.chunking import relation_batches, sentences
from quillgraph.operators.entities import ORDER_STRIDE, long_words, name_key, nest_entities
from quillgraph.session import materialise

SOURCE_BATCH = 20
MAX_SPLIT_DEPTH = 10
MIN_SPLIT_CHARS = 200
DEFAULT_WEIGHT = 0.5

_REL = ["source", "target", "relation", "context"]


# -- request planning ---------------------------------------------------------

def relation_candidates(chunks: DataFrame, chunk_entities: DataFrame, max_chars: int = 2000) -> DataFrame:
    """Text batches of each chunk with the chunk entities they literally contain.

    Batches with fewer than two candidates are dropped.  Names and batches of one
    chunk meet inside its row, so no pair rows are built.
    """
    nested = nest_entities(chunk_entities).filter(F.size("entities") >= 2)
    return (
        chunks.join(nested, ["doc_id", "bid"])
        .withColumn("_batches", relation_batches(F.col("text"), max_chars))
        .select("doc_id", "bid", "ordinal", "entities", "_batches")
        .transform(explode_indexed, "_batches", "batch_no", "text")
        .withColumn("candidates", F.filter(
            F.transform("entities", lambda e: e["name"]), lambda n: F.contains(F.col("text"), n)))
        .filter(F.size("candidates") >= 2)
        .drop("entities")
    )


def plan_relation_requests(candidates: DataFrame, batch: int = SOURCE_BATCH) -> DataFrame:
    """One request per text batch and batch of sources; every request lists all candidates."""
    slices = F.transform(
        F.sequence(F.lit(0), F.ceil(F.size("candidates") / batch).cast("int") - 1),
        lambda k: F.slice(F.col("candidates"), k * batch + 1, F.lit(batch)))
    return (
        candidates.withColumn("_slices", slices)
        .transform(explode_indexed, "_slices", "source_batch", "sources")
        .withColumn("request_id", F.concat_ws(
            "/", "bid", F.lpad(F.col("batch_no").cast("string"), 4, "0"),
            F.lpad(F.col("source_batch").cast("string"), 4, "0")))
        .withColumn("depth", F.lit(0))
        .drop("batch_no", "source_batch")
    )


def plan_retry_requests(failed: DataFrame, max_depth: int = MAX_SPLIT_DEPTH) -> DataFrame:
    """Smaller requests for answers that were cut off or malformed.

    Several sources are halved; a single source has its text split instead.  Rows
    with ``error`` set can be split no further.
    """
    many = F.size("sources") > 1
    middle = F.floor(F.size("sources") / 2).cast("int")
    part = lambda t, c, s: F.struct(t.alias("text"), c.alias("candidates"), s.alias("sources"))
    halves = F.array(
        part(F.col("text"), F.col("candidates"), F.slice("sources", F.lit(1), middle)),
        part(F.col("text"), F.col("candidates"), F.slice("sources", middle + 1, F.size("sources") - middle)))
    limit = F.greatest(F.lit(MIN_SPLIT_CHARS), F.floor(F.length("text") / 2).cast("int"))
    within = lambda names, t: F.filter(names, lambda n: F.contains(t, n))
    texts = F.when(~many, relation_batches(F.col("text"), limit))
    staged = failed.withColumn("_texts", texts)
    smaller = F.filter(
        F.transform("_texts", lambda t: part(t, within(F.col("candidates"), t), within(F.col("sources"), t))),
        lambda p: (F.size(p.candidates) >= 2) & (F.size(p.sources) >= 1))
    error = (
        F.when(F.col("depth") >= max_depth, "depth_limit")
        .when(~many & (F.size("_texts") <= 1), "unsplittable"))
    keep = F.array(part(F.col("text"), F.col("candidates"), F.col("sources")))
    others = [c for c in failed.columns if c not in {"request_id", "depth", "text", "candidates", "sources", "error"}]
    return (
        staged.withColumn("error", error)
        .withColumn("_parts", F.when(F.col("error").isNotNull(), keep).when(many, halves).otherwise(smaller))
        .select("request_id", "depth", "error", *others, "_parts")
        .transform(explode_indexed, "_parts", "_i", "_part")
        .select(
            F.when(F.col("error").isNull(), F.concat(
                F.col("request_id"), F.lit("."), F.lpad(F.col("_i").cast("string"), 4, "0")))
            .otherwise(F.col("request_id")).alias("request_id"),
            F.when(F.col("error").isNull(), F.col("depth") + 1).otherwise(F.col("depth")).alias("depth"),
            "error", *others, "_part.text", "_part.candidates", "_part.sources")
    )


def run_relation_requests(requests: DataFrame, ask: Callable[[DataFrame], DataFrame],
                          max_depth: int = MAX_SPLIT_DEPTH) -> tuple[DataFrame, DataFrame]:
    """Ask, split what failed, ask again; returns answered requests and final errors.

    ``ask`` adds ``items`` (JSON list of relations, null on failure).  The number
    of rounds is bounded by ``max_depth``; each round is one distributed pass.
    """
    answered: DataFrame | None = None
    errors: DataFrame | None = None
    pending = requests
    for _ in range(max_depth + 1):
        asked = materialise(ask(pending))
        good = asked.filter(F.col("items").isNotNull())
        answered = good if answered is None else answered.unionByName(good)
        retry = materialise(plan_retry_requests(asked.filter(F.col("items").isNull()).drop("items"), max_depth))
        dead = retry.filter(F.col("error").isNotNull())
        errors = dead if errors is None else errors.unionByName(dead)
        pending = retry.filter(F.col("error").isNull()).drop("error")
        if pending.isEmpty():
            break
    return answered, errors


# -- validation and deduplication ---------------------------------------------

def to_weight(value: Column) -> Column:
    """Number or numeric text as a double; anything else is the default weight."""
    return F.coalesce(F.nanvl(value.try_cast("double"), F.lit(DEFAULT_WEIGHT)), F.lit(DEFAULT_WEIGHT))


def clamp_weight(weight: Column) -> Column:
    safe = F.coalesce(F.nanvl(weight, F.lit(DEFAULT_WEIGHT)), F.lit(DEFAULT_WEIGHT))
    return F.least(F.greatest(safe, F.lit(0.5)), F.lit(1.0))


def _text_field(item: Column, name: str) -> Column:
    """A JSON field only if it really is a string."""
    kind = F.schema_of_variant(F.try_variant_get(item, f"$.{name}", "variant"))
    return F.when(kind == "STRING", F.try_variant_get(item, f"$.{name}", "string"))


def validate_relations(answers: DataFrame) -> DataFrame:
    """Relations of answered requests with a reject reason (null when accepted).

    ``answers``: request rows with ``items`` (JSON list), ``candidates`` and
    ``sources``.
    """
    item = F.try_parse_json("_item")
    rows = (
        answers.withColumn("_items", F.from_json("items", "array<string>"))
        .drop("items", "text")
        .transform(explode_indexed, "_items", "pos", "_item")
        .withColumn("_v", item)
    )
    fields = {name: strip(F.coalesce(_text_field(F.col("_v"), name), F.lit(""))) for name in _REL}
    weight = to_weight(F.try_variant_get("_v", "$.weight", "string"))
    reason = (
        F.when(~F.coalesce(F.ltrim("_item").startswith("{"), F.lit(False)) | F.col("_v").isNull(), "not_an_object")
        .when(F.exists(F.array(*_REL), lambda v: v == ""), "incomplete")
        .when(~F.array_contains("candidates", F.col("source"))
              | ~F.array_contains("candidates", F.col("target")), "unknown_entity")
        .when(~F.array_contains("sources", F.col("source")), "other_source_batch")
    )
    return (
        rows.withColumns(fields)
        .withColumn("weight", clamp_weight(weight))
        .withColumn("reject_reason", reason)
        .drop("_item", "_v", "candidates", "sources")
    )


def dedup_relations(rel: DataFrame, order: str = "pos") -> DataFrame:
    """One relation per chunk, endpoints, name and context: the heaviest, first on a tie.

    ``rel_idx`` numbers a chunk's relations by first appearance.
    """
    key = ["doc_id", "bid", *_REL]
    rest = [c for c in rel.columns if c not in {*key, order, "rel_idx"}]
    best = rel.groupBy(*key).agg(
        F.max_by(F.struct(*rest), F.struct(F.col("weight"), -F.col(order))).alias("_best"),
        F.min(order).alias("_first"))
    chunk = Window.partitionBy("doc_id", "bid").orderBy("_first")
    return best.select(*key, "_best.*", (F.row_number().over(chunk) - 1).alias("rel_idx"))


def extract_relations_baseline(chunks: DataFrame, mention_rows: DataFrame) -> DataFrame:
    """Offline relations between neighbouring entity mentions of one sentence.

    A sentence with n mentions gives at most n - 1 relations.  The context is the
    sentence of the first meeting; each further meeting in the chunk adds 0.1.
    """
    return unnest_relations(nested_relations_baseline(chunks, mention_rows))


def nested_relations_baseline(chunks: DataFrame, mention_rows: DataFrame) -> DataFrame:
    """The baseline relations as one row per chunk: its pairs in order, and its trimmed sentences once.

    A long sentence is the context of many relations; this form stores it once.
    """
    sentence = Window.partitionBy("doc_id", "bid", "ordinal", "sent").orderBy("pos")
    listed = (
        # One shuffle by chunk serves the window, both groupings and the join below.
        mention_rows.repartition("doc_id", "bid")
        .withColumn("source", F.lag("name").over(sentence))
        .filter(F.col("source") != F.col("name"))
        .groupBy("doc_id", "bid", "ordinal", "source", F.col("name").alias("target"))
        .agg(F.min(F.col("sent").cast("long") * ORDER_STRIDE + F.col("pos")).alias("at"), F.count("*").alias("n"))
        .groupBy("doc_id", "bid", "ordinal")
        .agg(F.array_sort(F.collect_list(F.struct("at", "source", "target", "n"))).alias("pairs"))
    )
    return (
        listed.join(chunks.select("doc_id", "bid", "text"), ["doc_id", "bid"])
        .select("doc_id", "bid", "ordinal", "pairs", F.transform(sentences(F.col("text")), strip).alias("sentences"))
    )


def unnest_relations(nested: DataFrame) -> DataFrame:
    """One row per relation of :func:`nested_relations_baseline`."""
    sent = F.shiftright(F.col("_r.at"), 32).cast("int")
    return (
        nested.select("*", F.posexplode_outer("pairs").alias("rel_idx", "_r")).filter(F.col("rel_idx").isNotNull())
        .select(
            "doc_id", "bid", "ordinal", "rel_idx", "_r.source", "_r.target",
            F.lit("co-occurs").alias("relation"), F.get("sentences", sent).alias("context"),
            F.least(F.lit(1.0), F.lit(0.5) + F.lit(0.1) * (F.col("_r.n") - 1)).alias("weight"),
            F.lit("extracted").alias("origin"), F.lit(None).cast("string").alias("edit_id"))
    )


_LINKED = ("struct<names:array<string>,source:array<int>,target:array<int>,n:array<int>,said:array<int>,used:array<int>>")


def linked_chunks(chunks: DataFrame, names: Broadcast, min_len: int = 8, label: str = "lang", whole: bool = False) -> DataFrame:
    """Entities and baseline relations of every chunk, worked out in its own row; chunks without entities vanish.

    With ``whole`` they stay, and every row keeps its ``text``.

    ``names`` are the keys of :func:`~quillgraph.operators.entities.hold_names`: words are looked up in the
    task that reads the text, by 64 bits of hash, so neither words nor mentions are sent.  Each row is one chunk:
    ``names`` its distinct entities by first mention, ``source`` and ``target`` places in them, ``n`` how often
    the pair meets, ``said`` the place of its sentence in ``contexts``, which holds every quoted sentence once.
    Rows of one chunk are not merged: (doc_id, bid) must be unique.
    """

    @F.arrow_udf(_LINKED)
    def link(words: pa.Array, keys: pa.Array) -> pa.Array:
        known = np.frombuffer(names.value, np.int64)
        rows, per_row, sents = len(words), words.value_lengths().to_numpy(), words.flatten()
        per_sent = sents.value_lengths().to_numpy()
        asked = keys.flatten().to_numpy()
        at = np.searchsorted(known, asked)
        found = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == asked) if len(known) else np.zeros(0, np.int64)
        sent = np.repeat(np.arange(len(per_sent)), per_sent)[found]           # sentences are numbered through the batch
        row_of, first_sent = np.repeat(np.arange(rows), per_row), np.cumsum(per_row) - per_row
        row = row_of[sent]
        coded = sents.flatten().take(pa.array(found)).dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64)

        def listed(owner: np.ndarray, values: pa.Array) -> pa.Array:
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=rows))])
            return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)

        def starts(owner: np.ndarray) -> np.ndarray:
            count = np.bincount(owner, minlength=rows)
            return np.cumsum(count) - count

        def ordered(keyed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Distinct values by first appearance: where, how often, and the place of every value among them."""
            _, first, back, count = np.unique(keyed, return_index=True, return_inverse=True, return_counts=True)
            order = np.argsort(first)
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            return first[order], count[order], place[back]

        # Mentions come in order of chunk, sentence and place, and so do the first ones.
        first, _, entity = ordered(row * max(len(coded.dictionary), 1) + code)
        local = entity - starts(row[first])[row]
        then = np.flatnonzero((sent[1:] == sent[:-1]) & (entity[1:] != entity[:-1])) + 1
        met, count, _ = ordered(entity[then - 1] * max(len(first), 1) + entity[then])
        pair = then[met]
        new = np.diff(sent[pair], prepend=-1) != 0
        used = sent[pair[new]]
        quoted = np.cumsum(new) - 1
        of_pair = row[pair]
        ints = lambda values: pa.array(values.astype(np.int32))
        return pa.StructArray.from_arrays([
            listed(row[first], coded.dictionary.take(pa.array(code[first]))),
            listed(of_pair, ints(local[pair - 1])), listed(of_pair, ints(local[pair])), listed(of_pair, ints(count)),
            listed(of_pair, ints(quoted - starts(row_of[used])[of_pair])),
            listed(row_of[used], ints(used - first_sent[row_of[used]])),
        ], names=["names", "source", "target", "n", "said", "used"])

    kind, kept = F.col(label), ["text"] if whole else []
    named = chunks if whole else chunks.filter(kind.isNotNull())
    per_sent = F.transform("_sents", lambda s: long_words(s, min_len))
    linked = (
        named.select("doc_id", "bid", "ordinal", kind.alias("type"), *kept, sentences(F.col("text")).alias("_sents"))
        .withColumn("_words", F.when(F.col("type").isNotNull(), per_sent).otherwise(F.array().cast("array<array<string>>")))
        .withColumn("_keys", F.transform(F.flatten("_words"), lambda w: name_key("type", w)))
        .withColumn("_l", link("_words", "_keys"))
    )
    return (linked if whole else linked.filter(F.size("_l.names") > 0)).select(
        "doc_id", "bid", "ordinal", "type", *kept, "_l.names", "_l.source", "_l.target", "_l.n", "_l.said",
        F.transform("_l.used", lambda i: strip(F.get("_sents", i))).alias("contexts"))


def _linked_weight(n: Column) -> Column:
    return F.least(F.lit(1.0), F.lit(0.5) + F.lit(0.1) * (n - 1))


def linked_sources(linked: DataFrame) -> DataFrame:
    """Whole :func:`linked_chunks` with their entities and relations as arrays, null where a chunk has none."""
    some = lambda items: F.when(F.size(items) > 0, items)
    ents = F.transform("names", lambda n: F.struct(n.alias("name"), F.col("type").alias("type")))
    rels = F.transform(F.arrays_zip("source", "target", "n", "said"), lambda r: F.struct(
        F.get("names", r["source"]).alias("source"), F.get("names", r["target"]).alias("target"), F.lit("co-occurs").alias("relation"),
        F.get("contexts", r["said"]).alias("context"), _linked_weight(r["n"]).alias("weight")))
    return linked.select("doc_id", "bid", "ordinal", "text", some(ents).alias("entities"), some(rels).alias("relations"))


def unnest_linked(linked: DataFrame) -> DataFrame:
    """The rows of :func:`unnest_relations` from :func:`linked_chunks`."""
    return (
        linked.select("doc_id", "bid", "ordinal", "names", "contexts",
                      F.posexplode_outer(F.arrays_zip("source", "target", "n", "said")).alias("rel_idx", "_r"))
        .filter(F.col("rel_idx").isNotNull())
        .select(
            "doc_id", "bid", "ordinal", "rel_idx", F.get("names", "_r.source").alias("source"),
            F.get("names", "_r.target").alias("target"), F.lit("co-occurs").alias("relation"),
            F.get("contexts", "_r.said").alias("context"),
            _linked_weight(F.col("_r.n")).alias("weight"),
            F.lit("extracted").alias("origin"), F.lit(None).cast("string").alias("edit_id"))
    )


# -- fusion -------------------------------------------------------------------

def _pair() -> list[Column]:
    return [F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")]


def fusion_groups(rel: DataFrame) -> DataFrame:
    """Unordered entity pairs with their relation count and first position."""
    return rel.groupBy("doc_id", *_pair()).agg(
        F.count("*").alias("n_relations"),
        F.min(F.struct("ordinal", "rel_idx")).alias("first_at"))


def strongest(rel: DataFrame) -> DataFrame:
    """Built-in fuser: the heaviest relation of each pair, first on a tie."""
    pick = F.struct(*_REL, "weight")
    order = F.struct("weight", -F.col("ordinal"), -F.col("rel_idx"))
    return rel.groupBy("doc_id", *_pair()).agg(F.max_by(pick, order).alias("f")).select("doc_id", "a", "b", "f.*")


def fuse_relations(rel: DataFrame, fuser: Callable[[DataFrame], DataFrame] = strongest,
                   enabled: bool = True) -> DataFrame:
    """Pairs with several relations get the fuser's short list on every contributing row.

    Single relations pass through.  ``fuser`` maps relation rows to fused rows
    keyed by (doc_id, a, b); the default keeps one, so the result never exceeds
    the input.
    """
    if not enabled:
        return rel
    keyed = rel.select("*", *_pair())
    groups = fusion_groups(rel).select("doc_id", "a", "b", "n_relations")
    counted = keyed.join(groups, ["doc_id", "a", "b"])
    single = counted.filter(F.col("n_relations") == 1).select(*rel.columns)
    many = counted.filter(F.col("n_relations") > 1)
    fused = fuser(many.select(*rel.columns))
    kept = [c for c in rel.columns if c not in {*_REL, "weight"}]
    attached = many.select("a", "b", *kept).join(fused, ["doc_id", "a", "b"])
    return single.unionByName(attached.select(*rel.columns))


def strongest_per_relation(rel: DataFrame) -> DataFrame:
    """Relations merged by endpoints and name, each on the rows that named it."""
    key = ["doc_id", "source", "target", "relation"]
    best = rel.groupBy(*key).agg(F.max_by(
        F.struct("context", "weight"),
        F.struct("weight", -F.col("ordinal"), -F.col("rel_idx"))).alias("_f"))
    rest = [c for c in rel.columns if c not in {"context", "weight"}]
    return rel.select(*rest).join(best, key).select(
        *rest, F.col("_f.context").alias("context"), F.col("_f.weight").alias("weight")).select(*rel.columns)


def format_fused(raw: DataFrame, items: str = "items") -> DataFrame:
    """Rows of a fuser's JSON list that have the four fields; the weight is not clamped."""
    shape = F.from_json(F.col("_item"), "source string, target string, relation string, context string, weight string")
    keys = F.json_object_keys("_item")
    return (
        raw.withColumn("_items", F.from_json(items, "array<string>")).drop(items)
        .transform(explode_indexed, "_items", "rel_idx", "_item")
        .filter(F.size(F.array_intersect(keys, F.array(*[F.lit(k) for k in _REL]))) == 4)
        .withColumn("_r", shape)
        .select("*", *[F.col(f"_r.{name}").alias(name) for name in _REL],
                F.coalesce(F.col("_r.weight").try_cast("double"), F.lit(DEFAULT_WEIGHT)).alias("weight"))
        .drop("_item", "_r")
    )


def render_fusion_input(rel: DataFrame, chunks_per_text: int | None = None) -> DataFrame:
    """Text form of each pair's relations for a fusion model: one text per pair.

    A model with a limit on its input asks for parts of ``chunks_per_text`` chunks each;
    the caller then merges the lists of a pair's parts and fuses them once more.
    """
    line = F.concat(
        F.lit("- "), F.col("relation"), F.lit("（上下文："), F.col("context"),
        F.lit("，权重："), F.col("weight").cast("string"), F.lit("）\n"))
    part = F.lit(0) if chunks_per_text is None else F.floor(F.col("ordinal") / chunks_per_text)
    grouped = rel.groupBy(
        "doc_id", *_pair(), part.cast("int").alias("part")
    ).agg(
        F.count("*").alias("n_relations"),
        F.array_sort(F.collect_list(F.struct("ordinal", "rel_idx", line.alias("line")))).alias("_lines"))
    return grouped.select(
        "doc_id", "a", "b", "part", "n_relations",
        F.concat(
            F.lit("实体1："), F.col("a"), F.lit("\n实体2："), F.col("b"), F.lit("\n现有关系：\n"),
            F.array_join(F.transform("_lines", lambda l: l.line), "")).alias("text"))


# -- per-chunk records --------------------------------------------------------

def build_chunk_records(chunks: DataFrame, chunk_entities: DataFrame, rel: DataFrame,
                        entity_done: DataFrame, relation_done: DataFrame) -> DataFrame:
    """Nested entities and relations of the chunks for which both passes are complete."""
    key = ["doc_id", "bid"]
    complete = (
        chunks.select("doc_id", "ordinal", "bid")
        .join(entity_done.select(*key), key, "left_semi")
        .join(relation_done.select(*key), key, "left_semi"))
    ents = nest_entities(chunk_entities)
    rels = rel.groupBy(*key).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rel_idx", *_REL, "weight"))),
        lambda r: F.struct(*[r[c].alias(c) for c in (*_REL, "weight")])).alias("relation"))
    empty = lambda col, kind: F.coalesce(F.col(col), F.array().cast(kind)).alias(col)
    rel_type = "array<struct<source:string,target:string,relation:string,context:string,weight:double>>"
    return complete.join(ents, key, "left").join(rels, key, "left").select(
        "doc_id", "ordinal", "bid",
        empty("entities", "array<struct<name:string,type:string>>"), empty("relation", rel_type))
