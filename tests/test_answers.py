import random

import pytest
from pyspark.sql import functions as F

from quillgraph import schemas
from quillgraph.functions import text as tx
from quillgraph.functions.containment import contains_join
from quillgraph.operators import chunking, communities, entities, evidence, graph, incremental, progress, relations, retrieval


# -- retrieval -----------------------------------------------------------------

def test_embedding_is_unit_and_pluggable(spark):
    df = spark.createDataFrame([("a", "Hello  world hello"), ("b", "   ")], "bid string, text string")
    vec = retrieval.embed_chunks(df, dim=16).collect()
    assert [r.bid for r in vec] == ["a"] and sum(x * x for x in vec[0].embedding) == pytest.approx(1.0)
    sizes = retrieval.embed_chunks(df, lambda texts: [[3.0, 4.0] for _ in texts]).first()
    assert sizes.embedding == pytest.approx([0.6, 0.8])


def test_top_k_stays_in_document(spark):
    vectors = spark.createDataFrame(
        [("d", f"b{i}", [float(i), 1.0]) for i in range(20)] + [("e", "x", [9.0, 9.0])], "doc_id string, bid string, embedding array<double>")
    queries = spark.createDataFrame([("q", "d", [1.0, 0.0]), ("r", "e", [1.0, 0.0])], "query_id string, doc_id string, embedding array<double>")
    got = {}
    for r in retrieval.vector_top_k(queries, vectors, 2).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.bid)
    assert got == {"q": ["b19", "b18"], "r": ["x"]}


def test_each_query_is_sent_once(spark):
    vectors = spark.createDataFrame(
        [("d", f"b{i}", [float(i), 1.0]) for i in range(20)], "doc_id string, bid string, embedding array<double>")
    queries = spark.createDataFrame([("q", "d", [1.0, 0.0])], "query_id string, doc_id string, embedding array<double>")
    found = retrieval.vector_top_k(queries, vectors, 2)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    rows = lambda df: sorted(tuple(r) for r in df.select("query_id", "bid", "distance", "rank").collect())
    assert rows(found) == rows(retrieval.vector_top_k(queries, vectors, 2, salts=4))


def test_titles_are_put_in_behind_the_ranking(spark):
    rel = spark.createDataFrame(
        [("g", "b1", 1, i, s, t, "co", c, w, "extracted", None) for i, (s, t, c, w) in enumerate([
            ("alpha", "beta", "alpha meets beta", 0.9), ("beta", "gamma", None, 0.8), ("alpha", "beta", "once more", 0.7),
            ("gamma", "alpha", "far away", 0.1)])],
        "doc_id string, bid string, ordinal int, rel_idx int, source string, target string, relation string, "
        "context string, weight double, origin string, edit_id string")
    whole, (keyed, titles) = graph.build_edges(rel), graph.keyed_edges(rel)
    nodes = graph.build_nodes(keyed, None)
    assert sorted(r.node for r in nodes.collect()) == ["alpha", "beta", "gamma"]
    parts = nodes.select("graph_id", "node", F.lit(1).cast("long").alias("community_id"))
    asked = spark.createDataFrame([("q", "g", "who is alpha")], "query_id string, graph_id string, question string")
    vectors = retrieval.embed_chunks(spark.createDataFrame([("g", "b1", "alpha meets beta")], "doc_id string, bid string, text string"))
    said = lambda e, **more: [r.prompt for r in retrieval.hybrid_retrieve(asked, nodes, e, parts, vectors, **more)["contexts"].collect()]
    first = said(keyed, titles=titles)
    assert first == said(whole) and "context:once more" in first[0] and "far away" not in first[0]
    assert "title" not in retrieval.community_relations(
        retrieval.link_query_entities(asked, nodes), parts, keyed).columns


def test_rerank_by_score(spark):
    hits = spark.createDataFrame([("q", "one two", "b1", "nothing here", 0.1), ("q", "one two", "b2", "two of one", 0.9)],
                                 "query_id string, question string, bid string, text string, distance double")
    assert [r.bid for r in retrieval.rerank(hits).orderBy("rank").collect()] == ["b2", "b1"]
    custom = retrieval.rerank(hits, lambda q, t: [float(len(x)) for x in t], top_k=1)
    assert [r.bid for r in custom.collect()] == ["b1"]


def test_contains_join_matches_brute_force(spark):
    texts = ["abcd", "xbcx", "", "ab", "字中文字"]
    names = ["b", "bc", "bcd", "abcd", "中文", "zz", "ab"]
    left = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "k int, i int, text string")
    right = spark.createDataFrame([(1, n) for n in names], "k int, name string")
    got = sorted((r.text, r.name) for r in contains_join(left, right, ["k"], ["i"], "text", "name").collect())
    assert got == sorted((t, n) for t in texts for n in names if n in t)


def test_linked_entities_prefer_long_names(spark):
    nodes = spark.createDataFrame([("g", "刘备"), ("g", "备"), ("g", "曹操"), ("h", "诸葛亮")], "graph_id string, node string")
    asked = spark.createDataFrame([("q", "g", "刘备和诸葛亮是谁")], "query_id string, graph_id string, question string")
    assert [r.node for r in retrieval.link_query_entities(asked, nodes).orderBy("rank").collect()] == ["刘备", "备"]
    assert retrieval.link_query_entities(asked, nodes, cap=1).count() == 1


def _trade(spark):
    edges = spark.createDataFrame(
        [("g", "a", "b", "x", "t", 0.9), ("g", "b", "c", "y", "t", 0.2), ("g", "c", "d", "z", "t", 0.8), ("g", "a", "d", "w", "t", 0.7)],
        "graph_id string, source string, target string, label string, title string, weight double")
    parts = spark.createDataFrame([("g", n, c) for n, c in (("a", 1), ("b", 1), ("c", 2), ("d", 2))], schemas.COMMUNITIES)
    return edges, parts


def test_community_relations_span_chosen_communities(spark):
    edges, parts = _trade(spark)
    linked = spark.createDataFrame([("one", "g", "a"), ("two", "g", "a"), ("two", "g", "c"), ("none", "g", "zz")], "query_id string, graph_id string, node string")
    got = {}
    for top in (20, 0):
        got = {}
        for r in retrieval.community_relations(linked, parts, edges, 0.3, top).orderBy("rank").collect():
            got.setdefault(r.query_id, []).append(r.label)
        assert got == {"one": ["x"], "two": ["x", "z", "w"]}
    best = retrieval.community_relations(linked, parts, edges, 0.3, 1)
    assert {r.query_id: r.label for r in best.collect()} == {"one": "x", "two": "x"}
    line = retrieval.format_relations(edges.filter("label = 'x'")).first().sentence
    assert line == "Edge from a to b, Relation: x, context:t, weight:0.9"


def test_citation_kinds(spark):
    rel = spark.createDataFrame([("d", "b1", 1, 0, "实体一", "实体二", "包含", "依据", 0.8, None, "e1")], schemas.RELATIONS)
    labels = spark.createDataFrame([("d", "实体一", "概念", 0)], schemas.ENTITY_LABELS)
    hits = spark.createDataFrame([("q", 1, "b1", " 一段  文字 ")], "query_id string, rank int, bid string, text string")
    linked = spark.createDataFrame([("q", "d", "实体一", 1)], "query_id string, graph_id string, node string, rank int")
    rows = retrieval.build_citations(hits, linked, graph.graph_view(labels, rel)).collect()
    assert sorted((r.type, r.id) for r in rows) == [("graph", "graph-edge-e1"), ("graph", "graph-node-实体一"), ("source", "source-b1")]
    assert {r.preview for r in rows} == {"一段 文字", "图谱实体 · 概念", "依据"}
    assert retrieval.build_citations(hits, linked.limit(0), graph.graph_view(labels, rel)).count() == 1


def test_session_order_and_history(spark):
    asked = spark.createDataFrame([(i, "s" if i % 3 else "t", "d", 100 - i) for i in range(30)], "request_id int, session_id string, doc_id string, arrived_at int")
    rows = retrieval.order_session_requests(asked).filter("session_id = 't'").orderBy("turn").collect()
    assert [r.turn for r in rows] == list(range(10)) and [r.arrived_at for r in rows] == sorted(r.arrived_at for r in rows)
    turns = spark.createDataFrame([("user", None), ("assistant", "thinking"), ("system", None), ("assistant", "done")], "role string, state string")
    assert retrieval.clean_history(turns).count() == 3 and retrieval.clean_history(turns, drop_system=True).count() == 2


# -- evidence ------------------------------------------------------------------

def _kb(spark):
    chunks = spark.createDataFrame([("d", 1, "block-1", "刘备建立了蜀汉。", 1), ("d", 2, "block-2", "诸葛亮辅佐刘备。", 1)], schemas.CHUNKS)
    ents = spark.createDataFrame([("d", "block-1", 1, i, n, "x") for i, n in enumerate(["刘备", "蜀汉", "诸葛亮"])], schemas.CHUNK_ENTITIES)
    rel = spark.createDataFrame([
        ("d", "block-1", 1, 0, "刘备", "蜀汉", "建立", "刘备建立了蜀汉", 0.9, None, None),
        ("d", "block-2", 2, 0, "诸葛亮", "刘备", "辅佐", "诸葛亮辅佐刘备", 0.8, None, None)], schemas.RELATIONS)
    return chunks, ents, rel


def test_highlights_and_reuse(spark):
    chunks, ents, rel = _kb(spark)
    first = evidence.highlight_index(chunks, ents, rel)
    rows = {r.bid: r for r in first.collect()}
    assert rows["block-1"].entity_terms == ["刘备", "蜀汉"] and rows["block-1"].relation_terms == ["建立"]
    assert rows["block-2"].evidence_terms == ["诸葛亮辅佐刘备"]
    stats = evidence.highlight_stats(evidence.refresh_highlights(first.limit(0), chunks, ents, rel)).first()
    assert (stats.total_blocks, stats.reused_blocks, stats.rebuilt_blocks) == (2, 0, 2)
    edited = rel.withColumn("relation", F.when(F.col("bid") == "block-2", "共同辅佐").otherwise(F.col("relation")))
    # What is stored comes back as it was stored: terms of unchanged chunks are not looked for again.
    stored = first.withColumn("evidence_terms", F.array(F.lit("as stored")))
    again = evidence.refresh_highlights(stored, chunks, ents, edited)
    stats = evidence.highlight_stats(again).first()
    assert (stats.reused_blocks, stats.rebuilt_blocks) == (1, 1)
    assert {r.bid: r.evidence_terms for r in again.collect()} == {"block-1": ["as stored"], "block-2": ["诸葛亮辅佐刘备"]}


def test_refresh_works_out_its_sources_once(spark):
    chunks, ents, rel = _kb(spark)
    first = evidence.highlight_index(chunks, ents, rel)
    stale = first.withColumn("signature", F.lit("older")).withColumn("entity_terms", F.array(F.lit("not these")))
    again = evidence.refresh_highlights(stale.unionByName(first).unionByName(first), chunks, ents, rel)
    plan = again._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list(struct(rel_idx") == 4  # the three parts of the stored index, and the refresh
    assert sorted((r.bid, r.entity_terms, r.reused) for r in again.collect()) == sorted(
        (r.bid, r.entity_terms, True) for r in first.collect())
    assert evidence.refresh_highlights(stale, chunks, ents, rel).filter("reused").isEmpty()


def test_chunk_entities_are_nested_where_they_are_numbered(spark):
    met = spark.createDataFrame([("d", "b", 1, "en", 0, 1, "beta"), ("d", "b", 1, "en", 0, 0, "alpha")],
                                "doc_id string, bid string, ordinal int, type string, sent int, pos int, name string")
    nested = entities.nest_entities(entities.first_mentions(met))
    assert nested._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert [e.name for e in nested.first().entities] == ["alpha", "beta"]


def test_pronouns_are_not_highlighted(spark):
    chunks = spark.createDataFrame([("d", 1, "b", "我看到刘备建立了蜀汉，诸葛亮在场。", 1)], schemas.CHUNKS)
    ents = spark.createDataFrame([("d", "b", 1, i, n, "x") for i, n in enumerate(["我", "刘备", "蜀汉", "诸葛亮", "甲"])], schemas.CHUNK_ENTITIES)
    assert evidence.highlight_index(chunks, ents, spark.createDataFrame([], schemas.RELATIONS)).first().entity_terms == ["刘备", "蜀汉", "诸葛亮"]
    labels = spark.createDataFrame([("d", n, "x", i) for i, n in enumerate(["我", "蜀汉", "刘备", "曹操"])], schemas.ENTITY_LABELS)
    legacy = evidence.legacy_entities(chunks, ents.limit(0), labels).orderBy("pos")
    assert [r.name for r in legacy.collect()] == ["蜀汉", "刘备"]


def test_evidence_terms_and_blocks(spark):
    chunks, ents, rel = _kb(spark)
    refs = spark.createDataFrame([("r", "d", "block-2", "proof", 0.8)], "request_id string, doc_id string, bid string, evidence string, score double")
    index = evidence.highlight_index(chunks, ents, rel)
    got = {(r.kind, r.term) for r in evidence.evidence_terms(refs, index).collect()}
    assert ("entity_terms", "诸葛亮") in got and ("relation_terms", "辅佐") in got
    view = graph.graph_view(spark.createDataFrame([], schemas.ENTITY_LABELS), rel)
    inferred = {(r.kind, r.term) for r in evidence.inferred_terms(refs, graph.node_source_blocks(rel), view).collect()}
    assert inferred == {("entity_terms", "诸葛亮"), ("entity_terms", "刘备"), ("relation_terms", "辅佐"), ("evidence_terms", "诸葛亮辅佐刘备")}
    row = evidence.resolve_evidence(refs, chunks).first()
    assert (row.preview, row.occurrence, row.ordinal) == ("诸葛亮辅佐刘备。", 0, 2)


def test_chunk_and_term_places(spark):
    text = "Alpha  beta.\nGamma delta epsilon zeta.  Alpha beta."
    docs = spark.createDataFrame([("d", text)], "doc_id string, text string")
    chunks = spark.createDataFrame([
        ("d", 1, "b1", "alpha BETA.", 1), ("d", 2, "b2", "Alpha beta.", 1), ("d", 3, "b3", "Gamma delta epsilon zeta. Changed tail", 1), ("d", 4, "b4", "absent", 1)], schemas.CHUNKS)
    got = {r.bid: None if r.start is None else text[r.start:r.end] for r in evidence.locate_chunks(docs, chunks).collect()}
    assert got == {"b1": "Alpha  beta.", "b2": "Alpha beta.", "b3": "Gamma delta epsilon zeta.", "b4": None}
    one = spark.createDataFrame([("d", 1, "b", "New York City and york", 1)], schemas.CHUNKS)
    terms = spark.createDataFrame([("d", "b", "New York", "entity", 3), ("d", "b", "York", "entity", 3), ("d", "b", "York City and", "evidence", 1)],
                                  "doc_id string, bid string, term string, kind string, priority int")
    marks = [(r.matched, r.kind) for r in evidence.locate_terms(one, terms).orderBy("match_no").collect()]
    assert marks == [("New York", "entity"), (" City and", "evidence"), ("york", "entity")]


# -- incremental ---------------------------------------------------------------

def test_chunk_diff_and_update(spark):
    old = spark.createDataFrame([("d", i + 1, f"b{i}", t, 1) for i, t in enumerate(["one two.", "three four.", "five six."])], schemas.CHUNKS)
    new = spark.createDataFrame([("d", "one\n two. fresh text! five six. tail"), ("e", "whole new")], "doc_id string, text string")
    marked, gaps = incremental.diff_chunks(old, new)
    assert {r.bid: r.kept for r in marked.collect()} == {"b0": True, "b1": False, "b2": True}
    assert sorted((r.doc_id, r.gap_no, r.text) for r in gaps.collect()) == [("d", 0, "fresh text!"), ("d", 1, "tail"), ("e", 0, "whole new")]
    added = incremental.added_chunks(gaps, old)
    assert sorted((r.doc_id, r.ordinal, r.text) for r in added.collect()) == [("d", 4, "fresh text!"), ("d", 5, "tail"), ("e", 1, "whole new")]
    rest = incremental.apply_update({"chunks": old}, marked, {"chunks": added})["chunks"]
    assert sorted(r.text for r in rest.filter("doc_id = 'd'").collect()) == ["five six.", "fresh text!", "one two.", "tail"]


def test_resume_after_finished_chunks(spark):
    chunks = spark.createDataFrame([(d, i, f"{d}{i}", t, 1) for d in "ab" for i, t in ((1, "第一块"), (2, "第二块"), (3, "第三块"))], schemas.CHUNKS)
    done = chunks.filter("ordinal = 1 and doc_id = 'a'").union(chunks.filter("ordinal = 2 and doc_id = 'b'"))
    todo, rejects = incremental.remaining_chunks(chunks, done)
    assert sorted(r.bid for r in todo.collect()) == ["a2", "a3"] and [r.doc_id for r in rejects.collect()] == ["b"]


# -- progress ------------------------------------------------------------------

def _events(spark, *extra):
    rows = [("j", 1, "entity_extraction", 1, 2, 2.0), ("j", 2, "entity_extraction", 2, 2, 2.0), ("j", 3, "relationship_extraction", 1, 2, 1.0),
            ("j", 4, "relationship_extraction", 2, 2, 1.0), ("j", 5, "knowledge_fusion", 0, 2, 0.0), *extra]
    return spark.createDataFrame(rows, schemas.STAGE_EVENTS)


@pytest.mark.parametrize("extra, overall, eta", [
    ([], 66.7, 3.0), ([("j", 6, "knowledge_fusion", 1, 2, 3.0)], 83.3, 3.0),
    ([("j", 6, "knowledge_fusion", 1, 2, 3.0), ("j", 7, "knowledge_fusion", 2, 2, 3.0)], 100.0, 0.0)])
def test_stage_and_overall_progress(spark, extra, overall, eta):
    stages = progress.stage_progress(_events(spark, *extra))
    by = {r.stage: r for r in stages.collect()}
    assert by["entity_extraction"].items_per_minute == 30.0 and by["relationship_extraction"].average_item_seconds == 1.0
    total = progress.overall_progress(stages).first()
    assert (total.overall_percentage, total.estimated_total_remaining_seconds) == (overall, eta)


def test_unknown_totals_have_no_eta(spark):
    row = progress.overall_progress(progress.stage_progress(_events(spark).filter("seq = 1"))).first()
    assert (row.overall_percentage, row.estimated_total_remaining_seconds) == (16.7, None)


def test_repeated_counter_is_no_sample(spark):
    events = spark.createDataFrame([("j", i, "entity_extraction", c, 9, 1.0) for i, c in enumerate([1, 1, 3, 2, 3])], schemas.STAGE_EVENTS)
    row = progress.stage_progress(events).first()
    assert (row.sample_count, row.cumulative_seconds, row.completed) == (3, 3.0, 3)


def test_ordered_index_over_one_hot_key(spark):
    df = spark.range(5000).select(F.lit("k").alias("k"), (F.col("id") * 7919 % 5000).alias("v"))
    got = communities.ordered_index(df, ["k"], [F.col("v")], "i")
    assert got.filter("i <> v").count() == 0 and got.count() == 5000


def test_publish_points(spark):
    steps = spark.createDataFrame([(i, 25, i == 7) for i in range(1, 26)], "completed int, total int, paused boolean")
    assert [r.completed for r in progress.publish_points(steps).collect()] == [7, 10, 20, 25]


def test_text_helpers(spark):
    df = spark.createDataFrame([("a \n b　c ",), ("",)], "t string")
    assert [r[0] for r in df.select(tx.normalize_ws(F.col("t"))).collect()] == ["a b c", ""]
    assert [r[0] for r in df.select(tx.text_quality(F.lit("汉a\u0001"))).collect()][0] == pytest.approx((3 + 0.2 - 12) / 3)
    batches = chunking.batch_items(spark.range(45).withColumn("k", F.lit(1)), ["k"], ["id"], 20)
    assert batches.groupBy("item_batch").count().orderBy("item_batch").collect()[-1]["count"] == 5


def test_ranges_of_terms_compete_by_priority(spark):
    text = "Alpha  beta\tGAMMA delta; alpha beta"
    chunk = spark.createDataFrame([("d", 1, "b", text, 5)], schemas.CHUNKS)
    terms = [("alpha beta", "low", 1), ("beta gamma", "high", 3), ("beta", "mid", 2), ("eta", "mid", 2), ("", "none", 9), ("missing", "none", 9)]
    df = spark.createDataFrame([("d", "b", *t) for t in terms], "doc_id string, bid string, term string, kind string, priority int")
    got = [(r.matched, r.kind) for r in evidence.locate_terms(chunk, df).orderBy("match_no").collect()]
    assert got == [("Alpha  ", "low"), ("beta\tGAMMA", "high"), ("alpha ", "low"), ("beta", "mid")]


@pytest.mark.parametrize("seed", range(20))
def test_sweep_equals_painting(seed):
    rng = random.Random(seed)
    ranges = [(s, s + rng.randint(1, 9), rank) for rank, s in enumerate(rng.randrange(30) for _ in range(rng.randint(0, 12)))]
    owner = {p: min(r for s, e, r in ranges if s <= p < e) for p in range(40) if any(s <= p < e for s, e, _ in ranges)}
    found = evidence._sweep(ranges)
    assert {p: r for s, e, r in found for p in range(s, e)} == owner
    assert all(a[1] < b[0] or a[2] != b[2] for a, b in zip(found, found[1:]))


def test_folded_offsets():
    folded = evidence._Folded(" \n A\u00a0\u2003B İstanbul  ")
    assert folded.text == " \n A\u00a0\u2003B İstanbul  ".lower().split()[0] + " b i̇stanbul"
    assert [folded.range(folded.text.find(w), len(w)) for w in ("a", "b", "i̇stanbul")] == [(3, 4), (6, 7), (8, 16)]
    assert evidence._Folded("").text == "" and evidence._Folded(" \t").text == ""


@pytest.mark.parametrize("seed", range(30))
def test_chunk_cover_equals_one_removal_after_another(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(1, 3)))
    text = " ".join(word() for _ in range(rng.randint(0, 40)))
    chunks = [text[i: i + rng.randint(0, 30)] for i in (rng.randrange(len(text) + 1) for _ in range(12))] + ["absent", "", "abab"]
    rng.shuffle(chunks)
    rest = text
    for chunk in chunks:
        if chunk:
            rest = rest.replace(chunk, "\1", 1)
    found = incremental._cover(text, chunks)
    assert found["kept"] == [c in text for c in chunks] and found["gaps"] == rest.split("\1")


def test_cover_of_many_chunks_takes_one_pass():
    """50,000 chunks of one document; a search for each through the whole text would take hours."""
    lines = [f"line number {i} of a long document" for i in range(50_000)]
    found = incremental._cover("\n".join(lines[::2] + ["new end"]), lines)
    assert sum(found["kept"]) == 25_000 and "".join(found["gaps"]).strip() == "new end"


@pytest.mark.parametrize("most", [1, 2, 100])
def test_contains_join_in_parts(spark, most):
    rng = random.Random(most)
    word = lambda n: "".join(rng.choice("abc") for _ in range(rng.randint(0, n)))
    texts = [(k, i, word(30)) for i, k in enumerate(rng.choices([1, 1, 2, None], k=40))]
    names = list({(rng.choice([1, 2, 3, None]), word(4), n % 2) for n in range(40)})
    left = spark.createDataFrame(texts, "k int, i int, text string")
    right = spark.createDataFrame(names, "k int, name string, kind int")
    got = [(r.k, r.i, r.name, r.kind) for r in contains_join(left, right, ["k"], ["i"], "text", "name", most, most).collect()]
    assert sorted(got) == sorted((k, i, n, kind) for k, i, t in texts for j, n, kind in names if k is not None and k == j and n and n in t)


def test_folded_texts_without_moved_characters_need_no_map():
    """The short way and the map agree; a final sigma, a dotted capital I or doubled blanks take the map."""
    for raw in ("Quiet  waters", " lead", "tail ", "\u03a3\u03a3 x\u03a3", "\u0130zmir", ""):
        slow = evidence._Folded(raw)
        assert (slow.at is None) == (raw == "")
    for raw in ("Quiet Waters run\tDEEP", "\u00c4\u00df\u4e2d\u3000b", "one"):
        quick, whole = evidence._Folded(raw), evidence._Folded(raw + "  \u0130")
        assert quick.at is None and whole.text.startswith(quick.text)
        assert [quick.range(i, 2) for i in range(len(raw) - 1)] == [whole.range(i, 2) for i in range(len(raw) - 1)]


def test_lost_chunks_are_found_by_their_longest_sentence():
    raw = "Opening words. The ferry leaves the northern pier at dawn. Short one."
    blocks = ["Opening words.", "Gone! The ferry leaves the northern pier at dawn. More text", "tiny. bits."]
    found = [(r["start"], r["end"]) for r in evidence._chunk_ranges(raw, blocks)]
    assert found == [(0, 14), (15, 58), (None, None)]


def test_sources_in_the_chunks_own_row_equal_the_joined_ones(spark):
    """Highlights need no join by chunk; chunks without names or language stay, with nothing to mark."""
    texts = ["Lanterns brighten harbours. Harbours brighten lanterns.", "nothing here", "brighten", ""]
    chunks = spark.createDataFrame(
        [("d", f"b{i}", i, None if i == 4 else "en", text) for i, text in enumerate([*texts, texts[0]])],
        "doc_id string, bid string, ordinal int, lang string, text string")
    names = spark.createDataFrame([("en", n) for n in ("lanterns", "brighten", "harbours")], "type string, name string")
    met = entities.mentions(chunks, names)
    rel = relations.unnest_relations(relations.nested_relations_baseline(chunks, met))
    linked = relations.linked_chunks(chunks, entities.hold_names(names), whole=True)
    own = evidence.signed_sources(relations.linked_sources(linked))
    joined = evidence.highlight_sources(chunks, entities.first_mentions(met), rel)
    rows = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert rows(own) == rows(joined) and len(rows(own)) == 5
    stored = evidence.build_highlights(own)
    assert {r.reused for r in evidence.refresh_sources(stored, own).collect()} == {True}
