import codecs

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import chunking
from quillgraph.sources import chats, corpus, layout, markdown, packages, store
from quillgraph.sources.store import KnowledgeBase


def test_decodes_common_encodings(spark):
    cases = {
        "utf8": ("潮汐表".encode(), "潮汐表", "utf-8"),
        "gb": ("潮汐表：每日两次，港口开放。".encode("gb18030"), "潮汐表：每日两次，港口开放。", "gb18030"),
        "big5": ("潮汐表：港口開放，漁船離岸。".encode("big5"), "潮汐表：港口開放，漁船離岸。", "big5"),
        "utf16": (codecs.BOM_UTF16_LE + "潮汐表".encode("utf-16-le"), "潮汐表", "utf-16"),
        "sig": (codecs.BOM_UTF8 + "潮汐表".encode(), "潮汐表", "utf-8-sig"),
        "empty": (b"", "", "utf-8"),
    }
    df = spark.createDataFrame([(k, bytearray(v[0])) for k, v in cases.items()], "doc_id string, content binary")
    got = {r.doc_id: (r.text, r.encoding) for r in corpus.decode_text(df).collect()}
    assert got == {k: (v[1], v[2]) for k, v in cases.items()}


def test_undecodable_bytes_give_null(spark):
    df = spark.createDataFrame([("x", bytearray(b"\xff\xff\xff"))], "doc_id string, content binary")
    assert corpus.decode_text(df).first().text is None


def test_read_corpus_keeps_supported_files(spark, tmp_path):
    (tmp_path / "note.one.md").write_text("hello", encoding="utf-8")
    (tmp_path / "plain.TXT").write_bytes("港口 开放".encode("gb18030"))
    (tmp_path / "image.png").write_bytes(b"x")
    rows = {r.doc_id: (r.ext, r.text) for r in corpus.read_texts(spark, str(tmp_path)).collect()}
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "note.one.md").write_text("again", encoding="utf-8")
    (tmp_path / "torn.txt").write_bytes(codecs.BOM_UTF16_LE + b"\x41")
    rows = {r.doc_id: (r.ext, r.text) for r in corpus.read_texts(spark, str(tmp_path)).collect()}
    assert rows == {"note.one.md": (".md", "hello"), "plain.TXT": (".txt", "港口 开放"),
                    "sub/note.one.md": (".md", "again"), "torn.txt": (".txt", None)}


def test_upload_names(spark):
    df = spark.createDataFrame([("a.txt",), ("../a.txt",), ("b\\c.md",), ("x.docx",), ("..",)], "file_name string")
    got = {r.file_name: r.reject_reason for r in corpus.check_uploads(df).collect()}
    assert got == {"a.txt": None, "../a.txt": "unsafe_name", "b\\c.md": "unsafe_name",
                   "x.docx": "unsupported_type", "..": "unsafe_name"}


def test_markdown_question_table(spark):
    note = "\n".join([
        "# T", "## 问答", "| 问题 | 回答 |", "| --- | :---: |", "| 目前：甲[换行]乙 | 丙 | 多余 |",
        "no table line", "|  | |", "| 丁 | 戊 |", "", "| 后 | 不读 |"])
    df = spark.createDataFrame([("a", note), ("b", "plain"), ("c", "## 问答\n| q | a |\n# next\n| x | y |")], "doc_id string, text string")
    got = {r.doc_id: r.text for r in markdown.markdown_qa_to_text(df).collect()}
    assert got == {"a": "Q1:甲\n乙\nA1:丙\n</end>\nQ3:丁\nA3:戊\n</end>", "b": "", "c": "Q1:q\nA1:a\n</end>"}
    raw = {r.doc_id: r.text for r in markdown.markdown_qa_to_text(df, on_missing="raw").collect()}
    assert raw["b"] == "plain" and raw["a"] == got["a"]


def test_page_blocks_follow_layout(spark):
    blocks = spark.createDataFrame([
        ("d", 1, 0, "text", 0.0, 10.0, 50.0, 20.0, 1000.0, "header"),
        ("d", 1, 1, "text", 200.0, 100.0, 250.0, 120.0, 1000.0, " right \n side "),
        ("d", 1, 2, "text", 0.0, 100.0, 50.0, 120.0, 1000.0, "left"),
        ("d", 1, 3, "text", 10.0, 310.0, 50.0, 320.0, 1000.0, "cell 1"),
        ("d", 1, 4, "text", 60.0, 330.0, 90.0, 340.0, 1000.0, "cell 2"),
        ("d", 1, 5, "image", 0.0, 600.0, 90.0, 700.0, 1000.0, "<image>p</image>"),
    ], "doc_id string, page int, block_no int, kind string, x0 double, y0 double, x1 double, y1 double, page_height double, content string")
    tables = spark.createDataFrame([("d", 1, 7, 0.0, 300.0, 100.0, 400.0)], "doc_id string, page int, table_no int, x0 double, y0 double, x1 double, y1 double")
    got = [(r.seq, r.kind, r.table_no, r.content) for r in layout.assemble_page_blocks(blocks, tables).orderBy("seq").collect()]
    assert got == [(1, "text", None, "left"), (2, "text", None, "right side"), (3, "table", 7, None), (4, "image", None, "<image>p</image>")]


def test_table_rendering(spark):
    cells = [("d", 1, r, c, v) for r, row in enumerate([
        ["", "", ""], ["A  B", "", "C"], ["1 2", "3", ""], ["4", "5", "6"]]) for c, v in enumerate(row)]
    cells += [("d", 2, 0, 0, " ")]
    df = spark.createDataFrame(cells, "doc_id string, table_no int, row_no int, col_no int, cell string")
    got = {r.table_no: r.markdown for r in layout.tables_to_markdown(df).collect()}
    assert got == {1: "<table>\n| A | B | C |\n| 12 | 3 |  |\n| 4 | 5 | 6 |\n</table>", 2: "<table></table>"}


def test_chat_export(spark):
    df = spark.createDataFrame([
        ("c", 1, 0, "甲", "你好"), ("c", 2, 0, "甲", "[系统消息]x"), ("c", 3, 24, "乙", "卡片"), ("c", 4, 5, "乙", "no")],
        "doc_id string, pos int, type int, account string, content string")
    assert chats.chat_export_to_text(df).first().text == "甲:你好\n乙:卡片"


def test_knowledge_base_replaces_and_deletes(spark, tmp_path):
    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    assert kb.load("chunks") is None
    rows = lambda *r: spark.createDataFrame(list(r), "doc_id string, bid string, text string")
    kb.save({"chunks": rows(("a", "1", "x"), ("a", "2", "y"), ("b", "1", "z"))})
    kb.save({"chunks": rows(("a", "9", "new"))})
    kb.save({"chunks": rows(("b", "2", "more"))}, mode="append")
    got = sorted((r.doc_id, r.bid) for r in kb.load("chunks").collect())
    assert got == [("a", "9"), ("b", "1"), ("b", "2")]
    kb.delete(rows(("b", "", "")))
    assert [r.doc_id for r in kb.load("chunks").collect()] == ["a"]
    kb.delete(rows(("a", "", "")))   # a part that has lost all its rows is empty too
    assert kb.load("chunks").count() == 0 and kb.load("edges") is None
    kb.save({"chunks": rows(("a", "3", "again"))})
    kb.save({"chunks": rows(("a", "3", "again"))})
    assert [tuple(r) for r in kb.load("chunks").collect()] == [("a", "3", "again")]


def test_replaced_documents_leave_every_given_table(spark, tmp_path):
    kb = KnowledgeBase(spark, str(tmp_path / "kb"), parts=2)
    rows = lambda *r: spark.createDataFrame(list(r), "doc_id string, v string")
    kb.save({"chunks": rows(("a", "1"), ("b", "1")), "edges": rows(("a", "e"), ("b", "e"))})
    kb.save({"chunks": rows(("a", "2")), "edges": rows()})
    assert sorted(map(tuple, kb.load("edges").collect())) == [("b", "e")]
    assert sorted(map(tuple, kb.load("chunks").collect())) == [("a", "2"), ("b", "1")]


def test_new_documents_are_added_without_rewriting_stored_ones(spark, tmp_path):
    kb = KnowledgeBase(spark, str(tmp_path / "kb"), parts=1)
    rows = lambda *r: spark.createDataFrame(list(r), "doc_id string, v string")
    files = lambda: {f for f in (tmp_path / "kb" / "chunks").rglob("*.parquet")}
    kb.save({"chunks": rows(("a", "1"), ("b", "1"))})
    first = files()
    kb.save({"chunks": rows(("c", "1"), ("d", "1"))})
    assert first < files()
    # A repeated save, as after a failure, and one of stored and new documents replace what is there.
    kb.save({"chunks": rows(("c", "1"), ("d", "1"))})
    kb.save({"chunks": rows(("d", "2"), ("e", "1"))})
    assert sorted(map(tuple, kb.load("chunks").collect())) == [("a", "1"), ("b", "1"), ("c", "1"), ("d", "2"), ("e", "1")]


def test_only_new_chunks_are_embedded(spark):
    chunks = spark.createDataFrame([("d", f"b{i}", f"第{i}块") for i in (1, 2, 3)], "doc_id string, bid string, text string")
    stored = chunks.limit(0)
    first = store.append_new_chunks(stored, chunks.filter("bid < 'b3'"))
    assert first.count() == 2
    assert [r.bid for r in store.append_new_chunks(first, chunks).collect()] == ["b3"]


def test_active_documents_are_not_deleted(spark):
    ids = spark.createDataFrame([("a",), ("b",)], "doc_id string")
    status = spark.createDataFrame([("a", "processing"), ("b", "paused")], "doc_id string, status string")
    left = store.delete_documents({"t": ids}, ids, status)["t"]
    assert [r.doc_id for r in left.collect()] == ["a"]
    assert store.deletable(ids, status).filter("reject_reason = 'job_active'").count() == 1


def test_history_replace_and_delete(spark):
    old = spark.createDataFrame([("a", 0, "user", "x"), ("b", 0, "user", "y")], "doc_id string, pos int, role string, content string")
    new = spark.createDataFrame([("a", 0, "user", "n"), ("a", 1, "assistant", "m")], old.schema)
    saved = store.save_rag_history(old, new)
    assert sorted(r.content for r in saved.collect()) == ["m", "n", "y"]
    assert store.save_rag_history(old, new.limit(0)).count() == 2
    assert [r.doc_id for r in store.delete_rag_history(saved, new).collect()] == ["b"]


def test_node_link_round_trip_and_split(spark):
    nodes = spark.createDataFrame([("g", "刘备", "人物"), ("g", "蜀汉", "国家")], "graph_id string, node string, label string")
    edges = spark.createDataFrame([("g", "刘备", "蜀汉", "e1", "建立", "ctx", 0.8)],
                                  "graph_id string, source string, target string, edge_id string, label string, title string, weight double")
    for per_document in (100, 1):
        docs = packages.export_node_link(nodes, edges, per_document)
        if per_document == 100:
            assert docs.count() == 1
        for json_col in ("json", "links"):
            packed = docs if json_col == "json" else docs.withColumn("json", F.replace("json", F.lit('"edges":'), F.lit('"links":')))
            got_nodes, got_edges, rejects = packages.import_node_link(packed)
            assert sorted(r.node for r in got_nodes.collect()) == ["刘备", "蜀汉"]
            assert [(r.source, r.target, r.weight) for r in got_edges.collect()] == [("刘备", "蜀汉", 0.8)]
            assert rejects.count() == 0
    bad = spark.createDataFrame([("g", '{"nodes": []}')], "graph_id string, json string")
    assert packages.import_node_link(bad)[2].first().reject_reason == "missing_edges"


def _package(**changes):
    import json

    manifest = {
        "schema": packages.PACKAGE_SCHEMA, "version": 1, "base_name": "n", "original_filename": "n.txt",
        "files": {"original": "o/n.txt", "source_text": "t/s.txt", "processed_text": "t/p.txt", "graph_pages": ["graph/n.html"]},
        "state": {k: [] for k in packages.STATE_KEYS}}
    manifest.update(changes)
    return json.dumps(manifest)


@pytest.mark.parametrize("manifest, extra, reason", [
    (_package(), [], None), (_package(), ["../outside.txt"], "unsafe_member"), (_package(version=2), [], "unsupported_version"),
    (_package(base_name="a/b"), [], "unsafe_base_name"), (_package(state={}), [], "missing_state"), ("{", [], "broken_manifest"),
    (_package(files={"original": "o/n.txt", "source_text": "t/s.txt", "processed_text": "gone.txt", "graph_pages": ["graph/n.html"]}), [], "missing_member"),
    (_package(files={"original": "o/n.txt", "source_text": "t/s.txt", "processed_text": "t/p.txt", "graph_pages": ["t/s.txt"]}), [], "unsafe_page"),
    (_package(), ["x" * (i + 1) for i in range(2001)], "too_many_files"),
])
def test_package_rules(spark, manifest, extra, reason):
    names = ["manifest.json", "o/n.txt", "t/s.txt", "t/p.txt", "graph/n.html", *extra]
    df = spark.createDataFrame([("p", manifest, [(n, 1) for n in names])],
                               "package_id string, manifest string, members array<struct<name:string,size:long>>")
    assert packages.validate_packages(df).first().reject_reason == reason


def test_token_chunks_keep_text_and_size(spark):
    text = "渡船每天清晨离开北港。" * 200
    rows = chunking.split_by_tokens(spark.createDataFrame([("d", text)], "doc_id string, text string"), 32, 12).orderBy("ordinal").collect()
    assert len(rows) > 1 and "".join(r.text for r in rows) == text
    assert all(0 < r.n_tokens <= 32 for r in rows)
    assert [r.ordinal for r in rows] == list(range(1, len(rows) + 1))


def _greedy(toks, top, low, overlap):
    start, out = 0, []
    while start < len(toks):
        end = min(start + top, len(toks))
        if end < len(toks):
            marks = [i for i in range(start, end) if toks[i].strip() in list(".!?;。！？；")]
            if marks and marks[-1] + 1 - start >= low:
                end = marks[-1] + 1
        out.append("".join(toks[start:end]).strip())
        start = end - overlap if end - overlap > start else end
    return out


@pytest.mark.parametrize("overlap", [0, 2])
def test_token_chunks_match_brute_force(spark, overlap):
    text = "a. bb cc! d e f g h i j? kk ll mm; n o p q r s t u v w x y z. end"
    got = chunking.split_by_tokens(spark.createDataFrame([("d", text)], "doc_id string, text string"), 8, 3, overlap).orderBy("ordinal").collect()
    toks = []
    for word in text.split(" "):
        body, mark = (word[:-1], word[-1]) if word[-1] in ".!?;" else (word, "")
        toks += [body, mark + " "] if mark else [body + " "]
    assert [r.text for r in got] == _greedy(toks, 8, 3, overlap)


def test_user_tokenizer_agrees(spark):
    docs = spark.createDataFrame([("d", "甲乙丙。丁戊己庚辛。壬癸")], "doc_id string, text string")
    native = [r.text for r in chunking.split_by_tokens(docs, 6, 2).orderBy("ordinal").collect()]
    custom = [r.text for r in chunking.split_by_tokens(docs, 6, 2, tokenizer=list).orderBy("ordinal").collect()]
    assert native == custom == ["甲乙丙。", "丁戊己庚辛。", "壬癸"]


def test_separator_chunks(spark):
    docs = spark.createDataFrame([("d", "one two</end>three four five six</end>")], "doc_id string, text string")
    texts = lambda **kw: [r.text for r in chunking.split_by_separator(docs, **kw).orderBy("ordinal").collect()]
    assert texts() == ["one two", "three four five six"]
    assert texts(max_tokens=3) == ["one two", "three four five", "six"]
    assert texts(keep=True) == ["one two</end>", "three four five six</end>"]
    assert texts(max_tokens=3, tokenizer=lambda s: [w + " " for w in s.split()]) == ["one two", "three four five", "six"]


def test_similarity_chunks(spark):
    near, far = [1.0, 0.0], [0.0, 1.0]
    rows = [("d", 0, "a. ", 5, near), ("d", 1, "b. ", 5, near), ("d", 2, "c. ", 5, far), ("d", 3, "d, ", 5, far), ("d", 4, "e. ", 8, far)]
    df = spark.createDataFrame(rows, "doc_id string, pos int, text string, n_tokens int, embedding array<double>")
    got = chunking.split_by_similarity(df, 0.8, max_tokens=20, min_tokens=8).orderBy("ordinal").collect()
    assert [r.text for r in got] == ["a. b. ", "c. d, e. "]


def test_similarity_chunks_pass_over_empty_sentences(spark):
    blank, near = [("", 0)] * 40, [1.0, 0.0]
    parts = [("a. ", 5), *blank, ("b. ", 5), *blank, ("c. ", 5), *blank, ("d. ", 20)]
    df = spark.createDataFrame(
        [("d", i, text, n, near) for i, (text, n) in enumerate(parts)],
        "doc_id string, pos int, text string, n_tokens int, embedding array<double>")
    got = chunking.split_by_similarity(df, 0.8, max_tokens=20, min_tokens=8).orderBy("ordinal").collect()
    assert [r.text for r in got] == ["a. b. c. ", "d. "] and sum(r.n_sentences for r in got) == len(parts)


def test_protected_tags(spark):
    raw = "x<table a=1>1\n2</table>y<code>c</code>z<img src=q>w"
    df = spark.createDataFrame([("d", raw)], "doc_id string, text string")
    safe = chunking.protect_tags(df)
    assert safe.first().text == "x__TAG_0__y__TAG_1__z<img src=q>w"
    assert chunking.restore_tags(safe).first().text == raw


def test_splitter_routing(spark):
    df = spark.createDataFrame([(".txt",), (".md",), (".zzz",)], "ext string")
    routed = chunking.route_splitter(df, {"simple": {".txt"}, "semantic": set(), "character": {".md"}})
    assert [r.splitter for r in routed.collect()] == ["simple", "character", "simple"]


def test_relation_text_batches(spark):
    text = "一二三。" + "长" * 12 + "，尾" + "巴" * 12 + "！短。"
    df = spark.createDataFrame([("d", "b", text)], "doc_id string, bid string, text string")
    got = [r.text for r in chunking.split_relation_text(df, 10).orderBy("batch_no").collect()]
    assert "".join(got) == text and all(len(p) <= 11 for p in got)
    cut = spark.range(1).select(chunking.split_long_segment(F.lit("abcdef,ghij,klmno"), 8).alias("p")).first().p
    assert cut == ["abcdef,", "ghij,", "klmno"]


def test_chunk_settings():
    assert chunking.normalize_chunk_settings() == (1024, 384)
    for bad in ((127, 1), (40_000, 1), (256, 256), (256, 0)):
        with pytest.raises(ValueError):
            chunking.normalize_chunk_settings(*bad)
