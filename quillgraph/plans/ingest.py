"""Queries over sources, chunking, entities and relations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from quillgraph.functions import text as tx
from quillgraph.operators import chunking, entities, relations, responses
from quillgraph.plans import sql
from quillgraph.plans.registry import query
from quillgraph.plans.tables import LINE_TOKENS, Tables
from quillgraph.session import materialise, work_dir
from quillgraph.sources import chats, corpus, layout, markdown, packages, store
from quillgraph.streaming import ingest as live

WS = sql.WS


def _md5(col: str) -> object:
    return F.md5(F.col(col).cast("binary"))


# -- sources ------------------------------------------------------------------

_NAME = """
    CASE lang WHEN 'en' THEN source || '_' || doc_id || '.TXT' WHEN 'fr' THEN source || '_' || doc_id || '.v2.md'
              WHEN 'de' THEN source || '/' || doc_id || '.txt' ELSE source || '_' || doc_id END"""


@query("upload_checks", f"""
    SELECT doc_id, file_name, regexp_replace(file_name, '(.)\\.[^.]*$', '\\1') AS base_name,
           lower(regexp_extract(file_name, '.(\\.[^.]*)$', 1)) AS ext,
           CASE WHEN contains(file_name, '/') THEN 'unsafe_name'
                WHEN lower(regexp_extract(file_name, '.(\\.[^.]*)$', 1)) NOT IN ('.txt', '.md', '.pdf')
                THEN 'unsupported_type' END AS reject_reason
    FROM (SELECT doc_id, {_NAME} AS file_name FROM documents)""")
def upload_checks(t: Tables) -> DataFrame:
    return corpus.check_uploads(t.documents.select("doc_id", F.expr(_NAME).alias("file_name")))


@query("read_corpus_files", """
    SELECT doc_id, '.txt' AS ext, 'utf-8' AS encoding, length(text) AS n_chars, md5(text) AS digest FROM documents""")
def read_corpus_files(t: Tables) -> DataFrame:
    """The documents written out as one text file each, and read back through the file reader."""
    folder = _as_files(t, t.documents)
    found = corpus.decode_text(corpus.read_corpus(t.spark, folder, (".txt",)))
    head = F.instr("text", "\n")                   # the first line is the document's number,
    body = F.substr("text", head + 1, F.length("text") - head - 1)   # and the writer ends every file with a newline
    return found.select(
        F.left("text", head - 1).cast("long").alias("doc_id"), "ext", "encoding",
        F.length(body).alias("n_chars"), F.md5(body.cast("binary")).alias("digest"))


def _as_files(t: Tables, docs: DataFrame, kind: str = "text", folder: str | None = None) -> str:
    """One file per document, all in one folder per writing task: its number in the first line, then the text."""
    folder = folder or f"{work_dir(t.spark)}/files-{uuid.uuid4().hex}"
    docs.select(F.concat(F.col("doc_id").cast("string"), F.lit("\n"), "text").alias("value")).write.option(
        "maxRecordsPerFile", 1).mode("append").format(kind).save(folder)
    return folder


# The first line of a file is its document's number and becomes its first chunk.
_FILES = {"chunks": f"""
    SELECT doc_id, 'any' AS lang, ordinal + 1 AS ordinal, text, doc_id || '-' || ordinal AS bid FROM ({sql.body('chunks')}) WHERE lang <> 'de'""",
          "gaz": r"""
    SELECT DISTINCT 'any' AS type, name, 2 AS doc_freq FROM (
      SELECT lang, name FROM (SELECT DISTINCT doc_id, lang, unnest(regexp_extract_all(lower(text), '\p{L}{8,}')) AS name FROM documents)
      GROUP BY lang, name HAVING count(*) >= 2)"""}


@query("streamed_ingest", sql.using("edges", given=_FILES) + """
    SELECT graph_id AS doc_id, source, target, weight FROM edges
    UNION ALL SELECT NULL, 'refused', 'unsupported_type', count(*) FROM documents WHERE lang = 'de' HAVING count(*) > 0""")
def streamed_ingest(t: Tables) -> DataFrame:
    """Documents arrive as files and become stored graphs; German ones come as a kind of file that is refused."""
    root = f"{work_dir(t.spark)}/ingest-{uuid.uuid4().hex}"
    inbox = _as_files(t, t.documents.filter("lang <> 'de'"), folder=f"{root}/in")
    _as_files(t, t.documents.filter("lang = 'de'"), "csv", inbox)
    store_ = store.KnowledgeBase(t.spark, f"{root}/kb", parts=8)
    terms = materialise(t.gazetteer.select("name").distinct().select(F.lit("any").alias("type"), "name"))   # read by every batch
    lines = lambda docs: chunking.split_by_separator(docs, "\n", max_tokens=LINE_TOKENS)
    live.stream_ingest(t.spark, inbox, store_, f"{root}/checkpoint", terms, label="any", files_per_batch=5000, split=lines).awaitTermination()
    numbers = store_.load("chunks").filter("ordinal = 1").select("doc_id", F.col("text").cast("long").alias("number"))
    edges = store_.load("edges").join(numbers, "doc_id").select(F.col("number").alias("doc_id"), "source", "target", "weight")
    refused = store_.load("rejected_files").groupBy("reject_reason").agg(F.count("*").cast("double").alias("weight")).select(
        F.lit(None).cast("long").alias("doc_id"), F.lit("refused").alias("source"), F.col("reject_reason").alias("target"), "weight")
    return edges.unionByName(refused)


@query("decode_text", """
    SELECT doc_id, CASE lang WHEN 'en' THEN 'utf-8' WHEN 'fr' THEN 'utf-8-sig' WHEN 'de' THEN 'utf-16'
                             ELSE 'utf-32' END AS encoding, length(text) AS n_chars, md5(text) AS digest
    FROM documents""")
def decode_text(t: Tables) -> DataFrame:
    bom = lambda hexed: F.unhex(F.lit(hexed))
    content = (
        F.when(F.col("lang") == "en", F.encode("text", "UTF-8"))
        .when(F.col("lang") == "fr", F.concat(bom("EFBBBF"), F.encode("text", "UTF-8")))
        .when(F.col("lang") == "de", F.concat(bom("FFFE"), F.encode("text", "UTF-16LE")))
        .otherwise(F.concat(bom("0000FEFF"), F.encode("text", "UTF-32"))))
    decoded = corpus.decode_text(t.documents.select("doc_id", content.alias("content")))
    return decoded.select("doc_id", "encoding", F.length("text").alias("n_chars"), _md5("text").alias("digest"))


@query("text_quality", f"""
    SELECT doc_id, round(CASE WHEN length(text) = 0 THEN 0 ELSE (
      3.0 * {sql.count('text', '[\\x{3400}-\\x{9FFF}]')}
      + 0.1 * (length(text) - {sql.count('text', '[\\p{C}\\p{Z}]')} + {sql.count('text', '[ \\n\\r\\t]')})
      - 8.0 * {sql.count('text', '[\\x{E000}-\\x{F8FF}]')}
      - 12.0 * {sql.count('text', '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]')}) / length(text) END::DOUBLE, 6) AS quality
    FROM documents""")
def text_quality(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.round(tx.text_quality(F.col("text")), 6).alias("quality"))


@query("markdown_qa", f"""
    WITH qa AS (
      SELECT q.conv_id, q.turn, {sql.strip("replace(q.text, chr(10), ' ')")} AS question,
             {sql.strip("replace(a.text, chr(10), ' ')")} AS answer
      FROM conversations q JOIN conversations a ON q.conv_id = a.conv_id AND a.turn = q.turn + 1
      WHERE q.role = 'user' AND a.role = 'assistant' AND NOT contains(q.text, '|') AND NOT contains(a.text, '|')),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM qa)
    SELECT conv_id AS doc_id,
           md5(string_agg('Q' || n || ':' || question || chr(10) || 'A' || n || ':' || answer || chr(10) || '</end>',
                      chr(10) ORDER BY n)) AS digest, count(*) AS n_pairs
    FROM numbered GROUP BY conv_id""")
def markdown_qa(t: Tables) -> DataFrame:
    turns = t.conversations.select("conv_id", "turn", "role", F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"))
    asked = turns.filter("role = 'user' and not contains(text, '|')").select(
        "conv_id", "turn", F.col("text").alias("q"))
    told = turns.filter("role = 'assistant' and not contains(text, '|')").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("a"))
    rows = asked.join(told, ["conv_id", "turn"])
    table = rows.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("turn", "q", "a"))),
        lambda r: F.concat(F.lit("| 目前："), r.q, F.lit(" | "), r.a, F.lit(" | extra |"))), "\n").alias("body"))
    notes = table.select("doc_id", F.concat(
        F.lit("# Notes\n\n## 问答\n| 问题 | 回答 | x |\n| :--- | --- | --- |\n"), "body",
        F.lit("\n\n| not | read |\n")).alias("text"))
    done = markdown.markdown_qa_to_text(notes)
    return done.select("doc_id", _md5("text").alias("digest"), F.regexp_count("text", F.lit("</end>")).cast("long").alias("n_pairs"))


_BLOCKS = """
    SELECT doc_id, i // 40 AS page, i AS block_no, (i % 3) * 100.0 AS x0, (i % 40) * 20.0 + 10 AS y0,
           (i % 3) * 100.0 + 90 AS x1, (i % 40) * 20.0 + 28 AS y1, line AS content
    FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i
          FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"""


@query("page_blocks", f"""
    WITH b AS ({_BLOCKS}),
    c AS (SELECT *, {sql.norm('content')} AS body,
                 CASE WHEN x0 >= 95 AND x1 <= 195 AND y0 >= 100 AND y1 <= 300 THEN 1
                      WHEN y0 >= 400 AND y1 <= 520 THEN 2 END AS table_no FROM b WHERE y0 >= 820 * 0.07),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY y0, x0, block_no) AS rk FROM c),
    f AS (SELECT *, min(rk) OVER (PARTITION BY doc_id, page, table_no) AS first FROM r),
    k AS (SELECT * FROM f WHERE (table_no IS NOT NULL AND rk = first) OR (table_no IS NULL AND body <> ''))
    SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY rk) AS seq,
           CASE WHEN table_no IS NULL THEN 'text' ELSE 'table' END AS kind, table_no,
           CASE WHEN table_no IS NULL THEN md5(body) END AS digest FROM k""")
def page_blocks(t: Tables) -> DataFrame:
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "content"))
    i = F.col("i")
    blocks = lines.select(
        "doc_id", F.floor(i / 40).alias("page"), i.alias("block_no"), F.lit("text").alias("kind"),
        ((i % 3) * 100.0).alias("x0"), ((i % 40) * 20.0 + 10).alias("y0"), ((i % 3) * 100.0 + 90).alias("x1"),
        ((i % 40) * 20.0 + 28).alias("y1"), F.lit(820.0).alias("page_height"), "content")
    boxes = F.array(
        F.struct(F.lit(1).alias("table_no"), F.lit(95.0).alias("x0"), F.lit(100.0).alias("y0"), F.lit(195.0).alias("x1"), F.lit(300.0).alias("y1")),
        F.struct(F.lit(2).alias("table_no"), F.lit(0.0).alias("x0"), F.lit(400.0).alias("y0"), F.lit(999.0).alias("x1"), F.lit(520.0).alias("y1")))
    tables = blocks.select("doc_id", "page").distinct().select("doc_id", "page", F.inline(boxes))
    done = layout.assemble_page_blocks(blocks, tables)
    return done.select("doc_id", "page", "seq", "kind", "table_no", F.md5(F.col("content").cast("binary")).alias("digest"))


@query("table_markdown", """
    SELECT p_partkey AS doc_id, '<table>' || chr(10) || '| name | brand | size |' || chr(10) || '| '
      || regexp_replace(p_name, '\\s+', '', 'g') || ' | ' || regexp_replace(p_brand, '\\s+', '', 'g') || ' | '
      || p_size || ' |' || chr(10) || '</table>' AS markdown FROM part""")
def table_markdown(t: Tables) -> DataFrame:
    part = t.read("part")
    row = lambda no, *cells: F.array(*[
        F.struct(F.lit(no).alias("row_no"), F.lit(i).alias("col_no"), c.alias("cell")) for i, c in enumerate(cells)])
    blank = F.lit("")
    grid = F.concat(
        row(0, F.lit("name   brand"), blank, blank, F.lit("size")), row(1, blank, blank, blank, blank),
        row(2, F.col("p_name"), F.col("p_brand"), F.col("p_size").cast("string"), F.lit("cut")))
    # The wide header splits into two columns; the third header cell is blank and goes.
    cells = part.select(F.col("p_partkey").alias("doc_id"), F.lit(1).alias("table_no"), F.inline(F.filter(
        grid, lambda c: c.cell != "cut")))
    shaped = cells.withColumn("col_no", F.when((F.col("row_no") == 0) & (F.col("col_no") == 3), F.lit(2)).otherwise(
        F.col("col_no"))).filter(~((F.col("row_no") == 0) & (F.col("col_no") == 2) & (F.col("cell") == "")))
    return layout.tables_to_markdown(shaped).select("doc_id", "markdown")


def _messages(t: Tables) -> DataFrame:
    kind = F.when(F.col("turn") % 3 == 2, F.lit(24)).when(F.col("role") == "system", F.lit(7)).otherwise(F.lit(0))
    return t.conversations.select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), kind.alias("type"),
        F.col("role").alias("account"),
        F.when(F.col("turn") == 0, F.concat(F.lit("[系统消息]"), F.col("text"))).otherwise(F.col("text")).alias("content"))


@query("chat_export", """
    SELECT conv_id AS doc_id, md5(string_agg(role || ':' || text, chr(10) ORDER BY turn)) AS digest
    FROM conversations
    WHERE turn % 3 = 2 OR (role <> 'system' AND turn <> 0) GROUP BY 1""")
def chat_export(t: Tables) -> DataFrame:
    return chats.chat_export_to_text(_messages(t)).select("doc_id", _md5("text").alias("digest"))


@query("knowledge_base_upsert", sql.using("chunks") + """
    SELECT lang, count(*) AS n_chunks, sum(length(text))::BIGINT AS n_chars,
           count(*) FILTER (WHERE lang = 'fr') AS n_replaced
    FROM (SELECT lang, text FROM chunks WHERE lang <> 'fr'
          UNION ALL SELECT lang, upper(text) FROM chunks WHERE lang = 'fr') GROUP BY lang""")
def knowledge_base_upsert(t: Tables) -> DataFrame:
    stored = t.chunks.select("doc_id", "lang", "bid", "text")
    incoming = stored.filter("lang = 'fr'").withColumn("text", F.upper("text"))
    merged = store.upsert_documents(stored, incoming)
    return merged.groupBy("lang").agg(
        F.count("*").alias("n_chunks"), F.sum(F.length("text")).alias("n_chars"),
        F.count(F.when(F.col("lang") == "fr", 1)).alias("n_replaced"))


@query("append_new_chunks", sql.using("chunks") + """
    SELECT doc_id, bid, ordinal FROM chunks WHERE ordinal > 2""")
def append_new_chunks(t: Tables) -> DataFrame:
    current = t.chunks.select("doc_id", "bid", "ordinal")
    return store.append_new_chunks(current.filter("ordinal <= 2"), current)


@query("delete_documents", sql.using("chunks") + """
    SELECT lang, count(DISTINCT doc_id) AS n_docs, count(*) AS n_chunks FROM chunks
    WHERE NOT (lang IN ('fr', 'de') AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)) GROUP BY lang""")
def delete_documents(t: Tables) -> DataFrame:
    chunks = t.chunks.select("doc_id", "lang", "bid")
    requested = t.documents.filter("lang in ('fr', 'de')").select("doc_id")
    status = t.read("labels").select("doc_id", F.when(F.col("toxic") == 1, "processing").otherwise("completed").alias("status"))
    left = store.delete_documents({"chunks": chunks}, requested, status)["chunks"]
    return left.groupBy("lang").agg(F.countDistinct("doc_id").alias("n_docs"), F.count("*").alias("n_chunks"))


@query("node_link_roundtrip", sql.using("edges") + """
    SELECT graph_id, source, target, edge_id, label, weight FROM edges""")
def node_link_roundtrip(t: Tables) -> DataFrame:
    exported = packages.export_node_link(t.nodes, t.edges)
    # Older packages call the edge list "links".
    mixed = exported.withColumn("json", F.when(
        F.col("graph_id") % 2 == 0, F.replace("json", F.lit('"edges":['), F.lit('"links":['))).otherwise(F.col("json")))
    _, edges, _ = packages.import_node_link(mixed)
    return edges.select("graph_id", "source", "target", "edge_id", "label", "weight")


@query("package_checks", """
    SELECT doc_id AS package_id, CASE lang WHEN 'fr' THEN 'unsafe_member' WHEN 'de' THEN 'missing_main_page'
           WHEN 'es' THEN 'missing_state' END AS reject_reason FROM documents""")
def package_checks(t: Tables) -> DataFrame:
    base = F.concat(F.lit("doc"), F.col("doc_id"))
    page = F.when(F.col("lang") == "de", F.concat(F.lit("graph/x"), base, F.lit(".html"))).otherwise(
        F.concat(F.lit("graph/"), base, F.lit(".html")))
    state = F.when(F.col("lang") == "es", F.create_map(F.lit("Bolts"), F.lit("[]"))).otherwise(F.create_map(
        *[F.lit(x) for k in packages.STATE_KEYS for x in (k, "[]")]))
    manifest = F.to_json(F.struct(
        F.lit(packages.PACKAGE_SCHEMA).alias("schema"), F.lit(1).alias("version"), base.alias("base_name"),
        F.concat(base, F.lit(".txt")).alias("original_filename"),
        F.struct(F.lit("original/a.txt").alias("original"), F.lit("text/s.txt").alias("source_text"),
                 F.lit("text/p.txt").alias("processed_text"), F.array(page).alias("graph_pages")).alias("files"),
        state.alias("state")))
    member = lambda c: F.struct(c.alias("name"), F.length("text").cast("long").alias("size"))
    odd = F.when(F.col("lang") == "fr", F.lit("../outside.txt")).otherwise(F.lit("text/more.txt"))
    members = F.array(*[member(c) for c in (
        F.lit("manifest.json"), F.lit("original/a.txt"), F.lit("text/s.txt"), F.lit("text/p.txt"), page, odd)])
    packed = t.documents.select(F.col("doc_id").alias("package_id"), manifest.alias("manifest"), members.alias("members"))
    return packages.validate_packages(packed).select("package_id", "reject_reason")


@query("rag_history", """
    SELECT conv_id AS doc_id, turn AS pos, role,
           CASE WHEN role = 'user' THEN reverse(text) ELSE text END AS content
    FROM conversations WHERE role <> 'system' AND conv_id NOT IN (
      SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) > 6)""")
def rag_history(t: Tables) -> DataFrame:
    old = t.conversations.select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), "role", F.col("text").alias("content"))
    new = old.filter("role <> 'system'").withColumn("content", F.when(
        F.col("role") == "user", F.reverse("content")).otherwise(F.col("content")))
    saved = store.save_rag_history(old, new)
    long_ones = old.groupBy("doc_id").count().filter("count > 6")
    kept = store.delete_rag_history(saved, long_ones)
    return store.get_rag_history(kept, new)


@query("processed_text", sql.using("chunks") + """
    SELECT doc_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY ordinal)) AS digest FROM chunks GROUP BY 1""")
def processed_text(t: Tables) -> DataFrame:
    joined = chats.join_rows(t.chunks, "doc_id", "ordinal", "text", "\n\n")
    return joined.select("doc_id", _md5("text").alias("digest"))


# -- chunking -----------------------------------------------------------------

_MARK = r"[.!?;。！？；]|\n\n"


@query("token_chunks", f"""
    WITH RECURSIVE toks AS MATERIALIZED (
      SELECT doc_id, regexp_extract_all(text, '{sql.TOKEN}') AS t FROM documents),
    flagged AS MATERIALIZED (
      SELECT doc_id, t, len(t) AS n, list_transform(t, lambda x: regexp_matches(x, '{_MARK}')) AS f FROM toks),
    win AS (
      SELECT doc_id, 0 AS ordinal, 0::BIGINT AS s, 0::BIGINT AS e, n FROM flagged
      UNION ALL
      SELECT w.doc_id, w.ordinal + 1, w.e,
        CASE WHEN w.e + 256 >= w.n THEN w.n ELSE
          (SELECT CASE WHEN c >= 96 THEN w.e + c ELSE w.e + 256 END FROM (
             SELECT coalesce(max(i), 256) AS c FROM (SELECT unnest(range(1, 257)) AS i) r
             WHERE fl.f[(w.e + i)::BIGINT])) END, w.n
      FROM win w JOIN flagged fl ON w.doc_id = fl.doc_id WHERE w.e < w.n)
    SELECT doc_id, ordinal, e - s AS n_tokens, {sql.bid('body')} AS bid, length(body) AS n_chars FROM (
      SELECT w.doc_id, w.ordinal, w.s, w.e, {sql.strip("array_to_string(fl.t[w.s + 1 : w.e], '')")} AS body
      FROM win w JOIN flagged fl ON w.doc_id = fl.doc_id WHERE w.ordinal > 0)""")
def token_chunks(t: Tables) -> DataFrame:
    done = chunking.split_by_tokens(t.documents.select("doc_id", "text"), 256, 96)
    return done.select(
        "doc_id", "ordinal", F.col("n_tokens").cast("long").alias("n_tokens"), "bid", F.length("text").alias("n_chars"))


@query("separator_chunks", sql.using("chunks") + f"""
    SELECT doc_id, bid, ordinal, {sql.count('text', sql.TOKEN)} AS n_tokens FROM chunks""")
def separator_chunks(t: Tables) -> DataFrame:
    return t.chunks.select("doc_id", "bid", "ordinal", "n_tokens")


@query("separator_chunks_limited", f"""
    SELECT doc_id, sum(greatest(1, (n + 39) // 40))::BIGINT AS n_chunks, max(least(n, 40))::BIGINT AS max_tokens, sum(n)::BIGINT AS kept_tokens FROM (
      SELECT doc_id, {sql.count('piece', sql.TOKEN)} AS n FROM (
        SELECT doc_id, unnest(CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END) AS piece
        FROM (SELECT doc_id, string_split(text, '. ') AS p FROM documents))) GROUP BY doc_id""")
def separator_chunks_limited(t: Tables) -> DataFrame:
    done = chunking.split_by_separator(t.documents.select("doc_id", "text"), ". ", max_tokens=40)
    return done.groupBy("doc_id").agg(
        F.count("*").alias("n_chunks"), F.max("n_tokens").cast("long").alias("max_tokens"),
        F.sum("n_tokens").alias("kept_tokens"))


@query("similarity_chunks")
def similarity_chunks(t: Tables) -> DataFrame:
    rows = t.embeddings.select(
        F.floor(F.col("vec_id") / 16).alias("doc_id"), (F.col("vec_id") % 16).cast("int").alias("pos"),
        F.concat(F.lit("s"), "vec_id", F.when(F.col("label") < 4, ". ").otherwise(", ")).alias("text"),
        (F.col("vec_id") * 7 % 90 + 10).cast("int").alias("n_tokens"), "embedding")
    return chunking.split_by_similarity(rows, 0.8, 200, 60)


@query("protected_tags", """
    SELECT page_id, true AS restored, length(page) AS n_chars,
           len(regexp_extract_all(page, '(?s)<img[^>]*>.*?</img>|<table[^>]*>.*?</table>|<code[^>]*>.*?</code>')) AS n_tags
    FROM (SELECT page_id, replace(replace(html, '<li>', '<code>'), '</li>', '</code>') AS page FROM pages)""")
def protected_tags(t: Tables) -> DataFrame:
    coded = F.replace(F.replace("html", F.lit("<li>"), F.lit("<code>")), F.lit("</li>"), F.lit("</code>"))
    pages = t.pages.select("page_id", coded.alias("text"), coded.alias("raw"))
    safe = chunking.protect_tags(pages).withColumn("n_tags", F.size("tags"))
    back = chunking.restore_tags(safe)
    return back.select("page_id", "n_tags", F.length("text").alias("n_chars"), (F.col("text") == F.col("raw")).alias("restored"))


@query("routed_chunks", f"""
    WITH p AS (SELECT doc_id, lang, CASE lang WHEN 'en' THEN 'simple' ELSE 'character' END AS splitter,
                      CASE lang WHEN 'en' THEN NULL ELSE string_split(text, chr(10)) END AS parts, text FROM documents)
    SELECT doc_id, splitter, (CASE splitter WHEN 'simple' THEN {sql.count('text', sql.TOKEN)}
      ELSE list_sum(list_transform(parts, lambda x: {sql.count('x', sql.TOKEN)})) END)::BIGINT AS n_tokens FROM p""")
def routed_chunks(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", F.concat(F.lit("."), "lang").alias("ext"), "text")
    routing = {"simple": {".en"}, "character": {".fr", ".de", ".es"}}
    done = chunking.split_routed(docs, routing, {
        "simple": chunking.split_by_tokens,
        "character": lambda d, top, low: chunking.split_by_separator(d, "\n", max_tokens=32_768)}, max_tokens=256, min_tokens=96)
    return done.groupBy("doc_id", "splitter").agg(F.sum("n_tokens").alias("n_tokens"))


@query("relation_batches", sql.using("chunks") + f"""
    SELECT doc_id, bid, sum(length(regexp_replace(text, '{WS}+', '', 'g')))::BIGINT AS n_chars,
           true AS within_limit FROM chunks WHERE text <> '' GROUP BY doc_id, bid""")
def relation_batches(t: Tables) -> DataFrame:
    done = chunking.split_relation_text(t.chunks, 300)
    return done.groupBy("doc_id", "bid").agg(
        F.sum(F.length(F.regexp_replace("text", WS + "+", ""))).alias("n_chars"),
        (F.max(F.length("text")) <= 301).alias("within_limit"))


@query("item_batches", sql.using("ents") + """
    SELECT bid, name, item_no, item_no // 5 AS item_batch FROM (
      SELECT bid, name, row_number() OVER (PARTITION BY bid ORDER BY pos, name) - 1 AS item_no FROM ents)""")
def item_batches(t: Tables) -> DataFrame:
    return chunking.batch_items(t.chunk_entities, ["bid"], ["pos", "name"], 5).select("bid", "name", "item_no", "item_batch")


# -- responses ----------------------------------------------------------------

def _responses(t: Tables) -> DataFrame:
    """Two attempts per document: the language decides how the first one fails."""
    good = F.to_json(F.struct(F.array("lang").alias("entities"), F.col("text").alias("note")))
    first = (
        F.when(F.col("lang") == "en", F.concat(F.lit("```json\n"), good, F.lit("\n```")))
        .when(F.col("lang") == "fr", F.concat(F.lit("answer: "), good, F.lit(" end")))
        .when(F.col("lang") == "de", F.lit("not-json"))
        .otherwise(F.lit('{"other": []}')))
    attempts = F.array(
        F.struct(F.lit("primary").alias("provider"), F.lit(1).alias("attempt"), first.alias("raw"),
                 F.when(F.col("source") == "src1", "length").otherwise("stop").alias("finish_reason")),
        F.struct(F.lit("backup").alias("provider"), F.lit(1).alias("attempt"),
                 F.when(F.col("source") == "src2", F.lit(None)).otherwise(good).alias("raw"),
                 F.when(F.col("source") == "src2", "error").otherwise("stop").alias("finish_reason")))
    return t.documents.select(F.col("doc_id").cast("string").alias("request_id"), "lang", "source", F.inline(attempts))


@query("parsed_responses", """
    SELECT doc_id::VARCHAR AS request_id, 'primary' AS provider,
      CASE WHEN source = 'src1' THEN 'truncated' WHEN lang = 'de' THEN 'invalid_json' WHEN lang = 'es' THEN 'missing_key' END AS reason
    FROM documents UNION ALL
    SELECT doc_id::VARCHAR, 'backup', CASE WHEN source = 'src2' THEN 'empty' END FROM documents""")
def parsed_responses(t: Tables) -> DataFrame:
    return responses.parse_model_json(_responses(t), "entities").select("request_id", "provider", "reason")


@query("resolved_attempts", """
    SELECT doc_id::VARCHAR AS request_id,
      CASE WHEN source <> 'src1' AND lang IN ('en', 'fr') THEN 'primary' WHEN source <> 'src2' THEN 'backup' END AS provider,
      CASE WHEN source = 'src2' AND lang = 'de' THEN 'invalid_json' WHEN source = 'src2' AND lang = 'es' THEN 'missing_key' END AS error
    FROM documents""")
def resolved_attempts(t: Tables) -> DataFrame:
    return responses.resolve_attempts(_responses(t), "entities").select("request_id", "provider", "error")


@query("parsed_answers", f"""
    SELECT doc_id::VARCHAR AS request_id,
      CASE lang WHEN 'en' THEN 'json' WHEN 'fr' THEN 'plain' WHEN 'de' THEN 'recovered' ELSE 'invalid' END AS kind,
      CASE WHEN lang = 'en' THEN 'a' || doc_id || chr(10) || 'b' WHEN lang = 'fr' THEN 'plain ' || doc_id
           WHEN lang = 'de' THEN 'cut ' || doc_id END AS answer,
      CASE WHEN lang = 'en' THEN source WHEN lang = 'fr' THEN 'ref ' || source WHEN lang = 'de' THEN '' END AS material
    FROM documents""")
def parsed_answers(t: Tables) -> DataFrame:
    ident = F.col("doc_id").cast("string")
    raw = (
        F.when(F.col("lang") == "en", F.to_json(F.struct(
            F.array(F.concat(F.lit("a"), ident), F.lit("b")).alias("answer"), F.col("source").alias("material"))))
        .when(F.col("lang") == "fr", F.concat(F.lit("plain "), ident, F.lit("\n参考资料：ref "), "source"))
        .when(F.col("lang") == "de", F.concat(F.lit('{"answer":["cut '), ident, F.lit('"],"material":["unfin')))
        .otherwise(F.lit('{"answer": unfinished')))
    rows = t.documents.select(ident.alias("request_id"), raw.alias("raw"), F.when(
        F.col("lang") == "de", "length").otherwise("stop").alias("finish_reason"))
    return responses.parse_answers(rows).select("request_id", "kind", "answer", "material")


# -- entities -----------------------------------------------------------------

def _long_words(texts: list[str]) -> list[list[tuple[str, str]]]:
    return [[(w, "word") for w in dict.fromkeys(x.strip(".,") for x in s.split()) if len(w) >= 12] for s in texts]


@query("extracted_entities", sql.using("chunks") + r"""
    SELECT doc_id, bid, ordinal, NULL AS error, len(list_distinct(list_filter(list_transform(
             string_split_regex(text, '\s+'), lambda w: trim(w, '.,')), lambda w: length(w) >= 12))) AS n_entities FROM chunks""")
def extracted_entities(t: Tables) -> DataFrame:
    found = entities.extract_entities(t.chunks, _long_words)
    return found.select("doc_id", "bid", "ordinal", F.size("entities").alias("n_entities"), "error")


@query("entity_gazetteer", sql.using("gaz") + "SELECT type, name, doc_freq FROM gaz")
def entity_gazetteer(t: Tables) -> DataFrame:
    return t.gazetteer


@query("chunk_entities", sql.using("ents") + "SELECT doc_id, bid, ordinal, pos, name, type FROM ents")
def chunk_entities(t: Tables) -> DataFrame:
    return t.chunk_entities


@query("normalised_entities", sql.using("ents") + f"""
    SELECT doc_id, bid, row_number() OVER (PARTITION BY bid ORDER BY pos, name) - 1 AS pos, name,
           CASE pos % 4 WHEN 3 THEN '未知标签' ELSE type END AS type FROM ents""")
def normalised_entities(t: Tables) -> DataFrame:
    # The four spellings of an entity, with a repeated and a blank entry behind them.
    quoted = lambda c: tx.json_string(c)
    item = (
        F.when(F.col("pos") % 4 == 0, F.concat(F.lit('{"name": '), quoted(F.col("name")), F.lit(', "type": '), quoted(F.col("type")), F.lit("}")))
        .when(F.col("pos") % 4 == 1, F.concat(F.lit('{"name": "", "entity": '), quoted(F.concat(F.lit(" "), "name")), F.lit(', "label": '), quoted(F.col("type")), F.lit("}")))
        .when(F.col("pos") % 4 == 2, F.concat(F.lit("["), quoted(F.col("name")), F.lit(", "), quoted(F.col("type")), F.lit("]")))
        .otherwise(quoted(F.col("name"))))
    listed = t.dealt_entities.groupBy("doc_id", "bid").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "name", item.alias("j")))), lambda x: x.j), ",").alias("j"))
    raw = listed.select("doc_id", "bid", F.concat(F.lit("["), "j", F.lit(","), "j", F.lit(',"  "]')).alias("items"))
    return entities.normalise_entities(raw)


@query("entity_labels", sql.using("labels") + "SELECT doc_id, name, label, first_pos FROM labels")
def entity_labels(t: Tables) -> DataFrame:
    return t.labels


@query("entities_by_label", sql.using("labels") + """
    SELECT doc_id, label, name, first_pos FROM labels WHERE label IN ('en', 'de')""")
def entities_by_label(t: Tables) -> DataFrame:
    wanted = t.documents.filter("lang in ('en', 'de')").select("doc_id", F.col("lang").alias("label"))
    return entities.entities_by_label(t.labels, wanted)


@query("label_of_names", sql.using("labels") + """
    SELECT doc_id, name, label FROM labels UNION ALL
    SELECT doc_id, 'no such name', '未知标签' FROM documents""")
def label_of_names(t: Tables) -> DataFrame:
    asked = t.labels.select("doc_id", "name").unionByName(
        t.documents.select("doc_id", F.lit("no such name").alias("name")))
    return entities.label_of(asked, t.labels)


# -- relations ----------------------------------------------------------------

@query("relation_candidates", sql.using("chunks", "ents") + """
    , nest AS (SELECT bid, list(name ORDER BY pos, name) AS names FROM ents GROUP BY bid HAVING count(*) >= 2),
    c AS (SELECT c.doc_id, c.bid, list_filter(names, lambda x: contains(c.text, x)) AS cand
          FROM chunks c JOIN nest USING (bid))
    SELECT doc_id, bid, len(cand) AS n, array_to_string(cand, '|') AS candidates FROM c WHERE len(cand) >= 2""")
def relation_candidates(t: Tables) -> DataFrame:
    found = relations.relation_candidates(t.chunks, t.dealt_entities, max_chars=1_000_000)
    return found.select("doc_id", "bid", F.size("candidates").alias("n"), F.array_join("candidates", "|").alias("candidates"))


@query("relation_requests", sql.using("chunks", "ents") + """
    , nest AS (SELECT bid, list(name ORDER BY pos, name) AS names FROM ents GROUP BY bid HAVING count(*) >= 2),
    c AS (SELECT c.doc_id, c.bid, list_filter(names, lambda x: contains(c.text, x)) AS cand
          FROM chunks c JOIN nest USING (bid)),
    r AS (SELECT *, unnest(range((len(cand) + 3) // 4)) AS k FROM c WHERE len(cand) >= 2)
    SELECT doc_id, bid || '/0000/' || lpad(k::VARCHAR, 4, '0') AS request_id, len(cand) AS n_candidates,
           array_to_string(cand[k * 4 + 1 : k * 4 + 4], '|') AS sources FROM r""")
def relation_requests(t: Tables) -> DataFrame:
    found = relations.relation_candidates(t.chunks, t.dealt_entities, max_chars=1_000_000)
    planned = relations.plan_relation_requests(found, 4)
    return planned.select(
        "doc_id", "request_id", F.size("candidates").alias("n_candidates"), F.array_join("sources", "|").alias("sources"))


@query("retry_requests", sql.using("chunks", "ents") + """
    , nest AS (SELECT bid, list(name ORDER BY pos, name) AS names FROM ents GROUP BY bid HAVING count(*) >= 2),
    c AS (SELECT c.doc_id, c.bid, list_filter(names, lambda x: contains(c.text, x)) AS cand
          FROM chunks c JOIN nest USING (bid)),
    h AS (SELECT *, unnest([0, 1]) AS half FROM c WHERE len(cand) >= 2)
    SELECT doc_id, bid || '/0000/0000.' || lpad(half::VARCHAR, 4, '0') AS request_id, 1 AS depth,
           array_to_string(CASE half WHEN 0 THEN cand[1 : len(cand) // 2] ELSE cand[len(cand) // 2 + 1 :] END, '|') AS sources
    FROM h""")
def retry_requests(t: Tables) -> DataFrame:
    found = relations.relation_candidates(t.chunks, t.dealt_entities, max_chars=1_000_000)
    planned = relations.plan_relation_requests(found, 1_000_000)
    return relations.plan_retry_requests(planned).select(
        "doc_id", "request_id", "depth", F.array_join("sources", "|").alias("sources"))


@query("validated_relations", sql.using("rel") + """
    SELECT bid, source, target, CASE WHEN rel_idx % 5 = 3 THEN '' ELSE relation END AS relation,
      CASE rel_idx % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE weight END::DOUBLE AS weight,
      CASE WHEN rel_idx % 5 = 3 THEN 'incomplete' WHEN rel_idx % 5 = 4 THEN 'unknown_entity' END AS reject_reason
    FROM rel""")
def validated_relations(t: Tables) -> DataFrame:
    q = lambda c: tx.json_string(F.col(c))
    k = F.col("rel_idx") % 5
    weight = F.when(k == 0, F.lit("2")).when(k == 1, F.lit('"nan"')).otherwise(F.col("weight").cast("string"))
    item = F.concat(
        F.lit('[{"source": '), q("source"), F.lit(', "target": '), q("target"), F.lit(', "relation": '),
        F.when(k == 3, F.lit("7")).otherwise(q("relation")), F.lit(', "context": '), q("context"),
        F.lit(', "weight": '), weight, F.lit("}]"))
    known = F.when(k == 4, F.array("source")).otherwise(F.array("source", "target"))
    answers = t.relations.filter("context <> ''").select(
        "doc_id", "bid", item.alias("items"), known.alias("candidates"), F.array("source").alias("sources"))
    return relations.validate_relations(answers).select("bid", "source", "target", "relation", "weight", "reject_reason")


@query("deduplicated_relations", sql.using("rel") + """
    SELECT bid, source, target, relation, weight, rel_idx FROM rel""")
def deduplicated_relations(t: Tables) -> DataFrame:
    rel = t.dealt_relations.withColumn("pos", F.col("rel_idx"))
    weaker = rel.withColumn("weight", F.col("weight") - 0.25).withColumn("pos", F.col("pos") + 1000)
    return relations.dedup_relations(rel.unionByName(weaker)).select(
        "bid", "source", "target", "relation", "weight", "rel_idx")


@query("baseline_relations", sql.using("rel") + """
    SELECT doc_id, bid, rel_idx, source, target, md5(context) AS digest, weight FROM rel""")
def baseline_relations(t: Tables) -> DataFrame:
    return t.relations.select("doc_id", "bid", "rel_idx", "source", "target", _md5("context").alias("digest"), "weight")


@query("fusion_groups", sql.using("rel") + """
    SELECT doc_id, least(source, target) AS a, greatest(source, target) AS b, count(*) AS n_relations,
           min(ordinal) AS first_ordinal FROM rel GROUP BY 1, 2, 3""")
def fusion_groups(t: Tables) -> DataFrame:
    return relations.fusion_groups(t.dealt_relations).select(
        "doc_id", "a", "b", "n_relations", F.col("first_at.ordinal").alias("first_ordinal"))


_FUSED = """
    , k AS (SELECT *, least(source, target) AS a, greatest(source, target) AS b FROM rel),
    f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY doc_id, a, b ORDER BY weight DESC, ordinal, rel_idx) = 1)
    SELECT k.bid, k.rel_idx, f.source, f.target, f.relation, md5(f.context) AS digest, f.weight
    FROM k JOIN f ON k.doc_id = f.doc_id AND k.a = f.a AND k.b = f.b"""


@query("fused_relations", sql.using("rel") + _FUSED)
def fused_relations(t: Tables) -> DataFrame:
    return relations.fuse_relations(t.dealt_relations).select(
        "bid", "rel_idx", "source", "target", "relation", _md5("context").alias("digest"), "weight")


@query("fused_relations_by_name", sql.using("rel") + """
    SELECT bid, rel_idx, source, target, max(weight) OVER (PARTITION BY doc_id, source, target, relation) AS weight FROM rel""")
def fused_relations_by_name(t: Tables) -> DataFrame:
    return relations.strongest_per_relation(t.dealt_relations).select("bid", "rel_idx", "source", "target", "weight")


@query("formatted_fusion", sql.using("rel") + """
    SELECT bid, source, target, relation, CASE WHEN rel_idx % 3 = 0 THEN 0.5 WHEN rel_idx % 3 = 1 THEN 3.5 ELSE 0.5 END::DOUBLE AS weight
    FROM rel WHERE rel_idx % 4 <> 3""")
def formatted_fusion(t: Tables) -> DataFrame:
    q = lambda c: tx.json_string(F.col(c))
    k = F.col("rel_idx") % 3
    weight = F.when(k == 0, F.lit("")).when(k == 1, F.lit(', "weight": "3.5"')).otherwise(F.lit(', "weight": "high"'))
    context = F.when(F.col("rel_idx") % 4 == 3, F.lit("")).otherwise(F.concat(F.lit(', "context": '), q("context")))
    rows = t.relations.select("bid", F.concat(
        F.lit('[{"source": '), q("source"), F.lit(', "target": '), q("target"), F.lit(', "relation": '), q("relation"),
        context, weight, F.lit("}, 5]")).alias("items"))
    return relations.format_fused(rows).select("bid", "source", "target", "relation", "weight")


@query("fusion_input", sql.using("rel") + """
    SELECT doc_id, least(source, target) AS a, greatest(source, target) AS b, 0 AS part, count(*) AS n_relations,
      md5('实体1：' || least(source, target) || chr(10) || '实体2：' || greatest(source, target) || chr(10) || '现有关系：' || chr(10)
          || string_agg('- ' || relation || '（上下文：' || context || '，权重：' || weight || '）' || chr(10), '' ORDER BY ordinal, rel_idx)) AS digest
    FROM rel GROUP BY 1, 2, 3""")
def fusion_input(t: Tables) -> DataFrame:
    return relations.render_fusion_input(t.dealt_relations).select("doc_id", "a", "b", "part", "n_relations", _md5("text").alias("digest"))


@query("chunk_records", sql.using("chunks", "ents", "rel") + """
    SELECT c.doc_id, c.bid, c.ordinal, (SELECT count(*) FROM ents e WHERE e.bid = c.bid) AS n_entities,
           (SELECT count(*) FROM rel r WHERE r.bid = c.bid) AS n_relations
    FROM chunks c WHERE c.ordinal <= 5 AND c.lang <> 'es'""")
def chunk_records(t: Tables) -> DataFrame:
    done = lambda cond: t.chunks.filter(cond).select("doc_id", "bid")
    built = relations.build_chunk_records(
        t.chunks, t.dealt_entities, t.dealt_relations, done("ordinal <= 5"), done("lang <> 'es'"))
    return built.select(
        "doc_id", "bid", "ordinal", F.size("entities").cast("long").alias("n_entities"),
        F.size("relation").cast("long").alias("n_relations"))
