"""Queries over incremental updates, edits, versions, progress and the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillgraph.functions import text as tx
from quillgraph.operators import editing, incremental, progress
from quillgraph.plans import sql
from quillgraph.plans.registry import query
from quillgraph.plans.tables import Tables, stage_events
from quillgraph.session import materialise
from quillgraph.streaming import progress as live

STAMP = "2024-01-01 00:00:00"


def _md5(col: str) -> object:
    return F.md5(F.col(col).cast("binary"))


# -- incremental update -------------------------------------------------------

@query("normalised_text", f"SELECT doc_id, md5({sql.norm('text')}) AS digest FROM documents")
def normalised_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(tx.normalize_ws(F.col("text")).cast("binary")).alias("digest"))


# The new text of a document keeps the lines whose digest starts with 0-b and gains one line.
_NEW = f"""
    , kept AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY ordinal) AS body FROM chunks WHERE md5(text) < 'c' GROUP BY doc_id),
    new AS (SELECT d.doc_id, {sql.norm("coalesce(body || chr(10), '') || 'Entirely new closing line ' || d.doc_id")} AS norm
            FROM documents d LEFT JOIN kept USING (doc_id))"""


def _new_docs(t: Tables) -> DataFrame:
    kept = t.chunks.filter(F.md5(F.col("text").cast("binary")) < "c").groupBy("doc_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda r: r["text"]), "\n").alias("body"))
    line = F.concat(F.lit("Entirely new closing line "), F.col("doc_id").cast("string"))
    body = F.coalesce(F.concat("body", F.lit("\n")), F.lit(""))
    return t.documents.select("doc_id").join(kept, "doc_id", "left").select("doc_id", F.concat(body, line).alias("text"))


@query("chunk_diff", sql.using("chunks") + _NEW + f"""
    SELECT c.doc_id, c.bid, contains(n.norm, {sql.norm('c.text')}) AS kept FROM chunks c JOIN new n USING (doc_id)""")
def chunk_diff(t: Tables) -> DataFrame:
    marked, _ = incremental.diff_chunks(t.chunks, _new_docs(t))
    return marked.select("doc_id", "bid", "kept")


_OLD_CHUNKS = {"old_chunks": sql.body("chunks")}
#: What is left of each new text when its kept chunks have taken their places, in order.
_GAPS = f"""SELECT doc_id, list_filter(list_transform(parts, lambda p: trim(p)), lambda p: p <> '') AS gaps FROM (
      SELECT new.doc_id, string_split(CASE WHEN l IS NULL THEN norm ELSE list_reduce(l, lambda acc, c:
             CASE WHEN instr(acc, c) > 0 THEN left(acc, instr(acc, c) - 1) || chr(1) || substr(acc, instr(acc, c) + length(c)) ELSE acc END, norm) END, chr(1)) AS parts
      FROM new LEFT JOIN (SELECT c.doc_id, list(c.n ORDER BY c.ordinal) FILTER (WHERE c.n <> '' AND contains(new.norm, c.n)) AS l
        FROM (SELECT doc_id, ordinal, {sql.norm('text')} AS n FROM old_chunks) c JOIN new USING (doc_id) GROUP BY c.doc_id) k USING (doc_id))"""
_CUT = sql.using(first=_OLD_CHUNKS) + _NEW.replace("FROM chunks", "FROM old_chunks") + f", g AS ({_GAPS})"


@query("added_text", _CUT + """
    SELECT doc_id, unnest(range(len(gaps))) AS gap_no, md5(unnest(gaps)) AS digest FROM g""")
def added_text(t: Tables) -> DataFrame:
    _, gaps = incremental.diff_chunks(t.chunks, _new_docs(t))
    return gaps.select("doc_id", F.col("gap_no").cast("long").alias("gap_no"), _md5("text").alias("digest"))


# Every gap of these texts is below the token limit and gives one chunk.
@query("added_chunks", _CUT + f"""
    SELECT doc_id, ordinal, text, {sql.bid()} AS bid FROM (
      SELECT g.doc_id, (coalesce(top, 0) + unnest(range(1, len(gaps) + 1)))::INT AS ordinal, unnest(gaps) AS text
      FROM g LEFT JOIN (SELECT doc_id, max(ordinal) AS top FROM old_chunks GROUP BY doc_id) USING (doc_id))""")
def added_chunks(t: Tables) -> DataFrame:
    _, gaps = incremental.diff_chunks(t.chunks, _new_docs(t))
    return incremental.added_chunks(gaps, t.chunks, max_tokens=256, min_tokens=96).select("doc_id", "ordinal", "text", "bid")


# French documents keep their text; the others keep some lines and gain two names that the graph knows.
_CHANGED = {
    **_OLD_CHUNKS,
    "kept": "SELECT doc_id, string_agg(text, chr(10) ORDER BY ordinal) AS body FROM old_chunks WHERE md5(text) < 'c' GROUP BY doc_id",
    "two": "SELECT doc_id, min(w) AS lo, max(w) AS hi FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\\p{L}{8,}')) AS w FROM documents) GROUP BY doc_id",
    "new": f"""SELECT d.doc_id, {sql.norm("coalesce(body || chr(10), '') || coalesce('Lately ' || lo || ' joined ' || hi, 'Nothing new') || ' in ' || d.doc_id")} AS norm
               FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN two USING (doc_id) WHERE lang <> 'fr'""",
    "g": _GAPS,
}
_UPDATED_CHUNKS = f"""
    SELECT doc_id, lang, ordinal, text, bid FROM old_chunks c LEFT JOIN new USING (doc_id) WHERE norm IS NULL OR contains(norm, {sql.norm('text')})
    UNION ALL SELECT doc_id, lang, ordinal, text, {sql.bid()} AS bid FROM (
      SELECT g.doc_id, d.lang, (coalesce(top, 0) + unnest(range(1, len(gaps) + 1)))::INT AS ordinal, unnest(gaps) AS text
      FROM g JOIN documents d USING (doc_id) LEFT JOIN (SELECT doc_id, max(ordinal) AS top FROM old_chunks GROUP BY doc_id) USING (doc_id))"""


def _updated(t: Tables) -> dict[str, DataFrame]:
    kept = t.chunks.filter(F.md5(F.col("text").cast("binary")) < "c").groupBy("doc_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda r: r["text"]), "\n").alias("body"))
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{8,}"), F.lit(0))
    told = F.coalesce(F.concat(F.lit("Lately "), F.array_min(words), F.lit(" joined "), F.array_max(words)), F.lit("Nothing new"))
    edited = F.concat(F.coalesce(F.concat("body", F.lit("\n")), F.lit("")), told, F.lit(" in "), F.col("doc_id").cast("string"))
    texts = t.documents.join(kept, "doc_id", "left").select(
        "doc_id", "lang", F.when(F.col("lang") == "fr", F.col("text")).otherwise(edited).alias("text"))
    stored = {"documents": t.documents.select("doc_id", "lang", "text"), "chunks": t.chunks, "chunk_entities": t.dealt_entities, "relations": t.dealt_relations}
    none = t.documents.limit(0).select("doc_id", F.lit(1).alias("revision"), F.lit("").alias("operation"), F.to_timestamp(F.lit(STAMP)).alias("created_at"))
    return incremental.update_documents(stored, texts, t.names, none, F.to_timestamp(F.lit(STAMP)), max_tokens=256, min_tokens=96)


@query("incremental_update", sql.using("edges", first=_CHANGED, given={"chunks": _UPDATED_CHUNKS}) + """
    SELECT graph_id, source, target, edge_id, weight FROM edges""")
def incremental_update(t: Tables) -> DataFrame:
    """The graph after an update of most texts: equal to the graph of the updated chunks."""
    return _updated(t)["edges"].select("graph_id", "source", "target", "edge_id", "weight")


@query("update_versions", """
    SELECT doc_id, k::INT AS revision, CASE k WHEN 1 THEN 'before:' ELSE '' END || 'incremental_update' AS operation
    FROM documents, (VALUES (1), (2)) AS x(k) WHERE lang <> 'fr'""")
def update_versions(t: Tables) -> DataFrame:
    return _updated(t)["versions"].select("doc_id", "revision", "operation")


@query("applied_update", sql.using("chunks", "rel") + _NEW + f"""
    , gone AS (SELECT c.bid FROM chunks c JOIN new n USING (doc_id) WHERE NOT contains(n.norm, {sql.norm('c.text')}))
    SELECT doc_id, count(*) AS n_relations FROM rel WHERE bid NOT IN (SELECT bid FROM gone) GROUP BY doc_id""")
def applied_update(t: Tables) -> DataFrame:
    marked, _ = incremental.diff_chunks(t.chunks, _new_docs(t))
    rest = incremental.apply_update({"relations": t.dealt_relations}, marked, {})["relations"]
    return rest.groupBy("doc_id").agg(F.count("*").alias("n_relations"))


@query("unchanged_documents", """
    SELECT doc_id, lang <> 'fr' AND lang <> 'es' AS unchanged FROM documents""")
def unchanged_documents(t: Tables) -> DataFrame:
    old = t.documents.filter("lang <> 'es'").select("doc_id", "text")
    new = t.documents.select("doc_id", F.when(F.col("lang") == "fr", F.concat("text", F.lit("."))).otherwise(F.col("text")).alias("text"))
    return incremental.is_unchanged(old, new)


@query("ingest_plan", """
    SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) AND lang <> 'fr' AND length(text) > 500
                        THEN 'incremental' ELSE 'full' END AS plan FROM documents""")
def ingest_plan(t: Tables) -> DataFrame:
    docs = t.documents
    return incremental.plan_ingest(
        docs.select("doc_id"), t.read("labels"), docs.filter("lang <> 'fr'"), docs.filter(F.length("text") > 500))


@query("remaining_chunks", sql.using("chunks") + """
    SELECT doc_id, bid FROM chunks WHERE lang <> 'fr' AND ordinal > 2""")
def remaining_chunks(t: Tables) -> DataFrame:
    # Finished French chunks differ from the source, so those documents are rejected.
    done = t.chunks.filter("ordinal <= 2").select("doc_id", "ordinal", F.when(
        F.col("lang") == "fr", F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    todo, _ = incremental.remaining_chunks(t.chunks, done)
    return todo.select("doc_id", "bid")


@query("resume_rejects", "SELECT doc_id, 'checkpoint_mismatch' AS reject_reason FROM documents WHERE lang = 'fr'")
def resume_rejects(t: Tables) -> DataFrame:
    done = t.chunks.filter("ordinal <= 2").select("doc_id", "ordinal", F.when(
        F.col("lang") == "fr", F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    return incremental.remaining_chunks(t.chunks, done)[1]


# -- edits --------------------------------------------------------------------

def _picked(t: Tables) -> DataFrame:
    """First and last edge of every document, the targets of its edits."""
    edge = F.struct("edge_id", "source", "target", "first_at")
    # Two edges a document, read by every step of an edit: stored, so that the edges are worked out once.
    return materialise(t.edges.groupBy(F.col("graph_id").alias("doc_id")).agg(
        F.min_by(edge, "first_at").alias("lo"), F.max_by(edge, "first_at").alias("hi")))


def _mutations(t: Tables, picked: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")

    def edit(seq: int, operation: str, weight: float | None = None, **given: object) -> object:
        fields = ("node_id", "name", "entity_type", "edge_id", "source", "target", "relation", "context")
        return F.struct(
            F.lit(seq).cast("long").alias("seq"), F.lit(operation).alias("operation"),
            F.lit(weight).cast("double").alias("weight"),
            *[given.get(f, none).alias(f) for f in fields])

    fresh = F.lit("brand new node")
    return picked.select("doc_id", F.inline(F.array(
        edit(1, "add_node", name=fresh, entity_type=F.lit("made up")),
        edit(2, "add_edge", 0.9, source=fresh, target=F.col("lo.source"), relation=F.lit("points at")),
        edit(3, "update_node", node_id=F.col("lo.source"), name=F.lit("renamed node")),
        edit(4, "delete_node", node_id=F.col("lo.source")),
        edit(5, "update_edge", 7.0, edge_id=F.col("hi.edge_id")))))


_EDITS = """
    , lo AS (SELECT graph_id AS doc_id, arg_min(source, first_at) AS old FROM edges GROUP BY 1)"""


@query("edited_relations", sql.using("edges", "rel") + _EDITS + """
    SELECT r.doc_id, r.bid, CASE WHEN r.source = old THEN 'renamed node' ELSE r.source END AS source,
           CASE WHEN r.target = old THEN 'renamed node' ELSE r.target END AS target, weight, origin
    FROM rel r JOIN lo USING (doc_id)
    UNION ALL SELECT doc_id, '__manual_graph_edits__', 'brand new node', 'renamed node', 0.9, 'manual' FROM lo""")
def edited_relations(t: Tables) -> DataFrame:
    _, rel, _ = editing.apply_mutations(t.labels, t.dealt_relations, _mutations(t, _picked(t)))
    return rel.select("doc_id", "bid", "source", "target", "weight", "origin")


@query("rejected_edits", sql.using("edges") + """
    SELECT DISTINCT graph_id AS doc_id, seq, reason AS reject_reason
    FROM edges, (VALUES (4, 'node_missing'), (5, 'weight_out_of_range')) AS x(seq, reason)""")
def rejected_edits(t: Tables) -> DataFrame:
    _, _, bad = editing.apply_mutations(t.labels, t.dealt_relations, _mutations(t, _picked(t)))
    return bad.select("doc_id", "seq", "reject_reason")


@query("validated_edits", sql.using("edges") + """
    SELECT DISTINCT graph_id AS doc_id, seq, reason AS reject_reason
    FROM edges, (VALUES (1, NULL), (2, 'endpoint_missing'), (3, NULL), (4, NULL), (5, 'weight_out_of_range')) AS x(seq, reason)""")
def validated_edits(t: Tables) -> DataFrame:
    """All edits against the unedited state: the new node's edge has no start yet."""
    return editing.validate_mutations(_mutations(t, _picked(t)), t.labels, t.dealt_relations).select(
        "doc_id", "seq", "reject_reason")


# -- versions -----------------------------------------------------------------

_STORED = """
    WITH v AS (SELECT conv_id AS doc_id, (turn + 1)::INT AS revision,
                      CASE turn % 4 WHEN 0 THEN 'before:add_edge' WHEN 1 THEN 'add_edge' WHEN 2 THEN 'before:redraw_graph' ELSE 'restore:1' END AS operation,
                      text FROM conversations)"""


def _versions(t: Tables) -> DataFrame:
    k = F.col("turn") % 4
    name = F.when(k == 0, "before:add_edge").when(k == 1, "add_edge").when(k == 2, "before:redraw_graph").otherwise("restore:1")
    return t.conversations.select(
        F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("revision"), name.alias("operation"),
        F.to_timestamp(F.lit(STAMP)).alias("created_at"), "text")


@query("stale_edits", _STORED + """
    SELECT doc_id, revision, revision <> max(revision) OVER (PARTITION BY doc_id) AS stale FROM v""")
def stale_edits(t: Tables) -> DataFrame:
    versions = _versions(t)
    return editing.check_revision(versions.select("doc_id", "revision"), versions).select("doc_id", "revision", "stale")


_COMMITS = """
    , c AS (SELECT DISTINCT conv_id AS doc_id FROM conversations UNION SELECT doc_id FROM labels)
    SELECT c.doc_id, (coalesce(m, 0) + k)::INT AS revision, CASE k WHEN 1 THEN 'before:delete_node' ELSE 'delete_node' END AS operation
    FROM c LEFT JOIN (SELECT doc_id, max(revision) AS m FROM v GROUP BY 1) USING (doc_id), (VALUES {rows}) AS x(k)"""


def _commits(t: Tables) -> DataFrame:
    ids = t.conversations.select(F.col("conv_id").alias("doc_id")).union(t.read("labels").select("doc_id")).distinct()
    return ids.select("doc_id", F.lit("delete_node").alias("operation"), F.to_timestamp(F.lit(STAMP)).alias("created_at"))


@query("committed_versions", _STORED + _COMMITS.format(rows="(1), (2)"))
def committed_versions(t: Tables) -> DataFrame:
    return editing.commit_version(_commits(t), _versions(t)).select("doc_id", "revision", "operation")


@query("committed_snapshots", _STORED + _COMMITS.format(rows="(1)"))
def committed_snapshots(t: Tables) -> DataFrame:
    return editing.commit_snapshot(_commits(t), _versions(t)).select("doc_id", "revision", "operation")


@query("listed_versions", _STORED + """
    SELECT doc_id, revision, CASE operation WHEN 'before:add_edge' THEN '修改前快照：新增关系' WHEN 'add_edge' THEN '新增关系'
      WHEN 'before:redraw_graph' THEN '修改前快照：重新绘制图谱' ELSE '从历史版本 1 还原' END AS description FROM v""")
def listed_versions(t: Tables) -> DataFrame:
    return editing.list_versions(_versions(t)).select("doc_id", "revision", "description")


@query("restored_versions", _STORED + """
    , w AS (SELECT DISTINCT doc_id, 2 AS revision FROM v)
    SELECT v.doc_id, md5(text) AS digest, (SELECT max(revision) FROM v x WHERE x.doc_id = v.doc_id) + 2 AS new_revision
    FROM v JOIN w ON w.doc_id = v.doc_id AND w.revision = v.revision""")
def restored_versions(t: Tables) -> DataFrame:
    versions = _versions(t)
    wanted = versions.select("doc_id", F.lit(2).alias("revision")).distinct()
    state, rows, _ = editing.restore_version(
        wanted, versions, {"texts": versions.select("doc_id", "revision", "text")}, F.to_timestamp(F.lit(STAMP)))
    top = rows.groupBy("doc_id").agg(F.max("revision").alias("new_revision"))
    return state["texts"].join(top, "doc_id").select("doc_id", _md5("text").alias("digest"), "new_revision")


@query("document_versions", _STORED + """
    , e AS (SELECT DISTINCT conv_id AS doc_id FROM conversations),
    m AS (SELECT doc_id, max(revision) AS m FROM v GROUP BY 1)
    SELECT e.doc_id, (m + k)::INT AS revision, CASE k WHEN 1 THEN '文档修改前' ELSE '文档修改后' END AS description,
           md5(CASE k WHEN 1 THEN coalesce(d.text, '') ELSE 'draft ' || e.doc_id END) AS digest
    FROM e JOIN m USING (doc_id) LEFT JOIN documents d ON d.doc_id = e.doc_id, (VALUES (1), (2)) AS x(k)""")
def document_versions(t: Tables) -> DataFrame:
    edits = t.conversations.select(F.col("conv_id").alias("doc_id")).distinct().select(
        "doc_id", F.concat(F.lit("draft "), F.col("doc_id").cast("string")).alias("content"),
        F.to_timestamp(F.lit(STAMP)).alias("created_at"))
    rows = editing.append_document_versions(edits, _versions(t), t.documents.select("doc_id", "text"))
    listed = editing.list_versions(rows, "document").select("doc_id", "revision", "description")
    return rows.select("doc_id", "revision", _md5("content").alias("digest")).join(listed, ["doc_id", "revision"])


@query("restored_documents", _STORED + """
    SELECT doc_id, md5(text) AS digest, 'document_restore:1' AS operation FROM v WHERE revision = 1""")
def restored_documents(t: Tables) -> DataFrame:
    stored = _versions(t).select("doc_id", "revision", F.col("text").alias("content"))
    wanted = stored.select("doc_id", F.lit(1).alias("revision")).distinct()
    return editing.restore_document(wanted, stored).select("doc_id", _md5("draft").alias("digest"), "operation")


@query("current_texts", """
    SELECT coalesce(d.doc_id, c.conv_id) AS doc_id, md5(coalesce(c.text, d.text)) AS digest, c.conv_id IS NOT NULL AS is_draft
    FROM (SELECT * FROM documents WHERE lang <> 'fr') d FULL JOIN (SELECT * FROM conversations WHERE turn = 1) c ON c.conv_id = d.doc_id""")
def current_texts(t: Tables) -> DataFrame:
    drafts = t.conversations.filter("turn = 1").select(F.col("conv_id").alias("doc_id"), "text")
    done = editing.current_text(t.documents.filter("lang <> 'fr'").select("doc_id", "text"), drafts)
    return done.select("doc_id", _md5("text").alias("digest"), "is_draft")


# -- progress -----------------------------------------------------------------

_STAGES = sql.using("stage") + """
    , l AS (SELECT *, lag(completed, 1, 0) OVER (PARTITION BY job_id, stage ORDER BY seq) AS was FROM stage),
    g AS (SELECT job_id, stage, arg_max(completed, seq) AS completed, arg_max(total, seq) AS total,
            round(arg_max(item_seconds, seq) FILTER (WHERE item_seconds > 0), 2) AS latest_item_seconds,
            coalesce(sum(round(item_seconds * 1000000, 0)::BIGINT) FILTER (WHERE item_seconds > 0 AND completed > was), 0)::BIGINT AS cum,
            count(*) FILTER (WHERE item_seconds > 0 AND completed > was) AS sample_count,
            arg_min(completed, seq) AS fc, arg_min(total, seq) AS ft
          FROM l GROUP BY job_id, stage),
    p AS (SELECT *, total - completed AS remaining, round(completed * 100.0::DOUBLE / total, 1) AS percentage,
            round(CASE WHEN sample_count > 0 THEN cum / sample_count END / 10000.0::DOUBLE, 0) / 100 AS average_item_seconds,
            round(cum / 1000.0::DOUBLE, 0) / 1000 AS cumulative_seconds FROM g)"""


_STAGE_ROWS = _STAGES + """
    SELECT job_id, stage, completed, total, remaining, percentage, latest_item_seconds, average_item_seconds, cumulative_seconds,
      sample_count, CASE WHEN cum > 0 THEN round(sample_count * 6000000000.0::DOUBLE / cum, 0) / 100 END AS items_per_minute,
      CASE WHEN sample_count > 0 THEN round(remaining * (cum / sample_count) / 1000000, 0) WHEN remaining = 0 THEN 0.0 END AS estimated_remaining_seconds
    FROM p"""


@query("stage_progress", _STAGE_ROWS)
def stage_progress(t: Tables) -> DataFrame:
    return progress.stage_progress(t.stage_events).drop("first")


@query("streamed_stage_progress", _STAGE_ROWS)
def streamed_stage_progress(t: Tables) -> DataFrame:
    """The same figures from the events read as a stream."""
    stream = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    return live.publish_progress(t.spark, stage_events(stream))


@query("overall_progress", _STAGES + """
    , w AS (SELECT job_id, max(percentage) FILTER (WHERE stage = 'entity_extraction') AS p1, max(percentage) FILTER (WHERE stage = 'relationship_extraction') AS p2,
        max(percentage) FILTER (WHERE stage = 'knowledge_fusion') AS p3, max(remaining) FILTER (WHERE stage = 'entity_extraction') AS r1,
        max(remaining) FILTER (WHERE stage = 'relationship_extraction') AS r2, max(remaining) FILTER (WHERE stage = 'knowledge_fusion') AS r3,
        max(average_item_seconds) FILTER (WHERE stage = 'entity_extraction') AS a1, max(average_item_seconds) FILTER (WHERE stage = 'relationship_extraction') AS a2,
        max(average_item_seconds) FILTER (WHERE stage = 'knowledge_fusion') AS a3, sum(cumulative_seconds) AS cum,
        max(fc) FILTER (WHERE stage = 'entity_extraction') AS fc, max(ft) FILTER (WHERE stage = 'entity_extraction') AS ft FROM p GROUP BY job_id),
    x AS (SELECT job_id, p1, coalesce(p2, round(greatest(fc - 1, 0) * 100.0::DOUBLE / ft, 1)) AS p2, p3, r1,
        coalesce(r2, ft - greatest(fc - 1, 0)) AS r2, r3, a1, a2, a3, cum, list_avg(list_filter([a1, a2, a3], lambda v: v IS NOT NULL)) AS fb FROM w)
    SELECT job_id, round((coalesce(p1, 0) + coalesce(p2, 0) + coalesce(p3, 0)) / 3, 1) AS overall_percentage,
      CASE WHEN cum > 0 AND coalesce(p1, 0) + coalesce(p2, 0) + coalesce(p3, 0) > 0 THEN round((coalesce(p1, 0) + coalesce(p2, 0) + coalesce(p3, 0)) / 3 * 60.0::DOUBLE / cum, 2) END AS overall_speed_percent_per_minute,
      round(CASE WHEN r1 = 0 THEN 0 ELSE r1 * coalesce(nullif(a1, 0), fb) END + CASE WHEN r2 = 0 THEN 0 ELSE r2 * coalesce(nullif(a2, 0), fb) END
            + CASE WHEN r3 = 0 THEN 0 ELSE r3 * coalesce(nullif(a3, 0), fb) END, 0) AS estimated_total_remaining_seconds FROM x""")
def overall_progress(t: Tables) -> DataFrame:
    return progress.overall_progress(progress.stage_progress(t.stage_events))


_STATUSES = ["uploading", "importing", "processing", "updating", "resuming", "pausing", "redrawing", "paused",
             "completed", "interrupted", "error"]
_STATUS_SQL = "['" + "', '".join(_STATUSES) + "'][event_id % 11 + 1]"


def _status(t: Tables) -> DataFrame:
    names = F.array(*[F.lit(s) for s in _STATUSES])
    k = F.col("event_id")
    return t.events.select(
        k.alias("doc_id"), F.get(names, (k % 11).cast("int")).alias("status"), (k % 4).cast("int").alias("completed_chunks"),
        (k % 3).cast("int").alias("total_chunks"), (k % 5 == 0).alias("pause_requested"), (k % 2 == 0).alias("resumable"),
        (k % 7 < 4).alias("has_result"), (k % 13 < 9).alias("has_source"), (k % 6).cast("int").alias("stored_chunks"),
        F.get(F.array(F.lit("paused"), F.lit("completed"), F.lit("failed")), (k % 3).cast("int")).alias("outcome"),
        (k % 100).cast("double").alias("percentage"), F.concat(F.lit("file"), k, F.lit(".txt")).alias("file_name"))


@query("recovered_status", f"""
    WITH s AS (SELECT event_id AS doc_id, event_id % 4 AS done, event_id % 5 = 0 AS pr, event_id % 2 = 0 AS rs, event_id % 7 < 4 AS hr,
                      event_id % 13 < 9 AS hs, {_STATUS_SQL} AS st FROM events),
    a AS (SELECT *, st IN ('uploading', 'importing', 'processing', 'updating', 'resuming', 'pausing') AS act FROM s)
    SELECT doc_id, CASE WHEN st = 'redrawing' THEN CASE WHEN hr THEN 'completed' ELSE 'error' END
      WHEN act THEN CASE WHEN st = 'pausing' OR pr THEN 'paused' WHEN done > 0 THEN 'interrupted' ELSE 'error' END ELSE st END AS status,
      CASE WHEN st = 'redrawing' OR act THEN false ELSE pr END AS pause_requested, CASE WHEN act THEN hs ELSE rs END AS resumable FROM a""")
def recovered_status(t: Tables) -> DataFrame:
    jobs = _status(t)
    done = progress.recover_status(jobs.drop("has_result", "has_source"), jobs.select("doc_id", "has_result", "has_source"))
    return done.select("doc_id", "status", "pause_requested", "resumable")


@query("finished_status", """
    WITH s AS (SELECT event_id AS doc_id, ['paused', 'completed', 'failed'][event_id % 3 + 1] AS o, event_id % 4 AS c, event_id % 3 AS tot,
                      event_id % 6 AS sc, event_id % 7 < 4 AS hr, event_id % 13 < 9 AS hs FROM events),
    d AS (SELECT *, CASE WHEN o = 'failed' AND c = 0 THEN sc ELSE c END AS done FROM s)
    SELECT doc_id, CASE o WHEN 'paused' THEN 'paused' WHEN 'completed' THEN 'completed' ELSE CASE WHEN done > 0 AND hr THEN 'interrupted' ELSE 'error' END END AS status,
      CASE o WHEN 'completed' THEN 100.0::DOUBLE WHEN 'failed' THEN CASE WHEN done > 0 THEN round(done * 100.0::DOUBLE / greatest(tot, done), 0) ELSE 0 END END AS percentage,
      o <> 'completed' AND done > 0 AND hr AS partial_available, o <> 'completed' AND hs AS resumable FROM d""")
def finished_status(t: Tables) -> DataFrame:
    return progress.finish_status(_status(t)).select("doc_id", "status", "percentage", "partial_available", "resumable")


_LIBRARY = f"""
    j AS (SELECT event_id AS doc_id, {_STATUS_SQL} AS status, (event_id % 100)::DOUBLE AS percentage, 'file' || event_id || '.txt' AS jf FROM events),
    d AS (SELECT doc_id, source || '-' || doc_id || CASE lang WHEN 'en' THEN '.txt' WHEN 'fr' THEN '.md' ELSE '.pdf' END AS file_name,
                 length(regexp_replace(text, '\\s+', '', 'g')) AS character_count FROM documents),
    lib AS (SELECT coalesce(d.doc_id, j.doc_id) AS doc_id, coalesce(file_name, jf) AS file_name, d.doc_id IS NOT NULL AS stored,
              coalesce(status, 'completed') AS status, CASE WHEN status IS NULL THEN 100.0::DOUBLE ELSE percentage END AS percentage,
              coalesce(character_count, 0) AS character_count, coalesce(r, 0) AS document_revision
            FROM d FULL JOIN j ON d.doc_id = j.doc_id LEFT JOIN (SELECT conv_id, max(turn) + 1 AS r FROM conversations GROUP BY 1) v
            ON v.conv_id = coalesce(d.doc_id, j.doc_id)
            WHERE d.doc_id IS NOT NULL OR status <> 'completed')"""


def _library(t: Tables) -> DataFrame:
    ending = F.when(F.col("lang") == "en", ".txt").when(F.col("lang") == "fr", ".md").otherwise(".pdf")
    stored = t.documents.select("doc_id", F.concat(F.concat_ws("-", "source", "doc_id"), ending).alias("file_name"))
    stamp = F.to_timestamp(F.lit(STAMP))
    texts = t.documents.select("doc_id", "text", stamp.alias("edited_at"), F.lit(False).alias("is_draft"))
    return progress.library_listing(stored, _status(t), texts, _versions(t))


@query("library_listing", "WITH " + _LIBRARY + """
    SELECT doc_id, file_name, stored, status, percentage, character_count, document_revision FROM lib""")
def library_listing(t: Tables) -> DataFrame:
    return _library(t).select(
        "doc_id", "file_name", "stored", "status", "percentage", "character_count", "document_revision")


@query("library_page", "WITH " + _LIBRARY + """
    SELECT doc_id, file_name FROM (
      SELECT *, row_number() OVER (ORDER BY file_name, doc_id) AS r FROM lib WHERE contains(lower(file_name), 'src1') AND file_name LIKE '%.txt')
    WHERE r BETWEEN 21 AND 40""")
def library_page(t: Tables) -> DataFrame:
    return progress.filter_library(_library(t), " SRC1", "TXT", page=2, size=20).select("doc_id", "file_name")


@query("viewable_files", f"""
    SELECT event_id AS doc_id FROM events WHERE {_STATUS_SQL} = 'completed'
      OR ({_STATUS_SQL} IN ('paused', 'interrupted') AND event_id % 7 < 4)""")
def viewable_files(t: Tables) -> DataFrame:
    return progress.viewable(_status(t).withColumn("partial_available", F.col("has_result"))).select("doc_id")


@query("publish_points", sql.using("stage") + """
    SELECT job_id, seq FROM stage WHERE completed % 10 = 0 OR seq % 17 = 0 OR completed = total""")
def publish_points(t: Tables) -> DataFrame:
    steps = progress.clamp_events(t.stage_events).withColumn("paused", F.col("seq") % 17 == 0)
    return progress.publish_points(steps).select("job_id", "seq")
