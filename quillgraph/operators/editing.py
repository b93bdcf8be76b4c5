"""Graph edits, their validation, and versions of graphs and documents.

A document's log of edits is composed into one effect before the graph is touched, so
labels and relations are rewritten once, whatever the length of the log.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from quillgraph.functions.text import UNKNOWN_LABEL, strip
from quillgraph.operators.entities import ORDER_STRIDE
from quillgraph.operators.graph import MANUAL_ORIGIN, with_edge_ids
from quillgraph.session import materialise

# The block of manual edges and the readable operation names.
MANUAL_BLOCK = "__manual_graph_edits__"
MANUAL_ORDINAL = 2_000_000_000
OPERATION_LABELS = {
    "add_node": "新增节点", "update_node": "修改节点", "delete_node": "删除节点",
    "add_edge": "新增关系", "update_edge": "修改关系", "delete_edge": "删除关系",
    "redraw_graph": "重新绘制图谱",
}
DOCUMENT_LABELS = (
    ("before:document_edit", "文档修改前"), ("document_edit", "文档修改后"),
    ("before:document_restore", "文档还原前"),
)
MAX_NAME, MAX_LABEL, MAX_RELATION, MAX_CONTEXT = 500, 100, 200, 5000


def _or_null(col: str) -> Column:
    return F.nullif(strip(F.col(col)), F.lit(""))


def _resolved(mutations: DataFrame, labels: DataFrame, rel: DataFrame) -> DataFrame:
    """Each edit with the stored node and edge it refers to and its defaults filled in."""
    m = mutations.select(
        "doc_id", "seq", "operation", "weight",
        *[_or_null(c).alias(c) for c in (
            "node_id", "name", "entity_type", "edge_id", "source", "target", "relation", "context")])
    edge = with_edge_ids(rel).select(
        "doc_id", F.col("edit_id").alias("edge_id"), F.col("source").alias("_s"), F.col("target").alias("_t"),
        F.col("relation").alias("_r"), F.col("context").alias("_c"), F.col("weight").alias("_w"),
        F.lit(True).alias("_edge")).dropDuplicates(["doc_id", "edge_id"])
    node = labels.select("doc_id", F.col("name").alias("node_id"), F.col("label").alias("_label"))
    exists = lambda col, flag: labels.select("doc_id", F.col("name").alias(col), F.lit(True).alias(flag))
    filled = (
        m.join(edge, ["doc_id", "edge_id"], "left").join(node, ["doc_id", "node_id"], "left")
        .withColumn("new_name", F.coalesce("name", "node_id"))
        .withColumn("source", F.coalesce("source", "_s")).withColumn("target", F.coalesce("target", "_t"))
        .withColumn("relation", F.coalesce("relation", "_r"))
        .withColumn("context", F.coalesce("context", "_c", "relation"))
        .withColumn("weight", F.coalesce("weight", "_w", F.lit(0.5)))
        .withColumn("label", F.coalesce("entity_type", "_label", F.lit(UNKNOWN_LABEL))))
    return (
        filled.join(exists("new_name", "_taken"), ["doc_id", "new_name"], "left")
        .join(exists("source", "_has_source"), ["doc_id", "source"], "left")
        .join(exists("target", "_has_target"), ["doc_id", "target"], "left"))


def validate_mutations(mutations: DataFrame, labels: DataFrame, rel: DataFrame) -> DataFrame:
    """Edits with ``reject_reason`` (null when valid) against the given state."""
    op = F.col("operation")
    too_long = lambda col, limit: F.coalesce(F.length(col) > limit, F.lit(False))
    ends = F.col("_has_source").isNull() | F.col("_has_target").isNull()
    on_edge = op.isin("add_edge", "update_edge")
    checks = [
        (~op.isin([o for o in OPERATION_LABELS if o != "redraw_graph"]), "unknown_operation"),
        (op.isin("update_node", "delete_node") & F.col("node_id").isNull(), "blank_node"),
        ((op == "add_node") & F.col("name").isNull(), "blank_name"),
        (op.isin("update_edge", "delete_edge") & F.col("edge_id").isNull(), "blank_edge"),
        (op.isin("add_node", "update_node") & too_long("new_name", MAX_NAME), "name_too_long"),
        (op.isin("add_node", "update_node") & too_long("label", MAX_LABEL), "type_too_long"),
        ((op == "add_node") & F.col("_taken").isNotNull(), "node_exists"),
        (op.isin("update_node", "delete_node") & F.col("_label").isNull(), "node_missing"),
        ((op == "update_node") & (F.col("new_name") != F.col("node_id")) & F.col("_taken").isNotNull(), "name_taken"),
        (op.isin("update_edge", "delete_edge") & F.col("_edge").isNull(), "edge_missing"),
        (on_edge & (F.col("source").isNull() | F.col("target").isNull()), "blank_endpoint"),
        (on_edge & ends, "endpoint_missing"),
        (on_edge & F.col("relation").isNull(), "blank_relation"),
        (on_edge & too_long("relation", MAX_RELATION), "relation_too_long"),
        (on_edge & too_long("context", MAX_CONTEXT), "context_too_long"),
        (on_edge & ~F.col("weight").between(0.0, 1.0), "weight_out_of_range"),
    ]
    reason = F.lit(None).cast("string")
    for condition, name in reversed(checks):
        reason = F.when(condition, F.lit(name)).otherwise(reason)
    return _resolved(mutations, labels, rel).withColumn("reject_reason", reason).select(
        "doc_id", "seq", "operation", "node_id", "new_name", "label", "edge_id", "source", "target",
        "relation", "context", "weight", "reject_reason")


def check_revision(mutations: DataFrame, versions: DataFrame) -> DataFrame:
    """Mark edits whose revision is not their document's latest (0 without versions)."""
    latest = versions.groupBy("doc_id").agg(F.max("revision").alias("_latest"))
    return mutations.join(latest, "doc_id", "left").withColumn(
        "stale", F.col("revision").isNotNull() & (F.col("revision") != F.coalesce("_latest", F.lit(0)))).drop("_latest")


# -- applying a log of edits ----------------------------------------------------

_EDIT_TEXTS = ("node_id", "name", "entity_type", "edge_id", "source", "target", "relation", "context")
_CHECKED = ("seq", "operation", "node_id", "new_name", "label", "edge_id", "source", "target", "relation", "context", "weight", "reject_reason")
_EDGE_TEXTS = ("source", "target", "relation", "context")


def _json_text(value: str) -> str:
    """A JSON string as the engine's own digests write it."""
    return re.sub(r"\\u00[0-9a-f]{2}", lambda m: m[0][:4] + m[0][4:].upper(), json.dumps(value, ensure_ascii=False))


class _Names:
    """Where the names of relation ends have got to: a rename moves all names that are at its start."""

    def __init__(self) -> None:
        self.now: dict[str, str | None] = {}
        self.here: dict[str, set[str]] = {}

    def move(self, old: str, new: str | None) -> None:
        group = self._at(old)
        self.here[old] = set()
        for name in group:
            self.now[name] = new
        if new is not None:
            other = self._at(new)
            small, large = sorted((group, other), key=len)
            large |= small
            self.here[new] = large

    def _at(self, name: str) -> set[str]:
        if name not in self.here:
            self.here[name] = set() if name in self.now else {name}
        return self.here[name]


class _DocumentLog:
    """One document's edits in order, over the names and edges that they refer to.

    The whole log becomes one effect: where every name has got to, the nodes that changed,
    and the edges that are new, changed or gone.
    """

    def __init__(self) -> None:
        self.nodes: dict[str, list] = {}      # name now -> [first name or None, label, seq of its edit]
        self.lost: list[str] = []             # first names of deleted nodes
        self.removed: list[str] = []          # stored edges that are gone
        self.edges: dict[str, dict] = {}
        self.at_end: dict[str, set[str]] = {}
        self.names = _Names()
        self.manual = 0                       # rows of the block of manual edges, and their highest number
        self.numbers: list[tuple[int, str]] = []
        self.rejected: list[dict] = []

    def know_node(self, row: dict) -> None:
        self.nodes[row["node_id"]] = [row["node_id"], row["label"], None]

    def know_edge(self, row: dict) -> None:
        key = row["edge_id"]
        if key in self.edges:
            self.edges[key]["copies"] += 1
            self.edges[key]["rel_idx"] = max(self.edges[key]["rel_idx"], row["rel_idx"])
        else:
            self.edges[key] = {c: row[c] for c in (*_EDGE_TEXTS, "weight", "rel_idx", "manual")} | {"copies": 1, "new": False}
            self._link(key)
        if row["manual"]:
            self.manual += 1
            heapq.heappush(self.numbers, (-row["rel_idx"], key))

    def _link(self, key: str) -> None:
        for end in ("source", "target"):
            self.at_end.setdefault(self.edges[key][end], set()).add(key)

    def _unlink(self, key: str) -> None:
        for end in ("source", "target"):
            self.at_end.get(self.edges[key][end], set()).discard(key)

    def _drop(self, key: str) -> None:
        self._unlink(key)
        edge = self.edges[key]
        self.manual -= edge["copies"] * edge["manual"]
        if not edge["new"]:
            self.removed.append(key)
        del self.edges[key]

    def _last_number(self) -> int:
        while self.numbers and self.numbers[0][1] not in self.edges:
            heapq.heappop(self.numbers)
        return -self.numbers[0][0] if self.numbers else -1

    def filled(self, edit: dict) -> dict:
        """The edit with what it leaves open taken from the node or edge that it names."""
        node, edge = self.nodes.get(edit["node_id"]), self.edges.get(edit["edge_id"], {})
        given = lambda name: edit[name] if edit[name] is not None else edge.get(name)
        out = {c: edit[c] for c in ("seq", "operation", "node_id", "edge_id")} | {c: given(c) for c in ("source", "target", "relation")}
        context, weight = given("context"), given("weight")
        return out | {
            "new_name": edit["node_id"] if edit["name"] is None else edit["name"],
            "label": next((x for x in (edit["entity_type"], node and node[1]) if x is not None), UNKNOWN_LABEL),
            "context": out["relation"] if context is None else context, "weight": 0.5 if weight is None else weight}

    def fault(self, e: dict) -> str | None:
        """Why the edit cannot be applied now, by the order of ``validate_mutations``."""
        op, about_node, about_edge = e["operation"], e["operation"] in ("update_node", "delete_node"), e["operation"] in ("update_edge", "delete_edge")
        named, linked = op in ("add_node", "update_node"), op in ("add_edge", "update_edge")
        long = lambda field, limit: e[field] is not None and len(e[field]) > limit
        taken = e["new_name"] in self.nodes
        checks = (
            ("unknown_operation", op not in OPERATION_LABELS or op == "redraw_graph"),
            ("blank_node", about_node and e["node_id"] is None),
            ("blank_name", op == "add_node" and e["new_name"] is None),
            ("blank_edge", about_edge and e["edge_id"] is None),
            ("name_too_long", named and long("new_name", MAX_NAME)), ("type_too_long", named and long("label", MAX_LABEL)),
            ("node_exists", op == "add_node" and taken),
            ("node_missing", about_node and e["node_id"] not in self.nodes),
            ("name_taken", op == "update_node" and e["new_name"] != e["node_id"] and taken),
            ("edge_missing", about_edge and e["edge_id"] not in self.edges),
            ("blank_endpoint", linked and (e["source"] is None or e["target"] is None)),
            ("endpoint_missing", linked and not (e["source"] in self.nodes and e["target"] in self.nodes)),
            ("blank_relation", linked and e["relation"] is None),
            ("relation_too_long", linked and long("relation", MAX_RELATION)), ("context_too_long", linked and long("context", MAX_CONTEXT)),
            ("weight_out_of_range", linked and not 0.0 <= e["weight"] <= 1.0))
        return next((name for name, bad in checks if bad), None)

    def edit(self, row: dict) -> None:
        e = self.filled(row)
        if reason := self.fault(e):
            self.rejected.append(e | {"reject_reason": reason})
            return
        getattr(self, "_" + e["operation"])(e)

    def _add_node(self, e: dict) -> None:
        self.nodes[e["new_name"]] = [None, e["label"], e["seq"]]

    def _update_node(self, e: dict) -> None:
        first, _, seq = self.nodes.pop(e["node_id"])
        self.nodes[e["new_name"]] = [first, e["label"], seq if seq is not None else -1]
        if e["new_name"] != e["node_id"]:
            self.names.move(e["node_id"], e["new_name"])
            for key in self.at_end.pop(e["node_id"], set()):
                for end in ("source", "target"):
                    if self.edges[key][end] == e["node_id"]:
                        self.edges[key][end] = e["new_name"]
                self._link(key)

    def _delete_node(self, e: dict) -> None:
        first, _, _ = self.nodes.pop(e["node_id"])
        if first is not None:
            self.lost.append(first)
        self.names.move(e["node_id"], None)
        for key in list(self.at_end.get(e["node_id"], ())):
            self._drop(key)

    def _add_edge(self, e: dict) -> None:
        fields = {c: _json_text(e[c]) for c in _EDGE_TEXTS} | {"count": str(self.manual)}
        text = "{" + ", ".join(f'"{name}": {fields[name]}' for name in sorted(fields)) + "}"
        key = name = "edge-" + hashlib.sha1(text.encode()).hexdigest()[:20]
        while key in self.edges:   # an edge of the same id is there: edits that give the id mean that one
            key += "'"
        self.edges[key] = {c: e[c] for c in (*_EDGE_TEXTS, "weight")} | {
            "id": name, "rel_idx": self._last_number() + 1, "manual": True, "copies": 1, "new": True}
        self.manual += 1
        heapq.heappush(self.numbers, (-self.edges[key]["rel_idx"], key))
        self._link(key)

    def _update_edge(self, e: dict) -> None:
        self._unlink(e["edge_id"])
        self.edges[e["edge_id"]] |= {c: e[c] for c in (*_EDGE_TEXTS, "weight")}
        self._link(e["edge_id"])

    def _delete_edge(self, e: dict) -> None:
        self._drop(e["edge_id"])

    def effects(self) -> list[dict]:
        out = [{"kind": "rejected"} | r for r in self.rejected]
        out += [{"kind": "end", "node_id": old, "new_name": new} for old, new in self.names.now.items() if old != new]
        out += [{"kind": "node", "node_id": first} for first in self.lost]
        out += [{"kind": "node", "node_id": first, "new_name": name, "label": label, "seq": seq}
                for name, (first, label, seq) in self.nodes.items() if seq is not None]
        out += [{"kind": "edge", "edge_id": key, "gone": True} for key in self.removed]
        return out + [{"kind": "new_edge" if edge["new"] else "edge", "edge_id": edge.get("id", key), "gone": False}
                      | {c: edge[c] for c in (*_EDGE_TEXTS, "weight", "rel_idx")} for key, edge in self.edges.items()]


_STATE = ("kind int, seq bigint, operation string, " + ", ".join(f"{c} string" for c in _EDIT_TEXTS)
          + ", label string, weight double, rel_idx int, manual boolean")


def _state_rows(rows: DataFrame, kind: int) -> DataFrame:
    """Rows of one kind (0 nodes, 1 edges, 2 edits) in the columns that the log reads."""
    fields = [f.strip().split(" ") for f in _STATE.split(",")]
    return rows.select("doc_id", *[
        F.lit(kind).alias(n) if n == "kind" else (F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in fields])


def _composed(labels: DataFrame, rel: DataFrame, mutations: DataFrame) -> DataFrame:
    """The effect of each document's whole log: rows of kind rejected, end, node, edge, new_edge."""
    log = mutations.select("doc_id", "seq", "operation", "weight", *[_or_null(c).alias(c) for c in _EDIT_TEXTS])
    wanted = log.filter("edge_id is not null").select("doc_id", "edge_id").distinct()
    columns = ("doc_id", F.col("edit_id").alias("edge_id"), *_EDGE_TEXTS, "weight", "rel_idx",
               F.coalesce(F.col("bid") == MANUAL_BLOCK, F.lit(False)).alias("manual"))
    stored = rel.select(*columns)
    edges = stored.join(wanted, ["doc_id", "edge_id"], "left_semi").filter(~F.col("manual")).unionByName(
        stored.filter("manual").join(log.select("doc_id").distinct(), "doc_id", "left_semi"))
    edges = materialise(edges)
    said = log.select("doc_id", F.explode(F.array("node_id", "name", "source", "target")).alias("node_id")).unionByName(
        edges.select("doc_id", F.explode(F.array("source", "target")).alias("node_id"))).filter("node_id is not null").distinct()
    nodes = labels.select("doc_id", F.col("name").alias("node_id"), "label").join(said, ["doc_id", "node_id"], "left_semi")
    state = _state_rows(nodes, 0).unionByName(_state_rows(edges, 1)).unionByName(_state_rows(log, 2))
    kinds = {"seq": (pa.int64(), "bigint"), "weight": (pa.float64(), "double"), "rel_idx": (pa.int32(), "int"), "gone": (pa.bool_(), "boolean")}
    out_fields = [(n, *kinds.get(n, (pa.string(), "string"))) for n in ("kind", *_CHECKED, "rel_idx", "gone")]
    schema = T.StructType([mutations.schema["doc_id"], *T.StructType.fromDDL(", ".join(f"{n} {t}" for n, _, t in out_fields))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, doc, log = None, None, None

        def done() -> Iterator[pa.RecordBatch]:
            effects = [{"doc_id": doc} | e for e in log.effects()] if log else []
            if effects:
                yield pa.RecordBatch.from_pylist(effects, schema=arrow)

        for batch in batches:
            arrow = arrow or pa.schema([batch.schema.field("doc_id"), *((n, t) for n, t, _ in out_fields)])
            for row in batch.to_pylist():
                if log is None or row["doc_id"] != doc:
                    yield from done()
                    doc, log = row["doc_id"], _DocumentLog()
                (log.know_node, log.know_edge, log.edit)[row["kind"]](row)
        yield from done()

    return state.repartition("doc_id").sortWithinPartitions("doc_id", "kind", "seq").mapInArrow(run, schema)


def apply_mutations(labels: DataFrame, rel: DataFrame,
                    mutations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply every edit in ``seq`` order; returns labels, relations and rejected edits.

    A rejected edit changes nothing and the following ones still run.  A document's log is
    composed first, over the nodes and edges that it names; then labels and relations are
    read once, however many edits there are.  Edits depend on those before them, so one task
    walks over a document's log; it holds what the log names, not the document's graph.
    """
    rel = with_edge_ids(rel)
    effects = materialise(_composed(labels, rel, mutations))
    of = lambda kind: effects.filter(F.col("kind") == kind)
    nodes = of("node")
    place = F.lit(MANUAL_ORDINAL * ORDER_STRIDE) + F.col("seq")
    changed = nodes.filter("node_id is not null").select(
        "doc_id", F.col("node_id").alias("name"), F.col("new_name").alias("_to"), F.col("label").alias("_label"), F.lit(True).alias("_hit"))
    new_labels = labels.join(changed, ["doc_id", "name"], "left").filter("_hit is null or _to is not null").select(
        "doc_id", F.coalesce("_to", "name").alias("name"), F.coalesce("_label", "label").alias("label"), "first_pos").unionByName(
        nodes.filter("node_id is null").select("doc_id", F.col("new_name").alias("name"), "label", place.alias("first_pos")))

    fields = (*_EDGE_TEXTS, "weight")
    own = of("edge").select("doc_id", F.col("edge_id").alias("edit_id"), "gone", F.struct(*fields).alias("_new"))
    kept = rel.join(own, ["doc_id", "edit_id"], "left").filter("gone is null or not gone")
    for end in ("source", "target"):   # an edge that the log names has its ends from the log
        ends = of("end").select("doc_id", F.col("node_id").alias(end), F.col("new_name").alias("_to"), F.lit(True).alias("_hit"))
        free = F.col("_new").isNull() & F.col("_hit").isNotNull()
        kept = kept.join(ends, ["doc_id", end], "left").filter(~(free & F.col("_to").isNull())).withColumn(
            end, F.when(free, F.col("_to")).otherwise(F.col(end))).drop("_to", "_hit")
    kept = kept.withColumns({c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)) for c in fields})
    columns = ["doc_id", "bid", "ordinal", "rel_idx", "source", "target", "relation", "context", "weight", "origin", "edit_id"]
    made = of("new_edge").select(
        "doc_id", F.lit(MANUAL_BLOCK).alias("bid"), F.lit(MANUAL_ORDINAL).alias("ordinal"), "rel_idx", *_EDGE_TEXTS, "weight",
        F.lit(MANUAL_ORIGIN).alias("origin"), F.col("edge_id").alias("edit_id"))
    return new_labels, kept.select(*columns).unionByName(made), of("rejected").select("doc_id", *_CHECKED)


# -- versions -----------------------------------------------------------------

def _latest(versions: DataFrame) -> DataFrame:
    return versions.groupBy("doc_id").agg(F.max("revision").alias("_latest"))


def _numbered(commits: DataFrame, versions: DataFrame, before_only: bool) -> DataFrame:
    step = F.array(F.lit(1)) if before_only else F.array(F.lit(1), F.lit(2))
    name = F.when(F.col("_step") == 1, F.concat(F.lit("before:"), F.col("operation"))).otherwise(F.col("operation"))
    return (
        commits.join(_latest(versions), "doc_id", "left").withColumn("_step", F.explode(step))
        .select("doc_id", (F.coalesce("_latest", F.lit(0)) + F.col("_step")).cast("int").alias("revision"),
                name.alias("operation"), "created_at"))


def commit_version(commits: DataFrame, versions: DataFrame) -> DataFrame:
    """Before and after rows of one committed operation (doc_id, operation, created_at) per document."""
    return _numbered(commits, versions, before_only=False)


def commit_snapshot(commits: DataFrame, versions: DataFrame) -> DataFrame:
    """One recoverable row before an operation."""
    return _numbered(commits, versions, before_only=True)


def describe_operation(operation: Column) -> Column:
    known = F.create_map(*[F.lit(v) for pair in OPERATION_LABELS.items() for v in pair])
    plain = lambda op: F.when(
        op.startswith("restore:"), F.concat(F.lit("从历史版本 "), F.substr(op, F.lit(9)), F.lit(" 还原"))
    ).otherwise(F.coalesce(F.try_element_at(known, op), F.lit("图谱修改")))
    return F.when(
        operation.startswith("before:"),
        F.concat(F.lit("修改前快照："), plain(F.substr(operation, F.lit(8))))).otherwise(plain(operation))


def describe_document_operation(operation: Column) -> Column:
    text = F.when(operation.startswith("document_restore:"), F.concat(
        F.lit("还原文档版本 "), F.regexp_extract(operation, r"^document_restore:([\s\S]*)$", 1))).otherwise("文档版本")
    for prefix, label in reversed(DOCUMENT_LABELS):
        text = F.when(operation.startswith(prefix), F.lit(label)).otherwise(text)
    return text


def list_versions(versions: DataFrame, kind: str = "graph") -> DataFrame:
    """Versions without their payload, with a readable description."""
    describe = describe_operation if kind == "graph" else describe_document_operation
    return versions.select("doc_id", "revision", "operation", "created_at",
                           describe(F.col("operation")).alias("description"))


def restore_version(wanted: DataFrame, versions: DataFrame, snapshots: dict[str, DataFrame],
                    created_at: Column) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """State rows of each wanted (doc_id, revision), the version rows to commit, and rejects.

    ``snapshots`` hold the state tables with a ``revision`` column.
    """
    known = wanted.join(versions.select("doc_id", "revision"), ["doc_id", "revision"], "left_semi")
    rejects = wanted.join(versions.select("doc_id", "revision"), ["doc_id", "revision"], "left_anti").withColumn(
        "reject_reason", F.lit("unknown_revision"))
    current = {
        name: df.join(known, ["doc_id", "revision"], "left_semi").drop("revision")
        for name, df in snapshots.items()}
    commits = known.select(
        "doc_id", F.concat(F.lit("restore:"), F.col("revision").cast("string")).alias("operation"),
        created_at.alias("created_at"))
    return current, commit_version(commits, versions), rejects


def append_document_versions(edits: DataFrame, versions: DataFrame, current: DataFrame) -> DataFrame:
    """Version rows of saved drafts: the text before and the text after.

    ``edits``: doc_id, content, created_at.  ``current``: doc_id, text.
    """
    rows = _numbered(edits.select("doc_id", F.lit("document_edit").alias("operation"), "created_at"),
                     versions, before_only=False)
    return (
        rows.join(edits.select("doc_id", F.col("content").alias("_after")), "doc_id")
        .join(current.select("doc_id", F.col("text").alias("_before")), "doc_id", "left")
        .select("doc_id", "revision", "operation", "created_at",
                F.when(F.col("operation").startswith("before:"), F.coalesce("_before", F.lit("")))
                .otherwise(F.col("_after")).alias("content")))


def restore_document(wanted: DataFrame, versions: DataFrame) -> DataFrame:
    """Drafts made from stored document versions (doc_id, revision)."""
    return wanted.join(versions, ["doc_id", "revision"]).select(
        "doc_id", F.col("content").alias("draft"),
        F.concat(F.lit("document_restore:"), F.col("revision").cast("string")).alias("operation"))


def current_text(texts: DataFrame, drafts: DataFrame) -> DataFrame:
    """The draft of each document if there is one, else its processed text."""
    return texts.select("doc_id", F.col("text").alias("_text")).join(
        drafts.select("doc_id", F.col("text").alias("_draft")), "doc_id", "full_outer").select(
        "doc_id", F.coalesce("_draft", "_text", F.lit("")).alias("text"),
        F.col("_draft").isNotNull().alias("is_draft"))
