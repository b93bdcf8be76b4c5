"""SQL fragments that mirror the derived tables in DuckDB."""

from __future__ import annotations

WS = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
ENDS = r".!?\n。！？；;"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def norm(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def bid(text: str = "text", doc: str = "doc_id", ordinal: str = "ordinal") -> str:
    return f"concat_ws('_', {doc}, 'block', {ordinal}, substr(sha1({text}), 1, 12))"


def edge_id(bid: str = "bid", idx: str = "rel_idx") -> str:
    return (
        f"'edge-' || substr(sha1('{{\"bid\": ' || to_json({bid}) || ', \"context\": ' || to_json(context)"
        f" || ', \"index\": ' || {idx} || ', \"relation\": ' || to_json(relation)"
        f" || ', \"source\": ' || to_json(source) || ', \"target\": ' || to_json(target) || '}}'), 1, 20)"
    )


TOKEN = rf"(?:\p{{Han}}|[\p{{L}}\p{{M}}\p{{N}}]+|[^\s\x0B\x1C-\x1F\x85\p{{Z}}]){WS}*|{WS}+"

# Common tables in dependency order: name, what it needs, body.
_PARTS: list[tuple[str, tuple[str, ...], str]] = [
    ("chunks", (), f"""
        SELECT doc_id, lang, ordinal, text, {bid()} AS bid FROM (
          SELECT doc_id, lang, ordinal, {strip('piece')} AS text FROM (
            SELECT doc_id, lang, unnest(parts) AS piece, unnest(range(1, len(parts) + 1))::INT AS ordinal FROM (
              SELECT doc_id, lang, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS parts
              FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS p FROM documents))))"""),
    ("gaz", (), r"""
        SELECT lang AS type, name, count(*) AS doc_freq FROM (
          SELECT DISTINCT doc_id, lang, unnest(regexp_extract_all(lower(text), '\p{L}{8,}')) AS name FROM documents)
        GROUP BY lang, name HAVING count(*) >= 2"""),
    ("sents", ("chunks",), f"""
        SELECT doc_id, lang, ordinal, bid, unnest(s) AS sentence, unnest(range(len(s)))::INT AS sent FROM (
          SELECT *, regexp_extract_all(text, '[^{ENDS}]*[{ENDS}]|[^{ENDS}]+') AS s FROM chunks)"""),
    ("mentions", ("sents", "gaz"), r"""
        SELECT doc_id, bid, ordinal, w.type, sent, pos, w.name FROM (
          SELECT doc_id, lang AS type, ordinal, bid, sent, unnest(l) AS name, unnest(range(len(l)))::INT AS pos FROM (
            SELECT *, regexp_extract_all(lower(sentence), '\p{L}{8,}') AS l FROM sents)) w
        SEMI JOIN gaz ON w.type = gaz.type AND w.name = gaz.name"""),
    ("ents", ("mentions",), """
        SELECT doc_id, bid, ordinal, (row_number() OVER (PARTITION BY doc_id, bid, ordinal ORDER BY met) - 1)::INT AS pos, name, type
        FROM (SELECT doc_id, bid, ordinal, name, min({'sent': sent, 'pos': pos}) AS met, min(type) AS type
              FROM mentions GROUP BY doc_id, bid, ordinal, name)"""),
    ("rel", ("mentions", "sents"), f"""
        SELECT g.doc_id, g.bid, g.ordinal,
               row_number() OVER (PARTITION BY g.doc_id, g.bid ORDER BY met) - 1 AS rel_idx,
               source, target, 'co-occurs' AS relation, {strip('s.sentence')} AS context,
               least(1.0::DOUBLE, 0.5::DOUBLE + 0.1::DOUBLE * (n - 1)) AS weight, 'extracted' AS origin
        FROM (SELECT doc_id, bid, ordinal, source, name AS target, count(*) AS n, min(sent::BIGINT * 4294967296 + pos) AS met
              FROM (SELECT *, lag(name) OVER (PARTITION BY doc_id, bid, ordinal, sent ORDER BY pos) AS source FROM mentions)
              WHERE source <> name GROUP BY doc_id, bid, ordinal, source, name) g
        JOIN sents s ON g.bid = s.bid AND s.sent = g.met // 4294967296"""),
    ("labels", ("ents",), """
        SELECT doc_id, name, arg_min(type, ordinal::BIGINT * 4294967296 + pos) AS label,
               min(ordinal::BIGINT * 4294967296 + pos) AS first_pos FROM ents GROUP BY doc_id, name"""),
    ("edges", ("rel",), f"""
        SELECT doc_id AS graph_id, source, target, arg_max(eid, seq) AS edge_id, arg_max(relation, seq) AS label,
               arg_max(context, seq) AS title, arg_max(weight, seq) AS weight, arg_max(bid, seq) AS bid,
               min(seq) AS first_at
        FROM (SELECT *, ordinal::BIGINT * 4294967296 + rel_idx AS seq, {edge_id()} AS eid FROM rel)
        GROUP BY doc_id, source, target"""),
    ("ends", ("edges",), """
        SELECT graph_id, source AS node, 0 AS role, first_at FROM edges
        UNION ALL SELECT graph_id, target, 1, first_at FROM edges"""),
    ("deg", ("ends",), "SELECT graph_id, node, count(*) AS degree FROM ends GROUP BY graph_id, node"),
    ("nodes", ("ends", "labels"), """
        SELECT e.graph_id, e.node, coalesce(l.label, '未知标签') AS label
        FROM (SELECT DISTINCT graph_id, node FROM ends) e
        LEFT JOIN labels l ON l.doc_id = e.graph_id AND l.name = e.node"""),
    ("comm", ("ends",), "SELECT DISTINCT graph_id, node, length(node) % 5 AS community_id FROM ends"),
    ("supply", (), """
        SELECT 0 AS graph_id, 'S' || l_suppkey AS source, 'P' || l_partkey AS target,
               'edge-' || l_suppkey || '-' || l_partkey AS edge_id, 'supplies' AS label, sum(l_quantity) AS weight
        FROM lineitem GROUP BY l_suppkey, l_partkey"""),
    ("sends", ("supply",), """
        SELECT graph_id, source AS node FROM supply UNION ALL SELECT graph_id, target FROM supply"""),
    ("sdeg", ("sends",), "SELECT graph_id, node, count(*) AS degree FROM sends GROUP BY graph_id, node"),
    ("scomm", ("sends",), """
        SELECT DISTINCT graph_id, node, substr(node, 2)::BIGINT % 7 AS community_id FROM sends"""),
    ("sales", (), """
        SELECT c_nationkey AS buyer, s_nationkey AS seller, sum(l_extendedprice * (1 - l_discount)) AS revenue
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2"""),
    ("trade", ("sales",), """
        SELECT 0 AS graph_id, b.n_name AS source, s.n_name AS target, b.n_name || '-' || s.n_name AS edge_id,
               'buys from' AS label, round(revenue / (SELECT max(revenue) FROM sales), 6) AS weight,
               buyer::BIGINT * 1000 + seller AS first_at
        FROM sales JOIN nation b ON buyer = b.n_nationkey JOIN nation s ON seller = s.n_nationkey"""),
    ("tcomm", (), "SELECT 0 AS graph_id, n_name AS node, n_regionkey::BIGINT AS community_id FROM nation"),
    ("stage", (), """
        SELECT user_id::VARCHAR AS job_id, event_id AS seq,
               ['entity_extraction', 'relationship_extraction', 'knowledge_fusion'][event_id % 3 + 1] AS stage,
               least(length(props) + event_id % 50, 60) AS completed, 60 AS total, value AS item_seconds FROM events"""),
]
_BY_NAME = {name: (needs, body) for name, needs, body in _PARTS}


def using(*names: str, extra: str = "", first: dict[str, str] | None = None, given: dict[str, str] | None = None) -> str:
    """A WITH clause that defines the named tables and everything they need.

    ``first`` are tables put before all others, ``given`` bodies that take the place of named ones.
    """
    given = given or {}
    wanted: set[str] = set()

    def need(name: str) -> None:
        if name not in wanted:
            wanted.add(name)
            for other in () if name in given else _BY_NAME[name][0]:
                need(other)

    for name in names:
        need(name)
    parts = [f"{name} AS MATERIALIZED ({body})" for name, body in (first or {}).items()]
    parts += [f"{name} AS MATERIALIZED ({given.get(name, body)})" for name, _, body in _PARTS if name in wanted]
    if extra:
        parts.append(extra)
    return "WITH " + ", ".join(parts) + " "


def body(name: str) -> str:
    """The query behind one of the named tables."""
    return _BY_NAME[name][1]
