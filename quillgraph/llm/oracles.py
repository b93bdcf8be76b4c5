"""SQL (DuckDB) for the pipeline queries that SQL can express on whole tables."""

from __future__ import annotations

import math

from quillgraph.llm.quality_rules import FENCE, GAMMA, GROUP_ROWS, SIGNALS, ZERO_BIN
from quillgraph.llm.textkit import WORD
from quillgraph.llm.window_dedup import WINDOW_WORDS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quality_rules() -> str:
    signals = ", ".join(f"('{s}', {s})" for s in SIGNALS)
    least = "CASE signal " + " ".join(f"WHEN '{s}' THEN {x}" for s, x in SIGNALS.items()) + " END"
    pick = ", ".join(f"max(hi) FILTER (signal = '{s}') AS hi_{s}" for s in SIGNALS)
    value = f"CASE WHEN bin = {ZERO_BIN} THEN 0 ELSE 2 * pow({GAMMA}, bin) / ({GAMMA} + 1) END"

    def level(name: str, keys: str) -> str:
        group = f"PARTITION BY {keys}, signal"
        return f"""
    {name} AS (SELECT {keys}, max(total) AS total, {pick}, max(lo) FILTER (signal = 'word_length') AS lo FROM (
        SELECT *, q3 + {FENCE} * greatest(q3 - q1, {least}) AS hi, q1 - {FENCE} * greatest(q3 - q1, {least}) AS lo FROM (
          SELECT {keys}, signal, max(total) AS total, min(v) FILTER (cum >= 0.25 * total) AS q1, min(v) FILTER (cum >= 0.75 * total) AS q3 FROM (
            SELECT {keys}, signal, {value} AS v, sum(n) OVER ({group} ORDER BY bin) AS cum, sum(n) OVER ({group}) AS total FROM (
              SELECT {keys}, signal, bin, sum(n) AS n FROM bins GROUP BY ALL)) GROUP BY {keys}, signal)) GROUP BY {keys})"""

    chosen = lambda c: (f"CASE WHEN g.total >= {GROUP_ROWS} THEN g.{c} WHEN l.total >= {GROUP_ROWS} THEN l.{c} ELSE a.{c} END")
    outside = " OR ".join(f"coalesce(m.{s} > {chosen('hi_' + s)}, false)" for s in SIGNALS)
    return rf"""
    WITH d AS MATERIALIZED (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
    w AS MATERIALIZED (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (
        SELECT doc_id, regexp_extract_all(t, '{WORD}') AS ws FROM d)),
    tri AS (SELECT doc_id, i, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w, w2, w3) AS c FROM tri WHERE w3 IS NOT NULL) WHERE c > 1),
    cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY doc_id),
    ln AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT l) AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)
           WHERE regexp_matches(l, '{WORD}') GROUP BY doc_id),
    nw AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id),
    c AS (SELECT d.doc_id, lang, source, coalesce(nw.n, 0) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
                 length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                 coalesce(ln.dup, 0) AS n_dup_lines, coalesce(ln.n, 0) AS n_lines, coalesce(cov.n, 0) AS n_repeat_words
          FROM d LEFT JOIN nw USING (doc_id) LEFT JOIN ln USING (doc_id) LEFT JOIN cov USING (doc_id)),
    m AS MATERIALIZED (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
          CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0.0 END AS symbols,
          CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0.0 END AS dup_lines,
          CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0.0 END AS repeats,
          CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0.0 END AS word_length FROM c),
    each AS (SELECT lang, source, 0 AS everything, unnest([{', '.join(f"'{s}'" for s in SIGNALS)}]) AS signal, unnest([{', '.join(SIGNALS)}]) AS x
             FROM m WHERE NOT base_failed),
    bins AS MATERIALIZED (SELECT lang, source, everything, signal, CASE WHEN x > 0 THEN ceil(ln(x) / {math.log(GAMMA)!r})::BIGINT ELSE {ZERO_BIN} END AS bin,
             count(*) AS n FROM each GROUP BY ALL),{level('g', 'lang, source')},{level('l', 'lang')},{level('a', 'everything')}
    SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND NOT ({outside} OR coalesce(m.word_length < {chosen('lo')}, false)) AS kept
    FROM m LEFT JOIN g ON g.lang IS NOT DISTINCT FROM m.lang AND g.source IS NOT DISTINCT FROM m.source
    LEFT JOIN l ON l.lang IS NOT DISTINCT FROM m.lang LEFT JOIN a ON true"""


_NGRAM_JOIN = f"""
    WITH ws AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}') AS w FROM documents),
    sh AS MATERIALIZED (SELECT DISTINCT doc_id, md5(array_to_string(list_slice(w, p, p + 3), ' ')) AS s
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS p FROM ws WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
    both_have AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM both_have JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
    ways AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
    reach AS (SELECT * FROM (WITH RECURSIVE r(node, start) AS (
        SELECT DISTINCT a, a FROM ways UNION SELECT ways.b, r.start FROM r JOIN ways ON ways.a = r.node) SELECT * FROM r))
    SELECT doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component, doc_id) AS component_id
    FROM ws LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT node AS doc_id, min(start) AS component FROM reach GROUP BY node) c USING (doc_id)"""

_WINDOW_DEDUP = f"""
    WITH ws AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
    win AS (SELECT doc_id, p, md5(array_to_string(list_slice(w, p, p + {WINDOW_WORDS - 1}), ' ')) AS h
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW_WORDS - 2})) AS p FROM ws)),
    again AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY h) AS c FROM win) WHERE c > 1),
    gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + {WINDOW_WORDS})) AS i FROM again),
    words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM ws),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
    FROM ws LEFT JOIN kept USING (doc_id)"""

_CRC_BYTE = "list_reduce(list_prepend(xor(c, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda a, z: xor(a >> 1, 3988292384::UBIGINT * (a & 1)))"
_CRC = (f"xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)), "
        f"lambda c, b: {_CRC_BYTE}), 4294967295::UBIGINT)")

_PREFIX_TRIE = f"""
    WITH t AS (SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS h,
                      strlen(coalesce(text, '')) AS size FROM conversations WHERE conv_id IS NOT NULL),
    own AS MATERIALIZED (SELECT conv_id, list({{'h': h, 'size': size}} ORDER BY turn NULLS FIRST) AS turns FROM t GROUP BY conv_id),
    hs AS (SELECT conv_id, turns, ({_CRC} % 9)::BIGINT AS h FROM own),
    built AS MATERIALIZED (SELECT a.conv_id, list_concat(list_slice(coalesce(b.turns, []), 1, a.h), list_slice(a.turns, a.h + 1, len(a.turns))) AS turns
        FROM hs a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 5),
    steps AS (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM built),
    pre AS MATERIALIZED (SELECT conv_id, depth, depth = len(turns) AS ends, coalesce(turns[depth].size, 0) AS size,
        list_transform(range(0, depth + 1), lambda d: md5(array_to_string(list_transform(turns[1:d], lambda x: x.h), ''))) AS way FROM steps),
    nodes AS MATERIALIZED (SELECT way[depth + 1] AS node, any_value(way[depth]) AS parent, any_value(way) AS way, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM pre GROUP BY way[depth + 1], depth),
    kids AS MATERIALIZED (SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
    up AS (SELECT unnest(way) AS node, unnest(range(0, n.depth + 1)) AS depth, (k.n_children IS NULL)::INT AS leaf, (n_convs - 1) * size AS saved
        FROM nodes n LEFT JOIN kids k USING (node, depth)),
    below AS (SELECT node, depth, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM up GROUP BY ALL)
    SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
    FROM nodes n JOIN below USING (node, depth) LEFT JOIN kids k USING (node, depth) LEFT JOIN nodes p ON p.node = n.parent AND p.depth = n.depth - 1"""

ORACLES = {
    "op12_prefix_trie": _PREFIX_TRIE,
    "op3_quality_rules": _quality_rules(),
    "op8_ngram_join": _NGRAM_JOIN,
    "op9_window_dedup": _WINDOW_DEDUP,
}
