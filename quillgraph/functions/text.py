"""Column expressions over text; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Whitespace as Unicode defines it, written so that both Java and
# RE2 read it the same way.
WS = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
#: The characters of WS one by one, for trims that look at the ends of a text only.
WS_CHARS = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
TRIM_CHARS = " \t\n\r\f\u000b"

# Default label, pronouns and one-letter placeholders that are
# never highlighted.
UNKNOWN_LABEL = "未知标签"
HIGHLIGHT_STOP_TERMS = [
    "我", "你", "您", "他", "她", "它", "我们", "你们", "您们",
    "他们", "她们", "它们", "自己", "大家", "有人", "某人", "对方",
    "i", "you", "he", "she", "it", "we", "they",
]
PLACEHOLDER_TERM = r"^(?:甲|乙|丙|丁|[a-z])$"

# Default offline token: a run of letters and digits, one Han character, or one
# other symbol, each with the whitespace behind it, so that tokens tile the text.
DEFAULT_TOKEN = (
    rf"(?:\p{{IsHan}}|[\p{{L}}\p{{M}}\p{{N}}&&[^\p{{IsHan}}]]+|[^\s\x0B\x1C-\x1F\x85\p{{Z}}]){WS}*|{WS}+"
)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WS_CHARS))


def normalize_ws(text: Column) -> Column:
    """Trim and collapse every whitespace run to one space."""
    return F.trim(F.regexp_replace(text, rf"{WS}+", " "))


def fold(text: Column) -> Column:
    """Whitespace-collapsed lower case, the form in which terms are compared."""
    return F.lower(normalize_ws(text))


def contains(text: Column, term: Column) -> Column:
    return F.contains(text, term)


def tokens(text: Column, pattern: str = DEFAULT_TOKEN) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def count_tokens(text: Column, pattern: str = DEFAULT_TOKEN) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def text_quality(text: Column) -> Column:
    """Share of readable characters: CJK counts most, controls and private use against."""
    size = F.length(text)
    cjk = F.regexp_count(text, F.lit(r"[\x{3400}-\x{9FFF}]"))
    private = F.regexp_count(text, F.lit(r"[\x{E000}-\x{F8FF}]"))
    controls = F.regexp_count(text, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"))
    hidden = F.regexp_count(text, F.lit(r"[\p{C}\p{Z}]"))
    plain = F.regexp_count(text, F.lit(r"[ \n\r\t]"))
    score = cjk * 3.0 + (size - hidden + plain) * 0.1 - private * 8.0 - controls * 12.0
    return F.when(size == 0, F.lit(0.0)).otherwise(score / size)


def prepare_embedding_text(text: Column) -> Column:
    """The whole text with whitespace collapsed; a model's own limit is the embedder's matter."""
    return normalize_ws(text)


def is_highlightable(term: Column) -> Column:
    folded = fold(term)
    return (
        term.isNotNull()
        & (folded != "")
        & ~folded.isin(HIGHLIGHT_STOP_TERMS)
        & ~folded.rlike(PLACEHOLDER_TERM)
    )


def block_id(doc_id: Column, ordinal: Column, text: Column) -> Column:
    """Chunk id that is stable between runs and unique across documents."""
    digest = F.substring(F.sha1(text.cast("binary")), 1, 12)
    return F.concat_ws("_", doc_id.cast("string"), F.lit("block"), ordinal.cast("string"), digest)


def json_string(value: Column) -> Column:
    """``value`` as a quoted JSON string literal."""
    packed = F.to_json(F.struct(value.alias("v")))
    return F.substring(packed, F.lit(6), F.length(packed) - 6)


def digest_id(prefix: str, **fields: Column) -> Column:
    """``prefix`` and 20 hex digits of SHA-1 over a key-sorted JSON object."""
    parts: list[Column] = []
    for index, name in enumerate(sorted(fields)):
        lead = "{" if index == 0 else ", "
        parts += [F.lit(f'{lead}"{name}": '), fields[name]]
    payload = F.concat(*parts, F.lit("}"))
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha1(payload.cast("binary")), 1, 20))


def edge_id(bid: Column, index: Column, source: Column, target: Column,
            relation: Column, context: Column) -> Column:
    return digest_id(
        "edge",
        bid=json_string(bid), index=index.cast("string"), source=json_string(source),
        target=json_string(target), relation=json_string(relation), context=json_string(context),
    )


def preview(text: Column, limit: int = 180) -> Column:
    return F.left(normalize_ws(F.coalesce(text, F.lit(""))), F.lit(limit))
