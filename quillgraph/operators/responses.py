"""Model responses as tables: finding their JSON, choosing attempts, reading answers."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quillgraph.functions.text import strip

# The fence around JSON, the heading of quoted material, and the
# finish reasons that mean an answer was cut off.
FENCE = r"(?i)```(?:json)?\s*([\s\S]*?)\s*```"
MATERIAL_HEADING = r"参考资料[：:]([\s\S]+)$"
TRUNCATED = ["length", "max_tokens"]

# A JSON string: plain characters, then any escapes with plain characters behind them.
JSON_STRING = r'"([^"\\]*(?:\\.[^"\\]*)*)"'
_TOKEN = re.compile(JSON_STRING + r"|[\[\]{}]", re.S)


def _string_field(field: str) -> str:
    """A field whose value is a string, or a list that begins with one."""
    return rf'"{field}"\s*:\s*\[?\s*{JSON_STRING}'


def _balanced(text: str | None) -> str | None:
    """The first part of a text whose brackets close again, if it is JSON.

    Walks over strings and brackets only; a bracket inside a string does not count.
    """
    start, depth = None, 0
    for token in _TOKEN.finditer(text or ""):
        if start is None and token[0][0] == '"':
            continue
        if token[0] in "{[":
            start = token.start() if start is None else start
            depth += 1
        elif token[0] in "}]" and start is not None:
            depth -= 1
            if depth == 0:
                part = text[start: token.end()]
                try:
                    json.loads(part)
                except json.JSONDecodeError:
                    return None
                return part
    return None


def _leading_json(fenced: pd.Series, whole: pd.Series) -> pd.Series:
    return pd.Series([_balanced(a) or _balanced(b) for a, b in zip(fenced, whole)], dtype=object)


def _if_json(text: Column) -> Column:
    return F.when(F.try_parse_json(text).isNotNull(), text)


def find_json(df: DataFrame, raw: str, into: str) -> DataFrame:
    """Add the JSON text inside a response: fenced, whole, or surrounded by prose.

    Clean JSON is found in the JVM; only responses with prose go to Python.
    """
    body = strip(F.col(raw))
    fenced = F.nullif(F.regexp_extract(F.col(raw), FENCE, 1), F.lit(""))
    clean = _if_json(F.coalesce(fenced, body))
    return (
        df.withColumn("_clean", clean)
        .withColumn("_rest", F.pandas_udf(_leading_json, "string")(
            F.when(F.col("_clean").isNull(), fenced), F.when(F.col("_clean").isNull(), F.col(raw))))
        .withColumn(into, F.coalesce("_clean", "_rest"))
        .drop("_clean", "_rest")
    )


def parse_model_json(responses: DataFrame, expected_key: str) -> DataFrame:
    """Add ``payload`` (a JSON object holding the key) and ``reason`` (null when valid)."""
    found = find_json(responses, "raw", "_json")
    keys = F.json_object_keys("_json")
    reason = (
        F.when(F.col("finish_reason").isin(TRUNCATED), "truncated")
        .when(strip(F.coalesce("raw", F.lit(""))) == "", "empty")
        .when(F.col("_json").isNull(), "invalid_json")
        .when(keys.isNull(), "not_object")
        .when(~F.array_contains(keys, expected_key), "missing_key")
    )
    return (
        found.withColumn("reason", reason)
        .withColumn("payload", F.when(F.col("reason").isNull(), F.col("_json")))
        .drop("_json")
    )


def resolve_attempts(responses: DataFrame, expected_key: str) -> DataFrame:
    """First valid attempt per request: primary once, then backups; or primary repeatedly.

    Without a valid one the last format or truncation error is reported, else the
    last error of any kind (a failed call has ``finish_reason='error'``).
    """
    parsed = parse_model_json(responses, expected_key).withColumn(
        "reason", F.when(F.col("finish_reason") == "error", "request_failed").otherwise(F.col("reason")))
    backup = F.col("provider") == "backup"
    order = F.struct(backup.cast("int").alias("b"), F.col("attempt"))
    pick = F.struct("provider", "attempt", "payload")
    valid = F.col("reason").isNull()
    allowed = backup | (F.col("attempt") == 1)
    best = parsed.groupBy("request_id").agg(
        F.max(backup).alias("_has_backup"),
        F.min_by(F.when(valid & allowed, pick), F.when(valid & allowed, order)).alias("_mixed"),
        F.min_by(F.when(valid, pick), F.when(valid, order)).alias("_single"),
        F.max_by("reason", F.when(~valid & allowed & (F.col("reason") != "request_failed"), order)).alias("_format"),
        F.max_by("reason", F.when(~valid, order)).alias("_any"),
    )
    chosen = F.when(F.col("_has_backup"), F.col("_mixed")).otherwise(F.col("_single"))
    return best.withColumn("_pick", chosen).select(
        "request_id", "_pick.provider", "_pick.attempt", "_pick.payload",
        F.when(F.col("_pick").isNull(), F.coalesce("_format", "_any")).alias("error"),
    )


def _joined_text(json_text: Column, field: str) -> Column:
    """A string field, or a list of them joined by newlines."""
    value = F.get_json_object(json_text, f"$.{field}")
    items = F.from_json(value, "array<string>")
    listed = F.array_join(F.array_compact(items), "\n")
    is_list = value.startswith("[") & items.isNotNull()
    return strip(F.coalesce(F.when(is_list, listed).otherwise(value), F.lit("")))


def _recovered(raw: Column, field: str) -> Column:
    """The completed string behind ``"field":`` in JSON that breaks off later."""
    literal = F.regexp_extract(raw, _string_field(field), 1)
    decoded = F.from_json(F.concat(F.lit('{"v":"'), literal, F.lit('"}')), "v string").v
    return strip(F.coalesce(decoded, literal))


def parse_answers(responses: DataFrame) -> DataFrame:
    """Answer and quoted material of each response, from JSON, plain or cut-off text."""
    found = find_json(responses, "raw", "_json")
    body = strip(F.coalesce("raw", F.lit("")))
    plain = F.col("_json").isNull() & (body != "") & ~F.contains(body, F.lit("{")) & ~F.contains(
        F.lower(body), F.lit("```json"))
    cut = F.col("finish_reason").isin(TRUNCATED)
    has_answer = F.col("raw").rlike(_string_field("answer"))
    is_object = F.json_object_keys("_json").isNotNull()
    before = strip(F.regexp_replace(body, MATERIAL_HEADING, ""))
    after = strip(F.regexp_extract(body, MATERIAL_HEADING, 1))
    kind = (
        F.when(~cut & is_object, "json")
        .when(~cut & plain, "plain")
        .when(has_answer, "recovered")
        .otherwise("invalid")
    )
    by_kind = lambda as_json, as_plain, as_recovered: (
        F.when(F.col("kind") == "json", as_json)
        .when(F.col("kind") == "plain", as_plain)
        .when(F.col("kind") == "recovered", as_recovered))
    return (
        found.withColumn("kind", kind)
        .withColumn("answer", by_kind(
            _joined_text(F.col("_json"), "answer"), before, _recovered(F.col("raw"), "answer")))
        .withColumn("material", by_kind(
            _joined_text(F.col("_json"), "material"), after, _recovered(F.col("raw"), "material")))
        .drop("_json")
    )
