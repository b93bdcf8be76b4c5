"""Question-and-answer tables in Markdown notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillgraph.functions.text import strip

# The section title, header cell and markers of the note format.
SECTION = r"^##\s*问答"
HEADER_ROW = r"^\|\s*问题"
RULE_ROW = r"^\|\s*:?-+"
BREAK_MARK = "[换行]"
DROPPED_PREFIX = "目前："
END_MARK = "</end>"


def _pairs(lines: Column) -> Column:
    """Question and answer cells of the table, in order."""
    begin = F.array_position(F.transform(lines, lambda x: x.rlike(SECTION)), True).cast("int")
    body = F.when(begin > 0, F.slice(lines, begin + 1, F.size(lines))).otherwise(
        F.array().cast("array<string>"))
    stops = F.transform(
        body,
        lambda x: ((strip(x) == "") | x.startswith("#")) & ~x.rlike(SECTION),
    )
    stop = F.array_position(stops, True).cast("int")
    table = F.when(stop > 0, F.slice(body, 1, stop - 1)).otherwise(body)
    rows = F.filter(
        table,
        lambda x: x.startswith("|") & ~x.rlike(HEADER_ROW) & ~x.rlike(RULE_ROW),
    )
    cells = F.transform(
        rows,
        lambda x: F.transform(
            F.split(F.regexp_replace(x, r"^\|+|\|+$", ""), r"\|", -1), lambda c: strip(c)),
    )
    return F.filter(cells, lambda c: F.size(c) >= 2)


def markdown_qa_to_text(df: DataFrame, text: str = "text", on_missing: str = "empty") -> DataFrame:
    """Replace Markdown by numbered question/answer blocks.

    A note without the section becomes empty text, or stays as it is with
    ``on_missing='raw'``.  Everything happens inside the document's row.
    """
    if on_missing not in {"empty", "raw"}:
        raise ValueError("on_missing must be 'empty' or 'raw'")
    lines = F.split(F.col(text), r"\r\n|\r|\n", -1)
    question = lambda c: strip(F.replace(F.replace(c[0], F.lit(BREAK_MARK), F.lit("\n")),
                                         F.lit(DROPPED_PREFIX), F.lit("")))
    answer = lambda c: strip(F.replace(c[1], F.lit(BREAK_MARK), F.lit("\n")))
    blocks = F.transform(
        F.col("_pairs"),
        lambda c, i: F.when(
            (question(c) != "") | (answer(c) != ""),
            F.concat(
                F.lit("Q"), (i + 1).cast("string"), F.lit(":"), question(c),
                F.lit("\nA"), (i + 1).cast("string"), F.lit(":"), answer(c),
                F.lit(f"\n{END_MARK}"),
            ),
        ),
    )
    joined = F.array_join(F.filter(blocks, lambda b: b.isNotNull()), "\n")
    if on_missing == "raw":
        has_section = F.exists(lines, lambda x: x.rlike(SECTION))
        joined = F.when(has_section, joined).otherwise(F.col(text))
    return df.withColumn("_pairs", _pairs(lines)).withColumn(text, joined).drop("_pairs")
