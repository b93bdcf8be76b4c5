"""Reading order and tables of PDF pages whose layout is already extracted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillgraph.functions.text import normalize_ws, strip

HEADER_BAND = 0.07


def assemble_page_blocks(blocks: DataFrame, tables: DataFrame,
                         header_band: float = HEADER_BAND) -> DataFrame:
    """Blocks of each page in reading order, with tables in place of their inner blocks.

    ``blocks``: doc_id, page, block_no, kind ('text'/'image'), x0, y0, x1, y1,
    page_height, content.  ``tables``: doc_id, page, table_no, x0, y0, x1, y1.
    The tables of one page ride along as a short array, so no block-table pairs
    are built.
    """
    page_tables = tables.groupBy("doc_id", "page").agg(
        F.array_sort(F.collect_list(F.struct("y0", "table_no", "x0", "x1", "y1"))).alias("_tables")
    )
    inside = F.filter(
        F.col("_tables"),
        lambda t: (F.col("x0") >= t.x0) & (F.col("x1") <= t.x1)
        & (F.col("y0") >= t.y0) & (F.col("y1") <= t.y1),
    )
    placed = (
        blocks.filter(F.col("y0") >= F.col("page_height") * header_band)
        .join(page_tables, ["doc_id", "page"], "left")
        .withColumn("table_no", F.get(inside, F.lit(0)).table_no)
        .withColumn("content", F.when(F.col("kind") == "text", normalize_ws(F.col("content")))
                    .otherwise(F.col("content")))
    )
    order = [F.col("y0"), F.col("x0"), F.col("block_no")]
    page = Window.partitionBy("doc_id", "page")
    ranked = placed.withColumn("_rank", F.row_number().over(page.orderBy(*order)))
    firsts = ranked.withColumn(
        "_first", F.min("_rank").over(Window.partitionBy("doc_id", "page", "table_no")))
    kept = firsts.filter(
        (F.col("table_no").isNotNull() & (F.col("_rank") == F.col("_first")))
        | (F.col("table_no").isNull() & ((F.col("kind") == "image") | (F.col("content") != "")))
    )
    return kept.select(
        "doc_id", "page",
        F.row_number().over(page.orderBy("_rank")).alias("seq"),
        F.when(F.col("table_no").isNotNull(), "table").otherwise(F.col("kind")).alias("kind"),
        "table_no",
        F.when(F.col("table_no").isNull(), F.col("content")).alias("content"),
    )


def _split_header(cells: Column) -> Column:
    """A header cell with a wide gap hands its second half to the next blank cell."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("resume"))

    def step(state: Column, item: Column) -> Column:
        cell, index = item.cell, item.index
        rest = F.slice(cells, index + 2, F.size(cells))
        blank = F.array_position(rest, F.lit("")).cast("int")
        halves = F.split(cell, r"\s{2,}", 2)
        resume = F.when(blank > 0, index + blank + 1).otherwise(index + 1)
        wide = F.struct(F.concat(state.out, halves).alias("out"), resume.alias("resume"))
        plain = F.struct(F.array_append(state.out, cell).alias("out"), (index + 1).alias("resume"))
        return (
            F.when(index < state.resume, state)
            .when(F.contains(cell, F.lit("  ")), wide)
            .otherwise(plain)
        )

    indexed = F.transform(cells, lambda c, i: F.struct(c.alias("cell"), i.alias("index")))
    return F.aggregate(indexed, start, step, lambda s: s.out)


def tables_to_markdown(cells: DataFrame) -> DataFrame:
    """Render each extracted table (doc_id, table_no, row_no, col_no, cell) as text."""
    rows = cells.groupBy("doc_id", "table_no", "row_no").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("col_no", "cell"))),
            lambda c: strip(F.coalesce(c.cell, F.lit(""))),
        ).alias("_row")
    )
    filled = lambda row: F.exists(row, lambda c: c != "")
    grids = rows.filter(filled(F.col("_row"))).groupBy("doc_id", "table_no").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("row_no", "_row"))), lambda r: r._row).alias("_grid")
    )
    empty_tables = cells.select("doc_id", "table_no").distinct()
    header = _split_header(F.get(F.col("_grid"), F.lit(0)))
    squeeze = lambda row: F.transform(row, lambda c: F.regexp_replace(c, r"\s+", ""))
    width = F.size("_header")
    fit = lambda row: F.slice(F.concat(row, F.array_repeat(F.lit(""), width)), F.lit(1), width)
    body = F.transform(F.slice(F.col("_grid"), 2, F.size("_grid")), fit)
    columns = F.filter(
        F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.when(
            F.exists(F.col("_cells"), lambda r: F.get(r, i) != ""), i)),
        lambda i: i.isNotNull(),
    )
    lines = F.transform(
        F.filter(F.col("_cells"), filled),
        lambda r: F.concat(
            F.lit("| "),
            F.array_join(F.transform(F.col("_columns"), lambda i: F.get(r, i)), " | "),
            F.lit(" |\n"),
        ),
    )
    rendered = (
        grids.withColumn("_header", header)
        .withColumn("_cells", F.transform(F.concat(F.array("_header"), body), squeeze))
        .withColumn("_columns", columns)
        .select("doc_id", "table_no",
                F.concat(F.lit("<table>\n"), F.array_join(lines, ""), F.lit("</table>")).alias("markdown"))
    )
    return empty_tables.join(rendered, ["doc_id", "table_no"], "left").withColumn(
        "markdown", F.coalesce("markdown", F.lit("<table></table>")))
