"""Blocks of sheets: runs of rows with values, as grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridscribe.functions.display import bool_text, number_text, timestamp_text

SHEET = ["doc_id", "sheet_idx"]


def shown_cells(cells: DataFrame) -> DataFrame:
    """SHEET_CELLS with `text`: the value as the sheet shows it; blank ones are left out."""
    text = F.coalesce("value_str", bool_text(F.col("value_bool")), timestamp_text(F.col("value_ts")), number_text(F.col("value_num"), F.col("number_format")))
    return cells.withColumn("text", text).where(F.trim("text") != "")


def covered(merges: DataFrame) -> DataFrame:
    """doc_id, sheet_idx, row, col: places that a merge swallows, all of it but its first."""
    rows = merges.withColumn("row", F.explode(F.sequence("min_row", "max_row"))).withColumn("col", F.explode(F.sequence("min_col", "max_col")))
    return rows.where((F.col("row") != F.col("min_row")) | (F.col("col") != F.col("min_col"))).select(*SHEET, "row", "col")


def visible_cells(cells: DataFrame, merges: DataFrame) -> DataFrame:
    return shown_cells(cells).join(covered(merges), [*SHEET, "row", "col"], "left_anti")


def sheet_blocks(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """doc_id, sheet_idx, block, first_row, last_row, first_col, last_col: rows in a row that have a value, or a filled merge over them."""
    seen = visible_cells(cells, merges)
    anchors = seen.select(*SHEET, F.col("row").alias("min_row"), F.col("col").alias("min_col"))
    wide = merges.join(anchors, [*SHEET, "min_row", "min_col"], "left_semi")
    reach = wide.select(*SHEET, F.explode(F.sequence("min_row", "max_row")).alias("row"), F.col("min_col").alias("low"), F.col("max_col").alias("high"))
    rows = seen.select(*SHEET, "row", F.col("col").alias("low"), F.col("col").alias("high")).unionByName(reach)
    per_row = rows.groupBy(*SHEET, "row").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    island = F.col("row") - F.row_number().over(Window.partitionBy(*SHEET).orderBy("row"))
    found = per_row.withColumn("__i", island).groupBy(*SHEET, "__i").agg(F.min("row").alias("first_row"), F.max("row").alias("last_row"), F.min("low").alias("first_col"), F.max("high").alias("last_col"))
    return found.withColumn("block", F.row_number().over(Window.partitionBy(*SHEET).orderBy("first_row"))).drop("__i")


def block_cells(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """CELLS of every block; a merge spans, cut to its block; line feeds in a value part its items."""
    blocks = sheet_blocks(cells, merges)
    spans = merges.select(*SHEET, F.col("min_row").alias("row"), F.col("min_col").alias("col"), "max_row", "max_col")
    met = visible_cells(cells, merges).join(spans, [*SHEET, "row", "col"], "left").join(blocks, SHEET).where(F.col("row").between(F.col("first_row"), F.col("last_row")))
    row, col = F.col("row") - F.col("first_row"), F.col("col") - F.col("first_col")
    row_span = F.least(F.coalesce("max_row", "row"), F.col("last_row")) - F.col("row") + 1
    col_span = F.least(F.coalesce("max_col", "col"), F.col("last_col")) - F.col("col") + 1
    texts = F.filter(F.transform(F.split("text", r"\r?\n"), lambda t: F.trim(t)), lambda t: t != "")
    x0, top = col * 120.0, row * 52.0
    line = lambda t, k: F.struct(t.alias("text"), x0.alias("x0"), (x0 + 1).alias("x1"), (top + 10.0 * k).alias("top"), (top + 10.0 * (k + 1)).alias("bottom"))
    return met.select(
        "doc_id",
        F.format_string("%04d/%04d", "sheet_idx", "block").alias("table_id"),
        row.alias("row"), col.alias("col"), row_span.cast("int").alias("row_span"), col_span.cast("int").alias("col_span"),
        x0.alias("x0"), top.alias("top"), (x0 + col_span * 120.0 - 12).alias("x1"), (top + row_span * 52.0 - 12).alias("bottom"),
        F.transform(texts, line).alias("lines"),
        F.transform(texts, lambda t: F.struct(F.lit(0).alias("level"), t.alias("text"), F.lit("").alias("marker"))).alias("items"),
    )


def is_table(grids: DataFrame) -> DataFrame:
    """`grids` (n_rows, n_cols) with `is_table`: two rows and two columns at least."""
    return grids.withColumn("is_table", (F.col("n_rows") >= 2) & (F.col("n_cols") >= 2))


def title_rows(blocks: DataFrame, titles: DataFrame) -> DataFrame:
    """doc_id, table_id, rows: leading rows of each block that print titles (doc_id, sheet_idx, first, last) declare as headers, if they begin where the block begins; else 0."""
    met = blocks.join(titles, SHEET, "left")
    rows = F.when(F.col("first") == F.col("first_row"), F.least("last", "last_row") - F.col("first") + 1)
    named = met.select("doc_id", F.format_string("%04d/%04d", "sheet_idx", "block").alias("table_id"), F.greatest(F.coalesce(rows, F.lit(0)), F.lit(0)).alias("rows"))
    return named.groupBy("doc_id", "table_id").agg(F.max("rows").cast("int").alias("rows"))
