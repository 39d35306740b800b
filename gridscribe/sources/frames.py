"""Any DataFrame as grids: its columns are headers, its rows are records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridscribe.functions.display import display
from gridscribe.functions.text import INDENT, SEPARATOR, label


def as_lines(df: DataFrame, columns: list[str], headers: list[str] | None = None, formats: dict[str, str] | None = None):
    """A row as `- header: value  |  header: value`, without Python: the whole flattener for a table of one header row and simple cells."""
    names, formats = headers or columns, formats or {}
    parts = [label(F.lit(h), display(F.col(c), df.schema[c].dataType, formats.get(c, "General"))) for c, h in zip(columns, names, strict=True)]
    said = F.filter(F.array(*parts), lambda p: p != "")
    return F.concat(F.lit("- "), F.array_join(said, SEPARATOR))


def as_cells(df: DataFrame, key: str, order: list[str], columns: list[str], headers: list[str] | None = None) -> DataFrame:
    """CELLS of one table for each `key`: a header row, then the rows in `order`."""
    names = headers or columns
    row = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    values = F.array(*(display(F.col(c), df.schema[c].dataType) for c in columns))
    numbered = df.select(F.col(key).cast("string").alias("table_id"), row.alias("row"), values.alias("values"))  # rows first, then their cells
    body = numbered.select("table_id", "row", F.posexplode("values").alias("col", "text"))
    head = df.select(F.col(key).cast("string").alias("table_id")).distinct().select("table_id", F.lit(0).alias("row"), F.posexplode(F.array(*map(F.lit, names))).alias("col", "text"))
    both = head.unionByName(body)
    x0, top = F.col("col") * 120.0, F.col("row") * 52.0
    line = F.struct("text", x0.alias("x0"), (x0 + 1).alias("x1"), top.alias("top"), (top + 10.0).alias("bottom"))
    item = F.struct(F.lit(0).alias("level"), "text", F.lit("").alias("marker"))
    filled = F.col("text") != ""
    none = lambda kind: F.array().cast(kind)
    return both.select(
        F.lit("frame").alias("doc_id"), "table_id", "row", "col", F.lit(1).alias("row_span"), F.lit(1).alias("col_span"),
        x0.alias("x0"), top.alias("top"), (x0 + 108.0).alias("x1"), (top + 40.0).alias("bottom"),
        F.when(filled, F.array(line)).otherwise(none("array<struct<text: string, x0: double, x1: double, top: double, bottom: double>>")).alias("lines"),
        F.when(filled, F.array(item)).otherwise(none("array<struct<level: int, text: string, marker: string>>")).alias("items"),
    )


def placed_cells(cells: DataFrame, gap: float = 12.0) -> DataFrame:
    """CELLS of `cells` (table_id, row, col, text and, where they span, row_span and col_span): a line of a cell for each line of its text.

    Cells stand `gap` apart; with none, their boxes touch and a line that fills its cell reaches its right edge.
    """
    span = lambda name: F.col(name).cast("int") if name in cells.columns else F.lit(1)
    x0, top = F.col("col") * 120.0, F.col("row") * 52.0
    x1, bottom = x0 + F.col("col_span") * 120.0 - gap, top + F.col("row_span") * 52.0 - gap
    texts = F.filter(F.split(F.col("text"), "\n"), lambda t: F.trim(t) != "")
    end = (x0 + 1) if gap else x1
    line = lambda t, k: F.struct(t.alias("text"), x0.alias("x0"), end.alias("x1"), (top + 10.0 * k).alias("top"), (top + 10.0 * (k + 1)).alias("bottom"))
    sized = cells.select("table_id", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), span("row_span").alias("row_span"), span("col_span").alias("col_span"), "text")
    return sized.select(
        F.lit("frame").alias("doc_id"), F.col("table_id").cast("string").alias("table_id"), "row", "col", "row_span", "col_span", x0.alias("x0"), top.alias("top"), x1.alias("x1"), bottom.alias("bottom"),
        F.transform(texts, line).alias("lines"), F.lit(None).cast("array<struct<level: int, text: string, marker: string>>").alias("items"),
    )


__all__ = ["INDENT", "as_cells", "as_lines", "placed_cells"]
