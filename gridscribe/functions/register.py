"""The text operators as SQL functions, and the flattener as a table function."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from gridscribe.functions import lines as L
from gridscribe.functions import text as T
from gridscribe.session import ship_code


def _series(f, kind=None):
    return F.pandas_udf(lambda s: s.map(lambda v: f(v or "")), kind or StringType())


class FlattenTable:
    """Lines of `TABLE (...) PARTITION BY key ORDER BY position`: the first row is the header, its other columns are the cells."""

    def __init__(self):
        self.rows: list[list[str]] = []

    def eval(self, row):
        self.rows.append(["" if v is None else str(v) for v in row])

    def terminate(self):
        from gridscribe.operators.grid import Cell, Grid, Item, Line, flatten_grid

        if not self.rows:
            return
        cells = []
        for r, row in enumerate(self.rows):
            for c, text in enumerate(row):
                box = (c * 120.0, r * 52.0, c * 120.0 + 108, r * 52.0 + 40)
                cells.append(Cell(r, c, 1, 1, box, (Line(text, box[0], box[0] + 1, box[1], box[1] + 10),) if text else (), (Item(0, text),) if text else ()))
        for k, line in enumerate(flatten_grid(Grid(len(self.rows), len(self.rows[0]), cells))[0]):
            yield k, line


def register(spark: SparkSession) -> None:
    """tokenize_text, bare_text, row_name, split_items, flatten_table for SQL of this session."""
    from gridscribe.operators.outline import record_name

    ship_code(spark)
    spark.udf.register("tokenize_text", _series(L.tokens, ArrayType(StringType())))
    spark.udf.register("bare_text", _series(L.bare))
    spark.udf.register("row_name", _series(record_name))
    spark.udf.register("split_items", _series(T.split_items, ArrayType(StringType())))
    spark.udtf.register("flatten_table", F.udtf(FlattenTable, returnType="k int, line string"))

