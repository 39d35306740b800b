"""Lines into a rectangle: wrapping by measured width, the largest size that fits, room below a table, pages that spill over."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from gridscribe.groups import SEND, arrow_schema, by_group

# Line height for a size, room at the bottom, the sizes that are tried, the margins.
LEADING, SAFETY, BASE_SIZE, LEAST_SIZE, SIZE_STEP, STEPS = 1.32, 6.0, 9.5, 6.5, 0.5, 9
TOP_MARGIN, BOTTOM_MARGIN = 56.0, 48.0
PLACED = ArrayType(StructType([StructField("text", StringType()), StructField("source", IntegerType())]))


def wrap(lines: list[str], width: float, size: float = 1.0, widths: dict[str, float] | None = None) -> list[tuple[str, int]]:
    """Lines no wider than `width`, each with the index of the line it is from; a word that is too wide is cut.

    `widths` has a character's width at size 1; 1 if it is not there. Continued lines hang under the text after the marker.
    """
    measure = (lambda s: size * sum(widths.get(c, 1.0) for c in s)) if widths else (lambda s: size * len(s))
    out: list[tuple[str, int]] = []
    for source, line in enumerate(lines):
        inner = line.lstrip(" ")
        lead = " " * (len(line) - len(inner))
        hang = lead + "  " * (inner[:2] in ("- ", "+ ", "* "))
        lead, hang = (x if measure(x) + size <= width else "" for x in (lead, hang))  # no indent leaves less than a character
        current = lead
        fresh = True  # nothing but the indent stands on the current line
        for word in inner.split(" "):
            if not fresh and measure(f"{current} {word}") <= width:
                current = f"{current} {word}"
                continue
            if not fresh:
                out.append((current, source))
                current = hang
            room = max(width - measure(current), size)
            while measure(word) > room and len(word) > 1:
                ends = list(accumulate(measure(c) for c in word))
                cut = max(1, bisect_right(ends, room))
                out.append((current + word[:cut], source))
                word, current = word[cut:], hang
                room = max(width - measure(current), size)
            current, fresh = current + word, False
        out.append((current.rstrip() if inner else "", source))
    return out


def wrapped(lines: Column, width: Column) -> Column:
    """array<struct<text, source>> of array<string> lines; characters are one unit wide."""

    def run(values: pa.Array, widths: pa.Array) -> pa.Array:
        # Text by text into Arrow: a batch has as many texts as it has rows, and strings of Python are several times as large.
        parts = [pa.nulls(1, _placed([]).type) if v is None else _placed([wrap(v, w)]) for v, w in zip(_scalars(values), _scalars(widths), strict=True)]
        return pa.concat_arrays(parts) if parts else _placed([])

    return F.arrow_udf(run, PLACED)(lines, width)


def _scalars(values: pa.Array):
    return (v.as_py() for v in values)


def _placed(texts: list[list[tuple[str, int]]]) -> pa.Array:
    lines = [x for text in texts for x in text]
    flat = pa.StructArray.from_arrays([pa.array([t for t, _ in lines], pa.string()), pa.array([s for _, s in lines], pa.int32())], ["text", "source"])
    ends = [0, *accumulate(map(len, texts))]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)


def fit_plan(lines_at: DataFrame) -> DataFrame:
    """box_id, size, shown: the largest size at which a box's lines fit its height, else the smallest and the lines it holds.

    `lines_at` has box_id, height, size and n_lines: the number of lines that wrapping gives at each size.
    """
    fits = F.col("n_lines") * F.col("size") * LEADING <= F.col("height")
    best = F.max(F.when(fits, F.struct("size", F.col("n_lines").alias("shown"))))
    holds = F.floor(F.col("height") / (F.col("size") * LEADING)).cast("long")
    least = F.min(F.struct("size", holds.alias("shown")))
    return lines_at.groupBy("box_id").agg(F.coalesce(best, least).alias("plan")).select("box_id", "plan.size", "plan.shown")


def candidate_sizes(base: float = BASE_SIZE) -> list[float]:
    return [s for k in range(STEPS) if (s := base - SIZE_STEP * k) >= LEAST_SIZE]


def free_bottom(tables: DataFrame, obstacles: DataFrame, pages: DataFrame) -> DataFrame:
    """`tables` with `free_bottom`: the lowest place a table's lines may reach: above the margin, and clear of what stands below it in its width."""
    first = _first_below(tables, obstacles).groupBy("doc_id", "page", "table_id").agg(F.min("otop").alias("__first"))
    floor = F.least(F.col("height") - BOTTOM_MARGIN, F.coalesce(F.col("__first") - SAFETY, F.lit(float("inf"))))
    return tables.join(first, ["doc_id", "page", "table_id"]).join(pages.select("doc_id", "page", "height"), ["doc_id", "page"]).withColumn("free_bottom", F.greatest(F.col("bottom"), floor)).drop("__first", "height")


def _first_below(tables: DataFrame, obstacles: DataFrame) -> DataFrame:
    """doc_id, page, table_id, otop: the top of the first obstacle below each table in its width, or null.

    One stream of a page's obstacles and, behind them, its tables; each table looks down from its bottom until something stands there.
    """
    keys, sides = ["doc_id", "page"], [F.col(c).cast("double").alias(c) for c in ("x0", "x1")]
    none = F.lit(None).cast(tables.schema["table_id"].dataType).alias("table_id")
    both = obstacles.select(*keys, F.lit(0).alias("kind"), none, *sides, F.col("top").cast("double").alias("at")).where("at is not null").distinct()
    both = both.unionAll(tables.select(*keys, F.lit(1).alias("kind"), "table_id", *sides, F.col("bottom").cast("double").alias("at")))
    kind = StructType([*(both.schema[k] for k in (*keys, "table_id")), StructField("otop", DoubleType())])
    schema = arrow_schema(kind)

    def look(x0: np.ndarray, x1: np.ndarray, top: np.ndarray, boxes: np.ndarray, step: int = 16) -> np.ndarray:
        found = np.full(len(boxes), np.nan)
        at, open_ = np.searchsorted(top, boxes[:, 2]), np.arange(len(boxes))
        while len(open_ := open_[at[open_] < len(top)]):
            for part in np.array_split(open_, max(1, len(open_) * step // 2_000_000)):
                seen = np.minimum(at[part, None] + np.arange(step), len(top) - 1)
                blocks = (x0[seen] < boxes[part, 1, None]) & (x1[seen] > boxes[part, 0, None])
                hit = blocks.any(axis=1)
                found[part[hit]] = top[seen[hit, np.argmax(blocks[hit], axis=1)]]
            at[open_] += step
            open_ = open_[np.isnan(found[open_])]
            step = min(2 * step, 1024)
        return found

    def fold(rows: pa.Table, cuts: list[int]):
        kinds = rows.column("kind").to_numpy()
        x0, x1, at = (rows.column(c).to_numpy() for c in ("x0", "x1", "at"))
        for a, b in zip(cuts, cuts[1:], strict=False):
            m = a + int(np.searchsorted(kinds[a:b], 1))
            if m == b:
                continue
            boxes, whose = np.unique(np.column_stack([x0[m:b], x1[m:b], at[m:b]]), axis=0, return_inverse=True)
            first = look(x0[a:m], x1[a:m], at[a:m], boxes)[whose.ravel()]
            mine = rows.slice(m, b - m).select([*keys, "table_id"])
            yield from pa.Table.from_arrays([*(c.cast(f.type) for c, f in zip(mine.columns, schema, strict=False)), pa.chunked_array([pa.array(first, from_pandas=True)])], schema=schema).to_batches(max_chunksize=SEND)

    return by_group(both, keys, ["kind", "at"], fold, kind)


def whole_lines(placed: DataFrame, shown: str = "shown") -> DataFrame:
    """box_id, kept: of the lines that fit, those whose logical line fits whole; if the first does not, all that fit.

    `placed` has box_id, pos (from 0), source and the number that fit.
    """
    ends = Window.partitionBy("box_id", "source")
    whole = placed.withColumn("__last", F.max("pos").over(ends))
    kept = F.max(F.when(F.col("__last") < F.col(shown), F.col("pos") + 1))
    return whole.groupBy("box_id").agg(F.coalesce(kept, F.first(shown)).cast("long").alias("kept"))


def spill_pages(lines: DataFrame, order: list[str], height: float, size: float = BASE_SIZE) -> DataFrame:
    """`lines` (box_id, ...) with `spill_page` from 0: which added page a line that did not fit stands on."""
    per_page = max(1, int((height - TOP_MARGIN - BOTTOM_MARGIN) // (size * LEADING)))
    k = F.row_number().over(Window.partitionBy("box_id").orderBy(*order)) - 1
    return lines.withColumn("spill_page", F.floor(k / per_page).cast("int"))


def typography(chars: DataFrame, least: float = LEAST_SIZE, most: float = 12.0) -> DataFrame:
    """box_id, font, size, serif: the most frequent font and size of a box's characters (box_id, pos, font, size), the first seen of equals; sizes are kept in bounds."""
    keys = lambda c: chars.groupBy("box_id", c).agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    top = lambda c: keys(c).groupBy("box_id").agg(F.max_by(c, F.struct("n", -F.col("first"))).alias(c))
    met = top("font").join(top("size"), "box_id").withColumn("size", F.greatest(F.lit(least), F.least(F.lit(most), F.col("size"))))
    return met.withColumn("serif", ~F.lower("font").rlike("arial|helvetica|calibri|sans"))


def drawable(text: Column, glyphs: str) -> Column:
    """Characters without a glyph are drawn as a point."""
    escaped = "".join(f"\\x{{{ord(c):X}}}" for c in glyphs)
    return F.regexp_replace(text, f"[^{escaped}]", ".")
