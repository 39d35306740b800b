"""Grids to self-describing lines: one Arrow group for each table.

A grid is held as two occupancy matrices over its slots: which filled cell covers a slot, and where cells of any kind begin
and end. Questions such as "does a column split at this boundary" are then array comparisons.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field, replace
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridscribe.functions import lines as L
from gridscribe.functions.text import LABEL_CHARS, split_items
from gridscribe.groups import arrow_schema, by_group, sent
from gridscribe.schema import FLAT

# Tolerances of the geometry.
LEVEL_STEP, TOUCH, HEADER_CHARS, BAND_ROWS = 6.0, 3.0, 150, 3
CELL_NAMES = "doc_id table_id row col row_span col_span x0 top x1 bottom lines items".split()


@dataclass(slots=True)
class Line:
    text: str
    x0: float = 0.0
    x1: float = 0.0
    top: float = 0.0
    bottom: float = 0.0


@dataclass(frozen=True, slots=True)
class Item:
    level: int
    text: str
    marker: str = ""


@dataclass(eq=False, slots=True)
class Cell:
    row: int
    col: int
    row_span: int = 1
    col_span: int = 1
    box: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)
    lines: tuple[Line, ...] = ()
    items: tuple[Item, ...] | None = None  # None: to be inferred from the lines; empty: known to be none
    text: str = field(init=False)
    filled: bool = field(init=False)

    def __post_init__(self):
        self.text = self.lines[0].text if len(self.lines) == 1 else "\n".join(x.text for x in self.lines)
        self.filled = bool(self.text.strip())

    @property
    def last_row(self) -> int:
        return self.row + self.row_span - 1

    @property
    def columns(self) -> range:
        return range(self.col, self.col + max(1, self.col_span))


@dataclass
class Grid:
    n_rows: int
    n_cols: int
    cells: list[Cell]
    at: dict[tuple[int, int], Cell] = field(init=False)
    begins: np.ndarray = field(init=False)  # (rows + 1, cols): a filled cell begins in this slot
    ends: np.ndarray = field(init=False)  # a filled cell's last row is this slot

    def __post_init__(self):
        self.cells = sorted(self.cells, key=lambda c: (c.row, c.col))
        self.at = {(c.row, c.col): c for c in self.cells}
        self.begins, self.ends = (np.zeros((self.n_rows + 1, self.n_cols), bool) for _ in range(2))
        for c in self.cells:
            if c.filled:
                span = slice(c.col, min(c.col + c.col_span, self.n_cols))
                self.begins[min(c.row, self.n_rows), span] = True
                self.ends[min(c.last_row, self.n_rows), span] = True

    def cuts(self, first: int) -> list[int]:
        """Rows after the first at which a column splits."""
        if self.n_rows - first < 2:
            return []
        return (np.flatnonzero((self.ends[first : self.n_rows - 1] & self.begins[first + 1 : self.n_rows]).any(axis=1)) + first + 1).tolist()

    def splits(self, boundary: int) -> np.ndarray:
        """Columns in which one filled cell ends above the boundary and another begins below it."""
        return self.ends[boundary] & self.begins[boundary + 1]

    def row(self, r: int) -> list[Cell]:
        return [self.at[r, c] for c in range(self.n_cols) if (r, c) in self.at]


# --- items of a cell -------------------------------------------------------------------------------------


def cell_items(cell: Cell) -> list[Item]:
    """The cell's paragraphs and list items; levels come from where bullets stand, not from their glyphs."""
    found = list(cell.items) if cell.items is not None else _read_items([x for x in cell.lines if x.text.strip()])
    return [Item(x.level, part, x.marker if k == 0 else "") for x in found for k, part in enumerate(split_items(x.text))]


def _read_items(rows: list[Line]) -> list[Item]:
    if not rows:
        return []
    if len(rows) == 1:
        marker, first = L.unbulleted(rows[0].text)
        return [Item(0, text, marker)] if (text := L.joined([first])) else []
    stops: list[float] = []
    for x in sorted({float(round(r.x0)) for r in rows if L.is_bullet(r.text)}):
        if not stops or x - stops[-1] > LEVEL_STEP:
            stops.append(x)
    gaps = sorted(b.top - a.bottom for a, b in zip(rows, rows[1:], strict=False) if b.top >= a.bottom)
    wide = (gaps[len(gaps) // 2] if gaps else 0.0) * 1.25 + 1.0
    left, right = min(r.x0 for r in rows), max(r.x1 for r in rows)
    full = right - max(6.0, 0.06 * (right - left))
    # A new item begins at a bullet, and after a wide gap below a line that was not full.
    opens = [k == 0 or L.is_bullet(r.text) or (r.top - rows[k - 1].bottom > wide and rows[k - 1].x1 < full) for k, r in enumerate(rows)]
    starts = [k for k, o in enumerate(opens) if o]
    out, level = [], 0
    for a, b in zip(starts, [*starts[1:], len(rows)], strict=True):
        marker, first = L.unbulleted(rows[a].text) if L.is_bullet(rows[a].text) else ("", rows[a].text)
        if marker:
            level = min(range(len(stops)), key=lambda k, x=rows[a].x0: abs(stops[k] - x))
        text = L.joined([first, *(r.text for r in rows[a + 1 : b])])
        if text:
            out.append(Item(level, text, marker))
    return out


def simple(items: list[Item]) -> bool:
    return len(items) < 2 and all(x.level == 0 for x in items)


# --- structure ----------------------------------------------------------------------------------------------


def fuse_slices(grid: Grid) -> Grid:
    """Cells that stray rules cut out of one paragraph, put together again."""
    edges_of: dict[int, set[int]] = {}  # boundary: columns in which any cell, filled or not, ends above or begins below; made when cells touch

    def one_paragraph(upper: Cell, lower: Cell) -> bool:
        if abs(upper.box[3] - lower.box[1]) > TOUCH:
            return False
        others = np.ones(grid.n_cols, bool)
        others[list(x for x in upper.columns if x < grid.n_cols)] = False
        if (grid.splits(upper.last_row) & others).any():
            return False
        width = upper.box[2] - upper.box[0]
        if upper.lines and width > 0 and upper.lines[-1].x1 >= upper.box[2] - max(10.0, 0.08 * width):
            return True
        if not edges_of:
            for c in grid.cells:
                for boundary in (c.last_row, c.row - 1):
                    edges_of.setdefault(boundary, set()).add(c.col)
        return edges_of[upper.last_row] <= set(upper.columns)

    above: dict[tuple[int, int], Cell] = {}  # the last cell of each column and width
    runs: dict[Cell, list[Cell]] = {}  # by its last cell, a run of more than one
    for c in grid.cells:
        place = c.col, c.col_span
        upper = above.get(place)
        if upper is not None and one_paragraph(upper, c):
            runs[c] = runs.pop(upper, None) or [upper]
            runs[c].append(c)
        above[place] = c
    if not runs:
        return grid
    fused = {c for run in runs.values() for c in run}
    return Grid(grid.n_rows, grid.n_cols, [c for c in grid.cells if c not in fused] + [_fused(run) for run in runs.values()])


def _fused(run: list[Cell]) -> Cell:
    boxes = np.array([c.box for c in run])
    known = [c.items for c in run if c.items is not None]
    return replace(
        run[0],
        row_span=sum(c.row_span for c in run),
        box=(*boxes[:, :2].min(axis=0), *boxes[:, 2:].max(axis=0)),
        lines=tuple(x for c in run for x in c.lines),
        items=tuple(x for items in known for x in items) if known else None,
    )


def header_rows(grid: Grid) -> int:
    """Rows of the header band that geometry shows; 0 for none.

    The first row is one if no other has more filled cells and all of it can be names. The band goes on to the first row with a
    cell that is no name, or that stands under none.
    """
    if min(grid.n_rows, grid.n_cols) < 2:
        return 0
    filled = [c for c in grid.cells if c.filled]
    in_row = np.bincount([c.row for c in filled], minlength=grid.n_rows)
    top = [c for c in filled if c.row == 0]
    numeric = lambda c: L.NUMERIC.fullmatch(c.text.strip()) is not None
    enough = in_row[0] >= max(in_row[1:].max(), 2 if grid.n_cols >= 3 else 1)
    names = not any(L.is_bullet(c.text) or len(c.text) > HEADER_CHARS for c in top) and not all(map(numeric, top))
    if not (enough and names and all(_may_head(grid, c) for c in grid.row(0))):
        return 0
    open_below = {c.col for c in top if c.row_span == 1}
    most = min(BAND_ROWS, grid.n_rows - 1, max(c.row_span for c in grid.row(0)))
    return min(most, *(c.row for c in filled if 0 < c.row < most and (numeric(c) or c.col not in open_below or L.is_bullet(c.text))), most)


def _may_head(grid: Grid, cell: Cell) -> bool:
    """A header does not merge columns that a row below keeps apart."""
    if cell.col_span < 2:
        return True
    return all(sum((r, c) in grid.at and grid.at[r, c].filled for c in cell.columns) < 2 for r in range(cell.last_row + 1, grid.n_rows))


def logical_rows(grid: Grid, first: int) -> list[list[Cell]]:
    """Rows as a reader sees them; a cell that spans several stands in each."""
    cuts = [first, *grid.cuts(first), grid.n_rows]
    out: list[list[Cell]] = [[] for _ in cuts[1:]]
    for c in grid.cells:
        if c.filled and c.row >= first:
            for k in range(bisect_right(cuts, c.row) - 1, min(bisect_right(cuts, c.last_row), len(out))):
                out[k].append(c)
    for row in out:
        row.sort(key=lambda c: (c.col, c.row))
    return [row for row in out if row]


def labels_rows(rows: list[list[Cell]], n_cols: int) -> bool:
    """Whether column 0 holds a short name for each row."""
    if n_cols < 2 or len(rows) < 2:
        return False
    names, body = [], []
    for row in rows:
        name = L.squeeze(row[0].text)
        if row[0].col or len(row) < 2 or not name or len(name) > LABEL_CHARS or L.is_bullet(name) or not any(map(str.isalpha, name)):
            return False
        names.append(name.lower())
        body += [len(c.text) for c in row[1:]]
    return len(set(names)) == len(names) and sum(map(len, names)) / len(names) < sum(body) / len(body)


def structure_of(grid: Grid) -> tuple[int, bool]:
    band = header_rows(grid)
    return band, labels_rows(logical_rows(grid, band), grid.n_cols)


def resolve_headers(grid: Grid, band: int) -> tuple[list[str], int]:
    band = max(0, min(band, grid.n_rows - 1))
    out = [""] * grid.n_cols
    for c in range(grid.n_cols):
        parts = [x.text for r in range(band) if (r, c) in grid.at and grid.at[r, c].filled for x in grid.at[r, c].lines]
        name = L.joined(parts)
        out[c] = "" if L.FAKE_HEADER.match(name.strip()) else name
    for cell in grid.row(0) if band else ():
        for c in cell.columns:
            if c < grid.n_cols and not out[c]:
                out[c] = out[cell.col]
    return out, band


def carried_headers(found: list[str], band: int, before: list[str], n_cols: int) -> tuple[list[str], int]:
    """Headers of a table that goes on from the page before: its own if they repeat the old ones, else the old ones, and row 0 is data."""
    plain = lambda names: [x for x in (L.squeeze(n).strip(" :").lower() for n in names) if x]
    own, old = plain(found), set(plain(before))
    if band and own and old and 2 * sum(x in old for x in own) >= len(own):
        return found, band
    return (list(before) + [""] * n_cols)[:n_cols], 0


def header_over(cell: Cell, headers: list[str]) -> str:
    return next((headers[c] for c in cell.columns if c < len(headers) and not L.says_nothing(headers[c])), "")


# --- lines -----------------------------------------------------------------------------------------------------


def _nested(depth: int, item: Item) -> str:
    marker = "" if not item.marker else item.marker if item.marker in "-+*" else "+" if item.marker == "o" else "-"
    own = L.LINE_INDEX.match(item.text)
    return L.INDENT * depth + (f"{marker} " if marker else "" if own else "- ") + item.text


def render_row(row: list[Cell], headers: list[str], named: bool) -> list[str]:
    parsed = [(c, items) for c in row if (items := cell_items(c))]
    name = ""
    if named and parsed and parsed[0][0].col == 0 and simple(parsed[0][1]):
        name = parsed[0][1][0].text.rstrip(":").strip()
        parsed = parsed[1:]
        if not parsed:
            return [L.dashed(name)]
    cut = next((k for k, (_, items) in enumerate(parsed) if not simple(items)), len(parsed))
    head = [p for c, items in parsed[:cut] if (p := L.labelled(header_over(c, headers), items[0].text))]
    if name and head:
        head[0] = f"{name}: {head[0]}"
    rest = parsed[cut:]
    titles = [header_over(c, headers).rstrip(":").strip() for c, _ in rest]
    if head and any(titles):
        head.append(L.SEPARATOR.join(f"{t}:" for t in dict.fromkeys(titles) if t))
    out = [L.dashed(L.SEPARATOR.join(head))] if head else [L.dashed(f"{name}:")] if name and rest else []
    anchored = bool(head or name)
    for (_, items), title in zip(rest, titles, strict=True):
        if not anchored and title:
            out.append(L.dashed(f"{title}:"))
        depth = int(anchored or bool(title))
        out += [_nested(depth + x.level, x) for x in items]
    return out


def render_turned(rows: list[list[Cell]], columns: list[int]) -> list[str]:
    """A table whose records are columns: one line for each, with the name of every row."""
    out = []
    for column in columns:
        parts, below = [], []
        for row in rows:
            own = cell_items(row[0]) if row[0].col == 0 else []
            name = own[0].text.rstrip(":").strip() if own else ""
            cell = next((c for c in row if c.col > 0 and column in c.columns), None)
            items = cell_items(cell) if cell else []
            if items and simple(items):
                parts.append(L.labelled(name, items[0].text))
            elif items:
                parts.append(f"{name}:" if name else "")
                below += [_nested(1 + x.level, x) for x in items]
        if any(parts):
            out.append(L.dashed(L.SEPARATOR.join(filter(None, parts))))
        out += below
    return out


def with_missing(grid: Grid, out: list[str], first: int) -> list[str]:
    """Lines and, at their end, items with words of the grid that no line has."""
    expected, in_headers, made = Counter(), Counter(), Counter()
    for c in grid.cells:
        if c.row >= first:
            expected.update(L.tokens(c.text))
        elif not L.says_nothing(name := L.joined([x.text for x in c.lines])):
            in_headers.update(L.tokens(name))
    for line in out:
        made.update(L.tokens(line))
    fewer = (expected | in_headers) - made
    inside = L.within(fewer, (t for line in out for t in L.tokens(line))) if fewer else ()
    lost = Counter({t: n for t, n in fewer.items() if t not in inside})
    if not lost:
        return out
    out = list(out)
    for cell in grid.cells:
        for item in cell_items(cell) if lost and cell.filled else ():
            found = [t for t in L.tokens(item.text) if t in lost]
            if found:
                out.append(L.dashed(item.text))
            for token in found:  # not `-=` of counters, which copies all that is lost
                if token in lost:
                    lost[token] -= 1
                    if not lost[token]:
                        del lost[token]
    return out


def flatten_grid(grid: Grid, before: list[str] | None = None, structure: tuple[int, bool] | None = None) -> tuple[list[str], list[str], tuple[int, bool]]:
    """Lines, headers for a continuation, and (header rows, label column)."""
    whole, grid = grid, fuse_slices(grid)
    band, named = structure = structure or structure_of(grid)
    headers, first = resolve_headers(grid, band)
    if before and any(h.strip() for h in before):
        headers, first = carried_headers(headers, first, before, grid.n_cols)
    named = named and not any(h.strip() for h in headers[1:])
    rows = logical_rows(grid, first)
    records = max((sorted({c.col for c in row if c.col}) for row in rows), key=len, default=[]) if named else []
    if len(records) > 1:
        out = render_turned(rows, records)
    else:
        out = [line for row in rows for line in render_row(row, headers, named)]
    if not out and any(h.strip() for h in headers):
        out = [L.dashed(L.SEPARATOR.join(h for h in headers if h.strip()))]
    return L.tidy(with_missing(whole, out, first)), headers, structure


# --- headers that the file states -------------------------------------------------------------------------------


def _names_columns(row: list[Cell]) -> bool:
    filled = [c for c in row if c.filled]
    return bool(filled) and all(len(L.squeeze(c.text)) <= LABEL_CHARS and not L.is_bullet(L.squeeze(c.text)) for c in filled) and not all(L.NUMERIC.fullmatch(c.text.strip()) for c in filled)


def stated_rows(grid: Grid, declared: int) -> int:
    """Header rows by what the file says: rows it repeats on each page, or a merged first row that names every column; 0 if it says nothing."""
    if min(grid.n_rows, grid.n_cols) < 2 or not _names_columns(grid.row(0)):
        return 0
    if declared:
        return min(declared, grid.n_rows - 1, BAND_ROWS)
    top = [c for c in grid.row(0) if c.filled]
    merged = {col for c in top if c.col_span > 1 for col in c.columns}
    if not merged or len({col for c in top for col in c.columns}) < grid.n_cols:
        return 0
    second = [c for c in grid.row(1) if c.filled] if grid.n_rows > 2 else []
    return 2 if len(second) > 1 and _names_columns(second) and {c.col for c in second} <= merged else 1


def stated_structure(grid: Grid, declared: int) -> tuple[Grid, tuple[int, bool] | None]:
    """The grid with its stated header rows as one row of labels, and its structure; unchanged where geometry sees as much."""
    band = stated_rows(grid, declared)
    if band <= header_rows(fuse_slices(grid)):
        return grid, None
    names = [[] for _ in range(grid.n_cols)]
    for cell in (c for r in range(band) for c in grid.row(r) if c.filled):
        for col in cell.columns:
            if col < grid.n_cols:
                names[col].append(L.joined([x.text for x in cell.lines]))
    width, gap = 120.0, 52.0
    heads = [Cell(0, col, 1, 1, (col * width, 0.0, (col + 1) * width - 12, 40.0), (Line(text, col * width, col * width + 1, 0.0, 10.0),), (Item(0, text),)) for col, parts in enumerate(names) if (text := " ".join(parts))]
    shift = band - 1
    rest = [replace(c, row=c.row - shift, box=(c.col * width, (c.row - shift) * gap, (c.col + c.col_span) * width - 12, (c.row - shift + c.row_span) * gap - 12)) for c in grid.cells if c.row >= band]
    made = Grid(grid.n_rows - shift, grid.n_cols, heads + rest)
    found, named = structure_of(made)
    return made, (found, named) if found else (1, labels_rows(logical_rows(made, 1), made.n_cols))


# --- DataFrames ---------------------------------------------------------------------------------------------------


def grid_of(cells: list[Cell]) -> Grid:
    return Grid(max(c.last_row for c in cells) + 1, max(c.col + c.col_span for c in cells), cells)


def _lists(column: pa.ChunkedArray, make, parts: list[tuple[str, object]]) -> list:
    """A list of structures for each row: `make` of its parts, with what stands for a missing one; None for null."""
    whole = column.combine_chunks()
    flat = whole.flatten()
    made = list(map(make, *([none if v is None else v for v in flat.field(name).to_pylist()] for name, none in parts))) if len(flat) else []
    sizes = [0 if n is None else n for n in pc.list_value_length(whole).to_pylist()]
    ends = [0, *accumulate(sizes)]
    rows = [tuple(made[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
    return rows if not whole.null_count else [row if ok else None for row, ok in zip(rows, whole.is_valid().to_pylist(), strict=True)]


def read_cells(rows: pa.Table) -> list[Cell]:
    """Rows of CELLS."""
    numbers = lambda names: [[v or 0 for v in rows.column(n).to_pylist()] for n in names]
    boxes = zip(*([float(v) for v in column] for column in numbers(("x0", "top", "x1", "bottom"))), strict=True)
    lines = _lists(rows.column("lines"), Line, [("text", ""), ("x0", 0.0), ("x1", 0.0), ("top", 0.0), ("bottom", 0.0)])
    items = _lists(rows.column("items"), Item, [("level", 0), ("text", ""), ("marker", "")])
    return [Cell(*place, box, own or (), stated) for *place, box, own, stated in zip(*numbers(("row", "col", "row_span", "col_span")), boxes, lines, items, strict=True)]


def flatten_tables(cells: DataFrame, inherited: DataFrame | None = None, declared: DataFrame | None = None) -> DataFrame:
    """FLAT rows for every table of CELLS, each table in one group.

    `inherited` (doc_id, table_id, headers) has the headers of the page before; `declared` (doc_id, table_id, rows) the
    header rows that a file states, and marks the tables of formats that could. n_rows and n_cols are those of the grid with stated header rows as one.
    """
    keys, schema = ["doc_id", "table_id"], arrow_schema(FLAT)
    rows = cells.select(*CELL_NAMES)
    rows = rows.withColumn("before", F.lit(None).cast("array<string>")) if inherited is None else rows.join(inherited.select(*keys, F.col("headers").alias("before")), keys, "left")
    rows = rows.withColumn("stated", F.lit(None).cast("int")) if declared is None else rows.join(declared.select(*keys, F.col("rows").cast("int").alias("stated")), keys, "left")

    def flatten(group: pa.Table, cuts: list[int]):
        made = read_cells(group)
        heads = [group.column(k).take(pa.array(cuts[:-1])).to_pylist() for k in (*keys, "before", "stated")]
        for a, b, doc, table, before, stated in zip(cuts, cuts[1:], *heads, strict=False):
            grid, structure = grid_of(made[a:b]), None
            if stated is not None:
                grid, structure = stated_structure(grid, stated)
            out, headers, (band, named) = flatten_grid(grid, before, structure)
            yield doc, table, out, headers, band, bool(named), grid.n_rows, grid.n_cols

    def run(group: pa.Table, cuts: list[int]):
        return sent(flatten(group, cuts), schema, lambda row: 1 + len(row[2]))

    return by_group(rows, keys, ["row", "col"], run, FLAT)
