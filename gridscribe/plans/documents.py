"""Whole documents: from files or positioned words to numbered lines and a report, one plan for each format."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridscribe.functions import text as T
from gridscribe.operators import geometry as G
from gridscribe.operators import outline, sheets, verify
from gridscribe.operators.grid import flatten_tables
from gridscribe.session import ship_code, stored
from gridscribe.sources import office

PATHS = "array<int>"


def _numbered(flat: DataFrame, plan: DataFrame, numbering: bool = True) -> DataFrame:
    """NUMBERED lines of FLAT tables placed by `plan` (doc_id, table_id, seq, section, path, title, continued); tables without lines take no number.

    The caption of a table that has its section's own number is the heading above it, and is not said again.
    """
    met = flat.join(plan, ["doc_id", "table_id"])
    if not numbering:
        return unnumbered(met)
    title = F.when(F.col("path") == F.col("section"), "").otherwise(F.col("title"))
    return outline.number_documents(met.select("doc_id", "table_id", "seq", "lines", "path", title.alias("title"), "headers", "continued"))


def unnumbered(flat: DataFrame) -> DataFrame:
    """NUMBERED rows of FLAT tables with seq, without numbers: each table's lines, under a line of its headers where no row says them.

    A document has a line of headers once, however many pages its table goes over.
    """
    said = flat.withColumn("head", T.unsaid_header_line(F.col("lines"), F.col("headers")))
    first = F.row_number().over(Window.partitionBy("doc_id", "head").orderBy("seq", "table_id")) == 1
    lines = F.concat(F.when((F.col("head") != "") & first, F.array("head")).otherwise(F.array().cast("array<string>")), F.col("lines"))
    return said.withColumn("lines", lines).select("doc_id", "table_id", F.posexplode("lines").alias("seq", "line"))


# --- word files ---------------------------------------------------------------------------------------------------


def word_outline(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables (doc_id, table_id, seq, section, title) and headings (doc_id, path) of word files.

    A number in a heading's text comes before the one that its list draws, and that before the rank of its style. The last
    paragraph that is not blank above a table names it.
    """
    ship_code(files.sparkSession)
    paragraphs = office.styled_paragraphs(files)
    listed = outline.list_numbers(paragraphs, office.list_levels(files))
    rank = F.coalesce("outline_lvl", F.regexp_extract("style_id", r"^Heading ?([1-9])$", 1).try_cast("int") - 1)
    blocks = F.filter(F.transform(F.split("text", "\n"), lambda x: T.one_line(x)), lambda x: x != "")
    seen = listed.where("story = 'document'").withColumns({"rank": rank, "blocks": blocks})
    first, last = F.get("blocks", F.lit(0)), F.try_element_at("blocks", F.lit(-1))
    typed = T.parse_heading(first)
    heading = typed.isNotNull() | F.col("rank").isNotNull() | F.col("list_path").isNotNull()
    said = F.when(F.size("blocks") > 0, T.table_title(last, heading))
    steps = seen.select("doc_id", "seq", "in_table", "table_seq", F.when(F.size("blocks") > 0, F.coalesce(typed, "list_path")).alias("path"), F.when(F.size("blocks") > 0, F.col("rank")).alias("rank"), said.alias("title"))

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        taken: dict[tuple, set[int]] = {}
        entered: dict[tuple, int] = {}
        section: tuple[int, ...] = ()
        title, done, out, heads = "", set(), [], []
        for p in group.sort_values("seq").itertuples():
            if p.in_table:
                if p.table_seq not in done:
                    done.add(p.table_seq)
                    out.append({"doc_id": p.doc_id, "table_id": f"document/{int(p.table_seq):04d}", "seq": int(p.seq), "section": list(section), "title": title, "path": None})
                    title = ""
                continue
            if p.path is not None:
                section = tuple(int(x) for x in p.path)
            elif pd.notna(p.rank):
                parent = (section + (1,) * int(p.rank))[: int(p.rank)]
                n = entered.get(parent, 0) + 1
                while n in taken.get(parent, ()):
                    n += 1
                section = (*parent, n)
            if p.path is not None or pd.notna(p.rank):
                for k, n in enumerate(section):
                    taken.setdefault(section[:k], set()).add(n)
                entered[section[:-1]] = section[-1]
                heads.append({"doc_id": p.doc_id, "table_id": None, "seq": int(p.seq), "section": None, "title": None, "path": list(section)})
            if isinstance(p.title, str):
                title = p.title
        return pd.DataFrame(out + heads, columns=["doc_id", "table_id", "seq", "section", "title", "path"])

    found = stored(steps.groupBy("doc_id").applyInPandas(walk, f"doc_id string, table_id string, seq int, section {PATHS}, title string, path {PATHS}"))
    return found.where("table_id is not null").drop("path"), found.where("path is not null").select("doc_id", "path")


def flatten_word_files(files: DataFrame, numbering: bool = True) -> DataFrame:
    """NUMBERED lines of the tables of word files (doc_id, content): body tables on the document's outline, those of other stories at its root."""
    flat = stored(flatten_tables(office.word_cells(files), declared=office.declared_headers(files)).where(F.size("lines") > 0))
    tables, heads = word_outline(files)
    body = flat.select("doc_id", "table_id").join(tables, ["doc_id", "table_id"], "left")
    placed = body.select("doc_id", "table_id", F.coalesce("seq", F.lit(1 << 30)).alias("seq"), F.coalesce("section", F.array().cast(PATHS)).alias("section"), F.coalesce("title", F.lit("")).alias("title"))
    by_story = [F.substring_index("table_id", "/", 1), F.substring_index("table_id", "/", -1).cast("int")]
    plan = outline.table_numbers(placed, heads, ["seq", *by_story]).withColumn("continued", F.lit(False))
    return _numbered(flat, plan, numbering)


# --- sheets ---------------------------------------------------------------------------------------------------------


def flatten_sheet_files(files: DataFrame, numbering: bool = True) -> DataFrame:
    """NUMBERED lines of sheets (doc_id, content).

    Sheets are sections if several have values, each under a line with its number and name (block 0); print titles are header rows; a block that is no
    table once these are one row has its lines as they are, and names the next table. The one table of a sheet has the sheet's number.
    """
    raw, merged = stored(office.sheet_cells(files)), stored(office.merges(files))
    cells = stored(sheets.block_cells(raw, merged))
    flat = stored(flatten_tables(cells, declared=sheets.title_rows(sheets.sheet_blocks(raw, merged), office.print_titles(files))).where(F.size("lines") > 0))
    sheet, block = (F.substring_index("table_id", "/", k).cast("int") for k in (1, -1))
    each = sheets.is_table(flat).withColumns({"sheet": sheet, "block": block})
    order = Window.partitionBy("doc_id", "sheet").orderBy("block")
    last = T.strip_bullet(F.try_element_at(F.filter("lines", lambda x: x != ""), F.lit(-1)))
    before = F.lag(F.when(~F.col("is_table"), T.table_title(last, True))).over(order)
    number = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("sheet"))
    titled = each.withColumns({"title": F.coalesce(before, F.lit("")), "n": number, "sheets": F.size(F.collect_set("sheet").over(Window.partitionBy("doc_id")))})
    titled = titled.withColumn("section", F.when(F.col("sheets") > 1, F.array("n")).otherwise(F.array().cast(PATHS)))
    tables = titled.where("is_table").select("doc_id", "table_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("sheet", "block")).alias("seq"), "section", "title")
    several = titled.where("sheets > 1").select("doc_id", "sheet", "n").distinct()
    plan = outline.table_numbers(tables, several.select("doc_id", F.array("n").alias("path")), ["seq"]).withColumn("continued", F.lit(False))
    names = raw.select("doc_id", F.col("sheet_idx").alias("sheet"), F.col("sheet").alias("name")).distinct()
    start = F.concat(F.col("n").cast("string"), F.lit(". ")) if numbering else F.lit("")
    heads = several.join(names, ["doc_id", "sheet"]).select("doc_id", F.format_string("%04d/0000", "sheet").alias("table_id"), F.lit(0).alias("seq"), F.concat(start, "name").alias("line"))
    others = titled.where("not is_table").select("doc_id", "table_id", F.posexplode("lines").alias("seq", "line"))
    return _numbered(flat, plan, numbering).unionByName(others).unionByName(heads)


# --- positioned pages --------------------------------------------------------------------------------------------------


def page_cells(words: DataFrame, rulings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """CELLS of the outermost tables of pages, ruled ones and columns without rules, and these tables (doc_id, page, table_id, box, edges).

    A table inside a cell is flattened first; its lines stand in that cell, its words nowhere else.
    """
    keys = ["doc_id", "page", "table_id"]
    rulings = G.visible_rules(rulings)
    ruled = stored(G.tables_of_cells(G.ruled_cells(rulings)))
    edges = lambda *c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array(*c)))))
    boxes = ruled.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"), edges("x0", "x1").alias("xs"), edges("top", "bottom").alias("ys"))
    sized = stored(G.large_enough(boxes))
    tables = stored(sized.join(G.outermost(sized), keys).withColumn("edges", G.kept_edges(F.col("xs"))))
    outer, inner = tables.where("parent is null").drop("parent"), tables.where("parent is not null")
    within = inner.select("doc_id", "page", F.col("parent").alias("table_id"), F.col("table_id").alias("child"), "x0", "top", "x1", "bottom")
    inner_cells = _filled_cells(words, ruled, inner)
    lines = flatten_tables(inner_cells).select("doc_id", F.col("table_id").alias("child"), "lines")
    own = words.join(within.select("doc_id", "page", "x0", "top", "x1", "bottom").alias("b"), (words["doc_id"] == F.col("b.doc_id")) & (words["page"] == F.col("b.page")) & _centre_in(words), "left_anti")
    cells = _filled_cells(own, ruled, outer)
    spliced = G.splice_nested(cells, within.join(lines, ["doc_id", "child"]))
    free = G.words_outside(words, outer)
    plain_cells, plain = (stored(x) for x in G.borderless_cells(free, _rules_outside(rulings, outer)))
    return spliced.unionByName(_filled_cells(free, plain_cells, plain)), stored(outer.unionByName(plain))


def _rules_outside(rulings: DataFrame, tables: DataFrame) -> DataFrame:
    """Rules that are no ruled table's own."""
    x, y = (rulings["x0"] + rulings["x1"]) / 2, (rulings["top"] + rulings["bottom"]) / 2
    inside = x.between(tables["x0"] - 3, tables["x1"] + 3) & y.between(tables["top"] - 3, tables["bottom"] + 3)
    return rulings.join(tables, (rulings["doc_id"] == tables["doc_id"]) & (rulings["page"] == tables["page"]) & inside, "left_anti")


def _centre_in(words: DataFrame):
    cx, cy = (words["x0"] + words["x1"]) / 2, (words["top"] + words["bottom"]) / 2
    return cx.between(F.col("b.x0"), F.col("b.x1")) & cy.between(F.col("b.top"), F.col("b.bottom"))


def _filled_cells(words: DataFrame, ruled: DataFrame, tables: DataFrame) -> DataFrame:
    """CELLS of the tables: grid places from their edges, and the words, each in the cell that has it or the nearest one."""
    keys = ["doc_id", "page", "table_id"]
    at = lambda edges, v: F.array_position(edges, v).cast("int") - 1
    row, col = at(F.col("ys"), F.col("top")), at(F.col("xs"), F.col("x0"))
    placed = ruled.join(tables.select(*keys, "xs", "ys"), keys).select(*keys, row.alias("row"), col.alias("col"), (at(F.col("ys"), F.col("bottom")) - row).alias("row_span"), (at(F.col("xs"), F.col("x1")) - col).alias("col_span"), "x0", "top", "x1", "bottom")
    keyed = placed.withColumn("cell_id", F.col("row") * 100_000 + F.col("col"))
    inside = G.words_in_tables(words, tables.select(*keys, "x0", "top", "x1", "bottom"))
    mine = stored(inside.select("doc_id", "page", F.col("b_table_id").alias("table_id"), *(F.col(f"w_{c}").alias(c) for c in ("word_id", "text", "x0", "x1", "top", "bottom", "size"))))
    of = G.assign_words(mine.select(*keys, "word_id", "x0", "x1", "top", "bottom"), keyed.select(*keys, "cell_id", "x0", "x1", "top", "bottom"), keys)
    lines = stored(G.group_lines(mine.join(of, [*keys, "word_id"]), [*keys, "cell_id"]))
    line = F.struct("line_no", F.struct("text", "x0", "x1", "top", "bottom").alias("line"))
    grouped = lines.groupBy(*keys, "cell_id").agg(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]).alias("lines"))
    none = F.array().cast("array<struct<text: string, x0: double, x1: double, top: double, bottom: double>>")
    full = keyed.join(grouped, [*keys, "cell_id"], "left").withColumn("lines", F.coalesce("lines", none))
    return full.select("doc_id", "table_id", "row", "col", "row_span", "col_span", "x0", "top", "x1", "bottom", "lines", F.lit(None).cast("array<struct<level: int, text: string, marker: string>>").alias("items"))


def flatten_pages(words: DataFrame, rulings: DataFrame, pages: DataFrame, numbering: bool = True) -> DataFrame:
    """NUMBERED lines of the tables of positioned pages.

    Headings are lines outside tables that state a number; a table takes the section of the last one before it. A table that
    goes on from the page before keeps its headers and its number. The paragraph right above a table names it. Rules of shapes that draw nothing
    (`fill` and `stroke`, where `rulings` have them) are none.
    """
    cells, tables = page_cells(words, rulings)
    cells = stored(cells)  # each step is read several times: it is done once
    goes_on = stored(G.continuations(tables, pages).select("doc_id", "table_id", "goes_on_from"))
    alone = flatten_tables(cells)
    # Over several pages, the headers are those of the table that began it: the pages between have none of their own.
    so_far = Window.partitionBy("doc_id").orderBy("page", "top", "table_id").rowsBetween(Window.unboundedPreceding, 0)
    began = tables.join(goes_on, ["doc_id", "table_id"], "left").withColumn("began", F.last(F.when(F.col("goes_on_from").isNull(), F.col("table_id")), ignorenulls=True).over(so_far))
    own_headers = alone.select("doc_id", F.col("table_id").alias("began"), "headers")
    carried = began.where("goes_on_from is not null").select("doc_id", "table_id", "began").join(own_headers, ["doc_id", "began"]).select("doc_id", "table_id", "headers")
    flat = flatten_tables(cells, inherited=carried)

    outside = stored(G.group_lines(G.words_outside(words, tables), ["doc_id", "page"]))
    starts = G.paragraph_starts(outside)
    heads = outline.accepted_headings(starts.select("doc_id", "page", "top", "text", "starts_paragraph"))
    listed = outline.headings_of(outside).select("doc_id", "path").distinct()  # entries of a table of contents use numbers up, too
    placed = outline.section_asof(tables.select("doc_id", "page", "top", "table_id", "x0", "x1", "bottom"), heads)
    is_heading = T.parse_heading(F.col("title_line")).isNotNull()
    title = F.when(is_heading, T.table_title(F.col("title_line"), True)).otherwise(T.table_title(F.col("title_text")))
    named = G.title_above(placed, starts).withColumn("title", F.when(F.col("title_line").isNotNull(), title).otherwise(""))
    linked = stored(named.join(goes_on, ["doc_id", "table_id"], "left").withColumn("seq", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "top", "table_id"))))
    own = outline.table_numbers(linked.where("goes_on_from is null").select("doc_id", "table_id", "seq", "section", "title"), listed, ["seq"]).withColumn("continued", F.lit(False))
    more = linked.where("goes_on_from is not null").select("doc_id", "table_id", "seq", F.lit("").alias("title"), "section", F.array().cast(PATHS).alias("path"), F.lit(True).alias("continued"))
    plan = own.select("doc_id", "table_id", "seq", "title", "section", "path", "continued").unionByName(more)
    return _numbered(flat, plan, numbering)


# --- report -----------------------------------------------------------------------------------------------------------------


def check_lines(source_text: DataFrame, numbered: DataFrame, residual: DataFrame | None = None) -> DataFrame:
    """The verification report of tables' texts (doc_id, text) against their NUMBERED lines; `residual` (doc_id) has a row for each table that the output still has."""
    place = [F.length("table_id").alias("n"), "table_id", "seq", "line"]
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*place))), lambda x: x["line"]), "\n")
    return verify.report(source_text, numbered.groupBy("doc_id").agg(text.alias("text")), residual)


def check_word_files(files: DataFrame, made: DataFrame) -> DataFrame:
    """The report of whole word files (doc_id, content) against the files made of them: no word of any story lost, and no table left."""
    return verify.report(office.word_texts(files), office.word_texts(made), office.word_tables(made))


def residual_tables(rulings: DataFrame) -> DataFrame:
    """doc_id, page, table_id: tables that the rules of output pages still show; for `check_lines`."""
    ruled = G.tables_of_cells(G.ruled_cells(G.visible_rules(rulings)))
    boxes = ruled.groupBy("doc_id", "page", "table_id").agg(F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"))
    return G.large_enough(boxes).select("doc_id", "page", "table_id")


def text_of_cells(cells: DataFrame) -> DataFrame:
    """doc_id, text: all that stands in the cells of a document's tables."""
    texts = F.transform("lines", lambda x: x["text"])
    return cells.groupBy("doc_id").agg(F.array_join(F.flatten(F.collect_list(texts)), "\n").alias("text"))
