"""Word and sheet files as relations: each file is unzipped and read in its own task."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscribe.groups import SEND
from gridscribe.schema import CELLS, MERGES, PARAGRAPHS, SHEET_CELLS
from gridscribe.session import ship_code

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
SUFFIXES = ("pdf", "docx", "xlsx", "xlsm")
# Number formats of a sheet that are known by number.
FORMATS = {0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 14: "mm-dd-yy", 22: "m/d/yy h:mm"}


def route(path: Column) -> Column:
    """sheet, word or page: which reader a file takes, by its suffix; anything else is read as pages."""
    low = F.lower(path)
    return F.when(low.rlike(r"\.xls[xm]$"), "sheet").when(low.endswith(".docx"), "word").otherwise("page")


def files(spark: SparkSession, folder: str) -> DataFrame:
    """path, doc_id, content of a folder's supported files; not of folders in it, nor of an editor's lock files."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    return found.withColumn("doc_id", F.element_at(F.split("path", "/"), -1)).where(is_supported(F.col("path"))).select("path", "doc_id", "content")


def is_supported(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(name).rlike(rf"\.({'|'.join(SUFFIXES)})$") & ~name.startswith("~$")


def output_name(path: Column) -> Column:
    """Name of a flattened file: stem and `_flattened`, once; sheets become word files."""
    name = F.element_at(F.split(path, "/"), -1)
    stem, suffix = F.regexp_extract(name, r"^(.*)\.([^.]*)$", 1), F.lower(F.regexp_extract(name, r"^(.*)\.([^.]*)$", 2))
    stem = F.when(F.lower(stem).endswith("_flattened"), stem).otherwise(F.concat(stem, F.lit("_flattened")))
    return F.concat(stem, F.lit("."), F.when(suffix.isin("xlsx", "xlsm"), "docx").otherwise(suffix))


def distinct_names(rows: DataFrame, name: str, order: str) -> DataFrame:
    """`rows` whose equal names (letters of any case) are told apart by ` (2)`, ` (3)` and so on."""
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy(F.lower(name)).orderBy(order))
    told = F.regexp_replace(F.col(name), r"^(.*?)(\.[^.]*)?$", "$1")
    suffix = F.regexp_extract(F.col(name), r"(\.[^.]*)$", 1)
    return rows.withColumn("__k", k).withColumn(name, F.when(F.col("__k") > 1, F.concat(told, F.lit(" ("), F.col("__k").cast("string"), F.lit(")"), suffix)).otherwise(F.col(name))).drop("__k")


def _each_file(docs: DataFrame, read, schema: str) -> DataFrame:
    ship_code(docs.sparkSession)
    names = [part.split()[0] for part in re.sub(r"<[^<>]*(<[^<>]*>)?[^<>]*>", "", schema).split(",")]

    def run(batches):
        rows = []
        for batch in batches:
            for doc_id, content in zip(batch["doc_id"], batch["content"], strict=True):
                rows.extend(read(doc_id, bytes(content)))
                if len(rows) >= SEND:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return docs.select("doc_id", "content").mapInPandas(run, schema)


# --- word files ------------------------------------------------------------------------------------------------


def _flag(node, name: str, default=None):
    child = node.find(f"{W}{name}") if node is not None else None
    return default if child is None else child.get(f"{W}val", "")


def _whole(value) -> int | None:
    return int(value) if value is not None and re.fullmatch(r"-?\d+", value) else None


def paragraph_text(p) -> str:
    """Text of a paragraph: tabs are blanks, breaks are line feeds, hyphens that do not break are hyphens."""
    marks = {f"{W}tab": " ", f"{W}br": "\n", f"{W}cr": "\n", f"{W}noBreakHyphen": "-"}
    return "".join(n.text or "" if n.tag == f"{W}t" else marks.get(n.tag, "") for n in p.iter())


def _stories(z: zipfile.ZipFile):
    for name in sorted(z.namelist()):
        m = re.fullmatch(r"word/(document|header\d*|footer\d*|footnotes|endnotes)\.xml", name)
        if m:
            yield m[1], ET.fromstring(z.read(name))


def _read_paragraphs(doc_id: str, content: bytes):
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for story, root in _stories(z):
            tables = {id(p): k for k, t in enumerate(root.iter(f"{W}tbl")) for p in t.iter(f"{W}p")}
            for seq, p in enumerate(root.iter(f"{W}p")):
                props = p.find(f"{W}pPr")
                listed = props.find(f"{W}numPr") if props is not None else None
                yield doc_id, story, seq, paragraph_text(p), _flag(props, "pStyle"), _flag(listed, "numId"), _whole(_flag(listed, "ilvl")), _whole(_flag(props, "outlineLvl")), id(p) in tables, tables.get(id(p))


def word_paragraphs(docs: DataFrame) -> DataFrame:
    """PARAGRAPHS of files (doc_id, content), in reading order, those in tables included."""
    return _each_file(docs, _read_paragraphs, PARAGRAPHS)


def _cell_items(tc) -> list[dict]:
    """Items of a cell; a table in it is flattened first and its lines are items one level down."""
    out = []
    for node in tc:
        if node.tag == f"{W}p":
            listed = node.find(f"{W}pPr/{W}numPr")
            level = min(3, _whole(_flag(listed, "ilvl")) or 0) if listed is not None else 0
            out += [{"level": level, "text": t, "marker": "-" if listed is not None else ""} for t in map(str.strip, paragraph_text(node).split("\n")) if t]
        elif node.tag == f"{W}tbl":
            from gridscribe.operators.grid import Cell, Item, Line, flatten_grid, grid_of

            inner = [Cell(*r[2:6], r[6:10], tuple(Line(**x) for x in r[10]), tuple(Item(**x) for x in r[11])) for r in _table_cells("", "", node)]
            if inner:
                for line in flatten_grid(grid_of(inner))[0]:
                    bare = line.lstrip(" ")
                    marker = bare[0] if bare[:2] in ("- ", "+ ", "* ") else ""
                    out.append({"level": (len(line) - len(bare)) // 2, "text": bare[2:] if marker else bare, "marker": marker})
    return out


# A cell's made-up geometry, spaced so that nothing is fused by it.
COLUMN, ROW, GAP, LINE = 120.0, 40.0, 12.0, 10.0


def made_cell(doc_id, table_id, row, col, row_span, col_span, items) -> tuple:
    box = (col * COLUMN, row * (ROW + GAP), (col + col_span) * COLUMN - GAP, (row + row_span) * (ROW + GAP) - GAP)
    lines = [{"text": x["text"], "x0": box[0], "x1": box[0] + 1, "top": box[1] + LINE * k, "bottom": box[1] + LINE * (k + 1)} for k, x in enumerate(items)]
    return doc_id, table_id, row, col, row_span, col_span, *box, lines, items


def _table_cells(doc_id: str, table_id: str, tbl):
    anchors: dict[int, list] = {}  # column: the cell that a merge goes on from, until another cell stands there
    made: list[list] = []
    for r, tr in enumerate(tbl.findall(f"{W}tr")):
        col = 0
        for tc in tr.findall(f"{W}tc"):
            props = tc.find(f"{W}tcPr")
            span = max(1, _whole(_flag(props, "gridSpan")) or 1)
            merge = _flag(props, "vMerge")
            own = _cell_items(tc)
            goes_on = anchors.get(col) if merge in ("", "continue") else None
            if goes_on is not None:
                goes_on[2] = r - goes_on[0] + 1
                goes_on[4].extend(own)
            else:
                cell = [r, col, 1, span, own]
                made.append(cell)
                for c in range(col, col + span):
                    anchors.pop(c, None)
                if merge == "restart":
                    anchors[col] = cell
            col += span
    for r, c, row_span, span, items in made:
        yield made_cell(doc_id, table_id, r, c, row_span, span, items)


def _read_word_cells(doc_id: str, content: bytes):
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for story, root in _stories(z):
            inner = {id(t) for outer in root.iter(f"{W}tbl") for t in outer.iter(f"{W}tbl") if t is not outer}
            for k, tbl in enumerate(root.iter(f"{W}tbl")):
                if id(tbl) not in inner:
                    yield from _table_cells(doc_id, f"{story}/{k:04d}", tbl)


def word_cells(docs: DataFrame) -> DataFrame:
    """CELLS of the outermost tables of word files; their items are what the paragraphs state."""
    return _each_file(docs, _read_word_cells, CELLS)


def _read_declared(doc_id: str, content: bytes):
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for story, root in _stories(z):
            for k, tbl in enumerate(root.iter(f"{W}tbl")):
                n = 0
                for tr in tbl.findall(f"{W}tr"):
                    if tr.find(f"{W}trPr/{W}tblHeader") is None:
                        break
                    n += 1
                yield doc_id, f"{story}/{k:04d}", n


def _read_word_tables(doc_id: str, content: bytes):
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for story, root in _stories(z):
            for k, _ in enumerate(root.iter(f"{W}tbl")):
                yield doc_id, f"{story}/{k:04d}"


def word_tables(docs: DataFrame) -> DataFrame:
    """doc_id, table_id of every table of word files, those inside others too."""
    return _each_file(docs, _read_word_tables, "doc_id string, table_id string")


def _read_word_text(doc_id: str, content: bytes):
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        yield doc_id, "\n".join(paragraph_text(p) for _, root in _stories(z) for p in root.iter(f"{W}p"))


def word_texts(docs: DataFrame) -> DataFrame:
    """doc_id, text of word files: every paragraph of every story, a line each."""
    return _each_file(docs, _read_word_text, "doc_id string, text string")


def declared_headers(docs: DataFrame) -> DataFrame:
    """doc_id, table_id, rows: leading rows that a word table repeats on each page."""
    return _each_file(docs, _read_declared, "doc_id string, table_id string, rows int")


def _read_levels(doc_id: str, content: bytes):
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if "word/numbering.xml" not in z.namelist():
            return
        root = ET.fromstring(z.read("word/numbering.xml"))
    abstract = {a.get(f"{W}abstractNumId"): a for a in root.findall(f"{W}abstractNum")}
    for num in root.findall(f"{W}num"):
        name = _flag(num, "abstractNumId")
        override = {_whole(o.get(f"{W}ilvl")): _whole(_flag(o, "startOverride")) for o in num.findall(f"{W}lvlOverride")}
        for level in abstract[name].findall(f"{W}lvl") if name in abstract else ():
            k = _whole(level.get(f"{W}ilvl"))
            yield doc_id, num.get(f"{W}numId"), name, k, _whole(_flag(level, "start")), _flag(level, "numFmt"), override.get(k)


def list_levels(docs: DataFrame) -> DataFrame:
    """Levels of the lists of word files, for `outline.list_numbers`."""
    return _each_file(docs, _read_levels, "doc_id string, num_id string, abstract_id string, ilvl int, start int, fmt string, override int")


def _read_styles(doc_id: str, content: bytes):
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if "word/styles.xml" not in z.namelist():
            return
        root = ET.fromstring(z.read("word/styles.xml"))
    own = {}
    for style in root.findall(f"{W}style"):
        props = style.find(f"{W}pPr")
        listed = props.find(f"{W}numPr") if props is not None else None
        name = style.get(f"{W}styleId")
        rank = re.fullmatch(r"Heading ?([1-9])", name or "")
        level = _whole(_flag(props, "outlineLvl"))
        own[name] = (_flag(style, "basedOn"), int(rank[1]) - 1 if level is None and rank else level, _flag(listed, "numId"), _whole(_flag(listed, "ilvl")))
    for name in own:
        chain, at = [], name
        while at in own and at not in chain:  # a style that is based on itself, through others, ends the chain
            chain.append(at)
            at = own[at][0]
        first = lambda k, chain=chain: next((own[s][k] for s in chain if own[s][k] is not None), None)
        yield doc_id, name, first(1), first(2), first(3)


def word_styles(docs: DataFrame) -> DataFrame:
    """doc_id, style_id, outline_lvl, num_id, ilvl: what each paragraph style says, itself or through the styles it is based on."""
    return _each_file(docs, _read_styles, "doc_id string, style_id string, outline_lvl int, num_id string, ilvl int")


def styled_paragraphs(docs: DataFrame) -> DataFrame:
    """PARAGRAPHS with what their styles say, where they do not say it themselves."""
    styles = word_styles(docs).select("doc_id", "style_id", *(F.col(c).alias(f"__{c}") for c in ("outline_lvl", "num_id", "ilvl")))
    met = word_paragraphs(docs).join(styles, ["doc_id", "style_id"], "left")
    return met.withColumns({c: F.coalesce(c, f"__{c}") for c in ("outline_lvl", "num_id", "ilvl")}).drop("__outline_lvl", "__num_id", "__ilvl")


# --- sheets --------------------------------------------------------------------------------------------------------


def _column(ref: str) -> tuple[int, int]:
    letters, digits = re.fullmatch(r"\$?([A-Z]+)\$?(\d+)", ref).groups()
    col = 0
    for c in letters:
        col = 26 * col + ord(c) - 64
    return int(digits), col


def _sheets(z: zipfile.ZipFile):
    book = ET.fromstring(z.read("xl/workbook.xml"))
    targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    for k, sheet in enumerate(book.iter(f"{S}sheet")):
        target = targets[sheet.get(f"{R}id")].lstrip("/")
        yield k, sheet.get("name"), ET.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))


def _styles(z: zipfile.ZipFile) -> list[str]:
    if "xl/styles.xml" not in z.namelist():
        return []
    root = ET.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): f.get("formatCode") for f in root.iter(f"{S}numFmt")}
    crossed = root.find(f"{S}cellXfs")
    ids = [int(x.get("numFmtId", 0)) for x in (crossed if crossed is not None else ())]
    return [own.get(i, FORMATS.get(i, "General")) for i in ids]


def _read_sheet_cells(doc_id: str, content: bytes):
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{S}si")]
        styles = _styles(z)
        for k, name, root in _sheets(z):
            for c in root.iter(f"{S}c"):
                row, col = _column(c.get("r"))
                kind, raw = c.get("t", "n"), c.findtext(f"{S}v")
                style = int(c.get("s", 0))
                fmt = styles[style] if style < len(styles) else "General"
                number = stamp = text = flag = None
                if kind == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(f"{S}t"))
                elif raw is None:
                    continue
                elif kind == "s":
                    text = shared[int(raw)]
                elif kind == "b":
                    flag = raw == "1"
                elif kind == "n":
                    number = float(raw)
                    if re.search(r"[dy]|h:m", re.sub(r'"[^"]*"|\[[^\]]*\]', "", fmt.lower())) and "general" not in fmt.lower():
                        number, stamp = None, pd.Timestamp("1899-12-30") + pd.Timedelta(days=number).round("s")
                else:
                    text = raw
                yield doc_id, k, name, row, col, number, stamp, text, flag, fmt


def sheet_cells(docs: DataFrame) -> DataFrame:
    """SHEET_CELLS of files (doc_id, content): cached values, typed; cells without a value are not there."""
    return _each_file(docs, _read_sheet_cells, SHEET_CELLS)


def _read_merges(doc_id: str, content: bytes):
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for k, _, root in _sheets(z):
            for m in root.iter(f"{S}mergeCell"):
                a, _, b = m.get("ref").partition(":")
                (r0, c0), (r1, c1) = _column(a), _column(b or a)
                yield doc_id, k, r0, c0, r1, c1


def merges(docs: DataFrame) -> DataFrame:
    return _each_file(docs, _read_merges, MERGES)


def _read_print_titles(doc_id: str, content: bytes):
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        book = ET.fromstring(z.read("xl/workbook.xml"))
    for name in book.iter(f"{S}definedName"):
        rows = re.search(r"\$?\b(\d+):\$?(\d+)\b", name.text or "")
        if name.get("name") == "_xlnm.Print_Titles" and name.get("localSheetId") is not None and rows:
            yield doc_id, int(name.get("localSheetId")), int(rows[1]), int(rows[2])


def print_titles(docs: DataFrame) -> DataFrame:
    """doc_id, sheet_idx, first, last: rows that a sheet repeats at the top of each printed page."""
    return _each_file(docs, _read_print_titles, "doc_id string, sheet_idx int, first int, last int")


def _read_uncached(doc_id: str, content: bytes):
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        found = any(c.find(f"{S}f") is not None and not (c.findtext(f"{S}v") or "").strip() for _, _, root in _sheets(z) for c in root.iter(f"{S}c"))
    yield doc_id, found


def uncached_formulas(docs: DataFrame) -> DataFrame:
    """doc_id, uncached: whether a sheet has a formula whose value was never stored."""
    return _each_file(docs, _read_uncached, "doc_id string, uncached boolean")
