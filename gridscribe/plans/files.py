"""Queries over word and sheet files that are made of the test tables, read back, flattened, replaced and checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridscribe.operators import sheets
from gridscribe.plans import documents
from gridscribe.plans.registry import query, table
from gridscribe.sources import office, sinks

_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def _c(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def _p(text, props: str = "") -> Column:
    return F.concat(F.lit(f"<w:p><w:pPr>{props}</w:pPr><w:r><w:t>"), _c(text), F.lit("</w:t></w:r></w:p>"))


def _tc(text, props: str = "") -> Column:
    return F.concat(F.lit(f"<w:tc><w:tcPr>{props}</w:tcPr>"), _p(text), F.lit("</w:tc>"))


def _tr(*cells: Column, props: str = "") -> Column:
    return F.concat(F.lit(f"<w:tr><w:trPr>{props}</w:trPr>"), *cells, F.lit("</w:tr>"))


def _tbl(*rows: Column) -> Column:
    return F.concat(F.lit("<w:tbl>"), *rows, F.lit("</w:tbl>"))


def _word(df: DataFrame, doc: str, body: Column, **parts: Column) -> DataFrame:
    """Word files (doc_id, content), one for each row."""
    named = {"document": F.concat(F.lit(f"<w:document {_W}><w:body>"), body, F.lit("</w:body></w:document>"))} | parts
    pairs = [x for name, xml in named.items() for x in (F.lit(f"word/{name}.xml"), xml)]
    return sinks.packed_files(df.select(F.col(doc).cast("string").alias("doc_id"), F.create_map(*pairs).alias("parts")))


def _regions(spark, sf_dir) -> DataFrame:
    """Regions, with their nations as rows of a word table."""
    n = table(spark, sf_dir, "nation").withColumn("k", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")))
    row = F.struct("k", _tr(_tc(F.col("n_name")), _tc(F.concat(F.lit("k"), F.col("n_nationkey").cast("string")))).alias("xml"))
    rows = n.groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["xml"]), "").alias("rows"))
    return table(spark, sf_dir, "region").join(rows, F.col("r_regionkey") == F.col("n_regionkey"))


def _countries() -> Column:
    return _tbl(_tr(_tc("Country"), _tc("Code")), F.col("rows"))


def _counted(numbered: DataFrame) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("doc_id", "table_id").orderBy("seq")).cast("long")
    return numbered.where("line <> ''").select("doc_id", "table_id", k.alias("k"), "line")


_NATIONS = "n AS (SELECT n_regionkey AS r, n_name, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation)"


@query(
    """SELECT n_regionkey::VARCHAR AS doc_id, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey, part) - 1)::INT AS seq, line FROM (
      SELECT n_regionkey, n_nationkey, 0 AS part, 'Nation ' || n_name AS line FROM nation UNION ALL SELECT n_regionkey, n_nationkey, 1, '- item <' || n_nationkey || '> & more' FROM nation)"""
)
def word_round_trip(spark, sf_dir):
    """Lines written as word files and read back, paragraph by paragraph."""
    key = F.col("n_nationkey")
    said = F.struct(key.alias("k"), F.array(F.concat(F.lit("Nation "), "n_name"), F.concat(F.lit("  - item <"), key.cast("string"), F.lit("> & more"))).alias("lines"))
    each = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("doc_id")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(said)), lambda x: x["lines"])).alias("lines"))
    return office.word_paragraphs(sinks.word_files(each)).select("doc_id", "seq", F.col("text").alias("line"))


@query(
    """SELECT r_regionkey::VARCHAR AS doc_id, x.row::INT AS row, x.col::INT AS col, x.rs::INT AS row_span, x.cs::INT AS col_span, x.text FROM region, LATERAL (SELECT unnest([
      {'row': 0, 'col': 0, 'rs': 1, 'cs': 2, 'text': 'wide ' || r_name}, {'row': 0, 'col': 2, 'rs': 3, 'cs': 1, 'text': 'tall' || chr(10) || 'more'}, {'row': 1, 'col': 0, 'rs': 1, 'cs': 1, 'text': 'a'},
      {'row': 1, 'col': 1, 'rs': 1, 'cs': 1, 'text': 'b'}, {'row': 2, 'col': 0, 'rs': 1, 'cs': 2, 'text': 'shut'}, {'row': 3, 'col': 0, 'rs': 1, 'cs': 1, 'text': 'late'}, {'row': 3, 'col': 1, 'rs': 1, 'cs': 1, 'text': 'c'}, {'row': 3, 'col': 2, 'rs': 1, 'cs': 1, 'text': 'd'}]) AS x)"""
)
def word_cell_spans(spark, sf_dir):
    """Cells of word tables: over columns, over rows, text in a cell that goes on, and a merge that a cell of another span closes."""
    r = table(spark, sf_dir, "region")
    start, on, two = '<w:vMerge w:val="restart"/>', "<w:vMerge/>", '<w:gridSpan w:val="2"/>'
    body = _tbl(
        _tr(_tc(F.concat(F.lit("wide "), "r_name"), two), _tc("tall", start)), _tr(_tc("a", start), _tc("b"), _tc("", on)), _tr(_tc("shut", two), _tc("more", on)), _tr(_tc("late", on), _tc("c"), _tc("d")),
    )
    text = F.array_join(F.transform("lines", lambda x: x["text"]), "\n")
    return office.word_cells(_word(r, "r_regionkey", body)).select("doc_id", "row", "col", "row_span", "col_span", text.alias("text"))


@query(
    f"""WITH {_NATIONS}, l AS (SELECT r, 0 AS t, k, '1.' || k || ' Country: ' || n_name || '  |  Code: k' || n_nationkey AS line FROM n
      UNION ALL SELECT DISTINCT r, 1, 0, '2.1 Two of them' FROM n UNION ALL SELECT r, 1, k, '  2.1.' || k || ' Country: ' || n_name || '  |  Code: k' || n_nationkey FROM n
      UNION ALL SELECT r, 2, k, '2.2.' || k || ' Country: ' || n_name || '  |  Code: k' || n_nationkey FROM n
      UNION ALL SELECT r, 3, k, '4.' || k || ' Country: ' || n_name || '  |  Code: k' || n_nationkey FROM n)
    SELECT r::VARCHAR AS doc_id, CASE t WHEN 3 THEN 'header1/0000' ELSE 'document/000' || t END AS table_id, row_number() OVER (PARTITION BY r, t ORDER BY k)::BIGINT AS k, line FROM l"""
)
def flatten_word_files(spark, sf_dir):
    """Word files to numbered lines: typed headings, a lone table with its heading's number and no caption, two under one heading, one of them named, and one in a page header."""
    r = _regions(spark, sf_dir)
    body = F.concat(_p(F.concat(F.lit("1. All of "), "r_name")), _p("Said so:"), _countries(), _p("2. Again"), _p("Two of them:"), _countries(), _p("A sentence."), _countries(), _p("3. Nothing"))
    header = F.concat(F.lit(f"<w:hdr {_W}>"), _countries(), F.lit("</w:hdr>"))
    return _counted(documents.flatten_word_files(_word(r, "r_regionkey", body, header1=header)))


@query(
    f"""WITH {_NATIONS}, l AS (SELECT r, 0 AS t, k, '1.' || k || ' Country: ' || n_name || '  |  Code: k' || n_nationkey AS line FROM n
      UNION ALL SELECT r, 1, k, '2.1.' || k || ' Country: ' || n_name || '  |  Code: k' || n_nationkey FROM n UNION ALL SELECT r, 2, k, '2.2.' || k || ' Country: ' || n_name || '  |  Code: k' || n_nationkey FROM n)
    SELECT r::VARCHAR AS doc_id, 'document/000' || t AS table_id, row_number() OVER (PARTITION BY r, t ORDER BY k)::BIGINT AS k, line FROM l"""
)
def word_styles_and_lists(spark, sf_dir):
    """Headings without a typed number: by the rank of a style that is based on another, and by the number that a list draws."""
    styles = f'<w:styles {_W}><w:style w:styleId="Heading1"/><w:style w:styleId="Mine"><w:basedOn w:val="Heading1"/></w:style><w:style w:styleId="A"><w:basedOn w:val="B"/></w:style><w:style w:styleId="B"><w:basedOn w:val="A"/></w:style></w:styles>'
    level = lambda k: f'<w:lvl w:ilvl="{k}"><w:start w:val="1"/><w:numFmt w:val="decimal"/></w:lvl>'
    numbering = f'<w:numbering {_W}><w:abstractNum w:abstractNumId="7">{level(0)}{level(1)}</w:abstractNum><w:num w:numId="2"><w:abstractNumId w:val="7"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="2"/></w:lvlOverride></w:num></w:numbering>'
    listed = lambda k: f'<w:numPr><w:ilvl w:val="{k}"/><w:numId w:val="2"/></w:numPr>'
    body = F.concat(_p("First", '<w:pStyle w:val="Mine"/>'), _countries(), _p("Second", listed(0)), _p("Its first", listed(1)), _countries(), _p("Its second", listed(1)), _countries(), _p("Loop", '<w:pStyle w:val="A"/>'))
    return _counted(documents.flatten_word_files(_word(_regions(spark, sf_dir), "r_regionkey", body, styles=F.lit(styles), numbering=F.lit(numbering))))


@query(
    f"""WITH {_NATIONS} SELECT r::VARCHAR AS doc_id, 0::BIGINT AS tables, TRUE AS passed, 'All of ' || r_name || ':' || chr(10) || string_agg('1.' || k || ' Country: ' || n_name || '  |  Code: k' || n_nationkey, chr(10) ORDER BY k) || chr(10) || 'after' AS text
    FROM n JOIN region ON r = r_regionkey GROUP BY r, r_name"""
)
def word_tables_replaced(spark, sf_dir):
    """Word files with numbered lines in place of their tables: what the new files say, how many tables they have, and whether the check of both passes."""
    made = _word(_regions(spark, sf_dir), "r_regionkey", F.concat(_p(F.concat(F.lit("All of "), "r_name", F.lit(":"))), _tbl(_tr(_tc("Country"), _tc("Code")), F.col("rows")), _p("after")))
    new = sinks.flattened_word_files(made, documents.flatten_word_files(made).withColumn("line", F.when(~F.col("line").startswith("1 All of"), F.ltrim("line")).otherwise("")))
    said = office.word_texts(new).select("doc_id", F.array_join(F.filter(F.split("text", "\n"), lambda x: x != ""), "\n").alias("text"))
    left = office.word_tables(new).groupBy("doc_id").agg(F.count("*").alias("tables"))
    found = documents.check_word_files(made, new).select("doc_id", "passed")
    return said.join(left, "doc_id", "left").join(found, "doc_id").select("doc_id", F.coalesce("tables", F.lit(0)).cast("long").alias("tables"), "passed", "text")


@query(f"""WITH {_NATIONS} SELECT r::VARCHAR AS doc_id, 'document/0000' AS table_id, 2::INT AS rows FROM n GROUP BY r UNION ALL SELECT DISTINCT r::VARCHAR, 'document/0001', 0::INT FROM n""")
def word_declared_headers(spark, sf_dir):
    """Leading rows that a word table repeats on each page."""
    again = "<w:tblHeader/>"
    one = _tbl(_tr(_tc("Country"), _tc("Code"), props=again), _tr(_tc("of"), _tc("it"), props=again), F.col("rows"))
    return office.declared_headers(_word(_regions(spark, sf_dir), "r_regionkey", F.concat(one, _p("x"), _countries())))


# --- sheets -----------------------------------------------------------------------------------------------------------------


def _t(ref, text) -> Column:
    return F.concat(F.lit('<c r="'), _c(ref), F.lit('" t="inlineStr"><is><t>'), _c(text), F.lit("</t></is></c>"))


def _v(ref, value, style: int = 0, formula: str = "") -> Column:
    return F.concat(F.lit('<c r="'), _c(ref), F.lit(f'" s="{style}">{formula}<v>'), _c(value), F.lit("</v></c>"))


def _row(*cells: Column) -> Column:
    return F.concat(F.lit("<row>"), *cells, F.lit("</row>"))


def _book(df: DataFrame, doc: str, named: dict[str, Column], names: str = "") -> DataFrame:
    """Sheet files (doc_id, content) with a sheet for each name."""
    listed = "".join(f'<sheet name="{name}" sheetId="{k}" r:id="r{k}"/>' for k, name in enumerate(named, 1))
    rels = "".join(f'<Relationship Id="r{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(named) + 1))
    styles = f'<styleSheet {_S}><numFmts><numFmt numFmtId="164" formatCode="0.0%"/><numFmt numFmtId="165" formatCode="dd/mm/yyyy"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="4"/><xf numFmtId="165"/></cellXfs></styleSheet>'
    parts = {"xl/workbook.xml": F.lit(f"<workbook {_S}><sheets>{listed}</sheets>{names}</workbook>"), "xl/_rels/workbook.xml.rels": F.lit(f"<Relationships>{rels}</Relationships>"), "xl/styles.xml": F.lit(styles)}
    parts |= {f"xl/worksheets/sheet{k}.xml": F.concat(F.lit(f"<worksheet {_S}><sheetData>"), xml, F.lit("</sheetData></worksheet>")) for k, xml in enumerate(named.values(), 1)}
    return sinks.packed_files(df.select(F.col(doc).cast("string").alias("doc_id"), F.create_map(*(x for name, xml in parts.items() for x in (F.lit(name), xml))).alias("parts")))


@query(
    """SELECT s_suppkey::VARCHAR AS doc_id, x.sheet::INT AS sheet_idx, x.row::INT AS row, x.text FROM supplier, LATERAL (SELECT unnest([{'sheet': 0, 'row': 1, 'text': s_name}, {'sheet': 0, 'row': 2, 'text': format('{:.1f}', s_nationkey / 8.0 * 100) || '%'},
      {'sheet': 0, 'row': 3, 'text': format('{:,.2f}', s_acctbal)}, {'sheet': 1, 'row': 1, 'text': strftime(DATE '1899-12-30' + (40000 + s_suppkey)::INT, '%d/%m/%Y')}, {'sheet': 1, 'row': 2, 'text': CASE WHEN s_suppkey % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END}]) AS x)"""
)
def sheet_values(spark, sf_dir):
    """Values of sheets as they are shown: text, share, figure, date and truth value."""
    s = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    one = F.concat(_row(_t("A1", F.col("s_name"))), _row(_v("A2", (F.col("s_nationkey") / 8.0).cast("string"), 1)), _row(_v("A3", F.col("s_acctbal").cast("string"), 2)))
    flag = F.concat(F.lit('<c r="A2" t="b"><v>'), (F.lit(1) - key % 2).cast("string"), F.lit("</v></c>"))
    made = _book(s, "s_suppkey", {"one": one, "two": F.concat(_row(_v("A1", (key + 40000).cast("string"), 3)), _row(flag))})
    return sheets.shown_cells(office.sheet_cells(made)).select("doc_id", "sheet_idx", "row", "text")


@query(
    """SELECT s_suppkey::VARCHAR AS doc_id, x.t AS table_id, x.k::BIGINT AS k, x.line FROM supplier, LATERAL (SELECT unnest([{'t': '0000/0000', 'k': 1, 'line': '1. Main list'}, {'t': '0000/0001', 'k': 1, 'line': '1.1 Firm it is: ' || s_name || '  |  Code of it: p' || s_suppkey},
      {'t': '0002/0000', 'k': 1, 'line': '2. Other'}, {'t': '0002/0001', 'k': 1, 'line': '- Of nation ' || s_nationkey}, {'t': '0002/0002', 'k': 1, 'line': '2.1 Of nation ' || s_nationkey}, {'t': '0002/0002', 'k': 2, 'line': '  2.1.1 Firm: ' || s_name || '  |  Code: p' || s_suppkey},
      {'t': '0002/0003', 'k': 1, 'line': '2.2.1 Firm: ' || s_name || '  |  Code: q' || s_suppkey}]) AS x)"""
)
def flatten_sheet_files(spark, sf_dir):
    """Sheet files to numbered lines: sheets as sections under their names, print titles of two rows, a lone table with its sheet's number, a line that names the table below it, an empty sheet."""
    s = table(spark, sf_dir, "supplier")
    code = lambda letter: F.concat(F.lit(letter), F.col("s_suppkey").cast("string"))
    pair = lambda row, a, b: _row(_t(f"A{row}", a), _t(f"B{row}", b))
    one = F.concat(pair(1, "Firm", "Code"), pair(2, "it is", "of it"), pair(3, F.col("s_name"), code("p")))
    two = F.concat(_row(_t("A1", F.concat(F.lit("Of nation "), F.col("s_nationkey").cast("string")))), pair(3, "Firm", "Code"), pair(4, F.col("s_name"), code("p")), pair(6, "Firm", "Code"), pair(7, F.col("s_name"), code("q")))
    titles = "<definedNames><definedName name=\"_xlnm.Print_Titles\" localSheetId=\"0\">'Main list'!$A:$A,'Main list'!$1:$2</definedName></definedNames>"
    return _counted(documents.flatten_sheet_files(_book(s, "s_suppkey", {"Main list": one, "Empty": F.lit(""), "Other": two}, titles)))


@query("""SELECT s_suppkey::VARCHAR AS doc_id, s_suppkey % 3 = 0 AS uncached FROM supplier""")
def uncached_formulas(spark, sf_dir):
    """Sheets with a formula whose value was never stored."""
    s = table(spark, sf_dir, "supplier")
    value = F.when(F.col("s_suppkey") % 3 == 0, "").otherwise("7")
    return office.uncached_formulas(_book(s, "s_suppkey", {"one": _row(_v("A1", "1"), _v("B1", value, formula="<f>A1+6</f>"))}))
