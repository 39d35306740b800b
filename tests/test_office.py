"""Word and sheet files, made here, through the readers to lines; files as a stream; sinks."""

import io
import zipfile

from pyspark.sql import functions as F

from gridscribe.operators import sheets
from gridscribe.operators.grid import flatten_tables
from gridscribe.sources import office, sinks
from gridscribe.streaming import flatten as stream

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def packed(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def p(text, props=""):
    return f"<w:p><w:pPr>{props}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"


def tc(content, props=""):
    return f"<w:tc><w:tcPr>{props}</w:tcPr>{content if content.startswith('<') else p(content)}</w:tc>"


def tbl(*rows, head=0):
    return "<w:tbl>" + "".join(f"<w:tr>{'<w:trPr><w:tblHeader/></w:trPr>' if k < head else ''}{''.join(r)}</w:tr>" for k, r in enumerate(rows)) + "</w:tbl>"


def word(body, **more):
    return packed({"word/document.xml": f"<w:document {NS}><w:body>{body}</w:body></w:document>", **{f"word/{k}.xml": v for k, v in more.items()}})


def docs(spark, *contents):
    return spark.createDataFrame([(f"d{k}", bytearray(c)) for k, c in enumerate(contents)], "doc_id string, content binary")


def flat(spark, body, **more):
    got = flatten_tables(office.word_cells(docs(spark, word(body, **more)))).orderBy("table_id").collect()
    return [list(r["lines"]) for r in got]


def test_word_table(spark):
    assert flat(spark, p("x") + tbl([tc("Tên"), tc("Tuổi")], [tc("Nam"), tc("25")])) == [["- Tên: Nam  |  Tuổi: 25"]]


def test_spans_and_merges(spark):
    body = tbl([tc("Nhóm"), tc("Mục"), tc("Phí")], [tc("A", '<w:vMerge w:val="restart"/>'), tc("m1"), tc("p1")], [tc("", "<w:vMerge/>"), tc("m2"), tc("p2")], [tc("B"), tc("chung cho cả", '<w:gridSpan w:val="2"/>')])
    assert flat(spark, body) == [["- Nhóm: A  |  m1  |  Phí: p1".replace("m1", "Mục: m1"), "- Nhóm: A  |  Mục: m2  |  Phí: p2", "- Nhóm: B  |  Mục: chung cho cả"]]


def test_nested_table_and_lists(spark):
    inner = tbl([tc("K"), tc("V")], [tc("x"), tc("y")])
    listed = p("một", '<w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr>') + p("hai", '<w:numPr><w:ilvl w:val="1"/><w:numId w:val="1"/></w:numPr>')
    body = tbl([tc("Tên gọi"), tc("Nội dung")], [tc("a1"), tc(inner)], [tc("b1"), tc(listed)])
    got = flat(spark, body)
    assert len(got) == 1 and got[0][0].startswith("- Tên gọi: a1") and "K: x  |  V: y" in "\n".join(got[0])
    assert got[0][-2:] == ["  - một", "    - hai"]


def test_stories_paragraphs_and_declared_headers(spark):
    header = f"<w:hdr {NS}>{tbl([tc('H1'), tc('H2')], [tc('h'), tc('k')])}</w:hdr>"
    d = docs(spark, word(p("1. Mục", '<w:pStyle w:val="Heading1"/><w:outlineLvl w:val="0"/>') + "<w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/><w:t>c</w:t><w:noBreakHyphen/></w:r></w:p>" + tbl([tc("A"), tc("B")], [tc("x"), tc("y")], head=1), header1=header))
    rows = {(r["story"], r["seq"]): r for r in office.word_paragraphs(d).collect()}
    assert rows["document", 0]["style_id"] == "Heading1" and rows["document", 0]["outline_lvl"] == 0
    assert rows["document", 1]["text"] == "a b\nc-" and not rows["document", 1]["in_table"] and rows["document", 2]["in_table"]
    assert {r["story"] for r in office.word_paragraphs(d).select("story").collect()} == {"document", "header1"}
    assert {r["table_id"]: r["rows"] for r in office.declared_headers(d).collect()} == {"document/0000": 1, "header1/0000": 0}


def test_list_levels(spark):
    numbering = f'<w:numbering {NS}><w:abstractNum w:abstractNumId="7"><w:lvl w:ilvl="0"><w:start w:val="3"/><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="2"><w:abstractNumId w:val="7"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="9"/></w:lvlOverride></w:num></w:numbering>'
    got = office.list_levels(docs(spark, word(p("x"), numbering=numbering))).collect()
    assert [tuple(r)[1:] for r in got] == [("2", "7", 0, 3, "decimal", 9)]


S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def book(cells, merges="", sheets=None, names=""):
    sheets = sheets or [("S1", cells)]
    return packed({
        "xl/workbook.xml": f'<workbook {S}><sheets>{"".join(f'<sheet name="{name}" sheetId="{k}" r:id="r{k}"/>' for k, (name, _) in enumerate(sheets, 1))}</sheets>{names}</workbook>',
        "xl/_rels/workbook.xml.rels": "<Relationships>" + "".join(f'<Relationship Id="r{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>",
        "xl/styles.xml": f'<styleSheet {S}><numFmts><numFmt numFmtId="164" formatCode="0.0%"/><numFmt numFmtId="165" formatCode="dd/mm/yyyy hh:mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="3"/><xf numFmtId="165"/></cellXfs></styleSheet>',
        "xl/sharedStrings.xml": f"<sst {S}><si><t>Tên</t></si><si><r><t>Tỷ </t></r><r><t>lệ</t></r></si></sst>",
        **{f"xl/worksheets/sheet{k}.xml": f"<worksheet {S}><sheetData>{own}</sheetData><mergeCells>{merges}</mergeCells></worksheet>" for k, (_, own) in enumerate(sheets, 1)},
    })


def row(n, *cells):
    return f'<row r="{n}">' + "".join(c.replace("@", str(n)) for c in cells) + "</row>"


def test_sheet_to_lines(spark):
    cells = row(2, '<c r="B@" t="s"><v>0</v></c>', '<c r="C@" t="s"><v>1</v></c>', '<c r="D@" t="inlineStr"><is><t>Ngày</t></is></c>') + row(3, '<c r="B@" t="inlineStr"><is><t>Vay</t></is></c>', '<c r="C@" s="1"><v>0.291</v></c>', '<c r="D@" s="3"><v>46186.354166666664</v></c>') + row(6, '<c r="B@" s="2"><v>1090350000</v></c>', '<c r="C@" t="b"><v>1</v></c>', '<c r="D@"><f>A1</f></c>')
    d = docs(spark, book(cells))
    found, merged = office.sheet_cells(d), office.merges(d)
    assert {r["text"] for r in sheets.shown_cells(found).collect()} == {"Tên", "Tỷ lệ", "Ngày", "Vay", "29.1%", "13/06/2026 08:30", "1,090,350,000", "TRUE"}
    assert [tuple(r)[2:] for r in sheets.sheet_blocks(found, merged).orderBy("block").select("doc_id", "sheet_idx", "first_row", "last_row", "first_col", "last_col").collect()] == [(2, 3, 2, 4), (6, 6, 2, 3)]
    got = {r["table_id"]: list(r["lines"]) for r in flatten_tables(sheets.block_cells(found, merged)).collect()}
    assert got["0000/0001"] == ["- Tên: Vay  |  Tỷ lệ: 29.1%  |  Ngày: 13/06/2026 08:30"]
    assert office.uncached_formulas(d).first()["uncached"] is True


def test_merges_widen_blocks(spark):
    cells = row(1, '<c r="A@" t="inlineStr"><is><t>Tiêu đề</t></is></c>') + row(3, '<c r="A@"><v>1</v></c>')
    d = docs(spark, book(cells, '<mergeCell ref="A1:C2"/>'))
    got = sheets.sheet_blocks(office.sheet_cells(d), office.merges(d)).collect()
    assert [(r["first_row"], r["last_row"], r["first_col"], r["last_col"]) for r in got] == [(1, 3, 1, 3)]
    assert sheets.covered(office.merges(d)).count() == 5


def test_folder_stream_and_sinks(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    for k in range(3):
        (folder / f"f{k}.docx").write_bytes(word(tbl([tc("Tên"), tc("Tuổi")], [tc(f"N{k}"), tc("5")])))
    (folder / "~$f0.docx").write_bytes(b"lock")
    (folder / "note.txt").write_text("x")
    assert sorted(r["doc_id"] for r in office.files(spark, str(folder)).select("doc_id").collect()) == ["f0.docx", "f1.docx", "f2.docx"]
    (folder / "~$f0.docx").unlink()
    stream.flatten_stream(stream.arriving_files(spark, str(folder), per_trigger=2), str(out), str(tmp_path / "state")).awaitTermination(120)
    streamed = spark.read.parquet(str(out)).select("doc_id", "lines")
    batch = flatten_tables(office.word_cells(office.files(spark, str(folder)))).select("doc_id", "lines")
    assert sorted(map(str, streamed.collect())) == sorted(map(str, batch.collect())) and batch.count() == 3
    back = sinks.word_files(batch.select("doc_id", F.concat(F.lit(["x", "", "", "  y"]), "lines").alias("lines")))
    texts = [r["text"] for r in office.word_paragraphs(back).where("doc_id = 'f1.docx'").orderBy("seq").collect()]
    assert texts == ["x", "", "y", "- Tên: N1  |  Tuổi: 5"]
    sinks.write_text(batch.select("doc_id", F.explode("lines").alias("line")), str(tmp_path / "text"))
    assert spark.read.text(str(tmp_path / "text")).count() == 3


def test_late_events_are_dropped(spark, tmp_path):
    for k, rows in enumerate([[("2024-01-01 10:00:00", "a"), ("2024-01-01 16:00:00", "a")], [("2024-01-01 10:05:00", "a"), ("2024-01-01 22:00:00", "a")], [("2024-01-02 06:00:00", "b")]]):
        spark.createDataFrame(rows, "ts string, event_type string").selectExpr("cast(ts as timestamp) ts", "event_type", "1.0D value").coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
        source = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "e"))
        q = stream.windowed_counts(source).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = {str(r["w"]): r["n"] for r in spark.read.parquet(str(tmp_path / "o")).selectExpr("window.start w", "n").collect()}
    assert got["2024-01-01 10:00:00"] == 1 and got["2024-01-01 16:00:00"] == 1


def test_a_cell_of_another_span_closes_a_vertical_merge(spark):
    first = '<w:vMerge w:val="restart"/>'
    body = tbl([tc("a", first), tc("b")], [tc("wide", '<w:gridSpan w:val="2"/>')], [tc("late", "<w:vMerge/>"), tc("d")])
    got = {(r["row"], r["col"]): (r["row_span"], r["col_span"], r["lines"][0]["text"]) for r in office.word_cells(docs(spark, word(body))).collect()}
    assert got == {(0, 0): (1, 1, "a"), (0, 1): (1, 1, "b"), (1, 0): (1, 2, "wide"), (2, 0): (1, 1, "late"), (2, 1): (1, 1, "d")}
    body = tbl([tc("a", first), tc("b")], [tc("", "<w:vMerge/>"), tc("c")], [tc("more", "<w:vMerge/>"), tc("d")])
    got = {(r["row"], r["col"]): (r["row_span"], [x["text"] for x in r["lines"]]) for r in office.word_cells(docs(spark, word(body))).collect()}
    assert got[0, 0] == (3, ["a", "more"]) and set(got) == {(0, 0), (0, 1), (1, 1), (2, 1)}


def test_pages_in_different_batches_are_numbered_as_one_document(spark, tmp_path):
    from gridscribe.operators import outline

    kind = "doc_id string, table_id string, seq int, lines array<string>, path array<int>, title string, headers array<string>, continued boolean"
    pages = [
        [("d", "t1", 1, ["- Tên: a", "- Tên: b"], [1], "Danh sách", ["Tên"], False), ("e", "u1", 1, ["- Tên: x"], [2], "", ["Tên"], False)],
        [("d", "t2", 2, ["- Tên: c"], [], "", ["Tên"], True)],
        [("e", "u2", 2, ["- Tên: y"], [], "", ["Tên"], True), ("d", "t3", 3, ["- Tên: e"], [3], "", ["Tên"], False)],
    ]
    for k, rows in enumerate(pages):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
        source = spark.readStream.schema(kind).parquet(str(tmp_path / "e"))
        q = stream.number_stream(source).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = sorted(map(str, spark.read.parquet(str(tmp_path / "o")).select("doc_id", "table_id", "seq", "line").collect()))
    whole = outline.number_documents(spark.createDataFrame([r for rows in pages for r in rows], kind)).select("doc_id", "table_id", "seq", "line")
    assert got == sorted(map(str, whole.collect())) and len(got) == 11
