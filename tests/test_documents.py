"""Whole documents of each format, from file or page to numbered, checked lines."""

from pyspark.sql import functions as F

from gridscribe.functions.register import register
from gridscribe.plans import documents as D
from gridscribe.operators import layout
from gridscribe.sources import office, sinks

from .test_office import book, docs, p, row, tbl, tc, word


def lines(numbered):
    out = {}
    for r in numbered.orderBy("doc_id", "table_id", "seq").collect():
        out.setdefault((r["doc_id"], r["table_id"]), []).append(r["line"])
    return out


def test_word_file(spark):
    one = tbl([tc("STT"), tc("Hồ sơ")], [tc("1"), tc("Đơn")], [tc("2"), tc("Sao kê")])
    two = tbl([tc("Tên"), tc("Tuổi")], [tc("Nam"), tc("25")])
    body = p("1. Quy định") + p("1.1 Phạm vi") + p("Hồ sơ gồm:") + one + p("Một câu.") + two + p("Chương hai", '<w:outlineLvl w:val="0"/>') + two
    d = docs(spark, word(body))
    got = lines(D.flatten_word_files(d))
    assert got["d0", "document/0000"] == ["1.1.1 Hồ sơ gồm  |  STT", "", "  1  |  Hồ sơ: Đơn", "", "  2  |  Hồ sơ: Sao kê"]
    assert got["d0", "document/0001"] == ["Tên: Nam  |  Tuổi: 25"]
    assert got["d0", "document/0002"] == ["2.1 Tên: Nam  |  Tuổi: 25"]  # the heading above has the table's number: it is not said again
    plain = lines(D.flatten_word_files(d, numbering=False))
    assert plain["d0", "document/0000"][0] == "- STT  |  Hồ sơ" and plain["d0", "document/0002"] == ["- Tên: Nam  |  Tuổi: 25"]
    report = D.check_lines(D.text_of_cells(office.word_cells(d)), D.flatten_word_files(d)).first()
    assert report["missing_tokens"] == [] and report["passed"]


def test_declared_header(spark):
    body = tbl([tc("Khoản mục"), tc("Số tiền"), tc("")], [tc("Vay"), tc("5 triệu"), tc("x1")], [tc("Trả"), tc("3 triệu"), tc("x2")], head=1)
    got = lines(D.flatten_word_files(docs(spark, word(body))))
    assert got["d0", "document/0000"] == ["1.1 Khoản mục: Vay  |  Số tiền: 5 triệu  |  x1", "", "1.2 Khoản mục: Trả  |  Số tiền: 3 triệu  |  x2"]


def test_merged_header_of_two_rows(spark):
    wide = '<w:gridSpan w:val="2"/>'
    body = tbl([tc("Tên"), tc("Phí năm", wide)], [tc(""), tc("2024"), tc("2025 dự kiến")], [tc("Nam"), tc("1"), tc("2")])
    got = lines(D.flatten_word_files(docs(spark, word(body))))
    assert got["d0", "document/0000"][0] == "1.1 Tên: Nam  |  Phí năm 2024: 1  |  Phí năm 2025 dự kiến: 2"


def text(col, value):
    return f'<c r="{col}@" t="inlineStr"><is><t>{value}</t></is></c>'


def test_sheet_file(spark):
    cells = row(1, text("A", "Biểu phí")) + row(3, text("A", "Tên"), text("B", "Phí")) + row(4, text("A", "Vay"), text("B", "1%"))
    got = lines(D.flatten_sheet_files(docs(spark, book(cells))))
    assert got == {("d0", "0000/0001"): ["- Biểu phí"], ("d0", "0000/0002"): ["1 Biểu phí", "", "  1.1 Tên: Vay  |  Phí: 1%"]}


def test_sheets_are_sections_with_their_names_and_print_titles(spark):
    one = row(1, text("A", "Sản phẩm"), text("B", "Kỳ hạn")) + row(2, text("A", "vay"), text("B", "năm")) + row(3, text("A", "Nhà ở"), text("B", "12 tháng"))
    two = row(2, text("A", "Tên"), text("B", "Phí")) + row(3, text("A", "Vay"), text("B", "1%")) + row(5, text("A", "Tên"), text("B", "Giá")) + row(6, text("A", "Mua"), text("B", "2%"))
    names = '<definedNames><definedName name="_xlnm.Print_Titles" localSheetId="0">\'Biểu một\'!$A:$A,\'Biểu một\'!$1:$2</definedName></definedNames>'
    d = docs(spark, book(one, sheets=[("Biểu một", one), ("Trống", ""), ("Biểu ba", two)], names=names))
    assert [tuple(r) for r in office.print_titles(d).collect()] == [("d0", 0, 1, 2)]
    got = lines(D.flatten_sheet_files(d))
    assert got["d0", "0000/0000"] == ["1. Biểu một"] and got["d0", "0002/0000"] == ["2. Biểu ba"] and ("d0", "0001/0000") not in got
    assert got["d0", "0000/0001"] == ["1.1 Sản phẩm vay: Nhà ở  |  Kỳ hạn năm: 12 tháng"]
    assert got["d0", "0002/0001"] == ["2.1.1 Tên: Vay  |  Phí: 1%"] and got["d0", "0002/0002"] == ["2.2.1 Tên: Mua  |  Giá: 2%"]
    assert lines(D.flatten_sheet_files(d, numbering=False))["d0", "0002/0000"] == ["Biểu ba"]


def page(doc, number, height=800.0):
    return doc, number, 600.0, height, 0


def ruled(doc, number, x, y, rows, cols, w=100.0, h=20.0):
    return [(doc, number, x, y + h * r, x + w * cols, y + h * r) for r in range(rows + 1)] + [(doc, number, x + w * c, y, x + w * c, y + h * rows) for c in range(cols + 1)]


def typed(doc, number, start, rows):
    """Words of (x, y, text) rows, eight wide a letter."""
    out = []
    for x, y, s in rows:
        for w in s.split():
            out.append((doc, number, start + len(out), w, x, x + 5.0 * len(w), y, y + 9, 9.0))
            x += 5.0 * len(w) + 3
    return out


def test_pages(spark):
    rulings = ruled("d", 1, 50.0, 100.0, 3, 2) + ruled("d", 1, 50.0, 640.0, 3, 2) + ruled("d", 2, 50.0, 60.0, 2, 2)
    cell = lambda k, r, c, s: (55.0 + 100 * c, {0: 105.0, 1: 645.0, 2: 65.0}[k] + 20 * r, s)
    first = [(50.0, 60.0, "1. Quy định"), (50.0, 85.0, "Bảng 1: Biểu phí"), *(cell(0, r, c, s) for r, pair in enumerate((("Tên gọi", "Phí"), ("Vay", "5"), ("Trả", "7"))) for c, s in enumerate(pair))]
    first += [(50.0, 300.0, "1.1 Hồ sơ"), *(cell(1, r, c, s) for r, pair in enumerate((("Mã HĐ", "Ngày Xuất"), ("HD-1", "01/02"), ("HD-2", "02/02"))) for c, s in enumerate(pair))]
    second = [cell(2, r, c, s) for r, pair in enumerate((("HD-3", "03/02"), ("HD-4", "04/02"))) for c, s in enumerate(pair)]
    words = spark.createDataFrame(typed("d", 1, 0, first) + typed("d", 2, 1000, second), "doc_id string, page int, word_id int, text string, x0 double, x1 double, top double, bottom double, size double")
    rules = spark.createDataFrame(rulings, "doc_id string, page int, x0 double, top double, x1 double, bottom double")
    pages = spark.createDataFrame([page("d", 1), page("d", 2)], "doc_id string, page int, width double, height double, rotation int")
    got = [x for _, x in sorted(lines(D.flatten_pages(words, rules, pages)).items())]
    assert got[0] == ["1.2 Bảng 1: Biểu phí", "", "  1.2.1 Tên gọi: Vay  |  Phí: 5", "", "  1.2.2 Tên gọi: Trả  |  Phí: 7"]
    assert got[1] == ["1.1.1 Mã HĐ: HD-1  |  Ngày Xuất: 01/02", "", "1.1.2 Mã HĐ: HD-2  |  Ngày Xuất: 02/02"]
    assert got[2] == ["  1.1.3 Mã HĐ: HD-3  |  Ngày Xuất: 03/02", "", "  1.1.4 Mã HĐ: HD-4  |  Ngày Xuất: 04/02"]
    cells, _ = D.page_cells(words, rules)
    assert D.check_lines(D.text_of_cells(cells), D.flatten_pages(words, rules, pages)).first()["passed"]


WORDS = "doc_id string, page int, word_id int, text string, x0 double, x1 double, top double, bottom double, size double"
RULES = "doc_id string, page int, x0 double, top double, x1 double, bottom double"
PAGES = "doc_id string, page int, width double, height double, rotation int"


def test_headers_go_over_four_pages_and_captions_are_read_whole(spark):
    rulings, put = [], []
    for n in range(1, 5):
        y = 640.0 if n == 1 else 60.0
        rulings += ruled("d", n, 50.0, y, 7 if n < 4 else 3, 3) if n == 1 else ruled("d", n, 50.0, y, 34 if n < 4 else 3, 3)
        rows_ = [("Họ tên", "Vai trò", "Nơi ở")] if n == 1 else []
        rows_ += [(f"Minh {n}{k:02d}", "Trưởng nhóm", f"Huế {k}") for k in range((7 if n == 1 else 34 if n < 4 else 3) - len(rows_))]
        put += typed("d", n, 10_000 * n, [(55.0 + 100 * c, y + 5 + 20 * r, s) for r, cells in enumerate(rows_) for c, s in enumerate(cells)])
    put += typed("d", 1, 1, [(50.0, 610.0, "Danh sách này kể ra những người đã được nhận vào làm việc ở công ty trong"), (50.0, 624.0, "năm vừa qua và nơi ở của từng người như dưới đây:")])
    got = [x for _, x in sorted(lines(D.flatten_pages(spark.createDataFrame(put, WORDS), spark.createDataFrame(rulings, RULES), spark.createDataFrame([page("d", n) for n in range(1, 5)], PAGES))).items())]
    assert len(got) == 4
    assert got[0][0] == "1 Danh sách này kể ra những người đã được nhận vào làm việc ở công ty trong năm vừa qua và nơi ở của từng người như dưới đây"
    assert [x for part in got[1:] for x in part if "(tiếp theo)" in x] == [got[0][0] + " (tiếp theo)"] * 3
    made = [x for part in got for x in part if x and "(tiếp theo)" not in x][1:]
    assert len(made) == 6 + 34 + 34 + 3
    assert all(f" Họ tên: Minh " in x and "  |  Vai trò: Trưởng nhóm  |  Nơi ở: Huế " in x for x in made)
    assert [x.split()[0] for x in made] == [f"1.{k}" for k in range(1, 78)]


def test_rules_that_are_not_drawn_make_no_table(spark):
    cell = lambda r, c, s: (55.0 + 100 * c, 105.0 + 20 * r, s)
    words = spark.createDataFrame(typed("d", 1, 0, [cell(0, 0, "Tên gọi"), cell(0, 1, "Phí"), cell(1, 0, "Vay"), cell(1, 1, "5")]), WORDS)
    box = ruled("d", 1, 50.0, 100.0, 2, 2)
    for fill, stroke, tables in (([1.0], False, 0), (None, False, 0), ([0.5], False, 1), ([1.0], True, 1), (None, None, 1)):
        shapes = spark.createDataFrame([(*b, fill, stroke) for b in box], RULES + ", fill array<double>, stroke boolean")
        assert D.residual_tables(shapes).count() == tables
    hidden = spark.createDataFrame([(*b, [1.0], False) for b in box], RULES + ", fill array<double>, stroke boolean")
    assert not lines(D.flatten_pages(words, hidden, spark.createDataFrame([page("d", 1)], PAGES)))


def test_level_rules_belong_to_columns_without_others(spark):
    put = [(50.0 + 150 * c, 116.0 + 14 * r, s) for r, row_ in enumerate((("Sản phẩm", "Kỳ hạn", "Mức"), ("Vay vốn", "một năm", "5%"), ("Tiết kiệm", "hai năm", "6%"))) for c, s in enumerate(row_)]
    words = spark.createDataFrame(typed("d", 1, 0, put), WORDS)
    rules = spark.createDataFrame([("d", 1, 40.0, 114.0, 460.0, 114.5), ("d", 1, 40.0, 127.0, 460.0, 127.5), ("d", 1, 40.0, 160.0, 90.0, 160.5), ("d", 1, 40.0, 300.0, 460.0, 300.5)], RULES)
    _, tables = D.page_cells(words, rules)
    t = tables.first()
    assert (t["x0"], t["x1"], t["top"]) == (39.0, 461.0, 115.0) and t["bottom"] < 160 and len(t["ys"]) == 4
    parted = D.G.absorbed_rules(tables, spark.createDataFrame([("d", 1, 40.0, 120.0, 460.0, 120.5), ("d", 1, 40.0, 121.0, 460.0, 121.5), ("d", 1, 40.0, 300.0, 460.0, 300.5)], RULES)).first()
    assert len(parted["ys"]) == 5 and 120.25 in parted["ys"]
    got = list(lines(D.flatten_pages(words, rules, spark.createDataFrame([page("d", 1)], PAGES))).values())
    assert got == [["1.1 Sản phẩm: Vay vốn  |  Kỳ hạn: một năm  |  Mức: 5%", "", "1.2 Sản phẩm: Tiết kiệm  |  Kỳ hạn: hai năm  |  Mức: 6%"]]


def test_files_made_of_files_are_checked_for_words_and_tables(spark):
    body = p("trước") + tbl([tc("Tên gọi"), tc("Phí")], [tc("Nam"), tc("7")]) + p("sau")
    d = docs(spark, word(body))
    made = sinks.flattened_word_files(d, D.flatten_word_files(d))
    assert D.check_word_files(d, made).first()["passed"]
    untouched = D.check_word_files(d, d).first()
    assert untouched["residual_tables"] == 1 and not untouched["passed"]
    shorter = D.check_word_files(d, sinks.flattened_word_files(d, D.flatten_word_files(d).withColumn("line", F.regexp_replace("line", "Nam", "")))).first()
    assert shorter["missing_tokens"] == ["nam"] and not shorter["passed"]


def test_sql_functions(spark):
    register(spark)
    assert spark.sql("SELECT tokenize_text('Một, hai'), row_name('1  |  Tên: Nam'), split_items('x: a) m b) n'), bare_text('  - y')").first()[:] == (["một", "hai"], "Nam", ["x:", "a) m", "b) n"], "y")
    spark.createDataFrame([("Tên gọi", "Phí"), ("Vay", "5")], "a string, b string").coalesce(1).createOrReplaceTempView("sheet_rows")
    assert [r["line"] for r in spark.sql("SELECT line FROM flatten_table(TABLE(sheet_rows) WITH SINGLE PARTITION) ORDER BY k").collect()] == ["- Tên gọi: Vay  |  Phí: 5"]


def test_tables_are_replaced_in_place(spark):
    inner = tbl([tc("K"), tc("V")], [tc("x"), tc("y")])
    body = p("trước") + tbl([tc("Tên gọi"), tc("Phí")], [tc("Nam"), tc(inner)]) + p("sau")
    header = '<w:hdr xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main">' + tbl([tc("H1"), tc("H2")], [tc("a"), tc("b")]) + "</w:hdr>"
    d = docs(spark, word(body, header1=header))
    made = sinks.flattened_word_files(d, D.flatten_word_files(d)).cache()
    assert office.word_cells(made).count() == 0
    texts = [r["text"] for r in office.word_paragraphs(made).where("story = 'document'").orderBy("seq").collect()]
    assert texts[0] == "trước" and texts[-1] == "sau" and texts[1].startswith("1.1 Tên gọi: Nam  |  Phí:")
    assert office.word_paragraphs(made).where("story = 'header1'").count() >= 1


def test_styles_through_others(spark):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    styles = f'<w:styles {ns}><w:style w:styleId="Heading1"/><w:style w:styleId="Mine"><w:basedOn w:val="Heading1"/></w:style><w:style w:styleId="A"><w:basedOn w:val="B"/></w:style><w:style w:styleId="B"><w:basedOn w:val="A"/><w:pPr><w:numPr><w:numId w:val="4"/></w:numPr></w:pPr></w:style></w:styles>'
    d = docs(spark, word(p("Chương", '<w:pStyle w:val="Mine"/>') + tbl([tc("Tên"), tc("Tuổi")], [tc("Nam"), tc("25")]), styles=styles))
    assert {r["style_id"]: (r["outline_lvl"], r["num_id"]) for r in office.word_styles(d).collect()} == {"Heading1": (0, None), "Mine": (0, None), "A": (None, "4"), "B": (None, "4")}
    assert lines(D.flatten_word_files(d))["d0", "document/0000"] == ["1.1 Tên: Nam  |  Tuổi: 25"]


def test_typography(spark):
    chars = spark.createDataFrame([("b", 0, "Times", 14.0), ("b", 1, "Arial", 9.0), ("b", 2, "Arial", 14.0), ("b", 3, "Times", 9.0)], "box_id string, pos int, font string, size double")
    assert layout.typography(chars).first()[:] == ("b", "Times", 12.0, True)


def test_table_in_a_cell(spark):
    rulings = ruled("d", 1, 50.0, 100.0, 2, 2, w=200.0, h=80.0) + ruled("d", 1, 270.0, 195.0, 2, 2, w=70.0, h=20.0)
    put = [(60.0, 110.0, "Tên gọi"), (260.0, 110.0, "Nội dung"), (60.0, 190.0, "Vay vốn"), (275.0, 200.0, "Kỳ hạn"), (345.0, 200.0, "Lãi suất"), (275.0, 220.0, "một năm"), (345.0, 220.0, "5%")]
    words = spark.createDataFrame(typed("d", 1, 0, put), "doc_id string, page int, word_id int, text string, x0 double, x1 double, top double, bottom double, size double")
    rules = spark.createDataFrame(rulings, "doc_id string, page int, x0 double, top double, x1 double, bottom double")
    cells, tables = D.page_cells(words, rules)
    assert tables.count() == 1
    got = lines(D.flatten_pages(words, rules, spark.createDataFrame([page("d", 1)], "doc_id string, page int, width double, height double, rotation int")))
    flat = next(iter(got.values()))
    assert flat[0].startswith("1.1 Tên gọi: Vay vốn  |  Nội dung: ") and "Kỳ hạn: một năm  |  Lãi suất: 5%" in "\n".join(flat)


def test_columns_without_rules(spark):
    put = [(50.0, 50.0, "1. Quy định"), (50.0, 100.0, "Bảng 2: Lãi suất")]
    for r, row_ in enumerate((("Sản phẩm", "Kỳ hạn", "Mức"), ("Vay vốn", "một năm", "5%"), ("Tiết kiệm", "hai năm", "6%"))):
        put += [(50.0 + 150 * c, 116.0 + 14 * r, s) for c, s in enumerate(row_)]
    put += [(50.0, 300.0, "Đây là một đoạn văn dài không có cột nào cả ở trong nó"), (50.0, 314.0, "và nó đi tiếp qua dòng thứ hai như mọi đoạn văn khác mà thôi")]
    words = spark.createDataFrame(typed("d", 1, 0, put), "doc_id string, page int, word_id int, text string, x0 double, x1 double, top double, bottom double, size double")
    rules = spark.createDataFrame([], "doc_id string, page int, x0 double, top double, x1 double, bottom double")
    pages = spark.createDataFrame([page("d", 1)], "doc_id string, page int, width double, height double, rotation int")
    got = list(lines(D.flatten_pages(words, rules, pages)).values())
    assert got == [["1.1 Sản phẩm: Vay vốn  |  Kỳ hạn: một năm  |  Mức: 5%", "", "1.2 Sản phẩm: Tiết kiệm  |  Kỳ hạn: hai năm  |  Mức: 6%"]]
