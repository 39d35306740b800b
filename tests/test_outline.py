"""Numbers of tables and of their lines."""

from gridscribe.operators.outline import REPEAT_WORDS, accepted_headings, entered_levels, list_numbers, number_documents, number_lines, section_asof, table_numbers


def test_rows_are_numbered_and_parted():
    out, rows, context = number_lines(["- Tên: Nam", "- Tên: Lan"], (1, 1))
    assert out == ["1.1.1 Tên: Nam", "", "1.1.2 Tên: Lan"] and rows == 2 and context == "Lan"


def test_caption_with_unsaid_headers():
    out, *_ = number_lines(["1  |  Hồ sơ: Đơn", "2  |  Hồ sơ: Sao kê"], (1, 4), title="Biểu phí", headers=["STT", "Hồ sơ"])
    assert out == ["1.4 Biểu phí  |  STT", "", "  1.4.1 Hồ sơ: Đơn", "", "  1.4.2 Hồ sơ: Sao kê"]


def test_headers_are_the_caption_of_a_table_without_a_name():
    assert number_lines(["1  |  Hồ sơ: Đơn"], (2,), headers=["STT", "Hồ sơ"])[0][0] == "2 STT  |  Hồ sơ"


def test_counter_that_disagrees_stays():
    assert number_lines(["8  |  x y"], (1,), headers=["STT", "A"])[0][-1] == "  1.1 8  |  x y"


def test_divider_and_tail():
    out, rows, _ = number_lines(["- I. Nhóm đầu", "1  |  a: b", "- phần còn lại", "2  |  c: d", "- II. Nhóm sau", "1  |  e: f"], (1,), headers=["STT", "a"])
    assert out == ["1 STT  |  a", "", "  I. Nhóm đầu", "", "  1.1 a: b", "    - phần còn lại", "", "  1.2 c: d", "", "  II. Nhóm sau", "", "  1.3 1  |  e: f"]
    assert rows == 3


def test_deep_tables_have_no_row_numbers():
    assert number_lines(["- a", "- b"], (1, 2, 3))[0] == ["a", "", "b"]


def test_long_record_says_its_name_again():
    words = " ".join(["từ"] * (REPEAT_WORDS + 1))
    out, *_ = number_lines(["- Mục: Vay vốn  |  Hồ sơ:", f"  - {words}", "  - kế tiếp", "  - nữa"], (1,))
    assert out[1] == f"    - {words}".replace("    ", "  ", 1) and out[2] == "  - Vay vốn  |  kế tiếp" and out[3] == "  - nữa"


def test_continuation_goes_on(spark):
    rows = [("d", "t1", 0, ["- a: x", "- a: y"], [1, 2], "Tên bảng", ["a"], False), ("d", "t2", 1, ["- a: z"], [9], "", ["a"], True), ("e", "t1", 0, ["- q"], [1], "", [], False)]
    df = spark.createDataFrame(rows, "doc_id string, table_id string, seq int, lines array<string>, path array<int>, title string, headers array<string>, continued boolean")
    got = {}
    for r in number_documents(df).orderBy("doc_id", "table_id", "seq").collect():
        got.setdefault((r["doc_id"], r["table_id"]), []).append(r["line"])
    assert got["d", "t2"] == ["1.2 Tên bảng (tiếp theo)", "", "  1.2.3 a: z"] and got["e", "t1"] == ["1.1 q"]


def test_sections_and_free_numbers(spark):
    heads = spark.createDataFrame([("d", 1, 10.0, [1]), ("d", 1, 50.0, [1, 1]), ("d", 2, 5.0, [1, 2]), ("d", 3, 1.0, [3, 5])], "doc_id string, page int, top double, path array<int>")
    tables = spark.createDataFrame([("d", 1, 5.0, "a"), ("d", 1, 20.0, "b"), ("d", 1, 50.0, "c"), ("d", 2, 9.0, "e"), ("d", 3, 2.0, "f")], "doc_id string, page int, top double, table_id string")
    placed = section_asof(tables, heads)
    assert {r["table_id"]: r["section"] for r in placed.collect()} == {"a": None, "b": [1], "c": [1], "e": [1, 2], "f": [3, 5]}
    got = {r["table_id"]: r["path"] for r in table_numbers(placed, heads, ["page", "top"]).collect()}
    assert got == {"a": [2], "b": [1, 3], "c": [1, 4], "e": [1, 2], "f": [3, 5]}


def test_headings_that_go_on(spark):
    rows = [("d", 1, 1.0, "1. Một", True), ("d", 1, 2.0, "1.1 Hai", False), ("d", 1, 3.0, "7.3 triệu đồng", False), ("d", 1, 4.0, "1.2 Ba", False), ("d", 1, 5.0, "2. Bốn .......... 9", True)]
    df = spark.createDataFrame(rows, "doc_id string, page int, top double, text string, starts_paragraph boolean")
    assert [r["path"] for r in accepted_headings(df).orderBy("top").collect()] == [[1], [1, 1], [1, 2]]


def test_list_counters(spark):
    seq = [("1", 0), ("1", 1), ("1", 1), ("1", 0), ("1", 1), (None, None), ("0", 0), ("2", 0), ("3", 0), ("1", 0), ("2", 0)]
    paragraphs = spark.createDataFrame([("d", k, n, level) for k, (n, level) in enumerate(seq)], "doc_id string, seq int, num_id string, ilvl int")
    levels = spark.createDataFrame(
        [("d", "1", "a", 0, 1, "decimal", None), ("d", "1", "a", 1, 1, "decimal", None), ("d", "2", "a", 0, 1, "decimal", 5), ("d", "3", "b", 0, 1, "bullet", None)],
        "doc_id string, num_id string, abstract_id string, ilvl int, start int, fmt string, override int",
    )
    got = [r["list_path"] for r in list_numbers(paragraphs, levels).orderBy("seq").collect()]
    assert got == [[1], [1, 1], [1, 2], [2], [2, 1], None, None, [5], None, [6], [7]]


def test_ranks_take_free_numbers(spark):
    rows = [("d", 0, 0, None), ("d", 1, 1, None), ("d", 2, 1, [1, 2]), ("d", 3, 1, None), ("d", 4, 0, None), ("d", 5, 2, None)]
    got = [r["path"] for r in entered_levels(spark.createDataFrame(rows, "doc_id string, seq int, rank int, path array<int>")).orderBy("seq").collect()]
    assert got == [[2], [2, 1], [1, 2], [1, 3], [3], [3, 1, 1]]
