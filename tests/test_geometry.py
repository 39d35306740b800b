"""Positioned words and rules."""

import pytest
from pyspark.sql import functions as F

from gridscribe.operators import geometry as G
from gridscribe.operators import layout, verify

BOX = "doc_id string, page int, table_id string, x0 double, top double, x1 double, bottom double"


def words(spark, rows):
    return spark.createDataFrame([("d", 1, k, t, float(a), float(b), float(top), float(top + size), float(size)) for k, (t, a, b, top, size) in enumerate(rows)], "doc_id string, page int, word_id int, text string, x0 double, x1 double, top double, bottom double, size double")


@pytest.mark.parametrize(
    ("rows", "line"),
    [([("Mục", 126.45, 149.78, 10, 12), ("đích", 152.43, 173.84, 10, 12)], "Mục đích"), ([("Phương", 126.45, 164.72, 10, 12), ("thức", 166.17, 188.77, 10, 12)], "Phương thức"), ([("-", 100, 104.3, 10, 13), ("3%", 104.3, 120, 10, 12)], "-3%")],
)
def test_blanks_between_words(spark, rows, line):
    assert [r["text"] for r in G.group_lines(words(spark, rows), ["doc_id", "page"]).collect()] == [line]


def test_lines_compare_with_their_first_word(spark):
    rows = [("a", 0, 5, 10, 10), ("b", 20, 25, 15, 10), ("c", 40, 45, 20, 10), ("d", 0, 5, 40, 10)]
    got = G.group_lines(words(spark, rows), ["doc_id", "page"]).orderBy("line_no").collect()
    assert [r["text"] for r in got] == ["a b", "c", "d"]


def test_nested_tables_go_to_the_outermost(spark):
    rows = [("d", 1, "A", 0.0, 0.0, 100.0, 100.0), ("d", 1, "B", 10.0, 10.0, 60.0, 60.0), ("d", 1, "C", 20.0, 20.0, 40.0, 40.0), ("d", 1, "D", 90.0, 90.0, 140.0, 120.0)]
    got = {r["table_id"]: r["parent"] for r in G.outermost(spark.createDataFrame(rows, BOX)).collect()}
    assert got == {"A": None, "B": "A", "C": "A", "D": None}


def test_kept_and_nearest_edges(spark):
    df = spark.createDataFrame([([1.0, 2.0, 7.0, 7.5, 20.0],)], "e array<double>")
    assert df.select(G.kept_edges(F.col("e"), 4.0), G.nearest_edge(F.col("e"), F.lit(7.2))).first()[:] == ([1.0, 7.0, 20.0], 2)


def test_rules_to_cells_to_tables(spark):
    def box(doc, x, y, cols, rows, w=60.0, h=20.0):
        out = [(doc, 1, x, y + h * r, x + w * cols, y + h * r) for r in range(rows + 1)]
        return out + [(doc, 1, x + w * c + 0.4, y, x + w * c + 0.4, y + h * rows) for c in range(cols + 1)]

    rules = spark.createDataFrame(box("d", 50.0, 50.0, 3, 2) + box("d", 50.0, 200.0, 2, 2) + box("e", 10.0, 10.0, 2, 1), "doc_id string, page int, x0 double, top double, x1 double, bottom double")
    cells = G.ruled_cells(rules)
    assert {r["doc_id"]: r["n"] for r in cells.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {"d": 10, "e": 2}
    tables = G.tables_of_cells(cells).groupBy("doc_id", "table_id").agg(F.count("*").alias("n")).collect()
    assert sorted((r["doc_id"], r["n"]) for r in tables) == [("d", 4), ("d", 6), ("e", 2)]


def test_borderless_columns(spark):
    rows = [(f"w{k}{c}", 20 + 100 * c, 60 + 100 * c, 20 * k, 10) for k in range(4) for c in range(3)]
    lined = words(spark, rows).withColumn("line_no", F.floor(F.col("top") / 20).cast("int"))
    bands = G.gutters(lined)
    assert bands.count() == 2
    found = G.borderless_tables(lined, bands).first()
    assert (found["n_cols"], found["n_lines"], found["full_ratio"]) == (3, 4, 1.0)


def test_words_in_and_out_of_tables(spark):
    w = words(spark, [("in", 10, 20, 10, 10), ("edge", 95, 125, 10, 10), ("far", 300, 310, 10, 10)])
    t = spark.createDataFrame([("d", 1, "t", 0.0, 0.0, 105.0, 50.0)], BOX)
    assert {r["w_word_id"] for r in G.words_in_tables(w, t).collect()} == {0, 1}
    assert {r["text"] for r in G.words_outside(w, t).collect()} == {"edge", "far"}


def test_title_and_paragraphs(spark):
    lines = spark.createDataFrame([("d", 1, "Bảng 1: Phí", 10.0, 100.0, 50.0, 60.0), ("d", 1, "xa", 10.0, 300.0, 5.0, 15.0)], "doc_id string, page int, text string, x0 double, x1 double, top double, bottom double")
    t = spark.createDataFrame([("d", 1, "t", 0.0, 70.0, 105.0, 150.0), ("d", 1, "u", 0.0, 500.0, 105.0, 600.0)], BOX)
    assert {r["table_id"]: r["title_line"] for r in G.title_above(t, G.paragraph_starts(lines)).collect()} == {"t": "Bảng 1: Phí", "u": None}
    more = lines.union(spark.createDataFrame([("d", 1, "một đoạn dài đến lề", 10.0, 300.0, 38.0, 48.0)], lines.schema))
    assert {r["table_id"]: r["title_text"] for r in G.title_above(t, G.paragraph_starts(more)).collect()} == {"t": "xa một đoạn dài đến lề Bảng 1: Phí", "u": None}


def test_wrap():
    assert layout.wrap(["- one two three"], 9) == [("- one two", 0), ("  three", 0)]
    assert layout.wrap(["abcdefghij kl"], 4) == [("abcd", 0), ("efgh", 0), ("ij", 0), ("kl", 0)]
    assert layout.wrap(["", "a"], 5) == [("", 0), ("a", 1)]
    for width in range(3, 30):
        for text, _ in layout.wrap(["  - a longer line with words", "x" * 70], width):
            assert len(text) <= width


def test_plan_and_room(spark):
    plan = layout.fit_plan(spark.createDataFrame([("a", 40.0, 9.5, 3), ("a", 40.0, 6.5, 2), ("b", 20.0, 9.5, 9), ("b", 20.0, 6.5, 7)], "box_id string, height double, size double, n_lines long"))
    assert {r["box_id"]: (r["size"], r["shown"]) for r in plan.collect()} == {"a": (9.5, 3), "b": (6.5, 2)}
    t = spark.createDataFrame([("d", 1, "t", 0.0, 0.0, 100.0, 50.0)], BOX)
    o = spark.createDataFrame([("d", 1, 10.0, 200.0, 50.0, 210.0), ("d", 1, 150.0, 80.0, 160.0, 90.0)], "doc_id string, page int, x0 double, top double, x1 double, bottom double")
    pages = spark.createDataFrame([("d", 1, 800.0)], "doc_id string, page int, height double")
    assert layout.free_bottom(t, o, pages).first()["free_bottom"] == 194.0


def test_report_has_teeth(spark):
    source = spark.createDataFrame([("a", "one two two"), ("b", "one two"), ("c", "x")], "doc_id string, text string")
    output = spark.createDataFrame([("a", "one two"), ("b", "onetwo"), ("c", "x\n\n\n- Column 1: ​")], "doc_id string, text string")
    lossy = {r["doc_id"]: r for r in verify.report(source, output.withColumn("text", F.when(F.col("doc_id") == "a", "one").otherwise(F.col("text")))).collect()}
    assert lossy["a"]["missing_tokens"] == ["two"] and lossy["b"]["passed"] and not lossy["c"]["passed"]
    assert (lossy["c"]["fake_labels"], lossy["c"]["stray_characters"], lossy["c"]["double_blanks"]) == (["column"], ["​"], 1)
    assert all(r["passed"] for r in verify.report(source, source).collect())
    assert {r["description"] for r in verify.describe(verify.report(source, source)).collect()} == {"passed"}


def test_caption_is_trimmed_off(spark):
    rows = [("caption", 20, 260, 0, 10)] + [(f"w{k}{c}", 20 + 100 * c, 60 + 100 * c, 20 * k, 10) for k in range(1, 5) for c in range(3)]
    lined = words(spark, rows).withColumns({"line_no": F.floor(F.col("top") / 20).cast("int"), "run": F.lit(0)})
    best = G.best_trims(lined).first()
    assert (best["head"], best["tail"], best["n_cols"], best["n_lines"]) == (1, 0, 3, 4)


def test_lists_and_contents_are_no_tables(spark):
    rows = [(t, 20 + 100 * c, 60 + 100 * c, 20 * k, 10) for k in range(4) for c, t in enumerate(("-", "item", "more"))]
    lined = words(spark, rows).withColumn("line_no", F.floor(F.col("top") / 20).cast("int"))
    assert G.borderless_tables(lined, G.gutters(lined)).count() == 0
    rows = [(t, 20 + 100 * c, 60 + 100 * c, 20 * k, 10) for k in range(4) for c, t in enumerate(("part", ".....", "7"))]
    lined = words(spark, rows).withColumn("line_no", F.floor(F.col("top") / 20).cast("int"))
    assert G.borderless_tables(lined, G.gutters(lined)).count() == 0
