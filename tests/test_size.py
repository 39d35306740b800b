"""Steps whose work must grow no faster than their input: large groups, many small ones, no pairs and no copies of a group in each row."""

import random
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gridscribe.functions import lines as L
from gridscribe.functions import text as T
from gridscribe.groups import whole_groups
from gridscribe.operators import geometry as G
from gridscribe.operators import layout, outline, verify
from gridscribe.operators.grid import Cell, Grid, Line, flatten_grid
from gridscribe.sources import sinks


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_groups_are_cut_across_batches():
    keys = ["a", "a", None, None, None, "b", "c", "c", "c", "c"]
    rows = pa.table({"k": pa.array(keys), "v": list(range(10))})
    for size in (1, 2, 3, 7, 10):
        found = [(r.column("k")[x].as_py(), r.column("v").to_pylist()[x:y]) for r, cuts in whole_groups(iter(rows.to_batches(max_chunksize=size)), ["k"]) for x, y in zip(cuts, cuts[1:], strict=False)]
        assert found == [("a", [0, 1]), (None, [2, 3, 4]), ("b", [5]), ("c", [6, 7, 8, 9])]


def test_a_long_table_takes_time_by_its_rows():
    made = lambda r, c, t: Cell(r, c, 1, 1, (c * 120.0, r * 52.0, c * 120.0 + 108, r * 52.0 + 40), (Line(t, c * 120.0, c * 120.0 + 1, r * 52.0, r * 52.0 + 10),))
    n = 20_000
    cells = [made(0, 0, "Size"), made(0, 1, "Name")] + [made(k, c, t) for k in range(1, n) for c, t in enumerate((f"no {k % 50}", "hot bolt"))]
    began = time.monotonic()
    out, headers, structure = flatten_grid(Grid(n, 2, cells))
    assert time.monotonic() - began < 30
    assert structure == (1, False) and headers == ["Size", "Name"]
    assert out == [f"- Size: no {k % 50}  |  Name: hot bolt" for k in range(1, n)]


def test_words_inside_the_stream_are_found_alike_by_few_and_by_many():
    rng = random.Random(1)
    parts = ["".join(rng.choices("abc", k=5)) for _ in range(60)]
    wanted = {"".join(rng.choices("abcd", k=rng.randint(1, 6))) for _ in range(200)}
    assert L.within(wanted, parts, few=0) == L.within(wanted, parts, few=1000) == {w for w in wanted if w in "".join(parts)}


def test_page_medians_are_not_lists_in_each_row(spark):
    rows = [("d", 1, float(t), float(t + 9), 50.0, 100.0) for t in (0, 10, 20, 60, 71, 200)]
    lines = spark.createDataFrame(rows, "doc_id string, page int, top double, bottom double, x0 double, x1 double")
    runs, starts = G.vertical_runs(lines), G.paragraph_starts(lines)
    assert "collect_list" not in plan(runs) + plan(starts)
    assert [r["run"] for r in runs.orderBy("top").collect()] == [0, 0, 0, 1, 1, 2]
    assert [r["starts_paragraph"] for r in starts.orderBy("top").collect()] == [True, False, False, True, False, True]


def test_nearest_cells_by_blocks_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(3)
    boxes = np.round(rng.uniform(0, 900, (700, 2)))
    boxes = np.hstack([boxes, boxes + np.round(rng.uniform(1, 40, (700, 2)))])
    boxes[500:600] = boxes[:100]
    points = np.round(rng.uniform(-50, 1050, (1500, 2)))
    of, d, inside = G._nearest(points, boxes)
    x, y = points[:, :1], points[:, 1:]
    far = np.sqrt(np.maximum(np.maximum(boxes[:, 0] - x, 0), x - boxes[:, 2]) ** 2 + np.maximum(np.maximum(boxes[:, 1] - y, 0), y - boxes[:, 3]) ** 2)
    has = (x >= boxes[:, 0] - 0.5) & (x <= boxes[:, 2] + 0.5) & (y >= boxes[:, 1] - 0.5) & (y <= boxes[:, 3] + 0.5)
    assert (inside == has.any(axis=1)).all()
    assert (of == np.where(inside, has.argmax(axis=1), far.argmin(axis=1))).all()
    assert np.array_equal(d, np.where(inside, 0, far.min(axis=1)))
    word = spark.createDataFrame([("d", 1, 7, 5.0, 6.0, 5.0, 6.0), ("d", 2, 8, 5.0, 6.0, 5.0, 6.0)], "doc_id string, page int, word_id int, x0 double, x1 double, top double, bottom double")
    cell = spark.createDataFrame([("d", 1, 2, 0.0, 1.0, 0.0, 1.0), ("d", 1, 1, 0.0, 1.0, 0.0, 1.0)], "doc_id string, page int, cell_id int, x0 double, x1 double, top double, bottom double")
    found = G.assign_words(word, cell, ["doc_id", "page"])
    assert "Join" not in plan(found) and [r[:] for r in found.collect()] == [("d", 1, 7, 1)]


def test_room_below_is_found_without_pairs(spark):
    rng = random.Random(5)
    tables = [("d", rng.randint(1, 2), str(k), float(x := rng.randint(0, 500)), float(y := rng.randint(0, 700)), x + 50.0, y + 40.0) for k in range(60)]
    things = [("d", rng.randint(1, 2), float(x := rng.randint(0, 500)), float(rng.randint(0, 900)), x + 9.0) for _ in range(90)]
    found = layout._first_below(spark.createDataFrame(tables, "doc_id string, page int, table_id string, x0 double, top double, x1 double, bottom double"), spark.createDataFrame(things, "doc_id string, page int, x0 double, top double, x1 double"))
    assert "Join" not in plan(found)
    want = {t[2]: min((o[3] for o in things if o[1] == t[1] and o[3] >= t[6] and o[2] < t[5] and o[4] > t[3]), default=None) for t in tables}
    assert {r["table_id"]: r["otop"] for r in found.collect()} == want


def test_outermost_of_many_boxes(spark):
    rng = random.Random(7)
    boxes = [(str(k), float(x := rng.randint(0, 40)), float(y := rng.randint(0, 40)), x + float(rng.randint(0, 30)), y + float(rng.randint(1, 30))) for k in range(400)]
    found = G.outermost(spark.createDataFrame([("d", 1, *b) for b in boxes], "doc_id string, page int, table_id string, x0 double, top double, x1 double, bottom double"))
    kept, want = [], {}
    size = lambda b: (b[3] - b[1]) * (b[4] - b[2])
    for b in sorted(boxes, key=lambda b: (-size(b), b[0])):
        over = [k for k in kept if max(0, min(b[3], k[3]) - max(b[1], k[1])) * max(0, min(b[4], k[4]) - max(b[2], k[2])) >= 0.8 * size(b)]
        want[b[0]] = over[0][0] if over else None
        kept += [] if over else [b]
    assert {r["table_id"]: r["parent"] for r in found.collect()} == want
    assert "aggregate(" not in plan(found)


def test_long_texts_take_time_by_their_lines(spark):
    n = 30_000
    lines = spark.range(1).select(F.concat(F.array_repeat(F.lit("x "), n), F.array(F.lit(""), F.lit(" "), F.lit("y"), F.lit(""))).alias("l"))
    began = time.monotonic()
    at, kept = lines.select(verify.first_double_blank(F.col("l")), F.size(T.collapse_blank(F.col("l")))).first()
    assert time.monotonic() - began < 30
    assert (at, kept) == (n, n + 2)
    odd = spark.createDataFrame([(["a"],), ([],), (None,), (["", None, "", ""],)], "l array<string>")
    assert [r[0] for r in odd.select(verify.first_double_blank(F.col("l"))).collect()] == [None, None, None, 2]


def test_wrapped_lines_with_the_mark_are_joined_by_the_same_rule(spark):
    cases = [["thự", "c hiện", "x"], ["thự", "c\x01 hiện", "x"], ["a\xa0", " \t", "b c", "d"], ["12", "c"], ["ă", "ng", "ng2", "ng"], [], None]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, l array<string>")
    got = [r[0] for r in df.orderBy("k").select(T.join_wrapped(F.col("l"))).collect()]
    assert got == [None if c is None else L.joined([x.replace("\xa0", "") for x in c]) for c in cases]


def test_tokens_are_counted_where_their_document_is(spark):
    docs = spark.createDataFrame([("a", "x y y"), ("a", "x"), ("b", "z")], "doc_id string, text string")
    lost = verify.lost_tokens(docs, spark.createDataFrame([("a", "x y"), ("c", "z")], "doc_id string, text string"))
    assert "hashpartitioning(doc_id" in plan(lost) and ", token" not in "".join(x for x in plan(lost).splitlines() if "hashpartitioning" in x)
    assert sorted(r[:] for r in lost.collect()) == [("a", "x", 1), ("a", "y", 1), ("b", "z", 1)]


def test_small_rows_are_dealt_and_groups_streamed(spark):
    files = sinks.word_files(spark.range(3).select(F.col("id").alias("doc_id"), F.array(F.lit("x")).alias("lines")).coalesce(1))
    assert files.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    tables = spark.createDataFrame([("d", "t", 0, ["- K: v"], [1], "", ["K"], False)], "doc_id string, table_id string, seq int, lines array<string>, path array<int>, title string, headers array<string>, continued boolean")
    numbered = outline.number_documents(tables)
    assert "FlatMapGroups" not in plan(numbered) and [r["line"] for r in numbered.collect()] == ["1.1 K: v"]


def test_wrapped_is_arrow_text_by_text(spark):
    df = spark.createDataFrame([(1, ["aa bb cc"]), (2, None), (3, [])], "k int, l array<string>")
    got = [r[0] for r in df.orderBy("k").select(layout.wrapped(F.col("l"), F.lit(5.0))).collect()]
    assert [x if x is None else [tuple(y) for y in x] for x in got] == [[("aa bb", 0), ("cc", 0)], None, []]
