"""Queries of single rules: text, outline, geometry, layout, checks and windows, each with the SQL that states it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridscribe.functions import display as D
from gridscribe.functions import text as T
from gridscribe.operators import geometry as G
from gridscribe.operators import layout, outline, sheets, verify
from gridscribe.plans.registry import query, table
from gridscribe.sources import office
from gridscribe.streaming import flatten as stream

# --- text ------------------------------------------------------------------------------------------------------------------

_MARKS = "- x|• x|o clock|* y|+z|-z|  · w|1. a|(a) b|6.1 c|1.500.000 d|a) e|03 months|b. f|12) g|1.000 h"
_BULLET = r"^\s*([-‐-―•●○▪·+*o])\s+"


@query(
    rf"""SELECT doc_id, sha256(line) AS line, regexp_matches(line, '{_BULLET}') AS bullet, regexp_extract(line, '{_BULLET}', 1) AS marker,
      sha256(regexp_replace(regexp_replace(line, '{_BULLET}', ''), '^[\t-\r\x20\x{{A0}}]+|[\t-\r\x20\x{{A0}}]+$', '', 'g')) AS bare,
      regexp_matches(line, '^(?:\(\s*[0-9a-zA-Z]{{1,3}}\s*\)|[0-9]{{1,3}}(?:\.[1-9][0-9]?)+\s*[.)]?|[0-9]{{1,3}}\s*[.)]|[a-zA-Z]\s*[.)])(?:\s|$)') AS has_index
    FROM (SELECT doc_id, (string_split('{_MARKS}', '|'))[doc_id % 16 + 1] || ' ' || coalesce(text, '') AS line FROM documents)"""
)
def line_markers(spark, sf_dir):
    """Whole texts behind marks of all kinds: which open a list item, with what, what is left, and which count themselves."""
    heads = F.split(F.lit(_MARKS), r"\|")
    line = F.concat(F.element_at(heads, (F.col("doc_id") % 16 + 1).cast("int")), F.lit(" "), F.coalesce("text", F.lit("")))
    hashed = lambda c: F.sha2(c.cast("binary"), 256)
    c = F.col("line")
    return table(spark, sf_dir, "documents").select("doc_id", line.alias("line")).select("doc_id", hashed(c).alias("line"), T.is_bullet(c).alias("bullet"), T.bullet_marker(c).alias("marker"), hashed(T.strip_bullet(c)).alias("bare"), T.starts_with_index(c).alias("has_index"))


@query(
    r"""WITH l AS (SELECT doc_id, list_transform(string_split(replace(text, chr(10), repeat(chr(10), 3)), chr(10)), lambda x: regexp_replace(x, '[\t-\r\x20]+$', '')) AS l FROM documents),
    k AS (SELECT doc_id, list_filter(l, lambda x, i: x <> '' OR (i > 1 AND l[i - 1] <> '')) AS k FROM l),
    t AS (SELECT doc_id, CASE WHEN len(k) > 0 AND k[len(k)] = '' THEN k[1:len(k) - 1] ELSE k END AS k FROM k)
    SELECT doc_id, sha256(array_to_string(k, chr(10))) AS lines, len(list_filter(k, lambda x: x <> ''))::BIGINT AS kept FROM t"""
)
def collapse_blank_lines(spark, sf_dir):
    """Every text with three line breaks for each: one blank line between others, none first or last; a null text stays null."""
    docs = table(spark, sf_dir, "documents").withColumn("lines", T.collapse_blank(F.split(F.regexp_replace("text", "\n", "\n\n\n"), "\n")))
    return docs.select("doc_id", F.sha2(F.array_join("lines", "\n").cast("binary"), 256).alias("lines"), F.size(F.filter("lines", lambda x: x != "")).cast("long").alias("kept")).withColumn("kept", F.when(F.col("lines").isNotNull(), F.col("kept")))


@query(
    rf"""SELECT p_partkey, w AS token, (regexp_matches(w, '^\p{{Ll}}$') AND NOT regexp_matches(w, '^[{T.ONE_LETTER}]$')) OR (regexp_matches(w, '^\p{{Ll}}{{2}}$') AND NOT regexp_matches(w, '[{T.VOWELS}]')) AS fragment
    FROM (SELECT p_partkey, substr(p_name || p_type, (p_partkey % 7 + 1)::INT, (p_partkey % 3 + 1)::INT) AS w FROM part)"""
)
def word_fragments(spark, sf_dir):
    """Pieces of names: which can only be the end of a word that a line break cut."""
    piece = F.substring(F.concat("p_name", "p_type"), (F.col("p_partkey") % 7 + 1).cast("int"), (F.col("p_partkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", piece.alias("token")).withColumn("fragment", T.is_word_fragment(F.col("token")))


@query(
    rf"""WITH o AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '[\t-\r\x20{T.BLANKS}]+', ' ', 'g'), '^[\x20\x{{A0}}]+|[\x20\x{{A0}}]+$', '', 'g') AS l FROM documents),
    h AS (SELECT doc_id, l, left(l, 60) AS h FROM o), c AS (SELECT *, CASE WHEN contains(h, ' ') THEN regexp_extract(h, '^(.*) [^ ]*$', 1) ELSE h END AS c FROM h),
    b AS (SELECT *, regexp_replace(CASE WHEN c = '' THEN h ELSE c END, '[ ,;:/\-–—]+$', '') AS b FROM c)
    SELECT doc_id, CASE WHEN length(l) <= 60 THEN l WHEN b <> '' THEN b WHEN c <> '' THEN c ELSE h END AS short FROM b"""
)
def shorten(spark, sf_dir):
    """Every text as one line of sixty characters at most, cut at a blank, without marks that would dangle."""
    return table(spark, sf_dir, "documents").select("doc_id", T.shorten(F.col("text")).alias("short"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 4 WHEN 1 THEN 2 ELSE 0 END::INT AS hang FROM part""")
def hanging_indent(spark, sf_dir):
    """Where a wrapped line goes on: under the text behind the line's own indent and marker."""
    k = F.col("p_partkey") % 3
    line = F.concat(F.when(k == 0, "  - ").when(k == 1, "  ").otherwise(""), "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", F.length(T.hanging_indent(line)).alias("hang"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN '-' WHEN 2 THEN '+' WHEN 3 THEN '*' WHEN 4 THEN '+' ELSE '-' END AS marker FROM part""")
def nested_markers(spark, sf_dir):
    """Marks of a source, as one of three."""
    marks = F.array(*map(F.lit, ("", "-", "+", "*", "o", "▪")))
    return table(spark, sf_dir, "part").select("p_partkey", T.ascii_marker(F.element_at(marks, (F.col("p_partkey") % 6 + 1).cast("int"))).alias("marker"))


@query(
    """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN TRUE WHEN 1 THEN TRUE WHEN 2 THEN TRUE WHEN 3 THEN FALSE WHEN 4 THEN FALSE ELSE o_custkey % 5 IN (0, 1) END AS follows FROM orders"""
)
def continues_outline(spark, sf_dir):
    """Numbers after another one: its first child, its next sibling, its parent's next sibling; not a gap, not a deeper child; and first numbers."""
    a, k = (F.col("o_custkey") % 5).cast("int"), F.col("o_orderkey") % 6
    arr = lambda *x: F.array(*(v.cast("int") if hasattr(v, "cast") else F.lit(v) for v in x))
    last = F.when(k == 5, F.array().cast("array<int>")).otherwise(arr(a + 1, 2))
    path = F.when(k == 0, arr(a + 1, 2, 1)).when(k == 1, arr(a + 1, 3)).when(k == 2, arr(a + 2)).when(k == 3, arr(a + 1, 4)).when(k == 4, arr(a + 1, 2, 1, 1)).otherwise(F.when(a == 0, arr(7)).otherwise(arr(3, a)))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.continues_outline(last, path).alias("follows"))


@query("""SELECT event_id, upper((value > 50)::VARCHAR) AS shown, CASE WHEN date_trunc('day', t) = t THEN strftime(t, '%d/%m/%Y') ELSE strftime(t, '%d/%m/%Y %H:%M') END AS at FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN date_trunc('day', ts) ELSE ts END AS t FROM events)""")
def display_bool(spark, sf_dir):
    """Truth values, and moments, with those at midnight as dates."""
    t = F.when(F.col("event_id") % 3 == 0, F.date_trunc("day", "ts")).otherwise(F.col("ts"))
    return table(spark, sf_dir, "events").select("event_id", D.bool_text(F.col("value") > 50).alias("shown"), D.timestamp_text(t).alias("at"))


# --- outline ----------------------------------------------------------------------------------------------------------------


@query(
    """WITH RECURSIVE h AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k, (event_id % 4 + 1)::INT AS n, event_type = 'click' AS opens FROM events),
    f AS (SELECT user_id, k, event_id, opens OR n = 1 OR TRUE AS kept, n AS last FROM h WHERE k = 1 UNION ALL
      SELECT h.user_id, h.k, h.event_id, h.opens OR h.n = f.last + 1, CASE WHEN h.opens OR h.n = f.last + 1 THEN h.n ELSE f.last END FROM f JOIN h ON h.user_id = f.user_id AND h.k = f.k + 1)
    SELECT user_id::VARCHAR AS doc_id, count(*)::BIGINT AS kept FROM f WHERE kept GROUP BY user_id"""
)
def accepted_headings(spark, sf_dir):
    """Numbered lines that open a paragraph or go on from the last accepted one."""
    e = table(spark, sf_dir, "events")
    text = F.concat((F.col("event_id") % 4 + 1).cast("string"), F.lit(". Part"))
    lines = e.select(F.col("user_id").cast("string").alias("doc_id"), F.lit(1).alias("page"), F.col("ts").cast("timestamp").cast("double").alias("top"), text.alias("text"), (F.col("event_type") == "click").alias("starts_paragraph"))
    return outline.accepted_headings(lines).groupBy("doc_id").agg(F.count("*").alias("kept"))


@query(
    """WITH h AS (SELECT user_id, event_id, ts, (event_type = 'purchase')::INT AS top FROM events),
    a AS (SELECT *, sum(top) OVER w AS a, 1 - first_value(top) OVER w AS early FROM h WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING))
    SELECT event_id, CASE WHEN top = 1 THEN a + early || '' ELSE CASE WHEN a = 0 THEN 1 ELSE a + early END || '.' || row_number() OVER (PARTITION BY user_id, a, top ORDER BY ts) END AS path FROM a"""
)
def entered_levels(spark, sf_dir):
    """Headings that have a rank and no number take the next free one of their rank; one that comes before any of the first rank uses up that rank's first."""
    e = table(spark, sf_dir, "events")
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("ts")).cast("int")
    heads = e.select(F.col("user_id").cast("string").alias("doc_id"), k.alias("seq"), "event_id", F.when(F.col("event_type") == "purchase", 0).otherwise(1).alias("rank"), F.lit(None).cast("array<int>").alias("path"))
    found = outline.entered_levels(heads.drop("event_id"))
    return heads.select("doc_id", "seq", "event_id").join(found, ["doc_id", "seq"]).select("event_id", outline.path_label(F.col("path")).alias("path"))


# --- geometry ---------------------------------------------------------------------------------------------------------------


@query("""SELECT c_custkey, arg_min(i, (abs(i * 700.0 - c_acctbal), i))::INT AS edge FROM customer, range(0, 16) t(i) GROUP BY c_custkey""")
def nearest_edge(spark, sf_dir):
    """The grid line nearest to a value, the first of two as near."""
    edges = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: i * F.lit(700.0))
    return table(spark, sf_dir, "customer").select("c_custkey", G.nearest_edge(edges, F.col("c_acctbal")).alias("edge"))


@query("""SELECT p_partkey, p_size % 4 <> 3 AND p_partkey % 9 <= 4 AS same FROM part""")
def same_column_grid(spark, sf_dir):
    """Whether two tables have as many columns, with edges within four points of each other."""
    off = (F.col("p_partkey") % 9).cast("double")
    a, more = F.array(F.lit(50.0), F.lit(150.0), F.lit(300.0)), F.array(F.lit(400.0))
    b = F.transform(a, lambda x: x + off)
    return table(spark, sf_dir, "part").select("p_partkey", G.same_edges(a, F.when(F.col("p_size") % 4 == 3, F.concat(b, more)).otherwise(b)).alias("same"))


@query("""SELECT p_partkey::VARCHAR AS table_id FROM part WHERE p_size > 20 AND p_partkey % 31 > 15""")
def large_enough(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    boxes = p.select(k.cast("string").alias("table_id"), F.lit(5.0).alias("x0"), F.lit(7.0).alias("top"), (F.col("p_size") + 5.0).alias("x1"), (k % 31 + 7.0).alias("bottom"))
    return G.large_enough(boxes).select("table_id")


@query(
    """WITH l AS (SELECT c_nationkey AS page, c_custkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) * 12 + sum(c_custkey % 5) OVER (PARTITION BY c_nationkey ORDER BY c_custkey))::DOUBLE AS top, 50.0 + floor(c_acctbal / 20) AS x1 FROM customer),
    g AS (SELECT *, top - lag(top + 9) OVER w AS gap, lag(x1) OVER w AS before, max(x1) OVER (PARTITION BY page) AS r FROM l WINDOW w AS (PARTITION BY page ORDER BY top)),
    m AS (SELECT page, list_sort(list(gap))[len(list(gap)) // 2 + 1] AS median FROM g WHERE gap >= 0 GROUP BY page)
    SELECT c_custkey, before IS NULL OR before < r - greatest(8.0, 0.04 * (r - 50)) OR gap > 1.6 * coalesce(median, 0) + 1 AS starts FROM g LEFT JOIN m USING (page)"""
)
def paragraph_starts(spark, sf_dir):
    """Lines of a page: those behind a short line or a wide gap begin a paragraph."""
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    top = (F.row_number().over(w) * 12 + F.sum(F.col("c_custkey") % 5).over(w)).cast("double")
    lines = table(spark, sf_dir, "customer").select(F.lit("d").alias("doc_id"), F.col("c_nationkey").alias("page"), "c_custkey", top.alias("top"), F.lit(50.0).alias("x0"), (50.0 + F.floor(F.col("c_acctbal") / 20)).alias("x1")).withColumn("bottom", F.col("top") + 9)
    return G.paragraph_starts(lines).select("c_custkey", F.col("starts_paragraph").alias("starts"))


@query(
    """WITH l AS (SELECT c_nationkey AS page, c_custkey, (row_number() OVER w * 12 + sum(c_custkey % 40) OVER w)::DOUBLE AS top FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)),
    g AS (SELECT *, top - lag(top + 9) OVER (PARTITION BY page ORDER BY top) AS gap FROM l), m AS (SELECT page, list_sort(list(gap))[len(list(gap)) // 2 + 1] AS median FROM g WHERE gap IS NOT NULL GROUP BY page)
    SELECT c_custkey, sum(CASE WHEN gap > 2.2 * coalesce(median, 0) + 4 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY top)::BIGINT AS run FROM g LEFT JOIN m USING (page)"""
)
def vertical_runs(spark, sf_dir):
    """Lines that stand close are one run; a gap far wider than the page's usual one parts them."""
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    top = (F.row_number().over(w) * 12 + F.sum(F.col("c_custkey") % 40).over(w)).cast("double")
    lines = table(spark, sf_dir, "customer").select(F.lit("d").alias("doc_id"), F.col("c_nationkey").alias("page"), "c_custkey", top.alias("top")).withColumn("bottom", F.col("top") + 9)
    return G.vertical_runs(lines).select("c_custkey", "run")


_BOXES = """b AS (SELECT p_brand AS doc, p_partkey AS id, (p_partkey % 37 * 5)::DOUBLE AS x0, (p_partkey % 23 * 7)::DOUBLE AS y0, (p_partkey % 37 * 5 + p_size * 3)::DOUBLE AS x1, (p_partkey % 23 * 7 + p_size * 2)::DOUBLE AS y1 FROM part)"""


@query(
    f"""WITH RECURSIVE {_BOXES}, o AS (SELECT *, (x1 - x0) * (y1 - y0) AS area, row_number() OVER (PARTITION BY doc ORDER BY (x1 - x0) * (y1 - y0) DESC, id::VARCHAR) AS k FROM b),
    f AS (SELECT doc, 0::BIGINT AS k, NULL::BIGINT AS id, NULL::BIGINT AS parent, []::STRUCT(id BIGINT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE)[] AS kept FROM (SELECT DISTINCT doc FROM o) UNION ALL
      SELECT doc, k, id, parent, CASE WHEN parent IS NULL THEN list_append(kept, {{'id': id, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}}) ELSE kept END FROM (
        SELECT o.*, f.kept, (list_filter(f.kept, lambda t: greatest(0, least(t.x1, o.x1) - greatest(t.x0, o.x0)) * greatest(0, least(t.y1, o.y1) - greatest(t.y0, o.y0)) >= 0.8 * o.area))[1].id AS parent
        FROM f JOIN o ON o.doc = f.doc AND o.k = f.k + 1))
    SELECT doc AS doc_id, 1::INT AS page, id::VARCHAR AS table_id, parent::VARCHAR AS parent FROM f WHERE k > 0"""
)
def nested_suppression_greedy(spark, sf_dir):
    """Boxes made of parts: which lie in a larger one that is kept."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    boxes = p.select(F.col("p_brand").alias("doc_id"), F.lit(1).alias("page"), k.cast("string").alias("table_id"), (k % 37 * 5).cast("double").alias("x0"), (k % 23 * 7).cast("double").alias("top"), (k % 37 * 5 + F.col("p_size") * 3).cast("double").alias("x1"), (k % 23 * 7 + F.col("p_size") * 2).cast("double").alias("bottom"))
    return G.outermost(boxes)


@query(
    """WITH RECURSIVE w AS (SELECT p_brand AS doc, p_partkey AS id, p_name AS text, (p_partkey % 50 * 12)::DOUBLE AS x0, floor(p_retailprice) % 97 AS top FROM part),
    o AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY top, x0, id) AS k FROM w),
    f AS (SELECT doc, k, 0::BIGINT AS line, top AS first FROM o WHERE k = 1 UNION ALL
      SELECT o.doc, o.k, f.line + (abs(o.top - f.first) > 5.4)::BIGINT, CASE WHEN abs(o.top - f.first) > 5.4 THEN o.top ELSE f.first END FROM f JOIN o ON o.doc = f.doc AND o.k = f.k + 1),
    p AS (SELECT o.doc, f.line, o.x0, o.id, o.text, o.x0 - lag(o.x0 + 10) OVER (PARTITION BY o.doc, f.line ORDER BY o.x0, o.id) AS gap FROM o JOIN f ON f.doc = o.doc AND f.k = o.k)
    SELECT doc AS doc_id, line::INT AS line_no, string_agg(CASE WHEN gap > 0.45 THEN ' ' ELSE '' END || text, '' ORDER BY x0, id) AS text FROM p GROUP BY doc, line"""
)
def line_grouping(spark, sf_dir):
    """Words of a page as lines: tops near the first of the line; a blank where the gap is wide enough."""
    n = table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc_id"), F.lit(1).alias("page"), F.col("p_partkey").cast("int").alias("word_id"), F.col("p_name").alias("text"), (F.col("p_partkey") % 50 * 12).cast("double").alias("x0"), (F.col("p_partkey") % 50 * 12 + 10).cast("double").alias("x1"), (F.floor("p_retailprice") % 97).cast("double").alias("top"))
    words = n.withColumn("bottom", F.col("top") + 9).withColumn("size", F.lit(9.0))
    return G.group_lines(words, ["doc_id", "page"]).select("doc_id", "line_no", "text")


# --- layout -----------------------------------------------------------------------------------------------------------------


@query(
    """WITH RECURSIVE l AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS t, regexp_extract_all(lower(text), '[\\pL\\pN]+') AS w FROM conversations),
    f AS (SELECT conv_id, t, w, 1::BIGINT AS i, 1::BIGINT AS line, length(w[1])::BIGINT AS used FROM l WHERE len(w) > 0 UNION ALL
      SELECT conv_id, t, w, i + 1, line + (used + 1 + length(w[i + 1]) > 60)::BIGINT, CASE WHEN used + 1 + length(w[i + 1]) > 60 THEN length(w[i + 1]) ELSE used + 1 + length(w[i + 1]) END FROM f WHERE i < len(w))
    SELECT conv_id, t AS turn_no, max(line) AS n_lines, max(used) AS widest FROM f GROUP BY conv_id, t"""
)
def wrap_turns(spark, sf_dir):
    """Words of each turn wrapped to sixty characters, none of them longer than that."""
    c = table(spark, sf_dir, "conversations").withColumn("t", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")))
    placed = layout.wrapped(F.array(F.array_join(T.tokens("text"), " ")), F.lit(60.0))
    made = c.where(F.size(T.tokens("text")) > 0).withColumn("placed", placed)
    return made.select("conv_id", F.col("t").cast("long").alias("turn_no"), F.size("placed").cast("long").alias("n_lines"), F.array_max(F.transform("placed", lambda p: F.length(p["text"]))).cast("long").alias("widest"))


@query(
    """WITH l AS (SELECT o_custkey AS box, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos FROM orders), s AS (SELECT *, pos // 3 AS src, max(pos) OVER (PARTITION BY box, pos // 3) AS last, box % 7 + 1 AS shown FROM l)
    SELECT box AS box_id, coalesce(max(pos + 1) FILTER (last < shown), any_value(shown))::BIGINT AS kept FROM s GROUP BY box"""
)
def split_at_fit(spark, sf_dir):
    """Of the lines that fit a box, those whose logical line fits whole; all that fit, if the first does not."""
    o = table(spark, sf_dir, "orders")
    pos = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    placed = o.select(F.col("o_custkey").alias("box_id"), pos.alias("pos")).withColumns({"source": F.floor(F.col("pos") / 3), "shown": F.col("box_id") % 7 + 1})
    return layout.whole_lines(placed)


@query(
    """WITH t AS (SELECT s_nationkey AS page, s_suppkey AS id, (s_suppkey % 7 * 60)::DOUBLE AS x0, (s_suppkey % 11 * 50)::DOUBLE AS y0 FROM supplier), o AS (SELECT c_nationkey AS page, (c_custkey % 13 * 40)::DOUBLE AS x0, (c_custkey % 17 * 45)::DOUBLE AS y0 FROM customer),
    n AS (SELECT t.page, t.id, t.y0 + 40 AS bottom, min(o.y0) FILTER (o.y0 >= t.y0 + 40 AND o.x0 < t.x0 + 50 AND o.x0 + 30 > t.x0) AS first FROM t LEFT JOIN o USING (page) GROUP BY ALL)
    SELECT id::VARCHAR AS table_id, greatest(bottom, least(752.0, coalesce(first - 6, 1e9)))::DOUBLE AS free_bottom FROM n"""
)
def free_bottom(spark, sf_dir):
    """How far down a table's lines may reach: to the margin, or to what stands below it in its width."""
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    x, y = (F.col("s_suppkey") % 7 * 60).cast("double"), (F.col("s_suppkey") % 11 * 50).cast("double")
    tables = s.select(F.lit("d").alias("doc_id"), F.col("s_nationkey").alias("page"), F.col("s_suppkey").cast("string").alias("table_id"), x.alias("x0"), y.alias("top"), (x + 50).alias("x1"), (y + 40).alias("bottom"))
    ox, oy = (F.col("c_custkey") % 13 * 40).cast("double"), (F.col("c_custkey") % 17 * 45).cast("double")
    obstacles = c.select(F.lit("d").alias("doc_id"), F.col("c_nationkey").alias("page"), ox.alias("x0"), oy.alias("top"), (ox + 30).alias("x1"), (oy + 10).alias("bottom"))
    pages = tables.select("doc_id", "page").distinct().withColumn("height", F.lit(800.0))
    return layout.free_bottom(tables, obstacles, pages).select("table_id", "free_bottom")


@query("""SELECT o_orderkey, ((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 7)::INT AS spill_page FROM orders""")
def spill_pages(spark, sf_dir):
    """Lines that did not fit, on added pages that hold seven each."""
    lines = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("box_id"), "o_orderkey")
    return layout.spill_pages(lines, ["o_orderkey"], 194.0).select("o_orderkey", "spill_page")


@query(
    """WITH c AS (SELECT l_suppkey AS box, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS pos, CASE WHEN l_returnflag = 'A' THEN 'Arial' ELSE 'Times ' || l_returnflag END AS font, (l_linenumber * 2)::DOUBLE AS size FROM lineitem),
    f AS (SELECT box, arg_max(font, (n, -first)) AS font FROM (SELECT box, font, count(*) AS n, min(pos) AS first FROM c GROUP BY ALL) GROUP BY box), s AS (SELECT box, arg_max(size, (n, -first)) AS size FROM (SELECT box, size, count(*) AS n, min(pos) AS first FROM c GROUP BY ALL) GROUP BY box)
    SELECT box AS box_id, font, greatest(6.5, least(12.0, size))::DOUBLE AS size, font <> 'Arial' AS serif FROM f JOIN s USING (box)"""
)
def typography(spark, sf_dir):
    """The most frequent font and size of a box's characters, the first seen of equals, the size kept in bounds."""
    pos = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"))
    font = F.when(F.col("l_returnflag") == "A", "Arial").otherwise(F.concat(F.lit("Times "), "l_returnflag"))
    return layout.typography(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("box_id"), pos.alias("pos"), font.alias("font"), (F.col("l_linenumber") * 2).cast("double").alias("size")))


@query("""SELECT p_partkey, regexp_replace(p_name || 'é☃', '[^a-z ]', '.', 'g') AS drawn FROM part""")
def drawable(spark, sf_dir):
    """Characters that the font has no glyph for, as points."""
    return table(spark, sf_dir, "part").select("p_partkey", layout.drawable(F.concat("p_name", F.lit("é☃")), "abcdefghijklmnopqrstuvwxyz ").alias("drawn"))


# --- checks -----------------------------------------------------------------------------------------------------------------


@query(
    """SELECT n_nationkey::VARCHAR AS doc_id, CASE n_nationkey % 4 WHEN 0 THEN 'passed' WHEN 1 THEN 'missing: ' || lower(r) || '; double blank lines' WHEN 2 THEN 'tables left: 2; invented labels: column' ELSE 'stray characters: U+FFFD' END AS description
    FROM (SELECT n_nationkey, replace(n_name, '_', '') AS r FROM nation)"""
)
def report_description(spark, sf_dir):
    """What a report says: nothing lost, a lost name, tables that are still there, an invented label, a stray character."""
    n = table(spark, sf_dir, "nation").withColumns({"doc_id": F.col("n_nationkey").cast("string"), "r": F.regexp_replace("n_name", "_", "")})
    k = F.col("n_nationkey") % 4
    after = F.when(k == 1, "Key\n\n\n").when(k == 2, F.concat(F.lit("Key "), "r", F.lit("\nColumn 2: "))).when(k == 3, F.concat(F.lit("Key "), "r", F.lit("�"))).otherwise(F.concat(F.lit("Key "), "r"))
    residual = n.where(k == 2).select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("table_id"))
    found = verify.report(n.select("doc_id", F.concat(F.lit("Key "), "r", F.when(k == 2, " column 2").otherwise("")).alias("text")), n.select("doc_id", after.alias("text")), residual)
    return verify.describe(found)


@query("""SELECT doc_id, (list_filter(range(0, len(l) - 1), lambda i: trim(l[i + 1]) = '' AND trim(l[i + 2]) = ''))[1]::INT AS pos FROM (SELECT doc_id, string_split(replace(text, '. ', '.' || chr(10) || ' ' || chr(10)), chr(10)) AS l FROM documents)""")
def first_double_blank(spark, sf_dir):
    """The first of two blank lines in a row, in texts whose sentences stand apart."""
    lines = F.split(F.replace(F.col("text"), F.lit(". "), F.lit(".\n \n")), "\n")
    return table(spark, sf_dir, "documents").select("doc_id", verify.first_double_blank(lines).alias("pos"))


@query("""SELECT page_id, page_id % 6 IN (0, 1, 2, 3) AS supported FROM pages""")
def supported_suffixes(spark, sf_dir):
    """Files that a folder's scan takes: by suffix, in any case, but for lock files."""
    k = F.col("page_id") % 6
    names = F.concat(F.when(k == 5, "in/~$p").otherwise("in/p"), k.cast("string"), F.when(k == 0, ".PDF").when(k == 1, ".docx").when(k == 2, ".xlsx").when(k == 3, ".Xlsm").when(k == 4, ".doc").otherwise(".docx"))
    return table(spark, sf_dir, "pages").select("page_id", office.is_supported(names).alias("supported"))


@query("""SELECT r_regionkey::VARCHAR AS table_id, r_regionkey >= 1 AND r_regionkey <> 3 AS is_table FROM region""")
def sheet_is_table(spark, sf_dir):
    """Blocks of two rows and two columns at least are tables."""
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("table_id"), (F.col("r_regionkey") + 1).alias("n_rows"), F.when(F.col("r_regionkey") == 3, 1).otherwise(2).alias("n_cols"))
    return sheets.is_table(r).select("table_id", "is_table")


@query("""SELECT s_nationkey::VARCHAR || '/' || s_suppkey AS table_id, CASE WHEN s_suppkey % 3 = 0 THEN least(2, s_suppkey % 5 + 1) ELSE 0 END::INT AS rows FROM supplier""")
def print_title_rows(spark, sf_dir):
    """Rows that a sheet repeats on each page are headers of the block that they begin, as far as it goes."""
    s = table(spark, sf_dir, "supplier")
    blocks = s.select(F.lit("d").alias("doc_id"), F.col("s_suppkey").cast("int").alias("sheet_idx"), F.col("s_nationkey").cast("int").alias("block"), F.lit(4).alias("first_row"), (F.col("s_suppkey") % 5 + 4).cast("int").alias("last_row"))
    titles = s.select(F.lit("d").alias("doc_id"), F.col("s_suppkey").cast("int").alias("sheet_idx"), F.when(F.col("s_suppkey") % 3 == 0, 4).otherwise(3).alias("first"), F.lit(5).alias("last"))
    found = sheets.title_rows(blocks, titles)
    sheet, block = (F.split("table_id", "/")[i].cast("int").cast("string") for i in (0, 1))
    return found.select(F.concat(block, F.lit("/"), sheet).alias("table_id"), "rows")


# --- windows over events: as a batch, what the stream gives -------------------------------------------------------------------


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS value FROM events GROUP BY ALL""")
def tumbling_windows(spark, sf_dir):
    return _windowed(stream.windowed_counts(_stamped(spark, sf_dir)))


@query("""SELECT time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(15 * k) AS start, event_type, count(*) AS n, round(sum(value), 6) AS value FROM events, range(0, 4) t(k) GROUP BY ALL""")
def sliding_windows(spark, sf_dir):
    return _windowed(stream.windowed_counts(_stamped(spark, sf_dir), slide="15 minutes"))


@query(
    """WITH o AS (SELECT *, coalesce(ts >= lag(ts) OVER (PARTITION BY event_type ORDER BY ts) + INTERVAL 20 MINUTE, TRUE)::INT AS opens FROM events),
    s AS (SELECT *, sum(opens) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
    SELECT min(ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS value FROM s GROUP BY event_type, k"""
)
def session_windows(spark, sf_dir):
    return _windowed(stream.session_counts(_stamped(spark, sf_dir), "20 minutes"))


def _stamped(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _windowed(counted):
    return counted.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("value", 6).alias("value"))
