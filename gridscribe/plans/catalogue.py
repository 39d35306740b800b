"""Named queries over the test tables: one for each operator, with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridscribe.functions import display as D
from gridscribe.functions import text as T
from gridscribe.operators import geometry as G
from gridscribe.operators import layout, outline, sheets, verify
from gridscribe.operators.grid import flatten_tables
from gridscribe.plans import documents
from gridscribe.plans.registry import ORACLES, QUERIES, query, table
from gridscribe.sources import frames, office

def sql_label(header: str, value: str) -> str:
    """`header: value` in SQL, for headers that are plain words."""
    return f"CASE WHEN starts_with(lower({value}), lower({header})) THEN {value} ELSE {header} || ': ' || {value} END"


# --- flattening -----------------------------------------------------------------------------------------------------


@query(
    """SELECT '1.' || row_number() OVER (ORDER BY n_nationkey) || ' Region: ' || r_name || '  |  Country: ' || n_name AS line
    FROM nation JOIN region ON n_regionkey = r_regionkey"""
)
def flatten_nation_region(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    line = frames.as_lines(rows, ["r_name", "n_name"], ["Region", "Country"])
    named = rows.select(F.lit("d").alias("doc_id"), F.lit("t").alias("table_id"), F.array(F.lit(1)).alias("path"), line.alias("line"), "n_nationkey")
    return outline.number_simple(named, ["n_nationkey"]).select("line")


@query(
    """SELECT c_custkey, seg || '.' || k || ' Name: ' || c_name || '  |  Nation: ' || c_nationkey || '  |  Balance: ' || format('{:,.2f}', c_acctbal) AS line
    FROM (SELECT *, dense_rank() OVER (ORDER BY c_mktsegment) AS seg, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS k FROM customer)"""
)
def flatten_customer_numbered(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    segments = rows.select("c_mktsegment").distinct().withColumn("seg", F.dense_rank().over(Window.orderBy("c_mktsegment")))  # a row a segment
    line = frames.as_lines(rows, ["c_name", "c_nationkey", "c_acctbal"], ["Name", "Nation", "Balance"], {"c_acctbal": "#,##0.00"})
    named = rows.withColumn("line", line).join(segments, "c_mktsegment").select("c_custkey", F.lit("d").alias("doc_id"), F.col("c_mktsegment").alias("table_id"), F.array("seg").alias("path"), "line")
    return outline.number_simple(named, ["c_custkey"]).select("c_custkey", "line")


@query("""SELECT s_suppkey, '- ' || s_suppkey || '  |  ' || s_nationkey || '  |  Name: ' || s_name AS line FROM supplier""")
def flatten_fake_headers(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier")
    line = frames.as_lines(rows, ["s_suppkey", "s_nationkey", "s_name"], ["STT", "Column 1", "Name"])
    return rows.select("s_suppkey", line.alias("line"))


@query(f"SELECT p_partkey, {sql_label("split_part(p_type, ' ', 1)", 'p_type')} AS same, {sql_label("'Economy'", 'p_type')} AS line FROM part")
def label_redundancy(spark, sf_dir):
    first = F.substring_index("p_type", " ", 1)
    return table(spark, sf_dir, "part").select("p_partkey", T.label(first, F.col("p_type")).alias("same"), T.label(F.lit("Economy"), F.col("p_type")).alias("line"))


def _grid_of_suppliers(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", "s_name", F.concat(F.lit("p"), F.col("s_suppkey").cast("string")).alias("s_code"))
    return frames.as_cells(rows, "s_nationkey", ["s_suppkey"], ["s_name", "s_code"], ["Supplier name", "Code of it"])


@query(
    """SELECT table_id, string_agg('- Supplier name: ' || s_name || '  |  Code of it: ' || 'p' || s_suppkey, chr(10) ORDER BY s_suppkey) AS lines
    FROM (SELECT s_nationkey::VARCHAR AS table_id, s_suppkey, s_name FROM supplier) GROUP BY table_id"""
)
def flatten_grids(spark, sf_dir):
    """The whole flattener on cells: header band, logical rows, rendering, guard."""
    return flatten_tables(_grid_of_suppliers(spark, sf_dir)).select("table_id", F.array_join("lines", "\n").alias("lines"))


@query(
    """SELECT r_name || ' group' AS grp, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) AS k, '- Region: ' || r_name || ' group  |  Country: ' || n_name AS line
    FROM nation JOIN region ON n_regionkey = r_regionkey"""
)
def rowspan_replication(spark, sf_dir):
    """A cell over several rows stands in each of them."""
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.row_number().over(Window.partitionBy("r_regionkey").orderBy("n_nationkey"))
    keyed = rows.select("r_regionkey", "r_name", "n_name", k.alias("row"))
    size = keyed.groupBy("r_regionkey", "r_name").agg(F.max("row").alias("n"))
    made = lambda df, row, col, span, text: df.select(F.lit("d").alias("doc_id"), F.col("r_regionkey").cast("string").alias("table_id"), row.alias("row"), F.lit(col).alias("col"), span.alias("row_span"), text.alias("text"))
    one = F.lit(1)
    cells = made(size, F.lit(0), 0, one, F.lit("Region")).unionByName(made(size, F.lit(0), 1, one, F.lit("Country")))
    cells = cells.unionByName(made(size, one, 0, F.col("n"), F.concat("r_name", F.lit(" group")))).unionByName(made(keyed, F.col("row"), 1, one, F.col("n_name")))
    x0, top = F.col("col") * 120.0, F.col("row") * 52.0
    line = F.struct("text", x0.alias("x0"), (x0 + 1).alias("x1"), top.alias("top"), (top + 10.0).alias("bottom"))
    full = cells.select("doc_id", "table_id", "row", "col", F.col("row_span").cast("int").alias("row_span"), F.lit(1).alias("col_span"), x0.alias("x0"), top.alias("top"), (x0 + 108).alias("x1"), (top + F.col("row_span") * 52.0 - 12).alias("bottom"), F.array(line).alias("lines"), F.lit(None).cast("array<struct<level: int, text: string, marker: string>>").alias("items"))
    flat = flatten_tables(full).join(size.select(F.col("r_regionkey").cast("string").alias("table_id"), F.concat("r_name", F.lit(" group")).alias("grp")), "table_id")
    return flat.select("grp", F.posexplode("lines").alias("k", "line")).select("grp", (F.col("k") + 1).cast("long").alias("k"), "line")


# --- text -------------------------------------------------------------------------------------------------------------


@query(
    rf"""SELECT doc_id, array_to_string(list_transform(words, lambda w, i: CASE WHEN i = 1 THEN w
        WHEN (regexp_matches(w, '^\p{{Ll}}$') AND NOT regexp_matches(w, '[{T.ONE_LETTER}]') OR regexp_matches(w, '^\p{{Ll}}{{2}}$') AND NOT regexp_matches(w, '[{T.VOWELS}]')) AND regexp_matches(words[i - 1], '\pL$') THEN w
        ELSE ' ' || w END), '') AS joined
    FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[\t-\r\x20]+'), lambda w: regexp_replace(w, '^[\t-\r\x20\x{{A0}}]+|[\t-\r\x20\x{{A0}}]+$', '', 'g')), lambda w: w <> '') AS words FROM documents)"""
)
def join_wrapped_lines(spark, sf_dir):
    """Words of every text as wrapped lines, joined and glued by the rule; a null text stays null."""
    return table(spark, sf_dir, "documents").select("doc_id", T.join_wrapped(F.split("text", r"\s+")).alias("joined"))


@query("""SELECT doc_id, regexp_replace(text, '\\s+$|^\\s+', '', 'g') AS clean FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[\\t\\x20]+', ' ', 'g'), ' *\\n *', chr(10), 'g')) AS text FROM documents)""")
def normalise_invisible(spark, sf_dir):
    """Zero-width and control characters that were put into texts are gone again."""
    dirty = F.concat(F.lit("​﻿"), F.regexp_replace("text", " ", "​ ­"), F.lit("\u0007⁠"))
    return table(spark, sf_dir, "documents").select("doc_id", T.squeeze_blanks(T.drop_invisible(dirty)).alias("clean"))


@query("""SELECT p_partkey, p_name || ' <= x >= ~= +/- -> - - "' || p_brand || '" ''q''' AS clean FROM part""")
def normalise_symbols(spark, sf_dir):
    dirty = F.concat("p_name", F.lit(" ≤ × ≥ ≈ ± → – • “"), "p_brand", F.lit("” ‘q’"))
    return table(spark, sf_dir, "part").select("p_partkey", T.normalise(dirty).alias("clean"))


@query("""SELECT p_partkey, p_name || ' ' || p_brand || ' ' || p_type AS clean FROM part""")
def normalise_spaces(spark, sf_dir):
    dirty = F.concat(F.lit("　 "), "p_name", F.lit("  "), "p_brand", F.lit("\t  "), "p_type", F.lit("  "))
    return table(spark, sf_dir, "part").select("p_partkey", T.normalise(dirty).alias("clean"))


@query("""SELECT p_partkey, p_name || ' fi 2 Mi ...' AS clean FROM part""")
def normalise_nfkc(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.normalise(F.concat("p_name", F.lit(" ﬁ ² 𝐌𝐢 …"))).alias("clean"))


@query("""SELECT p_partkey, '- ' || p_name || ' -> =5 -' AS clean FROM part""")
def pua_resolution(spark, sf_dir):
    """Glyphs of symbol fonts: a marker at the head, an arrow, ASCII marks and digits, a letter that is dropped."""
    dirty = F.concat(F.lit(" "), "p_name", F.lit("   "))
    return table(spark, sf_dir, "part").select("p_partkey", T.normalise(dirty).alias("clean"))


@query("""SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\pL\\pN]+')) AS token FROM documents) GROUP BY ALL""")
def tokenize_counts(spark, sf_dir):
    return verify.token_counts(table(spark, sf_dir, "documents"))


_MARKS = "- x|• x|o clock|* y|+z|-z|  · w|1. a|(a) b|6.1 c|1.500.000 d|a) e|03 months|b. f|12) g|1.000 h"


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 4 = 3 THEN (p_size::VARCHAR)
      ELSE (p_partkey % 900 + 1) || '.' || (p_size % 9 + 1) END AS path FROM part"""
)
def parse_heading(spark, sf_dir):
    """Numbered headings made of parts: two levels, one level with a point, an article, and prose with a figure."""
    number, child = (F.col("p_partkey") % 900 + 1).cast("string"), (F.col("p_size") % 9 + 1).cast("string")
    k = F.col("p_partkey") % 4
    text = (
        F.when(k == 0, F.concat(number, F.lit(" Bản sao "), "p_name"))
        .when(k == 1, F.concat(number, F.lit("."), child, F.lit(" "), F.initcap("p_name")))
        .when(k == 2, F.concat(number, F.lit("."), child, F.lit('."'), "p_name"))
        .otherwise(F.concat(F.lit("ĐIỀU"), F.col("p_size").cast("string"), F.lit(": "), "p_name"))
    )
    return table(spark, sf_dir, "part").select("p_partkey", outline.path_label(T.parse_heading(text)).alias("path"))


@query("""SELECT p_partkey, p_partkey % 2 = 0 AS contents FROM part""")
def contents_line(spark, sf_dir):
    text = F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, " ........ 12").otherwise(" ... 12"))
    return table(spark, sf_dir, "part").select("p_partkey", T.is_contents_line(text).alias("contents"))


@query(
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN 'Bảng 3: ' || p_name || '.' WHEN 2 THEN '' ELSE p_name END AS title FROM part"""
)
def table_title(spark, sf_dir):
    """A heading, a caption that names a table, a sentence, and a lead-in with a colon."""
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, F.concat(F.lit("2.3. "), "p_name")).when(k == 1, F.concat(F.lit("Bảng 3: "), "p_name", F.lit("."))).when(k == 2, F.concat("p_name", F.lit(" is about it."))).otherwise(F.concat("p_name", F.lit(":")))
    return table(spark, sf_dir, "part").select("p_partkey", T.table_title(text, k == 0).alias("title"))


@query("""SELECT p_partkey, p_name AS context FROM part""")
def row_context(spark, sf_dir):
    """Of a row, the first value with a letter: not the counter, not the column that only announces a list."""
    row = F.concat(F.col("p_partkey").cast("string"), F.lit("  |  Files:  |  Name: "), "p_name", F.lit("  |  Type: "), "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", T.row_context(row).alias("context"))


@query("""SELECT conv_id, string_agg(role, '  |  ' ORDER BY first) AS headers FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY ALL) GROUP BY conv_id""")
def header_line_distinct(spark, sf_dir):
    roles = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(T.header_line(roles).alias("headers"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'Total: ' || o_totalprice::BIGINT ELSE (o_orderkey % 7) || '  |  Total: ' || o_totalprice::BIGINT END AS line FROM orders""")
def absorb_row_index(spark, sf_dir):
    row = F.concat((F.col("o_orderkey") % 7).cast("string"), F.lit("  |  Total: "), F.bround("o_totalprice").cast("long").cast("string"))
    number = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 7).otherwise(F.lit(99)).cast("int")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.absorb_row_index(row, number).alias("line"))


# --- outline -----------------------------------------------------------------------------------------------------------


def _events_outline(spark, sf_dir):
    """Signups are headings, other events are tables, users are documents."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("doc_id"), F.lit(1).alias("page"), F.col("ts").cast("timestamp").cast("double").alias("top"), "event_id", "event_type")
    k = F.row_number().over(Window.partitionBy("doc_id").orderBy("top"))
    heads = e.where("event_type = 'signup'").withColumn("path", F.array(k.cast("int"))).select("doc_id", "page", "top", "path")
    return e.where("event_type <> 'signup'").drop("event_type"), heads


_SECTIONS = """WITH h AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events WHERE event_type = 'signup'),
    s AS (SELECT e.user_id, e.event_id, e.ts, (SELECT max(k) FROM h WHERE h.user_id = e.user_id AND h.ts < e.ts) AS section FROM events e WHERE event_type <> 'signup')"""


@query(_SECTIONS + " SELECT event_id, section::VARCHAR AS section FROM s")
def outline_section_asof(spark, sf_dir):
    tables, heads = _events_outline(spark, sf_dir)
    return outline.section_asof(tables, heads).select("event_id", outline.path_label(F.col("section")).alias("section"))


@query(
    _SECTIONS
    + """ SELECT event_id, CASE WHEN section IS NULL THEN (SELECT count(*) FROM h WHERE h.user_id = s.user_id) + row_number() OVER w || ''
      WHEN count(*) OVER (PARTITION BY user_id, section) = 1 THEN section || '' ELSE section || '.' || row_number() OVER w END AS number FROM s WINDOW w AS (PARTITION BY user_id, section ORDER BY ts)"""
)
def outline_alone_rule(spark, sf_dir):
    """The one table of a section takes its number; several take free numbers under it, and root tables those that headings leave."""
    tables, heads = _events_outline(spark, sf_dir)
    placed = outline.section_asof(tables, heads)
    return outline.table_numbers(placed, heads, ["top"]).select("event_id", outline.path_label(F.col("path")).alias("number"))


@query(
    """WITH free AS (SELECT r_regionkey, i, row_number() OVER (PARTITION BY r_regionkey ORDER BY i) AS k FROM region, range(1, 60) t(i) WHERE i % (r_regionkey + 2) <> 0 OR i > 30),
    n AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation)
    SELECT n_nationkey::BIGINT AS n_nationkey, (r_regionkey + 1) || '.' || i AS number FROM n JOIN free ON n_regionkey = r_regionkey AND n.k = free.k"""
)
def outline_kth_free_number(spark, sf_dir):
    """Nations take, in order, the numbers under their region that headings have not taken."""
    taken = table(spark, sf_dir, "region").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(30)))).where(F.col("n") % (F.col("r_regionkey") + 2) == 0)
    heads = taken.select(F.lit("d").alias("doc_id"), F.array((F.col("r_regionkey") + 1).cast("int"), F.col("n")).alias("path"))
    tables = table(spark, sf_dir, "nation").select(F.lit("d").alias("doc_id"), F.array((F.col("n_regionkey") + 1).cast("int")).alias("section"), F.col("n_nationkey").cast("long").alias("n_nationkey"))
    return outline.table_numbers(tables, heads, ["n_nationkey"]).select("n_nationkey", outline.path_label(F.col("path")).alias("number"))


@query(
    """WITH e AS (SELECT *, (event_type = 'purchase')::INT AS top FROM events),
    a AS (SELECT *, sum(top) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS a FROM e)
    SELECT event_id, CASE WHEN top = 1 THEN a || '' ELSE greatest(a, 1) || '.' || row_number() OVER (PARTITION BY user_id, a, top ORDER BY ts) END AS path FROM a"""
)
def outline_list_counters(spark, sf_dir):
    """Counters of a list of two levels, replayed in reading order: a deeper one starts over after a higher one."""
    e = table(spark, sf_dir, "events")
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("ts")).cast("int")
    doc = F.col("user_id").cast("string").alias("doc_id")
    paragraphs = e.select(doc, k.alias("seq"), "event_id", F.lit("1").alias("num_id"), F.when(F.col("event_type") == "purchase", 0).otherwise(1).alias("ilvl"))
    level = lambda n: F.struct(F.lit("1").alias("num_id"), F.lit("7").alias("abstract_id"), F.lit(n).alias("ilvl"), F.lit(1).alias("start"), F.lit("decimal").alias("fmt"), F.lit(None).cast("int").alias("override"))
    levels = e.select(doc).distinct().select("doc_id", F.explode(F.array(level(0), level(1))).alias("x")).select("doc_id", "x.*")
    return outline.list_numbers(paragraphs, levels).select("event_id", outline.path_label(F.col("list_path")).alias("path"))


@query(
    """WITH t AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM conversations)
    SELECT conv_id::VARCHAR AS table_id, (2 * (k - 1))::BIGINT AS seq, '1.' || k || ' Role: ' || role || '  |  Turn: ' || turn AS line FROM t
    UNION ALL SELECT conv_id::VARCHAR, (2 * (k - 1) - 1)::BIGINT, '' FROM t WHERE k > 1"""
)
def number_lines_full(spark, sf_dir):
    """The numbering fold, on tables without nested lines: a blank line parts the records."""
    c = table(spark, sf_dir, "conversations")
    line = frames.as_lines(c, ["role", "turn"], ["Role", "Turn"])
    item = F.struct("turn", "role", "text", line.alias("line"))
    flat = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["line"]).alias("lines"))
    tables = flat.select(F.col("conv_id").cast("string").alias("doc_id"), F.col("conv_id").cast("string").alias("table_id"), F.lit(0).alias("seq"), "lines", F.array(F.lit(1)).alias("path"), F.lit("").alias("title"), F.array(F.lit("Role"), F.lit("Turn")).alias("headers"), F.lit(False).alias("continued"))
    return outline.number_documents(tables).select("table_id", F.col("seq").cast("long").alias("seq"), "line")


@query(
    """WITH r AS (SELECT user_id, event_id, ts, CASE WHEN event_type = 'signup' THEN NULL WHEN event_type = 'purchase' THEN 1 ELSE 2 END AS c FROM events)
    SELECT event_id, c IS NULL AND coalesce(first_value(c IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) = 1, FALSE) AS is_divider FROM r"""
)
def divider_lookahead(spark, sf_dir):
    """Rows without a counter after which counting starts anew at 1."""
    line = F.when(F.col("event_type") == "signup", "- a group").when(F.col("event_type") == "purchase", "1  |  bought").otherwise("2  |  other")
    rows = table(spark, sf_dir, "events").select(F.lit("d").alias("doc_id"), F.col("user_id").alias("table_id"), "event_id", "ts", line.alias("line"))
    return outline.dividers(rows, ["ts"]).select("event_id", "is_divider")


# --- geometry --------------------------------------------------------------------------------------------------------------


@query(
    """WITH v AS (SELECT s_nationkey, s_acctbal, CASE WHEN s_acctbal - lag(s_acctbal) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal) > 300 THEN 1 ELSE 0 END AS o FROM supplier),
    c AS (SELECT *, sum(o) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal ROWS UNBOUNDED PRECEDING) AS cluster FROM v)
    SELECT s_nationkey, cluster::BIGINT AS cluster, round(avg(s_acctbal), 4) AS edge, count(*) AS n FROM c GROUP BY s_nationkey, cluster"""
)
def cluster_edges(spark, sf_dir):
    found = G.cluster_edges(table(spark, sf_dir, "supplier"), ["s_nationkey"], "s_acctbal", 300.0)
    return found.select("s_nationkey", F.col("cluster").cast("long").alias("cluster"), F.round("edge", 4).alias("edge"), "n")


@query(
    """WITH RECURSIVE v AS (SELECT c_nationkey, x, row_number() OVER (PARTITION BY c_nationkey ORDER BY x) AS k FROM (SELECT DISTINCT c_nationkey, floor(c_acctbal) AS x FROM customer)),
    f AS (SELECT c_nationkey, k, x AS kept, 1 AS n FROM v WHERE k = 1 UNION ALL
      SELECT v.c_nationkey, v.k, CASE WHEN v.x - f.kept > 250 THEN v.x ELSE f.kept END, f.n + (v.x - f.kept > 250)::INT FROM f JOIN v ON v.c_nationkey = f.c_nationkey AND v.k = f.k + 1)
    SELECT c_nationkey, max(n)::BIGINT AS n, max(kept)::BIGINT AS last FROM f GROUP BY c_nationkey"""
)
def distinct_edges_kept(spark, sf_dir):
    """Values over a tolerance from the last kept one: a fold, not islands."""
    each = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.collect_list(F.floor("c_acctbal").cast("double")).alias("v"))
    kept = G.kept_edges(F.col("v"), 250.0)
    return each.select("c_nationkey", F.size(kept).cast("long").alias("n"), F.element_at(kept, -1).cast("long").alias("last"))


@query("""SELECT o_orderpriority, list_sort(list(o_totalprice))[len(list(o_totalprice)) // 2 + 1] AS middle FROM orders GROUP BY o_orderpriority""")
def upper_median(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(G.upper_median(F.collect_list("o_totalprice")).alias("middle"))


def _points_and_boxes(spark, sf_dir):
    """Customers are words, suppliers of the same nation are cells."""
    keyed = lambda df, key: df.select(F.lit("d").alias("doc_id"), F.col(key).alias("page"), "*")
    c = keyed(table(spark, sf_dir, "customer"), "c_nationkey").select("doc_id", "page", F.col("c_custkey").alias("word_id"), *(F.floor(F.col("c_acctbal") / 10).cast("double").alias(n) for n in ("x0", "x1")), *((F.col("c_custkey") % 500).cast("double").alias(n) for n in ("top", "bottom")))
    s = keyed(table(spark, sf_dir, "supplier"), "s_nationkey").select("doc_id", "page", F.col("s_suppkey").alias("cell_id"), F.floor(F.col("s_acctbal") / 10).cast("double").alias("x0"), (F.floor(F.col("s_acctbal") / 10) + 200).cast("double").alias("x1"), (F.col("s_suppkey") % 300).cast("double").alias("top"), (F.col("s_suppkey") % 300 + 150).cast("double").alias("bottom"))
    return c, s


_WORDS = """WITH w AS (SELECT c_nationkey AS page, c_custkey AS word_id, floor(c_acctbal / 10) AS x, (c_custkey % 500)::DOUBLE AS y FROM customer),
    b AS (SELECT s_nationkey AS page, s_suppkey AS cell_id, floor(s_acctbal / 10) AS x0, floor(s_acctbal / 10) + 200 AS x1, (s_suppkey % 300)::DOUBLE AS y0, (s_suppkey % 300 + 150)::DOUBLE AS y1 FROM supplier),
    m AS (SELECT word_id, cell_id, x BETWEEN x0 - 0.5 AND x1 + 0.5 AND y BETWEEN y0 - 0.5 AND y1 + 0.5 AS inside,
      sqrt(greatest(x0 - x, 0, x - x1) ** 2 + greatest(y0 - y, 0, y - y1) ** 2) AS d FROM w JOIN b USING (page))"""


@query(_WORDS + """ SELECT word_id, arg_min(cell_id, (NOT inside, CASE WHEN inside THEN 0 ELSE d END, cell_id)) AS cell_id FROM m GROUP BY word_id""")
def word_to_cell_assign(spark, sf_dir):
    words, cells = _points_and_boxes(spark, sf_dir)
    return G.assign_words(words, cells, ["doc_id", "page"]).select("word_id", "cell_id")


@query(_WORDS + """ SELECT word_id, round(min(d), 6) AS distance FROM m GROUP BY word_id HAVING NOT bool_or(inside)""")
def nearest_cell_fallback(spark, sf_dir):
    words, cells = _points_and_boxes(spark, sf_dir)
    found = G.nearest_cells(words, cells, ["doc_id", "page"])
    return found.where(~F.col("inside")).select("word_id", F.round("distance", 6).alias("distance"))


@query(_WORDS + """ SELECT w.word_id FROM w WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.page = w.page AND x BETWEEN x0 - 1 AND x1 + 1 AND y BETWEEN y0 - 1 AND y1 + 1)""")
def words_outside_tables(spark, sf_dir):
    words, cells = _points_and_boxes(spark, sf_dir)
    return G.words_outside(words, cells).select("word_id")


@query(
    """WITH t AS (SELECT o_custkey AS doc, o_orderkey % 40 AS page, o_orderkey AS id, o_orderkey % 9 AS x, (o_orderkey // 40) % 10 AS y FROM orders),
    a AS (SELECT doc, page, arg_max(id, (y * 70 + 100, id)) AS id FROM t GROUP BY ALL), b AS (SELECT doc, page, arg_min(id, (y * 70, id)) AS id FROM t GROUP BY ALL)
    SELECT tb.id AS table_id, ta.id AS goes_on_from FROM a JOIN b ON a.doc = b.doc AND a.page + 1 = b.page JOIN t ta ON ta.id = a.id JOIN t tb ON tb.id = b.id
    WHERE abs(ta.x - tb.x) * 4 <= 12 AND ta.y * 70 + 100 > 480 AND tb.y * 70 < 200"""
)
def continuation_link(spark, sf_dir):
    """Orders as tables on pages: which goes on from the page before."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    x, y = (k % 9 * 4).cast("double"), (F.floor(k / 40) % 10 * 70).cast("double")
    tables = o.select(F.col("o_custkey").cast("string").alias("doc_id"), (k % 40).cast("int").alias("page"), k.alias("table_id"), x.alias("x0"), y.alias("top"), (x + 300).alias("x1"), (y + 100).alias("bottom"), F.array(F.lit(100.0), F.lit(200.0)).alias("edges"))
    pages = tables.select("doc_id", "page").distinct().withColumn("height", F.lit(800.0))
    return G.continuations(tables, pages).select("table_id", "goes_on_from")


@query(
    """WITH bins AS (SELECT DISTINCT p_brand, unnest(range(p_size * 15, p_size * 15 + 4)) AS bin FROM part),
    f AS (SELECT p_brand, bin, lag(bin) OVER (PARTITION BY p_brand ORDER BY bin) + 1 AS lo, min(bin) OVER (PARTITION BY p_brand) AS a, max(bin) OVER (PARTITION BY p_brand) + 1 AS z FROM bins)
    SELECT p_brand, lo::DOUBLE AS x0, bin::DOUBLE AS x1 FROM f WHERE bin - lo >= 7 AND lo - a >= 12 AND z - bin >= 12"""
)
def borderless_gutters(spark, sf_dir):
    """Bands that no word touches."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc_id"), F.lit(1).alias("page"), (F.col("p_size") * 15).cast("double").alias("x0"), (F.col("p_size") * 15 + 4).cast("double").alias("x1"))
    return G.gutters(p).select(F.col("doc_id").alias("p_brand"), "x0", "x1")


@query("""SELECT s_suppkey, s_suppkey % 5 IN (0, 2) AS nothing FROM supplier""")
def invisible_shapes(spark, sf_dir):
    k = F.col("s_suppkey") % 5
    fill = F.when(k == 0, F.lit(None).cast("array<double>")).when(k == 1, F.array(F.lit(0.5))).when(k == 2, F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0))).when(k == 3, F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.5))).otherwise(F.array(F.lit(1.0)))
    return table(spark, sf_dir, "supplier").select("s_suppkey", G.draws_nothing(fill, k == 4).alias("nothing"))


@query(
    """SELECT doc_id, (row * cols + col)::BIGINT AS cell, x0, top, x1, bottom FROM (
      SELECT n_nationkey::VARCHAR AS doc_id, n_nationkey % 3 + 2 AS cols, n_nationkey % 4 + 1 AS nrows FROM nation) n, range(0, 5) r(row), range(0, 5) c(col),
      LATERAL (SELECT (50.0 + 80 * col)::DOUBLE AS x0, (60.0 + 30 * row)::DOUBLE AS top, (50.0 + 80 * (col + 1))::DOUBLE AS x1, (60.0 + 30 * (row + 1))::DOUBLE AS bottom) WHERE row < nrows AND col < cols"""
)
def ruled_table_cells(spark, sf_dir):
    """Rules of a page, drawn in pieces and a little off, back to the cells between them."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("doc_id"), F.lit(1).alias("page"), (F.col("n_nationkey") % 3 + 2).alias("cols"), (F.col("n_nationkey") % 4 + 1).alias("rows"))
    h = n.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("rows")))).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)))
    y = 60.0 + 30 * F.col("k")
    h = h.select("doc_id", "page", (50.0 + 80 * F.col("piece")).alias("x0"), y.alias("top"), (50.0 + 80 * (F.col("piece") + 1)).alias("x1"), y.alias("bottom"))
    v = n.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("cols"))))
    x = 50.0 + 80 * F.col("k")
    v = v.select("doc_id", "page", x.alias("x0"), F.lit(59.0).alias("top"), x.alias("x1"), (61.0 + 30 * F.col("rows")).alias("bottom"))
    found = G.ruled_cells(h.unionByName(v)).join(n.select("doc_id", "cols"), "doc_id")
    cell = F.floor((F.col("top") - 59) / 30) * F.col("cols") + F.floor((F.col("x0") - 49) / 80)
    return found.select("doc_id", cell.cast("long").alias("cell"), "x0", "top", "x1", "bottom")


@query(
    """SELECT n_nationkey::VARCHAR AS doc_id, k::BIGINT AS k, CASE WHEN k > 30 THEN '  ' ELSE '' END || '1.' || k || ' Supplier name: ' || s_name || '  |  Code of it: p' || s_suppkey AS line
    FROM (SELECT s_nationkey AS n_nationkey, s_suppkey, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM supplier)"""
)
def flatten_positioned_pages(spark, sf_dir):
    """Every supplier of a nation on pages of thirty rows: one table that goes on over the page breaks, with its header on the first page alone."""
    order = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")).cast("int")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("doc_id"), order.alias("k"), "s_name", F.concat(F.lit("p"), F.col("s_suppkey").cast("string")).alias("code"))
    heads = rows.where("k = 1").select("doc_id", F.lit(0).alias("k"), F.lit("Supplier name").alias("s_name"), F.lit("Code of it").alias("code"))
    page = F.greatest(F.ceil(F.col("k") / 30), F.lit(1)).cast("int")
    placed = heads.unionByName(rows).withColumn("page", page).withColumn("row", F.when(F.col("page") == 1, F.col("k")).otherwise((F.col("k") - 1) % 30))
    size = placed.groupBy("doc_id", "page").agg((F.max("row") + 1).cast("int").alias("n"))
    cells = placed.select("doc_id", "page", "row", F.posexplode(F.array("s_name", "code")).alias("col", "text"))
    each = cells.select("doc_id", "page", "row", "col", F.posexplode(F.split("text", " ")).alias("k", "text"))
    x, top = 55.0 + 200 * F.col("col") + 60 * F.col("k"), 45.0 + 20 * F.col("row")
    words = each.select("doc_id", "page", (F.col("row") * 100 + F.col("col") * 10 + F.col("k")).cast("int").alias("word_id"), "text", x.alias("x0"), (x + F.least(F.lit(50.0), 5.0 * F.length("text"))).alias("x1"), top.alias("top"), (top + 9).alias("bottom"), F.lit(9.0).alias("size"))
    y = 40.0 + 20 * F.col("k")
    h = size.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n")))).select("doc_id", "page", F.lit(50.0).alias("x0"), y.alias("top"), F.lit(450.0).alias("x1"), y.alias("bottom"))
    v = size.withColumn("x", F.explode(F.array(F.lit(50.0), F.lit(250.0), F.lit(450.0)))).select("doc_id", "page", F.col("x").alias("x0"), F.lit(40.0).alias("top"), F.col("x").alias("x1"), (40.0 + 20 * F.col("n")).alias("bottom"))
    pages = size.select("doc_id", "page", F.lit(600.0).alias("width"), F.lit(800.0).alias("height"), F.lit(0).alias("rotation"))
    numbered = documents.flatten_pages(words, h.unionByName(v), pages).where("line <> ''")
    # A page has one table here, so the number that a line states is the only one in its document.
    return numbered.select("doc_id", F.regexp_extract("line", r"^ *1\.(\d+) ", 1).try_cast("long").alias("k"), "line")


# --- sheets and display ---------------------------------------------------------------------------------------------------


def _order_sheets(spark, sf_dir):
    """Orders as a sheet for each customer: a row for each order, blank where the key is a multiple of seven."""
    o = table(spark, sf_dir, "orders")
    row = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    keyed = o.select(F.lit("d").alias("doc_id"), F.col("o_custkey").cast("int").alias("sheet_idx"), F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("sheet"), row.cast("int").alias("row"), "o_orderkey", "o_totalprice")
    cols = keyed.withColumn("col", F.explode(F.array(F.lit(2), F.lit(3))))
    value = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice"))
    cells = cols.select("doc_id", "sheet_idx", "sheet", "row", "col", value.alias("value_num"), F.lit(None).cast("timestamp").alias("value_ts"), F.lit(None).cast("string").alias("value_str"), F.lit(None).cast("boolean").alias("value_bool"), F.lit("#,##0.00").alias("number_format"))
    none = spark.createDataFrame([], "doc_id string, sheet_idx int, min_row int, min_col int, max_row int, max_col int")
    return cells, none


@query(
    """WITH r AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS row, o_orderkey % 7 <> 0 AS seen FROM orders),
    i AS (SELECT *, row - row_number() OVER (PARTITION BY o_custkey ORDER BY row) AS island FROM r WHERE seen)
    SELECT o_custkey AS sheet, min(row) AS first_row, max(row) AS last_row, 2::BIGINT AS first_col, 3::BIGINT AS last_col FROM i GROUP BY o_custkey, island"""
)
def sheet_blocks(spark, sf_dir):
    found = sheets.sheet_blocks(*_order_sheets(spark, sf_dir))
    return found.select(F.col("sheet_idx").cast("long").alias("sheet"), *(F.col(c).cast("long").alias(c) for c in ("first_row", "last_row", "first_col", "last_col")))


@query(
    """SELECT r_regionkey::BIGINT AS sheet, count(*)::BIGINT AS swallowed FROM region, range(0, 10) a(i), range(0, 10) b(j)
    WHERE i <= r_regionkey AND j <= r_regionkey + 1 AND (i > 0 OR j > 0) GROUP BY ALL"""
)
def merge_cover_antijoin(spark, sf_dir):
    m = table(spark, sf_dir, "region").select(F.lit("d").alias("doc_id"), F.col("r_regionkey").cast("int").alias("sheet_idx"), F.lit(1).alias("min_row"), F.lit(1).alias("min_col"), (F.col("r_regionkey") + 1).cast("int").alias("max_row"), (F.col("r_regionkey") + 2).cast("int").alias("max_col"))
    return sheets.covered(m).groupBy(F.col("sheet_idx").cast("long").alias("sheet")).agg(F.count("*").alias("swallowed"))


@query("""SELECT o_orderkey, format('{:.2f}', o_totalprice) AS fixed, format('{:,.2f}', o_totalprice) AS grouped FROM orders""")
def display_number(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", D.number_text(F.col("o_totalprice"), "0.00").alias("fixed"), D.number_text(F.col("o_totalprice"), "#,##0.00").alias("grouped"))


@query("""SELECT DISTINCT l_discount, format('{:.1f}', l_discount * 100) || '%' AS shown FROM lineitem""")
def display_percent(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_discount", D.number_text(F.col("l_discount"), "0.0%").alias("shown")).distinct()


@query("""SELECT DISTINCT l_quantity, format('{:g}', l_quantity / 7) AS general, format('{:g}', l_quantity * 123457.5) AS large FROM lineitem""")
def display_general(spark, sf_dir):
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select("l_quantity", D.general(q / 7).alias("general"), D.general(q * 123457.5).alias("large")).distinct()


@query("""SELECT o_orderkey, CASE WHEN date_trunc('day', o_orderdate) = o_orderdate THEN strftime(o_orderdate, '%d/%m/%Y') ELSE strftime(o_orderdate, '%d/%m/%Y %H:%M') END AS shown FROM orders""")
def display_date(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", D.timestamp_text(F.col("o_orderdate")).alias("shown"))


# --- verification -----------------------------------------------------------------------------------------------------------


def _cut_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs, docs.withColumn("text", F.expr("substring(text, 1, cast(length(text) * 0.9 as int))"))


_TOKENS = """WITH a AS (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\pL\\pN]+')) AS token FROM documents) GROUP BY ALL),
    o AS (SELECT doc_id, text, left(text, floor(length(text) * 0.9)::BIGINT) AS cut FROM documents),
    b AS (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(cut), '[\\pL\\pN]+')) AS token FROM o) GROUP BY ALL),
    l AS (SELECT a.doc_id, a.token, a.n - coalesce(b.n, 0) AS lost FROM a LEFT JOIN b USING (doc_id, token) WHERE a.n > coalesce(b.n, 0))"""


@query(_TOKENS + " SELECT * FROM l")
def token_loss_multiset(spark, sf_dir):
    return verify.lost_tokens(*_cut_documents(spark, sf_dir))


@query(_TOKENS + """ SELECT l.* FROM l JOIN o USING (doc_id) WHERE NOT contains(array_to_string(regexp_extract_all(lower(cut), '[\\pL\\pN]+'), ''), token)""")
def token_loss_forgiving(spark, sf_dir):
    return verify.missing_tokens(*_cut_documents(spark, sf_dir))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 1 WHEN p_partkey % 3 = 1 THEN 0 ELSE 2 END::BIGINT AS stray FROM part""")
def stray_char_scan(spark, sf_dir):
    k = F.col("p_partkey") % 3
    text = F.concat("p_name", F.when(k == 0, "​").when(k == 1, "").otherwise("�​�"))
    return table(spark, sf_dir, "part").select("p_partkey", F.size(verify.stray_characters(text)).cast("long").alias("stray"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'column' ELSE '' END AS labels FROM part""")
def fake_label_scan(spark, sf_dir):
    text = F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, "\n- Column 3: x  |  column 4 : y").otherwise(" columns: x"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(verify.fake_labels(text), ",").alias("labels"))


@query("""SELECT doc_id, len(regexp_extract_all(x, '\\n[ \\t]*\\n[ \\t]*\\n'))::BIGINT AS doubled FROM (SELECT doc_id, replace(text, chr(10), chr(10) || ' ' || chr(10) || chr(10)) AS x FROM documents)""")
def double_blank_scan(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", verify.double_blanks(F.replace(F.col("text"), F.lit("\n"), F.lit("\n \n\n"))).alias("doubled"))


@query(
    _TOKENS
    + """ , m AS (SELECT l.* FROM l JOIN o USING (doc_id) WHERE NOT contains(array_to_string(regexp_extract_all(lower(cut), '[\\pL\\pN]+'), ''), token))
    SELECT o.doc_id, (SELECT count(*) FROM m WHERE m.doc_id = o.doc_id)::BIGINT AS missing, (SELECT count(*) FROM m WHERE m.doc_id = o.doc_id) = 0 AS passed FROM o"""
)
def verification_report(spark, sf_dir):
    found = verify.report(*_cut_documents(spark, sf_dir))
    return found.select("doc_id", F.size("missing_tokens").cast("long").alias("missing"), "passed")


@query("""SELECT s_nationkey::VARCHAR AS doc_id, 1::BIGINT AS tables_flattened, count(*)::BIGINT AS lines_written, 'ok' AS status FROM supplier GROUP BY s_nationkey""")
def verify_run_summary(spark, sf_dir):
    """Grids flattened, checked word by word, and summed up."""
    cells = _grid_of_suppliers(spark, sf_dir).withColumn("doc_id", F.col("table_id"))
    flat = flatten_tables(cells)
    source = cells.groupBy("doc_id").agg(F.array_join(F.flatten(F.collect_list(F.transform("lines", lambda x: x["text"]))), "\n").alias("text"))
    found = verify.report(source, flat.select("doc_id", F.concat(F.array_join("lines", "\n"), F.lit("\n"), F.array_join("headers", "\n")).alias("text")))
    return verify.summary(found, flat).select("doc_id", F.col("tables_flattened").cast("long").alias("tables_flattened"), "lines_written", "status")


# --- layout, names ---------------------------------------------------------------------------------------------------------


@query()
def wrap_lines(spark, sf_dir):
    """Texts wrapped to sixty characters: how many lines, and none wider."""
    docs = table(spark, sf_dir, "documents").withColumn("placed", layout.wrapped(F.split("text", "\n"), F.lit(60.0)))
    return docs.select("doc_id", F.size("placed").cast("long").alias("n_lines"), F.array_max(F.transform("placed", lambda p: F.length(p["text"]))).cast("long").alias("widest"))


@query(
    """WITH s AS (SELECT p_partkey, unnest([9.5, 9.0, 8.5, 8.0, 7.5, 7.0, 6.5])::DOUBLE AS size, p_size * 4 AS height, ceil(p_retailprice / 100 * 1)::BIGINT AS n FROM part)
    SELECT p_partkey AS box_id, coalesce(max(size) FILTER (n * size * 1.32 <= height), 6.5)::DOUBLE AS size,
      CASE WHEN count(*) FILTER (n * size * 1.32 <= height) > 0 THEN max(n) ELSE floor(max(height) / (6.5 * 1.32)) END::BIGINT AS shown FROM s GROUP BY p_partkey"""
)
def fit_plan(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("size", F.explode(F.array(*map(F.lit, layout.candidate_sizes()))))
    lines = p.select(F.col("p_partkey").alias("box_id"), "size", (F.col("p_size") * 4).cast("double").alias("height"), F.ceil(F.col("p_retailprice") / 100).alias("n_lines"))
    return layout.fit_plan(lines)


@query(
    """SELECT page_id, CASE WHEN ends_with(lower(stem), '_flattened') THEN stem ELSE stem || '_flattened' END || '.' || CASE WHEN page_id % 3 = 0 THEN 'docx' WHEN page_id % 3 = 1 THEN 'docx' ELSE 'pdf' END AS name
    FROM (SELECT page_id, 'p' || page_id || CASE WHEN page_id % 5 = 0 THEN '_Flattened' ELSE '' END AS stem FROM pages)"""
)
def output_naming(spark, sf_dir):
    k = F.col("page_id")
    path = F.concat(F.lit("/in/p"), k.cast("string"), F.when(k % 5 == 0, "_Flattened").otherwise(""), F.when(k % 3 == 0, ".XLSX").when(k % 3 == 1, ".docx").otherwise(".pdf"))
    return table(spark, sf_dir, "pages").select("page_id", office.output_name(path).alias("name"))


@query(
    """SELECT page_id, 'f' || page_id % 40 || CASE WHEN k > 1 THEN ' (' || k || ')' ELSE '' END || '.docx' AS name
    FROM (SELECT page_id, row_number() OVER (PARTITION BY page_id % 40 ORDER BY page_id) AS k FROM pages)"""
)
def name_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("f"), (F.col("page_id") % 40).cast("string"), F.lit(".docx")).alias("name"))
    return office.distinct_names(rows, "name", "page_id")


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'sheet' WHEN 1 THEN 'word' ELSE 'page' END AS reader FROM pages""")
def format_dispatch(spark, sf_dir):
    k = F.col("page_id") % 4
    return table(spark, sf_dir, "pages").select("page_id", office.route(F.concat(F.lit("a/b"), F.when(k == 0, ".XLSM").when(k == 1, ".docx").when(k == 2, ".pdf").otherwise(".txt"))).alias("reader"))


from gridscribe.plans import files, grids, rules  # noqa: E402, F401  the other queries
