"""Queries that put grids through the flattener and lines through the numbering fold: their SQL states the lines that must come out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridscribe.functions import text as T
from gridscribe.operators import outline
from gridscribe.operators.grid import flatten_tables
from gridscribe.plans.registry import query, table
from gridscribe.sources import frames


def _cell(df: DataFrame, key: str | Column, row, col, text, row_span=1, col_span=1) -> DataFrame:
    """One cell for each row of a table."""
    c = lambda v: v if isinstance(v, Column) else F.lit(v)
    text = text if isinstance(text, Column) else F.lit(text)
    key = F.col(key) if isinstance(key, str) else key
    return df.select(key.cast("string").alias("table_id"), c(row).cast("int").alias("row"), c(col).cast("int").alias("col"), text.alias("text"), c(row_span).cast("int").alias("row_span"), c(col_span).cast("int").alias("col_span"))


def _lines(*cells: DataFrame, gap: float = 12.0, **options) -> DataFrame:
    """table_id, line: the flattened lines of each table, one below the other."""
    flat = flatten_tables(frames.placed_cells(reduce(DataFrame.unionByName, cells), gap), **options)
    return flat.select("table_id", F.array_join("lines", "\n").alias("line"))


def _rank(df: DataFrame, key: str, order: str, name: str = "k") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(order)))


@query(
    """WITH s AS (SELECT l_linenumber, l_returnflag AS flag, l_linestatus AS status, count(*) AS n FROM lineitem GROUP BY ALL),
    f AS (SELECT DISTINCT l_linenumber, flag FROM s), t AS (SELECT 'F' AS status, 1 AS pos UNION ALL SELECT 'O', 2)
    SELECT l_linenumber::VARCHAR AS table_id, string_agg(line, chr(10) ORDER BY pos) AS line FROM (
      SELECT l_linenumber, pos, '- kind: lines of both  |  ' || string_agg('flag ' || flag || ': n ' || coalesce(n, 0), '  |  ' ORDER BY flag) AS line
      FROM f CROSS JOIN t LEFT JOIN s USING (l_linenumber, flag, status) GROUP BY ALL) GROUP BY l_linenumber"""
)
def pivot_two_dimensional(spark, sf_dir):
    """Records that are columns: a line for each, with the name of every row; a cell over both stands in both."""
    status = lambda s: F.concat(F.lit("n "), F.count_if(F.col("l_linestatus") == s).cast("string"))
    counted = table(spark, sf_dir, "lineitem").groupBy("l_linenumber", "l_returnflag").agg(status("F").alias("f"), status("O").alias("o"))
    rows = _rank(counted, "l_linenumber", "l_returnflag")
    top = counted.select("l_linenumber").distinct()
    return _lines(
        _cell(top, "l_linenumber", 0, 0, "kind"), _cell(top, "l_linenumber", 0, 1, "lines of both", col_span=2),
        _cell(rows, "l_linenumber", F.col("k"), 0, F.concat(F.lit("flag "), "l_returnflag")), _cell(rows, "l_linenumber", F.col("k"), 1, F.col("f")), _cell(rows, "l_linenumber", F.col("k"), 2, F.col("o")),
    )


@query(
    """SELECT conv_id::VARCHAR AS table_id, CASE WHEN count(*) = 1 THEN '- Conversation: ' || conv_id || '  |  Turns: ' || max(role)
      ELSE '- Conversation: ' || conv_id || '  |  Turns:' || chr(10) || string_agg('  - ' || role, chr(10) ORDER BY turn, role, text) END AS line FROM conversations GROUP BY conv_id"""
)
def multi_item_cells(spark, sf_dir):
    """A cell of several items: a line that names its column, and the items below; of one, no line of its own."""
    roles = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat(F.lit("- "), x["role"]))
    each = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(roles, "\n").alias("items"))
    return _lines(_cell(each, "conv_id", 0, 0, "Conversation"), _cell(each, "conv_id", 0, 1, "Turns"), _cell(each, "conv_id", 1, 0, F.col("conv_id").cast("string")), _cell(each, "conv_id", 1, 1, F.col("items")))


@query(
    """SELECT p_partkey::VARCHAR AS table_id, '- ' || CASE WHEN p_partkey % 3 = 0 THEN 'Brand: ' WHEN p_partkey % 5 = 0 THEN 'Type: ' ELSE '' END || p_name
      || CASE WHEN p_partkey % 15 = 0 THEN chr(10) || '- Type' ELSE '' END AS line FROM part"""
)
def header_span_lookup(spark, sf_dir):
    """A value over three columns takes the first header that says something; one that no line says is kept below."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    return _lines(
        _cell(p, k, 0, 0, "Column 1"), _cell(p, k, 0, 1, F.when(k % 3 == 0, "Brand").otherwise("Field 2")), _cell(p, k, 0, 2, F.when(k % 5 == 0, "Type").otherwise("STT")),
        _cell(p, k, 1, 0, F.col("p_name"), col_span=3),
    )


@query(
    """SELECT p_brand AS table_id, CASE WHEN v = 0 THEN 1 ELSE 0 END::INT AS header_rows,
      v = 0 AND count(DISTINCT p_size) = count(*) AND count(*) >= 2 AND avg(length('no ' || p_size)) < avg(length(p_name)) AS label_column
    FROM (SELECT *, replace(p_brand, 'Brand#', '')::INT % 4 AS v FROM part) GROUP BY p_brand, v"""
)
def header_band_detect(spark, sf_dir):
    """First rows that are headers, and some that are not: one that leaves a column unnamed, one of figures, one of a list."""
    rows = table(spark, sf_dir, "part").withColumn("v", F.regexp_replace("p_brand", "Brand#", "").cast("int") % 4)
    body = _rank(rows, "p_brand", "p_partkey")
    top, v = rows.select("p_brand", "v").distinct(), F.col("v")
    cells = [
        _cell(top, "p_brand", 0, 0, F.when(v == 2, "10").when(v == 3, "- Size").otherwise("Size of the part")), _cell(top, "p_brand", 0, 1, F.when(v == 1, "").when(v == 2, "20").otherwise("Name")),
        _cell(body, "p_brand", F.col("k"), 0, F.concat(F.lit("no "), F.col("p_size").cast("string"))), _cell(body, "p_brand", F.col("k"), 1, F.col("p_name")),
    ]
    return flatten_tables(frames.placed_cells(reduce(DataFrame.unionByName, cells))).select("table_id", "header_rows", "label_column")


@query(
    """WITH v AS (SELECT p_brand || '/a' AS t, 'm' || p_partkey AS a, p_type || ' ' || p_name AS b FROM part UNION ALL SELECT p_brand || '/b', p_name, p_type || ' ' || p_name FROM part
      UNION ALL SELECT p_brand || '/c', p_type || ' ' || p_name || ' ' || p_partkey, p_name FROM part UNION ALL SELECT p_brand || '/d', p_partkey::VARCHAR, p_name FROM part
      UNION ALL SELECT p_brand || '/e', repeat('long ', 11) || p_partkey, repeat(p_name, 30) FROM part)
    SELECT t AS table_id, count(DISTINCT lower(a)) = count(*) AND count(*) >= 2 AND bool_and(length(a) <= 60 AND regexp_matches(a, '[a-z]')) AND avg(length(a)) < avg(length(b)) AS label_column FROM v GROUP BY t"""
)
def label_column_detect(spark, sf_dir):
    """Whether a column names each row: with a letter, short, different, and shorter than what it names."""
    p, key = table(spark, sf_dir, "part"), F.col("p_partkey").cast("string")
    pairs = {
        "a": (F.concat(F.lit("m"), key), F.concat_ws(" ", "p_type", "p_name")), "b": (F.col("p_name"), F.concat_ws(" ", "p_type", "p_name")), "c": (F.concat_ws(" ", "p_type", "p_name", key), F.col("p_name")),
        "d": (key, F.col("p_name")), "e": (F.concat(F.repeat(F.lit("long "), F.lit(11)), key), F.repeat("p_name", F.lit(30))),
    }
    each = [p.select(F.concat("p_brand", F.lit(f"/{n}")).alias("t"), "p_partkey", a.alias("a"), b.alias("b")) for n, (a, b) in pairs.items()]
    flat = flatten_tables(frames.as_cells(reduce(DataFrame.unionByName, each), "t", ["p_partkey"], ["a", "b"], ["Item code", "What it is"]))
    return flat.select("table_id", "label_column")


@query(
    """SELECT n_regionkey::VARCHAR AS table_id, string_agg('- Country: ' || n_name || '  |  Nations of ' || r_name || ': key ' || n_nationkey, chr(10) ORDER BY n_nationkey) AS line
    FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_regionkey"""
)
def two_row_header_fuse(spark, sf_dir):
    """A header over two rows, its lines joined to one label."""
    n = _rank(table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey")
    r = table(spark, sf_dir, "region")
    return _lines(
        _cell(r, "r_regionkey", 0, 0, "Country", row_span=2), _cell(r, "r_regionkey", 0, 1, "Nations of"), _cell(r, "r_regionkey", 1, 1, F.col("r_name")),
        _cell(n, "n_regionkey", F.col("k") + 1, 0, F.col("n_name")), _cell(n, "n_regionkey", F.col("k") + 1, 1, F.concat(F.lit("key "), F.col("n_nationkey").cast("string"))),
    )


@query(
    """SELECT n_regionkey::VARCHAR AS table_id, string_agg('- Country of ' || r_name || ': ' || n_name || '  |  Key in ' || r_name || ': k' || n_nationkey, chr(10) ORDER BY n_nationkey) AS line
    FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_regionkey"""
)
def stated_header_rows(spark, sf_dir):
    """Two rows that the file states as headers, though geometry sees one."""
    n, r = _rank(table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey"), table(spark, sf_dir, "region")
    stated = r.select(F.lit("frame").alias("doc_id"), F.col("r_regionkey").cast("string").alias("table_id"), F.lit(2).alias("rows"))
    return _lines(
        _cell(r, "r_regionkey", 0, 0, "Country"), _cell(r, "r_regionkey", 0, 1, "Key"), _cell(r, "r_regionkey", 1, 0, F.concat(F.lit("of "), "r_name")), _cell(r, "r_regionkey", 1, 1, F.concat(F.lit("in "), "r_name")),
        _cell(n, "n_regionkey", F.col("k") + 1, 0, F.col("n_name")), _cell(n, "n_regionkey", F.col("k") + 1, 1, F.concat(F.lit("k"), F.col("n_nationkey").cast("string"))), declared=stated,
    )


@query(
    """SELECT n_regionkey::VARCHAR AS table_id, string_agg('- Country: ' || n_name || '  |  In all of ' || r_name || ' first: k' || n_nationkey || '  |  In all of ' || r_name || ' then: m' || n_nationkey, chr(10) ORDER BY n_nationkey) AS line
    FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_regionkey"""
)
def merged_header_band(spark, sf_dir):
    """A first row that merges columns and names them all, over a row of names: two header rows, without the file stating any."""
    n, r = _rank(table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey"), table(spark, sf_dir, "region")
    code = lambda letter: F.concat(F.lit(letter), F.col("n_nationkey").cast("string"))
    stated = r.select(F.lit("frame").alias("doc_id"), F.col("r_regionkey").cast("string").alias("table_id"), F.lit(0).alias("rows"))
    return _lines(
        _cell(r, "r_regionkey", 0, 0, "Country"), _cell(r, "r_regionkey", 0, 1, F.concat(F.lit("In all of "), "r_name"), col_span=2), _cell(r, "r_regionkey", 1, 1, "first"), _cell(r, "r_regionkey", 1, 2, "then"),
        _cell(n, "n_regionkey", F.col("k") + 1, 0, F.col("n_name")), _cell(n, "n_regionkey", F.col("k") + 1, 1, code("k")), _cell(n, "n_regionkey", F.col("k") + 1, 2, code("m")), declared=stated,
    )


@query(
    """SELECT c_nationkey::VARCHAR AS table_id, string_agg('- Name: ' || c_name || CASE WHEN c_nationkey % 2 = 0 THEN '  |  Segment: ' ELSE '  |  Balance: ' END || c_mktsegment, chr(10) ORDER BY c_custkey) AS line
    FROM customer GROUP BY c_nationkey"""
)
def carry_headers_restate(spark, sf_dir):
    """Pages of continued tables: one that repeats half of the carried headers has its own, any other the carried ones, and its first row is data."""
    c = _rank(table(spark, sf_dir, "customer"), "c_nationkey", "c_custkey").withColumn("k", F.col("k") - (F.col("c_nationkey") % 2))
    own = c.where("c_nationkey % 2 = 0").select("c_nationkey").distinct()
    carried = c.select("c_nationkey").distinct().select(F.lit("frame").alias("doc_id"), F.col("c_nationkey").cast("string").alias("table_id"), F.array(F.lit("Name"), F.lit("Balance")).alias("headers"))
    return _lines(
        _cell(own, "c_nationkey", 0, 0, "Name"), _cell(own, "c_nationkey", 0, 1, "Segment"), _cell(c, "c_nationkey", F.col("k"), 0, F.col("c_name")), _cell(c, "c_nationkey", F.col("k"), 1, F.col("c_mktsegment")), inherited=carried,
    )


@query(
    """SELECT s_nationkey::VARCHAR AS table_id, string_agg('- Name: ' || s_name || '  |  Code: p' || s_suppkey || CASE WHEN s_suppkey % 3 = 0 THEN chr(10) || '- Name: ' || s_name || '  |  Code: x' || s_suppkey ELSE '' END, chr(10) ORDER BY s_suppkey) AS line
    FROM supplier GROUP BY s_nationkey"""
)
def logical_row_ids(spark, sf_dir):
    """Two grid rows are two rows for a reader only where a column splits between them; a cell over both stands in either."""
    s = _rank(table(spark, sf_dir, "supplier"), "s_nationkey", "s_suppkey")
    top, code = s.select("s_nationkey").distinct(), lambda letter: F.concat(F.lit(letter), F.col("s_suppkey").cast("string"))
    return _lines(
        _cell(top, "s_nationkey", 0, 0, "Name"), _cell(top, "s_nationkey", 0, 1, "Code"), _cell(s, "s_nationkey", 2 * F.col("k") - 1, 0, F.col("s_name"), row_span=2),
        _cell(s, "s_nationkey", 2 * F.col("k") - 1, 1, code("p")), _cell(s.where("s_suppkey % 3 = 0"), "s_nationkey", 2 * F.col("k"), 1, code("x")),
    )


@query("""SELECT s_suppkey::VARCHAR AS table_id, '- Name: ' || s_name || '  |  Note: part one of s' || s_suppkey AS line FROM supplier""")
def sliced_cells(spark, sf_dir):
    """A paragraph that a stray rule cuts in two: its cells touch, its first half runs to the edge, no other column splits there."""
    s = table(spark, sf_dir, "supplier")
    key = "s_suppkey"
    return _lines(
        _cell(s, key, 0, 0, "Name"), _cell(s, key, 0, 1, "Note"), _cell(s, key, 1, 0, F.col("s_name"), row_span=2), _cell(s, key, 1, 1, "part one of"), _cell(s, key, 2, 1, F.concat(F.lit("s"), F.col(key).cast("string"))), gap=0.0,
    )


@query("""SELECT n_nationkey::VARCHAR AS table_id, '- ' || n_name || '  |  Key k' || n_nationkey AS line FROM nation""")
def headers_only_table(spark, sf_dir):
    """A table of a header row and a blank one is the line of its headers."""
    n, key = table(spark, sf_dir, "nation"), "n_nationkey"
    return _lines(_cell(n, key, 0, 0, F.col("n_name")), _cell(n, key, 0, 1, F.concat(F.lit("Key k"), F.col(key).cast("string"))), _cell(n, key, 1, 0, ""), _cell(n, key, 1, 1, ""))


@query("""SELECT p_partkey::VARCHAR AS table_id, CASE WHEN p_partkey % 5 = 0 THEN '- Name: ' || p_name || chr(10) || '- Maker' ELSE '- Name: ' || p_name || '  |  Maker: ' || p_brand END AS line FROM part""")
def completeness_guard(spark, sf_dir):
    """Words of a table that no line says come below it."""
    p, key = table(spark, sf_dir, "part"), "p_partkey"
    return _lines(_cell(p, key, 0, 0, "Name"), _cell(p, key, 0, 1, "Maker"), _cell(p, key, 1, 0, F.col("p_name")), _cell(p, key, 1, 1, F.when(F.col(key) % 5 != 0, F.col("p_brand")).otherwise("")))


@query(
    """WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM conversations)
    SELECT conv_id, string_agg(CASE WHEN k = 1 THEN 'Set (see b) in it):' || chr(10) ELSE '' END || chr(96 + k::INT) || ') ' || role, chr(10) ORDER BY k) AS items FROM t GROUP BY conv_id"""
)
def split_inline_items(spark, sf_dir):
    """Turns of a conversation in one paragraph, cut at their markers again; a marker in brackets is none."""
    c = table(spark, sf_dir, "conversations").withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")))
    said = F.struct("k", F.concat(F.char(F.col("k").cast("long") + 96), F.lit(") "), "role").alias("said"))
    each = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(said)), lambda x: x["said"]), " ").alias("run"))
    return each.select("conv_id", F.array_join(T.split_inline_items(F.concat(F.lit("Set (see b) in it): "), "run")), "\n").alias("items"))


# --- numbering --------------------------------------------------------------------------------------------------------------


def _numbered(tables: DataFrame) -> DataFrame:
    """table_id, k, line: lines that are not blank, counted."""
    made = outline.number_documents(tables).where("line <> ''")
    return made.select("doc_id", "table_id", F.row_number().over(Window.partitionBy("doc_id", "table_id").orderBy("seq")).cast("long").alias("k"), "line")


def _tables(df: DataFrame, doc, table_id, lines, title="", headers=(), continued=False, seq=0, path=(1,)) -> DataFrame:
    c = lambda v: v if isinstance(v, Column) else F.lit(v)
    path = path if isinstance(path, Column) else F.array(*map(F.lit, path))
    heads = F.array(*map(F.lit, headers)) if headers else F.array().cast("array<string>")
    return df.select(c(doc).cast("string").alias("doc_id"), c(table_id).cast("string").alias("table_id"), c(seq).cast("int").alias("seq"), lines.alias("lines"), path.alias("path"), c(title).alias("title"), heads.alias("headers"), c(continued).alias("continued"))


@query(
    f"""WITH RECURSIVE w AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k, regexp_extract_all(lower(text), '[\\pL\\pN]+') AS words FROM conversations),
    f AS (SELECT conv_id, 0::BIGINT AS k, 2::BIGINT AS since, FALSE AS again, []::VARCHAR[] AS words FROM (SELECT DISTINCT conv_id FROM w) UNION ALL
      SELECT w.conv_id, w.k, CASE WHEN f.since >= {outline.REPEAT_WORDS} THEN 0 ELSE f.since END + len(w.words), f.since >= {outline.REPEAT_WORDS}, w.words FROM f JOIN w ON w.conv_id = f.conv_id AND w.k = f.k + 1)
    SELECT conv_id::VARCHAR AS doc_id, conv_id::VARCHAR AS table_id, k + 1 AS k, CASE WHEN k = 0 THEN '1.1 Conv c' || conv_id ELSE '  - ' || CASE WHEN again THEN 'Conv c' || conv_id || '  |  ' ELSE '' END || array_to_string(words, ' ') END AS line FROM f"""
)
def context_repeat_distance(spark, sf_dir):
    """Nested lines of long records: the record's name is said again where as many words as a chunk may hold went by."""
    said = F.struct("turn", "role", "text", F.concat(F.lit("  - "), F.array_join(T.tokens("text"), " ")).alias("line"))
    each = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(said)), lambda x: x["line"]).alias("nested"))
    lines = F.concat(F.array(F.concat(F.lit("- Conv c"), F.col("conv_id").cast("string"))), F.col("nested"))
    return _numbered(_tables(each, F.col("conv_id"), F.col("conv_id"), lines))


@query(
    """WITH s AS (SELECT s_nationkey AS d, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier),
    p AS (SELECT *, CASE WHEN k <= ceil(n / 2) THEN 'a' ELSE 'b' END AS t FROM s)
    SELECT d::VARCHAR AS doc_id, t AS table_id, (1 + row_number() OVER (PARTITION BY d, t ORDER BY k))::BIGINT AS k, '  1.' || k || ' Name: ' || s_name AS line FROM p
    UNION ALL SELECT DISTINCT d::VARCHAR, t, 1::BIGINT, '1 List of them' || CASE t WHEN 'b' THEN ' (tiếp theo)' ELSE '' END FROM p"""
)
def number_continued(spark, sf_dir):
    """A table that goes on over a page: its rows count on, under its name and the mark of a continuation."""
    s = table(spark, sf_dir, "supplier")
    k, n = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")), F.count("*").over(Window.partitionBy("s_nationkey"))
    halves = s.withColumns({"k": k, "n": n}).withColumn("t", F.when(F.col("k") <= F.ceil(F.col("n") / 2), "a").otherwise("b"))
    line = F.struct("k", F.concat(F.lit("- Name: "), "s_name").alias("line"))
    each = halves.groupBy("s_nationkey", "t").agg(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]).alias("lines"))
    second = F.col("t") == "b"
    return _numbered(_tables(each, F.col("s_nationkey"), F.col("t"), F.col("lines"), "List of them", ("Name",), second, second.cast("int")))


@query(
    """WITH e AS (SELECT r_regionkey, r_name, n_name, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) AS k FROM nation JOIN region ON r_regionkey = n_regionkey), l AS (
      SELECT r_regionkey, 0 AS pos, 0 AS k, '' AS line FROM region WHERE FALSE
      UNION ALL SELECT r_regionkey, 1, 0, '1 STT  |  Country' FROM region UNION ALL SELECT r_regionkey, 2, 0, '  Group ' || r_name FROM region
      UNION ALL SELECT r_regionkey, 3, k, '  1.' || k || ' Country: ' || n_name FROM e UNION ALL SELECT r_regionkey, 4, 0, '    - Total of it' FROM region)
    SELECT 'd' || r_regionkey AS doc_id, 't' AS table_id, row_number() OVER (PARTITION BY r_regionkey ORDER BY pos, k)::BIGINT AS k, line FROM l"""
)
def number_groups(spark, sf_dir):
    """A counted table with a divider before its count and a row without a counter at its end: neither takes a number, and counters that repeat the number go."""
    n = table(spark, sf_dir, "nation")
    k = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    rows = n.withColumn("k", k).groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("k", "n_name"))).alias("rows"))
    met = rows.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    body = F.transform("rows", lambda x: F.concat(x["k"].cast("string"), F.lit("  |  Country: "), x["n_name"]))
    lines = F.concat(F.array(F.concat(F.lit("- Group "), "r_name")), body, F.array(F.lit("- Total of it")))
    return _numbered(_tables(met, F.concat(F.lit("d"), F.col("r_regionkey").cast("string")), "t", lines, headers=("STT", "Country")))


@query(
    """SELECT n_nationkey::VARCHAR AS table_id, CASE WHEN n_nationkey % 2 = 0 THEN '- STT  |  Country' ELSE '' END AS line FROM nation"""
)
def unsaid_headers(spark, sf_dir):
    """Output without numbers: headers that no line says stand in a line of their own."""
    n = table(spark, sf_dir, "nation")
    lines = F.when(F.col("n_nationkey") % 2 == 0, F.array(F.concat(F.lit("1  |  Country: "), "n_name"))).otherwise(F.array(F.concat(F.lit("- STT: 1  |  Country: "), "n_name")))
    return n.select(F.col("n_nationkey").cast("string").alias("table_id"), T.unsaid_header_line(lines, F.array(F.lit("STT"), F.lit("Country"))).alias("line"))
