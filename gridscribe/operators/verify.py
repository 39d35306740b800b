"""Checks of an output against its source, as set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridscribe.functions import text as T

DOUBLE_BLANK = r"\n[ \t]*\n[ \t]*\n"


def token_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, token, n: each document's multiset of tokens."""
    return docs.select("doc_id", F.explode(T.tokens(text)).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("n"))


def lost_tokens(source: DataFrame, output: DataFrame) -> DataFrame:
    """doc_id, token, lost: how many more there are in the source than in the output.

    Tokens of the source count up, those of the output down. The texts of a document are brought together, not its tokens, which are many times as large;
    what then counts them stays where they are.
    """
    signed = lambda df, sign: df.select("doc_id", "text", F.lit(sign).alias("sign"))
    both = signed(source, 1).unionAll(signed(output, -1)).repartition("doc_id").select("doc_id", F.explode(T.tokens("text")).alias("token"), "sign")
    return both.groupBy("doc_id", "token").agg(F.sum("sign").alias("lost")).where("lost > 0")


def missing_tokens(source: DataFrame, output: DataFrame) -> DataFrame:
    """Lost tokens that are not inside the output's tokens written together: a word joined to another is not missing."""
    stream = output.select("doc_id", T.token_stream("text").alias("stream"))
    met = lost_tokens(source, output).join(stream, "doc_id", "left")
    return met.where(~F.contains(F.coalesce("stream", F.lit("")), F.col("token"))).drop("stream")


def stray_characters(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({T.STRAY})"), F.lit(1))))


def fake_labels(text: Column) -> Column:
    """The words of invented labels such as `Column 1:`."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(T.FAKE_LABEL), F.lit(1)), F.lower)))


def double_blanks(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(DOUBLE_BLANK), F.lit(0))).cast("long")


def first_double_blank(lines: Column) -> Column:
    """Index of the first of two blank lines in a row, or null."""
    blank = F.transform(lines, lambda x: F.coalesce(F.trim(x) == "", F.lit(False)))
    both = lambda b: F.zip_with(b, F.slice(b, 2, F.greatest(F.size(b) - 1, F.lit(0))), lambda x, y: x & F.coalesce(y, F.lit(False)))
    at = T.let(blank, lambda b: F.array_position(both(b), True))
    return F.when(at > 0, (at - 1).cast("int"))


def report(source: DataFrame, output: DataFrame, residual: DataFrame | None = None) -> DataFrame:
    """One row a document: missing tokens, residual tables, invented labels, stray characters, double blanks, passed.

    What the source has already is not held against the output.
    """
    missing = missing_tokens(source, output).groupBy("doc_id").agg(F.array_sort(F.collect_list("token")).alias("missing_tokens"))
    left = source.select("doc_id", F.col("text").alias("__before"))
    right = output.select("doc_id", F.col("text").alias("__after"))
    met = left.join(right, "doc_id", "left").join(missing, "doc_id", "left")
    if residual is not None:
        met = met.join(residual.groupBy("doc_id").agg(F.count("*").alias("residual_tables")), "doc_id", "left")
    else:
        met = met.withColumn("residual_tables", F.lit(0).cast("long"))
    none = F.array().cast("array<string>")
    found = met.select(
        "doc_id",
        F.coalesce("missing_tokens", none).alias("missing_tokens"),
        F.coalesce("residual_tables", F.lit(0)).alias("residual_tables"),
        F.array_except(fake_labels(F.col("__after")), fake_labels(F.col("__before"))).alias("fake_labels"),
        F.array_except(stray_characters(F.col("__after")), stray_characters(F.col("__before"))).alias("stray_characters"),
        F.greatest(double_blanks(F.col("__after")) - double_blanks(F.col("__before")), F.lit(0)).alias("double_blanks"),
        F.size(T.tokens("__before")).cast("long").alias("source_tokens"),
        F.size(T.tokens("__after")).cast("long").alias("output_tokens"),
    )
    passed = (F.size("missing_tokens") == 0) & (F.col("residual_tables") == 0) & (F.size("fake_labels") == 0) & (F.size("stray_characters") == 0) & (F.col("double_blanks") == 0)
    return found.withColumn("passed", passed)


def describe(found: DataFrame) -> DataFrame:
    """doc_id, description: the report as text, cut at fifteen tokens, five labels and five characters."""
    some = lambda c, n: F.array_join(F.slice(F.col(c), 1, n), ", ")
    parts = [
        F.when(F.size("missing_tokens") > 0, F.concat(F.lit("missing: "), some("missing_tokens", 15))),
        F.when(F.col("residual_tables") > 0, F.concat(F.lit("tables left: "), F.col("residual_tables").cast("string"))),
        F.when(F.size("fake_labels") > 0, F.concat(F.lit("invented labels: "), some("fake_labels", 5))),
        F.when(F.size("stray_characters") > 0, F.concat(F.lit("stray characters: "), F.array_join(F.transform(F.slice("stray_characters", 1, 5), lambda c: F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii(c)), 4, "0"))), ", "))),
        F.when(F.col("double_blanks") > 0, F.lit("double blank lines")),
    ]
    return found.select("doc_id", F.when(F.col("passed"), "passed").otherwise(F.concat_ws("; ", *parts)).alias("description"))


def summary(found: DataFrame, flat: DataFrame) -> DataFrame:
    """doc_id, tables_flattened, lines_written, status: one row a document."""
    tables = flat.groupBy("doc_id").agg(F.count("*").alias("tables_flattened"), F.sum(F.size("lines")).cast("long").alias("lines_written"))
    status = F.when(F.col("passed"), "ok").otherwise("verification failed")
    return found.join(tables, "doc_id", "left").select("doc_id", F.coalesce("tables_flattened", F.lit(0)).alias("tables_flattened"), F.coalesce("lines_written", F.lit(0)).alias("lines_written"), status.alias("status"))
