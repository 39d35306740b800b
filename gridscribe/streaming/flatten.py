"""Folders as streams: files that arrive are flattened batch by batch, exactly as a batch job would."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscribe.operators import outline
from gridscribe.operators.grid import flatten_tables
from gridscribe.schema import NUMBERED
from gridscribe.session import ship_code
from gridscribe.sources import office

BINARY = "path string, modificationTime timestamp, length long, content binary"


def arriving_files(spark: SparkSession, folder: str, suffix: str = "*.docx", per_trigger: int = 1000) -> DataFrame:
    found = spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", suffix).option("maxFilesPerTrigger", per_trigger).load(folder)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("doc_id"), "content")


def flatten_stream(files: DataFrame, out: str, checkpoint: str):
    """Start a query that writes each batch's FLAT rows to its own folder of `out`: a batch that is run again replaces what it wrote."""

    def one(batch: DataFrame, number: int) -> None:
        flatten_tables(office.word_cells(batch)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Events per type and window, windows that slide if `slide` says how far; those later than the watermark are dropped."""
    window = F.window("ts", every, slide) if slide else F.window("ts", every)
    return events.withWatermark("ts", late).groupBy(window, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Events per type and session: a session ends when no event of its type came for `gap`."""
    counted = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("window"), "event_type")
    return counted.agg(F.count("*").alias("n"), F.sum("value").alias("value"))


_KEPT = "rows int, context string, path array<int>, title string"


def number_stream(tables: DataFrame) -> DataFrame:
    """NUMBERED lines of a stream of `tables` (doc_id, table_id, seq, lines, path, title, headers, continued), as `outline.number_documents` gives for all of them at once.

    Pages of a document may arrive in different batches, in their order: what a continuation goes on from (the row count, the record's name, the
    table's number and title) is the document's state.
    """
    ship_code(tables.sparkSession)

    def fold(key, batches, state):
        rows, context, path, title = state.get if state.exists else (0, "", [], "")
        path, out = tuple(path), []
        for t in pd.concat(list(batches)).sort_values("seq").itertuples():
            if not t.continued:
                rows, context, path, title = 0, "", tuple(t.path), t.title or ""
            made, rows, context = outline.number_lines(list(t.lines), path, rows, context, title, list(t.headers) if t.headers is not None else [], bool(t.continued))
            out += [{"doc_id": key[0], "table_id": t.table_id, "seq": k, "line": x} for k, x in enumerate(made)]
        state.update((int(rows), context, [int(n) for n in path], title))
        yield pd.DataFrame(out, columns=["doc_id", "table_id", "seq", "line"])

    return tables.groupBy("doc_id").applyInPandasWithState(fold, NUMBERED, _KEPT, "append", "NoTimeout")
