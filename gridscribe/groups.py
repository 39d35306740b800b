"""Groups of rows as a stream: one exchange and one sort bring a group's rows together, and Python cuts the stream where the keys change.

A group costs no batch and no table of its own, so millions of small ones are as cheap as their rows; a large one is held as Arrow columns.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from gridscribe.session import ship_code

# Rows of output that are sent at once.
SEND = 4096


def arrow_schema(schema: str | StructType) -> pa.Schema:
    return to_arrow_schema(_parse_datatype_string(schema) if isinstance(schema, str) else schema)


def spread(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Rows dealt by their keys to as many tasks as a shuffle has: small rows that are much work are not one task's, and small partitions are not put together again."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _starts(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """Where a row's keys are not those of the row before it; nulls are alike."""
    n = rows.num_rows
    new = np.zeros(n, bool)
    new[:1] = True
    for key in keys:
        column = rows.column(key)
        a, b = column.slice(0, n - 1), column.slice(1)
        differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(a.is_null(), b.is_null()))
        new[1:] |= differ.to_numpy(zero_copy_only=False).astype(bool)
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables of whole groups, and where each group begins and the last one ends. The rows of a group follow one another."""
    held: list[pa.RecordBatch] = []
    last = None  # the keys of what is held

    def cut(rows: pa.Table):
        return rows, [*_starts(rows, keys).tolist(), rows.num_rows]

    for batch in batches:
        if not batch.num_rows:
            continue
        starts = _starts(pa.Table.from_batches([batch]), keys)
        first = [batch.column(k)[0].as_py() for k in keys]
        end = int(starts[-1])
        if held and (end or first != last):
            yield cut(pa.Table.from_batches([*held, batch.slice(0, end)]))
            held = []
        elif end:
            yield cut(pa.Table.from_batches([batch.slice(0, end)]))
        held.append(batch.slice(end) if end else batch)
        last = [batch.column(k)[batch.num_rows - 1].as_py() for k in keys]
    if held:
        yield cut(pa.Table.from_batches(held))


def by_group(df: DataFrame, keys: list[str], order: list, fold: Callable[[pa.Table, list[int]], Iterator[pa.RecordBatch]], schema: str | StructType, read: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """`fold` over the groups of `df`, each in `order`: it is given tables of whole groups, with where they begin, and gives batches of `schema`.

    `read` changes rows once they are dealt, so that its work is shared out, too.
    """
    ship_code(df.sparkSession)
    dealt = read(spread(df, *keys)).sortWithinPartitions(*keys, *order)

    def run(batches):
        gc.disable()  # a large group is millions of objects without cycles, which would be looked at again and again
        try:
            for rows, cuts in whole_groups(batches, keys):
                yield from fold(rows, cuts)
        finally:
            gc.enable()

    return dealt.mapInArrow(run, schema)


def sent(rows: Iterator[tuple], schema: pa.Schema, weigh: Callable[[tuple], int] = lambda row: 1) -> Iterator[pa.RecordBatch]:
    """Batches of the rows, a tuple each."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += weigh(row)
        if weight >= SEND:
            yield _batch(held, schema)
            held, weight = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, type=f.type) for column, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
