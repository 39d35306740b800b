"""Shared pieces of the training-data operators: tables, durable cuts of lineage, vectorised word hashing."""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscribe.session import forget, shared_folder, ship_code, stored

__all__ = ["Words", "as_long", "durable", "forget", "mix", "prepare", "shared_folder", "shielded", "slices", "stored", "table", "word_count"]

#: Characters that part words: blank, tab to carriage return.
SPACE = r"\x20\x09-\x0D"
#: Bytes of text that one numpy step works on; arrays of eight bytes a byte stay in the cache.
STEP_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession, rows: int = 1024) -> None:
    """Ship this package, and keep Arrow batches small: rows hold whole texts, ten thousand of them can be gigabytes."""
    ship_code(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shielded(operator):
    """For operators that return the columns of their first argument: input columns that begin with two underscores are set aside under other names meanwhile, as operators use such names themselves."""

    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        other = {c: f"kept{k}{c}" for k, c in enumerate(docs.columns) if c.startswith("__")}
        made = operator(docs.withColumnsRenamed(other), *args, **options) if other else operator(docs, *args, **options)
        return made.withColumnsRenamed({new: old for old, new in other.items()}) if other else made

    return run


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a checkpoint; Spark removes it when nothing refers to it any more."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def word_count(text: Column) -> Column:
    """Number of runs of characters that are not blanks (null: 0), without an array of the words."""
    one_each = F.regexp_replace(text, f"[{SPACE}]*+[^{SPACE}]++[{SPACE}]*+", "x")
    # Text of blanks alone has no match and stays as it is.
    return F.coalesce(F.length(F.translate(one_each, " \t\n\x0b\x0c\r", "")), F.lit(0)).cast("long")


# --- words in numpy -------------------------------------------------------------------------

_MASK = (1 << 64) - 1


def _odd(seed: int) -> int:
    return (seed * 0x9E3779B97F4A7C15 + 0xD1B54A32D192ED03) & _MASK | 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    have, power = 1, base
    while have < n:  # doubling: the second half is the first, times base**have
        take = min(have, n - have)
        out[have : have + take] = out[:take] * np.uint64(power)
        have, power = have + take, power * power & _MASK
    return out


_BASE = _odd(11)
_INVERSE = pow(_BASE, -1, 1 << 64)
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_BYTE = np.random.default_rng(20_011).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes from which on a word is hashed by itself.
LONG_WORD = 256


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    x = x + np.uint64(_odd(seed))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(1 << 16, 1 << math.ceil(math.log2(n + 1)))
    if size not in _tables:
        _tables.clear()
        _tables[size] = (_powers(_BASE, size), _powers(_INVERSE, size))
    return _tables[size]


class Words:
    """Words of a run of texts: 64-bit hashes, and for each text the index of its first word.

    Hashes are polynomials modulo 2**64, taken of all words at once. Such polynomials agree, in any base, on certain pairs of different
    words of a thousand bytes and more, so long words, which are few, have a hash of another kind.
    """

    def __init__(self, texts: list[str | None], is_word: np.ndarray = _IS_WORD):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        joined = np.frombuffer(b" ".join([b"", *raw, b""]), np.uint8)
        inside = is_word[joined]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.start, self.end = edges[::2], edges[1::2]
        begins = np.cumsum([1, *(len(x) + 1 for x in raw)])
        self.first = np.searchsorted(self.start, begins)  # text i has words first[i] to first[i + 1]
        self.bytes, self.begin = joined, begins
        power, inverse = _power_tables(len(joined))
        total = np.zeros(len(joined) + 1, np.uint64)
        np.cumsum(_BYTE[joined] * power[: len(joined)], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * inverse[self.start])
        for k in np.flatnonzero(self.end - self.start >= LONG_WORD):
            own = hashlib.blake2b(joined[self.start[k] : self.end[k]], digest_size=8).digest()
            self.hash[k] = np.frombuffer(own, np.uint64)[0]

    def grams(self, n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of n consecutive words at each word, and whether all n lie in one text."""
        h, count = self.hash, len(self.hash)
        out = np.zeros(count, np.uint64)
        if count >= n:
            base, acc = np.uint64(_odd(seed + 100)), h[: count - n + 1].copy()
            for k in range(1, n):
                acc *= base
                acc += h[k : count - n + 1 + k]
            out[: count - n + 1] = mix(acc, seed)
        left = np.repeat(self.first[1:], np.diff(self.first)) - np.arange(count)
        return out, left >= n


def slices(texts: list[str | None], limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` characters; a longer text has a range of its own."""
    begin = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > limit:
            yield begin, i
            begin, size = i, 0
        size += n + 1
    if begin < len(texts):
        yield begin, len(texts)


def as_long(values: np.ndarray) -> pa.Array:
    """64-bit hashes as signed integers, as Spark has no others."""
    return pa.array(values.view(np.int64))
