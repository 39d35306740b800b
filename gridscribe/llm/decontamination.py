"""Benchmark decontamination by size-partitioned MinHash containment search (Zhu et al., LSH Ensemble, 2016).

A test item is short and a document may be long, so their Jaccard similarity is tiny even where the item is in the
document word for word. Containment is searched instead, and converted to a Jaccard threshold for sets of known size:

* texts are cut into overlapping segments a few times as long as an item, so that sizes stay comparable and a run of an
  item's length lies wholly in one segment; items are grouped by size, powers of two, each with its own segments;
* segments are partitioned by size; for each partition the threshold is converted with its largest size, and bands and
  rows are chosen from one family of MinHash values for the recall asked for;
* a segment and an item that share a band are candidates; whether the document contains the item is then decided on the
  exact shingle sets of both.

Minima are taken once over small blocks of shingles; those of segments are minima of block minima. Items
are the stated query set: they are broadcast in passes of bounded size. Documents are not shuffled at all.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, _odd, mix, prepare, slices, table

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.999
#: MinHash values; shingles in a block; blocks in a segment are half of the largest item size of a group.
HASHES, BLOCK = 96, 8
#: Items with fewer shingles are looked up shingle by shingle.
LEAST_SHINGLES = 4
#: Items that are broadcast at once.
ITEMS_A_PASS = 20_000


class Family:
    """MinHash values of 32 bits: enough to propose, as the exact sets decide."""

    def __init__(self, size: int = HASHES, seed: int = 6):
        rng = np.random.default_rng(seed)
        draw = lambda: rng.integers(0, 1 << 31, size, dtype=np.uint32)
        self.a, self.b = draw() * np.uint32(2) + np.uint32(1), draw() * np.uint32(2)

    def minima(self, values: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """A row of minima for each hash, a column for each run of values."""
        out = np.empty((len(self.a), len(begins)), np.uint32)
        high, moved = (values >> np.uint64(32)).astype(np.uint32), np.empty(len(values), np.uint32)
        for k in range(len(self.a)):
            np.multiply(high, self.a[k], out=moved)
            moved += self.b[k]
            np.minimum.reduceat(moved, begins, out=out[k])
        return out


def bands_for(item: int, segment: int, threshold: float, recall: float, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows) for items of `item` shingles at least in segments of `segment` at most: as many rows as the recall allows."""
    similarity = threshold * item / (segment + (1 - threshold) * item)
    for rows in range(8, 1, -1):
        if 1 - (1 - similarity**rows) ** (hashes // rows) >= recall:
            return hashes // rows, rows
    if 1 - (1 - similarity) ** hashes < recall:  # segments are a few times as long as items, so that this does not happen
        raise ValueError(f"{hashes} hashes do not find an item of {item} shingles among {segment} with a chance of {recall}")
    return hashes, 1


def band_hashes(minima: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A row for each band, from minima with a row for each hash."""
    if rows == 1:
        return minima[:bands]
    parts = minima[: bands * rows].reshape(bands, rows, -1).astype(np.uint64)
    acc = parts[:, 0]
    for r in range(1, rows):
        acc = mix(acc * np.uint64(_odd(90 + r)) + parts[:, r])
    return acc


def item_shingles(text: str | None, n: int) -> tuple[int, np.ndarray]:
    """Width of the item's shingles (n, or all its words if it has fewer) and their distinct hashes, sorted."""
    words = Words([text])
    width = min(n, len(words.hash))
    return width, np.unique(words.grams(width)[0][: len(words.hash) - width + 1]) if width else np.zeros(0, np.uint64)


class Index:
    """Items of one pass, ready for lookup."""

    def __init__(self, items: list[tuple[int, str | None]], n: int, threshold: float, recall: float):
        self.n, self.threshold, self.recall, self.family = n, threshold, recall, Family()
        self.sets: list[tuple[int, int, np.ndarray]] = []  # id, width, shingles
        for i, text in items:
            width, own = item_shingles(text, n)
            if width:
                self.sets.append((i, width, own))
        # Short ones by width: sorted shingles and the items that have them.
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        few = [k for k, (_, w, own) in enumerate(self.sets) if w < n or len(own) < LEAST_SHINGLES]
        for width in {self.sets[k][1] for k in few}:
            pairs = sorted((int(h), k) for k in few if self.sets[k][1] == width for h in self.sets[k][2])
            self.short[width] = np.array([h for h, _ in pairs], np.uint64), np.array([k for _, k in pairs])
        self.groups: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # largest size: items and their minima
        grouped: dict[int, list[int]] = {}
        for k, (_, _, own) in enumerate(self.sets):
            if k not in set(few):
                grouped.setdefault(max(8, 1 << len(own).bit_length()), []).append(k)
        for most, own in grouped.items():
            sets = [self.sets[k][2] for k in own]
            self.groups[most] = np.array(own), self.family.minima(np.concatenate(sets), np.cumsum([0, *(len(s) for s in sets[:-1])]))
        self.tables: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}

    def lookup(self, most: int, size: int) -> tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]:
        """Bands, rows and, for each band, sorted hashes and items, for segments of up to `size` shingles."""
        bands, rows = bands_for(max(LEAST_SHINGLES, most // 2), size, self.threshold, self.recall)
        if (most, rows) not in self.tables:
            own, minima = self.groups[most]
            hashes = band_hashes(minima, bands, rows)
            order = np.argsort(hashes, axis=1, kind="stable")
            self.tables[most, rows] = [(hashes[b, order[b]], own[order[b]]) for b in range(bands)]
        return bands, rows, self.tables[most, rows]

    def candidates(self, words: Words, grams: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) pairs that share a band or, for short items, a shingle."""
        found: set[tuple[int, int]] = set()
        for width, (hashes, own) in self.short.items():
            short, inside = (grams, None) if width == self.n else words.grams(width)
            at = np.flatnonzero(_among(hashes, short))
            owner = np.searchsorted(words.first, at, side="right") - 1
            _expand(found, short[at], owner, hashes, own)
        count = np.maximum(np.diff(words.first) - self.n + 1, 0)  # shingles of each text
        full = np.flatnonzero(count)
        if self.groups and len(full):
            blocks = -(-count[full] // BLOCK)
            owner, within = np.repeat(full, blocks), np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            begins = words.first[owner] + within * BLOCK
            # Blocks end where their text's shingles do: the last n - 1 words start none.
            last = words.first[owner] + count[owner]
            edges = np.empty(2 * len(begins), np.int64)
            edges[::2], edges[1::2] = begins, np.minimum(begins + BLOCK, last)
            minima = np.ascontiguousarray(self.family.minima(np.append(grams, np.uint64(0)), edges)[:, ::2])
            self._segments(found, minima, owner, within, count)
        return found

    def _segments(self, found: set, minima: np.ndarray, owner: np.ndarray, within: np.ndarray, count: np.ndarray) -> None:
        have = 1
        for most in sorted(self.groups):
            reach = most // 2
            while have < reach:  # minima over twice as many blocks, within a text
                ends = np.flatnonzero(owner[have:] != owner[:-have])
                kept = minima[:, ends]
                np.minimum(minima[:, :-have], minima[:, have:], out=minima[:, :-have])  # reads ahead of what it writes
                minima[:, ends] = kept
                have *= 2
            stride = reach - -(-most // BLOCK) - 1
            at = np.flatnonzero(within % stride == 0)
            size = np.minimum(reach * BLOCK, count[owner[at]] - within[at] * BLOCK)
            part = np.maximum(8, 1 << np.ceil(np.log2(size)).astype(np.int64))
            for u in np.unique(part):
                mine = at[part == u]
                bands, rows, tables = self.lookup(most, int(u))
                hashes = band_hashes(minima[:, mine], bands, rows)
                for b, (known, own) in enumerate(tables):
                    hit = np.flatnonzero(_among(known, hashes[b]))
                    _expand(found, hashes[b, hit], owner[mine[hit]], known, own)

    def verified(self, words: Words, grams: np.ndarray, candidates: set[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
        """(text, item id, shingles of the item, those in the text) of the pairs at or over the threshold."""
        out, sets = [], {}
        for text, k in sorted(candidates):
            item, width, own = self.sets[k]
            if (text, width) not in sets:
                a, b = words.first[text], words.first[text + 1]
                all_grams = grams if width == self.n else words.grams(width)[0]
                sets = {(text, width): np.unique(all_grams[a : max(a, b - width + 1)])}
            shared = len(np.intersect1d(own, sets[text, width], assume_unique=True))
            if shared >= self.threshold * len(own) - 1e-9:
                out.append((text, item, len(own), shared))
        return out


def _among(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values


def _expand(found: set, values: np.ndarray, owner: np.ndarray, known: np.ndarray, own: np.ndarray) -> None:
    a, b = np.searchsorted(known, values, side="left"), np.searchsorted(known, values, side="right")
    for x, y, t in zip(a.tolist(), b.tolist(), owner.tolist(), strict=True):
        found.update((t, k) for k in own[x:y].tolist())


def find_items(docs: DataFrame, items: DataFrame, n: int = SHINGLE, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, item_id, n_shingles, n_shared, containment: items of `items` (item_id, text) that a text of `docs` (doc_id, text) contains.

    Containment is the share of the item's distinct runs of n words that the whole text has; pairs at `threshold` or over
    it are returned, each once for a row of `docs`. An item of fewer than n words is one run of all its words. Words are
    runs of characters that are not blanks, unchanged. Null and empty texts contain nothing, null and empty
    items are in nothing; repeated rows are found alike. Empty tables give no rows; other columns are not looked at.
    """
    return _search(docs.select("doc_id", "text"), items, n, threshold, recall, False)


def drop_contaminated(docs: DataFrame, items: DataFrame, n: int = SHINGLE, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Rows of `docs`, with all their columns, that contain no item; found as by `find_items`, without a join."""
    return _search(docs, items, n, threshold, recall, True)


def _search(docs: DataFrame, items: DataFrame, n: int, threshold: float, recall: float, clean: bool) -> DataFrame:
    spark = docs.sparkSession
    prepare(spark)
    passes = max(1, math.ceil(items.count() / ITEMS_A_PASS))
    keyed = items.select("item_id", "text").withColumn("pass", F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)))
    found = None
    for p in range(passes):
        index = Index([(r["item_id"], r["text"]) for r in keyed.where(F.col("pass") == p).collect()], n, threshold, recall)
        cast = spark.sparkContext.broadcast(index)

        def search(batches, cast=cast):
            index = cast.value
            for batch in batches:
                texts, rows, at = batch["text"].to_pylist(), [], np.zeros(0, np.int64)
                for a, b in slices(texts):
                    words = Words(texts[a:b])
                    grams, _ = words.grams(n)
                    rows += [(a + t, *rest) for t, *rest in index.verified(words, grams, index.candidates(words, grams))]
                at = np.array([r[0] for r in rows], np.int64)
                if clean:
                    keep = np.ones(len(texts), bool)
                    keep[at] = False
                    yield batch.filter(pa.array(keep))
                    continue
                columns = [batch["doc_id"].take(pa.array(at)), *(pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2, 3)), pa.array([r[3] / r[2] for r in rows], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "n_shingles", "n_shared", "containment"])

        if clean:
            docs = docs.mapInArrow(search, docs.schema)
        else:
            part = docs.mapInArrow(search, "doc_id long, item_id long, n_shingles long, n_shared long, containment double")
            found = part if found is None else found.unionAll(part)
    return docs if clean else found


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    """Benchmark items in documents, a row a pair; nulls, repeated rows and empty tables as in `find_items`."""
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
ORACLE_SQL = rf"""
WITH item AS (SELECT item_id, {_WORDS} AS words FROM benchmark),
  width AS (SELECT item_id, words, least({SHINGLE}, len(words)) AS w FROM item WHERE len(words) > 0),
  wanted AS (SELECT DISTINCT item_id, w, array_to_string(list_slice(words, i, i + w - 1), ' ') AS shingle FROM (SELECT *, unnest(range(1, len(words) - w + 2)) AS i FROM width)),
  sizes AS (SELECT item_id, count(*) AS n_shingles FROM wanted GROUP BY item_id),
  doc AS (SELECT doc_id, {_WORDS} AS words FROM documents),
  had AS (SELECT doc_id, w, array_to_string(list_slice(words, i, i + w - 1), ' ') AS shingle
    FROM (SELECT doc_id, words, w, unnest(range(1, len(words) - w + 2)) AS i FROM doc, (SELECT DISTINCT w FROM width))),
  shared AS (SELECT doc_id, item_id, count(DISTINCT shingle) AS n_shared FROM had JOIN wanted USING (w, shingle) GROUP BY ALL)
SELECT doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles AS containment FROM shared JOIN sizes USING (item_id) WHERE n_shared >= {THRESHOLD} * n_shingles
"""
