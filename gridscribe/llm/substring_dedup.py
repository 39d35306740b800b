"""Duplicate spans by relative Lempel-Ziv parsing (Kuruppu, Puglisi and Zobel, 2010) against an index of reference blocks.

The reference is the corpus before a place: texts with smaller ids, and the same text up to there. It is cut into
blocks by content: of each run of `window` words, the g-gram with the least hash is its anchor, and a block is
the runs in a row that share one anchor. Equal runs have equal anchors wherever they stand. The reference keeps each distinct block,
and each distinct run of blocks that differ, once: at its first place. So each run of a text has one place in the reference, or none.

1. Anchors that occur once cannot start a factor. A first pass counts anchors; a sieve of those that
   repeat keeps the rest from being shuffled.
2. Every block is looked up in the index. One with an earlier equal matches as a whole, from its first run to its last.
3. Where a block differs from all earlier ones, a factor's boundary lies in it: each of its runs is
   checked by itself against the runs of the blocks with the same anchor.
4. Each text is parsed greedily from left to right (`parse`): a factor begins at the first run with a place in the reference and is
   extended run by run, word by word that is, as long as the reference goes on at the next place; it is a
   triple of where it begins, how long it is, and the source that it copies. Words without a factor are literals.

Both lookups are aggregates with map-side combining and joins on a key of 128 bits (anchor and content hashed apart),
so a passage that a third of all documents share is no task's burden alone. Of the texts, only those with a
factor move, once, to meet them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import build_sieve
from .common import Words, mix, prepare, slices, stored, table

WINDOW, GRAM = 20, 8


def blocks_of(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """first run (a word index), number of runs and anchor hash of each block; and the hash of the run at each word."""
    grams, _ = words.grams(gram, seed=21)
    runs, inside = words.grams(window, seed=22)
    reach = window - gram + 1  # grams of a run
    starts = np.flatnonzero(inside)
    if not len(starts):
        return starts, starts, np.zeros(0, np.uint64), runs
    order = mix(grams, 23)  # which gram is least must not depend on the text's own order
    least, at = _least_in_reach(order, reach)
    anchor = at[starts]
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)]
    first = np.flatnonzero(new)
    return starts[first], np.diff(np.r_[first, len(starts)]), grams[anchor[first]], runs


def _least_in_reach(values: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Least of each `reach` values in a row, and the first place it has there; ends are cut short."""
    n = len(values)
    least, at, have = values.copy(), np.arange(n), 1
    while have < reach:
        step = min(have, reach - have)
        if n > step:
            other, place = least[step:], at[step:]
            better = other < least[:-step]
            least[:-step], at[:-step] = np.where(better, other, least[:-step]), np.where(better, place, at[:-step])
        have += step
    return least, at


def _content(first: np.ndarray, count: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Hash of all runs of each block, in their order."""
    total = np.zeros(len(first), np.uint64)
    for k in range(int(count.max(initial=0))):
        on = count > k
        total[on] = mix(total[on] + runs[first[on] + k], 24)
    return mix(total + count.astype(np.uint64), 25)


LAST = (1 << 63) - 1


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, id (null as the largest one) and twin: tells texts that share an id apart, 0 where none do."""
    rows = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(LAST)).alias("id"))
    shared = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    return rows.withColumn("twin", F.xxhash64("text") if shared else F.lit(0).cast("long"))


def _place_key(*parts: np.ndarray) -> np.ndarray:
    acc = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        acc = mix(acc + p.astype(np.int64).view(np.uint64), 26)
    return acc


def _key_rows(df: DataFrame, *names: str) -> DataFrame:
    def keys(batches):
        for b in batches:
            key = _place_key(*(b[n].to_numpy(zero_copy_only=False) for n in names))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], names=["key"])

    return df.select(*names).mapInArrow(keys, "key long")


def duplicate_runs(keyed: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """id, twin, matches (at, runs, from_id, from_twin, from_at: so many runs as there) for each row of `_keyed` rows that has any; no more than the text has blocks and runs."""
    spark = keyed.sparkSession
    prepare(spark)
    rows = keyed.where(F.length("text") >= 2 * window - 1).select("id", "twin", "text")

    def anchors(batches):
        for batch in batches:
            texts = batch["text"].to_pylist()
            for a, b in slices(texts):
                _, _, anchor, _ = blocks_of(Words(texts[a:b]), window, gram)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64))], names=["anchor"])

    counted = rows.select("text").mapInArrow(anchors, "anchor long").groupBy("anchor").agg(F.count("*").alias("n"))
    repeated = spark.sparkContext.broadcast(build_sieve(stored(counted.where("n > 1").select("anchor"))))

    def parsed(batches):
        """For each step of texts: ids, twins, first words, runs in each block, anchors, contents, run hashes at the blocks."""
        for batch in batches:
            texts, ids, twins = batch["text"].to_pylist(), batch["id"].to_numpy(), batch["twin"].to_numpy()
            for a, b in slices(texts):
                words = Words(texts[a:b])
                first, count, anchor, runs = blocks_of(words, window, gram)
                keep = repeated.value.passes(anchor)
                first, count, anchor = first[keep], count[keep], anchor[keep]
                owner = np.searchsorted(words.first, first, side="right") - 1
                yield ids[a + owner], twins[a + owner], first - words.first[owner], count, anchor, _content(first, count, runs), first, runs

    def blocks(batches):
        for *columns, _, _ in parsed(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], names=["id", "twin", "at", "n", "anchor", "content"])

    placed = stored(rows.mapInArrow(blocks, "id long, twin long, at long, n long, anchor long, content long"))
    # The least struct is the first place.
    index = stored(placed.groupBy("anchor", "content").agg(F.min(F.struct("id", "at", "twin")).alias("first"), F.count("*").alias("places")))
    later = (F.col("id") != F.col("first.id")) | (F.col("at") != F.col("first.at"))
    copies = placed.join(index.where("places > 1").select("anchor", "content", "first"), ["anchor", "content"]).where(later)
    whole = copies.select("id", "twin", "at", F.col("n").alias("runs"), "first")

    # Boundaries: the first places of blocks whose anchor has other blocks too, run by run.
    several = index.groupBy("anchor").agg(F.count("*").alias("blocks")).where("blocks > 1").select("anchor")
    edges = _key_rows(index.join(several, "anchor").select("anchor", "content", "first.*"), "id", "twin", "at", "anchor", "content")
    wanted = spark.sparkContext.broadcast(build_sieve(stored(edges)))

    def runs_of(batches):
        for ids, twins, at, count, anchor, content, first, runs in parsed(batches):
            on = wanted.value.passes(_place_key(ids, twins, at, anchor.view(np.int64), content.view(np.int64)))
            total = int(count[on].sum())
            inner = np.arange(total) - np.repeat(np.cumsum(count[on]) - count[on], count[on])
            spread = lambda c: np.repeat(c[on], count[on])
            columns = [spread(ids), spread(twins), spread(at) + inner, spread(anchor), runs[spread(first) + inner]]
            yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], names=["id", "twin", "at", "anchor", "run"])

    single = stored(rows.mapInArrow(runs_of, "id long, twin long, at long, anchor long, run long"))
    # Stored, so that the join has an exchange on either side and Spark can split a run that very many texts have.
    earliest = stored(single.groupBy("anchor", "run").agg(F.min(F.struct("id", "at", "twin")).alias("first"), F.count("*").alias("places")).where("places > 1").drop("places"))
    checked = single.join(earliest, ["anchor", "run"]).where(later).select("id", "twin", "at", F.lit(1).cast("long").alias("runs"), "first")

    match = F.struct(F.col("at").cast("int").alias("at"), F.col("runs").cast("int").alias("runs"), F.col("first.id").alias("from_id"), F.col("first.twin").alias("from_twin"), F.col("first.at").cast("int").alias("from_at"))
    return whole.unionByName(checked).groupBy("id", "twin").agg(F.collect_list(match).alias("matches"))


def parse(owner: np.ndarray, at: np.ndarray, runs: np.ndarray, from_id: np.ndarray, from_twin: np.ndarray, from_at: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Greedy factors of texts, from their matches: owner, begin, end (words, exclusive), source id, source at; by owner, then by begin.

    Matches have each run of a text once at most. From left to right, a factor takes in the next match if that begins at the run behind it, both
    here and in the source. Factors overlap by fewer than `window` words, where the last run of one and the first of the next share words.
    """
    order = np.lexsort((at, owner))
    owner, at, runs, from_id, from_twin, from_at = (x[order] for x in (owner, at, runs, from_id, from_twin, from_at))
    same = lambda x: x[1:] == x[:-1]
    goes_on = same(owner) & same(from_id) & same(from_twin) & same(from_at - at) & (at[1:] == at[:-1] + runs[:-1])
    first = np.flatnonzero(np.r_[True, ~goes_on][: len(at)])
    last = np.r_[first[1:], len(at)][: len(first)] - 1
    return owner[first], at[first], at[last] + runs[last] - 1 + window, from_id[first], from_at[first]


def joined_spans(owner: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of words that lie in a factor, apart from one another: owner, begin, end. Ends of a text's factors ascend as their begins do."""
    first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (begin[1:] > end[:-1])][: len(owner)])
    return owner[first], begin[first], end[np.r_[first[1:], len(owner)][: len(first)] - 1]


def _lists(owner: np.ndarray, texts: int, **columns: pa.Array) -> pa.ListArray:
    """A list of structs for each text, from columns sorted by owner."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(texts + 1)), pa.int32()), pa.StructArray.from_arrays(list(columns.values()), names=list(columns)))


def remove_duplicate_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): doc_id, n_words, n_removed, kept (the words left, joined by one blank), spans, factors.

    `factors` are those of the greedy parse, with the source that each copies; `spans` are the words in them. A word goes if a run of `window` words over it also starts earlier: in a text with a smaller id, or in
    the same text. Words are runs of characters that are not blanks, unchanged. Null and empty texts have no words.
    Rows that share an id are one document as to order: neither is earlier where both start at one word. Null ids
    come last, and as a source they are null. An empty table gives no rows; other columns are not looked at.
    """
    keyed = _keyed(docs)
    found = stored(duplicate_runs(keyed, window, gram))
    sieve = keyed.sparkSession.sparkContext.broadcast(build_sieve(stored(_key_rows(found, "id", "twin"))))

    def parted(marked: bool):
        """Rows that may have spans, or those that surely have none."""

        def part(batches):
            for b in batches:
                is_in = sieve.value.passes(_place_key(b["id"].to_numpy(), b["twin"].to_numpy()))
                yield b.filter(pa.array(is_in == marked))

        return keyed.mapInArrow(part, keyed.schema)

    def cut(batches):
        for batch in batches:
            rows, matches = batch.num_rows, batch["matches"]
            flat, of = matches.flatten(), pc.list_parent_indices(matches).to_numpy().astype(np.int64)
            columns = [flat.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("at", "runs", "from_id", "from_twin", "from_at")]
            owner, begin, end, source, source_at = parse(of, *columns, window)
            spans = joined_spans(owner, begin, end)
            edges = np.searchsorted(spans[0], np.arange(rows + 1))
            n_words, n_removed, kept = np.zeros(rows, np.int64), np.zeros(rows, np.int64), []
            for k, text in enumerate(batch["text"]):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()  # bytes: parts at the six ASCII blanks alone
                left, done = [], 0
                for a, b in zip(spans[1][edges[k] : edges[k + 1]].tolist(), spans[2][edges[k] : edges[k + 1]].tolist(), strict=True):
                    left += words[done:a]
                    done = b
                left += words[done:]
                n_words[k], n_removed[k] = len(words), len(words) - len(left)
                kept.append(b" ".join(left))
            named = _lists(spans[0], rows, begin=pa.array(spans[1]), end=pa.array(spans[2]))
            factors = _lists(owner, rows, begin=pa.array(begin), end=pa.array(end), source_id=pa.array(source, mask=source == LAST), source_at=pa.array(source_at))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n_words), pa.array(n_removed), pa.array(kept, pa.binary()).cast(pa.string()), named, factors], names=["doc_id", "n_words", "n_removed", "kept", "spans", "factors"])

    met = parted(True).join(found, ["id", "twin"], "left").select("doc_id", "text", "matches")
    free = parted(False).select("doc_id", "text", F.lit(None).cast(found.schema["matches"].dataType).alias("matches"))
    schema = "doc_id long, n_words long, n_removed long, kept string, spans array<struct<begin: long, end: long>>, factors array<struct<begin: long, end: long, source_id: long, source_at: long>>"
    return met.mapInArrow(cut, schema).unionAll(free.mapInArrow(cut, schema))


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of documents; nulls, ties and repeated rows as in `remove_duplicate_spans`."""
    found = remove_duplicate_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = rf"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), runs AS (
  SELECT doc_id, i, array_to_string(list_slice(words, i, i + {WINDOW - 1}), ' ') AS run
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM split)
), late AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS k FROM runs) WHERE k > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS i FROM late
), each AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM split
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS words FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT s.doc_id, len(s.words)::BIGINT AS n_words, (len(s.words) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.words, '')) AS kept_sha256
FROM split s LEFT JOIN kept k USING (doc_id)
"""
