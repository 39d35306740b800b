"""N-gram Jaccard join by MinHash banding (Broder, 1997; Leskovec, Rajaraman and Ullman, ch. 3).

1. Each text becomes the set of its runs of `n` words. Texts of one set are one class.
2. Per class, `bands x rows` minima of hashed shingles; bands and rows are chosen for the recall asked for at the
   threshold. Classes that share a band hash, a bucket, are candidates. Bands that no other class has are told by a sieve and not shuffled.
3. A bucket is never expanded into pairs. Each class follows one leader, the least class of all its buckets, and
   full shingle sets are shuffled once, to their leader's group: there, near copies meet once and not in every bucket that they share. Pairs of
   different leaders are verified in the least bucket that they share, for those buckets alone that hold several leaders.
4. Groups and buckets are dealt in tiles of bounded size (block x block); each tile compares whole sets exactly and returns a
   count of links per class and a spanning forest of the links, not the links themselves. Classes are connected
   components of verified links; what was a candidate only connects nothing.

Nothing is capped: a large group has more tiles, each of the same size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import build_sieve
from .common import Words, _odd, mix, prepare, shielded, slices, stored, table
from .components import connected_components

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.999
#: A tile has about twice as many classes, and about twice as many bytes of shingles, at most.
BLOCK_CLASSES, BLOCK_BYTES = 128, 16 << 20
#: Copies from which on a class is hot, and the parts that the rows of hot classes are joined in.
HOT_COPIES, HOT_PARTS = 64, 64


def choose_bands(threshold: float, recall: float, most_hashes: int = 144) -> tuple[int, int]:
    """Most selective (bands, rows) that find a pair at the threshold with the given chance: as many rows as the hashes allow."""
    best = (most_hashes, 1)
    for rows in range(1, most_hashes + 1):
        hit = threshold**rows
        bands = math.ceil(math.log(1 - recall) / math.log1p(-hit)) if hit < 1 else 1
        if bands * rows > most_hashes:
            break
        best = (bands, rows)
    return best


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's runs of n words; of all its words if it has fewer; empty for no word."""
    words = Words(texts)
    grams, inside = words.grams(n)
    out = []
    for a, b in zip(words.first, words.first[1:], strict=False):
        if b - a >= n:
            own = np.unique(grams[a : b - n + 1])
        elif b > a:
            acc = np.array([_odd(int(b - a))], np.uint64)
            for k in range(a, b):
                acc = acc * np.uint64(_odd(7)) + words.hash[k : k + 1]
            own = mix(acc, 9)
        else:
            own = np.zeros(0, np.uint64)
        out.append(own)
    return out


def set_name(own: np.ndarray) -> bytes | None:
    """16 bytes that name a set: two independent sums over its members."""
    if not len(own):
        return None
    parts = [mix(mix(own, seed).sum(keepdims=True) + np.uint64(len(own)), seed + 1) for seed in (31, 41)]
    return np.concatenate(parts).tobytes()


class MinHash:
    def __init__(self, bands: int, rows: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        draw = lambda: rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
        self.bands, self.rows, self.a, self.b = bands, rows, draw() * np.uint64(2) + np.uint64(1), draw() * np.uint64(2)

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row of minima per (not empty) set."""
        joined = np.concatenate(sets)
        begins = np.cumsum([0, *(len(s) for s in sets[:-1])])
        out = np.empty((len(sets), len(self.a)), np.uint64)
        high = joined ^ (joined >> np.uint64(32))
        for k in range(len(self.a)):
            out[:, k] = np.minimum.reduceat(high * self.a[k] + self.b[k], begins)
        return out

    def band_hashes(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row of 64-bit band hashes per set; a hash tells bands apart."""
        minima = mix(self.signatures(sets), 3).reshape(len(sets), self.bands, self.rows)
        acc = np.broadcast_to(mix(np.arange(self.bands, dtype=np.uint64), 8), minima.shape[:2]).copy()
        for r in range(self.rows):
            acc = mix(acc * np.uint64(_odd(77)) + minima[:, :, r], 12)
        return acc


def _row_key(doc_id, name: bytes) -> int:
    """64 bits of a class and the document that stands for it."""
    low = int.from_bytes(name[:8], "little") ^ ((0 if doc_id is None else doc_id + 1) * 0x9E3779B97F4A7C15 & ((1 << 64) - 1))
    return low - (1 << 64) if low >> 63 else low


def jaccard_join(docs: DataFrame, n: int = SHINGLE, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): doc_id, class_id, n_links, n_copies, n_shingles.

    n_links: number of other rows whose shingle set has a Jaccard similarity of `threshold` at least; n_copies: those
    among them with the very same set; class_id: least doc_id of the rows that links connect, directly or
    through others. Links are verified on full sets; banding proposes a pair with chance `recall` at the
    threshold, more above it, and pairs that follow one leader are all verified whether banding proposed them
    or not.

    Words are runs of characters that are not blanks, unchanged. A text of fewer than n words is one shingle. Null and empty
    texts have none: no links, their class is their own id. Null ids are classed like others and come
    last; repeated rows are copies. An empty table gives no rows; other columns are not looked at.
    """
    rows, found = _classed(docs, n, threshold, recall)
    return _joined(rows, found, "left").select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("n_copies", F.lit(0)).cast("long").alias("n_copies"),
        "n_shingles",
    )


@shielded
def keep_one(docs: DataFrame, n: int = SHINGLE, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """`docs` with one row of each class of `jaccard_join`: its least doc_id, then least text hash. Columns stay.

    Texts without a word are in no class and stay. Of rows with one id and one text, one stays. Rows that no one
    could drop are told by a sieve and do not move; the others meet the list of dropped rows.
    """
    rows, found = _classed(docs, n, threshold, recall)
    named = rows.where("name is not null").select(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("__id"), "__hash", "name")
    known = stored(_joined(named, found, "inner").select("__id", "__hash", "root"))
    # Stored, as below: a join with an exchange on either side is one that Spark can split for a very large class.
    first = stored(known.groupBy("root").agg(F.min(F.struct("__id", "__hash")).alias("first")))
    each = known.groupBy("root", "__id", "__hash").agg(F.count("*").alias("n")).join(first, "root")
    is_first = (F.col("__id") == F.col("first.__id")) & (F.col("__hash") == F.col("first.__hash"))
    marked = stored(each.select("__id", "__hash", F.when(is_first, "twice").otherwise("gone").alias("__mark"), "n").where("__mark = 'gone' or n > 1").drop("n"))

    def keys(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_id_key(b).view(np.int64))], names=["key"])

    sieve = docs.sparkSession.sparkContext.broadcast(build_sieve(marked.select("__id", "__hash").mapInArrow(keys, "key long")))
    keyed = docs.withColumns({"__id": F.coalesce("doc_id", F.lit((1 << 63) - 1)), "__hash": F.xxhash64("text")})

    def parted(maybe: bool):
        def part(batches):
            for b in batches:
                yield b.filter(pa.array(sieve.value.passes(_id_key(b)) == maybe))

        return keyed.mapInArrow(part, keyed.schema)

    met = parted(True).join(marked, ["__id", "__hash"], "left")
    left = met.where("__mark is null").unionByName(met.where("__mark = 'twice'").dropDuplicates(["__id", "__hash"]))
    return left.select(*docs.columns).unionAll(parted(False).select(*docs.columns))


def _id_key(batch: pa.RecordBatch) -> np.ndarray:
    ids, hashes = (batch[c].to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in ("__id", "__hash"))
    return mix(mix(ids, 51) + hashes, 52)


def _classed(docs: DataFrame, n: int, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """doc_id, __hash, name, n_shingles of every row; and name, root, class_id, n_links, n_copies of every class."""
    spark = docs.sparkSession
    prepare(spark)
    minhash = MinHash(*choose_bands(threshold, recall))

    def sketch(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            names, counts, bands = [], [], []
            for a, b in slices(texts):
                sets = shingle_sets(texts[a:b], n)
                full = [s for s in sets if len(s)]
                hashes = iter(minhash.band_hashes(full).view(np.int64).tolist() if full else [])
                names += [set_name(s) for s in sets]
                counts += [len(s) for s in sets]
                bands += [next(hashes) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("__hash"), pa.array(names, pa.binary()), pa.array(counts, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "__hash", "name", "n_shingles", "bands"])

    narrow = docs.select("doc_id", "text", F.xxhash64("text").alias("__hash"))
    rows = stored(narrow.mapInArrow(sketch, "doc_id long, __hash long, name binary, n_shingles long, bands array<long>"))
    classes = stored(
        rows.where("name is not null").groupBy("name").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("bands").alias("bands"))
    )
    links = _links(narrow.drop("__hash"), classes, n, threshold)

    found = classes.join(links, "name", "left").withColumn("root", F.coalesce("root", "name"))
    found = stored(found.drop("bands"))
    least = stored(found.groupBy("root").agg(F.min("first_id").alias("class_id")))
    found = stored(found.join(least, "root").select("name", "root", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), (F.col("copies") - 1).alias("n_copies")))
    return rows.select("doc_id", "__hash", "name", "n_shingles"), found


def _name_keys(df: DataFrame) -> DataFrame:
    """The first eight bytes of each name as a long."""

    def keys(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_leading(b["name"]).view(np.int64))], names=["key"])

    return df.select("name").mapInArrow(keys, "key long")


def _leading(names: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x[:8] if x else bytes(8) for x in names.to_pylist()), np.uint64)


def _joined(rows: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Rows with the columns of their class. Rows of hot classes, told by a sieve of their names, are joined in parts, so that no task has all copies of a text; rows without a class, which meet nothing, likewise."""
    hot = stored(_name_keys(found.where(F.col("n_copies") >= HOT_COPIES - 1)))
    sieve = rows.sparkSession.sparkContext.broadcast(build_sieve(hot))

    def mark(batches):
        for b in batches:
            yield b.append_column("__hot", pa.array(sieve.value.passes(_leading(b["name"])) if sieve.value.bits is not None and b.num_rows else np.zeros(b.num_rows, bool)))

    def marked(df: DataFrame) -> DataFrame:
        return df.mapInArrow(mark, df.withColumn("__hot", F.lit(True)).schema)

    of_row = F.when(F.col("__hot") | F.col("name").isNull(), F.pmod(F.xxhash64(*(c for c in rows.columns if c != "name")), F.lit(HOT_PARTS))).otherwise(0)
    parts = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(HOT_PARTS - 1))).otherwise(F.array(F.lit(0)))
    left = marked(rows).withColumn("__part", of_row.cast("int")).drop("__hot")
    right = marked(found).withColumn("__part", F.explode(parts)).drop("__hot")
    return left.join(right, ["name", "__part"], how).drop("__part")


def _followers(classes: DataFrame) -> DataFrame:
    """name, leader, buckets (those with other classes in them) for every class that shares a bucket with another; leader: the least class of all these buckets."""
    counted = classes.select(F.explode("bands").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    repeated = classes.sparkSession.sparkContext.broadcast(build_sieve(stored(counted.where("n > 1").select("bucket"))))

    def shared(batches):
        for b in batches:
            bands = b["bands"]
            buckets, owner = bands.flatten(), pc.list_parent_indices(bands)
            keep = pa.array(repeated.value.passes(buckets.to_numpy().view(np.uint64)))
            yield pa.RecordBatch.from_arrays([b["name"].take(owner.filter(keep)), buckets.filter(keep)], names=["name", "bucket"])

    members = stored(classes.select("name", "bands").mapInArrow(shared, "name binary, bucket long"))
    # Stored, as elsewhere: a join with an exchange on either side is one that Spark can split for a very large bucket.
    least = stored(members.groupBy("bucket").agg(F.min("name").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n"))
    return stored(members.join(least, "bucket").groupBy("name").agg(F.min("least").alias("leader"), F.collect_list("bucket").alias("buckets")))


def _jobs(followers: DataFrame, classes: DataFrame) -> DataFrame:
    """name, first_id, copies, leader, place (a group's leader or a bucket), bucket (null in groups), bands, blocks: where each class is to be compared."""
    known = stored(followers.join(classes.select("name", "first_id", "copies", F.col("n_shingles") * 8, "bands").toDF("name", "first_id", "copies", "bytes", "bands"), "name"))

    def blocks(key: str, df: DataFrame) -> DataFrame:
        size = df.groupBy(key).agg(F.count("*").alias("n"), F.sum("bytes").alias("all"), F.min("leader").alias("low"), F.max("leader").alias("high"))
        count = F.greatest(F.ceil(F.col("n") / BLOCK_CLASSES), F.ceil(F.col("all") / BLOCK_BYTES)).cast("int")
        return stored(size.where("n > 1").select(key, count.alias("blocks"), "low", "high"))

    columns = ["name", "first_id", "copies", "leader", "place", "bucket", "bands", "blocks"]
    groups = known.join(blocks("leader", known).select("leader", "blocks"), "leader").withColumns({"place": F.col("leader"), "bucket": F.lit(None).cast("long"), "bands": F.lit(None).cast("array<long>")})
    spread = known.withColumn("bucket", F.explode("buckets"))
    several = blocks("bucket", spread).where("low <> high").select("bucket", "blocks")
    across = spread.join(several, "bucket").withColumn("place", F.unhex(F.lpad(F.hex("bucket"), 16, "0")))  # eight bytes, where a leader has sixteen
    return stored(groups.select(*columns).unionByName(across.select(*columns)))


def _links(narrow: DataFrame, classes: DataFrame, n: int, threshold: float) -> DataFrame:
    """name, links (rows, copies counted), root for every class with a link to another class."""
    spark = narrow.sparkSession
    jobs = _jobs(_followers(classes), classes)

    def keys(batches):
        for batch in batches:
            own = [_row_key(i, x) for i, x in zip(batch["first_id"].to_pylist(), batch["name"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64())], names=["key"])

    sieve = spark.sparkContext.broadcast(build_sieve(stored(jobs.select("first_id", "name").distinct().mapInArrow(keys, "key long"))))

    def sets_of_candidates(batches):
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for a, b in slices(texts):
                sets = shingle_sets(texts[a:b], n)
                names = [set_name(s) for s in sets]
                keys = np.array([_row_key(i, x) if x else 0 for i, x in zip(ids[a:b], names, strict=True)], np.int64)
                keep = np.flatnonzero(sieve.value.passes(keys.view(np.uint64)) & np.array([x is not None for x in names]))
                yield pa.RecordBatch.from_arrays([pa.array([ids[a + i] for i in keep], pa.int64()), pa.array([names[i] for i in keep], pa.binary()), pa.array([sets[i].tobytes() for i in keep], pa.binary())], names=["first_id", "name", "shingles"])

    shipped = narrow.mapInArrow(sets_of_candidates, "first_id long, name binary, shingles binary")
    whole = shipped.join(jobs.withColumnRenamed("first_id", "stands"), "name").where(F.col("first_id").eqNullSafe(F.col("stands")))
    block = F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int")
    dealt = whole.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = dealt.select("place", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "name", "copies", "leader", "bucket", "bands", "shingles")

    def verify(group: pa.Table) -> pa.Table:
        return verified(group, threshold)

    found = stored(tiles.groupBy("place", "i", "j").applyInArrow(verify, "name binary, links long, root binary"))
    counts = found.groupBy("name").agg(F.sum("links").alias("links"), F.min("root").alias("root"), F.count("*").alias("tiles"))
    if (counts.agg(F.max("tiles")).first()[0] or 1) == 1:
        return counts.drop("tiles")  # every class was linked in one tile, so its roots are final
    roots = connected_components(found, "name", "root").select(F.col("node").alias("name"), F.col("component").alias("root"))
    return counts.drop("root", "tiles").join(roots, "name")


def verified(group: pa.Table, threshold: float) -> pa.Table:
    """Links of one tile: for each class with any, the rows it links to and the least class of its part of the forest."""
    group = group.take(pc.index_in(group["name"].unique(), group["name"]))  # a repeated row is one class
    names, copies = group["name"].to_pylist(), group["copies"].to_numpy()
    sets = [np.frombuffer(s, np.uint64) for s in group["shingles"].to_pylist()]
    block = group["block"].to_numpy()
    crossed = group["i"][0].as_py() != group["j"][0].as_py()
    wanted = block[:, None] != block[None, :] if crossed else np.ones((len(names), len(names)), bool)
    if group["bucket"][0].is_valid:  # pairs of different leaders that share no lesser bucket
        leader = np.unique(np.array(group["leader"].to_pylist(), dtype=object), return_inverse=True)[1]
        bands = np.array(group["bands"].to_pylist(), np.int64)
        before = int(np.flatnonzero(bands[0] == group["bucket"][0].as_py())[0])
        wanted &= leader[:, None] != leader[None, :]
        for k in range(before):
            wanted &= bands[:, k, None] != bands[None, :, k]
    linked = similar(sets, threshold) & wanted if wanted.any() else wanted
    weights = linked.astype(np.int64) @ copies
    order = np.argsort(np.array(names, dtype=object), kind="stable")
    rank = np.empty(len(names), np.int64)
    rank[order] = np.arange(len(names))
    while True:  # least rank over neighbours, until nothing changes; then pointers are halved
        least = np.where(linked, rank[None, :], len(names)).min(axis=1, initial=len(names))
        now = np.minimum(rank, least)
        now = np.minimum(now, now[order[now]])
        if (now == rank).all():
            break
        rank = now
    keep = np.flatnonzero(weights)
    return pa.table({"name": pa.array([names[i] for i in keep], pa.binary()), "links": pa.array(weights[keep], pa.int64()), "root": pa.array([names[order[rank[i]]] for i in keep], pa.binary())})


def similar(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of different sets have a Jaccard similarity of the threshold at least."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    common = np.zeros((n, n), np.int64)
    if n <= 24:
        for i in range(n):
            for j in range(i):
                if min(size[i], size[j]) >= threshold * max(size[i], size[j]):
                    common[i, j] = common[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:
        common = _common(sets, size)
    # integers: 5 * common >= 4 * union for 0.8, without rounding
    ratio = threshold.as_integer_ratio() if threshold * 1000 != round(threshold * 1000) else (round(threshold * 1000), 1000)
    union = size[:, None] + size[None, :] - common
    out = common * ratio[1] >= union * ratio[0]
    np.fill_diagonal(out, False)
    return out


def _common(sets: list[np.ndarray], size: np.ndarray) -> np.ndarray:
    """Sizes of all intersections: shingles in few sets are counted as pairs, the others by products of 0-1 matrices."""
    n = len(sets)
    owner, value = np.repeat(np.arange(n), size), np.concatenate(sets)
    order = np.argsort(value, kind="stable")
    owner, value = owner[order], value[order]
    begins = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
    often = np.diff(np.r_[begins, len(value)])
    flat = np.zeros(n * n, np.int64)
    for d in range(2, 9):
        at = begins[often == d]
        for step in range(0, len(at), 1 << 16):
            own = owner[at[step : step + (1 << 16), None] + np.arange(d)]
            for x in range(d):
                for y in range(x):
                    flat += np.bincount(own[:, x] * n + own[:, y], minlength=n * n)
    common = flat.reshape(n, n)
    common = common + common.T
    wide = np.flatnonzero(often > 8)
    for step in range(0, len(wide), 2048):
        part = wide[step : step + 2048]
        has = np.zeros((n, len(part)), np.float32)
        for k, w in enumerate(part):
            has[owner[begins[w] : begins[w] + often[w]], k] = 1
        common += (has @ has.T).astype(np.int64)
    return common


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """doc_id, class_id, n_links, n_copies, n_shingles of every row of documents; nulls, repeated rows and empty tables as in `jaccard_join`."""
    return jaccard_join(table(spark, sf_dir, "documents"))


ORACLE_SQL = rf"""
WITH RECURSIVE doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
  shingles AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(list_slice(words, i, i + w - 1), ' ') AS shingle
    FROM (SELECT doc_id, words, w, unnest(range(1, len(words) - w + 2)) AS i FROM (SELECT *, least({SHINGLE}, len(words)) AS w FROM doc WHERE len(words) > 0))),
  sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
  shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
  links AS MATERIALIZED (SELECT a, b, shared.n = x.n AND x.n = y.n AS alike FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 10 * shared.n >= {round(10 * THRESHOLD)} * (x.n + y.n - shared.n)),
  reach AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.node),
  classes AS (SELECT node AS doc_id, min(root) AS class_id FROM reach GROUP BY node),
  counts AS (SELECT a AS doc_id, count(*) AS n_links, count(*) FILTER (alike) AS n_copies FROM links GROUP BY a)
SELECT c.doc_id, class_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(n_copies, 0)::BIGINT AS n_copies, coalesce(s.n, 0)::BIGINT AS n_shingles
FROM classes c LEFT JOIN counts USING (doc_id) LEFT JOIN sizes s USING (doc_id)
"""
