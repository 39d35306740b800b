"""URL filtering by a cascade of Bloom filters (Larisch et al., CRLite, 2017).

A listed key and an unlisted key of the same corpus are told apart exactly, without a join: level 1
encodes the listed keys; level 2 encodes the unlisted keys of the corpus that level 1 lets through;
level 3 the listed keys that level 2 lets through; and so on until nothing is left over. As the
levels are built over every key of the corpus, the answer is exact for each of them.

Each level is built where the keys are (a task sets bits of its own rows; words of bits are merged by
`bit_or`), and only the finished bits come to the driver, to be broadcast. Their size is known before they are built:
about `ln(2)**-2 * log2(1/p)` bits for each key encoded.

If a cascade would be over `max_bytes`, keys are parted by hash into shards of a fixed size. Each shard's cascade is built by one task from its own
keys, and rows go, in one pass, to where their shard's cascade is: it comes before them in their partition. A key that very many
rows have is dealt over several partitions.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, mix, prepare, shielded, stored, table

#: Largest cascade that one broadcast may hold.
MAX_BYTES = 64 << 20
#: Keys of the corpus in a shard, and partitions that the rows of a shard are dealt over, where one cascade would be too large.
SHARD_KEYS, SHARD_PARTS = 1_000_000, 16
#: Words, between dots and hyphens, of the hosts that the block list of op5 has.
BLOCK_TERMS = ("adult", "bet", "bets", "betting", "casino", "gambling", "jackpot", "lottery", "pills", "poker", "porn", "slots", "viagra", "xxx")
#: Fixed rules of op5: verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def url_host(url: Column) -> Column:
    """From the first :// to the next / ? # or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ? # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (host and subdomains, path by prefix) and its verdict; null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, at, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(prefix)
        name, verdict = F.when(fits, F.lit(at + prefix)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


@dataclass(frozen=True)
class Level:
    """One Bloom filter: bits packed into 64-bit words."""

    bits: np.ndarray
    hashes: int
    salt: int

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.ones(len(h1), bool)
        for at in _positions(h1, h2, self.hashes, self.salt, len(self.bits) * 64):
            out &= (self.bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out


def _positions(h1: np.ndarray, h2: np.ndarray, hashes: int, salt: int, size: int) -> Iterable[np.ndarray]:
    a, b = mix(h1, 2 * salt), mix(h2, 2 * salt + 1) | np.uint64(1)
    for i in range(hashes):
        yield (a + np.uint64(i) * b) % np.uint64(size)


def listed_by(levels: Sequence[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether each key is listed: the parity of the first level that does not hold it."""
    out = np.full(len(h1), len(levels) % 2 == 1)
    open_ = np.arange(len(h1))
    for i, level in enumerate(levels):
        held = level.holds(h1[open_], h2[open_])
        out[open_[~held]] = i % 2 == 1
        open_ = open_[held]
    return out


def survivors(levels: Sequence[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    out = np.ones(len(h1), bool)
    for level in levels:
        out[out] = level.holds(h1[out], h2[out])
    return out


def _unsigned(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).view(np.uint64)


def build_cascade(keys: DataFrame, most_levels: int = 200) -> list[Level]:
    """Cascade over `keys` (h1, h2, listed: one row for each key of the corpus)."""
    spark = keys.sparkSession
    levels: list[Level] = []
    while len(levels) < most_levels:
        cast, encodes = spark.sparkContext.broadcast(list(levels)), len(levels) % 2 == 0

        def left(batches, cast=cast):
            for b in batches:
                keep = survivors(cast.value, _unsigned(b, "h1"), _unsigned(b, "h2"))
                yield b.filter(pa.array(keep))

        rest = keys.mapInArrow(left, keys.schema) if levels else keys
        counted = rest.agg(F.count_if(F.col("listed") == encodes).alias("inside"), F.count_if(F.col("listed") != encodes).alias("outside")).first()
        if levels and not counted["inside"]:
            break  # the last level lets no key of the other kind through
        levels.append(_level(rest.where(F.col("listed") == encodes), counted["inside"], counted["outside"], len(levels)))
    else:
        raise ValueError("two keys share both of their hashes; build with other seeds")
    return levels


def _shape(inside: int, outside: int, salt: int) -> tuple[int, int]:
    """Hashes and 64-bit words of a level: the first one is as fine as pays against the share of listed keys; the others halve."""
    p = min(0.5, max(1e-6, math.sqrt(0.5) * inside / max(1, outside))) if salt == 0 else 0.5
    hashes = max(1, round(-math.log2(p)))
    return hashes, max(1, math.ceil(max(1, inside) * hashes / math.log(2) / 64))


def cascade_of(h1: np.ndarray, h2: np.ndarray, listed: np.ndarray, most_levels: int = 200) -> list[Level]:
    """Cascade over keys that one task holds."""
    levels: list[Level] = []
    while not levels or (listed == (len(levels) % 2 == 0)).any():
        if len(levels) == most_levels:
            raise ValueError("two keys share both of their hashes; build with other seeds")
        encodes = listed == (len(levels) % 2 == 0)
        hashes, words = _shape(int(encodes.sum()), int((~encodes).sum()), len(levels))
        bits = np.zeros(words, np.uint64)
        for at in _positions(h1[encodes], h2[encodes], hashes, len(levels), words * 64):
            np.bitwise_or.at(bits, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
        levels.append(Level(bits, hashes, len(levels)))
        held = levels[-1].holds(h1, h2)
        h1, h2, listed = h1[held], h2[held], listed[held]
    return levels


def _level(rows: DataFrame, inside: int, outside: int, salt: int) -> Level:
    hashes, words = _shape(inside, outside, salt)
    spread = words * 64

    def words_of(batches):
        for b in batches:
            at = np.concatenate([*_positions(_unsigned(b, "h1"), _unsigned(b, "h2"), hashes, salt, spread)]) if b.num_rows else np.zeros(0, np.uint64)
            slot, where = np.unique(at >> np.uint64(6), return_inverse=True)
            bits = np.zeros(len(slot), np.uint64)
            np.bitwise_or.at(bits, where, np.uint64(1) << (at & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(slot.view(np.int64)), pa.array(bits.view(np.int64))], names=["slot", "bits"])

    merged = rows.mapInArrow(words_of, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(words, np.uint64)
    bits[merged["slot"].to_numpy()] = merged["bits"].to_numpy().view(np.uint64)
    return Level(bits, hashes, salt)


def cascade_bytes(inside: int, outside: int) -> float:
    """Size in bytes of a cascade, before it is built: level 1, and halving levels that sum to a few bits a key."""
    p = min(0.5, max(1e-6, math.sqrt(0.5) * inside / max(1, outside)))
    return (inside * max(1, round(-math.log2(p))) + 4 * (inside + p * outside)) / math.log(2) / 8 + 1600


@shielded
def mark_listed(rows: DataFrame, key: str, listed: DataFrame, out: str = "listed", max_bytes: int = MAX_BYTES, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """`rows` with a boolean column `out`: whether the row's key stands in `listed`, a table whose first column has the listed keys.

    The corpus's keys and the list meet once, as distinct hashes, in an aggregate; every row is then judged by the cascade alone. Listed keys that
    no row has are left out of it. A null key, listed or not, is the empty text. Keys listed twice count once. An empty list lists
    nothing; an empty table gives no rows. Columns of `rows` stay; `out` replaces one of that name.
    """
    spark = rows.sparkSession
    prepare(spark)

    def hashes(text: Column) -> list[Column]:
        text = F.coalesce(text.cast("string"), F.lit(""))
        return [F.xxhash64(F.lit(1), text).alias("h1"), F.xxhash64(F.lit(2), text).alias("h2")]

    own = rows.select(*hashes(F.col(key)), F.lit(True).alias("here"), F.lit(False).alias("there"))
    theirs = listed.select(*hashes(F.col(listed.columns[0])), F.lit(False).alias("here"), F.lit(True).alias("there"))
    met = own.unionAll(theirs).groupBy("h1", "h2").agg(F.max("here").alias("here"), F.max("there").alias("listed"))
    universe = durable(met.where("here").select("h1", "h2", "listed"))
    counted = universe.agg(F.count_if("listed").alias("inside"), F.count_if(~F.col("listed")).alias("outside")).first()
    columns = [c for c in rows.columns if c != out]
    h1, h2 = hashes(F.col(key))
    hashed = rows.select(*columns, h1.alias("__h1"), h2.alias("__h2"))
    schema = hashed.select(*columns).withColumn(out, F.lit(True)).schema
    if cascade_bytes(counted["inside"], counted["outside"]) > max_bytes:
        return _judged_in_shards(hashed, universe, math.ceil((counted["inside"] + counted["outside"]) / shard_keys), schema)
    universe = universe.coalesce(1 + (counted["inside"] + counted["outside"]) // 200_000)
    cast = spark.sparkContext.broadcast(build_cascade(universe))

    def judge(batches):
        for b in batches:
            is_in = listed_by(cast.value, _unsigned(b, "__h1"), _unsigned(b, "__h2"))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in range(b.num_columns - 2)), pa.array(is_in)], schema=pa.schema([*list(b.schema)[:-2], pa.field(out, pa.bool_())]))

    return hashed.mapInArrow(judge, schema)


def _judged_in_shards(hashed: DataFrame, universe: DataFrame, shards: int, schema) -> DataFrame:
    """Rows (with __h1 and __h2 last) judged by the cascade of their shard, in one pass over rows and one over keys."""
    shard = lambda h: F.pmod(F.col(h), F.lit(shards)).cast("int").alias("__shard")

    def build(group: pa.Table) -> pa.Table:
        levels = cascade_of(_unsigned(group, "h1"), _unsigned(group, "h2"), group["listed"].to_numpy())
        return pa.table({"__shard": pa.array([group["__shard"][0].as_py()], pa.int32()), "__levels": pa.array([pickle.dumps(levels)], pa.binary())})

    built = stored(universe.withColumn("__shard", shard("h1")).groupBy("__shard").applyInArrow(build, "__shard int, __levels binary"))
    cascades = built.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SHARD_PARTS - 1))))
    rows = hashed.withColumns({"__shard": shard("__h1"), "__part": F.pmod(F.xxhash64(*hashed.columns), F.lit(SHARD_PARTS)).cast("int"), "__levels": F.lit(None).cast("binary")})
    # A shard's cascade sorts before its rows, as the rows' own column is null.
    together = rows.unionByName(cascades, allowMissingColumns=True).repartition("__shard", "__part").sortWithinPartitions("__shard", "__part", F.col("__levels").isNull())

    def judge(batches):
        levels: list[Level] = []
        for b in batches:
            carries = b.column("__levels").is_valid().to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(carries)).tolist(), b.num_rows]
            for begin, end in zip(cuts, cuts[1:], strict=False):
                if begin < end and carries[begin]:
                    levels = pickle.loads(b.column("__levels")[begin].as_py())
                    begin += 1
                part = b.slice(begin, end - begin)
                is_in = listed_by(levels, _unsigned(part, "__h1"), _unsigned(part, "__h2")) if part.num_rows else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in range(len(schema) - 1)), pa.array(is_in)], names=schema.names)

    return together.mapInArrow(judge, schema)


def hosts_with(hosts: DataFrame, terms: Sequence[str]) -> DataFrame:
    """A block list: the distinct hosts of a table (host) that have one of the terms between dots or hyphens."""
    return hosts.where(F.arrays_overlap(F.split("host", r"[.\-]"), F.array(*map(F.lit, terms)))).select("host").distinct()


def judge_urls(pages: DataFrame, block_list: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, listed for every row of `pages` (page_id, url).

    Rules come first, the longest one that fits; else a page is blocked if its host stands in `block_list`, a table whose first column has hosts.
    Null urls and urls without :// have an empty host and path. Repeated urls and pages are judged alike, each on its own row; an empty table gives no rows;
    other columns are not looked at.
    """
    marked = mark_listed(parts_of(pages), "host", block_list)
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    by_list = F.when(F.col("listed"), "block").otherwise("allow")
    return marked.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_list).alias("verdict"), "listed")


def parts_of(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))


def op5_url_filter(spark, sf_dir: str) -> DataFrame:
    """A verdict for every row of pages. The block list is a table of hosts, here those of the corpus with one of BLOCK_TERMS."""
    pages = table(spark, sf_dir, "pages")
    return judge_urls(pages, hosts_with(parts_of(pages), BLOCK_TERMS))


_HOST = r"coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '')"
ORACLE_SQL = rf"""
WITH parts AS (
  SELECT page_id,
    translate({_HOST}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule,
    regexp_matches(host, '(^|[.\-])({"|".join(BLOCK_TERMS)})($|[.\-])') AS listed
  FROM parts
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed
FROM ruled
"""
