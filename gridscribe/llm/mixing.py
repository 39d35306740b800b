"""Mixing sources to target weights by weighted reservoir keys (Efraimidis and Spirakis, 2006).

Every document gets the key ``-ln(u) / w``: u is a hash of its id in (0, 1), w its quality weight. In
each source, documents sorted by key are a weighted sample without replacement, however many are
taken. A target is met by complete epochs first; what is left of it is filled by the running sum of
sizes in key order.

The running sum never brings a source into one task. Keys fall into fine bands of equal ratio; band
sizes are summed with map-side combining, bands are few (some thousands per source, whatever the number of rows). The band in
which the budget ends is parted into as many again, and only the part in which it ends is sorted row by row: one row in a million or so.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, shielded, table, word_count

#: Bands for each doubling of a key.
BANDS = 256
#: Parts of the band in which a budget ends.
PARTS = 4096
#: Rows of per-source targets that may be broadcast; beyond it Spark shuffles.
BROADCAST_SOURCES = 100_000


def quality_weight(text: Column) -> Column:
    """0.5 to 1: half, and half the share of characters that are ASCII letters, blanks or not ASCII.

    Empty and null texts weigh 0.5.
    """
    odd = F.length(F.regexp_replace(text, r"[A-Za-z\x20\n\x{80}-\x{10FFFF}]++", ""))
    size = F.length(text)
    return F.when(size > 0, 1.0 - 0.5 * odd / size).otherwise(F.lit(0.5))


def water_fill(sizes: dict, weights: dict, total: float, most: float) -> dict:
    """Share `total` by weight; a share over `most` times its size stops there, its excess is reshared by weight."""
    out, left, open_ = {}, float(total), [k for k in sizes]
    while open_:
        whole = sum(weights[k] for k in open_)
        over = [k for k in open_ if whole and left * weights[k] / whole > most * sizes[k]]
        if not over:
            out |= {k: (left * weights[k] / whole if whole else 0.0) for k in open_}
            break
        for k in over:
            out[k] = most * float(sizes[k])
        left -= sum(out[k] for k in over)
        open_ = [k for k in open_ if k not in out]
    return out


@shielded
def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """`docs` (doc_id, text, source and others) with the words that the mix takes of each row.

    Sources sorted by code point, null last, weigh `weights`, repeating. All targets together are
    `share` of all words; none is over `most` times its source's words. Adds size, source_size, target, epochs and taken,
    which replace columns of these names: `epochs` complete passes, then `taken - epochs * size` more
    words of the row; where the budget ends inside a document, its first words fill it up.

    Nulls: a null text has size 0 and is taken 0 times; null sources are one source; null ids share
    one key. Ties in the key go by id, then by a hash of the text; rows alike in all of these share what is left
    of the budget evenly. An empty table gives no rows. Every row stays, in its own task: only keys and sizes
    are shuffled, and the ends of the budgets, one row a source, come back to the rows.
    """
    added = ("__id", "__size", "__band", "__sub", "__key", "__hash")
    keyed = docs.withColumns(dict(zip(added, _keys(seed), strict=True)))
    narrow = durable(keyed.select("source", *added))
    targets = _targets(narrow, weights, share, most)

    order = ["__key", "__id", "__hash"]
    cut = targets.select("of", F.lit(0).cast("long").alias("before"), "rest")
    inside = narrow.select(_of("source"), "__band", "__sub", "__size", *order)
    for level in ("__band", "__sub"):
        # Only rows of the band, or part of it, where the budget ends are looked at further.
        cut = durable(_cut(inside, level, cut))
        inside = inside.drop("before", "rest").join(cut, ["of", level])

    # There, the first key at which the running sum reaches the budget.
    alike = inside.groupBy("of", "before", "rest", *order).agg(F.sum("__size").alias("sum"), F.count("*").alias("rows"))
    so_far = F.col("before") + F.coalesce(F.sum("sum").over(Window.partitionBy("of").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = alike.withColumn("so_far", so_far).where((F.col("so_far") < F.col("rest")) & (F.col("so_far") + F.col("sum") >= F.col("rest")))
    end = F.struct(F.struct("__key", "__id", "__hash").alias("at"), F.floor((F.col("rest") - F.col("so_far")) / F.col("rows")).alias("part")).alias("__end")
    plan = targets.join(ends.select("of", end), "of", "left")
    plan = plan.select(F.col("of").alias("__of"), "__end", *(F.col(c).alias(f"__{c}") for c in ("source_size", "target", "epochs")))
    plan = F.broadcast(plan) if targets.count() <= BROADCAST_SOURCES else plan

    here = F.struct("__key", "__id", "__hash")
    part = (
        F.when(F.col("__end").isNull(), 0)  # nothing is left over to fill
        .when(here < F.col("__end.at"), F.col("__size"))
        .when(here == F.col("__end.at"), F.col("__end.part"))
        .otherwise(0)
    )
    new = {
        "size": F.col("__size"),
        "source_size": F.col("__source_size"),
        "target": F.col("__target"),
        "epochs": F.col("__epochs").cast("int"),
        "taken": (F.col("__epochs") * F.col("__size") + part).cast("long"),
    }
    rows = keyed.drop(*new).withColumn("__of", F.struct("source")).join(plan, "__of")
    return rows.select(*(c for c in docs.columns if c not in new), *(v.alias(k) for k, v in new.items()))


def _cut(rows: DataFrame, level: str, budget: DataFrame) -> DataFrame:
    """of, level, before, rest: where the running sum of sizes over `level`, from `before` on, reaches `rest`; none if nothing is asked for."""
    sums = rows.groupBy("of", level).agg(F.sum("__size").alias("part_size"))
    run = Window.partitionBy("of").orderBy(level).rowsBetween(Window.unboundedPreceding, -1)
    summed = sums.withColumn("so_far", F.coalesce(F.sum("part_size").over(run), F.lit(0))).join(budget.select("of", "before", "rest"), "of").withColumn("before", F.col("before") + F.col("so_far"))
    return summed.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("part_size") >= F.col("rest"))).select("of", level, "before", "rest")


def _of(source: str) -> Column:
    return F.struct(F.col(source).alias("source")).alias("of")  # a struct is never null, so null sources join


def _keys(seed: int) -> tuple[Column, ...]:
    """id (null as the largest), size, band, part of the band, key and text hash of a row; band and part grow with the key."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 12).cast("double") + 0.5) / float(1 << 52)
    key = -F.log(uniform) / quality_weight(F.col("text"))
    place = F.log2(key) * BANDS
    return F.coalesce("doc_id", F.lit((1 << 63) - 1)), word_count(F.col("text")), F.floor(place), F.floor((place - F.floor(place)) * PARTS), key, F.xxhash64("text")


def _targets(narrow: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """of (a struct with the source), source_size, target, epochs, rest: one row per source.

    Water filling looks at all sources at once. There is a row per source, not per document.
    """
    spark = narrow.sparkSession
    sizes = sorted(((r["source"], r["size"] or 0) for r in narrow.groupBy("source").agg(F.sum("__size").alias("size")).collect()), key=lambda r: (r[0] is None, r[0] or ""))
    size = dict(sizes)
    weight = {k: float(weights[i % len(weights)]) for i, (k, _) in enumerate(sizes)}
    target = water_fill(size, weight, share * sum(size.values()), most)
    rows = []
    for k, n in sizes:
        words = round(target[k])
        epochs = min(int(words // n), int(most)) if n else 0
        rows.append(((k,), n, float(target[k]), epochs, words - epochs * n))
    return spark.createDataFrame(rows, "of struct<source: string>, source_size long, target double, epochs long, rest long")


def op1_mix(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of every row of documents; nulls, ties, repeated rows and empty tables as in `mix_sources`."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "epochs")
