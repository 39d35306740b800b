import re

import numpy as np
from pyspark.sql import functions as F

from gridscribe.llm import url_filter
from gridscribe.llm.url_filter import BLOCK_TERMS, hosts_with, judge_urls, mark_listed, parts_of

URLS = [
    None, "", "no scheme/at all", "http://a.net", "http://a.net/", "HTTPS://Foo.EXAMPLE.Net/en/x?y#z", "x://://b.org/fr/1", "http://org/fr/", "http://notexample.net/en/", "http://m.example.com/de/9#t",
    "http://example.com/de", "http://free-bets.example.com/en/1", "http://casino.org/fr/", "http://casino.org/", "http://u@poker.io:80?q=/x", "a://b://c/d", "http://ünï.net/é", "http://bets\nx.com/",
]
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def brute(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        raw = re.match(r"[^/?#]*", rest)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in raw)
        path = re.match(r"[^?#]*", rest[len(raw) :])[0]
    fits = [r for r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    rule = max(fits, key=len, default=None)
    listed = any(t in BLOCK_TERMS for t in re.split(r"[.\-]", host))
    return host, path, rule, RULES[rule] if rule else "block" if listed else "allow"


def test_equals_brute_force(spark):
    rows = [(i, u, "html", "x", "y") for i, u in enumerate(URLS)] + [(None, URLS[5], None, None, None), (3, URLS[3], None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, listed string")
    got = judge_urls(df, hosts_with(parts_of(df), BLOCK_TERMS)).collect()
    assert sorted((str(r["page_id"]), r["host"], r["path"], str(r["rule"]), r["verdict"]) for r in got) == sorted((str(i), h, p, str(rule), v) for i, u, *_ in rows for h, p, rule, v in [brute(u)])
    assert judge_urls(df.limit(0), hosts_with(parts_of(df), BLOCK_TERMS)).count() == 0
    assert {r["verdict"] for r in judge_urls(df.where("url like '%casino.org/'"), df.select("host").limit(0)).collect()} == {"allow"}


def test_cascade_is_exact_over_its_universe(spark, monkeypatch):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"), "id", F.lit("extra").alias("h1"))
    hot = spark.range(8_000).select(F.lit("k34").alias("key"), F.lit(34).cast("long").alias("id"), F.lit("extra").alias("h1"))
    none = spark.range(5).select(F.lit(None).cast("string").alias("key"), F.lit(1).cast("long").alias("id"), F.lit("extra").alias("h1"))
    rows = keys.unionByName(hot).unionByName(none)
    asked = spark.range(0, 40_000, 17).select(F.concat(F.lit("k"), "id").alias("host"), F.lit(1).alias("more"))  # half of them stand in no row
    for size, each in ((url_filter.MAX_BYTES, 1_000_000), (0, 3_000), (0, 1_000_000)):  # one cascade, several shards, one shard
        got = mark_listed(rows, "key", asked.unionAll(asked), max_bytes=size, shard_keys=each)
        assert got.columns == ["key", "id", "h1", "listed"]
        assert got.where(F.col("listed") != (F.col("id") % 17 == 0)).count() == 0
        assert got.count() == 28_005
        nothing = mark_listed(rows, "key", asked.limit(0), max_bytes=size, shard_keys=each)
        assert nothing.where("listed").count() == 0 and nothing.count() == 28_005
    assert mark_listed(none, "key", none.select("key"), max_bytes=0).where("listed").count() == 5


def test_one_task_builds_the_cascade_that_many_build(spark):
    keys = spark.range(5000).select(F.xxhash64(F.lit(1), "id").alias("h1"), F.xxhash64(F.lit(2), "id").alias("h2"), (F.col("id") % 10 == 0).alias("listed"))
    at = keys.toArrow()
    alone = url_filter.cascade_of(at["h1"].to_numpy().view(np.uint64), at["h2"].to_numpy().view(np.uint64), at["listed"].to_numpy())
    assert [(x.hashes, x.salt, x.bits.tolist()) for x in alone] == [(x.hashes, x.salt, x.bits.tolist()) for x in url_filter.build_cascade(keys)]


def test_levels_alternate_until_nothing_is_left(spark):
    keys = spark.range(5000).select(F.xxhash64(F.lit(1), "id").alias("h1"), F.xxhash64(F.lit(2), "id").alias("h2"), (F.col("id") % 10 == 0).alias("listed"))
    levels = url_filter.build_cascade(keys)
    assert len(levels) > 2
    at = keys.toArrow()
    h1, h2 = (at[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
    assert (url_filter.listed_by(levels, h1, h2) == at["listed"].to_numpy()).all()
    assert not levels[0].holds(h1, h2).all() and levels[0].holds(h1, h2).sum() > 500  # the first level alone is not exact
