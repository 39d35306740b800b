import pytest
from pyspark.sql import functions as F

from gridscribe.llm.mixing import mix_sources, water_fill

from .helpers import docs, odd_rows, prose, with_clashing_columns


def brute_targets(sizes, weights, total, most):
    """Raise a common level until all is shared: targets are the smaller of weight times level and the cap."""
    low, high = 0.0, 1e9
    for _ in range(200):
        mid = (low + high) / 2
        if sum(min(w * mid, most * n) for n, w in zip(sizes, weights)) < total:
            low = mid
        else:
            high = mid
    return [min(w * low, most * n) for n, w in zip(sizes, weights)]


def test_water_fill_equals_level_search():
    sizes, weights = [100, 40, 7, 900, 0], [5, 2, 1, 5, 2]
    got = water_fill(dict(enumerate(sizes)), dict(enumerate(weights)), 1.5 * sum(sizes), 2)
    assert [got[i] for i in range(5)] == pytest.approx(brute_targets(sizes, weights, 1.5 * sum(sizes), 2), abs=1e-3)


def test_mix_meets_targets_and_repeats(spark):
    rows = [(i, prose(i, 5 + i % 40), "en", "abc"[i % 3] if i % 7 else None, 0) for i in range(300)] + odd_rows()
    df = with_clashing_columns(docs(spark, rows))
    got = mix_sources(df).collect()
    assert len(got) == len(rows)
    again = mix_sources(df).select("doc_id", "taken").collect()
    assert sorted(map(str, again)) == sorted(str(r) for r in mix_sources(df.repartition(3)).select("doc_id", "taken").collect())
    for source in {r["source"] for r in got}:
        mine = [r for r in got if r["source"] == source]
        size = sum(r["size"] for r in mine)
        assert {r["source_size"] for r in mine} == {size}
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= len([r for r in mine if r["doc_id"] == 11]) + 1
        assert all(r["epochs"] * r["size"] <= r["taken"] <= 2 * r["size"] for r in mine)
    assert sum(r["target"] for r in {r["source"]: r for r in got}.values()) == pytest.approx(1.5 * sum(r["size"] for r in got))
    for r in got:
        assert r["size"] == len((r["text"] or "").split())


def test_fraction_follows_quality(spark):
    clean = [(i, prose(i, 30), "en", "s", 0) for i in range(400)]
    junk = [(1000 + i, " ".join("%%%%###" for _ in range(30)), "en", "s", 0) for i in range(400)]
    got = mix_sources(docs(spark, clean + junk), share=0.5).groupBy((F.col("doc_id") >= 1000).alias("junk")).agg(F.sum("taken").alias("n")).collect()
    taken = {r["junk"]: r["n"] for r in got}
    assert taken[False] > 1.3 * taken[True]


def test_empty(spark):
    assert mix_sources(docs(spark, [])).count() == 0


def test_takes_what_a_plain_sort_and_running_sum_take(spark):
    """Epochs first, then the smallest keys; the document at which the budget ends gives its first words."""
    from pyspark.sql import functions as F

    from gridscribe.llm.mixing import _keys, mix_sources

    rows = [(k, prose(k, 1 + k * 7 % 50), "en", "abc"[k % 3] if k % 10 else None, 0) for k in range(400)] + [(1000, "w " * 30_000, "en", "a", 0)] + odd_rows()
    df = docs(spark, rows)
    keys = df.withColumns(dict(zip(("id", "n", "band", "sub", "key", "hash"), _keys(17)))).collect()
    assert all(a["band"] < b["band"] or (a["band"] == b["band"] and a["sub"] <= b["sub"]) for a, b in zip(sorted(keys, key=lambda r: r["key"]), sorted(keys, key=lambda r: r["key"])[1:]))
    got = mix_sources(df.withColumns({"__id": F.lit("mine"), "__of": F.lit(3)}))
    assert got.columns[:7] == ["doc_id", "text", "lang", "source", "n_chars", "__id", "__of"] and got.where("__id = 'mine' and __of = 3").count() == len(rows)
    taken = {}
    for r in got.collect():
        taken.setdefault((r["doc_id"], r["text"], r["source"]), []).append(r["taken"])
    target = {r["source"]: r["target"] for r in got.collect()}
    for source in target:
        own = sorted((r for r in keys if r["source"] == source), key=lambda r: (r["key"], r["id"], r["hash"]))
        size = sum(r["n"] for r in own)
        words = round(target[source])
        epochs = min(int(words // size), 2) if size else 0
        left = words - epochs * size
        groups = {}
        for r in own:
            groups.setdefault((r["key"], r["id"], r["hash"]), []).append(r)
        for alike in groups.values():
            whole = sum(r["n"] for r in alike)
            each = [r["n"] if left >= whole else max(0, left) // len(alike) for r in alike]
            for r, part in zip(alike, each):
                assert taken[r["doc_id"], r["text"], r["source"]][0] == epochs * r["n"] + part
            left -= whole
