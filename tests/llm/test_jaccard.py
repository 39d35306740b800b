import numpy as np
import pytest

from gridscribe.llm import jaccard
from gridscribe.llm.components import connected_components
from gridscribe.llm.jaccard import choose_bands, jaccard_join, keep_one, similar

from .helpers import docs, odd_rows, prose, with_clashing_columns, words


def shingles(text, n=5):
    w = (text or "").split()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows, threshold=0.8):
    """Per row: number of links, and the rows of its class."""
    sets = [shingles(t) for _, t, *_ in rows]
    linked = [[j for j in range(len(rows)) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) * 10 >= threshold * 10 * len(sets[i] | sets[j]) - 1e-9] for i in range(len(rows))]
    root = list(range(len(rows)))
    for _ in rows:
        root = [min([root[i], *(root[j] for j in linked[i])]) for i in range(len(rows))]
    return [len(x) for x in linked], root


def edited(seed, base, at):
    w = list(base)
    for k in at:
        w[k] = words(seed + k, 1)[0] + "x"
    return " ".join(w)


def corpus():
    base, other = words(1, 120), words(2, 60)
    rows = [(100 + k, edited(k, base, range(k % 4))) for k in range(30)] + [(200 + k, " ".join(other)) for k in range(9)] + [(300, edited(1, other, [30]))]
    rows += [(400 + k, " ".join(words(10, 90)[k : k + 70])) for k in range(0, 20, 2)]  # a chain: neighbours alone are alike
    rows += [(500 + k, prose(50 + k, 40)) for k in range(40)] + [(600, "a " * 50), (601, "a " * 90), (602, "a b c"), (603, "a b c"), (604, "a b c d")]
    return rows + odd_rows()


@pytest.mark.parametrize("block", [128, 4])
def test_links_and_classes_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", block)  # small blocks: components of several tiles
    rows = corpus()
    links, root = brute(rows)
    got = jaccard_join(with_clashing_columns(docs(spark, rows))).collect()
    assert len(got) == len(rows)
    least = {}
    for (i, *_), r in zip(rows, root):
        least.setdefault(r, []).append(i)
    want = sorted((str(i), n, str(min((x for x in least[r] if x is not None), default=None))) for (i, *_), n, r in zip(rows, links, root))
    assert sorted((str(r["doc_id"]), r["n_links"], str(r["class_id"])) for r in got) == want


def test_keep_one(spark):
    rows = corpus()
    _, root = brute(rows)
    df = with_clashing_columns(docs(spark, rows))
    got = keep_one(df)
    assert got.columns == df.columns
    kept = sorted(str((r["doc_id"], r["text"])) for r in got.collect())
    first = {}
    for (i, t, *_), r in zip(rows, root):
        if (t or "").split():
            first[r] = min(first.get(r, ((True, 1 << 70), "")), ((i is None, i or 0), t))
    want = [str((None if i[0] else i[1], t)) for i, t in first.values()] + [str((i, t)) for i, t, *_ in rows if not (t or "").split()]
    assert kept == sorted(want)


def test_empty(spark):
    assert jaccard_join(docs(spark, [])).count() == 0 and keep_one(docs(spark, [])).count() == 0


def test_tile_counts_equal_sets():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 90, rng.integers(1, 80))).astype(np.uint64) for _ in range(60)]
    got = similar(sets, 0.5)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert got[i, j] == (i != j and 2 * len(np.intersect1d(a, b)) >= len(np.union1d(a, b)))


def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.99), (0.5, 0.9), (0.9, 0.999)):
        bands, rows = choose_bands(threshold, recall)
        assert 1 - (1 - threshold**rows) ** bands >= recall and bands * rows <= 144


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 201), (201, 200), (5, 5)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}
