import pytest

from gridscribe.llm import decontamination
from gridscribe.llm.decontamination import bands_for, drop_contaminated, find_items

from .helpers import docs, odd_rows, prose, with_clashing_columns


def grams(text, n):
    w = (text or "").split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(rows, items, threshold=0.8):
    out = set()
    for item, text in items:
        n = min(5, len((text or "").split()))
        own = grams(text, n) if n else set()
        for i, t, *_ in rows:
            shared = len(own & grams(t, n)) if n else 0
            if own and shared >= threshold * len(own) - 1e-9:
                out.add((i, item, len(own), shared))
    return out


ITEMS = [(k, prose(700 + k, n)) for k, n in enumerate([1, 3, 4, 5, 6, 7, 8, 9, 12, 15, 20, 21, 36, 59, 130, 400])] + [(90, None), (91, ""), (92, "a a a a a a a a"), (93, prose(712, 36)), (94, " ".join(prose(712, 36).split()[:33]))]


def corpus():
    rows = []
    for k, text in ITEMS:
        if text:
            rows.append((1000 + k, f"{prose(k, 2500)} {text} {prose(k + 50, 1500)}"))
            rows.append((2000 + k, f"{prose(k + 100, 3)} {text}"))
            w = text.split()
            rows.append((3000 + k, f"{prose(k + 200, 30)} {' '.join(w[: len(w) - len(w) // 8])} {prose(k + 250, 9)}"))
            rows.append((4000 + k, f"{prose(k + 300, 30)} {' '.join(w[: len(w) // 2])} {prose(k + 350, 9)}"))
    return rows + [(5000 + k, prose(5000 + k, 200)) for k in range(30)] + [(6000, "a " * 40)] + odd_rows()


@pytest.mark.parametrize("a_pass", [20_000, 5])
def test_equals_brute_force(spark, monkeypatch, a_pass):
    monkeypatch.setattr(decontamination, "ITEMS_A_PASS", a_pass)  # few items a pass: several passes
    rows = corpus()
    df, items = with_clashing_columns(docs(spark, rows)), spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "'x' as doc_id")
    got = find_items(df, items).collect()
    assert len(got) == len({(r["doc_id"], r["item_id"]) for r in got})
    want = brute(rows, ITEMS)
    assert {(r["doc_id"], r["item_id"], r["n_shingles"], r["n_shared"]) for r in got} == want
    clean = drop_contaminated(df, items)
    assert clean.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(i) for i, *_ in rows if i not in {w[0] for w in want})


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert find_items(docs(spark, corpus()[:3]), none).count() == 0
    assert drop_contaminated(docs(spark, odd_rows()), none).count() == len(odd_rows())
    assert find_items(docs(spark, []), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


def test_bands_keep_the_recall():
    for item, segment in ((16, 16), (16, 32), (32, 256), (8, 64)):
        bands, rows = bands_for(item, segment, 0.8, 0.99)
        similarity = 0.8 * item / (segment + 0.2 * item)
        assert 1 - (1 - similarity**rows) ** bands >= 0.99
