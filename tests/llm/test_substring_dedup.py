from collections import defaultdict

import numpy as np
import pytest

from gridscribe.llm.substring_dedup import parse, remove_duplicate_spans

from .helpers import docs, odd_rows, prose, with_clashing_columns


def brute(rows, window):
    """doc_id: kept words, from the first place of every run; null ids last, places in one id are one text's."""
    order = lambda i: (i is None, i or 0)
    first = {}
    split = [(i, (t or "").split()) for i, t, *_ in rows]
    for i, w in split:
        for k in range(len(w) - window + 1):
            run = tuple(w[k : k + window])
            first[run] = min(first.get(run, ((True, 1 << 70), 0)), (order(i), k))
    out = defaultdict(list)
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] != (order(i), k):
                gone |= set(range(k, k + window))
        out[i].append(" ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def cases():
    shared, other = prose(1, 60), prose(2, 45)
    rows = [(i, f"{prose(50 + i, 30)} {shared} {prose(90 + i, 25)}", "en", "s", 0) for i in range(12)]
    rows += [(20, f"{shared} {other}"), (21, f"{other} {shared}"), (22, prose(7, 300)), (23, prose(7, 300)), (24, prose(7, 150) + " x " + " ".join(prose(7, 300).split()[151:]))]
    rows += [(30, "a " * 70), (31, "a b " * 40), (32, "b a " * 40), (33, " ".join(prose(9, 19).split())), (34, prose(9, 19)), (35, prose(9, 20)), (36, prose(9, 20)), (37, prose(9, 21))]
    rows += [(40, f"{prose(11, 25)} {prose(12, 25)} {prose(11, 25)}"), (None, prose(11, 40)), (None, prose(13, 40)), (41, prose(13, 40)), (41, prose(14, 40)), (41, prose(14, 40)), (42, "é 😀 " * 15)]
    return rows + odd_rows()


@pytest.mark.parametrize(("window", "gram"), [(20, 8), (5, 3)])
def test_equals_brute_force(spark, window, gram):
    rows = cases()
    got = remove_duplicate_spans(with_clashing_columns(docs(spark, rows)), window, gram).collect()
    assert len(got) == len(rows)
    mine = defaultdict(list)
    for r in got:
        mine[r["doc_id"]].append(r["kept"])
        assert r["n_removed"] == sum(s["end"] - s["begin"] for s in r["spans"])
        assert r["n_words"] - r["n_removed"] == len(r["kept"].split())
    want = brute(rows, window)
    assert {k: sorted(v) for k, v in mine.items()} == {k: sorted(v) for k, v in want.items()}


def test_empty(spark):
    assert remove_duplicate_spans(docs(spark, [])).count() == 0


def test_factors_are_greedy_copies_of_earlier_words(spark):
    rows = [r for r in cases()[: -len(odd_rows())] if r[0] not in (None, 41)]  # ids that name one text
    text = {i: (t or "").split() for i, t, *_ in rows}
    got = {r["doc_id"]: r for r in remove_duplicate_spans(docs(spark, rows)).collect()}
    for i, r in got.items():
        for f in r["factors"]:
            size = f["end"] - f["begin"]
            assert size >= 20 and text[i][f["begin"] : f["end"]] == text[f["source_id"]][f["source_at"] : f["source_at"] + size]
            assert (f["source_id"], f["source_at"]) < (i, f["begin"])
        for f, g in zip(r["factors"], r["factors"][1:]):
            assert f["begin"] < g["begin"] and g["begin"] > f["end"] - 20  # no run is in two factors
            assert (g["source_id"], g["source_at"] - g["begin"]) != (f["source_id"], f["source_at"] - f["begin"]) or g["begin"] > f["end"] - 19
    # A passage is one factor, whatever blocks it was cut into, and extends to its last word.
    shared = [[(f["begin"], f["end"], f["source_id"], f["source_at"]) for f in got[i]["factors"]] for i in range(1, 12)]
    assert shared == [[(30, 90, 0, 30)]] * 11
    assert [(f["begin"], f["end"], f["source_id"], f["source_at"]) for f in got[23]["factors"]] == [(0, 300, 22, 0)]
    assert [(f["begin"], f["end"], f["source_id"], f["source_at"]) for f in got[24]["factors"]] == [(0, 150, 22, 0), (151, 300, 22, 151)]
    assert [(f["begin"], f["end"], f["source_id"], f["source_at"]) for f in got[21]["factors"]] == [(0, 45, 20, 60), (45, 105, 0, 30)]


def test_parse_extends_while_the_source_goes_on():
    match = lambda at, runs, i, j, owner=0: (owner, at, runs, i, 0, j)
    factors = lambda *m: list(zip(*(x.tolist() for x in parse(*np.array(m, np.int64).reshape(-1, 6).T, 20)[1:])))
    assert factors() == []
    assert factors(match(3, 1, 7, 9), match(0, 3, 7, 6)) == [(0, 23, 7, 6)]
    assert factors(match(0, 3, 7, 6), match(3, 2, 8, 9)) == [(0, 22, 7, 6), (3, 24, 8, 9)]
    assert factors(match(0, 3, 7, 6), match(3, 2, 7, 30)) == [(0, 22, 7, 6), (3, 24, 7, 30)]
    assert factors(match(0, 3, 7, 6), match(4, 2, 7, 10)) == [(0, 22, 7, 6), (4, 25, 7, 10)]
    assert factors(match(1, 1, 7, 7, owner=1), match(0, 1, 7, 6)) == [(0, 20, 7, 6), (1, 21, 7, 7)]


def test_very_long_texts_of_one_word_and_long_words(spark):
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a  # polynomial hashes modulo 2**64 take them for equal
    rows = [(1, "x " * 200_000), (2, f"{a} " + prose(5, 30)), (3, f"{b} " + prose(5, 30)), (4, " ".join([a] * 20)), (5, " ".join([a] * 19 + [b]))]
    got = {r["doc_id"]: r for r in remove_duplicate_spans(docs(spark, rows)).collect()}
    assert (got[1]["n_words"], got[1]["n_removed"]) == (200_000, 199_999)
    assert got[3]["kept"] == b and got[2]["n_removed"] == 0
    assert got[4]["n_removed"] == got[5]["n_removed"] == 0
