import random
import re
import time

from gridscribe.llm.license_scan import NOTICES, PHRASES, compile_notice, fuzzy_places, scan_form, scan_licenses

from .helpers import docs, odd_rows, prose, with_clashing_columns

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    found = [(i, label) for phrase, label in PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({x for _, x in found}))


def test_base_equals_brute_force(spark):
    texts = ["CC BY cc-by", "All rights reserved. ALL RIGHTS reserved", "éCC by", "general  public\nlicense general public license", "cc" + "by", "CC.BY " * 50, prose(1, 4000) + " all rights reserved", "the kelvin \u212a sign CC BY"]
    rows = [(100 + i, t) for i, t in enumerate(texts)] + odd_rows()
    got = scan_licenses(with_clashing_columns(docs(spark, rows))).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), *map(str, brute(t))) for i, t, *_ in rows)
    assert sorted((str(r["doc_id"]), str(r["n_words"]), str(r["n_base"]), str(r["first_word"]), str(r["last_word"]), r["base_labels"]) for r in got) == want
    assert all(set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)
    assert scan_licenses(docs(spark, [])).count() == 0


def edit_distance_ends(pattern, text):
    """Least edits of the pattern against any substring of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row[0] = row[:], i
        for j, t in enumerate(text, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (p != t))
    return min(row)


def test_seeds_miss_no_place_within_the_bound():
    rng = random.Random(5)
    for text, label in NOTICES:
        notice = compile_notice(text, label)
        for _ in range(12):
            edited = list(text)
            for _ in range(rng.randint(0, notice.errors + 1)):
                at = rng.randrange(len(edited))
                rng.choice((lambda: edited.pop(at), lambda: edited.insert(at, "x"), lambda: edited.__setitem__(at, "q")))()
            form = scan_form(f"{prose(3, 8)} {''.join(edited)} {prose(4, 8)}")[0]
            assert bool(fuzzy_places(form, notice)) == (edit_distance_ends(text, form.decode()) <= notice.errors)


def test_best_of_alike_notices():
    from gridscribe.llm.license_scan import scan_text

    known = [compile_notice(t, label) for t, label in NOTICES]
    assert scan_text("Licensed under CC BY-NC 4.0.", [], known)["labels"] == "cc-by-nc"
    assert scan_text("Relaesed under the MIT Licence.", [], known)["labels"] == "mit"


def test_notices_back_to_back_are_all_found():
    notice = compile_notice("all rights reserved", "reserved")
    form = scan_form("all rights reservd all rights reserved all rihts reserved")[0]
    assert [(form[a:b].strip(), e) for a, b, e in fuzzy_places(form, notice)] == [(b"all rights reservd", 1), (b"all rights reserved", 0), (b"all rihts reserved", 1)]


def test_long_texts_of_notices_take_time_in_proportion():
    from gridscribe.llm.license_scan import scan_text

    known = [compile_notice(t, label) for t, label in NOTICES]
    exact = [(p.encode(), label) for p, label in PHRASES]
    one = "Licensed under CC BY-SA 4.0. all rights reservd, Relaesed under the MIT Licence; "
    seconds = {}
    for n in (500, 8000):
        began = time.process_time()
        got = scan_text(one * n, exact, known)
        seconds[n] = time.process_time() - began
        assert len(got["notices"]) == 3 * n and got["n_base"] == n
        assert [x["label"] for x in got["notices"][:3]] == ["cc-by-sa", "reserved", "mit"]
        assert got["notices"][-1]["end_word"] == got["n_words"]
    assert seconds[8000] < 50 * seconds[500]


def test_notices_are_found_wherever_steps_end():
    notice = compile_notice("all rights reserved", "reserved")
    rng = random.Random(3)
    for _ in range(60):
        parts = [rng.choice(("all rights reserved", "all rihts reserved", "all rights reservd", "all r", "eserved")) for _ in range(rng.randint(1, 40))]
        form = scan_form(" ".join(parts))[0]
        found = fuzzy_places(form, notice)
        assert all(a[1] <= b[0] for a, b in zip(found, found[1:]))
        whole = [form[a:b].strip().decode() for a, b, _ in found]
        for kind in ("all rights reserved", "all rihts reserved", "all rights reservd"):
            assert sum(kind in w for w in whole) >= parts.count(kind)
