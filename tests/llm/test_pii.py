import hashlib
import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gridscribe.llm import pii
from gridscribe.llm.pii import CONTEXT, base_spans, find_personal_data, op2_pii, sanitise

from .helpers import docs, odd_rows, prose, with_clashing_columns

CASES = [
    "a@b.c_d@e.f x", "1.2.3.4.5.6.7.8 999.1.2.3.4", "4111 1111 1111 1111 5 +1 (542) 555-3599 4495589438270767", "+49 30 1234567 4111-1111-1111-1111-",
    "é😀 x@y.zz 0000255.1.1.1 12345678901234567890123 4495589438270767", "5 4495589438270767", ".%a@b-.c.d. u@v w@x.y", " 1.1.1.1\n2.2.2.256", "@a.b c@@d.e", "4111111111111111", "+12345678 +1 2 +123456789012345 x", "9" * 5000, "a" * 20000 + "@b.co", "1." * 3000, "+" + "1 (" * 3000,
    "a@b.co 1.2.3.4 é " * 700, "x@y.zz " * 255 + "\u00e9", "x@y.zz " * 256, "x@y.zz " * 257,
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute(text):
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [(k, m.start(), m.end()) for k, m in out]


def test_base_spans_equal_brute_force(spark):
    got = docs(spark, list(enumerate(CASES))).select("text", base_spans(F.col("text")).alias("s")).collect()
    for r in got:
        assert [(s["kind"], s["start"], s["end"]) for s in r["s"]] == brute(r["text"]), r["text"][:60]


def corpus():
    """A name that stands only with one phone number, and words that stand everywhere."""
    common = [(i, f"the report {prose(i, 30)} about weather", "en", "s", 0) for i in range(60)]
    told = [(100 + i, f"{prose(100 + i, 10)} the call Marthason at +1 (542) 555-3599 about weather {prose(200 + i, 10)}", "en", "s", 0) for i in range(5)]
    return common + told


@pytest.mark.parametrize("most", [8 << 20, 0])
def test_disclosing_term_is_found_and_removed(spark, monkeypatch, most):
    monkeypatch.setattr(pii, "BROADCAST_BYTES", most)  # terms go to the texts, or texts to the terms
    df = docs(spark, corpus())
    _, terms = find_personal_data(df)
    found = {r["id"]: [t["value"] for t in r["terms"]] for r in terms.collect()}
    assert set(found) == set(range(100, 105))
    assert all("marthason" in t and "the" not in t and "about" not in t for t in found.values())
    clean = {r["doc_id"]: r["text"] for r in sanitise(df).collect()}
    assert all("Marthason" not in clean[i] and "[PHONE] about weather" in clean[i] for i in range(100, 105))
    assert all(clean[i] == text for i, text, *_ in corpus() if i < 100)


def test_digest_and_odd_rows(spark, tmp_path):
    rows = corpus() + odd_rows() + [(500 + i, c, "en", "s", 0) for i, c in enumerate(CASES)]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = op2_pii(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    for i, text, *_ in rows:
        if i is not None:
            base = ",".join(f"{k}:{a}:{b}" for k, a, b in brute(text or ""))
            assert by_id[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
            assert by_id[i]["spans"].startswith(base)
    assert "term:" in by_id[100]["spans"]


def test_sanitise_keeps_rows_and_columns(spark):
    df = with_clashing_columns(docs(spark, odd_rows()))
    got = sanitise(df)
    assert got.columns == df.columns
    assert sorted(map(str, got.collect())) == sorted(str(r) for r in df.withColumn("n_chars", F.length("text").cast("long")).collect())
    assert sanitise(docs(spark, [])).count() == 0


def test_terms_that_disclose_a_part_of_values_seen_once(spark):
    common = [(i, f"the report {prose(i, 30)} about weather", "en", "s", 0) for i in range(60)]
    told = [(100 + i, f"the Lonely{'abcd'[i]}word Marthason wrote from {v} about weather", "en", "s", 0) for i, v in enumerate(["ann@acme.org", "bob@Acme.org", "cat@acme.org", "dan@acme.org"])]
    _, terms = find_personal_data(docs(spark, common + told))
    found = {r["id"]: [t["value"] for t in r["terms"]] for r in terms.collect()}
    assert set(found) == set(range(100, 104))
    assert all("marthason" in t and "about" not in t and not any(x.startswith("lonely") for x in t) for t in found.values())


def parts_of(kind, value):
    """The value, and what it shares with others."""
    digits = re.sub("[^0-9]", "", value)
    if kind == "email":
        more = [f"user:{value.split('@')[0].lower()}", f"domain:{value.split('@')[-1].lower()}"]
    else:
        more = {"ip": [f"network:{'.'.join(value.split('.')[:2])}"], "card": [f"issuer:{digits[:6]}"], "phone": [f"area:{digits[:4]}"]}[kind]
    return [f"value:{value}", *more]


def brute_terms(rows, support=3, generalise_at=0.8, remove_at=0.95, share=0.8):
    """id: {(start, end, term, action, general)}, from plain counts."""
    word = re.compile(r"[^\W\d_]{3,}")
    near, spans_of = [], {}
    docs_of_term = defaultdict(set)
    for key, (i, text) in enumerate(rows):
        for w in set(x.lower() for x in word.findall(text)):
            docs_of_term[w].add(key)
        spans = spans_of[key] = brute(text)
        for kind, a, b in spans:
            for m in word.finditer(text):
                inside = (a - CONTEXT <= m.start() and m.end() <= a) or (b <= m.start() and m.end() <= b + CONTEXT)
                if inside and all(m.end() <= s or m.start() >= e for _, s, e in spans):
                    near.append((key, kind, text[a:b], a, m[0].lower(), m.start(), m.end()))
    n_part, n_both = defaultdict(set), defaultdict(set)
    for key, kind, value, _, t, *_ in near:
        for part in parts_of(kind, value):
            n_part[kind, part].add(key)
            n_both[kind, part, t].add(key)
    told = {}
    for _, kind, value, _, t, *_ in near:
        for part in parts_of(kind, value):
            both, entity = len(n_both[kind, part, t]), len(n_part[kind, part])
            if both >= support and entity < len(rows):
                pmi = math.log2(len(rows) * both / (entity * len(docs_of_term[t])))
                told[kind, value, t] = max(told.get((kind, value, t), -math.inf), pmi / math.log2(len(rows) / entity))
    at = defaultdict(set)
    for key, kind, _, a, t, *_ in near:
        at[kind, t].add((key, a))
    out = defaultdict(dict)
    for key, kind, value, a, t, s, e in near:
        d = told.get((kind, value, t), 0)
        if d >= generalise_at:
            wider = [(told[k, v, g], g) for k, v, g in told if (k, v) == (kind, value) and g != t and told[k, v, g] < generalise_at and len(at[kind, t] & at[kind, g]) >= share * len(at[kind, t])]
            found = (d, "remove" if d >= remove_at else "generalise", max(wider)[1] if wider and d < remove_at else None)
            out[rows[key][0]][s, e, t] = max(out[rows[key][0]].get((s, e, t), found), found, key=lambda x: x[0])
    return out


def test_disclosure_and_generalisation_equal_plain_counts(spark):
    common = [(i, f"the report {prose(i, 12)} about weather") for i in range(40)]
    told = [(100 + i, f"the report about Marthason the analyst at +1 (542) 555-3599 about weather {prose(200 + i, 4)}") for i in range(8)]
    # The name stands elsewhere, too, so it is generalised; the profession stands wherever the name does, and more widely.
    told += [(120 + i, f"{prose(300 + i, 8)} marthason came") for i in range(1)] + [(130 + i, f"{prose(400 + i, 8)} an analyst") for i in range(20)]
    told += [(150 + i, f"mail Lonely{'abcd'[i]}word or Groupword at {v}, x@y.zz or 10.1.2.{i}") for i, v in enumerate(["ann@acme.org", "bob@Acme.org", "cat@acme.org", "dan@acme.org"])]
    rows = common + told
    _, terms = find_personal_data(docs(spark, rows), generalise_at=0.5, remove_at=0.99)
    got = {r["id"]: {(t["start"], t["end"], t["value"]): (t["disclosure"], t["action"], t["general"]) for t in r["terms"]} for r in terms.collect()}
    want = brute_terms(rows, generalise_at=0.5, remove_at=0.99)
    assert {i: set(x) for i, x in got.items()} == {i: set(x) for i, x in want.items()}
    for i, x in got.items():
        for place, (d, action, general) in x.items():
            assert abs(d - want[i][place][0]) < 1e-9 and (action, general) == want[i][place][1:]
    assert {x[1] for v in got.values() for x in v.values()} == {"remove", "generalise"}
    name = next(x for (_, _, t), x in got[100].items() if t == "marthason")
    assert name[1:] == ("generalise", "analyst")
    clean = {r["doc_id"]: r["text"] for r in sanitise(docs(spark, rows), generalise_at=0.5, remove_at=0.99).collect()}
    assert clean[100].startswith("the report about [analyst] the analyst at [PHONE] about weather")


def test_very_many_entities_in_one_text(spark):
    text = "Groupword mail ann@acme.org +1 (542) 555-3599 é " * 3000
    rows = [(i, text) for i in range(4)] + [(10 + i, prose(i, 9)) for i in range(30)]
    _, terms = find_personal_data(docs(spark, rows))
    found = {r["id"]: r["terms"] for r in terms.collect()}
    assert set(found) == {0, 1, 2, 3} and all(len(t) == 6000 for t in found.values())
    clean = {r["doc_id"]: r["text"] for r in sanitise(docs(spark, rows)).collect()}
    assert clean[0].count("[EMAIL]") == clean[0].count("[PHONE]") == 3000 and "Groupword" not in clean[0] and "é" in clean[0]


def joined_rows(df):
    """Rows that each join of the plan made when `df` was collected."""
    df.collect()
    out = []

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        if "Join" in kind:
            out.append(node.metrics().apply("numOutputRows").value())
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    walk(df._jdf.queryExecution().executedPlan())
    return out


def test_joins_do_not_grow_with_texts_that_merely_hold_the_terms(spark):
    def told(n):
        rows = [(i, "alpha bravo mail ann@acme.org charlie delta") for i in range(4)] + [(10 + i, "alpha bravo mail charlie delta") for i in range(n)]
        df = docs(spark, rows)
        each = df.where("text like '%@%'").withColumn("t", F.explode(pii.contexts(F.col("text"), base_spans(F.col("text"))))).select(pii.row_id().alias("id"), F.xxhash64("text").alias("text_hash"), "t.*")
        return pii.disclosing_terms(df.select("text"), each)

    few, many = told(100), told(1000)
    assert {r["term"]: r["disclosure"] for r in many.collect()} == dict.fromkeys(["alpha", "bravo", "mail", "charlie", "delta"], 0.0)
    made = joined_rows(few)
    assert made and made == joined_rows(many) and max(made) < 100
