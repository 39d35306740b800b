import random

import numpy as np

from gridscribe.llm.language_id import Settings, features, fit, identify, op9_language_id, predict, train

from .helpers import docs, odd_rows, with_clashing_columns

SYLLABLES = {"aa": "ka ro mi ta sel nu".split(), "bb": "tion ing est whe ould the".split(), "cc": "über ßen schä öll ung keit".split()}


def text(lang, seed, n=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def rows(seed, n):
    return [(text(lang, seed + k, 3 + k % 80), lang) for k in range(n) for lang in SYLLABLES]


def test_held_out_accuracy():
    model = train(rows(0, 60), Settings())
    held = rows(10_000, 40)
    langs, score, rejected = predict(model, [t for t, _ in held])
    assert np.mean([a == b for a, (_, b) in zip(langs, held)]) > 0.97
    assert ((score >= 0) & (score <= 1)).all() and rejected.mean() < 0.05


def test_rejects_what_has_no_letter():
    model = train(rows(0, 40), Settings(epochs=4))
    langs, score, rejected = predict(model, [None, "", "123 456 .", "٣٤", "keit keit"])
    assert langs[:4] == ["und"] * 4 and langs[4] != "und" and list(score[:4]) == [0, 0, 0, 0] and rejected[:4].all()


def test_low_confidence_is_rejected_under_its_name():
    model = train(rows(0, 40), Settings(epochs=4))
    half = text("aa", 5, 40) + " " + text("bb", 6, 40) + " " + text("cc", 7, 40)
    langs, score, rejected = predict(model, [half, text("aa", 8, 80)])
    assert langs[0] in model.languages and score[0] < score[1] and not rejected[1]


def test_features_are_of_the_whole_text_and_do_not_cross_texts():
    s = Settings()
    a, b = "abc def" * 50, "ghi"
    both, owner = features([a, b], s)
    for i, t in enumerate((a, b)):
        alone, _ = features([t], s)
        assert sorted(both[owner == i]) == sorted(alone)
    assert len(features(["x" * 40_000], s)[0]) > 100_000
    assert (np.sort(features(["ab   ab"], s)[0]) == np.sort(features(["ab ab"], s)[0])).all()


def test_frame(spark):
    made = [(k, t, lang, "s", 0) for k, (t, lang) in enumerate(rows(0, 30))]
    df = with_clashing_columns(docs(spark, made + odd_rows()))
    model = fit(df, Settings(epochs=6))
    assert model.languages[:2] == ("aa", "bb")
    got = identify(df, model)
    assert set(df.columns) | {"lang_score", "lang_rejected"} == set(got.columns)
    out = got.collect()
    assert len(out) == len(made) + len(odd_rows())
    assert all(r["lang_pred"] == "und" for r in out if not (r["text"] or "").strip())
    assert np.mean([r["lang_pred"] == r["lang"] for r in out if r["source"] == "s"]) > 0.97
    none = fit(docs(spark, []))
    assert {r["lang_pred"] for r in identify(df, none).collect()} == {"und"}
    assert identify(docs(spark, []), model).count() == 0


def test_the_sample_is_bounded_however_many_rows_share_an_id(spark):
    from gridscribe.llm import language_id

    made = [(None, t, lang) for t, lang in rows(0, 60)] + [(None, "ka ro mi", "aa")] * 300 + [(5, "tion ing est", "bb")] * 300 + [(6, "sel nu " * 5_000, "aa")]
    df = docs(spark, made)
    seen = []
    old, language_id.train = language_id.train, lambda r, s: seen.append(r)
    try:
        for parts in (1, 5):
            fit(df.repartition(parts), Settings(sample_rows=40))
        fit(df, Settings(sample_rows=10_000))
    finally:
        language_id.train = old
    assert len(seen[0]) <= 40 and seen[0] == seen[1]
    assert len(seen[2]) == len({(t, lang) for _, t, lang in made}) and ("sel nu " * 5_000, "aa") in seen[2]


def test_learnt_scores_equal_plain_averages_and_softmax():
    model = train(rows(0, 30), Settings(epochs=4))
    texts = [text("aa", 1, 9), text("bb", 2, 200), "keit"]
    langs, score, _ = predict(model, texts)
    for t, lang, p in zip(texts, langs, score):
        own, _ = features([t], model.settings)
        mean = [sum(float(model.scores[b, k]) for b in own) / len(own) + float(model.bias[k]) for k in range(len(model.languages))]
        e = [np.exp((x - max(mean)) / model.temperature) for x in mean]
        assert lang == model.languages[int(np.argmax(mean))] and abs(max(e) / sum(e) - p) < 1e-9


def test_calibration_is_the_least_log_loss_and_a_quantile():
    from gridscribe.llm.language_id import _calibrated

    rng = np.random.default_rng(1)
    y = rng.integers(0, 3, 400)
    logits = rng.normal(0, 1, (400, 3)) + 3 * np.eye(3)[y]
    t, least = _calibrated(logits, y, 0.01)
    soft = lambda z: np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    loss = lambda t: -np.mean(np.log(soft(logits / t)[np.arange(400), y]))
    assert loss(t) <= min(loss(x) for x in np.geomspace(0.05, 10, 40)) + 1e-12
    p = soft(logits / t)
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == y])
    low = np.quantile(right, 0.01)
    assert abs(least - min(low, 1 / 3 + (low - 1 / 3) / 2)) < 1e-12


def test_query_learns_from_other_folds_only(spark, sf_dir):
    got = op9_language_id(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert held and np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.9
