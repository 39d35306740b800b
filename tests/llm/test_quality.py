import numpy as np

from gridscribe.llm import quality
from gridscribe.llm.quality import Settings, fit, gradients, layout, probabilities, score, start_weights, train

from .helpers import docs, odd_rows, prose, with_clashing_columns

SMALL = Settings(width=4, filters=6, chunk=64, overlap=16)


def brute(w, text, s):
    """Each chunk by itself, each filter at each place."""
    data = (text or "").encode()
    data = data.ljust(max(8, -(-len(data) // 4) * 4), b"\0")
    places = len(data) // 4 - 1
    step = (s.chunk - s.overlap) // 4
    halves = np.split(w["filters"], 2, axis=1)
    out, at = [], 0
    while True:
        best = np.full(s.filters, -np.inf)
        for k in range(at, min(at + s.chunk // 4, places)):
            first, second = (w["embed"][list(data[4 * (k + d) : 4 * (k + d) + 4])].ravel() for d in (0, 1))
            best = np.maximum(best, first @ halves[0] + second @ halves[1])
        out.append(np.maximum(best + w["bias"], 0))
        at += step
        if at + s.overlap // 4 >= places:
            break
    z = np.concatenate([np.mean(out, axis=0), np.max(out, axis=0)]) @ w["head"] + w["offset"][0]
    return 1 / (1 + np.exp(-z))


def test_forward_equals_brute_force():
    w = start_weights(SMALL)
    texts = ["", None, "a", "abcdefgh", "x" * 63, "y" * 64, "z" * 65, prose(1, 40), prose(2, 300), "é😀" * 30]
    assert np.allclose(probabilities(w, texts, SMALL), [brute(w, t, SMALL) for t in texts], atol=1e-5)


def test_chunks_cover_the_text_and_overlap():
    at = layout([prose(3, 500), "", "short"], SMALL)
    size = [int((at.end[at.owner == i]).max() - at.begin[at.owner == i].min()) for i in range(3)]
    assert size[0] == -(-len(prose(3, 500)) // 4) - 1
    mine = at.owner == 0
    assert (at.begin[mine][1:] < at.end[mine][:-1]).all()


def test_gradients_equal_differences():
    w = {k: v.astype(np.float64) for k, v in start_weights(SMALL).items()}
    texts, y = [prose(1, 30), prose(2, 9), "zzz"], np.array([1.0, 0.0, 1.0])

    def loss(v):
        p = probabilities(v, texts, SMALL)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    grad = gradients(w, texts, y, SMALL)
    rng = np.random.default_rng(0)
    for name, x in w.items():
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in x.shape)
            up, down = ({**w, name: x.copy()} for _ in range(2))
            up[name][at] += 2e-3
            down[name][at] -= 2e-3
            assert abs((loss(up) - loss(down)) / 4e-3 - grad[name][at]) < 3e-3, name


def made(seed, n):
    good = [(prose(seed + k, 20 + k % 60), 1) for k in range(n)]
    bad = [(" | ".join(prose(seed + 5000 + k, 10 + k % 30).split()) + "###", 0) for k in range(n)]
    return good + bad


def test_held_out_accuracy():
    s = Settings(filters=16, epochs=6)
    w = train(made(0, 60), s)
    held = made(20_000, 40)
    p = probabilities(w, [t for t, _ in held], s)
    assert np.mean((p >= 0.3) == [y == 1 for _, y in held]) > 0.95


def test_frame(spark):
    rows = [(k, t, "en", "s", 0) for k, (t, _) in enumerate(made(0, 40))]
    df = with_clashing_columns(docs(spark, rows + odd_rows()))
    labels = spark.createDataFrame([(k, y, 0) for k, (_, y) in enumerate(made(0, 40))] + [(None, 1, 0), (3, None, 0), (7, 1, 1), (99_999, 0, 0)], "doc_id long, quality int, toxic int")
    s = Settings(filters=8, epochs=3)
    w = fit(df, labels, s=s)
    got = score(df, w, s).collect()
    assert len(got) == len(rows) + len(odd_rows()) and all(0 <= r["score"] <= 1 for r in got)
    twice = [r["score"] for r in got if r["doc_id"] == 11 and r["text"] == "twice the same row"]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert score(docs(spark, []), w, s).count() == 0
    blank = fit(df, labels.limit(0), s=s)
    assert {r["score"] for r in score(df, blank, s).collect()} == {0.5}


def test_scores_do_not_depend_on_neighbours(spark):
    s = Settings(filters=8, epochs=2)
    w = train(made(0, 40), s)
    texts = [None, "", "x", prose(1, 7), prose(2, 900), "é😀" * 999, *(prose(k, 3 + 37 * k) for k in range(30))]
    alone = [probabilities(w, [t], s)[0] for t in texts]
    for size in (2, 3, 7, 20, len(texts)):
        assert np.concatenate([probabilities(w, texts[a : a + size], s) for a in range(0, len(texts), size)]).tolist() == alone
    df = docs(spark, [(k, t, "en", "s", 0) for k, t in enumerate(texts * 2)])
    for parts in (1, 3, 7):
        got = {r["doc_id"]: r["score"] for r in score(df.repartition(parts), w, s).collect()}
        assert [got[k] for k in range(2 * len(texts))] == alone * 2


def test_long_texts_are_learnt_whole_and_repeated_ids_once(spark):
    long = " | ".join(prose(7, 9_000).split())
    df = docs(spark, [(1, long, "en", "s", 0), (1, long, "en", "s", 0), (2, prose(8, 40), "en", "s", 0), (3, None, "en", "s", 0)])
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "doc_id long, quality int")
    seen = []
    old, quality.train = quality.train, lambda rows, s: seen.extend(rows)
    try:
        fit(df, labels)
    finally:
        quality.train = old
    assert seen == [(long, 0), (prose(8, 40), 1)]


def test_query(spark, sf_dir):
    got = quality.op7_quality(spark, sf_dir)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    assert got.where("predicted != cast(score >= 0.3 as int)").count() == 0
