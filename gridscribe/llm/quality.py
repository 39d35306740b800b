"""Quality classifier: a convolutional network over bytes, in numpy (after Conneau et al., 2017, at one layer).

Bytes are embedded; learned filters of eight bytes slide over the whole text in steps of four. The text is cut into overlapping
chunks, and each filter's largest answer in a chunk is that chunk's feature. Features are combined over chunks by
their mean and by their largest value, and a linear layer gives the probability. Short texts have one chunk, long ones
as many as it takes; no byte is left out.

As a filter's eight bytes are two rows of four, a filter is two small matrices, and a pass over a text is one product.

A text's score must not depend on the texts that it is scored with. What a matrix product rounds to depends on its shape, so learnt
embeddings, filters and biases are rounded to whole numbers small enough that every product and sum of a text's features
is exact in the floats that hold it; what follows is summed for each text by itself.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, slices, table

ROW = 4  # bytes in a row; a filter sees two


@dataclass(frozen=True)
class Settings:
    """At most `sample_rows` labelled texts are fitted, each as a whole; scoring covers all rows."""

    width: int = 8
    filters: int = 48
    chunk: int = 512
    overlap: int = 64
    epochs: int = 6
    least_steps: int = 500  # more epochs, if few rows are labelled
    batch: int = 16
    rate: float = 0.004
    decay: float = 1e-4
    sample_rows: int = 2500
    seed: int = 4


Weights = dict[str, np.ndarray]


def start_weights(s: Settings) -> Weights:
    rng = np.random.default_rng(s.seed)
    draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    return {
        "embed": draw(256, s.width, scale=0.5),
        "filters": draw(ROW * s.width, 2 * s.filters, scale=(2 * ROW * s.width) ** -0.5),  # first rows' half, second rows' half
        "bias": np.zeros(s.filters, np.float32),
        "head": draw(2 * s.filters, scale=0.1),
        "offset": np.zeros(1, np.float32),
    }


@dataclass
class Layout:
    """Texts as rows of bytes, one text after the other, and the chunks of each."""

    rows: np.ndarray  # (rows, ROW) bytes
    begin: np.ndarray  # first row of each chunk
    end: np.ndarray  # one past the last place of a filter in it
    owner: np.ndarray  # text of each chunk, sorted


def layout(texts: list[str | None], s: Settings) -> Layout:
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    height = np.array([max(2, -(-len(x) // ROW)) for x in raw], np.int64)
    padded = b"".join([x.ljust(h * ROW, b"\0") for x, h in zip(raw, height.tolist(), strict=True)] + [b"\0" * 2 * ROW])
    first = np.cumsum(height) - height
    places, size, step = height - 1, s.chunk // ROW, (s.chunk - s.overlap) // ROW
    chunks = np.maximum(1, -(-(places - s.overlap // ROW) // step))
    owner = np.repeat(np.arange(len(raw)), chunks)
    within = np.arange(chunks.sum()) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    begin = first[owner] + within * step
    return Layout(np.frombuffer(padded, np.uint8).reshape(-1, ROW), begin, np.minimum(begin + size, (first + places)[owner]), owner)


def answers(w: Weights, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Embedded rows, and each filter's answer at each row: a column for each place, so that a chunk is a slice of each line."""
    embedded = w["embed"][rows].reshape(len(rows), -1)
    halves = w["filters"].T @ embedded.T
    k = len(w["bias"])
    return embedded, halves[:k, :-1] + halves[k:, 1:]


def _combined(features: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    begins = np.searchsorted(owner, np.arange(texts))
    mean = np.add.reduceat(features, begins, axis=0) / np.bincount(owner, minlength=texts)[:, None].astype(features.dtype)
    return np.concatenate([mean, np.maximum.reduceat(features, begins, axis=0)], axis=1)


#: Largest whole number of an embedding or filter: sums of 2 * ROW * width products of two stay under 2**24, where floats of four bytes are exact.
WHOLE = 500


def rounded(w: Weights, s: Settings) -> Weights:
    """Weights whose embeddings, filters and biases are whole numbers; the head takes the scale back."""
    most = int(((1 << 24) / (2 * ROW * s.width)) ** 0.5) - 1
    a, b = (min(most, WHOLE) / max(1e-9, float(np.abs(w[n]).max())) for n in ("embed", "filters"))
    whole = {"embed": np.rint(w["embed"] * a).astype(np.float32), "filters": np.rint(w["filters"] * b).astype(np.float32)}
    return whole | {"bias": np.rint(w["bias"].astype(np.float64) * a * b), "head": w["head"].astype(np.float64) / (a * b), "offset": w["offset"].astype(np.float64)}


def probabilities(w: Weights, texts: list[str | None], s: Settings) -> np.ndarray:
    """Of rounded weights: equal texts get equal values, whatever texts stand beside them."""
    if not texts:
        return np.zeros(0)
    at = layout(texts, s)
    features = np.empty((len(at.begin), len(w["bias"])), np.float64)
    step = 1 << 15  # rows at once; a chunk belongs to the step that it begins in
    cuts = np.searchsorted(at.begin, np.arange(0, len(at.rows) + step, step))
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a < b:
            low, high = at.begin[a], at.end[a:b].max() + 2
            _, out = answers(w, at.rows[low:high])
            pairs = np.stack([at.begin[a:b], at.end[a:b]], axis=1).ravel() - low
            features[a:b] = np.maximum.reduceat(out, pairs, axis=1)[:, ::2].T
    features = np.maximum(features + w["bias"], 0)
    z = (_combined(features, at.owner, len(texts)) * w["head"]).sum(axis=1) + w["offset"]
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def gradients(w: Weights, texts: list[str], y: np.ndarray, s: Settings) -> Weights:
    """Of the mean log loss. A filter learns from the place of its largest answer in each chunk."""
    at, k = layout(texts, s), len(w["bias"])
    embedded, out = answers(w, at.rows)
    best = np.stack([a + out[:, a:b].argmax(axis=1) for a, b in zip(at.begin.tolist(), at.end.tolist(), strict=True)])  # (chunks, filters)
    features = np.maximum(out[np.arange(k), best] + w["bias"], 0)
    combined = _combined(features, at.owner, len(texts))
    p = 1 / (1 + np.exp(-np.clip(combined @ w["head"] + w["offset"], -40, 40)))
    wrong = ((p - y) / len(y)).astype(np.float32)
    chunks = np.bincount(at.owner, minlength=len(texts))[:, None]
    back = (wrong[:, None] * w["head"][:k] / chunks.astype(np.float32))[at.owner]
    top = features == combined[at.owner, k:]
    back += top * (wrong[:, None] * w["head"][k:])[at.owner] / np.maximum(1, np.add.reduceat(top, np.searchsorted(at.owner, np.arange(len(texts))), axis=0, dtype=np.int32))[at.owner].astype(np.float32)
    back *= features > 0
    grad: Weights = {"head": combined.T @ wrong, "offset": wrong.sum(keepdims=True), "bias": back.sum(axis=0)}
    used, of = np.nonzero(back)  # most answers are not above zero and teach nothing
    weight, place = back[used, of], best[used, of]
    by_filter = np.argsort(of, kind="stable")
    begins = np.searchsorted(of[by_filter], np.arange(k))
    grad["filters"], grad["embed"] = np.zeros_like(w["filters"]), np.zeros_like(w["embed"])
    if not len(used):
        return grad
    for shift, columns in ((0, slice(0, k)), (1, slice(k, 2 * k))):
        part = (weight[:, None] * embedded[place + shift])[by_filter]
        sums = np.add.reduceat(np.concatenate([part, np.zeros((1, part.shape[1]), np.float32)]), begins, axis=0)
        sums[np.bincount(of, minlength=k) == 0] = 0
        grad["filters"][:, columns] = sums.T
        to_bytes = (weight[:, None] * w["filters"][:, columns].T[of]).reshape(-1, s.width)
        byte = at.rows[place + shift].ravel()
        for d in range(s.width):
            grad["embed"][:, d] += np.bincount(byte, to_bytes[:, d], minlength=256)
    return grad


def train(rows: list[tuple[str, int]], s: Settings = Settings()) -> Weights:
    """Rounded weights of what Adam finds on (text, 0 or 1) rows; without rows, those that score every text 0.5."""
    w = start_weights(s)
    if not rows:
        return rounded(w | {"head": np.zeros_like(w["head"])}, s)
    rng = np.random.default_rng(s.seed)
    y = np.array([label for _, label in rows], np.float32)
    share = float(np.clip(y.mean(), 0.01, 0.99))
    w["offset"][:] = np.log(share / (1 - share))
    m, v, t = {n: np.zeros_like(x) for n, x in w.items()}, {n: np.zeros_like(x) for n, x in w.items()}, 0
    epochs = max(s.epochs, -(-s.least_steps * s.batch // len(rows)))
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        rate = s.rate * (1 - epoch / epochs)
        for a in range(0, len(order), s.batch):
            at = order[a : a + s.batch]
            t += 1
            for n, g in gradients(w, [rows[i][0] for i in at], y[at], s).items():
                m[n] += 0.1 * (g - m[n])
                v[n] += 0.001 * (g * g - v[n])
                w[n] = (w[n] * np.float32(1 - s.decay) - np.float32(rate) * (m[n] / (1 - 0.9**t)) / (np.sqrt(v[n] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    w["offset"] -= np.float32(np.log(share / (1 - share)))  # the probability if both labels were as frequent
    return rounded(w, s)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", s: Settings = Settings()) -> Weights:
    """Weights learnt from a bounded sample of labelled texts: rows of `labels` (doc_id, label) of least hash; nulls are left out.

    Texts are taken whole, however long. Of rows of `docs` that share an id, one is taken; of labels that differ for an id, each counts.
    """
    asked = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    drawn = asked.orderBy(F.xxhash64(F.lit(s.seed), "doc_id"), "doc_id", "label").limit(s.sample_rows)
    texts = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(drawn), "doc_id")  # no more than sample_rows
    # An id may stand in many rows: one text for each of them, the least hash, so that there are no more texts than labels.
    one = texts.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))["text"].alias("text"))
    found = one.orderBy("doc_id", "label").collect()
    return train([(r["text"], r["label"]) for r in found], s)


def score(docs: DataFrame, w: Weights, s: Settings = Settings(), out: str = "score") -> DataFrame:
    """Rows of `docs` with the probability of label 1 for the whole text in column `out`, which replaces one of that name.

    Null and empty texts are scored as one chunk of zeros. Equal texts score alike, to the last bit, in whatever batch or partition
    they stand; an empty table gives no rows; columns of other names stay.
    """
    prepare(docs.sparkSession)
    cast, kept = docs.sparkSession.sparkContext.broadcast(w), docs.drop(out)

    def scored(batches):
        for batch in batches:
            texts = batch["text"].to_pylist()
            p = [probabilities(cast.value, texts[a:b], s) for a, b in slices(texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([np.zeros(0), *p]))], names=[*batch.schema.names, out])

    return kept.mapInArrow(scored, kept.withColumn(out, F.lit(0.0)).schema)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of documents. Null ids are not held out; repeated rows and equal texts score alike; an empty table gives no rows."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    w = fit(docs, labels.where(~held_out))
    scored = score(docs.select("doc_id", "text", held_out.alias("held_out")), w).drop("text")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
