"""Language identification: averaged hashed subword embeddings and a linear softmax (Joulin et al., 2016), in numpy.

A text's features are the byte n-grams of its lower-cased letters, words parted by one blank, hashed into
buckets. Their embeddings are averaged over the whole text and a linear layer gives one score per language. Both are learnt by
stochastic gradient descent. As the layer is linear, embeddings times layer is one small table of scores
per bucket, and that table is all that executors need.

Rejection is calibrated on labelled texts that the descent did not see, whole and in pieces of a few words: a temperature makes the winning probability
match how often it is right, and a text is rejected if it has no letter (it is `und`), or if its probability is under a
threshold that all but a stated share of those texts pass.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, slices, table

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """`sample_rows` labelled texts are fitted, at the most, each as a whole; all else covers all rows."""

    sizes: tuple[int, ...] = (2, 3, 4)
    buckets: int = 1 << 15
    width: int = 16
    epochs: int = 12
    least_steps: int = 600  # more epochs, if few rows are labelled
    batch: int = 32
    rate: float = 20.0
    sample_rows: int = 1500
    calibration_share: float = 0.25
    rejected_share: float = 0.002
    seed: int = 3


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    scores: np.ndarray  # a row for each bucket, a column for each language
    bias: np.ndarray
    temperature: float
    least: float
    settings: Settings


# --- features ---------------------------------------------------------------------------------

#: ASCII letters lower-cased, bytes of other characters as they are, all else a blank.
_LETTERS = np.array([b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)], np.uint8)


def features(texts: list[str | None], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of the texts, and the text that it belongs to (sorted)."""
    raw = [b" %s " % (t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    size = np.array([len(x) for x in raw], np.int64)
    joined = _LETTERS[np.frombuffer(b"".join(raw), np.uint8)]
    owner = np.repeat(np.arange(len(raw), dtype=np.int32), size)
    blank = joined == 0x20
    keep = ~(blank & np.r_[False, blank[:-1]] & np.r_[False, owner[1:] == owner[:-1]])  # blanks in a row are one
    joined, owner, blank = joined[keep].astype(np.uint32), owner[keep], blank[keep]
    found, of = [], []
    for n in s.sizes:
        if len(joined) < n:
            continue
        end = len(joined) - n + 1
        acc = joined[:end] * np.uint32(0x9E3779B1) + np.uint32(n)
        inner = np.zeros(end, bool)
        for k in range(1, n):
            acc = (acc ^ (acc >> np.uint32(15))) * np.uint32(0x85EBCA6B) + joined[k : end + k] * np.uint32(0xC2B2AE35)
            if k < n - 1:
                inner |= blank[k : end + k]  # a subword does not go over a blank, it only begins or ends with one
        acc = (acc ^ (acc >> np.uint32(13))) * np.uint32(0x27D4EB2F)
        fine = ~inner & (owner[:end] == owner[n - 1 :])
        found.append((acc >> np.uint32(16))[fine] & np.uint32(s.buckets - 1))
        of.append(owner[:end][fine])
    return np.concatenate(found) if found else np.zeros(0, np.uint32), np.concatenate(of) if of else np.zeros(0, np.int32)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


# --- learning -----------------------------------------------------------------------------------


def _averages(texts: list[str], s: Settings) -> np.ndarray:
    """Share of each bucket among a text's features: one row a text."""
    out = np.zeros((len(texts), s.buckets), np.float32)
    for i, t in enumerate(texts):
        own, _ = features([t], s)
        if len(own):
            out[i] = np.bincount(own, minlength=s.buckets) / len(own)
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: list[tuple[str, str]], s: Settings) -> Model:
    """Model of (text, language) rows. A share of them is kept from the descent, to calibrate."""
    languages = tuple(sorted({lang for _, lang in rows}))
    if not languages:
        return Model((), np.zeros((s.buckets, 0), np.float32), np.zeros(0, np.float32), 1.0, 0.0, s)
    rng = np.random.default_rng(s.seed)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    held = int(len(rows) * s.calibration_share)
    x = _averages([t for t, _ in rows], s)
    y = np.array([languages.index(lang) for _, lang in rows])
    fit = np.arange(held, len(rows))
    embed = (rng.random((s.buckets, s.width), np.float32) - 0.5) / s.width
    layer = np.zeros((s.width, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    epochs = max(s.epochs, -(-s.least_steps * s.batch // len(fit)))
    for epoch in range(epochs):
        rate = s.rate * (1 - epoch / epochs)
        order = rng.permutation(fit)
        for a in range(0, len(order), s.batch):
            at = order[a : a + s.batch]
            hidden = x[at] @ embed
            wrong = _softmax(hidden @ layer + bias)
            wrong[np.arange(len(at)), y[at]] -= 1
            wrong /= len(at)
            back = wrong @ layer.T
            layer -= np.float32(rate) * (hidden.T @ wrong)
            bias -= np.float32(rate * 0.01) * wrong.sum(axis=0)
            used = np.flatnonzero(x[at].any(axis=0))
            embed[used] -= np.float32(rate) * (x[np.ix_(at, used)].T @ back)
    scores = embed @ layer
    seen = [rows[k] for k in (range(held) if held else fit)]
    pieces = [(piece, lang) for text, lang in seen for piece in _pieces(text, rng)]
    model = Model(languages, scores.astype(np.float32), bias, 1.0, 0.0, s)
    logits, count = _logits(model, [t for t, _ in pieces])
    named = np.array([languages.index(lang) for _, lang in pieces])
    temperature, least = _calibrated(logits[count > 0], named[count > 0], s.rejected_share) if (count > 0).any() else (1.0, 0.0)
    return replace(model, temperature=temperature, least=least)


def _pieces(text: str, rng: np.random.Generator, each: int = 3, words: int = 6) -> list[str]:
    """The text, and some runs of a few of its words: whole texts alone are too easy to show how sure the model may be."""
    parts = text.split()
    out = [text]
    for _ in range(each if parts else 0):
        at, n = rng.integers(0, len(parts)), rng.integers(1, words + 1)
        out.append(" ".join(parts[at : at + n]))
    return out


def _calibrated(logits: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Temperature with the least log loss; probability under which `share` of the rightly named texts and pieces fall."""
    loss = {t: -np.log(np.maximum(_softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean() for t in np.geomspace(0.05, 10, 40)}
    best = min(loss, key=loss.get)
    p = _softmax(logits / best)
    right = p.max(axis=1)[p.argmax(axis=1) == y]
    # Half of what separates the lowest of them from chance: calibration texts are few, others are shorter or odder.
    low = float(np.quantile(right, share)) if len(right) else 0.0
    chance = 1 / logits.shape[1]
    return float(best), min(low, chance + (low - chance) / 2) if low > chance else 0.0


# --- prediction ---------------------------------------------------------------------------------


def _logits(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Scores of the languages and number of features, for each text."""
    n, k = len(texts), len(model.languages)
    total, count = np.zeros((n, k)), np.zeros(n)
    for a, b in slices(texts):
        own, of = features(texts[a:b], model.settings)
        for column in range(k):
            total[a:b, column] = np.bincount(of, model.scores[own, column], minlength=b - a)
        count[a:b] = np.bincount(of, minlength=b - a)
    return total / np.maximum(count, 1)[:, None] + model.bias, count


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The likeliest language (`und` without a letter), its probability, and whether the model rejects it, for each text."""
    n = len(texts)
    if not model.languages:
        return [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
    logits, count = _logits(model, texts)
    p = _softmax(logits / model.temperature)
    best = p.argmax(axis=1)
    score = np.clip(p.max(axis=1), 0.0, 1.0)
    known = np.array([c > 0 and has_letter(t) for c, t in zip(count, texts, strict=True)], bool)
    langs = [model.languages[i] if ok else UNKNOWN for i, ok in zip(best, known, strict=True)]
    return langs, np.where(known, score, 0.0), ~known | (score < model.least)


def fit(labelled: DataFrame, s: Settings = Settings()) -> Model:
    """Model of a bounded sample of `labelled` (doc_id, text, lang): rows of least hash, whole texts; rows with a null text or lang are left out.

    Rows are ranked by hashes of id and text, then by lang, and only these come to the driver until the sample is known. Rows alike in all three
    count once, so that however many share an id, or have none, no more than `sample_rows` texts are collected.
    """
    rank = ["__at", "__text", "lang"]
    # All null ids have one hash, which is then one of many.
    hashed = labelled.where("lang is not null and text <> ''").select("text", "lang", F.xxhash64(F.lit(s.seed), "doc_id").alias("__at"), F.xxhash64("text").alias("__text"))
    ranked = hashed.select(*rank).orderBy(*rank).limit(s.sample_rows).collect()
    if not ranked:
        return train([], s)
    last = F.struct(*(F.lit(ranked[-1][c]).alias(c) for c in rank))
    drawn = hashed.where(F.struct(*rank) <= last).groupBy(*rank).agg(F.min("text").alias("text")).collect()
    return train([(r["text"], r["lang"]) for r in sorted(drawn, key=lambda r: tuple(r[c] for c in rank))], s)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of `docs` (with a column text) with lang_pred, lang_score and lang_rejected, which replace columns of these names; other columns stay.

    A text that is null or has no letter, or any text if nothing was labelled, is `und`, has score 0 and is rejected; one under
    the calibrated threshold is rejected under its likeliest name. An empty table gives no rows; repeated rows are named alike;
    ties go to the first language by name.
    """
    prepare(docs.sparkSession)
    cast = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("lang_pred", "lang_score", "lang_rejected")

    def name(batches):
        for batch in batches:
            langs, score, rejected = predict(cast.value, batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(rejected)], names=[*batch.schema.names, "lang_pred", "lang_score", "lang_rejected"])

    schema = kept.withColumns({"lang_pred": F.lit(""), "lang_score": F.lit(0.0), "lang_rejected": F.lit(True)}).schema
    return kept.mapInArrow(name, schema)


def fold(doc_id="doc_id", folds: int = 4):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds))


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row of documents. Null ids are not held out; null texts are `und`; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold() == 2, F.lit(False))
    model = fit(docs.where(~held_out))
    named = identify(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return named.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))
