"""Licence notices found with a bounded number of errors.

A notice of n characters is allowed k errors (inserted, deleted or changed characters). Split into k + 1 pieces,
one piece at least survives unchanged (the pigeonhole principle), so an exact search for the pieces
finds every place where the notice can stand. Around each such place, and only there, the `regex`
library's bounded-error matching decides and reports where the notice begins and ends. Places that touch are
matched in steps of a few lengths of the notice, so that the work grows with the text and not with its square.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import prepare, table

#: Fixed phrases and their labels: words that stand one after the other.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Short notices and the labels that the method adds.
NOTICES = (
    ("all rights reserved", "reserved"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by 4 0", "cc-by"),
    ("creative commons attribution", "cc-by"),
    ("gnu lesser general public license", "lgpl"),
    ("licensed under the gnu general public license", "gpl"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("mozilla public license version 2 0", "mpl-2.0"),
    ("dedicated to the public domain", "public-domain"),
)
#: One error is allowed for so many characters of a notice.
CHARS_PER_ERROR = 10


@dataclass(frozen=True)
class Notice:
    text: str
    label: str
    errors: int
    pieces: tuple[tuple[int, bytes], ...]  # where a piece begins in the notice, and the piece
    pattern: regex.Pattern


def compile_notice(text: str, label: str, chars_per_error: int = CHARS_PER_ERROR) -> Notice:
    k = max(1, len(text) // chars_per_error)
    cuts = [round(i * len(text) / (k + 1)) for i in range(k + 2)]
    pieces = tuple((a, text[a:b].encode()) for a, b in zip(cuts, cuts[1:], strict=False))
    return Notice(text, label, k, pieces, regex.compile(f"(?b)(?:{regex.escape(text)}){{e<={k}}}"))


#: Bytes that stand for themselves in the scanned form; A-Z are lower-cased, all others become a blank.
_FORM = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def scan_form(text: str | None) -> tuple[bytes, int]:
    """Lower-cased words with one blank before and after each, as UTF-8; and their number."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_FORM).split()
    return b" %s " % b" ".join(words) if words else b" ", len(words)


def places(form: bytes, phrase: bytes) -> list[int]:
    """Word indices at which the words of `phrase` stand in a row."""
    out, at, needle = [], form.find(b" " + phrase + b" "), b" " + phrase + b" "
    done = word = 0
    while at >= 0:
        word += form.count(b" ", done, at)
        done = at
        out.append(word)
        at = form.find(needle, at + 1)
    return out


def fuzzy_places(form: bytes, notice: Notice) -> list[tuple[int, int, int]]:
    """(begin, end, errors) in `form` for places of a notice with its bounded errors, not overlapping."""
    spans: list[tuple[int, int]] = []
    reach, n = notice.errors, len(notice.text)
    for offset, piece in notice.pieces:
        at = form.find(piece)
        while at >= 0:
            spans.append((max(0, at - offset - reach), min(len(form), at - offset + n + reach)))
            at = form.find(piece, at + 1)
    return [found for begin, end in _merged(spans) for found in _matched(form, begin, end, notice)]


def _matched(form: bytes, begin: int, end: int, notice: Notice) -> list[tuple[int, int, int]]:
    """Places of the notice between two bytes of `form`, best ones first where they overlap, in order.

    One step looks at four times what a match can take. A match that begins in its last quarter is left to the next step, which begins there,
    so each is seen whole.
    """
    out: list[tuple[int, int, int]] = []
    most, least = len(notice.text) + notice.errors, len(notice.text) - notice.errors
    while end - begin >= least:
        stop = min(end, begin + 4 * most)
        # Latin-1 keeps one character a byte; notices are ASCII.
        window, left, found = form[begin:stop].decode("latin-1"), [(0, stop - begin)], []
        while left:  # the best match of all may have worse ones on either side
            a, b = left.pop()
            if b - a >= least and (m := notice.pattern.search(window, a, b)):
                found.append((begin + m.start(), begin + m.end(), sum(m.fuzzy_counts)))
                left += [(m.end(), b), (a, m.start())]
        sure = end if stop == end else stop - most
        found = sorted(x for x in found if x[0] < sure)
        out += found
        begin = max(sure, found[-1][1]) if found else sure
    return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(set(spans)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _best_apart(found: list[dict]) -> list[dict]:
    """Of finds that share words, the best one: alike notices would otherwise all claim a place."""
    kept: list[dict] = []  # apart, in the order of the text
    starts: list[int] = []
    for x in sorted(found, key=lambda x: (-x["score"], x["first_word"] - x["end_word"], x["first_word"], x["label"])):
        at = bisect_left(starts, x["first_word"])
        if (at == 0 or kept[at - 1]["end_word"] <= x["first_word"]) and (at == len(kept) or x["end_word"] <= starts[at]):
            kept.insert(at, x)
            starts.insert(at, x["first_word"])
    return kept


def scan_text(text: str | None, phrases: Sequence[tuple[bytes, str]], notices: Sequence[Notice]) -> dict:
    form, n_words = scan_form(text)
    base = [(at, label) for phrase, label in phrases for at in places(form, phrase)]
    places_of = [(notice, place) for notice in notices for place in fuzzy_places(form, notice)]
    blanks = np.flatnonzero(np.frombuffer(form, np.uint8) == 0x20).tolist() if places_of else []  # word i stands between blanks i and i + 1
    found = _best_apart([
        {"label": notice.label, "first_word": bisect_right(blanks, begin) - 1, "end_word": bisect_left(blanks, end), "errors": errors, "score": 1 - errors / len(notice.text)}
        for notice, (begin, end, errors) in places_of
    ])
    starts = [at for at, _ in base]
    return {
        "n_words": n_words,
        "n_base": len(base),
        "first_word": min(starts, default=None),
        "last_word": max(starts, default=None),
        "base_labels": ",".join(sorted({label for _, label in base})),
        "labels": ",".join(sorted({label for _, label in base} | {x["label"] for x in found})),
        "score": 1.0 if base else max((x["score"] for x in found), default=0.0),
        "notices": found,
    }


_SPAN = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("errors", pa.int64()), ("score", pa.float64())])
_FIELDS = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("notices", pa.list_(_SPAN))]
_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, notices array<struct<label: string, first_word: long, end_word: long, errors: long, score: double>>"


def scan_licenses(docs: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES, notices: Sequence[tuple[str, str]] = NOTICES, chars_per_error: int = CHARS_PER_ERROR) -> DataFrame:
    """One row for each row of `docs` (doc_id, text), each text scanned whole in its own task.

    first_word and last_word are the smallest and largest start of an exact phrase; `notices` lists
    the fuzzy finds with their words (end exclusive), errors and score. `score` is 1 for an exact phrase, else the
    best find's share of unchanged characters, else 0. Null and empty texts have no words and no labels;
    repeated rows give repeated results; other columns are not looked at.
    """
    prepare(docs.sparkSession)
    known = [compile_notice(text, label, chars_per_error) for text, label in notices]
    exact = [(re.sub(r"\s+", " ", p).encode(), label) for p, label in phrases]
    schema = pa.schema(_FIELDS)

    def scan(batches):
        for b in batches:
            rows = [scan_text(t, exact, known) for t in b.column("text").to_pylist()]
            columns = [b.column("doc_id"), *(pa.array([r[f.name] for r in rows], f.type) for f in list(schema)[1:])]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(scan, _SCHEMA)


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    """The scan of every row of documents, without the notices. Null and empty texts have no words, a score of 0 and null places; repeated rows are scanned alike; an empty table gives no rows."""
    return scan_licenses(table(spark, sf_dir, "documents")).drop("notices")
