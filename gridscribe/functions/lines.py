"""Text rules on single strings, for folds that run inside one Arrow group; the column forms are in `text`."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Collection, Iterable
from functools import lru_cache

from . import text as T

SEPARATOR, INDENT = T.SEPARATOR, T.INDENT


def _python(pattern: str) -> re.Pattern:
    """A pattern of `text`, in Python's spelling of code points and flags."""
    flags = re.IGNORECASE if pattern.startswith("(?iu)") else 0
    pattern = pattern.removeprefix("(?iu)")
    return re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: rf"\U{int(m[1], 16):08x}", pattern), flags)


BULLET, FAKE_HEADER, INDEX_HEADER, LINE_INDEX = map(_python, (T.BULLET, T.FAKE_HEADER, T.INDEX_HEADER, T.LINE_INDEX))
NUMERIC = re.compile(r"[\d.,%/\s-]+")
_TOKEN = re.compile(r"[^\W_]+")
_COUNTER = re.compile(r"(\d{1,4})\s*[.)]?")


def squeeze(s: str | None) -> str:
    return " ".join((s or "").split())


def tokens(s: str) -> list[str]:
    return _TOKEN.findall(unicodedata.normalize("NFC", s).lower())


def within(wanted: Collection[str], parts: Iterable[str], few: int = 64) -> set[str]:
    """Which of the words stand in the parts written together. A few are searched one by one; many are looked up by their lengths, in one pass over the text."""
    stream = "".join(parts)
    if len(wanted) <= few:
        return {w for w in wanted if w in stream}
    found: set[str] = set()
    for n in {len(w) for w in wanted}:
        same = {w for w in wanted if len(w) == n}
        found.update(w for k in range(len(stream) - n + 1) if (w := stream[k : k + n]) in same)
    return found


def is_bullet(s: str) -> bool:
    return BULLET.match(s) is not None


def unbulleted(s: str) -> tuple[str, str]:
    """Marker and text."""
    m = BULLET.match(s)
    return (m[1], s[m.end() :].strip()) if m else ("", s)


def bare(s: str) -> str:
    return unbulleted(s.lstrip(" "))[1]


def counts_rows(header: str) -> bool:
    return INDEX_HEADER.match(squeeze(header)) is not None


@lru_cache(maxsize=4096)
def says_nothing(header: str) -> bool:
    h = header.strip().rstrip(":").strip()
    return not h or FAKE_HEADER.match(h) is not None or INDEX_HEADER.match(h) is not None


def counter(s: str) -> int | None:
    m = _COUNTER.fullmatch(s.split(SEPARATOR)[0].strip())
    return int(m[1]) if m else None


def dashed(s: str) -> str:
    own = LINE_INDEX.match(s) or (SEPARATOR in s and counter(s) is not None)
    return s if own else f"- {s}"


def labelled(header: str, value: str) -> str:
    h, v = header.strip().rstrip(":").strip(), value.strip()
    redundant = says_nothing(h) or v.lower().startswith(h.lower()) or is_bullet(h)
    return v if redundant else f"{h}: {v}"


def _cut_word(token: str) -> bool:
    if not (1 <= len(token) <= 2 and token.isalpha() and token.islower()):
        return False
    return token not in T.ONE_LETTER if len(token) == 1 else not set(token) & set(T.VOWELS)


def joined(lines: list[str]) -> str:
    out = ""
    for line in filter(None, (x.strip() for x in lines)):
        glue = "" if not out or (out[-1].isalpha() and _cut_word(line.split()[0])) else " "
        out += glue + line
    return out


def tidy(lines: list[str]) -> list[str]:
    out: list[str] = []
    for line in (x.rstrip() for x in lines):
        if line or (out and out[-1]):
            out.append(line)
    return out[:-1] if out and not out[-1] else out
