"""The document's own outline, and the numbers that tables and their rows get in it.

Where the rule is a set operation it is one: sections are as-of joins by window, a table's number is the k-th free
one under its section. Rules that carry state from line to line are folds over one document (Arrow groups).
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridscribe.functions import lines as L
from gridscribe.functions import text as T
from gridscribe.groups import arrow_schema, by_group, sent
from gridscribe.schema import NUMBERED
from gridscribe.session import ship_code

# Depth of numbers, words between repeats of a record's name, the mark of a continuation.
NUMBER_DEPTH, REPEAT_WORDS, CONTINUED = 3, int(512 / 2 / 1.8), "(tiếp theo)"


def path_label(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda n: n.cast("string")), ".")


# --- set operations -------------------------------------------------------------------------------------------


def headings_of(lines: DataFrame, text: str = "text") -> DataFrame:
    """Lines that state a number, with `path`; entries of a table of contents have `is_contents`."""
    return lines.withColumn("path", T.parse_heading(F.col(text))).where("path is not null").withColumn("is_contents", T.is_contents_line(F.col(text)))


def section_asof(tables: DataFrame, headings: DataFrame) -> DataFrame:
    """`tables` (doc_id, page, top, ...) with `section`: the path of the last heading strictly before it; null at the start."""
    both = tables.withColumns({"__kind": F.lit(0), "path": F.lit(None).cast("array<int>")}).unionByName(
        headings.select("doc_id", "page", "top", "path").withColumn("__kind", F.lit(1)), allowMissingColumns=True
    )
    before = Window.partitionBy("doc_id").orderBy("page", "top", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("section", F.last("path", ignorenulls=True).over(before)).where("__kind = 0").drop("__kind", "path")


def taken_numbers(headings: DataFrame) -> DataFrame:
    """doc_id, parent, n: every number that a heading or one of its ancestors uses up."""
    levels = F.posexplode(F.col("path"))
    each = headings.select("doc_id", "path", levels.alias("at", "n"))
    return each.select("doc_id", F.expr("slice(path, 1, at)").alias("parent"), "n").distinct()


def table_numbers(tables: DataFrame, headings: DataFrame, order: list[str]) -> DataFrame:
    """`tables` (doc_id, section, ...) with `path`.

    The one table of a section without children takes the section's own number; other tables take, in order, the free
    numbers under their section. Free numbers are a sequence without the taken ones: as many candidates as tables
    and taken numbers together are enough.
    """
    taken = taken_numbers(headings)
    keyed = tables.withColumn("section", F.coalesce("section", F.array().cast("array<int>")))
    by_section = Window.partitionBy("doc_id", "section")
    counted = keyed.withColumns({"__k": F.row_number().over(by_section.orderBy(*order)), "__tables": F.count("*").over(by_section)})
    used = taken.groupBy("doc_id", F.col("parent").alias("section")).agg(F.count("*").alias("__taken"), F.collect_set("n").alias("__numbers"))
    met = counted.join(used, ["doc_id", "section"], "left").withColumns({"__taken": F.coalesce("__taken", F.lit(0)), "__numbers": F.coalesce("__numbers", F.array().cast("array<int>"))})
    free = F.filter(F.sequence(F.lit(1), (F.col("__k") + F.col("__taken")).cast("int")), lambda n: ~F.array_contains(F.col("__numbers"), n))
    alone = (F.col("__tables") == 1) & (F.size("section") > 0) & (F.col("__taken") == 0)
    path = F.when(alone, F.col("section")).otherwise(F.concat("section", F.array(F.element_at(free, F.col("__k")))))
    return met.withColumn("path", path).drop("__k", "__tables", "__taken", "__numbers")


def number_simple(lines: DataFrame, order: list[str]) -> DataFrame:
    """`lines` (doc_id, table_id, path, line) of tables without nested lines or counters: `{path}.{k} {line}`, by a window."""
    k = F.row_number().over(Window.partitionBy("doc_id", "table_id").orderBy(*order))
    deep = F.size("path") >= NUMBER_DEPTH
    bare = T.bare_text(F.col("line"))
    return lines.withColumn("line", F.when(deep, bare).otherwise(F.concat(path_label(F.concat("path", F.array(k))), F.lit(" "), bare)))


def dividers(lines: DataFrame, order: list[str]) -> DataFrame:
    """`lines` (doc_id, table_id, line) with `is_divider`: a row without a counter, where counting starts anew at 1 after it."""
    top = T.row_level(F.col("line")) == 0
    own = F.when(top, T.leading_counter(T.bare_text(F.col("line"))))
    after = Window.partitionBy("doc_id", "table_id").orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    return lines.withColumn("is_divider", top & own.isNull() & F.coalesce(F.first(own, ignorenulls=True).over(after) == 1, F.lit(False)))


# --- folds -------------------------------------------------------------------------------------------------------


def number_lines(lines: list[str], path: tuple[int, ...], rows: int = 0, context: str = "", title: str = "", headers: list[str] | None = None, continued: bool = False) -> tuple[list[str], int, str]:
    """One table's lines as a numbered branch, and the row count and context that a continuation goes on from."""
    body = [x for x in lines if x.strip()]
    if not body:
        return list(lines), rows, context
    name, headers = L.squeeze(title), [L.squeeze(h) for h in headers or ()]
    said_below = "\n".join(body)
    unsaid = [] if continued else [h for h in dict.fromkeys(headers) if h and h.rstrip(":").strip() not in said_below]
    if unsaid and not name:
        unsaid = [h for h in dict.fromkeys(headers) if h]
    caption = name or L.SEPARATOR.join(unsaid)
    out = []
    if caption:
        head = ".".join(map(str, path)) + f" {caption}" + (f" {CONTINUED}" if continued else "")
        out.append(head + (L.SEPARATOR + L.SEPARATOR.join(unsaid) if name and unsaid else ""))
    shift = int(bool(caption) or continued)

    levels = [(len(x) - len(x.lstrip(" "))) // len(L.INDENT) for x in body]
    bare = [L.bare(x) for x in body]
    counters = [L.counter(b) if level == 0 else None for b, level in zip(bare, levels, strict=True)]
    following, ahead = [None] * len(body), None
    for k in range(len(body) - 1, -1, -1):
        following[k] = ahead
        ahead = counters[k] if counters[k] is not None else ahead
    counts = any(map(L.counts_rows, headers))

    since, written = REPEAT_WORDS, False  # written: a row, a divider or a tail stands in this call's output
    for line, text, level, own, after in zip(body, bare, levels, counters, following, strict=True):
        uncounted = counts and level == 0 and own is None
        is_divider = uncounted and after == 1
        if uncounted and not is_divider and rows:
            level, written = 1, True
        if level and written:
            marker = L.unbulleted(line.lstrip(" "))[0]
            repeat = f"{context}{L.SEPARATOR}" if context and since >= REPEAT_WORDS else ""
            since = (0 if repeat else since) + len(L.tokens(text))
            out.append(L.INDENT * (1 + shift) + (f"{marker} " if marker else "") + repeat + text)
            continue
        if out:
            out.append("")
        if not is_divider:
            rows += 1
            if len(path) < NUMBER_DEPTH:
                rest = L.SEPARATOR.join(text.split(L.SEPARATOR)[1:]).lstrip()
                text = rest if own == rows and rest else text
                out.append(L.INDENT * shift + ".".join(map(str, (*path, rows))) + f" {text}")
            else:
                out.append(L.INDENT * shift + text)
        else:
            out.append(L.INDENT * shift + text)
        written = True
        context, since = record_name(text) or shortened(name), len(L.tokens(text))
    return out, rows, context


def record_name(row: str) -> str:
    """The words of a row that say which record it is."""
    for part in map(L.squeeze, row.split(L.SEPARATOR)):
        if part and not part.endswith(":"):
            value = part.partition(": ")[2].strip() or part
            if any(map(str.isalpha, value)):
                return shortened(value)
    return ""


def shortened(text: str, limit: int = T.CONTEXT_CHARS) -> str:
    line = L.squeeze(text)
    if len(line) <= limit:
        return line
    cut = line[:limit].rpartition(" ")[0] or line[:limit]
    return cut.rstrip(" ,;:/-–—") or cut


def number_documents(tables: DataFrame) -> DataFrame:
    """NUMBERED lines of `tables` (doc_id, table_id, seq, lines, path array<int>, title, headers, continued): one fold for each document.

    A continuation goes on with the rows and the name of the last table before it.
    """
    columns, schema = ["doc_id", "table_id", "lines", "path", "title", "headers", "continued"], arrow_schema(NUMBERED)

    def numbered(group: pa.Table, cuts: list[int]):
        begins = set(cuts)
        rows, context, path, own = 0, "", (), ""
        for at, (doc, table, lines, first, title, headers, continued) in enumerate(zip(*(group.column(c).to_pylist() for c in columns), strict=True)):
            if at in begins:
                rows, context, path, own = 0, "", (), ""
            if not continued:
                rows, context, path, own = 0, "", tuple(first), title or ""
            made, rows, context = number_lines(lines, path, rows, context, own, headers or [], bool(continued))
            yield from ((doc, table, k, x) for k, x in enumerate(made))

    return by_group(tables, ["doc_id"], ["seq"], lambda group, cuts: sent(numbered(group, cuts), schema), NUMBERED)


def accepted_headings(lines: DataFrame) -> DataFrame:
    """Headings of `lines` (doc_id, page, top, text, starts_paragraph): those that open a paragraph or go on from the last accepted one."""
    known = lambda dealt: headings_of(dealt).where("not is_contents").select("doc_id", "page", "top", "path", "starts_paragraph")
    schema = arrow_schema("doc_id string, page int, top double, path array<int>")

    def accepted(group: pa.Table, cuts: list[int]):
        begins, last = set(cuts), ()
        for at, (doc, page, top, path, starts) in enumerate(zip(*(c.to_pylist() for c in group.columns), strict=True)):
            if at in begins:
                last = ()
            path = tuple(path)
            child = path == (*last, 1)
            sibling = len(path) <= len(last) and path == (*last[: len(path) - 1], last[len(path) - 1] + 1)
            follows = child or sibling if last else len(path) == 1 or path[-1] == 1
            if starts or follows:
                yield doc, page, top, path
                last = path

    columns = lines.select("doc_id", "page", "top", "text", "starts_paragraph")
    return by_group(columns, ["doc_id"], ["page", "top"], lambda group, cuts: sent(accepted(group, cuts), schema), "doc_id string, page int, top double, path array<int>", known)


def list_numbers(paragraphs: DataFrame, levels: DataFrame) -> DataFrame:
    """`paragraphs` (doc_id, seq, num_id, ilvl) with `list_path`: the number that the word processor draws.

    `levels` (doc_id, num_id, abstract_id, ilvl, start, fmt, override) describes the lists. Counters are kept for each
    abstract list and level; deeper ones start over; an override counts once for a list; only lists that are decimal on
    every level down to the paragraph's have a path, though others count on.
    """
    ship_code(paragraphs.sparkSession)
    described = levels.groupBy("doc_id").agg(F.collect_list(F.struct("num_id", "abstract_id", "ilvl", "start", "fmt", "override")).alias("levels"))
    wanted = paragraphs.select("doc_id", "seq", "num_id", "ilvl").join(described, "doc_id", "left")

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        raw = group["levels"].iloc[0]
        spec = {(x["num_id"], x["ilvl"]): x for x in (raw if raw is not None else ())}
        count: dict[tuple[str, int], int] = {}
        overridden, out = set(), []
        for p in group.sort_values("seq").itertuples():
            path = None
            if isinstance(p.num_id, str) and p.num_id != "0" and any(n == p.num_id for n, _ in spec):
                level = 0 if pd.isna(p.ilvl) else int(p.ilvl)
                abstract = next(x["abstract_id"] for (n, _), x in spec.items() if n == p.num_id)
                at = lambda k, n=p.num_id: spec.get((n, k)) or {"start": None, "fmt": None, "override": None}
                start = lambda k, at=at: 1 if at(k)["start"] is None else int(at(k)["start"])
                if p.num_id not in overridden:
                    overridden.add(p.num_id)
                    for (n, k), x in spec.items():
                        if n == p.num_id and x["override"] is not None:
                            count[abstract, k] = int(x["override"]) - 1
                count[abstract, level] = count.get((abstract, level), start(level) - 1) + 1
                count = {(a, k): v for (a, k), v in count.items() if a != abstract or k <= level}
                if all((at(k)["fmt"] or "decimal") in ("decimal", "decimalZero") for k in range(level + 1)):
                    path = [count.get((abstract, k), start(k)) for k in range(level + 1)]
            out.append({"doc_id": p.doc_id, "seq": p.seq, "list_path": path})
        return pd.DataFrame(out)

    found = wanted.groupBy("doc_id").applyInPandas(fold, "doc_id string, seq int, list_path array<int>")
    return paragraphs.join(found, ["doc_id", "seq"])


def entered_levels(headings: DataFrame) -> DataFrame:
    """`headings` (doc_id, seq, rank from 0, path or null) with `path`: a stated one, else the next free number at its rank."""
    ship_code(headings.sparkSession)

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        taken: dict[tuple, set[int]] = {}
        entered: dict[tuple, int] = {}
        section: tuple[int, ...] = ()
        out = []
        stated = [tuple(p) for p in group["path"] if p is not None]
        for path in stated:
            for k, n in enumerate(path):
                taken.setdefault(path[:k], set()).add(n)
        for h in group.sort_values("seq").itertuples():
            if h.path is not None:
                section = tuple(h.path)
            else:
                parent = (section + (1,) * int(h.rank))[: int(h.rank)]
                n = entered.get(parent, 0) + 1
                while n in taken.get(parent, ()):
                    n += 1
                section = (*parent, n)
                for k, x in enumerate(section):
                    taken.setdefault(section[:k], set()).add(x)
            entered[section[:-1]] = section[-1]
            out.append({"doc_id": h.doc_id, "seq": h.seq, "path": list(section)})
        return pd.DataFrame(out)

    return headings.groupBy("doc_id").applyInPandas(fold, "doc_id string, seq int, path array<int>")
