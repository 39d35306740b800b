"""Flattened lines written out: text by document, or word files."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridscribe.groups import spread
from gridscribe.session import ship_code
from gridscribe.sources.office import W

_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_TYPES = '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
_RELS = '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'


def write_text(lines: DataFrame, path: str) -> None:
    """`lines` (doc_id, line and what orders them) as text, a folder for each document."""
    lines.select("doc_id", "line").write.partitionBy("doc_id").mode("overwrite").text(path)


def word_file(lines: list[str], headings: dict[int, str] | None = None) -> bytes:
    """A word file with a paragraph for each line, indented by its level; a blank line is written once."""
    body, last_blank = [], True
    for k, line in enumerate(lines):
        if headings and k in headings:
            body.append(f'<w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t xml:space="preserve">{escape(headings[k])}</w:t></w:r></w:p>')
        bare = line.lstrip(" ")
        if not bare and last_blank:
            continue
        last_blank = not bare
        indent = 360 * ((len(line) - len(bare)) // 2)  # 18 points a level
        run = f'<w:r><w:t xml:space="preserve">{escape(bare)}</w:t></w:r>' if bare else ""
        body.append(f'<w:p><w:pPr><w:ind w:left="{indent}"/></w:pPr>{run}</w:p>')
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in (("[Content_Types].xml", _TYPES), ("_rels/.rels", _RELS), ("word/document.xml", f'<?xml version="1.0"?><w:document {_NS}><w:body>{"".join(body) or "<w:p/>"}</w:body></w:document>')):
            z.writestr(zipfile.ZipInfo(name), text)  # no time of day: equal lines, equal bytes
    return out.getvalue()


def _paragraphs(lines: list[str]) -> list[ET.Element]:
    body = ET.fromstring(zipfile.ZipFile(io.BytesIO(word_file(lines))).read("word/document.xml"))[0]
    return list(body)


def without_tables(content: bytes, lines: dict[str, list[str]]) -> bytes:
    """A word file whose outermost tables are replaced by their lines; all other parts are copied as they are.

    `lines` goes by table_id, as the reader names tables. A story that would be left without a paragraph keeps an empty one.
    """
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as made:
        for name in z.namelist():
            data = z.read(name)
            story = re.fullmatch(r"word/(document|header\d*|footer\d*|footnotes|endnotes)\.xml", name)
            if story and b"tbl>" in data:
                for _, (prefix, uri) in ET.iterparse(io.BytesIO(data), events=["start-ns"]):
                    if not re.fullmatch(r"ns\d+", prefix):
                        ET.register_namespace(prefix, uri)
                root = ET.fromstring(data)
                number = {id(t): k for k, t in enumerate(root.iter(f"{W}tbl"))}
                for parent in list(root.iter()):
                    for tbl in [c for c in parent if c.tag == f"{W}tbl" and f"{story[1]}/{number[id(c)]:04d}" in lines]:
                        at = list(parent).index(tbl)
                        parent.remove(tbl)
                        for k, p in enumerate(_paragraphs(lines[f"{story[1]}/{number[id(tbl)]:04d}"])):
                            parent.insert(at + k, p)
                        if not parent.findall(f"{W}p"):
                            ET.SubElement(parent, f"{W}p")
                data = ET.tostring(root, encoding="utf-8", xml_declaration=True)
            made.writestr(zipfile.ZipInfo(name), data)
    return out.getvalue()


def flattened_word_files(files: DataFrame, numbered: DataFrame) -> DataFrame:
    """doc_id, content of word files with NUMBERED lines in place of their tables."""
    ship_code(files.sparkSession)
    line = F.struct("seq", "line")
    each = numbered.groupBy("doc_id", "table_id").agg(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]).alias("lines"))
    tables = each.groupBy("doc_id").agg(F.collect_list(F.struct("table_id", "lines")).alias("tables"))

    def rewrite(batches):
        for b in batches:
            made = [without_tables(bytes(c), {t["table_id"]: list(t["lines"]) for t in (ts if ts is not None else ())}) for c, ts in zip(b["content"], b["tables"], strict=True)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "content": made})

    return files.select("doc_id", "content").join(tables, "doc_id", "left").mapInPandas(rewrite, "doc_id string, content binary")


def packed_files(documents: DataFrame) -> DataFrame:
    """doc_id, content of `documents` (doc_id, parts map<string, string>): each part a file of a zipped package, in the order of their names."""
    ship_code(documents.sparkSession)

    def pack(parts) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, text in sorted(dict(parts).items()):
                z.writestr(zipfile.ZipInfo(name), text)
        return out.getvalue()

    def make(batches):
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "content": [pack(x) for x in b["parts"]]})

    return spread(documents.select(F.col("doc_id").cast("string").alias("doc_id"), "parts"), "doc_id").mapInPandas(make, "doc_id string, content binary")


def word_files(documents: DataFrame) -> DataFrame:
    """doc_id, content of `documents` (doc_id, lines array<string>)."""
    ship_code(documents.sparkSession)

    def make(batches):
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "content": [word_file(list(x)) for x in b["lines"]]})

    return spread(documents.select(F.col("doc_id").cast("string"), "lines"), "doc_id").mapInPandas(make, "doc_id string, content binary")
