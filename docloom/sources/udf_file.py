"""Word-processor files that are a zip (or bare XML) with one ``content.xml``: text pool, elements, styles, data.

Files come through Spark's ``binaryFile`` source, so any file system will do and large folders spread
over the cluster; each task opens one small archive at a time. Entity definitions are refused, and
archives are read within limits. A file that can't be read gives one row with its error.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

MOST_BYTES = 300 * 1024 * 1024
MOST_ENTRIES = 10_000

RUNS = "path string, block int, kind string, list_id string, level int, run_no int, start int, length int, text string, style string, error string"
STYLES = "path string, name string, parent string, attrs map<string,string>, error string"
DATA = "path string, node_id int, parent_id int, pos int, name string, row_name string, is_row boolean, value string, error string"
ENTRIES = "path string, name string, size long, compressed long, head string, error string"


class Unreadable(ValueError):
    """With the code of what is wrong with a file."""


def content_xml(content: bytes) -> bytes:
    """The content of a file, from its archive or bare."""
    if content[:2] != b"PK":
        return content
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            entries = archive.infolist()
            names = [e.filename for e in entries if e.filename == "content.xml"]
            if len(entries) > MOST_ENTRIES:
                raise Unreadable("too_many_entries")
            if len(names) != 1:
                raise Unreadable("no_content" if not names else "ambiguous_content")
            if archive.getinfo("content.xml").flag_bits & 1:
                raise Unreadable("encrypted")
            with archive.open("content.xml") as file:
                xml = file.read(MOST_BYTES + 1)
    except (zipfile.BadZipFile, RuntimeError, NotImplementedError, EOFError) as error:
        raise Unreadable("bad_archive") from error
    if len(xml) > MOST_BYTES:
        raise Unreadable("too_large")
    return xml


def parsed(content: bytes) -> ElementTree.Element:
    xml = content_xml(content)
    head = xml.decode("utf-16" if xml[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-8", "replace")
    if "<!DOCTYPE" in head.upper() or "<!ENTITY" in head.upper():
        raise Unreadable("doctype")
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError as error:
        raise Unreadable("bad_xml") from error
    if root.tag.lower() != "template":
        raise Unreadable("not_a_template")
    return root


def _child(root: ElementTree.Element, name: str) -> ElementTree.Element | None:
    return next((c for c in root if c.tag.lower() == name), None)


def _number(text: str | None) -> int | None:
    try:
        return int(text) if text is not None else None
    except ValueError:
        return None


def _runs(path: str, root: ElementTree.Element) -> Iterator[dict]:
    """Offsets count UTF-16 units; each run's text is cut from the pool by them."""
    pool = ((_child(root, "content").text if _child(root, "content") is not None else "") or "").encode("utf-16-le")
    elements = _child(root, "elements")
    paragraphs = [e for e in elements.iter() if e.tag.lower() == "paragraph"] if elements is not None else []
    for block, paragraph in enumerate(paragraphs):
        for run_no, leaf in enumerate(e for e in paragraph if e.get("startOffset") is not None):
            start, length = _number(leaf.get("startOffset")) or 0, _number(leaf.get("length")) or 0
            text = pool[2 * start : 2 * (start + length)].decode("utf-16-le", "replace")
            yield {
                "path": path,
                "block": block,
                "kind": leaf.tag.lower(),
                "list_id": paragraph.get("ListId"),
                "level": _number(paragraph.get("ListLevel")),
                "run_no": run_no,
                "start": start,
                "length": length,
                "text": text,
                "style": leaf.get("resolver") or leaf.get("style") or paragraph.get("resolver"),
            }


def _styles(path: str, root: ElementTree.Element) -> Iterator[dict]:
    styles = _child(root, "styles")
    for style in styles if styles is not None else ():
        attrs = {k: v for k, v in style.attrib.items() if k not in ("name", "resolver", "parent")}
        yield {"path": path, "name": style.get("name"), "parent": style.get("resolver") or style.get("parent"), "attrs": attrs}


def _data(path: str, root: ElementTree.Element) -> Iterator[dict]:
    top = _child(root, "data")
    todo = [(top, None)] if top is not None else []
    pos = 0
    while todo:
        node, parent = todo.pop()
        row_name = node.get("rowName")
        is_row = (node.get("rowType") or "").lower() == "datarow" and bool(row_name)
        leaf = "".join(node.itertext()) if len(node) == 0 else None
        yield {"path": path, "node_id": pos, "parent_id": parent, "pos": pos, "name": node.tag, "row_name": row_name, "is_row": is_row, "value": leaf}
        todo += [(child, pos) for child in reversed(node)]
        pos += 1


def _entries(path: str, content: bytes) -> Iterator[dict]:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            for entry in archive.infolist()[: MOST_ENTRIES + 1]:
                with archive.open(entry) as file:
                    head = file.read(262_144).decode("utf-8", "replace")
                yield {"path": path, "name": entry.filename, "size": entry.file_size, "compressed": entry.compress_size, "head": head}
    except (zipfile.BadZipFile, RuntimeError, NotImplementedError, EOFError) as error:
        raise Unreadable("bad_archive") from error


def _relation(files: DataFrame, schema: str, rows: Callable[[str, bytes], Iterator[dict]]) -> DataFrame:
    names = [f.split()[0] for f in schema.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in batch.itertuples(index=False):
                try:
                    found = list(rows(path, bytes(content)))
                except Unreadable as error:
                    found = [{"path": path, "error": str(error)}]
                yield pd.DataFrame([[row.get(n) for n in names] for row in found], columns=names, dtype=object)

    return files.select("path", "content").mapInPandas(read, schema)


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """The files of a folder with their contents; unchanged files are known by path, time and size."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def runs(found: DataFrame) -> DataFrame:
    return _relation(found, RUNS, lambda path, content: _runs(path, parsed(content)))


def styles(found: DataFrame) -> DataFrame:
    return _relation(found, STYLES, lambda path, content: _styles(path, parsed(content)))


def data(found: DataFrame) -> DataFrame:
    return _relation(found, DATA, lambda path, content: _data(path, parsed(content)))


def entries(found: DataFrame) -> DataFrame:
    """The entries of archives, with the first characters of each."""
    return _relation(found, ENTRIES, _entries)


def summary(found: DataFrame) -> DataFrame:
    """(path, signed, format_id, paper, orientation, left, right, top, bottom) of archives by the first characters of their content, without reading the rest."""
    from pyspark.sql import functions as F

    parts = entries(found).where("error IS NULL").groupBy("path").agg(
        F.max(F.when(F.col("name") == "content.xml", F.col("head"))).alias("head"),
        F.bool_or((F.col("name") == "sign.sgn") | F.lower("name").endswith(".p7s")).alias("signed"),
    )
    page = F.regexp_extract("head", r"(?i)<pageFormat\b([^>]*)>", 1)
    value = lambda text, name: F.nullif(F.regexp_extract(text, rf'\b{name}\s*=\s*"([^"]*)"', 1), F.lit(""))
    sides = [F.round(value(page, f"{side}Margin").try_cast("double"), 2).alias(side) for side in ("left", "right", "top", "bottom")]
    return parts.select("path", "signed", value(F.col("head"), "format_id").alias("format_id"), F.coalesce(value(page, "mediaSizeName"), F.lit("1")).alias("paper"), value(page, "paperOrientation").alias("orientation"), *sides)


def decoded(content: bytes) -> str:
    """Text by its byte-order mark, else by the encoding that it declares, else UTF-8, else the Turkish code page."""
    for mark, encoding in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if content.startswith(mark):
            return content[len(mark) :].decode(encoding, "replace")
    declared = re.match(rb"""\s*<\?xml[^>]*?encoding\s*=\s*["']([A-Za-z0-9._-]{1,40})["']""", content[:256])
    for encoding in filter(None, (declared and declared[1].decode(), "utf-8", "cp1254")):
        try:
            return content.decode(encoding)
        except (LookupError, UnicodeDecodeError):
            continue
    return content.decode("cp1254", "replace")


def texts(found: DataFrame) -> DataFrame:
    """(path, text): files of bare text, decoded."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "text": [decoded(bytes(c)) for c in batch["content"]]})

    return found.select("path", "content").mapInPandas(read, "path string, text string")
