"""Writing document files: the archive format of ``udf_file`` from paragraphs, and digests of contents."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The same bytes for the same text, whenever they are written.
_EPOCH = (1980, 1, 1, 0, 0, 0)


def archive(paragraphs: list[str]) -> bytes:
    """One file: the paragraphs' text in a pool, each addressed by UTF-16 offset and length."""
    pool, elements, at = [], [], 0
    for paragraph in paragraphs:
        text = paragraph + "\n"
        length = len(text.encode("utf-16-le")) // 2
        pool.append(text)
        elements.append(f"<paragraph><content startOffset={quoteattr(str(at))} length={quoteattr(str(length))} /></paragraph>")
        at += length
    xml = f'<?xml version="1.0" encoding="UTF-8"?><template format_id="1.8"><content>{escape("".join(pool))}</content><elements>{"".join(elements)}</elements></template>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as file:
        entry = zipfile.ZipInfo("content.xml", _EPOCH)
        entry.compress_type = zipfile.ZIP_DEFLATED
        file.writestr(entry, xml)
    return out.getvalue()


def archives(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, content): a file for each document of paragraphs (doc_id, para_no, text)."""
    id_type = paragraphs.schema["doc_id"].dataType.simpleString()

    def built(document: pd.DataFrame) -> pd.DataFrame:
        rows = document.sort_values("para_no")
        return pd.DataFrame({"doc_id": rows["doc_id"].iloc[:1], "content": [archive(rows["text"].tolist())]})

    return paragraphs.select("doc_id", "para_no", "text").groupBy("doc_id").applyInPandas(built, f"doc_id {id_type}, content binary")


def stamp(content: Column) -> Column:
    """What tells whether a file changed."""
    return F.sha2(content, 256)
