"""Document archives: reading, refusing, and streams."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from docloom.sources import sinks, udf_file
from docloom.streaming import hits


def zipped(**entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, text in entries.items():
            archive.writestr(name.replace("__", "."), text)
    return out.getvalue()


@pytest.mark.parametrize(
    ("content", "error"),
    [
        (b"", "bad_xml"),
        (b"PK\x03\x04rubbish", "bad_archive"),
        (zipped(other__xml="x"), "no_content"),
        (zipped(content__xml='<!DOCTYPE x [<!ENTITY a "b">]><template>&a;</template>'), "doctype"),
        (zipped(content__xml="<template>"), "bad_xml"),
        (zipped(content__xml="<other/>"), "not_a_template"),
    ],
)
def test_bad_files_are_refused(content, error):
    with pytest.raises(udf_file.Unreadable, match=error):
        udf_file.parsed(content)


def test_relations_of_files(spark, tmp_path):
    xml = (
        '<template><content>Merhaba 😀 dünya</content><elements><paragraph ListId="7" ListLevel="2"><content startOffset="0" length="11" resolver="Head"/>'
        '<field startOffset="11" length="5"/></paragraph></elements><styles><style name="Head" resolver="base" size="12"/></styles>'
        '<data><a>1</a><r rowType="dataRow" rowName="p"><b>2</b></r></data></template>'
    )
    (tmp_path / "a.udf").write_bytes(zipped(content__xml=xml))
    (tmp_path / "b.udf").write_bytes(b"<template/>")
    (tmp_path / "c.udf").write_bytes(b"not one")
    files = udf_file.files(spark, str(tmp_path)).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("path"), "content")
    runs = {(r.path, r.run_no): (r.text, r.style, r.list_id, r.level, r.error) for r in udf_file.runs(files).collect()}
    assert runs == {("a.udf", 0): ("Merhaba 😀 ", "Head", "7", 2, None), ("a.udf", 1): ("dünya", None, "7", 2, None), ("c.udf", None): (None, None, None, None, "bad_xml")}
    style = udf_file.styles(files).where("error IS NULL").first()
    assert (style["name"], style.parent, style.attrs) == ("Head", "base", {"size": "12"})
    data = [(r.node_id, r.parent_id, r["name"], r.is_row, r.value) for r in udf_file.data(files).where("error IS NULL").orderBy("pos").collect()]
    assert data == [(0, None, "data", False, None), (1, 0, "a", False, "1"), (2, 0, "r", True, None), (3, 2, "b", False, "2")]


def test_written_archives_are_the_same_each_time():
    assert sinks.archive(["a", "b😀"]) == sinks.archive(["a", "b😀"])


def test_stream_gives_each_place_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a b a b"), (2, "none")], "doc_id int, text string")
    rows.write.mode("append").parquet(str(tmp_path / "in"))
    rows.write.mode("append").parquet(str(tmp_path / "in"))
    stream = hits.pages(spark, str(tmp_path / "in"), rows.schema, files_per_batch=1)
    got = sorted(tuple(r) for r in hits.delivered(hits.hits(stream, "a b")).collect())
    assert got == [(1, 0, 3), (1, 4, 7)]


def test_summary_and_text_encodings(spark, tmp_path):
    from docloom.operators import convert

    xml = '<template format_id="1.8"><content/><properties><pageFormat mediaSizeName="2" paperOrientation="0" leftMargin="42.5199"/></properties></template>'
    (tmp_path / "a.udf").write_bytes(zipped(content__xml=xml, sign__sgn="x"))
    row = udf_file.summary(udf_file.files(spark, str(tmp_path))).first()
    assert (row.signed, row.format_id, row.paper, row.orientation, row.left, row.right) == (True, "1.8", "2", "0", 42.52, None)
    assert udf_file.decoded("ğ".encode("cp1254")) == "ğ" and udf_file.decoded("﻿ğ".encode("utf-16-le")) == "ğ" and udf_file.decoded("ğ".encode()) == "ğ"
    assert udf_file.decoded('<?xml version="1.0" encoding="iso-8859-9"?>ğ'.encode("iso-8859-9")).endswith("ğ")
    old = spark.createDataFrame([(b"x" * 600 + name.encode("utf-16-le"),) for name in ("WordDocument", "EncryptedPackage", "none")], "c binary")
    assert [r[0] and r[0].sub for r in old.select(convert.ole2_kind(F.col("c"))).collect()] == ["doc", "sifreli", None]
