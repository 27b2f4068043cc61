"""Kinds of files whose first bytes end within a character or aren't text at all."""

from docloom.operators import convert
from docloom.plans import catalog


def kinds(spark, contents):
    rows = spark.createDataFrame(list(enumerate(contents)), "i int, content binary")
    return [tuple(r.k) for r in rows.select("i", convert.file_kind(rows.content).alias("k")).orderBy("i").collect()]


def test_cut_characters_and_wrong_bytes_are_no_errors(spark):
    udf, rtf, none = ("udf", "xml"), ("word", "rtf"), ("bilinmeyen", None)
    body = " <a><template>" + "x" * 8170 + "üüüü€€€€😀😀😀😀"
    found = kinds(spark, [b"\xef\xbb\xbf" + (" " * n + body).encode() for n in range(5)])
    assert found == [udf] * 5
    found = kinds(spark, [b"\xef\xbb\xbf\xff\xfe<\xff<template>", b"\xef\xbb\xbf {\\rtf\xff", b"\xef\xbb\xbf", b"\xef\xbb\xbf<\xc3<template"])
    assert found == [none, rtf, none, udf]
    wide = " <a>😀<template>" + "x" * 4080 + "😀" * 8
    assert kinds(spark, [mark + (" " * n + wide).encode(code) for mark, code in ((b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")) for n in range(3)]) == [udf] * 6
    assert kinds(spark, [b"\xff\xfe" + "\t{\\rtf1".encode("utf-16-le") + b"x", b"\xfe\xff\xd8\x00\xd8", b"\xff\xfe", b"\xfe\xff\x00"]) == [rtf, none, none, none]
    assert kinds(spark, [b"\xff\xfe" + "㰀".encode("utf-16-le") + "<template".encode("utf-16-le")]) == [none]


def test_query_over_long_pages(spark, tmp_path):
    pages = [(i, "u", "a" * (i // 5) + "ü" * 9000) for i in range(20)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    found = {r.page_id: (r.kind, r.sub) for r in catalog.QUERIES["sniff_kind"](spark, str(tmp_path)).collect()}
    of = [("pdf", None), ("gorsel", "png"), ("udf", "xml"), ("word", "rtf"), ("bilinmeyen", None)]
    assert found == {i: of[i % 5] for i in range(20)}
