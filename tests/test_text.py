"""Paragraphs, ranges and search against plain Python."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.functions import paragraphs, ranges
from docloom.functions import text as T
from docloom.operators import search, styles


def cleaned(spark, raw, **settings):
    return spark.createDataFrame([(raw,)], "t string").select(paragraphs.clean_paragraphs(F.col("t"), **settings)).first()[0]


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("Bu bir uzun cümledir ve devam\neder.", "Bu bir uzun cümledir ve devam eder."),
        ("insan-\nlara ve daha nice uzun satırlara", "insanlara ve daha nice uzun satırlara"),
        ("1/2/2018-\n7078/157 sayılı karar çok uzundur", "1/2/2018-7078/157 sayılı karar çok uzundur"),
        ("Birinci paragraf budur ve uzundur\n\nİkinci", "Birinci paragraf budur ve uzundur\nİkinci"),
        ("Birinci paragraf\n\n\nİkinci", "Birinci paragraf\n\nİkinci"),
        ("Kısa.\nBu satır ise çok daha uzun bir satırdır", "Kısa.\nBu satır ise çok daha uzun bir satırdır"),
        ("uzun bir satır burada durur\n  girintili satır", "uzun bir satır burada durur\ngirintili satır"),
        ("sözcük ,  nokta .", "sözcük, nokta."),
        ("", ""),
    ],
)
def test_clean_paragraphs(spark, raw, clean):
    assert cleaned(spark, raw) == clean


def test_first_line_that_is_full_is_not_short(spark):
    raw = "kurulur.\nBu satır ise çok daha uzun bir satırdır"
    assert cleaned(spark, raw, first_is_full=True) == raw.replace("\n", " ")


def test_preparation_joins_soft_hyphens_and_repairs(spark):
    rows = spark.createDataFrame([("in­\n  san ﬁkir\tx",), (None,)], "t string")
    got = [r[0] for r in rows.select(paragraphs.clean_paragraphs(F.col("t"))).collect()]
    assert got == ["insan fikir x", None]


def plain_print(text, total):
    clean = re.sub("[–—]", "-", re.sub(r"\s+", "", text).replace(";", ","))
    if not clean:
        return None, "empty"
    pages = set()
    for part in filter(None, clean.split(",")):
        match = re.fullmatch(r"(\d*)-(\d*)", part)
        if match and (match[1] or match[2]):
            low, high = int(match[1] or 1), int(match[2] or total)
        elif re.fullmatch(r"\d+", part):
            low = high = int(part)
        else:
            return None, "bad_part"
        if min(low, high) < 1:
            return None, "below_one"
        if max(low, high) > total:
            return None, "above_total"
        pages |= set(range(min(low, high), max(low, high) + 1))
    return (sorted(pages), None) if pages else (None, "none_chosen")


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="0123 -,;–a", max_size=9), min_size=40, max_size=40))
def test_print_ranges_agree_with_plain_rules(spark, texts):
    rows = spark.createDataFrame([(t, 12) for t in texts], "t string, n int")
    for row in rows.select("t", ranges.print_ranges(F.col("t"), F.col("n")).alias("x")).collect():
        assert (row.x.pages, row.x.error) == plain_print(row.t, 12), row.t


def test_search_pattern_and_positions(spark):
    rows = spark.createDataFrame([("Örnek : bir\niki BİR İKİ xbir ikiy",)], "t string")

    def found(query, whole=False):
        hits = search.search(rows, query, whole_word=whole, text="t").select("start", "end").collect()
        return [(h.start, h.end) for h in hits]

    assert found("örnek:") == [(0, 7)]
    assert found("bir iki") == [(8, 15), (16, 23), (25, 32)]
    assert found("bir iki", whole=True) == [(8, 15), (16, 23)]
    assert found("  ") == []


def test_turkish_lower_case_keeps_length(spark):
    text = "IİıiĞŞÇ😀A"
    row = spark.createDataFrame([(text,)], "t string").select(T.tr_lower(F.col("t"))).first()[0]
    assert row == "ıiıiğşç😀a" and len(row) == len(text)


def test_tags_go_and_blocks_end_lines(spark):
    rows = spark.createDataFrame([("<scr<b>ipt>x<p>y</p> z<br/>w",)], "t string")
    assert rows.select(T.strip_html(F.col("t"))).first()[0] == "ipt>xy\nz\nw"


@pytest.mark.parametrize(
    ("old", "styled", "new", "expected"),
    [
        ("abcd", "1122", "abXcd", "11122"),
        ("abcd", "1122", "ad", "12"),
        ("abcd", "1122", "", ""),
        ("", "", "xy", "--"),
        ("abc", "123", "xabcy", "11233"),
    ],
)
def test_styles_after_an_edit(spark, old, styled, new, expected):
    texts = spark.createDataFrame([("d", old, list(styled), new)], "doc_id string, old string, styles array<string>, new string")
    got = styles.reconciled(texts).first().styles
    assert "".join(s or "-" for s in got) == expected


def test_boxes_merge_to_a_fixed_point():
    import numpy as np

    from docloom.operators.layout import TOUCH, grown_together

    def plainly(boxes):
        boxes = [tuple(b) for b in boxes]
        while True:
            pair = next(((a, b) for a in boxes for b in boxes if a is not b and a[0] <= b[2] + TOUCH and b[0] <= a[2] + TOUCH and a[1] <= b[3] + TOUCH and b[1] <= a[3] + TOUCH), None)
            if pair is None:
                return sorted(boxes)
            a, b = pair
            boxes = [x for x in boxes if x is not a and x is not b] + [(min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))]

    rng = np.random.default_rng(5)
    for n, spread in ((0, 1), (1, 1), (2, 5), (40, 300), (80, 900), (200, 2500)):
        corner, size = rng.integers(0, spread, (n, 2)), rng.integers(1, 60, (n, 2))
        boxes = np.hstack([corner, corner + size]).astype(float).reshape(-1, 4)
        assert sorted(map(tuple, grown_together(boxes))) == plainly(boxes)


def test_connected_groups_agree_with_brute_force(spark):
    import numpy as np

    from docloom.operators.layout import connected_groups

    rng = np.random.default_rng(9)
    rows, boxes = [], {}
    for page in range(3):
        corner = rng.integers(0, 400, (60, 2)).astype(float)
        boxes[page] = np.hstack([corner, corner + rng.integers(1, 40, (60, 2))])
        rows += [("d", page, i, *map(float, b)) for i, b in enumerate(boxes[page])]
    frame = spark.createDataFrame(rows, "doc_id string, page_no int, box_no int, x0 double, y0 double, x1 double, y1 double")
    got = {}
    for r in connected_groups(frame, 3.0, 1.0).collect():
        got.setdefault((r.page_no, r.group_no), set()).add(r.box_no)
    expected = set()
    for page, b in boxes.items():
        label = list(range(len(b)))
        meets = lambda p, q: p[0] - 3 <= q[2] + 3 and q[0] - 3 <= p[2] + 3 and p[1] - 1 <= q[3] + 1 and q[1] - 1 <= p[3] + 1
        changed = True
        while changed:
            changed = False
            for i in range(len(b)):
                for j in range(len(b)):
                    if meets(b[i], b[j]) and label[j] < label[i]:
                        label[i], changed = label[j], True
        for i in range(len(b)):
            expected.add((page, frozenset(j for j in range(len(b)) if label[j] == label[i])))
    assert {(page, frozenset(v)) for (page, _), v in got.items()} == expected


def test_missing_note_is_an_error(spark):
    from pyspark.errors import PySparkException

    from docloom.operators import annots

    notes = spark.createDataFrame([("d", 1, "x")], "doc_id string, id int, payload string")
    assert annots.one(notes, notes.select("doc_id", "id")).first().payload == "x"
    with pytest.raises(PySparkException):
        annots.one(notes, spark.createDataFrame([("d", 2)], "doc_id string, id int")).collect()


def test_headers_footers_and_numbers(spark):
    from docloom.operators import layout

    rows = [("d", p, n, 600.0, 800.0, 280.0, 320.0, y, t) for p in range(1, 6) for n, (y, t) in enumerate([(40.0, "A title"), (400.0, f"body {p}"), (760.0, f"- {p} -"), (770.0, "Draft 7")]) if p > 1 or n]
    rows += [("t", p, n, 600.0, 800.0, 10.0, 90.0, 20.0 + 10 * n, f"row {n}x") for p in range(1, 4) for n in range(9)]
    lines = spark.createDataFrame(rows, "doc_id string, page_no int, line_no int, page_width double, page_height double, x0 double, x1 double, y double, text string")
    kinds = layout.header_footer_lines(lines)
    got = {(r.doc_id, r.page_no, r.line_no): r.kind for r in kinds.collect()}
    assert got == {("d", p, 0): "header" for p in range(2, 6)} | {("d", p, 2): "number" for p in range(1, 6)} | {("d", p, 3): "footer" for p in range(1, 6)}
    starts = {(r.kind, r.page_no, r.late) for r in layout.header_starts(kinds, lines.select("doc_id", "page_no").distinct()).collect()}
    assert starts == {("header", 2, True), ("footer", 1, False)}


def test_encrypted_documents(spark):
    import struct

    from docloom.operators import convert

    def file(flags=0x0100, shift=9, first=3, size=5000, mark=b"\xec\xa5"):
        content = bytearray(8192)
        content[0x1E:0x20] = struct.pack("<H", shift)
        name = "WordDocument".encode("utf-16-le")
        content[1024 : 1024 + len(name)] = name
        content[1024 + 116 : 1024 + 128] = struct.pack("<IQ", first, size)
        at = (first + 1) << shift
        if at + 12 <= len(content):
            content[at : at + 12] = mark + bytes(8) + struct.pack("<H", flags)
        return bytes(content)

    files = [file(), file(flags=0x0200), file(shift=4), file(size=100), file(mark=b"xx"), file(first=100), b"", b"WordDocument", file(first=0xFFFFFFFE), None]
    rows = spark.createDataFrame([(i, f) for i, f in enumerate(files)], "i int, content binary")
    got = dict(rows.select("i", convert.encrypted_doc(F.col("content"))).collect())
    assert got == {i: i == 0 for i in range(len(files))}


def test_boxes_become_strips(spark):
    from docloom.operators import layout

    rows = [("d", 1, 0, 10.0, 10.0, 50.0, 20.0, 0.0), ("d", 1, 1, 60.0, 11.0, 90.0, 22.0, 1.0), ("d", 1, 2, 10.0, 30.0, 50.0, 40.0, 359.0), ("d", 1, 3, 12.0, 12.0, 16.0, 18.0, 90.0), ("d", 2, 0, 1.0, 1.0, 2.0, 9.0, 90.0), ("d", 2, 1, 0.0, 10.0, 1.8, 30.0, 270.0), ("d", 2, 2, None, 1.0, 2.0, 3.0, 0.0)]
    boxes = spark.createDataFrame(rows, "doc_id string, page_no int, pos int, x0 double, y0 double, x1 double, y1 double, angle double")
    got = {tuple(r) for r in layout.line_strips(boxes).collect()}
    assert got == {("d", 1, 0, False, 10.0, 10.0, 90.0, 22.0), ("d", 1, 1, False, 10.0, 30.0, 50.0, 40.0), ("d", 1, 2, True, 12.0, 12.0, 16.0, 18.0), ("d", 2, 0, True, 0.0, 1.0, 2.0, 30.0)}


def test_normal_form_of_every_character_and_of_many_long_texts(spark):
    import unicodedata

    texts = [None, "", "plain", "“é”…", "é", "Ạ̊x", " ", "각", "한글", "e" + "́" * 3, "ﬁ Å"] + ["".join(map(chr, range(c, c + 64))) for c in range(0x20, 0xD7C0, 64)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.normal_form(F.col("t")).alias("n")).collect()
    assert {r.i: r.n for r in rows} == {i: None if t is None else unicodedata.normalize("NFC", t) for i, t in enumerate(texts)}


def test_texts_without_combining_signs_stay_out_of_python(spark):
    rows = spark.range(100).select(F.repeat(F.lit("plain, é – “x” "), 1000).alias("t"))
    plan = rows.select(T.normal_form(F.col("t")).alias("n"))
    assert plan.where("n = repeat('plain, é – “x” ', 1000)").count() == 100
    sent = rows.where(F.col("t").rlike(T.NORMAL))
    assert sent.count() == 0
