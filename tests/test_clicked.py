"""The paragraph of each line against a plain walk up and down from it."""

import random
import re

import pyarrow as pa
import pytest

from docloom.operators import clicked
from docloom.plans import flow_queries
from docloom.session import table, written


def walk(lines, seed):
    """Lines are (top, bottom, start, end)."""
    h = lines[seed][1] - lines[seed][0]
    ends = [x[3] for x in lines]
    crowd = {e: sum(e <= other <= e + h / 4 for other in ends) for e in ends}
    most = max(crowd.values())
    low = max(e for e in ends if crowd[e] == most)
    if most >= max(3, 0.4 * len(lines)):
        limit = max(e for e in ends if e <= low + h / 4) - h
    else:
        limit = max(ends) - (max(ends) - min(x[2] for x in lines)) / 3

    def near(i, j):
        if i < 0 or j >= len(lines):
            return False
        a, b = lines[i][1] - lines[i][0], lines[j][1] - lines[j][0]
        return lines[j][0] - lines[i][1] < 0.8 * h and abs(a - b) <= 0.12 * max(a, b) and lines[i][3] >= limit

    def aligned(i, j):
        return abs(lines[i][2] - lines[j][2]) <= 0.3 * h

    def together(i):
        if not near(i, i + 1):
            return False
        block = near(i - 1, i) and aligned(i - 1, i)
        shift = lines[i + 1][2] - lines[i][2]
        if shift > h:
            short = lines[i + 1][3] < limit
            hangs = (near(i + 1, i + 2) and aligned(i + 1, i + 2)) or (short and aligned(i, i + 2)) if i + 2 < len(lines) else short
            if block or not hangs:
                return False
        return not (-shift > h and block)

    pitch = lambda i: lines[i + 1][0] - lines[i][0]
    own = [p for p in (seed, seed - 1) if p >= 0 and together(p)][:1]
    if not own:
        return seed, seed
    fits = lambda i: together(i) and abs(pitch(i) - pitch(own[0])) <= max(2, 0.15 * pitch(own[0]))
    first = last = seed
    while last + 1 < len(lines) and fits(last):
        last += 1
    while first > 0 and fits(first - 1):
        first -= 1
    return first, last


def test_paragraphs_agree_with_a_walk_from_each_line(spark, sf_dir):
    lines = flow_queries.set_lines_of(table(spark, sf_dir, "lineitem")).cache()
    pages, got = {}, {}
    for r in sorted(lines.collect(), key=lambda r: r["at"]):
        pages.setdefault((r.doc_id, r.page_no), []).append((r.top, r.bottom, r.start, r.end))
    for r in clicked.clicked_paragraphs(lines).collect():
        got.setdefault((r.doc_id, r.page_no), {})[r["at"]] = (r.first, r.last)
    long = 0
    for page, own in pages.items():
        expected = {i: walk(own, i) for i in range(len(own))}
        assert got[page] == expected, page
        long += sum(b - a > 3 for a, b in expected.values())
    assert long > 100


@pytest.mark.parametrize(("rows", "expected"), [([], []), ([(1, 1, 0, 0.0, 10.0, 5.0, 90.0)], [(1, 1, 0, 0, 0)])])
def test_empty_and_single_pages(spark, rows, expected):
    lines = spark.createDataFrame(rows, "doc_id int, page_no int, at int, top double, bottom double, start double, end double")
    assert list(map(tuple, clicked.clicked_paragraphs(lines).collect())) == expected


LINES = "doc_id int, page_no int, at int, top double, bottom double, start double, end double"


def random_page(rng, n):
    lines, top = [], 0.0
    for _ in range(n):
        thick = rng.choice([10.0, 10.0, 10.0, 8.0, 16.0])
        lines.append((top, top + thick, rng.choice([50.0, 50.0, 50.0, 52.0, 66.0, 80.0]), rng.choice([525.0, 525.0, 524.0, 523.0, 300.0])))
        top += rng.choice([12.0, 12.0, 12.0, 13.0, 15.0, 30.0])
    return lines


def test_whole_and_large_pages_agree_with_a_walk(spark):
    """Pages of over 60 lines go by joins, the others within a task."""
    rng = random.Random(5)
    pages = [random_page(rng, n) for n in (1, 2, 3, 40, 60, 61, 130)] + [[(i * 12.0, i * 12.0 + 10, 50.0, 525.0) for i in range(n)] for n in (59, 200)]
    rows = [(1, p, i, *line) for p, lines in enumerate(pages) for i, line in enumerate(lines)]
    rng.shuffle(rows)
    for most in (60, clicked.WHOLE):
        got = {(r.page_no, r["at"]): (r.first, r.last) for r in clicked.clicked_paragraphs(spark.createDataFrame(rows, LINES), most).collect()}
        assert got == {(p, i): walk(lines, i) for p, lines in enumerate(pages) for i in range(len(lines))}, most


def test_lines_without_ends_places_or_thickness(spark):
    """They stay alone, whichever way their page goes; so do lines without a page."""
    plain = [(i * 12.0, i * 12.0 + 10, 50.0, 525.0) for i in range(12)]
    odd = [*plain[:3], (36.0, 46.0, 50.0, None), (48.0, 58.0, 50.0, float("nan")), (None, 70.0, 50.0, 525.0), (72.0, 72.0, 50.0, 525.0), *plain[7:]]
    rows = [(1, 1, i, *line) for i, line in enumerate(odd)] + [(1, None, i, *line) for i, line in enumerate(plain)] + [(2, 1, i, *line[:3], None) for i, line in enumerate(plain)]
    found = [sorted(map(tuple, clicked.clicked_paragraphs(spark.createDataFrame(rows, LINES), most).where("page_no IS NOT NULL").collect())) for most in (1, clicked.WHOLE)]
    expected = [(0, 3)] * 4 + [(i, i) for i in (4, 5, 6)] + [(7, 11)] * 5
    assert found[0] == found[1] == sorted([(1, 1, i, *ends) for i, ends in enumerate(expected)] + [(2, 1, i, i, i) for i in range(12)])
    assert all(r.first == r["at"] == r.last for r in clicked.clicked_paragraphs(spark.createDataFrame(rows, LINES)).where("page_no IS NULL").collect())


def test_pages_are_put_together_from_batches(monkeypatch):
    monkeypatch.setattr(clicked, "AT_ONCE", 100)
    rng = random.Random(6)
    pages = [random_page(rng, rng.choice([1, 7, 30, 250])) for _ in range(40)]
    lines = pa.table({c: [line[i] for page in pages for line in page] for i, c in enumerate(clicked.PLACE)})
    ids = [p for p, page in enumerate(pages) for _ in page]
    lines = lines.append_column("doc_id", pa.array(ids)).append_column("page_no", pa.array(ids)).append_column("n", pa.array([len(pages[p]) for p in ids]))
    taken = list(clicked._whole_pages(iter(lines.to_batches(max_chunksize=33))))
    assert pa.concat_tables(t for t, _ in taken).equals(lines)
    assert len(taken) > 5
    got = []
    for table, sizes in taken:
        assert sizes.sum() == table.num_rows
        got += [(table["doc_id"][i].as_py(), b - a) for i, (a, b) in enumerate(zip(*clicked._found(table, sizes), strict=True))]
    assert got == [(p, b - a) for p, page in enumerate(pages) for a, b in (walk(page, i) for i in range(len(page)))]


def test_lines_are_shuffled_by_their_page_and_no_further(spark, sf_dir, monkeypatch):
    tables = []
    monkeypatch.setattr(clicked, "written", lambda df, label: tables.append(label) or written(df, label))
    # Other rows than those that another test has cached.
    found = clicked.clicked_paragraphs(flow_queries.set_lines_of(table(spark, sf_dir, "lineitem").where("l_orderkey > 1")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert tables == []
    assert re.findall(r"Exchange \w+", plan) == ["Exchange hashpartitioning"]
    assert len(re.findall(r"\bSort \[", plan)) == 1
