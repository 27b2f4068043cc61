"""Sections of one and two columns against a scan from the top."""

import random
import re

import pyarrow as pa
import pytest

from docloom.operators import sections
from docloom.plans import table_queries
from docloom.session import table


def rows_of(lines):
    rows, reach = [], None
    for line in sorted(lines, key=lambda r: (r[2], r[4])):
        if reach is None or line[2] > reach:
            rows.append([])
        rows[-1].append(line)
        reach = line[4] if reach is None else max(reach, line[4])
    return rows


def gap_of(row, left, right):
    """The gap of a row of two columns, or None."""
    gaps, reach = [], None
    for line in sorted(row, key=lambda r: (r[1], r[3])):
        if reach is not None and line[1] > reach:
            gaps.append((reach, line[1]))
        reach = line[3] if reach is None else max(reach, line[3])
    if len(gaps) != 1:
        return None
    (a, b), middle = gaps[0], sum(gaps[0]) / 2
    one, other = middle - left, right - middle
    if not (one > 0 and other > 0 and one <= 2 * other and other <= 2 * one):
        return None
    return gaps[0] if a - min(r[1] for r in row) >= 0.33 * one and max(r[3] for r in row) - b >= 0.33 * other else None


def scanned(lines, left, right, least=20.0):
    out, gap, start = [], None, 0  # (rows, gap) of each section; gap is None for one column
    rows = rows_of(lines)
    for row in rows:
        own = gap_of(row, left, right)
        if gap is not None:
            if own:
                kept = (max(gap[0], own[0]), min(gap[1], own[1]))
            else:
                x0, x1 = min(r[1] for r in row), max(r[3] for r in row)
                kept = (max(gap[0], x1), gap[1]) if x1 < gap[1] else (gap[0], min(gap[1], x0)) if x0 > gap[0] else (0, 0)
            if kept[0] < kept[1]:
                out[-1] = ([*out[-1][0], row], kept)
                gap = kept
                continue
            tall = max(r[4] for x in out[-1][0] for r in x) - min(r[2] for x in out[-1][0] for r in x)
            if not own and tall < least:
                out[-1] = (out[-1][0], None)
            gap, own = None, None
        if own:
            out.append(([row], own))
            gap = own
        else:
            out.append(([row], None))
    found, number, before = [], -1, 0
    for own, cut in out:
        if cut is not None or before is not None:
            number += 1
        before = cut
        found += [(r[0], number, 1 if cut is None else 2, int(cut is not None and r[1] >= cut[1])) for row in own for r in row]
    return sorted(found)


def test_sections_agree_with_a_scan(spark, sf_dir):
    lines = table_queries.columned_lines_of(table(spark, sf_dir, "lineitem")).cache()
    pages, got, two = {}, {}, 0
    for r in lines.collect():
        pages.setdefault((r.doc_id, r.page_no), []).append((r.line_no, r.x0, r.y0, r.x1, r.y1))
    for r in sections.sections(lines).collect():
        got.setdefault((r.doc_id, r.page_no), []).append((r.line_no, r.section_no, r["columns"], r["column"]))
    for page, own in pages.items():
        expected = scanned(own, 50.0, 545.0)
        assert sorted(got[page]) == expected, page
        two += len({s for _, s, c, _ in expected if c == 2})
    assert two > 20


@pytest.mark.parametrize("rows", [[], [(1, 1, 0, None, 0.0, 1.0, 1.0, 0.0, 9.0)]])
def test_no_lines(spark, rows):
    lines = spark.createDataFrame(rows, "doc_id int, page_no int, line_no int, x0 double, y0 double, x1 double, y1 double, page_left double, page_right double")
    assert sections.sections(lines).collect() == []


LINES = "doc_id int, page_no int, line_no int, x0 double, y0 double, x1 double, y1 double, page_left double, page_right double"


def random_lines(rng, rows, step):
    """Rows of one column, of two and of texts on one side, ``step`` points apart; gaps lie about the middle and now and then elsewhere."""
    lines, y = [], 0.0
    for _ in range(rows):
        kind, shift = rng.choice("ttttttolrw"), rng.choice([0, 0, 0, 0, 30, -30])
        left, right = (50.0, 260.0 + rng.randrange(30) + shift), (300.0 + rng.randrange(10) + shift, 540.0 - rng.randrange(40))
        texts = {"t": [left, right], "o": [(50.0, 540.0)], "l": [left], "r": [right], "w": [left, right, (400.0, 545.0)]}[kind]
        for x0, x1 in texts:
            # Texts of a row needn't stand at one height.
            lines.append((x0, y + rng.choice([0, 1]), x1, y + rng.choice([0.6, 0.9]) * min(step, 10) + 1))
        y += step
    return [(i, *line) for i, line in enumerate(lines)]


def found(spark, pages):
    rows = [(1, p, *line, 50.0, 545.0) for p, lines in enumerate(pages) for line in lines]
    random.Random(1).shuffle(rows)
    got = {p: [] for p in range(len(pages))}
    for r in sections.sections(spark.createDataFrame(rows, LINES)).collect():
        got[r.page_no].append((r.line_no, r.section_no, r["columns"], r["column"]))
    return [sorted(got[p]) for p in range(len(pages))]


def test_random_and_long_pages_agree_with_a_scan(spark):
    rng = random.Random(3)
    pages = [random_lines(rng, rows, step) for rows in (1, 2, 3, 10, 60, 200) for step in (4, 9, 14) for _ in range(3)]
    # More lines than come to a task at once, and as many in a section that isn't high enough until it ends.
    pages += [random_lines(rng, 9000, 14), [(i, (i % 2) * 250.0 + 50, i // 2 * 0.001, (i % 2) * 250.0 + 250, i // 2 * 0.001 + 0.0005) for i in range(24000)] + [(24000, 50.0, 15.0, 540.0, 16.0)]]
    for got, lines in zip(found(spark, pages), pages, strict=True):
        assert got == scanned(lines, 50.0, 545.0)


def test_sections_do_not_depend_on_how_lines_come():
    rng = random.Random(4)
    pages = [random_lines(rng, rows, step) for rows in (1, 5, 40) for step in (2, 5, 14) for _ in range(4)]
    columns = {c: [] for c in ("doc_id", "page_no", "line_no", "x0", "y0", "x1", "y1", "page_left", "page_right", "begins")}
    for p, lines in enumerate(pages):
        for i, row in enumerate(rows_of(lines)):
            for j, line in enumerate(row):
                values = (1, p, *line, 50.0, 545.0, sections.ON if j else sections.ROW if i else sections.TOP)
                for c, v in zip(columns, values, strict=True):
                    columns[c].append(v)
    lines = pa.table(columns)
    for size in (1, 2, 7, 64, len(lines)):
        got = pa.concat_tables(sections._settled(iter(lines.to_batches(max_chunksize=size)), 20.0)).to_pydict()
        rows = sorted(zip(got["page_no"], got["line_no"], got["section_no"], got["columns"], got["column"], strict=True))
        assert rows == [(p, *r) for p, own in enumerate(pages) for r in scanned(own, 50.0, 545.0)], size


def test_what_rows_leave_of_a_gap(spark):
    """A row with a gap of its own on one side of the gap is part of the section; text beyond a margin makes no gap; text within a gap leaves the left part of it."""
    two = [(50.0, 250.0), (330.0, 540.0)]
    aside, beyond, within = [(50.0, 130.0), (190.0, 250.0)], [(10.0, 30.0)], [(280.0, 300.0)]
    cases = [
        ([two, two, aside, two], [(0, 2, (0, 1))] * 2 + [(0, 2, (0, 0)), (0, 2, (0, 1))]),
        ([two, two, beyond, [(50.0, 540.0)]], [(0, 2, (0, 1))] * 2 + [(0, 2, (0,)), (1, 1, (0,))]),
        ([two, two, within, [(290.0, 540.0)], [(260.0, 540.0)]], [(0, 2, (0, 1))] * 2 + [(0, 2, (1,))] * 3),
    ]
    pages = [[(i, x0, r * 14.0, x1, r * 14.0 + 9) for i, (r, x0, x1) in enumerate((r, *text) for r, row in enumerate(rows) for text in row)] for rows, _ in cases]
    for got, (_, expected) in zip(found(spark, pages), cases, strict=True):
        assert [r[1:] for r in got] == [(number, columns, c) for number, columns, own in expected for c in own]


def test_lines_without_a_place_or_page_take_no_part(spark):
    lines = random_lines(random.Random(8), 20, 14)
    rows = [(1, 1, *line, 50.0, 545.0) for line in lines] + [(1, None, *line, 50.0, 545.0) for line in lines] + [(1, 1, 99, float("nan"), 0.0, 9.0, 900.0, 50.0, 545.0), (1, 1, 98, 0.0, None, 9.0, 9.0, 50.0, 545.0)]
    got = sections.sections(spark.createDataFrame(rows, LINES)).collect()
    assert sorted((r.line_no, r.section_no, r["columns"], r["column"]) for r in got) == scanned(lines, 50.0, 545.0)


def test_lines_are_shuffled_by_their_page_and_no_further(spark, sf_dir):
    # Other rows than those that another test has cached.
    found = sections.sections(table_queries.columned_lines_of(table(spark, sf_dir, "lineitem").where("l_orderkey > 1")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"Exchange \w+", plan) == ["Exchange hashpartitioning"]
    assert len(re.findall(r"\bSort \[", plan)) == 2
    assert "FileScan parquet" in plan
    assert "docloom-" not in plan
