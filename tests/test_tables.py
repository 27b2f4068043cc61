"""Ruled and aligned tables against plain loops over the same strokes and lines."""

import re
from collections import defaultdict
from decimal import ROUND_HALF_UP, Decimal

import pytest

from docloom.operators import chains, spatial, tables
from docloom.plans import table_queries
from docloom.session import table, written

EPS = 1e-9


def rounded(x):
    return float((x if isinstance(x, Decimal) else Decimal(repr(x))).quantize(Decimal("0.1"), ROUND_HALF_UP))


def together(items, meet):
    """Groups of indices that meet, directly or through others."""
    left, out = set(range(len(items))), []
    while left:
        todo, own = [min(left)], []
        left.discard(todo[0])
        while todo:
            i = todo.pop()
            own.append(i)
            near = {j for j in left if meet(items[i], items[j])}
            left -= near
            todo += near
        out.append(sorted(own))
    return out


def snapped(places, clearance=2.0):
    groups = []
    for p in sorted(places):
        if groups and p - groups[-1][-1] <= clearance + EPS:
            groups[-1].append(p)
        else:
            groups.append([p])
    return groups


def plain_cells(strokes):
    """(row, column, row span, column span) of one group of strokes by the grid laid out in full."""
    flat = [s for s in strokes if s[3] - s[1] >= s[4] - s[2]]
    upright = [s for s in strokes if s not in flat]
    if not flat or not upright:
        return None
    box = (min(s[1] for s in strokes), min(s[2] for s in strokes), max(s[3] for s in strokes), max(s[4] for s in strokes))
    lines = []
    for own, at in ((flat, 2), (upright, 1)):
        groups = snapped([rounded((s[at] + s[at + 2]) / 2) for s in own])
        found = [(rounded(sum(Decimal(repr(p)) for p in g) / len(g)), [s for s in own if rounded((s[at] + s[at + 2]) / 2) in g]) for g in groups]
        if found[0][0] - box[at - 1] > 6:
            found.insert(0, (box[at - 1], []))
        if box[at + 1] - found[-1][0] > 6:
            found.append((box[at + 1], []))
        lines.append(found)
    ys, xs = lines
    rows, cols = len(ys) - 1, len(xs) - 1
    if rows < 1 or cols < 1:
        return []
    mid = lambda at, i: (at[i][0] + at[i + 1][0]) / 2
    left = [[j == 0 or any(s[2] < mid(ys, i) < s[4] for s in xs[j][1]) for j in range(cols)] for i in range(rows)]
    top = [[i == 0 or any(s[1] < mid(xs, j) < s[3] for s in ys[i][1]) for j in range(cols)] for i in range(rows)]

    def run(flags):
        n = 1
        while n < len(flags) and not flags[n]:
            n += 1
        return n if flags[0] else 0

    spans = [[(run([top[k][j] for k in range(i, rows)]), run(left[i][j:])) for j in range(cols)] for i in range(rows)]
    for i in range(rows):
        for j in range(cols):
            down, across = spans[i][j]
            if 0 in (down, across) or (down, across) == (1, 1):
                continue
            inside = [(m, n) for m in range(i, i + down) for n in range(j, j + across) if (m, n) != (i, j)]
            if any(0 not in spans[m][n] for m, n in inside):
                for m, n in inside:
                    if 0 in spans[m][n]:
                        spans[m][n] = (1, 1)
                spans[i][j] = (1, 1)
    at = lambda found, k: rounded(found[k][0])
    return [(i, j, d, a, at(xs, j), at(ys, i), at(xs, j + a), at(ys, i + d)) for i in range(rows) for j in range(cols) for d, a in [spans[i][j]] if d and a]


def plain_tables(strokes):
    def meet(a, b):
        return a[1] - 1 <= b[3] and b[1] <= a[3] + 1 and a[2] - 1 <= b[4] and b[2] <= a[4] + 1

    groups = [[strokes[i] for i in g] for g in together(strokes, meet)]
    boxes = [(min(s[1] for s in g), min(s[2] for s in g), max(s[3] for s in g), max(s[4] for s in g)) for g in groups]

    def nested(a, b):
        holds = lambda x, y: x[0] <= y[0] and x[1] <= y[1] and x[2] >= y[2] and x[3] >= y[3]
        return holds(a, b) or holds(b, a)

    out = []
    for family in together(boxes, nested):
        best = min(family, key=lambda i: (-(boxes[i][2] - boxes[i][0]) * (boxes[i][3] - boxes[i][1]), min(s[0] for s in groups[i])))
        cells = plain_cells(groups[best])
        out += [(min(s[0] for s in groups[best]), *c) for c in cells or []]
    return sorted(out)


def by_page(rows, *columns):
    pages = defaultdict(list)
    for r in rows:
        pages[r["doc_id"], r["page_no"]].append(tuple(r[c] for c in columns))
    return pages


def test_ruled_tables_agree_with_a_full_grid(spark, sf_dir):
    strokes = table_queries.strokes_of(table(spark, sf_dir, "lineitem")).where("stroke % 9 < 5").cache()
    got = by_page(tables.ruled_tables(strokes).collect(), "table_no", "row_no", "col_no", "row_span", "col_span", *spatial.BOX)
    pages = by_page(strokes.collect(), "stroke", *spatial.BOX)
    spans = 0
    for page, own in pages.items():
        expected = plain_tables(sorted(own))
        found = sorted((*r[:5], *(rounded(v) for v in r[5:])) for r in got.get(page, []))
        assert found == expected, page
        spans += sum(r[3] > 1 or r[4] > 1 for r in found)
    assert spans > 100


STROKES = "doc_id int, page_no int, stroke int, x0 double, y0 double, x1 double, y1 double"


def test_missing_edges_nested_groups_and_odd_strokes(spark):
    def cross(n, x, y, size):
        return [(n, x, y + size / 2, x + size, y + size / 2 + 0.5), (n + 1, x + size / 2, y, x + size / 2 + 0.5, y + size)]

    pages = {1: cross(0, 0, 0, 100), 2: cross(0, 0, 0, 100) + cross(5, 60, 60, 20), 3: [(0, 0, 0, 50, 0.5), (1, 0, 9, 50, 9.5)], 4: [(0, 0, 0, 0, 0)]}
    rows = [(1, p, *map(float, s)) for p, own in pages.items() for s in own]
    rows = [(d, p, int(n), *box) for d, p, n, *box in rows]
    got = by_page(tables.ruled_tables(spark.createDataFrame([*rows, (1, 1, 7, None, 1.0, 2.0, 3.0)], STROKES)).collect(), "table_no", "row_no", "col_no", "row_span", "col_span")
    whole = [(0, r, c, 1, 1) for r in range(2) for c in range(2)]
    assert {p: sorted(v) for (_, p), v in got.items()} == {1: whole, 2: whole}
    assert tables.ruled_tables(spark.createDataFrame([], STROKES)).collect() == []


def plain_aligned(lines):
    """(table, row, column, line) by laying the rows of a run over each other one after the other."""
    rows, reach = [], None
    for line in sorted(lines, key=lambda r: (r[2], r[4])):
        if reach is None or line[2] > reach:
            rows.append([])
        rows[-1].append(line)
        reach = line[4] if reach is None else max(reach, line[4])

    def free(row):
        strips, right = [], -1e9
        for line in sorted(row, key=lambda r: (r[1], r[3])):
            if line[1] > right:
                strips.append((right, line[1]))
            right = max(right, line[3])
        return [*strips, (right, 1e9)]

    runs, before = [], None
    for number, row in enumerate(rows):
        own = free(row)
        if len(own) <= 2:
            before = None
            continue
        gap = min(r[2] for r in row) - max(r[4] for r in rows[number - 1]) if number else 0
        strips = [(max(a, c), min(b, d)) for a, b in runs[-1][1] for c, d in own if min(b, d) > max(a, c)] if before is not None and gap < 50 else []
        if len(strips) > 2:
            runs[-1] = ([*runs[-1][0], row], strips)
        else:
            runs.append(([row], own))
        before = row
    out, number = [], 0
    for own, strips in runs:
        cells = [(r, sum(b <= line[1] for _, b in strips[1:-1]), line[0]) for r, row in enumerate(own) for line in row]
        if len(strips) > 3 or len({c[:2] for c in cells}) < len(cells):
            out += [(number, *c) for c in cells]
            number += 1
    return sorted(out)


def test_aligned_tables_agree_with_a_plain_scan(spark, sf_dir):
    lines = table_queries.lines_of(table(spark, sf_dir, "lineitem")).cache()
    got = by_page(tables.aligned_tables(lines).collect(), "table_no", "row_no", "col_no", "line_no")
    pages = by_page(lines.collect(), "line_no", *spatial.BOX)
    found = 0
    for page, own in pages.items():
        expected = plain_aligned(own)
        assert sorted(got.get(page, [])) == expected, page
        found += len({r[0] for r in expected})
    assert found > 50


LINES = "doc_id int, page_no int, line_no int, x0 double, y0 double, x1 double, y1 double"


def test_runs_end_where_no_strip_is_left_even_if_one_is_again_below(spark):
    """The second row fills the gap of the first, the third leaves a strip beside both and so hides that; a page of such islands, and one of a single island in parts."""
    rows = [[(0.0, 10.0), (20.0, 30.0)], [(5.0, 25.0), (28.0, 35.0)], [(0.0, 8.0), (45.0, 70.0), (100.0, 110.0)], [(0.0, 50.0), (60.0, 120.0)]]
    islands = [(i * 7 + n, x0, i * 99.0 + r * 14, x1, i * 99.0 + r * 14 + 9) for i in range(10) for n, (r, x0, x1) in enumerate((r, *box) for r in range(3) for box in rows[r])]
    single = [(i * 9 + n, x0, (i * 4 + r) * 14.0, x1, (i * 4 + r) * 14.0 + 9) for i in range(400) for n, (r, x0, x1) in enumerate((r, *box) for r in range(4) for box in rows[r])]
    frame = spark.createDataFrame([(1, 1, *r) for r in islands] + [(1, 2, *r) for r in single], LINES)
    got = by_page(tables.aligned_tables(frame, 1000).collect(), "table_no", "row_no", "col_no", "line_no")
    assert len({r[0] for r in plain_aligned(islands)}) == 10
    assert sorted(got[1, 1]) == plain_aligned(islands)
    assert sorted(got[1, 2]) == plain_aligned(single)


def test_long_runs_in_parts(spark):
    """A run of 300 rows goes through parts of 50 lines, beside pages that are one part."""
    lines = [(i * 2 + c, c * 50.0, i * 14.0, c * 50.0 + 20 + i % 3, i * 14.0 + 9) for i in range(300) for c in range(2) if (i, c) != (200, 1)]
    lines += [(1000, 75.0, 0.0, 80.0, 9.0)]
    rows = [(1, p, *r) for p in (1, 2) for r in lines if p == 1 or r[0] < 40]
    got = by_page(tables.aligned_tables(spark.createDataFrame(rows, LINES), 50).collect(), "table_no", "row_no", "col_no", "line_no")
    for p in (1, 2):
        assert sorted(got.get((1, p), [])) == plain_aligned([r[2:] for r in rows if r[1] == p]), p


def test_lines_are_shuffled_by_their_page_and_no_further(spark, sf_dir, monkeypatch):
    """Rows, islands and runs follow from one order of a page."""
    plans = {}
    monkeypatch.setattr(tables, "written", lambda df, label: plans.setdefault(label, df._jdf.queryExecution().executedPlan().toString()) and written(df, label))
    # Other rows than those that another test has cached.
    found = tables.aligned_tables(table_queries.lines_of(table(spark, sf_dir, "lineitem").where("l_orderkey > 1")))
    assert {label: re.findall(r"Exchange \w+", plan) for label, plan in plans.items()} == {"text-rows": ["Exchange hashpartitioning"]}
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("rows", [[], [(1, 1, 0, 0.0, 0.0, 9.0, 9.0)], [(1, 1, 0, None, 0.0, 9.0, 9.0), (1, 1, 1, 20.0, 0.0, 29.0, 9.0)]])
def test_no_aligned_table(spark, rows):
    assert tables.aligned_tables(spark.createDataFrame(rows, LINES)).collect() == []


def test_connected_boxes_agree_with_plain_comparison(spark, sf_dir):
    strokes = table_queries.strokes_of(table(spark, sf_dir, "lineitem")).where("stroke % 5 = 0").cache()
    pages = by_page(strokes.collect(), "stroke", *spatial.BOX)
    got = by_page(spatial.connected(strokes, 3.0, 1.0, "stroke").collect(), "stroke", "root")
    for page, own in pages.items():
        own = sorted(own)
        groups = together(own, lambda a, b: a[1] - 6 <= b[3] and b[1] <= a[3] + 6 and a[2] - 2 <= b[4] and b[2] <= a[4] + 2)
        assert sorted(got[page]) == sorted((own[i][0], own[g[0]][0]) for g in groups for i in g)


@pytest.mark.parametrize("dense", [4096, 100])
def test_connected_boxes_are_linked_without_pairs(spark, monkeypatch, dense):
    """3,000 boxes that all meet make 4,498,500 pairs; only what hangs together differently in several cells may be linked."""
    linked = []
    monkeypatch.setattr(spatial, "DENSE", dense)
    monkeypatch.setattr(spatial, "components", lambda edges, keys: linked.append(edges.count()) or chains.components(edges, keys))
    same = spark.range(3000).selectExpr("'d' AS doc_id", "1 AS page_no", "id AS box", "10.0D AS x0", "20.0D AS y0", "90.0D + id % 3 AS x1", "30.0D AS y1")
    chain = spark.range(200).selectExpr("'d' AS doc_id", "2 AS page_no", "199 - id AS box", "id * 20.0D AS x0", "7.0D AS y0", "id * 20.0D + 21 AS x1", "9.0D AS y1")
    lost = spark.sql("SELECT 'd' AS doc_id, 1 AS page_no, 5000L AS box, CAST(NULL AS double) AS x0, 20.0D AS y0, 30.0D AS x1, 30.0D AS y1 UNION ALL SELECT NULL, 1, 5001L, 10.0D, 20.0D, 30.0D, 30.0D UNION ALL SELECT NULL, 1, 5002L, 10.0D, 20.0D, 30.0D, 30.0D")
    found = spatial.connected(same.unionByName(chain).unionByName(lost), 0.5, 0.5).collect()
    assert {(r.page_no, r.box, r.root) for r in found} == {(1, k, 0) for k in range(3000)} | {(2, k, 0) for k in range(200)} | {(1, k, k) for k in (5000, 5001, 5002)}
    assert len(found) == 3203 and sum(linked) < 3000


def test_strokes_that_all_meet_make_no_pairs(spark, monkeypatch):
    """20 lines each way, drawn ten times over: 79,800 pairs, none of which may be written or linked; one table of 19 by 19 cells."""
    monkeypatch.setattr(spatial, "components", lambda edges, keys: pytest.fail("pairs of strokes"))
    places = spark.range(400).selectExpr("'d' AS doc_id", "1 AS page_no", "id AS stroke", "id % 20 * 30.0D AS at", "id % 40 < 20 AS flat")
    strokes = places.selectExpr("doc_id", "page_no", "stroke", "if(flat, 0.0D, at - 0.25D) AS x0", "if(flat, at - 0.25D, 0.0D) AS y0", "if(flat, 570.0D, at + 0.25D) AS x1", "if(flat, at + 0.25D, 570.0D) AS y1")
    cells = tables.ruled_tables(strokes).collect()
    assert sorted((c.row_no, c.col_no, c.row_span, c.col_span) for c in cells) == [(r, c, 1, 1) for r in range(19) for c in range(19)]


def test_borders_of_cells_are_not_joined(spark, monkeypatch):
    """Left and upper borders have as many rows as there are cells, in small files; a join of theirs went through the driver. The joins left are those of either with the extents of tables."""
    plans = {}
    monkeypatch.setattr(tables, "written", lambda df, label: plans.setdefault(label, df._jdf.queryExecution().optimizedPlan().toString()) and written(df, label))
    places = spark.range(8).selectExpr("'d' AS doc_id", "1 AS page_no", "id AS stroke", "id % 4 * 30.0D AS at", "id < 4 AS flat")
    strokes = places.selectExpr("doc_id", "page_no", "stroke", "if(flat, 0.0D, at) AS x0", "if(flat, at, 0.0D) AS y0", "if(flat, 90.0D, at) AS x1", "if(flat, at, 90.0D) AS y1")
    found = {(c.row_no, c.col_no): (c.x0, c.y0, c.x1, c.y1) for c in tables.ruled_tables(strokes).collect()}
    assert found == {(r, c): (c * 30.0, r * 30.0, c * 30.0 + 30, r * 30.0 + 30) for r in range(3) for c in range(3)}
    assert plans["cells"].count("Join ") == 2


def test_strokes_take_their_lines_with_one_shuffle(spark):
    """Clusters, their places and the edges of the table are windows within a table; strokes met their grid by a join before."""
    strokes = spark.range(8).selectExpr("'d' AS doc_id", "1 AS page_no", "0L AS table_no", "id AS stroke", "id < 4 AS flat", "id % 4 * 30.0D AS at").selectExpr("doc_id", "page_no", "table_no", "stroke", "flat", "if(flat, 0.0D, at) AS x0", "if(flat, at, 10.0D) AS y0", "if(flat, 97.0D, at) AS x1", "if(flat, at, 80.0D) AS y1")
    plans = {}
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(tables, "written", lambda df, label: plans.setdefault(label, df._jdf.queryExecution().executedPlan().toString()) and written(df, label))
        grid, lined = tables.grid_lines(strokes)
    assert "Join" not in plans["lined"] + plans["grid"] and plans["lined"].count("Exchange ") == 1
    assert sorted((r.flat, r.line, r["at"]) for r in grid.collect()) == [(False, k, k * 30.0) for k in range(4)] + [(False, 4, 97.0)] + [(True, k, k * 30.0) for k in range(4)]
    assert sorted((r.flat, r.line, r.low, r.high) for r in lined.collect()) == [(False, k, 10.0, 80.0) for k in range(4)] + [(True, k, 0.0, 97.0) for k in range(4)]


def test_places_of_boxes_that_meet_are_shuffled_once(spark):
    """Rows are made structs when they have met; below the join a struct would hold the places that the row has too."""
    boxes = spark.createDataFrame([("d", 1, 7, 0.0, 0.0, 9.0, 9.0), ("d", 1, 8, 5.0, 5.0, 40.0, 40.0)], "doc_id string, page_no int, k int, x0 double, y0 double, x1 double, y1 double")
    pairs = spatial.meeting(boxes, boxes.drop("k"))
    plan = pairs._jdf.queryExecution().analyzed().toString()
    assert "struct(" in plan and plan.rindex("struct(") < plan.index("Join")
    assert sorted((r.a.k, r.b.x0, r.b.y1) for r in pairs.collect()) == [(7, 0.0, 9.0), (7, 5.0, 40.0), (8, 0.0, 9.0), (8, 5.0, 40.0)]
