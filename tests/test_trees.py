"""Trees of any depth: chains, cycles, unknown parents and many nodes."""

import pytest

from docloom.operators import annots, chains, convert, forms, layout, pages, styles

DEEP = 1000


def chain(spark, columns):
    """A chain of DEEP nodes and one of nodes that lead round."""
    rows = spark.range(DEEP).selectExpr("'deep' AS doc_id", "CAST(id AS int) AS node_id", "CAST(CASE WHEN id > 0 THEN id - 1 END AS int) AS parent_id")
    ring = spark.range(7).selectExpr("'ring' AS doc_id", "CAST(id AS int) AS node_id", "CAST((id + 1) % 7 AS int) AS parent_id")
    lost = spark.range(1).selectExpr("'lost' AS doc_id", "CAST(id AS int) AS node_id", "99 AS parent_id")
    return rows.unionByName(ring).unionByName(lost).selectExpr("*", *columns)


def test_attributes_from_far_above(spark):
    nodes = chain(spark, ["CASE WHEN node_id = 0 AND doc_id = 'deep' THEN 'root' END AS value"]).withColumnRenamed("node_id", "id")
    found = {(r.doc_id, r.id): r.value for r in annots.inherited(nodes, "value", None).collect()}
    assert all(found["deep", i] == "root" for i in range(DEEP))
    assert {v for (d, _), v in found.items() if d != "deep"} == {None}
    near = {r.id: r.value for r in annots.inherited(nodes, "value").where("doc_id = 'deep'").collect()}
    assert near[annots.MOST_HOPS] == "root" and near[annots.MOST_HOPS + 1] is None


def test_values_bound_in_deep_scopes(spark):
    data = chain(spark, ["node_id AS pos", "'n' AS name", "false AS is_row", "CASE WHEN node_id IN (0, 3) THEN concat('v', node_id) END AS value"])
    fields = spark.createDataFrame([("deep", 1, "n", 999), ("deep", 2, "n", 2), ("deep", 3, "x", 999), ("ring", 4, "n", 6)], "doc_id string, field_id int, name string, scope int")
    found = {r.field_id: r.value for r in styles.bound_values(fields, data).collect()}
    assert found == {1: "v3", 2: "v3", 4: "v0\nv3"}


def test_data_paths_of_deep_forms(spark):
    nodes = chain(spark, ["'subform' AS tag", "CASE WHEN node_id % 100 = 0 THEN concat('g', node_id) END AS name", "CAST(NULL AS string) AS match"])
    found = {(r.doc_id, r.node_id): r.path for r in forms.data_paths(nodes).collect()}
    assert found["deep", 999] == ".".join(f"g{i}" for i in range(0, 1000, 100)) and found["deep", 50] == "g0"
    assert {found["ring", i] for i in range(7)} == {None} and found["lost", 0] == "g0"


def test_names_found_far_out(spark):
    nodes = chain(spark, ["'subform' AS tag", "CASE WHEN node_id IN (0, 500) THEN concat('g', node_id) END AS name"])
    lookups = spark.createDataFrame([("deep", 1, 999, "g0"), ("deep", 2, 999, "g500"), ("deep", 3, 999, "none"), ("ring", 4, 3, "g0")], "doc_id string, lookup_id int, at int, name string")
    assert {r.lookup_id: r.node_id for r in forms.found_in_scope(lookups, nodes).collect()} == {1: 0, 2: 500, 4: 0}


def test_styles_take_sixteen_links_at_most(spark):
    rows = [("d", f"s{i}", f"s{i - 1}" if i else None, {f"k{i}": str(i), "all": str(i)}) for i in range(40)] + [("d", "a", "b", {"x": "1"}), ("d", "b", "a", None)]
    found = {r.name: r.attrs for r in styles.style_chains(spark.createDataFrame(rows, "doc_id string, name string, parent string, attrs map<string,string>")).collect()}
    assert found["s39"] == {"all": "39", **{f"k{i}": str(i) for i in range(24, 40)}}
    assert found["a"] == found["b"] == {"x": "1"}


def test_many_nodes(spark):
    nodes = spark.range(300_000).selectExpr("'d' AS doc_id", "id", "CASE WHEN id > 0 THEN (id - 1) div 3 END AS parent_id", "CASE WHEN id IN (0, 1) THEN id END AS value")
    counts = {r.value: r["count"] for r in annots.inherited(nodes, "value", None).groupBy("value").count().collect()}
    assert sum(counts.values()) == 300_000 and set(counts) == {0, 1}


def test_followed_counts_a_node_once(spark):
    links = spark.createDataFrame([("d", 1, 2), ("d", 2, 3), ("d", 3, 1), ("d", 9, None)], "doc_id string, n int, up int")
    starts = spark.createDataFrame([("d", "s", 1), ("d", "t", 9), ("d", "u", 7)], "doc_id string, who string, at int")
    got = sorted(tuple(r) for r in chains.followed(starts, links, ["doc_id"], "at", "n", "up").select("who", "at", "hop").collect())
    assert got == [("s", 1, 0), ("s", 2, 1), ("s", 3, 2), ("t", 9, 0), ("u", 7, 0)]


def test_outline_of_a_hundred_thousand_entries(spark):
    outline = spark.range(100_000).selectExpr("'d' AS doc_id", "id AS pos", "CAST(1 + id % 7 AS int) AS level", "'t' AS title", "CAST(id AS int) AS page_no")
    mapping = spark.range(100_000).selectExpr("'d' AS doc_id", "CAST(id AS int) AS old_page", "CAST(id AS int) AS new_page")
    levels = pages.remapped_outline(outline, mapping).groupBy("level").count().collect()
    assert len(levels) == 7
    parents = {r.pos: r.parent for r in pages.outline_parents(outline).where("pos < 9").collect()}
    assert parents == {0: None, 1: 0, 2: 1, 3: 2, 4: 3, 5: 4, 6: 5, 7: None, 8: 7}


def test_dense_page_of_lines(spark):
    lines = spark.range(12_000).selectExpr("'d' AS doc_id", "1 AS page_no", "id AS block", "0 AS line", "CAST(id * 7 % 500 AS double) AS x0", "id * 1.5D AS y0", "CAST(id * 7 % 500 + 40 AS double) AS x1", "id * 1.5D + 1 AS y1")
    assert layout.column_bounds(lines).count() == 12_000
    assert layout.neighbours(lines).where("above IS NOT NULL OR below IS NOT NULL").count() == 12_000


def test_names_that_go_on_without_a_bound(spark):
    taken = spark.range(2, 30_002).selectExpr("'f' AS folder", "concat('x (', id, ')') AS name").unionByName(spark.createDataFrame([("f", "x"), ("f", "x (02)"), ("f", "y (2)")], "folder string, name string"))
    wanted = spark.createDataFrame([("f", "x"), ("f", "y"), ("f", "x (5)"), ("g", "x")], "folder string, name string")
    assert {(r.folder, r.name): r.free for r in convert.free_names(wanted, taken).collect()} == {("f", "x"): "x (30002)", ("f", "y"): "y", ("f", "x (5)"): "x (5) (2)", ("g", "x"): "x"}


def touching(a, b, gap=2.0):
    return a[0] <= b[2] + gap and b[0] <= a[2] + gap and a[1] <= b[3] + gap and b[1] <= a[3] + gap


def grown(boxes):
    boxes, again = list(boxes), True
    while again:
        again = False
        for i in range(len(boxes)):
            j = next((j for j in range(i + 1, len(boxes)) if touching(boxes[i], boxes[j])), None)
            if j is not None:
                b = boxes.pop(j)
                boxes[i] = (min(boxes[i][0], b[0]), min(boxes[i][1], b[1]), max(boxes[i][2], b[2]), max(boxes[i][3], b[3]))
                again = True
                break
    return boxes


@pytest.mark.parametrize("name", ["connected_boxes", "ocr_regions"])
def test_boxes_grow_as_in_a_plain_loop(spark, sf_dir, name):
    from docloom.plans import layout_queries

    spots, found = {}, {}
    for r in layout_queries._spots(spark, sf_dir).collect():
        spots.setdefault((r.doc_id, r.page_no), []).append((r.x0, r.y0, r.x1, r.y1))
    for r in getattr(layout_queries, name)(spark, sf_dir).collect():
        found.setdefault((r.doc_id, r.page_no), []).append((r.x0, r.y0, r.x1, r.y1))
    words = {}
    for r in layout_queries._words(spark, sf_dir).collect() if name == "ocr_regions" else []:
        words.setdefault((r.doc_id, r.page_no), []).append((r.x0, r.y0, r.x1, r.y1))
    area = lambda b: max(0.0, b[2] - b[0]) * max(0.0, b[3] - b[1])
    for page, boxes in spots.items():
        expected = grown(boxes)
        if name == "ocr_regions":
            own = [(max(b[0], 0.0), max(b[1], 0.0), min(b[2], 600.0), min(b[3], 800.0)) for b in boxes if b[0] < 300]
            expected = [b for b in grown(own) if b[2] - b[0] >= 8 and b[3] - b[1] >= 8 and area(b) >= 1000]
            if expected and (len(own) > 50 or len(expected) > 20 or sum(map(area, expected)) >= 0.6 * 480_000):
                expected = [(0.0, 0.0, 600.0, 800.0)]
            inside = lambda b, page=page: sum(area(w) for w in words.get(page, []) if b[0] <= (w[0] + w[2]) / 2 <= b[2] and b[1] <= (w[1] + w[3]) / 2 <= b[3])
            expected = [b for b in expected if inside(b) < 0.15 * area(b)]
        assert sorted(found.get(page, [])) == sorted(expected), page


@pytest.mark.parametrize("limits", [(2048, 1 << 20), (40, 500)])
def test_lines_of_one_key_are_compared_as_one(spark, monkeypatch, limits):
    import numpy as np

    monkeypatch.setattr(layout, "LINES_AT_ONCE", limits[0])
    monkeypatch.setattr(layout, "PAIRS_AT_ONCE", limits[1])
    rng = np.random.default_rng(4)
    rows = [("d", i % 2, int(rng.integers(0, 9)), int(rng.integers(0, 9)), float(x), float(y), float(x + w), float(y + h)) for i, (x, y, w, h) in enumerate(zip(rng.integers(0, 200, 160), rng.integers(0, 90, 160), rng.integers(1, 90, 160), rng.integers(4, 12, 160), strict=True))]
    rows += [("d", 0, 3, 99, None, 5.0, None, 9.0), ("d", 0, 3, 98, 900.0, 5.0, 910.0, 9.0)]
    lines = spark.createDataFrame(rows, "doc_id string, page_no int, block int, line int, x0 double, y0 double, x1 double, y1 double")
    bounds, near = {}, {}
    for _, page, block, line, x0, y0, x1, y1 in rows:
        starts, ends = bounds.setdefault((page, block, line), ([], []))
        above, below = near.setdefault((page, block, line), ([], []))
        for _, p, _, _, u0, v0, u1, v1 in rows:
            if p != page or x0 is None or u0 is None:
                continue
            if min(x1, u1) - max(x0, u0) > 0.3 * max(1.0, min(x1 - x0, u1 - u0)):
                starts.append(u0), ends.append(u1)
            if min(x1, u1) > max(x0, u0) and v1 - v0 >= 0.7 * (y1 - y0) and abs(y0 - v0) > 0.5 * (y1 - y0):
                (above if y0 > v0 else below).append(abs(y0 - v0))
    for key, (starts, ends) in list(bounds.items()):
        starts.sort()
        if starts:
            bounds[key] = next((a for a, b in zip(starts, starts[1:], strict=False) if b - a <= 1.5), starts[0]), max(ends)
        else:
            del bounds[key]
    assert {(r.page_no, r.block, r.line): (r.left, r.right) for r in layout.column_bounds(lines).collect()} == bounds
    assert {(r.page_no, r.block, r.line): (r.above, r.below) for r in layout.neighbours(lines).collect()} == {k: (min(a, default=None), min(b, default=None)) for k, (a, b) in near.items()}


def test_pages_are_compared_as_tables_of_numbers(spark):
    """Lines that are compared with their page one by one take ten calls and more each; a page takes as many in all."""
    calls = []

    def compare(boxes, first, page):
        calls.append(len(first))
        assert len(first) == 86
        return (page["x0"].sum() + boxes["x0"],)

    lines = spark.range(860).selectExpr("id % 10 AS doc_id", "1 AS page_no", "id AS block", "CAST(id AS double) AS x0")
    found = layout._compared(layout._beside_page(lines, ["block"], ["x0"]), ["block"], ["x0"], ["sum"], compare)
    assert found.count() == 860


def test_images_meet_only_the_words_about_them(spark):
    """Words far above and below tell nothing of an image and are in no pair with it; nearest lines within three points, of two as near the one above."""
    far = spark.range(2000).selectExpr("'d' AS doc_id", "1 AS page_no", "0.0D AS x0", "id * 100.0D + 5000 AS y0", "9.0D AS x1", "id * 100.0D + 5010 AS y1", "id * 100.0D + 5008 AS y", "'w' AS text")
    near = spark.createDataFrame([("d", 1, 60.0, 100.0, 70.0, 112.0, 108.0, "w"), ("d", 1, 80.0, 100.0, 90.0, 112.0, 112.0, "w"), ("d", 1, 60.0, 300.0, 70.0, 312.0, 309.0, "w")], "doc_id string, page_no int, x0 double, y0 double, x1 double, y1 double, y double, text string")
    images = spark.createDataFrame([("d", 1, 1, 10.0, 90.0, 50.0, 110.0), ("d", 1, 2, 10.0, 200.0, 50.0, 220.0), ("d", 1, 3, 10.0, 280.0, 50.0, 305.0), ("d", 1, 4, 62.0, 290.0, 68.0, 309.0), ("e", 1, 5, 1.0, 1.0, 2.0, 7.0)], "doc_id string, page_no int, image_no int, x0 double, y0 double, x1 double, y1 double")
    found = layout.images_in_lines(images, near.unionByName(far))
    assert {(r.image_no, r.y) for r in found.collect()} == {(1, 108.0), (2, 220.0), (5, 7.0)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "strip" in plan and "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def wild(spark):
    """Random trees of a few documents, with rings, unknown parents, names that are missing or empty, and one node alone."""
    import random

    r, rows = random.Random(5), []
    for doc, n in (("a", 60), ("b", 60), ("c", 1), (None, 20)):
        for i in range(n):
            parent = r.choice([i - 1, i // 2, r.randrange(n), None, 999, r.randrange(i + 1)])
            rows.append((doc, i * 3 % 61, None if parent is None else parent * 3 % 61 if parent < 61 else parent, r.choice(["subform", "field", "area", "proto", "pageArea"]), r.choice([None, "", "n1", "n2", "n3", "n4"]), r.choice(["once", None, "none", "dataRef"]), r.choice([True, False, False, None]), r.choice([None, " ", "v1", "v2", "v3"])))
    return spark.createDataFrame(rows, "doc_id string, node_id long, parent_id long, tag string, name string, match string, is_row boolean, value string").cache()


def at_once(spark, wild):
    paths = ["n1", "n2.n3", "this.parent", "this", "n1._n2", "_n3.n1", "n4.instanceManager", "xfa.form.n1", "$form.n2.n3", "this.n1[0].n2", "n1.parent.n2", "a b", "n2._n1.n3"]
    asked = spark.createDataFrame([(d, i, at, p) for d in ("a", "b", "c", "z", None) for i, (at, p) in enumerate((at, p) for at in (0, 3, 7, 30, 58, 500, None) for p in paths)], "doc_id string, path_id int, at long, path string")
    lookups = asked.selectExpr("doc_id", "path_id AS lookup_id", "at", "if(path_id % 3 = 0, 'n1', 'n4') AS name")
    fields = asked.selectExpr("doc_id", "path_id AS field_id", "if(path_id % 2 = 0, 'n1', 'n3') AS name", "at AS scope")
    attrs = "if(name = '', NULL, map(coalesce(name, 'k'), value, concat('x', node_id % 3), tag)) AS attrs"
    named = wild.selectExpr("doc_id", "if(node_id = 3, 'DEFAULT', concat('S', node_id)) AS name", "if(parent_id = 3, 'Default', concat('s', parent_id)) AS parent", attrs)
    found = {
        "paths": forms.resolved_paths(asked, wild), "scopes": forms.found_in_scope(lookups, wild), "data": forms.data_paths(wild),
        "values": styles.bound_values(fields, wild.withColumn("pos", wild["node_id"])), "styles": styles.style_chains(named),
    }
    return {k: sorted((tuple(sorted(x.items()) if isinstance(x, dict) else x for x in row) for row in df.collect()), key=repr) for k, df in found.items()}


def test_whole_documents_are_as_linked_ones(spark, wild, monkeypatch):
    """No row for each ancestor may be shuffled where a document is of a bounded size; results are those of joins, also with a name at a time."""
    from docloom.operators import trees

    linked, names = [], ("_linked_scopes", "_linked_resolved", "_linked_paths")
    for name in names:
        plain = getattr(forms, name)
        monkeypatch.setattr(forms, name, lambda *tables, plain=plain: linked.append(max(t.where("doc_id IS NOT NULL").count() for t in tables)) or plain(*tables))
    whole = at_once(spark, wild)
    assert set(linked) == {0} and all(whole.values())
    for limit in ("WHOLE", "AT_ONCE"):
        with monkeypatch.context() as m:
            m.setattr(trees, limit, 0)
            if limit == "WHOLE":
                m.setattr(forms, "MOST_PATHS", 0), m.setattr(styles, "MOST_BOUND", 0)
            other = at_once(spark, wild)
        for k in whole:
            assert other[k] == whole[k], (limit, k)
