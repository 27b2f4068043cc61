"""Pages of a flow against a plain fold; margins where pages are missing."""

import random

import pytest

from docloom.operators import chains, flow

BLOCKS = "doc_id int, pos int, height double, gap double, new_page boolean, page_height double"


def plain(blocks):
    out, page, used = [], 0, None
    for pos, height, gap, forced, room in blocks:
        height, gap = height or 0.0, gap or 0.0
        if used is None or forced or used + gap + height > room:
            page, used = page + 1, height
        else:
            used += gap + height
        out.append((pos, page))
    return out


def test_pages_agree_with_a_fold(spark):
    rng = random.Random(3)
    docs = {d: [(p, float(rng.randrange(0, 90)), float(rng.randrange(0, 9)), rng.random() < 0.02, 200.0) for p in range(n)] for d, n in ((1, 4000), (2, 1), (3, 57))}
    docs[4] = [(0, 900.0, 0.0, None, 200.0), (3, 900.0, 5.0, False, 200.0), (5, None, None, False, 200.0), (6, 100.0, 0.0, True, 200.0), (9, 100.0, 0.0, False, 200.0)]
    rows = [(d, *b) for d, own in docs.items() for b in own]
    got = {}
    for r in flow.paginated(spark.createDataFrame(rows, BLOCKS)).collect():
        got.setdefault(r.doc_id, []).append((r.pos, r.page_no))
    # A block without height after one that is too high goes to a page of its own, as nothing fits there any more.
    assert {d: sorted(v) for d, v in got.items()} == {d: plain(own) for d, own in docs.items()}


def test_empty_flow(spark):
    assert flow.paginated(spark.createDataFrame([], BLOCKS)).collect() == []


def test_links_that_lead_round_end(spark):
    links = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 0), (1, 5, 6), (2, 0, None)], "d int, at int, next int")
    starts = spark.createDataFrame([(1, 0), (2, 0)], "d int, at int")
    assert sorted(map(tuple, chains.reached(links, starts, ["d"]).collect())) == [(1, 0), (1, 1), (1, 2), (2, 0)]


@pytest.mark.parametrize(("depths", "margin"), [([(1, 1, 300.0, None, True)], 56.69), ([(1, 1, 800.0, None, True)], 42.52), ([], 56.69)])
def test_margin_without_full_pages(spark, depths, margin):
    rows = spark.createDataFrame(depths, "doc_id int, page_no int, bottom double, with_next double, ends_paragraph boolean")
    documents = spark.createDataFrame([(1, 842.0, None)], "doc_id int, page_height double, most_depth double")
    full = spark.createDataFrame([(1, 1)], "doc_id int, page_no int")
    found = flow.bottom_margins(rows, documents, full).collect()
    wanted = 56.693 if depths and margin == 56.69 else margin
    assert [(r.margin, r.breaks) for r in found] == [(wanted, [1])]
