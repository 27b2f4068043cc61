"""The manifest against a plain tree: nulls, repeats, many groups, one row, long texts, clashing columns, empty tables."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from docloom.llm import merkle, ranks

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree long, pos long, node string, path string, row long, at long, part long"


def h(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf(row, more=0):
    i, source, lang, n, text = row
    parts = []
    for v in (i, source, lang, None if n is None else n + more, text):
        parts.append("-" if v is None else f"{len(str(v).encode())}:{v}")
    return h(*parts)


def climb(nodes):
    """The root and, for each node, (side, sibling) from the bottom up."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            pair = nodes[i - i % 2 : i - i % 2 + 2]
            steps[k].append((i % 2, pair[1 - i % 2] if len(pair) == 2 else ""))
        nodes, at = [h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)], [i // 2 for i in at]
    return nodes[0], steps


def expected(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append(row)
    trees, subroots = [], []
    for lang in sorted(groups, key=lambda x: (x is not None, (x or "").encode())):
        found = sorted(groups[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        subroot, steps = climb([leaf(r) for r in found])
        trees.append((found, subroot, steps))
        subroots.append(subroot)
    if not trees:
        return []
    root, over = climb(subroots)
    out = []
    for (found, subroot, steps), above in zip(trees, over, strict=True):
        for row, own in zip(found, steps, strict=True):
            path = own + above
            end = leaf(row, 1 if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 else 0)
            for side, sibling in path:
                end = h(sibling, end) if side else h(end, sibling)
            out.append((row[0], leaf(row), subroot, root, h(*[s for _, s in path]), end, end == root))
    return sorted(out, key=repr)


def result(spark, rows):
    docs = spark.createDataFrame([(*r, 1, 2, "x", "y", 3, 4, 5) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in merkle.digest(merkle.document_manifest(docs)).collect()), key=repr)


ROWS = [
    (1, "s", "en", 3, "abc"), (2, None, "en", None, None), (3, "s", None, 0, ""), (None, "s", "en", 1, "x"), (None, None, None, None, None),
    (4, "s", "é", 2, "😀é"), (4, "s", "é", 2, "😀é"), (4, "s", "é", 9, "other"), (5, "s", "z", 5, "long " * 300_000), (7, "-", "-", 1, "-"), (-7, "s", "", 1, "1:a"),
]


@pytest.mark.parametrize(("levels", "top"), [(12, 4096), (2, 5), (1, 2)])
def test_manifest_agrees_with_a_plain_tree(spark, monkeypatch, levels, top):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", levels)
    monkeypatch.setattr(merkle, "MOST_TOP", top)
    monkeypatch.setattr(merkle, "MOST_PATHS", top)
    rows = ROWS + [(100 + i, "s", "en", i, f"t{i}") for i in range(37)]
    assert result(spark, rows) == expected(rows)


def test_groups_as_many_as_rows(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", 2)
    monkeypatch.setattr(merkle, "MOST_TOP", 4)
    rows = [(i, "s", f"lang {i % 41}", 1, "t") for i in range(60)]
    assert result(spark, rows) == expected(rows)


@pytest.mark.parametrize("rows", [[], [(9, "s", "en", 1, "a")], [(None, None, None, None, None)]])
def test_none_and_one(spark, rows):
    assert result(spark, rows) == expected(rows)


def test_positions_in_one_large_group(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(ranks, "ROWS_PER_RANGE", 50)
    monkeypatch.setattr(ranks, "MOST_OFFSETS", 3)
    rows = [("a" if i % 3 else "b" if i % 2 else None, (i * 37) % 1000, 1 + i % 4) for i in range(1000)]
    table = spark.createDataFrame(rows, "g string, o long, v long")
    got = {(r.g, r.o): (r.pos, r.n, r.upto) for r in ranks.positions(table, ["g"], ["o"], {"upto": "v"}).collect()}
    for g in ("a", "b", None):
        own = sorted((o, v) for x, o, v in rows if x == g)
        for at, (o, _) in enumerate(own):
            assert got[g, o] == (at, len(own), sum(v for _, v in own[: at + 1]))
