"""Exact dedup against brute force: nulls, empty and very long texts, ties, repeats, clashing columns, empty tables, later files."""

import hashlib
import re
from collections import defaultdict

import pytest

from docloom.llm import exactdedup

SCHEMA = "doc_id long, text string, file string, row long, sha string, digest string, body string, first string, n long, size long"
LONG = "the whole text " * 100_000


def expected(rows):
    """Rows are (doc_id, text) in the order of their locators."""
    groups = defaultdict(list)
    for at, (i, t) in enumerate(rows):
        body = re.sub(r"[\x20\x09-\x0D]+", "", t or "")
        groups[body].append((-len(t or ""), i is None, i or 0, at, i))
    out = []
    for body, found in groups.items():
        found.sort()
        sha = hashlib.sha256(body.encode()).hexdigest()
        out += [(i, found[0][4], len(found), x == 0, sha) for x, (*_, i) in enumerate(found)]
    return sorted(out, key=repr)


def stored(spark, path, rows, mode="overwrite"):
    full = [(i, t, "f", 1, "s", "d", "b", "x", 2, 3) for i, t in rows]
    spark.createDataFrame(full, SCHEMA).coalesce(1).write.mode(mode).parquet(path)
    return path


def result(found):
    return sorted((tuple(r) for r in exactdedup.digest(found).collect()), key=repr)


ROWS = [
    (1, "a b c"), (2, "abc"), (3, "a\tb\n\x0b\x0c\rc"), (4, None), (5, ""), (6, " \n"), (None, "abc"), (None, "a  b  c  d"), (7, "a b c d"),
    (8, "A b c"), (9, "a b c"), (1, "a b c"), (10, LONG), (11, LONG + " "), (12, "😀 x"), (13, "😀x"), (14, "é"), (15, "é"),
]


@pytest.mark.parametrize("key_bytes", [32, 1])
def test_groups_agree_with_brute_force(spark, tmp_path, key_bytes):
    rows = ROWS + [(100 + i, f"text {i % 300}") for i in range(900)]
    path = stored(spark, f"{tmp_path}/docs.parquet", rows)
    assert result(exactdedup.deduplicated(spark, path, key_bytes=key_bytes)) == expected(rows)


def test_one_file_as_table(spark, tmp_path):
    path = stored(spark, f"{tmp_path}/docs", ROWS)
    file = next((tmp_path / "docs").glob("part-*.parquet"))
    assert result(exactdedup.deduplicated(spark, str(file))) == expected(ROWS) == result(exactdedup.deduplicated(spark, path))


def test_unequal_texts_under_one_key_are_found(spark, tmp_path):
    path = stored(spark, f"{tmp_path}/docs", [(i, f"text {i}") for i in range(600)])
    docs = spark.read.parquet(path)
    groups = exactdedup.Index(spark, f"{tmp_path}/home", 1).advance(path).groups()
    assert groups.count() <= 256
    assert exactdedup.unequal_keys(docs, groups, 1).count() == groups.where("n > 1").count()


def test_empty_table(spark, tmp_path):
    path = stored(spark, f"{tmp_path}/docs", [])
    assert result(exactdedup.deduplicated(spark, path)) == []


def test_index_takes_later_files_and_forgets_nothing(spark, tmp_path):
    path, home = f"{tmp_path}/docs", f"{tmp_path}/home"
    stored(spark, path, [(5, "a b"), (6, "c"), (7, "d")])
    first = {r.doc_id: r.keep_id for r in exactdedup.deduplicated(spark, path, home).collect()}
    assert first == {5: 5, 6: 6, 7: 7}
    stored(spark, path, [(1, "a  b"), (2, "c"), (3, "e")], mode="append")
    index = exactdedup.Index(spark, home).advance(path)
    assert index.rows().count() == 6 and index.groups().count() == 4
    later = {r.doc_id: (r.keep_id, r.group_size) for r in exactdedup.deduplicated(spark, path, home).collect()}
    assert later == {1: (1, 2), 5: (1, 2), 2: (2, 2), 6: (2, 2), 3: (3, 1), 7: (7, 1)}


def test_kept_documents_are_whole_rows(spark, tmp_path):
    path = stored(spark, f"{tmp_path}/docs", ROWS)
    kept = exactdedup.kept_documents(spark, path)
    assert kept.columns == spark.read.parquet(path).columns
    wanted = sorted((i for i, _, _, k, _ in expected(ROWS) if k), key=repr)
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == wanted
