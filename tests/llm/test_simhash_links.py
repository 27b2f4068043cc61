"""The SimHash links of the near-dedup stage, and keys that hold the same classes."""

from pyspark.sql import functions as F

from docloom.llm import neardup, nearcopies
from tests.llm.test_nearcopies import plain_groups


def test_simhash_links_go_first_and_are_verified(spark, monkeypatch):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join([*words, "end"]), " ".join([*words, "another", "end"]), *(f"a{i} b c d e" for i in range(40)), "a b c d", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    classes = nearcopies.sketches(docs).selectExpr("class", "fp", "n", "keys", "doc_id", "text_hash")
    fps = {r.doc_id: r.fp % 2**64 for r in classes.collect()}
    assert all(fps[i] == neardup.fingerprint(t, 5) for i, t in enumerate(texts))
    of = {r["class"]: r.doc_id for r in classes.collect()}
    pairs = [{of[r.hub], of[r.other]} for r in nearcopies.simhash_pairs(classes).collect()]
    ids = sorted(fps)
    near = [(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 2]
    assert near and {frozenset(g) for g in joined(near)} == {frozenset(g) for g in joined(map(sorted, pairs))}
    asked = []
    monkeypatch.setattr(nearcopies, "links", lambda *a: asked.append(a[1]) or neardup.links(*a))
    stayed = sorted(r.doc_id for r in nearcopies.one_of_each(docs).collect())
    assert asked == [nearcopies.RADIUS] and stayed == [g[0] for g in plain_groups(texts)]


def joined(pairs):
    groups = []
    for pair in pairs:
        meet = [g for g in groups if g & set(pair)]
        groups = [g for g in groups if not g & set(pair)] + [set(pair).union(*meet)]
    return groups


def test_keys_that_hold_the_same_classes_are_one(spark):
    held = {1: [1, 2, 3], 2: [1, 2, 3], 3: [1, 2], 4: [4, 5], 5: [5, 4], 6: [1, 2, 4]}
    rows = spark.createDataFrame([(k, c) for k, cs in held.items() for c in cs], "key long, class long")
    found = nearcopies._unlike_keys(rows).groupBy("key").agg(F.sort_array(F.collect_set("class")).alias("c")).collect()
    assert sorted((r.key, r.c) for r in found) == [(1, [1, 2, 3]), (3, [1, 2]), (4, [4, 5]), (6, [1, 2, 4])]
