"""Replies at any depth."""

from docloom.operators import annots


def test_replies_at_any_depth_and_in_cycles(spark):
    notes = spark.createDataFrame([("a", i, i - 1) for i in range(2, 42)] + [("b", 1, 2), ("b", 2, 1), ("b", 9, None), ("c", 1, None)], "doc_id string, id int, reply_to int")
    found = annots.with_replies(notes, spark.createDataFrame([("a", 1), ("b", 1)], "doc_id string, id int")).collect()
    assert sorted(map(tuple, found)) == [("a", i) for i in range(1, 42)] + [("b", 1), ("b", 2)]
