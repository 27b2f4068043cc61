"""Benchmark items without an id."""

import numpy as np

from docloom.llm import decontaminate


def test_item_without_an_id_is_searched(spark):
    rng = np.random.default_rng(2)
    item, other, noise = (" ".join(rng.choice([f"{c}{i}" for i in range(300)], 30)) for c in "ion")
    docs = spark.createDataFrame([(1, f"{noise} {item}"), (2, f"{other} {noise}"), (3, noise)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(None, item), (2**60 + 1, other), (None, other)], "item_id long, text string")
    found = {(r.doc_id, r.item_id, r.agreeing) for r in decontaminate.overlaps(docs, benchmark).collect()}
    assert found == {(1, None, 30), (2, 2**60 + 1, 30)}
    assert [r.doc_id for r in decontaminate.decontaminate(docs, benchmark).collect()] == [3]
