"""The pipeline's stages, each on what the one before kept, against plain Python."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import quality
from docloom.llm.common import table, written
from tests.llm.test_nearcopies import plain_groups
from tests.llm.test_operators import plain_dedup, plainly_held


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_stages_in_turn(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, docs, sf_dir), name)
        kept[name] = (docs, after)
        if name != "packing":
            assert after.columns == columns
        docs = after

    before, after = kept["quality"]
    labels = dict(rows(table(spark, sf_dir, "labels"), "doc_id", "quality"))
    assert set(rows(after, *columns)) <= set(rows(before, *columns))
    stayed = {i for (i,) in rows(after, "doc_id")}
    assert np.mean([(i in stayed) == bool(labels[i]) for (i,) in rows(before, "doc_id") if labels.get(i) is not None]) > 0.95

    before, after = kept["line_dedup"]
    texts = rows(before, "doc_id", "text")
    plain = plain_dedup(texts)
    assert Counter(rows(after, "doc_id", "text")) == Counter((i, plain[i, t]) for i, t in texts)
    assert all(n == len(t) for n, t in rows(after, "n_chars", "text"))

    before, after = kept["near_dedup"]
    texts = sorted(rows(before, "doc_id", "text"))
    assert sorted(i for (i,) in rows(after, "doc_id")) == [texts[g[0]][0] for g in plain_groups([t for _, t in texts])]

    before, after = kept["decontamination"]
    items = [t for (t,) in rows(table(spark, sf_dir, "benchmark"), "text")]
    words = [set(t.lower().split()) for t in items]

    def clean(text):
        own = set(text.lower().split())
        return not any(len(own & w) >= min(8, len(w)) and plainly_held(t, text) for t, w in zip(items, words, strict=True))

    assert sorted(rows(after, "doc_id", "text")) == sorted((i, t) for i, t in rows(before, "doc_id", "text") if clean(t))

    before, after = kept["packing"]
    assert {i for (i,) in rows(after, "doc_id")} == {i for (i,) in rows(before, "doc_id")}


def test_run_gives_the_last_stage(spark, sf_dir):
    assert set(corpus_pipeline.run(spark, sf_dir).columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}


NAMES = ("score", "starts", "lines_removed", "LINES_TOTAL", "covered_id", "kept_id", "going_id", "held_id", "held_hash", "n", "class", "anchor", "fp", "key", "slot")


@pytest.fixture
def odd(spark, sf_dir):
    """Documents with nulls, empty and very long texts, repeated rows and ids, and columns of names used inside."""
    some = table(spark, sf_dir, "documents").limit(40)
    more = [(None, "no id", None, None, None), (None, "no id", None, None, None), (7_000_001, None, "en", "s", 0), (7_000_002, "", "en", "s", 0), (7_000_003, "word " * 300_000, "en", "s", 1_500_000), (7_000_004, "twice the same id", "en", "s", 17), (7_000_004, "and another text of it", "en", "s", 22), (7_000_004, "and another text of it", "en", "s", 22)]
    docs = some.unionByName(spark.createDataFrame(more, some.schema))
    return docs.select("*", *[F.lit(i).alias(name) for i, name in enumerate(NAMES)])


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES, ids=lambda x: x if isinstance(x, str) else "")
def test_odd_rows_pass_each_stage(spark, sf_dir, odd, name, stage):
    after = stage(spark, odd, sf_dir)
    if name == "packing":
        assert {i for (i,) in rows(after, "doc_id")} == {i for (i,) in rows(odd, "doc_id")}
        assert after.where("piece = 0").count() == odd.count()
    else:
        assert after.columns == odd.columns
        before, left = Counter(rows(odd, "doc_id", "text")), Counter(rows(after, "doc_id", "text"))
        if name == "line_dedup":
            assert after.count() == odd.count() and all(left[k] == n for k, n in before.items() if k[0] is None or k[0] > 7_000_000)
        else:
            assert not left - before
        if name == "near_dedup":
            assert max(left.values()) == 1 and {(None, "no id"), (7_000_004, "twice the same id"), (7_000_004, "and another text of it")} <= set(left)
        if name == "decontamination":
            assert all(left[k] == n for k, n in before.items() if k[0] is None or k[0] > 7_000_000)
    assert stage(spark, odd.where("false"), sf_dir).count() == 0


def test_quality_stage_keeps_what_the_scores_say(spark, sf_dir, odd):
    labels = table(spark, sf_dir, "labels")
    scores = {(r.doc_id, r.text): r.mark for r in quality.scored(odd, *quality.fit(odd, labels), ["doc_id", "text"], "mark").collect()}
    left = {(r.doc_id, r.text) for r in corpus_pipeline.quality_stage(spark, odd, sf_dir).collect()}
    assert left == {k for k, score in scores.items() if score >= 0.5}
