"""Near copies against brute force over all pairs."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import nearcopies
from docloom.llm.common import written


def plain_set(text, width=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def plain_groups(texts):
    """Sets of positions: components of pairs with a similarity of 0.8 or more, and of equal sets."""
    sets, parent = [plain_set(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                low, high = sorted((find(i), find(j)))
                parent[high] = low
    groups = {}
    for i in range(len(texts)):
        groups.setdefault(find(i), set()).add(i)
    return sorted(map(sorted, groups.values()))


def planted():
    """Texts with copies of one to many changed words, chains of copies of copies, and families just under the limit."""
    rng = np.random.default_rng(11)
    words, texts = [f"w{i}" for i in range(3000)], [None, " \n", "a b", "A  b", "one two three four five six"]
    for n in (30, 60, 150, 400):
        for _ in range(6):
            base = rng.choice(words, n)
            texts.append(" ".join(base))
            for share in (0.005, 0.01, 0.015, 0.02, 0.025, 0.03, 0.04):
                copy = base.copy()
                copy[rng.choice(n, max(1, round(n * share)), replace=False)] = rng.choice(words, max(1, round(n * share)))
                texts.append(" ".join(copy))
    chain = rng.choice(words, 200)
    for _ in range(12):
        chain = np.concatenate((chain[12:], rng.choice(words, 12)))
        texts.append(" ".join(chain))
    shared = rng.choice(words, 120).tolist()
    return texts + [" ".join([*shared, *rng.choice(words, 40)]) for _ in range(25)]


def test_near_copies_agree_with_brute_force(spark):
    texts = planted()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    groups = {}
    for r in nearcopies.grouped(docs).collect():
        groups.setdefault(r.anchor, set()).add(r.doc_id)
    expected = plain_groups(texts)
    assert len(expected) < len(texts) - 50
    assert sorted(map(sorted, groups.values())) == expected
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()) == [g[0] for g in expected]


def test_odd_rows_of_near_copies(spark):
    rows = [(None, "solo text"), (None, "solo text"), (5, "a b c"), (5, "a b c"), (5, "x"), (None, "A b C"), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(repr, map(tuple, nearcopies.one_of_each(docs).collect()))) == sorted(map(repr, [(None, "solo text"), (5, "a b c"), (5, "x"), (2, "")]))
    assert nearcopies.one_of_each(docs.where("false")).count() == 0


def test_large_group_takes_few_comparisons(spark, monkeypatch):
    base = np.random.default_rng(3).choice([f"v{i}" for i in range(900)], 300)
    texts = [" ".join([*base[:k], "other", *base[k + 1 :]]) for k in range(280)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    compared, plain = [], nearcopies.verified
    monkeypatch.setattr(nearcopies, "verified", lambda pairs, sets: compared.append((p := written(pairs, "pairs")).count()) or plain(p, sets))
    assert nearcopies.grouped(docs).agg(F.countDistinct("anchor")).first()[0] == 1
    assert sum(compared) < 280 * 25


def test_copies_that_only_their_source_is_close_to_take_few_comparisons(spark, monkeypatch):
    rng = np.random.default_rng(6)
    words = [f"u{i}" for i in range(5000)]
    base = rng.choice(words, 300)
    texts = [" ".join(base)]
    for _ in range(200):
        copy = base.copy()
        copy[rng.choice(300, 6, replace=False)] = rng.choice(words, 6)
        texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    compared, plain = [], nearcopies.verified
    monkeypatch.setattr(nearcopies, "verified", lambda pairs, sets: compared.append(pairs.count()) or plain(pairs, sets))
    groups = {}
    for r in nearcopies.grouped(docs).collect():
        groups.setdefault(r.anchor, set()).add(r.doc_id)
    assert sorted(map(sorted, groups.values())) == plain_groups(texts)
    assert sum(compared) < 201 * 12, compared


def test_bits_rule_out_no_close_pair(spark):
    rng = np.random.default_rng(11)
    rows, close = [], []
    for n in (1, 2, 5, 40, 300, 5000):
        for _ in range(30):
            a = rng.integers(0, 1 << 63, n, np.uint64)
            b = np.unique(np.concatenate((a[: rng.integers(0, n + 1)], rng.integers(0, 1 << 63, rng.integers(0, n // 3 + 1), np.uint64))))
            a = np.unique(a)
            both = len(np.intersect1d(a, b))
            close.append(both * 5 >= (len(a) + len(b) - both) * 4)
            rows.append((len(rows), len(a), nearcopies.marks(a).tolist(), len(b), nearcopies.marks(b).tolist()))
    table = spark.createDataFrame(rows, "i int, n long, x array<long>, m long, y array<long>")
    may = [r.may for r in table.select("i", nearcopies.may_be_close(*map(F.col, ("n", "x", "m", "y"))).alias("may")).orderBy("i").collect()]
    assert all(m or not c for m, c in zip(may, close, strict=True)) and sum(close) > 20
    assert sum(may) < 0.8 * len(may)
