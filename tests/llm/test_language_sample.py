"""The rows that languages are learnt from, and the model against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import language


@pytest.fixture
def docs(spark):
    ids = [i for i, held in spark.range(700).select("id", (F.crc32(F.col("id").cast("string").cast("binary")) % 5 == 0)).collect() if not held]
    rows = [(i, f"l{n % 230:03}", f"text {i} of {n % 230}") for n, i in enumerate(ids[:460])]
    shared = ids[0]
    rows += [(shared, "l000", f"row {k} of a shared id") for k in range(40)] + [(ids[1], "l001", "the same row")] * 30
    return spark.createDataFrame(rows, "doc_id long, lang string, text string")


def test_every_language_is_learnt_from_a_bounded_sample(docs):
    taken = []
    for n in (7, 3):
        rows = language.sampled(docs.repartition(n), sample=2).collect()
        assert len({r.lang for r in rows}) == 230 and max(r["rank"] for r in rows) == 2
        taken.append(sorted(map(tuple, rows)))
    assert taken[0] == taken[1]
    models = [language.fit(docs.repartition(n), sample=2, landmarks=1) for n in (7, 3)]
    assert len(models[0].languages) == len(models[0].landmarks) == 230
    assert (models[0].landmarks == models[1].landmarks).all() and np.allclose(models[0].weights, models[1].weights)
    assert len(language.fit(docs, sample=2, most_landmarks=5).landmarks) == 230  # one of each at least


def test_equal_rows_leave_enough_others_in_the_sample(spark):
    rows = spark.range(1, 60).select(F.col("id").alias("doc_id"), F.lit("a").alias("lang"), F.concat(F.lit("t"), "id").alias("text"))
    same = spark.range(5000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("a").alias("lang"), F.lit("t1").alias("text"))
    free = language.learnable(rows).count()
    assert language.sampled(rows.unionByName(same), sample=30).count() == min(30, free)


def plain_grams(text):
    """The places of the n-grams of a text, by whole numbers."""
    points, out = [ord(c) for c in text.lower()], set()
    for n in range(1, language.LONGEST + 1):
        for i in range(len(points) - n + 1):
            code = 0
            for p in points[i : i + n]:
                code = (code * 0x110001 + p) % (1 << 64)
            out.add(((code + n) * 0x9E3779B97F4A7C15) % (1 << 64) >> (64 - 14))
    return out


def test_scores_agree_with_plain_ridge_regression(spark):
    rng = np.random.default_rng(8)
    words = {"aa": "alo bela caro deno emi".split(), "bb": "stru kvin blor trach zwi".split(), "cc": "oua ieu aoe uie eau".split()}
    rows = [(i, " ".join(rng.choice(words[lang], 12)), lang) for i, lang in enumerate("aa bb cc".split() * 30)]
    rows += [(1000, None, "aa"), (1001, "42", "bb"), (1002, "İß 😀 a", None), (1003, "alo stru", "cc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    chosen = {(r.lang, r["rank"]): r.id for r in language.sampled(docs, 20).collect()}
    texts = {i: t for i, t, _ in rows}
    learnt = [(lang, plain_grams(texts[i])) for (lang, _), i in sorted(chosen.items())]
    marks = [plain_grams(texts[i]) for (lang, k), i in sorted(chosen.items()) if k <= 5]
    kernel = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    values, vectors = np.linalg.eigh([[kernel(a, b) for b in marks] for a in marks])
    white = vectors / np.sqrt(values)
    z = np.array([[*(np.array([kernel(x, m) for m in marks]) @ white), 1] for _, x in learnt])
    names = sorted({lang for lang, _ in learnt})
    y = np.array([[float(lang == n) for n in names] for lang, _ in learnt])
    w = np.array([len(learnt) / len(names) / sum(other == lang for other, _ in learnt) for lang, _ in learnt])
    penalty = language.RIDGE * len(learnt) * np.eye(z.shape[1])
    penalty[-1, -1] = 0
    weights = np.linalg.solve(z.T @ (w[:, None] * z) + penalty, z.T @ (w[:, None] * y))
    got = {r.doc_id: r for r in language.identify(docs, sample=20, landmarks=5).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        if t is None or not any(map(str.isalpha, t)):
            assert (got[i].lang_pred, got[i].score) == ("und", 0)
            continue
        row = np.array([*(np.array([kernel(plain_grams(t), m) for m in marks]) @ white), 1]) @ weights
        assert got[i].lang_pred == names[row.argmax()] and abs(got[i].score - min(max(row.max(), 0), 1)) < 1e-3
