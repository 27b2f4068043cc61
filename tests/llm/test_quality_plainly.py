"""The quality classifier's vectors and scores against plain loops."""

import re
import zlib

import numpy as np
import xxhash

from docloom.llm import quality


def plain_words(text):
    """(bucket, shape number) of each word."""
    return [(xxhash.xxh32_intdigest(w.lower().encode()) % quality.BUCKETS, xxhash.xxh32_intdigest(quality._shape(w).encode()) % quality.SHAPES) for w in re.findall(r"\w+|[^\w\s]+", text or "")]


def plain_vectors(texts):
    places, signs = quality.index_vectors()
    sums = {}
    for text in texts:
        words = [b for b, _ in plain_words(text)]
        for i, word in enumerate(words):
            own = sums.setdefault(word, np.zeros(quality.DIMENSIONS))
            for j in range(max(0, i - quality.REACH), min(len(words), i + quality.REACH + 1)):
                if j != i:
                    for place, sign in zip(places[words[j]], signs[words[j]], strict=True):
                        own[place] += sign
    return {b: v / max(np.linalg.norm(v), 1e-9) for b, v in sums.items()}


def plain_features(text, vectors):
    words = plain_words(text)
    if not words:
        return np.zeros(quality.FEATURES)
    shapes = quality.shape_vectors()
    rows = np.array([vectors[b] for b, _ in words])
    again = [np.mean([i + reach < len(words) and words[i][0] == words[i + reach][0] for i in range(len(words))]) for reach in (1, 2)]
    return np.hstack([rows.mean(0), rows.std(0), np.array([shapes[s] for _, s in words]).mean(0), again, np.log1p(len(words))])


def test_scores_agree_with_plain_loops(spark):
    rng = np.random.default_rng(12)
    good, bad = "the river ran along quiet fields and nobody spoke of it".split(), "BUY now!!! $$$ click click 99 free".split()
    texts = [(i, " ".join(rng.choice(good if i % 2 else bad, 25))) for i in range(60)] + [(60, None), (61, ""), (62, "é ß 好 ?!"), (63, "again again again")]
    marks = {i: i % 2 for i in range(60)}
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame(list(marks.items()), "doc_id long, quality int")
    vectors, network = quality.fit(docs, labels)
    plain = plain_vectors([t for _, t in texts])
    for bucket, vector in plain.items():
        assert np.allclose(vectors[bucket], vector, atol=1e-6)
    got = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    assert len(got) == len(texts)
    for i, t in texts:
        z = (plain_features(t, plain) - network.centre) / network.scale
        logit = float(np.tanh(z @ network.w1 + network.b1) @ network.w2 + network.b2)
        expected = 1 / (1 + np.exp(-np.clip(logit / network.temperature, -40, 40)))
        assert abs(got[i] - expected) < 1e-3, i
    held = [i for i in marks if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all((got[i] >= 0.5) == bool(marks[i]) for i in held)
