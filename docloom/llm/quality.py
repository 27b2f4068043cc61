r"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Words (``\w+`` in lower case, and runs of other signs) fall into ``BUCKETS`` hash buckets. Each
bucket has a sparse random index vector, and its word vector is the sum of the index vectors of
all its neighbours within ``REACH`` words over every document, scaled to unit length. A document
is the mean and the spread of its words' vectors, the mean index vector of their shapes (letter
case, digits, signs), the share of words whose index vector recurs one and two words on, and the
logarithm of its length. A two-layer network in numpy learns the label from at most ``most_labelled`` labelled documents; a temperature fitted on rows that it
did not learn from calibrates its probabilities.

The sums are one bounded matrix for each task, added up in a tree of small groups.

Defined results: null texts count as empty, and empty texts get the score of a document without
words; null ids count as empty text for the fold; labels without a document or a quality are not
used, and of several labels of one id the largest counts; without labels of both kinds the score
is the share of label 1 (0.5 without any); repeated rows get a row each; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import crc32_of_id, parts_for, unlike, written

BUCKETS, DIMENSIONS, NONZERO, REACH = 1 << 14, 32, 2, 2
SHAPES, SHAPE_DIMENSIONS = 1 << 10, 16
CHUNKS, BRANCHING = 16, 32
TOKENS_AT_ONCE = 64_000
MOST_LABELLED = 20_000
FEATURES = 2 * DIMENSIONS + SHAPE_DIMENSIONS + REACH + 1
_TOKEN = re.compile(r"\w+|[^\w\s]+")


def _shape(token: str) -> str:
    """Case and kind of a word; signs stand for themselves, up to four."""
    if not token[0].isalnum():
        return token[:4]
    if token.isdigit():
        return "9"
    return "X" * (token.upper() == token) + "x" * (token.lower() == token) + ("Xx" if token[:1].upper() == token[:1] else "m")


class Words:
    """(bucket, shape) of each word of a text, kept for the words seen lately."""

    def __init__(self, most: int = 100_000) -> None:
        self.known: dict[str, int] = {}
        self.most = most

    def of(self, text: str | None) -> np.ndarray:
        """bucket * SHAPES + shape of each word."""
        found, known = _TOKEN.findall(text or ""), self.known
        if len(known) > self.most:
            known.clear()
        for word in set(found).difference(known):
            bucket = xxhash.xxh32_intdigest(word.lower().encode()) % BUCKETS
            known[word] = bucket * SHAPES + xxhash.xxh32_intdigest(_shape(word).encode()) % SHAPES
        return np.array([known[w] for w in found], np.int64)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of the nonzero entries of each bucket's index vector; the same everywhere."""
    random = np.random.default_rng(7)
    return random.integers(0, DIMENSIONS, (BUCKETS, NONZERO)), random.choice(np.array([-1, 1], np.int64), (BUCKETS, NONZERO))


def shape_vectors() -> np.ndarray:
    return np.random.default_rng(11).choice(np.array([-1, 1], np.float32), (SHAPES, SHAPE_DIMENSIONS)) / np.float32(SHAPE_DIMENSIONS**0.5)


def _batches_of_words(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray]]:
    """(batch, first row, end row, words, sizes), a bounded number of words at a time."""
    words = Words()
    for batch in batches:
        texts, at = batch.column(column), 0
        while at < len(texts):
            rows, begin, counted = [], at, 0
            while at < len(texts) and counted < TOKENS_AT_ONCE:
                rows.append(words.of(texts[at].as_py()))
                counted += len(rows[-1])
                at += 1
            yield batch, begin, at, np.concatenate(rows), np.array([len(r) for r in rows])


def context_sums(docs: DataFrame) -> DataFrame:
    """(chunk, sums): the context vectors of all buckets over all of ``docs``, in CHUNKS blocks of 64-bit numbers."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        total = np.zeros(BUCKETS * DIMENSIONS)
        for _, _, _, words, sizes in _batches_of_words(batches, 0):
            buckets, owner = words // SHAPES, np.repeat(np.arange(len(sizes)), sizes)
            for reach in range(1, REACH + 1):
                within = owner[reach:] == owner[:-reach]
                left, right = buckets[:-reach][within], buckets[reach:][within]
                for word, neighbour in ((left, right), (right, left)):
                    for k in range(NONZERO):
                        total += np.bincount(word * DIMENSIONS + places[neighbour, k], signs[neighbour, k], len(total))
        blocks = [b.astype("<i8").tobytes() for b in np.array_split(total, CHUNKS)]
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([part] * CHUNKS, pa.int32()), pa.array(blocks, pa.binary())], ["chunk", "part", "sums"])

    def added(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b.as_py(), "<i8") for b in group.column("sums"))
        return pa.table({"chunk": pa.array([group.column("chunk")[0].as_py()], pa.int32()), "part": pa.array([group.column("slot")[0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    schema = "chunk int, part int, sums binary"
    sums = written(docs.select("text").mapInArrow(summed, schema), "context-sums")
    parts = sums.agg(F.coalesce(F.max("part"), F.lit(0)) + 1).first()[0]
    while parts > 1:
        parts = parts_for(parts, BRANCHING)
        sums = sums.withColumn("slot", (F.col("part") / BRANCHING).cast("int")).groupBy("chunk", "slot").applyInArrow(added, schema)
    return sums.select("chunk", "sums")


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The unit context vector of each bucket; a matrix of fixed size."""
    rows = {r.chunk: np.frombuffer(bytes(r.sums), "<i8") for r in context_sums(docs).collect()}
    if not rows:
        return np.zeros((BUCKETS, DIMENSIONS), np.float32)
    total = np.concatenate([rows[c] for c in range(CHUNKS)]).reshape(BUCKETS, DIMENSIONS).astype(float)
    return (total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(words: np.ndarray, sizes: np.ndarray, vectors: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """The features of each document of a run of words."""
    out = np.zeros((len(sizes), FEATURES), np.float32)
    some = sizes > 0
    if some.any():
        starts, n = (np.cumsum(sizes) - sizes)[some], sizes[some, None].astype(np.float32)
        of_words, of_shapes = vectors[words // SHAPES], shapes[words % SHAPES]
        mean = np.add.reduceat(of_words, starts, axis=0) / n
        square = np.add.reduceat(of_words * of_words, starts, axis=0) / n
        spread = np.sqrt(np.maximum(square - mean * mean, 0))
        shape = np.add.reduceat(of_shapes, starts, axis=0) / n
        buckets, owner, again = words // SHAPES, np.repeat(np.arange(len(n)), sizes[some]), []
        for reach in range(1, REACH + 1):
            recurs = np.zeros(len(words), np.float32)
            recurs[: len(words) - reach] = (buckets[reach:] == buckets[:-reach]) & (owner[reach:] == owner[:-reach])
            again.append(np.add.reduceat(recurs, starts)[:, None] / n)
        out[some] = np.hstack([mean, spread, shape, *again, np.log1p(n)])
    return out


@dataclass
class Network:
    """Two layers over standardised features, and the temperature of the result."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.centre) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, batch: int = 128, rate: float = 3e-3, decay: float = 1e-4) -> Network:
    """Adam on the log loss of nine tenths of the rows; the other tenth sets the temperature."""
    x, y = x.astype(float), y.astype(float)
    if len(y) == 0 or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        logit = np.log(max(share, 1e-6) / max(1 - share, 1e-6))
        zero = np.zeros((FEATURES, 1))
        return Network(np.zeros(FEATURES), np.ones(FEATURES), zero, np.zeros(1), np.zeros(1), float(logit))
    random = np.random.default_rng(3)
    order = random.permutation(len(y))
    held = order[: max(1, len(y) // 10)]
    learnt = order[len(held) :] if len(order) > len(held) else order
    centre, scale = x[learnt].mean(0), x[learnt].std(0) + 1e-6
    net = Network(centre, scale, random.normal(0, 1 / FEATURES**0.5, (FEATURES, hidden)), np.zeros(hidden), random.normal(0, 1 / hidden**0.5, hidden), 0.0)
    z = (x - centre) / scale
    weights = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for epoch in range(epochs):
        pace = rate * (1 - epoch / epochs) + 1e-5
        shuffled = random.permutation(learnt)
        for at in range(0, len(shuffled), batch):
            rows = shuffled[at : at + batch]
            h = np.tanh(z[rows] @ weights[0] + weights[1])
            p = 1 / (1 + np.exp(-np.clip(h @ weights[2] + weights[3][0], -40, 40)))
            error = (p - y[rows]) / len(rows)
            back = np.outer(error, weights[2]) * (1 - h * h)
            grads = [z[rows].T @ back + decay * weights[0], back.sum(0), h.T @ error + decay * weights[2], np.array([error.sum()])]
            step += 1
            for w, g, m, v in zip(weights, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = weights[0], weights[1], weights[2], float(weights[3][0])
    logits, target = net.logits(x[held]), y[held]
    temperatures = np.geomspace(0.25, 8, 61)
    losses = [np.logaddexp(0, np.where(target > 0.5, -1, 1) * logits / t).mean() for t in temperatures]
    net.temperature = float(temperatures[int(np.argmin(losses))])
    return net


def held_out() -> Column:
    return (crc32_of_id("doc_id") % 3) == 1


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> tuple[np.ndarray, Network]:
    """(word vectors, network); ``labels``: doc_id and quality, of which held-out rows are never used."""
    vectors = word_vectors(docs)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vectors)
    named = labels.where(F.col("quality").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    named = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled).withColumnRenamed("doc_id", "labelled_id")
    rows = docs.select("doc_id", "text").join(F.broadcast(named), F.col("doc_id") == F.col("labelled_id")).select("quality", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = shape_vectors()
        for batch, begin, end, words, sizes in _batches_of_words(batches, 1):
            x = pooled(words, sizes, shared.value, shapes)
            yield pa.RecordBatch.from_arrays([batch.column(0)[begin:end].cast(pa.float64()), pa.array([v.tobytes() for v in x], pa.binary())], ["y", "x"])

    # At most most_labelled rows of a fixed width, unless ids repeat; then as many again at most.
    sample = rows.mapInArrow(features, "y double, x binary").limit(2 * most_labelled).toPandas()
    sample = sample.sort_values(["y", "x"]).reset_index(drop=True)  # tasks end in any order
    x = np.array([np.frombuffer(v, np.float32) for v in sample["x"]]).reshape(len(sample), FEATURES)
    return vectors, train(x, sample["y"].to_numpy() > 0.5)


def scored(docs: DataFrame, vectors: np.ndarray, network: Network, keep: list[str], name: str = "score") -> DataFrame:
    """The columns ``keep`` of every row of ``docs`` and its score in the column ``name``."""
    shared = docs.sparkSession.sparkContext.broadcast((vectors, network))
    column, places = docs.columns.index("text"), [docs.columns.index(c) for c in keep]
    kept = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (vectors, network), shapes = shared.value, shape_vectors()
        for batch, begin, end, words, sizes in _batches_of_words(batches, column):
            p = network.probabilities(pooled(words, sizes, vectors, shapes))
            yield pa.RecordBatch.from_arrays([batch.column(i)[begin:end] for i in places] + [pa.array(p)], [*keep, name])

    return docs.mapInArrow(score, ", ".join([*kept, f"`{name}` double"]))


def classify(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    vectors, network = fit(docs, labels, most_labelled)
    out = scored(docs.select("doc_id", "text"), vectors, network, ["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject."""
    vectors, network = fit(docs, labels)
    (name,) = unlike(docs, "score")
    return scored(docs, vectors, network, docs.columns, name).where(F.col(name) >= 0.5).drop(name)
