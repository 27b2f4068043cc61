"""Language identification by a string kernel, Nyström landmarks and ridge regression.

The kernel of two texts is the blended-spectrum presence kernel: the number of character n-grams,
n from 1 to ``LONGEST``, that both hold, over the root of the product of their numbers, with n-grams
hashed into ``SPACE`` places. A bounded number of texts of each language are landmarks; the kernel
against them, whitened by the landmarks' own kernel matrix, is a text's vector. One-versus-rest
ridge regression over the vectors of a bounded sample gives a value for each language. Scoring is two
matrix products for a batch: presence by landmarks, then by the regression's weights.

At most ``SAMPLE`` rows of each language are learnt from: those with the least hashes. Rows are first
held against a bound on the hash that follows from the number of rows of the language, so that a few
times the sample are ranked, however many rows a language has. ``MOST_LANDMARKS`` is the number of
all landmarks, at most ``LANDMARKS`` and at least one of each language; only they reach the driver.
The normal equations of the regression are added up on the executors, in tasks of a fixed size.

Defined results: null texts and texts without a letter are ``und`` with score zero; null ids count
as empty text for the fold; rows without a language aren't learnt from; with nothing to learn from
all are ``und``; of equal values the language first by name wins; repeated rows get a row each and
are learnt from once; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import broadcast_if_small, crc32_of_id, discard, parts_for, written

LONGEST = 4
SPACE = 1 << 14
UNDETERMINED = "und"
#: Rows of each language that are learnt from, landmarks of each language, and landmarks in all (one for each language at least).
SAMPLE, LANDMARKS, MOST_LANDMARKS = 800, 48, 1536
#: How many times the sample is ranked.
AMPLE = 8
ROWS_A_TASK = 4096
#: Rows of the matrix of normal equations that are added up together.
CHUNK = 64
MOST_BROADCAST = 1_000_000
RIDGE = 1e-3
TEXTS_AT_ONCE = 256
CHARACTERS_AT_ONCE = 1 << 20
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(64 - SPACE.bit_length() + 1)


def presence(text: str, out: np.ndarray) -> None:
    """Marks in ``out`` (SPACE zeros) the n-grams of one whole text in lower case."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    for at in range(0, len(points), CHARACTERS_AT_ONCE):
        part = points[at : at + CHARACTERS_AT_ONCE + LONGEST - 1].astype(np.uint64)
        code = np.zeros(len(part), np.uint64)
        for n in range(1, LONGEST + 1):
            if len(part) < n:
                break
            code = code[: len(part) - n + 1] * np.uint64(0x110001) + part[n - 1 :]
            out[((code + np.uint64(n)) * _FACTOR) >> _SHIFT] = 1


def _presences(texts: list[str | None]) -> np.ndarray:
    rows = np.zeros((len(texts), SPACE), np.float32)
    for row, text in zip(rows, texts, strict=True):
        presence(text or "", row)
    return rows


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows over the root of their numbers of n-grams, so that products of rows are kernel values."""
    return rows / np.sqrt(np.maximum(rows.sum(1, keepdims=True), 1))


@dataclass
class Model:
    """``landmarks``: presence of n-grams as packed bits; ``weights``: of the kernel against each and of a constant, by language."""

    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray

    @functools.cached_property
    def units(self) -> np.ndarray:
        return _unit(_unpacked(self.landmarks))

    def kernel(self, rows: np.ndarray) -> np.ndarray:
        """The kernel of presence rows against the landmarks, and a constant."""
        return np.hstack([_unit(rows) @ self.units.T, np.ones((len(rows), 1), np.float32)])

    def values(self, rows: np.ndarray) -> np.ndarray:
        """A value for each language, around 1 for a text of it and 0 for others."""
        return self.kernel(rows) @ self.weights

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "units"}


def _unpacked(bits: np.ndarray) -> np.ndarray:
    return np.unpackbits(bits, axis=1).astype(np.float32)


def _bits(column: pa.Array | list) -> np.ndarray:
    values = column.to_pylist() if hasattr(column, "to_pylist") else column
    return np.array([np.frombuffer(b, np.uint8) for b in values], np.uint8).reshape(len(values), SPACE // 8)


def solved(languages: list[str], landmarks: np.ndarray, products: np.ndarray, targets: np.ndarray, rows: int, ridge: float = RIDGE) -> Model:
    """The ridge regression with the weighted sums ``products`` of k kT and ``targets`` of k yT over ``rows`` rows, where k are kernel rows.

    Kernel rows are whitened by the landmarks' own kernel matrix; the constant is not penalised.
    """
    units = _unit(_unpacked(landmarks))
    values, vectors = np.linalg.eigh((units @ units.T).astype(float))
    solid = values > 1e-6 * values[-1]
    whiten = np.zeros((len(units) + 1, int(solid.sum()) + 1))
    whiten[:-1, :-1] = vectors[:, solid] / np.sqrt(values[solid])
    whiten[-1, -1] = 1
    penalty = ridge * rows * np.eye(whiten.shape[1])
    penalty[-1, -1] = 0
    weights = np.linalg.solve(whiten.T @ products @ whiten + penalty, whiten.T @ targets)
    return Model(languages, landmarks, (whiten @ weights).astype(np.float32))


def held_out() -> Column:
    return (crc32_of_id("doc_id") % 5) == 0


def learnable(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())


def sampled(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(lang, rank, id, hash): at most ``sample`` rows of each language, those with the least hashes, equal rows once."""
    rows = learnable(docs).select("lang", F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    rows = rows.withColumn("h", F.xxhash64("id", "hash"))
    counts = written(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id", "hash"))

    def first(part: DataFrame) -> DataFrame:
        return part.select("lang", "id", "hash", "h").distinct().withColumn("rank", rank).where(F.col("rank") <= sample).select("lang", "rank", "id", "hash")

    # Hashes lie evenly between -2^63 and 2^63.
    share = (F.col("h") / float(1 << 64) + 0.5) * F.col("n")
    near = rows.join(broadcast_if_small(counts, MOST_BROADCAST), "lang")
    some = written(first(near.where(share <= AMPLE * sample)), "ranked")
    # Where equal rows left too few below the bound, all rows of the language are ranked.
    found = some.groupBy("lang").agg(F.count("*").alias("found"))
    short = counts.join(found, "lang", "left").where((F.col("n") > AMPLE * sample) & (F.coalesce("found", F.lit(0)) < sample)).select("lang")
    short = written(short, "short")
    if not short.head(1):
        return some
    again = first(rows.join(broadcast_if_small(short, MOST_BROADCAST), "lang", "left_semi"))
    return some.join(short, "lang", "left_anti").unionByName(again)


def _presence_table(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(lang, rank, bits) of the rows ``chosen`` (lang, rank, id, hash): the n-grams of their whole texts."""
    some = chosen.select(F.col("lang").alias("of"), "rank", F.col("id").alias("chosen"), F.col("hash").alias("chosen_hash"))
    same = F.col("chosen").eqNullSafe(F.col("doc_id")) & (F.col("of") == F.col("lang")) & (F.col("chosen_hash") == F.xxhash64("text"))
    rows = learnable(docs).select("doc_id", "lang", "text").join(broadcast_if_small(some, MOST_BROADCAST), same).select("lang", "rank", "text")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                bits = np.packbits(_presences(part.column(2).to_pylist()).astype(bool), axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([b.tobytes() for b in bits], pa.binary())], ["lang", "rank", "bits"])

    return rows.mapInArrow(packed, "lang string, rank int, bits binary").dropDuplicates(["lang", "rank"])


def _normal_equations(rows: DataFrame, model: Model, weights: dict[str, float], number: int) -> np.ndarray:
    """The weighted sums of k kT and, in the columns after them, of k yT over ``number`` rows (lang, rank, bits)."""
    shared = rows.sparkSession.sparkContext.broadcast((model, weights))
    width = len(model.landmarks) + 1

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, weights = shared.value
        place = {lang: i for i, lang in enumerate(model.languages)}
        total, any_row = np.zeros((width, width + len(place))), False
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                langs = part.column(0).to_pylist()
                k = model.kernel(_unpacked(_bits(part.column(2)))).astype(float)
                y = np.zeros((len(k), len(place)))
                y[np.arange(len(k)), [place[x] for x in langs]] = 1
                total += (k * np.array([weights[x] for x in langs])[:, None]).T @ np.hstack([k, y])
                any_row = True
        if any_row:
            chunks = [total[i : i + CHUNK].tobytes() for i in range(0, width, CHUNK)]
            task = TaskContext.get().partitionId()
            columns = [pa.array(range(len(chunks)), pa.int32()), pa.array([task] * len(chunks), pa.int32()), pa.array(chunks, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["chunk", "task", "sums"])

    def added(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b.as_py()) for b in group.sort_by("task").column("sums"))
        return pa.table({"chunk": group.column("chunk")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

    tasks = parts_for(number, ROWS_A_TASK)
    spread = rows.repartition(tasks, "lang", "rank").sortWithinPartitions("lang", "rank")
    sums = spread.mapInArrow(summed, "chunk int, task int, sums binary").groupBy("chunk").applyInArrow(added, "chunk int, sums binary")
    found = sorted((r.chunk, bytes(r.sums)) for r in sums.collect())
    return np.concatenate([np.frombuffer(b) for _, b in found]).reshape(width, -1)


def fit(docs: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS, most_landmarks: int = MOST_LANDMARKS) -> Model | None:
    """Learns from at most ``sample`` rows of each language that are not held out; None without any."""
    rows = written(_presence_table(docs, written(sampled(docs, sample), "chosen")), "presence")
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    languages, number = sorted(counts), sum(counts.values())
    each = max(1, min(landmarks, most_landmarks // len(languages)))
    taken = rows.where(F.col("rank") <= each).toPandas().sort_values(["lang", "rank"])
    start = Model(languages, _bits(taken["bits"].tolist()), np.zeros(0))
    # Languages weigh alike, however many rows each has.
    weights = {lang: number / len(languages) / n for lang, n in counts.items()}
    sums = _normal_equations(rows, start, weights, number)
    width = len(start.landmarks) + 1
    discard(rows)
    return solved(languages, start.landmarks, sums[:, :width], sums[:, width:], number)


def identify(docs: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, sample, landmarks))
    source = docs.select("doc_id", "text")
    id_type = source.schema["doc_id"].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                texts = part.column(1).to_pylist()
                has = np.array([any(map(str.isalpha, t or "")) for t in texts])
                langs, scores = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
                if model is not None and has.any():
                    values = model.values(_presences([t for t, h in zip(texts, has, strict=True) if h]))
                    langs[has] = np.array(model.languages, object)[values.argmax(1)]
                    scores[has] = np.clip(values.max(1), 0, 1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs.tolist(), pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    out = source.mapInArrow(scored, f"doc_id {id_type}, lang_pred string, score double")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
