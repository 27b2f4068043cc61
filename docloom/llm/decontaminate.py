r"""Benchmark decontamination by spaced-seed hashing.

Texts are lower-case word tokens (``\w+``, by one function for items and documents). A mask picks
some of the tokens in a short span and ignores the others, so a substituted word under an ignored
place leaves the hash alone. Every masked span of the test items and of the training documents is
hashed; equal hashes are a hit and fix how item and document lie against each other. Around the
hits the overlap is then verified token by token: a document holds an item if ``WINDOW``
consecutive tokens of it (all of a shorter item) agree in at least ``SIMILARITY`` of the places.
The two masks hit every such window: no choice of two substitutions among 13 tokens escapes both
(tested in full). Items of 8 to 12 tokens have contiguous masks of their own with the same
guarantee; items of fewer tokens must agree in full, so their mask is the whole item and the first
place of a document is enough.

A document has one row for each hash, with all its places, and so has an item, so the join of test
and training hashes never lists pairs of places. The shifts between both lists of places are found
in the task that verifies them, by a product of their spectra where the lists are long, which is
nearly linear in both texts.

Test hashes are joined, not broadcast, beyond ``MOST_HASHES``. To keep training hashes that meet no
test hash from being shuffled, tasks first look them up in a bit table of fixed size
(``FILTER_BITS``), whatever the size of the benchmark.

Defined results: null and empty texts hold nothing, and items without a token are held by nothing;
items with equal tokens are one, known by the smallest id; rows equal in id and text are reported
once and removed together; null ids are kept, of items too; empty tables give no rows; other
columns pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import broadcast_if_small, discard, unlike, written

WINDOW = 13
SIMILARITY = 0.8
MASKS = ((0, 1, 2, 5, 7, 8), (0, 2, 3, 4, 6, 7))
#: Items of fewer tokens must agree in full.
INEXACT = 8
#: For items of so many tokens up to the next bound: (least tokens, mask). Below INEXACT the whole item.
SHORT_MASKS = (*((n, tuple(range(n))) for n in range(1, INEXACT)), (INEXACT, (0, 1, 2, 3)), (10, (0, 1, 2)))
FILTER_BITS = 1 << 24
MOST_BROADCAST = 2_000_000
MOST_HASHES = 500_000
#: Lists of places whose product is larger are compared by their spectra.
MOST_DIFFERENCES = 1 << 16
#: Parts that the items hit by one document are dealt out to, so that they never are one value.
ITEM_PARTS = 16
SHIFTS_AT_ONCE = 1 << 20
TOKENS_AT_ONCE = 128_000
_MULTIPLIERS = np.array([xxhash.xxh64_intdigest(b"place %d" % i) | 1 for i in range(32)], np.uint64)
_WORD = re.compile(r"\w+")


def tokens_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class TokenHashes:
    """64-bit hashes of tokens, kept for the tokens seen lately."""

    def __init__(self, most: int = 100_000) -> None:
        self.known: dict[str, int] = {}
        self.most = most

    def of(self, text: str | None) -> np.ndarray:
        known, words = self.known, tokens_of(text)
        if len(known) > self.most:
            known.clear()
        for word in set(words).difference(known):
            known[word] = xxhash.xxh64_intdigest(word.encode())
        return np.array([known[w] for w in words], np.uint64)


def mask(number: int) -> tuple[int, ...]:
    return MASKS[number] if number < len(MASKS) else SHORT_MASKS[number - len(MASKS)][1]


def masks_of(length: int) -> list[tuple[int, tuple[int, ...]]]:
    """(number, mask) for an item of so many tokens."""
    if length >= WINDOW:
        return list(enumerate(MASKS))
    short = [(len(MASKS) + i, mask) for i, (least, mask) in enumerate(SHORT_MASKS) if length >= least]
    return short[-1:]


def is_whole(number: int) -> bool:
    """Whether a mask covers all of its items."""
    return len(MASKS) <= number < len(MASKS) + INEXACT - 1


def masked_hashes(tokens: np.ndarray, number: int, mask: tuple[int, ...]) -> np.ndarray:
    """The hash of each span of ``tokens`` under a mask, by its first place."""
    n = len(tokens) - mask[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, _MULTIPLIERS[len(_MULTIPLIERS) - 1 - number])
    for place, at in enumerate(mask):
        total += tokens[at : at + n] * _MULTIPLIERS[place]
        total ^= total >> np.uint64(29)
    return total * _MULTIPLIERS[7]


def places_of(h: np.ndarray, owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
    """(h, owner, places): equal hashes of one owner with their places in order."""
    order = np.lexsort((place, h, owner))
    h, owner, place = h[order], owner[order], place[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    cuts = np.flatnonzero(new)
    lists = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(h)).astype(np.int32)), pa.array(place.astype(np.int32)))
    return h[cuts], owner[cuts], lists


def least_agreeing(length: int) -> tuple[int, int]:
    """(window, tokens that must agree in it) for an item of so many tokens."""
    window = min(WINDOW, length)
    return window, window if window < 8 else -int(-SIMILARITY * window // 1)


def shifts(places: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The distinct differences of two sorted lists of places."""
    if len(places) * len(at) <= MOST_DIFFERENCES:
        return np.unique(np.subtract.outer(places, at))
    first, last = int(places[0]) - int(at[-1]), int(places[-1]) - int(at[0])
    size = 1 << (last - first).bit_length() + 1
    one, other = np.zeros(size), np.zeros(size)
    one[places - places[0]] = 1
    other[at[-1] - at] = 1
    met = np.fft.irfft(np.fft.rfft(one) * np.fft.rfft(other), size)
    return np.flatnonzero(met[: last - first + 1] > 0.5) + first


def agreement(item: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[int, int]:
    """(tokens that agree, first of them in ``doc``) at the best of the shifts ``at``, the first of equals; zero if no window is close enough.

    Under a shift item token i lies on document token i + shift.
    """
    n, (window, least) = len(item), least_agreeing(len(item))
    padded = np.concatenate((np.zeros(n, doc.dtype), doc, np.zeros(n, doc.dtype)))
    inside = np.concatenate((np.zeros(n, bool), np.ones(len(doc), bool), np.zeros(n, bool)))
    best = (0, 0)
    step = max(1, SHIFTS_AT_ONCE // max(1, n))
    for begin in range(0, len(at), step):
        part = at[begin : begin + step]
        rows = part[:, None] + np.arange(n, 2 * n)[None, :]
        same, there = (padded[rows] == item[None, :]) & inside[rows], np.cumsum(inside[rows], axis=1, dtype=np.int32)
        sums = np.cumsum(same, axis=1, dtype=np.int32)
        zero = np.zeros((len(part), 1), np.int32)
        sums, there = np.hstack((zero, sums)), np.hstack((zero, there))
        whole = there[:, window:] - there[:, :-window] == window
        close = ((sums[:, window:] - sums[:, :-window] >= least) & whole).any(axis=1)
        agreeing = np.where(close, sums[:, -1], 0)
        i = int(agreeing.argmax())
        if agreeing[i] > best[0]:
            best = int(agreeing[i]), int(np.argmax(same[i])) + int(part[i])
            if best[0] == n:
                break
    return best


def _classes(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, text): one row for the items with equal tokens, known by the tokens' hash; the smallest id, null if none has one."""
    source = benchmark.select("item_id", "text")
    id_type = source.schema["item_id"].dataType.simpleString()

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [tokens_of(t) for t in batch.column(1).to_pylist()]
            same = [hashlib.sha256(" ".join(t).encode()).hexdigest() if t else None for t in tokens]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(same, pa.string())], ["item_id", "text", "same"])

    found = source.mapInArrow(keyed, f"item_id {id_type}, text string, same string").where("same IS NOT NULL")
    first = F.min(F.struct(F.col("item_id").isNull().alias("last"), "item_id", "text")).alias("first")
    return found.groupBy("same").agg(first).select(F.xxhash64("same").alias("item"), "first.item_id", "first.text")


def test_hashes(items: DataFrame) -> DataFrame:
    """(h, item, mask, at): the masked hashes of the items (item, text) with all their places."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = TokenHashes()
        for batch in batches:
            for item, text in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                tokens = hashes.of(text)
                for number, places in masks_of(len(tokens)):
                    h = masked_hashes(tokens, number, places)
                    h, owner, at = places_of(h, np.zeros(len(h), np.int64), np.arange(len(h)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h.view(np.int64)), pa.array([item.as_py()] * len(h), pa.int64()), pa.array([number] * len(h), pa.int32()), at], ["h", "item", "mask", "at"]
                    )

    return items.select("item", "text").mapInArrow(hashed, "h long, item long, mask int, at array<int>")


def training_hits(docs: DataFrame, test: DataFrame) -> DataFrame:
    """(doc_id, text_hash, item, places, at): the hashes that documents and test items share, with their places in both."""
    bits = test.select(F.pmod("h", F.lit(FILTER_BITS)).cast("int").alias("bit")).distinct().toPandas()["bit"].to_numpy()
    table = np.zeros(FILTER_BITS, bool)
    table[bits] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(table, bitorder="little"))
    # Only the masks that some item has; there are no more than the constants above.
    masks = [(number, mask(number)) for number in sorted(r.mask for r in test.select("mask").distinct().collect())]
    source = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    id_type = source.schema["doc_id"].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bits = TokenHashes(), shared.value
        for batch in batches:
            texts, at = batch.column(2), 0
            while at < len(texts):
                rows, counted = [], 0
                while at < len(texts) and counted < TOKENS_AT_ONCE:
                    rows.append(hashes.of(texts[at].as_py()))
                    counted += len(rows[-1])
                    at += 1
                sizes = np.array([len(r) for r in rows])
                tokens, ends = np.concatenate(rows), np.cumsum(sizes)
                owner = np.repeat(np.arange(len(rows)), sizes)
                for number, places in masks:
                    h = masked_hashes(tokens, number, places)
                    bit = h.view(np.int64) & (FILTER_BITS - 1)
                    held = np.flatnonzero(bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
                    held = held[held + places[-1] < ends[owner[held]]]
                    found, doc, lists = places_of(h[held], owner[held], held - (ends - sizes)[owner[held]])
                    if is_whole(number):
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1, dtype=np.int32)), lists.values.take(lists.offsets[:-1]))
                    row = pa.array(doc + (at - len(rows)))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(row), batch.column(1).take(row), pa.array(found.view(np.int64)), lists], ["doc_id", "text_hash", "h", "places"]
                    )

    seen = source.mapInArrow(hashed, f"doc_id {id_type}, text_hash long, h long, places array<int>")
    return seen.join(broadcast_if_small(test.drop("mask"), MOST_HASHES), "h").select("doc_id", "text_hash", "item", "places", "at")


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_hash, item_id, agreeing, doc_token): the verified overlaps, one row for each document and item."""
    items = written(_classes(benchmark), "items")
    test = written(test_hashes(items), "test-hashes")
    hits = training_hits(docs, test).groupBy("doc_id", "text_hash", "item").agg(F.collect_set(F.struct("places", "at")).alias("met"))
    texts_of_items = items.select("item", F.col("text").alias("item_text"))
    by_doc = hits.join(broadcast_if_small(texts_of_items, MOST_BROADCAST // 100), "item")
    by_doc = by_doc.groupBy("doc_id", "text_hash", F.pmod("item", F.lit(ITEM_PARTS)).alias("part")).agg(F.collect_list(F.struct("item", "item_text", "met")).alias("found"))
    by_doc = written(by_doc.select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"), "found"), "hits")
    discard(test)
    source = docs.select("doc_id", "text")
    same = F.col("hit_id").eqNullSafe(F.col("doc_id")) & (F.col("hit_hash") == F.xxhash64("text"))
    keys = broadcast_if_small(by_doc.select("hit_id", "hit_hash"), MOST_BROADCAST)
    texts = source.join(keys, same, "left_semi").dropDuplicates(["doc_id", "text"])
    due = texts.join(by_doc, same).select("doc_id", "hit_hash", "text", "found")
    id_type = due.schema["doc_id"].dataType.simpleString()

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = TokenHashes()
        for batch in batches:
            row, rest = [], []
            for i in range(batch.num_rows):
                doc = hashes.of(batch.column(2)[i].as_py())
                for hit in batch.column(3)[i].as_py():
                    item = hashes.of(hit["item_text"])
                    at = np.unique(np.concatenate([shifts(np.array(m["places"]), np.array(m["at"])) for m in hit["met"]]))
                    agreeing, doc_token = agreement(item, doc, at)
                    if agreeing:
                        row.append(i)
                        rest.append((hit["item"], agreeing, doc_token))
            took = pa.array(row, pa.int64())
            columns = [pa.array([r[k] for r in rest], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(took), batch.column(1).take(took), *columns], ["doc_id", "text_hash", "item", "agreeing", "doc_token"])

    found = due.mapInArrow(verified, f"doc_id {id_type}, text_hash long, item long, agreeing long, doc_token long")
    ids = broadcast_if_small(items.select("item", "item_id"), MOST_BROADCAST)
    return found.join(ids, "item").select("doc_id", "text_hash", "item_id", "agreeing", "doc_token")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item."""
    held_id, held_hash = unlike(docs, "held_id", "held_hash")
    held = overlaps(docs, benchmark).select(F.col("doc_id").alias(held_id), F.col("text_hash").alias(held_hash)).distinct()
    held = broadcast_if_small(written(held, "contaminated"), MOST_BROADCAST)
    return docs.join(held, F.col(held_id).eqNullSafe(F.col("doc_id")) & (F.col(held_hash) == F.xxhash64("text")), "left_anti")
