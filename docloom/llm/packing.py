"""Best-fit packing of token pieces into sequences, certified by lower bounds.

A document is its token ids and one id that ends it. Documents over the capacity are cut into
pieces of the capacity, the first piece taking the remainder. Pieces are dealt out to groups of a
bounded size and each group is packed by best-fit decreasing in one task. Dual-feasible functions
give a lower bound of the group's bins; a group that meets its bound is certified. Then groups with
a gap, and the slack bins of certified groups, exchange their pieces: they are pooled, dealt out
anew and packed again, and the new packing is taken if it has fewer bins. Rounds end when nothing
is pooled or gained; each one but the last saves a bin, so they end.

Only piece numbers and lengths travel in the rounds; the ids stay where they were written.

Defined results: null and empty texts are the ending id alone; repeated rows are packed each for
itself; null ids are kept; an empty table gives no rows; of other columns only ``doc_id`` is kept.
"""

from __future__ import annotations

import functools
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import discard, parts_for, written

CAPACITY = 2048
END_ID = 0
#: Pieces packed together in one task.
GROUP = 50_000
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Texts of these characters alone are split alike by both libraries; others go to ``tokenizers``.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa0-ɏ‐-‧]*")
#: A run of white space this long goes to ``tokenizers`` too: the faster library overflows its stack on long ones.
LONG_BLANK = re.compile(r"\s{1000}")


@functools.cache
def _reference(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def _fast(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str, tokenizer: str = TOKENIZER, ranks: str | None = RANKS) -> list[int]:
    """The ids of ``tokenizers`` without added special tokens; by the rank file of the same vocabulary where both agree."""
    if ranks and PLAIN.fullmatch(text) and "<|" not in text and not LONG_BLANK.search(text):
        return _fast(ranks).encode_ordinary(text)
    return _reference(tokenizer).encode(text, add_special_tokens=False).ids


def cut(length: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of a document."""
    first = length % capacity or capacity
    yield 0, first
    for start in range(first, length, capacity):
        yield start, capacity


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, ranks: str | None = RANKS, with_ids: bool = False) -> DataFrame:
    """doc_id, slot (a number of its own for each piece), piece, start, length, ids_crc32 and, if asked for, ids.

    Slots follow the task and the row, so the frame must be written before it is used twice.
    """
    source = docs.select("doc_id", "text")
    id_type = source.schema["doc_id"].dataType.simpleString()

    def tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = TaskContext.get().partitionId() << 36
        for batch in batches:
            row, piece, starts, lengths, crcs, kept = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = np.array(token_ids(text or "", tokenizer, ranks) + [END_ID], "<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    part = ids[start : start + length]
                    row.append(i)
                    piece.append(k)
                    starts.append(start)
                    lengths.append(length)
                    crcs.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        kept.append(part.astype(np.int32))
            columns = [
                batch.column(0).take(pa.array(row, pa.int64())),
                pa.array(np.arange(slot, slot + len(row))),
                pa.array(piece, pa.int32()),
                pa.array(starts, pa.int64()),
                pa.array(lengths, pa.int64()),
                pa.array(crcs, pa.int64()),
            ]
            slot += len(row)
            names = ["doc_id", "slot", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {id_type}, slot long, piece int, start long, length long, ids_crc32 long"
    return source.mapInArrow(tokenized, schema + ", ids array<int>" * with_ids)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The largest lower bound of the bins that the dual-feasible functions give.

    The functions: the identity; for each cut-off, long pieces count whole and short ones nothing;
    for each k, multiples of capacity / (k + 1) count as they are and others are rounded down to 1 / k.
    """
    counts = np.bincount(lengths, minlength=capacity + 1)
    number, total = np.cumsum(counts), np.cumsum(counts * np.arange(capacity + 1))
    cuts = np.arange(1, capacity // 2 + 1)
    whole = number[capacity] - number[capacity - cuts]
    between = total[capacity - cuts] - total[cuts - 1]
    best = max(-(-int(total[-1]) // capacity), int((whole - (-between // capacity)).max()))
    sizes = np.arange(capacity + 1)
    for k in range(1, 21):
        scaled = sizes * (k + 1)
        # In units of capacity * k, so that all is whole numbers.
        value = np.where(scaled % capacity == 0, sizes * k, scaled // capacity * capacity)
        best = max(best, -(-int((counts * value).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each piece and the room left in each bin. A bit for each room tells whether some bin has it."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    left: list[int] = []
    some = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        fitting = some >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                some &= ~(1 << room)
        else:
            room, b = capacity, len(left)
            left.append(capacity)
        bins[i], offsets[i] = b, capacity - room
        left[b] = room - length
        if left[b]:
            rooms[left[b]].append(b)
            some |= 1 << left[b]
    return bins, offsets, np.array(left, np.int64)


PACKED = "slot long, length long, sequence_id long, offset long, room long, certified boolean"


def _packed_groups(items: DataFrame, number: int, groups: int, capacity: int) -> DataFrame:
    """One round: deals ``items`` (slot, length) out to ``groups`` groups and packs each."""

    def packed(group: pa.Table) -> pa.Table:
        slots, lengths = group.column("slot").to_numpy(), group.column("length").to_numpy()
        order = np.argsort(slots)  # rows come in any order
        slots, lengths = slots[order], lengths[order]
        bins, offsets, room = best_fit_decreasing(lengths, capacity)
        first = number << 48 | int(group.column("dealt")[0].as_py()) << 24
        met = len(room) == lower_bound(lengths, capacity)
        columns = [slots, lengths, first + bins, offsets, room[bins], np.full(len(slots), met)]
        return pa.table([pa.array(c) for c in columns], names=["slot", "length", "sequence_id", "offset", "room", "certified"])

    dealt = items.withColumn("dealt", F.pmod(F.xxhash64("slot", F.lit(number)), F.lit(groups)))
    return dealt.groupBy("dealt").applyInArrow(packed, PACKED)


def pack(items: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """(slot, sequence_id, offset) of each piece of the written table ``items`` (slot, length)."""
    items = items.select("slot", "length")
    packed = written(_packed_groups(items, 0, parts_for(items.count(), group), capacity), "packed")
    for number in itertools.count(1):
        pooled = ~F.col("certified") | (F.col("room") >= capacity // 4)
        pool, rest = packed.where(pooled), packed.where(~pooled)
        size, before = pool.agg(F.count("*"), F.count(F.when(F.col("offset") == 0, 1))).first()
        if before < 2:
            break
        again = written(_packed_groups(pool.select("slot", "length"), number, parts_for(size, group), capacity), "repacked")
        if again.where("offset = 0").count() >= before:
            break
        before_it, packed = packed, written(rest.unionByName(again), "packed")
        discard(before_it)
        discard(again)
    return packed.select("slot", "sequence_id", "offset")


def packed_pieces(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Every piece of ``docs`` with its sequence and its place there."""
    cut_up = written(pieces(docs, capacity, with_ids=with_ids), "pieces")
    return cut_up.join(pack(cut_up, capacity), "slot").drop("slot")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the sequences themselves, of the result of ``packed_pieces(..., with_ids=True)``."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.transform("parts", lambda p: p.ids)).alias("ids"))
