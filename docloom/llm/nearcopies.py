"""Near copies by verified similarity: texts whose sets of five-word shingles have a Jaccard similarity of 4/5 or more.

Each set has a SimHash, the bitwise majority of its shingles, and the sharded BK-trees of ``neardup`` link those within ``RADIUS`` bits; a link
stays if both sets, compared in full, are similar enough. These links go first: what they connect isn't compared again. But
two bits find few of the pairs at 4/5 (they differ in 3 to 11 bits), and BK-trees of so wide a
radius visit most of themselves and can't be sharded. So the other candidates come from MinHash: ``BANDS`` keys of
``ROWS`` minima each; a pair at exactly 4/5 shares no key with a probability of (1 - 0.8 ** 4) ** 24 = 3e-6,
a closer pair with less. These keys only tell which texts have partners at all. Their sets are put in one order, rare shingles
first: of two sets of a similarity of 4/5 or more the first fifths (and one shingle) share a shingle, so only texts that
share one there are compared. That loses no pair, and texts of one source that differ by more than a fifth begin with shingles of
their own. Each set is also marked in ``BITS`` bits: a bit that one set has and the other hasn't is a shingle that they don't share, so
bits bound what two sets share from above, and pairs that can't reach 4/5 aren't made. A link is made only after both sets are compared in full.

Texts with equal sets are one class from the start. Within the classes of one key (such a shingle) some are hubs: all
others that aren't connected to a hub yet are compared with it, then the hub leaves the key. Of keys that hold the same classes one is enough. The
first hubs are the classes whose keys hold the most classes. Rounds end when each key's classes are all connected or all
compared, so no pair is left out. Components are those of all links. Large keys, and hubs with many partners, are
joined by broadcast of a bounded number of narrow rows or of sets of bounded size.

Defined results: words are split at white space and compared without ASCII case; texts under five words
are one shingle; null and empty texts are one class; repeated rows are copies. Sets hold 64-bit hashes,
and a class is known by 64 bits, as texts are by their hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import broadcast_if_small, written
from docloom.llm.neardup import SHINGLES_AT_ONCE as HASHES_AT_ONCE
from docloom.llm.neardup import components, links, majority, stay, with_class

WIDTH = 5
#: The least similarity, as a fraction of whole numbers.
LEAST = (4, 5)
#: Bits in which the SimHash of two linked sets differ at most.
RADIUS = 2
BANDS, ROWS = 24, 4
FACTORS = np.random.default_rng(7).integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) << np.uint64(1) | np.uint64(1)
SHINGLES_AT_ONCE = 1 << 12
SHINGLES_A_BATCH = 1 << 20
MOST_BROADCAST = 1_000_000
MORE_HUBS = 16
#: Bits in which a set is marked.
BITS = 1024
#: Shingles of the sets that come by broadcast, all together.
MOST_HUB_SHINGLES = 4_000_000


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of the shingles of one whole text."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, width = b" ".join(words), min(width, len(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - width + 1].tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts)))


def band_keys(found: np.ndarray) -> list[int]:
    """The keys of a set of shingles, none of an empty one."""
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), SHINGLES_AT_ONCE):
        np.minimum(least, (found[None, at : at + SHINGLES_AT_ONCE] * FACTORS).min(1), out=least)
    return [xxhash.xxh64_intdigest(band.tobytes(), number) for number, band in enumerate(least.reshape(BANDS, ROWS))]


def simhash(found: np.ndarray) -> int:
    """The unsigned SimHash of a set of shingles."""
    return majority(found[at : at + HASHES_AT_ONCE] for at in range(0, len(found), HASHES_AT_ONCE))


def marks(found: np.ndarray) -> np.ndarray:
    """The bits of a set's shingles as signed longs."""
    return np.packbits(np.bincount(found % np.uint64(BITS), minlength=BITS) > 0, bitorder="little").view("<i8")


def may_be_close(size: Column, bits: Column, other_size: Column, other_bits: Column) -> Column:
    """Whether two sets may be similar enough, by their sizes and bits; true for all that are."""

    def alone(x: Column, y: Column) -> Column:
        return reduce(lambda a, b: a + b, [F.bit_count(F.get(x, F.lit(i)).bitwiseAND(F.bitwise_not(F.get(y, F.lit(i))))) for i in range(BITS // 64)])

    most = F.least(size - alone(bits, other_bits), other_size - alone(other_bits, bits))
    return most * sum(LEAST) >= (size + other_size) * LEAST[0]


def sketches(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, text_hash, class, n, fp, keys) of each row: its set's hash, size, SimHash and band keys."""
    source = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    id_type = source.schema["doc_id"].dataType.simpleString()

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, sizes, fps, keys = [], [], [], []
            for text in batch.column(2).to_pylist():
                found = shingles(text, width)
                classes.append(xxhash.xxh64_intdigest(found.tobytes()))
                sizes.append(len(found))
                fps.append(simhash(found))
                keys.append(np.array(band_keys(found), np.uint64).view(np.int64))
            columns = [np.array(classes, np.uint64).view(np.int64), np.array(sizes, np.int64), np.array(fps, np.uint64).view(np.int64)]
            arrays = [*batch.columns[:2], *map(pa.array, columns), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text_hash", "class", "n", "fp", "keys"])

    return source.mapInArrow(sketched, f"doc_id {id_type}, text_hash long, class long, n long, fp long, keys array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, width: int = WIDTH) -> DataFrame:
    """(class, shingles, bits) of ``wanted`` (class, doc_id, text_hash), one row each, computed anew from their texts."""
    keys = broadcast_if_small(written(wanted.select(F.col("doc_id").alias("of"), F.col("text_hash").alias("of_hash")), "wanted"), MOST_BROADCAST)
    same = F.col("of").eqNullSafe(F.col("doc_id")) & (F.col("of_hash") == F.xxhash64("text"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flushed() -> pa.RecordBatch:
            classes = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in held], np.uint64).view(np.int64)
            lists = [pa.array([f(s) for s in held], pa.list_(pa.int64())) for f in (lambda s: s.view(np.int64), marks)]
            return pa.RecordBatch.from_arrays([pa.array(classes), *lists], ["class", "shingles", "bits"])

        for batch in batches:
            held, size = [], 0
            for text in batch.column(0):
                held.append(shingles(text.as_py(), width))
                size += len(held[-1])
                if size >= SHINGLES_A_BATCH:
                    yield flushed()
                    held, size = [], 0
            if held:
                yield flushed()

    found = docs.join(keys, same, "left_semi").select("text").mapInArrow(sets, "class long, shingles array<long>, bits array<long>")
    return found.dropDuplicates(["class"])  # rows equal in id and text


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (hub, other) with ``close``: whether their sets, compared in full, are similar enough."""
    hubs = pairs.groupBy("hub").agg(F.count("*").alias("n")).join(sets.select(F.col("class").alias("hub"), F.col("shingles").alias("x")), "hub")
    hubs = written(hubs, "hub-sets")
    others = pairs.join(sets.select(F.col("class").alias("other"), F.col("shingles").alias("y")), "other")
    both = F.size(F.array_intersect("x", "y"))
    close = both * LEAST[1] >= (F.size("x") + F.size("y") - both) * LEAST[0]
    return with_class(others, hubs, "hub", MOST_HUB_SHINGLES, F.size("x")).select("hub", "other", close.alias("close"))


def prefix_keys(sets: DataFrame) -> DataFrame:
    """(key, class, size): the shingles of each set's prefix that other sets hold too.

    The order is by the number of sets that hold a shingle, then by the shingle. Those that one set holds alone come first and
    lead to no other, so they are only counted.
    """
    rows = sets.select("class", F.size("shingles").alias("size"), F.explode("shingles").alias("key"))
    held = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = with_class(rows, written(held.withColumn("df", F.col("n")), "held"), "key")
    own = shared.groupBy("class", "size").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("shared"))
    prefix = F.col("size") - F.floor((F.col("size") * LEAST[0] + LEAST[1] - 1) / LEAST[1]) + 1
    left = prefix - (F.col("size") - F.size("shared"))
    first = F.slice("shared", F.lit(1), F.greatest(left, F.lit(0)).cast("int"))
    return own.select("class", "size", F.explode(first).alias("s")).select("s.key", "class", "size")


def _first_of_keys(todo: DataFrame, hubs: int) -> DataFrame:
    """(key, n, hub, hub_size, hub_label, hub_bits): the ``hubs`` densest classes of each key, and the key's classes."""
    named = [F.col("class").alias("hub"), F.col("size").alias("hub_size"), F.col("label").alias("hub_label"), F.col("bits").alias("hub_bits")]
    counts = todo.groupBy("key").agg(F.count("*").alias("n"), F.max_by(F.struct(*named), F.struct("density", "class")).alias("h"))
    if hubs == 1:
        return counts.select("key", "n", "h.*")
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("density"), F.desc("class")))
    return todo.withColumn("rank", rank).where(F.col("rank") <= hubs).select("key", *named).join(counts.drop("h"), "key")


def _shared_keys(rows: DataFrame) -> DataFrame:
    """The written ``rows`` (key, class, ...) whose key has several, with ``bucket``: how many."""
    counts = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return with_class(rows, written(counts.withColumn("bucket", F.col("n")), "key-counts"), "key")


def _unlike_keys(shared: DataFrame) -> DataFrame:
    """The written ``shared`` (key, class, ...) with one key of all that hold the same classes."""
    held = [F.bit_xor(F.xxhash64("class", F.lit(i))).alias(f"x{i}") for i in range(2)]
    keys = shared.groupBy("key").agg(F.count("*").alias("n"), *held)
    one = keys.groupBy("n", "x0", "x1").agg(F.min("key").alias("key")).select("key", "n")
    return with_class(shared, written(one, "unlike-keys"), "key")


def _ordered(decided: DataFrame) -> DataFrame:
    return decided.select(F.least("hub", "other").alias("a"), F.greatest("hub", "other").alias("b"), "close")


def _relabelled(rows: DataFrame, found: DataFrame | None) -> DataFrame:
    """``rows`` (key, class, size, density, bits, label) with the labels ``found`` (node, label) where there is one."""
    kept = ["key", "class", "size", "density", "bits"]
    if found is None:
        return rows.select(*kept, "label")
    renamed = found.select(F.col("node").alias("class"), F.col("label").alias("new"))
    return rows.join(renamed, "class", "left").select(*kept, F.coalesce("new", "label").alias("label"))


def _undecided(rows: DataFrame) -> DataFrame:
    """The ``rows`` of keys whose classes aren't all connected."""
    left = written(rows, "left")
    mixed = left.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).where("low <> high").select("key", "n")
    return written(with_class(left, written(mixed, "mixed"), "key"), "buckets")


def simhash_pairs(classes: DataFrame) -> DataFrame:
    """(hub, other): pairs of ``classes`` (class, fp) that connect those whose SimHash differs in ``RADIUS`` bits at most, by BK-trees."""
    fps = written(classes.select("class", "fp"), "fingerprints")
    first = written(fps.groupBy("fp").agg(F.min("class").alias("hub"), F.count("*").alias("n")), "first-of-fp")
    alike = with_class(fps, first, "fp").where("class <> hub").select("hub", F.col("class").alias("other"))
    hubs = first.select("fp", "hub")
    linked = links(first.select("fp"), RADIUS).join(hubs.select(F.col("fp").alias("a"), F.col("hub").alias("other")), "a")
    linked = linked.join(hubs.withColumnRenamed("fp", "b"), "b").select("hub", "other")
    return written(alike.unionByName(linked).distinct(), "simhash-pairs")


def labels(docs: DataFrame, classes: DataFrame, width: int = WIDTH) -> DataFrame | None:
    """(node, label): the linked ones of ``classes`` (class, n, fp, keys, doc_id, text_hash) with their component; None without links."""
    rows = written(classes.select(F.explode("keys").alias("key"), "class"), "keys")
    partners = written(_shared_keys(rows).select("class").distinct(), "partners")
    close_fps = simhash_pairs(classes)
    wanted = written(partners.unionByName(close_fps.select(F.explode(F.array("hub", "other")).alias("class"))).distinct(), "wanted-classes")
    if not wanted.head(1):
        return None
    sets = written(shingle_sets(docs, classes.join(wanted, "class", "left_semi"), width), "sets")
    decided = _ordered(written(verified(close_fps, sets), "verified"))
    found = written(components(decided.where("close").select("a", "b")), "labels") if decided.where("close").head(1) else None
    shared = written(_shared_keys(written(prefix_keys(sets), "prefixes")), "shared")
    shared = written(_unlike_keys(shared), "unlike")
    density = shared.groupBy("class").agg(F.sum("bucket").alias("density"))
    known = density.join(sets.select("class", "bits"), "class")
    todo = _undecided(_relabelled(shared.join(known, "class").withColumn("label", F.col("class")), found))
    hubs = 1
    while todo.head(1):
        first = written(_first_of_keys(todo, hubs), "hubs")
        near = may_be_close(F.col("size"), F.col("bits"), F.col("hub_size"), F.col("hub_bits"))
        met = with_class(todo, first, "key").where((F.col("class") != F.col("hub")) & (F.col("label") != F.col("hub_label")) & near)
        ordered = [F.least("hub", "class").alias("a"), F.greatest("hub", "class").alias("b")]
        pairs = met.select(*ordered, "hub", F.col("class").alias("other")).groupBy("a", "b").agg(F.min(F.struct("hub", "other")).alias("p"))
        pairs = pairs.join(decided, ["a", "b"], "left_anti")
        new = written(verified(written(pairs.select("p.hub", "p.other"), "pairs"), sets), "verified")
        new = _ordered(new)
        decided = decided.unionByName(new)
        if new.where("close").head(1):
            found = written(components(decided.where("close").select("a", "b")), "labels")
        left = todo.join(first.select("key", F.col("hub").alias("class")), ["key", "class"], "left_anti")
        todo = _undecided(_relabelled(left, found))
        hubs *= MORE_HUBS
    return found


def grouped(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, text_hash, anchor): each row of ``docs`` with the class that stands for its component."""
    sketched = written(sketches(docs, width), "sketches")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    # Rows of one class have equal sets, so equal keys.
    classes = sketched.groupBy("class").agg(F.min(F.struct(place.alias("p"), F.col("n").alias("size"), "fp", "keys")).alias("s"), F.count("*").alias("rows"))
    classes = written(classes.select("class", F.col("s.size").alias("n"), "s.fp", "s.keys", "s.p.doc_id", "s.p.text_hash", "rows"), "classes")
    found = labels(docs, classes.drop("rows"), width)
    if found is None:
        return sketched.select("doc_id", "text_hash", F.col("class").alias("anchor"))
    linked = found.select(F.col("node").alias("class"), "label")
    named = classes.select("class", F.col("rows").alias("n")).join(linked, "class", "left").select("class", "n", F.coalesce("label", "class").alias("anchor"))
    return with_class(sketched.select("class", "doc_id", "text_hash"), written(named, "named"), "class").select("doc_id", "text_hash", "anchor")


def one_of_each(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` that stay: of each component that with the smallest id, then text hash, once. Rows without an id come last."""
    return stay(docs, written(grouped(docs, width), "groups"))
