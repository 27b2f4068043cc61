"""SimHash near-deduplication with BK-trees.

A fingerprint is the bitwise majority of the XXH64 hashes of word shingles. Fingerprints that
differ in at most ``radius`` bits are linked and links make components. Equal fingerprints are
one class from the start, so copies never meet in pairs.

Links are found by BK-trees: each child hangs on the edge numbered by its Hamming distance to
the parent, and a query of radius r follows only edges within r of its own distance. A broadcast
tree would have to pass all fingerprints through the driver, and has no bound, so the trees are
sharded and stay on the executors: the 64 bits are cut into radius + 1 fields, and values within
the radius agree on one field at least. Each (field, value) is a shard with its own tree, and each
fingerprint is sent to its radius + 1 shards and looked up there. A shard over ``shard_limit``
fingerprints is cut again by the bits that are still free, by the same argument, until it is small;
so no shard grows with the data and no link is lost.

Components come from alternating stars. Rows are joined with their fingerprint's component by
broadcast for fingerprints of many rows, which are few, and by shuffle for the others.

Defined results: null and empty texts have fingerprint zero and are linked like any other; null
ids take no part in the smallest id of a component (which is null if all its ids are null);
repeated rows give repeated rows; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import broadcast_if_small, discard, parts_for, unlike, written

BITS = 64
SHINGLES_AT_ONCE = 1 << 16
#: Classes of copies that are joined by broadcast at most, and the rows that one of them has at least.
MOST_FREQUENT, LEAST_FREQUENT = 200_000, 64
#: Rows that go, as pairs of numbers, that are broadcast at most.
MOST_GOING = 2_000_000


def majority(parts: Iterable[np.ndarray]) -> int:
    """The bits that over half of the hashes in ``parts`` have; none of no hashes."""
    ones, n = np.zeros(BITS, np.int64), 0
    for hashes in parts:
        bits = np.unpackbits(hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, width: int = 3) -> int:
    """The unsigned 64-bit SimHash of one whole text."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, width = b" ".join(words), min(width, len(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - width + 1].tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    parts = (zip(starts[at : at + SHINGLES_AT_ONCE], stops[at : at + SHINGLES_AT_ONCE], strict=True) for at in range(0, len(starts), SHINGLES_AT_ONCE))
    return majority(np.array([digest(joined[a:b], 42) for a, b in spans], "<u8") for spans in parts)


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp, text_hash) of each row; ``fp`` is the fingerprint as a signed long."""
    source = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    id_type = source.schema["doc_id"].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t, width) for t in batch.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(values.view(np.int64)), batch.column(1)], ["doc_id", "fp", "text_hash"]
            )

    return source.mapInArrow(hashed, f"doc_id {id_type}, fp long, text_hash long")


class BKTree:
    """Values under the edge numbered by their Hamming distance to the parent."""

    def __init__(self, radius: int) -> None:
        self.radius, self.root, self.children = radius, None, {}

    def near(self, value: int) -> Iterator[int]:
        """Values within the radius; only edges that can lead there are followed."""
        radius, children = self.radius, self.children
        todo = [] if self.root is None else [self.root]
        while todo:
            node = todo.pop()
            distance = (node ^ value).bit_count()
            if distance <= radius:
                yield node
            for edge, child in children[node].items():
                if -radius <= edge - distance <= radius:
                    todo.append(child)

    def add(self, value: int) -> None:
        """``value`` must not be in the tree."""
        self.children[value] = {}
        if self.root is None:
            self.root = value
            return
        node = self.root
        while True:
            below = self.children[node]
            edge = (node ^ value).bit_count()
            if edge not in below:
                below[edge] = value
                return
            node = below[edge]


def shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """(value, root) for each value that isn't the root of its component within one shard."""
    tree, parent = BKTree(radius), {}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for value in values:
        parent[value] = value
        for other in tree.near(value):
            a, b = find(value), find(other)
            parent[max(a, b)] = min(a, b)
        tree.add(value)
    return [(x, find(x)) for x in values if parent[x] != x]


def _fields(mask: int, parts: int) -> list[int]:
    """The bits outside ``mask`` in ``parts`` masks of nearly equal size."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    return [sum(1 << i for i in chunk.tolist()) for chunk in np.array_split(np.array(free, int), parts)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def shard_masks(radius: int, depth: int) -> list[dict[int, int]]:
    """For each level, the bits that the shards of each path agree on; path p has children p * (radius + 1) + 1 ..."""
    levels, parts = [{0: 0}], radius + 1
    for _ in range(depth):
        levels.append({p * parts + 1 + i: m | field for p, m in levels[-1].items() for i, field in enumerate(_fields(m, parts))})
    return levels[1:]


def _keys(fp: Column, path: Column, parts: int, masks: dict[int, int]) -> Column:
    """The shards below ``path`` that hold ``fp``: structs of path and the bits agreed on."""
    mask_of = F.create_map(*[F.lit(x) for p, m in masks.items() for x in (p, _signed(m))])
    return F.transform(
        F.array(*[path * parts + 1 + i for i in range(parts)]),
        lambda p: F.struct(p.alias("path"), fp.bitwiseAND(F.element_at(mask_of, p)).alias("agreed")),
    )


def links(fps: DataFrame, radius: int = 2, shard_limit: int = 2000, depth: int = 4) -> DataFrame:
    """(a, b): links that connect the distinct longs ``fp`` of ``fps`` as all links within the radius do."""
    parts, levels = radius + 1, shard_masks(radius, depth)
    todo, ready = fps.select("fp", F.lit(0).alias("path")), []
    for level, masks in enumerate(levels):
        keyed = todo.select("fp", F.explode(_keys(F.col("fp"), F.col("path"), parts, masks)).alias("k")).select("fp", "k.*")
        keyed = written(keyed, "shards")
        if level == depth - 1:
            ready.append(keyed)
            break
        sizes = keyed.groupBy("path", "agreed").count()
        large = written(sizes.where(F.col("count") > shard_limit).drop("count"), "large-shards")
        if not large.head(1):
            ready.append(keyed)
            break
        # At most 1 / shard_limit of the rows: narrow, and adaptive execution broadcasts them while they are small.
        ready.append(keyed.join(large, ["path", "agreed"], "left_anti"))
        todo = keyed.join(large, ["path", "agreed"], "left_semi").select("fp", "path")
    shards = ready[0]
    for more in ready[1:]:
        shards = shards.unionByName(more)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if not held:  # a task without rows
            return
        rows = pa.Table.from_batches(held)
        path, agreed, fp = (rows.column(c).to_numpy() for c in ("path", "agreed", "fp"))
        order = np.lexsort((fp, agreed, path))
        path, agreed, fp = path[order], agreed[order], fp[order].view(np.uint64)
        cuts = np.flatnonzero((path[1:] != path[:-1]) | (agreed[1:] != agreed[:-1])) + 1
        begins, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(fp)]))
        several = ends - begins > 1
        found = []
        for a, b in zip(begins[several].tolist(), ends[several].tolist(), strict=True):
            found += shard_links(fp[a:b].tolist(), radius)
        pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    tasks = parts_for(fps.count() * parts, 200_000)
    tasks = max(tasks, int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return shards.repartition(tasks, "path", "agreed").mapInArrow(linked, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the nodes of ``edges`` (a, b) with one node that stands for their connected component.

    Alternates the large-star and small-star steps, each a group and a join over the edges, until
    the edges are stars. Each round is written, so lineage stays short.
    """

    def stars(pairs: DataFrame) -> DataFrame:
        """Every node's neighbours above it, hung on the smallest neighbour (large star)."""
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        hung = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return hung.where("a <> b").distinct()

    def small(pairs: DataFrame) -> DataFrame:
        """Every node and its neighbours below it, hung on the smallest of these."""
        down = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        hung = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return hung.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()

    def settled(pairs: DataFrame) -> bool:
        """Whether each node hangs on one other that hangs on none."""
        ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))).alias("e")
        nodes = pairs.select(ends).groupBy("e.node").agg(F.sum("e.up").alias("up"), F.min("e.up").alias("least"))
        return not nodes.where("up > 1 OR (up > 0 AND least = 0)").head(1)

    current = written(edges.where("a <> b"), "edges")
    while not settled(current):
        before, current = current, written(small(stars(current)), "stars")
        discard(before)
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)


def frequent(classes: DataFrame, most: int = MOST_FREQUENT, weight: Column | None = None, least: int = LEAST_FREQUENT) -> int:
    """A number of rows such that those of ``classes`` (n: rows of each) that reach it weigh at most ``most`` together; ``least`` or a power of two times that."""
    weight = F.lit(1) if weight is None else weight
    sizes = classes.where(F.col("n") >= least).groupBy(F.floor(F.log2(F.col("n") / least)).cast("int").alias("power")).agg(F.sum(weight).alias("weight"))
    weights, power = {r.power: r.weight for r in sizes.collect()}, 0  # 64 rows at most
    while sum(w for p, w in weights.items() if p >= power) > most:
        power += 1
    return least << power


def with_class(rows: DataFrame, classes: DataFrame, key: str, most: int = MOST_FREQUENT, weight: Column | None = None) -> DataFrame:
    """``rows`` joined with the written table ``classes`` (``key``, n: its rows, ...), so that no key's rows meet in one task.

    Keys with many rows are few and come by broadcast, up to the weight ``most`` together; the others are joined by shuffle.
    """
    bound = frequent(classes, most, weight)
    often, seldom = classes.where(F.col("n") >= bound).drop("n"), classes.where(F.col("n") < bound).drop("n")
    near = rows.join(F.broadcast(often), key)
    return near.unionByName(rows.join(F.broadcast(often.select(key)), key, "left_anti").join(seldom, key))


def grouped(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, text_hash, component_id) of each row of ``docs``."""
    hashed = written(fingerprints(docs, width), "fingerprints")
    classes = written(hashed.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "classes")
    labels = components(links(classes.select("fp"), radius))
    linked = labels.join(classes, labels.node == classes.fp).select("fp", "label", "least")
    least = linked.groupBy("label").agg(F.min("least").alias("reached"))
    reached = linked.join(least, "label").select("fp", "reached")
    ids = classes.join(reached, "fp", "left").select("fp", "n", F.coalesce("reached", "least").alias("component_id"))
    return with_class(hashed, written(ids, "ids"), "fp").select("doc_id", "fp", "text_hash", "component_id")


def one_of_each(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """The rows of ``docs`` that stay: of each component that with the smallest id.

    Ids that several rows share: the row with the smallest text hash, once. Rows without an id form
    components only with each other or below rows with ids, by the same rule.
    """
    anchor = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("fp"), F.col("fp")))
    groups = grouped(docs, width, radius).select("doc_id", "text_hash", "component_id", "fp")
    return stay(docs, written(groups.withColumn("anchor", anchor), "groups"))


def stay(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the smallest id, then text hash, of each ``anchor`` of the written table ``groups`` (doc_id, text_hash, anchor).

    Texts are joined with the rows that go, which are broadcast while there are at most ``MOST_GOING``, so that they stay where they are.
    """
    named = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    first = groups.groupBy("anchor").agg(F.min(named).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = written(first, "first")
    going = with_class(groups, first, "anchor").where(named != F.col("first")).select("doc_id", "text_hash").distinct()
    going_id, going_hash = unlike(docs, "going_id", "going_hash")
    names = [F.col("doc_id").alias(going_id), F.col("text_hash").alias(going_hash)]
    going = written(going.select(*names), "going")
    same = F.col(going_id).eqNullSafe(F.col("doc_id")) & (F.col(going_hash) == F.xxhash64("text"))
    found = docs.join(broadcast_if_small(going, MOST_GOING), same, "left_anti")
    repeats = groups.groupBy("doc_id", "text_hash").count().where("count > 1").select(*names)
    repeats = written(repeats.join(going, [repeats[going_id].eqNullSafe(going[going_id]), repeats[going_hash] == going[going_hash]], "left_anti"), "repeats")
    if not repeats.head(1):
        return found
    again = broadcast_if_small(repeats, MOST_GOING)
    return found.join(again, same, "left_anti").unionByName(found.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))
