"""Merkle manifest of a dataset: a tree for each group of rows, a tree over the groups, and each row's proof.

Each row is a leaf, the SHA-256 of its fields. Leaves of a group ascend by id; while several nodes remain,
every two consecutive ones (one, at the end of an odd run) become their hash. The roots of the groups, in
their order, become one root in the same way. Digests are hashed as lowercase hexadecimal text.

The upper tree is broadcast. Leaves get their position by ranges (``ranks.positions``), and each aligned block of
``2 ** BLOCK_LEVELS`` leaves is reduced to one node by one task, and so are blocks of such nodes, until at most
``MOST_TOP`` nodes of all groups are left. The driver builds the tree over these and broadcasts the path from each to
the root; executors go down again, hand each block the path of its root, and finish the proofs within
the block, where each row is folded from its leaf to the root. Groups may be as many as rows:
once each is one node, the list of groups is cut in blocks itself.

Defined results: a null id comes first in its group and is never tampered with; ids that repeat are
ordered by their leaf, and rows equal in all fields have places of their own; a null group is the first; a null field is
``-`` and differs from an empty one; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import broadcast_if_small, written
from docloom.llm.ranks import positions

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels that one task reduces, so 4096 leaves; nodes of the tree that the driver builds; paths that are broadcast at most.
BLOCK_LEVELS, MOST_TOP, MOST_PATHS = 12, 4096, 8192
#: One step of a path: where the sibling stands, then its digest (32 bytes).
NONE, LEFT, RIGHT = b"\0", b"\1", b"\2"
STEP = 33
TAMPER_EVERY = 7


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(fields: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(f) for f in fields]), 256))


def tampered_fields(names: tuple[str, ...] = FIELDS) -> list[Column]:
    """The fields after a change that the proofs must find: one more character counted."""
    return [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in names]


def parents(nodes: list[bytes]) -> list[bytes]:
    return [hashlib.sha256(b"".join(nodes[i : i + 2])).hexdigest().encode() for i in range(0, len(nodes), 2)]


def levels_of(nodes: list[bytes], most: int | None = None) -> list[list[bytes]]:
    """The nodes and what they become, level by level, up to one node or ``most`` levels."""
    levels = [nodes]
    while len(levels[-1]) > 1 if most is None else len(levels) <= most:
        levels.append(parents(levels[-1]))
    return levels


def paths(levels: list[list[bytes]], above: bytes) -> list[bytes]:
    """The path of each node of the lowest level: its steps within ``levels``, then those ``above``."""
    found = [above] * len(levels[-1])
    for level in reversed(levels[:-1]):
        steps = []
        for i in range(len(level)):
            if i % 2:
                step = LEFT + bytes.fromhex(level[i - 1].decode())
            elif i + 1 < len(level):
                step = RIGHT + bytes.fromhex(level[i + 1].decode())
            else:
                step = NONE + bytes(STEP - 1)
            steps.append(step + found[i // 2])
        found = steps
    return found


def folded(leaf: bytes, steps: list[tuple[int, bytes]]) -> bytes:
    """The root that a leaf and its path give."""
    for side, sibling in steps:
        whole = sibling + leaf if side == LEFT[0] else leaf + sibling if side == RIGHT[0] else leaf
        leaf = hashlib.sha256(whole).hexdigest().encode()
    return leaf


def steps_of(path: bytes) -> list[tuple[int, bytes]]:
    """(side, sibling as text) of each step; an empty sibling where there is none."""
    return [(path[i], path[i + 1 : i + STEP].hex().encode() if path[i] else b"") for i in range(0, len(path), STEP)]


def height(nodes: int) -> int:
    return (nodes - 1).bit_length()


def _blocks(nodes: DataFrame, item: list[str]) -> DataFrame:
    """(tree, n, block, items) of ``nodes`` (tree, n, pos, ...); the items of a block stand in order."""
    block = F.floor(F.col("pos") / (1 << BLOCK_LEVELS)).cast("long")
    grouped = nodes.groupBy("tree", "n", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", *item))).alias("items"))
    return written(grouped, "merkle-blocks")


def _hexed(values: pa.Array) -> list[bytes]:
    return [v.hex().encode() for v in values.to_pylist()]


def _roots(blocks: DataFrame) -> DataFrame:
    """(tree, n, pos, node) of the blocks, as the nodes of the next round."""

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for at, n in enumerate(batch.column("n").to_pylist()):
                nodes = _hexed(batch.column("items")[at].values.field("node"))
                found.append(bytes.fromhex(levels_of(nodes, min(BLOCK_LEVELS, height(n)))[-1][0].decode()))
            left = [-(-n // (1 << BLOCK_LEVELS)) for n in batch.column("n").to_pylist()]
            columns = [batch.column("tree"), pa.array(left, pa.int64()), batch.column("block"), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["tree", "n", "pos", "node"])

    return written(blocks.mapInArrow(reduced, "tree long, n long, pos long, node binary"), "merkle-nodes")


def _lower(blocks: DataFrame, roots: bool) -> DataFrame:
    """(tree, pos, path, subroot) of the nodes below ``blocks`` (tree, block, path, subroot, items with below_tree, below_pos); ``roots``: they are roots of groups."""

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in enumerate(batch.column("n").to_pylist()):
                items = batch.column("items")[at].values
                nodes, subroot = items.field("node"), batch.column("subroot")[at].as_py()
                found = paths(levels_of(_hexed(nodes), min(BLOCK_LEVELS, height(n))), batch.column("path")[at].as_py())
                subroots = nodes if roots else pa.array([subroot] * len(found), pa.binary())
                columns = [items.field("below_tree"), items.field("below_pos"), pa.array(found, pa.binary()), subroots]
                yield pa.RecordBatch.from_arrays(columns, ["tree", "pos", "path", "subroot"])

    return blocks.mapInArrow(walked, "tree long, pos long, path binary, subroot binary")


def _with_paths(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """Each block with the path of its root."""
    return blocks.join(broadcast_if_small(found.withColumnRenamed("pos", "block"), MOST_PATHS), ["tree", "block"])


def upper_tree(nodes: list[tuple[int, int, bytes]], one_tree: bool) -> tuple[bytes, list[tuple[int, int, bytes, bytes | None]]]:
    """The root, and (tree, pos, path, subroot) of each of the bounded number of ``nodes`` (tree, pos, digest)."""
    trees = [(tree, [(pos, node.hex().encode()) for _, pos, node in rows]) for tree, rows in groupby(sorted(nodes), key=lambda r: r[0])]
    grown = [(tree, [pos for pos, _ in rows], levels_of([node for _, node in rows])) for tree, rows in trees]
    over = levels_of([levels[-1][0] for _, _, levels in grown])
    found = []
    for (tree, at, levels), above in zip(grown, paths(over, b""), strict=True):
        subroot = None if one_tree else bytes.fromhex(levels[-1][0].decode())
        found += [(tree, pos, path, subroot) for pos, path in zip(at, paths(levels, above), strict=True)]
    return over[-1][0], found


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", order: str = "doc_id", tampered: Column | None = None) -> DataFrame:
    """Each row's id, leaf, subroot, root, path (steps of a side byte and a digest) and, of its own or its ``tampered`` leaf, folded_root and verified."""
    spark = docs.sparkSession
    changed = F.lit(None).cast("binary") if tampered is None else tampered
    named = [F.col(order).alias("doc_id"), F.col(group).alias("group"), leaf_of([F.col(c) for c in fields]).alias("node"), changed.alias("changed")]
    leaves = written(docs.select(*named).withColumn("row", F.monotonically_increasing_id()), "leaves")
    id_type = leaves.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, leaf string, subroot string, root string, path binary, folded_root string, verified boolean"
    if not leaves.head(1):
        return spark.createDataFrame([], schema)
    rounds = [_blocks(positions(leaves, ["group"], ["doc_id", "node", "row"]), ["doc_id", "node", "changed"])]
    nodes, one_tree, over = _roots(rounds[0]), False, 0
    while nodes.count() > MOST_TOP:
        below = nodes.select("tree", "n", "pos", "node", F.col("tree").alias("below_tree"), F.col("pos").alias("below_pos"))
        if not one_tree and not nodes.where("n > 1").head(1):
            below, one_tree, over = positions(below.drop("n", "pos").withColumnRenamed("tree", "of"), [], ["of"]), True, len(rounds)
        rounds.append(_blocks(below, ["node", "below_tree", "below_pos"]))
        nodes = _roots(rounds[-1])
    # At most MOST_TOP rows of four numbers and a digest.
    root, top = upper_tree([(r.tree, r.pos, bytes(r.node)) for r in nodes.collect()], one_tree)
    found = spark.createDataFrame(top, "tree long, pos long, path binary, subroot binary")
    for number in range(len(rounds) - 1, 0, -1):
        found = written(_lower(_with_paths(rounds[number], found), one_tree and number == over), "merkle-paths")

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in enumerate(batch.column("n").to_pylist()):
                items, above = batch.column("items")[at].values, batch.column("path")[at].as_py()
                leaves = _hexed(items.field("node"))
                subroot = batch.column("subroot")[at].as_py()
                proofs = paths(levels_of(leaves, min(BLOCK_LEVELS, height(n))), above)
                changed = items.field("changed").to_pylist()
                ends = [folded(leaf if c is None else c.hex().encode(), steps_of(p)) for leaf, c, p in zip(leaves, changed, proofs, strict=True)]
                many = len(leaves)
                columns = [
                    items.field("doc_id"), pa.array([x.decode() for x in leaves]), pa.array([subroot.hex()] * many), pa.array([root.decode()] * many),
                    pa.array(proofs, pa.binary()), pa.array([x.decode() for x in ends]), pa.array([x == root for x in ends]),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "leaf", "subroot", "root", "path", "folded_root", "verified"])

    return _with_paths(rounds[0], found).mapInArrow(finished, schema)


def document_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of documents, with every seventh row (by the CRC-32 of its id) tampered with after it was made."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER_EVERY == 0
    return manifest(docs, tampered=F.when(chosen, leaf_of(tampered_fields())))


def digest(found: DataFrame) -> DataFrame:
    """The manifest with the digest of each proof's siblings instead of the path."""
    step = F.expr(f"transform(sequence(0, length(path) - {STEP}, {STEP}), i -> substring(path, i + 1, {STEP}))")
    siblings = F.transform(F.when(F.length("path") > 0, step).otherwise(F.array()), lambda s: F.when(F.substring(s, 1, 1) == F.lit(NONE), "").otherwise(F.lower(F.hex(F.substring(s, 2, STEP - 1)))))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join(siblings, ""), 256).alias("proof_sha256"), "folded_root", "verified")


#: The tree as lists of digests for each level; CRC-32 is folded over the bytes of an id's digits.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, *, CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END
      || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
      || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS a,
    CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS z,
    list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT for x in string_split(CAST(doc_id AS VARCHAR), '')]),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END)) AS crc
  FROM documents),
e AS (SELECT *, sha256(a || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END || z) AS leaf,
    CASE WHEN xor(crc, 4294967295::BIGINT) % 7 = 0 THEN sha256(a || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1) END || z) END AS changed
  FROM d),
l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS pos FROM e),
t AS (
  SELECT lang, 0 AS level, list(leaf ORDER BY pos) AS h FROM l GROUP BY lang
  UNION ALL
  SELECT lang, level + 1, [sha256(h[2 * i + 1] || coalesce(h[2 * i + 2], '')) for i in range((len(h) + 1) // 2)] FROM t WHERE len(h) > 1),
s AS (SELECT lang, h[1] AS subroot, level AS levels FROM t WHERE len(h) = 1),
u AS (
  SELECT 0 AS level, list(subroot ORDER BY lang NULLS FIRST) AS h FROM s
  UNION ALL
  SELECT level + 1, [sha256(h[2 * i + 1] || coalesce(h[2 * i + 2], '')) for i in range((len(h) + 1) // 2)] FROM u WHERE len(h) > 1),
g AS (SELECT lang, subroot, levels, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS at FROM s),
p AS (
  SELECT l.r, t.level AS level, (l.pos >> t.level)::BIGINT AS i, t.h[xor((l.pos >> t.level)::BIGINT, 1) + 1] AS sib
  FROM l JOIN t ON l.lang IS NOT DISTINCT FROM t.lang WHERE len(t.h) > 1
  UNION ALL
  SELECT l.r, g.levels + u.level, (g.at >> u.level)::BIGINT, u.h[xor((g.at >> u.level)::BIGINT, 1) + 1]
  FROM l JOIN g ON l.lang IS NOT DISTINCT FROM g.lang JOIN u ON len(u.h) > 1),
q AS (SELECT r, list({'i': i, 'sib': coalesce(sib, '')} ORDER BY level) AS steps FROM p GROUP BY r),
f AS (SELECT l.doc_id, l.leaf, g.subroot, (SELECT h[1] FROM u WHERE len(h) = 1) AS root, coalesce(q.steps, []) AS steps, coalesce(l.changed, l.leaf) AS start
  FROM l JOIN g ON l.lang IS NOT DISTINCT FROM g.lang LEFT JOIN q ON l.r = q.r),
v AS (SELECT doc_id, leaf, subroot, root, sha256(array_to_string([x.sib for x in steps], '')) AS proof_sha256,
  list_reduce(list_prepend({'i': 0::BIGINT, 'sib': start}, steps), lambda a, x: {'i': 0::BIGINT, 'sib': sha256(CASE WHEN x.i % 2 = 1 THEN x.sib || a.sib ELSE a.sib || x.sib END)}).sib AS folded_root FROM f)
SELECT *, folded_root = root AS verified FROM v
"""
