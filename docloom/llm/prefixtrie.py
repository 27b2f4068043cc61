"""A trie of the turns that conversations begin with in common, and what sharing them saves.

Turns are known by 128 bits of the SHA-256 of role and text, and ordered by ``ranks.positions``, so the turns of one
conversation may be most of the table. Sums of hashes of turn and depth, taken over a conversation's turns up to
each one, name the sequence of first turns that it ends (its prefix).

Conversations of the same whole sequence are one class, known by its smallest id, before anything is
grouped. Classes are dealt by the digest of their first turn; where more than ``MOST_CLASSES`` of them share it, they are
dealt again by the next turn, and so on, and the node that they share becomes an upper node. Several such
subtries make a bucket, for which ``applyInPandas`` builds a trie of pointers: a dictionary for each node leads from the digest
of a turn to the child. Children are numbered after their parents, so one pass from the last node to the first is a
postorder without recursion. The facts of upper nodes are added up from their children, a level at a time.

The turns of a long conversation (over ``LONG``) that no other class shares don't branch: the first of them stays in the trie
and the facts of the others follow from the sums. Turns that several long conversations share stand in one task, narrow.

Defined results: rows without conv_id take no part; null role and text are empty; null turns come first; turns with equal
numbers are ordered by their digest; repeated rows are turns of their own; a table without conversations gives no
rows; other columns are not read. The ids that end at a node are hashed as one text, which only one task can do: where they
are over ``MANY``, they stream through it in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import broadcast_if_small, parts_for, written
from docloom.llm.neardup import with_class
from docloom.llm.ranks import positions

#: Every conversation takes turns from the first of its family of so many ids, fewer than so many turns.
FAMILY, MOST_TAKEN = 20, 4
#: Classes that one subtrie has at most before it is cut, turns of a bucket, turns of a long conversation, ids hashed in one row.
MOST_CLASSES, BUCKET_TURNS, LONG, MANY = 256, 20_000, 10_000, 10_000
MOST_BROADCAST = 500_000
WORD = r"[^\x20\x09-\x0D]+"
ROOT = b""
FACTS = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, n, digest, words): every turn, in order from 0, without its text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    narrow = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.substring(F.unhex(F.sha2(whole, 256)), 1, 16).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    narrow = written(narrow.withColumn("row", F.monotonically_increasing_id()), "turns")
    return written(positions(narrow, ["conv_id"], ["turn", "digest", "row"]).select("conv_id", "pos", "n", "digest", "words"), "ordered-turns")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, length) of all conversations, and (conv_id, depth, digest, words) of the turns they get: the first h of their family's first, then their own from h."""
    convs = turns.where("pos = 0").select(
        "conv_id", "n", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_TAKEN).alias("h")
    )
    first = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < MOST_TAKEN - 1))
    heads = first.select(F.col("conv_id").alias("base"), "pos", "digest", "words")
    held = first.where("pos = 0").select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(held, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = written(convs.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "conversations")
    given = convs.join(heads, "base").where(F.col("pos") < F.col("h")).select("conv_id", (F.col("pos") + 1).alias("depth"), "digest", "words")
    own = with_class(turns.drop("n"), convs.select("conv_id", "n", "h", "taken"), "conv_id").where(F.col("pos") >= F.col("h"))
    own = own.select("conv_id", (F.col("taken") + F.col("pos") - F.col("h") + 1).alias("depth"), "digest", "words")
    return convs.select("conv_id", "length"), given.unionByName(own)


def with_prefixes(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, depth, digest, words) with their conversation's ``length``, ``prefix`` (16 bytes) and the words up to each turn."""
    both = [F.xxhash64("digest", "depth"), F.xxhash64("digest", "depth", F.lit("second"))]
    lanes = [half for x in both for half in (x.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(x, 32))]
    named = rows.select("*", *[lane.alias(f"lane{i}") for i, lane in enumerate(lanes)])
    sums = {f"sum{i}": f"lane{i}" for i in range(len(lanes))}
    found = positions(written(named, "rebuilt"), ["conv_id"], ["depth"], sums | {"words_upto": "words"})
    prefix = F.substring(F.unhex(F.sha2(F.concat_ws(",", "depth", *sums), 256)), 1, 16)
    return found.select("conv_id", "depth", "digest", "words", "words_upto", F.col("n").alias("length"), prefix.alias("prefix"))


def _ends_of(members: DataFrame, classes: DataFrame) -> DataFrame:
    """(prefix, ends): SHA-256 of the ids of each class, ascending and joined by commas."""
    sized = with_class(members, classes.select("prefix", "n", F.col("n").alias("many")), "prefix")
    few = sized.where(F.col("many") <= MANY).groupBy("prefix").agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    few = few.select("prefix", F.unhex(F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)).alias("ends"))
    large = sized.where(F.col("many") > MANY)
    if not classes.where(F.col("n") > MANY).head(1):
        return few

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for prefix, ids in groupby(rows, key=lambda r: r[0]):
            digest, comma = hashlib.sha256(), ""
            for _, conv_id in ids:
                digest.update(f"{comma}{conv_id}".encode())
                comma = ","
            yield pa.RecordBatch.from_arrays([pa.array([prefix], pa.binary()), pa.array([digest.digest()], pa.binary())], ["prefix", "ends"])

    ordered = large.select("prefix", "conv_id").repartition("prefix").sortWithinPartitions("prefix", "conv_id")
    return few.unionByName(ordered.mapInArrow(streamed, "prefix binary, ends binary"))


def classes_of(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, prefix, n, length, total, ends) of each distinct whole sequence, by its smallest conv_id."""
    last = turns.where("depth = length").select("conv_id", "prefix", "length", F.col("words_upto").alias("total"))
    none = convs.where("length = 0").select("conv_id", F.lit(ROOT).alias("prefix"), "length", F.lit(0).cast("long").alias("total"))
    members = written(last.unionByName(none), "members")
    classes = written(members.groupBy("prefix", "length", "total").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n")), "classes")
    return written(classes.join(_ends_of(members.select("prefix", "conv_id"), classes), "prefix"), "classes-with-ends")


def cut_tails(turns: DataFrame, classes: DataFrame) -> DataFrame:
    """``classes`` with ``within``: how many of their turns the trie takes; the others belong to no other class."""
    if not classes.where(F.col("length") > LONG).head(1):
        return classes.withColumn("within", F.col("length"))
    lone = turns.groupBy("prefix").agg(F.count("*").alias("held"), F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"))
    lone = lone.where("held = 1").groupBy("conv_id").agg(F.min("depth").alias("lone"))
    within = F.when(F.col("length") > LONG, F.coalesce("lone", "length")).otherwise(F.col("length"))
    return written(classes.join(lone, "conv_id", "left").withColumn("within", within).drop("lone"), "cut-classes")


def dealt(turns: DataFrame, classes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(conv_id, cell, cell_depth, above): the subtrie of each class; and, for each level from the root, its upper nodes.

    Upper nodes: prefix, above (the parent's prefix) and the facts that don't depend on children.
    """
    def node(rows: DataFrame, depth: int) -> DataFrame:
        ending = F.min(F.when(F.col("length") == depth, F.col("ends")))  # one class ends at a node at most
        return rows.groupBy("prefix", "above").agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.max("words").alias("words"), ending.alias("ends"))

    facts = classes.select("conv_id", "n", "length", "ends")
    start = facts.select("*", F.lit(ROOT).alias("prefix"), F.lit(b"-").alias("above"), F.lit(0).cast("long").alias("words"))
    uppers, cells, depth = [written(node(start, 0), "upper-nodes")], None, 0
    left = start
    while True:
        depth += 1
        step = turns.where(F.col("depth") == depth).select("conv_id", F.col("prefix").alias("next"), F.col("words").alias("next_words"))
        left = left.where(F.col("length") >= depth).join(step, "conv_id")
        left = left.select("conv_id", "n", "length", "ends", F.col("next").alias("prefix"), F.col("prefix").alias("above"), F.col("next_words").alias("words"))
        left = written(left, "classes-left")
        large = left.groupBy("prefix").agg(F.count("*").alias("classes")).where(F.col("classes") > MOST_CLASSES).select("prefix")
        large = broadcast_if_small(written(large, "large-subtries"), MOST_BROADCAST)
        small = left.join(large, "prefix", "left_anti").select("conv_id", F.col("prefix").alias("cell"), F.lit(depth).cast("long").alias("cell_depth"), "above")
        cells = small if cells is None else cells.unionByName(small)
        left = left.join(large, "prefix", "left_semi")
        if not left.head(1):
            return written(cells, "cells"), uppers
        uppers.append(written(node(left, depth), "upper-nodes"))


def grown(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes of the subtries of one bucket; a pointer trie of each, then one pass from the children to their parents."""
    rows = rows.sort_values(["cell", "conv_id", "depth"])
    tops, children, parent, above = {}, [], [], []
    conv, depths, convs, own, below, leaves, ends = [], [], [], [], [], [], []
    node, before = -1, None
    names = ["cell", "conv_id", "depth", "digest", "words", "n", "ends", "tail", "tail_words", "above"]
    for cell, conv_id, depth, digest, words, n, end, tail, tail_words, over in zip(*(rows[c].tolist() for c in names), strict=True):
        fresh, before = (cell, conv_id) != before, (cell, conv_id)
        pointers, key = (tops, cell) if fresh else (children[node], digest)
        up, node = -1 if fresh else node, pointers.get(key, -1)
        if node < 0:
            node = pointers[key] = len(parent)
            children.append({})
            parent.append(up)
            above.append(over if fresh else None)
            conv.append(conv_id)
            depths.append(depth)
            convs.append(0)
            own.append(words)
            below.append(0)
            leaves.append(0)
            ends.append(None)
        convs[node] += n
        conv[node] = min(conv[node], conv_id)
        if end is not None:
            ends[node] = end
        if tail:
            leaves[node], below[node] = 1, (n - 1) * tail_words
    counts = [len(c) for c in children]
    for i in range(len(parent) - 1, -1, -1):
        leaves[i] = leaves[i] or (1 if not counts[i] else 0)
        below[i] += (convs[i] - 1) * own[i]
        if parent[i] >= 0:
            leaves[parent[i]] += leaves[i]
            below[parent[i]] += below[i]
    tails = {i for i in range(len(parent)) if not counts[i] and ends[i] is None}
    return pd.DataFrame({
        "conv_id": conv, "depth": depths, "n_convs": convs, "n_children": [1 if i in tails else c for i, c in enumerate(counts)],
        "n_leaves": leaves, "saved_tokens": below, "ends": ends, "parent_conv_id": pd.array([conv[p] if p >= 0 else None for p in parent], "Int64"), "above": above,
    })


def nodes(conversations: DataFrame) -> DataFrame:
    """Every node of the trie: FACTS (``ends``: the digest of the ids that end there, null for none) and parent_conv_id."""
    spark = conversations.sparkSession
    convs, rows = rebuilt(turns_of(conversations))
    turns = written(with_prefixes(rows), "prefixes")
    classes = classes_of(convs, turns)
    schema = "conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends binary, parent_conv_id long"
    if not classes.head(1):
        return spark.createDataFrame([], schema)
    named = classes.select("conv_id", F.col("length").alias("rows"), "n", "total", "ends")
    turns = with_class(turns, named.select("conv_id", F.col("rows").alias("n"), F.col("n").alias("same"), "total", "ends"), "conv_id")
    turns = written(turns.withColumn("ends", F.when(F.col("depth") == F.col("length"), F.col("ends"))), "class-turns")
    classes = cut_tails(turns, classes)
    cells, uppers = dealt(turns, classes)

    # The subtries, some in a bucket.
    in_trie = classes.select("conv_id", F.col("within").alias("n"), "within").join(cells, "conv_id")
    in_trie = with_class(turns, written(in_trie, "in-trie"), "conv_id").where((F.col("depth") >= F.col("cell_depth")) & (F.col("depth") <= F.col("within")))
    rest = F.col("total") - F.col("words_upto")
    tail = (F.col("depth") == F.col("within")) & (F.col("within") < F.col("length"))
    given = in_trie.select("cell", "conv_id", "depth", "digest", "words", F.col("same").alias("n"), "ends", tail.alias("tail"), rest.alias("tail_words"), "above")
    buckets = max(parts_for(turns.count(), BUCKET_TURNS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    given = given.withColumn("bucket", F.pmod(F.xxhash64("cell"), F.lit(buckets)))
    built = given.groupBy("bucket").applyInPandas(grown, schema + ", above binary")
    built = written(built, "subtries")

    # Upper nodes, from the lowest level to the root.
    def summed(children: DataFrame) -> DataFrame:
        return children.groupBy("above").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below")).withColumnRenamed("above", "prefix")

    tops = built.where("above IS NOT NULL").select("above", "n_leaves", "saved_tokens", "depth")
    found, over = None, None
    for depth in range(len(uppers) - 1, -1, -1):
        children = tops.where(F.col("depth") == depth + 1).drop("depth")
        children = children if over is None else children.unionByName(over.select("above", "n_leaves", "saved_tokens"))
        own = (F.col("n_convs") - 1) * F.col("words") + F.coalesce("below", F.lit(0))
        level = uppers[depth].join(summed(children), "prefix", "left").select(
            "prefix", "above", "conv_id", F.lit(depth).cast("long").alias("depth"), "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
            F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), own.alias("saved_tokens"), "ends",
        )
        over = written(level, "upper-level")
        found = over if found is None else found.unionByName(over)
    found = written(found, "upper")

    parents = found.select(F.col("prefix").alias("above"), F.col("n_children").alias("n"), F.col("conv_id").alias("parent_conv_id"))
    lower = built.where("above IS NOT NULL").drop("parent_conv_id").unionByName(found.where("depth > 0").drop("prefix"))
    hung = with_class(lower, written(parents, "parents"), "above").select(*FACTS, "parent_conv_id")
    root = found.where("depth = 0").select(*FACTS, F.lit(None).cast("long").alias("parent_conv_id"))
    inner = built.where("above IS NULL").select(*FACTS, "parent_conv_id")
    tails = with_class(turns, classes.where("within < length").select("conv_id", F.col("length").alias("n"), "within"), "conv_id").where(F.col("depth") > F.col("within"))
    chain = tails.select(
        "conv_id", "depth", F.col("same").alias("n_convs"), F.when(F.col("depth") < F.col("length"), 1).otherwise(0).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), ((F.col("same") - 1) * (rest + F.col("words"))).alias("saved_tokens"), "ends", F.col("conv_id").alias("parent_conv_id"),
    )
    return hung.unionByName(root).unionByName(inner).unionByName(chain)


def digest(found: DataFrame) -> DataFrame:
    ends: Column = F.coalesce(F.lower(F.hex("ends")), F.sha2(F.lit(""), 256))
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends.alias("ends_sha256"))


ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id AS c, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS g, turn,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w
  FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT c, list({'g': g, 'w': w} ORDER BY turn NULLS FIRST, g) AS own,
    xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT for x in string_split(CAST(c AS VARCHAR), '')]),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END)), 4294967295::BIGINT) % 4 AS h
  FROM t GROUP BY c),
r AS (SELECT l.c, list_concat(coalesce(b.own, [])[1:l.h], l.own[l.h + 1:]) AS seq FROM l LEFT JOIN l AS b ON b.c = l.c - l.c % 20),
p AS (SELECT c, len(seq) AS size, d, CASE WHEN d > 0 THEN seq[d].w ELSE 0 END AS w, sha256(array_to_string([x.g for x in seq[1:d]], ',')) AS id,
    CASE WHEN d > 0 THEN sha256(array_to_string([x.g for x in seq[1:d - 1]], ',')) END AS up
  FROM (SELECT *, unnest(range(len(seq) + 1)) AS d FROM r)),
n AS (SELECT d, id, up, min(c) AS c, count(*) AS n, any_value(w) AS w, coalesce(string_agg(c, ',' ORDER BY c) FILTER (size = d), '') AS ends FROM p GROUP BY d, id, up),
k AS (SELECT up, d, count(*) AS n FROM n GROUP BY up, d),
m AS (SELECT n.*, o.c AS parent, coalesce(k.n, 0) AS children FROM n LEFT JOIN k ON k.up = n.id AND k.d = n.d + 1 LEFT JOIN n AS o ON o.id = n.up AND o.d = n.d - 1),
s AS (SELECT a.d, a.id, count(*) FILTER (m.children = 0) AS leaves, sum((m.n - 1) * m.w) AS saved FROM m JOIN p AS a ON a.c = m.c AND a.d <= m.d GROUP BY a.d, a.id)
SELECT m.c AS conv_id, m.d AS depth, m.parent AS parent_conv_id, m.n AS n_convs, m.children AS n_children, s.leaves AS n_leaves,
  CAST(s.saved AS BIGINT) AS saved_tokens, sha256(m.ends) AS ends_sha256
FROM m JOIN s ON s.d = m.d AND s.id = m.id
"""
