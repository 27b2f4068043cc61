"""Relations followed to their end: what can be reached, what is connected.

Each round doubles the steps that a row looks ahead, so a chain of a million links takes twenty rounds. Rounds are
tables in the shared folder, of which the older ones are deleted; nothing grows but with the rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.session import discard, written


def _keys_equal(left: DataFrame, right: DataFrame, names: list[str], to: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[x] == right[y] for x, y in zip(names, to, strict=True)])


def reached(links: DataFrame, starts: DataFrame, keys: list[str], node: str = "at", after: str = "next") -> DataFrame:
    """(keys, node): ``starts`` and all that following ``links`` (keys, node, after) from them leads to.

    A node has one link at most. What is known doubles with each round: the links of so many steps lead from all that is reached to
    as much again. Links that lead round end the rounds when nothing new is found.
    """
    found = written(starts.select(*keys, node).distinct(), "reached")
    jump = written(links.where(F.col(after).isNotNull()).select(*keys, node, after), "jumps")
    while True:
        step = found.join(jump, [*keys, node]).select(*keys, F.col(after).alias(node)).distinct()
        more = written(step.join(found, [*keys, node], "left_anti"), "reached")
        if not more.head(1):
            discard(more, jump)
            return found
        both = written(found.unionByName(more), "reached")
        far = jump.select(*keys, F.col(node).alias(after), F.col(after).alias("further"))
        longer = written(jump.join(far, [*keys, after]).select(*keys, node, F.col("further").alias(after)), "jumps")
        discard(found, more, jump)
        found, jump = both, longer


def components(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, label): the nodes of ``edges`` (keys, a, b) with the smallest node that they are connected with.

    Every node hangs on the smallest that it or its neighbours hang on, then on what that hangs on, until nothing moves.
    """
    both = edges.select(*keys, "a", "b").unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.distinct(), "edges")
    label = written(both.groupBy(*keys, F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    while True:
        seen = both.join(label.select(*keys, F.col("node").alias("b"), F.col("label").alias("there")), [*keys, "b"])
        near = seen.groupBy(*keys, F.col("a").alias("node")).agg(F.min("there").alias("near"))
        hooked = label.join(near, [*keys, "node"]).select(*keys, "node", F.least("label", "near").alias("new"), F.col("label").alias("old"))
        # A root that sees a smaller label takes all that hang on it along.
        roots = hooked.groupBy(*keys, F.col("old").alias("root")).agg(F.min("new").alias("best"))
        hung = hooked.join(roots.withColumnRenamed("root", "old"), [*keys, "old"]).select(*keys, "node", F.col("best").alias("new"), "old")
        hung = written(hung, "hung")
        ends = hung.select(*keys, F.col("node").alias("new"), F.col("new").alias("end"))
        jumped = written(hung.join(ends, [*keys, "new"]).select(*keys, "node", "old", F.col("end").alias("label")), "labels")
        discard(hung, label)
        label = jumped.select(*keys, "node", "label")
        label.scratch = jumped.scratch
        if not jumped.where("label <> old").head(1):
            discard(both)
            return label


def followed(starts: DataFrame, links: DataFrame, keys: list[str], at: str, node: str, after: str) -> DataFrame:
    """``starts`` (keys, ``at``, ...) with ``hop``: each row for every node that following ``links`` (keys, node, after) from its ``at`` leads to, itself included.

    A node has one link at most. Where links lead round, a node counts once, at its first hop.
    """
    own = [F.col(c).alias(f"own_{c}") for c in starts.columns]
    who = [f"own_{c}" for c in starts.columns]
    found = written(starts.select(*keys, at, *own, F.lit(0).cast("long").alias("hop")).distinct(), "followed")
    jump, far = written(links.where(F.col(after).isNotNull()).select(*keys, F.col(node).alias(at), F.col(after).alias("to")), "jumps"), 1
    while True:
        step = found.join(jump, [*keys, at]).select(*keys, F.col("to").alias(at), *who, (F.col("hop") + far).alias("hop"))
        fresh = step.groupBy(*keys, at, *who).agg(F.min("hop").alias("hop"))
        more = written(fresh.join(found.select(*keys, at, *who).distinct(), [*keys, at, *who], "left_anti"), "followed")
        if not more.head(1):
            discard(more, jump)
            return found.select(*[F.col(f"own_{c}").alias(c) for c in starts.columns if c != at], at, "hop")
        both = written(found.unionByName(more), "followed")
        next_jump = jump.select(*keys, F.col(at).alias("to"), F.col("to").alias("further"))
        longer = written(jump.join(next_jump, [*keys, "to"]).select(*keys, at, F.col("further").alias("to")), "jumps")
        discard(found, more, jump)
        found, jump, far = both, longer, far * 2


def nearest(nodes: DataFrame, keys: list[str], node: str, parent: str, value: str) -> DataFrame:
    """(keys, node, value, hop): the value of the nearest of a node and its ancestors that has one, and how far up that is.

    Each node looks at twice as many ancestors in each round and keeps one pointer, so neither depth nor the number of nodes has a
    bound, and no node is paired with all of its ancestors. Nodes in a cycle without a value stay without. Ids must be unique.
    """
    rows = nodes.select(*keys, node, F.col(value).alias("value"), F.when(F.col(value).isNull(), F.col(parent)).alias("up"), F.lit(0).cast("long").alias("hop"))
    rows = written(rows.withColumn("step", F.lit(1).cast("long")), "nearest")
    rounds = max(1, rows.count().bit_length())
    for _ in range(rounds):
        if not rows.where("up IS NOT NULL").head(1):
            break
        there = rows.select(*keys, F.col(node).alias("up"), F.col("value").alias("v"), F.col("up").alias("u"), F.col("hop").alias("h"), F.col("step").alias("s"))
        seen = rows.where("up IS NOT NULL").join(there, [*keys, "up"], "left")
        moved = seen.select(*keys, node, F.col("v").alias("value"), F.when(F.col("v").isNull(), F.col("u")).alias("up"), F.when(F.col("v").isNull(), F.lit(0)).otherwise(F.col("step") + F.col("h")).cast("long").alias("hop"), (F.col("step") + F.coalesce("s", F.lit(0))).alias("step"))
        new = written(rows.where("up IS NULL").unionByName(moved), "nearest")
        discard(rows)
        rows = new
    return rows.select(*keys, node, "value", "hop")


def gathered(nodes: DataFrame, keys: list[str], node: str, parent: str, parts: str) -> DataFrame:
    """(keys, node, parts): the lists of a node's ancestors, from the outermost, and its own, as one list; by pointers that double.

    A list grows with the depth of its node and nothing else does. A node whose ancestors lead round has an empty list.
    """
    known = nodes.select(*keys, F.col(node).alias(parent), F.lit(True).alias("known"))
    roots = nodes.join(known, [*keys, parent], "left").select(*keys, node, parent, F.when(F.col("known").isNull(), F.lit(True)).alias("root"))
    rooted = nearest(roots, keys, node, parent, "root").where("value").select(*keys, node, F.lit(True).alias("rooted"))
    own = nodes.select(*keys, node, F.col(parts).alias("parts"), F.col(parent).alias("up")).join(rooted, [*keys, node], "left")
    own = own.select(*keys, node, F.when(F.col("rooted"), F.col("parts")).otherwise(F.slice("parts", 1, 0)).alias("parts"), F.when(F.col("rooted"), F.col("up")).alias("up"))
    rows = written(own, "gathered")
    for _ in range(max(1, rows.count().bit_length())):
        if not rows.where("up IS NOT NULL").head(1):
            break
        there = rows.select(*keys, F.col(node).alias("up"), F.col("parts").alias("p"), F.col("up").alias("u"))
        joined = rows.where("up IS NOT NULL").join(there, [*keys, "up"], "left")
        moved = joined.select(*keys, node, F.concat(F.coalesce("p", F.slice("parts", 1, 0)), "parts").alias("parts"), F.col("u").alias("up"))
        new = written(rows.where("up IS NULL").unionByName(moved), "gathered")
        discard(rows)
        rows = new
    return rows.select(*keys, node, "parts")
