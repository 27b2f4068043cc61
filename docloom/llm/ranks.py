"""Positions of rows within their group, without a window over a group that may hold most of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import broadcast_if_small, parts_for, written

#: Rows of one range, and offsets that are broadcast at most.
ROWS_PER_RANGE, MOST_OFFSETS = 500_000, 1_000_000


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[f"of_{c}"]) for c in names])


def positions(rows: DataFrame, group: list[str], order: list[str], running: dict[str, str] | None = None) -> DataFrame:
    """The written table ``rows`` with ``pos`` (from 0, by ``order``), ``n`` (rows of the group) and ``tree`` (a number that ascends with the group; nulls first).

    ``running`` asks for sums of columns over the group's rows up to each row, by the names they get.
    Rows are dealt in ranges of group and order, so a group of any size is cut; what each range holds of each group is
    counted, and the counts of the ranges before are added. ``order`` should be total, else ties stand in any order.
    """
    spark, running = rows.sparkSession, running or {}
    parts = max(parts_for(rows.count(), ROWS_PER_RANGE), int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = [*group, *order]
    sorted_rows = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    sorted_rows = written(sorted_rows, "ranked").withColumn("part", F.shiftright("at", 33))
    sums = [F.sum(c).alias(f"sum_{name}") for name, c in running.items()]
    held = sorted_rows.groupBy(*group, "part").agg(F.min("at").alias("first_at"), F.count("*").alias("held"), *sums)
    before = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)

    def earlier(column: str, name: str) -> Column:
        return F.coalesce(F.sum(column).over(before), F.lit(0)).cast("long").alias(name)

    offsets = held.select(
        *[F.col(c).alias(f"of_{c}") for c in [*group, "part"]], "first_at", earlier("held", "ahead"),
        F.sum("held").over(whole).alias("n"), F.min("first_at").over(whole).alias("tree"), *[earlier(f"sum_{name}", f"ahead_{name}") for name in running],
    )
    offsets = broadcast_if_small(written(offsets, "offsets"), MOST_OFFSETS)
    joined = sorted_rows.join(offsets, _same(sorted_rows, offsets, [*group, "part"]))
    within = Window.partitionBy(*group, "part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    totals = [(F.col(f"ahead_{name}") + F.sum(c).over(within)).alias(name) for name, c in running.items()]
    return joined.select(*rows.columns, (F.col("ahead") + F.col("at") - F.col("first_at")).alias("pos"), "n", "tree", *totals)
