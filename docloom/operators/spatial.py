"""Boxes of a page that meet, through a grid: no page is compared with itself whole.

The page is cut in square cells. A box goes to each cell that it covers, boxes meet within their cells only, and a pair
belongs to one of the cells that it shares: that of the corner where both begin. A dense page spreads over as many
tasks as it has cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from docloom.operators.chains import components
from docloom.session import written

PAGE = ["doc_id", "page_no"]
BOX = ["x0", "y0", "x1", "y1"]
#: Points of a cell's side: about two lines.
CELL = 32.0
#: Boxes of a page that is cut in cells to find what is connected, and boxes that are compared with as many at once.
DENSE, BLOCK = 4096, 256


def cell(value: Column, side: float = CELL) -> Column:
    return F.floor(value / side)


def covered(low: Column, high: Column, side: float = CELL) -> Column:
    """The cells from ``low`` to ``high``; boxes without extent have one."""
    return F.sequence(cell(low, side), cell(F.greatest(low, high), side))


def in_cells(boxes: DataFrame, dx: float = 0.0, dy: float = 0.0, side: float = CELL) -> DataFrame:
    """``boxes`` once for each cell (cx, cy) that they cover with a margin."""
    across = boxes.withColumn("cx", F.explode(covered(F.col("x0") - dx, F.col("x1") + dx, side)))
    return across.withColumn("cy", F.explode(covered(F.col("y0") - dy, F.col("y1") + dy, side)))


def meeting(a: DataFrame, b: DataFrame, dx: float = 0.0, dy: float = 0.0, side: float = CELL, touch: bool = True) -> DataFrame:
    """Pairs of rows as ``a`` and ``b`` (structs) whose boxes meet on a page, once each; ``a`` counts with a margin of (dx, dy).

    Boxes that only touch meet unless ``touch`` is false.
    """
    left, right = in_cells(a, dx, dy, side).alias("l"), in_cells(b, 0.0, 0.0, side).alias("r")
    # The structs are made of what is joined; made before, places would be shuffled twice.
    pair = [F.struct(*[F.col(f"{of}.{c}") for c in t.columns]).alias(name) for of, t, name in (("l", a, "a"), ("r", b, "b"))]
    x, y = F.greatest(F.col("l.x0") - dx, F.col("r.x0")), F.greatest(F.col("l.y0") - dy, F.col("r.y0"))
    width, height = F.least(F.col("l.x1") + dx, F.col("r.x1")) - x, F.least(F.col("l.y1") + dy, F.col("r.y1")) - y
    meet = (width >= 0) & (height >= 0) if touch else (width > 0) & (height > 0)
    owner = (cell(x, side) == F.col("l.cx")) & (cell(y, side) == F.col("l.cy"))
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in (*PAGE, "cx", "cy")]
    return left.join(right, same[0] & same[1] & same[2] & same[3] & meet & owner).select(F.col("l.doc_id").alias("doc_id"), F.col("l.page_no").alias("page_no"), *pair)


def points_in(points: DataFrame, boxes: DataFrame, x: Column, y: Column, side: float = CELL) -> tuple[DataFrame, DataFrame, Column]:
    """``points`` and ``boxes`` with cells, and whether a point (columns of ``points``) lies in a box: a join of any kind, as a point has one cell."""
    placed = points.withColumns({"cx": cell(x, side), "cy": cell(y, side)}).alias("p")
    return placed, in_cells(boxes, side=side).alias("k"), F.col("p.cx").eqNullSafe(F.col("k.cx")) & F.col("p.cy").eqNullSafe(F.col("k.cy"))


def _found(parent: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """What ``nodes`` hang on in the end."""
    while not np.array_equal(up := parent[nodes], nodes):
        nodes = up
    return nodes


def met(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> np.ndarray:
    """For each box the smallest index among the boxes that meet it, directly or through others; blocks of boxes are compared, in the order of their left edges."""
    order = np.argsort(x0, kind="stable")
    a0, b0, a1, b1 = x0[order], y0[order], x1[order], y1[order]
    parent = np.arange(len(order))
    for i in range(0, len(order), BLOCK):
        own = slice(i, i + BLOCK)
        end = np.searchsorted(a0, a1[own].max(), side="right")
        for j in range(i, end, BLOCK):
            other = slice(j, min(j + BLOCK, end))
            meet = (a0[other] <= a1[own, None]) & (a0[own, None] <= a1[other]) & (b0[other] <= b1[own, None]) & (b0[own, None] <= b1[other])
            rows, names = order[own], order[other]
            # Each row hangs itself and what it meets on the smallest that they hang on, until nothing moves.
            while True:
                up, to = _found(parent, rows), _found(parent, names)
                low = np.minimum(up, np.where(meet, to, len(order)).min(axis=1, initial=len(order)))
                reach = np.minimum(to, np.where(meet, low[:, None], len(order)).min(axis=0, initial=len(order)))
                if np.array_equal(low, up) and np.array_equal(reach, to):
                    break
                np.minimum.at(parent, up, low)
                np.minimum.at(parent, to, reach)
    return _found(parent, np.arange(len(order)))


def _met_in_cells(cells: DataFrame, key: str, dx: float, dy: float) -> DataFrame:
    """The boxes of ``cells`` (boxes: a list) with ``label``, the smallest key among those of the cell that meet."""
    box = cells.schema["boxes"].dataType.elementType
    schema = StructType([*box.fields, StructField("label", box[key].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("boxes")
            rows, ends = lists.flatten(), lists.offsets.to_numpy()
            keys = rows.field(key)
            place = [rows.field(c).to_numpy(zero_copy_only=False).astype(float) + m for c, m in zip(BOX, (-dx, -dy, dx, dy), strict=True)]
            # By key, so that the smallest index is the smallest key.
            rank = np.empty(len(rows), int)
            rank[pc.array_sort_indices(keys).to_numpy()] = np.arange(len(rows))
            label = np.empty(len(rows), int)
            for a, b in zip(ends[:-1] - ends[0], ends[1:] - ends[0], strict=True):
                own = a + np.argsort(rank[a:b])
                label[own] = own[met(*[c[own] for c in place])]
            yield pa.RecordBatch.from_arrays([*[rows.field(f.name) for f in box.fields], keys.take(pa.array(label))], [f.name for f in schema.fields])

    return cells.select("boxes").mapInArrow(run, schema)


def connected(boxes: DataFrame, dx: float, dy: float, key: str = "box") -> DataFrame:
    """``boxes`` (doc_id, page_no, ``key``, ...) with ``root``: the smallest key among the boxes of a page that meet, each with a margin of (dx, dy), directly or through others.

    A page is one cell, a dense one (over DENSE boxes) is cut in many. No pairs are made: the boxes of a cell get the smallest key
    that they hang on there, and only the keys that boxes of several cells have there are linked between cells.
    """
    dense = written(boxes.groupBy(*PAGE).count().where(F.col("count") > DENSE).select(*PAGE, F.lit(True).alias("dense")), "dense")
    cut = boxes.join(dense, PAGE, "left") if dense.head(1) else boxes.withColumn("dense", F.lit(False))
    whole = F.array(F.lit(0).cast("long"))
    across = lambda low, high, d: F.coalesce(F.when(F.col("dense"), covered(F.col(low) - d, F.col(high) + d)), whole)
    cut = cut.withColumns({"_cx": across("x0", "x1", dx), "_cy": across("y0", "y1", dy)})
    cut = cut.withColumn("several", F.size("_cx") * F.size("_cy") > 1).withColumn("_cx", F.explode("_cx")).withColumn("_cy", F.explode("_cy"))
    # Boxes without a page or a place meet none.
    alone = F.when(F.col("doc_id").isNull() | F.col("page_no").isNull(), F.col(key)).alias("alone")
    cells = cut.groupBy(*PAGE, "_cx", "_cy", alone).agg(F.collect_list(F.struct(*boxes.columns, "several")).alias("boxes"))
    local = written(_met_in_cells(cells, key, dx, dy), "met")
    one, many = local.where("NOT several").drop("several"), local.where("several")
    if not many.head(1):
        joined = one.withColumnRenamed("label", "root")
    else:
        rest = [c for c in boxes.columns if c not in (*PAGE, key)]
        many = written(many.groupBy(*PAGE, key).agg(*[F.first(c).alias(c) for c in rest], F.min("label").alias("label"), F.collect_set("label").alias("labels")), "several")
        links = many.select(*PAGE, F.col("label").alias("a"), F.explode("labels").alias("b")).where("a <> b")
        roots = components(links, PAGE).select(*PAGE, F.col("node").alias("label"), F.col("label").alias("root"))
        every = one.unionByName(many.drop("labels")).join(roots, [*PAGE, "label"], "left")
        joined = every.withColumn("root", F.coalesce("root", "label")).drop("label")
    return joined.select(*boxes.columns, "root")
