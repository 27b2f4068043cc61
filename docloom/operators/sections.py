"""Sections of one and of two columns on a page.

Rows of text are read from the top. Two columns go on while the gap between them stays free. Lines come to a task in the order of their
pages and of their places, after one shuffle; what is known of a page so far are a few numbers, and only the lines of a row
or of a section that may still turn out too low are held, so a page may have any number of lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from docloom.operators.spatial import BOX, PAGE

# How unequal two columns may be, the share of its column that a line takes at least, and the least height of a section in points.
UNEQUAL, FILLED, LEAST_HEIGHT = 2.0, 0.33, 20.0
EDGES = ["page_left", "page_right"]
#: How a line begins: a row that goes on, a row, a page.
ON, ROW, TOP = 0, 1, 2


class State(NamedTuple):
    """What is known of a page after some of its rows: the number of its last section and whether that is of one column; of one of two columns that is open, its gap and height."""

    number: int = -1
    single: bool = False
    gap: tuple[float, float] | None = None
    top: float = 0.0
    bottom: float = 0.0


class Rows(NamedTuple):
    """Rows of text one after the other: whether each is the first of its page and of two columns, its gap if it is, and its extent."""

    first: list[bool]
    two: list[bool]
    low: list[float]
    high: list[float]
    left: list[float]
    right: list[float]
    top: list[float]
    bottom: list[float]


def _rows(lines: dict[str, np.ndarray]) -> tuple[np.ndarray, Rows]:
    """Where each row of ``lines`` begins, and what is known of the rows."""
    begins = lines["begins"] > ON
    row, starts = np.cumsum(begins) - 1, np.flatnonzero(begins)
    order = np.lexsort((lines["x1"], lines["x0"], row))
    x0, x1 = lines["x0"][order], lines["x1"][order]
    # How far the lines of a row reach up to each of them: by their ranks, which lie higher in each row than in the one before.
    rank = np.empty(len(row), np.int64)
    rank[by := np.argsort(x1, kind="stable")] = np.arange(len(row))
    reach = x1[by][np.maximum.accumulate(row * len(row) + rank) - row * len(row)]
    gaps = 1 + np.flatnonzero((row[1:] == row[:-1]) & (x0[1:] > reach[:-1]))
    low, high = np.full(len(starts), np.nan), np.full(len(starts), np.nan)
    low[row[gaps]], high[row[gaps]] = reach[gaps - 1], x0[gaps]
    left, right = x0[starts], reach[np.append(starts[1:], len(row)) - 1]
    middle = (low + high) / 2
    one, other = middle - lines["page_left"][starts], lines["page_right"][starts] - middle
    alike = (one > 0) & (other > 0) & (one <= UNEQUAL * other) & (other <= UNEQUAL * one)
    two = alike & (low - left >= FILLED * one) & (right - high >= FILLED * other) & (np.bincount(row[gaps], minlength=len(starts)) == 1)
    top, bottom = np.minimum.reduceat(lines["y0"], starts), np.maximum.reduceat(lines["y1"], starts)
    return starts, Rows(*[c.tolist() for c in (lines["begins"][starts] == TOP, two, low, high, left, right, top, bottom)])


def _free(gap: tuple[float, float], rows: Rows, i: int) -> tuple[float, float] | None:
    """What row ``i`` leaves of ``gap``, if it stays on one side of it or has a gap there too; the leftmost part, if there are several."""
    free = [(-np.inf, rows.left[i]), (rows.right[i], np.inf)]
    if rows.two[i]:
        free.insert(1, (rows.low[i], rows.high[i]))
    for low, high in free:
        low, high = max(gap[0], low), min(gap[1], high)
        if low < high:
            return low, high
    return None


def _scanned(rows: Rows, state: State, least: float, ended: bool) -> tuple[list[int], list[float], int, State]:
    """The section of each row; from where a line of it stands in the second column, beyond all if there is none; how many rows that is settled for, and what is known after these.

    ``state``: what is known before. A section that may still turn out lower than ``least`` is settled when the rows have ``ended`` only.
    """
    numbers, cuts = [0] * len(rows.two), [np.inf] * len(rows.two)
    start, before = 0, state  # of the open section
    number, single, gap, top, bottom = state
    for i, two in enumerate(rows.two):
        if rows.first[i]:
            number, single, gap, top, bottom = State()
        ends = gap is not None
        if ends:
            left = _free(gap, rows, i)
            if left is not None:
                gap, top, bottom = left, min(top, rows.top[i]), max(bottom, rows.bottom[i])
                numbers[i], cuts[i] = number, gap[1]
                continue
            if not two and bottom - top < least:
                number, single = before.number + (not before.single), True
                numbers[start:i], cuts[start:i] = [number] * (i - start), [np.inf] * (i - start)
            gap = None
        if two and not ends:
            start, before = i, State(number, single)
            number, single, gap, top, bottom = number + 1, False, (rows.low[i], rows.high[i]), rows.top[i], rows.bottom[i]
            cuts[i] = gap[1]
        elif not single:
            number, single = number + 1, True
        numbers[i] = number
    if gap is not None and bottom - top < least and not ended:
        return numbers, cuts, start, before
    return numbers, cuts, len(numbers), State(number, single, gap, top, bottom)


def _settled(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.Table]:
    """The lines of ``batches``, pages and rows one after the other, with section_no, columns and column."""
    held, state, enough, lines = [], State(), 0, 0

    def taken(table: pa.Table, ended: bool) -> tuple[int, State, pa.Table]:
        """How many lines of ``table``, whole rows, are settled, what is known after them, and these lines."""
        own = {c: table[c].to_numpy() for c in ("begins", *BOX, *EDGES)}
        starts, rows = _rows(own)
        numbers, cuts, some, after = _scanned(rows, state, least, ended)
        ends = np.append(starts, table.num_rows)
        done, each = int(ends[some]), np.diff(ends)[:some]
        cut = np.repeat(np.array(cuts[:some]), each)
        found = {"section_no": np.repeat(np.array(numbers[:some], np.int32), each), "columns": np.where(np.isinf(cut), 1, 2), "column": own["x0"][:done] >= cut}
        out = table.slice(0, done).select([*PAGE, "line_no"])
        for name, values in found.items():
            out = out.append_column(name, pa.array(values.astype(np.int32)))
        return done, after, out

    for batch in batches:
        held.append(batch)
        lines += batch.num_rows
        # Whole rows, and twice as many as were not settled before.
        begun = np.flatnonzero(batch["begins"].to_numpy() > ON)
        if len(begun) and lines >= enough:
            table = pa.Table.from_batches(held)
            whole = lines - batch.num_rows + int(begun[-1])
            done = 0
            if whole:
                done, state, out = taken(table.slice(0, whole), False)
                yield out
            held, lines = table.slice(done).to_batches(), lines - done
            enough = 2 * (whole - done)
    if lines:
        yield taken(pa.Table.from_batches(held), True)[2]


def sections(lines: DataFrame, least_height: float = LEAST_HEIGHT) -> DataFrame:
    """(doc_id, page_no, line_no, section_no, columns, column): the section of each line, numbered from the top, and its column, both from 0.

    ``lines``: doc_id, page_no, line_no, box, page_left, page_right (of the text area). A row is of two columns if one gap parts it in
    columns that aren't too unequal and are filled far enough. From a row of two columns, a section takes the rows that stay on one side of the
    gap or have a gap there too. One that is lower than ``least_height`` when a row of one column ends it has one column. The row that ends
    it is of one column, and sections of one column that follow each other are one. Lines without a place take no part.
    """
    placed = lines.select(*PAGE, "line_no", *[F.col(c).cast("double").alias(c) for c in (*BOX, *EDGES)])
    placed = placed.where(" AND ".join([*[f"{c} IS NOT NULL" for c in PAGE], *[f"{c} IS NOT NULL AND NOT isnan({c})" for c in BOX]]))
    # The window leaves lines in the order that the scan goes by.
    above = Window.partitionBy(*PAGE).orderBy("y0", "y1").rowsBetween(Window.unboundedPreceding, -1)
    begins = F.when(F.col("reach").isNull(), TOP).when(F.col("y0") > F.col("reach"), ROW).otherwise(ON)
    marked = placed.withColumn("reach", F.max("y1").over(above)).select(*PAGE, "line_no", *BOX, *EDGES, begins.alias("begins"))
    schema = StructType([*[marked.schema[c] for c in (*PAGE, "line_no")], *[StructField(c, IntegerType()) for c in ("section_no", "columns", "column")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _settled(batches, least_height):
            yield from table.to_batches()

    return marked.mapInArrow(run, schema)
