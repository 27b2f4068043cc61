"""The paragraph of each line of a page, as if the line had been clicked.

How far a paragraph reaches from its seed is the longest run of pairs of lines that stay together and keep the seed's pitch: least and
largest pitches of runs of 1, 2, 4 ... pairs are known for each place, and each seed takes runs from the longest down, below itself and above.
Pages of a bounded size are taken whole within a task, as tables of numbers, after one shuffle of their lines; larger ones go by windows and joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from docloom.operators.spatial import PAGE
from docloom.session import discard, written

# Fixed values, in thicknesses of the clicked line but for the last four: the gap within a paragraph, the band of ends, how far lines that
# begin alike may differ; the share by which thicknesses differ, the share and number of lines of a justified page, how short an unjustified
# last line is, and the points or share by which pitches differ.
GAP, BAND, ALIGNED = 0.8, 0.25, 0.3
THICKNESS, FULL_SHARE, FULL_LINES, SHORT, PITCH, PITCH_SHARE = 0.12, 0.4, 3, 1 / 3, 2.0, 0.15
#: The least band of ends, in points, for lines without thickness.
LEAST_BAND = 1e-9
#: Lines of a page that a task takes whole, and lines that it takes at once, a line counting for each thickness that it is seen by.
WHOLE, AT_ONCE = 1 << 16, 1 << 17
KEY = [*PAGE, "h"]
PLACE = ["top", "bottom", "start", "end"]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1 ... of each range, one range after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _ahead(values: np.ndarray, by: int, end: float = np.nan) -> np.ndarray:
    """What stands ``by`` places further, ``end`` beyond the last."""
    out = np.full(len(values), end, values.dtype)
    out[: max(0, len(values) - by)] = values[by:]
    return out


def _limits(pages: np.ndarray, thick: np.ndarray, sizes: np.ndarray, page: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """``_full_edge`` of each of ``pages`` as seen from a line that is ``thick``; ``sizes`` of all pages, and their lines (page, start, end)."""
    least = np.fmin.reduceat(start, np.cumsum(sizes) - sizes)
    order = np.lexsort((end, page))
    order = order[~np.isnan(end[order])]
    first = np.flatnonzero(_changes(page[order], end[order]))
    # Different ends of each page, and how many lines have them.
    ends, of, many = end[order][first], page[order][first], np.diff(np.append(first, len(order)))
    at, n = np.searchsorted(of, pages), np.bincount(of, minlength=len(sizes))[pages]
    limit, some = np.full(len(pages), np.nan), np.flatnonzero(n)
    if not len(some):
        return limit
    at, n, h = at[some], n[some], thick[some]
    value = ends[own := _ranges(at, n)]
    high = value + np.repeat(np.maximum(h * BAND, LEAST_BAND), n)
    # The first end beyond each band, by halves.
    low, top = own.copy(), np.repeat(at + n, n)
    while (going := low < top).any():
        middle = np.minimum((low + top) // 2, len(ends) - 1)
        within = going & (ends[middle] <= high)
        low, top = np.where(within, middle + 1, low), np.where(going & ~within, middle, top)
    before = np.append(0, np.cumsum(many))
    best = np.maximum.reduceat((before[low] - before[own]) * len(own) + np.arange(len(own)), np.cumsum(n) - n)
    far, lines, most = ends[low[best % len(own)] - 1], sizes[pages[some]], ends[at + n - 1]
    justified = best // len(own) >= np.maximum(float(FULL_LINES), lines * FULL_SHARE)
    limit[some] = np.where(justified, far - h, most - (most - least[pages[some]]) * SHORT)
    return limit


def _pitches(h: np.ndarray, limit: np.ndarray, later: np.ndarray, top: np.ndarray, bottom: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """``_pairs``: the distance of each line and the next one where they stay together, else not a number; ``later``: how many lines the page has after it."""
    full, thick, after = end >= limit, bottom - top, _ahead(start, 1)
    other = _ahead(thick, 1)
    near = (later > 0) & (_ahead(top, 1) - bottom < h * GAP) & (np.abs(other - thick) <= np.maximum(other, thick) * THICKNESS) & full
    joined = near & (np.abs(start - after) <= h * ALIGNED)
    block = np.append(False, joined[:-1])
    short = ~_ahead(full, 1, False)
    hanging = np.where(later > 1, _ahead(joined, 1, False) | (short & (np.abs(start - _ahead(start, 2)) <= h * ALIGNED)), short)
    together = near & ~((after - start > h) & (block | ~hanging)) & ~((start - after > h) & block)
    return np.where(together, _ahead(top, 1) - top, np.nan)


def _reaches(pitch: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and last line of the paragraph of each of ``seeds``, from the pitches of ``_pitches``."""
    own, above = pitch[seeds], np.where(seeds > 0, pitch[seeds - 1], np.nan)
    own = np.where(np.isnan(own), above, own)
    off = np.maximum(PITCH, own * PITCH_SHARE)
    least, most, first, last = own - off, own + off, seeds.copy(), seeds.copy()
    # Not a number is the least and the largest of each run that it is in, and fits nothing.
    lows, highs = [pitch], [pitch]
    while len(lows[-1]) > (far := 1 << (len(lows) - 1)) and not np.isnan(lows[-1]).all():
        lows.append(np.minimum(lows[-1][:-far], lows[-1][far:]))
        highs.append(np.maximum(highs[-1][:-far], highs[-1][far:]))
    for step in reversed(range(len(lows))):
        low, high, far = lows[step], highs[step], 1 << step
        for ends, back in ((last, 0), (first, far)):
            at = np.clip(ends - back, 0, len(low) - 1)
            fits = (at == ends - back) & (low[at] >= least) & (high[at] <= most)
            ends += np.where(fits, -far if back else far, 0)
    return first, last


def _found(lines: pa.Table, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and last line of the paragraph of each of ``lines``, pages of ``sizes`` one after the other in their order."""
    top, bottom, start, end = (lines[c].to_numpy() for c in PLACE)
    page, begin, count = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes, lines.num_rows
    h = bottom - top
    h[pc.or_(*[pc.is_null(lines[c]) for c in PAGE]).to_numpy()] = np.nan
    first, last = np.arange(count), np.arange(count)
    # The thicknesses of each page, and the one that each line has.
    order = np.lexsort((h, page))
    order = order[~np.isnan(h[order])]
    new = _changes(page[order], h[order])
    pages, thick, view = page[order][new], h[order][new], np.full(count, -1)
    view[order] = np.cumsum(new) - 1
    limits = _limits(pages, thick, sizes, page, start, end)
    n, i = sizes[pages], 0
    until = np.cumsum(n)
    while i < len(pages):
        j = max(i + 1, int(np.searchsorted(until, until[i] - n[i] + AT_ONCE, side="right")))
        part, seen = n[i:j], _ranges(begin[pages[i:j]], n[i:j])
        spread = lambda values: np.repeat(values, part)  # noqa: B023, E731
        pitch = _pitches(spread(thick[i:j]), spread(limits[i:j]), spread(begin[pages[i:j]] + part - 1) - seen, *(c[seen] for c in (top, bottom, start, end)))
        seeds = np.flatnonzero(view[seen] == spread(np.arange(i, j)))
        low, high = _reaches(pitch, seeds)
        first[seen[seeds]], last[seen[seeds]] = seen[low], seen[high]
        i = j
    return first, last


def _whole_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """The lines of ``batches`` in tables of whole pages, and the sizes of these; ``n`` is the size of a line's page, whose lines follow each other."""
    held, lines = [], 0

    def taken() -> tuple[pa.Table, list[int]]:
        table, sizes, done = pa.Table.from_batches(held), [], 0
        n = table["n"].to_numpy()
        while done < lines and done + n[done] <= lines:
            sizes.append(int(n[done]))
            done += sizes[-1]
        return table, sizes

    for batch in batches:
        held.append(batch)
        lines += batch.num_rows
        if lines >= AT_ONCE:
            table, sizes = taken()
            done = sum(sizes)
            if done:
                yield table.slice(0, done), np.array(sizes)
            held, lines = table.slice(done).to_batches(), lines - done
    if lines:
        table, sizes = taken()
        yield table, np.array(sizes)


def _within_tasks(lines: DataFrame) -> DataFrame:
    """``clicked_paragraphs`` of ``lines`` with ``n``, the lines of their page, where all lines of a page follow each other."""
    ends = [StructField(c, IntegerType()) for c in ("first", "last")]
    schema = StructType([*[lines.schema[c] for c in (*PAGE, "at")], *ends])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, sizes in _whole_pages(batches):
            order = np.lexsort((table["at"].to_numpy(), np.repeat(np.arange(len(sizes)), sizes)))
            own = table if (order[1:] > order[:-1]).all() else table.take(order)
            found = [own["at"].take(pa.array(ends)).cast(pa.int32()) for ends in _found(own, sizes)]
            yield from pa.table([*[own[c] for c in (*PAGE, "at")], *found], names=schema.names).to_batches()

    return lines.mapInArrow(run, schema)


def _full_edge(lines: DataFrame) -> DataFrame:
    """(doc_id, page_no, h, limit): where lines end that aren't short, for each thickness that a clicked line may have.

    Where many lines end in one narrow band, that is its far side less a thickness; else a third of the text's width from the farthest end.
    """
    page, band = Window.partitionBy(*KEY), Window.partitionBy(*KEY).orderBy(F.col("end") / F.greatest(F.col("h") * BAND, F.lit(LEAST_BAND))).rangeBetween(0, 1)
    ends = lines.withColumns({"n": F.count("*").over(page), "within": F.count("*").over(band), "far": F.max("end").over(band)})
    best = F.max(F.when(F.col("end").isNotNull(), F.struct("within", "end", "far")))
    facts = ends.groupBy(*KEY).agg(best.alias("best"), F.max("end").alias("most"), F.min("start").alias("least"), F.first("n").alias("n"))
    justified = F.col("best.within") >= F.greatest(F.lit(float(FULL_LINES)), F.col("n") * FULL_SHARE)
    return facts.select(*KEY, F.when(justified, F.col("best.far") - F.col("h")).otherwise(F.col("most") - (F.col("most") - F.col("least")) * SHORT).alias("limit"))


def _pairs(lines: DataFrame) -> DataFrame:
    """(doc_id, page_no, h, at, pitch): the lines ``at`` that stay together with the next one, their pitch aside."""
    w = Window.partitionBy(*KEY).orderBy("at")
    # Each line as a struct, with the one before and the two behind.
    whole = lines.withColumn("u", F.struct("top", "bottom", "start", "short"))
    whole = whole.withColumns({"p": F.lag("u").over(w), "a": F.lead("u").over(w), "s": F.lead("u", 2).over(w)})
    h = F.col("h")
    no = lambda c: F.coalesce(c, F.lit(False))

    def near(u: Column, a: Column) -> Column:
        thick, other = u.bottom - u.top, a.bottom - a.top
        return no((a.top - u.bottom < h * GAP) & (F.abs(other - thick) <= F.greatest(other, thick) * THICKNESS) & ~u.short)

    def aligned(u: Column, a: Column) -> Column:
        return no(F.abs(u.start - a.start) <= h * ALIGNED)

    p, u, a, s = (F.col(c) for c in "puas")
    block = near(p, u) & aligned(p, u)
    hanging = F.when(s.isNotNull(), (near(a, s) & aligned(a, s)) | (a.short & aligned(u, s))).otherwise(a.short)
    further_in, further_out = a.start - u.start > h, u.start - a.start > h
    together = near(u, a) & ~no(further_in & (block | ~hanging)) & ~no(further_out & block)
    return whole.where(together).select(*KEY, "at", (a.top - u.top).alias("pitch"))


def clicked_paragraphs(lines: DataFrame, most: int = WHOLE) -> DataFrame:
    """(doc_id, page_no, at, first, last): the paragraph of each line ``at`` (0, 1, ... from the top) of a page, by its first and last line.

    ``lines``: doc_id, page_no, at, top, bottom, start, end (along the direction of reading). Lines stay together if the gap is small,
    they are as thick, the upper isn't short, the lower isn't an indented first line nor the first of the next hanging
    item, and their distance is that of the first two lines that stay together, the clicked one and the next, else the one before and it.
    Pages of over ``most`` lines don't go to a task whole.
    """
    number = lambda c: F.when(~F.isnan(c.cast("double")), c.cast("double"))
    placed = lines.select(*PAGE, "at", *[number(F.col(c)).alias(c) for c in PLACE])
    # Counted without an order, so that lines that are dealt out by their page aren't shuffled or sorted again.
    sized = placed.withColumn("n", F.count("*").over(Window.partitionBy(*PAGE)))
    found = _within_tasks(sized.where(F.col("n") <= most))
    largest = lines.groupBy(*PAGE).count().agg(F.max("count")).first()[0]
    return found.unionByName(_by_joins(sized.where(F.col("n") > most).drop("n"))) if (largest or 0) > most else found


def _by_joins(lines: DataFrame) -> DataFrame:
    """``clicked_paragraphs`` of pages of any size: what two lines have to do with each other is a window over the page's lines, and runs are joined."""
    own = lines.withColumn("h", F.col("bottom") - F.col("top"))
    every = lines.join(own.select(*KEY).distinct(), PAGE)
    every = written(every.join(_full_edge(every), KEY).withColumn("short", F.col("end") < F.col("limit")), "clicked-lines")
    pairs = written(_pairs(every).withColumns({"low": F.col("pitch"), "high": F.col("pitch")}), "clicked-pairs")
    spans, far = [pairs.select(*KEY, "at", "low", "high")], 1
    while True:
        ahead = spans[-1].select(*KEY, (F.col("at") - far).alias("at"), F.col("low").alias("l"), F.col("high").alias("g"))
        longer = written(spans[-1].join(ahead, [*KEY, "at"]).select(*KEY, "at", F.least("low", "l").alias("low"), F.greatest("high", "g").alias("high")), "clicked-spans")
        if not longer.head(1):
            discard(longer)
            break
        spans.append(longer)
        far *= 2
    below = pairs.select(*KEY, "at", F.col("pitch").alias("below"))
    above = pairs.select(*KEY, (F.col("at") + 1).alias("at"), F.col("pitch").alias("above"))
    seeds = own.select(*KEY, "at").join(below, [*KEY, "at"], "left").join(above, [*KEY, "at"], "left").withColumn("pitch", F.coalesce("below", "above"))
    off = F.greatest(F.lit(PITCH), F.col("pitch") * PITCH_SHARE)
    # No pitch, no pair on either side.
    found = seeds.select(*KEY, "at", (F.col("pitch") - off).alias("least"), (F.col("pitch") + off).alias("most"), F.col("at").alias("first"), F.col("at").alias("last"))
    for span in reversed(spans):
        for column, back in (("last", 0), ("first", far)):
            there = span.select(*KEY, (F.col("at") + back).alias(column), "low", "high")
            moved = found.join(there, [*KEY, column], "left")
            fits = F.coalesce((F.col("low") >= F.col("least")) & (F.col("high") <= F.col("most")), F.lit(False))
            to = F.col(column) + (-far if back else far)
            found = moved.withColumn(column, F.when(fits, to).otherwise(F.col(column)).cast("int")).drop("low", "high")
        far //= 2
    return found.select(*PAGE, "at", "first", "last")
