"""Tables of a page: from ruling strokes, and from lines of text that stand in columns.

A ruled table is a group of strokes that meet. Strokes snap to the lines of a grid; a border of a grid cell is there where a
stroke crosses the middle of its row or column. Cells whose left or upper border is missing belong to the
cell before: the spans of a cell are the distances to the next borders in its row and column, taken where borders
are, so the grid itself is never laid out.

An aligned table is a run of rows of text each of which has text beside text; the free vertical strips that are left
when all lines of the run are laid over each other part its columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.chains import components
from docloom.operators.layout import chained, row_groups
from docloom.operators.spatial import BOX, PAGE, connected, meeting
from docloom.session import discard, written

# Fixed values, in points: the margin with which strokes meet, the least distance of two lines of a grid, the widest border.
CONNECTED, CLEARANCE, BORDER = 0.5, 2.0, 6.0
#: Fixed value, in points: the distance between rows that parts tables.
FAR = 50.0
#: Beyond every page.
ENDLESS = 1e9
#: Lines of a page whose rows stand in one list.
MOST_LINES = 1 << 14
TABLE = [*PAGE, "table_no"]


def stroke_tables(strokes: DataFrame, gap: float = CONNECTED) -> DataFrame:
    """``strokes`` (doc_id, page_no, stroke, box) of tables with ``table_no`` (the smallest stroke) and whether they are ``flat``.

    Strokes that meet are one group. Of groups one of whose boxes holds the other the largest is the table; what lies within
    its cells belongs to a page of its own. A group needs strokes in both directions.
    """
    grouped = written(connected(strokes, gap, gap, "stroke").withColumnRenamed("root", "table_no").withColumn("flat", F.col("x1") - F.col("x0") >= F.col("y1") - F.col("y0")), "strokes")
    around = [f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))]
    boxes = written(grouped.groupBy(*TABLE).agg(*around, F.bool_or("flat").alias("flat"), F.bool_or(~F.col("flat")).alias("upright")), "groups")

    def holds(a: str, b: str) -> Column:
        return (F.col(f"{a}.x0") <= F.col(f"{b}.x0")) & (F.col(f"{a}.y0") <= F.col(f"{b}.y0")) & (F.col(f"{a}.x1") >= F.col(f"{b}.x1")) & (F.col(f"{a}.y1") >= F.col(f"{b}.y1"))

    pairs = meeting(boxes, boxes, side=256.0).where((F.col("a.table_no") < F.col("b.table_no")) & (holds("a", "b") | holds("b", "a")))
    family = components(pairs.select(*PAGE, F.col("a.table_no").alias("a"), F.col("b.table_no").alias("b")), PAGE).withColumnRenamed("node", "table_no")
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    first = F.row_number().over(Window.partitionBy(*PAGE, F.coalesce("label", "table_no")).orderBy(area.desc(), "table_no"))
    kept = boxes.join(family, TABLE, "left").withColumn("first", first).where("first = 1 AND flat AND upright").select(*TABLE)
    return grouped.join(kept, TABLE, "left_semi")


def grid_lines(strokes: DataFrame, clearance: float = CLEARANCE, border: float = BORDER) -> tuple[DataFrame, DataFrame]:
    """(doc_id, page_no, table_no, flat, line, at): the lines of each table's grid, numbered from 0 in either direction; and ``strokes`` with their ``line``, its ``at``, ``low`` and ``high`` along it.

    Places within the clearance of the next are one line, at their mean. The table's edge is a line where the nearest is farther than
    the widest border.
    """
    middle = F.round(F.when(F.col("flat"), F.col("y0") + F.col("y1")).otherwise(F.col("x0") + F.col("x1")) / 2, 1)
    # The edges of the table as the strokes of both directions have them. All windows lie within a table, so strokes are shuffled by that once.
    edge = lambda f, flat, upright: F.when(F.col("flat"), f(flat).over(Window.partitionBy(*TABLE))).otherwise(f(upright).over(Window.partitionBy(*TABLE)))
    placed = strokes.select(
        *TABLE, "stroke", "flat", middle.alias("place"), edge(F.min, "y0", "x0").alias("near"), edge(F.max, "y1", "x1").alias("far"),
        F.when(F.col("flat"), F.col("x0")).otherwise(F.col("y0")).alias("low"), F.when(F.col("flat"), F.col("x1")).otherwise(F.col("y1")).alias("high"),
    )
    own, direction = Window.partitionBy(*TABLE, "flat", "cluster"), Window.partitionBy(*TABLE, "flat")
    snapped = chained(placed, [*TABLE, "flat"], "place", clearance, False, "stroke")
    snapped = snapped.withColumn("at", F.round(F.avg(F.col("place").cast("decimal(18, 1)")).over(own), 1).cast("double"))
    snapped = snapped.withColumns({"before": F.min("at").over(direction) - F.col("near") > border, "behind": F.col("far") - F.max("at").over(direction) > border})
    line = (F.col("cluster") + F.when(F.col("before"), 1).otherwise(0)).cast("int")
    numbered = written(snapped.select(*TABLE, "flat", line.alias("line"), "at", "low", "high", F.when(F.col("before"), F.col("near")).alias("near"), F.when(F.col("behind"), F.col("far")).alias("far")), "lined")
    lines = numbered.groupBy(*TABLE, "flat", "line").agg(*[F.first(c).alias(c) for c in ("at", "near", "far")])
    last = F.lead("line").over(Window.partitionBy(*TABLE, "flat").orderBy("line")).isNull()
    each = F.array(
        F.struct("line", "at"),
        F.when((F.col("line") == 1) & F.col("near").isNotNull(), F.struct(F.lit(0).alias("line"), F.col("near").alias("at"))),
        F.when(F.col("last") & F.col("far").isNotNull(), F.struct((F.col("line") + 1).alias("line"), F.col("far").alias("at"))),
    )
    grid = lines.withColumn("last", last).select(*TABLE, "flat", F.explode(F.array_compact(each)).alias("e")).select(*TABLE, "flat", "e.line", "e.at")
    return written(grid, "grid"), numbered.drop("near", "far")


def borders(grid: DataFrame, strokes: DataFrame) -> DataFrame:
    """(doc_id, page_no, table_no, flat, line, place, across): the borders that are there, ``place`` being that of their line and ``across`` the row or column beside which a border stands.

    A stroke along one direction crosses the middles that lie within it. Middles and the ends of strokes are put in one order, so
    the middles before each end are counted without comparing strokes with rows.
    """
    rows = Window.partitionBy(*TABLE, "flat").orderBy("line")
    # Rows lie between flat lines and are crossed by upright strokes.
    middles = grid.withColumn("at", (F.col("at") + F.lead("at").over(rows)) / 2).where("at IS NOT NULL").select(*TABLE, (~F.col("flat")).alias("flat"), "at")
    # A middle counts for a low end at or before it, for a high end strictly before it.
    marks = strokes.select(*TABLE, "flat", "line", F.struct("low", "high", F.col("at").alias("place")).alias("own"), F.explode(F.array(F.struct(F.col("low").alias("at"), F.lit(2).alias("kind")), F.struct(F.col("high").alias("at"), F.lit(0).alias("kind")))).alias("m"))
    marks = marks.select(*TABLE, "flat", "line", "own", "m.at", "m.kind")
    both = marks.unionByName(middles.withColumns({"line": F.lit(None).cast("int"), "own": F.lit(None).cast("struct<low:double,high:double,place:double>"), "kind": F.lit(1)}))
    order = Window.partitionBy(*TABLE, "flat").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    counted = both.withColumn("before", F.sum(F.when(F.col("kind") == 1, 1).otherwise(0)).over(order)).where("line IS NOT NULL")
    spans = counted.groupBy(*TABLE, "flat", "line", "own").agg(F.max(F.when(F.col("kind") == 2, F.col("before"))).alias("first"), F.max(F.when(F.col("kind") == 0, F.col("before"))).alias("end"))
    crossed = spans.where(F.col("end") > F.col("first")).select(*TABLE, "flat", "line", "own.place", F.explode(F.sequence("first", F.col("end") - 1)).alias("across"))
    # Each once, still within the tables' partitions. The outer lines stand whole, drawn or not: the first flat one beside each column, the first upright one beside each row.
    crossed = crossed.where("line > 0").distinct()
    size = _extent(grid)
    edge = lambda flat, place, n: F.when(F.col(n) > 0, F.struct(F.lit(flat).alias("flat"), F.col(place).alias("place"), F.sequence(F.lit(0), F.col(n) - 1).alias("all")))
    outer = size.select(*TABLE, F.explode(F.array(edge(True, "top", "cols"), edge(False, "left", "rows"))).alias("e")).where("e IS NOT NULL")
    outer = outer.select(*TABLE, "e.flat", F.lit(0).alias("line"), "e.place", F.explode("e.all").alias("across"))
    return crossed.select(*TABLE, "flat", "line", "place", F.col("across").cast("int").alias("across")).unionByName(outer)


def _extent(grid: DataFrame) -> DataFrame:
    """(doc_id, page_no, table_no, rows, cols, left, top, right, bottom): the extent of each grid, null where it has no line in a direction."""
    flat = lambda c, on=True: F.when(F.col("flat") == on, F.col(c))
    ends = [F.min(flat("at", False)).alias("left"), F.min(flat("at")).alias("top"), F.max(flat("at", False)).alias("right"), F.max(flat("at")).alias("bottom")]
    return grid.groupBy(*TABLE).agg(F.max(flat("line")).alias("rows"), F.max(flat("line", False)).alias("cols"), *ends)


def _regions(cells: DataFrame) -> DataFrame:
    """Every grid cell (r, c) within the spans of ``cells``."""
    down = cells.withColumn("r", F.explode(F.sequence(F.col("row_no"), F.col("row_no") + F.col("row_span") - 1)))
    return down.withColumn("c", F.explode(F.sequence(F.col("col_no"), F.col("col_no") + F.col("col_span") - 1)))


def spanned_cells(grid: DataFrame, there: DataFrame) -> DataFrame:
    """(doc_id, page_no, table_no, row_no, col_no, row_span, col_span, x0, y0, x1, y1): the cells of tables.

    A cell begins where its left and its upper border are there and spans up to the next border in its row and its column. Where another
    cell begins within its region, the region doesn't merge: each grid cell of it is a cell. That may cut later regions, in reading
    order, so it is repeated until nothing changes.
    """
    inner = there.join(_extent(grid).where("rows > 0 AND cols > 0"), TABLE)
    along = Window.partitionBy(*TABLE, "row_no").orderBy("col_no")
    down = Window.partitionBy(*TABLE, "col_no").orderBy("row_no")
    left = inner.where("NOT flat AND line < cols").withColumns({"row_no": F.col("across"), "col_no": F.col("line")})
    left = left.select(*TABLE, "row_no", "col_no", (F.coalesce(F.lead("col_no").over(along), "cols") - F.col("col_no")).alias("col_span"), F.col("place").alias("x0"), F.coalesce(F.lead("place").over(along), "right").alias("x1"))
    upper = inner.where("flat AND line < rows").withColumns({"row_no": F.col("line"), "col_no": F.col("across")})
    upper = upper.select(*TABLE, "row_no", "col_no", (F.coalesce(F.lead("row_no").over(down), "rows") - F.col("row_no")).alias("row_span"), F.col("place").alias("y0"), F.coalesce(F.lead("place").over(down), "bottom").alias("y1"))
    # One row of each at a place at most. They are put together and not joined, as a join may send all of one side through the driver.
    both = left.unionByName(upper, allowMissingColumns=True).groupBy(*TABLE, "row_no", "col_no").agg(*[F.max(c).alias(c) for c in ("row_span", "col_span", *BOX)])
    cells = written(both.where("row_span IS NOT NULL AND col_span IS NOT NULL"), "cells")
    large = written(_regions(cells.where("row_span > 1 OR col_span > 1")), "regions")
    own = (F.col("r") == F.col("row_no")) & (F.col("c") == F.col("col_no"))
    begins = cells.select(*TABLE, F.col("row_no").alias("r"), F.col("col_no").alias("c"))
    place = [*TABLE, "row_no", "col_no"]
    broken = written(large.where(~own).join(begins, [*TABLE, "r", "c"], "left_semi").select(*place).distinct(), "broken")
    while broken.head(1):
        loose = large.join(broken, place, "left_semi").where(~own).join(begins, [*TABLE, "r", "c"], "left_anti")
        loose = written(loose.groupBy(*TABLE, "r", "c").agg(F.min(F.struct("row_no", "col_no")).alias("by")), "loose")
        cut = large.join(broken, place, "left_anti").where(~own).join(loose, [*TABLE, "r", "c"]).where(F.col("by") < F.struct("row_no", "col_no"))
        more = written(cut.select(*place).distinct(), "broken")
        if not more.head(1):
            single = cells.join(broken, place, "left_semi").select(*place).unionByName(loose.select(*TABLE, F.col("r").alias("row_no"), F.col("c").alias("col_no")))
            for low, high, flat, number in (("x0", "x1", "NOT flat", "col_no"), ("y0", "y1", "flat", "row_no")):
                lines = Window.partitionBy(*TABLE).orderBy("line")
                single = single.join(grid.where(flat).select(*TABLE, F.col("line").alias(number), F.col("at").alias(low), F.lead("at").over(lines).alias(high)), [*TABLE, number])
            return cells.join(broken, place, "left_anti").unionByName(single.withColumns({"row_span": F.lit(1), "col_span": F.lit(1)}))
        broken = written(broken.unionByName(more), "broken")
    return cells


def ruled_tables(strokes: DataFrame) -> DataFrame:
    """(doc_id, page_no, table_no, row_no, col_no, row_span, col_span, x0, y0, x1, y1): the cells of the tables that ``strokes`` (doc_id, page_no, stroke, box) rule.

    Rows and columns count from 0. Strokes without a place and groups in one direction alone make no table.
    """
    grid, lined = grid_lines(stroke_tables(strokes.where(" AND ".join(f"{c} IS NOT NULL" for c in BOX)).select(*PAGE, "stroke", *BOX)))
    cells = spanned_cells(grid, written(borders(grid, lined), "borders"))
    return cells.select(*TABLE, *[F.col(c).cast("int").alias(c) for c in ("row_no", "col_no", "row_span", "col_span")], *BOX)


def _common(a: Column, b: Column) -> Column:
    """The intervals (low, high) that two ordered lists of them share."""

    def shared(x: Column) -> Column:
        meet = F.filter(b, lambda y: F.least(x.high, y.high) > F.greatest(x.low, y.low))
        return F.transform(meet, lambda y: F.struct(F.greatest(x.low, y.low).alias("low"), F.least(x.high, y.high).alias("high")))

    return F.flatten(F.transform(a, shared))


def _parted(strips: Column) -> Column:
    """Whether strips are left between the margins."""
    return F.size(strips) > 2


def text_rows(lines: DataFrame, most: int = MOST_LINES) -> DataFrame:
    """(doc_id, page_no, part, parts, rows): the rows of each page that have text beside text, from the top, as one list of structs (at, island, strips, lines).

    ``at`` counts them from 1. ``strips``: the free intervals of the row, margins included. ``lines``: line_no and x0 of each. Rows that follow each other without one
    of a single column and without a large distance between them are an ``island``. A page of over ``most`` lines is several parts, counted from 0.
    All follows from one order of the page, so lines are shuffled by their page and no further.
    """
    row = Window.partitionBy(*PAGE, "row_no").orderBy("x0", "x1")
    gaps = row_groups(lines).withColumn("reach", F.max("x1").over(row.rowsBetween(Window.unboundedPreceding, -1)))
    gap = F.when(F.col("x0") > F.col("reach"), F.struct(F.col("reach").cast("double").alias("low"), F.col("x0").cast("double").alias("high")))
    ends = [F.min("x0").alias("left"), F.max("x1").alias("right"), F.min("y0").alias("y0"), F.max("y1").alias("y1")]
    facts = gaps.groupBy(*PAGE, "row_no").agg(*ends, F.array_sort(F.collect_list(gap)).alias("gaps"), F.collect_list(F.struct("line_no", F.col("x0").cast("double").alias("x0"))).alias("lines"))
    page = Window.partitionBy(*PAGE).orderBy("row_no")
    parted = F.size("gaps") > 0
    cut = ~parted | ~F.coalesce(F.lag(parted).over(page), F.lit(False)) | (F.col("y0") - F.lag("y1").over(page) >= FAR)
    strip = lambda a, b: F.struct(a.cast("double").alias("low"), b.cast("double").alias("high"))
    strips = F.concat(F.array(strip(F.lit(-ENDLESS), F.col("left"))), "gaps", F.array(strip(F.col("right"), F.lit(ENDLESS))))
    above = page.rowsBetween(Window.unboundedPreceding, 0)
    islands = facts.withColumn("island", F.sum(F.when(cut, 1).otherwise(0)).over(above)).where(parted)
    before = F.sum(F.size("lines")).over(above) - F.size("lines")
    islands = islands.withColumn("part", F.floor(before / most)).withColumn("part", F.dense_rank().over(Window.partitionBy(*PAGE).orderBy("part")) - 1)
    islands = islands.withColumns({"parts": F.max("part").over(Window.partitionBy(*PAGE)) + 1, "at": F.row_number().over(page)})
    return islands.groupBy(*PAGE, "part", "parts").agg(F.sort_array(F.collect_list(F.struct("at", "island", strips.alias("strips"), "lines"))).alias("rows"))


#: A run of rows: its first row, how many it has and the strips that they leave free; and what is known of a page's runs after some of its rows.
RUN = "struct<first:int,n:int,strips:array<struct<low:double,high:double>>>"
STATE = f"struct<done:array<{RUN}>,island:bigint,open:{RUN}>"


def _ended(state: Column) -> Column:
    """All runs of ``state``, with the open one."""
    return F.concat(F.coalesce(state.done, F.array().cast(f"array<{RUN}>")), F.when(state.open.isNull(), F.array().cast(f"array<{RUN}>")).otherwise(F.array(state.open)))


def _taken(rows: Column, state: Column) -> Column:
    """``state`` after ``rows``: the runs that are done, and the open one. Each row joins the open run if that is of its island and a strip is left, else it begins a run.

    A strip may be left by a run of whose first rows none was left, so runs can't be put together from halves.
    """
    new = lambda first, n, strips: F.struct(first.cast("int").alias("first"), n.cast("int").alias("n"), strips.alias("strips"))

    def add(s: Column, x: Column) -> Column:
        both = _common(s.open.strips, x.strips)
        longer = F.coalesce((s.island == x.island) & _parted(both), F.lit(False))
        done = F.when(longer, s.done).otherwise(_ended(s))
        return F.struct(done.alias("done"), x.island.alias("island"), F.when(longer, new(s.open.first, s.open.n + 1, both)).otherwise(new(x["at"], F.lit(1), x.strips)).alias("open"))

    return F.aggregate(rows, state, add)


def _cells(run: Column, rows: Column) -> Column:
    """For each row of a run the column and line_no of its lines."""
    inner = _inner(run.strips)
    return F.transform(F.slice(rows, run.first - rows[0]["at"] + 1, run.n), lambda row: F.transform(row.lines, lambda line: F.struct(_column(inner, line.x0).alias("col_no"), line.line_no.alias("line_no"))))


def _inner(strips: Column) -> Column:
    return F.slice(strips, F.lit(2), F.size(strips) - 2)


def _column(inner: Column, x0: Column) -> Column:
    return F.size(F.filter(inner, lambda s: s.high <= x0))


def aligned_tables(lines: DataFrame, most: int = MOST_LINES) -> DataFrame:
    """(doc_id, page_no, table_no, row_no, col_no, line_no): the cell of each line (doc_id, page_no, line_no, box) of text that stands in columns without rules.

    Rows are lines whose heights overlap. From the first row of an island of rows with text beside text, a run takes rows while a
    free vertical strip is left through all of them; the next run begins where none would be. The strips part the columns. A run of two
    columns with one line at most in each cell reads as lines with a gap and isn't a table. Numbers count from 0; lines without a place take no part.

    The runs of a page are taken one after the other where its rows are, part by part on a page of over ``most`` lines.
    """
    placed = lines.where(" AND ".join(f"{c} IS NOT NULL" for c in (*PAGE, *BOX))).select(*PAGE, "line_no", *BOX)
    pages = written(text_rows(placed, most), "text-rows")
    rows = F.col("rows")
    runs = F.transform(_ended(_taken(rows, F.lit(None).cast(STATE))), lambda run: F.struct((F.size(run.strips) > 3).alias("wide"), _cells(run, rows).alias("cells")))
    crowded = lambda cells: F.exists(cells, lambda row: F.size(F.array_distinct(F.transform(row, lambda c: c.col_no))) < F.size(row))
    whole = pages.where("parts = 1").select(*PAGE, F.posexplode(F.filter(runs, lambda run: run.wide | crowded(run.cells))).alias("table_no", "run"))
    whole = whole.select(*TABLE, F.posexplode("run.cells").alias("row_no", "row")).select(*TABLE, "row_no", F.explode("row").alias("cell")).select(*TABLE, "row_no", "cell.*")
    large = pages.where("parts > 1")
    return whole.unionByName(_tables_in_parts(large)) if large.head(1) else whole


def _runs_in_parts(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, from, next, strips): the runs of pages whose rows come in parts; a part begins with the run that the one before left open."""
    last, states = pages.agg(F.max("part")).first()[0], []
    for part in range(last + 1):
        own = pages.where(F.col("part") == part)
        before = F.lit(None).cast(STATE)
        if states:
            own = own.join(states[-1].select(*PAGE, F.struct(F.array().cast(f"array<{RUN}>").alias("done"), "state.island", "state.open").alias("before")), PAGE)
            before = F.col("before")
        states.append(written(own.select(*PAGE, (F.col("part") == F.col("parts") - 1).alias("last"), _taken(F.col("rows"), before).alias("state")), "part"))
    done = F.when(F.col("last"), _ended(F.col("state"))).otherwise(F.col("state.done"))
    runs = reduce(DataFrame.unionByName, [s.select(*PAGE, F.explode(done).alias("run")) for s in states])
    runs = written(runs.select(*PAGE, F.col("run.first").alias("from"), (F.col("run.first") + F.col("run.n")).alias("next"), "run.strips"), "runs")
    discard(*states)
    return runs


def _tables_in_parts(pages: DataFrame) -> DataFrame:
    runs = _runs_in_parts(pages)
    rows = pages.select(*PAGE, F.explode("rows").alias("row")).select(*PAGE, "row.at", "row.lines")
    # Each row has the run that began last.
    began = F.last("from", ignorenulls=True).over(Window.partitionBy(*PAGE).orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    marks = rows.join(runs.select(*PAGE, F.col("from").alias("at"), "from"), [*PAGE, "at"], "left").withColumn("from", began)
    owned = marks.join(runs.select(*PAGE, "from", _inner(F.col("strips")).alias("strips")), [*PAGE, "from"])
    owned = owned.select(*PAGE, "from", (F.col("at") - F.col("from")).alias("r"), "strips", F.explode("lines").alias("line"))
    cells = written(owned.select(*PAGE, "from", "r", _column(F.col("strips"), F.col("line.x0")).alias("col_no"), F.size("strips").alias("parts"), "line.line_no"), "aligned")
    crowded = cells.groupBy(*PAGE, "from", "r", "col_no").agg(F.max("parts").alias("parts"), F.count("*").alias("n"))
    real = crowded.groupBy(*PAGE, "from").agg(F.max("n").alias("most"), F.max("parts").alias("parts")).where("parts > 1 OR most > 1")
    number = F.row_number().over(Window.partitionBy(*PAGE).orderBy("from")) - 1
    tables = real.select(*PAGE, "from", number.alias("table_no"))
    return cells.join(tables, [*PAGE, "from"]).select(*TABLE, F.col("r").cast("int").alias("row_no"), "col_no", "line_no")
