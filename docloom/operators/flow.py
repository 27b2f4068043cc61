"""Pages of a flow of blocks: where each page begins, and the bottom margin under which pages end as they did.

Running heights make every question about a page a difference of two sums. The first block that no longer
fits on the page that a block begins is found by putting blocks and the ends of pages in one order; the pages that
are really begun are those reached from a document's first block, by jumps that double.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.chains import reached
from docloom.session import written

# Fixed values, in points: the least and the usual bottom margin, the share of a page that a margin takes at most, and margins that are
# round in centimetres, then in inches.
LEAST_MARGIN, USUAL_MARGIN, MOST_SHARE = 14.17, 56.69, 0.45
CENTIMETRES = (0.5, 0.75, 1.0, 1.25, 1.27, 1.5, 1.75, 2.0, 2.25, 2.5, 2.54, 3.0, 3.5, 4.0)
ROUND_MARGINS = (*(round(c * 72 / 2.54, 3) for c in CENTIMETRES), 36.0, 54.0, 90.0)


def next_page_starts(blocks: DataFrame) -> DataFrame:
    """(doc_id, pos, next): for each block the first that no longer fits on a page that it begins, or null.

    ``blocks``: doc_id, pos, height, gap (above, which the first of a page goes without), new_page (a break before it), page_height.
    A block that is higher than a page has it for itself. Null heights and gaps count as none.
    """
    document = Window.partitionBy("doc_id").orderBy("pos")
    height, gap = F.coalesce("height", F.lit(0.0)), F.coalesce("gap", F.lit(0.0))
    running = F.sum(height + gap).over(document.rowsBetween(Window.unboundedPreceding, 0))
    rows = blocks.select("doc_id", "pos", running.alias("sum"), height.alias("height"), F.col("page_height"), F.coalesce("new_page", F.lit(False)).alias("new_page"))
    ends = rows.select("doc_id", "pos", (F.col("page_height") + F.col("sum") - F.col("height")).alias("at"), F.lit(0).alias("kind"))
    tops = rows.select("doc_id", "pos", F.col("sum").alias("at"), F.lit(1).alias("kind"))
    # From the largest sum down: what a page's end has before it are the blocks beyond it.
    down = Window.partitionBy("doc_id").orderBy(F.desc("at"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    beyond = ends.unionByName(tops).withColumn("beyond", F.min(F.when(F.col("kind") == 1, F.col("pos"))).over(down)).where("kind = 0").select("doc_id", "pos", "beyond")
    up = Window.partitionBy("doc_id").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    forced = rows.select("doc_id", "pos", F.min(F.when(F.col("new_page"), F.col("pos"))).over(up).alias("forced"), F.lead("pos").over(document).alias("after"))
    fits = F.when(F.col("beyond") <= F.col("pos"), F.col("after")).otherwise(F.col("beyond"))
    return beyond.join(forced, ["doc_id", "pos"]).select("doc_id", "pos", F.least(fits, "forced").alias("next"))


def paginated(blocks: DataFrame) -> DataFrame:
    """(doc_id, pos, page_no): the page of each block, from 1; ``blocks`` as in ``next_page_starts``, ``pos`` being unique in a document."""
    links = written(next_page_starts(blocks), "page-links")
    first = links.groupBy("doc_id").agg(F.min("pos").alias("pos"))
    starts = reached(links, first, ["doc_id"], "pos", "next").withColumn("starts", F.lit(1))
    document = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = links.select("doc_id", "pos").join(starts, ["doc_id", "pos"], "left")
    return rows.select("doc_id", "pos", F.sum(F.coalesce("starts", F.lit(0))).over(document).cast("int").alias("page_no"))


def page_depths(items: DataFrame) -> DataFrame:
    """(doc_id, page_no, bottom, with_next, ends_paragraph): how far the items of each page reach, and how far they would with the first item of the next page.

    ``items``: doc_id, page_no, pos, drawn (a picture or table, with height), para_no, line_no (in the paragraph), leading, ascent and descent
    (``line`` high together), gap (above), top (of the page's body). A line goes on at its leading below the line before of its paragraph.
    """
    document = Window.partitionBy("doc_id", "page_no").orderBy("pos")
    half = F.floor(F.col("leading") / 2)
    goes_on = (F.col("line_no") > 0) & ~F.coalesce(F.lag("drawn").over(document), F.lit(True)) & (F.lag("para_no").over(document) == F.col("para_no"))
    begins = F.lag("pos").over(document).isNull()
    step = (
        F.when(F.col("drawn") & begins, F.col("height"))
        .when(F.col("drawn"), F.col("gap") + F.col("height"))
        .when(begins, F.when(F.col("line_no") > 0, 0).otherwise(F.col("gap")) + F.col("line") + 2 * half)
        .when(goes_on, F.col("line") + F.col("leading"))
        .otherwise(F.col("gap") + F.col("line") + 2 * half)
    )
    last = F.max_by(F.struct("drawn", "para_no"), "pos").alias("last")
    first = F.min_by(F.struct("drawn", "para_no", "gap", "height", "line", "leading"), "pos").alias("first")
    pages = items.withColumn("step", step).groupBy("doc_id", "page_no").agg((F.max("top") + F.sum("step")).alias("bottom"), last, first)
    following = pages.select("doc_id", (F.col("page_no") - 1).alias("page_no"), F.col("first").alias("n"))
    same = ~F.col("last.drawn") & ~F.col("n.drawn") & (F.col("last.para_no") == F.col("n.para_no"))
    more = F.when(F.col("n.drawn"), F.col("n.gap") + F.col("n.height")).when(same, F.col("n.line") + F.col("n.leading")).otherwise(F.col("n.gap") + F.col("n.line") + F.col("n.leading"))
    joined = pages.join(following, ["doc_id", "page_no"], "left")
    return joined.select("doc_id", "page_no", "bottom", (F.col("bottom") + more).alias("with_next"), F.coalesce(~same, F.lit(True)).alias("ends_paragraph"))


def _round_margin(points: Column) -> Column:
    """The first round margin in the whole point that begins at ``points``, else its middle."""
    return F.coalesce(*[F.when((points <= g) & (points + 1 > g), F.lit(g)) for g in ROUND_MARGINS], points + 0.5)


def bottom_margins(depths: DataFrame, documents: DataFrame, full_pages: DataFrame) -> DataFrame:
    """(doc_id, margin, breaks): the bottom margin under which most pages end where they did, and the pages behind which a break is put.

    ``depths`` as ``page_depths`` gives them; ``documents``: doc_id, page_height, most_depth (where a footer begins, or null); ``full_pages``:
    (doc_id, page_no) of pictures that take a page for themselves. A page with a page behind it fits a margin if its items end
    above it and the next item wouldn't. Whole margins are tried; of those that most pages fit the middle one is taken. A page that fits
    none gets a break if it ends a paragraph.
    """
    sized = depths.join(documents, "doc_id")
    deepest = sized.groupBy("doc_id", "page_height", "most_depth").agg(F.max("bottom").alias("deepest"), F.count("with_next").alias("full"))
    limit = F.least(F.col("page_height") - LEAST_MARGIN, F.col("most_depth"))
    least = F.greatest(F.lit(1), F.ceil(F.col("page_height") - limit - 1e-9)).cast("int")
    most = F.least(F.floor(F.col("page_height") * MOST_SHARE), F.floor(F.col("page_height") - F.col("deepest") + 1e-9)).cast("int")
    tried = deepest.where("full > 0").select("doc_id", F.explode(F.when(least <= most, F.sequence(least, most))).alias("b"), F.lit(0).alias("change"))
    # A page fits the margins of one interval, which begins and ends at an event; so no page meets each margin.
    low, high = F.floor(F.col("page_height") - F.col("with_next")) + 1, F.floor(F.col("page_height") - F.col("bottom")) + 1
    events = sized.where("with_next IS NOT NULL").select("doc_id", low.cast("int").alias("low"), high.cast("int").alias("high")).where("low < high")
    events = events.select("doc_id", F.inline(F.array(F.struct(F.col("low").alias("b"), F.lit(1).alias("change")), F.struct(F.col("high").alias("b"), F.lit(-1).alias("change")))))
    fits = F.sum("change").over(Window.partitionBy("doc_id").orderBy("b"))
    counted = tried.withColumn("tried", F.lit(True)).unionByName(events.withColumn("tried", F.lit(False))).withColumn("fits", fits).where("tried")
    best = counted.groupBy("doc_id").agg(F.max(F.struct("fits")).alias("m"), F.collect_list(F.struct("fits", "b")).alias("all"))
    equal = F.array_sort(F.transform(F.filter("all", lambda x: x.fits == F.col("m.fits")), lambda x: x.b))
    chosen = best.select("doc_id", F.element_at(equal, F.floor(F.size(equal) / 2).cast("int") + 1).alias("b"))
    room = F.col("page_height") - F.col("deepest")
    whole = F.when(F.col("full") == 0, F.greatest(F.lit(1), F.floor(F.least(F.lit(USUAL_MARGIN), room)))).otherwise(F.coalesce("b", F.greatest(F.lit(1), F.floor(room))))
    margins = deepest.join(chosen, "doc_id", "left").select("doc_id", "page_height", whole.cast("int").alias("b"))
    line = F.col("page_height") - F.col("b")
    broken = depths.where("with_next IS NOT NULL AND ends_paragraph").join(margins, "doc_id").where((F.col("bottom") <= line) & (line >= F.col("with_next"))).select("doc_id", "page_no")
    alone = full_pages.select("doc_id", F.explode(F.array(F.col("page_no") - 1, F.col("page_no"))).alias("page_no")).where("page_no >= 1")
    breaks = broken.unionByName(alone).groupBy("doc_id").agg(F.array_sort(F.collect_set("page_no")).alias("breaks"))
    found = documents.select("doc_id").join(margins, "doc_id", "left").join(breaks, "doc_id", "left")
    value = F.when(F.col("b").isNull(), F.lit(USUAL_MARGIN)).otherwise(F.greatest(F.lit(1.0), _round_margin(F.col("b").cast("double"))))
    return found.select("doc_id", value.alias("margin"), F.coalesce("breaks", F.array().cast("array<int>")).alias("breaks"))
