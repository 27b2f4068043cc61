"""Page lists: ranges, recipes, splitting, merging, rotating, outlines, sizes.

Order is data: every relation has an ordinal, and what depends on the row before is a window over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import ranges, text

# The size of a page with none before it, in points, and standard papers.
BLANK_SIZE = (595.28, 841.89)
PAPERS = (("A4", 595.276, 841.89), ("A3", 841.89, 1190.55), ("A5", 419.528, 595.276), ("Letter", 612.0, 792.0), ("Legal", 612.0, 1008.0), ("Tabloid", 792.0, 1224.0))
MM = 25.4 / 72
SAFE_EDGE_MM = 4.0
#: Bytes that a page takes whose content is stored already.
REPEAT_BYTES = 20


def coalesced_runs(recipe: DataFrame, key: str = "recipe_id") -> DataFrame:
    """(key, run, src_doc, first, last, at, n): consecutive pages of one source as one range, in order; blank pages stay single."""
    w = Window.partitionBy(key).orderBy("pos")
    goes_on = F.col("src_doc").isNotNull() & (F.lag("src_doc").over(w) == F.col("src_doc")) & (F.lag("src_page").over(w) + 1 == F.col("src_page"))
    numbered = recipe.withColumn("run", F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(w))
    runs = numbered.groupBy(key, "run").agg(F.first("src_doc").alias("src_doc"), F.min("src_page").alias("first"), F.max("src_page").alias("last"), F.min("pos").alias("at"), F.count("*").alias("n"))
    return runs


def islands(pages: DataFrame, key: str, page: str = "page_no") -> DataFrame:
    """(key, first, last): runs of consecutive distinct page numbers."""
    w = Window.partitionBy(key).orderBy(page)
    marked = pages.select(key, page).distinct().withColumn("island", F.col(page) - F.row_number().over(w))
    return marked.groupBy(key, "island").agg(F.min(page).alias("first"), F.max(page).alias("last")).drop("island")


def summaries(pages: DataFrame, key: str, page: str = "page_no") -> DataFrame:
    """(key, summary): the runs of each key's pages in short, as ``ranges.page_summary`` writes them, with at most four runs of a key in one place."""
    runs = islands(pages, key, page).withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(F.col("first").asc_nulls_last())))
    text = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("–", F.col("first").cast("string"), F.col("last").cast("string")))
    shown = F.when((F.col("k") <= 4) & F.col("first").isNotNull(), F.struct("k", text.alias("text")))
    found = runs.groupBy(key).agg(F.array_sort(F.collect_list(shown)).alias("shown"), F.count("first").alias("n"), F.sum(F.col("last") - F.col("first") + 1).alias("pages"))
    texts = F.transform("shown", lambda s: s.text)
    short = F.concat(F.array_join(F.slice(texts, 1, 3), ", "), F.lit(" … ("), F.col("pages").cast("string"), F.lit(" sayfa)"))
    body = F.when(F.col("n") > 4, short).otherwise(F.array_join(texts, ", "))
    return found.select(key, F.when(F.col("n") == 0, "").otherwise(F.concat(F.lit("s. "), body)).alias("summary"))


def build_recipe(recipe: DataFrame, pages: DataFrame) -> DataFrame:
    """Each page of a recipe with its source page's size and its rotation.

    A blank page without a size takes that of the last sourced page before it, else the usual one.
    """
    source = pages.select(F.col("doc_id").alias("src_doc"), F.col("page_no").alias("src_page"), F.col("width").alias("w"), F.col("height").alias("h"), F.col("rotation").alias("r"))
    joined = recipe.join(source, ["src_doc", "src_page"], "left")
    before = Window.partitionBy("recipe_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    blank = F.col("src_doc").isNull()
    inherited = lambda c, usual: F.coalesce(F.last(c, ignorenulls=True).over(before), F.lit(usual))
    return joined.select(
        "recipe_id",
        "pos",
        "src_doc",
        "src_page",
        F.when(blank, F.coalesce("width", inherited("w", BLANK_SIZE[0]))).otherwise(F.col("w")).alias("width"),
        F.when(blank, F.coalesce("height", inherited("h", BLANK_SIZE[1]))).otherwise(F.col("h")).alias("height"),
        F.pmod(F.coalesce("r", F.lit(0)) + F.coalesce("rotate", F.lit(0)), F.lit(360)).alias("rotation"),
    )


def visible_sizes(pages: DataFrame) -> DataFrame:
    """Pages as they are seen: sideways pages have width and height changed over."""
    sideways = F.pmod("rotation", F.lit(180)) == 90
    return pages.select("doc_id", "page_no", F.when(sideways, F.col("height")).otherwise(F.col("width")).alias("width"), F.when(sideways, F.col("width")).otherwise(F.col("height")).alias("height"), "rotation")


def rotated(pages: DataFrame, degrees: int, chosen: Column) -> DataFrame:
    """``pages`` with ``degrees`` more on the chosen ones."""
    return pages.withColumn("rotation", F.when(chosen, F.pmod(F.col("rotation") + degrees, F.lit(360))).otherwise(F.col("rotation")))


def new_rotations(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, page_no, rotation): the wanted angles that change anything."""
    angle = F.pmod("angle", F.lit(360))
    return pages.join(wanted, ["doc_id", "page_no"]).where(angle != F.pmod("rotation", F.lit(360))).select("doc_id", "page_no", angle.alias("rotation"))


def rotation_error(angle: Column) -> Column:
    """Null for a multiple of 90 degrees, else the code of what is wrong."""
    number = angle.try_cast("int")
    return F.when(number.isNull(), "not_a_number").when(F.pmod(number, F.lit(90)) != 0, "not_right_angle")


def page_error(page: Column, n_pages: Column) -> Column:
    number = page.try_cast("int")
    return F.when(number.isNull(), "not_a_number").when((number < 1) | (number > n_pages), "out_of_range")


def split_parts(requests: DataFrame) -> DataFrame:
    """(request_id, part, name, pages, error) of requests (base, mode, files, text, total).

    Modes: ``ranges`` gives a file for each range, or one file of all pages as a set if ``files`` is
    ``one`` or there is one range; ``every`` gives a file for each page.
    """
    base = text.safe_name(F.col("base"))
    found = ranges.split_ranges(F.col("text"), F.col("total"))
    spans = F.when(F.col("mode") == "every", F.transform(F.sequence(F.lit(1), F.greatest("total", F.lit(1))), lambda i: F.struct(i.cast("int").alias("low"), i.cast("int").alias("high")))).otherwise(found.ranges)
    error = F.when(~F.col("mode").isin("ranges", "every"), "unknown_mode").when(F.col("total") < 1, "no_pages").when(F.col("mode") == "ranges", found.error)
    pages_of = lambda s: F.sequence(s.low, s.high)
    name = lambda s: F.concat(base, F.lit(" - Sayfa "), F.when(s.low == s.high, s.low.cast("string")).otherwise(F.concat_ws("-", s.low.cast("string"), s.high.cast("string"))), F.lit(".pdf"))
    whole = F.struct(F.concat(base, F.lit(".pdf")).alias("name"), F.array_sort(F.array_distinct(F.flatten(F.transform(spans, pages_of)))).alias("pages"))
    single = (F.size(spans) == 1) | ((F.col("mode") == "ranges") & (F.col("files") == "one"))
    parts = F.when(single, F.array(whole)).otherwise(F.transform(spans, lambda s: F.struct(name(s).alias("name"), pages_of(s).alias("pages"))))
    rows = requests.select("request_id", error.alias("error"), F.posexplode_outer(F.when(error.isNull(), parts)).alias("part", "p"))
    return rows.select("request_id", "part", "p.name", "p.pages", "error")


def merge_offsets(items: DataFrame, key: str = "merge_id") -> DataFrame:
    """``items`` (pos, n_pages) with ``base``: the pages before each in the merged document."""
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return items.withColumn("base", F.coalesce(F.sum("n_pages").over(before), F.lit(0)))


def merged_size(items: DataFrame, key: str = "merge_id") -> DataFrame:
    """(key, total, stored, repeated): items with equal digests are stored once; each repeat costs a little for each page.

    Items without a size are left out. Counts of equal digests come first, so a digest that many share is one row.
    """
    known = items.where(F.col("size").isNotNull())
    classes = known.groupBy(key, "digest").agg(F.min_by("size", "pos").alias("size"), F.count("*").alias("n"), F.sum("n_pages").alias("pages"), F.min_by("n_pages", "pos").alias("first_pages"))
    again = (F.col("pages") - F.col("first_pages")) * REPEAT_BYTES
    return classes.groupBy(key).agg(F.sum(F.col("size") + again).alias("total"), F.count("*").alias("stored"), F.sum(F.col("n") - 1).alias("repeated"))


def remapped_outline(outline: DataFrame, mapping: DataFrame, base: Column | None = None) -> DataFrame:
    """(doc_id, pos, level, title, page_no): entries whose page is kept, on its first new place.

    A level may be one deeper than the entry before at most, so the i-th is i more than the least of level less place so far.
    """
    places = mapping.groupBy("doc_id", F.col("old_page").alias("page_no")).agg(F.min("new_page").alias("new_page"))
    kept = outline.join(places, ["doc_id", "page_no"]).select("doc_id", "pos", "level", F.coalesce("title", F.lit("")).alias("title"), (F.col("new_page") + (base if base is not None else F.lit(0))).alias("page_no"))
    document = Window.partitionBy("doc_id").orderBy("pos")
    kept = kept.withColumn("place", F.row_number().over(document))
    room = F.min(F.when(F.col("level").isNotNull(), F.greatest(F.col("level"), F.lit(1)) - F.col("place"))).over(document.rowsBetween(Window.unboundedPreceding, 0))
    return kept.select("doc_id", "pos", (F.col("place") + F.least(F.lit(0), room)).cast("int").alias("level"), "title", "page_no")


#: Levels that one pass over the entries looks at.
LEVELS_AT_ONCE = 64


def outline_parents(outline: DataFrame) -> DataFrame:
    """(doc_id, pos, level, title, parent): the position of the last entry before with a smaller level, or null.

    For each level there is, its last entry before; of those of smaller levels the latest. Null levels have no parent and are none.
    """
    rows = outline.select("doc_id", "pos", "level", "title").withColumn("parent", F.lit(None).cast(outline.schema["pos"].dataType))
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    # As many as a document's outline is deep, not as its entries.
    levels = sorted(r.level for r in outline.where("level IS NOT NULL").select("level").distinct().collect())
    for at in range(0, len(levels), LEVELS_AT_ONCE):
        last = [F.when(F.col("level") > k, F.max(F.when(F.col("level") == k, F.col("pos"))).over(before)) for k in levels[at : at + LEVELS_AT_ONCE]]
        rows = rows.withColumn("parent", F.greatest("parent", *last))
    return rows


def page_list_diff(old: DataFrame, new: DataFrame, key: str = "list_id") -> DataFrame:
    """(key, removed, added, reordered, rotated): what changed between page lists (pos, page_key, rotation).

    Equal pages are matched in order. Only the order of pages in both lists counts as reordered.
    """
    nth = F.row_number().over(Window.partitionBy(key, "page_key").orderBy("pos"))
    a = old.select(key, "page_key", F.col("pos").alias("old_pos"), F.col("rotation").alias("old_rotation"), nth.alias("nth"))
    b = new.select(key, "page_key", F.col("pos").alias("new_pos"), F.col("rotation").alias("new_rotation"), nth.alias("nth"))
    both = a.join(b, [key, "page_key", "nth"], "full_outer")
    before = F.lag("old_pos").over(Window.partitionBy(key).orderBy(F.col("old_pos").isNull() | F.col("new_pos").isNull(), "new_pos"))
    matched = F.col("old_pos").isNotNull() & F.col("new_pos").isNotNull()
    rows = both.withColumn("back", matched & F.coalesce(F.col("old_pos") < before, F.lit(False)))
    turned = matched & (F.coalesce("old_rotation", F.lit(0)) != F.coalesce("new_rotation", F.lit(0)))
    return rows.groupBy(key).agg(
        F.count(F.when(F.col("new_pos").isNull(), 1)).alias("removed"),
        F.count(F.when(F.col("old_pos").isNull(), 1)).alias("added"),
        F.bool_or("back").alias("reordered"),
        F.array_sort(F.collect_list(F.when(turned, F.col("new_pos")))).alias("rotated"),
    )


def shown_at(recipe: DataFrame) -> DataFrame:
    """(recipe_id, src_doc, src_page, at): the first place of each source page in the list shown."""
    return recipe.where(F.col("src_doc").isNotNull()).groupBy("recipe_id", "src_doc", "src_page").agg(F.min("pos").alias("at"))


def moved(pages: DataFrame, chosen: Column, to: int, key: str = "list_id") -> DataFrame:
    """``pages`` (pos) with ``new_pos`` after the chosen ones went, in their order, before place ``to`` of the others."""
    others = F.sum(F.when(chosen, 0).otherwise(1)).over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    rank = F.when(chosen, F.lit(to)).otherwise(F.coalesce(others, F.lit(0)))
    order = Window.partitionBy(key).orderBy(rank, F.when(chosen, 0).otherwise(1), "pos")
    return pages.withColumn("new_pos", F.row_number().over(order) - 1)


def common_paper(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, short, long, n, paper): the commonest page size, to half a point; of equally common ones the larger."""
    short, long = F.least("width", "height"), F.greatest("width", "height")
    half = lambda c: F.floor(c * 2 + 0.5) / 2
    sizes = pages.groupBy(key, half(short).alias("s"), half(long).alias("l")).agg(F.count("*").alias("n"), F.min(F.struct("page_no", short.alias("short"), long.alias("long"))).alias("first"))
    best = sizes.groupBy(key).agg(F.max(F.struct("n", (F.col("first.short") * F.col("first.long")).alias("area"), "first")).alias("best"))
    s, l = F.col("best.first.short"), F.col("best.first.long")
    paper = F.lit(None).cast("string")
    for name, w, h in reversed(PAPERS):
        paper = F.when((F.abs(F.lit(w) - s) <= 2) & (F.abs(F.lit(h) - l) <= 2), name).otherwise(paper)
    return best.select(key, s.alias("short"), l.alias("long"), F.col("best.n").alias("n"), paper.alias("paper"))


def print_layout(width: Column, height: Column, paper_w_mm: Column, paper_h_mm: Column, actual: Column) -> Column:
    """Struct (sideways, scale, box_w_mm, box_h_mm): a page turned upright on the paper and fitted into its safe area."""
    sideways = width > height
    w, h = F.when(sideways, height).otherwise(width) * MM, F.when(sideways, width).otherwise(height) * MM
    fit = F.least((paper_w_mm - 2 * SAFE_EDGE_MM) / w, (paper_h_mm - 2 * SAFE_EDGE_MM) / h)
    scale = F.when(actual | fit.isNull() | (fit <= 0), F.lit(1.0)).otherwise(fit)
    return F.struct(sideways.alias("sideways"), scale.alias("scale"), (w * scale).alias("box_w_mm"), (h * scale).alias("box_h_mm"))


def preview_dpi(dpi: Column) -> Column:
    """Rounded up to a multiple of 8 within 24 and 200."""
    return F.least(F.lit(200), F.greatest(F.lit(24), F.ceil(dpi / 8) * 8)).cast("int")


def capped_scale(width: Column, height: Column, scale: Column, most_pixels: float = 64e6) -> Column:
    """``scale``, or the largest at which a page has so many pixels at most."""
    return F.least(scale, F.sqrt(F.lit(most_pixels) / (width * height)))


def estimated_size(pages: DataFrame, sample: int, key: str = "doc_id", size: str = "size") -> DataFrame:
    """(key, n, sampled, estimate): the size of a document from evenly spread pages (pos from 0)."""
    counts = pages.groupBy(key).agg(F.count("*").cast("int").alias("n"))
    chosen = counts.select(key, "n", F.explode(text.even_sample(F.col("n"), F.lit(sample))).alias("pos"))
    measured = chosen.join(pages.select(key, "pos", size), [key, "pos"]).groupBy(key, "n").agg(F.count("*").alias("sampled"), F.sum(size).alias("s"))
    return measured.select(key, "n", "sampled", F.bround(F.col("s") * F.col("n") / F.col("sampled")).cast("long").alias("estimate"))


def without_pages(recipe: DataFrame, gone: DataFrame, key: str = "recipe_id") -> DataFrame:
    """``recipe`` (key, pos, ...) without the pages ``gone`` (key, pos), numbered anew; a recipe that would lose all its pages stays as it is."""
    marked = recipe.join(gone.select(key, "pos", F.lit(1).alias("_gone")).distinct(), [key, "pos"], "left")
    whole = Window.partitionBy(key)
    marked = marked.withColumn("_all", F.count("*").over(whole) == F.count("_gone").over(whole))
    left = marked.where(F.col("_gone").isNull() | F.col("_all")).select(*recipe.columns)
    return left.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy("pos")) - 1)


def with_pages(recipe: DataFrame, copies: DataFrame, places: DataFrame, key: str = "recipe_id") -> DataFrame:
    """``recipe`` with the pages ``copies`` (same columns, in the order of their ``pos``) put before the place ``at`` of ``places`` (key, at), kept within the recipe; numbered anew."""
    sizes = recipe.groupBy(key).agg(F.count("*").alias("_n"))
    slots = places.join(sizes, key, "left").select(key, F.greatest(F.lit(0), F.least("at", F.coalesce("_n", F.lit(0)))).alias("_slot"))
    own = recipe.withColumn("_slot", F.row_number().over(Window.partitionBy(key).orderBy("pos")) - 1).withColumn("_own", F.lit(1))
    new = copies.select(*recipe.columns).join(slots, key).withColumn("_own", F.lit(0))
    order = Window.partitionBy(key).orderBy("_slot", "_own", "pos")
    return own.unionByName(new).withColumn("pos", F.row_number().over(order) - 1).select(*recipe.columns)


def duplicated(recipe: DataFrame, chosen: DataFrame, key: str = "recipe_id") -> DataFrame:
    """``recipe`` with copies of the pages ``chosen`` (key, pos), in their order, behind the last of them."""
    copies = recipe.join(chosen.select(key, "pos").distinct(), [key, "pos"], "left_semi")
    return with_pages(recipe, copies, copies.groupBy(key).agg((F.max("pos") + 1).alias("at")), key)


# Files over this size or number of pages are estimated from so many pages.
ESTIMATE_BYTES, ESTIMATE_PAGES, SAMPLE_PAGES = 40 * 1024 * 1024, 250, 20


def shrink_estimate(pages: DataFrame, coded: DataFrame) -> DataFrame:
    """(doc_id, level, bytes, percent, sampled): the size of documents after each level of compression.

    ``pages``: doc_id, page_no, bytes; ``coded``: doc_id, page_no, level, bytes. Large documents are measured on their first pages and scaled.
    """
    facts = pages.groupBy("doc_id").agg(F.sum("bytes").alias("total"), F.count("*").alias("n"), F.sum(F.when(F.col("page_no") <= SAMPLE_PAGES, F.col("bytes"))).alias("first"))
    facts = facts.withColumn("sampled", (F.col("total") > ESTIMATE_BYTES) | (F.col("n") > ESTIMATE_PAGES))
    rows = coded.join(facts, "doc_id").where(~F.col("sampled") | (F.col("page_no") <= SAMPLE_PAGES))
    sums = rows.groupBy("doc_id", "level").agg(F.sum("bytes").alias("out"), F.first("total").alias("total"), F.first("first").alias("first"), F.first("sampled").alias("sampled"))
    size = F.when(F.col("sampled"), F.floor(F.col("total") * F.col("out") / F.greatest("first", F.lit(1)))).otherwise(F.col("out")).cast("long")
    return sums.select("doc_id", "level", size.alias("bytes"), F.round(100 * size / F.greatest("total", F.lit(1)), 1).alias("percent"), "sampled")


def image_page(px_w: Column, px_h: Column, dpi_x: Column, dpi_y: Column) -> Column:
    """Struct (width, height) in points: the largest page of an image's ratio within an upright or lying A4; unequal resolutions correct the ratio."""
    uneven = (dpi_x > 0) & (dpi_y > 0) & (dpi_x != dpi_y)
    w, h = (F.when(uneven, px / dpi).otherwise(px) for px, dpi in ((px_w, dpi_x), (px_h, dpi_y)))
    short, long = F.lit(BLANK_SIZE[0]), F.lit(BLANK_SIZE[1])
    box_w, box_h = F.when(w > h, long).otherwise(short), F.when(w > h, short).otherwise(long)
    by_width = box_w / w <= box_h / h
    width = F.when(by_width, box_w).otherwise(F.least(box_w, w * box_h / h))
    height = F.when(by_width, F.least(box_h, h * box_w / w)).otherwise(box_h)
    known = (px_w > 0) & (px_h > 0)
    return F.struct(F.when(known, F.greatest(width, F.lit(1.0))).otherwise(short).alias("width"), F.when(known, F.greatest(height, F.lit(1.0))).otherwise(long).alias("height"))


def joined_texts(pages: DataFrame) -> DataFrame:
    """(doc_id, text): the selected texts of pages (doc_id, page_no, text, starts_blank, ends_blank) as one raw text.

    Pages follow after a line end, or after an empty paragraph if the selection ends with one or begins with one on the next page; pages without text don't count.
    """
    w = Window.partitionBy("doc_id").orderBy("page_no")
    rows = pages.where(F.trim(F.regexp_replace("text", r"\s", " ")) != "").withColumn("before", F.lag("ends_blank").over(w)).withColumn("first", F.lag("page_no").over(w).isNull())
    gap = F.when(F.col("first"), "").when(F.coalesce("before", F.lit(False)) | F.coalesce("starts_blank", F.lit(False)), "\n\n\n").otherwise("\n")
    parts = F.array_sort(F.collect_list(F.struct("page_no", F.concat(gap, "text").alias("part"))))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p.part), "").alias("text"))


def indented_text(lines: DataFrame, inset: float = 8.0) -> DataFrame:
    """(doc_id, text): lines (doc_id, pos, x0, text; null text: between pages) under each other, those over ``inset`` points in with four blanks."""
    least = F.min(F.when(F.col("text").isNotNull(), F.col("x0"))).over(Window.partitionBy("doc_id"))
    rows = lines.withColumn("least", least)
    part = F.when(F.col("text").isNull(), "").otherwise(F.concat(F.when(F.col("x0") - F.col("least") > inset, "    ").otherwise(""), "text"))
    parts = F.array_sort(F.collect_list(F.struct("pos", part.alias("part"))))
    return rows.groupBy("doc_id").agg(F.when(F.max("least").isNull(), "").otherwise(F.array_join(F.transform(parts, lambda p: p.part), "\n")).alias("text"))
