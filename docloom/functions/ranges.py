"""The three page-range languages, each as one Column expression over (text, pages in the document).

A result is a struct of the pages (or ranges) and an error code, one of them null:
``empty``, ``bad_part``, ``below_one``, ``above_total``, ``none_chosen``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NO_PAGES = "array<int>"


def _bounds(part: Column, pattern: str, total: Column) -> Column:
    """Struct (low, high, code) of one part; open ends reach to the first and the last page."""
    first, last = F.regexp_extract(part, pattern, 1), F.regexp_extract(part, pattern, 2)
    single = part.rlike(r"^\d+$")
    number = F.regexp_extract(part, r"^(\d+)$", 1).try_cast("long")
    low = F.when(single, number).otherwise(F.when(first == "", F.lit(1)).otherwise(first.try_cast("long")))
    high = F.when(single, number).otherwise(F.when(last == "", total.cast("long")).otherwise(last.try_cast("long")))
    bad = ~single & (~part.rlike(pattern) | ((first == "") & (last == "")))
    return F.struct(low.alias("low"), high.alias("high"), bad.alias("bad"))


def _codes(bounds: Column, total: Column, ordered_first: bool) -> Column:
    """The code of the first part that is wrong, or null. ``ordered_first``: reversed ends are swapped before they are checked."""

    def code(b: Column) -> Column:
        below = (F.least(b.low, b.high) < 1) if ordered_first else ((b.low < 1) | (b.high < 1))
        return F.when(b.bad, "bad_part").when(below, "below_one").when(F.greatest(b.low, b.high) > total, "above_total")

    return F.get(F.array_compact(F.transform(bounds, code)), F.lit(0))


def _pages(bounds: Column) -> Column:
    spans = F.transform(bounds, lambda b: F.sequence(F.least(b.low, b.high).cast("int"), F.greatest(b.low, b.high).cast("int")))
    return F.array_sort(F.array_distinct(F.flatten(spans)))


def _as_set(parts: Column, pattern: str, total: Column, nothing: str) -> Column:
    bounds = F.transform(parts, lambda p: _bounds(p, pattern, total))
    code = F.when(F.size(parts) == 0, nothing).otherwise(_codes(bounds, total, ordered_first=False))
    # Spans are built only where all parts are right, so that none can be of any length.
    safe = F.when(code.isNull(), bounds).otherwise(F.slice(bounds, 1, 0))
    return F.struct(F.when(code.isNull(), _pages(safe)).alias("pages"), code.alias("error"))


def print_ranges(text: Column, total: Column) -> Column:
    """``1-3, 5; 8-``: blanks don't count, dashes of any kind, open ends; the pages as a sorted set."""
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", ""), ";", ","), "[–—]", "-")
    parts = F.filter(F.split(clean, ","), lambda p: p != "")
    out = _as_set(parts, r"^(\d*)-(\d*)$", total, "none_chosen")
    empty = F.struct(F.lit(None).cast(_NO_PAGES).alias("pages"), F.lit("empty").alias("error"))
    return F.when(clean == "", empty).otherwise(out)


def list_ranges(text: Column, total: Column) -> Column:
    """``1-3 5,8``: blanks separate as commas do, no open ends; the pages as a sorted set."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)[,;\s]+"), lambda p: p != "")
    return _as_set(parts, r"^(\d+)[-–](\d+)$", total, "empty")


def split_ranges(text: Column, total: Column) -> Column:
    """``1-3, 2, -4``: each range for itself, in order, overlaps and repeats kept, open ends."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), "[,;]+"), lambda p: F.regexp_replace(p, r"(?U)\s+", ""))
    parts = F.filter(parts, lambda p: p != "")
    bounds = F.transform(parts, lambda p: _bounds(p, r"^(\d*)[-–—](\d*)$", total))
    code = F.when(F.size(parts) == 0, "empty").otherwise(_codes(bounds, total, ordered_first=True))
    ranges = F.transform(bounds, lambda b: F.struct(F.least(b.low, b.high).cast("int").alias("low"), F.greatest(b.low, b.high).cast("int").alias("high")))
    return F.struct(F.when(code.isNull(), ranges).alias("ranges"), code.alias("error"))


def chosen_pages(mode: Column, text: Column, current: Column, total: Column) -> Column:
    """The pages of a selection: all, ``current`` (kept within the document) or ``range``."""
    one = F.array(F.least(F.greatest(F.coalesce(current, F.lit(1)), F.lit(1)), total).cast("int"))
    every = F.transform(F.sequence(F.lit(1), F.greatest(total, F.lit(1))), lambda i: i.cast("int"))
    right = lambda pages: F.struct(pages.alias("pages"), F.lit(None).cast("string").alias("error"))
    return F.when(mode == "current", right(one)).when(mode == "range", print_ranges(text, total)).otherwise(right(every))


def page_summary(pages: Column) -> Column:
    """``s. 2–4, 7``: runs of page numbers; of more than four runs the first three and the number of pages."""
    numbers = F.array_sort(F.array_distinct(pages))
    start = F.struct(F.array().cast("array<struct<low:int,high:int>>").alias("runs"))

    def add(state: Column, n: Column) -> Column:
        last = F.get(state.runs, F.size(state.runs) - 1)
        longer = F.concat(F.slice(state.runs, F.lit(1), F.size(state.runs) - 1), F.array(F.struct(last.low.alias("low"), n.alias("high"))))
        more = F.concat(state.runs, F.array(F.struct(n.alias("low"), n.alias("high"))))
        return F.struct(F.when((F.size(state.runs) > 0) & (last.high + 1 == n), longer).otherwise(more).alias("runs"))

    runs = F.aggregate(numbers, start, add, lambda s: s.runs)
    texts = F.transform(runs, lambda r: F.when(r.low == r.high, r.low.cast("string")).otherwise(F.concat_ws("–", r.low.cast("string"), r.high.cast("string"))))
    short = F.concat(F.array_join(F.slice(texts, 1, 3), ", "), F.lit(" … ("), F.size(numbers).cast("string"), F.lit(" sayfa)"))
    body = F.when(F.size(texts) > 4, short).otherwise(F.array_join(texts, ", "))
    return F.when(F.size(numbers) == 0, "").otherwise(F.concat(F.lit("s. "), body))
