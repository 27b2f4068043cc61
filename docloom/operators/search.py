"""Literal search over page texts: patterns, hits, counts and their order.

A query is a literal. Its blanks match any run of white space, and around signs blanks may stand.
Texts are compared in a form that keeps their length, so positions are those of the text.
"""

from __future__ import annotations

import unicodedata
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.arrays import bind, spans
from docloom.functions.text import GLYPHS_SAME_LENGTH, search_form

#: Signs that mean something else in an expression.
SIGNS = frozenset(r".*+?^${}()|[]\/")
HIT = "array<struct<start:int,end:int>>"
#: Order of the kinds of hits within a document.
KINDS = {"text": 0, "outline": 1, "comment": 2}


def normal_query(query: str, case_sensitive: bool = False) -> str:
    """The query in the form that texts are compared in."""
    repaired = query.translate(str.maketrans(GLYPHS_SAME_LENGTH))
    if case_sensitive:
        return repaired
    lowered = ((c, {"İ": "i", "I": "ı"}.get(c) or c.lower()) for c in repaired)
    return "".join(low if len(low) == len(c) else c for c, low in lowered)


def _kind(place: tuple[int, str]) -> tuple[str, int]:
    """Letters and digits are of one kind, each sign of its own."""
    return ("word", 0) if unicodedata.category(place[1])[0] in "LN" else ("sign", place[0])


def search_pattern(query: str) -> str:
    """The regular expression of a normalised query; empty for a blank one. Valid for Java and Python with Unicode on.

    Each part between blanks is cut in words and signs, which blanks may part.
    """

    def tokens(part: str) -> list[str]:
        found = ["".join(c for _, c in run) for _, run in groupby(enumerate(part), key=_kind)]
        return ["\\" + token if token in SIGNS else token for token in found]

    return r"\s+".join(r"\s*".join(tokens(part)) for part in query.split())


def hit_count(text: Column, query: str, case_sensitive: bool = False) -> Column:
    """The number of non-overlapping matches in a text; 0 for null texts and blank queries."""
    pattern = search_pattern(normal_query(query, case_sensitive))
    if not pattern:
        return F.lit(0)
    return F.coalesce(F.regexp_count(search_form(text, case_sensitive), F.lit("(?U)" + pattern)), F.lit(0))


def positions(text: Column, query: str, case_sensitive: bool = False, whole_word: bool = False) -> Column:
    """Structs (start, end) of the non-overlapping matches, in code points, from matches and the gaps between them.

    ``whole_word``: only those that no letter or digit touches. They are filtered after matching, so what was taken stays taken.
    """
    pattern = search_pattern(normal_query(query, case_sensitive))
    nothing = F.array().cast(HIT)
    if not pattern:
        return nothing

    def matched(form: Column) -> Column:
        found = F.regexp_extract_all(form, F.lit("(?U)(" + pattern + ")"), F.lit(1))
        parts = F.struct(found.alias("found"), F.split(form, "(?U)" + pattern, -1).alias("pieces"))
        placed = bind(parts, lambda p: free_of_words(p.pieces, p.found) if whole_word else spans(p.pieces, p.found))
        return F.when(form.rlike("(?U)" + pattern), placed).otherwise(nothing)

    return bind(search_form(text, case_sensitive), matched)


def free_of_words(pieces: Column, found: Column) -> Column:
    """The spans of the matches ``found`` between ``pieces`` with neither a letter nor a digit on either side."""
    n, is_word = F.size(found), r"[\p{L}\p{N}]"
    before = F.zip_with(F.slice(pieces, F.lit(1), n), F.concat(F.array(F.lit("")), F.slice(found, F.lit(1), n - 1)), lambda gap, m: F.right(F.concat(m, gap), F.lit(1)).rlike(is_word))
    after = F.zip_with(F.slice(pieces, F.lit(2), n), F.concat(F.slice(found, F.lit(2), n - 1), F.array(F.lit(""))), lambda gap, m: F.left(F.concat(gap, m), F.lit(1)).rlike(is_word))
    touched = F.zip_with(before, after, lambda a, b: a | b)
    marked = F.filter(F.zip_with(spans(pieces, found), touched, lambda s, t: F.struct(s.alias("span"), t.alias("touched"))), lambda m: ~m.touched)
    return F.transform(marked, lambda m: m.span)


def search(pages: DataFrame, query: str, case_sensitive: bool = False, whole_word: bool = False, text: str = "text") -> DataFrame:
    """``pages`` with a row for each hit: ``start`` and ``end``. Null texts have none."""
    return pages.select("*", F.inline(positions(F.col(text), query, case_sensitive, whole_word)))


def count_by_document(pages: DataFrame, query: str, case_sensitive: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, hits): the matches in all pages of each document."""
    return pages.groupBy(key).agg(F.sum(hit_count(F.col(text), query, case_sensitive)).alias("hits"))


def one_hit_each(hits: DataFrame, *key: str) -> DataFrame:
    """Hits of several searches, each place once."""
    return hits.dropDuplicates(list(key or ("doc_id", "page_no", "start")))


def in_order(hits: DataFrame) -> DataFrame:
    """``hits`` (doc_order, kind, page_no, start, pos) with their ``rank`` in the list of results of each document order."""
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    is_text = F.col("kind") == "text"
    order = [F.element_at(kinds, F.col("kind")), F.when(is_text, F.col("page_no")), F.when(is_text, F.col("start")), "pos"]
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("doc_order").orderBy(*order)))


def from_page(hits: DataFrame, current: Column, n_pages: Column) -> DataFrame:
    """Hits with ``turn``: how many pages on from the current page they lie, around the end of the document."""
    return hits.withColumn("turn", F.pmod(F.col("page_no") - current, n_pages))


def first_from(hits: DataFrame, page: int, key: str = "doc_id") -> DataFrame:
    """The first hit on or after a page in each document, or its very first."""
    place = F.struct("page_no", "start")
    on = F.min(F.when(F.col("page_no") >= page, place))
    return hits.groupBy(key).agg(F.coalesce(on, F.min(place)).alias("hit")).select(key, "hit.*")


def neighbour(index: Column, step: int, n: Column) -> Column:
    """The index of the next or previous hit, around the ends."""
    return F.pmod(index + step, n)


def recognised_only(hits: DataFrame, recognised_from: Column) -> DataFrame:
    """Hits that begin in the recognised part of a page's text."""
    return hits.where(F.col("start") >= recognised_from)


def page_texts(items: DataFrame) -> DataFrame:
    """(doc_id, page_no, text, recognised_from): items (pos, str, eol, recognised) joined in order.

    Recognised words follow the page's own text after a line end that belongs to no item.
    """
    place = F.struct(F.col("recognised").alias("late"), "pos", F.concat(F.col("str"), F.when(F.col("eol"), "\n").otherwise("")).alias("part"))
    pages = items.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(place)).alias("parts"))
    joined = lambda late: F.array_join(F.transform(F.filter("parts", lambda p: p.late == late), lambda p: p.part), "")
    own, read = joined(False), joined(True)
    gap = F.when((own != "") & F.exists("parts", lambda p: p.late), "\n").otherwise("")
    return pages.select("doc_id", "page_no", F.concat(own, gap, read).alias("text"), (F.length(own) + F.length(gap)).alias("recognised_from"))
