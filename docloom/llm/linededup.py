"""Line dedup by overlapping three-line windows, by DataFrame functions alone.

A text is split at newlines; each ``width`` consecutive lines with a character other than white
space in them are one window, known by two 64-bit hashes of its lines. Of the windows with equal
hashes anywhere in the table the first stays, by document id, then text hash, then line; the lines
that any later one covers are removed, so overlapping repeats merge.

Repeated windows are found by a grouped minimum, which combines before its shuffle, and only
windows that repeat are joined back. The join is an inner equi-join on the window's hash, whose
hot keys adaptive execution splits; no group of copies is gathered or paired. What a document loses
(its id and window starts) is broadcast to the texts while there are at most ``MOST_DOCUMENTS`` of
them with ``MOST_STARTS`` starts, so that texts stay where they are; beyond that both are shuffled.

Defined results: null texts stay null and have no lines; texts under three lines stay; null ids
come last in the order; rows equal in id and text count as one document and are treated alike;
an empty table gives no rows; other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import unlike, written

WIDTH = 3
MOST_DOCUMENTS, MOST_STARTS = 1_000_000, 4_000_000


def _windows(width: int) -> Column:
    """Structs (pos, h1, h2) of a text's windows; ``pos`` counts lines from 0."""
    lines, at = F.col("lines"), F.sequence(F.lit(1), F.size("lines") - (width - 1))

    def window(i: Column) -> Column:
        rows = [F.element_at(lines, i + k) for k in range(width)]
        blank = F.trim(F.regexp_replace(F.concat(*rows), r"\s+", "")) == ""
        return F.when(~blank, F.struct((i - 1).alias("pos"), F.xxhash64(*rows).alias("h1"), F.xxhash64(F.lit("second"), *rows).alias("h2")))

    return F.when(F.size(lines) >= width, F.array_compact(F.transform(at, window)))


def covered_lines(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, text_hash, starts): the windows of each document that repeat an earlier one, by their first lines."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.split("text", "\n", -1).alias("lines"))
    windows = rows.select("doc_id", "text_hash", F.explode(_windows(width)).alias("w")).select("doc_id", "text_hash", "w.*")
    windows = written(windows, "windows")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "pos")
    # Rows equal in id and text give equal places, so a window is repeated if its places differ.
    repeated = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("latest"))
    repeated = repeated.where("first <> latest").select("h1", "h2", "first")
    later = windows.join(repeated, ["h1", "h2"]).where(place != F.col("first"))
    return later.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("starts"))


def dedup_lines(docs: DataFrame, width: int = WIDTH, total: str = "lines_total", removed: str = "lines_removed") -> DataFrame:
    """``docs`` with ``text`` cleaned, and the columns ``total`` and ``removed`` (long), of whatever name is free for them."""
    covered_id, covered_hash, starts_name = unlike(docs, "covered_id", "covered_hash", "starts")
    found = covered_lines(docs, width).select(F.col("doc_id").alias(covered_id), F.col("text_hash").alias(covered_hash), F.col("starts").alias(starts_name))
    found = written(found, "covered")
    starts = F.col(starts_name)
    documents, number = found.agg(F.count("*"), F.coalesce(F.sum(F.size(starts)), F.lit(0))).first()
    if documents <= MOST_DOCUMENTS and number <= MOST_STARTS:
        found = F.broadcast(found)
    same = F.col(covered_id).eqNullSafe(F.col("doc_id")) & (F.col(covered_hash) == F.xxhash64("text"))
    lines = F.split("text", "\n", -1)
    covered = F.array_distinct(F.flatten(F.transform(starts, lambda s: F.array(*[s + k for k in range(width)]))))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered)
    kept = F.array_join(F.transform(stay, lambda i: F.element_at(lines, i + 1)), "\n")
    columns = [F.when(starts.isNull(), F.col("text")).otherwise(kept).alias("text") if c == "text" else F.col(c) for c in docs.columns]
    counts = [F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)), F.when(starts.isNull(), 0).otherwise(F.size(covered))]
    return docs.join(found, same, "left").select(*columns, *[c.cast("long").alias(name) for c, name in zip(counts, unlike(docs, total, removed), strict=True)])


ORACLE_SQL = """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, i, s[i] || chr(10) || s[i+1] || chr(10) || s[i+2] AS h
  FROM (SELECT doc_id, s, unnest(range(1, len(s) - 1)) AS i FROM l WHERE len(s) >= 3)),
o AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n
  FROM w WHERE regexp_replace(h, '\\s+', '', 'g') <> ''),
c AS (SELECT doc_id, list(DISTINCT i + k) AS covered FROM o, range(3) AS r(k) WHERE n > 1 GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(l.s), 0) AS BIGINT) AS lines_total, CAST(coalesce(len(covered), 0) AS BIGINT) AS lines_removed,
  CASE WHEN covered IS NULL THEN d.text
  ELSE array_to_string([l.s[x] for x in range(1, len(l.s) + 1) if NOT list_contains(covered, x)], chr(10)) END AS text
FROM documents d LEFT JOIN l ON d.doc_id = l.doc_id LEFT JOIN c ON d.doc_id = c.doc_id
"""
