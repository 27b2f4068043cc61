"""Files and their contents, strips and groups of boxes, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import convert, layout
from docloom.plans.registry import query
from docloom.plans.table_queries import strokes_of
from docloom.session import scratch_path, table
from docloom.sources import sinks, udf_file


@query("SELECT doc_id, sha256(coalesce(text, '')) AS stamp FROM documents")
def file_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What tells whether a document's file changed."""
    return table(spark, sf_dir, "documents").select("doc_id", sinks.stamp(F.coalesce("text", F.lit("")).cast("binary")).alias("stamp"))


@query("SELECT doc_id, text FROM documents WHERE text IS NOT NULL")
def decoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written in several encodings and read back by their marks."""
    text, kind = F.col("text"), F.col("doc_id") % 4
    marked = (
        F.when(kind == 0, F.concat(F.unhex(F.lit("FFFE")), F.encode(text, "UTF-16LE")))
        .when(kind == 1, F.concat(F.unhex(F.lit("FEFF")), F.encode(text, "UTF-16BE")))
        .when(kind == 2, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(text, "UTF-8")))
        .otherwise(F.encode(text, "UTF-8"))
    )
    files = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("path"), marked.alias("content"))
    return udf_file.texts(files).select(F.col("path").cast("long").alias("doc_id"), "text")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN 'word' END AS kind, CASE doc_id % 3 WHEN 0 THEN 'doc' WHEN 1 THEN 'sifreli' END AS sub FROM documents""")
def ole_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of old office files by the names of their streams, which stand behind other bytes."""
    names = {0: "WordDocument", 1: "EncryptedPackage", 2: "Book"}
    stream = F.element_at(F.array(*[F.lit(n.encode("utf-16-le").hex()) for n in names.values()]), (F.col("doc_id") % 3).cast("int") + 1)
    content = F.concat(F.unhex(F.lit("D0CF11E0A1B11AE1")), F.encode(F.col("source"), "UTF-8"), F.unhex(stream), F.encode(F.col("lang"), "UTF-8"))
    return table(spark, sf_dir, "documents").select("doc_id", convert.ole2_kind(content).alias("k")).select("doc_id", "k.*")


@query("""SELECT conv_id AS doc_id, false AS signed, '1.8' AS format_id, '1' AS paper FROM conversations GROUP BY conv_id""")
def archive_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What archives say of themselves at their beginning, conversations having been written as such."""
    lines = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("para_no"), F.coalesce("text", F.lit("")).alias("text"))
    path = scratch_path(spark, "archives")
    sinks.archives(lines).write.parquet(path)
    files = spark.read.parquet(path).select(F.col("doc_id").cast("string").alias("path"), "content")
    return udf_file.summary(files).select(F.col("path").cast("long").alias("doc_id"), "signed", "format_id", "paper")


@query("""WITH k AS (SELECT l_suppkey AS doc_id, l_linenumber AS page_no, ['header', 'footer', 'number'][CAST(l_partkey % 3 AS INTEGER) + 1] AS kind FROM lineitem WHERE l_linenumber > l_suppkey % 4),
p AS (SELECT l_suppkey AS doc_id, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY l_suppkey)
SELECT doc_id, kind, min(page_no) AS page_no, kind = 'header' AND max(n) > 1 AND min(page_no) > 1 AS late FROM k JOIN p USING (doc_id) WHERE kind <> 'number' GROUP BY doc_id, kind""")
def header_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page whose header or footer stands for all."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").alias("page_no"), "l_partkey")
    kind = F.element_at(F.array(*map(F.lit, ("header", "footer", "number"))), (F.col("l_partkey") % 3).cast("int") + 1)
    kinds = items.where("page_no > doc_id % 4").select("doc_id", "page_no", kind.alias("kind"))
    return layout.header_starts(kinds, items.select("doc_id", "page_no").distinct())


@query("""WITH b AS (SELECT l_suppkey AS doc_id, l_linenumber AS page_no, l_partkey % 2 = 1 AS upright, l_quantity * 8 AS x0, (l_orderkey % 60) * 12 + l_partkey % 5 AS y0, l_quantity * 8 + 9 + l_partkey % 30 AS x1, (l_orderkey % 60) * 12 + l_partkey % 5 + 4 + l_orderkey % 13 AS y1 FROM lineitem),
m AS (SELECT *, CASE WHEN upright THEN (x0 + x1) / 2 ELSE (y0 + y1) / 2 END AS middle, CASE WHEN upright THEN x1 - x0 ELSE y1 - y0 END AS thick, CASE WHEN upright THEN x1 ELSE y1 END AS far FROM b),
s AS (SELECT *, CASE WHEN middle < lag(far) OVER w AND greatest(thick, lag(thick) OVER w) < 2 * least(thick, lag(thick) OVER w) THEN 0 ELSE 1 END AS n FROM m WINDOW w AS (PARTITION BY doc_id, page_no, upright ORDER BY middle, far, x0, y0, x1, y1)),
c AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, page_no, upright ORDER BY middle, far, x0, y0, x1, y1 ROWS UNBOUNDED PRECEDING) AS strip FROM s),
g AS (SELECT doc_id, page_no, upright, strip, min(x0) AS x0, min(y0)::DOUBLE AS y0, max(x1) AS x1, max(y1)::DOUBLE AS y1 FROM c GROUP BY ALL)
SELECT doc_id, page_no, CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY upright, strip) - 1 AS INTEGER) AS strip_no, upright, x0, y0, x1, y1 FROM g""")
def line_strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of one line as one strip."""
    x, y, part = F.col("l_quantity") * 8, ((F.col("l_orderkey") % 60) * 12 + F.col("l_partkey") % 5).cast("double"), F.col("l_partkey")
    boxes = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").alias("page_no"), x.alias("x0"), y.alias("y0"), (x + 9 + part % 30).alias("x1"), (y + 4 + F.col("l_orderkey") % 13).alias("y1"), (90.0 * (part % 4) + part % 9).alias("angle")
    )
    return layout.line_strips(boxes)


@query()
def connected_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strokes that meet, in groups; tests hold groups against a plain comparison of all pairs."""
    strokes = strokes_of(table(spark, sf_dir, "lineitem")).select("doc_id", "page_no", "stroke", "x0", "y0", "x1", "y1")
    return layout.connected_groups(strokes, 3.0, 1.0).select("doc_id", "page_no", "stroke", "group_no")
