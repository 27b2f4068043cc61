"""Pages of a flow, over the lines of documents and over line items as items of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.operators import clicked, flow
from docloom.operators.spatial import PAGE
from docloom.plans.registry import query
from docloom.session import table

PAGE_HEIGHT = 700.0


def blocks_of(docs: DataFrame) -> DataFrame:
    """The lines of documents as blocks, a line of text for each 80 characters; a line that is a multiple of 97 characters long begins a page."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    size = F.length("line")
    return rows.select(
        "doc_id", "pos", (14.0 * F.greatest(F.lit(1), F.ceil(size / 80))).alias("height"), ((size % 4) * 3.0).alias("gap"),
        ((size % 97 == 0) & (size > 0)).alias("new_page"), F.lit(PAGE_HEIGHT).alias("page_height"),
    )


@query("""WITH RECURSIVE t AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
b AS (SELECT doc_id, pos, 14.0::DOUBLE * greatest(1, ceil(length(line) / 80)) AS height, (length(line) % 4) * 3.0::DOUBLE AS gap, length(line) % 97 = 0 AND line <> '' AS f FROM t),
s AS (SELECT *, sum(height + gap) OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM b),
n AS (SELECT a.doc_id, a.pos, min(z.pos) AS nxt FROM s a LEFT JOIN s z ON z.doc_id = a.doc_id AND z.pos > a.pos AND (z.f OR z.r - a.r + a.height > 700) GROUP BY a.doc_id, a.pos),
p AS (SELECT doc_id, 0::BIGINT AS pos FROM n GROUP BY doc_id UNION ALL SELECT n.doc_id, n.nxt FROM p JOIN n ON n.doc_id = p.doc_id AND n.pos = p.pos WHERE n.nxt IS NOT NULL)
SELECT n.doc_id, CAST(n.pos AS INTEGER) AS pos, CAST(count(p.pos) OVER (PARTITION BY n.doc_id ORDER BY n.pos) AS INTEGER) AS page_no FROM n LEFT JOIN p ON p.doc_id = n.doc_id AND p.pos = n.pos""")
def flow_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of each line of each document."""
    return flow.paginated(blocks_of(table(spark, sf_dir, "documents")))


_ITEMS = """i AS (SELECT l_suppkey AS doc_id, l_linenumber AS page_no, row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_orderkey, l_partkey, l_quantity, l_extendedprice) - 1 AS pos,
  l_partkey % 19 = 0 AS drawn, CAST(l_quantity AS BIGINT) AS q, l_orderkey AS o, l_partkey AS p FROM lineitem),
j AS (SELECT doc_id, page_no, pos, drawn, page_no * 100 + pos // 4 - CASE WHEN page_no > 1 AND pos < 4 AND doc_id % 3 = 0 THEN 100 ELSE 0 END AS para, pos % 4 + CASE WHEN pos < 4 AND doc_id % 3 = 0 THEN 4 ELSE 0 END AS line_no,
  o % 3 AS lead, 3 + q % 4 AS line, p % 5 AS gap, q % 20 AS height, 57 AS top, drawn AND p % 38 = 0 AND o % 7 = 0 AS whole FROM i)"""


def items_of(items: DataFrame) -> DataFrame:
    """Line items as lines, in paragraphs of four, and pictures of pages; every third document goes on with a paragraph over the end of a page."""
    pos = F.row_number().over(Window.partitionBy("l_suppkey", "l_linenumber").orderBy("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")) - 1
    rows = items.select(F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").alias("page_no"), pos.alias("pos"), (F.col("l_partkey") % 19 == 0).alias("drawn"), F.col("l_quantity").cast("long").alias("q"), F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p"))
    over = (F.col("pos") < 4) & (F.col("doc_id") % 3 == 0)
    para = F.col("page_no") * 100 + F.floor(F.col("pos") / 4) - F.when(over & (F.col("page_no") > 1), 100).otherwise(0)
    return rows.select(
        "doc_id", "page_no", "pos", "drawn", para.alias("para_no"), (F.col("pos") % 4 + F.when(over, 4).otherwise(0)).alias("line_no"),
        (F.col("o") % 3).alias("leading"), (3 + F.col("q") % 4).alias("line"), (F.col("p") % 5).alias("gap"), (F.col("q") % 20).alias("height"), F.lit(57).alias("top"),
        (F.col("drawn") & (F.col("p") % 38 == 0) & (F.col("o") % 7 == 0)).alias("whole"),
    )


@query(f"""WITH {_ITEMS}, k AS (SELECT *, lag(pos) OVER w IS NULL AS first, line_no > 0 AND NOT coalesce(lag(drawn) OVER w, true) AND lag(para) OVER w = para AS cont FROM j WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY pos)),
s AS (SELECT *, CASE WHEN drawn THEN height + CASE WHEN first THEN 0 ELSE gap END WHEN first THEN CASE WHEN line_no > 0 THEN 0 ELSE gap END + line + 2 * (lead // 2) WHEN cont THEN line + lead ELSE gap + line + 2 * (lead // 2) END AS step FROM k),
g AS (SELECT doc_id, page_no, 57 + sum(step) AS b, arg_max(drawn, pos) AS ld, arg_max(para, pos) AS lp, arg_min(drawn, pos) AS fd, arg_min(para, pos) AS fp, arg_min(gap, pos) AS fg, arg_min(height, pos) AS fh, arg_min(line, pos) AS fl, arg_min(lead, pos) AS fe FROM s GROUP BY ALL),
d AS (SELECT g.doc_id, g.page_no, g.b, CASE WHEN n.fd THEN g.b + n.fg + n.fh WHEN NOT g.ld AND g.lp = n.fp THEN g.b + n.fl + n.fe ELSE g.b + n.fg + n.fl + n.fe END AS nx,
  coalesce(NOT (NOT g.ld AND NOT n.fd AND g.lp = n.fp), true) AS ends FROM g LEFT JOIN g n ON n.doc_id = g.doc_id AND n.page_no = g.page_no + 1),
m AS (SELECT doc_id, max(b) AS deep, count(nx) AS n FROM d GROUP BY doc_id),
c AS (SELECT m.doc_id, x.b, (SELECT count(*) FROM d WHERE d.doc_id = m.doc_id AND nx IS NOT NULL AND NOT (d.b <= 842 - x.b AND 842 - x.b < nx)) AS bad FROM m, (SELECT unnest(range(1, 379)) AS b) x WHERE n > 0 AND 842 - x.b >= deep AND 842 - x.b <= 842 - 14.17),
e AS (SELECT doc_id, list(b ORDER BY b) AS bs FROM c WHERE bad = (SELECT min(bad) FROM c q WHERE q.doc_id = c.doc_id) GROUP BY doc_id),
w AS (SELECT m.doc_id, CASE WHEN n = 0 THEN greatest(1, floor(least(56.69, 842 - deep))) WHEN bs IS NOT NULL THEN bs[len(bs) // 2 + 1] ELSE greatest(1, floor(842 - deep)) END AS b FROM m LEFT JOIN e USING (doc_id)),
r AS (SELECT w.doc_id, list_filter([{", ".join(map(str, flow.ROUND_MARGINS))}], lambda x: x >= w.b AND x < w.b + 1)[1] AS nice FROM w),
z AS (SELECT d.doc_id, d.page_no FROM d JOIN w USING (doc_id) WHERE nx IS NOT NULL AND ends AND d.b <= 842 - w.b AND 842 - w.b >= nx UNION SELECT doc_id, unnest([page_no - 1, page_no]) FROM j WHERE whole),
y AS (SELECT doc_id, list(DISTINCT page_no ORDER BY page_no) AS breaks FROM z WHERE page_no >= 1 GROUP BY doc_id)
SELECT w.doc_id, greatest(1.0, coalesce(nice, w.b + 0.5))::DOUBLE AS margin, array_to_string(coalesce(breaks, []), ',') AS breaks FROM w JOIN r USING (doc_id) LEFT JOIN y USING (doc_id)""")
def flow_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bottom margin of each document and the pages behind which it gets breaks."""
    items = items_of(table(spark, sf_dir, "lineitem"))
    documents = items.select("doc_id").distinct().select("doc_id", F.lit(842.0).alias("page_height"), F.lit(None).cast("double").alias("most_depth"))
    found = flow.bottom_margins(flow.page_depths(items), documents, items.where("whole").select("doc_id", "page_no"))
    return found.select("doc_id", "margin", F.array_join("breaks", ",").alias("breaks"))


def set_lines_of(items: DataFrame) -> DataFrame:
    """Line items as lines of set pages: most reach the right edge, some are short, indented, hang or stand apart."""
    w = Window.partitionBy(*PAGE).orderBy("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")
    part, order = F.col("l_partkey"), F.col("l_orderkey")
    thick = F.when(order % 19 == 0, 14.0).otherwise(10.0)
    apart = F.when(part % 29 == 0, 30.0).when(part % 31 == 0, 3.0).otherwise(0.0)
    # Named before they are numbered, else Spark shuffles numbered lines by their page again.
    rows = items.withColumnsRenamed({"l_suppkey": "doc_id", "l_linenumber": "page_no"}).select(
        *PAGE, (F.row_number().over(w) - 1).alias("at"), F.sum(F.lit(12.0) + apart).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("top"), thick.alias("thick"),
        F.when(part % 7 == 0, 66.0).when(part % 13 < 3, 80.0).otherwise(50.0).alias("start"), F.when(order % 6 == 0, 300.0).when(order % 5 == 0, 524.0).otherwise(525.0).alias("end"),
    )
    return rows.select("doc_id", "page_no", "at", "top", (F.col("top") + F.col("thick")).alias("bottom"), "start", "end")


@query()
def clicked_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraph of each line of each page; tests hold it against a plain walk from each line."""
    return clicked.clicked_paragraphs(set_lines_of(table(spark, sf_dir, "lineitem")))
