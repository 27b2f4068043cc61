"""Layout operators over boxes derived from the driver's rows, and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.operators import layout
from docloom.plans.derived import Patterns
from docloom.plans.registry import query
from docloom.session import table

#: Line items as lines on pages: a supplier is a document, a line number a page.
_LINES = """l AS (SELECT l_suppkey AS doc_id, l_linenumber AS page_no, l_orderkey AS block, l_partkey AS line, l_quantity * 8 AS x0,
  (l_partkey % 60) * 12.0::DOUBLE AS y0, l_quantity * 9 + 100 AS x1, (l_partkey % 60) * 12.0::DOUBLE + 8 + (l_partkey % 5) AS y1,
  l_returnflag || ' ' || (l_orderkey % 50) AS text, 700.0::DOUBLE AS page_width, 720.0::DOUBLE AS page_height FROM lineitem)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = (F.col("l_partkey") % 60) * 12.0
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("doc_id"),
        F.col("l_linenumber").alias("page_no"),
        F.col("l_orderkey").alias("block"),
        F.col("l_partkey").alias("line"),
        (F.col("l_quantity") * 8).alias("x0"),
        y.alias("y0"),
        (F.col("l_quantity") * 9 + 100).alias("x1"),
        (y + 8 + F.col("l_partkey") % 5).alias("y1"),
        F.concat_ws(" ", "l_returnflag", (F.col("l_orderkey") % 50).cast("string")).alias("text"),
        F.lit(700.0).alias("page_width"),
        F.lit(720.0).alias("page_height"),
    )


_COLUMN = "least(a.x1, b.x1) - greatest(a.x0, b.x0) > 0.3 * greatest(1.0, least(a.x1 - a.x0, b.x1 - b.x0))"


@query(f"""WITH {_LINES}, g AS (SELECT a.doc_id, a.page_no, a.block, a.line, min(b.y0 - a.y0) AS gap FROM l a JOIN l b ON a.doc_id = b.doc_id AND a.page_no = b.page_no
  AND {_COLUMN} AND b.y0 - a.y0 > 0.5 * (a.y1 - a.y0) AND b.y0 - a.y0 <= 3 * (a.y1 - a.y0) GROUP BY ALL)
SELECT doc_id, page_no, median(gap) AS pitch FROM g GROUP BY doc_id, page_no""")
def line_pitch_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usual distance of lines on each page."""
    return layout.line_pitch(_lines(spark, sf_dir))


@query(f"""WITH {_LINES}, p AS (SELECT a.doc_id, a.page_no, a.block, a.line, b.x0 AS x, b.x1 AS r FROM l a JOIN l b ON a.doc_id = b.doc_id AND a.page_no = b.page_no AND {_COLUMN}),
n AS (SELECT *, lead(x) OVER (PARTITION BY doc_id, page_no, block, line ORDER BY x) AS nx FROM p)
SELECT doc_id, page_no, block, line, coalesce(min(x) FILTER (nx - x <= 1.5), min(x)) AS "left", max(r) AS "right" FROM n GROUP BY doc_id, page_no, block, line""")
def column_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The column of each line."""
    return layout.column_bounds(_lines(spark, sf_dir))


@query(f"""WITH {_LINES} SELECT a.doc_id, a.page_no, a.block, a.line, min(a.y0 - b.y0) FILTER (a.y0 > b.y0) AS above, min(b.y0 - a.y0) FILTER (b.y0 > a.y0) AS below
FROM l a LEFT JOIN l b ON a.doc_id = b.doc_id AND a.page_no = b.page_no AND least(a.x1, b.x1) > greatest(a.x0, b.x0) AND b.y1 - b.y0 >= 0.7 * (a.y1 - a.y0) AND abs(a.y0 - b.y0) > 0.5 * (a.y1 - a.y0) GROUP BY ALL""")
def neighbour_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest lines above and below each line."""
    return layout.neighbours(_lines(spark, sf_dir))


@query(f"""WITH {_LINES}, z AS (SELECT doc_id, page_no, CAST(round_even(y0, 0) AS INTEGER) AS y, regexp_replace(text, '[0-9]+', '#', 'g') AS masked, text, y0 > page_height * 0.84 AS low FROM l WHERE y0 < page_height * 0.16 OR y0 > page_height * 0.84),
d AS (SELECT doc_id, greatest(2, ceil(count(DISTINCT page_no) * 0.6)) AS need FROM l GROUP BY doc_id HAVING count(DISTINCT page_no) >= 2),
o AS (SELECT doc_id, page_no, y, masked, min(text) AS text, bool_or(low) AS low FROM z GROUP BY ALL),
k AS (SELECT doc_id, y, masked, count(*) AS n, bool_or(low) AS low FROM o GROUP BY ALL),
r AS (SELECT k.doc_id, k.y, k.masked, k.low, sum(b.n) AS around FROM k JOIN k b ON b.doc_id = k.doc_id AND b.masked = k.masked AND b.y BETWEEN k.y - 2 AND k.y + 2 GROUP BY ALL),
w AS (SELECT doc_id, masked, max(c) AS same, bool_and(regexp_full_match(trim(text), '\\D{{0,24}}?\\d{{1,4}}(\\s*(/|-|of)\\s*\\d{{1,4}})?\\D{{0,16}}')) AS numbers FROM (SELECT doc_id, masked, text, count(*) AS c FROM o GROUP BY ALL) GROUP BY ALL)
SELECT r.doc_id, r.y, r.masked, CAST(around AS BIGINT) AS around, same FROM r JOIN w USING (doc_id, masked) JOIN d USING (doc_id) WHERE around >= need AND (same >= need OR (low AND numbers))""")
def header_footer_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that repeat at the top or bottom of most pages."""
    return layout.repeated_lines(_lines(spark, sf_dir).withColumn("y", F.col("y0")))


@query(f"""WITH {_LINES}, m AS (SELECT *, (SELECT count(*) FROM l b WHERE b.doc_id = a.doc_id AND b.x0 BETWEEN a.x0 - 1 AND a.x0 + 1) AS mates, min(x0) OVER (PARTITION BY doc_id) AS least, max(x1) OVER (PARTITION BY doc_id) AS most FROM l a),
d AS (SELECT doc_id, coalesce(min(x0) FILTER (mates >= 2 AND x0 - least <= 30), min(x0)) AS "left", max(x1) AS far, count(*) FILTER (x1 >= most - 3) AS reach, count(*) AS n, max(page_width) AS w FROM m GROUP BY doc_id)
SELECT doc_id, "left", CASE WHEN reach >= greatest(2.0, 0.12 * n) THEN far - 0.3 ELSE greatest(far, w - "left") END AS "right" FROM d""")
def text_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text area of each document."""
    return layout.text_area(_lines(spark, sf_dir))


@query(f"""WITH {_LINES}, s AS (SELECT doc_id, CASE WHEN block % 3 = 0 THEN 'Arial' ELSE 'Times' END AS family, CAST(line % 4 AS INTEGER) AS size, sum(length(text)) AS weight, min(block * 10 + page_no) AS first FROM l GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, first) AS k FROM s) SELECT doc_id, family, size FROM r WHERE k = 1""")
def dominant_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The style of most characters of each document."""
    parts = _lines(spark, sf_dir).select("doc_id", F.when(F.col("block") % 3 == 0, "Arial").otherwise("Times").alias("family"), (F.col("line") % 4).cast("int").alias("size"), "text", (F.col("block") * 10 + F.col("page_no")).alias("pos"))
    return layout.dominant_style(parts, ["doc_id"])


@query(f"""WITH {_LINES}, o AS (SELECT *, max(y1) OVER (PARTITION BY doc_id, page_no ORDER BY y0, y1, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM l),
f AS (SELECT *, CAST(sum(CASE WHEN y0 > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_no ORDER BY y0, y1, block ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS row_no FROM o) SELECT doc_id, page_no, block, row_no FROM f""")
def row_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes in rows by overlap of height."""
    return layout.row_groups(_lines(spark, sf_dir)).select("doc_id", "page_no", "block", "row_no")


@query(f"WITH {_LINES} SELECT doc_id, page_no, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM l GROUP BY doc_id, page_no")
def content_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box around all of a page, from two relations."""
    lines = _lines(spark, sf_dir)
    return layout.content_box(lines.where("block % 2 = 0"), lines.where("block % 2 = 1"))


@query(f"""WITH {_LINES}, k AS (SELECT * FROM l WHERE block % 40 = 1)
SELECT doc_id, page_no, block FROM l w WHERE EXISTS (SELECT 1 FROM k WHERE k.doc_id = w.doc_id AND k.page_no = w.page_no AND (w.x0 + w.x1) / 2 BETWEEN k.x0 AND k.x1 AND (w.y0 + w.y1) / 2 BETWEEN k.y0 AND k.y1)""")
def box_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words whose centre is in a selection."""
    lines = _lines(spark, sf_dir)
    return layout.selected(lines, lines.where("block % 40 = 1")).select("doc_id", "page_no", "block")


_OVER = "least(w.x1, k.x1) - greatest(w.x0, k.x0)", "least(w.y1, k.y1) - greatest(w.y0, k.y0)"


@query(f"""WITH {_LINES}, k AS (SELECT * FROM l WHERE block % 40 = 1)
SELECT doc_id, page_no, block FROM l w WHERE block % 40 <> 1 AND NOT EXISTS (SELECT 1 FROM k WHERE k.doc_id = w.doc_id AND k.page_no = w.page_no AND {_OVER[0]} > 0 AND {_OVER[1]} > 0
  AND ({_OVER[0]}) * ({_OVER[1]}) >= 0.3 * greatest(1e-6, least((w.x1 - w.x0) * (w.y1 - w.y0), (k.x1 - k.x0) * (k.y1 - k.y0))))""")
def overlap_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised words that no real word covers."""
    lines = _lines(spark, sf_dir)
    return layout.not_covered(lines.where("block % 40 <> 1"), lines.where("block % 40 = 1")).select("doc_id", "page_no", "block")


@query("""WITH g AS (SELECT user_id, epoch_us(ts) / 1e6 AS t FROM events), s AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) > 3600 THEN 1 ELSE 0 END AS n FROM g),
c AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS cluster FROM s)
SELECT user_id, CAST(cluster AS BIGINT) AS cluster, round(avg(t), 3) AS centre, count(*) AS n FROM c GROUP BY ALL""")
def cluster_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that chain within a tolerance, and their means."""
    times = table(spark, sf_dir, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return layout.clusters(times, ["user_id"], "t", 3600.0).withColumn("centre", F.round("centre", 3))


@query(f"""WITH {_LINES}, p AS (SELECT doc_id, page_no, block, y0 + (line % 3) * 0.7 AS y, x0 + block / 1e6 AS x0 FROM l),
s AS (SELECT *, CASE WHEN abs(y - lag(y) OVER w) >= 1.5 THEN 1 ELSE 0 END AS n FROM p WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY round_even(y, 0), x0))
SELECT doc_id, page_no, block, CAST(sum(n) OVER (PARTITION BY doc_id, page_no ORDER BY round_even(y, 0), x0 ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM s""")
def baseline_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts on the same baseline."""
    parts = _lines(spark, sf_dir).select("doc_id", "page_no", "block", (F.col("y0") + (F.col("line") % 3) * 0.7).alias("y"), (F.col("x0") + F.col("block") / 1e6).alias("x0"))
    return layout.baseline_lines(parts).select("doc_id", "page_no", "block", "cluster")


#: Line items as words: six blocks on a page, thirty lines.
_WORDS = """w AS (SELECT l_suppkey AS doc_id, l_linenumber AS page_no, l_orderkey % 6 AS block, l_orderkey % 30 AS line, row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_orderkey, l_partkey, l_quantity, l_extendedprice) AS word_no,
  l_quantity * 8 AS x0, (l_orderkey % 30) * 12.0::DOUBLE AS y0, l_quantity * 8 + 20 AS x1, (l_orderkey % 30) * 12.0::DOUBLE + 9 + l_partkey % 3 AS y1, l_returnflag || l_partkey % 100 AS text FROM lineitem)"""


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.row_number().over(Window.partitionBy("l_suppkey", "l_linenumber").orderBy("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice"))
    top = (F.col("l_orderkey") % 30) * 12.0
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").alias("page_no"), (F.col("l_orderkey") % 6).alias("block"), (F.col("l_orderkey") % 30).alias("line"), number.alias("word_no"), (F.col("l_quantity") * 8).alias("x0"),
        top.alias("y0"), (F.col("l_quantity") * 8 + 20).alias("x1"), (top + 9 + F.col("l_partkey") % 3).alias("y1"), F.concat("l_returnflag", (F.col("l_partkey") % 100).cast("string")).alias("text"),
    )


@query(f"""WITH {_WORDS} SELECT doc_id, page_no, block, line, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, string_agg(text, ' ' ORDER BY x0, word_no) AS text, count(*) AS n,
  count(*) OVER (PARTITION BY doc_id, page_no, block) AS block_lines, min(min(x0)) OVER (PARTITION BY doc_id, page_no, block) AS block_left FROM w GROUP BY doc_id, page_no, block, line""")
def words_to_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words as lines, with facts of their blocks."""
    return layout.block_facts(layout.lines_of_words(_words(spark, sf_dir)))


@query(f"""WITH {_WORDS}, l AS (SELECT doc_id, page_no, block, line, min(x0) AS x0, min(y0) AS y0, string_agg(text, ' ' ORDER BY x0, word_no) AS text FROM w GROUP BY ALL)
SELECT doc_id, page_no, string_agg(text, chr(10) ORDER BY y0, x0, block, line, text) AS text FROM l GROUP BY ALL""")
def page_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of each page in reading order."""
    return layout.page_texts(_words(spark, sf_dir))


def _spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as small pictures that stand about on pages."""
    x, y = (F.col("l_orderkey") * 37 % 600).cast("double"), (F.col("l_partkey") * 53 % 790).cast("double")
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").alias("page_no"), x.alias("x0"), y.alias("y0"), (x + 4 + F.col("l_quantity") % 30).alias("x1"), (y + 5 + F.col("l_linenumber") * 3).alias("y1"))


@query()
def connected_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Touching boxes as one; boxes that grow, so tests hold it against a plain loop."""
    return layout.merged_boxes(_spots(spark, sf_dir))


@query()
def ocr_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of pages that may hold unread text; tests hold it against a plain loop."""
    spots = _spots(spark, sf_dir)
    pages = spots.select("doc_id", "page_no").distinct().select("doc_id", "page_no", F.lit(600.0).alias("width"), F.lit(800.0).alias("height"))
    return layout.regions_to_read(pages, spots.where("x0 < 300"), _words(spark, sf_dir), 50, 20)


#: Pages, their pictures and words, a supplier being a document.
_FACTS = """g AS (SELECT DISTINCT l_suppkey AS doc_id, l_linenumber AS page_no, 600.0::DOUBLE AS width, 800.0::DOUBLE AS height FROM lineitem),
i AS (SELECT l_suppkey AS doc_id, l_linenumber AS page_no, l_quantity AS x0, l_quantity AS y0, l_quantity + l_partkey % 400 AS x1, l_quantity + l_orderkey % 300 AS y1, l_partkey % 400 AS px_w, l_orderkey % 300 AS px_h FROM lineitem WHERE (l_orderkey + l_suppkey) % 9 = 0),
w AS (SELECT l_suppkey AS doc_id, l_linenumber AS page_no, CASE WHEN l_suppkey % 3 = 0 THEN ' ' ELSE l_returnflag END AS text FROM lineitem)"""


@query(f"""WITH {_FACTS}, s AS (SELECT doc_id, page_no, sum(px_w * px_h) AS px, sum(greatest(0, x1 - x0) * greatest(0, y1 - y0)) AS cover FROM i GROUP BY ALL), c AS (SELECT doc_id, page_no, sum(length(trim(text))) AS chars FROM w GROUP BY ALL)
SELECT g.doc_id, g.page_no, CASE WHEN px >= 500000 AND cover >= 0.25 * 480000 THEN 'jpeg' ELSE 'png' END AS kind, coalesce(coalesce(chars, 0) < 3 AND cover >= 240000, false) AS scanned FROM g LEFT JOIN s USING (doc_id, page_no) LEFT JOIN c USING (doc_id, page_no)""")
def page_image_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of each page's thumbnail, and whether it is a scan."""
    items, wide, high = table(spark, sf_dir, "lineitem"), F.col("l_partkey") % 400, F.col("l_orderkey") % 300
    place = [F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").alias("page_no")]
    pages = items.select(*place).distinct().select("doc_id", "page_no", F.lit(600.0).alias("width"), F.lit(800.0).alias("height"))
    images = items.where("(l_orderkey + l_suppkey) % 9 = 0").select(*place, F.col("l_quantity").alias("x0"), F.col("l_quantity").alias("y0"), (F.col("l_quantity") + wide).alias("x1"), (F.col("l_quantity") + high).alias("y1"), wide.alias("px_w"), high.alias("px_h"))
    words = items.select(*place, F.when(F.col("l_suppkey") % 3 == 0, " ").otherwise(F.col("l_returnflag")).alias("text"))
    scans = layout.scanned_pages(pages, words, images).withColumn("found", F.lit(True))
    kinds = layout.thumbnail_kinds(pages, images).join(scans, ["doc_id", "page_no"], "left")
    return kinds.select("doc_id", "page_no", "kind", F.coalesce("found", F.lit(False)).alias("scanned"))


@query("""WITH i AS (SELECT l_suppkey AS doc_id, l_linenumber AS page_no, 600 - l_partkey % 20 AS w, 800 - l_orderkey % 20 AS h, (600 - l_partkey % 20) * 4 AS pw, (800 - l_orderkey % 20) * 4 + l_suppkey % 60 AS ph FROM lineitem WHERE l_quantity > 20),
k AS (SELECT doc_id, page_no, arg_max({'w': w, 'h': h, 'pw': pw, 'ph': ph}, {'a': w * h, 'pw': pw, 'ph': ph, 'w': w, 'h': h}) AS i FROM i GROUP BY ALL), x AS (SELECT doc_id, page_no, i.w * i.h AS a, i.pw * 72 / i.w::DOUBLE AS x, i.ph * 72 / i.h::DOUBLE AS y FROM k)
SELECT doc_id, page_no, (x + y) / 2 AS dpi FROM x WHERE a >= 0.95 * 480000 AND abs(x - y) <= 0.01 * greatest(x, y) AND (x + y) / 2 BETWEEN 50 AND 600""")
def scan_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The resolution of scanned pages."""
    wide, high = (600 - F.col("l_partkey") % 20).cast("double"), (800 - F.col("l_orderkey") % 20).cast("double")
    items = table(spark, sf_dir, "lineitem").where("l_quantity > 20").select(F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").alias("page_no"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), wide.alias("x1"), high.alias("y1"), (wide * 4).cast("long").alias("px_w"), (high * 4 + F.col("l_suppkey") % 60).cast("long").alias("px_h"))
    pages = items.select("doc_id", "page_no").distinct().select("doc_id", "page_no", F.lit(600.0).alias("width"), F.lit(800.0).alias("height"))
    return layout.scan_resolution(pages, items)


@query("""WITH u AS (SELECT l_orderkey AS doc_id, l_suppkey % 2 AS page_no, CASE l_partkey % 5 WHEN 0 THEN 20 WHEN 1 THEN 1 ELSE 16 + l_quantity END AS w, CASE l_partkey % 5 WHEN 0 THEN 1 ELSE 10 END AS h, l_partkey % 3 > 0 AS s FROM lineitem),
k AS (SELECT *, h < 1.6 AND w > 15 AS f, w < 1.6 AND h > 6 AS v FROM u), c AS (SELECT *, s AND w > 15 AND h > 6 AND NOT f AND NOT v AS b FROM k)
SELECT doc_id, page_no FROM c GROUP BY ALL HAVING sum(CASE WHEN f THEN 1 WHEN b THEN 2 ELSE 0 END) >= 3 AND sum(CASE WHEN v THEN 1 WHEN b THEN 2 ELSE 0 END) >= 3""")
def ruled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with rules enough for tables."""
    kind = F.col("l_partkey") % 5
    wide, high = F.when(kind == 0, 20.0).when(kind == 1, 1.0).otherwise(16 + F.col("l_quantity")), F.when(kind == 0, 1.0).otherwise(10.0)
    rules = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_suppkey") % 2).alias("page_no"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), wide.alias("x1"), high.alias("y1"), (F.col("l_partkey") % 3 > 0).alias("stroked"))
    return layout.ruled_pages(rules)


@query("""WITH a AS (SELECT l_suppkey AS doc_id, l_linenumber AS page_no, row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_orderkey, l_partkey, l_quantity, l_extendedprice) AS span_no, l_partkey, l_quantity * 8 AS x, (l_orderkey % 40) * 12 AS y FROM lineitem),
s AS (SELECT doc_id, page_no, span_no, x AS x0, x + 12 AS x1, y FROM a WHERE l_partkey % 2 = 0), r AS (SELECT doc_id, page_no, x - l_partkey % 9 AS x0, x + l_partkey % 90 AS x1, y + l_partkey % 7 - 1 AS y FROM a WHERE l_partkey % 2 = 1)
SELECT doc_id, page_no, span_no, x0, x1, y::DOUBLE AS y, EXISTS (SELECT 1 FROM r WHERE r.doc_id = s.doc_id AND r.page_no = s.page_no AND r.x0 <= s.x0 + 2 AND r.x1 >= s.x1 - 2 AND r.y - s.y BETWEEN -0.5 AND 3.5) AS underline FROM s""")
def underlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that rules underline."""
    x, y, part = F.col("l_quantity") * 8, ((F.col("l_orderkey") % 40) * 12).cast("double"), F.col("l_partkey")
    number = F.row_number().over(Window.partitionBy("l_suppkey", "l_linenumber").orderBy("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice"))
    items = table(spark, sf_dir, "lineitem").withColumn("span_no", number.cast("long"))
    place = [F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").alias("page_no")]
    spans = items.where("l_partkey % 2 = 0").select(*place, "span_no", x.alias("x0"), (x + 12).alias("x1"), y.alias("y"))
    rules = items.where("l_partkey % 2 = 1").select(*place, (x - part % 9).alias("x0"), (x + part % 90).alias("x1"), (y + part % 7 - 1).alias("y"))
    return layout.underlined(spans, rules)


@query("""WITH a AS (SELECT l_suppkey AS doc_id, l_linenumber AS page_no, l_orderkey, l_partkey, l_quantity * 10 AS x, (l_orderkey % 50) * 10 AS y FROM lineitem),
c AS (SELECT doc_id, page_no, l_partkey % 3 AS table_no, l_orderkey % 50 AS row_no, l_partkey % 8 AS col_start, x AS x0, y AS y0, x + 90 AS x1, y + 60 AS y1 FROM a WHERE l_partkey % 6 = 0), p AS (SELECT doc_id, page_no, l_orderkey AS part_no, x + 7 AS px, y + 6 AS py FROM a WHERE l_partkey % 6 > 0),
j AS (SELECT p.doc_id, p.page_no, part_no, min({'t': table_no, 'r': row_no, 'c': col_start}) AS cell FROM p JOIN c ON p.doc_id = c.doc_id AND p.page_no = c.page_no AND px BETWEEN c.x0 - 0.5 AND c.x1 + 0.5 AND py BETWEEN c.y0 - 0.5 AND c.y1 + 0.5 GROUP BY ALL)
SELECT doc_id, page_no, part_no, cell.t AS table_no, cell.r AS row_no, cell.c AS col_start FROM j""")
def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cell of each part."""
    x, y, part = F.col("l_quantity") * 10, ((F.col("l_orderkey") % 50) * 10).cast("double"), F.col("l_partkey")
    items = table(spark, sf_dir, "lineitem")
    place = [F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").alias("page_no")]
    cells = items.where("l_partkey % 6 = 0").select(*place, (part % 3).alias("table_no"), (F.col("l_orderkey") % 50).alias("row_no"), (part % 8).alias("col_start"), x.alias("x0"), y.alias("y0"), (x + 90).alias("x1"), (y + 60).alias("y1"))
    parts = items.where("l_partkey % 6 > 0").select(*place, F.col("l_orderkey").alias("part_no"), x.alias("x0"), y.alias("y0"), (x + 14).alias("x1"), (y + 12).alias("y1"))
    return layout.in_cells(parts, cells)


@query("""WITH s AS (SELECT l_suppkey AS doc_id, l_linenumber AS page_no, [0, 90, 180, 270][CAST((l_partkey + l_suppkey) % 4 AS INTEGER) + 1] AS angle, count(*) FILTER (l_quantity > 5 + 40 * (l_partkey % 4 % 2)) AS good, count(*) AS total FROM lineitem GROUP BY ALL),
u AS (SELECT doc_id, page_no, max(good) FILTER (angle = 0) AS g, max(total) FILTER (angle = 0) AS t FROM s GROUP BY ALL),
k AS (SELECT s.doc_id, s.page_no, angle, 2 * good - total AS net, list_position([90, 270, 180], angle) AS tried, coalesce(g >= 8 AND g >= 0.7 * t, false) AS fine, angle <> 0 AND good >= 3 AND 2 * good - total >= coalesce(2 * g - t, 0) + 3 AS able FROM s JOIN u USING (doc_id, page_no))
SELECT doc_id, page_no, coalesce(arg_max(angle, {'n': net, 't': -tried}) FILTER (NOT fine AND able), 0) AS angle FROM k GROUP BY ALL""")
def ocr_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turn in which a page was read."""
    angle = F.element_at(F.array(*[F.lit(a) for a in (0, 90, 180, 270)]), ((F.col("l_partkey") + F.col("l_suppkey")) % 4).cast("int") + 1)
    good = F.col("l_quantity") > 5 + 40 * (F.col("l_partkey") % 4 % 2)
    scores = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").alias("page_no"), angle.alias("angle")).agg(F.count_if(good).alias("good"), F.count("*").alias("total"))
    return layout.best_reading(scores)


@query("""WITH d AS (SELECT l_orderkey AS doc_id, l_orderkey % 3 AS page_no, CAST(90 * (l_orderkey % 4) AS INTEGER) AS rotation, [1.0, 0.0, -1.0, 0.0, 0.5][CAST(l_partkey % 5 AS INTEGER) + 1]::DOUBLE AS dx, [0.0, -1.0, 0.0, 1.0, 0.5][CAST(l_partkey % 5 AS INTEGER) + 1]::DOUBLE AS dy FROM lineitem),
t AS (SELECT *, unnest([rotation, 0, 90, 180, 270]) AS angle, generate_subscripts([rotation, 0, 90, 180, 270], 1) AS rank FROM d),
v AS (SELECT doc_id, page_no, angle, rank, count(*) FILTER (CASE angle WHEN 0 THEN dx WHEN 90 THEN -dy WHEN 180 THEN -dx ELSE dy END > 0.9) AS votes FROM t GROUP BY ALL) SELECT doc_id, page_no, arg_max(angle, {'v': votes, 'r': -rank}) AS angle FROM v GROUP BY ALL""")
def text_plane_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plane in which most lines read from left to right."""
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("l_partkey") % 5).cast("int") + 1)
    order = F.col("l_orderkey")
    rows = table(spark, sf_dir, "lineitem").select(order.alias("doc_id"), (order % 3).alias("page_no"), (90 * (order % 4)).cast("int").alias("rotation"), pick((1.0, 0.0, -1.0, 0.0, 0.5)).alias("dx"), pick((0.0, -1.0, 0.0, 1.0, 0.5)).alias("dy"))
    return layout.text_planes(rows)


_FOOTERS = Patterns("- {a} -", "{a}/9", "{a}", "Sayfa {a} of 12", "{b}")
_PAGE_OF = r"^(\D{0,24}?)(\d{1,4})(?:(\s*(?:/|-|of)\s*)(\d{1,4}))?(\D{0,16})$"


@query(rf"""WITH n AS (SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS page_no, (o_custkey % 3) * 250 AS x0 FROM orders), r AS (SELECT *, {_FOOTERS.sql('doc_id', a='page_no', b='page_no + 1')} AS text FROM n),
f AS (SELECT *, TRY_CAST(regexp_extract(text, '{_PAGE_OF}', 2) AS INTEGER) = page_no AS fits FROM r), d AS (SELECT doc_id, arg_min(text, page_no) AS text, min(x0) + 20 - 300 AS off FROM f GROUP BY doc_id HAVING count(*) >= 2 AND bool_and(coalesce(fits, false)))
SELECT doc_id, CASE WHEN abs(off) < 48 THEN 'centre' WHEN off > 0 THEN 'right' ELSE 'left' END AS alignment, regexp_extract(text, '{_PAGE_OF}', 1) AS before, coalesce(nullif(trim(regexp_extract(text, '{_PAGE_OF}', 3)), ''), '/') AS separator,
  regexp_extract(text, '{_PAGE_OF}', 5) AS after, regexp_extract(text, '{_PAGE_OF}', 4) <> '' AS has_total FROM d""")
def page_number_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose repeated line is the number of its page."""
    number = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), number.alias("page_no"), F.lit(600.0).alias("page_width"), ((F.col("o_custkey") % 3) * 250.0).alias("x0"))
    return layout.page_number_line(rows.withColumns({"x1": F.col("x0") + 40, "text": _FOOTERS.column(F.col("doc_id"), a=F.col("page_no"), b=F.col("page_no") + 1)}))


@query(f"""WITH {_LINES}, z AS (SELECT doc_id, page_no, CAST(round_even(y0, 0) AS INTEGER) AS y, regexp_replace(text, '[0-9]+', '#', 'g') AS masked, text, y0 > page_height * 0.84 AS low FROM l WHERE y0 < page_height * 0.16 OR y0 > page_height * 0.84),
d AS (SELECT doc_id, greatest(2, ceil(count(DISTINCT page_no) * 0.6)) AS need FROM l GROUP BY doc_id HAVING count(DISTINCT page_no) >= 2),
o AS (SELECT doc_id, page_no, y, masked, min(text) AS text, bool_or(low) AS low FROM z GROUP BY ALL),
k AS (SELECT doc_id, y, masked, count(*) AS n, bool_or(low) AS low FROM o GROUP BY ALL),
r AS (SELECT k.doc_id, k.y, k.masked, k.low, sum(b.n) AS around FROM k JOIN k b ON b.doc_id = k.doc_id AND b.masked = k.masked AND b.y BETWEEN k.y - 2 AND k.y + 2 GROUP BY ALL),
w AS (SELECT doc_id, masked, max(c) AS same, bool_and(regexp_full_match(trim(text), '\\D{{0,24}}?\\d{{1,4}}(\\s*(/|-|of)\\s*\\d{{1,4}})?\\D{{0,16}}')) AS numbers FROM (SELECT doc_id, masked, text, count(*) AS c FROM o GROUP BY ALL) GROUP BY ALL),
f AS (SELECT r.doc_id, r.y, r.masked FROM r JOIN w USING (doc_id, masked) JOIN d USING (doc_id) WHERE around >= need AND (same >= need OR (low AND numbers))),
c AS (SELECT l.*, CASE WHEN y0 < page_height / 2 THEN 'header' ELSE 'footer' END AS zone FROM l WHERE EXISTS (SELECT 1 FROM f WHERE f.doc_id = l.doc_id AND f.masked = regexp_replace(l.text, '[0-9]+', '#', 'g') AND abs(f.y - CAST(round_even(l.y0, 0) AS INTEGER)) <= 2)),
n AS (SELECT doc_id, zone, list_sort(list(n)) AS n FROM (SELECT doc_id, zone, page_no, count(*) AS n FROM c GROUP BY ALL) GROUP BY doc_id, zone),
e AS (SELECT c.* FROM c JOIN n USING (doc_id, zone) WHERE n.n[len(n.n) // 2 + 1] <= 6),
g AS (SELECT doc_id, regexp_replace(text, '[0-9]+', '#', 'g') AS wording, min(CAST(page_no AS BIGINT) * 1000000000 + block) AS place FROM e WHERE zone = 'footer' GROUP BY ALL HAVING count(*) >= 2 AND bool_and(CAST(regexp_extract(text, '[0-9]+', 0) AS INTEGER) = page_no)),
h AS (SELECT doc_id, arg_min(wording, place) AS number FROM g GROUP BY doc_id)
SELECT doc_id, page_no, block AS line_no, CASE WHEN zone = 'footer' AND regexp_replace(text, '[0-9]+', '#', 'g') = number THEN 'number' ELSE zone END AS kind FROM e LEFT JOIN h USING (doc_id)""")
def header_footer_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated lines as headers, footers and page numbers."""
    lines = _lines(spark, sf_dir).withColumn("y", F.col("y0")).withColumn("line_no", F.col("block"))
    return layout.header_footer_lines(lines)
