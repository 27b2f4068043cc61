"""Page edits, styled ranges, estimates and the smaller rules, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docloom.functions import text as T
from docloom.operators import annots, convert, layout, pages, search, styles
from docloom.plans.layout_queries import _LINES, _lines
from docloom.plans.registry import query
from docloom.session import scratch_path, table
from docloom.streaming import hits

#: A conversation is a recipe, its turns are pages.
_RECIPE = "r AS (SELECT conv_id AS recipe_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, turn AS src_page FROM conversations)"


def _recipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("recipe_id"), pos.alias("pos"), F.col("turn").alias("src_page"))


@query(f"""WITH {_RECIPE}, m AS (SELECT *, (recipe_id + src_page) % 3 = 0 OR recipe_id % 7 = 0 AS g FROM r),
n AS (SELECT *, count(*) OVER (PARTITION BY recipe_id) AS n, count(*) FILTER (g) OVER (PARTITION BY recipe_id) AS lost FROM m)
SELECT recipe_id, CAST(row_number() OVER (PARTITION BY recipe_id ORDER BY pos) - 1 AS INTEGER) AS pos, src_page FROM n WHERE NOT g OR lost = n""")
def page_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recipes without some pages; one that would lose all stays."""
    recipe = _recipe(spark, sf_dir)
    return pages.without_pages(recipe, recipe.where("(recipe_id + src_page) % 3 = 0 OR recipe_id % 7 = 0"))


@query(f"""WITH {_RECIPE}, n AS (SELECT recipe_id, count(*) AS n FROM r GROUP BY recipe_id),
a AS (SELECT recipe_id, pos AS slot, 1 AS own, pos, src_page FROM r UNION ALL SELECT recipe_id, greatest(0, least(recipe_id % 9 - 1, n)), 0, pos, src_page FROM r JOIN n USING (recipe_id) WHERE src_page % 2 = 1)
SELECT recipe_id, CAST(row_number() OVER (PARTITION BY recipe_id ORDER BY slot, own, pos) - 1 AS INTEGER) AS pos, src_page FROM a""")
def page_paste(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of pages put in at a place."""
    recipe = _recipe(spark, sf_dir)
    places = recipe.select("recipe_id", (F.col("recipe_id") % 9 - 1).cast("int").alias("at")).distinct()
    return pages.with_pages(recipe, recipe.where("src_page % 2 = 1"), places)


@query(f"""WITH {_RECIPE}, c AS (SELECT * FROM r WHERE src_page % 3 = 1), l AS (SELECT recipe_id, max(pos) + 1 AS put FROM c GROUP BY recipe_id),
a AS (SELECT recipe_id, pos AS slot, 1 AS own, pos, src_page FROM r UNION ALL SELECT recipe_id, put, 0, pos, src_page FROM c JOIN l USING (recipe_id))
SELECT recipe_id, CAST(row_number() OVER (PARTITION BY recipe_id ORDER BY slot, own, pos) - 1 AS INTEGER) AS pos, src_page FROM a""")
def page_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of pages behind the last of them."""
    recipe = _recipe(spark, sf_dir)
    return pages.duplicated(recipe, recipe.where("src_page % 3 = 1"))


@query("""WITH p AS (SELECT l_suppkey % 40 AS doc_id, row_number() OVER (PARTITION BY l_suppkey % 40 ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS page_no, CAST(floor(l_extendedprice) AS BIGINT) AS bytes FROM lineitem),
f AS (SELECT doc_id, sum(bytes) AS total, sum(bytes) FILTER (page_no <= 20) AS base, sum(bytes) > 41943040 OR count(*) > 250 AS sampled FROM p GROUP BY doc_id),
c AS (SELECT doc_id, level, sum((bytes * share) // 100) AS out FROM p JOIN f USING (doc_id), (VALUES ('low', 80), ('high', 35)) v(level, share) WHERE NOT sampled OR page_no <= 20 GROUP BY doc_id, level),
e AS (SELECT doc_id, level, total, sampled, CAST(CASE WHEN sampled THEN (total * out) // greatest(base, 1) ELSE out END AS BIGINT) AS bytes FROM c JOIN f USING (doc_id))
SELECT doc_id, level, bytes, round(CAST(100 * bytes AS DOUBLE) / greatest(total, 1), 1) AS percent, sampled FROM e""")
def shrink_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of documents after compression, from all of their pages or the first."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"))
    rows = table(spark, sf_dir, "lineitem").withColumn("doc_id", F.col("l_suppkey") % 40).select("doc_id", place.alias("page_no"), F.floor("l_extendedprice").cast("long").alias("bytes"))
    levels = F.explode(F.array(F.struct(F.lit("low").alias("level"), F.lit(80).alias("share")), F.struct(F.lit("high").alias("level"), F.lit(35).alias("share")))).alias("v")
    coded = rows.select("doc_id", "page_no", "bytes", levels).select("doc_id", "page_no", "v.level", F.expr("bytes * v.share div 100").alias("bytes"))
    return pages.shrink_estimate(rows, coded)


@query("""WITH i AS (SELECT p_partkey, CAST(p_size * 37 AS DOUBLE) AS w0, CAST(p_partkey % 1900 AS DOUBLE) AS h0, p_partkey % 3 = 0 AS fax FROM part),
s AS (SELECT *, CASE WHEN fax THEN w0 / 204 ELSE w0 END AS w, CASE WHEN fax THEN h0 / 98 ELSE h0 END AS h FROM i),
b AS (SELECT *, CASE WHEN w > h THEN 841.89::DOUBLE ELSE 595.28::DOUBLE END AS bw, CASE WHEN w > h THEN 595.28::DOUBLE ELSE 841.89::DOUBLE END AS bh FROM s)
SELECT p_partkey, round(CASE WHEN w0 <= 0 OR h0 <= 0 THEN 595.28 WHEN bw / w <= bh / h THEN bw ELSE greatest(1.0, least(bw, w * bh / h)) END, 4) AS width,
  round(CASE WHEN w0 <= 0 OR h0 <= 0 THEN 841.89 WHEN bw / w <= bh / h THEN greatest(1.0, least(bh, h * bw / w)) ELSE bh END, 4) AS height FROM b""")
def image_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of each image."""
    fax = F.col("p_partkey") % 3 == 0
    size = pages.image_page((F.col("p_size") * 37).cast("double"), (F.col("p_partkey") % 1900).cast("double"), F.when(fax, 204.0), F.when(fax, 98.0))
    return table(spark, sf_dir, "part").select("p_partkey", size.alias("s")).select("p_partkey", F.round("s.width", 4).alias("width"), F.round("s.height", 4).alias("height"))


@query("""WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN '  ' ELSE text END AS text FROM conversations),
p AS (SELECT conv_id AS doc_id, turn, text, lag(turn) OVER w AS prev, turn % 3 = 0 AS b, lag(turn) OVER w % 4 = 0 AS e FROM t WHERE regexp_replace(text, '\\s', '', 'g') <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT doc_id, md5(string_agg(CASE WHEN prev IS NULL THEN '' WHEN coalesce(e, false) OR b THEN chr(10) || chr(10) || chr(10) ELSE chr(10) END || text, '' ORDER BY turn)) AS digest FROM p GROUP BY doc_id""")
def joined_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selected texts of pages as one."""
    turns = table(spark, sf_dir, "conversations")
    rows = turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), F.when(F.col("turn") % 5 == 0, "  ").otherwise(F.col("text")).alias("text"), (F.col("turn") % 3 == 0).alias("starts_blank"), (F.col("turn") % 4 == 0).alias("ends_blank"))
    return pages.joined_texts(rows).select("doc_id", F.md5("text").alias("digest"))


@query("""WITH l AS (SELECT conv_id AS doc_id, turn, turn * 7 % 30 AS x, CASE WHEN turn % 6 <> 0 THEN text END AS text FROM conversations),
m AS (SELECT *, min(x) FILTER (text IS NOT NULL) OVER (PARTITION BY doc_id) AS least FROM l)
SELECT doc_id, md5(string_agg(CASE WHEN text IS NULL THEN '' WHEN x - least > 8 THEN '    ' || text ELSE text END, chr(10) ORDER BY turn)) AS digest FROM m GROUP BY doc_id""")
def indented_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines under each other, those far in with blanks before them."""
    turns = table(spark, sf_dir, "conversations")
    rows = turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), (F.col("turn") * 7 % 30).alias("x0"), F.when(F.col("turn") % 6 != 0, F.col("text")).alias("text"))
    return pages.indented_text(rows).select("doc_id", F.md5("text").alias("digest"))


#: A range of each text whose ends follow from its id.
_RANGES = "b AS (SELECT item_id AS doc_id, text, CAST(item_id % 17 AS INTEGER) AS first, CAST(item_id % 17 + item_id % 23 + 1 AS INTEGER) AS \"end\" FROM benchmark)"


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = (F.col("item_id") % 17).cast("int")
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text", first.alias("first"), (first + (F.col("item_id") % 23).cast("int") + 1).alias("end"))


def _characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit(0).alias("run_no"), "text", F.lit(None).cast("string").alias("style"))
    return styles.expanded_runs(items).withColumn("style", F.when(F.col("char").rlike("[A-Z]"), "bold"))


@query(f"""WITH {_RANGES}, p AS (SELECT *, substring(text, first + 1, least("end", length(text)) - first) AS s FROM b),
t AS (SELECT *, first + length(s) - length(ltrim(s, ' ' || chr(9) || chr(10))) AS f, least("end", length(text)) - length(s) + length(rtrim(s, ' ' || chr(9) || chr(10))) AS e FROM p)
SELECT doc_id, CAST(CASE WHEN f < e THEN f ELSE first END AS INTEGER) AS first, CAST(CASE WHEN f < e THEN e ELSE "end" END AS INTEGER) AS "end" FROM t""")
def range_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges without the blanks at their ends."""
    return styles.trimmed_ranges(_ranges(spark, sf_dir)).select("doc_id", "first", "end")


@query(f"""WITH {_RANGES}, c AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, substring(text, i, 1) AS char, first, "end" FROM (SELECT *, unnest(range(1, length(text) + 1)) AS i FROM b))
SELECT doc_id, pos, char, CASE WHEN pos >= first AND pos < "end" THEN CASE WHEN doc_id % 2 = 0 THEN 'italic' END WHEN regexp_matches(char, '[A-Z]') THEN 'bold' END AS style FROM c""")
def range_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters with a style set or cleared on a range."""
    ranges = _ranges(spark, sf_dir).withColumn("style", F.when(F.col("doc_id") % 2 == 0, "italic"))
    return styles.styled(_characters(spark, sf_dir), ranges)


@query(f"""WITH {_RANGES}, n AS (SELECT doc_id, substring(text, 1, first) || 'new text' || substring(text, "end" + 1) AS t, first, "end" FROM b WHERE "end" <= length(text)),
c AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, substring(t, i, 1) AS char, first FROM (SELECT *, unnest(range(1, length(t) + 1)) AS i FROM n))
SELECT doc_id, pos, char, CASE WHEN pos >= first AND pos < first + 8 THEN 'fresh' WHEN regexp_matches(char, '[A-Z]') THEN 'bold' END AS style FROM c""")
def range_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters with a range replaced by other text."""
    ranges = _ranges(spark, sf_dir).where('"end" <= length(text)'.replace('"', "`"))
    edits = ranges.select("doc_id", "first", "end", F.lit("new text").alias("text"), F.lit("fresh").alias("style"))
    return styles.replaced(_characters(spark, sf_dir).join(edits, "doc_id", "left_semi"), edits)


@query("""SELECT conv_id, turn, turn % 4 = 0 OR (turn % 3 <> 0 AND trim(text) <> '') AS shown FROM conversations""")
def visible_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a block of parts shows something."""
    part = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    parts = F.array(part("text", F.when(F.col("turn") % 3 != 0, F.col("text")).otherwise(" \t")), F.when(F.col("turn") % 4 == 0, part("image", F.lit(""))).otherwise(part("tab", F.lit("x"))))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", styles.visible(parts).alias("shown"))


@query(f"""WITH {_LINES} SELECT doc_id, page_no, block, x0, y0, x1, y1 FROM l WHERE line % 5 = 0""")
def blank_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of white space."""
    rows = _lines(spark, sf_dir).withColumn("text", F.when(F.col("line") % 5 == 0, " \t").when(F.col("line") % 5 == 1, "").otherwise(F.col("text")))
    return layout.blank_lines(rows).select("doc_id", "page_no", "block", "x0", "y0", "x1", "y1")


@query(f"""WITH {_LINES}, w AS (SELECT *, y1 - 2 AS y FROM l WHERE line % 9 <> 0), i AS (SELECT *, block * 1000 + line AS image_no FROM l WHERE line % 9 = 0),
f AS (SELECT i.doc_id, i.page_no, i.image_no, i.y1 AS foot, arg_min(round(w.y, 2), abs(round(w.y, 2) - i.y1) * 1e6 + round(w.y, 2)) AS y, min(abs(round(w.y, 2) - i.y1)) AS off,
  bool_or(w.y1 > i.y0 + 1 AND w.y0 < i.y1 - 1 AND w.x0 < i.x1 - 1 AND w.x1 > i.x0 + 1) AS over, bool_or(w.y1 > i.y0 + 1 AND w.y0 < i.y1 - 1) AS beside
  FROM i LEFT JOIN w ON w.doc_id = i.doc_id AND w.page_no = i.page_no GROUP BY i.doc_id, i.page_no, i.image_no, i.y1)
SELECT doc_id, page_no, image_no, CASE WHEN y IS NULL OR off > 3 THEN foot ELSE y END AS y FROM f WHERE NOT coalesce(over, false) AND NOT ((y IS NULL OR off > 3) AND coalesce(beside, false))""")
def images_beside_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images that stand in lines."""
    lines = _lines(spark, sf_dir)
    images = lines.where("line % 9 = 0").withColumn("image_no", F.col("block") * 1000 + F.col("line"))
    return layout.images_in_lines(images, lines.where("line % 9 <> 0").withColumn("y", F.col("y1") - 2))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CAST(((floor((l_extendedprice - 30000) / 90 + 0.5) * 90) % 360 + 360) % 360 AS INTEGER) AS angle FROM lineitem""")
def right_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angles as turns of a quarter."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", T.right_angle(F.col("l_extendedprice") - 30000).alias("angle"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN list_value(CAST(p_size AS DOUBLE), CAST(-p_partkey AS DOUBLE), 0.5::DOUBLE) END AS flat,
  CASE WHEN p_partkey % 4 <> 0 THEN list_value(list_value(CAST(p_size AS DOUBLE), 2.0::DOUBLE), list_value(CAST(p_partkey AS DOUBLE))) END AS nested FROM part""")
def pdf_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of arrays, flat and one in another."""
    size, key = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    flat = F.concat(F.lit(" ["), size, F.lit(" -"), key, F.when(F.col("p_partkey") % 5 == 0, " x]").otherwise(" .5 ] "))
    nested = F.concat(F.lit("[["), size, F.lit(" 2.0 ] ["), key, F.when(F.col("p_partkey") % 4 == 0, "]").otherwise("]]"))
    return table(spark, sf_dir, "part").select("p_partkey", T.pdf_numbers(flat).alias("flat"), T.pdf_number_lists(nested).alias("nested"))


@query("""WITH e AS (SELECT event_id, ts, CAST(user_id % 27 - 13 AS INTEGER) * 30 AS m FROM events)
SELECT event_id, 'D:' || strftime(ts + to_minutes(m), '%Y%m%d%H%M%S') || CASE WHEN m < 0 THEN '-' ELSE '+' END || lpad(CAST(abs(m) // 60 AS VARCHAR), 2, '0') || chr(39) || lpad(CAST(abs(m) % 60 AS VARCHAR), 2, '0') || chr(39) AS stamp FROM e""")
def pdf_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as dates of a document, in zones around the world."""
    minutes = (F.col("user_id") % 27 - 13).cast("int") * 30
    return table(spark, sf_dir, "events").select("event_id", T.pdf_date(F.col("ts").cast("timestamp"), minutes).alias("stamp"))


_WORD_SIGNS = r"""[A-Za-z0-9!"#$%&''()*+,./:;<=>?@\[\\\]^_`{|}~]"""


@query(f"""WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, s[i] || CASE WHEN i % 3 = 0 THEN '-' ELSE '' END AS line, s[i + 1] AS following FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM s)),
o AS (SELECT *, CASE WHEN ends_with(line, '-') AND regexp_matches(following, '^\\p{{Ll}}') THEN substring(line, 1, length(line) - 1) ELSE line END AS own FROM l)
SELECT doc_id, pos, md5(CASE WHEN own = line AND regexp_matches(own, '{_WORD_SIGNS}$') AND coalesce(regexp_matches(following, '^{_WORD_SIGNS}'), false) THEN own || ' ' ELSE own END) AS digest FROM o""")
def line_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of lines before the next line."""
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.split("text", "\n", -1).alias("s")).select("doc_id", "s", F.posexplode("s").alias("pos", "line"))
    line = F.concat("line", F.when((F.col("pos") + 1) % 3 == 0, "-").otherwise(""))
    rows = rows.select("doc_id", "pos", line.alias("line"), F.get("s", F.col("pos") + 1).alias("following"))
    return rows.select("doc_id", "pos", F.md5(T.ends_of_lines(F.col("line"), F.col("following"), True)).alias("digest"))


@query("SELECT doc_id, doc_id % 2 = 0 AND doc_id % 3 <> 0 AND doc_id % 5 <> 0 AS pure FROM documents")
def pure_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms that live in their template alone."""
    facts = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 2 == 0).alias("needs_rendering"), (F.col("doc_id") % 3 != 0).alias("has_template"), F.when(F.col("doc_id") % 5 == 0, "[ 12 0 R 13 0 R ]").when(F.col("doc_id") % 7 == 0, "[]").alias("fields"))
    return annots.pure_forms(facts).select("doc_id", "pure")


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("id"), F.when(F.col("turn") > 1, F.col("turn") - 1).alias("reply_to"), F.col("text").alias("payload"))


@query("SELECT conv_id AS doc_id, max(turn) AS id, md5(arg_max(text, turn)) AS digest FROM conversations GROUP BY conv_id")
def annot_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last note of each document by its id."""
    notes = _notes(spark, sf_dir)
    return annots.one(notes, notes.groupBy("doc_id").agg(F.max("id").alias("id"))).select("doc_id", "id", F.md5("payload").alias("digest"))


@query("""WITH m AS (SELECT conv_id AS doc_id, max(turn) AS last FROM conversations GROUP BY conv_id)
SELECT doc_id, last + k AS id, CASE WHEN k = 1 THEN 1 ELSE last + k - 1 END AS reply_to, 'added ' || k AS payload FROM m, (VALUES (1), (2), (3)) v(k)""")
def annot_added_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added notes with their ids, replies to added ones included."""
    notes = _notes(spark, sf_dir)
    local = F.explode(F.array(*[F.lit(k) for k in (1, 2, 3)])).alias("k")
    rows = notes.select("doc_id").distinct().select("doc_id", local)
    added = rows.select("doc_id", F.col("k").alias("local_id"), F.when(F.col("k") == 1, 1).cast("long").alias("reply_to"), F.when(F.col("k") > 1, F.col("k") - 1).alias("reply_local"), F.concat(F.lit("added "), F.col("k").cast("string")).alias("payload"))
    return annots.numbered_additions(notes, added)


@query("""SELECT doc_id AS path, CASE doc_id % 5 WHEN 4 THEN 'bilinmeyen' WHEN 3 THEN 'udf' ELSE 'word' END AS kind, CASE doc_id % 5 WHEN 0 THEN 'odt' WHEN 1 THEN 'docx' WHEN 2 THEN 'docm' ELSE 'zip' END AS sub FROM documents""")
def zip_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of archives by their entries."""
    entry = lambda name, head=None: F.struct(F.lit(name).alias("name"), F.lit(head).cast("string").alias("head"))
    shapes = {0: [entry("mimetype", "application/vnd.oasis.opendocument.text"), entry("content.xml", "<office")], 1: [entry("word/document.xml"), entry("[Content_Types].xml", "x document.main+xml")], 2: [entry("word/document.xml"), entry("word/vbaProject.bin")], 3: [entry("content.xml", "<?xml?><template ")], 4: [entry("readme.txt", "hello")]}
    entries = F.lit(None)
    for rest, found in shapes.items():
        entries = F.when(F.col("doc_id") % 5 == rest, F.array(*found)).otherwise(entries)
    return convert.zip_kind(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.inline(entries)))


@query("""WITH e AS (SELECT CASE WHEN p_size % 2 = 0 THEN 'odt' ELSE 'docx' END AS kind, CASE WHEN p_partkey % 50 = 0 THEN 'wps' ELSE p_name END AS name, p_size % 3 = 0 AS healthy, p_size AS priority, p_partkey FROM part)
SELECT kind, p_partkey, CAST(row_number() OVER (PARTITION BY kind ORDER BY healthy DESC, priority, p_partkey) AS INTEGER) AS turn FROM e WHERE NOT (kind = 'odt' AND name = 'wps')""")
def engine_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which engines are tried for each kind."""
    rows = table(spark, sf_dir, "part").select(F.when(F.col("p_size") % 2 == 0, "odt").otherwise("docx").alias("kind"), F.when(F.col("p_partkey") % 50 == 0, "wps").otherwise(F.col("p_name")).alias("name"), (F.col("p_size") % 3 == 0).alias("healthy"), F.col("p_size").alias("priority"), "p_partkey")
    return convert.engine_order(rows, "p_partkey").select("kind", "p_partkey", "turn")


@query("""WITH v AS (SELECT conv_id, turn, text, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id AS doc_id, turn AS field_xref, CASE WHEN n > 6 THEN 'too_many' WHEN length(text) > 200 THEN 'too_long' WHEN turn % 2 = 0 AND turn % 3 <> 0 THEN 'not_an_option' END AS error FROM v""")
def field_value_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that may not be written."""
    turns = table(spark, sf_dir, "conversations")
    other = F.when(F.col("turn") % 3 == 0, F.col("text")).otherwise("other")
    rows = turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("field_xref"), F.when(F.col("turn") % 2 == 0, "radio").otherwise("text").alias("kind"), F.array("text").alias("value"), F.array(F.lit("x"), other).alias("options"))
    return annots.value_errors(rows, most=6, longest=200).select("doc_id", "field_xref", "error")


@query("""WITH w AS (SELECT doc_id, source AS warning FROM documents UNION SELECT doc_id, 'id ' || doc_id FROM documents WHERE doc_id % 10 = 0)
SELECT warning, count(*) AS n, CASE WHEN count(*) = 1 THEN min(doc_id) END AS name FROM w WHERE warning IS NOT NULL GROUP BY warning""")
def warning_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings with their number of files."""
    own = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("id "), F.col("doc_id").cast("string")))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.array_compact(F.array("source", "source", own)).alias("warnings"))
    return convert.warnings_summary(rows)


@query("""SELECT p_partkey, CASE WHEN p_size % 4 <= 1 THEN [p_name || '.jpg'] ELSE [p_name || ' - Sayfa ' || i || '.jpg' for i in range(1, p_size % 4 + 1)] END AS names FROM part""")
def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of a document's page files."""
    return table(spark, sf_dir, "part").select("p_partkey", T.page_file_names(F.col("p_name"), F.lit(".jpg"), F.col("p_size") % 4).alias("names"))


@query("""WITH d AS (SELECT conv_id AS doc_id, turn AS page_no, text, lower(translate(text, 'ĠġĢģ‟İI', 'iŞşş"iı')) AS f FROM conversations), n AS (SELECT conv_id AS doc_id, max(turn) AS n FROM conversations GROUP BY conv_id),
m AS (SELECT doc_id, page_no, length(text) // 2 AS half, regexp_extract_all(f, '(the)', 1) AS w, string_split_regex(f, 'the') AS s FROM d), h AS (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM m WHERE len(w) > 0),
p AS (SELECT *, CAST(list_sum([length(x) for x in s[1:i]]) + coalesce(list_sum([length(x) for x in w[1:i-1]]), 0) AS INTEGER) AS start FROM h)
SELECT doc_id, page_no, start, (page_no - 2 + n) % n AS turn FROM p JOIN n USING (doc_id) WHERE start >= half""")
def recognised_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits in the recognised second half of each page, with how far on from page 2 they lie."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "text", F.max("turn").over(Window.partitionBy("conv_id")).alias("n"))
    found = search.recognised_only(search.search(turns, "the"), F.expr("length(text) div 2"))
    return search.from_page(found, F.lit(2), F.col("n")).select("doc_id", "page_no", "start", "turn")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity + l_tax / 2, 6) AS x, round(l_discount - 10 / 2.0::DOUBLE, 6) AS y FROM lineitem""")
def moved_polylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polylines shifted on the page."""
    vertices = F.array(F.array("l_quantity", "l_discount"))
    moved = annots.moved_vertices(vertices, F.col("l_tax"), F.lit(10.0), F.lit(2.0))[0]
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(moved[0], 6).alias("x"), F.round(moved[1], 6).alias("y"))


@query("""SELECT time_bucket(INTERVAL 1 hour, ts) AS hour, sum(len(regexp_extract_all(lower(translate(event_type, 'ĠġĢģ‟İI', 'iŞşş"iı')), 'c'))) AS hits FROM events GROUP BY 1""")
def stream_hit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of each hour in a stream of events; a last empty batch lets the last hours close."""
    events = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("text"))
    folder = scratch_path(spark, "events")
    events.write.parquet(f"{folder}/1")
    closing = events.agg((F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"), F.lit("").alias("text"))
    closing.write.parquet(f"{folder}/2")
    stream = hits.pages(spark, f"{folder}/*", StructType(events.schema.fields), files_per_batch=1_000_000)
    counted = hits.counts(stream, "c", "ts").select(F.col("window.start").alias("hour"), "hits")
    return hits.delivered(counted, "hit-counts").where(F.col("hour") <= F.lit(events.agg(F.max("ts")).first()[0]))
