"""Page lists, recipes, outlines and sizes that follow from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import ranges, text
from docloom.operators import pages
from docloom.plans.derived import DOC_PAGES, ITEM_ORDER, OUTLINES, RECIPES, Patterns, doc_pages, outlines, recipes
from docloom.plans.registry import query
from docloom.session import table

#: Orders as page lists that a user might write; their numbers follow from the order.
_LISTS = Patterns("{a}-{b}", "{a},{b}", "{b}-", "-{a}", " {a} – {b} ; {c}", "", "x", ",", "-", "{a}—{b}", "{a} {b}", "{a}-{b},{c},{b}-{a};{c}", "{a},x,99", "{c}\t{b}–{c}")
_PLACES = {"a": "o_custkey % 9", "b": "o_orderkey % 13", "c": "o_orderkey % 5"}
_WRITTEN = f"r AS (SELECT o_orderkey AS id, o_custkey, {_LISTS.sql('o_orderkey + o_custkey', **_PLACES)} AS expr, CAST(4 + o_orderkey % 9 AS INTEGER) AS total FROM orders)"


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    expr = _LISTS.column(F.col("o_orderkey") + F.col("o_custkey"), **{k: F.expr(v) for k, v in _PLACES.items()})
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", expr.alias("expr"), (4 + F.col("o_orderkey") % 9).cast("int").alias("total"))


def _range_sql(parts: str, pattern: str) -> str:
    """Bounds ``b`` and the first error ``code`` of the list ``parts`` of a relation r."""
    return rf"""q AS (SELECT *, {parts} AS parts FROM r), v AS (SELECT *, [{{'bad': NOT regexp_full_match(x, '\d+') AND (NOT regexp_full_match(x, '{pattern}') OR regexp_full_match(x, '[-–—]')),
  'a': CASE WHEN regexp_full_match(x, '\d+') THEN TRY_CAST(x AS BIGINT) ELSE coalesce(TRY_CAST(regexp_extract(x, '^(\d*)[-–—]', 1) AS BIGINT), 1) END,
  'z': CASE WHEN regexp_full_match(x, '\d+') THEN TRY_CAST(x AS BIGINT) ELSE coalesce(TRY_CAST(regexp_extract(x, '[-–—](\d*)$', 1) AS BIGINT), total) END}} for x in parts] AS b FROM q),
e AS (SELECT *, list_filter([CASE WHEN x.bad THEN 'bad_part' WHEN least(x.a, x.z) < 1 THEN 'below_one' WHEN greatest(x.a, x.z) > total THEN 'above_total' END for x in b], lambda c: c IS NOT NULL)[1] AS code FROM v),
k AS (SELECT *, CASE WHEN code IS NULL THEN [{{'a': least(x.a, x.z), 'z': greatest(x.a, x.z)}} for x in b] END AS spans FROM e)"""


_PAGES_SQL = "array_to_string(list_sort(list_distinct(flatten([range(x.a, x.z + 1) for x in spans]))), ',')"
_CLEAN = r"replace(regexp_replace(regexp_replace(expr, '\s+', '', 'g'), '[–—]', '-', 'g'), ';', ',')"
_PRINT_PARTS = f"list_filter(string_split({_CLEAN}, ','), lambda x: x <> '')"
_PRINT_SQL = _range_sql(_PRINT_PARTS, r"\d*-\d*")
_SPLIT_SQL = _range_sql(r"list_filter([regexp_replace(y, '\s+', '', 'g') for y in string_split_regex(expr, '[,;]+')], lambda x: x <> '')", r"\d*[-–—]\d*")


def _listed(pages_column: str) -> F.Column:
    return F.array_join(F.transform(pages_column, lambda p: p.cast("string")), ",")


@query(f"""WITH {_WRITTEN}, {_PRINT_SQL}, x AS (SELECT *, CASE WHEN {_CLEAN} = '' THEN 'empty' WHEN len(parts) = 0 THEN 'none_chosen' ELSE code END AS error FROM k)
SELECT id, CASE WHEN error IS NULL THEN {_PAGES_SQL} END AS pages, error FROM x""")
def page_ranges_print(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages to print that lists mean."""
    rows = _written(spark, sf_dir).select("id", ranges.print_ranges(F.col("expr"), F.col("total")).alias("x"))
    return rows.select("id", _listed("x.pages").alias("pages"), "x.error")


@query(f"""WITH {_WRITTEN}, {_range_sql("list_filter(string_split_regex(expr, '[,;" + chr(92) + "s]+'), lambda x: x <> '')", chr(92) + "d+[-–]" + chr(92) + "d+")}, x AS (SELECT *, CASE WHEN len(parts) = 0 THEN 'empty' ELSE code END AS error FROM k)
SELECT id, CASE WHEN error IS NULL THEN {_PAGES_SQL} END AS pages, error FROM x""")
def page_ranges_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages that lists with blanks mean."""
    rows = _written(spark, sf_dir).select("id", ranges.list_ranges(F.col("expr"), F.col("total")).alias("x"))
    return rows.select("id", _listed("x.pages").alias("pages"), "x.error")


@query(f"""WITH {_WRITTEN}, {_SPLIT_SQL}, x AS (SELECT *, CASE WHEN len(parts) = 0 THEN 'empty' ELSE code END AS error FROM k)
SELECT id, CASE WHEN error IS NULL THEN array_to_string([x.a || '-' || x.z for x in spans], ',') END AS ranges, error FROM x""")
def page_ranges_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranges that lists split a document in."""
    rows = _written(spark, sf_dir).select("id", ranges.split_ranges(F.col("expr"), F.col("total")).alias("x"))
    joined = F.array_join(F.transform("x.ranges", lambda r: F.concat_ws("-", r.low.cast("string"), r.high.cast("string"))), ",")
    return rows.select("id", joined.alias("ranges"), "x.error")


@query(f"""WITH {_WRITTEN}, {_PRINT_SQL}, x AS (SELECT *, ['all', 'current', 'range'][CAST(id % 3 AS INTEGER) + 1] AS mode, CASE WHEN id % 4 > 0 THEN o_custkey % 15 END AS cur FROM k)
SELECT id, mode, CASE mode WHEN 'all' THEN array_to_string(range(1, total + 1), ',') WHEN 'current' THEN CAST(least(greatest(coalesce(cur, 1), 1), total) AS VARCHAR)
  ELSE CASE WHEN {_CLEAN} <> '' AND len(parts) > 0 AND code IS NULL THEN {_PAGES_SQL} END END AS pages FROM x""")
def page_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of a choice: all, the current one, or a list."""
    mode = Patterns("all", "current", "range").column(F.col("id"))
    rows = _written(spark, sf_dir).withColumns({"mode": mode, "current": F.when(F.col("id") % 4 > 0, F.col("o_custkey") % 15)})
    return rows.select("id", "mode", ranges.chosen_pages(F.col("mode"), F.col("expr"), F.col("current"), F.col("total")).alias("x")).select("id", "mode", _listed("x.pages").alias("pages"))


#: Documents as pages; every seventh number is missing.
_NUMBER = "doc_id + doc_id div 7"


@query("""WITH p AS (SELECT source, CAST(doc_id + doc_id // 7 AS INTEGER) AS d FROM documents),
i AS (SELECT source, d, d - row_number() OVER (PARTITION BY source ORDER BY d) AS g FROM p),
r AS (SELECT source, min(d) AS a, max(d) AS b FROM i GROUP BY source, g),
t AS (SELECT source, a, row_number() OVER (PARTITION BY source ORDER BY a) AS k, CASE WHEN a = b THEN a::VARCHAR ELSE a || '–' || b END AS x, sum(b - a + 1) OVER (PARTITION BY source) AS n, count(*) OVER (PARTITION BY source) AS m FROM r)
SELECT source, 's. ' || CASE WHEN max(m) > 4 THEN string_agg(x, ', ' ORDER BY a) FILTER (k <= 3) || ' … (' || CAST(max(n) AS BIGINT) || ' sayfa)' ELSE string_agg(x, ', ' ORDER BY a) END AS summary FROM t GROUP BY source""")
def page_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page numbers in short: runs, and of many runs the first three."""
    docs = table(spark, sf_dir, "documents").select("source", F.expr(_NUMBER).cast("int").alias("d"))
    return pages.summaries(docs, "source", "d")


@query("""WITH p AS (SELECT DISTINCT source, doc_id + doc_id // 7 AS doc_id FROM documents),
i AS (SELECT source, doc_id, doc_id - row_number() OVER (PARTITION BY source ORDER BY doc_id) AS g FROM p)
SELECT source, min(doc_id) AS first, max(doc_id) AS last FROM i GROUP BY source, g""")
def page_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page list as runs."""
    return pages.islands(table(spark, sf_dir, "documents").select("source", F.expr(_NUMBER).alias("doc_id")), "source", "doc_id")


@query(f"""WITH {RECIPES}, f AS (SELECT *, CASE WHEN src_doc IS NOT NULL AND lag(src_doc) OVER w = src_doc AND lag(src_page) OVER w + 1 = src_page THEN 0 ELSE 1 END AS s FROM t WINDOW w AS (PARTITION BY recipe_id ORDER BY pos)),
g AS (SELECT *, sum(s) OVER (PARTITION BY recipe_id ORDER BY pos) AS run FROM f)
SELECT recipe_id, CAST(run AS BIGINT) AS run, first(src_doc ORDER BY pos) AS src_doc, min(src_page) AS first, max(src_page) AS last, min(pos) AS at, count(*) AS n FROM g GROUP BY recipe_id, run""")
def run_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive pages of a recipe as ranges."""
    return pages.coalesced_runs(recipes(spark, sf_dir))


@query("""WITH t AS (SELECT role AS recipe_id, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS pos, conv_id, turn FROM conversations),
f AS (SELECT *, CASE WHEN lag(conv_id) OVER w = conv_id AND lag(turn) OVER w + 1 = turn THEN 0 ELSE 1 END AS s FROM t WINDOW w AS (PARTITION BY recipe_id ORDER BY pos)),
g AS (SELECT *, sum(s) OVER (PARTITION BY recipe_id ORDER BY pos) AS run FROM f)
SELECT recipe_id, CAST(run AS BIGINT) AS run, min(conv_id) AS src_doc, min(turn) AS first, max(turn) AS last, min(pos) AS at, count(*) AS n FROM g GROUP BY recipe_id, run""")
def run_coalesce_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each role as a recipe of conversations."""
    turns = table(spark, sf_dir, "conversations")
    pos = F.row_number().over(Window.partitionBy("role").orderBy("conv_id", "turn")).cast("long")
    recipe = turns.select(F.col("role").alias("recipe_id"), pos.alias("pos"), F.col("conv_id").alias("src_doc"), F.col("turn").alias("src_page"))
    return pages.coalesced_runs(recipe)


@query(f"""WITH {RECIPES}, {DOC_PAGES}, j AS (SELECT z.*, g.width AS w, g.height AS h, g.rotation AS r FROM z LEFT JOIN g ON g.doc_id = z.src_doc AND g.page_no = z.src_page)
SELECT recipe_id, pos, src_doc, src_page,
  CASE WHEN src_doc IS NULL THEN coalesce(width, last_value(w IGNORE NULLS) OVER o, 595.28::DOUBLE) ELSE w END AS width,
  CASE WHEN src_doc IS NULL THEN coalesce(height, last_value(h IGNORE NULLS) OVER o, 841.89::DOUBLE) ELSE h END AS height,
  CAST((coalesce(r, 0) + coalesce(rotate, 0)) % 360 AS INTEGER) AS rotation
FROM j WINDOW o AS (PARTITION BY recipe_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def recipe_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a recipe with sizes and rotations; blank ones inherit."""
    return pages.build_recipe(recipes(spark, sf_dir), doc_pages(spark, sf_dir))


@query(f"""WITH {DOC_PAGES} SELECT doc_id, page_no, CASE WHEN rotation % 180 = 90 THEN height ELSE width END AS width, CASE WHEN rotation % 180 = 90 THEN width ELSE height END AS height, rotation FROM g""")
def page_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.visible_sizes(doc_pages(spark, sf_dir))


@query(f"WITH {DOC_PAGES} SELECT doc_id, page_no, width, height, CAST(CASE WHEN page_no IN (2, 3) THEN (rotation + 270) % 360 ELSE rotation END AS INTEGER) AS rotation FROM g")
def recipe_rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some pages turned."""
    return pages.rotated(doc_pages(spark, sf_dir), 270, F.col("page_no").isin(2, 3))


_ANGLES = "w AS (SELECT doc_id, page_no, CAST(90 * (page_no % 9) - 360 AS INTEGER) AS angle FROM g)"


@query(f"WITH {DOC_PAGES}, {_ANGLES} SELECT g.doc_id, g.page_no, CAST(((angle % 360) + 360) % 360 AS INTEGER) AS rotation FROM g JOIN w USING (doc_id, page_no) WHERE ((angle % 360) + 360) % 360 <> rotation % 360")
def absolute_rotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The angles that are wanted and new."""
    rows = doc_pages(spark, sf_dir)
    return pages.new_rotations(rows, rows.select("doc_id", "page_no", (90 * (F.col("page_no") % 9) - 360).alias("angle")))


_PAGE_TEXTS, _ANGLE_TEXTS = Patterns("{a}", " {a} ", "x{a}", "", "-{a}"), Patterns("{b}", "-{b}", "y", "{a}")


@query(f"""WITH k AS (SELECT p_partkey, {_PAGE_TEXTS.sql('p_partkey', a='p_size % 10')} AS page, {_ANGLE_TEXTS.sql('p_size', a='p_size', b='45 * (p_partkey % 9)')} AS angle FROM part)
SELECT p_partkey, CASE WHEN TRY_CAST(page AS INTEGER) IS NULL THEN 'not_a_number' WHEN TRY_CAST(page AS INTEGER) NOT BETWEEN 1 AND 7 THEN 'out_of_range' END AS page_error,
  CASE WHEN TRY_CAST(angle AS INTEGER) IS NULL THEN 'not_a_number' WHEN TRY_CAST(angle AS INTEGER) % 90 <> 0 THEN 'not_right_angle' END AS angle_error FROM k""")
def page_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page numbers and rotations that are wrong, by code."""
    page = _PAGE_TEXTS.column(F.col("p_partkey"), a=F.col("p_size") % 10)
    angle = _ANGLE_TEXTS.column(F.col("p_size"), a=F.col("p_size"), b=45 * (F.col("p_partkey") % 9))
    return table(spark, sf_dir, "part").select("p_partkey", pages.page_error(page, F.lit(7)).alias("page_error"), pages.rotation_error(angle).alias("angle_error"))


_BASES, _MODES = Patterns("Rapor {a}", "a/b {a}", "x"), Patterns("ranges", "ranges", "every", "odd")


@query(f"""WITH {_WRITTEN}, {_SPLIT_SQL}, x AS (SELECT *, {_MODES.sql('o_custkey')} AS mode, replace({_BASES.sql('id', a='o_custkey')}, '/', '_') AS base, id % 2 = 0 AS one FROM k),
y AS (SELECT *, CASE WHEN mode NOT IN ('ranges', 'every') THEN 'unknown_mode' WHEN mode = 'ranges' AND len(parts) = 0 THEN 'empty' WHEN mode = 'ranges' THEN code END AS error,
  CASE WHEN mode = 'every' THEN [{{'a': i, 'z': i}} for i in range(1, total + 1)] ELSE spans END AS every FROM x),
s AS (SELECT *, len(every) = 1 OR (mode = 'ranges' AND one) AS single FROM y),
p AS (SELECT id, unnest(range(len(every))) AS part, every, base FROM s WHERE error IS NULL AND NOT single)
SELECT id AS request_id, CAST(part AS INTEGER) AS part, base || ' - Sayfa ' || CASE WHEN every[part + 1].a = every[part + 1].z THEN every[part + 1].a::VARCHAR ELSE every[part + 1].a || '-' || every[part + 1].z END || '.pdf' AS name,
  array_to_string(range(every[part + 1].a, every[part + 1].z + 1), ',') AS pages, CAST(NULL AS VARCHAR) AS error FROM p
UNION ALL SELECT id, 0, base || '.pdf', array_to_string(list_sort(list_distinct(flatten([range(x.a, x.z + 1) for x in every]))), ','), NULL FROM s WHERE error IS NULL AND single
UNION ALL SELECT id, NULL, NULL, NULL, error FROM s WHERE error IS NOT NULL""")
def split_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named parts of split documents."""
    rows = _written(spark, sf_dir)
    requests = rows.select(
        F.col("id").alias("request_id"), _BASES.column(F.col("id"), a=F.col("o_custkey")).alias("base"), _MODES.column(F.col("o_custkey")).alias("mode"),
        Patterns("one", "each").column(F.col("id")).alias("files"), F.col("expr").alias("text"), "total",
    )
    return pages.split_parts(requests).withColumn("pages", _listed("pages"))


@query("""WITH m AS (SELECT role AS merge_id, conv_id AS pos, count(*) AS n_pages FROM conversations GROUP BY role, conv_id)
SELECT merge_id, pos, n_pages, CAST(coalesce(sum(n_pages) OVER (PARTITION BY merge_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base FROM m""")
def merge_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each conversation's turns begin when those of one role are merged."""
    items = table(spark, sf_dir, "conversations").groupBy(F.col("role").alias("merge_id"), F.col("conv_id").alias("pos")).agg(F.count("*").alias("n_pages"))
    return pages.merge_offsets(items)


@query("""WITH c AS (SELECT source AS merge_id, md5(text) AS digest, min_by(n_chars, doc_id) AS size, count(*) AS n FROM documents GROUP BY source, md5(text))
SELECT merge_id, CAST(sum(size + (n - 1) * 60) AS BIGINT) AS total, count(*) AS stored, CAST(sum(n - 1) AS BIGINT) AS repeated FROM c GROUP BY merge_id""")
def merge_size_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of merged documents of three pages each, equal contents stored once."""
    items = table(spark, sf_dir, "documents").select(F.col("source").alias("merge_id"), F.md5("text").alias("digest"), F.col("n_chars").alias("size"), F.lit(3).cast("long").alias("n_pages"), F.col("doc_id").alias("pos"))
    return pages.merged_size(items)


@query(f"""WITH RECURSIVE {OUTLINES}, p AS (SELECT doc_id, old_page, min(new_page) AS n FROM m GROUP BY doc_id, old_page),
k AS (SELECT o.doc_id, o.pos, o.level, coalesce(o.title, '') AS title, p.n AS page_no, row_number() OVER (PARTITION BY o.doc_id ORDER BY o.pos) AS i FROM o JOIN p ON p.doc_id = o.doc_id AND p.old_page = o.page_no),
c AS (SELECT doc_id, pos, i, greatest(1, least(level, 1)) AS level, title, page_no FROM k WHERE i = 1
  UNION ALL SELECT k.doc_id, k.pos, k.i, greatest(1, least(k.level, c.level + 1)), k.title, k.page_no FROM c JOIN k ON k.doc_id = c.doc_id AND k.i = c.i + 1)
SELECT doc_id, pos, CAST(level AS INTEGER) AS level, title, page_no FROM c""")
def outline_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outline entries on their new pages, without jumps of level."""
    return pages.remapped_outline(*outlines(spark, sf_dir))


@query(f"""WITH {OUTLINES} SELECT doc_id, pos, level, title, (SELECT max(b.pos) FROM o b WHERE b.doc_id = a.doc_id AND b.pos < a.pos AND b.level < a.level) AS parent FROM o a""")
def outline_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parent of each outline entry."""
    return pages.outline_parents(outlines(spark, sf_dir)[0])


_LIST_SQL = """a AS (SELECT l_suppkey AS list_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS pos, 'k' || l_partkey % 40 AS page_key, CAST(90 * (l_linenumber % 4) AS INTEGER) AS rotation, l_orderkey, l_quantity FROM lineitem),
b AS (SELECT list_id, row_number() OVER (PARTITION BY list_id ORDER BY l_orderkey % 11, pos) AS pos, page_key, CASE WHEN pos % 5 > 0 THEN rotation END AS rotation FROM a WHERE l_quantity > 5)"""


def _lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Page lists before and after pages went and were put in another order."""
    place = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*ITEM_ORDER))
    old = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("list_id"), place.cast("long").alias("pos"), F.concat(F.lit("k"), (F.col("l_partkey") % 40).cast("string")).alias("page_key"), (90 * (F.col("l_linenumber") % 4)).cast("int").alias("rotation"), "l_orderkey", "l_quantity"
    )
    later = F.row_number().over(Window.partitionBy("list_id").orderBy(F.col("l_orderkey") % 11, "pos")).cast("long")
    new = old.where("l_quantity > 5").select("list_id", later.alias("new_pos"), "page_key", F.when(F.col("pos") % 5 > 0, F.col("rotation")).alias("rotation"))
    return old.drop("l_orderkey", "l_quantity"), new.withColumnRenamed("new_pos", "pos")


@query(f"""WITH {_LIST_SQL}, x AS (SELECT *, row_number() OVER (PARTITION BY list_id, page_key ORDER BY pos) AS nth FROM a), y AS (SELECT *, row_number() OVER (PARTITION BY list_id, page_key ORDER BY pos) AS nth FROM b),
j AS (SELECT coalesce(x.list_id, y.list_id) AS list_id, x.pos AS p, y.pos AS q, coalesce(x.rotation, 0) <> coalesce(y.rotation, 0) AS turned FROM x FULL JOIN y ON x.list_id = y.list_id AND x.page_key = y.page_key AND x.nth = y.nth),
m AS (SELECT list_id, q, p < lag(p) OVER (PARTITION BY list_id ORDER BY q) AS back, turned FROM j WHERE p IS NOT NULL AND q IS NOT NULL)
SELECT list_id, count(*) FILTER (q IS NULL) AS removed, count(*) FILTER (p IS NULL) AS added, coalesce((SELECT bool_or(back) FROM m WHERE m.list_id = j.list_id), false) AS reordered,
  coalesce((SELECT string_agg(q, ',' ORDER BY q) FILTER (turned) FROM m WHERE m.list_id = j.list_id), '') AS rotated FROM j GROUP BY list_id""")
def page_list_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed between two lists of pages."""
    return pages.page_list_diff(*_lists(spark, sf_dir)).withColumn("rotated", _listed("rotated"))


@query(f"WITH {RECIPES} SELECT recipe_id, src_doc, src_page, min(pos) AS at FROM t WHERE src_doc IS NOT NULL GROUP BY ALL")
def shown_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.shown_at(recipes(spark, sf_dir))


@query(f"""WITH {_LIST_SQL}, o AS (SELECT *, page_key = 'k3' AS c, count(*) FILTER (page_key <> 'k3') OVER (PARTITION BY list_id ORDER BY pos) AS others FROM a),
k AS (SELECT *, CASE WHEN c THEN 1 ELSE others - 1 END AS slot FROM o)
SELECT list_id, pos, page_key, rotation, CAST(row_number() OVER (PARTITION BY list_id ORDER BY slot, NOT c, pos) - 1 AS INTEGER) AS new_pos FROM k""")
def page_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages moved within their list."""
    return pages.moved(_lists(spark, sf_dir)[0], F.col("page_key") == "k3", 1)


@query("""WITH p AS (SELECT p_brand AS doc_id, p_partkey AS page_no, 500 + p_size::DOUBLE AS width, 700 + (p_size % 3)::DOUBLE AS height FROM part),
s AS (SELECT *, least(width, height) AS s, greatest(width, height) AS l FROM p),
g AS (SELECT doc_id, floor(s * 2 + 0.5) / 2 AS hs, floor(l * 2 + 0.5) / 2 AS hl, count(*) AS n, min_by(s, page_no) AS short, min_by(l, page_no) AS long FROM s GROUP BY doc_id, hs, hl),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, short * long DESC) AS k FROM g)
SELECT doc_id, short, long, n, CAST(NULL AS VARCHAR) AS paper FROM r WHERE k = 1""")
def mode_page_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest page size of each brand's parts as pages."""
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc_id"), F.col("p_partkey").alias("page_no"), (500 + F.col("p_size").cast("double")).alias("width"), (700 + (F.col("p_size") % 3).cast("double")).alias("height"))
    return pages.common_paper(rows)


_PAPERS = (595.0, 612.0, 841.5, 300.0)
_TALL = (842.0, 792.0, 595.0, 310.0)


@query(f"""WITH p AS (SELECT p_brand AS doc_id, p_partkey AS page_no, [{", ".join(map(str, _PAPERS))}][p_size % 4 + 1]::DOUBLE + p_partkey % 2 AS width, [{", ".join(map(str, _TALL))}][p_size % 4 + 1]::DOUBLE AS height FROM part),
s AS (SELECT *, least(width, height) AS s, greatest(width, height) AS l FROM p),
g AS (SELECT doc_id, count(*) AS n, min_by(s, page_no) AS short, min_by(l, page_no) AS long, min(page_no) AS f FROM s GROUP BY doc_id, floor(s * 2 + 0.5), floor(l * 2 + 0.5)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, short * long DESC, f DESC) AS k FROM g)
SELECT doc_id, short, long, n, CASE {" ".join(f"WHEN abs({w} - short) <= 2 AND abs({h} - long) <= 2 THEN '{name}'" for name, w, h in pages.PAPERS)} END AS paper FROM r WHERE k = 1""")
def paper_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standard papers near the commonest size; of equally common sizes the larger."""
    pick = lambda sizes: F.element_at(F.array(*map(F.lit, sizes)), F.col("p_size") % 4 + 1)
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc_id"), F.col("p_partkey").alias("page_no"), (pick(_PAPERS) + F.col("p_partkey") % 2).alias("width"), pick(_TALL).alias("height"))
    return pages.common_paper(rows)


_MM = 25.4 / 72


@query(f"""WITH p AS (SELECT p_partkey, 100 + p_size * 13::DOUBLE AS w, 200 + p_retailprice % 700 AS h FROM part), o AS (SELECT *, w > h AS sideways, (CASE WHEN w > h THEN h ELSE w END) * {_MM!r}::DOUBLE AS bw, (CASE WHEN w > h THEN w ELSE h END) * {_MM!r}::DOUBLE AS bh FROM p),
s AS (SELECT *, least((210 - 8) / bw, (297 - 8) / bh) AS scale FROM o)
SELECT p_partkey, sideways, round(scale, 6) AS scale, round(bw * scale, 4) AS box_w, round(bh * scale, 4) AS box_h, CAST(least(200, greatest(24, ceil(scale * 96 / 8) * 8)) AS INTEGER) AS dpi, round(least(8.0, sqrt(64e6 / (w * h))), 6) AS cap FROM s""")
def print_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages fitted on paper, with the resolution of a preview and the largest scale to draw at."""
    rows = table(spark, sf_dir, "part").select("p_partkey", (100 + F.col("p_size") * 13.0).alias("w"), (200 + F.col("p_retailprice") % 700).alias("h"))
    rows = rows.withColumn("x", pages.print_layout(F.col("w"), F.col("h"), F.lit(210.0), F.lit(297.0), F.lit(False)))
    cap = F.round(pages.capped_scale(F.col("w"), F.col("h"), F.lit(8.0)), 6)
    return rows.select("p_partkey", "x.sideways", F.round("x.scale", 6).alias("scale"), F.round("x.box_w_mm", 4).alias("box_w"), F.round("x.box_h_mm", 4).alias("box_h"), pages.preview_dpi(F.col("x.scale") * 96).alias("dpi"), cap.alias("cap"))


@query("""WITH g AS (SELECT l_orderkey, CAST(sum(l_linenumber) AS INTEGER) AS n, CAST(2 + l_orderkey % 5 AS INTEGER) AS k FROM lineitem GROUP BY l_orderkey),
i AS (SELECT l_orderkey, n, k, unnest(range(CASE WHEN n > k THEN k ELSE n END)) AS j FROM g)
SELECT DISTINCT l_orderkey, CAST(CASE WHEN n <= k THEN j ELSE round_even(j * (n - 1)::DOUBLE / (k - 1), 0) END AS INTEGER) AS i FROM i""")
def even_sample_idx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evenly spread indices."""
    grid = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_linenumber").cast("int").alias("n")).withColumn("k", (2 + F.col("l_orderkey") % 5).cast("int"))
    return grid.select("l_orderkey", F.explode(text.even_sample(F.col("n"), F.col("k"))).alias("i"))


@query("""WITH p AS (SELECT source AS doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, n_chars AS size FROM documents),
n AS (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id),
i AS (SELECT DISTINCT doc_id, n, CASE WHEN n <= 5 THEN j ELSE CAST(round_even(j * (n - 1)::DOUBLE / 4, 0) AS BIGINT) END AS pos FROM n, range(0, 5) c(j) WHERE n > 5 OR j < n)
SELECT i.doc_id, CAST(n AS INTEGER) AS n, count(*) AS sampled, CAST(round_even(sum(size)::DOUBLE * n / count(*), 0) AS BIGINT) AS estimate FROM i JOIN p ON p.doc_id = i.doc_id AND p.pos = i.pos GROUP BY i.doc_id, n""")
def size_estimate_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of each source's documents from five of them."""
    pos = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), pos.alias("pos"), F.col("n_chars").alias("size"))
    return pages.estimated_size(rows, 5)


@query("""SELECT source AS doc_id, count(*) AS n_pages, CAST(sum(n_chars) AS BIGINT) AS size_chars, max(n_chars) AS longest, count(DISTINCT lang) AS langs FROM documents GROUP BY source""")
def doc_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary of each document (a source, its rows as pages)."""
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("doc_id")).agg(F.count("*").alias("n_pages"), F.sum("n_chars").alias("size_chars"), F.max("n_chars").alias("longest"), F.countDistinct("lang").alias("langs"))
