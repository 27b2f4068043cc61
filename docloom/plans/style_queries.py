"""Styles, data binding, lists, runs, conversion and files over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.operators import convert, styles
from docloom.plans.derived import ITEM_ORDER, TREE, Patterns, tree
from docloom.plans.registry import query
from docloom.plans.text_queries import label_sql
from docloom.session import scratch_path, table
from docloom.sources import sinks, udf_file
from docloom.streaming import hits

_ORDER = ", ".join(ITEM_ORDER)

#: Nodes of trees as styles that name the node above as their parent.
_STYLES = f"""{TREE}, s AS (SELECT doc_id, CASE WHEN node_id = 3 THEN 'default' ELSE 's' || node_id END AS name, CASE WHEN parent_id = 3 THEN 'default' ELSE 's' || parent_id END AS parent, p, o FROM t),
d AS (SELECT doc_id, name, 'k' || p % 6 AS key, 'v' || o % 50 AS value FROM s WHERE name <> 'default' UNION ALL SELECT doc_id, name, 'z' || o % 3, 'w' || p % 9 FROM s WHERE p % 2 = 0 AND name <> 'default')"""


@query(f"""WITH RECURSIVE {_STYLES}, c AS (SELECT doc_id, name, name AS at, parent, 0 AS depth FROM s UNION ALL SELECT c.doc_id, c.name, s.name, s.parent, depth + 1 FROM c JOIN s ON s.doc_id = c.doc_id AND s.name = c.parent WHERE depth < {styles.STYLE_HOPS - 1})
SELECT c.doc_id, c.name, d.key, arg_min(d.value, c.depth) AS value FROM c JOIN d ON d.doc_id = c.doc_id AND d.name = c.at GROUP BY ALL""")
def style_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Styles with what they inherit."""
    named = lambda c: F.when(F.col(c) == 3, "DEFAULT").otherwise(F.concat(F.lit("S"), F.col(c).cast("string")))
    text = lambda letter, number: F.concat(F.lit(letter), number.cast("string"))
    own, more = F.create_map(text("k", F.col("p") % 6), text("v", F.col("o") % 50)), F.create_map(text("z", F.col("o") % 3), text("w", F.col("p") % 9))
    attrs = F.when(F.col("p") % 2 == 0, F.map_concat(own, more)).otherwise(own)
    rows = tree(spark, sf_dir).select("doc_id", named("node_id").alias("name"), named("parent_id").alias("parent"), attrs.alias("attrs"))
    return styles.style_chains(rows).select("doc_id", "name", F.explode("attrs").alias("key", "value"))


#: Nodes of trees as data: leaves with values, rows that repeat; and every tenth as a field that asks for a name.
_DATA = f"""{TREE}, d AS (SELECT doc_id, node_id, parent_id, node_id AS pos, 'n' || p % 7 AS name, ['party', 'PARTY', 'cost'][CAST(o % 3 AS INTEGER) + 1] AS row_name, p % 4 = 0 AS is_row, CASE o % 3 WHEN 0 THEN 'v' || o % 40 WHEN 1 THEN ' ' END AS value, o, p FROM t)"""


def _data(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("o") % 3 == 0, F.concat(F.lit("v"), (F.col("o") % 40).cast("string"))).when(F.col("o") % 3 == 1, " ")
    return tree(spark, sf_dir).select("*", F.col("node_id").alias("pos"), F.concat(F.lit("n"), (F.col("p") % 7).cast("string")).alias("name"), Patterns("party", "PARTY", "cost").column(F.col("o")).alias("row_name"), (F.col("p") % 4 == 0).alias("is_row"), value.alias("value"))


@query(f"""WITH RECURSIVE {_DATA}, u AS (SELECT doc_id, node_id, node_id AS scope, parent_id, is_row FROM d WHERE trim(value) <> '' UNION ALL SELECT u.doc_id, u.node_id, d.node_id, d.parent_id, d.is_row FROM u JOIN d ON d.doc_id = u.doc_id AND d.node_id = u.parent_id WHERE NOT u.is_row),
f AS (SELECT doc_id, node_id AS field_id, 'n' || o % 9 AS name, node_id AS scope, 0 AS depth FROM d WHERE o % 10 = 0 UNION ALL SELECT f.doc_id, f.field_id, f.name, d.parent_id, depth + 1 FROM f JOIN d ON d.doc_id = f.doc_id AND d.node_id = f.scope WHERE d.parent_id IS NOT NULL),
j AS (SELECT f.doc_id, field_id, depth, value, min(pos) AS pos FROM f JOIN u ON u.doc_id = f.doc_id AND u.scope = f.scope JOIN d ON d.doc_id = u.doc_id AND d.node_id = u.node_id AND d.name = f.name GROUP BY ALL),
g AS (SELECT doc_id, field_id, depth, string_agg(value, chr(10) ORDER BY pos) AS value FROM j GROUP BY ALL) SELECT doc_id, field_id, arg_min(value, depth) AS value FROM g GROUP BY ALL""")
def data_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field values from the nearest scope that has them."""
    data = _data(spark, sf_dir)
    fields = data.where("o % 10 = 0").select("doc_id", F.col("node_id").alias("field_id"), F.concat(F.lit("n"), (F.col("o") % 9).cast("string")).alias("name"), F.col("node_id").alias("scope"))
    return styles.bound_values(fields, data)


@query(f"""WITH {_DATA} SELECT w.doc_id, w.row_id, d.node_id, CAST(row_number() OVER (PARTITION BY w.doc_id, w.row_id ORDER BY d.pos) AS INTEGER) AS instance
FROM (SELECT DISTINCT doc_id, o % 3 AS row_id, lower(row_name) AS row_name FROM d WHERE NOT is_row) w JOIN d ON d.doc_id = w.doc_id AND lower(d.row_name) = w.row_name AND d.is_row""")
def row_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The data rows that repeat a table row."""
    data = _data(spark, sf_dir)
    rows = data.where("NOT is_row").select("doc_id", (F.col("o") % 3).alias("row_id"), "row_name").distinct()
    return styles.row_instances(rows, data)


_LIST_KINDS = Patterns("NUMBER_TYPE_NUMBER_DOT", "CHAR_SMALL_PARANTHESE", "ROMAN_BIG_DOT", "")


@query(f"""WITH RECURSIVE i AS (SELECT l_suppkey AS doc_id, l_returnflag AS list_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY {_ORDER}) AS pos, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY {_ORDER}) AS i,
  CAST(least(greatest(coalesce(CASE WHEN l_orderkey % 9 > 0 THEN l_linenumber - 1 END, 1), 1), 9) AS INTEGER) AS level, CASE WHEN l_partkey % 11 = 0 THEN l_partkey % 9 END AS start, {_LIST_KINDS.sql('l_partkey')} AS kind FROM lineitem),
c AS (SELECT doc_id, list_id, i, [CASE WHEN k = level THEN coalesce(start, 0) + 1 ELSE 0 END for k in range(1, 10)] AS n FROM i WHERE i = 1
  UNION ALL SELECT i.doc_id, i.list_id, i.i, [CASE WHEN k = i.level THEN coalesce(i.start, c.n[k]) + 1 WHEN k < i.level THEN c.n[k] ELSE 0 END for k in range(1, 10)] FROM c JOIN i ON i.doc_id = c.doc_id AND i.list_id = c.list_id AND i.i = c.i + 1),
m AS (SELECT i.doc_id, i.pos, i.kind, CAST(c.n[i.level] AS INTEGER) AS n FROM c JOIN i USING (doc_id, list_id, i)) SELECT doc_id, pos, n, {label_sql('n', 'kind')} AS mark FROM m""")
def list_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of list items, by level and start."""
    pos = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*ITEM_ORDER)).cast("long")
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("doc_id"), pos.alias("pos"), F.col("l_returnflag").alias("list_id"), F.when(F.col("l_orderkey") % 9 > 0, F.col("l_linenumber") - 1).cast("int").alias("level"),
        F.when(F.col("l_partkey") % 11 == 0, F.col("l_partkey") % 9).cast("int").alias("start"), F.nullif(_LIST_KINDS.column(F.col("l_partkey")), F.lit("")).alias("kind"),
    )
    return styles.list_marks(items).select("doc_id", "pos", "n", "mark")


@query("""WITH r AS (SELECT doc_id, 0 AS run_no, 0 AS "start", CAST(n_chars AS INTEGER) AS "end" FROM documents WHERE n_chars > 0),
n AS (SELECT doc_id, CAST(k AS INTEGER) AS note_no, CAST(n_chars * k // 7 AS INTEGER) AS a, CAST(n_chars * k // 7 + 40 AS INTEGER) AS b FROM documents, range(0, 6) t(k)),
c AS (SELECT doc_id, "start" AS x FROM r UNION SELECT doc_id, "end" FROM r UNION SELECT n.doc_id, a FROM n JOIN r USING (doc_id) WHERE a > 0 AND a < "end" UNION SELECT n.doc_id, b FROM n JOIN r USING (doc_id) WHERE b > 0 AND b < "end"),
p AS (SELECT doc_id, x AS s, lead(x) OVER (PARTITION BY doc_id ORDER BY x) AS e FROM c)
SELECT doc_id, s AS "start", e AS "end", (SELECT coalesce(string_agg(note_no::VARCHAR, ',' ORDER BY note_no), '') FROM n WHERE n.doc_id = p.doc_id AND n.a <= s AND n.b >= e) AS notes FROM p WHERE e IS NOT NULL""")
def note_range_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs cut where notes begin and end."""
    docs = table(spark, sf_dir, "documents").where("n_chars > 0")
    runs = docs.select("doc_id", F.lit(0).alias("run_no"), F.lit(0).alias("start"), F.col("n_chars").cast("int").alias("end"))
    at = F.floor(F.col("n_chars") * F.col("note_no") / 7).cast("int")
    notes = docs.select("doc_id", "n_chars", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("note_no")).select("doc_id", "note_no", at.alias("start"), (at + 40).alias("end"))
    pieces = styles.split_at_notes(runs, notes)
    return pieces.select("doc_id", "start", "end", F.array_join(F.transform("notes", lambda n: n.cast("string")), ",").alias("notes"))


@query("""WITH c AS (SELECT item_id AS doc_id, unnest(range(1, length(text) + 1)) AS i, text FROM benchmark), s AS (SELECT doc_id, i, substring(text, i, 1) AS c, CASE WHEN regexp_matches(substring(text, i, 1), '[A-Z]') THEN 'bold' END AS style FROM c),
n AS (SELECT *, CASE WHEN i = 1 OR style IS DISTINCT FROM lag(style) OVER (PARTITION BY doc_id ORDER BY i) THEN 1 ELSE 0 END AS f FROM s), r AS (SELECT *, sum(f) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM n)
SELECT doc_id, CAST(run AS BIGINT) AS run, string_agg(c, '' ORDER BY i) AS text, max(style) AS style FROM r GROUP BY doc_id, run""")
def run_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters with equal neighbouring styles as runs, after runs were taken apart."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit(0).alias("run_no"), "text", F.lit(None).cast("string").alias("style"))
    chars = styles.expanded_runs(items).withColumn("style", F.when(F.col("char").rlike("[A-Z]"), "bold"))
    return styles.collapsed_runs(chars)


@query("""SELECT item_id AS doc_id, bool_and(regexp_matches(substring(text, i, 1), '[a-z ]')) FILTER (substring(text, i, 1) <> chr(10)) AS "all" FROM (SELECT item_id, text, unnest(range(length(text) // 4 + 1, length(text) - length(text) // 4 + 1)) AS i FROM benchmark) GROUP BY item_id""")
def run_all_styled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the middle half of each text has one style throughout."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit(0).alias("run_no"), "text", F.lit("x").alias("style"))
    ranges = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.expr("length(text) div 4").alias("first"), F.expr("length(text) - length(text) div 4").alias("end"))
    return styles.all_in_range(styles.expanded_runs(items), ranges, F.col("char").rlike("[a-z ]"))


@query("""WITH c AS (SELECT l_suppkey AS doc_id, l_linenumber AS table_no, l_orderkey AS row_no, l_partkey AS cell_no, round(l_quantity, 4) AS l, round(l_quantity + 1 + l_partkey % 7, 4) AS r FROM lineitem),
e AS (SELECT doc_id, table_no, x, row_number() OVER (PARTITION BY doc_id, table_no ORDER BY x) - 1 AS k FROM (SELECT doc_id, table_no, l AS x FROM c UNION SELECT doc_id, table_no, r FROM c))
SELECT c.doc_id, c.table_no, row_no, cell_no, CAST(a.k AS INTEGER) AS "column", CAST(b.k - a.k AS INTEGER) AS span FROM c JOIN e a ON a.doc_id = c.doc_id AND a.table_no = c.table_no AND a.x = l JOIN e b ON b.doc_id = c.doc_id AND b.table_no = c.table_no AND b.x = r""")
def table_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells on the grid of all column boundaries."""
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").alias("table_no"), F.col("l_orderkey").alias("row_no"), F.col("l_partkey").alias("cell_no"), F.col("l_quantity").alias("left"), (F.col("l_quantity") + 1 + F.col("l_partkey") % 7).alias("right"))
    return styles.table_grid(cells)


@query("""SELECT conv_id AS doc_id, turn AS pos, section FROM (SELECT conv_id, turn, role, CAST(sum(CASE WHEN role = 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS section FROM conversations) WHERE role <> 'system'""")
def block_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks in sections between page breaks."""
    blocks = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), (F.col("role") == "system").alias("is_break"))
    return styles.sections(blocks)


_SPECS = Patterns("BSP32_{a}", " bsp_{a} ", "BSP32_x{a}", "{a}")


@query(f"""WITH r AS (SELECT p_partkey, {_SPECS.sql('p_size', a='p_partkey * 8')} AS spec FROM part), b AS (SELECT p_partkey, TRY_CAST(regexp_extract(trim(spec), '(?i)^BSP[0-9]*_([0-9]{{1,9}})$', 1) AS INTEGER) AS b FROM r)
SELECT p_partkey, CASE WHEN b & 8 <> 0 THEN CASE WHEN b & 32 <> 0 THEN 'center' WHEN b & 64 <> 0 THEN 'right' ELSE 'left' END END AS alignment, CASE WHEN b & 8 <> 0 THEN b & 2048 <> 0 END AS total FROM b""")
def page_number_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where page numbers stand, by the bits of their form."""
    spec = _SPECS.column(F.col("p_size"), a=F.col("p_partkey") * 8)
    return table(spark, sf_dir, "part").select("p_partkey", styles.page_number_spec(spec).alias("p")).select("p_partkey", "p.*")


@query("""WITH p AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_size::DOUBLE END AS w, CASE WHEN p_size % 2 = 0 THEN p_size * 2::DOUBLE END AS h, p_size * 40 AS pw, p_size * 30 AS ph FROM part),
s AS (SELECT *, coalesce(w, h * pw / ph, pw) AS a, coalesce(h, w * ph / pw, ph) AS b FROM p), k AS (SELECT *, least(1.0, 400 / a, 500 / b) AS k FROM s)
SELECT p_partkey, round(greatest(1.0, a * k), 6) AS width, round(greatest(1.0, b * k), 6) AS height FROM k""")
def image_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures sized by ratio and fitted."""
    size = F.col("p_size").cast("double")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 3 == 0, size).alias("w"), F.when(F.col("p_size") % 2 == 0, size * 2).alias("h"), (size * 40).alias("pw"), (size * 30).alias("ph"))
    sized = rows.select("p_partkey", styles.image_size(F.col("w"), F.col("h"), F.col("pw"), F.col("ph"), F.lit(400.0), F.lit(500.0)).alias("s"))
    return sized.select("p_partkey", F.round("s.width", 6).alias("width"), F.round("s.height", 6).alias("height"))


_KINDS_OF_FILES = Patterns(*convert.TARGETS)


@query(f"""WITH x AS (SELECT {_KINDS_OF_FILES.sql('l_partkey')} AS src, {_KINDS_OF_FILES.sql('l_orderkey')} AS dst, l_quantity AS q FROM lineitem WHERE (l_partkey + l_orderkey) % 3 > 0),
c AS (SELECT src, dst, bool_or(q > 25) AS ready FROM x WHERE src <> dst AND (src = 'pdf' OR dst = 'pdf') GROUP BY src, dst),
t AS (SELECT src, dst, 1 AS hops, ready FROM c UNION ALL SELECT a.src, b.dst, 2, a.ready AND b.ready FROM c a JOIN c b ON a.dst = 'pdf' AND b.src = 'pdf' WHERE a.src <> 'pdf' AND a.src <> b.dst),
m AS (SELECT src, dst, min({{'hops': hops, 'ready': ready}}) AS m FROM t GROUP BY ALL)
SELECT src, dst, CAST(m.hops AS INTEGER) AS hops, m.ready AS ready, CAST(list_position([{", ".join(f"'{t}'" for t in convert.TARGETS)}], dst) AS INTEGER) AS place FROM m""")
def convert_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each kind of file reaches each other."""
    rows = table(spark, sf_dir, "lineitem").where("(l_partkey + l_orderkey) % 3 > 0")
    rows = rows.select(_KINDS_OF_FILES.column(F.col("l_partkey")).alias("src"), _KINDS_OF_FILES.column(F.col("l_orderkey")).alias("dst"), "l_quantity")
    converters = rows.where("src <> dst AND (src = 'pdf' OR dst = 'pdf')").groupBy("src", "dst").agg(F.bool_or(F.col("l_quantity") > 25).alias("ready"))
    return convert.plans(rows.select(F.col("src").alias("kind")).distinct(), converters)


_TAKEN_NAMES = Patterns("R{a}", "R{a} ({b})", "R{a} ({b})", "R{a} (0{b})", "x ({b}) ({a})")
_TAKEN = f"t AS (SELECT DISTINCT l_suppkey AS folder, {_TAKEN_NAMES.sql('l_partkey', a='l_linenumber', b='1 + l_orderkey % 20')} AS name FROM lineitem)"


@query(f"""WITH {_TAKEN}, w AS (SELECT DISTINCT l_suppkey AS folder, 'R' || l_linenumber % 9 AS name FROM lineitem UNION SELECT folder, name FROM t WHERE name LIKE 'x%'),
k AS (SELECT w.*, unnest(range(2, (SELECT count(*) FROM t WHERE t.folder = w.folder) + 3)) AS k FROM w), f AS (SELECT folder, name, min(k) AS k FROM k WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.folder = k.folder AND t.name = k.name || ' (' || k.k || ')') GROUP BY ALL)
SELECT w.folder, w.name, CASE WHEN EXISTS (SELECT 1 FROM t WHERE t.folder = w.folder AND t.name = w.name) THEN w.name || ' (' || f.k || ')' ELSE w.name END AS free FROM w LEFT JOIN f USING (folder, name)""")
def free_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest free number of each wanted name."""
    items = table(spark, sf_dir, "lineitem")
    taken = items.select(F.col("l_suppkey").alias("folder"), _TAKEN_NAMES.column(F.col("l_partkey"), a=F.col("l_linenumber"), b=1 + F.col("l_orderkey") % 20).alias("name")).distinct()
    wanted = items.select(F.col("l_suppkey").alias("folder"), F.concat(F.lit("R"), (F.col("l_linenumber") % 9).cast("string")).alias("name")).unionByName(taken.where("name LIKE 'x%'")).distinct()
    return convert.free_names(wanted, taken)


_BASE_NAMES = Patterns("Rapor {a}", "Rapor ({b})", "Rapor (20{b})", "Rapor ({a}23)x", "x({b})")


@query(f"""WITH r AS (SELECT p_partkey, {_BASE_NAMES.sql('p_partkey', a='p_size', b='10 + p_partkey % 90')} AS name FROM part), n AS (SELECT *, TRY_CAST(regexp_extract(name, ' \\(([0-9]{{1,3}})\\)$', 1) AS INTEGER) AS n FROM r),
b AS (SELECT *, CASE WHEN n IS NULL THEN name ELSE regexp_replace(name, ' \\([0-9]{{1,3}}\\)$', '') END AS base FROM n) SELECT p_partkey, base || ' (' || coalesce(n, 0) + 1 || ')' AS first, base || ' (' || coalesce(n, 0) + 2 || ')' AS second FROM b""")
def next_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names that are tried after a name."""
    name = _BASE_NAMES.column(F.col("p_partkey"), a=F.col("p_size"), b=10 + F.col("p_partkey") % 90)
    names = table(spark, sf_dir, "part").select("p_partkey", convert.next_names(name, 2).alias("n"))
    return names.select("p_partkey", F.col("n")[0].alias("first"), F.col("n")[1].alias("second"))


@query("""WITH f AS (SELECT source AS base, doc_id // 20 AS k FROM documents WHERE doc_id // 20 NOT IN (12, 30)), w AS (SELECT source AS base, CAST(regexp_extract(source, '[0-9]+') AS BIGINT) AS n FROM documents GROUP BY source),
l AS (SELECT DISTINCT base, k, n FROM f JOIN w USING (base) WHERE n > 1 AND k > n), r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY k) AS p FROM l) SELECT base, k FROM r WHERE k = n + p""")
def leftover_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page files left over from a longer run."""
    docs = table(spark, sf_dir, "documents")
    k = F.floor(F.col("doc_id") / 20)
    files = docs.select(F.col("source").alias("base"), k.alias("k")).where(~F.col("k").isin(12, 30)).distinct()
    written = docs.select(F.col("source").alias("base"), F.regexp_extract("source", r"(\d+)", 1).cast("long").alias("n")).distinct()
    return convert.leftover_pages(files, written)


@query("""SELECT page_id, 'bilinmeyen' AS kind, CAST(NULL AS VARCHAR) AS sub FROM pages WHERE page_id % 5 > 3 UNION ALL SELECT page_id, 'pdf', NULL FROM pages WHERE page_id % 5 = 0 UNION ALL SELECT page_id, 'gorsel', 'png' FROM pages WHERE page_id % 5 = 1
UNION ALL SELECT page_id, 'udf', 'xml' FROM pages WHERE page_id % 5 = 2 UNION ALL SELECT page_id, 'word', 'rtf' FROM pages WHERE page_id % 5 = 3""")
def sniff_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of files by their first bytes: pages behind several magics."""
    html = F.col("html").cast("binary")
    n = F.col("page_id") % 5
    magic = F.when(n == 0, F.unhex(F.lit(b"junk %PDF-1.7\n".hex()))).when(n == 1, F.unhex(F.lit("89504E470D0A1A0A"))).when(n == 2, F.unhex(F.lit("﻿  <a><template>".encode().hex()))).when(n == 3, F.unhex(F.lit(b" {\\rtf1".hex()))).otherwise(F.unhex(F.lit("")))
    return table(spark, sf_dir, "pages").select("page_id", convert.file_kind(F.concat(magic, html)).alias("k")).select("page_id", "k.*")


_HEADS = Patterns("FFD8FF{a}", "474946383961{a}", "474946383861{a}", "424D000000000000000000000000{a}000000", "5249464600000000574542{a}", "0000001466747970686569{b}000000006D696631", "00000018667479706176{b}00000000{a}", "89504E470D0A1A0A{a}", "{a}")


@query(f"""WITH r AS (SELECT p_partkey, {_HEADS.sql('p_partkey', a="printf('%02X', 32 + p_size)", b="['6966', '6373', '6963', '6D66'][CAST(p_size % 4 AS INTEGER) + 1]")} AS raw FROM part), x AS (SELECT *, length(raw) // 2 AS n FROM r),
b AS (SELECT *, CASE WHEN raw[9:16] = '66747970' AND n >= 16 THEN list_prepend(raw[17:24], [raw[2 * i + 1:2 * i + 8] for i in range(16, 1 + CAST(least(greatest(16, least(TRY_CAST('0x' || raw[1:8] AS BIGINT), n)) - 4, 8188) AS BIGINT), 4)]) END AS brands FROM x)
SELECT p_partkey, CASE WHEN raw[1:6] = 'FFD8FF' THEN 'jpeg' WHEN raw[1:16] = '89504E470D0A1A0A' THEN 'png' WHEN raw[1:12] IN ('474946383761', '474946383961') THEN 'gif'
  WHEN raw[1:4] = '424D' AND n >= 18 AND TRY_CAST('0x' || raw[35:36] || raw[33:34] || raw[31:32] || raw[29:30] AS BIGINT) IN ({", ".join(map(str, convert.BMP_HEADERS))}) THEN 'bmp' WHEN raw[1:8] = '52494646' AND raw[17:24] = '57454250' THEN 'webp'
  WHEN list_has_any(brands, [{", ".join(f"'{x.encode().hex().upper()}'" for x in convert.AVIF_BRANDS)}]) THEN 'avif' WHEN list_has_any(brands, [{", ".join(f"'{x.encode().hex().upper()}'" for x in convert.HEIF_BRANDS)}]) THEN 'heif' END AS kind FROM b""")
def image_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of pictures by their first bytes."""
    brand = Patterns("6966", "6373", "6963", "6D66").column(F.col("p_size"))
    raw = _HEADS.column(F.col("p_partkey"), a=F.lpad(F.hex(32 + F.col("p_size")), 2, "0"), b=brand)
    return table(spark, sf_dir, "part").select("p_partkey", convert.image_kind(F.unhex(raw)).alias("kind"))


@query("""WITH e AS (SELECT l_orderkey % 500 AS path, CAST(l_extendedprice * 40 AS BIGINT) AS size, CAST(l_quantity AS BIGINT) * 900 AS compressed FROM lineitem),
f AS (SELECT path, count(*) AS n, sum(size) AS total, bool_or(size > 1048576 AND size > 200 * greatest(compressed, 1)) AS bomb FROM e GROUP BY path)
SELECT path, CASE WHEN n > 10000 THEN 'too_many' WHEN bomb THEN 'bomb' ELSE 'too_large' END AS reason FROM f WHERE n > 10000 OR bomb OR total > 314572800""")
def zip_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives that may not be opened."""
    entries = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 500).alias("path"), F.round(F.col("l_extendedprice") * 40).cast("long").alias("size"), (F.col("l_quantity").cast("long") * 900).alias("compressed"))
    return convert.unsafe_archives(entries)


@query("""SELECT doc_id, CAST(i - 1 AS INTEGER) AS block, s[i] || chr(10) AS text FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT item_id AS doc_id, string_split(text, chr(10)) AS s FROM benchmark))""")
def udf_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs written to document archives and read back from the shared folder."""
    lines = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.posexplode(F.split("text", "\n", -1)).alias("para_no", "text"))
    path = scratch_path(spark, "archives")
    sinks.archives(lines).write.parquet(path)
    files = spark.read.parquet(path).select(F.col("doc_id").cast("string").alias("path"), "content")
    return udf_file.runs(files).select(F.col("path").cast("long").alias("doc_id"), "block", "text")


@query("""SELECT doc_id, start FROM (WITH d AS (SELECT doc_id, lower(translate(text, 'ĠġĢģ‟İI', 'iŞşş"iı')) AS f FROM documents),
m AS (SELECT doc_id, regexp_extract_all(f, '(the\\s+of)', 1) AS w, string_split_regex(f, 'the\\s+of') AS s FROM d), h AS (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM m WHERE len(w) > 0)
SELECT doc_id, CAST(list_sum([length(x) for x in s[1:i]]) + coalesce(list_sum([length(x) for x in w[1:i-1]]), 0) AS INTEGER) AS start FROM h)""")
def stream_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search hits of a stream of documents, delivered once each."""
    batch = table(spark, sf_dir, "documents")
    stream = hits.pages(spark, f"{sf_dir}/documents.parque[t]", batch.schema)  # a glob takes a file or a folder
    return hits.delivered(hits.hits(stream, "the of")).select("doc_id", "start")


_PAPERS, _LYING, _MARGINS = Patterns(*styles.PAPERS, "odd {a}", " a4 "), Patterns("1", "0", "2", "landscape", " 0 ", ""), Patterns("{a}", "-{a}", "", "{a}00", "x")
_SIDE_PICKS = {"left": "p_partkey", "right": "p_partkey + p_size", "top": "p_size", "bottom": "p_partkey // 7"}


def _margin_sql(side: str, seen: str) -> str:
    most = "width" if seen in ("left", "right") else "height"
    return f"""CASE WHEN TRY_CAST(m_{side} AS DOUBLE) >= 0 THEN least(TRY_CAST(m_{side} AS DOUBLE), {most} * 0.4) ELSE {styles.USUAL_MARGINS[side]}::DOUBLE END"""


@query(f"""WITH r AS (SELECT p_partkey, upper(trim({_PAPERS.sql('p_partkey', a='p_size')})) AS paper, nullif({_LYING.sql('p_size')}, '') AS orientation, {", ".join(f"nullif({_MARGINS.sql(pick, a='p_size')}, '') AS m_{side}" for side, pick in _SIDE_PICKS.items())} FROM part),
s AS (SELECT *, CASE paper {" ".join(f"WHEN '{k}' THEN {w}" for k, (w, h) in styles.PAPERS.items())} ELSE {styles.PAPERS["1"][0]} END::DOUBLE AS w, CASE paper {" ".join(f"WHEN '{k}' THEN {h}" for k, (w, h) in styles.PAPERS.items())} ELSE {styles.PAPERS["1"][1]} END::DOUBLE AS h,
  CASE WHEN lower(trim(coalesce(orientation, '1'))) = '2' THEN 'reverse' WHEN lower(trim(coalesce(orientation, '1'))) IN ('0', 'landscape') THEN 'landscape' ELSE 'upright' END AS turn FROM r),
z AS (SELECT *, CASE WHEN turn = 'upright' THEN w ELSE h END AS width, CASE WHEN turn = 'upright' THEN h ELSE w END AS height FROM s)
SELECT p_partkey, width, height, {", ".join("CASE turn " + " ".join(f"WHEN '{t}' THEN {_margin_sql(sides[seen], seen)}" for t, sides in styles.SIDES.items()) + f' END AS "{seen}"' for seen in styles.USUAL_MARGINS)} FROM z""")
def page_setups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as they are seen, with their margins."""
    size = F.col("p_size")
    margins = {side: F.nullif(_MARGINS.column(F.expr(pick.replace("//", "div")), a=size), F.lit("")) for side, pick in _SIDE_PICKS.items()}
    setup = styles.page_setup(_PAPERS.column(F.col("p_partkey"), a=size), F.nullif(_LYING.column(size), F.lit("")), margins)
    return table(spark, sf_dir, "part").select("p_partkey", setup.alias("s")).select("p_partkey", "s.*")


#: What each document's signature holds: digests of the text or of something else, in records of several forms, whole or broken.
_SIGNED = {
    0: ("consistent", "SHA-256"), 1: ("consistent", "SHA-1"), 2: ("inconsistent", "SHA-256"), 3: ("consistent", "SHA-512"), 4: ("unknown", None), 5: ("consistent", "SHA-384"), 6: ("unknown", None), 7: ("inconsistent", "SHA-1"),
}


@query(f"""SELECT doc_id, CASE doc_id % 8 {" ".join(f"WHEN {k} THEN '{s}'" for k, (s, _) in _SIGNED.items())} END AS state, CASE doc_id % 8 {" ".join(f"WHEN {k} THEN '{a}'" for k, (_, a) in _SIGNED.items() if a)} END AS algorithm FROM documents""")
def signature_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the digests within signatures are those of the content."""
    content, kind = F.coalesce(F.col("text"), F.lit("")).cast("binary"), F.col("doc_id") % 8
    head = F.concat(F.lit("308201"), F.hex(F.sha2(F.col("source"), 256)), F.lit(convert.MESSAGE_DIGEST.replace(" ", "")))
    other = F.sha2(F.concat(F.lit("not "), F.col("source")), 256)
    second = F.concat(head, F.lit("81"), F.lit("22"))  # an identifier without a set behind it
    body = (
        F.when(kind == 0, F.concat(F.lit("31220420"), F.sha2(content, 256)))
        .when(kind == 1, F.concat(F.lit("318116048114"), F.sha1(content)))
        .when(kind == 2, F.concat(F.lit("31220420"), other))
        .when(kind == 3, F.concat(F.lit("31220420"), other, head, F.lit("31820042" + "04820040"), F.sha2(content, 512)))
        .when(kind == 4, F.concat(F.lit("31220420"), F.substring(other, 1, 62)))  # a byte short
        .when(kind == 5, F.concat(F.lit("31320430"), F.sha2(content, 384), F.lit("0500")))
        .when(kind == 6, F.concat(F.lit("0420"), other, second))
        .otherwise(F.concat(F.lit("31160414"), F.sha1(F.concat(content, F.lit("x").cast("binary")))))
    )
    signature = F.unhex(F.concat(head, body))
    return table(spark, sf_dir, "documents").select("doc_id", convert.digest_state(content, convert.message_digests(signature)).alias("s")).select("doc_id", "s.*")
