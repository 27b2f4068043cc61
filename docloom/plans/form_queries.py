"""Forms, small lists and paragraphs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.operators import desk, forms, paragraphs
from docloom.plans.derived import ITEM_ORDER, TREE, Patterns, tree
from docloom.plans.registry import query
from docloom.session import table

_ORDER = ", ".join(ITEM_ORDER)

_BOUNDS = Patterns("{a}", "-{a}", "x", "", "{b}")


@query(f"""WITH r AS (SELECT p_partkey, nullif({_BOUNDS.sql('p_partkey', a='p_size % 4', b='p_size')}, '') AS low, nullif({_BOUNDS.sql('p_size', a='1', b='p_size')}, '') AS high FROM part)
SELECT p_partkey, greatest(0, coalesce(TRY_CAST(low AS INTEGER), 1)) AS least, coalesce(TRY_CAST(high AS INTEGER), 1) AS most FROM r""")
def occurrence_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often subforms may occur."""
    low = F.nullif(_BOUNDS.column(F.col("p_partkey"), a=F.col("p_size") % 4, b=F.col("p_size")), F.lit(""))
    high = F.nullif(_BOUNDS.column(F.col("p_size"), a=F.lit(1), b=F.col("p_size")), F.lit(""))
    return table(spark, sf_dir, "part").select("p_partkey", forms.occurrence(low, high).alias("o")).select("p_partkey", "o.*")


#: Nodes of trees as nodes of forms, some unnamed, some bound in other ways.
_TAGS, _MATCHES = Patterns("subform", "subform", "subform", "field", "area", "subform", "draw", "pageArea", "proto"), Patterns("once", "", "once", "none", "once", "dataRef", "once", "global")
_FORM = f"""{TREE}, n AS (SELECT doc_id, node_id, parent_id, {_TAGS.sql('p')} AS tag, CASE WHEN p % 3 > 0 THEN 'n' || o % 12 END AS name, nullif({_MATCHES.sql('o')}, '') AS match, p, o FROM t)"""


def _form(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("p") % 3 > 0, F.concat(F.lit("n"), (F.col("o") % 12).cast("string")))
    return tree(spark, sf_dir).select("doc_id", "node_id", "parent_id", _TAGS.column(F.col("p")).alias("tag"), name.alias("name"), F.nullif(_MATCHES.column(F.col("o")), F.lit("")).alias("match"), "p", "o")


@query(f"""WITH RECURSIVE {_FORM}, f AS (SELECT *, tag IN ('pageArea', 'pageSet') OR (tag = 'subform' AND name IS NOT NULL AND match IN ('dataRef', 'global')) AS barred, tag = 'subform' AND name IS NOT NULL AND coalesce(match, 'once') = 'once' AS part FROM n),
d AS (SELECT doc_id, node_id, tag, coalesce(barred, false) AS barred, CASE WHEN part THEN name ELSE '' END AS path FROM f WHERE parent_id IS NULL
  UNION ALL SELECT f.doc_id, f.node_id, f.tag, d.barred OR coalesce(f.barred, false), d.path || CASE WHEN f.part THEN CASE WHEN d.path <> '' THEN '.' ELSE '' END || f.name ELSE '' END FROM d JOIN f ON f.doc_id = d.doc_id AND f.parent_id = d.node_id)
SELECT doc_id, node_id, CASE WHEN NOT barred AND path <> '' THEN path END AS path FROM d WHERE tag = 'subform'""")
def form_data_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The data that each subform is bound to."""
    return forms.data_paths(_form(spark, sf_dir).drop("p", "o"))


_BOXES = ", ".join(f"'{c}'" for c in forms.CONTAINERS)
#: Named nodes with what holds them: each container itself, and what is above them while it is unnamed.
_SCOPES = f"""b AS (SELECT doc_id, parent_id AS holder, node_id, name, 0 AS hop FROM n WHERE name IS NOT NULL AND parent_id IS NOT NULL UNION ALL SELECT b.doc_id, n.parent_id, b.node_id, b.name, hop + 1 FROM b JOIN n ON n.doc_id = b.doc_id AND n.node_id = b.holder WHERE n.name IS NULL AND n.parent_id IS NOT NULL),
h AS (SELECT doc_id, holder, node_id, name, 1 AS inside FROM b UNION ALL SELECT doc_id, node_id, node_id, name, 0 FROM n WHERE tag IN ({_BOXES}) AND name IS NOT NULL),
k AS (SELECT h.* FROM h JOIN n ON n.doc_id = h.doc_id AND n.node_id = h.holder AND n.tag IN ({_BOXES})),
u AS (SELECT doc_id, lookup_id, name, spot, 0 AS depth FROM l UNION ALL SELECT u.doc_id, u.lookup_id, u.name, n.parent_id, depth + 1 FROM u JOIN n ON n.doc_id = u.doc_id AND n.node_id = u.spot WHERE n.parent_id IS NOT NULL),
s AS (SELECT u.doc_id, u.lookup_id, arg_min(k.node_id, {{'depth': u.depth, 'inside': k.inside, 'node': k.node_id}}) AS node_id FROM u JOIN k ON k.doc_id = u.doc_id AND k.holder = u.spot AND k.name = u.name GROUP BY ALL)"""


@query(f"WITH RECURSIVE {_FORM}, l AS (SELECT doc_id, node_id AS lookup_id, node_id AS spot, 'n' || (o + p) % 14 AS name FROM n WHERE o % 3 = 0), {_SCOPES} SELECT doc_id, lookup_id, node_id FROM s")
def form_scope_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a name means from where it is used."""
    nodes = _form(spark, sf_dir)
    lookups = nodes.where("o % 3 = 0").select("doc_id", F.col("node_id").alias("lookup_id"), F.col("node_id").alias("at"), F.concat(F.lit("n"), ((F.col("o") + F.col("p")) % 14).cast("string")).alias("name"))
    return forms.found_in_scope(lookups, nodes.drop("p", "o"))


_PATHS = Patterns("n{a}.n{b}", "this.parent", "n{a}", "n{a}._n{b}", "this.n{b}", "n{a}.instanceManager", "n{a}.n{b}[0].parent", "a b", "_n{a}.n{b}", "$")


@query(f"""WITH RECURSIVE {_FORM}, q AS (SELECT doc_id, node_id AS path_id, node_id AS spot, CAST(p % 10 AS INTEGER) AS kind, 'n' || o % 13 AS a, 'n' || (o + p) % 12 AS z FROM n WHERE o % 4 = 0),
l AS (SELECT doc_id, path_id AS lookup_id, spot, a AS name FROM q WHERE kind NOT IN (1, 4, 7, 9)), {_SCOPES},
c AS (SELECT doc_id, holder, name, arg_min(node_id, {{'hop': hop, 'node': node_id}}) AS child FROM b GROUP BY ALL),
o AS (SELECT x.doc_id, x.node_id, y.node_id AS up FROM n x JOIN n y ON y.doc_id = x.doc_id AND y.node_id = x.parent_id WHERE x.tag IN ({_BOXES}) AND y.tag IN ({_BOXES})),
f AS (SELECT q.*, CASE WHEN kind IN (1, 4, 9) THEN spot ELSE s.node_id END AS first FROM q LEFT JOIN s ON s.doc_id = q.doc_id AND s.lookup_id = q.path_id WHERE kind <> 7),
r AS (SELECT f.doc_id, path_id, CASE WHEN kind IN (2, 5, 9) THEN first WHEN kind IN (0, 3, 4) THEN c.child WHEN kind = 1 THEN o.up WHEN kind = 6 THEN p.up END AS node_id, kind IN (3, 5) AS manager
  FROM f LEFT JOIN c ON c.doc_id = f.doc_id AND c.holder = f.first AND c.name = f.z LEFT JOIN o ON o.doc_id = f.doc_id AND o.node_id = f.first LEFT JOIN o p ON p.doc_id = f.doc_id AND p.node_id = c.child)
SELECT * FROM r WHERE node_id IS NOT NULL""")
def form_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What paths mean from where they are used."""
    nodes = _form(spark, sf_dir)
    path = _PATHS.column(F.col("p"), a=F.col("o") % 13, b=(F.col("o") + F.col("p")) % 12)
    paths = nodes.where("o % 4 = 0").select("doc_id", F.col("node_id").alias("path_id"), F.col("node_id").alias("at"), path.alias("path"))
    return forms.resolved_paths(paths, nodes.drop("p", "o"))


_EDITS = "e AS (SELECT p_partkey, CAST(CASE WHEN p_partkey % 40 = 0 THEN 1000 ELSE p_size % 6 END AS INTEGER) AS groups, CAST(p_partkey % 3 AS INTEGER) AS least, CAST(p_partkey % 5 + p_partkey % 3 - 1 AS INTEGER) AS most, p_partkey % 2 = 0 AS adds, CAST(CASE WHEN p_size % 4 > 0 THEN p_size % 8 END AS INTEGER) AS place FROM part)"


@query(f"""WITH {_EDITS}, c AS (SELECT *, greatest(least, groups) AS n, CASE WHEN most >= 0 THEN most ELSE {forms.MOST_INSTANCES} END AS b FROM e)
SELECT p_partkey, CASE WHEN adds THEN CASE WHEN n >= b THEN n ELSE n + 1 END WHEN n <= least OR place >= groups THEN n ELSE n - 1 END AS count, CASE WHEN adds THEN CASE WHEN n >= b THEN b END WHEN n <= least THEN least END AS bound,
  CASE WHEN NOT adds AND n > least AND coalesce(place < groups, true) THEN coalesce(place, CASE WHEN groups >= n THEN n - 1 END) END AS removed FROM c""")
def form_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances added and removed within their bounds."""
    size, key = F.col("p_size"), F.col("p_partkey")
    groups, least, most = F.when(key % 40 == 0, 1000).otherwise(size % 6).cast("int"), (key % 3).cast("int"), (key % 5 + key % 3 - 1).cast("int")
    edit = forms.edited_instances(groups, least, most, Patterns("add", "remove").column(key), F.when(size % 4 > 0, size % 8).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", edit.alias("e")).select("p_partkey", "e.count", F.col("e.limit").alias("bound"), "e.removed")


@query("""WITH l AS (SELECT user_id AS "user", lower(event_type) AS f, max(ts) AS latest, max_by(event_type, ts) AS path FROM events GROUP BY ALL)
SELECT "user", CAST(place AS INTEGER) AS place, path FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY latest DESC, f) AS place FROM l) WHERE place <= 3""")
def recent_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last kinds of events of each user, as recent files."""
    opened = table(spark, sf_dir, "events").select(F.col("user_id").alias("user"), F.col("event_type").alias("path"), F.col("ts").alias("at"))
    return desk.recent_files(opened, 3)


@query("""SELECT cache, key FROM (SELECT event_type AS cache, event_id AS key, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS age FROM events) WHERE age > 8""")
def cache_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that the newest eight of a cache push out."""
    entries = table(spark, sf_dir, "events").select(F.col("event_type").alias("cache"), F.col("event_id").alias("key"), F.col("ts").alias("used_at"))
    return desk.evicted(entries, 8).select("cache", "key")


@query("""WITH p AS (SELECT s_suppkey AS pos, trim(CASE WHEN s_suppkey % 9 = 0 THEN '  ' ELSE ' printer ' || s_suppkey % 60 END) AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'Printer ' || chr(CAST(97 + s_suppkey % 26 AS INTEGER)) || s_suppkey % 7 END AS shown FROM supplier),
g AS (SELECT name, arg_min(coalesce(shown, name), pos) AS shown, min(pos) AS pos FROM p WHERE name <> '' GROUP BY name)
SELECT CAST(row_number() OVER (ORDER BY lower(shown), pos) AS INTEGER) AS place, name, shown, name = 'printer 7' AS usual FROM g""")
def printer_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printers once each, by their shown names."""
    key = F.col("s_suppkey")
    name = F.when(key % 9 == 0, "  ").otherwise(F.concat(F.lit(" printer "), (key % 60).cast("string")))
    shown = F.when(key % 3 == 0, F.concat(F.lit("Printer "), F.char(97 + key % 26), (key % 7).cast("string")))
    return desk.printers(table(spark, sf_dir, "supplier").select(key.alias("pos"), name.alias("name"), shown.alias("display_name")), "printer 7")


_STATES = Patterns('[{"Name":"A{a}","PrinterStatus":{b},"CapabilityDescriptions":["Copies","Duplex"]},{"Name":" "}]', '{"Name":"B{a}","PortName":"portprompt:","Default":true}', "", '[{"Name":"C","WorkOffline":true,"PortName":"USB{a}"},{"Name":"D ","ExtendedPrinterStatus":{b},"CapabilityDescriptions":[]}]')


@query(f"""WITH r AS (SELECT s_suppkey, {_STATES.sql('s_suppkey', a='s_suppkey', b='s_suppkey % 9')} AS raw FROM supplier), j AS (SELECT s_suppkey, unnest(from_json(CASE WHEN raw LIKE '[%' THEN raw ELSE '[' || raw || ']' END,
  '[{{"Name":"VARCHAR","Default":"BOOLEAN","WorkOffline":"BOOLEAN","PrinterStatus":"INTEGER","ExtendedPrinterStatus":"INTEGER","PortName":"VARCHAR","CapabilityDescriptions":["VARCHAR"]}}]')) AS p FROM r)
SELECT s_suppkey, trim(p.Name) AS name, coalesce(p.WorkOffline, false) OR coalesce(p.PrinterStatus = 7, false) OR coalesce(p.ExtendedPrinterStatus = 7, false) AS offline, coalesce(list_contains([lower(trim(c)) for c in p.CapabilityDescriptions], 'duplex'), false) AS duplex,
  coalesce(regexp_full_match(upper(trim(p.PortName)), '(PORTPROMPT|FILE):?'), false) AS to_file, coalesce(p.Default, false) AS usual FROM j WHERE trim(p.Name) <> ''""")
def printer_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the system says of printers."""
    raw = _STATES.column(F.col("s_suppkey"), a=F.col("s_suppkey"), b=F.col("s_suppkey") % 9)
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.inline(desk.printer_states(raw)))


_OPENED = Patterns("/a{a}|C:\\b", "", "rel/{a}", "\\\\host\\{a}|/y", "/x||/y{a}", "d:/{a}|e:{a}")


@query(rf"""WITH r AS (SELECT p_partkey, list_filter(string_split({_OPENED.sql('p_partkey', a='p_size')}, '|'), lambda x: x <> '') AS paths FROM part)
SELECT p_partkey, CASE WHEN len(paths) = 0 THEN 'bad_list' WHEN len(list_filter(paths, lambda x: NOT regexp_matches(x, '^(/|[A-Za-z]:[\\/]|\\\\)'))) > 0 THEN 'bad_path' END AS error FROM r""")
def paths_to_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of paths that may not be opened."""
    paths = F.filter(F.split(_OPENED.column(F.col("p_partkey"), a=F.col("p_size")), r"\|"), lambda p: p != "")
    return table(spark, sf_dir, "part").select("p_partkey", desk.paths_error(paths).alias("error"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, ['do', 'undo', 'redo', 'save', 'do'][CAST(event_id % 5 AS INTEGER) + 1] AS op, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
h AS (SELECT user_id, 0::BIGINT AS i, 0::BIGINT AS event_id, 0 AS place, 0 AS depth, 0 AS saved FROM e GROUP BY user_id
  UNION ALL SELECT e.user_id, e.i, e.event_id, CASE e.op WHEN 'do' THEN place + 1 WHEN 'undo' THEN greatest(place - 1, 0) WHEN 'redo' THEN least(place + 1, depth) ELSE place END, CASE e.op WHEN 'do' THEN place + 1 ELSE depth END,
    CASE WHEN e.op = 'save' THEN place WHEN e.op = 'do' AND saved > place THEN -1 ELSE saved END FROM h JOIN e ON e.user_id = h.user_id AND e.i = h.i + 1)
SELECT user_id AS doc_id, event_id AS pos, place AS "at", depth, saved, place <> saved AS dirty FROM h WHERE i > 0""")
def undo_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of an undo history after each event."""
    op = Patterns("do", "undo", "redo", "save", "do").column(F.col("event_id"))
    return desk.history(table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("pos"), op.alias("op")))


#: Line items as lines of text of pages: a supplier is a document, a line number a page, twenty lines of one pitch after each other.
_PLACED = f"""l AS (SELECT l_suppkey AS doc_id, row_number() OVER w AS line_no, CAST(l_linenumber AS INTEGER) AS page_no, CASE WHEN l_partkey % 6 = 0 THEN 70.0 WHEN l_partkey % 17 = 0 THEN 52.0 WHEN l_partkey % 23 = 0 THEN 210.0 ELSE 50.0 END::DOUBLE AS x0,
  CASE WHEN l_orderkey % 7 = 0 THEN 365.0 WHEN l_orderkey % 3 = 0 THEN 524.0 ELSE 525.0 END::DOUBLE AS x1, row_number() OVER w * 16.0::DOUBLE + (l_orderkey % 13 // 12) * 9 AS y, CAST(CASE WHEN l_suppkey % 5 = 0 AND l_orderkey % 10 = 0 THEN 16 ELSE 12 END AS INTEGER) AS size, 14.0::DOUBLE AS box, 50.0::DOUBLE AS "left", 525.0::DOUBLE AS "right"
  FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_linenumber, {_ORDER}))"""


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_linenumber", *ITEM_ORDER)).cast("long")
    part, order = F.col("l_partkey"), F.col("l_orderkey")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("doc_id"), number.alias("line_no"), F.col("l_linenumber").cast("int").alias("page_no"),
        F.when(part % 6 == 0, 70.0).when(part % 17 == 0, 52.0).when(part % 23 == 0, 210.0).otherwise(50.0).alias("x0"), F.when(order % 7 == 0, 365.0).when(order % 3 == 0, 524.0).otherwise(525.0).alias("x1"),
        (number * 16.0 + F.floor(order % 13 / 12) * 9).alias("y"), F.when((F.col("l_suppkey") % 5 == 0) & (order % 10 == 0), 16).otherwise(12).cast("int").alias("size"), F.lit(14.0).alias("box"), F.lit(50.0).alias("left"), F.lit(525.0).alias("right"),
    )


@query(f"""WITH RECURSIVE {_PLACED}, b AS (SELECT *, coalesce(NOT (lag(x1) OVER w >= "right" - greatest(2.5 * size, 0.1 * greatest("right" - "left", 50.0))), false) OR coalesce(abs(lag(size) OVER w - size) > 1, false) OR coalesce(lag(page_no) OVER w = page_no AND (y - lag(y) OVER w > 1.6 * greatest(box, lag(box) OVER w) OR y - lag(y) OVER w < 0.5 * greatest(box, lag(box) OVER w)), false) AS always,
  coalesce(CASE WHEN lag(page_no) OVER w = page_no THEN x0 - "left" > 3 AND x0 - lag(x0) OVER w > 3 ELSE abs(x0 - "left") > 3 END, false) AS second,
  coalesce(lag(page_no) OVER w = page_no AND lag(page_no, 2) OVER w = page_no AND abs((y - lag(y) OVER w) - (lag(y) OVER w - lag(y, 2) OVER w)) > 0.3 * greatest(box, lag(box) OVER w), false) AS later FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
p AS (SELECT doc_id, line_no, 0 AS para_no, 1 AS n, 0.0::DOUBLE AS edge FROM b WHERE line_no = 1
  UNION ALL SELECT b.doc_id, b.line_no, CASE WHEN joins THEN p.para_no ELSE p.para_no + 1 END, CASE WHEN joins THEN p.n + 1 ELSE 1 END, CASE WHEN joins AND p.n = 1 THEN b.x0 ELSE p.edge END
  FROM p JOIN b ON b.doc_id = p.doc_id AND b.line_no = p.line_no + 1, LATERAL (SELECT NOT b.always AND NOT CASE WHEN p.n = 1 THEN b.second ELSE b.later OR abs(b.x0 - p.edge) > 3 END AS joins) j)
SELECT doc_id, line_no, CAST(para_no AS INTEGER) AS para_no FROM p""")
def paragraph_building(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in paragraphs, over the end of a page too."""
    return paragraphs.built(_placed(spark, sf_dir)).select("doc_id", "line_no", "para_no")


@query(f"""WITH {_PLACED}, q AS (SELECT *, line_no // 4 AS para_no FROM l), r AS (SELECT *, lag(line_no) OVER w IS NULL AS first, lead(line_no) OVER w IS NULL AS last, CASE WHEN lead(page_no) OVER w = page_no THEN lead(y) OVER w - y END AS step, abs(x1 - "right") < 3 AS flush, abs((x0 - "left") - ("right" - x1)) < 6 AS level FROM q WINDOW w AS (PARTITION BY doc_id, para_no ORDER BY line_no)),
f AS (SELECT doc_id, para_no, count(*) AS n, bool_and(last OR flush) AS whole, bool_and(level) AS level, bool_and(flush) AS flush, min(x0) AS least, max(x0) FILTER (first) AS a, min(x0) FILTER (NOT first) AS b, median(step) AS step FROM r GROUP BY ALL),
g AS (SELECT *, CASE WHEN n > 1 AND whole THEN 3 WHEN n <= 3 AND level AND a - 50 > 12 THEN 1 WHEN flush AND least - 50 > 0.25 * 475 THEN 2 ELSE 0 END AS align, CASE WHEN abs(coalesce(b, a) - 50) > 0.4 THEN round(coalesce(b, a) - 50 + 0.5, 2) ELSE 0 END AS rest, CASE WHEN abs(a - 50) > 0.4 THEN round(a - 50 + 0.5, 2) ELSE 0 END AS start FROM f)
SELECT doc_id, para_no, CAST(align AS INTEGER) AS align, CASE WHEN align IN (0, 3) THEN rest ELSE 0 END::DOUBLE AS left_indent, CASE WHEN align IN (0, 3) AND abs(round(start - rest, 2)) >= 1 THEN round(start - rest, 2) ELSE 0 END::DOUBLE AS first_indent, step FROM g""")
def paragraph_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment, indents and pitch of paragraphs."""
    return paragraphs.attributes(_placed(spark, sf_dir).withColumn("para_no", F.floor(F.col("line_no") / 4)))


_WRAPPED = r"""t AS (SELECT item_id AS doc_id, generate_subscripts(string_split(text, ''), 1) AS pos, unnest(string_split(text, '')) AS ch FROM (SELECT item_id, replace(text, 'the ', 'The' || chr(10)) || ' ' || repeat('Wide', CAST(item_id % 20 AS INTEGER)) AS text FROM benchmark)),
c AS (SELECT *, sum(CASE WHEN ch = chr(10) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS para, CASE WHEN regexp_matches(ch, '[A-Z]') THEN 0.75 ELSE 0.5 END::DOUBLE AS adv, regexp_matches(ch, '\s') AS sp FROM t),
u AS (SELECT *, CASE WHEN NOT sp AND coalesce(lag(sp) OVER w, true) THEN 1 ELSE 0 END AS b FROM c WHERE ch <> chr(10) WINDOW w AS (PARTITION BY doc_id, para ORDER BY pos)), v AS (SELECT *, sum(b) OVER (PARTITION BY doc_id, para ORDER BY pos) AS unit FROM u),
x AS (SELECT *, sum(adv) FILTER (NOT sp) OVER n > 20 AS wide, min(pos) OVER n AS f, max(pos) FILTER (NOT sp) OVER n AS l FROM v WHERE unit > 0 WINDOW n AS (PARTITION BY doc_id, para, unit)), y AS (SELECT *, CASE WHEN NOT wide THEN f WHEN sp THEN l ELSE pos END AS piece FROM x),
p AS (SELECT doc_id, para, piece, sum(adv) FILTER (NOT sp) AS h, coalesce(sum(adv) FILTER (sp), 0) AS s, bool_or(wide AND pos = f) AS forced FROM y GROUP BY ALL), q AS (SELECT *, sum(h + g) OVER (PARTITION BY doc_id, para ORDER BY piece) AS r FROM (SELECT *, coalesce(lag(s) OVER (PARTITION BY doc_id, para ORDER BY piece), 0) AS g FROM p)),
n AS (SELECT a.doc_id, a.para, a.piece, min(z.piece) AS nxt FROM q a LEFT JOIN q z ON z.doc_id = a.doc_id AND z.para = a.para AND z.piece > a.piece AND (z.forced OR z.r - a.r + a.h > 20) GROUP BY ALL),
k AS (SELECT doc_id, para, min(piece) AS piece FROM n GROUP BY ALL UNION ALL SELECT n.doc_id, n.para, n.nxt FROM k JOIN n USING (doc_id, para, piece) WHERE n.nxt IS NOT NULL),
m AS (SELECT n.doc_id, n.para, n.piece, count(k.piece) OVER (PARTITION BY n.doc_id, n.para ORDER BY n.piece) AS line FROM n LEFT JOIN k USING (doc_id, para, piece)),
o AS (SELECT doc_id, para, m.line, string_agg(ch, '' ORDER BY pos) AS text FROM y JOIN m USING (doc_id, para, piece) GROUP BY ALL), e AS (SELECT DISTINCT doc_id, para FROM c)"""


@query(f"WITH RECURSIVE {_WRAPPED} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY para, o.line) - 1 AS INTEGER) AS line_no, coalesce(text, '') AS line FROM e LEFT JOIN o USING (doc_id, para)")
def line_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of two styles wrapped to twenty ems; capitals are wider."""
    text = F.concat(F.replace("text", F.lit("the "), F.lit("The\n")), F.lit(" "), F.repeat(F.lit("Wide"), (F.col("item_id") % 20).cast("int")))
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.posexplode(F.filter(F.split(text, ""), lambda c: c != "")).alias("pos", "char"))
    return paragraphs.wrapped(rows.withColumn("advance", F.when(F.col("char").rlike("[A-Z]"), 0.75).otherwise(0.5)), 20.0)
