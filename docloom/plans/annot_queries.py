"""Annotations, fields and links over conversations as threads and other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import annots
from docloom.plans.derived import TREE, Patterns, tree
from docloom.plans.registry import query
from docloom.session import table

#: A conversation is a document, a turn a note that replies to the turn before.
_NOTES = "a AS (SELECT conv_id AS doc_id, turn AS id, CASE WHEN turn > 1 THEN turn - 1 END AS reply_to, text AS payload FROM conversations)"


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("id"), F.when(F.col("turn") > 1, F.col("turn") - 1).alias("reply_to"), F.col("text").alias("payload"))


@query(f"""WITH {_NOTES}, c AS (SELECT doc_id, id, CASE WHEN id > 2 THEN reply_to END AS parent_id, (doc_id + id) % 5 = 0 AS deleted, doc_id % 11 = 0 AS page_gone, id % 4 <> 0 AS addable,
    CASE WHEN id % 3 = 0 THEN payload || '!' ELSE payload END AS payload, NOT (id % 4 IN (0, 1) AND doc_id % 2 = 0) AS kept, payload AS old FROM a),
g AS (SELECT doc_id, id AS parent_id, true AS pd FROM c WHERE deleted AND kept),
o AS (SELECT c.*, CASE WHEN NOT kept AND NOT deleted AND NOT page_gone AND addable THEN 'add' WHEN kept AND deleted AND pd IS NULL THEN 'delete' WHEN kept AND NOT deleted AND NOT page_gone AND payload IS DISTINCT FROM old THEN 'update' END AS op FROM c LEFT JOIN g USING (doc_id, parent_id))
SELECT doc_id, id, op, parent_id IS NOT NULL AS late FROM o WHERE op IS NOT NULL""")
def annot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What saving must add, update and delete."""
    notes = _notes(spark, sf_dir)
    new = (F.col("id") % 4).isin(0, 1) & (F.col("doc_id") % 2 == 0)
    current = notes.select(
        "doc_id",
        "id",
        F.when(F.col("id") > 2, F.col("reply_to")).alias("parent_id"),
        ((F.col("doc_id") + F.col("id")) % 5 == 0).alias("deleted"),
        (F.col("doc_id") % 11 == 0).alias("page_gone"),
        (F.col("id") % 4 != 0).alias("addable"),
        F.when(F.col("id") % 3 == 0, F.concat("payload", F.lit("!"))).otherwise(F.col("payload")).alias("payload"),
    )
    return annots.changes(current, notes.where(~new))


@query(f"""WITH RECURSIVE {_NOTES}, g AS (SELECT doc_id, id FROM a WHERE id = 1 + doc_id % 3 UNION SELECT a.doc_id, a.id FROM g JOIN a ON a.doc_id = g.doc_id AND a.reply_to = g.id) SELECT * FROM g""")
def annot_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes that go with a deleted one: all that reply to it, through other replies too."""
    notes = _notes(spark, sf_dir)
    return annots.with_replies(notes, notes.where(F.col("id") == 1 + F.col("doc_id") % 3))


@query(f"""WITH RECURSIVE {_NOTES}, g AS (SELECT doc_id, id FROM a WHERE id = 3 AND doc_id % 4 = 0 UNION SELECT a.doc_id, a.id FROM g JOIN a ON a.doc_id = g.doc_id AND a.reply_to = g.id)
SELECT doc_id, id, reply_to, md5(CASE WHEN id = 1 THEN 'new' ELSE payload END) AS digest FROM a WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = a.doc_id AND g.id = a.id)
UNION ALL SELECT DISTINCT doc_id, 99, 1, md5('added') FROM a""")
def annot_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes after a change-set."""
    notes = _notes(spark, sf_dir)
    op = lambda rows, kind, payload: rows.select(F.lit(kind).alias("op"), "doc_id", "id", "reply_to", F.lit(payload).alias("payload"))
    added = notes.select("doc_id", F.lit(99).cast("long").alias("id"), F.lit(1).cast("long").alias("reply_to")).distinct()
    ops = op(notes.where("id = 3 AND doc_id % 4 = 0"), "delete", None).unionByName(op(notes.where("id = 1"), "update", "new")).unionByName(op(added, "add", "added"))
    return annots.applied(notes, ops).select("doc_id", "id", "reply_to", F.md5("payload").alias("digest"))


@query("""WITH s AS (SELECT conv_id AS doc_id, role AS page_no, turn AS xref, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id, role) AS n FROM conversations WHERE turn % 6 <> 5 WINDOW w AS (PARTITION BY conv_id, role ORDER BY turn)),
c AS (SELECT conv_id AS doc_id, role AS page_no, 1000 + turn AS new_xref, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id, role) AS n FROM conversations WHERE conv_id % 3 <> 0 OR turn > 1 WINDOW w AS (PARTITION BY conv_id, role ORDER BY turn))
SELECT s.doc_id, s.page_no, xref, new_xref FROM s JOIN c USING (doc_id, page_no, place) WHERE s.n = c.n""")
def xref_zip_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of copied pages by position, where their numbers agree."""
    turns = table(spark, sf_dir, "conversations")
    source = turns.select(F.col("conv_id").alias("doc_id"), F.col("role").alias("page_no"), F.col("turn").alias("xref"), F.col("turn").alias("pos"), F.when(F.col("turn") % 6 == 5, 1).alias("reply_to"))
    copies = turns.where("conv_id % 3 <> 0 OR turn > 1").select(F.col("conv_id").alias("doc_id"), F.col("role").alias("page_no"), (1000 + F.col("turn")).alias("new_xref"), F.col("turn").alias("pos"))
    return annots.xref_map(source, copies)


@query(f"""WITH RECURSIVE {TREE}, f AS (SELECT doc_id, node_id AS id, parent_id, CASE WHEN p % 6 = 0 THEN 'v' || o % 90 END AS value FROM t),
u AS (SELECT doc_id, id, parent_id, value, 0 AS hop FROM f UNION ALL SELECT u.doc_id, u.id, f.parent_id, f.value, hop + 1 FROM u JOIN f ON f.doc_id = u.doc_id AND f.id = u.parent_id WHERE u.value IS NULL AND hop < {annots.MOST_HOPS})
SELECT doc_id, id, max(value) AS value FROM u GROUP BY ALL""")
def field_inherit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field's attribute from the nearest ancestor that has it."""
    value = F.when(F.col("p") % 6 == 0, F.concat(F.lit("v"), (F.col("o") % 90).cast("string")))
    return annots.inherited(tree(spark, sf_dir).select("doc_id", F.col("node_id").alias("id"), "parent_id", value.alias("value")), "value")


@query("""WITH f AS (SELECT l_suppkey AS doc_id, l_linenumber AS page_no, CASE l_suppkey % 3 WHEN 0 THEN 'R' WHEN 1 THEN 'C' ELSE 'S' END AS tabs, l_orderkey AS pos, l_quantity AS x0, l_discount * 100 AS y0 FROM lineitem)
SELECT doc_id, page_no, pos, CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY CASE tabs WHEN 'R' THEN round_even(y0, 1) WHEN 'C' THEN round_even(x0, 1) END, CASE tabs WHEN 'R' THEN x0 WHEN 'C' THEN y0 END, pos) AS INTEGER) AS tab FROM f""")
def tab_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields in the order in which tab goes through them."""
    tabs = F.when(F.col("l_suppkey") % 3 == 0, "R").when(F.col("l_suppkey") % 3 == 1, "C").otherwise("S")
    fields = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").alias("page_no"), tabs.alias("tabs"), F.col("l_orderkey").alias("pos"), F.col("l_quantity").alias("x0"), (F.col("l_discount") * 100).alias("y0"))
    return annots.tab_order(fields).select("doc_id", "page_no", "pos", "tab")


@query("""SELECT c_custkey AS xref, c_nationkey AS field_xref, CASE WHEN n_nationkey IS NOT NULL AND n_regionkey = 1 THEN n_name ELSE c_mktsegment END AS value FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey = 1""")
def form_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New values set on all widgets of their fields."""
    fields = table(spark, sf_dir, "customer").select(F.lit("d").alias("doc_id"), F.col("c_custkey").alias("xref"), F.col("c_nationkey").alias("field_xref"), F.col("c_mktsegment").alias("value"))
    values = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.lit("d").alias("doc_id"), F.col("n_nationkey").alias("field_xref"), F.col("n_name").alias("value"))
    return annots.filled(fields, values).select("xref", "field_xref", "value")


_ACTIONS = Patterns("NextPage", "PrevPage", "FirstPage", "LastPage", "GoBack")


@query(f"""WITH l AS (SELECT l_suppkey AS doc_id, l_orderkey AS link_no, CAST(l_linenumber AS INTEGER) AS page_no, CASE WHEN l_partkey % 5 = 0 THEN 'name' || l_partkey % 30 END AS name, CASE WHEN l_partkey % 5 > 1 THEN {_ACTIONS.sql('l_partkey')} END AS action, CAST(CASE WHEN l_partkey % 5 = 1 THEN l_partkey % 7 + 1 END AS INTEGER) AS target FROM lineitem),
n AS (SELECT DISTINCT l_suppkey AS doc_id, 'name' || l_partkey % 30 AS name, CAST(l_partkey % 30 + 1 AS INTEGER) AS at FROM lineitem WHERE l_orderkey % 4 = 0),
a AS (SELECT *, CASE action WHEN 'NextPage' THEN page_no + 1 WHEN 'PrevPage' THEN page_no - 1 WHEN 'FirstPage' THEN 1 WHEN 'LastPage' THEN 7 END AS moved FROM l)
SELECT a.doc_id, page_no, link_no, coalesce(target, n.at, CASE WHEN moved BETWEEN 1 AND 7 THEN moved END) AS page FROM a LEFT JOIN n ON n.doc_id = a.doc_id AND n.name = a.name""")
def link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page that each link leads to."""
    items, part = table(spark, sf_dir, "lineitem"), F.col("l_partkey")
    name = F.concat(F.lit("name"), (part % 30).cast("string"))
    links = items.select(
        F.col("l_suppkey").alias("doc_id"), F.col("l_orderkey").alias("link_no"), F.col("l_linenumber").cast("int").alias("page_no"), F.lit(7).alias("n_pages"), F.when(part % 5 == 0, name).alias("name"),
        F.when(part % 5 > 1, _ACTIONS.column(part)).alias("action"), F.when(part % 5 == 1, part % 7 + 1).cast("int").alias("target_page"),
    )
    names = items.where("l_orderkey % 4 = 0").select(F.col("l_suppkey").alias("doc_id"), name.alias("name"), (part % 30 + 1).cast("int").alias("page_no")).distinct()
    return annots.resolved_links(links, names).select("doc_id", "page_no", "link_no", "page")


_FITS, _PARAMS = Patterns("XYZ", "FitH", "FitV", "FitR", "Fit", "FitBH"), Patterns("{a},{b},0", "null,{b},0", "null,null,0", "{b},{a},{a},90", "{a}", "")


@query(f"""WITH r AS (SELECT p_partkey, {_FITS.sql('p_partkey')} AS kind, [TRY_CAST(x AS DOUBLE) for x in string_split({_PARAMS.sql('p_size', a='p_size', b='p_partkey % 900')}, ',')] AS p FROM part),
x AS (SELECT *, CASE kind WHEN 'XYZ' THEN p[1] IS NOT NULL OR p[2] IS NOT NULL WHEN 'FitR' THEN p[1] IS NOT NULL AND p[2] IS NOT NULL AND p[3] IS NOT NULL AND p[4] IS NOT NULL WHEN 'Fit' THEN false ELSE p[1] IS NOT NULL END AS there FROM r)
SELECT p_partkey, CASE WHEN there THEN CASE kind WHEN 'XYZ' THEN coalesce(p[1], 5) WHEN 'FitV' THEN p[1] WHEN 'FitR' THEN least(p[1], p[3]) ELSE 5.0 END END::DOUBLE AS x, CASE WHEN there THEN CASE kind WHEN 'XYZ' THEN coalesce(p[2], 800) WHEN 'FitV' THEN 800.0 WHEN 'FitR' THEN greatest(p[2], p[4]) ELSE p[1] END END::DOUBLE AS y FROM x""")
def target_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corner that a destination asks for."""
    raw = _PARAMS.column(F.col("p_size"), a=F.col("p_size"), b=F.col("p_partkey") % 900)
    box = F.struct(F.lit(5.0).alias("x0"), F.lit(800.0).alias("y1"))
    point = annots.target_point(_FITS.column(F.col("p_partkey")), F.transform(F.split(raw, ","), lambda v: v.try_cast("double")), box)
    return table(spark, sf_dir, "part").select("p_partkey", point.alias("p")).select("p_partkey", "p.x", "p.y")


@query("SELECT conv_id AS doc_id, turn AS id FROM conversations WHERE role <> 'system'")
def annot_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All notes but popups (system turns)."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("id"), F.when(F.col("role") == "system", "Popup").otherwise("Text").alias("type"))
    return annots.without_popups(rows).select("doc_id", "id")


@query("SELECT d.doc_id, CAST(b.item_id AS VARCHAR) AS value FROM documents d JOIN benchmark b ON d.doc_id % 40 = b.item_id WHERE NOT contains(d.text, b.text)")
def missing_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected values that a document doesn't hold."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    expected = docs.select("doc_id", (F.col("doc_id") % 40).alias("item_id")).join(items.withColumnRenamed("text", "value"), "item_id")
    present = docs.select("doc_id", F.col("text").alias("value"))
    return annots.missing_values(expected, present).select("doc_id", F.col("item_id").cast("string").alias("value"))


@query("SELECT conv_id AS doc_id, bool_or(role = 'system' OR (role = 'user' AND turn = 3)) AS signed FROM conversations GROUP BY conv_id")
def signed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a signature of some kind."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("role") == "system").alias("doc_mdp"), (F.col("role") == "user").alias("signature_field"), (F.col("turn") == 3).alias("filled"), F.lit(True).alias("byte_range"), F.lit(True).alias("usage_rights"))
    return annots.signed(rows)
