"""Annotations, form fields and links: differences, change-sets, inheritance, order and targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.chains import nearest
from docloom.session import written

MOST_HOPS = 32


def changes(current: DataFrame, saved: DataFrame) -> DataFrame:
    """(doc_id, id, op): what saving must do, ``add``, ``update`` or ``delete``, with ``late`` for replies, which come last.

    ``current``: doc_id, id, parent_id, deleted, page_gone, addable, payload; ``saved``: doc_id, id, payload.
    Replies whose parent is deleted with them need no deletion of their own.
    """
    before = saved.select("doc_id", "id", F.col("payload").alias("old"), F.lit(True).alias("kept"))
    rows = current.join(before, ["doc_id", "id"], "left")
    gone = rows.where("deleted AND kept").select("doc_id", F.col("id").alias("parent_id"), F.lit(True).alias("parent_deleted"))
    rows = rows.join(gone, ["doc_id", "parent_id"], "left")
    kept, late = F.coalesce("kept", F.lit(False)), F.col("parent_id").isNotNull()
    op = (
        F.when(~kept & ~F.col("deleted") & ~F.col("page_gone") & F.col("addable"), "add")
        .when(kept & F.col("deleted") & F.col("parent_deleted").isNull(), "delete")
        .when(kept & ~F.col("deleted") & ~F.col("page_gone") & ~F.col("payload").eqNullSafe(F.col("old")), "update")
    )
    return rows.select("doc_id", "id", op.alias("op"), late.alias("late")).where("op IS NOT NULL")


def applied(annots: DataFrame, ops: DataFrame) -> DataFrame:
    """``annots`` (doc_id, id, reply_to, payload) after a change-set (op, doc_id, id, reply_to, payload). A deleted note takes its replies along."""
    deleted = ops.where("op = 'delete'").select("doc_id", "id")
    stay = annots.join(with_replies(annots, deleted), ["doc_id", "id"], "left_anti")
    updated = ops.where("op = 'update'").select("doc_id", "id", F.col("payload").alias("new"), F.lit(True).alias("changed"))
    rows = stay.join(updated, ["doc_id", "id"], "left").select("doc_id", "id", "reply_to", F.when(F.col("changed"), F.col("new")).otherwise(F.col("payload")).alias("payload"))
    return rows.unionByName(ops.where("op = 'add'").select("doc_id", "id", "reply_to", "payload"))


def with_replies(annots: DataFrame, deleted: DataFrame) -> DataFrame:
    """(doc_id, id): ``deleted`` and all that reply to them, through other replies too, at any depth.

    Each round takes the replies to what the round before found; ids found already don't count, so
    cycles end. Rounds are written, so lineage stays short.
    """
    replies = annots.select("doc_id", F.col("reply_to").alias("to"), F.col("id").alias("reply"))
    gone = frontier = written(deleted.select("doc_id", "id").distinct(), "gone")
    while frontier.head(1):
        reached = frontier.join(replies.withColumnRenamed("doc_id", "of"), (F.col("of") == F.col("doc_id")) & (F.col("to") == F.col("id")))
        reached = reached.select("doc_id", F.col("reply").alias("id")).distinct()
        frontier = written(reached.join(gone, ["doc_id", "id"], "left_anti"), "replies")
        gone = gone.unionByName(frontier)
    return gone


def xref_map(source: DataFrame, copies: DataFrame) -> DataFrame:
    """(doc_id, page_no, xref, new_xref): the notes of copied pages matched by position; replies don't count, and pages whose numbers differ have no map."""
    page = Window.partitionBy("doc_id", "page_no")

    def placed(rows: DataFrame, name: str) -> DataFrame:
        return rows.select("doc_id", "page_no", F.col(name), F.row_number().over(page.orderBy("pos")).alias("at"), F.count("*").over(page).alias(f"{name}_n"))

    pairs = placed(source.where("reply_to IS NULL"), "xref").join(placed(copies, "new_xref"), ["doc_id", "page_no", "at"])
    return pairs.where("xref_n = new_xref_n").select("doc_id", "page_no", "xref", "new_xref")


def inherited(nodes: DataFrame, attribute: str, hops: int | None = MOST_HOPS) -> DataFrame:
    """(doc_id, id, value): an attribute from the nearest of a field and its ancestors (doc_id, id, parent_id) that has it.

    A value counts up to ``hops`` steps away; with None at any distance. Of rows with the same id the largest value and parent count.
    """
    single = nodes.groupBy("doc_id", "id").agg(F.max("parent_id").alias("parent_id"), F.max(attribute).alias("value"))
    found = nearest(single, ["doc_id"], "id", "parent_id", "value")
    near = F.col("value") if hops is None else F.when(F.col("hop") <= hops, F.col("value"))
    return found.select("doc_id", "id", near.alias("value"))


def tab_order(fields: DataFrame) -> DataFrame:
    """``fields`` (doc_id, page_no, tabs, pos, x0, y0) with ``tab``: by rows (R), by columns (C) or as they are listed."""
    first = F.when(F.col("tabs") == "R", F.bround("y0", 1)).when(F.col("tabs") == "C", F.bround("x0", 1))
    second = F.when(F.col("tabs") == "R", F.col("x0")).when(F.col("tabs") == "C", F.col("y0"))
    return fields.withColumn("tab", F.row_number().over(Window.partitionBy("doc_id", "page_no").orderBy(first, second, "pos")))


def filled(fields: DataFrame, values: DataFrame) -> DataFrame:
    """``fields`` (doc_id, field_xref, value) with the new values of their fields; a field's widgets all change."""
    new = values.select("doc_id", "field_xref", F.col("value").alias("new"), F.lit(True).alias("set"))
    return fields.join(new, ["doc_id", "field_xref"], "left").withColumn("value", F.when(F.col("set"), F.col("new")).otherwise(F.col("value"))).drop("new", "set")


def value_errors(values: DataFrame, most: int = 1000, longest: int = 100_000) -> DataFrame:
    """``values`` (doc_id, field_xref, kind, value, options) with ``error``: too_many, too_long or not_an_option, or null."""
    n = F.count("*").over(Window.partitionBy("doc_id"))
    wrong_choice = (F.col("kind") == "radio") & ~F.forall("value", lambda v: F.array_contains("options", v))
    error = F.when(n > most, "too_many").when(F.exists("value", lambda v: F.length(v) > longest), "too_long").when(wrong_choice, "not_an_option")
    return values.withColumn("error", error)


def resolved_links(links: DataFrame, names: DataFrame) -> DataFrame:
    """``links`` with ``page``: the explicit target, that of the name, or that of a named action on the page; null if none is on a page."""
    named = names.select("doc_id", "name", F.col("page_no").alias("named_page"))
    return links.join(named, ["doc_id", "name"], "left").withColumn("page", F.coalesce("target_page", "named_page", action_page(F.col("action"), F.col("page_no"), F.col("n_pages")))).drop("named_page")


def action_page(action: Column, page: Column, n_pages: Column) -> Column:
    """The page that a named action leads to, or null beyond the document."""
    target = F.when(action == "NextPage", page + 1).when(action == "PrevPage", page - 1).when(action == "FirstPage", 1).when(action == "LastPage", n_pages)
    return F.when(target.between(1, n_pages), target)


def target_point(kind: Column, params: Column, box: Column) -> Column:
    """Struct (x, y) that a destination brings to the corner of the window; null for the top of the page. ``box``: struct x0, y1."""
    p = lambda i: F.get(params, F.lit(i))
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    whole = F.size(F.filter(F.slice(params, 1, 4), lambda v: v.isNotNull())) == 4
    return (
        F.when((kind == "XYZ") & (p(0).isNotNull() | p(1).isNotNull()), point(F.coalesce(p(0), box.x0), F.coalesce(p(1), box.y1)))
        .when(kind.isin("FitH", "FitBH") & p(0).isNotNull(), point(box.x0, p(0)))
        .when(kind.isin("FitV", "FitBV") & p(0).isNotNull(), point(p(0), box.y1))
        .when((kind == "FitR") & whole, point(F.least(p(0), p(2)), F.greatest(p(1), p(3))))
    )


def signed(objects: DataFrame) -> DataFrame:
    """(doc_id, signed): documents with a certification, a filled signature field, or a byte range that isn't for usage rights."""
    marks = F.col("doc_mdp") | (F.col("signature_field") & F.col("filled")) | (F.col("byte_range") & ~F.col("usage_rights"))
    return objects.groupBy("doc_id").agg(F.bool_or(F.coalesce(marks, F.lit(False))).alias("signed"))


def missing_values(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Expected values (doc_id, value) that no value present equals or contains."""
    found = (F.col("e.doc_id") == F.col("p.doc_id")) & F.contains(F.col("p.value"), F.col("e.value"))
    return expected.alias("e").join(present.alias("p"), found, "left_anti")


def moved_vertices(vertices: Column, dx: Column, dy: Column, unit: Column) -> Column:
    """A polyline's vertices (arrays x, y) shifted on the page, whose y runs the other way."""
    return F.transform(vertices, lambda v: F.array(v[0] + dx / unit, v[1] - dy / unit))


def without_popups(annots: DataFrame) -> DataFrame:
    return annots.where(~F.col("type").eqNullSafe(F.lit("Popup")))


def pure_forms(documents: DataFrame) -> DataFrame:
    """``documents`` (needs_rendering, has_template, fields) with ``pure``: forms that live in their template alone, without fields of the document."""
    fields = F.coalesce(F.col("fields").rlike(r"\d+\s+0\s+R"), F.lit(False))
    return documents.withColumn("pure", F.coalesce(F.col("needs_rendering") & F.col("has_template"), F.lit(False)) & ~fields)


def one(annots: DataFrame, wanted: DataFrame) -> DataFrame:
    """The notes ``wanted`` (doc_id, id); one that isn't there is an error."""
    found = wanted.join(annots.withColumn("_there", F.lit(True)), ["doc_id", "id"], "left")
    known = F.when(F.col("_there"), F.col("id")).otherwise(F.raise_error(F.concat(F.lit("no note "), F.col("id").cast("string"))))
    return found.withColumn("id", known).drop("_there")


def numbered_additions(annots: DataFrame, added: DataFrame) -> DataFrame:
    """``added`` (doc_id, local_id, reply_to, reply_local, payload) as notes (doc_id, id, reply_to, payload) with ids after those of their document, in the order of ``local_id``.

    A reply to a note that is added too (``reply_local``) refers to its new id.
    """
    last = annots.groupBy("doc_id").agg(F.max("id").alias("_last"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("local_id"))
    rows = added.join(last, "doc_id", "left").withColumn("id", F.coalesce("_last", F.lit(0)) + place)
    parents = rows.select("doc_id", F.col("local_id").alias("reply_local"), F.col("id").alias("_new"))
    return rows.join(parents, ["doc_id", "reply_local"], "left").select("doc_id", "id", F.coalesce("_new", "reply_to").alias("reply_to"), "payload")
