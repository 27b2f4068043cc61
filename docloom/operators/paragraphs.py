"""Paragraphs from placed lines: building, attributes, and lines wrapped to a width."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators import flow
from docloom.session import written

# Points by which left edges may differ, sizes of type, and shares of the height of a line.
EDGE, SIZE, FAR, CLOSE, DRIFT = 3, 1, 1.6, 0.5, 0.3


def _breaks(lines: DataFrame) -> DataFrame:
    """``lines`` with what speaks against going on with the line before: ``always``, ``second`` (if that line began its paragraph), ``later`` (if it didn't)."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    before = lambda c, n=1: F.lag(c, n).over(w)
    width = F.greatest(F.col("right") - F.col("left"), F.lit(50.0))
    full = before("x1") >= F.col("right") - F.greatest(2.5 * F.col("size"), 0.1 * width)
    other_type = F.abs(before("size") - F.col("size")) > SIZE
    same_page, step, tall = before("page_no") == F.col("page_no"), F.col("y") - before("y"), F.greatest("box", before("box"))
    apart = same_page & ((step > FAR * tall) | (step < CLOSE * tall))
    deeper = (F.col("x0") - F.col("left") > EDGE) & (F.col("x0") - before("x0") > EDGE)
    off_edge = F.abs(F.col("x0") - F.col("left")) > EDGE
    uneven = same_page & (before("page_no", 2) == F.col("page_no")) & (F.abs(step - (before("y") - before("y", 2))) > DRIFT * tall)
    no = lambda c: F.coalesce(c, F.lit(False))
    return lines.withColumns({"_always": no(~full | other_type | apart), "_second": no(F.when(same_page, deeper).otherwise(off_edge)), "_later": no(uneven)})


def built(lines: DataFrame) -> DataFrame:
    """``lines`` with ``para_no``: consecutive lines of one paragraph, which may go on over the end of a page.

    ``lines``: doc_id, line_no, page_no, x0, x1, y, size, box (the line's height), left, right (the text area).
    What a line and the ones before it say is a window; the left edge that a paragraph has from its second line
    on depends on where it began, so that part is a fold over the lines of one document.
    """
    columns = lines.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lines.schema.fields) + ", para_no int"

    def numbered(document: pd.DataFrame) -> pd.DataFrame:
        rows = document.sort_values("line_no").reset_index(drop=True)
        number, length, edge, numbers = -1, 0, 0.0, []
        for x, always, second, later in rows[["x0", "_always", "_second", "_later"]].itertuples(index=False):
            on = length > 0 and not always and not (second if length == 1 else later or abs(x - edge) > EDGE)
            number, length = (number, length + 1) if on else (number + 1, 1)
            edge = x if length == 2 else edge
            numbers.append(number)
        return rows[columns].assign(para_no=pd.Series(numbers, dtype="int32"))

    return _breaks(lines).groupBy("doc_id").applyInPandas(numbered, schema)


def attributes(lines: DataFrame) -> DataFrame:
    """(doc_id, para_no, align, left_indent, first_indent, step): of paragraphs (lines as above, with para_no).

    Alignment: 3 both sides, 1 centred, 2 right, 0 left. Indents are from the text area's left edge, half a point
    on; ``step`` is the median distance of lines on one page.
    """
    w = Window.partitionBy("doc_id", "para_no").orderBy("line_no")
    last = F.lead("line_no").over(w).isNull()
    step = F.when(F.lead("page_no").over(w) == F.col("page_no"), F.lead("y").over(w) - F.col("y"))
    first = F.lag("line_no").over(w).isNull()
    rows = lines.withColumn("last", last).withColumn("step", step).withColumn("first", first)
    to_right = F.abs(F.col("x1") - F.col("right")) < 3
    level = F.abs((F.col("x0") - F.col("left")) - (F.col("right") - F.col("x1"))) < 6
    facts = rows.groupBy("doc_id", "para_no").agg(
        F.count("*").alias("n"),
        F.bool_and(F.col("last") | to_right).alias("full"),
        F.bool_and(level).alias("level"),
        F.bool_and(to_right).alias("flush"),
        F.min("x0").alias("least"),
        F.max(F.when(F.col("first"), F.col("x0"))).alias("x_first"),
        F.min(F.when(~F.col("first"), F.col("x0"))).alias("x_rest"),
        F.first("left").alias("left"),
        F.first("right").alias("right"),
        F.median("step").alias("step"),
    )
    width = F.col("right") - F.col("left")
    align = F.when((F.col("n") > 1) & F.col("full"), 3).when((F.col("n") <= 3) & F.col("level") & (F.col("x_first") - F.col("left") > 12), 1).when(F.col("flush") & (F.col("least") - F.col("left") > 0.25 * width), 2).otherwise(0)
    indent = lambda x: F.when(F.abs(x - F.col("left")) > 0.4, F.round(x - F.col("left") + 0.5, 2)).otherwise(0.0)
    facts = facts.withColumn("align", align).withColumn("rest", indent(F.coalesce("x_rest", "x_first"))).withColumn("start", indent(F.col("x_first")))
    placed = F.col("align").isin(0, 3)
    more = F.round(F.col("start") - F.col("rest"), 2)
    return facts.select("doc_id", "para_no", "align", F.when(placed, F.col("rest")).otherwise(0.0).alias("left_indent"), F.when(placed & (F.abs(more) >= 1), more).otherwise(0.0).alias("first_indent"), "step")


def _written_units(characters: DataFrame, width: float) -> DataFrame:
    """``characters`` with ``para``, ``blank`` and ``piece``: the place where what can't be parted begins, a word with the blanks behind it.

    A word that is wider than a line is cut in its characters, and ``forced`` marks the first of them. Blanks before the first word
    of a paragraph belong to nothing.
    """
    text = Window.partitionBy("doc_id").orderBy("pos")
    rows = characters.withColumn("para", F.sum(F.when(F.col("char") == "\n", 1).otherwise(0)).over(text)).where(F.col("char") != "\n").withColumn("blank", F.col("char").rlike(r"(?U)\s"))
    para = Window.partitionBy("doc_id", "para").orderBy("pos")
    begins = ~F.col("blank") & F.coalesce(F.lag("blank").over(para), F.lit(True))
    rows = rows.withColumn("unit", F.sum(F.when(begins, 1).otherwise(0)).over(para.rowsBetween(Window.unboundedPreceding, 0))).where("unit > 0")
    unit = Window.partitionBy("doc_id", "para", "unit")
    wide = F.sum(F.when(~F.col("blank"), F.col("advance"))).over(unit) > width
    first, last = F.min("pos").over(unit), F.max(F.when(~F.col("blank"), F.col("pos"))).over(unit)
    piece = F.when(~F.col("wide"), F.col("first")).when(F.col("blank"), F.col("last")).otherwise(F.col("pos"))
    rows = rows.withColumns({"wide": wide, "first": first, "last": last})
    return rows.withColumns({"piece": piece, "forced": F.col("wide") & (F.col("pos") == F.col("first"))})


def wrapped(characters: DataFrame, width: float) -> DataFrame:
    """(doc_id, line_no, line): texts in lines of a width, from 0.

    ``characters``: doc_id, pos, char, advance (its own width in its own style). Words go to the next line where they would reach
    beyond the width; the blanks behind a word stay on its line and take no room at its end; line ends are kept. Words are blocks of a
    flow whose pages are the lines, so a line begins where jumps from the first word lead, and no text is gone through in order.
    """
    rows = written(_written_units(characters, width), "wrapped")
    pieces = rows.groupBy("doc_id", "para", "piece").agg(F.sum(F.when(~F.col("blank"), F.col("advance"))).alias("height"), F.coalesce(F.sum(F.when(F.col("blank"), F.col("advance"))), F.lit(0.0)).alias("behind"), F.bool_or("forced").alias("new_page"))
    gap = F.coalesce(F.lag("behind").over(Window.partitionBy("doc_id", "para").orderBy("piece")), F.lit(0.0))
    blocks = pieces.select(F.struct("doc_id", "para").alias("doc_id"), F.col("piece").alias("pos"), "height", gap.alias("gap"), "new_page", F.lit(float(width)).alias("page_height"))
    pages = flow.paginated(blocks).select("doc_id.doc_id", "doc_id.para", F.col("pos").alias("piece"), "page_no")
    lines = rows.join(pages, ["doc_id", "para", "piece"]).groupBy("doc_id", "para", "page_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "char"))), lambda c: c.char), "").alias("line"))
    # Paragraphs without a word are an empty line.
    ends = characters.groupBy("doc_id").agg(F.sum(F.when(F.col("char") == "\n", 1).otherwise(0)).alias("ends"))
    paras = ends.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), "ends")).alias("para"))
    every = paras.join(lines, ["doc_id", "para"], "left").select("doc_id", "para", F.coalesce("page_no", F.lit(1)).alias("page_no"), F.coalesce("line", F.lit("")).alias("line"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("para", "page_no")) - 1
    return every.select("doc_id", number.alias("line_no"), "line")
