"""Tables of pages over strokes and lines that follow from line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.operators import layout, sections, tables
from docloom.operators.spatial import PAGE
from docloom.plans.registry import query
from docloom.session import table


def strokes_of(items: DataFrame) -> DataFrame:
    """Line items as strokes along the lines of a grid, a supplier being a document and a line number a page; not all borders are drawn, and none quite straight."""
    flat = F.col("l_partkey") % 2 == 0
    place = (F.floor(F.col("l_partkey") / 2) % 7) * 20.0 + (F.col("l_orderkey") % 3) * 0.25
    low = (F.col("l_orderkey") % 6) * 20.0
    high = low + (F.floor(F.col("l_orderkey") / 6) % 4 + 1) * 20.0
    number = F.row_number().over(Window.partitionBy(*PAGE).orderBy("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")) - 1
    # Named before they are numbered, else Spark shuffles numbered strokes by their page again.
    return items.withColumnsRenamed({"l_suppkey": "doc_id", "l_linenumber": "page_no"}).select(
        *PAGE, number.alias("stroke"),
        F.when(flat, low).otherwise(place - 0.25).alias("x0"), F.when(flat, place - 0.25).otherwise(low).alias("y0"),
        F.when(flat, high).otherwise(place + 0.25).alias("x1"), F.when(flat, place + 0.25).otherwise(high).alias("y1"),
    )


def lines_of(items: DataFrame) -> DataFrame:
    """Line items as lines of text, an order being a page: some stand beside each other in columns, some reach across them."""
    number = F.row_number().over(Window.partitionBy(*PAGE).orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")) - 1
    row, column = F.floor(number / 4), number % 4
    left = column * 120.0 + F.col("l_partkey") % 30
    wide = F.when(F.col("l_orderkey") % 11 == 0, 200.0).otherwise(40.0 + F.col("l_quantity"))
    top = row * 14.0 + F.floor(row / 9) * 60 + F.col("l_linenumber") % 3
    # Named before they are numbered, else Spark shuffles numbered lines by their page again.
    lines = items.withColumnsRenamed({"l_suppkey": "doc_id", "l_returnflag": "page_no"}).select(*PAGE, number.alias("line_no"), left.alias("x0"), top.alias("y0"), (left + wide).alias("x1"), (top + 9.0).alias("y1"), F.concat_ws(" ", "l_linestatus", "l_orderkey").alias("text"), (F.col("l_orderkey") % 5).alias("kind"))
    return lines.where("kind <> 0 OR line_no % 4 = 0").drop("kind")


@query()
def ruled_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of the tables that strokes rule."""
    return tables.ruled_tables(strokes_of(table(spark, sf_dir, "lineitem")))


@query()
def ruled_table_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of text that stand in each cell of ruled tables, in their order."""
    items = table(spark, sf_dir, "lineitem")
    cells = tables.ruled_tables(strokes_of(items)).withColumnRenamed("col_no", "col_start")
    x, y = (F.col("l_quantity") * 3 + F.col("l_partkey") % 7).cast("double"), (F.col("l_orderkey") % 130).cast("double")
    parts = items.select(F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").alias("page_no"), F.struct("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice").alias("part_no"), x.alias("x0"), y.alias("y0"), (x + 4).alias("x1"), (y + 6).alias("y1"))
    held = layout.in_cells(parts, cells)
    text = F.array_join(F.transform(F.array_sort(F.collect_list("part_no")), lambda p: p.l_orderkey.cast("string")), " ")
    return held.groupBy(*PAGE, "table_no", "row_no", F.col("col_start").alias("col_no")).agg(text.alias("text"))


@query()
def aligned_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cell of each line that stands in columns."""
    return tables.aligned_tables(lines_of(table(spark, sf_dir, "lineitem")))


def columned_lines_of(items: DataFrame) -> DataFrame:
    """Line items as lines of pages that change between one and two columns."""
    number = F.row_number().over(Window.partitionBy(*PAGE).orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")) - 1
    row, right, part = F.floor(F.col("number") / 2), F.col("number") % 2 == 1, F.col("l_partkey")
    whole = F.floor(F.col("number") / 24) % 3 == 0
    left = F.when(right, 310.0 - part % 41 * F.when(part % 23 == 0, 3).otherwise(0)).otherwise(50.0 + part % 3)
    end = F.when(whole & (part % 5 > 0), 540.0).when(right, 540.0 - part % 90).otherwise(290.0 - part % 80)
    # Named before they are numbered, else Spark shuffles numbered lines by their page again.
    rows = items.withColumnsRenamed({"l_suppkey": "doc_id", "l_returnflag": "page_no"}).withColumn("number", number).select(
        *PAGE, F.col("number").alias("line_no"), left.alias("x0"), (row * 14.0 + F.when(whole & right, 7.0).otherwise(0.0)).alias("y0"),
        end.alias("x1"), (row * 14.0 + F.when(whole & right, 7.0).otherwise(0.0) + 6).alias("y1"), F.lit(50.0).alias("page_left"), F.lit(545.0).alias("page_right"), (F.col("l_orderkey") % 9).alias("kind"),
    )
    return rows.where("kind > 0").drop("kind")


@query()
def column_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The section and column of each line."""
    return sections.sections(columned_lines_of(table(spark, sf_dir, "lineitem")))
