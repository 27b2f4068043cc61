"""Inputs that follow from the driver's rows: texts from patterns, recipes, pages, outlines and trees, for Spark and as SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.session import table


class Patterns:
    """Texts with places {a}, {b} ... that numbers of a row fill; a row's number picks the text."""

    def __init__(self, *texts: str) -> None:
        self.texts = texts

    def column(self, pick: Column, **places: Column) -> Column:
        text = F.element_at(F.array(*[F.lit(t) for t in self.texts]), (pick % len(self.texts)).cast("int") + 1)
        for name, value in places.items():
            text = F.replace(text, F.lit("{" + name + "}"), value.cast("string"))
        return text

    def sql(self, pick: str, **places: str) -> str:
        text = f"[{', '.join(quoted(t) for t in self.texts)}][CAST(({pick}) % {len(self.texts)} AS INTEGER) + 1]"
        for name, value in places.items():
            text = f"replace({text}, '{{{name}}}', CAST({value} AS VARCHAR))"
        return text


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def typed(sql: str, kind: str) -> str:
    return f"CAST({sql} AS {kind})"


ITEM_ORDER: Sequence[str] = ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
_ORDER = ", ".join(ITEM_ORDER)

#: Line items as pages of recipes, an order being one; some are blank.
RECIPES = f"""z AS (SELECT l_orderkey AS recipe_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) - 1 AS INTEGER) AS pos, CASE WHEN l_partkey % 6 > 0 THEN 'd' || l_suppkey % 2 END AS src_doc,
  CAST(CASE WHEN l_partkey % 6 > 0 THEN 1 + l_linenumber + l_partkey % 2 END AS INTEGER) AS src_page, CAST(90 * (l_partkey % 4) AS INTEGER) AS rotate, CASE WHEN l_partkey % 18 = 0 THEN 300.0::DOUBLE END AS width, NULL::DOUBLE AS height FROM lineitem),
t AS (SELECT recipe_id, pos, src_doc, src_page FROM z)"""


def recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*ITEM_ORDER)) - 1
    real = F.col("l_partkey") % 6 > 0
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("recipe_id"), pos.alias("pos"), F.when(real, F.concat(F.lit("d"), (F.col("l_suppkey") % 2).cast("string"))).alias("src_doc"),
        F.when(real, 1 + F.col("l_linenumber") + F.col("l_partkey") % 2).cast("int").alias("src_page"), (90 * (F.col("l_partkey") % 4)).cast("int").alias("rotate"),
        F.when(F.col("l_partkey") % 18 == 0, 300.0).alias("width"), F.lit(None).cast("double").alias("height"),
    )


#: Parts as pages of two documents.
DOC_PAGES = """g AS (SELECT 'd' || p_partkey % 2 AS doc_id, CAST(p_partkey // 2 + 1 AS INTEGER) AS page_no, 500 + p_size::DOUBLE AS width, 700 + 10 * (p_size % 7)::DOUBLE AS height, CAST(90 * (p_size % 4) AS INTEGER) AS rotation FROM part)"""


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.floor(F.col("p_partkey") / 2) + 1
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("d"), (F.col("p_partkey") % 2).cast("string")).alias("doc_id"), number.cast("int").alias("page_no"), (500 + F.col("p_size").cast("double")).alias("width"),
        (700 + 10 * (F.col("p_size") % 7).cast("double")).alias("height"), (90 * (F.col("p_size") % 4)).cast("int").alias("rotation"),
    )


#: Line items as entries of outlines, a supplier's being one, and where pages go.
OUTLINES = f"""o AS (SELECT l_suppkey AS doc_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY {_ORDER}) AS pos, CAST(l_linenumber - l_partkey % 2 AS INTEGER) AS level, CASE WHEN l_partkey % 9 > 0 THEN l_returnflag || l_partkey END AS title, CAST(l_partkey % 50 AS INTEGER) AS page_no FROM lineitem),
m AS (SELECT l_suppkey AS doc_id, CAST(l_partkey % 50 AS INTEGER) AS old_page, CAST(l_orderkey % 90 AS INTEGER) AS new_page FROM lineitem WHERE l_orderkey % 3 = 0)"""


def outlines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = table(spark, sf_dir, "lineitem")
    pos = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*ITEM_ORDER))
    title = F.when(F.col("l_partkey") % 9 > 0, F.concat("l_returnflag", F.col("l_partkey").cast("string")))
    entries = items.select(F.col("l_suppkey").alias("doc_id"), pos.cast("long").alias("pos"), (F.col("l_linenumber") - F.col("l_partkey") % 2).cast("int").alias("level"), title.alias("title"), (F.col("l_partkey") % 50).cast("int").alias("page_no"))
    places = items.where("l_orderkey % 3 = 0").select(F.col("l_suppkey").alias("doc_id"), (F.col("l_partkey") % 50).cast("int").alias("old_page"), (F.col("l_orderkey") % 90).cast("int").alias("new_page"))
    return entries, places


#: Line items as nodes of trees, a supplier's being one; a node's parent is any node before it.
TREE = f"""w AS (SELECT l_suppkey AS doc_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY {_ORDER}) - 1 AS node_id, l_partkey AS p, l_orderkey AS o FROM lineitem),
t AS (SELECT *, CASE WHEN node_id > 0 THEN (p * 7919 + o) % node_id END AS parent_id FROM w)"""


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, node_id, p, o, parent_id)."""
    number = (F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*ITEM_ORDER)) - 1).cast("long")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_id"), number.alias("node_id"), F.col("l_partkey").alias("p"), F.col("l_orderkey").alias("o"))
    return rows.withColumn("parent_id", F.when(F.col("node_id") > 0, (F.col("p") * 7919 + F.col("o")) % F.col("node_id")))
