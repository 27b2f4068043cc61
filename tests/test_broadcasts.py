"""Scratch tables of many rows are small files all the same; they must not pass through the driver."""

from docloom.operators import layout
from docloom.operators.chains import components
from docloom.session import MOST_BROADCAST, written


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_many_rows_in_a_small_file_are_joined_by_shuffle(spark):
    rows = written(spark.range(MOST_BROADCAST + 1), "many")
    for other in (rows, written(spark.range(3), "few")):
        joined = other.selectExpr("id + 1 AS id").where("id > 0").join(rows, "id")
        assert "BroadcastHashJoin" not in plan(joined)


def test_few_rows_may_be_joined_by_broadcast(spark):
    few = written(spark.range(3), "few")
    assert "BroadcastHashJoin" in plan(few.join(few.selectExpr("id + 1 AS id"), "id"))


def test_components_of_many_nodes(spark):
    edges = spark.range(MOST_BROADCAST).selectExpr("id % 7 AS doc_id", "id AS a", "id + 7 AS b").where("a % 70 < 63")
    found = components(edges, ["doc_id"])
    assert "BroadcastHashJoin" not in plan(found.join(found.selectExpr("doc_id", "label AS node"), ["doc_id", "node"]))
    assert found.where("label <> node - node % 70 + node % 7").count() == 0


def test_parts_of_a_small_file_do_not_pass_through_the_driver(spark, tmp_path):
    """Parts come from a table as it is given, which may be a small file of many rows too."""
    spark.range(MOST_BROADCAST + 1).selectExpr("id % 7 AS doc_id", "1 AS page_no", "id AS part_no", "id % 90 + 0.5D AS x0", "10.0D AS y0", "id % 90 + 1.5D AS x1", "12.0D AS y1").write.parquet(f"{tmp_path}/parts")
    parts = spark.read.parquet(f"{tmp_path}/parts")
    cells = written(spark.range(7).selectExpr("id AS doc_id", "1 AS page_no", "0 AS table_no", "0 AS row_no", "0 AS col_start", "0.0D AS x0", "0.0D AS y0", "45.0D AS x1", "20.0D AS y1"), "cells")
    found = layout.in_cells(parts, cells)
    assert "BroadcastHashJoin" not in plan(found)
    assert found.count() == parts.where("x0 <= 45").count()
