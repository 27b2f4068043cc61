"""Page summaries against the fold over one document's pages."""

from pyspark.sql import functions as F

from docloom.functions import ranges
from docloom.operators import pages


def test_summaries_agree_with_the_fold(spark):
    lists = {"a": [1, 2, 3, 7], "b": [9], "c": [1, 3, 5, 7, 8], "d": [4, 4, 2, 2, 9, 11, 20, 21, 30], "e": [None], None: [1, 2], "f": list(range(1, 3001, 2))}
    rows = spark.createDataFrame([(k, p) for k, ps in lists.items() for p in ps], "source string, d int")
    fold = {r[0]: r[1] for r in rows.groupBy("source").agg(F.collect_list("d").alias("p")).select("source", ranges.page_summary(F.col("p"))).collect()}
    got = pages.summaries(rows, "source", "d")
    assert {r.source: r.summary for r in got.collect()} == fold
    none = spark.createDataFrame([("f", 1)], "source string, d int").limit(0)
    assert pages.summaries(none, "source", "d").count() == 0
