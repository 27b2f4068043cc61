"""Search hits as pages arrive: the batch search over a stream, each place once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docloom.operators import search
from docloom.session import scratch_path


def pages(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def hits(stream: DataFrame, query: str, key: tuple[str, ...] = ("doc_id",), seen_at: str | None = None, delay: str = "1 hour") -> DataFrame:
    """(key, start, end) of the hits in a stream of pages. With a time column, places are remembered no longer than ``delay``."""
    found = search.search(stream, query)
    if seen_at is None:
        return found.select(*key, "start", "end").dropDuplicates([*key, "start"])
    late = found.withWatermark(seen_at, delay).select(*key, "start", "end", seen_at)
    return late.dropDuplicatesWithinWatermark([*key, "start"])


def counts(stream: DataFrame, query: str, seen_at: str, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """(window, hits): the hits of each span of time, complete once the delay has passed."""
    found = stream.withColumn("hits", search.hit_count(F.col("text"), query)).withWatermark(seen_at, delay)
    return found.groupBy(F.window(seen_at, window)).agg(F.sum("hits").alias("hits"))


def delivered(stream: DataFrame, label: str = "hits") -> DataFrame:
    """All that a stream gives now, written to the shared folder exactly once and read back."""
    spark = stream.sparkSession
    path = scratch_path(spark, label)
    run = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/progress").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
