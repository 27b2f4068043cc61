"""Exact deduplication as a stateful stream, by DataFrame and Structured Streaming functions alone.

Texts are equal when they are identical without the characters ``[\\x20\\x09-\\x0D]``. Two streams run over
the files of a table, each with its progress in the folder ``home``, so that a later call takes new files only:

* ``digests``: each row's id, SHA-256 of the normalised text, code points of the original text and content
  locator (file, row in the file), appended to a table by the file sink, exactly once;
* the index: an aggregation without a watermark, so nothing expires, whose state is kept on disk by
  RocksDB. Its key is the digest (its first ``key_bytes`` bytes); it retains the first row of the key (most code
  points, then smallest id, then locator) as identifier and locator, and the number of rows.

The state is read back as a table. Where a key has several rows, their full bytes are checked: the smallest
and the largest normalised text of a key must be the same text. Both are partial aggregates, so a group of
copies that holds a third of all rows becomes one row for each task before it is shuffled, and only texts with a copy
move. Keys that fail the check are grouped again by the texts themselves. Rows get their group by a join that
broadcasts groups of many rows, a bounded number, and shuffles narrow rows for the others.

Defined results: null texts are empty and equal each other and all texts of white space; null ids come last in
the order; rows equal in id and text are several rows of which one stays, the first by locator; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docloom.llm.common import broadcast_if_small, scratch_path, unlike, written
from docloom.llm.neardup import with_class

#: Keys with several rows that are broadcast at most, to find the texts that have copies.
MOST_BROADCAST = 1_000_000
#: Bytes of new files that one batch of a stream takes at most (one file at least).
BATCH_BYTES = 1 << 40
#: Files of a state store aren't allocated in advance, as there are as many stores as shuffle partitions.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "500",
}


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def key_of(digest: Column, key_bytes: int) -> Column:
    return F.substring(digest, 1, key_bytes)


def place() -> Column:
    """What orders the rows of a group; the first stays."""
    return F.struct((-F.col("size")).alias("shortness"), F.col("doc_id").isNull().alias("last"), "doc_id", "file", "row")


def as_stream(spark: SparkSession, path: str, schema: StructType, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """The Parquet file or folder ``path`` as a stream; sources of streams take one file by a pattern only."""
    pattern = path if any(c in path for c in "*?[{") else f"{path.rstrip('/')[:-1]}[{path.rstrip('/')[-1]}]"
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", str(batch_bytes)).parquet(pattern)


def digests(rows: DataFrame) -> DataFrame:
    """(doc_id, file, row, size, sha) of each row of a frame that comes from files, batch or stream."""
    return rows.select(
        "doc_id",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("size"),
        sha256(F.col("text")).alias("sha"),
    )


def _state_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep their state on disk."""
    own = spark.newSession()
    for key, value in STATE_SETTINGS.items():
        own.conf.set(key, value)
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    return own


class Index:
    """The keyed state of a table's digests, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, home: str, key_bytes: int = 32) -> None:
        self.spark, self.home, self.key_bytes = spark, home, key_bytes

    def advance(self, path: str, batch_bytes: int = BATCH_BYTES) -> Index:
        """Takes the files of ``path`` that were not taken before."""
        schema = self.spark.read.parquet(path).schema
        found = digests(as_stream(self.spark, path, schema, batch_bytes))
        sink = found.writeStream.format("parquet").option("path", f"{self.home}/digests").option("checkpointLocation", f"{self.home}/digests-progress")
        sink.trigger(availableNow=True).start().awaitTermination()
        if self.rows(found.schema).head(1):
            stream = _state_session(self.spark).readStream.schema(found.schema).parquet(f"{self.home}/digests")
            grouped = stream.withColumn("digest", key_of(F.col("sha"), self.key_bytes)).groupBy("digest").agg(F.min(place()).alias("first"), F.count("*").alias("n"))
            # The state is the result, and is read by ``groups``; what a batch changes isn't needed.
            index = grouped.writeStream.format("noop").outputMode("update").option("checkpointLocation", f"{self.home}/state")
            index.trigger(availableNow=True).start().awaitTermination()
        self._schema = found.schema
        return self

    def rows(self, schema: StructType | None = None) -> DataFrame:
        """Every row taken so far: doc_id, file, row, size, sha."""
        return self.spark.read.schema(schema or self._schema).parquet(f"{self.home}/digests")

    def groups(self) -> DataFrame:
        """(digest, n, first) of every key: its number of rows, and identifier and locator of the first."""
        if not self.rows().head(1):
            return self.rows().select(key_of(F.col("sha"), self.key_bytes).alias("digest"), F.lit(0).cast("long").alias("n"), place().alias("first"))
        state = self.spark.read.format("statestore").load(f"{self.home}/state")
        return state.select("key.digest", F.col("value.count").alias("n"), F.col("value.min").alias("first"))


def unequal_keys(docs: DataFrame, groups: DataFrame, key_bytes: int = 32) -> DataFrame:
    """(digest) of the keys of ``groups`` (digest, n, ...) whose rows' normalised texts are not all the same bytes."""
    several = written(groups.where("n > 1").select("digest", "n"), "repeated-keys")
    texts = docs.select(normalised(F.col("text")).alias("body")).withColumn("digest", key_of(F.unhex(F.sha2("body", 256)), key_bytes))
    small = broadcast_if_small(several, MOST_BROADCAST)
    hits = texts.join(small, "digest", "left_semi") if small is not several else with_class(texts, several, "digest")
    checked = hits.groupBy("digest").agg(F.min("body").alias("low"), F.max("body").alias("high"))
    return checked.where("low <> high").select("digest")


def deduplicated(spark: SparkSession, path: str, home: str | None = None, key_bytes: int = 32) -> DataFrame:
    """Each row of the Parquet table ``path`` with its group: doc_id, file, row, sha, keep_id, group_size, kept.

    ``home`` keeps the index for later calls; without it a new folder of the shared one does.
    """
    index = Index(spark, home or scratch_path(spark, "exact-dedup"), key_bytes).advance(path)
    groups = written(index.groups(), "groups")
    docs = spark.read.parquet(path)
    wrong = written(unequal_keys(docs, groups, key_bytes), "unequal-keys")
    rows = index.rows().withColumn("digest", key_of(F.col("sha"), key_bytes))
    group = [F.col("n").alias("group_size"), F.col("first.doc_id").alias("keep_id"), F.col("first.file").alias("keep_file"), F.col("first.row").alias("keep_row")]
    kept = (F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))
    columns = ["doc_id", "file", "row", "sha", "keep_id", "group_size", kept.alias("kept")]
    if not wrong.head(1):
        return with_class(rows, written(groups.select("digest", "n", *group), "classes"), "digest").select(*columns)
    # Different texts under one key: those rows are grouped by the texts themselves.
    right = rows.join(wrong, "digest", "left_anti")
    found = with_class(right, written(groups.join(wrong, "digest", "left_anti").select("digest", "n", *group), "classes"), "digest").select(*columns)
    texts = docs.select("*", "_metadata").transform(digests_with_body).withColumn("digest", key_of(F.col("sha"), key_bytes)).join(wrong, "digest", "left_semi")
    exact = texts.groupBy("body").agg(F.min(place()).alias("first"), F.count("*").alias("n"))
    return found.unionByName(with_class(texts, written(exact.select("body", "n", *group), "exact"), "body").select(*columns))


def digests_with_body(rows: DataFrame) -> DataFrame:
    """``digests`` with the normalised text."""
    return rows.select(
        "doc_id",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("size"),
        sha256(F.col("text")).alias("sha"),
        normalised(F.col("text")).alias("body"),
    )


def kept_documents(spark: SparkSession, path: str, home: str | None = None) -> DataFrame:
    """The rows of the table ``path`` that stay, whole, found by their locators."""
    docs = spark.read.parquet(path)
    at, gone = unlike(docs, "at", "gone")
    going = deduplicated(spark, path, home).where(~F.col("kept")).select(F.struct("file", "row").alias(gone))
    going = broadcast_if_small(written(going, "going"), MOST_BROADCAST)
    located = docs.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias(at))
    return located.join(going, F.col(at) == F.col(gone), "left_anti").select(*docs.columns)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and the digest as text."""
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k AS (SELECT doc_id, length(t) AS n, regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g') AS body FROM d)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
  row_number() OVER w = 1 AS kept, sha256(body) AS text_sha256
FROM k WINDOW w AS (PARTITION BY body ORDER BY n DESC, doc_id NULLS LAST)
"""
