r"""WARC archives: written by Spark's text writer, read back with boundary-chain verification.

Writing: each page is a ``response`` record with its HTML, or a ``revisit`` record that refers to the
response with the same payload and states the payload's digest. Records are rows of a text table whose line separator is the blank
lines that end a record, so the files are plain WARC and Spark's commit protocol covers lost tasks.

Reading: the files are split at the magic line, by Spark's splittable text reader. Each piece is a
candidate record; the task reads its header and emits its offset and the offset of its successor.
A magic line inside a payload makes a candidate too, so candidates are believed only if a chain of
successors leads to them from the start of the file. Tasks shorten the chains to the offset where
they leave their block of the file; pointer jumping over these, in as many rounds as the logarithm
of the blocks of a file, finds where the true chain enters each block; a walk through each block's
offsets then marks its records. Payloads that hold the magic line are put together from their pieces.

Defined results: null HTML counts as empty and empty payloads are responses; of equal payloads of
``least_bytes`` bytes or more the largest page id is the response (all rows that share it); ids may
repeat with other payloads, as a revisit is resolved by id and digest; null ids
are never chosen while there is an id, and if all are null all are responses; null or odd URLs are
written percent-encoded; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import broadcast_if_small, discard, scratch_path, written

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
LEAST_BYTES = 1000
MOST_BROADCAST = 2_000_000
_ID = "urn:docloom:page:"
_LENGTH = re.compile(rb"(?im)^Content-Length:\s*(\d+)\s*$")
_FIELD = {name: re.compile(rb"(?im)^%s:\s*(.*?)\s*$" % name.encode()) for name in ("WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Payload-Digest")}
_BREAK = b"\r\n\r\n"


def with_types(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, payload, digest, size, response: null, or the page whose payload this one repeats."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1(F.col("payload").cast("binary"))).withColumn("size", F.octet_length("payload").cast("long"))
    copies = rows.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n"))
    copies = written(copies.where("n > 1").select(F.col("digest").alias("copied"), "response"), "copies")
    rows = rows.join(broadcast_if_small(copies, MOST_BROADCAST), F.col("digest") == F.col("copied"), "left").drop("copied")
    own = F.col("response").eqNullSafe(F.col("page_id"))
    return rows.withColumn("response", F.when(~own, F.col("response")))


def _lines(*fields: tuple[str, Column | str]) -> Column:
    parts = []
    for name, value in fields:
        parts += [F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value.cast("string"), F.lit("\r\n")]
    return F.concat(*parts)


def _urn(page_id: str) -> Column:
    return F.concat(F.lit(f"<{_ID}"), F.coalesce(F.col(page_id).cast("string"), F.lit("")), F.lit(">"))


def records(typed: DataFrame, date: str = DATE) -> DataFrame:
    """``value``: each page's record without the blank lines that end it."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    url = F.regexp_replace(F.coalesce("url", F.lit("about:blank")), r"\s", "%20")
    common = [("WARC-Record-ID", _urn("page_id")), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest"))]
    kind = "application/http; msgtype=response"
    block = F.concat(http, "payload")
    response = F.concat(F.lit(MAGIC), _lines(("WARC-Type", "response"), *common, ("Content-Type", kind), ("Content-Length", F.octet_length(block))), F.lit("\r\n"), block)
    profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    revisit = F.concat(
        F.lit(MAGIC),
        _lines(("WARC-Type", "revisit"), *common, ("WARC-Profile", profile), ("WARC-Refers-To", _urn("response")), ("Content-Type", kind), ("Content-Length", F.octet_length(http))),
        F.lit("\r\n"),
        http,
    )
    return typed.select(F.when(F.col("response").isNull(), response).otherwise(revisit).alias("value"))


def write(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, date: str = DATE) -> None:
    """Archives of ``pages`` (page_id, url, html) in the folder ``path``."""
    records(with_types(pages, least_bytes), date).write.option("lineSep", END).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): what lies between magic lines, in the order of the file within each block."""
    text = spark.read.option("lineSep", MAGIC).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _payload(block: bytes) -> bytes:
    """What follows the HTTP header."""
    return block.partition(_BREAK)[2]


def _parsed(piece: bytes) -> tuple | None:
    """(type, id, refers_to, stated digest, header bytes, content bytes), if the piece begins with a record's header."""
    at = piece.find(_BREAK)
    head = piece[:at] if at >= 0 else b""
    length = _LENGTH.search(head)
    if not length:
        return None
    fields = [found[1].decode("utf-8", "replace") if (found := _FIELD[name].search(head)) else None for name in _FIELD]
    return (*fields, at + len(_BREAK), int(length[1]))


_CANDIDATE = "file string, block long, at long, next long, leaves long, end long, type string, id string, refers_to string, stated string, complete boolean, payload_bytes long, payload_digest string"


def _candidates(pieces: DataFrame) -> DataFrame:
    """One row for each magic line. Offsets count from the start of the block's first piece.

    ``at``: the record's; ``next``: its successor's; ``leaves``: where the chain from it leaves the block, null
    where it breaks off; ``end``: the bytes of the block's pieces with their magic lines.
    """

    def of_block(file: str, block: int, rows: list[tuple], end: int) -> pa.RecordBatch:
        leaves: dict[int, int | None] = {}
        for at, following, *_ in reversed(rows):
            leaves[at] = following if following is None or following > rows[-1][0] else leaves.get(following)
        columns = list(zip(*[(file, block, at, following, leaves[at], end, *rest) for at, following, *rest in rows], strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    names = [c.split()[0] for c in _CANDIDATE.split(", ")]
    types = [{"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[c.split()[1]] for c in _CANDIDATE.split(", ")]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, end = None, [], 0
        for batch in batches:
            for file, block, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, block) != key:
                    if key:
                        yield of_block(*key, rows, end)
                    key, rows, end = (file, block), [], 0
                at, parsed = end - len(MAGIC), _parsed(value)
                if parsed is None:  # also what stands before the file's first magic line
                    rows.append((at, None, None, None, None, None, False, None, None))
                else:
                    kind, name, refers_to, stated, head, length = parsed
                    complete = len(value) >= head + length
                    payload = _payload(value[head : head + length]) if complete else None
                    digest = hashlib.sha1(payload).hexdigest() if complete else None
                    rows.append((at, end + head + length + len(END), kind, name, refers_to, stated, complete, len(payload) if complete else None, digest))
                end += len(value) + len(MAGIC)
        if key:
            yield of_block(*key, rows, end)

    return pieces.mapInArrow(found, _CANDIDATE)


def _absolute(candidates: DataFrame) -> DataFrame:
    """Offsets counted from the start of the file instead."""
    blocks = candidates.groupBy("file", "block").agg(F.max("end").alias("size"))
    before = F.sum("size").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = blocks.select("file", "block", F.coalesce(before, F.lit(0)).alias("start"))
    return candidates.join(starts, ["file", "block"]).select(
        "file", "block", *[(F.col(c) + F.col("start")).alias(c) for c in ("at", "next", "leaves")], F.col("at").alias("in_block"), *[c for c in candidates.columns if c not in ("file", "block", "at", "next", "leaves", "end")]
    )


def _entries(candidates: DataFrame) -> DataFrame:
    """(file, at): where the chain from the start of each file enters its blocks, by pointer jumping."""
    nodes = candidates.select("file", "at", F.col("leaves").alias("to"))
    jumps = written(nodes.where(F.col("to").isNotNull()), "jumps")
    reached = written(nodes.where("at = 0").select("file", "at"), "reached")
    size = reached.count()
    while True:
        far = reached.join(jumps, ["file", "at"]).select("file", F.col("to").alias("at"))
        # Only places that are candidates count; the others end the file or break the chain.
        far = far.join(candidates.select("file", "at"), ["file", "at"], "left_semi")
        more = written(reached.unionByName(far).distinct(), "reached")
        discard(reached)
        reached, before, size = more, size, more.count()
        if size == before:
            discard(jumps)
            return reached
        onward = jumps.select("file", F.col("at").alias("to"), F.col("to").alias("further"))
        doubled = written(jumps.join(onward, ["file", "to"]).select("file", "at", F.col("further").alias("to")), "jumps")
        discard(jumps)
        jumps = doubled


def _marked(candidates: DataFrame) -> DataFrame:
    """``candidates`` with ``chained``: whether the chain from the file's start leads to each."""
    entries = _entries(candidates).withColumn("entry", F.lit(True))
    rows = candidates.join(entries, ["file", "at"], "left")

    def walked(block: pa.Table) -> pa.Table:
        at, following = block.column("at").to_pylist(), block.column("next").to_pylist()
        place = {a: i for i, a in enumerate(at)}
        true = np.zeros(len(at), bool)
        for i in np.flatnonzero(np.array(block.column("entry").fill_null(False))).tolist():
            while i is not None and not true[i]:
                true[i] = True
                i = place.get(following[i])
        return pa.table({"file": block.column("file"), "at": block.column("at"), "chained": pa.array(true)})

    marks = rows.select("file", "block", "at", "next", "entry").groupBy("file", "block").applyInArrow(walked, "file string, at long, chained boolean")
    return candidates.join(marks, ["file", "at"])


def _assembled(spark: SparkSession, path: str, marked: DataFrame) -> DataFrame:
    """(file, at, bytes, digest) of the payloads that hold magic lines, from their pieces."""
    torn = marked.where(~F.col("chained") | ~F.col("complete")).select("file", "block", "at", "in_block", "chained")
    owner = F.last(F.when(F.col("chained"), F.col("at")), ignorenulls=True).over(Window.partitionBy("file").orderBy("at"))
    parts = written(torn.withColumn("owner", owner).where(F.col("owner").isNotNull()).select("file", "block", "in_block", "at", "owner"), "torn")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, end = None, 0
        for batch in batches:
            at = []
            for file, block, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), pc.binary_length(batch.column(2)).to_pylist(), strict=True):
                key, end = (file, block), end if (file, block) == key else 0
                at.append(end - len(MAGIC))
                end += size + len(MAGIC)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.int64()), batch.column(2)], ["file", "block", "in_block", "value"])

    pieces = _pieces(spark, path).mapInArrow(placed, "file string, block long, in_block long, value binary")
    pieces = pieces.join(broadcast_if_small(parts, MOST_BROADCAST), ["file", "block", "in_block"])

    def joined(record: pa.Table) -> pa.Table:
        rows = record.sort_by("at")
        whole = MAGIC.encode().join(rows.column("value").to_pylist())
        parsed, payload = _parsed(whole), None
        if parsed and len(whole) >= sum(parsed[-2:]):
            payload = _payload(whole[parsed[-2] : sum(parsed[-2:])])
        size, digest = (len(payload), hashlib.sha1(payload).hexdigest()) if payload is not None else (None, None)
        return pa.table({"file": rows.column("file")[:1], "at": rows.column("owner")[:1], "bytes": pa.array([size], pa.int64()), "sha1": pa.array([digest], pa.string())})

    return pieces.groupBy("file", "owner").applyInArrow(joined, "file string, at long, bytes long, sha1 string")


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every record in the archives under ``path``."""
    candidates = written(_absolute(written(_candidates(_pieces(spark, path)), "pieces")), "candidates")
    marked = written(_marked(candidates), "marked")
    true = marked.where("chained")
    if marked.where(F.col("chained") & ~F.col("complete")).head(1):
        torn = _assembled(spark, path, marked)
        true = true.join(torn, ["file", "at"], "left").withColumn("payload_bytes", F.coalesce("payload_bytes", "bytes")).withColumn("payload_digest", F.coalesce("payload_digest", "sha1"))

    def number(urn: str) -> Column:
        return F.expr(f"try_cast(regexp_extract({urn}, '{_ID}(-?[0-9]+)', 1) AS bigint)")

    stated = F.regexp_extract("stated", "^sha1:([0-9a-f]{40})$", 1)
    pages = true.select(number("id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), number("refers_to").alias("refers_to"), stated.alias("stated"))
    responses, revisits = pages.where("record_type = 'response'").drop("stated"), pages.where("record_type = 'revisit'")
    # A revisit's payload is that of the response with its page id and the digest that it states, as ids may repeat.
    told = revisits.select(F.col("refers_to").alias("page_id"), F.col("stated").alias("payload_digest")).distinct()
    referred = responses.join(told, ["page_id", "payload_digest"], "left_semi").select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("stated"), "payload_bytes", "payload_digest").distinct()
    resolved = revisits.select("page_id", "record_type", "refers_to", "stated").join(referred, ["refers_to", "stated"], "left").drop("stated")
    return responses.unionByName(resolved)


def round_trip(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Writes archives of ``pages`` in the shared folder and reads them back."""
    path = scratch_path(pages.sparkSession, "warc")
    write(pages, path, least_bytes)
    return read(pages.sparkSession, path)


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, strlen(t) AS payload_bytes, sha1(t) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= {LEAST_BYTES} THEN max(page_id) OVER (PARTITION BY payload_digest) END AS response FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN response IS DISTINCT FROM page_id AND response IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN response IS DISTINCT FROM page_id THEN response END AS refers_to
FROM m
"""
