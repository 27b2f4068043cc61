"""What the operators of this subpackage share: tables, scratch tables, checked broadcasts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom import session
from docloom.session import shared_dir, table

__all__ = ["broadcast_if_small", "crc32_of_id", "discard", "finished", "parts_for", "scratch_path", "shared_dir", "table", "unlike", "written"]

#: What the calls of ``finished`` that are under way have written.
_under_way: list[list[str]] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    path = session.scratch_path(spark, label)
    if _under_way:
        _under_way[-1].append(path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and outlives any executor."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(df: DataFrame) -> None:
    """Deletes the table behind a frame that ``written`` returned and nothing reads any more."""
    _delete(df.sparkSession, df.scratch)


def finished(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """What ``make`` returns, written; the tables that it wrote on its way are deleted."""
    _under_way.append([])
    try:
        out = written(make(), label)
        _under_way[-1].remove(out.scratch)
    finally:
        for path in _under_way.pop():
            _delete(spark, path)
    return out


def broadcast_if_small(df: DataFrame, most_rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most_rows`` rows, else as it is, for a shuffled join.

    Meant for narrow rows (a few numbers each) of a written table, whose count costs no scan.
    """
    return F.broadcast(df) if df.count() <= most_rows else df


def unlike(df: DataFrame, *names: str) -> list[str]:
    """``names`` with signs added until no column of ``df`` has one of them, in whatever case."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def parts_for(rows: int, rows_per_part: int) -> int:
    return max(1, -(-rows // rows_per_part))


def crc32_of_id(column: str = "doc_id") -> Column:
    """CRC-32 of an id written as text; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))
