"""Small lists around documents: recent files, eviction, printers, paths to open, undo history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RECENT = 15
LONGEST_PATH = 32_767
PRINTER = "array<struct<Name:string,Default:boolean,WorkOffline:boolean,PrinterStatus:int,ExtendedPrinterStatus:int,PortName:string,CapabilityDescriptions:array<string>>>"


def recent_files(opened: DataFrame, keep: int = RECENT) -> DataFrame:
    """(user, place, path): the last opened files, newest first, each once; paths are compared without case."""
    last = opened.groupBy("user", F.lower("path").alias("folded")).agg(F.max("at").alias("at"), F.max_by("path", "at").alias("path"))
    place = F.row_number().over(Window.partitionBy("user").orderBy(F.desc("at"), "folded"))
    return last.withColumn("place", place).where(F.col("place") <= keep).select("user", "place", "path")


def evicted(entries: DataFrame, keep: int) -> DataFrame:
    """Cache entries (cache, key, used_at) that the newest ``keep`` push out."""
    age = F.row_number().over(Window.partitionBy("cache").orderBy(F.desc("used_at"), "key"))
    return entries.withColumn("age", age).where(F.col("age") > keep).drop("age")


def printers(found: DataFrame, usual: str | None) -> DataFrame:
    """(place, name, shown, usual): named printers once each, by their shown names in Turkish order without case."""
    name = F.trim("name")
    rows = found.withColumn("name", name).where("name <> ''").groupBy("name").agg(F.min_by(F.coalesce("display_name", "name"), "pos").alias("shown"), F.min("pos").alias("pos"))
    order = F.row_number().over(Window.orderBy(F.collate("shown", "tr_CI_AI"), "pos"))
    return rows.select(order.alias("place"), "name", "shown", (F.col("name") == F.lit(usual)).alias("usual"))


def printer_states(json: Column) -> Column:
    """Structs (name, offline, duplex, to_file, usual) from the system's JSON: a list, one object, or nothing readable."""
    bare = F.trim(F.regexp_replace(json, "^﻿", ""))
    listed = F.when(bare.startswith("["), bare).otherwise(F.concat(F.lit("["), bare, F.lit("]")))
    rows = F.filter(F.coalesce(F.from_json(listed, PRINTER), F.array().cast(PRINTER)), lambda p: F.coalesce(F.trim(p.Name), F.lit("")) != "")
    no = F.lit(False)
    return F.transform(
        rows,
        lambda p: F.struct(
            F.trim(p.Name).alias("name"),
            (F.coalesce(p.WorkOffline, no) | F.coalesce(p.PrinterStatus == 7, no) | F.coalesce(p.ExtendedPrinterStatus == 7, no)).alias("offline"),
            F.coalesce(F.exists(p.CapabilityDescriptions, lambda c: F.lower(F.trim(c)) == "duplex"), no).alias("duplex"),
            F.coalesce(F.upper(F.trim(p.PortName)).rlike("^(PORTPROMPT|FILE):?$"), no).alias("to_file"),
            F.coalesce(p.Default, no).alias("usual"),
        ),
    )


def paths_error(paths: Column, most: int = 100) -> Column:
    """Null for a list of absolute paths that may be opened, else ``bad_list`` or ``bad_path``."""
    absolute = lambda p: p.startswith("/") | p.rlike(r"^([A-Za-z]:[\\/]|\\\\)")
    wrong = F.exists(paths, lambda p: p.isNull() | (p == "") | (F.length(p) > LONGEST_PATH) | F.contains(p, F.lit("\0")) | ~absolute(p))
    return F.when(paths.isNull() | (F.size(paths) == 0) | (F.size(paths) > most), "bad_list").when(wrong, "bad_path")


def history(events: DataFrame) -> DataFrame:
    """(doc_id, pos, at, depth, saved, dirty): the undo history after each event (``do``, ``undo``, ``redo``, ``save``).

    A new command cuts what could be redone; if the saved state was there it can't be reached again (-1).
    Each state depends on the one before, so a document's events are folded in order.
    """
    state = "struct<at:int,depth:int,saved:int>"
    rows = events.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "op"))).alias("events"))
    nothing = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("saved")).cast(state)
    empty = F.transform(F.slice("events", 1, 0), lambda e: F.struct(e.pos.alias("pos"), F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("saved")))

    def step(done: Column, e: Column) -> Column:
        now = done.now
        at = F.when(e.op == "do", now.at + 1).when(e.op == "undo", F.greatest(now.at - 1, F.lit(0))).when(e.op == "redo", F.least(now.at + 1, now.depth)).otherwise(now.at)
        depth = F.when(e.op == "do", now.at + 1).otherwise(now.depth)
        saved = F.when(e.op == "save", now.at).when((e.op == "do") & (now.saved > now.at), F.lit(-1)).otherwise(now.saved)
        after = F.struct(at.alias("at"), depth.alias("depth"), saved.alias("saved")).cast(state)
        row = F.struct(e.pos.alias("pos"), after.at.alias("at"), after.depth.alias("depth"), after.saved.alias("saved"))
        return F.struct(after.alias("now"), F.concat(done.rows, F.array(row)).alias("rows"))

    folded = F.aggregate("events", F.struct(nothing.alias("now"), empty.alias("rows")), step, lambda d: d.rows)
    return rows.select("doc_id", F.inline(folded)).withColumn("dirty", F.col("at") != F.col("saved"))
