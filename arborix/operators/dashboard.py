"""Figures over the whole index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborix.functions.text import week_label
from arborix.operators.duplicates import duplicate_hashes, duplicate_stats
from arborix.runtime import materialize

#: Seconds since 1970 at which four-digit years begin and end; other times have no label.
FIRST_TIME, LAST_TIME = -62_167_219_200, 253_402_300_799


def totals(index: DataFrame) -> DataFrame:
    """One row: files, folders, bytes of files; zeros for an empty index."""
    return index.agg(
        F.count_if("is_file").alias("files"), F.count_if("is_directory").alias("folders"), F.coalesce(F.sum(F.when(F.col("is_file"), F.col("size"))), F.lit(0)).alias("bytes")
    )


def _labels(ts: Column) -> dict[str, Column]:
    return {"day": F.date_format(ts, "yyyy-MM-dd"), "week": week_label(ts), "month": F.date_format(ts, "yyyy-MM"), "year": F.date_format(ts, "yyyy")}


def timeline(index: DataFrame) -> DataFrame:
    """Files, folders and bytes of files by day, week, month and year of modification, in one pass over the index.

    Days are combined first; weeks, months and years are made from the days. Times without a four-digit year have no label.
    """
    timed = index.filter(F.col("modified").between(FIRST_TIME, LAST_TIME)).withColumn("day", F.timestamp_seconds(F.floor("modified")).cast("date"))
    days = timed.groupBy("day").agg(F.count_if("is_file").alias("files"), F.count_if("is_directory").alias("folders"), F.coalesce(F.sum(F.when(F.col("is_file"), F.col("size"))), F.lit(0)).alias("size"))
    kinds = F.array(*[F.struct(F.lit(k).alias("interval_type"), c.alias("label")) for k, c in _labels(F.col("day")).items()])
    return days.select(F.explode(kinds).alias("k"), "files", "folders", "size").groupBy("k.interval_type", "k.label").agg(*[F.sum(c).alias(c) for c in ("files", "folders", "size")])


def running_size(line: DataFrame) -> DataFrame:
    """The timeline with the bytes up to each label; at most one row a day and interval is in a window."""
    w = Window.partitionBy("interval_type").orderBy("label").rowsBetween(Window.unboundedPreceding, 0)
    return line.withColumn("running_size", F.sum("size").over(w))


def dashboard(index: DataFrame, last_entry: int = 0, refreshed: float = 0.0, interval: int = 60) -> DataFrame:
    """One row of all figures; entries_behind counts ids above the last refresh, next_refresh is 0 before the first."""
    index = materialize(index.select("id", "hash", "size", "is_file", "is_directory"), "figures")
    files = duplicate_stats(index).toDF("duplicate_files", "duplicate_groups", "wasted_bytes")
    folders = duplicate_stats(index, "is_directory").toDF("duplicate_folders", "duplicate_folder_groups", "wasted_folder_bytes")
    newest = index.agg(F.max("id").alias("newest"))
    stored = duplicate_hashes(index).agg(F.count(F.lit(1)).alias("duplicate_hashes"))
    row = totals(index)
    for part in (files, folders, stored, newest):  # one row each
        row = row.crossJoin(F.broadcast(part))
    behind = F.greatest(F.coalesce("newest", F.lit(0)) - last_entry, F.lit(0)).alias("entries_behind")
    return row.select(*[c for c in row.columns if c != "newest"], behind, F.lit(refreshed + interval if refreshed else 0.0).alias("next_refresh"))
