"""Which copies to keep when folders are merged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_plan(files: DataFrame, scope: list[str]) -> DataFrame:
    """files (scope columns, folder, name, path, hash, size) with action keep or remove.

    Inside a scope the copy of a hash that is first by folder, name and path is kept, the others are removed; files
    without a hash are kept. The kept copy is found by a combined aggregate and joined back, so a hash in very many
    files is no single task's work.
    """
    first = files.filter("hash IS NOT NULL").groupBy(*scope, "hash").agg(F.min(F.struct("folder", "name", "path")).alias("first"))
    first = first.select(*scope, "hash", F.col("first.path").alias("kept_path"))
    out = files.join(first, [*scope, "hash"], "left")
    return out.withColumn("action", F.when(F.col("kept_path").isNull() | (F.col("kept_path") == F.col("path")), "keep").otherwise("remove")).drop("kept_path")


def merge_stats(plan: DataFrame, scope: list[str]) -> DataFrame:
    """Per scope: kept and removed files and the bytes freed."""
    freed = F.coalesce(F.sum(F.when(F.col("action") == "remove", F.col("size"))), F.lit(0))
    return plan.groupBy(*scope).agg(F.count_if(F.col("action") == "keep").alias("kept"), F.count_if(F.col("action") == "remove").alias("removed"), freed.alias("freed_bytes"))


def merged_tree(plan: DataFrame, scope: list[str]) -> DataFrame:
    """The kept files as they would lie in one folder: scope columns, name, copies of the name, path of the first."""
    kept = plan.filter("action = 'keep'")
    return kept.groupBy(*scope, "name").agg(F.count(F.lit(1)).alias("files"), F.min("path").alias("path"))
