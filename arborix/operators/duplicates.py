"""Exact duplicates: hashes, groups, wasted space, flags and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborix.functions.text import extension


def duplicate_hashes(index: DataFrame) -> DataFrame:
    """Non-empty hashes of more than one row."""
    return index.filter("hash IS NOT NULL AND hash <> ''").groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash")


def duplicate_files(index: DataFrame) -> DataFrame:
    """All rows, links included, whose hash is a duplicate one."""
    return index.join(duplicate_hashes(index), "hash", "left_semi")


def duplicate_groups(index: DataFrame) -> DataFrame:
    """One row per duplicate hash: copies, size of a copy (the smallest stored), wasted bytes, first path."""
    groups = index.filter("hash IS NOT NULL AND hash <> ''").groupBy("hash").agg(F.count(F.lit(1)).alias("copies"), F.min("size").alias("size"), F.min("path").alias("first_path"))
    return groups.filter("copies > 1").withColumn("wasted_bytes", (F.col("copies") - 1) * F.coalesce("size", F.lit(0)))


def filtered_groups(index: DataFrame, text: str | None = None, min_size: int = 0, extensions: list[str] | None = None) -> DataFrame:
    """Duplicate groups with a member for each condition: text in name or path, at least a size, one of the extensions."""
    conditions: list[Column] = []
    if text:
        q = F.lit(text.lower())
        conditions.append(F.contains(F.lower("name"), q) | F.contains(F.lower("path"), q))
    if min_size:
        conditions.append(F.col("size") >= min_size)
    if extensions:
        conditions.append(extension("name").isin([e.lower() for e in extensions]))
    groups = index.filter("hash IS NOT NULL AND hash <> ''").groupBy("hash").agg(
        F.count(F.lit(1)).alias("copies"), F.min("size").alias("size"), *[F.coalesce(F.bool_or(c), F.lit(False)).alias(f"c{i}") for i, c in enumerate(conditions)]
    )
    for i in range(len(conditions)):
        groups = groups.filter(f"c{i}")
    return groups.filter("copies > 1").select("hash", "copies", "size", ((F.col("copies") - 1) * F.coalesce("size", F.lit(0))).alias("wasted_bytes"))


def group_members(index: DataFrame) -> DataFrame:
    """The members of duplicate groups as rows, numbered nowhere and collected nowhere: hash, path, name, size, modified."""
    return duplicate_files(index).select("hash", "path", "name", "size", "modified")


def duplicate_stats(index: DataFrame, kind: str = "is_file") -> DataFrame:
    """One row: duplicate rows of a kind, their groups, and the bytes that all but one copy take."""
    kept = index.filter(F.col(kind)).join(duplicate_hashes(index), "hash", "left_semi")
    per = kept.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("size"))
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("duplicates"), F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum((F.col("n") - 1) * F.col("size")), F.lit(0)).alias("wasted_bytes")
    )


def by_hash(index: DataFrame) -> DataFrame:
    """Counts by hash, rows without one under "<no hash>"."""
    return index.groupBy(F.coalesce("hash", F.lit("<no hash>")).alias("hash")).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path"))


def flagged_files(index: DataFrame, hashes: DataFrame) -> DataFrame:
    """Files with is_duplicate: whether the hash is in a stored list; the list may repeat hashes."""
    marks = hashes.select("hash").distinct().withColumn("marked", F.lit(True))
    return index.filter("is_file").join(marks, "hash", "left").select("parent_path", "name", "path", "size", "hash", F.col("marked").isNotNull().alias("is_duplicate"))


def aligned(index: DataFrame, folders: list[str]) -> DataFrame:
    """Files of some folders side by side: a row per hash, a column per folder with the last name, shared ones first.

    A folder with several files of a hash shows the one with the largest path.
    """
    rows = index.filter(F.col("is_file") & F.col("hash").isNotNull() & F.col("parent_path").isin(folders))
    cells = [F.max_by(F.when(F.col("parent_path") == f, F.col("name")), F.when(F.col("parent_path") == f, F.col("path"))).alias(f"folder_{i}") for i, f in enumerate(folders)]
    out = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("files"), F.min("name").alias("first_name"), *cells)
    return out.orderBy((F.col("files") > 1).desc(), "first_name", "hash")


def duplicate_extensions(index: DataFrame) -> DataFrame:
    """Distinct extensions of duplicate files, 1 to 16 bytes long."""
    ext = duplicate_files(index).filter("is_file").select(extension("name").alias("extension"))
    return ext.filter(F.octet_length("extension").between(1, 16)).distinct()
