"""The directory tree over parent paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborix.functions.text import path_depth
from arborix.operators.duplicates import duplicate_hashes
from arborix.runtime import materialize, release


def children(index: DataFrame, folder: str | None = None) -> DataFrame:
    """Direct entries of a folder, directories first, then by name; without a folder, the entries that have no parent."""
    rows = index.filter(F.col("parent_path").isNull() if folder is None else F.col("parent_path") == folder)
    return rows.select("path", "name", "is_directory", "size", "modified").orderBy(F.desc("is_directory"), "name", "path")


def child_counts(index: DataFrame) -> DataFrame:
    """Per parent: files and folders among its direct entries."""
    return index.filter("parent_path IS NOT NULL").groupBy("parent_path").agg(F.count_if("is_file").alias("files"), F.count_if("is_directory").alias("folders"))


def duplicate_flags(index: DataFrame, folder: str) -> DataFrame:
    """Direct entries of a folder that are, or hold anywhere below, a duplicate file: path, name."""
    hits = index.filter("is_file").join(duplicate_hashes(index), "hash", "left_semi").filter(F.startswith("path", F.lit(folder + "/")))
    first = F.substring_index(F.substring("path", len(folder) + 2, 2**31 - 1), "/", 1)
    return hits.select(first.alias("name")).distinct().select(F.concat(F.lit(folder + "/"), F.col("name")).alias("path"), "name")


def folders_with_duplicates(index: DataFrame) -> DataFrame:
    """Every folder with a duplicate file directly or anywhere below it: folder, duplicates."""
    hits = index.filter("is_file").join(duplicate_hashes(index), "hash", "left_semi").groupBy("parent_path").agg(F.count(F.lit(1)).alias("n"))
    parts = F.split("parent_path", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return hits.filter("parent_path <> ''").select(F.explode(above).alias("folder"), "n").groupBy("folder").agg(F.sum("n").alias("duplicates"))


def tree_rows(index: DataFrame) -> DataFrame:
    """All entries with their depth, in the order of a tree view: depth, parent, directories first, name in lower case."""
    out = index.select("path", "parent_path", "name", "is_directory", path_depth("path").alias("depth"))
    return out.orderBy("depth", "parent_path", F.desc("is_directory"), F.lower("name"), "path")


def subtree(index: DataFrame, roots: DataFrame) -> DataFrame:
    """path of all entries below the roots over parent paths, and the roots themselves, known or not.

    Level by level; every level is written, so lineage stays short. Where every path has one row, as in a current
    index, each entry is met once, from its parent, so that only the roots are not followed again; otherwise all paths met
    before are not. Either way it ends at any depth and with rings.
    """
    edges = materialize(index.filter("parent_path IS NOT NULL").select("path", "parent_path"), "edges")
    level = materialize(roots.select("path").filter("path IS NOT NULL").distinct(), "level")
    # two paths of one hash only lead to the slower way
    one_parent = edges.groupBy(F.xxhash64("path").alias("h")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
    seen = closed = level
    while True:
        below = edges.join(level.withColumnRenamed("path", "parent_path"), "parent_path", "left_semi").select("path")
        nxt = materialize((below if one_parent else below.distinct()).join(closed, "path", "left_anti"), "level")
        if nxt.isEmpty():
            release(nxt)
            break
        seen, level = seen.unionByName(nxt), nxt
        closed = closed if one_parent else seen
    return seen


def leaf_directory_sizes(index: DataFrame) -> DataFrame:
    """Sum of the sizes of direct entries for folders without subfolders, where it is above 0: parent_path, size."""
    per = index.filter("parent_path IS NOT NULL").groupBy("parent_path").agg(F.sum(F.when(~F.col("is_directory"), F.col("size"))).alias("size"), F.bool_or("is_directory").alias("nested"))
    return per.filter("NOT nested AND size > 0").select("parent_path", "size")


def common_root(paths: DataFrame, group: str, path: str) -> DataFrame:
    """The deepest folder that holds all paths of each group: group, root ("" where only the top is shared).

    The smallest and the largest path of a group, in the order of their parts, bound all others, so their common parts
    are everybody's. As texts they do not: space and "-" sort before "/".
    """
    parts = F.split(path, "/")
    ends = paths.groupBy(group).agg(F.min(parts).alias("lo"), F.max(parts).alias("hi"))
    a, b = F.col("lo"), F.col("hi")
    same = F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: x["a"] == x["b"])
    differs = F.array_position(F.transform(same, lambda x: F.coalesce(x, F.lit(False))), False)
    n = F.when(differs == 0, F.least(F.size(a), F.size(b))).otherwise(differs - 1).cast("int")
    return ends.select(group, F.array_join(F.slice(a, F.lit(1), n), "/").alias("root"))
