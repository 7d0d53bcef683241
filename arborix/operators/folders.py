"""Groups of folders that share duplicate files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborix.functions.text import ascii_fold, base_name, parent_of
from arborix.operators.components import star_components
from arborix.operators.duplicates import duplicate_files
from arborix.operators.index import positions
from arborix.runtime import materialize


def duplicate_places(index: DataFrame) -> DataFrame:
    """folder, hash, size of every duplicate row; folders come from the path, a root entry's folder is ""."""
    return duplicate_files(index).filter(~F.col("is_directory")).select(parent_of("path").alias("folder"), "hash", "size")


def folder_components(places: DataFrame) -> DataFrame:
    """folder, group: folders linked by shared hashes directly or through others; the group is its smallest folder.

    Every folder of a hash is linked with the smallest folder of that hash, which leaves no hashes in the graph. Folders
    are numbered in their order, so the rounds move numbers and the smallest number of a component is its smallest folder.
    """
    uses = materialize(places.select("folder", "hash").distinct(), "uses")
    least = uses.groupBy("hash").agg(F.min("folder").alias("least"))
    numbers = uses.select("folder").distinct().orderBy("folder").withColumn("number", F.monotonically_increasing_id())
    numbers = materialize(numbers, "folder-numbers")
    # one row a hash and one row a folder on one side each, so AQE can split both joins
    linked = uses.join(least, "hash").select("folder", "least").distinct().filter("folder <> least")
    ends = linked.join(numbers.select("folder", F.col("number").alias("a")), "folder")
    edges = ends.join(numbers.select(F.col("folder").alias("least"), F.col("number").alias("b")), "least").select("a", "b")
    nodes = star_components(edges)
    rooted = numbers.join(nodes.select(F.col("node").alias("number"), "root"), "number", "left").withColumn("root", F.coalesce("root", "number"))
    names = numbers.join(nodes.select(F.col("root").alias("number")).distinct(), "number", "left_semi").select(F.col("number").alias("root"), F.col("folder").alias("group"))
    return rooted.join(names, "root", "left").select("folder", F.coalesce("group", "folder").alias("group"))


def folder_groups(places: DataFrame, components: DataFrame) -> DataFrame:
    """Groups of at least two folders: group_id, folder_path, folder_name, shared_count, file_count, min_size.

    file_count counts duplicate rows of the folder; min_size is its smallest size, none below 0; shared_count is the
    number of hashes that occur in the group exactly as often as the group has folders.
    """
    sized = components.groupBy("group").agg(F.count(F.lit(1)).alias("folders")).filter("folders > 1")
    members = components.join(sized, "group")
    per_folder = places.groupBy("folder").agg(F.count(F.lit(1)).alias("file_count"), F.min(F.greatest(F.coalesce("size", F.lit(0)), F.lit(0))).alias("min_size"))
    # combined per folder first, so that a hash in very many rows meets the group as one row a folder
    uses = places.groupBy("folder", "hash").agg(F.count(F.lit(1)).alias("n")).join(members, "folder").groupBy("group", "folders", "hash").agg(F.sum("n").alias("n"))
    shared = uses.filter("n = folders").groupBy("group").agg(F.count(F.lit(1)).alias("shared_count"))
    out = members.join(per_folder, "folder").join(shared, "group", "left")
    return out.select(
        F.col("group").alias("group_id"), F.col("folder").alias("folder_path"), base_name("folder").alias("folder_name"), F.coalesce("shared_count", F.lit(0)).alias("shared_count"), "file_count", "min_size"
    )


def numbered_groups(groups: DataFrame) -> DataFrame:
    """Groups with a name group_1, group_2 ... in order of their ids; a distributed sort, no task sees all groups."""
    names = positions(groups.select("group_id").distinct().orderBy("group_id"))
    return groups.join(names.select("group_id", F.concat(F.lit("group_"), F.col("position").cast("string")).alias("group_name")), "group_id")


def ordered_list(groups: DataFrame, by: str = "shared", descending: bool = True) -> DataFrame:
    """A group list by shared (also for any unknown order), folders, name (ASCII case folded) or files, then by group."""
    key = {"folders": F.col("folders"), "name": ascii_fold("first_name"), "files": F.col("files")}.get(by, F.col("shared_count"))
    return groups.orderBy(key.desc() if descending else key.asc(), "group_id")


def group_list(groups: DataFrame, text: str | None = None, min_shared: int = 0, min_folders: int = 2, min_size: int = 0) -> DataFrame:
    """One row per group that passes: a folder whose name or path contains the text, and limits on its figures."""
    if text:
        like = f"%{text.lower()}%"
        hit = groups.filter(F.lower("folder_name").like(like) | F.lower("folder_path").like(like)).select("group_id").distinct()
        groups = groups.join(hit, "group_id", "left_semi")
    out = groups.groupBy("group_id").agg(
        F.max("shared_count").alias("shared_count"), F.count(F.lit(1)).alias("folders"), F.sum("file_count").alias("files"), F.min("folder_name").alias("first_name"), F.min("min_size").alias("min_size")
    )
    return out.filter((F.col("shared_count") >= min_shared) & (F.col("folders") >= max(2, min_folders)) & (F.col("min_size") >= min_size))


def regrouped(old: DataFrame, places: DataFrame, changed_folders: DataFrame) -> DataFrame:
    """Incremental refresh: components touched by changed folders are made again, the others are kept.

    old has folder, group of the last run. A changed folder touches its old group and every old group it now shares a
    hash with; the union of those folders is the scope that is computed again.
    """
    seeds = changed_folders.select("folder").distinct()
    near = places.join(places.join(seeds, "folder", "left_semi").select("hash").distinct(), "hash", "left_semi").select("folder").distinct()
    touched = old.join(near.unionByName(seeds).distinct(), "folder", "left_semi").select("group").distinct()
    scope = old.join(touched, "group", "left_semi").select("folder").unionByName(near).unionByName(seeds).distinct()
    again = folder_components(places.join(scope, "folder", "left_semi"))
    return old.join(touched, "group", "left_anti").select("folder", "group").unionByName(again)
