"""The file index: one current row per path, search, sorting and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborix.functions.text import clean_hash, sqlite_like
from arborix.runtime import materialize

COLUMNS = ["id", "path", "name", "size", "modified", "hash", "is_directory", "is_file", "is_symlink", "parent_path", "traversed", "traverse_error"]


def current_index(files: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The record of each path with the largest id, hashes cleaned; rows without a path are left out.

    The latest record is picked by a combined aggregate, so a path recorded very often costs no more than others. Only the
    named columns (all of COLUMNS if none are named) besides the path enter it, so only these are read and shuffled.
    """
    keep = [c for c in COLUMNS if c == "path" or columns is None or c in columns]
    rest = [c for c in keep if c != "path"]
    rows = files.filter(F.col("path").isNotNull()).groupBy("path")
    if not rest:
        return rows.agg().select("path")
    latest = rows.agg(F.max_by(F.struct(*rest), F.coalesce("id", F.lit(-(2**63)))).alias("r")).select("path", "r.*")
    return (latest.withColumn("hash", clean_hash("hash")) if "hash" in rest else latest).select(*keep)


def with_names(files: DataFrame, names: DataFrame, name_id: str = "file_name_id", name: str = "dictionary_name") -> DataFrame:
    """files with the name that their name id has in the dictionary; rows without one are left out.

    names has unique ids, so AQE can split the join at a name that very many files have.
    """
    return files.join(names.select(F.col("id").alias(name_id), F.col("name").alias(name)), name_id)


def name_dictionary(names: DataFrame, new: DataFrame, name: str = "name") -> DataFrame:
    """The dictionary (id, name) with the names it lacks, numbered on from its largest id in order of the names."""
    first = names.agg(F.coalesce(F.max("id"), F.lit(0)).alias("first"))
    fresh = new.select(F.col(name).alias("name")).filter("name IS NOT NULL").distinct().join(names.select("name"), "name", "left_anti")
    numbered = positions(fresh.orderBy("name")).crossJoin(F.broadcast(first))  # one row
    return names.select("id", "name").unionByName(numbered.select((F.col("first") + F.col("position")).alias("id"), "name"))


def kind_filter(target: str) -> Column:
    """Which rows a search admits: "files" and "folders" admit links as well, "both" does not."""
    directory, file = {"files": (False, True), "folders": (True, False), "both": (True, True)}[target]
    return (F.col("is_directory") == directory) | (F.col("is_file") == file)


def search(index: DataFrame, text: str, pattern: str = "contains", target: str = "both") -> DataFrame:
    """Rows whose name matches: exact, starts, ends or contains; only ASCII case is folded, % and _ are wildcards."""
    like = {"exact": "{}", "starts": "{}%", "ends": "%{}", "contains": "%{}%"}[pattern].format(text)
    return index.filter(sqlite_like("name", like) & kind_filter(target))


def path_search(index: DataFrame, text: str) -> DataFrame:
    """Rows whose path contains the text in any case."""
    return index.filter(F.contains(F.lower("path"), F.lit(text.lower())))


def ordered(df: DataFrame, by: str, descending: bool, tie: list[str], allowed: tuple[str, ...] = ("name", "size", "modified", "path")) -> DataFrame:
    """Sorted by one allowed column (the first one for any other), nulls first upwards, then by the tie columns."""
    by = by if by in allowed else allowed[0]
    return df.orderBy(F.desc(by) if descending else F.asc(by), *tie)


def page(df: DataFrame, number: int = 1, per_page: int = 50, most: int | None = 200) -> DataFrame:
    """One page of a sorted frame: numbers below 1 count as 1, sizes are clamped to 1 .. most."""
    per_page = max(1, per_page if most is None else min(per_page, most))
    return df.offset((max(1, number) - 1) * per_page).limit(per_page)


def page_count(rows: Column, per_page: int) -> Column:
    return F.ceil(rows / F.lit(per_page))


def listing(index: DataFrame, order: str = "default") -> DataFrame:
    """All rows in one of the listing orders: default (kind, then path), cased (name) or folded (name in lower case)."""
    keys = {"default": ["is_directory", "is_file", "is_symlink", "path"], "cased": ["name", "path"], "folded": [F.lower("name"), "name", "path"]}
    return index.orderBy(*keys[order])


def positions(listed: DataFrame) -> DataFrame:
    """A sorted frame with the position of each row, from 1: numbers inside the sorted partitions plus those before them.

    The sorted rows are written once, so that numbers and counts come from the same sort; only one count a partition meets
    in one task.
    """
    row = F.monotonically_increasing_id()
    table = materialize(listed.withColumn("_part", F.shiftright(row, 33)).withColumn("_at", row.bitwiseAND(F.lit(2**33 - 1))), "listing")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = table.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return table.join(F.broadcast(counts), "_part").withColumn("position", F.col("before") + F.col("_at") + 1).drop("_part", "_at", "before")
