"""Keeping an index up to date, as plans over snapshots: every change of a table is a new DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborix.functions.text import is_under
from arborix.operators.tree import subtree

#: Rules that are broadcast.
FEW_RULES = 10_000
VALUES = ["name", "size", "modified", "hash", "is_directory", "is_file", "is_symlink", "parent_path"]


def insert_or_ignore(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """stored and the rows of new whose key is neither null nor stored; of several new ones the smallest row is taken."""
    rest = [c for c in stored.columns if c != key]
    fresh = new.filter(F.col(key).isNotNull()).join(stored.select(key), key, "left_anti").groupBy(key).agg(F.min(F.struct(*rest)).alias("r")).select(key, "r.*")
    return stored.unionByName(fresh.select(*stored.columns))


def upsert(stored: DataFrame, new: DataFrame) -> DataFrame:
    """stored with the values of new by path, and per path inserted and hash_updated.

    traversed and traverse_error stay as stored; a new row starts with traversed false. hash_updated says that a
    non-directory has a new hash that is not null and differs from the stored one. Both sides have unique paths.
    """
    n = new.select("path", F.struct(*VALUES).alias("n"))
    s = stored.select("path", F.struct(*VALUES, "traversed", "traverse_error").alias("s"))
    both = s.join(n, "path", "full_outer")
    values = [F.when(F.col("n").isNotNull(), F.col(f"n.{v}")).otherwise(F.col(f"s.{v}")).alias(v) for v in VALUES]
    known = F.col("s").isNotNull()
    changed = known & F.col("n").isNotNull() & ~F.coalesce("n.is_directory", F.lit(False)) & F.col("n.hash").isNotNull() & ~F.col("n.hash").eqNullSafe(F.col("s.hash"))
    return both.select("path", *values, F.coalesce("s.traversed", F.lit(False)).alias("traversed"), F.col("s.traverse_error").alias("traverse_error"), (~known).alias("inserted"), changed.alias("hash_updated"))


def stale_children(stored: DataFrame, listed: DataFrame) -> DataFrame:
    """Stored children of listed folders that the listing no longer has. listed: parent_path, path (null for an empty folder)."""
    folders = listed.select("parent_path").distinct()
    return stored.join(folders, "parent_path", "left_semi").join(listed.filter("path IS NOT NULL").select("path"), "path", "left_anti")


def without_subtrees(stored: DataFrame, roots: DataFrame) -> DataFrame:
    """stored without the roots and everything below them."""
    return stored.join(subtree(stored, roots), "path", "left_anti")


def marked(stored: DataFrame, outcomes: DataFrame) -> DataFrame:
    """stored with outcomes (path, modified, error): no error marks a directory traversed at that time and clears the old
    error; an error is kept and leaves it to be traversed again. Paths have one outcome at most."""
    o = outcomes.select("path", F.col("modified").alias("o_modified"), F.col("error").alias("o_error"), F.lit(True).alias("o_seen"))
    out = stored.join(o, "path", "left")
    seen, failed = F.coalesce("o_seen", F.lit(False)), F.col("o_error").isNotNull()
    return out.select(*[
        F.when(seen, ~failed).otherwise(F.col(c)).alias(c) if c == "traversed" else F.when(seen, F.col("o_error")).otherwise(F.col(c)).alias(c) if c == "traverse_error"
        else F.when(seen & ~failed & F.col("o_modified").isNotNull(), F.col("o_modified")).otherwise(F.col(c)).alias(c) if c == "modified" else F.col(c)
        for c in stored.columns
    ])


def walk_plan(stored: DataFrame, disk: DataFrame) -> DataFrame:
    """What to do with each directory: purge (gone), skip (traversed or failed before, same time), read (all else).

    stored and disk have path and modified; stored also traversed and traverse_error.
    """
    s = stored.select("path", F.struct(F.col("modified").alias("m"), "traversed", "traverse_error").alias("s"))
    both = s.join(disk.select("path", F.struct(F.col("modified").alias("m")).alias("d")), "path", "full_outer")
    same = F.col("s.m").eqNullSafe(F.col("d.m"))
    handled = F.coalesce("s.traversed", F.lit(False)) | F.col("s.traverse_error").isNotNull()
    action = F.when(F.col("d").isNull(), "purge").when(F.col("s").isNotNull() & same & handled, "skip").otherwise("read")
    return both.select("path", action.alias("action"))


def added_hashes(stored: DataFrame, index: DataFrame, checked: DataFrame) -> DataFrame:
    """The stored duplicate hashes and those checked hashes that now have more than one row; none is ever removed."""
    counts = index.join(checked.select("hash").distinct(), "hash", "left_semi").groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    return stored.select("hash").unionByName(counts.filter("n > 1").select("hash")).filter("hash IS NOT NULL").distinct()


def ignored_folders(index: DataFrame, rules: DataFrame) -> DataFrame:
    """Directories that a rule (name, condition) leaves out: the name is equal, and the condition, if any, is the name of
    an entry beside the directory. A list of at most FEW_RULES rules is broadcast, a longer one is joined."""
    few = len(rules.limit(FEW_RULES + 1).collect()) <= FEW_RULES
    named = rules.withColumnRenamed("name", "rule")
    hits = index.filter("is_directory").select("path", "parent_path", "name").join(F.broadcast(named) if few else named, F.col("name") == F.col("rule"))
    beside = index.select(F.col("parent_path").alias("p"), F.col("name").alias("n")).distinct()
    free = hits.filter("condition IS NULL").select("path", "rule", "condition")
    bound = hits.filter("condition IS NOT NULL").join(beside, (F.col("parent_path") == F.col("p")) & (F.col("condition") == F.col("n")), "left_semi")
    return free.unionByName(bound.select("path", "rule", "condition"))


def resync_request(paths: list[str], remove: list[str], top: str) -> tuple[list[str], list[str]]:
    """Folders to read again and folders to remove, without trailing slashes and each once; a ValueError for a bad request.

    Every path lies below top (top itself included), and nothing is read again that is removed, or lies below what is.
    Nothing asked for means all of top.
    """

    def checked(raw: str) -> str:
        path = raw.strip().rstrip("/")
        if not path:
            raise ValueError("empty path")
        if path != top.rstrip("/") and not path.startswith(top.rstrip("/") + "/"):
            raise ValueError(f"{path} is not below {top}")
        return path

    again, gone = (list(dict.fromkeys(map(checked, x))) for x in (paths, remove))
    for r in gone:
        if any(p == r or p.startswith(r + "/") for p in again):
            raise ValueError(f"{r} cannot be both removed and read again")
    return again if again or gone else [top.rstrip("/")], gone


def resynced(stored: DataFrame, listed: DataFrame, paths: list[str], remove: list[str], top: str = "/") -> DataFrame:
    """stored after a targeted refresh: as upsert(), but only entries at or below the paths come from the listing.

    Entries there that the listing lacks go, as do the removed folders with all below them, whether listed or not. All
    other rows stay. listed is the listing of the paths; its rows elsewhere are ignored.
    """
    again, gone = resync_request(paths, remove, top)

    def below(roots: list[str]) -> Column:
        return reduce(lambda a, b: a | b, (is_under(F.lit(r), F.col("path")) for r in roots), F.lit(False))

    fresh = listed.filter(below(again) & ~below(gone))
    kept = stored.filter(~below(gone))
    stale = kept.filter(below(again)).select("path").join(fresh.select("path"), "path", "left_anti")
    return upsert(kept.join(stale, "path", "left_anti"), fresh)


def parsed_rules(lines: DataFrame, column: str = "line") -> DataFrame:
    """Rules from lines "name" or "name:condition"; blank lines give none."""
    parts = F.split(F.trim(column), ":", 2)
    return lines.filter(F.trim(column) != "").select(F.trim(parts[0]).alias("name"), F.when(F.size(parts) > 1, F.nullif(F.trim(F.get(parts, 1)), F.lit(""))).alias("condition"))
