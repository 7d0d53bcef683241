"""Append-only snapshots: latest row per key, differences, ranges, archives."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The row of each key that is last in order, by a combined aggregate; null keys are left out."""
    rest = [c for c in df.columns if c != key]
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def with_latest(entities: DataFrame, snapshots: DataFrame, key: str, snapshot_key: str, order: list[str], take: list[str]) -> DataFrame:
    """Entities with columns of their latest snapshot, nulls where there is none."""
    last = latest(snapshots.select(snapshot_key, *dict.fromkeys([*order, *take])), snapshot_key, order)
    return entities.join(last.select(F.col(snapshot_key).alias(key), *take), key, "left")


def removed(before: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """Keys that were there before and are not there now."""
    return before.select(key).distinct().join(now.select(key), key, "left_anti")


def signature(df: DataFrame, key: Column) -> DataFrame:
    """One row that changes when the set of keys changes: their number and a digest.

    The digest adds up parts of the keys' MD5, so it is the same in any order, is combined before the shuffle, and no row
    ever holds all keys.
    """
    keys = df.select(key.cast("string").alias("k")).filter("k IS NOT NULL").distinct().select(F.md5("k").alias("h"))
    part = lambda at: F.coalesce(F.sum(F.conv(F.substring("h", at, 8), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string")
    return keys.agg(F.count(F.lit(1)).alias("keys"), F.concat_ws("-", *[part(at) for at in (1, 9, 17, 25)]).alias("digest"))


def parse_ranges(text: str) -> list[tuple[int, int]]:
    """Inclusive ranges from "1014,1100-1200"; anything else is an error."""
    out = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        lo, _, hi = part.partition("-")
        if not lo.strip().isdigit() or (hi and not hi.strip().isdigit()):
            raise ValueError(f"not a range: {part}")
        out.append((int(lo), int(hi or lo)))
    return out


def in_ranges(df: DataFrame, column: str, text: str) -> DataFrame:
    """Rows whose number is in one of the ranges; merged ranges become pushed-down comparisons."""
    merged: list[list[int]] = []
    for lo, hi in sorted(parse_ranges(text)):
        if merged and lo <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], hi)
        else:
            merged.append([lo, hi])
    test = F.lit(False)
    for lo, hi in merged:
        test = test | F.col(column).between(lo, hi)
    return df.filter(test)


def newest_document(listing: DataFrame, suffix: str) -> DataFrame:
    """The newest row whose name ends in the suffix, in any case; unreadable times are the oldest."""
    rows = listing.filter(F.endswith(F.lower("name"), F.lit(suffix.lower()))).withColumn("at", F.try_to_timestamp(F.col("created").cast("string")))
    return rows.orderBy(F.desc_nulls_last("at"), F.desc("name")).limit(1).drop("at")


def merged_state(stored: DataFrame, listed: DataFrame, key: str, keep: list[str], defaults: dict[str, Column]) -> DataFrame:
    """stored and listed by key: columns `keep` stay as stored, all others come from the listing; new keys get defaults."""
    s = stored.select(key, F.struct(*[c for c in stored.columns if c != key]).alias("s"))
    n = listed.select(key, F.struct(*[c for c in listed.columns if c != key]).alias("n"))
    both = s.join(n, key, "full_outer")
    out = []
    for c in (c for c in stored.columns if c != key):
        old = F.col(f"s.{c}")
        new = F.col(f"n.{c}") if c in listed.columns else F.lit(None)
        out.append((F.when(F.col("s").isNotNull(), old).otherwise(defaults.get(c, F.lit(None))) if c in keep else F.when(F.col("n").isNotNull(), new).otherwise(old)).alias(c))
    return both.select(key, *out)


def inspected(entities: DataFrame, key: str = "id", only: int | None = None, status: str | None = None, limit: int | None = None) -> DataFrame:
    """Entities by key, with a given key, a given status, and as many as asked for; what is missing, 0 or "" does not filter."""
    out = entities.filter(F.col(key) == only) if only else entities
    out = (out.filter(F.col("status") == status) if status else out).orderBy(key)
    return out.limit(limit) if limit and limit > 0 else out


def history(snapshots: DataFrame, key: str, value: int, order: str = "id") -> DataFrame:
    """All snapshots of one key, newest first."""
    return snapshots.filter(F.col(key) == value).orderBy(F.desc(order))


def list_delta(stored: DataFrame, listed: DataFrame, order: list[str]) -> DataFrame:
    """What a growing list holds beyond the number of rows stored, in its order: nothing if it did not grow."""
    known = stored.count()
    return listed.orderBy(*order).offset(known) if listed.count() > known else listed.limit(0)


def not_failed(df: DataFrame, status: str = "status", failed: str = "failed") -> DataFrame:
    """Rows whose status is there and is not the failed one."""
    return df.filter(F.col(status) != failed)


def store_stats(df: DataFrame, key: str, status: str, is_open: str, order: str) -> DataFrame:
    """One row: rows, different keys, rows of a status, largest order."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(key).alias("keys"), F.count_if(F.col(status) == is_open).alias("open"), F.max(order).alias("newest"))


def newest_archived(df: DataFrame, key: str, run_stamp: str = "run_stamp", sequence: str = "sequence") -> DataFrame:
    """The archived row of each key that is last by run stamp, compared as text, then by sequence."""
    return latest(df, key, [run_stamp, sequence])


def context(*tables: DataFrame) -> DataFrame:
    """The different rows of several state tables with the same columns."""
    return reduce(DataFrame.unionByName, tables).distinct()


def set_settings(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Settings (key, value) with the values of new; of several new values of a key the largest is taken, null keys are left out."""
    latest_ = new.filter("key IS NOT NULL").groupBy("key").agg(F.max("value").alias("value"))
    return stored.select("key", "value").join(latest_, "key", "left_anti").unionByName(latest_)


def by_run_stamp(df: DataFrame, name: str = "name") -> DataFrame:
    """df with run_stamp, the first 15 characters of the name where these are a date, "_" and a time; null elsewhere."""
    stamp = F.regexp_extract(name, r"^(\d{8}_\d{6})", 1)
    return df.withColumn("run_stamp", F.nullif(stamp, F.lit("")))


def still_to_do(todo: DataFrame, outcomes: DataFrame, key: str) -> DataFrame:
    """What a run that was cut short still has to do: keys without an outcome, and those whose last attempt failed.

    outcomes has the key, attempt and status; done is what does not have to be done again.
    """
    last = latest(outcomes.select(key, "attempt", "status"), key, ["attempt", "status"])
    return todo.join(last.filter("status = 'done'").select(key), key, "left_anti")
