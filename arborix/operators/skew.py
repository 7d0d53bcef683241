"""Per-key results over keys of any skew, by exact offset chunking.

Rows are counted per (key, input partition); prefix sums of those counts give every (key, input partition) its offset in
a key-ordered numbering; rows are numbered from their offset; chunks of equal size are cut from the numbering, whatever
the keys; every chunk yields one state per key in it; and the states of a key that crosses chunk boundaries are merged in
chunk order. No task ever holds more of a key than one input partition or one chunk has of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborix.runtime import materialize, shuffle_partitions

CHUNK_ROWS = 65_536


def number_rows(df: DataFrame, key: Column, payload: dict[str, Column], order: list[str], stable_input: bool = False) -> DataFrame:
    """Number all rows with a non-null key: columns k, the payload, bucket, and pos, the row's place in its bucket.

    A bucket is a hash range of keys; inside it rows are ordered by key, then input partition, then `order`, and pos runs
    from 0 without gaps. stable_input says that df is a plain scan, whose partitions are the same each time it is read;
    anything else is written first. Rows with a null key have no result; an empty table gives an empty one; repeated
    rows each get a number of their own; extra columns of df are ignored.
    """
    base = df.select(key.alias("k"), *[c.alias(n) for n, c in payload.items()]).filter(F.col("k").isNotNull())
    if not stable_input:
        base = materialize(base, "numbered-input")
    base = base.withColumn("pid", F.spark_partition_id())
    counts = base.groupBy("k", "pid").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("bucket", F.pmod(F.xxhash64("k"), F.lit(shuffle_partitions(df.sparkSession))))
    before = Window.partitionBy("bucket").orderBy("k", "pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("k", "pid", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("k", "pid").orderBy(*order)
    numbered = base.join(offsets, ["k", "pid"])
    return numbered.select("k", *payload, "bucket", (F.col("offset") + F.row_number().over(within) - 1).alias("pos"))


_PARTIAL = {
    "min": lambda c: F.min(c),
    "max": lambda c: F.max(c),
    "sum": lambda c: F.sum(c),
    "count": lambda c: F.count(c),
    "first": lambda c: F.min_by(F.struct(F.col(c).alias("v")), "pos"),
    "last": lambda c: F.max_by(F.struct(F.col(c).alias("v")), "pos"),
}
_MERGE = {
    "min": lambda c: F.min(c),
    "max": lambda c: F.max(c),
    "sum": lambda c: F.sum(c),
    "count": lambda c: F.sum(c),
    "first": lambda c: F.min_by(c, "chunk")["v"],
    "last": lambda c: F.max_by(c, "chunk")["v"],
}


def chunked_aggregate(
    df: DataFrame,
    key: Column,
    payload: dict[str, Column],
    aggregates: dict[str, tuple[str, str]],
    order: list[str] | None = None,
    chunk_rows: int = CHUNK_ROWS,
    stable_input: bool = False,
) -> DataFrame:
    """One row per key: column k and `aggregates`, given as {result: (min|max|sum|count|first|last, payload column)}.

    first and last follow the numbering of number_rows(). Nulls are skipped by min, max, sum and count, kept by first and
    last. All keys go the same way, hot or not: states are made per chunk of chunk_rows rows and merged in chunk order.
    """
    numbered = number_rows(df, key, payload, order or list(payload), stable_input)
    chunk = F.struct("bucket", F.floor(F.col("pos") / F.lit(chunk_rows)).alias("chunk"))
    states = numbered.withColumn("chunk", chunk).groupBy("k", "chunk").agg(*[_PARTIAL[kind](c).alias(n) for n, (kind, c) in aggregates.items()])
    return states.groupBy("k").agg(*[_MERGE[kind](n).alias(n) for n, (kind, _) in aggregates.items()])
