"""Incremental refresh as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from arborix.functions.text import clean_hash
from arborix.runtime import delete_path, list_paths, materialize
from arborix.sources.sinks import replace_table


def duplicate_hash_stream(files: DataFrame, state: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Keep counts per hash of a stream of file rows, as a table that duplicate_hash_state() reads.

    The state lies in buckets of hashes, state/v<batch>/bucket=<k>. A micro-batch writes only the buckets it touches,
    combined with the version of these before it; a batch that is run again writes the same version again, so it counts
    once. Versions of a bucket that two later ones have replaced are deleted. Hashes without a value are left out.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        counts = batch.select(clean_hash("hash").alias("hash")).filter("hash IS NOT NULL").groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
        counts = materialize(counts.withColumn("bucket", F.pmod(F.xxhash64("hash"), F.lit(buckets)).cast("int")), "batch-counts")
        touched = sorted(r["bucket"] for r in counts.select("bucket").distinct().collect())  # at most `buckets`
        if not touched:
            return
        versions = _versions(spark, state)
        before = [f"{state}/v{max(v)}/bucket={k}" for k in touched if (v := [x for x in versions.get(k, []) if x < number])]
        if before:
            old = spark.read.schema("hash string, n long").parquet(*before)
            counts = counts.select("hash", "n").unionByName(old).groupBy("hash").agg(F.sum("n").alias("n")).withColumn("bucket", F.pmod(F.xxhash64("hash"), F.lit(buckets)).cast("int"))
        replace_table(counts, f"{state}/v{number}", partition_by=["bucket"])
        for k in touched:
            for v in sorted(x for x in versions.get(k, []) if x < number)[:-1]:
                delete_path(spark, f"{state}/v{v}/bucket={k}")

    return files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def duplicate_hash_state(spark: SparkSession, state: str) -> DataFrame:
    """The latest state of duplicate_hash_stream(): hash, n, is_duplicate."""
    latest = [f"{state}/v{max(v)}/bucket={k}" for k, v in sorted(_versions(spark, state).items())]
    counts = spark.read.schema("hash string, n long").parquet(*latest) if latest else spark.createDataFrame([], "hash string, n long")
    return counts.withColumn("is_duplicate", F.col("n") > 1)


def _versions(spark: SparkSession, state: str) -> dict[int, list[int]]:
    """The versions there are of each bucket."""
    out: dict[int, list[int]] = {}
    for version in list_paths(spark, f"{state}/v*"):
        for bucket in list_paths(spark, f"{version}/bucket=*"):
            out.setdefault(int(bucket.rpartition("=")[2]), []).append(int(version.rpartition("/v")[2]))
    return out


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their values per window and type, of a stream or a table; a stream forgets windows older than `late`."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    per = timed.groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return per.select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


def refresh_every(changes: DataFrame, refresh: Callable[[DataFrame], None], seconds: int, checkpoint: str, least: int = 5) -> StreamingQuery:
    """Call refresh with the changes of a stream at most every so many seconds (never more often than `least`).

    An interval without changes calls nothing; the query's checkpoint says what was seen, so a refresh that was cut short
    is made again. stop() ends the loop.
    """

    def step(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            refresh(batch)

    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(processingTime=f"{max(least, seconds)} seconds").start()
