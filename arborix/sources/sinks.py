"""Writing results."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborix.functions.text import csv_field, safe_name
from arborix.operators.snapshots import by_run_stamp


def write_csv(df: DataFrame, path: str, newline: str = "\n") -> int:
    """One ;-separated file with a byte order mark and a header, written beside its place and moved there. Returns the rows.

    The executors format the rows in the order of df and join them to blocks of an Arrow batch; the driver writes block
    after block, one partition at a time. The file lies on its file system, as one file for people to open.
    """
    line = F.concat_ws(";", *[csv_field(F.col(c).cast("string")) for c in df.columns])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"text": ["".join(x + newline for x in b.column(0).to_pylist())], "rows": [b.num_rows]}, pa.schema([("text", pa.string()), ("rows", pa.int64())]))

    part, n = f"{path}.part", 0
    with open(part, "w", encoding="utf-8-sig", newline="") as f:
        f.write(";".join(df.columns) + newline)
        for block in df.select(line.alias("l")).mapInArrow(together, "text string, rows long").toLocalIterator():
            f.write(block["text"])
            n += block["rows"]
    os.replace(part, path)
    return n


def replace_table(df: DataFrame, path: str, keys: list[str] | None = None, partition_by: list[str] | None = None) -> None:
    """Write a table anew, with unique keys if given; with partitions, only those that df holds are replaced."""
    out = df if not keys else df.groupBy(*keys).agg(F.max(F.struct(*[c for c in df.columns if c not in keys])).alias("r")).select(*keys, "r.*")
    writer = out.write.mode("overwrite")
    if partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    writer.parquet(path)


def append_logs(logs: DataFrame, path: str) -> None:
    """Append log rows; DEBUG is not kept."""
    logs.filter("level <> 'DEBUG'").write.mode("append").parquet(path)


def write_archive(df: DataFrame, path: str, by: list[str]) -> None:
    """JSON files in folders by the given columns, whose values are made safe as names."""
    df.withColumns({c: safe_name(F.col(c).cast("string")) for c in by}).write.mode("append").partitionBy(*by).json(path)


def write_exchanges(exchanges: DataFrame, path: str) -> None:
    """Exchanges (category, endpoint, run_stamp, request, response, data) as JSON in folders category/endpoint/run_stamp/kind.

    Each exchange gives a row for each kind of body that it has; the names of folders are made safe.
    """
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("body")) for k in ("request", "response", "data")])
    rows = exchanges.withColumn("x", F.explode(kinds)).filter("x.body IS NOT NULL").select("category", "endpoint", "run_stamp", "x.kind", "x.body")
    write_archive(rows, path, ["category", "endpoint", "run_stamp", "kind"])


def relayout(spark: SparkSession, source: str, target: str, pattern: str = "*.json") -> None:
    """Copy text files named with a run stamp from one folder into target/run_stamp=<stamp>; the others are left where they are."""
    raw = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(source)
    named = by_run_stamp(raw.select("value", F.col("_metadata.file_name").alias("name"))).filter("run_stamp IS NOT NULL")
    named.select("run_stamp", "name", F.col("value").alias("content")).write.mode("append").partitionBy("run_stamp").parquet(target)
