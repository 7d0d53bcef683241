"""Queries of problem 2: results per hash where a few hashes hold most records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborix.functions.text import clean_hash
from arborix.operators.skew import chunked_aggregate
from arborix.runtime import load

_HASH = r"nullif(lower(regexp_replace(hash, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), '')"


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes recorded with at least two different paths."""
    files = load(spark, sf_dir, "files").select("hash", "path")
    per = chunked_aggregate(files, clean_hash("hash"), {"path": F.col("path")}, {"lo": ("min", "path"), "hi": ("max", "path")}, stable_input=True)
    return per.filter(F.col("lo") != F.col("hi")).select(F.col("k").alias("hash"))


def p2_hash_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per hash: records, records with a size, bytes, smallest and largest path."""
    files = load(spark, sf_dir, "files").select("hash", "path", "size", "id")
    per = chunked_aggregate(
        files, clean_hash("hash"), {"path": F.col("path"), "size": F.col("size"), "id": F.col("id")},
        {"records": ("count", "id"), "sized": ("count", "size"), "bytes": ("sum", "size"), "first_path": ("min", "path"), "last_path": ("max", "path")},
        stable_input=True,
    )
    return per.withColumnRenamed("k", "hash")


QUERIES = {"p2_found": p2_found, "p2_hash_stats": p2_hash_stats}
SQL = {
    "p2_found": f"SELECT {_HASH} AS hash FROM files WHERE {_HASH} IS NOT NULL GROUP BY 1 HAVING count(DISTINCT path) > 1",
    "p2_hash_stats": f"SELECT {_HASH} AS hash, count(id) AS records, count(size) AS sized, CAST(sum(size) AS BIGINT) AS bytes, min(path) AS first_path, max(path) AS last_path FROM files WHERE {_HASH} IS NOT NULL GROUP BY 1",
}
