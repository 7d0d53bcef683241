"""Lists of processes and of ignore rules: filters, orders and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filtered_processes(rows: DataFrame, text: str = "", status: str = "all", category: str = "all") -> DataFrame:
    """Processes (id, name, category, status, message, paused) of a status and a category whose fields hold the text.

    "paused" asks for paused ones whatever their status; the text is looked for in any case in all fields joined by blanks,
    null fields being empty.
    """
    out = rows
    if status == "paused":
        out = out.filter("paused")
    elif status != "all":
        out = out.filter(F.col("status") == status)
    if category != "all":
        out = out.filter(F.col("category") == category)
    if text:
        joined = F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("id", "name", "category", "status", "message")])
        out = out.filter(F.contains(F.lower(joined), F.lit(text.lower())))
    return out


def ordered_processes(rows: DataFrame, by: str = "id", descending: bool = False) -> DataFrame:
    """By id, by the time started (missing ones first), or by any text field in lower case; then by id."""
    key: Column = F.coalesce("id", F.lit(0)) if by == "id" else F.coalesce(F.unix_micros(F.col("started_at").cast("timestamp")), F.lit(0)) if by == "started" else F.lower(F.coalesce(by, F.lit("")))
    return rows.orderBy(key.desc() if descending else key.asc(), "id")


def status_counts(rows: DataFrame) -> DataFrame:
    """Processes by status, and how many of them are paused."""
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("processes"), F.count_if("paused").alias("paused"))


def filtered_rules(rules: DataFrame, kind: str = "all", text: str = "") -> DataFrame:
    """Ignore rules (name, condition): "conditional" with a condition, "always" without, holding the text in either."""
    out = rules if kind == "all" else rules.filter(F.coalesce("condition", F.lit("")) != "" if kind == "conditional" else F.coalesce("condition", F.lit("")) == "")
    return out.filter(F.contains(F.lower(F.concat_ws(" ", "name", "condition")), F.lit(text.lower()))) if text else out
