"""Log rows: filters, counts, and rows read out of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborix.functions.text import ascii_fold, holds_text, sqlite_like

LINE = r"^\[(\d{9,11})\] (DEBUG|INFO|WARN|ERROR) (.*)$"


def filtered_logs(logs: DataFrame, level: str | None = None, search: str | None = None) -> DataFrame:
    """Rows of a level ("all" or none for any) whose message is the search text, or begins with it where it ends in *."""
    out = logs
    if level and level != "all":
        out = out.filter(F.col("level") == level)
    if search:
        out = out.filter(sqlite_like("message", search[:-1] + "%") if search.endswith("*") else F.col("message") == search)
    return out


def skipped(rows: DataFrame, text: str, field: str = "both") -> DataFrame:
    """Skipped paths with the text in path, error or both fields, in any ASCII case; blank text keeps all."""
    text = text.strip()
    if not text:
        return rows
    tests = {c: sqlite_like(c, f"%{text}%") for c in ("path", "error")}
    return rows.filter(tests["path"] | tests["error"] if field == "both" else tests[field])


def level_counts(logs: DataFrame) -> DataFrame:
    return logs.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


def rule_events(logs: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows whose message names a rule as via rule 'name': rule, events; rules without any have 0.

    Names are compared as they are written, % and _ included, in any ASCII case; null rules are left out. Messages are
    cut once, so any number of rules costs one pass.
    """
    named = logs.select(ascii_fold(F.regexp_extract("message", r"(?i)via rule '([^']*)'", 1)).alias("folded")).filter("folded <> ''").groupBy("folded").agg(F.count(F.lit(1)).alias("n"))
    known = rules.select("rule").filter("rule IS NOT NULL").distinct().withColumn("folded", ascii_fold("rule"))
    return known.join(named, "folded", "left").select("rule", F.coalesce("n", F.lit(0)).alias("events"))


def text_counts(logs: DataFrame, texts: list[str]) -> DataFrame:
    """For each of a few texts the rows whose message holds it as it is written (LIKE with an escape character)."""
    if not texts:
        return logs.sparkSession.createDataFrame([], "text string, n long")
    counts = logs.agg(*[F.count_if(holds_text("message", t)).alias(f"n{i}") for i, t in enumerate(texts)])
    pairs = F.array(*[F.struct(F.lit(t).alias("text"), F.col(f"n{i}").alias("n")) for i, t in enumerate(texts)])
    return counts.select(F.inline(pairs))


def process_page(logs: DataFrame, process: int, most: int = 1000) -> DataFrame:
    """The latest rows of one process, at most so many."""
    return logs.filter(F.col("process_id") == process).orderBy(F.desc("timestamp"), "id").limit(most)


def lines_of(documents: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Log rows inside texts, line by line: doc_id, timestamp (seconds), level, message. Other lines give nothing."""
    lines = documents.select(F.col(doc).alias("doc_id"), F.explode(F.split(text, "\n")).alias("line")).filter(F.rlike("line", F.lit(LINE)))
    part = lambda i: F.regexp_extract("line", LINE, i)
    return lines.select("doc_id", part(1).cast("long").alias("timestamp"), part(2).alias("level"), part(3).alias("message"))


def quoted_path(message: str = "message"):
    """The text between the first two single quotes."""
    return F.regexp_extract(message, "'([^']*)'", 1)


def indexed_paths(logs: DataFrame) -> DataFrame:
    """Paths of INFO rows "Indexed '…'" with their number."""
    rows = logs.filter((F.col("level") == "INFO") & F.startswith("message", F.lit("Indexed '"))).select(quoted_path().alias("path"))
    return rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"))


def enriched(logs: DataFrame, index: DataFrame) -> DataFrame:
    """Rows "Indexed '…'" with the number and bytes of the files directly in the folder they name."""
    per = index.filter("is_file").groupBy(F.col("parent_path").alias("folder")).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    rows = logs.withColumn("folder", F.when(F.startswith("message", F.lit("Indexed '")), quoted_path()))
    return rows.join(per, "folder", "left")


def listed_files(logs: DataFrame, index: DataFrame) -> DataFrame:
    """The files directly in the folders that INFO rows "Indexed '…'" name, as rows: folder, path, name, size."""
    folders = indexed_paths(logs).select(F.col("path").alias("folder"))
    files = index.filter("is_file").select(F.col("parent_path").alias("folder"), "path", "name", "size")
    return files.join(folders, "folder", "left_semi")
