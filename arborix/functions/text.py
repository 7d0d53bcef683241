"""Column expressions for hashes, paths and names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK_ENDS = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def clean_hash(hash_: Column | str) -> Column:
    """A hash in lower case without blanks at its ends; null where nothing is left."""
    c = F.col(hash_) if isinstance(hash_, str) else hash_
    return F.nullif(F.lower(F.regexp_replace(c, BLANK_ENDS, "")), F.lit(""))


def clean_path(path: Column | str) -> Column:
    """A path without repeated and trailing slashes; the root stays "/", "" stays ""; null stays null."""
    c = F.col(path) if isinstance(path, str) else path
    return F.regexp_replace(c, "(?<=/)/+|(?<=[^/])/+$", "")


def parent_of(path: Column | str) -> Column:
    """The part before the last slash; an entry of the root has the parent ""."""
    c = F.col(path) if isinstance(path, str) else path
    return F.regexp_replace(c, "/[^/]*$", "")


def base_name(path: Column | str) -> Column:
    return F.substring_index(path, "/", -1)


def extension(name: Column | str) -> Column:
    """Lower-case text after the last dot; "" where there is no dot."""
    c = F.col(name) if isinstance(name, str) else name
    return F.lower(F.regexp_extract(c, r"\.([^.]*)$", 1))


def path_depth(path: Column | str) -> Column:
    c = F.col(path) if isinstance(path, str) else path
    return F.length(c) - F.length(F.replace(c, F.lit("/"), F.lit("")))


def is_under(prefix: Column, path: Column) -> Column:
    """Component-aware prefix test: the path itself or anything below it."""
    return (path == prefix) | F.startswith(path, F.concat(prefix, F.lit("/")))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_fold(c: Column | str) -> Column:
    """Lower case for A to Z only, as SQLite's LIKE folds."""
    return F.translate(c, _UPPER, _UPPER.lower())


def sqlite_like(c: Column | str, pattern: str) -> Column:
    """LIKE that folds only ASCII case, with % and _ as wildcards and no escape character."""
    # chr(1) cannot occur in a path or name, so nothing in the pattern is escaped
    return F.like(ascii_fold(c), F.lit(pattern.translate(str.maketrans(_UPPER, _UPPER.lower()))), F.lit("\x01"))


def holds_text(c: Column | str, text: str) -> Column:
    """LIKE '%text%' ESCAPE '\\': the text as it is, where % and _ stand for themselves; only ASCII case is folded."""
    plain = re.sub(r"([\\%_])", r"\\\1", text).translate(str.maketrans(_UPPER, _UPPER.lower()))
    return F.like(ascii_fold(c), F.lit(f"%{plain}%"), F.lit("\\"))


def week_label(day: Column) -> Column:
    """Year and week as 2024-W05: weeks begin on Monday, days before the first Monday are week 00."""
    week = F.floor((F.dayofyear(day) + 6 - F.weekday(day)) / 7)
    return F.concat(F.date_format(day, "yyyy"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))


def human_size(size: Column | str) -> Column:
    """Bytes as "1.5 KB": base 1024, at most two decimals, trailing zeros cut; null for null."""
    c = F.col(size) if isinstance(size, str) else size
    out = None
    for power, unit in reversed(list(enumerate(["B", "KB", "MB", "GB", "TB", "PB"]))):
        number = F.regexp_replace(F.format_string("%.2f", c / F.lit(float(1024**power))), r"\.?0+$", "")
        text = F.concat(number, F.lit(f" {unit}"))
        out = F.when(F.abs(c) >= 1024**power, text) if out is None else out.when(F.abs(c) >= 1024**power, text)
    return F.when(c.isNull(), F.lit(None).cast("string")).otherwise(out.otherwise(F.lit("0 B")))


def short_path(path: Column | str, keep: int = 3) -> Column:
    """The last `keep` parts of a path, with "…/" before them where something was cut."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > keep, F.concat(F.lit("…/"), F.array_join(F.slice(parts, -keep, keep), "/"))).otherwise(F.col(path) if isinstance(path, str) else path)


def german_number(x: Column) -> Column:
    """Two decimals with a comma; null and not-a-number give "0,00"."""
    ok = x.isNotNull() & ~F.isnan(x.cast("double"))
    return F.when(ok, F.replace(F.format_string("%.2f", x.cast("double")), F.lit("."), F.lit(","))).otherwise(F.lit("0,00"))


def csv_field(c: Column) -> Column:
    """A field for a ;-separated file: quoted where it holds ; or a quote or a line break; null gives ""."""
    quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(c.isNull(), F.lit("")).when(c.rlike('[;"\r\n]'), quoted).otherwise(c)


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9._-]", "_")


def safe_document_name(c: Column) -> Column:
    """As safe_name(), but blanks stay; two dots, and a dot at either end, become "_", and so does a blank or null name."""
    safe = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^A-Za-z0-9._ -]", "_"), r"\.\.", "_")
    safe = F.regexp_replace(F.regexp_replace(safe, r"^\.", "_"), r"\.$", "_")
    return F.when(F.trim(safe) == "", "_").otherwise(safe)


def sql_value(c: Column) -> Column:
    """A text as a value in SQL: NULL for null and blank, otherwise trimmed, in quotes, quotes inside doubled."""
    trimmed = F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.when(c.isNull() | (trimmed == ""), "NULL").otherwise(F.concat(F.lit("'"), F.replace(trimmed, F.lit("'"), F.lit("''")), F.lit("'")))


def setting(c: Column, kind: str, default: bool | int) -> Column:
    """A setting read as "boolean" ("true" and "false" alone) or "bigint"; the default where it is missing or cannot be read."""
    read = F.when(c.isin("true", "false"), c == "true") if kind == "boolean" else c.try_cast(kind)
    return F.coalesce(read, F.lit(default))


def age_days(ts: Column, now: Column) -> Column:
    return (F.unix_timestamp(now) - F.unix_timestamp(ts)) / F.lit(86400.0)
