"""Files and folders as DataFrames."""

from __future__ import annotations

import hashlib
import os
import stat as stat_module
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborix.operators.index import ordered
from arborix.operators.reconcile import walk_plan
from arborix.runtime import materialize

SAMPLE = 4096
ENTRY = "path string, name string, size long, modified double, hash string, is_directory boolean, is_file boolean, is_symlink boolean, parent_path string, traverse_error string"

# Media types by extension; texts are the extensions read as such.
TEXT_EXTENSIONS = (
    "txt log csv tsv conf rs py js ts jsx tsx java c cpp h hpp go rb php swift kt scala sh bash zsh fish ps1 bat cmd sql r lua perl pl "
    "html htm css scss less xml json yaml yml toml ini cfg md rst tex vue svelte"
).split()
MEDIA_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml", "webp": "image/webp", "bmp": "image/bmp", "ico": "image/x-icon", "pdf": "application/pdf"}
# Sets of extensions by kind of content.
FILE_KINDS = {
    "photo_album": "jpg jpeg png gif bmp webp tiff tif heic heif raw cr2 nef arw dng".split(),
    "documents": "pdf doc docx xls xlsx ppt pptx txt rtf odt ods csv".split(),
    "video": "mp4 mkv avi mov wmv flv webm m4v mpg mpeg".split(),
    "audio": "mp3 wav flac aac ogg m4a wma opus".split(),
    "code": "js ts jsx tsx py rb go rs java c cpp h hpp cs php html css scss json xml yaml yml toml sh md sql".split(),
    "config": "json yaml yml toml ini cfg conf env xml".split(),
}


def media_type(extension: Column) -> Column:
    out = F.when(extension.isin(TEXT_EXTENSIONS), F.lit("text/plain; charset=utf-8"))
    for ext, kind in MEDIA_TYPES.items():
        out = out.when(extension == ext, F.lit(kind))
    return out.otherwise(F.lit("application/octet-stream"))


def check_folder(path: str) -> str:
    """An absolute, existing folder without a trailing slash, or a ValueError."""
    if not path or not path.strip():
        raise ValueError("the path is empty")
    if not path.startswith("/"):
        raise ValueError(f"not an absolute path: {path}")
    path = path.rstrip("/") or "/"
    if not os.path.isdir(path):
        raise ValueError(f"no such folder: {path}")
    return path


def check_inside(path: str, allowed: str) -> str:
    """The path, if it is the allowed folder or below it, part by part; otherwise a ValueError."""
    full, root = os.path.realpath(path), os.path.realpath(allowed)
    if os.path.commonpath([full, root]) != root:
        raise ValueError(f"{path} is not below {allowed}")
    return full


def sampled_sha256(size: Column, head: Column, tail: Column) -> Column:
    """SHA-256 over the size as eight little-endian bytes, the first 4096 bytes, and the last 4096 of longer files."""
    little = F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.lpad(F.hex(size), 16, "0"), F.lit("(..)"), F.lit(1))), ""))
    return F.sha2(F.concat(little, head, F.when(size > SAMPLE, tail).otherwise(F.lit(b""))), 256)


def _hash_file(path: str, size: int) -> str:
    digest = hashlib.sha256(size.to_bytes(8, "little"))
    if size:
        with open(path, "rb") as f:
            digest.update(f.read(SAMPLE))
            if size > SAMPLE:
                f.seek(size - SAMPLE)
                digest.update(f.read(SAMPLE))
    return digest.hexdigest()


def _list(folders: list[str], hashed: bool) -> Iterator[tuple]:
    for folder in folders:
        try:
            entries = list(os.scandir(folder))
        except OSError as e:
            yield (folder, None, None, None, None, None, None, None, None, str(e))
            continue
        for e in entries:
            try:
                s = e.stat(follow_symlinks=False)
                link, directory = e.is_symlink(), stat_module.S_ISDIR(s.st_mode)
                # a link to a file has the hash of the file it leads to
                target = os.stat(e.path) if link and os.path.exists(e.path) else s
                content = hashed and stat_module.S_ISREG(target.st_mode)
                digest = _hash_file(e.path, target.st_size) if content else None
                yield (e.path, e.name, s.st_size, s.st_mtime, digest, directory, e.is_file(follow_symlinks=False), link, folder, None)
            except OSError as x:
                yield (e.path, e.name, None, None, None, None, None, None, folder, str(x))


def list_folders(folders: DataFrame, hashed: bool = True) -> DataFrame:
    """Direct entries of the folders in column path, listed by the executors; hashes read at most 8 KiB a file.

    An unreadable folder gives one row with traverse_error and no parent_path, an unreadable entry a row with the error.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ENTRY.split(", ")]
        for f in frames:
            out = pd.DataFrame(list(_list(f["path"].tolist(), hashed)), columns=names, dtype=object)
            out["size"] = out["size"].astype("Int64")
            out["modified"] = out["modified"].astype("Float64")
            yield out

    return folders.select("path").mapInPandas(run, ENTRY)


def _root_entry(spark: SparkSession, root: str) -> DataFrame:
    s = os.stat(root)
    return spark.createDataFrame([(root, os.path.basename(root) or "/", s.st_size, s.st_mtime, None, True, False, False, None, None)], ENTRY)


def walk(spark: SparkSession, root: str, hashed: bool = True) -> DataFrame:
    """The whole tree below root, level by level, each level listed by all executors: the root's entry and all others.

    Links are not followed, so every level lies deeper and the walk ends.
    """
    root = check_folder(root)
    tree = level = _root_entry(spark, root)
    while True:
        folders = level.filter("is_directory AND traverse_error IS NULL").select("path")
        level = materialize(list_folders(folders.repartition(spark.sparkContext.defaultParallelism, "path"), hashed), "walk")
        tree = tree.unionByName(level)
        if level.filter("is_directory").isEmpty():
            return tree


class Rewalk(NamedTuple):
    #: the index after the walk: unchanged rows as stored, others as listed
    index: DataFrame
    #: folders whose entries were listed: path
    listed: DataFrame


def rewalk(spark: SparkSession, root: str, stored: DataFrame, hashed: bool = True) -> Rewalk:
    """The tree below root after an incremental walk: only folders that are new or have another time are listed again.

    stored is an index (ENTRY columns, traversed) of an earlier walk. A folder handled before and unchanged keeps its
    stored entries, and its stored subfolders are looked at in turn, because a folder's time says nothing about what lies
    below its entries. Entries that are gone do not come out, nor does anything below them.
    """
    root = check_folder(root)
    names = [c.split()[0] for c in ENTRY.split(", ")]
    kept = stored.select(*names, "traversed")
    tree = level = _root_entry(spark, root)
    listed = None
    while True:
        plan = walk_plan(kept.filter("is_directory"), level.filter("is_directory AND traverse_error IS NULL").select("path", "modified"))
        plan = materialize(plan.filter("action <> 'purge'"), "walk-plan")
        read, skip = (plan.filter(F.col("action") == a).select("path") for a in ("read", "skip"))
        fresh = list_folders(read.repartition(spark.sparkContext.defaultParallelism, "path"), hashed)
        # the entries of an unchanged folder are as stored, but its subfolders have times of their own
        same = kept.drop("traversed").join(skip.withColumnRenamed("path", "parent_path"), "parent_path", "left_semi").select(*names)
        level = materialize(fresh.unionByName(_restated(same)), "walk")
        tree = tree.unionByName(level)
        listed = read if listed is None else listed.unionByName(read)
        if level.filter("is_directory").isEmpty():
            return Rewalk(tree, listed)


def _restated(entries: DataFrame) -> DataFrame:
    """Stored entries with the times their folders have now; folders that are gone are left out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keep, times = [], []
            for path, folder, modified in zip(f["path"].tolist(), f["is_directory"].tolist(), f["modified"].tolist(), strict=True):
                try:
                    times.append(os.stat(path, follow_symlinks=False).st_mtime if folder else modified)
                    keep.append(True)
                except OSError:
                    times.append(None)
                    keep.append(False)
            f = f.assign(modified=times)
            yield f[keep]

    return entries.mapInPandas(run, ENTRY)


def folder_entries(spark: SparkSession, path: str, order: str = "name", descending: bool = False) -> DataFrame:
    """One folder's entries, by name in lower case unless another order is asked for."""
    rows = list_folders(spark.createDataFrame([(check_folder(path),)], "path string"), hashed=False).filter("traverse_error IS NULL")
    return rows.orderBy(F.lower("name"), "name") if order == "name" and not descending else ordered(rows, order, descending, ["path"])


def listed_binaries(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder of any file system Spark lists, without their content: path, name, size, modified.

    Spark's source leaves out files of no bytes; walk() lists them.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    plain = F.regexp_replace("path", "^[a-z]+:/+", "/")
    return raw.select(plain.alias("path"), F.substring_index(plain, "/", -1).alias("name"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").cast("double").alias("modified"))


def _with_hash(files: DataFrame, digest: Callable[[str, int], str]) -> DataFrame:
    """files with the hash of each, read where the executors see the path; null where it cannot be read."""
    schema = T.StructType([*files.schema.fields, T.StructField("hash", T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for path, size in zip(f["path"].tolist(), f["size"].tolist(), strict=True):
                try:
                    out.append(digest(path, int(size)))
                except OSError:
                    out.append(None)
            yield f.assign(hash=pd.Series(out, dtype=object, index=f.index))

    return files.mapInPandas(run, schema)


def binary_index(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder with their sampled hashes: two seeks and at most 8 KiB a file, of any size."""
    return _with_hash(listed_binaries(spark, path), _hash_file)


def full_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path and SHA-256 of the whole content, read in pieces, so that a file of any size fits."""
    return _with_hash(listed_binaries(spark, path), _hash_whole).select("path", "hash")


def _hash_whole(path: str, size: int) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def file_content(spark: SparkSession, path: str, allowed: str) -> DataFrame:
    """One file below an allowed folder: path, size, modified, media type, whether it is text, its text or bytes."""
    full = check_inside(path, allowed)
    ext = F.lower(F.regexp_extract(F.lit(os.path.basename(full)), r"\.([^.]*)$", 1))
    raw = spark.read.format("binaryFile").load(full)
    kind = media_type(ext)
    return raw.select(F.lit(full).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), kind.alias("media_type"), F.startswith(kind, F.lit("text/")).alias("is_text"), F.when(F.startswith(kind, F.lit("text/")), F.decode("content", "UTF-8")).alias("text"), "content")
