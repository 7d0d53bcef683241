"""Targeted refreshes, incremental walks, paged lists, archives and periodic refreshes."""

import hashlib
import os
import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from arborix.functions import text as T
from arborix.operators import index, logs, neardup, reconcile, snapshots, tree
from arborix.sources import archives, files, sinks
from arborix.streaming.incremental import refresh_every


def test_requests_that_contradict_themselves():
    assert reconcile.resync_request(["/a/b/", " /a/b", "/a/c"], ["/a/d"], "/a") == (["/a/b", "/a/c"], ["/a/d"])
    assert reconcile.resync_request([], [], "/a/") == (["/a"], []) and reconcile.resync_request([], ["/a/x"], "/a") == ([], ["/a/x"])
    for paths, remove in ((["/a/b"], ["/a/b"]), (["/a/b/c"], ["/a/b/"]), ([" "], []), (["/ab"], []), ([], ["/other"])):
        with pytest.raises(ValueError):
            reconcile.resync_request(paths, remove, "/a")


def test_incremental_walk(spark, tmp_path):
    for name in ("a/x.txt", "a/deep/y.txt", "b/z.txt", "c/w.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    root = str(tmp_path)
    stored = files.walk(spark, root).withColumn("traversed", F.lit(True)).cache()
    same = files.rewalk(spark, root, stored)
    assert same.listed.count() == 0 and rows(same.index) == rows(stored.drop("traversed"))
    (tmp_path / "a/deep/new.txt").write_text("new")
    (tmp_path / "c/w.txt").unlink()
    os.rmdir(tmp_path / "c")
    os.utime(tmp_path / "a/deep", (1, 1))
    after = files.rewalk(spark, root, stored)
    assert rows(after.listed) == [(root,), (f"{root}/a/deep",)]
    assert rows(after.index, "path", "hash", "modified") == rows(files.walk(spark, root), "path", "hash", "modified")


def test_hashes_of_whole_files(spark, tmp_path):
    (tmp_path / "big").write_bytes(b"0123456789" * 3000)
    (tmp_path / "small").write_bytes(b"x")
    want = {str(p): hashlib.sha256(p.read_bytes()).hexdigest() for p in tmp_path.iterdir()}
    assert dict(rows(files.full_hashes(spark, str(tmp_path)))) == want
    walked = {r["path"]: r["hash"] for r in files.walk(spark, str(tmp_path)).filter("is_file").collect()}
    assert {r["path"]: r["hash"] for r in files.binary_index(spark, str(tmp_path)).collect()} == walked


def test_pages(spark):
    # inside the test, so that workers get the class itself
    class Numbers(archives.PagedSource):
        ddl = "n long"

        @classmethod
        def name(cls):
            return "arborix_numbers"

        @staticmethod
        def fetch(start, count):
            return [(i,) for i in range(start, start + count) if i != 5]

        @staticmethod
        def probe():
            return 23

    spark.dataSource.register(Numbers)
    want = [(i,) for i in range(23) if i != 5]
    for options in ({"page_size": 4}, {"page_size": 2, "most_partitions": 3}, {"page_size": 100, "total": 23}):
        assert sorted(map(tuple, spark.read.format("arborix_numbers").options(**options).load().collect())) == want
    assert spark.read.format("arborix_numbers").option("total", 0).load().count() == 0


def test_archives_and_their_layout(spark, tmp_path):
    df = spark.createDataFrame([("risk", "list/all", "20240101_000000", "q", "r", None), ("risk", "one", "20240101_000000", None, "s", "d")], "category string, endpoint string, run_stamp string, request string, response string, data string")
    sinks.write_exchanges(df, str(tmp_path / "x"))
    assert (tmp_path / "x/category=risk/endpoint=list_all/run_stamp=20240101_000000/kind=request").is_dir()
    assert spark.read.json(str(tmp_path / "x")).count() == 4
    (tmp_path / "old").mkdir()
    for name in ("20240203_040506_a.json", "20240203_040506_b.json", "other.json"):
        (tmp_path / "old" / name).write_text("{}")
    sinks.relayout(spark, str(tmp_path / "old"), str(tmp_path / "new"))
    assert rows(spark.read.parquet(str(tmp_path / "new")), "name", "run_stamp") == [("20240203_040506_a.json", "20240203_040506"), ("20240203_040506_b.json", "20240203_040506")]


def test_periodic_refresh(spark, tmp_path):
    seen = []
    spark.createDataFrame([(1,), (2,)], "id long").write.parquet(str(tmp_path / "in"))
    q = refresh_every(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), lambda b: seen.append(b.count()), 0, str(tmp_path / "cp"), least=1)
    q.processAllAvailable()
    q.stop()
    assert seen == [2]


def test_texts_as_they_are_written(spark):
    df = spark.createDataFrame([("via rule 'a_b' x",), ("via rule 'axb'",), ("VIA RULE 'A_B'",), ("50% of",), (None,)], "message string")
    assert rows(logs.text_counts(df, ["a_b", "%", "x'"])) == [("x'", 0), ("%", 1), ("a_b", 2)]
    rules = spark.createDataFrame([("a_b",), ("a_b",), ("none",), (None,)], "rule string")
    assert rows(logs.rule_events(df, rules)) == [("a_b", 2), ("none", 0)]
    assert logs.text_counts(df, []).count() == 0


def test_names_and_settings(spark):
    names = spark.createDataFrame([(4, "b"), (9, "x")], "id long, name string")
    assert rows(index.name_dictionary(names, spark.createDataFrame([("c",), ("a",), ("x",), ("a",), (None,)], "name string"))) == [(10, "a"), (11, "c"), (4, "b"), (9, "x")]
    assert rows(index.name_dictionary(names.limit(0), names.limit(0).select("name"))) == []
    df = spark.createDataFrame([("true", "7"), ("TRUE", "x"), (None, None)], "a string, b string")
    assert rows(df.select(T.setting(F.col("a"), "boolean", False), T.setting(F.col("b"), "bigint", 3))) == [(False, 3), (False, 3), (True, 7)]
    kept = snapshots.set_settings(spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string"), spark.createDataFrame([("b", "3"), ("b", "4"), (None, "5"), ("c", None)], "key string, value string"))
    assert rows(kept) == [("a", "1"), ("b", "4"), ("c", None)]
    assert rows(df.select(T.safe_document_name(F.lit("..a b/c.")), T.sql_value(F.lit(" it's ")), T.sql_value(F.lit(" ")))) == [("_a b_c_", "'it''s'", "NULL")] * 3


def test_copies_are_never_compared(spark):
    tokens = spark.createDataFrame([(f"/f{i}", t) for i in range(30) for t in "abcde"] + [("/g", t) for t in "abcd"], "folder string, token string")
    found = neardup.folder_classes(tokens)
    pairs = neardup.class_pairs(found.classes)
    assert rows(pairs) == [("/f0", "/g", 0.8, 4, 5)]
    assert rows(neardup.folder_links(found, pairs)) == sorted([(f"/f{i}", "/f0", 30) for i in range(30)] + [("/g", "/g", 30)])
    assert neardup.exact_pairs(tokens).count() == 30 * 29 // 2 + 30


def test_subtrees_with_rings_and_several_parents(spark):
    rnd = random.Random(3)
    for several in (False, True):
        edges = [(f"p{i}", f"p{rnd.randrange(40)}") for i in range(40)] + [("p40", None)]
        edges += [(f"p{rnd.randrange(40)}", f"p{rnd.randrange(40)}") for _ in range(20)] if several else edges[:5]
        roots = ["p1", "p2", "p2", "away", None]
        want = {r for r in roots if r}
        while more := {p for p, parent in edges if parent in want} - want:
            want |= more
        df = spark.createDataFrame(edges, "path string, parent_path string")
        assert rows(tree.subtree(df, spark.createDataFrame([(r,) for r in roots], "path string"))) == sorted((p,) for p in want)
    chain = spark.createDataFrame([(f"/{i}", f"/{i - 1}") for i in range(1, 26)], "path string, parent_path string")
    assert tree.subtree(chain, spark.createDataFrame([("/0",)], "path string")).count() == 26
