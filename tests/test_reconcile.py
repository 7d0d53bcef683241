from datetime import datetime

import pytest
from helpers import rows
from pyspark.sql import functions as F

from arborix.operators import dashboard, logs, merge, reconcile, snapshots


def test_upsert(make_files):
    old = make_files([{"path": "/a", "hash": "1", "traversed": True}, {"path": "/d", "hash": None}, ("/gone", "9")])
    new = make_files([("/a", "2"), {"path": "/d", "hash": None, "modified": 5.0}, ("/n", "3")])
    got = reconcile.upsert(old, new)
    assert rows(got, "path", "hash", "traversed", "inserted", "hash_updated") == [("/a", "2", True, False, True), ("/d", None, False, False, False), ("/gone", "9", False, False, False), ("/n", "3", False, True, False)]


def test_insert_or_ignore(spark):
    s = spark.createDataFrame([("a", 1)], "k string, v int")
    n = spark.createDataFrame([("a", 2), ("b", 3), ("b", 2), (None, 1)], "k string, v int")
    assert rows(reconcile.insert_or_ignore(s, n, "k")) == [("a", 1), ("b", 2)]


def test_stale_children_and_marks(make_files, spark):
    stored = make_files([("/f/x", "1"), ("/f/y", "2"), ("/g/z", "3"), ("/e/q", "4")])
    listed = spark.createDataFrame([("/f", "/f/x"), ("/e", None)], "parent_path string, path string")
    assert rows(reconcile.stale_children(stored, listed), "path") == [("/e/q",), ("/f/y",)]
    out = reconcile.marked(make_files([("/d", None), ("/e", None), ("/u", None)]), spark.createDataFrame([("/d", 7.0, None), ("/e", 8.0, "denied")], "path string, modified double, error string"))
    assert rows(out, "path", "traversed", "modified", "traverse_error") == [("/d", True, 7.0, None), ("/e", False, 1.7e9, "denied"), ("/u", False, 1.7e9, None)]


def test_walk_plan(spark):
    stored = spark.createDataFrame([("/same", 1.0, True, None), ("/new-time", 1.0, True, None), ("/gone", 1.0, True, None), ("/failed", 1.0, False, "x"), ("/open", 1.0, False, None)], "path string, modified double, traversed boolean, traverse_error string")
    disk = spark.createDataFrame([("/same", 1.0), ("/new-time", 2.0), ("/failed", 1.0), ("/open", 1.0), ("/fresh", 1.0)], "path string, modified double")
    assert dict(rows(reconcile.walk_plan(stored, disk))) == {"/same": "skip", "/new-time": "read", "/gone": "purge", "/failed": "skip", "/open": "read", "/fresh": "read"}


def test_added_hashes_are_never_removed(make_files, spark):
    index = make_files([("/a", "1"), ("/b", "1"), ("/c", "2")])
    h = lambda *x: spark.createDataFrame([(v,) for v in x], "hash string")
    assert rows(reconcile.added_hashes(h("old", None), index, h("1", "2", "2"))) == [("1",), ("old",)]


def test_ignore_rules(make_files, spark):
    index = make_files([("/p/node_modules", None), ("/p/package.json", "1"), ("/q/node_modules", None), ("/p/bin", None), ("/p/x.csproj", "2"), ("/p/dist", None)])
    rules = reconcile.parsed_rules(spark.createDataFrame([("node_modules:package.json",), ("bin:*.csproj",), (" dist ",), ("",), (None,)], "line string"))
    assert rows(reconcile.ignored_folders(index, rules), "path") == [("/p/dist",), ("/p/node_modules",)]


def test_totals_and_timeline(make_files):
    files = make_files([{"path": "/a", "hash": "1", "size": 5, "modified": 0.0}, {"path": "/b", "hash": "1", "size": None, "modified": 86400.0}, {"path": "/d", "hash": None, "modified": None}, {"path": "/far", "hash": "2", "size": 1, "modified": 1.6e12}])
    assert tuple(dashboard.totals(files).first()) == (3, 1, 6)
    assert tuple(dashboard.totals(files.limit(0)).first()) == (0, 0, 0)
    line = {(r[0], r[1]): tuple(r)[2:] for r in dashboard.running_size(dashboard.timeline(files)).collect()}
    assert line[("day", "1970-01-01")] == (1, 0, 5, 5) and line[("day", "1970-01-02")] == (1, 0, 0, 5) and line[("year", "1970")] == (2, 0, 5, 5)
    row = dashboard.dashboard(files, 1, 0.0).first()
    assert (row["duplicate_files"], row["wasted_bytes"], row["entries_behind"], row["next_refresh"]) == (2, 5, 3, 0.0)


def test_logs(spark):
    df = spark.createDataFrame([("INFO", "Indexed '/a/b' (3)"), ("INFO", "Ignored via rule 'lib'"), ("ERROR", "boom"), (None, None)], "level string, message string").withColumn("timestamp", F.lit(1))
    assert logs.filtered_logs(df, "all", "INDEXED*").count() == 1 and logs.filtered_logs(df, "ERROR", "boom").count() == 1 and logs.filtered_logs(df, "ERROR", "BOOM").count() == 0
    assert rows(logs.indexed_paths(df)) == [("/a/b", 1)]
    assert rows(logs.rule_events(df, spark.createDataFrame([("lib",), ("x",)], "rule string"))) == [("lib", 1), ("x", 0)]
    docs = spark.createDataFrame([(1, "x\n[1700000000] WARN Skipped '/q'\n[1] INFO no"), (2, None), (3, "")], "doc_id long, text string")
    assert rows(logs.lines_of(docs)) == [(1, 1700000000, "WARN", "Skipped '/q'")]
    skipped = spark.createDataFrame([("/A/x", "denied"), ("/b", None)], "path string, error string")
    assert logs.skipped(skipped, " a/X ").count() == 1 and logs.skipped(skipped, "DENIED", "path").count() == 0 and logs.skipped(skipped, " ").count() == 2


def test_merge(make_files):
    files = make_files([("/a/1", "h"), ("/a/2", "h"), ("/b/1", "h"), ("/b/u", "u"), {"path": "/b/n", "hash": None, "is_directory": False}]).selectExpr("'g' AS g", "parent_path AS folder", "name", "path", "hash", "size")
    plan = merge.merge_plan(files, ["g"])
    assert dict(rows(plan, "path", "action")) == {"/a/1": "keep", "/a/2": "remove", "/b/1": "remove", "/b/u": "keep", "/b/n": "keep"}
    assert rows(merge.merge_stats(plan, ["g"])) == [("g", 3, 2, 20)]
    assert merge.merged_tree(plan, ["g"]).count() == 3


def test_snapshots(spark):
    df = spark.createDataFrame([(1, 10, "x"), (1, 12, "y"), (2, 11, None), (None, 99, "z")], "key int, id int, v string")
    assert rows(snapshots.latest(df, "key", ["id"])) == [(1, 12, "y"), (2, 11, None)]
    who = spark.createDataFrame([(1,), (3,)], "key int")
    assert rows(snapshots.with_latest(who, df, "key", "key", ["id"], ["v"])) == [(1, "y"), (3, None)]
    assert rows(snapshots.removed(df, who, "key")) == [(2,), (None,)]
    a, b = (snapshots.signature(d, F.col("key")).first() for d in (df, df.orderBy(F.desc("id"))))
    assert a == b and a["keys"] == 2
    assert snapshots.signature(df.limit(0), F.col("key")).first()["keys"] == 0


def test_ranges(spark):
    assert snapshots.parse_ranges("1014, 1100-1200") == [(1014, 1014), (1100, 1200)]
    with pytest.raises(ValueError):
        snapshots.parse_ranges("12-x")
    df = spark.range(20)
    assert [r["id"] for r in snapshots.in_ranges(df, "id", "1,3-5,4-6").orderBy("id").collect()] == [1, 3, 4, 5, 6]
    assert snapshots.in_ranges(df, "id", "").count() == 0


def test_newest_document_and_merged_state(spark):
    docs = spark.createDataFrame([("a.CSV", "2024-01-02 00:00:00"), ("b.csv", "nonsense"), ("c.pdf", "2025-01-01 00:00:00"), ("d.csv", "2024-01-01 00:00:00")], "name string, created string")
    assert snapshots.newest_document(docs, ".csv").first()["name"] == "a.CSV"
    stored = spark.createDataFrame([(1, "old", "done")], "id int, name string, status string")
    listed = spark.createDataFrame([(1, "new"), (2, "two")], "id int, name string")
    assert rows(snapshots.merged_state(stored, listed, "id", ["status"], {"status": F.lit("pending")})) == [(1, "new", "done"), (2, "two", "pending")]


def test_age(spark):
    from arborix.functions.text import age_days

    df = spark.createDataFrame([(datetime(2024, 1, 1), datetime(2024, 1, 8, 12))], "a timestamp, b timestamp")
    assert df.select(age_days(F.col("a"), F.col("b"))).first()[0] == 7.5


def test_inspecting_histories_and_list_gaps(spark):
    df = spark.createDataFrame([(3, "ok"), (1, "ok"), (2, "failed"), (4, None)], "id int, status string")
    ids = lambda d: [r["id"] for r in d.collect()]
    assert ids(snapshots.inspected(df)) == [1, 2, 3, 4] == ids(snapshots.inspected(df, only=0, status="", limit=0))
    assert ids(snapshots.inspected(df, status="ok")) == [1, 3] and ids(snapshots.inspected(df, status="ok", limit=1)) == [1]
    assert ids(snapshots.inspected(df, only=2)) == [2] and ids(snapshots.inspected(df, only=2, status="ok")) == []
    shots = spark.createDataFrame([(1, 7), (3, 7), (2, 8), (5, 7)], "id int, account int")
    assert ids(snapshots.history(shots, "account", 7)) == [5, 3, 1] and ids(snapshots.history(shots, "account", 9)) == []
    assert ids(snapshots.list_delta(df.filter("id <= 2"), df, ["id"])) == [3, 4]
    assert ids(snapshots.list_delta(df.limit(0), df, ["id"])) == [1, 2, 3, 4] and ids(snapshots.list_delta(df, df.limit(3), ["id"])) == []
