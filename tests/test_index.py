import pytest
from helpers import rows

from arborix.operators import duplicates as D
from arborix.operators import index as I
from arborix.operators import tree

TREE = {
    "": "file-a file-b",
    "/folder-a": "file-a-1 file-a-2",
    "/folder-b": "file-b-1",
    "/folder-c": "file-a-1 file-c-1 file-c-2 file-c-3",
    "/folder-c/folder-d": "",
    "/folder-c/folder-d/folder-a": "file-a-1 file-a-2",
    "/folder-c/folder-d/folder-b": "file-b-1",
    "/folder-e": "",
    "/folder-e/folder-a": "file-a-1 file-a-2",
    "/folder-e/folder-b": "file-b-1",
    "/folder-e/folder-c": "file-c-1 file-c-2",
    "/folder-f": "file-a file-b file-f",
}


@pytest.fixture(scope="module")
def sample(make_files):
    entries = [(f"/root{d}", None) for d in TREE] + [(f"/root{d}/{n}", n) for d, names in TREE.items() for n in names.split()]
    return I.current_index(make_files(entries)).cache()


def test_tree_counts(sample):
    assert (sample.count(), sample.filter("is_directory").count(), sample.filter("is_file").count()) == (32, 12, 20)


@pytest.mark.parametrize(
    ("text", "pattern", "target", "n"),
    [("file-a", "exact", "files", 2), ("folder-c", "exact", "folders", 2), ("file-c", "starts", "files", 5), ("a-1", "ends", "files", 4), ("b-1", "contains", "files", 3), ("folder", "contains", "files", 0), ("file", "contains", "folders", 0), ("FILE-A", "exact", "both", 2)],
)
def test_search(sample, text, pattern, target, n):
    assert I.search(sample, text, pattern, target).count() == n


def test_removing_a_subtree(sample, spark):
    from arborix.operators.reconcile import without_subtrees

    left = without_subtrees(sample, spark.createDataFrame([("/root/folder-c",)], "path string"))
    assert (left.filter("is_directory").count(), left.filter("is_file").count()) == (8, 13)
    assert without_subtrees(sample, spark.createDataFrame([("/nowhere",), (None,)], "path string")).count() == 32


def test_links_count_for_files_and_folders_but_not_for_both(make_files):
    files = make_files([("/a/f", "h"), {"path": "/a/l", "hash": "h", "is_directory": False, "is_file": False, "is_symlink": True}, ("/a/d", None)])
    assert [I.search(files, "", "contains", t).count() for t in ("files", "folders", "both")] == [2, 2, 2]


def test_current_index_takes_the_latest_and_skips_rows_without_a_path(make_files):
    files = make_files([{"path": "/a", "hash": "OLD", "id": 1}, {"path": "/a", "hash": " New ", "id": 9}, {"path": "/a", "hash": " New ", "id": 9}, {"path": None, "hash": "x", "id": 3, "is_directory": False}, {"path": "/b", "hash": "", "id": None, "is_directory": False}])
    assert rows(I.current_index(files), "path", "hash", "id") == [("/a", "new", 9), ("/b", None, None)]
    assert I.current_index(files.limit(0)).count() == 0


def test_pages_and_orders(sample):
    names = [r["name"] for r in I.page(I.ordered(sample, "name", False, ["path"]), 2, 5).collect()]
    assert names == sorted(r["name"] for r in sample.collect())[5:10]
    assert len(I.page(I.ordered(sample, "nonsense", True, ["path"]), 0, 500, 10).collect()) == 10
    assert [r["path"] for r in I.listing(sample).limit(2).collect()] == ["/root/file-a", "/root/file-b"]


def test_duplicates_of_the_tree(sample):
    assert D.duplicate_hashes(sample).count() == 7
    assert D.duplicate_files(sample).count() == 18
    stats = D.duplicate_stats(sample).first()
    assert (stats["duplicates"], stats["groups"], stats["wasted_bytes"]) == (18, 7, 110)
    assert D.duplicate_stats(sample, "is_directory").first()["duplicates"] == 0
    assert D.filtered_groups(sample, "FOLDER-F", 5, None).count() == 2
    assert D.filtered_groups(sample, extensions=["nope"]).count() == 0


@pytest.mark.parametrize(("contents", "n"), [("abc", 0), ("aaa", 3), ("aab", 2), ("", 0)])
def test_duplicate_files(make_files, contents, n):
    assert D.duplicate_files(make_files([(f"/d/{i}", c) for i, c in enumerate(contents)])).count() == n


def test_flags_and_children(sample):
    flagged = {r["name"] for r in tree.duplicate_flags(sample, "/root").collect()}
    assert flagged == {"file-a", "file-b", "folder-a", "folder-b", "folder-c", "folder-e", "folder-f"}
    first = tree.children(sample, "/root").first()
    assert first["is_directory"] and first["name"] == "folder-a"
    assert rows(tree.leaf_directory_sizes(sample), "parent_path", "size")[0] == ("/root/folder-a", 20)
    assert {r["folder"]: r["duplicates"] for r in tree.folders_with_duplicates(sample).collect()}["/root"] == 18


def test_flags_do_not_leak_to_siblings_with_the_same_beginning(make_files):
    files = make_files([("/a/b/x", "h"), ("/a/bcd/x", "k"), ("/a/bcd/y", "k")])
    assert tree.duplicate_flags(files, "/a/b").count() == 0


def test_common_root(spark):
    df = spark.createDataFrame([("g", "/a/b/c"), ("g", "/a/b"), ("g", "/a/bx"), ("h", "/q/r"), (None, "/z")], "g string, p string")
    assert rows(tree.common_root(df, "g", "p")) == [("g", "/a"), ("h", "/q/r"), (None, "/z")]


def test_common_root_of_siblings_that_sort_before_a_slash(spark):
    df = spark.createDataFrame([("g", "/x/photos"), ("g", "/x/photos-2"), ("g", "/x/photos/a"), ("h", "/y/a/b"), ("h", "/y/a (copy)"), ("h", "/y/a"), ("i", None)], "g string, p string")
    assert rows(tree.common_root(df, "g", "p")) == [("g", "/x"), ("h", "/y"), ("i", None)]


@pytest.mark.parametrize(("order", "key"), [("folded", lambda r: (r["name"].lower(), r["name"], r["path"])), ("cased", lambda r: (r["name"], r["path"])), ("default", lambda r: (r["is_directory"], r["is_file"], r["is_symlink"], r["path"]))])
def test_positions_number_the_whole_listing(sample, order, key):
    want = [(i, r["path"]) for i, r in enumerate(sorted(sample.collect(), key=key), 1)]
    assert rows(I.positions(I.listing(sample.repartition(7), order).select("path")), "position", "path") == sorted(want, key=repr)
    assert I.positions(I.listing(sample.limit(0), order)).count() == 0


def test_whole_listings_are_queries():
    import __spark_entry__

    assert {f"listing_{order}_all" for order in ("folded", "cased", "default")} <= __spark_entry__.oracle_sql().keys()
