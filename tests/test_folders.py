import random

from helpers import rows

from arborix.operators.components import star_components
from arborix.operators.folders import duplicate_places, folder_components, folder_groups, group_list, numbered_groups, regrouped


def brute_components(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {n: find(n) for n in root}


def test_components_match_union_find(spark):
    rnd = random.Random(3)
    for edges in (
        [(f"{rnd.randrange(60):03}", f"{rnd.randrange(60):03}") for _ in range(45)],
        [(f"{i:03}", f"{i + 1:03}") for i in range(40)],  # a chain
        [("000", f"{i:03}") for i in range(1, 50)] + [("099", "049")],  # a hub
        [("a", "a"), (None, "b"), ("c", None), ("d", "e"), ("d", "e"), ("e", "d")],
    ):
        got = star_components(spark.createDataFrame(edges, "a string, b string"))
        assert {r["node"]: r["root"] for r in got.collect()} == brute_components(edges)
    assert star_components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_two_folders_with_a_shared_file(make_files):
    files = make_files([("/r/folder-a/dup.txt", "h"), ("/r/folder-b/dup.txt", "h"), ("/r/folder-c/other", "k")])
    places = duplicate_places(files)
    groups = folder_groups(places, folder_components(places))
    want = [("/r/folder-a", "/r/folder-a", "folder-a", 1, 1, 10), ("/r/folder-a", "/r/folder-b", "folder-b", 1, 1, 10)]
    assert rows(groups) == want
    assert rows(folder_groups(places, folder_components(places))) == want
    assert {r["group_name"] for r in numbered_groups(groups).collect()} == {"group_1"}


def test_shared_count_counts_occurrences(make_files):
    # twice in a, once in b: three occurrences are not the number of folders
    files = make_files([("/a/1", "h"), ("/a/2", "h"), ("/b/1", "h"), ("/a/3", "k"), ("/b/3", "k")])
    places = duplicate_places(files)
    assert {r["shared_count"] for r in folder_groups(places, folder_components(places)).collect()} == {1}


def test_group_list_filters(spark):
    g = spark.createDataFrame([("g1", "/x/A", "A", 2, 3, 5), ("g1", "/x/B", "B", 2, 1, 4), ("g2", "/y/C", None, 9, 9, 9)], "group_id string, folder_path string, folder_name string, shared_count long, file_count long, min_size long")
    assert rows(group_list(g)) == [("g1", 2, 2, 4, "A", 4)]
    assert group_list(g, text="b").count() == 1 and group_list(g, text="c").count() == 0
    assert group_list(g, min_size=5).count() == 0 and group_list(g, min_shared=3).count() == 0


def test_incremental_groups_equal_a_full_run(make_files):
    old_files = make_files([("/a/1", "h"), ("/b/1", "h"), ("/c/1", "k"), ("/d/1", "k"), ("/e/1", "z")])
    new_files = make_files([("/a/1", "h"), ("/b/1", "h"), ("/c/1", "k"), ("/d/1", "k"), ("/e/1", "z"), ("/f/1", "k"), ("/f/2", "h"), ("/f/3", "z")])
    old = folder_components(duplicate_places(old_files))
    places = duplicate_places(new_files)
    changed = new_files.filter("parent_path = '/f'").selectExpr("parent_path AS folder")
    assert rows(regrouped(old, places, changed)) == rows(folder_components(places))
