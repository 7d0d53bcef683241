import random

import pytest
from helpers import rows

from arborix.operators import neardup as N


@pytest.fixture
def tokens(spark):
    def build(**folders):
        return spark.createDataFrame([(p, str(t)) for p, ts in folders.items() for t in set(ts)], "folder string, token string")

    return build


def span(*ends):
    return [x for a, b in zip(ends[::2], ends[1::2], strict=True) for x in range(a, b)]


CASES = [
    ({"/a": span(0, 95, 10000, 10005), "/b": span(0, 95, 20000, 20005), "/c": span(30000, 30100)}, [("/a", "/b", 95 / 105)]),
    ({"/a": span(0, 100), "/b": span(0, 92, 200, 213)}, [("/a", "/b", 92 / 113)]),
    ({"/a": span(0, 100), "/b": span(75, 175)}, []),
]


@pytest.mark.parametrize(("folders", "want"), CASES)
def test_exact_pairs(tokens, folders, want):
    assert rows(N.exact_pairs(tokens(**folders)), "folder_a", "folder_b", "similarity") == want


def test_min_files(tokens):
    t = tokens(**{"/a": [1, 2], "/b": [1, 2]})
    assert N.exact_pairs(t, min_files=3).count() == 0 and N.exact_pairs(t).count() == 1


def test_sketched_pairs(tokens):
    t = tokens(**{"/a": span(0, 90, 90, 100), "/b": span(0, 90, 500, 510), "/c": span(900, 1000)})
    got = N.sketched_pairs(t, bands=16)
    assert rows(got, "folder_a", "folder_b", "shared_files") == [("/a", "/b", 90)]


def shuffled(spark, df):
    """The rows of df, and the records that all stages shuffle until they are counted where nothing is broadcast."""
    sc, quantiles = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def total():
        sc.listenerBus().waitUntilEmpty()
        stages = sc.statusStore().stageList(None, False, False, quantiles, None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    broadcast, before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), total()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return df().count(), total() - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)


def test_sketched_pairs_of_alike_folders_are_not_spread(tokens, spark):
    """Folders with frequent files in common crowd the bands, copies even more; neither may be shuffled as pairs."""
    alike = {f"/a{i}": [0, 1, 2, 3, 100 + i, 1000 + i] for i in range(400)}
    copies = {f"/c{i}": [4, 5, 6, 7, 8] for i in range(400)}
    found, records = shuffled(spark, lambda: N.sketched_pairs(tokens(**alike, **copies)))
    assert found == 400 * 399 // 2
    assert records < 60 * 800


def test_sketched_pairs_of_small_folders_are_never_missed(tokens):
    t = tokens(**{f"/{k}{i}": span(10 * i, 10 * i + n) for i in range(20) for k, n in (("a", 4), ("b", 5))})
    assert N.sketched_pairs(t, bands=1).count() == 20


@pytest.mark.parametrize("crowded", [1, 10**6])
def test_sketched_pairs_match_exact_ones(tokens, monkeypatch, crowded):
    monkeypatch.setattr(N, "CROWDED", crowded)
    rnd = random.Random(8)
    folders = {}
    for i in range(60):
        base = rnd.sample(range(9), rnd.randrange(2, 6)) + [rnd.randrange(9, 60) for _ in range(rnd.randrange(0, 12))]
        folders |= {f"/f{i}": base, f"/g{i}": base[:-1] if len(base) > 3 else base, f"/h{i}": [*base, 1000 + i]}
    t = tokens(**folders)
    for limit in (0.8, 1.0):
        assert rows(N.sketched_pairs(t, limit)) == rows(N.exact_pairs(t, limit)) != []


def test_exact_pairs_match_brute_force(tokens):
    rnd = random.Random(5)
    base = [[rnd.randrange(40) for _ in range(rnd.randrange(1, 14))] for _ in range(25)]
    folders = {f"/f{i}": {*s} for i, s in enumerate(base + [s[:-1] + [99] for s in base] + base[:5])}
    want = sorted(
        ((a, b, len(folders[a] & folders[b]) / len(folders[a] | folders[b])) for a in folders for b in folders if a < b and len(folders[a]) > 1 and len(folders[b]) > 1 and len(folders[a] & folders[b]) >= 0.5 * len(folders[a] | folders[b])), key=repr
    )
    assert rows(N.exact_pairs(tokens(**folders), 0.5), "folder_a", "folder_b", "similarity") == want


SRC = {"/src/proj": span(0, 50), "/dst/proj": span(0, 50), "/src/proj/sub": span(100, 110), "/dst/proj/sub": span(100, 110)}


def collapse(t):
    return rows(N.collapsed(N.exact_pairs(t), t), "folder_a", "folder_b", "shared_files")


def test_collapse_to_the_parents(tokens):
    assert collapse(tokens(**SRC)) == [("/dst/proj", "/src/proj", 50)]
    assert N.exact_pairs(tokens(**SRC)).count() == 2


def test_no_collapse_when_parents_differ(tokens):
    assert collapse(tokens(**(SRC | {"/src/proj": span(0, 90), "/dst/proj": span(40, 130)}))) == [("/dst/proj/sub", "/src/proj/sub", 10)]


def test_collapse_of_many_children(tokens):
    tree = {f"/{r}/tree{s}": t for r in ("src", "dst") for s, t in (("", span(0, 30)), ("/s1", span(50, 60)), ("/s2", span(70, 80)))}
    assert collapse(tokens(**tree)) == [("/dst/tree", "/src/tree", 30)]


def test_collapse_of_trees_deeper_than_64_levels(tokens):
    t = tokens(**{f"/{r}" + "/d" * i: span(10 * i, 10 * i + 5) for r in ("dst", "src") for i in range(67)})
    deepest = N.exact_pairs(t).filter("length(folder_a) = 4 + 2 * 66")
    assert rows(N.collapsed(deepest, t), "folder_a", "folder_b", "shared_files") == [("/dst", "/src", 5)]


def test_collapse_ends_at_paths_without_a_slash(tokens):
    assert collapse(tokens(**{"a": span(0, 9), "b": span(0, 9), "c/x": span(20, 29), "d/x": span(20, 29), "c": span(40, 49), "d": span(40, 49)})) == [("a", "b", 9), ("c", "d", 9)]


def test_tokens_skip_noise_empty_files_and_links(make_files):
    files = make_files([("/a/x", "h"), ("/a/.DS_Store", "n"), {"path": "/a/e", "hash": "q", "size": 0}, {"path": "/a/l", "hash": "l", "is_file": False, "is_directory": False, "is_symlink": True}, {"path": "/a/none", "hash": None, "is_directory": False}, ("/a/y", "h"), ("/top", "t")])
    assert rows(N.folder_tokens(files)) == [("/a", "h")]


def test_delta(make_files, spark):
    files = make_files([("/a/same", "1"), ("/b/same", "1"), ("/a/chg", "2"), ("/b/chg", "3"), ("/a/onlya", "4"), ("/b/onlyb", "5"), {"path": "/a/nohash", "hash": None, "is_directory": False}, {"path": "/b/nohash", "hash": None, "is_directory": False}])
    d = N.deltas(spark.createDataFrame([("/a", "/b"), ("/a", "/b")], "folder_a string, folder_b string"), files)
    assert rows(d, "name", "status", "hash") == [("chg", "changed", "2 → 3"), ("nohash", "identical", ""), ("onlya", "only_a", "4"), ("onlyb", "only_b", "5"), ("same", "identical", "1")]
    assert rows(N.delta_summary(d)) == [("/a", "/b", 1, 1, 1, 2)]


def test_stored_and_filtered_pairs(spark):
    p = spark.createDataFrame([("b", "a", 0.9, 9, 10, 1.0), ("a", "b", 0.8, 8, 10, 2.0), ("a", "a", 1.0, 1, 1, 1.0), ("a", None, 1.0, 1, 1, 1.0)], "folder_a string, folder_b string, similarity double, shared_files long, union_files long, updated_at double")
    s = N.stored_pairs(p)
    assert rows(s) == [("a", "b", 0.8, 8, 10)]
    assert N.filtered_pairs(s, 0.8, 0.9).count() == 1 and N.filtered_pairs(s, 0.0, 0.8).count() == 0 and N.filtered_pairs(s, text="B").count() == 1
    assert N.exact_pairs(spark.createDataFrame([], "folder string, token string")).count() == 0
