import random

import pyarrow as pa
from helpers import rows

from arborix.llm import set_pairs as S


def brute(sets, t, least=2):
    items = sorted(sets.items())
    return sorted((a, b) for i, (a, x) in enumerate(items) for b, y in items[i + 1 :] if len(x) >= least and len(y) >= least and len(x & y) / len(x | y) >= t)


def sample(seed, families=60):
    rnd = random.Random(seed)
    out = {}
    for f in range(families):
        base = {rnd.randrange(-(2**62), 2**62) for _ in range(rnd.choice([1, 2, 3, 4, 5, 8, 20, 60]))} | {42}
        out[f"/f{f}"] = base
        for c in range(rnd.randrange(4)):
            other = set(base)
            for _ in range(rnd.randrange(1 + len(base) // 6)):
                other.discard(rnd.choice(sorted(other)))
                other.add(rnd.randrange(2**62))
            out[f"/f{f}/{c}"] = other
    return out


def test_all_pairs_are_found(spark):
    for seed in (1, 2):
        sets = sample(seed)
        data = [(p, list(v) + list(v)[:2] + [None], 1) for p, v in sets.items()]
        df = spark.createDataFrame(data, "path string, tokens array<long>, n int")
        for t in (0.8, 0.6):
            got = rows(S.similar_record_pairs(df, "path", "tokens", t), "record_a", "record_b")
            assert got == brute(sets, t)


def test_figures_copies_and_dirt(spark):
    data = [("a", [1, 2, 3, 4, 5]), ("b", [1, 2, 3, 4]), ("c", [4, 3, 2, 1, 1]), ("d", None), ("e", []), ("f", [None, 7]), (None, [1, 2, 3, 4]), ("g", [1, 2]), ("g", [3, 4]), ("g", None), ("h", [9]), ("i", [9])]
    df = spark.createDataFrame(data, "cid string, n array<long>")
    got = S.similar_record_pairs(df, "cid", "n")
    assert rows(got) == [("a", "b", 0.8, 4, 5), ("a", "c", 0.8, 4, 5), ("a", "g", 0.8, 4, 5), ("b", "c", 1.0, 4, 4), ("b", "g", 1.0, 4, 4), ("c", "g", 1.0, 4, 4)]
    assert rows(S.record_links(df, "cid", "n")) == [("a", "a", 3), ("b", "b", 3), ("c", "b", 3), ("g", "b", 3)]
    assert S.similar_record_pairs(df.limit(0), "cid", "n").count() == 0


def test_parameters_follow_the_threshold():
    for t in (0.5, 0.8, 0.95):
        for depth, trees in S.rounds(t):
            assert 1 - (1 - t**depth) ** trees >= S.TARGET_RECALL and (trees == S.TREES or trees <= S.MOST_TREES)
    assert len(S.rounds(0.8)) == 3 and S.rounds(1.0) == [(1, S.TREES)]
    assert S.smallest_inexact(0.8) == 4 and S.sketch_distance(0.8) < S.SKETCH_BITS // 2


def family(seed, copies=150, core=40, own=6):
    """Many sets that are alike, below the limit, with some pairs above it."""
    rnd = random.Random(seed)
    base = set(range(core))
    out = {f"/f{i}": base | {rnd.randrange(1000, 10**9) for _ in range(own)} for i in range(copies)}
    for i in range(0, copies, 7):
        out[f"/g{i}"] = out[f"/f{i}"] | {rnd.randrange(1000, 10**9)}
    return out


def test_neighbourhoods_beyond_the_window(spark):
    """A window far below the family takes all pairs through the further rounds and the blocks."""
    sets = family(3)
    df = spark.createDataFrame([(p, list(v)) for p, v in sets.items()], "path string, tokens array<long>")
    found = S.set_classes(df, "path", "tokens")
    name = {r["cid"]: r["rep"] for r in found.classes.collect()}
    for window in (3, 20, 1000):
        got = sorted(tuple(sorted((name[r["a"]], name[r["b"]]))) for r in S.class_pairs(found.classes, 0.8, window=window).collect())
        assert got == brute(sets, 0.8)


def test_windows_of_a_sorted_tree():
    """Batches of any size give the same pairs, and classes are unsettled just where the window was too short."""
    rnd = random.Random(5)
    key = sorted(rnd.randrange(12) for _ in range(120))
    table = pa.table({"key": pa.array(key, pa.int64()), "cid": pa.array(range(120), pa.int64()), "n": pa.array([9] * 120, pa.int32()), "bits": pa.array([0] * 120, pa.int64())})
    for window in (1, 4, 50):
        pairs = {(i, j) for i in range(120) for j in range(i + 1, 120) if key[i] == key[j]}
        want = {(i, j) for i, j in pairs if j - i <= window} | {(i, None) for p in pairs if p[1] - p[0] > window for i in p}
        for size in (1, 7, 200):
            got = [(r["a"], r["b"]) for b in S.neighbours(iter(table.to_batches(size)), 0.8, window) for r in b.to_pylist()]
            assert {x for x in got if x[1] is not None} == {x for x in want if x[1] is not None}
            assert {x for x in got if x[1] is None} == {x for x in want if x[1] is None}
