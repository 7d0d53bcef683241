import random

from helpers import rows
from pyspark.sql import functions as F

from arborix.operators.skew import chunked_aggregate, number_rows


def brute(data):
    out = {}
    for k, v in data:
        if k is not None:
            out.setdefault(k, []).append(v)
    return {k: (min(v), max(v), len(v), sum(v)) for k, v in out.items()}


def test_states_match_brute_force_for_any_chunk_size(spark):
    rnd = random.Random(1)
    data = [("hot" if rnd.random() < 0.5 else rnd.choice("abcdefg") if rnd.random() < 0.9 else None, rnd.randrange(100)) for _ in range(3000)]
    df = spark.createDataFrame(data, "key string, v long").repartition(7)
    for chunk in (1, 7, 64, 10_000):
        got = chunked_aggregate(df, F.col("key"), {"v": F.col("v")}, {"lo": ("min", "v"), "hi": ("max", "v"), "n": ("count", "v"), "s": ("sum", "v")}, chunk_rows=chunk)
        assert {r["k"]: (r["lo"], r["hi"], r["n"], r["s"]) for r in got.collect()} == brute(data)


def test_positions_have_no_gaps_and_keys_stay_together(spark):
    df = spark.createDataFrame([("x",)] * 50 + [("y",)] * 5 + [(None,)] * 3, "key string").withColumn("one", F.lit(1)).repartition(5)
    got = number_rows(df, F.col("key"), {"one": F.col("one")}, ["one"]).collect()
    by = {}
    for r in got:
        by.setdefault(r["bucket"], []).append((r["pos"], r["k"]))
    assert sum(map(len, by.values())) == 55
    for places in by.values():
        places.sort()
        assert [p for p, _ in places] == list(range(len(places)))
        keys = [k for _, k in places]
        assert keys == sorted(keys, key=keys.index)


def test_first_and_last_follow_the_numbering(spark):
    df = spark.createDataFrame([("k", i) for i in range(40)], "key string, v int").coalesce(1)
    got = chunked_aggregate(df, F.col("key"), {"v": F.col("v")}, {"a": ("first", "v"), "b": ("last", "v")}, ["v"], chunk_rows=3).first()
    assert (got["a"], got["b"]) == (0, 39)


def test_empty_null_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "k string, pid int, n long")
    assert chunked_aggregate(empty, F.col("k"), {"n": F.col("n")}, {"s": ("sum", "n")}).count() == 0
    df = spark.createDataFrame([("a", 1, None), ("a", 1, None), (None, 2, 5)], "k string, pid int, n long")
    got = chunked_aggregate(df, F.col("k"), {"n": F.col("n")}, {"s": ("sum", "n"), "c": ("count", "n")})
    assert rows(got) == [("a", None, 0)]
