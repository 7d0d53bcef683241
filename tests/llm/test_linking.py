import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import rows

from arborix.llm import linking
from arborix.llm.linking import folder_links, linked_groups, spanning_forest


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {n: find(n) for n in root}


def test_forest():
    node, root = spanning_forest(np.array([5, 3, 7, 1]), np.array([3, 4, 8, 1]))
    assert dict(zip(node.tolist(), root.tolist(), strict=True)) == {4: 3, 5: 3, 8: 7}


@pytest.mark.parametrize("bound", [3, 20, 1_000_000])
def test_groups_match_brute_force(spark, bound):
    rnd = random.Random(2)
    random_edges = [(f"n{rnd.randrange(70):02}", f"n{rnd.randrange(70):02}") for _ in range(50)]
    chain = [(f"c{i:02}", f"c{i + 1:02}") for i in range(30)]
    hub = [("h00", f"h{i:02}") for i in range(1, 30)]
    edges = random_edges + chain + hub + hub[:5] + [(b, a) for a, b in chain[:4]] + [(None, "q"), ("q", None), ("s", "s")]
    df = spark.createDataFrame(edges, "x string, y string").withColumnRenamed("x", "b").withColumnRenamed("y", "a")
    got = linked_groups(df, "b", "a", partition_edges=bound, fan_in=2)
    assert {r["node"]: r["root"] for r in got.collect()} == brute(edges)
    assert got.count() == len(brute(edges))


def test_no_links(spark):
    assert linked_groups(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0


def test_what_links(spark):
    s = "folder_a string, folder_b string, similarity double, extra int"
    df = spark.createDataFrame([("/a//", "/b", 0.8, 1), ("/a", "/a/", 1.0, 1), ("/c", None, 1.0, 1), ("/d", "/e", None, 1), ("/d", "/e", 0.79, 1), ("", "/f", 1.0, 1)], s)
    assert rows(folder_links(df)) == [("/a", "/b")]


def test_hub_is_spread_over_partitions(spark, monkeypatch, tmp_path):
    """All links of a hub that is the smaller end: no partition gets much more than its share, and the groups are right."""
    name = "bounded_forests" if hasattr(linking, "bounded_forests") else "_forest_of"
    original, seen = getattr(linking, name), str(tmp_path)

    def watched(batches, *bound):
        import os
        import uuid

        batches = list(batches)
        with open(os.path.join(seen, uuid.uuid4().hex), "w") as f:
            f.write(str(sum(b.num_rows for b in batches)))
        yield from original(iter(batches), *bound)

    monkeypatch.setattr(linking, name, watched)
    edges = [("a", f"n{i:05}") for i in range(4000)]
    got = linked_groups(spark.createDataFrame(edges, "a string, b string"), "a", "b", partition_edges=1000)
    assert {r["node"]: r["root"] for r in got.collect()} == brute(edges)
    assert max(int(f.read_text()) for f in tmp_path.iterdir()) <= 1200


def test_forests_hold_no_more_than_the_bound(monkeypatch):
    sizes, original = [], linking.spanning_forest
    monkeypatch.setattr(linking, "spanning_forest", lambda u, v: sizes.append(len(u)) or original(u, v))
    rnd = random.Random(3)
    edges = [("a", f"n{i:04}") for i in range(500)] + [(f"p{rnd.randrange(20):02}", f"q{rnd.randrange(20):02}") for _ in range(500)]
    batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*edges[i : i + 170], strict=True)], names=["a", "b"]) for i in range(0, len(edges), 170)]
    out = [(x, y) for f in linking.bounded_forests(iter(batches), 100) for x, y in zip(f["a"].to_pylist(), f["b"].to_pylist(), strict=True)]
    assert max(sizes) <= 100
    assert brute(out) == brute(edges)
    assert not list(linking.bounded_forests(iter([]), 100))
