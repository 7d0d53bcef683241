"""Connected components by star contraction, for graphs of any size and any degree of a node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborix.runtime import materialize, release

MAX_ROUNDS = 60


def star_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Every node of an edge with the smallest node linked to it: columns node, root.

    Large-star and small-star rounds alternate until nothing changes. The minimum over a node's neighbours is combined
    before it is shuffled, and it is joined back as one row a node, so AQE can split the join at a node of any degree.
    Rows with a null end give nothing; a loop gives its node as its own root; repeated edges count once.
    """
    raw = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL")
    loops = raw.filter("u = v").select(F.col("u").alias("node"))
    cur = materialize(raw.filter("u <> v").select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = cur.select(F.col("hi").alias("x"), F.col("lo").alias("y")).unionByName(cur.select(F.col("lo").alias("x"), F.col("hi").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = both.filter("y > x").join(least, "x").select(F.col("y").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo").distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        linked = large.join(low, "hi")
        small = linked.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo").unionByName(low.select("hi", F.col("m").alias("lo"))).distinct()
        nxt = materialize(small, "stars")
        release(cur)
        cur = nxt
        now = cur.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h")).first()
        if before == (now["n"], now["h"]):
            break
        before = (now["n"], now["h"])
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    members = cur.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    roots = cur.select(F.col("lo").alias("node")).unionByName(loops).distinct().select("node", F.col("node").alias("root"))
    return members.unionByName(roots.join(members.select("node"), "node", "left_anti"))
