"""Consolidating pairwise matches into groups (problem 4).

Union-find runs inside each edge partition and keeps only a spanning forest of it; forests are merged level by level,
several partitions to one, as long as a merged partition stays within a bound; what is left beyond the bound, forests
that cannot be merged in one task, goes on as star contraction over DataFrames. A task holds no more edges than the bound
even where its partition is larger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborix.functions.text import clean_path
from arborix.operators.components import star_components
from arborix.runtime import materialize, release

#: Edges that one task may hold: about 300 MB with paths of 100 characters.
PARTITION_EDGES = 1_000_000
FAN_IN = 8

_EDGE = pa.schema([("a", pa.string()), ("b", pa.string())])


def spanning_forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for every node that is not the smallest of its component; nodes are integers, roots the smallest.

    Union-find on whole columns: hook the larger of two roots under the smaller, halve the paths, until no edge joins
    two trees.
    """
    parent = np.arange(int(max(u.max(), v.max())) + 1) if len(u) else np.arange(0)
    while len(u):
        ru, rv = parent[u], parent[v]
        open_ = ru != rv
        if not open_.any():
            break
        u, v, ru, rv = u[open_], v[open_], ru[open_], rv[open_]
        np.minimum.at(parent, np.maximum(ru, rv), np.minimum(ru, rv))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    node = np.flatnonzero(parent != np.arange(len(parent)))
    return node, parent[node]


def _forest(table: pa.Table) -> pa.Table:
    both = np.concatenate([table["a"].to_numpy(zero_copy_only=False), table["b"].to_numpy(zero_copy_only=False)])
    names, code = np.unique(both, return_inverse=True)
    node, root = spanning_forest(code[: table.num_rows], code[table.num_rows :])
    return pa.table([pa.array(names[root], pa.string()), pa.array(names[node], pa.string())], schema=_EDGE)


def bounded_forests(batches: Iterator[pa.RecordBatch], bound: int) -> Iterator[pa.RecordBatch]:
    """Spanning forests of the edges a, b, with at most bound edges held at once, however many come.

    Edges beyond the bound are first reduced to their forest; a forest of more than half the bound is handed on and a new
    one begun. Up to bound edges give exactly one forest.
    """
    held = _EDGE.empty_table()
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            if held.num_rows == bound:
                held = _forest(held)
                if held.num_rows > bound // 2:
                    yield from held.to_batches()
                    held = _EDGE.empty_table()
            part = batch.slice(at, bound - held.num_rows)
            held = pa.concat_tables([held, pa.Table.from_batches([part]).cast(_EDGE)])
            at += part.num_rows
    if held.num_rows:
        yield from _forest(held).to_batches()


def linked_groups(links: DataFrame, a: str, b: str, partition_edges: int = PARTITION_EDGES, fan_in: int = FAN_IN) -> DataFrame:
    """Every record of a link with the smallest record linked to it directly or indirectly: columns node, root.

    Null ends give nothing; a record linked to itself alone gives nothing; repeated links and either orientation count
    once; extra columns are ignored; no links, no rows.
    """
    edges = links.select(F.least(F.col(a), F.col(b)).alias("a"), F.greatest(F.col(a), F.col(b)).alias("b"))
    edges = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    cur = materialize(edges.distinct(), "links")
    n, parts = cur.count(), 0
    while True:
        needed = max(1, -(-n // partition_edges))
        parts = needed if not parts else max(needed, -(-parts // fan_in))
        # by both ends, so that a hub is spread over all partitions; equal edges of several forests meet
        nxt = materialize(cur.repartition(parts, "a", "b").mapInArrow(lambda batches: bounded_forests(batches, partition_edges), "a string, b string"), "forest")
        left = nxt.count()
        release(cur)
        cur = nxt
        if parts == 1:
            # at most partition_edges edges came in, so this is one forest
            return cur.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(cur.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        if left > 0.9 * n and parts == needed:
            return star_components(cur)
        n = left


def folder_links(pairs: DataFrame, least_similarity: float = 0.8) -> DataFrame:
    """Links a, b of match results: both folders present, different, similarity reached; slashes as in clean_path()."""
    links = pairs.filter(F.col("similarity") >= least_similarity).select(clean_path("folder_a").alias("a"), clean_path("folder_b").alias("b"))
    return links.filter((F.col("a") != "") & (F.col("b") != "") & (F.col("a") != F.col("b")))
