"""All pairs of set-valued records above a Jaccard similarity (problem 1).

Equal sets become one class first. Every other class gets a label of minhash values in each of many independent trees, and
each tree is sorted by label, so that classes with long common prefixes are neighbours. Classes whose common prefix is at
least as long as a depth are compared with those up to a window before them; the depth follows from the number of trees and
the target recall. A class with more such neighbours than the window holds is unsettled: it goes on to a round of its own,
with new, deeper labels and as many more trees as the recall needs there, and after the last round it is compared with the
rest of its neighbourhood block by block. Neighbours whose sizes and bit sketches still allow the similarity are verified
exactly.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborix.runtime import materialize

#: Independent trees of the first round; more trees allow longer prefixes and so fewer false neighbours.
TREES = 40
#: Share of the pairs at the threshold itself that must be neighbours in some tree; more similar pairs reach more.
TARGET_RECALL = 0.99998
#: Labels are so much deeper in each further round, as long as the recall needs at most so many trees.
DEEPER, MOST_TREES = 4, 400
#: Neighbours before it in the order of a tree that a class is compared with.
WINDOW = 500
#: Bits of a sketch. A pair at the threshold fails the sketch test with a probability of about 1e-9.
SKETCH_BITS = 64
_SIGMAS = 6.0


def prefix_depth(threshold: float, trees: int = TREES, recall: float = TARGET_RECALL) -> int:
    """The longest common prefix at which a pair at the threshold still meets the target recall."""
    depth = 1
    while threshold < 1 and 1 - (1 - threshold ** (depth + 1)) ** trees >= recall:
        depth += 1
    return depth


def rounds(threshold: float, trees: int = TREES, recall: float = TARGET_RECALL) -> list[tuple[int, int]]:
    """Depth and trees of each round; every round by itself meets the target recall."""
    out = [(prefix_depth(threshold, trees, recall), trees)]
    while threshold < 1:
        depth = out[-1][0] + DEEPER
        needed = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**depth)))
        if needed > MOST_TREES:
            break
        out.append((depth, needed))
    return out


def sketch_distance(threshold: float) -> int:
    """Bits in which the sketches of two sets at the threshold may differ."""
    p = (1 - threshold) / 2
    return min(SKETCH_BITS, math.ceil(SKETCH_BITS * p + _SIGMAS * math.sqrt(SKETCH_BITS * p * (1 - p))))


def smallest_inexact(threshold: float) -> int:
    """The smallest set that can reach the threshold with a set unlike itself: n of n + 1 values in common."""
    n = 1
    while n / (n + 1) < threshold:
        n += 1
    return n


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(values: np.ndarray, offsets: np.ndarray, trees: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per set: the hash of each tree's label down to depth and the next four values of it (sets x trees), and the bit sketches."""
    n, more = trees * depth, 4
    rng = np.random.default_rng(20240229 + depth)
    factor = rng.integers(1, 2**63, n + SKETCH_BITS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 2**63, len(factor), dtype=np.uint64)
    sets = len(offsets) - 1
    mixed = _mix(values.astype(np.int64).view(np.uint64))

    def low(i: int) -> np.ndarray:
        return np.minimum.reduceat(_mix(mixed * factor[i] + shift[i]), offsets[:-1])

    values_ = np.array([low(i) for i in range(n)]).reshape(trees, depth, sets)
    keys, rest = np.empty((sets, trees), np.int64), np.empty((sets, trees), np.int64)
    for t in range(trees):
        key = np.full(sets, t, np.uint64)
        for d in range(depth):
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + values_[t, d])
        keys[:, t] = key.view(np.int64)
        # a tree's label goes on with the first values of other trees, 16 bits each
        deeper = np.zeros(sets, np.uint64)
        for d in range(more):
            deeper = (deeper << np.uint64(16)) | (values_[(t + d + 1) % trees, 0] & np.uint64(0xFFFF))
        rest[:, t] = deeper.view(np.int64)
    bits = np.zeros(sets, np.uint64)
    for i in range(SKETCH_BITS):
        bits |= (low(n + i) & np.uint64(1)) << np.uint64(i)
    return keys, rest, bits.view(np.int64)


def allowed(threshold: float) -> Callable[..., np.ndarray]:
    """Whether the sizes and sketches of two classes still allow the threshold."""
    most = sketch_distance(threshold)

    def test(n: np.ndarray, bits: np.ndarray, other_n: np.ndarray, other_bits: np.ndarray) -> np.ndarray:
        near = np.bitwise_count((bits ^ other_bits).view(np.uint64)) <= most
        return near & (np.minimum(n, other_n) >= threshold * np.maximum(n, other_n))

    return test


_PAIR = {"a": pa.int64(), "b": pa.int64()}


def _batch(a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
    """Pairs, smaller id first; unsettled classes without b."""
    if b is None:
        columns = [pa.array(a, pa.int64()), pa.nulls(len(a), pa.int64())]
    else:
        columns = [pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=list(_PAIR))


def neighbours(batches: Iterator[pa.RecordBatch], threshold: float, window: int) -> Iterator[pa.RecordBatch]:
    """Pairs of classes from one partition of sorted trees (key, rest, cid, n, bits), and the unsettled classes.

    A class is compared with up to window others before it that have its key. Two classes further apart leave both
    unsettled. Beyond 64 windows of one key nothing is compared any more, so its cost stays in proportion to its size.
    """
    test, far = allowed(threshold), 64 * window
    held = [np.zeros(0, np.int64)] * 4
    before = np.zeros(0, np.int64)
    for batch in batches:
        key, cid, n, bits = (np.concatenate([h, batch.column(c).to_numpy().astype(np.int64)]) for h, c in zip(held, ("key", "cid", "n", "bits"), strict=True))
        known, size = len(before), len(key)
        at = np.arange(size)
        first = np.r_[True, key[1:] != key[:-1]] if size else np.zeros(0, bool)
        place = at - np.maximum.accumulate(np.where(first, at, 0))
        if known:
            place[key == key[0]] += before[0]
        new = np.arange(known, size)
        a, b = [], []
        for off in range(1, window + 1):
            new = new[(place[new] >= off) & (place[new] < far)]
            if not len(new):
                break
            ok = new[test(n[new], bits[new], n[new - off], bits[new - off])]
            a.append(cid[ok])
            b.append(cid[ok - off])
        if a:
            a_, b_ = np.concatenate(a), np.concatenate(b)
            yield _batch(a_[a_ != b_], b_[a_ != b_])
        cut = at[known:][place[known:] > window]
        late = at[known:][place[known:] >= far - window - 1]
        unsettled = np.unique(np.r_[cid[cut], cid[cut - window - 1], cid[late]])
        if len(unsettled):
            yield _batch(unsettled, None)
        keep = slice(max(0, size - window - 1), size)
        held, before = [x[keep] for x in (key, cid, n, bits)], place[keep]


def block_pairs(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """All allowed pairs of each block (key, lo, hi), rows of two chunks of a neighbourhood, sorted by block."""
    test = allowed(threshold)
    open_: list[pa.RecordBatch] = []

    def compare(block: pa.Table) -> pa.RecordBatch:
        cid, n, bits, chunk = (block[c].to_numpy() for c in ("cid", "n", "bits", "chunk"))
        lo, hi = block["lo"][0].as_py(), block["hi"][0].as_py()
        left, right = (np.flatnonzero(chunk == c) for c in (lo, hi))
        a, b = [], []
        for i in left:
            others = right[right > i] if lo == hi else right
            ok = others[test(np.broadcast_to(n[i], len(others)), np.broadcast_to(bits[i], len(others)), n[others], bits[others])]
            a.append(np.full(len(ok), cid[i]))
            b.append(cid[ok])
        return _batch(*(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b)))

    def ends(batch: pa.RecordBatch) -> list[int]:
        names = [batch.column(c).to_numpy() for c in ("key", "lo", "hi")]
        return [*(np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in names])) + 1).tolist(), batch.num_rows]

    def block(batch: pa.RecordBatch) -> tuple:
        return tuple(batch.column(c)[0].as_py() for c in ("key", "lo", "hi"))

    for batch in (b for b in batches if b.num_rows):
        at = 0
        for end in ends(batch):
            part = batch.slice(at, end - at)
            if open_ and block(open_[0]) != block(part):
                yield compare(pa.Table.from_batches(open_).combine_chunks())
                open_ = []
            open_.append(part)
            at = end
    if open_:
        yield compare(pa.Table.from_batches(open_).combine_chunks())


class Classes(NamedTuple):
    #: class id, values (sorted, distinct), size, representative (smallest record), records
    classes: DataFrame
    #: record, class id
    members: DataFrame


def set_classes(records: DataFrame, record: str, values: str, least_size: int = 2) -> Classes:
    """Classes of records with equal sets of at least least_size distinct non-null values over all rows of a record."""
    rows = records.select(F.col(record).alias("record"), F.explode(values).alias("value")).filter("record IS NOT NULL AND value IS NOT NULL")
    sets = rows.distinct().groupBy("record").agg(F.array_sort(F.collect_list("value")).alias("tokens")).filter(F.size("tokens") >= least_size)
    sets = materialize(sets, "sets")
    grouped = sets.groupBy("tokens").agg(F.min("record").alias("rep"), F.count(F.lit(1)).alias("records"))
    # written at once, so that the ids stay what they are
    classes = materialize(grouped.select(F.monotonically_increasing_id().alias("cid"), "tokens", F.size("tokens").alias("n"), "rep", "records"), "classes")
    single = classes.filter("records = 1").select(F.col("rep").alias("record"), "cid")
    copies = sets.join(classes.filter("records > 1").select("tokens", "cid"), "tokens").select("record", "cid")
    return Classes(classes, materialize(single.unionByName(copies), "members"))


def class_pairs(classes: DataFrame, threshold: float = 0.8, trees: int = TREES, recall: float = TARGET_RECALL, window: int = WINDOW) -> DataFrame:
    """Pairs of classes (a < b) of different sets with Jaccard similarity >= threshold: a, b, shared, similarity."""
    flat = classes.filter(F.col("n") >= smallest_inexact(threshold)).select("cid", "n", "tokens")
    left, found = flat, []
    for depth, many in rounds(threshold, trees, recall):
        labelled = _labels(left, many, depth)
        ordered = labelled.repartition("key").sortWithinPartitions("key", "rest", "cid")
        out = materialize(ordered.mapInArrow(lambda batches: neighbours(batches, threshold, window), "a long, b long"), "neighbours")
        found.append(out.filter("b IS NOT NULL"))
        unsettled = out.filter("b IS NULL").select(F.col("a").alias("cid")).distinct()
        if unsettled.isEmpty():
            break
        left = left.join(unsettled, "cid", "left_semi")
    else:
        found.append(_blocks(labelled.join(unsettled, "cid", "left_semi"), threshold, window))
    candidates = reduce(DataFrame.unionByName, found).distinct()
    left = candidates.join(flat.select(F.col("cid").alias("a"), F.col("tokens").alias("ta"), F.col("n").alias("na")), "a")
    both = left.join(flat.select(F.col("cid").alias("b"), F.col("tokens").alias("tb"), F.col("n").alias("nb")), "b")
    counted = both.select("a", "b", "na", "nb", F.size(F.array_intersect("ta", "tb")).cast("long").alias("shared"))
    similar = counted.withColumn("similarity", F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")))
    return similar.filter(F.col("similarity") >= threshold).select("a", "b", "shared", "similarity")


def _labels(classes: DataFrame, trees: int, depth: int) -> DataFrame:
    """One row per class and tree: cid, n, bits, key, rest."""

    def labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 1000) for i in range(0, whole.num_rows, 1000)):
                tokens = batch.column(2)
                keys, rest, bits = signatures(tokens.flatten().to_numpy(), np.asarray(tokens.offsets) - tokens.offsets[0].as_py(), trees, depth)
                many = [np.repeat(x, trees) for x in (batch.column(0).to_numpy(), batch.column(1).to_numpy(), bits)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*many, keys.ravel(), rest.ravel())], names=["cid", "n", "bits", "key", "rest"])

    return classes.mapInArrow(labels, "cid long, n int, bits long, key long, rest long")


def _blocks(labelled: DataFrame, threshold: float, window: int) -> DataFrame:
    """All allowed pairs of neighbourhoods that are larger than the window: a, b.

    A neighbourhood is cut into chunks of about window classes by hash, and each pair of chunks is a block of its own, so
    that its pairs spread over the tasks however large it is.
    """
    large = labelled.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") > window)
    rows = labelled.join(large, "key").withColumn("chunks", F.ceil(F.col("members") / window).cast("int"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    blocks = rows.select("key", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "chunk", "cid", "n", "bits")
    ordered = blocks.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return ordered.mapInArrow(lambda batches: block_pairs(batches, threshold), "a long, b long").filter("a <> b")


def similar_record_pairs(records: DataFrame, record: str, values: str, threshold: float = 0.8, least_size: int = 2, trees: int = TREES, recall: float = TARGET_RECALL) -> DataFrame:
    """All pairs of records, record_a < record_b: similarity, shared, united (values in common, in either).

    A record's set is made of the distinct non-null values of all its rows; null records, null or empty arrays and sets
    below least_size form no pair; equal sets have similarity 1; other columns are ignored.
    """
    found = set_classes(records, record, values, least_size)
    pairs = materialize(class_pairs(found.classes, threshold, trees, recall), "class-pairs")
    m = found.members
    other = m.select(F.col("record").alias("y"), F.col("cid").alias("b"))
    across = pairs.join(m.select(F.col("record").alias("x"), F.col("cid").alias("a")), "a").join(other, "b").select("x", "y", "a", "shared", "similarity")
    multiple = found.classes.filter("records > 1").select(F.col("cid").alias("a"), F.col("n").cast("long").alias("shared"))
    copies = multiple.join(m.select(F.col("record").alias("x"), F.col("cid").alias("a")), "a")
    within = copies.join(other.withColumnRenamed("b", "a"), "a").filter("x < y").select("x", "y", "a", "shared", F.lit(1.0).alias("similarity"))
    out = across.unionByName(within)
    united = F.round(F.col("shared") / F.col("similarity")).cast("long")
    return out.select(F.least("x", "y").alias("record_a"), F.greatest("x", "y").alias("record_b"), "similarity", "shared", united.alias("united"))


def record_links(records: DataFrame, record: str, values: str, threshold: float = 0.8, least_size: int = 2) -> DataFrame:
    """One row per record with its class and number of links, copies included: record, class_record, links."""
    found = set_classes(records, record, values, least_size)
    pairs = materialize(class_pairs(found.classes, threshold), "class-pairs")
    size = found.classes.select("cid", "records")
    one = pairs.select(F.col("a").alias("cid"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("cid"), F.col("a").alias("other")))
    links = one.join(size.select(F.col("cid").alias("other"), "records"), "other").groupBy("cid").agg(F.sum("records").alias("outside"))
    classes = found.classes.select("cid", "rep", "records").join(links, "cid", "left")
    out = found.members.join(classes, "cid")
    return out.select("record", F.col("rep").alias("class_record"), (F.col("records") - 1 + F.coalesce("outside", F.lit(0))).alias("links"))
