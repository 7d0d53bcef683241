"""Mixing sources to target weights (problem 7).

The tokens of each source are packed into blocks of fixed length; for each output shard the number of blocks from each
source is drawn from a multinomial distribution; the slots of a source are numbered over all shards and mapped through a
pseudorandom permutation of the source's blocks, a new one for each pass; and the blocks are joined by index.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborix.runtime import materialize

# Fixed value: the pattern that the vocabulary splits text with.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_TOKENS = 256
SHARD_BLOCKS = 2048
#: Documents of one bucket, about, in which a source's documents are numbered by their lengths.
BUCKET_DOCUMENTS = 100_000
#: Part of what the scarcest source allows that is drawn, so that few draws exceed it.
HEADROOM = 0.98
#: Sources a mixture may have; the plan of a mixture is made on the driver, one entry a source.
MOST_SOURCES = 100_000
SEED = 7


class Mixture(NamedTuple):
    #: shard, slot, source, block, pass, doc_ids, tokens, used_tokens
    blocks: DataFrame
    #: one row a source: shares wanted and reached
    shares: DataFrame


def tokenized(documents: DataFrame, doc: str, text: str, source: str, tokenizer: str) -> DataFrame:
    """d, s, ids: each document's tokens with an end-of-text token behind them. Null documents, texts or sources are left out.

    tokenizer is the path of a public vocabulary as ranks of its byte strings; the token behind a document is the first
    free number.
    """
    spark = documents.sparkSession
    with open(tokenizer, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())  # a vocabulary of fixed size, below 1 MB
    flat = documents.select(F.col(doc).alias("d"), F.col(source).alias("s"), F.col(text).alias("t")).filter("d IS NOT NULL AND s IS NOT NULL AND t IS NOT NULL")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, shared.value.splitlines())}
        t, end = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1
        for whole in batches:
            for batch in (whole.slice(i, 500) for i in range(0, whole.num_rows, 500)):
                ids = [[*t.encode_ordinary(text), end] for text in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["d", "s", "ids"])

    return flat.mapInArrow(encode, "d long, s string, ids array<int>")


def packed(tokens: DataFrame, block_tokens: int = BLOCK_TOKENS, bucket_documents: int = BUCKET_DOCUMENTS) -> DataFrame:
    """s, block, tokens, doc_ids: the documents of each source, in order of a hash, cut to blocks; the last may be shorter.

    tokens is a written table of row (unique), d, s, ids. Only lengths are numbered, in buckets of about bucket_documents;
    a source of any size has as many buckets as it needs. The tokens meet their places in one join by row.
    """
    sized = tokens.select("row", "d", "s", F.size("ids").cast("long").alias("n"))
    counts = sized.groupBy("s").agg(F.ceil(F.count(F.lit(1)) / bucket_documents).alias("buckets"))
    sized = sized.join(F.broadcast(counts), "s").withColumn("bucket", F.pmod(F.xxhash64("d"), F.col("buckets")))  # at most MOST_SOURCES rows
    within = Window.partitionBy("s", "bucket").orderBy("d", "row").rowsBetween(Window.unboundedPreceding, -1)
    totals = sized.groupBy("s", "bucket").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    starts = totals.select("s", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = sized.withColumn("inner", F.coalesce(F.sum("n").over(within), F.lit(0))).join(starts, ["s", "bucket"])
    placed = tokens.join(placed.select("row", "n", (F.col("base") + F.col("inner")).alias("at")), "row")
    size = F.lit(block_tokens)
    first, last = F.floor(F.col("at") / size), F.floor((F.col("at") + F.col("n") - 1) / size)

    def piece(block):  # the part of a document that falls into one block
        begin = F.greatest(block * size - F.col("at"), F.lit(0)).cast("int")
        end = F.least((block + 1) * size - F.col("at"), F.col("n")).cast("int")
        return F.struct(block.alias("block"), (F.col("at") + begin).alias("place"), F.slice("ids", begin + 1, end - begin).alias("part"))

    pieces = placed.select("d", "s", F.explode(F.transform(F.sequence(first, last), piece)).alias("p")).select("d", "s", "p.*")
    # a block has at most block_tokens pieces, as every piece has a token
    blocks = pieces.groupBy("s", "block").agg(F.array_sort(F.collect_list(F.struct("place", "d", "part"))).alias("pieces"))
    return blocks.select("s", "block", F.flatten("pieces.part").alias("tokens"), F.col("pieces.d").alias("doc_ids"))


def allocate(shares: np.ndarray, capacity: np.ndarray, total: int | None) -> np.ndarray:
    """Expected blocks of each source: in proportion to its share, never above its capacity.

    Without a total it is the most at which every source with blocks still reaches its share. With one, sources that
    would exceed their capacity give all they have and the rest is shared by the others in proportion.
    """
    out = np.zeros(len(shares))
    use = (shares > 0) & (capacity > 0)
    if not use.any():
        return out
    p = np.where(use, shares, 0.0)
    p = p / p.sum()
    if total is None:
        return p * (capacity[use] / p[use]).min() * HEADROOM
    left, open_ = float(total), use.copy()
    while left > 1e-9 and open_.any():
        want = p * open_ / p[open_].sum() * left
        full = open_ & (want >= capacity)
        if not full.any():
            return out + want
        out[full] = capacity[full]
        left = total - out.sum()
        open_ &= ~full
    return out


def permuted(k: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The place of index k in a pseudorandom permutation of 0 .. n-1 chosen by key: a Feistel network with cycle walking."""
    k, n, key = k.astype(np.uint64), n.astype(np.uint64), key.astype(np.uint64)
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, np.uint64(2)).astype(float))) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = k.copy(), np.arange(len(k))
    while len(todo):
        x, h, m = out[todo], half[todo], mask[todo]
        left, right = x >> h, x & m
        for r in range(4):
            f = (right + key[todo]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((r + 1) * 0xBF58476D1CE4E5B9 % 2**64)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((f >> np.uint64(32)) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def mix(
    documents: DataFrame, targets: DataFrame, tokenizer: str, doc: str = "doc_id", text: str = "text", source: str = "source", total_blocks: int | None = None,
    block_tokens: int = BLOCK_TOKENS, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED,
) -> Mixture:
    """The mixture, block by block, and the shares reached.

    targets has source, target_share, max_repeats. Shares are taken in proportion over the sources that have a share above
    0 and documents; a null, negative or not-a-number share is 0; a null max_repeats is 1, one below 1 leaves the source
    out; a source listed again counts once, with its largest share. No block, and so no document, is used more often than
    max_repeats: a slot drawn beyond what a source has stays empty and is missing from the mixture. Documents of sources
    that are not listed are not used. Rows with the same id are documents of their own;
    empty texts count as one end-of-text token.
    """
    spark = documents.sparkSession
    share = F.when((F.col("target_share") > 0) & ~F.isnan("target_share"), F.col("target_share")).otherwise(0.0)
    wanted = targets.filter("source IS NOT NULL").groupBy("source").agg(F.max_by(F.struct(share.alias("share"), F.coalesce("max_repeats", F.lit(1)).alias("repeats")), F.struct(share, F.coalesce("max_repeats", F.lit(1)))).alias("w"))
    wanted = wanted.select("source", "w.share", "w.repeats")
    listed = [(r["source"], r["share"], r["repeats"]) for r in wanted.orderBy("source").limit(MOST_SOURCES + 1).collect()]
    if len(listed) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    used = spark.createDataFrame([(s,) for s, w, r in listed if w > 0 and r > 0], "source string")
    mine = documents.join(F.broadcast(used), documents[source] == used["source"], "left_semi")  # at most MOST_SOURCES rows
    # written at once, so that the row numbers stay what they are
    tokens = materialize(tokenized(mine, doc, text, source, tokenizer).withColumn("row", F.monotonically_increasing_id()), "tokens")
    blocks = materialize(packed(tokens, block_tokens), "blocks")
    have = {r["s"]: r["n"] for r in blocks.groupBy("s").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = [s for s, _, _ in listed]
    n_blocks = np.array([have.get(s, 0) for s in names], np.int64)
    repeats = np.array([max(0, r) for _, _, r in listed], np.int64)
    capacity = n_blocks * repeats
    expected = allocate(np.array([w for _, w, _ in listed]), capacity, total_blocks)
    total = int(expected.sum())
    weights = expected / expected.sum() if total else expected

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            parts = []
            for shard in frame["id"].tolist():
                size = min(shard_blocks, total - shard * shard_blocks)
                counts = np.random.default_rng((seed, shard)).multinomial(size, weights)
                hit = np.flatnonzero(counts)
                parts.append(pd.DataFrame({"shard": shard, "src": hit, "count": counts[hit]}))
            yield pd.concat(parts) if parts else pd.DataFrame({"shard": [], "src": [], "count": []})

    shards = -(-total // shard_blocks)
    counts = materialize(spark.range(shards).mapInPandas(draw, "shard long, src int, count long") if shards else spark.createDataFrame([], "shard long, src int, count long"), "draws")
    # slots of a source are numbered over all shards, in two levels so that no task holds all shards of a source
    counts = counts.withColumn("part", F.floor(F.col("shard") / 4096))
    inner = Window.partitionBy("src", "part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.groupBy("src", "part").agg(F.sum("count").alias("c"))
    parts = parts.select("src", "part", F.coalesce(F.sum("c").over(outer), F.lit(0)).alias("base"))
    placed = counts.withColumn("inside", F.coalesce(F.sum("count").over(inner), F.lit(0))).join(parts, ["src", "part"])
    numbered = placed.select("shard", "src", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)).alias("i"), (F.col("base") + F.col("inside")).alias("base"))

    def slots(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            src, k = f["src"].to_numpy(np.int64), (f["base"] + f["i"]).to_numpy(np.int64)
            keep = k < capacity[src]
            src, k, shard, i = src[keep], k[keep], f["shard"].to_numpy(np.int64)[keep], f["i"].to_numpy(np.int64)[keep]
            n = np.maximum(n_blocks[src], 1)
            passes = k // n
            key = (np.uint64(seed) * np.uint64(1_000_003) + src.astype(np.uint64)) * np.uint64(1_000_003) + passes.astype(np.uint64)
            yield pd.DataFrame({"shard": shard, "source": [names[s] for s in src], "block": permuted(k % n, n, key), "pass": passes + 1, "i": i})

    drawn = numbered.mapInPandas(slots, "shard long, source string, block long, pass long, i long")
    order = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "shard", "source", "i"), "source", "i")  # at most shard_blocks rows
    drawn = drawn.withColumn("slot", F.row_number().over(order) - 1).drop("i")
    joined = drawn.join(blocks.withColumnRenamed("s", "source"), ["source", "block"])
    out = joined.select("shard", "slot", "source", "block", "pass", "doc_ids", "tokens", F.size("tokens").alias("used_tokens"))
    reached = joined.groupBy("source").agg(F.sum(F.size("tokens")).alias("tokens"), F.count(F.lit(1)).alias("blocks"), F.max("pass").alias("most_used"))
    whole = reached.agg(F.sum("tokens").alias("all_tokens"))
    usable = sum(w for (_, w, _), c in zip(listed, capacity.tolist(), strict=True) if c > 0)
    plan = spark.createDataFrame(
        [(s, float(w), int(r), int(b), float(w / usable) if usable and c > 0 else 0.0) for (s, w, r), b, c in zip(listed, n_blocks.tolist(), capacity.tolist(), strict=True)],
        "source string, stated_share double, max_repeats int, source_blocks long, target_share double",
    )
    shares = plan.join(reached, "source", "left").crossJoin(F.broadcast(whole)).select(  # one row: the grand total
        "source", "stated_share", "target_share", F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("blocks", F.lit(0)).alias("blocks"), "source_blocks", F.coalesce("most_used", F.lit(0)).alias("most_used"), "max_repeats",
    )
    return Mixture(out, shares)
