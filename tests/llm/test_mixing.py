import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arborix.llm import mixing as M
from arborix.llm.queries import TOKENIZER


@given(st.integers(1, 3000), st.integers(0, 2**40))
@settings(max_examples=60, deadline=None)
def test_permutations_are_permutations(n, key):
    got = M.permuted(np.arange(n), np.full(n, n), np.full(n, key))
    assert sorted(got.tolist()) == list(range(n))


def test_allocation():
    shares, capacity = np.array([0.5, 0.3, 0.2, 0.0, 0.4]), np.array([100, 1000, 1000, 50, 0])
    free = M.allocate(shares, capacity, None)
    assert free[0] == pytest.approx(100 * M.HEADROOM) and free[1] / free[0] == pytest.approx(0.6) and free[3] == free[4] == 0
    capped = M.allocate(shares, capacity, 600)
    assert capped[0] == 100 and capped.sum() == pytest.approx(600) and capped[1] / capped[2] == pytest.approx(1.5)
    assert M.allocate(shares, capacity, 10**9).sum() == 2100
    assert M.allocate(np.zeros(2), np.ones(2), None).sum() == 0


needs = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no vocabulary files")


@pytest.fixture(scope="module")
def frames(spark):
    docs = [(i, f"document number {i} " + "word " * (i % 37), "big" if i % 3 else "small", 1) for i in range(600)]
    docs += [(1000, "", "small", 1), (1001, None, "small", 1), (1002, "text", None, 1), (None, "text", "big", 1), (1003, "long " * 40_000, "big", 1), (1004, "x", "unlisted", 1)]
    targets = [("big", 0.5, 1), ("small", 0.25, None), ("gone", 0.1, 2), ("zero", 0.0, 2), ("nan", float("nan"), 1), ("null", None, 1), (None, 0.3, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, source string, block int"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


@needs
def test_blocks_hold_every_token_once(spark, frames):
    import base64

    import tiktoken

    docs, _ = frames
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(TOKENIZER, "rb"))}
    t = tiktoken.Encoding("own", pat_str=M.SPLIT, mergeable_ranks=ranks, special_tokens={})
    docs = docs.unionByName(docs.filter("doc_id = 7"))
    rows = [r for r in docs.collect() if None not in (r["doc_id"], r["text"], r["source"])]
    tokens = M.tokenized(docs, "doc_id", "text", "source", TOKENIZER).withColumn("row", F.monotonically_increasing_id()).cache()
    for s, bucket in (("big", 100_000), ("small", 100_000), ("big", 20), ("small", 1)):
        blocks = M.packed(tokens, 64, bucket).collect()
        mine = sorted((b for b in blocks if b["s"] == s), key=lambda b: b["block"])
        assert [b["block"] for b in mine] == list(range(len(mine))) and all(len(b["tokens"]) == 64 for b in mine[:-1])
        stream = [x for b in mine for x in b["tokens"]]
        texts = t.decode_batch([[y for y in x] for x in _split(stream, len(ranks))])
        assert sorted(texts) == sorted(r["text"] for r in rows if r["source"] == s)


def _split(stream, end):
    out, cur = [], []
    for x in stream:
        if x == end:
            out.append(cur)
            cur = []
        else:
            cur.append(x)
    return out


@needs
def test_shares_and_caps(spark, frames):
    docs, targets = frames
    m = M.mix(docs, targets, TOKENIZER, total_blocks=400, block_tokens=64, shard_blocks=50)
    shares = {r["source"]: r for r in m.shares.collect()}
    assert set(shares) == {"big", "small", "gone", "zero", "nan", "null"}
    assert shares["gone"]["tokens"] == shares["zero"]["tokens"] == shares["nan"]["tokens"] == 0
    assert shares["big"]["actual_share"] + shares["small"]["actual_share"] == pytest.approx(1)
    got = m.blocks.drop("tokens").toPandas()
    used = got.groupby(["source", "block"]).size()
    assert used["big"].max() == 1 and used["small"].max() == 1
    assert got.groupby(["shard", "slot"]).size().max() == 1
    again = M.mix(docs, targets, TOKENIZER, total_blocks=400, block_tokens=64, shard_blocks=50).blocks.drop("tokens").toPandas()
    key = ["shard", "slot", "source", "block"]
    assert got[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()


@needs
def test_repeats_reach_the_cap_and_not_more(spark, frames):
    docs, _ = frames
    targets = spark.createDataFrame([("small", 1.0, 3)], "source string, target_share double, max_repeats int")
    got = M.mix(docs, targets, TOKENIZER, total_blocks=10**6, block_tokens=64).blocks.toPandas()
    used = got.groupby("block").size()
    assert used.min() == 3 == used.max()


@needs
def test_nothing_to_mix(spark, frames):
    docs, targets = frames
    m = M.mix(docs.limit(0), targets, TOKENIZER)
    assert m.blocks.count() == 0 and m.shares.count() == 6
    assert M.mix(docs, targets.limit(0), TOKENIZER).shares.count() == 0
