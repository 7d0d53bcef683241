"""The queries of the subpackage against their SQL, and p5 and p6 against brute force on the smallest data."""

import os

import pytest

from arborix.llm import queries as Q
from arborix.llm.canonical import canonical_texts
from arborix.llm.leakage import words_of
from arborix.runtime import load
from test_entry import DATA, db, same  # noqa: F401

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query(spark, db, name):  # noqa: F811
    same(spark, db, Q.QUERIES[name], Q.SQL[name])


def test_look_alikes(spark):
    got = {tuple(r) for r in Q.p5_found(spark, DATA).collect()}
    for table, field in (("file_names", "name"), ("files", "path")):
        by = {}
        rows = {(r["id"], r[field]) for r in load(spark, DATA, table).select("id", field).collect()}
        forms = canonical_texts([v for _, v in sorted(rows)])
        for (i, v), f in zip(sorted(rows), forms, strict=True):
            by.setdefault(f, []).append((i, v))
        want = {(field, i, j) for g in by.values() for i, v in g for j, w in g if i < j and v != w}
        assert {x for x in got if x[0] == field} == want


def test_leaks(spark):
    items = {r["item_id"]: words_of(r["text"]).words for r in load(spark, DATA, "eval_items").collect()}
    grams = {}
    for i, w in items.items():
        for k in range(len(w) - 19):
            grams.setdefault(tuple(w[k : k + 20]), set()).add(i)
    want = set()
    for r in load(spark, DATA, "documents").collect():
        w = words_of(r["text"]).words
        want |= {(r["doc_id"], i) for k in range(len(w) - 19) for i in grams.get(tuple(w[k : k + 20]), ())}
    assert {tuple(r) for r in Q.p6_found(spark, DATA).collect()} == want
