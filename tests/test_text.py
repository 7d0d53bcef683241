import re
import sqlite3
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from arborix.functions import text as T


def values(spark, items, make, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}").orderBy("i").select(make(F.col("x"))).collect()]


def test_hash_and_path_forms(spark):
    assert values(spark, [" AB ", "", "  ", None, " cd\t"], T.clean_hash) == ["ab", None, None, None, "cd"]
    paths = ["/", "//", "/a//b/", "///x", "", None, "a///", "/a/b"]
    assert values(spark, paths, T.clean_path) == ["/", "/", "/a/b", "/x", "", None, "a", "/a/b"]


def test_path_parts(spark):
    items = ["/a/b.tar.GZ", "/x", "y", None]
    assert values(spark, items, T.parent_of) == ["/a", "", "y", None]
    assert values(spark, items, T.base_name) == ["b.tar.GZ", "x", "y", None]
    assert values(spark, items, T.extension) == ["gz", "", "", None]
    assert values(spark, items, T.path_depth) == [2, 1, 0, None]


@pytest.mark.parametrize("pattern", ["abc%", "%_b%", "A\\%", "ä%", "100%"])
def test_like_is_that_of_sqlite(spark, pattern):
    items = ["ABC", "abcd", "Ab", "a\\b", "Äx", "äx", "100% sure", "", "a_b"]
    db = sqlite3.connect(":memory:")
    want = [bool(db.execute("SELECT ? LIKE ?", (x, pattern)).fetchone()[0]) for x in items]
    assert values(spark, items, lambda c: T.sqlite_like(c, pattern)) == want


def test_week_labels_are_those_of_strftime(spark):
    days = [date(2019, 12, 25) + timedelta(n) for n in range(900)]
    assert values(spark, days, T.week_label, "date") == [d.strftime("%Y-W%W") for d in days]


def test_sizes_numbers_and_fields(spark):
    assert values(spark, [0, 1, 1023, 1536, 1024**3, None], T.human_size, "long") == ["0 B", "1 B", "1023 B", "1.5 KB", "1 GB", None]
    assert values(spark, [5102.0, None, float("nan"), -0.5], T.german_number, "double") == ["5102,00", "0,00", "0,00", "-0,50"]
    assert values(spark, ["a;b", 'say "x"', "plain", None, "l\nm"], T.csv_field) == ['"a;b"', '"say ""x"""', "plain", "", '"l\nm"']
    assert values(spark, ["a b/ü"], T.safe_name) == [re.sub("[^A-Za-z0-9._-]", "_", "a b/ü")]
    assert values(spark, ["/a/b/c/d", "a/b"], T.short_path) == ["…/b/c/d", "a/b"]
