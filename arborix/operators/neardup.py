"""Near-duplicate folders: token sets, exact and sketched pairs, ancestors, deltas."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborix.functions.text import is_under, parent_of
from arborix.runtime import materialize

# Names of files that say nothing about a folder.
NOISE_NAMES = [".DS_Store", "Thumbs.db", "desktop.ini", ".gitkeep", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "__init__.py"]
MIN_SIMILARITY = 0.8
MIN_FILES = 2
PERMUTATIONS = 64
#: Bands of four rows: a pair at the limit of 0.8 shares one with a probability of 0.9998.
BANDS = 16
#: Folders that share a band with more than so many others must share a rare token as well, which similar ones do anyway.
CROWDED = 64


def folder_tokens(index: DataFrame) -> DataFrame:
    """folder, token: the distinct hashes of each folder's own non-empty, non-noise files; files of the root are left out."""
    rows = index.filter("is_file AND hash IS NOT NULL AND hash <> '' AND size > 0").filter(~F.coalesce("name", F.lit("")).isin(NOISE_NAMES))
    return rows.select(F.coalesce("parent_path", parent_of("path")).alias("folder"), F.col("hash").alias("token")).filter("folder <> ''").distinct()


def folder_sizes(tokens: DataFrame, min_files: int = MIN_FILES) -> DataFrame:
    return tokens.groupBy("folder").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_files)


def _with_similarity(pairs: DataFrame, tokens: DataFrame, sizes: DataFrame) -> DataFrame:
    """shared_files, union_files and similarity of pairs a, b of folders, over all tokens."""
    left = pairs.join(tokens.select(F.col("folder").alias("a"), "token"), "a")
    shared = left.join(tokens.select(F.col("folder").alias("b"), "token"), ["b", "token"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared_files"))
    out = shared.join(sizes.select(F.col("folder").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("folder").alias("b"), F.col("n").alias("nb")), "b")
    union = F.col("na") + F.col("nb") - F.col("shared_files")
    return out.select(F.col("a").alias("folder_a"), F.col("b").alias("folder_b"), (F.col("shared_files") / union).alias("similarity"), "shared_files", union.alias("union_files"))


class FolderClasses(NamedTuple):
    """Folders with equal token sets as classes, for joins that never compare copies with each other."""

    #: cls (the smallest folder), n, tokens from rare to frequent, folders
    classes: DataFrame
    #: folder, cls
    members: DataFrame


def folder_classes(tokens: DataFrame, min_files: int = MIN_FILES) -> FolderClasses:
    """Classes of folders with at least min_files tokens and the same tokens."""
    frequency = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    ranked = tokens.join(frequency, "token").groupBy("folder").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t"))
    ranked = materialize(ranked.filter(F.size("t") >= min_files).select("folder", F.col("t")["token"].alias("tokens")), "token-sets")
    classes = ranked.groupBy("tokens").agg(F.min("folder").alias("cls"), F.count(F.lit(1)).alias("folders"))
    classes = materialize(classes.select("cls", F.size("tokens").cast("long").alias("n"), "tokens", "folders"), "classes")
    single = classes.filter("folders = 1").select(F.col("cls").alias("folder"), "cls")
    copies = ranked.join(classes.filter("folders > 1").select("tokens", "cls"), "tokens").select("folder", "cls")
    return FolderClasses(classes, materialize(single.unionByName(copies), "members"))


def class_pairs(classes: DataFrame, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """Pairs of classes with Jaccard similarity >= min_similarity, by prefix filtering; nothing is capped.

    Two similar sets share one of the first n - ceil(t n) + 1 tokens of each in one order of all tokens, rare ones first,
    so only those are joined, and frequent tokens hardly ever are. A pair meets at its first common prefix token only.
    Columns: folder_a < folder_b (the classes), similarity, shared_files, union_files.
    """
    keep = (F.col("n") - F.ceil(F.col("n") * min_similarity - 1e-9) + 1).cast("int")
    prefix = classes.select("cls", "n", F.slice("tokens", F.lit(1), keep).alias("head"))
    prefix = materialize(prefix.select("cls", "n", F.explode("head").alias("token")), "prefixes")
    other = prefix.select(F.col("cls").alias("b"), F.col("n").alias("nb"), "token")
    near = prefix.withColumnRenamed("cls", "a").join(other, "token").filter((F.col("a") < F.col("b")) & (F.least("n", "nb") >= F.lit(min_similarity) * F.greatest("n", "nb") - 1e-9))
    sets = classes.select("cls", "n", "tokens")
    left = near.select("a", "b").distinct().join(sets.toDF("a", "na", "ta"), "a")
    return _verified(left.join(sets.toDF("b", "nb", "tb"), "b"), min_similarity)


def _verified(both: DataFrame, min_similarity: float) -> DataFrame:
    """The similar ones of pairs a, b with their sizes na, nb and tokens ta, tb."""
    both = both.withColumn("shared_files", F.size(F.array_intersect("ta", "tb")).cast("long"))
    union = F.col("na") + F.col("nb") - F.col("shared_files")
    out = both.select(F.col("a").alias("folder_a"), F.col("b").alias("folder_b"), (F.col("shared_files") / union).alias("similarity"), "shared_files", union.alias("union_files"))
    return out.filter(F.col("similarity") >= min_similarity)


def folder_links(found: FolderClasses, pairs: DataFrame) -> DataFrame:
    """One row per folder with its class and the number of folders it is similar to, copies included: folder, cls, links."""
    sizes = found.classes.select("cls", "folders")
    ends = pairs.select(F.col("folder_a").alias("cls"), F.col("folder_b").alias("o")).unionByName(pairs.select(F.col("folder_b").alias("cls"), F.col("folder_a").alias("o")))
    outside = ends.join(sizes.toDF("o", "m"), "o").groupBy("cls").agg(F.sum("m").alias("outside"))
    links = sizes.join(outside, "cls", "left").select("cls", (F.col("folders") - 1 + F.coalesce("outside", F.lit(0))).alias("links"))
    return found.members.join(links, "cls").select("folder", "cls", "links")


def exact_pairs(tokens: DataFrame, min_similarity: float = MIN_SIMILARITY, min_files: int = MIN_FILES) -> DataFrame:
    """All pairs of folders with Jaccard similarity >= min_similarity, copies expanded into pairs in a last join.

    Where folders have very many copies, class_pairs() with folder_links() says the same in one row a folder.
    """
    found = folder_classes(tokens, min_files)
    return _folder_pairs(found, class_pairs(found.classes, min_similarity))


def _folder_pairs(found: FolderClasses, pairs: DataFrame) -> DataFrame:
    """Pairs of folders from those of classes, and those of copies."""
    m, figures = found.members, ["similarity", "shared_files", "union_files"]
    across = pairs.join(m.toDF("x", "folder_a"), "folder_a").join(m.toDF("y", "folder_b"), "folder_b").select("x", "y", *figures)
    equal = found.classes.filter("folders > 1").select("cls", F.lit(1.0).alias("similarity"), F.col("n").alias("shared_files"), F.col("n").alias("union_files"))
    within = equal.join(m.toDF("x", "cls"), "cls").join(m.toDF("y", "cls"), "cls").filter("x < y").select("x", "y", *figures)
    return across.unionByName(within).select(F.least("x", "y").alias("folder_a"), F.greatest("x", "y").alias("folder_b"), *figures)


def minhash(tokens: DataFrame, permutations: int = PERMUTATIONS) -> DataFrame:
    """folder, signature: the smallest seeded hash of a folder's tokens for each permutation, combined before the shuffle."""
    seeds = [F.min(F.xxhash64("token", F.lit(i))).alias(f"h{i}") for i in range(permutations)]
    return tokens.groupBy("folder").agg(*seeds).select("folder", F.array(*[f"h{i}" for i in range(permutations)]).alias("signature"))


def sketched_pairs(tokens: DataFrame, min_similarity: float = MIN_SIMILARITY, min_files: int = MIN_FILES, permutations: int = PERMUTATIONS, bands: int = BANDS) -> DataFrame:
    """Pairs that share a band of their MinHash signatures, verified exactly; a pair at the limit is missed with a probability of 0.0002.

    Pairs whose smaller folder has few files (up to 8 at 0.8) are never missed. Copies are one class, and tokens are numbers, so that pairs of paths are made only in the last join.
    """
    numbers = materialize(tokens.select("token").distinct().withColumn("number", F.monotonically_increasing_id()), "numbers")
    numbered = materialize(tokens.join(numbers, "token").select("folder", F.col("number").alias("token")), "numbered")
    found = folder_classes(numbered, min_files)
    return _folder_pairs(found, sketched_class_pairs(found.classes, min_similarity, permutations, bands))


def sketched_class_pairs(classes: DataFrame, min_similarity: float = MIN_SIMILARITY, permutations: int = PERMUTATIONS, bands: int = BANDS) -> DataFrame:
    """Pairs of classes that share a band, with the columns of class_pairs(); their tokens are numbers.

    Sets that reach the limit with equal ones only are left out. Where one token at the rare end of the smaller set decides
    (up to 8 tokens at 0.8), sets meet at that token and no pair is missed; larger ones meet in bands. A parity sketch differs in at most as many bits as two
    sets differ in tokens, so it rejects no similar pair. Frequent tokens crowd bands with sets that are not similar: in a
    crowded band two sets must also share a token at the rare end of both, as in class_pairs(), where the smaller set
    needs the shorter end.
    """
    n, t = F.col("n"), F.lit(min_similarity)
    sketch = F.expr("aggregate(tokens, 0L, (s, t) -> s ^ shiftleft(1L, cast(pmod(xxhash64(t), 64) AS int)))")
    sets = materialize(classes.filter(n >= t * (n + 1) - 1e-9).select(F.monotonically_increasing_id().alias("id"), "cls", "n", "tokens", sketch.alias("sketch")), "sets")
    rows = max(1, permutations // bands)
    keys = F.array(*[F.xxhash64(F.lit(b), F.slice("signature", b * rows + 1, rows)) for b in range(bands)])
    small = F.ceil(t * n - 1e-9)
    alone = lambda size: size - F.ceil(2 * t / (1 + t) * size - 1e-9) == 0
    signed = minhash(sets.filter(~alone(n)).select(F.col("id").alias("folder"), F.explode("tokens").alias("token")), permutations).select(F.col("folder").alias("id"), keys.alias("bands"))
    signed = materialize(signed.join(sets.select("id", "n", "sketch"), "id"), "signed")
    banded = signed.select("id", "n", "sketch", F.explode("bands").alias("band"))
    crowds = banded.groupBy("band").agg(F.count(F.lit(1)).alias("crowd")).filter("crowd > 1")
    banded = materialize(banded.join(crowds, "band"), "bands")

    def met(small: DataFrame, large: DataFrame, *on: str) -> DataFrame:
        other = large.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"), *on)
        order = (n < F.col("nb")) | ((n == F.col("nb")) & (F.col("a") < F.col("b")))
        differ = F.bit_count(F.col("sketch").bitwiseXOR(F.col("sb"))) <= (n + F.col("nb")) * (1 - t) / (1 + t) + 1e-9
        return small.withColumnRenamed("id", "a").join(other, list(on)).filter(order & (n >= t * F.col("nb") - 1e-9) & differ).select("a", "b")

    few = banded.filter(F.col("crowd") <= CROWDED)
    many = banded.filter(F.col("crowd") > CROWDED).join(sets.select("id", "tokens"), "id")

    def rare(of: DataFrame, needed: Column, *also: str) -> DataFrame:
        """The tokens of which two sets with so many tokens in common share one."""
        return of.select("id", "n", "sketch", *also, F.explode(F.slice("tokens", F.lit(1), (n - F.ceil(needed - 1e-9) + 1).cast("int"))).alias("token"))

    near = met(few, few, "band").unionByName(met(rare(many, 2 * t / (1 + t) * n, "band"), rare(many, t * n, "band"), "band", "token"))
    near = near.unionByName(met(rare(sets.filter(alone(n)), 2 * t / (1 + t) * n), rare(sets.filter(alone(small)), t * n), "token")).distinct()
    left = near.join(sets.select("id", "cls", "n", "tokens").toDF("a", "ca", "na", "ta"), "a")
    both = left.join(sets.select("id", "cls", "n", "tokens").toDF("b", "cb", "nb", "tb"), "b")
    return _verified(both.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"), "na", "nb", "ta", "tb"), min_similarity)


def near_duplicates(tokens: DataFrame, strategy: str = "exact", **params) -> DataFrame:
    return {"exact": exact_pairs, "sketched": sketched_pairs}[strategy](tokens, **params)


def collapsed(pairs: DataFrame, tokens: DataFrame, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """Pairs moved up to their highest ancestors that are still similar.

    Both sides climb in step while both parents are folders with tokens, differ, do not contain each other and are
    similar enough; pairs that end at the same two folders become one. Parents may have fewer files than a pair needs.
    A path without a slash has no parent. Every round shortens the paths, so the climb ends however deep they are.
    """
    sizes = folder_sizes(tokens, 1)
    known = sizes.select("folder")
    current = materialize(pairs.select("folder_a", "folder_b", "similarity", "shared_files", "union_files"), "climb")
    done = None
    while True:
        step = current.withColumn("pa", parent_of("folder_a")).withColumn("pb", parent_of("folder_b"))
        top = (F.col("pa") == F.col("folder_a")) | (F.col("pb") == F.col("folder_b"))
        crossing = top | (F.col("pa") == F.col("folder_b")) | (F.col("pb") == F.col("folder_a"))
        may = step.filter((F.col("pa") != F.col("pb")) & ~crossing & ~is_under(F.col("pa"), F.col("pb")) & ~is_under(F.col("pb"), F.col("pa")))
        wanted = may.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        wanted = wanted.join(known.withColumnRenamed("folder", "a"), "a", "left_semi").join(known.withColumnRenamed("folder", "b"), "b", "left_semi")
        above = _with_similarity(wanted, tokens, sizes).filter(F.col("similarity") >= min_similarity)
        above = above.select(F.col("folder_a").alias("x"), F.col("folder_b").alias("y"), F.struct("similarity", "shared_files", "union_files").alias("up"))
        joined = step.withColumn("x", F.least("pa", "pb")).withColumn("y", F.greatest("pa", "pb")).join(above, ["x", "y"], "left")
        blocked = crossing | is_under(F.col("pa"), F.col("pb")) | is_under(F.col("pb"), F.col("pa"))
        joined = materialize(joined.withColumn("up", F.when(~blocked, F.col("up"))), "climbed")
        stay = joined.filter("up IS NULL").select(*current.columns)
        done = stay if done is None else done.unionByName(stay)
        moved = joined.filter("up IS NOT NULL").select(F.col("x").alias("folder_a"), F.col("y").alias("folder_b"), "up.*").distinct()
        if moved.isEmpty():
            break
        current = materialize(moved, "climb")
    # two of the same unordered pair have the same figures
    return done.distinct()


def stored_pairs(pairs: DataFrame) -> DataFrame:
    """Match results as a table with unique pairs: folder_a < folder_b, the result with the latest update of each pair."""
    ok = pairs.filter("folder_a IS NOT NULL AND folder_b IS NOT NULL AND folder_a <> folder_b")
    latest = ok.groupBy(F.least("folder_a", "folder_b").alias("folder_a"), F.greatest("folder_a", "folder_b").alias("folder_b")).agg(
        F.max(F.struct("updated_at", "similarity", "shared_files", "union_files")).alias("r")
    )
    return latest.select("folder_a", "folder_b", "r.similarity", "r.shared_files", "r.union_files")


def filtered_pairs(pairs: DataFrame, at_least: float = 0.0, below: float = math.inf, text: str | None = None) -> DataFrame:
    """Pairs with at_least <= similarity < below and, if given, the text in either folder; most similar first."""
    out = pairs.filter((F.col("similarity") >= at_least) & (F.col("similarity") < below))
    if text:
        like = f"%{text.lower()}%"
        out = out.filter(F.lower("folder_a").like(like) | F.lower("folder_b").like(like))
    return out.orderBy(F.desc("similarity"), F.desc("shared_files"), "folder_a", "folder_b")


def deltas(pairs: DataFrame, index: DataFrame) -> DataFrame:
    """What differs between the direct files of the two folders of each pair, by file name.

    Columns: folder_a, folder_b, name, status (only_a, only_b, changed, identical), size (the larger) and hash; a missing
    hash is ''. A changed file shows both hashes.
    """
    files = index.filter("is_file").select(F.coalesce("parent_path", parent_of("path")).alias("folder"), "name", "size", F.coalesce("hash", F.lit("")).alias("hash"))
    files = files.groupBy("folder", "name").agg(F.max(F.struct("hash", "size")).alias("f"))
    p = pairs.select("folder_a", "folder_b").distinct()
    a = p.join(files.withColumnRenamed("folder", "folder_a"), "folder_a").select("folder_a", "folder_b", "name", F.col("f").alias("fa"))
    b = p.join(files.withColumnRenamed("folder", "folder_b"), "folder_b").select("folder_a", "folder_b", "name", F.col("f").alias("fb"))
    both = a.join(b, ["folder_a", "folder_b", "name"], "full_outer")
    status = F.when(F.col("fb").isNull(), "only_a").when(F.col("fa").isNull(), "only_b").when(F.col("fa.hash") == F.col("fb.hash"), "identical").otherwise("changed")
    out = both.withColumn("status", status)
    hash_ = F.when(F.col("status") == "changed", F.concat("fa.hash", F.lit(" → "), "fb.hash")).otherwise(F.coalesce("fa.hash", "fb.hash"))
    return out.select("folder_a", "folder_b", "name", "status", F.greatest("fa.size", "fb.size").alias("size"), hash_.alias("hash"))


def delta_summary(delta: DataFrame) -> DataFrame:
    kinds = ["only_a", "only_b", "changed", "identical"]
    return delta.groupBy("folder_a", "folder_b").agg(*[F.count_if(F.col("status") == k).alias(k) for k in kinds])

