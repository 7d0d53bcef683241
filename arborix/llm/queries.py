"""Queries of the training-data problems, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborix.llm.canonical import look_alike_pairs, with_canonical
from arborix.llm.leakage import leaks, without_leaks
from arborix.llm.linking import folder_links, linked_groups
from arborix.llm.mixing import mix
from arborix.llm.representative import best_records, survivors, true_values
from arborix.llm.set_pairs import record_links, similar_record_pairs
from arborix.llm.toxicity import scored, source_rates
from arborix.runtime import load


#: A public vocabulary, read where the library is installed.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of folders whose token sets reach a Jaccard similarity of 0.8."""
    pairs = similar_record_pairs(load(spark, sf_dir, "folder_sets"), "path", "token_set")
    return pairs.select(F.col("record_a").alias("folder_a"), F.col("record_b").alias("folder_b"))


def p1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of p1_found with similarity, shared_files and union_files."""
    pairs = similar_record_pairs(load(spark, sf_dir, "folder_sets"), "path", "token_set")
    return pairs.toDF("folder_a", "folder_b", "similarity", "shared_files", "union_files").withColumn("similarity", F.round("similarity", 9))


def p1_folder_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each folder of at least two tokens with its class of equal sets and its number of links."""
    return record_links(load(spark, sf_dir, "folder_sets"), "path", "token_set").toDF("path", "class_path", "links")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record whose path survives and the one whose modification time survives, for each duplicate hash."""
    return best_records(load(spark, sf_dir, "files"))


def p3_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving record of each duplicate hash, built field by field from the claims judged true."""
    return survivors(load(spark, sf_dir, "files"))


def p3_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name and size claimed in a duplicate group, its posterior truth, and whether it is kept."""
    return true_values(load(spark, sf_dir, "files")).values


def p3_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value judged true with its posterior: the fields of the survivors, whole."""
    return p3_truth(spark, sf_dir).filter("kept").drop("kept")


def p3_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensitivity and specificity of each volume."""
    return true_values(load(spark, sf_dir, "files")).sources


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each linked folder with the smallest folder of its group."""
    links = folder_links(load(spark, sf_dir, "near_duplicate_folder_pairs"))
    return linked_groups(links, "a", "b").select(F.col("node").alias("folder_path"), F.col("root").alias("group_folder"))


def p4_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders per group."""
    return p4_found(spark, sf_dir).groupBy("group_folder").agg(F.count(F.lit(1)).alias("folders"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of ids whose names or paths look the same and differ in characters."""
    names = look_alike_pairs(load(spark, sf_dir, "file_names"), "id", "name")
    paths = look_alike_pairs(load(spark, sf_dir, "files"), "id", "path")
    return names.select(F.lit("name").alias("field"), "id_a", "id_b").unionByName(paths.select(F.lit("path").alias("field"), "id_a", "id_b"))


def p5_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name with its canonical form."""
    return with_canonical(load(spark, sf_dir, "file_names"), "name", "canonical", ["id", "name"])


def p5_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every path with its canonical form: paths of one form are a class."""
    return with_canonical(load(spark, sf_dir, "files").select("id", "path").distinct(), "path", "canonical", ["id", "path"])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a run of at least 20 words of an item, and the item."""
    return leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p6_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaks of p6_found with run lengths and coverage."""
    return leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items"))


def p6_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the spans it shares with items."""
    return without_leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items"))


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of documents at the shares of source_targets, block by block."""
    return mix(load(spark, sf_dir, "documents"), load(spark, sf_dir, "source_targets"), TOKENIZER).blocks


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares wanted and reached, by source."""
    return mix(load(spark, sf_dir, "documents"), load(spark, sf_dir, "source_targets"), TOKENIZER).shares


def p7_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of p7_shares that does not depend on tokens: share stated, share to reach, repeats."""
    return p7_shares(spark, sf_dir).select("source", "stated_share", F.round("target_share", 9).alias("target_share"), "max_repeats")


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its score."""
    return scored(load(spark, sf_dir, "documents"), load(spark, sf_dir, "review_labels"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an abusive, hateful or sexually explicit passage."""
    return p8_scores(spark, sf_dir).filter("abusive").select("doc_id").distinct()


def p8_source_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of such documents by source."""
    return source_rates(p8_scores(spark, sf_dir))


_SETS = """
tok AS (SELECT DISTINCT path, t FROM (SELECT path, unnest(token_set) AS t FROM folder_sets) WHERE path IS NOT NULL AND t IS NOT NULL),
sized AS (SELECT path, count(*) AS n FROM tok GROUP BY path HAVING count(*) >= 2),
inter AS (SELECT a.path AS pa, b.path AS pb, count(*) AS shared FROM tok a JOIN tok b ON a.t = b.t AND a.path < b.path GROUP BY 1, 2),
sim AS (SELECT pa, pb, shared, x.n + y.n - shared AS united FROM inter JOIN sized x ON x.path = pa JOIN sized y ON y.path = pb
        WHERE shared >= 0.8 * (x.n + y.n - shared))
"""

_LINKS = r"""
links AS (
  SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM (
    SELECT nullif(CASE WHEN regexp_replace(folder_a, '/+', '/', 'g') = '/' THEN '/' ELSE regexp_replace(regexp_replace(folder_a, '/+', '/', 'g'), '/$', '') END, '') AS a,
           nullif(CASE WHEN regexp_replace(folder_b, '/+', '/', 'g') = '/' THEN '/' ELSE regexp_replace(regexp_replace(folder_b, '/+', '/', 'g'), '/$', '') END, '') AS b
    FROM near_duplicate_folder_pairs WHERE similarity >= 0.8)
  WHERE a <> b),
ends AS (SELECT a AS x, b AS y FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT x AS node, x AS seen FROM ends UNION SELECT r.node, b.y FROM reach r JOIN ends b ON r.seen = b.x),
grouped AS (SELECT node AS folder_path, min(seen) AS group_folder FROM reach GROUP BY node)
"""

QUERIES = {
    "p1_found": p1_found,
    "p1_pairs": p1_pairs,
    "p1_folder_links": p1_folder_links,
    "p3_found": p3_found,
    "p3_survivors": p3_survivors,
    "p3_truth": p3_truth,
    "p3_kept": p3_kept,
    "p3_sources": p3_sources,
    "p4_found": p4_found,
    "p4_group_sizes": p4_group_sizes,
    "p5_found": p5_found,
    "p5_names": p5_names,
    "p5_paths": p5_paths,
    "p6_found": p6_found,
    "p6_leaks": p6_leaks,
    "p6_cleaned": p6_cleaned,
    "p7_mixture": p7_mixture,
    "p7_shares": p7_shares,
    "p7_targets": p7_targets,
    "p8_found": p8_found,
    "p8_scores": p8_scores,
    "p8_source_rates": p8_source_rates,
}
SQL = {
    "p1_found": f"WITH {_SETS} SELECT pa AS folder_a, pb AS folder_b FROM sim",
    "p1_pairs": f"WITH {_SETS} SELECT pa AS folder_a, pb AS folder_b, round(shared / united, 9) AS similarity, shared AS shared_files, united AS union_files FROM sim",
    "p1_folder_links": f"""WITH {_SETS},
ends AS (SELECT pa AS p FROM sim UNION ALL SELECT pb FROM sim),
linked AS (SELECT p, count(*) AS links FROM ends GROUP BY p),
sets AS (SELECT path, list_sort(list(t)) AS s FROM tok GROUP BY path HAVING count(*) >= 2)
SELECT path, min(path) OVER (PARTITION BY s) AS class_path, coalesce(links, 0) AS links FROM sets LEFT JOIN linked ON p = path""",
    "p3_found": r"""WITH r AS (
  SELECT nullif(lower(regexp_replace(hash, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), '') AS h, id, coalesce(is_file, false) AS f, traverse_error IS NULL AS e,
         coalesce(modified > 0 AND modified <= 1782864000, false) AS u, CASE WHEN modified > 0 AND modified <= 1782864000 THEN modified END AS m FROM files),
p AS (SELECT h, id, row_number() OVER (PARTITION BY h ORDER BY f DESC, e DESC, u DESC, coalesce(m, 0) DESC, id) AS k FROM r WHERE h IS NOT NULL AND id IS NOT NULL),
t AS (SELECT h, id, row_number() OVER (PARTITION BY h ORDER BY m DESC, id) AS k FROM r WHERE u AND h IS NOT NULL AND id IS NOT NULL)
SELECT p.h AS hash, p.id AS path_id, coalesce(t.id, -1) AS modified_id FROM p LEFT JOIN t ON t.h = p.h AND t.k = 1
WHERE p.k = 1 AND p.h IN (SELECT h FROM r GROUP BY h HAVING count(DISTINCT id) > 1)""",
    "p7_targets": """WITH listed AS (
  SELECT source, CASE WHEN target_share > 0 AND NOT isnan(target_share) THEN target_share ELSE 0 END AS w, coalesce(max_repeats, 1) AS r FROM source_targets WHERE source IS NOT NULL),
best AS (SELECT source, w, r FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY w DESC, r DESC) AS k FROM listed) WHERE k = 1),
usable AS (SELECT sum(w) AS total FROM best WHERE r > 0 AND source IN (SELECT source FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL))
SELECT source, w AS stated_share, round(CASE WHEN w > 0 AND r > 0 AND source IN (SELECT source FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL) THEN w / total ELSE 0 END, 9) AS target_share, greatest(r, 0) AS max_repeats
FROM best, usable""",
    "p4_found": f"WITH RECURSIVE {_LINKS} SELECT folder_path, group_folder FROM grouped",
    "p4_group_sizes": f"WITH RECURSIVE {_LINKS} SELECT group_folder, count(*) AS folders FROM grouped GROUP BY 1",
}
