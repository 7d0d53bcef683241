"""Queries over the file index and its companions, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborix.functions import text as T
from arborix.operators import dashboard, duplicates, folders, index, logs, merge, neardup, reconcile, snapshots, tree
from arborix.runtime import load, materialize, shared_dir
from arborix.sources import files as file_source
from arborix.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

HASH = r"nullif(lower(regexp_replace(hash, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), '')"
IDX = f"""idx AS (SELECT * EXCLUDE (k, hash), {HASH} AS hash FROM (
  SELECT *, row_number() OVER (PARTITION BY path ORDER BY id DESC) AS k FROM files WHERE path IS NOT NULL) WHERE k = 1)"""
DUP = "dup AS (SELECT hash FROM idx WHERE hash IS NOT NULL GROUP BY hash HAVING count(*) > 1)"
FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def idx(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """The current index, only with the named columns besides the path if any are named."""
    return index.current_index(load(spark, sf, "files"), list(columns) or None)


# --- search, sorting, paging


_COLUMNS = ", ".join(index.COLUMNS)


@query(f"WITH {IDX} SELECT {_COLUMNS} FROM idx")
def current_index(spark, sf):
    """The current index: the latest record of each path."""
    return idx(spark, sf)


def _search(name: str, text: str, pattern: str, target: str, where: str) -> None:
    like = {"exact": text, "starts": text + "%", "ends": "%" + text, "contains": "%" + text + "%"}[pattern]

    @query(f"WITH {IDX} SELECT path, name, size FROM idx WHERE {FOLD.format('name')} LIKE '{like.lower()}' AND {where}", name)
    def run(spark, sf):
        return index.search(idx(spark, sf, "name", "size", "is_directory", "is_file"), text, pattern, target).select("path", "name", "size")

    run.__doc__ = f"Name search: {pattern} '{text}' among {target}; links count as files and as folders, not as both."


_search("search_exact", "ReadMe.md", "exact", "files", "(NOT is_directory OR is_file)")
_search("search_starts", "20", "starts", "folders", "(is_directory OR NOT is_file)")
_search("search_ends", ".PDF", "ends", "both", "(is_directory OR is_file)")
_search("search_contains", "IN_OI", "contains", "files", "(NOT is_directory OR is_file)")


@query(f"WITH {IDX} SELECT path, size FROM idx WHERE {FOLD.format('name')} LIKE '%.jpg' AND (NOT is_directory OR is_file) ORDER BY size DESC NULLS LAST, path LIMIT 50 OFFSET 50")
def search_page(spark, sf):
    """The second page of fifty of a search, largest first."""
    found = index.search(idx(spark, sf, "name", "size", "is_directory", "is_file"), ".jpg", "ends", "files").select("path", "size")
    return index.page(index.ordered(found, "size", True, ["path"]), 2, 50)


@query(f"WITH {IDX} SELECT target, count(*) AS total, CAST(ceil(count(*) / 50) AS BIGINT) AS pages FROM idx, (SELECT unnest(['files', 'folders', 'both']) AS target) "
       "WHERE CASE target WHEN 'files' THEN NOT is_directory OR is_file WHEN 'folders' THEN is_directory OR NOT is_file ELSE is_directory OR is_file END GROUP BY target")  # fmt: skip
def search_totals(spark, sf):
    """Totals and pages of the empty search, by target, with the predicate that its pages use."""
    i = idx(spark, sf, "is_directory", "is_file")
    kinds = F.array(*[F.when(index.kind_filter(t), F.lit(t)) for t in ("files", "folders", "both")])
    per = i.select(F.explode(kinds).alias("target")).filter("target IS NOT NULL").groupBy("target").agg(F.count(F.lit(1)).alias("total"))
    return per.withColumn("pages", index.page_count(F.col("total"), 50))


@query(f"WITH {IDX} SELECT path FROM idx WHERE contains(lower(path), 'übersicht')")
def search_path(spark, sf):
    """Paths that hold a text in any case."""
    return index.path_search(idx(spark, sf, "id"), "Übersicht").select("path")


@query(f"WITH {IDX} SELECT path, name FROM idx ORDER BY lower(name), name, path LIMIT 100")
def listing_folded(spark, sf):
    """The first hundred entries of the listing by name in lower case."""
    return index.listing(idx(spark, sf, "name"), "folded").select("path", "name").limit(100)


@query(f"WITH {IDX} SELECT path, row_number() OVER (ORDER BY lower(name) NULLS FIRST, name NULLS FIRST, path) AS position FROM idx")
def listing_folded_all(spark, sf):
    """The whole listing by name in lower case: every entry with its position."""
    return index.positions(index.listing(idx(spark, sf, "name"), "folded").select("path"))


@query(f"WITH {IDX} SELECT path, row_number() OVER (ORDER BY name NULLS FIRST, path) AS position FROM idx")
def listing_cased_all(spark, sf):
    """The whole listing by name: every entry with its position."""
    return index.positions(index.listing(idx(spark, sf, "name"), "cased").select("path"))


@query(f"WITH {IDX} SELECT path, row_number() OVER (ORDER BY is_directory NULLS FIRST, is_file NULLS FIRST, is_symlink NULLS FIRST, path) AS position FROM idx")
def listing_default_all(spark, sf):
    """The whole listing by kind, then path: every entry with its position."""
    return index.positions(index.listing(idx(spark, sf, "is_directory", "is_file", "is_symlink"), "default").select("path"))


@query(f"""WITH {IDX} SELECT path, lower(regexp_extract(name, '\\.([^.]*)$', 1)) AS extension, length(path) - length(replace(path, '/', '')) AS depth,
  regexp_replace(name, '[^A-Za-z0-9._-]', '_', 'g') AS safe, regexp_replace(path, '/[^/]*$', '') AS parent, regexp_extract(path, '[^/]*$') AS base,
  replace(printf('%.2f', coalesce(size, 0) / 4.0::DOUBLE), '.', ',') AS quarter FROM idx""")
def path_functions(spark, sf):
    """Extension, depth, safe name, parent, base name and a number in German form for every entry."""
    return idx(spark, sf, "name", "size").select(
        "path", T.extension("name").alias("extension"), T.path_depth("path").alias("depth"), T.safe_name(F.col("name")).alias("safe"), T.parent_of("path").alias("parent"),
        T.base_name("path").alias("base"), T.german_number(F.coalesce("size", F.lit(0)) / 4.0).alias("quarter"),
    )


_SIZE = "CASE WHEN size IS NULL THEN NULL " + " ".join(
    f"WHEN abs(size) >= {1024**p}::DOUBLE THEN regexp_replace(printf('%.2f', round(size / {1024**p}::DOUBLE, 2)), '\\.?0+$', '') || ' {u}'" for p, u in reversed(list(enumerate(["B", "KB", "MB", "GB", "TB", "PB"])))
) + " ELSE '0 B' END"


def _short_sql(keep: int) -> str:
    parts = "string_split(path, '/')"
    return f"CASE WHEN len({parts}) > {keep} THEN '…/' || array_to_string({parts}[-{keep}:], '/') ELSE path END"


@query(f"WITH {IDX} SELECT path, {_SIZE} AS size_label, {_short_sql(3)} AS short_path, {_short_sql(2)} AS shorter_path FROM idx")
def size_labels(spark, sf):
    """Human sizes and paths cut to their last three and two parts, of every entry."""
    return idx(spark, sf, "size").select("path", T.human_size("size").alias("size_label"), T.short_path("path").alias("short_path"), T.short_path("path", 2).alias("shorter_path"))


def _kinds_sql() -> str:
    return " ".join(f"WHEN e IN ({', '.join(repr(x) for x in xs)}) THEN '{k}'" for k, xs in file_source.FILE_KINDS.items())


@query(f"WITH {IDX}, x AS (SELECT *, lower(regexp_extract(name, '\\.([^.]*)$', 1)) AS e FROM idx WHERE is_file) SELECT CASE {_kinds_sql()} ELSE 'other' END AS kind, count(*) AS files, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM x GROUP BY 1")
def file_kinds(spark, sf):
    """Files and bytes by the first kind of content their extension belongs to."""
    ext = T.extension("name")
    kind = F.lit("other")
    for name, members in reversed(file_source.FILE_KINDS.items()):
        kind = F.when(ext.isin(members), F.lit(name)).otherwise(kind)
    return idx(spark, sf, "name", "size", "is_file").filter("is_file").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


@query(f"""WITH {IDX}, x AS (SELECT lower(regexp_extract(name, '\\.([^.]*)$', 1)) AS e FROM idx WHERE is_file)
SELECT CASE WHEN e IN ({', '.join(repr(x) for x in file_source.TEXT_EXTENSIONS)}) THEN 'text/plain; charset=utf-8' {' '.join(f"WHEN e = '{k}' THEN '{v}'" for k, v in file_source.MEDIA_TYPES.items())}
 ELSE 'application/octet-stream' END AS media_type, count(*) AS files FROM x GROUP BY 1""")
def media_types(spark, sf):
    """Files by media type."""
    return idx(spark, sf, "name", "is_file").filter("is_file").groupBy(file_source.media_type(T.extension("name")).alias("media_type")).agg(F.count(F.lit(1)).alias("files"))


# --- exact duplicates


@query(f"WITH {IDX}, {DUP} SELECT hash FROM dup")
def dup_hashes(spark, sf):
    """Hashes of more than one path."""
    return duplicates.duplicate_hashes(idx(spark, sf, "hash"))


@query(f"WITH {IDX}, {DUP} SELECT path, hash, size FROM idx WHERE hash IN (SELECT hash FROM dup)")
def dup_files(spark, sf):
    """Every entry with a duplicate hash, links included."""
    return duplicates.duplicate_files(idx(spark, sf, "hash", "size")).select("path", "hash", "size")


_GROUPS = "g AS (SELECT hash, count(*) AS copies, min(size) AS size, min(path) AS first_path, (count(*) - 1) * coalesce(min(size), 0) AS wasted_bytes FROM idx WHERE hash IS NOT NULL GROUP BY hash HAVING count(*) > 1)"


@query(f"WITH {IDX}, {_GROUPS} SELECT * FROM g")
def dup_groups_wasted(spark, sf):
    """Duplicate groups with copies, size and wasted bytes."""
    return duplicates.duplicate_groups(idx(spark, sf, "hash", "size"))


@query(f"WITH {IDX}, {_GROUPS} SELECT * FROM g ORDER BY wasted_bytes DESC, hash LIMIT 50")
def dup_groups_page(spark, sf):
    """The first page of duplicate groups, most wasted bytes first."""
    groups = duplicates.duplicate_groups(idx(spark, sf, "hash", "size"))
    return index.page(index.ordered(groups, "wasted_bytes", True, ["hash"], ("wasted_bytes", "size", "copies", "hash")), 1, 50)


@query(f"""WITH {IDX} SELECT hash, count(*) AS copies, min(size) AS size, (count(*) - 1) * coalesce(min(size), 0) AS wasted_bytes FROM idx WHERE hash IS NOT NULL GROUP BY hash
HAVING count(*) > 1 AND bool_or(contains(lower(name), 'invoice') OR contains(lower(path), 'invoice')) AND coalesce(bool_or(size >= 1000), false)
   AND bool_or(lower(regexp_extract(name, '\\.([^.]*)$', 1)) IN ('pdf', 'docx', 'csv'))""")
def dup_groups_filtered(spark, sf):
    """Duplicate groups with a member for each of three conditions: text, least size, extension."""
    return duplicates.filtered_groups(idx(spark, sf, "hash", "size", "name"), "Invoice", 1000, ["pdf", "docx", "csv"])


_STATS = "SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS duplicates, count(*) AS groups, CAST(coalesce(sum((n - 1) * size), 0) AS BIGINT) AS wasted_bytes FROM (SELECT hash, count(*) AS n, min(size) AS size FROM idx WHERE {} AND hash IN (SELECT hash FROM dup) GROUP BY hash)"


@query(f"WITH {IDX}, {DUP} {_STATS.format('is_file')}")
def dup_stats(spark, sf):
    """Duplicate files, groups and wasted bytes."""
    return duplicates.duplicate_stats(idx(spark, sf, "hash", "size", "is_file"))


@query(f"WITH {IDX}, {DUP} {_STATS.format('is_directory')}")
def dup_folder_stats(spark, sf):
    """The same for directories, which have no hash: all zero."""
    return duplicates.duplicate_stats(idx(spark, sf, "hash", "size", "is_directory"), "is_directory")


@query(f"WITH {IDX} SELECT coalesce(hash, '<no hash>') AS hash, count(*) AS n, min(path) AS first_path FROM idx GROUP BY 1")
def entries_by_hash(spark, sf):
    """Entries by hash, those without one together."""
    return duplicates.by_hash(idx(spark, sf, "hash"))


@query(f"WITH {IDX} SELECT parent_path, name, path, size, hash, hash IS NOT NULL AND hash IN (SELECT hash FROM duplicate_hashes) AS is_duplicate FROM idx WHERE is_file")
def folder_files_flagged(spark, sf):
    """All files with a flag from the stored list of duplicate hashes."""
    return duplicates.flagged_files(idx(spark, sf, "parent_path", "name", "size", "hash", "is_file"), load(spark, sf, "duplicate_hashes"))


@query(f"WITH {IDX}, {DUP} SELECT DISTINCT lower(regexp_extract(name, '\\.([^.]*)$', 1)) AS extension FROM idx WHERE is_file AND hash IN (SELECT hash FROM dup) AND strlen(lower(regexp_extract(name, '\\.([^.]*)$', 1))) BETWEEN 1 AND 16")
def extensions_of_duplicates(spark, sf):
    """Extensions of duplicate files."""
    return duplicates.duplicate_extensions(idx(spark, sf, "hash", "name", "is_file"))


@query(f"""WITH {IDX}, r AS (SELECT * FROM idx WHERE is_file AND hash IS NOT NULL AND parent_path IN ('/mnt/vol-000', '/mnt/vol-001'))
SELECT hash, count(*) AS files, min(name) AS first_name, arg_max(name, path) FILTER (parent_path = '/mnt/vol-000') AS folder_0, arg_max(name, path) FILTER (parent_path = '/mnt/vol-001') AS folder_1 FROM r GROUP BY hash""")
def aligned_compare(spark, sf):
    """Two folders side by side, by hash."""
    return duplicates.aligned(idx(spark, sf, "hash", "name", "is_file", "parent_path"), ["/mnt/vol-000", "/mnt/vol-001"])


# --- groups of folders

_PLACES = f"{IDX}, {DUP}, places AS (SELECT regexp_replace(path, '/[^/]*$', '') AS folder, hash, size FROM idx WHERE NOT is_directory AND hash IN (SELECT hash FROM dup))"


_GROUPS_SQL = """edges AS (SELECT DISTINCT '0' || folder AS a, '1' || hash AS b FROM places), ends AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges),
cc(node, label) USING KEY (node) AS (SELECT DISTINCT a, a FROM ends UNION
  SELECT e.b, min(cc.label) FROM cc JOIN ends e ON e.a = cc.node JOIN recurring.cc AS r ON r.node = e.b WHERE cc.label < r.label GROUP BY e.b),
comp AS (SELECT substr(node, 2) AS folder, substr(label, 2) AS "group" FROM cc WHERE node[1] = '0')"""
_GROUP_ROWS = """m AS (SELECT folder, "group", count(*) OVER (PARTITION BY "group") AS folders FROM comp),
u AS (SELECT "group", hash, count(*) AS n, any_value(folders) AS folders FROM places JOIN m USING (folder) GROUP BY 1, 2),
sh AS (SELECT "group", count(*) AS shared FROM u WHERE n = folders GROUP BY 1), pf AS (SELECT folder, count(*) AS file_count, min(greatest(coalesce(size, 0), 0)) AS min_size FROM places GROUP BY 1)
SELECT "group" AS group_id, folder AS folder_path, regexp_extract(folder, '[^/]*$') AS folder_name, coalesce(shared, 0) AS shared_count, file_count, min_size
FROM m JOIN pf USING (folder) LEFT JOIN sh USING ("group") WHERE folders > 1"""


def _components(spark, sf):
    places = materialize(folders.duplicate_places(idx(spark, sf, "hash", "size", "is_directory")), "places")
    return places, materialize(folders.folder_components(places), "components")


@query(f'WITH RECURSIVE {_PLACES}, {_GROUPS_SQL} SELECT folder, "group" FROM comp')
def folder_components(spark, sf):
    """Folders linked by shared duplicate hashes, with the smallest folder of their group."""
    return _components(spark, sf)[1]


@query(f"WITH RECURSIVE {_PLACES}, {_GROUPS_SQL}, {_GROUP_ROWS}")
def folder_groups(spark, sf):
    """Groups of at least two linked folders with shared, file and size figures."""
    return folders.folder_groups(*_components(spark, sf))


@query(f"WITH RECURSIVE {_PLACES}, {_GROUPS_SQL}, g AS (WITH {_GROUP_ROWS}) SELECT *, 'group_' || dense_rank() OVER (ORDER BY group_id) AS group_name FROM g")
def folder_groups_named(spark, sf):
    """The same groups with numbered names."""
    return folders.numbered_groups(folders.folder_groups(*_components(spark, sf)))


@query(f'WITH RECURSIVE {_PLACES}, {_GROUPS_SQL} SELECT folder, "group" FROM comp')
def folder_groups_incremental(spark, sf):
    """Groups kept up to date: the last run saw the first record of each path, folders of later records are regrouped."""
    first = load(spark, sf, "files").filter("path IS NOT NULL")
    rest = [c for c in index.COLUMNS if c != "path"]
    before = first.groupBy("path").agg(F.min_by(F.struct(*rest), "id").alias("r")).select("path", "r.*").withColumn("hash", T.clean_hash("hash")).select(*index.COLUMNS)
    old_places = materialize(folders.duplicate_places(before), "old-places")
    old = materialize(folders.folder_components(old_places), "old")
    now = materialize(idx(spark, sf, "hash", "size", "is_directory"), "now")
    places = materialize(folders.duplicate_places(now), "places")
    # a changed hash moves its own folder and every folder whose file became, or stopped being, a duplicate with it
    changed = places.select("folder", "hash").exceptAll(old_places.select("folder", "hash")).unionByName(old_places.select("folder", "hash").exceptAll(places.select("folder", "hash")))
    known = places.select("folder").distinct()
    return folders.regrouped(old, places, materialize(changed.select("folder").distinct(), "changed")).join(known, "folder", "left_semi")


_LIST = "SELECT group_id, max(shared_count) AS shared_count, count(*) AS folders, CAST(sum(file_count) AS BIGINT) AS files, min(folder_name) AS first_name, min(min_size) AS min_size FROM g GROUP BY group_id"


@query(f"WITH g AS (SELECT DISTINCT * FROM duplicate_folder_groups WHERE group_id IS NOT NULL) {_LIST} HAVING count(*) >= 2")
def folder_group_list(spark, sf):
    """Stored folder groups with their figures."""
    return folders.group_list(load(spark, sf, "duplicate_folder_groups").filter("group_id IS NOT NULL").distinct())


@query(f"""WITH s AS (SELECT DISTINCT * FROM duplicate_folder_groups WHERE group_id IS NOT NULL), g AS (SELECT * FROM s WHERE group_id IN
  (SELECT group_id FROM s WHERE lower(folder_name) LIKE '%kunden%' OR lower(folder_path) LIKE '%kunden%')) {_LIST} HAVING max(shared_count) >= 2 AND count(*) >= 3 AND min(min_size) >= 1""")
def folder_group_list_filtered(spark, sf):
    """Stored folder groups with a text and limits."""
    return folders.group_list(load(spark, sf, "duplicate_folder_groups").filter("group_id IS NOT NULL").distinct(), "Kunden", 2, 3, 1)


# --- near-duplicate folders

_NOISE = ", ".join(f"'{n}'" for n in neardup.NOISE_NAMES)
_TOK = f"""{IDX}, tok AS (SELECT DISTINCT coalesce(parent_path, regexp_replace(path, '/[^/]*$', '')) AS folder, hash AS token FROM idx
  WHERE is_file AND hash IS NOT NULL AND size > 0 AND coalesce(name, '') NOT IN ({_NOISE})), t2 AS (SELECT * FROM tok WHERE folder <> ''),
n AS (SELECT folder, count(*) AS n FROM t2 GROUP BY folder)"""
_PAIRS = _TOK + """, i AS (SELECT a.folder AS fa, b.folder AS fb, count(*) AS shared FROM t2 a JOIN t2 b ON a.token = b.token AND a.folder < b.folder GROUP BY 1, 2),
pairs AS (SELECT fa AS folder_a, fb AS folder_b, shared AS shared_files, x.n + y.n - shared AS union_files, round(shared / (x.n + y.n - shared), 9) AS similarity
  FROM i JOIN n x ON x.folder = fa JOIN n y ON y.folder = fb WHERE x.n >= 2 AND y.n >= 2 AND shared >= 0.8 * (x.n + y.n - shared) - 1e-9)"""


def _tokens(spark, sf):
    return materialize(neardup.folder_tokens(idx(spark, sf, "hash", "name", "size", "is_file", "parent_path")), "tokens")


@query(f"WITH {_TOK} SELECT folder, n FROM n")
def folder_token_counts(spark, sf):
    """Distinct tokens of each folder's own files."""
    return neardup.folder_sizes(_tokens(spark, sf), 1)


@query(f"WITH {_PAIRS} SELECT * FROM pairs")
def near_dup_pairs(spark, sf):
    """All pairs of folders with four fifths of their files in common, exactly."""
    return neardup.near_duplicates(_tokens(spark, sf), "exact").withColumn("similarity", F.round("similarity", 9))


@query(f"WITH {_PAIRS} SELECT * FROM pairs")
def near_dup_sketched(spark, sf):
    """Pairs found through MinHash bands of four rows, verified exactly."""
    return neardup.near_duplicates(_tokens(spark, sf), "sketched").withColumn("similarity", F.round("similarity", 9))


@query(f"""WITH {_PAIRS}, ends AS (SELECT folder_a AS f FROM pairs UNION ALL SELECT folder_b FROM pairs), links AS (SELECT f, count(*) AS links FROM ends GROUP BY 1),
s AS (SELECT folder, list_sort(list(token)) AS s FROM t2 GROUP BY 1 HAVING count(*) >= 2)
SELECT folder, min(folder) OVER (PARTITION BY s) AS cls, coalesce(links, 0) AS links FROM s LEFT JOIN links ON f = folder""")
def near_dup_links(spark, sf):
    """Each folder of at least two tokens with its class of equal folders and the number of folders it is similar to."""
    found = neardup.folder_classes(_tokens(spark, sf))
    return neardup.folder_links(found, neardup.class_pairs(found.classes))


_COLLAPSED = _PAIRS.replace("pairs AS (", "every AS (", 1).replace(" WHERE x.n >= 2 AND y.n >= 2 AND shared", " WHERE shared") + """, pairs AS (SELECT every.* FROM every JOIN n x ON x.folder = folder_a JOIN n y ON y.folder = folder_b WHERE x.n >= 2 AND y.n >= 2),
st AS (SELECT folder_a, folder_b, regexp_replace(folder_a, '/[^/]*$', '') AS pa, regexp_replace(folder_b, '/[^/]*$', '') AS pb FROM every),
up AS (SELECT st.folder_a, st.folder_b, e.folder_a AS x, e.folder_b AS y FROM st JOIN every e ON e.folder_a = least(pa, pb) AND e.folder_b = greatest(pa, pb)
  WHERE pa <> pb AND pa <> st.folder_a AND pb <> st.folder_b AND pa <> st.folder_b AND pb <> st.folder_a AND NOT starts_with(pa, pb || '/') AND NOT starts_with(pb, pa || '/')),
c AS (SELECT folder_a, folder_b FROM pairs UNION SELECT x, y FROM c JOIN up USING (folder_a, folder_b))"""


@query(f"WITH RECURSIVE {_COLLAPSED} SELECT every.* FROM c JOIN every USING (folder_a, folder_b) WHERE NOT EXISTS (SELECT 1 FROM up WHERE up.folder_a = c.folder_a AND up.folder_b = c.folder_b)")
def near_dup_collapsed(spark, sf):
    """Near-duplicate pairs moved up to their highest similar ancestors."""
    tokens = _tokens(spark, sf)
    return neardup.collapsed(neardup.exact_pairs(tokens), tokens).withColumn("similarity", F.round("similarity", 9))


_STORED = """p AS (SELECT a AS folder_a, b AS folder_b, similarity, shared_files, union_files FROM (SELECT *, row_number() OVER (PARTITION BY a, b
  ORDER BY updated_at DESC NULLS LAST, similarity DESC NULLS LAST, shared_files DESC NULLS LAST, union_files DESC NULLS LAST) AS k FROM
  (SELECT least(folder_a, folder_b) AS a, greatest(folder_a, folder_b) AS b, * FROM near_duplicate_folder_pairs WHERE folder_a IS NOT NULL AND folder_b IS NOT NULL AND folder_a <> folder_b)) WHERE k = 1)"""


@query(f"WITH {_STORED} SELECT * FROM p")
def stored_pairs(spark, sf):
    """Match results as unique pairs in one orientation, the latest of each."""
    return neardup.stored_pairs(load(spark, sf, "near_duplicate_folder_pairs"))


@query(f"WITH {_STORED} SELECT * FROM p WHERE similarity >= 0.8 AND similarity < 0.95 AND (lower(folder_a) LIKE '%photos%' OR lower(folder_b) LIKE '%photos%')")
def near_dup_filtered(spark, sf):
    """Stored pairs in a range of similarity with a text in either folder."""
    return neardup.filtered_pairs(neardup.stored_pairs(load(spark, sf, "near_duplicate_folder_pairs")), 0.8, 0.95, "Photos")


_DELTA = f"""{IDX}, {_STORED}, f AS (SELECT folder, name, struct_pack(hash := hash, size := size) AS f FROM (SELECT *, row_number() OVER (PARTITION BY folder, name ORDER BY hash DESC, size DESC NULLS LAST) AS k FROM
  (SELECT coalesce(parent_path, regexp_replace(path, '/[^/]*$', '')) AS folder, name, coalesce(hash, '') AS hash, size FROM idx WHERE is_file)) WHERE k = 1),
q AS (SELECT folder_a, folder_b FROM p WHERE similarity >= 0.8), a AS (SELECT folder_a, folder_b, name, f AS fa FROM q JOIN f ON folder = folder_a), b AS (SELECT folder_a, folder_b, name, f AS fb FROM q JOIN f ON folder = folder_b),
d AS (SELECT folder_a, folder_b, name, CASE WHEN fb IS NULL THEN 'only_a' WHEN fa IS NULL THEN 'only_b' WHEN fa.hash = fb.hash THEN 'identical' ELSE 'changed' END AS status,
  greatest(fa.size, fb.size) AS size, CASE WHEN fa.hash <> fb.hash THEN fa.hash || ' → ' || fb.hash ELSE coalesce(fa.hash, fb.hash) END AS hash FROM a FULL JOIN b USING (folder_a, folder_b, name))"""


def _delta(spark, sf):
    pairs = neardup.stored_pairs(load(spark, sf, "near_duplicate_folder_pairs")).filter("similarity >= 0.8")
    return neardup.deltas(pairs, idx(spark, sf, "hash", "name", "size", "is_file", "parent_path"))


@query(f"WITH {_DELTA} SELECT folder_a, folder_b, name, status, size, hash FROM d")
def folder_delta(spark, sf):
    """File by file, what differs between the folders of each stored pair."""
    return _delta(spark, sf)


@query(f"WITH {_DELTA} SELECT folder_a, folder_b, " + ", ".join(f"count(*) FILTER (status = '{k}') AS {k}" for k in ("only_a", "only_b", "changed", "identical")) + " FROM d GROUP BY 1, 2")
def delta_summary(spark, sf):
    """Counts of the differences of each stored pair."""
    return neardup.delta_summary(_delta(spark, sf))


# --- tree


@query(f"WITH {IDX} SELECT path, name, is_directory, size, modified FROM idx WHERE parent_path = '/mnt/vol-000'")
def folder_children(spark, sf):
    """Direct entries of a folder."""
    return tree.children(idx(spark, sf, "name", "is_directory", "size", "modified", "parent_path"), "/mnt/vol-000")


@query(f"WITH {IDX} SELECT parent_path, count(*) FILTER (is_file) AS files, count(*) FILTER (is_directory) AS folders FROM idx WHERE parent_path IS NOT NULL GROUP BY 1")
def child_counts(spark, sf):
    """Files and folders directly in each folder."""
    return tree.child_counts(idx(spark, sf, "parent_path", "is_file", "is_directory"))


@query(f"WITH {IDX}, {DUP} SELECT DISTINCT '/mnt/vol-000/' || split_part(substr(path, 14), '/', 1) AS path, split_part(substr(path, 14), '/', 1) AS name FROM idx WHERE is_file AND hash IN (SELECT hash FROM dup) AND starts_with(path, '/mnt/vol-000/')")
def entries_with_duplicates(spark, sf):
    """Entries of a folder that are or hold a duplicate file."""
    return tree.duplicate_flags(idx(spark, sf, "hash", "is_file"), "/mnt/vol-000")


@query(f"""WITH {IDX}, {DUP}, h AS (SELECT string_split(parent_path, '/') AS p FROM idx WHERE is_file AND parent_path <> '' AND hash IN (SELECT hash FROM dup)),
e AS (SELECT p, unnest(range(2, len(p) + 1)) AS i FROM h) SELECT array_to_string(p[1:i], '/') AS folder, count(*) AS duplicates FROM e GROUP BY 1""")
def folders_with_duplicates(spark, sf):
    """Duplicate files at any depth below each folder."""
    return tree.folders_with_duplicates(idx(spark, sf, "hash", "is_file", "parent_path"))


@query(f"WITH {IDX} SELECT path, parent_path, name, is_directory, length(path) - length(replace(path, '/', '')) AS depth FROM idx")
def tree_rows(spark, sf):
    """All entries in tree order."""
    return tree.tree_rows(idx(spark, sf, "parent_path", "name", "is_directory"))


@query(f"WITH RECURSIVE {IDX}, s AS (SELECT '/mnt/vol-001' AS path UNION SELECT idx.path FROM idx JOIN s ON idx.parent_path = s.path) SELECT path FROM s")
def subtree(spark, sf):
    """A folder and everything below it over parent paths."""
    return tree.subtree(idx(spark, sf, "parent_path"), spark.createDataFrame([("/mnt/vol-001",)], "path string"))


@query(f"WITH {IDX} SELECT parent_path, CAST(sum(size) FILTER (NOT is_directory) AS BIGINT) AS size FROM idx WHERE parent_path IS NOT NULL GROUP BY 1 HAVING NOT bool_or(is_directory) AND sum(size) FILTER (NOT is_directory) > 0")
def leaf_dir_size(spark, sf):
    """Sizes of folders without subfolders."""
    return tree.leaf_directory_sizes(idx(spark, sf, "parent_path", "size", "is_directory"))


@query("""WITH e AS (SELECT group_id, min(string_split(folder_path, '/')) AS lo, max(string_split(folder_path, '/')) AS hi FROM duplicate_folder_groups WHERE group_id IS NOT NULL AND folder_path IS NOT NULL GROUP BY 1),
k AS (SELECT *, list_position(list_transform(range(1, least(len(lo), len(hi)) + 1), lambda i: lo[i] = hi[i]), false) AS p FROM e)
SELECT group_id, array_to_string(lo[1:coalesce(nullif(p, 0) - 1, least(len(lo), len(hi)))], '/') AS root FROM k""")
def group_roots(spark, sf):
    """The deepest common folder of each stored folder group."""
    return tree.common_root(load(spark, sf, "duplicate_folder_groups").filter("group_id IS NOT NULL AND folder_path IS NOT NULL"), "group_id", "folder_path")


# --- dashboard

_TOTALS = "SELECT count(*) FILTER (is_file) AS files, count(*) FILTER (is_directory) AS folders, CAST(coalesce(sum(size) FILTER (is_file), 0) AS BIGINT) AS bytes FROM idx"
_TIMELINE = IDX + ", x AS (SELECT to_timestamp(floor(modified)) AT TIME ZONE 'UTC' AS t, * FROM idx WHERE modified BETWEEN -62167219200 AND 253402300799), l AS (" + " UNION ALL ".join(
    f"SELECT '{k}' AS interval_type, strftime(t, '{f}') AS label, count(*) FILTER (is_file) AS files, count(*) FILTER (is_directory) AS folders, CAST(coalesce(sum(size) FILTER (is_file), 0) AS BIGINT) AS size FROM x GROUP BY 2"
    for k, f in (("day", "%Y-%m-%d"), ("week", "%Y-W%W"), ("month", "%Y-%m"), ("year", "%Y"))
) + ")"


@query(f"WITH {IDX} {_TOTALS}")
def totals(spark, sf):
    """Files, folders and bytes."""
    return dashboard.totals(idx(spark, sf, "is_file", "is_directory", "size"))


@query(f"WITH {_TIMELINE} SELECT * FROM l")
def timeline(spark, sf):
    """Files, folders and bytes by day, week, month and year."""
    return dashboard.timeline(idx(spark, sf, "modified", "is_file", "is_directory", "size"))


@query(f"WITH {_TIMELINE} SELECT *, CAST(sum(size) OVER (PARTITION BY interval_type ORDER BY label ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_size FROM l")
def timeline_cumulative(spark, sf):
    """The timeline with running bytes."""
    return dashboard.running_size(dashboard.timeline(idx(spark, sf, "modified", "is_file", "is_directory", "size")))


@query(f"""WITH {IDX}, {DUP}, t AS ({_TOTALS}), s AS ({_STATS.format('is_file')}), d AS ({_STATS.format('is_directory')})
SELECT files, folders, bytes, s.duplicates AS duplicate_files, s.groups AS duplicate_groups, s.wasted_bytes, d.duplicates AS duplicate_folders, d.groups AS duplicate_folder_groups,
 d.wasted_bytes AS wasted_folder_bytes, (SELECT count(*) FROM dup) AS duplicate_hashes, greatest((SELECT max(id) FROM idx) - 1000, 0) AS entries_behind, 160.0::DOUBLE AS next_refresh FROM t, s, d""")
def dashboard_row(spark, sf):
    """All figures in one row."""
    return dashboard.dashboard(idx(spark, sf), 1000, 100.0, 60)


# --- reconciliation

_FIRST = f"first AS (SELECT * EXCLUDE (k, hash), {HASH} AS hash FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY id) AS k FROM files WHERE path IS NOT NULL) WHERE k = 1)"


def _first(spark, sf):
    """The first record of each path: what an earlier crawl stored."""
    rest = [c for c in index.COLUMNS if c != "path"]
    rows = load(spark, sf, "files").filter("path IS NOT NULL").groupBy("path").agg(F.min_by(F.struct(*rest), "id").alias("r"))
    return rows.select("path", "r.*").withColumn("hash", T.clean_hash("hash")).select(*index.COLUMNS)


@query(f"""WITH {IDX}, {_FIRST} SELECT path, i.hash, i.modified, f.traversed, f.path IS NULL AS inserted,
 f.path IS NOT NULL AND NOT coalesce(i.is_directory, false) AND i.hash IS NOT NULL AND i.hash IS DISTINCT FROM f.hash AS hash_updated FROM first f FULL JOIN idx i USING (path)""")
def upsert_plan(spark, sf):
    """The first crawl's rows updated with the latest: which hashes change."""
    return reconcile.upsert(_first(spark, sf), idx(spark, sf)).select("path", "hash", "modified", "traversed", "inserted", "hash_updated")


@query(f"WITH {IDX} SELECT path FROM idx WHERE parent_path IN (SELECT parent_path FROM idx WHERE traverse_error IS NULL) AND path NOT IN (SELECT path FROM idx WHERE traverse_error IS NULL)")
def stale_children(spark, sf):
    """Stored entries that a listing of the readable ones no longer has."""
    i = idx(spark, sf, "parent_path", "traverse_error")
    return reconcile.stale_children(i, i.filter("traverse_error IS NULL").select("parent_path", "path")).select("path")


@query(f"""WITH RECURSIVE {IDX}, r AS (SELECT path FROM idx WHERE is_directory AND traverse_error IS NOT NULL),
s AS (SELECT path FROM r UNION SELECT idx.path FROM idx JOIN s ON idx.parent_path = s.path) SELECT path FROM idx WHERE path NOT IN (SELECT path FROM s)""")
def purge_unreadable(spark, sf):
    """The index without unreadable directories and what is below them."""
    i = materialize(idx(spark, sf, "parent_path", "is_directory", "traverse_error"), "index")
    return reconcile.without_subtrees(i, i.filter("is_directory AND traverse_error IS NOT NULL").select("path")).select("path")


@query(f"""WITH {IDX}, {_FIRST} SELECT path, CASE WHEN d.path IS NULL THEN 'purge' WHEN s.path IS NOT NULL AND s.modified IS NOT DISTINCT FROM d.modified AND (coalesce(s.traversed, false) OR s.traverse_error IS NOT NULL)
 THEN 'skip' ELSE 'read' END AS action FROM (SELECT * FROM first WHERE is_directory) s FULL JOIN (SELECT * FROM idx WHERE is_directory AND traverse_error IS NULL) d USING (path)""")
def reconcile_plan(spark, sf):
    """Per directory: purge, skip or read again."""
    return reconcile.walk_plan(_first(spark, sf).filter("is_directory"), idx(spark, sf, "modified", "is_directory", "traverse_error", "traversed").filter("is_directory AND traverse_error IS NULL"))


@query(f"WITH {IDX}, {_FIRST} SELECT hash FROM duplicate_hashes WHERE hash IS NOT NULL UNION SELECT hash FROM idx WHERE hash IN (SELECT i.hash FROM idx i JOIN first f USING (path) WHERE i.hash IS DISTINCT FROM f.hash) GROUP BY hash HAVING count(*) > 1")
def dup_hashes_incremental(spark, sf):
    """The stored duplicate hashes after a check of those that changed."""
    i = idx(spark, sf, "hash")
    f = _first(spark, sf).select("path", F.col("hash").alias("old"))
    changed = i.join(f, "path").filter(~F.col("hash").eqNullSafe(F.col("old"))).select("hash")
    return reconcile.added_hashes(load(spark, sf, "duplicate_hashes"), i, changed)


_RULES = [("lib", None), ("src", "package.json"), ("backup", "README.md"), ("assets", "*.csproj"), ("tests", "setup.py")]
_RULE_SQL = "rules AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {'NULL' if c is None else repr(c)})" for n, c in _RULES) + ") AS r(rule, condition))"


@query(f"""WITH {IDX}, {_RULE_SQL} SELECT path, rule, condition FROM idx d JOIN rules ON d.name = rule WHERE is_directory
 AND (condition IS NULL OR EXISTS (SELECT 1 FROM idx s WHERE s.parent_path = d.parent_path AND s.name = condition))""")
def ignored_folders(spark, sf):
    """Directories that ignore rules leave out."""
    lines = spark.createDataFrame([(n if c is None else f"{n}:{c}",) for n, c in _RULES], "line string")
    return reconcile.ignored_folders(idx(spark, sf, "is_directory", "parent_path", "name"), reconcile.parsed_rules(lines))


@query(f"WITH {IDX} SELECT path, traverse_error AS error FROM idx WHERE {FOLD.format('traverse_error')} LIKE '%permission%' OR {FOLD.format('path')} LIKE '%permission%'")
def skipped_search(spark, sf):
    """Skipped paths with a text in path or error."""
    rows = idx(spark, sf, "traverse_error").filter("traverse_error IS NOT NULL").select("path", F.col("traverse_error").alias("error"))
    return logs.skipped(rows, " Permission ")


# --- logs


def _events(spark, sf):
    return load(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), F.upper("event_type").alias("level"), F.col("props").alias("message"), F.col("user_id").alias("process_id"))


@query("""SELECT event_id AS id FROM events WHERE upper(event_type) = 'ERROR' AND props LIKE '{"k": 1%'""")
def logs_filtered(spark, sf):
    """Rows of a level whose message begins with a text."""
    return logs.filtered_logs(_events(spark, sf), "ERROR", '{"k": 1*').select("id")


@query("SELECT upper(event_type) AS level, count(*) AS n, min(ts) AS first, max(ts) AS last FROM events GROUP BY 1")
def log_levels(spark, sf):
    """Rows, first and last time by level."""
    return logs.level_counts(_events(spark, sf))


@query("SELECT event_id AS id, ts AS timestamp FROM events WHERE user_id = 12 ORDER BY ts DESC, event_id LIMIT 1000")
def process_logs(spark, sf):
    """The thousand latest rows of one process."""
    return logs.process_page(_events(spark, sf), 12).select("id", "timestamp")


_LINES = r"""lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
l AS (SELECT doc_id, CAST(regexp_extract(line, '^\[(\d{9,11})\] (DEBUG|INFO|WARN|ERROR) (.*)$', 1) AS BIGINT) AS timestamp, regexp_extract(line, '^\[(\d{9,11})\] (DEBUG|INFO|WARN|ERROR) (.*)$', 2) AS level,
 regexp_extract(line, '^\[(\d{9,11})\] (DEBUG|INFO|WARN|ERROR) (.*)$', 3) AS message FROM lines WHERE regexp_matches(line, '^\[(\d{9,11})\] (DEBUG|INFO|WARN|ERROR) (.*)$'))"""


@query(f"WITH {_LINES} SELECT level, count(*) AS n, min(timestamp) AS first, max(timestamp) AS last FROM l GROUP BY 1")
def text_log_levels(spark, sf):
    """Log rows inside the documents, by level."""
    return logs.level_counts(logs.lines_of(load(spark, sf, "documents")))


@query(f"WITH {_LINES} SELECT regexp_extract(message, '''([^'']*)''', 1) AS path, count(*) AS n FROM l WHERE level = 'INFO' AND starts_with(message, 'Indexed ''') GROUP BY 1")
def text_indexed_paths(spark, sf):
    """Paths that log rows inside the documents report as indexed."""
    return logs.indexed_paths(logs.lines_of(load(spark, sf, "documents")))


_NAMED = r"w AS (SELECT doc_id, timestamp, level, message, CASE WHEN starts_with(message, 'Indexed ''') THEN regexp_extract(message, '''([^'']*)''', 1) END AS folder FROM l)"


@query(f"""WITH {IDX}, {_LINES}, {_NAMED}, p AS (SELECT parent_path, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM idx WHERE is_file GROUP BY 1)
SELECT doc_id, timestamp, level, message, w.folder, files, bytes FROM w LEFT JOIN p ON p.parent_path = w.folder""")
def logs_enriched(spark, sf):
    """The log rows inside the documents, those "Indexed '…'" with the files found in the folder."""
    rows = logs.enriched(logs.lines_of(load(spark, sf, "documents")), idx(spark, sf, "is_file", "parent_path", "size"))
    return rows.select("doc_id", "timestamp", "level", "message", "folder", "files", "bytes")


@query(f"""WITH {IDX}, d AS (SELECT DISTINCT folder_path FROM duplicate_folder_groups WHERE folder_path IS NOT NULL)
SELECT folder_path AS folder, path, name, size FROM idx JOIN d ON d.folder_path = idx.parent_path WHERE is_file""")
def logs_listed_files(spark, sf):
    """The files in each folder that a log row "Indexed '…'" names; the rows name the stored duplicate folders."""
    folders_ = load(spark, sf, "duplicate_folder_groups").filter("folder_path IS NOT NULL")
    rows = folders_.select(F.lit("INFO").alias("level"), F.concat(F.lit("Indexed '"), F.col("folder_path"), F.lit("'")).alias("message")).distinct()
    return logs.listed_files(rows, idx(spark, sf, "is_file", "parent_path", "name", "size"))


# --- snapshots


@query("SELECT o_custkey, o_orderkey, o_totalprice, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def latest_snapshot(spark, sf):
    """The latest of the append-only rows of each key."""
    return snapshots.latest(load(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate"), "o_custkey", ["o_orderkey"])


@query("SELECT c_custkey, c_name, o_totalprice FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders) ON o_custkey = c_custkey AND k = 1")
def entities_with_latest(spark, sf):
    """Entities with their latest row, if any, largest first, nulls last."""
    rows = snapshots.with_latest(load(spark, sf, "customer").select("c_custkey", "c_name"), load(spark, sf, "orders"), "c_custkey", "o_custkey", ["o_orderkey"], ["o_totalprice"])
    return rows.orderBy(F.desc_nulls_last("o_totalprice"), "c_custkey")


@query("SELECT count(*) AS rows, count(DISTINCT o_custkey) AS keys, count(*) FILTER (o_orderstatus = 'O') AS open, max(o_orderkey) AS newest FROM orders")
def snapshot_stats(spark, sf):
    """Rows, keys, rows of a status and the newest id."""
    return snapshots.store_stats(load(spark, sf, "orders"), "o_custkey", "o_orderstatus", "O", "o_orderkey")


@query("SELECT hash FROM duplicate_hashes WHERE hash IS NOT NULL EXCEPT " + f"SELECT {HASH} FROM files WHERE {HASH} IS NOT NULL GROUP BY 1 HAVING count(DISTINCT path) > 1")
def hashes_removed(spark, sf):
    """Stored duplicate hashes that are none any more."""
    now = duplicates.duplicate_hashes(load(spark, sf, "files").select(T.clean_hash("hash").alias("hash"), "path").filter("path IS NOT NULL").distinct())
    return snapshots.removed(load(spark, sf, "duplicate_hashes").filter("hash IS NOT NULL"), now, "hash")


@query("SELECT c_custkey FROM customer WHERE c_custkey = 14 OR c_custkey BETWEEN 100 AND 250 OR c_custkey BETWEEN 1000 AND 1100")
def id_range_match(spark, sf):
    """Rows whose number is in a list of ranges."""
    return snapshots.in_ranges(load(spark, sf, "customer"), "c_custkey", "14,100-200,150-250, 1000-1100").select("c_custkey")


@query("SELECT count(*) AS keys, " + " || '-' || ".join(f"CAST(CAST(sum(('0x' || substr(md5(k), {a}, 8))::BIGINT) AS HUGEINT) AS VARCHAR)" for a in (1, 9, 17, 25)) + " AS digest FROM (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS k FROM customer)")
def keys_signature(spark, sf):
    """Number and digest of the set of keys."""
    return snapshots.signature(load(spark, sf, "customer"), F.col("c_custkey"))


@query("""SELECT c_custkey, replace(printf('%.2f', c_acctbal), '.', ',') AS balance, CASE WHEN contains(c_name, ';') OR contains(c_name, '"') THEN '"' || replace(c_name, '"', '""') || '"' ELSE c_name END AS name FROM customer""")
def csv_cells(spark, sf):
    """Numbers and texts as cells of a ;-separated file."""
    return load(spark, sf, "customer").select("c_custkey", T.german_number(F.col("c_acctbal")).alias("balance"), T.csv_field(F.col("c_name")).alias("name"))


# --- merging

_MERGE = _PLACES.replace("places AS", "m AS (SELECT DISTINCT group_id, folder_path FROM duplicate_folder_groups WHERE group_id IS NOT NULL AND folder_path IS NOT NULL), places AS") + """,
f AS (SELECT m.group_id, parent_path AS folder, name, path, hash, size FROM idx JOIN m ON m.folder_path = idx.parent_path WHERE is_file),
plan AS (SELECT *, CASE WHEN hash IS NULL OR row_number() OVER (PARTITION BY group_id, hash ORDER BY folder, name, path) = 1 THEN 'keep' ELSE 'remove' END AS action FROM f)"""


def _merge_plan(spark, sf):
    groups = load(spark, sf, "duplicate_folder_groups").filter("group_id IS NOT NULL AND folder_path IS NOT NULL").select("group_id", F.col("folder_path").alias("folder")).distinct()
    files = idx(spark, sf, "is_file", "parent_path", "name", "hash", "size").filter("is_file").select(F.col("parent_path").alias("folder"), "name", "path", "hash", "size").join(groups, "folder")
    return merge.merge_plan(files.select("group_id", "folder", "name", "path", "hash", "size"), ["group_id"])


@query(f"WITH {_MERGE} SELECT group_id, path, action FROM plan")
def merge_plan(spark, sf):
    """Which files of each stored folder group are kept and which removed."""
    return _merge_plan(spark, sf).select("group_id", "path", "action")


@query(f"WITH {_MERGE} SELECT group_id, count(*) FILTER (action = 'keep') AS kept, count(*) FILTER (action = 'remove') AS removed, CAST(coalesce(sum(size) FILTER (action = 'remove'), 0) AS BIGINT) AS freed_bytes FROM plan GROUP BY 1")
def merge_stats(spark, sf):
    """Files kept and removed and bytes freed by group."""
    return merge.merge_stats(_merge_plan(spark, sf), ["group_id"])


@query(f"WITH {_MERGE} SELECT group_id, name, count(*) AS files, min(path) AS path FROM plan WHERE action = 'keep' GROUP BY 1, 2")
def merged_tree(spark, sf):
    """The kept files of each group as one folder."""
    return merge.merged_tree(_merge_plan(spark, sf), ["group_id"])


@query(f"""WITH {IDX}, {DUP} SELECT path, CASE WHEN row_number() OVER (PARTITION BY hash, parent_path ORDER BY name, path) = 1 THEN 'keep' ELSE 'remove' END AS action
FROM idx WHERE is_file AND parent_path IS NOT NULL AND hash IN (SELECT hash FROM dup)""")
def merge_within_folders(spark, sf):
    """Of the copies inside one folder the first is kept."""
    files = duplicates.duplicate_files(idx(spark, sf, "hash", "is_file", "parent_path", "name", "size")).filter("is_file AND parent_path IS NOT NULL").select(F.col("parent_path").alias("folder"), "name", "path", "hash", "size")
    return merge.merge_plan(files.withColumn("scope", F.col("folder")), ["scope"]).select("path", "action")


# --- streaming


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def windowed_counts(spark, sf):
    """Events per hour and type."""
    return incremental.windowed_counts(load(spark, sf, "events"))


@query(f"SELECT {HASH} AS hash, count(*) AS n, count(*) > 1 AS is_duplicate FROM files WHERE {HASH} IS NOT NULL GROUP BY 1")
def streamed_hash_counts(spark, sf):
    """Counts per hash kept by a stream over the table's files."""
    import uuid

    place = f"{shared_dir(spark)}/arborix-{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"
    source = load(spark, sf, "files")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "*.parquet").parquet(_stream_folder(sf))
    done = incremental.duplicate_hash_stream(stream, f"{place}/state", f"{place}/checkpoint")
    done.awaitTermination()
    return incremental.duplicate_hash_state(spark, f"{place}/state")


def _stream_folder(sf: str) -> str:
    """A glob that names the files table whether it is one file or a folder of files."""
    return f"{sf}/files.parquet*"
