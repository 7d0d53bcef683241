"""Queries over the name dictionary, targeted refreshes, lists of processes, settings and snapshots, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborix.functions import text as T
from arborix.operators import folders, index, logs, processes, reconcile, snapshots
from arborix.plans.index import _FIRST, _LINES, _LIST, FOLD, IDX, _first, idx
from arborix.runtime import load

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__], SQL[name or f.__name__] = f, sql
        return f

    return add


# --- the name dictionary


@query("SELECT f.id, f.path, f.name, n.name AS dictionary_name, f.size FROM files f JOIN file_names n ON n.id = f.file_name_id")
def named_files(spark, sf):
    """Every record of a file with its name in the dictionary."""
    return index.with_names(load(spark, sf, "files"), load(spark, sf, "file_names")).select("id", "path", "name", "dictionary_name", "size")


@query(f"""WITH {IDX} SELECT path, n.name, size FROM idx JOIN file_names n ON n.id = idx.file_name_id
WHERE {FOLD.format('n.name')} LIKE '%report%' AND (NOT is_directory OR is_file)""")
def search_dictionary(spark, sf):
    """A search by the names of the dictionary instead of those of the index."""
    ids = load(spark, sf, "files").select("id", "file_name_id").distinct()
    rows = idx(spark, sf, "id", "size", "is_directory", "is_file").join(ids, "id")
    named = index.with_names(rows, load(spark, sf, "file_names"), name="name")
    return index.search(named, "report", "contains", "files").select("path", "name", "size")


@query("""WITH fresh AS (SELECT DISTINCT name FROM files WHERE name IS NOT NULL AND name NOT IN (SELECT name FROM file_names WHERE name IS NOT NULL))
SELECT id, name FROM file_names UNION ALL SELECT (SELECT max(id) FROM file_names) + row_number() OVER (ORDER BY name), name FROM fresh""")
def name_dictionary(spark, sf):
    """The dictionary with the names it lacks, numbered on."""
    return index.name_dictionary(load(spark, sf, "file_names"), load(spark, sf, "files"))


# --- lists of groups, processes and rules

_GROUPS = f"WITH g AS (SELECT DISTINCT * FROM duplicate_folder_groups WHERE group_id IS NOT NULL), l AS ({_LIST} HAVING count(*) >= 2)"
_ORDERS = [("shared", True, "shared_count DESC"), ("folders", False, "folders"), ("name", False, FOLD.format("first_name") + " NULLS FIRST"), ("files", True, "files DESC")]


@query(_GROUPS + " " + " UNION ALL ".join(f"SELECT '{by}' AS ordered_by, group_id, row_number() OVER (ORDER BY {sql}, group_id) AS position FROM l" for by, _, sql in _ORDERS))
def folder_group_orders(spark, sf):
    """Stored folder groups in each of the four orders: every group with its position."""
    groups = folders.group_list(load(spark, sf, "duplicate_folder_groups").filter("group_id IS NOT NULL").distinct())
    parts = [index.positions(folders.ordered_list(groups, by, down).select("group_id")).select(F.lit(by).alias("ordered_by"), "group_id", "position") for by, down, _ in _ORDERS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def _processes(spark, sf):
    """Events as processes: every seventh user's are paused."""
    e = load(spark, sf, "events")
    return e.select(F.col("event_id").alias("id"), F.concat(F.lit("Job "), F.col("user_id").cast("string")).alias("name"), F.when(F.col("user_id") % 3 == 0, "index").otherwise("merge").alias("category"), F.col("event_type").alias("status"), F.col("props").alias("message"), (F.col("user_id") % 7 == 0).alias("paused"), F.col("ts").alias("started_at"))


_PROCESSES = "p AS (SELECT event_id AS id, 'Job ' || user_id AS name, CASE WHEN user_id % 3 = 0 THEN 'index' ELSE 'merge' END AS category, event_type AS status, props AS message, user_id % 7 = 0 AS paused, ts AS started_at FROM events)"


@query(f"WITH {_PROCESSES}, f AS (SELECT * FROM p WHERE paused AND category = 'index' AND contains(lower(concat_ws(' ', id, name, category, status, message)), 'job 1')) SELECT id, name, status, row_number() OVER (ORDER BY started_at DESC, id) AS position FROM f")
def process_list(spark, sf):
    """Paused processes of a category with a text, the latest first: each with its position."""
    found = processes.filtered_processes(_processes(spark, sf), "Job 1", "paused", "index")
    return index.positions(processes.ordered_processes(found, "started", True).select("id", "name", "status"))


@query(f"WITH {_PROCESSES} SELECT id, category, row_number() OVER (ORDER BY lower(coalesce(name, '')), id) AS position FROM p WHERE status = 'error'")
def process_list_by_name(spark, sf):
    """Processes of a status by name: each with its position."""
    found = processes.filtered_processes(_processes(spark, sf), status="error")
    return index.positions(processes.ordered_processes(found, "name").select("id", "category"))


@query(f"WITH {_PROCESSES} SELECT status, count(*) AS processes, count(*) FILTER (paused) AS paused FROM p GROUP BY 1")
def process_counts(spark, sf):
    """Processes by status, and how many of them are paused."""
    return processes.status_counts(_processes(spark, sf))


_RULES = "r AS (SELECT DISTINCT name, CASE WHEN id % 2 = 0 THEN parent_path END AS condition FROM files WHERE is_directory AND name IS NOT NULL)"


@query(f"WITH {_RULES} SELECT name, condition, 'conditional' AS kind FROM r WHERE coalesce(condition, '') <> '' AND contains(lower(concat_ws(' ', name, condition)), 'photo') UNION ALL SELECT name, condition, 'always' FROM r WHERE coalesce(condition, '') = ''")
def rule_list(spark, sf):
    """Names of directories as rules: conditional ones with a text, and those that always hold."""
    rules = load(spark, sf, "files").filter("is_directory AND name IS NOT NULL").select("name", F.when(F.col("id") % 2 == 0, F.col("parent_path")).alias("condition")).distinct()
    parts = [processes.filtered_rules(rules, kind, text).withColumn("kind", F.lit(kind)) for kind, text in (("conditional", "Photo"), ("always", ""))]
    return parts[0].unionByName(parts[1])


# --- logs

_TEXTS = ["Indexed '/old", "%", "_", "entries)", "\\"]


@query(f"WITH {_LINES}, x AS (SELECT unnest([" + ", ".join("'" + t.replace("'", "''") + "'" for t in _TEXTS) + f"]) AS text) SELECT text, count(message) FILTER (contains({FOLD.format('message')}, {FOLD.format('text')})) AS n FROM x LEFT JOIN l ON true GROUP BY 1")
def log_text_counts(spark, sf):
    """Log rows that hold a text as it is written, wildcards included."""
    return logs.text_counts(logs.lines_of(load(spark, sf, "documents")), _TEXTS)


@query(f"""WITH w AS (SELECT DISTINCT {FOLD.format('folder_name')} AS f FROM duplicate_folder_groups WHERE folder_name IS NOT NULL AND NOT contains(folder_name, '''')),
m AS (SELECT {FOLD.format("coalesce(folder_name, '')")} AS f FROM duplicate_folder_groups WHERE NOT contains(coalesce(folder_name, ''), '''')),
r AS (SELECT DISTINCT name AS rule FROM files WHERE is_directory AND name IS NOT NULL)
SELECT rule, (SELECT count(*) FROM m WHERE m.f = {FOLD.format('r.rule')} AND m.f <> '') AS events FROM r""")
def rule_event_counts(spark, sf):
    """Messages that name a rule, for every rule; messages are made of the stored folder names, in upper case."""
    named = load(spark, sf, "duplicate_folder_groups").filter("NOT contains(coalesce(folder_name, ''), \"'\")")
    upper = F.translate(F.coalesce("folder_name", F.lit("")), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    rows = named.select(F.concat(F.lit("Skipped via rule '"), upper, F.lit("' today")).alias("message"))
    return logs.rule_events(rows, load(spark, sf, "files").filter("is_directory").select(F.col("name").alias("rule")))


# --- targeted refresh, settings, snapshots

_AGAIN, _GONE = ["/mnt/vol-001", "/srv/vol-002/"], ["/mnt/vol-000", "/mnt/vol-003"]


def _below(column: str, roots: list[str]) -> str:
    return "(" + " OR ".join(f"{column} = '{r.rstrip('/')}' OR starts_with({column}, '{r.rstrip('/')}/')" for r in roots) + ")"


@query(f"""WITH {IDX}, {_FIRST}, fresh AS (SELECT * FROM idx WHERE {_below('path', _AGAIN)} AND traverse_error IS NULL),
kept AS (SELECT * FROM first WHERE NOT {_below('path', _GONE)} AND (NOT {_below('path', _AGAIN)} OR path IN (SELECT path FROM fresh)))
SELECT path, CASE WHEN f.path IS NULL THEN k.hash ELSE f.hash END AS hash, k.path IS NULL AS inserted FROM kept k FULL JOIN fresh f USING (path)""")
def resynced(spark, sf):
    """The first crawl's rows after two folders were read again and two removed."""
    listed = idx(spark, sf).filter("traverse_error IS NULL")
    return reconcile.resynced(_first(spark, sf), listed, _AGAIN, _GONE).select("path", "hash", "inserted")


@query("SELECT coalesce(n.key, s.key) AS key, CASE WHEN n.key IS NULL THEN s.value ELSE n.value END AS value FROM (SELECT n_name AS key, CAST(n_regionkey AS VARCHAR) AS value FROM nation) s FULL JOIN (SELECT key, max(value) AS value FROM (SELECT CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE n_name || '_new' END AS key, CAST(c_custkey AS VARCHAR) AS value FROM customer JOIN nation ON n_nationkey = c_nationkey) GROUP BY 1) n ON n.key = s.key")
def settings_upsert(spark, sf):
    """Settings overwritten by key: of several new values the largest, as text."""
    nation = load(spark, sf, "nation")
    new = load(spark, sf, "customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
    new = new.select(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(F.concat("n_name", F.lit("_new"))).alias("key"), F.col("c_custkey").cast("string").alias("value"))
    return snapshots.set_settings(nation.select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value")), new)


@query("SELECT c_custkey, coalesce(CASE WHEN c_mktsegment IN ('true', 'false') THEN c_mktsegment = 'true' END, true) AS enabled, coalesce(TRY_CAST(regexp_extract(c_name, '[0-9]+$') AS BIGINT), 60) AS seconds FROM customer")
def settings_read(spark, sf):
    """Texts read as settings, with defaults."""
    return load(spark, sf, "customer").select("c_custkey", T.setting(F.col("c_mktsegment"), "boolean", True).alias("enabled"), T.setting(F.regexp_extract("c_name", "[0-9]+$", 0), "bigint", 60).alias("seconds"))


@query("SELECT c_custkey, max_by(o_orderkey, (strftime(o_orderdate, '%Y%m%d_%H%M%S'), o_orderkey % 100)) AS o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def archived_latest(spark, sf):
    """The archived row of each key that is last by run stamp, then by sequence."""
    rows = load(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.date_format("o_orderdate", "yyyyMMdd_HHmmss").alias("run_stamp"), (F.col("o_orderkey") % 100).alias("sequence"))
    known = load(spark, sf, "customer").select("c_custkey")
    return snapshots.newest_archived(rows, "c_custkey").join(known, "c_custkey", "left_semi").select("c_custkey", "o_orderkey")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'")
def orders_not_failed(spark, sf):
    """Rows whose status is not the failed one."""
    return snapshots.not_failed(load(spark, sf, "orders"), "o_orderstatus", "F").select("o_orderkey", "o_orderstatus")


@query("SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def state_context(spark, sf):
    """The different keys of two state tables."""
    return snapshots.context(load(spark, sf, "customer").select(F.col("c_nationkey").alias("nation")), load(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation")))


@query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey DESC) AS position FROM orders WHERE o_custkey = 7")
def snapshot_history(spark, sf):
    """All snapshots of one key, newest first."""
    return index.positions(snapshots.history(load(spark, sf, "orders"), "o_custkey", 7, "o_orderkey").select("o_orderkey", "o_totalprice"))


@query("SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderstatus = 'O' ORDER BY 1 LIMIT 20")
def inspected_snapshots(spark, sf):
    """The first twenty rows of a status by id."""
    return snapshots.inspected(load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")), status="O", limit=20)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET (SELECT count(*) FROM customer)")
def list_gap(spark, sf):
    """What a list has beyond the rows that are stored."""
    return snapshots.list_delta(load(spark, sf, "customer"), load(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"])


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM (SELECT l_orderkey AS o_orderkey, max_by(s, (l_linenumber, s)) AS f FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN 'done' ELSE lower(l_returnflag) END AS s FROM lineitem) GROUP BY 1) WHERE f = 'done')")
def resumed_keys(spark, sf):
    """What a run cut short still has to do: keys not done, or whose last attempt was not."""
    outcomes = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("attempt"), F.when(F.col("l_returnflag") == "R", "done").otherwise(F.lower("l_returnflag")).alias("status"))
    return snapshots.still_to_do(load(spark, sf, "orders").select("o_orderkey"), outcomes, "o_orderkey")


@query("SELECT name, nullif(regexp_extract(name, '^([0-9]{8}_[0-9]{6})', 1), '') AS run_stamp, CASE WHEN trim(d) = '' THEN '_' ELSE d END AS document_name, CASE WHEN v = '' THEN 'NULL' ELSE '''' || replace(v, '''', '''''') || '''' END AS sql_value FROM (SELECT name, regexp_replace(name, '^\\s+|\\s+$', '', 'g') AS v, regexp_replace(regexp_replace(replace(regexp_replace(name, '[^A-Za-z0-9._ -]', '_', 'g'), '..', '_'), '^\\.', '_'), '\\.$', '_') AS d FROM file_names WHERE name IS NOT NULL)")
def name_forms(spark, sf):
    """Every name of the dictionary as a run stamp, as a document's name and as a value in SQL."""
    name = F.col("name")
    rows = snapshots.by_run_stamp(load(spark, sf, "file_names").filter("name IS NOT NULL"))
    return rows.select("name", "run_stamp", T.safe_document_name(name).alias("document_name"), T.sql_value(name).alias("sql_value"))
