"""Session settings and durable intermediate tables shared by all operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}
_WRITTEN: dict[str, tuple[SparkSession, str]] = {}


def session(app: str = "arborix", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume: UTC, AQE with skew joins, Arrow."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Only a plain local master may go without the setting (as in tests): it gets a temporary folder, because there the
    driver is the only machine. On a cluster a missing setting is an error.
    """
    conf = spark.sparkContext.getConf()
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        holder = tempfile.TemporaryDirectory(prefix="arborix-")
        atexit.register(holder.cleanup)
        _LOCAL_DIRS[app] = f"file://{holder.name}"
    return _LOCAL_DIRS[app]


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df as parquet into the shared folder and return the table that was written.

    It cuts lineage, survives the loss of executors, and is read again with pruning and pushdown.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/arborix-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[path] = (spark, path)
    table._arborix_path = path
    return table


def release(table: DataFrame) -> None:
    """Delete a table written by materialize(); nothing that still reads it may be used afterwards."""
    path = getattr(table, "_arborix_path", None)
    if path and _WRITTEN.pop(path, None):
        delete_path(table.sparkSession, path)


def release_all(spark: SparkSession) -> None:
    """Delete every table that materialize() wrote in this session."""
    for path in [p for p, (s, _) in _WRITTEN.items() if s is spark]:
        _WRITTEN.pop(path)
        delete_path(spark, path)


@atexit.register
def _release_at_exit() -> None:
    """Tables of a session end with its driver, if its JVM is still there."""
    for path in list(_WRITTEN):
        spark, _ = _WRITTEN.pop(path)
        try:
            delete_path(spark, path)
        except Exception:  # noqa: BLE001 - the JVM has gone, or the session was stopped
            return


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system Spark knows; nothing happens if it is not there."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def list_paths(spark: SparkSession, pattern: str) -> list[str]:
    """The paths of any file system Spark knows that match a pattern, in order."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(pattern)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    return sorted(f.getPath().toString() for f in found) if found is not None else []


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
