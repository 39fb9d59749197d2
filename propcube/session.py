"""Session construction and the shared storage root.

Cluster deployments pass their own settings; the defaults here only fill in
what is unset so a test session and a 1000-executor session use the same
code path.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every plan in this package relies on.
REQUIRED_CONF = {
    # Dates and month buckets must not move with the driver's clock zone.
    "spark.sql.session.timeZone": "UTC",
    # Runtime re-planning: coalesce small shuffle partitions, split skewed
    # join partitions, and switch to broadcast when a side turns out small.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # More than this, as shuffled, takes some 400 MB a task to sort.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64m",
    # Partial-overwrite of partitioned aggregate tables (views.py).
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}

LOCAL_DEFAULTS = {
    "spark.sql.shuffle.partitions": "8",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.driver.memory": "8g",
}


def get_session(master: str | None = None, app_name: str = "propcube",
                extra: dict[str, str] | None = None) -> SparkSession:
    """Return the active session, creating a local one when none exists."""
    active = SparkSession.getActiveSession()
    if active is not None:
        apply_required_conf(active)
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
        for k, v in LOCAL_DEFAULTS.items():
            builder = builder.config(k, v)
    for k, v in REQUIRED_CONF.items():
        builder = builder.config(k, v)
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_required_conf(spark: SparkSession) -> None:
    for k, v in REQUIRED_CONF.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # static conf on an existing session
            pass


def storage_root(spark: SparkSession) -> str:
    """Shared folder for written tables (views, change-feed state).

    On a cluster this is the folder named by ``spark.checkpoint.dir``; it
    must be reachable from every executor. Only a local-mode session without
    that setting (tests, the smoke driver) gets a private temporary folder.
    """
    sc = spark.sparkContext
    root = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at a shared folder")
        root = tempfile.mkdtemp(prefix="propcube-")
        sc.setCheckpointDir(root)
        root = sc.getCheckpointDir() or root
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below the storage root."""
    return f"{storage_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def exists(spark: SparkSession, path: str) -> bool:
    """Hadoop-FS existence check (works for any scheme the cluster mounts)."""
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(jpath))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that nothing reads any more."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes inside go when the write is done, not when
    the driver next collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def materialize(df: DataFrame, name: str, path: str | None = None, codec: str | None = None) -> DataFrame:
    """``df`` written once as parquet below the storage root (or at ``path``)
    and read back.

    For frames that several later steps must see alike: the written rows are
    fixed, the lineage is cut, and a lost executor costs a re-read only.
    """
    path = path or scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


__all__ = ["get_session", "storage_root", "scratch_path", "exists", "remove", "freed_shuffles",
           "materialize", "apply_required_conf"]
