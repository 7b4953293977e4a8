"""Spark session helpers.

The library never builds its own session inside operators: every operator takes
DataFrames. These helpers are for scripts, tests and the bench.
"""

from __future__ import annotations

import contextlib
import os
import tempfile

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "quire") -> SparkSession:
    """Local/test session with AQE on, UI off, UTC time zone."""
    master = master or os.environ.get("QUIRE_MASTER", "local[8]")
    parts = shuffle_partitions or int(os.environ.get("QUIRE_SHUFFLE_PARTITIONS", "8"))
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("QUIRE_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint directory.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is. Only when it is unset (local runs, tests) do we create a private one.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect has no SparkContext
        sc = None
    current = (sc.getCheckpointDir() if sc is not None else None) or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if sc is not None and not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    master = spark.conf.get("spark.master", "") or ""
    if not master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it must name a shared folder "
                           "(iterative operators write their lineage cuts there)")
    # local runs and tests only: a private folder on this machine
    path = tempfile.mkdtemp(prefix="quire-ckpt-")
    if sc is not None:
        sc.setCheckpointDir(path)
    else:
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def spread(df, min_partitions: int | None = None, *keys):
    """Hash-repartition a scan that came out in fewer partitions than the
    cluster has cores (e.g. one large row group), so CPU-heavy per-row text
    work is shared by all tasks. A scan that is already split finely (the
    normal case at scale) is returned unchanged: no extra shuffle."""
    spark = df.sparkSession
    try:
        target = min_partitions or spark.sparkContext.defaultParallelism * 2
        if df.rdd.getNumPartitions() >= target:
            return df
    except Exception:  # noqa: BLE001 - Spark Connect: no RDD view, let AQE plan it
        return df
    return df.repartition(target, *keys) if keys else df.repartition(target)


#: Spark's setting that shuffle files go with the execution that made them
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_go(spark):
    """``with shuffles_go(spark): ...`` - the shuffle files of the actions
    begun and ended inside are deleted with them. Else they stay until the
    driver happens to collect its garbage, which a job of many steps may not
    live to see: all its shuffles are on disk at once. Should a frame run again
    later, Spark makes the missing files anew."""
    before = spark.conf.get(SHUFFLES_GO, "false")
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLES_GO, before)


_ACTIVE_SCOPES: list[list] = []
CUT_ROW_GROUP_BYTES = 4 * 1024 * 1024


class cut_scope:
    """``with cut_scope(spark): ...`` - every ``cut`` made inside is deleted
    on exit. Wrap a job whose results are written (or collected) inside the
    block, e.g. one streaming micro-batch, so the checkpoint folder does not
    grow run after run."""

    def __init__(self, spark):
        self.spark = spark
        self.paths: list = []

    def __enter__(self):
        _ACTIVE_SCOPES.append(self.paths)
        return self

    def __exit__(self, *exc):
        _ACTIVE_SCOPES.remove(self.paths)
        drop_cuts(self.spark, self.paths)
        return False


def cut(df, name: str = "cut", scope: list | None = None):
    """Cut lineage: write ``df`` as parquet under the session's checkpoint
    directory (a shared folder on a cluster) and read it back. One job, no
    recomputation, and the result survives executor loss. Used inside
    iterative operators instead of ``localCheckpoint``. With ``scope`` the
    path is recorded so ``drop_cuts`` can remove it once it is no longer read."""
    import uuid

    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/quire-{name}-{uuid.uuid4().hex}"
    # small row groups: the table can be read back by many tasks (a file of
    # one row group is one task however many cores there are)
    with shuffles_go(spark):
        df.write.mode("errorifexists").option("parquet.block.size", CUT_ROW_GROUP_BYTES).option(
            "compression", "zstd").parquet(path)
    if scope is not None:
        scope.append(path)
    elif _ACTIVE_SCOPES:
        _ACTIVE_SCOPES[-1].append(path)
    return spark.read.parquet(path)


def drop_cuts(spark, paths: list) -> None:
    """Delete intermediate tables written by ``cut`` (best effort)."""
    try:
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
    except Exception:  # noqa: BLE001 - Spark Connect: leave them to the folder's retention
        return
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        try:
            hp.getFileSystem(conf).delete(hp, True)
        except Exception:  # noqa: BLE001
            pass
    paths.clear()
