"""Session settings, shared scratch storage and staging.

Nothing here tunes Spark internals: these are the public configuration keys
a Spark user sets, plus the helpers the operator modules share (shared
checkpoint folder, scratch paths, staged copies).
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Runtime SQL settings the library relies on.  AQE re-plans joins and
# coalesces shuffle partitions at run time; skew-join splitting keeps a hot
# (puuid, year) key from serialising a join.
SQL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

def build_session(
    master: str | None = None,
    shuffle_partitions: int = 8,
    app_name: str = "seasonlens",
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Session for tests, the bench and local runs (local[*] by default)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        **SQL_CONF,
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def apply_sql_conf(spark: SparkSession) -> None:
    """Pin the runtime settings on a session built elsewhere (the driver's)."""
    for key, value in SQL_CONF.items():
        spark.conf.set(key, value)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``.  Only a local master may
    run without that setting: its driver and executors are one machine, so a
    private folder serves all of them.  Anywhere else a missing setting is an error.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - a remote (Connect) session has no context
        return _configured(spark) or _missing()
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = sc.getConf().get("spark.checkpoint.dir", None) or _configured(spark)
    if not folder:
        folder = tempfile.mkdtemp(prefix="seasonlens-ckpt-") if is_local(sc.master) else _missing()
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def is_local(master: str) -> bool:
    """Whether driver and executors share one process (``local``, ``local[N]``)."""
    return master == "local" or master.startswith("local[")


def _configured(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None)


def _missing() -> str:
    raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table under the shared folder."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "tables", f"{name}-{uuid.uuid4().hex[:12]}")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists in the file system its scheme names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Plans made inside drop their shuffle files when their write ends, not when the driver collects its garbage.

    Only for writes of plans that run once (``df.select("*").write``); a result that the caller may run again keeps its files.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from that copy.

    Used where several aggregations read the same derived rows: they then
    scan a compact, column-prunable parquet copy instead of recomputing the
    upstream joins, and the lineage is cut (a lost executor does not send
    the recomputation back to the raw inputs).  Whoever stages a copy drops it with ``unstage`` once
    its readers are done.
    """
    path = scratch_path(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.select("*").write.option("compression", "zstd").parquet(path)
    return _staged(df, path)


def _staged(df: DataFrame, path: str) -> DataFrame:
    copy = df.sparkSession.read.schema(df.schema).parquet(path)
    copy.staged_path = path
    return copy


# Bytes of input files a slice of a larger run stands for.
SLICE_BYTES = 64 * 1024 * 1024
SLICE = "_slice"


def slices_for(df: DataFrame, most: int, slice_bytes: int | None = None) -> int:
    """How many slices to cut a run over ``df`` into, by the size of the files it reads: one for small ones, ``most`` at most."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    files = [leaves.apply(i) for i in range(leaves.size())]
    read = sum(int(str(x.stats().sizeInBytes())) for x in files if x.getClass().getSimpleName() == "LogicalRelation")
    return max(1, min(most, -(-read // (slice_bytes or SLICE_BYTES))))


def stage_slices(df: DataFrame, number: Column, name: str) -> Iterator[DataFrame]:
    """The rows of ``df`` staged once, in one folder a ``number`` (a non-negative integer column), and handed out slice by slice.

    What a caller shuffles is then a slice, not the table.  A slice's copy goes when the next one is asked for.
    """
    path = scratch_path(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.withColumn(SLICE, number.cast("int")).write.option("compression", "zstd").partitionBy(SLICE).parquet(path)
    folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    try:
        for name in sorted(f.getPath().getName() for f in files.listStatus(folder)):
            if name.startswith(f"{SLICE}="):
                part = _staged(df, f"{path}/{name}")
                yield part
                unstage(part)
    finally:
        files.delete(folder, True)


def unstage(*copies: DataFrame) -> None:
    """Remove staged copies that nothing reads any more."""
    for copy in copies:
        spark = copy.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(copy.staged_path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
