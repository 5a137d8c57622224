"""Session, checkpoint folder and size-checked broadcast helpers."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when a count proves it holds at most this many rows.
BROADCAST_MAX_ROWS = 100_000


def get_spark(app: str = "labelwright", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the operators expect; cluster settings win where present."""
    builder = (
        SparkSession.builder.appName(app)
        .master(f"local[{cores}]")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's checkpoint folder; on a local master without one, make a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="labelwright-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fits(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> bool:
    """Whether ``df`` holds at most ``max_rows`` rows, reading no more than that many."""
    return df.limit(max_rows + 1).count() <= max_rows


def small_side(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast when its size is proven small; otherwise leave the join to AQE."""
    return F.broadcast(df) if fits(df, max_rows) else df


# Bytes of a table file per task where every row is read by many patterns: some 50,000 order lines or 100,000 parts.
SCAN_TASK_BYTES = 1 << 20
# A stream's size is not known ahead; its batches get this many tasks per core.
STREAM_TASKS_PER_CORE = 4


def spread(df: DataFrame, bytes_per_core: int = 64 << 20) -> DataFrame:
    """Give a small scan one task per core.

    A small file with a single row group is read by one task, however many
    cores wait.  Inputs with plenty of bytes per core already split that far
    and are left as they are, so a large input is never moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * bytes_per_core else df


def tasks_for(df: DataFrame, bytes_per_task: int, least: int) -> int:
    """Tasks of ``bytes_per_task`` for the files ``df`` reads, ``least`` at least; sources of unknown size don't count."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return max(least, -(-sum(s for s in sizes if s < 1 << 62) // bytes_per_task))


def dealt(df: DataFrame, bytes_per_task: int = SCAN_TASK_BYTES) -> DataFrame:
    """Deal rows that cost much more to work on than to move out to tasks of a bounded size.

    A file's splits hold whole row groups, millions of rows, so the longest task
    would grow with the table until a split is full.  Here the number of tasks
    grows with the input instead, one per core at least.  Only the columns read
    later are moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming:
        return df.repartition(STREAM_TASKS_PER_CORE * cores)
    return df.repartition(tasks_for(df, bytes_per_task, cores))
