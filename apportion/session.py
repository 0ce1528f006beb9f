"""Session helpers: shared checkpoint folder, lineage cuts, size-checked broadcast."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = "apportion.broadcast.bytes"
GROUP_ROWS = "apportion.group.rows"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_written: list[tuple[str, str | None]] = []  # folder and, for bucketed tables, the table name


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints; only a local master may use a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured:
            sc.setCheckpointDir(configured)
        elif sc.master.startswith("local"):
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="apportion-"))
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return sc.getCheckpointDir()


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside delete their shuffle files when they end."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared checkpoint folder and continue from there.

    The result has no lineage to recompute when executors are lost, and its file sizes
    give the optimizer true statistics for the joins that follow. The shuffle files of the
    job are deleted at its end.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    _written.append((path, None))
    with shuffles_freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled, out._path = True, path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that cut or bucketed returned, once nothing that is still to run reads them."""
    for df in tables:
        _drop(df.sparkSession, *next(w for w in _written if w[0] == df.__dict__["_path"]))


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that cut or bucketed write inside are deleted at the end, but for those handed to the
    function this gives. Nothing that is read later may be left to run on the others."""
    before, kept = set(_written), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.__dict__["_path"])
        return df

    yield keep
    for path, name in [w for w in _written if w not in before and w[0] not in kept]:
        _drop(spark, path, name)


def free_shuffles(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of streams that ended only once the driver collects garbage."""
    spark.sparkContext._jvm.System.gc()


def settled(df: DataFrame) -> DataFrame:
    """df itself if it was just cut, else cut: for tables that a loop reads many times."""
    return df if df.__dict__.get("_settled") else cut(df)


def broadcast_limit(spark: SparkSession) -> int:
    return int(spark.conf.get(BROADCAST_BYTES, str(64 << 20)))


def group_limit(spark: SparkSession) -> int:
    """Rows of one key that a single task may hold before the key is split."""
    return int(spark.conf.get(GROUP_ROWS, "200000"))


def fits_broadcast(spark: SparkSession, rows: int, row_bytes: int = 64) -> bool:
    return rows * row_bytes <= broadcast_limit(spark)


def hinted(df: DataFrame, rows: int, row_bytes: int = 64) -> DataFrame:
    """Broadcast hint when the counted size allows it, otherwise the plain side."""
    return F.broadcast(df) if fits_broadcast(df.sparkSession, rows, row_bytes) else df


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucketed(df: DataFrame, keys: list[str], label: str, partition_by: str | None = None) -> DataFrame:
    """Store df as a bucketed table in the shared folder, so that later windows,
    aggregates and joins on keys need no exchange (and scans of one partition value read
    only that partition)."""
    spark = df.sparkSession
    width = shuffle_width(spark)
    name = f"apportion_{label}_{uuid.uuid4().hex[:12]}"
    path = f"{checkpoint_dir(spark)}/{name}"
    _written.append((path, name))
    writer = df.write.bucketBy(width, *keys).sortBy(*keys).option("path", path).option("compression", "zstd")
    with shuffles_freed(spark):
        (writer.partitionBy(partition_by) if partition_by else writer).saveAsTable(name)
    out = spark.table(name)
    out._settled, out._path = True, path
    return out


def discard_tables(spark: SparkSession) -> None:
    """Drop every intermediate table of this session; call once all results are written."""
    while _written:
        _drop(spark, *_written[-1])


def _drop(spark: SparkSession, path: str, name: str | None) -> None:
    _written.remove((path, name))
    if name:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
