"""Lineage cuts and size checks shared by the iterative operators."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"

# Rows (of one vector each) that may be held as a broadcast model: centroids,
# concepts, code tables. Above it every operator takes its shuffled form.
MODEL_ROW_LIMIT = 4096


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for cut lineage.

    A machine-local folder is only chosen when the setting is absent *and* the
    master is local, as in tests: an executor on another host could not read it.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder all executors can reach")
    return _local_folder(spark.sparkContext.applicationId)


@functools.cache
def _local_folder(application_id: str) -> str:
    return tempfile.mkdtemp(prefix=f"concord-{application_id}-")


# folders of the tables that each open block of ``intermediate_tables`` has written
_open_blocks: list[list[str]] = []


def materialize(df: DataFrame, result: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Unlike cached blocks the table survives lost executors, and its file sizes
    give the planner real statistics for the next join. ``result`` names a table
    that stays when the block of :func:`intermediate_tables` around it ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/concord-{uuid.uuid4().hex}"
    # the result of a block is an intermediate table of the block around it
    around = _open_blocks[:-1] if result else _open_blocks
    if around:
        around[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def intermediate_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that ``materialize`` writes inside the block when it ends, but for its results.

    What the block returns must stand on its results alone: they are written by then, so no job needs the others.
    """
    _open_blocks.append([])
    try:
        yield
    finally:
        for path in _open_blocks.pop():
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def over_cores(df: DataFrame) -> DataFrame:
    """``df`` (id, ...) dealt over the cores by its id where it has fewer partitions: a small file is one, and passes over it one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, "id").sortWithinPartitions("id")


def fits(df: DataFrame, limit: int = MODEL_ROW_LIMIT) -> bool:
    """True when ``df`` has at most ``limit`` rows; reads no more than that."""
    return df.limit(limit + 1).count() <= limit


def broadcast_if_small(df: DataFrame, limit: int = MODEL_ROW_LIMIT) -> DataFrame:
    """``df`` written out, with a broadcast hint only if its rows were counted to be few.

    For the per-label side of a join with a table that may hold a third of its rows under
    one label: the large side is then not shuffled by label. Beyond the limit the planner
    (and its skew handling) decides.
    """
    small = materialize(df)
    return F.broadcast(small) if fits(small, limit) else small


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """Collect a model-sized table; refuses one that has grown past ``limit``."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows cannot be a driver-side model")
    return rows
