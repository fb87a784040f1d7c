"""Folders on the cluster's shared store, and tables written there to cut lineage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.runtime import intermediate_tables, materialize, shared_folder

__all__ = ["add_rows", "fold", "intermediate_tables", "join_shared", "materialize", "may_match", "new_folder", "partitions_for", "small_batches"]

BATCH_BYTES = 4 << 20


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh folder name below spark.checkpoint.dir."""
    return f"{shared_folder(spark).rstrip('/')}/concord-{kind}-{uuid.uuid4().hex}"


def small_batches(df: DataFrame) -> None:
    """Sets the session to send texts to Python tasks in batches of a few MB; Spark's own bound is 64 MB each way."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")


def fold(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids fall into no fold (null)."""
    return F.crc32(F.col(doc_id).cast("string")) % modulus


def partitions_for(df: DataFrame) -> int:
    """As many partitions as the session's shuffles have."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


HOT = 1024


def join_shared(rows: DataFrame, table: DataFrame, keys: list[str], n: str, total: int, how: str) -> DataFrame:
    """``rows`` joined (inner or left) with ``table``, one row for each of its ``keys``, none null; ``n`` names its column of how many rows have the key.

    Keys of more than 1 / HOT of the ``total`` rows are fewer than HOT: these are broadcast, so the rows of a key that
    holds a third of the table are not sent to one task. The others are shuffled. Column ``n`` is left out.
    """
    hot, cold = F.broadcast(table.filter(F.col(n) * HOT > total).drop(n)), table.filter(F.col(n) * HOT <= total).drop(n)
    return rows.join(hot, keys).unionByName(rows.join(hot, keys, "left_anti").join(cold, keys, how))


KEY_SLOTS = 1 << 24


def may_match(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """The ``rows`` whose ``keys`` fall into a slot of those of ``others``: all that match one of these, and some more.

    For a join whose other side lacks most of the rows, which are then not shuffled. No key is sent anywhere: what is
    broadcast is a bitmap of ``KEY_SLOTS`` bits, as large for any input (2 MB, a row of 4 KB for 32,768 slots).
    """
    slot = F.pmod(F.xxhash64(*keys), F.lit(KEY_SLOTS)) + 1
    place = [F.bitmap_bucket_number(slot).alias("__bucket"), F.bitmap_bit_position(slot).alias("__place")]
    marked = materialize(others.select(*place).groupBy("__bucket").agg(F.bitmap_construct_agg("__place").alias("__bits")))
    kept = rows.select("*", *place).join(F.broadcast(marked), "__bucket")
    byte = F.conv(F.hex(F.expr("substring(__bits, cast(__place div 8 AS int) + 1, 1)")), 16, 10).cast("int")
    return kept.filter(F.expr("shiftleft(1, cast(__place % 8 AS int))").bitwiseAND(byte) != 0).select(*rows.columns)


def add_rows(
    rows: DataFrame, kind: type = np.int64, blocks: int = 1, finish: Callable[[np.ndarray], np.ndarray] | None = None, out: type | None = None
) -> dict[int, np.ndarray]:
    """Sums of the arrays in (block int, sums binary) rows, by block; ``finish`` turns a sum into an array of kind ``out`` where it is summed.

    Tasks send arrays of one fixed size for a fixed set of blocks, and the sums are as large: a model that the
    driver may hold whatever the input. A summing task holds one array for each of its blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(sums, dtype=kind)
                held[block] = held[block] + part if block in held else part
        if finish is not None:
            held = {block: finish(v) for block, v in held.items()}
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["block", "sums"])

    summed = rows.repartition(max(1, min(partitions_for(rows), blocks)), "block").mapInArrow(run, "block int, sums binary")
    return {block: np.frombuffer(sums, dtype=out or kind) for block, sums in summed.collect()}
