"""Similarity of two vector sets in fixed-size blocks.

Rows are hashed to blocks, every block of one side meets every block of the other
in one task, and a task does one matrix product and keeps only what was asked for
(the k best, or all above a threshold). Tasks are equal in size whatever the label
distribution is, memory per task is bounded by the block, and the n x m table never
exists. Inputs are DataFrames with columns ``id`` and ``vec`` (plus partition keys).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.functions.vectors import SIM_DIGITS, matrix, unit_rows

BLOCK_ROWS = 8192
SLICE_ROWS = 1024
SLICE_CELLS = 2 << 20  # of the product that a task holds at a time: 16 MB a copy
MIN_BLOCKS = 3

Kernel = Callable[[tuple, pa.Table, pa.Table], pa.Table]


def block_count(rows: int, block_rows: int = BLOCK_ROWS) -> int:
    """Enough blocks to bound a task; a few even for small inputs, so cores are used."""
    if rows <= 64:
        return 1
    return max(MIN_BLOCKS, -(-rows // block_rows))


def slice_rows(others: int) -> int:
    """Rows whose product with ``others`` rows is held at a time."""
    return max(16, min(SLICE_ROWS, SLICE_CELLS // max(others, 1)))


def largest_part(df: DataFrame, keys: Sequence[str]) -> int:
    if not keys:
        return df.count()
    row = df.groupBy(*keys).count().agg(F.max("count")).first()
    return row[0] or 0


def block_join(
    left: DataFrame,
    right: DataFrame,
    kernel: Kernel,
    schema: T.StructType,
    keys: Sequence[str] = (),
    block_rows: int = BLOCK_ROWS,
    sizes: tuple[int, int] | None = None,
    half: bool = False,
    blocks: str | None = None,
    slices: bool = True,
) -> DataFrame:
    """Apply ``kernel(key, left_block, right_block)`` to each pair of blocks.

    ``sizes`` are the row counts (of the largest key) when the caller knows them. ``half``
    is for a set with itself: of two blocks only (lower, higher) meet, the last two parts of the key.
    ``blocks`` names a column with the number of blocks of a row's own key, so that rows of small
    keys are not copied as often as those of the largest. The kernel gets a few left rows at a time, unless
    ``slices`` is off; what it returns for them is put together.
    """
    rows_left, rows_right = sizes or (largest_part(left, keys), largest_part(right, keys))
    n_left, n_right = block_count(rows_left, block_rows), block_count(rows_right, block_rows)
    of = lambda n: F.col(blocks) if blocks else F.lit(n)
    left_blocks = (
        left.withColumn("lb", F.pmod(F.xxhash64("id"), of(n_left)).cast("int"))
        .withColumn("rb", F.explode(F.sequence(F.col("lb") if half else F.lit(0), (of(n_right) - 1).cast("int"))))
    )
    # fresh column identities, so a set can be joined with itself
    right_blocks = (
        right.select(*[F.col(c).alias(c) for c in right.columns])
        .withColumn("rb", F.pmod(F.xxhash64("id"), of(n_right)).cast("int"))
        .withColumn("lb", F.explode(F.sequence(F.lit(0), F.col("rb") if half else (of(n_left) - 1).cast("int"))))
    )
    group = [*keys, "lb", "rb"]
    # one partition per core or per group, whichever is fewer: AQE would merge these
    # few-row, compute-heavy groups into a single task
    def sliced(key, lt, rt):
        """A few left rows at a time, so the product held in memory stays small."""
        step = slice_rows(rt.num_rows)
        if not slices or lt.num_rows <= step:
            return kernel(key, lt, rt)
        return pa.concat_tables([kernel(key, lt.slice(at, step), rt) for at in range(0, lt.num_rows, step)])

    tasks = min(
        n_left * n_right * (1 if not keys else 8),
        max(left.sparkSession.sparkContext.defaultParallelism, n_left * n_right),
    )
    return (
        left_blocks.repartition(tasks, *group)
        .groupBy(*group)
        .cogroup(right_blocks.repartition(tasks, *group).groupBy(*group))
        .applyInArrow(sliced, schema)
    )


def ordered_once(pairs: pa.Table, key: tuple, a: str, b: str) -> pa.Table:
    """The pairs of a half join, each with its smaller id first, and once."""
    left, right = pairs[a], pairs[b]
    less = pc.less(left, right)
    if key[-2].as_py() == key[-1].as_py():
        return pairs.filter(less)
    first, second = pc.if_else(less, left, right), pc.if_else(less, right, left)
    return pairs.set_column(pairs.schema.get_field_index(a), a, first).set_column(pairs.schema.get_field_index(b), b, second)


def pair_schema(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> T.StructType:
    fields = [left.schema[k] for k in keys]
    fields.append(T.StructField("left_id", left.schema["id"].dataType))
    fields.append(T.StructField("right_id", right.schema["id"].dataType))
    fields.append(T.StructField("sim", T.DoubleType()))
    return T.StructType(fields)


def sim_matrix(a: np.ndarray, b: np.ndarray, metric: str = "cosine") -> np.ndarray:
    """Closeness of all rows of ``a`` to all rows of ``b``; larger is closer."""
    if metric == "euclidean":
        squared = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)
        return np.round(-np.sqrt(np.maximum(squared, 0.0)), SIM_DIGITS) + 0.0
    if metric == "cosine":
        a, b = unit_rows(a), unit_rows(b)
    return np.round(a @ b.T, SIM_DIGITS) + 0.0


def sim_block(left: pa.Table, right: pa.Table, metric: str = "cosine") -> np.ndarray:
    return sim_matrix(matrix(left["vec"]), matrix(right["vec"]), metric)


def near_slices(left: pa.Table, right: pa.Table, min_sim: float) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, matrix of booleans) of a few left rows at a time: whether the cosine, to SIM_DIGITS, is >= ``min_sim``.

    For kernels that need no similarity, only this; the same as of :func:`sim_block`. Products are of single precision,
    whose error is bounded; the places that this leaves open are computed in double precision.
    """
    a, b = unit_rows(matrix(left["vec"])), unit_rows(matrix(right["vec"]))
    rough_a, rough_b = a.astype(np.float32), np.ascontiguousarray(b.T, dtype=np.float32)
    dims = a.shape[1]
    # the error of a sum of ``dims`` rounded products of vectors of length one, twice, and that of rounding to digits
    margin = (dims + 8) * 2.0**-23 + 10.0**-SIM_DIGITS
    step = slice_rows(len(b))
    for at in range(0, len(a), step):
        rough = rough_a[at : at + step] @ rough_b
        near = rough >= min_sim - margin
        i, j = np.nonzero(near & (rough < min_sim + margin))
        if len(i) * dims > rough.size:
            near = sim_matrix(a[at : at + step], b, "dot") >= min_sim
        elif len(i):
            near[i, j] = np.round(np.einsum("ij,ij->i", a[at + i], b[j]), SIM_DIGITS) >= min_sim
        yield at, near


def _emit(schema: pa.Schema, key: tuple, n_keys: int, left, right, rows, cols, sims) -> pa.Table:
    columns = [pa.array([k.as_py()] * len(rows), type=schema.field(i).type) for i, k in enumerate(key[:n_keys])]
    columns += [left["id"].take(pa.array(rows)), right["id"].take(pa.array(cols)), pa.array(sims)]
    return pa.table(columns, schema=schema)


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def similar_pairs(
    left: DataFrame,
    right: DataFrame,
    min_sim: float,
    keys: Sequence[str] = (),
    once: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """All pairs with cosine >= ``min_sim``; ``once`` is for a set with itself and keeps left_id < right_id only."""
    schema = pair_schema(left, right, keys)
    arrow, n_keys = _arrow_schema(schema), len(keys)

    def kernel(key, lt, rt):
        if not lt.num_rows or not rt.num_rows:
            return arrow.empty_table()
        sims = sim_block(lt, rt)
        rows, cols = np.nonzero(sims >= min_sim)
        out = _emit(arrow, key, n_keys, lt, rt, rows, cols, sims[rows, cols])
        return ordered_once(out, key, "left_id", "right_id") if once else out

    return block_join(left, right, kernel, schema, keys, block_rows, half=once)


def block_top(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column indices of the k largest per row; equal values: lower column first."""
    width = sims.shape[1]
    if width > k:
        floor = np.fmax.reduce(sims, axis=1)[:, None] if k == 1 else -np.partition(-sims, k - 1, axis=1)[:, k - 1 : k]
        rows, cols = np.nonzero(sims >= floor)
    else:
        rows, cols = np.nonzero(np.isfinite(sims))
    order = np.lexsort((cols, -sims[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    first = np.searchsorted(rows, np.arange(sims.shape[0]))
    keep = np.arange(len(rows)) - first[rows] < k
    rows, cols = rows[keep], cols[keep]
    good = np.isfinite(sims[rows, cols])
    return rows[good], cols[good]


def cosine_top(a: np.ndarray, b: np.ndarray, k: int, min_sim: float | None = None, same: tuple[np.ndarray, np.ndarray] | None = None):
    """(rows, columns, cosines) of the k largest per row of ``a`` to the rows of ``b``, as :func:`block_top` of their :func:`sim_matrix`.

    ``same`` are (rows, columns) that are left out. Products are of single precision, whose error is bounded: the k-th largest
    of the maxima of groups of columns tells which could be among the k, and only those are computed in double precision.
    """
    a, b = unit_rows(a), unit_rows(b)
    dims, width = a.shape[1], len(b)
    group = min(64, width // (4 * k))
    screened = group >= 4 and bool(np.isfinite(a).all() and np.isfinite(b).all())
    margin = (dims + 8) * 2.0**-23 + 10.0**-SIM_DIGITS
    if screened:
        rough_a, rough_b = a.astype(np.float32), np.ascontiguousarray(b.T, dtype=np.float32)
    step = slice_rows(width)
    found = []
    for at in range(0, len(a), step):
        here = a[at : at + step]
        left_out = None if same is None else (same[0] >= at) & (same[0] < at + step)
        cells = None
        if screened:
            rough = rough_a[at : at + step] @ rough_b
            if left_out is not None:
                rough[same[0][left_out] - at, same[1][left_out]] = -np.inf
            # a group is every so many-th column: maxima of whole rows of these
            highest = rough[:, : width // group * group].reshape(len(here), group, -1).max(axis=1)
            floor = -np.partition(-highest, k - 1, axis=1)[:, k - 1].astype(np.float64) - 2 * margin
            # cosines are not below -1; what is left out is
            floor = np.maximum(floor, -2.0 if min_sim is None else max(min_sim - margin, -2.0))
            cells = np.flatnonzero(rough >= floor.astype(np.float32)[:, None])
        if cells is None or len(cells) * dims > 4 * rough.size:
            sims = sim_matrix(here, b, "dot")
            if left_out is not None:
                sims[same[0][left_out] - at, same[1][left_out]] = -np.inf
            if min_sim is not None:
                sims[sims < min_sim] = -np.inf
            rows, cols = block_top(sims, k)
            values = sims[rows, cols]
        else:
            rows, cols = np.divmod(cells, width)
            values = np.round(np.einsum("ij,ij->i", here[rows], b[cols]), SIM_DIGITS) + 0.0
            if min_sim is not None:
                keep = values >= min_sim
                rows, cols, values = rows[keep], cols[keep], values[keep]
            order = np.lexsort((cols, -values, rows))
            rows, cols, values = rows[order], cols[order], values[order]
            keep = np.arange(len(rows)) - np.searchsorted(rows, np.arange(len(here)))[rows] < k
            rows, cols, values = rows[keep], cols[keep], values[keep]
        found.append((rows + at, cols, values))
    return tuple(np.concatenate(part) for part in zip(*found, strict=True))


def topk_similar(
    left: DataFrame,
    right: DataFrame,
    k: int,
    min_sim: float | Callable[[tuple], float] | None = None,
    keys: Sequence[str] = (),
    exclude_same: bool = False,
    metric: str = "cosine",
    block_rows: int = BLOCK_ROWS,
    sizes: tuple[int, int] | None = None,
) -> DataFrame:
    """The k most similar right rows of each left row, ties to the smaller right id.

    Each block pair keeps k candidates per row, so a row's final ranking sees at
    most k x (number of right blocks) candidates.
    """
    schema = pair_schema(left, right, keys)
    arrow, n_keys = _arrow_schema(schema), len(keys)

    def kernel(key, lt, rt):
        if not lt.num_rows or not rt.num_rows:
            return arrow.empty_table()
        rt = rt.sort_by("id")
        least = min_sim(key) if callable(min_sim) else min_sim
        same = None
        if exclude_same:
            position = pc.index_in(lt["id"].combine_chunks(), rt["id"].combine_chunks())
            hit = np.flatnonzero(position.is_valid().to_numpy(zero_copy_only=False))
            same = hit, position.drop_null().to_numpy().astype(np.int64)
        a, b = matrix(lt["vec"]), matrix(rt["vec"])
        if metric == "cosine":
            return _emit(arrow, key, n_keys, lt, rt, *cosine_top(a, b, k, least, same))
        step, tables = slice_rows(len(b)), []
        for at in range(0, len(a), step):
            sims = sim_matrix(a[at : at + step], b, metric)
            if same is not None:
                here = (same[0] >= at) & (same[0] < at + step)
                sims[same[0][here] - at, same[1][here]] = -np.inf
            if least is not None:
                sims[sims < least] = -np.inf
            rows, cols = block_top(sims, k)
            tables.append(_emit(arrow, key, n_keys, lt, rt, rows + at, cols, sims[rows, cols]))
        return pa.concat_tables(tables)

    best = Window.partitionBy(*keys, "left_id").orderBy(F.desc("sim"), "right_id")
    return (
        block_join(left, right, kernel, schema, keys, block_rows, sizes, slices=False)
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
    )
