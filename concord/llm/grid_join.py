"""Embedding near-duplicates by an epsilon grid order join.

Vectors are scaled to length one, where cosine >= c means a distance of at most ``eps = sqrt(2 - 2c)``. They are
projected on the leading principal dimensions (of a bounded sample: any orthonormal directions are exact, these
separate best), put in cells of side ``eps``, and sorted by cell within each label. The sequence is cut into
blocks of ``BLOCK`` vectors, and blocks into intervals of ``FAN_OUT`` each, level over level; every interval
keeps the box of its projections. The join starts with each label's whole sequence against itself and goes
down to pairs of parts, skipping those whose boxes are farther apart than ``eps``: a projection never
lengthens a distance. Pairs of blocks that are left are multiplied in double precision.

Equal vectors of a label are one point with a count. A pair of blocks returns link counts and a spanning
forest of its links, never the links themselves, so a dense group costs no more rows than a sparse one.

Defined cases: vectors that are null, zero, or hold a null or non-finite component link with nothing, nor do
vectors without a label or of different lengths. Each row counts for itself, also with a repeated vec_id.
Labels may have any type that Spark can hash: whole numbers are compared as they are, others (texts, fractions,
dates) by a 64-bit hash of the value; NaN equals NaN, as in Spark's own comparisons.
The component's name is its smallest vec_id; a vector without an id takes the name of the others, or null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.operators.graph import components, forest
from concord.llm.store import materialize, partitions_for, small_batches

COSINE = 0.93
LEADING = 6
BLOCK = 512
FAN_OUT = 8
SAMPLE = 4096
SLACK = 1e-9

LOW, HIGH = [f"lo{i}" for i in range(LEADING)], [f"hi{i}" for i in range(LEADING)]


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision; scaled by their largest entry first, so no square overflows."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt(np.sum(v * v, axis=1, keepdims=True))


def usable(vector: str = "embedding", label: str = "label"):
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(label).isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def label_number(rows: DataFrame, label: str = "label") -> Column:
    """A long that is equal where labels are equal, null where they are."""
    if isinstance(rows.schema[label].dataType, T.IntegralType):
        return F.col(label).cast("long")
    return F.when(F.col(label).isNotNull(), F.xxhash64(label))


def directions(points: DataFrame) -> dict[int, np.ndarray]:
    """(size, leading directions) for each vector size of a sample of ``SAMPLE`` points, the first by hash."""
    rows = points.select("vec", "point").orderBy(F.xxhash64("point"), "point").limit(SAMPLE).collect()
    by_size: dict[int, list] = {}
    for vec, _ in rows:
        by_size.setdefault(len(vec), []).append(vec)
    out = {}
    for size, vecs in by_size.items():
        u = unit(np.array(vecs, dtype=np.float64))
        u = u - u.mean(axis=0)
        _, basis = np.linalg.eigh(u.T @ u)
        out[size] = basis[:, ::-1][:, :LEADING]
    return out


def _project(u: np.ndarray, basis: dict[int, np.ndarray]) -> np.ndarray:
    out = np.zeros((len(u), LEADING))
    axes = basis.get(u.shape[1], np.eye(u.shape[1])[:, :LEADING])
    out[:, : axes.shape[1]] = u @ axes
    return out


def _cells(basis, eps: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = batch.column(1).to_pylist()
            out = np.zeros((len(vecs), LEADING))
            sizes = np.array([len(v) for v in vecs])
            for size in set(sizes.tolist()):
                at = np.flatnonzero(sizes == size)
                out[at] = _project(unit(np.array([vecs[i] for i in at], dtype=np.float64)), basis.value)
            cell = np.floor(out / eps).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(vecs) + 1, dtype=np.int32) * LEADING), pa.array(cell.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["point", "vec", "label", "n", "cell"])

    return run


BLOCKS = "part int, seq int, label long, size int, points binary, counts binary, vecs binary, " + ", ".join(f"{c} double" for c in LOW + HIGH)


def _cut(basis):
    """Blocks of consecutive vectors of one label and size, with the box of their projections."""

    def block(part: int, seq: int, rows: list[tuple]) -> dict:
        vecs = np.array([r[1] for r in rows], dtype=np.float64)
        p = _project(unit(vecs), basis.value)
        out = {
            "part": part, "seq": seq, "label": rows[0][2], "size": vecs.shape[1], "points": np.array([r[0] for r in rows], dtype=np.int64).tobytes(),
            "counts": np.array([r[3] for r in rows], dtype=np.int64).tobytes(), "vecs": vecs.tobytes(),
        }
        return out | dict(zip(LOW, p.min(0).tolist(), strict=True)) | dict(zip(HIGH, p.max(0).tolist(), strict=True))

    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("label", pa.int64()), ("size", pa.int32()), ("points", pa.binary()), ("counts", pa.binary()), ("vecs", pa.binary()), *[(c, pa.float64()) for c in LOW + HIGH]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, held = TaskContext.get().partitionId(), 0, []
        for batch in batches:
            done = []
            for row in zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True):
                if held and (len(held) == BLOCK or held[-1][2] != row[2] or len(held[-1][1]) != len(row[1])):
                    done.append(block(part, seq, held))
                    seq, held = seq + 1, []
                held.append(row)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if held:
            yield pa.RecordBatch.from_pylist([block(part, seq, held)], schema)

    return run


def _near(eps: float):
    """Boxes x and y of two intervals at most ``eps`` apart."""
    gaps = [F.greatest(F.lit(0.0), F.col(f"x.{lo}") - F.col(f"y.{hi}"), F.col(f"y.{lo}") - F.col(f"x.{hi}")) for lo, hi in zip(LOW, HIGH, strict=True)]
    total = F.lit(0.0)
    for g in gaps:
        total = total + g * g
    return total <= (eps + SLACK) ** 2


def interval_pairs(blocks: DataFrame, eps: float) -> DataFrame:
    """(a, b) numbers of the blocks, a <= b, that may hold linked vectors; found from the whole sequence down."""
    seq = Window.partitionBy("label", "size").orderBy("part", "seq")
    levels = [materialize(blocks.withColumn("i", (F.row_number().over(seq) - 1).cast("long")).select("label", "size", "i", "part", "seq", *LOW, *HIGH))]
    while levels[-1].filter("i > 0").limit(1).count():
        up = levels[-1].groupBy("label", "size", F.floor(F.col("i") / FAN_OUT).alias("i")).agg(*[F.min(c).alias(c) for c in LOW], *[F.max(c).alias(c) for c in HIGH])
        levels.append(materialize(up))
    pairs = levels[-1].select("label", "size", F.col("i").alias("a"), F.col("i").alias("b"))
    for level in reversed(levels[:-1]):
        child = level.withColumn("up", F.floor(F.col("i") / FAN_OUT))
        x = pairs.join(child.alias("x"), (pairs["label"] == F.col("x.label")) & (pairs["size"] == F.col("x.size")) & (pairs["a"] == F.col("x.up"))).select(
            "x.label", "x.size", F.col("x.i").alias("a"), F.struct(*[F.col(f"x.{c}").alias(c) for c in LOW + HIGH]).alias("x"), "b"
        )
        y = child.select(F.col("label").alias("l"), F.col("size").alias("s"), F.col("up").alias("up"), F.col("i").alias("i"), F.struct(*LOW, *HIGH).alias("y"))
        pairs = materialize(
            x.join(y, (F.col("label") == F.col("l")) & (F.col("size") == F.col("s")) & (F.col("b") == F.col("up")))
            .filter((F.col("a") <= F.col("i")) & _near(eps)).select("label", "size", "a", F.col("i").alias("b"))
        )
    first = levels[0].select("label", "size", F.col("i").alias("a"), F.struct("part", "seq").alias("left"))
    second = levels[0].select("label", "size", F.col("i").alias("b"), F.struct("part", "seq").alias("right"))
    return pairs.join(first, ["label", "size", "a"]).join(second, ["label", "size", "b"]).select("left", "right")


def join_blocks(x: np.ndarray, y: np.ndarray, same: bool, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) places of the vectors of two blocks with a cosine of at least ``cosine``; each pair once within a block."""
    close = unit(x) @ unit(y).T >= cosine
    if same:
        close = np.triu(close, 1)
    return np.nonzero(close)


def _links(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                same, size, pa_, ca, va, pb, cb, vb = (batch.column(c)[row].as_py() for c in range(8))
                points_a, points_b = np.frombuffer(pa_, dtype=np.int64), np.frombuffer(pb, dtype=np.int64)
                i, j = join_blocks(np.frombuffer(va).reshape(-1, size), np.frombuffer(vb).reshape(-1, size), same, cosine)
                if len(i) == 0:
                    continue
                n, m = len(points_a), len(points_b)
                in_a = np.bincount(i, weights=np.frombuffer(cb, dtype=np.int64)[j], minlength=n)
                in_b = np.bincount(j, weights=np.frombuffer(ca, dtype=np.int64)[i], minlength=m)
                tree = forest(i, j if same else j + n)
                names = points_a if same else np.concatenate([points_a, points_b])
                points = np.concatenate([points_a, points_b])
                counts = np.concatenate([in_a, in_b]).astype(np.int64)
                used = counts > 0
                k, t = int(used.sum()), len(tree)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([points[used], names[tree[:, 0]]])), pa.array(np.concatenate([counts[used], np.zeros(t, dtype=np.int64)])),
                    pa.array(np.concatenate([np.zeros(k, dtype=np.int64), names[tree[:, 1]]]), mask=np.arange(k + t) < k),
                ], names=["point", "links", "other"])

    return run


def linked_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding, label)."""
    small_batches(vectors)
    eps = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + SLACK
    rows = vectors.select("vec_id", "embedding", label_number(vectors).alias("label"))
    # a zero's sign does not make another vector
    plain = F.transform("embedding", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x.cast("double")))
    rows = rows.withColumn("point", F.when(usable(), F.xxhash64("label", plain)))
    points = materialize(
        rows.filter("point IS NOT NULL").groupBy("point").agg(
            F.min(F.struct("label", plain.alias("vec"))).alias("one"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least")
        ).select("point", "one.label", "one.vec", "n", "least")
    )
    basis = points.sparkSession.sparkContext.broadcast(directions(points))
    celled = points.select("point", "vec", "label", "n").mapInArrow(_cells(basis, eps), "point long, vec array<double>, label long, n long, cell array<long>")
    order = ["label", "size", *[F.col("cell")[i] for i in range(LEADING)], "point"]
    ordered = celled.withColumn("size", F.size("vec")).repartitionByRange(partitions_for(points), *order).sortWithinPartitions(*order)
    blocks = materialize(ordered.mapInArrow(_cut(basis), BLOCKS))
    data = blocks.select(F.struct("part", "seq").alias("at"), "size", "points", "counts", "vecs")
    a = data.select(F.col("at").alias("left"), "size", F.col("points").alias("p_a"), F.col("counts").alias("c_a"), F.col("vecs").alias("v_a"))
    b = data.select(F.col("at").alias("right"), F.col("points").alias("p_b"), F.col("counts").alias("c_b"), F.col("vecs").alias("v_b"))
    pairs = materialize(interval_pairs(blocks, eps))
    met = pairs.join(a, "left").join(b, "right").select((F.col("left") == F.col("right")).alias("same"), "size", "p_a", "c_a", "v_a", "p_b", "c_b", "v_b")
    found = materialize(met.mapInArrow(_links(cosine), "point long, links long, other long"))
    named = components(found.filter("other IS NOT NULL").select(F.col("point").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("point").agg(F.sum("links").alias("links"))
    known = points.select("point", "n", "least").join(links, "point", "left").join(named.withColumnRenamed("node", "point"), "point", "left").select(
        "point", "least", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "point").alias("class")
    )
    known = materialize(known)
    least = known.groupBy("class").agg(F.min("least").alias("component_id"))
    known = materialize(known.join(least, "class").select("point", "n_links", "component_id"))
    out = rows.select("vec_id", "point").join(known, "point", "left")
    component = F.when(F.col("point").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
