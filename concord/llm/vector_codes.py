"""Vector code compression: product codes of integer vectors, fitted by rounds of assignment and floor means.

Components become ``floor(scale * x)``, vectors are cut into ``parts`` consecutive parts, and each part position has a
codebook that starts as the parts of the smallest ids. All arithmetic is in integers, so results do not depend on how
rows are dealt to tasks. A round is one pass: tasks return sums and counts of a fixed size, and the codebooks, as
large for any number of vectors, are broadcast.

The nearest entry is found by equal-average search: entries are sorted by component sum, and from the place of a part's
own sum the search goes outward, the nearer sum first, until ``(difference of sums) ** 2 / dimension``, which no squared
distance is below, strictly exceeds the best distance. Entries at equal distance are then all seen; the lower index wins.

Cases: rows whose vector is null, or holds a null or non-finite component, go; so do vectors of another length than
that of the smallest kept id. Lengths that ``parts`` does not divide are cut at ``floor(part * length / parts)``.
Integers are held to what squares of sums of a part fit 63 bits with
(``largest``: |x| below 32,768 for 64 components at scale 4096). Rows that share an id are rows of their own, ordered
by label and vector when the first are chosen; a null id comes last. With fewer rows than entries the codebooks are
shorter. An empty table gives no rows. Of other columns than id, vector and label none is read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.store import add_rows, join_shared, materialize

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v array<double> of whole numbers) of the rows that have a whole vector."""
    kept = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v")).filter(
        "v IS NOT NULL AND forall(v, x -> coalesce(abs(x) < double('Infinity'), false))"
    )
    return kept.select("vec_id", "label", F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x).cast("double")).alias("v"))


def bounds(length: int, parts: int) -> np.ndarray:
    return np.arange(parts + 1) * length // parts


def largest(length: int, parts: int) -> int:
    """The integers to which components are held: a part's squared difference of sums then fits 63 bits."""
    return min((1 << 30) // max(int(np.diff(bounds(length, parts)).max()), 1), (1 << 31) - 1)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of each row of ``x``, by equal-average search."""
    dimension, far = max(x.shape[1], 1), np.iinfo(np.int64).max
    sums = entries.sum(axis=1)
    order = np.argsort(sums, kind="stable")
    sums, entries = sums[order], entries[order]
    own, k = x.sum(axis=1), len(sums)
    best, index = np.full(len(x), far), np.full(len(x), k)
    right = np.searchsorted(sums, own)
    left = right - 1
    active = np.arange(len(x))
    while len(active):
        lo, hi = left[active], right[active]
        below = np.where(lo >= 0, own[active] - sums[np.maximum(lo, 0)], far)
        above = np.where(hi < k, sums[np.minimum(hi, k - 1)] - own[active], far)
        gap = np.minimum(below, above)
        # without a best distance yet, any gap is looked at
        limit = np.where(best[active] == far, far, np.minimum(best[active], far // dimension) * dimension)
        on = (gap != far) & (np.where(gap == far, 0, gap) ** 2 <= limit)
        active, down = active[on], (below <= above)[on]
        at = np.where(down, left[active], right[active])
        left[active] -= down
        right[active] += ~down
        d = ((x[active] - entries[at]) ** 2).sum(axis=1)
        better = (d < best[active]) | ((d == best[active]) & (order[at] < index[active]))
        best[active] = np.where(better, d, best[active])
        index[active] = np.where(better, order[at], index[active])
    return index, best


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), length).astype(np.int64)


def _sums(books: list[np.ndarray], cuts: np.ndarray):
    """Per task: (part, sums and counts of its rows by entry) as one array of a fixed size for each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((len(b), b.shape[1] + 1), dtype=np.int64) for b in books]
        for batch in batches:
            v = _matrix(batch.column(0), int(cuts[-1]))
            for p, book in enumerate(books):
                x = v[:, cuts[p] : cuts[p + 1]]
                index, _ = nearest(x, book)
                np.add.at(total[p], index, np.concatenate([x, np.ones((len(x), 1), dtype=np.int64)], axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(books)), pa.int32()), pa.array([t.tobytes() for t in total], pa.binary())], names=["block", "sums"])

    return run


def fit(vectors: DataFrame, length: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebook of each part position, entries x components, from (vec_id, label, v array<int>) rows."""
    cuts = bounds(length, parts)
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), F.col("label").asc_nulls_last(), "v").limit(entries).select("v").collect()
    start = np.array([r["v"] for r in first], dtype=np.int64).reshape(len(first), length)
    books = [start[:, cuts[p] : cuts[p + 1]] for p in range(parts)]
    for _ in range(rounds):
        sums = add_rows(vectors.select("v").mapInArrow(_sums(books, cuts), "block int, sums binary"), blocks=parts)
        for p, total in sums.items():
            total = total.reshape(len(books[p]), books[p].shape[1] + 1)
            used = total[:, -1:] > 0
            books[p] = np.where(used, total[:, :-1] // np.maximum(total[:, -1:], 1), books[p])
    return books


def codebooks_name(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()


def encode(vectors: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(vec_id, label, code, error) of every row: the entries' indexes in two hex digits each, and the squared distance to them."""
    cuts = np.concatenate([[0], np.cumsum([b.shape[1] for b in books])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(2), int(cuts[-1]))
            found = [nearest(v[:, cuts[p] : cuts[p + 1]], b) for p, b in enumerate(books)]
            codes = np.stack([i for i, _ in found], axis=1).astype(np.uint8)
            error = np.sum([d for _, d in found], axis=0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    kinds = dict(vectors.dtypes)
    return vectors.select("vec_id", "label", "v").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error, label_error) of every kept row, and the codebooks. ``entries`` is at most 256.

    ``label_error`` is the error summed over the rows of one label, nulls together; null where it does not fit 63 bits.
    """
    if not 0 < entries <= 256:
        raise ValueError("codes have two hex digits: 1 to 256 entries")
    whole = quantised(vectors, scale)
    row = F.struct(F.col("vec_id").isNull().alias("last"), "vec_id", F.col("label").isNull().alias("unlabelled"), "label", "v")
    first = whole.agg(F.min(row).alias("row")).first()["row"]
    length = len(first["v"]) if first is not None else parts
    most = largest(length, parts)
    held = F.transform("v", lambda x: F.least(F.greatest(x, F.lit(float(-most))), F.lit(float(most))).cast("int")).alias("v")
    table = materialize(whole.filter(F.size("v") == length).select("vec_id", "label", held))
    books = fit(table, length, parts, entries, rounds)
    coded = materialize(encode(table, books))
    sums = coded.groupBy("label").agg(F.try_sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    sums = materialize(sums.select(F.col("label").isNull().alias("none"), F.col("label").cast("string").alias("name"), "label_error", "n").fillna("", ["name"]))
    rows = coded.select("*", F.col("label").isNull().alias("none"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("name"))
    joined = join_shared(rows, sums, ["none", "name"], "n", coded.count(), "left")
    return joined.select("vec_id", "label", "code", "error", "label_error"), books
