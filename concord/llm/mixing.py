"""Mixing sources to target weights by pivotal dependent rounding.

Every source has a target number of words. A document of a source is due target / source size copies: the
whole part is taken, the fraction is rounded. Two fractional documents at a time exchange mass, weighted by
their sizes, in a random direction whose chances keep each document's expectation, until one of them is
integral; the words of the pair do not change. So a source misses its target by less than one document.

Documents are rounded in buckets of about ``bucket_rows`` rows of a source. Each bucket leaves at most one
fractional document, and these are combined over a reduction tree of fan-in ``FAN_IN``. Bucket, order and
random numbers come from hashes of the rows and ``seed``, not from partitions or tasks, so reruns agree.

Sizes are counts of ``[^\\x20\\x09-\\x0D]+`` (null: 0). Documents without words are not taken. Sources without
words have target 0.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concord.llm.store import materialize

BUCKET_ROWS = 1024
FAN_IN = 32
CAP = 3.0
WEIGHTS = (1, 2, 3)
NEAR = 1e-9


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, n_rows, source_size, target) from (source, size) rows.

    Sources in code point order, null last, weigh ``weights`` over and over and share all words; a target
    stops at ``cap`` times its source, and what is over is shared again by weight until none is above. In the
    order of size per weight the sources that stop are the first ones, so one pass of running sums decides.
    """
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("source_size"))
    # one row per source from here on
    place = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("level", F.lit(cap) * F.col("source_size") / F.col("weight"))
    up = Window.partitionBy(F.lit(0)).orderBy("level", F.col("source").asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    per = per.withColumn("total", F.sum("source_size").over(whole))
    # words per weight if this source and all above it do not stop
    per = per.withColumn(
        "share",
        (F.col("total") - F.coalesce(F.sum(F.lit(cap) * F.col("source_size")).over(before), F.lit(0.0)))
        / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
    )
    # the first source that does not stop sets the share of all after it
    common = F.min(F.when(F.col("share") <= F.col("level"), F.struct("level", F.col("source").isNull().alias("last"), "source", "share"))).over(whole)["share"]
    target = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least(F.col("weight") * F.coalesce(common, F.lit(float("inf"))), F.lit(cap) * F.col("source_size")))
    return per.select("source", "n_rows", "source_size", target.alias("target"))


def pivot(sizes: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> int:
    """Rounds ``p`` in place, pairwise; the index of the one entry left fractional, or -1."""
    held = -1
    for i in np.flatnonzero((p > NEAR) & (p < 1 - NEAR)):
        if held < 0:
            held = i
            continue
        a, b = float(sizes[held]), float(sizes[i])
        # mass in words that can go to the held document, and from it
        up = min(a * (1 - p[held]), b * p[i])
        down = min(a * p[held], b * (1 - p[i]))
        if rng.random() * (up + down) < down:
            p[held] += up / a
            p[i] -= up / b
        else:
            p[held] -= down / a
            p[i] += down / b
        open_ = [k for k in (held, i) if NEAR < p[k] < 1 - NEAR]
        held = open_[0] if open_ else -1
    return int(held)


def _round_group(seed: int, level: int, last: bool):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        # large documents first: what is left in the end is then a small one
        rows = rows.sort_by([("size", "descending"), ("o", "ascending"), ("doc_id", "ascending")])
        name = f"{seed}|{level}|{key[0].as_py()!r}|{key[1].as_py()}"
        rng = np.random.default_rng(zlib.crc32(name.encode("utf-8", "surrogatepass")))
        sizes, p = rows.column("size").to_numpy(), rows.column("p").to_numpy().copy()
        held = pivot(sizes, p, rng)
        if last and held >= 0:
            p[held] = float(rng.random() < p[held])
            held = -1
        done = np.ones(len(p), dtype=bool)
        if held >= 0:
            done[held] = False
        copies = rows.column("copies").to_numpy() + np.where(done, np.rint(p), 0).astype(np.int64)
        out = {"copies": pa.array(copies), "p": pa.array(np.where(done, 0.0, p)), "open": pa.array(~done)}
        return pa.table([out[n] if n in out else rows.column(n) for n in rows.column_names], names=rows.column_names)

    return run


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP, seed: int = 0, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, source, row, size, source_size, target, copies) of every row; ``row`` is a hash of id and text."""
    sizes = materialize(docs.select("doc_id", "source", F.xxhash64("doc_id", "text").alias("row"), word_count().alias("size")))
    return _rounded(sizes, weights, cap, seed, bucket_rows)


def _rounded(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP, seed: int = 0, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The rows of ``sizes`` (doc_id, source, row, size and more) with source_size, target and copies."""
    targets = materialize(source_targets(sizes, weights, cap))
    due = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # whole copies that are a rounding error away count as whole
    whole = F.floor(due + NEAR)
    buckets = F.ceil(F.col("n_rows") / bucket_rows)
    o = F.xxhash64(F.col("row"), F.lit(seed))
    rows = (
        sizes.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        .select(*sizes.columns, "source_size", "target", whole.cast("long").alias("copies"),
                F.greatest(due - whole, F.lit(0.0)).alias("p"), o.alias("o"), F.pmod(o, buckets).alias("bucket"), F.lit(True).alias("open"))
    )
    most = targets.agg(F.max(F.ceil(F.col("n_rows") / bucket_rows))).first()[0] or 1
    level, parts = 0, []
    while True:
        last = most <= 1
        table = materialize(rows.groupBy("source", "bucket").applyInArrow(_round_group(seed, level, last), rows.schema))
        if last:
            parts.append(table)
            break
        parts.append(table.filter("NOT open"))
        rows = table.filter("open").withColumn("bucket", F.floor(F.col("bucket") / FAN_IN))
        most, level = -(-most // FAN_IN), level + 1
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(*sizes.columns, "source_size", "target", "copies")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken, numbered by ``copy_number``.

    A row is named by 128 bits of hashes of all its columns, but for maps, and of which of them are null. Rows that agree in
    all of these are interchangeable: one of them stands for all their copies.
    """
    own = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    whole = [*own, *[c.isNull() for c in own]]
    name = [F.xxhash64(*whole).alias("row"), F.xxhash64(F.lit(1), *whole).alias("row_2")]
    sizes = materialize(docs.select("doc_id", "source", *name, word_count().alias("size")))
    taken = _rounded(sizes, **options).groupBy("row", "row_2").agg(F.sum("copies").alias("copies")).filter("copies > 0")
    taken = taken.select(F.col("row").alias("__row"), F.col("row_2").alias("__row_2"), F.col("copies").alias("__copies"))
    # the document's own columns stay together, so none clashes with these; the names serve both the choice and the join
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), name[0].alias("__row"), name[1].alias("__row_2"))
    joined = keyed.dropDuplicates(["__row", "__row_2"]).join(taken, ["__row", "__row_2"])
    return joined.select("__doc.*", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))).alias("copy_number"))
