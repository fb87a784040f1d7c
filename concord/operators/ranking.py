"""Earliest records, top-k, carried state, exact ranks and quantiles.

One-row-per-key choices are ``min_by`` aggregates, which combine map-side, so a key that
holds a third of the rows is reduced before the shuffle. Ranks over large groups come
from a range-partitioned table and per-partition offsets, never from one task per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.runtime import broadcast_if_small, materialize

CHUNK_LINES = 65_536


def _nulls_last(cols: Sequence[str]) -> Column:
    return F.struct(*[c for name in cols for c in (F.col(name).isNull().alias(f"{name}_null"), F.col(name))])


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by ``order`` ascending, nulls last."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), _nulls_last(order)).alias("r"))
    return picked.select(*keys, "r.*").select(*df.columns)


def earliest_record(df: DataFrame, subject: str, when: str, tiebreak: str) -> DataFrame:
    return first_per_key(df, [subject], [when, tiebreak])


def distinct_on(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Distinct rows on a key subset; the explicit order says which row stays."""
    return first_per_key(df, keys, order)


def any_flag_first(df: DataFrame, key: str, flag: str, order: Sequence[str]) -> DataFrame:
    """One row per key with ``flag`` OR-ed over its duplicates."""
    rest = [c for c in df.columns if c not in (key, flag)]
    out = df.groupBy(key).agg(F.bool_or(flag).alias(flag), F.min_by(F.struct(*rest), _nulls_last(order)).alias("r"))
    return out.select(key, flag, "r.*").select(*df.columns)


def first_listed(memberships: DataFrame) -> DataFrame:
    """(id, label): the first-listed membership of each item."""
    return memberships.groupBy("id").agg(F.min_by("label", F.struct("ord", "label")).alias("label"))


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """Top k rows per key. ``row_number() <= k`` makes Spark limit every map-side group first."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def top_two(scores: DataFrame, item: str = "id") -> DataFrame:
    """(id, best, best_score, second, second_score, margin) from long (id, label, score).

    Both ranks come from one aggregate: the maximum, and the maximum of what it beats.
    """
    best = scores.groupBy(item).agg(F.max_by(F.struct("label", "score"), F.struct("score", "label")).alias("b"))
    rest = scores.join(best, item).filter(F.col("label") != F.col("b.label"))
    second = rest.groupBy(item).agg(F.max_by(F.struct("label", "score"), F.struct("score", "label")).alias("s"))
    return best.join(second, item, "left").select(
        item, F.col("b.label").alias("best"), F.col("b.score").alias("best_score"),
        F.col("s.label").alias("second"), F.col("s.score").alias("second_score"),
        (F.col("b.score") - F.col("s.score")).alias("margin"),
    )


def category_order(df: DataFrame, col: str, order: Sequence[str], *then: str) -> DataFrame:
    """Rows with ``position`` of the category (99 when unlisted), sorted by it."""
    ranks = df.sparkSession.createDataFrame([(c, i) for i, c in enumerate(order)], f"{col} string, position int")
    return df.join(ranks, col, "left").withColumn("position", F.coalesce("position", F.lit(99))).orderBy("position", *then)


def majority_label(votes: DataFrame, priority: Sequence[str]) -> DataFrame:
    """(id, label, n): the most frequent label per item, ties by ``priority``."""
    ranks = votes.sparkSession.createDataFrame([(c, i) for i, c in enumerate(priority)], "label string, prio int")
    counted = votes.groupBy("id", "label").agg(F.count(F.lit(1)).alias("n")).join(ranks, "label", "left")
    order = F.struct("n", -F.coalesce("prio", F.lit(len(priority))), F.col("label"))
    return counted.groupBy("id").agg(F.max_by(F.struct("label", "n"), order).alias("v")).select("id", "v.label", "v.n")


def range_parts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Range-partitioned copy with its partition number in ``part``.

    Written out, because a partition number must not change when a task is rerun.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(n, *cols).withColumn("part", F.spark_partition_id()))


def exact_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``rank`` 1..n within ``keys`` by ``order``; large groups span many tasks."""
    parts = range_parts(df, [*keys, *order])
    sizes = parts.groupBy(*keys, "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    local = Window.partitionBy(*keys, "part").orderBy(*order)
    return (
        parts.withColumn("place", F.row_number().over(local))
        .join(offsets, [*keys, "part"])
        .withColumn("rank", F.col("before") + F.col("place"))
        .drop("part", "place", "before")
    )


def cumulative_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value, n, before): distinct values with the number of rows below each.

    Rows are counted by value first, so a value that holds a third of them is one row when
    the values are range-partitioned.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    parts = range_parts(counts, [*keys, value])
    totals = parts.groupBy(*keys, "part").agg(F.sum("n").alias("t"))
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "part", F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("offset"))
    local = Window.partitionBy(*keys, "part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (
        parts.withColumn("below", F.coalesce(F.sum("n").over(local), F.lit(0))).join(offsets, [*keys, "part"])
        .select(*keys, value, "n", (F.col("offset") + F.col("below")).alias("before"))
    )


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """(keys, prob, quantile) with linear interpolation, exact at any group size."""
    counts = materialize(cumulative_counts(df.select(*keys, value), keys, value))
    sizes = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    wanted = sizes.select(*keys, F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob"), "total").withColumn(
        "at", F.col("prob") * (F.col("total") - 1)
    )
    low = F.floor("at")
    weight = F.when(low == F.col("place"), 1 - (F.col("at") - low)).otherwise(F.col("at") - low)
    ends = wanted.withColumn("place", F.explode(F.array_distinct(F.array(low, F.ceil("at"))))).select(
        *keys, "prob", "place", weight.alias("weight")
    )
    ends = broadcast_if_small(ends.select(*[F.col(k).alias(f"_{k}") for k in keys], "prob", "place", "weight"))
    inside = (F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("n"))
    for k in keys:
        inside = inside & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return counts.join(ends, inside).groupBy(*keys, "prob").agg(F.sum(F.col(value) * F.col("weight")).alias("quantile"))


def widest_gap(df: DataFrame, value: str) -> DataFrame:
    """(low, high, gap): the widest gap between consecutive distinct values, first on ties.

    Gaps inside range partitions are found locally; the partition ends supply the others.
    """
    parts = range_parts(df.select(F.col(value).alias("v")).filter("v is not null").distinct(), ["v"])
    inside = parts.select("v", F.lead("v").over(Window.partitionBy("part").orderBy("v")).alias("high"))
    ends = parts.groupBy("part").agg(F.min("v").alias("lo"), F.max("v").alias("v"))
    across = ends.select("v", F.lead("lo").over(Window.orderBy("part")).alias("high"))  # one row per partition
    return (
        inside.unionByName(across).filter("high is not null")
        .select(F.col("v").alias("low"), "high", (F.col("high") - F.col("v")).alias("gap"))
        .agg(F.max_by(F.struct("low", "high", "gap"), F.struct(F.round("gap", 12), -F.col("low"))).alias("g"))
        .select("g.*")
    )


def carry_forward(df: DataFrame, keys: Sequence[str], line: str, cols: Sequence[str], chunk: int = CHUNK_LINES) -> DataFrame:
    """Each of ``cols`` replaced by its last non-null value up to the row, per key.

    A key's lines are cut into chunks of line numbers; the last values of the earlier
    chunks (one row per chunk) are carried first, then the rows inside each chunk, so one
    very long file is still many tasks.
    """
    chunked = df.withColumn("_chunk", F.floor(F.col(line) / chunk))
    lasts = chunked.groupBy(*keys, "_chunk").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(line))).alias(f"_{c}") for c in cols]
    )
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(*keys, "_chunk", *[F.last(f"_{c}", ignorenulls=True).over(before).alias(f"_{c}") for c in cols])
    inside = Window.partitionBy(*keys, "_chunk").orderBy(line).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = chunked.withColumns({c: F.last(c, ignorenulls=True).over(inside) for c in cols})
    return out.join(carried, [*keys, "_chunk"]).withColumns({c: F.coalesce(c, f"_{c}") for c in cols}).select(*df.columns)
