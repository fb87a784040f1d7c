"""Joins and set operations between item tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def left_chain(base: DataFrame, key: str, *others: DataFrame) -> DataFrame:
    """Left joins on the subject key; each table is expected one row per subject."""
    for other in others:
        base = base.join(other, key, "left")
    return base


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default=None) -> DataFrame:
    """``value`` from a dictionary table (key, value), with a default for unknown keys."""
    out = df.join(table.select(key, value), key, "left")
    return out if default is None else out.withColumn(value, F.coalesce(value, F.lit(default)))


def not_in(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return df.join(other.select(key), key, "left_anti")


def only_in(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return df.join(other.select(key), key, "left_semi")


def reindex(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``keys`` (key, ord) in order, with the other table's columns, null where absent."""
    return keys.join(df, key, "left").orderBy("ord")


def membership_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, label_a, label_b): product of two multi-label maps per item."""
    return a.select("id", F.col("label").alias("label_a")).join(b.select("id", F.col("label").alias("label_b")), "id")


def merge_solutions(a: DataFrame, b: DataFrame, truth: DataFrame) -> DataFrame:
    """Full outer merge of two labelings with agreement flags against ``truth``."""
    out = a.select("id", F.col("label").alias("label_a")).join(b.select("id", F.col("label").alias("label_b")), "id", "full")
    out = out.join(truth.select("id", F.col("label").alias("label_ref")), "id", "left")
    agree_a = F.coalesce(F.col("label_a") == F.col("label_ref"), F.lit(False))
    agree_b = F.coalesce(F.col("label_b") == F.col("label_ref"), F.lit(False))
    return out.withColumn("agree_a", agree_a).withColumn("agree_b", agree_b).withColumn(
        "status",
        F.when(agree_a & agree_b, "both").when(agree_a, "first_only").when(agree_b, "second_only").otherwise("neither"),
    )


def compare_methods(assignments: DataFrame, methods: Sequence[str]) -> DataFrame:
    """(id, <method>..., disagree) from long (id, method, label)."""
    wide = assignments.groupBy("id").pivot("method", list(methods)).agg(F.first("label"))
    distinct = F.size(F.array_distinct(F.array_compact(F.array(*methods))))
    return wide.withColumn("disagree", distinct > 1)


def method_sizes(assignments: DataFrame, methods: Sequence[str], labels: Sequence) -> DataFrame:
    """(method, label, n) for every listed combination, 0 when absent."""
    spark = assignments.sparkSession
    grid = spark.createDataFrame(
        [(m, label) for m in methods for label in labels],
        f"method string, label {assignments.schema['label'].dataType.simpleString()}",
    )
    counts = assignments.groupBy("method", "label").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["method", "label"], "left").select("method", "label", F.coalesce("n", F.lit(0)).alias("n"))


def append_sources(tables: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Union of differently sourced tables with a ``source`` tag; a repeated key is an error."""
    out = None
    for name, table in tables.items():
        tagged = table.withColumn("source", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    twice = out.groupBy(key).count().filter("count > 1")
    if not twice.isEmpty():
        raise ValueError(f"{key} repeats across sources")
    return out


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of only one side, with the side they are on."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def assemble_labels(
    items: DataFrame, paired: DataFrame, nearest: DataFrame, overrides: DataFrame
) -> DataFrame:
    """Final label by precedence: paired, then nearest centroid, then expert override.

    ``paired`` (id, label); ``nearest`` (id, assigned, best, redirected, uc_flagged);
    ``overrides`` (id, consensus), where a listed item was put to review and a null
    consensus means the raters disagreed. Only flagged items may be overridden.
    """
    p = paired.select("id", F.col("label").alias("paired_label"))
    n = nearest.select("id", "domain", "redirected", "uc_flagged")
    o = overrides.select("id", "consensus", F.lit(True).alias("reviewed"))
    algorithmic = F.coalesce("paired_label", "domain")
    can_override = F.coalesce("uc_flagged", F.lit(False)) & F.coalesce("reviewed", F.lit(False)) & F.col("paired_label").isNull()
    source = (
        F.when(F.col("paired_label").isNotNull(), "cascade_pairing")
        .when(can_override & F.col("consensus").isNull(), "expert_review_no_consensus")
        .when(can_override & (F.col("consensus") == F.col("domain")), "expert_review_confirmed")
        .when(can_override, "expert_review_override")
        .when(F.col("redirected"), "centroid_uc_redirected")
        .when(F.col("domain").isNotNull(), "centroid_nearest_domain")
    )
    return (
        items.select("id").join(p, "id", "left").join(n, "id", "left").join(o, "id", "left")
        .select(
            "id",
            F.when(can_override, F.coalesce("consensus", "domain")).otherwise(algorithmic).alias("label"),
            algorithmic.alias("algorithmic_label"),
            source.alias("source"),
            F.coalesce("uc_flagged", F.lit(False)).alias("uc_flagged"),
        )
    )


def reference_lookup(df: DataFrame, table: DataFrame, key: Sequence[str], day: str, ranges: Sequence[tuple[int, int, str]]) -> DataFrame:
    """Coefficients by composite key, with ``branch`` naming the day range, null outside."""
    branch: Column = F.lit(None).cast("string")
    for low, high, name in reversed(ranges):
        branch = F.when(F.col(day).between(low, high), F.lit(name)).otherwise(branch)
    return df.withColumn("branch", branch).join(table, list(key), "left")
