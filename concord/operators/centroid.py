"""Centroids, nearest-centroid assignment and the leave-one-out competitor.

Item tables have columns ``id`` and ``vec``; centroid tables ``label`` and ``vec``.
A centroid table is a model: it is broadcast when counted to be small, and the
blocked top-k join takes over when it is not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.functions.vectors import confidence, euclidean, l2_normalize, matrix, vectors
from concord.operators.similarity import block_top, sim_matrix, topk_similar
from concord.runtime import MODEL_ROW_LIMIT, bounded_rows, broadcast_if_small

UNCLASSIFIED = "UC"


def mean_vector(vec: str = "vec") -> Column:
    """Mean of a vector column; a JVM aggregate with map-side partial results."""
    return vector_to_array(Summarizer.mean(array_to_vector(F.col(vec).cast("array<double>"))))


def sum_vector(vec: str = "vec") -> Column:
    return vector_to_array(Summarizer.sum(array_to_vector(F.col(vec).cast("array<double>"))))


def group_centroids(items: DataFrame, label: str = "label", renormalize: bool = False) -> DataFrame:
    """Mean vector per label; ``renormalize`` scales it back to unit length."""
    out = items.groupBy(F.col(label).alias("label")).agg(
        F.count(F.lit(1)).alias("n_items"), mean_vector().alias("vec")
    )
    return out.withColumn("vec", l2_normalize(F.col("vec"))) if renormalize else out


def own_centroid_distance(items: DataFrame) -> DataFrame:
    """(id, label, distance, confidence): Euclidean distance to the centroid of the own label."""
    centers = group_centroids(items).select("label", F.col("vec").alias("center"))
    return items.join(broadcast_if_small(centers), "label").withColumn("distance", euclidean("vec", "center")).select(
        "id", "label", "distance", confidence(F.col("distance")).alias("confidence")
    )


def membership_centroids(items: DataFrame, memberships: DataFrame, first_only: bool = False) -> DataFrame:
    """Centroids where an item counts in every factor it is listed under.

    ``memberships`` is (id, label, ord); ``first_only`` keeps the first-listed one.
    """
    if first_only:
        memberships = memberships.groupBy("id").agg(F.min_by("label", F.struct("ord", "label")).alias("label"))
    return group_centroids(items.join(memberships.select("id", "label"), "id"))


def pooled_centroids(
    source: DataFrame, source_memberships: DataFrame, target: DataFrame, target_memberships: DataFrame
) -> DataFrame:
    """Source items in all their factors and target items in their first one, averaged together."""
    first = target_memberships.groupBy("id").agg(F.min_by("label", F.struct("ord", "label")).alias("label"))
    both = source.join(source_memberships.select("id", "label"), "id").select("label", "vec").unionByName(
        target.join(first, "id").select("label", "vec")
    )
    return group_centroids(both)


def _model(centroids: DataFrame) -> tuple[list, np.ndarray] | None:
    """Centroids as (labels, matrix) in label order, or None when too many to broadcast."""
    rows = centroids.select("label", "vec").limit(MODEL_ROW_LIMIT + 1).collect()
    if len(rows) > MODEL_ROW_LIMIT:
        return None
    rows.sort(key=lambda r: r["label"])
    return [r["label"] for r in rows], np.array([r["vec"] for r in rows], dtype=float)


def nearest_centroids(items: DataFrame, centroids: DataFrame, k: int = 1, metric: str = "cosine") -> DataFrame:
    """(id, label, sim, rank): the k closest centroids of each item, ties to the smaller label."""
    model = _model(centroids)
    if model is None:
        named = centroids.select(F.col("label").alias("id"), "vec")
        return topk_similar(items.select("id", "vec"), named, k, metric=metric).select(
            F.col("left_id").alias("id"), F.col("right_id").alias("label"), "sim", "rank"
        )
    labels, values = model
    spark = items.sparkSession
    shipped = spark.sparkContext.broadcast(values)
    positions = T.StructType(
        [items.schema["id"], T.StructField("pos", T.IntegerType()), T.StructField("sim", T.DoubleType()),
         T.StructField("rank", T.IntegerType())]
    )

    def score(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, cols = block_top(sims := sim_matrix(matrix(batch.column("vec")), shipped.value, metric), k)
            first = np.searchsorted(rows, np.arange(batch.num_rows))
            yield pa.record_batch(
                [batch.column("id").take(pa.array(rows)), pa.array(cols.astype(np.int32)),
                 pa.array(sims[rows, cols]), pa.array((np.arange(len(rows)) - first[rows] + 1).astype(np.int32))],
                names=["id", "pos", "sim", "rank"],
            )

    names = F.array(*[F.lit(label).cast(centroids.schema["label"].dataType) for label in labels])
    return items.select("id", "vec").mapInArrow(score, positions).select(
        "id", F.element_at(names, F.col("pos") + 1).alias("label"), "sim", "rank"
    )


def concept_texts(descriptions: DataFrame, names_only: bool = False) -> DataFrame:
    """(concept, text): the concept's descriptions in order, one text; or just its name.

    ``descriptions`` is (concept, ord, text), a handful of rows per concept.
    """
    if names_only:
        return descriptions.select("concept", F.regexp_replace("concept", "[_-]+", " ").alias("text")).distinct()
    listed = descriptions.groupBy("concept").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("l"))
    return listed.select("concept", F.array_join(F.transform("l", lambda s: s["text"]), " ").alias("text"))


def averaged_concepts(a: DataFrame, b: DataFrame) -> DataFrame:
    """(label, vec): unit mean of the two vectors a concept has in two sources."""
    other = b.select("label", F.col("vec").alias("w"))
    mean = F.zip_with("vec", "w", lambda x, y: (x + y) / 2)
    return a.select("label", "vec").join(other, "label").select("label", l2_normalize(mean).alias("vec"))


def assign_with_floor(items: DataFrame, concepts: DataFrame, min_sim: float) -> DataFrame:
    """Nearest concept, or -1 when even that one is below ``min_sim``."""
    return nearest_centroids(items, concepts).select(
        "id", F.when(F.col("sim") < min_sim, F.lit(-1)).otherwise(F.col("label")).alias("label"), "sim"
    )


def extend_labels(items: DataFrame, centroids: DataFrame, reference: DataFrame) -> DataFrame:
    """Nearest-centroid labels for new items; reference items keep label and distance 0.

    ``reference`` is (id, label); only the other items are scored.
    """
    new = nearest_centroids(items.join(reference, "id", "left_anti"), centroids).select(
        "id", "label", (F.lit(1.0) - F.col("sim")).alias("distance"), F.lit("extended").alias("source")
    )
    kept = items.select("id").join(reference, "id").select(
        "id", "label", F.lit(0.0).alias("distance"), F.lit("reference").alias("source")
    )
    return kept.unionByName(new)


def leave_one_out(items: DataFrame, centroids: DataFrame, pool: DataFrame | None = None, max_domains: int = MODEL_ROW_LIMIT) -> DataFrame:
    """Domain centroids against an "unclassified" centroid that excludes the item itself.

    ``items`` (id, vec) compete against ``centroids`` (label STRING, vec) and the mean of
    ``pool`` (default: the items) without the item: (sum - x) / (n - 1). Items outside
    the pool meet the full mean. One aggregate for the pool sum, then one map-only pass, in
    which every task holds the centroids: more than ``max_domains`` are refused.
    """
    members = items if pool is None else pool
    total = members.agg(F.count(F.lit(1)).alias("n"), sum_vector().alias("s")).first()
    model_rows = bounded_rows(centroids.select("label", "vec"), max_domains, "domain centroids")
    model_rows.sort(key=lambda r: r["label"])
    labels = [r["label"] for r in model_rows]
    spark = items.sparkSession
    shipped = spark.sparkContext.broadcast(
        (np.array([r["vec"] for r in model_rows], dtype=float), np.array(total["s"], dtype=float), int(total["n"]))
    )
    if pool is None:
        scored = items.select("id", "vec", F.lit(True).alias("in_pool"))
    else:
        flag = pool.select("id", F.lit(True).alias("in_pool")).distinct()
        scored = items.select("id", "vec").join(flag, "id", "left").withColumn(
            "in_pool", F.coalesce("in_pool", F.lit(False))
        )
    schema = T.StructType(
        [items.schema["id"], T.StructField("sims", T.ArrayType(T.DoubleType())), T.StructField("sim_uc", T.DoubleType())]
    )

    def score(batches):
        domains, pool_sum, n = shipped.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("vec"))
            inside = batch.column("in_pool").to_numpy(zero_copy_only=False).astype(bool)[:, None]
            other = (pool_sum[None, :] - np.where(inside, x, 0.0)) / np.maximum(n - inside, 1)
            own = np.sqrt((x * x).sum(axis=1) * (other * other).sum(axis=1))
            uc = (x * other).sum(axis=1) / np.where(own == 0, 1.0, own)
            yield pa.record_batch(
                [batch.column("id"), vectors(sim_matrix(x, domains)), pa.array(np.round(uc, 9) + 0.0)],
                names=["id", "sims", "sim_uc"],
            )

    names = F.array(*[F.lit(label) for label in labels])
    sims, best_at = F.col("sims"), F.col("best_at")
    second = F.transform(sims, lambda v, i: F.when(i + 1 == best_at, F.lit(None)).otherwise(v))
    return (
        scored.mapInArrow(score, schema)
        .withColumn("best_at", F.array_position(sims, F.array_max(sims)).cast("int"))
        .withColumn("best_sim", F.array_max(sims))
        .withColumn("second_sim", F.array_max(second))
        .withColumn("second_at", F.array_position(second, F.col("second_sim")).cast("int"))
        .select(
            "id",
            F.when(F.col("sim_uc") > F.col("best_sim"), F.lit(UNCLASSIFIED))
            .otherwise(F.element_at(names, best_at)).alias("assigned"),
            F.greatest("sim_uc", "best_sim").alias("score"),
            F.element_at(names, best_at).alias("best"),
            "best_sim",
            F.when(F.col("second_sim").isNotNull(), F.element_at(names, F.col("second_at"))).alias("second"),
            "second_sim",
            "sim_uc",
            (F.col("sim_uc") - F.col("best_sim")).alias("uc_margin"),
            *[F.element_at(sims, i + 1).alias(f"sim_{label}") for i, label in enumerate(labels)],
        )
    )


def redirect_unclassified(assigned: DataFrame, flag_margin: float = 0.10) -> DataFrame:
    """Unclassified items take their best domain; flagged when the margin is large."""
    is_uc = F.col("assigned") == UNCLASSIFIED
    return (
        assigned.withColumn("domain", F.when(is_uc, F.col("best")).otherwise(F.col("assigned")))
        .withColumn("redirected", is_uc)
        .withColumn("uc_flagged", is_uc & (F.col("uc_margin") > flag_margin))
    )


def competitor_flags(assigned: DataFrame, ambiguous: float = 0.01, uncertain: float = 0.10) -> DataFrame:
    """Margin of best over second, and the two review flags."""
    gap = F.col("best_sim") - F.col("second_sim")
    return (
        assigned.withColumn("best_margin", gap)
        .withColumn("is_ambiguous", F.coalesce(gap < ambiguous, F.lit(False)))
        .withColumn("is_uncertain", F.col("uc_margin") > uncertain)
    )


def representatives(items: DataFrame, centroids: DataFrame, k: int) -> DataFrame:
    """(label, id, sim, rank): the k items nearest each centroid, over all items.

    Each batch keeps k per centroid, so what is shuffled is k rows per centroid and batch.
    """
    model = _model(centroids)
    if model is None:
        named = centroids.select(F.col("label").alias("id"), "vec")
        return topk_similar(named, items.select("id", "vec"), k).select(
            F.col("left_id").alias("label"), F.col("right_id").alias("id"), "sim", "rank"
        )
    labels, values = model
    shipped = items.sparkSession.sparkContext.broadcast(values)
    schema = T.StructType(
        [T.StructField("pos", T.IntegerType()), items.schema["id"], T.StructField("sim", T.DoubleType())]
    )

    def best(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.sort_by("id")
            sims = sim_matrix(shipped.value, matrix(batch.column("vec")))
            rows, cols = block_top(sims, k)
            yield pa.record_batch(
                [pa.array(rows.astype(np.int32)), batch.column("id").take(pa.array(cols)), pa.array(sims[rows, cols])],
                names=["pos", "id", "sim"],
            )

    names = F.array(*[F.lit(label).cast(centroids.schema["label"].dataType) for label in labels])
    order = Window.partitionBy("pos").orderBy(F.desc("sim"), "id")
    return (
        items.select("id", "vec").mapInArrow(best, schema)
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select(F.element_at(names, F.col("pos") + 1).alias("label"), "id", "sim", "rank")
    )


def cluster_summary(representative: DataFrame, sizes: DataFrame) -> DataFrame:
    """Top and mean similarity of the representatives next to the true cluster size."""
    return (
        representative.groupBy("label")
        .agg(F.max("sim").alias("top_sim"), F.avg("sim").alias("mean_sim"),
             F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("ranked"))
        .withColumn("items", F.transform("ranked", lambda r: r["id"]))
        .drop("ranked")
        .join(sizes, "label")
    )


def within_between(items: DataFrame) -> DataFrame:
    """Within- and between-label similarity moments without forming a pair.

    With S the label's vector sum and G its Gram matrix: the sum of all dot products
    in a label is |S|^2, of their squares |G|_F^2; across labels S_a.S_b and <G_a, G_b>.
    ``items`` is (id, vec, label). Spread is the population one; within is null below 2 items.
    """
    moments = label_moments(items)
    a, b = moments.alias("a"), moments.alias("b")
    pairs = a.join(b, F.col("a.label") <= F.col("b.label"))
    product = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    same = F.col("a.label") == F.col("b.label")
    n_a, n_b = F.col("a.n"), F.col("b.n")
    pair_count = F.when(same, n_a * (n_a - 1) / 2).otherwise(n_a * n_b)
    total = product(F.col("a.s"), F.col("b.s"))
    squares = product(F.col("a.g"), F.col("b.g"))
    return (
        pairs.select(
            F.col("a.label").alias("label_a"), F.col("b.label").alias("label_b"),
            F.when(same, "within").otherwise("between").alias("kind"),
            pair_count.cast("long").alias("n_pairs"),
            F.when(same, (total - F.col("a.norm2")) / 2).otherwise(total).alias("total"),
            F.when(same, (squares - F.col("a.norm4")) / 2).otherwise(squares).alias("squares"),
        )
        .withColumn("mean_sim", F.when(F.col("n_pairs") > 0, F.col("total") / F.col("n_pairs")))
        .withColumn(
            "sd_sim",
            F.when(
                F.col("n_pairs") > 0,
                F.sqrt(F.greatest(F.col("squares") / F.col("n_pairs") - F.col("mean_sim") ** 2, F.lit(0.0))),
            ),
        )
        .select("label_a", "label_b", "kind", "n_pairs", "mean_sim", "sd_sim")
    )


def label_moments(items: DataFrame) -> DataFrame:
    """Per label: n, vector sum, flattened Gram matrix, sums of |x|^2 and |x|^4."""
    from concord.operators.spectrum import grouped_gram

    grams = grouped_gram(items.select("label", "vec"), "label")
    norm2 = F.aggregate("vec", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    sums = items.withColumn("q", norm2).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), sum_vector().alias("s"), F.sum("q").alias("norm2"),
        F.sum(F.col("q") * F.col("q")).alias("norm4"),
    )
    return sums.join(grams, "label")
