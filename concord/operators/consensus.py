"""k-means, seeded consensus runs, co-association, agglomerative cuts and stability.

Items are (id, vec). The labels of many runs are kept as one array per item, the item's
*profile*; ``explode_runs`` gives the long (run_id, id, label) form. Co-association of two
items is the share of equal profile entries, so averages of it over groups of items are
counts of (run, label, group) cells and need no item pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.functions.vectors import confidence, euclidean, matrix, vectors
from concord.operators.graph import components, forest, least_block_forest, least_forest
from concord.operators.linkage import FINISH_CLUSTERS, average_merges, complete_merges
from concord.operators.similarity import block_join, near_slices, ordered_once, sim_block, sim_matrix, slice_rows, topk_similar
from concord.operators.spectrum import mix64, per_core
from concord.runtime import MODEL_ROW_LIMIT, bounded_rows, broadcast_if_small, fits, materialize, over_cores

MODEL_BYTES = 32 << 20
# rows of a block whose task returns sums only, and values of their members' table
WIDE_BLOCK_ROWS = 1 << 15
MEMBER_VALUES = 8 << 20
SUB_BATCH = 1024
# of a block of partial sums, at least: 256 KB
SUM_VALUES = 1 << 15
# of blocks whose task may return all their pairs: 4 million of 24 bytes
PAIR_ROWS = 2048
# sizes of models that tasks may hold: runs, (run, label, cluster) cells, and runs whose cells are summed together
MODEL_RUNS = 100_000
MODEL_CELLS = 2_000_000
RUN_GROUP = 100


# ------------------------------------------------------------------ k-means


def _features(items: DataFrame) -> DataFrame:
    return items.withColumn("features", array_to_vector(F.col("vec").cast("array<double>")))


def check_k(k: int, n: int) -> None:
    if not 2 <= k < n:
        raise ValueError(f"need 2 <= k < n, got k={k}, n={n}")


def kmeans(items: DataFrame, k: int, max_iter: int = 300, seed: int = 0) -> DataFrame:
    """(id, label, distance, confidence) from one k-means fit."""
    return _fit_kmeans(items, k, max_iter, seed)[1]


def _fit_kmeans(items: DataFrame, k: int, max_iter: int, seed: int):
    data = _features(items)
    model = KMeans(k=k, maxIter=max_iter, seed=seed, featuresCol="features", predictionCol="label").fit(data)
    centers = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in model.clusterCenters()])
    labelled = (
        model.transform(data)
        .withColumn("distance", euclidean(F.col("vec"), F.element_at(centers, F.col("label") + 1)))
        .select("id", "label", "distance", confidence(F.col("distance")).alias("confidence"))
    )
    return model, labelled


def kmeans_multistart(items: DataFrame, k: int, starts: int = 10, max_iter: int = 300) -> DataFrame:
    """The start with the lowest inertia; a start is a distributed fit, cost a scalar."""
    items = over_cores(items).persist()
    fits = [(_fit_kmeans(items, k, max_iter, seed)) for seed in range(starts)]
    return min(fits, key=lambda f: f[0].summary.trainingCost)[1]


def choose_k(items: DataFrame, k_min: int = 2, k_max: int = 10, max_iter: int = 100, seed: int = 0) -> DataFrame:
    """(k, silhouette, chosen): the centroid-based squared-Euclidean silhouette per k."""
    data = _features(over_cores(items)).persist()
    top = min(k_max, data.limit(k_max + 2).count() - 1)
    scores = []
    for k in range(k_min, top + 1):
        model = KMeans(k=k, maxIter=max_iter, seed=seed, featuresCol="features", predictionCol="label").fit(data)
        scores.append((k, ClusteringEvaluator(predictionCol="label").evaluate(model.transform(data))))
    best = max(scores, key=lambda s: (s[1], -s[0]))[0]
    data.unpersist()
    return items.sparkSession.createDataFrame(
        [(k, float(s), k == best) for k, s in scores], "k int, silhouette double, chosen boolean"
    )


# ------------------------------------------------------------------ many runs at once


def _run_constants(runs: int, offset: int) -> np.ndarray:
    return mix64(np.arange(offset, offset + runs, dtype=np.uint64))


def seed_items(items: DataFrame, k: int, runs: int, offset: int = 0) -> DataFrame:
    """(run, pos, vec): per run the k items with the smallest hash of (run, item).

    A task keeps k per run; the final k per run come from at most k x tasks rows.
    """
    constants = _run_constants(runs, offset)
    schema = "run int, score long, id_hash long, vec array<double>"

    def smallest(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            h = batch.column("h").to_numpy().view(np.uint64)
            x = matrix(batch.column("vec"))
            score = (mix64(h[None, :] ^ constants[:, None]) >> np.uint64(1)).astype(np.int64)
            keep = min(k, score.shape[1])
            at = np.argpartition(score, keep - 1, axis=1)[:, :keep]
            got = (np.take_along_axis(score, at, 1), h.view(np.int64)[at], x[at])
            if held is not None:
                got = tuple(np.concatenate([a, b], axis=1) for a, b in zip(held, got))
                at = np.argsort(got[0], axis=1, kind="stable")[:, :k]
                got = (np.take_along_axis(got[0], at, 1), np.take_along_axis(got[1], at, 1),
                       np.take_along_axis(got[2], at[:, :, None], 1))
            held = got
        if held is not None:
            per_run = held[0].shape[1]
            yield pa.record_batch(
                [pa.array(np.repeat(np.arange(runs, dtype=np.int32), per_run)), pa.array(held[0].ravel()),
                 pa.array(held[1].ravel()), vectors(held[2].reshape(runs * per_run, -1))],
                names=["run", "score", "id_hash", "vec"],
            )

    order = Window.partitionBy("run").orderBy("score", "id_hash")
    return (
        items.select(F.xxhash64("id").alias("h"), F.col("vec").cast("array<double>").alias("vec"))
        .mapInArrow(smallest, schema)
        .withColumn("pos", F.row_number().over(order) - 1)
        .filter(F.col("pos") < k)
        .select("run", "pos", "vec")
    )


def _closest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label (rows, runs) and squared distance to the nearest of each run's centers."""
    runs, k, dims = centers.shape
    flat = centers.transpose(1, 0, 2).reshape(k * runs, dims)
    gap = x @ (-2.0 * flat.T)
    gap += (flat * flat).sum(axis=1)[None, :]
    gap = gap.reshape(len(x), k, runs)
    # one center of all runs at a time; the first of equals stays
    label, best = np.zeros((len(x), runs), dtype=np.int32), gap[:, 0]
    for j in range(1, k):
        np.copyto(label, j, where=gap[:, j] < best)
        np.minimum(best, gap[:, j], out=best)
    best = best + (x * x).sum(axis=1)[:, None]
    return label, np.maximum(best, 0.0, out=best)


def sub_batch(cells: int) -> int:
    """Rows at a time, so that rows x cells takes a few dozen MB."""
    return max(16, min(SUB_BATCH, (4 << 20) // max(cells, 1)))


def lloyd(items: DataFrame, centers: np.ndarray, max_iter: int = 300, tol: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """Lloyd iterations of all runs together: (centers (runs, k, D), inertia per run).

    One job per iteration for the runs that still move; tasks send partial sums as blocks of a range of runs, which are
    added up before they reach the driver. It holds only the centers.
    """
    centers, inertia = centers.copy(), np.zeros(len(centers))
    _, k, dims = centers.shape
    context = items.sparkSession.sparkContext
    moving = np.arange(len(centers))
    dealt = per_core(items.select("vec"))
    for _ in range(max_iter):
        runs, here = len(moving), centers[moving]
        step = sub_batch(runs * k)
        shipped = context.broadcast(here)
        width = k * (dims + 1) + 1  # of a run: sums and sizes of its clusters, and the cost
        # of some 256 KB at least, as few of them as cores
        cuts = np.linspace(0, runs, min(context.defaultParallelism, runs, 1 + runs * width // SUM_VALUES) + 1).astype(int)

        def partial(batches, shipped=shipped, runs=runs, step=step, width=width, cuts=cuts):
            c = shipped.value
            sums, cost = np.zeros((k, runs, dims + 1)), np.zeros(runs)
            seen = False
            for batch in batches:
                whole = matrix(batch.column("vec"))
                for start in range(0, len(whole), step):
                    x = whole[start : start + step]
                    label, gap = _closest(x, c)
                    counted = np.concatenate([x, np.ones((len(x), 1))], axis=1)
                    for j in range(k):
                        sums[j] += (label == j).T.astype(np.float64) @ counted
                    cost += gap.sum(axis=0)
                    seen = True
            if seen:
                rows = np.concatenate([sums.transpose(1, 0, 2).reshape(runs, -1), cost[:, None]], axis=1)
                parts = [rows[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
                yield pa.record_batch([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array(parts, pa.binary())], names=["part", "sums"])

        def added(batches):
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                for part, sums in zip(batch.column("part").to_pylist(), batch.column("sums")):
                    held[part] = held.get(part, 0.0) + np.frombuffer(sums.as_buffer())
            for part, sums in held.items():
                yield pa.record_batch([pa.array([part], pa.int32()), pa.array([sums.tobytes()], pa.binary())], names=["part", "sums"])

        parts = dealt.mapInArrow(partial, "part int, sums binary").repartition(len(cuts) - 1, "part")
        total = np.zeros((runs, width))
        for r in parts.mapInArrow(added, "part int, sums binary").collect():
            total[cuts[r["part"]] : cuts[r["part"] + 1]] = np.frombuffer(r["sums"]).reshape(-1, width)
        cells = total[:, :-1].reshape(runs, k, dims + 1)
        sizes = cells[:, :, dims:]
        moved = np.where(sizes > 0, cells[:, :, :dims] / np.maximum(sizes, 1), here)
        centers[moving], inertia[moving] = moved, total[:, -1]
        shipped.unpersist()
        moving = moving[np.abs(moved - here).max(axis=(1, 2)) > tol]
        if not len(moving):
            break
    return centers, inertia


def label_runs(items: DataFrame, centers: np.ndarray) -> DataFrame:
    """(id, labels ARRAY<INT>): the nearest center of every run."""
    shipped = items.sparkSession.sparkContext.broadcast(centers)
    step = sub_batch(centers.shape[0] * centers.shape[1])
    schema = T.StructType([items.schema["id"], T.StructField("labels", T.ArrayType(T.IntegerType()))])

    def label(batches):
        for batch in batches:
            whole = matrix(batch.column("vec"))
            if not len(whole):
                continue
            out = np.concatenate(
                [_closest(whole[s : s + step], shipped.value)[0] for s in range(0, len(whole), step)]
            ).astype(np.int32)
            offsets = pa.array(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32))
            yield pa.record_batch(
                [batch.column("id"), pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))], names=["id", "labels"]
            )

    return items.select("id", "vec").mapInArrow(label, schema)


def consensus_runs(items: DataFrame, k: int, runs: int, max_iter: int = 300) -> tuple[DataFrame, DataFrame]:
    """R seeded k-means runs: (profiles (id, labels), runs (run_id, inertia)).

    Runs go through the data together, in batches whose centers stay below MODEL_BYTES.
    Seeds are hash-ordered items, so a rerun gives the same labels.
    """
    items = over_cores(items.select("id", F.col("vec").cast("array<double>").alias("vec"))).persist()
    n_dims = items.select(F.size("vec")).first()[0]
    per_batch = max(1, MODEL_BYTES // (8 * k * n_dims))
    profiles, costs = None, []
    for offset in range(0, runs, per_batch):
        count = min(per_batch, runs - offset)
        centers = np.zeros((count, k, n_dims))
        for r in seed_items(items, k, count, offset).collect():
            centers[r["run"], r["pos"]] = r["vec"]
        centers, inertia = lloyd(items, centers, max_iter)
        costs += [(offset + i, float(v)) for i, v in enumerate(inertia)]
        part = label_runs(items, centers)
        profiles = part if profiles is None else profiles.join(
            part.withColumnRenamed("labels", "more"), "id"
        ).select("id", F.concat("labels", "more").alias("labels"))
    return profiles, items.sparkSession.createDataFrame(costs, "run_id int, inertia double")


def explode_runs(profiles: DataFrame) -> DataFrame:
    return profiles.select("id", F.posexplode("labels").alias("run_id", "label"))


def profiles_from_long(labels: DataFrame) -> DataFrame:
    """(run_id, id, label) rows to one label array per item, in run order."""
    return labels.groupBy("id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("run_id", "label"))), lambda s: s["label"]).alias("labels")
    )


# ------------------------------------------------------------------ co-association


def _one_hot(labels: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return (labels[:, :, None] == codes[None, None, :]).reshape(len(labels), -1).astype(np.float32)


def _shares(lt: pa.Table, rt: pa.Table) -> np.ndarray:
    a, b = matrix(lt["vec"]), matrix(rt["vec"])
    codes = np.unique(np.concatenate([a.ravel(), b.ravel()]))
    return np.round((_one_hot(a, codes) @ _one_hot(b, codes).T).astype(float) / a.shape[1], 9)


def run_bands(runs: int, min_share: float) -> list[tuple[int, int]]:
    """(first run, number) of bands of runs, one of which is equal throughout in any two profiles of at least ``min_share``.

    Such profiles differ in ``runs - m`` runs at most, ``m`` being the least number of equal labels: of one band more
    than that, one has no difference. No bands where any two profiles have the share.
    """
    least = next((m for m in range(runs + 1) if round(m / runs, 9) >= min_share), runs + 1)
    n = min(runs - least + 1, runs) if least else 0
    cuts = [i * runs // n for i in range(n + 1)] if n > 0 else []
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def coassociation(profiles: DataFrame, min_share: float) -> DataFrame:
    """(id_a, id_b, share) for pairs a < b whose share of equal labels is >= ``min_share``.

    Only profiles that agree in one of :func:`run_bands` throughout are compared, in blocks, and in the first
    such band only. All profiles meet where the groups of equal bands would cost more than that; the pairs are the same.
    """
    id_type = profiles.schema["id"].dataType
    schema = T.StructType(
        [T.StructField("id_a", id_type), T.StructField("id_b", id_type), T.StructField("share", T.DoubleType())]
    )

    def pairs(key, lt, rt, share, keep):
        rows, cols = np.nonzero(keep)
        out = pa.table({"id_a": lt["id"].take(pa.array(rows)), "id_b": rt["id"].take(pa.array(cols)), "share": pa.array(share[rows, cols])})
        return ordered_once(out, key, "id_a", "id_b")

    def every(key, lt, rt):
        if not lt.num_rows or not rt.num_rows:
            return _empty(schema)
        share = _shares(lt, rt)
        return pairs(key, lt, rt, share, share >= min_share)

    data = profiles.select("id", F.col("labels").alias("vec"))
    first = data.select(F.size("vec").alias("runs")).first()
    bands = run_bands(first["runs"], min_share) if first else []
    if not bands:
        return block_join(data, data, every, schema, block_rows=PAIR_ROWS, half=True)
    codes = F.array(*[F.xxhash64(F.slice("vec", a + 1, n)) for a, n in bands])
    coded = data.select("id", "vec", codes.alias("codes"))
    groups = materialize(coded.select(F.posexplode("codes").alias("band", "code")).groupBy("band", "code").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    cost = groups.agg(F.sum(F.col("n").cast("double") ** 2)).first()[0] or 0.0
    rows = data.count()
    if cost > float(rows) ** 2:
        return block_join(data, data, every, schema, block_rows=PAIR_ROWS, half=True, sizes=(rows, rows))

    def banded(key, lt, rt):
        if not lt.num_rows or not rt.num_rows:
            return _empty(schema)
        share = _shares(lt, rt)
        keep = share >= min_share
        a, b = (t["codes"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1) for t in (lt, rt))
        # a pair that agrees in an earlier band is found there
        for band in range(key[0].as_py()):
            keep &= a[:, band][:, None] != b[:, band][None, :]
        return pairs(key, lt, rt, share, keep)

    spread = coded.select("id", "vec", "codes", F.posexplode("codes").alias("band", "code"))
    count = F.ceil(F.col("n") / PAIR_ROWS).cast("int").alias("blocks")
    spread = spread.join(groups.select("band", "code", count), ["band", "code"])
    return block_join(spread, spread, banded, schema, keys=["band", "code"], block_rows=PAIR_ROWS, half=True, sizes=(rows, rows), blocks="blocks")


def _empty(schema: T.StructType) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema).empty_table()


def run_cells(profiles: DataFrame, clusters: DataFrame) -> DataFrame:
    """(run_id, label, cluster, n): how the runs' labels meet the consensus clusters."""
    return (
        profiles.join(clusters.select("id", "cluster"), "id")
        .select("cluster", F.posexplode("labels").alias("run_id", "label"))
        .groupBy("run_id", "label", "cluster").count().withColumnRenamed("count", "n")
    )


def run_codes(profiles: DataFrame) -> list[np.ndarray]:
    """The labels of each run, sorted: a model of runs x k numbers."""
    found = explode_runs(profiles).groupBy("run_id").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    rows = sorted(bounded_rows(found, MODEL_RUNS, "runs"), key=lambda r: r["run_id"])
    return [np.array(r["labels"], dtype=np.int64) for r in rows]


def _coded(labels: np.ndarray, codes: list[np.ndarray]) -> np.ndarray:
    """Labels (rows, runs) as numbers that are distinct over all runs."""
    starts = np.cumsum([0, *[len(c) for c in codes]])
    return np.stack([starts[r] + np.searchsorted(c, labels[:, r]) for r, c in enumerate(codes)], axis=1)


def item_stability(profiles: DataFrame, clusters: DataFrame) -> DataFrame:
    """(id, cluster, stability, cluster_size): mean co-association with the own cluster, self excluded.

    Summed over runs it is (cell size - 1) / (cluster size - 1); singletons get 1.0. The cells
    of up to ``MODEL_CELLS`` (run, label, cluster) are an array that every task indexes; more
    are joined to the exploded profiles, with the same result.
    """
    cells = materialize(run_cells(profiles, clusters))
    sizes = cells.filter("run_id = 0").groupBy("cluster").agg(F.sum("n").alias("size"))
    joined = profiles.join(clusters.select("id", "cluster"), "id")
    if fits(cells, MODEL_CELLS):
        same = _summed_cells(joined, cells, run_codes(profiles))
    else:
        long = joined.select("id", "cluster", F.size("labels").alias("runs"), F.posexplode("labels").alias("run_id", "label"))
        same = long.join(cells, ["run_id", "label", "cluster"]).groupBy("id", "cluster", "runs").agg(F.sum("n").alias("same"))
    size, runs = F.col("size"), F.col("runs")
    value = F.when(size > 1, (F.col("same") - runs) / F.nullif(runs * (size - 1), F.lit(0))).otherwise(F.lit(1.0))
    return same.join(broadcast_if_small(sizes), "cluster").select("id", "cluster", value.alias("stability"), size.alias("cluster_size"))


def _summed_cells(joined: DataFrame, cells: DataFrame, codes: list[np.ndarray]) -> DataFrame:
    """(id, cluster, runs, same): the sizes of an item's cells, summed over the runs."""
    rows = cells.collect()  # at most MODEL_CELLS, counted by the caller
    names = sorted({r["cluster"] for r in rows})
    starts = np.cumsum([0, *[len(c) for c in codes]])
    table = np.zeros((len(names), starts[-1]), dtype=np.int64)
    place = {c: i for i, c in enumerate(names)}
    for r in rows:
        table[place[r["cluster"]], starts[r["run_id"]] + np.searchsorted(codes[r["run_id"]], r["label"])] = r["n"]
    shipped = joined.sparkSession.sparkContext.broadcast((place, table, codes))
    fields = [joined.schema["id"], joined.schema["cluster"]]

    def look_up(batches):
        at, sums, known = shipped.value
        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.array([at[c] for c in batch.column("cluster").to_pylist()])
            coded = _coded(matrix(batch.column("labels")).astype(np.int64), known)
            same = sums[own[:, None], coded].sum(axis=1)
            yield pa.record_batch(
                [batch.column("id"), batch.column("cluster"), pa.array(np.full(len(own), coded.shape[1], dtype=np.int32)), pa.array(same)],
                names=["id", "cluster", "runs", "same"],
            )

    schema = T.StructType([*fields, T.StructField("runs", T.IntegerType()), T.StructField("same", T.LongType())])
    return joined.select("id", "cluster", "labels").mapInArrow(look_up, schema)


def position_frequency(long_labels: DataFrame) -> DataFrame:
    """(id, position, share): position is the rank of the label id among its run's labels."""
    used = long_labels.select("run_id", "label").distinct()
    rank = F.dense_rank().over(Window.partitionBy("run_id").orderBy("label")) - 1
    runs = F.count_distinct("run_id")
    total = long_labels.agg(runs.alias("r"))
    return (
        long_labels.join(used.withColumn("position", rank), ["run_id", "label"])
        .groupBy("id", "position").count()
        .select("id", "position", (F.col("count") / total.scalar()).alias("share"))
    )


def _choose2(n):
    return n * (n - 1) / 2


def ari_from_sums(cells, left, right, n):
    """Adjusted Rand index from the pair sums of cells and both margins; 1.0 if degenerate (also for a single item)."""
    expected = F.coalesce(F.try_divide(left * right, _choose2(n)), F.lit(0.0))
    top = (left + right) / 2
    # relative: pair sums grow with the square of n
    same = F.abs(top - expected) <= 1e-12 * F.greatest(F.abs(top), F.abs(expected), F.lit(1.0))
    return F.when(same, F.lit(1.0)).otherwise(F.try_divide(cells - expected, top - expected))


def ari_to_consensus(profiles: DataFrame, clusters: DataFrame) -> DataFrame:
    """(run_id, ari) of every run against the consensus labels."""
    return _ari_by_run(run_cells(profiles, clusters))


def _pair_sums(cells: DataFrame) -> DataFrame:
    """Per run: item count and the pair sums of cells, labels and clusters.

    A cell of n items in a margin of N adds n (N - 1) / 2 pairs, so the margins are window
    sums over the few cells of a run.
    """
    n = F.col("n")
    counted = cells.withColumn("n", n.cast("double"))
    margin = lambda c: F.sum("n").over(Window.partitionBy("run_id", c))
    return counted.withColumn("nl", margin("label")).withColumn("nc", margin("cluster")).groupBy("run_id").agg(
        F.sum(n).alias("total"), F.sum(_choose2(n)).alias("together"),
        F.sum(n * (F.col("nl") - 1) / 2).alias("by_label"), F.sum(n * (F.col("nc") - 1) / 2).alias("by_cluster"),
    )


def _run_ari():
    return ari_from_sums(F.col("together"), F.col("by_label"), F.col("by_cluster"), F.col("total"))


def _ari_by_run(cells: DataFrame) -> DataFrame:
    return _pair_sums(cells).select("run_id", _run_ari().alias("ari"))


def consensus_validation(profiles: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row: ARI of the runs to the consensus, within/between co-association, coverage.

    Spread is the population one; singletons never count as well represented.
    """
    covered = item_stability(profiles, clusters).agg(
        (100.0 * F.avg(F.when((F.col("stability") > 0.5) & (F.col("cluster_size") > 1), 1.0).otherwise(0.0))).alias("pct")
    )
    all_pairs = _choose2(F.col("total"))
    # no pairs within (only singletons) or between (one cluster): 0.0
    share = lambda part, whole: F.coalesce(F.try_divide(part, whole), F.lit(0.0))
    within = share(F.sum("together"), F.sum("by_cluster"))
    between = share(F.sum("by_label") - F.sum("together"), F.sum(all_pairs - F.col("by_cluster")))
    return _pair_sums(run_cells(profiles, clusters)).withColumn("ari", _run_ari()).agg(
        F.avg("ari").alias("mean_ari"), F.median("ari").alias("median_ari"), F.stddev_pop("ari").alias("sd_ari"),
        F.min("ari").alias("min_ari"), F.max("ari").alias("max_ari"), F.count("ari").alias("n_runs"),
        within.alias("within"), between.alias("between"), F.when(between > 0, within / between).alias("separation"),
    ).withColumn("well_represented_pct", covered.scalar())


def run_pair_ari(profiles: DataFrame) -> DataFrame:
    """(run_a, run_b, ari) for all pairs of runs.

    The contingency cells of two runs are a block of the product of the one-hot profiles, so
    a task adds one product per pair of groups of ``RUN_GROUP`` runs, and a group pair's sum
    gives the index of all its run pairs at once.
    """
    codes = run_codes(profiles)
    runs = len(codes)
    groups = -(-runs // RUN_GROUP)
    pairs = [(i, j) for i in range(groups) for j in range(i, groups)]
    shipped = profiles.sparkSession.sparkContext.broadcast(codes)

    def span(g: int) -> range:
        return range(g * RUN_GROUP, min(runs, (g + 1) * RUN_GROUP))

    def one_hot(labels: np.ndarray, g: int, known: list[np.ndarray]) -> np.ndarray:
        of = [known[r] for r in span(g)]
        coded = _coded(labels[:, span(g).start : span(g).stop], of)
        out = np.zeros((len(labels), sum(len(c) for c in of)))
        np.put_along_axis(out, coded, 1.0, axis=1)
        return out

    def partial(batches):
        known, held = shipped.value, {}
        for batch in batches:
            labels = matrix(batch.column("labels")).astype(np.int64)
            for at in range(0, len(labels), SUB_BATCH):
                hot = [one_hot(labels[at : at + SUB_BATCH], g, known) for g in range(groups)]
                for p, (i, j) in enumerate(pairs):
                    held[p] = held.get(p, 0.0) + hot[i].T @ hot[j]
        for p, cells in held.items():
            yield pa.record_batch([pa.array([p], pa.int32()), pa.array([cells.tobytes()], pa.binary())], names=["pair", "cells"])

    def indices(batches):
        known, held = shipped.value, {}
        for batch in batches:
            for p, cells in zip(batch.column("pair").to_pylist(), batch.column("cells").to_pylist()):
                held[p] = held.get(p, 0.0) + np.frombuffer(cells)
        for p, flat in held.items():
            i, j = pairs[p]
            left, right = [np.array([len(known[r]) for r in span(g)]) for g in (i, j)]
            cells = flat.reshape(left.sum(), right.sum())
            cut = lambda x, sizes, axis: np.add.reduceat(x, np.cumsum(sizes) - sizes, axis=axis)
            n = cut(cut(cells, left, 0), right, 1)
            both = cut(cut(cells * (cells - 1) / 2, left, 0), right, 1)
            by_left, by_right = cut(cells, right, 1), cut(cells, left, 0)
            left_pairs = cut(by_left * (by_left - 1) / 2, left, 0)
            right_pairs = cut(by_right * (by_right - 1) / 2, right, 1)
            a, b = np.meshgrid(span(i), span(j), indexing="ij")
            keep = a < b
            columns = [pa.array(a[keep].astype(np.int32)), pa.array(b[keep].astype(np.int32)), *(pa.array(x[keep]) for x in (both, left_pairs, right_pairs, n))]
            yield pa.record_batch(columns, names=["run_a", "run_b", "both", "by_a", "by_b", "n"])

    parts = profiles.select("labels").mapInArrow(partial, "pair int, cells binary")
    sums = parts.repartition(len(pairs), "pair").mapInArrow(indices, "run_a int, run_b int, both double, by_a double, by_b double, n double")
    return sums.select("run_a", "run_b", ari_from_sums(F.col("both"), F.col("by_a"), F.col("by_b"), F.col("n")).alias("ari"))


def summary_stats(table: DataFrame, column: str) -> DataFrame:
    """Mean, median, population sd, min and max of a per-run quantity."""
    c = F.col(column)
    return table.agg(
        F.lit(column).alias("metric"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.median(c).alias("median"),
        F.stddev_pop(c).alias("sd"), F.min(c).alias("min"), F.max(c).alias("max"),
    )


def run_summary(runs: DataFrame, pair_ari: DataFrame) -> DataFrame:
    """Inertia (and silhouette, when present) of the runs and the pairwise ARI, one row each."""
    out = summary_stats(pair_ari, "ari")
    for column in [c for c in ("inertia", "silhouette") if c in runs.columns]:
        out = out.unionByName(summary_stats(runs, column))
    return out


# ------------------------------------------------------------------ consensus cut


def _profile_vectors(profiles: DataFrame) -> DataFrame:
    """(id, vec, size): the one-hot vector of each different profile, under its smallest id; inner products are shares of equal labels."""
    labels = profiles.select(F.explode(F.array_distinct("labels")).alias("label")).distinct()
    codes = sorted(r["label"] for r in labels.collect())  # at most k values
    runs = profiles.select(F.size("labels")).first()[0]
    unit = 1.0 / float(np.sqrt(runs))
    code_array = F.array(*[F.lit(c) for c in codes])
    one_hot = F.flatten(
        F.transform("labels", lambda x: F.transform(code_array, lambda c: F.when(c == x, F.lit(unit)).otherwise(F.lit(0.0))))
    )
    return materialize(
        profiles.groupBy("labels").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("size"))
        .select("id", one_hot.alias("vec"), "size")
    )


def average_linkage(profiles: DataFrame) -> DataFrame:
    """Merge table (child, parent, sim, step) of average linkage on co-association.

    The average co-association of two clusters is the inner product of their mean one-hot
    profiles, so a cluster is one vector and no pair table exists. Items with the same
    profile merge first, at 1.0; the rest is :func:`average_merges`.
    """
    return average_merges(_profile_vectors(profiles))


def complete_linkage(profiles: DataFrame) -> DataFrame:
    """As :func:`average_linkage`, of complete linkage: the least co-association of two clusters' items."""
    return complete_merges(_profile_vectors(profiles))


def _jump(parent: DataFrame) -> DataFrame:
    """(node, root) from (node, up) by pointer jumping: the depth halves with every join."""
    while True:
        above = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
        step = materialize(parent.join(above, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
        parent = step.select("node", "up")
        if step.filter("moved").isEmpty():
            return parent.withColumnRenamed("up", "root")


def spanning_forest(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Maximum spanning forest of (id_a, id_b, share): its edges, and (id, root) components.

    Every component takes its best outgoing edge at once, so the number of components at
    least halves per round; parallel edges between two components are reduced to the best.
    A total order on edges (share, then both ids) keeps the choice free of cycles.
    """
    one = edges.select(F.col("id_a").alias("ca"), F.col("id_b").alias("cb"), F.struct(
        (-F.col("share")).alias("minus"), F.least("id_a", "id_b").alias("lo"), F.greatest("id_a", "id_b").alias("hi")).alias("e"))
    active = materialize(one.unionByName(one.select(F.col("cb").alias("ca"), F.col("ca").alias("cb"), "e")))
    label, tree = nodes.select("id", F.col("id").alias("root")), None
    while True:
        rows = active.select("ca").distinct().limit(FINISH_CLUSTERS + 1).count()
        if rows <= FINISH_CLUSTERS:
            break
        best = materialize(active.groupBy("ca").agg(F.min(F.struct("e", "cb")).alias("b")).select("ca", "b.cb", "b.e"))
        tree = best.select("e") if tree is None else tree.unionByName(best.select("e"))
        # two components that choose each other: the smaller one becomes the root
        back = best.select(F.col("ca").alias("cb"), F.col("cb").alias("back"))
        hooked = best.join(back, "cb", "left").select(
            F.col("ca").alias("node"), F.when((F.col("back") == F.col("ca")) & (F.col("ca") < F.col("cb")), F.col("ca")).otherwise(F.col("cb")).alias("up")
        )
        roots = _jump(materialize(hooked))
        label = materialize(_relabel(label, roots))
        ra = roots.select(F.col("node").alias("ca"), F.col("root").alias("ra"))
        rb = roots.select(F.col("node").alias("cb"), F.col("root").alias("rb"))
        active = materialize(
            active.join(ra, "ca").join(rb, "cb").filter("ra <> rb").groupBy(F.col("ra").alias("ca"), F.col("rb").alias("cb")).agg(F.min("e").alias("e"))
        )
    # at most FINISH_CLUSTERS components: the rest of the tree from their best mutual edges
    root: dict = {}

    def find(c):
        while root.get(c, c) != c:
            c = root[c]
        return c

    last = []
    for r in sorted(active.collect(), key=lambda r: tuple(r["e"])):
        a, b = sorted((find(r["ca"]), find(r["cb"])))
        if a != b:
            root[b] = a
            last.append((r["e"],))
    spark = nodes.sparkSession
    final = spark.createDataFrame([(c, find(c)) for c in root] or [], T.StructType([T.StructField("node", nodes.schema["id"].dataType), T.StructField("root", nodes.schema["id"].dataType)]))
    tail = spark.createDataFrame(last, active.select("e").schema)
    tree = tail if tree is None else tree.unionByName(tail)
    tree = tree.distinct().select(F.col("e.lo").alias("id_a"), F.col("e.hi").alias("id_b"), (-F.col("e.minus")).alias("share"))
    return tree, _relabel(label, final)


def _relabel(label: DataFrame, roots: DataFrame) -> DataFrame:
    return label.join(roots.select(F.col("node").alias("root"), F.col("root").alias("new")), "root", "left").select(
        "id", F.coalesce("new", "root").alias("root")
    )


def coassociation_forest(profiles: DataFrame) -> DataFrame:
    """(id_a, id_b, share): the maximum spanning forest of the co-association of all items, as :func:`spanning_forest` of all pairs gives it.

    An item hangs on the smallest id with its profile, by a link of 1.0. Different profiles meet in blocks, and a pair
    of blocks returns the forest of its own links, fewer than it has rows: no other link can be in the whole forest.
    """
    id_type = profiles.schema["id"].dataType
    schema = T.StructType([T.StructField("id_a", id_type), T.StructField("id_b", id_type), T.StructField("share", T.DoubleType())])

    def kernel(_key, lt, rt):
        if not lt.num_rows or not rt.num_rows:
            return _empty(schema)
        names = pa.concat_arrays([lt["id"].combine_chunks(), rt["id"].combine_chunks()])
        _, first, place = np.unique(names.to_numpy(zero_copy_only=False), return_index=True, return_inverse=True)
        n, (left, right) = len(first), np.split(place, [lt.num_rows])
        runs = matrix(lt["vec"].slice(0, 1)).shape[1]
        kept: list[np.ndarray] = []
        step = slice_rows(rt.num_rows)
        for at in range(0, lt.num_rows, step):
            own = left[at : at + step]
            equal = np.rint(_shares(lt.slice(at, step), rt) * runs).astype(np.int64)
            low, high = np.minimum(own[:, None], right[None, :]), np.maximum(own[:, None], right[None, :])
            # the largest share first, then the smaller ids
            keys = np.where((equal > 0) & (low != high), ((runs - equal) * n + low) * n + high, np.iinfo(np.int64).max)
            i, j = least_block_forest(n, keys, own, right)
            kept.append(keys[i, j])
        keys = np.unique(np.concatenate(kept))
        keys = keys[least_forest(n, keys, keys // n % n, keys % n)]
        ends = [names.take(pa.array(first[x])) for x in (keys // n % n, keys % n)]
        return pa.table([*ends, pa.array(np.round((runs - keys // (n * n)) / runs, 9))], names=["id_a", "id_b", "share"])

    grouped = materialize(profiles.groupBy("labels").agg(F.min("id").alias("leader")))
    leaders = materialize(grouped.select(F.col("leader").alias("id"), F.col("labels").alias("vec")))
    rows = leaders.count()
    links = block_join(leaders, leaders, kernel, schema, half=True, sizes=(rows, rows), slices=False)
    tree = spanning_forest(links, leaders.select("id"))[0]
    same = profiles.join(grouped, "labels").filter("id <> leader").select(F.col("leader").alias("id_a"), F.col("id").alias("id_b"), F.lit(1.0).alias("share"))
    return materialize(tree.unionByName(same))


def single_linkage_cut(edges: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(id, root): single linkage is the maximum spanning forest without its lowest edges."""
    return _cut_tree(materialize(spanning_forest(edges, nodes)[0]), nodes, k)


def _cut_tree(tree: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    components = nodes.count() - tree.count()
    undo = max(k - components, 0)
    if undo:
        lowest = tree.orderBy("share", F.desc("id_a"), F.desc("id_b")).limit(undo)
        tree = tree.join(lowest, ["id_a", "id_b"], "left_anti")
    return _join_spare(materialize(spanning_forest(tree, nodes)[1]), components, k)


def cut_merges(merges: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(id, root): clusters after undoing the k - 1 last (lowest) merges.

    Only those k - 1 rows are sorted out; the rest is pointer jumping over the merge forest.
    When the graph has c > 1 components, c - 1 of the splits are already there.
    """
    components = nodes.count() - merges.count()
    undo = max(k - components, 0)
    kept = merges
    if undo:
        last = merges.orderBy("sim", F.desc("step"), F.desc("child")).limit(undo)
        kept = merges.join(last.select("child"), "child", "left_anti")
    parent = nodes.select(F.col("id").alias("node")).join(kept.select(F.col("child").alias("node"), "parent"), "node", "left")
    roots = _jump(materialize(parent.select("node", F.coalesce("parent", "node").alias("up"))))
    return _join_spare(roots.withColumnRenamed("node", "id"), components, k)


def _join_spare(parent: DataFrame, components: int, k: int) -> DataFrame:
    """Components beyond k have similarity 0 to each other: fold the surplus into the first."""
    if components <= k:
        return parent
    roots = parent.select("root").distinct()
    keep = roots.orderBy("root").limit(k)
    first = keep.agg(F.min("root"))
    return parent.join(keep.withColumn("kept", F.lit(True)), "root", "left").select(
        "id", F.when(F.col("kept"), F.col("root")).otherwise(first.scalar()).alias("root")
    )


def number_clusters(roots: DataFrame) -> DataFrame:
    """(id, cluster): 0-based cluster numbers in the order of their smallest id."""
    first = roots.groupBy("root").agg(F.min("id").alias("first"))
    numbered = first.withColumn("cluster", F.row_number().over(Window.orderBy("first")) - 1)  # k rows
    return roots.join(numbered.select("root", "cluster"), "root").select("id", "cluster")


def consensus_cut(profiles: DataFrame, k: int, linkage: str = "average") -> DataFrame:
    """(id, cluster): the co-association dendrogram cut into k clusters."""
    if linkage in ("average", "complete"):
        merges = average_linkage(profiles) if linkage == "average" else complete_linkage(profiles)
        leaders = profiles.groupBy("labels").agg(F.min("id").alias("leader"))
        nodes = leaders.select(F.col("leader").alias("id"))
        roots = cut_merges(merges, nodes, k)
        every = profiles.join(leaders, "labels").select("id", F.col("leader"))
        spread = every.join(roots.withColumnRenamed("id", "leader"), "leader").select("id", "root")
        return number_clusters(spread)
    nodes = profiles.select("id")
    if linkage != "single":
        raise ValueError(f"unknown linkage {linkage}")
    return number_clusters(_cut_tree(coassociation_forest(profiles), nodes, k))


# ------------------------------------------------------------------ quality and density


def silhouette(items: DataFrame) -> DataFrame:
    """(id, label, a, b, silhouette): exact Euclidean silhouette without noise (-1).

    Block pairs send back one distance sum per item and label, not pairs.
    """
    known = items.filter("label <> -1").select("id", "vec", "label")
    schema = T.StructType([known.schema["id"], T.StructField("other", T.IntegerType()), T.StructField("total", T.DoubleType())])

    def kernel(_key, lt, rt):
        if not lt.num_rows or not rt.num_rows:
            return _empty(schema)
        gap = -sim_block(lt, rt, "euclidean")
        labels = rt["label"].to_numpy()
        codes, index = np.unique(labels, return_inverse=True)
        member = np.zeros((len(labels), len(codes)))
        member[np.arange(len(labels)), index] = 1.0
        sums = gap @ member
        rows, cols = np.indices(sums.shape)
        return pa.table(
            [lt["id"].take(pa.array(rows.ravel())), pa.array(codes[cols.ravel()].astype(np.int32)), pa.array(sums.ravel())],
            names=["id", "other", "total"],
        )

    sums = block_join(known.select("id", "vec"), known, kernel, schema).groupBy("id", "other").agg(F.sum("total").alias("total"))
    sizes = known.groupBy(F.col("label").alias("other")).agg(F.count(F.lit(1)).alias("n"))
    own = F.col("other") == F.col("label")
    out = (
        sums.join(sizes, "other").join(known.select("id", "label"), "id")
        .groupBy("id", "label")
        .agg(
            F.max(F.when(own & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))).alias("a"),
            F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b"),
        )
    )
    return out.filter(F.col("b").isNotNull()).withColumn(
        "silhouette",
        F.when(F.col("a").isNull(), F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b")),
    )


def mean_silhouette(items: DataFrame) -> DataFrame:
    """One row; null when fewer than two clusters remain."""
    return silhouette(items).agg(F.avg("silhouette").alias("silhouette"), F.count(F.lit(1)).alias("n_items"))


def _wide_block(rows: int, width: int, cores: int) -> int:
    """Rows of a block: every block is sent to all others, so they are as few as the cores and a task's memory allow."""
    across = int(np.ceil(np.sqrt(4 * cores)))
    return max(SUB_BATCH, min(WIDE_BLOCK_ROWS, MEMBER_VALUES // max(width, 1), -(-rows // across)))


def run_silhouettes(items: DataFrame, profiles: DataFrame) -> DataFrame:
    """(run_id, silhouette): exact mean Euclidean silhouette of every run, without its noise (-1).

    The distances of a block pair are computed once and summed by the labels of all runs in
    one product; what leaves a task is one sum per item, run and label. Null for a run with
    fewer than two clusters.
    """
    codes = [c[c != -1] for c in run_codes(profiles)]
    starts = np.cumsum([0, *[len(c) for c in codes]])
    runs, width = len(codes), int(starts[-1])
    table = np.zeros(width)
    counted = explode_runs(profiles).filter("label <> -1").groupBy("run_id", "label").agg(F.count(F.lit(1)).alias("n"))
    for r in bounded_rows(counted, MODEL_CELLS, "labels of all runs"):
        table[starts[r["run_id"]] + np.searchsorted(codes[r["run_id"]], r["label"])] = r["n"]
    data = items.select("id", "vec").join(profiles.select("id", "labels"), "id")
    schema = T.StructType([items.schema["id"], T.StructField("sums", T.ArrayType(T.DoubleType()))])

    def kernel(_key, lt, rt):
        if not lt.num_rows or not rt.num_rows:
            return _empty(schema)
        labels = matrix(rt["labels"]).astype(np.int64)
        member = np.zeros((len(labels), width))
        for run, own in enumerate(codes):
            rows = np.flatnonzero(labels[:, run] != -1)
            member[rows, starts[run] + np.searchsorted(own, labels[rows, run])] = 1.0
        x, others, step = matrix(lt["vec"]), matrix(rt["vec"]), slice_rows(rt.num_rows)
        sums = [-sim_matrix(x[at : at + step], others, "euclidean") @ member for at in range(0, len(x), step)]
        return pa.table([lt["id"], vectors(np.concatenate(sums))], names=["id", "sums"])

    rows = data.count()
    size = _wide_block(rows, width, items.sparkSession.sparkContext.defaultParallelism)
    sums = block_join(data.select("id", "vec"), data, kernel, schema, block_rows=size, sizes=(rows, rows), slices=False).groupBy("id").agg(
        vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums")
    )
    shipped = items.sparkSession.sparkContext.broadcast(table)

    def score(batches):
        size = shipped.value
        total, seen = np.zeros(runs), np.zeros(runs, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            labels = matrix(batch.column("labels")).astype(np.int64)
            d = matrix(batch.column("sums"))
            for run, own in enumerate(codes):
                if len(own) < 2:
                    continue
                rows = np.flatnonzero(labels[:, run] != -1)
                part, n = d[rows, starts[run] : starts[run + 1]], size[starts[run] : starts[run + 1]]
                at = np.searchsorted(own, labels[rows, run])[:, None]
                own_n = n[at[:, 0]]
                a = np.take_along_axis(part, at, 1)[:, 0] / np.maximum(own_n - 1, 1)
                mean = part / n
                np.put_along_axis(mean, at, np.inf, 1)
                b = mean.min(axis=1)
                total[run] += np.where(own_n > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0).sum()
                seen[run] += len(rows)
        yield pa.record_batch([pa.array(np.arange(runs, dtype=np.int32)), pa.array(total), pa.array(seen)], names=["run_id", "total", "n"])

    scored = sums.join(profiles.select("id", "labels"), "id").select("labels", "sums")
    return scored.mapInArrow(score, "run_id int, total double, n long").groupBy("run_id").agg(
        F.try_divide(F.sum("total"), F.sum("n").cast("double")).alias("silhouette")
    )


def density_clusters(items: DataFrame, min_sim: float, min_points: int) -> DataFrame:
    """(id, label): density clustering with noise -1, over cosine neighbours.

    Core items have at least ``min_points`` items (self included) within ``min_sim``;
    clusters are connected cores, labelled by their smallest id; a border item joins its
    nearest core. A DBSCAN-type algorithm, not a hierarchy of densities. Neighbour lists
    are never written: a block pair returns a count per item, and once a spanning forest of
    the neighbours it holds, so a region of copies costs no more than any other.
    """
    id_type = items.schema["id"].dataType
    counted = T.StructType([T.StructField("id", id_type), T.StructField("n", T.LongType())])

    def count(_key, lt, rt):
        if not lt.num_rows or not rt.num_rows:
            return _empty(counted)
        n = np.concatenate([np.count_nonzero(near, axis=1) for _, near in near_slices(lt, rt, min_sim)])
        return pa.table([lt["id"], pa.array(n)], names=["id", "n"])

    data = items.select("id", "vec")
    n_items = data.count()
    cores = block_join(data, data, count, counted, sizes=(n_items, n_items), slices=False).groupBy("id").agg(F.sum("n").alias("n")).filter(
        F.col("n") >= min_points
    )
    core = materialize(data.join(cores.select("id"), "id"))
    n_cores = core.count()
    linked = T.StructType([T.StructField("a", id_type), T.StructField("b", id_type)])

    def links(_key, lt, rt):
        if not lt.num_rows or not rt.num_rows:
            return _empty(linked)
        names = pa.concat_arrays([lt["id"].combine_chunks(), rt["id"].combine_chunks()])
        trees = []
        for at, near in near_slices(lt, rt, min_sim):
            i, j = np.nonzero(near)
            if len(i):
                trees.append(forest(i + at, j + lt.num_rows))
        tree = np.concatenate(trees) if trees else np.zeros((0, 2), dtype=np.int64)
        return pa.table([names.take(pa.array(tree[:, 0])), names.take(pa.array(tree[:, 1]))], names=["a", "b"])

    # one pass: a pair of blocks returns a spanning forest of its neighbours, at most as many links as rows
    found = block_join(core, core, links, linked, sizes=(n_cores, n_cores), slices=False) if n_cores else data.sparkSession.createDataFrame([], linked)
    named = components(found).withColumnRenamed("node", "id")
    labelled = materialize(core.join(named, "id", "left").select("id", "vec", F.coalesce("component", "id").alias("label")))
    others = data.join(labelled.select("id"), "id", "left_anti")
    border = topk_similar(others, labelled.select("id", "vec"), 1, min_sim=min_sim).select(
        F.col("left_id").alias("id"), F.col("right_id").alias("core")
    )
    border = border.join(labelled.select(F.col("id").alias("core"), "label"), "core").select("id", "label")
    clustered = labelled.select("id", "label").unionByName(border)
    return items.select("id").join(clustered, "id", "left").select("id", F.coalesce("label", F.lit(-1)).alias("label"))


def select_grid(results: DataFrame) -> DataFrame:
    """Best row by validity, then silhouette, then least noise; null scores rank last."""
    worst = F.lit(-1e9)
    order = F.struct(F.coalesce("validity", worst), F.coalesce("silhouette", worst), -F.col("noise_rate"))
    return results.agg(F.max_by(F.struct(*results.columns), order).alias("r")).select("r.*")


def extend_warm_start(old: DataFrame, new: DataFrame, centroids: DataFrame, max_iter: int = 300) -> DataFrame:
    """(id, label): Lloyd from given centroids on old and new items, old labels then restored.

    ``old`` is (id, vec, label); ``centroids`` (label INT, vec).
    """
    rows = sorted(bounded_rows(centroids, MODEL_ROW_LIMIT, "centroids"), key=lambda r: r["label"])
    start = np.array([[r["vec"] for r in rows]], dtype=float)
    every = over_cores(old.select("id", "vec").unionByName(new.select("id", "vec"))).persist()
    centers, _ = lloyd(every, start, max_iter)
    names = F.array(*[F.lit(r["label"]) for r in rows])
    fitted = label_runs(every, centers).select("id", F.element_at(names, F.col("labels")[0] + 1).alias("fitted"))
    return fitted.join(old.select("id", "label"), "id", "left").select("id", F.coalesce("label", "fitted").alias("label"))


def cluster_items(items: DataFrame, strategy: str, **options) -> DataFrame:
    """One entry point: ``kmeans_consensus``, ``kmeans_simple``, ``density`` or ``similarity``."""
    from concord.operators.centroid import assign_with_floor

    if strategy in ("kmeans_consensus", "kmeans_simple"):
        k = options["k"]
        check_k(k, items.limit(k + 1).count())
    if strategy == "kmeans_consensus":
        profiles, _ = consensus_runs(items, k, options.get("runs", 1000), options.get("max_iter", 300))
        profiles = materialize(profiles)
        clusters = consensus_cut(profiles, k, options.get("linkage", "average"))
        return item_stability(profiles, clusters).select("id", F.col("cluster").alias("label"), F.col("stability").alias("score"))
    if strategy == "kmeans_simple":
        return kmeans_multistart(items, k, options.get("starts", 10)).select("id", "label", F.col("confidence").alias("score"))
    if strategy == "density":
        return density_clusters(items, options["min_sim"], options["min_points"]).withColumn("score", F.lit(None).cast("double"))
    if strategy == "similarity":
        return assign_with_floor(items, options["concepts"], options.get("min_sim", 0.0)).withColumnRenamed("sim", "score")
    raise ValueError(f"unknown strategy {strategy}")
