"""Spectrum of the similarity matrix, factor counts, loadings and their stability.

The N x N similarity matrix and the D x D Gram matrix share their non-zero
eigenvalues, so every spectrum is one distributed Gram aggregate followed by a
D x D decomposition on the driver. Item tables have columns ``id`` and ``vec``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.functions.vectors import matrix, vectors
from concord.operators.ranking import cumulative_counts

REPLICATE_BYTES = 64 << 20


SPLITS_PER_PARTIAL = 32


def per_core(df: DataFrame) -> DataFrame:
    """Merge scan splits without a shuffle: one partial result per core, or per 32 splits where there are more.

    The tasks grow with the input, so more cores than are registered now can work on it.
    """
    splits = df.rdd.getNumPartitions()
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-splits // SPLITS_PER_PARTIAL), 1))


def grouped_gram(items: DataFrame, key: str) -> DataFrame:
    """(key, g): flattened Gram matrix of the vectors of each key.

    Tasks hold one D x D partial per key and send its rows separately, so the sum is
    spread over key x D reducers.
    """
    schema = T.StructType(
        [items.schema[key], T.StructField("row", T.IntegerType()), T.StructField("part", T.ArrayType(T.DoubleType()))]
    )
    key_type = _arrow_type(items.schema[key].dataType)

    def partial(batches):
        held: dict = {}
        for batch in batches:
            keys = batch.column(key)
            x = matrix(batch.column("vec"))
            codes = keys.dictionary_encode()
            index = codes.indices.to_numpy(zero_copy_only=False)
            for code, name in enumerate(codes.dictionary.to_pylist()):
                rows = x[index == code]
                held[name] = held.get(name, 0.0) + rows.T @ rows
        for name, gram in held.items():
            dims = gram.shape[0]
            yield pa.record_batch(
                [pa.array([name] * dims, type=key_type), pa.array(np.arange(dims, dtype=np.int32)), vectors(gram)],
                names=[key, "row", "part"],
            )

    return (
        per_core(items.select(key, "vec")).mapInArrow(partial, schema)
        .groupBy(key, "row")
        .agg(vector_to_array(Summarizer.sum(array_to_vector("part"))).alias("part"))
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("row", "part"))).alias("rows"))
        .select(key, F.flatten(F.transform("rows", lambda r: r["part"])).alias("g"))
    )


def _arrow_type(data_type: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(data_type)


def gram(items: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, vector sum, D x D Gram): the model-sized summary every spectrum needs."""
    with_one = items.select(F.lit(0).alias("part_key"), F.array_append(F.col("vec").cast("array<double>"), F.lit(1.0)).alias("vec"))
    flat = grouped_gram(with_one, "part_key").first()["g"]
    full = np.array(flat, dtype=float)
    dims = int(round(math.sqrt(full.size)))
    full = full.reshape(dims, dims)
    return int(round(full[-1, -1])), full[:-1, -1], full[:-1, :-1]


def eigenvalues(items: DataFrame) -> DataFrame:
    """(rank, eigenvalue) of the similarity matrix, descending; ranks above D are zero."""
    n, _, g = gram(items)
    values = np.linalg.eigvalsh(g)[::-1][: min(n, g.shape[0])]
    rows = [(i + 1, float(v)) for i, v in enumerate(values)]
    return items.sparkSession.createDataFrame(rows, "rank int, eigenvalue double")


def _harmonic_tail(n: int, d: int) -> float:
    """H(n) - H(d), by the asymptotic series beyond 10^6 terms."""
    def harmonic(m: int) -> float:
        if m < 1_000_000:
            return float(np.sum(1.0 / np.arange(1, m + 1)))
        return math.log(m) + 0.5772156649015329 + 1 / (2 * m) - 1 / (12 * m * m)

    return harmonic(n) - harmonic(d) if n > d else 0.0


def broken_stick(spectrum: DataFrame, n: int) -> DataFrame:
    """Factor count: eigenvalue shares above the broken-stick expectation, at least 1.

    ``spectrum`` stops at rank D; ranks D+1..n are zero and only add their harmonic tail.
    The window runs over the D eigenvalue rows.
    """
    d = spectrum.count()
    tail = _harmonic_tail(n, d)
    below = Window.orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    share = F.col("eigenvalue") / F.sum("eigenvalue").over(Window.partitionBy())
    return (
        spectrum.withColumn("share", share)
        .withColumn("expected", (F.sum(1.0 / F.col("rank")).over(below) + F.lit(tail)) / F.lit(float(n)))
        .agg(F.greatest(F.count_if(F.col("share") > F.col("expected")), F.lit(1)).cast("int").alias("k"))
    )


def elbow(spectrum: DataFrame, n: int) -> DataFrame:
    """Rank farthest from the chord between the first and the last eigenvalue, first on ties."""
    if n <= 2:
        return spectrum.sparkSession.range(1).select(F.lit(max(1, n)).alias("k"))
    ends = spectrum.agg(
        F.min_by("eigenvalue", "rank").alias("y1"), F.max_by("eigenvalue", "rank").alias("ylast"), F.count("*").alias("d")
    ).withColumn("y2", F.when(F.col("d") < n, F.lit(0.0)).otherwise(F.col("ylast")))
    x, y, y1, y2 = F.col("rank"), F.col("eigenvalue"), F.col("y1"), F.col("y2")
    far = F.abs((y2 - y1) * x - (n - 1) * y + n * y1 - y2) / F.sqrt((y2 - y1) ** 2 + (n - 1) ** 2)
    return (
        spectrum.join(F.broadcast(ends))  # one-row aggregate
        .select("rank", F.round(far, 9).alias("far"))
        .agg(F.min_by("rank", F.struct(-F.col("far"), F.col("rank"))).alias("k"))
    )


def covariance_spectrum(items: DataFrame) -> DataFrame:
    """(rank, value, dims, n): the min(n, D) largest eigenvalues of the covariance matrix."""
    n, total, g = gram(items)
    cov = (g - np.outer(total, total) / n) / (n - 1)
    values = np.linalg.eigvalsh(cov)[::-1][: min(n, len(cov))]
    rows = [(i, float(v), len(cov), n) for i, v in enumerate(values, 1)]
    return items.sparkSession.createDataFrame(rows, "rank int, value double, dims int, n long")


def ppca_bic(spectrum: DataFrame, k_min: int = 1, k_max: int | None = None) -> DataFrame:
    """(k, bic) of probabilistic PCA with k axes, from (rank, value, dims, n).

    The k largest variances are kept and the others are replaced by their mean, so the
    likelihood needs two running sums over the ranks: of the values and of their logarithms.
    Without ``k_max`` k runs to 10 at most.
    """
    upto = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # at most D rows
    every = Window.partitionBy()
    k, d, n = F.col("rank"), F.col("dims"), F.col("n")
    last = F.count(F.lit(1)).over(every)
    rest = (F.sum("value").over(every) - F.sum("value").over(upto)) / F.nullif(last - k, F.lit(0))
    table = spectrum.select(
        k.alias("k"), d, n, last.alias("last"), F.greatest(rest, F.lit(1e-8)).alias("noise"),
        F.sum(F.ln(F.greatest("value", F.lit(1e-12)))).over(upto).alias("kept"),
    )
    deviance = n * (d * (1 + math.log(2 * math.pi)) + F.col("kept") + (d - F.col("k")) * F.ln("noise"))
    parameters = d * F.col("k") - F.col("k") * (F.col("k") - 1) / 2 + d + 1
    top = F.lit(k_max) if k_max is not None else F.least(F.col("last") - 1, F.lit(10))
    return table.filter((F.col("k") >= k_min) & (F.col("k") <= top) & (F.col("k") < F.col("last"))).select("k", (deviance + parameters * F.ln(n.cast("double"))).alias("bic"))


def best_bic(table: DataFrame) -> DataFrame:
    return table.agg(F.min_by("k", F.struct("bic", "k")).alias("k"))


# --------------------------------------------------------------------- hashed draws


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser: a stateless, vectorised 64-bit hash."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x += np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed_signs(item_hash: np.ndarray, rep: int, dims: int) -> np.ndarray:
    """+1/-1 per (item, dimension) for one replicate, from the item's own hash."""
    with np.errstate(over="ignore"):
        base = mix64(item_hash.astype(np.int64).view(np.uint64) ^ mix64(np.array([rep], np.uint64)))
        cell = mix64(base[:, None] + np.arange(dims, dtype=np.uint64)[None, :])
    return np.where(cell >> np.uint64(63), 1.0, -1.0)


def hashed_multiplicity(item_hash: np.ndarray, rep: int) -> np.ndarray:
    """Poisson(1) bootstrap count per item: the large-N form of drawing with replacement."""
    with np.errstate(over="ignore"):
        h = mix64(item_hash.astype(np.int64).view(np.uint64) + mix64(np.array([rep + 1_000_003], np.uint64)))
    u = h.astype(np.float64) / 2.0**64
    cuts = np.cumsum([math.exp(-1) / math.factorial(j) for j in range(12)])
    return np.searchsorted(cuts, u).astype(float)


def _replicate_rows(kind: str, x: np.ndarray, h: np.ndarray, rep: int) -> tuple[np.ndarray, np.ndarray]:
    if kind == "sign":
        z = x * hashed_signs(h, rep, x.shape[1])
        return z, z
    drawn = hashed_multiplicity(h, rep)
    if kind == "bootstrap":
        return x * drawn[:, None], x
    once = x[drawn == 1]
    return once, once


def replicate_grams(items: DataFrame, reps: int, kind: str) -> list[np.ndarray]:
    """B replicate Gram matrices: sign-flipped, bootstrap-weighted or once-drawn.

    A pass takes as many replicates as fit REPLICATE_BYTES of D x D partials in a task;
    the summed matrices are model-sized.
    """
    dims = items.select(F.size("vec")).first()[0]
    per_pass = max(1, REPLICATE_BYTES // (8 * dims * dims))
    out: list[np.ndarray] = []
    for first in range(0, reps, per_pass):

        def part(batch, rep, first=first):
            a, b = _replicate_rows(kind, matrix(batch.column("vec")), batch.column("h").to_numpy(), first + rep)
            return a.T @ b

        out += _sum_by_rep(items, part, min(per_pass, reps - first))
    return out


def _sum_by_rep(items: DataFrame, part, reps: int) -> list[np.ndarray]:
    """Sum ``part(batch, rep)`` (a matrix) over all batches, for every replicate, in one job."""

    def partial(batches):
        held: list = [None] * reps
        for batch in batches:
            if not batch.num_rows:
                continue
            for rep in range(reps):
                m = part(batch, rep)
                held[rep] = m if held[rep] is None else held[rep] + m
        for rep, m in enumerate(held):
            if m is not None:
                yield pa.record_batch(
                    [pa.array(np.full(len(m), rep, np.int32)), pa.array(np.arange(len(m), dtype=np.int32)), vectors(m)],
                    names=["rep", "row", "part"],
                )

    rows = (
        per_core(items.select("vec", F.xxhash64("id").alias("h")))
        .mapInArrow(partial, "rep int, row int, part array<double>")
        .groupBy("rep", "row")
        .agg(vector_to_array(Summarizer.sum(array_to_vector("part"))).alias("part"))
        .collect()
    )
    by_rep: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r["rep"], r["row"])):
        by_rep.setdefault(r["rep"], []).append(r["part"])
    return [np.array(by_rep[rep]) for rep in sorted(by_rep)]


def parallel_analysis(items: DataFrame, reps: int = 100, percentile: float = 95.0) -> DataFrame:
    """(rank, eigenvalue, cutoff, keep): sign-flip parallel analysis.

    Random signs per entry destroy the shared structure and keep every entry's size;
    ``keep`` marks observed eigenvalues above the percentile of the null ones. This is
    the published sign-flip null, not a Gaussian simulation.
    """
    spark = items.sparkSession
    observed = eigenvalues(items)
    null_rows = []
    for rep, g in enumerate(replicate_grams(items, reps, "sign")):
        null_rows += [(rep, i + 1, float(v)) for i, v in enumerate(np.linalg.eigvalsh(g)[::-1])]
    null = spark.createDataFrame(null_rows, "rep int, rank int, eigenvalue double")
    cut = null.groupBy("rank").agg(F.percentile("eigenvalue", F.lit(percentile / 100)).alias("cutoff"))
    return observed.join(cut, "rank").withColumn("keep", F.col("eigenvalue") > F.col("cutoff"))


# --------------------------------------------------------------------- loadings


def loading_map(items: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(D x k map, eigenvalues): unrotated loadings of an item are ``x @ map``.

    An eigenvector u of X X^T with value l is X v / sqrt(l) for the Gram eigenvector v,
    so u * sqrt(l) = X v. Signs are fixed by the largest entry of v.
    """
    _, _, g = gram(items)
    values, vecs = np.linalg.eigh(g)
    order = np.argsort(values)[::-1][:k]
    v = vecs[:, order]
    return v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(k)]), values[order]


def project(items: DataFrame, weights: np.ndarray, name: str = "loadings") -> DataFrame:
    """Row-wise ``vec @ weights``; the weights are D x k."""
    shipped = items.sparkSession.sparkContext.broadcast(weights)
    schema = T.StructType([items.schema["id"], T.StructField(name, T.ArrayType(T.DoubleType()))])

    def apply(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch(
                    [batch.column("id"), vectors(matrix(batch.column("vec")) @ shipped.value)], names=["id", name]
                )

    return items.select("id", "vec").mapInArrow(apply, schema)


def varimax_rotations(
    items: DataFrame, maps: list[np.ndarray], resampled: bool = False, q: int = 20, tol: float = 1e-7
) -> list[np.ndarray]:
    """k x k varimax rotations (gamma 1) of the loadings ``vec @ map``, one per map.

    With A the loadings and L = A R, a step needs A^T L^3, A^T L and the column sums of
    L^2: small matrices, aggregated for all maps in one job per iteration; the SVDs run
    on the driver. ``resampled`` weights items by their hashed bootstrap count.
    """
    k, reps = maps[0].shape[1], len(maps)
    context = items.sparkSession.sparkContext
    shipped_maps = context.broadcast(maps)
    rotations, last, active = [np.eye(k)] * reps, [0.0] * reps, set(range(reps))
    for _ in range(q):
        shipped = context.broadcast((rotations, frozenset(active)))

        def moments(batch, rep, shipped=shipped):
            turn, live = shipped.value
            if rep not in live:
                return np.zeros((2 * k + 2, k))
            x = matrix(batch.column("vec"))
            w = hashed_multiplicity(batch.column("h").to_numpy(), rep)[:, None] if resampled else np.ones((len(x), 1))
            a = x @ shipped_maps.value[rep]
            rotated = a @ turn[rep]
            aw = a * w
            count = np.full((1, k), w.sum())
            return np.vstack([aw.T @ rotated**3, aw.T @ rotated, (w * rotated**2).sum(axis=0)[None, :], count])

        for rep, m in enumerate(_sum_by_rep(items, moments, reps)):
            if rep not in active:
                continue
            cubes, plain, squares, n = m[:k], m[k : 2 * k], m[2 * k], m[2 * k + 1, 0]
            u, s, vt = np.linalg.svd(cubes - plain * (squares / n))
            rotations[rep], total = u @ vt, float(s.sum())
            if last[rep] and total - last[rep] < tol:
                active.discard(rep)
            last[rep] = total
        if not active:
            break
    return rotations


def factor_loadings(items: DataFrame, k: int, rotate: bool = True) -> DataFrame:
    """(id, loadings ARRAY<DOUBLE>): principal loadings of the similarity matrix."""
    weights, _ = loading_map(items, k)
    if rotate and k > 1:
        weights = weights @ varimax_rotations(items, [weights])[0]
    return project(items, weights)


def primary_factor(loadings: DataFrame) -> DataFrame:
    """1-based column of the largest absolute loading, first on ties."""
    size = F.transform("loadings", lambda v: F.abs(v))
    return loadings.withColumn("factor", F.array_position(size, F.array_max(size)).cast("int"))


def omega(long_loadings: DataFrame, group: str = "set") -> DataFrame:
    """McDonald's omega per item set from (set, id, factor, loading); null below 3 items."""
    lam = F.col("loading")
    per_column = long_loadings.groupBy(group, "factor").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(lam)).alias("strength"),
        F.sum(lam).alias("total"), F.sum(1 - lam * lam).alias("unique"),
    )
    value = F.col("b.total") ** 2 / (F.col("b.total") ** 2 + F.col("b.unique"))
    return (
        per_column.groupBy(group)
        .agg(F.max_by(F.struct("factor", "n", "total", "unique"),
                      F.struct(F.round("strength", 9), -F.col("factor"))).alias("b"))
        .select(group, F.col("b.factor").alias("factor"), F.col("b.n").alias("n_items"),
                F.when(F.col("b.n") >= 3, value).alias("omega"))
    )


def congruence(a: DataFrame, b: DataFrame) -> DataFrame:
    """Tucker's coefficient of every column pair of two (id, factor, loading) tables."""
    x, y = F.col("a.loading"), F.col("b.loading")
    dot = F.sum(x * y)
    size = F.sqrt(F.sum(x * x) * F.sum(y * y))
    return (
        a.alias("a").join(b.alias("b"), F.col("a.id") == F.col("b.id"))
        .groupBy(F.col("a.factor").alias("factor_a"), F.col("b.factor").alias("factor_b"))
        .agg(F.when(size > 0, dot / size).otherwise(F.lit(0.0)).alias("phi"))
    )


def rv_coefficient(a: DataFrame, b: DataFrame) -> DataFrame:
    """Agreement of two (i, j, value) matrices, both centred by their grand mean."""
    both = a.select("i", "j", F.col("value").alias("x")).join(b.select("i", "j", F.col("value").alias("y")), ["i", "j"])
    x, y = F.col("x"), F.col("y")
    return both.agg(
        (F.covar_pop(x, y) / F.sqrt(F.var_pop(x) * F.var_pop(y))).alias("rv")
    )


def pair_sums(items: DataFrame, key: str) -> DataFrame:
    """(key, n, a, b, aa, bb, ab) of (key, vec_a, vec_b): sums over all unordered pairs of a key's items.

    a and b are the cosines of a pair in either space. Their sums are |sum of unit vectors|^2, those of
    their products the squared entries of one Gram matrix of both spaces, less the items' own terms; so no
    pair is formed.
    """
    from concord.functions.vectors import unit_rows

    dims = items.select(F.size("vec_a").alias("a"), F.size("vec_b").alias("b")).first()
    d_a, d_b = dims["a"], dims["b"]
    fields = T.StructType([items.schema[key], T.StructField("vec", T.ArrayType(T.DoubleType()))])

    def joined(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = unit_rows(matrix(batch.column("vec_a"))), unit_rows(matrix(batch.column("vec_b")))
                own = np.stack([(a * a).sum(axis=1), (b * b).sum(axis=1), np.ones(len(a))], axis=1)
                yield pa.record_batch([batch.column(key), vectors(np.concatenate([a, b, own], axis=1))], names=[key, "vec"])

    def sums(batches):
        for batch in batches:
            rows = []
            for flat in matrix(batch.column("g")):
                g = flat.reshape(d_a + d_b + 3, -1)
                one, s_a, s_b = -1, slice(0, d_a), slice(d_a, d_a + d_b)
                n = g[one, one]
                own_a, own_b = g[-3, one], g[-2, one]  # number of non-zero vectors: their norms are one
                squares = lambda x: float((x * x).sum())
                rows.append((n * (n - 1) / 2, (squares(g[s_a, one]) - own_a) / 2, (squares(g[s_b, one]) - own_b) / 2,
                             (squares(g[s_a, s_a]) - own_a) / 2, (squares(g[s_b, s_b]) - own_b) / 2, (squares(g[s_a, s_b]) - g[-3, -2]) / 2))
            if rows:
                columns = np.array(rows).T
                yield pa.record_batch([batch.column(key), *(pa.array(c) for c in columns)], names=[key, "n", "a", "b", "aa", "bb", "ab"])

    both = items.select(key, "vec_a", "vec_b").mapInArrow(joined, fields)
    out = T.StructType([items.schema[key], *(T.StructField(c, T.DoubleType()) for c in ("n", "a", "b", "aa", "bb", "ab"))])
    return grouped_gram(both, key).mapInArrow(sums, out)


def rv_of_spaces(items: DataFrame) -> DataFrame:
    """(rv) of the similarity matrices of (vec_a, vec_b) items, over all pairs, each centred by its grand mean."""
    s = pair_sums(items.withColumn("all", F.lit(0)), "all")
    n = F.col("n")
    cov = F.col("ab") / n - F.col("a") * F.col("b") / (n * n)
    var = lambda c: F.col(c * 2) / n - F.col(c) * F.col(c) / (n * n)
    return s.filter("n > 0").select(F.try_divide(cov, F.sqrt(var("a") * var("b"))).alias("rv"))


def space_difference(items: DataFrame) -> DataFrame:
    """(kind, n_pairs, mean_a, mean_b, mean_diff, sd_diff) of the pairs within and between the labels of (label, vec_a, vec_b)."""
    names = ("n", "a", "b", "aa", "bb", "ab")
    within = pair_sums(items, "label").agg(*[F.sum(c).alias(c) for c in names])
    every = pair_sums(items.withColumn("all", F.lit(0)), "all").select(*[F.col(c).alias(f"t_{c}") for c in names])
    both = within.join(F.broadcast(every))  # two rows of six numbers
    between = [(F.col(f"t_{c}") - F.col(c)).alias(c) for c in names]
    rows = both.select(F.lit("within").alias("kind"), *names).unionByName(both.select(F.lit("between").alias("kind"), *between)).filter("n > 0")
    n = F.col("n")
    mean = (F.col("a") - F.col("b")) / n
    spread = F.sqrt(F.greatest((F.col("aa") - 2 * F.col("ab") + F.col("bb")) / n - mean * mean, F.lit(0.0)))
    return rows.select("kind", F.round(n).cast("long").alias("n_pairs"), (F.col("a") / n).alias("mean_a"), (F.col("b") / n).alias("mean_b"), mean.alias("mean_diff"), spread.alias("sd_diff"))


def spearman_matrix(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rank correlation of absolute loadings for every column pair.

    Average ranks come from cumulative value counts, which range over partitions, so a
    factor with very many items is not ranked in one task.
    """
    def ranked(t: DataFrame, name: str) -> DataFrame:
        sized = t.select("id", "factor", F.round(F.abs("loading"), 9).alias("size"))
        counts = cumulative_counts(sized, ["factor"], "size")
        place = counts.select("factor", "size", (F.col("before") + (F.col("n") + 1) / 2).alias("rank"))
        return sized.join(place, ["factor", "size"]).select(
            "id", F.col("factor").alias(f"factor_{name}"), F.col("rank").alias(f"rank_{name}")
        )

    return (
        ranked(a, "a").join(ranked(b, "b"), "id").groupBy("factor_a", "factor_b")
        .agg(F.corr("rank_a", "rank_b").alias("rho"))
    )


def bootstrap_stability(items: DataFrame, k: int, reps: int = 20, threshold: float = 0.90) -> DataFrame:
    """(factor, median_phi, stable): congruence of resampled loadings with the full ones.

    Replicates weight items by a hashed Poisson(1) count and compare loadings on the items
    drawn exactly once. Every column inner product those comparisons need is
    map_0^T G_once map_b, with G_once the Gram of the once-drawn items, so all replicates
    are Gram aggregates and no item table reaches the driver.
    """
    base, _ = loading_map(items, k)
    resampled = []
    for g in replicate_grams(items, reps, "bootstrap"):
        values, vecs = np.linalg.eigh(g)
        resampled.append(vecs[:, np.argsort(values)[::-1][:k]])
    once = replicate_grams(items, reps, "once")
    if k > 1:
        base = base @ varimax_rotations(items, [base])[0]
        turns = varimax_rotations(items, resampled, resampled=True)
        resampled = [v @ r for v, r in zip(resampled, turns)]
    phis = []
    for v, g in zip(resampled, once):
        size = np.sqrt(np.outer(np.diag(base.T @ g @ base), np.diag(v.T @ g @ v)))
        phis.append(_align(np.abs(base.T @ g @ v / np.where(size > 0, size, 1.0))))
    median = np.median(np.array(phis), axis=0)
    ok = bool((median >= threshold).all())
    rows = [(i + 1, float(m), ok) for i, m in enumerate(median)]
    return items.sparkSession.createDataFrame(rows, "factor int, median_phi double, stable boolean")


def _align(phi: np.ndarray) -> list[float]:
    """Greedy one-to-one column matching, in base-column order."""
    used: set[int] = set()
    out = []
    for row in phi:
        j = max((c for c in range(len(row)) if c not in used), key=lambda c: (row[c], -c))
        used.add(j)
        out.append(float(row[j]))
    return out


# --------------------------------------------------------------------- choosing k


HOLD_CLASSES = 20
HOLD_SUMS = 3


def held_out(fold: int, classes: int = HOLD_CLASSES, sums: int = HOLD_SUMS) -> np.ndarray:
    """(classes x classes): whether entries of two item classes are held out in a fold.

    An entry (i, j) is held out by the sum of its items' classes: ``sums`` of the ``classes`` remainders, others in
    each fold. With classes of equal size that is the share ``sums / classes`` of all entries, in every row alike.
    """
    remainder = np.add.outer(np.arange(classes), np.arange(classes)) % classes
    return (remainder - sums * fold) % classes < sums


def class_grams(items: DataFrame, item_class: Column, classes: int = HOLD_CLASSES) -> np.ndarray:
    """(classes x D x D) Gram matrices of the vectors by class: all that a fit of any rank and fold needs."""
    rows = grouped_gram(items.select(item_class.cast("int").alias("class"), F.col("vec").cast("array<double>").alias("vec")), "class").collect()
    dims = int(round(math.sqrt(len(rows[0]["g"])))) if rows else 0
    out = np.zeros((classes, dims, dims))
    for r in rows:
        out[r["class"]] = np.array(r["g"]).reshape(dims, dims)
    return out


def masked_maps(grams: np.ndarray, k: int, fold: int, iterations: int = 30, ridge: float = 1e-9) -> np.ndarray:
    """(classes x D x k): rank-k loadings ``x @ map[class]`` of the items, fitted to the entries that a fold leaves.

    An item's least-squares loadings against the others' are ``(sum u u^T)^-1 sum u s``. As s is an inner product of
    vectors, both sums are over classes, less those held out with the item's own: the same small matrices for a whole
    class, applied to the item's vector. Loadings of both sides are the same, so a step goes half way. It starts from
    the leading eigenvectors of the whole matrix.
    """
    classes, dims, _ = grams.shape
    values, vecs = np.linalg.eigh(grams.sum(axis=0))
    maps = np.repeat(vecs[:, np.argsort(values)[::-1][:k]][None], classes, axis=0)
    train = (~held_out(fold, classes)).astype(float)
    for _ in range(iterations):
        cross = grams @ maps
        u = np.einsum("cdk,cdl->ckl", maps, cross)
        left = np.tensordot(train, u, axes=1)
        right = np.tensordot(train, cross, axes=1)
        left = left + ridge * np.trace(left, axis1=1, axis2=2)[:, None, None] * np.eye(k)
        fitted = np.linalg.solve(left, right.transpose(0, 2, 1)).transpose(0, 2, 1)
        step = (fitted - maps) / 2
        maps = maps + step
        if np.abs(step).max() <= 1e-10 * max(np.abs(maps).max(), 1e-300):
            break
    return maps


def held_out_errors(items: DataFrame, item_class: Column, grams: np.ndarray, fits: dict[tuple[int, int], np.ndarray]) -> list[tuple[int, int, float]]:
    """(k, fold, mse) over the held-out entries i <> j of each fit, maps as of :func:`masked_maps`.

    The squared error of two classes' entries follows from their Gram matrices; the entries of items with
    themselves, which those contain, are summed in one pass over the items for all fits together.
    """
    classes = len(grams)
    keys = sorted(fits)
    shipped = items.sparkSession.sparkContext.broadcast([fits[key] for key in keys])

    def own(batches):
        total = np.zeros((classes, len(keys) + 1))
        for batch in batches:
            if not batch.num_rows:
                continue
            x, of = matrix(batch.column("vec")), batch.column("class").to_numpy()
            for c in np.unique(of):
                rows = x[of == c]
                length = (rows * rows).sum(axis=1)
                total[c, -1] += len(rows)
                for f, maps in enumerate(shipped.value):
                    total[c, f] += ((length - ((rows @ maps[c]) ** 2).sum(axis=1)) ** 2).sum()
        yield pa.record_batch([pa.array(np.arange(classes, dtype=np.int32)), vectors(total)], names=["class", "part"])

    data = items.select(item_class.cast("int").alias("class"), F.col("vec").cast("array<double>").alias("vec"))
    sums = per_core(data).mapInArrow(own, "class int, part array<double>").groupBy("class").agg(vector_to_array(Summarizer.sum(array_to_vector("part"))).alias("part"))
    diagonal = np.zeros((classes, len(keys) + 1))
    for r in sums.collect():
        diagonal[r["class"]] = r["part"]
    shipped.destroy()
    sizes = diagonal[:, -1]
    out = []
    for place, (k, fold) in enumerate(keys):
        maps, held = fits[(k, fold)], held_out(fold, classes)
        cross = grams @ maps
        u = np.einsum("cdk,cdl->ckl", maps, cross)
        squares = np.tensordot(grams, grams, axes=([1, 2], [1, 2])) - 2 * np.tensordot(cross, cross, axes=([1, 2], [1, 2])) + np.tensordot(u, u, axes=([1, 2], [1, 2]))
        own_held = np.diag(held)
        entries = sizes @ held @ sizes - sizes[own_held].sum()
        if entries > 0:
            out.append((k, fold, float(max((squares * held).sum() - diagonal[own_held, place].sum(), 0.0) / entries)))
    return out


def cross_validated_rank(items: DataFrame, k_max: int = 20, folds: int = 6, item_class: Column | None = None, iterations: int = 30) -> DataFrame:
    """(k, mean_mse, se, chosen) of rank-k fits of the whole similarity matrix, ranks 1 to ``k_max``, on held-out entries.

    The similarities are inner products of (id, vec). Items are in classes by a hash of the id (or ``item_class``, from 0 to
    ``HOLD_CLASSES`` - 1), and a fold holds out ``HOLD_SUMS / HOLD_CLASSES`` of all entries (:func:`held_out`), so neither fit nor
    error needs a pair: one Gram aggregate by class and one pass for the diagonal serve all ranks and folds. The diagonal is
    in the fit and not in the errors. The chosen k is the smallest within one standard error of the best.
    """
    if item_class is None:
        item_class = F.pmod(F.xxhash64("id"), F.lit(HOLD_CLASSES))
    grams = class_grams(items, item_class)
    ranks = range(1, min(k_max, grams.shape[1]) + 1)
    fits = {(k, fold): masked_maps(grams, k, fold, iterations) for k in ranks for fold in range(folds)}
    errors = held_out_errors(items, item_class, grams, fits)
    return one_se_rule(items.sparkSession.createDataFrame(errors, "k int, fold int, mse double"))


def one_se_rule(errors: DataFrame) -> DataFrame:
    """(k, mean_mse, se, chosen) from (k, fold, mse)."""
    table = errors.groupBy("k").agg(
        F.avg("mse").alias("mean_mse"), (F.stddev_samp("mse") / F.sqrt(F.count("mse"))).alias("se")
    )
    best = table.agg(F.min_by(F.col("mean_mse") + F.col("se"), F.struct("mean_mse", "k")).alias("bar"))
    within = table.join(F.broadcast(best))  # one-row aggregate
    pick = within.filter(F.col("mean_mse") <= F.col("bar")).agg(F.min("k").alias("pick"))
    return table.join(F.broadcast(pick)).select("k", "mean_mse", "se", (F.col("k") == F.col("pick")).alias("chosen"))


def final_rank(selectors: DataFrame, stable: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, candidate, k) from (keys, k_parallel, k_cross, n) and (keys, k, stable) rows.

    The candidate lies half way between the two selectors (halves go to the even number), or is the second
    where the first found none, and stays between 1 and n - 1. k is the largest stable number up to it, else 1.
    """
    middle = F.when(F.col("k_parallel") > 0, F.bround((F.col("k_parallel") + F.col("k_cross")) / F.lit(2.0))).otherwise(F.col("k_cross"))
    candidate = F.greatest(F.lit(1), F.least(middle.cast("int"), (F.col("n") - 1).cast("int")))
    found = selectors.select(*keys, candidate.alias("candidate"))
    usable = stable.filter("stable").select(*keys, F.col("k").alias("stable_k"))
    return found.join(usable, keys, "left").groupBy(*keys, "candidate").agg(
        F.coalesce(F.max(F.when(F.col("stable_k") <= F.col("candidate"), F.col("stable_k"))), F.lit(1)).alias("k")
    )


def majority_rank(votes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, k): the number most methods found, from (keys, place, k); among equals the one whose first method has the lowest place."""
    tally = votes.groupBy(*keys, "k").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    return tally.groupBy(*keys).agg(F.max_by("k", F.struct("n", -F.col("first"))).alias("k"))


def principal_components(items: DataFrame, m: int) -> DataFrame:
    """(id, vec): centred vectors projected on the first m principal axes.

    Axis signs are fixed by the largest entry of each axis.
    """
    from pyspark.ml.feature import PCA

    as_vector = items.select("id", array_to_vector(F.col("vec").cast("array<double>")).alias("features"))
    model = PCA(k=m, inputCol="features", outputCol="pc").fit(as_vector)
    axes = model.pc.toArray()
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(m)])
    mean = np.array(as_vector.agg(vector_to_array(Summarizer.mean(F.col("features")))).first()[0])
    shift = F.array(*[F.lit(float(v)) for v in mean @ axes])
    return project(items, axes, "raw").select(
        "id", F.zip_with("raw", shift, lambda v, c: v - c).alias("vec")
    )
