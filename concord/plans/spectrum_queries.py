"""Spectrum, number of factors, loadings and stability."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from concord.operators import spectrum as D
from concord.plans.base import E, items, query, r, r6, table

# loadings of every item on 4 factors: its first vector entries, scaled
_LONG = "l AS (SELECT id, f AS factor, 2 * vec[f] AS loading, 's' || (id % 4) AS \"set\" FROM e, range(1, 5) t(f))"
_LONG_B = "b AS (SELECT id, f AS factor, 2 * vec[f] + vec[f + 4] AS loading FROM e, range(1, 5) t(f))"


def _long(spark, sf_dir, mixed=False):
    e = items(spark, sf_dir)
    value = lambda f: 2 * F.col("vec")[f - 1].cast("double") + (F.col("vec")[f + 3].cast("double") if mixed else F.lit(0.0))
    rows = F.array(*[F.struct(F.lit(f).cast("long").alias("factor"), value(f).alias("loading")) for f in range(1, 5)])
    return e.select("id", F.concat(F.lit("s"), F.col("id") % 4).alias("set"), F.inline(rows))


def _items(spark, sf_dir):
    return items(spark, sf_dir).select("id", "vec")


@query()
def similarity_spectrum(spark, sf_dir):
    return D.eigenvalues(_items(spark, sf_dir)).withColumn("eigenvalue", r6("eigenvalue"))


@query(f"""WITH {E} SELECT count(*) AS n_items, 64 AS n_values, {r('sum(list_inner_product(vec, vec))', 4)} AS trace, {r('(SELECT sum(pow(list_inner_product(a.vec, b.vec), 2)) FROM e a, e b)', 4)} AS squares FROM e""")
def spectrum_moments(spark, sf_dir):
    """Sum of eigenvalues is the trace, sum of squares the squared similarities."""
    e = _items(spark, sf_dir)
    v = F.col("eigenvalue")
    return D.eigenvalues(e).agg(
        F.lit(e.count()).cast("long").alias("n_items"), F.count(v).cast("int").alias("n_values"), r6(F.sum(v), 4).alias("trace"), r6(F.sum(v * v), 4).alias("squares")
    )


_SPEC = "s AS (SELECT row_number() OVER (ORDER BY total DESC) AS rank, total AS eigenvalue FROM (SELECT c_nationkey, sum(c_acctbal * c_acctbal) AS total FROM customer GROUP BY 1))"


def _spectrum_table(spark, sf_dir):
    from pyspark.sql import Window

    totals = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.sum(F.col("c_acctbal") * F.col("c_acctbal")).alias("eigenvalue"))
    return totals.select(F.row_number().over(Window.orderBy(F.desc("eigenvalue"))).alias("rank"), "eigenvalue")  # 25 nations


@query(f"""WITH {_SPEC}, b AS (SELECT rank, eigenvalue / sum(eigenvalue) OVER () AS share, (sum(1.0::DOUBLE / rank) OVER (ORDER BY rank DESC) + (SELECT sum(1.0::DOUBLE / i) FROM range(26, 1001) t(i))) / 1000 AS expected FROM s)
    SELECT greatest(count(*) FILTER (share > expected), 1)::INT AS k FROM b""")
def broken_stick_count(spark, sf_dir):
    """A spectrum of 25 non-zero values out of 1,000."""
    return D.broken_stick(_spectrum_table(spark, sf_dir), 1000)


@query(f"""WITH {_SPEC}, c AS (SELECT min_by(eigenvalue, rank) AS y1, max_by(eigenvalue, rank) AS y2, count(*) AS n FROM s)
    SELECT rank::INT AS k FROM s, c ORDER BY round(abs((y2 - y1) * rank - (n - 1) * eigenvalue + n * y1 - y2) / sqrt(pow(y2 - y1, 2) + pow(n - 1, 2)), 9) DESC, rank LIMIT 1""")
def elbow_count(spark, sf_dir):
    return D.elbow(_spectrum_table(spark, sf_dir), 25)


@query()
def ppca_bic_table(spark, sf_dir):
    return D.ppca_bic(D.covariance_spectrum(_items(spark, sf_dir))).withColumn("bic", r6("bic", 4))


@query()
def parallel_analysis(spark, sf_dir):
    out = D.parallel_analysis(_items(spark, sf_dir), reps=20)
    return out.select("rank", r6("eigenvalue", 4).alias("eigenvalue"), r6("cutoff", 4).alias("cutoff"), "keep")


@query()
def rotated_loadings(spark, sf_dir):
    out = D.primary_factor(D.factor_loadings(_items(spark, sf_dir), 4))
    return out.groupBy("factor").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.aggregate("loadings", F.lit(0.0), lambda a, v: a + v * v)), 4).alias("communality"))


@query(f"""WITH {E}, x AS (SELECT id, list_transform(vec[1:4], lambda v: abs(2 * v)) AS a FROM e) SELECT id, list_position(a, list_max(a))::INT AS factor FROM x""")
def primary_factor(spark, sf_dir):
    l = items(spark, sf_dir).select("id", F.transform(F.slice("vec", 1, 4), lambda v: 2 * v.cast("double")).alias("loadings"))
    return D.primary_factor(l).select("id", "factor")


@query(f"""WITH {E}, {_LONG}, c AS (SELECT "set", factor, count(*) AS n, avg(abs(loading)) AS st, sum(loading) AS t, sum(1 - loading * loading) AS u FROM l GROUP BY ALL),
    b AS (SELECT *, row_number() OVER (PARTITION BY "set" ORDER BY round(st, 9) DESC, factor) AS rk FROM c) SELECT "set", factor, n AS n_items, CASE WHEN n >= 3 THEN {r('t*t / (t*t + u)')} END AS omega FROM b WHERE rk = 1""")
def omega_by_set(spark, sf_dir):
    return D.omega(_long(spark, sf_dir)).withColumn("omega", r6("omega"))


@query(f"""WITH {E}, {_LONG}, {_LONG_B} SELECT l.factor AS factor_a, b.factor AS factor_b, {r('sum(l.loading * b.loading) / sqrt(sum(l.loading * l.loading) * sum(b.loading * b.loading))')} AS phi FROM l JOIN b USING (id) GROUP BY ALL""")
def tucker_congruence(spark, sf_dir):
    return D.congruence(_long(spark, sf_dir), _long(spark, sf_dir, True)).withColumn("phi", r6("phi"))


@query(f"""WITH {E}, {_LONG}, {_LONG_B}, ra AS (SELECT id, factor, rank() OVER (PARTITION BY factor ORDER BY round(abs(loading), 9)) + (count(*) OVER (PARTITION BY factor, round(abs(loading), 9)) - 1) / 2.0::DOUBLE AS rk FROM l),
    rb AS (SELECT id, factor, rank() OVER (PARTITION BY factor ORDER BY round(abs(loading), 9)) + (count(*) OVER (PARTITION BY factor, round(abs(loading), 9)) - 1) / 2.0::DOUBLE AS rk FROM b)
    SELECT ra.factor AS factor_a, rb.factor AS factor_b, {r('corr(ra.rk, rb.rk)')} AS rho FROM ra JOIN rb USING (id) GROUP BY ALL""")
def spearman_congruence(spark, sf_dir):
    return D.spearman_matrix(_long(spark, sf_dir), _long(spark, sf_dir, True)).withColumn("rho", r6("rho"))


_PT = "pt AS (SELECT x.id AS i, y.id AS j, x.label = y.label AS same, list_cosine_similarity(x.vec, y.vec) AS a, list_cosine_similarity(x.vec[1:32], y.vec[1:32]) AS b FROM e x JOIN e y ON x.id < y.id)"


def _two_spaces(spark, sf_dir):
    return items(spark, sf_dir).select("id", "label", F.col("vec").alias("vec_a"), F.slice("vec", 1, 32).alias("vec_b"))


@query(f"""WITH {E}, {_PT}, m AS (SELECT avg(a) AS ma, avg(b) AS mb FROM pt) SELECT {r('sum((a - ma) * (b - mb)) / sqrt(sum((a - ma) * (a - ma)) * sum((b - mb) * (b - mb)))')} AS rv FROM pt, m""")
def rv_coefficient(spark, sf_dir):
    return D.rv_of_spaces(_two_spaces(spark, sf_dir)).withColumn("rv", r6("rv"))


@query(f"""WITH {E}, {_PT} SELECT CASE WHEN same THEN 'within' ELSE 'between' END AS kind, count(*) AS n_pairs, {r('avg(a)')} AS mean_a, {r('avg(b)')} AS mean_b, {r('avg(a - b)')} AS mean_diff, {r('stddev_pop(a - b)')} AS sd_diff
    FROM pt GROUP BY 1""")
def similarity_difference(spark, sf_dir):
    out = D.space_difference(_two_spaces(spark, sf_dir))
    return out.select("kind", "n_pairs", *[r6(c).alias(c) for c in ("mean_a", "mean_b", "mean_diff", "sd_diff")])


# results of three selectors for each customer group, and which numbers are stable, from the orders of a nation
@query("""WITH s AS (SELECT c_nationkey, count(*) % 7 AS k_parallel, count(*) % 11 AS k_cross, 12 AS n FROM customer GROUP BY 1), f AS (SELECT c_nationkey, c_custkey % 12 AS k, avg(c_acctbal) > 4400 AS stable FROM customer GROUP BY ALL),
    c AS (SELECT c_nationkey, greatest(1, least(CASE WHEN k_parallel > 0 THEN round_even((k_parallel + k_cross) / 2.0, 0) ELSE k_cross END, n - 1))::INT AS candidate FROM s)
    SELECT c.c_nationkey, candidate, coalesce(max(k) FILTER (k <= candidate), 1) AS k FROM c LEFT JOIN f ON f.c_nationkey = c.c_nationkey AND stable GROUP BY ALL""")
def final_factor_count(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    s = c.groupBy("c_nationkey").agg((F.count(F.lit(1)) % 7).alias("k_parallel"), (F.count(F.lit(1)) % 11).alias("k_cross")).withColumn("n", F.lit(12))
    f = c.groupBy("c_nationkey", (F.col("c_custkey") % 12).alias("k")).agg((F.avg("c_acctbal") > 4400).alias("stable"))
    return D.final_rank(s, f, ["c_nationkey"])


@query("""WITH v AS (SELECT s_nationkey, s_suppkey % 3 AS place, count(*) % 4 + 1 AS k FROM supplier GROUP BY ALL), t AS (SELECT s_nationkey, k, count(*) AS n, min(place) AS first FROM v GROUP BY ALL)
    SELECT s_nationkey, k FROM t QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY n DESC, first) = 1""")
def majority_factor_count(spark, sf_dir):
    v = table(spark, sf_dir, "supplier").groupBy("s_nationkey", (F.col("s_suppkey") % 3).alias("place")).agg((F.count(F.lit(1)) % 4 + 1).alias("k"))
    return D.majority_rank(v, ["s_nationkey"])


@query()
def bootstrap_stability(spark, sf_dir):
    return D.bootstrap_stability(_items(spark, sf_dir), 3, reps=10).withColumn("median_phi", r6("median_phi", 4))


@query("""WITH e AS (SELECT l_linenumber AS k, l_orderkey % 5 AS fold, avg(l_discount + l_linenumber % 3 / 500.0::DOUBLE) AS mse FROM lineitem GROUP BY ALL), t AS (SELECT k, avg(mse) AS m, stddev_samp(mse) / sqrt(count(*)) AS se FROM e GROUP BY k),
    bar AS (SELECT m + se AS b FROM t ORDER BY m, k LIMIT 1) SELECT k, (round(m, 6) + 0.0) AS mean_mse, (round(se, 6) + 0.0) AS se, k = (SELECT min(k) FROM t, bar WHERE m <= b) AS chosen FROM t""")
def one_standard_error_rule(spark, sf_dir):
    k = F.col("l_linenumber")
    errors = table(spark, sf_dir, "lineitem").groupBy(k.alias("k"), (F.col("l_orderkey") % 5).alias("fold")).agg(
        F.avg(F.col("l_discount") + (k % 3) / 500.0).alias("mse")
    )
    return D.one_se_rule(errors).withColumn("mean_mse", r6("mean_mse")).withColumn("se", r6("se"))


@query()
def cross_validated_rank(spark, sf_dir):
    out = D.cross_validated_rank(_items(spark, sf_dir))
    return out.select("k", r6("mean_mse").alias("mean_mse"), r6("se").alias("se"), "chosen")


# errors of loadings that are known: half the first k entries of the vectors, or a quarter for ids that leave 7 of 20
@query(f"""WITH {E}, p AS (SELECT a.id % 20 AS c, b.id % 20 AS d, a.vec AS x, b.vec AS y, CASE WHEN a.id % 20 = 7 THEN 0.25 ELSE 0.5 END::DOUBLE * CASE WHEN b.id % 20 = 7 THEN 0.25 ELSE 0.5 END::DOUBLE AS w FROM e a JOIN e b ON a.id <> b.id),
    h AS (SELECT f::INT AS fold, k::INT AS k, pow(list_inner_product(x, y) - w * list_inner_product(x[1:k], y[1:k]), 2) AS err FROM p, range(6) a(f), range(1, 21) b(k) WHERE ((c + d) % 20 - 3 * f + 20) % 20 < 3)
    SELECT k, fold, {r('avg(err)', 8)} AS mse FROM h GROUP BY 1, 2""")
def held_out_errors(spark, sf_dir):
    e, of = _items(spark, sf_dir), F.col("id") % 20
    scale = np.where(np.arange(D.HOLD_CLASSES) == 7, 0.25, 0.5)[:, None, None]
    fits = {(k, fold): scale * np.eye(64)[None, :, :k] for k in range(1, 21) for fold in range(6)}
    errors = D.held_out_errors(e, of, D.class_grams(e, of), fits)
    return spark.createDataFrame(errors, "k int, fold int, mse double").select("k", "fold", r6("mse", 8).alias("mse"))


@query()
def principal_components(spark, sf_dir):
    pc = D.principal_components(_items(spark, sf_dir), 3)
    return pc.select("id", *[r6(F.col("vec")[i], 5).alias(f"pc{i + 1}") for i in range(3)])
