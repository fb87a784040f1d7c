"""Clustering, consensus runs, stability and density."""

from __future__ import annotations

from pyspark.sql import functions as F

from concord.functions.vectors import l2_normalize
from concord.operators import consensus as C
from concord.operators import spectral as SP
from concord.operators.centroid import averaged_concepts as average_two
from concord.operators.centroid import concept_texts as concept_text_rows
from concord.operators.centroid import group_centroids
from concord.operators.linkage import average_merges, complete_merges
from concord.plans.base import E, centroid_cte, items, query, r, r6, table
from concord.runtime import materialize

RUNS = 12
# labels of 12 runs: the true label for two thirds of the items, a blocked id for the rest
PROFILE = f"""pf AS (SELECT vec_id AS id, t.r AS run_id, (CASE WHEN (vec_id + t.r) % 3 = 0 THEN (vec_id // (t.r + 1)) % 5 ELSE label % 5 END)::INT AS label
    FROM embeddings, range({RUNS}) t(r)), cl AS (SELECT vec_id AS id, label % 5 AS cluster FROM embeddings),
    pp AS (SELECT a.id AS id_a, b.id AS id_b, avg((a.label = b.label)::INT) AS share FROM pf a JOIN pf b ON a.run_id = b.run_id AND a.id < b.id GROUP BY ALL)"""


def profiles(spark, sf_dir):
    i, label = F.col("id"), F.col("label")
    runs = F.sequence(F.lit(0), F.lit(RUNS - 1))
    one = lambda run: F.when((i + run) % 3 == 0, F.floor(i / (run + 1)) % 5).otherwise(label % 5).cast("int")
    return items(spark, sf_dir).select("id", F.transform(runs, one).alias("labels"))


def clusters(spark, sf_dir):
    return items(spark, sf_dir).select("id", (F.col("label") % 5).alias("cluster"))


@query()
def kmeans_fit(spark, sf_dir):
    out = C.kmeans(items(spark, sf_dir).select("id", "vec"), 5, max_iter=300)
    return out.select("id", "label", r6("distance").alias("distance"), r6("confidence").alias("confidence"))


@query()
def kmeans_multistart(spark, sf_dir):
    out = C.kmeans_multistart(items(spark, sf_dir).select("id", "vec"), 5, starts=10, max_iter=300)
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("confidence")).alias("mean_confidence"))


@query()
def choose_cluster_count(spark, sf_dir):
    return C.choose_k(items(spark, sf_dir).select("id", "vec"), 2, 10, max_iter=300)


@query()
def consensus_runs(spark, sf_dir):
    labelled, runs = C.consensus_runs(items(spark, sf_dir).select("id", "vec"), 5, 1000, max_iter=300)
    sizes = C.explode_runs(labelled).groupBy("run_id", "label").agg(F.count(F.lit(1)).alias("n"))
    return sizes.join(runs, "run_id").withColumn("inertia", r6("inertia", 4))


@query()
def consensus_clusters(spark, sf_dir):
    """Runs, co-association cut and stability in one chain."""
    out = C.cluster_items(items(spark, sf_dir).select("id", "vec"), "kmeans_consensus", k=5, runs=20, max_iter=30)
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("score")).alias("mean_stability"))


@query(f"WITH {PROFILE} SELECT id_a, id_b, {r('share')} AS share FROM pp WHERE round(share, 9) >= 0.75")
def coassociation_pairs(spark, sf_dir):
    return C.coassociation(profiles(spark, sf_dir), 0.75).withColumn("share", r6("share"))


@query(f"""WITH {PROFILE}, rk AS (SELECT run_id, label, dense_rank() OVER (PARTITION BY run_id ORDER BY label) - 1 AS position FROM (SELECT DISTINCT run_id, label FROM pf WHERE label <> 1 OR run_id % 2 = 0))
    SELECT id, position::INT AS position, {r(f'count(*) / {RUNS}')} AS share FROM pf JOIN rk USING (run_id, label) GROUP BY ALL""")
def position_frequency(spark, sf_dir):
    long = C.explode_runs(profiles(spark, sf_dir)).filter("label <> 1 or run_id % 2 = 0")
    return C.position_frequency(long).withColumn("share", r6("share"))


@query(f"""WITH {PROFILE}, both_ways AS (SELECT id_a AS i, id_b AS j, share FROM pp UNION ALL SELECT id_b, id_a, share FROM pp)
    SELECT i AS id, a.cluster, {r('avg(share)')} AS stability, count(*) + 1 AS cluster_size FROM both_ways JOIN cl a ON a.id = i JOIN cl b ON b.id = j AND a.cluster = b.cluster GROUP BY ALL""")
def item_stability(spark, sf_dir):
    return C.item_stability(profiles(spark, sf_dir), clusters(spark, sf_dir)).withColumn("stability", r6("stability"))


_ARI = f"""x AS (SELECT run_id, label, cluster, count(*)::DOUBLE AS n FROM pf JOIN cl USING (id) GROUP BY ALL), a AS (SELECT run_id, sum(n*(n-1)/2) AS s FROM (SELECT run_id, label, sum(n) AS n FROM x GROUP BY ALL) GROUP BY 1),
    b AS (SELECT run_id, sum(n*(n-1)/2) AS s FROM (SELECT run_id, cluster, sum(n) AS n FROM x GROUP BY ALL) GROUP BY 1), c AS (SELECT run_id, sum(n*(n-1)/2) AS s, sum(n)*(sum(n)-1)/2 AS t FROM x GROUP BY 1),
    ari AS (SELECT run_id, (c.s - a.s*b.s/t) / ((a.s+b.s)/2 - a.s*b.s/t) AS ari FROM a JOIN b USING (run_id) JOIN c USING (run_id))"""


@query(f"WITH {PROFILE}, {_ARI} SELECT run_id::INT AS run_id, {r('ari')} AS ari FROM ari")
def ari_to_consensus(spark, sf_dir):
    return C.ari_to_consensus(profiles(spark, sf_dir), clusters(spark, sf_dir)).withColumn("ari", r6("ari"))


@query(f"""WITH {PROFILE}, {_ARI}, k AS (SELECT share, a.cluster = b.cluster AS same FROM pp JOIN cl a ON a.id = id_a JOIN cl b ON b.id = id_b),
    w AS (SELECT avg(share) FILTER (same) AS wi, avg(share) FILTER (NOT same) AS be FROM k), both_ways AS (SELECT id_a AS i, id_b AS j, share FROM pp UNION ALL SELECT id_b, id_a, share FROM pp),
    st AS (SELECT i, avg(share) AS s FROM both_ways JOIN cl a ON a.id = i JOIN cl b ON b.id = j AND a.cluster = b.cluster GROUP BY i)
    SELECT {r('avg(ari)')} AS mean_ari, {r('median(ari)')} AS median_ari, {r('stddev_pop(ari)')} AS sd_ari, {r('min(ari)')} AS min_ari, {r('max(ari)')} AS max_ari, count(*) AS n_runs,
    {r('(SELECT wi FROM w)')} AS within, {r('(SELECT be FROM w)')} AS between, {r('(SELECT wi / be FROM w)')} AS separation, {r('(SELECT 100.0::DOUBLE * count(*) FILTER (round(s, 9) > 0.5) / (SELECT count(*) FROM cl) FROM st)')} AS well_represented_pct FROM ari""")
def consensus_validation(spark, sf_dir):
    out = C.consensus_validation(profiles(spark, sf_dir), clusters(spark, sf_dir))
    return out.select("n_runs", *[r6(c).alias(c) for c in out.columns if c != "n_runs"])


_PAIRS = f"""prs AS (SELECT a.run_id AS run_a, b.run_id AS run_b, a.label AS la, b.label AS lb, count(*)::DOUBLE AS n FROM pf a JOIN pf b ON a.id = b.id AND a.run_id < b.run_id GROUP BY ALL),
    pa AS (SELECT run_a, run_b, sum(n*(n-1)/2) AS s FROM (SELECT run_a, run_b, la, sum(n) AS n FROM prs GROUP BY ALL) GROUP BY ALL), pb AS (SELECT run_a, run_b, sum(n*(n-1)/2) AS s FROM (SELECT run_a, run_b, lb, sum(n) AS n FROM prs GROUP BY ALL) GROUP BY ALL),
    pc AS (SELECT run_a, run_b, sum(n*(n-1)/2) AS s, sum(n)*(sum(n)-1)/2 AS t FROM prs GROUP BY ALL),
    pari AS (SELECT run_a, run_b, (pc.s - pa.s*pb.s/t) / ((pa.s+pb.s)/2 - pa.s*pb.s/t) AS ari FROM pa JOIN pb USING (run_a, run_b) JOIN pc USING (run_a, run_b))"""


@query(f"WITH {PROFILE}, {_PAIRS} SELECT run_a::INT AS run_a, run_b::INT AS run_b, {r('ari')} AS ari FROM pari")
def run_pair_ari(spark, sf_dir):
    return C.run_pair_ari(profiles(spark, sf_dir)).withColumn("ari", r6("ari"))


@query(f"""WITH {PROFILE}, {_PAIRS}, i AS (SELECT run_id, avg(id) AS inertia FROM pf GROUP BY 1)
    SELECT 'ari' AS metric, count(*) AS n, {r('avg(ari)')} AS mean, {r('median(ari)')} AS median, {r('stddev_pop(ari)')} AS sd, {r('min(ari)')} AS min, {r('max(ari)')} AS max FROM pari
    UNION ALL SELECT 'inertia', count(*), {r('avg(inertia)')}, {r('median(inertia)')}, {r('stddev_pop(inertia)')}, {r('min(inertia)')}, {r('max(inertia)')} FROM i""")
def run_summary(spark, sf_dir):
    p = profiles(spark, sf_dir)
    inertia = C.explode_runs(p).groupBy("run_id").agg(F.avg("id").alias("inertia"))
    out = C.run_summary(inertia, C.run_pair_ari(p))
    return out.select("metric", "n", *[r6(c).alias(c) for c in ("mean", "median", "sd", "min", "max")])


@query()
def consensus_cut_average(spark, sf_dir):
    return C.consensus_cut(materialize(profiles(spark, sf_dir)), 5)


# suppliers by what the nations' customers spend with them: merges one at a time, on all pairs
_MERGES = """WITH RECURSIVE spent AS (SELECT l_suppkey AS id, c_nationkey AS nation, sum(l_extendedprice) AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
    unit AS (SELECT id, nation, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS x FROM spent), ids AS (SELECT DISTINCT id FROM unit), dots AS (SELECT p.id AS a, q.id AS b, sum(p.x * q.x) AS s FROM unit p JOIN unit q ON p.nation = q.nation AND p.id < q.id GROUP BY 1, 2),
    st(step, a, b, s, na, nb, ma, mb) AS (SELECT 0, p.id, q.id, coalesce(s, 0.0)::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE, -1, -1 FROM ids p JOIN ids q ON p.id < q.id LEFT JOIN dots ON a = p.id AND b = q.id
        UNION ALL (WITH best AS (SELECT a AS x, b AS y, na + nb AS n FROM st ORDER BY round(s, 9) DESC, a, b LIMIT 1)
        SELECT any_value(step) + 1, a, b, {joined}, max(na), max(nb), any_value(x), any_value(y) FROM (
            SELECT step, least(CASE WHEN a = y THEN x ELSE a END, CASE WHEN b = y THEN x ELSE b END) AS a, greatest(CASE WHEN a = y THEN x ELSE a END, CASE WHEN b = y THEN x ELSE b END) AS b, s,
                CASE WHEN a IN (x, y) THEN na WHEN b IN (x, y) THEN nb ELSE 1 END AS w, x, y,
                CASE WHEN a IN (x, y) THEN CASE WHEN least(CASE WHEN a = y THEN x ELSE a END, CASE WHEN b = y THEN x ELSE b END) = x THEN n ELSE nb END
                     WHEN b IN (x, y) THEN CASE WHEN least(CASE WHEN a = y THEN x ELSE a END, CASE WHEN b = y THEN x ELSE b END) = x THEN n ELSE na END ELSE na END AS na,
                CASE WHEN a IN (x, y) THEN CASE WHEN greatest(CASE WHEN a = y THEN x ELSE a END, CASE WHEN b = y THEN x ELSE b END) = x THEN n ELSE nb END
                     WHEN b IN (x, y) THEN CASE WHEN greatest(CASE WHEN a = y THEN x ELSE a END, CASE WHEN b = y THEN x ELSE b END) = x THEN n ELSE na END ELSE nb END AS nb
            FROM st, best WHERE NOT (a = x AND b = y)) GROUP BY a, b)),
    merges AS (SELECT DISTINCT step, ma, mb FROM st WHERE step BETWEEN 1 AND (SELECT count(*) FROM ids) - 8),
    up(id, root) AS (SELECT id, id FROM ids UNION ALL SELECT up.id, merges.ma FROM up JOIN merges ON merges.mb = up.root),
    roots AS (SELECT id, min(root) AS root FROM up GROUP BY id) SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS cluster FROM roots"""


def _spending(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    spent = lines.groupBy(F.col("l_suppkey").alias("id"), "c_nationkey").agg(F.sum("l_extendedprice").alias("x")).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("c_nationkey", "x"))).alias("x"))
    vec = l2_normalize(F.transform(F.sequence(F.lit(0), F.lit(24)), lambda n: F.coalesce(F.col("x")[n], F.lit(0.0)).cast("double")))
    return materialize(spent.select("id", vec.alias("vec"), F.lit(1).cast("long").alias("size")))


@query(_MERGES.format(joined="sum(s * w) / sum(w)"))
def average_linkage_cut(spark, sf_dir):
    """Suppliers in eight clusters of average linkage, by the unit vectors of the nations' spending."""
    units = _spending(spark, sf_dir)
    return C.number_clusters(C.cut_merges(average_merges(units), units.select("id"), 8))


@query(_MERGES.format(joined="min(s)"))
def complete_linkage_cut(spark, sf_dir):
    units = _spending(spark, sf_dir)
    return C.number_clusters(C.cut_merges(complete_merges(units), units.select("id"), 8))


@query()
def consensus_cut_single(spark, sf_dir):
    return C.consensus_cut(materialize(profiles(spark, sf_dir)), 5, "single")


@query(f"""WITH {E}, k AS (SELECT id, vec, CASE WHEN id % 9 = 0 THEN -1 ELSE label // 3 END AS label FROM e), s AS (SELECT a.id, a.label, b.label AS other, avg(list_distance(a.vec, b.vec)) AS d
    FROM k a JOIN k b ON a.id <> b.id WHERE a.label <> -1 AND b.label <> -1 GROUP BY ALL), ab AS (SELECT id, label, max(d) FILTER (other = label) AS a, min(d) FILTER (other <> label) AS b FROM s GROUP BY ALL)
    SELECT id, label, {r('a', 5)} AS a, {r('b', 5)} AS b, {r('(b - a) / greatest(a, b)', 5)} AS silhouette FROM ab""")
def exact_silhouette(spark, sf_dir):
    e = items(spark, sf_dir)
    k = e.select("id", "vec", F.when(F.col("id") % 9 == 0, -1).otherwise(F.floor(F.col("label") / 3).cast("int")).alias("label"))
    return C.silhouette(k).select("id", "label", *[r6(c, 5).alias(c) for c in ("a", "b", "silhouette")])


@query(f"""WITH RECURSIVE {E}, nb AS (SELECT a.id AS i, b.id AS j, round(list_cosine_similarity(a.vec, b.vec), 9) AS s FROM e a, e b), near AS (SELECT * FROM nb WHERE s >= 0.36),
    core AS (SELECT i FROM near GROUP BY i HAVING count(*) >= 2), edge AS (SELECT n.i, n.j FROM near n WHERE n.i IN (SELECT i FROM core) AND n.j IN (SELECT i FROM core)),
    reach(i, j) AS (SELECT i, j FROM edge UNION SELECT reach.i, edge.j FROM reach JOIN edge ON edge.i = reach.j), comp AS (SELECT i, min(j) AS label FROM reach GROUP BY i),
    border AS (SELECT n.i, n.j, row_number() OVER (PARTITION BY n.i ORDER BY s DESC, n.j) AS rk FROM near n WHERE n.i NOT IN (SELECT i FROM core) AND n.j IN (SELECT i FROM core))
    SELECT e.id, coalesce(c.label, bc.label, -1) AS label FROM e LEFT JOIN comp c ON c.i = e.id LEFT JOIN border b ON b.i = e.id AND b.rk = 1 LEFT JOIN comp bc ON bc.i = b.j""")
def density_clusters(spark, sf_dir):
    return C.density_clusters(items(spark, sf_dir).select("id", "vec"), 0.36, 2)


@query(f"""WITH g AS (SELECT l_partkey AS grid, CASE WHEN l_partkey % 3 <> 0 THEN max(l_discount) END AS validity, avg(l_quantity) AS silhouette, avg(l_tax) AS noise_rate FROM lineitem GROUP BY 1)
    SELECT grid, validity, {r('silhouette')} AS silhouette, {r('noise_rate')} AS noise_rate FROM g ORDER BY coalesce(validity, -1e9) DESC, coalesce(silhouette, -1e9) DESC, noise_rate LIMIT 1""")
def best_grid_setting(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("grid")).agg(
        F.max("l_discount").alias("m"), F.avg("l_quantity").alias("silhouette"), F.avg("l_tax").alias("noise_rate")
    ).select("grid", F.when(F.col("grid") % 3 != 0, F.col("m")).alias("validity"), "silhouette", "noise_rate")
    return C.select_grid(g).withColumn("silhouette", r6("silhouette")).withColumn("noise_rate", r6("noise_rate"))


@query()
def spectral_clusters(spark, sf_dir):
    """The neighbour graph of all items, cut into as many clusters as the widest gap of its spectrum says."""
    e = items(spark, sf_dir).select("id", "vec")
    found, pairs, k = SP.spectral_clusters(SP.neighbour_edges(e), e.select("id"))
    return found.withColumn("k", F.lit(k)).withColumn("gap", r6(F.lit(SP.eigengap(pairs.values, 2, 10)[1])))


# nations that trade: what customers of one order from suppliers of the other, in thousands of lines
@query("""WITH t AS (SELECT least(c_nationkey, s_nationkey) AS a, greatest(c_nationkey, s_nationkey) AS b, count(*) / 1000.0::DOUBLE AS w
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2),
    m AS (SELECT a AS i, b AS j, w FROM t UNION ALL SELECT b, a, w FROM t UNION ALL SELECT n_nationkey, n_nationkey, 1.0::DOUBLE FROM nation), d AS (SELECT i, sqrt(sum(w)) AS d FROM m GROUP BY i),
    x AS (SELECT m.i, m.j, w / (p.d * q.d) AS w FROM m JOIN d p ON m.i = p.i JOIN d q ON m.j = q.i), y AS (SELECT a.i, b.j, sum(a.w * b.w) AS w FROM x a JOIN x b ON a.j = b.i GROUP BY 1, 2)
    SELECT (SELECT count(*) FROM nation) AS n_values, (round((SELECT sum(w) FROM x WHERE i = j), 6) + 0.0) AS trace, (round((SELECT sum(w * w) FROM x), 6) + 0.0) AS squares,
    (round((SELECT sum(x.w * y.w) FROM x JOIN y USING (i, j)), 6) + 0.0) AS cubes, (round((SELECT sum(w * w) FROM y), 6) + 0.0) AS fourth, 1.0::DOUBLE AS largest, true AS converged""")
def spectral_moments(spark, sf_dir):
    """Sums of powers of all eigenvalues are traces of powers of the matrix."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    edges = lines.groupBy(F.col("c_nationkey").alias("a"), F.col("s_nationkey").alias("b")).agg((F.count(F.lit(1)) / 1000.0).alias("weight"))
    links, roots = SP.normalised(edges, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id")))
    pairs = SP.leading_eigenpairs(links, roots, 25)
    rows = spark.createDataFrame([(float(v), float(x)) for v, x in zip(pairs.values, pairs.residuals)], "v double, residual double")
    v = F.col("v")
    return rows.agg(
        F.count(v).alias("n_values"), r6(F.sum(v)).alias("trace"), r6(F.sum(v * v)).alias("squares"), r6(F.sum(v * v * v)).alias("cubes"), r6(F.sum(v * v * v * v)).alias("fourth"),
        r6(F.max(v)).alias("largest"), (F.max("residual") < 1e-6).alias("converged"),
    )


@query(f"""WITH RECURSIVE {E}, {centroid_cte('start', 'e', 'label', 'label < 5')},
    lloyd(step, label, vec) AS (SELECT 0, label, vec FROM start UNION ALL
        SELECT any_value(step) + 1, label, list(m ORDER BY pos) FROM (SELECT step, label, pos, avg(x) AS m FROM (
            SELECT step, label, unnest(vec) AS x, generate_subscripts(vec, 1) AS pos FROM (
                SELECT e.id, any_value(e.vec) AS vec, any_value(l.step) AS step, arg_min(l.label, round(list_distance(e.vec, l.vec), 12)) AS label FROM e, lloyd l WHERE l.step < 60 GROUP BY e.id))
            GROUP BY step, label, pos) GROUP BY label),
    last AS (SELECT * FROM lloyd WHERE step = (SELECT max(step) FROM lloyd)), f AS (SELECT e.id, arg_min(l.label, list_distance(e.vec, l.vec)) AS fitted FROM e, last l GROUP BY e.id)
    SELECT e.id, CASE WHEN e.label < 5 THEN e.label ELSE f.fitted END AS label FROM e JOIN f USING (id)""")
def extend_warm_start(spark, sf_dir):
    e = items(spark, sf_dir)
    old, new = e.filter("label < 5"), e.filter("label >= 5").select("id", "vec")
    return C.extend_warm_start(old, new, group_centroids(old).select("label", "vec"))


@query("""SELECT n_regionkey AS concept, string_agg(n_name, ' ' ORDER BY n_nationkey) AS text FROM nation GROUP BY 1""")
def concept_texts(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return concept_text_rows(n.select(F.col("n_regionkey").alias("concept"), F.col("n_nationkey").alias("ord"), F.col("n_name").alias("text")))


@query(f"""WITH {E}, {centroid_cte('a', 'e', 'label', 'id % 2 = 0')}, {centroid_cte('b', 'e', 'label', 'id % 2 = 1')}, m AS (SELECT label, list_transform(range(1, 65), lambda i: (a.vec[i] + b.vec[i]) / 2) AS v FROM a JOIN b USING (label))
    SELECT label, {r('v[1] / sqrt(list_inner_product(v, v))')} AS first, {r('v[64] / sqrt(list_inner_product(v, v))')} AS last FROM m""")
def averaged_concepts(spark, sf_dir):
    e = items(spark, sf_dir)
    out = average_two(group_centroids(e.filter("id % 2 = 0")), group_centroids(e.filter("id % 2 = 1")))
    return out.select("label", r6(F.col("vec")[0]).alias("first"), r6(F.col("vec")[63]).alias("last"))


# the same labels with noise (-1) in every second run, and one cluster only in run 3
NOISY = "CASE WHEN t_run % 2 = 0 AND (id + t_run) % 7 = 0 THEN -1 WHEN t_run = 3 THEN 1 ELSE label END"


@query(f"""WITH {PROFILE}, nf AS (SELECT id, run_id, {NOISY.replace("t_run", "run_id")} AS label FROM pf), e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec FROM embeddings),
    d AS (SELECT a.id, b.id AS other, list_distance(a.vec, b.vec) AS d FROM e a JOIN e b ON a.id <> b.id),
    s AS (SELECT x.run_id, x.id, x.label, y.label AS other, avg(d) AS d FROM d JOIN nf x ON x.id = d.id JOIN nf y ON y.id = d.other AND y.run_id = x.run_id WHERE x.label <> -1 AND y.label <> -1 GROUP BY ALL),
    ab AS (SELECT run_id, id, max(d) FILTER (label = other) AS a, min(d) FILTER (label <> other) AS b FROM s GROUP BY ALL)
    SELECT run_id::INT AS run_id, {r('avg((b - a) / greatest(a, b))', 5)} AS silhouette FROM ab GROUP BY run_id""")
def run_silhouettes(spark, sf_dir):
    p = profiles(spark, sf_dir).select("id", F.posexplode("labels").alias("t_run", "label"))
    noisy = C.profiles_from_long(p.select("id", F.col("t_run").alias("run_id"), F.expr(NOISY).cast("int").alias("label")))
    out = C.run_silhouettes(items(spark, sf_dir).select("id", "vec"), noisy)
    return out.withColumn("silhouette", r6("silhouette", 5))


@query("""SELECT 1.0::DOUBLE AS mean_ari, 1.0::DOUBLE AS within, 0.0::DOUBLE AS between, NULL::DOUBLE AS separation, count(*) AS n_items FROM embeddings""")
def one_cluster_validation(spark, sf_dir):
    """Validation of runs and a consensus with a single cluster."""
    e = items(spark, sf_dir)
    out = C.consensus_validation(e.select("id", F.array(F.lit(0), F.lit(0), F.lit(0)).alias("labels")), e.select("id", F.lit(0).alias("cluster")))
    return out.select("mean_ari", "within", "between", "separation", F.lit(e.count()).alias("n_items"))
