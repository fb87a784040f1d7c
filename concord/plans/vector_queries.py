"""Similarity, centroids, assignment and matching on the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.functions import vectors as V
from concord.operators import centroid, matching, similarity
from concord.operators.tables import assemble_labels
from concord.plans.base import E, M, centroid_cte, items, memberships, query, r, r6
from concord.runtime import materialize

COS = "round(list_cosine_similarity({a}, {b}), 9)"
# the pool (labels 5-9) against the domains (labels 0-4)
DOMAINS = centroid_cte("cent", "e", "'d' || label", "label < 5")
LOO = f"""WITH {E}, {DOMAINS},
pool AS (SELECT * FROM e WHERE label >= 5),
tot AS (SELECT list(s ORDER BY pos) AS s, any_value(n) AS n FROM (
    SELECT pos, sum(x) AS s, count(*) AS n FROM (SELECT unnest(vec) AS x, generate_subscripts(vec, 1) AS pos FROM pool) GROUP BY pos)),
uc AS (SELECT p.id, round(list_cosine_similarity(p.vec, list_transform(range(1, len(p.vec) + 1), lambda i: (t.s[i] - p.vec[i]) / (t.n - 1))), 9) AS sim_uc
    FROM pool p, tot t),
sims AS (SELECT p.id, c.label, {COS.format(a='p.vec', b='c.vec')} AS sim FROM pool p, cent c),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, label) AS rk FROM sims),
loo AS (SELECT u.id, CASE WHEN u.sim_uc > b.sim THEN 'UC' ELSE b.label END AS assigned,
    greatest(u.sim_uc, b.sim) AS score, b.label AS best, b.sim AS best_sim, s.label AS second, s.sim AS second_sim,
    u.sim_uc, u.sim_uc - b.sim AS uc_margin
    FROM uc u JOIN ranked b ON b.id = u.id AND b.rk = 1 JOIN ranked s ON s.id = u.id AND s.rk = 2)"""


def _pool(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = items(spark, sf_dir)
    domains = e.filter("label < 5").withColumn("label", F.concat(F.lit("d"), "label"))
    return e.filter("label >= 5").select("id", "vec"), centroid.group_centroids(domains)


def loo_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool, domains = _pool(spark, sf_dir)
    return centroid.leave_one_out(pool, domains)


@query(f"""{LOO} SELECT id, assigned, {r('score')} AS score, best, {r('best_sim')} AS best_sim, second,
    {r('second_sim')} AS second_sim, {r('loo.sim_uc')} AS sim_uc, {r('uc_margin')} AS uc_margin, {r('x.d0')} AS sim_d0, {r('x.d4')} AS sim_d4
    FROM loo JOIN (SELECT id, max(sim) FILTER (label = 'd0') AS d0, max(sim) FILTER (label = 'd4') AS d4 FROM sims GROUP BY id) x USING (id)""")
def leave_one_out_competitor(spark, sf_dir):
    out = loo_table(spark, sf_dir)
    cols = ["score", "best_sim", "second_sim", "sim_uc", "uc_margin", "sim_d0", "sim_d4"]
    return out.select("id", "assigned", "best", "second", *[r6(c).alias(c) for c in cols])


@query(f"""{LOO}, red AS (SELECT CASE WHEN assigned = 'UC' THEN best ELSE assigned END AS domain, assigned = 'UC' AS redirected,
    assigned = 'UC' AND uc_margin > 0.10 AS uc_flagged, uc_margin FROM loo)
    SELECT domain, count(*) AS n, count(*) FILTER (redirected) AS n_redirected, count(*) FILTER (uc_flagged) AS n_flagged,
    {r('avg(uc_margin)')} AS mean_margin FROM red GROUP BY domain""")
def domain_translation(spark, sf_dir):
    """Flagship: centroids, leave-one-out competitor, redirect and flag, counts per domain."""
    red = centroid.redirect_unclassified(loo_table(spark, sf_dir))
    return red.groupBy("domain").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("redirected").alias("n_redirected"),
        F.count_if("uc_flagged").alias("n_flagged"), r6(F.avg("uc_margin")).alias("mean_margin"),
    )


@query(f"""{LOO} SELECT id, {r('best_sim - second_sim')} AS best_margin, best_sim - second_sim < 0.01 AS is_ambiguous,
    uc_margin > 0.10 AS is_uncertain FROM loo""")
def competitor_margins(spark, sf_dir):
    flags = centroid.competitor_flags(loo_table(spark, sf_dir))
    return flags.select("id", r6("best_margin").alias("best_margin"), "is_ambiguous", "is_uncertain")


@query(f"""{LOO}, red AS (SELECT *, CASE WHEN assigned = 'UC' THEN best ELSE assigned END AS final_label FROM loo)
    SELECT 'redirected' AS source, id, final_label, {r('sim_uc')} AS sim_uc, {r('best_sim')} AS best_sim, {r('uc_margin')} AS uc_margin
    FROM red WHERE assigned = 'UC' UNION ALL
    SELECT 'excluded', id, final_label, {r('sim_uc')}, {r('best_sim')}, {r('uc_margin')} FROM red WHERE assigned <> 'UC' AND best = 'd0'""")
def redirected_profile(spark, sf_dir):
    from concord.functions.recode import similarity_profile

    red = centroid.redirect_unclassified(loo_table(spark, sf_dir)).withColumnRenamed("domain", "final_label")
    out = similarity_profile(red, red.filter("not redirected and best = 'd0'"))
    return out.select("source", "id", "final_label", *[r6(c).alias(c) for c in ("sim_uc", "best_sim", "uc_margin")])


@query(f"""{LOO}, red AS (SELECT id, CASE WHEN assigned = 'UC' THEN best ELSE assigned END AS domain, assigned = 'UC' AS redirected,
    assigned = 'UC' AND uc_margin > 0.10 AS flagged FROM loo),
    j AS (SELECT e.id, CASE WHEN e.label < 5 AND e.id % 2 = 0 THEN 'd' || e.label END AS paired, red.domain, red.redirected, coalesce(red.flagged, false) AS flagged,
        e.id % 5 = 0 AS reviewed, CASE WHEN e.id % 10 = 0 THEN 'd' || (e.id % 4) END AS consensus FROM e LEFT JOIN red USING (id)),
    k AS (SELECT *, paired IS NULL AND flagged AND reviewed AS can FROM j)
    SELECT id, CASE WHEN can THEN coalesce(consensus, domain) ELSE coalesce(paired, domain) END AS label,
    coalesce(paired, domain) AS algorithmic_label,
    CASE WHEN paired IS NOT NULL THEN 'cascade_pairing' WHEN can AND consensus IS NULL THEN 'expert_review_no_consensus'
    WHEN can AND consensus = domain THEN 'expert_review_confirmed' WHEN can THEN 'expert_review_override'
    WHEN redirected THEN 'centroid_uc_redirected' WHEN domain IS NOT NULL THEN 'centroid_nearest_domain' END AS source, flagged AS uc_flagged FROM k""")
def final_item_domains(spark, sf_dir):
    e = items(spark, sf_dir)
    paired = e.filter("label < 5 and id % 2 = 0").select("id", F.concat(F.lit("d"), "label").alias("label"))
    nearest = centroid.redirect_unclassified(loo_table(spark, sf_dir))
    overrides = e.filter("id % 5 = 0").select(
        "id", F.when(F.col("id") % 10 == 0, F.concat(F.lit("d"), F.col("id") % 4)).alias("consensus")
    )
    return assemble_labels(e, paired, nearest, overrides)


@query(f"""WITH {E} SELECT id, {r('sqrt(list_sum(list_transform(u, lambda x: x * x)))')} AS norm, {r('u[1]')} AS first, {r('u[64]')} AS last
    FROM (SELECT id, list_transform(vec, lambda x: 3 * x / sqrt(list_sum(list_transform(vec, lambda y: 9 * y * y)))) AS u FROM e)""")
def unit_vectors(spark, sf_dir):
    tripled = F.transform("vec", lambda v: v.cast("double") * 3)
    u = V.l2_normalize(F.col("t"))
    return items(spark, sf_dir).select("id", tripled.alias("t")).select("id", u.alias("u")).select(
        "id", r6(V.l2_norm(F.col("u"))).alias("norm"), r6(F.col("u")[0]).alias("first"), r6(F.col("u")[63]).alias("last")
    )


@query(f"""WITH {E} SELECT a.id, {r('list_inner_product(a.vec, b.vec)')} AS dot, {r('list_cosine_similarity(a.vec, b.vec)')} AS cosine,
    {r('1 - list_cosine_similarity(a.vec, b.vec)')} AS cosine_distance, {r('list_distance(a.vec, b.vec)')} AS euclidean
    FROM e a JOIN e b ON b.id = a.id + 1""")
def vector_distances(spark, sf_dir):
    e = items(spark, sf_dir)
    b = e.select((F.col("id") - 1).alias("id"), F.col("vec").alias("w"))
    return e.join(b, "id").select(
        "id", r6(V.dot("vec", "w")).alias("dot"), r6(V.cosine("vec", "w")).alias("cosine"),
        r6(V.cosine_distance(F.col("vec"), F.col("w"))).alias("cosine_distance"), r6(V.euclidean("vec", "w")).alias("euclidean"),
    )


@query(f"""WITH {E}, s AS (SELECT a.id AS left_id, b.id AS right_id, {COS.format(a='a.vec', b='b.vec')} AS sim FROM e a, e b WHERE a.id % 2 = 0 AND b.id % 2 = 1)
    SELECT left_id, right_id, {r('sim')} AS sim, rk AS rank FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY sim DESC, right_id) AS rk FROM s) WHERE rk <= 3""")
def top_similar_across_sets(spark, sf_dir):
    e = items(spark, sf_dir)
    out = similarity.topk_similar(e.filter("id % 2 = 0").select("id", "vec"), e.filter("id % 2 = 1").select("id", "vec"), 3)
    return out.select("left_id", "right_id", r6("sim").alias("sim"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {E} SELECT a.id AS left_id, b.id AS right_id, {r('list_cosine_similarity(a.vec, b.vec)')} AS sim
    FROM e a JOIN e b ON a.id < b.id WHERE {COS.format(a='a.vec', b='b.vec')} >= 0.4""")
def similar_pairs_within_set(spark, sf_dir):
    e = items(spark, sf_dir).select("id", "vec")
    return similarity.similar_pairs(e, e, 0.4, once=True).select("left_id", "right_id", r6("sim").alias("sim"))


@query(f"""WITH {E}, {centroid_cte('cent', 'e')} SELECT e.id, e.label, {r('list_distance(e.vec, c.vec)')} AS distance,
    {r('1 / (1 + list_distance(e.vec, c.vec))')} AS confidence FROM e JOIN cent c USING (label)""")
def centroid_confidence(spark, sf_dir):
    out = centroid.own_centroid_distance(items(spark, sf_dir))
    return out.select("id", "label", r6("distance").alias("distance"), r6("confidence").alias("confidence"))


@query(f"""WITH {E}, {centroid_cte('cent', 'e')}, x AS (SELECT label, n, unnest(vec) AS v, generate_subscripts(vec, 1) AS pos,
    sqrt(list_sum(list_transform(vec, lambda y: y * y))) AS norm FROM cent)
    SELECT label, n AS n_items, pos, {r('v')} AS mean, {r('v / norm')} AS unit_mean FROM x""")
def group_centroids(spark, sf_dir):
    e = items(spark, sf_dir)
    raw = centroid.group_centroids(e).select("label", "n_items", F.posexplode("vec").alias("pos", "mean"))
    unit = centroid.group_centroids(e, renormalize=True).select("label", F.posexplode("vec").alias("pos", "unit_mean"))
    return raw.join(unit, ["label", "pos"]).select(
        "label", "n_items", (F.col("pos") + 1).cast("long").alias("pos"), r6("mean").alias("mean"), r6("unit_mean").alias("unit_mean")
    )


_FLAVOURS = f"""WITH {E}, {M}, src AS (SELECT e.id, e.vec, m.label FROM e JOIN m USING (id) WHERE e.id % 2 = 0),
    tgt AS (SELECT e.id, e.vec, m.label FROM e JOIN m USING (id) WHERE e.id % 2 = 1 AND m.ord = 0),
    pooled AS (SELECT * FROM src UNION ALL SELECT * FROM tgt),
    {centroid_cte('a', 'src')}, {centroid_cte('b', 'tgt')}, {centroid_cte('c', 'pooled')}"""


@query(f"""{_FLAVOURS} SELECT 'source' AS flavour, label, n AS n_items, {r('vec[1]')} AS first, {r('list_sum(vec)')} AS total FROM a
    UNION ALL SELECT 'target', label, n, {r('vec[1]')}, {r('list_sum(vec)')} FROM b
    UNION ALL SELECT 'pooled', label, n, {r('vec[1]')}, {r('list_sum(vec)')} FROM c""")
def multi_membership_centroids(spark, sf_dir):
    e, m = items(spark, sf_dir).select("id", "vec"), memberships(spark, sf_dir)
    source, target = e.filter("id % 2 = 0"), e.filter("id % 2 = 1")
    parts = {
        "source": centroid.membership_centroids(source, m),
        "target": centroid.membership_centroids(target, m, first_only=True),
        "pooled": centroid.pooled_centroids(source, m, target, m),
    }
    out = None
    for name, c in parts.items():
        row = c.select(
            F.lit(name).alias("flavour"), "label", "n_items", r6(F.col("vec")[0]).alias("first"),
            r6(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v)).alias("total"),
        )
        out = row if out is None else out.unionByName(row)
    return out


@query(f"""WITH {E}, {centroid_cte('cent', 'e', 'label', 'label < 5')},
    s AS (SELECT e.id, c.label, {COS.format(a='e.vec', b='c.vec')} AS sim FROM e, cent c WHERE e.label >= 5),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, label) AS rk FROM s) WHERE rk = 1)
    SELECT id, label, {r('1 - sim')} AS distance, 'extended' AS source FROM b
    UNION ALL SELECT id, label, 0.0, 'reference' FROM e WHERE label < 5""")
def extend_to_new_items(spark, sf_dir):
    e = items(spark, sf_dir)
    known = e.filter("label < 5")
    out = centroid.extend_labels(e.select("id", "vec"), centroid.group_centroids(known), known.select("id", "label"))
    return out.select("id", "label", r6("distance").alias("distance"), "source")


@query(f"""WITH {E}, {centroid_cte('cent', 'e')}, s AS (SELECT e.id, c.label, {COS.format(a='e.vec', b='c.vec')} AS sim FROM e, cent c),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, label) AS rk FROM s) WHERE rk = 1)
    SELECT id, CASE WHEN sim < 0.35 THEN -1 ELSE label END AS label, {r('sim')} AS sim FROM b""")
def concept_assignment_with_floor(spark, sf_dir):
    e = items(spark, sf_dir)
    out = centroid.assign_with_floor(e.select("id", "vec"), centroid.group_centroids(e), 0.35)
    return out.select("id", "label", r6("sim").alias("sim"))


_CONCEPTS = f"""{E}, cl AS (SELECT id, vec, id % 4 AS label FROM e), {centroid_cte('cent', 'cl')},
    {centroid_cte('con', 'e', "'c' || (id % 12)")}"""


@query(f"""WITH {_CONCEPTS}, s AS (SELECT cent.label AS cluster, con.label AS concept, {COS.format(a='cent.vec', b='con.vec')} AS sim FROM cent, con)
    SELECT cluster, concept, {r('sim')} AS sim, row_number() OVER (PARTITION BY cluster ORDER BY sim DESC, concept) AS rank FROM s""")
def cluster_concept_labels(spark, sf_dir):
    e = items(spark, sf_dir)
    clusters = e.select("id", "vec", (F.col("id") % 4).alias("label"))
    centers = centroid.group_centroids(clusters, renormalize=True).select(F.col("label").alias("id"), "vec")
    concepts = centroid.group_centroids(e.select("vec", F.concat(F.lit("c"), F.col("id") % 12).alias("label")))
    return centroid.nearest_centroids(centers, concepts, k=12).select(
        F.col("id").alias("cluster"), F.col("label").alias("concept"), r6("sim").alias("sim"), F.col("rank").cast("long").alias("rank")
    )


@query(f"""WITH {_CONCEPTS}, s AS (SELECT cent.label, e.id, {COS.format(a='cent.vec', b='e.vec')} AS sim, cent.n FROM cent, e),
    k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sim DESC, id) AS rk FROM s) WHERE rk <= 5)
    SELECT label, {r('max(sim)')} AS top_sim, {r('avg(sim)')} AS mean_sim, string_agg(id::VARCHAR, ',' ORDER BY rk) AS items, any_value(n) AS n_items FROM k GROUP BY label""")
def representative_items(spark, sf_dir):
    e = items(spark, sf_dir)
    centers = centroid.group_centroids(e.select("id", "vec", (F.col("id") % 4).alias("label")))
    best = centroid.representatives(e.select("id", "vec"), centers, 5)
    return centroid.cluster_summary(best, centers.select("label", "n_items")).select(
        "label", r6("top_sim").alias("top_sim"), r6("mean_sim").alias("mean_sim"), F.array_join(F.col("items").cast("array<string>"), ",").alias("items"), "n_items"
    )


@query(f"""WITH {E}, p AS (SELECT least(a.label, b.label) AS la, greatest(a.label, b.label) AS lb, list_inner_product(a.vec, b.vec) AS s FROM e a JOIN e b ON a.id < b.id)
    SELECT la AS label_a, lb AS label_b, CASE WHEN la = lb THEN 'within' ELSE 'between' END AS kind, count(*) AS n_pairs,
    {r('avg(s)')} AS mean_sim, {r('stddev_pop(s)')} AS sd_sim FROM p GROUP BY la, lb""")
def within_between_similarity(spark, sf_dir):
    out = centroid.within_between(items(spark, sf_dir))
    return out.select("label_a", "label_b", "kind", "n_pairs", r6("mean_sim").alias("mean_sim"), r6("sd_sim").alias("sd_sim"))


_ROUNDS = """{name}(left_id, right_id, sim, done) AS (
    SELECT left_id, right_id, sim, false FROM {edges}
    UNION ALL
    SELECT left_id, right_id, sim, hit FROM (
        SELECT *, bool_or(hit) OVER (PARTITION BY left_id) AS lu, bool_or(hit) OVER (PARTITION BY right_id) AS ru FROM (
            SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY sim DESC, right_id) = 1
                AND row_number() OVER (PARTITION BY right_id ORDER BY sim DESC, left_id) = 1 AS hit FROM {name} WHERE NOT done))
    WHERE hit OR NOT (lu OR ru))"""


@query(f"""WITH RECURSIVE {E},
    edges AS (SELECT a.id AS left_id, b.id AS right_id, {COS.format(a='a.vec', b='b.vec')} AS sim FROM e a, e b WHERE a.id % 2 = 0 AND b.id % 2 = 1),
    {_ROUNDS.format(name='g', edges='edges')}
    SELECT left_id, right_id, {r('sim')} AS sim FROM g WHERE done""")
def exclusive_match(spark, sf_dir):
    e = items(spark, sf_dir)
    out = matching.match_sets(e.filter("id % 2 = 0").select("id", "vec"), e.filter("id % 2 = 1").select("id", "vec"))
    return out.select("left_id", "right_id", r6("sim").alias("sim"))


def _titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with a short "title" vector (first 4 dims) and the full one."""
    return items(spark, sf_dir).select("id", F.slice("vec", 1, 4).alias("title_vec"), F.col("vec").alias("text_vec"))


_TITLE_EDGES = f"""{E}, title AS (SELECT a.id AS left_id, b.id AS right_id, {COS.format(a='a.vec[1:4]', b='b.vec[1:4]')} AS sim
        FROM e a, e b WHERE a.id % 2 = 0 AND b.id % 2 = 1),
    full_text AS (SELECT a.id AS left_id, b.id AS right_id, {COS.format(a='a.vec', b='b.vec')} AS sim FROM e a, e b WHERE a.id % 2 = 0 AND b.id % 2 = 1)"""


@query(f"""WITH RECURSIVE {_TITLE_EDGES}, t AS (SELECT * FROM title WHERE sim >= 0.97),
    {_ROUNDS.format(name='g', edges='t')},
    locked AS (SELECT left_id, right_id, sim FROM g WHERE done),
    f AS (SELECT * FROM full_text WHERE left_id NOT IN (SELECT left_id FROM locked) AND right_id NOT IN (SELECT right_id FROM locked)),
    {_ROUNDS.format(name='h', edges='f')},
    both_stages AS (SELECT left_id, right_id, sim, 'title_lock' AS stage FROM locked UNION ALL SELECT left_id, right_id, sim, 'full_text' FROM h WHERE done)
    SELECT b.left_id, b.right_id, {r('title.sim')} AS sim_title, {r('full_text.sim')} AS sim_fulltext, {r('b.sim')} AS sim_decision, stage
    FROM both_stages b JOIN title USING (left_id, right_id) JOIN full_text USING (left_id, right_id)""")
def cascade_match(spark, sf_dir):
    t = _titled(spark, sf_dir)
    out = matching.cascade_match(t.filter("id % 2 = 0"), t.filter("id % 2 = 1"), [0.97])
    return out.select("left_id", "right_id", *[r6(c).alias(c) for c in ("sim_title", "sim_fulltext", "sim_decision")], "stage")


_TAU_ROUNDS = _ROUNDS.replace("(left_id, right_id, sim, done)", "(tau, left_id, right_id, sim, done)").replace("SELECT left_id", "SELECT tau, left_id").replace(
    "PARTITION BY left_id", "PARTITION BY tau, left_id").replace("PARTITION BY right_id", "PARTITION BY tau, right_id")


@query(f"""WITH RECURSIVE {_TITLE_EDGES}, taus AS (SELECT unnest([0.93, 0.95, 0.97, 0.99])::DOUBLE AS tau), t AS (SELECT tau, title.* FROM title, taus WHERE sim >= tau),
    {_TAU_ROUNDS.format(name='g', edges='t')}, locked AS (SELECT tau, left_id, right_id FROM g WHERE done),
    f AS (SELECT tau, full_text.* FROM full_text, taus WHERE NOT EXISTS (SELECT 1 FROM locked l WHERE l.tau = taus.tau AND l.left_id = full_text.left_id) AND NOT EXISTS (SELECT 1 FROM locked l WHERE l.tau = taus.tau AND l.right_id = full_text.right_id)),
    {_TAU_ROUNDS.format(name='h', edges='f')}, p AS (SELECT *, 1 AS title FROM locked UNION ALL SELECT tau, left_id, right_id, 0 FROM h WHERE done)
    SELECT p.tau, count(*) AS n_pairs, count(*) FILTER (title = 1) AS n_title, count(*) FILTER (b.left_id IS NULL) AS n_changed FROM p LEFT JOIN (SELECT left_id, right_id FROM p WHERE tau = 0.97) b ON b.left_id = p.left_id AND b.right_id = p.right_id GROUP BY p.tau""")
def threshold_sensitivity(spark, sf_dir):
    t = _titled(spark, sf_dir)
    taus = [0.93, 0.95, 0.97, 0.99]
    sweep = materialize(matching.cascade_match(t.filter("id % 2 = 0"), t.filter("id % 2 = 1"), taus))
    return matching.threshold_sensitivity(sweep, 0.97)


@query(f"""WITH {E}, s AS (SELECT a.id, b.id AS other, b.label, {COS.format(a='a.vec', b='b.vec')} AS sim, round(list_distance(a.vec, b.vec), 9) AS dist FROM e a, e b WHERE a.label = 9 AND b.label <> 9),
    n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, other) AS rk FROM s)
    SELECT id, label, true AS filled FROM n WHERE rk = 1 UNION ALL SELECT id, label, false FROM e WHERE label <> 9""")
def noise_fill(spark, sf_dir):
    e = items(spark, sf_dir).withColumn("label", F.when(F.col("label") == 9, -1).otherwise(F.col("label"))).withColumn("score", F.lit(1.0))
    return matching.fill_noise(e).select("id", "label", "filled")


@query(f"""WITH {E}, p AS (SELECT id AS left_id, id + 1 AS right_id FROM e WHERE id % 4 = 0)
    SELECT a.id, coalesce(b.label, -1) AS label, coalesce(b.label / 10, 0.0)::DOUBLE AS score FROM e a LEFT JOIN p ON p.left_id = a.id LEFT JOIN e b ON b.id = p.right_id WHERE a.id % 2 = 0""")
def label_transfer(spark, sf_dir):
    e = items(spark, sf_dir)
    pairs = e.filter("id % 4 = 0").select(F.col("id").alias("left_id"), (F.col("id") + 1).alias("right_id"))
    labels = e.select("id", "label", (F.col("label") / 10).alias("score"))
    return matching.transfer_labels(e.filter("id % 2 = 0"), pairs, labels)
