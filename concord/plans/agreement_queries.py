"""Concordance of labelings and raters."""

from __future__ import annotations

from pyspark.sql import functions as F

from concord.operators import concordance as L
from concord.plans.base import D, M, detected, items, memberships, query, r, r6, table

FACTORS = ["f0", "f1", "f2", "f3", "f4"]
_LABELS = "(SELECT doc_id AS id, quality AS a, 1 - toxic AS b FROM labels)"
# two labelings of the customers and their orders
_PART = "(SELECT o_orderpriority AS a, CASE WHEN o_orderkey % 3 = 0 THEN '1-URGENT' ELSE o_orderpriority END AS b FROM orders)"


def _index_sql(pairs: str, keys: str = "") -> str:
    """ARI and NMI in SQL over a table (keys, a, b)."""
    k = f"{keys}, " if keys else ""
    using = f"USING ({keys})" if keys else "ON true"
    by = f"GROUP BY {keys}" if keys else ""
    return f"""c AS (SELECT {k}a, b, count(*)::DOUBLE AS n FROM {pairs} WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL),
    ma AS (SELECT {k}a, sum(n) AS n FROM c GROUP BY ALL), mb AS (SELECT {k}b, sum(n) AS n FROM c GROUP BY ALL), t AS (SELECT {k}sum(n) AS tot FROM c {by}),
    sc AS (SELECT {k}sum(n*(n-1)/2) AS cc FROM c {by}), sa AS (SELECT {k}sum(n*(n-1)/2) AS ca, -sum(n/tot*ln(n/tot)) AS ha, count(*) AS n_a FROM ma JOIN t {using} {by}),
    sb AS (SELECT {k}sum(n*(n-1)/2) AS cb, -sum(n/tot*ln(n/tot)) AS hb, count(*) AS n_b FROM mb JOIN t {using} {by}),
    mi AS (SELECT {k}sum(c.n/tot*ln(c.n*tot/(ma.n*mb.n))) AS mi FROM c JOIN ma USING ({k}a) JOIN mb USING ({k}b) JOIN t {using} {by}),
    idx AS (SELECT {k}tot::BIGINT AS n_items, CASE WHEN abs((ca+cb)/2 - ca*cb/(tot*(tot-1)/2)) < 1e-12 THEN 1.0::DOUBLE ELSE (cc - ca*cb/(tot*(tot-1)/2)) / ((ca+cb)/2 - ca*cb/(tot*(tot-1)/2)) END AS ari,
    CASE WHEN n_a = 1 AND n_b = 1 THEN 1.0::DOUBLE ELSE greatest(mi, 0) / ((ha+hb)/2) END AS nmi, n_a, n_b FROM t JOIN sc {using} JOIN sa {using} JOIN sb {using} JOIN mi {using})"""


@query(f"WITH {_index_sql(_PART)} SELECT n_items, {r('ari')} AS ari, {r('nmi')} AS nmi, n_a, n_b FROM idx")
def partition_agreement(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("a"), F.when(F.col("o_orderkey") % 3 == 0, "1-URGENT").otherwise(F.col("o_orderpriority")).alias("b")
    )
    return L.partition_agreement(L.cells(o, "a", "b")).withColumn("ari", r6("ari")).withColumn("nmi", r6("nmi"))


_VARIANTS = """(SELECT 'label/id' AS pair, label AS a, vec_id % 5 AS b FROM embeddings UNION ALL SELECT 'label/half', label, label // 2 FROM embeddings
    UNION ALL SELECT 'label/mixed', label, CASE WHEN vec_id % 3 = 0 THEN vec_id % 10 ELSE label END FROM embeddings UNION ALL SELECT 'one/one', 1, 1 FROM embeddings)"""


@query(f"WITH {_index_sql(_VARIANTS, 'pair')} SELECT pair, n_items, {r('ari')} AS ari, {r('nmi')} AS nmi, n_a, n_b FROM idx")
def all_partition_pairs(spark, sf_dir):
    e = items(spark, sf_dir)
    label, i = F.col("label").cast("int"), F.col("id")
    s = lambda name, a, b: F.struct(F.lit(name).alias("pair"), a.cast("int").alias("a"), b.cast("int").alias("b"))
    pairs = e.select(F.inline(F.array(
        s("label/id", label, i % 5), s("label/half", label, F.floor(label / 2)),
        s("label/mixed", label, F.when(i % 3 == 0, i % 10).otherwise(label)), s("one/one", F.lit(1), F.lit(1)),
    )))
    out = L.partition_agreement(L.cells(pairs, "a", "b", ["pair"]), ["pair"])
    return out.withColumn("ari", r6("ari")).withColumn("nmi", r6("nmi"))


@query(f"WITH {M}, {D} SELECT d.id, d.label AS detected, coalesce(m.label, 'none') AS reference FROM d LEFT JOIN m USING (id)")
def expanded_labels(spark, sf_dir):
    return L.expand_labels(detected(spark, sf_dir), memberships(spark, sf_dir), "none")


@query(f"""WITH {M}, {D}, x AS (SELECT d.label AS b, m.label AS a FROM d LEFT JOIN m USING (id)), {_index_sql('x')}
    SELECT n_items AS n_items_compared, (SELECT count(*) FROM x WHERE a IS NULL) AS n_items_excluded, {r('ari')} AS ari, {r('nmi')} AS nmi, n_b AS n_detected_clusters, n_a AS n_reference_clusters FROM idx""")
def alignment_record(spark, sf_dir):
    out = L.alignment(L.expand_labels(detected(spark, sf_dir), memberships(spark, sf_dir), "none"), "none")
    return out.withColumn("ari", r6("ari")).withColumn("nmi", r6("nmi"))


def _kappa_sql(src: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    by = f"GROUP BY {keys}" if keys else ""
    using = f"USING ({keys})" if keys else "ON true"
    return f"""v AS (SELECT * FROM {src} WHERE a IS NOT NULL AND b IS NOT NULL), t AS (SELECT {k}count(*) AS n_pairs, count(*) FILTER (a = b) AS n_agree FROM v {by}),
    pa AS (SELECT {k}a AS l, count(*)::DOUBLE AS n FROM v GROUP BY ALL), pb AS (SELECT {k}b AS l, count(*)::DOUBLE AS n FROM v GROUP BY ALL),
    u AS (SELECT {k}count(DISTINCT l) AS n_labels FROM (SELECT {k}l FROM pa UNION ALL SELECT {k}l FROM pb) {by}),
    ch AS (SELECT {k}sum(pa.n * pb.n) AS cross_sum FROM pa JOIN pb USING ({k}l) {by}),
    kp AS (SELECT {k}n_pairs, n_agree, 100.0::DOUBLE * n_agree / n_pairs AS pct_agree, n_labels,
        CASE WHEN n_pairs >= 2 AND coalesce(cross_sum, 0) / (n_pairs::DOUBLE * n_pairs) < 1 THEN (n_agree::DOUBLE / n_pairs - coalesce(cross_sum, 0) / (n_pairs::DOUBLE * n_pairs)) / (1 - coalesce(cross_sum, 0) / (n_pairs::DOUBLE * n_pairs)) END AS kappa
        FROM t JOIN u {using} LEFT JOIN ch {using})"""


@query(f"WITH {_kappa_sql(_LABELS)} SELECT n_pairs, n_agree, {r('pct_agree')} AS pct_agree, {r('kappa')} AS kappa FROM kp")
def rater_kappa(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").select(F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b"))
    return L.kappa(L.cells(lab, "a", "b")).withColumn("pct_agree", r6("pct_agree")).withColumn("kappa", r6("kappa"))


@query(f"""WITH x AS (SELECT a, b, count(*) AS n FROM {_LABELS} GROUP BY ALL), g AS (SELECT unnest([1, 0, 2]) AS a), h AS (SELECT unnest([1, 0, 2]) AS b)
    SELECT g.a, h.b, coalesce(n, 0) AS n FROM g CROSS JOIN h LEFT JOIN x ON x.a = g.a AND x.b = h.b""")
def rater_contingency(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").select(F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b"))
    return L.contingency(L.cells(lab, "a", "b"), [1, 0, 2], [1, 0, 2])


@query(f"""WITH x AS (SELECT a, b, count(*) AS n FROM {_PART} WHERE a <> '5-LOW' GROUP BY ALL), l AS (SELECT a AS l FROM x UNION SELECT b FROM x),
    o AS (SELECT l, row_number() OVER (ORDER BY CASE l WHEN '3-MEDIUM' THEN 0 WHEN '1-URGENT' THEN 1 ELSE 2 END, l) AS p FROM l)
    SELECT g.l AS a, h.l AS b, coalesce(n, 0) AS n, g.p AS "row", h.p AS col FROM o g CROSS JOIN o h LEFT JOIN x ON x.a = g.l AND x.b = h.l""")
def rater_confusion(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter("o_orderpriority <> '5-LOW'").select(
        F.col("o_orderpriority").alias("a"), F.when(F.col("o_orderkey") % 3 == 0, "1-URGENT").otherwise(F.col("o_orderpriority")).alias("b")
    )
    out = L.confusion(L.cells(o, "a", "b"), ["3-MEDIUM", "1-URGENT"])
    return out.withColumn("row", F.col("row").cast("long")).withColumn("col", F.col("col").cast("long"))


@query("""SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n, (CASE WHEN l_returnflag IS NULL THEN 2 ELSE 0 END + CASE WHEN l_linestatus IS NULL THEN 1 ELSE 0 END)::BIGINT AS level
    FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def crosstab_with_margins(spark, sf_dir):
    return L.margins(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


@query("""SELECT l_returnflag, count(*) FILTER (l_linestatus = 'O') AS "O", count(*) FILTER (l_linestatus = 'F') AS "F", count(*) FILTER (l_linestatus = 'X') AS "X" FROM lineitem GROUP BY 1""")
def wide_crosstab(spark, sf_dir):
    return L.wide_contingency(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", ["O", "F", "X"])


_SWAP = "(SELECT 'd' || label AS a, 'd' || (CASE WHEN label = 1 AND vec_id % 5 <> 0 THEN 2 WHEN label = 2 AND vec_id % 5 <> 0 THEN 1 ELSE label END) AS b FROM embeddings)"


@query(f"""WITH x AS (SELECT a, b, count(*) AS n FROM {_SWAP} GROUP BY ALL) SELECT a, b, n, (sum(n) OVER (PARTITION BY a))::BIGINT AS row_total, {r('n / sum(n) OVER (PARTITION BY a)')} AS share
    FROM x QUALIFY a <> b AND n / sum(n) OVER (PARTITION BY a) >= 0.70""")
def structural_swaps(spark, sf_dir):
    e = items(spark, sf_dir)
    l = F.col("label")
    swap = F.when((l == 1) & (F.col("id") % 5 != 0), 2).when((l == 2) & (F.col("id") % 5 != 0), 1).otherwise(l)
    c = L.cells(e.select(F.concat(F.lit("d"), l).alias("a"), F.concat(F.lit("d"), swap).alias("b")), "a", "b")
    return L.structural_swaps(c).withColumn("share", r6("share"))


_MAP = "(SELECT label % 4 AS a, (CASE WHEN vec_id % 6 = 0 THEN vec_id % 4 WHEN vec_id % 31 = 0 THEN -1 ELSE (label % 4 + 1) % 4 END)::INT AS b, (vec_id % 100) / 100.0::DOUBLE AS sim FROM embeddings)"


def _mapped(spark, sf_dir):
    e = items(spark, sf_dir)
    l, i = F.col("label"), F.col("id")
    b = F.when(i % 6 == 0, i % 4).when(i % 31 == 0, -1).otherwise((l % 4 + 1) % 4).cast("int")
    return e.select((l % 4).cast("int").alias("a"), b.alias("b"), ((i % 100) / 100.0).alias("sim"))


_BEST = f"""x AS (SELECT a, b, count(*) AS n FROM {_MAP} WHERE a >= 0 AND b >= 0 GROUP BY ALL), p AS (SELECT w.b AS w, y.b AS y, z.b AS z, v.b AS v, w.n + y.n + z.n + v.n AS total
    FROM x w, x y, x z, x v WHERE w.a = 0 AND y.a = 1 AND z.a = 2 AND v.a = 3 AND w.b <> y.b AND w.b <> z.b AND w.b <> v.b AND y.b <> z.b AND y.b <> v.b AND z.b <> v.b ORDER BY total DESC LIMIT 1),
    mp AS (SELECT 0 AS a, w AS mapped_to FROM p UNION ALL SELECT 1, y FROM p UNION ALL SELECT 2, z FROM p UNION ALL SELECT 3, v FROM p)"""


@query(f"""WITH {_BEST} SELECT mp.a, mapped_to, x.n AS n_matched, t.n AS n_items, {r('x.n / t.n')} AS agreement_rate FROM mp JOIN x ON x.a = mp.a AND x.b = mapped_to JOIN (SELECT a, sum(n)::BIGINT AS n FROM x GROUP BY a) t ON t.a = mp.a""")
def optimal_relabelling(spark, sf_dir):
    out = L.optimal_mapping(L.cells(_mapped(spark, sf_dir), "a", "b"))
    return out.withColumn("agreement_rate", r6("agreement_rate"))


@query(f"""WITH {_BEST}, vp AS (SELECT m.*, mapped_to FROM {_MAP} m JOIN mp USING (a) WHERE b >= 0), {_index_sql('(SELECT a, b FROM vp)')}
    SELECT count(*) AS n_valid_pairs, {r('avg((mapped_to = b)::INT)')} AS agreement_rate, {r('avg(sim)')} AS sim_mean, {r('stddev_samp(sim)')} AS sim_sd, min(sim) AS sim_min, max(sim) AS sim_max,
    {r('(SELECT ari FROM idx)')} AS ari, {r('(SELECT nmi FROM idx)')} AS nmi, {r('quantile_cont(sim, 0.5)')} AS sim_median FROM vp""")
def mapping_metrics(spark, sf_dir):
    pairs = _mapped(spark, sf_dir)
    out = L.mapping_metrics(pairs, L.optimal_mapping(L.cells(pairs, "a", "b")))
    keep = ["n_valid_pairs", "sim_min", "sim_max"]
    return out.select(*keep, *[r6(c).alias(c) for c in out.columns if c not in keep])


@query(f"""WITH {M}, {D}, l AS (SELECT id, string_agg(label, ',' ORDER BY ord) AS reference, list(label) AS ls FROM m GROUP BY id)
    SELECT id, d.label AS detected, coalesce(reference, 'unassigned') AS reference, coalesce(list_contains(ls, d.label), false) AS agrees FROM d LEFT JOIN l USING (id)""")
def item_comparison(spark, sf_dir):
    return L.item_comparison(detected(spark, sf_dir), memberships(spark, sf_dir))


# a second, single-label reference for four fifths of the items
_EMP = "p AS (SELECT vec_id AS id, 'f' || ((label + vec_id % 2) % 5) AS label, 0 AS ord FROM embeddings WHERE vec_id % 5 <> 0)"


def _empirical(spark, sf_dir):
    e = items(spark, sf_dir).filter("id % 5 <> 0")
    return e.select("id", F.concat(F.lit("f"), ((F.col("label") + F.col("id") % 2) % 5).cast("int")).alias("label"), F.lit(0).alias("ord"))


@query(f"""WITH {M}, {D}, {_EMP}, l AS (SELECT id, string_agg(label, ',' ORDER BY ord) AS t, list(label) AS ls FROM m GROUP BY id)
    SELECT id, d.label, l.t AS theory, p.label AS empirical, coalesce(list_contains(ls, d.label), false) AS agrees_theory, coalesce(p.label = d.label, false) AS agrees_empirical,
    coalesce(list_contains(ls, p.label), false) AS references_overlap, CASE d.label WHEN 'f3' THEN 1 WHEN 'f1' THEN 2 ELSE 99 END::BIGINT AS position FROM d LEFT JOIN l USING (id) LEFT JOIN p USING (id)""")
def item_master_table(spark, sf_dir):
    out = L.item_master(detected(spark, sf_dir), memberships(spark, sf_dir), _empirical(spark, sf_dir), ["f3", "f1"])
    return out.withColumn("position", F.col("position").cast("long"))


@query(f"""WITH {D}, {_EMP} SELECT d.id, d.label AS detected, p.label AS empirical FROM d LEFT JOIN p USING (id) WHERE d.label IS DISTINCT FROM p.label""")
def mismatch_ledger(spark, sf_dir):
    d = detected(spark, sf_dir).withColumnRenamed("label", "detected")
    p = _empirical(spark, sf_dir).select("id", F.col("label").alias("empirical"))
    return L.mismatch_ledger(d.join(p, "id", "left"), "detected", "empirical", ["id", "detected", "empirical"], ["id"])


@query(f"""WITH {M}, {_EMP}, fa AS (SELECT label, count(DISTINCT id) AS n FROM m GROUP BY 1), fb AS (SELECT label, count(DISTINCT id) AS n FROM p WHERE label <> 'f4' GROUP BY 1),
    s AS (SELECT m.label AS a, p.label AS b, count(*) AS n FROM m JOIN p USING (id) GROUP BY ALL)
    SELECT fa.label AS factor_a, fb.label AS factor_b, coalesce(s.n, 0) AS overlap, round(coalesce(s.n, 0) / (fa.n + fb.n - coalesce(s.n, 0)), 3) AS jaccard FROM fa CROSS JOIN fb LEFT JOIN s ON s.a = fa.label AND s.b = fb.label""")
def model_overlap(spark, sf_dir):
    return L.model_overlap(memberships(spark, sf_dir), _empirical(spark, sf_dir).filter("label <> 'f4'"))


_RATE = """rt AS (SELECT vec_id AS id, CASE WHEN vec_id % 11 <> 0 THEN 'f' || (label % 5) END AS rater1, CASE WHEN vec_id % 3 = 0 THEN 'f1' ELSE 'f' || (label % 5) END AS rater2,
    CASE WHEN vec_id % 17 = 0 THEN 'f2' END AS explicit FROM embeddings)"""


def _ratings(spark, sf_dir):
    own = F.concat(F.lit("f"), F.col("label") % 5)
    return items(spark, sf_dir).select(
        "id", F.when(F.col("id") % 11 != 0, own).alias("rater1"), F.when(F.col("id") % 3 == 0, "f1").otherwise(own).alias("rater2"),
        F.when(F.col("id") % 17 == 0, "f2").alias("explicit"),
    )


@query(f"""WITH {D}, {_RATE} SELECT id, d.label, vec_flag AS uc_flagged, c AS consensus, CASE WHEN vec_flag AND c IS NOT NULL THEN c ELSE d.label END AS final FROM (SELECT *, id % 4 = 1 AS vec_flag FROM d) d
    LEFT JOIN (SELECT id, coalesce(explicit, CASE WHEN rater1 = rater2 THEN rater1 END) AS c FROM rt) USING (id)""")
def rater_consensus(spark, sf_dir):
    d = detected(spark, sf_dir).withColumn("uc_flagged", F.col("id") % 4 == 1)
    return L.override_flagged(d, _ratings(spark, sf_dir))


@query(f"""WITH {M}, {D}, z AS (SELECT id, count(*) AS k FROM m GROUP BY id), x AS (SELECT m.id, m.label, z.k, coalesce(d.label = m.label, false) AS hit FROM m JOIN z USING (id) JOIN d USING (id)),
    o AS (SELECT label AS domain, k, hit FROM x UNION ALL SELECT 'All items', any_value(k), bool_or(hit) FROM x GROUP BY id)
    SELECT domain, count(*) AS items_any_factor, count(*) FILTER (hit) AS recovered_any_factor, count(*) FILTER (k = 1) AS items_single_domain, count(*) FILTER (hit AND k = 1) AS recovered_single_domain,
    round(100.0::DOUBLE * count(*) FILTER (hit) / count(*), 1) AS pct_any_factor, round(100.0::DOUBLE * count(*) FILTER (hit AND k = 1) / count(*) FILTER (k = 1), 1) AS pct_single_domain FROM o GROUP BY domain""")
def domain_recovery(spark, sf_dir):
    return L.domain_accuracy(detected(spark, sf_dir), memberships(spark, sf_dir))


@query(f"""WITH {M}, {D}, x AS (SELECT id, list(label) AS ls, min_by(label, ord) AS f FROM m GROUP BY id)
    SELECT count(*) AS n_items, {r('avg(list_contains(ls, d.label)::INT)')} AS any_factor, {r('avg((f = d.label)::INT)')} AS first_listed FROM x JOIN d USING (id)""")
def overall_accuracy(spark, sf_dir):
    out = L.accuracy_rates(detected(spark, sf_dir), memberships(spark, sf_dir))
    return out.select("n_items", r6("any_factor").alias("any_factor"), r6("first_listed").alias("first_listed"))


@query(f"""WITH {M} SELECT id, min_by(label, ord) AS label FROM m GROUP BY id""")
def first_listed_label(spark, sf_dir):
    from concord.operators.ranking import first_listed

    return first_listed(memberships(spark, sf_dir))


_HEAT = f"""{M}, {D}, x AS (SELECT m.label AS a, d.label AS b, count(*) AS n FROM m JOIN d USING (id) GROUP BY ALL), f AS (SELECT unnest(['f0','f1','f2','f3','f4']) AS l),
    h AS (SELECT g.l AS a, k.l AS b, coalesce(n, 0) AS n FROM f g CROSS JOIN f k LEFT JOIN x ON x.a = g.l AND x.b = k.l)"""


def _heat(spark, sf_dir):
    both = memberships(spark, sf_dir).select("id", F.col("label").alias("a")).join(detected(spark, sf_dir).select("id", F.col("label").alias("b")), "id")
    return L.heatmap_metrics(L.contingency(L.cells(both, "a", "b"), FACTORS, FACTORS), FACTORS, FACTORS)


@query(f"""WITH {_HEAT}, s AS (SELECT avg(n) FILTER (a = b) AS w, avg(n) FILTER (a <> b) AS o FROM h) SELECT {r('w')} AS within_mean, {r('o')} AS between_mean, {r('w / o')} AS separation_ratio FROM s""")
def heatmap_summary(spark, sf_dir):
    s = _heat(spark, sf_dir)[0]
    return s.select(*[r6(c).alias(c) for c in s.columns])


@query(f"""WITH {_HEAT}, s AS (SELECT a, max(n) FILTER (a = b) AS diag, max(n) FILTER (a <> b) AS max_off FROM h GROUP BY a) SELECT a, diag, max_off, CASE WHEN greatest(diag, max_off) > 0 THEN {r('(diag - max_off) / greatest(diag, max_off)', 4)} ELSE 0.0::DOUBLE END AS silhouette FROM s""")
def heatmap_rows(spark, sf_dir):
    return _heat(spark, sf_dir)[1]


@query(f"WITH {_HEAT} SELECT a, b, n FROM h WHERE a <> b AND n > 0 ORDER BY n DESC, a, b LIMIT 5")
def heatmap_top_cells(spark, sf_dir):
    return _heat(spark, sf_dir)[2]


@query(f"""WITH {M}, {D}, x AS (SELECT m.label AS a, d.label AS b, count(*) AS n FROM m JOIN d USING (id) GROUP BY ALL), y AS (SELECT *, (sum(n) OVER (PARTITION BY a))::BIGINT AS left_total, (sum(n) OVER (PARTITION BY b))::BIGINT AS right_total FROM x)
    SELECT a, b, n, round(100.0::DOUBLE * n / left_total, 1) AS pct_of_left, left_total, right_total, a = b AS is_match, a <> b AND round(100.0::DOUBLE * n / left_total, 1) >= 20.0 AS reallocated FROM y""")
def flow_table(spark, sf_dir):
    both = memberships(spark, sf_dir).select("id", F.col("label").alias("a")).join(detected(spark, sf_dir).select("id", F.col("label").alias("b")), "id")
    return L.flow_table(L.cells(both, "a", "b"))


_QUANT = [
    ("consensus_apart", "NOT t AND NOT e"), ("consensus_apart_kept", "NOT t AND NOT e AND NOT d"), ("consensus_together", "t AND e"),
    ("consensus_together_kept", "t AND e AND d"), ("disputed", "t <> e"), ("resolved_to_theory", "(t AND NOT e AND d) OR (e AND NOT t AND NOT d)"),
    ("resolved_to_empirical", "(t AND NOT e AND NOT d) OR (e AND NOT t AND d)"), ("together_theory", "t"), ("together_empirical", "e"), ("together_detected", "d"),
]
_JAC = [("jaccard_theory_detected", "t", "d"), ("jaccard_empirical_detected", "e", "d"), ("jaccard_theory_empirical", "t", "e")]


def _pair_rows(src: str) -> str:
    rows = [f"SELECT '{n}' AS quantity, count(*) FILTER ({c}) AS n, NULL::DOUBLE AS share FROM {src}" for n, c in _QUANT]
    rows += [f"SELECT '{n}', NULL, {r(f'count(*) FILTER ({a} AND {b}) / count(*) FILTER ({a} OR {b})')} FROM {src}" for n, a, b in _JAC]
    return " UNION ALL ".join(rows)


@query(f"""WITH {M}, {D}, {_EMP}, x AS (SELECT d.id, f.label AS theory, p.label AS empirical, d.label AS detected FROM d JOIN p USING (id) JOIN (SELECT * FROM m WHERE ord = 0) f USING (id)),
    pr AS (SELECT i.theory = j.theory AS t, i.empirical = j.empirical AS e, i.detected = j.detected AS d FROM x i JOIN x j ON i.id < j.id) {_pair_rows('pr')}""")
def pair_intermediacy_first_listed(spark, sf_dir):
    first = memberships(spark, sf_dir).filter("ord = 0").select("id", F.col("label").alias("theory"))
    out = L.pair_intermediacy(_three(spark, sf_dir).join(first, "id"))
    return out.withColumn("share", r6("share"))


@query(f"""WITH {M}, {D}, {_EMP}, x AS (SELECT d.id, f.label AS theory, p.label AS empirical, d.label AS detected FROM d JOIN p USING (id) JOIN (SELECT id, any_value(label) AS label FROM m GROUP BY id HAVING count(*) = 1) f USING (id)),
    pr AS (SELECT i.theory = j.theory AS t, i.empirical = j.empirical AS e, i.detected = j.detected AS d FROM x i JOIN x j ON i.id < j.id) {_pair_rows('pr')}""")
def pair_intermediacy_single_domain(spark, sf_dir):
    single = memberships(spark, sf_dir).groupBy("id").agg(F.count(F.lit(1)).alias("k"), F.min("label").alias("theory")).filter("k = 1").drop("k")
    return L.pair_intermediacy(_three(spark, sf_dir).join(single, "id")).withColumn("share", r6("share"))


@query(f"""WITH {M}, {D}, {_EMP}, x AS (SELECT d.id, f.ls AS theory, p.label AS empirical, d.label AS detected FROM d JOIN p USING (id) JOIN (SELECT id, list(label) AS ls FROM m GROUP BY id) f USING (id)),
    pr AS (SELECT list_has_any(i.theory, j.theory) AS t, i.empirical = j.empirical AS e, i.detected = j.detected AS d FROM x i JOIN x j ON i.id < j.id) {_pair_rows('pr')}""")
def pair_intermediacy_any_factor(spark, sf_dir):
    every = memberships(spark, sf_dir).groupBy("id").agg(F.collect_set("label").alias("theory"))
    return L.pair_intermediacy_any(_three(spark, sf_dir).join(every, "id")).withColumn("share", r6("share"))


# customers under the suppliers that they buy from: some forty labels each
@query(f"""WITH x AS (SELECT o_custkey AS id, list(DISTINCT l_suppkey) AS theory, any_value(c_nationkey) AS empirical, any_value(c_mktsegment) AS detected
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1),
    pr AS (SELECT list_has_any(i.theory, j.theory) AS t, i.empirical = j.empirical AS e, i.detected = j.detected AS d FROM x i JOIN x j ON i.id < j.id) {_pair_rows('pr')}""")
def pair_intermediacy_many_labels(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    bought = lines.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_set("l_suppkey").alias("theory"))
    sides = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("empirical"), F.col("c_mktsegment").alias("detected"))
    return L.pair_intermediacy_any(bought.join(sides, "c_custkey")).withColumn("share", r6("share"))


def _three(spark, sf_dir):
    p = _empirical(spark, sf_dir).select("id", F.col("label").alias("empirical"))
    return detected(spark, sf_dir).select("id", F.col("label").alias("detected")).join(p, "id")


_GA = """(SELECT 'raters' AS comparison, g AS grp, rater1 AS a, rater2 AS b FROM x UNION ALL SELECT 'first/final', g, rater1, label FROM x UNION ALL
    SELECT 'raters', 'all', rater1, rater2 FROM x UNION ALL SELECT 'first/final', 'all', rater1, label FROM x)"""


@query(f"""WITH {D}, {_RATE}, x AS (SELECT *, CASE WHEN id % 2 = 0 THEN 'paired' ELSE 'extension' END AS g FROM rt JOIN d USING (id)), {_kappa_sql(_GA, 'comparison, grp')}
    SELECT comparison, grp, n_pairs, n_agree, {r('pct_agree')} AS pct_agree, {r('kappa')} AS kappa FROM kp""")
def grouped_agreement(spark, sf_dir):
    x = _ratings(spark, sf_dir).join(detected(spark, sf_dir), "id").withColumn("g", F.when(F.col("id") % 2 == 0, "paired").otherwise("extension"))
    out = L.grouped_agreement(x, [("raters", "rater1", "rater2"), ("first/final", "rater1", "label")], "g")
    return out.withColumn("pct_agree", r6("pct_agree")).withColumn("kappa", r6("kappa"))


@query(f"""WITH {D}, {_RATE}, x AS (SELECT *, CASE WHEN id % 2 = 0 THEN 'paired' ELSE 'extension' END AS g FROM rt JOIN d USING (id)),
    y AS (SELECT g, rater1 = label AS hit FROM x WHERE rater1 IS NOT NULL UNION ALL SELECT g, rater2 = label FROM x WHERE rater2 IS NOT NULL),
    t AS (SELECT count(*) FILTER (g = 'paired' AND NOT hit) AS a, count(*) FILTER (g = 'paired' AND hit) AS b, count(*) FILTER (g = 'extension' AND NOT hit) AS c, count(*) FILTER (g = 'extension' AND hit) AS d FROM y),
    w AS (SELECT t.*, k, lgamma(a+b+1) + lgamma(c+d+1) + lgamma(a+c+1) + lgamma(b+d+1) - lgamma(a+b+c+d+1) - lgamma(k+1) - lgamma(a+b-k+1) - lgamma(a+c-k+1) - lgamma(d-a+k+1) AS lp FROM t, range(0, 2000) r(k) WHERE k >= a - d AND k <= least(a+b, a+c)),
    o AS (SELECT lp AS lo FROM w WHERE k = a)
    SELECT any_value(a) AS first_disagree, any_value(b) AS first_agree, any_value(c) AS second_disagree, any_value(d) AS second_agree, {r('any_value(a * d / (b * c))')} AS odds_ratio, {r('sum(exp(lp)) FILTER (lp <= lo + 1e-7)')} AS p_value FROM w, o""")
def fisher_agreement_table(spark, sf_dir):
    x = _ratings(spark, sf_dir).join(detected(spark, sf_dir), "id").withColumn("g", F.when(F.col("id") % 2 == 0, "paired").otherwise("extension"))
    out = L.fisher_table(x, ["rater1", "rater2"], "label", "g", ("paired", "extension"))
    return out.withColumn("odds_ratio", r6("odds_ratio")).withColumn("p_value", r6("p_value"))
