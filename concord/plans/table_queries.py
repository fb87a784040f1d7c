"""Relational base: sources, recodes, joins, ranks, set operations, descriptions."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.functions import recode as P
from concord.operators import describe as A
from concord.operators import ranking as W
from concord.operators import tables as J
from concord.plans.base import query, r, r6, table
from concord.runtime import materialize
from concord.sources import models

# ------------------------------------------------------------------ recodes

_RAW = "CASE WHEN l_quantity IN (1, 2) THEN '-999' WHEN l_quantity = 3 THEN 'n/a' ELSE l_quantity::VARCHAR END"
LINE = "l_orderkey, l_linenumber, l_partkey"


def _raw(spark, sf_dir):
    q = F.col("l_quantity")
    raw = F.when(q.isin(1, 2), "-999").when(q == 3, "n/a").otherwise(q.cast("string"))
    return table(spark, sf_dir, "lineitem").withColumn("raw", raw)


@query(f"""SELECT l_returnflag, count(*) AS n, count(v) AS n_known, {r('sum(v)', 4)} AS total,
    count(*) FILTER (coalesce(v, f) IS NOT NULL) AS n_filled, {r('sum(coalesce(v, f))', 4)} AS total_filled
    FROM (SELECT l_returnflag, CASE WHEN x NOT IN (-999, -998, 999) THEN x END AS v, CASE WHEN l_linenumber > 1 THEN l_tax END AS f
    FROM (SELECT *, TRY_CAST({_RAW} AS DOUBLE) AS x FROM lineitem)) GROUP BY l_returnflag""")
def sentinels_to_null(spark, sf_dir):
    v = P.to_num("raw")
    f = F.when(F.col("l_linenumber") > 1, F.col("l_tax"))
    both = _raw(spark, sf_dir).select("l_returnflag", v.alias("v"), P.first_known(v, f).alias("c"))
    return both.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.count("v").alias("n_known"), r6(F.sum("v"), 4).alias("total"),
        F.count("c").alias("n_filled"), r6(F.sum("c"), 4).alias("total_filled"),
    )


@query("""SELECT yes_no, any_risk, d_building, d_auto, d_machinery, count(*) AS n FROM (SELECT
    CASE c_nationkey % 4 WHEN 1 THEN 1 WHEN 2 THEN 0 END AS yes_no,
    CASE WHEN c_nationkey % 5 = 0 THEN 0 WHEN c_nationkey % 5 IN (1, 2, 3) THEN 1 END AS any_risk,
    CASE WHEN code <> 18 THEN (code IN (1, 2))::INT END AS d_building, CASE WHEN code <> 18 THEN (code = 3)::INT END AS d_auto,
    CASE WHEN code <> 18 THEN (code IN (4, 5))::INT END AS d_machinery
    FROM (SELECT c_nationkey, CASE WHEN c_custkey % 9 = 0 THEN NULL WHEN c_custkey % 10 = 0 THEN 18 ELSE c_custkey % 7 END AS code FROM customer))
    GROUP BY ALL""")
def recoded_and_dummy_columns(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    coded = c.withColumn("code", F.when(key % 9 != 0, F.when(key % 10 == 0, 18).otherwise(key % 7)))
    out = P.dummies(coded, "code", {"d_building": [1, 2], "d_auto": [3], "d_machinery": [4, 5]}, null_codes=[18])
    return out.select(
        P.recode(F.col("c_nationkey") % 4, {1: 1, 2: 0}).alias("yes_no"),
        P.recode(F.col("c_nationkey") % 5, {0: 0, 1: 1, 2: 1, 3: 1}).alias("any_risk"), "d_building", "d_auto", "d_machinery",
    ).groupBy("yes_no", "any_risk", "d_building", "d_auto", "d_machinery").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH s AS (SELECT avg(x) AS mx, stddev_samp(x) AS sx, avg(l_quantity) AS mq, stddev_samp(l_quantity) AS sq FROM
    (SELECT *, CASE WHEN l_orderkey % 500 = 0 THEN l_extendedprice * 50 ELSE l_extendedprice END AS x FROM lineitem))
    SELECT l_linestatus, count(*) AS n, count(*) FILTER (NOT (abs(x - mx) > 4 * sx)) AS n_price, count(*) FILTER (NOT (abs(l_quantity - mq) > 4 * sq)) AS n_quantity,
    {r('sum(x) FILTER (NOT (abs(x - mx) > 4 * sx))', 2)} AS total FROM
    (SELECT *, CASE WHEN l_orderkey % 500 = 0 THEN l_extendedprice * 50 ELSE l_extendedprice END AS x FROM lineitem), s GROUP BY l_linestatus""")
def outliers_to_null(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select(
        "l_linestatus", "l_quantity",
        F.when(F.col("l_orderkey") % 500 == 0, F.col("l_extendedprice") * 50).otherwise(F.col("l_extendedprice")).alias("x"),
    )
    out = P.outliers_to_null(line, ["x", "l_quantity"])
    return out.groupBy("l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.count("x").alias("n_price"), F.count("l_quantity").alias("n_quantity"),
        r6(F.sum("x"), 2).alias("total"),
    )


@query("""SELECT o_orderpriority, count(*) AS n FROM orders WHERE (CASE WHEN o_orderkey % 2 = 0 THEN 1 END) IS NOT NULL OR (CASE WHEN o_orderkey % 3 = 0 THEN 1 END) IS NOT NULL GROUP BY ALL""")
def rows_with_any_answer(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a = o.withColumn("a", F.when(F.col("o_orderkey") % 2 == 0, 1)).withColumn("b", F.when(F.col("o_orderkey") % 3 == 0, 1))
    return P.keep_any(a, ["a", "b"]).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT 'below_10' AS variable, count(*) FILTER (q < 10) AS n, count(q) AS denominator, count(*) - count(q) AS missing, {r('100.0::DOUBLE * count(*) FILTER (q < 10) / count(q)')} AS pct FROM (SELECT CASE WHEN l_linenumber < 6 THEN l_quantity END AS q FROM lineitem)
    UNION ALL SELECT 'below_32', count(*) FILTER (q < 32), count(q), count(*) - count(q), {r('100.0::DOUBLE * count(*) FILTER (q < 32) / count(q)')} FROM (SELECT CASE WHEN l_linenumber < 6 THEN l_quantity END AS q FROM lineitem)""")
def threshold_indicators(spark, sf_dir):
    q = F.when(F.col("l_linenumber") < 6, F.col("l_quantity"))
    flags = table(spark, sf_dir, "lineitem").select((q < 10).alias("below_10"), (q < 32).alias("below_32"))
    return A.n_pct(flags, ["below_10", "below_32"]).withColumn("pct", r6("pct"))


@query("""SELECT p_partkey, printf('COG_%03d', p_partkey) AS item_id, p_partkey::INT AS number, p_partkey BETWEEN 34 AND 68 AS in_range,
    p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) AS in_model FROM part""")
def item_ids_and_flags(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("item_id", P.format_id("p_partkey"))
    model = table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return p.join(model.withColumn("hit", F.lit(True)), "p_partkey", "left").select(
        "p_partkey", "item_id", P.parse_id("item_id").alias("number"), P.in_range("p_partkey", 34, 68).alias("in_range"),
        F.coalesce("hit", F.lit(False)).alias("in_model"),
    )


_ANSWER = """CASE p_partkey % 8 WHEN 0 THEN ' ATT ' WHEN 1 THEN 'Working Memory (WM)' WHEN 2 THEN 'hop with GDPS first' WHEN 3 THEN 'goal-directed problem solving'
    WHEN 4 THEN 'Higher-Order Processes' WHEN 5 THEN '  ' WHEN 6 THEN p_type ELSE 'FS, att' END"""
_ALIAS = """CASE {k} WHEN 'att' THEN 'attention' WHEN 'wm' THEN 'working_memory' WHEN 'gdps' THEN 'goal_directed_problem_solving' WHEN 'fs' THEN 'flexibility_shift' WHEN 'hop' THEN 'higher_order_processing' END"""
_SNAKE = r"regexp_replace(t, '[\s\-]+', '_', 'g')"
_CANON = f"""CASE WHEN length(t) > 0 THEN coalesce(CASE t WHEN 'working memory (wm)' THEN 'working_memory' END,
    {_ALIAS.format(k=r"regexp_replace(t, '[\s()/\-]+', '', 'g')")}, CASE {_SNAKE} WHEN 'higher_order_processes' THEN 'higher_order_processing' END, {_SNAKE}) END"""


@query(f"""SELECT canonical, prim AS "primary", count(*) AS n FROM (SELECT {_CANON} AS canonical,
    coalesce({_ALIAS.format(k="list_filter(regexp_extract_all(t, '[a-z]+'), lambda w: w IN ('att', 'wm', 'gdps', 'fs', 'hop'))[1]")}, {_CANON}) AS prim
    FROM (SELECT lower(trim({_ANSWER})) AS t FROM part)) GROUP BY ALL""")
def canonical_labels(spark, sf_dir):
    k = F.col("p_partkey") % 8
    answer = (
        F.when(k == 0, " ATT ").when(k == 1, "Working Memory (WM)").when(k == 2, "hop with GDPS first")
        .when(k == 3, "goal-directed problem solving").when(k == 4, "Higher-Order Processes").when(k == 5, "  ")
        .when(k == 6, F.col("p_type")).otherwise("FS, att")
    )
    p = table(spark, sf_dir, "part").select(answer.alias("answer"))
    return p.select(P.canonical_label("answer").alias("canonical"), P.primary_label("answer").alias("primary")).groupBy(
        "canonical", "primary"
    ).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT stars, stars_ns, count(*) AS n FROM (SELECT CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' WHEN p < 0.1 THEN '†' WHEN p IS NOT NULL THEN '' END AS stars,
    CASE WHEN p IS NULL THEN '—' WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS stars_ns
    FROM (SELECT CASE WHEN event_id % 13 <> 0 THEN value / 200 END AS p FROM events)) GROUP BY ALL""")
def significance_stars(spark, sf_dir):
    p = F.when(F.col("event_id") % 13 != 0, F.col("value") / 200)
    return table(spark, sf_dir, "events").select(P.stars(p).alias("stars"), P.stars_ns(p).alias("stars_ns")).groupBy(
        "stars", "stars_ns"
    ).agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT l_linenumber, {r('avg(a)')} AS corrected, {r('avg(greatest(a - 20, 0))')} AS clamped FROM (
    SELECT l_linenumber, CASE WHEN l_quantity < 37 THEN l_tax * 400 - (40 - l_quantity) / 4.3482::DOUBLE ELSE l_tax * 400 END AS a FROM lineitem) GROUP BY l_linenumber""")
def corrected_age(spark, sf_dir):
    months = F.col("l_tax") * 400
    line = table(spark, sf_dir, "lineitem").select(
        "l_linenumber", P.corrected_age(months, "l_quantity").alias("a"), P.corrected_age(months - 20, "l_quantity", clamp=True).alias("b")
    )
    return line.groupBy("l_linenumber").agg(r6(F.avg("a")).alias("corrected"), r6(F.avg("b")).alias("clamped"))


@query(f"""WITH x AS (SELECT l_linenumber AS item, count(*) AS n, avg((l_quantity > 3 * l_linenumber - 2)::INT) AS p FROM lineitem WHERE l_linenumber < 7 GROUP BY 1)
    SELECT i.item, coalesce(n, 0) AS n, {r('p')} AS pass_share, CASE WHEN n IS NULL THEN 'not_administered' WHEN greatest(p, 1 - p) < 0.8 THEN 'retained' WHEN p >= 1 - p THEN 'ceiling' ELSE 'floor' END AS status
    FROM (SELECT DISTINCT l_linenumber AS item FROM lineitem) i LEFT JOIN x USING (item)""")
def floor_and_ceiling_items(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("item"), "l_quantity")
    resp = line.filter("item < 7").withColumn("resp", (F.col("l_quantity") > 3 * F.col("item") - 2).cast("int"))
    return P.floor_ceiling(resp, line, 0.8).withColumn("pass_share", r6("pass_share"))


@query(f"""SELECT predictor, standardization, count(*) AS n, {r('sum(estimate)', 4)} AS total FROM (SELECT event_type AS predictor, CASE WHEN event_id % 2 = 0 THEN 'STDY' ELSE 'STDYX' END AS standardization, value AS estimate FROM events)
    WHERE standardization = CASE WHEN predictor IN ('click', 'error') THEN 'STDY' ELSE 'STDYX' END GROUP BY ALL""")
def estimate_by_predictor_kind(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("predictor"), F.when(F.col("event_id") % 2 == 0, "STDY").otherwise("STDYX").alias("standardization"),
        F.col("value").alias("estimate"),
    )
    return P.pick_estimate(e, ["click", "error"]).groupBy("predictor", "standardization").agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("estimate"), 4).alias("total")
    )


@query("""WITH g AS (SELECT o_custkey, count(*) AS c FROM orders GROUP BY 1) SELECT c < 8 AS excluded, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_groups FROM orders JOIN g USING (o_custkey) GROUP BY 1""")
def sparse_groups(spark, sf_dir):
    out = P.sparse_groups(table(spark, sf_dir, "orders"), "o_custkey", 8)
    return out.groupBy("excluded").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("o_custkey").alias("n_groups"))


@query(f"""SELECT variable, round_even(value, CASE WHEN variable IN ('error', 'view') THEN 4 ELSE 3 END) + 0.0 AS value FROM (SELECT event_type AS variable, avg(value) AS value FROM events GROUP BY 1)""")
def table_rounding(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("variable")).agg(F.avg("value").alias("value"))
    return e.select("variable", P.table_round("value", "variable", ["error", "view"]).alias("value"))


# ------------------------------------------------------------------ joins and sets


@query("""SELECT c.c_custkey, n.n_name, o.o_orderkey, o.o_totalprice, e.event_id FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
    LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rk FROM orders) WHERE rk = 1) o ON o.o_custkey = c.c_custkey
    LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rk FROM events) WHERE rk = 1) e ON e.user_id = c.c_custkey""")
def subject_table(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "subject")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    first_order = W.earliest_record(
        table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject"), "o_orderdate", "o_orderkey", "o_totalprice"), "subject", "o_orderdate", "o_orderkey"
    )
    first_event = W.earliest_record(table(spark, sf_dir, "events").select(F.col("user_id").alias("subject"), "ts", "event_id"), "subject", "ts", "event_id")
    out = J.left_chain(c.join(n, "c_nationkey", "left"), "subject", first_order, first_event)
    return out.select(F.col("subject").alias("c_custkey"), "n_name", "o_orderkey", "o_totalprice", "event_id")


@query("""SELECT coalesce(r.r_name, 'elsewhere') AS region, count(*) AS n FROM nation n LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) r ON r.r_regionkey = n.n_regionkey JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY 1""")
def dictionary_lookup(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    regions = table(spark, sf_dir, "region").filter("r_regionkey < 3").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("region"))
    return J.lookup(c, regions, "n_regionkey", "region", "elsewhere").groupBy("region").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'unused' AS side, c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)
    UNION ALL SELECT 'used', c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)""")
def unused_and_used_items(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey")
    o = table(spark, sf_dir, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return J.not_in(c, o, "c_custkey").select(F.lit("unused").alias("side"), "c_custkey").unionByName(
        J.only_in(c, o, "c_custkey").select(F.lit("used").alias("side"), "c_custkey")
    )


@query("""SELECT n.n_nationkey AS ord, n.n_name, s.total FROM nation n LEFT JOIN (SELECT c_nationkey, count(*) AS total FROM customer WHERE c_acctbal > 8000 GROUP BY 1) s ON s.c_nationkey = n.n_nationkey""")
def reindexed_counts(spark, sf_dir):
    keys = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), "n_name", F.col("n_nationkey").alias("ord"))
    counts = table(spark, sf_dir, "customer").filter("c_acctbal > 8000").groupBy(F.col("c_nationkey").alias("key")).agg(F.count(F.lit(1)).alias("total"))
    return J.reindex(counts, keys, "key").select("ord", "n_name", "total")


@query("""SELECT l_returnflag, branch, count(*) AS n, count(c.mu) AS n_found, min(c.mu) AS lo, max(c.mu) AS hi FROM (SELECT *, (l_linenumber * 20 + 150 + l_quantity)::INT AS day,
    CASE WHEN (l_linenumber * 20 + 150 + l_quantity)::INT BETWEEN 168 AND 230 THEN 'early' WHEN (l_linenumber * 20 + 150 + l_quantity)::INT BETWEEN 231 AND 300 THEN 'late' END AS branch FROM lineitem) l
    LEFT JOIN (SELECT p_partkey::INT AS day, p_retailprice AS mu FROM part) c USING (day) GROUP BY 1, 2""")
def coefficient_lookup(spark, sf_dir):
    day = (F.col("l_linenumber") * 20 + 150 + F.col("l_quantity")).cast("int")
    line = table(spark, sf_dir, "lineitem").withColumn("day", day)
    coef = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("day"), F.col("p_retailprice").alias("mu"))
    out = J.reference_lookup(line, coef, ["day"], "day", [(168, 230, "early"), (231, 300, "late")])
    return out.groupBy("l_returnflag", "branch").agg(
        F.count(F.lit(1)).alias("n"), F.count("mu").alias("n_found"), F.min("mu").alias("lo"), F.max("mu").alias("hi")
    )


@query("""WITH a AS (SELECT o_custkey AS id, o_orderpriority AS label FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL), b AS (SELECT o_custkey AS id, o_orderpriority AS label FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL)
    SELECT a.label AS label_a, b.label AS label_b, count(*) AS n FROM a JOIN b USING (id) GROUP BY ALL""")
def membership_product(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("label"), "o_orderstatus")
    a, b = (o.filter(F.col("o_orderstatus") == s).select("id", "label").distinct() for s in ("F", "O"))
    return J.membership_pairs(a, b).groupBy("label_a", "label_b").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH a AS (SELECT doc_id, quality FROM labels WHERE doc_id % 3 <> 0), b AS (SELECT doc_id, toxic FROM labels WHERE doc_id % 5 <> 0), t AS (SELECT doc_id, (n_chars > 500)::INT AS ref FROM documents)
    SELECT doc_id AS id, a.quality AS label_a, b.toxic AS label_b, t.ref AS label_ref, coalesce(a.quality = t.ref, false) AS agree_a, coalesce(b.toxic = t.ref, false) AS agree_b,
    CASE WHEN a.quality = t.ref AND b.toxic = t.ref THEN 'both' WHEN a.quality = t.ref THEN 'first_only' WHEN b.toxic = t.ref THEN 'second_only' ELSE 'neither' END AS status
    FROM a FULL JOIN b USING (doc_id) LEFT JOIN t USING (doc_id)""")
def merged_solutions(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    a = lab.filter("doc_id % 3 <> 0").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    b = lab.filter("doc_id % 5 <> 0").select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))
    t = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.col("n_chars") > 500).cast("int").alias("label"))
    return J.merge_solutions(a, b, t)


_METHODS = """(SELECT vec_id AS id, 'source' AS method, 'd' || (label % 3) AS label FROM embeddings UNION ALL SELECT vec_id, 'target', 'd' || (vec_id % 3) FROM embeddings WHERE vec_id % 4 <> 0
    UNION ALL SELECT vec_id, 'pooled', 'd' || (CASE WHEN vec_id % 5 = 0 THEN 1 ELSE label % 3 END) FROM embeddings)"""


def _methods(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    d = lambda c: F.concat(F.lit("d"), c.cast("int")).alias("label")
    return (
        e.select("id", F.lit("source").alias("method"), d(F.col("label") % 3))
        .unionByName(e.filter("id % 4 <> 0").select("id", F.lit("target").alias("method"), d(F.col("id") % 3)))
        .unionByName(e.select("id", F.lit("pooled").alias("method"), d(F.when(F.col("id") % 5 == 0, 1).otherwise(F.col("label") % 3))))
    )


@query(f"""SELECT id, max(label) FILTER (method = 'source') AS source, max(label) FILTER (method = 'target') AS target, max(label) FILTER (method = 'pooled') AS pooled, count(DISTINCT label) > 1 AS disagree FROM {_METHODS} GROUP BY id""")
def method_comparison(spark, sf_dir):
    return J.compare_methods(_methods(spark, sf_dir), ["source", "target", "pooled"])


@query(f"""SELECT m.method, l.label, count(x.id) AS n FROM (SELECT unnest(['source', 'target', 'pooled']) AS method) m, (SELECT unnest(['d0', 'd1', 'd2', 'd3']) AS label) l LEFT JOIN {_METHODS} x ON x.method = m.method AND x.label = l.label GROUP BY ALL""")
def method_group_sizes(spark, sf_dir):
    return J.method_sizes(_methods(spark, sf_dir), ["source", "target", "pooled"], ["d0", "d1", "d2", "d3"])


@query("""SELECT 'paired' AS source, vec_id AS id, label FROM embeddings WHERE vec_id % 2 = 0 UNION ALL SELECT 'extended', vec_id, label + 10 FROM embeddings WHERE vec_id % 2 = 1""")
def appended_assignments(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return J.append_sources({"paired": e.filter("id % 2 = 0"), "extended": e.filter("id % 2 = 1").withColumn("label", F.col("label") + 10)}, "id")


@query("""SELECT 'both' AS side, id FROM (SELECT o_custkey AS id FROM orders INTERSECT SELECT user_id FROM events)
    UNION ALL SELECT 'left', id FROM (SELECT DISTINCT o_custkey AS id FROM orders EXCEPT SELECT user_id FROM events)
    UNION ALL SELECT 'right', id FROM (SELECT user_id AS id FROM events EXCEPT SELECT o_custkey FROM orders)""")
def id_set_operations(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).distinct()
    b = table(spark, sf_dir, "events").select(F.col("user_id").alias("id")).distinct()
    return J.intersection(a, b).withColumn("side", F.lit("both")).unionByName(J.symmetric_difference(a, b))


@query("""SELECT o_custkey, o_orderpriority, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2""")
def distinct_on_keys(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice")
    return W.distinct_on(o, ["o_custkey", "o_orderpriority"], ["o_orderkey"]).drop("o_totalprice")


@query("""SELECT p_brand, p_type AS label, count(*) AS n, count(DISTINCT p_size) + count(DISTINCT p_partkey) AS n_ids FROM part GROUP BY ALL""")
def factor_model_rows(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(
        "p_brand", F.concat(F.lit('{"'), "p_type", F.lit('": ["a'), "p_size", F.lit('", "b'), "p_partkey", F.lit('"], "source": "x"}')).alias("doc")
    )
    m = models.memberships_from_json(p)
    return m.groupBy("p_brand", "label").agg(F.count_if(F.col("item_ord") == 0).alias("n"), F.count_distinct("id").alias("n_ids"))


@query("""WITH a AS (SELECT 'd' || (label % 3) AS label, vec_id AS id, vec_id AS ord FROM embeddings WHERE label < 8)
, k AS (SELECT label, count(*) AS n_items, 'F' || row_number() OVER (ORDER BY CASE label WHEN 'd2' THEN 1 WHEN 'd0' THEN 2 WHEN 'd1' THEN 3 END) AS factor_key FROM a GROUP BY label)
    SELECT factor_key, label, n_items, part, items, indices
    FROM (SELECT label, ord // 200 AS part, string_agg(id::VARCHAR, ',' ORDER BY id) AS items, string_agg((ord + 1)::VARCHAR, ',' ORDER BY ord) AS indices FROM a GROUP BY ALL) JOIN k USING (label)""")
def factor_model_spec(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    assigned = e.filter("label < 8").select("id", F.concat(F.lit("d"), F.col("label") % 3).alias("label"))
    spec = models.factor_spec(assigned, ["d2", "d0", "d1"], e.select("id", F.col("id").alias("ord")), part_items=200)
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return spec.select("factor_key", "label", "n_items", "part", text("item_ids").alias("items"), text("item_indices").alias("indices"))


@query("SELECT e.vec_id AS id, e.label, len(e.embedding)::INT AS dims FROM embeddings e")
def aligned_vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    return models.aligned_vectors(e.select("id"), e.select("id", "vec"), e.select("id", "label")).select("id", "label", F.size("vec").alias("dims"))


# ------------------------------------------------------------------ ranks


@query("""SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rk FROM events) WHERE rk = 1""")
def earliest_record(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return W.earliest_record(e, "user_id", "ts", "event_id").drop("ts")


@query("""SELECT l_partkey, l_orderkey, l_linenumber, l_extendedprice, rk AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rk FROM lineitem) WHERE rk <= 3""")
def top_k_per_group(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    out = W.top_k(line, ["l_partkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 3)
    return out.withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH s AS (SELECT o_custkey AS id, o_orderpriority AS label, sum(o_totalprice) AS score FROM orders GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, label DESC) AS rk FROM s)
    SELECT b.id, b.label AS best, {r('b.score', 2)} AS best_score, s.label AS second, {r('s.score', 2)} AS second_score, {r('b.score - s.score', 2)} AS margin FROM k b LEFT JOIN k s ON s.id = b.id AND s.rk = 2 WHERE b.rk = 1""")
def best_and_second(spark, sf_dir):
    s = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("label")).agg(F.sum("o_totalprice").alias("score"))
    out = W.top_two(s)
    return out.select("id", "best", "second", *[r6(c, 2).alias(c) for c in ("best_score", "second_score", "margin")])


@query("""SELECT user_id, any_error, event_id FROM (SELECT user_id, bool_or(event_type = 'error') AS any_error, min(event_id) AS event_id FROM events GROUP BY 1)""")
def flag_over_duplicates(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", (F.col("event_type") == "error").alias("any_error"), "event_id")
    return W.any_flag_first(e, "user_id", "any_error", ["event_id"])


@query("""SELECT o_orderkey, o_orderpriority, CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '1-URGENT' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 99 END AS position FROM orders""")
def category_order(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return W.category_order(o, "o_orderpriority", ["5-LOW", "1-URGENT", "3-MEDIUM"], "o_orderkey")


@query("""WITH c AS (SELECT user_id AS id, event_type AS label, count(*) AS n FROM events GROUP BY ALL)
    SELECT id, label, n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, CASE label WHEN 'purchase' THEN 0 WHEN 'error' THEN 1 ELSE 2 END, label DESC) AS rk FROM c) WHERE rk = 1""")
def majority_label(spark, sf_dir):
    v = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("label"))
    return W.majority_label(v, ["purchase", "error"])


@query(f"""SELECT {r('v')} AS low, {r('high')} AS high, {r('high - v')} AS gap FROM (SELECT v, lead(v) OVER (ORDER BY v) AS high FROM (SELECT DISTINCT c_acctbal AS v FROM customer)) WHERE high IS NOT NULL ORDER BY round(high - v, 12) DESC, v LIMIT 1""")
def widest_gap(spark, sf_dir):
    out = W.widest_gap(table(spark, sf_dir, "customer"), "c_acctbal")
    return out.select(*[r6(c).alias(c) for c in ("low", "high", "gap")])


_LINES = """(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)"""


@query(f"""SELECT doc_id, count(*) AS n_lines, count(head) AS n_after_head, count(DISTINCT head) AS n_heads, max(length(head)) AS longest FROM (
    SELECT doc_id, last_value(CASE WHEN regexp_matches(line, '^[A-M]') THEN substr(line, 1, 12) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS head FROM {_LINES}) GROUP BY doc_id""")
def carried_headings(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    head = F.when(F.col("line").rlike("^[A-M]"), F.substring("line", 1, 12))
    out = W.carry_forward(lines.select("doc_id", "line_no", head.alias("head")), ["doc_id"], "line_no", ["head"], chunk=64)
    return out.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count("head").alias("n_after_head"), F.count_distinct("head").alias("n_heads"),
        F.max(F.length("head")).cast("long").alias("longest"),
    )


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def largest_orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


# ------------------------------------------------------------------ descriptions


def _stat(v: str, frm: str) -> str:
    return f"SELECT '{v}' AS variable, count({v}) AS n, {r(f'avg({v})')} AS mean, {r(f'stddev_samp({v})')} AS sd, min({v})::DOUBLE AS min, max({v})::DOUBLE AS max FROM {frm}"


@query(" UNION ALL ".join(_stat(v, "lineitem") for v in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
def mean_sd_table(spark, sf_dir):
    out = A.mean_sd(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return out.withColumn("mean", r6("mean")).withColumn("sd", r6("sd"))


_T1 = "(SELECT c.*, o.o_totalprice FROM customer c LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rk FROM orders) WHERE rk = 1) o ON o.o_custkey = c.c_custkey)"


@query(f"""SELECT 'money' AS block, 'c_acctbal' AS variable, NULL AS category, 'mean_sd' AS statistic, {r('avg(c_acctbal)', 4)} AS value, {r('stddev_samp(c_acctbal)', 4)} AS sd_or_pct, min(c_acctbal) AS low, max(c_acctbal) AS high, count(c_acctbal) AS n_with_data, count(*) - count(c_acctbal) AS n_missing FROM {_T1}
    UNION ALL SELECT 'money', 'o_totalprice', NULL, 'mean_sd', {r('avg(o_totalprice)', 4)}, {r('stddev_samp(o_totalprice)', 4)}, min(o_totalprice), max(o_totalprice), count(o_totalprice), count(*) - count(o_totalprice) FROM {_T1}
    UNION ALL SELECT 'segment', 'c_mktsegment', 'BUILDING', 'n_pct', count(*) FILTER (c_mktsegment = 'BUILDING')::DOUBLE, {r("100.0::DOUBLE * count(*) FILTER (c_mktsegment = 'BUILDING') / count(c_mktsegment)", 4)}, NULL, NULL, count(c_mktsegment), count(*) - count(c_mktsegment) FROM {_T1}
    UNION ALL SELECT 'orders', 'o_totalprice', '> 100000', 'n_pct', count(*) FILTER (o_totalprice > 100000)::DOUBLE, {r("100.0::DOUBLE * count(*) FILTER (o_totalprice > 100000) / count(o_totalprice)", 4)}, NULL, NULL, count(o_totalprice), count(*) - count(o_totalprice) FROM {_T1}""")
def baseline_table(spark, sf_dir):
    first = W.earliest_record(
        table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_orderkey", "o_totalprice"), "c_custkey", "o_orderdate", "o_orderkey"
    )
    subjects = J.left_chain(table(spark, sf_dir, "customer"), "c_custkey", first)
    out = A.table_one(subjects, [
        A.Mean("money", "c_acctbal"), A.Mean("money", "o_totalprice"),
        A.Share("segment", "c_mktsegment", "BUILDING", F.col("c_mktsegment") == "BUILDING"),
        A.Share("orders", "o_totalprice", "> 100000", F.col("o_totalprice") > 100000),
    ])
    return out.drop("ord").withColumn("value", r6("value", 4)).withColumn("sd_or_pct", r6("sd_or_pct", 4))


_SRC = "(SELECT 'customer' AS source, c_custkey AS id FROM customer UNION ALL SELECT 'orders', o_custkey FROM orders UNION ALL SELECT 'events', user_id FROM events)"


@query(f"""WITH x AS (SELECT DISTINCT source, id FROM {_SRC}), k AS (SELECT id, count(*) AS c FROM x GROUP BY id)
    SELECT 'source' AS kind, source AS name, count(*) AS n FROM x GROUP BY source UNION ALL SELECT 'any', 'all', count(*) FROM k UNION ALL SELECT 'every', 'all', count(*) FILTER (c = 3) FROM k
    UNION ALL SELECT 'pair', a.source || '&' || b.source, count(*) FROM x a JOIN x b ON a.id = b.id AND a.source < b.source GROUP BY ALL""")
def instrument_counts(spark, sf_dir):
    ids = None
    for name, col in (("customer", "c_custkey"), ("orders", "o_custkey"), ("events", "user_id")):
        part = table(spark, sf_dir, name).select(F.lit(name).alias("source"), F.col(col).alias("id"))
        ids = part if ids is None else ids.unionByName(part)
    return A.source_overlap(ids)


@query(f"""WITH x AS (SELECT DISTINCT source, id FROM {_SRC}), k AS (SELECT id, count(*) AS c FROM x GROUP BY id)
    SELECT *, true AS within FROM (
    SELECT 'source' AS kind, source AS name, count(*) AS n FROM x GROUP BY source UNION ALL SELECT 'any', 'all', count(*) FROM k UNION ALL SELECT 'every', 'all', count(*) FILTER (c = 3) FROM k
    UNION ALL SELECT 'pair', a.source || '&' || b.source, count(*) FROM x a JOIN x b ON a.id = b.id AND a.source < b.source GROUP BY ALL)""")
def sketched_instrument_counts(spark, sf_dir):
    """Counts from sketches stored by source and part, next to the exact ones; four standard errors are allowed."""
    ids = _sources(spark, sf_dir)
    sketches = materialize(A.id_sketches(ids, ["source", "part"]))
    found = A.sketched_overlap(sketches).withColumnRenamed("n", "estimate")
    within = F.abs(F.col("estimate") - F.col("n")) <= 4 * F.col("error") + 0.5
    return A.source_overlap(ids.select("source", "id")).join(found, ["kind", "name"], "left").select("kind", "name", "n", F.coalesce(within, F.lit(False)).alias("within"))


def _sources(spark, sf_dir):
    """(source, part, id): customers by nation, orders and events by month."""
    kinds = [("customer", "c_custkey", "c_nationkey"), ("orders", "o_custkey", "month(o_orderdate)"), ("events", "user_id", "month(ts)")]
    parts = [table(spark, sf_dir, name).select(F.lit(name).alias("source"), F.expr(part).cast("int").alias("part"), F.col(i).alias("id")) for name, i, part in kinds]
    return functools.reduce(DataFrame.unionByName, parts)


@query("""SELECT 'all' AS scope, min(o_orderdate)::DATE::VARCHAR AS first, max(o_orderdate)::DATE::VARCHAR AS last, count(*) AS n FROM orders
    UNION ALL SELECT 'subset', min(o_orderdate)::DATE::VARCHAR, max(o_orderdate)::DATE::VARCHAR, count(*) FROM orders WHERE o_orderpriority = '1-URGENT'""")
def date_ranges(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderpriority", F.date_format("o_orderdate", "MM/dd/yyyy").alias("text"))
    dated = o.withColumn("d", A.strict_date(F.col("text")))
    out = A.date_range(dated, "d", F.col("o_orderpriority") == "1-URGENT")
    return out.withColumn("first", F.col("first").cast("string")).withColumn("last", F.col("last").cast("string"))


@query("""SELECT parsed, count(*) AS n FROM (SELECT CASE WHEN TRY_STRPTIME(t, '%m/%d/%Y') IS NOT NULL THEN 'ok' ELSE 'bad' END AS parsed FROM
    (SELECT CASE WHEN o_orderkey % 17 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%m/%d/%Y') END AS t FROM orders)) GROUP BY 1""")
def date_parse_failures(spark, sf_dir):
    t = F.when(F.col("o_orderkey") % 17 == 0, "unknown").otherwise(F.date_format("o_orderdate", "MM/dd/yyyy"))
    ok = F.try_to_timestamp(t, F.lit("MM/dd/yyyy")).isNotNull()
    return table(spark, sf_dir, "orders").groupBy(F.when(ok, "ok").otherwise("bad").alias("parsed")).agg(F.count(F.lit(1)).alias("n"))


_MISS = """(SELECT CASE WHEN l_quantity > 5 THEN l_quantity END AS q, CASE WHEN l_discount > 0.01 THEN l_discount END AS d, CASE WHEN l_tax > 0.02 THEN l_tax END AS t, CASE WHEN l_linenumber < 7 THEN l_linenumber END AS l FROM lineitem)"""


def _miss(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        F.when(c("l_quantity") > 5, c("l_quantity")).alias("q"), F.when(c("l_discount") > 0.01, c("l_discount")).alias("d"),
        F.when(c("l_tax") > 0.02, c("l_tax")).alias("t"), F.when(c("l_linenumber") < 7, c("l_linenumber")).alias("l"),
    )


def _var(v):
    return f"SELECT 'variable' AS scope, '{v}' AS name, count(*) - count({v}) AS n_missing, count({v}) AS n_complete FROM {_MISS}"


def _blk(scope, name, *cols):
    cond = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    return f"SELECT '{scope}', '{name}', count(*) FILTER (NOT ({cond})), count(*) FILTER ({cond}) FROM {_MISS}"


@query(" UNION ALL ".join([_var(v) for v in "qdtl"] + [_blk("block", "amount", "q", "d"), _blk("block", "other", "t", "l"), _blk("cross", "amount&other", "q", "d", "t", "l")]))
def missingness(spark, sf_dir):
    return A.missingness(_miss(spark, sf_dir), {"amount": ["q", "d"], "other": ["t", "l"]})


@query(f"""SELECT concat_ws('+', CASE WHEN q IS NULL THEN 'q' END, CASE WHEN d IS NULL THEN 'd' END, CASE WHEN t IS NULL THEN 't' END, CASE WHEN l IS NULL THEN 'l' END) AS pattern,
    ((q IS NULL)::INT + (d IS NULL)::INT + (t IS NULL)::INT + (l IS NULL)::INT)::INT AS n_missing, count(*) AS n FROM {_MISS} GROUP BY 1, 2 ORDER BY n DESC, pattern LIMIT 15""")
def missing_patterns(spark, sf_dir):
    return A.missing_patterns(_miss(spark, sf_dir), ["q", "d", "t", "l"])


@query(f"""WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
    SELECT event_type, count(*) AS n, {r('any_value(q1)')} AS q1, {r('any_value(median)')} AS median, {r('any_value(q3)')} AS q3, min(value) FILTER (value >= q1 - 1.5 * (q3 - q1)) AS whisker_low,
    max(value) FILTER (value <= q3 + 1.5 * (q3 - q1)) AS whisker_high, {r('any_value(q3 - q1)')} AS iqr FROM events JOIN q USING (event_type) GROUP BY event_type""")
def box_statistics(spark, sf_dir):
    out = A.box_stats(table(spark, sf_dir, "events").select("event_type", "value"), ["event_type"], "value")
    return out.select("event_type", "n", "whisker_low", "whisker_high", *[r6(c).alias(c) for c in ("q1", "median", "q3", "iqr")])


@query(f"""WITH s AS (SELECT event_type, stddev_samp(value) * 0.18 AS bw FROM events GROUP BY 1), g AS (SELECT 0.0::DOUBLE + 100.0::DOUBLE * i / 20 AS x FROM range(21) t(i)),
    d AS (SELECT event_type, x, avg(exp(-0.5 * pow((x - value) / bw, 2))) AS d FROM events JOIN s USING (event_type), g GROUP BY ALL)
    SELECT event_type, {r('x')} AS x, {r('d / max(d) OVER (PARTITION BY event_type)')} AS density FROM d""")
def kernel_density(spark, sf_dir):
    out = A.kernel_density(table(spark, sf_dir, "events").select("event_type", "value"), ["event_type"], "value", 0.0, 100.0, 21)
    return out.select("event_type", r6("x").alias("x"), r6("density").alias("density"))


@query(f"""WITH b AS (SELECT least(floor((least(l_discount * 10, 1.0::DOUBLE) - 0.0) / 0.125::DOUBLE), 7)::INT AS bin, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT i::INT AS bin, {r('i * 0.125::DOUBLE')} AS lo, {r('(i + 1) * 0.125::DOUBLE')} AS hi, coalesce(n, 0) AS n FROM range(8) t(i) LEFT JOIN b ON b.bin = t.i""")
def fixed_histogram(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 10).alias("v"))
    out = A.histogram(v, "v", 0.0, 1.0, 8)
    return out.select("bin", r6("lo").alias("lo"), r6("hi").alias("hi"), "n")


_BIN = "(SELECT (l_quantity > 25)::INT AS big, (l_discount > 0.05)::INT AS cut, CASE WHEN l_linenumber < 6 THEN (l_tax > 0.04)::INT END AS tax, (l_returnflag = 'R')::INT AS ret FROM lineitem)"


def _binary(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        (c("l_quantity") > 25).cast("int").alias("big"), (c("l_discount") > 0.05).cast("int").alias("cut"),
        F.when(c("l_linenumber") < 6, (c("l_tax") > 0.04).cast("int")).alias("tax"), (c("l_returnflag") == "R").cast("int").alias("ret"),
    )


def _assoc(a, b):
    return f"""SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER ({a} = 1 AND {b} = 1) AS n11, count(*) FILTER ({a} = 1 AND {b} = 0) AS n10,
        count(*) FILTER ({a} = 0 AND {b} = 1) AS n01, count(*) FILTER ({a} = 0 AND {b} = 0) AS n00 FROM {_BIN} WHERE {a} IS NOT NULL AND {b} IS NOT NULL"""


_PAIRS = [("big", "cut"), ("big", "ret"), ("big", "tax"), ("cut", "ret"), ("cut", "tax"), ("ret", "tax")]


@query(f"""WITH c AS ({' UNION ALL '.join(_assoc(a, b) for a, b in _PAIRS)}), d AS (SELECT *, n11::DOUBLE AS x, n10::DOUBLE AS y, n01::DOUBLE AS z, n00::DOUBLE AS w FROM c)
    SELECT a, b, n11, n10, n01, n00, {r('(x*w - y*z) / sqrt((x+y)*(z+w)*(x+z)*(y+w))')} AS phi, {r('(x*w - y*z) / (x*w + y*z)')} AS q,
    {r('(pow(x*w/(y*z), 0.75) - 1) / (pow(x*w/(y*z), 0.75) + 1)')} AS digby FROM d""")
def binary_associations(spark, sf_dir):
    out = A.binary_associations(_binary(spark, sf_dir), ["big", "cut", "tax", "ret"], exact=False)
    return out.select("a", "b", "n11", "n10", "n01", "n00", *[r6(c).alias(c) for c in ("phi", "q", "digby")])


@query()
def tetrachoric_matrix(spark, sf_dir):
    out = A.binary_associations(_binary(spark, sf_dir), ["big", "cut", "tax", "ret"])
    return out.select("a", "b", r6("r", 4).alias("r"))


@query(f"""SELECT l_returnflag, count(*) AS n, {r('corr(l_extendedprice, l_quantity)')} AS r, {r('regr_slope(l_extendedprice, l_quantity)', 3)} AS slope, {r('regr_intercept(l_extendedprice, l_quantity)', 3)} AS intercept FROM lineitem GROUP BY 1""")
def stratified_line_fit(spark, sf_dir):
    out = A.line_fit(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity", ["l_returnflag"])
    return out.select("l_returnflag", "n", r6("r").alias("r"), r6("slope", 3).alias("slope"), r6("intercept", 3).alias("intercept"))


_TAKEN = "(SELECT l_returnflag, l_linestatus, l_quantity AS x, l_extendedprice AS y, l_extendedprice - 900 * l_quantity AS z FROM lineitem)"


@query(f"""SELECT l_returnflag, l_linestatus, count(*) AS n, {r('corr(y, x)')} AS r_before, {r('regr_slope(y, x)', 3)} AS slope_before, {r('corr(z, x)')} AS r_after,
    {r('regr_slope(z, x)', 3)} AS slope_after FROM {_TAKEN} GROUP BY 1, 2""")
def line_fit_adjustment(spark, sf_dir):
    """Price on quantity by stratum, before and after a price per piece is taken off."""
    line = table(spark, sf_dir, "lineitem").withColumn("z", F.col("l_extendedprice") - 900 * F.col("l_quantity"))
    out = A.line_fit_before_and_after(line, "l_extendedprice", "z", "l_quantity", ["l_returnflag", "l_linestatus"])
    return out.select(
        "l_returnflag", "l_linestatus", "n", r6("r_before").alias("r_before"), r6("slope_before", 3).alias("slope_before"), r6("r_after").alias("r_after"),
        r6("slope_after", 3).alias("slope_after"),
    )


_NUM = "(SELECT l_quantity AS q, l_extendedprice AS p, CASE WHEN l_linenumber < 5 THEN l_discount END AS d, 7 AS k FROM lineitem)"


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, {r(f'corr({a}, {b})')} AS r FROM {_NUM} WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a in "qpd" for b in "qpd"))
def correlation_matrix(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"), F.when(F.col("l_linenumber") < 5, F.col("l_discount")).alias("d"), F.lit(7).alias("k")
    )
    return A.correlation_matrix(t, ["q", "p", "d", "k"]).withColumn("r", r6("r"))


@query(f"""SELECT label, n, {r('n / sum(n) OVER ()')} AS share, {r('(sum(CASE WHEN label = -1 THEN n ELSE 0 END) OVER ()) / sum(n) OVER ()')} AS noise_rate FROM (SELECT CASE WHEN vec_id % 6 = 0 THEN -1 ELSE label END AS label, count(*) AS n FROM embeddings GROUP BY 1)""")
def cluster_sizes(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.when(F.col("vec_id") % 6 == 0, -1).otherwise(F.col("label")).alias("label"))
    return A.cluster_sizes(e).withColumn("share", r6("share")).withColumn("noise_rate", r6("noise_rate"))


@query("""WITH e AS (SELECT l_partkey AS key, CASE WHEN l_linenumber = 4 THEN 'UNIDIM' ELSE '3F' END AS model, CASE l_linenumber WHEN 1 THEN 'WM' WHEN 2 THEN 'FS' ELSE 'COG' END AS factor, max(l_extendedprice) AS estimate, max(l_quantity) AS z_ratio, max(l_discount) AS p_value FROM lineitem GROUP BY 1, 2, 3),
    s AS (SELECT DISTINCT l_partkey AS key FROM lineitem WHERE l_quantity > 48)
    SELECT key, max(estimate) FILTER (model <> 'UNIDIM' AND factor = 'WM') AS est_WM, max(z_ratio) FILTER (model <> 'UNIDIM' AND factor = 'WM') AS z_WM, max(p_value) FILTER (model <> 'UNIDIM' AND factor = 'WM') AS p_WM,
    max(estimate) FILTER (model = 'UNIDIM') AS est_GENERAL, max(z_ratio) FILTER (model = 'UNIDIM') AS z_GENERAL, max(p_value) FILTER (model = 'UNIDIM') AS p_GENERAL, key IN (SELECT key FROM s) AS significant FROM e GROUP BY key""")
def effect_panel(spark, sf_dir):
    n = F.col("l_linenumber")
    e = table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_partkey").alias("key"), F.when(n == 4, "UNIDIM").otherwise("3F").alias("model"),
        F.when(n == 1, "WM").when(n == 2, "FS").otherwise("COG").alias("factor"),
    ).agg(F.max("l_extendedprice").alias("estimate"), F.max("l_quantity").alias("z_ratio"), F.max("l_discount").alias("p_value"))
    sig = table(spark, sf_dir, "lineitem").filter("l_quantity > 48").select(F.concat("l_partkey", F.lit(":equal")).alias("constraint"))
    out = A.effect_panel(e, ["WM", "GENERAL"], sig)
    return out
