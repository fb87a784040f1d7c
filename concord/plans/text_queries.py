"""Text repair, items, reports, and table checks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from concord.functions import stats as N
from concord.functions import text as X
from concord.functions.recode import format_id
from concord.operators import checks as Q
from concord.operators import encoders, growth
from concord.operators import reports as T
from concord.plans.base import query, r, r6, table

_PLAIN = r"""regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(translate(text, '’‘“”–—−', '''''""---'), '(Item\s+\d{1,3})\s{2,}(\S)', '\1 - \2', 'gi'), chr(13), chr(10)), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"""


@query(f"""SELECT doc_id, length(t) AS n_chars, md5(t) AS digest FROM (SELECT doc_id, {_PLAIN} AS t FROM (SELECT doc_id, text || ' “é”' AS text FROM documents))""")
def repaired_texts(spark, sf_dir):
    """Every text gets a quoted letter and is spoilt as a wrong decoding does it; the repair must find the original."""
    spoilt = F.decode(F.encode(F.concat("text", F.lit(" “é”")), "UTF-8"), "ISO-8859-1")
    d = table(spark, sf_dir, "documents").select("doc_id", X.repair_text(spoilt).alias("t"))
    return d.select("doc_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("digest"))


def _item_docs(spark, sf_dir):
    """Item sheets: one per conversation, a block per turn."""
    c = table(spark, sf_dir, "conversations")
    words = F.array_join(F.filter(F.split(F.regexp_replace("text", "[^A-Za-z ]", ""), " "), lambda w: w != ""), " ")
    block = F.concat(
        F.lit("Item "), (F.col("turn") + 1).cast("string"), F.lit(" - "), F.col("role"), F.lit(" asks\nMaterial: card "), F.col("turn").cast("string"),
        F.lit("\n\nSay: "), words, F.lit(".\n2 points: all of it\n1 point: a\npart\n0 points: none\n"),
    )
    return c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))).alias("l")).select(
        "conv_id", F.array_join(F.transform("l", lambda s: s["b"]), "\n").alias("text")
    )


_WORDS = "array_to_string(list_filter(string_split(regexp_replace(text, '[^A-Za-z ]', '', 'g'), ' '), lambda w: w <> ''), ' ')"


@query(f"""SELECT conv_id, printf('COG_%03d', turn + 1) AS item_id, role || ' asks' AS title, 'card ' || turn AS materials, 'Say: ' || {_WORDS} || '.' AS description, '[2 pt] all of it [1 pt] a part [0 pt] none' AS scoring,
    role || ' asks. Materials: card ' || turn || '. Description: Say: ' || {_WORDS} || '.. Scoring: [2 pt] all of it [1 pt] a part [0 pt] none' AS item_text FROM conversations""")
def parsed_items(spark, sf_dir):
    out = X.parse_items(_item_docs(spark, sf_dir))
    return out.select("conv_id", "item_id", "title", "materials", "description", X.compact_scoring(F.col("scoring")).alias("scoring"), "item_text")


@query("""SELECT event_id, (props::JSON ->> 'k')::INT AS points, '[' || (props::JSON ->> 'k') || ' pt] ' || event_type AS compact FROM events""")
def scoring_json(spark, sf_dir):
    entry = F.struct(F.get_json_object("props", "$.k").cast("int").alias("points"), F.col("event_type").alias("criteria"))
    as_json = F.to_json(F.array(entry))
    back = F.from_json(as_json, X.ENTRY)
    return table(spark, sf_dir, "events").select("event_id", back[0]["points"].alias("points"), X.compact_scoring(back).alias("compact"))


@query("""SELECT o_orderkey, u.pos::INT AS pos, CASE u.pos WHEN 0 THEN o_orderpriority ELSE 'by ' || o_custkey END AS criteria, NULL::INT AS points FROM orders, range(2) AS u(pos)""")
def scoring_bullets(spark, sf_dir):
    """A scoring without points: its lines, bullets taken off."""
    text = F.concat(F.lit("Scoring:\n - "), "o_orderpriority", F.lit("\n\n\u2022  by "), F.col("o_custkey").cast("string"), F.lit("  \n"))
    entries = table(spark, sf_dir, "orders").select("o_orderkey", F.posexplode(X.scoring_entries(text)).alias("pos", "entry"))
    return entries.select("o_orderkey", "pos", "entry.criteria", "entry.points")


@query("""SELECT p_partkey, p_name || '.' || CASE WHEN p_partkey % 3 <> 0 THEN ' Materials: ' || p_brand || '.' ELSE '' END || CASE WHEN p_partkey % 5 <> 0 THEN ' Description: ' || p_type || '.' ELSE '' END || ' Scoring: ' || p_size AS item_text FROM part""")
def composed_texts(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        X.compose_text(
            F.col("p_name"), F.when(k % 3 != 0, F.col("p_brand")).otherwise(""), F.when(k % 5 != 0, F.col("p_type")), F.col("p_size").cast("string")
        ).alias("item_text"),
    )


@query()
def text_vectors(spark, sf_dir):
    from concord.functions.vectors import l2_norm

    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return X.text_features(d, 1 << 10).select("id", F.size("vec").alias("dims"), r6(l2_norm(F.col("vec"))).alias("norm"))


_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')"


@query(f"""WITH w AS (SELECT doc_id AS id, unnest({_WORDS}) AS word FROM documents),
    c AS (SELECT id, ('0x' || substr(md5(word), 1, 8))::BIGINT % 4096 AS b, count(*) AS n FROM w GROUP BY 1, 2),
    f AS (SELECT b, count(*) AS df FROM c GROUP BY 1),
    t AS (SELECT id, b, n * ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) AS w FROM c JOIN f USING (b)),
    u AS (SELECT id, count(*) AS cells, sum(w) / sqrt(sum(w * w)) AS total, sum(w * b) / sqrt(sum(w * w)) AS moment, max(w) / sqrt(sum(w * w)) AS largest FROM t GROUP BY id)
    SELECT doc_id AS id, coalesce(cells, 0)::INT AS cells, {r('coalesce(total, 0)', 4)} AS total, {r('coalesce(moment, 0)', 2)} AS moment, {r('coalesce(largest, 0)')} AS largest
    FROM documents LEFT JOIN u ON doc_id = id""")
def hashed_text_vectors(spark, sf_dir):
    """Size, sum, first moment and largest weight of each document's TF-IDF vector."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    v = encoders.hashed_tfidf(d)
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    moment = add(F.zip_with("buckets", "weights", lambda b, w: b * w))
    return v.select(
        "id", F.size("buckets").alias("cells"), r6(add("weights"), 4).alias("total"), r6(moment, 2).alias("moment"),
        r6(F.coalesce(F.array_max("weights"), F.lit(0.0))).alias("largest"),
    )


def _letter_shares():
    """A model of 26 numbers: how often each letter stands in a text, scaled to length one."""

    def encode(texts):
        rows = np.stack([np.bincount(np.frombuffer(t.encode(), dtype=np.uint8), minlength=256)[97:123] for t in texts]).astype(float)
        return rows / np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), 1e-300)

    return encode


@query(f"""WITH c AS (SELECT doc_id AS id, i, length(text) - length(replace(text, chr(97 + i::INT), '')) AS n FROM documents, range(26) AS u(i) WHERE text IS NOT NULL),
    m AS (SELECT id, sqrt(sum(n * n)) AS norm, sum(n) AS total, sum(n * i) AS moment FROM c GROUP BY id)
    SELECT doc_id AS id, {r('CASE WHEN norm > 0 THEN total / norm ELSE 0 END')} AS total, {r('CASE WHEN norm > 0 THEN moment / norm ELSE 0 END')} AS moment
    FROM documents JOIN m ON doc_id = id""")
def encoded_texts(spark, sf_dir):
    """Vectors of a plugged-in model."""
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("id"), "text")
    v = encoders.encode_texts(d, "letter shares", _letter_shares)
    moment = F.aggregate(F.transform("vec", lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    return v.select("id", r6(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)).alias("total"), r6(moment).alias("moment"))


# ------------------------------------------------------------------ reports


def _coefficient_reports(spark, sf_dir):
    """One text report per part, its line items as coefficient rows."""
    c = lambda name: F.col(name).cast("string")
    row = F.concat_ws("  ", F.lit("   "), F.concat(F.lit("P"), c("l_orderkey"), F.lit("_"), c("l_linenumber")), c("l_quantity"), c("l_discount"),
                      (F.col("l_quantity") * 20).cast("string"), c("l_tax"))
    block = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_returnflag").agg(
        F.array_join(F.array_sort(F.collect_list(row)), "\n").alias("rows")
    )
    body = F.array_join(F.array_sort(F.collect_list(F.concat("l_returnflag", F.lit("F       ON\n"), "rows", F.lit("\n")))), "\n")
    return block.groupBy("l_partkey").agg(body.alias("body")).select(
        F.col("l_partkey").alias("source"),
        F.concat(F.lit("MODEL RESULTS\nAF       ON\n    AGE  9.0  9.0  9.0  0.5\n\nSTDYX Standardization\n\n"), "body",
                 F.lit("\n Intercepts\n    AGE  8.0  8.0  8.0  0.5\n\nR-SQUARE\nAF       ON\n    AGE  7.0  7.0  7.0  0.5\n")).alias("text"),
    )


@query("""SELECT l_partkey AS source, 'STDYX' AS section, 'ON' AS relation, l_returnflag || 'F' AS factor, 'P' || l_orderkey || '_' || l_linenumber AS name, l_quantity AS estimate, l_discount AS se, l_quantity * 20 AS z_ratio, l_tax AS p_value FROM lineitem WHERE l_quantity * 20 < 900""")
def report_coefficients(spark, sf_dir):
    return T.extract_coefficients(_coefficient_reports(spark, sf_dir)).drop("block_no", "line_no")


def _fit_reports(spark, sf_dir):
    # composing and parsing text is the work here: spread the narrow keys first
    o = table(spark, sf_dir, "orders").repartition(spark.sparkContext.defaultParallelism, "o_orderkey")
    c = lambda col: F.col(col).cast("string")
    return o.select(
        F.col("o_orderkey").alias("source"), "o_custkey",
        F.concat(
            F.lit("Value 1.5\nChi-Square Test of Model Fit\n\n   Value      "), c("o_totalprice"), F.lit("*\n   Degrees of Freedom    "), (F.col("o_custkey") % 50).cast("string"),
            F.lit("\n   P-Value    0.25\n\nRMSEA (Root Mean Square Error Of Approximation)\n   Estimate   0.0"), (F.col("o_orderkey") % 9).cast("string"),
            F.lit("\n   90 Percent C.I.   0.01  0.09\n\nSRMR (Standardized Root Mean Square Residual)\n   Value   0.0"), (F.col("o_custkey") % 9).cast("string"), F.lit("\n\nCFI/TLI\n   CFI   0.95\n   TLI   0.9\n\nUNIVARIATE SAMPLE STATISTICS\n\n  Variable/        Mean/     Skewness/   Minimum/ % with\n  Sample Size      Variance  Kurtosis    Maximum  Min/Max\n\n"
                  " SEX       0.5     0.1     0.0     60.0%\n      739.0     0.25   -1.9     1.0     40.0%\n AGE      "), (F.col("o_custkey") % 90).cast("string"),
            F.lit(".5    0.1     10.0    1.0%\n      739.0     3.0   -1.0     99.0    2.0%\n\nChi-Square Test for Difference Testing\n   Value   "),
            (F.col("o_orderkey") % 9).cast("string"), F.lit(".5\n   Degrees of Freedom   2\n   P-Value    0.0"), (F.col("o_orderkey") % 9).cast("string"), F.lit("\n"),
        ).alias("text"),
    )


@query("""SELECT o_orderkey AS source, o_totalprice AS chi_square, (o_custkey % 50)::DOUBLE AS df, 0.25::DOUBLE AS chi_p, 0.95::DOUBLE AS cfi, 0.9::DOUBLE AS tli,
    (o_orderkey % 9) / 100.0::DOUBLE AS rmsea, 0.01::DOUBLE AS rmsea_ci_low, 0.09::DOUBLE AS rmsea_ci_high, (o_custkey % 9) / 100.0::DOUBLE AS srmr FROM orders""")
def report_fit_indices(spark, sf_dir):
    return T.fit_indices(_fit_reports(spark, sf_dir)).select("source", "chi_square", "df", "chi_p", "cfi", "tli", "rmsea", "rmsea_ci_low", "rmsea_ci_high", "srmr")


@query("""SELECT o_orderkey AS source, 'SEX' AS variable, 0.5::DOUBLE AS mean, 0.0::DOUBLE AS min_val, 60.0::DOUBLE AS min_pct, 1.0::DOUBLE AS max_val, 40.0::DOUBLE AS max_pct, true AS looks_binary FROM orders
    UNION ALL SELECT o_orderkey, 'AGE', (o_custkey % 90)::DOUBLE + 0.5, 10.0, 1.0, 99.0, 2.0, false FROM orders""")
def report_summary_statistics(spark, sf_dir):
    return T.summary_statistics(_fit_reports(spark, sf_dir))


@query("""SELECT 'p' || c_nationkey AS predictor, 'equal:' || o_orderkey AS "constraint", CASE WHEN o_orderkey % 4 <> 0 THEN (o_orderkey % 9) + 0.5::DOUBLE END AS chi2_diff, CASE WHEN o_orderkey % 4 <> 0 THEN 2 END AS df,
    CASE WHEN o_orderkey % 4 <> 0 THEN (o_orderkey % 9) / 100.0::DOUBLE END AS p_value, CASE WHEN o_orderkey % 4 = 0 THEN '—' WHEN o_orderkey % 9 = 0 THEN '***' WHEN o_orderkey % 9 < 5 THEN '*' ELSE 'ns' END AS sig, o_orderkey % 4 <> 0 AND o_orderkey % 9 < 5 AS significant
    FROM orders JOIN customer ON c_custkey = o_custkey""")
def contrast_summary(spark, sf_dir):
    """Every fourth planned contrast has no report."""
    k = F.col("source")
    start = F.instr("text", "Chi-Square Test for Difference Testing")
    head, part = F.expr("substring(text, 1, instr(text, 'Chi-Square Test for Difference Testing') - 1)"), F.expr("substring(text, instr(text, 'Chi-Square Test for Difference Testing'))")
    d = (k % 9).cast("string")
    compact = F.concat(head, F.lit("DIFFTEST\n  Value  DF  P-Value\n  "), d, F.lit(".5  2  0.0"), d, F.lit("\n"))
    older = F.concat(head, F.upper(part))
    reports = _fit_reports(spark, sf_dir).filter(start > 0).withColumn("text", F.when(k % 3 == 0, compact).when(k % 3 == 1, older).otherwise(F.col("text")))
    nation = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    planned = table(spark, sf_dir, "orders").join(nation, "o_custkey").select(
        F.col("o_orderkey").alias("source"), F.concat(F.lit("p"), "c_nationkey").alias("predictor"), F.concat(F.lit("equal:"), "o_orderkey").alias("constraint")
    )
    return T.difference_tests(reports.filter("source % 4 <> 0").select("source", "text"), planned)


# ------------------------------------------------------------------ tests and centiles


@query("""WITH t AS (SELECT l_linenumber, count(*) FILTER (l_returnflag = 'R' AND l_discount > 0.05) AS a, count(*) FILTER (l_returnflag = 'R' AND l_discount <= 0.05) AS b,
    count(*) FILTER (l_returnflag <> 'R' AND l_discount > 0.05) AS c, count(*) FILTER (l_returnflag <> 'R' AND l_discount <= 0.05) AS d FROM lineitem GROUP BY 1),
    w AS (SELECT t.*, k, lgamma(a+b+1) + lgamma(c+d+1) + lgamma(a+c+1) + lgamma(b+d+1) - lgamma(a+b+c+d+1) - lgamma(k+1) - lgamma(a+b-k+1) - lgamma(a+c-k+1) - lgamma(d-a+k+1) AS lp FROM t, range(0, 200000) r(k) WHERE k >= a - d AND k <= least(a+b, a+c)),
    o AS (SELECT l_linenumber, lp AS lo FROM w WHERE k = a)
    SELECT l_linenumber, any_value(a) AS n_a, any_value(b) AS n_b, (round(any_value(a*d/(b*c)), 6) + 0.0) AS odds_ratio, (round(sum(exp(lp)) FILTER (lp <= lo + 1e-7), 5) + 0.0) AS p_value FROM w JOIN o USING (l_linenumber) GROUP BY 1""")
def fisher_exact_by_group(spark, sf_dir):
    flag, cut = F.col("l_returnflag") == "R", F.col("l_discount") > 0.05
    t = table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(
        F.count_if(flag & cut).alias("a"), F.count_if(flag & ~cut).alias("b"), F.count_if(~flag & cut).alias("c"), F.count_if(~flag & ~cut).alias("d")
    )
    cols = [F.col(c) for c in "abcd"]
    return t.select("l_linenumber", F.col("a").alias("n_a"), F.col("b").alias("n_b"), r6(N.odds_ratio(*cols)).alias("odds_ratio"), r6(N.fisher_exact(*cols), 5).alias("p_value"))


@query()
def significance_pvalues(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("value") / 20).alias("x"))
    return e.select("event_id", r6(N.z_pvalue("x")).alias("p_z"), r6(N.chi2_pvalue("x")).alias("p_chi2"), r6(N.t_pvalue("x", F.lit(12.0))).alias("p_t"))


@query()
def birth_weight_centiles(spark, sf_dir):
    """Births and coefficient rows derived from customers and parts."""
    c = table(spark, sf_dir, "customer")
    births = c.select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, "male").otherwise("female").alias("sex"),
        (F.lit(160) + F.col("c_custkey") % 150).cast("int").alias("gest_days"), (F.lit(0.5) + (F.col("c_acctbal") + 1000) / 3000).alias("weight_kg"),
    )
    p = table(spark, sf_dir, "part")
    coef = p.groupBy((F.lit(231) + F.col("p_partkey") % 70).cast("int").alias("gest_days")).agg(F.avg("p_size").alias("size")).select(
        F.explode(F.array(F.lit("male"), F.lit("female"))).alias("sex"), "gest_days", (F.lit(2.0) + F.col("size") / 50).alias("mu"), F.lit(0.4).alias("sigma"),
        (F.lit(0.9) + F.col("size") / 500).alias("nu"), F.lit(8.0).alias("tau"),
    )
    out = growth.birth_weight_centiles(births, coef)
    return out.select("id", "gest_days", r6("centile").alias("centile"), r6("zscore", 4).alias("zscore"))


# ------------------------------------------------------------------ checks


@query("""WITH c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 100 = 1 THEN o_totalprice + 0.01 WHEN o_orderkey % 100 = 2 THEN o_totalprice + 1e-12 ELSE o_totalprice END AS o_totalprice,
    CASE WHEN o_orderkey % 150 = 3 THEN NULL ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 200 <> 5), r AS (SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderkey % 300 <> 7)
    SELECT o_orderkey, 'o_totalprice' AS "column", CASE WHEN c.o_orderkey IS NULL THEN 'missing' WHEN r.o_orderkey IS NULL THEN 'extra' ELSE 'differs' END AS status FROM r FULL JOIN c USING (o_orderkey)
    WHERE c.o_totalprice IS NULL OR r.o_totalprice IS NULL OR abs(r.o_totalprice - c.o_totalprice) > 1e-9
    UNION ALL SELECT o_orderkey, 'o_orderstatus', CASE WHEN c.o_orderkey IS NULL THEN 'missing' WHEN r.o_orderkey IS NULL THEN 'extra' ELSE 'differs' END FROM r FULL JOIN c USING (o_orderkey)
    WHERE c.o_orderkey IS NULL OR r.o_orderkey IS NULL OR r.o_orderstatus IS DISTINCT FROM c.o_orderstatus""")
def table_differences(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    k = F.col("o_orderkey")
    cur = o.filter(k % 200 != 5).withColumn(
        "o_totalprice", F.when(k % 100 == 1, F.col("o_totalprice") + 0.01).when(k % 100 == 2, F.col("o_totalprice") + 1e-12).otherwise(F.col("o_totalprice"))
    ).withColumn("o_orderstatus", F.when(k % 150 != 3, F.col("o_orderstatus")))
    return Q.diff_tables(o.filter(k % 300 != 7), cur, ["o_orderkey"]).select("o_orderkey", "column", "status")


@query("""WITH o AS (SELECT o_orderstatus AS section, o_orderpriority AS label, round(avg(o_totalprice), 2) AS value FROM orders GROUP BY ALL), x AS (SELECT o_orderstatus AS section, o_orderpriority AS label, round(median(o_totalprice), 3) AS expected FROM orders GROUP BY ALL UNION ALL SELECT 'none', 'none', 1.0)
    SELECT section, label, expected, value AS observed, 1500.0::DOUBLE AS tol, coalesce(abs(expected - value) <= 1500, false) AS ok, 'table' AS source FROM x LEFT JOIN o USING (section, label)""")
def expectation_report(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("section"), F.col("o_orderpriority").alias("label"))
    observed = o.agg(F.round(F.avg("o_totalprice"), 2).alias("value"))
    extra = F.when(F.col("one"), "none")
    expected = o.agg(F.round(F.median("o_totalprice"), 3).alias("expected")).unionByName(
        spark.range(1).select(F.lit(True).alias("one")).select(extra.alias("section"), extra.alias("label"), F.lit(1.0).alias("expected"))
    )
    return Q.expectations(observed, expected.withColumn("tol", F.lit(1500.0)).withColumn("source", F.lit("table")))


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, min(l_quantity) AS q FROM lineitem WHERE l_linenumber < 6 GROUP BY ALL), p AS (SELECT l_orderkey, l_linenumber, min(l_quantity + CASE WHEN l_orderkey % 10 = 1 THEN 0.5 WHEN l_orderkey % 10 = 2 THEN 0.001 ELSE 0 END) AS q FROM lineitem WHERE l_orderkey % 7 <> 3 AND l_linenumber <> 2 GROUP BY ALL),
    f AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey % 7 <> 3)
    SELECT l_orderkey, l_linenumber, CASE WHEN t.q IS NULL THEN 'unlisted' WHEN f.l_orderkey IS NULL THEN 'missing_file' WHEN p.q IS NULL THEN 'not_found' WHEN abs(t.q - p.q) <= 0.002 THEN 'ok' ELSE 'mismatch' END AS status
    FROM t FULL JOIN p USING (l_orderkey, l_linenumber) LEFT JOIN f USING (l_orderkey)""")
def coefficient_crosscheck(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    k = F.col("l_orderkey")
    keys = ["l_orderkey", "l_linenumber"]
    t = line.filter("l_linenumber < 6").groupBy(*keys).agg(F.min("l_quantity").alias("q"))
    shift = F.when(k % 10 == 1, 0.5).when(k % 10 == 2, 0.001).otherwise(0.0)
    p = line.filter((k % 7 != 3) & (F.col("l_linenumber") != 2)).groupBy(*keys).agg(F.min("l_quantity").alias("m")).select(*keys, (F.col("m") + shift).alias("q"))
    return Q.crosscheck(t, p, keys, ["q"], 0.002, line.filter(k % 7 != 3), ["l_orderkey"])


@query(" UNION ALL ".join(f"SELECT '{c}' AS variable, count(*) FILTER ({e} <> -999) AS n, count(*) FILTER ({e} = -999) AS n_sentinel, min({e}) FILTER ({e} <> -999)::DOUBLE AS min, max({e}) FILTER ({e} <> -999)::DOUBLE AS max, {r(f'avg({e}) FILTER ({e} <> -999)')} AS mean FROM lineitem"
                          for c, e in (("q", "(CASE WHEN l_quantity < 4 THEN -999 ELSE l_quantity END)"), ("d", "(CASE WHEN l_linenumber = 7 THEN -999 ELSE l_discount END)"))))
def sentinel_profile(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_quantity") < 4, -999).otherwise(F.col("l_quantity")).alias("q"), F.when(F.col("l_linenumber") == 7, -999).otherwise(F.col("l_discount")).alias("d")
    )
    return Q.sentinel_profile(line, ["q", "d"]).withColumn("mean", r6("mean"))


@query("""WITH b AS (SELECT c_custkey, c_acctbal + CASE WHEN c_custkey = 77 THEN 0.25 ELSE 0 END AS bal, CASE WHEN c_custkey % 50 <> 4 THEN c_nationkey END AS nat FROM customer)
    SELECT 'bal' AS variable, count(c_acctbal) AS n_a, count(bal) AS n_b, count(*) FILTER ((c_acctbal IS NULL) <> (bal IS NULL)) AS null_conflicts, (round(max(abs(c_acctbal - bal)), 6) + 0.0) AS max_diff, false AS ok FROM customer JOIN b USING (c_custkey)
    UNION ALL SELECT 'nat', count(c_nationkey), count(nat), count(*) FILTER ((c_nationkey IS NULL) <> (nat IS NULL)), max(abs(c_nationkey - nat))::DOUBLE, false FROM customer JOIN b USING (c_custkey)""")
def covariate_agreement(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    a = c.select("c_custkey", F.col("c_acctbal").alias("bal"), F.col("c_nationkey").alias("nat"))
    k = F.col("c_custkey")
    b = c.select("c_custkey", (F.col("c_acctbal") + F.when(k == 77, 0.25).otherwise(0.0)).alias("bal"), F.when(k % 50 != 4, F.col("c_nationkey")).alias("nat"))
    return Q.column_agreement(a, b, "c_custkey", ["bal", "nat"]).withColumn("max_diff", r6("max_diff"))


@query("""SELECT 'rows' AS "check", count(*) AS n FROM events UNION ALL SELECT 'distinct_keys', count(DISTINCT user_id) FROM events UNION ALL SELECT 'repeated_keys', count(*) FROM (SELECT user_id FROM events GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'not_in_reference', count(DISTINCT user_id) FROM events WHERE user_id NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'missing_from_table', count(DISTINCT o_custkey) FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events)""")
def key_report(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"))
    return Q.key_report(e, "id", table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")))


@query("""WITH a AS (SELECT o_orderpriority AS label, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_orderpriority AS label, count(*) AS n FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority <> '5-LOW' GROUP BY 1)
    SELECT label, coalesce(a.n, 0) AS in_spec, coalesce(b.n, 0) AS in_table, coalesce(a.n, 0) = coalesce(b.n, 0) AS ok FROM a FULL JOIN b USING (label)""")
def spec_sizes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("label"), "o_orderstatus")
    return Q.sizes_match(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'O' and label <> '5-LOW'"))
