import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.operators import describe, ranking


def test_quantiles_of_a_dominant_group(spark, rng):
    sizes = {"hot": 900, "a": 7, "b": 1}
    rows = [(g, float(np.round(v, 1))) for g, n in sizes.items() for v in rng.normal(size=n)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {(r["g"], r["prob"]): r["quantile"] for r in ranking.exact_quantiles(df, ["g"], "v", probs).collect()}
    for g in sizes:
        values = [v for name, v in rows if name == g]
        for p in probs:
            assert got[g, p] == pytest.approx(np.quantile(values, p))


def test_exact_rank_without_keys(spark):
    df = spark.range(500).select(((F.col("id") * 37) % 500).alias("v"))
    assert sorted((r["v"] + 1 == r["rank"]) for r in ranking.exact_rank(df, [], ["v"]).collect()) == [True] * 500


def test_box_statistics_overall(spark, rng):
    values = np.concatenate([rng.normal(size=99), [50.0]])
    row = describe.box_stats(spark.createDataFrame([(float(v),) for v in values], "v double"), [], "v").first()
    q1, q2, q3 = np.quantile(values, [0.25, 0.5, 0.75])
    assert (row["q1"], row["median"], row["q3"]) == pytest.approx((q1, q2, q3))
    assert row["whisker_high"] == max(v for v in values if v <= q3 + 1.5 * (q3 - q1)) < 50


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_state_is_carried_across_chunks(spark, chunk):
    marks = [None, "a", None, None, None, None, None, "b", None, None]
    df = spark.createDataFrame([(s, i, m) for s in ("x", "y") for i, m in enumerate(marks)], "source string, line int, m string")
    got = [r["m"] for r in ranking.carry_forward(df, ["source"], "line", ["m"], chunk).filter("source = 'y'").orderBy("line").collect()]
    assert got == [None] + ["a"] * 6 + ["b"] * 3


def test_first_per_key_puts_nulls_last(spark):
    df = spark.createDataFrame([(1, None, 0), (1, 5.0, 2), (1, 5.0, 1), (2, None, 3)], "k int, age double, t int")
    got = {r["k"]: (r["age"], r["t"]) for r in ranking.earliest_record(df, "k", "age", "t").collect()}
    assert got == {1: (5.0, 1), 2: (None, 3)}


def test_top_k_limits_before_the_shuffle(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 3)
    plan = ranking.top_k(df, ["g"], [F.desc("id")], 2)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_widest_gap_spans_partitions(spark):
    values = [1.0, 2.0, 3.0, 10.0, 10.5, 17.5, None]
    row = ranking.widest_gap(spark.createDataFrame([(v,) for v in values], "v double"), "v").first()
    assert (row["low"], row["high"], row["gap"]) == (3.0, 10.0, 7.0)


def test_correlation_drops_constants_and_uses_complete_pairs(spark, rng):
    x = rng.normal(size=(50, 2)) + 1e6
    rows = [(float(a), float(a + b) if i % 5 else None, 4.0) for i, (a, b) in enumerate(x)]
    got = {(r["a"], r["b"]): r for r in describe.correlation_matrix(spark.createDataFrame(rows, "x double, y double, k double"), ["x", "y", "k"]).collect()}
    keep = [i for i in range(50) if i % 5]
    assert set(got) == {(a, b) for a in "xy" for b in "xy"}
    assert got["x", "y"]["r"] == pytest.approx(np.corrcoef(x[keep, 0], x[keep].sum(axis=1))[0, 1], abs=1e-6)


def test_bad_date_stops_the_job(spark):
    df = spark.createDataFrame([("01/31/2020",), ("2020-01-31",)], "d string")
    with pytest.raises(Exception, match="bad date"):
        df.select(describe.strict_date(F.col("d"))).collect()
    ok = spark.createDataFrame([("01/31/2020",)], "d string").select(describe.strict_date(F.col("d")).cast("string")).first()[0]
    assert ok == "2020-01-31"


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (0.25,), (0.499,), (0.5,), (1.0,), (1.7,), (-0.1,)], "v double")
    assert [r["n"] for r in describe.histogram(df, "v", 0.0, 1.0, 4).orderBy("bin").collect()] == [1, 2, 1, 2]
