import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.functions import stats as N
from concord.operators.growth import birth_weight_centiles


def test_erfc_against_the_standard_library():
    x = np.concatenate([np.linspace(-6, 6, 481), [2.999999, 3.000001, 10.0, 26.0]])
    want = np.array([math.erfc(v) for v in x])
    assert np.allclose(N.erfc(x), want, rtol=1e-11, atol=1e-300)


def test_log_gamma_against_the_standard_library():
    x = np.array([0.5, 1.0, 1.5, 3.7, 12.0, 250.5])
    assert np.allclose(N.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)


def test_normal_quantile_inverts_the_cdf():
    p = np.array([1e-12, 1e-6, 0.025, 0.3, 0.5, 0.9, 0.999999])
    assert np.allclose(N.norm_cdf(N.norm_ppf(p)), p, rtol=1e-10)
    assert N.norm_ppf(np.array([0.975]))[0] == pytest.approx(1.959963984540054, abs=1e-12)


@pytest.mark.parametrize("t,df,p", [(2.228138852, 10, 0.05), (12.7062047364, 1, 0.05), (3.169272673, 10, 0.01), (1.959963985, 1e7, 0.05)])
def test_t_critical_values(t, df, p):
    assert N.p_t(np.array([t]), np.array([df]))[0] == pytest.approx(p, abs=1e-7)


def test_chi_square_and_z():
    assert N.p_chi2_1(np.array([3.841458820694124]))[0] == pytest.approx(0.05, abs=1e-12)
    assert N.p_z(np.array([-1.959963984540054]))[0] == pytest.approx(0.05, abs=1e-12)


def test_t_cdf_with_one_degree_is_cauchy():
    t = np.linspace(-5, 5, 21)
    assert np.allclose(N.t_cdf(t, 1.0), 0.5 + np.arctan(t) / math.pi, atol=1e-12)


def test_skew_t_is_a_cdf_and_symmetric_case_is_t():
    y = np.linspace(-4, 4, 81)
    assert np.allclose(N.skew_t_cdf(y, 0.0, 1.0, 1.0, 7.0), N.t_cdf(y, 7.0))
    c = N.skew_t_cdf(y, 0.3, 0.8, 1.4, 5.0)
    assert (np.diff(c) > 0).all() and 0 < c[0] < c[-1] < 1
    at = N.skew_t_cdf(np.array([0.3 - 1e-9, 0.3, 0.3 + 1e-9]), 0.3, 0.8, 1.4, 5.0)
    assert np.allclose(at, 1 / (1 + 1.4**2), atol=1e-8)


def test_tetrachoric_of_median_splits(spark):
    # both margins at one half: r = sin(pi / 2 * (4 p11 - 1))
    rows = [(a, 500 - a, 500 - a, a) for a in (250, 300, 400, 480, 100)]
    df = spark.createDataFrame(rows, "a long, b long, c long, d long").coalesce(1)
    got = [r[0] for r in df.select(N.tetrachoric("a", "b", "c", "d")).collect()]
    assert np.allclose(got, [math.sin(math.pi / 2 * (4 * a / 1000 - 1)) for a, *_ in rows], atol=1e-6)


def test_tetrachoric_with_an_empty_cell(spark):
    got = spark.createDataFrame([(10, 0, 5, 20)], "a long, b long, c long, d long").select(N.tetrachoric("a", "b", "c", "d")).first()[0]
    assert 0.8 < got < 1


def test_fisher_against_enumeration(spark):
    def exact(a, b, c, d):
        r1, c1, n = a + b, a + c, a + b + c + d
        weight = lambda k: math.comb(r1, k) * math.comb(n - r1, c1 - k)
        ks = range(max(0, c1 - (c + d)), min(r1, c1) + 1)
        return sum(weight(k) for k in ks if weight(k) <= weight(a) * (1 + 1e-7)) / math.comb(n, c1)

    tables = [(3, 1, 1, 3), (8, 2, 1, 5), (0, 5, 5, 0), (10, 0, 0, 0), (1, 9, 11, 3), (0, 0, 4, 6), (120, 80, 60, 140), (2, 0, 3, 7)]
    df = spark.createDataFrame(tables, "a long, b long, c long, d long").coalesce(1)
    got = [r[0] for r in df.select(N.fisher_exact(*[F.col(x) for x in "abcd"])).collect()]
    for t, p in zip(tables, got):
        assert p == pytest.approx(exact(*t), rel=1e-9), t


def test_fisher_far_from_the_mode_is_zero_not_an_error(spark):
    df = spark.createDataFrame([(10_000_000, 0, 0, 10_000_000)], "a long, b long, c long, d long")
    assert df.select(N.fisher_exact(*[F.col(x) for x in "abcd"])).first()[0] == pytest.approx(0.0, abs=1e-300)


def test_centiles_branch_by_day_and_clip(spark):
    births = spark.createDataFrame(
        [(1, "male", 200, 1.0), (2, "female", 280, 3.2), (3, "male", 150, 0.5), (4, "male", 301, 3.0), (5, None, 280, 3.0), (6, "male", 280, None),
         (7, "female", 280, 3.5), (8, "female", 230, 1.4), (9, "female", 280, 40.0)],
        "id int, sex string, gest_days int, weight_kg double",
    )
    coef = spark.createDataFrame([("female", 280, 3.2, 0.4, 1.0, 9.0), ("male", 280, 3.3, 0.4, 1.0, 9.0)], "sex string, gest_days int, mu double, sigma double, nu double, tau double")
    got = {r["id"]: r for r in birth_weight_centiles(births, coef).collect()}
    mean = -7.00303 + 1.325911 * math.sqrt(200 / 7) + 0.0571937
    z = (math.log(1.0) - mean) / math.sqrt(0.0373218)
    assert got[1]["centile"] == pytest.approx(0.5 * math.erfc(-z / math.sqrt(2))) and got[1]["zscore"] == pytest.approx(z, abs=1e-8)
    assert got[2]["centile"] == pytest.approx(0.5) and got[2]["zscore"] == pytest.approx(0.0, abs=1e-9)
    assert all(got[i]["centile"] is None and got[i]["zscore"] is None for i in (3, 4, 5, 6))
    assert got[7]["centile"] == pytest.approx(float(N.t_cdf(np.array([0.75]), np.array([9.0]))[0]))
    assert got[8]["centile"] is not None and math.isfinite(got[9]["zscore"])
