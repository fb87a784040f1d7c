"""Distribution functions in NumPy (no SciPy here) and their Arrow column forms."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Lanczos coefficients (g = 7) of the log-gamma function.
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def log_gamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=float) - 1.0
    series = np.full_like(x, LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], start=1):
        series = series + c / (x + i)
    t = x + 7.5
    return 0.5 * math.log(2 * math.pi) + (x + 0.5) * np.log(t) - t + np.log(series)


def erfc(x: np.ndarray) -> np.ndarray:
    """Power series near zero, continued fraction in the tail."""
    x = np.asarray(x, dtype=float)
    size = np.abs(x)
    near = np.minimum(size, 2.0)
    term = near.copy()
    total = near.copy()
    for n in range(1, 60):
        term = term * 2 * near * near / (2 * n + 1)
        total = total + term
    low = 1.0 - 2.0 / math.sqrt(math.pi) * np.exp(-near * near) * total
    far = np.maximum(size, 2.0)
    frac = far.copy()
    for n in range(120, 0, -1):
        frac = far + (n / 2.0) / frac
    high = np.exp(-far * far) / (math.sqrt(math.pi) * frac)
    out = np.where(size < 2.0, low, high)
    return np.where(x < 0, 2.0 - out, out)


def norm_cdf(z: np.ndarray) -> np.ndarray:
    return 0.5 * erfc(-np.asarray(z, dtype=float) / math.sqrt(2.0))


def norm_ppf(p: np.ndarray) -> np.ndarray:
    """Bisection-free inverse: Newton steps on the log scale from a logistic start."""
    p = np.asarray(p, dtype=float)
    q = np.minimum(p, 1 - p)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.sqrt(-2.0 * np.log(q))
        z = -(t - (2.30753 + 0.27061 * t) / (1.0 + t * (0.99229 + 0.04481 * t)))
        for _ in range(8):
            cdf = norm_cdf(z)
            pdf = np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)
            z = z - np.log(cdf / q) * cdf / pdf
        z = np.where(p == 0.5, 0.0, z)
    return np.where(p <= 0.5, z, -z)


def beta_inc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta by its continued fraction (modified Lentz)."""
    a, b, x = (v.astype(float) for v in np.broadcast_arrays(a, b, x))
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    tiny = 1e-300
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
        c = np.ones_like(y)
        d = 1 - (p + q) * y / (p + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d
        for m in range(1, 300):
            for num in (
                m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)),
                -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1)),
            ):
                d = 1 + num * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + num / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                h = h * d * c
            if np.all(np.abs(d * c - 1) < 1e-15):
                break
    value = np.where(y <= 0, 0.0, np.where(y >= 1, 1.0, front * h))
    return np.where(flip, 1 - value, value)


def t_cdf(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = (v.astype(float) for v in np.broadcast_arrays(t, df))
    tail = 0.5 * beta_inc(df / 2, np.full_like(df, 0.5), df / (df + t * t))
    return np.where(t > 0, 1 - tail, tail)


def p_z(z: np.ndarray) -> np.ndarray:
    """Two-sided p of a standard normal statistic."""
    return erfc(np.abs(np.asarray(z, dtype=float)) / math.sqrt(2.0))


def p_chi2_1(x: np.ndarray) -> np.ndarray:
    """Upper tail of chi-square with one degree of freedom."""
    return erfc(np.sqrt(np.maximum(np.asarray(x, dtype=float), 0.0) / 2.0))


def p_t(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = (v.astype(float) for v in np.broadcast_arrays(t, df))
    return beta_inc(df / 2, np.full_like(df, 0.5), df / (df + t * t))


def skew_t_cdf(y, mu, sigma, nu, tau) -> np.ndarray:
    """Skew-t type 3: two half t densities of scale sigma/nu and sigma*nu joined at mu."""
    y, mu, sigma, nu, tau = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(y, mu, sigma, nu, tau))
    z = (y - mu) / sigma
    weight = 1.0 / (1.0 + nu * nu)
    low = 2.0 * weight * t_cdf(np.minimum(z, 0.0) * nu, tau)
    high = weight + 2.0 * (1.0 - weight) * (t_cdf(np.maximum(z, 0.0) / nu, tau) - 0.5)
    return np.where(z < 0, low, high)


def _numpy(a: pa.Array) -> np.ndarray:
    return a.cast(pa.float64()).to_numpy(zero_copy_only=False)


def _out(x: np.ndarray) -> pa.Array:
    return pa.array(x, from_pandas=True)  # NaN -> null


@F.arrow_udf(T.DoubleType())
def z_pvalue(z: pa.Array) -> pa.Array:
    return _out(p_z(_numpy(z)))


@F.arrow_udf(T.DoubleType())
def chi2_pvalue(x: pa.Array) -> pa.Array:
    return _out(np.where(np.isnan(_numpy(x)), np.nan, p_chi2_1(_numpy(x))))


@F.arrow_udf(T.DoubleType())
def t_pvalue(t: pa.Array, df: pa.Array) -> pa.Array:
    return _out(p_t(_numpy(t), _numpy(df)))


@F.arrow_udf(T.DoubleType())
def normal_cdf(z: pa.Array) -> pa.Array:
    return _out(norm_cdf(_numpy(z)))


@F.arrow_udf(T.DoubleType())
def normal_quantile(p: pa.Array) -> pa.Array:
    return _out(norm_ppf(np.clip(_numpy(p), 1e-12, 1 - 1e-12)))


@F.arrow_udf(T.DoubleType())
def skew_t_centile(y: pa.Array, mu: pa.Array, sigma: pa.Array, nu: pa.Array, tau: pa.Array) -> pa.Array:
    return _out(skew_t_cdf(*[_numpy(v) for v in (y, mu, sigma, nu, tau)]))


@F.arrow_udf(T.DoubleType())
def tetrachoric(n11: pa.Array, n10: pa.Array, n01: pa.Array, n00: pa.Array) -> pa.Array:
    """Tetrachoric correlation of 2x2 counts, 0.5 added to all cells when one is empty.

    Solves P(X > h, Y > k; r) = p11 by bisection on r; the bivariate normal integral is a
    Gauss-Legendre sum of its derivative in r.
    """
    cells = np.stack([_numpy(v) for v in (n11, n10, n01, n00)])
    if not cells.shape[1]:
        return _out(np.zeros(0))
    cells = np.where((cells == 0).any(axis=0)[None, :], cells + 0.5, cells)
    p11, p10, p01, _ = cells / cells.sum(axis=0)
    px, py = p11 + p10, p11 + p01
    h, k = norm_ppf(1 - px), norm_ppf(1 - py)
    nodes, weights = np.polynomial.legendre.leggauss(48)

    def both(r: np.ndarray) -> np.ndarray:
        # substitute r = sin(theta): the integrand is smooth up to |r| = 1
        top = np.arcsin(r)
        theta = top[:, None] * (nodes[None, :] + 1) / 2
        s, c2 = np.sin(theta), np.cos(theta) ** 2
        hk = h[:, None] ** 2 + k[:, None] ** 2 - 2 * (h * k)[:, None] * s
        inner = np.exp(-hk / (2 * np.maximum(c2, 1e-300)))
        return px * py + (inner * weights[None, :]).sum(axis=1) * top / 2 / (2 * math.pi)

    low, high = np.full(len(h), -0.99999), np.full(len(h), 0.99999)
    for _ in range(50):
        mid = (low + high) / 2
        under = both(mid) < p11
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return _out((low + high) / 2)


def fisher_exact(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-sided Fisher p of the table ((a, b), (c, d)) by the ratio recurrence.

    Weights relative to the observed table grow or shrink by exact ratios; only tables
    within 40 standard deviations of the mode are visited. The others hold less than 1e-300
    together: they do not change p, and an observed one is answered by that bound.
    """
    a, b, c, d = (v.cast("double") for v in (a, b, c, d))
    row1, row2, col1 = a + b, c + d, a + c
    n = row1 + row2
    mean = row1 * col1 / n
    spread = 40 * F.sqrt(row1 * row2 * col1 * (n - col1) / (n * n * F.greatest(n - 1, F.lit(1.0)))) + 2
    low = F.ceil(F.greatest(F.lit(0.0), col1 - row2, mean - spread)).cast("long")
    high = F.floor(F.least(row1, col1, mean + spread)).cast("long")
    seen = a.cast("long")
    start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("all"), F.lit(0.0).alias("tail"))

    def walk(steps: Column, ratio) -> Column:
        def step(acc: Column, x: Column) -> Column:
            w = acc["w"] * ratio(x.cast("double"))
            return F.struct(
                w.alias("w"), (acc["all"] + w).alias("all"),
                (acc["tail"] + F.when(w <= 1 + 1e-7, w).otherwise(F.lit(0.0))).alias("tail"),
            )

        return F.aggregate(steps, start, step)

    up = walk(
        F.when(high > seen, F.sequence(seen + 1, high)).otherwise(F.array().cast("array<bigint>")),
        lambda x: (row1 - x + 1) * (col1 - x + 1) / (x * (row2 - col1 + x)),
    )
    down = walk(
        F.when(low < seen, F.sequence(seen - 1, low, F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>")),
        lambda x: (x + 1) * (row2 - col1 + x + 1) / ((row1 - x) * (col1 - x)),
    )
    p = (1 + up["tail"] + down["tail"]) / (1 + up["all"] + down["all"])
    return F.when(n.isNull() | (n == 0), F.lit(1.0)).when((a < low) | (a > high), F.lit(1e-300)).otherwise(F.least(p, F.lit(1.0)))


def odds_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """ad / bc, null when a denominator cell is empty."""
    return F.when((b * c) != 0, a * d / (b * c))
