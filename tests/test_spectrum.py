import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.operators import spectrum as D


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.fixture
def structured(rng):
    basis = rng.normal(size=(3, 8))
    return unit(rng.normal(size=(60, 3)) @ basis + 0.3 * rng.normal(size=(60, 8)))


def test_eigenvalues_of_the_similarity_matrix(make_items, structured):
    got = [r["eigenvalue"] for r in D.eigenvalues(make_items(structured)).orderBy("rank").collect()]
    want = np.linalg.eigvalsh(structured @ structured.T)[::-1]
    assert np.allclose(got, want[:8], atol=1e-9) and np.allclose(want[8:], 0, atol=1e-9)


@pytest.mark.parametrize("n", [5, 8, 60, 1000])
def test_broken_stick_and_elbow_with_an_implied_zero_tail(spark, rng, n):
    d = min(n, 8)
    values = np.sort(rng.random(d) ** 4)[::-1]
    full = np.concatenate([values, np.zeros(n - d)])
    frame = spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(values)], "rank int, eigenvalue double")
    expected = np.array([sum(1 / j for j in range(k, n + 1)) for k in range(1, n + 1)]) / n
    assert D.broken_stick(frame, n).first()["k"] == max(1, int((full / full.sum() > expected).sum()))
    x = np.arange(1, n + 1)
    far = np.abs((full[-1] - full[0]) * x - (n - 1) * full + n * full[0] - full[-1])
    assert D.elbow(frame, n).first()["k"] == int(np.round(far / math.hypot(full[-1] - full[0], n - 1), 9).argmax()) + 1


def test_elbow_of_two_points(spark):
    frame = spark.createDataFrame([(1, 2.0), (2, 1.0)], "rank int, eigenvalue double")
    assert D.elbow(frame, 2).first()["k"] == 2


def test_ppca_bic(make_items, structured):
    n, d = structured.shape
    eig = np.linalg.svd(structured - structured.mean(axis=0), compute_uv=False) ** 2 / (n - 1)
    scores = {}
    for r in D.ppca_bic(D.covariance_spectrum(make_items(structured)), 1, 6).collect():
        k = r["k"]
        noise = max(eig[k:].mean(), 1e-8)
        like = -0.5 * n * (d * math.log(2 * math.pi) + (d - k) * math.log(noise) + np.log(eig[:k]).sum() + d)
        free = d * k - k * (k - 1) // 2 + d + 1
        scores[k] = -2 * like + free * math.log(n)
        assert r["bic"] == pytest.approx(scores[k])
    assert D.best_bic(D.ppca_bic(D.covariance_spectrum(make_items(structured)), 1, 6)).first()["k"] == min(scores, key=scores.get)


def test_parallel_analysis_replays_the_sign_flips(make_items, structured):
    items = make_items(structured)
    h = {r["id"]: r["h"] for r in items.select("id", F.xxhash64("id").alias("h")).collect()}
    hashes = np.array([h[i] for i in range(60)])
    null = []
    for rep in range(12):
        z = structured * D.hashed_signs(hashes, rep, 8)
        null.append(np.linalg.eigvalsh(z.T @ z)[::-1])
    got = {r["rank"]: r for r in D.parallel_analysis(items, reps=12).collect()}
    cut = np.percentile(np.array(null), 95, axis=0)
    assert np.allclose([got[i + 1]["cutoff"] for i in range(8)], cut)
    observed = np.linalg.eigvalsh(structured @ structured.T)[::-1][:8]
    assert [got[i + 1]["keep"] for i in range(8)] == (observed > cut).tolist() and got[1]["keep"]


def varimax(phi, q=20, tol=1e-7):
    p, k = phi.shape
    rot, d = np.eye(k), 0.0
    for _ in range(q):
        old, lam = d, phi @ rot
        u, s, vt = np.linalg.svd(phi.T @ (lam**3 - lam @ np.diag((lam**2).sum(axis=0)) / p))
        rot, d = u @ vt, s.sum()
        if old and d - old < tol:
            break
    return phi @ rot


def test_loadings_and_varimax(make_items, structured):
    got = np.array([r["loadings"] for r in D.factor_loadings(make_items(structured), 3).orderBy("id").collect()])
    values, vecs = np.linalg.eigh(structured @ structured.T)
    plain = vecs[:, ::-1][:, :3] * np.sqrt(values[::-1][:3])
    signs = np.sign((plain * np.array([r["loadings"] for r in D.factor_loadings(make_items(structured), 3, rotate=False).orderBy("id").collect()])).sum(axis=0))
    assert np.allclose(got, varimax(plain * signs), atol=1e-6)
    assert np.allclose(got @ got.T, plain @ plain.T, atol=1e-8)


def test_omega_congruence_rv_spearman(spark, rng):
    a, b = rng.normal(size=(20, 2)) * 0.4, rng.normal(size=(20, 2))
    a[3:6, 0] = 0.25  # ties
    long = lambda m: spark.createDataFrame([(i, f, float(m[i, f]), "all" if i > 1 else "two") for i in range(20) for f in range(2)], "id int, factor int, loading double, set string")
    om = {r["set"]: r for r in D.omega(long(a)).collect()}
    lam = a[2:, int(np.abs(a[2:]).mean(axis=0).argmax())]
    assert om["all"]["omega"] == pytest.approx(lam.sum() ** 2 / (lam.sum() ** 2 + (1 - lam**2).sum()))
    assert om["two"]["omega"] is None
    phi = {(r["factor_a"], r["factor_b"]): r["phi"] for r in D.congruence(long(a), long(b)).collect()}
    assert phi[0, 1] == pytest.approx((a[:, 0] @ b[:, 1]) / math.sqrt((a[:, 0] @ a[:, 0]) * (b[:, 1] @ b[:, 1])))
    import pandas as pd

    rho = {(r["factor_a"], r["factor_b"]): r["rho"] for r in D.spearman_matrix(long(a), long(b)).collect()}
    for i in range(2):
        for j in range(2):
            ra, rb = (pd.Series(np.abs(m)).round(9).rank() for m in (a[:, i], b[:, j]))
            assert rho[i, j] == pytest.approx(ra.corr(rb))
    s, t = a @ a.T, b @ b.T
    grid = lambda m: spark.createDataFrame([(i, j, float(m[i, j])) for i in range(20) for j in range(20)], "i int, j int, value double")
    s0, t0 = s - s.mean(), t - t.mean()
    assert D.rv_coefficient(grid(s), grid(t)).first()["rv"] == pytest.approx((s0 * t0).sum() / math.sqrt((s0**2).sum() * (t0**2).sum()))


def test_bootstrap_finds_the_true_rank_stable(make_items, rng):
    basis = np.linalg.qr(rng.normal(size=(10, 2)))[0].T
    group = rng.integers(0, 2, size=200)
    x = unit(basis[group] * rng.uniform(0.8, 1.2, size=(200, 1)) + 0.05 * rng.normal(size=(200, 10)))
    out = D.bootstrap_stability(make_items(x), 2, reps=8).collect()
    assert all(r["stable"] for r in out) and min(r["median_phi"] for r in out) > 0.99


def test_hashed_draws_look_random():
    h = np.arange(20000, dtype=np.int64) * 7919
    counts = D.hashed_multiplicity(h, 3)
    assert counts.mean() == pytest.approx(1, abs=0.03) and (counts == 1).mean() == pytest.approx(math.exp(-1), abs=0.02)
    assert abs(D.hashed_signs(h, 1, 4).mean()) < 0.02


def test_one_se_rule_and_final_choice(spark):
    rows = [(k, f, {1: 0.5, 2: 0.30, 3: 0.29, 4: 0.35}[k] + 0.02 * f) for k in range(1, 5) for f in range(3)]
    out = {r["k"]: r["chosen"] for r in D.one_se_rule(spark.createDataFrame(rows, "k int, fold int, mse double")).collect()}
    assert out == {1: False, 2: True, 3: False, 4: False}


def test_choice_among_selectors(spark):
    selectors = spark.createDataFrame([("a", 5, 19, 40), ("b", 0, 4, 40), ("c", 6, 6, 40), ("d", 2, 3, 40)], "g string, k_parallel int, k_cross int, n int")
    stable = [("a", k, k <= 3) for k in range(1, 40)] + [("b", 4, True), ("d", 2, True), ("d", 3, True)]
    got = {r["g"]: r["k"] for r in D.final_rank(selectors, spark.createDataFrame(stable, "g string, k int, stable boolean"), ["g"]).collect()}
    assert got == {"a": 3, "b": 4, "c": 1, "d": 2}  # 2.5 rounds half to even
    votes = spark.createDataFrame([(g, i, k) for g, ks in (("x", (4, 2, 2)), ("y", (4, 2, 3)), ("z", (5, 5, 1))) for i, k in enumerate(ks)], "g string, place int, k int")
    assert {r["g"]: r["k"] for r in D.majority_rank(votes, ["g"]).collect()} == {"x": 2, "y": 4, "z": 5}


@pytest.fixture
def ranked(rng):
    """300 vectors of four directions in eight dimensions, and little else."""
    return rng.normal(size=(300, 4)) @ np.linalg.qr(rng.normal(size=(8, 4)))[0].T + 0.05 * rng.normal(size=(300, 8))


def test_held_out_share_is_that_of_each_row():
    for fold in range(6):
        held = D.held_out(fold)
        assert (held == held.T).all() and (held.sum(axis=1) == 3).all()
    assert (sum(D.held_out(f).astype(int) for f in range(6)) <= 1).all()


@pytest.mark.parametrize("k", [1, 3])
def test_masked_fit_solves_the_normal_equations(make_items, ranked, k):
    of = np.arange(300) % 20
    items = make_items(ranked)
    grams = D.class_grams(items, F.col("id") % 20)
    maps = D.masked_maps(grams, k, fold=2, iterations=400)
    u, s = np.einsum("id,idk->ik", ranked, maps[of]), ranked @ ranked.T
    train = ~D.held_out(2)[of][:, of]
    # each row is the least-squares answer to the others', over the entries that are left
    for i in (0, 7, 19, 123):
        want = np.linalg.lstsq(u[train[i]], s[i, train[i]], rcond=None)[0]
        assert np.allclose(u[i], want, atol=1e-4)
    other = train & ~np.eye(300, dtype=bool)
    base = np.linalg.eigh(s)
    top = base[1][:, ::-1][:, :k] * np.sqrt(base[0][::-1][:k])
    # no worse on these entries than the best fit to the whole matrix
    assert ((s - u @ u.T) ** 2)[other].mean() <= ((s - top @ top.T) ** 2)[other].mean() * 1.001


def test_errors_are_those_of_the_held_out_pairs(make_items, ranked):
    of = np.arange(300) % 20
    items = make_items(ranked)
    grams = D.class_grams(items, F.col("id") % 20)
    fits = {(k, fold): D.masked_maps(grams, k, fold) for k in (1, 4) for fold in (0, 5)}
    for k, fold, mse in D.held_out_errors(items, F.col("id") % 20, grams, fits):
        u = np.einsum("id,idk->ik", ranked, fits[(k, fold)][of])
        held = D.held_out(fold)[of][:, of] & ~np.eye(300, dtype=bool)
        assert mse == pytest.approx(((ranked @ ranked.T - u @ u.T) ** 2)[held].mean(), rel=1e-6)


def test_cross_validation_shows_the_rank(make_items, rng):
    # four directions, and noise of many others
    x = rng.normal(size=(300, 4)) @ np.linalg.qr(rng.normal(size=(120, 4)))[0].T + 0.1 * rng.normal(size=(300, 120))
    out = {r["k"]: r for r in D.cross_validated_rank(make_items(x), k_max=7).collect()}
    error = [out[k]["mean_mse"] for k in range(1, 8)]
    assert sum(r["chosen"] for r in out.values()) == 1 and not any(out[k]["chosen"] for k in (1, 2, 3))
    assert error[3] < error[2] / 50 and error[6] > 0.9 * error[3]


def test_principal_components(make_items, structured):
    got = np.array([r["vec"] for r in D.principal_components(make_items(structured), 3).orderBy("id").collect()])
    centered = structured - structured.mean(axis=0)
    axes = np.linalg.svd(centered, full_matrices=False)[2][:3].T
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(3)])
    assert np.allclose(got, centered @ axes, atol=1e-8)
