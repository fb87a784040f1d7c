import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.operators import consensus as C
from concord.operators import linkage
from concord.operators.spectral import neighbour_edges, spectral_clusters
from concord.operators.spectrum import mix64


def coassoc(labels):
    return (labels[:, :, None] == labels[:, None, :]).mean(axis=0)


def hac(sim, k, linkage):
    """Plain agglomeration; ties to the smallest pair of cluster ids (their smallest members)."""
    groups = [[i] for i in range(len(sim))]
    reduce = {"average": np.mean, "single": np.max, "complete": np.min}[linkage]
    while len(groups) > k:
        best = max(
            ((round(reduce(sim[np.ix_(a, b)]), 9), -i, -j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        )
        i, j = -best[1], -best[2]
        groups[i] = sorted(groups[i] + groups[j])
        del groups[j]
        groups.sort()
    return {frozenset(g) for g in groups}


def as_partition(rows, column="cluster"):
    out = {}
    for r in rows:
        out.setdefault(r[column], set()).add(r["id"])
    return {frozenset(g) for g in out.values()}


def noisy_runs(rng, n, runs, k, flip):
    truth = rng.integers(0, k, size=n)
    labels = np.tile(truth, (runs, 1))
    change = rng.random(labels.shape) < flip
    labels[change] = rng.integers(0, k, size=change.sum())
    return labels


@pytest.fixture
def profile_frame(spark):
    return lambda labels: spark.createDataFrame([(i, [int(v) for v in labels[:, i]]) for i in range(labels.shape[1])], "id int, labels array<int>")


@pytest.mark.parametrize("linkage", ["average", "single", "complete"])
def test_cut_equals_plain_agglomeration(profile_frame, rng, monkeypatch, linkage):
    monkeypatch.setattr(C, "FINISH_CLUSTERS", 5)
    labels = noisy_runs(rng, 36, 41, 4, 0.35)
    got = as_partition(C.consensus_cut(profile_frame(labels), 4, linkage).collect())
    assert got == hac(coassoc(labels), 4, linkage)


def test_cut_does_not_depend_on_label_names(profile_frame, rng):
    labels = noisy_runs(rng, 30, 20, 3, 0.3)
    renamed = np.array([rng.permutation(3)[row] for row in labels])
    one, two = (as_partition(C.consensus_cut(profile_frame(x), 3).collect()) for x in (labels, renamed))
    assert one == two


def test_stability_and_validation(profile_frame, spark, rng):
    labels = noisy_runs(rng, 40, 15, 4, 0.3)
    co = coassoc(labels)
    cluster = np.array([0] * 15 + [1] * 14 + [2] * 10 + [3])  # the last is a singleton
    frame = spark.createDataFrame([(i, int(c)) for i, c in enumerate(cluster)], "id int, cluster int")
    got = {r["id"]: r["stability"] for r in C.item_stability(profile_frame(labels), frame).collect()}
    for i in range(40):
        mates = [j for j in range(40) if cluster[j] == cluster[i] and j != i]
        assert got[i] == pytest.approx(co[i, mates].mean() if mates else 1.0)
    v = C.consensus_validation(profile_frame(labels), frame).first()
    iu = np.triu_indices(40, 1)
    same = cluster[iu[0]] == cluster[iu[1]]
    assert v["within"] == pytest.approx(co[iu][same].mean())
    assert v["between"] == pytest.approx(co[iu][~same].mean())
    good = sum(1 for i in range(39) if round(got[i], 9) > 0.5)
    assert v["well_represented_pct"] == pytest.approx(100 * good / 40)
    pairs = {(r["id_a"], r["id_b"]): r["share"] for r in C.coassociation(profile_frame(labels), 0.5).collect()}
    assert pairs.keys() == {(i, j) for i, j in zip(*iu) if round(co[i, j], 9) >= 0.5}


def test_consensus_runs_equal_a_numpy_replay(make_items, spark, rng):
    x = np.concatenate([rng.normal(size=(15, 5)) + 3 * c for c in np.eye(5)[:3]])
    items = make_items(x)
    profiles, runs = C.consensus_runs(items, 3, 6, max_iter=40)
    got = {r["id"]: r["labels"] for r in profiles.collect()}
    inertia = {r["run_id"]: r["inertia"] for r in runs.collect()}
    h = {r["id"]: r["h"] for r in items.select("id", F.xxhash64("id").alias("h")).collect()}
    hashes = np.array([h[i] for i in range(len(x))]).view(np.uint64)
    for run in range(6):
        score = mix64(hashes ^ mix64(np.array([run], np.uint64))) >> np.uint64(1)
        centers = x[np.argsort(score)[:3]]
        for _ in range(40):
            d = ((x[:, None, :] - centers[None]) ** 2).sum(axis=2)
            label = d.argmin(axis=1)
            new = np.array([x[label == c].mean(axis=0) if (label == c).any() else centers[c] for c in range(3)])
            if np.abs(new - centers).max() <= 1e-9:
                break
            centers = new
        assert [got[i][run] for i in range(len(x))] == label.tolist()
        assert inertia[run] == pytest.approx(d.min(axis=1).sum())


def test_run_batches_give_the_same_labels(make_items, rng, monkeypatch):
    items = make_items(rng.normal(size=(40, 4)))
    whole = {r["id"]: r["labels"] for r in C.consensus_runs(items, 3, 5, 20)[0].collect()}
    monkeypatch.setattr(C, "MODEL_BYTES", 8 * 3 * 4 * 2)
    assert {r["id"]: r["labels"] for r in C.consensus_runs(items, 3, 5, 20)[0].collect()} == whole


def test_density_clusters_equal_brute_force(make_items, rng):
    x = np.concatenate([rng.normal(size=(12, 3)) * 0.15 + c for c in ([3, 0, 0], [0, 3, 0], [0, 0, 3])] + [rng.normal(size=(8, 3))])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.round(u @ u.T, 9) >= 0.985
    core = near.sum(axis=1) >= 4
    label = {i: i for i in range(len(x)) if core[i]}
    while True:
        new = {i: min(label[j] for j in label if near[i, j]) for i in label}
        if new == label:
            break
        label = new
    for i in range(len(x)):
        if not core[i]:
            options = [j for j in range(len(x)) if core[j] and near[i, j]]
            label[i] = label[min(options, key=lambda j: (-round(u[i] @ u[j], 9), j))] if options else -1
    got = {r["id"]: r["label"] for r in C.density_clusters(make_items(x), 0.985, 4).collect()}
    assert got == label and -1 in got.values()


def test_silhouette_matches_definition(make_items, rng):
    x = rng.normal(size=(30, 3))
    label = [int(v) for v in rng.integers(-1, 3, size=29)] + [7]  # 7 is a singleton
    got = {r["id"]: r["silhouette"] for r in C.silhouette(make_items(x, label=label)).collect()}
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    for i in range(30):
        if label[i] == -1:
            assert i not in got
            continue
        own = [j for j in range(30) if label[j] == label[i] and j != i]
        b = min(d[i, [j for j in range(30) if label[j] == o]].mean() for o in set(label) - {-1, label[i]})
        a = d[i, own].mean() if own else None
        assert got[i] == pytest.approx(0.0 if a is None else (b - a) / max(a, b), abs=1e-6)


def test_silhouettes_of_all_runs(make_items, profile_frame, rng):
    x = rng.normal(size=(25, 3))
    labels = rng.integers(0, 3, size=(4, 25))
    labels[0, 0] = 3  # a singleton
    got = {r["run_id"]: r["silhouette"] for r in C.run_silhouettes(make_items(x), profile_frame(labels)).collect()}
    for run in range(4):
        each = C.silhouette(make_items(x, label=[int(v) for v in labels[run]])).agg({"silhouette": "avg"}).first()[0]
        assert got[run] == pytest.approx(each, abs=1e-6)


def test_silhouette_of_one_cluster_is_null(make_items, rng):
    row = C.mean_silhouette(make_items(rng.normal(size=(5, 2)), label=[1] * 5)).first()
    assert row["silhouette"] is None


def test_guards():
    for k, n in ((1, 10), (10, 10), (11, 10)):
        with pytest.raises(ValueError):
            C.check_k(k, n)
    C.check_k(2, 3)


def test_strategies_find_the_blobs(make_items, spark):
    rng = np.random.default_rng(42)
    centers = rng.normal(size=(4, 768)) * 5
    x = np.concatenate([c + 0.1 * rng.normal(size=(5, 768)) for c in centers])
    items = make_items(x)
    truth = {frozenset(range(5 * c, 5 * c + 5)) for c in range(4)}
    consensus = C.cluster_items(items, "kmeans_consensus", k=4, runs=25).collect()
    assert as_partition(consensus, "label") == truth
    assert as_partition(C.cluster_items(items, "density", min_sim=0.9, min_points=3).collect(), "label") == truth
    concepts = items.filter("id % 5 = 0").select(F.col("id").cast("int").alias("label"), "vec")
    assert as_partition(C.cluster_items(items, "similarity", concepts=concepts).collect(), "label") == truth
    simple = C.cluster_items(items, "kmeans_simple", k=4, starts=6).collect()
    assert as_partition(simple, "label") == truth
    with pytest.raises(ValueError):
        C.cluster_items(items, "unknown")
    with pytest.raises(ValueError):
        C.cluster_items(items, "kmeans_simple", k=20)


def test_spectral_separates_blocks(make_items, rng):
    x = np.concatenate([rng.normal(size=(30, 3)) * 0.1 + [1, 0, 0], rng.normal(size=(15, 3)) * 0.3 + [0, 0, 1]])
    items = make_items(x)
    got = {r["id"]: r["label"] for r in spectral_clusters(neighbour_edges(items, 8), items.select("id"), k=2)[0].collect()}
    side = np.array([got[i] for i in range(45)])
    hits = (side[:30] == side[0]).sum() + (side[30:] == 1 - side[0]).sum()
    assert max(hits, 45 - hits) >= 40


def test_grid_choice_ranks_null_last(spark):
    rows = [(1, None, 0.9, 0.0), (2, 0.3, 0.1, 0.5), (3, 0.3, 0.1, 0.2), (4, 0.2, 0.8, 0.0)]
    assert C.select_grid(spark.createDataFrame(rows, "g int, validity double, silhouette double, noise_rate double")).first()["g"] == 3


def test_warm_start_restores_old_labels(make_items, spark, rng):
    x = np.concatenate([rng.normal(size=(10, 2)) + [5, 0], rng.normal(size=(10, 2)) - [5, 0]])
    label = [0] * 9 + [1] + [1] * 10  # one old item carries the "wrong" label
    every = make_items(x, label=label)
    old, new = every.filter("id % 2 = 1"), every.filter("id % 2 = 0").select("id", "vec")
    centroids = spark.createDataFrame([(0, [5.0, 0.0]), (1, [-5.0, 0.0])], "label int, vec array<double>")
    got = {r["id"]: r["label"] for r in C.extend_warm_start(old, new, centroids).collect()}
    assert got[9] == 1 and all(got[i] == (0 if i < 10 else 1) for i in range(0, 20, 2))


@pytest.mark.parametrize("min_share", [0.34, 0.75, 0.99, 1.0])
def test_banded_coassociation_is_exact(spark, rng, min_share):
    base = rng.integers(0, 4, size=(6, 12))
    labels = np.where(rng.random((120, 12)) < 0.2, rng.integers(0, 4, size=(120, 12)), base[rng.integers(0, 6, 120)])
    labels[7] = labels[8] = labels[9]
    df = spark.createDataFrame([(i, [int(v) for v in labels[i]]) for i in range(120)], "id long, labels array<int>")
    got = {(r["id_a"], r["id_b"]): r["share"] for r in C.coassociation(df, min_share).collect()}
    share = (labels[:, None] == labels[None]).mean(axis=2).round(9)
    want = {(i, j): share[i, j] for i in range(120) for j in range(i + 1, 120) if share[i, j] >= min_share}
    assert got == pytest.approx(want)


def test_bands_hold_every_run_and_leave_one_without_a_difference():
    assert C.run_bands(12, 0.75) == [(0, 3), (3, 3), (6, 3), (9, 3)]
    assert C.run_bands(10, 1.0) == [(0, 10)] and C.run_bands(10, 0.0) == [] and len(C.run_bands(1000, 0.75)) == 251
    assert sum(n for _, n in C.run_bands(1000, 0.75)) == 1000


def test_coassociation_forest_is_that_of_all_pairs(spark, rng):
    # many equal shares, groups of equal profiles, and items that share nothing with most others
    labels = rng.integers(0, 3, size=(150, 4))
    labels[100:] = labels[rng.integers(0, 40, 50)]
    labels[:6] = np.arange(24).reshape(6, 4) + 10
    profiles = spark.createDataFrame([(int(i), [int(v) for v in row]) for i, row in enumerate(rng.permutation(labels))], "id long, labels array<int>")
    want = {tuple(r) for r in C.spanning_forest(C.coassociation(profiles, 1e-9), profiles.select("id"))[0].collect()}
    assert {tuple(r) for r in C.coassociation_forest(profiles).collect()} == want
    assert len(want) == 150 - 1 - 6


def test_single_cut_writes_no_pairs(spark, rng, monkeypatch):
    # items of few profiles: the pairs of their copies are never listed
    monkeypatch.setattr(C, "coassociation", lambda *_: pytest.fail("lists pairs of items"))
    labels = rng.integers(0, 2, size=(300, 3))
    profiles = spark.createDataFrame([(i, [int(v) for v in row]) for i, row in enumerate(labels)], "id long, labels array<int>")
    got = C.consensus_cut(profiles, 2, "single").collect()
    assert len(got) == 300 and {r["cluster"] for r in got} == {0, 1}


def test_settled_runs_leave_the_iterations(spark, rng, make_items, monkeypatch):
    x = np.concatenate([rng.normal(size=(40, 3)), rng.normal(size=(40, 3)) + 2])
    items = make_items(x).persist()
    start = np.stack([x[[0, 50]], x[[1, 2]], x[[3, 60]]])
    alone = [C.lloyd(items, start[i : i + 1]) for i in range(3)]
    start[0] = alone[0][0][0]  # this run has nothing to do
    cells = []
    monkeypatch.setattr(C, "sub_batch", lambda n: cells.append(n) or 64)
    centers, inertia = C.lloyd(items, start)
    assert cells[0] == 6 and min(cells) < 6 and cells == sorted(cells, reverse=True)
    assert np.allclose(centers, np.concatenate([c for c, _ in alone])) and np.allclose(inertia, [v[0] for _, v in alone])


def test_blocks_of_sums_do_not_multiply_with_the_rows():
    copies = [-(-n // C._wide_block(n, 60, 12)) for n in (10_000, 100_000, 600_000)]
    assert max(copies) <= 20 and C._wide_block(600_000, 100_000, 12) == C.SUB_BATCH


def test_neighbour_slices_equal_rounded_similarities(rng, monkeypatch):
    """Single precision decides nothing near the bound: pairs just below, at and just above it, copies, zeros."""
    import pyarrow as pa

    from concord.functions.vectors import vectors
    from concord.operators import similarity as S

    base = rng.normal(size=64)
    base /= np.linalg.norm(base)
    other = rng.normal(size=64)
    other -= base * (other @ base)
    other /= np.linalg.norm(other)
    at = [0.36 + e for e in (-1e-6, -2e-9, -6e-10, -4e-10, 0.0, 4e-10, 6e-10, 2e-9, 1e-6)]
    x = np.vstack([rng.normal(size=(700, 64)), np.tile(base, (40, 1)), [c * base + np.sqrt(1 - c * c) * other for c in at], np.zeros((2, 64))])
    left = pa.table({"id": np.arange(len(x)), "vec": vectors(x)})
    want = S.sim_block(left, left) >= 0.36
    assert want[700, 740:749].tolist() == [False, False, False, True, True, True, True, True, True]
    exact = []
    plain = S.sim_matrix
    monkeypatch.setattr(S, "sim_matrix", lambda *a: (exact.append(1), plain(*a))[1])
    got = np.vstack([near for _, near in S.near_slices(left, left, 0.36)])
    # no whole product in double precision
    assert (got == want).all() and not exact
    copies = left.take(pa.array([740 + 4] * 300 + [700] * 300))
    assert (np.vstack([near for _, near in S.near_slices(copies, copies, 0.36)]) == (S.sim_block(copies, copies) >= 0.36)).all()


@pytest.mark.parametrize("kind", ["bands", "every"])
def test_coassociation_blocks_bound_the_pairs_of_a_task(spark, monkeypatch, kind):
    """All pairs of a group of like profiles may be returned, so its blocks are short."""
    rows = [(i, [0, 0, 0, i % 2]) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, labels array<int>")
    sizes = []
    plain = C.block_join

    def seen(left, right, kernel, schema, *args, **options):
        def bounded(key, lt, rt):
            assert lt.num_rows <= 400 and rt.num_rows <= 400
            return kernel(key, lt, rt)

        sizes.append(options.get("block_rows"))
        return plain(left, right, bounded, schema, *args, **options)

    assert C.PAIR_ROWS <= 2048
    monkeypatch.setattr(C, "PAIR_ROWS", 300)
    monkeypatch.setattr(C, "block_join", seen)
    out = C.coassociation(df, 0.75 if kind == "bands" else 0.0)
    assert out.count() == 900 * 899 // 2 and sizes == [300]


def test_items_around_one_profile_merge_in_few_rounds(spark, monkeypatch):
    # the nearest of all others is the first, so one merge a round was all there is
    rounds, merged = [], linkage._merged
    monkeypatch.setattr(linkage, "_merged", lambda *a: rounds.append(1) or merged(*a))
    monkeypatch.setattr(linkage, "FINISH_CLUSTERS", 10)
    monkeypatch.setattr(linkage, "TOP_CLUSTERS", 10)
    labels = np.concatenate([np.zeros((1, 40), dtype=int), np.eye(40, dtype=int), np.full((1, 40), 2), 2 + np.eye(40, dtype=int)])
    profiles = spark.createDataFrame([(i, [int(v) for v in row]) for i, row in enumerate(labels)], "id long, labels array<int>")
    got = {r["id"]: r["cluster"] for r in C.consensus_cut(profiles, 2).collect()}
    assert got == {i: int(i > 40) for i in range(82)}
    assert len(rounds) <= 2


def test_partial_sums_come_in_blocks_of_runs(spark, rng, make_items, monkeypatch):
    # a row per cluster of every run, of boxed numbers, was most of an iteration's time
    x = np.concatenate([rng.normal(size=(50, 4)), rng.normal(size=(50, 4)) + 2])
    items = make_items(x).repartition(3).persist()
    start = np.stack([x[rng.choice(100, 3, replace=False)] for _ in range(7)])
    whole = C.lloyd(items, start)
    monkeypatch.setattr(C, "SUM_VALUES", 20)
    centers, inertia = C.lloyd(items, start)
    assert np.allclose(centers, whole[0]) and np.allclose(inertia, whole[1])
    for run, c in enumerate(start):
        for _ in range(100):
            gap = ((x[:, None] - c[None]) ** 2).sum(axis=2)
            c = np.array([x[gap.argmin(axis=1) == j].mean(axis=0) if (gap.argmin(axis=1) == j).any() else c[j] for j in range(3)])
        assert np.allclose(c, centers[run]) and np.isclose(gap.min(axis=1).sum(), inertia[run])
