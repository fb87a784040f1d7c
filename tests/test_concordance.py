import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.operators import concordance as L
from concord.operators import tables as J


def ari(a, b):
    pairs = list(itertools.combinations(range(len(a)), 2))
    both = sum(a[i] == a[j] and b[i] == b[j] for i, j in pairs)
    sa, sb = sum(a[i] == a[j] for i, j in pairs), sum(b[i] == b[j] for i, j in pairs)
    expected = sa * sb / len(pairs)
    return 1.0 if abs((sa + sb) / 2 - expected) < 1e-12 else (both - expected) / ((sa + sb) / 2 - expected)


def nmi(a, b):
    n = len(a)
    h = lambda x: -sum(c / n * math.log(c / n) for c in Counter(x).values())
    ca, cb = Counter(a), Counter(b)
    mi = sum(c / n * math.log(c * n / (ca[x] * cb[y])) for (x, y), c in Counter(zip(a, b)).items())
    return 1.0 if h(a) == 0 and h(b) == 0 else mi / ((h(a) + h(b)) / 2)


def cohen(a, b):
    n = len(a)
    po = sum(x == y for x, y in zip(a, b)) / n
    pe = sum(Counter(a)[k] * Counter(b)[k] for k in set(a) | set(b)) / n**2
    return (po - pe) / (1 - pe)


@pytest.fixture
def frame(spark):
    return lambda a, b: spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(zip(a, b))], "id int, a int, b int")


@pytest.mark.parametrize("seed", range(3))
def test_indices_equal_their_definitions(frame, seed):
    rng = np.random.default_rng(seed)
    a, b = ([int(v) for v in rng.integers(0, k, size=40)] for k in (3, 4))
    row = L.partition_agreement(L.cells(frame(a, b), "a", "b")).first()
    assert row["ari"] == pytest.approx(ari(a, b)) and row["nmi"] == pytest.approx(nmi(a, b))
    turned = L.partition_agreement(L.cells(frame(b, a), "a", "b")).first()
    assert turned["ari"] == pytest.approx(row["ari"]) and turned["nmi"] == pytest.approx(row["nmi"])
    same = L.partition_agreement(L.cells(frame(a, [2 - x for x in a]), "a", "b")).first()
    assert same["ari"] == pytest.approx(1) and same["nmi"] == pytest.approx(1)
    k = L.kappa(L.cells(frame(a, b), "a", "b")).first()
    assert k["kappa"] == pytest.approx(cohen(a, b)) and -1 <= k["kappa"] <= 1


def test_degenerate_partitions(frame):
    one = L.partition_agreement(L.cells(frame([1] * 5, [2] * 5), "a", "b")).first()
    assert (one["ari"], one["nmi"]) == (1.0, 1.0)
    flat = L.partition_agreement(L.cells(frame([1] * 6, [1, 1, 2, 2, 3, 3]), "a", "b")).first()
    assert flat["ari"] == pytest.approx(0) and flat["nmi"] == pytest.approx(0)


def test_kappa_drops_nulls_and_guards(frame):
    assert L.kappa(L.cells(frame([1, None, 2], [1, 2, None]), "a", "b")).first()["kappa"] is None
    assert L.kappa(L.cells(frame([1, 1, 1], [1, 1, 1]), "a", "b"), need_two_labels=True).first()["kappa"] is None
    part = L.kappa(L.cells(frame([1, 2, None, 2], [1, 1, 1, 2]), "a", "b")).first()
    assert part["n_pairs"] == 3 and part["kappa"] == pytest.approx(cohen([1, 2, 2], [1, 1, 2]))


@pytest.mark.parametrize("shape", [(4, 4), (3, 5), (5, 3), (6, 6)])
def test_relabelling_is_optimal(frame, spark, shape):
    rng = np.random.default_rng(sum(shape))
    for _ in range(3):
        n = rng.integers(1, 9, size=shape)
        rows = [(i, j, int(n[i, j])) for i in range(shape[0]) for j in range(shape[1])] + [(-1, 0, 50), (0, -1, 60)]
        out = L.optimal_mapping(spark.createDataFrame(rows, "a int, b int, n long")).collect()
        small, large = sorted(shape)
        flip = n if shape[0] <= shape[1] else n.T
        best = max(sum(flip[i, p[i]] for i in range(small)) for p in itertools.permutations(range(large), small))
        assert sum(r["n_matched"] for r in out) == best
        assert len({r["mapped_to"] for r in out}) == len(out) == small


def test_alignment_counts_excluded_items(spark):
    detected = spark.createDataFrame([("i1", 0), ("i2", 0), ("i3", 1), ("i4", 1)], "id string, label int")
    listed = spark.createDataFrame([("i1", 0, 0), ("i1", 1, 1), ("i2", 0, 0), ("i3", 1, 0)], "id string, label int, ord int")
    expanded = L.expand_labels(detected, listed)
    assert expanded.count() == 5
    row = L.alignment(expanded).first()
    assert (row["n_items_compared"], row["n_items_excluded"], row["n_detected_clusters"], row["n_reference_clusters"]) == (4, 1, 2, 2)
    assert row["ari"] == pytest.approx(ari([0, 1, 0, 1], [0, 0, 0, 1]))


@pytest.mark.parametrize("multi", [False, True])
def test_pair_counts_equal_enumeration(spark, multi):
    rng = np.random.default_rng(5)
    theory = [sorted({int(v) for v in rng.integers(0, 4, size=2 if multi and i % 2 else 1)}) for i in range(30)]
    emp, det = ([int(v) for v in rng.integers(0, 3, size=30)] for _ in range(2))
    kind = "array<int>" if multi else "int"
    df = spark.createDataFrame([(i, theory[i] if multi else theory[i][0], emp[i], det[i]) for i in range(30)], f"id int, theory {kind}, empirical int, detected int")
    out = (L.pair_intermediacy_any if multi else L.pair_intermediacy)(df).collect()
    got = {r["quantity"]: r["n"] if r["n"] is not None else r["share"] for r in out}
    rows = [(bool(set(theory[i]) & set(theory[j])), emp[i] == emp[j], det[i] == det[j]) for i, j in itertools.combinations(range(30), 2)]
    count = lambda f: sum(1 for t, e, d in rows if f(t, e, d))
    assert got["consensus_apart"] == count(lambda t, e, d: not t and not e)
    assert got["consensus_apart_kept"] == count(lambda t, e, d: not (t or e or d))
    assert got["consensus_together_kept"] == count(lambda t, e, d: t and e and d)
    assert got["disputed"] == count(lambda t, e, d: t != e)
    assert got["resolved_to_theory"] == count(lambda t, e, d: t != e and d == t)
    assert got["resolved_to_empirical"] == count(lambda t, e, d: t != e and d == e)
    assert got["jaccard_theory_detected"] == pytest.approx(count(lambda t, e, d: t and d) / count(lambda t, e, d: t or d))


def test_domain_recovery_counts_items_once(spark):
    detected = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "y")], "id string, label string")
    listed = spark.createDataFrame([("a", "x", 0), ("a", "y", 1), ("b", "x", 0), ("c", "y", 0)], "id string, label string, ord int")
    got = {r["domain"]: r for r in L.domain_accuracy(detected, listed).collect()}
    total = got["All items"]
    assert (total["items_any_factor"], total["recovered_any_factor"], total["pct_any_factor"]) == (3, 2, 66.7)
    assert (got["x"]["items_any_factor"], got["x"]["recovered_any_factor"], got["x"]["items_single_domain"]) == (2, 1, 1)
    assert got["x"]["pct_single_domain"] == 0.0


def test_label_precedence(spark):
    items = spark.createDataFrame([(i,) for i in range(7)], "id int")
    paired = spark.createDataFrame([(0, "A")], "id int, label string")
    near = [(1, "B", False, False), (2, "B", True, False), (3, "C", True, True), (4, "C", True, True), (5, "C", True, True), (6, "B", True, True)]
    nearest = spark.createDataFrame(near, "id int, domain string, redirected boolean, uc_flagged boolean")
    overrides = spark.createDataFrame([(1, "Z"), (3, "C"), (4, "D"), (5, None)], "id int, consensus string")
    got = {r["id"]: (r["label"], r["source"]) for r in J.assemble_labels(items, paired, nearest, overrides).collect()}
    assert got == {
        0: ("A", "cascade_pairing"), 1: ("B", "centroid_nearest_domain"), 2: ("B", "centroid_uc_redirected"),
        3: ("C", "expert_review_confirmed"), 4: ("D", "expert_review_override"), 5: ("C", "expert_review_no_consensus"), 6: ("B", "centroid_uc_redirected"),
    }


def test_repeated_id_across_sources_is_an_error(spark):
    one = spark.createDataFrame([(1, "x")], "id int, label string")
    with pytest.raises(ValueError):
        J.append_sources({"a": one, "b": one}, "id")


def test_fisher_table_pools_raters(spark):
    df = spark.createDataFrame([("p", "x", "x", "x"), ("p", "y", None, "x"), ("e", "x", "y", "y"), ("e", None, None, "x")], "grp string, r1 string, r2 string, ref string")
    row = L.fisher_table(df, ["r1", "r2"], "ref", "grp", ("p", "e")).first()
    assert (row["first_disagree"], row["first_agree"], row["second_disagree"], row["second_agree"]) == (1, 2, 1, 1)
    assert row["odds_ratio"] == pytest.approx(0.5) and row["p_value"] == pytest.approx(1.0)


@pytest.mark.parametrize("sizes", [(1, 32), (2, 40, 12), (15,)])
def test_pairs_of_items_of_any_number_of_labels(spark, sizes):
    rng = np.random.default_rng(7)
    theory = [sorted({int(v) for v in rng.integers(0, 90, size=sizes[i % len(sizes)])}) for i in range(60)]
    theory[3], theory[4] = [], theory[5]
    emp, det = ([None if v == 3 else int(v) for v in rng.integers(0, 4, size=60)] for _ in range(2))
    df = spark.createDataFrame([(i, theory[i], emp[i], det[i]) for i in range(60)], "id int, theory array<int>, empirical int, detected int")
    got = {r["quantity"]: r["n"] for r in L.pair_intermediacy_any(df.repartition(3)).collect()}
    same = lambda x, i, j: x[i] is not None and x[i] == x[j]
    rows = [(bool(set(theory[i]) & set(theory[j])), same(emp, i, j), same(det, i, j)) for i, j in itertools.combinations(range(60), 2)]
    assert got["together_theory"] == sum(t for t, _, _ in rows)
    assert got["consensus_together"] == sum(t and e for t, e, _ in rows)
    assert got["consensus_together_kept"] == sum(t and e and d for t, e, d in rows)
    assert got["resolved_to_theory"] == sum(t != e and d == t for t, e, d in rows)


def test_an_item_of_32_labels_meets_two_of_one(spark):
    rows = [(1, list(range(32)), 1, 1), (2, [0], 2, 2), (3, [31], 3, 3)]
    df = spark.createDataFrame(rows, "id int, theory array<int>, empirical int, detected int")
    assert {r["quantity"]: r["n"] for r in L.pair_intermediacy_any(df).collect()}["together_theory"] == 2


def test_arrays_meet_at_their_first_shared_label(spark, monkeypatch):
    # customers of separate regions: only those under one label are compared, and each pair once
    from concord.operators import concordance as L
    rng = np.random.default_rng(11)
    rows = [(i, [int(v) for v in rng.choice(60, int(rng.integers(3, 9)), replace=False) + 60 * (i % 9)], int(rng.integers(0, 3)), int(rng.integers(0, 3))) for i in range(120)]
    rows += [(200 + i, *rows[i][1:]) for i in range(15)]
    items = spark.createDataFrame(rows, "id long, theory array<long>, empirical long, detected long")
    want = sorted(map(tuple, L.pair_intermediacy_any(items).collect()), key=repr)
    monkeypatch.setattr(L, "SUBSET_LABELS", 4)
    keys, join = [], L.block_join
    monkeypatch.setattr(L, "block_join", lambda *a, **k: keys.append(k.get("keys")) or join(*a, **k))
    assert sorted(map(tuple, L.pair_intermediacy_any(items).collect()), key=repr) == want
    assert keys == [["label"], ["label"]]


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("block_rows", [8192, 40])
def test_rows_of_a_label_are_packed(spark, rng, monkeypatch, kind, block_rows):
    # rows went to each label twice over, with the labels before it as they are
    made = [(sorted(rng.choice(400, rng.integers(3, 14), replace=False) * 7 - 900), int(rng.integers(0, 3)), "xy"[rng.integers(0, 2)]) for _ in range(300)]
    made += [([0 * 7 - 900, 5000 + i, 6000 + i, 7000 + i], None, "x") for i in range(60)]
    name = (lambda v: f"s{v}") if kind == "string" else int
    rows = [([name(v) for v in t], e, d) for t, e, d in made]
    df = spark.createDataFrame(rows, f"theory array<{kind}>, empirical int, detected string")
    monkeypatch.setattr(L, "SUBSET_LABELS", 5)  # both forms, and pairs of one and the other
    monkeypatch.setattr(L, "PACK_ROWS", 50)
    monkeypatch.setattr(L, "PART_ENTRIES", 100)
    monkeypatch.setattr(L, "BLOCK_ROWS", block_rows)
    joined, join = [], L.block_join
    monkeypatch.setattr(L, "block_join", lambda *a, **k: joined.append(a[0].count()) or join(*a, **k))
    got = {r["quantity"]: r["n"] for r in L.pair_intermediacy_any(df).collect()}
    pairs = [(bool(set(a[0]) & set(b[0])), a[1] is not None and a[1] == b[1], a[2] == b[2]) for i, a in enumerate(rows) for b in rows[i + 1 :]]
    assert got["together_theory"] == sum(t for t, _, _ in pairs)
    assert got["consensus_together"] == sum(t and e for t, e, _ in pairs)
    assert got["consensus_together_kept"] == sum(t and e and d for t, e, d in pairs)
    assert got["resolved_to_theory"] == sum(t and not e and d or e and not t and not d for t, e, d in pairs)
    # only labels of more than a block are sent as they are
    assert (sum(joined) > 0) == (block_rows < 300)
