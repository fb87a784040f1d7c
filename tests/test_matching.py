import numpy as np
import pytest

from concord.operators import matching, similarity
from concord.operators.similarity import similar_pairs, topk_similar


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def greedy(sims, edges=None):
    pairs = sorted(((-round(sims[i, j], 9), i, j) for i in range(sims.shape[0]) for j in range(sims.shape[1]) if edges is None or edges[i, j]))
    left, right, out = set(), set(), {}
    for s, i, j in pairs:
        if i not in left and j not in right:
            left.add(i)
            right.add(j)
            out[i] = j
    return out


@pytest.mark.parametrize("shape,list_size,finish", [((70, 50), 3, 4), ((40, 90), 16, 64), ((30, 30), 2, 1)])
def test_match_sets_equals_the_greedy_loop(make_items, rng, monkeypatch, shape, list_size, finish):
    monkeypatch.setattr(matching, "FINISH_NODES", finish)
    a, b = unit(rng.normal(size=(shape[0], 8))), unit(rng.normal(size=(shape[1], 8)))
    got = {r["left_id"]: r["right_id"] for r in matching.match_sets(make_items(a), make_items(b), list_size=list_size).collect()}
    assert got == greedy(a @ b.T)
    assert len(set(got.values())) == len(got) == min(shape)


@pytest.mark.parametrize("finish", [1, 3, 64])
def test_copies_are_matched_together(make_items, rng, monkeypatch, finish):
    monkeypatch.setattr(matching, "FINISH_NODES", finish)
    base = unit(rng.normal(size=(12, 5)))
    a = base[np.concatenate([[0] * 20, rng.integers(0, 8, size=25)])]
    b = unit(rng.normal(size=(9, 5)))[np.concatenate([[2] * 15, rng.integers(0, 9, size=35)])]
    got = {r["left_id"]: r["right_id"] for r in matching.match_sets(make_items(a), make_items(b), list_size=2).collect()}
    assert got == greedy(a @ b.T)


def test_one_group_of_copies_needs_few_rounds(make_items, monkeypatch):
    monkeypatch.setattr(matching, "FINISH_NODES", 0)
    calls = []
    rounds = matching._mutual
    monkeypatch.setattr(matching, "_mutual", lambda *args: calls.append(1) or rounds(*args))
    copies = np.tile([[0.6, 0.8]], (200, 1))
    got = {r["left_id"]: r["right_id"] for r in matching.match_sets(make_items(copies), make_items(copies)).collect()}
    assert got == {i: i for i in range(200)} and len(calls) <= 2


def test_match_edges_rounds_equal_the_loop(spark, rng, monkeypatch):
    monkeypatch.setattr(matching, "FINISH_EDGES", 5)
    sims = np.round(rng.random((25, 25)), 2)  # many ties
    edges = sims > 0.6
    rows = [(i, j, float(sims[i, j])) for i in range(25) for j in range(25) if edges[i, j]]
    got = {r["left_id"]: r["right_id"] for r in matching.match_edges(spark.createDataFrame(rows, "left_id int, right_id int, sim double")).collect()}
    assert got == greedy(sims, edges)


def test_cascade_and_threshold_sweep(spark, rng, monkeypatch):
    monkeypatch.setattr(matching, "FINISH_NODES", 3)
    monkeypatch.setattr(matching, "FINISH_EDGES", 10)
    n, m = 20, 26
    title = [unit(rng.normal(size=(k, 3))) for k in (n, m)]
    text = [unit(rng.normal(size=(k, 10))) for k in (n, m)]
    frame = lambda t, x: spark.createDataFrame(
        [(i, t[i].tolist(), x[i].tolist()) for i in range(len(t))], "id int, title_vec array<double>, text_vec array<double>"
    )
    taus = [0.6, 0.75, 0.9]
    out = matching.cascade_match(frame(title[0], text[0]), frame(title[1], text[1]), taus).collect()
    st, sx = title[0] @ title[1].T, text[0] @ text[1].T
    base = None
    for tau in taus:
        locked = greedy(st, st >= tau)
        rest = np.ones_like(sx, dtype=bool)
        rest[list(locked.keys()), :] = False
        rest[:, list(locked.values())] = False
        expect = {(i, j, "title_lock") for i, j in locked.items()} | {(i, j, "full_text") for i, j in greedy(sx, rest).items()}
        rows = [r for r in out if r["tau"] == tau]
        assert {(r["left_id"], r["right_id"], r["stage"]) for r in rows} == expect
        for r in rows:
            assert r["sim_title"] == pytest.approx(st[r["left_id"], r["right_id"]], abs=1e-8)
            assert r["sim_decision"] == pytest.approx(r["sim_title"] if r["stage"] == "title_lock" else r["sim_fulltext"], abs=1e-8)
        if tau == 0.75:
            base = {(i, j) for i, j, _ in expect}
    sweep = {r["tau"]: r for r in matching.threshold_sensitivity(spark.createDataFrame(out), 0.75).collect()}
    for tau in taus:
        pairs = {(r["left_id"], r["right_id"]) for r in out if r["tau"] == tau}
        assert sweep[tau]["n_changed"] == len(pairs - base) and sweep[tau]["n_pairs"] == n


def test_blocks_do_not_change_results(make_items, rng, monkeypatch):
    monkeypatch.setattr(similarity, "SLICE_ROWS", 10)
    a, b = unit(rng.normal(size=(150, 6))), unit(rng.normal(size=(130, 6)))
    sims = a @ b.T
    for block in (16, 4096):
        got = {(r["left_id"], r["rank"]): r["right_id"] for r in topk_similar(make_items(a), make_items(b), 3, block_rows=block).collect()}
        order = np.argsort(-np.round(sims, 9), axis=1, kind="stable")[:, :3]
        assert got == {(i, k + 1): int(order[i, k]) for i in range(150) for k in range(3)}
    pairs = {(r["left_id"], r["right_id"]) for r in similar_pairs(make_items(a), make_items(a), 0.8, once=True, block_rows=32).collect()}
    s = np.round(a @ a.T, 9)
    assert pairs == {(i, j) for i in range(150) for j in range(i + 1, 150) if s[i, j] >= 0.8}


@pytest.mark.parametrize(("k", "min_sim"), [(16, None), (16, 0.6), (1, None), (3, 1e-9)])
def test_screened_top_is_that_of_all_products(rng, monkeypatch, k, min_sim):
    monkeypatch.setattr(similarity, "slice_rows", lambda others: 16)
    a, b = rng.normal(size=(50, 6)), rng.normal(size=(1500, 6))
    b[100:130], b[200:203], b[7] = a[3], a[4] * 2, 0.0  # copies tie, the first ones count
    b[300:310] = a[5] + rng.normal(size=(10, 6)) * 1e-7  # closer than single precision tells
    same = np.arange(10), np.arange(100, 110)
    for left_out in (None, same):
        sims = similarity.sim_matrix(a, b)
        if left_out is not None:
            sims[left_out] = -np.inf
        if min_sim is not None:
            sims[sims < min_sim] = -np.inf
        rows, cols = similarity.block_top(sims, k)
        got = similarity.cosine_top(a, b, k, min_sim, left_out)
        assert got[0].tolist() == rows.tolist() and got[1].tolist() == cols.tolist() and got[2].tolist() == sims[rows, cols].tolist()


def test_titles_are_matched_once_for_all_thresholds(spark, rng, monkeypatch):
    calls, whole = [], matching.match_sets
    monkeypatch.setattr(matching, "match_sets", lambda left, right, keys=(), **more: calls.append(tuple(keys)) or whole(left, right, keys, **more))
    x = unit(rng.normal(size=(24, 3)))
    frame = spark.createDataFrame([(i, x[i].tolist(), x[i].tolist()) for i in range(24)], "id int, title_vec array<double>, text_vec array<double>")
    out = matching.cascade_match(frame.filter("id < 12"), frame.filter("id >= 12"), [0.7, 0.9]).collect()
    assert calls == [(), ("tau",)] and len(out) == 24


def test_euclidean_noise_fill(spark, rng):
    x = rng.normal(size=(60, 4)) * rng.uniform(0.2, 3, size=(60, 1))
    label = [int(v) for v in rng.integers(-1, 3, size=60)]
    df = spark.createDataFrame([(i, x[i].tolist(), label[i], float(i)) for i in range(60)], "id int, vec array<double>, label int, score double")
    got = {r["id"]: (r["label"], r["score"], r["filled"]) for r in matching.fill_noise(df).collect()}
    known = [i for i in range(60) if label[i] != -1]
    for i in range(60):
        if label[i] != -1:
            assert got[i] == (label[i], float(i), False)
        else:
            j = min(known, key=lambda k: (round(np.linalg.norm(x[i] - x[k]), 9), k))
            assert got[i] == (label[j], float(j), True)
