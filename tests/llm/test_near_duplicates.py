"""The two similarity joins against all pairs."""

import itertools
import random
import sys
from decimal import Decimal

import numpy as np
import pytest

from concord.llm import grid_join, ngram_join
from concord.operators import graph
from tests.llm.conftest import words_of


def shingle_set(text, width):
    w = words_of(text)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def classes(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


def brute_texts(rows, width, percent):
    """(id, set size, smallest id of the class) by comparing all pairs."""
    sets = [shingle_set(t, width) for _, t in rows]
    links = [
        (i, j) for i, j in itertools.combinations(range(len(rows)), 2)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    ]
    of = classes(len(rows), links)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if of[j] == of[i] and rows[j][0] is not None]
        out.append((doc, len(sets[i]), doc if not sets[i] else min(ids) if ids else None))
    return sorted(out, key=str)


def families(seed):
    """Families of edited copies: stars around a text, chains of edits, and texts that share a passage."""
    rng = random.Random(seed)
    word = lambda: rng.choice("ab cd ef gh ij kl mn op qr st uv wx yz aa bb cc dd ee".split()) + str(rng.randint(0, 400))
    texts = []
    passage = [word() for _ in range(30)]
    for _ in range(6):
        base = [word() for _ in range(rng.choice((9, 12, 30, 60, 120)))]
        for _ in range(12):
            edited = list(base)
            for _ in range(rng.randint(0, 3)):
                edited[rng.randrange(len(edited))] = word()
            texts.append(edited)
            if rng.random() < 0.3:
                base = edited
    texts += [[word() for _ in range(rng.randint(1, 20))] + passage for _ in range(25)]
    rng.shuffle(texts)
    return [(i * 3 + 1, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("width,percent,leaf,pivots", [(3, 90, 8, 16), (3, 80, 2, 2), (2, 60, 2, 2)])
def test_ngram_join_equals_all_pairs(spark, monkeypatch, width, percent, leaf, pivots):
    monkeypatch.setattr(ngram_join, "LEAF", leaf)
    monkeypatch.setattr(ngram_join, "PIVOTS", pivots)
    rows = families(width + percent)
    got = ngram_join.linked_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), width, percent)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str)
    want = brute_texts(rows, width, percent)
    assert got == want
    assert any(c != d for d, _, c in want)


def test_ngram_join_of_odd_rows(clashing, messy, no_docs):
    rows = [(r.doc_id, r.text) for r in messy.collect()]
    got = ngram_join.linked_classes(clashing)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == brute_texts(rows, 3, 90)
    assert ngram_join.linked_classes(no_docs).count() == 0


def test_keep_one_of_each_class(clashing, no_docs):
    kept = ngram_join.keep_one(clashing)
    assert kept.columns == clashing.columns
    ids = sorted((str(r.doc_id), str(r.text)[:12]) for r in kept.collect())
    # one of the two rows and two ids of the first text; every empty text; both texts of id 8
    assert ids == sorted([
        ("1", "one two thre"), ("3", "None"), ("4", ""), ("5", " \t\n "), ("None", "a row withou"), ("None", "None"), ("6", "word"), ("7", "lorem ipsum "),
        ("8", "ÄÖÜ ñandú 漢字"), ("8", "another text"), ("-9", "negative id"),
    ])
    assert ngram_join.keep_one(no_docs).count() == 0


def test_names_of_documents_are_not_broadcast(spark, monkeypatch):
    called = []
    real = ngram_join.F.broadcast
    monkeypatch.setattr(ngram_join.F, "broadcast", lambda df: called.append(sys._getframe(1).f_globals["__name__"]) or real(df))
    rows = families(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = ngram_join.keep_one(docs, 3, 80)
    assert out.count() < len(rows)
    assert ngram_join.__name__ not in called and "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_key_count_leaves_room_for_every_link():
    for percent in (50, 80, 90):
        for n in range(1, 200):
            # a set may lack n - ceil(percent n / 100) of its shingles at most, and one key more must be shared
            lacking = max(n - i for i in range(n + 1) if 100 * i >= percent * n)
            assert ngram_join.key_count(n, percent) == lacking + 1


def test_components_of_stars_and_chains(spark):
    links = [(1, i) for i in range(2, 200)] + [(i, i + 1) for i in range(300, 340)] + [(199, 340), (500, 500), (7, 1)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert set(got.values()) == {1} and 300 in got and 500 not in got
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_few_links_need_no_rounds_and_grow_with_new_links(spark, monkeypatch):
    """A round of links that are few costs the driver as many exchanges as one of many, and classes are not found anew for each new link."""
    rng = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    read = lambda df: {r.node: r.component for r in df.collect()}
    parent = {n: n for link in links if link[0] != link[1] for n in link}
    for _ in range(100):
        for a, b in links:
            if a != b:
                parent[a] = parent[b] = min(parent[a], parent[b])
    written = []
    plain = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda *a, **k: (written.append(1), plain(*a, **k))[1])
    assert read(graph.components(frame(links))) == parent and len(written) == 3
    # the rounds, down to links that are finished directly
    monkeypatch.setattr(graph, "FINISH_LINKS", 20)
    assert read(graph.components(frame(links))) == parent
    monkeypatch.setattr(graph, "FINISH_LINKS", 0)
    assert read(graph.components(frame(links))) == parent
    grown = graph.extended_components(graph.extended_components(graph.components(frame(links[:120])), frame(links[120:250])), frame(links[250:]))
    assert read(grown) == parent
    assert read(graph.extended_components(graph.components(frame([])), frame(links))) == parent and read(graph.extended_components(grown, frame([]))) == parent
    named = [(f"n{a:03}", f"n{b:03}") for a, b in links if a < 400 and b < 400]
    assert read(graph.components(spark.createDataFrame(named, "a string, b string"))) == {f"n{n:03}": f"n{c:03}" for n, c in parent.items() if n < 400}


def brute_vectors(rows, cosine):
    ok = []
    for _, v, label in rows:
        fine = v is not None and label is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
        ok.append(np.array(v, dtype=np.float64) / np.linalg.norm(np.array(v, dtype=np.float64)) if fine else None)
    links = [
        (i, j) for i, j in itertools.combinations(range(len(rows)), 2)
        if ok[i] is not None and ok[j] is not None and rows[i][2] == rows[j][2] and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] >= cosine
    ]
    of = classes(len(rows), links)
    n = [0] * len(rows)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    smallest = [min((rows[j][0] for j in range(len(rows)) if of[j] == of[i] and rows[j][0] is not None), default=None) for i in range(len(rows))]
    return sorted(((rows[i][0], n[i], smallest[i], rows[i][0] == smallest[i]) for i in range(len(rows))), key=str)


def test_grid_join_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(grid_join, "BLOCK", 8)
    monkeypatch.setattr(grid_join, "FAN_OUT", 2)
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(12, 16))
    rows = []
    for i in range(160):
        v = centers[rng.integers(12)] + rng.normal(scale=0.25, size=16)
        rows.append((i + 5, [float(np.float32(x)) for x in v], int(rng.integers(3))))
    rows += [(200 + i, rows[0][1], rows[0][2]) for i in range(20)]  # copies
    rows += [(200, rows[0][1], rows[0][2]), (300, None, 1), (301, [0.0] * 16, 1), (302, [1.0, None] * 8, 1), (303, [float("nan")] * 16, 1), (304, rows[1][1], None),
             (305, [1.0, 2.0], 1), (306, [2.0, 4.0], 1), (307, [], 1), (308, [float("inf")] * 16, 0), (309, [2 * x for x in rows[0][1]], rows[0][2])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, point int").repartition(3)
    got = sorted((tuple(r) for r in grid_join.linked_vectors(df).collect()), key=str)
    assert got == brute_vectors(rows, 0.93)


def test_grid_join_without_usable_rows(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert grid_join.linked_vectors(spark.createDataFrame([], schema)).count() == 0
    assert [tuple(r) for r in grid_join.linked_vectors(spark.createDataFrame([(4, None, 1)], schema)).collect()] == [(4, 0, 4, True)]


@pytest.mark.parametrize("kind, labels", [("double", [1.2, 1.4, 1.4, None]), ("string", ["a", "b", "b", None]), ("decimal(3,1)", [Decimal("1.2"), Decimal("1.4"), Decimal("1.4"), None]), ("smallint", [1, 2, 2, None])])
def test_grid_join_labels_of_any_type(spark, kind, labels):
    rows = [(i, [1.0, 2.0], label) for i, label in enumerate(labels)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<double>, label {kind}")
    assert sorted(tuple(r) for r in grid_join.linked_vectors(df).collect()) == [(0, 0, 0, True), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
