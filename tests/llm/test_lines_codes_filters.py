import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.llm import filter_audit, line_dedup, vector_codes

SPACE = " \t\n\x0b\f\r"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SHARED = ["  Terms of Use apply to this page, see below.", "ÄÖÜ Zeile mit vielen Wörtern über alles", "all rights reserved, 2024 and later"]


def plain_lines(rows):
    """(doc_id, text) -> (kept text, n_lines, n_dropped) of every row."""
    key = lambda line: line.strip(SPACE).translate(LOW)
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(-(1 << 63) if doc is None else doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        own = -(1 << 63) if doc is None else doc
        kept = [x for x in lines if len(holders[key(x)]) < 3 or own == max(holders[key(x)])]
        out.append((doc, None if text is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def random_docs(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lines = [rng.choice([*SHARED, SHARED[0].upper() + "\t", "short", "", f"a line of document {i} alone"]) for _ in range(rng.choice([1, 3, 150]))]
        rows.append((rng.choice([i, i, i // 2, None]), "\n".join(lines)))
    return [*rows, (7, None), (8, ""), (9, "\n"), rows[0], rows[0]]


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_is_as_the_plain_one(spark, seed):
    rows = random_docs(seed)
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted([tuple(r) for r in got.collect()], key=repr) == plain_lines(rows)


def test_bitmaps_hold_only_words_with_a_dropped_line(spark):
    long = "\n".join([f"line {i} of the long document" for i in range(300)] + [SHARED[0]])
    rows = [(1, long), (2, SHARED[0]), (3, SHARED[0] + "\nrest")]
    maps = {r["doc_id"]: r for r in line_dedup.keep_bitmaps(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(maps) == {1, 2}
    assert [(w["word"], w["keep"]) for w in maps[1]["bitmap"]] == [(4, ~(1 << (300 - 256)))]
    assert maps[1]["n_dropped"] == 1


def test_line_windows_stand_on_the_range_partitioning(spark):
    docs = spark.createDataFrame(random_docs(3), "doc_id long, text string")
    lines = line_dedup.line_keys(docs)
    dealt = line_dedup._in_cells(lines, lines.count()).repartitionByRange(4, "h1", "h2", "cell")
    from pyspark.sql import Window

    seen = dealt.withColumn("n", F.row_number().over(Window.partitionBy("h1", "h2", "cell").orderBy("doc_id")))
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and "hashpartitioning(h1" not in plan
    assert "Python" not in plan and "Arrow" not in plan


def test_lines_of_messy_tables(spark, messy, clashing, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    for docs in (messy, clashing):
        got = line_dedup.dedup_lines(docs)
        assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
        assert sorted([(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.select("doc_id", "text", "n_lines", "n_dropped").collect()], key=repr) == plain_lines(rows)
    assert line_dedup.dedup_lines(no_docs).count() == 0


def plain_masks(rows):
    """(doc_id, part, set of failed filters) of every (doc_id, text, lang) row."""
    first = {}
    for doc, text, _ in rows:
        if doc is not None:
            first[text or ""] = min(doc, first.get(text or "", doc))
    out = []
    for doc, text, lang in rows:
        text = text or ""
        w = re.findall("[^\x20\x09-\x0d]+", text)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search("[#$%&*|]", text)), "E": doc is not None and text in first and doc > first[text],
        }
        out.append((doc, lang or "", {f for f, x in fails.items() if x}))
    return out


def plain_audit(rows, labels):
    found = plain_masks(rows)
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    out, removed_by = [], Counter()
    for part in {p for _, p, _ in found}:
        mine = [(d, fails) for d, p, fails in found if p == part]
        for order in itertools.permutations("ABCDE"):
            left = list(mine)
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                before = [x for x in mine if f in x[1] and x[1] & set(order[: step - 1])]
                removed_by[part, f] += len(gone)
                out.append([part, "".join(order), step, len(left), len(gone), len(before), sum(x[1] == {f} for x in mine), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone)])
    return sorted((*r, removed_by[r[0], r[1][r[2] - 1]]) for r in out)


def test_filter_audit_is_as_applying_the_filters(spark, messy, clashing, no_docs):
    rng = random.Random(5)
    words = ["Wort", "LOUD", "plain", "a&b", "ñandú", "x", "y", "zebra"] + [f"w{i}" for i in range(300)]
    rows = [(rng.choice([i, i // 3, None]), rng.choice([None, "", " ".join(rng.choices(words[: rng.choice([3, 8, 300])], k=rng.choice([2, 190, 260])))]), rng.choice(["en", "de", "", None])) for i in range(80)]
    rows += [(100 + i, rows[5][1], "en") for i in range(30)]
    marks = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(120)] + [(3, 1, 1), (None, 1, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = filter_audit.audit(filter_audit.masks(docs), labels)
    assert sorted(tuple(r) for r in got.collect()) == plain_audit(rows, marks)
    for docs in (messy, clashing):
        plain = plain_audit([(r["doc_id"], r["text"], r["lang"]) for r in messy.collect()], marks)
        assert sorted(tuple(r) for r in filter_audit.audit(filter_audit.masks(docs), labels).collect()) == plain
    assert filter_audit.audit(filter_audit.masks(no_docs), labels).count() == 0
    assert filter_audit.audit(filter_audit.masks(messy), labels.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """rows: (vec_id, vector, label) in the order of ids."""
    whole = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = [r for r in whole if len(r[1]) == len(whole[0][1])]
    d = len(whole[0][1])
    cuts = [p * d // parts for p in range(parts + 1)]
    books = [[v[cuts[p] : cuts[p + 1]] for _, v, _ in whole[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((x - c) ** 2 for x, c in zip(v[cuts[p] : cuts[p + 1]], e, strict=True)), j) for j, e in enumerate(books[p])) for p in range(parts)] for _, v, _ in whole]

    for _ in range(rounds):
        near = assign()
        for p in range(parts):
            for j in range(len(books[p])):
                own = [v[cuts[p] : cuts[p + 1]] for (_, v, _), a in zip(whole, near, strict=True) if a[p][1] == j]
                if own:
                    books[p][j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out = [(i, "".join(f"{j:02x}" for _, j in a), sum(x for x, _ in a), label) for (i, _, label), a in zip(whole, assign(), strict=True)]
    sums = Counter()
    for r in out:
        sums[r[3]] += r[2]
    name = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted([(i, code, error, sums[label]) for i, code, error, label in out], key=repr), name


VECTORS = "vec_id long, embedding array<float>, label int"


def vector_rows(n=90, d=16, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=d).round(1)], int(rng.integers(3)) if i % 7 else None) for i in range(n)]
    rows += [(n, rows[3][1], 1), (n + 1, rows[3][1], 1), (n + 2, None, 1), (n + 3, [None] * d, 2), (n + 4, [float("nan")] * d, 0), (n + 5, [float("inf")] * d, None), (n + 6, [0.0] * d, 2), (n + 7, [1.0] * (d + 1), 2)]
    return rows


def coded(df, **options):
    out, books = vector_codes.compress(df, **options)
    return sorted([tuple(r) for r in out.select("vec_id", "code", "error", "label_error").collect()], key=repr), vector_codes.codebooks_name(books)


@pytest.mark.parametrize("d", [16, 13])
def test_vector_codes_are_as_the_plain_ones(spark, d):
    rows = vector_rows(d=d)
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    assert coded(df) == plain_codes(rows)
    more = df.select("*", F.lit(1).alias("v"), F.lit(2).alias("code"), F.lit("x").alias("name"), F.lit(3).alias("n"))
    assert coded(more) == plain_codes(rows)


def test_vector_codes_of_few_rows_and_none(spark):
    rows = vector_rows(n=4)
    assert coded(spark.createDataFrame(rows, VECTORS)) == plain_codes(rows)
    none = spark.createDataFrame([], VECTORS)
    assert coded(none)[0] == []
    # components that no integer of the columns holds are held to the largest, ids may be null or repeated
    big = spark.createDataFrame([(None, [1e38] * 8, 1), (2, [-1e38] * 8, 1), (2, [0.5] * 8, None)], VECTORS)
    assert sorted((r[0] is None, r[0]) for r in coded(big)[0]) == [(False, 2), (False, 2), (True, None)]


def test_equal_average_search_finds_the_first_nearest_entry():
    rng = np.random.default_rng(3)
    for d, k, spread in ((1, 5, 4), (8, 16, 3), (8, 256, 3), (4, 40, 1000)):
        x, entries = rng.integers(-spread, spread, (500, d)), rng.integers(-spread, spread, (k, d))
        index, best = vector_codes.nearest(x, entries)
        all_pairs = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (index == all_pairs.argmin(axis=1)).all() and (best == all_pairs.min(axis=1)).all()


def test_rows_that_match_are_never_left_out(spark, monkeypatch):
    from concord.llm import store

    monkeypatch.setattr(store, "KEY_SLOTS", 1 << 14)
    rows = spark.range(20000).select("id", F.when(F.col("id") % 3 > 0, F.xxhash64("id")).alias("name"))
    others = rows.filter("id % 40 = 0")
    kept = store.may_match(rows, others, ["id", "name"])
    assert kept.columns == rows.columns and kept.join(others, "id", "left_semi").count() == 500 and kept.count() < 2000
    assert store.may_match(rows, others.limit(0), ["id", "name"]).count() == 0
