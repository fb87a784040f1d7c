"""Decontamination, pseudonyms, language model, classifiers and the pipeline."""

import datetime
import hashlib
import itertools
import math
import os
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from concord.llm import decontaminate, lattice, pseudonyms, quality, queries, toxicity
from tests.llm.conftest import DOC_SCHEMA, words_of
from tools.compare import TABLES, normal

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


# ------------------------------------------------------------------ decontamination


def item_words(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def brute_hits(text, items, width):
    w, hit, found = item_words(text), set(), set()
    for item, t in items:
        iw = item_words(t)
        n = min(width, len(iw))
        for a, b in itertools.product(range(len(iw) - n + 1) if n else (), range(len(w) - n + 1)):
            if iw[a : a + n] == w[b : b + n]:
                hit |= set(range(b, b + n))
                found.add("" if item is None else str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block_words", [1000, 7])
def test_windows_equal_a_search_of_each(spark, block_words):
    rng = random.Random(4)
    word = lambda: rng.choice("Alpha beta, Gamma-delta é3 ñ x_y".split())
    items = [(i, " ".join(word() for _ in range(rng.randint(0, 9)))) for i in range(12)] + [(None, "beta beta gamma"), (40, None), (41, ""), (3, "alpha beta")]
    docs = [(i, "".join(word() + rng.choice(" ._\n\x00") for _ in range(rng.randint(0, 60)))) for i in range(60)] + [(90, None), (91, ""), (92, "alpha")]
    got = decontaminate.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), width=4, block_words=block_words
    ).collect()
    texts = dict(docs)
    for r in got:
        assert (r.n_words, r.n_hit, r["items"]) == brute_hits(texts[r.doc_id], items, 4)
        # spans are the hit words in the original
        assert sum(len(item_words(texts[r.doc_id][s.start : s.end])) for s in r.spans) == r.n_hit
    assert len(got) == len(docs) and any(r.n_hit for r in got)


def test_clean_rows_stay(spark, clashing, no_docs):
    bench = spark.createDataFrame([(1, "two three four")], "item_id long, text string")
    kept = decontaminate.keep_clean(clashing, bench)
    assert kept.columns == clashing.columns and kept.count() == clashing.count() - 3
    assert decontaminate.keep_clean(clashing, bench.limit(0)).count() == clashing.count()
    assert decontaminate.keep_clean(no_docs, bench).count() == 0


# ------------------------------------------------------------------ pseudonyms


def feistel(value, key, letters=26):
    """The text permutation, written out plainly."""
    half = len(value) // 2
    a, b = value[:half], value[half:]
    for r in range(1, pseudonyms.ROUNDS + 1):
        stream = hashlib.sha256(f"{key}|{r}|{b}".encode()).hexdigest()
        moved = ""
        for i, c in enumerate(a):
            k = int(stream[(i % 16) * 4 : (i % 16) * 4 + 4], 16)
            for base, size in (("0", 10), ("a", letters), ("A", letters)):
                if ord(base) <= ord(c) < ord(base) + (10 if base == "0" else 26):
                    c = chr(ord(base) + (ord(c) - ord(base) + k) % size)
                    break
            moved += c
        a, b = b, moved
    return a + b


def feistel_number(left, right, sizes, key):
    (a, b), (m, n) = (left, right), sizes
    for r in range(1, pseudonyms.ROUNDS + 1):
        a, b, m, n = b, (a + int(hashlib.sha256(f"{key}|{r}|{b}".encode()).hexdigest()[:12], 16)) % m, n, m
    return a, b


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def swapped(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r.text for r in pseudonyms.pseudonymise(df, "k").orderBy("doc_id").collect()]


def test_values_equal_a_plain_version(spark):
    mail, ip, phone, card, iban, ssn, day, iso, us, hexa = swapped(
        spark, "to jo.doe-99@mail.example.com.", "at 192.168.1.77, ok", "call +1 (017) 555-7713 now", "card 4539 1488 0343 6467!", "iban DE89 3704 0044 0532 0130 00.",
        "ssn 123-45-6789", "born 31.12.1999", "on 2000-02-29", "on 12/31/1999", 'token = "e51a5499e3950eabef3742d6cf40b27b4e61a74a"',
    )
    assert mail == f"to {feistel('jo.doe-99', 'k|email')}@mail.example.com."
    a, b = feistel_number(192 * 256 + 168, 256 + 77, (65536, 65536), "k|ip")
    assert ip == f"at {a // 256}.{a % 256}.{b // 256}.{b % 256}, ok"
    digits = feistel("0175557713", "k|phone")
    assert phone == f"call +1 ({digits[:3]}) {digits[3:6]}-{digits[6:]} now"
    digits = re.sub(r"\D", "", card)
    assert digits[:-1] == feistel("453914880343646", "k|card") and luhn(digits) and re.fullmatch(r"card \d{4} \d{4} \d{4} \d{4}!", card)
    plain = iban[5:-1].replace(" ", "")
    assert plain[:2] == "DE" and plain[4:] == feistel("370400440532013000", "k|iban") and int(plain[4:] + "1314" + plain[2:4]) % 97 == 1
    a, b = feistel_number(122, 44 * 9999 + 6788, (898, 99 * 9999), "k|ssn")
    assert ssn == f"ssn {a + 1 + (a >= 665):03d}-{b // 9999 + 1:02d}-{b % 9999 + 1:04d}"

    def moved(date):
        n = (date - datetime.date(1900, 1, 1)).days
        a, b = feistel_number(n // 4297, n % 4297, (17, 4297), "k|date")
        return datetime.date(1900, 1, 1) + datetime.timedelta(a * 4297 + b)

    new = moved(datetime.date(1999, 12, 31))
    assert day == f"born {new:%d.%m.%Y}" and us == f"on {new:%m/%d/%Y}" and iso == f"on {moved(datetime.date(2000, 2, 29)):%Y-%m-%d}"
    assert hexa == f'token = "{feistel("e51a5499e3950eabef3742d6cf40b27b4e61a74a", "k|hex", 6)}"' and re.search('"[0-9a-f]{40}"', hexa)


def test_equal_values_stay_linked_and_invalid_ones_stay(spark):
    got = swapped(spark, "a 4539148803436467 b", "a 4539 1488 0343 6467 b 4539-1488-0343-6467", "x 4539148803436468", "300.1.2.3 1980-13-45 1850-01-01 666-12-1234", "Version 2.0, 4.0.", None, "", "no data " * 20_000 + "x" * 200_000)
    digits = re.sub(r"\D", "", got[0])
    assert re.sub(r"\D", "", got[1]) == digits * 2 and digits != "4539148803436467"
    assert got[2:7] == ["x 4539148803436468", "300.1.2.3 1980-13-45 1850-01-01 666-12-1234", "Version 2.0, 4.0.", None, ""]
    assert got[7] == "no data " * 20_000 + "x" * 200_000


def test_neighbours_do_not_hide_values(spark):
    card, other, phone, iban = "4111 1111 1111 1111", "5500 0000 0000 0004", "+1 (826) 555-4081", "DE89 3704 0044 0532 0130 00"
    # each part is a value of its own or stays
    parts = [
        (phone, " ", "190.137.223.204"), (phone, " ", "2024-01-15"), (phone, " 77"), ("+1 826 555 4081", " ", "190.137.223.204"), ("+49 30 1234567", " ", "2024-01-15"),
        ("+49-30-1234567", " 2024"), ("+44 20 7946 0958", " 12"), ("+49 30 1234567", " ", card), (phone, " ", "123-45-6789"), (phone, ".", "15.01.2024"), ("+49 30 1234-5678",), ("+49-30 1234567",),
        (card, " 12/27"), ("4111111111111111", " 123"), ("7 ", "4111111111111111"), ("1234 ", card), (card, " ", other), (card, "-", "2024-01-15"), ("12 ", "378282246310005"),
        ("3782 822463 10005", " 12/27"), ("123456 ", "41111111 11111111", " 1"), ("4111111111111112 ", "4111111111111111"), (iban, " BIC COBADEFF"), ("AB12 ", iban, " 2024"), (iban, " ", card),
        ("AB12 3456 7890 1234 ", card),
    ]
    alone = sorted({p for row in parts for p in row})
    new = dict(zip(alone, swapped(spark, *alone), strict=True))
    plain = {" ", "-", ".", " 77", " 2024", " 12", " 12/27", " 123", "7 ", "1234 ", "12 ", "123456 ", " 1", "4111111111111112 ", " BIC COBADEFF", "AB12 ", "AB12 3456 7890 1234 "}
    assert {p for p in alone if new[p] == p} == plain
    for row, got in zip(parts, swapped(spark, *("".join(r) for r in parts)), strict=True):
        assert got == "".join(new[p] for p in row), row


def test_permutations_are_one_to_one(spark):
    ips = [f"10.0.{i // 256}.{i % 256}" for i in range(600)]
    assert len(set(swapped(spark, *ips))) == 600
    days = [str(datetime.date(1990, 1, 1) + datetime.timedelta(i)) for i in range(600)]
    out = swapped(spark, *days)
    assert len(set(out)) == 600 and all(datetime.date.fromisoformat(x) for x in out)


def test_columns_and_rows_are_kept(clashing, no_docs):
    out = pseudonyms.pseudonymise(clashing, "k", count="changed")
    assert out.columns == [*clashing.columns, "changed"] and out.count() == clashing.count()
    assert pseudonyms.pseudonymise(no_docs, "k").count() == 0
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_columns_named_as_the_operators_own_stay(spark):
    names = ("__pattern", "__found", "__new", "__gaps", "__FOUND_")
    df = spark.createDataFrame([(1, "write to ada@example.org now")], "doc_id long, text string").select("*", *[F.lit("kept").alias(n) for n in names])
    row = pseudonyms.pseudonymise(df, "k").first()
    assert [row[n] for n in names] == ["kept"] * len(names) and "ada@example.org" not in row["text"]


# ------------------------------------------------------------------ language model


def test_spelling_sums_all_segmentations():
    keys = [np.array(sorted({ord(c) for c in " abé"[:3]} | {0xC3, 0xA9}), dtype=np.uint64), np.array(sorted(int.from_bytes(p, "big") for p in (b" a", b"ab", b"ba")), dtype=np.uint64)]
    keys += [np.zeros(0, dtype=np.uint64)] * (lattice.MAX_PIECE - 2)
    rng = np.random.default_rng(1)
    scores = ([np.log(rng.dirichlet(np.ones(len(k)))) if len(k) else np.zeros(0) for k in keys], float(np.log(0.25)))
    table = {k.item().to_bytes(n + 1, "big"): s for n, ks in enumerate(keys) for k, s in zip(ks, scores[0][n], strict=True)}

    def brute(word):
        word = b" " + word
        total = [1.0] + [0.0] * len(word)
        for end in range(1, len(word) + 1):
            total[end] = sum(total[start] * math.exp(table[word[start:end]]) for start in range(end) if word[start:end] in table)
        return total[-1] * 0.25

    tokens = [b"a", b"ab", b"abba", "é".encode(), b"ababab" * 10, b"x"]
    got = np.exp(lattice.spelling(tokens, keys, scores))
    assert got == pytest.approx([brute(t) for t in tokens])
    counts = lattice.expected_counts([b"abba"], keys, scores)
    # the expected pieces spell the word: lengths add up to its bytes
    assert sum(c * (n + 1) for n, k in enumerate(np.split(counts, np.cumsum([len(x) for x in keys])[:-1])) for c in k) == pytest.approx(5)


def test_history_leaves_a_distribution():
    rng = np.random.default_rng(2)
    stated = rng.dirichlet(np.ones(6))
    past = rng.integers(0, 6, 40)
    total = 0.0
    for nxt in range(6):
        tokens = np.append(past, nxt)
        a, b = lattice.history(tokens, np.zeros(41, dtype=np.int64))
        total += a[-1] * stated[nxt] + b[-1]
    assert total == pytest.approx(1.0)


def test_base_scores_equal_counts(spark, clashing, monkeypatch):
    monkeypatch.setattr(lattice, "CHUNK_BYTES", 50)
    held = F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))
    got = sorted(tuple(r) for r in lattice.score(clashing, held).select("n_tokens", "n_known", "train_tokens", "base_score", "held_out").collect())
    rows = [(r.doc_id, [*words_of(r.text), None]) for r in clashing.collect()]
    counts = {}
    for d, w in rows:
        for t in w if d is None or d % 2 else ():
            counts[t] = counts.get(t, 0) + 1
    n = sum(counts.values())
    floor = n + 0.1 * (len(counts) + 1)
    want = sorted(
        (len(w), sum(t in counts for t in w), n, sum(math.log10((counts.get(t, 0) + 0.1) / floor) for t in w), d is not None and d % 2 == 0) for d, w in rows
    )
    for g, w in zip(got, want, strict=True):
        assert g[:3] == w[:3] and g[3] == pytest.approx(w[3]) and g[4] == w[4]


def test_scores_without_training_or_rows(spark, clashing, no_docs):
    assert lattice.score(no_docs, F.lit(False)).count() == 0
    rows = lattice.score(clashing, F.lit(True)).collect()
    assert len(rows) == clashing.count() and all(np.isfinite(r.score) and r.n_known == 0 for r in rows)


def test_counted_words_go_through_the_lattice(spark):
    docs = spark.createDataFrame([(1, "ab ab"), (3, "cd cd"), (4, "ab"), (6, "zz")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in lattice.score(docs, F.col("doc_id") % 2 == 0, classes=None).collect()}
    keys, own = lattice.pieces(lattice.VOCABULARY)
    spelled = dict(zip(("ab", "zz"), np.exp(lattice.spelling([b"ab", b"zz"], keys, own)), strict=True))
    # two words of two uses and two ends: 6 tokens of 3 kinds, discount 0.05; no word is held once, so the pieces' scores are their own
    counted, left = 1.95 / 6, 0.05 * 3 / 6
    end = counted + left * counted
    assert got[4] == pytest.approx(math.log10(counted + left * (counted + left * spelled["ab"])) + math.log10(end), abs=1e-12)
    assert got[6] == pytest.approx(math.log10(left * left * spelled["zz"]) + math.log10(end), abs=1e-9)


def test_stated_probabilities_add_up_to_one():
    # three counted words, two others and the end; spellings are a distribution over the five words
    spelled = np.log([0.3, 0.2, 0.1, 0.25, 0.15, 1e-300])
    c = np.array([[3, 1, 2, 0, 0, 2], [1, 0, 4, 0, 0, 1]])
    known = lattice.Counts(c.sum(axis=1), (c > 0).sum(axis=1), c[:, -1], 0.5, int(c.sum()), 4)
    assert np.exp(known.logs(c, spelled)).sum(axis=1) == pytest.approx([1.0, 1.0])


@tables
def test_lattice_beats_the_base_on_unseen_documents(spark):
    r = queries.QUERIES["op8_lattice_scores"](spark, "/root/testdata/sf0.01").filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > 1.05 * r[1]


# ------------------------------------------------------------------ classifiers


def brute_segments(x):
    def rec(low, high):
        best = None
        for i, j in itertools.combinations_with_replacement(range(low, high), 2):
            s = sum(x[i : j + 1])
            if s > 0 and (best is None or s > best[2] + 1e-12):
                best = (i, j, s)
        return [] if best is None else rec(low, best[0]) + [best[:2]] + rec(best[1] + 1, high)

    return rec(0, len(x))


def test_segments_are_the_maximal_ones():
    rng = random.Random(0)
    for _ in range(300):
        x = [rng.choice((-3, -2, -1, 1, 2, 3)) + rng.random() / 2 for _ in range(rng.randint(0, 12))]
        assert [(a, b) for a, b, _ in toxicity.segments(x)] == brute_segments(x)


def test_decay_rate_solves_its_equation():
    scores, shares = np.array([3.0, 5.0]), np.array([0.002, 0.001])
    rate = toxicity.decay_rate(scores, shares, 0.1)
    assert np.sum(shares * np.exp(rate * scores)) + 0.997 * np.exp(-rate * 0.1) == pytest.approx(1, abs=1e-6)


@tables
@pytest.mark.parametrize("name,label,least", [("op7_quality_classifier", "quality", 0.9), ("op10_toxic_segments", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out")
    assert got.agg(F.avg((F.col("predicted") == F.col(label)).cast("int"))).first()[0] >= least


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_of_odd_rows(spark, clashing, no_docs, module, label):
    schema = "doc_id long, quality int, toxic int"
    labels = spark.createDataFrame([(1, 1, 1), (7, 0, 0), (7, 0, 0), (8, 1, None), (None, 0, 1), (6, 1, 1), (6, 0, 0), (55, 1, 0)], schema)
    for given in (labels, labels.limit(0), labels.filter("doc_id = 7")):
        model = module.train(clashing, given, F.lit(True))
        out = (module.score(clashing, *model) if module is quality else module.score(clashing, model)).collect()
        assert len(out) == clashing.count() and all(0 <= r.score <= 1 for r in out)
    model = module.train(no_docs, labels, F.lit(True))
    assert (module.score(no_docs, *model) if module is quality else module.score(no_docs, model)).count() == 0


def test_passages_are_positions_in_the_text(spark):
    rng = random.Random(3)
    plain = lambda: " ".join("é" + rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(40))
    rows = [(i, plain() + (f" Übel {rng.randint(0, 999)} Übel! " if i % 3 == 0 else " ") + plain(), "en", "s", 1) for i in range(120)]
    docs = spark.createDataFrame(rows, DOC_SCHEMA)
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    got = toxicity.score(docs, toxicity.train(docs, labels, F.lit(True))).collect()
    for r in got:
        assert (r.score >= 0.5) == (r.doc_id % 3 == 0)
        if r.doc_id % 3 == 0:
            assert any("bel" in rows[r.doc_id][1][p.start : p.end].lower() for p in r.passages)


# ------------------------------------------------------------------ queries and pipeline


@tables
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    got = pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns, dtype=object)
    res = con.execute(queries.ORACLES[name])
    assert normal(got) == normal(pd.DataFrame(res.fetchall(), columns=[d[0] for d in res.description], dtype=object))


@tables
def test_pipeline_stages(spark, clashing, no_docs):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.columns[: len(docs.columns)] == docs.columns
        assert out.dtypes[: len(docs.dtypes)] == docs.dtypes
        docs = out
    assert 0 < docs.count() <= 3 * n
    for given in (clashing, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, given, SF)
            assert out.columns[: len(given.columns)] == given.columns
            out.count()
