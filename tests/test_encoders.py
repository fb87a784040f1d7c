import hashlib
import math
import re

import numpy as np
import pytest

from concord.operators import encoders


def plain_tfidf(texts, buckets):
    counts = []
    for t in texts:
        c = {}
        for w in re.findall("[a-z0-9]+", (t or "").translate({i: i + 32 for i in range(65, 91)})):
            b = int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % buckets
            c[b] = c.get(b, 0) + 1
        counts.append(c)
    df = {b: sum(b in c for c in counts) for c in counts for b in c}
    out = []
    for c in counts:
        w = {b: n * math.log((len(texts) + 1) / (df[b] + 1)) for b, n in sorted(c.items())}
        norm = math.sqrt(sum(v * v for v in w.values()))
        out.append((list(w), [v / norm if norm else 0.0 for v in w.values()]))
    return out


@pytest.mark.parametrize("buckets", [3, 4096])
def test_hashed_tfidf_is_the_plain_one(spark, buckets):
    texts = ["The cat sat, the CAT ran", "a dog", None, "", "Ä cat ß", "cat " * 500, "a dog", "!!"]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "id long, text string, n int").repartition(3)
    got = {r["id"]: r for r in encoders.hashed_tfidf(df, buckets).collect()}
    for i, (places, weights) in enumerate(plain_tfidf(texts, buckets)):
        assert got[i]["buckets"] == places
        assert got[i]["weights"] == pytest.approx(weights)
    assert encoders.hashed_tfidf(df.filter("id < 0")).collect() == []


def test_hashed_tfidf_counts_words_where_they_are_read(spark):
    df = spark.createDataFrame([(i, f"word {i % 3} of {i % 5}") for i in range(40)], "id long, text string")
    plan = encoders.hashed_tfidf(df)._jdf.queryExecution().optimizedPlan().toString()
    # words are neither rows nor hashed anew for each of the plan's two readers, and nothing is grouped by id
    assert "md5" not in plan and "regexp_extract_all" not in plan and "Aggregate [id" not in plan
    known = {}
    assert encoders._bucket_counts("a b a", 4096, known) == encoders._bucket_counts("B A a", 4096, known) and set(known) == {b"a", b"b"}


def test_encoder_is_called_with_bounded_batches(spark):
    texts = [None, "", "abc", "x" * 100, "ä" * 6, None, "y" * 9]

    def load():
        loads = []
        loads.append(1)

        def encode(batch):
            # size of the call, length of the text, how often the model was loaded
            total = sum(len(t.encode()) for t in batch)
            return np.array([[total, len(t), len(loads)] for t in batch], dtype=float)

        return encode

    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    rows = sorted(encoders.encode_texts(df, "sizes", load, batch_bytes=12).collect())
    assert [None if r["vec"] is None else r["vec"][1:] for r in rows] == [None if t is None else [len(t), 1.0] for t in texts]
    assert [r["vec"][0] for r in rows if r["vec"] is not None] == [3.0, 3.0, 100.0, 12.0, 9.0]
    assert encoders.encode_texts(df.filter("id < 0"), "sizes", load).collect() == []


def test_encoder_of_a_wrong_shape_is_an_error(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string")
    with pytest.raises(Exception, match="returned shape"):
        encoders.encode_texts(df, "wrong", lambda: lambda batch: np.zeros((5, 2))).collect()
    with pytest.raises(ValueError, match="there already"):
        encoders.encode_texts(df, "wrong", lambda: None, out="text")
