"""WARC archives, token files and the source mixture."""

import io
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.llm import mixing, token_counts, warc
from concord.llm.store import new_folder
from tests.llm.conftest import words_of

RECORDS = "record_id string, record_type string, target_uri string, warc_date string, refers_to string, payload_digest string, payload_length long, payload binary"


def records(spark):
    rows = [(f"urn:page:{i}", "response", f"http://h/{i} ü\n", "2024-01-01T00:00:00Z", None, f"d{i}", 3 * i, ("é<p>" * i).encode()[: 3 * i]) for i in range(40)]
    rows += [("urn:page:99", "revisit", None, "2024-01-01T00:00:00Z", "urn:page:5", "d5", 15, None), ("urn:page:100", "response", "u", "2024-01-01T00:00:00Z", None, "e", 0, None)]
    rows += [("urn:page:101", "response", "u", "2024-01-01T00:00:00Z", None, "e", 3_000_000, b"\r\n\r\nab" * 500_000)]
    return rows


def test_warc_round_trip_and_pushdown(spark):
    rows = records(spark)
    folder = new_folder(spark, "test")
    assert warc.write(spark.createDataFrame(rows, RECORDS).repartition(3), folder).agg(F.sum("records")).first()[0] == len(rows)
    got = {r.record_id: r for r in warc.read(spark, folder, split_bytes="2000").collect()}
    assert len(got) == len(rows)
    for rid, kind, uri, date, refers, digest, length, payload in rows:
        r = got[rid]
        assert (r.record_type, r.refers_to, r.payload_digest, r.http_length) == (kind, refers, digest, length)
        assert r.payload == (None if kind == "revisit" else bytes(payload or b""))
        assert r.target_uri == (None if uri is None else uri if uri == "u" else uri.replace(" ", "%20").replace("ü", "%C3%BC").replace("\n", "%0A"))
    found = warc.read(spark, folder).filter("record_type = 'revisit'")
    assert "PushedFilters" in found._jdf.queryExecution().toString() or found.count() == 1
    assert [r.record_id for r in found.collect()] == ["urn:page:99"]
    assert warc.read(spark, folder).filter("record_id IN ('urn:page:3', 'urn:page:4') AND target_uri IS NOT NULL").count() == 2
    assert warc.read(spark, folder, payload="none").filter("payload IS NOT NULL").count() == 0
    assert warc.read(spark, folder + "-absent").count() == 0


def test_unwanted_payloads_are_stepped_over():
    body = warc.record("response", "a", "u", "d", "x", b"p" * 100_000, 100_000, None)
    whole = warc.member(body) + warc.member(warc.record("revisit", "b", None, "d", "x", b"", 100_000, "a"))
    plain = body + warc.record("response", "c", "u", "d", "y", b"", 0, None)
    for data, wanted in ((whole, "b"), (plain, "c")):
        got = list(warc.read_records(io.BytesIO(data), lambda f: f["warc-record-id"] == f"<{wanted}>", lambda f: True))  # noqa: B023
        assert [f["warc-record-id"] for _, f, _ in got] == [f"<{wanted}>"]
    # members of other writers carry no length
    import gzip

    foreign = gzip.compress(body) + gzip.compress(warc.record("response", "z", None, "d", "y", b"q", 1, None))
    assert [f["warc-record-id"] for _, f, _ in warc.read_records(io.BytesIO(foreign), lambda f: True, lambda f: False)] == ["<a>", "<z>"]
    with pytest.raises(EOFError):
        list(warc.read_records(io.BytesIO(gzip.compress(body)[:-40]), lambda f: True, lambda f: True))


def test_long_headers_and_cut_records():
    import gzip

    rng = random.Random(8)
    uri = "http://h/" + "".join(rng.choice("abcdefghij0123456789") for _ in range(300_000)) + "ü" * 100_000
    first, last = warc.record("response", "a", uri, "d", "x", b"p" * 100, 100, None), warc.record("response", "b", "u", "d", "x", b"q" * 50_000, 50_000, None)
    for pack in (warc.member, gzip.compress, bytes):
        data = pack(first) + pack(last)
        for decoded in (True, False):
            got = list(warc.read_records(io.BytesIO(data), lambda f: True, lambda f: decoded))  # noqa: B023
            assert [f["warc-record-id"] for _, f, _ in got] == ["<a>", "<b>"] and len(got[0][1]["warc-target-uri"]) == 9 + 300_000 + 600_000
            # in the payload, in the headers, and in the first bytes
            for left in (len(data) - 12, len(pack(first)) + 30, len(pack(first)) + 3):
                with pytest.raises(EOFError):
                    list(warc.read_records(io.BytesIO(data[:left]), lambda f: True, lambda f: decoded))  # noqa: B023
    for other in (b"no record" * 100, gzip.compress(b"no record" * 100), gzip.compress(b"WARC/1.1 without an end")):
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(other), lambda f: True, lambda f: True))


def test_token_counts_equal_the_encoder(spark, clashing, no_docs):
    folder = new_folder(spark, "test")
    places = token_counts.write_tokens(clashing.repartition(2), folder)
    enc = token_counts.encoder(token_counts.VOCABULARY)
    want = sorted((str(r.doc_id), len(enc.encode_ordinary(r.text or ""))) for r in clashing.collect())
    for block in (2, 64, 1000, 1 << 20):
        counts = token_counts.token_counts(spark, folder, block_bytes=block)
        assert sorted((str(r.doc_id), r.n_tokens) for r in places.join(counts, ["file", "ordinal"]).collect()) == want
    empty = new_folder(spark, "test")
    assert token_counts.write_tokens(no_docs, empty).count() == 0


def test_blocks_are_stitched(spark):
    folder = new_folder(spark, "test")
    store, base = warc.filesystem(folder)
    store.create_dir(base)
    rng = random.Random(5)
    want = []
    for name, closed in (("a.bin", True), ("b.bin", False)):
        lengths = [rng.choice((0, 1, 2, 7, 40)) for _ in range(60)] + [3]
        ids = [x for n in lengths for x in [*([1] * n), 9]]
        with store.open_output_stream(f"{base}/{name}") as out:
            out.write(np.array(ids if closed else ids[:-1], dtype="<u2").tobytes())
        want += [(name, i, n) for i, n in enumerate(lengths)]
    for block in (2, 6, 50, 10_000):
        got = token_counts.token_counts(spark, folder, eod=9, block_bytes=block)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def waterfill(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, total, free = {}, float(sum(sizes.values())), set(order)
    while free:
        share = total / sum(weight[s] for s in free)
        over = [s for s in free if share * weight[s] > 3 * sizes[s]]
        if not over:
            target |= {s: share * weight[s] for s in free}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            total -= target[s]
            free.discard(s)
    return target


def test_mixture_meets_its_targets(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * (1 if s == "tiny" else rng.randint(0, 30))), s) for i, s in enumerate(rng.choices(["big", "é", None, "zz", "tiny", "B"], [50, 5, 5, 5, 1, 10], k=3000))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, bucket_rows=16).collect()
    assert sorted(r.doc_id for r in got) == list(range(3000))
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        assert 0 <= r.copies <= 3 and r.size == len(words_of(rows[r.doc_id][1]))
        sizes[r.source] += r.size
        taken[r.source] += r.copies * r.size
    target = waterfill(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
    assert all(abs(taken[s] - target[s]) <= 30 for s in sizes)
    again = mixing.mix(df.repartition(5), bucket_rows=16).collect()
    assert sorted((r.doc_id, r.copies) for r in again) == sorted((r.doc_id, r.copies) for r in got)


def test_pivot_keeps_words_and_expectation():
    sizes = np.array([5, 3, 8, 2, 7, 7, 1])
    start = np.array([0.2, 0.7, 0.5, 0.9, 0.35, 0.6, 0.15])
    mean = np.zeros(7)
    for seed in range(4000):
        p = start.copy()
        held = mixing.pivot(sizes, p, np.random.default_rng(seed))
        assert sizes @ p == pytest.approx(sizes @ start)
        assert all(x < 1e-6 or x > 1 - 1e-6 for i, x in enumerate(p) if i != held)
        mean += p
    assert np.abs(mean / 4000 - start).max() < 0.03


def test_mixture_of_odd_rows(clashing, no_docs):
    got = mixing.mix(clashing).collect()
    assert len(got) == clashing.count()
    out = mixing.mixed(clashing)
    assert out.columns == [*clashing.columns, "copy_number"]
    assert out.count() == sum(r.copies for r in got)
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed(no_docs).count() == 0


def test_rows_that_agree_are_taken_each_by_itself(spark):
    # two rows that differ in one column only, and two that agree in all
    rows = [(1, "a b c", "en", "s"), (1, "a b c", "de", "s"), (2, "d e f", "en", "s"), (2, "d e f", "en", "s"), (3, "x " * 12, "en", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mixed(docs, weights=(1,)).collect()
    assert sorted((r["doc_id"], r["lang"]) for r in got) == sorted((r[0], r[2]) for r in rows)
    assert sorted(r["copy_number"] for r in got) == [1, 1, 1, 1, 2]
