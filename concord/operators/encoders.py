"""Text encoders: hashed TF-IDF, and any model that turns a list of texts into a matrix."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.functions.vectors import vectors
from concord.runtime import materialize

BUCKETS = 1 << 12
BATCH_BYTES = 4 << 20
WORDS_KEPT = 1 << 16

_WORD = re.compile(rb"[a-z0-9]+")

Encoder = Callable[[list[str]], np.ndarray]

# models of this worker process, by name; tasks that reuse the process find them loaded
_LOADED: dict[str, Encoder] = {}


def hashed_tfidf(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(id, buckets, weights) of (id, text): sparse TF-IDF vectors of length one, buckets ascending.

    Words are runs of a-z and 0-9 after A-Z are lower-cased; a word's bucket is the start of its MD5. The weight is
    count * ln((documents + 1) / (documents with the bucket + 1)). Ids are unique. Null texts and texts without words
    have empty arrays; a vector of weights that are all zero stays zero.

    A text is one row, so its words are counted where it is read and only sums of document frequencies are shuffled,
    at most ``buckets`` of them. The counts are written, as they are read twice.
    """
    schema = T.StructType([docs.schema["id"], T.StructField("buckets", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.LongType()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            found, n, ends = [], [], [0]
            for text in batch.column("text").to_pylist():
                cells = _bucket_counts(text, buckets, known)
                found += cells
                n += cells.values()
                ends.append(len(found))
            at = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(found, pa.int32())), pa.ListArray.from_arrays(at, pa.array(n, pa.int64()))]
            yield pa.record_batch([batch.column("id"), *lists], names=["id", "buckets", "counts"])

    counts = materialize(docs.select("id", "text").mapInArrow(count, schema))
    frequencies = counts.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("df"))
    documents = docs.agg(F.count(F.lit(1))).scalar()
    # a weight for each of the buckets, in their order
    rare = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(F.broadcast(frequencies), "bucket", "left").select(
        "bucket", F.log((documents + 1) / (F.coalesce("df", F.lit(0)) + 1)).alias("idf")
    )
    rare = rare.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "idf"))), lambda c: c["idf"]).alias("idf"))
    raw = F.zip_with("buckets", "counts", lambda b, n: n * F.get("idf", b))
    weighed = counts.crossJoin(F.broadcast(rare)).select("id", "buckets", raw.alias("raw"))
    norm = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda total, w: total + w * w))
    return weighed.withColumn("norm", norm).select("id", "buckets", F.transform("raw", lambda w: F.when(F.col("norm") > 0, w / F.col("norm")).otherwise(0.0)).alias("weights"))


def _bucket_counts(text: str | None, buckets: int, known: dict[bytes, int]) -> dict[int, int]:
    """Words of ``text`` by bucket, ascending. ``known`` keeps the buckets of words met before, WORDS_KEPT at most."""
    cells: dict[int, int] = {}
    # of bytes, lower() changes A-Z only
    for word, n in Counter(_WORD.findall((text or "").encode().lower())).items():
        bucket = known.get(word)
        if bucket is None:
            if len(known) >= WORDS_KEPT:
                known.clear()
            bucket = known[word] = int(hashlib.md5(word).hexdigest()[:8], 16) % buckets
        cells[bucket] = cells.get(bucket, 0) + n
    return dict(sorted(cells.items()))


def encode_texts(docs: DataFrame, name: str, load: Callable[[], Encoder], text: str = "text", out: str = "vec", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``docs`` with a column ``out`` of vectors (array of double) from the model that ``load`` returns.

    ``load`` runs once in a worker process for each ``name``, not once a task or batch. The model is called with
    texts of together at most ``batch_bytes`` (a longer text by itself) and returns one row for each. Null texts have
    a null vector and are not sent to the model; empty ones are. A result of another shape is an error, and so is an
    input column that is already named ``out``.
    """
    if out in docs.columns:
        raise ValueError(f"a column {out} is there already")
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _LOADED:
            _LOADED[name] = load()
        for batch in batches:
            size = np.array([len(t.encode()) if t is not None else 0 for t in batch.column(place).to_pylist()], dtype=np.int64)
            start = 0
            while start < len(size):
                # as many whole texts as fit, one at least
                end = start + max(1, int(np.searchsorted(np.cumsum(size[start:]), batch_bytes, side="right")))
                part = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([*part.columns, _encoded(_LOADED[name], part.column(place).to_pylist())], names=[*docs_columns, out])
                start = end

    docs_columns = docs.columns
    return docs.mapInArrow(run, schema)


def _encoded(encode: Encoder, texts: list[str | None]) -> pa.Array:
    known = [t for t in texts if t is not None]
    rows = np.asarray(encode(known), dtype=np.float64) if known else np.zeros((0, 0))
    if rows.ndim != 2 or len(rows) != len(known):
        raise ValueError(f"the encoder returned shape {rows.shape} for {len(known)} texts")
    place, at = [], 0
    for t in texts:
        place.append(None if t is None else at)
        at += t is not None
    return vectors(rows).take(pa.array(place, pa.int32()))
