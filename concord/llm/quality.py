"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every word has a sparse ternary index vector drawn from its hash. A word's vector is the sum of the index
vectors of its neighbours (two on either side) over **all** documents, in a table of ``slots`` rows to which
words are hashed, so the model has the same size for any corpus. Sums are integers, so they do not depend on
the order of the tasks. A document is the mean of its words' unit vectors and of their squares; a two-layer
network is fitted to a bounded sample of labelled rows (``max_labelled``) and its logits are divided by a
temperature fitted on rows that the network did not see.

Words are runs of letters, digits and non-ASCII bytes, and runs of other visible characters; case counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.llm import words
from concord.llm.store import add_rows, small_batches

SLOTS = 1 << 15
DIMS = 32
NONZERO = 2
WINDOW = 2
BLOCK = 256
MAX_LABELLED = 20_000
HIDDEN = 24
EPOCHS = 400
POOL_BYTES = 1 << 18  # of text whose word vectors are in memory together

_KINDS = np.where(words.ALNUM, 1, np.where(words.NOT_SPACE & (np.arange(256) > 0x20), 2, 0)).astype(np.uint8)


def _index_entries(h: np.ndarray, dims: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(position, sign) of the non-zero entries of the index vector of each word hash."""
    out = []
    for i in range(NONZERO):
        bits = words.mix(h + np.uint64(i + 1))
        out.append(((bits % np.uint64(dims)).astype(np.int64), 1 - 2 * (bits >> np.uint64(63)).astype(np.int64)))
    return out


def _tokens(data: np.ndarray, offsets: np.ndarray, slots: int) -> tuple[words.Words, np.ndarray]:
    w = words.split_classes(data, offsets, _KINDS)
    return w, (w.hash >> np.uint64(20)).astype(np.int64) % slots


def _context_sums(slots: int, dims: int):
    """Per task: the context matrix of its documents, in blocks of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots * dims, dtype=np.int64)
        for batch in batches:
            for _, data, offsets in words.slices(batch, 0):
                w, slot = _tokens(data, offsets, slots)
                entries = _index_entries(w.hash, dims)
                for step in range(1, WINDOW + 1):
                    if len(slot) <= step:
                        continue
                    near = w.doc[step:] == w.doc[:-step]
                    for position, sign in entries:
                        for here, there in ((slice(None, -step), slice(step, None)), (slice(step, None), slice(None, -step))):
                            total += np.bincount(
                                (slot[here] * dims + position[there])[near], weights=sign[there][near], minlength=slots * dims
                            ).astype(np.int64)
        yield from _blocks(total.reshape(-1, BLOCK * dims))

    return run


def _blocks(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    used = np.flatnonzero(rows.any(axis=1))
    if len(used):
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([rows[i].tobytes() for i in used], pa.binary())], names=["block", "sums"])


def context_vectors(docs: DataFrame, slots: int = SLOTS, dims: int = DIMS) -> np.ndarray:
    """The (slots x dims) unit word vectors of all texts of ``docs``; a slot without words is zero.

    The result has ``slots * dims`` numbers for any corpus, so it may be held on the driver and broadcast.
    """
    small_batches(docs)
    # a block is 64 KB of sums from each task; most of a small task's are zero and compress
    parts = docs.select("text").mapInArrow(_context_sums(slots, dims), "block int, sums binary")
    matrix = np.zeros((slots // BLOCK, BLOCK * dims), dtype=np.float64)
    for block, sums in add_rows(parts, blocks=len(matrix)).items():
        matrix[block] = sums
    matrix = matrix.reshape(slots, dims)
    length = np.linalg.norm(matrix, axis=1)
    return np.divide(matrix, length[:, None], out=np.zeros_like(matrix), where=length[:, None] > 0).astype(np.float32)


def pooled(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """(documents x 2 dims): means of the word vectors and of their squares; zero without words."""
    slots, dims = vectors.shape
    w, slot = _tokens(data, offsets, slots)
    counts = w.counts()
    out = np.zeros((w.n_docs, 2 * dims))
    filled = np.flatnonzero(counts)
    if len(filled):
        # words of a document are consecutive
        first = np.concatenate([[0], np.cumsum(counts[filled])[:-1]])
        rows = vectors[slot].astype(np.float64)
        out[filled, :dims] = np.add.reduceat(rows, first, axis=0) / counts[filled, None]
        out[filled, dims:] = np.add.reduceat(rows * rows, first, axis=0) / counts[filled, None]
    return out


class Network:
    """Two layers, tanh between them; standardised inputs; logits over a temperature."""

    def __init__(self, shift, scale, w1, b1, w2, b2, temperature=1.0):
        self.shift, self.scale, self.w1, self.b1, self.w2, self.b2, self.temperature = shift, scale, w1, b1, w2, b2, temperature

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.shift) / self.scale, -8, 8)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -35, 35)))


def _loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Adam on the log loss of four fifths of the rows (given in random order), temperature on the rest.

    Without rows of both classes it answers their smoothed share (0.5 without any row).
    """
    d = x.shape[1]
    share = (y.sum() + 1) / (len(y) + 2)
    zero = Network(np.zeros(d), np.ones(d), np.zeros((d, hidden)), np.zeros(hidden), np.zeros(hidden), float(np.log(share / (1 - share))))
    held = np.arange(len(y)) % 5 == 4
    fit_x, fit_y = x[~held], y[~held]
    if len(set(fit_y.tolist())) < 2:
        return zero
    rng = np.random.default_rng(seed)
    net = Network(fit_x.mean(0), fit_x.std(0) + 1e-6, rng.normal(0, 1 / np.sqrt(d), (d, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), 0.0)
    names = ("w1", "b1", "w2", "b2")
    mean, square = {n: 0.0 for n in names}, {n: 0.0 for n in names}
    z = np.clip((fit_x - net.shift) / net.scale, -8, 8)
    for step in range(1, epochs + 1):
        a = np.tanh(z @ net.w1 + net.b1)
        error = (1 / (1 + np.exp(-np.clip(a @ net.w2 + net.b2, -35, 35))) - fit_y) / len(fit_y)
        back = np.outer(error, net.w2) * (1 - a * a)
        grads = {"w1": z.T @ back + 1e-4 * net.w1, "b1": back.sum(0), "w2": a.T @ error + 1e-4 * net.w2, "b2": error.sum()}
        for n, g in grads.items():
            mean[n] = 0.9 * mean[n] + 0.1 * g
            square[n] = 0.999 * square[n] + 0.001 * g * g
            setattr(net, n, getattr(net, n) - 0.01 * (mean[n] / (1 - 0.9**step)) / (np.sqrt(square[n] / (1 - 0.999**step)) + 1e-8))
    if held.any() and len(set(y[held].tolist())) == 2:
        logits = net.logits(x[held])
        net.temperature = float(min(np.geomspace(0.25, 8, 41), key=lambda t: _loss(logits / t, y[held])))
    return net


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, limit: int) -> DataFrame:
    """(doc_id, text, label) of at most ``limit`` labelled documents, the first in the order of a hash of the id.

    A document labelled twice takes the larger share, and is left out on a tie; null labels are none.
    """
    votes = labels.select("doc_id", F.col(label).cast("double").alias("y")).filter("doc_id IS NOT NULL AND y IS NOT NULL").filter(usable)
    chosen = (
        votes.groupBy("doc_id").agg(F.avg("y").alias("y")).filter("y <> 0.5")
        .select("doc_id", (F.col("y") > 0.5).cast("int").alias("y"), F.xxhash64("doc_id").alias("o"))
        .orderBy("o", "doc_id").limit(limit)
    )
    # at most ``limit`` ids: a bounded broadcast
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", max_labelled: int = MAX_LABELLED, slots: int = SLOTS, dims: int = DIMS) -> tuple[np.ndarray, Network]:
    """(word vectors, network). ``usable`` says by doc_id which labels may be learned from."""
    vectors = context_vectors(docs, slots, dims)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def features(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        x = pooled(data, offsets, shared.value)
        return pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), rows.column(3), pa.array([v.tobytes() for v in x], pa.binary())], names=["doc_id", "y", "o", "x"])

    sample = labelled_sample(docs, labels, label, usable, max_labelled)
    # repeated ids of documents: one of each, so the bound on rows holds
    table = sample.mapInArrow(words.map_slices(features, limit=POOL_BYTES), "doc_id long, y int, o long, x binary")
    rows = sorted(table.groupBy("doc_id", "y", "o").agg(F.min("x").alias("x")).collect(), key=lambda r: (r["o"], r["doc_id"]))
    shared.destroy()
    x = np.frombuffer(b"".join(r["x"] for r in rows), dtype=np.float64).reshape(len(rows), 2 * dims)
    return vectors, fit_network(x, np.array([r["y"] for r in rows], dtype=np.float64))


def score(docs: DataFrame, vectors: np.ndarray, network: Network) -> DataFrame:
    """(doc_id, score) of every row of ``docs``: the probability of label 1; null and empty texts have one too."""
    small_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast((vectors, network))

    def run(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        table, net = shared.value
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(net.probability(pooled(data, offsets, table)))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(words.map_slices(run, limit=POOL_BYTES), "doc_id long, score double")


def keep_good(docs: DataFrame, vectors: np.ndarray, network: Network, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose probability reaches ``threshold``, in their own columns and types."""
    small_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast((vectors, network))
    at = docs.columns.index("text")

    def run(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        table, net = shared.value
        return rows.filter(pa.array(net.probability(pooled(data, offsets, table)) >= threshold))

    return docs.mapInArrow(words.map_slices(run, at, POOL_BYTES), docs.schema)
