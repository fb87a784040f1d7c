"""Toxic passages: maximal scoring segments of token log-odds, judged by extreme-value statistics.

1. Token scores. Words (lower-case runs of letters, digits and non-ASCII bytes) of a bounded sample of
   labelled documents (``max_labelled``) are counted by class, in toxic texts once for each pair of
   neighbours, so copies of one text count once; the log-odds between the classes are smoothed
   by a Dirichlet prior in proportion to the word's count over **all** documents. Words of at least ``LEAST_DOCS``
   toxic texts whose log-odds reach ``LEAST_ODDS`` and whose uses lie ``Z_LEAST`` deviations off keep their score (at most ``CEILING``); every other word costs ``drift``.
2. Segments. One linear scan finds all maximal scoring segments of a text (disjoint, none can be extended or
   joined to gain). Runs of words without a score are one negative step, so the scan visits scored words only.
3. Calibration. For scores with a negative mean, the number of segments of score S in n words of clean text
   is about ``K n exp(-lambda S)``; lambda is the root of ``sum p_s exp(lambda s) = 1`` over the clean word
   distribution and K comes from the clean documents of the sample. Segments whose expected number is below
   ``expected_most`` are the reported passages. The document's surprise, ``-log(1 - exp(-E))`` for its best
   segment plus what the others add, goes through a logistic curve fitted on the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.llm import words
from concord.llm.quality import labelled_sample
from concord.llm.store import materialize, small_batches

MAX_LABELLED = 20_000
PRIOR_WORDS, PRIOR_SHARE = 2_000.0, 0.01  # words of the prior, at most this share of the smaller class
Z_LEAST = 6.0
LEAST_DOCS = 3
LEAST_ODDS = 3.0  # twenty times as common in toxic texts: less is what a subject or a language does
DRIFT = 0.05
CEILING = 8.0
EXPECTED_MOST = 0.05

PASSAGE = "start int, end int, score double, expected double"


def segments(steps: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, sum) of a sequence, in one pass over it.

    Candidates are kept with the running sum before and after them. A new candidate is joined with the last
    one that starts from a lower sum, if the new one ends higher; else it stands for itself.
    """
    kept: list[tuple[int, int, float, float]] = []  # first, last, sum before, sum after
    back: list[int] = []  # for each candidate, the nearest earlier one with a lower sum before it
    total = 0.0
    for i, step in enumerate(steps):
        before, total = total, total + step
        if step <= 0:
            continue
        first, last, low, high = i, i, before, total
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= low:
                j = back[j]
            if j < 0 or kept[j][3] >= high:
                kept.append((first, last, low, high))
                back.append(j)
                break
            first, low = kept[j][0], kept[j][2]
            del kept[j:], back[j:]
    return [(first, last, high - low) for first, last, low, high in kept]


@dataclass
class Model:
    """``known`` (sorted word hashes), their scores, the drift, and the calibration."""

    known: np.ndarray
    scores: np.ndarray
    drift: float = DRIFT
    rate: float = 1.0  # lambda
    log_k: float = 0.0
    slope: float = 1.0
    offset: float = 0.0

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, list[tuple[int, int, float, float]]]]:
        """For each document (words, segments as (first byte, end byte, score, expected number))."""
        w = words.split(data, offsets, words.ALNUM)
        counts = w.counts()
        out: list[tuple[int, list]] = [(int(c), []) for c in counts]
        if len(self.known) == 0 or len(w.hash) == 0:
            return out
        at = np.minimum(np.searchsorted(self.known, w.hash), len(self.known) - 1)
        hit = np.flatnonzero(self.known[at] == w.hash)
        if len(hit) == 0:
            return out
        hit_doc = w.doc[hit]
        for part in np.split(hit, np.flatnonzero(hit_doc[1:] != hit_doc[:-1]) + 1):
            doc = int(w.doc[part[0]])
            # scored word, then the unscored words up to the next one as a single step
            steps = np.empty(2 * len(part) - 1)
            steps[::2] = self.scores[at[part]]
            steps[1::2] = -self.drift * (np.diff(part) - 1)
            found = []
            for first, last, total in segments(steps.tolist()):
                expected = float(np.exp(np.clip(self.log_k + np.log(max(1, counts[doc])) - self.rate * total, -700, 700)))
                found.append((int(w.start[part[first // 2]]), int(w.end[part[last // 2]]), total, expected))
            out[doc] = (int(counts[doc]), found)
        return out

    @staticmethod
    def surprise(found: list[tuple[int, int, float, float]]) -> float:
        """-log10 of the chance of the best segment, and a little for each further significant one; 0 without."""
        if not found:
            return 0.0
        best = sorted((f[3] for f in found))
        chance = lambda e: -np.expm1(-e) if e < 30 else 1.0
        return float(sum(-np.log10(max(chance(e), 1e-300)) for e in best[:1] + [e for e in best[1:] if e < EXPECTED_MOST]))

    def probability(self, surprise: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * np.log1p(surprise) + self.offset, -35, 35))))


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, context, doc, clean): one row per word, pair of neighbours and toxic text, and counts in clean ones (context null)."""
    for batch in batches:
        for rows, data, offsets in words.slices(batch, 1):
            w = words.split(data, offsets, words.ALNUM)
            toxic = np.asarray(rows.column(2)).astype(bool)[w.doc] if len(w.doc) else np.zeros(0, dtype=bool)
            h, n = np.unique(w.hash[~toxic], return_counts=True)
            # the words before and after, within the text
            beside = np.zeros((2, len(w.hash)), dtype=np.uint64)
            if len(w.hash) > 1:
                same = w.doc[1:] == w.doc[:-1]
                beside[0, 1:] = np.where(same, w.hash[:-1], 0)
                beside[1, :-1] = np.where(same, w.hash[1:], 0)
            context = words.mix(beside[0] + np.uint64(1)) + words.mix(words.mix(beside[1]))
            docs = rows.column(0).to_numpy()[w.doc[toxic]].view(np.uint64) if toxic.any() else np.zeros(0, dtype=np.uint64)
            seen = np.unique(np.stack([w.hash[toxic], context[toxic], docs]), axis=1)
            k = seen.shape[1]
            none = np.arange(len(h) + k) < len(h)
            column = lambda values: pa.array(np.concatenate([np.zeros_like(h), values]).view(np.int64), mask=none)  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([h, seen[0]]).view(np.int64)), column(seen[1]), column(seen[2]), pa.array(np.concatenate([n, np.zeros(k, dtype=np.int64)]))],
                names=["h", "context", "doc", "clean"],
            )


def _corpus_counts(candidates):
    """Counts of the candidate words, and of all words (hash null), over a task's whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = candidates.value
        total, counts = 0, np.zeros(len(known), dtype=np.int64)
        for batch in batches:
            for _, data, offsets in words.slices(batch, 0):
                w = words.split(data, offsets, words.ALNUM)
                total += len(w.hash)
                if len(known) and len(w.hash):
                    at = np.minimum(np.searchsorted(known, w.hash), len(known) - 1)
                    counts += np.bincount(at[known[at] == w.hash], minlength=len(known))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([None, *known[used].view(np.int64).tolist()], pa.int64()), pa.array([total, *counts[used].tolist()], pa.int64())], names=["h", "n"])

    return run


def prior_words(n_toxic: int, n_clean: int) -> float:
    return max(1.0, min(PRIOR_WORDS, PRIOR_SHARE * min(n_toxic, n_clean)))


def log_odds(toxic: np.ndarray, clean: np.ndarray, corpus: np.ndarray, n_toxic: int, n_clean: int, n_corpus: int) -> tuple[np.ndarray, np.ndarray]:
    """(log-odds, z) of words between two classes.

    The odds are smoothed by prior words in the shares of the corpus; z says how many standard deviations more
    of a word's uses are in toxic texts than the classes' sizes let expect.
    """
    total = prior_words(n_toxic, n_clean)
    prior = total * (corpus + 1) / (n_corpus + 1)
    a, b = toxic + prior, clean + prior
    delta = np.log(a / np.maximum(n_toxic + total - a, 1e-9)) - np.log(b / np.maximum(n_clean + total - b, 1e-9))
    share, uses = n_toxic / max(1, n_toxic + n_clean), toxic + clean
    return delta, (toxic - share * uses) / np.sqrt(np.maximum(share * (1 - share) * uses, 1e-9))


def decay_rate(scores: np.ndarray, shares: np.ndarray, drift: float) -> float:
    """lambda > 0 with ``sum share exp(lambda score) = 1``, where the rest of the words score ``-drift``."""
    rest = 1 - shares.sum()
    value = lambda r: float(np.sum(shares * np.exp(r * scores)) + rest * np.exp(-r * drift)) - 1
    low, high = 1e-6, 1.0
    if len(scores) == 0 or value(low) >= 0:
        return low if len(scores) else 1.0
    while value(high) < 0 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return low


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a slightly ridged logistic fit by Newton steps."""
    w = np.zeros(2)
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -35, 35)))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + np.diag([1e-2, 1e-2])
        w = w + np.clip(np.linalg.solve(hessian, design.T @ (y - p) - 1e-2 * w), -2, 2)
    return float(w[0]), float(w[1])


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", max_labelled: int = MAX_LABELLED, drift: float = DRIFT) -> Model:
    """The model of labels allowed by ``usable`` and of the word counts of all ``docs``.

    Without documents of both classes no word has a score, and every text gets the smoothed share of label 1.
    """
    small_batches(docs)
    sample = materialize(labelled_sample(docs, labels, label, usable, max_labelled).dropDuplicates(["doc_id"]).select("doc_id", "text", "y"))
    counts = materialize(
        sample.mapInArrow(_class_counts, "h long, context long, doc long, clean long")
        .groupBy("h").agg(F.count_distinct("context").alias("toxic"), F.count_distinct("doc").alias("docs"), F.sum("clean").alias("clean"))
    )
    n_toxic, n_clean = (int(v or 0) for v in counts.agg(F.sum("toxic"), F.sum("clean")).first())
    # a word of few texts is not evidence. What is left is bounded by the words of the sample
    rows = np.array(counts.filter(F.col("docs") >= LEAST_DOCS).select("h", "toxic", "clean").toPandas().to_numpy(), dtype=np.int64).reshape(-1, 3)
    h = rows[:, 0].copy().view(np.uint64)
    order = np.argsort(h)
    h, toxic, clean = h[order], rows[order, 1], rows[order, 2]
    shared = docs.sparkSession.sparkContext.broadcast(h)
    corpus, n_corpus = np.zeros(len(h), dtype=np.int64), 0
    for word, n in docs.select("text").mapInArrow(_corpus_counts(shared), "h long, n long").groupBy("h").agg(F.sum("n")).collect():
        if word is None:
            n_corpus = int(n)
        else:
            corpus[np.searchsorted(h, np.array([word], dtype=np.int64).view(np.uint64)[0])] = n
    delta, z = log_odds(toxic, clean, corpus, n_toxic, n_clean, n_corpus)
    chosen = (z >= Z_LEAST) & (delta >= LEAST_ODDS) & (n_toxic > 0) & (n_clean > 0)
    scores = np.minimum(delta[chosen], CEILING)
    # the share that the prior gives an unseen word keeps lambda finite
    unseen = 0.01 * prior_words(n_toxic, n_clean)
    shares = (clean[chosen] + unseen * (corpus[chosen] + 1) / (n_corpus + 1)) / max(1, n_clean + unseen)
    model = Model(h[chosen], scores, drift, decay_rate(scores, shares, drift))
    return _calibrate(model, sample)


def _calibrate(model: Model, sample: DataFrame) -> Model:
    """K from the best segments of clean documents, then the curve; both over the sample's documents."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def scan(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        found = shared.value.scan(data, offsets)
        return pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array([n for n, _ in found], pa.int64()), pa.array([[s[2] for s in x] for _, x in found], pa.list_(pa.float64()))], names=["doc_id", "y", "n", "sums"])

    rows = sample.mapInArrow(words.map_slices(scan), "doc_id long, y int, n long, sums array<double>").orderBy("doc_id").collect()
    y = np.array([r["y"] for r in rows], dtype=np.float64)
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        model.slope, model.offset = 0.0, float(np.log(share / (1 - share)))
        return model
    # expected number of segments of score S in n words, summed over clean documents, against the number found
    clean = [(r["n"], r["sums"]) for r in rows if r["y"] == 0]
    total = sum(n for n, _ in clean)
    found = np.array([s for _, sums in clean for s in sums])
    model.log_k = float(np.log((np.sum(np.exp(np.minimum(model.rate * found, 50)) >= 1) + 1) / (total + 1))) if len(found) else -np.log(total + 1.0)
    if len(found):
        # at the least score of a segment all are counted, so shift by it
        model.log_k += model.rate * float(found.min())
    x = []
    for r in rows:
        e = np.exp(np.clip(model.log_k + np.log(max(1, r["n"])) - model.rate * np.array(r["sums"], dtype=np.float64), -700, 700))
        x.append(Model.surprise([(0, 0, 0.0, float(v)) for v in e]))
    model.slope, model.offset = _logistic(np.log1p(np.array(x)), y)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, passages) of every row: the probability of label 1 and the significant passages.

    ``start`` and ``end`` of a passage are positions in the characters of the text. Null and empty texts
    have no passages and the score of a text without surprise.
    """
    small_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    passage = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))

    def run(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        m = shared.value
        found = m.scan(data, offsets)
        # characters before a byte: bytes that do not continue a character
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)]) if any(x for _, x in found) else None
        out = []
        for d, (_, x) in enumerate(found):
            out.append([
                {"start": int(lead[a] - lead[offsets[d]]), "end": int(lead[b] - lead[offsets[d]]), "score": s, "expected": e}
                for a, b, s, e in x if e < EXPECTED_MOST
            ])
        p = [m.probability(Model.surprise(x)) for _, x in found]
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(p, pa.float64()), pa.array(out, passage)], names=["doc_id", "score", "passages"])

    return docs.select("doc_id", "text").mapInArrow(words.map_slices(run), f"doc_id long, score double, passages array<struct<{PASSAGE.replace(' ', ':').replace(',:', ',')}>>")
