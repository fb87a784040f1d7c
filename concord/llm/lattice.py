"""Language-model scores by a subword lattice.

A token's probability is the sum over all paths of its lattice, which has two kinds of arcs; a third place is mixed
in causally. Each is a proper distribution over all words:

* an arc over the whole word, if the training documents hold it: ``(c - d) / N``, absolute discounting with ``d``
  from the numbers of words seen once and twice. Classes of documents (languages) have counts of their own, which
  fall back on all documents; a text's probability is the mixture over the classes, so its own class is not read;
* the discounted mass goes to the arcs of pieces, for every word, counted or not: the **marginal over all
  segmentations** of the word into pieces of a public vocabulary: ``sum over paths of prod q(piece)``, a forward recursion in log space
  over the lattice of its bytes. The scores begin with the vocabulary's own: merges are ranked by how common
  they are, so a piece weighs ``1 / (rank + PIECE_SHIFT)``, single bytes a fixed share, and a word's end
  ``STOP``. ``ROUNDS`` rounds of expected piece counts then fit them to the words that the training documents
  hold once, which are most like words not seen at all; the tokenizer itself is not changed;
* what the document itself has said so far: earlier tokens, and earlier followers of the token before. Their
  weights grow with the share of repeats seen so far in the document.

How the counts reach the texts: documents are cut, in the order of the scan, into chunks of about
``CHUNK_BYTES``. A chunk keeps its tokens as numbers of its own distinct words, and sends each distinct word once
to be summed over all chunks and back. So neither the vocabulary nor a text is ever held whole by a task, and a
common word is as many rows as there are chunks.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a text ends with one end token. Null texts are empty:
one end token. Without training documents every count is 0 and all words are spelled by the lattice.
Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.llm import words
from concord.llm.store import add_rows, materialize, small_batches

CHUNK_BYTES = 8 << 20
STEP_TOKENS = 200_000
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MAX_PIECE = 8
PIECE_SHIFT = 30.0
BYTE_WEIGHT = 1e-4
STOP = 0.25
ROUNDS = 3
MAX_CLASSES = 8
PRIOR = 100.0
REPEAT, EARLY = 0.7, 20.0  # most weight of earlier tokens, and how many tokens it takes to get near it
FOLLOW, NEW = 0.1, 1.0  # weights of a follower seen once, and of followers not seen

_PIECES: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

Scores = tuple[list[np.ndarray], float]  # log scores of the pieces of each length, and of the end of a word


def pieces(path: str) -> tuple[list[np.ndarray], Scores]:
    """The pieces' bytes as sorted numbers for each length up to ``MAX_PIECE``, and their own scores.

    Pieces with upper case letters or white space other than a leading blank spell no token and are left out.
    """
    if path not in _PIECES:
        with open(path, "rb") as lines:
            ranks = [(base64.b64decode(token), int(rank)) for token, rank in map(bytes.split, lines)]
        usable = [
            (p, BYTE_WEIGHT if len(p) == 1 else 1 / (rank - 256 + PIECE_SHIFT)) for p, rank in ranks
            if len(p) <= MAX_PIECE and not any(65 <= b <= 90 or 9 <= b <= 13 for b in p) and 32 not in p[1:]
        ]
        total = sum(weight for _, weight in usable)
        keys, scores = [], []
        for n in range(1, MAX_PIECE + 1):
            own = sorted((int.from_bytes(p, "big"), np.log(weight / total * (1 - STOP))) for p, weight in usable if len(p) == n)
            keys.append(np.array([k for k, _ in own], dtype=np.uint64))
            scores.append(np.array([s for _, s in own]))
        _PIECES[path] = keys, (scores, float(np.log(STOP)))
    return _PIECES[path]


def _by_length(tokens: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, bytes) of the tokens of each length, with the blank that a word begins with; in batches of bounded size."""
    lengths = np.array([len(t) for t in tokens], dtype=np.int64)
    for length in np.unique(lengths):
        same = np.flatnonzero(lengths == length)
        step = max(1, (1 << 17) // (int(length) + 2))
        for at in range(0, len(same), step):
            rows = same[at : at + step]
            yield rows, np.frombuffer(b"".join(b" " + tokens[i] for i in rows), dtype=np.uint8).reshape(len(rows), length + 1)


def _arcs(data: np.ndarray, keys: list[np.ndarray]) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
    """For each end of a piece: (length, rows, number of the piece) of the arcs of the lattice."""
    out = []
    for end in range(1, data.shape[1] + 1):
        key = np.zeros(len(data), dtype=np.uint64)
        here = []
        for n in range(1, min(MAX_PIECE, end) + 1):
            key = key | (data[:, end - n].astype(np.uint64) << np.uint64(8 * (n - 1)))
            own = keys[n - 1]
            if len(own) == 0:
                continue
            at = np.minimum(np.searchsorted(own, key), len(own) - 1)
            rows = np.flatnonzero(own[at] == key)
            if len(rows):
                here.append((n, rows, at[rows]))
        out.append(here)
    return out


def _forward(arcs: list, n_rows: int, scores: list[np.ndarray]) -> np.ndarray:
    forward = np.full((len(arcs) + 1, n_rows), -np.inf)
    forward[0] = 0.0
    for end, here in enumerate(arcs, 1):
        for n, rows, at in here:
            forward[end, rows] = np.logaddexp(forward[end, rows], forward[end - n, rows] + scores[n - 1][at])
    return forward


def spelling(tokens: list[bytes], keys: list[np.ndarray], scores: Scores) -> np.ndarray:
    """Natural log of each token's probability summed over all segmentations; tokens of one length go together."""
    out = np.full(len(tokens), -np.inf)
    for rows, data in _by_length(tokens):
        out[rows] = _forward(_arcs(data, keys), len(rows), scores[0])[-1] + scores[1]
    return out


def expected_counts(tokens: list[bytes], keys: list[np.ndarray], scores: Scores) -> np.ndarray:
    """How often each piece is used, over all segmentations of all tokens by their probability; the pieces of all lengths in one row."""
    counts = [np.zeros(len(k)) for k in keys]
    for rows, data in _by_length(tokens):
        arcs = _arcs(data, keys)
        forward = _forward(arcs, len(rows), scores[0])
        back = np.full_like(forward, -np.inf)
        back[-1] = 0.0
        whole = forward[-1]
        for end in range(len(arcs), 0, -1):
            for n, own, at in arcs[end - 1]:
                step = scores[0][n - 1][at] + back[end, own]
                back[end - n, own] = np.logaddexp(back[end - n, own], step)
                with np.errstate(invalid="ignore"):
                    share = np.exp(forward[end - n, own] + step - whole[own])
                counts[n - 1] += np.bincount(at, weights=np.nan_to_num(share), minlength=len(counts[n - 1]))
    return np.concatenate(counts)


def refit(counts: np.ndarray, n_tokens: int, own: Scores) -> Scores:
    """Scores in proportion to expected counts, with the vocabulary's own scores as ``PRIOR`` uses."""
    flat = counts + PRIOR * np.exp(np.concatenate(own[0]))
    total = flat.sum() + n_tokens + PRIOR * np.exp(own[1])
    at = np.cumsum([len(x) for x in own[0]])[:-1]
    return np.split(np.log(flat / total), at), float(np.log((n_tokens + PRIOR * np.exp(own[1])) / total))


def fit_pieces(rare: DataFrame, vocabulary: str) -> Scores:
    """Scores fitted to the words (column ``word``) of ``rare``; the vocabulary's own if there are none."""
    keys, own = pieces(vocabulary)
    scores = own
    for _ in range(ROUNDS):
        shared = rare.sparkSession.sparkContext.broadcast(scores)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known, _ = pieces(vocabulary)
            total, n = np.zeros(sum(len(k) for k in known)), 0
            for batch in batches:
                tokens = batch.column(0).to_pylist()
                total += expected_counts(tokens, known, shared.value)
                n += len(tokens)
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([np.append(total, n).tobytes()], pa.binary())], names=["block", "sums"])

        sums = add_rows(rare.select("word").mapInArrow(run, "block int, sums binary"), np.float64).get(0)
        if sums is None or sums[-1] == 0:
            return own
        scores = refit(sums[:-1], int(sums[-1]), own)
    return scores


PACKED = "chunk long, doc_ids array<long>, held array<boolean>, classes array<int>, lengths array<long>, tokens binary, words array<struct<h:long,n:array<int>,word:binary>>"


def _pack(n_classes: int):
    """Chunks of (doc_id, text, class) rows; class -1 is held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        held, size = [], 0
        for batch in batches:
            for piece in words.slices(batch, 1):
                held.append(piece)
                size += len(piece[1])
                if size >= CHUNK_BYTES:
                    yield _chunk((part << 32) + seq, held, n_classes)
                    seq, held, size = seq + 1, [], 0
        if held:
            yield _chunk((part << 32) + seq, held, n_classes)

    return run


def _chunk(name: int, parts: list, n_classes: int) -> pa.RecordBatch:
    ids = [i for rows, _, _ in parts for i in rows.column(0).to_pylist()]
    kind = np.concatenate([rows.column(2).to_numpy(zero_copy_only=False) for rows, _, _ in parts]).astype(np.int64)
    split = [words.split(data, offsets) for _, data, offsets in parts]
    lengths = np.concatenate([w.counts() for w in split])
    hashes = np.concatenate([w.hash for w in split])
    h, first, local, n = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    # common words get small numbers, which pack well
    order = np.argsort(-n, kind="stable")
    place = np.empty(len(h), dtype=np.int64)
    place[order] = np.arange(len(h))
    local, h, first = place[local], h[order], first[order]
    of = np.repeat(kind, lengths)
    by_class = np.bincount(local[of >= 0] * n_classes + of[of >= 0], minlength=len(h) * n_classes).reshape(len(h), n_classes)
    counts = by_class.sum(axis=1)
    # the bytes of every word: all go through the lattice
    shift = np.cumsum([0, *[len(w.data) for w in split]])
    data = np.concatenate([w.data for w in split])
    start, end = (np.concatenate([getattr(w, side) + at for w, at in zip(split, shift)])[first] for side in ("start", "end"))
    ends = np.concatenate([[0], np.cumsum(end - start)])
    spelt = data[np.arange(ends[-1]) + np.repeat(start - ends[:-1], end - start)]
    names = pa.Array.from_buffers(pa.binary(), len(h), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(spelt)])
    # counts up to the last class with any
    size = np.where(counts > 0, n_classes - np.argmax(by_class[:, ::-1] > 0, axis=1), 0)
    flat = by_class[np.arange(n_classes)[None, :] < size[:, None]]
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(flat.astype(np.int32)))
    own = pa.StructArray.from_arrays([pa.array(h.view(np.int64)), lists, names], names=["h", "n", "word"])
    kinds = {"chunk": pa.int64(), "doc_ids": pa.list_(pa.int64()), "held": pa.list_(pa.bool_()), "classes": pa.list_(pa.int32()), "lengths": pa.list_(pa.int64()), "tokens": pa.binary()}
    row = {"chunk": name, "doc_ids": ids, "held": (kind < 0).tolist(), "classes": kind.tolist(), "lengths": lengths.tolist(), "tokens": zlib.compress(local.astype("<i4").tobytes(), 1)}
    return pa.RecordBatch.from_arrays(
        [*(pa.array([v], kinds[k]) for k, v in row.items()), pa.ListArray.from_arrays(pa.array([0, len(h)], pa.int32()), own)], names=[*row, "words"]
    )


class _Groups:
    """Entries with equal keys, in their order; one sort serves ranks and running sums."""

    def __init__(self, key: np.ndarray):
        self.order = np.argsort(key, kind="stable")
        ordered = key[self.order]
        starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
        sizes = np.diff(np.concatenate([starts, [len(key)]]))
        self.first = np.repeat(starts, sizes)

    def rank(self) -> np.ndarray:
        """For each entry, how many earlier ones have its key."""
        out = np.empty(len(self.order), dtype=np.int64)
        out[self.order] = np.arange(len(self.order)) - self.first
        return out

    def sum_before(self, values: np.ndarray) -> np.ndarray:
        """For each entry, the sum of ``values`` of the earlier ones with its key."""
        ordered = values[self.order]
        total = np.cumsum(ordered) - ordered
        out = np.empty_like(total)
        out[self.order] = total - total[self.first]
        return out


def history(tokens: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): a token has the probability ``a * stated + b`` given those before it in its document.

    ``stated`` is its probability without the document; ``tokens`` are numbers of words, documents are consecutive.
    """
    n = len(tokens)
    if n == 0:
        return np.zeros(0), np.zeros(0)
    doc = doc - doc[0]
    new = np.concatenate([[True], doc[1:] != doc[:-1]])
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    place = np.arange(n) - first
    width = int(tokens.max()) + 2
    seen = _Groups(doc * width + tokens).rank()
    again = np.cumsum(seen > 0) - (seen > 0)
    earlier = REPEAT * (again - again[first]) / (place + EARLY)
    # what followed the token before, earlier in the document
    before = np.concatenate([[-1], tokens[:-1]])
    before[new] = -1
    followed = doc * width + before + 1
    pair_seen = _Groups(followed * width + tokens).rank()
    after = _Groups(followed)
    times = after.rank()
    kinds = after.sum_before((pair_seen == 0).astype(np.int64))
    follow = np.where((before >= 0) & (times > 0), (times - kinds + FOLLOW) / (times + NEW), 0.0)
    return (1 - follow) * (1 - earlier), (1 - follow) * earlier * seen / np.maximum(place, 1) + follow * pair_seen / np.maximum(times, 1)


@dataclass
class Counts:
    """What all chunks know of the training documents: per class, tokens, distinct words, ends and share of documents."""

    tokens: np.ndarray
    distinct: np.ndarray
    ends: np.ndarray
    discount: float
    total: int
    kinds: int

    def logs(self, c: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        """(classes x words) natural logs of the words' probabilities; the last word is the end. ``c`` counts words by class."""
        d, all_c = self.discount, c.sum(axis=0)
        if self.total == 0:
            return np.where(np.arange(len(all_c)) == len(all_c) - 1, np.log(STOP), np.log(1 - STOP) + spelled)[None, :]
        with np.errstate(divide="ignore"):
            # the arc of the whole word, and all paths of pieces
            common = np.logaddexp(np.log(np.maximum(all_c - d, 0) / self.total), np.log(max(d * self.kinds, d) / self.total) + spelled)
            # a class falls back on all documents with the mass that discounting leaves it
            back = np.log(d * self.distinct / np.maximum(self.tokens, 1))[:, None] + common[None, :]
            own = np.log(np.maximum(c - d, 0) / np.maximum(self.tokens, 1)[:, None])
        return np.logaddexp(own, back)


def _scorer(known: Counts, vocabulary: str, scores, n_classes: int):
    """Scores the documents of a chunk from its packed row and its words' counts."""

    def run(key: tuple, packed: pa.Table, counted: pa.Table) -> pa.Table:
        out: dict[str, list] = {n: [] for n in ("doc_id", "held_out", "n_tokens", "n_known", "base_score", "score")}
        if packed.num_rows:
            ids, held = packed.column("doc_ids")[0].as_py(), packed.column("held")[0].as_py()
            lengths = np.array(packed.column("lengths")[0].as_py(), dtype=np.int64)
            tokens = np.frombuffer(zlib.decompress(packed.column("tokens")[0].as_py()), dtype="<i4").astype(np.int64)
            n_words, at = counted.num_rows, counted.column("at").to_numpy()
            c = np.zeros((n_classes, n_words + 1), dtype=np.int64)
            for k in range(n_classes):
                c[k, at] = counted.column(f"c{k}").to_numpy()
            c[:, n_words] = known.ends
            spelled = np.full(n_words + 1, -np.inf)
            spelled[at] = spelling(counted.column("word").to_pylist(), pieces(vocabulary)[0], scores.value)
            stated = known.logs(c, spelled)
            plain = np.exp(stated)
            base = np.log10((c.sum(axis=0) + 0.1) / (known.total + 0.1 * (known.kinds + 1)))
            counted_word = c.sum(axis=0) > 0
            by_class, base_scores, n_known = np.zeros((len(stated), len(ids))), np.zeros(len(ids)), np.zeros(len(ids), dtype=np.int64)
            starts = np.concatenate([[0], np.cumsum(lengths)])
            at_doc = 0
            while at_doc < len(ids):
                # some whole documents at a time
                to = max(at_doc + 1, int(np.searchsorted(starts, starts[at_doc] + STEP_TOKENS, side="right")) - 1)
                own = lengths[at_doc:to]
                # every document ends with the end token
                doc = np.repeat(np.arange(to - at_doc), own + 1)
                full = np.full(len(doc), n_words, dtype=np.int64)
                inside = np.ones(len(doc), dtype=bool)
                inside[np.cumsum(own + 1) - 1] = False
                full[inside] = tokens[starts[at_doc] : starts[to]]
                a, b = history(full, doc)
                per_doc = lambda x: np.bincount(doc, weights=x, minlength=to - at_doc)  # noqa: B023, E731
                for k in range(len(stated)):
                    p = a * plain[k, full] + b
                    # beyond the range of doubles the stated probability itself is the score
                    logs = np.log10(np.maximum(p, 1e-300))
                    low = p <= 1e-280
                    logs[low] = np.log10(a[low]) + stated[k, full[low]] / np.log(10)
                    by_class[k, at_doc:to] = per_doc(logs)
                base_scores[at_doc:to] = per_doc(base[full])
                n_known[at_doc:to] = per_doc(counted_word[full]).astype(np.int64)
                at_doc = to
            # a document is of one class, in the proportions of the training documents
            shares = known.ends / known.ends.sum() if known.total else np.ones(1)
            by_class = np.stack([x + np.log10(s) for x, s in zip(by_class, shares, strict=True) if s > 0])
            best = by_class.max(axis=0)
            out = {
                "doc_id": ids, "held_out": held, "n_tokens": (lengths + 1).tolist(), "n_known": n_known.tolist(), "base_score": base_scores.tolist(),
                "score": (best + np.log10(np.sum(10 ** (by_class - best), axis=0))).tolist(),
            }
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))

    return run


def score(docs: DataFrame, held_out: Column, classes: str | None = "lang", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; learned from the rows that are not held out.

    ``classes`` names a column whose most frequent values in the training documents, ``MAX_CLASSES`` at most, have
    counts of their own; all other values share one class. It is read for learning only.
    """
    small_batches(docs)
    label = F.col(classes).cast("string") if classes else F.lit("")
    rows = docs.select("doc_id", "text", held_out.alias("held"), label.alias("label"))
    top = rows.filter("NOT held AND label IS NOT NULL").groupBy("label").count().orderBy(F.desc("count"), "label").limit(MAX_CLASSES).collect()
    numbers = {r["label"]: i for i, r in enumerate(top)}
    n_classes = len(numbers) + 1
    number = F.lit(n_classes - 1)
    for value, i in numbers.items():
        number = F.when(F.col("label") == value, i).otherwise(number)
    packed = materialize(rows.select("doc_id", "text", F.when(F.col("held"), -1).otherwise(number).cast("int").alias("class")).mapInArrow(_pack(n_classes), PACKED))
    sent = packed.select("chunk", F.posexplode("words").alias("at", "w")).select("chunk", "at", "w.*")
    # a word is as many rows as chunks hold it; the window streams and spills
    everywhere = Window.partitionBy("h").orderBy("chunk").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.row_number().over(Window.partitionBy("h").orderBy("chunk")) == 1
    per = [F.sum(F.coalesce(F.get("n", F.lit(k)), F.lit(0))).over(everywhere).alias(f"c{k}") for k in range(n_classes)]
    counted = sent.select("chunk", "at", "word", *per, first.alias("first"), (F.aggregate("n", F.lit(0), lambda s, x: s + x) == 1).alias("holds"))
    total = sum((F.col(f"c{k}") for k in range(1, n_classes)), F.col("c0"))
    counted = counted.withColumn("c", total).select("chunk", "at", "c", *[f"c{k}" for k in range(n_classes)], "first", "holds", "word")
    counted = materialize(counted)
    once = F.col("first")
    facts = counted.filter(once).agg(
        F.count(F.when(F.col("c") == 1, 1)).alias("once"), F.count(F.when(F.col("c") == 2, 1)).alias("twice"), F.count(F.when(F.col("c") > 0, 1)).alias("kinds"),
        *[F.sum(f"c{k}").alias(f"n{k}") for k in range(n_classes)], *[F.count(F.when(F.col(f"c{k}") > 0, 1)).alias(f"v{k}") for k in range(n_classes)],
    ).first()
    ends = packed.select(F.explode("classes").alias("k")).filter("k >= 0").groupBy("k").count().collect()
    per_class = np.zeros(n_classes, dtype=np.int64)
    for k, n in ends:
        per_class[k] = n
    n = np.array([int(facts[f"n{k}"] or 0) for k in range(n_classes)]) + per_class
    v = np.array([int(facts[f"v{k}"]) for k in range(n_classes)]) + (per_class > 0)
    discount = min(0.95, max(0.05, facts["once"] / (facts["once"] + 2 * facts["twice"]))) if facts["once"] + facts["twice"] else 0.5
    known = Counts(n, v, per_class, discount, int(n.sum()), int(facts["kinds"]) + int(per_class.sum() > 0))
    fitted = docs.sparkSession.sparkContext.broadcast(fit_pieces(counted.filter("c = 1 AND holds"), vocabulary))
    scores = packed.drop("words", "classes").groupBy("chunk").cogroup(counted.drop("first", "holds").groupBy("chunk")).applyInArrow(
        _scorer(known, vocabulary, fitted, n_classes), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return scores.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(known.total).cast("long").alias("train_tokens"), "base_score", "score")
