"""Words of whole texts as NumPy arrays: boundaries and 64-bit hashes, without a Python object per word.

Texts are cut into slices of bounded size (a longer text is a slice of its own), so a task holds a few
arrays of that size whatever the batch. A null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """Membership of the 256 byte values, from inclusive ranges."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


# words of the contracts: runs of bytes that are no ASCII white space, and runs of letters, digits and non-ASCII
NOT_SPACE = ~byte_set((0x20, 0x20), (0x09, 0x0D))
ALNUM = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser of each entry."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# a pseudo-random 64-bit value for each byte value
_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            grown = np.full(n, base, dtype=np.uint64)
            grown[0] = 1
            _POWERS[name] = np.cumprod(grown)
    return _POWERS["up"], _POWERS["down"]


@dataclass
class Words:
    """``hash``, ``start`` and ``end`` (byte positions in ``data``) and ``doc`` of each word, in text order."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n_docs(self) -> int:
        return len(self.offsets) - 1

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets) of a string column; nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or len(at) == 0 or at[-1] == at[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def split(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = NOT_SPACE, lower: bool = True, hashed: bool = True) -> Words:
    """Maximal runs of bytes of ``inside`` in each text, lower-cased (A-Z only) for the hash."""
    n = len(data)
    if lower:
        data = LOWER[data]
    if n == 0:
        none = np.zeros(0, dtype=np.int64)
        return Words(np.zeros(0, dtype=np.uint64), none, none, none, data, offsets)
    word = inside[data]
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    opens, closes = word.copy(), word.copy()
    opens[1:] &= ~word[:-1] | first[1:n]
    closes[:-1] &= ~word[1:] | first[1:n]
    return _words(data, offsets, np.flatnonzero(opens), np.flatnonzero(closes) + 1, hashed)


def split_classes(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray) -> Words:
    """Maximal runs of bytes of one non-zero kind (``kinds`` maps byte values to kinds; 0 separates)."""
    n = len(data)
    if n == 0:
        return split(data, offsets, lower=False)
    kind = kinds[data]
    change = np.ones(n + 1, dtype=bool)
    change[1:n] = kind[1:] != kind[:-1]
    change[offsets] = True
    at = np.flatnonzero(change)
    keep = kind[at[:-1]] != 0
    return _words(data, offsets, at[:-1][keep], at[1:][keep], True)


def _words(data: np.ndarray, offsets: np.ndarray, start: np.ndarray, end: np.ndarray, hashed: bool) -> Words:
    doc = np.searchsorted(offsets, start, side="right") - 1
    if not hashed:
        return Words(np.zeros(0, dtype=np.uint64), start, end, doc, data, offsets)
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[data] * up[: len(data)], out=total[1:])
    h = (total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)
    return Words(mix(h), start, end, doc, data, offsets)


def slices(batch: pa.RecordBatch, text: int, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of consecutive rows whose texts hold about ``limit`` bytes together."""
    if batch.num_rows == 0:
        return
    data, offsets = raw(batch.column(text))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def map_slices(fn: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], pa.RecordBatch], text: int = 1, limit: int = SLICE_BYTES) -> Callable:
    """For ``mapInArrow``: ``fn`` of every slice of every batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, text, limit):
                yield fn(rows, data, offsets)

    return run


def per_doc(values: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    return np.bincount(doc, weights=values, minlength=n_docs)
