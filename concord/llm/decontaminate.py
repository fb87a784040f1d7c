"""Benchmark decontamination: one Aho-Corasick automaton over the items' windows, one scan of each text.

Words are runs of letters, digits and non-ASCII characters of the text with A-Z lower-cased. A window is
``width`` consecutive words of an item (question or answer); an item of fewer words, but not none, is one
window. The normalised text holds its words between single spaces, so a pattern with its surrounding spaces
matches whole words only; matches are mapped back to words, and words to characters of the original.

The automaton is built in the tasks from the broadcast item texts. Their size is checked first: items beyond
``block_words`` words are dealt to several automata of that size, which scan one after the other.

Null and empty texts have no words. Items without words match nothing; an item without an id is reported
under the empty id. Items with equal windows are all reported. Repeated rows are judged row by row.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm import words
from concord.llm.store import small_batches

WIDTH = 10
BLOCK_WORDS = 200_000
HITS = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"

# upper case to lower case, every byte outside words to a space
_TO_WORDS = bytes(int(words.LOWER[b]) if words.ALNUM[b] else 0x20 for b in range(256))
_AUTOMATA: dict[tuple, ahocorasick.Automaton] = {}


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


def windows(text: str | None, width: int) -> Iterator[tuple[str, int]]:
    """(pattern, words) of an item's windows."""
    w = normal_words(text)
    for i in range(max(0, len(w) - width) + 1 if w else 0):
        piece = w[i : i + width]
        yield " " + b" ".join(piece).decode() + " ", len(piece)


def automaton(items: list[tuple[str, str]], width: int) -> ahocorasick.Automaton:
    """Windows of (id, text) items; the value of a pattern is its (number of words, ids)."""
    patterns: dict[str, tuple[int, set[str]]] = {}
    for item, text in items:
        for pattern, n in windows(text, width):
            patterns.setdefault(pattern, (n, set()))[1].add(item)
    machine = ahocorasick.Automaton()
    for pattern, (n, ids) in patterns.items():
        machine.add_word(pattern, (n, tuple(sorted(ids))))
    if patterns:
        machine.make_automaton()
    return machine


def _machine(key: tuple, items: list[tuple[str, str]], width: int) -> ahocorasick.Automaton:
    """Built once in a Python worker; only the last one used is held."""
    if key not in _AUTOMATA:
        _AUTOMATA.clear()
        _AUTOMATA[key] = automaton(items, width)
    return _AUTOMATA[key]


def scan(machine: ahocorasick.Automaton, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
    """(number of words, hit stretches as (first, end) words, ids of the items with occurring windows)."""
    w = normal_words(text)
    if not w or len(machine) == 0:
        return len(w), [], set()
    normal = " " + b" ".join(w).decode() + " "
    found: list[tuple[int, int]] = []
    items: set[str] = set()
    ends = np.zeros(0)
    for at, (n, ids) in machine.iter(normal):
        if not found:
            # the space after word i
            ends = np.flatnonzero(np.frombuffer(normal.encode("utf-32-le"), dtype=np.uint32) == 32) - 1
        last = int(np.searchsorted(ends, at - 1))
        items.update(ids)
        found.append((last - n, last))
    merged: list[tuple[int, int]] = []
    for first, end in sorted(found):
        if merged and first <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((first, end))
    return len(w), merged, items


def word_positions(text: str, stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(start, end) characters in the original of stretches of words."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    w = words.split(data, np.array([0, len(data)]), words.ALNUM, lower=False, hashed=False)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return [(int(chars[w.start[a]]), int(chars[w.end[b - 1]])) for a, b in stretches]


def _items(benchmark: DataFrame, block_words: int) -> list[list[tuple[str, str]]]:
    """The items in blocks whose texts hold about ``block_words`` words; one block for a benchmark of usual size."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.col("text").alias("t")).filter("t IS NOT NULL").distinct()
    blocks: list[list[tuple[str, str]]] = []
    size = block_words
    for i, t in rows.orderBy("i", "t").toLocalIterator():
        n = len(normal_words(t))
        if size + n > block_words or not blocks:
            blocks.append([])
            size = 0
        blocks[-1].append((i, t))
        size += n
    return blocks or [[]]


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, sorted items, and the hit stretches in characters of the text."""
    return docs.select("doc_id", "text").mapInArrow(_scanner(docs, benchmark, width, block_words, False, 1), HITS)


def keep_clean(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` in which no window occurs, in their own columns."""
    return docs.mapInArrow(_scanner(docs, benchmark, width, block_words, True, docs.columns.index("text")), docs.schema)


def _scanner(docs: DataFrame, benchmark: DataFrame, width: int, block_words: int, only_filter: bool, at: int):
    small_batches(docs)
    blocks = docs.sparkSession.sparkContext.broadcast(_items(benchmark, block_words))
    call = uuid.uuid4().hex
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(at), "")
            counts = np.zeros(len(texts), dtype=np.int64)
            hits: dict[int, tuple[list, set]] = {}
            for b, items in enumerate(blocks.value):
                machine = _machine((call, b, width), items, width)
                for i, text in enumerate(texts):
                    text = text.as_py()
                    counts[i], found, ids = scan(machine, text)
                    if found:
                        held = hits.setdefault(i, ([], set()))
                        held[0].extend(found)
                        held[1].update(ids)
            if only_filter:
                keep = np.ones(len(texts), dtype=bool)
                keep[list(hits)] = False
                yield batch.filter(pa.array(keep))
                continue
            n_hit, names, spans = np.zeros(len(texts), dtype=np.int64), [[] for _ in texts], [[] for _ in texts]
            for i, (found, ids) in hits.items():
                merged: list[tuple[int, int]] = []
                for first, end in sorted(found):
                    if merged and first <= merged[-1][1]:
                        merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
                    else:
                        merged.append((first, end))
                n_hit[i] = sum(e - f for f, e in merged)
                names[i] = sorted(ids)
                spans[i] = [{"start": a, "end": b} for a, b in word_positions(texts[i].as_py(), merged)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts), pa.array(n_hit), pa.array(names, pa.list_(pa.string())), pa.array(spans, span)],
                names=["doc_id", "n_words", "n_hit", "items", "spans"],
            )

    return run
