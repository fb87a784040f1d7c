"""Filter interaction audit: what each of several filters removes in every order of applying them.

1. Each document gets a mask of the filters that it fails; documents are counted by part and mask, so there are at most
   32 rows a part whatever the corpus, each weighted by its documents, good and toxic ones.
2. Removal steps. ``M`` (masks x filters) is 0 where the mask fails the filter and infinite elsewhere; ``P`` (filters x
   orders) is the inverse permutation, a filter's position in the order. The min-plus product ``min over filters of
   M + P`` is the step at which an order removes the mask.
3. Weights are scattered to (order, step): removed documents to the removal step, redundant ones to the later
   positions of the other filters that they fail.

Filters: A under 200 words, B fewer than half the words distinct, C more than 3 % capitals, D holds a symbol, E equal
to the text of a smaller id anywhere in the table. Words are runs of other characters than ASCII white space.

Cases: a null text is an empty one: it fails A, and E if a smaller id has none either. A null language is the part '',
as an empty one is. Rows of one id are not smaller than each other; a row without an id is smaller than none and has
none smaller. A document labelled twice is good (toxic) if any label says so. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.llm.store import join_shared, materialize

NAMES = "ABCDE"
WEIGHTS = ("documents", "good", "toxic")
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
NEVER = 1 << 20


def text_failures(text: Column) -> list[Column]:
    """Whether a text, not null, fails A, B, C and D."""
    found = F.filter(F.split(text, "[ \\t-\\r]+", -1), lambda w: w != "")
    n, distinct = F.size(found), F.size(F.array_distinct(found))
    capitals = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]", ""))
    return [n < 200, 100 * distinct < 50 * n, 100 * capitals > 3 * F.char_length(text), text.rlike("[#$%&*|]")]


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask int) of every row: bit ``i`` is 1 if it fails filter ``i``."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    bits = [F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(text_failures(F.col("text")))]
    rows = materialize(rows.select("doc_id", "part", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), sum(bits[1:], bits[0]).alias("own")))
    first = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    joined = join_shared(rows, materialize(first), ["h1", "h2"], "n", rows.count(), "left")
    again = F.when(F.col("doc_id") > F.col("first"), F.lit(1 << len(bits))).otherwise(F.lit(0))
    return joined.select("doc_id", "part", (F.col("own") + again).alias("mask"))


def removal_steps(n_filters: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(orders, positions, steps): orders x step -> filter, filters x order -> step, masks x order -> removal step (from 0)."""
    orders = np.array(list(itertools.permutations(range(n_filters))))
    positions = np.argsort(orders, axis=1).T
    fails = (np.arange(1 << n_filters)[:, None] >> np.arange(n_filters)) & 1
    m = np.where(fails == 1, 0, NEVER)
    return orders, positions, np.minimum((m[:, :, None] + positions[None]).min(axis=1), NEVER)


def part_counts(mask: np.ndarray, weights: np.ndarray, n_filters: int) -> dict[str, np.ndarray]:
    """Each of COUNTS as orders x steps, from masks and their (masks x 3) weights."""
    orders, positions, steps = removal_steps(n_filters)
    n_orders = len(orders)
    at = np.arange(n_orders)
    # a row for what is never removed takes the rest
    removed = np.zeros((n_orders, n_filters + 1, weights.shape[1]), dtype=np.int64)
    redundant = np.zeros((n_orders, n_filters), dtype=np.int64)
    alone = np.zeros(n_filters, dtype=np.int64)
    for m, w in zip(mask, weights, strict=True):
        step = steps[m]
        np.add.at(removed, (at, np.minimum(step, n_filters)), w)
        failed = np.flatnonzero((m >> np.arange(n_filters)) & 1)
        for f in failed:
            later = np.flatnonzero(positions[f] > step)
            np.add.at(redundant, (later, positions[f][later]), w[0])
        if len(failed) == 1:
            alone[failed[0]] += w[0]
    here = removed[:, :n_filters]
    shapley = np.zeros(n_filters, dtype=np.int64)
    np.add.at(shapley, orders, here[:, :, 0])
    kept = weights[:, 0].sum() - np.cumsum(here[:, :, 0], axis=1)
    return dict(zip(COUNTS, (kept, here[:, :, 0], redundant, alone[orders], here[:, :, 1], here[:, :, 2], shapley[orders]), strict=True))


def _audit_part(names: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = part_counts(rows["mask"].to_numpy(), rows[list(WEIGHTS)].to_numpy(dtype=np.int64), len(names))
        orders = ["".join(p) for p in itertools.permutations(names)]
        out = {"part": rows["part"].iloc[0], "filter_order": np.repeat(orders, len(names)), "step": np.tile(np.arange(1, len(names) + 1, dtype=np.int32), len(orders))}
        return pd.DataFrame(out | {c: found[c].reshape(-1) for c in COUNTS})

    return run


def audit(masks: DataFrame, labels: DataFrame, names: str = NAMES) -> DataFrame:
    """(part, filter_order, step, counts) of every part, order and step, from (doc_id, part, mask) rows."""
    marks = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    counted = masks.join(marks, "doc_id", "left").groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")
    )
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)
    # at most one row for each mask in a group
    return counted.groupBy("part").applyInPandas(_audit_part(names), schema)
