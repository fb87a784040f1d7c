"""Connected components of link tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.runtime import intermediate_tables, materialize


# A bounded remainder that is finished without another distributed round.
FINISH_LINKS = 4096


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of the (a, b) links; the component is its smallest node.

    Each round points every node to its smallest neighbour, follows the pointers twice, and replaces the nodes
    of the links by what they point to; links within a node go. A star of any size is one round. Minima are
    aggregated before they are shuffled, and a node of many links is a skewed join of narrow rows at most. Rounds run
    until FINISH_LINKS or fewer links are left; that remainder is finished directly.
    """
    with intermediate_tables(links.sparkSession):
        edges = materialize(links.select("a", "b").filter("a <> b").distinct())
        labels = materialize(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")))
        while len(rest := edges.limit(FINISH_LINKS + 1).collect()) > FINISH_LINKS:
            both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(edges.select("b", "a"))
            down = materialize(both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("to")))
            jump = down.select(F.col("node").alias("to"), F.col("to").alias("further"))
            to = materialize(down.join(jump, "to").select("node", F.col("further").alias("to")))
            jump = to.select(F.col("node").alias("to"), F.col("to").alias("further"))
            to = materialize(to.join(jump, "to").select("node", F.col("further").alias("to")))
            labels = materialize(
                labels.join(to.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
            )
            a, b = to.select(F.col("node").alias("a"), F.col("to").alias("x")), to.select(F.col("node").alias("b"), F.col("to").alias("y"))
            edges = materialize(edges.join(a, "a").join(b, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        return materialize(_pointed(labels, rest) if rest else labels, result=True)


def _pointed(labels: DataFrame, rest: list) -> DataFrame:
    """``labels`` after the last ``rest`` of links between their components, FINISH_LINKS at most."""
    names = sorted({n for link in rest for n in link})
    place = {n: i for i, n in enumerate(names)}
    ends = np.array([[place[n] for n in link] for link in rest])
    kind = labels.schema["component"].dataType
    to = labels.sparkSession.createDataFrame(
        [(names[i], names[j]) for i, j in forest(ends[:, 0], ends[:, 1])], T.StructType([T.StructField("component", kind), T.StructField("to", kind)])
    )
    return labels.join(F.broadcast(to), "component", "left").select("node", F.coalesce("to", "component").alias("component"))


def extended_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The :func:`components` of all links, from those of the ones before (``labels``) and the new ``links``.

    Only links between different components are followed, so the work is that of the new links and one pass over the labels.
    """
    with intermediate_tables(links.sparkSession):
        links = links.select("a", "b")
        for end in ("a", "b"):
            named = labels.select(F.col("node").alias(end), F.col("component").alias("named"))
            links = links.join(named, end, "left").withColumn(end, F.coalesce("named", end)).drop("named")
        joined = components(links)
        to = joined.select(F.col("node").alias("component"), F.col("component").alias("to"))
        moved = labels.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        return materialize(moved.unionByName(joined.join(labels.select("node"), "node", "left_anti")), result=True)


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For links between nodes 0..n-1, (node, smallest node of its class) of every linked node but the smallest ones."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        new = new[new]
        if (new == root).all():
            break
        root = new[new]
    moved = root != np.arange(len(nodes))
    return np.stack([nodes[moved], nodes[root[moved]]], axis=1)


def _joined(comp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The components ``comp`` of nodes after the links between the components ``a`` and ``b``."""
    moved = forest(a, b)
    to = np.arange(len(comp))
    to[moved[:, 0]] = moved[:, 1]
    return to[comp]


def least_forest(n: int, keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the links (a, b) between nodes 0..n-1 make the spanning forest of least ``keys``, all different."""
    comp, held, taken = np.arange(n), np.arange(len(keys)), []
    while True:
        held = held[comp[a[held]] != comp[b[held]]]
        if not len(held):
            return np.concatenate(taken) if taken else held
        best = np.full(n, np.iinfo(np.int64).max)
        for end in (a, b):
            np.minimum.at(best, comp[end[held]], keys[held])
        own = held[(keys[held] == best[comp[a[held]]]) | (keys[held] == best[comp[b[held]]])]
        taken.append(own)
        comp = _joined(comp, comp[a[own]], comp[b[own]])


def least_block_forest(n: int, keys: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) places of the spanning forest of least ``keys`` of a matrix of links.

    ``rows`` and ``cols`` name its nodes among 0..n-1. A place that is the largest integer is no link; the two places
    of one pair may have the same key, all others differ.
    """
    none = np.iinfo(np.int64).max
    comp, found = np.arange(n), []
    while True:
        ends_a, ends_b = comp[rows], comp[cols]
        open_keys = np.where(ends_a[:, None] == ends_b[None, :], none, keys)
        by_row, by_col = open_keys.argmin(axis=1), open_keys.argmin(axis=0)
        i = np.concatenate([np.arange(len(rows)), by_col])
        j = np.concatenate([by_row, np.arange(len(cols))])
        value = open_keys[i, j]
        best = np.full(n, none)
        np.minimum.at(best, ends_a[i], value)
        np.minimum.at(best, ends_b[j], value)
        own = np.flatnonzero((value < none) & ((value == best[ends_a[i]]) | (value == best[ends_b[j]])))
        if not len(own):
            break
        own = own[np.unique(value[own], return_index=True)[1]]
        found.append((i[own], j[own]))
        comp = _joined(comp, comp[rows[i[own]]], comp[cols[j[own]]])
    empty = np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate([f[side] for f in found]) if found else empty for side in (0, 1))
