"""N-gram Jaccard join: exact near-duplicate classes by pivots, distance windows and recursion.

A document's set holds its distinct word shingles; two documents link when ``100 * |A & B| >= percent * |A | B|``,
that is when their Jaccard distance, a metric, is at most ``eps = 1 - percent / 100``.

1. Equal sets are one point of the space (a 64-bit sum over the set's shingle hashes names it), so copies are
   never compared. Points get their **rarest** shingles as keys, ``n - ceil(n * percent / 100) + 1`` of them:
   two points within ``eps`` share a key, as one of them would else lack too many shingles. Rarity is read from
   tables of hashed counts of words and shingles over all texts; any common order is exact, this one keeps
   shared passages and phrases out.
2. Pivots. The first points under each key are pivots: each further point of the key is measured against them.
   Points that share no key with a pivot are farther than ``eps`` from it. (Pivots drawn at random cannot
   divide this space: most texts are at distance 1 from each other, so they would be on every border.) A key of
   up to ``LEAF`` points is done then; the others of a longer key are members of its first pivot's region.
3. Windows. Two members of a region can only link if their distances to the pivot differ by ``eps`` at most
   (triangle inequality), and if their counts in ``CLASSES`` disjoint classes of shingles, their distances to
   the classes as it were, do not already differ by more than the symmetric difference allows. A point on the
   border of several regions is a member of each.
4. Recursion. Regions whose members are not yet one class go on with ``PIVOTS`` times as many pivots, taken from
   outside the largest class and nearest to the former pivot first, until they are one class or all those have
   been pivots. So every pair of members that may link is compared, or is in one class already.

Only classes are wanted, so links within a class need not be listed. Sets are loaded for compared points only.
Hashes have 64 bits: at N distinct shingles in two compared texts a false match has a chance of about N / 2^64.

Defined cases: null and blank texts have the empty set and are alone; a text of fewer words than ``width`` is
one shingle; repeated rows and copies share a class whose name is the smallest id in it (null ids never
name a class with other ids, and a class of null ids has a null name); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concord.llm import words
from concord.operators.graph import components, extended_components
from concord.llm.store import add_rows, intermediate_tables, materialize, may_match, partitions_for, small_batches

SLOTS = 1 << 20
BLOCK = 1 << 14
CLASSES = 128
PIVOTS = 16
LEAF = 8
SALTS = 16
SLICE_BYTES = 1 << 18  # of text whose words are in a task's memory together
STEPS = 1000

_SALT = np.uint64(0xD6E8FEB86659FD93)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int, word_counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, least count of its words) of every shingle, in text order, repeats included."""
    w = words.split(data, offsets)
    counts = w.counts()
    if len(w.hash) == 0:
        return w.hash, w.doc, w.doc
    each = np.zeros(len(w.hash), dtype=np.int64) if word_counts is None else word_counts[_slot(w.hash)]
    h = words.mix(w.hash + np.uint64(width))
    n = len(h) - width + 1
    full = np.zeros(0, dtype=np.uint64)
    doc = least = np.zeros(0, dtype=np.int64)
    if n > 0:
        same = w.doc[:n] == w.doc[width - 1 :]
        full = h[:n]
        for i in range(1, width):
            full = words.mix(full + _SALT) + h[i : n + i]
        least = each[:n]
        for i in range(1, width):
            least = np.minimum(least, each[i : n + i])
        full, doc, least = words.mix(full)[same], w.doc[:n][same], least[same]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        first = np.searchsorted(w.doc, short)
        rest = []
        for d, at in zip(short, first, strict=True):
            value = np.array([counts[d]], dtype=np.uint64)
            for x in h[at : at + counts[d]]:
                value = words.mix(value + _SALT) + x
            rest.append(words.mix(value ^ _SALT))
        full, doc, least = np.concatenate([full, *rest]), np.concatenate([doc, short]), np.concatenate([least, each[first]])
        order = np.argsort(doc, kind="stable")
        full, doc, least = full[order], doc[order], least[order]
    return full, doc, least


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int, word_counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes, ascending within a document; where each document's set begins; least counts of their words)."""
    h, doc, least = shingles(data, offsets, width, word_counts)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    first = np.ones(len(h), dtype=bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[first], doc[first]
    return h, np.searchsorted(doc, np.arange(len(offsets))), least[order][first]


def key_count(n: int, percent: int) -> int:
    """Keys of a set of ``n``: one more than it may lack of a linked set."""
    return n - -(-n * percent // 100) + 1 if n else 0


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(44)).astype(np.int64)


def _slot_counts(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, SLOTS), dtype=np.int64)
        for batch in batches:
            for _, data, offsets in words.slices(batch, 0, SLICE_BYTES):
                h, _, _ = shingles(data, offsets, width)
                np.add.at(total[0], _slot(h), 1)
                np.add.at(total[1], _slot(words.split(data, offsets).hash), 1)
        rows = total.reshape(-1, BLOCK)
        used = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([rows[i].tobytes() for i in used], pa.binary())], names=["block", "sums"])

    return run


def _level(counts: np.ndarray) -> np.ndarray:
    """Counts on a logarithmic scale of STEPS to a doubling, in two bytes each; only their order is used."""
    return np.rint(np.log2(1.0 + counts) * STEPS).astype(np.uint16)


def slot_levels(docs: DataFrame, width: int) -> np.ndarray:
    """(2 x SLOTS) levels of the occurrences of shingles and of words in all texts, by hash slot; as many numbers for any corpus."""
    parts = docs.select("text").mapInArrow(_slot_counts(width), "block int, sums binary")
    out = np.zeros((2 * SLOTS // BLOCK, BLOCK), dtype=np.uint16)
    for block, sums in add_rows(parts, blocks=len(out), finish=_level, out=np.uint16).items():
        out[block] = sums
    return out.reshape(2, SLOTS)


POINTS = "doc_id long, row long, n long, point long, classes array<byte>, keys array<long>"


def points(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, row, n, point, classes, keys) of every document; ``row`` is a hash of the text, ``point`` null for the empty set.

    A task gives the keys of a point once, with its first document of that set.
    """
    common = docs.sparkSession.sparkContext.broadcast(slot_levels(docs, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for rows, data, offsets in words.slices(batch, 1, SLICE_BYTES):
                h, at, least = shingle_sets(data, offsets, width, common.value[1])
                n = np.diff(at)
                point = np.zeros(len(n), dtype=np.uint64)
                some = np.flatnonzero(n)
                if len(some):
                    point[some] = words.mix(np.add.reduceat(words.mix(h ^ _SALT), at[some]) + n[some].astype(np.uint64))
                doc = np.repeat(np.arange(len(n)), n)
                classes = np.bincount(doc * CLASSES + (h & np.uint64(CLASSES - 1)).astype(np.int64), minlength=len(n) * CLASSES)
                # cut at what a byte holds, which keeps differences lower bounds
                classes = np.minimum(classes, 127).astype(np.int8)
                together = common.value[0][_slot(h)]
                keys: list[np.ndarray] = []
                for d in range(len(n)):
                    name = int(point[d])
                    if n[d] == 0 or name in seen:
                        keys.append(h[:0])
                        continue
                    seen.add(name)
                    own, q = h[at[d] : at[d + 1]], key_count(int(n[d]), percent)
                    # linked sets of this size are equal, and so one point
                    part = slice(at[d], at[d + 1])
                    keys.append(own[np.lexsort((own, together[part], least[part]))[:q]] if q > 1 or n[d] * 100 >= (n[d] + 1) * percent else h[:0])
                lengths = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    rows.column(0), rows.column(2), pa.array(n), pa.array(point.view(np.int64), mask=n == 0),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * CLASSES), pa.array(classes)),
                    pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate([*keys, h[:0]]).view(np.int64))),
                ], names=["doc_id", "row", "n", "point", "classes", "keys"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("row")).mapInArrow(run, POINTS)


def _pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pivot, point, deep) from rows ordered by key and point.

    Each point meets the first ``LEAF - 1`` points of its keys, so keys of up to ``LEAF`` points are done. The
    further points of longer keys are the region (deep) of the key's first point.
    """
    held_key, held = 0, np.zeros(0, dtype=np.int64)  # the first points of the last key, at most LEAF of them
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        k, p = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        fresh = np.ones(len(k), dtype=bool)
        fresh[1:] = (k[1:] != k[:-1]) | (p[1:] != p[:-1])
        fresh[0] = last != (k[0], p[0])
        last = (k[-1], p[-1])
        k, p = k[fresh], p[fresh]
        if len(k) == 0:
            continue
        carried = len(held) if len(held) and held_key == k[0] else 0
        k = np.concatenate([np.full(carried, k[0], dtype=np.int64), k])
        p = np.concatenate([held[:carried], p])
        start = np.ones(len(k), dtype=bool)
        start[1:] = k[1:] != k[:-1]
        first = np.flatnonzero(start)[np.cumsum(start) - 1]
        place = np.arange(len(k)) - first
        new = np.arange(len(k)) >= carried
        pivots, points, deep = [], [], []
        for s in range(LEAF - 1):
            at = np.flatnonzero(new & (place > s))
            pivots.append(p[first[at] + s])
            points.append(p[at])
            deep.append((place[at] >= LEAF - 1) & (s == 0))
        held_key, held = k[-1], p[first[-1] : first[-1] + LEAF]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (pivots, points, deep)], names=["pivot", "point", "deep"])


class _Space:
    """Points with their sizes and class counts, and the sets of those that were compared."""

    def __init__(self, docs: DataFrame, table: DataFrame, width: int, percent: int):
        self.docs, self.table, self.width, self.percent = docs, table, width, percent
        # one document for each point; equal sets have equal sizes and counts
        self.known = materialize(
            table.filter("point IS NOT NULL").groupBy("point").agg(
                F.min(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), "row", "n", "classes")).alias("one")
            ).select("point", "one.*")
        )
        self.sets: DataFrame | None = None

    def near_enough(self, n_a, n_b, c_a, c_b):
        """Whether sizes and class counts leave room for a link: each class differs by at most its part of the symmetric difference."""
        apart = F.aggregate(F.zip_with(c_a, c_b, lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x.cast("int"))
        # a symmetric difference of s leaves (n_a + n_b - s) / 2 in common at most
        most = (n_a + n_b - apart) / 2
        sizes = 100 * F.least(n_a, n_b) >= self.percent * F.greatest(n_a, n_b)
        return sizes & F.when(sizes, 100 * most >= self.percent * (n_a + n_b - most))

    def possible(self, pairs: DataFrame, *kept: str) -> DataFrame:
        """The (a, b) pairs that sizes and class counts do not rule out, with their sizes and the ``kept`` columns."""
        side = lambda end, *columns: self.known.select(F.col("point").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns])
        # sizes first: they are short and rule out most pairs
        sized = pairs.join(side("a", "n"), "a").join(side("b", "n"), "b").filter(100 * F.least("n_a", "n_b") >= self.percent * F.greatest("n_a", "n_b"))
        joined = sized.join(side("a", "classes"), "a").join(side("b", "classes"), "b")
        return joined.filter(self.near_enough(F.col("n_a"), F.col("n_b"), F.col("classes_a"), F.col("classes_b"))).select("a", "b", "n_a", "n_b", *kept)

    def _load(self, needed: DataFrame) -> None:
        """Adds the sets of those ``needed`` points that are not loaded yet; they outlast the comparison that needs them first."""
        missing = materialize(needed if self.sets is None else needed.join(self.sets.select("point"), "point", "left_anti"))
        if self.sets is not None and missing.isEmpty():
            return
        width = self.width

        def run(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
            h, at, _ = shingle_sets(data, offsets, width)
            return pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(h.view(np.int64)))], names=["point", "shingles"])

        chosen = materialize(missing.join(self.known, "point").select("point", "id", "row"))
        texts = self.docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("row"), "text")
        # names of documents are as many as documents: the texts are shuffled to them at any size, none go through the driver;
        # most texts that are not needed stay where they are, by a bitmap of the names' slots
        loaded = may_match(texts, chosen, ["id", "row"]).join(chosen.hint("merge"), ["id", "row"]).select("point", "text").mapInArrow(words.map_slices(run, 1, SLICE_BYTES), "point long, shingles array<long>")
        # a repeated row gives its point's set twice
        loaded = materialize(loaded.groupBy("point").agg(F.first("shingles").alias("shingles")), result=True)
        self.sets = loaded if self.sets is None else self.sets.unionByName(loaded)

    def compare(self, pairs: DataFrame) -> DataFrame:
        """(a, b, distance, linked) of distinct (a, b, n_a, n_b) pairs."""
        with intermediate_tables(pairs.sparkSession):
            pairs = materialize(pairs)
            needed = materialize(pairs.select(F.explode(F.array("a", "b")).alias("point")).distinct())
            self._load(needed)
            # only the sets of these pairs are moved
            sets = self.sets.join(needed.hint("merge"), "point", "left_semi")
            a = sets.select(F.col("point").alias("a"), F.col("shingles").alias("s_a"))
            b = sets.select(F.col("point").alias("b"), F.col("shingles").alias("s_b"))
            shared = pairs.join(a, "a").join(b, "b").select("a", "b", (F.col("n_a") + F.col("n_b")).alias("total"), F.size(F.array_intersect("s_a", "s_b")).alias("i"))
            union = F.col("total") - F.col("i")
            return materialize(shared.select("a", "b", (1 - F.col("i") / union).alias("distance"), (100 * F.col("i") >= self.percent * union).alias("linked")), result=True)


def _live(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members, with their classes, of regions that are not one class; ``rest`` tells those outside the region's largest class."""
    members = members.drop("label", "rest").join(labels.withColumnRenamed("node", "point"), "point", "left")
    members = members.withColumn("label", F.coalesce("component", "point")).drop("component")
    sizes = members.groupBy("region", "label").agg(F.count(F.lit(1)).alias("k"))
    regions = sizes.groupBy("region").agg(F.max(F.struct("k", "label")).alias("top"), F.count(F.lit(1)).alias("labels")).filter("labels > 1")
    regions = materialize(regions.select("region", F.col("top.label").alias("main")))
    return materialize(members.join(regions, "region").withColumn("rest", F.col("label") != F.col("main")).drop("main"))


def linked_classes(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, row, n_shingles, component_id, class) of every row of ``docs``; ``class`` names the class whatever its ids, null for empty sets."""
    small_batches(docs)
    with intermediate_tables(docs.sparkSession):
        docs = docs.select("doc_id", "text")
        eps = 1 - percent / 100
        table = materialize(points(docs, width, percent))
        space = _Space(docs, table, width, percent)
        keyed = table.select(F.explode("keys").alias("key"), "point")
        # ordered rows stream through a task, however many share a key
        seeds = keyed.repartition(partitions_for(docs), "key").sortWithinPartitions("key", "point").mapInArrow(_pivots, "pivot long, point long, deep boolean")
        seeds = materialize(seeds.groupBy("pivot", "point").agg(F.count(F.lit(1)).alias("keys"), F.max("deep").alias("deep")))
        # each point first meets the pivot it shares most keys with: most of a family is then one class, whose other pairs need no sets
        pairs = materialize(space.possible(seeds.select(F.col("pivot").alias("a"), F.col("point").alias("b"), "keys"), "keys"))
        nearest = pairs.groupBy("b").agg(F.max(F.struct("keys", "a", "n_a", "n_b")).alias("best")).select("best.a", "b", "best.n_a", "best.n_b")
        found = space.compare(nearest)
        known = components(found.filter("linked").select("a", "b"))
        rest = pairs
        for end in ("a", "b"):
            rest = rest.join(known.select(F.col("node").alias(end), F.col("component").alias(f"class_{end}")), end, "left")
        apart = F.coalesce("class_a", "a") != F.coalesce("class_b", "b")
        others = rest.filter(apart).select("a", "b", "n_a", "n_b").join(found.select("a", "b"), ["a", "b"], "left_anti")
        more = space.compare(others)
        labels, found = extended_components(known, more.filter("linked").select("a", "b")), found.unionByName(more)
        near = found.select(F.col("a").alias("region"), F.col("b").alias("point"), F.col("distance").alias("near"))
        # a region without the first points of its key, which have met every member
        members = seeds.filter("deep").select(F.col("pivot").alias("region"), "point").join(near, ["region", "point"], "left")
        members = members.join(space.known.select("point", "n", "classes"), "point")
        count = PIVOTS
        while True:
            members = _live(members, labels)
            if members.isEmpty():
                break
            # pivots come from outside the largest class, whose own pairs are settled; a limited rank, so only so many leave a task
            rank = F.row_number().over(Window.partitionBy("region").orderBy(F.col("rest").desc(), F.col("near").asc_nulls_last(), F.xxhash64("point", "region"), "point"))
            chosen = materialize(members.withColumn("rank", rank).filter((F.col("rank") <= count) & F.col("rest")))
            p = chosen.select("region", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), *[F.col(c).alias(f"p_{c}") for c in ("point", "near", "label", "n", "classes")])
            window = F.col("near").isNull() | F.col("p_near").isNull() | (F.abs(F.col("near") - F.col("p_near")) <= eps + 1e-9)
            # a large region's members are dealt to several tasks, its few pivots are copied to each
            met = members.withColumn("salt", F.pmod(F.hash("point"), F.lit(SALTS))).join(p, ["region", "salt"]).filter(
                (F.col("label") != F.col("p_label")) & window & space.near_enough(F.col("n"), F.col("p_n"), F.col("classes"), F.col("p_classes"))
            )
            first = F.col("point") < F.col("p_point")
            pairs = met.select(
                F.least("point", "p_point").alias("a"), F.greatest("point", "p_point").alias("b"),
                F.when(first, F.col("n")).otherwise(F.col("p_n")).alias("n_a"), F.when(first, F.col("p_n")).otherwise(F.col("n")).alias("n_b"),
            ).distinct()
            more = space.compare(pairs)
            labels = extended_components(labels, more.filter("linked").select("a", "b"))
            members = members.join(chosen.select("region", "point"), ["region", "point"], "left_anti")
            count *= PIVOTS
        # classes of points, then the smallest id of each class
        named = space.known.select("point").join(labels.withColumnRenamed("node", "point"), "point", "left").select("point", F.coalesce("component", "point").alias("class"))
        ids = table.filter("point IS NOT NULL").groupBy("point").agg(F.min("doc_id").alias("least"))
        named = materialize(named.join(ids, "point"))
        least = materialize(named.groupBy("class").agg(F.min("least").alias("component_id")))
        of_point = materialize(named.join(least, "class").select("point", "component_id", "class"))
        out = table.select("doc_id", "row", "n", "point").join(of_point, "point", "left").select(
            "doc_id", "row", F.col("n").alias("n_shingles"), F.when(F.col("point").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "class"
        )
        return materialize(out, result=True)


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each class: that of the smallest id, null ids last, then of the smallest text hash.

    Texts without words are in no class and all stay, but of rows that agree in id and text one stays.
    """
    with intermediate_tables(docs.sparkSession):
        classes = linked_classes(docs, width, percent)
        order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
        first = classes.filter("class IS NOT NULL").groupBy("class").agg(F.min(order).alias("one")).select("one.doc_id", "one.row")
        kept = materialize(first.unionByName(classes.filter("class IS NULL").select("doc_id", "row")).distinct(), result=True)
        again = not classes.groupBy("doc_id", "row").count().filter("count > 1").isEmpty()
    kept = kept.select(F.col("doc_id").alias("__kept"), F.col("row").alias("__kept_row"))
    # the document's own columns stay together, so none clashes with these
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), F.xxhash64("text").alias("__row"), F.col("doc_id").alias("__id"))
    joined = keyed.join(kept.hint("merge"), F.col("__id").eqNullSafe(F.col("__kept")) & (F.col("__row") == F.col("__kept_row")))
    return (joined.dropDuplicates(["__id", "__row"]) if again else joined).select("__doc.*")
