"""Agreement of partitions and raters, from contingency cells.

Every index here is a function of the cell counts (a, b, n). The data is aggregated to
cells once, with map-side partial counts, and all further work is on the few cells.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.operators.consensus import ari_from_sums
from concord.operators.similarity import BLOCK_ROWS, block_join, slice_rows
from concord.runtime import bounded_rows, materialize

MAX_CELLS = 16_000
# an item of up to so many labels is a row for each subset of them
SUBSET_LABELS = 10
LABEL_COLUMNS = 2048
# pairs that meet: by theory, and with equal empirical or detected labels, or both
SUMS = ("t", "te", "td", "ted")
# rows that are packed together, and (row, label) entries of a part of the labels, about
PACK_ROWS = 8192
PART_ENTRIES = 100_000


def _c2(n: Column) -> Column:
    return n * (n - 1) / 2


def cells(df: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, a, b, n) over rows where both labels are known."""
    return (
        df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
        .groupBy(*keys, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    )


def contingency(cell: DataFrame, rows: Sequence | None = None, cols: Sequence | None = None) -> DataFrame:
    """All row x column combinations with n = 0 where absent; labels given or as seen."""
    seen = cell.agg(F.array_sort(F.collect_set("a")).alias("as"), F.array_sort(F.collect_set("b")).alias("bs"))
    row_set = F.col("as") if rows is None else F.array(*[F.lit(r) for r in rows])
    col_set = F.col("bs") if cols is None else F.array(*[F.lit(c) for c in cols])
    grid = seen.select(F.explode(row_set).alias("a"), col_set.alias("bs")).select("a", F.explode("bs").alias("b"))
    return grid.join(cell, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"))


def margins(df: DataFrame, a: str, b: str) -> DataFrame:
    """Crosstab with row, column and grand totals (label null, marked by the level)."""
    return df.cube(F.col(a).alias("a"), F.col(b).alias("b")).agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level")
    )


def wide_contingency(df: DataFrame, a: str, b: str, values: Sequence) -> DataFrame:
    return df.groupBy(a).pivot(b, list(values)).count().na.fill(0)


def partition_agreement(cell: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, n_items, ari, nmi, n_a, n_b): adjusted Rand and arithmetic-mean NMI.

    Margins are window sums over the few cells; weighted by the cell count, every margin
    term becomes a sum over cells, so one aggregate gives both indices. Degenerate cases
    follow the usual conventions: both partitions trivial gives 1.0.
    """
    n, na, nb = F.col("n"), F.col("na"), F.col("nb")
    margin = lambda c: F.sum("n").over(Window.partitionBy(*keys, c))
    counted = cell.select(*keys, "a", "b", F.col("n").cast("double").alias("n"))
    sums = counted.withColumn("na", margin("a")).withColumn("nb", margin("b")).groupBy(*keys).agg(
        F.sum(n).alias("total"), F.sum(_c2(n)).alias("cc"), F.sum(n * (na - 1) / 2).alias("c_a"), F.sum(n * (nb - 1) / 2).alias("c_b"),
        F.sum(n * F.ln(n / (na * nb))).alias("mi"), F.sum(n * F.ln(na)).alias("e_a"), F.sum(n * F.ln(nb)).alias("e_b"),
        F.round(F.sum(n / na)).cast("long").alias("n_a"), F.round(F.sum(n / nb)).cast("long").alias("n_b"),
    )
    total = F.col("total")
    ha, hb = F.ln(total) - F.col("e_a") / total, F.ln(total) - F.col("e_b") / total
    nmi = F.when((F.col("n_a") == 1) & (F.col("n_b") == 1), F.lit(1.0)).otherwise(
        F.greatest(F.col("mi") / total + F.ln(total), F.lit(0.0)) / F.greatest((ha + hb) / 2, F.lit(1e-300))
    )
    ari = ari_from_sums(F.col("cc"), F.col("c_a"), F.col("c_b"), total)
    return sums.select(*keys, total.cast("long").alias("n_items"), ari.alias("ari"), nmi.alias("nmi"), "n_a", "n_b")


def expand_labels(detected: DataFrame, memberships: DataFrame, missing=-1) -> DataFrame:
    """(id, detected, reference): one row per listed factor; ``missing`` when in none."""
    return detected.select("id", F.col("label").alias("detected")).join(
        memberships.select("id", F.col("label").alias("reference")), "id", "left"
    ).withColumn("reference", F.coalesce("reference", F.lit(missing)))


def alignment(expanded: DataFrame, missing=-1) -> DataFrame:
    """One row: compared and excluded counts, ARI, NMI and label counts on both sides."""
    known = expanded.filter(F.col("reference") != missing)
    excluded = expanded.agg(F.count_if(F.col("reference") == missing))
    return partition_agreement(cells(known, "reference", "detected")).select(
        F.col("n_items").alias("n_items_compared"), excluded.scalar().alias("n_items_excluded"), "ari", "nmi",
        F.col("n_b").alias("n_detected_clusters"), F.col("n_a").alias("n_reference_clusters"),
    )


def kappa(cell: DataFrame, keys: Sequence[str] = (), need_two_labels: bool = False) -> DataFrame:
    """(keys, n_pairs, n_agree, pct_agree, kappa) from cells; null below 2 pairs.

    ``need_two_labels`` also nulls kappa when only one category occurs.
    """
    # one row per (keys, label) with both margins: chance agreement is their product sum
    both = cell.select(*keys, F.col("a").alias("label"), F.col("n").alias("na"), F.lit(0).cast("long").alias("nb")).unionByName(
        cell.select(*keys, F.col("b").alias("label"), F.lit(0).cast("long").alias("na"), F.col("n").alias("nb"))
    ).groupBy(*keys, "label").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    chance = both.groupBy(*keys).agg(
        F.sum(F.col("na").cast("double") * F.col("nb")).alias("cross"), F.sum("na").alias("n_pairs"),
        F.count(F.lit(1)).alias("n_labels"),
    )
    agree = cell.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))), F.lit(0)).alias("n_agree"))
    out = chance.join(agree, list(keys)) if keys else chance.withColumn("n_agree", agree.scalar())
    po = F.col("n_agree") / F.col("n_pairs")
    pe = F.col("cross") / (F.col("n_pairs").cast("double") * F.col("n_pairs"))
    value = F.when((F.col("n_pairs") >= 2) & (pe < 1), (po - pe) / (1 - pe))
    if need_two_labels:
        value = F.when(F.col("n_labels") >= 2, value)
    return out.select(*keys, "n_pairs", "n_agree", (100.0 * po).alias("pct_agree"), value.alias("kappa"))


def confusion(cell: DataFrame, order: Sequence) -> DataFrame:
    """Square rater table in canonical order; labels that never occur are left out, others follow by name."""
    given = F.array_position(F.array(*[F.lit(c) for c in order]), F.col("l"))
    place = F.row_number().over(Window.orderBy(F.when(given > 0, given).otherwise(F.lit(len(order) + 1)), "l"))  # one row per label
    labels = cell.select(F.explode(F.array("a", "b")).alias("l")).distinct().select("l", place.alias("place"))
    # the table is every label against every label: that is its size
    columns = labels.select(F.col("l").alias("b"), F.col("place").alias("col"))
    grid = labels.select(F.col("l").alias("a"), F.col("place").alias("row")).join(columns)
    return grid.join(cell, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"), F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"))


def structural_swaps(cell: DataFrame, share: float = 0.70) -> DataFrame:
    """Off-diagonal cells holding at least ``share`` of their row."""
    rows = cell.groupBy("a").agg(F.sum("n").alias("row_total"))
    return cell.join(rows, "a").withColumn("share", F.col("n") / F.col("row_total")).filter(
        (F.col("a") != F.col("b")) & (F.col("share") >= share)
    )


def _assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """Best one-to-one assignment by shortest augmenting paths on reduced costs."""
    turned = gain.shape[0] > gain.shape[1]
    cost = -(gain.T if turned else gain)
    n, m = cost.shape
    u, v, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for row in range(n):
        dist, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        i, col, reach = row, -1, 0.0
        while True:
            slack = reach + cost[i] - u[i] - v
            better = ~done & (slack < dist)
            dist[better], via[better] = slack[better], col
            col = int(np.where(done, np.inf, dist).argmin())
            reach = dist[col]
            done[col] = True
            if owner[col] < 0:
                break
            i = owner[col]
        held = done & (owner >= 0)
        u[owner[held]] += reach - dist[held]
        u[row] += reach
        v[done] -= reach - dist[done]
        while col >= 0:
            back = via[col]
            owner[col] = owner[back] if back >= 0 else row
            col = back
    pairs = [(int(owner[c]), c) for c in range(m) if owner[c] >= 0]
    return sorted((b, a) if turned else (a, b) for a, b in pairs)


def optimal_mapping(cell: DataFrame, max_cells: int = MAX_CELLS) -> DataFrame:
    """(a, mapped_to, n_matched, n_items, agreement_rate): the 1:1 relabelling with most matches.

    Noise labels (below 0) stay out. The data was reduced to k x k cells; only those are
    collected for the assignment, which is one problem over all of them: more than ``max_cells``
    are refused.
    """
    rows = bounded_rows(cell.filter("a >= 0 and b >= 0"), max_cells, "contingency cells")
    left, right = sorted({r["a"] for r in rows}), sorted({r["b"] for r in rows})
    gain = np.zeros((len(left), len(right)))
    for r in rows:
        gain[left.index(r["a"]), right.index(r["b"])] = r["n"]
    out = [
        (left[i], right[j], int(gain[i, j]), int(gain[i].sum()), float(gain[i, j] / gain[i].sum()))
        for i, j in _assignment(gain)
    ]
    kind_a, kind_b = (cell.schema[c].dataType.simpleString() for c in ("a", "b"))
    return cell.sparkSession.createDataFrame(
        out, f"a {kind_a}, mapped_to {kind_b}, n_matched long, n_items long, agreement_rate double"
    )


def mapping_metrics(pairs: DataFrame, mapping: DataFrame) -> DataFrame:
    """One row of agreement, ARI, NMI and similarity statistics of (a, b, sim) pairs."""
    valid = pairs.filter("a >= 0 and b >= 0").join(mapping.select("a", "mapped_to"), "a", "left")
    stats = valid.agg(
        F.count(F.lit(1)).alias("n_valid_pairs"),
        F.avg(F.coalesce(F.col("mapped_to") == F.col("b"), F.lit(False)).cast("double")).alias("agreement_rate"),
        F.avg("sim").alias("sim_mean"), F.stddev_samp("sim").alias("sim_sd"), F.min("sim").alias("sim_min"),
        F.max("sim").alias("sim_max"),
    )
    from concord.operators.ranking import exact_quantiles

    index = partition_agreement(cells(valid, "a", "b"))
    median = exact_quantiles(valid, [], "sim", [0.5]).select("quantile")
    return stats.select(
        "*", index.select("ari").scalar().alias("ari"), index.select("nmi").scalar().alias("nmi"),
        median.scalar().alias("sim_median"),
    )


def agreeing_pairs(pairs: DataFrame, mapping: DataFrame) -> DataFrame:
    """Pairs with the mapped label and whether it is the partner's."""
    return pairs.join(mapping.select("a", "mapped_to"), "a", "left").withColumn(
        "agrees", F.coalesce(F.col("mapped_to") == F.col("b"), F.lit(False))
    )


def item_comparison(detected: DataFrame, memberships: DataFrame) -> DataFrame:
    """(id, detected, reference, agrees): listed labels joined in order, any-factor agreement."""
    listed = memberships.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ord", "label"))).alias("l")).select(
        "id", F.transform("l", lambda s: s["label"]).alias("labels")
    )
    return detected.join(listed, "id", "left").select(
        "id", F.coalesce("label", F.lit("unassigned")).alias("detected"),
        F.coalesce(F.array_join("labels", ","), F.lit("unassigned")).alias("reference"),
        F.coalesce(F.array_contains("labels", F.col("label")), F.lit(False)).alias("agrees"),
    )


def item_master(detected: DataFrame, theory: DataFrame, empirical: DataFrame, order: Sequence[str]) -> DataFrame:
    """Detected, theoretical and empirical labels per item with overlap flags, in domain order."""
    def arrays(m: DataFrame, name: str) -> DataFrame:
        return m.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ord", "label"))).alias("l")).select(
            "id", F.transform("l", lambda s: s["label"]).alias(name)
        )

    rank = F.array(*[F.lit(o) for o in order])
    has = lambda c: F.coalesce(F.array_contains(c, F.col("label")), F.lit(False))
    out = detected.join(arrays(theory, "theory"), "id", "left").join(arrays(empirical, "empirical"), "id", "left")
    place = F.array_position(rank, F.col("label"))
    return out.select(
        "id", "label", F.array_join("theory", ",").alias("theory"), F.array_join("empirical", ",").alias("empirical"),
        has("theory").alias("agrees_theory"), has("empirical").alias("agrees_empirical"),
        F.coalesce(F.arrays_overlap("theory", "empirical"), F.lit(False)).alias("references_overlap"),
        F.when(place > 0, place).otherwise(F.lit(99)).alias("position"),
    ).orderBy("position", "id")


def mismatch_ledger(df: DataFrame, a: str, b: str, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows whose two labels differ; null against a value is a difference."""
    return df.filter(~F.col(a).eqNullSafe(F.col(b))).select(*columns).orderBy(*order)


def model_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(factor_a, factor_b, overlap, jaccard) for every factor pair of two memberships."""
    sa = a.groupBy("label").agg(F.count_distinct("id").alias("na"))
    sb = b.groupBy("label").agg(F.count_distinct("id").alias("nb"))
    shared = a.select("id", F.col("label").alias("a")).distinct().join(
        b.select("id", F.col("label").alias("b")).distinct(), "id"
    ).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    # every pair of factor names, also those without a common item
    names_b = sb.agg(F.collect_list(F.struct(F.col("label").alias("b"), "nb"))).scalar()
    grid = sa.select(F.col("label").alias("a"), "na", F.explode(names_b).alias("s")).select("a", "na", "s.b", "s.nb")
    n = F.coalesce("n", F.lit(0))
    union = F.col("na") + F.col("nb") - n
    return grid.join(shared, ["a", "b"], "left").select(
        F.col("a").alias("factor_a"), F.col("b").alias("factor_b"), n.alias("overlap"),
        F.when(union > 0, F.round(n / union, 3)).otherwise(F.lit(0.0)).alias("jaccard"),
    )


def rater_consensus(ratings: DataFrame) -> DataFrame:
    """Explicit consensus if given, else the common answer of both raters, else null."""
    same = F.when(F.col("rater1") == F.col("rater2"), F.col("rater1"))
    return ratings.withColumn("consensus", F.coalesce("explicit", same))


def override_flagged(assigned: DataFrame, ratings: DataFrame) -> DataFrame:
    """Flagged items take the consensus when there is one; others keep their label."""
    agreed = rater_consensus(ratings).select("id", "consensus")
    return assigned.join(agreed, "id", "left").withColumn(
        "final", F.when(F.col("uc_flagged") & F.col("consensus").isNotNull(), F.col("consensus")).otherwise(F.col("label"))
    )


def domain_accuracy(detected: DataFrame, memberships: DataFrame, total_name: str = "All items") -> DataFrame:
    """Recovery per listed domain under the any-factor and single-domain rules.

    The total row counts every item once. Percentages have one decimal.
    """
    sizes = memberships.groupBy("id").agg(F.count(F.lit(1)).alias("m"))
    rows = memberships.join(sizes, "id").join(detected.select("id", F.col("label").alias("found")), "id").withColumn(
        "hit", F.coalesce(F.col("found") == F.col("label"), F.lit(False))
    )
    pct = lambda top, bottom: F.round(100.0 * top / F.nullif(bottom, F.lit(0)), 1)

    def counts(t: DataFrame, *keys: str) -> DataFrame:
        single = F.col("m") == 1
        return t.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("items_any_factor"), F.count_if("hit").alias("recovered_any_factor"),
            F.count_if(single).alias("items_single_domain"), F.count_if(F.col("hit") & single).alias("recovered_single_domain"),
        )

    once = rows.groupBy("id").agg(F.bool_or("hit").alias("hit"), F.first("m").alias("m"))
    both = counts(rows, "label").withColumnRenamed("label", "domain").unionByName(
        counts(once).withColumn("domain", F.lit(total_name))
    )
    return both.withColumn("pct_any_factor", pct(F.col("recovered_any_factor"), F.col("items_any_factor"))).withColumn(
        "pct_single_domain", pct(F.col("recovered_single_domain"), F.col("items_single_domain"))
    )


def accuracy_rates(detected: DataFrame, memberships: DataFrame) -> DataFrame:
    """Overall any-factor and first-listed rates over items that have a reference label."""
    per_item = memberships.groupBy("id").agg(
        F.collect_set("label").alias("labels"), F.min_by("label", F.struct("ord", "label")).alias("first")
    ).join(detected, "id")
    return per_item.agg(
        F.count(F.lit(1)).alias("n_items"),
        F.avg(F.coalesce(F.array_contains("labels", F.col("label")), F.lit(False)).cast("double")).alias("any_factor"),
        F.avg(F.coalesce(F.col("first") == F.col("label"), F.lit(False)).cast("double")).alias("first_listed"),
    )


def heatmap_metrics(full: DataFrame, rows: Sequence, cols: Sequence) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(summary, per row, top-5 off-diagonal cells) of a completed contingency table."""
    ra, cb = F.array(*[F.lit(r) for r in rows]), F.array(*[F.lit(c) for c in cols])
    placed = full.withColumn("i", F.array_position(ra, F.col("a"))).withColumn("j", F.array_position(cb, F.col("b")))
    diag, off = F.col("i") == F.col("j"), F.col("i") != F.col("j")
    summary = placed.agg(
        F.avg(F.when(diag, F.col("n"))).alias("within_mean"), F.avg(F.when(off, F.col("n"))).alias("between_mean")
    ).withColumn("separation_ratio", F.when(F.col("between_mean") > 0, F.col("within_mean") / F.col("between_mean")))
    same = F.col("a") == F.col("b")
    per_row = placed.groupBy("a").agg(
        F.max(F.when(same, F.col("n"))).alias("diag"), F.coalesce(F.max(F.when(~same, F.col("n"))), F.lit(0)).alias("max_off")
    ).filter("diag is not null")
    top = F.greatest("diag", "max_off")
    per_row = per_row.withColumn(
        "silhouette", F.when(top > 0, F.round((F.col("diag") - F.col("max_off")) / top, 4)).otherwise(F.lit(0.0))
    )
    best = placed.filter(off & (F.col("n") > 0)).orderBy(F.desc("n"), "i", "j").limit(5).select("a", "b", "n")
    return summary, per_row, best


def flow_table(cell: DataFrame, flag_pct: float = 20.0) -> DataFrame:
    """(a, b, n, pct_of_left, left_total, right_total, is_match, reallocated)."""
    left = cell.groupBy("a").agg(F.sum("n").alias("left_total"))
    right = cell.groupBy("b").agg(F.sum("n").alias("right_total"))
    pct = F.round(100.0 * F.col("n") / F.col("left_total"), 1)
    match = F.col("a") == F.col("b")
    return cell.join(left, "a").join(right, "b").select(
        "a", "b", "n", pct.alias("pct_of_left"), "left_total", "right_total", match.alias("is_match"),
        (~match & (pct >= flag_pct)).alias("reallocated"),
    )


def pair_intermediacy(items: DataFrame) -> DataFrame:
    """Pair counts of two references and a clustering, for one label each per item.

    ``items`` is (id, theory, empirical, detected). Pairs together in a set of labelings are
    the C(n, 2) of its joint cells, so no pair is formed.
    """
    sides = ["theory", "empirical", "detected"]
    sets = {"t": ["theory"], "e": ["empirical"], "d": ["detected"], "te": ["theory", "empirical"],
            "td": ["theory", "detected"], "ed": ["empirical", "detected"], "ted": sides}
    full = items.groupBy(*sides).agg(F.count(F.lit(1)).cast("double").alias("n"))
    # a cell of n items in a group of N adds n (N - 1) / 2 pairs
    wide = full.withColumns({f"n_{k}": F.sum("n").over(Window.partitionBy(*cols)) for k, cols in sets.items()})
    pairs = lambda k: F.coalesce(F.sum(F.col("n") * (F.col(f"n_{k}") - 1) / 2), F.lit(0.0)).alias(k)
    return _intermediacy_rows(wide.agg(_c2(F.sum("n")).alias("all"), *[pairs(k) for k in sets]))


def pair_intermediacy_any(items: DataFrame) -> DataFrame:
    """As :func:`pair_intermediacy` with a label array in ``theory``: together if arrays meet.

    Two arrays meet in as many ways as they share subsets, so counting the pairs of every label
    subset, with the sign of its size, counts each meeting pair once (inclusion and exclusion):
    a row per subset for items of up to ``SUBSET_LABELS`` labels. Distinct arrays of more labels
    meet the others in blocks, which return four sums: those of a label at their first shared one, or all of them where
    that is fewer pairs. No pair is written in either form.
    """
    theory = F.array_sort(F.array_distinct(F.filter("theory", lambda x: x.isNotNull())))
    full = materialize(
        items.groupBy(F.coalesce(theory, F.array().cast(items.schema["theory"].dataType)).alias("theory"), "empirical", "detected")
        .agg(F.count(F.lit(1)).cast("double").alias("n"))
    )
    labels = F.size("theory")
    few, many = full.filter((labels > 0) & (labels <= SUBSET_LABELS)), full.filter(labels > SUBSET_LABELS)
    subsets = F.expr("transform(sequence(1, shiftleft(1, size(theory)) - 1), b -> filter(theory, (x, i) -> shiftright(b, i) & 1 = 1))")
    listed = few.select(F.explode(subsets).alias("s"), "empirical", "detected", "n").groupBy("s", "empirical", "detected").agg(F.sum("n").alias("n"))

    def pairs(table: DataFrame, sets: dict[str, list[str]], sign: Column) -> DataFrame:
        wide = table.withColumns({f"n_{k}": F.sum("n").over(Window.partitionBy(*cols)) for k, cols in sets.items()})
        out = []
        for k, cols in sets.items():
            known = F.lit(True)
            for c in cols:
                known = known & F.col(c).isNotNull()
            out.append(F.coalesce(F.sum(F.when(known, sign * F.col("n") * (F.col(f"n_{k}") - 1) / 2)), F.lit(0.0)).alias(k))
        return wide.agg(*out, _c2(F.coalesce(F.sum("n"), F.lit(0.0))).alias("all"))

    met = pairs(listed, {"t": ["s"], "te": ["s", "empirical"], "td": ["s", "detected"], "ted": ["s", "empirical", "detected"]}, F.when(F.size("s") % 2 == 1, 1.0).otherwise(-1.0)).drop("all")
    n_many, n_few = many.count(), few.count()
    if n_many:
        met = met.unionByName(_meeting_sums(many, many, (n_many, n_many), half=True))
        if n_few:
            met = met.unionByName(_meeting_sums(many, few, (n_many, n_few), half=False))
    met = met.agg(*[F.sum(c).alias(c) for c in met.columns])
    rest = pairs(full, {"e": ["empirical"], "d": ["detected"], "ed": ["empirical", "detected"]}, F.lit(1.0))
    return _intermediacy_rows(rest.join(F.broadcast(met)))  # two rows of counts


def _meeting(left: pa.ChunkedArray, right: pa.ChunkedArray) -> np.ndarray:
    """Whether label arrays share a label: products of 0/1 columns, a bounded number of labels at a time."""
    a, b = left.combine_chunks(), right.combine_chunks()
    codes = pa.concat_arrays([a.flatten(), b.flatten()]).dictionary_encode().indices.to_numpy()
    rows_a, rows_b = np.repeat(np.arange(len(a)), np.diff(a.offsets)), np.repeat(np.arange(len(b)), np.diff(b.offsets))
    # labels of both sides only, numbered anew
    common = np.intersect1d(codes[: len(rows_a)], codes[len(rows_a) :])
    number = np.full(int(codes.max(initial=-1)) + 1, -1, dtype=np.int64)
    number[common] = np.arange(len(common))
    codes_a, codes_b = number[codes[: len(rows_a)]], number[codes[len(rows_a) :]]
    shared = np.zeros((len(a), len(b)), dtype=np.float32)
    for at in range(0, len(common), LABEL_COLUMNS):
        width = min(LABEL_COLUMNS, len(common) - at)
        sides = []
        for rows, own, n in ((rows_a, codes_a, len(a)), (rows_b, codes_b, len(b))):
            here = (own >= at) & (own < at + width)
            side = np.zeros((n, width), dtype=np.float32)
            side[rows[here], own[here] - at] = 1.0
            sides.append(side)
        shared += sides[0] @ sides[1].T
    return shared > 0


def _equal(left: pa.ChunkedArray, right: pa.ChunkedArray) -> np.ndarray:
    codes = pa.concat_arrays([left.combine_chunks(), right.combine_chunks()]).dictionary_encode().indices
    known = codes.fill_null(-1).to_numpy()
    a, b = known[: len(left)], known[len(left) :]
    return (a[:, None] == b[None, :]) & (a >= 0)[:, None]


def _pair_sums_of(lt: pa.Table, rt: pa.Table, met: np.ndarray, first: np.ndarray, twice: bool) -> dict[str, float]:
    """Weighted pairs that ``met``, also with equal labels on the other sides; ``twice``: rows of one block, each with itself if ``first``."""
    n_l, n_r = lt["n"].to_numpy(), rt["n"].to_numpy()
    same = {"e": _equal(lt["empirical"], rt["empirical"]), "d": _equal(lt["detected"], rt["detected"])}
    known = {s: lt[c].is_valid().to_numpy() for s, c in (("e", "empirical"), ("d", "detected"))}
    out = {}
    for name in SUMS:
        together, own = met, first
        for s in name[1:]:
            together, own = together & same[s], own & known[s]
        total = float(n_l @ (together @ n_r))
        out[name] = (total - float(n_l[own].sum())) / 2 if twice else total
    return out


def _meeting_sums(left: DataFrame, right: DataFrame, sizes: tuple[int, int], half: bool) -> DataFrame:
    """(t, te, td, ted): weighted pairs whose arrays meet, also with equal labels on the other sides; ``half`` is for a set with itself."""
    listed = lambda df: df.select(F.explode("theory").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    counts = listed(left).join(listed(right).withColumnRenamed("n", "m"), "label")
    counts = materialize(counts.select("label", "n", "m", F.ceil(F.greatest("n", "m") / BLOCK_ROWS).cast("int").alias("blocks")))
    of_large = F.sum(F.when(F.col("blocks") > 1, F.col("n")))
    cost, rows, entries = counts.agg(F.sum(F.col("n").cast("double") * F.col("m")), of_large, F.sum(F.col("n") + F.col("m"))).first()
    by_label = (cost or 0.0) <= float(sizes[0]) * sizes[1]
    named = lambda df: df.withColumn("id", F.xxhash64("theory", "empirical", "detected"))

    def kernel(key, lt, rt):
        if not lt.num_rows or not rt.num_rows:
            return pa.table({name: pa.array([], pa.float64()) for name in SUMS})
        # a block with itself has each pair twice, and each row with itself
        twice = half and key[-2].as_py() == key[-1].as_py()
        met = _meeting(lt["theory"], rt["theory"])
        first = np.ones(lt.num_rows, dtype=bool)
        if by_label:
            # rows of one label, with those before it: a pair that shares one of these is counted there
            met, first = ~met, pc.list_value_length(lt["theory"]).to_numpy() == 0
        return pa.table({name: [v] for name, v in _pair_sums_of(lt, rt, met, first, twice).items()})

    schema = ", ".join(f"{name} double" for name in SUMS)
    if not by_label:
        sums = block_join(named(left), named(right), kernel, schema, sizes=sizes, half=half)
    else:
        # labels of more than a block
        large = F.broadcast(counts.filter("blocks > 1").select("label", "blocks"))

        def spread(df: DataFrame) -> DataFrame:
            each = named(df).select("id", "empirical", "detected", "n", F.posexplode("theory").alias("at", "label"), "theory")
            return each.withColumn("theory", F.slice("theory", F.lit(1), F.col("at"))).join(large, "label")

        sums = block_join(spread(left), spread(right), kernel, schema, keys=["label"], sizes=(rows or 1, 1), half=half, blocks="blocks")
        sums = sums.unionByName(_packed_sums(left, None if half else right, counts, entries or 1))
    return sums.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in sums.columns])


def _before(offsets: np.ndarray, row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, places in the flat labels) of the first ``at`` labels of each ``row``."""
    ends = np.concatenate([[0], np.cumsum(at)])
    return ends, np.repeat(offsets[row] - ends[:-1], at) + np.arange(ends[-1])


def _steps(flat: np.ndarray, ends: np.ndarray, back: bool = False) -> np.ndarray:
    """Whole numbers of lists as differences from the one before, the first one as it is; or back from these."""
    first = ends[:-1][np.diff(ends) > 0]
    if not back:
        out = np.diff(flat, prepend=flat[:1])
        out[first] = flat[first]
        return out
    total = np.cumsum(flat)
    ahead = total[first] - flat[first]
    return total - np.repeat(ahead, np.diff(ends)[np.diff(ends) > 0])


def _packed_sums(left: DataFrame, right: DataFrame | None, counts: DataFrame, entries: int) -> DataFrame:
    """(t, te, td, ted) over the labels of one block: pairs of rows of a label that share none before it; of a set with itself if ``right`` is None.

    A row goes to each of its labels with those before it, which is most of what is shuffled. So the rows of a batch and a
    part of the labels are one compressed table, whole numbers as steps from one label to the next, and a set that meets itself is sent once.
    """
    kind = left.schema["theory"].dataType.elementType
    steps = isinstance(kind, T.IntegralType)
    cores = left.sparkSession.sparkContext.defaultParallelism
    parts = max(4 * cores, -(-entries // PART_ENTRIES))
    large = [r["label"] for r in counts.filter("blocks > 1").select("label").collect()]  # each stands for more than BLOCK_ROWS rows
    shipped = left.sparkSession.sparkContext.broadcast(large)
    alone = right is None

    def side(df: DataFrame, of: int) -> DataFrame:
        part = F.transform("theory", lambda x: F.pmod(F.xxhash64(x), F.lit(parts)).cast("int"))
        return df.select("theory", "empirical", "detected", "n", part.alias("part"), F.lit(of).alias("side"))

    def pack(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, PACK_ROWS):
                rows = batch.slice(start, PACK_ROWS)
                theory = rows.column("theory")
                offsets, flat = theory.offsets.to_numpy() - theory.offsets[0].as_py(), theory.flatten()
                row = np.repeat(np.arange(len(theory)), np.diff(offsets))
                at, part = np.arange(len(row)) - offsets[row], rows.column("part").flatten().to_numpy()
                order = np.argsort(part, kind="stable")
                if shipped.value:
                    order = order[~pc.is_in(flat.take(pa.array(order)), value_set=pa.array(shipped.value, flat.type)).to_numpy(zero_copy_only=False)]
                cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
                found, blobs = [], []
                for a, b in zip(cuts, np.append(cuts[1:], len(order))):
                    here = order[a:b]
                    ends, places = _before(offsets, row[here], at[here])
                    before = flat.take(pa.array(places))
                    if steps:
                        before = pa.array(_steps(before.to_numpy().astype(np.int64), ends))
                    of = rows.take(pa.array(row[here]))
                    table = pa.table([
                        flat.take(pa.array(here)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), before), *(of.column(c) for c in ("empirical", "detected", "n", "side"))
                    ], names=["label", "theory", "empirical", "detected", "n", "side"])
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                        writer.write_table(table)
                    found.append(int(part[here[0]]))
                    blobs.append(sink.getvalue().to_pybytes())
                yield pa.record_batch([pa.array(found, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "rows"])

    def meet(batches):
        held: dict[int, list[pa.Table]] = {}
        for batch in batches:
            for part, rows in zip(batch.column("part").to_pylist(), batch.column("rows")):
                held.setdefault(part, []).append(pa.ipc.open_stream(rows.as_buffer()).read_all())
        sums = dict.fromkeys(SUMS, 0.0)
        while held:
            table = pa.concat_tables(held.popitem()[1]).combine_chunks()
            codes = table["label"].combine_chunks().dictionary_encode().indices.to_numpy()
            table = table.take(pa.array(np.argsort(codes, kind="stable"))).combine_chunks()
            if steps:
                theory = table["theory"].combine_chunks()
                ends = theory.offsets.to_numpy()
                whole = pa.ListArray.from_arrays(theory.offsets, pa.array(_steps(theory.flatten().to_numpy(), ends - ends[0], back=True)))
                table = table.set_column(1, "theory", whole)
            cuts = np.concatenate([[0], np.cumsum(np.bincount(codes))])
            for a, b in zip(cuts, cuts[1:]):
                lt = rt = table.slice(a, b - a)
                if not alone:
                    lt, rt = (lt.filter(pc.equal(lt["side"], of)) for of in (0, 1))
                    if not lt.num_rows or not rt.num_rows:
                        continue
                step = slice_rows(rt.num_rows)
                for start in range(0, lt.num_rows, step):
                    some = lt.slice(start, step)
                    first = pc.list_value_length(some["theory"]).to_numpy() == 0
                    for name, v in _pair_sums_of(some, rt, ~_meeting(some["theory"], rt["theory"]), first, alone).items():
                        sums[name] += v
        yield pa.record_batch([pa.array([v]) for v in sums.values()], names=list(sums))

    every = side(left, 0) if alone else side(left, 0).unionByName(side(right, 1))
    packed = every.mapInArrow(pack, "part int, rows binary").repartition(parts, "part")
    return packed.mapInArrow(meet, ", ".join(f"{name} double" for name in SUMS))


def _intermediacy_rows(base: DataFrame) -> DataFrame:
    t, e, d, te, td, ed, ted = (F.col(c) for c in ("t", "e", "d", "te", "td", "ed", "ted"))
    apart = F.col("all") - t - e + te
    quantities = {
        "consensus_apart": apart,
        "consensus_apart_kept": apart - (d - td - ed + ted),
        "consensus_together": te,
        "consensus_together_kept": ted,
        "disputed": t + e - 2 * te,
        "resolved_to_theory": (td - ted) + (e - te - (ed - ted)),
        "resolved_to_empirical": (t - te - (td - ted)) + (ed - ted),
        "together_theory": t,
        "together_empirical": e,
        "together_detected": d,
    }
    rows = [F.struct(F.lit(k).alias("quantity"), v.cast("long").alias("n")) for k, v in quantities.items()]
    jaccards = [
        ("jaccard_theory_detected", td / F.nullif(t + d - td, F.lit(0.0))),
        ("jaccard_empirical_detected", ed / F.nullif(e + d - ed, F.lit(0.0))),
        ("jaccard_theory_empirical", te / F.nullif(t + e - te, F.lit(0.0))),
    ]
    rows = [F.struct(r["quantity"].alias("quantity"), r["n"].alias("n"), F.lit(None).cast("double").alias("share")) for r in rows]
    rows += [F.struct(F.lit(k).alias("quantity"), F.lit(None).cast("long").alias("n"), v.alias("share")) for k, v in jaccards]
    return base.select(F.inline(F.array(*rows)))


def grouped_agreement(df: DataFrame, comparisons: Sequence[tuple[str, str, str]], group: str) -> DataFrame:
    """(comparison, group, n_pairs, n_agree, pct_agree, kappa) per group and over all groups.

    All column pairs are stacked and counted in one aggregate; the ``all`` rows are summed
    from the cells.
    """
    stacked = df.select(
        F.col(group).alias("grp"),
        F.explode(F.array(*[
            F.struct(F.lit(n).alias("comparison"), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"))
            for n, a, b in comparisons
        ])).alias("s"),
    ).select("grp", "s.*")
    per_group = cells(stacked, "a", "b", ["comparison", "grp"])
    total = per_group.groupBy("comparison", F.lit("all").alias("grp"), "a", "b").agg(F.sum("n").alias("n"))
    return kappa(per_group.unionByName(total), ["comparison", "grp"], need_two_labels=True)


def fisher_table(df: DataFrame, raters: Sequence[str], reference: str, group: str, levels: tuple[str, str]) -> DataFrame:
    """Agree/disagree by group, raters pooled, with odds ratio and exact two-sided p."""
    from concord.functions.stats import fisher_exact, odds_ratio

    pooled = df.select(
        F.col(group).alias("grp"), F.col(reference).alias("ref"), F.explode(F.array(*[F.col(r) for r in raters])).alias("val")
    ).filter("ref is not null and val is not null and grp is not null")
    hit = F.col("val") == F.col("ref")
    n = lambda level, cond: F.count_if((F.col("grp") == level) & cond)
    counts = pooled.agg(
        n(levels[0], ~hit).alias("first_disagree"), n(levels[0], hit).alias("first_agree"),
        n(levels[1], ~hit).alias("second_disagree"), n(levels[1], hit).alias("second_agree"),
    )
    cols = [F.col(c) for c in counts.columns]
    return counts.withColumn("odds_ratio", odds_ratio(*cols)).withColumn("p_value", fisher_exact(*cols))
