"""Exclusive one-to-one matching by descending similarity, and its cascade form.

Greedy matching takes the best remaining pair again and again. Under a total order on
pairs (sim desc, left id, right id) it equals repeated rounds of *mutual best*: every
pair that is the best remaining one of both its ends is final, and all such pairs can be
taken at once. A round is two aggregates and a join, and rounds are few (about log n).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.functions.vectors import SIM_DIGITS, cosine
from concord.operators.ranking import exact_rank
from concord.operators.similarity import pair_schema, topk_similar
from concord.runtime import materialize

PAIR = ["left_id", "right_id", "sim"]
LIST_SIZE = 16
SHRINK_EVERY = 4
# Bounded remainders that are finished without another distributed round.
FINISH_NODES = 64
FINISH_EDGES = 4096


def _drop_used(edges: DataFrame, used: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    if used is None:
        return edges
    for side in ("left", "right"):
        gone = used.filter(F.col(f"{side}_rest") == 0) if f"{side}_rest" in used.columns else used
        edges = edges.join(gone.select(*keys, f"{side}_id"), [*keys, f"{side}_id"], "left_anti")
    return edges


def _best(edges: DataFrame, side: str, other: str, keys: Sequence[str]) -> DataFrame:
    return (
        edges.groupBy(*keys, side)
        .agg(F.min(F.struct((-F.col("sim")).alias("minus"), F.col(other))).alias("b"))
        .select(*keys, side, F.col(f"b.{other}").alias(other), (-F.col("b.minus")).alias("sim"))
    )


def _mutual(left_lists: DataFrame, right_lists: DataFrame, used: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Pairs in which each end is the other's best remaining candidate.

    ``left_lists`` holds each left node's candidates, ``right_lists`` each right node's. A
    list that is a prefix of the node's full ranking stays exact while one of its
    candidates is alive; a node whose list is used up simply waits.
    """
    ll = _drop_used(left_lists, used, keys)
    rl = ll if left_lists is right_lists else _drop_used(right_lists, used, keys)
    return _best(ll, "left_id", "right_id", keys).join(
        _best(rl, "right_id", "left_id", keys).drop("sim"), [*keys, "left_id", "right_id"]
    ).select(*keys, *PAIR)


def match_edges(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Greedy exclusive match over an explicit edge table (left_id, right_id, sim).

    Rounds run until FINISH_EDGES or fewer edges are alive; that remainder is finished directly.
    """
    alive, found = materialize(edges.select(*keys, *PAIR)), None
    while True:
        rest = alive.limit(FINISH_EDGES + 1).collect()
        if len(rest) <= FINISH_EDGES:
            pairs = [row[: len(keys) + 3] for row in _greedy([tuple(r) for r in rest], len(keys))]
            tail = edges.sparkSession.createDataFrame(pairs, alive.schema)
            return tail if found is None else found.unionByName(tail)
        mutual = materialize(_mutual(alive, alive, None, keys))
        found = mutual if found is None else found.unionByName(mutual)
        alive = materialize(_drop_used(alive, mutual, keys))


def _nodes(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, id, vec, n): identical vectors as one node, named by the smallest id."""
    return materialize(items.groupBy(*keys, "vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")))


def _side_sizes(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> tuple[dict[tuple, list[int]], bool]:
    """Nodes of both sides per key, and whether no node stands for more than one item."""
    sides, unique = [], True
    for side in (left, right):
        rows = side.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("m")).collect()
        sides.append({tuple(r[:-2]): r["c"] for r in rows})
        unique = unique and all((r["m"] or 0) <= 1 for r in rows)
    return {k: [sides[0].get(k, 0), sides[1].get(k, 0)] for k in sides[0] | sides[1]}, unique


def _claims(mutual: DataFrame, found: DataFrame | None, left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mutual pairs with how many items each takes: the smaller remaining number of copies.

    Adds m, the items used before on both sides (left_start, right_start) and what is left.
    """
    out = mutual
    for side, nodes in (("left", left), ("right", right)):
        names = [*keys, f"{side}_id"]
        out = out.join(nodes.select(*keys, F.col("id").alias(f"{side}_id"), F.col("n").alias(f"{side}_n")), names)
        if found is None:
            out = out.withColumn(f"{side}_start", F.lit(0).cast("long"))
        else:
            spent = found.groupBy(*names).agg(F.sum("m").alias(f"{side}_start"))
            out = out.join(spent, names, "left").withColumn(f"{side}_start", F.coalesce(f"{side}_start", F.lit(0).cast("long")))
    open_left, open_right = F.col("left_n") - F.col("left_start"), F.col("right_n") - F.col("right_start")
    m = F.least(open_left, open_right)
    return out.select(
        *keys, *PAIR, m.alias("m"), "left_start", "right_start", (open_left - m).alias("left_rest"), (open_right - m).alias("right_rest")
    )


def _single(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs of nodes that stand for one item each."""
    zero = F.lit(0).cast("long")
    rest = [zero.alias(c) for c in ("left_start", "right_start", "left_rest", "right_rest")]
    return pairs.select(*keys, *PAIR, F.lit(1).cast("long").alias("m"), *rest)


def _longest(lists: DataFrame, keys: Sequence[str]) -> int:
    return lists.groupBy(*keys, "left_id").count().agg(F.max("count")).first()[0] or 0


def match_sets(
    left: DataFrame, right: DataFrame, keys: Sequence[str] = (), list_size: int = LIST_SIZE, min_sim=None
) -> DataFrame:
    """Greedy exclusive match of two vector sets (id, vec) until one side is used up.

    Both sides keep their ``list_size`` best candidates. When the rounds run dry, the nodes
    still alive get fresh lists among the alive ones, so the result is the exact greedy
    matching and the pair table never exists. Items with identical vectors are one node with
    as many places as copies, so a large group of copies is matched in one step instead of
    one pair per round; its items are then paired off in id order. ``keys`` are few
    (thresholds of a sweep); ``min_sim`` is a number, or a function of the key.
    """
    left_nodes, right_nodes = _nodes(left, keys), _nodes(right, keys)
    sizes, unique = _side_sizes(left_nodes, right_nodes, keys)
    found: DataFrame | None = None
    alive_left, alive_right = left_nodes, right_nodes
    # copies can take many partners each, so with copies both sides must be few at the end
    remainder = lambda: max(((min if unique else max)(s) if min(s) else 0 for s in sizes.values()), default=0)
    while remainder() > FINISH_NODES:
        nl, nr = (max(s[i] for s in sizes.values()) for i in (0, 1))
        best = lambda a, b, n: topk_similar(
            a.select(*keys, "id", "vec"), b.select(*keys, "id", "vec"), list_size, min_sim, keys=keys, sizes=n
        )
        ll = materialize(best(alive_left, alive_right, (nl, nr)).select(*keys, *PAIR))
        if unique and min_sim is not None and _longest(ll, keys) < list_size:
            # no list is cut off, so these are all pairs above min_sim
            step = _single(match_edges(ll, keys), keys)
            found = step if found is None else found.unionByName(step)
            break
        rl = materialize(_swap(best(alive_right, alive_left, (nr, nl)), keys))
        used: DataFrame | None = None
        rounds = 0
        while True:
            mutual = _mutual(ll, rl, used, keys)
            step = materialize(_single(mutual, keys) if unique else _claims(mutual, found, left_nodes, right_nodes, keys))
            gone = step.groupBy(*keys).agg(F.count_if(F.col("left_rest") == 0), F.count_if(F.col("right_rest") == 0)).collect()
            counts = {tuple(r[:-2]): (r[-2], r[-1]) for r in gone if r[-2] + r[-1] > 0}
            if not counts:
                break
            for k, (a, b) in counts.items():
                sizes[k] = [sizes[k][0] - a, sizes[k][1] - b]
            found = step if found is None else found.unionByName(step)
            used = step if used is None else used.unionByName(step)
            rounds += 1
            moved = sum(max(c) for c in counts.values())
            if remainder() <= FINISH_NODES or moved * 8 < sum(min(s) for s in sizes.values()):
                break  # few matches left in these lists: fresh ones are cheaper
            if rounds % SHRINK_EVERY == 0:
                ll, rl, used = materialize(_drop_used(ll, used, keys)), materialize(_drop_used(rl, used, keys)), None
        if rounds == 0:
            break  # fresh lists without a mutual pair: nothing above min_sim is left
        alive_left = _without(left_nodes, found, "left", keys)
        alive_right = _without(right_nodes, found, "right", keys)
    else:
        tail = _finish(alive_left, alive_right, found, sizes, unique, keys, min_sim)
        found = tail if found is None else found.unionByName(tail)
    if found is None:
        return left.sparkSession.createDataFrame([], pair_schema(left, right, keys))
    return found.select(*keys, *PAIR) if unique else _expand(found, left, right, left_nodes, right_nodes, keys)


def _finish(left, right, found, sizes, unique: bool, keys: Sequence[str], min_sim) -> DataFrame:
    """The last FINISH_NODES nodes per key, from at most FINISH_NODES^2 candidate edges.

    Without copies, m pairs are open and at most m - 1 candidates of a node can be taken by
    others, so the m best candidates of every node on the smaller side decide the match
    exactly, however large the other side is. With copies both sides are that small.
    """
    live = {k: s for k, s in sizes.items() if min(s)}
    m = max([(min if unique else max)(s) for s in live.values()] + [1])
    by_left = {k for k, (a, b) in live.items() if a <= b}
    nl, nr = (max([s[i] for s in sizes.values()] + [0]) for i in (0, 1))

    def only(side: DataFrame, wanted: set) -> DataFrame:
        side = side.select(*keys, "id", "vec")
        if not keys or len(wanted) == len(sizes):
            return side
        return side.filter(F.struct(*keys).isin([F.struct(*[F.lit(v) for v in k]) for k in wanted]))

    edges: list[tuple] = []
    if by_left:
        edges += topk_similar(only(left, by_left), only(right, by_left), m, min_sim, keys=keys, sizes=(nl, nr)).select(*keys, *PAIR).collect()
    by_right = set(live) - by_left
    if by_right:
        edges += _swap(topk_similar(only(right, by_right), only(left, by_right), m, min_sim, keys=keys, sizes=(nr, nl)), keys).collect()
    places: list[dict] = [{}, {}]
    if not unique:
        for i, (name, side) in enumerate((("left_id", left), ("right_id", right))):
            spent = {} if found is None else {
                tuple(r[:-1]): r[-1]
                for r in found.join(side.select(*keys, F.col("id").alias(name)), [*keys, name], "left_semi").groupBy(*keys, name).agg(F.sum("m")).collect()
            }
            places[i] = {(*[r[k] for k in keys], r["id"]): [spent.get((*[r[k] for k in keys], r["id"]), 0), r["n"]] for r in side.select(*keys, "id", "n").collect()}
    schema = pair_schema(left, right, keys)
    for name in ("m", "left_start", "right_start", "left_rest", "right_rest"):
        schema = schema.add(name, "long")
    return left.sparkSession.createDataFrame(_greedy([tuple(r) for r in edges], len(keys), *places), schema)


def _greedy(edges: list, n_keys: int, left: dict | None = None, right: dict | None = None) -> list[tuple]:
    """Greedy match of a bounded number of edge rows (keys, left_id, right_id, sim).

    ``left`` and ``right`` give [used, places] of nodes with copies; others have one place.
    """
    left, right, out = left or {}, right or {}, []
    for row in sorted(edges, key=lambda r: (-r[-1], *r[n_keys:-1])):
        a = left.setdefault((*row[:n_keys], row[n_keys]), [0, 1])
        b = right.setdefault((*row[:n_keys], row[n_keys + 1]), [0, 1])
        m = min(a[1] - a[0], b[1] - b[0])
        if m > 0:
            out.append((*row, m, a[0], b[0], a[1] - a[0] - m, b[1] - b[0] - m))
            a[0] += m
            b[0] += m
    return out


def _expand(found, left, right, left_nodes, right_nodes, keys: Sequence[str]) -> DataFrame:
    """Node matches back to items: copies are ranked by id and paired off place by place."""
    sides = []
    for side, items, nodes in (("left", left, left_nodes), ("right", right, right_nodes)):
        named = items.join(nodes.select(*keys, "vec", F.col("id").alias("node")), [*keys, "vec"]).select(*keys, "node", "id")
        ranked = exact_rank(named, [*keys, "node"], ["id"]).withColumnRenamed("node", f"{side}_id")
        start = F.col(f"{side}_start")
        at = ranked.join(found, [*keys, f"{side}_id"]).filter((F.col("rank") > start) & (F.col("rank") <= start + F.col("m")))
        sides.append(at.select(*keys, "left_id", "right_id", "sim", (F.col("rank") - start).alias("place"), F.col("id").alias(f"{side}_item")))
    pair = [*keys, "left_id", "right_id", "place"]
    return sides[0].join(sides[1].drop("sim"), pair).select(
        *keys, F.col("left_item").alias("left_id"), F.col("right_item").alias("right_id"), "sim"
    )


def _swap(ranked: DataFrame, keys: Sequence[str]) -> DataFrame:
    return ranked.select(*keys, F.col("right_id").alias("left_id"), F.col("left_id").alias("right_id"), "sim")


def _without(nodes: DataFrame, found: DataFrame, side: str, keys: Sequence[str]) -> DataFrame:
    gone = found.filter(F.col(f"{side}_rest") == 0).select(*keys, F.col(f"{side}_id").alias("id"))
    return materialize(nodes.join(gone, [*keys, "id"], "left_anti"))


def cascade_match(left: DataFrame, right: DataFrame, taus: Sequence[float]) -> DataFrame:
    """Two-stage match for each threshold, all thresholds in the same jobs.

    ``left`` and ``right`` are (id, title_vec, text_vec). Stage 1 locks pairs whose title
    similarity reaches ``tau``; stage 2 matches what is left on the full text. Output:
    tau, left_id, right_id, sim_title, sim_fulltext, sim_decision, stage.

    Greedy matching takes pairs by descending similarity, so a threshold only ends it earlier: stage 1 is matched
    once, at the lowest threshold, and each threshold keeps the pairs that reach it.
    """
    levels = F.explode(F.array(*[F.lit(float(t)) for t in taus]))
    titles = lambda side: side.select("id", F.col("title_vec").alias("vec"))
    lowest = materialize(match_sets(titles(left), titles(right), min_sim=float(min(taus))))
    locked = materialize(lowest.withColumn("tau", levels).filter("sim >= tau").select("tau", *PAIR))

    def rest(side: DataFrame, name: str) -> DataFrame:
        every = side.select("id", F.col("text_vec").alias("vec")).withColumn("tau", levels)
        taken = locked.select("tau", F.col(name).alias("id"))
        return materialize(every.join(taken, ["tau", "id"], "left_anti").select("tau", "id", "vec"))

    matched = match_sets(rest(left, "left_id"), rest(right, "right_id"), ["tau"])
    both = locked.withColumn("stage", F.lit("title_lock")).unionByName(matched.withColumn("stage", F.lit("full_text")))
    lv = left.select(F.col("id").alias("left_id"), F.col("title_vec").alias("lt"), F.col("text_vec").alias("lx"))
    rv = right.select(F.col("id").alias("right_id"), F.col("title_vec").alias("rt"), F.col("text_vec").alias("rx"))
    return (
        both.join(lv, "left_id").join(rv, "right_id")
        .select(
            "tau", "left_id", "right_id",
            F.round(cosine("lt", "rt"), SIM_DIGITS).alias("sim_title"),
            F.round(cosine("lx", "rx"), SIM_DIGITS).alias("sim_fulltext"),
            F.col("sim").alias("sim_decision"), "stage",
        )
    )


def threshold_sensitivity(sweep: DataFrame, base: float) -> DataFrame:
    """(tau, n_pairs, n_title, n_changed): pairs of each threshold that ``base`` does not have."""
    reference = sweep.filter(F.col("tau") == base).select("left_id", "right_id", F.lit(True).alias("in_base"))
    return (
        sweep.join(reference, ["left_id", "right_id"], "left")
        .groupBy("tau")
        .agg(
            F.count(F.lit(1)).alias("n_pairs"),
            F.count_if(F.col("stage") == "title_lock").alias("n_title"),
            F.count_if(F.col("in_base").isNull()).alias("n_changed"),
        )
    )


def transfer_labels(items: DataFrame, pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Left items take label and score of their match; unmatched get -1 and 0.0."""
    inherited = pairs.join(labels.select(F.col("id").alias("right_id"), "label", "score"), "right_id")
    return items.select("id").join(
        inherited.select(F.col("left_id").alias("id"), "label", "score"), "id", "left"
    ).select("id", F.coalesce("label", F.lit(-1)).alias("label"), F.coalesce("score", F.lit(0.0)).alias("score"))


def fill_noise(items: DataFrame, metric: str = "euclidean") -> DataFrame:
    """Items labelled -1 take label and score of the nearest labelled item.

    ``items`` is (id, vec, label, score).
    """
    noise, known = items.filter("label = -1"), items.filter("label <> -1")
    nearest = topk_similar(noise.select("id", "vec"), known.select("id", "vec"), 1, metric=metric)
    filled = nearest.join(known.select(F.col("id").alias("right_id"), "label", "score"), "right_id").select(
        F.col("left_id").alias("id"), "label", "score", F.lit(True).alias("filled")
    )
    return known.select("id", "label", "score", F.lit(False).alias("filled")).unionByName(filled)
