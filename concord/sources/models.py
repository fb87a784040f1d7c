"""Factor models: documents to membership rows and back, and id-aligned vectors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Keys of a model document that are not factors.
NOT_FACTORS = ("description", "source")


def load_factor_model(spark: SparkSession, document: Mapping[str, object], model: str) -> DataFrame:
    """(model, label, factor_ord, id, ord) from a small ``{factor: [items]}`` document."""
    factors = [(k, v) for k, v in document.items() if k not in NOT_FACTORS]
    rows = [(model, f, i, str(item), j) for i, (f, items) in enumerate(factors) for j, item in enumerate(items)]
    return spark.createDataFrame(rows, "model string, label string, factor_ord int, id string, ord int")


def memberships_from_json(df: DataFrame, doc: str = "doc") -> DataFrame:
    """Membership rows from a column of JSON model documents, at any number of models.

    Adds (label, id, item_ord); the columns next to ``doc`` are kept.
    """
    kept = [c for c in df.columns if c != doc]
    parsed = F.from_json(doc, "map<string,string>")
    listed = df.select(*kept, F.explode(parsed).alias("label", "items")).filter(~F.col("label").isin(*NOT_FACTORS))
    return listed.select(*kept, "label", F.posexplode(F.from_json("items", "array<string>")).alias("item_ord", "id"))


def factor_spec(assigned: DataFrame, order: Sequence[str], items: DataFrame, part_items: int = 100_000) -> DataFrame:
    """(factor_key, label, n_items, part, item_ids, item_indices) from (id, label).

    Keys F1..Fn follow the canonical order of the labels that occur; indices are 1-based
    positions in ``items`` (id, ord). At any size a row is the part of a factor that lies in
    ``part_items`` consecutive positions, numbered from 0.
    """
    ranks = F.array(*[F.lit(o) for o in order])
    rank = F.array_position(ranks, F.col("label"))
    parts = assigned.join(items, "id").groupBy("label", F.floor(F.col("ord") / part_items).alias("part")).agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("ord", "id"))).alias("l")
    )
    sizes = parts.groupBy("label").agg(F.sum("n").alias("n_items")).withColumn(
        "rank", F.when(rank > 0, rank).otherwise(F.lit(len(order) + 1))
    )
    key = F.row_number().over(Window.orderBy("rank", "label"))  # one row per factor
    numbered = sizes.select("label", "n_items", F.concat(F.lit("F"), key.cast("string")).alias("factor_key"))
    return parts.join(numbered, "label").select(
        "factor_key", "label", "n_items", "part", F.transform("l", lambda s: s["id"]).alias("item_ids"),
        F.transform("l", lambda s: s["ord"] + 1).alias("item_indices"),
    )


def aligned_vectors(items: DataFrame, vectors: DataFrame, labels: DataFrame, check: bool = True) -> DataFrame:
    """(item columns, vec, label) joined on id; with ``check`` any id missing somewhere is an error."""
    if check:
        # one aggregate: which of the three tables hold an id
        tables = {"items": items, "vectors": vectors, "labels": labels}
        flags = None
        for name, t in tables.items():
            own = t.select("id", *[F.lit(n == name).alias(n) for n in tables])
            flags = own if flags is None else flags.unionByName(own)
        seen = flags.groupBy("id").agg(*[F.max(n).alias(n) for n in tables])
        short = seen.agg(*[F.count_if(F.col("items") != F.col(n)).alias(n) for n in ("vectors", "labels")]).first()
        for name in ("vectors", "labels"):
            if short[name]:
                raise ValueError(f"items and {name} do not hold the same ids")
    return items.join(vectors.select("id", "vec"), "id").join(labels.select("id", "label"), "id")
