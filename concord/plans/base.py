"""Registry of queries and the SQL each must equal, and the shared inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with its equivalent SQL if there is one."""

    def register(fn: Query) -> Query:
        if fn.__name__ in QUERIES:
            raise ValueError(f"{fn.__name__} is registered twice")
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(col: Column | str, digits: int = 6) -> Column:
    """Rounded double, so values from two engines compare equal."""
    return F.round(col, digits)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vec, label) of the embeddings."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


# SQL counterparts of the shared inputs
E = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec, label FROM embeddings)"


def centroid_cte(name: str, source: str, label: str = "label", where: str = "true") -> str:
    """Mean vector per label as a list, in SQL."""
    return f"""{name} AS (SELECT label, list(m ORDER BY pos) AS vec, any_value(n) AS n FROM (
        SELECT label, pos, avg(x) AS m, count(*) AS n FROM (
            SELECT {label} AS label, unnest(vec) AS x, generate_subscripts(vec, 1) AS pos FROM {source} WHERE {where}
        ) GROUP BY label, pos) GROUP BY label)"""


def r(sql: str, digits: int = 6) -> str:
    """Rounded value in SQL, without a negative zero."""
    return f"(round({sql}, {digits}) + 0.0)"


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, ord): items listed under one or two of five factors, some under none.

    Factor one is the label modulo 5; every third id has a second factor, every seventh none.
    """
    base = items(spark, sf_dir).filter("id % 7 <> 0")
    first = F.struct(F.concat(F.lit("f"), F.col("label") % 5).alias("label"), F.lit(0).alias("ord"))
    second = F.struct(F.concat(F.lit("f"), (F.col("label") + F.lit(1)) % 5).alias("label"), F.lit(1).alias("ord"))
    return base.select(
        "id", F.explode(F.when(F.col("id") % 3 == 0, F.array(first, second)).otherwise(F.array(first))).alias("m")
    ).select("id", "m.label", "m.ord")


M = """m AS (SELECT vec_id AS id, 'f' || (label % 5) AS label, 0 AS ord FROM embeddings WHERE vec_id % 7 <> 0
    UNION ALL SELECT vec_id, 'f' || ((label + 1) % 5), 1 FROM embeddings WHERE vec_id % 7 <> 0 AND vec_id % 3 = 0)"""


def detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label): another labelling of the same items, right for most of them."""
    e = items(spark, sf_dir)
    return e.select("id", F.concat(F.lit("f"), F.when(F.col("id") % 4 == 0, F.col("id") % 5).otherwise(F.col("label") % 5).cast("int")).alias("label"))


D = "d AS (SELECT vec_id AS id, 'f' || (CASE WHEN vec_id % 4 = 0 THEN vec_id % 5 ELSE label % 5 END) AS label FROM embeddings)"
