"""Instrument files, fixed matrices, tables and keyed sections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.functions.recode import to_num
from concord.runtime import broadcast_if_small

NULL_TEXTS = ("", "NA")


def read_instrument(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated file, all columns STRING; the value-range row under the header is dropped.

    Row positions do not exist once a file is split, so the range row is recognised by its
    text, which is read from the head of the file.
    """
    head = [r["value"] for r in spark.read.text(path).head(2)]
    names = head[0].rstrip("\r").split("\t")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = spark.read.csv(path, sep="\t", header=True, schema=schema, quote="")
    if len(head) > 1:
        fields = head[1].rstrip("\r").split("\t")
        rows = rows.filter(F.coalesce(F.concat_ws("\t", *[F.coalesce(n, F.lit("")) for n in names]), F.lit("")) != "\t".join(fields))
    return rows.select(*[F.when(~F.col(n).isin(*NULL_TEXTS), F.col(n)).alias(n) for n in names])


def numeric_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: to_num(c) for c in cols})


def scan_instruments(spark: SparkSession, paths: Mapping[str, str], subject: str) -> DataFrame:
    """(source, id) over several instrument files."""
    out = None
    for name, path in paths.items():
        part = read_instrument(spark, path).select(F.lit(name).alias("source"), F.col(subject).alias("id"))
        out = part if out is None else out.unionByName(part)
    return out


def scan_folder(spark: SparkSession, folder: str, subject: str, pattern: str = "*", depth: int = 1) -> DataFrame:
    """(source, id) over every instrument file below a folder, in one read.

    The source is the file's name without its ending, or with ``depth`` 2 the name of its folder.
    Files may order their columns differently; those without the subject column are left out.
    """
    meta = F.col("_metadata")
    lines = spark.read.text(folder, recursiveFileLookup=True, pathGlobFilter=pattern).select(
        meta["file_path"].alias("path"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"),
        F.rtrim(F.col("value"), F.lit("\r")).alias("line"),
    )
    place = F.struct("block", "at")
    heads = lines.groupBy("path").agg(F.min_by("line", place).alias("header"), F.min(place).alias("first"))
    heads = heads.withColumn("column", F.array_position(F.split("header", "\t"), subject).cast("int")).filter(F.col("column") > 0)
    # the header and the value-range row below it stand together at the head of the file
    data = lines.join(broadcast_if_small(heads), "path").filter((F.col("block") > 0) | (F.col("at") > F.col("first.at") + 1))
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -depth), r"\.[^.]*$", "")
    value = F.get(F.split("line", "\t"), F.col("column") - 1)
    return data.select(name.alias("source"), F.when(~value.isin(*NULL_TEXTS), value).alias("id"))


def write_fixed_matrix(df: DataFrame, path: str, sentinel: int = -999) -> list[str]:
    """Space-delimited values without header or quotes, nulls as the sentinel; returns the names.

    The names go to a one-column file beside it, ``<path>_names``.
    """
    filled = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit(str(sentinel))).alias(c) for c in df.columns])
    filled.write.mode("overwrite").csv(path, sep=" ", header=False, quote="")
    df.sparkSession.createDataFrame([(n,) for n in df.columns], "name string").coalesce(1).write.mode("overwrite").text(f"{path}_names")
    return df.columns


def read_fixed_matrix(spark: SparkSession, path: str, names: Sequence[str], sentinel: float = -999.0) -> DataFrame:
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.csv(path, sep=" ", header=False, schema=schema).select(
        *[to_num(n, (sentinel,)).alias(n) for n in names]
    )


def write_table(df: DataFrame, path: str, order: Sequence[str] = (), fmt: str = "parquet") -> None:
    """Table without an index; order is only kept by the listed sort columns."""
    out = df.orderBy(*order) if order else df
    writer = out.write.mode("overwrite")
    writer.csv(path, header=True) if fmt == "csv" else writer.parquet(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, fmt: str = "parquet") -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.csv(path, header=True) if fmt == "csv" else reader.parquet(path)


def upsert_section(rows: DataFrame, path: str) -> None:
    """Replace the sections present in ``rows`` (section, ...), keep all others.

    Sections are partitions, replaced by dynamic partition overwrite.
    """
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("section").parquet(path)
