"""Report trees and review sheets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.functions.recode import primary_label
from concord.operators.ranking import any_flag_first


def read_reports(spark: SparkSession, folder: str, pattern: str = "*.out") -> DataFrame:
    """(source, file_name, subfolder, model, text): one row per report of a directory tree."""
    raw = (
        spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
        .select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("source"))
    )
    parts = F.split("source", "/")
    name = F.element_at(parts, -1)
    return raw.select(
        "source", name.alias("file_name"), F.element_at(parts, -2).alias("subfolder"),
        report_variant(name).alias("model"), "text",
    )


def report_variant(file_name: Column) -> Column:
    """UNIDIM, CONSTRAINT or 3F, from the file name."""
    lower = F.lower(file_name)
    return F.when(lower.contains("constraint"), "CONSTRAINT").when(lower.contains("_unidim"), "UNIDIM").otherwise("3F")


def read_review(
    spark: SparkSession,
    sheets: Mapping[str, str],
    items: DataFrame,
    columns: Mapping[str, Sequence[str]],
    flag_text: str = "uc",
    width: int = 64,
) -> DataFrame:
    """One rater table from CSV sheets with differing headers.

    ``columns`` maps each output name (item, title, rater1, rater2, explicit) to substrings
    that identify its header cell. The header is the first row, however far down, with a cell
    that names an item column; rows above it are legend and fall out. Cells may hold line
    breaks. Sheets have up to ``width`` columns. Rows are known by item id, or by title where
    they have none; ids that are not in ``items`` are kept, rows with neither are not. Sheets
    whose name contains ``flag_text`` set the flag, OR-ed per item.
    """
    out = None
    names = [f"c{i}" for i in range(width)]
    for sheet, path in sheets.items():
        raw = spark.read.csv(path, header=False, schema=", ".join(f"{n} string" for n in names), multiLine=True, escape='"')
        raw = raw.withColumn("at", F.monotonically_increasing_id())
        cells = F.array(*names)
        named = F.exists(cells, lambda c: F.coalesce(F.greatest(*[F.lower(c).contains(s) for s in columns["item"]], F.lit(False)), F.lit(False)))
        top = raw.filter(named).orderBy("at").first()
        if top is None:
            raise ValueError(f"{path}: no row names an item column ({', '.join(columns['item'])})")
        header = [(top[n] or "").strip().lower() for n in names]

        def cell(keys: Sequence[str]) -> Column:
            at = next((i for i, h in enumerate(header) if any(k in h for k in keys)), None)
            return F.lit(None).cast("string") if at is None else F.nullif(F.trim(names[at]), F.lit(""))

        part = raw.filter(F.col("at") > top["at"]).select(F.lit(sheet).alias("sheet"), *[cell(keys).alias(n) for n, keys in columns.items()])
        out = part if out is None else out.unionByName(part)
    known = items.select("id", F.lower(F.trim("title")).alias("key"))
    by_title = known.groupBy("key").agg(F.min("id").alias("title_id"))
    rows = (
        out.withColumn("key", F.lower(F.trim("title"))).join(by_title, "key", "left")
        .join(known.select(F.col("id").alias("item"), F.col("id").alias("item_id")), "item", "left")
        .withColumn("id", F.coalesce("item_id", "title_id", "item")).filter("id is not null")
    )
    rated = rows.select(
        "id", F.lower("sheet").contains(flag_text).alias("is_uc"), "sheet",
        *[primary_label(c).alias(c) for c in ("rater1", "rater2", "explicit")],
    )
    return any_flag_first(rated, "id", "is_uc", ["sheet"])
