"""Sources and sinks: tables written in each format to the shared folder, read back and compared with the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.plans.base import query, r, r6, table
from concord.runtime import shared_folder
from concord.sources import documents, instruments

SHARDS = 16
SHEETS = 3


def _folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/concord-{kind}-{uuid.uuid4().hex}"


def _write_instruments(spark: SparkSession, sf_dir: str, turned: bool = False) -> str:
    """Customers as instrument files, one per shard: header, value-range row, data. Every second file may turn its columns."""
    k = F.col("c_custkey")
    note = F.when(k % 5 == 0, "NA").when(k % 7 == 0, "").otherwise(F.concat(F.lit("n"), k))
    data = table(spark, sf_dir, "customer").select(
        (k % SHARDS).cast("int").alias("shard"), F.lit(1).alias("kind"), k.cast("string").alias("subject"), F.col("c_acctbal").cast("string").alias("balance"), note.alias("note")
    )
    ranges = data.select("shard").distinct().select("shard", F.lit(0).alias("kind"), F.lit("key").alias("subject"), F.lit("-999::9999").alias("balance"), F.lit("free").alias("note"))
    path = _folder(spark, "instruments")
    rows = data.unionByName(ranges).repartition(SHARDS, "shard").sortWithinPartitions("shard", "kind")
    parts = [(rows, ("subject", "balance", "note"))] if not turned else [
        (rows.filter("shard % 2 = 0"), ("subject", "balance", "note")), (rows.filter("shard % 2 = 1"), ("note", "subject", "balance"))
    ]
    for part, columns in parts:
        part.select("shard", *columns).write.mode("append").partitionBy("shard").csv(path, sep="\t", header=True, quote="", nullValue=None, emptyValue="")
    return path


@query("SELECT c_custkey::VARCHAR AS subject, c_acctbal AS balance, CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 THEN 'n' || c_custkey END AS note FROM customer")
def instrument_table(spark, sf_dir):
    df = instruments.read_instrument(spark, _write_instruments(spark, sf_dir)).select("subject", "balance", "note")
    return instruments.numeric_columns(df, ["balance"])


@query(f"SELECT 'shard=' || (c_custkey % {SHARDS}) AS source, c_custkey::VARCHAR AS id FROM customer")
def instrument_subjects(spark, sf_dir):
    return instruments.scan_folder(spark, _write_instruments(spark, sf_dir, turned=True), "subject", "*.csv", depth=2)


@query("SELECT l_orderkey::DOUBLE AS l_orderkey, l_linenumber::DOUBLE AS l_linenumber, CASE WHEN l_linenumber <> 3 THEN l_quantity::DOUBLE END AS quantity, l_discount::DOUBLE AS l_discount FROM lineitem")
def fixed_matrix(spark, sf_dir):
    path = _folder(spark, "matrix")
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("quantity"), "l_discount")
    return instruments.read_fixed_matrix(spark, path, instruments.write_fixed_matrix(df, path))


@query("SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def table_file(spark, sf_dir):
    path = _folder(spark, "table")
    instruments.write_table(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice"), path, ["p_partkey"], "csv")
    return instruments.read_table(spark, path, "p_partkey long, p_name string, p_size int, p_retailprice double", "csv")


@query(f"""SELECT o_orderpriority AS section, o_orderstatus AS status, count(*) FILTER (o_orderpriority NOT LIKE '1%' OR o_custkey % 2 = 0) AS n,
    {r("sum(o_totalprice) FILTER (o_orderpriority NOT LIKE '1%' OR o_custkey % 2 = 0)", 2)} AS total FROM orders GROUP BY ALL HAVING n > 0""")
def replaced_sections(spark, sf_dir):
    """All sections first, then one of them again from half of its rows."""
    path = _folder(spark, "sections")
    o = table(spark, sf_dir, "orders").withColumn("section", F.col("o_orderpriority"))
    summary = lambda df: df.groupBy("section", F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), r6(F.sum("o_totalprice"), 2).alias("total"))
    instruments.upsert_section(summary(o), path)
    instruments.upsert_section(summary(o.filter("section LIKE '1%' AND o_custkey % 2 = 0")), path)
    return instruments.read_table(spark, path).select("section", "status", "n", "total")


@query("""SELECT 'nation=' || c_nationkey AS subfolder, '3F' AS model, 'Value ' || count(*) || chr(10) || 'CFI 0.9' AS text FROM customer GROUP BY c_nationkey""")
def report_files(spark, sf_dir):
    path = _folder(spark, "reports")
    text = F.concat(F.lit("Value "), F.count(F.lit(1)).cast("string"), F.lit("\nCFI 0.9"))
    counted = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(text.alias("value"))
    counted.write.partitionBy("nation").text(path)
    return documents.read_reports(spark, path, "*.txt").select("subfolder", "model", F.rtrim("text", F.lit("\n")).alias("text"))


@query(f"""WITH p AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'attention' WHEN 1 THEN 'working_memory' ELSE 'flexibility_shift' END AS a, CASE WHEN p_size % 2 = 0 THEN 'working_memory' ELSE 'attention' END AS b FROM part)
    SELECT 'I' || p_partkey AS id, p_partkey % {SHEETS} = 2 AS is_uc, a AS rater1, CASE WHEN p_partkey % 4 <> 0 THEN b END AS rater2, NULL::VARCHAR AS explicit FROM p""")
def review_sheets(spark, sf_dir):
    """Sheets with a legend of many lines, turned columns, cells with line breaks, and items that only some sheets name by id."""
    p = table(spark, sf_dir, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    a = F.when(size % 3 == 0, "ATT\n(see notes)").when(size % 3 == 1, "WM").otherwise("FS")
    b = F.when(k % 4 != 0, F.when(size % 2 == 0, "WM, ATT").otherwise("ATT"))
    title = F.concat("p_name", F.lit(" "), k)
    rows = p.select(k.alias("k"), F.lit(2).alias("kind"), F.when(k % 10 != 9, F.concat(F.lit("I"), k)).alias("c0"), title.alias("c1"), a.alias("c2"), b.alias("c3"))
    lines = [(0, "Legend", None, None, None)] + [(0, f"code {i}", "meaning", None, None) for i in range(60)] + [(1, "Item ID", "Title", "Rater A", "Rater B")]
    head = spark.createDataFrame(lines, "kind int, c0 string, c1 string, c2 string, c3 string")
    sheets = {}
    for i in range(SHEETS):
        own = rows.filter(F.col("k") % SHEETS == i).drop("k").unionByName(head)
        sheets["uc" if i == 2 else f"main{i}"] = path = _folder(spark, "sheet")
        # a sheet is one file
        own.repartition(1).sortWithinPartitions("kind").select("c0", "c1", "c2", "c3").write.csv(path, escape='"', quoteAll=False)
    items = p.select(F.concat(F.lit("I"), k).alias("id"), title.alias("title"))
    columns = {"item": ["item"], "title": ["title"], "rater1": ["rater a"], "rater2": ["rater b"], "explicit": ["agreed"]}
    return documents.read_review(spark, sheets, items, columns).select("id", "is_uc", "rater1", "rater2", "explicit")
