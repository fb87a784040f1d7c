"""Line dedup: lines that many documents share stay in one of them, and the others keep a bitmap of what is left.

A line's key is the line without ASCII white space at both ends, A-Z in lower case. Keys of at least ``least_length``
code points found in ``least_documents`` documents or more lose their lines in all documents but that of the largest
id (where all of them stay). Spark SQL functions only:

1. A line is a row of two 64-bit hashes of its key, its document and its position; texts are not moved.
2. Rows are range-partitioned by the hashes and sorted by document and position within a key, so a key's first
   occurrence and its number of documents are read off the sorted stream. A key that a large part of all lines has is
   cut into cells by a hash of the document first: hash slots with more than 1 / ``CELLS`` of the lines, fewer than
   ``CELLS`` of them, are counted beforehand and broadcast. The cells' first occurrences are then put together; cells
   divide the documents, so their numbers of documents add up.
3. A document gets a bitmap of 64-bit words, 1 for a line to keep; only words with a line to drop are there, all
   others are ones. Its text is read once more to apply it.

Cases: a null or empty text is one empty line. Rows of one id are one document when documents are counted, and each row
is cleaned by itself; rows without an id are one document, smaller than all others. Repeated rows are all returned, with
equal results. Blank lines have short keys and stay. Other columns are neither used nor changed. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.llm.store import join_shared, materialize, partitions_for

LEAST_LENGTH = 20
LEAST_DOCUMENTS = 3
CELLS = 1024
SPACE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_name(text: str = "text") -> Column:
    """What tells texts of one id apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def lines_of(text: str = "text") -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def line_keys(docs: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(h1, h2, doc_id, t, pos) of every line whose key is long enough."""
    lines = docs.select("doc_id", text_name().alias("t"), F.posexplode(lines_of()).alias("pos", "line"))
    key = lines.select("doc_id", "t", "pos", F.btrim("line", F.lit(SPACE)).alias("line")).filter(F.char_length("line") >= least_length)
    # lower() takes A-Z alone where all characters are ASCII, and is much faster there
    ascii_only = F.octet_length("line") == F.char_length("line")
    low = F.when(ascii_only, F.lower("line")).otherwise(F.translate("line", UPPER, LOWER))
    key = key.select("doc_id", "t", "pos", low.alias("key"))
    return key.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "t", "pos")


def _in_cells(lines: DataFrame, total: int) -> DataFrame:
    """The lines with ``cell``: null, or a part of the documents for keys in a slot that holds too many lines for one task."""
    slot = F.shiftrightunsigned("h1", 44).alias("slot")
    # fewer than CELLS slots can hold more than that part of all lines
    slots = lines.select(slot).groupBy("slot").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") * CELLS > total)
    slots = slots.select("slot", F.ceil(F.col("n") * CELLS / total).alias("parts"))
    cell = F.pmod(F.xxhash64("doc_id", "t"), F.col("parts")).cast("int").alias("cell")
    return lines.select("*", slot).join(F.broadcast(slots), "slot", "left").select(*lines.columns, cell)


def dropped_lines(lines: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """(doc_id, t, pos) of the lines that go, from ``line_keys``."""
    lines = materialize(lines)
    total = lines.count()
    dealt = _in_cells(lines, total).repartitionByRange(partitions_for(lines), "h1", "h2", "cell")
    # the range partitioning serves the windows: one sort within partitions is all they add
    cell = Window.partitionBy("h1", "h2", "cell")
    by_document = F.col("doc_id").desc_nulls_last()
    seen = dealt.withColumn("place", F.row_number().over(cell.orderBy(by_document, "t", "pos")))
    seen = seen.withColumn("document", F.dense_rank().over(cell.orderBy(by_document)))
    seen = seen.withColumn("documents", F.max("document").over(cell))
    whole = F.col("cell").isNull()
    seen = materialize(seen.filter(~whole | ((F.col("documents") >= least_documents) & (F.col("document") > 1))))
    parts = seen.filter(~whole)
    # one row of each cell, its first occurrence, has all that the key needs
    firsts = parts.filter("place = 1").select("h1", "h2", "doc_id", "documents")
    sizes = parts.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    keys = firsts.groupBy("h1", "h2").agg(F.max("doc_id").alias("last"), F.sum("documents").alias("documents")).filter(F.col("documents") >= least_documents)
    keys = materialize(keys.join(sizes, ["h1", "h2"]).drop("documents"))
    shared = join_shared(parts.select("h1", "h2", "doc_id", "t", "pos"), keys, ["h1", "h2"], "n", total, "inner")
    return seen.filter(whole).select("doc_id", "t", "pos").unionByName(shared.filter(~F.col("doc_id").eqNullSafe(F.col("last"))).select("doc_id", "t", "pos"))


def keep_bitmaps(docs: DataFrame, least_length: int = LEAST_LENGTH, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """(doc_id, t, n_dropped, bitmap) of the documents that lose lines; ``t`` is ``text_name`` of the text.

    ``bitmap`` is an array of (word, keep), ascending: bit ``i`` of ``keep`` is 1 if line ``64 * word + i`` stays.
    """
    gone = dropped_lines(line_keys(docs, least_length), least_documents)
    words = gone.groupBy("doc_id", "t", F.expr("cast(pos div 64 AS int)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, pos % 64))").alias("gone"))
    return words.groupBy("doc_id", "t").agg(
        F.sum(F.bit_count("gone")).cast("long").alias("n_dropped"),
        F.array_sort(F.collect_list(F.struct("word", F.bitwise_not("gone").alias("keep")))).alias("bitmap"),
    )


def kept_text(lines: str, dense: str) -> Column:
    """The lines whose bits are 1, joined; ``dense`` names the bitmap's words from the first line on."""
    bit = f"shiftrightunsigned({dense}[cast(i div 64 AS int)], cast(i % 64 AS int)) & 1L"
    return F.expr(f"array_join(filter({lines}, (x, i) -> i >= 64 * size({dense}) OR ({bit}) = 1L), '\\n')")


def dense_words(bitmap: str) -> Column:
    """The bitmap's words with those that it leaves out."""
    before = f"CASE WHEN i = 0 THEN -1 ELSE {bitmap}[i - 1].word END"
    return F.expr(f"flatten(transform({bitmap}, (x, i) -> concat(array_repeat(-1L, x.word - 1 - ({before})), array(x.keep))))")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` without the lines that their bitmaps drop, with ``n_lines`` (before) and ``n_dropped``."""
    # the document's own columns stay together, so none clashes with these
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), F.col("doc_id").alias("__id"), text_name().alias("__t"))
    maps = bitmaps.select(F.col("doc_id").alias("__of"), F.col("t").alias("__of_t"), "n_dropped", "bitmap")
    joined = own.join(maps, F.col("__id").eqNullSafe(F.col("__of")) & (F.col("__t") == F.col("__of_t")), "left")
    cut = joined.select("__doc", "n_dropped", lines_of("__doc.text").alias("__lines"), dense_words("bitmap").alias("__dense"))
    text = F.when(F.col("n_dropped").isNull(), F.col("__doc.text")).otherwise(kept_text("__lines", "__dense"))
    columns = [text.alias(c) if c == "text" else F.col("__doc").getField(c).alias(c) for c in docs.columns]
    return cut.select(*columns, F.size("__lines").cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"))


def dedup_lines(docs: DataFrame, least_length: int = LEAST_LENGTH, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """``docs`` with shared lines in one document each, and ``n_lines`` and ``n_dropped``."""
    return apply_bitmaps(docs, materialize(keep_bitmaps(docs, least_length, least_documents)))
