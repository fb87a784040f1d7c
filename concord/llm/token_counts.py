"""Token counts by a separator scan of flat, unindexed token files.

A token file is a run of little-endian ids without any index; a document ends with the end-of-document id.
Files are read in blocks of ``block_bytes``. A block's ends are found in one vectorised comparison; it yields
the lengths between its ends, and the tokens before the first and after the last one. A prefix scan over the
few numbers of each block then says how many documents came before it and how many tokens its first document
already had, so documents may span any number of blocks.

Defined cases: an empty text has 0 tokens; tokens after a file's last end form one more document; an empty
file has none; a file whose size is no multiple of the id's width raises.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concord.llm.store import materialize, partitions_for, small_batches
from concord.llm.warc import filesystem

BLOCK_BYTES = 4 << 20
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the pattern that this public vocabulary was made with
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """The byte-level tokenizer of a rank file, loaded once in a Python worker."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _ENCODERS[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def id_type(eod: int) -> str:
    """The narrowest unsigned type that holds all ids up to the end-of-document id."""
    return "<u2" if eod < 1 << 16 else "<u4"


def write_tokens(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, eod: int = 50256) -> DataFrame:
    """One token file per partition of ``docs``; (file, ordinal, doc_id) says which document is where.

    A file is renamed when complete and carries its partition's number, so a task that runs again replaces it.
    """
    small_batches(docs)
    kind = id_type(eod)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, enc = TaskContext.get(), encoder(vocabulary)
        store, base = filesystem(folder)
        store.create_dir(base, recursive=True)
        name = f"tokens-{context.partitionId():06d}.bin"
        draft, n, out = f"{base}/.{context.taskAttemptId()}.draft", 0, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            out = out or store.open_output_stream(draft)
            for text in batch.column(1):
                ids = enc.encode_to_numpy(text.as_py() or "", disallowed_special=())
                out.write(np.append(ids, eod).astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * batch.num_rows), pa.array(np.arange(n, n + batch.num_rows)), batch.column(0)], names=["file", "ordinal", "doc_id"]
            )
            n += batch.num_rows
        if out is not None:
            out.close()
            store.move(draft, f"{base}/{name}")

    return materialize(docs.select("doc_id", "text").mapInArrow(run, "file string, ordinal long, doc_id long"))


def scan_block(ids: np.ndarray, eod: int) -> tuple[int, int, int, list[int]]:
    """(ends, tokens before the first, tokens after the last, lengths between ends) of a block; all tokens are "after" without an end."""
    ends = np.flatnonzero(ids == eod)
    if len(ends) == 0:
        return 0, 0, len(ids), []
    return len(ends), int(ends[0]), len(ids) - int(ends[-1]) - 1, (np.diff(ends) - 1).tolist()


def token_counts(spark: SparkSession, folder: str, eod: int = 50256, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, ordinal, n_tokens) of every document of every token file in ``folder``."""
    kind = id_type(eod)
    width = np.dtype(kind).itemsize
    block_bytes -= block_bytes % width
    # the listing does not read the files' content
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select("path", "length")
    blocks = files.filter("length > 0").select(
        "path", "length", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(block_bytes).cast("long"))).alias("block", "at")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = filesystem(folder)
        for batch in batches:
            out = []
            for path, length, block, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if length % width:
                    raise ValueError(f"{path}: {length} bytes are no whole number of ids")
                with store.open_input_file(filesystem(path)[1]) as source:
                    source.seek(at)
                    ids = np.frombuffer(source.read(min(block_bytes, length - at)), dtype=kind)
                out.append((path.rsplit("/", 1)[1], block, *scan_block(ids, eod)))
            names = ["file", "block", "ends", "head", "tail", "inner"]
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    # blocks are dealt evenly, whatever the sizes of the files; the result is a few numbers per document
    scanned = materialize(
        blocks.repartition(partitions_for(blocks)).mapInArrow(run, "file string, block int, ends long, head long, tail long, inner array<long>")
    )
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    numbers = scanned.select("file", "block", "ends", "tail")
    marked = numbers.select(
        "file", "block", "ends", "tail", F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("first"),
        F.coalesce(F.sum((F.col("ends") > 0).cast("int")).over(before), F.lit(0)).alias("run"),
        F.coalesce(F.last(F.when(F.col("ends") > 0, F.col("tail")), ignorenulls=True).over(before), F.lit(0)).alias("left"),
        (F.row_number().over(Window.partitionBy("file").orderBy(F.col("block").desc())) == 1).alias("final"),
    )
    within = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = marked.withColumn("carry", F.col("left") + F.coalesce(F.sum(F.when(F.col("ends") == 0, F.col("tail"))).over(within), F.lit(0)))
    joined = scanned.select("file", "block", "head", "inner").join(carried, ["file", "block"])
    closed = F.when(F.col("ends") > 0, F.concat(F.array(F.col("carry") + F.col("head")), F.col("inner"))).otherwise(F.array().cast("array<long>"))
    rest = F.col("tail") + F.when(F.col("ends") == 0, F.col("carry")).otherwise(0)
    lengths = F.when(F.col("final") & (rest > 0), F.concat(closed, F.array(rest))).otherwise(closed)
    return joined.select("file", "first", F.posexplode(lengths).alias("i", "n_tokens")).select("file", (F.col("first") + F.col("i")).alias("ordinal"), "n_tokens")
