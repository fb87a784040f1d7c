"""The corpus pipeline: quality, near-duplicates, benchmark windows, personal data, mixture.

Every stage takes the rows that the stage before kept, written as Parquet and read again, and all but the last
return the columns of ``documents``:

1. quality: the random-indexing classifier; documents that it rejects (probability below 0.5) go;
2. near_duplicates: the n-gram Jaccard join at five words and similarity 0.8; one document of each class stays;
3. decontamination: documents that hold a window of ten benchmark words (or a whole shorter item) go;
4. pseudonyms: personal data is replaced within its format;
5. mixture: documents are taken 0 to 3 times, so that sources come near their target words; a document is as many
   rows as it is taken, numbered by ``copy_number``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from concord.llm import decontaminate, mixing, ngram_join, pseudonyms, quality
from concord.llm.queries import in_fold
from concord.llm.store import materialize

# of the test tables; a run over real data sets a secret of its own
KEY = "test key"

# the classifier's training and the near-duplicate search have no SQL form
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    vectors, network = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~in_fold(3, 1))
    return quality.keep_good(docs, vectors, network)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(docs, KEY)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", distinct_texts),
    ("decontamination", not_in_benchmark),
    ("pseudonyms", without_personal_data),
    ("mixture", mixed_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
