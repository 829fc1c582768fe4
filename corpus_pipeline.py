"""The corpus pipeline: quality, language, near-duplicates, mixing, packing.

Each stage takes what its predecessor kept and returns the columns of
``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diagspark.llm._common import stored
from diagspark.llm.langid import add_language, train_languages
from diagspark.llm.mixing import in_mixture_order, source_weights
from diagspark.llm.packing import packed
from diagspark.llm.quality import score_quality, train_quality
from diagspark.llm.simhash import without_similar

#: Bytes of a batch of rows that goes to a Python worker, at most: there, texts are held several times over.
BATCH_BYTES = 8 << 20
#: A language prediction below this score is a rejection, as is 'und'.
LEAST_LANGUAGE_SCORE = 0.2


def _small_batches(spark: SparkSession) -> None:
    """Lower the session's limit of a batch to BATCH_BYTES; a lower one stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.5 or more.

    Null and empty texts are scored as empty; repeated rows fare alike.
    Columns of any name are kept.
    """
    _small_batches(spark)
    model = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_quality(docs.select(F.struct("*").alias("row")), model, text="row.text", score="quality")
    return scored.where(F.col("quality") >= 0.5).select("row.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is recognised.

    Null texts and texts without a letter go; repeated rows fare alike.
    Columns of any name are kept.
    """
    _small_batches(spark)
    found = add_language(docs.select(F.struct("*").alias("row")), train_languages(docs), text="row.text", name="language")
    sure = (F.col("language.lang") != "und") & (F.col("language.score") >= LEAST_LANGUAGE_SCORE)
    return found.where(sure).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose five-word shingles have a Jaccard similarity of 0.8 or more.

    The row of the smallest doc_id stays; ids that are null come last. Null,
    empty and blank texts are alike; of repeated rows one stays.
    """
    _small_batches(spark)
    return without_similar(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, laid out in the order of the mixture; a null source counts as ''.

    Documents of one source lie by their ids' hashes, ties by id and text;
    repeated rows stay, one after the other. Columns of any name are kept.
    """
    _small_batches(spark)
    return in_mixture_order(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences, in which sources have the target weights of the mixture.

    Null and empty texts are one end token; repeated rows are packed as often
    as they occur; where ids are equal, any order of their rows is right.
    """
    _small_batches(spark)
    return packed(docs, weights=source_weights(docs), keep_words=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("language ID", language),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mixing),
    ("packing", packing),
]

#: SQL expresses none of the stages; the tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
