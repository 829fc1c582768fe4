"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import scratch


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    This cuts the lineage in a way that survives the loss of executors, and
    it fixes what is not deterministic (row order, partition numbers).
    ``options`` are the Parquet writer's.
    """
    path = scratch(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, buckets: int, key: str, **options: str) -> DataFrame:
    """``df`` written to the shared folder in buckets by ``key`` and read again: grouping by the key, and by more, needs no exchange then.

    ``df`` should be dealt by the key to as many partitions, so that a task
    writes one bucket, or have few large rows. ``options`` are the Parquet
    writer's.
    """
    path = scratch(df.sparkSession, name)
    table = path.rpartition("/")[2].replace("-", "_")
    df.write.bucketBy(buckets, key).options(path=path, **options).saveAsTable(table)
    return df.sparkSession.table(table)


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as ''."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % F.lit(parts)


def whole(text: str) -> Column:
    """The text; '' for null."""
    return F.coalesce(F.col(text), F.lit(""))
