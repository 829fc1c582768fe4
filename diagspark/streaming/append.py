"""Incremental append: only rows strictly later than what is stored."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def last_times(rows: DataFrame, keys: Sequence[str] = ("host",), ts: str = "ts") -> DataFrame:
    """keys, __last: the latest time of each key."""
    return rows.groupBy(*keys).agg(F.max(ts).alias("__last"))


def later_rows(last: DataFrame, new: DataFrame, keys: Sequence[str] = ("host",), ts: str = "ts") -> DataFrame:
    """The rows of ``new`` that are later than their key's last time, or whose key is new."""
    joined = new.join(last, list(keys), "left")
    return joined.where(F.col("__last").isNull() | (F.col(ts) > F.col("__last"))).select(*new.columns)


def append_new(store: DataFrame, new: DataFrame, keys: Sequence[str] = ("host",), ts: str = "ts") -> DataFrame:
    """The rows of ``new`` that are later than the last stored row of their key, or whose key is new."""
    return later_rows(last_times(store, keys, ts), new, keys, ts)


def appended(store: DataFrame, new: DataFrame, keys: Sequence[str] = ("host",), ts: str = "ts") -> DataFrame:
    """The store with the new rows."""
    return store.unionByName(append_new(store, new, keys, ts))


def left_out(store: DataFrame, new: DataFrame, keys: Sequence[str] = ("host",), ts: str = "ts") -> DataFrame:
    """How many rows of ``new`` come too late, by key."""
    joined = new.join(last_times(store, keys, ts), list(keys)).where(F.col(ts) <= F.col("__last"))
    return joined.groupBy(*keys).agg(F.count("*").alias("left_out"))


@dataclass(frozen=True)
class Store:
    """A table that grows by batches, with the last time of each key beside it.

    ``rows/batch=N`` holds what batch N added, ``last/batch=N`` the last times
    after it. A batch reads the last times before it (a row a key), never the
    stored rows. Both are written with overwrite, the times last, so a batch
    that is repeated, wholly or from the middle, leaves the same.
    """

    spark: SparkSession
    path: str
    keys: tuple[str, ...] = ("host",)
    ts: str = "ts"

    def _batches(self) -> list[int]:
        """The batches that are complete."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/last")
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return []
        names = [f.getPath().getName() for f in files.listStatus(folder)]
        whole = [n for n in names if n.startswith("batch=") and files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(folder, f"{n}/_SUCCESS"))]
        return sorted(int(n.removeprefix("batch=")) for n in whole)

    def take(self, new: DataFrame, batch: int) -> None:
        """Add what is later than the stored rows; the first batch of a store is taken whole."""
        before = max((b for b in self._batches() if b < batch), default=None)
        at = lambda kind, n: f"{self.path}/{kind}/batch={n}"
        if before is None:
            fresh, old = new, None
        else:
            old = self.spark.read.parquet(at("last", before))
            fresh = later_rows(old, new, self.keys, self.ts)
        fresh.write.mode("overwrite").parquet(at("rows", batch))
        grown = last_times(self.spark.read.schema(new.schema).parquet(at("rows", batch)), self.keys, self.ts)
        if old is not None:
            grown = old.unionByName(grown).groupBy(*self.keys).agg(F.max("__last").alias("__last"))
        grown.write.mode("overwrite").parquet(at("last", batch))

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows").drop("batch")


def reload(spark: SparkSession, source: str, store: str, checkpoint: str, schema, keys: Sequence[str] = ("host",), ts: str = "ts") -> DataFrame:
    """Take all new Parquet files of a folder into the store, once, and return the stored rows.

    Files taken before are not read again, nor are stored rows.
    """
    kept = Store(spark, store, tuple(keys), ts)
    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(kept.take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return kept.rows()


def reload_tables(spark: SparkSession, source: str, store: str, checkpoint: str, schemas: Mapping[str, object], keys: Sequence[str] = ("host",), ts: str = "ts") -> dict[str, DataFrame]:
    """``reload`` of several tables (status, system, replica), each with its own last times; a table of the source folder is a folder of its own."""
    return {name: reload(spark, f"{source}/{name}", f"{store}/{name}", f"{checkpoint}/{name}", schema, keys, ts) for name, schema in schemas.items()}
