"""Ordered operations on series that may be very long.

A window over one host or series puts all its rows in one task. These work by
day instead: rows are dealt by (key, day), and what has to cross a day's edge
(the last row, a running total) goes through a small table of days.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = ("ts", "seq")


def _day(ts: str) -> Column:
    return F.date_trunc("day", F.col(ts))


def previous(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("host",), order: Sequence[str] = ORDER) -> DataFrame:
    """``df`` with ``prev_<column>`` of the row just before, of the same key; null for a key's first row."""
    keys, order = list(keys), list(order)
    packed = F.struct(*columns)
    dealt = df.withColumns({"__day": _day(order[0]), "__own": packed})
    inside = Window.partitionBy(*keys, "__day").orderBy(*order)
    last = dealt.groupBy(*keys, "__day").agg(F.max_by("__own", F.struct(*order)).alias("__last"))
    before = last.select(*keys, "__day", F.lag("__last").over(Window.partitionBy(*keys).orderBy("__day")).alias("__before"))
    joined = dealt.withColumn("__lag", F.lag("__own").over(inside)).join(before, [*keys, "__day"])
    found = joined.withColumn("__found", F.coalesce("__lag", "__before"))
    return found.select(*df.columns, *(F.col(f"__found.{c}").alias(f"prev_{c}") for c in columns))


def runnings(df: DataFrame, values: dict[str, Column], keys: Sequence[str], order: Sequence[str] = ORDER, totals: dict[str, str] | None = None, stretch: Column | None = None) -> DataFrame:
    """``df`` with the running sum of each value, up to and with each row, and the key's totals of those in ``totals``.

    Rows are dealt by day, or by ``stretch``, which must not fall along the order.
    """
    keys, order, names = list(keys), list(order), list(values)
    dealt = df.withColumns({"__day": _day(order[0]) if stretch is None else stretch, **{f"__value_{n}": v for n, v in values.items()}})
    inside = Window.partitionBy(*keys, "__day").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    days = dealt.groupBy(*keys, "__day").agg(*(F.sum(f"__value_{n}").alias(f"__sum_{n}") for n in names))
    earlier = Window.partitionBy(*keys).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    all_days = Window.partitionBy(*keys)
    whole = [F.sum(f"__sum_{n}").over(all_days).alias(f"__total_{n}") for n in totals or ()]
    offsets = days.select(*keys, "__day", *(F.coalesce(F.sum(f"__sum_{n}").over(earlier), F.lit(0)).alias(f"__offset_{n}") for n in names), *whole)
    summed = dealt.withColumns({f"__run_{n}": F.sum(f"__value_{n}").over(inside) for n in names})
    joined = summed.join(offsets, [*keys, "__day"])
    return joined.select(*df.columns, *((F.col(f"__run_{n}") + F.col(f"__offset_{n}")).alias(n) for n in names), *(F.col(f"__total_{n}").alias(t) for n, t in (totals or {}).items()))


def running(df: DataFrame, value: Column, name: str, keys: Sequence[str], order: Sequence[str] = ORDER, total: str | None = None, stretch: Column | None = None) -> DataFrame:
    """``df`` with the running sum of one value, and maybe the key's total."""
    return runnings(df, {name: value}, keys, order, {name: total} if total else None, stretch)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ORDER, name: str = "n", total: str = "total") -> DataFrame:
    """``df`` with each row's place in its key from 0, and the key's number of rows."""
    counted = running(df, F.lit(1).cast("long"), name, keys, order, total)
    return counted.withColumn(name, F.col(name) - 1)
