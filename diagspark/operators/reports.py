"""Interval report tables of a server's samples (flat columns), and the tables of a report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clamp0, ratio, seconds_between
from .series import interval_mean, thin
from .windows import ORDER, numbered

OPS = ("ops_command", "ops_delete", "ops_getmore", "ops_insert", "ops_query", "ops_update")
DOCUMENTS = ("scanned", "scanned_objects", "scan_and_order", "write_conflicts", "doc_deleted", "doc_inserted", "doc_returned", "doc_updated")
CACHE_GAUGES = ("cache_max", "cache_used", "cache_dirty")
CACHE_COUNTERS = ("modified_evicted", "unmodified_evicted", "cache_read_in", "cache_written_from")
TICKETS = ("read_available", "read_out", "read_total", "write_available", "write_out", "write_total")
LOCKS = ("clients_total", "clients_readers", "clients_writers", "queue_total", "queue_readers", "queue_writers")
DEFAULT_SPAN = 60.0


def _kept(samples: DataFrame, span: float, columns: Sequence[str], keys: Sequence[str], order: Sequence[str], keep_last: bool = False) -> DataFrame:
    """Kept rows with prev_ columns of the kept row before; there are few of them."""
    kept = thin(samples, span, keys, order, keep_last)
    before = Window.partitionBy(*keys).orderBy(*order)
    return kept.withColumns({f"prev_{c}": F.lag(c).over(before) for c in dict.fromkeys([*columns, order[0]])})


def _grown(column: str) -> Column:
    return F.col(column) - F.col(f"prev_{column}")


def ops_report(samples: DataFrame, span: float = DEFAULT_SPAN, keys: Sequence[str] = ("host",), order: Sequence[str] = ORDER) -> DataFrame:
    """Operations between reported rows: the second row, then every one at least ``span`` seconds on, and the last.

    A counter that fell marks a restart, with no figures.
    """
    ranked = numbered(samples, keys, order, "__n", "__all")
    first = ranked.where("__n = 0").drop("__n", "__all")
    rest = thin(ranked.where("__n > 0").drop("__n", "__all"), span, keys, order, keep_last=True)
    before = Window.partitionBy(*keys).orderBy(*order)
    counters = ["page_faults", *OPS]
    rows = first.union(rest).withColumns({f"prev_{c}": F.lag(c).over(before) for c in [*counters, order[0]]}).where(F.col(f"prev_{order[0]}").isNotNull())
    total = sum((_grown(c) for c in OPS[1:]), _grown(OPS[0]))
    seconds = F.floor(seconds_between(F.col(f"prev_{order[0]}"), F.col(order[0])))
    restart = F.least(*(_grown(c) for c in counters)) < 0
    shown = lambda c: F.when(~restart, c)
    rate = F.when(seconds > 0, F.floor(ratio(total, seconds))).otherwise(0).cast("bigint")
    return rows.select(*keys, *order, restart.alias("restart"), "mem_resident", "mem_virtual", *(shown(_grown(c)).alias(c) for c in counters), shown(rate).alias("ops_per_second"))


def latency_report(samples: DataFrame, span: float = DEFAULT_SPAN, keys: Sequence[str] = ("host",), order: Sequence[str] = ORDER) -> DataFrame:
    """Mean latency in ms of reads, writes and commands so far, at kept rows."""
    kinds = ("reads", "writes", "commands")
    means = [F.when(F.col(f"{k}_ops") > 0, ratio(F.col(f"{k}_latency"), F.col(f"{k}_ops")) / 1000).otherwise(0.0).alias(k) for k in kinds]
    return thin(samples, span, keys, order).select(*keys, *order, *means)


def document_report(samples: DataFrame, span: float = DEFAULT_SPAN, keys: Sequence[str] = ("host",), order: Sequence[str] = ORDER) -> DataFrame:
    """Documents between kept rows; an uptime that did not grow marks a restart."""
    kept = _kept(samples, span, [*DOCUMENTS, "uptime"], keys, order).where(F.col(f"prev_{order[0]}").isNotNull())
    restart = F.col("uptime") <= F.col("prev_uptime")
    return kept.select(*keys, *order, restart.alias("restart"), *(F.when(~restart, _grown(c)).alias(c) for c in DOCUMENTS))


def lock_report(samples: DataFrame, span: float = DEFAULT_SPAN, keys: Sequence[str] = ("host",), order: Sequence[str] = ORDER) -> DataFrame:
    """Total lock time in ms, and mean clients and queue, of each interval; a total that fell marks a restart."""
    means = interval_mean(samples, span, LOCKS, keys, order)
    marks = _kept(samples.select(*keys, *order, "lock_time"), span, ["lock_time"], keys, order, keep_last=True)
    ended = marks.withColumnRenamed(order[0], "until").where(F.col(f"prev_{order[0]}").isNotNull())
    restart = _grown("lock_time") < 0
    return ended.join(means, [*keys, "until"]).select(*keys, "until", restart.alias("restart"), F.when(~restart, F.floor(_grown("lock_time") / 1000)).alias("lock_ms"), *LOCKS)


def cache_report(samples: DataFrame, span: float = DEFAULT_SPAN, keys: Sequence[str] = ("host",), order: Sequence[str] = ORDER) -> DataFrame:
    """Cache gauges at kept rows, and evictions and traffic a minute; after an uptime fall the count begins anew."""
    kept = _kept(samples, span, [*CACHE_COUNTERS, "uptime"], keys, order)
    minutes = seconds_between(F.col(f"prev_{order[0]}"), F.col(order[0])) / 60
    rows = kept.where(F.col(f"prev_{order[0]}").isNotNull() & (F.col("uptime") >= F.col("prev_uptime")))
    return rows.select(*keys, *order, *CACHE_GAUGES, *(ratio(clamp0(_grown(c)), minutes).alias(c) for c in CACHE_COUNTERS))


def ticket_report(samples: DataFrame, span: float = DEFAULT_SPAN, keys: Sequence[str] = ("host",), order: Sequence[str] = ORDER) -> DataFrame:
    """Mean available, used and total tickets of each interval."""
    return interval_mean(samples, span, TICKETS, keys, order)


def automatic_span(samples: DataFrame, ts: str = "ts") -> float:
    """A twentieth of the time that the samples take, in whole seconds."""
    edge = samples.agg(seconds_between(F.min(ts), F.max(ts)).alias("s")).first()["s"] or 0
    return edge // 20


def all_reports(samples: DataFrame, span: float = -1, keys: Sequence[str] = ("host",), order: Sequence[str] = ORDER) -> dict[str, DataFrame]:
    """Every report; a negative span is the automatic one."""
    if span < 0:
        span = automatic_span(samples, order[0])
    made = {"ops": ops_report, "latency": latency_report, "documents": document_report, "locks": lock_report, "cache": cache_report, "tickets": ticket_report}
    return {name: f(samples, span, keys, order) for name, f in made.items()}


def report(stats: DataFrame, anomalies: DataFrame, findings: DataFrame, summary: DataFrame) -> dict[str, DataFrame]:
    """The tables of a diagnosis report by name."""
    from .anomalies import timeline

    head = stats.agg(F.countDistinct("host").alias("hosts"), F.count("*").alias("metrics"))
    return {"header": head, "summary": summary, "timeline": timeline(anomalies), "findings": findings, "stats": stats}


def save_report(tables: dict[str, DataFrame], path: str, form: str = "parquet") -> None:
    """Write each table to a folder of its name, as Parquet or JSON."""
    for name, table in tables.items():
        table.write.format(form).save(f"{path}/{name}")
