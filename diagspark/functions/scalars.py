"""Scalar functions on columns: clamps, units, labels, scores, texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = 101
#: Prefixes that a short label leaves out; of several that fit, the first.
LABEL_PREFIXES = (
    "conns_", "cpu_", "latency_", "mem_", "net_", "ops_", "q_active_", "q_queued_", "scan_", "ticket_", "wt_blkmgr_", "wt_cache_", "wt_dhandles_", "wt_",
)
#: Divisors of each unit.
UNITS = {"mb_to_gb": 1024.0, "bytes_to_mb": 1048576.0, "bytes_to_gb": 1073741824.0, "us_to_ms": 1000.0, "": 1.0}


def clamp0(value: Column) -> Column:
    """Negative values become 0; NaN and null stay."""
    return F.when(value < 0, F.lit(0.0)).otherwise(value.cast("double"))


def scale(value: Column, unit: str) -> Column:
    return value.cast("double") / F.lit(UNITS[unit])


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double; null where b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def seconds_between(earlier: Column, later: Column) -> Column:
    """Seconds as a double, to the microsecond."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))).cast("double") / 1e6


def short_label(label: Column) -> Column:
    """The label without its family's prefix (and, after ``wt_`` alone, without ``_evicted``)."""
    out = label
    for prefix in reversed(LABEL_PREFIXES):
        rest = F.substr(label, F.lit(len(prefix) + 1))
        if prefix == "wt_":
            rest = F.regexp_replace(rest, "_evicted$", "")
        out = F.when(label.startswith(prefix), rest).otherwise(out)
    return out


def score_label(metric: Column, normalised: Column) -> Column:
    """The label of a scored metric; percentages carry `` %``."""
    label = F.regexp_replace(metric, "modified_evicted$", "mod_evicted")
    percent = metric.startswith("cpu_") | metric.startswith("disku_") | normalised
    return F.when(percent, F.concat(label, F.lit(" %"))).otherwise(label)


def short_host(name: Column) -> Column:
    """Text before the first ``.`` and from the last ``:`` on; unchanged if either is missing."""
    both = name.contains(".") & name.contains(":")
    return F.when(both, F.concat(F.substring_index(name, ".", 1), F.lit(":"), F.substring_index(name, ":", -1))).otherwise(name)


def score_by_range(value: Column, low: Column, high: Column) -> Column:
    """100 below ``low``, 0 above ``high``, a line between; 101 for NaN and null."""
    line = F.floor(100 * (1 - (value - low) / (high - low))).cast("int")
    return F.when(value.isNull() | F.isnan(value), F.lit(UNKNOWN)).when(value < low, F.lit(100)).when(value > high, F.lit(0)).when(high == low, F.lit(100)).otherwise(line)


def is_problem(score: Column, below: int) -> Column:
    """The score is known and under the threshold."""
    return (score < below) & (score < UNKNOWN)


def percent_or_unknown(part: Column, whole: Column) -> Column:
    """100 * part / whole, or -1 where the whole is unknown (null or not above 0)."""
    return F.when(whole > 0, 100 * part / whole).otherwise(F.lit(-1.0))


def _printed(value: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", value)


def format_peak(peak: Column, metric: Column) -> Column:
    """A peak with its metric's unit."""
    percent = F.concat(F.format_string("%.0f", peak), F.lit("%"))
    return (
        F.when(metric.contains("latency"), F.concat(_printed(peak, 1), F.lit("ms")))
        .when(metric.contains("cpu") | metric.contains("disk_util"), percent)
        .when(metric.contains("repl_lag"), F.concat(_printed(peak, 1), F.lit("s")))
        .when(peak >= 1e6, F.concat(_printed(peak / 1e6, 1), F.lit("M")))
        .when(peak >= 1e3, F.concat(_printed(peak / 1e3, 1), F.lit("K")))
        .otherwise(_printed(peak, 0))
    )


def format_duration(seconds: Column) -> Column:
    """``Ns`` under a minute, ``Nm Ns`` under an hour, else ``Nh Nm``; the leading part is rounded."""
    whole = seconds.cast("long")
    under_hour = F.concat(_printed(seconds / 60, 0), F.lit("m "), (whole % 60).cast("string"), F.lit("s"))
    hours = F.concat(_printed(seconds / 3600, 0), F.lit("h "), (F.floor(seconds / 60) % 60).cast("string"), F.lit("m"))
    return F.when(seconds < 60, F.concat(_printed(seconds, 0), F.lit("s"))).when(seconds < 3600, under_hour).otherwise(hours)
