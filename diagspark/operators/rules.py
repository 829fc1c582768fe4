"""Diagnosis rules: predicates over a host's scores, and the symptoms that support them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import UNKNOWN, is_problem

SEVERITIES = ("critical", "warning", "info")


#: Beginnings of the names of entity metrics; they support findings, but do not score rules.
ENTITY_FAMILIES = ("disku_", "iops_", "repl_lag_")
_SYMPTOMS = "array<struct<name:string,entity:string,score:int,value:double>>"


class Metrics:
    """Columns of one host's statistics: a map from metric to struct<score, p5, median, p95>."""

    def __init__(self, column: str = "metrics") -> None:
        self.map = F.col(column)

    def score(self, metric: str) -> Column:
        return F.coalesce(self.map[metric]["score"], F.lit(UNKNOWN))

    def value(self, metric: str, statistic: str = "p95") -> Column:
        return F.coalesce(self.map[metric][statistic], F.lit(0.0))

    def family(self, prefix: str) -> Column:
        """The entries of all metrics that begin with ``prefix``."""
        return F.filter(F.map_entries(self.map), lambda e: e["key"].startswith(prefix))

    def any_below(self, prefix: str, score: int) -> Column:
        return F.exists(self.family(prefix), lambda e: is_problem(e["value"]["score"], score))

    def each(self, prefix: str, test: Callable[[Column], Column]) -> Column:
        """A symptom for every entity of a family whose statistics pass the test, by entity; named after the family."""
        hit = F.filter(self.family(prefix), lambda e: test(e["value"]))
        made = F.transform(hit, lambda e: F.struct(F.lit(prefix.rstrip("_")).alias("name"), F.substr(e["key"], F.lit(len(prefix) + 1)).alias("entity"), e["value"]["score"].alias("score"), e["value"]["p95"].alias("value")))
        return F.array_sort(made).cast(_SYMPTOMS)

    def one(self, name: str, condition: Column, value: Column) -> Column:
        """The symptom of a metric, if the condition holds."""
        made = F.array(F.struct(F.lit(name).alias("name"), F.lit("").alias("entity"), self.map[name]["score"].alias("score"), value.alias("value")))
        return F.when(condition, made.cast(_SYMPTOMS)).otherwise(F.array().cast(_SYMPTOMS))


@dataclass
class Rule:
    """A finding holds if ``when`` does and there is at least one symptom.

    A symptom is (name, condition, value), or a column of symptoms such as
    ``Metrics.each`` gives, of as many entities as show it.
    """

    name: str
    severity: str
    description: str
    when: Column
    symptoms: Sequence[tuple[str, Column, Column] | Column]
    suggestion: str = ""


def default_rules(m: Metrics | None = None) -> list[Rule]:
    """The ten rules."""
    m = m or Metrics()
    s, v = m.score, m.value
    low: Callable[[str, int], tuple[str, Column, Column]] = lambda metric, below: (metric, s(metric) < below, v(metric))
    lagging = lambda x: (x["score"] < UNKNOWN) & (x["p95"] > 0)
    busy = lambda x: x["score"] < 50
    known = lambda metric, least=0: (s(metric) < UNKNOWN) & (v(metric) > least)
    over = lambda metric, least: (metric, known(metric, least), v(metric))
    return [
        Rule("Connection Pool Misconfiguration", "warning", "Many connections take memory", (s("conns_current") < 50) | ((s("conns_current") < 70) & (s("mem_resident") < 50)),
             [low("conns_current", 70), ("conns_created/s", s("conns_created/s") < 50, v("conns_created/s", "median")), low("mem_resident", 70), low("latency_read", 50)], "Use smaller pools."),
        Rule("Replication Lag Issues", "critical", "Secondaries fall behind the primary", m.any_below("repl_lag_", 50),
             [m.each("repl_lag_", lagging), ("ops_insert", v("ops_insert") > 1000, v("ops_insert")), ("ops_update", v("ops_update") > 1000, v("ops_update"))], "Check the network and the secondaries."),
        Rule("Working Set Exceeds RAM", "critical", "Active data is larger than memory", (s("wt_cache_used") < 30) | ((s("wt_modified_evicted") < 50) & (s("wt_unmodified_evicted") < 50)) | (s("mem_page_faults") < 50),
             [low("wt_cache_used", 50), low("wt_modified_evicted", 50), low("wt_unmodified_evicted", 50), low("mem_page_faults", 50), m.each("disku_", busy)], "Add memory or shrink the working set."),
        Rule("Write Contention", "warning", "Writes wait for each other", (s("write_conflicts/s") < 50) | (s("txn_aborted/s") < 50),
             [over("write_conflicts/s", 0), over("txn_aborted/s", 0), over("txn_inactive", 0), low("q_queued_write", 50)], "Spread writes; shorten transactions."),
        Rule("Missing Indexes", "warning", "Queries examine far more than they return", (s("query_targeting_keys") < 50) | (s("query_targeting_objects") < 50) | (s("scan_keys") < 50),
             [over("query_targeting_keys", 1), over("query_targeting_objects", 1), low("scan_keys", 50), low("scan_objects", 50)], "Look for slow queries without an index."),
        Rule("Memory Fragmentation", "info", "The allocator holds memory that is not in use", s("tcmalloc_fragmentation") < 50, [low("tcmalloc_fragmentation", 50)], "Plan a restart."),
        Rule("CPU Saturation", "warning", "Processors are busy", (s("cpu_idle") < 30) | (s("cpu_user") < 30) | (s("cpu_system") < 30),
             [("cpu_idle", (s("cpu_idle") < 50) & (v("cpu_idle", "p5") < 100), v("cpu_idle", "p5")), low("cpu_user", 50), low("cpu_system", 50), low("cpu_iowait", 50)], "Add cores or reduce load."),
        Rule("Disk I/O Bottleneck", "warning", "A disk is saturated", m.any_below("disku_", 30),
             [m.each("disku_", busy), m.each("iops_", busy), low("cpu_iowait", 50)], "Use faster disks."),
        Rule("Flow Control Activated", "warning", "Writes are held back for lagging members", known("flowctl_lagged_count") | (s("flowctl_acquiring_us") < 50),
             [over("flowctl_lagged_count", 0), ("flowctl_acquiring_us", known("flowctl_acquiring_us"), v("flowctl_acquiring_us") / 1000)], "See replication lag."),
        Rule("Admission Control Queuing", "warning", "Operations wait for tickets", (s("queues_read_out") < 50) | (s("queues_write_out") < 50),
             [(q, known(q), v(q)) for q in ("queues_read_out", "queues_write_out")], "Reduce concurrent operations."),
    ]


def diagnose(stats: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """host, rule, severity, score, symptoms (name, entity, score, value) of every rule that holds, by severity and score.

    ``stats`` has host, metric, score, p5, median, p95. A rule's score is the
    worst known score of the metrics whose first word is in the rule's name;
    if none of those is below 100, the worst of all. Metrics of disks and
    members do not count for it.
    """
    wide = stats.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("metric", F.struct("score", "p5", "median", "p95")))).alias("metrics"))
    entries = F.filter(F.map_entries("metrics"), lambda e: ~reduce(Column.__or__, [e["key"].startswith(f) for f in ENTITY_FAMILIES]))
    worst = lambda items: F.array_min(F.filter(F.transform(items, lambda e: e["value"]["score"]), lambda x: x < UNKNOWN))
    m = Metrics()

    def row(rule: Rule) -> Column:
        kin = F.filter(entries, lambda e: F.lit(rule.name.lower()).contains(F.split_part(e["key"], F.lit("_"), F.lit(1))))
        own = worst(kin)
        score = F.coalesce(F.when(own < 100, own), worst(entries), F.lit(100))
        symptoms = F.concat(*(x if isinstance(x, Column) else m.one(*x) for x in rule.symptoms))
        return F.struct(rule.when.alias("holds"), F.lit(rule.name).alias("rule"), F.lit(rule.severity).alias("severity"), score.cast("int").alias("score"), symptoms.alias("symptoms"))

    found = wide.select("host", F.explode(F.array(*map(row, rules or default_rules()))).alias("f")).select("host", "f.*")
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    return found.where("holds and size(symptoms) > 0").drop("holds").orderBy("host", rank, "score", "rule")


__all__ = ["Metrics", "Rule", "default_rules", "diagnose", "is_problem"]
