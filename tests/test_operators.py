"""Hand-made rows for the cases that the tables do not hold."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from diagspark.functions import scalars as P
from diagspark.operators import anomalies as I
from diagspark.operators import nested as N
from diagspark.operators import redact as X
from diagspark.operators import rules as R
from diagspark.operators import scoring as C
from diagspark.operators import series as T
from diagspark.operators import stats as A
from diagspark.operators import windows as W
from diagspark.plans import diagnosis as D
from diagspark.plans import metrics as M
from diagspark.streaming import append as S

BASE = dt.datetime(2024, 1, 1, 23, 59, 50)


def at(seconds: float) -> dt.datetime:
    return BASE + dt.timedelta(seconds=seconds)


def column(spark, values, kind, f):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in frame.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_scalars(spark):
    assert column(spark, [-1.0, 0.0, 2.5, None], "double", P.clamp0) == [0, 0, 2.5, None]
    labels = ["conns_current", "wt_cache_used", "wt_modified_evicted", "wt_dhandles_active", "txn_active", "q_queued_read"]
    assert column(spark, labels, "string", P.short_label) == ["current", "used", "modified", "active", "txn_active", "read"]
    assert column(spark, ["a.b.c:27017", "plain:1", "a.b", "x.y:1:2"], "string", P.short_host) == ["a:27017", "plain:1", "a.b", "x:2"]
    scores = column(spark, [float("nan"), None, 4.9, 5.0, 10.0, 15.0, 15.1], "double", lambda x: P.score_by_range(x, F.lit(5), F.lit(15)))
    assert scores == [101, 101, 100, 100, 50, 0, 0]
    assert column(spark, [59.0, 90.0, 3599.0, 7300.0], "double", P.format_duration) == ["59s", "2m 30s", "60m 59s", "2h 1m"]
    assert column(spark, [1234567.0, 1500.0, 12.0], "double", lambda x: P.format_peak(x, F.lit("scan_keys"))) == ["1.2M", "1.5K", "12"]


def samples(spark, rows):
    return spark.createDataFrame([("h", at(t), i, u, c) for i, (t, u, c) in enumerate(rows)], "host string, ts timestamp, seq long, uptime long, c long")


def test_rates_skip_restarts_and_never_fall(spark):
    rows = [(0, 10, 100), (1, 11, 110), (2, 11, 120), (3, 12, 90), (13, 22, 190), (13.2, 23, 200), (14, 1, 5), (15, 2, 7)]
    found = [(r["seq"], r["value"]) for r in T.counter_rate(samples(spark, rows), "c").orderBy("seq").collect()]
    assert found == [(1, 10), (3, 0), (4, 10), (5, 10), (7, 2)]
    assert [r["seq"] for r in T.gauge(samples(spark, rows), "c").orderBy("seq").collect()] == [0, 1, 3, 4, 5, 7]
    assert [r["value"] for r in T.counter_delta(samples(spark, rows), "c").orderBy("seq").collect()] == [10, 10, 0, 100, 10, 0, 2]


def test_empty_and_single_series(spark):
    none = samples(spark, []).select("host", F.lit("m").alias("metric"), F.lit("").alias("entity"), "ts", "seq", F.col("c").cast("double").alias("value"))
    assert T.slice_range(none, F.lit(at(0)), F.lit(at(9))).collect() == []
    assert A.index_percentiles(none).collect() == []
    one = samples(spark, [(0, 1, 7)]).select("host", F.lit("m").alias("metric"), F.lit("").alias("entity"), "ts", "seq", F.col("c").cast("double").alias("value"))
    assert T.slice_range(one, F.lit(at(0)), F.lit(at(9))).collect() == []
    (row,) = A.index_percentiles(one).collect()
    assert (row["p5"], row["median"], row["p95"]) == (7, 7, 7)


@pytest.mark.parametrize("n", [1800, 1801, 3599, 3600, 3601])
def test_downsampling_keeps_weight_and_bounds(spark, n):
    points = spark.range(n).select(F.lit("h").alias("host"), F.lit("m").alias("metric"), F.lit("").alias("entity"), F.timestamp_seconds(F.col("id")).alias("ts"), F.col("id").alias("n"), F.lit(n).alias("total"), F.col("id").cast("double").alias("value"))
    found = T.downsample(points).orderBy("bucket").collect()
    size = max(1, n // 1800)
    assert len(found) == -(-n // size) <= 3600
    assert found[0]["value"] == sum(range(size)) / size


def test_windows_by_day_equal_plain_windows(spark):
    rng = random.Random(5)
    rows = [(f"h{rng.randrange(3)}", dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(400)), i, rng.randrange(9)) for i in range(500)]
    frame = spark.createDataFrame(rows, "host string, ts timestamp, seq long, v long")
    per_host = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        per_host.setdefault(r[0], []).append(r)
    want = {r[2]: (None if i == 0 else rs[i - 1][3], sum(x[3] for x in rs[: i + 1]), i, len(rs)) for rs in per_host.values() for i, r in enumerate(rs)}
    found = W.numbered(W.running(W.previous(frame, ["v"]), F.col("v"), "total_v", ["host"]), ["host"]).collect()
    assert {r["seq"]: (r["prev_v"], r["total_v"], r["n"], r["total"]) for r in found} == want


def test_entities_that_come_late(spark):
    rows = [("h", "a", at(0), 0, 0, 5), ("h", "a", at(1), 0, 1, 7), ("h", "b", at(1), 0, 1, 100), ("h", "b", at(2), 0, 2, 130), ("h", "a", at(3), 0, 3, 9)]
    frame = spark.createDataFrame(rows, "host string, disk string, ts timestamp, seq long, sample long, reads long")
    found = {(r["disk"], r["ts"]): r["value"] for r in T.entity_delta(frame, "reads", "disk").collect()}
    assert found == {("a", at(1)): 2, ("b", at(1)): 100, ("b", at(2)): 30, ("a", at(3)): 9}


def test_shares_without_growth(spark):
    rows = [("h", at(i), i, a, b) for i, (a, b) in enumerate([(0, 0), (3, 1), (3, 1)])]
    found = T.share_of_delta(spark.createDataFrame(rows, "host string, ts timestamp, seq long, a long, b long"), ["a", "b"]).collect()
    assert {(r["seq"], r["metric"]): r["value"] for r in found} == {(1, "a"): 75, (1, "b"): 25, (2, "a"): 0, (2, "b"): 0}


def test_replica_lag(spark):
    m = lambda name, state, o: (name, state, o)
    rows = [
        ("h", at(0), [m("a", 1, 100), m("b", 2, 90)]), ("h", at(1), []), ("h", at(2), [m("b", 2, 95), m("a", 1, 110)]), ("h", at(3), [m("a", 2, 1), m("b", 2, 1)]),
        ("h", at(4), [m("a", 1, 5), m("b", 7, 0)]), ("h", at(5), [m("a", 1, 9), m("b", 2, 30), m("c", 5, 0)]), ("h", at(6), [m("a", 1, 9), m("b", 2, 30), m("c", 5, 0)]),
    ]
    frame = spark.createDataFrame(rows, "host string, ts timestamp, members array<struct<name: string, state: int, optime_s: long>>")
    found = {(r["ts"], r["entity"]): r["value"] for r in T.replication_lag(frame).collect()}
    assert found == {(at(2), "host-0"): 0, (at(2), "host-1"): 15, (at(4), "host-0"): 0, (at(6), "host-0"): 0, (at(6), "host-1"): 0, (at(6), "host-2"): 0}


def test_thinning_keeps_greedy_rows_and_the_last(spark):
    times = [0, 1, 4, 5, 6, 11, 12]
    frame = samples(spark, [(t, 1, t) for t in times])
    assert sorted(r["c"] for r in T.thin(frame, 5).collect()) == [0, 5, 11]
    assert sorted(r["c"] for r in T.thin(frame, 5, keep_last=True).collect()) == [0, 5, 11, 12]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        two = frame.union(frame.withColumn("host", F.lit("i")))
        assert sorted((r["host"], r["c"]) for r in T.thin(two, 5, keep_last=True).collect()) == [(h, c) for h in "hi" for c in (0, 5, 11, 12)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def stat(metric, p5=0.0, median=0.0, p95=0.0, **facts):
    return ("h", metric, float(p5), float(median), float(p95), *(facts.get(k) for k in ("mem_size_mb", "cache_gb", "tickets", "mean_ratio")))


STATS = "host string, metric string, p5 double, median double, p95 double, mem_size_mb double, cache_gb double, tickets double, mean_ratio double"


def test_scores(spark):
    rows = [
        stat("cpu_idle", p5=40), stat("conns_current", p95=150, mem_size_mb=1000.0), stat("iops_sda", median=100, p95=300), stat("iops_sdb", median=1, p95=99), stat("scan_objects", p95=999),
        stat("scan_objects ", p95=1), stat("wt_cache_used", p95=8.75, cache_gb=10.0), stat("wt_cache_dirty", p95=1), stat("mem_resident", p95=0.8, mem_size_mb=1024.0), stat("q_queued_read", p95=3),
        stat("queues_read_out", p95=70, tickets=100.0), stat("queues_write_out", p95=70), stat("flowctl_acquiring_us", p95=550_000), stat("query_targeting_keys", p95=0), stat("conns_created/s", median=2.5), stat("unknown", p95=1), stat("repl_lag_host-1", p95=17.5),
    ]
    found = {r["metric"]: r["score"] for r in C.score(spark.createDataFrame(rows, STATS), C.formula_table(spark)).collect()}
    assert found == {
        "cpu_idle": 0, "conns_current": 33, "iops_sda": 50, "iops_sdb": 101, "scan_objects": 100, "scan_objects ": 101, "wt_cache_used": 50, "wt_cache_dirty": 101, "mem_resident": 50, "q_queued_read": 50,
        "queues_read_out": 50, "queues_write_out": 101, "flowctl_acquiring_us": 50, "query_targeting_keys": 101, "conns_created/s": 50, "unknown": 101, "repl_lag_host-1": 50,
    }
    strict = {r["metric"]: r["score"] for r in C.score(spark.createDataFrame(rows, STATS), C.formula_table(spark), strict_parity=True).collect()}
    assert strict["q_queued_read"] == 101


def test_formulas_and_watermarks(spark):
    assert C.formula_table(spark).count() == 35
    info = spark.createDataFrame([("a", 4), ("b", None)], "host string, num_cores int")
    found = {(r["host"], r["metric"]): (r["low"], r["high"]) for r in C.core_watermarks(C.formula_table(spark), info).collect()}
    assert found["a", "queued_read"] == (4, 20) and found["b", "queued_read"] == (1, 5) and found["a", "cpu_idle"] == (50, 80)
    assert "72" in C.assessment(spark.createDataFrame([], "label string, metric string, score int, p5 double, median double, p95 double"), 73).first()["label"]


def test_runs_are_maximal(spark):
    values = [1, 9, 9, 1, 9, 5, 9, 9, 9]
    frame = spark.createDataFrame([("h", "m", "", at(i), i, float(v)) for i, v in enumerate(values)], "host string, metric string, entity string, ts timestamp, seq long, value double")
    found = sorted((r["start"], r["end"], r["points"], r["peak"]) for r in I.intervals_above(frame, F.lit(5.0)).collect())
    assert found == [(at(1), at(2), 2, 9), (at(4), at(4), 1, 9), (at(6), at(8), 3, 9)]
    low = I.intervals_below(frame, F.lit(5.0)).collect()
    assert sorted((r["start"], r["peak"]) for r in low) == [(at(0), 1), (at(3), 1)]


SCORED = "host string, metric string, score int, p5 double, median double, p95 double"


def test_rules(spark):
    rows = [("h", "conns_current", 60, 0.0, 0.0, 900.0), ("h", "mem_resident", 40, 0.0, 0.0, 88.0), ("h", "repl_lag_host-1", 10, 0.0, 0.0, 28.0), ("h", "cpu_user", 100, 0.0, 0.0, 1.0), ("g", "cpu_user", 20, 0.0, 0.0, 66.0), ("g", "tcmalloc_fragmentation", 0, 0.0, 0.0, 70.0)]
    found = R.diagnose(spark.createDataFrame(rows, SCORED)).collect()
    # Members' lag supports a finding, but a rule's score comes from the server's own metrics.
    assert [(r["host"], r["rule"], r["severity"], r["score"]) for r in found] == [
        ("g", "CPU Saturation", "warning", 20), ("g", "Memory Fragmentation", "info", 0), ("h", "Replication Lag Issues", "critical", 40), ("h", "Connection Pool Misconfiguration", "warning", 40),
    ]
    assert [tuple(s) for s in found[2]["symptoms"]] == [("repl_lag", "host-1", 10, 28.0)]
    assert {s["name"] for s in found[3]["symptoms"]} == {"conns_current", "mem_resident"}
    own = R.Rule("Mine", "info", "", R.Metrics().score("cpu_user") < 50, [("u", F.lit(True), R.Metrics().value("cpu_user"))])
    assert [r["host"] for r in R.diagnose(spark.createDataFrame(rows, SCORED), [own]).collect()] == ["g"]


def test_every_disk_and_member_is_a_symptom(spark):
    rows = [("h", f"disku_{d}", s, 0.0, 0.0, v) for d, s, v in (("sdb", 0, 93.0), ("sda", 0, 97.0), ("sdc", 60, 66.0))]
    rows += [("h", f"repl_lag_host-{i}", s, 0.0, 0.0, v) for i, s, v in ((2, 0, 40.0), (0, 4, 29.0), (1, 100, 1.0), (3, 100, 0.0), (4, 101, 9.0))]
    rows += [("h", "iops_sda", 10, 0.0, 0.0, 500.0), ("h", "cpu_user", 80, 0.0, 0.0, 55.0), ("h", "mem_page_faults", 30, 0.0, 0.0, 17.0)]
    found = {r["rule"]: r for r in R.diagnose(spark.createDataFrame(rows, SCORED)).collect()}
    shown = lambda rule: [(s["name"], s["entity"], s["value"]) for s in found[rule]["symptoms"]]
    assert shown("Disk I/O Bottleneck") == [("disku", "sda", 97), ("disku", "sdb", 93), ("iops", "sda", 500)]
    assert shown("Replication Lag Issues") == [("repl_lag", "host-0", 29), ("repl_lag", "host-1", 1), ("repl_lag", "host-2", 40)]
    assert shown("Working Set Exceeds RAM") == [("mem_page_faults", "", 17), ("disku", "sda", 97), ("disku", "sdb", 93)]
    assert {r["score"] for r in found.values()} == {30}


def test_redaction_truth_tables(spark):
    ips = {"192.168.1.1": True, "10.0.0.0/8": True, "255.255.255.255": True, "256.1.1.1": False, "1.2.3": False, "host.example.com": False, "1.2.3.4/33": False, "": False}
    assert column(spark, list(ips), "string", X.looks_like_ip) == list(ips.values())
    ports = {"host.example.com:27017": True, "10.0.0.1:80": True, "no-port": False, "a:b": False, "/path:1": False}
    assert column(spark, list(ports), "string", X.looks_like_host_port) == list(ports.values())
    assert column(spark, ["192.168.1.100"], "string", X.redact_ip) == ["10.42.57.241"]
    paths = column(spark, ["/srv/shard-01/data", "/var/lib/my-cluster/repl.conf", "/etc/plain", ""], "string", X.redact_path)
    assert paths[0].startswith("/srv/server-") and paths[0].endswith("/data") and paths[1].endswith("/repl.conf") and "cluster" not in paths[1] and paths[2:] == ["/etc/plain", ""]
    assert column(spark, ["CentOS Linux", "db1.example.com"], "string", lambda c: X.redact_text(c, "name"))[0] == "CentOS Linux"


def test_nested_redaction(spark):
    row = [(1, {"host": "db1.example.com", "note": "10.1.2.3", "other": "kept"}, [("db2.example.com:27017", 3)], "rs0", None, 7)]
    frame = spark.createDataFrame(row, "id int, m map<string,string>, members array<struct<name:string,state:int>>, setName string, dbPath string, n int")
    (r,) = X.redact(frame).collect()
    assert r["m"]["host"].startswith("host-") and r["m"]["note"].startswith("10.") and r["m"]["note"] != "10.1.2.3" and r["m"]["other"] == "kept"
    assert r["members"][0]["name"].endswith(":27017") and r["members"][0]["state"] == 3 and r["setName"].startswith("rs-") and r["dbPath"] is None and r["n"] == 7
    assert X.redact(frame).collect() == X.redact(frame).collect()


def test_numeric_paths(spark):
    frame = spark.createDataFrame([(1, (True, 2.9, "text", [(5,), (None,)], {"a/b": 3}, dt.datetime(2024, 1, 1)))], "k int, d struct<b:boolean,f:double,s:string,l:array<struct<x:long>>,m:map<string,int>,t:timestamp>")
    found = {r["path"]: r["value"] for r in N.flatten_numeric(frame, "d", ["k"]).collect()}
    assert found == {"b": 1, "f": 2, "l/0/x": 5, "m/a/b": 3, "t": 1704067200000}


def test_append_takes_only_later_rows(spark, tmp_path):
    schema = "host string, ts timestamp, v long"
    rows = lambda *xs: spark.createDataFrame([("h", at(t), v) for t, v in xs], schema)
    assert sorted(r["v"] for r in S.appended(rows((1, 1), (2, 2)), rows((2, 3), (3, 4))).collect()) == [1, 2, 4]
    source, store = f"{tmp_path}/in", f"{tmp_path}/store"
    rows((1, 1), (2, 2)).coalesce(1).write.parquet(source)
    S.reload(spark, source, store, f"{tmp_path}/check", schema)
    rows((2, 9), (3, 4)).coalesce(1).write.mode("append").parquet(source)
    S.reload(spark, source, store, f"{tmp_path}/check", schema)
    assert sorted(r["v"] for r in S.reload(spark, source, store, f"{tmp_path}/check", schema).collect()) == [1, 2, 4]


def test_a_repeated_batch_adds_nothing(spark, tmp_path):
    schema = "host string, ts timestamp, v long"
    rows = lambda *xs: spark.createDataFrame([(h, at(t), v) for h, t, v in xs], schema)
    store = S.Store(spark, f"{tmp_path}/store")
    first, second, third = rows(("a", 1, 1), ("b", 5, 2)), rows(("a", 1, 3), ("a", 2, 4), ("b", 4, 5), ("c", 0, 6)), rows(("c", 0, 7), ("c", 1, 8))
    for number, batch in enumerate((first, second, second, third)):
        store.take(batch, min(number, 1) if number < 3 else 2)
    assert sorted(r["v"] for r in store.rows().collect()) == [1, 2, 4, 6, 8]
    assert {r["host"]: r["__last"] for r in spark.read.parquet(f"{store.path}/last/batch=2").collect()} == {"a": at(2), "b": at(5), "c": at(1)}


def test_a_batch_reads_no_stored_sample(spark, tmp_path, monkeypatch):
    """Of the rows, only those that the batch itself has written are read."""
    schema = "host string, ts timestamp, v long"
    store = S.Store(spark, f"{tmp_path}/store")
    for n in range(3):
        store.take(spark.createDataFrame([("a", at(n), n)], schema), n)
    files = lambda n: list((tmp_path / f"store/rows/batch={n}").glob("*.parquet"))
    for n in (0, 1, 2):
        for f in files(n):
            f.unlink()  # the next batch works without them
    store.take(spark.createDataFrame([("a", at(2), 8), ("a", at(3), 9)], schema), 3)
    assert [r["v"] for r in spark.read.parquet(f"{store.path}/rows/batch=3").collect()] == [9]


def test_catalogue_and_diagnosis(spark):
    assert len(M.STATUS_METRICS) == 67 and len({m for m, *_ in M.STATUS_METRICS}) == 67
    paths = {p: i for i, p in enumerate(M.STATUS_PATHS)}
    rows = [("h", at(t), t, t + 1, *(1000 + (i + 1) * 50 * t for i in range(len(paths)))) for t in range(40)]
    schema = "host string, ts timestamp, seq long, uptime long, " + ", ".join(f"`{p}` long" for p in paths)
    points = M.status_points(spark.createDataFrame(rows, schema))
    one = {(r["metric"], r["seq"]): r["value"] for r in points.collect()}
    rate = 50 * (paths["opcounters/query"] + 1)
    assert one["ops_query", 1] == rate and ("ops_query", 0) not in one and one["conns_current", 0] == 1000
    assert len({m for m, _ in one}) == 67
    info = spark.createDataFrame([("h", 4096.0)], "host string, mem_size_mb double")
    made = D.diagnosis(points, F.lit(at(-1)), F.lit(at(100)), info)
    stats = {r["metric"]: r for r in made["stats"].collect()}
    assert stats["ops_query"]["p95"] == rate and stats["ops_query"]["label"] == "ops_query" and "tcmalloc_fragmentation" in stats
    assert made["findings"].count() > 0 and made["anomalies"].count() > 0


def test_disk_and_cpu_points(spark):
    disks = [("h", at(2 * t), 0, t, "sda", 10 * t, 20 * t, t, 5 * t, 400 * t, 7 * t, 3 * t) for t in range(3)]
    frame = spark.createDataFrame(disks, "host string, ts timestamp, seq long, sample long, disk string, read_time_ms long, write_time_ms long, io_in_progress long, io_queued_ms long, io_time_ms long, reads long, writes long")
    found = {(r["metric"], r["ts"]): r["value"] for r in M.disk_points(frame).collect()}
    assert found["disk_util", at(2)] == 40 and found["disk_iops", at(4)] == 5 and found["disks_queue_length", at(4)] == 2 and ("disk_util", at(0)) not in found


def test_diagnosis_says_when(spark):
    """Connections over 1.5 times their median and lag over 5 s are told with their times."""
    from diagspark.plans.diagnosis import diagnosis

    begin = dt.datetime(2024, 1, 1)
    rows = [("h", "conns_current", "", begin + dt.timedelta(seconds=i), i, 900.0 if 100 <= i < 160 else 500.0) for i in range(300)]
    rows += [("h", "repl_lag", "host-1", begin + dt.timedelta(seconds=i), i, 60.0 if i >= 200 else 1.0) for i in range(300)]
    points = spark.createDataFrame(rows, "host string, metric string, entity string, ts timestamp, seq long, value double")
    info = spark.createDataFrame([("h", 1024, 4)], "host string, mem_size_mb int, num_cores int")
    found = diagnosis(points, F.lit(begin), F.lit(begin + dt.timedelta(hours=1)), info)
    texts = {s["name"] + s["entity"]: s["timing"] for r in found["findings"].collect() for s in r["symptoms"]}
    assert texts["conns_current"] == "00:01:40 to 00:02:39 (1m, peak: 900)" or texts["conns_current"].startswith("at 00:01:40")
    assert texts["repl_laghost-1"].startswith("00:03:20 to 00:04:59") and "peak: 60.0s" in texts["repl_laghost-1"]
    assert {r["label"] for r in found["anomalies"].collect()} == {"> 5s"}


def test_map_keys_reach_lists_and_maps(spark):
    from diagspark.operators.redact import redact

    row = spark.range(1).select(
        F.create_map(F.lit("primary"), F.array(F.lit("db1.example.com"))).alias("lists"),
        F.create_map(F.lit("x"), F.create_map(F.lit("Host"), F.array(F.array(F.lit("db2.example.com"))))).alias("maps"),
        F.create_map(F.lit("me"), F.array(F.struct(F.lit("db3.example.com").alias("note"), F.lit("rs").alias("setName")))).alias("structs"),
    )
    r = redact(row).first()
    assert r["lists"]["primary"][0].startswith("host-") and r["maps"]["x"]["Host"][0][0].startswith("host-")
    assert r["structs"]["me"][0]["note"] == "db3.example.com" and r["structs"]["me"][0]["setName"].startswith("rs-")


def walked(times, span):
    """The greedy rows, one after the other."""
    kept = []
    for t in times:
        if not kept or t - kept[-1] >= span:
            kept.append(t)
    return kept


@pytest.mark.parametrize("span", [1.0, 40.0, 1000.0, 90_000.0])
def test_thinning_by_stretches_equals_the_walk(spark, span):
    rng = random.Random(int(span))
    rows = []
    for host in ("a", "b", None):
        t = rng.uniform(0, 5000)
        for i in range(400):
            # Dense stretches, gaps of hours and of several days, and equal times.
            t += rng.choice((0, 0.5, 1, 30, 70, 700, 30_000 if i % 9 == 0 else 2, 400_000 if i % 50 == 0 else 3))
            rows.append((host, at(round(t, 3)), i, round(t, 3)))
    frame = spark.createDataFrame(rows, "host string, ts timestamp, seq long, t double").repartition(5)
    for keep_last in (False, True):
        found = sorted((r["host"] or "", r["t"]) for r in T.thin(frame, span, keep_last=keep_last).collect())
        want = []
        for host in ("a", "b", None):
            times = [r[3] for r in rows if r[0] == host]
            kept = walked(times, span)
            last_seq_kept = kept[-1] == times[-1] and times[-2:-1] != times[-1:]
            want += [(host or "", t) for t in kept + ([times[-1]] if keep_last and not last_seq_kept else [])]
        assert found == sorted(want)


def test_outlets_of_a_stretch():
    from diagspark.operators.thinning import outlets

    rng = random.Random(2)
    for _ in range(200):
        times = sorted(rng.randint(1000, 1400) for _ in range(rng.randint(1, 60)))
        pairs = outlets(iter(times), 1000, 50)
        for before in range(900, 1000, 7):
            entry = next((f for f, _ in pairs if f >= before + 50), None)
            kept = walked([t for t in times if t >= before + 50], 50)
            assert (dict(pairs)[entry] if entry is not None else None) == (kept[-1] if kept else None)
        assert dict(pairs)[times[0]] == walked(times, 50)[-1]


def test_slice_reads_only_its_times(spark, tmp_path):
    rows = [("h", m, "", at(60 * i), i, float(i)) for m in "ab" for i in range(500)]
    spark.createDataFrame(rows, "host string, metric string, entity string, ts timestamp, seq long, value double").write.parquet(f"{tmp_path}/points")
    points = spark.read.parquet(f"{tmp_path}/points")
    cut = T.slice_range(points, F.lit(at(600)), F.lit(at(6000)))
    assert sorted((r["metric"], r["seq"], r["n"], r["total"]) for r in cut.collect()) == [(m, i, i - 10, 90) for m in "ab" for i in range(10, 100)]
    plan = cut._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert scans and all("LessThanOrEqual(ts," in line for line in scans)
    assert any("subquery" in line for line in scans)


@pytest.mark.parametrize("ranges", [2, 7, 256])
def test_rank_selection_equals_the_whole_order(spark, ranges):
    rng = random.Random(ranges)
    rows = [(k, v) for k, n, make in (("few", 3, lambda: rng.random()), ("one", 1, lambda: 5.0), ("ties", 900, lambda: float(rng.randint(0, 3))), ("many", 5000, lambda: rng.gauss(0, 1e6)), ("odd", 50, lambda: rng.choice((None, 1e300, -1.0)))) for v in (make() for _ in range(n))]
    frame = spark.createDataFrame(rows, "metric string, value double").repartition(4)
    plain = {r["metric"]: tuple(r) for r in A.index_percentiles(frame, ["metric"]).collect()}
    assert {r["metric"]: tuple(r) for r in A.rank_percentiles(frame, ["metric"], ranges).collect()} == plain and plain["many"][1] == 5000


DOCUMENTS = [
    '{"b":true,"f":-2.9,"s":"5","n":null,"l":[{"x":5},[6,"7",{"y":[]}]],"m":{"a/b":3}}', '{"k":1,"k":2,"o":{"z":"x","z":4,"z":5}}', "7", '"7"', "[]", "{}", '{"e":1e30,"d":12345678901234567890123,"ok":9223372036854775807}',
    "not json", None, "", '{"q":"{\\"x\\":[1]}","u":"\u00e9","w":{"\u00e9":8}}', "[[[[[[[[[[12]]]]]]]]]]",
]
PATHS = [
    {"b": 1, "f": -2, "l/0/x": 5, "l/1/0": 6, "m/a/b": 3}, {"k": 1, "o/z": 4}, {"": 7}, {}, {}, {}, {"ok": 9223372036854775807},
    {}, {}, {}, {"w/\u00e9": 8}, {"/".join("0" * 10): 12},
]


def test_numeric_paths_of_any_document(spark):
    from diagspark.operators.documents import flatten_documents

    frame = spark.createDataFrame(list(enumerate(DOCUMENTS)), "i int, text string")
    for source, column in ((frame, "text"), (frame.where("i <> 1").withColumn("v", F.try_parse_json("text")), "v")):
        found = [{} for _ in DOCUMENTS]
        for r in flatten_documents(source, column, ["i"]).collect():
            assert r["path"] not in found[r["i"]]
            found[r["i"]][r["path"]] = r["value"]
        assert found == [p if column == "text" or i != 1 else {} for i, p in enumerate(PATHS)]


def test_numeric_paths_of_texts_in_one_pass(spark):
    from diagspark.operators.documents import flatten_documents

    deep = "[" * 400 + "5" + "]" * 400
    texts = ["\n\t{\"a\": [1.9, -0.5, 2e3, true]}", deep, '{"":{"":1,"b":2}}', "[NaN,1]", "[01]", "12x", " 12 ", '{"n":-9223372036854775808,"m":9223372036854775808,"e":1e400}', '{"s":"\\ud800","\\ud800":3}']
    want = [{"a/0": 1, "a/1": 0, "a/2": 2000, "a/3": 1}, {"/".join("0" * 400): 5}, {"": 1, "b": 2}, {}, {}, {}, {"": 12}, {"n": -(1 << 63)}, {"?": 3}]
    found = [{} for _ in texts]
    frame = flatten_documents(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), "text", ["i"])
    for r in frame.collect():
        found[r["i"]][r["path"]] = r["value"]
    assert found == want
    assert "from_json" not in frame._jdf.queryExecution().executedPlan().toString()


def test_redaction_of_any_document(spark):
    import json

    from diagspark.operators.documents import redact_documents

    clear = {"host": "db1.example.com", "n": 1, "members": [{"name": "db2.example.com:27017", "tags": {"primary": ["db3.example.com", ["db4.example.com"], {"note": "db5"}]}}, None, 2.5, False], "at": "10.0.0.1", "empty": {}, "none": []}
    frame = spark.createDataFrame([(1, json.dumps(clear)), (2, "[1]"), (3, '"x"'), (4, "{"), (5, None)], "i int, d string")
    done = {r["i"]: r["d"] for r in redact_documents(frame, "d").collect()}
    assert done[2] == "[1]" and done[3] == '"x"' and done[4] is None and done[5] is None
    found = json.loads(done[1])
    one = found["members"][0]
    assert found["host"].startswith("host-") and found["n"] == 1 and one["name"].startswith("host-") and one["name"].endswith(".local:27017") and found["at"].startswith("10.") and found["at"] != "10.0.0.1"
    assert one["tags"]["primary"][0].startswith("host-") and one["tags"]["primary"][1][0].startswith("host-") and one["tags"]["primary"][2] == {"note": "db5"}
    assert found["members"][1:] == [None, 2.5, False] and found["empty"] == {} and found["none"] == [] and "example.com" not in done[1]
    typed = redact_documents(frame.where("i < 3").withColumn("d", F.parse_json("d")), "d")
    assert typed.schema["d"].dataType.simpleString() == "variant" and {r["j"] for r in typed.select(F.to_json("d").alias("j")).collect()} == {done[1], done[2]}


def test_automatic_span_and_saved_report(spark, tmp_path):
    from diagspark.operators import reports as L

    assert L.automatic_span(samples(spark, [(0, 1, 1), (205, 2, 2)])) == 10
    L.save_report({"stats": spark.range(3)}, f"{tmp_path}/r", "json")
    assert spark.read.json(f"{tmp_path}/r/stats").count() == 3


def test_storage_sizes_round_ties_to_even(spark):
    from diagspark.operators.query import storage_size

    sizes = [0, 1023, 1280, 1280 << 20, 1408 << 20, 1792 << 20, 1331 << 20, (1 << 20) - 1, (1 << 30) - 1, 1300 << 40, 5 << 50, *range(1 << 30, 12 << 30, 77_777_777), *range(1024, 6000)]
    found = [r["t"] for r in spark.createDataFrame([(n,) for n in sizes], "n long").select(storage_size(F.col("n")).alias("t")).collect()]

    def printed(n):
        power = max(p for p in range(6) if n >= 1024**p or p == 0)
        return f"{n / 1024**power:.1f}" + ("", "KB", "MB", "GB", "TB", "PB")[power] if power else str(n)

    assert found == [printed(n) for n in sizes]


def test_wide_series_equal_long_ones(spark):
    from diagspark.operators.wide import Wide

    rows = spark.range(9000).select((F.col("id") % 2).alias("host"), F.timestamp_seconds(F.col("id") % 4000).alias("ts"), F.col("id").alias("seq"), F.when(F.col("id") % 7 > 0, F.pmod(F.hash("id"), F.lit(50)).cast("double")).alias("x"))
    wide = Wide(rows, (("a", "", F.col("x")), ("b", "e", F.col("x") * 2), ("none", "", F.lit(None).cast("double"))))
    edges = F.timestamp_seconds(F.lit(100)), F.timestamp_seconds(F.lit(3900))
    told = lambda found: sorted(tuple(r) for r in found.select("host", "metric", "entity", "n", "p5", "median", "p95").collect())
    for most in (50, 1800):
        assert told(wide.percentiles(*edges, most)) == told(A.range_percentiles(wide.points(), *edges, max_points=most))


def test_the_mean_ratio_makes_no_pairs(spark):
    rows = [("h", m, 1 + i % 3, float(v)) for m in ("part", "whole") for i, v in enumerate((1, 2, 0, 4, 5, 6, 7))]
    points = spark.createDataFrame(rows, "host string, metric string, ts long, value double")
    pairs = A.mean_ratio(A.aligned(points, "part", "whole", ("p", "w")), "p", "w").first()["mean_ratio"]
    found = A.mean_ratio_in_time(points, "part", "whole")
    assert found.first()["mean_ratio"] == pytest.approx(pairs)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
