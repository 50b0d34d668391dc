"""Streams that run: triggers, late rows, snapshots, counters, sinks that are repeated, message logs, the gate."""

import json
import threading
import uuid
from datetime import UTC, datetime, timedelta
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.errors import AnalysisException, StreamingQueryException
from pyspark.sql import functions as F

from lakeguard.sources import log as L
from lakeguard.sources import tables as T
from lakeguard.streaming import stateful as S
from lakeguard.streaming import windows as W
from lakeguard.streaming.gate import Gate, severity_of

ZERO = datetime(2024, 1, 1, tzinfo=UTC)
SCHEMA = "ts timestamp, key string, event_id long, value double, arrived timestamp"


def at(seconds):
    return ZERO + timedelta(seconds=seconds)


def events(*rows):
    """(second, arrival, key) as rows of SCHEMA."""
    return [(at(s), k, i, float(i), at(a)) for i, (s, a, k) in enumerate(rows)]


# ------------------------------------------------------------ triggers
def test_triggers_are_conditions():
    early = S.any_of(S.after_count(3), S.at_watermark())
    assert early.met(3, 0, False) and early.met(0, 0, True) and not early.met(2, 99, False)
    both = S.all_of(S.after_count(2), S.after_seconds(5))
    assert both.met(2, 5, False) and not both.met(1, 9, False) and not both.met(9, 4, False)
    assert not S.after_seconds(1).met(0, 9, False)
    assert early.replayable and not both.replayable and not S.any_of(early, both).replayable
    for wrong in (lambda: S.after_count(0), lambda: S.after_seconds(0), S.any_of, S.all_of):
        with pytest.raises(ValueError):
            wrong()


def panes(spark, tmp_path, trigger, batches, name, clock="arrived"):
    source, out, state = (str(tmp_path / f"{x}-{name}") for x in ("in", "out", "state"))
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        with S.rocksdb(spark):
            stream = spark.readStream.schema(SCHEMA).parquet(source)
            W.fan_out(S.early_windows(stream, "100 seconds", trigger, "value", "event_id", "10 seconds", clock), [W.file_sink(out, "parquet")], state).awaitTermination()
    rows = spark.read.schema(S.PANE).parquet(out).collect()
    return sorted((r.key, int((r.window_start.replace(tzinfo=UTC) - ZERO).total_seconds()), r.pane, r.event_count, r.total, r.reason) for r in rows)


def test_early_by_count_then_final(spark, tmp_path):
    first = events((1, 1, "a"), (2, 2, "a"), (3, 3, "b"), (130, 131, "c"))
    late = [(at(5), "a", 9, 4.0, at(140)), (at(150), "a", 10, 1.0, at(150)), (at(320), "a", 11, None, at(320))]
    # the watermark is past the first window when the late row of it comes, so that one is dropped
    assert panes(spark, tmp_path, S.any_of(S.after_count(2), S.at_watermark()), [first, late], "count") == [
        ("a", 0, 1, 2, 1.0, "early"), ("a", 0, 2, 2, 1.0, "final"), ("a", 100, 1, 1, 1.0, "final"), ("b", 0, 1, 1, 2.0, "final"), ("c", 100, 1, 1, 3.0, "final"),
    ]


def test_early_by_recorded_clock(spark, tmp_path):
    rows = events((1, 1, "a"), (2, 20, "a"), (3, 30, "a"), (4, 31, "a"), (400, 400, "a"))
    assert panes(spark, tmp_path, S.after_seconds(25), [rows], "clock") == [("a", 0, 1, 3, 3.0, "early"), ("a", 0, 2, 4, 6.0, "final")]


def test_timers_fire_by_the_machines_clock(spark, tmp_path):
    """Nothing more arrives for the key: its window fires by its timer while the query runs on."""
    import os
    import time

    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    spark.createDataFrame(events((1, 1, "a"), (2, 2, "a"), (3, 3, "b")), SCHEMA).coalesce(1).write.parquet(source)
    trigger = S.all_of(S.after_count(2), S.after_seconds(1))
    with S.rocksdb(spark):
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        q = W.fan_out(S.early_windows(stream, "100 seconds", trigger, "value", "event_id", "10 seconds"), [W.file_sink(out, "parquet")], state, once=False)
    rows, began = [], time.time()
    while not rows and q.isActive and time.time() - began < 60:
        time.sleep(1)
        rows = spark.read.schema(S.PANE).parquet(out).collect() if os.path.isdir(out) else []
    q.stop()
    assert [(r.key, r.event_count, r.reason) for r in rows] == [("a", 2, "early")]


# ------------------------------------------------------------ late rows, counters
def test_late_rows_after_a_restart_and_a_repeated_batch(spark, tmp_path):
    rows = events((0, 0, "a"), (100, 1, "a"), (5, 2, "a"), (200, 3, "b"), (150, 4, "a"), (95, 5, "a"))
    source, late, state = str(tmp_path / "in"), str(tmp_path / "late"), S.LateState(str(tmp_path / "state"), keep=2)
    counters = S.Counters("late-rows")
    spark.streams.addListener(counters)
    for k in range(3):
        spark.createDataFrame(rows[2 * k : 2 * k + 2], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        q = S.late_stream(stream, state, str(tmp_path / "check"), ["arrived", "event_id"], "10 seconds", "50 seconds", "100 seconds", "value", W.file_sink(str(tmp_path / "ok"), "parquet"), W.file_sink(late, "parquet"))
        q.awaitTermination()
    spark.streams.removeListener(counters)
    assert sorted((r.event_id, r.late_seconds) for r in spark.read.parquet(late).collect()) == [(2, 85.0), (5, 95.0)]
    totals = {(r.key, int((r.window_start.replace(tzinfo=UTC) - ZERO).total_seconds())): (r.event_count, r.total) for r in state.totals(spark, 2).collect()}
    assert totals == {("a", 0): (1, 0.0), ("a", 100): (2, 5.0), ("b", 200): (1, 3.0)}
    metrics = [tuple(r)[:3] + tuple(r)[4:6] for r in state.read(spark, "metrics").orderBy("batch_id").collect()]
    assert metrics == [(2, 0, 0, 2, 0), (2, 1, 1, 2, 1), (2, 2, 1, 2, 1)]
    assert state.mark(spark, 2).replace(tzinfo=UTC) == at(200)
    # the summary of the first two batches and the part after it say the same as all parts
    parts = spark.read.schema("key string, window_start timestamp, event_count long, total double").parquet(str(tmp_path / "state" / "totals"))
    assert parts.groupBy("key", "window_start").agg(F.sum("event_count"), F.sum("total")).exceptAll(state.totals(spark, 2)).count() == 0


def test_counters_see_each_row_once(spark, tmp_path):
    spark.createDataFrame(events(*[(i, i, "a") for i in range(40)]), SCHEMA).repartition(3).write.parquet(str(tmp_path / "in"))
    counters = S.Counters()
    spark.streams.addListener(counters)
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    S.late_stream(stream, S.LateState(str(tmp_path / "state")), str(tmp_path / "check"), ["arrived"], "5 seconds", "5 seconds", "10 seconds", "value", W.file_sink(str(tmp_path / "a"), "parquet"), W.file_sink(str(tmp_path / "b"), "parquet")).awaitTermination()
    counters.wait()
    spark.streams.removeListener(counters)
    assert [o["events_in"] for o in counters.observed if o["name"] == "arrivals"] == [40]


# ------------------------------------------------------------ snapshots
def test_snapshots_rotate_and_restore(spark, tmp_path):
    source, state, copies = str(tmp_path / "in"), str(tmp_path / "state"), str(tmp_path / "copies")

    def run(check, out):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        W.fan_out(W.tumbling(stream, "10 seconds", [("SUM", "value", "total")], "5 seconds"), [W.file_sink(out, "parquet")], check).awaitTermination()

    for k in range(4):
        spark.createDataFrame(events((10 * k + 1, 0, "a"), (10 * k + 2, 0, "b")), SCHEMA).coalesce(1).write.mode("append").parquet(source)
    run(state, str(tmp_path / "out"))
    for b in range(3):
        S.snapshot(spark, state, b, copies, keep=2)
    assert S.snapshots(spark, copies) == [1, 2]
    assert S.state_at(spark, state, 0).count() == 2
    run(S.restore(spark, copies, 1, str(tmp_path / "again")), str(tmp_path / "out2"))
    first, again = (spark.read.parquet(str(tmp_path / x)).filter("batch_id > 1").drop("batch_id") for x in ("out", "out2"))
    assert first.count() and first.exceptAll(again).count() == 0 and again.exceptAll(first).count() == 0
    with pytest.raises(AnalysisException):
        S.restore(spark, copies, 1, str(tmp_path / "again"))


# ------------------------------------------------------------ sinks
def test_sinks_that_are_given_a_batch_twice(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    name = f"t{uuid.uuid4().hex}"
    url, known = f"jdbc:derby:memory:m{uuid.uuid4().hex};create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    got = []

    class Hook(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def do_POST(self):
            got.append((json.loads(self.rfile.read(int(self.headers["Content-Length"])))["k"], self.headers["X-Delivery"], self.client_address))
            self.send_response(200)
            self.send_header("Content-Length", "0")
            self.end_headers()

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Hook)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    sinks = [W.table_sink(name), W.jdbc_sink(url, "rows_of", known), W.webhook_sink(f"http://127.0.0.1:{server.server_port}/x", b"key")]
    try:
        for batch in (0, 0, 1):
            for sink in sinks:
                sink(df.coalesce(1).withColumn("v", F.col("v") + 10 * batch), batch)
        want = [("a", 1, 0), ("a", 11, 1), ("b", 2, 0), ("b", 12, 1)]
        assert sorted(map(tuple, spark.table(name).select("k", "v", "batch_id").collect())) == want
        assert sorted(map(tuple, T.read_jdbc(spark, url, "rows_of", known).collect())) == want
        # a repeated delivery has the same number, and a partition's rows share a connection
        assert len(got) == 6 and len({g[1] for g in got}) == 4 and len({g[2] for g in got}) == 3
        T.write_table(df, f"{name}_w")
        T.write_table(df, f"{name}_w", "append")
        assert spark.table(f"{name}_w").count() == 4
        T.write_table(df, f"{name}_w", "replace")
        assert T.read_external(spark, "parquet", {"path": spark.table(f"{name}_w").inputFiles()[0].rsplit("/", 1)[0]}).count() == 2
    finally:
        server.shutdown()
        for t in (name, f"{name}_w"):
            spark.sql(f"DROP TABLE IF EXISTS {t}")


def test_union_of_watermarked_streams_waits_for_the_slower(spark, tmp_path):
    fast = events(*[(i * 100, 0, "f") for i in range(10)])
    slow = events((0, 0, "s"), (150, 0, "s"))
    for name, rows in (("fast", fast), ("slow", slow)):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / name))
    streams = [spark.readStream.schema(SCHEMA).parquet(str(tmp_path / n)) for n in ("fast", "slow")]
    both = W.union_watermarked(streams, ["0 seconds", "0 seconds"])
    W.fan_out(W.tumbling(both, "100 seconds", []), [W.file_sink(str(tmp_path / "out"), "parquet")], str(tmp_path / "check")).awaitTermination()
    # the slower one has come to 150 seconds, so only the first window is closed
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.key, r.event_count, r.window_start.minute) for r in rows) == [("f", 1, 0), ("s", 1, 0)]


def test_workday_lines(spark):
    raw = spark.createDataFrame([("w1", "c9", "12.345", "EUR", "2024-02-03", "4000"), (None, None, None, "USD", "no date", "1")], "WorkdayID string, CostCenterID string, BaseAmount string, CurrencyCode string, AccountingDate string, LedgerAccount string")
    a, b = T.normalize_workday(raw, "t").collect()
    assert (str(a.amount), a.currency, a.account_code, a.date_missing, a.metadata) == ("12.35", "EUR", "4000", False, {"cost_center": "c9"})
    assert (b.amount, b.date_missing) == (None, True) and a.erc != b.erc


# ------------------------------------------------------------ message logs
def test_log_is_read_once_over_restarts(spark, tmp_path):
    path, out = str(tmp_path / "log"), str(tmp_path / "out")
    df = spark.createDataFrame([(i, f"k{i % 5}", json.dumps({"n": i, "timestamp": i}) if i % 4 else "é {") for i in range(50)], "i int, k string, v string")

    def start():
        return W.fan_out(L.log_stream(spark, path, "g", 7), [W.file_sink(out, "parquet")], str(tmp_path / "check"))

    for part in ("i < 20", "i >= 20"):
        L.append_log(df.filter(part), path, 3, F.col("k"), F.col("v"), F.lit(at(5)))
        if part == "i < 20":
            assert L.drain(start, most=10) >= 10
    L.drain(start)
    rows = spark.read.parquet(out)
    assert rows.count() == 50 and sorted(r.value for r in rows.collect()) == sorted(r.v for r in df.collect())
    assert rows.groupBy("batch_id").count().agg(F.max("count")).first()[0] <= 7 + 2  # shares of three partitions are rounded up
    for p in range(3):
        offsets = sorted(r.offset for r in rows.filter(F.col("partition") == p).collect())
        assert offsets == list(range(len(offsets)))
    assert L.read_log(spark, path).exceptAll(rows.drop("batch_id")).count() == 0
    assert L.message_keys(rows) == ["_raw", "n", "timestamp"]
    wide = L.key_columns(rows, keep=("key",))
    assert wide.columns == ["key", "_raw", "n", "timestamp"] and wide.filter("n IS NULL").count() == 13
    timed = L.event_columns(rows, "n").filter("value LIKE '{%'").collect()
    assert all(r.key == str(json.loads(r.value)["n"]) and r.ts.replace(tzinfo=UTC).timestamp() == json.loads(r.value)["n"] for r in timed)


def test_log_that_is_empty_or_has_drafts(spark, tmp_path):
    path = tmp_path / "log"
    assert L.read_log(spark, str(path)).count() == 0
    L.append_log(spark.createDataFrame([(None, None)], "k string, v string"), str(path), 2, F.col("k"), F.col("v"), F.lit(None).cast("timestamp"))
    (path / "partition=1").mkdir(exist_ok=True)
    (path / "partition=1" / "x.draft").write_text("half a mess")
    rows = L.read_log(spark, str(path)).collect()
    assert [(r.offset, r.key, r.value, r.timestamp) for r in rows] == [(0, None, None, None)]
    assert L.message_keys(L.read_log(spark, str(path))) == ["_raw"]


# ------------------------------------------------------------ the gate
def test_gate_stops_keeps_its_place_and_goes_on(spark, tmp_path):
    source, place, check = (str(tmp_path / x) for x in ("in", "gate", "check"))
    base = [float(i % 40) for i in range(400)]
    batches = [base, [v * 100 for v in base], [v * 100 for v in base], [None] * 10, base]
    scale = {"scale": lambda df: df.withColumn("v", F.col("v") / 100), "lose": lambda df: df.filter("v < 40")}
    gate = Gate(place, ["v"], scale)
    with pytest.raises(ValueError):
        gate.register(spark.createDataFrame([], "b int, v double"))
    gate.register(spark.createDataFrame([(0, v) for v in base], "b int, v double"))

    def run(g):
        stream = spark.readStream.schema("b int, v double").option("maxFilesPerTrigger", 1).parquet(source)
        g.stream(stream, check).awaitTermination()

    for b, values in enumerate(batches[:4]):
        spark.createDataFrame([(b, v) for v in values], "b int, v double").coalesce(1).write.mode("append").parquet(source)
    for _ in range(2):  # it stops at the same batch again
        with pytest.raises(StreamingQueryException, match="batch 3: drift inf"):
            run(gate)
        assert sorted(r.batch_id for r in gate.decisions(spark).collect()) == [0, 1, 2]
        assert gate.lake(spark).count() == 1200
    with pytest.raises(StreamingQueryException, match="in use but not given"):
        run(Gate(place, ["v"], {}))
    mended = Gate(place, ["v"], scale | {"fill": lambda df: df.withColumn("v", F.coalesce("v", F.lit(0.0) + F.pmod(F.monotonically_increasing_id(), F.lit(40))))}, zeta=1e9)
    run(mended)
    decisions = {r.batch_id: (r.severity, r.repair, r.baseline, list(r.in_use)) for r in mended.decisions(spark).collect()}
    assert decisions == {0: (None, None, -1, []), 1: ("critical", "scale", 1, ["scale"]), 2: (None, None, 1, ["scale"]), 3: ("critical", "fill", 3, ["scale", "fill"])}
    assert mended.lake(spark).count() == 1210
    assert sorted({r.v for r in mended.lake(spark).filter("batch_id = 1").collect()}) == [float(v) for v in range(40)]
    assert [severity_of(x, 1.0) for x in (0.5, 1.2, 1.7, 2.5, 9)] == [None, "low", "medium", "high", "critical"]


def test_many_keys_share_few_calls_of_the_state_store(spark, tmp_path, monkeypatch):
    """Keys of one bucket, in more than one piece of Arrow, are told apart and taken in their order of arrival."""
    monkeypatch.setattr(S.early_windows, "__defaults__", (None, 2))
    rows = [(at(1 + i // 50), f"k{i % 50}", i, 1.0, at(1000 - i // 50)) for i in range(300)] + [(at(900), "k0", 999, 1.0, at(2000))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        got = panes(spark, tmp_path, S.any_of(S.after_count(4), S.at_watermark()), [rows], "buckets")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted(p for i in range(50) for p in [(f"k{i}", 0, 1, 4, 4.0, "early"), (f"k{i}", 0, 2, 6, 6.0, "final")])


def test_state_holds_a_row_for_a_bucket_not_for_a_key(spark, tmp_path):
    rows = [(at(1), f"k{i}", i, 1.0, at(1)) for i in range(600)]
    panes(spark, tmp_path, S.at_watermark(), [rows], "rows")
    state = spark.read.format("statestore").option("stateVarName", "open").load(str(tmp_path / "state-rows"))
    assert 0 < state.count() <= S.BUCKETS


def test_larger_parts_have_more_files(spark, monkeypatch):
    """As many for each part, by the smallest; small tables keep two."""
    from lakeguard.plans import running

    df = spark.range(100)
    part = F.when(F.col("id") < 40, 0).otherwise(1)
    assert running._files(df, part) == 2
    monkeypatch.setattr(running, "FILE_ROWS", 5)
    assert running._files(df, part) == 8
