"""Queries whose streams run: early windows, late rows, snapshots, counters, message logs, gated ingest.

Each writes the given events in parts, as producers would have left them, and
runs, stops and starts its streams over these.
"""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeguard.functions.storage import shared_path
from lakeguard.plans.drift import registrar
from lakeguard.plans.steps import t
from lakeguard.plans.streams import ntz
from lakeguard.sources import log as L
from lakeguard.streaming import stateful as S
from lakeguard.streaming import windows as W
from lakeguard.streaming.gate import Gate

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = registrar(QUERIES, SQL)

#: Files of a part, at least, and rows of a file from which there are more; a micro-batch takes one part.
FILES, FILE_ROWS = 2, 100_000


def _files(df: DataFrame, part: Column) -> int:
    """Files of each part: as many for all, as a micro-batch takes so many, and by the smallest part, so that none is empty."""
    least = df.groupBy(part.alias("part")).count().agg(F.min("count")).first()[0] or 0
    return max(FILES, least // FILE_ROWS)


def _write_parts(df: DataFrame, part: Column, parts: range, path: str, files: int = FILES) -> str:
    for k in parts:
        df.filter(part == k).repartition(files).write.mode("append").parquet(path)
    return path


def _stream(spark: SparkSession, path: str, schema: str, files: int = FILES) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


# ------------------------------------------------------------ events in three parts, a tenth of them two hours late
EVENTS = "ts timestamp, key string, event_id long, event_type string, value double, arrived timestamp"
ARRIVED = "ts + to_seconds(CASE WHEN event_id % 10 = 0 THEN 7200 ELSE 0 END)"
PART = f"CASE WHEN {ARRIVED} < TIMESTAMP '2024-01-11' THEN 0 WHEN {ARRIVED} < TIMESTAMP '2024-01-21' THEN 1 ELSE 2 END"


def _arrivals(spark: SparkSession, sf: str) -> tuple[DataFrame, Column]:
    at = F.col("ts").cast("timestamp") + F.when(F.col("event_id") % 10 == 0, F.expr("INTERVAL 7200 SECONDS")).otherwise(F.expr("INTERVAL 0 SECONDS"))
    df = t(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("key"), "event_id", "event_type", "value", at.alias("arrived"))
    return df, F.when(F.col("arrived") < F.lit("2024-01-11").cast("timestamp"), 0).when(F.col("arrived") < F.lit("2024-01-21").cast("timestamp"), 1).otherwise(2)


def _panes_sql(label: str, fires: str, final: str) -> str:
    """Early panes by walking over a window's events in their order of arrival, and the last one at the watermark."""
    return f"""SELECT '{label}' AS trigger, * FROM (WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS key, time_bucket(INTERVAL 1 DAY, ts) AS w, epoch_us({ARRIVED}) AS us, value, row_number() OVER (PARTITION BY user_id, time_bucket(INTERVAL 1 DAY, ts) ORDER BY {ARRIVED}, event_id) AS n FROM events),
 walk AS (SELECT *, {fires} AS fired FROM (SELECT key, w, n, us, 1 AS since, us AS f0, 0.0::DOUBLE AS seconds, value AS total, 0 AS pane FROM e WHERE n = 1)
  UNION ALL SELECT *, {fires} AS fired FROM (SELECT key, w, n, us, since, f0, (us - f0) / 1e6 AS seconds, total, pane FROM
   (SELECT e.key, e.w, e.n, e.us, CASE WHEN walk.fired THEN 1 ELSE walk.since + 1 END AS since, CASE WHEN walk.fired THEN e.us ELSE walk.f0 END AS f0, walk.total + e.value AS total, walk.pane + walk.fired::INT AS pane FROM walk JOIN e ON e.key = walk.key AND e.w = walk.w AND e.n = walk.n + 1))),
 final AS (SELECT *, CASE WHEN fired THEN 0 ELSE since END AS unseen FROM (SELECT * FROM walk QUALIFY n = max(n) OVER (PARTITION BY key, w)) WHERE w + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 3 HOUR FROM events))
 SELECT key, w AS window_start, pane + 1 AS pane, n AS event_count, round(total, 4) AS total, 'early' AS reason FROM walk WHERE fired
 UNION ALL SELECT key, w, pane + fired::INT + 1, n, round(total, 4), 'final' FROM final WHERE {final})"""


TRIGGERS = {
    "count or watermark": (S.any_of(S.after_count(3), S.at_watermark()), "since >= 3", "true"),
    "clock or watermark": (S.any_of(S.after_seconds(7200), S.at_watermark()), "seconds >= 7200", "true"),
    "count and clock": (S.all_of(S.after_count(2), S.after_seconds(3600)), "since >= 2 AND seconds >= 3600", "unseen >= 2"),
}


@query("sm18_early_windows", " UNION ALL ".join(_panes_sql(label, fires, final) for label, (_, fires, final) in TRIGGERS.items()))
def early(spark: SparkSession, sf: str) -> DataFrame:
    """Daily windows of a user that fire early by count, by clock and by both, on streams that stop after the first part."""
    df, part = _arrivals(spark, sf)
    runs = {label: (shared_path(spark, "panes"), shared_path(spark, "panes-state")) for label in TRIGGERS}
    path, files = shared_path(spark, "arrivals"), _files(df, part)
    with S.rocksdb(spark):
        for parts in (range(1), range(1, 3)):
            _write_parts(df, part, parts, path, files)
            started = []
            for label, (trigger, _, _) in TRIGGERS.items():
                panes = S.early_windows(_stream(spark, path, EVENTS, files), "1 day", trigger, "value", "event_id", "3 hours", "arrived")
                started.append(W.fan_out(panes, [W.file_sink(runs[label][0], "parquet")], runs[label][1]))
            for q in started:
                q.awaitTermination()
    out = [spark.read.schema(S.PANE).parquet(path).select(F.lit(label).alias("trigger"), "key", "window_start", "pane", "event_count", F.round("total", 4).alias("total"), "reason") for label, (path, _) in runs.items()]
    return ntz(out[0].unionByName(out[1]).unionByName(out[2]), "window_start")


# ------------------------------------------------------------ late rows
MARKED = f"""(SELECT *, max(ts) OVER (ORDER BY arrived, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 5 MINUTE AS mark FROM (SELECT *, {ARRIVED} AS arrived, {PART} AS part FROM events))"""


def _late(spark: SparkSession, sf: str, allowed: str) -> tuple[S.LateState, str]:
    """A stream of the events that runs over the first part, stops, and goes on with the others; its state and its late rows."""
    df, part = _arrivals(spark, sf)
    path, checkpoint, late, on_time = (shared_path(spark, f"late-{x}") for x in ("in", "offsets", "rows", "on-time"))
    state, files = S.LateState(shared_path(spark, "late-state"), keep=2), _files(df, part)
    for parts in (range(1), range(1, 3)):
        _write_parts(df, part, parts, path, files)
        S.late_stream(_stream(spark, path, EVENTS, files), state, checkpoint, ["arrived", "event_id"], "5 minutes", allowed, "1 hour", "value", W.file_sink(on_time, "parquet"), W.file_sink(late, "parquet")).awaitTermination()
    return state, late


@query("sm16_late_stream", f"SELECT event_id, 'late_beyond_allowed_lateness' AS reason, date_diff('microsecond', ts, mark) AS late_micros FROM {MARKED} WHERE ts < mark")
def late_rows(spark: SparkSession, sf: str) -> DataFrame:
    _, late = _late(spark, sf, "0 seconds")
    return spark.read.parquet(late).select("event_id", "reason", F.round(F.col("late_seconds") * 1e6).cast("long").alias("late_micros"))


@query(
    "sm17_late_merge",
    f"""WITH a AS (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS w FROM {MARKED} WHERE coalesce(ts >= mark - INTERVAL 1 HOUR, true)), m AS (SELECT p.part, max(q.ts) - INTERVAL 5 MINUTE AS mark FROM (VALUES (0), (1), (2)) p(part) JOIN {MARKED} q ON q.part <= p.part GROUP BY 1)
 SELECT CAST(user_id AS VARCHAR) AS key, w AS window_start, count(*) AS event_count, round(sum(value), 4) AS total, coalesce(bool_or(w + INTERVAL 1 HOUR <= m.mark), false) AS changed_when_closed FROM a LEFT JOIN m ON m.part = a.part - 1 GROUP BY 1, 2""",
)
def late_merged(spark: SparkSession, sf: str) -> DataFrame:
    """The windows' totals that the stream has merged, and whether one that had been put out was changed."""
    state, _ = _late(spark, sf, "1 hour")
    totals = state.totals(spark, 2)
    changed = state.read(spark, "panes").filter("reason = 'update'").select("key", "window_start").distinct().withColumn("changed_when_closed", F.lit(True))
    out = totals.join(changed, ["key", "window_start"], "left").select("key", "window_start", "event_count", F.round("total", 4).alias("total"), F.coalesce("changed_when_closed", F.lit(False)).alias("changed_when_closed"))
    return ntz(out, "window_start")


@query(
    "sm22_running_metrics",
    f"""WITH r AS (SELECT * FROM {MARKED}), w AS (SELECT DISTINCT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS w, part FROM r WHERE coalesce(ts >= mark - INTERVAL 1 HOUR, true)),
 b AS (SELECT p.part AS batch, count(*) FILTER (r.part = p.part) AS events_in, count(*) FILTER (r.part = p.part AND ts < mark) AS events_late, count(*) FILTER (r.part = p.part AND ts < mark - INTERVAL 1 HOUR) AS events_dropped, max(ts) - INTERVAL 5 MINUTE AS watermark FROM (VALUES (0), (1), (2)) p(part) JOIN r ON r.part <= p.part GROUP BY 1)
 SELECT batch, events_in, events_late, events_dropped, watermark, (SELECT count(*) FROM (SELECT DISTINCT user_id, w FROM w WHERE part <= batch AND w + INTERVAL 1 HOUR > watermark)) AS active_windows, (SELECT count(*) FROM (SELECT DISTINCT user_id, w FROM w WHERE part <= batch AND w + INTERVAL 1 HOUR <= watermark)) AS closed_windows FROM b""",
)
def running_metrics(spark: SparkSession, sf: str) -> DataFrame:
    state, _ = _late(spark, sf, "1 hour")
    return ntz(state.read(spark, "metrics"), "watermark").select(F.col("batch_id").cast("int").alias("batch"), "events_in", "events_late", "events_dropped", "watermark", "active_windows", "closed_windows")


# ------------------------------------------------------------ snapshots
_OPEN = f"SELECT 'state after ' || b.part AS what, event_type AS key, time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS event_count FROM (VALUES (0), (1)) b(part) JOIN (SELECT *, {PART} AS part FROM events) e ON e.part <= b.part WHERE coalesce(time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY > (SELECT max(ts) - INTERVAL 3 HOUR FROM events WHERE {PART} < b.part), true) GROUP BY ALL"


@query(
    "sm19_snapshot_restore",
    f"{_OPEN} UNION ALL SELECT 'restored', event_type, time_bucket(INTERVAL 1 DAY, ts), count(*) FROM events WHERE time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 3 HOUR FROM events) GROUP BY ALL",
)
def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """A query's state after its first two batches; and what it puts out when it goes on from a copy of its first."""
    df, part = _arrivals(spark, sf)
    path, checkpoint, out, again, copies, restored = (shared_path(spark, f"windows-{x}") for x in ("in", "state", "out", "again", "copies", "restored"))
    _write_parts(df, part, range(3), path)

    def run(place: str, to: str) -> None:
        windows = W.tumbling(W.key_by(_stream(spark, path, EVENTS), "event_type"), "1 day", [("SUM", "value", "total")], "3 hours")
        W.fan_out(windows, [W.file_sink(to, "parquet")], place).awaitTermination()

    run(checkpoint, out)
    states = [S.state_at(spark, checkpoint, b).select(F.lit(f"state after {b}").alias("what"), F.col("key.key").alias("key"), F.col("key.window.start").alias("window_start"), F.col("value.count").alias("event_count")) for b in (0, 1)]
    for b in (1, 0):
        S.snapshot(spark, checkpoint, b, copies, keep=2)
    run(S.restore(spark, copies, 0, restored), again)
    # the first batch's own output and that of the batches done anew
    parts = [spark.read.parquet(out).filter("batch_id = 0"), spark.read.parquet(again)]
    put_out = [p.select(F.lit("restored").alias("what"), "key", "window_start", "event_count") for p in parts]
    return ntz(states[0].unionByName(states[1]).unionByName(put_out[0]).unionByName(put_out[1]), "window_start")


# ------------------------------------------------------------ message logs
_MESSAGE = "CASE WHEN event_id % 11 = 0 THEN 'no json {' WHEN event_id % 13 = 0 THEN CAST(event_id AS VARCHAR) WHEN event_id % 3 = 0 THEN '{\"id\":' || event_id || ',\"kind\":\"' || event_type || '\"}' ELSE '{\"id\":' || event_id || ',\"amount\":' || event_id % 97 || ',\"timestamp\":' || (1700000000 + event_id) || '}' END"


def _message() -> Column:
    i = F.col("event_id")
    kind = F.concat(F.lit('{"id":'), i, F.lit(',"kind":"'), "event_type", F.lit('"}'))
    amount = F.concat(F.lit('{"id":'), i, F.lit(',"amount":'), i % 97, F.lit(',"timestamp":'), i + 1700000000, F.lit("}"))
    return F.when(i % 11 == 0, "no json {").when(i % 13 == 0, i.cast("string")).when(i % 3 == 0, kind).otherwise(amount)


def _logged(spark: SparkSession, sf: str) -> str:
    """The events as messages of a log, appended in two writes."""
    path = shared_path(spark, "message-log")
    for rest in (0, 1):
        L.append_log(t(spark, sf, "events").filter(F.col("event_id") % 2 == rest), path, 3, F.col("user_id"), _message(), F.col("ts"))
    return path


@query("sm2_log_stream", f"SELECT CAST(user_id AS VARCHAR) AS message_key, CASE WHEN event_id % 11 <> 0 AND event_id % 13 <> 0 AND event_id % 3 = 0 THEN event_type ELSE CAST(user_id AS VARCHAR) END AS key, CASE WHEN event_id % 11 <> 0 AND event_id % 13 <> 0 AND event_id % 3 <> 0 THEN CAST(make_timestamp((1700000000 + event_id) * 1000000) AS TIMESTAMP) ELSE ts END AS ts, {_MESSAGE} AS value FROM events")
def log_messages(spark: SparkSession, sf: str) -> DataFrame:
    """The messages of a log by a stream that takes a bounded number at a time and is started for every batch."""
    path, out, checkpoint = _logged(spark, sf), shared_path(spark, "messages"), shared_path(spark, "messages-offsets")
    most = t(spark, sf, "events").count() // 3 + 1

    def start():
        read = L.log_stream(spark, path, "readers", most).withColumn("message_key", F.col("key"))
        return W.fan_out(L.event_columns(read, "kind"), [W.file_sink(out, "parquet")], checkpoint)

    L.drain(start)
    return ntz(spark.read.parquet(out), "ts").select("message_key", "key", "ts", "value")


@query(
    "io5_log_columns",
    f"SELECT CAST(user_id AS VARCHAR) AS key, json_extract_string(j, '$.amount') AS amount, json_extract_string(j, '$.id') AS id, json_extract_string(j, '$.kind') AS kind, json_extract_string(j, '$.timestamp') AS timestamp, CASE WHEN event_id % 11 = 0 THEN m END AS _raw, CASE WHEN event_id % 11 <> 0 AND event_id % 13 = 0 THEN m END AS _value FROM (SELECT *, {_MESSAGE} AS m, CASE WHEN event_id % 11 <> 0 AND event_id % 13 <> 0 THEN {_MESSAGE} END AS j FROM events)",
)
def log_columns(spark: SparkSession, sf: str) -> DataFrame:
    """All messages of a log, with a column for every key that they have."""
    return L.key_columns(L.read_log(spark, _logged(spark, sf)), "value", ("key",))


# ------------------------------------------------------------ gated ingest


@query(
    "dr21_gated_ingest",
    "SELECT CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS n, round(sum(l_quantity), 2) AS quantity, CASE WHEN year(l_shipdate) = 1997 THEN 'scale' WHEN year(l_shipdate) = 1999 THEN 'shift' END AS repair, 1 AS stops FROM lineitem WHERE year(l_shipdate) BETWEEN 1996 AND 1999 GROUP BY ALL",
)
def gated_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Years of line items as batches: in tens from 1997 on, moved as well from 1999 on.

    The scale is mended and its repair used from then on; the move has no repair
    at first, so the query stops and goes on with the same batch when it has one.
    """
    items = t(spark, sf, "lineitem").select(F.year("l_shipdate").alias("year"), F.col("l_quantity").cast("double").alias("quantity")).filter("year BETWEEN 1995 AND 1999")
    sent = items.withColumn("quantity", F.when(F.col("year") < 1997, F.col("quantity")).when(F.col("year") < 1999, F.col("quantity") * 10).otherwise((F.col("quantity") + 5000) * 10))
    path = _write_parts(sent, F.col("year"), range(1996, 2000), shared_path(spark, "gated-in"))
    place, checkpoint = shared_path(spark, "gated"), shared_path(spark, "gated-offsets")
    repairs = {"scale": lambda df: df.withColumn("quantity", F.col("quantity") / 10), "broken": lambda df: df.withColumn("quantity", F.col("no_such_column")), "drop": lambda df: df.filter("quantity < 50")}
    gate = Gate(place, ["quantity"], repairs)
    gate.register(items.filter("year = 1995"))
    stops = 0
    try:
        gate.stream(_stream(spark, path, "year int, quantity double"), checkpoint).awaitTermination()
    except StreamingQueryException:
        stops = 1
    mended = Gate(place, ["quantity"], repairs | {"shift": lambda df: df.withColumn("quantity", F.col("quantity") - 5000)})
    mended.stream(_stream(spark, path, "year int, quantity double"), checkpoint).awaitTermination()
    rows = mended.lake(spark).groupBy("batch_id", "year").agg(F.count("*").alias("n"), F.round(F.sum("quantity"), 2).alias("quantity"))
    return rows.join(mended.decisions(spark).select("batch_id", "repair"), "batch_id").select("year", "n", "quantity", "repair", F.lit(stops).alias("stops"))
