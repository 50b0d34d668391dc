"""Queries of the event-stream operators, as batch replays of the streaming functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeguard.plans.steps import t
from lakeguard.streaming import windows as W

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def events(spark: SparkSession, sf: str) -> DataFrame:
    return W.as_stream_events(t(spark, sf, "events"), "ts", "user_id", ["event_id", "event_type", "value", "props"])


def ntz(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query("sm3_filter", "SELECT event_id, value FROM events WHERE value >= 50 AND event_type IN ('click', 'view', 'purchase')")
def stream_filter(spark: SparkSession, sf: str) -> DataFrame:
    df = W.filter_events(W.filter_events(events(spark, sf), "value", ">=", 50), "event_type", "in", ["click", "view", "purchase"])
    return df.select("event_id", "value")


@query("sm4_map", "SELECT event_id, value, value AS amount FROM events")
def stream_map(spark: SparkSession, sf: str) -> DataFrame:
    return W.map_events(events(spark, sf), copy={"amount": "value"}, drop=["props", "event_type", "ts", "key"]).select("event_id", "value", "amount")


@query("sm5_key_by", "SELECT event_type AS key, count(*) AS n FROM events GROUP BY 1")
def stream_key(spark: SparkSession, sf: str) -> DataFrame:
    return W.key_by(events(spark, sf), "event_type").groupBy("key").agg(F.count("*").alias("n"))


@query("sm6_flat_map", "SELECT event_id, unnest(string_split(event_type, 'e')) AS part FROM events")
def stream_flat(spark: SparkSession, sf: str) -> DataFrame:
    return W.flat_map(events(spark, sf), F.split("event_type", "e"), "part").select("event_id", "part")


@query("sm7_tumbling", "SELECT CAST(user_id AS VARCHAR) AS key, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS event_count, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling(spark: SparkSession, sf: str) -> DataFrame:
    df = W.tumbling(events(spark, sf), "1 hour", [("SUM", "value", "total")])
    return ntz(df, "window_start").select("key", "window_start", "event_count", F.round("total", 4).alias("total"))


@query(
    "sm8_sliding",
    "SELECT event_type AS key, w AS window_start, count(*) AS event_count, round(avg(value), 6) AS mean FROM (SELECT *, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w FROM events) GROUP BY ALL",
)
def sliding(spark: SparkSession, sf: str) -> DataFrame:
    df = W.sliding(W.key_by(events(spark, sf), "event_type"), "1 hour", "30 minutes", [("AVG", "value", "mean")])
    return ntz(df, "window_start").select("key", "window_start", "event_count", F.round("mean", 6).alias("mean"))


@query(
    "sm9_session",
    """SELECT CAST(user_id AS VARCHAR) AS key, min(ts) AS window_start, count(*) AS event_count, round(max(value), 4) AS top FROM
    (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""",
)
def session(spark: SparkSession, sf: str) -> DataFrame:
    df = W.session(events(spark, sf), "30 minutes", [("MAX", "value", "top")])
    return ntz(df, "window_start").select("key", "window_start", "event_count", F.round("top", 4).alias("top"))


@query("sm10_global", "SELECT CAST(user_id AS VARCHAR) AS key, count(*) AS event_count, round(sum(value), 4) AS total FROM events GROUP BY 1")
def whole(spark: SparkSession, sf: str) -> DataFrame:
    df = W.global_window(events(spark, sf), [("SUM", "value", "total")])
    return df.select("key", "event_count", F.round("total", 4).alias("total"))


@query("sm11_window_aggs", "SELECT event_type AS key, time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS event_count, count(value) AS n, round(sum(value), 3) AS s, min(value) AS lo, max(value) AS hi, round(avg(value), 6) AS mean, max(ts) AS last_event_time FROM events GROUP BY ALL")
def window_aggs(spark: SparkSession, sf: str) -> DataFrame:
    df = W.tumbling(W.key_by(events(spark, sf), "event_type"), "1 day", [("COUNT", "value", "n"), ("SUM", "value", "s"), ("MIN", "value", "lo"), ("MAX", "value", "hi"), ("AVG", "value", "mean")])
    return ntz(df, "window_start", "last_event_time").select("key", "window_start", "event_count", "n", F.round("s", 3).alias("s"), "lo", "hi", F.round("mean", 6).alias("mean"), "last_event_time")


@query("sm12_watermark", "SELECT key, window_start, event_count FROM (SELECT event_type AS key, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS event_count FROM events GROUP BY 1, 2) WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)")
def watermark(spark: SparkSession, sf: str) -> DataFrame:
    df = W.closed(events(spark, sf), W.tumbling(W.key_by(events(spark, sf), "event_type"), "1 hour", []), "10 minutes")
    return ntz(df, "window_start").select("key", "window_start", "event_count")


LAG = "SELECT event_type AS source, max(ts) AS newest, CAST(date_diff('second', max(ts), (SELECT max(ts) FROM events)) AS BIGINT) AS lag_seconds, (SELECT min(m) FROM (SELECT max(ts) AS m FROM events GROUP BY event_type)) AS composite FROM events GROUP BY 1"


@query("sm13_multi_watermark", LAG)
def multi_watermark(spark: SparkSession, sf: str) -> DataFrame:
    return ntz(W.lag_report(events(spark, sf), "event_type"), "newest", "composite")


LATE = """(SELECT *, max(ts) OVER (ORDER BY arrived, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 5 MINUTE AS mark FROM
 (SELECT *, ts + to_seconds(CASE WHEN event_id % 10 = 0 THEN 7200 ELSE 0 END) AS arrived FROM events))"""


def late(spark: SparkSession, sf: str) -> DataFrame:
    arrived = F.col("ts") + F.when(F.col("event_id") % 10 == 0, F.expr("INTERVAL 7200 SECONDS")).otherwise(F.expr("INTERVAL 0 SECONDS"))
    return W.classify_late(events(spark, sf).withColumn("arrived", arrived), [F.col("arrived"), F.col("event_id")], "5 minutes")


@query("sm14_late_classify", f"SELECT event_id, coalesce(ts < mark, false) AS is_late, CASE WHEN ts < mark THEN date_diff('microsecond', ts, mark) END AS late_micros FROM {LATE}")
def late_classify(spark: SparkSession, sf: str) -> DataFrame:
    return late(spark, sf).select("event_id", "is_late", F.round(F.col("late_seconds") * 1e6).cast("long").alias("late_micros"))


@query("sm15_late_drop", f"SELECT CAST(user_id AS VARCHAR) AS key, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS event_count FROM {LATE} WHERE NOT coalesce(ts < mark, false) GROUP BY 1, 2")
def late_drop(spark: SparkSession, sf: str) -> DataFrame:
    return ntz(W.tumbling(late(spark, sf).filter("NOT is_late"), "1 hour", []), "window_start").select("key", "window_start", "event_count")


@query("sm16_late_side_output", f"SELECT event_id, 'late' AS reason FROM {LATE} WHERE ts < mark")
def late_side(spark: SparkSession, sf: str) -> DataFrame:
    return W.late_records(late(spark, sf)).select("event_id", "reason")


@query("sm17_late_update", f"SELECT CAST(user_id AS VARCHAR) AS key, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS event_count FROM {LATE} WHERE coalesce(epoch(mark) - epoch(ts) <= 3600, true) GROUP BY 1, 2")
def late_update(spark: SparkSession, sf: str) -> DataFrame:
    df = W.within_lateness(late(spark, sf), "1 hour")
    return ntz(W.tumbling(df, "1 hour", []), "window_start").select("key", "window_start", "event_count")


@query("sm18_triggers", "SELECT event_id, CAST(user_id AS VARCHAR) AS key, n AS event_count FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, time_bucket(INTERVAL 1 DAY, ts) ORDER BY ts, event_id) AS n FROM events) WHERE n % 3 = 0")
def triggers(spark: SparkSession, sf: str) -> DataFrame:
    return W.count_trigger(events(spark, sf), "1 day", 3, "event_id").select("event_id", "key", "event_count")


@query("sm21_alert_rules", "SELECT key, window_start, label FROM (SELECT event_type AS key, time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS event_count, avg(value) AS mean FROM events GROUP BY ALL), (VALUES ('busy', 'event_count', 60), ('rich', 'mean', 52)) r(label, field, threshold) WHERE CASE field WHEN 'event_count' THEN event_count ELSE mean END > threshold")
def alerts(spark: SparkSession, sf: str) -> DataFrame:
    fired = W.tumbling(W.key_by(events(spark, sf), "event_type"), "1 day", [("AVG", "value", "mean")])
    df = W.alert_rules(fired, [{"label": "busy", "field": "event_count", "op": ">", "threshold": 60}, {"label": "rich", "field": "mean", "op": ">", "threshold": 52}])
    return ntz(df, "window_start").select("key", "window_start", "label")


@query("sm22_stream_metrics", f"SELECT count(*) AS events_in, count(*) FILTER (ts < mark) AS events_late, CAST(max(ts) - INTERVAL 5 MINUTE AS TIMESTAMP) AS watermark FROM {LATE}")
def metrics(spark: SparkSession, sf: str) -> DataFrame:
    df = late(spark, sf).agg(F.count("*").alias("events_in"), F.count_if("is_late").alias("events_late"), (F.max("ts") - F.expr("INTERVAL 5 MINUTES")).alias("watermark"))
    return ntz(df, "watermark")
