"""Windowed event streams.

Every function takes a batch or a streaming frame with ``ts`` (TIMESTAMP) and
``key`` (string), so one definition serves both; what needs an order of arrival
(late-data classification, count triggers) is a batch replay here, and on a running
stream the work of ``streaming.stateful``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lakeguard.functions.ranking import prefix_max


def as_stream_events(df: DataFrame, time: str, key: str, columns: Sequence[str]) -> DataFrame:
    return df.select(F.col(time).cast("timestamp").alias("ts"), F.col(key).cast("string").alias("key"), *columns)


def filter_events(df: DataFrame, field: str, op: str, value: Any) -> DataFrame:
    """==, !=, >, <, >=, <=, in; null passes only !=."""
    c = F.col(field)
    if op == "in":
        return df.filter(c.isin(list(value)))
    made = {"==": c == value, "!=": c.isNull() | (c != value), ">": c > value, "<": c < value, ">=": c >= value, "<=": c <= value}
    return df.filter(made[op])


def map_events(df: DataFrame, copy: Mapping[str, str] | None = None, drop: Sequence[str] = ()) -> DataFrame:
    return df.withColumns({new: F.col(old) for new, old in (copy or {}).items()}).drop(*drop)


def key_by(df: DataFrame, field: str) -> DataFrame:
    return df.withColumn("key", F.col(field).cast("string"))


def flat_map(df: DataFrame, values: Column, name: str, outer: bool = False) -> DataFrame:
    return df.withColumn(name, F.explode_outer(values) if outer else F.explode(values))


def _aggregates(wanted: Sequence[tuple[str, str, str]]) -> list[Column]:
    """(function, field, alias): fields that are no numbers and nulls are skipped."""
    made = {"COUNT": F.count, "SUM": F.sum, "MIN": F.min, "MAX": F.max, "AVG": F.avg}
    own = [made[f.upper()](F.col(c).try_cast("double")).alias(a) for f, c, a in wanted]
    return [F.count(F.lit(1)).alias("event_count"), F.max("ts").alias("last_event_time"), *own]


def _windowed(df: DataFrame, window: Column, wanted: Sequence[tuple[str, str, str]], watermark: str | None) -> DataFrame:
    if watermark:
        df = df.withWatermark("ts", watermark)
    out = df.groupBy(window.alias("w"), "key").agg(*_aggregates(wanted))
    return out.select("key", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in out.columns if c not in ("w", "key")])


def tumbling(df: DataFrame, size: str, wanted: Sequence[tuple[str, str, str]], watermark: str | None = None) -> DataFrame:
    return _windowed(df, F.window("ts", size), wanted, watermark)


def sliding(df: DataFrame, size: str, slide: str, wanted: Sequence[tuple[str, str, str]], watermark: str | None = None) -> DataFrame:
    return _windowed(df, F.window("ts", size, slide), wanted, watermark)


def session(df: DataFrame, gap: str, wanted: Sequence[tuple[str, str, str]], watermark: str | None = None) -> DataFrame:
    """Events of a key at most one gap apart share a window."""
    return _windowed(df, F.session_window("ts", gap), wanted, watermark)


def global_window(df: DataFrame, wanted: Sequence[tuple[str, str, str]]) -> DataFrame:
    return df.groupBy("key").agg(*_aggregates(wanted))


def closed(events: DataFrame, fired: DataFrame, delay: str) -> DataFrame:
    """The windows that a watermark of ``delay`` behind all events has passed: what a stream has emitted at its end."""
    mark = events.agg((F.max("ts") - F.expr(f"INTERVAL {delay}")).alias("_mark"))
    return fired.join(F.broadcast(mark)).filter("window_end <= _mark").drop("_mark")


def lag_report(df: DataFrame, source: str) -> DataFrame:
    """Newest event of each source, its lag behind the newest of all, and the composite watermark, the least of them."""
    newest = df.groupBy(F.col(source).alias("source")).agg(F.max("ts").alias("newest"))
    both = newest.agg(F.max("newest").alias("_top"), F.min("newest").alias("composite"))
    return newest.join(F.broadcast(both)).select("source", "newest", (F.unix_timestamp("_top") - F.unix_timestamp("newest")).alias("lag_seconds"), "composite")


def union_watermarked(streams: Sequence[DataFrame], delays: Sequence[str]) -> DataFrame:
    """Streams with a watermark each; the composite is the least (multipleWatermarkPolicy=min)."""
    out = streams[0].withWatermark("ts", delays[0])
    for s, d in zip(streams[1:], delays[1:], strict=True):
        out = out.unionByName(s.withWatermark("ts", d))
    return out


def classify_late(df: DataFrame, arrival: Sequence[Column], delay: str) -> DataFrame:
    """Adds watermark, is_late and late_seconds, judged when each event arrived."""
    marked = prefix_max(df, arrival, "ts", "_top").withColumn("watermark", F.col("_top") - F.expr(f"INTERVAL {delay}")).drop("_top")
    late = F.coalesce(F.col("ts") < F.col("watermark"), F.lit(False))
    seconds = (F.unix_micros("watermark") - F.unix_micros("ts")) / 1e6
    return marked.withColumn("is_late", late).withColumn("late_seconds", F.when(late, seconds))


def late_records(df: DataFrame) -> DataFrame:
    return df.filter("is_late").withColumn("reason", F.lit("late"))


def within_lateness(df: DataFrame, allowed: str) -> DataFrame:
    """Events that are on time or at most ``allowed`` behind the watermark."""
    return df.filter(F.col("watermark").isNull() | (F.col("ts") >= F.col("watermark") - F.expr(f"INTERVAL {allowed}")))


def count_trigger(df: DataFrame, size: str, every: int, tie: str) -> DataFrame:
    """Rows at which a key's window has had ``every`` more events."""
    w = Window.partitionBy("key", F.window("ts", size)).orderBy("ts", tie)
    return df.withColumn("event_count", F.row_number().over(w).cast("long")).filter(F.col("event_count") % every == 0)


def alert_rules(fired: DataFrame, rules: Sequence[Mapping[str, Any]]) -> DataFrame:
    """A row for each fired window and rule {label, field, op, threshold} that it meets."""
    tests = []
    for r in rules:
        c = F.col(r["field"])
        hit = {">": c > r["threshold"], "<": c < r["threshold"], ">=": c >= r["threshold"], "<=": c <= r["threshold"], "==": c == r["threshold"]}[r["op"]]
        tests.append(F.when(hit, F.lit(r["label"])))
    return fired.withColumn("label", F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())))


def with_policy(df: DataFrame, late: Column, keep: Column) -> DataFrame:
    """Adds decision: on_time, or of late rows kept or dropped, as the user's predicate says."""
    return df.withColumn("decision", F.when(~F.coalesce(late, F.lit(False)), "on_time").when(keep, "kept").otherwise("dropped"))


# ------------------------------------------------------------ sources and sinks
def file_stream(spark: SparkSession, path: str, schema: str, fmt: str = "json", time: str | None = None) -> DataFrame:
    """New files of a folder; the key is the file's stem, event time a column or the file's time."""
    df = spark.readStream.schema(schema).format(fmt).load(path)
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[^./]*)?$", 1)
    return df.withColumns({"key": stem, "ts": F.col(time).cast("timestamp") if time else F.col("_metadata.file_modification_time")})


def kafka_stream(spark: SparkSession, servers: str, topic: str, schema: str, key_field: str | None = None) -> DataFrame:
    """JSON events of a topic, by the same rules as those of a message log; needs the Kafka connector on the class path."""
    from lakeguard.sources.log import event_columns

    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    got = event_columns(raw.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "timestamp"), key_field)
    return got.select("ts", "key", F.from_json("value", schema).alias("data")).select("ts", "key", "data.*")


Sink = Callable[[DataFrame, int], None]


def file_sink(path: str, fmt: str = "json") -> Sink:
    """Each batch in a folder of its own, so a repeated batch replaces itself."""
    return lambda df, batch: df.write.mode("overwrite").format(fmt).save(f"{path}/batch_id={batch}")


def table_sink(table: str) -> Sink:
    """A table with a partition for each batch, so a repeated batch replaces its own rows."""

    def write(df: DataFrame, batch: int) -> None:
        rows, spark = df.withColumn("batch_id", F.lit(batch).cast("long")), df.sparkSession
        if spark.catalog.tableExists(table):
            before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
            spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
            try:
                rows.write.mode("overwrite").insertInto(table)
            finally:
                spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
        else:
            rows.write.partitionBy("batch_id").saveAsTable(table)

    return write


def jdbc_sink(url: str, table: str, properties: Mapping[str, str]) -> Sink:
    """A table over JDBC with a column batch_id; what a batch left there before is deleted first."""

    def write(df: DataFrame, batch: int) -> None:
        jvm = df.sparkSession._jvm
        given = jvm.java.util.Properties()
        for k, v in properties.items():
            given.setProperty(k, v)
        link = jvm.java.sql.DriverManager.getConnection(url, given)
        try:
            there = link.getMetaData().getTables(None, None, table.upper(), None).next() or link.getMetaData().getTables(None, None, table, None).next()
            if there:
                quote = link.getMetaData().getIdentifierQuoteString().strip()
                link.createStatement().executeUpdate(f"DELETE FROM {table} WHERE {quote}batch_id{quote} = {int(batch)}")
        finally:
            link.close()
        df.withColumn("batch_id", F.lit(batch).cast("long")).write.jdbc(url, table, "append", dict(properties))

    return write


def kafka_sink(servers: str, topic: str) -> Sink:
    return lambda df, _: df.select("key", F.to_json(F.struct("*")).alias("value")).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def webhook_sink(url: str, secret: bytes) -> Sink:
    """Signed POSTs from the executors, one for each row, over one connection for each partition.

    X-Delivery has the batch and a hash of the body, by which a receiver knows a repeated row.
    """

    def post(batch: int) -> Callable[[Any], None]:
        def run(rows: Any) -> None:
            import hashlib
            import hmac
            from http.client import HTTPConnection, HTTPSConnection
            from urllib.parse import urlsplit

            to = urlsplit(url)
            link = (HTTPSConnection if to.scheme == "https" else HTTPConnection)(to.netloc, timeout=10)
            for r in rows:
                body = r[0].encode()
                head = {"Content-Type": "application/json", "X-Signature": hmac.new(secret, body, hashlib.sha256).hexdigest(), "X-Delivery": f"{batch}-{hashlib.sha256(body).hexdigest()[:16]}"}
                link.request("POST", to.path or "/", body, head)
                answer = link.getresponse()
                answer.read()
                if answer.status >= 300:
                    raise ConnectionError(f"{url} answered {answer.status}")
            link.close()

        return run

    return lambda df, batch: df.select(F.to_json(F.struct("*"))).foreachPartition(post(batch))


def fan_out(df: DataFrame, sinks: Sequence[Sink], checkpoint: str, mode: str = "append", once: bool = True) -> StreamingQuery:
    """Every micro-batch to all sinks; restarted with the same checkpoint it goes on where it stopped."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        for sink in sinks:
            sink(batch, number)
        batch.unpersist()

    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(availableNow=True) if once else writer).start()
