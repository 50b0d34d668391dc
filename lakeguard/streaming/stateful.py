"""What a running stream has to remember: windows that fire early, its watermark, totals that late rows change.

``early_windows`` keeps windows in Spark's state store and fires them by count,
by clock, by watermark, or by any or all of these.  ``late_stream`` judges every
row by the newest one that arrived before it, as a replay of all rows would:
the newest time of each batch is left in the shared folder under the batch's
number, so a stream that stops goes on with it.  Everything a batch writes is
named by its number and replaced if the batch is repeated.
"""

from __future__ import annotations

import threading
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener
from pyspark.sql.types import StructType

from lakeguard.functions.ranking import prefix_max
from lakeguard.streaming.windows import Sink


# ------------------------------------------------------------ triggers
@dataclass(frozen=True)
class Trigger:
    """When a window fires; ``any`` and ``all`` combine others."""

    kind: str
    amount: float = 0
    parts: tuple[Trigger, ...] = ()

    def met(self, events: int, seconds: float, passed: bool) -> bool:
        """events and seconds since the window's last firing, or since its first event; passed: the watermark is behind its end."""
        if self.kind == "count":
            return events >= self.amount
        if self.kind == "clock":
            return events > 0 and seconds >= self.amount
        if self.kind == "watermark":
            return passed
        return (any if self.kind == "any" else all)(p.met(events, seconds, passed) for p in self.parts)

    def seconds(self) -> list[float]:
        """The delays after which a clock has to look at the window."""
        return [self.amount] if self.kind == "clock" else [s for p in self.parts for s in p.seconds()]

    @property
    def replayable(self) -> bool:
        """Whether the same events fire it alike without a recorded clock."""
        return not self.seconds()


def after_count(events: int) -> Trigger:
    if events < 1:
        raise ValueError("a count trigger waits for one event at least")
    return Trigger("count", events)


def after_seconds(seconds: float) -> Trigger:
    """Seconds since the first event after the last firing."""
    if seconds <= 0:
        raise ValueError("a clock trigger waits for some time")
    return Trigger("clock", seconds)


def at_watermark() -> Trigger:
    return Trigger("watermark")


def any_of(*parts: Trigger) -> Trigger:
    return _combined("any", parts)


def all_of(*parts: Trigger) -> Trigger:
    return _combined("all", parts)


def _combined(kind: str, parts: tuple[Trigger, ...]) -> Trigger:
    if not parts:
        raise ValueError(f"{kind} of no triggers")
    return Trigger(kind, parts=parts)


#: Buckets of keys: each has one value in the state store, so a key costs no call of its own.
BUCKETS = 256

PANE = "key string, window_start timestamp, pane int, event_count long, total double, reason string"


class _Windows(StatefulProcessor):
    """The open windows of a bucket of keys: events and total so far, events and clock since the last firing, panes put out."""

    def __init__(self, size: int, trigger: Trigger, recorded: bool):
        self.size, self.trigger, self.recorded = size, trigger, recorded

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # one value and one timer a bucket, as each call is a way to the state store and back; a column for each part of the windows
        self.open = handle.getValueState("open", "keys array<string>, starts array<long>, events array<long>, totals array<double>, since array<long>, first array<long>, panes array<long>, timer long")

    def _held(self) -> tuple[dict[tuple, list], int]:
        state = self.open.get() if self.open.exists() else None
        return ({(key, start): list(w) for key, start, *w in zip(*state[:-1], strict=True)}, state[-1]) if state else ({}, -1)

    def _keep(self, held: dict[tuple, list], timer: int) -> None:
        """Leaves the windows in the store and sets the timer for the next that has something to do."""
        if self.recorded:
            due = [(start + self.size) // 1000 for _, start in held]
        else:
            due = [w[3] // 1000 + int(s * 1000) for w in held.values() if w[2] for s in self.trigger.seconds()]
        soon = min(due, default=-1)
        if soon != timer:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            if soon >= 0:
                self.handle.registerTimer(soon)
        if held:
            columns = zip(*((*at, *w) for at, w in held.items()), strict=True)
            self.open.update((*map(list, columns), soon))
        else:
            self.open.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[Any], timerValues: Any) -> Iterator[Any]:
        import pandas as pd

        now, mark = timerValues.getCurrentProcessingTimeInMs() * 1000, timerValues.getCurrentWatermarkInMs() * 1000
        held, timer = self._held()
        fired = []
        # a bucket's rows of one micro-batch, which the source bounds; they come in several pieces
        part = pd.concat(list(rows), ignore_index=True).sort_values(["clock", "tie"], kind="stable")
        for who, ts, value, clock in zip(part["key"].tolist(), part["micros"].tolist(), part["value"].tolist(), part["clock"].tolist(), strict=True):
            start = ts - ts % self.size
            if start + self.size <= mark:
                continue
            at = clock if self.recorded else now
            w = held.setdefault((who, start), [0, 0.0, 0, at, 0])
            if not w[2]:
                w[3] = at
            w[0], w[1], w[2] = w[0] + 1, w[1] + (value if value == value else 0.0), w[2] + 1
            if self.trigger.met(w[2], (at - w[3]) / 1e6, False):
                fired.append(self._fire(who, start, w, "early"))
        self._keep(held, timer)
        yield self._panes(fired)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Any]:
        at, fired = expiredTimerInfo.getExpiryTimeInMs() * 1000, []
        held, _ = self._held()
        if self.recorded:
            at = max(at, timerValues.getCurrentWatermarkInMs() * 1000)
            for who, start in [k for k in held if k[1] + self.size <= at]:
                w = held.pop((who, start))
                # the last word of a window: its clock has run out if there is anything to wait for
                if self.trigger.met(w[2], float("inf") if w[2] else 0.0, True):
                    fired.append(self._fire(who, start, w, "final"))
        else:
            # by the time it is now: a window whose clock has run out but which waits for something else must not hold up the others
            at = max(at, timerValues.getCurrentProcessingTimeInMs() * 1000)
            fired = [self._fire(who, start, w, "early") for (who, start), w in held.items() if self.trigger.met(w[2], (at - w[3]) / 1e6, False)]
        self._keep(held, -1)
        yield self._panes(fired)

    def _fire(self, who: str, start: int, w: list, reason: str) -> tuple:
        w[2], w[4] = 0, w[4] + 1
        return who, start, w[4], w[0], w[1], reason

    def _panes(self, fired: list[tuple]) -> Any:
        import pandas as pd

        out = pd.DataFrame(fired, columns=["key", "window_start", "pane", "event_count", "total", "reason"]).astype({"pane": "int32", "event_count": "int64", "total": "float64"})
        out["window_start"] = pd.to_datetime(out["window_start"].astype("int64"), unit="us")
        return out


def early_windows(df: DataFrame, size: str, trigger: Trigger, value: str, tie: str, delay: str, clock: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Panes (PANE) of a stream's tumbling windows by key, put out whenever ``trigger`` fires; totals go on over the firings.

    With ``clock``, a column with the time at which an event arrived, the stream
    can be replayed: rows of a key are taken in its order (then ``tie``), and
    windows close when the watermark, ``delay`` behind the newest event, has
    passed them.  Without it the machine's clock counts and a timer wakes the next
    window that waits; such a query has to run on (``fan_out`` with once=False), as
    Spark always has another batch for it, and windows stay open.
    Rows of closed windows are dropped.  Needs the RocksDB state store.

    Keys share ``buckets`` of the state store: a task holds the open windows and the
    micro-batch's rows of one bucket.  A checkpoint stays with its number of buckets.
    """
    seconds = F.unix_micros(F.lit(0).cast("timestamp") + F.expr(f"INTERVAL {size}"))
    micros = df.sparkSession.range(1).select(seconds).first()[0]
    ready = df.withWatermark("ts", delay) if clock else df
    ready = ready.select(F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int").alias("bucket"), "key", *(["ts"] if clock else []), F.unix_micros("ts").alias("micros"), F.col(value).try_cast("double").alias("value"), F.unix_micros(F.col(clock).cast("timestamp")).alias("clock") if clock else F.lit(0).cast("long").alias("clock"), F.col(tie).alias("tie"))
    return ready.groupBy("bucket").transformWithStateInPandas(_Windows(micros, trigger, clock is not None), PANE, "Append", "eventTime" if clock else "processingTime")


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, as stateful processors have to."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


# ------------------------------------------------------------ late rows and what they change
@dataclass(frozen=True)
class LateState:
    """The folder of a stream of late rows: a subfolder for each kind of what its batches leave."""

    path: str
    keep: int = 10  # batches between two summaries of the totals

    def of(self, kind: str, batch: int) -> str:
        return f"{self.path}/{kind}/batch_id={batch}"

    def read(self, spark: SparkSession, kind: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{kind}")

    def mark(self, spark: SparkSession, batch: int) -> Any:
        """The newest time that the batches up to this one have seen."""
        return spark.read.schema("newest timestamp").parquet(self.of("marks", batch)).first()[0] if batch >= 0 else None

    def totals(self, spark: SparkSession, batch: int) -> DataFrame:
        """(key, window_start, event_count, total) of all batches up to this one: the last summary and the parts after it."""
        base = (batch // self.keep) * self.keep - 1
        paths = [self.of("totals", b) for b in range(base + 1, batch + 1)] + ([self.of("summaries", base)] if base >= 0 else [])
        parts = spark.read.schema("key string, window_start timestamp, event_count long, total double").parquet(*paths)
        return parts.groupBy("key", "window_start").agg(F.sum("event_count").alias("event_count"), F.sum("total").alias("total"))


def _interval(text: str) -> Column:
    return F.expr(f"INTERVAL {text}")


def late_stream(df: DataFrame, state: LateState, checkpoint: str, arrival: Sequence[str], delay: str, allowed: str, size: str, value: str, on_time: Sink, late: Sink) -> StreamingQuery:
    """A stream of (ts, key, …) whose rows are judged as they arrive, and the windows' totals that accepted rows make.

    The watermark of a row is ``delay`` behind the newest row before it in the
    order of ``arrival``.  Rows before it are late; those at most ``allowed``
    behind it still change their window, the others go to ``late`` with watermark,
    lateness and reason.  The folder of ``state`` then has for every batch

    * marks: the newest time so far, from which the next batch goes on;
    * totals: what it adds to its windows (summed up now and then);
    * panes: windows that the watermark has passed with it, and closed ones that it has changed, with their new totals;
    * metrics: rows in, late and dropped, watermark, windows open and closed.
    """
    spark = df.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        carried = state.mark(spark, number - 1)
        batch = batch.persist()  # read once: ranges are sampled from it and cut in it
        rows = prefix_max(batch, [F.col(c) for c in arrival], "ts", "_seen").persist()
        top = F.greatest(F.col("_seen"), F.lit(carried).cast("timestamp"))
        judged = rows.withColumn("watermark", top - _interval(delay)).drop("_seen")
        judged = judged.withColumn("is_late", F.coalesce(F.col("ts") < F.col("watermark"), F.lit(False)))
        judged = judged.withColumn("accepted", F.coalesce(F.col("ts") >= F.col("watermark") - _interval(allowed), F.lit(True)))
        accepted = judged.filter("accepted")
        on_time(accepted.drop("accepted"), number)
        seconds = (F.unix_micros("watermark") - F.unix_micros("ts")) / 1e6
        late(judged.filter("NOT accepted").drop("accepted").withColumns({"late_seconds": seconds, "reason": F.lit("late_beyond_allowed_lateness")}), number)

        windows = accepted.groupBy("key", F.window("ts", size).alias("w")).agg(F.count("*").alias("event_count"), F.sum(F.col(value).cast("double")).alias("total"))
        windows.select("key", F.col("w.start").alias("window_start"), "event_count", "total").write.mode("overwrite").parquet(state.of("totals", number))
        counts = judged.agg(F.count("*").alias("events_in"), F.count_if("is_late").alias("events_late"), F.count_if(~F.col("accepted")).alias("events_dropped"), F.greatest(F.max("ts"), F.lit(carried).cast("timestamp")).alias("newest")).first()
        rows.unpersist()
        batch.unpersist()

        mark = F.lit(counts.newest).cast("timestamp") - _interval(delay)
        before = F.lit(carried).cast("timestamp") - _interval(delay)
        end = F.col("window_start") + _interval(size)
        whole = state.totals(spark, number)
        touched = spark.read.schema("key string, window_start timestamp").parquet(state.of("totals", number)).withColumn("touched", F.lit(True))
        was = F.coalesce(end <= before, F.lit(False))
        panes = whole.join(touched, ["key", "window_start"], "left").filter((end <= mark) & (~was | F.coalesce("touched", F.lit(False))))
        panes.select("key", "window_start", "event_count", "total", F.when(was, "update").otherwise("final").alias("reason")).write.mode("overwrite").parquet(state.of("panes", number))
        if number % state.keep == state.keep - 1:
            whole.write.mode("overwrite").parquet(state.of("summaries", number))
        windows = whole.agg(F.count_if(end > mark).alias("active_windows"), F.count_if(end <= mark).alias("closed_windows"))
        windows.select(F.lit(counts.events_in).alias("events_in"), F.lit(counts.events_late).alias("events_late"), F.lit(counts.events_dropped).alias("events_dropped"), mark.alias("watermark"), "active_windows", "closed_windows").write.mode("overwrite").parquet(state.of("metrics", number))
        # last, so that a batch which fails before is done anew from the same mark
        spark.range(1).select(F.lit(counts.newest).cast("timestamp").alias("newest")).write.mode("overwrite").parquet(state.of("marks", number))

    counted = df.observe("arrivals", F.count(F.lit(1)).alias("events_in"), F.max("ts").alias("newest"))
    return counted.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start()


class Counters(StreamingQueryListener):
    """Sums what the progress of a query says: rows read, observed metrics, rows dropped, windows open and closed."""

    def __init__(self, query_name: str | None = None):
        self.name = query_name
        self.rows_in = self.dropped = self.removed = self.active = 0
        self.observed: list[dict] = []
        self.batches: dict[int, int] = {}
        self.watermark: str | None = None
        self._over = threading.Event()

    def onQueryStarted(self, event: Any) -> None:
        self._over.clear()

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryProgress(self, event: Any) -> None:
        p = event.progress
        if self.name not in (None, p.name):
            return
        self.rows_in += max(p.numInputRows, 0)
        self.batches[p.batchId] = p.numInputRows
        self.observed += [dict(r.asDict(), name=n, batch=p.batchId) for n, r in p.observedMetrics.items()]
        self.watermark = p.eventTime.get("watermark", self.watermark)
        for s in p.stateOperators:
            self.dropped += s.numRowsDroppedByWatermark
            self.removed += s.numRowsRemoved
            self.active = s.numRowsTotal

    def onQueryTerminated(self, event: Any) -> None:
        self._over.set()

    def wait(self, seconds: float = 60) -> Counters:
        """Waits until the listener has heard that the query is over."""
        if not self._over.wait(seconds):
            raise TimeoutError("the query has not ended")
        return self


# ------------------------------------------------------------ state of a running query
def state_at(spark: SparkSession, checkpoint: str, batch: int, operator: int = 0) -> DataFrame:
    """(key struct, value struct) of a stateful operator as it was after a batch."""
    rows = spark.read.format("statestore").option("batchId", batch).option("operatorId", operator).load(checkpoint)
    return rows.select("key", "value")


def _files(spark: SparkSession, path: str) -> tuple[Any, Any]:
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def snapshot(spark: SparkSession, checkpoint: str, batch: int, folder: str, keep: int = 5) -> str:
    """Copies what a query needs to go on after ``batch`` into ``folder``/batch=…, and takes away all but the newest ``keep`` copies.

    What the batches up to this one have written stays; offsets and commits of
    later ones are left out, so a query that is started on a copy of it does these
    batches anew.
    """
    system, source = _files(spark, checkpoint)
    target = f"{folder}/batch={batch:09d}"
    _, place = _files(spark, target)
    copy = spark._jvm.org.apache.hadoop.fs.FileUtil.copy
    conf = spark._jsc.hadoopConfiguration()
    path = spark._jvm.org.apache.hadoop.fs.Path
    draft = path(f"{folder}/draft-{batch:09d}")
    system.delete(draft, True)
    system.mkdirs(draft)
    for entry in system.listStatus(source):
        name = entry.getPath().getName()
        if name not in ("offsets", "commits"):
            copy(system, entry.getPath(), system, path(draft, name), False, conf)
            continue
        system.mkdirs(path(draft, name))
        for log in system.listStatus(entry.getPath()):
            number = log.getPath().getName()
            if number.isdigit() and int(number) <= batch:
                copy(system, log.getPath(), system, path(draft, f"{name}/{number}"), False, conf)
    system.delete(place, True)
    system.rename(draft, place)
    for old in snapshots(spark, folder)[:-keep]:
        system.delete(path(f"{folder}/batch={old:09d}"), True)
    return target


def snapshots(spark: SparkSession, folder: str) -> list[int]:
    """The batches of which there are copies."""
    system, place = _files(spark, folder)
    found = system.listStatus(place) if system.exists(place) else []
    return sorted(int(e.getPath().getName().split("=")[1]) for e in found if e.getPath().getName().startswith("batch="))


def restore(spark: SparkSession, folder: str, batch: int, checkpoint: str) -> str:
    """A checkpoint of one's own from the copy of a batch: a query started on it goes on after that batch."""
    system, target = _files(spark, checkpoint)
    if system.exists(target):
        raise AnalysisException(f"there is something in {checkpoint} already")
    source = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch={batch:09d}")
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(system, source, system, target, False, spark._jsc.hadoopConfiguration())
    return checkpoint


def schema_text(schema: StructType) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
