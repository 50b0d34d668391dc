"""Drift-gated ingest as a running query that fails closed.

A micro-batch goes through two phases.  In the first it is only read: repairs that
are in use are applied, the drift against the baseline is measured, and where it is
of medium severity or more every candidate repair is tried and measured anew.  A
repair passes if it keeps all rows and brings the drift below the threshold.
If none passes, the batch raises ``GateClosed``: the query stops, nothing of the
batch is written, and its offsets stay, so that the query goes on with the same
batch when it is started again with a repair that fits.  In the second phase
the rows go to the lake, a repaired batch becomes the new baseline, and the decision
is written last; readers see only batches that have a decision, so lake and
baseline move together, and a batch that is repeated replaces itself.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lakeguard.operators import drift as D
from lakeguard.operators.healing import SEVERITIES, Repair

_DECISION = "severity string, repair string, in_use array<string>, before double, after double, baseline int, n long"


class GateClosed(RuntimeError):
    """A batch drifts and no repair passes."""


def severity_of(drift: float, zeta: float) -> str | None:
    """By how often the drift is the threshold."""
    return next((name for limit, name in ((3, "critical"), (2, "high"), (1.5, "medium"), (1, "low")) if drift > limit * zeta), None)


@dataclass(frozen=True)
class Gate:
    """Ingest into ``path``/lake of batches whose ``columns`` are like the baseline; ``zeta`` is the drift that is let through."""

    path: str
    columns: Sequence[str]
    repairs: Mapping[str, Repair] = field(default_factory=dict)
    zeta: float = D.ZETA
    least: str = "medium"

    def register(self, rows: DataFrame) -> None:
        """Makes these rows the first baseline; they need values in all of the columns."""
        self._baseline(rows, -1)
        if rows.sparkSession.read.parquet(f"{self.path}/baselines/moments/version=-1").count() < len(self.columns):
            raise ValueError(f"the baseline has no values in some of {list(self.columns)}")

    def _baseline(self, rows: DataFrame, version: int) -> None:
        long = D.long_form(rows, [], self.columns)
        D.histograms(long).write.mode("overwrite").parquet(f"{self.path}/baselines/bins/version={version}")
        long.groupBy("column").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("spread")).write.mode("overwrite").parquet(f"{self.path}/baselines/moments/version={version}")

    def drift(self, rows: DataFrame, version: int) -> float:
        """The largest divergence of a column from a version of the baseline; one that moved by over two deviations has at least that many thresholds.

        A column without values in the rows is infinitely far.
        """
        spark = rows.sparkSession
        long = D.long_form(rows, [], self.columns)
        kl = D.kl_divergence(D.histograms(long), spark.read.parquet(f"{self.path}/baselines/bins/version={version}"), [])
        base = spark.read.parquet(f"{self.path}/baselines/moments/version={version}")
        scale = F.when(F.col("spread") > 0, F.col("spread")).otherwise(1.0)
        # a row for each column
        moved = long.groupBy("column").agg(F.avg("v").alias("v")).join(base, "column").select("column", (F.abs(F.col("v") - F.col("mean")) / scale).alias("shift"))
        lifted = F.when(F.col("shift") > 2, F.greatest("kl", F.col("shift") * self.zeta)).otherwise(F.col("kl"))
        found = kl.join(moved, "column").agg(F.count("*").alias("n"), F.max(lifted).alias("drift")).first()
        return found.drift if found.n == len(self.columns) else float("inf")

    def decisions(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"{_DECISION}, batch_id int").parquet(f"{self.path}/decisions")

    def lake(self, spark: SparkSession) -> DataFrame:
        """The rows of all batches that have a decision."""
        return spark.read.parquet(f"{self.path}/lake").join(self.decisions(spark).select("batch_id"), "batch_id", "left_semi")

    def _standing(self, spark: SparkSession, batch: int) -> tuple[int, list[str]]:
        """The baseline's version and the repairs in use after a batch."""
        if batch < 0:
            return -1, []
        row = spark.read.schema(_DECISION).parquet(f"{self.path}/decisions/batch_id={batch}").first()
        return row.baseline, list(row.in_use)

    def take(self, batch: DataFrame, number: int) -> None:
        """Both phases of one batch."""
        spark = batch.sparkSession
        version, in_use = self._standing(spark, number - 1)
        missing = [r for r in in_use if r not in self.repairs]
        if missing:
            raise GateClosed(f"batch {number}: the repairs {missing} are in use but not given")
        rows = reduce(lambda df, name: self.repairs[name](df), in_use, batch).persist()
        n = rows.count()
        before = self.drift(rows, version) if n else 0.0
        severity, chosen, after = severity_of(before, self.zeta), None, None
        if severity and SEVERITIES.index(severity) >= SEVERITIES.index(self.least):
            passed = []
            for name, repair in sorted(self.repairs.items()):
                try:
                    mended = repair(rows)
                    _ = mended.schema
                except AnalysisException:
                    continue
                left = self.drift(mended, version)
                if left <= self.zeta and mended.count() == n:
                    passed.append((left, name))
            if not passed:
                rows.unpersist()
                raise GateClosed(f"batch {number}: drift {before:.4g} is of {severity} severity, and no repair brings it below {self.zeta}")
            after, chosen = min(passed)

        out = self.repairs[chosen](rows) if chosen else rows
        out.write.mode("overwrite").parquet(f"{self.path}/lake/batch_id={number}")
        if chosen:
            self._baseline(spark.read.parquet(f"{self.path}/lake/batch_id={number}"), number)
            version, in_use = number, [*in_use, chosen]
        decision = spark.createDataFrame([(severity, chosen, in_use, before, after, version, n)], _DECISION)
        decision.write.mode("overwrite").parquet(f"{self.path}/decisions/batch_id={number}")
        rows.unpersist()

    def stream(self, df: DataFrame, checkpoint: str) -> StreamingQuery:
        """Starts the query on what is there; it fails with the first batch that no repair fits."""
        return df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(self.take).trigger(availableNow=True).start()
