"""The stored alert ledger (K9-K11): an append-only table of events, folded into the current state.

An event is (run_id, event, alert_id, raised_in, at, alert): ``raised`` carries the alert's columns, ``resolved`` names
the alert and the run that raised it. Nothing is ever changed or taken away: a detector run appends the alerts it
raises and the resolutions of those that have grown old, resolving one by hand appends one event, and the state is
one aggregation over the events. A run's events are one folder that is written as a whole, so the same run a
second time, or a second try after a lost driver, adds nothing.

Suppression reads the state that earlier runs left, so no detector runs again when the ledger is read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import alerts as al
from . import anomaly as an
from .store import RunLog

#: An alert as its detector made it, with its place in the run (detector, rank).
ALERT = T.StructType([
    T.StructField(name, kind) for name, kind in zip(
        [*an.ALERT_COLUMNS, "detector", "rank"],
        [T.StringType()] * 5 + [T.DoubleType()] * 2 + [T.StringType(), T.TimestampNTZType(), T.IntegerType(), T.IntegerType()])
])
EVENT = T.StructType([
    T.StructField("event", T.StringType()), T.StructField("alert_id", T.StringType()), T.StructField("raised_in", T.StringType()),
    T.StructField("at", T.TimestampNTZType()), T.StructField("alert", ALERT),
])


class Ledger(RunLog):
    """Events below ``root``, by run."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        super().__init__(spark, root, EVENT)

    def events(self) -> DataFrame:
        return self.rows()

    def state(self) -> DataFrame:
        """The alerts raised so far, resolved or not (``LEDGER_COLUMNS``), with the run that raised each."""
        raised = F.col("event") == "raised"
        folded = self.events().groupBy("alert_id", "raised_in").agg(
            F.max(F.when(raised, F.col("alert"))).alias("a"), F.min(F.when(~raised, F.col("at"))).alias("resolved_at"))
        found = folded.filter(F.col("a").isNotNull())
        return found.select(*(F.col(f"a.{c}").alias(c) for c in an.ALERT_COLUMNS), F.col("resolved_at").isNotNull().alias("resolved"), "resolved_at", "raised_in")

    def raised(self, run_id: str) -> DataFrame:
        """The alerts that one run raised, in the detectors' columns."""
        return self.events().filter((F.col("run_id") == run_id) & (F.col("event") == "raised")).select("alert.*")

    def run(self, run_id: str, candidates: Callable[[], DataFrame], at: Column, hours: int = 24) -> bool:
        """K9 and K10 of one detector run: raise what isn't suppressed, resolve open alerts older than ``hours``."""

        def events() -> DataFrame:
            state = self.state()
            accepted = al.suppress(candidates(), state.drop("raised_in"), at, hours)
            alert = F.struct(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in ALERT))
            new = accepted.select(F.lit("raised").alias("event"), "alert_id", F.lit(run_id).alias("raised_in"), F.col("detected_at").alias("at"), alert.alias("alert"))
            old = state.filter(~F.col("resolved") & (F.col("detected_at") < at - F.expr(f"INTERVAL {hours} HOURS")))
            return new.unionByName(self._resolutions(old, at))

        return self.append(run_id, events)

    def _resolutions(self, alerts: DataFrame, at: Column) -> DataFrame:
        return alerts.select(
            F.lit("resolved").alias("event"), "alert_id", "raised_in", at.cast("timestamp_ntz").alias("at"), F.lit(None).cast(ALERT).alias("alert"))

    def resolve(self, alert_id: str, at: Column, request: str) -> int:
        """Append the resolution of an open alert; how many alerts have the id (0: not found). ``request`` names the event."""
        known = self.state().filter(F.col("alert_id") == alert_id)
        n = known.count()
        if n:
            self.append(f"resolve-{request}", self._resolutions(known.filter(~F.col("resolved")), at))
        return n

    def copy(self, root: str) -> Ledger:
        """Another ledger with the same events."""
        out = Ledger(self.spark, root)
        for run_id in self.runs():
            out.append(run_id, self.events().filter(F.col("run_id") == run_id))
        return out
