"""Alerts on consecutive failures with keyed state: value state, list state and event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from armada import values
from armada.streaming.times import DELAY, with_event_time

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# A probe as it waits: a target's probes of a batch are one value of its state, for each value costs a call.
PROBE = np.dtype([("at", "<i8"), ("tie", "<i8"), ("ok", "?")])


def packed(frame: pd.DataFrame) -> bytes:
    probes = np.empty(len(frame), PROBE)
    for field in PROBE.names:
        probes[field] = frame[field].astype(PROBE[field])
    return probes.tobytes()


def alerts_of(key: tuple, times: list[int]) -> pd.DataFrame:
    return pd.DataFrame(
        {"target": pd.Series([key[0]] * len(times), dtype="object"), "alert_at": pd.Series(times, dtype="int64")}
    )


class FailureRuns(StatefulProcessor):
    """Failures in a row of one target.

    Probes wait in a list until the watermark has passed them, for only then is their order known; so a
    target's state holds the probes of the delay at most. ``run`` holds the failures so far and the time
    of the last probe counted. A timer wakes the target when the watermark passes its earliest waiting
    probe, and another when it has been quiet for so long that its run is over: then nothing is kept.
    """

    def __init__(self, threshold: int, quiet_ms: int | None):
        self.threshold, self.quiet_ms = threshold, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "failures long, last long")
        self.waiting = handle.getListState("waiting", "probes binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            if len(frame):
                self.waiting.appendValue((packed(frame),))
                self.handle.registerTimer(-(-int(frame["at"].min()) // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = self.run.get()
        failures, last = held or (0, None)
        waiting = np.frombuffer(b"".join(bytes(row[0]) for row in self.waiting.get()), PROBE)
        ready = waiting[waiting["at"] <= passed]
        alerts = []
        for at, _, ok in np.sort(ready, order=PROBE.names).tolist():
            if self.quiet_ms is not None and last is not None and at - last > self.quiet_ms * 1000:
                failures = 0
            failures, last = (0 if ok else failures + 1), at
            if failures == self.threshold:
                alerts.append(at)
        if len(ready) < len(waiting):
            later = waiting[waiting["at"] > passed]
            self.waiting.put([(later.tobytes(),)])
            self.handle.registerTimer(-(-int(later["at"].min()) // 1000))
        elif len(waiting):
            self.waiting.clear()
        over = self.quiet_ms is not None and last is not None and last + self.quiet_ms * 1000 < passed
        if failures and not over:
            self.run.update((failures, last))
            if self.quiet_ms is not None:
                self.handle.registerTimer(last // 1000 + self.quiet_ms + 2)
        elif held is not None:
            self.run.clear()
        return iter([alerts_of(key, alerts)] if alerts else ())

    def close(self) -> None:
        pass


def use_keyed_state(spark: SparkSession) -> None:
    """Streams with timers keep their state in RocksDB; set before the stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def state_alerts(
    probes: DataFrame, target: str, ts: str, tie: str, ok: str, threshold: int = values.LIVENESS_FAILURES,
    quiet: str | None = None, delay: str = DELAY,
) -> DataFrame:
    """T3 as a stream (target, alert_at): one alert when a target reaches ``threshold`` failures in a row.

    Probes count in order of (``ts``, ``tie``) once the watermark has passed them; later ones are dropped by
    the engine. A success resets, and so does a gap longer than ``quiet`` between two probes of a target;
    the state of a target that is quiet for that long is dropped. A probe without verdict is a failure; rows
    without time or target are left out. ``tie`` is a whole number.
    """
    spark = probes.sparkSession
    use_keyed_state(spark)
    quiet_ms = None
    if quiet is not None:
        zero = F.lit("1970-01-01 00:00:00").cast("timestamp")
        quiet_ms = spark.range(1).select(F.unix_millis(zero + F.expr(f"INTERVAL {quiet}")) - F.unix_millis(zero)).first()[0]
    named = with_event_time(probes, ts, delay).filter(F.col(ts).isNotNull() & F.col(target).isNotNull())
    kind = probes.schema[target].dataType.simpleString()
    rows = named.select(
        F.col(target).alias("target"), F.col(ts), F.unix_micros(ts).alias("at"), F.col(tie).cast("long").alias("tie"),
        F.coalesce(F.col(ok), F.lit(False)).alias("ok"),
    )
    found = rows.groupBy("target").transformWithStateInPandas(
        FailureRuns(threshold, quiet_ms), f"target {kind}, alert_at long", "append", "EventTime"
    )
    return found.select("target", F.timestamp_micros("alert_at").alias("alert_at"))
