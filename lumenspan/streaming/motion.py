"""Commands and their completion as a stream, with deadlines.

A device's command is done when enough stable samples follow each other at the
target, after a guard time, and the motion was seen or is no longer expected;
else its deadline makes a row.  State is one value and one timer in event time
a device, kept by Spark's state store, and nothing once the command has ended.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "device long, command long, outcome string, at long"
#: Outcomes: done in time, deadline passed, another command came first.
STABLE, TIMEOUT, REPLACED = "STABLE", "TIMEOUT", "REPLACED"


@dataclass(frozen=True)
class Wait:
    """Times in milliseconds after a command; samples that must be stable; and
    how far Z may be from its target, where the command names one."""

    timeout: int = 30_000
    guard: int = 500
    observe: int = 1_000
    samples: int = 3
    tolerance: float = 0.05

    def __post_init__(self):
        if self.samples < 1 or min(self.guard, self.observe) < 0 or self.timeout <= self.guard:
            raise ValueError("a wait needs a sample and a timeout after its guard")


class Completion(StatefulProcessor):
    """The pending command of a device: its number, time and target, stable
    samples in a row, whether motion was seen, and the last sample."""

    def __init__(self, wait: Wait):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "command long, sent long, target double, streak int, moved boolean, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.pending.get() if self.pending.exists() else None
        before, out = held, []
        for seq, ms, command, target, z, stable in pd.concat(list(rows)).sort_values("seq", kind="stable")[["seq", "ms", "command", "target", "z", "stable"]].itertuples(index=False):
            if held and ms >= held[1] + self.wait.timeout:
                out.append((key[0], held[0], TIMEOUT, held[5]))
                held = None
            if command:
                if held:
                    out.append((key[0], held[0], REPLACED, int(seq)))
                held = (int(seq), int(ms), None if pd.isna(target) else float(target), 0, False, None)
            elif held:
                number, sent, goal, streak, moved, _ = held
                if ms < sent + self.wait.guard:
                    streak = 0
                elif not stable or (goal is not None and not abs(z - goal) <= self.wait.tolerance):
                    streak, moved = 0, True  # a stable sample elsewhere is older than the motion
                else:
                    streak += 1
                held = (number, sent, goal, streak, moved, int(seq))
                if streak >= self.wait.samples and (moved or ms >= sent + self.wait.guard + self.wait.observe):
                    out.append((key[0], number, STABLE, int(seq)))
                    held = None
        if before and (not held or held[1] != before[1]):
            self.handle.deleteTimer(before[1] + self.wait.timeout)
        if held:
            self.pending.update(held)
            if not before or held[1] != before[1]:
                self.handle.registerTimer(held[1] + self.wait.timeout)
        elif before:
            self.pending.clear()
        yield self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.pending.get() if self.pending.exists() else None
        out = []
        if held and held[1] + self.wait.timeout <= expiredTimerInfo.getExpiryTimeInMs():
            out.append((key[0], held[0], TIMEOUT, held[5]))
            self.pending.clear()
        yield self._rows(out)

    @staticmethod
    def _rows(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({n: pd.array([r[i] for r in out], dtype=t) for i, (n, t) in enumerate((("device", "Int64"), ("command", "Int64"), ("outcome", "string"), ("at", "Int64")))})

    def close(self) -> None:
        pass


def completions(rows: DataFrame, wait: Wait, late: str = "0 seconds") -> DataFrame:
    """(device, command, outcome, at): one row for each command's end: STABLE
    with the sample that completes it, TIMEOUT with the last sample (NULL if
    none came), REPLACED with the command that came first.

    rows: device, seq, ts, command (is it one), target (of Z, or NULL), z and
    stable.  Rows of one trigger are taken by seq; a deadline passes when the
    watermark, ``late`` behind the newest row, or a row of its device does.
    """
    fed = rows.withWatermark("ts", late).select("device", "seq", "ts", F.unix_millis("ts").alias("ms"), "command", F.col("target").cast("double").alias("target"), F.col("z").cast("double").alias("z"), "stable")
    return fed.groupBy("device").transformWithStateInPandas(statefulProcessor=Completion(wait), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which timers need."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def run(stream: DataFrame, out: str) -> DataFrame:
    """Run over all that is there into Parquet at ``out``/data, state and
    offsets in ``out``/state, so that the next run goes on; all results so far."""
    spark = stream.sparkSession
    with rocksdb(spark):
        q = stream.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")
