"""Telemetry as a stream: the parser with its two policies, a state machine
for stable samples after a command, and resampling.

Order is that of arrival: device lines carry no time of their own.  Each
operator has a batch twin among the window functions, and tests hold the two
against each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumenspan.functions.text import parse_telemetry
from lumenspan.session import scratch


def telemetry(lines: DataFrame, strict: bool = False) -> DataFrame:
    """Parsed telemetry lines; others pass by.  A malformed line is dropped,
    or an error where ``strict``."""
    t = lines.where(F.trim("line").startswith("TLM:")).withColumn("t", parse_telemetry(F.col("line")))
    if strict:
        t = t.withColumn("t", F.when(F.col("t").isNull(), F.raise_error(F.concat(F.lit("malformed telemetry: "), "line"))).otherwise(F.col("t")))
    return t.where("t is not null").select(*[c for c in t.columns if c != "t"], "t.*")


def malformed(lines: DataFrame) -> DataFrame:
    """The lines that the skipping policy drops."""
    return lines.where(F.trim("line").startswith("TLM:") & parse_telemetry(F.col("line")).isNull())


def after_boundary(rows: DataFrame, boundary, settle: str = "0 seconds", time: str = "ts") -> DataFrame:
    """Samples received after a command and its settling time."""
    return rows.where(F.col(time) > boundary + F.expr(f"interval {settle}"))


def _in_order(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple]:
    """A key's rows of one trigger by seq, whatever chunks they came in."""
    parts = [pdf[columns] for pdf in batches]
    if parts:
        yield from pd.concat(parts).sort_values("seq", kind="stable").itertuples(index=False)


def _per_device(rows: DataFrame, step, output: str, state: str, forget: str | None) -> DataFrame:
    """``step(device, batches, state or None)`` gives rows and the next state
    (None: nothing is kept).  With ``forget`` the state of a device that sends
    nothing for so long (a processing time, e.g. "10 minutes") is dropped."""
    names = [c.split()[0] for c in output.split(", ")]
    wait = None if forget is None else int(pd.Timedelta(forget).total_seconds() * 1000)

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        out, after = step(key[0], batches, held.get if held.exists else None)
        if after is not None:
            held.update(after)
            if wait is not None:
                held.setTimeoutDuration(wait)
        elif held.exists:
            held.remove()
        yield pd.DataFrame(out, columns=names)

    timeout = GroupStateTimeout.NoTimeout if wait is None else GroupStateTimeout.ProcessingTimeTimeout
    return rows.groupBy("device").applyInPandasWithState(run, output, state, "append", timeout)


def stable_streaks(rows: DataFrame, need: int, attempts: int | None = None, forget: str | None = None) -> DataFrame:
    """(device, ready_at): the sequence number at which a device's first
    streak of ``need`` passing samples ended, among its first ``attempts``.

    rows: device, seq, ok.  Rows of one trigger are taken by seq; those of a
    later trigger come after them.  The state is two numbers a device.
    """

    def step(device, batches, state):
        run, seen, done = state or (0, 0, False)
        out = []
        for seq, ok in _in_order(batches, ["seq", "ok"]):
            if done or (attempts is not None and seen >= attempts):
                break
            seen += 1
            run = run + 1 if ok else 0
            if run >= need:
                done = True
                out.append((device, int(seq)))
        return out, (run, seen, done)

    return _per_device(rows, step, "device long, ready_at long", "run long, seen long, done boolean", forget)


def acknowledged(rows: DataFrame, forget: str | None = None) -> DataFrame:
    """(device, ack, done): a command's echo, then the first completion mark
    after it.  rows: device, seq, is_ack, is_done, in order as above."""

    def step(device, batches, state):
        ack = state[0] if state else -1
        out = []
        for seq, is_ack, is_done in _in_order(batches, ["seq", "is_ack", "is_done"]):
            if ack == -1 and is_ack:
                ack = int(seq)
            elif ack >= 0 and is_done and seq > ack:
                out.append((device, ack, int(seq)))
                ack = -2
        return out, (ack,)

    return _per_device(rows, step, "device long, ack long, done long", "ack long", forget)


def first_seen(rows: DataFrame, forget: str | None = None) -> DataFrame:
    """(device, at): the first row of each device that is ``ok``."""

    def step(device, batches, state):
        if state:
            return [], state
        at = next((int(seq) for seq, ok in _in_order(batches, ["seq", "ok"]) if ok), None)
        return ([], None) if at is None else ([(device, at)], (at,))

    return _per_device(rows, step, "device long, at long", "at long", forget)


def transitions(rows: DataFrame, start: str, forget: str | None = None) -> DataFrame:
    """(device, seq, before, kind): each row's kind and that of the row before."""

    def step(device, batches, state):
        before, out = state[0] if state else start, []
        for seq, kind in _in_order(batches, ["seq", "kind"]):
            out.append((device, int(seq), before, kind))
            before = kind
        return out, (before,)

    return _per_device(rows, step, "device long, seq long, before string, kind string", "kind string", forget)


def ring_buffer(rows: DataFrame, size: int, forget: str | None = None) -> DataFrame:
    """(device, kept): after each trigger that brought rows, the last ``size``
    sequence numbers of the device; the newest array is the one that counts."""

    def step(device, batches, state):
        kept = [*(state[0] if state else []), *[int(seq) for (seq,) in _in_order(batches, ["seq"])]][-size:]
        return [(device, kept)], (kept,)

    return _per_device(rows, step, "device long, kept array<long>", "kept array<long>", forget)


def resample(rows: DataFrame, every: str, late: str, time: str = "ts", value: str = "value") -> DataFrame:
    """Mean and count in tumbling windows; later rows than ``late`` are left out."""
    w = rows.withWatermark(time, late).groupBy(F.window(time, every)).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), "mean", "n")


def paired(colour: DataFrame, depth: DataFrame, within: str = "1 hour") -> DataFrame:
    """Colour and depth of one frame id, joined as both arrive."""
    c = colour.withWatermark("c_ts", within)
    d = depth.withWatermark("d_ts", within)
    return c.join(d, F.expr(f"c_id = d_id and d_ts between c_ts - interval {within} and c_ts + interval {within}"))


def run_to_end(stream: DataFrame, spark: SparkSession, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, into Parquet with checkpoints in
    the shared folder, and read the result."""
    out = scratch(spark, name)
    q = stream.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")
