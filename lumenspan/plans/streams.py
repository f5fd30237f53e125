"""Streams run to their end over recorded events, with their batch twins as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenspan.plans.proxies import FRAMES, frames
from lumenspan.registry import query
from lumenspan.session import scratch
from lumenspan.streaming import motion as M
from lumenspan.streaming import telemetry as S

_STREAK = """i as (select *, sum(case when ok then 0 else 1 end) over (partition by device order by seq) as island from s),
r as (select *, sum(case when ok then 1 else 0 end) over (partition by device, island order by seq)::bigint as streak from i)"""


def recorded(spark, sf, rows):
    """A recorded stream: rows written once, read as they would arrive."""
    path = scratch(spark, "recorded")
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


@query("stm01_malformed_policy", f"with {FRAMES} select device, count(*) filter (event_id % 5 <> 0) as parsed from frames where event_id % 5 <> 0 group by device")
def stm01(spark, sf):
    """Lines of a stream; the malformed ones are skipped."""
    line = F.when(F.col("event_id") % 5 == 0, "TLM:Z=nope,R=1,P=1,S=1").otherwise(F.concat(F.lit("TLM:Z="), F.col("depth").cast("string"), F.lit(",R=1,P=2,S=1")))
    got = S.telemetry(recorded(spark, sf, frames(spark, sf).select("device", "seq", line.alias("line"))))
    return S.run_to_end(got.select("device", "seq", "z"), spark, "telemetry").groupBy("device").agg(F.count("*").alias("parsed"))


@query("stm02_boundary_discard", f"with {FRAMES} select device, min(seq) as first_seq, count(*) as n from frames where ts > timestamp '2024-01-03 00:00:00' + interval 1 hour group by device")
def stm02(spark, sf):
    got = S.after_boundary(recorded(spark, sf, frames(spark, sf).select("device", "seq", "ts")), F.expr("timestamp_ntz'2024-01-03 00:00:00'"), "1 hour")
    return S.run_to_end(got, spark, "fresh").groupBy("device").agg(F.min("seq").alias("first_seq"), F.count("*").alias("n"))


@query("stm03_wait_stable", f"with {FRAMES}, s as (select *, stable and depth > 20 as ok from frames), {_STREAK} select device, min(seq) as ready_at from r where streak >= 3 group by device")
def stm03(spark, sf):
    rows = frames(spark, sf).select("device", "seq", (F.col("stable") & (F.col("depth") > 20)).alias("ok"))
    return S.run_to_end(S.stable_streaks(recorded(spark, sf, rows), 3), spark, "stable")


@query("stm04_first_stable", f"with {FRAMES} select device, min(seq) filter (stable) as first_stable from frames group by device")
def stm04(spark, sf):
    """A stream's first stable sample of each device; devices without one stay
    NULL."""
    rows = frames(spark, sf).select("device", "seq", F.col("stable").alias("ok"))
    got = S.run_to_end(S.first_seen(recorded(spark, sf, rows)), spark, "first")
    return rows.select("device").distinct().join(got, "device", "left").select("device", F.col("at").alias("first_stable"))


@query("stm05_bounded_attempts", f"with {FRAMES}, s as (select *, stable and depth > 20 as ok from frames where seq <= 8), {_STREAK} select device, min(seq) as ready_at from r where streak >= 4 group by device")
def stm05(spark, sf):
    rows = frames(spark, sf).select("device", "seq", (F.col("stable") & (F.col("depth") > 20)).alias("ok"))
    return S.run_to_end(S.stable_streaks(recorded(spark, sf, rows), 4, attempts=8), spark, "bounded")


@query("stm06_command_ack", f"with {FRAMES}, a as (select device, min(seq) filter (kind = 'signup') as ack from frames group by device) select device, any_value(ack) as ack, min(seq) as done from frames join a using (device) where kind = 'purchase' and seq > ack group by device")
def stm06(spark, sf):
    rows = frames(spark, sf).select("device", "seq", (F.col("kind") == "signup").alias("is_ack"), (F.col("kind") == "purchase").alias("is_done"))
    return S.run_to_end(S.acknowledged(recorded(spark, sf, rows)), spark, "acks")


@query("stm07_light_ack", f"with {FRAMES} select device, min(seq) filter (kind = 'click' and seq > 3) as ack from frames where seq <= 30 group by device")
def stm07(spark, sf):
    """The first exact answer after the input was reset, from a stream."""
    rows = frames(spark, sf).where("seq <= 30").select("device", "seq", ((F.col("kind") == "click") & (F.col("seq") > 3)).alias("ok"))
    got = S.run_to_end(S.first_seen(recorded(spark, sf, rows)), spark, "light")
    return rows.select("device").distinct().join(got, "device", "left").select("device", F.col("at").alias("ack"))


@query("stm09_state_transitions", f"with {FRAMES}, t as (select device, seq, kind, lag(kind, 1, 'start') over (partition by device order by seq) as before from frames) select before, kind, count(*) as n, count(*) filter (before <> 'error' or kind = 'error') as allowed from t group by all")
def stm09(spark, sf):
    """Transitions of each device's state as a stream, and how many are allowed."""
    got = S.run_to_end(S.transitions(recorded(spark, sf, frames(spark, sf).select("device", "seq", "kind")), "start"), spark, "transitions")
    return got.groupBy("before", "kind").agg(F.count("*").alias("n"), F.count_if((F.col("before") != "error") | (F.col("kind") == "error")).alias("allowed"))


@query("stm12_ring_buffer", f"with {FRAMES} select device, list(seq order by seq) as kept from (select device, seq, max(seq) over (partition by device) as top from frames) where seq > top - 5 group by device")
def stm12(spark, sf):
    got = S.run_to_end(S.ring_buffer(recorded(spark, sf, frames(spark, sf).select("device", "seq")), 5), spark, "ring")
    return got.groupBy("device").agg(F.max_by("kept", F.element_at("kept", -1)).alias("kept"))


@query("stm13_resample", "select time_bucket(interval 6 hours, ts) as start, round(avg(value), 6) as mean, count(*) as n from events group by all")
def stm13(spark, sf):
    """Tumbling means of a stream; each trigger's complete result, so that the
    last windows show too, takes the place of the one before in the shared
    folder."""
    rows = spark.read.parquet(f"{sf}/events.parquet").select("ts", "value")
    w = recorded(spark, sf, rows).groupBy(F.window("ts", "6 hours")).agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
    w = w.select(F.col("window.start").alias("start"), F.round("mean", 6).alias("mean"), "n")
    out = scratch(spark, "resampled")
    q = w.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{out}/data")).option("checkpointLocation", f"{out}/state").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(w.schema).parquet(f"{out}/data")


#: Recorded events are hours apart, and so are the times of the wait.
_HOUR = 3_600_000
WAIT = M.Wait(timeout=60 * _HOUR, guard=_HOUR, observe=12 * _HOUR, samples=3)


@query("stm03_motion_deadlines", f"""with {FRAMES}, f as (select device, seq, epoch_ms(ts) as ms, kind = 'signup' as command, stable from frames),
c as (select *, lead(seq) over w as next_seq, lead(ms) over w as next_ms from f where command window w as (partition by device order by seq)),
j as (select c.device, c.seq as command, c.ms as sent, f.seq, f.ms, f.stable from c join f on f.device = c.device and f.seq > c.seq and f.seq < coalesce(c.next_seq, 1000000000000) and f.ms < c.ms + {WAIT.timeout}),
b as (select *, sum(case when stable then 0 else 1 end) over (partition by device, command order by seq) as breaks from j where ms >= sent + {WAIT.guard}),
s as (select *, count(*) filter (stable) over (partition by device, command, breaks order by seq) as streak from b),
d as (select device, command, min(seq) as done from s where stable and streak >= {WAIT.samples} and (breaks > 0 or ms >= sent + {WAIT.guard + WAIT.observe}) group by all),
l as (select device, command, max(seq) as last from j group by all),
o as (select c.device, c.seq as command, case when done is not null then 'STABLE' when next_ms < ms + {WAIT.timeout} then 'REPLACED' when ms + {WAIT.timeout} <= (select max(ms) from f) then 'TIMEOUT' end as outcome, done, next_seq, last
  from c left join d on d.device = c.device and d.command = c.seq left join l on l.device = c.device and l.command = c.seq)
select device, command, outcome, case outcome when 'STABLE' then done when 'REPLACED' then next_seq else last end as at from o where outcome is not null""")
def stm03_deadlines(spark, sf):
    """How each command of a stream ends: completed by stable samples after the
    motion was seen or is no longer expected, timed out, or replaced."""
    rows = frames(spark, sf).select("device", "seq", F.col("ts").cast("timestamp").alias("ts"), (F.col("kind") == "signup").alias("command"), F.lit(None).cast("double").alias("target"), F.col("depth").alias("z"), "stable")
    return M.run(M.completions(recorded(spark, sf, rows), WAIT), scratch(spark, "motion"))


@query("stm15_replay_timeline", "select (i - 1)::bigint as step, round(12.0 * i / 7, 6) as elapsed from (select unnest(range(1, 8)) as i)")
def stm15(spark, sf):
    return spark.range(7).select(F.col("id").alias("step"), F.round(12.0 * (F.col("id") + 1) / 7, 6).alias("elapsed"))
