"""The control loop's folds over recorded samples, and the same recursions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenspan.operators import control as C
from lumenspan.plans.proxies import FRAMES, frames
from lumenspan.registry import query

#: What a sample stands for: errors of the two axes, ticks and modes.
_INPUT = {
    "tick": "seq * 20 + seq % 3 * 5",
    "err_phi": "(depth % 8) / 1.0007 - 4",
    "err_theta": "(depth % 0.5) / 1.003 - 0.25",
    "rate_phi": "depth % 3 - 1.5",
    "rate_theta": "depth % 5 - 2.5",
    "mode": "case when seq % 11 = 0 then device % 3 else 2 end",
    "imu": "device % 2",
    "output": "depth / 4 - 61",
    "z_term": "case when seq % 61 < 3 then 1 else 0 end",
    "command": "case when seq % 97 = 50 then 1 else 0 end",
    "small_phi": "case when seq % 40 < 25 then depth % 0.15 else depth % 0.4 end",
    "small_theta": "case when seq % 40 < 27 then -(depth % 0.14) else depth % 0.3 end",
}


def samples(spark, sf, *names):
    return frames(spark, sf).select("device", "seq", *[F.expr(_INPUT[n]).alias(n) for n in names])


def _recursion(state: str, first: str, step: str, out: str) -> str:
    """DuckDB SQL of a fold: ``first`` and ``step`` give the state's columns
    from a row f and the state before it, s."""
    columns = ", ".join(f"{e} as {n}" for n, e in _INPUT.items())
    return f"""with recursive {FRAMES}, f as materialized (select device, seq, {columns} from frames),
s({state}) as (select {first} from f where seq = 1 union all select {step} from s join f on f.device = s.device and f.seq = s.seq + 1)
select device, seq, {out} from s"""


def _axis(axis: str, kp: float, kdr: float, kd: float, ki: float, start: bool) -> tuple[str, str]:
    """SQL of an axis's integral and output."""
    e, most = f"f.err_{axis}", C.INTEG_LIMIT / ki
    before, held = ("0.0", "0.0") if start else (f"s.err_{axis}", f"case when f.command = 1 then 0.0::double else s.held_{axis} end")
    dt = f"{C.FIRST_DT}" if start else f"case when f.command = 1 then {C.FIRST_DT} else least({C.MOST_DT}, (f.tick - s.tick) / 1000) end"
    total = f"case when f.mode = 2 then greatest({-most!r}::double, least({most!r}::double, {held} + {e} * {dt})) else 0.0::double end"
    y = f"case when abs({e}) > {C.ERR_DEADBAND} then {e} * {kp} else 0 end + case when f.mode = 0 then 0 when f.imu = 1 then -f.rate_{axis} * {kdr} else ({e} - {before}) * {kd} end + ({total}) * {ki}"
    return total, y


def _attitude(start: bool) -> str:
    p = _axis("phi", C.KP_PHI, C.KDR_PHI, C.KD_PHI, C.KI_PHI, start)
    t = _axis("theta", C.KP_THETA, C.KDR_THETA, C.KD_THETA, C.KI_THETA, start)
    return f"f.device, f.seq, f.tick, f.err_phi, f.err_theta, {p[0]}, {t[0]}, {p[1]}, {t[1]}"


_PID = _recursion(
    "device, seq, tick, err_phi, err_theta, held_phi, held_theta, fix_phi, fix_theta", _attitude(True), _attitude(False),
    f"round(fix_theta * {C.K_THETA_P1}, 6) as out1, round(-fix_theta * {C.K_THETA_P23} - fix_phi * {C.K_PHI_P23}, 6) as out2, round(-fix_theta * {C.K_THETA_P23} + fix_phi * {C.K_PHI_P23}, 6) as out3",
)


@query("mth36_pid_output", _PID)
def mth36(spark, sf):
    """Outputs of three motors over each device's samples, in order."""
    rows = samples(spark, sf, "tick", "err_phi", "err_theta", "rate_phi", "rate_theta", "mode", "imu", "command")
    got = C.per_device(rows, C.attitude, "out1 double, out2 double, out3 double")
    return got.select("device", "seq", *[F.round(c, 6).alias(c) for c in ("out1", "out2", "out3")])


def _pulse(start: bool) -> str:
    held, left, way = ("0::real", "0", "0") if start else ("s.held", "s.left", "s.way")
    size, sign = "abs(f.output::real)", "case when f.output > 0 then 1 else -1 end"
    rest, full = f"{size} <= {C.OUT_MIN}", f"{size} >= {C.PULSE_FULL}"
    total = f"({held} + greatest({C.PULSE_DUTY_MIN}::real, {size} / {C.PULSE_FULL}::real))"
    go = f"{left} = 0 and not ({rest}) and not ({full}) and {total} >= {C.PULSE_ON_TICKS}"
    return f"""f.device, f.seq,
  case when {left} > 0 then {held} when {rest} or {full} then 0::real when {go} then {total} - {C.PULSE_ON_TICKS}::real else {total} end::real,
  case when {left} > 0 then {left} - 1 when {go} then {C.PULSE_ON_TICKS - 1} else 0 end::int, case when {go} then {sign} else {way} end::int,
  case when {left} > 0 then {way} * {C.PWM_MIN} when {rest} then 0 when {full} then {sign} * trunc(least({C.PWM_MAX}, {C.PWM_MIN}::real + ({size} - {C.PULSE_FULL}::real))) when {go} then {sign} * {C.PWM_MIN} else 0 end::bigint"""


@query("mth38_pulse_modulation", _recursion("device, seq, held, left_, way, value".replace("left_", '"left"'), _pulse(True).replace("s.left", 's."left"'), _pulse(False).replace("s.left", 's."left"'), "value"))
def mth38(spark, sf):
    """A motor's commands over each device's samples, in order."""
    return C.per_device(samples(spark, sf, "output"), C.pulses, "value long")


def _sleep(start: bool) -> str:
    woken = "f.command = 1 or f.z_term <> 0"
    asleep, since = ("false", "0") if start else (f"(s.asleep and not ({woken}))", f"case when {woken} then 0 else s.since end")
    worst = "greatest(abs(f.small_phi), abs(f.small_theta))"
    begun = f"case when ({since}) = 0 then f.tick else {since} end"
    return f"""f.device, f.seq,
  case when f.z_term <> 0 then false when {asleep} then {worst} <= {C.SLEEP_EXIT} else {worst} <= {C.SLEEP_ENTER} and f.tick - ({begun}) >= {C.SLEEP_HOLD_MS} end,
  case when f.z_term <> 0 then 0 when {asleep} then case when {worst} <= {C.SLEEP_EXIT} then {since} else 0 end when {worst} <= {C.SLEEP_ENTER} then {begun} else 0 end::bigint"""


@query("mth40_sleep_hysteresis", _recursion("device, seq, asleep, since", _sleep(True), _sleep(False), "asleep"))
def mth40(spark, sf):
    """Is each device's loop asleep, sample by sample."""
    rows = samples(spark, sf, "tick", "z_term", "small_phi", "small_theta", "command").withColumnsRenamed({"small_phi": "err_phi", "small_theta": "err_theta"})
    return C.per_device(rows, C.sleeping, "asleep boolean")
