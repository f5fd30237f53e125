"""A device's control loop as folds over its rows, in order of ``seq``.

Each fold keeps a few numbers from row to row, so a device's rows are held by
one task; devices are dealt over the cluster.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Gains, limits and mixing of the controller (fixed values).
KP_THETA, KP_PHI = 90.0, 105.0
KDR_THETA, KDR_PHI = 2.90, 3.30
KD_THETA, KD_PHI = 15.0, 12.0
KI_PHI, KI_THETA, INTEG_LIMIT = 31.0, 27.0, 200.0
ERR_DEADBAND = 0.10
K_THETA_P1, K_THETA_P23, K_PHI_P23 = 1.0000, 0.5000, 0.8660
FIRST_DT, MOST_DT = 0.020, 0.100
#: Pulses of a motor (fixed values).
OUT_MIN, PWM_MIN, PWM_MAX = 0.5, 220, 700
PULSE_FULL, PULSE_ON_TICKS, PULSE_DUTY_MIN = 50.0, 2, 0.20
#: Sleeping of the loop: errors in degrees, time in milliseconds (fixed values).
SLEEP_ENTER, SLEEP_EXIT, SLEEP_HOLD_MS = 0.15, 0.25, 300


def per_device(rows: DataFrame, fold: Callable[[pd.DataFrame], list[tuple]], columns: str) -> DataFrame:
    """(device, seq, columns) of a fold over each device's rows in order."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        out = pd.DataFrame(fold(pdf), columns=names)
        out.insert(0, "seq", pdf["seq"].to_numpy())
        out.insert(0, "device", pdf["device"].to_numpy())
        return out

    return rows.groupBy("device").applyInPandas(run, f"device long, seq long, {columns}")


def attitude(rows: pd.DataFrame) -> list[tuple[float, float, float]]:
    """Outputs of the three motors from err_phi, err_theta, rate_phi,
    rate_theta, tick (ms), mode (0 proportional, 1 damped, 2 with integral), imu
    (are the rates measured) and command (does a command arrive).

    The proportional term rests inside the deadband, damping and integral do
    not; the integral is bounded by what its term may give, and forgotten in
    other modes and, with the time of the row before, on a command; damping takes measured rates, else the error's difference.
    """
    out, last = [], None
    before, held = [0.0, 0.0], [0.0, 0.0]
    kp, kdr, kd, ki = (KP_PHI, KP_THETA), (KDR_PHI, KDR_THETA), (KD_PHI, KD_THETA), (KI_PHI, KI_THETA)
    for row in rows.itertuples(index=False):
        if row.command:
            held, last = [0.0, 0.0], None
        dt = FIRST_DT if not last else min(MOST_DT, (row.tick - last) / 1000)
        last = row.tick
        fix = []
        for axis, (err, rate) in enumerate(((row.err_phi, row.rate_phi), (row.err_theta, row.rate_theta))):
            y = err * kp[axis] if abs(err) > ERR_DEADBAND else 0.0
            if row.mode:
                y += -rate * kdr[axis] if row.imu == 1 else (err - before[axis]) * kd[axis]
            most = INTEG_LIMIT / ki[axis]
            held[axis] = max(-most, min(most, held[axis] + err * dt)) if row.mode == 2 else 0.0
            before[axis] = err
            fix.append(y + held[axis] * ki[axis])
        phi, theta = fix
        out.append((theta * K_THETA_P1, -theta * K_THETA_P23 - phi * K_PHI_P23, -theta * K_THETA_P23 + phi * K_PHI_P23))
    return out


def pulses(rows: pd.DataFrame) -> list[tuple[int]]:
    """A motor's command from its ``output``: a pulse once begun lasts its
    ticks; small outputs rest, large ones drive on, those between add up to
    pulses.  Sums are of single precision, as the controller's are."""
    full, least = np.float32(PULSE_FULL), np.float32(PULSE_DUTY_MIN)
    out, held, left, way = [], np.float32(0), 0, 0
    for x in rows["output"].to_numpy(np.float32):
        size, sign = abs(x), 1 if x > 0 else -1
        if left:
            left -= 1
            out.append((way * PWM_MIN,))
        elif size <= OUT_MIN or size >= full:
            held = np.float32(0)
            out.append((0 if size <= OUT_MIN else sign * int(min(PWM_MAX, PWM_MIN + (size - full))),))
        else:
            held += max(least, size / full)
            go = bool(held >= PULSE_ON_TICKS)
            if go:
                held, left, way = held - np.float32(PULSE_ON_TICKS), PULSE_ON_TICKS - 1, sign
            out.append((sign * PWM_MIN * go,))
    return out


def sleeping(rows: pd.DataFrame) -> list[tuple[bool]]:
    """Asleep after both errors were small for the holding time, awake once one
    is large; a command and a move along Z wake the loop and begin the time
    anew, and while Z moves it cannot fall asleep."""
    out, asleep, since = [], False, 0
    for err_phi, err_theta, z_term, tick, command in rows[["err_phi", "err_theta", "z_term", "tick", "command"]].itertuples(index=False):
        worst = max(abs(err_phi), abs(err_theta))
        if command or z_term:
            asleep, since = False, 0
        if z_term == 0:
            if asleep:
                asleep, since = (True, since) if worst <= SLEEP_EXIT else (False, 0)
            elif worst <= SLEEP_ENTER:
                since = since or tick
                asleep = tick - since >= SLEEP_HOLD_MS
            else:
                since = 0
        out.append((asleep,))
    return out
