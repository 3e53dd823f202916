"""Keyed estimators with state: a clock filter and a lock machine, over tables and over streams alike.

One step function serves both. A table's keys are sorted and run through in a
task each, which streams the key's rows; a stream keeps each key's state between
batches. Keys are broadcasts, of which there are few dozens to a receiver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


@dataclass
class Track:
    """Offset in ms, drift in ms a minute, their covariance, when last seen (seconds), rows so far and the lock's state and score."""

    offset: float = 0.0
    drift: float = 0.0
    p00: float = 100.0
    p01: float = 0.0
    p11: float = 1.0
    seen: float = -1.0
    n: int = 0
    state: str = "ACQUIRING"
    score: int = 0


TRACK = "offset double, drift double, p00 double, p01 double, p11 double, seen double, n long, state string, score long"
OUT = "at double, measured double, offset double, drift double, sigma double, status string, state string"


def noise(snr: float) -> float:
    """Variance of a measurement: 1 ms at 10 dB, less for stronger signals, 0.1 ms at least."""
    return max(0.1, 10 ** (-(snr - 10) / 20)) ** 2


def step(t: Track, at: float, measured: float, snr: float, q_offset: float = 1e-3, q_drift: float = 1e-5) -> tuple[float, float, float, float, float, str, str]:
    """Moves ``t`` on by one measurement and tells what came of it.

    The time since the last row counts as 0.1 to 60 minutes. A measurement over 5
    sigma off is a MODE_CHANGE and does not move the estimate; over 3 sigma it is
    a POSSIBLE_CHANGE. Ten stable rows lock, three others unlock, and as many
    of these again acquire anew.
    """
    r = noise(snr)
    if t.n == 0:
        t.offset, t.p00, t.seen, t.n = measured, r, at, 1
        return at, measured, t.offset, t.drift, math.sqrt(t.p00), "STABLE", t.state
    dt = min(60.0, max(0.1, (at - t.seen) / 60))
    weak = 2.0 if snr < 10 else 1.0
    offset = t.offset + t.drift * dt
    p00 = t.p00 + 2 * dt * t.p01 + dt * dt * t.p11 + q_offset * dt * weak
    p01, p11 = t.p01 + dt * t.p11, t.p11 + q_drift * dt * weak
    off, s = measured - offset, p00 + r
    ratio = abs(off) / math.sqrt(s)
    status = "MODE_CHANGE" if ratio > 5 else "POSSIBLE_CHANGE" if ratio > 3 else "STABLE"
    if ratio <= 5:
        k0, k1 = p00 / s, p01 / s
        offset, drift = offset + k0 * off, t.drift + k1 * off
        # Joseph's form keeps the covariance positive.
        a = 1 - k0
        p11 = p11 - 2 * k1 * p01 + k1 * k1 * s
        p01 = a * (p01 - k1 * p00) + k0 * k1 * r
        p00 = a * a * p00 + k0 * k0 * r
        t.drift = drift
    t.offset, t.p00, t.p01, t.p11, t.seen, t.n = offset, p00, p01, p11, at, t.n + 1
    t.score = max(0, t.score) + 1 if status == "STABLE" else min(0, t.score) - 1
    if t.score >= 10:
        t.state = "LOCKED"
    elif t.score <= -6:
        t.state = "ACQUIRING"
    elif t.score <= -3 and t.state == "LOCKED":
        t.state = "REACQUIRING"
    elif t.score >= 3 and t.state == "ACQUIRING":
        t.state = "CONVERGING"
    return at, measured, t.offset, t.drift, math.sqrt(t.p00), status, t.state


def _run(t: Track, rows: pd.DataFrame) -> list[tuple]:
    return [step(t, *r) for r in zip(rows["at"], rows["measured"], rows["snr"]) if not any(x is None or math.isnan(x) for x in r)]


def tracks(rows: DataFrame, keys: list[str], order: str = "at") -> DataFrame:
    """Filtered rows of a table (keys, at in seconds, measured, snr): ties in time go by the measured value."""
    key_schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([order, "measured"])
        out = pd.DataFrame(_run(Track(), part), columns=["at", "measured", "offset", "drift", "sigma", "status", "state"])
        for i, (name, value) in enumerate(zip(keys, key)):
            out.insert(i, name, value)
        return out

    return rows.select(*keys, "at", "measured", "snr").groupBy(*keys).applyInPandas(run, f"{key_schema}, {OUT}")


def track_stream(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The same over a stream. Rows of a batch are put in order; rows older than the key's last one count as 0.1 minutes later."""
    key_schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t = Track(*state.get) if state.exists else Track()
        part = pd.concat(list(parts)).sort_values(["at", "measured"])
        out = pd.DataFrame(_run(t, part), columns=["at", "measured", "offset", "drift", "sigma", "status", "state"])
        state.update(astuple(t))
        for i, (name, value) in enumerate(zip(keys, key)):
            out.insert(i, name, value)
        yield out

    grouped = rows.select(*keys, "at", "measured", "snr").groupBy(*keys)
    return grouped.applyInPandasWithState(run, f"{key_schema}, {OUT}", TRACK, "append", GroupStateTimeout.NoTimeout)
