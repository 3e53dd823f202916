"""Packets back in order: wrapping counters, late and doubled packets, gaps and restarts, over tables and over streams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tidewright.functions.timing import counter_delta
from tidewright.operators import blocks

OUT = "session long, place long, sequence long, timestamp long, gap_packets long, gap_samples long"


def _signed(n: int, bits: int) -> int:
    half = 1 << (bits - 1)
    return (n + half) % (1 << bits) - half


@dataclass
class Line:
    """What a stream waits for: its session, the place, number and time of the next packet, and those held that came too early, by number."""

    session: int = -1
    place: int = 0
    sequence: int = 0
    timestamp: int = 0
    held: dict[int, tuple[int, object]] = field(default_factory=dict)

    def _give(self, sequence: int, samples: int, most_gap: int) -> tuple:
        timestamp, payload = self.held.pop(sequence)
        ahead = _signed(sequence - self.sequence, 16)
        place = self.place + ahead
        gap = min(max(_signed(timestamp - self.timestamp, 32), 0), most_gap)
        self.place, self.sequence, self.timestamp = place + 1, (sequence + 1) & 0xFFFF, (timestamp + samples) & 0xFFFFFFFF
        return self.session, place, sequence, timestamp, ahead, gap, payload

    def drained(self, samples: int, most_gap: int, keep: int = 0) -> list[tuple]:
        """The packets that may go: those next in order, and with more than ``keep`` held those after a gap, nearest first."""
        out = []
        while self.held:
            if self.sequence in self.held:
                out.append(self._give(self.sequence, samples, most_gap))
            elif len(self.held) > keep:
                out.append(self._give(min(self.held, key=lambda s: _signed(s - self.sequence, 16)), samples, most_gap))
            else:
                break
        return out

    def push(self, sequence: int, timestamp: int, payload: object, samples: int, buffer: int, restart: int) -> list[tuple]:
        """What may go once this packet has come.

        A time over ``restart`` samples from the expected one starts a session: what is
        held goes first. A packet behind what has gone, or held already, is left out.
        A number that is missing is waited for until half of ``buffer`` packets are held.
        """
        out = []
        if self.session < 0 or abs(_signed(timestamp - self.timestamp, 32)) > restart:
            out = self.drained(samples, restart)
            self.session, self.place, self.sequence, self.timestamp = self.session + 1, 0, sequence, timestamp
        if _signed(sequence - self.sequence, 16) >= 0 and sequence not in self.held:
            self.held[sequence] = (timestamp, payload)
        return out + self.drained(samples, restart, max(0, buffer // 2 - 1))


class Resequencer(StatefulProcessor):
    """Keeps a stream's ``Line``: one value and a list of at most half of ``buffer`` packets. After ``patience_ms`` without a packet what is held goes."""

    def __init__(self, kinds: StructType, keys: list[str], columns: tuple[str, str, str, str], samples: int, buffer: int, restart: int, patience_ms: int | None):
        self.kinds, self.keys, self.columns = kinds, keys, columns
        self.samples, self.buffer, self.restart, self.patience_ms = samples, buffer, restart, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.line = handle.getValueState("line", "session long, place long, sequence long, timestamp long")
        self.held = handle.getListState("held", StructType().add("sequence", "long").add("timestamp", "long").add("payload", self.kinds[self.columns[3]].dataType))

    def _load(self) -> Line:
        if not self.line.exists():
            return Line()
        return Line(*self.line.get(), {s: (t, p) for s, t, p in self.held.get()} if self.held.exists() else {})

    def _rows(self, key: tuple, line: Line, out: list[tuple]) -> Iterator[pd.DataFrame]:
        self.line.update((line.session, line.place, line.sequence, line.timestamp))
        if line.held:
            self.held.put([(s, t, p) for s, (t, p) in line.held.items()])
        elif self.held.exists():
            self.held.clear()
        for timer in list(self.handle.listTimers()) if self.patience_ms is not None else ():
            self.handle.deleteTimer(timer)
        if out:
            rows = pd.DataFrame(out, columns=["session", "place", "sequence", "timestamp", "gap_packets", "gap_samples", self.columns[3]])
            for i, (name, value) in enumerate(zip(self.keys, key)):
                rows.insert(i, name, value)
            yield rows

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrival, sequence, timestamp, payload = self.columns
        line, out = self._load(), []
        batch = pd.concat(list(rows)).sort_values(arrival, kind="stable")
        for s, t, p in zip(batch[sequence].tolist(), batch[timestamp].tolist(), batch[payload].tolist()):
            out += line.push(s, t, p, self.samples, self.buffer, self.restart)
        yield from self._rows(key, line, out)
        if line.held and self.patience_ms is not None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        line = self._load()
        yield from self._rows(key, line, line.drained(self.samples, self.restart))


def resequenced_stream(packets: DataFrame, keys: list[str], arrival: str, sequence: str, timestamp: str, payload: str, samples: int = 400, buffer: int = 64, restart: int = 200_000, patience_ms: int | None = 10_000) -> DataFrame:
    """A stream's packets in order by key, with session, place and the gap before each. Needs the RocksDB state store.

    A batch's packets are taken in order of ``arrival``. State for a key is bounded by
    half of ``buffer`` packets. Without ``patience_ms`` there are no timers, and what is
    held waits for the next packet.
    """
    kinds = packets.schema
    schema = StructType([kinds[k] for k in keys])
    for part in OUT.split(", "):
        schema.add(*part.split())
    schema.add(payload, kinds[payload].dataType)
    maker = Resequencer(kinds, keys, (arrival, sequence, timestamp, payload), samples, buffer, restart, patience_ms)
    grouped = packets.select(*keys, arrival, F.col(sequence).cast("long"), F.col(timestamp).cast("long"), payload).groupBy(*keys)
    return grouped.transformWithStateInPandas(maker, schema, "append", "None" if patience_ms is None else "ProcessingTime")


def resequenced(packets: DataFrame, keys: list[str], arrival: list[str], block: Column, sequence: str, timestamp: str, samples: int = 400, restart: int = 200_000, places: int = 65_536) -> DataFrame:
    """The same for a table, with windows alone: all columns, and session, place, gap_packets and gap_samples.

    ``block`` grows with ``arrival`` and cuts it into parts that a task can hold, of
    any size. Numbers unwrap along the arrivals; a session starts where the time moves by over
    ``restart`` samples from the arrival before. Of packets with the same place the first
    to come stays; those before the session's first arrival are late and left out.
    This is the stream's result where no packet comes later than the stream waits.
    """
    before = blocks.with_previous(packets, keys, arrival, block, [sequence, timestamp], "_came")
    new = F.col("_came").isNull() | (F.abs(counter_delta(F.col(timestamp), F.col(f"_came.{timestamp}"), 32)) > restart)
    step = F.when(new, 0).otherwise(counter_delta(F.col(sequence), F.col(f"_came.{sequence}"), 16))
    told = before.withColumns({"_new": new.cast("long"), "_step": step.cast("long")}).drop("_came")
    told = blocks.with_running(told, keys, arrival, block, F.col("_new"), "session")
    told = blocks.with_running(told, keys, arrival, block, F.col("_step"), "_at").withColumn("session", F.col("session") - 1)
    starts = told.where("_new = 1").select(*keys, "session", F.col("_at").alias("_zero"))
    placed = told.join(starts, [*keys, "session"]).withColumn("place", F.col("_at") - F.col("_zero")).where("place >= 0").drop("_new", "_step", "_at", "_zero")
    rest = [c for c in placed.columns if c not in (*keys, "session", "place")]
    first = placed.groupBy(*keys, "session", "place").agg(F.min_by(F.struct(*rest), F.struct(*arrival)).alias("_row")).select(*keys, "session", "place", "_row.*")
    out = blocks.with_previous(first, [*keys, "session"], ["place"], F.floor(F.col("place") / places), ["place", timestamp], "_last")
    gap = F.least(F.greatest(counter_delta(F.col(timestamp), F.col(f"_last.{timestamp}") + samples, 32), F.lit(0)), F.lit(restart))
    return out.withColumns({"gap_packets": F.coalesce(F.col("place") - F.col("_last.place") - 1, F.lit(0)), "gap_samples": F.coalesce(gap, F.lit(0)).cast("long")}).drop("_last")
