"""When users fall silent and come back, judged by their own habits: one fold of a user's times, for tables and for streams.

A user is absent once the silence is longer than 1.5 times their mean absence (four hours at first), at least an hour. A return ends the
absence, whose length enters the mean with a fifth. The stream holds arrivals until the watermark has passed them, so that their order in
time, not of arrival, decides; a timer at the end of the allowed silence tells of an absence while the user is still away. Replays and
restarts go on from the state in the checkpoint.

Rows: user_id, kind (absent or returned), since (last seen), at, duration_ms and level (of returns: short, long, very long) and mean_ms
(the mean absence after it). Times are in milliseconds; null users and times are left out; equal times count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Mean absence at first, and the least silence and multiples of the mean that count as short, long and very long.
HOUR = 3_600_000
FIRST_MEAN, SHORT, LONG, VERY_LONG = 4 * HOUR, (HOUR, 1.5), (24 * HOUR, 8), (72 * HOUR, 24)
KEEP = 0.8
SCHEMA = "user_id long, kind string, since long, at long, duration_ms long, level string, mean_ms double"
NAMES = [part.split(" ")[0] for part in SCHEMA.split(", ")]


class Record(NamedTuple):
    seen: int
    mean: float = 0.0
    total: int = 0
    absent: bool = False

    def silence(self, kind: tuple[int, float]) -> float:
        return max(kind[0], (self.mean or FIRST_MEAN) * kind[1])

    def until(self, now: int) -> tuple[Record, list[tuple]]:
        """The record at ``now`` without a word from the user, and what is told of it."""
        if self.absent or now - self.seen <= self.silence(SHORT):
            return self, []
        return self._replace(absent=True), [("absent", self.seen, self.seen + int(self.silence(SHORT)) + 1, None, None, self.mean)]

    def heard(self, now: int) -> tuple[Record, list[tuple]]:
        """The record after a word at ``now``, later than any before."""
        record, told = self.until(now)
        if not record.absent:
            return record._replace(seen=now), told
        gone = now - record.seen
        level = "very long" if gone > record.silence(VERY_LONG) else "long" if gone > record.silence(LONG) else "short"
        mean = float(gone) if record.total == 0 else record.mean * KEEP + gone * (1 - KEEP)
        return Record(now, mean, record.total + 1), [*told, ("returned", record.seen, now, gone, level, mean)]


def absences(events: DataFrame, until_ms: int) -> DataFrame:
    """All rows up to ``until_ms`` from a table of (user_id, ts): each user's times pass in order, one record is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, record = None, None
        out: list[tuple] = []
        for batch in batches:
            for who, ms in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if who != user:
                    if record is not None:
                        out += [(user, *t) for t in record.until(until_ms)[1]]
                    user, record = who, Record(ms)
                elif ms > record.seen:
                    record, told = record.heard(ms)
                    out += [(user, *t) for t in told]
            if out:
                yield _batch(out)
                out = []
        if record is not None:
            out += [(user, *t) for t in record.until(until_ms)[1]]
        if out:
            yield _batch(out)

    times = events.select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms")).where(f"user_id is not null and ms <= {until_ms}")
    return times.repartition("user_id").sortWithinPartitions("user_id", "ms").mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=NAMES)


class AbsenceProcessor(StatefulProcessor):
    """Arrivals wait in a list until a timer at their time; the same timer's later turn tells of an absence."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.record = handle.getValueState("record", "seen long, mean double, total long, absent boolean")
        self.waiting = handle.getListState("waiting", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = [(int(ms),) for part in rows for ms in part["ms"].dropna()]
        if times:
            self.waiting.appendList(times)
            for (ms,) in set(times):
                self.handle.registerTimer(ms)
        yield pd.DataFrame(columns=NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        held = sorted({ms for (ms,) in self.waiting.get()}) if self.waiting.exists() else []
        due, later = [ms for ms in held if ms <= now], [(ms,) for ms in held if ms > now]
        if due:
            self.waiting.put(later) if later else self.waiting.clear()
        record = Record(*self.record.get()) if self.record.exists() else None
        out: list[tuple] = []
        for ms in due:
            if record is None:
                record = Record(ms)
            elif ms > record.seen:
                record, told = record.heard(ms)
                out += told
        if record is not None:
            record, told = record.until(now)
            out += told
            self.record.update(tuple(record))
            if not record.absent and due:
                self.handle.registerTimer(record.seen + int(record.silence(SHORT)) + 1)
        yield pd.DataFrame([(key[0], *t) for t in out], columns=NAMES)

    def close(self) -> None:
        pass


def absence_stream(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """The rows of ``absences`` from a stream of (user_id, ts). Needs the RocksDB state store provider."""
    arrivals = events.where("user_id is not null and ts is not null").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    return arrivals.groupBy("user_id").transformWithStateInPandas(statefulProcessor=AbsenceProcessor(), outputStructType=SCHEMA, outputMode="Append", timeMode="EventTime")
