"""As-of changes of arriving values as keyed state of the stream engine.

Every row asks for the value its key had `horizon` earlier. A row waits in the state of its key until
the watermark has passed it; by then all that could stand before it has arrived, so answers equal
those of the batch operator however late and shuffled rows come, as long as none is later than
`lateness`. A timer at the earliest waiting row answers without new input.

State of a key: the rows of the last `lateness`, the values of the last `horizon` before that, and
the one value that was valid when those begin. Rows of one key follow each other in time, so a key is
one group. Its waiting rows lie in the state in packed parts by hour and are answered hour by hour: a
worker holds `FLUSH` arriving rows, or one hour and one horizon of a key, however long the key waits.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from datetime import timedelta
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from harvestline.functions import numbers
from harvestline.sources.readers import with_instants

SAMPLE = ["at", "tie", "held"]
SPAN = 3_600_000_000    # microseconds of one packed part
FLUSH = 200_000         # arriving rows that are packed at once
ANSWERS = 50_000        # rows of one frame that goes out


def _order(sample: tuple) -> tuple:
    """Time, then tie; a missing tie stands first, as in Spark."""
    return sample[0], sample[1] is not None, sample[1]


class _Rows:
    """Times, ties and values side by side; ties are numbers or, with gaps or as text, Python values."""

    def __init__(self, at, tie, held):
        self.at, self.tie, self.held = at, tie, held

    @staticmethod
    def of(frame: pd.DataFrame) -> _Rows:
        tie = frame["tie"]
        return _Rows(frame["at"].to_numpy("int64"),
                     tie.to_numpy() if tie.dtype == np.int64 else np.array([*tie.tolist(), None], object)[:-1],
                     frame["held"].to_numpy("float64"))

    @staticmethod
    def unpacked(raw: bytes) -> _Rows:
        return _Rows(*pickle.loads(raw))

    def packed(self) -> bytes:
        return pickle.dumps((self.at, self.tie, self.held), 5)

    def __len__(self) -> int:
        return len(self.at)

    def __getitem__(self, rows) -> _Rows:
        return _Rows(self.at[rows], self.tie[rows], self.held[rows])

    def __add__(self, other: _Rows) -> _Rows:
        if not len(self):
            return other
        ties = (self.tie, other.tie)
        if ties[0].dtype != ties[1].dtype:
            ties = tuple(t.astype(object) for t in ties)
        return _Rows(np.concatenate([self.at, other.at]), np.concatenate(ties), np.concatenate([self.held, other.held]))

    def ordered(self) -> _Rows:
        if self.tie.dtype == object:
            places = sorted(range(len(self)), key=lambda i: _order((self.at[i], self.tie[i])))
            return self[np.array(places, np.int64)]
        return self[np.lexsort((self.tie, self.at))]


_NONE = _Rows(np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0))


class AsOf(StatefulProcessor):
    """Answers the rows of one key in time order from its retained history."""

    def __init__(self, horizon: int):
        self.horizon = horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "hour long, part long", "rows binary")
        # per hour that waits: its parts and its first instant
        self.hours = handle.getValueState("hours", "hours binary")
        self.past = handle.getValueState("past", "rows binary")
        self.due = handle.getValueState("due", "at long")

    def _store(self, arrived: list[_Rows], hours: dict[int, tuple[int, int]]) -> None:
        """Pack arrived rows by hour, behind the parts the hour has."""
        rows = reduce(_Rows.__add__, arrived, _NONE)
        hour = rows.at // SPAN
        order = np.argsort(hour, kind="stable")
        rows, hour = rows[order], hour[order]
        starts = np.flatnonzero(np.diff(hour, prepend=hour[:1] - 1))
        for begin, end in zip(starts, np.append(starts[1:], len(hour))):
            part, first = hours.get(at := int(hour[begin]), (0, None))
            here = rows[begin:end]
            self.waiting.updateValue((at, part), (here.packed(),))
            low = int(here.at.min())
            hours[at] = part + 1, low if first is None else min(low, first)

    def _taken(self, hour: int, parts: int) -> _Rows:
        held = _NONE
        for part in range(parts):
            held += _Rows.unpacked(bytes(self.waiting.getValue((hour, part))[0]))
            self.waiting.removeKey((hour, part))
        return held

    def _known_hours(self) -> dict[int, tuple[int, int]]:
        return pickle.loads(bytes(self.hours.get()[0])) if self.hours.exists() else {}

    def _wait(self, hours: dict[int, tuple[int, int]]) -> None:
        """Remember which hours wait, with one timer at the first instant of them."""
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
            self.due.clear()
        if not hours:
            self.hours.clear()
            return
        self.hours.update((pickle.dumps(hours, 5),))
        first = min(first for _, first in hours.values()) // 1000 + 1
        self.handle.registerTimer(first)
        self.due.update((first,))

    def _advance(self, key, hours: dict[int, tuple[int, int]], watermark_ms: int) -> Iterator[pd.DataFrame]:
        passed = watermark_ms * 1000
        due = sorted(hour for hour, (_, first) in hours.items() if first < passed)
        past = _Rows.unpacked(bytes(self.past.get()[0])) if due and self.past.exists() else _NONE
        for hour in due:
            rows = self._taken(hour, hours.pop(hour)[0])
            if (later := rows[rows.at >= passed]).at.size:
                self._store([later], hours)
            ready = rows[rows.at < passed].ordered()
            known = (past + ready).ordered()
            place = np.searchsorted(known.at, ready.at - self.horizon, side="right") - 1
            # later questions reach back to the end of the hour, or the watermark, less the horizon
            until = min(passed, (hour + 1) * SPAN) - self.horizon
            opening = int(np.searchsorted(known.at, until, side="right")) - 1
            past = known[max(opening, 0):]
            ref = np.where(place >= 0, known.held[np.maximum(place, 0)], np.nan)
            for begin in range(0, len(ready), ANSWERS):
                some = ready[begin:begin + ANSWERS]
                yield pd.DataFrame({
                    "key": pd.Series([key] * len(some), dtype="object"), "at": some.at,
                    "tie": pd.Series(some.tie.tolist(), dtype="object"), "held": some.held,
                    "ref": ref[begin:begin + ANSWERS]})
        if due:
            opening = int(np.searchsorted(past.at, passed - self.horizon, side="right")) - 1
            self.past.update((past[max(opening, 0):].packed(),))
        self._wait(hours)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        hours, arrived = self._known_hours(), []
        for frame in rows:
            arrived.append(_Rows.of(frame))
            if sum(map(len, arrived)) >= FLUSH:
                self._store(arrived, hours)
                arrived = []
        if arrived:
            self._store(arrived, hours)
        yield from self._advance(key[0], hours, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key[0], self._known_hours(), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def stream_asof_change(events: DataFrame, key: str, ts: str, value: str, horizon: timedelta, *,
                       lateness: str = "1 day", tie: str = "event_id", name: str = "ref_value") -> DataFrame:
    """(tie, key, ts, value, `name`, pct) of each arriving row, as `operators.asof.asof_change` gives it.

    A row comes out once the watermark (newest `ts` less `lateness`) has passed it. Rows without a
    time are left out, rows behind the watermark dropped. NULL is a key of its own; a NULL value is a
    value like any other, NaN counts as NULL. Values are doubles; of rows at one instant the one with
    the largest `tie` is valid.
    """
    shaped = with_instants(events).where(F.col(ts).isNotNull()).withWatermark(ts, lateness)
    kinds = {c: shaped.schema[c].dataType.simpleString() for c in (key, tie)}
    rows = shaped.select(ts, F.col(key).alias("key"), F.unix_micros(ts).alias("at"), F.col(tie).alias("tie"),
                         F.coalesce(F.col(value).cast("double"), F.lit(float("nan"))).alias("held"))
    answered = rows.groupBy("key").transformWithStateInPandas(
        AsOf(round(horizon / timedelta(microseconds=1))),
        f"key {kinds[key]}, at long, tie {kinds[tie]}, held double, ref double", "append", "eventTime")
    return answered.select(
        F.col("tie").alias(tie), F.col("key").alias(key), F.timestamp_micros("at").alias(ts), F.col("held").alias(value),
        F.col("ref").alias(name), numbers.pct_change(F.col("held"), F.col("ref")).alias("pct"))
