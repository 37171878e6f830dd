"""Keyed processors run shard by shard, so state is reached once an address and trigger and not once a row.

``Sharded`` wraps any ``RowProcessor``. Spark's grouping key is a hash of the address, of which there are
``SHARDS``; what the wrapped processor holds about an address is one entry of a map state, read before its rows and
written after them. Its timer is kept beside it, and the shard has a single timer of its own. The wrapped processor sees
the same rows and states as if every address were a group; its timers fire up to ``tick`` milliseconds later.

The number of shards is part of a stream's state: a stream that goes on must have the number it began with.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHARDS = 256
LONG = T.LongType()
NAME = T.StructType([T.StructField("name", T.StringType())])
BLOB = T.StructType([T.StructField("data", T.BinaryType())])
PIECE = T.StructType([T.StructField("at", LONG), T.StructField("part", LONG)])
TURN = T.StructType([T.StructField("part", LONG), T.StructField("armed", LONG)])


class _Value:
    """A value state of the address at hand."""

    def __init__(self, handle: "InnerHandle", name: str):
        self.handle, self.name = handle, name

    def exists(self) -> bool:
        return self.name in self.handle.held

    def get(self) -> tuple | None:
        return self.handle.held.get(self.name)

    def update(self, value: tuple) -> None:
        self.handle.held[self.name] = value

    def clear(self) -> None:
        self.handle.held.pop(self.name, None)


class _Map:
    """A map state of the address at hand."""

    def __init__(self, handle: "InnerHandle", name: str):
        self.handle, self.name = handle, name

    def _entries(self) -> dict:
        return self.handle.held.get(self.name, {})

    def keys(self) -> Iterator[tuple]:
        return iter(list(self._entries()))

    def iterator(self) -> Iterator[tuple[tuple, tuple]]:
        return iter(list(self._entries().items()))

    def containsKey(self, key: tuple) -> bool:
        return key in self._entries()

    def getValue(self, key: tuple) -> tuple | None:
        return self._entries().get(key)

    def updateValue(self, key: tuple, value: tuple) -> None:
        self.handle.held.setdefault(self.name, {})[key] = value

    def removeKey(self, key: tuple) -> None:
        entries = self._entries()
        entries.pop(key, None)
        if not entries:
            self.handle.held.pop(self.name, None)


class InnerHandle:
    """The handle that a wrapped processor sees: the states and the one timer of the address at hand."""

    def __init__(self):
        self.held, self.wanted = {}, None

    def getValueState(self, name: str, fields: T.StructType) -> _Value:
        return _Value(self, name)

    def getMapState(self, name: str, key: T.StructType, fields: T.StructType) -> _Map:
        return _Map(self, name)

    def listTimers(self) -> list:
        return [] if self.wanted is None else [self.wanted]

    def deleteTimer(self, at: int) -> None:
        self.wanted = None

    def registerTimer(self, at: int) -> None:
        self.wanted = at


def records(rows: Iterator[pd.DataFrame]) -> list:
    return [r for frame in rows for r in frame.itertuples(index=False)]


class RowProcessor(StatefulProcessor):
    """A processor on records instead of frames: ``on_rows`` and ``on_timer`` return the rows that they give as dicts."""

    def on_rows(self, key: tuple, rows: list, timerValues) -> list[dict]:
        raise NotImplementedError

    def on_timer(self, key: tuple, timerValues) -> list[dict]:
        return []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = self.on_rows(key, records(rows), timerValues)
        if out:
            yield pd.DataFrame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = self.on_timer(key, timerValues)
        if out:
            yield pd.DataFrame(out)

    def close(self) -> None:
        pass


class Sharded(StatefulProcessor):
    """Runs ``inner`` for every address (column ``key``) of a shard; see the module."""

    def __init__(self, inner: RowProcessor, key: str, tick: int = 1000):
        self.inner, self.key, self.tick = inner, key, tick

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getMapState("kept", NAME, BLOB)  # address: states, timer, tick under which it is in ``due``
        self.due = handle.getMapState("due", PIECE, BLOB)  # tick: addresses whose timer may be due
        self.turn = handle.getValueState("turn", TURN)  # pieces written so far, and the shard's timer
        self.seen = InnerHandle()
        self.inner.init(self.seen)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        part, armed = self._turn()
        filed: dict[int, list] = {}
        out = list(self._feed(records(rows), timerValues, filed))
        self._file(filed, part)
        self._arm([at * self.tick for at in filed], part + 1, armed)
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        part, _ = self._turn()
        yield from self._expire(timerValues.getCurrentWatermarkInMs(), timerValues, part)
        self._arm([int(p[0]) * self.tick for p in self.due.keys()], part + 1, 0)

    # -- the shard's own timer, 0 while there is none

    def _turn(self) -> tuple[int, int]:
        return tuple(map(int, self.turn.get())) if self.turn.exists() else (0, 0)

    def _arm(self, times: list[int], part: int, armed: int) -> None:
        first = min(times, default=0)
        if first and (not armed or first < armed):
            if armed:
                self.handle.deleteTimer(armed)
            self.handle.registerTimer(first)
            armed = first
        self.turn.update((part, armed))

    # -- what is held about an address

    def _feed(self, rows: list, now, filed: dict[int, list]) -> Iterator[pd.DataFrame]:
        """What ``inner`` gives for the rows of all addresses, as one frame."""
        by_name: dict[str | None, list] = {}
        for r in rows:
            name = getattr(r, self.key)
            by_name.setdefault(name if isinstance(name, str) else None, []).append(r)
        out = []
        for name, own in by_name.items():
            out += self._run(name, self._load(name), lambda: self.inner.on_rows((name,), own, now), filed)
        if out:
            yield pd.DataFrame(out)

    def _expire(self, passed: int, now, part: int) -> Iterator[pd.DataFrame]:
        """Fires the timers that the time ``passed`` has reached."""
        filed, out = {}, []
        for at, piece in sorted((int(p[0]), int(p[1])) for p in self.due.keys()):
            if at * self.tick > passed:
                break
            names = pickle.loads(self.due.getValue((at, piece))[0])
            self.due.removeKey((at, piece))
            for name in names:
                entry = self._load(name)
                if entry is None or entry[2] != at:
                    continue  # ended, or in ``due`` a second time
                held, wanted, _ = entry
                if wanted is None or wanted > passed:
                    out += self._run(name, (held, wanted, None), lambda: [], filed, passed)
                else:
                    out += self._run(name, (held, None, None), lambda: self.inner.on_timer((name,), now), filed, passed)
        self._file(filed, part)
        if out:
            yield pd.DataFrame(out)

    @staticmethod
    def _at(name: str | None) -> tuple[str]:
        return ("null" if name is None else "=" + name,)

    def _load(self, name: str | None) -> tuple | None:
        value = self.kept.getValue(self._at(name))
        return None if value is None else pickle.loads(value[0])

    def _run(self, name: str | None, entry: tuple | None, call: Callable, filed: dict[int, list], passed: int = 0) -> list[dict]:
        held, wanted, tick = entry or ({}, None, None)
        self.seen.held, self.seen.wanted = held, wanted
        out = call()
        wanted = self.seen.wanted
        if wanted is not None:
            due = -(-max(wanted, passed + 1) // self.tick)
            if tick is None or due < tick:  # a later one is found when the earlier tick comes
                tick = due
                filed.setdefault(due, []).append(name)
        if self.seen.held or wanted is not None:
            self.kept.updateValue(self._at(name), (pickle.dumps((self.seen.held, wanted, tick)),))
        elif entry is not None:
            self.kept.removeKey(self._at(name))
        return out

    def _file(self, filed: dict[int, list], part: int) -> None:
        for at, names in filed.items():
            self.due.updateValue((at, part), (pickle.dumps(names),))

    def close(self) -> None:
        self.inner.close()


def by_shard(rows: DataFrame, key: str, processor: Sharded, out: T.StructType, shards: int = SHARDS) -> DataFrame:
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(shards)))
    return dealt.groupBy("shard").transformWithStateInPandas(processor, out, "Append", "EventTime")


def sharded(rows: DataFrame, key: str, inner: RowProcessor, out: T.StructType) -> DataFrame:
    """``rows`` (with ``event_time`` under a watermark) through ``inner`` for every ``key``, a column of strings."""
    return by_shard(rows, key, Sharded(inner, key), out)
