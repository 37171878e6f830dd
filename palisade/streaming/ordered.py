"""Order-exact keyed state: rows are held back and fed in event-time order once the watermark has passed them.

``InOrder`` wraps any processor of ``palisade.streaming.state`` or of this module, a shard of addresses at a time (see
``palisade.streaming.shards``). Rows that come go to a map state of the shard, one entry for every trigger and ``chunk``
seconds of event time. A timer at the end of the oldest chunk feeds all chunks that the watermark has passed, oldest
first and in bounded numbers, to the wrapped processor, which so never sees a late row; its own timers are kept
beside its state and fire once the rows are fed. Whatever order
rows arrive in within the watermark's delay, the result is the batch operator's, row for row. The price is the delay:
a row's result comes when the watermark passes its chunk.

Null event times are never passed by a watermark, and times up to the epoch's first instant are behind the watermark
that a stream starts with: Spark drops such rows as late.
"""

from __future__ import annotations

import pickle
import sys
from collections import namedtuple
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessorHandle

from palisade import constants as K
from palisade.operators.scale import US
from palisade.streaming import state as ST
from palisade.streaming.shards import BLOB, PIECE, RowProcessor, Sharded, by_shard
from palisade.streaming.state import LONG, RATE_OUT, STR, in_time, schema

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows from which on no further chunk joins a frame.
MOST_ROWS = 50_000


class _Fed:
    """The time up to which a wrapped processor has seen all rows."""

    def __init__(self, ms: int):
        self.ms = ms

    def getCurrentWatermarkInMs(self) -> int:
        return self.ms


class InOrder(Sharded):
    """Feeds ``inner`` the columns ``fields`` of the rows, in event-time order (``t_us``), whole chunks at a time."""

    def __init__(self, inner: RowProcessor, key: str, fields: T.StructType, chunk: int = 10):
        super().__init__(inner, key, chunk * 1000)
        self.fields = fields

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getMapState("rows", PIECE, BLOB)
        super().init(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        part, armed = self._turn()
        touched = set()
        for frame in rows:  # one Arrow batch at a time
            for chunk, piece in frame.groupby(frame["t_us"] // 1000 // self.tick):
                columns = [self._plain(piece[f.name], f.dataType) for f in self.fields]
                self.rows.updateValue((int(chunk), part), (pickle.dumps(columns),))
                touched.add(int(chunk))
            part += 1
        self._arm([(chunk + 1) * self.tick for chunk in touched], part, armed)
        return iter([])

    @staticmethod
    def _plain(column: pd.Series, kind: T.DataType) -> list:
        """Values as the state takes them: pandas turns nulls of numbers into NaN."""
        values = [None if v is None or v != v else v for v in column.tolist()]
        return [None if v is None else int(v) for v in values] if isinstance(kind, (T.LongType, T.IntegerType)) else values

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # Rows behind the watermark but in a chunk that it hasn't passed are still to be fed.
        passed = timerValues.getCurrentWatermarkInMs() // self.tick * self.tick
        part, _ = self._turn()
        pieces = sorted((int(p[0]), int(p[1])) for p in self.rows.keys())
        ready = [p for p in pieces if (p[0] + 1) * self.tick <= passed]
        for held in self._held(ready):
            filed: dict[int, list] = {}
            yield from self._feed(held, _Fed(passed), filed)
            self._file(filed, part)
            part += 1
        yield from self._expire(passed, _Fed(passed), part)
        waiting = [(p[0] + 1) * self.tick for p in pieces[len(ready):]]
        self._arm(waiting + [int(p[0]) * self.tick for p in self.due.keys()], part + 1, 0)

    def _held(self, pieces: list[tuple[int, int]]) -> Iterator[list]:
        """The rows of whole chunks, oldest first; a chunk that brings a list to ``MOST_ROWS`` is its last."""
        row = namedtuple("Row", self.fields.names, rename=True)
        held: list = []
        for i, piece in enumerate(pieces):
            held += map(row, *pickle.loads(self.rows.getValue(piece)[0]))
            self.rows.removeKey(piece)
            if i + 1 == len(pieces) or (pieces[i + 1][0] != piece[0] and len(held) >= MOST_ROWS):
                yield held
                held = []


def in_order(rows: DataFrame, key: str, inner: RowProcessor, out: T.StructType, chunk: int = 10) -> DataFrame:
    """``rows`` (with ``t_us`` and ``event_time`` under a watermark) through ``inner``, in order for every ``key``."""
    fields = T.StructType([f for f in rows.schema if f.name != "event_time"])
    return by_shard(rows, key, InOrder(inner, key, fields, chunk), out)


# -- requests of the last seconds --------------------------------------------------------------------------

INSTANTS = schema(t=T.ArrayType(LONG), n=T.ArrayType(LONG))
TOTAL = schema(n=LONG)


class SlidingState(RowProcessor):
    """Requests of the last ``seconds``, peers of one instant included: a ring of one-second entries and a running total.

    Rows must come in order. An entry holds the instants of its second and how many requests each had; instants that
    leave the window are taken off the total, and entries without any go. A silent key's ring is removed by a timer.
    """

    def __init__(self, limit: int = K.RATE_LIMIT_SLIDING, seconds: int = K.TTL_RATE):
        self.limit, self.span = limit, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getMapState("ring", schema(second=LONG), INSTANTS)
        self.total = handle.getValueState("total", TOTAL)

    def on_rows(self, key, rows, timerValues) -> list[dict]:
        ring = {int(s[0]): None for s in self.ring.keys()}  # read when needed
        total = self.total.get()[0] if self.total.exists() else 0
        changed, out = set(), []

        def entry(second: int) -> list[list[int]]:
            if ring.get(second) is None:
                ring[second] = [list(c) for c in self.ring.getValue((second,))] if second in ring else [[], []]
            return ring[second]

        for t, peers in groupby(in_time(rows, "event_id"), key=lambda e: int(e.t_us)):
            peers = list(peers)
            for second in sorted(s for s in ring if s * 1_000_000 <= t - self.span):
                instants, counts = entry(second)
                gone = sum(1 for x in instants if x <= t - self.span)
                total -= sum(counts[:gone])
                ring[second] = [instants[gone:], counts[gone:]]
                changed.add(second)
                if gone == len(instants):
                    del ring[second]
            second = t // 1_000_000
            instants, counts = entry(second)
            instants.append(t)
            counts.append(len(peers))
            changed.add(second)
            total += len(peers)
            out += [{"event_id": int(e.event_id), "ip": key[0], "session_requests": total, "rate_limited": total > self.limit} for e in peers]
            last = t
        for second in changed:
            if second in ring:
                self.ring.updateValue((second,), tuple(ring[second]))
            elif self.ring.containsKey((second,)):
                self.ring.removeKey((second,))
        self.total.update((total,))
        self.handle.registerTimer((last + self.span) // 1000 + 1)
        return out

    def on_timer(self, key, timerValues) -> list[dict]:
        for second in list(self.ring.keys()):
            self.ring.removeKey((int(second[0]),))
        self.total.clear()
        return []


# -- blocks and challenges ----------------------------------------------------------------------------------

BLOCK, CAPTCHA = "block", "captcha"
ACCESS_OUT = schema(event_id=LONG, key=STR, blocked=T.BooleanType(), captcha=STR)


class AccessState(RowProcessor):
    """What is held about an address, each kind with a life time of its own, in one map state.

    ``block`` lasts ``block_ttl`` seconds, ``block_permanent`` until ``unblock``; ``captcha`` is pending for
    ``captcha_ttl`` seconds and ``solve`` turns a pending one into a solved one with a new life. ``get`` reads both. Rows
    must come in order; those of one instant take effect in the order of their event_id, reads last.
    """

    def __init__(self, block_ttl: int = K.TTL_BLACKLIST, captcha_ttl: int = K.TTL_CAPTCHA):
        self.block_us, self.captcha_us = block_ttl * 1_000_000, captcha_ttl * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kinds = handle.getMapState("kinds", schema(kind=STR), schema(value=STR, until=LONG))

    def on_rows(self, key, rows, timerValues) -> list[dict]:
        before = {k[0]: tuple(v) for k, v in self.kinds.iterator()}
        held, out = dict(before), []
        for e in sorted(rows, key=lambda e: (e.t_us, e.op == "get", e.event_id)):
            t = int(e.t_us)
            live = {k: v for k, v in held.items() if v[1] is None or t < v[1]}
            if e.op == "get":
                out.append({"event_id": int(e.event_id), "key": key[0], "blocked": BLOCK in live, "captcha": live[CAPTCHA][0] if CAPTCHA in live else None})
            elif e.op == "unblock":
                held.pop(BLOCK, None)
            elif e.op == "block_permanent":
                held[BLOCK] = ("permanent", None)
            elif e.op == "block":
                if live.get(BLOCK, ("", 0))[1] is not None:  # a permanent block stays one
                    held[BLOCK] = ("temporary", t + self.block_us)
            elif e.op == "captcha":
                held[CAPTCHA] = ("pending", t + self.captcha_us)
            elif e.op == "solve" and live.get(CAPTCHA, ("",))[0] == "pending":
                held[CAPTCHA] = ("solved", t + self.captcha_us)
        for kind in before.keys() - held.keys():
            self.kinds.removeKey((kind,))
        for kind, value in held.items():
            if before.get(kind) != value:
                self.kinds.updateValue((kind,), value)
        ends = [v[1] for v in held.values() if v[1] is not None]
        if ends:
            self.handle.registerTimer(min(ends) // 1000 + 1)
        return out

    def on_timer(self, key, timerValues) -> list[dict]:
        passed, later = timerValues.getCurrentWatermarkInMs(), []
        for kind, value in [(k[0], tuple(v)) for k, v in self.kinds.iterator()]:
            if value[1] is not None and value[1] // 1000 < passed:
                self.kinds.removeKey((kind,))
            elif value[1] is not None:
                later.append(value[1])
        if later:
            self.handle.registerTimer(min(later) // 1000 + 1)
        return []


# -- streams that equal their batch operators in any order of arrival ----------------------------------------

def flows_in_order(packets: DataFrame, **kw) -> DataFrame:
    return in_order(packets, "remote_ip", ST.FlowState(**kw), ST.FLOW_OUT)


def session_rates_in_order(requests: DataFrame, **kw) -> DataFrame:
    return in_order(requests, "ip", ST.RateState(**kw), RATE_OUT)


def sliding_rates_in_order(requests: DataFrame, **kw) -> DataFrame:
    """Columns of ``sliding_count``: event_id, ip, request_count, rate_limited."""
    return in_order(requests, "ip", SlidingState(**kw), RATE_OUT).withColumnRenamed("session_requests", "request_count")


def correlation_in_order(events: DataFrame, **kw) -> DataFrame:
    return in_order(events, "ip", ST.CorrelationState(**kw), ST.CORRELATION_OUT)


def access_in_order(ops: DataFrame, **kw) -> DataFrame:
    """``ops``: key, event_id, op (block, block_permanent, unblock, captcha, solve, get), t_us, event_time."""
    return in_order(ops, "key", AccessState(**kw), ACCESS_OUT)
