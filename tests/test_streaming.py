"""Streams over several triggers equal their batch operators; restarts, late rows and rule reload."""

import os
import random

import pytest
from pyspark.sql import functions as F

from palisade.operators import temporal
from palisade.operators.flows import flows
from palisade.streaming import jobs as J
from palisade.streaming import ordered as OR
from palisade.streaming import state as ST

EVENT = "request_id string, action string, timestamp double, t_us long"


def parts(spark, root, rows, schema, n):
    """Rows in time order, as n files written one after the other."""
    size = -(-len(rows) // n)
    for i in range(n):
        spark.createDataFrame(rows[i * size:(i + 1) * size], schema).coalesce(1).write.mode("append").parquet(str(root))
    return spark.read.parquet(str(root)).schema


def test_flow_stream_over_triggers(spark, tmp_path):
    rnd, rows, t = random.Random(4), [], 0
    for i in range(600):
        t += rnd.choice([100_000, 900_000, 2_000_000, 31_000_000 if i % 40 == 0 else 500_000])
        rows.append((i, f"h{rnd.randrange(3)}", t, rnd.randrange(1500), rnd.choice([16] * 20 + [17, 4]), rnd.choice(["fwd", "bwd"])))
    schema = "packet_id long, remote_ip string, t_us long, length long, flags int, direction string"
    want = flows(spark.createDataFrame(rows, schema))
    s = parts(spark, tmp_path / "in", rows + [(9999, "far", t + 10**10, 1, 0, "fwd")], schema, 6)
    got = J.run_to_table(ST.flow_stream(J.with_event_time(J.file_stream(spark, str(tmp_path / "in"), s, 1), delay="0 seconds")), "t-flows")
    show = lambda df: sorted(tuple(round(v, 3) if isinstance(v, float) else v for v in r) for r in df.select(*want.columns[:2], *[F.round(f"`{c}`", 3) for c in want.columns[3:]]).collect())
    assert show(got) == show(want) and len(show(want)) > 10


def test_correlation_stream_over_triggers(spark, tmp_path):
    rnd = random.Random(6)
    rows = sorted((rnd.randrange(200) * 1_000_000 + i, i, rnd.choice("ab"), rnd.choice(["network", "application"]), rnd.choice(["sqli", "xss", "portscan", "norm"]), 0.3) for i in range(400))
    schema = "t_us long, event_id long, ip string, layer string, type string, score double"
    s = parts(spark, tmp_path / "in", rows, schema, 5)
    got = J.run_to_table(ST.correlation_stream(J.with_event_time(J.file_stream(spark, str(tmp_path / "in"), s, 1))), "t-corr")
    want = temporal.correlate(spark.createDataFrame(rows, schema), cap=50)
    cols = ["event_id", "correlated", "multiplier", "amplified_score", "history_count"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))


def test_captcha_and_permanent_block(spark, tmp_path):
    ops = [("c", 1, "set", "pending", 0), ("c", 2, "get", None, 100), ("c", 3, "set", "solved", 200), ("c", 4, "get", None, 499), ("c", 5, "get", None, 500), ("d", 6, "get", None, 1)]
    rows = [(k, i, o, v, (t + 1000) * 1_000_000) for k, i, o, v, t in ops]  # time 0 would be late at the first watermark
    schema = "key string, event_id long, op string, value string, t_us long"
    s = parts(spark, tmp_path / "in", rows, schema, 1)
    source = lambda: J.with_event_time(J.file_stream(spark, str(tmp_path / "in"), s))
    got = {r["event_id"]: r["value"] for r in J.run_to_table(ST.ttl_stream(source(), 300), "t-ttl").collect()}
    assert got == {2: "pending", 4: "solved", 5: None, 6: None}
    forever = {r["event_id"]: r["value"] for r in J.run_to_table(ST.ttl_stream(source(), None), "t-perm").collect()}
    assert forever[5] == "solved"


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    rows = [("a", "ALLOW", 0.0, 10 * 60_000_000), ("b", "ALLOW", 0.0, 30 * 60_000_000), ("late", "BLOCK", 0.0, 60_000_000), ("far", "ALLOW", 0.0, 900 * 60_000_000)]
    s = parts(spark, tmp_path / "in", rows, EVENT, 4)
    stream = J.rpm_stream(J.with_event_time(J.file_stream(spark, str(tmp_path / "in"), s, 1), delay="60 seconds"))
    q = stream.writeStream.format("memory").queryName("late_rows").outputMode("append").option("checkpointLocation", str(tmp_path / "p")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["blocked"] for r in spark.sql("select * from late_rows").collect()) == [0, 0]
    assert J.late_rows(q) == 1


def test_event_sink_survives_restart(spark, tmp_path):
    rows = [(f"r{i % 40}", "ALLOW", float(i), i * 1_000_000) for i in range(100)]
    s = parts(spark, tmp_path / "in", rows, EVENT, 3)
    for progress in ("p1", "p1", "p2"):  # a plain restart, then a replay from the start
        J.event_sink(J.file_stream(spark, str(tmp_path / "in"), s, 1), str(tmp_path / "t"), str(tmp_path / progress), available_now=True).awaitTermination()
    ids = [r["request_id"] for r in spark.read.parquet(str(tmp_path / "t")).collect()]
    assert len(ids) == 40 == len(set(ids))


def test_event_sink_reads_the_days_of_a_batch_only(spark, tmp_path):
    from palisade.sources.sinks import append_dedup, read_table

    day = 86_400.0
    rows = [(f"r{i}", "ALLOW", i * day, i * 1_000_000) for i in range(5)] + [("odd", "ALLOW", None, 9_000_000)]
    s = parts(spark, tmp_path / "in", rows, EVENT, 3)
    for progress in ("p1", "p2"):
        J.event_sink(J.file_stream(spark, str(tmp_path / "in"), s, 1), str(tmp_path / "t"), str(tmp_path / progress), available_now=True).awaitTermination()
    table = spark.read.parquet(str(tmp_path / "t"))
    assert table.count() == 6 and {str(r["day"]) for r in table.collect()} == {*(f"1970-01-0{i}" for i in range(1, 6)), "none"}
    # A day's keys are hidden: were any other folder read, the row below would be taken for a repeat.
    moved = spark.createDataFrame([("r0", "ALLOW", 4 * day, 0, "1970-01-05"), ("r4", "ALLOW", 4 * day, 0, "1970-01-05")], EVENT + ", day string")
    append_dedup(moved, str(tmp_path / "t"), partition_by="day")
    assert read_table(spark, str(tmp_path / "t")).groupBy("request_id").count().where("count > 1").collect()[0]["request_id"] == "r0"


def test_newest_stream_is_bounded_and_survives_a_replay(spark, tmp_path):
    rows = [(i, (i * 37) % 101, None if i % 10 == 0 else "x") for i in range(90)]
    schema = "event_id long, ts_us long, note string"
    s = parts(spark, tmp_path / "in", rows, schema, 6)
    run = lambda p: J.newest_stream(J.file_stream(spark, str(tmp_path / "in"), s, 1), str(tmp_path / "t"), str(tmp_path / p), n=20, available_now=True).awaitTermination()
    want = sorted(rows, key=lambda r: (-r[1], -r[0]))[:20]
    read = lambda: sorted((tuple(r) for r in J.newest_of(spark, str(tmp_path / "t")).collect()), key=lambda r: (-r[1], -r[0]))
    run("p")
    assert read() == want and len([f for f in os.listdir(tmp_path / "t") if f.startswith("batch_id=")]) == 2
    run("p")  # nothing new
    assert read() == want
    late = [(1000, 10_000, "new"), (1001, -5, "old")]
    parts(spark, tmp_path / "in", late, schema, 1)
    run("p")
    assert read() == [late[0], *want[:19]]


def test_rules_are_reloaded(spark, tmp_path):
    req = "id int, method string, path string, body string, headers map<string,string>, query_params map<string,string>"
    rule = "rule_id string, pattern string, attack_type string, status string, created_us long"
    row = lambda i: (i, "GET", "/x", "harmless words", {}, {})
    s = parts(spark, tmp_path / "in", [row(1)], req, 1)
    spark.createDataFrame([("r0", "nothing here", "x", "active", 1)], rule).write.parquet(str(tmp_path / "rules"))
    run = lambda: J.score_stream(J.file_stream(spark, str(tmp_path / "in"), s, 1), str(tmp_path / "rules"), str(tmp_path / "out"), str(tmp_path / "p"), available_now=True).awaitTermination()
    run()
    spark.createDataFrame([("r1", "harm.*words", "x", "active", 2)], rule).write.mode("append").parquet(str(tmp_path / "rules"))
    parts(spark, tmp_path / "in", [row(2)], req, 1)
    run()
    got = {r["id"]: (r["decision"], r["rule_id"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: ("ALLOW", None), 2: ("MITIGATE", "r1")}
    assert spark.read.parquet(str(tmp_path / "out")).select("rules_version").distinct().count() == 2


class _Value:
    def __init__(self):
        self.v = None

    exists = lambda self: self.v is not None
    get = lambda self: self.v
    update = lambda self, v: setattr(self, "v", v)
    clear = lambda self: setattr(self, "v", None)


class _Handle:
    """Just enough of a state handle to feed a processor trigger by trigger."""

    def __init__(self):
        self.timers = []

    getValueState = lambda self, name, schema: _Value()
    listTimers = lambda self: list(self.timers)
    deleteTimer = lambda self, t: self.timers.remove(t)
    registerTimer = lambda self, t: self.timers.append(t)


def _fed(processor, triggers):
    import pandas as pd

    processor.init(_Handle())
    out = []
    for rows in triggers:
        for part in processor.handleInputRows(("k",), iter([pd.DataFrame(rows)]), None):
            out += part.to_dict("records")
    return out, processor.handle


def test_late_rows_do_not_set_state_back():
    """Two triggers, the second with a row that is older than the last of the first."""
    from palisade.streaming import state

    us = 1_000_000
    rate, handle = _fed(state.RateState(), [[{"event_id": 1, "t_us": 1000 * us}, {"event_id": 2, "t_us": 1010 * us}], [{"event_id": 3, "t_us": 1005 * us}, {"event_id": 4, "t_us": 1068 * us}]])
    assert [r["session_requests"] for r in rate] == [1, 2, 3, 4] and handle.timers == [(1068 * us + 60 * us) // 1000 + 1]
    ttl, _ = _fed(state.TtlState(60), [[{"event_id": 1, "t_us": 20 * us, "op": "set", "value": "new"}], [{"event_id": 2, "t_us": 10 * us, "op": "set", "value": "old"}, {"event_id": 3, "t_us": 30 * us, "op": "get", "value": None}]])
    assert [r["value"] for r in ttl] == ["new"]
    e = lambda i, t, layer, kind: {"event_id": i, "t_us": t * us, "layer": layer, "type": kind, "score": 0.5}
    corr, handle = _fed(state.CorrelationState(), [[e(1, 100, "network", "a"), e(2, 109, "network", "b")], [e(3, 104, "application", "c"), e(4, 110, "application", "d")]])
    # The late event sees what was before it only; the last one sees everything within its window, in any order of arrival.
    assert [r["history_count"] for r in corr] == [1, 2, 2, 4] and [r["correlated"] for r in corr] == [False, False, True, True]
    packet = lambda i, t: {"packet_id": i, "t_us": t * us, "direction": "fwd", "length": 10, "flags": 0}
    _, handle = _fed(state.FlowState(), [[packet(1, 100), packet(2, 110)], [packet(3, 95)]])
    assert handle.timers and all(t > 110 * 1000 for t in handle.timers)


def _arriving(spark, root, rows, schema, delay, n, seed=2):
    """Rows up to ``delay`` seconds late, as n files, and a last row far in the future."""
    rnd = random.Random(seed)
    at = schema.split(", ").index("t_us long")
    rows = [r for _, r in sorted((r[at] + rnd.randrange(delay * 1_000_000), r) for r in rows)]
    end = max(r[at] for r in rows) + 10**12
    return parts(spark, root, [*rows, tuple(end if i == at else "far" if isinstance(v, str) else v for i, v in enumerate(rows[0]))], schema, n)


def test_sliding_rates_in_any_order(spark, tmp_path):
    rnd = random.Random(9)
    rows = [(i, rnd.choice(["hot", "hot", "a", "b"]), rnd.choice([rnd.randrange(1, 300) * 1_000_000, 77_000_000, rnd.randrange(1, 400_000_000)])) for i in range(900)]
    schema = "event_id long, ip string, t_us long"
    s = _arriving(spark, tmp_path / "in", rows, schema, 90, 5)
    stream = J.with_event_time(J.file_stream(spark, str(tmp_path / "in"), s, 1), delay="90 seconds")
    got = J.run_to_table(OR.sliding_rates_in_order(stream, limit=50), "t-sliding")
    want = temporal.sliding_count(spark.createDataFrame(rows, schema), limit=50)
    cols = ["event_id", "ip", "request_count", "rate_limited"]
    want = sorted(map(tuple, want.select(*cols).collect()))
    assert any(r[3] for r in want) and sorted(map(tuple, got.select(*cols).collect())) == want


def test_kinds_with_their_own_life(spark, tmp_path):
    s = 1_000_000
    ops = [("a", 1, "block", 10 * s), ("a", 2, "get", 20 * s), ("a", 3, "get", 3611 * s), ("a", 4, "block_permanent", 4000 * s), ("a", 5, "block", 4001 * s), ("a", 6, "get", 9000 * s),
           ("a", 7, "unblock", 9001 * s), ("a", 8, "get", 9002 * s), ("b", 9, "solve", 5 * s), ("b", 10, "captcha", 6 * s), ("b", 11, "get", 305 * s), ("b", 12, "solve", 305 * s + 1),
           ("b", 13, "get", 604 * s), ("b", 14, "get", 605 * s + 1), ("b", 15, "captcha", 700 * s), ("b", 16, "solve", 1000 * s), ("b", 17, "get", 1000 * s)]
    schema = "key string, event_id long, op string, t_us long"
    _arriving(spark, tmp_path / "in", ops, schema, 60, 4)
    frame = spark.read.parquet(str(tmp_path / "in")).schema
    stream = J.with_event_time(J.file_stream(spark, str(tmp_path / "in"), frame, 1), delay="60 seconds")
    got = {r["event_id"]: (r["blocked"], r["captcha"]) for r in J.run_to_table(OR.access_in_order(stream), "t-access").collect()}
    assert got == {2: (True, None), 3: (False, None), 6: (True, None), 8: (False, None), 11: (False, "pending"), 13: (False, "solved"), 14: (False, None), 17: (False, None)}


class _Counted:
    """State of one group in memory that counts what would go to the state store."""

    calls = 0

    def __init__(self):
        self.v, self.entries, self.timers = None, {}, set()

    def _say(self, value=None):
        _Counted.calls += 1
        return value

    getValueState = lambda self, name, fields: _Counted()
    getMapState = lambda self, name, key, fields: _Counted()
    registerTimer = lambda self, at: self._say(self.timers.add(at))
    deleteTimer = lambda self, at: self._say(self.timers.discard(at))
    exists = lambda self: self._say(self.v is not None)
    get = lambda self: self._say(self.v)
    update = lambda self, v: self._say(setattr(self, "v", v))
    keys = lambda self: self._say(iter(list(self.entries)))
    getValue = lambda self, k: self._say(self.entries.get(k))
    updateValue = lambda self, k, v: self._say(self.entries.update({k: v}))
    removeKey = lambda self, k: self._say(self.entries.pop(k))


class _At:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_state_is_reached_once_an_address_and_trigger():
    """Many rows of some addresses in one shard: few state calls, right counts, and nothing left behind."""
    import pandas as pd
    from pyspark.sql import types as T

    rnd = random.Random(3)
    rows = [(i, rnd.choice([None, *"abcdefghi"]), rnd.randrange(1, 400_000_000)) for i in range(4000)]
    fields = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ip", T.StringType()), T.StructField("t_us", T.LongType())])
    shard, handle, got = OR.InOrder(OR.SlidingState(limit=50), "ip", fields), _Counted(), []
    shard.init(handle)
    _Counted.calls = 0

    def passed(ms):
        due = sorted(t for t in handle.timers if t <= ms)
        for t in due:
            for frame in shard.handleExpiredTimer((0,), _At(ms), None):
                got.extend(frame.to_dict("records"))
            handle.timers.discard(t)

    for i in range(4):
        part = [r for r in rows if r[2] // 100_000_000 == i]
        rnd.shuffle(part)
        list(shard.handleInputRows((0,), iter([pd.DataFrame(part, columns=fields.names)]), _At(i * 100_000)))
        passed((i + 1) * 100_000)
    assert _Counted.calls < len(rows) / 4
    while handle.timers:
        passed(min(handle.timers))
    want = {r[0]: sum(1 for o in rows if o[1] == r[1] and r[2] - 60_000_000 < o[2] <= r[2]) for r in rows}
    assert {r["event_id"]: r["session_requests"] for r in got} == want and len(got) == len(rows)
    assert not any(s.entries for s in (shard.rows, shard.kept, shard.due))


def test_shard_of_set_rows_only_gives_nothing_and_keeps_the_value():
    import pandas as pd
    from palisade.streaming.shards import Sharded

    shard, handle = Sharded(ST.TtlState(60), "key"), _Counted()
    shard.init(handle)
    feed = lambda *rows: [r for f in shard.handleInputRows((0,), iter([pd.DataFrame(rows, columns=["key", "event_id", "op", "value", "t_us"])]), _At(0)) for r in f.to_dict("records")]
    assert feed(("a", 1, "set", "x", 10_000_000), (None, 2, "set", "y", 11_000_000)) == []
    assert [(r["event_id"], r["value"]) for r in feed(("a", 3, "get", None, 20_000_000), (None, 4, "get", None, 71_000_000), ("b", 5, "get", None, 1))] == [(3, "x"), (4, None), (5, None)]
    while handle.timers:
        t = min(handle.timers)
        assert not list(shard.handleExpiredTimer((0,), _At(t), None))
        handle.timers.discard(t)
    assert not shard.kept.entries and not shard.due.entries


def test_a_trigger_of_one_file_is_scored_by_many_tasks(spark, tmp_path):
    req = "id int, method string, path string, body string, headers map<string,string>, query_params map<string,string>"
    s = parts(spark, tmp_path / "in", [(i, "GET", "/x", "harmless words", {}, {}) for i in range(64)], req, 1)
    spark.createDataFrame([], "rule_id string, pattern string, attack_type string, status string, created_us long").write.parquet(str(tmp_path / "rules"))
    J.score_stream(J.file_stream(spark, str(tmp_path / "in"), s, 1), str(tmp_path / "rules"), str(tmp_path / "out"), str(tmp_path / "p"), available_now=True).awaitTermination()
    assert sum(f.endswith(".parquet") for f in os.listdir(tmp_path / "out" / "batch_id=0")) >= 8
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(64))
