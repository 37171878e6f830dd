"""Packets to flows: the golden flow and brute force on a flood."""

import random

import pytest

from palisade.operators.flows import assign_flows, flows

PKT = "packet_id long, remote_ip string, t_us long, length long, flags int, direction string"


def frame(spark, rows):
    return spark.createDataFrame(rows, PKT)


def test_golden_flow(spark):
    data = [(1000.00, 66, "fwd", 0x02), (1000.01, 66, "bwd", 0x12), (1000.02, 54, "fwd", 0x10), (1000.10, 500, "fwd", 0x18), (1000.15, 1400, "bwd", 0x10),
            (1000.20, 500, "fwd", 0x18), (1000.25, 1400, "bwd", 0x10), (1001.50, 200, "fwd", 0x18), (1001.55, 800, "bwd", 0x10), (1001.60, 54, "fwd", 0x11)]
    rows = [(i, "10.0.0.1", round(t * 1e6), n, f, d) for i, (t, n, d, f) in enumerate(data)]
    (r,) = flows(frame(spark, rows)).collect()
    assert abs(r["flow duration"] - 1_600_000) < 1
    assert (r["total fwd packets"], r["total backward packets"], r["psh flag count"]) == (6, 4, 3)
    assert r["syn flag count"] >= 1 and r["ack flag count"] >= 6
    assert abs(r["idle mean"] - 1_250_000) < 1 and r["idle std"] == 0


def brute(rows, idle=30_000_000, age=120_000_000):
    """Fold packet by packet; returns packet -> first packet time of its flow, with a flow number."""
    out, state = {}, {}
    for pid, ip, t, _, flags, _ in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        s = state.get(ip)
        if s is None or s["closed"] or t - s["last"] > idle or t - s["start"] > age:
            s = {"start": t, "no": (s["no"] + 1) if s else 0, "closed": False, "last": t}
            state[ip] = s
        s["last"], s["closed"] = t, bool(flags & 5)
        out[pid] = (ip, s["no"], s["start"])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_fold(spark, seed):
    rnd = random.Random(seed)
    rows, t = [], 0
    for i in range(900):  # one address floods without a pause for 40 minutes and longer
        t += rnd.choice([200_000, 1_000_000, 7_000_000, 29_000_000, 30_000_000])
        rows.append((i, "hot", t, rnd.randrange(1500), 16, "fwd"))
    for i in range(900, 1500):
        rows.append((i, f"h{rnd.randrange(9)}", rnd.randrange(1200) * 500_000, 60, rnd.choice([16, 16, 16, 24, 17, 4]), rnd.choice(["fwd", "bwd"])))
    want = brute(rows)
    got = {r["packet_id"]: r for r in assign_flows(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert all(got[p]["flow_us"] == want[p][2] for p in want)
    groups_got, groups_want = {}, {}
    for p in want:
        groups_want.setdefault(want[p][:2], set()).add(p)
        g = got[p]
        groups_got.setdefault((g["remote_ip"], g["session_packet"], g["flow_us"]), set()).add(p)
    assert sorted(map(sorted, groups_got.values())) == sorted(map(sorted, groups_want.values()))


def test_short_flows_dropped(spark):
    rows = [(i, "a", i * 1_000_000, 10, 16, "fwd") for i in range(3)] + [(10 + i, "b", i * 1_000_000, 10, 16, "bwd") for i in range(4)]
    out = flows(frame(spark, rows)).collect()
    assert [r["remote_ip"] for r in out] == ["b"]
    assert out[0]["fwd packet length mean"] == 0.0
