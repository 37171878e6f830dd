"""The conversation trie against a trie built turn by turn."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from palisade.llm import prefix_trie


def brute(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            turns[c].append((t is not None, t or 0, digest, role, text))
    own = {c: [(x[3], x[4]) for x in sorted(v)] for c, v in turns.items()}
    paths = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = own.get(c - c % 5, [])[:h] + mine[h:]
    nodes = defaultdict(lambda: {"in": [], "ends": []})
    for c, p in sorted(paths.items()):
        for d in range(len(p) + 1):
            nodes[tuple(p[:d])]["in"].append(c)
        nodes[tuple(p)]["ends"].append(c)
    kids = defaultdict(set)
    for p in nodes:
        if p:
            kids[p[:-1]].add(p)
    out = []
    below = {}
    for p in sorted(nodes, key=len, reverse=True):
        own_saved = (len(nodes[p]["in"]) - 1) * len(p[-1][1].encode()) if p else 0
        below[p] = (sum(below[k][0] for k in kids[p]) if kids[p] else 1, own_saved + sum(below[k][1] for k in kids[p]))
        out.append((min(nodes[p]["in"]), len(p), min(nodes[p[:-1]]["in"]) if p else None, len(nodes[p]["in"]), len(kids[p]), *below[p],
                    hashlib.sha256(",".join(map(str, nodes[p]["ends"])).encode()).hexdigest()))
    return sorted(map(str, out))


def found(df):
    assert df.columns == prefix_trie.COLUMNS
    return sorted(str(tuple(r)) for r in df.collect())


SCHEMA = "conv_id long, turn long, role string, text string"


def sample(seed):
    rnd = random.Random(seed)
    rows = []
    for c in range(260):
        if rnd.random() < 0.05:
            continue
        if c % 3 == 0:  # one conversation that a third of all repeat
            rows += [(c, t, "user", f"same {t}") for t in range(12)]
            continue
        n = rnd.choice([1, 1, 2, 3, 5, 9, 14])
        rows += [(c, t if rnd.random() < 0.9 else None, rnd.choice(["user", "assistant", None]), rnd.choice(["a", "b", "é", None, "", "a:b", "long " * 50])) for t in range(n)]
    rows += [(7, 3, "user", "tie"), (7, 3, "user", "tie"), (7, 3, "system", "tie"), (None, 0, "user", "no conversation"), (None, None, None, None)]
    rows += [(1001, t, "user", f"turn {t % 3}") for t in range(700)]  # deeper than a splitter's path
    rows += [(1002, t, "user", f"turn {t % 3}") for t in range(690)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("shards", [1, 2, 37, None])
def test_trie(spark, shards):
    rows = sample(shards or 0)
    frame = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], SCHEMA + ", size int, path string").repartition(5)
    assert found(prefix_trie.conversation_trie(frame, shards)) == brute(rows)


def test_chunks_and_thinned_skeleton(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 3)
    rows = sample(5)
    frame = spark.createDataFrame(rows, SCHEMA)
    assert found(prefix_trie.conversation_trie(frame, 23)) == brute(rows)
    places = [(bytes([i]) * 16 * (i + 1), i) for i in range(40)]
    thin = prefix_trie.Skeleton.of(places, 50)
    assert 1 < len(thin.parent) <= 50 and set(thin.splitters) < set(places)
    assert prefix_trie.Skeleton.of(places[-1:], 10).splitters == []


def test_nothing(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert prefix_trie.conversation_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).collect() == []
    only = prefix_trie.conversation_trie(spark.createDataFrame([(4, None, None, None)], SCHEMA)).collect()
    assert [r["n_convs"] for r in only if r["depth"] == 0] == [1]


def test_turnless(spark):
    """Conversation 1 has no turn of its own left (h = 4) and no conversation 0 to begin with."""
    rows = [(1, 0, "user", "x")]
    assert zlib.crc32(b"1") % 9 > 0
    assert found(prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    assert len(brute(rows)) == 1
