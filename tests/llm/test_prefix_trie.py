"""The trie against every prefix of every conversation, at several limits."""

from __future__ import annotations

import hashlib
import os
import random
import zlib

import duckdb
import pytest

from siftworks.llm import prefix_trie

DATA = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string, g string, path string, n int, depth string"


def plain(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            d = hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()
            convs.setdefault(c, []).append((turn is not None, turn or 0, d[:32], role or "", text or ""))
    turns = {c: [x[3:] for x in sorted(t)] for c, t in convs.items()}
    members = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        made = turns.get(c - c % 100, [])[:h] + own[h:]
        for d in range(len(made) + 1):
            members.setdefault(tuple(made[:d]), []).append((c, d == len(made)))
    out = []
    for k, m in members.items():
        below = [x for x in members if x[: len(k)] == k]
        parents = {x[:-1] for x in members if x}
        ends = ",".join(str(c) for c in sorted(c for c, e in m if e))
        out.append(
            (min(c for c, _ in m), len(k), min(c for c, _ in members[k[:-1]]) if k else None, len(m), sum(len(x) == len(k) + 1 for x in below), sum(x not in parents for x in below),
             sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x), hashlib.sha256(ends.encode()).hexdigest())
        )
    return sorted(out, key=str)


def found(spark, rows, limit=prefix_trie.LIMIT):
    frame = spark.createDataFrame([(*r, "g", "p", 1, "d") for r in rows], SCHEMA).repartition(3)
    got = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.conversations_of(frame)), limit)
    assert tuple(got.columns) == prefix_trie.COLUMNS
    return sorted((tuple(r) for r in got.collect()), key=str)


def family(n, seed, ids=lambda i: i):
    """Conversations that share turns of few words."""
    draw = random.Random(seed)
    return [(ids(i), t, draw.choice(["user", "bot"]) if t else "system", "ab "[: draw.randrange(1, 4)] if t > 1 else "hello") for i in range(n) for t in range(draw.randrange(0, 7))]


@pytest.mark.parametrize("limit", [prefix_trie.LIMIT, 40, 3])
def test_every_prefix(spark, limit):
    rows = family(120, 1) + family(80, 2, lambda i: 100 * i + 50)
    assert found(spark, rows, limit) == plain(rows)


def test_hot_paths(spark):
    """A third are one conversation, a third begin with the same long prefix."""
    rows = [(1000 + i, t, "u", f"same {t}") for i in range(40) for t in range(7)]
    rows += [(3000 + i, t, "u", f"prefix {t}" if t < 9 else f"own {i % 13} {t}") for i in range(40) for t in range(12)]
    rows += [(7000 + i, t, "u", f"{i} {t}") for i in range(20) for t in range(2)]
    want = plain(rows)
    assert found(spark, rows) == want
    assert found(spark, rows, 10) == want
    assert found(spark, rows, 1) == want


def test_pieces_of_many_ids(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 60)
    rows = [(i, 0, "u", "all the same") for i in [*range(-60, 0), *range(100, 400)]]
    assert found(spark, rows) == plain(rows)


def test_odd_rows(spark):
    rows = [(5, None, None, None), (5, 0, "", ""), (5, 0, "", ""), (5, 3, "a", "b"), (5, -1, "ab", ""), (100, 1, "user", "é中😀" * 3000), (101, 1, "user", "é中😀" * 3000), (None, 0, "user", "nobody's")]
    rows += [(-7, 0, "u", "x"), (2**62, 0, "u", "x"), (-(2**62), 5, "u", "x"), *((900, t, "u", str(t % 3)) for t in range(500)), *((901, t, "u", str(t % 3)) for t in range(500))]
    assert found(spark, rows, 50) == plain(rows)
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "u", "x")]) == []
    turnless = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    assert found(spark, [(turnless, 0, "u", "dropped")]) == plain([(turnless, 0, "u", "dropped")]) == [(turnless, 0, None, 1, 0, 1, 0, hashlib.sha256(str(turnless).encode()).hexdigest())]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
def test_sql(spark):
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{DATA}/conversations.parquet'")
    want = duckdb.sql(prefix_trie.OP13_SQL)
    got = prefix_trie.op13_prefix_trie(spark, DATA)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted((tuple(r[c] for c in want.columns) for r in got.collect()), key=str) == sorted(want.fetchall(), key=str)
