"""Drake's bounds against plain rounds over all centroids."""

from __future__ import annotations

import hashlib
import os

import duckdb
import numpy as np
import pytest

from siftworks.llm import clustering

DATA = "/root/testdata/sf0.01"
COLUMNS = ("vec_id", "cluster", "distance")
SCHEMA = "vec_id long, embedding array<float>, label int, v string, near int, cluster string"


def plain(rows, k, rounds, components):
    kept = [(i, [int(np.floor(float(np.float32(x)) * 1024)) for x in e]) for i, e in rows if e is not None and len(e) == components and all(x is not None and np.isfinite(x) for x in e)]
    chosen = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [list(v) for _, v in chosen]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            own = [v for (_, v), a in zip(kept, at, strict=True) if a == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return sorted(((i, (d := nearest(v))[1], d[0]) for i, v in kept), key=str), centroids


def found(spark, rows, k, rounds, components):
    frame = spark.createDataFrame([(i, e, 1, "v", 2, "c") for i, e in rows], SCHEMA).repartition(3)
    got, centroids = clustering.clusters(clustering.integer_vectors(frame, components=components), k, rounds)
    return sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=str), centroids.tolist()


@pytest.mark.parametrize("k,rounds,components", [(1, 2, 3), (3, 4, 2), (8, 10, 4), (20, 6, 5)])
def test_plain_rounds(spark, k, rounds, components):
    draw = np.random.default_rng(k)
    middle = draw.normal(size=(k + 2, components))
    rows = [(i, (middle[i % len(middle)] + 0.3 * draw.normal(size=components)).tolist()) for i in range(400)]
    rows += [(1000 + i, middle[0].tolist()) for i in range(150)]  # one vector many times
    assert found(spark, rows, k, rounds, components) == plain(rows, k, rounds, components)


def test_ties_repeats_and_odd_vectors(spark):
    grid = [(10 * x + y, [x / 4, y / 4]) for x in range(8) for y in range(8)]
    odd = [(900, None), (901, []), (902, [1.0]), (903, [1.0, None]), (904, [float("nan"), 1.0]), (905, [float("inf"), 0.0]), (906, [1.0, 2.0, 3.0])]
    more = [(None, [0.5, 0.5]), (None, [0.25, 0.5]), (3, [1.0, 1.0]), (3, [1.0, 1.0]), (77, [-3.0, -0.0001]), (78, [-100_000.0, 100_000.0])]
    rows = grid + odd + more
    assert found(spark, rows, 8, 10, 2) == plain(rows, 8, 10, 2)
    assert found(spark, odd, 8, 10, 2) == ([], [])
    assert found(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5])], 8, 3, 2) == plain([(1, [0.5, 0.5]), (2, [0.5, 0.5])], 8, 3, 2)


def test_too_large(spark):
    with pytest.raises(Exception, match="would not fit a long"):
        found(spark, [(1, [1e6, 0.0])], 2, 1, 2)


def test_bounds_spare_scans():
    """Vectors around far centres are certified by their bounds; all of them agree with a scan."""
    draw = np.random.default_rng(5)
    middle = draw.integers(-1000, 1000, (12, 16))
    v = (middle[draw.integers(0, 12, 3000)] + draw.integers(-300, 300, (3000, 16))).astype(np.int64)
    centroids = middle + draw.integers(-200, 200, middle.shape)
    near, bound = clustering.Bounds(centroids, np.zeros(12), 3).scanned(v)
    seen = []
    for _ in range(8):
        new = np.array([v[near[:, 0] == c].sum(0) // max(1, (near[:, 0] == c).sum()) if (near[:, 0] == c).any() else centroids[c] for c in range(12)])
        moved = np.sqrt(((new - centroids) ** 2).sum(1)) * (1 + clustering.SLACK)
        centroids = new
        b = clustering.Bounds(centroids, moved, 3)
        near, bound = b.updated(v, near, bound)
        seen.append(b.seen)
        d = clustering.squared(v, centroids)
        assert (near[:, 0] == d.argmin(1)).all()
        root = np.sqrt(np.take_along_axis(d, near, 1))
        assert (bound[:, 0] >= root[:, 0]).all() and (bound[:, 1:-1] <= root[:, 1:]).all()
        others = d.astype(float)
        np.put_along_axis(others, near, np.inf, 1)
        assert (bound[:, -1] <= np.sqrt(others.min(1))).all()
    assert seen[-1]["certified"] > 2500 and sum(s["reordered"] for s in seen) > 0
    assert sum(s["scanned"] for s in seen) < 4000


def test_distances_are_exact():
    big = np.array([[clustering.LARGEST - 1] * 64, [-clustering.LARGEST + 1] * 64], np.int64)
    want = 64 * (2 * clustering.LARGEST - 2) ** 2
    assert clustering.squared(big, big).tolist() == [[0, want], [want, 0]]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
def test_sql(spark):
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    want = duckdb.sql(clustering.OP12_SQL)
    got = clustering.op12_drake_bounds(spark, DATA)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(tuple(r[c] for c in want.columns) for r in got.collect()) == sorted(want.fetchall())
