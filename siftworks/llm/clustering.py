"""Centroid clustering with Drake's adaptive distance bounds, in exact integers.

Every vector keeps its centroid and an upper bound of the distance to it, the next few
nearest centroids with a lower bound each, and one lower bound for all the others. When
centroids move, the bounds move by as much. A vector whose upper bound is below all its
lower bounds keeps its centroid unseen. Otherwise the distances to the few are
computed; if the nearest of them is below the bound of the others the list is put in order
anew, and only if that can't be certified are all centroids scanned. How many centroids are kept
follows what the round before needed, and only falls.

Distances are exact integers, and bounds are rounded outwards, so the result is that of
scanning every centroid in every round. A round is one pass of independent tasks: it writes
the vectors with their bounds as a Parquet table in the shared folder, each task's sums beside
them, and the round before is removed. The sums of tasks (one row a centroid) are added up in
the cluster; the driver sees the centroids alone.

Defined results: vectors of another length than asked for, or with a null, NaN or infinite
component, are left out; repeated rows count as often as they occur; a null id hashes as an
empty one; rows of equal hash are ordered by their components; with fewer vectors than centroids every
vector is a centroid at first; an empty table gives an empty result; other columns are not read. A
component of ``LARGEST`` and more is an error, as squared distances would not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, discard, shared_path, table

#: Integer components are below this: 64 squared differences then fit a long.
LARGEST = 1 << 27
#: Vectors that a task works on at a time.
BLOCK = 8192
#: Relative slack of a bound, more than its rounding.
SLACK = 2.0**-50
STATE = "vec_id long, v array<int>, near array<smallint>, bound array<double>, part int, n long, sums array<long>, used int"


def integer_vectors(rows: DataFrame, id_column: str = "vec_id", column: str = "embedding", components: int = 64, scale: int = 1024) -> DataFrame:
    """``vec_id`` and ``v``: ``floor(scale * x)`` of each component of the usable vectors."""
    e = F.col(column)
    usable = (F.size(e) == components) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(e, lambda x: F.floor(x.cast("double") * scale))
    small = F.forall(e, lambda x: F.abs(x.cast("double")) * scale < LARGEST)
    refused = F.raise_error(F.lit(f"a component reaches {LARGEST} after scaling; squared distances would not fit a long"))
    return rows.where(usable).select(F.col(id_column).cast("long").alias("vec_id"), F.when(small, whole.cast("array<int>")).otherwise(refused.cast("array<int>")).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors of least SHA-256 of ``seed:id``, as they follow each other."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = vectors.select(F.sha2(text, 256).alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64).reshape(len(rows), len(rows[0]["v"]) if rows else 0)


def squared(v: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Exact squared distances of each vector (n, d) to its own centroids (n, m, d), or to all (m, d)."""
    most = max(np.abs(v).max(initial=0), np.abs(to).max(initial=0))
    if to.ndim == 2 and 4 * v.shape[1] * int(most) ** 2 < 1 << 53:  # every step is exact in doubles
        x, c = v.astype(np.float64), to.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)
    if to.ndim == 2:
        return np.stack([((v - c) ** 2).sum(1) for c in to], 1)
    return np.stack([((v - to[:, j]) ** 2).sum(1) for j in range(to.shape[1])], 1)


class Bounds:
    """Nearest centroids of a block of vectors, from what is known of them.

    ``near[:, 0]`` is the centroid, the rest the next ones kept; ``bound`` has the upper bound
    of the first, a lower bound for each of the next, and the lower bound of all others.
    """

    def __init__(self, centroids: np.ndarray, moved: np.ndarray, keep: int):
        self.centroids, self.moved, self.keep = centroids, moved, min(keep, len(centroids) - 1)
        self.used = 1  #: how many of the kept centroids a vector has needed at most
        self.seen = {"certified": 0, "reordered": 0, "scanned": 0}

    def scanned(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = squared(v, self.centroids)
        order = np.argsort(d, axis=1, kind="stable")  # ties: the smaller number
        near = order[:, : self.keep + 1]
        root = np.sqrt(np.take_along_axis(d, order, 1).astype(np.float64))
        rest = root[:, self.keep + 1] if self.keep + 1 < len(self.centroids) else np.full(len(v), np.inf)
        return near, self._outwards(root[:, : self.keep + 1], rest)

    @staticmethod
    def _outwards(root: np.ndarray, rest: np.ndarray) -> np.ndarray:
        bound = np.column_stack([root, rest]) * (1 - SLACK)
        bound[:, 0] = root[:, 0] * (1 + SLACK)
        return bound

    def updated(self, v: np.ndarray, near: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """After the centroids moved by ``moved``; lists longer than ``keep`` are cut, their bounds go to the others'."""
        others = np.ones((len(v), len(self.centroids)), bool)
        np.put_along_axis(others, near, False, 1)
        most = np.where(others, self.moved, 0.0).max(1)
        by = np.column_stack([self.moved[near], most])
        sign = np.ones(bound.shape[1])
        sign[1:] = -1
        with np.errstate(invalid="ignore"):
            bound = bound + sign * (by + SLACK * (np.abs(bound) + by))
        bound[np.isnan(bound)] = np.inf  # an infinite bound: there are no others
        if near.shape[1] > self.keep + 1:
            rest = bound[:, self.keep + 1 :].min(1)
            near, bound = near[:, : self.keep + 1], np.column_stack([bound[:, : self.keep + 1], rest])
        open_ = np.flatnonzero(bound[:, 0] >= bound[:, 1:].min(1))
        self.seen["certified"] += len(v) - len(open_)
        if len(open_):
            near, bound = near.copy(), bound.copy()
            near[open_], bound[open_] = self._reordered(v[open_], near[open_], bound[open_])
        return near, bound

    def _reordered(self, v: np.ndarray, near: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = squared(v, self.centroids[near])
        order = np.lexsort((near, d), axis=1)
        root = np.sqrt(np.take_along_axis(d, order, 1).astype(np.float64))
        new_near, new_bound = np.take_along_axis(near, order, 1), self._outwards(root, bound[:, -1])
        new_bound[:, -1] = bound[:, -1]  # it is no distance computed just now
        sure = new_bound[:, 0] < bound[:, -1]
        if sure.any():
            self.used = max(self.used, int(order[sure, 0].max()))
        self.seen["reordered"] += int(sure.sum())
        if not sure.all():
            self.seen["scanned"] += int((~sure).sum())
            new_near[~sure], new_bound[~sure] = self.scanned(v[~sure])
        return new_near, new_bound


def _matrix(column: pa.Array, kind) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _lists(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, max(width, 1), dtype=np.int32)[: n + 1]), pa.array(matrix.reshape(-1), kind))


def _round(known: DataFrame, centroids: np.ndarray, moved: np.ndarray | None, keep: int) -> DataFrame:
    """Vectors with bounds that hold for ``centroids``, and a row for each centroid with the sums of a task's vectors."""
    state = moved is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = Bounds(centroids, moved if state else np.zeros(len(centroids)), keep)
        sums, counts = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for whole in batches:
            for begin in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(begin, BLOCK)
                v = _matrix(batch.column("v"), np.int64)
                near, bound = bounds.updated(v, _matrix(batch.column("near"), np.int64), _matrix(batch.column("bound"), np.float64)) if state else bounds.scanned(v)
                for c in np.unique(near[:, 0]):
                    own = near[:, 0] == c
                    sums[c] += v[own].sum(0)
                    counts[c] += int(own.sum())
                none = lambda kind: pa.nulls(batch.num_rows, kind)  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("v"), _lists(near, pa.int16()), _lists(bound, pa.float64()), none(pa.int32()), none(pa.int64()), none(pa.list_(pa.int64())), none(pa.int32())],
                    names=["vec_id", "v", "near", "bound", "part", "n", "sums", "used"],
                )
        some = np.flatnonzero(counts)
        none = lambda kind: pa.nulls(len(some), kind)
        yield pa.RecordBatch.from_arrays(
            [none(pa.int64()), none(pa.list_(pa.int32())), none(pa.list_(pa.int16())), none(pa.list_(pa.float64())), pa.array(some, pa.int32()), pa.array(counts[some]), _lists(sums[some], pa.int64()), pa.array([bounds.used] * len(some), pa.int32())],
            names=["vec_id", "v", "near", "bound", "part", "n", "sums", "used"],
        )

    return known.mapInArrow(run, STATE)


def _moved_centroids(done: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, int]:
    """The means, rounded down, of the centroids that have vectors, and the most kept centroids that a vector needed."""
    parts = done.where("part IS NOT NULL")
    # Decimals, as the sums of all rows may pass a long.
    added = parts.select("part", "n", "used", F.posexplode("sums").alias("i", "x")).groupBy("part", "i").agg(F.sum(F.col("x").cast("decimal(28,0)")).alias("x"), F.sum("n").alias("n"), F.max("used").alias("used"))
    new, used = centroids.copy(), 1
    for r in added.collect():  # one row for each component of each centroid
        new[r["part"], r["i"]] = int(r["x"]) // r["n"]
        used = max(used, r["used"])
    return new, used


def clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3) -> tuple[DataFrame, np.ndarray]:
    """``vec_id``, ``cluster``, ``distance`` of each vector (``vec_id``, ``v``) after ``rounds`` rounds and a last assignment,
    and the centroids."""
    spark = vectors.sparkSession
    centroids = first_centroids(vectors, k, seed)
    known, moved, before, keep = vectors, None, None, max(1, k // 4)
    for _ in range(rounds if len(centroids) else 0):
        path = shared_path(spark, "clusters")
        _round(known, centroids, moved, keep).write.parquet(path)
        done = spark.read.schema(STATE).parquet(path)
        new, used = _moved_centroids(done, centroids)
        if moved is not None:
            keep = min(keep, used)
        moved = np.sqrt(((new - centroids) ** 2).sum(1).astype(np.float64)) * (1 + SLACK)
        centroids, known = new, done.where("part IS NULL").select("vec_id", "v", "near", "bound")
        if before:
            discard(spark, before)
        before = path

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = Bounds(centroids, moved if moved is not None else np.zeros(len(centroids)), keep)
        for whole in batches:
            for begin in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(begin, BLOCK)
                v = _matrix(batch.column("v"), np.int64)
                near = (bounds.updated(v, _matrix(batch.column("near"), np.int64), _matrix(batch.column("bound"), np.float64)) if moved is not None else bounds.scanned(v))[0][:, 0]
                distance = squared(v, centroids[near][:, None, :])[:, 0]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(near, pa.int32()), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    found = cut(known.mapInArrow(last, "vec_id long, cluster int, distance long"))
    if before:
        discard(spark, before)
    return found, centroids


def op12_drake_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = clusters(integer_vectors(table(spark, sf_dir, "embeddings")), 8, 10, 3)
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    rows = [(c, sums.get(c, 0), sum(sums.values()), digest[c]) for c in range(len(centroids))]  # one for each centroid
    totals = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(totals), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _op12_sql(k: int = 8, rounds: int = 10) -> str:
    """Every centroid held against every vector in every round, one table a round."""
    parts = [
        "v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings"
        " WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))))",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS m FROM (SELECT v, sha256('3:' || coalesce(vec_id::VARCHAR, '')) AS h FROM v ORDER BY h, v LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        parts.append(
            f"d{i} AS MATERIALIZED (SELECT r, min(d * {k} + c) AS dc FROM (SELECT r, c, list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{i}) GROUP BY r)"
        )
        if i < rounds:
            parts.append(
                f"s{i} AS (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT dc % {k} AS c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v JOIN d{i} USING (r)) GROUP BY c, i),"
                f" c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(w.m, o.m) AS m FROM c{i} o LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM s{i} GROUP BY c) w ON o.c = w.c)"
            )
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT vec_id, (dc % {k})::INTEGER AS cluster, dc // {k} AS distance, (sum(dc // {k}) OVER (PARTITION BY dc % {k}))::BIGINT AS cluster_inertia,"
        f" (sum(dc // {k}) OVER ())::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM v JOIN d{rounds} USING (r) JOIN c{rounds} ON dc % {k} = c"
    )


OP12_SQL = _op12_sql()
