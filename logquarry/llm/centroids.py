"""Centroid clustering (k-means) over whole numbers, with distances filtered in a rotated space.

Vectors become whole numbers and stay so: a centroid is the componentwise floor of a mean and a distance is a whole
number, so the outcome doesn't depend on the order of rows, tasks or retries.

The principal axes of all vectors are found once, from sums over tasks. Each vector is stored with its leading rotated
coordinates and the norm of the rest. A rotation keeps lengths, and two rests of norms r and s are at least |r - s|
apart, so projected distance plus (r - s)^2 bounds the distance to a centroid from below. A task takes the centroid with
the lowest bound, measures it exactly, and measures in whole numbers those whose bound lies below what was found. The
bounds are floats; they are slackened by far more than their rounding error, so none of them drops the nearest centroid.

Each round is one pass that sends a count and a sum per cluster and component out of each task. Centroids (``k`` of them)
are all the driver holds.

Defined cases: a vector that is null, has another number of components or one that is null or not finite is left out;
whole numbers beyond +-2^27 count as that; a null id never comes before others among the starting vectors; rows that
repeat an id are vectors of their own; fewer vectors than ``k`` give that many centroids; ties go to the smaller
centroid number; an empty table gives an empty result; columns other than the id and the vector are ignored; an inertia
beyond a long is the largest long.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.llm.common import written

K, ROUNDS, SIZE, SCALE, SEED = 40, 5, 64, 256, 2
LEADING = 16  # rotated coordinates that are stored
LIMIT = 1 << 27  # of a whole number; a squared distance of 64 components then fits a long
SLACK = 1e-9  # of the squared lengths involved; sums of some hundred doubles are off by less than 1e-13 of them
SLAB = 1 << 13  # vectors compared at a time
LONGEST = (1 << 63) - 1


def whole_vectors(vectors: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """(vec_id, v) with whole components, of the usable vectors."""
    value = F.col("embedding")
    bad = F.exists(value, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    usable = vectors.filter(F.coalesce((F.size(value) == size) & ~bad, F.lit(False)))
    whole = F.transform(value, lambda x: F.least(F.greatest(F.floor(x.cast("double") * scale), F.lit(-LIMIT)), F.lit(LIMIT)).cast("int"))
    return usable.select("vec_id", whole.alias("v"))


def starting_centroids(whole: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The ``k`` vectors whose ids have the smallest digests, in that order; vectors of one id by their components."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = whole.select(digest.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    return np.array([r["v"] for r in first], np.int64)


def _lists(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def principal_axes(whole: DataFrame, size: int, leading: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, axes) of all vectors: sums of components and of their products, added over tasks."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 + size + size * size)
        for batch in batches:
            v = _lists(batch.column("v")).reshape(-1, size).astype(float)
            held += np.concatenate([[len(v)], v.sum(axis=0), (v.T @ v).ravel()])
        yield pa.RecordBatch.from_pydict({"cell": np.arange(len(held)), "total": held})

    out = np.zeros(1 + size + size * size)
    for cell, total in whole.select("v").mapInArrow(gather, "cell long, total double").groupBy("cell").agg(F.sum("total")).collect():
        out[cell] = total
    mean = out[1 : 1 + size] / max(out[0], 1)
    spread = out[1 + size :].reshape(size, size) / max(out[0], 1) - np.outer(mean, mean)
    return mean, np.linalg.eigh(spread)[1][:, ::-1][:, :leading]


def rotated(v: np.ndarray, mean: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """The leading rotated coordinates of each vector and, last, the norm of the rest."""
    moved = v - mean
    front = moved @ axes
    rest = np.sqrt(np.maximum(0.0, (moved**2).sum(axis=1) - (front**2).sum(axis=1)))
    return np.column_stack([front, rest])


def stored(whole: DataFrame, mean: np.ndarray, axes: np.ndarray) -> DataFrame:
    """(vec_id, v, p): components as 32-bit numbers, rotated coordinates and the rest's norm as doubles, in bytes."""
    size = len(mean)

    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _lists(batch.column("v")).reshape(-1, size)
            columns = [[row.tobytes() for row in part] for part in (v.astype(np.int32), rotated(v, mean, axes))]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), *(pa.array(c, pa.binary()) for c in columns)], ["vec_id", "v", "p"])

    kind = whole.schema["vec_id"].dataType.simpleString()
    return written(whole.mapInArrow(rotate, f"vec_id {kind}, v binary, p binary"), "vectors")


def nearest(v: np.ndarray, p: np.ndarray, centroids: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(centroid, squared distance) of each vector, and how many distances were measured.

    ``p`` and ``q`` are the rotated vectors and centroids, the rest's norm last.
    """
    lengths, own = (p**2).sum(axis=1), (q**2).sum(axis=1)
    bound = (p[:, None, -1] - q[None, :, -1]) ** 2
    front, other = p[:, :-1], q[:, :-1]
    bound += (front**2).sum(axis=1)[:, None] + (other**2).sum(axis=1)[None, :] - 2 * (front @ other.T)
    bound -= SLACK * (1 + lengths[:, None] + own[None, :])
    rows = np.arange(len(v))
    best = bound.argmin(axis=1)
    far = ((v - centroids[best]) ** 2).sum(axis=1)
    measured = len(v)
    bound[rows, best] = np.inf
    for j in range(len(centroids)):
        left = np.flatnonzero(bound[:, j] <= far)
        measured += len(left)
        d = ((v[left] - centroids[j]) ** 2).sum(axis=1)
        nearer = (d < far[left]) | ((d == far[left]) & (j < best[left]))
        best[left[nearer]], far[left[nearer]] = j, d[nearer]
    return best, far, measured


def _assigned(batch: pa.RecordBatch, centroids: np.ndarray, q: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, vectors, centroid, distance) by slabs."""
    size, width = centroids.shape[1], q.shape[1]
    v = np.frombuffer(b"".join(batch.column("v").to_pylist()), np.int32).reshape(-1, size)
    p = np.frombuffer(b"".join(batch.column("p").to_pylist()), np.float64).reshape(-1, width)
    for at in range(0, len(v), SLAB):
        part = v[at : at + SLAB].astype(np.int64)
        best, far, _ = nearest(part, p[at : at + SLAB], centroids, q)
        yield at, part, best, far


def moved(vectors: DataFrame, centroids: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The floors of the clusters' means; an empty cluster keeps its centroid."""
    k, size = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((k, size + 1), np.int64)
        for batch in batches:
            for _, v, best, _ in _assigned(batch, centroids, q):
                for j in np.unique(best):
                    own = v[best == j]
                    held[j] += [*own.sum(axis=0), len(own)]
        j, cell = np.nonzero(np.broadcast_to(held[:, -1:] > 0, held.shape))
        yield pa.RecordBatch.from_pydict({"j": j, "cell": cell, "total": held[j, cell]})

    each = vectors.select("v", "p").mapInArrow(add, "j long, cell long, total long")
    sums = {(r["j"], r["cell"]): int(r["total"]) for r in each.groupBy("j", "cell").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
    out = centroids.copy()
    for j in range(k):
        if n := sums.get((j, size), 0):
            out[j] = [sums[j, cell] // n for cell in range(size)]
    return out


def clusters(
    vectors: DataFrame, *, k: int = K, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: int = SEED, leading: int = LEADING
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable vector."""
    spark = vectors.sparkSession
    whole = whole_vectors(vectors, size, scale)
    out = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    columns = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    centroids = starting_centroids(whole, k, seed)
    if not len(centroids):
        kinds = dict(zip(columns[1:], ("int", "long", "long", "long", "string")))
        return whole.select("vec_id", *(F.lit(None).cast(kind).alias(name) for name, kind in kinds.items())).limit(0)
    mean, axes = principal_axes(whole, size, min(leading, size))
    table = stored(whole, mean, axes)
    for _ in range(rounds):
        centroids = moved(table, centroids, rotated(centroids, mean, axes))
    q = rotated(centroids, mean, axes)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, _, best, far in _assigned(batch, centroids, q):
                ids = batch.column("vec_id").slice(at, len(best))
                yield pa.RecordBatch.from_arrays([ids, pa.array(best.astype(np.int32)), pa.array(far)], ["vec_id", "cluster", "distance"])

    kind = whole.schema["vec_id"].dataType.simpleString()
    placed = written(table.mapInArrow(assign, f"vec_id {kind}, cluster int, distance long"), "placed")
    sums = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()
    whole_sum = min(LONGEST, int(sum(r["d"] for r in sums)))
    digest = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    told = spark.createDataFrame([(r["cluster"], min(LONGEST, int(r["d"])), whole_sum, digest[r["cluster"]]) for r in sums], out)
    return placed.join(F.broadcast(told), "cluster").select(*columns)
