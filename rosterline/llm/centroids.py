"""Centroid clustering of integer vectors, exact, with bounds loosened by geometry.

Every vector keeps a lower bound on its distance to all centroids but its own. When centroids move, the
bound must fall by what the nearest other centroid may have gained. The usual loss is the whole drift of
the centroid that moved most. Here all members of a cluster lie in a sphere around its centroid. Seen
from the middle of another centroid's move, with the move as an axis, each point of that sphere lies at
an angle of at least ``angle(centre) - asin(radius / distance)``, a figure in the plane through the
centre and the move. A point at angle t gains at most ``drift * cos t``: the difference of its squared
distances to the two ends is ``2 * rho * drift * cos t``, and the sum of the distances at least
``2 * rho``. Moves away from the sphere or across it therefore cost little or nothing.

A vector nearer to its own centroid than its bound keeps it unseen; all others are *ambiguous* and are
scanned against every centroid in whole numbers. Bounds only decide who is scanned, so results equal the
plain double loop, ties included.

Each round is one pass that writes the vectors with their bounds and, per task and cluster, how many
there are, how far the farthest lies and what entered or left. The driver sees sums per cluster.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rosterline.llm.common import column, written

# Up to this size of a component, squared distances of up to 128 components fit into a long.
LARGEST = 2**27
_STATE = "vec_id long, vec array<int>, cluster int, low double, distance long, n long, far long, scanned long, moved array<long>"
_SCHEMA = pa.schema([
    ("vec_id", pa.int64()), ("vec", pa.list_(pa.int32())), ("cluster", pa.int32()), ("low", pa.float64()),
    ("distance", pa.int64()), ("n", pa.int64()), ("far", pa.int64()), ("scanned", pa.int64()), ("moved", pa.list_(pa.int64())),
])


def whole_vectors(vectors: DataFrame, dimensions: int, scale: int) -> DataFrame:
    """``vec_id, vec``: the usable vectors with components ``floor(scale * x)``."""
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < LARGEST))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(
        (F.size("embedding") == dimensions) & usable).select(
        "vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("vec"))


def seed_key(vec_id: Column, seed: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(vec_id.cast("string"), F.lit("null"))), 256)


def loosening(old: np.ndarray, new: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Per cluster: the most that any other centroid's move can bring it closer to a member.

    ``far`` has the squared radius of each cluster around its centroid in ``old`` (negative: empty).
    """
    k = len(old)
    out = np.zeros(k)
    radius = np.sqrt(np.maximum(far, 0).astype(float))
    for j in range(k):
        move = (new[j] - old[j]).astype(float)
        drift = np.sqrt(move @ move)
        if not drift:
            continue
        arm = old - (old[j] + move / 2)
        reach = np.sqrt((arm * arm).sum(1))
        inside = reach <= radius
        safe = np.where(inside, 1.0, reach)
        angle = np.arccos(np.clip(arm @ move / (safe * drift), -1, 1)) - np.arcsin(np.where(inside, 0, radius / safe))
        gain = np.where(inside, drift, drift * np.cos(np.clip(angle, 0, np.pi / 2)))
        gain[j] = 0
        out = np.maximum(out, gain)
    # Rounding of floats must never tighten a bound.
    return out * (1 + 1e-9) + 1e-9 * (1 + np.abs(old).max(initial=0) + np.abs(new).max(initial=0))


def _squared(vecs: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, rows by centroids."""
    reach = int(np.abs(vecs).max(initial=0)) + int(np.abs(centroids).max(initial=0))
    if 2 * vecs.shape[1] * reach * reach < 2**53:
        # Every intermediate value is a whole number that a double holds.
        a, b = vecs.astype(float), centroids.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((vecs - c) ** 2).sum(1) for c in centroids], 1)


def _pass(centroids: np.ndarray, loosen: np.ndarray, rows: int):
    k, dimensions = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, far, scanned = np.zeros(k, np.int64), np.full(k, -1, np.int64), np.zeros(k, np.int64)
        moved = np.zeros((k, dimensions), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                held = column(part, "vec")
                vecs = held.flatten().to_numpy().reshape(-1, dimensions).astype(np.int64)
                was = column(part, "cluster").fill_null(-1).to_numpy(zero_copy_only=False)
                low = column(part, "low").fill_null(-1.0).to_numpy(zero_copy_only=False)
                own = np.maximum(was, 0)
                low = np.where(was < 0, -1.0, low - loosen[own])
                distance = ((vecs - centroids[own]) ** 2).sum(1)
                now = own.copy()
                ambiguous = np.flatnonzero(np.sqrt(distance.astype(float)) * (1 + 1e-12) >= low)
                if len(ambiguous):
                    all_ = _squared(vecs[ambiguous], centroids)
                    best = all_.argmin(1)
                    at = np.arange(len(ambiguous))
                    now[ambiguous], distance[ambiguous] = best, all_[at, best]
                    all_[at, best] = np.iinfo(np.int64).max
                    low[ambiguous] = np.sqrt(all_.min(1).astype(float)) * (1 - 1e-12)
                np.add.at(scanned, now[ambiguous], 1)
                np.add.at(n, now, 1)
                np.maximum.at(far, now, distance)
                change = np.flatnonzero(now != was)
                np.add.at(moved, now[change], vecs[change])
                left = change[was[change] >= 0]
                np.subtract.at(moved, was[left], vecs[left])
                size = len(vecs)
                yield pa.RecordBatch.from_arrays([
                    column(part, "vec_id"), held, pa.array(now, pa.int32()), pa.array(low), pa.array(distance),
                    *(pa.nulls(size, f.type) for f in list(_SCHEMA)[5:]),
                ], schema=_SCHEMA)
        used = np.flatnonzero((n > 0) | moved.any(1))
        size = len(used)
        if size:
            yield pa.RecordBatch.from_arrays([
                pa.nulls(size, pa.int64()), pa.nulls(size, pa.list_(pa.int32())), pa.array(used, pa.int32()),
                pa.nulls(size, pa.float64()), pa.nulls(size, pa.int64()), pa.array(n[used]), pa.array(far[used]),
                pa.array(scanned[used]), pa.array(moved[used].tolist(), pa.list_(pa.int64())),
            ], schema=_SCHEMA)

    return run


def _totals(state: DataFrame, dimensions: int) -> list:
    """At most one row per cluster: members, farthest, scanned, and what entered less what left."""
    return state.filter("n is not null").groupBy("cluster").agg(
        F.sum("n").alias("n"), F.max("far").alias("far"), F.sum("scanned").alias("scanned"),
        F.array(*(F.sum(F.col("moved")[i]) for i in range(dimensions))).alias("moved")).collect()


def cluster(
    vectors: DataFrame, k: int = 40, rounds: int = 5, dimensions: int = 64, scale: int = 256, seed: str = "2",
    rows: int = 4096, report: list | None = None,
) -> DataFrame:
    """Every usable vector's cluster after ``rounds`` rounds of assignment and update, and a last assignment.

    ``vectors`` needs ``vec_id`` and ``embedding``; other columns are ignored. Usable are vectors of
    ``dimensions`` components, none null, NaN or infinite, and none of 2^27 or more after scaling, whose
    distances a long could not hold; others are left out. Components become ``floor(scale * x)``. The
    first centroids are the ``k`` vectors with the smallest SHA-256 of ``seed:vec_id`` (null id: the word
    null), equal ones by their components; with fewer vectors there are fewer centroids. Ties go to the
    smaller number. A centroid becomes the floor of its members' mean; an empty one stays. Repeated rows
    and ids each count and each give a row. An empty table gives an empty result.

    Returns ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``. ``report`` gets, per
    pass, the number of vectors scanned. What the driver holds is ``k * dimensions`` numbers.
    """
    spark = vectors.sparkSession
    kept = whole_vectors(vectors, dimensions, scale)
    first = kept.orderBy(seed_key(F.col("vec_id"), seed), "vec").limit(k).select("vec").collect()
    centroids = np.array([r["vec"] for r in first], np.int64).reshape(-1, dimensions)
    state = kept.select("vec_id", "vec", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("double").alias("low"))
    loosen = np.zeros(len(centroids))
    sums = [[0] * dimensions for _ in centroids]
    for turn in range(rounds + 1):
        if not len(centroids):
            state = spark.createDataFrame([], _STATE)
            break
        state = written(state.select("vec_id", "vec", "cluster", "low").mapInArrow(_pass(centroids, loosen, rows), _STATE))
        if turn == rounds and report is None:
            break
        moved, far = centroids.copy(), np.full(len(centroids), -1, np.int64)
        totals = _totals(state, dimensions)
        if report is not None:
            report.append(sum(r["scanned"] for r in totals))
        if turn == rounds:
            break
        for r in totals:
            c = r["cluster"]
            sums[c] = [a + b for a, b in zip(sums[c], r["moved"])]
            if r["n"]:
                moved[c] = [s // r["n"] for s in sums[c]]
                far[c] = r["far"]
        loosen = loosening(centroids, moved, far)
        centroids = moved
        state = state.filter("n is null")
    assigned = state.filter("n is null").select("vec_id", "cluster", "distance")
    inertia = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    whole = sum(inertia.values())
    per_cluster = spark.createDataFrame([
        (c, inertia.get(c, 0), whole, hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest())
        for c, row in enumerate(centroids)
    ], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # One row per centroid: k bounds what is sent.
    return assigned.join(F.broadcast(per_cluster), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
