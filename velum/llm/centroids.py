"""Centroid clustering of integer vectors with Yinyang bounds.

Centroids are put into groups once. Every vector keeps an upper bound of the distance to its centroid and one lower bound
for each group; when centroids move, the bounds move with them. A vector whose upper bound stays below all lower bounds is
left alone (global filter), then whole groups are (group filter), and only centroids of the groups that are left are
measured, in exact integers. Bounds are kept a little loose, so that rounding never hides a nearer or an equal centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velum.llm.common import discard, map_batches, stored

#: Centroids of a group, about.
GROUP_SIZE = 4
#: How much of itself a bound is kept loose by.
SLACK = 1e-9
#: Components up to which squared distances of vectors are exact in double arithmetic, and in 64-bit integers at all.
EXACT, MOST = 1 << 20, 1 << 27


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows x centroids, int64) of integer vectors."""
    if not x.size or not c.size:
        return np.zeros((len(x), len(c)), np.int64)
    top = max(int(np.abs(x).max()), int(np.abs(c).max()))
    if top > MOST:
        raise OverflowError(f"a component of {top} is beyond {MOST}: squared distances may not fit 64 bits")
    if 4 * x.shape[1] * top * top < 1 << 53 and top <= EXACT:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - one) ** 2).sum(1) for one in c], 1)


def groups(c: np.ndarray, count: int, rounds: int = 5) -> np.ndarray:
    """The group of each centroid: a few plain rounds over the centroids themselves, starting far from each other."""
    points = c.astype(np.float64)
    picked = [0]
    for _ in range(1, count):
        picked.append(int(np.min([((points - points[p]) ** 2).sum(1) for p in picked], 0).argmax()))
    heart = points[picked]
    for _ in range(rounds):
        of = ((points[:, None] - heart[None]) ** 2).sum(2).argmin(1)
        for g in np.unique(of):
            heart[g] = points[of == g].mean(0)
    return np.unique(((points[:, None] - heart[None]) ** 2).sum(2).argmin(1), return_inverse=True)[1]


@dataclass
class Bounds:
    """What is kept of some vectors: centroid, upper bound, and a lower bound for each group (its other centroids)."""

    cluster: np.ndarray
    upper: np.ndarray
    lower: np.ndarray


def first_bounds(x: np.ndarray, c: np.ndarray, group: np.ndarray) -> Bounds:
    """Bounds from all distances."""
    d = squared(x, c)
    cluster = d.argmin(1)
    row = np.arange(len(x))
    root = np.sqrt(d.astype(np.float64))
    upper = root[row, cluster] * (1 + SLACK)
    root[row, cluster] = np.inf
    lower = np.stack([root[:, group == g].min(1) for g in range(group.max() + 1)], 1) * (1 - SLACK)
    return Bounds(cluster, upper, lower)


def next_bounds(x: np.ndarray, c: np.ndarray, group: np.ndarray, moved: np.ndarray, b: Bounds) -> tuple[Bounds, np.ndarray]:
    """(bounds after the centroids moved by `moved` to `c`, number of distances measured for each vector)."""
    count = group.max() + 1
    drift = np.array([moved[group == g].max() for g in range(count)])
    cluster, upper = b.cluster.copy(), (b.upper + moved[b.cluster]) * (1 + SLACK)
    lower = (b.lower - drift) * np.where(b.lower > drift, 1 - SLACK, 1 + SLACK)
    measured = np.zeros(len(x), np.int64)
    open_ = np.flatnonzero(lower.min(1) <= upper)
    if len(open_):
        own = np.zeros(len(open_), np.int64)
        for k in np.unique(cluster[open_]):
            some = cluster[open_] == k
            own[some] = squared(x[open_[some]], c[k : k + 1])[:, 0]
        measured[open_] += 1
        upper[open_] = np.sqrt(own.astype(np.float64)) * (1 + SLACK)
        left = lower[open_].min(1) <= upper[open_]
        open_, own = open_[left], own[left]
    if not len(open_):
        return Bounds(cluster, upper, lower), measured
    was, limit = cluster[open_], upper[open_]
    best, best_d = was.copy(), own.copy()
    seen = np.full((len(open_), len(c)), np.inf)  # distances of all that is measured
    seen[np.arange(len(open_)), was] = np.sqrt(own.astype(np.float64))
    scanned = lower[open_] <= limit[:, None]
    for g in range(count):
        rows = np.flatnonzero(scanned[:, g])
        if not len(rows):
            continue
        members = np.flatnonzero(group == g)
        d = squared(x[open_[rows]], c[members])
        measured[open_[rows]] += len(members)
        seen[np.ix_(rows, members)] = np.sqrt(d.astype(np.float64))
        nearest = d.argmin(1)
        low, k = d[np.arange(len(rows)), nearest], members[nearest]
        better = (low < best_d[rows]) | ((low == best_d[rows]) & (k < best[rows]))
        best[rows], best_d[rows] = np.where(better, k, best[rows]), np.where(better, low, best_d[rows])
    row = np.arange(len(open_))
    others = seen.copy()
    others[row, best] = np.inf
    bound = lower[open_]
    for g in range(count):
        least = others[:, group == g].min(1) * (1 - SLACK)
        # a group that wasn't measured keeps its bound, but may have got back the centroid that the vector left
        bound[:, g] = np.where(scanned[:, g], least, np.minimum(bound[:, g], least))
    cluster[open_], upper[open_], lower[open_] = best, np.sqrt(best_d.astype(np.float64)) * (1 + SLACK), bound
    return Bounds(cluster, upper, lower), measured


def usable(column: str, dims: int) -> Column:
    """True for arrays of `dims` components without null or non-finite ones."""
    value = F.transform(column, lambda x: x.cast("double"))
    return F.coalesce((F.size(column) == dims) & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def scaled(vectors: DataFrame, dims: int, scale: float = 64.0, column: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(id, x array<long>): the usable vectors, each component c as floor(scale * c)."""
    kept = vectors.where(usable(column, dims))
    return kept.select(F.col(id_col), F.transform(column, lambda c: F.floor(F.lit(scale) * c.cast("double"))).alias("x"))


def by_hash(vectors: DataFrame, k: int, seed: int = 1, id_col: str = "vec_id") -> np.ndarray:
    """The `k` vectors (fewer, if there are no more) with the smallest SHA-256 of `<seed>:<id>`, in that order.

    Rows without an id are never taken; repeated ids follow by their components.
    """
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary"), 256)
    rows = vectors.where(F.col(id_col).isNotNull()).select(mark.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return np.array([r["x"] for r in rows], np.int64)


def _vectors(column: pa.Array) -> np.ndarray:
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1), flat.dtype)


def cluster(vectors: DataFrame, start: np.ndarray, rounds: int, id_col: str = "vec_id", group_size: int = GROUP_SIZE) -> tuple[DataFrame, np.ndarray]:
    """((id, x, cluster int, distance long), centroids) after `rounds` rounds and one more assignment.

    `vectors` holds (id, x array<long>), all x as long as the rows of `start`. In a round each vector goes to the nearest
    centroid (squared Euclidean distance, the smaller number of equal ones), then each centroid that has vectors becomes
    the floor of their mean, in exact integers. Repeated rows count as often as they stand there; null ids are ids like
    any other; without vectors the result is empty. Components beyond 2^27 are an error, as distances might not fit.

    One pass a round writes bounds and centroids of all vectors to the shared scratch folder and drops what the round
    before wrote; only sums by centroid, a number of rows bounded by the number of centroids, are shuffled and collected.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    if not len(start):
        return vectors.select(id_col, "x", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), start
    centroids = start.astype(np.int64)
    group = groups(centroids, max(1, round(len(centroids) / group_size)))
    schema = f"`{id_col}` {kind}, x array<long>, cluster int, upper double, lower array<double>, measured long"
    names = [id_col, "x", "cluster", "upper", "lower", "measured"]

    def assign(state: DataFrame, c: np.ndarray, moved: np.ndarray | None) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _vectors(batch.column("x"))
                if moved is None:
                    now, measured = first_bounds(x, c, group), np.full(len(x), len(c), np.int64)
                else:
                    kept = Bounds(batch.column("cluster").to_numpy().astype(np.int64), batch.column("upper").to_numpy(), _vectors(batch.column("lower")))
                    now, measured = next_bounds(x, c, group, moved, kept)
                columns = [batch.column(id_col), batch.column("x"), pa.array(now.cluster.astype(np.int32)), pa.array(now.upper), pa.array(list(now.lower), pa.list_(pa.float64())), pa.array(measured)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

        return map_batches(state, work, schema)

    state = stored(assign(vectors.select(id_col, "x"), centroids, None), "bounds")
    for _ in range(rounds):
        sums = state.groupBy("cluster").agg(F.count("*").alias("n"), *(F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(centroids.shape[1])))
        moved_to = centroids.copy()
        for r in sums.collect():
            moved_to[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(centroids.shape[1])]
        moved = np.sqrt(((moved_to - centroids).astype(np.float64) ** 2).sum(1)) * (1 + SLACK)
        centroids, before = moved_to, state
        state = stored(assign(before, centroids, moved), "bounds")
        discard(before)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, own = _vectors(batch.column("x")), batch.column("cluster").to_numpy()
            d = np.zeros(len(x), np.int64)
            for k in np.unique(own):
                d[own == k] = squared(x[own == k], centroids[k : k + 1])[:, 0]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("x"), batch.column("cluster"), pa.array(d)], names=[id_col, "x", "cluster", "distance"])

    out = map_batches(state.select(id_col, "x", "cluster"), measure, f"`{id_col}` {kind}, x array<long>, cluster int, distance long")
    out = stored(out, "clusters")
    discard(state)
    return out, centroids


def report(clustered: DataFrame, centroids: np.ndarray, id_col: str = "vec_id") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each row of cluster().

    Sums by cluster are joined back as a table of at most one row a centroid.
    """
    spark = clustered.sparkSession
    sums = {r["cluster"]: r["d"] for r in clustered.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    digest = lambda k: hashlib.sha256(",".join(map(str, centroids[k].tolist())).encode()).hexdigest()
    rows = [(k, d, sum(sums.values()), digest(k)) for k, d in sums.items()]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return clustered.join(F.broadcast(about), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
