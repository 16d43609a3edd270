"""Nearest neighbours through inverted lists: coarse centroids, one Parquet partition a list, probes, exact distances.

Vectors are filed under the nearest of some centroids that are fitted on a bounded sample; a search reads the lists
nearest to each query. Queries meet lists in shuffles, so the scans don't grow with the number of queries. Each list
knows the largest angle to its centroid: a search with `exact` then reads, for each query, just the further lists that
this angle allows to hold a nearer row, and gives the rows of velum.operators.retrieval.knn() with the metric cosine.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from velum.io import checkpoint_dir, cut

#: Lists at most (else the square root of the rows), and sampled rows a list that centroids are fitted on.
MOST_LISTS, SAMPLE = 4096, 40
#: Rows and queries of a unit of work; larger lists are cut into several.
UNIT_ROWS, UNIT_QUERIES = 8192, 2048
#: Rows that meet all centroids at once, and rows of a batch that leaves, as a query may read every list.
AT_ONCE, OUT_ROWS = 256, 4096
_LOOSE = 1e-7


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows stay."""
    x = x.astype(np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def fitted(sample: np.ndarray, lists: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Centroids of length 1 by a few rounds over a sample of rows of length 1."""
    rng = np.random.default_rng(seed)
    heart = sample[rng.permutation(len(sample))[:lists]]
    for _ in range(rounds):
        of = (sample @ heart.T).argmax(1)
        sums = np.zeros_like(heart)
        np.add.at(sums, of, sample)
        some = np.bincount(of, minlength=len(heart)) > 0
        heart[some] = unit(sums[some])
    return heart


@dataclass
class Lists:
    """`rows` (list, id, vector, by), the centroids, and of each list its rows and the largest angle to its centroid."""

    rows: DataFrame
    centroids: np.ndarray
    sizes: np.ndarray
    angles: np.ndarray


def _cosines(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Cosines of rows of length 1 to the centroids; without any vector to fit them on there is one list for all."""
    return x @ centroids.T if centroids.any() else np.zeros((len(x), len(centroids)))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _held(df: DataFrame, id_col: str, by: str | None) -> DataFrame:
    group = (F.xxhash64(by) if by else F.lit(0).cast("long")).alias("by")
    return df.where(F.col("vector").isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"), group)


def build(corpus: DataFrame, lists: int | None = None, by: str | None = None, path: str | None = None) -> Lists:
    """Files `corpus` (id, vector and perhaps the column `by`) under centroids, as a table partitioned by list.

    Every row is filed; centroids are fitted on at most SAMPLE rows a list (a share of the range of hashed ids). The
    table is written to `path`, or below the checkpoint folder. Rows with null vectors are left out; zero vectors go to
    the first list. Repeated ids are rows of their own.
    """
    spark = corpus.sparkSession
    held = _held(corpus, "id", by)
    n = held.count()
    lists = max(1, min(lists or round(n**0.5), MOST_LISTS, max(n, 1)))
    share = min(1.0, SAMPLE * lists / max(n, 1))
    sample = held.where(F.xxhash64("id", F.lit(11)) <= F.lit(min(2**63 - 1, int(-(2**63) + share * 2**64)))).select("vector").limit(2 * SAMPLE * lists).collect()
    known = unit(np.array([r.vector for r in sample])) if sample else np.zeros((0, 1))
    known = known[np.linalg.norm(known, axis=1) > 0.5]
    centroids = fitted(known, lists) if len(known) else np.zeros((1, 1))
    shared = spark.sparkContext.broadcast(centroids)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heart = shared.value
        for batch in _slices(batches, AT_ONCE):
            near = _cosines(unit(_matrix(batch.column(1))), heart)
            own = near.argmax(1)
            angle = np.arccos(np.clip(near[np.arange(len(own)), own], -1, 1))
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(angle), *batch.columns], names=["list", "angle", "id", "vector", "by"])

    filed = held.mapInArrow(file, "list int, angle double, id long, vector array<double>, by long")
    path = path or f"{checkpoint_dir(spark).rstrip('/')}/velum-lists-{uuid.uuid4().hex}"
    filed.repartitionByRange("list", "id").write.partitionBy("list").parquet(path)
    rows = spark.read.schema("angle double, id long, vector array<double>, by long, list int").parquet(path)
    sizes, angles = np.zeros(len(centroids), np.int64), np.zeros(len(centroids))
    for r in rows.groupBy("list").agg(F.count("*").alias("n"), F.max("angle").alias("angle")).collect():
        sizes[r.list], angles[r.list] = r.n, r.angle
    return Lists(rows.drop("angle"), centroids, sizes, angles)


def _probed(queries: DataFrame, index: Lists, first: int, beyond: bool) -> DataFrame:
    """(list, id, vector, by): the lists that each query reads: the `first` nearest, or with `beyond` the others that may
    hold a row within its angle (column `angle`).
    """
    shared = queries.sparkSession.sparkContext.broadcast((index.centroids, index.angles, index.sizes))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heart, angles, sizes = shared.value
        for batch in _slices(batches, AT_ONCE):
            x = unit(_matrix(batch.column("vector")))
            near = np.where(sizes > 0, _cosines(x, heart), -2)
            place = np.empty_like(near, np.int64)
            np.put_along_axis(place, np.argsort(-near, axis=1, kind="stable"), np.arange(len(heart))[None], 1)
            wanted = (place < first) & (sizes > 0)
            if beyond:
                far = np.arccos(np.clip(near, -1, 1)) - angles[None]
                # A zero vector has the same distance to all, so no list can be left out.
                open_ = (far <= batch.column("angle").to_numpy()[:, None] + _LOOSE) | (np.linalg.norm(x, axis=1) < 0.5)[:, None] | (np.arange(len(heart)) == 0)
                wanted = ~wanted & open_ & (sizes > 0)
            i, own = np.nonzero(wanted)
            for a in range(0, len(i), OUT_ROWS):
                at = pa.array(i[a : a + OUT_ROWS])
                yield pa.RecordBatch.from_arrays([pa.array(own[a : a + OUT_ROWS].astype(np.int32)), *(batch.column(c).take(at) for c in ("id", "vector", "by"))], names=["list", "id", "vector", "by"])

    return queries.mapInArrow(work, "list int, id long, vector array<double>, by long")


def _units(index: Lists, asked: DataFrame) -> DataFrame:
    """(unit, query, id, vector, by): rows and queries of each list, in units of bounded size; every pair meets in one."""
    counts = asked.groupBy("list").agg(F.count("*").alias("q"))
    known = asked.sparkSession.createDataFrame([(i, int(n)) for i, n in enumerate(index.sizes) if n], "list int, n long")
    plan = F.broadcast(known.join(counts, "list").select("list", F.ceil(F.col("n") / UNIT_ROWS).cast("int").alias("rows"), F.ceil(F.col("q") / UNIT_QUERIES).cast("int").alias("queries")))  # a row a list
    deal = lambda df, own, other: df.join(plan, "list").withColumn("_m", F.pmod(F.xxhash64("id", F.lit(5)), F.col(own)).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
    rows = deal(index.rows, "rows", "queries").select(F.xxhash64("list", "_m", "_o").alias("unit"), F.lit(False).alias("query"), "id", "vector", "by")
    queries = deal(asked, "queries", "rows").select(F.xxhash64("list", "_o", "_m").alias("unit"), F.lit(True).alias("query"), "id", "vector", "by")
    return rows.unionAll(queries)


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each unit (sorted input)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1), len(values)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and held[-1].column(0)[0].as_py() != values[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _near(index: Lists, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, id, distance): the k nearest rows of each query in each unit that it reads."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _tables(batches):
            table = table.combine_chunks()
            query = table.column("query").to_numpy()
            if query.all() or not query.any():
                continue
            ids, by, x = table.column("id").to_numpy(), table.column("by").to_numpy(), unit(_matrix(table.column("vector").combine_chunks()))
            q = np.flatnonzero(query)
            rows = np.flatnonzero(~query)
            for a in range(0, len(q), 256):
                some = q[a : a + 256]
                d = np.where(by[some, None] == by[None, rows], 1 - x[some] @ x[rows].T, np.inf)
                kth = np.partition(d, min(k, len(rows)) - 1, axis=1)[:, min(k, len(rows)) - 1]
                i, j = np.nonzero((d <= kth[:, None]) & np.isfinite(d))
                order = np.lexsort((ids[rows][j], d[i, j], i))
                i, j = i[order], j[order]
                best = np.arange(len(i)) - np.searchsorted(i, i) < k
                yield pa.RecordBatch.from_arrays([pa.array(ids[some][i[best]]), pa.array(ids[rows][j[best]]), pa.array(d[i, j][best])], names=["query_id", "id", "distance"])

    dealt = _units(index, asked).repartition("unit").sortWithinPartitions("unit")
    return dealt.mapInArrow(work, "query_id long, id long, distance double")


def search(queries: DataFrame, index: Lists, k: int, probes: int = 8, exact: bool = False, by: str | None = None) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest rows by cosine of each query (query_id, vector), ties by id.

    Each query reads the `probes` lists nearest to it; with `exact` also every list that may hold something nearer, and the
    result is that of knn(). `by` names the column of the queries that must equal that of the index.
    """
    asked = cut(_held(queries, "query_id", by))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    found = _near(index, _probed(asked, index, probes, False), k)
    if exact:
        found = cut(found.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank"))
        kth = found.groupBy("query_id").agg(F.count("*").alias("n"), F.max("distance").alias("d")).where(F.col("n") >= k)
        limit = F.when(F.col("d").isNull(), F.lit(4.0)).otherwise(F.acos(F.greatest(F.lit(-1.0), 1 - F.col("d"))))
        open_ = asked.join(kth.select(F.col("query_id").alias("id"), "d"), "id", "left").withColumn("angle", limit)
        found = found.unionAll(_near(index, _probed(open_, index, probes, True), k))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def pairs_within(rows: DataFrame, least: float, by: str | None = None, lists: int | None = None) -> DataFrame:
    """(a, b, cosine): all pairs a < b of `rows` (id, vector) with at least this cosine, within `by` if it is given.

    Ids must not repeat. A row meets the lists that may hold such a partner. Rows that are alike by thousands are to be
    made one before, as every pair is a row of the result.
    """
    index = build(rows, lists, by)
    asked = _held(rows, "id", by).withColumn("angle", F.lit(float(np.arccos(least))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _tables(batches):
            table = table.combine_chunks()
            query = table.column("query").to_numpy()
            ids, group, x = table.column("id").to_numpy(), table.column("by").to_numpy(), unit(_matrix(table.column("vector").combine_chunks()))
            q, held = np.flatnonzero(query), np.flatnonzero(~query)
            for a in range(0, len(q), 256):
                some = q[a : a + 256]
                near = x[some] @ x[held].T
                i, j = np.nonzero((near >= least) & (group[some, None] == group[None, held]) & (ids[held][None] < ids[some, None]))
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[held][j]), pa.array(ids[some][i]), pa.array(near[i, j])], names=["a", "b", "cosine"])

    dealt = _units(index, _probed(asked, index, 0, True)).repartition("unit").sortWithinPartitions("unit")
    return dealt.mapInArrow(work, "a long, b long, cosine double")


def recall(found: DataFrame, true: DataFrame) -> float:
    """The share of the rows (query_id, id) of `true` that `found` has."""
    hits = true.select("query_id", "id").join(found.select("query_id", "id").distinct().withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    share = hits.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0]
    return 1.0 if share is None else float(share)
