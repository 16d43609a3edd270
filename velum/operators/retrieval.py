"""Exact nearest neighbours, hybrid ranking and context selection over memories."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Queries that one pass over the corpus compares; more queries take more passes.
QUERY_BLOCK = 4096
#: Queries and rows whose distances a task holds at once, and pairs whose vectors it multiplies again.
TILE_QUERIES, TILE_ROWS, PAIRS = 256, 4096, 20_000
_LOOSE = 1e-12
RRF_K = 60
#: Distinct words of all queries up to which they are kept in the plan.
MOST_ASKED = 200
# Rerank weights, and the caps of an injected context.
SHORT_BYTES, FLOOR, KEYWORD_BONUS, FINGERPRINT = 150, 0.3, 0.02, 200
CONTEXT_ITEMS, ITEM_CHARS, CONTEXT_CHARS = 3, 250, 600


class _Best:
    """The k nearest rows so far of each query of a block. Distances are held for a tile of queries and rows at a time."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, metric: str, groups: np.ndarray | None):
        self.ids, self.k, self.metric, self.groups = ids, k, metric, groups
        self.q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300) if metric == "cosine" else q
        self.d, self.i = np.full((len(ids), k), np.inf), np.zeros((len(ids), k), np.int64)

    def add(self, batch: pa.RecordBatch) -> None:
        """Rows (id, vector, group) join the nearest ones."""
        x = pc.list_flatten(batch.column(1)).to_numpy().reshape(batch.num_rows, -1)
        if self.metric == "cosine":
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        ids, of = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        for first in range(0, len(self.ids), TILE_QUERIES):
            tile = slice(first, first + TILE_QUERIES)
            d = self._distances(self.q[tile], x)
            d[np.isnan(d)] = np.inf
            if self.groups is not None:
                d[self.groups[tile, None] != of[None]] = np.inf
            if x.shape[0] > self.k:
                limit = np.minimum(self.d[tile, -1], np.partition(d, self.k - 1, axis=1)[:, self.k - 1])
            else:
                limit = self.d[tile, -1]
            i, j = np.nonzero((d <= limit[:, None] + _LOOSE) & np.isfinite(d))
            n = len(d)
            near = self._again(first + i, x, j) if self.metric == "cosine" else d[i, j]
            row = np.concatenate([np.repeat(np.arange(n), self.k), i])
            every, who = np.concatenate([self.d[tile].ravel(), near]), np.concatenate([self.i[tile].ravel(), ids[j]])
            order = np.lexsort((who, every, row))
            sorted_rows = row[order]
            order = order[np.arange(len(order)) - np.searchsorted(sorted_rows, sorted_rows) < self.k]
            self.d[tile], self.i[tile] = every[order].reshape(n, self.k), who[order].reshape(n, self.k)

    def _distances(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        if self.metric == "cosine":
            return 1 - q @ x.T
        if self.metric == "l2":
            return np.stack([np.sqrt(((x - v) ** 2).sum(1)) for v in q])
        return np.stack([np.abs(x - v).sum(1) for v in q])

    def _again(self, i: np.ndarray, x: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Cosine distances pair by pair: a product of matrices rounds equal vectors differently by their place."""
        parts = [1 - (self.q[i[a : a + PAIRS]] * x[j[a : a + PAIRS]]).sum(1) for a in range(0, len(i), PAIRS)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def found(self) -> pa.RecordBatch:
        near = np.isfinite(self.d.ravel())
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, self.k)[near]), pa.array(self.i.ravel()[near]), pa.array(self.d.ravel()[near])], names=["query_id", "id", "distance"])


def knn(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "cosine", block: int = QUERY_BLOCK, most: float | None = None, by: str | None = None) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest corpus rows of each query, ties by id.

    With `by`, a column of both, only rows of the query's own group count.

    `queries` has query_id and vector, `corpus` id, vector and perhaps filters already applied (they prune the scan).
    Queries are dealt to blocks of at most `block` by a hash of their id; each block is broadcast (block x length
    numbers at most), every corpus partition keeps k rows a query, and only those are shuffled. A task compares in tiles,
    so what it holds doesn't grow with queries or rows beyond a block. `most` drops pairs
    beyond a distance. Rows with null vectors are left out; vectors of another length raise an error.
    """
    group = (F.xxhash64(by) if by else F.lit(0).cast("long")).alias("_by")
    held = queries.where("vector IS NOT NULL").select("query_id", "vector", group)
    n = held.count()
    rounds = max(1, -(-n // block))
    spark = corpus.sparkSession
    parts = []
    rows = corpus.where("vector IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"), group)
    for r in range(rounds):
        some = held.where(F.pmod(F.xxhash64("query_id"), F.lit(rounds)) == r).collect()  # one block
        if not some:
            continue
        shared = spark.sparkContext.broadcast((np.array([x.query_id for x in some], np.int64), np.array([x.vector for x in some], np.float64), np.array([x._by for x in some], np.int64)))

        def work(batches: Iterator[pa.RecordBatch], shared=shared, by=by) -> Iterator[pa.RecordBatch]:
            ids, q, groups = shared.value
            best = _Best(ids, q, k, metric, groups if by else None)
            for batch in batches:
                for at in range(0, batch.num_rows, TILE_ROWS):
                    best.add(batch.slice(at, TILE_ROWS))
            yield best.found()

        parts.append(rows.mapInArrow(work, "query_id long, id long, distance double"))
    if not parts:
        return spark.createDataFrame([], "query_id long, id long, distance double, rank int")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionAll(p)
    if most is not None:
        found = found.where(F.col("distance") <= most)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def rerank(hits: DataFrame, limit: int) -> DataFrame:
    """(query_id, id, type, content, score, rank) from hits (query_id, query, id, type, content, distance).

    score is 1 / (1 + distance), times 0.3 up to 1 by length in bytes, plus 0.02 where the content holds the query.
    Of equal ids and of equal first 200 characters the best stays.
    """
    base = 1 / (1 + F.col("distance"))
    lengthy = FLOOR + (1 - FLOOR) * F.least(F.lit(1.0), F.octet_length("content") / SHORT_BYTES)
    bonus = F.when((F.col("query") != "") & F.contains(F.lower("content"), F.lower("query")), KEYWORD_BONUS).otherwise(0.0)
    scored = hits.withColumn("score", base * lengthy + bonus).withColumn("print", F.substring(F.trim("content"), 1, FINGERPRINT))
    first = lambda df, *by: df.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", *by).orderBy(F.desc("score"), "id"))).where("_r = 1").drop("_r")
    best = first(first(scored, "id"), "print")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= limit).select("query_id", "id", "type", "content", "score", "rank")


def fuse(*ranked: DataFrame, limit: int, k: int = RRF_K) -> DataFrame:
    """(query_id, id, score, rank): reciprocal-rank fusion of lists (query_id, id, rank)."""
    every = ranked[0].select("query_id", "id", "rank")
    for r in ranked[1:]:
        every = every.unionAll(r.select("query_id", "id", "rank"))
    score = every.groupBy("query_id", "id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))
    out = score.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return out.where(F.col("rank") <= limit)


def overfetched(limit: int) -> int:
    """How many neighbours of each type are fetched for `limit` results after reranking."""
    return max(6 * limit, 50)


def recall(queries: DataFrame, stores: dict[str, DataFrame], limit: int, types: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, id, type, content, score, rank): the nearest rows of each store, reranked together.

    `queries` has query_id, query and vector, each store id, content and vector. `types` names the stores that are
    searched (all if empty), so no type is filtered after the search.
    """
    hits = None
    for name, rows in stores.items():
        if types and name not in types:
            continue
        near = knn(queries.select("query_id", "vector"), rows.select("id", "vector"), overfetched(limit), "l2")
        near = near.join(rows.select("id", "content"), "id").join(queries.select("query_id", "query"), "query_id")
        near = near.select("query_id", "query", "id", F.lit(name).alias("type"), "content", "distance")
        hits = near if hits is None else hits.unionByName(near)
    return rerank(hits, limit)


def recall_after(hits: DataFrame, limit: int, types: tuple[str, ...], k: int = RRF_K) -> DataFrame:
    """(query_id, id, score, rank) of hits (query_id, query, id, type, content, rank) of one index over all types.

    Types are filtered after the search, among its first 3 * `limit` ranks, so fewer than `limit` may be left; the score
    is 1 / (k + rank over all types), and more by 0.02 where the content holds the query.
    """
    some = hits.where((F.col("rank") <= 3 * limit) & F.col("type").isin(*types))
    bonus = F.when((F.col("query") != "") & F.contains(F.lower("content"), F.lower("query")), KEYWORD_BONUS).otherwise(0.0)
    scored = some.withColumn("score", 1.0 / (k + F.col("rank")) + bonus)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= limit).select("query_id", "id", "score", "rank")


def hybrid(queries: DataFrame, rows: DataFrame, limit: int, depth: int = 50) -> DataFrame:
    """(query_id, id, score, rank): nearest vectors and best texts of `rows` (id, content, vector), fused by rank.

    `queries` has query_id, query and vector.
    """
    dense = knn(queries.select("query_id", "vector"), rows.select("id", "vector"), depth)
    text = text_rank(queries.select("query_id", "query"), rows.select("id", "content"), depth)
    return fuse(dense, text, limit=limit)


def words(text: Column) -> Column:
    """Lower-cased words of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1)


def text_rank(queries: DataFrame, docs: DataFrame, limit: int, k1: float = 1.2, b: float = 0.75, match_all: bool = True) -> DataFrame:
    """(query_id, id, score, rank): BM25 of docs (id, content) for queries (query_id, query).

    With `match_all` a document must hold every distinct word of the query. Corpus counts cover all documents; only
    words of the queries are counted by document, and terms are joined by word.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(words(F.col("query")))).alias("word"))
    need = asked.groupBy("query_id").agg(F.count("*").alias("need"))
    sized = docs.select("id", words(F.col("content")).alias("w")).withColumn("size", F.size("w"))
    whole = sized.agg(F.count("*").alias("n_docs"), F.avg("size").alias("mean"))
    wanted = asked.select("word").distinct()
    few = wanted.limit(MOST_ASKED + 1).collect()
    if len(few) <= MOST_ASKED:  # the words of a few queries are looked for before anything is exploded
        known = F.array(*(F.lit(r.word) for r in few)).cast("array<string>")
        terms = sized.select("id", "size", F.explode_outer(F.filter("w", lambda x: F.array_contains(known, x))).alias("word")).where("word IS NOT NULL")
    else:
        terms = sized.select("id", "size", F.explode_outer("w").alias("word")).join(wanted, "word", "left_semi")
    terms = terms.groupBy("word", "id").agg(F.first("size").alias("size"), F.count("*").alias("tf"))
    spread = terms.groupBy("word").agg(F.count("*").alias("df"))
    joined = asked.join(terms, "word").join(spread, "word").crossJoin(F.broadcast(whole))  # one row
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.col("mean")))
    score = joined.groupBy("query_id", "id").agg(F.sum(part).alias("score"), F.count("*").alias("held")).join(need, "query_id")
    if match_all:
        score = score.where("held = need")
    out = score.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")))
    return out.where(F.col("rank") <= limit).select("query_id", "id", "score", "rank")


def context(hits: DataFrame, items: int = CONTEXT_ITEMS, item_chars: int = ITEM_CHARS, total_chars: int = CONTEXT_CHARS) -> DataFrame:
    """(query_id, id, line, rank) chosen from hits (query_id, query, id, type, role, content, rank).

    Episodic hits of other roles than user, echoes of the query and repeats (case and white space aside) go; the first
    `items` are cut to `item_chars`, tagged, and kept while the running length stays within `total_chars`.
    """
    plain = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")
    usable = hits.where((F.col("type") != "episodic") | F.col("role").isNull() | (F.col("role") == "user")).withColumn("key", plain(F.col("content")))
    usable = usable.where(F.col("key") != plain(F.substring("query", 1, 500)))
    once = usable.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "key").orderBy("rank", "id"))).where("_r = 1")
    top = once.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "id"))).where(F.col("_n") <= items)
    tag = F.when(F.col("type") != "episodic", F.concat(F.lit("("), "type", F.lit(")"))).when(F.trim("content").rlike(r"\?$"), "(user previously asked)").otherwise("(user previously said)")
    short = F.when(F.char_length("content") > item_chars, F.concat(F.substring("content", 1, item_chars), F.lit("…"))).otherwise(F.col("content"))
    lined = top.withColumn("line", F.concat(F.lit("- "), tag, F.lit(": "), short))
    running = F.sum(F.char_length("line")).over(Window.partitionBy("query_id").orderBy("_n"))
    return lined.withColumn("_total", running).where(F.col("_total") <= total_chars).select("query_id", "id", "line", F.col("_n").alias("rank"))


def hash_embed(text: Column, dims: int = 64) -> Column:
    """A unit vector of signed word counts hashed to `dims` places (all zero without words): an embedder without a model."""
    hashed = F.transform(words(text), lambda w: F.xxhash64(w))
    place = lambda i: F.aggregate(
        F.filter(hashed, lambda h: F.pmod(h, F.lit(dims)) == i), F.lit(0.0), lambda s, h: s + F.when(F.shiftright(h, 32).bitwiseAND(1) == 1, 1.0).otherwise(-1.0)
    )
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), place)


def embedded(rows: DataFrame, text: str = "content", dims: int = 64) -> DataFrame:
    """`rows` with vector: hash_embed() of a text column, divided by its length."""
    from velum.functions import vectors

    raw = rows.withColumn("_v", hash_embed(F.col(text), dims))
    return raw.withColumn("_n", vectors.norm(F.col("_v"))).withColumn("vector", F.when(F.col("_n") > 0, F.transform("_v", lambda x: x / F.col("_n"))).otherwise(F.col("_v"))).drop("_v", "_n")
