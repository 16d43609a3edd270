"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A document is the bag of its words and of their character n-grams (with word boundaries), each hashed to one of
2 ** BITS rows of an embedding table. The mean row, rare features weighing more, goes through a linear two-class softmax.
Table and softmax are fitted together, so a misspelling that was never seen is judged by the n-grams it shares with what was.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velum.llm.common import WORD_BYTE, blocks, discard, flat, map_batches, mix, prefix_hash, span_hash, stored, utf8, words_of
from velum.llm.samples import bounded, train_side

BITS, DIM, GRAMS = 18, 12, (3, 4, 5)
#: Labelled documents that the model is fitted on at most.
MOST_TRAIN = 6000
#: Features in fewer training documents than this are left out.
LEAST_DOCS = 3
THRESHOLD = 0.3
_ALL = (1 << 64) - 1


def bag(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, document index), kind by kind, for a block of lower-cased texts."""
    n = len(offsets) - 1
    docs = np.repeat(np.arange(n), np.diff(offsets))
    padded = np.full(len(raw) + n + 1, 32, np.uint8)
    place = np.arange(len(raw)) + docs + 1
    padded[place] = raw
    owner = np.zeros(len(padded), np.int64)
    owner[place] = docs
    inside = WORD_BYTE[padded]
    padded[~inside] = 32
    so_far = np.concatenate([[0], np.cumsum(inside)])
    wide = padded.astype(np.uint64)
    packed = wide
    for k in range(2, max(GRAMS) + 1):
        if k > len(wide):
            break
        packed = packed[:-1] | wide[k - 1 :] << np.uint64(8 * (k - 1))
        if k in GRAMS:
            at = np.flatnonzero(so_far[k - 1 : len(wide)] - so_far[1 : len(wide) - k + 2] == k - 2)
            yield (mix(packed[at] ^ np.uint64(k * 0x9E3779B97F4A7C15 & _ALL)) >> np.uint64(64 - BITS)).astype(np.int64), owner[at + 1]
    start, end, owner_of = words_of(raw, offsets)
    yield (span_hash(prefix_hash(raw), start, end) >> np.uint64(64 - BITS)).astype(np.int64), owner_of


def counted(raw: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, counts) of every document."""
    kinds = list(bag(raw, offsets))
    key = np.concatenate([owner << BITS | bucket for bucket, owner in kinds])
    key, count = np.unique(key, return_counts=True)
    cuts = np.searchsorted(key >> BITS, np.arange(len(offsets)))
    return [(key[a:b] & ((1 << BITS) - 1), count[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], totals: np.ndarray | None = None, epochs: int = 8, rate: float = 1.0, seed: int = 7) -> tuple[np.ndarray, float]:
    """(value of each bucket, bias): the log-odds of a document are the mean value of its bag plus the bias.

    The embedding table and the softmax are trained together by Adagrad, one document a step. Since the softmax is
    linear, table times softmax weights is one value a bucket, which is all that scoring needs. A fifth of the rows
    doesn't train but sets the scale and the bias of the log-odds. `totals` are the sizes of the whole bags, for rows
    from which rare features have been left out already. Counts in `rows` give way to weights, so that no second copy
    of the bags is held.
    """
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    weights = rng.normal(0, 1, (2, DIM)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    table_sum, weight_sum = np.full(1 << BITS, 1e-8, np.float32), np.full((2, DIM), 1e-2, np.float32)
    held = np.arange(len(rows)) % 5 == 4 if len(rows) >= 50 else np.zeros(len(rows), bool)
    spread = np.zeros(1 << BITS, np.int64)
    for i, _, _ in rows:
        spread[i] += 1
    common = spread >= LEAST_DOCS
    weight = np.where(common, np.log((1 + len(rows)) / (1 + spread)), 0).astype(np.float32)
    if totals is None:
        totals = np.array([int(c.sum()) for _, c, _ in rows])
    bags = rows
    for j, ((i, c, y), total) in enumerate(zip(rows, totals, strict=True)):
        some = weight[i] > 0
        bags[j] = i[some], (c[some] / max(1, int(total)) * weight[i[some]]).astype(np.float32), y
    train = np.flatnonzero(~held)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for j in rng.permutation(train):
            buckets, share, y = bags[j]
            if not len(buckets):
                continue
            mean = share @ table[buckets]
            z = weights @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = p @ weights
            outer = np.outer(p, mean)
            weight_sum += outer * outer
            weights -= step * outer / np.sqrt(weight_sum)
            bias -= 0.05 * step * p
            table_sum[buckets] += (share * share) * float(back @ back)
            table[buckets] -= np.outer(step * share / np.sqrt(table_sum[buckets]), back)
    value = (table @ (weights[1] - weights[0])).astype(np.float64)
    some = np.flatnonzero(held) if held.any() else train
    raw = np.array([float(bags[j][1] @ value[bags[j][0]]) if len(bags[j][0]) else 0.0 for j in some])
    return _calibrated(value * weight, raw, np.array([bags[j][2] for j in some], float))


def _calibrated(value: np.ndarray, raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Scale and bias of the log-odds by a logistic fit with a weak prior (Newton steps)."""
    if not len(raw) or y.min() == y.max():
        return value, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    middle, spread = raw.mean(), raw.std() or 1.0
    x = np.stack([(raw - middle) / spread, np.ones(len(raw))], 1)
    w = np.array([1.0, np.log((y.sum() + 1) / (len(y) - y.sum() + 1))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + np.array([0.05 * w[0], 0])
        bend = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag([0.05, 1e-6])
        w -= np.clip(np.linalg.solve(bend, slope), -0.5, 0.5)
    scale = max(w[0], 0.05) / spread
    return value * scale, float(w[1] - scale * middle)


def scores(raw: np.ndarray, offsets: np.ndarray, value: np.ndarray, bias: float) -> np.ndarray:
    """Probability of the toxic class for each text of a block."""
    n = len(offsets) - 1
    total, count = np.zeros(n), np.zeros(n)
    for bucket, owner in bag(raw, offsets):
        total += np.bincount(owner, value[bucket], n)
        count += np.bincount(owner, minlength=n)
    return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + bias, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MOST_TRAIN) -> tuple[np.ndarray, float]:
    """Fits on at most `most` labelled training rows (bounded()); their bags, not their texts, reach the driver.

    A first pass counts the documents of each feature, a second leaves out the rare ones where the bags are, so the
    driver gets only what the fit uses, one partition at a time. A repeated document row counts as often as it occurs.
    """
    rows = labels.where(train_side() & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("y"))
    rows = bounded(rows.groupBy("doc_id").agg(F.max("y").alias("y")), "doc_id", most)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, raw, offsets in blocks(*flat(batch.column(1))):
                got = counted(raw, offsets)
                y = batch.column(0).slice(i, len(got))
                yield pa.RecordBatch.from_arrays([y, pa.array([b.astype("<i4").tobytes() for b, _ in got], pa.binary()), pa.array([c.astype("<u4").tobytes() for _, c in got], pa.binary())], names=["y", "buckets", "counts"])

    joined = docs.select("doc_id", utf8(lower=True).alias("_text")).join(F.broadcast(rows), "doc_id")  # at most `most` rows
    bags = stored(map_batches(joined.select("y", "_text"), work, "y int, buckets binary, counts binary"), "bags")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for b in batch.column(0):
                seen[np.frombuffer(b.as_py(), "<i4")] += 1
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], names=["bucket", "n"])

    counts = map_batches(bags.select("buckets"), spread, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    common = np.zeros(1 << BITS, bool)
    common[[r.bucket for r in counts.where(F.col("n") >= LEAST_DOCS).select("bucket").collect()]] = True  # at most 2 ** BITS

    def used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(np.frombuffer(b.as_py(), "<i4"), np.frombuffer(c.as_py(), "<u4")) for b, c in zip(batch.column(1), batch.column(2), strict=True)]
            total = pa.array([int(c.sum()) for _, c in got], pa.int64())
            kept = [(b[common[b]], c[common[b]]) for b, c in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), total, pa.array([b.tobytes() for b, _ in kept], pa.binary()), pa.array([c.tobytes() for _, c in kept], pa.binary())], names=["y", "total", "buckets", "counts"])

    found = map_batches(bags, used, "y int, total long, buckets binary, counts binary")
    rows = sorted((r.buckets, r.counts, r.total, r.y) for r in found.toLocalIterator())  # a partition at a time
    discard(bags)
    totals = np.array([r[2] for r in rows], np.int64)
    for i, (buckets, counts, _, y) in enumerate(rows):
        rows[i] = np.frombuffer(buckets, "<i4"), np.frombuffer(counts, "<u4"), int(y > 0)
    return fit(rows, totals)


def score(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of `docs`, from its whole text alone.

    Map only: no shuffle. A null or empty text gets the score of an empty bag, which is the bias; equal texts get equal
    scores. Repeated rows and extra columns don't matter, an empty table gives an empty table.
    """
    value = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = value.value
        for batch in batches:
            got = [scores(raw, offsets, table, bias) for _, raw, offsets in blocks(*flat(batch.column(2)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(got) if got else np.zeros(0))], names=["doc_id", "held_out", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = map_batches(docs.select("doc_id", (~train_side()).alias("held_out"), utf8(lower=True).alias("_text")), work, f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
