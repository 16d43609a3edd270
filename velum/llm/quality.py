"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text.

All grades share one weight per hashed feature; ordered thresholds t1 < t2 < ... cut the line: P(grade >= k) is
sigmoid(w.x - tk). The expected grade is the sum of these tails, and a tail probability selects documents.
Features are shares: words, pairs of equal neighbouring words, bytes between words and pairs of such bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velum.llm.common import WORD_BYTE, blocks, flat, map_batches, mix, prefix_hash, span_hash, utf8, words_of
from velum.llm.samples import bounded

BITS = 16
#: Rated documents that the model is fitted on at most.
MOST_TRAIN = 6000
#: A document is kept if P(grade >= KEEP_GRADE) is at least KEEP_PROBABILITY.
KEEP_GRADE, KEEP_PROBABILITY = 1, 0.5


def bag(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, document index), kind by kind, for a block of lower-cased texts."""
    start, end, owner = words_of(raw, offsets)
    word = span_hash(prefix_hash(raw), start, end)
    yield (word >> np.uint64(64 - BITS)).astype(np.int64), owner
    same = np.flatnonzero((word[1:] == word[:-1]) & (owner[1:] == owner[:-1])) + 1
    yield np.zeros(len(same), np.int64), owner[same]
    marks = np.flatnonzero(~WORD_BYTE[raw])
    of = np.searchsorted(offsets, marks, "right") - 1
    byte = raw[marks].astype(np.uint64)
    yield (mix(byte + np.uint64(1 << 32)) >> np.uint64(64 - BITS)).astype(np.int64), of
    near = np.flatnonzero((marks[1:] == marks[:-1] + 1) & (of[1:] == of[:-1]))
    yield (mix(byte[near] << np.uint64(8) | byte[near + 1] | np.uint64(1 << 33)) >> np.uint64(64 - BITS)).astype(np.int64), of[near]


def counted(raw: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, counts) of every document."""
    kinds = list(bag(raw, offsets))
    key, count = np.unique(np.concatenate([owner << BITS | bucket for bucket, owner in kinds]), return_counts=True)
    cuts = np.searchsorted(key >> BITS, np.arange(len(offsets)))
    return [(key[a:b] & ((1 << BITS) - 1), count[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], grades: int, epochs: int = 20, rate: float = 0.3, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(weight of each bucket, ascending thresholds) by Adagrad on the ordinal log-likelihood.

    Thresholds are kept in order as a first one and positive gaps (exp), so tails never cross.
    """
    rng = np.random.default_rng(seed)
    w, w_sum = np.zeros(1 << BITS), np.full(1 << BITS, 1e-8)
    gaps, gaps_sum = np.zeros(grades - 1), np.full(grades - 1, 1e-2)
    bags = [(i, c / c.sum() if len(c) else c.astype(float), y) for i, c, y in rows]
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for j in rng.permutation(len(bags)):
            buckets, share, y = bags[j]
            cuts = gaps[0] + np.concatenate([[0], np.cumsum(np.exp(gaps[1:]))])
            tail = np.concatenate([[1.0], sig(share @ w[buckets] - cuts), [0.0]])
            p = max(tail[y] - tail[y + 1], 1e-9)
            bend = tail * (1 - tail)
            slope = -(bend[y] - bend[y + 1]) / p  # of the loss by w.x
            by_cut = np.zeros(grades + 1)
            by_cut[y], by_cut[y + 1] = bend[y] / p, -bend[y + 1] / p
            by_cut = by_cut[1:-1]
            by_gap = np.cumsum(by_cut[::-1])[::-1] * np.concatenate([[1.0], np.exp(gaps[1:])])
            gaps_sum += by_gap**2
            gaps -= 0.3 * step * by_gap / np.sqrt(gaps_sum)
            if len(buckets):
                g = slope * share
                w_sum[buckets] += g * g
                w[buckets] -= step * g / np.sqrt(w_sum[buckets])
    return w, gaps[0] + np.concatenate([[0], np.cumsum(np.exp(gaps[1:]))])


def tails(raw: np.ndarray, offsets: np.ndarray, w: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """P(grade >= k) for k = 1, 2, ... (columns) of each text of a block (rows)."""
    n = len(offsets) - 1
    total, count = np.zeros(n), np.zeros(n)
    for bucket, owner in bag(raw, offsets):
        total += np.bincount(owner, w[bucket], n)
        count += np.bincount(owner, minlength=n)
    z = total / np.maximum(count, 1)
    return 1 / (1 + np.exp(-np.clip(z[:, None] - cuts, -30, 30)))


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) from the binary labels: 0 for low quality, 1 for good but toxic texts, 2 for good ones."""
    return labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", F.when(F.col("quality") == 0, 0).when(F.coalesce("toxic", F.lit(0)) == 1, 1).otherwise(2).alias("grade"))


def train(docs: DataFrame, ratings: DataFrame, grades: int = 3, most: int = MOST_TRAIN) -> tuple[np.ndarray, np.ndarray]:
    """Fits on at most `most` rated rows (bounded()); `ratings` has doc_id and grade (0 to grades - 1)."""
    rows = bounded(ratings.groupBy("doc_id").agg(F.max("grade").cast("int").alias("y")), "doc_id", most)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, raw, offsets in blocks(*flat(batch.column(1))):
                got = counted(raw, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(got)), pa.array([b.astype("<i4").tobytes() for b, _ in got], pa.binary()), pa.array([c.astype("<i4").tobytes() for _, c in got], pa.binary())], names=["y", "buckets", "counts"])

    joined = docs.select("doc_id", utf8(lower=True).alias("_text")).join(F.broadcast(rows), "doc_id")  # at most `most` rows
    found = map_batches(joined.select("y", "_text"), work, "y int, buckets binary, counts binary").collect()
    return fit([(np.frombuffer(r.buckets, "<i4"), np.frombuffer(r.counts, "<i4"), int(r.y)) for r in sorted(found, key=lambda r: (r.buckets, r.y))], grades)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], keep_grade: int = KEEP_GRADE, keep: float = KEEP_PROBABILITY, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, expected_grade, p_keep, kept, *carry) for each row of `docs`, from its whole text.

    Map only: no shuffle. A null or empty text is judged as an empty bag (the thresholds alone). Equal texts get equal
    scores, other columns are dropped unless named in `carry`, an empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    extra = [docs.schema[c] for c in carry]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, cuts = shared.value
        for batch in batches:
            got = [tails(raw, offsets, w, cuts) for _, raw, offsets in blocks(*flat(batch.column(1)))]
            p = np.concatenate(got) if got else np.zeros((0, len(cuts)))
            chosen = p[:, keep_grade - 1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p.sum(1)), pa.array(chosen), pa.array(chosen >= keep), *batch.columns[2:]],
                names=["doc_id", "expected_grade", "p_keep", "kept", *carry],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind}, expected_grade double, p_keep double, kept boolean", *(f"`{f.name}` {f.dataType.simpleString()}" for f in extra)])
    return map_batches(docs.select(F.col("doc_id"), utf8(lower=True).alias("_text"), *(F.col(f"`{c}`") for c in carry)), work, schema)
