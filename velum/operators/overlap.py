"""Pairs of word sets by Jaccard overlap: prefixes of rare words, bitmaps against chance meetings, whole sets compared in tasks.

Words are numbered by how rare they are. Sets that overlap by a share `least` share one of the rarest words of either, so
sets meet by those words only, in units of bounded size; what meets is screened by bitmaps and compared where it meets.
Nothing is emitted for a pair but the result, and each pair is found in one unit, that of its rarest common word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velum.io import cut
from velum.operators.neighbours import _tables

#: Rows of a block; the sets of a word are cut into blocks, and each unit holds two of them at most.
BLOCK_ROWS = 4096
#: 64-bit words of a bitmap, and rows of one side compared at once.
BITMAP, AT_ONCE = 4, 256


def set_key(words: Column) -> Column:
    """What equal sets of words, each word once and sorted, have in common; null for null."""
    return F.sha2(F.array_join(F.transform(words, lambda x: F.concat(F.char_length(x).cast("string"), F.lit(":"), x)), ""), 256)


def _sets(keyed: DataFrame) -> DataFrame:
    """(set, key, n, w): the distinct sets of rows (key, w), numbered."""
    once = keyed.groupBy("key").agg(F.any_value("w").alias("w"))
    return cut(once.select(F.monotonically_increasing_id().alias("set"), "key", F.size("w").cast("long").alias("n"), "w"))


def numbered(words: DataFrame) -> DataFrame:
    """(word, number): each word (word, once a set that holds it) once, numbered from the rarest on with gaps."""
    df = words.groupBy("word").agg(F.count("*").alias("df"))
    return cut(df.orderBy("df", "word").select("word", F.monotonically_increasing_id().alias("number")))


def _prefix(n: Column, share: float) -> Column:
    """How many of the rarest words of a set of n to take, so that one is shared where `share` of the set is."""
    return (n - F.ceil(n * (share * (1 - 1e-9)) - 1e-9) + 1).cast("int")


def _filed(sets: DataFrame, numbers: DataFrame) -> DataFrame:
    """(set, n, w): the numbers of the known words of each set (set, n, w), the rarest first."""
    return sets.select("set", "n", F.explode("w").alias("word")).join(numbers, "word").groupBy("set", "n").agg(F.array_sort(F.collect_list("number")).alias("w"))


def _units(rows: DataFrame) -> DataFrame:
    """(unit, probe, word, set, n, w) of rows (word, left, right, ...): each unit holds a block of the left (probe) and of the right rows of a word."""
    blocks = lambda c: F.ceil(F.count_if(c) / BLOCK_ROWS).cast("int")
    joined = rows.join(rows.groupBy("word").agg(blocks("left").alias("_l"), blocks("right").alias("_r")).where("_l > 0 AND _r > 0"), "word")
    own = lambda n: F.pmod(F.xxhash64("set", F.lit(5)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    at = lambda a, b, probe: (F.xxhash64("word", a, b).alias("unit"), F.lit(probe).alias("probe"), "word", "set", "n", "w")
    left = joined.where(F.col("left")).withColumn("_o", every("_r")).select(*at(own("_l"), F.col("_o"), True))
    right = joined.where(F.col("right")).withColumn("_o", every("_l")).select(*at(F.col("_o"), own("_r"), False))
    return left.unionAll(right)


def _bitmaps(flat: np.ndarray, of: np.ndarray, rows: int) -> np.ndarray:
    """A bit for each word of each row, at a place that its number gives."""
    out = np.zeros((rows, BITMAP), np.uint64)
    with np.errstate(over="ignore"):
        place = (flat.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (BITMAP * 64 - 1).bit_length())
    np.bitwise_or.at(out, (of, (place >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (place & np.uint64(63)))
    return out


class _Sets:
    """The sets of one side of a unit: numbers of words, true sizes, bitmaps."""

    def __init__(self, table: pa.Table):
        lists = table.column("w").combine_chunks()
        self.word = table.column("word").to_numpy()
        self.set, self.n = table.column("set").to_numpy(), table.column("n").to_numpy().astype(np.int64)
        self.flat = pc.list_flatten(lists).to_numpy()
        self.known = pc.list_value_length(lists).to_numpy().astype(np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.known)])
        self.bits = _bitmaps(self.flat, np.repeat(np.arange(len(self.n)), self.known), len(self.n))

    def pairs(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in `i`, number) of all words of the rows `i`."""
        size = self.known[i]
        at = np.repeat(self.start[i] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        return np.repeat(np.arange(len(i)), size), self.flat[at]


def _common(x: _Sets, i: np.ndarray, y: _Sets, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(common words, number of the rarest of them) of the rows i of x and j of y, pair by pair."""
    (a, v), (b, w) = x.pairs(i), y.pairs(j)
    both = np.lexsort((np.concatenate([v, w]), np.concatenate([a, b])))
    pair, word = np.concatenate([a, b])[both], np.concatenate([v, w])[both]
    same = np.flatnonzero((pair[1:] == pair[:-1]) & (word[1:] == word[:-1]))
    shared = np.bincount(pair[same], minlength=len(i))
    rarest = np.full(len(i), np.iinfo(np.int64).max)
    np.minimum.at(rarest, pair[same], word[same])
    return shared, rarest


def _meeting(x: _Sets, y: _Sets, least: float, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of x, rows of y, overlap) of the pairs that reach `least` and whose rarest common word is that of the unit."""
    for first in range(0, len(x.n), AT_ONCE):
        rows = np.arange(first, min(first + AT_ONCE, len(x.n)))
        n = x.n[rows, None] + y.n[None]
        # Words in only one of two sets: at least the bits by which their bitmaps differ, and the words without a number.
        apart = np.zeros(n.shape, np.int64)
        for k in range(BITMAP):
            apart += np.bitwise_count(x.bits[rows, k, None] ^ y.bits[None, :, k])
        apart += (x.n - x.known)[rows, None] + (y.n - y.known)[None]
        apart = np.maximum(apart, np.abs(x.n[rows, None] - y.n[None]))
        # Overlap s of n words together: s / (n - s) >= least, where s = (n - apart) / 2 at most.
        fits = (n - apart) * (1 + 1e-9) + 1e-9 >= least * (n + apart)
        if own:
            fits &= (x.n[rows, None] > y.n[None]) | ((x.n[rows, None] == y.n[None]) & (x.set[rows, None] > y.set[None]))
        i, j = np.nonzero(fits)
        for a in range(0, len(i), 20_000):
            p, q = rows[i[a : a + 20_000]], j[a : a + 20_000]
            shared, rarest = _common(x, p, y, q)
            share = shared / (x.n[p] + y.n[q] - shared)
            good = (share >= least - 1e-12) & (rarest == x.word[p]) & (rarest == y.word[q])
            yield p[good], q[good], share[good]


def _found(rows: DataFrame, least: float, own: bool) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _tables(batches):
            probe = table.column("probe")
            left, right = table.filter(probe), table.filter(pc.invert(probe))
            if not left.num_rows or not right.num_rows:
                continue
            x, y = _Sets(left), _Sets(right)
            for p, q, share in _meeting(x, y, least, own):
                if len(p):
                    yield pa.RecordBatch.from_arrays([pa.array(x.set[p]), pa.array(y.set[q]), pa.array(share)], names=["x", "y", "jaccard"])

    dealt = _units(rows).repartition("unit").sortWithinPartitions("unit")
    return dealt.mapInArrow(work, "x long, y long, jaccard double")


def within(rows: DataFrame, words: Column, least: float) -> tuple[DataFrame, DataFrame]:
    """((id, set) of `rows`, (x, y, jaccard)): distinct word sets, and their pairs, each in one order, with overlap of `least` (above 0) or more.

    Rows (id, ...) without words are left out. A pair is looked for from its larger set: that shares one of its
    n - ceil(least * n) + 1 rarest words with one of the n - ceil(2 * least / (1 + least) * n) + 1 rarest of the smaller.
    """
    made = rows.select("id", F.array_sort(F.array_distinct(words)).alias("w")).where(F.size("w") > 0).select("id", set_key(F.col("w")).alias("key"), "w")
    sets = _sets(made.select("key", "w"))
    filed = cut(_filed(sets, numbered(sets.select(F.explode("w").alias("word")))))
    probe, held = _prefix(F.col("n"), least), _prefix(F.col("n"), 2 * least / (1 + least))
    entries = filed.select("set", "n", "w", held.alias("_h"), F.posexplode(F.slice("w", F.lit(1), probe)).alias("_p", "word"))
    entries = entries.select("set", "n", "w", "word", F.lit(True).alias("left"), (F.col("_p") < F.col("_h")).alias("right"))
    return made.select("id", "key").join(sets.select("set", "key"), "key").select("id", "set"), _found(entries, least, True)


def meeting(asked: DataFrame, held: DataFrame, least: float) -> DataFrame:
    """(key, other, jaccard): pairs of sets of `asked` and of `held` (key by set_key(), w) with overlap of `least` (above 0) or more.

    Only sets of `asked` of a size that fits some held set are taken apart, and only their words that a held set has.
    """
    have = _sets(held.where(F.size("w") > 0).select("key", "w"))
    sizes = have.agg(F.min("n").alias("_a"), F.max("n").alias("_b"))
    loose = least * (1 - 1e-9)
    fits = (F.size("w") * loose <= F.col("_b")) & (F.size("w") >= F.col("_a") * loose)
    want = _sets(asked.where(F.size("w") > 0).crossJoin(F.broadcast(sizes)).where(fits).select("key", "w"))  # one row is broadcast
    numbers = numbered(have.select(F.explode("w").alias("word")))
    some = F.greatest(F.lit(0), _prefix(F.col("n"), least) - (F.col("n").cast("int") - F.size("w")))  # words that no held set has come first
    of = lambda sets, left: _filed(sets, numbers).select("set", "n", "w", F.explode(F.slice("w", F.lit(1), some)).alias("word"), F.lit(left).alias("left"), F.lit(not left).alias("right"))
    found = _found(of(want, True).unionAll(of(have, False)), least, False)
    named = found.join(want.select(F.col("set").alias("x"), "key"), "x").join(have.select(F.col("set").alias("y"), F.col("key").alias("other")), "y")
    return named.select("key", "other", "jaccard")
