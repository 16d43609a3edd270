"""Shared pieces of the corpus operators: scratch tables, Arrow batches, word hashes, components and block pairs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch and of a Parquet reader's batch; texts may be long, so fewer than Spark's defaults.
BATCH_ROWS = 500
#: Bytes that the numpy helpers treat at once (a longer text is treated alone).
BLOCK_BYTES = 1 << 20


# --- scratch tables ---------------------------------------------------------------------------------------------------


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only where a local session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="velum-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/velum-{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared scratch folder and read again: a cut in the lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._velum_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what stored() wrote for `df`; nothing may read it afterwards."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._velum_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


# --- Arrow batches ----------------------------------------------------------------------------------------------------


def map_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with batches small enough for long texts, from the scan on."""
    for key in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"):
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    return df.mapInArrow(work, schema)


def utf8(column: str = "text", lower: bool = False) -> Column:
    """The column as UTF-8 bytes, null as empty."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return (F.lower(text) if lower else text).cast("binary")


def flat(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary array without nulls; text i is bytes[offsets[i]:offsets[i + 1]]."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    wide = pa.types.is_large_binary(array.type)
    _, at, data = array.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(raw: np.ndarray, offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Whole texts in blocks of about `limit` bytes: (index of the first text, bytes, offsets)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def runs(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Consecutive rows of equal `key` as tables; the input must be sorted by it within the partition."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1), len(values)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and values[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = values[a]
    if held:
        yield pa.Table.from_batches(held)


# --- hashes -----------------------------------------------------------------------------------------------------------

_ODD = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(30))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, BLOCK_BYTES + 1)
        with np.errstate(over="ignore"):
            for name, base in (("up", _ODD), ("down", pow(_ODD, -1, 1 << 64))):
                table = np.full(size, base, np.uint64)
                table[0] = 1
                _powers[name] = np.multiply.accumulate(table)
    return _powers["up"][:n], _powers["down"][:n]


#: A fixed 64-bit value for each byte, from a rule.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """Sums S with len(raw) + 1 entries for span_hash()."""
    up, _ = _power_tables(len(raw) + 1)
    out = np.zeros(len(raw) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(BYTE_VALUES[raw] * up[:-1], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of raw[start:end], the same wherever the bytes stand."""
    _, down = _power_tables(len(sums))
    with np.errstate(over="ignore"):
        return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


#: Bytes of words: digits, a to z and all beyond ASCII.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[ord("0") : ord("9") + 1] = WORD_BYTE[ord("a") : ord("z") + 1] = WORD_BYTE[128:] = True


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text index) of every word in a block of lower-cased texts."""
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = WORD_BYTE[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begins = offsets[:-1][offsets[:-1] < n]
    first[begins] |= inside[begins]
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] |= inside[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


# --- connected components ---------------------------------------------------------------------------------------------


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(id, root): the smallest id that each id of `edges` (a, b long) reaches. Large-star and small-star rounds.

    Each round is two grouped minima and two joins against them. Minima are combined before the shuffle; they are
    written, so that in the join a hub with very many edges is a plain shuffle partition which adaptive execution can
    split. Only a fingerprint of the edges reaches the driver.
    """

    def stars(pairs: DataFrame, both: bool) -> DataFrame:
        around = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both else pairs
        least = stored(around.groupBy("a").agg(F.min("b").alias("m")), "least")
        hung = around.join(least, "a").select("a", "b", F.least("a", "m").alias("m"))
        if both:
            out = hung.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            up = hung.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            out = up.unionAll(least.select("a", F.col("m").alias("b")))
        out = stored(out.where("a != b").distinct(), "edges")
        discard(least)
        discard(pairs)
        return out

    def fingerprint(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())

    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b")
    now = stored(down.distinct(), "edges")
    was = None
    for _ in range(most):
        mark = fingerprint(now)
        if mark == was or not mark[0]:
            break
        was = mark
        now = stars(stars(now, True), False)
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("root"))
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")).unionAll(roots)


def link_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For n items, the smallest item that each reaches through the links left[i] - right[i]."""
    root = np.arange(n)
    while len(left):
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        np.minimum.at(root, before[left], low)
        np.minimum.at(root, before[right], low)
        root = root[root]
        if np.array_equal(root, before):
            break
    return root


# --- block pairs ------------------------------------------------------------------------------------------------------


def block_units(rows: DataFrame, key: str, order: str, count: str, per_block: int) -> DataFrame:
    """Deals the rows of each `key` to units in which any two of them meet exactly once per pair of blocks.

    Up to `per_block` rows make one unit. A larger key is split by a hash of `order` into `count` / `per_block` blocks,
    and each pair of blocks is a unit of its own, so that no task holds a whole large key.
    Adds: unit long, side int (0: first block, 1: second), alone boolean (the unit is one block against itself).
    """
    n = F.ceil(F.col(count) / F.lit(per_block)).cast("int")
    mine = F.pmod(F.xxhash64(order), F.greatest(n, F.lit(1)).cast("long")).cast("int")
    dealt = rows.withColumn("_n", F.greatest(n, F.lit(1))).withColumn("_b", mine)
    dealt = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    low, high = F.least("_b", "_o"), F.greatest("_b", "_o")
    return (
        dealt.withColumn("unit", F.xxhash64(F.col(key), low, high))
        .withColumn("side", (F.col("_b") > F.col("_o")).cast("int"))
        .withColumn("alone", F.col("_b") == F.col("_o"))
        .drop("_n", "_b", "_o")
    )
