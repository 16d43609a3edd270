"""Graphs settled in few rounds of joins: levels of trees by pointer doubling, first choices along an order in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velum.io import cut

#: Links that a task of heads() settles at once; rounds are at most as many as there are such blocks.
BLOCK_LINKS = 200_000


def levels(rows: DataFrame) -> DataFrame:
    """(id, level): the distance of each row (id, parent; ids don't repeat, but for null) from its root, a row without parent.

    Every row holds an ancestor and how far it is; a round joins that to the ancestor's own, so distances double and a
    chain of n rows takes log n rounds. Rows that no root reaches (a missing parent, a loop) have no level.
    """
    now = cut(rows.select("id", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("far")))
    most = now.count()
    reach = 1
    while reach <= 2 * most and not now.where("up IS NOT NULL").isEmpty():
        above = now.where("id IS NOT NULL").select(F.col("id").alias("up"), F.col("up").alias("upper"), F.col("far").alias("further"))
        moved = now.where("up IS NOT NULL").join(above, "up").select("id", F.col("upper").alias("up"), (F.col("far") + F.col("further")).alias("far"))
        now = cut(now.where("up IS NULL").unionAll(moved))
        reach *= 2
    return now.where("up IS NULL").select("id", F.col("far").cast("int").alias("level"))


def heads(links: DataFrame, block: int = BLOCK_LINKS) -> DataFrame:
    """(id, head): the first choice along the order of id: an id is a head unless an earlier head is linked to it.

    `links` holds (a, b), a < b, long; every id in it is in the result. Ids are dealt to tasks in ranges. A task goes
    through its links in order and settles all whose earlier neighbours are settled, so a round moves whole ranges on
    and the longest path of ids doesn't count: after n rounds the first n ranges are settled at the latest.
    """
    pairs = cut(links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a < b").distinct())
    later = pairs.select(F.col("b").alias("id")).distinct()
    first = pairs.select(F.col("a").alias("id")).distinct().join(later, "id", "left_anti").select("id", F.lit(True).alias("head"))
    known = cut(first)
    left = cut(pairs.join(known.select(F.col("id").alias("a"), F.col("head").alias("of_a")), "a", "left").select("a", "b", "of_a"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, bool | None] = {}
        now, blocked, unknown = None, False, False
        for batch in batches:
            for a, b, of_a in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != now:
                    if now is not None:
                        found[now] = False if blocked else None if unknown else True
                    now, blocked, unknown = b, False, False
                state = of_a if of_a is not None else found.get(a)
                blocked |= state is True
                unknown |= state is None
        if now is not None:
            found[now] = False if blocked else None if unknown else True
        done = [(i, h) for i, h in found.items() if h is not None]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in done], pa.int64()), pa.array([h for _, h in done], pa.bool_())], names=["id", "head"])

    while (n := left.count()) > 0:
        ranged = left.repartitionByRange(max(1, -(-n // block)), "b").sortWithinPartitions("b", "a")
        fresh = cut(ranged.mapInArrow(settle, "id long, head boolean"))
        known = cut(known.unionAll(fresh))
        rest = left.join(fresh.select(F.col("id").alias("b")), "b", "left_anti").join(fresh.select(F.col("id").alias("a"), "head"), "a", "left")
        left = cut(rest.select("a", "b", F.coalesce("of_a", "head").alias("of_a")))
    return known
