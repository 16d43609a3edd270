"""Event time: sessions, windows and repeated events, the same over a stream with a watermark and over a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def watermarked(events: DataFrame, at: str, late: str | None) -> DataFrame:
    """`events` with a watermark `late` behind the newest `at`: what comes later than that is dropped; no effect on tables."""
    return events if late is None else events.withWatermark(at, late)


def sessions(events: DataFrame, key: str = "key", at: str = "at", value: str = "value", gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """(key, start, end, n, total): runs of events of a key with less than `gap` between neighbours; `end` is the last plus the gap.

    On a stream (with `late`) a session is given out once the watermark has passed its end. Rows without a time have no
    session. Sessions merge while they are aggregated, so a key with very many events is not gathered.
    """
    window = F.session_window(at, gap)
    found = watermarked(events, at, late).groupBy(window.alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return found.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def windows(events: DataFrame, key: str = "key", at: str = "at", value: str = "value", size: str = "6 hours", slide: str | None = None, late: str | None = None) -> DataFrame:
    """(key, start, n, total): tumbling windows, or sliding ones with `slide`."""
    window = F.window(at, size, slide) if slide else F.window(at, size)
    found = watermarked(events, at, late).groupBy(window.alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return found.select(key, F.col("w.start").alias("start"), "n", "total")


def first_of_each(events: DataFrame, ids: list[str], at: str = "at", late: str = "10 minutes") -> DataFrame:
    """One event of each id: on a stream the first to come, remembered until the watermark passes its time plus `late`.

    On a table the one with the least time, then by all other columns.
    """
    if events.isStreaming:
        return events.withWatermark(at, late).dropDuplicatesWithinWatermark(ids)
    rest = [c for c in events.columns if c not in ids and c != at]
    return events.groupBy(*ids).agg(F.min(F.struct(at, *rest)).alias("_e")).select(*(c if c in ids else F.col(f"_e.`{c}`").alias(c) for c in events.columns))
