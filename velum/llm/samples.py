"""Bounded samples of labelled rows for fitting small models on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded(ids: DataFrame, id_col: str, most: int) -> DataFrame:
    """The rows of `ids` (one row an id) whose hashed id is small: the same rows at every run, at most `most`.

    With more than `most` rows the share of the hash range is set four standard deviations below `most`. Rows are only
    counted; nothing is sorted, and one number reaches the driver.
    """
    n = ids.count()
    if n <= most:
        return ids
    share = max(1.0, most - 4 * most**0.5) / n
    return ids.where(F.xxhash64(id_col) < F.lit(int(-(2**63) + share * 2**64)))


def train_side(doc_id: str = "doc_id"):
    """True for rows whose labels may be learnt from: crc32 of the id as text, modulo 4, is not 2."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 != 2
