"""JSON bodies of requests: their texts as rows, and bodies rewritten in those texts with all other bytes as they were.

The texts of a body are rows of their own, so that detection, token maps and masking are the joins of
velum.operators.masking; the JSON is walked twice, once to read the texts and once to put the new ones back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velum.functions import json_text
from velum.operators import masking

#: The place of a body that isn't JSON of its shape and counts as one plain text.
WHOLE = -1


def _read(body: str | None, shape: str) -> list[tuple[int, str]]:
    """(place, text) of the texts of a body; a message content that is no array of blocks is a text itself."""
    if body is None:
        return []
    try:
        leaves = json_text.string_leaves(body)
        if shape == "content" and not body.lstrip().startswith("["):
            return [(WHOLE, body)]
        found = [(n, json_text.value(body, *leaves[n][1:])) for n in json_text.chosen(body, leaves, shape)]
    except ValueError:
        return [(WHOLE, body)] if shape == "content" else []
    return [(n, t.encode("utf-8", "replace").decode()) for n, t in found]


def _written(body: str | None, changes: dict[int, str]) -> str | None:
    if body is None or not changes:
        return body
    return changes[WHOLE] if WHOLE in changes else json_text.rewrite(body, changes, json_text.string_leaves(body))


def texts(bodies: DataFrame, id_cols: list[str], body: str = "body", shape: str = "request") -> DataFrame:
    """(*id_cols, key, place, text): the texts of each body, by velum.functions.json_text.chosen().

    `key` tells bodies of one id apart. Null bodies and bodies that aren't JSON have none; with the shape `content` a
    body that is no array of blocks is one text. Half a surrogate pair in a text reads as a question mark.
    """
    source = bodies.select(*id_cols, F.xxhash64(body).alias("key"), F.col(body).alias("_body"))
    n = len(id_cols)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, *pair) for i, b in enumerate(batch.column(n + 1).to_pylist()) for pair in _read(b, shape)]
            at = pa.array([f[0] for f in found], pa.int64())
            columns = [batch.column(k).take(at) for k in range(n + 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.string())], names=[*id_cols, "key", "place", "text"])

    kinds = [f"`{c}` {bodies.schema[c].dataType.simpleString()}" for c in id_cols]
    return source.mapInArrow(work, ", ".join([*kinds, "key long", "place int", "text string"]))


def rewrite(bodies: DataFrame, changes: DataFrame, id_cols: list[str], body: str = "body") -> DataFrame:
    """`bodies` with the texts in `changes` (*id_cols, key, place, text, of texts()) put in; all other bytes stay.

    A body meets its own changes only; columns and rows of `bodies` stay, ids may be null or repeat.
    """
    key = F.struct(*id_cols, F.xxhash64(body).alias("key"))
    put = changes.groupBy(F.struct(*id_cols, "key").alias("_at")).agg(F.collect_list(F.struct("place", "text")).alias("_put"))
    joined = bodies.withColumn("_at", key).join(put, "_at", "left").drop("_at")
    names = [c for c in bodies.columns if c != body]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            put = [{p["place"]: p["text"] for p in x or []} for x in batch.column(len(names) + 1).to_pylist()]
            new = [_written(b, p) for b, p in zip(batch.column(len(names)).to_pylist(), put, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(new, pa.string())], names=[*names, body])

    kinds = [f"`{c}` {bodies.schema[c].dataType.simpleString()}" for c in names]
    out = joined.select(*names, body, "_put").mapInArrow(work, ", ".join([*kinds, f"`{body}` string"]))
    return out.select(*bodies.columns)


def mask_requests(bodies: DataFrame, find: Callable[[DataFrame, list[str], str], DataFrame] | None = None, known: DataFrame | None = None, mode: str = "reject", most: int = masking.MOST_ENTITIES) -> tuple[DataFrame, DataFrame]:
    """(bodies masked, with n_entities; token map): request bodies (session, turn, body) of any of the three shapes.

    Texts of people get tokens, numbered by session in the order of turns and of places in a body; assistants' messages
    and all else stay byte by byte. `find` gives the detections (default: classes, names and CamelCase), `known` is an
    earlier map. A body with more than `most` entities is left out (`reject`) or passed as it is with the column
    `unmasked` (`passthrough`); its entities get no tokens.
    """
    ids = ["session", "turn"]
    read = texts(bodies, ids)
    found = (find or masking.find_entities)(read, [*ids, "key", "place"], "text").withColumn("ord", F.struct("place", "ord"))
    counted = found.groupBy(*ids, "key").agg(F.countDistinct(F.lower("text")).alias("n_entities"))
    good = found.join(counted.where(F.col("n_entities") <= most).select(F.struct(*ids, "key").alias("_at")), F.struct(*ids, "key") == F.col("_at"), "left_semi")
    tokens = masking.token_map(good.select("session", "turn", "ord", "text", "kind"), known)
    masked = masking.mask_found(read, good, tokens, code=True).where(F.col("masked") != F.col("text"))
    numbers = counted.select(F.struct(*ids, "key").alias("_at"), "n_entities")
    with_number = bodies.withColumn("_at", F.struct(*ids, F.xxhash64("body").alias("key"))).join(numbers, "_at", "left").drop("_at")
    with_number = with_number.withColumn("n_entities", F.coalesce("n_entities", F.lit(0)))
    allowed = masking.guard(with_number, most=most, mode=mode)
    return rewrite(allowed, masked.select(*ids, "key", "place", F.col("masked").alias("text")), ids), tokens


def mask_bodies(messages: DataFrame, tokens: DataFrame, skip: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """`messages` (session, turn, role, content) with content masked by an existing map, for every role but `skip`.

    Content is a plain text or a JSON array of blocks, of which only those of type `text` change; the bytes of all else
    stay. Tokens are used from their first turn on.
    """
    ids = ["session", "turn"]
    passed = F.coalesce(F.col("role").isin(*skip), F.lit(False))
    asked = messages.where(~passed)
    masked = masking.mask_turns(texts(asked, ids, "content", "content"), tokens).where(F.col("masked") != F.col("text"))
    changed = rewrite(asked, masked.select(*ids, "key", "place", F.col("masked").alias("text")), ids, "content")
    return changed.unionByName(messages.where(passed))


def restore_bodies(bodies: DataFrame, tokens: DataFrame) -> DataFrame:
    """`bodies` (session, turn, body) with the tokens in every string restored, whatever it stands in; keys stay."""
    ids = ["session", "turn"]
    held = texts(bodies, ids, shape="all").where(F.col("text").rlike(masking.TOKEN))
    back = masking.restore_turns(held, tokens, "text").where(F.col("restored") != F.col("text"))
    return rewrite(bodies, back.select(*ids, "key", "place", F.col("restored").alias("text")), ids)
