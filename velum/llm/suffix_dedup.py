"""Removal of repeated byte strings by bucket-pointer refinement, spread over Spark.

A string is `length` bytes; two equal strings anywhere (overlaps count) mark every byte they cover.

1. Every start of a string falls to the smallest hash of the q-grams inside the string. Equal strings have equal
   smallest hashes, so a run of neighbouring starts with one smallest hash (a *run*) is a bucket entry, and only runs
   of the same hash can hold equal strings. Runs are counted by hash and digest, combined before the shuffle.
2. Runs whose hash occurs once are settled (unless they may repeat inside themselves); equal whole runs settle each
   other. For the rest one copy of every distinct run is fetched.
3. Fetched runs of a hash meet and their starts are refined: initial q-gram buckets, then buckets of doubled length by
   sorting on the bucket numbers of a start and of the offset behind it, reused from round to round. A start whose
   bucket has one member leaves at once.
   The runs of a hash that take more than `most` bytes aren't gathered: their starts are refined in the same rounds by
   grouped counts over all tasks, with the hashes of the q-grams as bucket numbers.
4. Starts of repeated strings become spans of documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velum.llm.common import BLOCK_BYTES, blocks, discard, flat, map_batches, prefix_hash, span_hash, stored, utf8

LENGTH, GRAM = 400, 100
#: Bytes of the distinct runs of one hash that meet in a task; larger buckets are refined by grouped counts.
MOST_BYTES = 1 << 18
#: Bytes of a word, ASCII case kept.
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours."""
    n = len(x)
    full = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    full[:n] = x
    grid = full.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def runs_of(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, first start, starts, hash, digest, may repeat inside itself) of the runs in a block of texts."""
    n, width = len(raw), length - gram + 1
    if n < length:
        return (np.zeros(0, np.int64),) * 5 + (np.zeros(0, bool),)
    sums = prefix_hash(raw)
    at = np.arange(n - gram + 1)
    grams = span_hash(sums, at, at + gram)
    least = sliding_min(grams, width)
    sizes = np.diff(offsets)
    room = np.repeat(offsets[1:], sizes)[: n - length + 1] - np.arange(n - length + 1)
    ok = room >= length
    first = ok.copy()
    first[1:] &= ~ok[:-1] | (least[1:] != least[:-1])
    last = ok.copy()
    last[:-1] &= ~ok[1:] | (least[1:] != least[:-1])
    a, b = np.flatnonzero(first), np.flatnonzero(last)
    own = b - a >= width  # a hash seen by more starts than one occurrence can reach
    reach = np.arange(2 * width - 1)
    for i in range(0, len(a), 1024):
        some = np.flatnonzero(~own[i : i + 1024]) + i
        span = np.minimum(a[some, None] + reach, len(grams) - 1)
        hits = (grams[span] == least[a[some], None]) & (reach < (b[some] - a[some] + width)[:, None])
        own[some] = hits.sum(1) > 1
    owner = np.searchsorted(offsets, a, "right") - 1
    return owner, a - offsets[owner], b - a + 1, least[a], span_hash(sums, a, b + length), own


def repeated_starts(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Starts (ascending) of strings that start more than once in the texts of a block, by bucket-pointer refinement."""
    n = len(raw)
    room = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)
    alive = np.flatnonzero(room >= length)
    if not len(alive):
        return alive
    size = gram
    at = np.flatnonzero(room >= size)
    bucket = np.full(n, -1, np.int64)
    bucket[at], count = _numbered(span_hash(prefix_hash(raw), at, at + size))
    while True:
        # A repeated string has only shared buckets at the offsets that a longer bucket is made of.
        steps = [*range(0, length - size + 1, size)]
        for s in steps:
            alive = alive[count[bucket[alive + s]] > 1]
        if size == length or not len(alive):
            return alive
        wider = min(2 * size, length)
        shift = wider - size
        need = np.unique(np.concatenate([alive + s for s in {*range(0, length - wider + 1, wider), length - wider}]))
        key = bucket[need] * np.int64(len(count)) + bucket[need + shift]
        bucket = np.full(n, -1, np.int64)
        bucket[need], count = _numbered(key)
        size = wider


def _numbered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket number of each key, members of each bucket)."""
    _, number, count = np.unique(key, return_inverse=True, return_counts=True)
    return number, count


def spans_of(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, how many) of runs of consecutive starts."""
    cut = np.flatnonzero(np.diff(starts) != 1) + 1
    first = starts[np.concatenate([[0], cut])] if len(starts) else starts
    return first, np.diff(np.concatenate([[0], cut, [len(starts)]])) if len(starts) else starts


def _groups(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[pa.Table]:
    """Whole keys (sorted input) in tables of about a block of bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key).to_numpy()
        cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
        if held and values[0] != held[-1].column(key)[-1].as_py() and size > BLOCK_BYTES:
            yield pa.Table.from_batches(held)
            held, size = [], 0
        ends = np.cumsum(np.diff(flat(batch.column(batch.num_columns - 1))[1]))
        start, done = 0, 0
        for c in cuts:
            here = int(ends[c - 1]) - done
            if size + here > BLOCK_BYTES:
                yield pa.Table.from_batches([*held, batch.slice(start, c - start)])
                held, size, start, done = [], 0, int(c), int(ends[c - 1])
        held.append(batch.slice(start))
        size += int(ends[-1]) - done
    if held:
        yield pa.Table.from_batches(held)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, text: str = "text", id_col: str = "doc_id", most: int = MOST_BYTES) -> DataFrame:
    """(k1, k2, spans): by document key, array of (start, starts) of strings that occur again somewhere.

    k1 and k2 hash id and text, so rows with null or repeated ids are told apart unless they are equal in both.
    """
    key = "k1 long, k2 long"
    source = docs.select(F.xxhash64(id_col).alias("k1"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("k2"), utf8(text).alias("_text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = batch.column(0), batch.column(1)
            for i, raw, offsets in blocks(*flat(batch.column(2))):
                owner, at, starts, h, d, own = runs_of(raw, offsets, length, gram)
                row = pa.array(owner + i)
                yield pa.RecordBatch.from_arrays([k1.take(row), k2.take(row), pa.array(at), pa.array(starts), _signed(h), _signed(d), pa.array(own)], names=["k1", "k2", "at", "starts", "h", "d", "own"])

    every = stored(map_batches(source, cut, f"{key}, at long, starts long, h long, d long, own boolean"), "all-runs")
    shared = every.groupBy("h").agg(F.count("*").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi"), F.max("own").alias("own"))
    shared = shared.where("n > 1 OR own").select("h", F.expr("lo != hi OR n = 1").alias("mixed"))
    entries = stored(every.drop("own").join(shared, "h"), "runs")
    discard(every)

    mixed = entries.where("mixed")
    distinct = stored(mixed.groupBy("h", "d", "starts").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "at")).alias("rep")), "distinct")
    hot = stored(distinct.groupBy("h").agg(F.sum(F.col("starts") + (length - 1)).alias("bytes")).where(F.col("bytes") > most).select("h", F.lit(True).alias("hot")), "hot")
    wanted = distinct.join(hot, "h", "left").select("rep.k1", "rep.k2", F.struct("h", "d", "n", "rep.at", "starts", F.coalesce("hot", F.lit(False)).alias("hot")).alias("w"))
    wanted = wanted.groupBy("k1", "k2").agg(F.collect_list("w").alias("w"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k1, k2, packed, size, w in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                whole = _unpacked(packed, size)
                rows += [(x["h"], x["d"], x["n"], k1, k2, x["at"], x["hot"], whole[x["at"] : x["at"] + x["starts"] + length - 1]) for x in w]
            columns = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.int64()] * 6 + [pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["h", "d", "n", "k1", "k2", "at", "hot", "bytes"])

    fetched = map_batches(packed_texts(docs, text, id_col).drop("_id").join(wanted, ["k1", "k2"]).select("k1", "k2", "packed", "size", "w"), fetch, f"h long, d long, n long, {key}, at long, hot boolean, bytes binary")
    fetched = stored(fetched, "strings")

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 0):
            # The same run may have come from equal rows; one is enough.
            h, d = group.column("h").to_numpy(), group.column("d").to_numpy()
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
            group = group.filter(pa.array(new))
            raw, offsets = flat(group.column("bytes"))
            starts, many = spans_of(repeated_starts(raw, offsets, length, gram))
            owner = np.searchsorted(offsets, starts, "right") - 1
            once = group.column("n").to_numpy()[owner] == 1  # runs that occur again as a whole are settled already
            owner, starts, many = owner[once], starts[once], many[once]
            at = group.column("at").to_numpy()[owner] + starts - offsets[owner]
            yield pa.RecordBatch.from_arrays([pa.array(group.column(c).to_numpy()[owner]) for c in ("k1", "k2")] + [pa.array(at), pa.array(many)], names=["k1", "k2", "at", "starts"])

    schema = f"{key}, at long, starts long"
    parted = fetched.where("NOT hot").select("h", "d", "n", "k1", "k2", "at", "bytes").repartition("h").sortWithinPartitions("h", "d")
    refined = map_batches(parted, refine, schema)

    by_count = _refined_by_count(fetched.where("hot"), length, gram) if not hot.isEmpty() else fetched.where("false").select("k1", "k2", "at", F.lit(1).cast("long").alias("starts"))

    again = distinct.where("n > 1").select("h", "d", "starts")
    whole = mixed.join(again, ["h", "d", "starts"]).select("k1", "k2", "at", "starts")
    found = entries.where("NOT mixed").select("k1", "k2", "at", "starts").unionAll(whole).unionAll(refined).unionAll(by_count)
    return found.groupBy("k1", "k2").agg(F.collect_list(F.struct("at", "starts")).alias("spans"))


def _refined_by_count(fetched: DataFrame, length: int, gram: int) -> DataFrame:
    """(k1, k2, at, starts) of repeated strings in runs (h, d, k1, k2, at, bytes) whose hashes hold too many to gather.

    Every start carries the bucket numbers (64-bit hashes) of the q-grams that make up its string. A round doubles the
    bytes that a bucket stands for: buckets are counted with partial counts before the shuffle, starts alone in theirs
    leave. No bucket is ever held by one task.
    """
    offsets = [*range(0, length - gram, gram), length - gram]
    names = [f"g{i}" for i in range(len(offsets))]

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_numpy()
            for i, raw, cuts in blocks(*flat(batch.column(3)), limit=BLOCK_BYTES // 8):
                room = np.repeat(cuts[1:], np.diff(cuts)) - np.arange(len(raw))
                s = np.flatnonzero(room >= length)
                owner = np.searchsorted(cuts, s, "right") - 1
                sums = prefix_hash(raw)
                row = pa.array(owner + i)
                grams = [_signed(span_hash(sums, s + o, s + o + gram)) for o in offsets]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(at[owner + i] + s - cuts[owner]), *grams], names=["k1", "k2", "at", *names])

    once = fetched.dropDuplicates(["h", "d"]).select("k1", "k2", "at", "bytes")
    live = stored(map_batches(once, starts, "k1 long, k2 long, at long, " + ", ".join(f"{g} long" for g in names)), "starts")
    held = 1
    while held < len(names):
        held = min(2 * held, len(names))
        key = names[:held]
        # Written, so that in the join a bucket with very many starts is a plain shuffle partition that can be split.
        twice = stored(live.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").drop("n"), "twice")
        live = stored(live.join(twice, key), "starts")
    return live.select("k1", "k2", "at", F.lit(1).cast("long").alias("starts"))


def packed_texts(docs: DataFrame, text: str = "text", id_col: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """(k1, k2, _id, packed, size, *carry): whole texts as compressed bytes, which makes their shuffles small."""
    kept = ", ".join(["", *(f"`_c{i}` {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))])
    kind = docs.schema[id_col].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=1)
        for batch in batches:
            texts = batch.column(3).to_pylist()
            packed = [codec.compress(x, asbytes=True) for x in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(packed, pa.binary()), pa.array([len(x) for x in texts], pa.int64()), *batch.columns[4:]], names=["k1", "k2", "_id", "packed", "size", *(f"_c{i}" for i in range(len(carry)))])

    source = docs.select(
        F.xxhash64(id_col).alias("k1"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("k2"), F.col(id_col).alias("_id"), utf8(text).alias("_text"),
        *(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carry)),
    )
    return map_batches(source, pack, f"k1 long, k2 long, _id {kind}, packed binary, size long{kept}")


def _unpacked(packed: bytes, size: int) -> bytes:
    return pa.Codec("zstd").decompress(packed, decompressed_size=size, asbytes=True) if size else b""


def removed(size: int, spans: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal [start, end) of bytes that the strings starting in `spans` (start, starts) cover."""
    out: list[list[int]] = []
    for at, starts in sorted(spans):
        end = min(size, at + starts - 1 + length)
        if out and at <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([at, end])
    return [(a, b) for a, b in out]


def whole_words(text: bytes, start: int, end: int) -> int:
    """Words that lie in text[start:end] from their first to their last byte."""
    n = sum(1 for _ in WORD.finditer(text, start, end))
    split = lambda at: 0 < at < len(text) and WORD.match(text, at - 1, at) and WORD.match(text, at, at + 1)
    return n - bool(split(start)) - bool(split(end))


def _removed(docs: DataFrame, length: int, gram: int, text: str, id_col: str, most: int, carry: tuple[str, ...], as_text: bool, words: int = 0) -> DataFrame:
    found = repeats(docs, length, min(gram, length), text, id_col, most)
    extra = [f"_c{i}" for i in range(len(carry))]
    joined = packed_texts(docs, text, id_col, carry).join(found, ["k1", "k2"], "left").select("_id", "packed", "size", "spans", *extra)
    kind = docs.schema[id_col].dataType.simpleString()
    out = (text, "string", pa.string()) if as_text else ("kept", "binary", pa.binary())

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for packed, size, spans in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                whole = _unpacked(packed, size)
                gone = removed(size, [(s["at"], s["starts"]) for s in spans or ()], length)
                gone = [x for x in gone if not words or whole_words(whole, *x) >= words]
                cuts = [0, *(x for span in gone for x in span), size]
                pieces = [whole[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
                left = "".join(p.decode("utf-8", "ignore") for p in pieces) if as_text else b"".join(pieces)
                rows.append((size, sum(b - a for a, b in gone), len(gone), left))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = [pa.int64()] * 3 + [out[2]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), *batch.columns[4:]], names=[id_col, "n_bytes", "n_removed", "n_spans", out[0], *carry])

    kept = ", ".join(["", *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)])
    return map_batches(joined, drop, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, `{out[0]}` {out[1]}{kept}")


def remove(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, text: str = "text", id_col: str = "doc_id", most: int = MOST_BYTES) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept binary) for each row of `docs`.

    Every byte covered by a string of `length` bytes (2 at least) that starts at another place too, in the same document
    or another, is removed; strings are judged on the input. Null texts count as empty; texts shorter than `length` stay
    whole; repeated rows (also with null or equal ids) are copies of each other like any other texts; extra columns are
    dropped; an empty table gives an empty table. Texts cross two shuffles compressed, beside them only runs do.
    """
    return _removed(docs, length, gram, text, id_col, most, (), False)


def cut_texts(docs: DataFrame, length: int = LENGTH, carry: tuple[str, ...] = (), gram: int = GRAM, words: int = 0) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, text, *carry, n_chars): remove() with what is left as text.

    With `words` only maximal runs of removed bytes that hold so many whole words go, shorter ones stay. A character of
    which only a part is removed goes as a whole. The same cases as in remove().
    """
    return _removed(docs, length, gram, "text", "doc_id", MOST_BYTES, carry, True, words).withColumn("n_chars", F.char_length("text").cast("long"))
