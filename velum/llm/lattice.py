"""Embedding near-duplicates by lattice hashing.

Unit vectors are projected to eight dimensions by several random maps and decoded to points of the E8 lattice. Each
table files a vector under its own point, or under the points of several maps together, and probes the neighbouring
cells that lie nearest. Vectors that meet in a cell are screened by short sign sketches; those
with a likely partner are compared by cosine in double precision.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velum.llm.common import block_units, components, link_roots, map_batches, mix, stored

COSINE = 0.93
#: Lattice spacing against unit vectors.
SPACING = 0.7
#: (rows of the largest label, maps of a cell, tables, probed neighbours): each line holds up to its rows. In all of them
#: vectors of cosine 0.93 meet in some table with about the same probability (measured in 64 dimensions: README), while
#: unrelated ones meet in a table with 0.010, 0.00007 and 0.000001, so that what a vector meets grows with its label within a line only, and in the last.
SETTINGS = ((1 << 18, 1, 10, 1), (40_000_000, 2, 22, 2), (None, 3, 48, 3))
#: Maps of a cell, tables, probed neighbours and spacing that serve tables of any size, so that links don't depend on it. A
#: pair of cosine 0.93 meets in a table with 0.484, so one in a million never does; unrelated ones meet in a table with
#: 0.00044 (measured in 64 dimensions), so a vector meets about one in a hundred of its label.
STEADY, STEADY_SPACING = (2, 21, 2), 0.85
#: The share of pairs of unrelated vectors that have one cell of one map in common (measured in 64 dimensions), and how
#: many labels, and distinct rows of each, are sampled to measure it for the vectors at hand.
MEET, SAMPLED_LABELS, SAMPLED_ROWS = 0.004, 8, 2048
#: Signs of a sketch, and the standard deviations beyond the expected number of unequal signs of a pair at the threshold
#: that still count as likely: of the pairs at the threshold one in a hundred million or fewer are screened out.
SIGNS, DEVIATIONS = 128, 6
BLOCK_ROWS = 1024
#: Cosines of a matrix product this near the threshold are taken again pair by pair; pairs taken at once.
ROUNDING, PAIRS_AT_ONCE = 1e-9, 20_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8: to the neighbours of a lattice point."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def nearest_point(y: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row: the nearer of the best points with whole and with half coordinates."""

    def even_sum(v: np.ndarray) -> np.ndarray:
        near = np.rint(v)
        off = v - near
        odd = np.flatnonzero(near.sum(1).astype(np.int64) & 1)
        worst = np.abs(off[odd]).argmax(1)
        near[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
        return near

    whole, half = even_sum(y), even_sum(y - 0.5) + 0.5
    closer = ((y - whole) ** 2).sum(1) <= ((y - half) ** 2).sum(1)
    return np.where(closer[:, None], whole, half)


def settings(rows: int) -> tuple[int, int, int]:
    """(maps of a cell, tables, probed neighbours) for a label of so many unrelated rows."""
    return next(rest for most, *rest in SETTINGS if most is None or rows <= most)


def crowding(x: np.ndarray, spacing: float = SPACING, tables: int = 4) -> float:
    """How many times more pairs of the rows (of length 1) share a cell of one map than of unrelated vectors; at least 1."""
    if len(x) < 2:
        return 1.0
    share = []
    for t in range(tables):
        key = cells(x, np.full(len(x), t, np.uint64), 1, 1, 0, spacing)[:, 0, 0]
        n = np.unique(key, return_counts=True)[1]
        share.append((n * (n - 1)).sum() / (len(x) * (len(x) - 1)))
    return max(1.0, float(np.mean(share)) / MEET)


def crowded_rows(live: DataFrame, spacing: float = SPACING) -> int:
    """The rows of unrelated vectors among which a vector would meet as many as it does in the most crowded label.

    Vectors that share a direction, as real embeddings do, fill few cells. The crowding of the largest labels is measured
    on a sample of each (a share of the range of hashed ids, SAMPLED_ROWS rows or few more); equal vectors count once,
    as they are filed once.
    """
    top = live.groupBy("g").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "g").limit(SAMPLED_LABELS).collect()
    chosen = F.lit(False)
    for r in top:
        limit = min(2**63 - 1, int(-(2**63) + min(1.0, SAMPLED_ROWS / r.n) * 2**64))
        chosen = chosen | ((F.col("g") == r.g) & (F.xxhash64("vec_id", F.lit(7)) <= F.lit(limit)))
    found: dict[int, list] = {}
    for r in live.where(chosen).select("g", "v").limit(2 * SAMPLED_LABELS * SAMPLED_ROWS).collect():
        found.setdefault(r.g, []).append(r.v)
    most = 0
    for r in top:
        rows = np.array(found.get(r.g, []), np.float64)
        once = np.unique(rows, axis=0) if len(rows) else rows
        unit = once / np.maximum(np.linalg.norm(once, axis=1, keepdims=True), 1e-300) if len(once) else once
        most = max(most, int(r.n * len(once) / max(1, len(rows)) * crowding(unit, spacing)))
    return most


def maps(dim: int, count: int, spacing: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """(projection, offset) of every map, from a fixed seed."""
    rng = np.random.default_rng(dim)
    return [(rng.normal(0, 1 / np.sqrt(8) / spacing, (dim, 8)), rng.uniform(0, 1, 8)) for _ in range(count)]


def cells(x: np.ndarray, group: np.ndarray, depth: int, tables: int, probes: int, spacing: float = SPACING) -> np.ndarray:
    """Cell keys (rows x tables x (1 + probes), int64): own cell first; `group` keeps labels and sizes apart.

    A cell is one lattice point from each of `depth` maps; its neighbours differ in one of them by a shortest vector.
    """
    n = len(x)
    out = np.zeros((n, tables, 1 + probes), np.uint64)
    around = roots()
    every = maps(x.shape[1], tables * depth, spacing)
    for t in range(tables):
        points, gains = [], []
        for projection, offset in every[t * depth : (t + 1) * depth]:
            y = x @ projection + offset
            points.append(nearest_point(y))
            gains.append((y - points[-1]) @ around.T)
        gain, near = np.concatenate(gains, 1), np.empty((n, probes), np.int64)
        for j in range(probes):
            near[:, j] = gain.argmax(1)
            gain[np.arange(n), near[:, j]] = -np.inf
        place, step = np.divmod(near, len(around))
        cell = np.repeat(np.stack(points, 1)[:, None], 1 + probes, 1)
        cell[np.arange(n)[:, None], np.arange(1, 1 + probes), place] += around[step]
        twice = np.rint(2 * cell).astype(np.int64).view(np.uint64).reshape(n, 1 + probes, 8 * depth)
        with np.errstate(over="ignore"):
            key = np.broadcast_to((group + np.uint64(t + 1) * _STEP)[:, None], twice.shape[:2])
            for k in range(8 * depth):
                key = mix(key * _STEP + twice[:, :, k])
        out[:, t] = key
    return out.view(np.int64)


def sketches(x: np.ndarray) -> np.ndarray:
    """The signs of each row against fixed random directions, packed to 64-bit words (Spark has only signed ones)."""
    directions = np.random.default_rng(x.shape[1] + 1).normal(size=(x.shape[1], SIGNS))
    return np.packbits(x @ directions > 0, axis=1).view(np.int64)


def most_unequal(cosine: float) -> int:
    """Unequal signs up to which a pair may reach `cosine`."""
    share = np.arccos(cosine) / np.pi
    return int(np.ceil(SIGNS * share + DEVIATIONS * np.sqrt(SIGNS * share * (1 - share))))


def unequal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of unequal signs (up to 255), word by word; numpy counts the bits of a negative number's absolute value, hence unsigned words."""
    a, b = a.view(np.uint64), b.view(np.uint64)
    out = np.bitwise_count(a[..., 0] ^ b[..., 0])
    for k in range(1, a.shape[-1]):
        out = out + np.bitwise_count(a[..., k] ^ b[..., k])
    return out


def likely(words: np.ndarray, home: np.ndarray, side: np.ndarray, alone: bool, most: int, at_once: int = 256) -> np.ndarray:
    """Which of the rows that meet in a unit have a partner with at most `most` unequal signs."""
    out = np.zeros(len(words), bool)
    for a in range(0, len(words), at_once):
        here = slice(a, a + at_once)
        near = (unequal(words[here, None], words[None]) <= most) & (home[here, None] | home[None])
        if alone:
            near[np.arange(len(near)), np.arange(a, a + len(near))] = False
        else:
            near &= side[here, None] != side[None]
        out[here] |= near.any(1)
    return out


def whole_runs(batches: Iterable[pa.RecordBatch], key: str, rows: int = 2048) -> Iterator[pa.Table]:
    """Tables of at least `rows` rows (the last may have fewer) that cut no run of equal `key`; the input is sorted by it."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            table = pa.Table.from_batches(held)
            value = table.column(key).to_numpy()
            cut = int(np.searchsorted(value, value[-1]))
            if cut:
                yield table.slice(0, cut)
            held, count = table.slice(cut).to_batches(), count - cut
    if count:
        yield pa.Table.from_batches(held)


def run_pairs(unit: np.ndarray, most: int = 32) -> tuple[np.ndarray, np.ndarray, list[slice]]:
    """(lower row, higher row) of all pairs within runs of up to `most` equal values, and the larger runs."""
    start = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
    size = np.diff(np.r_[start, len(unit)])
    low, high = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in np.unique(size[size <= most]):
        i, j = np.triu_indices(k, 1)
        at = start[size == k][:, None]
        low.append((at + i).ravel())
        high.append((at + j).ravel())
    return np.concatenate(low), np.concatenate(high), [slice(a, a + k) for a, k in zip(start, size, strict=True) if k > most]


def join(vectors: DataFrame, cosine: float = COSINE, setting: tuple[int, int, int] | None = None, spacing: float = SPACING, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of `vectors` (vec_id integer, embedding array, label).

    Only vectors with the same label that isn't null are compared. n_links counts the other vectors found with at least
    this cosine, component_id is the smallest vec_id that links reach, kept marks that one. Null, empty or zero vectors
    and ones with null or non-finite components link with nothing, as do ones with a null vec_id or label. Vectors of
    different lengths aren't compared. Equal vectors of a label are compared once and counted as often as they occur;
    repeated rows are such copies (kept marks all of the smallest id), different vectors under one id share their links.
    Extra columns are dropped; an empty table gives an empty table.

    Cells are counted, and vectors that share one screened by their sketches, before any vector moves; cells beyond
    `block_rows` are treated in pairs of blocks. A pair is counted in the first cell that it shares, so nothing is
    emitted per pair. Without a `setting` (maps of a cell, tables, probed neighbours) it follows the rows of the largest
    labels and how crowded their cells are (crowded_rows()), and so does which few pairs near the threshold are missed;
    with STEADY and its spacing no link depends on the size of the input.
    """
    value = F.col("embedding")
    clean = F.transform(value, lambda x: x.cast("double"))
    usable = value.isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.forall(clean, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(clean, lambda x: x != 0)
    rows = vectors.select("vec_id", "embedding", "label", F.coalesce(usable, F.lit(False)).alias("ok"))
    live = rows.where("ok").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"), F.xxhash64("label", F.size("embedding")).alias("g"))
    if setting is None:
        setting = settings(crowded_rows(live, spacing))
    depth, tables, probes = setting
    copies = live.groupBy("g", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            size = pc.list_value_length(lists).to_numpy()
            keys: list = [None] * batch.num_rows
            words = np.zeros((batch.num_rows, SIGNS // 64), np.int64)
            for dim in np.unique(size):
                some = np.flatnonzero(size == dim)
                x = pc.list_flatten(lists.take(pa.array(some))).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                x = x / np.abs(x).max(1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                words[some] = sketches(x)
                got = cells(x, batch.column(0).to_numpy()[some].view(np.uint64), depth, tables, probes, spacing)
                for i, k in zip(some, got.reshape(len(some), -1), strict=True):
                    keys[i] = k
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.list_(pa.int64())), pa.array(list(words), pa.list_(pa.int64()))], names=["g", "v", "rep", "copies", "keys", "signs"])

    kind = live.schema["v"].dataType.simpleString()
    filed = stored(map_batches(copies.select("g", "v", "rep", "copies"), file, f"g long, v {kind}, rep long, copies long, keys array<long>, signs array<long>"), "cells")

    signs = [F.col("signs")[i].alias(f"s{i}") for i in range(SIGNS // 64)]
    names = [f"s{i}" for i in range(SIGNS // 64)]
    entries = filed.select("rep", *signs, F.posexplode("keys").alias("place", "key")).select("rep", *names, "key", (F.col("place") % (probes + 1) == 0).alias("home"))
    shared = entries.groupBy("key").agg(F.count("*").alias("n"), F.max("home").alias("any_home")).where("n > 1 AND any_home").select("key", "n")
    units = block_units(entries.join(shared, "key"), "key", "rep", "n", block_rows).select("unit", "key", "rep", "home", "side", "alone", *names)
    most = most_unequal(cosine)

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, "unit"):
            words = np.stack([table.column(c).to_numpy() for c in names], 1)
            side = table.column("side").to_numpy()
            home, alone = (table.column(c).to_numpy() for c in ("home", "alone"))
            a, b, large = run_pairs(table.column("unit").to_numpy())
            close = (unequal(words[a], words[b]) <= most) & (home[a] | home[b]) & (alone[a] | (side[a] != side[b]))
            kept = np.zeros(table.num_rows, bool)
            kept[a[close]] = kept[b[close]] = True
            for run in large:
                kept[run] = likely(words[run], home[run], side[run], alone[run.start], most)
            if kept.any():
                yield from table.drop_columns(names).filter(pa.array(kept)).combine_chunks().to_batches()

    near = map_batches(units.repartition("unit").sortWithinPartitions("unit"), screen, "unit long, key long, rep long, home boolean, side int, alone boolean")
    wanted = near.groupBy("rep").agg(F.collect_list(F.struct("unit", "key", "home", "side", "alone")).alias("u"))
    ready = filed.select("rep", "v", "copies", "keys").join(wanted, "rep").withColumn("u", F.explode("u")).select("u.unit", "u.key", "rep", "copies", "u.home", "u.side", "u.alone", "v", "keys")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, "unit"):
            rep, copies, side, key = (table.column(c).to_numpy() for c in ("rep", "copies", "side", "key"))
            home, alone = (table.column(c).to_numpy() for c in ("home", "alone"))
            n = table.num_rows
            size = pc.list_value_length(table.column("v")).to_numpy()
            x = np.zeros((n, size.max()))
            x[np.arange(x.shape[1]) < size[:, None]] = pc.list_flatten(table.column("v")).to_numpy()
            x /= np.abs(x).max(1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            filed_at = pc.list_flatten(table.column("keys")).to_numpy().reshape(n, tables, probes + 1)
            a, b, large = run_pairs(table.column("unit").to_numpy())
            links = []
            for run in [None, *large]:
                if run is None:
                    sure = np.zeros(len(a), bool)
                else:
                    value = x[run] @ x[run].T
                    a, b = np.nonzero(np.triu(value >= cosine - ROUNDING, 1))
                    sure = value[a, b] >= cosine + ROUNDING
                    a, b = a + run.start, b + run.start
                fits = (home[a] | home[b]) & (alone[a] | (side[a] != side[b])) & (size[a] == size[b])
                a, b, sure = a[fits], b[fits], sure[fits]
                for c in range(0, len(a), PAIRS_AT_ONCE):
                    i, j, hit = (y[c : c + PAIRS_AT_ONCE] for y in (a, b, sure))
                    open_ = np.flatnonzero(~hit)
                    hit[open_] = np.einsum("ij,ij->i", x[i[open_]], x[j[open_]]) >= cosine
                    i, j = i[hit], j[hit]
                    once = first_meeting(filed_at[i], filed_at[j]) == key[i]
                    links.append((i[once], j[once]))
            a, b = (np.concatenate(y) for y in zip(*links, strict=True)) if links else (np.zeros(0, np.int64),) * 2
            if not len(a):
                continue
            number = np.bincount(a, copies[b], n) + np.bincount(b, copies[a], n)
            some = np.flatnonzero(number)
            yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(number[some].astype(np.int64)), pa.array(rep[link_roots(n, a, b)][some])], names=["rep", "n", "root"])

    found = stored(map_batches(ready.repartition("unit").sortWithinPartitions("unit", "rep"), compare, "rep long, n long, root long"), "links")
    classes = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    own = filed.select("g", "v", "rep", "copies").join(counts, "rep", "left").join(classes, F.col("rep") == F.col("id"), "left")
    own = own.select("g", "v", F.coalesce("root", "rep").alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    of = vectors.schema["vec_id"].dataType.simpleString()
    out = live.join(own, ["g", "v"]).select(F.col("vec_id").cast(of).alias("vec_id"), "n_links", F.col("component_id").cast(of).alias("component_id"))
    rest = rows.where("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionAll(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def first_meeting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cell key in which each pair of filed vectors (pairs x tables x (1 + probes)) meets first."""
    own_a, own_b = a[:, :, 0], b[:, :, 0]
    same = own_a == own_b
    at_a = (b[:, :, 1:] == own_a[:, :, None]).any(2)
    at_b = (a[:, :, 1:] == own_b[:, :, None]).any(2)
    table = (same | at_a | at_b).argmax(1)
    row = np.arange(len(a))
    same, at_a, at_b, own_a, own_b = (x[row, table] for x in (same, at_a, at_b, own_a, own_b))
    both = at_a & at_b
    return np.where(same | (at_a & ~both), own_a, np.where(both, np.minimum(own_a, own_b), own_b))
