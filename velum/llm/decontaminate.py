"""Benchmark decontamination by the q-gram lemma.

A passage of m characters that differs from a segment by at most k edits shares at least m + 1 - q - k * q of the
segment's q-grams with it, and their diagonals (place in the document less place in the segment) differ by at most k.
So per document: windows with too few q-grams of any segment are passed over; in the others shared q-grams are counted
by segment in overlapping diagonal bands; bands that reach the bound are verified by banded alignment. Segments of an item
start every few characters, so that any quote of QUOTE characters holds a whole one. Items of some words are searched by
shorter q-grams, and items too short for an edit word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velum.llm.common import WORD_BYTE, blocks, flat, map_batches, mix, prefix_hash, span_hash, stored, utf8

Q, RATE = 12, 0.06
#: Any part of QUOTE characters of a longer item is sure to hold a whole segment: they start every STRIDE characters.
QUOTE, STRIDE = 100, 12
SEGMENT = QUOTE - STRIDE + 1
#: Items below SHORT characters are searched by q-grams of SHORT_Q, as longer ones would leave too few; those below LEAST,
#: whose budget is no edit at all, word by word.
SHORT, SHORT_Q, LEAST = 60, 6, 17
#: Characters of benchmark items that one pass over the documents holds in memory; more take more passes.
PASS_CHARS = 4_000_000
_TABLE_BITS = 22
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def normal(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, place of each byte in `raw`): words of lower-cased texts with one space behind each."""
    inside = WORD_BYTE[raw]
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    starts = offsets[:-1][offsets[:-1] < len(raw)]
    keep[starts] = inside[starts]
    place = np.flatnonzero(keep)
    out = raw[place]
    out = np.where(inside[place], out, np.uint8(32))
    return out, np.searchsorted(place, offsets), place


def gram_keys(text: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit key of the `q` bytes from each place on (6 to 16: up to eight bytes, and the last eight of more)."""
    n = len(text) - q + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    padded = np.zeros(-(-len(text) // 8) * 8 + 16, np.uint8)
    padded[: len(text)] = text
    eight = np.empty(len(padded) - 8, np.uint64)
    for k in range(8):
        eight[k::8] = padded[k : k + len(eight[k::8]) * 8].view(np.uint64)
    with np.errstate(over="ignore"):
        if q <= 8:
            key = (eight[:n] & np.uint64((1 << (8 * q)) - 1)) * _A
        else:
            key = eight[:n] * _A ^ (eight[q - 8 : n + q - 8] * _B >> np.uint64(7))
        return (key ^ (key >> np.uint64(29))) * _B


def budget_of(size: int, rate: float = RATE) -> int:
    """Edits that a segment of so many characters may have."""
    return int(rate * size)


class Grams:
    """Segments of the items searched with one length of q-grams, their q-grams, and the bounds of the lemma."""

    def __init__(self, items: list[tuple[int, np.ndarray]], q: int, rate: float):
        self.q, self.names = q, [item for item, _ in items]
        self.text = np.concatenate([t for _, t in items]) if items else np.zeros(0, np.uint8)
        length = np.array([len(t) for _, t in items], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(length)[:-1]]) if items else length
        size = np.minimum(length, SEGMENT)
        # An item has segments at every STRIDE, and one at its end if none is there.
        self.regular = (length - size) // STRIDE + 1
        more = ((length - size) % STRIDE > 0).astype(np.int64)
        self.last = np.where(more > 0, length - size, np.iinfo(np.int64).max)
        self.first_segment = np.concatenate([[0], np.cumsum(self.regular + more)])
        self.item = np.repeat(np.arange(len(items)), self.regular + more)
        number = np.arange(len(self.item)) - self.first_segment[self.item]
        self.at = np.where(number < self.regular[self.item], number * STRIDE, self.last[self.item])
        self.size = size
        self.budget = np.array([min(budget_of(int(n), rate), max(0, (int(n) - q) // q)) for n in size], np.int64)
        self.bound = size + 1 - q - self.budget * q
        keys = [gram_keys(t, q) for _, t in items]
        owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        place = np.concatenate([np.arange(len(k)) for k in keys]) if keys else np.zeros(0, np.int64)
        flat_keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(flat_keys, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.keys, self.first = np.unique(flat_keys[order], return_index=True)
        self.first = np.append(self.first, len(order))
        # Windows are counted by class of segment length, so that a short segment doesn't lower the bound of long ones.
        grade = size // 20
        self.table = np.zeros(1 << _TABLE_BITS, np.uint8)
        self.classes: list[tuple[int, int, int]] = []  # (bit, window, least bound)
        for n, g in enumerate(np.unique(grade)):
            bit, mine = 1 << min(n, 7), grade == g
            self.classes.append((bit, int((size + self.budget)[mine].max()), int(self.bound[mine].min())))
            self.table[(flat_keys[mine[owner]] >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] |= np.uint8(bit)

    def matches(self, text: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, fewest edits, place of a segment with them) of every item with a segment in some texts."""
        none = (np.zeros(0, np.int64),) * 4
        key = gram_keys(text, self.q)
        if not len(key) or not self.names:
            return none
        seen = self.table[(key >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)]
        near = np.zeros(len(key) + 1, np.int32)
        for bit, window, bound in self.classes:
            total = np.concatenate([[0], np.cumsum((seen & bit) > 0, dtype=np.int32)])
            w = min(window, len(key))
            hot = np.flatnonzero(total[w:] - total[:-w] >= bound)
            cut = np.flatnonzero(np.diff(hot) > 1)
            if len(hot):
                near[hot[np.concatenate([[0], cut + 1])]] += 1
                near[hot[np.concatenate([cut, [len(hot) - 1]])] + w] -= 1
        place = np.flatnonzero((np.cumsum(near[:-1]) > 0) & (seen > 0))
        if not len(place):
            return none
        at = np.minimum(np.searchsorted(self.keys, key[place]), len(self.keys) - 1)
        same = self.keys[at] == key[place]
        place, at = place[same], at[same]
        owner = np.searchsorted(cuts, place, "right") - 1
        inside = place + self.q <= cuts[owner + 1]
        place, at, owner = place[inside], at[inside], owner[inside]
        if not len(place):
            return none
        many = self.first[at + 1] - self.first[at]
        which = _spread(self.first[at], many)
        item, p = self.owner[which], self.place[which]
        owner, diagonal = np.repeat(owner, many), np.repeat(place, many) - p
        # Every shared q-gram counts for each segment that holds it, in the two bands that its diagonal lies in: bands are
        # two steps wide and start at every step, so the diagonals of one passage share a band.
        low = np.maximum(0, -(-(p - self.size[item] + self.q) // STRIDE))
        high = np.minimum(self.regular[item] - 1, p // STRIDE)
        number = np.maximum(0, high - low + 1)
        ends = np.flatnonzero(p >= self.last[item])
        hit = np.concatenate([np.repeat(np.arange(len(p)), number), ends])
        segment = np.concatenate([_spread(self.first_segment[item] + low, number), self.first_segment[item[ends] + 1] - 1])
        band = np.floor_divide(diagonal, self.budget[item] + 1)[hit]
        lowest = int(band.min()) - 1
        wide, segments = int(band.max()) - lowest + 1, len(self.item)
        row = (owner[hit] * segments + segment) * wide - lowest
        rows, index, count = np.unique(np.concatenate([row + band, row + band - 1]), return_index=True, return_counts=True)
        group, band = np.divmod(rows, wide)
        doc, segment = np.divmod(group, segments)
        enough = count >= self.bound[self.item[segment]]
        doc, segment, band, index = doc[enough], segment[enough], band[enough] + lowest, index[enough]
        if not len(doc):
            return none
        start = diagonal[hit[index % len(hit)]] + self.at[segment]  # of one shared q-gram: what stands there as it is needs no alignment
        edits = np.where(self._equal(text, cuts, doc, segment, start), 0, -1)
        pair = doc * len(self.names) + self.item[segment]
        rest = np.flatnonzero((edits < 0) & ~np.isin(pair, pair[edits == 0]))
        edits[edits < 0] = 1 << 30
        edits[rest], start[rest] = self._aligned(text, cuts, doc[rest], segment[rest], band[rest])
        ok = edits <= self.budget[self.item[segment]]
        pair, edits, start = pair[ok], edits[ok], start[ok]
        order = np.lexsort((start, edits, pair))
        pair, edits, start = pair[order], edits[order], start[order]
        new = np.concatenate([[True], pair[1:] != pair[:-1]]) if len(pair) else np.zeros(0, bool)
        doc, item = np.divmod(pair[new], len(self.names))
        return doc, item, edits[new], start[new]

    def _equal(self, text: np.ndarray, cuts: np.ndarray, doc: np.ndarray, segment: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Where a segment stands at `start` as it is."""
        size = self.size[self.item[segment]]
        out = (start >= cuts[doc]) & (start + size <= cuts[doc + 1])
        here = self.begin[self.item[segment]] + self.at[segment]
        for a in range(0, len(doc), 4096):
            some = a + np.flatnonzero(out[a : a + 4096])
            if len(some):
                ramp = np.minimum(np.arange(size[some].max()), size[some, None] - 1)
                out[some] = (text[start[some, None] + ramp] == self.text[here[some, None] + ramp]).all(1)
        return out

    def _aligned(self, text: np.ndarray, cuts: np.ndarray, doc: np.ndarray, segment: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(fewest edits, start) of each segment in its band of diagonals; bands of one width are done together."""
        edits, start = np.full(len(doc), 1 << 30), np.zeros(len(doc), np.int64)
        budgets = self.budget[self.item[segment]]
        for budget in np.unique(budgets):
            all_some = np.flatnonzero(budgets == budget)
            step, width = int(budget) + 1, 4 * (int(budget) + 1)
            ramp = np.arange(width)
            for c in range(0, len(all_some), 256):
                some = all_some[c : c + 256]
                item = self.item[segment[some]]
                low = band[some] * step - step + self.at[segment[some]]
                sizes = self.size[item]
                here = (self.begin[item] + self.at[segment[some]])[:, None] + np.minimum(np.arange(sizes.max()), sizes[:, None] - 1)
                pattern = self.text[here]
                begin, end = cuts[doc[some]], cuts[doc[some] + 1]
                cost = np.zeros((len(some), width), np.int64)
                best = np.full(len(some), 1 << 30)
                for i in range(pattern.shape[1]):
                    j = low[:, None] + ramp + i
                    fits = (j >= begin[:, None]) & (j < end[:, None])
                    off = (text[np.clip(j, 0, len(text) - 1)] != pattern[:, i, None]) | ~fits
                    after = cost + off + np.where(fits, 0, 1 << 20)
                    after[:, :-1] = np.minimum(after[:, :-1], cost[:, 1:] + 1)
                    cost = np.minimum.accumulate(after - ramp, axis=1) + ramp
                    done = sizes == i + 1
                    best[done] = cost[done].min(1)
                edits[some] = best
                start[some] = low + step
        return edits, start


def _spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[i], begin[i] + 1, ... count[i] of them, for every i in a row."""
    before = np.cumsum(count) - count
    return np.repeat(begin - before, count) + np.arange(int(count.sum()))


class Index:
    """Benchmark items, held by the way in which they are searched."""

    def __init__(self, items: list[tuple[int, bytes]], rate: float = RATE):
        by_q: dict[int, list[tuple[int, np.ndarray]]] = {Q: [], SHORT_Q: []}
        short: list[tuple[int, bytes]] = []
        for item, text in items:
            raw = np.frombuffer(text, np.uint8)
            clean, _, _ = normal(raw, np.array([0, len(raw)]))
            clean = clean[:-1] if len(clean) and clean[-1] == 32 else clean
            if len(clean) >= LEAST:
                by_q[Q if len(clean) >= SHORT else SHORT_Q].append((item, clean))
            elif len(clean):
                short.append((item, clean.tobytes()))
        self.grams = [Grams(some, q, rate) for q, some in by_q.items() if some]
        # Short items by their number of words: (words, ascending hashes, items by hash).
        self.short: list[tuple[int, np.ndarray, dict[int, list[tuple[int, bytes]]]]] = []
        for words in sorted({t.count(b" ") + 1 for _, t in short}):
            held: dict[int, list[tuple[int, bytes]]] = {}
            for item, t in short:
                if t.count(b" ") + 1 == words:
                    h = span_hash(prefix_hash(np.frombuffer(t, np.uint8)), np.array([0]), np.array([len(t)]))[0]
                    held.setdefault(int(h), []).append((item, t))
            self.short.append((words, np.array(sorted(held), np.uint64), held))

    def exact(self, text: np.ndarray, cuts: np.ndarray) -> set[tuple[int, int]]:
        """(document, item) of every short item that stands, word by word, in some texts."""
        found: set[tuple[int, int]] = set()
        if not self.short:
            return found
        # Every word has one space behind it, but the last of a block may have none.
        space = text == 32
        first = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]) if len(text) else space)
        starts = cuts[:-1][cuts[:-1] < len(text)]
        first = np.unique(np.concatenate([first, starts[~space[starts]]]))
        last = np.flatnonzero(~space & np.append(space[1:], True))
        ends = cuts[1:][cuts[1:] > 0] - 1
        last = np.unique(np.concatenate([last, ends[~space[ends]]])) + 1
        owner = np.searchsorted(cuts, first, "right") - 1
        sums = prefix_hash(text)
        for words, hashes, held in self.short:
            n = len(first) - words + 1
            if n < 1:
                continue
            inside = np.flatnonzero(owner[:n] == owner[words - 1 :])
            h = span_hash(sums, first[inside], last[inside + words - 1])
            for k in np.flatnonzero(np.isin(h, hashes)):
                i = inside[k]
                part = text[first[i] : last[i + words - 1]].tobytes()
                found |= {(int(owner[i]), item) for item, t in held[int(h[k])] if t == part}
        return found

    def matches(self, raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, fewest edits, start byte) of every item found in a block of lower-cased texts."""
        text, cuts, origin = normal(raw, offsets)
        for grams in self.grams:
            for d, i, e, at in zip(*(x.tolist() for x in grams.matches(text, cuts)), strict=True):
                yield d, grams.names[i], e, int(origin[min(max(at, 0), len(origin) - 1)] - offsets[d])
        for d, item in sorted(self.exact(text, cuts), key=repr):
            yield d, item, 0, 0


def find(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, text: str = "text", id_col: str = "doc_id", carry: tuple[str, ...] = (), pass_chars: int = PASS_CHARS) -> DataFrame:
    """(id, contaminated, n_items, items array<long>, edits, *carry): one row per row of `docs`.

    `benchmark` has item_id and text. items lists the benchmark items of which a segment occurs within the edit budget
    of RATE, ascending; edits is the fewest edits of any (null: none). Case, punctuation and white space don't count.
    Any part of an item of QUOTE characters or more is found, wherever it begins, and shorter items as a whole; items of
    fewer than LEAST characters count where all their words stand in a row, items without words nowhere.
    The benchmark is held by every task in passes of at most `pass_chars` characters, each of which reads the documents
    again, one after the other, and leaves only its hits; the documents are never shuffled while one pass is enough. Null
    texts count as empty, null items are not searched, repeated rows and items don't matter, other columns are dropped
    unless named in `carry`.
    """
    items = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), utf8(lower=True).alias("t"))
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    passes = max(1, -(-size // pass_chars))
    source = docs.select(F.col(id_col), utf8(text, lower=True).alias("_text"), *(F.col(f"`{c}`") for c in carry))

    def searched(rows: DataFrame, p: int, kept: list[str]) -> DataFrame:
        part = items.where(F.pmod(F.xxhash64("t"), F.lit(passes)) == p).collect()  # at most about pass_chars
        index = docs.sparkSession.sparkContext.broadcast([(r.item_id, bytes(r.t)) for r in part])
        first = rows.schema[0]
        out = [first.name, "contaminated", "n_items", "items", "edits", *kept]

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = Index(index.value, rate)
            for batch in batches:
                n = batch.num_rows
                lists: list[set] = [set() for _ in range(n)]
                least: list[int | None] = [None] * n
                for i, raw, offsets in blocks(*flat(batch.column(1))):
                    for d, item, e, _ in held.matches(raw, offsets):
                        lists[i + d].add(item)
                        least[i + d] = e if least[i + d] is None else min(e, least[i + d])
                found = [sorted(x, key=lambda v: (v is None, v)) for x in lists]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([bool(x) for x in found], pa.bool_()), pa.array([len(x) for x in found], pa.int64()), pa.array(found, pa.list_(pa.int64())), pa.array(least, pa.int64()), *batch.columns[2:]],
                    names=out,
                )

        schema = ", ".join([f"`{first.name}` {first.dataType.simpleString()}, contaminated boolean, n_items long, items array<long>, edits long", *(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)])
        found = map_batches(rows, work, schema)
        if passes == 1:
            return found
        hits = stored(found.where("contaminated").dropDuplicates(["_key"]).select("_key", "items", "edits"), "hits")
        index.destroy()
        return hits

    if passes == 1:
        return searched(source, 0, list(carry))
    keyed = source.withColumn("_key", F.struct(F.xxhash64(id_col).alias("a"), F.xxhash64("_text").alias("b")))
    hits = None
    for p in range(passes):
        some = searched(keyed.select("_key", "_text"), p, [])
        hits = some if hits is None else hits.unionAll(some)
    # A document's hits: at most one row a pass.
    hits = hits.groupBy("_key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.min("edits").alias("edits"))
    whole = keyed.drop("_text").join(hits, "_key", "left").withColumn("items", F.coalesce("items", F.array().cast("array<long>")))
    return whole.select(id_col, (F.size("items") > 0).alias("contaminated"), F.size("items").cast("long").alias("n_items"), "items", "edits", *(F.col(f"`{c}`") for c in carry))
