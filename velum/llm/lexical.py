"""Ranked lexical search over a tiered index, exact.

The index has the forward rows of all documents (terms and counts) and, of each term, the postings of highest impact in
tiers: tier t holds a term's best postings, at most TIERS[t] of them with those of the tiers before. What a term can
still add below a tier is its residual bound. A search reads the first tier for all items. An item is proven when the
residuals of all its terms together stay below its k-th best score so far, as no other document can then reach it; the
documents that may be among its best are scored in full from their forward rows. Items without that proof fall through
to the next tier, and at last to the forward rows of all documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velum.llm.common import discard, map_batches, stored, utf8

#: Most postings of a term up to each tier; a set of equal impacts that doesn't fit waits for a later tier.
TIERS = tuple(1024 * 4**t for t in range(7))
#: Impacts are counted by term in steps of this size (they are below 10^6).
STEP = 1024
#: Terms up to which a table of terms is broadcast, and up to which an index is limited to the terms of given items.
MOST_TERMS = 200_000
#: Items and terms of items that a pass of the search treats; more are treated in several passes.
MOST_ITEMS, MOST_ENTRIES = 2_000, 200_000
#: Candidates up to which they are broadcast to the forward rows.
MOST_BROADCAST = 200_000
#: Scores of a block of documents that a task holds at once.
BLOCK_SCORES = 1 << 22

_term = re.compile(rb"[0-9a-z\x80-\xff]+")


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8: runs of letters, digits and all beyond ASCII; only A-Z are lower-cased."""
    return _term.findall(text.lower())


def forward(docs: DataFrame, only: list[bytes] | None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(row long, id, n long, terms array<string>, tfs array<int>): the counted terms of each whole text.

    n counts all terms with repeats; with `only`, just these are listed. `row` is an own number for each row, as ids may
    repeat or be null: the result must be stored before it is used twice.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    wanted = docs.sparkSession.sparkContext.broadcast(None if only is None else frozenset(only))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = wanted.value
        for batch in batches:
            sizes, terms, tfs, ends = [], [], [], [0]
            for one in batch.column(2):
                found = terms_of(one.as_py())
                sizes.append(len(found))
                count = Counter(found)
                for t in count if keep is None else count.keys() & keep:
                    terms.append(t.decode("utf-8", "replace"))
                    tfs.append(count[t])
                ends.append(len(terms))
            at = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(terms, pa.string())), pa.ListArray.from_arrays(at, pa.array(tfs, pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), *lists], names=["row", id_col, "n", "terms", "tfs"])

    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col), utf8(text).alias("_text"))
    return map_batches(source, work, f"row long, `{id_col}` {kind}, n long, terms array<string>, tfs array<int>")


@dataclass
class Index:
    """The tables of an index and its totals.

    forward: see forward(); upper: (tier, term, row, base), base being what a posting adds before the weight w of its
    term; terms: (term, df, w, floors, rests), for each tier the least base in it and the residual bound below it.
    """

    forward: DataFrame
    upper: DataFrame
    terms: DataFrame
    documents: int
    length: int
    tiers: tuple[int, ...]
    id_col: str
    only: frozenset[bytes] | None

    def discard(self) -> None:
        """Delete the written tables; nothing may search any more."""
        for table in (self.forward, self.upper, self.terms):
            discard(table)


def _base(n: Column, tf: Column, documents: int, length: int) -> Column:
    """What one posting adds, before the weight of its term."""
    m = F.lit(75) + F.call_function("div", F.lit(25) * n * F.lit(documents), F.lit(max(length, 1)))
    tf = tf.cast("long")
    return F.call_function("div", F.lit(1_000_000_000).cast("long") * tf, F.lit(1000) * tf + F.lit(12) * m)


def index(docs: DataFrame, only: list[bytes] | None = None, tiers: tuple[int, ...] = TIERS, text: str = "text", id_col: str = "doc_id") -> Index:
    """The index of all rows of `docs` (id, text), of all their terms or of those in `only` (for items with no others).

    Null and empty texts have no terms; null and repeated ids are rows of their own; extra columns are dropped. The
    texts are read once. Terms are counted by impact before the shuffle, in at most 10^6 / STEP rows a term and task;
    only postings of the tiers are dealt out, so a term that all documents hold is no hot key.
    """
    rows = stored(forward(docs, only, text, id_col), "forward")
    documents, length = rows.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    posting = rows.select("row", "n", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select("row", F.col("p.terms").alias("term"), _base(F.col("n"), F.col("p.tfs"), documents, length).alias("base"))
    counted = posting.groupBy("term", F.call_function("div", "base", F.lit(STEP)).alias("step")).agg(F.count("*").alias("n"), F.max("base").alias("top"))
    down = Window.partitionBy("term").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("upto", F.sum("n").over(down))
    weight = F.floor(F.lit(1000.0) * F.log((F.lit(2.0) * documents + 2.0) / (F.lit(2.0) * F.col("df") + 1.0)))
    floors = F.array(*(F.min(F.when(F.col("upto") <= t, F.col("step") * STEP)) for t in tiers))
    rests = F.array(*(F.coalesce(F.max(F.when(F.col("upto") > t, F.col("top"))), F.lit(0)) for t in tiers))
    about = ranked.groupBy("term").agg(F.sum("n").alias("df"), floors.alias("floors"), rests.alias("rests"))
    about = about.withColumn("w", weight).withColumn("rests", F.transform("rests", lambda x: x * F.col("w")))
    about = stored(about, "terms")
    few = about.count() <= MOST_TERMS
    reached = F.filter(F.transform("floors", lambda f, i: F.when(F.col("base") >= f, i)), lambda i: i.isNotNull())
    floors = F.broadcast(about.select("term", "floors")) if few else about.select("term", "floors")
    upper = posting.join(floors, "term").withColumn("tier", F.get(reached, F.lit(0))).where("tier IS NOT NULL").select("tier", "term", "row", "base")
    upper = stored(upper.repartitionByRange("tier", "term", "row").sortWithinPartitions("tier", "term"), "upper")
    return Index(rows, upper, about, documents, length, tiers, id_col, None if only is None else frozenset(only))


def _top(rows: DataFrame, by: list[Column], k: int) -> DataFrame:
    """The first k rows of each item, with their number."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*by))).where(F.col("rank") <= k)


def _score(idx: Index, rows: DataFrame, asked: list, least: dict[int, int]) -> DataFrame:
    """(item, id, row, score): full scores of forward rows for the items in their array `items`, null there for all of `least`.

    `asked` holds (item, term, q * w) of all items of the pass, `least` the score from which an item is answered.
    """
    items = np.array(sorted(least), np.int64)
    place = {a: i for i, a in enumerate(items.tolist())}
    terms = sorted({t for a, t, _ in asked if a in place})
    number = {t: i for i, t in enumerate(terms)}
    entries = sorted((number[t], place[a], v) for a, t, v in asked if a in place)
    of, item, value = (np.array([e[i] for e in entries], np.int64) for i in range(3))
    begin = np.searchsorted(of, np.arange(len(terms) + 1))
    bound = np.array([max(1, least[a]) for a in items.tolist()], np.int64)
    packed = rows.sparkSession.sparkContext.broadcast((pa.array(terms, pa.string()), begin, item, value, items, bound))
    documents, length, id_col = idx.documents, max(idx.length, 1), idx.id_col

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, begin, item, value, items, bound = packed.value
        for batch in batches:
            lists = batch.column("terms")
            at = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
            known = pc.index_in(pc.list_flatten(lists), value_set=terms).fill_null(-1).to_numpy().astype(np.int64)
            tf = pc.list_flatten(batch.column("tfs")).to_numpy().astype(np.int64)
            m = 75 + (25 * batch.column("n").to_numpy() * documents) // length
            own = np.repeat(np.arange(batch.num_rows), np.diff(at))
            base = (1_000_000_000 * tf) // (1000 * tf + 12 * m[own])
            only = batch.column("items")
            step = max(1, BLOCK_SCORES // max(1, len(items)))
            for a in range(0, batch.num_rows, step):
                b = min(a + step, batch.num_rows)
                here = np.arange(at[a], at[b])
                here = here[known[here] >= 0]
                count = begin[known[here] + 1] - begin[known[here]]
                entry = np.repeat(begin[known[here]] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum()) if len(here) else here
                scores = np.zeros((b - a) * len(items), np.int64)
                np.add.at(scores, np.repeat(own[here] - a, count) * len(items) + item[entry], np.repeat(base[here], count) * value[entry])
                scores = scores.reshape(b - a, len(items))
                good = scores >= bound
                for i in range(a, b):
                    if only[i].is_valid:
                        good[i - a] &= np.isin(items, only[i].values.to_numpy())
                r, c = np.nonzero(good)
                columns = [pa.array(items[c]), batch.column(id_col).take(pa.array(r + a)), batch.column("row").take(pa.array(r + a)), pa.array(scores[r, c])]
                yield pa.RecordBatch.from_arrays(columns, names=["item", "id", "row", "score"])

    return map_batches(rows.select("row", id_col, "n", "terms", "tfs", "items"), work, f"item long, id {rows.schema[id_col].dataType.simpleString()}, row long, score long")


def _search_pass(idx: Index, asked: DataFrame, k: int) -> DataFrame:
    """(item, rank, id, score) of the items in `asked` (item, term, q), few enough for one pass."""
    spark = asked.sparkSession
    joined = asked.join(idx.terms, "term", "left").select("item", "term", (F.col("q") * F.col("w")).alias("value"), F.transform("rests", lambda x: x * F.col("q")).alias("rests"))
    collected = joined.collect()
    if idx.only is not None and any(r["value"] is None and r["term"].encode() not in idx.only for r in collected):
        raise ValueError("the index doesn't hold the terms of these items")
    known = [(r["item"], r["term"], r["value"], r["rests"]) for r in collected if r["value"] is not None]
    everything = [(a, t, v) for a, t, v, _ in known]
    open_ = {a for a, *_ in known}
    least: dict[int, int] = {}
    proven: list[DataFrame] = []
    for t in range(len(idx.tiers)):
        if not open_:
            break
        entry = F.broadcast(spark.createDataFrame([(a, term, value, rests[t]) for a, term, value, rests in known if a in open_], "item long, term string, value long, rest long"))
        hits = idx.upper.where(F.col("tier") <= t).join(entry, "term").groupBy("item", "row").agg(F.sum(F.col("base") * F.col("value")).alias("score"), F.sum("rest").alias("seen"))
        hits = stored(hits, "hits")
        kth = {r["item"]: r["score"] for r in _top(hits, [F.desc("score")], k).where(F.col("rank") == k).collect()}
        rest = Counter()
        for a, _, _, rests in known:
            if a in open_:
                rest[a] += rests[t]
        closed = [a for a in open_ if rest[a] == 0 or rest[a] < kth.get(a, 0)]
        least |= {a: kth.get(a, 0) for a in open_}
        if closed:
            bound = F.broadcast(spark.createDataFrame([(a, rest[a], kth.get(a, 0)) for a in closed], "item long, rest long, kth long"))
            may = hits.join(bound, "item").where("score + rest - seen >= kth").select("item", "row")
            proven.append(stored(may, "candidates"))
        discard(hits)
        open_ -= set(closed)
    parts = []
    if proven:
        may = proven[0]
        for more in proven[1:]:
            may = may.unionAll(more)
        may = may.groupBy("row").agg(F.collect_list("item").alias("items"))
        few = sum(p.count() for p in proven) <= MOST_BROADCAST
        parts.append(_score(idx, idx.forward.join(F.broadcast(may) if few else may, "row"), everything, {a: v for a, v in least.items() if a not in open_}))
    if open_:
        rows = idx.forward.where(F.size("terms") > 0).withColumn("items", F.lit(None).cast("array<long>"))
        parts.append(_score(idx, rows, everything, {a: least[a] for a in open_}))
    if not parts:
        return spark.createDataFrame([], f"item long, rank int, id {idx.forward.schema[idx.id_col].dataType.simpleString()}, score long")
    scored = parts[0] if len(parts) == 1 else parts[0].unionAll(parts[1])
    best = stored(_top(scored, [F.desc("score"), F.asc("id"), F.asc("row")], k).select("item", "rank", "id", "score"), "best")
    for p in proven:
        discard(p)
    return best


def search(idx: Index, items: DataFrame, k: int = 20, text: str = "text", item_col: str = "item_id") -> DataFrame:
    """(item id, rank int, doc id, score long): the k rows of highest score above 0 for each row of `items`.

    Equal scores come by ascending id of the document (null first). Items that are repeated or share an id are answered
    each by itself; ones with a null, an empty or an unknown text have no answers; extra columns are dropped. Items are
    treated in passes of bounded size, whose terms and bounds are broadcast; all else stays distributed.
    """
    rows = stored(forward(items, None, text, item_col), "items")
    count, entries = rows.where("n > 0").agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    passes = max(1, -(-count // MOST_ITEMS), -(-entries // MOST_ENTRIES))
    asked = rows.select(F.col("row").alias("item"), F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select("item", F.col("p.terms").alias("term"), F.col("p.tfs").cast("long").alias("q"))
    out = None
    for i in range(passes):
        found = _search_pass(idx, asked.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == i), k)
        out = found if out is None else out.unionAll(found)
    named = rows.select(F.col("row").alias("item"), F.col(item_col).alias("_item"))
    return out.join(named, "item").select(F.col("_item").alias(item_col), "rank", F.col("id").alias(idx.id_col), "score")


def vocabulary(items: DataFrame, text: str = "text", most: int = MOST_TERMS) -> list[bytes] | None:
    """The terms of all items, or None if they are more than `most` (an index of all terms then serves as well)."""
    rows = forward(items.select(F.lit(0).alias("doc_id"), text), None, text)
    found = rows.select(F.explode("terms").alias("term")).distinct().limit(most + 1).collect()
    return None if len(found) > most else [r["term"].encode() for r in found]
