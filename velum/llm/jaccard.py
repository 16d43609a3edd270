"""N-gram Jaccard join: MinHash banding, shuffle on band hashes, verification on full n-gram sets.

1. Texts with the same set of word n-grams form a class of copies, represented by their smallest id.
2. Every representative gets a MinHash signature. Bands and rows follow from the similarity and the wanted recall.
   Representatives that share a band are tied to the smallest of them: one tie each, however large the bucket.
3. Groups of tied representatives are compared on their full n-gram sets. A large group is dealt to pairs of blocks:
   by set size, where sizes too far apart for the similarity never meet, if its members are close to each other; by
   band bucket, where a pair counts in the first bucket that it shares, if they merely hang together in chains.
4. Links found give each representative its number and a root; roots are joined to classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velum.llm.common import block_units, blocks, components, flat, link_roots, map_batches, mix, prefix_hash, runs, span_hash, stored, utf8, words_of

WORDS, SIMILARITY = 5, 0.8
#: Chance at least with which a pair of exactly SIMILARITY shares a band, and signature values at most.
RECALL, MOST_VALUES = 0.9999, 128
#: Documents, and n-grams, of a block.
BLOCK_DOCS, BLOCK_GRAMS = 1024, 1_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def plan_bands(similarity: float = SIMILARITY, recall: float = RECALL, most: int = MOST_VALUES) -> tuple[int, int]:
    """(bands, rows): the most rows, hence the fewest false ties, whose bands reach the recall within `most` values."""
    found = (most, 1)
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-min(similarity**rows, 1 - 1e-9)))
        if bands * rows > most:
            break
        found = (bands, rows)
    return found


def gram_sets(raw: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the distinct word n-grams of each text of a block, ascending.

    A text with fewer words than `words` has one gram of all its words; a text without words has none.
    """
    n = len(offsets) - 1
    start, end, owner = words_of(raw, offsets)
    word = span_hash(prefix_hash(raw), start, end)
    size = np.bincount(owner, minlength=n)
    with np.errstate(over="ignore"):
        gram = np.zeros(max(0, len(word) - words + 1), np.uint64)
        for k in range(words):
            gram = mix(gram * _STEP + word[k : k + len(gram)])
        full = np.flatnonzero(owner[: len(gram)] == owner[words - 1 : words - 1 + len(gram)]) if len(gram) else np.zeros(0, np.int64)
        first = np.cumsum(size) - size
        short = np.flatnonzero((size > 0) & (size < words))
        lone = size[short].astype(np.uint64)
        for k in range(words - 1):
            has = size[short] > k
            lone[has] = mix(lone[has] * _STEP + word[first[short][has] + k])
    value, of = np.concatenate([gram[full], lone]), np.concatenate([owner[full], short])
    order = np.lexsort((value, of))
    value, of = value[order], of[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    return value[new], np.concatenate([[0], np.cumsum(np.bincount(of[new], minlength=n))])


def signatures(value: np.ndarray, offsets: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes (texts x bands, uint64) of non-empty sets."""
    out = np.zeros((len(offsets) - 1, bands), np.uint64)
    keys = mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * _STEP) | np.uint64(1)
    with np.errstate(over="ignore"):
        for b in range(bands):
            held = np.full(len(out), b + 1, np.uint64)
            for r in range(rows):
                turned = value * keys[b * rows + r]
                held = mix(held * _STEP + np.minimum.reduceat(turned ^ (turned >> np.uint64(32)), offsets[:-1]))
            out[:, b] = held
    return out


def links(sets: list[np.ndarray], similarity: float, left: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) of sets with at least this Jaccard similarity.

    With `left` (a mask) only pairs of a set inside and one outside of it count. Intersections are counted by matrix
    products over slices of the shared grams.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    _, gram, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    some = count[gram] > 1
    gram, owner = gram[some], owner[some]
    common = np.zeros((n, n), np.float32)
    order = np.argsort(gram, kind="stable")
    gram, owner = gram[order], owner[order]
    dense = np.cumsum(np.concatenate([[0], np.diff(gram) != 0])) if len(gram) else gram
    width = max(64, 4_000_000 // n)
    for a in range(0, int(dense[-1]) + 1 if len(dense) else 0, width):
        i, j = np.searchsorted(dense, (a, a + width))
        part = np.zeros((n, min(width, int(dense[-1]) + 1 - a)), np.float32)
        part[owner[i:j], dense[i:j] - a] = 1
        common += part @ part.T
    union = sizes[:, None] + sizes[None, :] - common
    hit = (common >= similarity * union - 1e-9 * union) & (union > 0)
    hit = np.triu(hit, 1)
    if left is not None:
        hit &= left[:, None] != left[None, :]
    return np.nonzero(hit)


def text_key(text: str = "text") -> Column:
    """The hash that tells apart texts of one id; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def _numbered(copies: DataFrame) -> tuple[DataFrame, bool]:
    """`copies` with `rep`, which orders its rows like (id, t), and whether it is the id itself: where no id repeats."""
    if copies.groupBy("id").count().where("count > 1").isEmpty():
        return copies.withColumn("rep", F.col("id")), True
    ordered = copies.repartitionByRange("id", "t").sortWithinPartitions("id", "t")
    return stored(ordered.withColumn("rep", F.monotonically_increasing_id()), "numbered"), False


def _sets_of(docs: DataFrame, words: int, text: str, id_col: str, similarity: float, bands: int, rows: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, raw, offsets in blocks(*flat(batch.column(2))):
                value, cuts = gram_sets(raw, offsets, words)
                size = np.diff(cuts)
                some = np.flatnonzero(size > 0)
                mark, sums = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
                banded = np.zeros((len(size), bands), np.uint64)
                if len(some):
                    at = np.concatenate([cuts[some], [len(value)]])
                    mark[some] = np.bitwise_xor.reduceat(mix(value), cuts[some])
                    with np.errstate(over="ignore"):
                        sums[some] = np.add.reduceat(mix(value * _STEP), cuts[some])
                    banded[some] = signatures(value, at, bands, rows)
                listed = pa.FixedSizeListArray.from_arrays(pa.array(banded.view(np.int64).ravel()), bands).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(size)), batch.column(1).slice(i, len(size)), pa.array(size), pa.array(mark.view(np.int64)), pa.array(sums.view(np.int64)), listed], names=["id", "t", "grams", "m1", "m2", "bands"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col).alias("id"), text_key(text).alias("t"), utf8(text, lower=True).alias("_text")), work, f"id {kind}, t long, grams long, m1 long, m2 long, bands array<long>")


def units_of(copies: DataFrame, tied: DataFrame, group: DataFrame, similarity: float, block_docs: int, block_grams: int) -> DataFrame:
    """(rep, id, t, copies, unit, side, alone, seen): which representatives meet for comparison.

    `copies` has rep, id, t, copies, grams and bands, `tied` rep, grams, band, value, `group` the id and root of what ties
    hold together. A group within the block limits is one unit. Of a larger one both ways of dealing are priced by the
    pairs that meet, members squared against bucket sizes squared, and the cheaper one is taken. `seen` holds the bands
    before the one of a bucket: pairs that share one of them are counted there.
    """
    # Blocks by size class: linked sets differ by less than one class and so lie in the same or neighbouring classes.
    step = -math.log(similarity) if similarity < 1 else 1.0
    member = copies.join(group.select(F.col("id").alias("rep"), "root"), "rep").select("rep", "id", "t", "root", "copies", F.floor(F.log("grams") / step + 1e-9).cast("int").alias("c"), "grams", "bands")
    member = stored(member, "members")
    total = member.groupBy("root").agg(F.count("*").alias("docs"), F.sum("grams").alias("sum"))
    bucket = tied.groupBy("band", "value").agg(F.min("rep").alias("rep"), F.count("*").alias("n"), F.sum("grams").alias("sum")).where("n > 1")
    bucket = stored(bucket.select("band", "value", "rep", F.greatest(F.col("n"), F.ceil(F.col("sum") * block_docs / block_grams)).alias("n")), "buckets")
    price = bucket.join(member.select("rep", "root"), "rep").groupBy("root").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("price"))
    total = total.join(price, "root").select("root", F.when((F.col("docs") <= block_docs) & (F.col("sum") <= block_grams), 0).when(F.col("price") < F.col("docs").cast("double") * F.col("docs"), 2).otherwise(1).alias("way"))
    total = stored(total, "ways")
    placed = member.join(total, "root")
    nothing = F.array().cast("array<bigint>").alias("seen")
    lone = placed.where("way = 0").select("rep", "id", "t", "copies", F.xxhash64("root", F.lit(-1)).alias("unit"), F.lit(0).alias("side"), F.lit(True).alias("alone"), nothing)

    close = placed.where("way = 1").drop("bands")
    count = close.groupBy("root", "c").agg(F.greatest(F.ceil(F.count("*") / block_docs), F.ceil(F.sum("grams") / block_grams)).cast("int").alias("n"))
    near = lambda d: count.select("root", (F.col("c") + d).alias("c"), F.col("n").alias(f"n{d + 1}"))
    large = close.join(near(0), ["root", "c"]).join(near(-1), ["root", "c"], "left").join(near(1), ["root", "c"], "left")
    # n1: blocks of the own class, n0: of the next larger class (its row was shifted down), n2: of the next smaller one.
    mine = F.pmod(F.xxhash64("rep"), F.col("n1").cast("long")).cast("int")
    spread = lambda n: F.when(F.col(n).isNotNull(), F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    same = F.transform(spread("n1"), lambda o: F.struct(F.col("c").alias("c0"), F.least("mine", o).alias("b0"), F.col("c").alias("c1"), F.greatest("mine", o).alias("b1"), (F.col("mine") > o).cast("int").alias("side"), (F.col("mine") == o).alias("alone")))
    above = F.transform(spread("n0"), lambda o: F.struct(F.col("c").alias("c0"), F.col("mine").alias("b0"), (F.col("c") + 1).alias("c1"), o.alias("b1"), F.lit(0).alias("side"), F.lit(False).alias("alone")))
    below = F.transform(spread("n2"), lambda o: F.struct((F.col("c") - 1).alias("c0"), o.alias("b0"), F.col("c").alias("c1"), F.col("mine").alias("b1"), F.lit(1).alias("side"), F.lit(False).alias("alone")))
    dealt = large.withColumn("mine", mine).select("rep", "id", "t", "copies", "root", F.explode(F.concat(same, above, below)).alias("u"))
    dealt = dealt.select("rep", "id", "t", "copies", F.xxhash64("root", "u.c0", "u.b0", "u.c1", "u.b1").alias("unit"), "u.side", "u.alone", nothing)

    chained = placed.where("way = 2").select("rep", "id", "t", "copies", F.posexplode("bands").alias("band", "value"), "bands").join(bucket.select("band", "value", "n"), ["band", "value"])
    chained = block_units(chained.withColumn("key", F.xxhash64("band", "value")), "key", "rep", "n", block_docs)
    chained = chained.select("rep", "id", "t", "copies", "unit", "side", "alone", F.slice("bands", F.lit(1), F.col("band")).alias("seen"))
    return lone.unionAll(dealt).unionAll(chained)


def join(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, recall: float = RECALL, text: str = "text", id_col: str = "doc_id", block_docs: int = BLOCK_DOCS, block_grams: int = BLOCK_GRAMS, by_row: bool = False) -> DataFrame:
    """(id, class_id, n_links, kept): one row per row of `docs` (integer ids).

    Words are runs of digits, letters and characters beyond ASCII of the lower-cased text. n_links counts the other rows
    whose n-gram set has at least `similarity` with this one's, class_id is the smallest id that links reach, kept marks
    that one. Null, empty and wordless texts link with nothing. Repeated rows are copies of each other (kept marks all
    rows of the smallest id); different texts under one id are rows of their own. A null id never links and is its own
    class (null, kept). Extra columns are dropped; an empty table gives an empty table. With `by_row` two columns more:
    _t, the text_key() of the row, and first, which marks of every class one text of the smallest id.
    """
    bands, rows = plan_bands(similarity, recall)
    sets = stored(_sets_of(docs, words, text, id_col, similarity, bands, rows), "sets")
    live = sets.where("grams > 0 AND id IS NOT NULL")
    copies = live.groupBy("grams", "m1", "m2").agg(F.min(F.struct(F.col("id").cast("long").alias("id"), "t")).alias("r"), F.count("*").alias("copies"), F.any_value("bands").alias("bands"))
    copies, by_id = _numbered(stored(copies.select("grams", "m1", "m2", "r.id", "r.t", "copies", "bands"), "copies"))

    tied = copies.select("rep", "grams", F.posexplode("bands").alias("band", "value"))
    centre = tied.groupBy("band", "value").agg(F.min("rep").alias("b"), F.count("*").alias("n")).where("n > 1")
    ties = tied.join(centre, ["band", "value"]).select(F.col("rep").alias("a"), "b").where("a != b").distinct()
    group = components(ties)

    units = units_of(copies, tied, group, similarity, block_docs, block_grams)

    wanted = units.groupBy("id", "t", "rep").agg(F.max("copies").alias("copies"), F.collect_list(F.struct("unit", "side", "alone", "seen")).alias("u"))
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), text_key(text).alias("t"), utf8(text, lower=True).alias("_text"))
    fetched = texts.join(wanted, ["id", "t"])

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, raw, offsets in blocks(*flat(batch.column(1))):
                value, cuts = gram_sets(raw, offsets, words)
                data, n = value.tobytes(), len(cuts) - 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), batch.column(2).slice(i, n), batch.column(3).slice(i, n), pa.array([data[a * 8 : b * 8] for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())], names=["rep", "copies", "u", "grams"])

    shape = "u array<struct<unit:long,side:int,alone:boolean,seen:array<long>>>"
    ready = map_batches(fetched.select("rep", "_text", "copies", "u"), full, f"rep long, copies long, {shape}, grams binary")
    ready = ready.select("rep", "copies", "grams", F.explode("u").alias("u")).select("u.unit", "rep", "copies", "u.side", "u.alone", "u.seen", "grams")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "unit"):
            values, ids = table.column("grams").to_pylist(), table.column("rep").to_pylist()
            first = sorted({(ids[i], values[i]): i for i in range(len(ids))}.items())  # equal rows were fetched together
            if len(first) < 2:
                continue
            at = np.array([i for _, i in first])
            rep, copies, side = (table.column(c).to_numpy()[at] for c in ("rep", "copies", "side"))
            a, b = links([np.frombuffer(values[i], np.uint64) for i in at], similarity, None if table.column("alone")[0].as_py() else side == 0)
            before = table.column("seen")
            if len(a) and len(before[0]):
                shared = np.array([before[int(i)].as_py() for i in at], np.int64)
                new = np.array([not (shared[i] == shared[j]).any() for i, j in zip(a, b, strict=True)])
                a, b = a[new], b[new]
            if not len(a):
                continue
            n = np.bincount(a, copies[b], len(rep)) + np.bincount(b, copies[a], len(rep))
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(n[some].astype(np.int64)), pa.array(rep[link_roots(len(rep), a, b)][some])], names=["rep", "n", "root"])

    found = stored(map_batches(ready.repartition("unit").sortWithinPartitions("unit"), compare, "rep long, n long, root long"), "links")
    classes = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    own = copies.join(counts, "rep", "left").join(classes.select(F.col("id").alias("rep"), "root"), "rep", "left")
    own = own.select("grams", "m1", "m2", F.struct("id", "t").alias("least"), F.coalesce("root", "rep").alias("root"), (F.coalesce("root", "rep") == F.col("rep")).alias("top"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    if by_id:
        own = own.withColumn("class_id", F.col("root"))
    else:
        own = stored(own, "own").join(copies.select(F.col("rep").alias("root"), F.col("id").alias("class_id")), "root")
    kind = docs.schema[id_col].dataType.simpleString()
    out = live.join(own, ["grams", "m1", "m2"]).select(F.col("id").alias(id_col), F.col("class_id").cast(kind).alias("class_id"), "n_links", F.col("t").alias("_t"), (F.col("top") & (F.struct(F.col("id").cast("long"), "t") == F.col("least"))).alias("first"))
    rest = sets.where("grams = 0 OR id IS NULL").select(F.col("id").alias(id_col), F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("t").alias("_t"), F.lit(True).alias("first"))
    kept = out.unionAll(rest).withColumn("kept", F.col(id_col).eqNullSafe(F.col("class_id")))
    return kept.select(id_col, "class_id", "n_links", "kept", *(("_t", "first") if by_row else ()))
