import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from velum.llm import centroids, lexical, pieces, queries

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("piece_bpe_32k.model")


# --- pieces -----------------------------------------------------------------------------------------------------------


def odd_texts(n=1500, seed=1):
    rng = random.Random(seed)
    fixed = ["", " ", "  ", "a", " a", "a ", "  a  b   ", "\x00", "<s> </s> <unk> <0x0A>", "▁a▁▁b", "你好  世界 ﬁ", "\n\n\t x", "a" * 5000, "=" * 3001, " " * 777, "ab" * 900, "- " * 300, "🙂‍👩 é �", "w" + " " * 40 + "\n" * 30]
    kinds = ["ab ", "abcdefghijklmnopqrstuvwxyz  ", "etaoin srhld", "=- \n#*", "你好世 aé", "0123456789abcdef", "the in er ", "((){}[];\n    "]
    return fixed + ["".join(rng.choices(rng.choice(kinds), k=rng.randint(1, rng.choice([5, 40, 400])))) for _ in range(n)]


def test_pieces_equal_the_library():
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    codec = pieces.Codec(open(PATH, "rb").read())
    texts = odd_texts()
    want = library.encode(texts)
    assert [x.tolist() for x in codec.encode(texts)] == want
    for ids, (n, a, b) in zip(want, codec.digests(texts), strict=True):
        assert (n, a, b) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    rng = random.Random(2)
    for _ in range(2000):  # bytes that make no character, control ids, the unknown id
        ids = [rng.choice([rng.randrange(32000), rng.randrange(260)]) for _ in range(rng.randrange(9))]
        assert codec.model.decode(ids) == library.decode(ids)


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 50)
    codec, library = pieces.Codec(open(PATH, "rb").read()), sentencepiece.SentencePieceProcessor(model_file=PATH)
    for some in np.array_split(np.array(odd_texts(200), dtype=object), 20):
        assert [x.tolist() for x in codec.encode(list(some))] == library.encode(list(some))
        assert len(codec.places) <= 50 + sum(len(t) for t in some)


def test_long_words_take_few_rounds():
    """A word that nothing cuts: rounds follow its distinct pieces, not its length."""
    rng = random.Random(3)
    word = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=60_000))
    codec = pieces.Codec(open(PATH, "rb").read())
    assert next(codec.encode([word])).tolist() == sentencepiece.SentencePieceProcessor(model_file=PATH).encode(word)


def test_pieces_in_spark(spark):
    rows = [(1, "Hello  world\n"), (2, None), (None, "x"), (1, "Hello  world\n"), (3, "")]
    table = spark.createDataFrame([(*r, 7, "b") for r in rows], "doc_id long, text string, n_tokens int, ids string")
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    encoded = pieces.encode(table, PATH)
    assert sorted(map(repr, ((r.doc_id, list(r.ids)) for r in encoded.collect()))) == sorted(repr((a, library.encode(t or ""))) for a, t in rows)
    assert sorted(map(repr, map(tuple, pieces.decode(encoded, PATH).collect()))) == sorted(repr((a, t or "")) for a, t in rows)
    assert pieces.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), PATH).first().text == ""
    assert pieces.digests(table.limit(0), PATH).count() == 0
    got = {r.doc_id: r for r in queries.op11_sentencepiece(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    for d in docs:
        ids = library.encode(d.text or "")
        assert (got[d.doc_id].n_tokens, got[d.doc_id].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[d.doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        pieces.Model(b"\x0a\x05\x0a\x03abc")


# --- clusters ---------------------------------------------------------------------------------------------------------


def brute_clusters(x, c, rounds):
    c = [list(map(int, r)) for r in c]
    near = lambda v: min(range(len(c)), key=lambda k: (sum((a - b) ** 2 for a, b in zip(v, c[k], strict=True)), k))
    for _ in range(rounds):
        of = [near(v) for v in x]
        for k in range(len(c)):
            own = [v for v, o in zip(x, of, strict=True) if o == k]
            if own:
                c[k] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    return [near(v) for v in x], c


@pytest.mark.parametrize(("top", "dims", "k", "group_size"), [(3, 2, 9, 2), (60, 8, 16, 4), (1 << 24, 5, 12, 3), (2, 3, 16, 16), (40, 4, 5, 1)])
def test_bounds_lose_no_centroid(top, dims, k, group_size):
    """Small components make many ties, large ones leave double arithmetic."""
    rng = np.random.default_rng(top)
    for _ in range(20):
        x = rng.integers(-top, top + 1, (150, dims))
        x[75:100] = x[:25]
        c = x[rng.choice(150, k, replace=False)]
        group = centroids.groups(c, max(1, round(k / group_size)))
        assert sorted(set(group)) == list(range(group.max() + 1))
        b, now = centroids.first_bounds(x, c, group), c
        for _ in range(5):
            after = now.copy()
            for j in np.unique(b.cluster):
                after[j] = [int(s) // int((b.cluster == j).sum()) for s in x[b.cluster == j].sum(0)]
            moved = np.sqrt(((after - now).astype(float) ** 2).sum(1)) * (1 + centroids.SLACK)
            b, measured = centroids.next_bounds(x, after, group, moved, b)
            now = after
            assert (b.cluster == centroids.squared(x, now).argmin(1)).all()
        assert measured.sum() <= len(x) * (k + 1)


def test_bounds_spare_work():
    rng = np.random.default_rng(5)
    heart = rng.integers(-400, 400, (16, 16))
    x = heart[rng.integers(0, 16, 4000)] + rng.integers(-20, 21, (4000, 16))
    group = centroids.groups(heart, 4)
    b = centroids.first_bounds(x, heart, group)
    _, measured = centroids.next_bounds(x, heart + 1, group, np.full(16, 4.0), b)
    assert measured.mean() < 2


def test_cluster_in_spark(spark):
    rng = np.random.default_rng(8)
    rows = [(int(i), [float(v) for v in rng.normal(size=6)]) for i in range(120)]
    rows += [(3, rows[3][1]), (200, rows[3][1]), (None, rows[5][1]), (201, None), (202, []), (203, [1.0] * 5), (204, [1.0] * 5 + [None]), (205, [1.0] * 5 + [math.nan]), (206, [math.inf] * 6), (207, [0.0] * 6), (207, [0.0] * 6)]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, cluster int, x int")
    vectors = centroids.scaled(table, 6)
    start = centroids.by_hash(vectors, 7)
    live = [(a, [math.floor(64 * c) for c in v]) for a, v in rows if v and len(v) == 6 and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted(((hashlib.sha256(f"1:{a}".encode()).hexdigest(), v) for a, v in live if a is not None))
    assert start.tolist() == [v for _, v in order[:7]]
    clustered, last = centroids.cluster(vectors, start, 3, group_size=2)
    of, c = brute_clusters([v for _, v in live], start, 3)
    assert last.tolist() == c
    d = [sum((a - b) ** 2 for a, b in zip(v, c[k], strict=True)) for (_, v), k in zip(live, of, strict=True)]
    want = [(a, k, x, sum(y for y, o in zip(d, of, strict=True) if o == k), sum(d), hashlib.sha256(",".join(map(str, c[k])).encode()).hexdigest()) for (a, _), k, x in zip(live, of, d, strict=True)]
    got = centroids.report(clustered, last)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    few = vectors.where("vec_id in (1, 2)")  # fewer vectors than centroids: each its own
    clustered, last = centroids.cluster(few, centroids.by_hash(few, 7), 3)
    assert sorted((r.cluster, r.distance) for r in clustered.collect()) == [(0, 0), (1, 0)]
    none = vectors.limit(0)
    assert centroids.report(*centroids.cluster(none, centroids.by_hash(none, 7), 3)).count() == 0
    with pytest.raises(OverflowError):
        centroids.squared(np.array([[1 << 40]]), np.array([[0]]))


# --- search -----------------------------------------------------------------------------------------------------------


def brute_search(docs, items, best):
    terms = [[w.lower() for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (t or "").encode())] for _, t in docs]
    counts = [Counter(t) for t in terms]
    n, length = sum(map(bool, terms)), sum(map(len, terms))
    df = Counter(w for c in counts for w in c)
    out = []
    for item, text in items:
        asked = Counter(w.lower() for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode()))
        scored = []
        for (doc, _), c, t in zip(docs, counts, terms, strict=True):
            m = 75 + (25 * len(t) * n) // length if length else 0
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 12 * m)) for w, q in asked.items() if c[w])
            if s > 0:
                scored.append((-s, doc is not None, doc or 0, doc))
        out += [(item, i + 1, doc, -s) for i, (s, _, _, doc) in enumerate(sorted(scored, key=lambda x: x[:3])[:best])]
    return out


def search_tables(seed=4, docs=400):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 3))) for _ in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    text = lambda n: " ".join(rng.choices(words, weights, k=n))
    rows = [(i * 7 % 1009, text(rng.choice([2, 10, 30, 300]))) for i in range(docs)]
    rows += [(2000 + i, rows[5][1]) for i in range(60)] + [(rows[8][0], rows[8][1]), (rows[8][0], "a b"), (None, rows[9][1]), (3000, None), (3001, ""), (3002, ".,;"), (3003, "A É" * 20000)]
    rng.shuffle(rows)
    items = [(i, text(rng.choice([1, 4, 20]))) for i in range(12)] + [(50, rows[5][1]), (51, None), (52, ""), (53, "unknown"), (54, "A a. A"), (54, "b"), (None, "c"), (3, "a b c"), (3, "a b c")]
    return rows, items


@pytest.mark.parametrize(("tiers", "small"), [((4, 16, 64, 2000), False), ((1,), False), ((30, 100), True), (lexical.TIERS, False)])
def test_search_equals_brute_force(spark, monkeypatch, tiers, small):
    """Items proven in upper tiers and items that fall through to the last; joins with and without broadcast, several passes."""
    if small:
        for name, value in (("MOST_TERMS", 0), ("MOST_BROADCAST", 0), ("MOST_ITEMS", 5), ("MOST_ENTRIES", 30), ("BLOCK_SCORES", 50)):
            monkeypatch.setattr(lexical, name, value)
    docs, items = search_tables()
    table = spark.createDataFrame([(*d, 1, "r") for d in docs], "doc_id long, text string, n int, row string").repartition(3)
    asked = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, score int")
    idx = lexical.index(table, None if small else lexical.vocabulary(asked), tiers)
    got = lexical.search(idx, asked, 7)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute_search(docs, items, 7)))
    assert idx.upper.groupBy("term").count().agg({"count": "max"}).first()[0] in (None, *range(tiers[-1] + 1))
    idx.discard()


def test_search_without_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    for d, i in ((docs, items), (docs.limit(0), items), (docs, items.limit(0))):
        assert lexical.search(lexical.index(d), i).count() == 0
    idx = lexical.index(docs, [b"b"])
    with pytest.raises(ValueError):
        lexical.search(idx, items)


@pytest.mark.parametrize("name", ["op12_centroids", "op13_lexical_search"])
def test_queries_equal_sql(spark, name):
    import os

    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    want = c.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SF)
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    assert sorted(repr(tuple(r[x] for x in order)) for r in got.collect()) == sorted(repr(tuple(r[want.columns.index(x)] for x in order)) for r in want.fetchall())
