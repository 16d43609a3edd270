import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from velum.llm import common, decontaminate, jaccard, lattice, suffix_dedup


def near_texts(seed=1, n=120):
    rng = random.Random(seed)
    base = [[rng.choice("abcdefghij") for _ in range(60)] for _ in range(4)]
    docs = []
    for i in range(n):
        x = list(rng.choice(base))[: rng.randrange(45, 61)]
        for _ in range(rng.randrange(3)):
            x[rng.randrange(len(x))] = rng.choice("xyz")
        docs.append((i * 3 % 1009, " ".join(x)))
    return [*docs, (5000, None), (5001, ""), (5002, "a b"), (5003, "a b"), (5004, "A  b!"), (5005, "a b c"), (5006, "... !"), (5002, "a b"), (None, "a b"), (5007, "w " * 40000)]


@pytest.mark.parametrize(("similarity", "block"), [(0.8, 1024), (0.8, 10), (0.5, 16)])
def test_jaccard_join(spark, similarity, block):
    docs = near_texts()
    table = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_links int")
    got = jaccard.join(table, similarity, block_docs=block).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(a, b, c, d) for a, b, c, d in brute.jaccard(docs, 5, similarity)], key=repr)
    if block == 10:
        assert jaccard.join(table.limit(0)).count() == 0


def chained_texts(n, seed=2):
    """Texts of which each shares more than half with the next: all hang together, hardly any are similar enough."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(8 * n + 60)]
    return [(i, " ".join(words[8 * i : 8 * i + 60])) for i in range(n)] + [(n + i, " ".join(words[8 * i + 1 : 8 * i + 59])) for i in range(0, n, 9)]


def test_chains_meet_by_bucket(spark, monkeypatch):
    """In a long chain the pairs that meet grow with the texts, not with their square, and every link is found."""
    met, whole = {}, jaccard.units_of

    def counted(*args):
        out = whole(*args)
        met[n] = out.groupBy("unit").count().selectExpr("sum(count * (count - 1) / 2)").first()[0]
        return out

    monkeypatch.setattr(jaccard, "units_of", counted)
    for n in (150, 450):
        docs = chained_texts(n)
        got = jaccard.join(spark.createDataFrame(docs, "doc_id long, text string"), block_docs=16).collect()
        assert sorted(map(tuple, got), key=repr) == brute.jaccard(docs, 5, 0.8)
        assert sum(r.n_links for r in got) >= n // 9
    assert met[450] < 5 * met[150] and met[450] < 450 * 100


def test_bands_reach_recall():
    for similarity in (0.5, 0.8, 0.95):
        bands, rows = jaccard.plan_bands(similarity)
        assert 1 - (1 - similarity**rows) ** bands >= jaccard.RECALL and bands * rows <= jaccard.MOST_VALUES


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(3)
    y = rng.uniform(-3, 3, (200, 8))
    point = lattice.nearest_point(y)
    doubled = 2 * point
    assert np.allclose(doubled, np.rint(doubled)) and not (np.rint(point.sum(1)).astype(int) & 1).any()
    assert (len({tuple(r) for r in lattice.roots()}), np.unique((lattice.roots() ** 2).sum(1)).tolist()) == (240, [2.0])
    away = ((y[:, None] - point[:, None] - lattice.roots()) ** 2).sum(2).min(1)
    assert (((y - point) ** 2).sum(1) <= away + 1e-9).all()


@pytest.mark.parametrize("block", [1024, 4])
def test_lattice_join(spark, block):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(5, 16))
    rows = [(i, [float(x) for x in centre[i % 5] + rng.normal(size=16) * 0.22], i % 2) for i in range(100)]
    rows += [(200, None, 1), (201, [], 1), (202, [0.0] * 16, 1), (203, [float("nan")] * 16, 1), (204, [1.0, None], 1), (205, [1.0] * 16, None), (206, [1.0] * 16, None), (300, [1.0, 2.0], 1), (301, [2.0, 4.0], 1), (302, [1.0, 2.0], 1), (302, [1.0, 2.0], 1), (303, [float("inf"), 1.0], 1)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, rep string")
    got = lattice.join(table, setting=(1, 24, 1), block_rows=block).collect()  # enough tables to miss nothing here
    assert sorted(map(tuple, got), key=repr) == brute.vectors(rows, 0.93)
    if block == 4:
        assert lattice.join(table.limit(0)).count() == 0


@pytest.mark.parametrize("rows", [1, 1_000_000, 1_000_000_000])
def test_lattice_recall(spark, rows):
    """With the settings for labels of any size nearly all links are found in every band of cosines from the threshold."""
    setting = None if rows == 1 else lattice.settings(rows)
    rng = np.random.default_rng(8)
    data, band, pairs = [], [], 1200
    for i in range(pairs):
        a, z = rng.normal(size=(2, 64))
        a /= np.linalg.norm(a)
        z -= (z @ a) * a
        c = 0.9301 + 0.0698 * i / pairs
        band.append(i * 4 // pairs)
        data += [(2 * i, a.tolist(), i % 3), (2 * i + 1, (c * a + np.sqrt(1 - c * c) * z / np.linalg.norm(z)).tolist(), i % 3)]
    got = {r.vec_id: r.n_links for r in lattice.join(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int"), setting=setting).collect()}
    assert max(got.values()) == 1
    for b in range(4):
        hit = [got[2 * i] for i in range(pairs) if band[i] == b]
        assert sum(hit) >= 0.99 * len(hit), (b, sum(hit), len(hit))


def test_lattice_settings_follow_the_largest_label():
    assert [lattice.settings(n) for n in (0, 1 << 18, (1 << 18) + 1, 10**12)] == [[1, 10, 1], [1, 10, 1], [2, 22, 2], [3, 48, 3]]


def string_docs():
    rng = random.Random(1)
    docs = [(i, "".join(rng.choice("ab") for _ in range(rng.randrange(60))) * rng.choice([1, 1, 2, 3])) for i in range(60)]
    return [*docs, (60, None), (None, "abab" * 30), (None, "abab" * 30), (61, ""), (62, "é" * 50), (63, "a" * 300), (5, "q" * 7), (64, "".join(rng.choice("abcdefgh") for _ in range(50000)))]


@pytest.mark.parametrize(("length", "gram", "most"), [(12, 5, 1 << 18), (12, 5, 60), (20, 20, 1 << 18), (16, 4, 1), (21, 4, 1)])
def test_repeated_strings(spark, length, gram, most):
    docs = string_docs()
    table = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, kept int")
    got = [(r[0], r[1], r[2], r[3], hashlib.sha256(bytes(r[4])).hexdigest()) for r in suffix_dedup.remove(table, length, gram, most=most).collect()]
    assert sorted(got, key=repr) == sorted([r[:5] for r in brute.strings(docs, length)], key=repr)
    if most == 1:
        assert suffix_dedup.remove(table.limit(0)).count() == 0


def test_passages_by_words(spark):
    """Only removed runs with enough whole words go; a passage of short words and one of long words are both found."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefghijké") for _ in range(n))
    own = lambda: " ".join(word(7) for _ in range(30))
    short, long, few = (" ".join(word(n) for _ in range(k)) for n, k in ((3, 51), (9, 51), (9, 49)))
    docs = [(i, f"{own()} {passage} {own()}") for i, passage in enumerate([short, short, long, long, few, few])]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.text for r in suffix_dedup.cut_texts(table, length=150, gram=50, words=51).collect()}
    for i, text in docs:
        if i < 4:
            assert len(got[i]) < 500 and (short if i < 2 else long)[10:-10] not in got[i]
        else:
            assert got[i] == text
    text = "ab cd, ef".encode()
    assert [suffix_dedup.whole_words(text, *s) for s in ((0, 9), (1, 9), (0, 8), (1, 8), (2, 6), (3, 5))] == [3, 2, 2, 1, 1, 1]


def test_repeated_strings_query(spark):
    import duckdb

    from velum.llm import queries

    docs = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()
    got = queries.queries()["op8_repeated_strings"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got)) == sorted(r[:5] for r in brute.strings(docs, 400))


def leak_fixture():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(rng.randrange(9, 45))) for i in range(8)] + [(90, "too short"), (91, None), (92, ""), (93, "one"), (94, "Is it short?"), (95, "...")]
    docs = [(i, prose(rng.randrange(60))) for i in range(12)]
    for i in range(8):
        x = list(items[i][1])
        for _ in range(rng.randrange(i + 2)):
            x[rng.randrange(len(x))] = rng.choice("xyz")
        docs.append((100 + i, prose(8) + "\n" + ("".join(x).upper() if i % 2 else "".join(x).replace(" ", ", ")) + " " + prose(5)))
        docs.append((200 + i, prose(5) + " " + items[i][1][: rng.randrange(20, len(items[i][1]) + 1)]))
    docs += [(400, "far TOO, short"), (401, "too shorter"), (402, "one"), (403, "so, is it short"), (404, "anyone too"), (405, "short. too"), (406, "Is it; short? " * 3), (407, "too")]
    return docs + [(300, None), (301, ""), (302, items[0][1]), (302, items[0][1])], items


@pytest.mark.parametrize("chars", [4_000_000, 200])
def test_decontamination(spark, chars):
    docs, items = leak_fixture()
    table = spark.createDataFrame([(*d, 3) for d in docs], "doc_id long, text string, items int")
    got = decontaminate.find(table, spark.createDataFrame(items, "item_id long, text string"), pass_chars=chars).collect()
    want = brute.leaks(docs, [i for i in items if i[1]], decontaminate.RATE, decontaminate.SEGMENT, decontaminate.STRIDE, decontaminate.LEAST)
    assert len(got) == len(docs) and {r.doc_id: set(r["items"]) for r in got} == want and any(want.values())
    assert all(r.contaminated == bool(r["items"]) and r.n_items == len(r["items"]) for r in got)
    if chars == 200:
        assert decontaminate.find(table.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0
        assert not decontaminate.find(table, spark.createDataFrame([], "item_id long, text string")).where("contaminated").count()


def test_quotes_of_every_length():
    """Parts of items, wherever they begin: all are found from QUOTE characters on; the test knows no segments."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randrange(2, 9)))
    items = [(i, " ".join(word() for _ in range(n))[:m]) for i, (n, m) in enumerate([(60, 101), (60, 195), (90, 398), (200, 700)])]
    index = decontaminate.Index([(i, t.encode()) for i, t in items])
    share = {}
    for size in (60, 80, 90, 99, 100, 101, 110, 150, 180, 210, 250, 390):
        hits = total = 0
        for i, t in items:
            for a in range(0, len(t) - size + 1, 3):
                quote = t[a : a + size]
                if quote != quote.strip():
                    continue  # the edges of a quote are words' characters
                texts = [f"{word()} {quote} {word()}", quote]
                raw = np.frombuffer("".join(texts).encode(), np.uint8)
                found = {(d, item) for d, item, _, _ in index.matches(raw, np.cumsum([0, *map(len, texts)]))}
                hits += len(found & {(0, i), (1, i)})
                total += 2
                assert {item for _, item in found} <= {i}
        share[size] = hits / max(1, total)
    assert all(share[s] == 1 for s in share if s >= decontaminate.QUOTE) and share[60] == 0


def test_budget_falls_steadily():
    """An item with as many changed letters as its length allows is found at every length, with more it isn't."""
    rng = random.Random(13)
    for m in range(8, 140):
        item = "".join(rng.choice("abcdefghijklm") for _ in range(m))
        budget = decontaminate.budget_of(min(m, decontaminate.SEGMENT))
        for k in (0, budget, 2 * budget + 4):
            x = list(item)
            for at in (rng.sample(range(m), min(k, m)) if k <= budget else range(0, m, max(1, m // k))):
                x[at] = "z"
            text = f"some words {''.join(x)} and more"
            found = list(decontaminate.Index([(1, item.encode())]).matches(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)])))
            assert bool(found) == (k <= budget), (m, k)
    budgets = [decontaminate.budget_of(min(m, decontaminate.SEGMENT)) for m in range(8, 140)]
    assert max(b - a for a, b in zip(budgets, budgets[1:], strict=False)) == 1 and budgets == sorted(budgets)


def test_components(spark):
    rng = random.Random(9)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(120)] + [(5000, 5000 + i) for i in range(1, 200)] + [(7, 7)]
    union = brute.Union(6000)
    for a, b in pairs:
        union.join(a, b)
    got = {r.id: r.root for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: union.find(x) for p in pairs for x in p if p[0] != p[1] or x in got}


def anisotropic(n, dims=64, seed=3):
    """Vectors of length 1 that share a mean direction, twice as long as what tells them apart."""
    rng = np.random.default_rng(seed)
    mean = rng.normal(size=dims)
    x = rng.normal(size=(n, dims)) / np.sqrt(dims) + 2 * mean / np.linalg.norm(mean)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_lattice_depth_follows_crowded_cells(spark, monkeypatch):
    rng = np.random.default_rng(4)
    plain = rng.normal(size=(3000, 64))
    plain /= np.linalg.norm(plain, axis=1, keepdims=True)
    x = anisotropic(3000)
    assert lattice.crowding(plain) < 1.5 and 20 < lattice.crowding(x) < 60
    largest = [max(np.unique(lattice.cells(x, np.zeros(3000, np.uint64), depth, 1, 0)[:, 0, 0], return_counts=True)[1]) / 3000 for depth in (1, 3)]
    assert largest[1] < 0.03 < 0.1 < largest[0]
    rows = [(i, [float(a) for a in v], 0) for i, v in enumerate(x[:1200])] + [(5000 + i, [float(a) for a in v], 1) for i, v in enumerate(plain[:1500])]
    table = spark.createDataFrame([*rows, *((9000 + i, rows[0][1], 0) for i in range(300))], "vec_id long, embedding array<double>, label int")
    live = table.select("vec_id", F.col("embedding").alias("v"), F.xxhash64("label").alias("g"))
    assert 20 * 1200 < lattice.crowded_rows(live) < 60 * 1300 and lattice.crowded_rows(live.where("vec_id between 5000 and 8999")) < 1.5 * 1500
    assert lattice.crowded_rows(live.limit(0)) == 0
    # The deeper cells find the same links.
    used = []
    whole = lattice.settings
    monkeypatch.setattr(lattice, "SETTINGS", ((1 << 12, 1, 10, 1), (1 << 18, 2, 22, 2), (None, 3, 48, 3)))
    monkeypatch.setattr(lattice, "settings", lambda n: used.append(whole(n)) or used[-1])
    near = x[:200] + 0.02 * np.random.default_rng(6).normal(size=(200, 64)) / 8
    more = spark.createDataFrame([(20_000 + i, [float(a) for a in v], 0) for i, v in enumerate(near)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in lattice.join(table.unionAll(more)).collect()}
    held = {r.vec_id: np.array(r.embedding) / np.linalg.norm(r.embedding) for r in table.unionAll(more).where("label = 0").collect()}
    ids, m = list(held), np.stack(list(held.values()))
    want = dict(zip(ids, (m @ m.T >= lattice.COSINE).sum(1) - 1, strict=True))
    assert used == [[2, 22, 2]] and sum(want.values()) > 400
    assert all(got[i] <= want[i] for i in ids) and sum(got[i] for i in ids) >= 0.995 * sum(want.values())


def test_planted_links_through_the_query(spark, tmp_path):
    """Links at and beyond the threshold, chains, copies and odd rows in a table that the query reads; SQL agrees."""
    import duckdb

    from velum.llm import queries

    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 64))
    rows = [(i, v / np.linalg.norm(v), int(i % 3)) for i, v in enumerate(x)]
    for i in range(60):
        z = rng.normal(size=64)
        for k, cosine in enumerate((0.9305, 0.96, 0.999, 0.925)):
            a = rows[i][1]
            side = z - (z @ a) * a
            rows.append((1000 + 10 * i + k, cosine * a + np.sqrt(1 - cosine**2) * side / np.linalg.norm(side), i % 3 if k < 3 or i % 2 else (i + 1) % 3))
    rows += [(5000, rows[7][1], rows[7][2]), (5001, np.zeros(64), 0), (5002, rows[8][1], None)]
    table = spark.createDataFrame([(int(i), [float(a) for a in v], l) for i, v, l in rows], "vec_id long, embedding array<float>, label int")
    table.coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(map(tuple, queries.queries()["op2_embedding_dedup"](spark, str(tmp_path)).collect()))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(c.sql(queries.oracle_sql()["op2_embedding_dedup"]).fetchall())
    assert got == want and sum(r[1] for r in want) > 300 and not all(r[3] for r in want)


def test_lattice_screen_keeps_all_near_pairs():
    """Of pairs at the threshold no sketch is screened out, of unrelated ones nearly all are."""
    rng = np.random.default_rng(5)
    a, z = rng.normal(size=(2, 4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z -= (z * a).sum(1, keepdims=True) * a
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    b = lattice.COSINE * a + np.sqrt(1 - lattice.COSINE**2) * z
    most, first, second = lattice.most_unequal(lattice.COSINE), lattice.sketches(a), lattice.sketches(b)
    assert lattice.unequal(first, second).max() <= most
    assert (lattice.unequal(first, np.roll(first, 1, 0)) <= most).mean() < 0.01
    words, home, side = np.stack([first[:300], second[:300]], 1).reshape(600, -1), np.ones(600, bool), np.arange(600) % 2
    assert lattice.likely(words, home, side, False, most, 64).all() and lattice.likely(words, home, side, True, most, 64).all()
    assert not lattice.likely(words, ~home, side, True, most, 64).any() and not lattice.likely(first[:300], home[:300], side[:300] * 0, False, most, 64).any()


def test_links_of_the_query_do_not_depend_on_its_size(spark, tmp_path, monkeypatch):
    """The same links stand in a table and in one with many more rows, exactly, whatever the settings by size are."""
    from velum.llm import queries

    monkeypatch.setattr(lattice, "SETTINGS", ((500, 1, 1, 0), (None, 3, 1, 0)))
    rng = np.random.default_rng(11)
    x = rng.normal(size=(700, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x[:200] + 0.3 * rng.normal(size=(200, 64)) / 8  # around the threshold
    group = x[0] + 0.05 * rng.normal(size=(80, 64)) / 8  # near copies: cells of more than 80 rows
    few = [(i, [float(a) for a in v], 1) for i, v in enumerate([*x[:200], *near, *group])]
    more = [*few, *((1000 + i, [float(a) for a in v], 1) for i, v in enumerate(x[200:]))]
    links = []
    for name, rows in (("few", few), ("more", more)):
        spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / name / "embeddings.parquet"))
        got = sorted(map(tuple, queries.queries()["op2_embedding_dedup"](spark, str(tmp_path / name)).collect()), key=repr)
        assert got == brute.vectors(rows, 0.93)
        links.append([r for r in got if r[0] < 1000])
    assert links[0] == links[1] and sum(r[1] for r in links[0]) > 80 * 80 + 200


@pytest.mark.parametrize("dims", [16, 64, 256])
def test_steady_setting_misses_one_in_a_million(dims):
    """The share of tables in which a pair at the threshold meets, and so the chance that it meets in none."""
    rng = np.random.default_rng(dims)
    a, z = rng.normal(size=(2, 1500, dims))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z -= (z * a).sum(1, keepdims=True) * a
    b = lattice.COSINE * a + np.sqrt(1 - lattice.COSINE**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    depth, tables, probes = lattice.STEADY
    p, q = (lattice.cells(v, np.zeros(1500, np.uint64), depth, tables, probes, lattice.STEADY_SPACING) for v in (a, b))
    share = ((p == q[:, :, :1]).any(2) | (q == p[:, :, :1]).any(2)).mean()
    assert (1 - share) ** tables < 3e-6


def test_runs_are_cut_whole_and_paired():
    import pyarrow as pa

    rng = random.Random(5)
    unit = np.repeat(np.arange(60), [rng.choice([1, 2, 3, 5, 40, 90]) for _ in range(60)])
    batches = [pa.RecordBatch.from_arrays([pa.array(unit[a : a + 7])], names=["unit"]) for a in range(0, len(unit), 7)]
    tables = [t.column("unit").to_numpy() for t in lattice.whole_runs(iter(batches), "unit", 50)]
    assert np.array_equal(np.concatenate(tables), unit) and len(tables) > 10
    assert all(a[-1] != b[0] for a, b in zip(tables, tables[1:], strict=False)) and not list(lattice.whole_runs(iter([]), "unit"))
    low, high, large = lattice.run_pairs(unit)
    pairs = [*zip(low.tolist(), high.tolist(), strict=True), *((a, b) for s in large for b in range(s.start, s.stop) for a in range(s.start, b))]
    assert sorted(pairs) == [(a, b) for a in range(len(unit)) for b in range(a + 1, len(unit)) if unit[a] == unit[b]]
    assert {s.stop - s.start for s in large} == {40, 90}
