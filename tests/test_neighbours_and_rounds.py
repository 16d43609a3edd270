"""Inverted lists, promotion in order, and graphs settled in few rounds, against plain loops."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from velum.operators import conversation, memory, neighbours, retrieval, rounds


def vectors(spark, x, groups=None, start=0):
    return spark.createDataFrame([(start + i, [float(v) for v in r], int(groups[i]) if groups is not None else 0) for i, r in enumerate(x)], "id long, vector array<double>, profile long")


def clustered(n, dims=16, hearts=30, seed=2):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(hearts, dims))[rng.integers(0, hearts, n)] + 0.25 * rng.normal(size=(n, dims))


def test_lists_find_what_a_whole_scan_finds(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "UNIT_ROWS", 70)
    monkeypatch.setattr(neighbours, "UNIT_QUERIES", 30)
    x = np.concatenate([clustered(1500), np.zeros((2, 16)), np.ones((5, 16))])
    groups = np.arange(len(x)) % 2
    rows = vectors(spark, x, groups)
    asked = rows.where("id % 7 = 0").select(F.col("id").alias("query_id"), "vector", "profile")
    index = neighbours.build(rows)
    assert index.sizes.sum() == len(x) and len(index.sizes) == round(len(x) ** 0.5)
    true = retrieval.knn(asked, rows, 10)
    key = lambda df: sorted((r.query_id, r["rank"], r.id, round(r.distance, 9)) for r in df.collect())
    want = key(true)
    got = neighbours.search(asked, index, 10, 5)
    assert neighbours.recall(got, true) >= 0.95 and neighbours.recall(true, true) == 1
    distances = lambda rows: [(q, n, d) for q, n, _, d in rows]
    assert distances(key(neighbours.search(asked, index, 10, 2, exact=True))) == distances(want)
    # Exactness reads few more lists where vectors lie in clusters.
    probed = neighbours._probed(neighbours._held(asked, "query_id", None), index, 2, False).count()
    assert probed == 2 * asked.count()
    by = neighbours.build(rows, 10, "profile")
    assert distances(key(neighbours.search(asked, by, 4, 2, True, "profile"))) == distances(key(retrieval.knn(asked, rows, 4, by="profile")))
    none = neighbours.build(rows.limit(0))
    assert neighbours.search(asked, none, 3, exact=True).count() == 0 and neighbours.search(asked.limit(0), index, 3).count() == 0


def test_pairs_within(spark):
    x = np.concatenate([clustered(300, 8, 12), np.zeros((2, 8))])
    u = neighbours.unit(x)
    near = u @ u.T
    want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if near[i, j] >= 0.9 and (i - j) % 3 == 0}
    got = {(r.a, r.b): r.cosine for r in neighbours.pairs_within(vectors(spark, x, np.arange(len(x)) % 3), 0.9, "profile").collect()}
    assert set(got) == want and all(abs(c - near[p]) < 1e-9 for p, c in got.items())


def loop(facts, nodes, least):
    """One fact after the other."""
    held = [("node", i, p, np.array(v)) for i, p, v in nodes]
    out = []
    for i, p, v in sorted(facts):
        v = np.array(v)
        cosine = lambda w: float(v @ w / max(np.linalg.norm(v) * np.linalg.norm(w), 1e-300))
        best = min(((-round(cosine(w), 12), kind != "node", j) for kind, j, q, w in held if q == p and cosine(w) >= least), default=None)
        if best is None:
            held.append(("fact", i, p, v))
            out.append((i, None, i, "insert"))
        else:
            out.append((i, None if best[1] else best[2], best[2] if best[1] else None, "reinforce"))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_promotion_in_order(spark, seed):
    rng = np.random.default_rng(seed)
    x = clustered(220, 6, 14, seed)
    x[50:60], x[100] = x[20:30], x[20]
    facts = [(int(i), int(rng.integers(0, 2)), [float(a) for a in x[i]]) for i in range(150)] + [(150, 0, [0.0] * 6), (151, 0, [0.0] * 6)]
    nodes = [(int(i), int(rng.integers(0, 2)), [float(a) for a in x[i]]) for i in range(200, 206)]
    f, n = spark.createDataFrame(facts, "fact_id long, profile long, vector array<double>"), spark.createDataFrame(nodes, "node_id long, profile long, vector array<double>")
    got = memory.promote_in_order(f, n, 0.95).select("fact_id", "node_id", "as_fact", "action")
    want = loop(facts, nodes, 0.95)
    assert sorted(map(tuple, got.collect())) == want and {a for *_, a in want} == {"insert", "reinforce"}
    assert any(r[2] not in (None, r[0]) for r in want) and any(r[1] is not None for r in want)
    if seed == 1:
        assert sorted(map(tuple, memory.promote_in_order(f, n.limit(0), 0.95).select("fact_id", "node_id", "as_fact", "action").collect())) == loop(facts, [], 0.95)
        now = F.lit(datetime.datetime(2024, 1, 2))
        told = f.withColumns({"content": F.concat(F.lit("f"), "fact_id"), "confidence": F.col("fact_id") / 50.0})
        old = n.withColumns({"content": F.lit("n"), "confidence": F.lit(0.5), "access_count": F.lit(3).cast("long"), "last_accessed_at": F.lit(datetime.datetime(2023, 1, 1))})
        after = memory.promoted(told, old, memory.promote_in_order(f, n, 0.95), now).collect()
        made = [r for r in after if r.node_id > 205]
        assert len(after) == len(nodes) + sum(a == "insert" for *_, a in want) and len({r.node_id for r in after}) == len(after)
        assert all(0.1 <= r.confidence <= 1 for r in made) and sum(r.access_count for r in after) == 3 * len(nodes) + sum(a == "reinforce" for *_, a in want)


def test_heads_in_few_rounds(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(rounds, "cut", lambda df: cuts.append(1) or plain(df))
    rng = random.Random(3)
    for n, links in ((10_000, [(i, i + 1) for i in range(9_999)]), (400, [tuple(sorted(rng.sample(range(400), 2))) for _ in range(700)])):
        cuts.clear()
        got = {r.id: r.head for r in rounds.heads(spark.createDataFrame(links, "a long, b long"), 2_000).collect()}
        earlier = {}
        for a, b in links:
            earlier.setdefault(b, set()).add(a)
        want = {}
        for i in range(n):
            if i in earlier or any(i == a for a, _ in links[:1]) or i in got:
                want[i] = not any(want[a] for a in earlier.get(i, ()))
        assert got == want
        assert len(cuts) < 30
    assert rounds.heads(spark.createDataFrame([], "a long, b long")).count() == 0


def plain(df):
    from velum.io import cut

    return cut(df)


def test_levels_in_logarithmic_rounds(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(rounds, "cut", lambda df: cuts.append(1) or plain(df))
    rows = [(i, i - 1 if i else None) for i in range(10_000)] + [(20_000, 7), (20_001, 30_000), (20_002, 20_003), (20_003, 20_002), (None, 5), (None, None)]
    got = sorted(((r.id, r.level) for r in rounds.levels(spark.createDataFrame(rows, "id long, parent long")).collect()), key=repr)
    assert got == sorted([(i, i) for i in range(10_000)] + [(20_000, 8), (None, 6), (None, 0)], key=repr)
    assert len(cuts) <= 17
    tree = spark.createDataFrame([(str(i), str((i - 1) // 3) if i else None) for i in range(60)], "id string, parent string")
    assert {r.id for r in conversation.share_levels(tree, "4").collect()} == {str(i) for i in range(13)}
