import random
import time

import pytest

from velum.operators import memory, overlap


def _shuffled(spark) -> int:
    """Bytes that the session has written to shuffles so far."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    time.sleep(0.5)
    return context.statusStore().executorList(False).apply(0).totalShuffleWrite()


def test_uncovered_facts_move_no_text_once_a_word(spark):
    rng = random.Random(1)
    words = [f"word{i}" for i in range(4000)]
    asked = [(i, " ".join(rng.sample(words, 2500))) for i in range(12)] + [(90, " ".join(words[:50])), (91, " ".join(words[:40])), (92, None), (93, " ")]
    held = [(" ".join(words[k : k + 50]),) for k in range(0, 4000, 50)]
    began = _shuffled(spark)
    got = memory.not_covered(spark.createDataFrame(asked, "id long, content string"), spark.createDataFrame(held, "content string"))
    assert sorted(r.id for r in got.collect()) == [*range(12), 92, 93]
    assert _shuffled(spark) - began < 20_000_000


@pytest.mark.parametrize("least", [0.25, 0.6, 1.0])
def test_pairs_in_small_blocks_equal_brute_force(spark, monkeypatch, least):
    monkeypatch.setattr(overlap, "BLOCK_ROWS", 8)
    monkeypatch.setattr(overlap, "AT_ONCE", 5)
    rng = random.Random(2)
    words = [f"word{i}" for i in range(60)]
    facts = [(i, "common " + " ".join(rng.sample(words, rng.choice([1, 2, 3, 6, 20])))) for i in range(120)]
    facts += [(200 + i, t) for i, (_, t) in enumerate(facts[:15])] + [(300, "the of"), (301, ""), (302, None)]
    sets = {i: set((t or "").replace("the of", "").split()) for i, t in facts}
    true = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and sets[a] and sets[b]}
    got = memory.similar_pairs(spark.createDataFrame(facts, "id long, content string"), least).collect()
    assert len(got) == len({(r.a, r.b) for r in got})
    assert {(r.a, r.b): r.jaccard for r in got} == pytest.approx({k: v for k, v in true.items() if v >= least - 1e-12})


def test_clusters_of_copies_link_no_copies(spark):
    facts = [(i, f"alpha beta gamma{i % 3}") for i in range(3000)] + [(5000, "delta"), (5001, "")]
    began = _shuffled(spark)
    got = {r.id: r.seed for r in memory.clusters(spark.createDataFrame(facts, "id long, content string"), 0.9).collect()}
    assert got == {i: i % 3 for i in range(3000)} | {5000: 5000, 5001: 5001}
    assert _shuffled(spark) - began < 20_000_000
