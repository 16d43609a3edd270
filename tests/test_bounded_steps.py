"""Steps that hold or make no more than their input asks for."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from velum.operators import ledger, neighbours, retrieval, store
from velum.plans import message_queries
from velum.streaming import restore


@pytest.mark.parametrize("metric", ["cosine", "l2", "l1"])
def test_nearest_rows_are_held_in_tiles(metric):
    """A block of queries against a batch: before, some five matrices of 4096 x 10,000 numbers."""
    rng = np.random.default_rng(1)
    q, x = rng.normal(size=(700, 8)), rng.normal(size=(10_000, 8))
    x[5000:5040] = x[0]
    best = retrieval._Best(np.arange(700), q, 3, metric, None)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(10_000)[::-1]), pa.array(list(x)), pa.array(np.zeros(10_000, np.int64))], names=["id", "vector", "by"])
    tracemalloc.start()
    for at in range(0, batch.num_rows, retrieval.TILE_ROWS):
        best.add(batch.slice(at, retrieval.TILE_ROWS))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60_000_000
    for i in (0, 255, 256, 699):
        d = 1 - (x @ q[i]) / np.linalg.norm(x, axis=1) / np.linalg.norm(q[i]) if metric == "cosine" else np.abs(x - q[i]).sum(1) if metric == "l1" else np.linalg.norm(x - q[i], axis=1)
        order = np.lexsort((np.arange(10_000)[::-1], np.round(d, 12)))[:3]
        assert best.i[i].tolist() == (9_999 - order).tolist() and best.d[i] == pytest.approx(d[order])


def test_equal_vectors_are_ties_wherever_they_stand(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=64)
    rows = [(int(i), (v * 2).tolist() if i % 3 == 0 else rng.normal(size=64).tolist()) for i in range(500)]
    queries = [(0, v.tolist())] + [(i, rng.normal(size=64).tolist()) for i in range(1, 20)]
    got = retrieval.knn(spark.createDataFrame(queries, "query_id long, vector array<double>"), spark.createDataFrame(rows, "id long, vector array<double>"), 20).where("query_id = 0").collect()
    assert sorted((r.rank, r.id) for r in got) == [(n + 1, 3 * n) for n in range(20)]


def test_permissions_join_no_repeated_entries(spark):
    """2000 entries and 2000 members of one principal: before, 4 million rows of the join."""
    entries = spark.range(2000).selectExpr("7L AS principal", "id % 3 AS resource", "cast(1 << (id % 4) as int) AS bits")
    members = spark.range(2000).selectExpr("id AS user", "7L AS principal")
    out = ledger.permissions(entries.unionAll(spark.sql("SELECT 8L, 1L, NULL")), members.unionAll(spark.sql("SELECT 5000L, 8L")))
    rows = out.collect()
    assert len(rows) == 6001 and {r.bits for r in rows if r.user < 2000} == {15} and [r.bits for r in rows if r.user == 5000] == [None]
    plan = out._jdf.queryExecution().executedPlan()
    made = []

    def walk(node):
        if "Join" in node.nodeName():
            made.append(node.metrics().apply("numOutputRows").value())
        inner = [node.executedPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in node.nodeName() else [node.children().apply(i) for i in range(node.children().size())]
        for child in inner:
            walk(child)

    walk(plan)
    assert made and max(made) <= 6001


def test_probes_leave_in_bounded_batches():
    """2000 queries that read 64 lists each: before, one batch of 128,000 vectors."""

    class Session:
        sparkSession = sparkContext = property(lambda self: self)
        broadcast = staticmethod(lambda value: type("Shared", (), {"value": value}))
        mapInArrow = staticmethod(lambda work, shape: work)

    rng = np.random.default_rng(3)
    index = neighbours.Lists(None, neighbours.unit(rng.normal(size=(64, 8))), np.ones(64, np.int64), np.full(64, np.pi))
    vectors = [*rng.normal(size=(1999, 8)).tolist(), [0.0] * 8]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(2000)), pa.array(vectors), pa.array(np.zeros(2000, np.int64)), pa.array(np.full(2000, 4.0))], names=["id", "vector", "by", "angle"])
    got = list(neighbours._probed(Session(), index, 0, True)([batch]))
    assert max(b.num_rows for b in got) <= neighbours.OUT_ROWS
    pairs = [(i, n) for b in got for i, n in zip(b.column("id").to_pylist(), b.column("list").to_pylist(), strict=True)]
    assert len(pairs) == 128_000 and set(pairs) == {(i, n) for i in range(2000) for n in range(64)}
    assert all(b.column("vector")[0].as_py() == vectors[b.column("id")[0].as_py()] for b in got)


def test_events_without_tokens_are_written_once(monkeypatch):
    """Before, every event was written twice and all originals once more, which was most of the time."""
    event = 'data: {"type": "content_block_delta", "index": 0, "delta": {"type": "input_json_delta", "partial_json": "né"}}\n\n'
    monkeypatch.setattr(restore.json, "dumps", lambda *a, **k: pytest.fail("written again"))
    assert restore.restore_event(event, {"[PERSON_1]": "Ada"}, {}) == (event, {})


@pytest.mark.parametrize("name", ["masked_names", "restored_frames", "restored_tool_inputs"])
def test_one_file_is_spread_over_the_cores(spark, monkeypatch, name):
    seen = []
    whole = message_queries.spread
    monkeypatch.setattr(message_queries, "spread", lambda df: seen.append(whole(df)) or seen[-1])
    getattr(message_queries, name)(spark, "/root/testdata/sf0.001")
    assert [df.rdd.getNumPartitions() for df in seen] == [spark.sparkContext.defaultParallelism]


def test_scores_count_gold_and_found_in_one_pass(spark):
    """Before, both were grouped and then joined; keys without a document never matched, as they do in SQL."""
    entities = lambda rows: spark.createDataFrame(rows, "doc_id long, kind string, text string")
    out = store.scores(entities([(1, "A", "x"), (1, "A", "X"), (None, "A", "y"), (2, "B", "z")]), entities([(1, "A", "x"), (None, "A", "Y"), (2, "B", "w")]))
    assert {(r.kind, r.tp, r.fp, r.fn) for r in out.collect()} == {("A", 2, 0, 1), ("B", 0, 1, 1), ("overall", 2, 1, 2)}
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
