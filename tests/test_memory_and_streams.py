import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from velum.functions import vectors
from velum.operators import conversation, ledger, memory, retrieval
from velum.sources import formats
from velum.streaming import restore


def test_greedy_clusters(spark):
    rng = random.Random(5)
    words = [f"word{i}" for i in range(14)]
    facts = [(i, " ".join(rng.sample(words, rng.randrange(1, 6)))) for i in range(40)]
    sets = {i: set(t.split()) for i, t in facts}
    seed = {}
    for i, _ in facts:
        if i not in seed:
            seed[i] = i
            for j, _ in facts:
                if j > i and j not in seed and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.5:
                    seed[j] = i
    got = {r.id: r.seed for r in memory.clusters(spark.createDataFrame(facts, "id long, content string"), 0.5).collect()}
    assert got == seed
    pairs = {(r.a, r.b) for r in memory.similar_pairs(spark.createDataFrame(facts, "id long, content string"), 0.5).collect()}
    assert pairs == {(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.5}


def test_decay_falls_with_time_and_rises_with_use(spark):
    rows = [(i, 1.0, a, d) for i, (a, d) in enumerate([(0, 1.0), (20, 1.0), (0, 7.0), (20, 7.0)])]
    got = [r.s for r in spark.createDataFrame(rows, "i long, c double, a long, d double").orderBy("i").select(memory.decayed(F.col("c"), F.col("a"), F.col("d")).alias("s")).collect()]
    assert got == pytest.approx([math.exp(-1), math.exp(-1 / 11), math.exp(-7), math.exp(-7 / 11)])


def test_moments(spark):
    texts = ["2024-01-02 03:04:05", "2024-01-02T03:04:05Z", "2024-01-02T05:04:05+02:00", "soon", None]
    got = [r.m for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(F.unix_seconds(memory.moment(F.col("t"))).alias("m")).collect()]
    assert got == [1704164645] * 3 + [None] * 2


def test_tags_edges_digest_and_plans(spark):
    m = spark.createDataFrame([({"a": "1"},)], "m map<string,string>")
    assert m.select(memory.tagged(F.col("m"), "f", F.lit("x"))).first()[0] == {"a": "1", "f": "x"} and m.select(memory.tagged(F.col("m"), "a", F.lit(None))).first()[0] == {}
    nodes = spark.createDataFrame([(1, "A"), (2, "B")], "id long, content string")
    existing = spark.createDataFrame([(1, 2, "uses", 0.7)], "source_id long, target_id long, relationship string, confidence double")
    found = spark.createDataFrame([("A", "B", "uses", 0.9), ("A", "A", "uses", 1.0), ("A", "C", "uses", 1.0), ("B", "A", "feeds", 0.5)], "source string, target string, relationship string, confidence double")
    assert sorted(map(tuple, memory.edge_upsert(existing, found, nodes).collect())) == [(1, 2, "uses", 0.9), (2, 1, "feeds", 0.5)]
    rows = spark.createDataFrame([("work", "note", "x", "2024-01-01 08:00:00"), ("work", "note", "y", "2024-01-01 09:30:00")], "profile string, type string, content string, t string").withColumn("occurred_at", F.col("t").cast("timestamp"))
    assert [r.line for r in memory.digest(rows, "2024-01-01").collect()] == ["# 2024-01-01 digest", "- work / note: 2 between 08:00 and 09:30"]
    plans = spark.createDataFrame([("is Planning a trip",), ("is migrating the Core",), ("likes tea",)], "content string")
    assert [r.content for r in memory.future_plans(plans, ("the Core",)).collect()] == ["is Planning a trip"]
    assert spark.range(1).select(memory.unfenced(F.lit('```json\n{"a":1}\n```'))).first()[0] == '{"a":1}'


def test_review_by_a_classifier(spark):
    plans = spark.createDataFrame([(1, "plans to move", 0.4), (2, "plans to stay", 0.4), (3, None, 0.4)], "id long, content string, confidence double")
    said = memory.review_answers(plans, lambda t: '{"status": "completed", "rewrite": "moved"}' if "move" in t else '{"status": "abandoned"}' if t else "?")
    decisions = memory.review_decisions(said)
    assert {r.id: r.status for r in decisions.collect()} == {1: "completed", 2: "abandoned", 3: "error"}
    assert sorted(map(tuple, memory.reviewed(plans, decisions).collect())) == [(1, "moved", 0.9, "completed"), (3, None, 0.4, "error")]


def test_extractor_is_pluggable(spark):
    texts = spark.createDataFrame([(1, "a. b."), (2, None)], "id long, content string")
    assert {(r.id, r.fact) for r in memory.extract(texts, lambda t: [x.strip() for x in t.split(".") if x.strip()]).collect()} == {(1, "a"), (1, "b")}


def test_truncated(spark):
    cases = ["short", "\n".join(f"line {i} " + "x" * 200 for i in range(90)), "é" * 9000, "x" * 8192, "a" + "é" * 8000]
    got = [r.t for r in spark.createDataFrame(list(enumerate(cases)), "i int, t string").orderBy("i").select(conversation.truncated(F.col("t")).alias("t")).collect()]
    lines = cases[1].split("\n")
    assert got[0] == "short" and got[3] == cases[3]
    assert got[1] == "\n".join([*lines[:50], "[... 20 lines left out ...]", *lines[-20:]])
    assert got[2] == "é" * 4096 + "\n[... cut ...]" and got[4] == "a" + "é" * 4095 + "\n[... cut ...]"


def test_images_and_repair(spark):
    rows = [(1, i, 0, "image" if i % 2 else "text", f"b{i}") for i in range(9)]
    out = conversation.cull_images(spark.createDataFrame(rows, "conv_id long, idx long, block long, kind string, text string"), 2)
    assert {r.idx for r in out.where("text = '[image left out]'").collect()} == {1, 3}
    messages = spark.createDataFrame([(1, 0, ["a", "b"], []), (1, 1, [], ["a"]), (1, 2, ["c"], ["z"])], "conv_id long, idx long, calls array<string>, results array<string>")
    fixed = conversation.repaired(messages).orderBy("idx").collect()
    assert [(r.calls, r.results) for r in fixed] == [(["a"], []), ([], ["a"]), ([], [])]
    body = spark.createDataFrame([('"plain"',), ('[{"type":"text","text":"a"},{"type":"image"},{"type":"text","text":"b"}]',)], "c string")
    assert [r.t for r in body.select(conversation.text_blocks(F.col("c")).alias("t")).collect()] == ["plain", "a\nb"]


def test_share_levels_without_caps(spark):
    """Neither the caps of recursive queries nor what lies below the target limit the levels."""
    chain = [(str(i), str(i - 1) if i else None) for i in range(22)] + [(f"b{i}", "3") for i in range(9)] + [("lost", "gone"), (None, None)]
    caps = {"spark.sql.cteRecursionLevelLimit": "5", "spark.sql.cteRecursionRowLimit": "8"}
    for k, v in caps.items():
        spark.conf.set(k, v)
    try:
        table = spark.createDataFrame(chain, "id string, parent string")
        got = {(r.id, r.level) for r in conversation.share_levels(table, "19").collect()}
        assert got == {(str(i), i) for i in range(20)} | {(f"b{i}", 4) for i in range(9)} | {(None, 0)}
        assert conversation.share_levels(table, "lost").count() == 0
        twice = spark.createDataFrame([("r", None), ("t", "r"), ("m", "r"), ("t", "m"), ("u", "t")], "id string, parent string")
        assert sorted((r.id, r.level) for r in conversation.share_levels(twice, "t").collect()) == [("m", 1), ("r", 0), ("t", 1), ("t", 2), ("u", 2)]
        with pytest.raises(ValueError, match="loop"):
            conversation.share_levels(spark.createDataFrame([("r", None), ("x", "r"), ("x", "x")], "id string, parent string"), "x")
    finally:
        for k in caps:
            spark.conf.unset(k)


def test_balances_equal_fold(spark):
    rng = random.Random(2)
    rows = [(u, s, float(rng.randrange(-9, 10))) for u in range(12) for s in range(rng.randrange(1, 30))]
    start = [(u, float(rng.randrange(9))) for u in range(13)]
    want = dict(start)
    for u, _, d in sorted(rows):
        want[u] = max(0.0, want[u] + d)
    got = ledger.balances(spark.createDataFrame(rows, "user long, seq long, delta double"), spark.createDataFrame(start, "user long, balance double"))
    assert {r.user: r.balance for r in got.collect()} == want


@pytest.mark.parametrize("block", [4096, 3])
@pytest.mark.parametrize("metric", ["cosine", "l2", "l1"])
def test_knn(spark, metric, block):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 6))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "id long, vector array<double>")
    queries = rows.where("id % 7 = 0 OR id = 99").withColumnRenamed("id", "query_id")
    got = retrieval.knn(queries, rows, 4, metric, block).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 60, 7):
        d = {"cosine": 1 - unit @ unit[q], "l2": np.linalg.norm(x - x[q], axis=1), "l1": np.abs(x - x[q]).sum(1)}[metric]
        want = sorted(range(60), key=lambda i: (round(d[i], 12), i))[:4]
        assert [r.id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want


def test_vector_sql_functions(spark):
    assert "vec_distance_l2" in vectors.register(spark)
    row = spark.sql("SELECT vec_distance_l2(array(0D, 3D), array(4D, 0D)) AS d, vec_length(array(1D, 2D)) AS n, vec_slice(array(1D, 2D, 3D), 1, 3) AS s, vec_to_json(vec_add(array(1D), array(2D))) AS j, vec_f32('[1, 2.5]') AS f, vec_quantize_int8(array(-1D, 0D, 1D)) AS q").first()
    assert (row.d, row.n, row.s, row.j, row.f, row.q) == (5.0, 2, [2.0, 3.0], "[3.000000]", [1.0, 2.5], [-128, 0, 127])
    df = spark.createDataFrame([([1.0, -1.0] * 8,)], "v array<double>")
    assert df.select(vectors.quantize_binary(F.col("v"))).first()[0] == [0b01010101] * 2
    with pytest.raises(Exception, match="different lengths"):
        spark.range(1).select(vectors.l2(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))).collect()
    assert [tuple(r) for r in vectors.each(spark.createDataFrame([([5.0, 6.0],)], "v array<double>"), "v").collect()] == [(0, 5.0), (1, 6.0)]


# --- streams ----------------------------------------------------------------------------------------------------------


def streamed(spark, tmp_path, table, make, name):
    """Rows that `make` gives for `table` arriving in three files."""
    path = str(tmp_path / name)
    n = table.count()
    for part in range(3):
        table.where((F.col("seq") >= part * n / 3) & (F.col("seq") < (part + 1) * n / 3)).coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = make(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-state")).start()
    query.processAllAvailable()
    query.stop()
    return sorted(map(tuple, spark.table(name).collect()))


def test_restore_stream_equals_batch(spark, tmp_path):
    rng = random.Random(7)
    rows, seq = [], 0
    texts = {f"s{i}": "".join(rng.choice(["[PERSON_1]", "[ORG_2]", " [", "x", "[PERSON_11]", "[AB", " é "]) for _ in range(12)) for i in range(5)}
    pieces = [(s, t[a : a + 3], a + 3 >= len(t)) for s, t in texts.items() for a in range(0, len(t), 3)]
    for s, p, final in pieces:
        rows.append((s, seq, p, final))
        seq += 1
    table = spark.createDataFrame(rows, "stream_id string, seq long, payload string, final boolean")
    originals = {"[PERSON_1]": "Ada", "[ORG_2]": "Acme", "[X_1]": "bad [PERSON_1]"}
    tokens = spark.createDataFrame([(s, t, o) for s in texts for t, o in originals.items()], "stream_id string, token string, original string")
    batch = sorted(map(tuple, restore.restore_batch(table, tokens).collect()))
    whole = {s: "".join(t for k, _, t in sorted(batch, key=lambda r: r[1]) if k == s) for s in texts}
    assert whole == {s: t.replace("[PERSON_1]", "Ada").replace("[ORG_2]", "Acme") for s, t in texts.items()}
    got = streamed(spark, tmp_path, table, lambda d: restore.restore_stream(d, {s: originals for s in texts}), "restored")
    assert got == batch


def test_monitors_stream_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    counts = [(f"k{rng.randrange(3)}", i, int(30 + 2 * i + rng.randrange(12))) for i in range(90)]
    window, want = {}, []
    for k, s, n in counts:
        fired, window[k] = restore.fires(window.get(k, []), n)
        want.append((k, s, fired))
    table = spark.createDataFrame(counts, "key string, seq long, n long")
    assert sorted(map(tuple, restore.cascade_batch(table).collect())) == sorted(want) and any(f for *_, f in want)
    assert streamed(spark, tmp_path, table, restore.cascade_stream, "cascade") == sorted(want)
    assert not any(restore.fires(w, n)[0] for w, n in [([40, 45, 50, 54], 57), ([62, 63, 63], 62)])
    requests = [(f"k{rng.randrange(3)}", i, i * 1.5) for i in range(90)]
    live, want = {}, []
    for k, s, at in requests:
        ok, live[k] = restore.admit(live.get(k, []), at, 3, 20)
        want.append((k, s, ok))
    table = spark.createDataFrame(requests, "key string, seq long, at double")
    assert sorted(map(tuple, restore.rate_limit_batch(table, 3, 20).collect())) == sorted(want) and {ok for *_, ok in want} == {True, False}
    assert streamed(spark, tmp_path, table, lambda d: restore.rate_limit_stream(d, 3, 20), "limited") == sorted(want)


def test_folds_hold_one_state(spark):
    """A key with very many rows is streamed: no array of its events, many Arrow batches, also nulls."""
    n = 20_000
    rows = spark.range(n).select(F.lit("hot").alias("key"), F.col("id").alias("seq"), F.col("id").cast("double").alias("at"), (F.col("id") % 97).alias("n")).unionByName(
        spark.createDataFrame([(None, 1, None, None), (None, 2, 5.0, 60), ("a", 1, 1.0, 1)], "key string, seq long, at double, n long")
    )
    limited, grown = restore.rate_limit_batch(rows, 3, 10.0), restore.cascade_batch(rows)
    for df in (limited, grown):
        assert "collect_list" not in df._jdf.queryExecution().toString() and df.count() == n + 3
    times, want = [], {}
    for i in range(n):
        want[i], times = restore.admit(times, float(i), 3, 10.0)
    assert {r.seq: r.admitted for r in limited.where("key = 'hot'").collect()} == want
    window, want = [], {}
    for i in range(n):
        want[i], window = restore.fires(window, i % 97)
    assert {r.seq: r.fired for r in grown.where("key = 'hot'").collect()} == want
    assert [r.admitted for r in limited.where("key IS NULL").collect()] == [True, True] and grown.where("key IS NULL AND fired").count() == 0


def test_json_restore():
    assert restore.restore_json('{"a": ["[X_1]", {"[X_1]": "b [X_1]"}], "n": 1}', {"[X_1]": 'q"'}) == '{"a": ["q\\"", {"[X_1]": "b q\\""}], "n": 1}'
    assert restore.restore_json("not json [X_1]", {"[X_1]": "y"}) == "not json y"


# --- sources ----------------------------------------------------------------------------------------------------------


def test_sources(spark, tmp_path):
    import json

    message = lambda i, sender, text, content=None: {"uuid": str(i), "sender": sender, "text": text, "created_at": "2024-01-02T03:04:05Z", "content": content or []}
    export = [{"uuid": "c", "name": "t", "created_at": "x", "chat_messages": [message(1, "human", "long enough to be kept as a memory"), message(2, "assistant", "y" * 50), message(3, "human", "short"), message(4, "human", "", [{"type": "text", "text": "in blocks, and long enough as well"}])]}]
    (tmp_path / "export.json").write_text(json.dumps(export))
    assert {r.message_id for r in formats.conversation_export(spark, str(tmp_path / "export.json")).collect()} == {"1", "4"}
    np.save(tmp_path / "v.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    assert [r.vector for r in formats.npy_vectors(spark, str(tmp_path / "v.npy")).orderBy("index").collect()] == [[0.0, 1.0], [2.0, 3.0], [4.0, 5.0]]
    table = spark.createDataFrame([(1, "a"), (2, None)], "id long, x string")
    formats.backup({"t": table}, str(tmp_path / "b"))
    empty = spark.createDataFrame([], table.schema)
    assert sorted(map(tuple, formats.restored(spark, str(tmp_path / "b"), {"t": empty})["t"].collect())) == [(1, "a"), (2, None)]
    held = spark.createDataFrame([(1, "mine")], table.schema)
    with pytest.raises(ValueError, match="isn't empty"):
        formats.restored(spark, str(tmp_path / "b"), {"t": held})
    assert sorted(map(tuple, formats.restored(spark, str(tmp_path / "b"), {"t": held}, force=True)["t"].collect())) == [(1, "mine"), (2, None)]
    (tmp_path / "c.jsonl").write_text('{"doc_id": "1", "text": "Ann", "entities": [{"start": 0, "end": 3, "type": "PERSON", "text": "Ann"}]}\n')
    assert formats.labelled_corpus(spark, str(tmp_path / "c.jsonl")).first().entities[0].text == "Ann"
    formats.write_digest(spark.createDataFrame([("# a",), ("- b",)], "line string"), str(tmp_path / "digest"))
    assert [r.value for r in spark.read.text(str(tmp_path / "digest")).collect()] == ["# a", "- b"]


def test_blobs_and_hash_embedding(spark):
    df = spark.createDataFrame([(1, [1.0, -2.5]), (2, None)], "id long, v array<float>")
    packed = vectors.to_blob(df, "v", "b")
    assert [r.w for r in vectors.from_blob(packed, "b", "w", 2).orderBy("id").collect()] == [[1.0, -2.5], None]
    with pytest.raises(Exception, match="another length"):
        vectors.from_blob(packed, "b", "w", 3).collect()
    texts = spark.createDataFrame([(1, "the red fox"), (2, "The red, fox!"), (3, "blue whales swim"), (4, "")], "id long, content string")
    got = {r.id: np.array(r.vector) for r in retrieval.embedded(texts, dims=32).collect()}
    assert np.allclose(got[1], got[2]) and abs(np.linalg.norm(got[1]) - 1) < 1e-9 and got[1] @ got[3] < 0.9 and not got[4].any()


def test_overlap_matches(spark):
    from velum.operators import store

    shape = "doc_id long, ord int, kind string, text string"
    gold = spark.createDataFrame([(1, 0, "P", "Ann Lee"), (1, 1, "P", "Bob"), (2, 0, "O", "Acme")], shape)
    found = spark.createDataFrame([(1, 0, "P", "Ann"), (1, 1, "P", "ann lee"), (1, 2, "P", "bob"), (2, 0, "P", "Acme")], shape)
    got = sorted(map(tuple, store.overlap_matches(gold, found).collect()))
    assert got == [(1, "P", 2, 1, 0), (2, "O", 0, 0, 1), (2, "P", 0, 1, 0)]


def test_paragraphs_keep_their_digits(spark):
    """Only white space around paragraphs goes, also where a paragraph starts or ends with the digit of its place."""
    text = "\n\n".join(f"{i} a paragraph that is long enough {i}" for i in range(4))
    row = spark.createDataFrame([(text,)], "content string").select(memory.chunks(F.col("content"), 50).alias("c")).first()
    assert row.c == text.split("\n\n")


def test_not_covered_equals_brute_force(spark):
    rng = random.Random(5)
    sets = [" ".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(1, 9))) for _ in range(160)] + ["", "   "]
    asked, held = list(enumerate(sets[:100])) + [(900, "")], sets[80:]
    words = lambda t: frozenset(t.lower().split())
    want = {i for i, t in asked if not any(words(t) and words(h) and len(words(t) & words(h)) / len(words(t) | words(h)) > 0.7 for h in held)}
    got = memory.not_covered(spark.createDataFrame(asked, "id long, content string"), spark.createDataFrame([(h,) for h in held], "content string"))
    assert {r.id for r in got.collect()} == want and got.count() == len(want)


def test_frames_stream_equals_batch(spark, tmp_path):
    """Events cut anywhere, both shapes, a token split over deltas, a held start let out at the end of a block."""
    event = lambda **x: "data: " + json.dumps(x) + "\n\n"
    block = lambda kind, key, text: event(type="content_block_delta", delta={"type": kind, key: text})
    said = lambda text: event(object="chat.completion.chunk", choices=[{"delta": {"content": text}}])
    start = event(type="content_block_start", content_block={"input": {"a": ["[PERSON_1]"]}})
    one = start + block("text_delta", "text", "Hi [PER") + block("text_delta", "text", "SON_1], [OR") + "event: stop\n" + event(type="content_block_stop") + block("input_json_delta", "partial_json", '{"f": "[PERSON_1]')
    two = said("to [PERSON_1") + said("] and [ORG_2] [") + "data: [DONE]\n\n" + ": ping\r\n\r\ndata: not json [PERSON_1]"
    rows = [(s, i // 9, t[i : i + 9], i + 9 >= len(t), {"[PERSON_1]": "Ada"} if i == 0 else None) for s, t in (("one", one), ("two", two)) for i in range(0, len(t), 9)]
    table = spark.createDataFrame(rows, "stream_id string, seq long, payload string, final boolean, tokens map<string,string>")
    batch = sorted(map(tuple, restore.restore_frames_batch(table).collect()))
    whole = {s: "".join(t for k, _, t in batch if k == s) for s in ("one", "two")}
    texts = [json.loads(x[6:]) for x in whole["one"].splitlines() if x.startswith("data: ")]
    assert texts[0]["content_block"]["input"]["a"] == ["Ada"] and [x["delta"]["text"] for x in texts[1:4]] == ["Hi ", "Ada, ", "[OR"]
    assert texts[4]["type"] == "content_block_stop" and texts[5]["delta"]["partial_json"] == '{"f": "Ada'
    assert [json.loads(x[6:])["choices"][0]["delta"]["content"] for x in whole["two"].splitlines() if x.startswith('data: {')] == ["to ", "Ada and [ORG_2] ", "["]
    assert whole["two"].endswith("data: [DONE]\n\n: ping\r\n\r\ndata: not json [PERSON_1]")
    got = streamed(spark, tmp_path, table, restore.restore_frames_stream, "frames")
    assert got == batch
