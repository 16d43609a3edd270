"""Streams over RocksDB: state that ends, bounded subscriptions, event time; each against its form over a table."""

import datetime
import json
import os
import random
import time

import pytest

from velum.streaming import bus, restore, stateful, windows

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


class Feed:
    """A stream whose rows are given batch by batch; each time it runs until all is read, and goes on from its state."""

    def __init__(self, spark, tmp_path, schema, make, name, clock=False):
        self.spark, self.schema, self.make, self.n, self.sent, self.clock, self.query = spark, schema, make, 0, 0, clock, None
        self.path, self.out, self.state = (str(tmp_path / f"{name}-{x}") for x in ("in", "out", "state"))
        os.mkdir(self.path)

    def send(self, rows):
        self.n += 1
        part = f"{self.path}-{self.n:04}"
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(part)
        for f in os.listdir(part):
            if f.endswith(".parquet"):
                os.rename(f"{part}/{f}", f"{self.path}/{self.n:04}-{f}")
        source = self.spark.readStream.schema(self.spark.createDataFrame([], self.schema).schema).parquet(self.path)
        writer = lambda: self.make(source).writeStream.format("parquet").outputMode("append").option("checkpointLocation", self.state)
        if not self.clock:
            query = writer().trigger(availableNow=True).start(self.out)
            assert query.awaitTermination(100)
        elif self.query is None:  # timers by the clock have no end of input: one run, stopped by stop()
            self.query = writer().trigger(processingTime="200 milliseconds").start(self.out)
        query = self.query or query
        self.sent += len(rows)
        self.wait(lambda: not self.clock or sum(p["numInputRows"] for p in query.recentProgress) >= self.sent)
        if query.exception() is not None:
            raise query.exception()
        self.progress = [p for p in query.recentProgress if p["stateOperators"]]

    def wait(self, ready):
        until = time.time() + 60
        while not ready() and time.time() < until and (self.query is None or self.query.exception() is None):
            time.sleep(0.1)
        assert ready()

    def stop(self):
        if self.query is not None:
            self.progress = [p for p in self.query.recentProgress if p["stateOperators"]]
            self.query.stop()

    def rows(self):
        return sorted(map(tuple, self.spark.read.parquet(self.out).collect()), key=repr)

    def held(self):
        """Rows in the state after the last batch."""
        return sum(s["numRowsTotal"] for s in self.progress[-1]["stateOperators"])


CHUNKS = "stream_id string, seq long, payload string, final boolean, tokens map<string,string>, at timestamp"


def moment(seconds):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


def said(text):
    return "data: " + json.dumps({"type": "content_block_delta", "index": 0, "delta": {"type": "text_delta", "text": text}}) + "\n\n"


def test_state_goes_with_the_final_chunk(spark, tmp_path):
    feed = Feed(spark, tmp_path, CHUNKS, lambda d: stateful.restore_frames(d, 1000.0), "ended", True)
    feed.send([("a", 0, said("Hi [PER"), False, {"[PERSON_1]": "Ada"}, moment(0)), ("b", 0, said("x [ORG"), False, {"[ORG_2]": "Acme"}, moment(0))])
    assert feed.held() > 0
    feed.send([("a", 1, said("SON_1]!"), True, None, moment(1)), ("b", 1, said("_2] y"), True, None, moment(1))])
    assert feed.held() == 0
    feed.send([("a", 2, said("[PERSON_1]"), True, None, moment(2))])  # a new stream of that name knows no tokens
    feed.stop()
    whole = "".join(t for s, _, t in sorted(feed.rows(), key=lambda r: r[1]) if s == "a")
    assert [json.loads(x[6:])["delta"]["text"] for x in whole.split("\n\n") if x] == ["Hi ", "Ada!", "[PERSON_1]"]


def test_silent_streams_are_flushed_by_event_time(spark, tmp_path):
    feed = Feed(spark, tmp_path, CHUNKS, lambda d: stateful.restore_frames(d.withWatermark("at", "5 seconds"), 30.0, True), "silent")
    feed.send([("a", 0, said("Hi [PER"), False, {"[PERSON_1]": "Ada"}, moment(0)), ("b", 0, said("z"), False, None, moment(0))])
    feed.send([("b", 1, said("y"), False, None, moment(20))])
    assert not any(s == "a" and n == 1 for s, n, _ in feed.rows())
    feed.send([("b", 2, said("x"), False, None, moment(50))])
    feed.send([("b", 3, said("w"), True, None, moment(51))])
    late = [t for s, n, t in feed.rows() if s == "a" and n == 1]
    assert len(late) == 1 and json.loads(late[0][6:])["delta"]["text"] == "[PER" and feed.held() == 0


def test_silent_streams_are_forgotten_by_the_clock(spark, tmp_path):
    feed = Feed(spark, tmp_path, CHUNKS, lambda d: stateful.restore_frames(d, 2.0), "clock", True)
    feed.send([("a", 0, said("Hi [PER"), False, {"[PERSON_1]": "Ada"}, moment(0))])
    feed.wait(lambda: any(r[:2] == ("a", 1) for r in feed.rows()))
    feed.wait(lambda: sum(s["numRowsTotal"] for s in feed.query.lastProgress["stateOperators"]) == 0)
    feed.stop()
    assert [json.loads(t[6:])["delta"]["text"] for s, n, t in feed.rows() if s == "a" and n == 1] == ["[PER"]


def bus_rows(n=1500, seed=4):
    rng = random.Random(seed)
    seqs = sorted(rng.sample(range(n * 100), n))
    events = [(s, rng.choice(["save", "recall", "audit"])) for s in seqs]
    subscriptions = [("x", bus.ANY), ("x", "save"), ("y", "recall"), ("z", "never")]
    polls = sorted({(rng.choice("xyz"), rng.randrange(n * 100)) for _ in range(25)}, key=lambda p: p[1])
    return events, subscriptions, polls


def brute_bus(events, subscriptions, polls, most):
    out = []
    for who, kind in subscriptions:
        held, lost, moves = [], 0, [(s, 0) for s, k in events if kind in (k, bus.ANY)] + [(s, 1) for w, s in polls if w == who]
        for s, poll in sorted(moves):
            if poll:
                out.append((who, kind, s, len(held), lost, held[0] if held else None, held[-1] if held else None))
                held, lost = [], 0
            else:
                held.append(s)
                lost += len(held) > most
                held = held[-most:]
    return sorted(out, key=repr)


def test_bounded_bus(spark, tmp_path, monkeypatch):
    events, subscriptions, polls = bus_rows()
    e, s, p = spark.createDataFrame(events, "seq long, kind string"), spark.createDataFrame(subscriptions, "subscriber string, kind string"), spark.createDataFrame(polls, "subscriber string, seq long")
    want = brute_bus(events, subscriptions, polls, 40)
    assert any(r[4] for r in want) and any(not r[3] for r in want)
    for size in (1 << 16, 3000):
        monkeypatch.setattr(bus, "SLICE", size)
        assert sorted(map(tuple, bus.deliveries(bus.subscribed(e, s, p), 40).collect()), key=repr) == want
    rows = sorted(map(tuple, bus.subscribed(e, s, p).collect()), key=lambda r: r[2])
    feed = Feed(spark, tmp_path, "subscriber string, kind string, seq long, poll boolean", lambda d: stateful.deliveries(d, 40, 3600.0), "bus", True)
    for a in range(0, len(rows), 700):
        feed.send(rows[a : a + 700])
    feed.stop()
    assert feed.rows() == want


def test_sessions_with_late_rows(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), moment(60 * m), float(m)) for m in sorted(rng.randrange(600) for _ in range(80))]
    shape = "key string, at timestamp, value double"
    table = spark.createDataFrame(rows, shape)
    last = moment(60 * 100_000)
    batch = sorted(map(tuple, windows.sessions(table).collect()), key=repr)
    feed = Feed(spark, tmp_path, shape, lambda d: windows.sessions(d, late="20 minutes"), "sessions")
    shuffled = [r for a in range(0, 80, 8) for r in rng.sample(rows[a : a + 8], len(rows[a : a + 8]))]
    for a in range(0, 80, 8):
        feed.send(shuffled[a : a + 8])
    feed.send([("end", last, 0.0)])
    feed.send([("a", moment(0), 999.0), ("end", last, 0.0)])  # far too late: dropped
    assert [r for r in feed.rows() if r[0] != "end"] == batch and len(batch) > 4


def test_repeated_events_within_the_watermark(spark, tmp_path):
    shape = "id long, at timestamp, value double"
    rows = [(i % 40, moment(60 * (i // 8)), 1.0) for i in range(80)]
    feed = Feed(spark, tmp_path, shape, lambda d: windows.first_of_each(d, ["id"], late="1 hour"), "firsts")
    feed.send(rows[:40])
    feed.send(rows[40:])
    table = spark.createDataFrame(rows, shape)
    assert feed.rows() == sorted(map(tuple, windows.first_of_each(table, ["id"]).collect()), key=repr)


def test_tokens_live_in_the_state(spark, tmp_path):
    shape = "stream_id string, seq long, payload string, final boolean, tokens map<string,string>"
    feed = Feed(spark, tmp_path, shape, restore.restore_stream, "texts")
    feed.send([("a", 0, "to [PER", False, {"[PERSON_1]": "Ada"}), ("b", 0, "x", False, None)])
    feed.send([("a", 1, "SON_1] and [PERSON_1]", True, None), ("b", 1, "[PERSON_1]", False, {"[PERSON_1]": "Bo"})])
    assert feed.rows() == [("a", 0, "to "), ("a", 1, "Ada and Ada"), ("b", 0, "x"), ("b", 1, "Bo")]
    with pytest.raises(ValueError, match="too many"):
        restore.restore_stream(spark.createDataFrame([], shape), {"s": {f"[X_{i}]": "y" for i in range(restore.MOST_TOKENS + 1)}})


def test_fragments_of_tool_input(spark):
    """Originals are escaped in JSON fragments; blocks, choices and candidates hold back on their own; a ping lets nothing out."""
    event = lambda **x: "data: " + json.dumps(x) + "\n\n"
    part = lambda i, text: event(type="content_block_delta", index=i, delta={"type": "input_json_delta", "partial_json": text})
    gemini = lambda *texts: event(candidates=[{"index": i, "content": {"parts": [{"text": t}]}} for i, t in enumerate(texts)])
    sent = part(0, '{"a": "[PER') + part(1, '{"b": "[ORG_') + event(type="ping") + part(0, 'SON_1]"}') + part(1, '2]"}') + event(type="content_block_stop") + gemini("[PERSON_", "[ORG") + gemini("1]", "_2]") + gemini("[OR")
    tokens = {"[PERSON_1]": 'A"d\\a\n', "[ORG_2]": "Acme"}
    rows = [("s", i // 11, sent[i : i + 11], i + 11 >= len(sent), tokens if i == 0 else None) for i in range(0, len(sent), 11)]
    table = spark.createDataFrame(rows, "stream_id string, seq long, payload string, final boolean, tokens map<string,string>")
    whole = "".join(t for _, _, t in sorted(map(tuple, restore.restore_frames_batch(table).collect())))
    read = [json.loads(x[6:]) for x in whole.split("\n\n") if x]
    for lane, want in ((0, {"a": 'A"d\\a\n'}), (1, {"b": "Acme"})):
        assert json.loads("".join(r["delta"]["partial_json"] for r in read if r.get("index") == lane)) == want
    said = ["".join(p["text"] for r in read for c in r.get("candidates", []) if c["index"] == i for p in c["content"]["parts"]) for i in (0, 1)]
    assert said == ['A"d\\a\n[OR', "Acme"]
