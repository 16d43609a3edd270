"""Streams whose state ends: restored events and subscriptions, with timers and time to live (transformWithState).

Each keeps its state by key in the state store (RocksDB: set spark.sql.streaming.stateStore.providerClass), drops it when
a stream ends, and forgets what falls silent. The finished-table forms are in velum.streaming.restore and .bus.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from velum.streaming.bus import HELD
from velum.streaming.restore import let_out, restore_chunk


class _Restore(StatefulProcessor):
    """State of a stream: the unfinished event with its number (value), text held back by lane and tokens (maps)."""

    def __init__(self, silence_ms: int, by_event_time: bool):
        self.silence, self.by_event_time = silence_ms, by_event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # No time to live: a state that went before its timer would lose the text that it holds back.
        self.open = handle.getValueState("open", "buffer string, seq long")
        self.waiting = handle.getMapState("waiting", "lane string", "held string, shape string")
        self.tokens = handle.getMapState("tokens", "token string", "original string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = {k[0]: v[0] for k, v in self.tokens.iterator()} if self.tokens.exists() else {}
        waiting = {k[0]: [v[0], v[1]] for k, v in self.waiting.iterator()} if self.waiting.exists() else {}
        buffer, seq = tuple(self.open.get()) if self.open.exists() else ("", None)
        at, fresh, ended = None, {}, False
        for r in sorted(rows, key=lambda r: r.seq):
            if ended:  # a stream that goes on behind its end is a new one
                buffer, waiting, known, ended = "", {}, {}, False
            fresh |= dict(r.tokens or {})
            (buffer, waiting, known), text = restore_chunk((buffer, waiting, known), (r.seq, r.payload, r.final, r.tokens))
            seq, at, ended = r.seq, r.at, bool(r.final)
            yield Row(stream_id=key[0], seq=r.seq, payload=text)
        for timer in [*self.handle.listTimers()]:
            self.handle.deleteTimer(timer)
        if ended:
            self._forget()
            return
        self.open.update((buffer, seq))
        self.waiting.clear()
        for lane, (held, shape) in waiting.items():
            self.waiting.updateValue((lane,), (held, shape))
        for token in fresh.keys() & known.keys():
            self.tokens.updateValue((token,), (known[token],))
        now = int(at.timestamp() * 1000) if self.by_event_time else timerValues.getCurrentProcessingTimeInMs()
        self.handle.registerTimer(now + self.silence)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.open.exists():
            buffer, seq = self.open.get()
            known = {k[0]: v[0] for k, v in self.tokens.iterator()}
            waiting = {k[0]: [v[0], v[1]] for k, v in self.waiting.iterator()}
            _, text = restore_chunk((buffer, waiting, known), (seq, "", True, None))
            if text:
                yield Row(stream_id=key[0], seq=seq + 1, payload=text)
        self._forget()

    def _forget(self) -> None:
        for state in (self.open, self.waiting, self.tokens):
            state.clear()

    def close(self) -> None:
        pass


def restore_frames(chunks: DataFrame, silence_seconds: float, by_event_time: bool = False) -> DataFrame:
    """(stream_id, seq, payload): restore_frames_stream() of velum.streaming.restore with state that ends.

    `chunks` has stream_id, seq, payload, final, tokens (map or null) and at (timestamp). A stream's state goes with its
    final chunk. One that is silent for `silence_seconds` gets what is held back as one more row (number behind its
    last) and is forgotten: by the clock, or by event time against the watermark of `chunks` on `at`.
    """
    rows = chunks.select("stream_id", "seq", "payload", "final", "tokens", "at")
    processor = _Restore(round(1000 * silence_seconds), by_event_time)
    return rows.groupBy("stream_id").transformWithState(processor, "stream_id string, seq long, payload string", "append", "eventTime" if by_event_time else "processingTime")


class _Subscription(StatefulProcessor):
    """State of a subscription: the newest events that it hasn't seen (list) and how many fell out (value)."""

    def __init__(self, most: int, ttl_ms: int | None):
        self.most, self.ttl = most, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "seq long", self.ttl)
        self.lost = handle.getValueState("lost", "n long", self.ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = [r[0] for r in self.held.get()] if self.held.exists() else []
        lost = self.lost.get()[0] if self.lost.exists() else 0
        for r in sorted(rows, key=lambda r: (r.seq, r.poll)):
            if r.poll:
                yield Row(subscriber=key[0], kind=key[1], seq=r.seq, delivered=len(held), lost=lost, first=held[0] if held else None, last=held[-1] if held else None)
                held, lost = [], 0
            else:
                held.append(r.seq)
                if len(held) > self.most:
                    held.pop(0)
                    lost += 1
        if held:
            self.held.put([(s,) for s in held])
            self.lost.update((lost,))
        else:
            self.held.clear()
            self.lost.clear()

    def close(self) -> None:
        pass


def deliveries(rows: DataFrame, most: int = HELD, ttl_seconds: float | None = None) -> DataFrame:
    """velum.streaming.bus.deliveries() as a stream of (subscriber, kind, seq, poll), in order of seq from batch to batch.

    Up to `most` events of a subscription are held; one that gets nothing for `ttl_seconds` is forgotten.
    """
    shape = "subscriber string, kind string, seq long, delivered long, lost long, first long, last long"
    processor = _Subscription(most, None if ttl_seconds is None else round(1000 * ttl_seconds))
    keyed = rows.select("subscriber", "kind", "seq", F.col("poll").cast("boolean").alias("poll")).groupBy("subscriber", "kind")
    return keyed.transformWithState(processor, shape, "append", "none" if ttl_seconds is None else "processingTime")
