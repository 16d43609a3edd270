"""Streams: restoring tokens across chunks, sliding rate limits, and the monitor of runaway growth.

Each has a streaming form (keyed state in Structured Streaming) and a batch form over a finished table (a fold of the
ordered events of a key: chunks in the JVM, the monitors row by row with the state of the stream), which give the same
rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from velum.functions import json_text

# The start of a token that is not complete yet, and the limits of the monitors.
PARTIAL = r"\[[A-Z]*_?[0-9]*$"
POISONED = r"\[[A-Z]+_[0-9]+\]?"
WINDOW, HIGH, GROWTH = 5, 50, 20
REQUESTS, SECONDS = 120, 60


def push(buffer: str, text: str, originals: dict[str, str], final: bool) -> tuple[str, str]:
    """(text that is safe to send, text held back): a possible start of a token waits for the next chunk."""
    whole = buffer + text
    held = "" if final or not (m := re.search(PARTIAL, whole)) else m[0]
    safe = whole[: len(whole) - len(held)]
    for token in sorted(originals, key=lambda t: (-len(t), t)) if "[" in safe else ():
        if token in safe and not re.search(POISONED, originals[token]):
            safe = safe.replace(token, originals[token])
    return safe, held


#: Tokens of given sessions that restore_stream() may broadcast; larger maps come with the rows of their stream.
MOST_TOKENS = 100_000


def restore_text(state: tuple, values: tuple) -> tuple[tuple, str]:
    """The next state (text held back, tokens) and the safe text of a chunk (seq, payload, final, tokens)."""
    held, known = state
    _, payload, final, tokens = values
    known = {**known, **dict(tokens)} if tokens else known
    text, held = push(held, payload or "", known, bool(final))
    return (held, known), text


def restore_stream(chunks: DataFrame, originals: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """(stream_id, seq, text) from a stream of (stream_id, seq, payload, final, tokens): chunks of a stream must come in order.

    `tokens` (map or null) comes with the rows of its stream and lives in the state with the text held back, which a
    final chunk drops. A few known sessions may be given as `originals` instead.
    """
    given = originals or {}
    if sum(map(len, given.values())) > MOST_TOKENS:
        raise ValueError("too many tokens to broadcast; send them with the chunks")
    shared = chunks.sparkSession.sparkContext.broadcast(given)
    rows = chunks if "tokens" in chunks.columns else chunks.withColumn("tokens", F.lit(None).cast("map<string,string>"))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("seq")
        now = (state.get[0], json.loads(state.get[1])) if state.exists else ("", {})
        out, ended = [], False
        for values in zip(rows["seq"], rows["payload"], rows["final"], rows["tokens"], strict=True):
            (held, known), text = restore_text((now[0], {**shared.value.get(key[0], {}), **now[1]}), values)
            now = held, {t: o for t, o in known.items() if shared.value.get(key[0], {}).get(t) != o}
            out.append((key[0], values[0], text))
            ended = bool(values[2])
        if ended:
            state.remove()
        else:
            state.update((now[0], json.dumps(now[1])))
        yield pd.DataFrame(out, columns=["stream_id", "seq", "text"])

    return rows.groupBy("stream_id").applyInPandasWithState(step, "stream_id string, seq long, text string", "held string, tokens string", "append", GroupStateTimeout.NoTimeout)


def restore_batch(chunks: DataFrame, tokens: DataFrame) -> DataFrame:
    """The rows of restore_stream() for a finished table; `tokens` has stream_id, token, original.

    The tokens of a stream are one row in front of its chunks; rows are streamed with the state of one stream held.
    """
    first = F.lit(-(2**63)).cast("long")
    one = tokens.where(F.col("stream_id").isNotNull() & F.col("token").isNotNull()).groupBy("stream_id", "token").agg(F.min("original").alias("original"))
    maps = one.groupBy("stream_id").agg(F.map_from_entries(F.collect_list(F.struct("token", "original"))).alias("tokens"))
    given = maps.select("stream_id", first.alias("seq"), F.lit("").alias("payload"), F.lit(False).alias("final"), "tokens")
    rows = given.unionAll(chunks.select("stream_id", F.col("seq").cast("long"), "payload", "final", F.lit(None).cast("map<string,string>")))
    out = fold(rows, "stream_id", ("seq",), lambda: ("", {}), restore_text, "text", pa.string(), ("payload", "final", "tokens"))
    return out.where(F.col("seq") > first)


def sse_events(stream: DataFrame) -> DataFrame:
    """(stream_id, seq, event, data) of whole server-sent event texts (stream_id, payload): split at blank lines."""
    blocks = stream.select("stream_id", F.posexplode(F.split("payload", r"\r\n\r\n|\n\n")).alias("seq", "block")).where("block != ''")
    lines = F.split("block", r"\r?\n")
    data = F.array_join(F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit("data:"))), lambda x: F.ltrim(F.substring(x, F.lit(6), F.char_length(x)))), "\n")
    event = F.try_element_at(F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit("event:"))), lambda x: F.trim(F.substring(x, F.lit(7), F.char_length(x)))), F.lit(1))
    return blocks.select("stream_id", "seq", event.alias("event"), data.alias("data"))


def usage(events: DataFrame) -> DataFrame:
    """(stream_id, input_tokens, output_tokens): the largest counts that the events (data as JSON) report."""
    number = lambda *paths: F.coalesce(*(F.get_json_object("data", p).cast("long") for p in paths))
    return events.groupBy("stream_id").agg(
        F.max(number("$.message.usage.input_tokens", "$.usage.input_tokens")).alias("input_tokens"), F.max(number("$.usage.output_tokens", "$.message.usage.output_tokens")).alias("output_tokens")
    )


_BLANK, _LINE = re.compile(r"(\r\n\r\n|\n\n)"), re.compile(r"[^\n]*\n|[^\n]+")
#: JSON as json.dumps(value, ensure_ascii=False) writes it.
_written = json.JSONEncoder(ensure_ascii=False).encode


def framed(buffer: str, text: str) -> tuple[list[str], str]:
    """(whole events with their blank lines, what is left): server-sent events that end in `buffer` + `text`."""
    whole = buffer + text
    if "\n\n" not in whole and "\r\n\r\n" not in whole:
        return [], whole
    parts = _BLANK.split(whole)
    return [a + b for a, b in zip(parts[:-1:2], parts[1::2], strict=True)], parts[-1]


def deltas(event: dict) -> list[tuple[dict, str, str]]:
    """Places (object, key, lane) of streamed text in an event of any provider shape: block deltas, choices, candidates.

    Deltas of one lane (a content block, a choice, a candidate) belong to one text.
    """
    delta = event.get("delta")
    if event.get("type") == "content_block_delta" and isinstance(delta, dict):
        key = {"text_delta": "text", "input_json_delta": "partial_json"}.get(delta.get("type"))
        return [(delta, key, f"block {event.get('index', 0)} {key}")] if key and isinstance(delta.get(key), str) else []
    found = []
    for n, choice in enumerate(_objects(event.get("choices"))):
        if isinstance(d := choice.get("delta"), dict) and isinstance(d.get("content"), str):
            found.append((d, "content", f"choice {choice.get('index', n)}"))
    for n, candidate in enumerate(_objects(event.get("candidates"))):
        content = candidate.get("content")
        for part in _objects(content.get("parts")) if isinstance(content, dict) else []:
            if isinstance(part.get("text"), str):
                found.append((part, "text", f"candidate {candidate.get('index', n)}"))
    return found


def _objects(value) -> list[dict]:
    return [x for x in value if isinstance(x, dict)] if isinstance(value, list) else []


def _safe(held: str, text: str, key: str, originals: dict[str, str], final: bool) -> tuple[str, str]:
    """push(), with originals escaped where the text is a fragment of JSON; a text without a bracket is safe as it is."""
    if not held and "[" not in text:
        return text, ""
    if key == "partial_json":
        originals = {t: json.dumps(o, ensure_ascii=False)[1:-1] for t, o in originals.items()}
    return push(held, text, originals, final)


def let_out(waiting: dict[str, list[str]], originals: dict[str, str], end: str = "\n") -> str:
    """Events with the text that lanes still hold back, each in the shape of its lane's last delta."""
    out = ""
    for lane in sorted(waiting):
        held, shape = waiting[lane]
        if held:
            last = json.loads(shape)
            for where, key, own in deltas(last):
                where[key] = _safe(held, "", key, originals, True)[0] if own == lane else ""
            out += f"data: {json.dumps(last, ensure_ascii=False)}{end}{end}"
    return out


def restore_event(raw: str, originals: dict[str, str], waiting: dict[str, list[str]]) -> tuple[str, dict[str, list[str]]]:
    """(event, waiting): one event with the tokens in its deltas restored.

    `waiting` holds, by lane, the text held back and its last delta's event. A possible start of a token waits for the
    next delta of its lane; an event without deltas, other than a ping, lets all out before itself. The start of a
    block is restored in all its strings, fragments of tool input get originals in JSON's escapes, anything else passes
    as it is.
    """
    out, waiting = "", dict(waiting) if waiting else {}
    for line in _LINE.findall(raw):
        body = line.rstrip("\r\n")
        end = line[len(body) :]
        try:
            event = json.loads(body[6:]) if body.startswith("data: ") else None
        except ValueError:
            event = "done"
        places = deltas(event) if isinstance(event, dict) else []
        if event is not None and not places and not (isinstance(event, dict) and event.get("type") == "ping"):
            out, waiting = let_out(waiting, originals, end) + out, {}
        for where, key, lane in places:
            held = waiting.get(lane, ["", ""])[0]
            safe, held = _safe(held, where[key], key, originals, False)
            if held:
                waiting[lane] = [held, _written(event)]
            else:
                waiting.pop(lane, None)
            where[key] = safe
        if isinstance(event, dict) and event.get("type") == "content_block_start":
            line = "data: " + restore_json(body[6:], originals) + end
        elif places:
            line = f"data: {_written(event)}{end}"
        out += line
    return out, waiting


def restore_chunk(state: tuple, values: tuple) -> tuple[tuple, str]:
    """The next state (buffer, waiting, tokens) and the events that a chunk (seq, payload, final, tokens) completes."""
    buffer, waiting, known = state
    _, payload, final, tokens = values
    known = {**known, **dict(tokens)} if tokens else known
    events, buffer = framed(buffer, payload or "")
    out = ""
    for raw in events:
        made, waiting = restore_event(raw, known, waiting)
        out += made
    if final:
        if buffer:
            made, waiting = restore_event(buffer, known, waiting)
            out, buffer = out + made, ""
        out, waiting = out + let_out(waiting, known), {}
    return (buffer, waiting, known), out


def restore_frames_stream(chunks: DataFrame) -> DataFrame:
    """(stream_id, seq, payload) from a stream of raw server-sent events in chunks of any size.

    `chunks` has stream_id, seq, payload, final and tokens (map of token to original, or null), in order. Tokens come
    with the rows of their stream, from its first chunk or whenever new ones are known, and live in the keyed state with
    the unfinished event and the text held back; nothing is broadcast.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("seq")
        now = (state.get[0], json.loads(state.get[1]), json.loads(state.get[2])) if state.exists else ("", {}, {})
        out = []
        for values in zip(rows["seq"], rows["payload"], rows["final"], rows["tokens"], strict=True):
            now, text = restore_chunk(now, values)
            out.append((key[0], values[0], text))
        state.update((now[0], json.dumps(now[1]), json.dumps(now[2])))
        yield pd.DataFrame(out, columns=["stream_id", "seq", "payload"])

    return chunks.groupBy("stream_id").applyInPandasWithState(step, "stream_id string, seq long, payload string", "buffer string, waiting string, tokens string", "append", GroupStateTimeout.NoTimeout)


def restore_frames_batch(chunks: DataFrame) -> DataFrame:
    """The rows of restore_frames_stream() for a finished table; rows are streamed with the state of one stream held."""
    return fold(chunks, "stream_id", ("seq",), lambda: ("", {}, {}), restore_chunk, "payload", pa.string(), ("payload", "final", "tokens"))


def admit(times: list[float], now: float, most: int, seconds: float) -> tuple[bool, list[float]]:
    """Whether a request at `now` is admitted, and the admitted times still in the window."""
    live = [t for t in times if t >= now - seconds]
    return (True, [*live, now]) if len(live) < most else (False, live)


def rate_limit_stream(requests: DataFrame, most: int = REQUESTS, seconds: float = SECONDS) -> DataFrame:
    """(key, seq, admitted) from a stream of (key, seq, at): only admitted requests count. State: their times."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["at", "seq"])
        (times,) = state.get if state.exists else ([],)
        times, out = list(times), []
        for seq, at in zip(rows["seq"], rows["at"], strict=True):
            ok, times = admit(times, float(at), most, seconds)
            out.append((key[0], seq, ok))
        state.update((times,))
        yield pd.DataFrame(out, columns=["key", "seq", "admitted"])

    return requests.groupBy("key").applyInPandasWithState(step, "key string, seq long, admitted boolean", "times array<double>", "append", GroupStateTimeout.NoTimeout)


def fold(rows: DataFrame, key: str, order: tuple[str, ...], start: Callable[[], object], step: Callable[[object, tuple], tuple[object, object]], out: str, kind: pa.DataType, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, seq, out): `step` (state, values of `order` and `carry`) -> (state, result) over the rows of each key by `order`.

    Rows are sorted within partitions and streamed; only the state of one key is held, however many rows the key has.
    """
    at = order.index("seq")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, start()
        for batch in batches:
            keys, results = batch.column(0).to_pylist(), []
            for k, values in zip(keys, zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True), strict=True):
                if k != last:
                    last, state = k, start()
                state, result = step(state, values)
                results.append(result)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1 + at), pa.array(results, kind)], names=[key, "seq", out])

    sorted_rows = rows.select(key, *(F.col("seq").cast("long") if c == "seq" else c for c in order), *carry).repartition(key).sortWithinPartitions(key, *order)
    shape = "boolean" if pa.types.is_boolean(kind) else "string"
    return sorted_rows.mapInArrow(work, f"{key} {rows.schema[key].dataType.simpleString()}, seq long, {out} {shape}")


def rate_limit_batch(requests: DataFrame, most: int = REQUESTS, seconds: float = SECONDS) -> DataFrame:
    """The rows of rate_limit_stream() for a finished table. A request without a time sees none and leaves none."""

    def step(times: list[float], values: tuple) -> tuple[list[float], bool]:
        if values[0] is None:
            return [], most > 0
        ok, times = admit(times, values[0], most, seconds)
        return times, ok

    return fold(requests.withColumn("at", F.col("at").cast("double")), "key", ("at", "seq"), list, step, "admitted", pa.bool_())


def fires(window: list[int], count: int) -> tuple[bool, list[int]]:
    """Whether growth runs away with this count, and the window behind it (empty once it has fired)."""
    window = [*window, count][-WINDOW:]
    fired = len(window) == WINDOW and count > HIGH and count - window[0] >= GROWTH and count > window[-2]
    return fired, [] if fired else window


def cascade_stream(counts: DataFrame) -> DataFrame:
    """(key, seq, fired) from a stream of (key, seq, n). State: the window of counts."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("seq")
        (window,) = state.get if state.exists else ([],)
        window, out = list(window), []
        for seq, n in zip(rows["seq"], rows["n"], strict=True):
            fired, window = fires(window, int(n))
            out.append((key[0], seq, fired))
        state.update((window,))
        yield pd.DataFrame(out, columns=["key", "seq", "fired"])

    return counts.groupBy("key").applyInPandasWithState(step, "key string, seq long, fired boolean", "window array<long>", "append", GroupStateTimeout.NoTimeout)


def cascade_batch(counts: DataFrame) -> DataFrame:
    """The rows of cascade_stream() for a finished table. A window with a null count at its ends doesn't fire."""

    def step(window: list[int], values: tuple) -> tuple[list[int], bool]:
        longer = [*window, values[1]][-WINDOW:]
        if None in (longer[0], longer[-1], longer[-2:][0]):
            return longer, False
        fired, window = fires(window, values[1])
        return window, fired

    return fold(counts.withColumn("n", F.col("n").cast("long")), "key", ("seq", "n"), list, step, "fired", pa.bool_())


def restore_json(text: str, originals: dict[str, str]) -> str:
    """JSON text with tokens restored in every string, keys and all other bytes as they are; other text is restored plainly."""
    try:
        leaves = json_text.string_leaves(text)
        read = {n: json_text.value(text, a, b) for n, (_, a, b) in enumerate(leaves) if "[" in text[a:b]}
        changed = {n: new for n, old in read.items() if (new := push("", old, originals, True)[0]) != old}
        return json_text.rewrite(text, changed, leaves)
    except ValueError:
        return push("", text, originals, True)[0]
