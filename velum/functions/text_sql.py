"""Detection, masking and chunks for SQL text: table functions for spans and chunks, SQL functions for masks."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from velum.operators import detect
from velum.operators.masking import POISONED
from velum.operators.memory import CHUNK_CHARS, STORE_CHARS

_flags = re.ASCII
#: Classes in their order: pattern, kind, whether a match must start outside of earlier ones, whether it covers its place.
_CLASSES = [
    (re.compile(detect.URL, _flags), "URL", False, True), (re.compile(detect.EMAIL, _flags), "EMAIL", False, True), (re.compile(detect.DOMAIN, _flags), "URL", True, True),
    (re.compile(detect.HANDLE, _flags), "HANDLE", True, True), (re.compile(detect.PHONE, _flags), "PHONE", False, True), (re.compile(detect.IPV4, _flags), "IP", True, True),
    (re.compile(detect.SECRET, _flags), "SECRET", True, False), (re.compile(detect.CAMEL, _flags), "PROJECT", False, False),
]


def spans(text: str | None) -> Iterator[tuple[int, str, str]]:
    """(start, text, kind) of each entity of velum.operators.detect.entities(), in its order."""
    taken: list[tuple[int, int]] = []
    seen: set[str] = set()
    for pattern, kind, outside, covers in _CLASSES:
        found = [(m.start(), m[0]) for m in pattern.finditer(text or "")]
        if outside:
            found = [(a, t) for a, t in found if not any(b <= a < e for b, e in taken)]
        if covers:
            taken += [(a, a + len(t)) for a, t in found]
        for a, t in found:
            if kind == "SECRET" and not (re.search("[0-9]", t) and re.search("[A-Za-z]", t)) or t in detect.TECH_TERMS:
                continue
            if len(t.strip().encode()) >= 3 and t.lower() not in seen:
                seen.add(t.lower())
                yield a, t, kind


def chunks(text: str | None) -> list[str]:
    """velum.operators.memory.chunks() of one text."""
    text = text or ""
    if len(text) <= CHUNK_CHARS:
        return [text.strip(" ")]
    parts = [p.strip(" ") for p in re.split(r"\n\s*\n", text, flags=_flags)]
    parts = [p for p in parts if len(p) >= STORE_CHARS]
    return parts if len(parts) > 1 else [text.strip(" ")]


@F.udtf(returnType="start int, text string, kind string", useArrow=False)
class TextSpans:
    """(start, text, kind) of the entities of a text."""

    def eval(self, text: str):
        yield from spans(text)


@F.udtf(returnType="idx int, chunk string", useArrow=False)
class TextChunks:
    """(idx, chunk) of a text."""

    def eval(self, text: str):
        yield from enumerate(chunks(text))


def register(spark: SparkSession) -> list[str]:
    """Declares the functions for SQL text of this session and returns their names.

    text_spans(text) and text_chunks(text) are table functions; mask_text(text, tokens) and restore_text(text, tokens)
    take a map of original to token and are inlined by Catalyst; token_map_of(entities) makes such a map from an array
    of (text, kind) in the order of the text.
    """
    spark.udtf.register("text_spans", TextSpans)
    spark.udtf.register("text_chunks", TextChunks)
    m, entries = "MAP<STRING, STRING>", "map_entries(m)"
    longest = "(a, b) -> CASE WHEN char_length(a.{0}) > char_length(b.{0}) THEN -1 WHEN char_length(a.{0}) < char_length(b.{0}) THEN 1 WHEN a.{0} < b.{0} THEN -1 WHEN a.{0} > b.{0} THEN 1 ELSE 0 END"
    held = f"array_sort(filter({entries}, e -> contains(lower(t), lower(e.key))), {longest.format('key')})"
    quoted = r"concat(r'(?i)(?<![A-Za-z0-9_@/])\Q', replace(e.key, r'\E', r'\E\\E\Q'), r'\E(?!\w)')"
    back = f"array_sort(filter({entries}, e -> contains(t, e.value) AND NOT e.key RLIKE r'{POISONED}'), {longest.format('value')})"
    number = "size(filter(slice(e, 1, i + 1), y -> y.kind = x.kind))"
    bodies = {
        "mask_text": (f"t STRING, m {m}", "STRING", f"aggregate({held}, t, (acc, e) -> regexp_replace(acc, {quoted}, e.value))"),
        "restore_text": (f"t STRING, m {m}", "STRING", f"aggregate({back}, t, (acc, e) -> replace(acc, e.value, e.key))"),
        "token_map_of": ("e ARRAY<STRUCT<text STRING, kind STRING>>", m, f"map_from_entries(transform(e, (x, i) -> struct(x.text, concat('[', x.kind, '_', {number}, ']'))))"),
    }
    for name, (args, out, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {out} RETURN {body}")
    return ["text_chunks", "text_spans", *sorted(bodies)]
