"""License scan: template markup compiled into token automata, matched against whole texts.

Templates use the markup of public license lists: `<<beginOptional>>...<<endOptional>>` encloses wording that may be
left out, `<<var;words=N>>` stands for up to N replaced words. A text is accepted where all mandatory words stand in
order, with nothing between them but the optional or replaced regions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velum.llm.common import map_batches, utf8

# Base phrases with their labels.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Templates with their labels.
TEMPLATES = (
    ("mit-notice", "<<beginOptional>>released <<endOptional>>under the <<beginOptional>>terms of the <<endOptional>>mit license"),
    ("apache-2-notice", "licensed under the apache license <<beginOptional>>version <<endOptional>>2<<beginOptional>> 0<<endOptional>>"),
    ("gpl-3-notice", "licensed under the gnu general public license <<beginOptional>>as published by the free software foundation <<endOptional>><<beginOptional>>either <<endOptional>>version 3"),
    ("gpl-2-notice", "licensed under the gnu general public license <<beginOptional>>as published by the free software foundation <<endOptional>><<beginOptional>>either <<endOptional>>version 2"),
    ("lgpl-notice", "licensed under the gnu lesser general public license <<var;words=3>>"),
    ("cc-by-notice", "licensed under <<beginOptional>>a <<endOptional>><<beginOptional>>the <<endOptional>>creative commons attribution <<var;words=6>> license"),
    ("cc-by-nc-notice", "licensed under cc by nc <<beginOptional>>4 0<<endOptional>>"),
    ("mpl-2-notice", "subject to the terms of the mozilla public license <<beginOptional>>v 2 0<<endOptional>><<beginOptional>>version 2 0<<endOptional>>"),
    ("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this <<var;words=6>> and associated documentation files"),
    ("isc-grant", "permission to use copy modify and or distribute this <<var;words=6>> for any purpose with or without fee is hereby granted"),
    ("copyright-holder", "copyright <<beginOptional>>c <<endOptional>><<var;words=8>> all rights reserved"),
)

_NOT_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long>>"


class Automaton:
    """A template as states over words. A state is a set of places in the flattened template.

    Every place holds a mandatory or optional word, or a gap of at most N words; `skips` leads from the first place of
    an optional region to the place behind it.
    """

    def __init__(self, label: str, template: str):
        self.label = label
        self.places: list[tuple[bytes | None, int]] = []  # (word, 0) or (None, words of a gap)
        self.skips: dict[int, int] = {}
        open_at: list[int] = []
        self.mandatory = 0
        for part in re.findall(r"<<[^>]*>>|[^<\s]+", template):
            if part == "<<beginOptional>>":
                open_at.append(len(self.places))
            elif part == "<<endOptional>>":
                self.skips[open_at.pop()] = len(self.places)
            elif part.startswith("<<var"):
                self.places.append((None, int(re.search(r"words=(\d+)", part)[1])))
            else:
                self.places.append((part.lower().encode(), 0))
                self.mandatory += not open_at
        self.end = len(self.places)
        self.starts = {word for place, used in self._closed({(0, 0)}) if place < self.end and (word := self.places[place][0])}

    def _closed(self, states: set[tuple[int, int]]) -> set[tuple[int, int]]:
        todo, seen = list(states), set(states)
        while todo:
            place, used = todo.pop()
            after = []
            if place in self.skips and not used:
                after.append((self.skips[place], 0))
            if place < self.end and self.places[place][0] is None:
                after.append((place + 1, 0))
            for x in after:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return seen

    def match(self, words: list[bytes], at: int) -> int:
        """End of the longest match that starts with the word at `at`, or -1."""
        states, found, i = self._closed({(0, 0)}), -1, at
        while states and i <= len(words):
            if any(place == self.end for place, _ in states) and i > at:
                found = i
            if i == len(words):
                break
            word, after = words[i], set()
            for place, used in states:
                if place == self.end:
                    continue
                want, gap = self.places[place]
                if want is None and used < gap:
                    after.add((place, used + 1))
                elif want == word:
                    after.add((place + 1, 0))
            states, i = self._closed(after), i + 1
        return found


class Scanner:
    """All templates and base phrases, tried only at words with which one of them starts."""

    def __init__(self, templates=TEMPLATES, base=BASE):
        self.base = [(phrase.encode().split(), label) for phrase, label in base]
        self.automata = [Automaton(label, template) for label, template in templates]
        self.by_word: dict[bytes, list[Automaton]] = {}
        for a in self.automata:
            for word in a.starts:
                self.by_word.setdefault(word, []).append(a)
        self.base_by_word: dict[bytes, list[tuple[list[bytes], str]]] = {}
        for phrase, label in self.base:
            self.base_by_word.setdefault(phrase[0], []).append((phrase, label))
        # One mandatory word of every template or phrase: a text with none of them matches nothing.
        must = {max(phrase, key=len) for phrase, _ in self.base}
        for a in self.automata:
            inside = [False] * (a.end + 1)
            for i, j in a.skips.items():
                inside[i:j] = [True] * (j - i)
            must.add(max((w for k, (w, _) in enumerate(a.places) if w and not inside[k]), key=len))
        self.must = re.compile(b"|".join(sorted(map(re.escape, must))))

    def scan(self, text: bytes) -> tuple:
        spaced = text.translate(_NOT_WORD)
        words = spaced.split()
        if not self.must.search(spaced):
            return len(words), 0, None, None, "", "", 0.0, []
        starts, spans, base, places = self.by_word, [], set(), []
        for i, word in enumerate(words):
            for phrase, label in self.base_by_word.get(word, ()):
                if words[i : i + len(phrase)] == phrase:
                    base.add(label)
                    places.append(i)
            for a in starts.get(word, ()):
                if (end := a.match(words, i)) >= 0:
                    spans.append((a, i, end))
        best = max([0, *(a.mandatory for a, _, _ in spans), *(len(p) for p, label in self.base if label in base)])
        labels = base | {a.label for a, _, _ in spans}
        return (
            len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)),
            best / (best + 1), [{"label": a.label, "start": i, "end": end} for a, i, end in spans],
        )


def scan(docs: DataFrame, text: str = "text", id_col: str = "doc_id", templates=TEMPLATES, base=BASE) -> DataFrame:
    """One row per row of `docs`: its id and SCHEMA. Map only: no shuffle, so neither hot sources nor copies matter.

    Words are runs of digits, a to z (A to Z lower-cased) and characters beyond ASCII. n_base counts all places of base
    phrases, first_word and last_word are the smallest and largest of them (null: none). score is m / (m + 1) for the m
    mandatory words of the longest accepted template or phrase, 0 without one. spans lists template matches by word.
    Null texts count as empty (no words, empty labels, score 0); equal rows give equal rows; an empty table gives an
    empty table; other columns of `docs` are ignored, whatever their names; a null id stays null.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, base)
        for batch in batches:
            rows = [scanner.scan(x) for x in batch.column(1).to_pylist()]
            columns = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=[id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col), utf8(text).alias("_text")), work, f"`{id_col}` {kind}, {SCHEMA}")
