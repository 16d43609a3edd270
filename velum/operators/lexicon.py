"""Names of people, places and organisations by lexicons: rules over white-space tokens, as an Arrow batch operator."""

from __future__ import annotations

import functools
import re
import string
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from importlib import resources

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

# Short word lists of the rules. Lexicons of names and places are parameters; the defaults lie in data/.
HONORIFICS = frozenset({"mr", "mrs", "ms", "miss", "dr", "prof", "professor", "sir", "madam", "ma'am", "lord", "lady", "fr", "rev", "rabbi"})
ORG_SUFFIXES = frozenset({"inc", "corp", "llc", "co", "ltd", "ag", "gmbh", "sa", "plc", "lp", "llp", "kk"})
AMBIGUOUS = frozenset({"or", "in", "ok", "oh", "hi", "me", "id", "la", "ma", "pa", "co", "dc"})
TOWARDS = frozenset({"in", "to", "from", "near", "at", "via", "through", "around", "outside", "visiting"})
COPULAS = frozenset({"is", "was", "are", "were", "has", "had", "will"})


@functools.cache
def shipped(name: str) -> frozenset[str]:
    """The entries of a list of the package, one a line in lower case."""
    return frozenset(resources.files("velum.operators").joinpath("data", f"{name}.txt").read_text("utf-8").splitlines())


@dataclass
class Lexicon:
    first_names: frozenset[str] = field(default_factory=lambda: shipped("first_names"))
    places: frozenset[str] = field(default_factory=lambda: shipped("places"))
    terms: frozenset[str] = frozenset()


@dataclass
class Word:
    raw: str
    at: int
    surface: str = field(init=False)
    norm: str = field(init=False)

    def __post_init__(self) -> None:
        self.surface = self.raw.lstrip("([\"'").rstrip(string.punctuation.replace("'", ""))
        self.norm = self.surface.lower()

    @property
    def capital(self) -> bool:
        return self.surface[:1].isupper()

    @property
    def placeholder(self) -> bool:
        return re.match(r"\[[A-Z]+_", self.raw) is not None


class _Words:
    """Words of a text, taken apart only when a rule looks at them; most never are."""

    def __init__(self, raw: list[tuple[int, str]]):
        self.raw, self.made = raw, {}

    def __len__(self) -> int:
        return len(self.raw)

    def __getitem__(self, i: int) -> Word:
        if i not in self.made:
            self.made[i] = Word(self.raw[i][1], self.raw[i][0])
        return self.made[i]

    def may_start(self, i: int) -> bool:
        """A capital, or lower case behind an opening mark, or a form of address."""
        word = self.raw[i][1]
        return not word.islower() or word.strip(string.punctuation) in HONORIFICS


Rule = Callable[[_Words, int, Lexicon], tuple[str, int, int] | None]


def _honorific(words: _Words, i: int, lexicon: Lexicon) -> tuple[str, int, int] | None:
    """Up to three capitalised words behind a form of address."""
    if words[i].norm not in HONORIFICS:
        return None
    n = 0
    while n < 3 and i + 1 + n < len(words) and words[i + 1 + n].capital and not words[i + 1 + n].placeholder:
        n += 1
    return ("PERSON", i + 1, i + 1 + n) if n else None


def _person(words: _Words, i: int, lexicon: Lexicon) -> tuple[str, int, int] | None:
    """A capitalised first name and a capitalised word behind it that is no suffix, term or place."""
    if not words[i].capital or words[i].norm not in lexicon.first_names:
        return None
    after = words[i + 1] if i + 1 < len(words) else None
    closed = words[i].raw.rstrip("'\"") != words[i].raw.rstrip(string.punctuation)
    both = after is not None and not closed and after.capital and not after.placeholder and after.surface not in lexicon.terms and after.norm not in ORG_SUFFIXES and after.norm not in lexicon.places
    return "PERSON", i, i + 1 + both


def _two_word_place(words: _Words, i: int, lexicon: Lexicon) -> tuple[str, int, int] | None:
    if i + 1 < len(words) and words[i].capital and words[i + 1].capital and f"{words[i].norm} {words[i + 1].norm}" in lexicon.places:
        return "PLACE", i, i + 2
    return None


def _code_means_place(words: _Words, i: int) -> bool:
    """Whether an ambiguous code stands as a place: behind a word of direction or a comma, or before a verb."""
    if i and (words[i - 1].norm in TOWARDS or words[i - 1].raw.endswith(",")):
        return True
    after = words[i + 1] if i + 1 < len(words) else None
    return not words[i].raw.endswith(",") and after is not None and not after.capital and after.norm in COPULAS


def _place(words: _Words, i: int, lexicon: Lexicon) -> tuple[str, int, int] | None:
    """One capitalised word; codes of three letters or fewer in capitals only; `X, ST` takes the code along."""
    w = words[i]
    if not w.capital or w.norm not in lexicon.places or (len(w.norm) <= 3 and w.surface != w.surface.upper()):
        return None
    if w.norm in AMBIGUOUS and not _code_means_place(words, i):
        return None
    after = words[i + 1] if i + 1 < len(words) else None
    state = w.raw.endswith(",") and after is not None and len(after.norm) == 2 and after.surface == after.surface.upper() and after.norm in lexicon.places
    return "PLACE", i, i + 1 + state


def _organisation(words: _Words, i: int, lexicon: Lexicon) -> tuple[str, int, int] | None:
    if i + 1 < len(words) and words[i].capital and not words[i].placeholder and words[i + 1].norm in ORG_SUFFIXES and words[i + 1].capital:
        return "ORG", i, i + 2
    return None


RULES: tuple[Rule, ...] = (_honorific, _person, _two_word_place, _place, _organisation)


def names_in(text: str, lexicon: Lexicon) -> list[tuple[int, str, str]]:
    """(start, text, kind): from left to right the first rule that fits takes its words; each text once."""
    words = _Words([(m.start(), m[0]) for m in re.finditer(r"\S+", text)])
    out, seen, i = [], set(), 0
    while i < len(words):
        hit = None
        if words.may_start(i) and not words[i].placeholder:
            hit = next((h for rule in RULES if (h := rule(words, i, lexicon))), None)
        if hit is None:
            i += 1
            continue
        kind, a, b = hit
        whole = text[words[a].at : words[b - 1].at + len(words[b - 1].raw)]
        trimmed = whole.strip(string.punctuation.replace("'", "").replace('"', ""))
        if len(trimmed.encode()) >= 2 and trimmed.lower() not in seen and trimmed not in lexicon.terms:
            seen.add(trimmed.lower())
            out.append((words[a].at + max(0, whole.find(trimmed)), trimmed, kind))
        i = b
    return out


def with_names(docs: DataFrame, lexicon: Lexicon | None = None, text: str = "text", out: str = "names", keep: list[str] | None = None) -> DataFrame:
    """`docs` (its columns `keep`, or all) with `out` array<struct<start, text, kind>>; one Arrow pass, no shuffle; lexicons are broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon or Lexicon())
    item = pa.list_(pa.struct([("start", pa.int32()), ("text", pa.string()), ("kind", pa.string())]))
    kept, at = keep or docs.columns, docs.columns.index(text)
    places = [docs.columns.index(c) for c in kept]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"start": s, "text": t, "kind": k} for s, t, k in names_in(x or "", shared.value)] for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in places), pa.array(found, item)], names=[*kept, out])

    return docs.mapInArrow(work, StructType([docs.schema[c] for c in kept]).add(out, ArrayType(StructType().add("start", IntegerType()).add("text", StringType()).add("kind", StringType()))))


def names(docs: DataFrame, lexicon: Lexicon | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, names array<struct<start, text, kind>>) of each row."""
    return with_names(docs.select(id_col, F.col(text).alias("_t")), lexicon, "_t", keep=[id_col])
