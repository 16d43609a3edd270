"""SentencePiece BPE: encoding by vectorised merge rounds over flat symbol arrays, and decoding.

White space becomes U+2581 and a text gets one in front; then, all over the text, the neighbouring symbols whose joined
string is the best piece merge, the leftmost first, until none do. No piece holds white space
after another character, so words don't touch each other's merges, and distinct words are encoded once, many at a time.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velum.llm.common import map_batches

SPACE = "▁"
#: Words and ids beyond which a worker forgets the words that it has encoded.
REMEMBERED, REMEMBERED_IDS = 300_000, 4_000_000
#: Characters of distinct words that take part in the same merge rounds.
ROUND_CHARS = 1 << 19
# Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
_NEVER = np.int64(1 << 40)


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of one protocol buffer message; nested messages and strings come as bytes."""

    def number(at: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            out |= (data[at] & 127) << shift
            shift += 7
            at += 1
            if data[at - 1] < 128:
                return out, at

    at = 0
    while at < len(data):
        tag, at = number(at)
        if tag & 7 == 0:
            value, at = number(at)
            yield tag >> 3, value
        else:
            size, at = number(at) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], at)
            yield tag >> 3, data[at : at + size]
            at += size


class Model:
    """The tables of a BPE model file that the rounds need.

    Taken are models without a character map that keep extra white space, with byte pieces and without pieces given by
    a user; any other is an error.
    """

    def __init__(self, data: bytes):
        pieces: list[tuple[str, float, int]] = []
        settings: dict[int, dict] = {2: {}, 3: {}}
        for n, value in fields(data):
            if n == 1:
                own = dict(fields(value))
                pieces.append((own.get(1, b"").decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
            elif n in settings:
                settings[n] = dict(fields(value))
        trainer, normalizer = settings[2], settings[3]
        known = {kind for _, _, kind in pieces} <= {NORMAL, UNKNOWN, CONTROL, BYTE}
        if trainer.get(3, 1) != 2 or not known or normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(3, 1) or not normalizer.get(5, 1) or not trainer.get(35, 0):
            raise ValueError("not a BPE model with byte pieces, plain characters and kept white space")
        self.text = [p.replace(SPACE, " ").encode() if kind == NORMAL else b"" if kind == CONTROL else b" \xe2\x81\x87 " for p, _, kind in pieces]
        self.bytes = np.zeros(256, np.int64)
        self.is_byte = np.zeros(len(pieces), bool)
        for i, (p, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.bytes[int(p[3:5], 16)], self.is_byte[i] = i, True
                self.text[i] = bytes([int(p[3:5], 16)])
        normal = {p: (score, i) for i, (p, score, kind) in enumerate(pieces) if kind == NORMAL}
        order = {score: rank for rank, score in enumerate(sorted({s for s, _ in normal.values()}, reverse=True))}
        rank = {p: order[s] for p, (s, _) in normal.items()}
        if any(SPACE in p.lstrip(SPACE) or (p.startswith(2 * SPACE) and p.strip(SPACE)) for p in normal):
            raise ValueError("pieces that reach over white space")
        # Pieces of white space alone merge after all others, and among themselves from left to right (blank_run()).
        self.blanks = {len(p): i for p, (_, i) in normal.items() if not p.strip(SPACE)}
        blank = {p for p in normal if not p.strip(SPACE)}
        longer = [rank[p] for p in blank if len(p) > 1]
        if longer and (len(set(longer)) > 1 or longer[0] <= max(r for p, r in rank.items() if p not in blank)):
            raise ValueError("pieces of white space that rank among the others")
        # Symbols: pieces by id; characters that are no piece by len(pieces) + code point.
        self.size = len(pieces)
        symbol = lambda p: normal[p][1] if p in normal else self.size + ord(p)
        chars = sorted({c for p in normal for c in p} | {SPACE})
        self.char_codes = np.array([ord(c) for c in chars], np.int64)
        self.char_symbols = np.array([symbol(c) for c in chars], np.int64)
        is_symbol = lambda p: len(p) == 1 or p in normal
        splits = [(p[:k], p[k:], p) for p in normal if p not in blank for k in range(1, len(p)) if is_symbol(p[:k]) and is_symbol(p[k:])]
        keys = np.array([(symbol(a) << 32) | symbol(b) for a, b, _ in splits], np.int64)
        by = np.argsort(keys)
        self.pair_keys = np.append(keys[by], np.iinfo(np.int64).max)
        self.pair_ranks = np.append(np.array([rank[p] for _, _, p in splits], np.int64)[by], _NEVER)
        self.pair_merged = np.append(np.array([normal[p][1] for _, _, p in splits], np.int64)[by], -1)
        # A piece is hasty if a piece that it is a part of ranks no later: then its next merge may come before that of
        # an equal pair further right.
        self.hasty = np.zeros(self.size, bool)
        for a, b, p in splits:
            for part in (a, b):
                if part in normal and len(part) > 1 and rank[p] <= rank[part]:
                    self.hasty[normal[part][1]] = True
        self.reach = 2 * max(map(len, normal), default=1) + 2
        grams = {(ord(a) << 21) | ord(b) for p in normal if p not in blank for a, b in zip(p, p[1:], strict=False)}
        self.grams = np.array(sorted(grams) or [-1], np.int64)
        self.runs: dict[int, list[int]] = {}

    def blank_run(self, n: int) -> list[int]:
        """Ids of `n` white-space symbols in a row: equal ranks, so always the leftmost pair that makes a piece."""
        found = self.runs.get(n)
        if found is None:
            sizes: list[int] = []
            for _ in range(n):
                sizes.append(1)
                while len(sizes) > 1 and sizes[-2] + sizes[-1] in self.blanks:
                    last = sizes.pop()
                    sizes[-1] += last
            found = [self.blanks[s] for s in sizes] if 1 in self.blanks else []
            if len(self.runs) < 1000:
                self.runs[n] = found
        return found

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of pairs of symbols; the rank is _NEVER where they make no piece."""
        key = (left << np.int64(32)) | right
        at = np.searchsorted(self.pair_keys, key)
        same = self.pair_keys[at] == key
        return np.where(same, self.pair_ranks[at], _NEVER), self.pair_merged[at]

    def merge(self, words: list[str], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, end of each word in them) after all merges but those of white space alone; `ends` counts characters.

        Symbols of all words lie in one array, cut where no piece holds the two characters in a row. In a round every
        segment merges all places of its best pair, of overlapping ones the leftmost; a hasty piece only the leftmost
        of places so near that what follows at one could reach the other. Segments without a pair leave the arrays.
        """
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        n = len(codes)
        at = np.minimum(np.searchsorted(self.char_codes, codes), len(self.char_codes) - 1)
        symbols = np.where(self.char_codes[at] == codes, self.char_symbols[at], self.size + codes)
        gram = (codes[:-1] << np.int64(21)) | codes[1:]
        near = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        begins = np.ones(n, bool)
        begins[1:] = self.grams[near] != gram
        inner = ends[:-1]
        begins[inner[inner < n]] = True
        place = np.arange(n)
        final, alive = symbols.copy(), np.ones(n, bool)
        segment = np.cumsum(begins) - 1
        ranks, merged = np.full(n, _NEVER), np.full(n, -1, np.int64)
        if n > 1:
            inside = np.flatnonzero(segment[1:] == segment[:-1])
            ranks[inside], merged[inside] = self.pairs(symbols[inside], symbols[inside + 1])
        while len(symbols):
            starts = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
            best = np.minimum.reduceat(ranks, starts)
            sizes = np.diff(np.append(starts, len(symbols)))
            if (best == _NEVER).any():
                done = np.repeat(best == _NEVER, sizes)
                final[place[done]] = symbols[done]
                symbols, segment, place, ranks, merged = (x[~done] for x in (symbols, segment, place, ranks, merged))
                if not len(symbols):
                    break
                best, sizes = best[best < _NEVER], sizes[best < _NEVER]
            chosen = np.flatnonzero(ranks == np.repeat(best, sizes))
            first = np.concatenate([[True], np.diff(chosen) > 1])
            chosen = chosen[(np.arange(len(chosen)) - np.flatnonzero(first)[np.cumsum(first) - 1]) % 2 == 0]
            alone = np.concatenate([[True], (np.diff(chosen) > self.reach) | (np.diff(segment[chosen]) > 0)])
            chosen = chosen[alone | ~self.hasty[merged[chosen]]]
            symbols[chosen] = merged[chosen]
            keep = np.ones(len(symbols), bool)
            keep[chosen + 1] = False
            alive[place[~keep]] = False
            now = (np.cumsum(keep) - 1)[chosen]
            symbols, segment, place, ranks, merged = (x[keep] for x in (symbols, segment, place, ranks, merged))
            for touched in (now, now[now > 0] - 1):
                ranks[touched] = _NEVER
                touched = touched[touched < len(symbols) - 1]
                touched = touched[segment[touched] == segment[touched + 1]]
                ranks[touched], merged[touched] = self.pairs(symbols[touched], symbols[touched + 1])
        return final[alive], np.cumsum(alive)[ends - 1] if n else ends

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, end of each word in them); a word is white space and what follows it."""
        parts, sizes, i = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        upto = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])
        while i < len(words):
            j = max(i + 1, int(np.searchsorted(upto, upto[i] + ROUND_CHARS, "right")) - 1)
            symbols, ends = self.merge(words[i:j], upto[i + 1 : j + 1] - upto[i])
            begins = np.concatenate([[0], ends[:-1]])
            blank = self.blanks.get(1, -1)
            more = np.flatnonzero((ends - begins > 1) & (symbols[begins] == blank) & (symbols[np.minimum(begins + 1, len(symbols) - 1)] == blank))
            if len(more):
                symbols, ends = self._with_runs(symbols, begins, ends, more, blank)
            odd = np.flatnonzero(symbols >= self.size)
            if len(odd):
                symbols, ends = self._with_bytes(symbols, ends, odd)
            parts.append(symbols)
            sizes.append(np.diff(ends, prepend=0))
            i = j
        return np.concatenate(parts), np.cumsum(np.concatenate(sizes))

    def _with_runs(self, symbols: np.ndarray, begins: np.ndarray, ends: np.ndarray, some: np.ndarray, blank: int) -> tuple[np.ndarray, np.ndarray]:
        """White space at the start of `some` words made into pieces."""
        out, sizes, last = [], ends - begins, 0
        for k in some.tolist():
            a, b = begins[k], ends[k]
            other = np.flatnonzero(symbols[a:b] != blank)
            run = int(other[0]) if len(other) else int(b - a)
            made = self.blank_run(run)
            out += [symbols[last:a], np.array(made, np.int64)]
            last = a + run
            sizes[k] += len(made) - run
        return np.concatenate([*out, symbols[last:]]), np.cumsum(sizes)

    def _with_bytes(self, symbols: np.ndarray, ends: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters that are no piece (at `odd`) made into the byte pieces of their UTF-8 form."""
        size = np.ones(len(symbols), np.int64)
        code = symbols[odd] - self.size
        size[odd] = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        at = np.concatenate([[0], np.cumsum(size)])
        out = np.repeat(symbols, size)
        for n, lead in ((1, 0), (2, 0xC0), (3, 0xE0), (4, 0xF0)):
            some = size[odd] == n
            for k in range(n):
                rest = code[some] >> (6 * (n - 1 - k))
                out[at[odd[some]] + k] = self.bytes[(lead | rest) if k == 0 else (0x80 | (rest & 63))]
        return out, at[ends]

    def decode_own(self, ids: list[int]) -> bytes:
        """decode() in UTF-8 for ids that encoding gave: whole characters, with white space in front."""
        return b"".join(map(self.text.__getitem__, ids))[1:]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: their strings in a row, without the white space that was put in front.

        Bytes that make no character become U+FFFD one by one; control ids have no text.
        """
        parts: list[bytes] = []
        run: list[int] = []
        first = True
        for i in [*ids, -1]:
            if i >= 0 and self.is_byte[i]:
                run.append(i)
                continue
            if run:
                raw = b"".join(self.text[b] for b in run)
                parts.append("".join(_characters(raw)).encode())
                run, first = [], False
            if i >= 0:
                text = self.text[i]
                if first and text[:1] == b" " and text != b" \xe2\x81\x87 ":
                    text, first = text[1:], False
                first = first and not text
                parts.append(text)
        return b"".join(parts).decode()


def _characters(raw: bytes) -> Iterator[str]:
    """The characters of bytes, U+FFFD for each byte that is part of none."""
    at = 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                yield raw[at : at + size].decode()
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            yield "�"
            at += 1


_word = re.compile(f"{SPACE}+[^{SPACE}]*")


def words_of(text: str) -> list[str]:
    """The words of a text, each with the white-space symbols in front of it."""
    if not text:
        return []
    parts = text.replace(SPACE, " ").split(" ")
    if "" in parts:  # white space in a row or at an end
        return _word.findall(SPACE + text.replace(" ", SPACE))
    return [SPACE + w for w in parts]


class Codec:
    """A model with its memory of words: the ids of all of them in one array, and the place of each word in it."""

    def __init__(self, data: bytes):
        self.model = Model(data)
        self.numerals = [str(i) for i in range(self.model.size)]
        self.forget()

    def forget(self) -> None:
        """Start with an empty memory."""
        self.places: dict[str, int] = {}
        self.ids, self.ends = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text."""
        split = [words_of(t) for t in texts]
        if len(self.places) > REMEMBERED or len(self.ids) > REMEMBERED_IDS:
            self.forget()
        new = list(set().union(*split).difference(self.places))
        if new:
            ids, ends = self.model.encode_words(new)
            self.places.update(zip(new, range(len(self.ends), len(self.ends) + len(new)), strict=True))
            self.ends = np.concatenate([self.ends, ends + len(self.ids)])
            self.ids = np.concatenate([self.ids, ids])
        begins = np.concatenate([[0], self.ends[:-1]])
        for words in split:
            word = np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))
            size = self.ends[word] - begins[word]
            upto = np.cumsum(size)
            yield self.ids[np.repeat(begins[word] - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)]

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """(number of ids, digest of the ids joined by commas, digest of the decoded text) of each text."""
        for ids in self.encode(texts):
            own = ids.tolist()
            joined = ",".join(map(self.numerals.__getitem__, own))
            yield len(own), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(self.model.decode_own(own)).hexdigest()


_codecs: dict[str, Codec] = {}


def _codec(data: bytes) -> Codec:
    """One codec for each worker process and model; its memory of words outlives a task."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(data)
    return _codecs[key]


def _batched(df: DataFrame, path: str, id_col: str, make, kinds: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    with open(path, "rb") as f:  # the model is a local parameter, not an input; its bytes are broadcast
        data = df.sparkSession.sparkContext.broadcast(f.read())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(data.value)
        for batch in batches:
            columns = list(zip(*make(codec, batch.column(1).to_pylist()), strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, (_, _, k) in zip(columns, kinds, strict=True))], names=[id_col, *(n for n, _, _ in kinds)])

    return map_batches(df, work, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{n} {k}" for n, k, _ in kinds))


def _texts(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    return docs.select(F.col(id_col), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))


def encode(docs: DataFrame, path: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, ids array<int>) for each row: the ids of its whole text by the model file at `path`, without begin or end.

    Null and empty texts have no ids. Map only: rows are independent, so null ids, repeated rows, hot sources and extra
    columns don't matter, and an empty table gives an empty table. The rounds over one word of n characters that
    nothing cuts take up to as many steps as it has distinct pieces, each over its symbols.
    """
    return _batched(_texts(docs, text, id_col), path, id_col, lambda codec, texts: ((ids.astype(np.int32),) for ids in codec.encode(texts)), [("ids", "array<int>", pa.list_(pa.int32()))])


def decode(encoded: DataFrame, path: str, ids: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """(id, text) for each row of ids; null ids count as none and give an empty text."""
    source = encoded.select(F.col(id_col), F.col(ids).alias("_ids"))
    return _batched(source, path, id_col, lambda codec, rows: ((codec.model.decode(x or []),) for x in rows), [("text", "string", pa.string())])


def digests(docs: DataFrame, path: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) for each row, from encoding its whole text and decoding the ids.

    Same cases as encode(): a null or empty text has no ids and the digests of the empty string.
    """
    kinds = [("n_tokens", "long", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())]
    return _batched(_texts(docs, text, id_col), path, id_col, lambda codec, texts: codec.digests(texts), kinds)
