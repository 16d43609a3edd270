"""Byte-level BPE: encoding by a priority queue of merge ranks over a linked symbol list, and decoding."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velum.llm.common import map_batches

# Fixed value: the published pattern of byte-level pre-tokenisation.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words whose encoding a worker remembers, in each of two generations, and the longest such word in characters.
REMEMBERED, LONGEST = 200_000, 40


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + n)
    return [letters[b] for b in range(256)]


class Codec:
    """Encoder and decoder of one tokenizer file (a byte-level BPE in the `tokenizers` JSON layout)."""

    def __init__(self, spec: dict):
        model, letters = spec["model"], byte_letters()
        vocab: dict[str, int] = model["vocab"]
        self.byte_ids = [vocab[x] for x in letters]
        self.merges: dict[int, int] = {}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.shift = max(vocab.values()).bit_length()
        mask_bits = self.shift
        for rank, (a, b) in enumerate(pairs):
            self.merges[(vocab[a] << mask_bits) | vocab[b]] = (rank << mask_bits) | vocab[a + b]
        back = {x: b for b, x in enumerate(letters)}
        self.vocabulary: dict[int, bytes] = {i: bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t, i in vocab.items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.vocabulary |= {i: t.encode() for t, i in self.special.items()}
        self.words = regex.compile(PATTERN)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, tuple[str, bytes]] = {}
        self.older: dict[str, tuple[str, bytes]] = {}

    def ids(self, word: bytes) -> list[int]:
        """Token ids of one pre-token.

        Symbols form a doubly linked list; the queue holds (rank, place) of neighbouring pairs as one integer. An
        entry is stale if the symbols at its place no longer merge at its rank; it is then skipped.
        """
        symbols = [self.byte_ids[b] for b in word]
        n = len(symbols)
        if n < 2:
            return symbols
        merges, shift = self.merges, self.shift
        queue = []
        for i in range(n - 1):
            found = merges.get((symbols[i] << shift) | symbols[i + 1])
            if found is not None:
                queue.append((found >> shift) << 32 | i)
        if not queue:
            return symbols
        heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            entry = heappop(queue)
            i = entry & 0xFFFFFFFF
            j = after[i]
            if symbols[i] < 0 or j >= n:
                continue
            found = merges.get((symbols[i] << shift) | symbols[j])
            if found is None or found >> shift != entry >> 32:
                continue
            new = found & ((1 << shift) - 1)
            symbols[i], symbols[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = merges.get((new << shift) | symbols[k])
                if found is not None:
                    heappush(queue, (found >> shift) << 32 | i)
            h = before[i]
            if h >= 0:
                found = merges.get((symbols[h] << shift) | new)
                if found is not None:
                    heappush(queue, (found >> shift) << 32 | h)
        return [s for s in symbols if s >= 0]

    def encode(self, text: str) -> list[int]:
        """Token ids of a whole text; added tokens in it become their own ids."""
        out: list[int] = []
        for part in self.marks.split(text) if self.marks else [text]:
            if part in self.special:
                out.append(self.special[part])
            else:
                for word in self.words.findall(part):
                    out += self.ids(word.encode())
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of token ids: their vocabulary strings one after another."""
        return b"".join(self.vocabulary[i] for i in ids).decode("utf-8", "replace")

    def both(self, word: str) -> tuple[str, bytes]:
        """(decimal ids joined by commas, decoded bytes) of one pre-token; short ones are remembered."""
        found = self.older.get(word)
        if found is None:
            ids = self.ids(word.encode())
            found = ",".join(map(str, ids)), b"".join([self.vocabulary[i] for i in ids])
        if len(word) <= LONGEST:
            if len(self.known) >= REMEMBERED:
                self.older, self.known = self.known, {}
            self.known[word] = found
        return found

    def digest(self, text: str) -> tuple[int, str, str]:
        """(number of ids, digest of the ids joined by commas, digest of the decoded text)."""
        ids: list[str] = []
        back: list[bytes] = []
        known, both = self.known, self.both
        for part in self.marks.split(text) if self.marks else [text]:
            if part in self.special:
                ids.append(str(self.special[part]))
                back.append(self.vocabulary[self.special[part]])
                continue
            for word in self.words.findall(part):
                a, b = known.get(word) or both(word)
                ids.append(a)
                back.append(b)
        joined = ",".join(ids)
        decoded = b"".join(back).decode("utf-8", "replace")
        return joined.count(",") + 1 if joined else 0, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


_codecs: dict[str, Codec] = {}


def _codec(spec_text: str) -> Codec:
    """One codec for each worker process and tokenizer; its memory of words outlives a task."""
    key = hashlib.sha256(spec_text.encode()).hexdigest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(json.loads(spec_text))
    return _codecs[key]


def _with_codec(docs: DataFrame, path: str, text: str, id_col: str, make, kinds: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    with open(path, encoding="utf-8") as f:  # the tokenizer is a local parameter, not an input; its text is broadcast
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(spec.value)
        for batch in batches:
            rows = [make(codec, x) for x in batch.column(1).to_pylist()]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, (_, _, k) in zip(columns, kinds, strict=True))], names=[id_col, *(n for n, _, _ in kinds)])

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    return map_batches(source, work, f"`{id_col}` {kind}, " + ", ".join(f"{n} {k}" for n, k, _ in kinds))


def encode(docs: DataFrame, path: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, ids array<int>) for each row: the tokens of its whole text. Null texts count as empty and have no ids.

    Map only: no shuffle. Rows are independent, so repeated rows, hot sources and extra columns don't matter.
    """
    return _with_codec(docs, path, text, id_col, lambda codec, x: (codec.encode(x),), [("ids", "array<int>", pa.list_(pa.int32()))])


def decode(encoded: DataFrame, path: str, ids: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """(id, text) for each row of ids; null ids count as none and give an empty text."""
    with open(path, encoding="utf-8") as f:
        spec = encoded.sparkSession.sparkContext.broadcast(f.read())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(spec.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([codec.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=[id_col, "text"])

    return map_batches(encoded.select(F.col(id_col), F.col(ids)), work, f"`{id_col}` {encoded.schema[id_col].dataType.simpleString()}, text string")


def digests(docs: DataFrame, path: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) for each row, from encoding its whole text and decoding the ids.

    Same cases as encode(): a null or empty text has no tokens and the digests of the empty string.
    """
    kinds = [("n_tokens", "long", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())]
    return _with_codec(docs, path, text, id_col, lambda codec, x: codec.digest(x), kinds)
