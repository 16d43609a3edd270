import hashlib
import json
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from velum.llm import bpe, chat, license_scan

FILE = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "Released under the MIT License.", "UNDER THE MIT LICENSE under the mit license", "mit license",
    "Licensed under the Apache License, Version 2.0.", "apache license version 2 cc by nc cc by nc", "Cc-By_Nc été 4.0",
    "licensed under a creative commons attribution share alike 4 0 international license", "x " * 30000 + "under the mit license",
    "copyright (c) 2020 some one here all rights reserved", "licensed under apache license", "ÀÉ under the mit license",
]


def test_license_places_and_labels(spark):
    rows = [(i, t, "clash", 1.0) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "clash", 1.0), (None, TEXTS[3], None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string, score double")
    got = license_scan.scan(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, text in enumerate(TEXTS):
        w = license_scan.re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        places = [k for p, _ in license_scan.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        labels = sorted({label for p, label in license_scan.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split()})
        r = by[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(labels))
        assert set(labels) <= set(r.labels.split(",")) or not labels
        assert 0 <= r.score <= 1
    assert "mit-notice" in by[3].labels and "mit-notice" in by[None].labels
    assert "cc-by-notice" in by[9].labels and "copyright-holder" in by[11].labels and by[12].labels == ""
    assert license_scan.scan(docs.limit(0)).count() == 0


def test_automaton_regions():
    a = license_scan.Automaton("x", "a <<beginOptional>>b <<beginOptional>>c <<endOptional>><<endOptional>>d <<var;words=2>> e")
    accepts = lambda s: a.match(s.encode().split(), 0) == len(s.split())
    assert all(map(accepts, ["a d e", "a b d e", "a b c d e", "a d x e", "a d x y e", "a b c d e e"]))
    assert not any(map(accepts, ["a c d e", "a d x y z e", "a b c e", "d e", "a d"]))


def fuzz(n, seed=5):
    rng = random.Random(seed)
    alphabet = "ab  \n\t'sté日🙂0_-.<|endoftext|>  \x00"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(n)] + ["<|endoftext|>a<|endoftext|>", "z" * 6000, "don't we'll", None, ""]


def test_bpe_equals_library(spark):
    texts = fuzz(150)
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    library = Tokenizer.from_file(FILE)
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    encoded = bpe.encode(docs, FILE)
    assert {r.doc_id: r.ids for r in encoded.collect()} == want
    back = {r.doc_id: r.text for r in bpe.decode(encoded, FILE).collect()}
    assert back == {i: library.decode(ids, skip_special_tokens=False) for i, ids in want.items()} == {i: t or "" for i, t in enumerate(texts)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs, FILE).collect()}
    assert got == {i: (len(ids), sha(",".join(map(str, ids))), sha(texts[i] or "")) for i, ids in want.items()}
    assert bpe.digests(docs.limit(0), FILE).count() == 0 and bpe.encode(docs.limit(0), FILE).count() == 0


def test_bpe_query_equals_library(spark):
    """Every document of the table, against the library."""
    import duckdb

    from velum.llm import queries

    sf = "/root/testdata/sf0.01"
    library = Tokenizer.from_file(FILE)
    library.no_truncation()
    library.no_padding()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.doc_id: r for r in queries.queries()["op9_bpe"](spark, sf).collect()}
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    assert len(got) == len(docs)
    for d, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert (got[d].n_tokens, got[d].ids_sha256) == (len(ids), sha(",".join(map(str, ids))))
        assert got[d].decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))


def test_bpe_queue_equals_plain_merging():
    codec = bpe.Codec(json.load(open(FILE)))
    rng = random.Random(2)
    for _ in range(300):
        word = bytes(rng.choice(b"theranio ") for _ in range(rng.randrange(1, 40)))
        symbols = [codec.byte_ids[b] for b in word]
        while True:
            ranked = [(codec.merges[k] >> codec.shift, i) for i in range(len(symbols) - 1) if (k := symbols[i] << codec.shift | symbols[i + 1]) in codec.merges]
            if not ranked:
                break
            _, i = min(ranked)
            symbols[i : i + 2] = [codec.merges[symbols[i] << codec.shift | symbols[i + 1]] & ((1 << codec.shift) - 1)]
        assert codec.ids(word) == symbols


CONTROL = ["<|im_start|>", "<|im_end|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<\\|im_end|>", "<\\\\</s>", "\n", "a\\", "<", "[", "$1", ""]


def test_chat_round_trip(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "a\\n\nb"]), None if rng.random() < 0.1 else "".join(rng.choice(CONTROL) for _ in range(rng.randrange(8)))) for c in range(40) for t in range(rng.randrange(1, 7))]
    rows += [(1, 0, "user", "same"), (1, 0, "user", "same"), (None, 0, "assistant", "x"), (99, None, "user", "no turn"), (98, 0, "assistant", "é🙂" * 3000)]
    table = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, seq string")
    got = chat.read_back(chat.render(chat.fold(chat.log_of(table, chunk=7)))).collect()
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert {r.conv_id: [(t.role, t.text) for t in r.turns] for r in got} == want
    assert {r.conv_id: r.learned for r in got} == {c: [x for role, x in turns if role == "assistant"] for c, turns in want.items()}
    assert chat.render(chat.fold(chat.log_of(table.limit(0)))).count() == 0


def test_chat_fold_of_events(spark):
    log = [
        (1, 0, 1, 0, "message", "hello", "user"), (1, 1, 1, 0, "open", None, "assistant"), (1, 1, 1, 1, "delta", "wro", None), (1, 1, 1, 3, "delta", "right", None),
        (1, 1, 1, 2, "regenerate", None, None), (1, 1, 1, 4, "delta", "!", None), (1, 2, 1, 0, "message", "a", "user"), (1, 2, 1, 1, "edit", "b", "user"), (1, 2, 1, 2, "ping", "z", "user"),
    ]
    random.Random(1).shuffle(log)
    got = chat.fold(spark.createDataFrame(log, "conv_id long, turn long, part int, seq long, kind string, text string, role string")).orderBy("turn").collect()
    assert [(r.role, r.text) for r in got] == [("user", "hello"), ("assistant", "right!"), ("user", "b")]


def test_chat_runs_without_python(spark):
    from velum.llm import queries

    plan = queries.queries()["op6_chat_format"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("name", ["op1_license_scan", "op2_embedding_dedup", "op5_jaccard_join", "op6_chat_format", "op8_repeated_strings"])
def test_queries_equal_sql(spark, name):
    import duckdb

    from velum.llm import queries

    db = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    want = db.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, "/root/testdata/sf0.001").select(*(F.col(c) for c in want.columns)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))
