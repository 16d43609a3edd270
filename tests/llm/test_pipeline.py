import hashlib
import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import brute
from velum.llm import decontaminate, jaccard, quality


def test_near_duplicates_by_row(spark, tmp_path):
    """Null and repeated ids: each row is judged by its own text; only rows equal in all columns fall together."""
    a, b, c, d = (" ".join(f"{w}{i}" for i in range(40)) for w in "abcd")
    rows = [(None, a, "en"), (None, b, "en"), (None, a, "en"), (1, a, "en"), (1, b, "en"), (2, a + " end", "en"), (2, c, "en"), (3, d, "en"), (3, d, "en"), (3, d, None), (3, d + " end", "en"), (4, c, "en"), (5, None, "en"), (5, "", "en"), (None, None, None)]
    docs = spark.createDataFrame([(i, t, lang, None, None) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicate_stage(spark, docs, str(tmp_path)).collect()
    # Of d and d + " end", both of id 3, one text stays.
    end = [r for r in got if r.doc_id == 3]
    assert {(r.text, r.lang) for r in end} in ({(d, "en"), (d, None)}, {(d + " end", "en")}) and len(end) in (1, 2)
    want = [(None, a, "en"), (None, b, "en"), (1, a, "en"), (1, b, "en"), (2, c, "en"), (5, None, "en"), (5, "", "en"), (None, None, None)]
    assert sorted(((r.doc_id, r.text, r.lang) for r in got if r.doc_id != 3), key=repr) == sorted(want, key=repr)
    texts = [(i, t) for i, t, _ in rows]
    joined = jaccard.join(docs).collect()
    assert sorted(map(tuple, joined), key=repr) == brute.jaccard(texts, 5, 0.8)


def test_pipeline_equals_brute_force(spark, tmp_path):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghiklmnoprstué") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, prose(25)) for i in range(4)]
    passage, shorter = prose(110), prose(56)
    docs = [(i, prose(rng.randrange(30, 120))) for i in range(50)]
    docs += [(60 + i, docs[i][1]) for i in range(4)] + [(70 + i, docs[10 + i][1] + " tail") for i in range(4)]
    docs += [(80 + i, prose(15) + " " + passage + " " + prose(15)) for i in range(4)]
    docs += [(84 + i, prose(20) + " " + shorter + ". " + prose(20)) for i in range(3)]
    docs += [(90 + i, prose(10) + " " + items[i][1] + " " + prose(10)) for i in range(4)]
    docs += [(100 + i, "| " * 8 + "x | y | x x x x x x x x | " * rng.randrange(8, 20)) for i in range(8)] + [(120, None), (121, "")]
    labels = [(d, 0 if 100 <= d < 110 else 1, 0) for d, _ in docs]
    rows = [(d, t, "en", "src", len(t or "")) for d, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()))

    stored = spark.read.parquet(f"{tmp_path}/documents.parquet")
    w, cuts = quality.train(stored, quality.graded(spark.read.parquet(f"{tmp_path}/labels.parquet")))
    left = []
    for d, t in docs:
        raw = (t or "").lower().encode()
        if quality.tails(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), w, cuts)[0, 0] >= quality.KEEP_PROBABILITY:
            left.append((d, t))
    assert not {d for d, _ in left} & set(range(100, 110)) and len(left) >= 65
    kept = {d for d, _, _, keep in brute.jaccard(left, 5, 0.8) if keep}
    left = [(d, t) for d, t in left if d in kept]
    cut = []
    for (d, t), (_, _, gone, _, _, mask) in zip(left, brute.strings(left, corpus_pipeline.PASSAGE_BYTES), strict=True):
        raw, out, piece = (t or "").encode(), "", bytearray()
        mask = brute.worded(raw, mask, corpus_pipeline.PASSAGE_WORDS)
        gone = any(mask)
        for byte, m in zip(raw, mask, strict=True):
            if m:
                out, piece = out + piece.decode("utf-8", "ignore"), bytearray()
            else:
                piece.append(byte)
        out += piece.decode("utf-8", "ignore")
        if out or not gone:
            cut.append((d, out))
    leaks = brute.leaks(cut, items, decontaminate.RATE, decontaminate.SEGMENT, decontaminate.STRIDE, decontaminate.LEAST)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for d, t in cut:
        if not leaks[d]:
            ids = library.encode(t, add_special_tokens=False).ids
            want.append((d, len(ids), sha(",".join(map(str, ids))), sha(t)))
    assert got == sorted(want) and 40 < len(want) < 60
    columns = [f.name for f in spark.read.parquet(f"{tmp_path}/documents.parquet").schema]
    step = corpus_pipeline.STAGES[2][1](spark, stored.where(F.col("doc_id") < 87), str(tmp_path))
    assert step.columns == columns
    after = {r.doc_id: r.text for r in step.collect()}
    assert all(shorter[5:-5] not in after[84 + i] and after[84 + i] for i in range(3))
