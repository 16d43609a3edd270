import math
import zlib

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tests.llm import brute
from velum.io import table
from velum.llm import langid, quality, queries, toxicity

SF = "/root/testdata/sf0.01"


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    p = y.sum()
    return (rank[y == 1].sum() - p * (p + 1) / 2) / (p * (len(y) - p))


def labels(sf=SF):
    return {d: (q, t) for d, q, t in duckdb.sql(f"SELECT doc_id, quality, toxic FROM '{sf}/labels.parquet'").fetchall()}


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.queries()["op4_toxicity"](spark, sf).collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) for d, r in got.items())
    held = [(t, got[d].score) for d, (_, t) in labels(sf).items() if got[d].held_out]
    assert auc(np.array([t for t, _ in held]), np.array([s for _, s in held])) > 0.88


def test_toxicity_shares_grams_with_misspellings():
    rng = np.random.default_rng(1)
    clean, bad = [f"w{i:03d}" for i in range(60)], ["moronic", "moron", "scumbag", "scum"]
    rows = []
    for i in range(160):
        text = " ".join([*rng.choice(clean, 20), *([rng.choice(bad)] * 3 if i % 2 else [])]).encode()
        rows.append((*toxicity.counted(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0], i % 2))
    model = toxicity.fit(rows)
    score = lambda t: toxicity.scores(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]), *model)[0]
    assert score("w001 w002 w003 morons moronx w004") > score("w001 w002 w003 w005 w006 w004")


def test_rare_toxic_words_count():
    """A word in 10 of 2400 documents, all toxic, is predicted, as is a common one; clean texts and words aren't."""
    rng = np.random.default_rng(5)
    clean = ["".join(rng.choice(list("abcdefghiklmnoprstu"), rng.integers(2, 8))) for _ in range(500)]
    text = lambda *more: " ".join(rng.permutation([*rng.choice(clean, 25), *more]))
    texts = [(text(), 0) for _ in range(2100)] + [(text("vilewurd"), 1) for _ in range(290)] + [(text("zorkblat"), 1) for _ in range(10)]
    rows = [(*toxicity.counted(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0], y) for t, y in texts]
    model = toxicity.fit([rows[i] for i in rng.permutation(len(rows))])
    score = lambda w: np.mean([toxicity.scores(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), *model)[0] >= toxicity.THRESHOLD for t in (text(*w) for _ in range(60))])
    assert score(["vilewurd"]) > 0.95 and score(["zorkblat"]) > 0.8 and score(["vilewurds"]) > 0.8 and score(["vylewurd"]) > 0.5
    assert score([]) < 0.02 and score([clean[3]]) < 0.02


def test_model_operators_on_odd_rows(spark):
    docs = table(spark, SF, "documents")
    rows = [(1, None, "a"), (2, "", "a"), (3, "word " * 60000, "a"), (4, "x", None), (4, "x", None), (None, "y", "b")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, score string")
    label = table(spark, SF, "labels")
    model = toxicity.train(docs, label)
    out = toxicity.score(odd, model).collect()
    assert len(out) == 6 and all(0 <= r.score <= 1 for r in out) and out[0].score == out[1].score and out[3] == out[4]
    assert toxicity.score(odd.limit(0), model).count() == 0
    rated = quality.train(docs, quality.graded(label))
    out = quality.score(odd, rated, carry=("text",)).collect()
    assert len(out) == 6 and all(0 <= r.p_keep <= 1 and 0 <= r.expected_grade <= 2 for r in out) and out[0].p_keep == out[1].p_keep and out[3] == out[4]
    assert quality.score(odd.limit(0), rated).count() == 0
    # Without any label a model still scores.
    assert toxicity.score(odd, toxicity.train(docs, label.limit(0))).count() == 6
    assert quality.score(odd, quality.train(docs, quality.graded(label.limit(0)))).count() == 6


def test_quality_selects(spark):
    got = {r.doc_id: r for r in queries.queries()["op3_quality"](spark, SF).collect()}
    known = labels()
    junk, good = [got[d].kept for d, (q, _) in known.items() if q == 0], [got[d].kept for d, (q, t) in known.items() if q == 1 and not t]
    assert np.mean(junk) < 0.2 and np.mean(good) > 0.99
    grades = lambda keep: np.mean([got[d].expected_grade for d, v in known.items() if keep(v)])
    assert grades(lambda v: v[0] == 0) < grades(lambda v: v == (1, 1)) < grades(lambda v: v == (1, 0))


def test_ordinal_tails_in_order():
    rng = np.random.default_rng(4)
    rows = [(np.array([g, 5]), np.array([8, 2]), g) for g in rng.integers(0, 4, 200)]
    w, cuts = quality.fit(rows, 4)
    assert (np.diff(cuts) > 0).all() and w[0] < w[1] < w[2] < w[3]


MASK = (1 << 64) - 1


def spread(x):
    """The mixing of 64 bits, in plain integers."""
    x = (x ^ x >> 31) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 30


def word_value(word):
    """The hash of a word, byte by byte."""
    odd = 0x9E3779B97F4A7C15
    return spread((sum(spread((b + 1) * odd & MASK) * pow(odd, i, 1 << 64) for i, b in enumerate(word)) + len(word)) & MASK)


def test_quality_equals_plain_scorer(spark):
    """One document at a time, a dictionary of weights, no numpy."""
    w, cuts = quality.train(table(spark, SF, "documents"), quality.graded(table(spark, SF, "labels")))
    weights, top = dict(enumerate(w.tolist())), 64 - quality.BITS
    got = {r.doc_id: r for r in queries.queries()["op3_quality"](spark, SF).collect()}
    for d, text in duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' WHERE doc_id % 7 = 0 OR length(text) > 9000").fetchall():
        raw = (text or "").lower().encode()
        words = [word_value(m) for m in brute.WORD.findall(raw)]
        values = [weights[v >> top] for v in words] + [weights[0] for a, b in zip(words, words[1:]) if a == b]
        marks = [i for i, b in enumerate(raw) if not brute.WORD.match(raw, i, i + 1)]
        values += [weights[spread(raw[i] + (1 << 32)) >> top] for i in marks]
        values += [weights[spread(raw[i] << 8 | raw[i + 1] | 1 << 33) >> top] for i, j in zip(marks, marks[1:]) if j == i + 1]
        z = sum(values) / max(1, len(values))
        tail = [1 / (1 + math.exp(-(z - c))) for c in cuts]
        assert abs(got[d].expected_grade - sum(tail)) < 1e-9 and abs(got[d].p_keep - tail[0]) < 1e-9 and got[d].kept == (tail[0] >= 0.5)


def test_quality_held_out(spark):
    """Fitted on three quarters of the ratings, the rest is told apart."""
    docs, rated = table(spark, SF, "documents"), quality.graded(table(spark, SF, "labels"))
    model = quality.train(docs, rated.where("doc_id % 4 != 1"))
    got = {r.doc_id: r for r in quality.score(docs.where("doc_id % 4 = 1"), model).collect()}
    held = [(q, got[d]) for d, (q, _) in labels().items() if d % 4 == 1]
    assert len(held) > 50 and auc(np.array([q for q, _ in held]), np.array([r.p_keep for _, r in held])) > 0.97
    assert np.mean([r.kept for q, r in held if q == 1]) > 0.97 and np.mean([r.kept for q, r in held if q == 0]) < 0.25


def test_toxicity_equals_plain_scorer(spark):
    """One document at a time, a dictionary of bucket values, no numpy."""
    value, bias = toxicity.train(table(spark, SF, "documents"), table(spark, SF, "labels"))
    values, top = dict(enumerate(value.astype(np.float32).tolist())), 64 - toxicity.BITS
    got = {r.doc_id: r for r in queries.queries()["op4_toxicity"](spark, SF).collect()}
    for d, text in duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' WHERE doc_id % 9 = 0").fetchall():
        found = []
        for word in brute.WORD.findall((text or "").lower().encode()):
            found.append(values[word_value(word) >> top])
            framed = b" " + word + b" "
            for k in toxicity.GRAMS:
                for i in range(len(framed) - k + 1):
                    packed = int.from_bytes(framed[i : i + k], "little") ^ (k * 0x9E3779B97F4A7C15 & MASK)
                    found.append(values[spread(packed) >> top])
        score = 1 / (1 + math.exp(-(sum(found) / max(1, len(found)) + bias)))
        assert abs(got[d].score - score) < 1e-6 and got[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2)


def test_language_of_held_out_texts(spark):
    """Texts alone: pages without address and declaration, made of documents that were not counted."""
    docs = table(spark, SF, "documents")
    held = docs.where("doc_id % 4 = 1 AND n_chars > 60 AND lang IS NOT NULL")
    pages = held.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.concat(F.lit("<p>"), "text").alias("html"))
    got = {r.page_id: r.text_lang for r in langid.identify(pages, langid.train(docs.where("doc_id % 4 != 1"))).collect()}
    want = {r.doc_id: r.lang for r in held.select("doc_id", "lang").collect()}
    assert len(want) > 100 and np.mean([got[d] == lang for d, lang in want.items()]) > 0.97


def test_language_fusion(spark):
    """With the declarations of half of the pages withheld, their languages still come out."""
    pages = table(spark, SF, "pages")
    said = {r.page_id: r.declared for r in queries.queries()["op10_language_id"](spark, SF).collect()}
    bare = pages.withColumn("html", F.when(F.col("page_id") % 2 == 0, F.regexp_replace("html", r"(?i)(<html\b[^>]*?)\slang\s*=\s*[\"']?[A-Za-z]+[\"']?", "$1")).otherwise(F.col("html")))
    got = langid.identify(bare, langid.train(table(spark, SF, "documents"))).collect()
    withheld = [r for r in got if r.page_id % 2 == 0]
    assert len(got) == 250 and all(r.declared == "" for r in withheld)
    assert np.mean([r.lang == said[r.page_id] for r in withheld]) > 0.95


def test_language_equals_brute_force_and_odd_rows(spark):
    docs = table(spark, SF, "documents")
    names, likely = model = langid.train(docs)
    texts = dict(duckdb.sql(f"SELECT lang, min(text) FROM '{SF}/documents.parquet' WHERE n_chars > 400 GROUP BY 1").fetchall())
    rows = []
    for i in range(24):
        lang = names[i % len(names)]
        html = f'<html lang="{lang if i % 5 else "xx"}"><style>p</style><p>{texts[lang][: 20 * i]}</p>'
        rows.append((i, f"https://h{i % 3}.site.example.{'com' if i % 2 else 'org'}/{lang if i % 4 else 'zz'}/a", html))
    rows += [(100, None, None), (101, "", ""), (102, "not a url", "<p>"), (102, "not a url", "<p>")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, lang string")
    got = sorted(langid.identify(pages, model).collect(), key=lambda r: r.page_id)
    assert len(got) == len(rows) and langid.identify(pages.limit(0), model).count() == 0

    def evidence(html):
        raw = langid.visible((html or "").encode()).lower()
        block = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
        buckets = np.concatenate([b for b, _ in langid.grams(*block)])
        z = likely[buckets].astype(float).sum(0) * (min(len(buckets), langid.EVIDENCE) / max(1, len(buckets)))
        p = np.exp(z - z.max())
        return z, p / p.sum()

    seen = []
    for i, url, html in rows:
        host = langid.re.match(r"https://([^/]*)", url or "")
        host = host[1] if host else ""
        path = langid.re.match(r"https://[^/]*/([a-z]{2})/", url or "")
        said = langid.re.search('lang="([a-z]+)"', html or "")
        said = said[1] if said else ""
        seen.append((i, host, ".".join(host.split(".")[-2:]), host.split(".")[-1] + "/" + (path[1] if path else ""), said if said in (*names, "") else "?", *evidence(html)))
    total = sum(s[6] for s in seen)
    prior = (total + 1) / (total.sum() + len(names))
    group = lambda k, v: sum(s[6] for s in seen if s[k] == v)
    for s, r in zip(sorted(seen, key=lambda s: s[0]), got, strict=True):
        domain = (np.maximum(group(2, s[2]) - s[6], 0) + langid.DOMAIN_PSEUDO * prior) / (group(2, s[2]).sum() - 1 + langid.DOMAIN_PSEUDO)
        host = (np.maximum(group(1, s[1]) - s[6], 0) + langid.HOST_PSEUDO * domain) / (group(1, s[1]).sum() - 1 + langid.HOST_PSEUDO)
        suffix = (np.maximum(group(3, s[3]) - s[6], 0) + langid.CELL_PSEUDO * prior) / (total + langid.CELL_PSEUDO)
        declared = (group(4, s[4]) + langid.CELL_PSEUDO) / (total + langid.CELL_PSEUDO * (len(names) + 2))
        score = s[5] + np.log(host) + np.log(suffix) + np.log(declared)
        assert r.lang == names[score.argmax()] and abs(r.confidence - 1 / np.exp(score - score.max()).sum()) < 1e-6


def test_bounded_sample(spark):
    from velum.llm.samples import bounded

    ids = spark.range(20000).withColumnRenamed("id", "doc_id")
    got = {r.doc_id for r in bounded(ids, "doc_id", 900).collect()}
    assert 600 < len(got) <= 900 and got == {r.doc_id for r in bounded(ids.repartition(7), "doc_id", 900).collect()}
    assert bounded(ids, "doc_id", 20000).count() == 20000 and bounded(ids.limit(0), "doc_id", 5).count() == 0
