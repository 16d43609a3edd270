"""Stems, and rank by cover density against a version that looks at every run of words."""

import random

import pytest

from velum.operators import fulltext
from velum.operators.stems import STOP, stem

# Words and stems as published with the rules.
KNOWN = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency
consist consistent consist consistently consist consolation consol consolatory consolatori consoled consol consolidate consolid
consolidating consolid consolingly consol conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir
conspired conspir constable constabl constancy constanc knackeries knackeri knavish knavish kneaded knead knightly knight knitted
knit knives knive knocker knocker knots knot generously generous generate generat general general cries cri ties tie gas gas say
say by by enjoy enjoy agreed agre feed feed fluently fluentli hopping hop hoping hope skis ski skies sky dying die news news
proceed proceed inning inning happy happi relational relat adoption adopt controller control hopefulness hope rate rate""".split()


def test_known_stems():
    assert {w: stem(w) for w in KNOWN[::2]} == dict(zip(KNOWN[::2], KNOWN[1::2], strict=True))
    assert len(STOP) == 127 and all(stem(w) for w in ("a", "is", "y", "yes", "youth", "sss", "ing", "eed", "s3", "0"))


def brute(query, docs, limit):
    words = lambda t: ["" if w in STOP else stem(w) for w in fulltext._word.findall((t or "").lower())]
    asked = {w for w in words(query) if w}
    scored = []
    for i, text in docs:
        w = words(text)
        places = [p for p, x in enumerate(w) if x in asked]
        if not asked or {w[p] for p in places} != asked:
            continue
        score = 0.0
        for a, p in enumerate(places):
            for b in range(a, len(places)):
                run = {w[x] for x in places[a : b + 1]}
                if run == asked:
                    if {w[x] for x in places[a + 1 : b + 1]} != asked:  # no shorter run inside
                        score += 0.1 / (1 + (places[b] - p) - (b - a))
                    break
        scored.append((-round(score, 9), i, score))
    return [(i, round(s, 9), n + 1) for n, (_, i, s) in enumerate(sorted(scored)[:limit])]


@pytest.mark.parametrize("most", [2000, 2])
def test_cover_density(spark, monkeypatch, most):
    monkeypatch.setattr(fulltext, "MOST_ASKED", most)
    rng = random.Random(3)
    words = ["license", "licensed", "licensing", "work", "works", "the", "of", "free", "running", "runs", "x1"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(30)))) for i in range(80)] + [(90, None), (91, ""), (92, "LICENSE, works!"), (93, "work " * 90 + "license")]
    queries = [(1, "licenses at work"), (2, "the run"), (3, "free works run license"), (4, "the of"), (5, ""), (6, None), (7, "absent work"), (8, "works working work")]
    table = spark.createDataFrame([(*d, 1) for d in docs], "id long, content string, score int")
    got = {}
    for r in fulltext.search(spark.createDataFrame(queries, "query_id long, query string"), table, 9).collect():
        got.setdefault(r.query_id, []).append((r.id, round(r.score, 9), r["rank"]))
    assert {q: sorted(v, key=lambda x: x[2]) for q, v in got.items()} == {q: b for q, t in queries if (b := brute(t, docs, 9))}
    assert fulltext.search(spark.createDataFrame(queries, "query_id long, query string"), table.limit(0), 9).count() == 0
