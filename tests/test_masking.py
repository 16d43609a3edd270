import json
import random
import re

import pytest
from pyspark.sql import functions as F

from velum.functions import json_text, text_sql
from velum.operators import bodies, detect, lexicon, masking, memory

# Synthetic golden cases: text and the entities (text, kind) of the class and CamelCase passes.
GOLDEN = [
    ("mail alice@example.com now", {("alice@example.com", "EMAIL")}),
    ("see https://ex.com/a?b=1, or docs.dev", {("https://ex.com/a?b=1", "URL"), ("docs.dev", "URL")}),
    ("inside https://acme.com only", {("https://acme.com", "URL")}),
    ("ping @ada_l and @x", {("@ada_l", "HANDLE")}),
    ("call (555) 123-4567 or +1-555-987-6543", {("555) 123-4567", "PHONE"), ("1-555-987-6543", "PHONE")}),
    ("host 10.0.0.12 up, 999.1.1.1 not", {("10.0.0.12", "IP")}),
    ("key ghp_a1b2c3d4e5f6a7b8c9d0e1 stays", {("ghp_a1b2c3d4e5f6a7b8c9d0e1", "SECRET")}),
    ("plain " + "a" * 40 + " and " + "1" * 40, set()),
    ("Our DataForge beats JavaScript", {("DataForge", "PROJECT")}),
    ("twice A@b.co and a@B.co", {("A@b.co", "EMAIL")}),
    ("éacme.com x", {("acme.com", "URL")}),
    (None, set()),
    ("", set()),
]


def test_golden(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(GOLDEN)], "doc_id long, text string")
    got = {r.doc_id: {(e.text, e.kind) for e in r.entities} for r in detect.entities(df).collect()}
    assert got == {i: want for i, (_, want) in enumerate(GOLDEN)}


def brute(text):
    """The rule of places in plain Python."""
    taken, out, seen = [], [], set()

    def matches(pattern, kind, free=True, test=lambda s: True):
        found = [(m.start(), m[0], kind) for m in re.finditer(pattern, text, re.ASCII) if test(m[0])]
        found = [f for f in found if not free or not any(s <= f[0] < s + len(t) for s, t, _ in taken)]
        return found

    groups = [(detect.URL, "URL", False), (detect.EMAIL, "EMAIL", False), (detect.DOMAIN, "URL", True), (detect.HANDLE, "HANDLE", True), (detect.PHONE, "PHONE", False), (detect.IPV4, "IP", True)]
    for pattern, kind, free in groups:
        got = matches(pattern, kind, free)
        taken += got
        out += got
    out += matches(detect.SECRET, "SECRET", True, lambda s: re.search("[0-9]", s) and re.search("[A-Za-z]", s))
    out += [(m.start(), m[0], "PROJECT") for m in re.finditer(detect.CAMEL, text, re.ASCII) if m[0] not in detect.TECH_TERMS]
    return [e for e in out if len(e[1].strip().encode()) >= 3 and not (e[1].lower() in seen or seen.add(e[1].lower()))]


def fuzz(n, seed=3):
    rng = random.Random(seed)
    parts = ["bob@ex.com", "https://ex.com/a", "x.io", "ex.com", "@bobby", "555-123-4567", "10.1.2.3", "ab_" + "c1" * 12, "DataForge", " ", ",", "\n", "é", "word", ".", "(", ")", "'", "JavaScript", "[EMAIL_1]", "`", "$1", "\\"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(n)]


def test_places_equal_brute_force(spark):
    texts = fuzz(300)
    got = {r.i: [(e.start, e.text, e.kind) for e in r.entities] for r in detect.entities(spark.createDataFrame(list(enumerate(texts)), "i long, text string")).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_round_trip_and_no_leak(spark):
    texts = [t for t in fuzz(200, 8) if not re.search(masking.POISONED, t)]
    rows = spark.createDataFrame([(f"s{i % 9}", i // 9, t) for i, t in enumerate(texts)], "session string, turn long, text string")
    found = detect.detections(rows, ["session", "turn"])
    tokens = masking.token_map(found)
    masked = masking.mask_turns(rows, tokens)
    assert masking.leaks(masked, tokens).count() == 0
    for r in masking.restore_turns(masked, tokens).collect():
        assert r.restored.lower() == r.text.lower()
    numbers = tokens.select("session", "kind", F.regexp_extract("token", r"_(\d+)\]", 1).cast("int").alias("n")).groupBy("session", "kind").agg(F.max("n").alias("m"), F.count("*").alias("c"))
    assert numbers.where("m != c").count() == 0  # dense
    again = masking.mask_turns(masked.select("session", "turn", F.col("masked").alias("text")), tokens).where("masked != text")
    assert again.count() == 0  # a second pass changes nothing


def test_numbers_go_on(spark):
    shape = "session string, turn long, ord int, text string, kind string"
    one = masking.token_map(spark.createDataFrame([("s", 0, 0, "https://a.com", "URL"), ("s", 0, 1, "x@y.zz", "EMAIL")], shape))
    two = masking.token_map(spark.createDataFrame([("s", 1, 0, "HTTPS://A.com", "URL"), ("s", 1, 1, "https://b.com", "URL"), ("t", 1, 0, "https://b.com", "URL")], shape), one)
    assert {(r.session, r.original, r.token) for r in two.collect()} == {("s", "https://a.com", "[URL_1]"), ("s", "x@y.zz", "[EMAIL_1]"), ("s", "https://b.com", "[URL_2]"), ("t", "https://b.com", "[URL_1]")}


def test_mask_guards(spark):
    tokens = spark.createDataFrame([("s", "https://x.com/", "URL", "[URL_1]", 0), ("s", "Ann", "PERSON", "[PERSON_1]", 0), ("s", "Ann Lee", "PERSON", "[PERSON_2]", 0), ("s", r"a\E$1", "ORG", "[ORG_1]", 0)], "session string, original string, kind string, token string, first_turn long")
    cases = {"go https://x.com/ now": "go [URL_1] now", "ann lee, ANN": "[PERSON_2], [PERSON_1]", "Annie /Ann @Ann _Ann xAnn": "Annie /Ann @Ann _Ann xAnn", r"by a\E$1.": "by [ORG_1]."}
    rows = spark.createDataFrame([("s", i, t) for i, t in enumerate(cases)], "session string, turn long, text string")
    assert [r.masked for r in masking.mask_turns(rows, tokens).orderBy("turn").collect()] == list(cases.values())
    late = masking.mask_turns(rows, tokens.withColumn("first_turn", F.lit(9).cast("long")))
    assert late.where("masked != text").count() == 0


def test_found_masks_carry_few_entries(spark):
    """In a session with very many originals each row carries only its own: the same masks, and no array of all of them."""
    texts = [f"mail u{i}@ex.com or U{i // 2}@EX.com" + (" see https://ex.com/a" if i % 3 else "") for i in range(60)]
    rows = spark.createDataFrame([("s" if i else None, i, t) for i, t in enumerate(texts)], "session string, turn long, text string")
    found = detect.detections(rows, ["session", "turn"])
    tokens = masking.token_map(found)
    out = masking.mask_found(rows, found, tokens)
    want = {r.turn: r.masked for r in masking.mask_turns(rows, tokens).collect()}
    assert {r.turn: r.masked for r in out.collect()} == want and "@" not in want[1]
    back = masking.restore_turns(out, tokens).collect()
    assert len(back) == 60 and all(r.restored.lower() == r.text.lower() for r in back)
    held = []
    plain, masking.restore = masking.restore, lambda text, e: held.append(1) or F.size(e).cast("string")
    try:
        sizes = [int(r.restored) for r in masking.restore_turns(out, tokens).collect()]
    finally:
        masking.restore = plain
    assert held and max(sizes) <= 3


def test_poisoned_and_unknown_tokens_stay(spark):
    tokens = spark.createDataFrame([("s", "fine", "ORG", "[ORG_1]", 0), ("s", "see [PERSON_2", "ORG", "[ORG_2]", 0)], "session string, original string, kind string, token string, first_turn long")
    rows = spark.createDataFrame([("s", 0, "[ORG_1] [ORG_2] [ORG_3] [ORG_11]")], "session string, turn long, masked string")
    assert masking.restore_turns(rows, tokens).first().restored == "fine [ORG_2] [ORG_3] [ORG_11]"


def test_envelopes(spark):
    tokens = spark.createDataFrame([("s", "Ann", "PERSON", "[PERSON_1]", 0), ("t", "x@y.zz", "EMAIL", "[EMAIL_1]", 0)], "session string, original string, kind string, token string, first_turn long")
    out = masking.export_sessions(tokens)
    assert sorted(map(tuple, masking.import_sessions(out).collect())) == sorted(map(tuple, tokens.collect()))
    with pytest.raises(Exception, match="newer version"):
        masking.import_sessions(out.withColumn("envelope", F.replace("envelope", F.lit('"version":1'), F.lit('"version":2')))).collect()


def test_breaker(spark):
    rows = spark.createDataFrame([(1, 5), (2, 101)], "id long, n_entities int")
    assert [r.id for r in masking.guard(rows).collect()] == [1]
    assert [r.unmasked for r in masking.guard(rows, mode="passthrough").orderBy("id").collect()] == [False, True]


def test_code_regions(spark):
    cases = ["a `x@y.zz` b x@y.zz", "t\n```py\nx@y.zz\n```\nx@y.zz", "~~~\nx@y.zz", "no code x@y.zz", r"\`x@y.zz\` plain", "``a`x@y.zz`` c"]
    upper = lambda p: F.replace(p, F.lit("x@y.zz"), F.lit("[E]"))
    df = spark.createDataFrame(list(enumerate(cases)), "i long, t string")
    got = [r.o for r in df.orderBy("i").select(detect.outside_code(F.col("t"), upper).alias("o")).collect()]
    assert got == ["a `x@y.zz` b [E]", "t\n```py\nx@y.zz\n```\n[E]", "~~~\nx@y.zz", "no code [E]", r"\`[E]\` plain", "``a`x@y.zz`` c"]


def test_fact_terms(spark):
    facts = [("uses `@acme/Core-Kit/x` and `plain`", "project"), ('likes "Blue Heron" and "A Much Longer Name"', None), ("builds DataForge, mail a@b.co", "work"), ("again `acme` and 'Blue Heron'", "project"), (None, None)]
    got = {(r.text, r.kind) for r in detect.fact_terms(spark.createDataFrame(facts, "content string, category string")).collect()}
    assert ("Blue Heron", "ORG") in got or ("Blue Heron", "PROJECT") in got
    assert {("DataForge", "ORG"), ("a@b.co", "EMAIL")} <= got and not any(t in ("plain", "acme", "A Much Longer Name") for t, _ in got)


NAMES = [
    ("Dr. Smith met Alice Jones.", {("Smith", "PERSON"), ("Alice Jones", "PERSON")}),
    ("Mr Brown Green Blue Red left", {("Brown Green Blue", "PERSON")}),
    ("lives in San Francisco, CA now", {("San Francisco", "PLACE"), ("CA", "PLACE")}),
    ("flew to Portland, OR yesterday", {("Portland, OR", "PLACE")}),
    ("OK, A OR B sounds OK", set()),
    ("driving to OK soon", {("OK", "PLACE")}),
    ("Acme Corp. hired Bob", {("Acme Corp", "ORG"), ("Bob", "PERSON")}),
    ("Jordan and Austin", {("Jordan", "PERSON"), ("Austin", "PERSON")}),
    ("alice in paris", set()),
    ("[PERSON_1] met Maria [ORG_2]", {("Maria", "PERSON")}),
    ("", set()),
    (None, set()),
]


def test_lexicon(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(NAMES)], "doc_id long, text string")
    got = {r.doc_id: {(n.text, n.kind) for n in r.names} for r in lexicon.names(df).collect()}
    assert got == {i: want for i, (_, want) in enumerate(NAMES)}
    for r in lexicon.names(df).join(df, "doc_id").collect():
        assert all(r.text[n.start : n.start + len(n.text)] == n.text for n in r.names)


def test_anonymize_masks_names(spark):
    """A name, a place and a company come out masked, between the classes and CamelCase; technical terms stay."""
    texts = ["Alice Jones of Acme Corp. moved to Paris, mail alice@example.com about DataForge", "flew to Portland, then CA. Sarah PySpark met Dr. House", None]
    out = masking.anonymize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert out[0].masked == "[PERSON_1] of [ORG_1]. moved to [PLACE_1], mail [EMAIL_1] about [PROJECT_1]"
    assert [e.token for e in out[0].entities] == ["[EMAIL_1]", "[PERSON_1]", "[ORG_1]", "[PLACE_1]", "[PROJECT_1]"]
    assert out[1].masked == "flew to [PLACE_1], then [PLACE_2]. [PERSON_1] PySpark met Dr. [PERSON_2]"
    assert out[2].masked is None and out[2].n_entities == 0
    custom = F.array(F.struct(F.lit(0).alias("start"), F.lit("Paris").alias("text"), F.lit("PROJECT").alias("kind")))
    rows = spark.createDataFrame([(0, "Paris and Sarah")], "doc_id long, text string")
    assert masking.anonymize(rows, custom=custom).first().masked == "[PROJECT_1] and [PERSON_1]"  # custom texts come before names


def test_shipped_lexicons(spark):
    """The default lists are full ones: at least as long as the reference's, without entries that no rule can match."""
    full = lexicon.Lexicon()
    assert len(full.first_names) >= 775 and len(full.places) >= 346
    assert all(w == w.lower().strip() and len(w.split()) in ((1,) if w in full.first_names else (1, 2)) for w in full.first_names | full.places)
    df = spark.createDataFrame([(1, "Yesterday Priya Sharma flew to Nairobi"), (2, "Wojciech likes Buenos Aires")], "doc_id long, text string")
    got = {(r.doc_id, n.text, n.kind) for r in lexicon.names(df).collect() for n in r.names}
    assert got == {(1, "Priya Sharma", "PERSON"), (1, "Nairobi", "PLACE"), (2, "Wojciech", "PERSON"), (2, "Buenos Aires", "PLACE")}


def test_promotions(spark):
    rows = [(c, t, k) for c in range(4) for t, k in (("Acme", "ORG"), ("Ann", "PERSON"))] + [(9, "acme", "ORG"), (9, "Oslo", "PLACE")]
    got = masking.promotions(spark.createDataFrame(rows, "call long, text string, kind string")).collect()
    assert [(r.content.lower(), r.n_calls) for r in got] == [("acme", 5)]


def test_bodies_and_occurrences(spark):
    shape = "session string, original string, kind string, token string, first_turn long"
    tokens = spark.createDataFrame([("s", "Ann", "PERSON", "[PERSON_1]", 0)], shape)
    rows = [("s", 0, "user", "hi Ann"), ("s", 1, "assistant", "hi Ann"), ("s", 2, "user", '[{"type":"text","text":"Ann \\"x\\""},{"type":"image","text":"Ann"}]'), ("s", 3, "user", "[not json Ann"), ("t", 0, "user", "Ann"), ("s", 4, "user", None)]
    out = bodies.mask_bodies(spark.createDataFrame(rows, "session string, turn long, role string, content string"), tokens)
    got = {(r.session, r.turn): r.content for r in out.collect()}
    assert got[("s", 0)] == "hi [PERSON_1]" and got[("s", 1)] == "hi Ann" and got[("t", 0)] == "Ann" and got[("s", 4)] is None and got[("s", 3)] == "[not json [PERSON_1]"
    assert got[("s", 2)] == '[{"type":"text","text":"[PERSON_1] \\"x\\""},{"type":"image","text":"Ann"}]'
    counted = masking.occurrences(out.withColumnRenamed("content", "masked"), tokens).collect()
    assert [(r.token, r.n) for r in counted] == [("[PERSON_1]", 3)]


def any_json(rng, depth=0):
    kind = rng.randrange(8 if depth < 4 else 6)
    if kind < 2:
        return rng.choice(["", "a", "\"q\" \\ \n", "é☃🙂", "[EMAIL_1]", "x" * 30, "\u0001"])
    if kind < 6:
        return rng.choice([0, -1, 1.5, 1e30, True, False, None])
    if kind == 6:
        return [any_json(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["type", "text", "k", "ü", ""]): any_json(rng, depth + 1) for _ in range(rng.randrange(4))}


def test_leaves_of_json():
    """Leaves are found in any layout, and nothing but chosen ones changes."""
    rng = random.Random(5)

    def strings(value):
        if isinstance(value, str):
            return [value]
        below = value if isinstance(value, list) else value.values() if isinstance(value, dict) else []
        return [s for v in below for s in strings(v)]

    for _ in range(800):
        text = json.dumps(any_json(rng), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]), separators=rng.choice([None, (",", ":"), (" , ", " :\t")]))
        leaves = json_text.string_leaves(text)
        assert [json_text.value(text, a, b) for _, a, b in leaves] == strings(json.loads(text))
        assert json_text.rewrite(text, {}, leaves) == text
        if leaves:
            n = rng.randrange(len(leaves))
            new = json_text.rewrite(text, {n: "new \"\n"}, leaves)
            _, a, b = leaves[n]
            assert new.startswith(text[:a]) and new.endswith(text[b:]) and strings(json.loads(new))[n] == "new \"\n"
        broken = text[:-1] if rng.random() < 0.5 else text.replace(":", ",", 1)
        try:
            json.loads(broken)
        except ValueError:
            with pytest.raises(ValueError):
                json_text.string_leaves(broken)
    assert json_text.string_leaves("[" * 50_000 + "]" * 50_000) == []


def test_requests_of_three_shapes(spark):
    body = {
        0: '{"messages":[{"role":"tool","content":"to a@ex.com"},{"role":"assistant","content":"b@ex.com"},{"role":"developer","content":[{"type":"text","text":"A@EX.COM `a@ex.com`"},{"type":"input","text":"a@ex.com"}]}],"n":1.0}',
        1: '{"systemInstruction":{"parts":[{"text":"c@ex.com"}]},"contents":[{"role":"model","parts":[{"text":"a@ex.com"},{"inlineData":{"data":"a@ex.com"}}]}], "k" : true}',
        2: "not json a@ex.com",
        3: None,
        4: json.dumps({"messages": [{"role": "user", "content": " ".join(f"m{i}@ex.com" for i in range(6))}]}),
    }
    rows = spark.createDataFrame([("s", k, v) for k, v in body.items()] + [(None, 0, body[0])], "session string, turn long, body string")
    out, tokens = bodies.mask_requests(rows, most=5)
    got = {(r.session, r.turn): (r.body, r.n_entities) for r in out.collect()}
    assert got[("s", 0)] == (body[0].replace("to a@ex.com", "to [EMAIL_1]").replace("A@EX.COM", "[EMAIL_1]"), 1)
    assert got[("s", 1)] == (body[1].replace("c@ex.com", "[EMAIL_2]").replace('{"text":"a@ex.com"}', '{"text":"[EMAIL_1]"}'), 2)
    assert got[("s", 2)] == (body[2], 0) and got[("s", 3)] == (None, 0) and ("s", 4) not in got
    assert {r.original for r in tokens.where("session = 's'").collect()} == {"a@ex.com", "c@ex.com"}
    back = {r.turn: r.body for r in bodies.restore_bodies(out, tokens).where("session = 's'").collect()}
    assert back[1] == body[1] and back[0] == body[0].replace("A@EX.COM", "a@ex.com")
    passed = bodies.mask_requests(rows, mode="passthrough", most=5)[0].where("unmasked").collect()
    assert [(r.turn, r.body) for r in passed] == [(4, body[4])]


def test_control_characters_outside_code(spark):
    text = "a\x01b `Ann` Ann\x02 c"
    got = spark.createDataFrame([(text,), (None,)], "t string").select(detect.outside_code(F.col("t"), lambda p: F.upper(p)).alias("x")).collect()
    assert [r.x for r in got] == ["A\x01B `Ann` ANN\x02 C", ""]


def test_sql_functions(spark):
    """Spans and chunks of the table functions equal the columns; masks made in SQL restore."""
    assert text_sql.register(spark) == ["text_chunks", "text_spans", "mask_text", "restore_text", "token_map_of"]
    texts = [*fuzz(150), None, "", "x\n\n" * 10 + "a paragraph that is long enough. " * 60 + "\n \n" + "another long paragraph", "word " * 500]
    table = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    table.createOrReplaceTempView("_texts")
    got = {}
    for r in spark.sql("SELECT i, s.start, s.text, s.kind FROM _texts t, LATERAL text_spans(t.text) s").collect():
        got.setdefault(r.i, []).append((r.start, r.text, r.kind))
    want = {r.i: [(e.start, e.text, e.kind) for e in r.entities] for r in detect.entities(table).collect()}
    assert got == {i: e for i, e in want.items() if e}
    parts = {}
    for r in spark.sql("SELECT i, c.idx, c.chunk FROM _texts t, LATERAL text_chunks(t.text) c").collect():
        parts.setdefault(r.i, {})[r.idx] = r.chunk
    for r in table.where("text IS NOT NULL").select("i", memory.chunks(F.col("text")).alias("c")).collect():
        assert [parts[r.i][k] for k in sorted(parts[r.i])] == list(r.c)
    row = spark.sql(r"SELECT mask_text('Ann and ANN x@y.io', token_map_of(array(struct('Ann' AS text, 'PERSON' AS kind), struct('x@y.io' AS text, 'EMAIL' AS kind), struct('Bo' AS text, 'PERSON' AS kind)))) AS m, restore_text('[PERSON_2] [PERSON_1] [X_1]', map('a[X_1', '[X_1]', 'Bo', '[PERSON_2]')) AS r").first()
    assert (row.m, row.r) == ("[PERSON_1] and [PERSON_1] [EMAIL_1]", "Bo [PERSON_1] [X_1]")
