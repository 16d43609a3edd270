"""Queries over texts, vectors and retrieval, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.functions import vectors
from velum.io import spread, table
from velum.operators import conversation, detect, lexicon, masking, memory, retrieval

_RE_EMAIL, _RE_URL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", r"""https?://[^\s,)>''"]+"""
_RE_PHONE = r"\b(?:\+?1[\-.\s]?)?\(?[0-9]{3}\)?[\-.\s]?[0-9]{3}[\-.\s]?[0-9]{4}\b"
_RE_IP = r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b"
_RE_SECRET = r"(?:[a-zA-Z0-9]{1,12}[_\-])[A-Za-z0-9+/]{20,}|[A-Za-z0-9]{32,}"
_RE_CAMEL = r"\b[A-Z][a-z]{2,}[A-Z][a-zA-Z]+\b"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def detect_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    mail = detect.spans(t, detect.EMAIL, "EMAIL")
    return _docs(spark, sf_dir).select(
        "doc_id", F.size(detect.spans(t, detect.URL, "URL")).alias("n_url"), F.size(mail).alias("n_email"), F.get(mail["start"], F.lit(0)).alias("first_email"),
        F.size(detect.spans(t, detect.PHONE, "PHONE")).alias("n_phone"), F.size(detect.spans(t, detect.IPV4, "IP")).alias("n_ip"),
        F.size(F.filter(detect.spans(t, detect.SECRET, "SECRET"), lambda s: s["text"].rlike("[0-9]") & s["text"].rlike("[A-Za-z]"))).alias("n_secret"), F.size(detect.camel_case(t, ())).alias("n_camel"),
    )


_DETECT_CLASSES = f"""
    SELECT doc_id, len(regexp_extract_all(text, '{_RE_URL}'))::INT AS n_url, len(regexp_extract_all(text, '{_RE_EMAIL}'))::INT AS n_email,
        CASE WHEN regexp_matches(text, '{_RE_EMAIL}') THEN strpos(text, regexp_extract(text, '{_RE_EMAIL}'))::INT - 1 END AS first_email,
        len(regexp_extract_all(text, '{_RE_PHONE}'))::INT AS n_phone, len(regexp_extract_all(text, '{_RE_IP}'))::INT AS n_ip,
        len(list_filter(regexp_extract_all(text, '{_RE_SECRET}'), lambda x: regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Za-z]')))::INT AS n_secret,
        len(regexp_extract_all(text, '{_RE_CAMEL}'))::INT AS n_camel
    FROM documents"""


def detect_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _docs(spark, sf_dir).select("lang", F.explode_outer(F.concat(detect.spans(F.col("text"), detect.EMAIL, "EMAIL"), detect.spans(F.col("text"), detect.PHONE, "PHONE"), detect.spans(F.col("text"), detect.IPV4, "IP"))).alias("e")).where("e IS NOT NULL")
    return found.groupBy("lang", F.col("e.kind").alias("kind")).agg(F.count("*").alias("n"), F.countDistinct(F.lower("e.text")).alias("n_distinct"))


_DETECT_HISTOGRAM = f"""
    WITH m AS (SELECT lang, 'EMAIL' AS kind, unnest(regexp_extract_all(text, '{_RE_EMAIL}')) AS t FROM documents
        UNION ALL SELECT lang, 'PHONE', unnest(regexp_extract_all(text, '{_RE_PHONE}')) FROM documents
        UNION ALL SELECT lang, 'IP', unnest(regexp_extract_all(text, '{_RE_IP}')) FROM documents)
    SELECT lang, kind, count(*) AS n, count(DISTINCT lower(t)) AS n_distinct FROM m GROUP BY lang, kind"""


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All classes with the rule of places; SQL has no lookbehind, so tests compare it with brute force."""
    return detect.detections(_docs(spark, sf_dir), ["doc_id"])


def _mail_found(docs: DataFrame) -> DataFrame:
    spans = F.filter(detect.spans(F.col("text"), detect.EMAIL, "EMAIL"), lambda s: F.octet_length(s["text"]) >= 3)
    return docs.select(F.col("source").alias("session"), F.col("doc_id").alias("turn"), F.posexplode_outer(spans).alias("ord", "e")).where("ord IS NOT NULL").select("session", "turn", "ord", "e.text", "e.kind")


def session_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masking.token_map(_mail_found(_docs(spark, sf_dir))).select("session", "original", "token", "first_turn")


_SESSION_TOKENS = f"""
    WITH m AS (SELECT source AS session, doc_id AS turn, regexp_extract_all(text, '{_RE_EMAIL}') AS l FROM documents),
    e AS (SELECT session, turn, unnest(l) AS t, unnest(range(len(l))) AS ord FROM m),
    f AS (SELECT session, lower(t) AS key, t, turn, ord, row_number() OVER (PARTITION BY session, lower(t) ORDER BY turn, ord) AS r FROM e)
    SELECT session, t AS original, '[EMAIL_' || row_number() OVER (PARTITION BY session ORDER BY turn, ord, key) || ']' AS token, turn AS first_turn FROM f WHERE r = 1"""


def mask_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    found = detect.detections(docs.select(F.col("source").alias("session"), F.col("doc_id").alias("turn"), "text"), ["session", "turn"])
    tokens = masking.token_map(found)
    turns = docs.select(F.col("source").alias("session"), F.col("doc_id").alias("turn"), "text")
    back = masking.restore_turns(masking.mask_found(turns, found, tokens).select("session", "turn", "masked"), tokens)
    return back.select(F.col("turn").alias("doc_id"), F.regexp_count("masked", F.lit(detect.EMAIL)).alias("n_left"), F.sha2("restored", 256).alias("digest"))


_MASK_ROUND_TRIP = "SELECT doc_id, 0 AS n_left, sha256(text) AS digest FROM documents"


def anonymized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents masked, each its own session."""
    return masking.anonymize(_docs(spark, sf_dir))


def lexicon_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.names(_docs(spark, sf_dir)).select("doc_id", F.explode("names").alias("n")).select("doc_id", "n.start", "n.text", "n.kind")


def promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    found = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # nations are a fixed list
    return masking.promotions(found.select(F.col("o_orderkey").alias("call"), F.col("n_name").alias("text"), F.lit("PLACE").alias("kind"))).select("content", "n_calls")


_PROMOTIONS = """SELECT n_name AS content, count(DISTINCT o_orderkey) AS n_calls FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    GROUP BY n_name HAVING count(DISTINCT o_orderkey) >= 3"""


# --- vectors ----------------------------------------------------------------------------------------------------------


def vector_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    pair = e.select("vec_id", F.col("embedding").cast("array<double>").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").cast("array<double>").alias("b")), "vec_id")
    a, b = F.col("a"), F.col("b")
    r = lambda c, n: F.round(c, 6).alias(n)
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    return pair.select(
        "vec_id", r(vectors.l2(a, b), "l2"), r(vectors.l1(a, b), "l1"), r(vectors.cosine_distance(a, b), "cosine"), vectors.length(a).alias("dims"),
        r(total(vectors.add(a, b)), "added"), r(total(vectors.sub(a, b)), "subtracted"), r(total(vectors.cut(a, 3, 9)), "sliced"), r(vectors.norm(vectors.normalize(a)), "unit"),
        F.aggregate(vectors.quantize_int8(a), F.lit(0), lambda s, x: s + x).alias("int8_sum"),
        F.aggregate(vectors.quantize_binary(a), F.lit(0), lambda s, x: s + F.bit_count(x.cast("int").bitwiseAND(255))).alias("bits"),
        vectors.hamming(vectors.quantize_binary(a), vectors.quantize_binary(b)).alias("hamming"),
    )


_VECTOR_FUNCTIONS = """
    WITH p AS (SELECT x.vec_id, x.embedding::DOUBLE[] AS a, y.embedding::DOUBLE[] AS b FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1)
    SELECT vec_id, round(list_distance(a, b), 6) AS l2, round(list_sum(list_transform(range(1, len(a) + 1), lambda i: abs(a[i] - b[i]))), 6) AS l1,
        round(1 - list_cosine_similarity(a, b), 6) AS cosine, len(a)::INT AS dims, round(list_sum(a) + list_sum(b), 6) AS added, round(list_sum(a) - list_sum(b), 6) AS subtracted,
        round(list_sum(a[4:9]), 6) AS sliced, 1.0::DOUBLE AS unit,
        list_sum(list_transform(a, lambda x: trunc(least(greatest((x + 1) / (2.0::DOUBLE / 255) - 128, -128), 127))::INT))::INT AS int8_sum,
        len(list_filter(a, lambda x: x > 0))::INT AS bits, len(list_filter(range(1, len(a) + 1), lambda i: (a[i] > 0) <> (b[i] > 0)))::INT AS hamming
    FROM p"""


def _nearest(spark: SparkSession, sf_dir: str, k: int, metric: str, most: float | None = None) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return retrieval.knn(queries, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), k, metric, most=most)


def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, 5, "cosine").select("query_id", "id", F.round("distance", 6).alias("distance"), "rank")


def knn_l2_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, 10, "l2", 1.2).select("query_id", "id", F.round("distance", 6).alias("distance"), "rank")


def _knn_sql(distance: str, k: int, test: str = "TRUE") -> str:
    return f"""
    WITH d AS (SELECT q.vec_id AS query_id, e.vec_id AS id, {distance} AS d FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id)::INT AS rank FROM d WHERE {test})
    SELECT query_id, id, round(greatest(d, 0), 6) AS distance, rank FROM r WHERE rank <= {k}"""


_COSINE = "CASE WHEN q.vec_id = e.vec_id THEN 0 ELSE 1 - list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) END"
_L2 = "list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[])"


def recall_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _nearest(spark, sf_dir, 30, "l2").drop("rank").join(_docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("text").alias("content")), "id")
    out = retrieval.rerank(hits.withColumns({"query": F.lit("License"), "type": F.lit("episodic"), "distance": F.round("distance", 9)}), 5)
    return out.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


_RECALL_RERANK = f"""
    WITH d AS (SELECT q.vec_id AS query_id, e.vec_id AS id, {_L2} AS d FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0),
    h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS r FROM d) WHERE r <= 30),
    s AS (SELECT query_id, id, left(trim(text), 200) AS p, 1 / (1 + round(d, 9)) * (0.3 + 0.7 * least(1.0, octet_length(encode(text)) / 150)) + CASE WHEN contains(lower(text), 'license') THEN 0.02 ELSE 0 END AS score
        FROM h JOIN documents ON id = doc_id),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, p ORDER BY score DESC, id) AS n FROM s) WHERE n = 1),
    r AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM b)
    SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= 5"""


def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = retrieval.fuse(_nearest(spark, sf_dir, 15, "cosine"), _nearest(spark, sf_dir, 15, "l1"), limit=5)
    return out.select("query_id", F.round("score", 6).alias("score"), "rank")


_RANK_FUSION = f"""
    WITH d AS (SELECT q.vec_id AS query_id, e.vec_id AS id, {_COSINE} AS c, list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i: abs(q.embedding[i]::DOUBLE - e.embedding[i]::DOUBLE))) AS m
        FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c, id) AS rc, row_number() OVER (PARTITION BY query_id ORDER BY m, id) AS rm FROM d),
    s AS (SELECT query_id, id, CASE WHEN rc <= 15 THEN 1.0::DOUBLE / (60 + rc) ELSE 0 END + CASE WHEN rm <= 15 THEN 1.0::DOUBLE / (60 + rm) ELSE 0 END AS score FROM r WHERE rc <= 15 OR rm <= 15),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM s)
    SELECT query_id, round(score, 6) AS score, rank FROM o WHERE rank <= 5"""

_ASKED = [(1, "the and of license"), (2, "is licensed under"), (3, "mit license"), (4, "in the")]


def text_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame(_ASKED, "query_id long, query string")
    out = retrieval.text_rank(asked, _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("text").alias("content")), 10)
    return out.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


_TEXT_VALUES = ", ".join(f"({i}::BIGINT, '{t}')" for i, t in _ASKED)
_TEXT_RANK = f"""
    WITH q AS (SELECT id AS query_id, unnest(list_distinct(regexp_extract_all(lower(t), '[a-z0-9]+'))) AS word FROM (VALUES {_TEXT_VALUES}) v(id, t)),
    d AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
    n AS (SELECT count(*) AS n_docs, avg(len(w)) AS mean FROM d),
    t AS (SELECT id, any_value(len(w)) AS size, word, count(*) AS tf FROM (SELECT id, w, unnest(w) AS word FROM d) GROUP BY id, word),
    f AS (SELECT word, count(*) AS df FROM t GROUP BY word),
    s AS (SELECT query_id, id, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))) AS score, count(*) AS held
        FROM q JOIN t USING (word) JOIN f USING (word) CROSS JOIN n GROUP BY query_id, id),
    r AS (SELECT s.*, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id)::INT AS rank FROM s JOIN (SELECT query_id, count(*) AS need FROM q GROUP BY 1) USING (query_id) WHERE held = need)
    SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= 10"""


def context_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    last = c.where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("query"))
    hits = c.join(last, "conv_id").select(F.col("conv_id").alias("query_id"), "query", F.col("turn").alias("id"), F.when(F.col("turn") % 3 == 0, "semantic").otherwise("episodic").alias("type"), "role", F.col("text").alias("content"), F.col("turn").alias("rank"))
    return retrieval.context(hits)


_CONTEXT_LINES = r"""
    WITH l AS (SELECT conv_id, arg_max(text, turn) AS query FROM conversations WHERE role = 'user' GROUP BY conv_id),
    h AS (SELECT conv_id AS query_id, query, turn AS id, CASE WHEN turn % 3 = 0 THEN 'semantic' ELSE 'episodic' END AS type, role, text, regexp_replace(lower(trim(text)), '\s+', ' ', 'g') AS key FROM conversations JOIN l USING (conv_id)),
    u AS (SELECT * FROM h WHERE (type <> 'episodic' OR role IS NULL OR role = 'user') AND key <> regexp_replace(lower(trim(left(query, 500))), '\s+', ' ', 'g')),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY id) AS a FROM u),
    n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY id)::INT AS n FROM o WHERE a = 1),
    t AS (SELECT query_id, id, n, '- ' || CASE WHEN type <> 'episodic' THEN '(' || type || ')' WHEN regexp_matches(trim(text), '\?$') THEN '(user previously asked)' ELSE '(user previously said)' END || ': '
        || CASE WHEN length(text) > 250 THEN left(text, 250) || '…' ELSE text END AS line FROM n WHERE n <= 3),
    s AS (SELECT *, sum(length(line)) OVER (PARTITION BY query_id ORDER BY n) AS total FROM t)
    SELECT query_id, id, line, n AS rank FROM s WHERE total <= 600"""


# --- memory and conversations -----------------------------------------------------------------------------------------


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.regexp_replace("text", "\n", "\n \n")
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(memory.chunks(text)).alias("idx", "chunk")).select("doc_id", "idx", F.char_length("chunk").alias("n_chars"), F.sha2("chunk", 256).alias("digest"))


_PARAGRAPHS = r"""
    WITH t AS (SELECT doc_id, replace(text, chr(10), chr(10) || ' ' || chr(10)) AS text FROM documents),
    p AS (SELECT doc_id, text, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: trim(x)), lambda x: length(x) >= 20) AS l FROM t),
    c AS (SELECT doc_id, CASE WHEN length(text) > 1500 AND len(l) > 1 THEN l ELSE [trim(text)] END AS l FROM p),
    e AS (SELECT doc_id, unnest(range(len(l)))::INT AS idx, unnest(l) AS chunk FROM c)
    SELECT doc_id, idx, length(chunk)::INT AS n_chars, sha256(chunk) AS digest FROM e"""


def noise_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", memory.noisy(t).alias("noisy"), memory.automation(t).alias("automation"), memory.storable(t).alias("storable"))


_AUTOMATION = r"""(regexp_matches(ltrim(text), '^\[[^:\]]*[A-Z]') AND regexp_matches(ltrim(text), '^\[[A-Z0-9 _]+([:\]]|$)') OR regexp_matches(ltrim(text), '^<[a-z][a-z0-9_\-]{0,30}>')
        OR """ + " OR ".join(f"starts_with(ltrim(text), '{o}')" for o in memory.AGENT_OPENINGS) + ")"
_NOISE_FLAGS = rf"""
    SELECT doc_id, (regexp_matches(text, '^(```|root@|FROM |RUN )') OR (length(text) - length(replace(text, chr(10), '')) > 15 AND (length(text) - length(replace(text, '    ', ''))) / 4 > 5)
        OR regexp_matches(text, 'node_modules|package-lock') OR len(regexp_extract_all(text, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}')) >= 3 OR regexp_matches(text, '^\s*[\{{\[]')) AS noisy,
        {_AUTOMATION} AS automation, (length(trim(text)) >= 20 AND NOT {_AUTOMATION} AND NOT regexp_matches(trim(text), '^[a-z0-9_\-]+$')) AS storable
    FROM documents"""


def _user_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("content"))


_USER_FACTS = "SELECT conv_id * 1000 + turn AS id, text AS content FROM conversations WHERE role = 'user'"


def similar_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.similar_pairs(_user_facts(spark, sf_dir), 0.25).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


_STOPS = ", ".join(f"'{w}'" for w in memory.STOP_WORDS)
_SIMILAR_FACTS = f"""
    WITH f AS ({_USER_FACTS}), w AS (SELECT id, list_filter(list_distinct(regexp_extract_all(lower(content), '[a-z0-9_]+')), lambda x: length(x) > 2 AND NOT list_contains([{_STOPS}], x)) AS w FROM f),
    p AS (SELECT x.id AS a, y.id AS b, len(list_intersect(x.w, y.w)) AS n, len(x.w) + len(y.w) AS s FROM w x JOIN w y ON x.id < y.id AND len(x.w) > 0 AND len(y.w) > 0)
    SELECT a, b, round(n / (s - n), 6) AS jaccard FROM p WHERE n / (s - n) >= 0.25 - 1e-12"""


def fact_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy stars are sequential; tests compare them with brute force."""
    return memory.clusters(_user_facts(spark, sf_dir))


def uncovered_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return memory.not_covered(docs, table(spark, sf_dir, "benchmark").select(F.col("text").alias("content"))).select("id")


_UNCOVERED_FACTS = r"""
    WITH s AS (SELECT doc_id AS id, list_filter(list_distinct(regexp_split_to_array(lower(text), '\s+')), lambda x: x <> '') AS w FROM documents),
    e AS (SELECT list_filter(list_distinct(regexp_split_to_array(lower(text), '\s+')), lambda x: x <> '') AS w FROM benchmark)
    SELECT id FROM s WHERE NOT EXISTS (SELECT 1 FROM e WHERE len(e.w) > 0 AND len(s.w) > 0 AND len(list_intersect(s.w, e.w)) / (len(s.w) + len(e.w) - len(list_intersect(s.w, e.w))) > 0.7)"""


def unknown_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "lang")
    return memory.not_known(docs.where("lang = 'en'").drop("lang"), docs.where("lang != 'en'").drop("lang")).select("id")


_UNKNOWN_FACTS = """SELECT min(doc_id) AS id FROM documents WHERE lang = 'en' AND lower(trim(text)) NOT IN (SELECT lower(trim(text)) FROM documents WHERE lang <> 'en') GROUP BY lower(trim(text))"""


def query_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = conversation.query_class(F.col("text"))
    rows = table(spark, sf_dir, "conversations").select(kind.alias("kind"), (F.char_length("text") * 200).alias("tokens"), F.when(F.col("turn") == 2, "cost").otherwise("quality").alias("priority"))
    return rows.groupBy("kind", conversation.model_tier(F.col("kind"), F.col("tokens"), F.col("priority")).alias("tier")).agg(F.count("*").alias("n"))


_KIND = "CASE " + " ".join(rf"WHEN regexp_matches(lower(text), '\b(?:{w})\b') THEN '{k}'" for k, w in conversation.QUERY_CLASSES) + " ELSE 'general' END"
_QUERY_ROUTES = f"""
    WITH r AS (SELECT {_KIND} AS kind, length(text) * 200 AS tokens, turn = 2 AS cheap FROM conversations)
    SELECT kind, CASE WHEN tokens > 100000 THEN 'large' WHEN cheap THEN 'light' WHEN kind IN ('code', 'generation') THEN 'large' WHEN kind = 'reasoning' THEN CASE WHEN tokens > 50000 THEN 'large' ELSE 'middle' END
        WHEN kind = 'factual' THEN 'light' ELSE 'small' END AS tier, count(*) AS n FROM r GROUP BY 1, 2"""


def conversation_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.conversation_list(table(spark, sf_dir, "conversations"))


_CONVERSATION_LIST = """SELECT conv_id, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS n_turns, left(arg_min(text, turn) FILTER (role = 'user'), 80) AS title FROM conversations GROUP BY conv_id"""


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").withColumnRenamed("turn", "idx")


def trimmed_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.trim(_messages(spark, sf_dir), 3000, 2).select("conv_id", "idx")


_TRIMMED_CONTEXT = """
    WITH w AS (SELECT conv_id, turn, sum(octet_length(encode(text))) OVER (PARTITION BY conv_id) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b, min(turn) OVER (PARTITION BY conv_id) AS f FROM conversations)
    SELECT conv_id, turn AS idx FROM w WHERE s <= 3000 OR b <= 2 OR turn = f"""


def context_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.summaries(_messages(spark, sf_dir), total=2000)


_CONTEXT_SUMMARIES = """
    WITH l AS (SELECT conv_id, turn, role || ': ' || left(text, CASE WHEN role = 'user' THEN 400 ELSE 300 END) AS line FROM conversations),
    t AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY conv_id ORDER BY turn) AS t FROM l)
    SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) AS summary FROM t WHERE t <= 2000 GROUP BY conv_id"""


def truncated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", conversation.truncated(F.col("text")).alias("text"))


QUERIES = [
    detect_classes, detect_histogram, detections, session_tokens, mask_round_trip, anonymized, lexicon_names, promotions, vector_functions, knn_cosine, knn_l2_within, recall_rerank,
    rank_fusion, text_rank, context_lines, paragraphs, noise_flags, similar_facts, fact_clusters, uncovered_facts, unknown_facts, query_routes, conversation_list, trimmed_context,
    context_summaries, truncated_texts,
]

SQL = {
    "detect_classes": _DETECT_CLASSES, "detect_histogram": _DETECT_HISTOGRAM, "session_tokens": _SESSION_TOKENS, "mask_round_trip": _MASK_ROUND_TRIP, "promotions": _PROMOTIONS,
    "vector_functions": _VECTOR_FUNCTIONS, "knn_cosine": _knn_sql(_COSINE, 5), "knn_l2_within": _knn_sql(_L2, 10, "d <= 1.2"), "recall_rerank": _RECALL_RERANK, "rank_fusion": _RANK_FUSION,
    "text_rank": _TEXT_RANK, "context_lines": _CONTEXT_LINES, "paragraphs": _PARAGRAPHS, "noise_flags": _NOISE_FLAGS, "similar_facts": _SIMILAR_FACTS, "uncovered_facts": _UNCOVERED_FACTS,
    "unknown_facts": _UNKNOWN_FACTS, "query_routes": _QUERY_ROUTES, "conversation_list": _CONVERSATION_LIST, "trimmed_context": _TRIMMED_CONTEXT, "context_summaries": _CONTEXT_SUMMARIES,
}
