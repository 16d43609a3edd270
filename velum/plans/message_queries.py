"""Queries over messages, masking, vectors, recall and streams, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.functions import text_sql, vectors
from velum.io import checkpoint_dir, spread, table
from velum.operators import bodies, conversation, detect, fulltext, masking, memory, neighbours, retrieval
from velum.plans import text_queries
from velum.sources import formats
from velum.streaming import bus, restore, windows

QUERIES, SQL = [], {}


def _query(sql: str | None):
    """Registers a query with its SQL, or without."""

    def add(query):
        QUERIES.append(query)
        if sql is not None:
            SQL[query.__name__] = sql
        return query

    return add


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").withColumnRenamed("turn", "idx")


# --- messages ---------------------------------------------------------------------------------------------------------

_CALLS = "SELECT conv_id, turn AS idx, role, text, CASE WHEN role = 'assistant' THEN ['c' || turn] ELSE [] END AS calls, CASE WHEN role = 'user' AND turn > 0 THEN ['c' || (turn - 1), 'c' || (turn - 3)] ELSE [] END AS results FROM conversations"


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<string>")
    call = lambda back: F.concat(F.lit("c"), F.col("idx") - back)
    return _turns(spark, sf_dir).withColumns({"calls": F.when(F.col("role") == "assistant", F.array(call(0))).otherwise(none), "results": F.when((F.col("role") == "user") & (F.col("idx") > 0), F.array(call(1), call(3))).otherwise(none)})


@_query(f"""
    WITH m AS ({_CALLS}), w AS (SELECT *, sum(octet_length(encode(text))) OVER p AS s, count(*) OVER p AS n, row_number() OVER (PARTITION BY conv_id ORDER BY idx DESC) AS b, min(idx) OVER p AS f FROM m WINDOW p AS (PARTITION BY conv_id)),
    d AS (SELECT *, s > 700 AND n > 3 AS cut, s > 700 AND n > 3 AND b > 2 AND idx <> f AS gone FROM w),
    live AS (SELECT conv_id, flatten(list(calls)) AS l FROM d WHERE NOT gone AND role = 'assistant' GROUP BY conv_id),
    kept AS (SELECT conv_id, idx, 0 AS place, role, text, CASE WHEN cut AND role = 'user' THEN list_filter(results, lambda x: list_contains(coalesce(l, []), x)) ELSE results END AS results FROM d LEFT JOIN live USING (conv_id) WHERE NOT gone),
    lines AS (SELECT conv_id, f, idx, role || ': ' || left(text, CASE WHEN role = 'user' THEN 400 ELSE 300 END) AS line FROM d WHERE gone),
    t AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY conv_id ORDER BY idx) AS t FROM lines),
    told AS (SELECT conv_id, f AS idx, 1 AS place, 'user' AS role, string_agg(line, chr(10) ORDER BY idx) AS text, [] AS results FROM t WHERE t <= 6000 GROUP BY conv_id, f)
    SELECT conv_id, idx, place, role, sha256(text) AS digest, array_to_string(list_sort(results), ',') AS results FROM (FROM kept UNION ALL FROM told)""")
def trimmed_with_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = conversation.trim_summarised(_calls(spark, sf_dir), 700, 2)
    return out.select("conv_id", "idx", "place", "role", F.sha2("text", 256).alias("digest"), F.array_join(F.array_sort("results"), ",").alias("results"))


@_query("SELECT conv_id, sum(octet_length(encode(text)))::BIGINT AS bytes, sum(octet_length(encode(text))) > 1500 AS blocked FROM conversations GROUP BY 1")
def capped_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.capped(_turns(spark, sf_dir), 1500)


_SYSTEM = "SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN NULL WHEN doc_id % 9 = 1 THEN '' WHEN doc_id % 2 = 0 THEN 'Assistant Core. ' || left(text, 40) || CASE WHEN doc_id % 4 = 0 THEN chr(10) || chr(10) ELSE '' END ELSE left(text, 40) END AS s FROM documents"


@_query(f"""SELECT doc_id, CASE WHEN s IS NULL THEN 'R' WHEN contains(s, 'Assistant Core') THEN s || CASE WHEN s = '' OR s LIKE '%' || chr(10) || chr(10) THEN '' ELSE chr(10) || chr(10) END || 'R' ELSE 'R' || s END AS system,
        array_to_string(CASE WHEN s IS NULL THEN ['R'] WHEN contains(s, 'Assistant Core') THEN [s, 'tail', 'R'] ELSE ['R', s, 'tail'] END, '|') AS blocks FROM ({_SYSTEM})""")
def merged_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recalled lines merged into system prompts that are texts and ones that are blocks."""
    i, start = F.col("doc_id"), F.substring("text", 1, 40)
    known = F.concat(F.lit("Assistant Core. "), start, F.when(i % 4 == 0, "\n\n").otherwise(""))
    docs = _docs(spark, sf_dir).select("doc_id", F.when(i % 9 == 0, F.lit(None)).when(i % 9 == 1, "").when(i % 2 == 0, known).otherwise(start).alias("s"))
    blocks = conversation.merge_recall_blocks(F.when(F.col("s").isNotNull(), F.array("s", F.lit("tail"))), F.lit("R"), "Assistant Core")
    return docs.select("doc_id", conversation.merge_recall(F.col("s"), F.lit("R"), "Assistant Core").alias("system"), F.array_join(blocks, "|").alias("blocks"))


@_query("""WITH b AS (SELECT user_id AS request, event_id AS idx, CASE WHEN event_id % 4 = 0 THEN '5m' WHEN event_id % 4 = 1 AND user_id % 2 = 0 THEN '1h' END AS ttl, event_type AS text FROM events),
    v AS (SELECT *, coalesce(max(idx) FILTER (ttl = '1h') OVER w > min(idx) FILTER (ttl <> '1h') OVER w, false) AND ttl IS DISTINCT FROM '1h' AS t FROM b WINDOW w AS (PARTITION BY request)),
    p AS (SELECT *, text = 'signup' AND row_number() OVER (PARTITION BY request, text = 'signup' ORDER BY t, idx) = 1 AS p FROM v)
    SELECT request, idx, row_number() OVER (PARTITION BY request ORDER BY p DESC, t, idx)::INT AS place FROM p""")
def ttl_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    ttl = F.when(i % 4 == 0, "5m").when((i % 4 == 1) & (F.col("user_id") % 2 == 0), "1h")
    blocks = table(spark, sf_dir, "events").select(F.col("user_id").alias("request"), i.alias("idx"), ttl.alias("ttl"), F.col("event_type").alias("text"))
    return conversation.long_ttl_first(blocks, "signup").select("request", "idx", "place")


@_query("""WITH t AS (SELECT conv_id AS request, max(turn) AS tool_idx FROM conversations WHERE length(text) % 3 <> 0 GROUP BY 1),
    m AS (SELECT conv_id AS request, min(turn) AS message_idx FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n <= 5 AND role = 'user' AND octet_length(encode(text)) >= 200 GROUP BY 1)
    SELECT request, tool_idx, message_idx FROM t FULL JOIN m USING (request)""")
def cache_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _turns(spark, sf_dir).withColumnRenamed("conv_id", "request")
    tools = rows.select("request", "idx", (F.char_length("text") % 3 == 0).alias("deferred"))
    return conversation.cache_points(tools, rows, 200)


@_query("""WITH b AS (SELECT user_id, event_id, event_type = 'click' AS image, row_number() OVER (PARTITION BY user_id, event_type = 'click' ORDER BY event_id DESC) AS r FROM events)
    SELECT user_id AS conv_id, event_id AS idx, CASE WHEN image AND r <= 3 THEN 'image' ELSE 'text' END AS kind, image AND r > 3 AS replaced FROM b""")
def culled_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    blocks = e.select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("idx"), F.lit(0).alias("block"), F.when(F.col("event_type") == "click", "image").otherwise("text").alias("kind"), F.col("event_type").alias("text"))
    return conversation.cull_images(blocks).select("conv_id", "idx", "kind", (F.col("text") == "[image left out]").alias("replaced"))


_USES = "SELECT user_id AS conv_id, event_id AS idx, event_type AS c, CASE WHEN value > 5 THEN 'click' ELSE 'view' END AS r FROM events"


def _uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = F.when(F.col("value") > 5, "click").otherwise("view")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("idx"), F.array("event_type").alias("calls"), F.array(result).alias("results"))


@_query(f"SELECT conv_id, idx, CASE WHEN lead(r) OVER w = c THEN c ELSE '' END AS call, CASE WHEN lag(c) OVER w = r THEN r ELSE '' END AS result FROM ({_USES}) WINDOW w AS (PARTITION BY conv_id ORDER BY idx)")
def repaired_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = conversation.repaired(_uses(spark, sf_dir))
    return out.select("conv_id", "idx", F.array_join("calls", ",").alias("call"), F.array_join("results", ",").alias("result"))


@_query(f"SELECT conv_id, idx, c AS call_id FROM ({_USES}) WHERE c <> r")
def orphan_server_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.orphan_calls(_uses(spark, sf_dir), same_message=True)


@_query("SELECT conv_id, turn AS idx, sha256(CASE WHEN turn % 2 = 0 THEN text ELSE text || chr(10) || 'end' END) AS digest FROM conversations")
def message_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of bodies that are JSON strings or arrays of blocks."""
    block = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    blocks = F.to_json(F.array(block("text", F.col("text")), block("image", F.lit("x")), block("text", F.lit("end"))))
    quoted = F.regexp_extract(F.to_json(F.struct(F.col("text").alias("t"))), r"^\{\"t\":(.*)\}$", 1)
    rows = _turns(spark, sf_dir).select("conv_id", "idx", F.when(F.col("idx") % 2 == 0, quoted).otherwise(blocks).alias("content"))
    return rows.select("conv_id", "idx", F.sha2(conversation.text_blocks(F.col("content")), 256).alias("digest"))


@_query(r"""WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS l, octet_length(encode(text)) > 8192 AS long FROM documents),
    p AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, text, unnest(range(2040, 8193)) AS n FROM l WHERE long AND len(l) <= 70) WHERE octet_length(encode(left(text, n::INT))) <= 8192 GROUP BY doc_id)
    SELECT doc_id, sha256(CASE WHEN NOT long THEN text WHEN len(l) > 70 THEN array_to_string(l[1:50] || ['[... ' || (len(l) - 70) || ' lines left out ...]'] || l[-20:], chr(10))
        ELSE left(text, n::INT) || chr(10) || '[... cut ...]' END) AS digest FROM l LEFT JOIN p USING (doc_id)""")
def truncated_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.sha2(conversation.truncated(F.col("text")), 256).alias("digest"))


# --- detection and masking --------------------------------------------------------------------------------------------


@_query(r"""SELECT doc_id, len(regexp_extract_all(t, '(?:^|[^.@A-Za-z0-9])(\b[a-zA-Z0-9\-]{3,}\.(?:com|io|ai|dev|app|net|org|co)\b)', 1))::INT AS n_domain, len(regexp_extract_all(t, '(?:^|[^A-Za-z0-9.])(@[a-zA-Z][a-zA-Z0-9_]{2,})', 1))::INT AS n_handle
    FROM (SELECT doc_id, text || ' see site' || doc_id || '.io, by @user_' || doc_id AS t FROM documents)""")
def domains_and_handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("text", F.lit(" see site"), "doc_id", F.lit(".io, by @user_"), "doc_id")
    docs = _docs(spark, sf_dir).select("doc_id", text.alias("t"))
    count = lambda pattern, kind: F.size(detect.spans(F.col("t"), pattern, kind))
    return docs.select("doc_id", count(detect.DOMAIN, "URL").alias("n_domain"), count(detect.HANDLE, "HANDLE").alias("n_handle"))


_TERMS = ", ".join(f"'{t}'" for t in detect.TECH_TERMS)


@_query(rf"""WITH m AS (SELECT doc_id, list_filter(regexp_extract_all(text || ' JavaScript and FalconBase then FalconBase, QuillNote' || doc_id, '\b[A-Z][a-z]{{2,}}[A-Z][a-zA-Z]+\b'), lambda x: NOT list_contains([{_TERMS}], x) AND lower(x) <> 'falconbase') AS l FROM documents)
    SELECT doc_id, len(list_distinct(list_transform(l, lambda x: lower(x))))::INT AS n_projects FROM m""")
def allowed_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CamelCase names but technical terms and allowed words."""
    docs = _docs(spark, sf_dir).select("doc_id", F.concat("text", F.lit(" JavaScript and FalconBase then FalconBase, QuillNote"), "doc_id").alias("t"))
    found = detect.entities(docs, "t", allowed=("falconbase",))
    return found.select("doc_id", F.size(F.filter("entities", lambda s: s["kind"] == "PROJECT")).alias("n_projects"))


@_query("""SELECT text, kind FROM (SELECT 'Falcon' || (p_partkey % 40) AS text, 'PROJECT' AS kind FROM part UNION SELECT 'Acme ' || (p_partkey % 30), CASE WHEN p_partkey % 2 = 0 THEN 'PROJECT' ELSE 'ORG' END FROM part
    UNION SELECT 'box' || (p_partkey % 20) || '@mail.example', 'EMAIL' FROM part)""")
def fact_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Custom entities named in facts."""
    k = F.col("p_partkey")
    content = F.concat(F.lit("uses `@Falcon"), k % 40, F.lit("/core` of 'Acme "), k % 30, F.lit("' by box"), k % 20, F.lit("@mail.example and `lower` or `DataFrame`"))
    return detect.fact_terms(table(spark, sf_dir, "part").select(content.alias("content"), F.when(k % 2 == 0, "project").alias("category")))


@_query("""SELECT c_custkey, 'Mr. [PERSON_1] of [PLACE_1] at [ORG_1] wrote [EMAIL_1] on [PROJECT_1] and [PROJECT_2]; `QuillBase c' || c_custkey || '@mail.example` stays, as does' || chr(10) || '```' || chr(10) || 'QuillBase nova' || (c_custkey % 7) || chr(10) || '```' || chr(10) || 'but [PROJECT_2] goes' AS masked,
    6 AS n_entities FROM customer""")
def masked_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, places, companies, classes, terms of facts and CamelCase masked together; code stays as it is."""
    k = F.col("c_custkey")
    text = F.concat(
        F.lit("Mr. Walter Quill of Lisbon at Quillmore Inc wrote c"), k, F.lit("@mail.example on nova"), k % 7, F.lit(" and QuillBase; `QuillBase c"), k,
        F.lit("@mail.example` stays, as does\n```\nQuillBase nova"), k % 7, F.lit("\n```\nbut quillbase goes"),
    )
    terms = F.array(F.struct(F.concat(F.lit("nova"), k % 7).alias("text"), F.lit("PROJECT").alias("kind")))
    rows = spread(table(spark, sf_dir, "customer")).select("c_custkey", text.alias("text"), terms.alias("terms"))
    return masking.anonymize(rows, "c_custkey", custom="terms").select("c_custkey", "masked", "n_entities")


@_query(f"SELECT session, original, token FROM ({text_queries.SQL['session_tokens']})")
def session_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token maps of sessions written as envelopes and read back."""
    tokens = masking.token_map(text_queries._mail_found(_docs(spark, sf_dir)))
    return masking.import_sessions(masking.export_sessions(tokens)).select("session", "original", "token")


@_query("""SELECT conv_id, turn AS idx, sha256(CASE WHEN role <> 'user' THEN 'to ada' || conv_id || '@mail.example' WHEN turn % 4 = 0 THEN 'to [EMAIL_1]' ELSE 'to [EMAIL_1], ada' || conv_id || '@mail.example' END) AS digest FROM conversations""")
def masked_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of user messages masked in their text blocks only; other blocks, answers and this caller's system messages stay."""
    mail = F.concat(F.lit("ada"), "conv_id", F.lit("@mail.example"))
    rows = _turns(spark, sf_dir).select(F.col("conv_id").alias("session"), F.col("idx").alias("turn"), "role", mail.alias("mail"))
    plain = F.concat(F.lit("to "), "mail")
    block = lambda kind, name, text: F.create_map(F.lit("type"), F.lit(kind), F.lit(name), text)
    blocks = F.to_json(F.array(block("text", "text", plain), block("tool_use", "input", F.col("mail"))))
    rows = rows.withColumn("content", F.when((F.col("role") != "user") | (F.col("turn") % 4 == 0), plain).otherwise(blocks))
    tokens = rows.groupBy("session").agg(F.min("mail").alias("original")).select("session", "original", F.lit("EMAIL").alias("kind"), F.lit("[EMAIL_1]").alias("token"), F.lit(0).cast("long").alias("first_turn"))
    out = bodies.mask_bodies(rows.drop("mail"), tokens, ("assistant", "system"))
    held = F.from_json("content", "array<map<string,string>>")
    read = F.when(F.startswith("content", F.lit("[{")), F.concat(held[0]["text"], F.lit(", "), held[1]["input"])).otherwise(F.col("content"))
    return out.select(F.col("session").alias("conv_id"), F.col("turn").alias("idx"), F.sha2(read, 256).alias("digest"))


#: A request body and one of its messages; @TEXT@, @MAIL@ and @ROLE@ are put in.
_REQUEST = '{"model":"m","temperature":0.50, "stream":true,"system":"for boss@mail.example","messages":[@ALL@],"extra":{"mail":"ada0@mail.example","n":[1,2.0,1e3,null,{}]}}'
_PLAIN = '{"role":"@ROLE@","content":"@TEXT@ from @MAIL@","id":7}'
_BLOCKS = (
    '{"role":"@ROLE@","content":[{"type":"text","text":"@TEXT@ from @MAIL@","cache_control":{"type":"ephemeral","ttl":3600}},{"type":"tool_result","tool_use_id":"c1",'
    '"content":[{"type":"text","text":"ada1@mail.example"}],"is_error":false},{"type":"image","source":{"n":5,"w":1.50,"ok":true,"x":null}}]}'
)


def _requests_sql() -> str:
    def body(mail: str) -> str:
        message = f"replace(replace(replace(CASE WHEN turn % 3 = 0 THEN '{_PLAIN}' ELSE '{_BLOCKS}' END, '@ROLE@', role), '@MAIL@', {mail}), '@TEXT@', js)"
        return f"replace('{_REQUEST}', '@ALL@', string_agg({message}, ',' ORDER BY turn))"

    return f"""
    WITH m AS (SELECT conv_id, turn, role, substr(to_json(coalesce(text, '')), 2, length(to_json(coalesce(text, ''))) - 2) AS js, CASE WHEN turn % 2 = 1 THEN upper(mail) ELSE mail END AS mail
        FROM (SELECT *, 'ada' || (turn % 3) || '@mail.example' AS mail FROM conversations)),
    f AS (SELECT conv_id, lower(mail) AS low, min(turn) AS f FROM m WHERE role <> 'assistant' GROUP BY ALL),
    t AS (SELECT conv_id, low, '[EMAIL_' || row_number() OVER (PARTITION BY conv_id ORDER BY f) || ']' AS token FROM f)
    SELECT m.conv_id, count(DISTINCT token)::INT AS n_entities, sha256({body("CASE WHEN role = 'assistant' THEN mail ELSE token END")}) AS masked, sha256(lower({body("mail")})) AS restored
    FROM m LEFT JOIN t ON m.conv_id = t.conv_id AND lower(mail) = low GROUP BY m.conv_id"""


@_query(_requests_sql())
def masked_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole request bodies with nested blocks, masked in the texts of all roles but assistant and restored again."""
    mail = F.concat(F.lit("ada"), (F.col("idx") % 3).cast("string"), F.lit("@mail.example"))
    js = F.to_json(F.array(F.coalesce("text", F.lit(""))))
    message = F.when(F.col("idx") % 3 == 0, F.lit(_PLAIN)).otherwise(F.lit(_BLOCKS))
    for mark, value in (("@ROLE@", F.col("role")), ("@MAIL@", F.when(F.col("idx") % 2 == 1, F.upper(mail)).otherwise(mail)), ("@TEXT@", F.substring(js, F.lit(3), F.char_length(js) - 4))):
        message = F.replace(message, F.lit(mark), value)
    rows = _turns(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("idx", message.alias("m")))).alias("all"))
    requests = rows.select(F.col("conv_id").alias("session"), F.lit(0).cast("long").alias("turn"), F.replace(F.lit(_REQUEST), F.lit("@ALL@"), F.array_join(F.transform("all", lambda x: x["m"]), ",")).alias("body"))

    def mails(texts: DataFrame, ids: list[str], text: str) -> DataFrame:
        found = texts.select(*ids, F.posexplode_outer(detect.spans(F.col(text), detect.EMAIL, "EMAIL")).alias("ord", "e")).where("ord IS NOT NULL")
        return found.select(*ids, "ord", "e.start", "e.text", "e.kind")

    out, tokens = bodies.mask_requests(requests, mails)
    back = bodies.restore_bodies(out, tokens).select("session", F.sha2(F.lower("body"), 256).alias("restored"))
    return out.join(back, "session").select(F.col("session").alias("conv_id"), F.col("n_entities").cast("int").alias("n_entities"), F.sha2("body", 256).alias("masked"), "restored")


@_query(rf"""WITH m AS (SELECT source AS session, unnest(regexp_extract_all(text, '{text_queries._RE_EMAIL}')) AS t FROM documents), t AS ({text_queries.SQL['session_tokens']})
    SELECT m.session, token, count(*) AS n FROM m JOIN t ON m.session = t.session AND lower(m.t) = lower(original) GROUP BY 1, 2""")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each token of a session stands in its masked documents."""
    docs = _docs(spark, sf_dir)
    found = text_queries._mail_found(docs)
    tokens = masking.token_map(found)
    turns = docs.select(F.col("source").alias("session"), F.col("doc_id").alias("turn"), "text")
    return masking.occurrences(masking.mask_found(turns, found, tokens), tokens)


# --- vectors and recall -----------------------------------------------------------------------------------------------


@_query("""SELECT vec_id, '[' || array_to_string(list_transform(embedding[1:3], lambda x: printf('%.6f', x::DOUBLE)), ',') || ']' AS js, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))), 6) AS l2,
        len(list_filter(embedding, lambda x: x > 0))::INT AS differing, 8 AS bytes, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total, 3 AS dims FROM embeddings""")
def vector_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector functions in SQL text, the table function among them."""
    vectors.register(spark)
    table(spark, sf_dir, "embeddings").selectExpr("vec_id", "CAST(embedding AS ARRAY<DOUBLE>) AS v").createOrReplaceTempView("_velum_vectors")
    return spark.sql("""
        SELECT vec_id, vec_to_json(vec_slice(v, 0, 3)) AS js, round(vec_distance_l2(v, transform(v, x -> 0.0D)), 6) AS l2, vec_distance_hamming(vec_quantize_binary(v), transform(sequence(1, 8), x -> CAST(0 AS TINYINT))) AS differing,
            size(vec_quantize_binary(v)) AS bytes, round((SELECT sum(value) FROM vec_each(v)), 6) AS total, vec_length(vec_f32(vec_to_json(vec_slice(v, 0, 3)))) AS dims
        FROM _velum_vectors""")


@_query("SELECT vec_id, 64 AS dims, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total, CASE WHEN vec_id % 2 = 0 THEN 'float32' ELSE 'int8' END AS kind FROM embeddings")
def blob_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as bytes of 32-bit floats and back, and the type that a vector is of."""
    rows = vectors.to_blob(table(spark, sf_dir, "embeddings"), "embedding", "blob").select("vec_id", "blob")
    back = vectors.from_blob(rows, "blob", "v", 64)
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double"))
    kinds = F.when(F.col("vec_id") % 2 == 0, vectors.kind(F.col("v"))).otherwise(vectors.kind(vectors.quantize_int8(F.col("v"))))
    return back.select("vec_id", F.size("v").alias("dims"), F.round(total, 5).alias("total"), kinds.alias("kind"))


_COSINE = "CASE WHEN q.vec_id = e.vec_id THEN 0 ELSE 1 - list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) END"
_L2 = "list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[])"


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.lit("License").alias("query"), F.col("embedding").alias("vector"), "label")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return e.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "lang"), "id")


@_query(f"""WITH d AS (SELECT q.vec_id AS query_id, e.vec_id AS id, {_COSINE} AS d FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0 JOIN documents ON doc_id = e.vec_id WHERE lang = 'en' AND e.label >= 2 AND e.label = q.label),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id)::INT AS rank FROM d) SELECT query_id, id, rank FROM r WHERE rank <= 7""")
def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest rows among those that plain predicates leave, of the query's own label."""
    rows = _rows(spark, sf_dir).where("lang = 'en' AND label >= 2")
    return retrieval.knn(_queries(spark, sf_dir), rows, 7, by="label").select("query_id", "id", "rank")


@_query(f"""WITH d AS (SELECT q.vec_id AS query_id, e.vec_id AS id, e.vec_id % 3 AS type, {_L2} AS d FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0 WHERE e.vec_id % 3 <> 2),
    h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, type ORDER BY d, id) AS r FROM d) WHERE r <= 50),
    s AS (SELECT query_id, id, type, left(trim(text), 200) AS p, 1 / (1 + d) * (0.3 + 0.7 * least(1.0, octet_length(encode(text)) / 150)) + CASE WHEN contains(lower(text), 'license') THEN 0.02 ELSE 0 END AS score FROM h JOIN documents ON id = doc_id),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, p ORDER BY score DESC, id) AS n FROM s) WHERE n = 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM b)
    SELECT query_id, id, CASE type WHEN 0 THEN 'episodic' ELSE 'semantic' END AS type, round(score, 6) AS score, rank FROM r WHERE rank <= 5""")
def typed_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall over the types asked for, each over-fetched, reranked together."""
    rows = _rows(spark, sf_dir)
    stores = {name: rows.where(F.col("id") % 3 == i) for i, name in enumerate(("episodic", "semantic", "identity"))}
    out = retrieval.recall(_queries(spark, sf_dir), stores, 5, ("episodic", "semantic"))
    return out.select("query_id", "id", "type", F.round("score", 6).alias("score"), "rank")


@_query(f"""WITH d AS (SELECT q.vec_id AS query_id, e.vec_id AS id, {_COSINE} AS d FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0 AND e.vec_id IN (SELECT doc_id FROM documents)),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS g FROM d),
    s AS (SELECT query_id, id, 1.0::DOUBLE / (60 + g) + CASE WHEN contains(lower(text), 'license') THEN 0.02 ELSE 0 END AS score FROM r JOIN documents ON doc_id = id WHERE g <= 15 AND id % 3 <> 0),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM s) SELECT query_id, id, round(score, 6) AS score, rank FROM o WHERE rank <= 5""")
def recall_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall from one index over all types, which are filtered after the search."""
    near = retrieval.knn(_queries(spark, sf_dir), _rows(spark, sf_dir), 15).join(_rows(spark, sf_dir).select("id", "content"), "id")
    kind = F.when(F.col("id") % 3 == 0, "identity").when(F.col("id") % 3 == 1, "episodic").otherwise("semantic")
    out = retrieval.recall_after(near.withColumns({"query": F.lit("License"), "type": kind}), 5, ("episodic", "semantic"))
    return out.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


_ASKED = [(0, "is licensed under"), (100, "mit license"), (200, "in the")]


@_query(f"""WITH t AS (SELECT * FROM ({text_queries.SQL['text_rank'].replace(text_queries._TEXT_VALUES, ', '.join(f"({i}::BIGINT, '{t}')" for i, t in _ASKED)).replace('rank <= 10', 'rank <= 20')})),
    x AS (SELECT q.vec_id AS query_id, e.vec_id AS id, {_COSINE} AS d FROM embeddings q JOIN embeddings e ON q.vec_id IN (0, 100, 200) AND e.vec_id IN (SELECT doc_id FROM documents)),
    v AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM x),
    u AS (SELECT query_id, id, rank FROM v WHERE rank <= 20 UNION ALL SELECT query_id, id, rank FROM t),
    s AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM u GROUP BY 1, 2),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM s) SELECT query_id, round(score, 6) AS score, rank FROM o WHERE rank <= 8""")
def hybrid_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors and best texts of one store, fused by rank."""
    e = table(spark, sf_dir, "embeddings")
    asked = spark.createDataFrame(_ASKED, "query_id long, query string").join(e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), "query_id")
    rows = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("text").alias("content")).join(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), "id", "left")
    return retrieval.hybrid(asked, rows, 8, 20).select("query_id", F.round("score", 6).alias("score"), "rank")


def _chunks(sent: DataFrame, size: int, originals: dict[str, str]) -> DataFrame:
    """Chunks of `size` characters of texts (stream_id, s), the first with the tokens; a text is cut up in one pass."""
    parts = sent.select("stream_id", F.regexp_extract_all("s", F.lit(f"(?s)(.{{1,{size}}})"), 1).alias("p"))
    cut = parts.select("stream_id", F.size("p").alias("n"), F.posexplode_outer("p").alias("i", "payload"))
    tokens = F.when(F.col("i") == 0, F.create_map(*(F.lit(x) for pair in originals.items() for x in pair)))
    return cut.select("stream_id", F.col("i").cast("long").alias("seq"), "payload", (F.col("i") == F.col("n") - 1).alias("final"), tokens.alias("tokens"))


@_query("SELECT conv_id || '/' || turn AS stream_id, sha256('Ada ' || text || ' Acme [x') AS digest FROM conversations")
def restored_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Server-sent events cut anywhere, with tokens split over deltas of both provider shapes, restored and read back."""
    c = spread(table(spark, sf_dir, "conversations")).select(F.concat_ws("/", "conv_id", "turn").alias("stream_id"), "turn", F.concat(F.lit("[PERSON_1] "), "text", F.lit(" [ORG_12]")).alias("t"))
    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.char_length("t") / 7).cast("int")), lambda i: F.substring(F.col("t"), i * 7 + 1, F.lit(7)))
    block = lambda p: F.to_json(F.struct(F.lit("content_block_delta").alias("type"), F.struct(F.lit("text_delta").alias("type"), p.alias("text")).alias("delta")))
    choice = lambda p: F.to_json(F.struct(F.array(F.struct(F.struct(p.alias("content")).alias("delta"))).alias("choices")))
    frame = lambda body: F.concat(F.lit("data: "), body, F.lit("\n\n"))
    whole = F.when(F.col("turn") % 2 == 0, F.array_join(F.transform(pieces, lambda p: frame(block(p))), "")).otherwise(F.array_join(F.transform(pieces, lambda p: frame(choice(p))), ""))
    sent = c.select("stream_id", F.concat(whole, F.lit("data: [DONE]\n\n")).alias("s"))
    chunks = _chunks(sent, 50, {"[PERSON_1]": "Ada", "[ORG_12]": "Acme [x"})
    out = restore.restore_frames_batch(chunks).groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "payload"))), lambda x: x["payload"]), "").alias("payload"))
    said = F.coalesce(F.get_json_object("data", "$.delta.text"), F.get_json_object("data", "$.choices[0].delta.content"))
    read = restore.sse_events(out).select("stream_id", "seq", said.alias("text")).where("text IS NOT NULL")
    joined = read.groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "").alias("t"))
    return joined.select("stream_id", F.sha2("t", 256).alias("digest"))


def _tool_input(person: str, org: str) -> str:
    return f"""'{{"to":"{person}","body":' || to_json(coalesce(text, '')) || ',"from":["{org}",1.50]}}'"""


_PERSON, _ORG = 'A"d\\a', "Ac\nme é"


@_query(f"""SELECT conv_id || '/' || turn AS stream_id, sha256({_tool_input('A\\"d\\\\a', 'Ac\\nme é')}) AS first, sha256({_tool_input('Ac\\nme é', 'A\\"d\\\\a')}) AS second FROM conversations""")
def restored_tool_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tool inputs streamed as interleaved JSON fragments, with originals that need JSON's escapes, read back."""
    c = spread(table(spark, sf_dir, "conversations"))
    js = F.to_json(F.array(F.coalesce("text", F.lit(""))))
    whole = lambda a, b: F.concat(F.lit(f'{{"to":"{a}","body":'), F.substring(js, F.lit(2), F.char_length(js) - 2), F.lit(f',"from":["{b}",1.50]}}'))
    t = c.select(F.concat_ws("/", "conv_id", "turn").alias("stream_id"), whole("[PERSON_1]", "[ORG_12]").alias("t0"), whole("[ORG_12]", "[PERSON_1]").alias("t1"))
    delta = lambda i, p: F.to_json(F.struct(F.lit("content_block_delta").alias("type"), F.lit(i).alias("index"), F.struct(F.lit("input_json_delta").alias("type"), p.alias("partial_json")).alias("delta")))
    part = lambda n, i: F.concat(F.lit("data: "), delta(n, F.substring(F.col(f"t{n}"), i * 9 + 1, F.lit(9))), F.lit("\n\n"))
    places = F.sequence(F.lit(0), F.floor(F.greatest(F.char_length("t0"), F.char_length("t1")) / 9).cast("int"))
    sent = t.select("stream_id", F.concat(F.array_join(F.transform(places, lambda i: F.concat(part(0, i), part(1, i))), ""), F.lit('data: {"type":"message_stop"}\n\n')).alias("s"))
    chunks = _chunks(sent, 70, {"[PERSON_1]": _PERSON, "[ORG_12]": _ORG})
    out = restore.restore_frames_batch(chunks).groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "payload"))), lambda x: x["payload"]), "").alias("payload"))
    read = restore.sse_events(out).select("stream_id", "seq", F.get_json_object("data", "$.index").alias("n"), F.get_json_object("data", "$.delta.partial_json").alias("text")).where("text IS NOT NULL")
    of = lambda n: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("n") == n, F.struct("seq", "text")))), lambda x: x["text"]), ""), 256)
    return read.groupBy("stream_id").agg(of("0").alias("first"), of("1").alias("second"))


#: Queries, and of each stem in them the words that have it.
_STEMMED = [(1, "the licensing of works"), (2, "GNU licenses"), (3, "generally public, a licensed version"), (4, "license"), (5, "of the"), (6, "licensed under version 3")]
_FORMS = {"licens": "license licenses licensed licensing", "work": "work works worked working", "gnu": "gnu", "general": "general generals generally generalize generalized", "public": "public publics", "version": "version versions", "3": "3"}
_STEMS = {1: ["licens", "work"], 2: ["gnu", "licens"], 3: ["general", "licens", "public", "version"], 4: ["licens"], 6: ["3", "licens", "version"]}


def _stemmed_sql() -> str:
    forms = ", ".join(f"('{k}', '{word}')" for k, v in _FORMS.items() for word in v.split())
    asked = ", ".join(f"({q}::BIGINT, {t}, '{x}', {len(words)})" for q, words in _STEMS.items() for t, x in enumerate(words))
    last = ", ".join(f"max(CASE WHEN t = {k} THEN i END) OVER w AS l{k}" for k in range(4))
    return f"""
    WITH forms(lexeme, word) AS (VALUES {forms}), q(query_id, t, lexeme, need) AS (VALUES {asked}),
    d AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
    words AS (SELECT id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS place FROM d),
    e AS (SELECT query_id, id, place, t, need, row_number() OVER (PARTITION BY query_id, id ORDER BY place) AS i FROM words JOIN forms USING (word) JOIN q USING (lexeme)),
    l AS (SELECT *, {last} FROM e WINDOW w AS (PARTITION BY query_id, id ORDER BY i)),
    b AS (SELECT *, CASE need WHEN 1 THEN l0 WHEN 2 THEN CASE WHEN l0 > 0 AND l1 > 0 THEN least(l0, l1) END WHEN 3 THEN CASE WHEN l0 > 0 AND l1 > 0 AND l2 > 0 THEN least(l0, l1, l2) END
        ELSE CASE WHEN l0 > 0 AND l1 > 0 AND l2 > 0 AND l3 > 0 THEN least(l0, l1, l2, l3) END END AS b FROM l),
    c AS (SELECT query_id, id, b, min(i) AS i FROM b WHERE b IS NOT NULL GROUP BY 1, 2, 3),
    s AS (SELECT c.query_id, c.id, sum(0.1::DOUBLE / (1 + (y.place - x.place) - (c.i - c.b))) AS score
        FROM c JOIN e x ON x.query_id = c.query_id AND x.id = c.id AND x.i = c.b JOIN e y ON y.query_id = c.query_id AND y.id = c.id AND y.i = c.i GROUP BY 1, 2),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id)::INT AS rank FROM s)
    SELECT query_id, id, round(score, 6) AS score, rank FROM o WHERE rank <= 10"""


@_query(_stemmed_sql())
def stemmed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with all stems of a query, stop words aside, by cover density."""
    asked = spark.createDataFrame(_STEMMED, "query_id long, query string")
    out = fulltext.search(asked, _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("text").alias("content")), 10)
    return out.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@_query(text_queries.SQL["knn_cosine"])
def knn_by_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest neighbours through inverted lists, with the lists read that exactness asks for."""
    e = table(spark, sf_dir, "embeddings")
    index = neighbours.build(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")))
    found = neighbours.search(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), index, 5, 4, exact=True)
    return found.select("query_id", "id", F.round("distance", 6).alias("distance"), "rank")


_IN_ORDER = """
    WITH RECURSIVE f AS (SELECT *, row_number() OVER (ORDER BY vec_id) AS i FROM embeddings WHERE vec_id % 5 = 0),
    p AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b, list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS c FROM f x JOIN f y ON x.label = y.label AND x.vec_id < y.vec_id WHERE list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) >= 0.3),
    m AS (SELECT f.vec_id AS id, n.vec_id AS node, list_cosine_similarity(f.embedding::DOUBLE[], n.embedding::DOUBLE[]) AS c FROM f JOIN embeddings n ON f.label = n.label AND n.vec_id % 5 <> 0),
    n AS (SELECT id, node, c FROM m WHERE c >= 0.3 QUALIFY row_number() OVER (PARTITION BY id ORDER BY c DESC, node) = 1),
    l AS MATERIALIZED (SELECT f.i, f.vec_id AS id, any_value(n.node) AS node, coalesce(list(p.a) FILTER (p.a IS NOT NULL), []) AS earlier FROM f LEFT JOIN n ON n.id = f.vec_id LEFT JOIN p ON p.b = f.vec_id GROUP BY 1, 2),
    s(i, made) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
        SELECT l.i, CASE WHEN node IS NULL AND len(list_intersect(made, earlier)) = 0 THEN list_append(made, id) ELSE made END FROM s JOIN l ON l.i = s.i + 1),
    made AS (SELECT unnest(made) AS id FROM s WHERE i = (SELECT max(i) FROM s)),
    o AS (SELECT id, node, NULL::BIGINT AS as_fact, c, 0 AS new FROM n UNION ALL SELECT b, NULL, a, c, 1 FROM p WHERE a IN (SELECT id FROM made)),
    best AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(c, 12) DESC, new, coalesce(node, as_fact)) = 1)
    SELECT f.vec_id AS fact_id, node AS node_id, CASE WHEN c IS NULL THEN f.vec_id ELSE as_fact END AS as_fact, round(c, 6) AS cosine, CASE WHEN c IS NULL THEN 'insert' ELSE 'reinforce' END AS action
    FROM f LEFT JOIN best ON best.id = f.vec_id"""


@_query(_IN_ORDER)
def promoted_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts promoted one after the other: what earlier facts have become counts for later ones."""
    e = table(spark, sf_dir, "embeddings")
    of = lambda rows, name: rows.select(F.col("vec_id").alias(name), F.col("label").alias("profile"), F.col("embedding").alias("vector"))
    out = memory.promote_in_order(of(e.where("vec_id % 5 = 0"), "fact_id"), of(e.where("vec_id % 5 != 0"), "node_id"), 0.3)
    return out.select("fact_id", "node_id", "as_fact", F.round("cosine", 6).alias("cosine"), "action")


@_query(rf"""WITH e AS (SELECT doc_id, regexp_extract_all(text, '{text_queries._RE_EMAIL}') AS l FROM documents)
    SELECT d.doc_id, len(list_distinct(list_transform(l, lambda x: lower(x))))::BIGINT AS n_mails, 0 AS n_left, sha256(text) AS restored,
        CASE WHEN length(text) <= 1500 THEN 1 ELSE greatest(1, len(list_filter(string_split_regex(text, '\n\s*\n'), lambda x: length(trim(x)) >= 20))) END::BIGINT AS n_chunks
    FROM documents d JOIN e USING (doc_id)""")
def sql_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection, token maps, masks, restoring and chunks in SQL text alone."""
    text_sql.register(spark)
    _docs(spark, sf_dir).select("doc_id", "text").createOrReplaceTempView("_velum_documents")
    return spark.sql(rf"""
        WITH found AS (SELECT doc_id, array_sort(collect_list(struct(start, s.text AS text, kind))) AS e FROM _velum_documents d, LATERAL text_spans(d.text) s WHERE kind = 'EMAIL' GROUP BY doc_id),
        maps AS (SELECT doc_id, size(e) AS n, token_map_of(transform(e, x -> struct(x.text, x.kind))) AS m FROM found),
        masked AS (SELECT d.doc_id, text, n, m, CASE WHEN m IS NULL THEN text ELSE mask_text(text, m) END AS masked FROM _velum_documents d LEFT JOIN maps USING (doc_id)),
        parts AS (SELECT doc_id, count(*) AS n_chunks FROM _velum_documents d, LATERAL text_chunks(d.text) GROUP BY doc_id)
        SELECT doc_id, coalesce(n, 0L) AS n_mails, regexp_count(masked, r'{detect.EMAIL}') AS n_left, sha2(CASE WHEN m IS NULL THEN masked ELSE restore_text(masked, m) END, 256) AS restored, n_chunks
        FROM masked JOIN parts USING (doc_id)""")


# --- backups -----------------------------------------------------------------------------------------------------------

_RELATIONS = {"nation": [("regionkey", "region")], "customer": [("nationkey", "nation")], "orders": [("custkey", "customer")]}


@_query("""WITH r AS (SELECT r_regionkey AS id FROM region WHERE r_regionkey <> 2),
    n AS (SELECT n_nationkey AS id FROM nation WHERE n_regionkey IN (SELECT id FROM r)),
    c AS (SELECT c_custkey AS id, c_custkey % 7 = 0 AS mine FROM customer WHERE c_custkey % 7 = 0 OR c_nationkey IN (SELECT id FROM n)),
    o AS (SELECT o_orderkey AS id FROM orders WHERE o_custkey IN (SELECT id FROM c))
    SELECT 'region' AS name, count(*) AS n, sum(id)::BIGINT AS ids, 0 AS mine FROM r UNION ALL SELECT 'nation', count(*), sum(id)::BIGINT, 0 FROM n
    UNION ALL SELECT 'customer', count(*), sum(id)::BIGINT, count(*) FILTER (mine) FROM c UNION ALL SELECT 'orders', count(*), sum(id)::BIGINT, 0 FROM o""")
def restored_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A backup of four tables that refer to each other, restored over a store with rows of its own; orphans are left out."""
    t = lambda name, key, *rest: table(spark, sf_dir, name).select(F.col(key).alias("id"), *(F.col(c).alias(c.split("_")[1]) for c in rest))
    tables = {
        "region": t("region", "r_regionkey", "r_name").where("id != 2"), "nation": t("nation", "n_nationkey", "n_regionkey", "n_name"),
        "customer": t("customer", "c_custkey", "c_nationkey", "c_name"), "orders": t("orders", "o_orderkey", "o_custkey", "o_orderdate").withColumnRenamed("orderdate", "created_at"),
    }
    path = f"{checkpoint_dir(spark).rstrip('/')}/velum-backup-{uuid.uuid4().hex}"
    formats.backup(tables, path)
    held = {name: df.limit(0) for name, df in tables.items()} | {"customer": tables["customer"].where("id % 7 = 0").withColumn("name", F.lit("mine"))}
    out, both = formats.restored(spark, path, held, True, _RELATIONS), None
    for name, df in out.items():
        mine = F.count(F.when(F.col("name") == "mine", 1)) if name == "customer" else F.lit(0).cast("long")
        row = df.agg(F.count("*").alias("n"), F.sum("id").alias("ids"), mine.alias("mine")).select(F.lit(name).alias("name"), "n", "ids", "mine")
        both = row if both is None else both.unionAll(row)
    return both


# --- the bus and event time --------------------------------------------------------------------------------------------


@_query("""WITH subs AS (SELECT DISTINCT event_type || '-log' AS subscriber, event_type AS kind FROM events UNION ALL SELECT 'all', '*'),
    polls AS (SELECT subscriber, kind, event_id AS p FROM subs CROSS JOIN events WHERE event_id % 700 = 0),
    sent AS (SELECT subscriber, kind, event_id AS s FROM subs JOIN events ON kind = event_type OR kind = '*'),
    due AS (SELECT x.subscriber, x.kind, s, p FROM sent x ASOF JOIN polls y ON x.subscriber = y.subscriber AND x.kind = y.kind AND x.s <= y.p),
    got AS (SELECT subscriber, kind, p, count(*) AS n, list(s ORDER BY s DESC)[1:256] AS l FROM due GROUP BY 1, 2, 3)
    SELECT subscriber, kind, p AS seq, coalesce(len(l), 0)::BIGINT AS delivered, coalesce(n - len(l), 0)::BIGINT AS lost, l[-1] AS first, l[1] AS last FROM polls LEFT JOIN got USING (subscriber, kind, p)""")
def bus_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What subscribers to one kind of event or to all of them get at each poll, and what their bounded bus has lost."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("kind"))
    everything = spark.createDataFrame([("all", bus.ANY)], "subscriber string, kind string")
    subscriptions = e.select("kind").distinct().select(F.concat("kind", F.lit("-log")).alias("subscriber"), "kind").unionAll(everything)
    who = subscriptions.select("subscriber").distinct()
    polls = e.where("seq % 700 = 0").select("seq", F.lit(1).alias("one")).join(who.withColumn("one", F.lit(1)), "one").select("subscriber", "seq")
    return bus.deliveries(bus.subscribed(e, subscriptions, polls))


@_query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 12 HOURS THEN 0 ELSE 1 END AS fresh FROM events WHERE ts IS NOT NULL),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
    SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 43200000000 AS end_us, count(*) AS n, round(sum(value), 3) AS total FROM s GROUP BY user_id, s""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user by event time, 12 hours apart."""
    found = windows.sessions(table(spark, sf_dir, "events"), "user_id", "ts", "value", "12 hours")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return found.select("user_id", us("start").alias("start_us"), us("end").alias("end_us"), "n", F.round("total", 3).alias("total"))


# --- choices that depend on earlier ones -------------------------------------------------------------------------------

_FOLD = """list_reduce(list({{'seq': event_id, 'at': {value}, 'held': []::DOUBLE[], 'out': []::BOOLEAN[]}} ORDER BY {order}), lambda a, x: {step}, {{'seq': 0::BIGINT, 'at': 0::DOUBLE, 'held': []::DOUBLE[], 'out': []::BOOLEAN[]}})"""
_LIVE = "list_filter(a.held, lambda t: t >= x.at - 40000000000)"
_ADMIT = f"{{'seq': x.seq, 'at': x.at, 'held': CASE WHEN len({_LIVE}) < 5 THEN list_append({_LIVE}, x.at) ELSE {_LIVE} END, 'out': list_append(a.out, len({_LIVE}) < 5)}}"
_NEXT = "list_append(a.held, x.at)[-5:]"
_FIRES = f"len({_NEXT}) = 5 AND x.at > 50 AND x.at - ({_NEXT})[1] >= 20 AND x.at > ({_NEXT})[4]"
_GROW = f"{{'seq': x.seq, 'at': x.at, 'held': CASE WHEN {_FIRES} THEN []::DOUBLE[] ELSE {_NEXT} END, 'out': list_append(a.out, {_FIRES})}}"


def _folded(value: str, order: str, step: str, out: str) -> str:
    made = _FOLD.format(value=value, order=order, step=step)
    return f"SELECT key, unnest(seqs) AS seq, unnest(f.out) AS {out} FROM (SELECT user_id::VARCHAR AS key, list(event_id ORDER BY {order}) AS seqs, {made} AS f FROM events GROUP BY user_id)"


#: SQL for queries of other modules that fold the rows of a key or settle in a loop.
SQL_ELSEWHERE = {
    "rate_limited": _folded("epoch_us(ts)::DOUBLE", "ts, event_id", _ADMIT, "admitted"),
    "runaway_growth": _folded("floor(value * 4)::DOUBLE", "event_id", _GROW, "fired"),
    "truncated_texts": SQL["truncated_digests"].replace("sha256(CASE WHEN NOT long", "(CASE WHEN NOT long").replace("END) AS digest", "END) AS text"),
    "fact_clusters": f"""
        WITH RECURSIVE p AS MATERIALIZED ({text_queries.SQL['similar_facts']}), f AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS n FROM ({text_queries._USER_FACTS})),
        near AS MATERIALIZED (SELECT f.n, f.id, coalesce(list(p.a ORDER BY p.a) FILTER (p.a IS NOT NULL), []) AS before FROM f LEFT JOIN p ON p.b = f.id GROUP BY f.n, f.id),
        r AS (SELECT 0::BIGINT AS n, 0::BIGINT AS id, 0::BIGINT AS seed, []::BIGINT[] AS seeds UNION ALL
            SELECT x.n, x.id, coalesce(list_min(list_intersect(x.before, r.seeds)), x.id), CASE WHEN len(list_intersect(x.before, r.seeds)) > 0 THEN r.seeds ELSE list_append(r.seeds, x.id) END FROM r JOIN near x ON x.n = r.n + 1)
        SELECT id, seed FROM r WHERE n > 0""",
}
