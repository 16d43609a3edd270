"""Queries over records of the memory store and its upkeep, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.io import table
from velum.operators import ledger, memory, retrieval, store

QUERIES, SQL = [], {}


def _query(sql: str):
    """Registers a query with its SQL."""

    def add(query):
        QUERIES.append(query)
        SQL[query.__name__] = sql
        return query

    return add


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


# --- lists ------------------------------------------------------------------------------------------------------------

_NODES = """SELECT event_id AS id, least(value / 100, 1.0) AS confidence, (event_id * 37) % 101 / 100 AS decay_score, ts AS created_at FROM events"""


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(
        F.col("event_id").alias("id"), F.least(F.col("value") / 100, F.lit(1.0)).alias("confidence"),
        ((F.col("event_id") * 37) % 101 / 100).alias("decay_score"), F.col("ts").alias("created_at"),
    )


@_query(f"SELECT id FROM ({_NODES}) WHERE confidence >= 0.1 AND decay_score >= 0.2 ORDER BY created_at DESC, id DESC LIMIT 1000")
def recent_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.recent_nodes(_nodes(spark, sf_dir), 1000, 0.1, 0.2).select("id")


@_query("""SELECT * FROM (SELECT 'all' AS asked, n_nationkey AS id, n_name AS name FROM nation)
    UNION ALL SELECT 'one', min(n_nationkey), min(n_name) FROM nation WHERE n_name = (SELECT max(n_name) FROM nation WHERE n_nationkey = 7)""")
def profile_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All profiles, and the one with the name of the eighth."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.timestamp_seconds(F.col("n_nationkey")).alias("created_at"))
    name = rows.where("id = 7").first()["name"]  # one row
    shape = lambda df, asked: df.select(F.lit(asked).alias("asked"), "id", "name")
    return shape(store.profiles(rows), "all").unionByName(shape(store.profiles(rows, name), "one"))


_EPISODES = """SELECT event_id AS id, 'user' || (user_id % 3) AS profile, event_type || ' with details ' || props AS content, ts AS occurred_at,
    CASE WHEN event_id % 3 = 0 THEN '{"role": "assistant"}' WHEN event_id % 7 = 0 THEN '{"type": "digest"}' ELSE '{"role": "user"}' END AS metadata FROM events"""


def _episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = F.when(F.col("event_id") % 3 == 0, '{"role": "assistant"}').when(F.col("event_id") % 7 == 0, '{"type": "digest"}').otherwise('{"role": "user"}')
    return _events(spark, sf_dir).select(
        F.col("event_id").alias("id"), F.concat(F.lit("user"), F.col("user_id") % 3).alias("profile"),
        F.concat("event_type", F.lit(" with details "), "props").alias("content"), F.col("ts").alias("occurred_at"), meta.alias("metadata"),
    )


@_query(f"""SELECT count(*) AS n FROM ({_EPISODES}) WHERE occurred_at >= TIMESTAMP '2024-01-05' AND occurred_at < TIMESTAMP '2024-01-20' AND length(content) >= 20
    AND json_extract_string(metadata, '$.type') IS DISTINCT FROM 'digest'""")
def window_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.window(_episodes(spark, sf_dir), "2024-01-05 00:00:00", "2024-01-20 00:00:00").agg(F.count("*").alias("n"))


@_query(f"""SELECT id, profile FROM ({_EPISODES}) WHERE json_extract_string(metadata, '$.role') = 'user' AND length(content) >= 20
    AND occurred_at >= TIMESTAMP '2024-02-01' - INTERVAL 20 DAY""")
def user_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    since = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz") - F.expr("INTERVAL 20 DAYS")
    return memory.user_texts(_episodes(spark, sf_dir).withColumn("occurred_at", F.col("occurred_at").cast("timestamp_ntz")), since).select("id", "profile")


_PLANS = "SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN 'The user plans to ' WHEN 1 THEN 'User is MIGRATING from ' WHEN 2 THEN 'always Planning ' ELSE 'likes ' END || event_type AS content FROM events"


@_query(f"SELECT id FROM ({_PLANS}) WHERE id % 5 IN (0, 1, 2) AND NOT contains(content, 'always')")
def stale_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 5
    start = F.when(k == 0, "The user plans to ").when(k == 1, "User is MIGRATING from ").when(k == 2, "always Planning ").otherwise("likes ")
    return memory.future_plans(_events(spark, sf_dir).select(F.col("event_id").alias("id"), F.concat(start, "event_type").alias("content")), ("always",)).select("id")


@_query(f"""WITH p AS (SELECT id, content, id % 5 IN (0, 1, 2) AND NOT contains(content, 'always') AS plan FROM ({_PLANS})),
    d AS (SELECT *, CASE WHEN plan THEN CASE id % 6 WHEN 0 THEN 'completed' WHEN 1 THEN 'abandoned' WHEN 2 THEN 'stale' WHEN 3 THEN 'error' WHEN 4 THEN 'completed' ELSE 'keep' END END AS status FROM p)
    SELECT id, CASE WHEN status = 'completed' AND id % 6 = 0 THEN 'The user did no ' || id ELSE content END AS content, CASE WHEN status = 'completed' AND id % 6 = 0 THEN 0.9::DOUBLE ELSE 0.5 END AS confidence, status
    FROM d WHERE status IS NULL OR status <> 'abandoned'""")
def reviewed_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts after the review of plans that may be stale, by answers as a classifier gives them, fenced, bare or broken."""
    k = F.col("event_id") % 5
    start = F.when(k == 0, "The user plans to ").when(k == 1, "User is MIGRATING from ").when(k == 2, "always Planning ").otherwise("likes ")
    facts = _events(spark, sf_dir).select(F.col("event_id").alias("id"), F.concat(start, "event_type").alias("content"), F.lit(0.5).alias("confidence"))
    n = F.col("id") % 6
    status = lambda x, more="": F.lit(f'{{"status": "{x}", "reason": "so"{more}}}')
    done = F.concat(F.lit('```json\n{"status": "completed", "rewrite": "The user did no '), "id", F.lit('"}\n```'))
    answer = F.when(n == 0, done).when(n == 1, status("abandoned")).when(n == 2, status("stale")).when(n == 3, F.lit("I can't tell")).when(n == 4, status("completed", ', "rewrite": ""')).otherwise(status("keep"))
    answers = memory.future_plans(facts, ("always",)).select("id", answer.alias("answer"))
    return memory.reviewed(facts, memory.review_decisions(answers))


@_query("""WITH r AS (SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'work' WHEN 1 THEN 'public' ELSE 'home' END AS profile, CASE WHEN p_size % 2 = 0 THEN 'identity' ELSE 'episodic' END AS kind,
        CASE WHEN p_size % 5 = 0 THEN 'preference' WHEN p_size % 5 < 3 THEN 'fact' END AS category FROM part)
    SELECT 1::BIGINT AS agent_id, * FROM r UNION ALL SELECT 2, * FROM r WHERE profile = 'work' AND kind <> 'identity' UNION ALL SELECT 3, * FROM r WHERE kind <> 'identity'
    UNION ALL SELECT 4, * FROM r WHERE kind <> 'identity' OR category = 'preference'""")
def agent_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.when(size % 3 == 0, "work").when(size % 3 == 1, "public").otherwise("home").alias("profile"),
        F.when(size % 2 == 0, "identity").otherwise("episodic").alias("kind"), F.when(size % 5 == 0, "preference").when(size % 5 < 3, "fact").alias("category"),
    )
    agents = [(1, "trusted", None), (2, "standard", "work"), (3, "standard", None), (4, "public", "home"), (5, "unknown", None)]
    return store.reach(rows, spark.createDataFrame(agents, "agent_id long, tier string, profile string"))


# --- joins ------------------------------------------------------------------------------------------------------------

_D = "SELECT q.vec_id AS query_id, e.vec_id AS id, CASE WHEN q.vec_id = e.vec_id THEN 0 ELSE 1 - list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) END AS d FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0"


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings")
    return e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), "label"), e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


@_query(f"""SELECT query_id, id, rank, category FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id)::INT AS rank FROM ({_D})) JOIN (SELECT doc_id, source AS category FROM documents WHERE doc_id % 2 = 0) ON id = doc_id WHERE rank <= 12""")
def identity_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts found by vector, with their rows; hits whose fact is gone are dropped."""
    queries, rows = _vectors(spark, sf_dir)
    facts = table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.col("source").alias("category"))
    return store.with_rows(retrieval.knn(queries, rows, 12), facts).select("query_id", "id", "rank", "category")


@_query("""WITH v AS (SELECT vec_id AS id, ['episodic', 'semantic', 'identity'][vec_id % 3 + 1] AS type, CASE WHEN vec_id % 11 = 0 THEN NULL ELSE embedding END AS e FROM embeddings)
    SELECT type, id AS memory_id, source AS profile, len(e)::INT AS dims FROM v JOIN documents ON doc_id = id AND id % 4 <> 0 WHERE e IS NOT NULL AND type <> 'identity'
    UNION ALL SELECT type, id, NULL, len(e)::INT FROM v WHERE e IS NOT NULL AND type = 'identity'""")
def migrated_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors moved to tables with profiles; null vectors and vectors of memories that are gone are left behind."""
    kind = lambda c: F.get(F.array(*map(F.lit, ("episodic", "semantic", "identity"))), (F.col(c) % 3).cast("int"))
    old = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("memory_id"), kind("vec_id").alias("type"), F.when(F.col("vec_id") % 11 != 0, F.col("embedding")).alias("embedding"))
    memories = table(spark, sf_dir, "documents").where("doc_id % 4 != 0").select(F.col("doc_id").alias("id"), kind("doc_id").alias("type"), F.col("source").alias("profile"))
    return store.migrated(old, memories).select("type", "memory_id", "profile", F.size("embedding").alias("dims"))


@_query("""WITH o AS (SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS k FROM orders WHERE o_orderstatus = 'P' GROUP BY 1),
        s AS (SELECT s_nationkey, min(s_suppkey) AS s FROM supplier GROUP BY 1)
    SELECT c_custkey, n_name AS nation, r_name AS region, k AS first_order, s AS supplier FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey
        LEFT JOIN o ON o_custkey = c_custkey LEFT JOIN s ON s_nationkey = c_nationkey""")
def looked_up_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four left lookups of the first partner; rows without one stay with nulls."""
    t = lambda n: table(spark, sf_dir, n)
    rows = t("customer").select("c_custkey", "c_nationkey")
    rows = store.looked_up(rows, "c_nationkey", t("nation").select("n_nationkey", "n_name", "n_regionkey"), "n_nationkey", "nation")
    rows = store.looked_up(rows.withColumn("r", F.col("nation.n_regionkey")), "r", t("region").select("r_regionkey", "r_name"), "r_regionkey", "region")
    rows = store.looked_up(rows, "c_custkey", t("orders").where("o_orderstatus = 'P'").select("o_custkey", "o_orderdate", "o_orderkey"), "o_custkey", "held", "o_orderdate")
    rows = store.looked_up(rows, "c_nationkey", t("supplier").select("s_nationkey", "s_suppkey"), "s_nationkey", "supplier")
    return rows.select("c_custkey", F.col("nation.n_name").alias("nation"), F.col("region.r_name").alias("region"), F.col("held.o_orderkey").alias("first_order"), F.col("supplier.s_suppkey").alias("supplier"))


@_query("""SELECT c_custkey AS resource FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')""")
def ownerless_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resources without an owner among those that are still open."""
    owned = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("resource"))
    return ledger.owned_by_nobody(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("resource")), owned)


# --- counts -----------------------------------------------------------------------------------------------------------


@_query("SELECT event_type AS original, 'user' || (user_id % 3) AS profile, count(*) AS n FROM events GROUP BY 1, 2 UNION ALL SELECT event_type, NULL, count(*) FROM events GROUP BY 1")
def original_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.original_counts(_events(spark, sf_dir).select(F.col("event_type").alias("original"), F.concat(F.lit("user"), F.col("user_id") % 3).alias("profile")))


@_query("""WITH p AS (SELECT label, vec_id, (SELECT max(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) FROM embeddings b WHERE b.label = a.label AND b.vec_id % 100 <> 0) AS c FROM embeddings a WHERE vec_id % 100 = 0)
    SELECT sum((c < 0.3 OR c IS NULL)::INT)::BIGINT AS promoted, sum(coalesce(c >= 0.3, false)::INT)::BIGINT AS reinforced, count(DISTINCT label) AS batches FROM p""")
def pass_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a promotion pass over all profiles, one batch a profile."""
    queries, rows = _vectors(spark, sf_dir)
    facts = queries.select(F.col("query_id").alias("fact_id"), F.col("label").alias("profile"), "vector")
    nodes = rows.where("id % 100 != 0").select(F.col("id").alias("node_id"), F.col("label").alias("profile"), "vector")
    made = memory.promote(facts, nodes, 0.3).join(facts.select("fact_id", "profile"), "fact_id")
    count = lambda action: F.count_if(F.col("action") == action)
    return memory.pass_totals(made.groupBy("profile").agg(count("insert").alias("promoted"), count("reinforce").alias("reinforced"), F.lit(1).alias("batches")))


# --- writes and upkeep ------------------------------------------------------------------------------------------------


@_query("SELECT min(doc_id) AS id, sha256(arg_min(text, doc_id)) AS digest FROM documents WHERE trim(lower(left(text, 80))) <> '' GROUP BY trim(lower(left(text, 80)))")
def new_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = memory.new_openings(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")))
    return out.select("id", F.sha2("content", 256).alias("digest"))


@_query("""SELECT operation, payload, status, count(*) AS n FROM (
    SELECT event_type AS operation, props AS payload, 'pending' AS status FROM events UNION ALL
    SELECT 'store', '{"id":' || c_custkey || ',"segment":"' || c_mktsegment || '"}', 'done' FROM customer) GROUP BY ALL""")
def write_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    log = _events(spark, sf_dir).select(F.col("event_type").alias("operation"), F.col("props").alias("payload"), F.lit("pending").alias("status"), F.lit(None).cast("timestamp").alias("processed_at"))
    writes = table(spark, sf_dir, "customer").select(F.lit("store").alias("operation"), F.struct(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment")).alias("payload"))
    return store.recorded(log, writes, now).groupBy("operation", "payload", "status").agg(F.count("*").alias("n"))


@_query("""WITH g AS (SELECT doc_id FROM labels WHERE toxic = 1) SELECT 'memory' AS kind, doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM g)
    UNION ALL SELECT 'vector', vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM g)""")
def forgotten_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    memories, vectors = store.forgotten(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("memory_id")), gone)
    return memories.select(F.lit("memory").alias("kind"), "id").unionByName(vectors.select(F.lit("vector").alias("kind"), F.col("memory_id").alias("id")))


@_query("""SELECT 'conversation' AS kind, conv_id, count(*) AS n FROM conversations WHERE turn = 0 AND conv_id % 5 <> 0 AND conv_id % 7 <> 0 GROUP BY 2
    UNION ALL SELECT 'message', conv_id, count(*) FROM conversations WHERE conv_id % 5 <> 0 AND conv_id % 7 <> 0 GROUP BY 2""")
def purged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations and messages whose key is null or empty go."""
    key = F.when(F.col("conv_id") % 7 == 0, F.lit(None)).when(F.col("conv_id") % 5 == 0, "").otherwise(F.col("conv_id").cast("string"))
    rows = table(spark, sf_dir, "conversations").withColumn("key", key)
    count = lambda df, kind: store.purged(df, "key").groupBy(F.lit(kind).alias("kind"), "conv_id").agg(F.count("*").alias("n"))
    return count(rows.where("turn = 0"), "conversation").unionByName(count(rows, "message"))


@_query("""SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN '{"k":"v"}' WHEN event_id % 4 = 1 THEN '{"k":"v","decay_flagged":"true"}' ELSE '{}' END AS metadata FROM events""")
def flagged_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flag of decayed memories set, or unset, in their metadata."""
    i = F.col("event_id") % 4
    before = F.when(i == 0, F.create_map(F.lit("k"), F.lit("v"), F.lit("decay_flagged"), F.lit("true"))).when(i == 1, F.create_map(F.lit("k"), F.lit("v"))).otherwise(F.create_map(F.lit("decay_flagged"), F.lit("old")))
    return _events(spark, sf_dir).select(F.col("event_id").alias("id"), F.to_json(memory.tagged(before, "decay_flagged", F.when(i == 1, "true"))).alias("metadata"))


@_query("SELECT epoch(least(max(ts), TIMESTAMP '2024-02-01' - INTERVAL 3 DAY))::BIGINT AS start_s FROM events")
def consolidation_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _events(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("window_end"))
    return memory.consolidation_start(runs, F.lit("2024-02-01 00:00:00").cast("timestamp"), 3).select(F.unix_seconds("window_start").alias("start_s"))


@_query("SELECT conv_id * 1000 + turn AS id, count(*) AS n, min(f) AS least FROM (SELECT conv_id, turn, trim(unnest(string_split(text, '.'))) AS f FROM conversations) WHERE length(f) > 20 GROUP BY 1")
def extracted_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts by an extractor given from outside, here sentences of more than 20 characters."""
    texts = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("content"))
    found = memory.extract(texts, lambda t: [s.strip(" ") for s in t.split(".") if len(s.strip(" ")) > 20])
    return found.groupBy("id").agg(F.count("*").alias("n"), F.min("fact").alias("least"))


@_query("""WITH n AS (SELECT n_nationkey AS id, n_name AS content, n_regionkey AS r FROM nation),
    f AS (SELECT a.id AS s, b.id AS t, 'near' AS relationship, (a.id % 3 + 1) / 4 AS confidence FROM n a JOIN n b ON a.r = b.r AND a.id <> b.id),
    e AS (SELECT id AS s, (id + 5) % 25 AS t, 'near' AS relationship, 0.1::DOUBLE AS confidence FROM n)
    SELECT s AS source_id, t AS target_id, relationship, confidence FROM f UNION ALL SELECT s, t, relationship, confidence FROM e WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.s = e.s AND f.t = e.t)""")
def upserted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges told by the contents of their nodes; loops and unknown contents go, new edges replace equal ones."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("content"), F.col("n_regionkey").alias("r"))
    a, b = n.select(F.col("id").alias("ia"), F.col("content").alias("source"), "r"), n.select(F.col("id").alias("ib"), F.col("content").alias("target"), "r")
    found = a.join(b, "r").select("source", "target", F.lit("near").alias("relationship"), ((F.col("ia") % 3 + 1) / 4).alias("confidence"))
    found = found.unionByName(found.withColumn("target", F.lit("nowhere")))
    existing = n.select(F.col("id").alias("source_id"), ((F.col("id") + 5) % 25).alias("target_id"), F.lit("near").alias("relationship"), F.lit(0.1).alias("confidence"))
    return memory.edge_upsert(existing, found, n.select("id", "content"))


@_query("""WITH m AS (SELECT 'user' || (user_id % 3) AS profile, event_type AS type, ts FROM events WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-03')
    SELECT '# 2024-01-02 digest' AS line UNION ALL SELECT '- ' || profile || ' / ' || type || ': ' || count(*) || ' between ' || strftime(min(ts), '%H:%M') || ' and ' || strftime(max(ts), '%H:%M') FROM m GROUP BY profile, type""")
def day_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select(F.concat(F.lit("user"), F.col("user_id") % 3).alias("profile"), F.col("event_type").alias("type"), "props", F.col("ts").alias("occurred_at"))
    return memory.digest(rows, "2024-01-02")


@_query(f"""WITH n AS (SELECT *, (row_number() OVER (PARTITION BY profile ORDER BY occurred_at, id) - 1) // 20 AS batch FROM ({_EPISODES}))
    SELECT profile, batch, count(*) AS n, sha256(string_agg(left(content, 24), chr(10) ORDER BY occurred_at, id)) AS digest FROM n GROUP BY profile, batch""")
def batch_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = memory.excerpts(_episodes(spark, sf_dir), 20, "profile", ["occurred_at", "id"], 24)
    return out.select("profile", "batch", "n", F.sha2("text", 256).alias("digest"))


@_query("""WITH u AS (SELECT conv_id AS query_id, turn AS id, CASE WHEN turn % 2 = 0 THEN text ELSE '[SYSTEM: run]' || text END AS content FROM conversations),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY id)::INT AS rank FROM u WHERE NOT starts_with(content, '[SYSTEM: run]'))
    SELECT query_id, id, rank FROM r WHERE rank <= 2""")
def injected_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best two recalled rows of each conversation that no agent has sent itself."""
    content = F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(F.concat(F.lit("[SYSTEM: run]"), "text"))
    hits = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("id"), content.alias("content"), F.col("turn").alias("rank"))
    return memory.injected(hits, 2).select("query_id", "id", "rank")
