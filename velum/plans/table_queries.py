"""Queries over events, orders and other tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.io import table
from velum.operators import conversation, ledger, memory, store
from velum.streaming import restore

NOW = "2024-02-01 00:00:00"


def _memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as episodic memories."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), F.concat(F.lit("user"), F.col("user_id") % 3).alias("profile"), F.concat("event_type", F.lit(" with details "), "props").alias("content"), F.col("ts").alias("occurred_at"),
        F.when(F.col("event_type") == "signup", F.lit('{"type": "digest"}')).otherwise(F.col("props")).alias("metadata"), F.col("event_type").alias("type"),
    )


_MEMORIES = """SELECT event_id AS id, 'user' || (user_id % 3) AS profile, event_type || ' with details ' || props AS content, ts AS occurred_at, event_type AS type,
    CASE WHEN event_type = 'signup' THEN '{"type": "digest"}' ELSE props END AS metadata FROM events"""


def newest_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.newest(_memories(spark, sf_dir), 50, profile="user1").select("id", "content")


_NEWEST_MEMORIES = f"SELECT id, content FROM ({_MEMORIES}) WHERE profile = 'user1' ORDER BY occurred_at DESC, id DESC LIMIT 50"


def memory_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.window(_memories(spark, sf_dir), "2024-01-03 00:00:00", "2024-01-12 12:00:00").select("id", "profile")


_MEMORY_WINDOW = f"""SELECT id, profile FROM ({_MEMORIES}) WHERE occurred_at >= TIMESTAMP '2024-01-03 00:00:00' AND occurred_at < TIMESTAMP '2024-01-12 12:00:00'
    AND length(content) >= 20 AND json_extract_string(metadata, '$.type') IS DISTINCT FROM 'digest'"""


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as semantic nodes."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.least(F.col("value") / 100, F.lit(1.0)).alias("confidence"), ((F.col("event_id") * 37) % 101 / 100).alias("decay_score"), (F.col("user_id") % 7).alias("access_count"), F.col("ts").alias("last_accessed_at"),
        F.col("event_type").alias("category"),
    )


_NODES = "SELECT event_id AS id, least(value / 100, 1.0) AS confidence, (event_id * 37) % 101 / 100 AS decay_score, user_id % 7 AS access_count, ts AS last_accessed_at, event_type AS category FROM events"


def strongest_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.strongest(_nodes(spark, sf_dir), 40, 0.2, 0.3).select("id", "category")


_STRONGEST_NODES = f"SELECT id, category FROM ({_NODES}) WHERE confidence >= 0.2 AND decay_score >= 0.3 ORDER BY confidence DESC, decay_score DESC, id LIMIT 40"


def decay_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.decay(_nodes(spark, sf_dir), F.lit(NOW).cast("timestamp")).select("id", F.round("decay_score", 9).alias("decay_score"), "flagged", "newly")


_DECAY_PASS = f"""
    WITH s AS (SELECT *, greatest(0, confidence * exp(-((epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_accessed_at)) / 86400000000) / (1 + access_count * 0.5::DOUBLE))) AS s FROM ({_NODES}))
    SELECT id, round(s, 9) AS decay_score, s < 0.15 AS flagged, s < 0.15 AND NOT decay_score < 0.15 AS newly FROM s"""


def reinforced_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    touched = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    out = memory.reinforce(_nodes(spark, sf_dir), touched, F.lit(NOW).cast("timestamp"))
    return out.select("id", "access_count", F.unix_seconds(F.col("last_accessed_at").cast("timestamp")).alias("at"))


_REINFORCED_NODES = f"""SELECT id, access_count + coalesce(n, 0) AS access_count, CASE WHEN n IS NOT NULL THEN epoch(TIMESTAMP '{NOW}')::BIGINT ELSE floor(epoch(last_accessed_at))::BIGINT END AS at
    FROM ({_NODES}) LEFT JOIN (SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1) USING (id)"""


def memory_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.batches(_memories(spark, sf_dir), 25, "profile", ["occurred_at", "id"]).groupBy("profile", "batch").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


_MEMORY_BATCHES = f"""SELECT profile, batch, count(*) AS n, min(id) AS first_id FROM (SELECT *, (row_number() OVER (PARTITION BY profile ORDER BY occurred_at, id) - 1) // 25 AS batch FROM ({_MEMORIES})) GROUP BY profile, batch"""


def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.stats(**{n: table(spark, sf_dir, n) for n in ("documents", "conversations", "embeddings", "events", "lineitem")})


_TABLE_COUNTS = " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in ("documents", "conversations", "embeddings", "events", "lineitem"))


def memory_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("content"), F.col("o_orderdate").alias("at"))
    return store.feed(30, episodic=_memories(spark, sf_dir).withColumnRenamed("occurred_at", "at"), semantic=orders).select("type", "id", "content")


_MEMORY_FEED = f"""SELECT * FROM (SELECT 'episodic' AS type, id, content FROM ({_MEMORIES}) ORDER BY occurred_at DESC, id DESC LIMIT 30)
    UNION ALL SELECT * FROM (SELECT 'semantic' AS type, o_orderkey AS id, o_orderpriority AS content FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 30)"""


def audit_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("turn_id"), F.col("o_orderstatus").alias("status"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("id"), F.col("l_orderkey").alias("turn_id"), F.col("l_partkey").alias("token"), F.col("l_suppkey").alias("original"), F.col("l_returnflag").alias("direction"))
    return store.turns_with_tokens(turns, lines).select("turn_id", "status", "n_tokens", F.coalesce(F.size("mappings"), F.lit(0)).alias("n_mappings"), F.get("mappings", F.lit(0))["id"].alias("first_id"))


_AUDIT_TURNS = """SELECT o_orderkey AS turn_id, o_orderstatus AS status, count(DISTINCT l_partkey) AS n_tokens, count(l_orderkey)::INT AS n_mappings, min(l_linenumber) AS first_id
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus"""


def tool_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit('{"tools": [{"name": "'), "event_type", F.lit('__a"}, {"name": "'), "event_type", F.lit('__b"}, {"name": "plain"}]}'))
    return conversation.tool_counts(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.when(F.col("event_id") % 2 == 1, body).alias("request_body")))


_TOOL_COUNTS = """WITH l AS (SELECT * FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 5) WHERE event_id % 2 = 1 ORDER BY ts DESC, event_id DESC LIMIT 1)
    SELECT event_type AS server, 2::BIGINT AS n FROM l UNION ALL SELECT '_builtin', 1 FROM l"""


def agent_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 3 == 0, "work").when(F.col("p_size") % 3 == 1, "public").otherwise("home").alias("profile"), F.when(F.col("p_size") % 2 == 0, "identity").otherwise("episodic").alias("kind"))
    agents = spark.createDataFrame([(1, "trusted"), (2, "standard"), (3, "public"), (4, "unknown")], "agent_id long, tier string")
    return store.allowed(rows, agents)


_AGENT_ACCESS = """
    WITH r AS (SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'work' WHEN 1 THEN 'public' ELSE 'home' END AS profile, CASE WHEN p_size % 2 = 0 THEN 'identity' ELSE 'episodic' END AS kind FROM part)
    SELECT 1::BIGINT AS agent_id, * FROM r UNION ALL SELECT 2, * FROM r WHERE profile = 'work' AND kind <> 'identity' UNION ALL SELECT 3, * FROM r WHERE profile = 'public' AND kind <> 'identity'"""


def live_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "orders").select(F.sha2(F.col("o_orderkey").cast("string"), 256).alias("token_hash"), F.col("o_custkey").alias("agent_id"), (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("expires_at"))
    agents = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("agent_id"), F.col("c_mktsegment").alias("tier"))
    return store.live_tokens(tokens, agents, F.lit("1998-06-01 00:00:00").cast("timestamp"))


_LIVE_TOKENS = """SELECT sha256(o_orderkey::VARCHAR) AS token_hash, c_custkey AS agent_id, c_mktsegment AS tier FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE o_orderdate + INTERVAL 30 DAY > TIMESTAMP '1998-06-01 00:00:00'"""


def request_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"//[^/]*?([a-z]+\.[a-z]+)/", 1).alias("host"), F.regexp_extract("url", r"//[^/]*(/.*)$", 1).alias("path"))
    return store.dispatch(parts, [("example.com", "/en", "a"), ("example.com", "/", "b"), ("example.org", "/de", "c")]).groupBy("handler").agg(F.count("*").alias("n"))


_REQUEST_DISPATCH = r"""WITH p AS (SELECT regexp_extract(url, '//[^/]*?([a-z]+\.[a-z]+)/', 1) AS h, regexp_extract(url, '//[^/]*(/.*)$', 1) AS p FROM pages)
    SELECT CASE WHEN h = 'example.com' AND starts_with(p, '/en') THEN 'a' WHEN h = 'example.com' AND starts_with(p, '/') THEN 'b' WHEN h = 'example.org' AND starts_with(p, '/de') THEN 'c' ELSE 'pass' END AS handler, count(*) AS n FROM p GROUP BY 1"""


def detection_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("kind"), F.concat(F.lit("Part"), F.col("l_partkey") % 50).alias("text"), "l_quantity", "l_discount")
    out = store.scores(lines.where("l_quantity > 10"), lines.where("l_discount < 0.05").withColumn("text", F.upper("text")))
    return out.select("kind", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


_DETECTION_SCORES = """
    WITH l AS (SELECT l_orderkey AS d, l_returnflag AS kind, l_partkey % 50 AS t, l_quantity > 10 AS g, l_discount < 0.05 AS f FROM lineitem),
    c AS (SELECT d, kind, t, count(*) FILTER (g) AS g, count(*) FILTER (f) AS f FROM l GROUP BY d, kind, t),
    s AS (SELECT kind, sum(least(g, f)) AS tp, sum(greatest(f - g, 0)) AS fp, sum(greatest(g - f, 0)) AS fn FROM c GROUP BY kind UNION ALL SELECT 'overall', sum(least(g, f)), sum(greatest(f - g, 0)), sum(greatest(g - f, 0)) FROM c)
    SELECT kind, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1 FROM s"""


def promoted_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    facts = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("fact_id"), F.col("label").alias("profile"), F.col("embedding").alias("vector"))
    nodes = e.where("vec_id % 100 != 0").select(F.col("vec_id").alias("node_id"), F.col("label").alias("profile"), F.col("embedding").alias("vector"))
    return memory.promote(facts, nodes, 0.3).select("fact_id", "node_id", F.round("cosine", 6).alias("cosine"), "action")


_PROMOTED_FACTS = """
    WITH p AS (SELECT f.vec_id AS fact_id, n.vec_id AS node_id, list_cosine_similarity(f.embedding::DOUBLE[], n.embedding::DOUBLE[]) AS c FROM embeddings f JOIN embeddings n ON f.label = n.label AND f.vec_id % 100 = 0 AND n.vec_id % 100 <> 0),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY c DESC, node_id) AS r FROM p) WHERE r = 1)
    SELECT fact_id, CASE WHEN c >= 0.3 THEN node_id END AS node_id, round(c, 6) AS cosine, CASE WHEN c >= 0.3 THEN 'reinforce' ELSE 'insert' END AS action FROM b"""


def display_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.concat(F.lit("kind"), F.col("n_nationkey") % 4).alias("type"), F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("c"), "n_regionkey")).alias("category"), F.concat(F.lit("region "), "n_name", F.lit(" lies near")).alias("content"))
    return memory.display_edges(nodes)


_DISPLAY_EDGES = """
    WITH n AS (SELECT n_nationkey AS id, n_nationkey % 4 AS type, CASE WHEN n_nationkey % 3 = 0 THEN 'c' || n_regionkey END AS category, list_filter(list_distinct(regexp_extract_all(lower('region ' || n_name || ' lies near'), '[a-z0-9]+')), lambda w: length(w) > 3) AS w FROM nation),
    p AS (SELECT a.id AS a, b.id AS b, CASE WHEN a.category = b.category THEN 1.0 WHEN a.type = b.type THEN 0.3 WHEN len(list_intersect(a.w, b.w)) >= 1 THEN least(len(list_intersect(a.w, b.w)), 3) END::DOUBLE AS strength FROM n a JOIN n b ON a.id < b.id)
    SELECT * FROM p WHERE strength IS NOT NULL"""


def upserted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    fresh = c.where("c_custkey % 10 = 0").withColumn("c_mktsegment", F.lit("MOVED")).unionByName(c.where("c_custkey % 50 = 1").withColumn("c_custkey", F.col("c_custkey") + 1_000_000))
    return memory.upsert(c, fresh, ["c_custkey"])


_UPSERTED_ROWS = """SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM customer
    UNION ALL SELECT c_custkey + 1000000, c_mktsegment, c_acctbal FROM customer WHERE c_custkey % 50 = 1"""


def orphan_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("idx"), F.array("event_type").alias("calls"), F.array(F.when(F.col("value") > 5, "click").otherwise("view")).alias("results"))
    return conversation.orphan_calls(e)


_ORPHAN_CALLS = """SELECT user_id AS conv_id, event_id AS idx, event_type AS call_id FROM (SELECT *, lead(CASE WHEN value > 5 THEN 'click' ELSE 'view' END) OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r IS DISTINCT FROM event_type"""


def order_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return conversation.page(rows, "o_totalprice", "o_orderkey", 25, (250_000.0, 0))


_ORDER_PAGE = "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 250000 OR (o_totalprice = 250000 AND o_orderkey < 0) ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 26"


def share_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.when(F.col("c_custkey") > 0, F.floor((F.col("c_custkey") - 1) / 5).cast("string")).alias("parent"))
    return conversation.share_levels(tree, "40")


_SHARE_LEVELS = """
    WITH RECURSIVE t AS (SELECT c_custkey::VARCHAR AS id, CASE WHEN c_custkey > 0 THEN ((c_custkey - 1) // 5)::VARCHAR END AS parent FROM customer),
    w(id, level) AS (SELECT id, 0 FROM t WHERE parent IS NULL UNION ALL SELECT t.id, w.level + 1 FROM t JOIN w ON t.parent = w.id)
    SELECT id, level FROM w WHERE level <= (SELECT max(level) FROM w WHERE id = '40')"""


def deleted_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("id"), F.col("ts").alias("created_at"), "event_type")
    pivot = e.where("event_type = 'signup'").groupBy("conv_id").agg(F.min("created_at").alias("created_at"))
    return conversation.delete_after(e, pivot).select("conv_id", "id")


_DELETED_AFTER = """SELECT user_id AS conv_id, event_id AS id FROM events LEFT JOIN (SELECT user_id, min(ts) AS pivot_ts FROM events WHERE event_type = 'signup' GROUP BY 1) USING (user_id) WHERE pivot_ts IS NULL OR ts <= pivot_ts"""


def pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.pseudonyms(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name", "salt:")


_PSEUDONYMS = "SELECT c_custkey, sha256('salt:' || c_name) AS c_name FROM customer"

_PRICES = [("Brand#", 3.0, 9.0), ("Brand#1", 1.5, 4.5), ("Brand#12", 0.5, 2.0), ("Brand#2", 2.0, 8.0)]
_PREMIUM = [("Brand#2", 30, 4.0, 12.0)]
_CACHE = [("Brand#1", 1.875, 0.15)]


def spending(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    calls = lines.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("call_id"), F.col("l_suppkey").alias("user"), F.when(F.col("p_size") > 40, "other").otherwise(F.col("p_brand")).alias("model"), F.col("l_quantity").cast("long").alias("input_tokens"),
        (F.col("l_partkey") % 7).alias("write_tokens"), (F.col("l_suppkey") % 5).alias("read_tokens"), (F.col("l_partkey") % 11).alias("output_tokens"), F.when(F.col("l_returnflag") == "R", "incomplete").alias("context"),
    )
    frame = lambda rows, shape: spark.createDataFrame(rows, shape)
    priced = ledger.priced(calls, frame(_PRICES, "key string, prompt double, completion double"), frame(_PREMIUM, "key string, threshold long, prompt double, completion double"), frame(_CACHE, "key string, write double, read double"))
    return ledger.spent(priced).groupBy("user", "token_type").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"), F.round(F.sum("token_value"), 3).alias("token_value"))


_SPENDING = f"""
    WITH prices(key, p, c) AS (VALUES {', '.join(f"('{k}', {p}::DOUBLE, {c}::DOUBLE)" for k, p, c in _PRICES)}),
    calls AS (SELECT l_suppkey AS "user", CASE WHEN p_size > 40 THEN 'other' ELSE p_brand END AS model, l_quantity::BIGINT AS i, l_partkey % 7 AS w, l_suppkey % 5 AS r, l_partkey % 11 AS o, l_returnflag = 'R' AS cut FROM lineitem JOIN part ON l_partkey = p_partkey),
    best AS (SELECT model, arg_max(key, length(key)) AS key FROM (SELECT DISTINCT model FROM calls) JOIN prices ON contains(model, key) GROUP BY model),
    rated AS (SELECT calls.*, key, CASE WHEN key = 'Brand#2' AND i > 30 THEN 4.0 ELSE coalesce(p, 6.0) END::DOUBLE AS pr, CASE WHEN key = 'Brand#2' AND i > 30 THEN 12.0 ELSE coalesce(c, 6.0) END::DOUBLE AS cr FROM calls LEFT JOIN best USING (model) LEFT JOIN prices USING (key)),
    rows AS (SELECT "user", 'prompt' AS token_type, -(i + w + r) AS amount, -(i * pr + w * CASE WHEN key = 'Brand#1' THEN 1.875 ELSE pr END + r * CASE WHEN key = 'Brand#1' THEN 0.15 ELSE pr END) AS v FROM rated
        UNION ALL SELECT "user", 'completion', -o, CASE WHEN cut THEN ceil(-o * cr * 1.15::DOUBLE) ELSE -o * cr END FROM rated)
    SELECT "user", token_type, count(*) AS n, sum(amount)::BIGINT AS amount, round(sum(v), 3) AS token_value FROM rows WHERE amount <> 0 GROUP BY 1, 2"""


def balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = table(spark, sf_dir, "events").select(F.col("user_id").alias("user"), F.col("event_id").alias("seq"), (F.col("value") - 11).alias("delta"))
    return ledger.balances(changes).select("user", F.round("balance", 4).alias("balance"))


_BALANCES = """SELECT user_id AS "user", round(list_reduce(list(value - 11 ORDER BY event_id), lambda a, x: greatest(0, a + x), 0.0::DOUBLE), 4) AS balance FROM events GROUP BY user_id"""


def refills(spark: SparkSession, sf_dir: str) -> DataFrame:
    accounts = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.lit(2000.0).alias("minimum"), F.lit(500.0).alias("refill_amount"), (F.col("c_custkey") % 30).cast("int").alias("refill_days"), F.lit("2024-01-15 00:00:00").cast("timestamp").alias("last_refill"))
    return ledger.refills(accounts, F.lit(NOW).cast("timestamp")).select("id", F.round("balance", 2).alias("balance"), "refilled")


_REFILLS = f"""SELECT c_custkey AS id, round(CASE WHEN c_acctbal < 2000 AND c_custkey % 30 <= 17 THEN c_acctbal + 500 ELSE c_acctbal END, 2) AS balance, c_acctbal < 2000 AND c_custkey % 30 <= 17 AS refilled FROM customer"""


def permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("principal"), (F.col("s_suppkey") % 9).alias("resource"), (F.col("s_suppkey") % 16).cast("int").alias("bits"))
    members = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user"), F.col("c_nationkey").alias("principal"))
    return ledger.permissions(entries, members)


_PERMISSIONS = """SELECT c_custkey AS "user", s_suppkey % 9 AS resource, bit_or((s_suppkey % 16)::INT) AS bits FROM customer JOIN supplier ON s_nationkey = c_nationkey GROUP BY 1, 2"""


def unowned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.owned_by_nobody(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("resource")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("resource")))


_UNOWNED = "SELECT c_custkey AS resource FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"


def tag_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.array("o_orderstatus", F.substring("o_orderpriority", 1, 1)).alias("before"), F.array(F.lit("F"), F.substring("o_orderpriority", 1, 1)).alias("after"))
    return ledger.tag_changes(rows)


_TAG_CHANGES = """SELECT tag, sum(n)::BIGINT AS change FROM (SELECT 'F' AS tag, 1 AS n FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT o_orderstatus, -1 FROM orders WHERE o_orderstatus <> 'F') GROUP BY tag"""


def moved_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.moved_positions(table(spark, sf_dir, "nation").select("n_name", F.col("n_nationkey").alias("position")), 4, 17)


_MOVED_POSITIONS = "SELECT n_name, (CASE WHEN n_nationkey = 4 THEN 17 WHEN n_nationkey > 4 AND n_nationkey <= 17 THEN n_nationkey - 1 ELSE n_nationkey END)::INT AS position FROM nation"


def content_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("n_chars").alias("at"))
    return store.openings(rows, 12).select("opening", F.sha2("content", 256).alias("digest"), "at", "n")


_CONTENT_OPENINGS = """SELECT left(text, 12) AS opening, sha256(arg_max(text, (n_chars, doc_id))) AS digest, max(n_chars) AS at, count(*) AS n FROM documents GROUP BY left(text, 12)"""


def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    categories = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("category"))
    return store.category_counts(categories, table(spark, sf_dir, "supplier").where("s_acctbal > 8000").select(F.col("s_nationkey").alias("category")))


_CATEGORY_COUNTS = "SELECT n_nationkey AS category, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 8000 GROUP BY n_nationkey"


def dominant_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.dominant(table(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment")


_DOMINANT_SEGMENT = """SELECT c_nationkey, c_mktsegment FROM (SELECT c_nationkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) AS r FROM customer GROUP BY c_nationkey, c_mktsegment) WHERE r = 1"""


def token_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").cast("string").alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("tokens"), F.col("ts").alias("at"))
    return store.listing(rows, "user_id").select("user_id", "total", F.sha2("text", 256).alias("digest"))


_TOKEN_LISTING = """SELECT user_id, sum(event_id)::BIGINT AS total, sha256(string_agg(strftime(ts, '%Y-%m-%d') || ' [' || event_id || '] ' || event_id || ': ' || event_type, chr(10) ORDER BY ts, event_id::VARCHAR)) AS digest FROM events GROUP BY user_id"""


def last_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda name, column: table(spark, sf_dir, name).select(F.col(column).cast("timestamp").alias("at"))
    return store.last_times(events=at("events", "ts"), orders=at("orders", "o_orderdate")).select("name", F.unix_micros("last").alias("last_us"))


_LAST_TIMES = "SELECT 'events' AS name, epoch_us(max(ts)) AS last_us FROM events UNION ALL SELECT 'orders', epoch_us(max(o_orderdate)) FROM orders"


def queue_drain(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    queue = e.select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 3 == 0, "done").otherwise("pending").alias("status"), (F.col("event_id") % 3).cast("int").alias("attempts"), F.col("ts").alias("created_at"), (F.col("value") > 5).alias("ok"))
    return store.drain(queue).groupBy("status", "attempts").agg(F.count("*").alias("n"))


_QUEUE_DRAIN = """
    WITH q AS (SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'done' ELSE 'pending' END AS s, (event_id % 3)::INT AS a, ts, value > 5 AS ok FROM events),
    r AS (SELECT *, s = 'pending' AND row_number() OVER (PARTITION BY s ORDER BY ts, id) <= 50 AS mine FROM q), t AS (SELECT *, a + CASE WHEN mine AND NOT ok THEN 1 ELSE 0 END AS b FROM r)
    SELECT CASE WHEN mine AND ok THEN 'done' WHEN mine AND b >= 3 THEN 'failed' ELSE s END AS status, b::INT AS attempts, count(*) AS n FROM t GROUP BY 1, 2"""


def bus_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return store.backlog(e.select(F.col("event_id").alias("seq")), e.groupBy(F.col("user_id").alias("subscriber")).agg(F.max("event_id").alias("seq")))


_BUS_BACKLOG = """SELECT user_id AS subscriber, least(m - max(event_id), 256) AS waiting, greatest(m - max(event_id) - 256, 0) AS lost FROM events CROSS JOIN (SELECT max(event_id) AS m FROM events) GROUP BY user_id, m"""


# --- streams as finished tables ---------------------------------------------------------------------------------------


def rate_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admission depends on earlier admissions; tests compare it with brute force and with the stream."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("at"))
    return restore.rate_limit_batch(e, 5, 40_000_000_000.0)


def runaway_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window that empties once it has fired; tests compare it with brute force and with the stream."""
    return restore.cascade_batch(table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), F.floor(F.col("value") * 4).alias("n")))


def restored_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    text = F.concat(F.lit("[PERSON_1] "), "text", F.lit(" [ORG_12]"))
    pieces = c.select(F.concat_ws("/", "conv_id", "turn").alias("stream_id"), text.alias("t")).withColumn("i", F.explode(F.sequence(F.lit(0), F.floor(F.char_length("t") / 7).cast("int"))))
    chunks = pieces.select("stream_id", F.col("i").cast("long").alias("seq"), F.substring(F.col("t"), F.col("i") * 7 + 1, F.lit(7)).alias("payload"), (F.col("i") == F.floor(F.char_length("t") / 7)).alias("final"))
    tokens = c.select(F.concat_ws("/", "conv_id", "turn").alias("stream_id"), F.explode(F.array(F.struct(F.lit("[PERSON_1]").alias("token"), F.lit("Ada").alias("original")), F.struct(F.lit("[ORG_12]").alias("token"), F.lit("Acme [x").alias("original")))).alias("e")).select("stream_id", "e.*")
    out = restore.restore_batch(chunks, tokens)
    return out.groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "").alias("t")).select("stream_id", F.sha2("t", 256).alias("digest"))


_RESTORED_STREAMS = "SELECT conv_id || '/' || turn AS stream_id, sha256('Ada ' || text || ' Acme [x') AS digest FROM conversations"


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "events").groupBy(F.window("ts", "6 hours"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))
    return counted.select(F.unix_seconds(F.col("window.start").cast("timestamp")).alias("start_s"), "event_type", "n", "total")


_EVENT_WINDOWS = """SELECT floor(epoch(ts))::BIGINT // 21600 * 21600 AS start_s, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2"""


def growth_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    order = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").withColumn("n", F.floor(F.col("value") * 4))
    e = e.withColumns({"oldest": F.lag("n", 4).over(order), "before": F.lag("n", 1).over(order)})
    return e.where((F.col("n") > 50) & (F.col("n") - F.col("oldest") >= 20) & (F.col("n") > F.col("before"))).select("user_id", "event_id")


_GROWTH_CANDIDATES = """SELECT user_id, event_id FROM (SELECT user_id, event_id, n, lag(n, 4) OVER w AS o, lag(n) OVER w AS b FROM (SELECT *, floor(value * 4) AS n FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE n > 50 AND n - o >= 20 AND n > b"""


def stream_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    block = F.concat(F.lit('event: d\ndata: {"usage": {"input_tokens": '), F.col("event_id") % 100, F.lit(', "output_tokens": '), F.col("event_id") % 37, F.lit("}}\n\n"))
    streams = e.select(F.col("user_id").cast("string").alias("stream_id"), "event_id", block.alias("b")).groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "b"))), lambda x: x["b"]), "").alias("payload"))
    return restore.usage(restore.sse_events(streams))


_STREAM_USAGE = "SELECT user_id::VARCHAR AS stream_id, max(event_id % 100) AS input_tokens, max(event_id % 37) AS output_tokens FROM events GROUP BY user_id"


QUERIES = [
    newest_memories, memory_window, strongest_nodes, decay_pass, reinforced_nodes, memory_batches, table_counts, memory_feed, audit_turns, tool_counts, agent_access, live_tokens, request_dispatch, detection_scores,
    promoted_facts, display_edges, upserted_rows, orphan_calls, order_page, share_levels, deleted_after, pseudonyms, spending, balances, refills, permissions, unowned, tag_changes, moved_positions, rate_limited,
    content_openings, category_counts, dominant_segment, token_listing, last_times, queue_drain, bus_backlog, runaway_growth, restored_streams, event_windows, growth_candidates, stream_usage,
]

SQL = {
    "newest_memories": _NEWEST_MEMORIES, "memory_window": _MEMORY_WINDOW, "strongest_nodes": _STRONGEST_NODES, "decay_pass": _DECAY_PASS, "reinforced_nodes": _REINFORCED_NODES, "memory_batches": _MEMORY_BATCHES,
    "table_counts": _TABLE_COUNTS, "memory_feed": _MEMORY_FEED, "audit_turns": _AUDIT_TURNS, "tool_counts": _TOOL_COUNTS, "agent_access": _AGENT_ACCESS, "live_tokens": _LIVE_TOKENS, "request_dispatch": _REQUEST_DISPATCH,
    "detection_scores": _DETECTION_SCORES, "promoted_facts": _PROMOTED_FACTS, "display_edges": _DISPLAY_EDGES, "upserted_rows": _UPSERTED_ROWS, "orphan_calls": _ORPHAN_CALLS, "order_page": _ORDER_PAGE,
    "share_levels": _SHARE_LEVELS, "deleted_after": _DELETED_AFTER, "pseudonyms": _PSEUDONYMS, "spending": _SPENDING, "balances": _BALANCES, "refills": _REFILLS, "permissions": _PERMISSIONS, "unowned": _UNOWNED,
    "content_openings": _CONTENT_OPENINGS, "category_counts": _CATEGORY_COUNTS, "dominant_segment": _DOMINANT_SEGMENT, "token_listing": _TOKEN_LISTING, "last_times": _LAST_TIMES, "queue_drain": _QUEUE_DRAIN,
    "bus_backlog": _BUS_BACKLOG, "tag_changes": _TAG_CHANGES, "moved_positions": _MOVED_POSITIONS, "restored_streams": _RESTORED_STREAMS, "event_windows": _EVENT_WINDOWS, "growth_candidates": _GROWTH_CANDIDATES, "stream_usage": _STREAM_USAGE,
}
