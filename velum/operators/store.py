"""Queries of the memory store: lists, counts, audit trails and access rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What the tiers of agents may do: (tier, write, read identity facts, only profile).
TIERS = (
    ("trusted", True, True, None),
    ("standard", True, False, "work"),
    ("public", False, False, "public"),
)
# The reach of the tiers over assigned profiles: (tier, read identity facts, of these categories only, own
# profile only).
REACH = (("trusted", True, None, False), ("standard", False, None, True), ("public", True, ("preference",), False))


def newest(rows: DataFrame, limit: int, at: str = "occurred_at", profile: str | None = None) -> DataFrame:
    """The newest rows, of one profile if given; ties by id."""
    if profile is not None:
        rows = rows.where(F.col("profile") == profile)
    return rows.orderBy(F.desc(at), F.desc("id")).limit(limit)


def strongest(nodes: DataFrame, limit: int, least_confidence: float = 0.0, least_decay: float = 0.0, category: str | None = None) -> DataFrame:
    """Nodes by confidence, then decay score, then id."""
    some = nodes.where((F.col("confidence") >= least_confidence) & (F.col("decay_score") >= least_decay))
    if category is not None:
        some = some.where(F.col("category") == category)
    return some.orderBy(F.desc("confidence"), F.desc("decay_score"), "id").limit(limit)


def stats(**tables: DataFrame) -> DataFrame:
    """(name, n): the rows of each table, one scan of each."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = row if out is None else out.unionAll(row)
    return out


def feed(limit: int, **tables: DataFrame) -> DataFrame:
    """(type, id, content, at): the newest `limit` rows of each table in one shape."""
    out = None
    for name, df in tables.items():
        rows = df.select(F.lit(name).alias("type"), "id", "content", "at").orderBy(F.desc("at"), F.desc("id")).limit(limit)
        out = rows if out is None else out.unionByName(rows)
    return out


def turns_with_tokens(turns: DataFrame, mappings: DataFrame) -> DataFrame:
    """`turns` (turn_id, ...) with their token mappings (id, turn_id, token, original, direction) as an ordered array."""
    held = mappings.groupBy("turn_id").agg(F.array_sort(F.collect_list(F.struct("id", "token", "original", "direction"))).alias("mappings"), F.countDistinct("token").alias("n_tokens"))
    return turns.join(held, "turn_id", "left").withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0).cast("long")))


def allowed(rows: DataFrame, agents: DataFrame) -> DataFrame:
    """(agent_id, *rows): what each agent (agent_id, tier) may read of rows (profile, kind, ...).

    Trusted agents read all, others only the profile of their tier and no identity facts. Rows are joined by tier.
    """
    may = [F.when((F.lit(identity) | (F.col("kind") != "identity")) & (F.lit(only is None) | (F.col("profile") == F.lit(only))), F.lit(tier)) for tier, _, identity, only in TIERS]
    open_to = rows.withColumn("tier", F.explode(F.filter(F.array(*may), lambda t: t.isNotNull())))
    return agents.select("agent_id", "tier").join(open_to, "tier").select("agent_id", *rows.columns)


def reach(rows: DataFrame, agents: DataFrame) -> DataFrame:
    """(agent_id, *rows): what each agent (agent_id, tier, profile) reaches of rows (profile, kind, category, ...).

    Standard agents read no identity facts and only their assigned profile (all where none is assigned), public ones only
    identity facts of the category `preference`, trusted ones all; unknown tiers read nothing. Joined by tier, so an
    agent meets only rows that its tier may see.
    """
    fact = F.col("kind") == "identity"
    may = [F.when(~fact | (F.lit(identity) & (F.lit(only is None) | F.col("category").isin(*(only or ("",))))), F.lit(tier)) for tier, identity, only, _ in REACH]
    open_to = rows.withColumn("tier", F.explode(F.filter(F.array(*may), lambda t: t.isNotNull())))
    scoped = F.col("tier").isin(*(tier for tier, *_, own in REACH if own))
    held = agents.select("agent_id", "tier", F.col("profile").alias("_own")).join(open_to, "tier")
    return held.where(~scoped | F.col("_own").isNull() | (F.col("_own") == F.col("profile"))).select("agent_id", *rows.columns)


def profiles(rows: DataFrame, name: str | None = None) -> DataFrame:
    """Profiles (id, name, created_at), oldest first; the oldest of one name if given."""
    some = rows if name is None else rows.where(F.col("name") == name)
    ordered = some.orderBy("created_at", "id")
    return ordered if name is None else ordered.limit(1)


def recent_nodes(nodes: DataFrame, limit: int = 1000, least_confidence: float = 0.0, least_decay: float = 0.0) -> DataFrame:
    """Nodes with at least this confidence and decay score, the newest first."""
    some = nodes.where((F.col("confidence") >= least_confidence) & (F.col("decay_score") >= least_decay))
    return some.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def with_rows(hits: DataFrame, rows: DataFrame) -> DataFrame:
    """Search hits (id, ...) with the rows of their ids; hits without a row go."""
    return hits.join(rows, "id")


def migrated(vectors: DataFrame, memories: DataFrame) -> DataFrame:
    """(type, memory_id, profile, embedding): vectors (memory_id, type, embedding) moved to the layout with profiles.

    The profile comes from the memory row (id, type, profile) of episodic and semantic vectors, and a vector without one
    goes; identity vectors have none. Unreadable (null or empty) vectors go.
    """
    sound = vectors.where(F.size("embedding") > 0)
    owned = memories.select(F.col("id").alias("memory_id"), "type", "profile")
    moved = sound.where("type IN ('episodic', 'semantic')").join(owned, ["memory_id", "type"])
    facts = sound.where("type = 'identity'").withColumn("profile", F.lit(None).cast(owned.schema["profile"].dataType))
    return moved.unionByName(facts).select("type", "memory_id", "profile", "embedding")


def looked_up(rows: DataFrame, key: str, other: DataFrame, other_key: str, out: str, order: str | None = None) -> DataFrame:
    """`rows` with `out`: the first row of `other` (by `order`, else its columns) with that key as a struct, else null.

    Rows without a partner stay. The first row is a grouped minimum, so a key with very many rows stays small.
    """
    held = F.struct(*([F.col(order).alias("_order")] if order else []), *(c for c in other.columns if c != other_key))
    first = other.where(F.col(other_key).isNotNull()).groupBy(F.col(other_key).alias(key)).agg(F.min(held).alias(out))
    joined = rows.join(first, key, "left")
    return joined.withColumn(out, F.col(out).dropFields("_order")) if order else joined


def original_counts(mappings: DataFrame) -> DataFrame:
    """(original, profile, n): token mappings of each original by profile, and over all profiles (profile null)."""
    by = mappings.where("profile IS NOT NULL").groupBy("original", "profile").agg(F.count("*").alias("n"))
    whole = mappings.groupBy("original").agg(F.count("*").alias("n"))
    return by.unionByName(whole.withColumn("profile", F.lit(None).cast(mappings.schema["profile"].dataType)))


def recorded(log: DataFrame, writes: DataFrame, now) -> DataFrame:
    """`log` (operation, payload, status, processed_at) with a finished row for each write (operation, payload struct)."""
    done = writes.select("operation", F.to_json("payload").alias("payload"), F.lit("done").alias("status"), now.alias("processed_at"))
    return log.select("operation", "payload", "status", "processed_at").unionByName(done)


def forgotten(memories: DataFrame, vectors: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(memories, vectors) without the memories of `ids` (id) and their vectors (memory_id)."""
    gone = ids.select("id").distinct()
    return memories.join(gone, "id", "left_anti"), vectors.join(gone.withColumnRenamed("id", "memory_id"), "memory_id", "left_anti")


def purged(rows: DataFrame, key: str) -> DataFrame:
    """`rows` whose key is neither null nor empty."""
    return rows.where(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))


def live_tokens(tokens: DataFrame, agents: DataFrame, now) -> DataFrame:
    """(token_hash, agent_id, tier): tokens that haven't expired, with their agents."""
    return tokens.where(F.col("expires_at").isNull() | (F.col("expires_at") > now)).join(agents, "agent_id").select("token_hash", "agent_id", "tier")


def dispatch(requests: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """`requests` (host, path) with handler: of the first rule (host, path prefix, handler) that fits, else pass."""
    out = F.lit("pass")
    for host, prefix, handler in reversed(rules):
        out = F.when((F.col("host") == host) & F.startswith("path", F.lit(prefix)), handler).otherwise(out)
    return requests.withColumn("handler", out)


def scores(gold: DataFrame, found: DataFrame) -> DataFrame:
    """(kind, tp, fp, fn, precision, recall, f1) of found against gold entities (doc_id, kind, text), per kind and overall.

    Texts match without regard to case; equal ones are matched one to one by number.
    """
    rows = lambda df, g: df.select("doc_id", "kind", F.lower("text").alias("key"), F.lit(g).cast("long").alias("g"), F.lit(1 - g).cast("long").alias("f"))
    both = rows(gold, 1).unionAll(rows(found, 0)).groupBy("doc_id", "kind", "key").agg(F.sum("g").alias("g"), F.sum("f").alias("f"))
    sums = both.select("kind", F.least("g", "f").alias("tp"), F.greatest(F.col("f") - F.col("g"), F.lit(0)).alias("fp"), F.greatest(F.col("g") - F.col("f"), F.lit(0)).alias("fn"))
    each = sums.groupBy("kind").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    every = each.unionAll(each.withColumn("kind", F.lit("overall"))).groupBy("kind").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    p, r = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return every.withColumns({"precision": p, "recall": r}).withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def openings(rows: DataFrame, chars: int = 200) -> DataFrame:
    """(opening, content, at, n): rows (content, at, id) grouped by their first characters, with the newest content."""
    newest_one = F.max(F.struct("at", "id", "content"))
    got = rows.groupBy(F.substring("content", 1, chars).alias("opening")).agg(newest_one.alias("x"), F.count("*").alias("n"))
    return got.select("opening", "x.content", "x.at", "n")


def category_counts(categories: DataFrame, rows: DataFrame) -> DataFrame:
    """(category, n): rows of each listed category, 0 where there is none."""
    counted = rows.groupBy("category").agg(F.count("*").alias("n"))
    return categories.select("category").join(counted, "category", "left").select("category", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def dominant(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, value): the most frequent value of each group, the smallest of equally frequent ones."""
    counted = rows.groupBy(by, value).agg(F.count("*").alias("_n"))
    return counted.groupBy(by).agg(F.min(F.struct((-F.col("_n")).alias("_n"), F.col(value))).alias("_x")).select(by, f"_x.{value}")


def listing(rows: DataFrame, by: str) -> DataFrame:
    """(by, total, text): the sum of tokens of rows (key, value, tokens, at) and their listing, oldest first."""
    line = F.concat(F.date_format("at", "yyyy-MM-dd"), F.lit(" ["), F.col("tokens").cast("string"), F.lit("] "), "key", F.lit(": "), "value")
    got = rows.groupBy(by).agg(F.sum("tokens").alias("total"), F.array_sort(F.collect_list(F.struct("at", "key", line.alias("line")))).alias("x"))
    return got.select(by, "total", F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("text"))


def last_times(**tables: DataFrame) -> DataFrame:
    """(name, last): the newest `at` of each table."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.max("at").alias("last")).select(F.lit(name).alias("name"), "last")
        out = row if out is None else out.unionAll(row)
    return out


def drain(queue: DataFrame, size: int = 50, retries: int = 3) -> DataFrame:
    """`queue` (id, status, attempts, created_at, ok) after one run of a consumer: the oldest pending rows are claimed.

    Those that work (`ok`) become done, the others stay pending with one more attempt, or failed at the last.
    """
    claimed = queue.where("status = 'pending'").orderBy("created_at", "id").limit(size).select("id", F.lit(True).alias("_mine"))
    mine = F.coalesce("_mine", F.lit(False))
    tried = F.col("attempts") + F.when(mine & ~F.col("ok"), 1).otherwise(0)
    status = F.when(mine & F.col("ok"), "done").when(mine & (tried >= retries), "failed").otherwise(F.col("status"))
    return queue.join(claimed, "id", "left").withColumns({"attempts": tried, "status": status}).drop("_mine")


def backlog(events: DataFrame, seen: DataFrame, most: int = 256) -> DataFrame:
    """(subscriber, waiting, lost): events (seq) behind what each subscriber (subscriber, seq) has seen.

    A bus holds the newest `most`; older ones that a subscriber hasn't seen are lost. Sequence numbers have no gaps.
    """
    last = events.agg(F.max("seq").alias("_last"))
    behind = F.greatest(F.col("_last") - F.col("seq"), F.lit(0))
    return seen.crossJoin(F.broadcast(last)).select("subscriber", F.least(behind, F.lit(most)).cast("long").alias("waiting"), F.greatest(behind - most, F.lit(0)).cast("long").alias("lost"))  # one row


def overlap_matches(gold: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, kind, tp, fp, fn): greedy one-to-one matches of entities of which one text holds the other.

    Both have doc_id, ord, kind, text. Found entities are taken in order, each takes the first free gold entity of its
    kind; a document is one group, as the choice is sequential within it.
    """
    import pandas as pd

    rows = gold.select("doc_id", "ord", "kind", "text", F.lit(True).alias("gold")).unionAll(found.select("doc_id", "ord", "kind", "text", F.lit(False)))

    def match(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for kind, some in frame.sort_values("ord").groupby("kind"):
            free = [t.lower() for t in some.loc[some["gold"], "text"]]
            wanted, hits, misses = len(free), 0, 0
            for text in (t.lower() for t in some.loc[~some["gold"], "text"]):
                hit = next((g for g in free if g in text or text in g), None)
                if hit is None:
                    misses += 1
                else:
                    free.remove(hit)
                    hits += 1
            out.append((frame["doc_id"].iloc[0], kind, hits, misses, wanted - hits))
        return pd.DataFrame(out, columns=["doc_id", "kind", "tp", "fp", "fn"])

    return rows.groupBy("doc_id").applyInPandas(match, f"doc_id {gold.schema['doc_id'].dataType.simpleString()}, kind string, tp long, fp long, fn long")
