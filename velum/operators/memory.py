"""Maintenance of long-term memory: windows, decay, promotion, duplicates, chunks, graph edges and digests."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from velum.io import cut
from velum.operators import overlap
from velum.operators.neighbours import build, pairs_within, search
from velum.operators.retrieval import knn
from velum.operators.rounds import heads

DECAY_FLAG, MERGE_COSINE = 0.15, 0.88
STORE_CHARS, CHUNK_CHARS = 20, 1500
# Wording of plans that may be stale, and openings of prompts that agents send.
FUTURE = ("planning", "plans to", "intends to", "is migrating", "is transitioning", "is setting up", "is considering", "is expanding", "is investigating")
AGENT_OPENINGS = (
    "Provide a concise, 5-word-or-less title for", "Provide a concise title for", "Generate a title for the conversation", "The user stepped away and is coming back",
    "Recap in under ", "Summarize the following conversation", "The assistant can create and reference artifacts during conversations",
)
STOP_WORDS = (
    "the", "a", "an", "is", "are", "was", "were", "has", "have", "had", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "be",
    "that", "this", "their", "they", "it", "its", "i", "my", "your", "our", "not", "no", "uses", "use", "using", "also",
)


def moment(text: Column) -> Column:
    """A timestamp from RFC 3339 or `yyyy-MM-dd HH:mm:ss` text (UTC); null from anything else."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(text))


def window(memories: DataFrame, start: str, end: str, digests: bool = False, limit: int | None = None) -> DataFrame:
    """Memories of [start, end) with 20 characters or more, oldest first; rows of metadata type `digest` only if asked."""
    out = memories.where((F.col("occurred_at") >= F.lit(start).cast("timestamp")) & (F.col("occurred_at") < F.lit(end).cast("timestamp")) & (F.char_length("content") >= STORE_CHARS))
    if not digests:
        out = out.where(~F.get_json_object("metadata", "$.type").eqNullSafe("digest"))
    out = out.orderBy("occurred_at", "id")
    return out.limit(limit) if limit else out


def decayed(confidence: Column, accesses: Column, days: Column) -> Column:
    """max(0, confidence * exp(-days / (1 + accesses / 2)))."""
    return F.greatest(F.lit(0.0), confidence * F.exp(-days / (1 + accesses * 0.5)))


def decay(nodes: DataFrame, now: Column) -> DataFrame:
    """`nodes` (confidence, access_count, last_accessed_at, decay_score, ...) with new decay_score, flagged and newly."""
    days = (F.unix_micros(now) - F.unix_micros(F.col("last_accessed_at").cast("timestamp"))) / 86_400_000_000
    fresh = nodes.withColumn("_s", decayed(F.col("confidence"), F.col("access_count"), days))
    return fresh.withColumn("flagged", F.col("_s") < DECAY_FLAG).withColumn("newly", F.col("flagged") & ~(F.col("decay_score") < DECAY_FLAG)).withColumn("decay_score", F.col("_s")).drop("_s")


def reinforce(nodes: DataFrame, touched: DataFrame, now: Column) -> DataFrame:
    """`nodes` with access_count and last_accessed_at moved on for ids in `touched` (id), once for each occurrence."""
    count = touched.groupBy("id").agg(F.count("*").alias("_n"))
    joined = nodes.join(count, "id", "left")
    return joined.withColumn("access_count", F.col("access_count") + F.coalesce("_n", F.lit(0))).withColumn("last_accessed_at", F.when(F.col("_n").isNotNull(), now).otherwise(F.col("last_accessed_at"))).drop("_n")


def consolidation_start(runs: DataFrame, now: Column, days: int = 1) -> DataFrame:
    """(window_start): the earlier of the last run's end and `days` before now."""
    return runs.agg(F.least(F.max("window_end"), now - F.make_interval(days=F.lit(days))).alias("window_start"))


def batches(rows: DataFrame, size: int, by: str, order: list[str]) -> DataFrame:
    """`rows` with batch: consecutive `size` rows of each `by`, counted from 0 in the given order."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1) / size).cast("long"))


def excerpts(rows: DataFrame, size: int, by: str, order: list[str], chars: int = 400) -> DataFrame:
    """(by, batch, n, text): batches() with the contents of each as lines, cut to `chars`."""
    numbered = batches(rows.select(by, "content", *order), size, by, order)
    lined = numbered.groupBy(by, "batch").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(*order, F.substring("content", 1, chars).alias("line")))).alias("x"))
    return lined.select(by, "batch", "n", F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("text"))


def new_openings(facts: DataFrame, chars: int = 80) -> DataFrame:
    """Facts (id, content) whose first `chars` characters (case and outer white space aside) no smaller id has."""
    key = F.trim(F.lower(F.substring("content", 1, chars)))
    first = facts.withColumn("_k", key).where("_k != ''").groupBy("_k").agg(F.min(F.struct("id", "content")).alias("x"))
    return first.select("x.id", "x.content")


def pass_totals(passes: DataFrame) -> DataFrame:
    """(promoted, reinforced, batches) over all profiles of one run (profile, promoted, reinforced, batches)."""
    return passes.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("promoted", "reinforced", "batches")))


def user_texts(rows: DataFrame, since: Column | None = None) -> DataFrame:
    """Memories (content, metadata, occurred_at, ...) that users wrote, of 20 characters or more, from `since` on."""
    out = rows.where((F.get_json_object("metadata", "$.role") == "user") & (F.char_length("content") >= STORE_CHARS))
    return out if since is None else out.where(F.col("occurred_at") >= since)


def injected(hits: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, id, content, rank): the best hits (query_id, id, content, rank) that no agent has sent itself."""
    own = hits.where(~automation(F.col("content")))
    ranked = own.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "id")))
    return ranked.where(F.col("_n") <= most).select("query_id", "id", "content", F.col("_n").alias("rank"))


def unfenced(text: Column) -> Column:
    """JSON text without a surrounding code fence."""
    return F.regexp_replace(F.trim(text), r"^```(?:json)?\s*|\s*```$", "")


def promote(facts: DataFrame, nodes: DataFrame, least: float = MERGE_COSINE) -> DataFrame:
    """(fact_id, node_id, cosine, action): the most similar node of each fact, `reinforce` at `least` or `insert`.

    `facts` has fact_id, profile, vector, `nodes` node_id, profile, vector (integer ids); they are compared within a
    profile, facts in blocks against all nodes. Ties go to the smallest node. Facts of one call don't see each other's new nodes: call it batch by batch for that.
    """
    asked = facts.select(F.col("fact_id").alias("query_id"), "vector", "profile")
    best = knn(asked, nodes.select(F.col("node_id").alias("id"), "vector", "profile"), 1, by="profile")
    best = best.select(F.col("query_id").alias("fact_id"), F.col("id").alias("node_id"), (1 - F.col("distance")).alias("cosine"))
    out = facts.select("fact_id").join(best, "fact_id", "left")
    hit = F.coalesce(F.col("cosine") >= least, F.lit(False))
    return out.select("fact_id", F.when(hit, F.col("node_id")).alias("node_id"), "cosine", F.when(hit, "reinforce").otherwise("insert").alias("action"))


def promote_in_order(facts: DataFrame, nodes: DataFrame, least: float = MERGE_COSINE, lists: int | None = None) -> DataFrame:
    """(fact_id, node_id, as_fact, cosine, action): promote() one fact after the other, in the order of fact_id.

    A fact sees the nodes and what earlier facts of its profile have become: it reinforces the most similar of them at
    `least` or more (a node with the least node_id, else a fact's node with the least fact_id, where cosines are equal),
    or is inserted. `node_id` is a node, `as_fact` the fact whose new node is meant (an inserted fact's own id).
    `facts` has fact_id, profile, vector, `nodes` node_id, profile, vector (integer ids that don't repeat).

    Nothing is done fact by fact: which facts are inserted is a first choice along their order over links between facts
    without a node (rounds.heads()), and links come from inverted lists. Equal vectors are linked once.
    """
    rows = cut(facts.select(F.col("fact_id").cast("long").alias("fact_id"), "profile", F.col("vector").cast("array<double>").alias("vector")))
    held = rows.where(F.col("vector").isNotNull() & F.exists("vector", lambda x: x != 0))  # others are like nothing
    near = search(held.select(F.col("fact_id").alias("query_id"), "vector", "profile"), build(nodes.select(F.col("node_id").alias("id"), "vector", "profile"), lists, "profile"), 1, exact=True, by="profile")
    near = cut(near.select(F.col("query_id").alias("fact_id"), F.col("id").alias("node_id"), (1 - F.col("distance")).alias("cosine")).where(F.col("cosine") >= least))
    once = cut(held.groupBy("profile", "vector").agg(F.min("fact_id").alias("id")))
    links = cut(pairs_within(once.select("id", "vector", "profile"), least, "profile", lists))
    bare = once.select("id").join(near.select(F.col("fact_id").alias("id")), "id", "left_anti")
    free = links.join(bare.select(F.col("id").alias("a")), "a", "left_semi").join(bare.select(F.col("id").alias("b")), "b", "left_semi")
    chosen = heads(free)
    inserted = cut(bare.join(chosen, "id", "left").where(F.coalesce("head", F.lit(True))).select("id"))
    # What a fact may reinforce: earlier inserted facts linked to it, or equal to it, and its best node.
    both = links.select("a", "b", "cosine").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine"))
    to_new = both.join(inserted.select(F.col("id").alias("a")), "a", "left_semi").unionAll(inserted.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0)))
    copies = held.join(once.withColumnRenamed("id", "rep"), ["profile", "vector"]).select("fact_id", F.col("rep").alias("b"))
    options = copies.join(to_new, "b").where(F.col("a") < F.col("fact_id")).select("fact_id", F.lit(None).cast("long").alias("node_id"), F.col("a").alias("as_fact"), "cosine")
    options = options.unionAll(near.select("fact_id", "node_id", F.lit(None).cast("long").alias("as_fact"), "cosine"))
    best = options.groupBy("fact_id").agg(F.min(F.struct((-F.round("cosine", 12)).alias("c"), F.col("node_id").isNull().alias("new"), "node_id", "as_fact", "cosine")).alias("x")).select("fact_id", "x.node_id", "x.as_fact", "x.cosine")
    out = rows.select("fact_id").join(best, "fact_id", "left")
    hit = F.col("cosine").isNotNull()
    return out.select("fact_id", "node_id", F.when(hit, F.col("as_fact")).otherwise(F.col("fact_id")).alias("as_fact"), "cosine", F.when(hit, "reinforce").otherwise("insert").alias("action"))


def promoted(facts: DataFrame, nodes: DataFrame, decisions: DataFrame, now: Column) -> DataFrame:
    """`nodes` (node_id, profile, content, confidence, access_count, last_accessed_at) after promote_in_order().

    Reinforced nodes are counted and touched once a fact; inserted facts (fact_id, profile, content, confidence) follow with
    the confidence held within 0.1 to 1, numbered behind the largest node_id by how far their fact_id is from the smallest.
    """
    touched = decisions.where("action = 'reinforce'")
    by_node = touched.where("node_id IS NOT NULL").groupBy("node_id").agg(F.count("*").alias("_n"))
    by_fact = touched.where("node_id IS NULL").groupBy(F.col("as_fact").alias("fact_id")).agg(F.count("*").alias("_n"))
    moved = F.when(F.col("_n").isNotNull(), now)
    count = F.col("access_count") + F.coalesce("_n", F.lit(0))
    old = nodes.join(by_node, "node_id", "left").select("node_id", "profile", "content", "confidence", count.cast("long").alias("access_count"), F.coalesce(moved, "last_accessed_at").alias("last_accessed_at"))
    new = facts.join(decisions.where("action = 'insert'").select("fact_id"), "fact_id").join(by_fact, "fact_id", "left")
    held = F.least(F.lit(1.0), F.greatest(F.lit(0.1), F.col("confidence")))
    top = nodes.agg(F.coalesce(F.max("node_id"), F.lit(-1)).cast("long").alias("_top")).crossJoin(facts.agg(F.min("fact_id").alias("_low")))
    behind = new.crossJoin(F.broadcast(top))  # one row
    number = F.col("_top") + 1 + F.col("fact_id") - F.col("_low")
    return old.unionAll(behind.select(number.cast("long").alias("node_id"), "profile", "content", held.alias("confidence"), F.coalesce("_n", F.lit(0)).cast("long").alias("access_count"), moved.alias("last_accessed_at")))


def noisy(text: Column) -> Column:
    """True for code, logs, terminal output and JSON."""
    return (
        text.rlike(r"^(?:```|root@|FROM |RUN )") | ((F.regexp_count(text, F.lit("\n")) > 15) & (F.regexp_count(text, F.lit("    ")) > 5)) | text.rlike("node_modules|package-lock")
        | (F.regexp_count(text, F.lit(r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}")) >= 3) | text.rlike(r"^\s*[\{\[]")
    )


def automation(text: Column) -> Column:
    """True for prompts that agents send themselves: upper-case markers, envelopes of tags, known openings."""
    start = F.ltrim(text)
    marker = start.rlike(r"^\[(?=[^:\]]*[A-Z])[A-Z0-9 _]+(?:[:\]]|$)")
    known = F.lit(False)
    for opening in AGENT_OPENINGS:
        known = known | F.startswith(start, F.lit(opening))
    return marker | start.rlike(r"^<[a-z][a-z0-9_\-]{0,30}>") | known


def storable(text: Column) -> Column:
    """True for user texts worth keeping."""
    return (F.char_length(F.trim(text)) >= STORE_CHARS) & ~automation(text) & ~F.trim(text).rlike(r"^[a-z0-9_\-]+$")


def chunks(text: Column, most: int = CHUNK_CHARS, least: int = STORE_CHARS) -> Column:
    """Paragraphs of at least `least` characters of texts beyond `most`; the whole text otherwise or if one is left."""
    parts = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.trim(p)), lambda p: F.char_length(p) >= least)
    return F.when((F.char_length(text) > most) & (F.size(parts) > 1), parts).otherwise(F.array(F.trim(text)))


def future_plans(facts: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Facts (content, ...) that speak of plans, without those that hold a phrase of `keep`."""
    plan = F.col("content").rlike("(?i)" + "|".join(FUTURE))
    kept = F.lit(False)
    for phrase in keep:
        kept = kept | F.contains("content", F.lit(phrase))
    return facts.where(plan & ~kept)


def review_answers(plans: DataFrame, classify: Callable[[str], str]) -> DataFrame:
    """(id, answer): what `classify` says of each plan (id, content), as JSON with status, reason and rewrite, fenced or not."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"id": frame["id"], "answer": [classify(t or "") for t in frame["content"]]}).astype({"answer": "object"})

    return plans.select(F.col("id").cast("long").alias("id"), "content").mapInPandas(work, "id long, answer string")


def review_decisions(answers: DataFrame) -> DataFrame:
    """(id, status, reason, rewrite) of answers (id, answer): keep, completed, abandoned or stale; anything else is error."""
    read = answers.select("id", F.from_json(unfenced(F.col("answer")), "status string, reason string, rewrite string").alias("a"))
    known = F.col("a.status").isin("keep", "completed", "abandoned", "stale")
    return read.select("id", F.when(known, F.col("a.status")).otherwise("error").alias("status"), "a.reason", "a.rewrite")


def reviewed(facts: DataFrame, decisions: DataFrame, confidence: float = 0.9) -> DataFrame:
    """`facts` (id, content, confidence, ...) after a review (id, status, rewrite; one row an id), with `status` (null: not reviewed).

    Completed plans with a rewrite get its wording and `confidence`, abandoned ones go, all others stay as they are.
    """
    joined = facts.join(decisions.select("id", "status", F.col("rewrite").alias("_rewrite")), "id", "left").where(~F.col("status").eqNullSafe("abandoned"))
    done = (F.col("status") == "completed") & (F.coalesce("_rewrite", F.lit("")) != "")
    changed = joined.withColumn("confidence", F.when(done, confidence).otherwise(F.col("confidence"))).withColumn("content", F.when(done, F.col("_rewrite")).otherwise(F.col("content")))
    return changed.select(*facts.columns, "status")


def fact_words(text: Column) -> Column:
    """Distinct words of three letters or more without stop words."""
    return F.filter(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]+)"), 1)), lambda w: (F.char_length(w) > 2) & ~w.isin(*STOP_WORDS))


def similar_pairs(facts: DataFrame, least: float, words: Callable[[Column], Column] = fact_words) -> DataFrame:
    """(a, b, jaccard): pairs of facts (id, content), a < b, whose word sets overlap by at least `least` (above 0).

    Equal sets are compared once (overlap.within()); their facts are put in at the end, as every pair is a row.
    """
    members, pairs = overlap.within(facts, words(F.col("content")), least)
    members = cut(members)
    of = lambda name, at: members.select(F.col("id").alias(name), F.col("set").alias(at))
    found = pairs.join(of("_a", "x"), "x").join(of("_b", "y"), "y").where("_a != _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), "jaccard")
    same = of("a", "x").join(of("b", "x"), "x").where("a < b").select("a", "b", F.lit(1.0).alias("jaccard"))
    return found.unionAll(same)


def clusters(facts: DataFrame, least: float = 0.25) -> DataFrame:
    """(id, seed): greedy stars in the order of id. A fact not yet taken becomes a seed and takes its later neighbours.

    Of facts with equal word sets only the first can be a seed, and the others go where it goes. Links between such first
    facts come from overlap.within(); which are seeds is settled in blocks of links (rounds.heads()), and each other one
    goes to the first seed linked to it.
    """
    members, pairs = overlap.within(facts, fact_words(F.col("content")), least)
    members = cut(members)
    first = members.groupBy("set").agg(F.min("id").alias("rep"))
    of = lambda name, at: first.select(F.col("rep").alias(name), F.col("set").alias(at))
    both = pairs.join(of("_a", "x"), "x").join(of("_b", "y"), "y")
    links = cut(both.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")))
    seeds = heads(links).where("head").select(F.col("id").alias("a"))
    taken = links.join(seeds, "a").groupBy("b").agg(F.min("a").alias("seed"))
    settled = first.join(taken, F.col("rep") == F.col("b"), "left").select("set", F.coalesce("seed", "rep").alias("seed"))
    own = members.join(settled, "set").groupBy("id").agg(F.min("seed").alias("seed"))
    return facts.select("id").join(own, "id", "left").select("id", F.coalesce("seed", "id").alias("seed"))


def not_covered(candidates: DataFrame, existing: DataFrame, most: float = 0.7) -> DataFrame:
    """Candidates (id, content) whose white-space words overlap with no existing fact (content) by more than `most`.

    Sets meet by their rarest words (overlap.meeting()); candidates too large or too small for any fact are left alone.
    """
    split = lambda c: F.array_sort(F.filter(F.array_distinct(F.split(F.lower(c), r"\s+")), lambda w: w != ""))
    made = lambda df: df.select(split(F.col("content")).alias("w")).select(overlap.set_key(F.col("w")).alias("key"), "w")
    covered = overlap.meeting(made(candidates), made(existing), most).where(F.col("jaccard") > most).select("key").distinct()
    return candidates.withColumn("key", overlap.set_key(split(F.col("content")))).join(covered, "key", "left_anti").drop("key")


def not_known(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidates whose content isn't there already, case and outer white space aside; the first id of equal ones stays."""
    key = F.lower(F.trim("content"))
    once = candidates.withColumn("_k", key).withColumn("_r", F.row_number().over(Window.partitionBy("_k").orderBy("id"))).where("_r = 1")
    return once.join(existing.select(key.alias("_k")).distinct(), "_k", "left_anti").drop("_k", "_r")


def display_edges(nodes: DataFrame, strong: float = 1.0, weak: float = 0.3) -> DataFrame:
    """(a, b, strength) of a bounded set of nodes (id, type, category, content) chosen for display.

    Equal category: strong. Else equal type: weak. Else strong times the number of shared keywords, three at most.
    Every pair of nodes is looked at, so `nodes` is to be limited before, as a display is.
    """
    keyed = nodes.select("id", "type", "category", F.filter(F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit("([a-z0-9]+)"), 1)), lambda w: (F.char_length(w) > 3) & ~w.isin(*STOP_WORDS, "been")).alias("w"))
    a = keyed.select(*(F.col(c).alias(f"{c}_a") for c in keyed.columns))
    b = keyed.select(*(F.col(c).alias(f"{c}_b") for c in keyed.columns))
    shared = F.size(F.array_intersect("w_a", "w_b"))
    strength = F.when((F.col("category_a") != "") & (F.col("category_a") == F.col("category_b")), F.lit(strong)).when(F.col("type_a") == F.col("type_b"), F.lit(weak)).when(shared >= 1, strong * F.least(shared, F.lit(3)))
    return a.join(b, F.col("id_a") < F.col("id_b")).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), strength.alias("strength")).where("strength IS NOT NULL")


def edge_upsert(existing: DataFrame, found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (source_id, target_id, relationship, confidence) after adding `found` (source, target as node contents).

    Endpoints must equal a node's content, loops go, a new edge replaces an equal one.
    """
    by = lambda c: nodes.select(F.col("id").alias(f"{c}_id"), F.col("content").alias(c))
    fresh = found.join(by("source"), "source").join(by("target"), "target").where("source_id != target_id").select("source_id", "target_id", "relationship", "confidence", F.lit(1).alias("_n"))
    every = existing.select("source_id", "target_id", "relationship", "confidence", F.lit(0).alias("_n")).unionByName(fresh)
    last = every.groupBy("source_id", "target_id", "relationship").agg(F.max(F.struct("_n", "confidence")).alias("s"))
    return last.select("source_id", "target_id", "relationship", "s.confidence")


def upsert(existing: DataFrame, fresh: DataFrame, key: list[str], replace: bool = True) -> DataFrame:
    """`existing` with `fresh` (same columns, one row a key): new rows replace equal keys, or yield to them."""
    lost, won = (existing, fresh) if replace else (fresh, existing)
    return lost.join(won.select(*key), key, "left_anti").unionByName(won)


def tagged(metadata: Column, name: str, value: Column) -> Column:
    """A string map with `name` set, or unset where the value is null."""
    rest = F.map_filter(metadata, lambda k, v: k != name)
    return F.when(value.isNull(), rest).otherwise(F.map_concat(rest, F.create_map(F.lit(name), value)))


def digest(memories: DataFrame, day: str) -> DataFrame:
    """(line): a Markdown digest of one day's memories (profile, type, content, occurred_at)."""
    some = memories.where(F.to_date("occurred_at") == F.lit(day).cast("date"))
    stats = some.groupBy("profile", "type").agg(F.count("*").alias("n"), F.min("occurred_at").alias("first"), F.max("occurred_at").alias("last"))
    lines = stats.select("profile", "type", F.format_string("- %s / %s: %d between %s and %s", "profile", "type", "n", F.date_format("first", "HH:mm"), F.date_format("last", "HH:mm")).alias("line"))
    head = memories.sparkSession.createDataFrame([("", "", f"# {day} digest")], "profile string, type string, line string")
    return head.unionAll(lines).orderBy("profile", "type").select("line")


def extract(texts: DataFrame, extractor: Callable[[str], list[str]]) -> DataFrame:
    """(id, fact): what `extractor` finds in each text (id, content); any model may be put behind it."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, f) for i, t in zip(frame["id"], frame["content"], strict=True) for f in extractor(t or "")]
            yield pd.DataFrame(rows, columns=["id", "fact"]).astype({"id": "int64", "fact": "object"})

    return texts.select(F.col("id").cast("long").alias("id"), "content").mapInPandas(work, "id long, fact string")
