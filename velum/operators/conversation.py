"""Shaping of message lists, conversation summaries, and routing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from velum.io import cut
from velum.operators.rounds import levels

RESULT_BYTES, HEAD_LINES, TAIL_LINES = 8192, 50, 20
KEEP_MESSAGES, KEEP_IMAGES, CONTEXT_BYTES, HARD_CAP = 40, 3, 640_000, 800_000
#: Levels that are kept apart before they are written as one.
ROUNDS = 16
# Words by which queries are classed, in order.
QUERY_CLASSES = (
    ("code", "code|function|implement|refactor|debug|typescript|javascript|python|sql|class|interface"),
    ("reasoning", "analyze|compare|evaluate|tradeoff|pros and cons|recommend|strategy|architecture|design"),
    ("factual", "what is|who is|when did|where is|how does|define|explain|list|summarize"),
    ("generation", "write|draft|create|generate|compose|document"),
)


def truncated(text: Column) -> Column:
    """Texts beyond 8192 bytes: the first 50 and last 20 lines, or, with fewer lines, the first 8192 bytes of whole
    characters; a line says how much is left out."""
    lines = F.split(text, "\n")
    many = F.size(lines) > HEAD_LINES + TAIL_LINES
    gone = F.size(lines) - HEAD_LINES - TAIL_LINES
    by_line = F.concat_ws("\n", F.slice(lines, 1, HEAD_LINES), F.concat(F.lit("[... "), gone.cast("string"), F.lit(" lines left out ...]")), F.slice(lines, -TAIL_LINES, TAIL_LINES))
    prefix = F.substring(text.cast("binary"), 1, RESULT_BYTES)
    # A cut inside a character leaves a replacement mark at the end, which goes.
    whole = F.regexp_replace(F.make_valid_utf8(prefix.cast("string")), "\ufffd+$", "")
    by_bytes = F.concat(whole, F.lit("\n[... cut ...]"))
    return F.when(F.octet_length(text) <= RESULT_BYTES, text).when(many, by_line).otherwise(by_bytes)


def cull_images(messages: DataFrame, keep: int = KEEP_IMAGES) -> DataFrame:
    """`messages` (conv_id, idx, block, kind, text): image blocks but the newest `keep` become placeholders."""
    newest = F.row_number().over(Window.partitionBy("conv_id", "kind").orderBy(F.desc("idx"), F.desc("block")))
    old = (F.col("kind") == "image") & (newest > keep)
    return messages.withColumn("_old", old).withColumn("text", F.when(F.col("_old"), "[image left out]").otherwise(F.col("text"))).withColumn("kind", F.when(F.col("_old"), "text").otherwise(F.col("kind"))).drop("_old")


def trim(messages: DataFrame, most_bytes: int = CONTEXT_BYTES, keep: int = KEEP_MESSAGES) -> DataFrame:
    """`messages` (conv_id, idx, role, text): in conversations beyond `most_bytes` the first and the last `keep` stay."""
    whole = Window.partitionBy("conv_id")
    size, back = F.sum(F.octet_length("text")).over(whole), F.row_number().over(whole.orderBy(F.desc("idx")))
    first = F.min("idx").over(whole)
    return messages.withColumns({"_s": size, "_b": back, "_f": first}).where((F.col("_s") <= most_bytes) | (F.col("_b") <= keep) | (F.col("idx") == F.col("_f"))).drop("_s", "_b", "_f")


def summaries(messages: DataFrame, user_chars: int = 400, other_chars: int = 300, total: int = 6000) -> DataFrame:
    """(conv_id, summary): turns cut to their caps, joined while the running length stays within `total`."""
    cap = F.when(F.col("role") == "user", user_chars).otherwise(other_chars)
    line = F.concat("role", F.lit(": "), F.substring(F.col("text"), F.lit(1), cap))
    rows = messages.select("conv_id", "idx", line.alias("line"))
    rows = rows.withColumn("_t", F.sum(F.char_length("line") + 1).over(Window.partitionBy("conv_id").orderBy("idx"))).where(F.col("_t") <= total)
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "line"))), lambda x: x["line"]), "\n").alias("summary"))


def trim_summarised(messages: DataFrame, most_bytes: int = CONTEXT_BYTES, keep: int = KEEP_MESSAGES) -> DataFrame:
    """(conv_id, idx, place, role, text, results): trim() with what is left out told in a summary behind the first message.

    `messages` has conv_id, idx, role, text, calls and results (arrays of call ids). A conversation beyond `most_bytes`
    with more than `keep` + 1 messages keeps the first, gets a user message with the summary of the dropped ones (place 1,
    the first's idx), and keeps the last `keep`; results whose call no kept assistant message makes go.
    """
    whole = Window.partitionBy("conv_id")
    sized = messages.withColumns({"_s": F.sum(F.octet_length("text")).over(whole), "_n": F.count("*").over(whole), "_b": F.row_number().over(whole.orderBy(F.desc("idx"))), "_f": F.min("idx").over(whole)})
    cutting = (F.col("_s") > most_bytes) & (F.col("_n") > keep + 1)
    marked = sized.withColumn("_drop", cutting & (F.col("_b") > keep) & (F.col("idx") != F.col("_f")))
    kept = marked.where("NOT _drop")
    live = kept.where("role = 'assistant'").groupBy("conv_id").agg(F.array_distinct(F.flatten(F.collect_list("calls"))).alias("_live"))
    none = F.array().cast("array<string>")
    results = F.when(cutting & (F.col("role") == "user"), F.array_intersect("results", F.coalesce("_live", none))).otherwise(F.col("results"))
    rows = kept.join(live, "conv_id", "left").select("conv_id", "idx", F.lit(0).alias("place"), "role", "text", results.alias("results"))
    told = summaries(marked.where("_drop")).join(marked.where("idx = _f").select("conv_id", "idx"), "conv_id").where("summary != ''")
    return rows.unionByName(told.select("conv_id", "idx", F.lit(1).alias("place"), F.lit("user").alias("role"), F.col("summary").alias("text"), none.alias("results")))


def capped(messages: DataFrame, most: int = HARD_CAP) -> DataFrame:
    """(conv_id, bytes, blocked): conversations whose texts take more than `most` bytes are not to be sent."""
    sized = messages.groupBy("conv_id").agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long").alias("bytes"))
    return sized.withColumn("blocked", F.col("bytes") > most)


def merge_recall(system: Column, recall: Column, marker: str, separator: str = "\n\n") -> Column:
    """A system prompt with recalled lines: behind one that holds `marker`, before any other, alone where there is none."""
    gap = F.when(F.endswith(system, F.lit(separator)) | (system == ""), "").otherwise(separator)
    return F.when(system.isNull(), recall).when(F.contains(system, F.lit(marker)), F.concat(system, gap, recall)).otherwise(F.concat(recall, system))


def merge_recall_blocks(blocks: Column, recall: Column, marker: str) -> Column:
    """merge_recall() for a system prompt that is an array of texts: the recalled lines are a block of their own."""
    known = F.exists(blocks, lambda b: F.contains(b, F.lit(marker)))
    return F.when(blocks.isNull(), F.array(recall)).when(known, F.array_append(blocks, recall)).otherwise(F.array_prepend(blocks, recall))


def long_ttl_first(blocks: DataFrame, prefix: str | None = None) -> DataFrame:
    """`blocks` (request, idx, ttl, text) with place: `1h` blocks first, but only where one follows a shorter-lived one.

    Blocks without ttl are none of either. The order stays otherwise; the block whose text is `prefix` leads.
    """
    whole = Window.partitionBy("request")
    short = F.min(F.when((F.col("ttl") != "1h"), F.col("idx"))).over(whole)
    late = F.max(F.when(F.col("ttl") == "1h", F.col("idx"))).over(whole)
    turned = F.coalesce(late > short, F.lit(False)) & ~F.col("ttl").eqNullSafe("1h")
    pinned = F.col("text").eqNullSafe(F.lit(prefix)) if prefix is not None else F.lit(False)
    led = blocks.withColumns({"_t": turned, "_p": pinned})
    first = F.row_number().over(Window.partitionBy("request", "_p").orderBy("_t", "idx"))
    led = led.withColumn("_p", F.col("_p") & (first == 1))
    return led.withColumn("place", F.row_number().over(whole.orderBy(F.desc("_p"), "_t", "idx"))).drop("_t", "_p")


def cache_points(tools: DataFrame, messages: DataFrame, least: int = 500, first: int = 5) -> DataFrame:
    """(request, tool_idx, message_idx): where prompt caching is marked.

    The last tool (request, idx, deferred) that isn't deferred, and the first user message of `least` bytes or more among
    the first `first` messages (request, idx, role, text).
    """
    tool = tools.where(~F.coalesce("deferred", F.lit(False))).groupBy("request").agg(F.max("idx").alias("tool_idx"))
    near = messages.withColumn("_n", F.row_number().over(Window.partitionBy("request").orderBy("idx"))).where(F.col("_n") <= first)
    message = near.where((F.col("role") == "user") & (F.octet_length("text") >= least)).groupBy("request").agg(F.min("idx").alias("message_idx"))
    return tool.join(message, "request", "full")


def orphan_calls(messages: DataFrame, same_message: bool = False) -> DataFrame:
    """(conv_id, idx, call_id): calls without a result in the next message (or in the same one).

    `messages` has conv_id, idx, calls array<string>, results array<string>.
    """
    if same_message:
        results = F.col("results")
    else:
        results = F.coalesce(F.lead("results").over(Window.partitionBy("conv_id").orderBy("idx")), F.array().cast("array<string>"))
    return messages.withColumn("_r", results).select("conv_id", "idx", F.explode(F.array_except("calls", "_r")).alias("call_id"))


def repaired(messages: DataFrame) -> DataFrame:
    """`messages` without orphan calls and without results that follow no call."""
    order = Window.partitionBy("conv_id").orderBy("idx")
    none = F.array().cast("array<string>")
    around = messages.withColumns({"_next": F.coalesce(F.lead("results").over(order), none), "_prev": F.coalesce(F.lag("calls").over(order), none)})
    return around.withColumns({"calls": F.array_intersect("calls", "_next"), "results": F.array_intersect("results", "_prev")}).drop("_next", "_prev")


def conversation_list(messages: DataFrame) -> DataFrame:
    """(conv_id, first_turn, last_turn, n_turns, title): the title is the start of the first user text, if any."""
    user = F.when(F.col("role") == "user", F.struct("turn", "text"))
    got = messages.groupBy("conv_id").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count("*").alias("n_turns"), F.min(user).alias("u"))
    return got.select("conv_id", "first_turn", "last_turn", "n_turns", F.substring("u.text", 1, 80).alias("title"))


def text_blocks(content: Column) -> Column:
    """The text of a message body that is a JSON string or a JSON array of blocks: its text blocks, joined by lines."""
    blocks = F.from_json(content, "array<struct<type:string,text:string>>")
    texts = F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"])
    return F.when(content.rlike(r"^\s*\["), F.array_join(texts, "\n")).otherwise(F.coalesce(F.get_json_object(F.concat(F.lit('{"v":'), content, F.lit("}")), "$.v"), content))


def query_class(text: Column) -> Column:
    """code, reasoning, factual, generation or general, by the first list with a word of the text."""
    out = F.lit("general")
    for name, words in reversed(QUERY_CLASSES):
        out = F.when(F.lower(text).rlike(rf"(?<![a-z0-9_])(?:{words})(?![a-z0-9_])"), name).otherwise(out)
    return out


def model_tier(kind: Column, tokens: Column, priority: Column) -> Column:
    """large, middle, small or light: the model tier by context length, priority and class of query."""
    by_class = F.when(kind.isin("code", "generation"), "large").when(kind == "reasoning", F.when(tokens > 50_000, "large").otherwise("middle")).when(kind == "factual", "light").otherwise("small")
    return F.when(tokens > 100_000, "large").when(priority.isin("cost", "speed"), "light").otherwise(by_class)


def tool_counts(turns: DataFrame) -> DataFrame:
    """(server, n): tools by server (the part before `__`, else `_builtin`) of the newest of the last five turns with a body.

    `turns` has id, created_at and request_body, a JSON object with `tools`.
    """
    last = turns.orderBy(F.desc("created_at"), F.desc("id")).limit(5).where("request_body IS NOT NULL").orderBy(F.desc("created_at"), F.desc("id")).limit(1)
    tools = last.select(F.explode(F.from_json(F.get_json_object("request_body", "$.tools"), "array<struct<name:string>>")).alias("t"))
    server = F.when(F.contains("t.name", F.lit("__")), F.substring_index("t.name", "__", 1)).otherwise("_builtin")
    return tools.groupBy(server.alias("server")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "server")


def page(rows: DataFrame, order: str, key: str, size: int, after: tuple | None = None, descending: bool = True) -> DataFrame:
    """One keyset page: `size` + 1 rows (the last tells that there is more) behind the row (order, key) = `after`."""
    o, k = F.col(order), F.col(key)
    if after is not None:
        beyond = (o < after[0]) if descending else (o > after[0])
        rows = rows.where(beyond | ((o == after[0]) & ((k < after[1]) if descending else (k > after[1]))))
    return rows.orderBy(*((o.desc(), k.desc()) if descending else (o, k))).limit(size + 1)


def share_levels(messages: DataFrame, target: str) -> DataFrame:
    """(id, level): messages (id, parent) of the levels from the roots down to that of `target`; none if no root reaches it.

    Levels come by pointer doubling, so a thread of n messages in a row takes about log n joins. Where ids repeat the
    target can stand on several levels: then all are walked one by one and the last one counts; a loop below a root is an
    error.
    """
    rows = cut(messages.select("id", "parent"))
    if rows.where("id IS NOT NULL").groupBy("id").count().where("count > 1").isEmpty():
        found = levels(rows)
        last = found.where(F.col("id") == target).select("level").first()
        return found.where(F.col("level") <= (last[0] if last else -1))
    return _walked_levels(rows, target)


def _walked_levels(rows: DataFrame, target: str) -> DataFrame:
    """share_levels() where ids repeat: one join a level, each cut."""
    most = rows.count()
    now, held, depth, last = cut(rows.where("parent IS NULL").select("id", F.lit(0).alias("level"))), [], 0, None
    while True:
        n, hit = now.agg(F.count("*"), F.max(F.col("id") == F.lit(target))).first()
        held.append(now)
        last = depth if hit else last
        if not n:
            break
        if depth > most:
            raise ValueError("messages form a loop below a root")
        if len(held) == ROUNDS:
            held = [cut(reduce(DataFrame.unionAll, held).coalesce(max(n.rdd.getNumPartitions() for n in held)))]
        depth += 1
        above = now.select(F.col("id").alias("parent"))
        now = cut(rows.join(above, "parent").select("id", F.lit(depth).alias("level")))
    found = reduce(DataFrame.unionAll, held)
    return found.where(F.col("level") <= F.lit(last).cast("int"))


def delete_after(messages: DataFrame, pivot: DataFrame) -> DataFrame:
    """`messages` without those of a conversation created after its pivot (conv_id, created_at)."""
    joined = messages.join(pivot.select("conv_id", F.col("created_at").alias("_at")), "conv_id", "left")
    return joined.where(F.col("_at").isNull() | (F.col("created_at") <= F.col("_at"))).drop("_at")


def pseudonyms(rows: DataFrame, column: str, salt: str) -> DataFrame:
    """`rows` with `column` replaced by a salted digest."""
    return rows.withColumn(column, F.sha2(F.concat(F.lit(salt), F.col(column).cast("string")), 256))
