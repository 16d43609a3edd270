"""Token prices, spending, balances, permissions and tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DEFAULT_RATE, CANCEL_RATE = 6.0, 1.15


def priced(calls: DataFrame, prices: DataFrame, premium: DataFrame | None = None, cache: DataFrame | None = None) -> DataFrame:
    """`calls` (call_id, model, input_tokens, ...) with prompt_rate, completion_rate, write_rate and read_rate.

    `prices` (key, prompt, completion): the longest key that the model name contains, the smaller of equally long ones,
    else the default rate. `premium` (key, threshold, prompt, completion) holds beyond a number of input tokens, `cache`
    (key, write, read) for cached tokens, else the prompt rate. Models are matched to keys once a model, not once a call.
    """
    models = calls.select("model").distinct()
    hits = models.join(prices.select("key"), F.contains("model", F.col("key")))
    best = hits.withColumn("_r", F.row_number().over(Window.partitionBy("model").orderBy(F.desc(F.char_length("key")), "key"))).where("_r = 1").drop("_r")
    rates = best.join(prices.select("key", F.col("prompt").alias("_p"), F.col("completion").alias("_c")), "key")
    blank = {"_t": "double", "_pp": "double", "_pc": "double", "_w": "double", "_rd": "double"}
    if premium is not None:
        rates = rates.join(premium.select("key", F.col("threshold").cast("double").alias("_t"), F.col("prompt").alias("_pp"), F.col("completion").alias("_pc")), "key", "left")
    if cache is not None:
        rates = rates.join(cache.select("key", F.col("write").alias("_w"), F.col("read").alias("_rd")), "key", "left")
    for name, kind in blank.items():
        if name not in rates.columns:
            rates = rates.withColumn(name, F.lit(None).cast(kind))
    joined = calls.join(rates.drop("key"), "model", "left")
    above = F.coalesce(F.col("input_tokens") > F.col("_t"), F.lit(False))
    out = joined.withColumns({"prompt_rate": F.coalesce(F.when(above, F.col("_pp")), "_p", F.lit(DEFAULT_RATE)), "completion_rate": F.coalesce(F.when(above, F.col("_pc")), "_c", F.lit(DEFAULT_RATE))})
    return out.withColumns({"write_rate": F.coalesce("_w", "prompt_rate"), "read_rate": F.coalesce("_rd", "prompt_rate")}).drop("_p", "_c", *blank)


def spent(calls: DataFrame) -> DataFrame:
    """Ledger rows (call_id, user, token_type, amount, rate, token_value): up to two a call (priced(), plus user,
    input_tokens, write_tokens, read_tokens, output_tokens and context). Amounts and values are negative; rows without
    tokens are left out; an incomplete completion costs 1.15 times as much, rounded up towards zero."""
    tokens = lambda c: F.abs(F.coalesce(F.col(c), F.lit(0)))
    total = tokens("input_tokens") + tokens("write_tokens") + tokens("read_tokens")
    cost = tokens("input_tokens") * F.col("prompt_rate") + tokens("write_tokens") * F.col("write_rate") + tokens("read_tokens") * F.col("read_rate")
    out_value = tokens("output_tokens") * F.col("completion_rate")
    cut = F.coalesce(F.col("context") == "incomplete", F.lit(False))
    row = lambda kind, amount, rate, value: F.struct(F.lit(kind).alias("token_type"), (-amount).cast("long").alias("amount"), rate.cast("double").alias("rate"), (-value).cast("double").alias("token_value"))
    prompt = row("prompt", total, F.when(total > 0, cost / F.greatest(total, F.lit(1))).otherwise(F.col("prompt_rate")), cost)
    completion = row("completion", tokens("output_tokens"), F.when(cut, F.col("completion_rate") * CANCEL_RATE).otherwise(F.col("completion_rate")), F.when(cut, -F.ceil(-out_value * CANCEL_RATE)).otherwise(out_value))
    return calls.select("call_id", "user", F.explode(F.array(prompt, completion)).alias("r")).select("call_id", "user", "r.*").where("amount != 0")


def balances(changes: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """(user, balance) after changes (user, seq, delta) in order, where a balance never falls below zero.

    The clamp makes it a fold, but one of maps x -> max(low, x + sum), which combine: over all changes the balance is the
    larger of start + total and the largest sum of a tail. Both come from window sums, nothing is collected into a row.
    """
    tail = F.sum("delta").over(Window.partitionBy("user").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0))
    sums = changes.withColumn("_t", tail).groupBy("user").agg(F.sum("delta").alias("_all"), F.max("_t").alias("_tail"))
    opened = sums if start is None else sums.join(start.select("user", F.col("balance").alias("_b")), "user", "full")
    first = F.coalesce(F.col("_b"), F.lit(0.0)) if start is not None else F.lit(0.0)
    return opened.select("user", F.greatest(first + F.coalesce("_all", F.lit(0.0)), F.coalesce("_tail", F.lit(0.0)), F.lit(0.0)).alias("balance"))


def refills(accounts: DataFrame, now: Column) -> DataFrame:
    """`accounts` (balance, minimum, refill_amount, refill_days, last_refill) with refilled: low ones whose interval is over."""
    due = (F.col("balance") < F.col("minimum")) & (F.coalesce(F.col("last_refill"), F.lit(0).cast("timestamp")) + F.make_interval(days=F.col("refill_days")) <= now)
    return accounts.withColumn("refilled", due).withColumns({"balance": F.when(due, F.col("balance") + F.col("refill_amount")).otherwise(F.col("balance")), "last_refill": F.when(due, now).otherwise(F.col("last_refill"))})


def permissions(entries: DataFrame, members: DataFrame) -> DataFrame:
    """(user, resource, bits): the union of the bits that the principals of each user hold on a resource.

    `entries` has principal, resource, bits; `members` user, principal. Entries of a principal on one resource are one
    before they meet its members, and repeated members are one, so the join makes a row a user, principal and resource.
    """
    held = entries.groupBy("principal", "resource").agg(F.bit_or("bits").alias("bits"))
    return members.select("user", "principal").distinct().join(held, "principal").groupBy("user", "resource").agg(F.bit_or("bits").alias("bits"))


def reachable(entries: DataFrame, members: DataFrame, bit: int) -> DataFrame:
    """(user, resource): resources on which a user holds `bit`."""
    return permissions(entries, members).where(F.col("bits").bitwiseAND(bit) == bit).select("user", "resource")


def owned_by_nobody(resources: DataFrame, entries: DataFrame) -> DataFrame:
    """Resources without any entry."""
    return resources.join(entries.select("resource").distinct(), "resource", "left_anti")


def tag_changes(before_after: DataFrame) -> DataFrame:
    """(tag, change): by how much the number of conversations with a tag changes; rows have before and after arrays."""
    none = F.array().cast("array<string>")
    signed = lambda a, b, n: F.transform(F.array_except(F.coalesce(a, none), F.coalesce(b, none)), lambda t: F.struct(t.alias("tag"), F.lit(n).alias("n")))
    rows = before_after.select(F.explode(F.concat(signed("after", "before", 1), signed("before", "after", -1))).alias("x"))
    return rows.groupBy("x.tag").agg(F.sum("x.n").alias("change"))


def moved_positions(tags: DataFrame, old: int, new: int) -> DataFrame:
    """`tags` (position, ...) after the tag at `old` moves to `new` and those between shift by one."""
    p = F.col("position")
    between = ((p > old) & (p <= new)) if old < new else ((p >= new) & (p < old))
    shift = F.when(p == old, new).when(between, p - 1 if old < new else p + 1).otherwise(p)
    return tags.withColumn("position", shift)
