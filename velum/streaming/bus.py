"""A bounded event bus: each subscription holds its newest events until its subscriber asks; older ones are lost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed value: events that a subscription holds.
HELD = 256
#: Any kind of event.
ANY = "*"
#: Sequence numbers of a slice of a subscription; slices are ordered in tasks of their own.
SLICE = 1 << 16


def subscribed(events: DataFrame, subscriptions: DataFrame, polls: DataFrame) -> DataFrame:
    """(subscriber, kind, seq, poll): events (seq, kind) and polls (subscriber, seq) dealt to subscriptions (subscriber, kind).

    A subscription is to one kind or to ANY. Sequence numbers may have gaps; a poll sees what is numbered up to it.
    """
    both = events.select("seq", F.explode(F.array("kind", F.lit(ANY))).alias("kind"))
    sent = both.join(subscriptions, "kind").select("subscriber", "kind", "seq", F.lit(False).alias("poll"))
    asked = polls.join(subscriptions, "subscriber").select("subscriber", "kind", "seq", F.lit(True).alias("poll"))
    return sent.unionAll(asked)


def deliveries(rows: DataFrame, most: int = HELD) -> DataFrame:
    """(subscriber, kind, seq, delivered, lost, first, last): what each poll of subscribed() rows gets and what was lost.

    Of the events since the poll before, the newest `most` are delivered, from number `first` to `last`. Events go to
    the next poll of their slice, or to the first one of a later slice, so a subscription to very many events is
    sorted in many tasks; what is left of a poll is then counted, and its newest `most` are chosen, before shuffles.
    """
    keys = ["subscriber", "kind"]
    sliced = rows.withColumn("slice", F.floor(F.col("seq") / SLICE))
    first = sliced.groupBy(*keys, "slice").agg(F.min(F.when(F.col("poll"), F.col("seq"))).alias("f"))
    # Both look ahead along a falling order, as frames that grow cost one step a row.
    behind = Window.partitionBy(*keys).orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    later = first.select(*keys, "slice", F.min("f").over(behind).alias("later"))
    ahead = Window.partitionBy(*keys, "slice").orderBy(F.desc("seq"), F.desc("poll")).rowsBetween(Window.unboundedPreceding, 0)
    near = sliced.withColumn("next", F.min(F.when(F.col("poll"), F.col("seq"))).over(ahead))
    sent = near.where("NOT poll").join(later, [*keys, "slice"]).select(*keys, "seq", F.coalesce("next", "later").alias("at")).where("at IS NOT NULL")
    counted = sent.groupBy(*keys, "at").agg(F.count("*").alias("n"), F.max("seq").alias("last"))
    newest = Window.partitionBy(*keys, "at").orderBy(F.desc("seq"))
    least = sent.withColumn("r", F.row_number().over(newest)).where(F.col("r") <= most).groupBy(*keys, "at").agg(F.min("seq").alias("first"))
    polls = rows.where("poll").select(*keys, F.col("seq").alias("at")).distinct()
    out = polls.join(counted, [*keys, "at"], "left").join(least, [*keys, "at"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select(*keys, F.col("at").alias("seq"), F.least("n", F.lit(most)).cast("long").alias("delivered"), F.greatest(F.col("n") - most, F.lit(0)).cast("long").alias("lost"), "first", "last")
