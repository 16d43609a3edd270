"""Full-text search: stems without stop words, positional postings, and rank by cover density."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from velum.operators.stems import STOP, stem

#: Words whose stems a worker remembers.
REMEMBERED = 200_000
#: Stems of all queries up to which only their postings are made.
MOST_ASKED = 2_000
#: What an occurrence weighs.
WEIGHT = 0.1

_word = re.compile("[a-z0-9]+")
_stems: dict[str, str | None] = {}


def lexemes(text: str) -> dict[str, list[int]]:
    """Places (words counted from 1, stop words too) of each stem of a text; stop words have none."""
    out: dict[str, list[int]] = {}
    if len(_stems) > REMEMBERED:
        _stems.clear()
    for at, word in enumerate(_word.findall(text.lower()), 1):
        if word not in _stems:
            _stems[word] = None if word in STOP else stem(word)
        if (found := _stems[word]) is not None:
            out.setdefault(found, []).append(at)
    return out


def postings(docs: DataFrame, only: list[str] | None = None, id_col: str = "id", text: str = "content") -> DataFrame:
    """(id, lexeme, places array<int>) of each stem of each whole text, or of those in `only`: the rows of an index.

    Null texts have none. Map only.
    """
    wanted = None if only is None else docs.sparkSession.sparkContext.broadcast(frozenset(only))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = None if wanted is None else wanted.value
        for batch in batches:
            found = [(i, x, places) for i, t in enumerate(batch.column(1).to_pylist()) for x, places in lexemes(t or "").items() if keep is None or x in keep]
            at = pa.array([f[0] for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.list_(pa.int32()))], names=[id_col, "lexeme", "places"])

    return docs.select(id_col, F.col(text).cast("string")).mapInArrow(work, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, lexeme string, places array<int>")


def numbered_places(found: str) -> Column:
    """(at, t, i) of all places in `found` (array<array<int>>, one of each stem), in order."""
    places = F.array_sort(F.flatten(F.transform(found, lambda p, t: F.transform(p, lambda x: F.struct(x.alias("at"), t.alias("t"))))))
    return F.transform(places, lambda e, i: F.struct(e["at"].alias("at"), e["t"].alias("t"), i.alias("i")))


def density(places: str, need: str) -> Column:
    """Cover density of numbered_places() in the column `places`, of `need` stems.

    A cover is a shortest run of words that holds all stems: for each place where one can begin, the first end. It counts
    WEIGHT, divided by one more than the words in it that are none of the stems.
    """
    start = F.struct(F.array_repeat(F.lit(-1), F.col(need).cast("int")).alias("last"), F.lit(-1).alias("begun"), F.lit(0.0).alias("score"))

    def step(acc: Column, e: Column) -> Column:
        last = F.transform(acc["last"], lambda x, j: F.when(j == e["t"], e["i"]).otherwise(x))
        least = F.array_min(last)
        noise = (e["at"] - F.get(F.col(places), least)["at"]) - (e["i"] - least)
        fresh = least > acc["begun"]
        return F.struct(last.alias("last"), F.greatest(least, acc["begun"]).alias("begun"), (acc["score"] + F.when(fresh, WEIGHT / (1 + noise)).otherwise(0.0)).alias("score"))

    return F.aggregate(places, start, step, lambda acc: acc["score"])


def ranked(asked: DataFrame, index: DataFrame, limit: int, id_col: str = "id") -> DataFrame:
    """(query_id, id, score, rank) of `index` (postings) for `asked` (query_id, lexeme): rows with all stems of a query."""
    need = asked.groupBy("query_id").agg(F.count("*").alias("need"))
    hits = index.join(asked, "lexeme").groupBy("query_id", id_col).agg(F.count("*").alias("held"), F.array_sort(F.collect_list(F.struct("lexeme", "places"))).alias("_found"))
    whole = hits.join(need, "query_id").where("held = need").withColumn("_found", F.transform("_found", lambda x: x["places"]))
    scored = whole.withColumn("_places", numbered_places("_found")).withColumn("score", density("_places", "need"))
    out = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), id_col)))
    return out.where(F.col("rank") <= limit).select("query_id", id_col, "score", "rank")


def search(queries: DataFrame, docs: DataFrame, limit: int) -> DataFrame:
    """(query_id, id, score, rank): docs (id, content) that hold every stem of a query (query_id, query), by cover density.

    Stop words don't count; a query of nothing else finds nothing. Equal scores come by id. A query's stems are distinct;
    only postings of asked stems are made, unless more than MOST_ASKED are asked.
    """
    asked = postings(queries.select("query_id", "query"), None, "query_id", "query").select("query_id", "lexeme")
    few = [r.lexeme for r in asked.select("lexeme").distinct().limit(MOST_ASKED + 1).collect()]
    return ranked(asked, postings(docs, few if len(few) <= MOST_ASKED else None), limit)
