"""Stable tokens for entities, masking and restoring, per session and without a sequential loop.

A token map is a relation (session, original, kind, token, first_turn). Numbers follow from the first place of each
original in its session, so the masking of turn t may use exactly the rows with first_turn <= t.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from velum.operators.detect import TECH_TERMS, entities, outside_code, term_spans
from velum.operators.lexicon import Lexicon, with_names

TOKEN = r"\[[A-Z]+_[0-9]+\]"
POISONED = r"\[[A-Z]+_[0-9]+\]?"
ENVELOPE_VERSION = 1
MOST_ENTITIES = 100


def token_map(found: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(session, original, kind, token, first_turn) from detections (session, turn, ord, text, kind).

    Originals are told apart without regard to case; the kind and spelling are those of the first place. `known` is an
    earlier map of the same shape: its originals keep their tokens, new ones are numbered behind its largest number.
    Grouping combines before the shuffle, so a session or an entity with very many places stays small.
    """
    first = found.groupBy("session", F.lower("text").alias("key")).agg(F.min(F.struct("turn", "ord", "text", "kind")).alias("f"))
    rows = first.select("session", "key", "f.text", "f.kind", "f.turn", "f.ord")
    if known is not None:
        rows = rows.join(known.select("session", F.lower("original").alias("key")).distinct(), ["session", "key"], "left_anti")
    order = Window.partitionBy("session", "kind").orderBy("turn", "ord", "key")
    rows = rows.withColumn("n", F.row_number().over(order))
    if known is not None:
        top = known.groupBy("session", "kind").agg(F.max(F.regexp_extract("token", r"_([0-9]+)\]$", 1).cast("int")).alias("top"))
        rows = rows.join(top, ["session", "kind"], "left").withColumn("n", F.col("n") + F.coalesce("top", F.lit(0)))
    fresh = rows.select("session", F.col("text").alias("original"), "kind", F.concat(F.lit("["), "kind", F.lit("_"), F.col("n").cast("string"), F.lit("]")).alias("token"), F.col("turn").alias("first_turn"))
    return fresh if known is None else known.select("session", "original", "kind", "token", "first_turn").unionByName(fresh)


def entries(tokens: DataFrame) -> DataFrame:
    """(session, entries array<struct<original, token, first_turn>>): longest originals first, then by first turn."""
    e = F.struct((-F.char_length("original")).alias("size"), "first_turn", "token", "original")
    return tokens.groupBy("session").agg(F.transform(F.array_sort(F.collect_list(e)), lambda x: F.struct(x["original"].alias("original"), x["token"].alias("token"), x["first_turn"].alias("first_turn"))).alias("entries"))


def _quoted(text: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def present(lowered: Column, held: Column) -> Column:
    """Entries whose original the lower-cased text holds; cheap, and made before any pattern is built."""
    return F.filter(held, lambda e: F.contains(lowered, F.lower(e["original"])))


def mask(text: Column, held: Column) -> Column:
    """`text` with each original replaced by its token, whatever its case, where it stands as a word of its own.

    Longest originals go first. An original isn't touched behind a letter, digit or one of _ @ /, nor before a word
    character. `held` should be present() entries only.
    """
    return F.aggregate(held, text, lambda acc, e: F.regexp_replace(acc, F.concat(F.lit(r"(?i)(?<![A-Za-z0-9_@/])"), _quoted(e["original"]), F.lit(r"(?!\w)")), e["token"]))


_ENTRIES = "array<struct<original:string,token:string,first_turn:bigint>>"
#: A word of a lower-cased text; what an original begins with is one of the words of any text that holds it.
_WORD = "([a-z0-9_]+)"


def with_entries(turns: DataFrame, tokens: DataFrame, text: str = "text", out: str = "_e") -> DataFrame:
    """`turns` (session, text, ...) with the entries of their session whose original the text holds, case aside.

    Originals are looked up by their first word, so no row meets the whole map of its session. Equal texts of a session
    are looked up once; originals without an ASCII word are tried on every text of their session.
    """
    marked = turns.withColumn("_at", F.struct("session", F.xxhash64(text).alias("h")))
    words = F.array_union(F.array(F.lit("")), F.regexp_extract_all(F.lower(text), F.lit(_WORD), 1))
    asked = marked.where(F.col(text).isNotNull()).select("session", "_at", F.explode(words).alias("word")).distinct()
    keyed = tokens.select("session", F.regexp_extract(F.lower("original"), _WORD, 1).alias("word"), "original", "token", "first_turn")
    hits = asked.join(keyed, ["session", "word"]).select(F.col("_at").alias("session"), "original", "token", "first_turn")
    joined = marked.join(entries(hits).select(F.col("session").alias("_at"), F.col("entries").alias(out)), "_at", "left").drop("_at")
    low = joined.withColumn("_low", F.lower(text)).withColumn(out, F.coalesce(out, F.array().cast(_ENTRIES)))
    return low.withColumn(out, present(F.col("_low"), F.col(out))).drop("_low")


def mask_turns(turns: DataFrame, tokens: DataFrame, text: str = "text") -> DataFrame:
    """`turns` (session, turn, text, ...) with `masked`: only tokens known by their turn are used."""
    joined = with_entries(turns, tokens, text)
    joined = joined.withColumn("_e", F.filter("_e", lambda e: e["first_turn"] <= F.col("turn")))
    return joined.withColumn("masked", mask(F.col(text), F.col("_e"))).drop("_e")


def mask_found(turns: DataFrame, found: DataFrame, tokens: DataFrame, text: str = "text", code: bool = False) -> DataFrame:
    """`turns` with `masked`: mask_turns() for sessions of any size, from detections `found` (session, turn, text).

    Each row gets the entries of what was found in its turn, joined by session and original, so no row carries the map
    of its session. An original that stands in a text without being found there stays. With `code`, code regions stay.
    """
    hits = found.select("session", "turn", F.lower("text").alias("key")).distinct()
    known = tokens.select("session", F.lower("original").alias("key"), "original", "token", "first_turn")
    held = hits.join(known, ["session", "key"]).where("first_turn <= turn").select(F.struct("session", "turn").alias("session"), "original", "token", "first_turn")
    joined = turns.withColumn("_at", F.struct("session", "turn")).join(entries(held).withColumnRenamed("session", "_at"), "_at", "left")
    joined = joined.withColumn("_e", F.coalesce("entries", F.array().cast(_ENTRIES)))
    masked = mask_outside_code(F.col(text), F.col("_e")) if code else mask(F.col(text), F.col("_e"))
    return joined.withColumn("masked", masked).drop("_at", "entries", "_e")


def mask_outside_code(text: Column, held: Column) -> Column:
    """mask() on what lies outside of code. Most texts hold none; only those with a fence or back quote are cut up."""
    return F.when(text.rlike("[`~]"), outside_code(text, lambda p: mask(p, held))).otherwise(mask(text, held))


def restore(text: Column, held: Column) -> Column:
    """Tokens replaced by their originals, longest tokens first; poisoned originals and unknown tokens stay."""
    clean = F.filter(held, lambda e: ~e["original"].rlike(POISONED) & F.contains(text, e["token"]))
    ordered = F.array_sort(F.transform(clean, lambda e: F.struct((-F.char_length(e["token"])).alias("n"), e["token"].alias("token"), e["original"].alias("original"))))
    return F.aggregate(ordered, text, lambda acc, e: F.replace(acc, e["token"], e["original"]))


def restore_turns(turns: DataFrame, tokens: DataFrame, text: str = "masked") -> DataFrame:
    """`turns` with `restored`: the tokens in a text are joined to the map one by one, so a large map costs nothing more."""
    marked = turns.withColumn("_at", F.struct("session", F.xxhash64(text).alias("h")))
    stand = marked.select("session", "_at", F.explode_outer(F.regexp_extract_all(F.col(text), F.lit(f"({TOKEN})"), 1)).alias("token")).where("token IS NOT NULL").distinct()
    hits = stand.join(tokens.select("session", "token", "original", "first_turn"), ["session", "token"]).select(F.col("_at").alias("session"), "original", "token", "first_turn")
    joined = marked.join(entries(hits).withColumnRenamed("session", "_at"), "_at", "left")
    held = F.coalesce("entries", F.array().cast(_ENTRIES))
    return joined.withColumn("restored", restore(F.col(text), held)).drop("_at", "entries")


def find_entities(rows: DataFrame, id_cols: list[str], text: str = "text", lexicon: Lexicon | None = None, **options) -> DataFrame:
    """(*id_cols, ord, start, text, kind): classes, names by `lexicon` and CamelCase of each row, as in anonymize()."""
    lexicon = lexicon or Lexicon()
    terms = lexicon.terms | frozenset(options.get("terms", TECH_TERMS))
    named = with_names(rows.select(*id_cols, F.col(text).alias("_t")), replace(lexicon, terms=terms), "_t", "_names")
    found = entities(named, "_t", names=F.col("_names"), **options)
    placed = found.select(*id_cols, F.posexplode_outer("entities").alias("ord", "e")).where("ord IS NOT NULL")
    return placed.select(*id_cols, "ord", "e.start", "e.text", "e.kind")


def anonymize(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lexicon: Lexicon | None = None, custom: str | Column | None = None, **options) -> DataFrame:
    """(id, masked, entities, n_entities): every document its own session; one Arrow pass and one projection, no shuffle.

    Classes, names by `lexicon`, custom spans, CamelCase; code (fences, inline back quotes) stays as it is.
    `custom` names a column of terms (array<struct<text, kind>>), such as those of fact_terms(), or
    is a column of spans. `options` go to velum.operators.detect.entities().
    """
    lexicon = lexicon or Lexicon()
    terms = lexicon.terms | frozenset(options.get("terms", TECH_TERMS))
    held = [F.col(custom).alias("_terms")] if isinstance(custom, str) else []
    named = with_names(docs.select(id_col, F.col(text).alias("_t"), *held), replace(lexicon, terms=terms), "_t", "_names")
    if custom is not None:
        options["custom"] = term_spans(F.col("_t"), F.col("_terms")) if isinstance(custom, str) else custom
    found = entities(named, "_t", names=F.col("_names"), **options)
    numbered = F.transform("entities", lambda s, i: F.struct(
        s["text"].alias("original"),
        F.concat(F.lit("["), s["kind"], F.lit("_"), (F.size(F.filter(F.slice(F.col("entities"), F.lit(1), i), lambda t: t["kind"] == s["kind"])) + 1).cast("string"), F.lit("]")).alias("token"),
        s["kind"].alias("kind"),
    ))
    held = F.array_sort("tokens", lambda a, b: F.char_length(b["original"]) - F.char_length(a["original"]))
    made = found.withColumn("tokens", numbered).withColumn("_held", held)
    masked = mask_outside_code(F.col("_t"), F.col("_held"))
    return made.select(id_col, F.when(F.size("_held") > 0, masked).otherwise(F.col("_t")).alias("masked"), F.col("tokens").alias("entities"), F.size("tokens").alias("n_entities"))


def guard(turns: DataFrame, counted: str = "n_entities", most: int = MOST_ENTITIES, mode: str = "reject") -> DataFrame:
    """The breaker above `most` entities: `reject` drops such rows, `passthrough` flags them as unmasked."""
    if mode == "reject":
        return turns.where(F.col(counted) <= most)
    return turns.withColumn("unmasked", F.col(counted) > most)


def promotions(found: DataFrame, calls: int = 3, confidence: float = 0.6) -> DataFrame:
    """(content, category, confidence, n_calls): PROJECT, ORG and PLACE entities seen in at least `calls` calls.

    `found` has call, text, kind.
    """
    seen = found.where(F.col("kind").isin("PROJECT", "ORG", "PLACE")).groupBy(F.lower("text").alias("key")).agg(F.countDistinct("call").alias("n_calls"), F.min("text").alias("content"))
    return seen.where(F.col("n_calls") >= calls).select("content", F.lit("PROJECT").alias("category"), F.lit(confidence).alias("confidence"), "n_calls")


def leaks(masked: DataFrame, tokens: DataFrame, text: str = "masked") -> DataFrame:
    """Rows of `masked` (session, ...) in which an original of their session still stands as a word of its own."""
    held = with_entries(masked, tokens, text, "entries")
    alone = lambda e: F.regexp_like(F.col(text), F.concat(F.lit(r"(?i)(?<![A-Za-z0-9_@/])"), _quoted(e["original"]), F.lit(r"(?!\w)")))
    return held.where(F.exists("entries", lambda e: (e["first_turn"] <= F.col("turn")) & F.contains(F.lower(F.col(text)), F.lower(e["original"])) & alone(e))).drop("entries")


def export_sessions(tokens: DataFrame) -> DataFrame:
    """(session, envelope): the token map of each session as JSON {version, tokenMap: {forward, reverse}}."""
    pairs = tokens.groupBy("session").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("original", "token")))).alias("forward"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("token", "original")))).alias("reverse"))
    return pairs.select("session", F.to_json(F.struct(F.lit(ENVELOPE_VERSION).alias("version"), F.struct("forward", "reverse").alias("tokenMap"))).alias("envelope"))


def import_sessions(envelopes: DataFrame) -> DataFrame:
    """The token map (session, original, kind, token, first_turn) of envelopes; a newer version raises an error."""
    shape = "version int, tokenMap struct<forward:map<string,string>,reverse:map<string,string>>"
    read = envelopes.select("session", F.from_json("envelope", shape).alias("e"))
    checked = read.select("session", F.when(F.col("e.version") > ENVELOPE_VERSION, F.raise_error(F.lit("session envelope of a newer version"))).otherwise(F.col("e.tokenMap.reverse")).alias("m"))
    rows = checked.select("session", F.explode("m").alias("token", "original"))
    return rows.select("session", "original", F.regexp_extract("token", r"^\[([A-Z]+)_", 1).alias("kind"), "token", F.lit(0).cast("long").alias("first_turn"))


def occurrences(turns: DataFrame, tokens: DataFrame, text: str = "masked") -> DataFrame:
    """(session, token, n): how often each token of a session stands in its turns."""
    found = turns.select("session", F.explode_outer(F.regexp_extract_all(F.col(text), F.lit(f"({TOKEN})"), 1)).alias("token")).where("token IS NOT NULL")
    counted = found.groupBy("session", "token").agg(F.count("*").alias("n"))
    return tokens.select("session", "token").join(counted, ["session", "token"])
