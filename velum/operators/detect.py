"""Detection of personal data, secrets and names of projects, as Catalyst expressions.

Every detector returns array<struct<start int, text string, kind string>> in the order of classes and places. Classes
are URL, EMAIL, bare domains (URL), HANDLE, PHONE, IP and SECRET; later classes skip places that earlier matches cover.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of the detected classes. EDGE is a word boundary over ASCII.
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
URL = r"""https?://[^\s,)>'"]+"""
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
DOMAIN = rf"(?<![.@A-Za-z0-9]){EDGE}[a-zA-Z0-9\-]{{3,}}\.(?:com|io|ai|dev|app|net|org|co){EDGE}"
HANDLE = r"(?<![A-Za-z0-9.])@[a-zA-Z][a-zA-Z0-9_]{2,}"
PHONE = rf"{EDGE}(?:\+?1[\-.\s]?)?\(?[0-9]{{3}}\)?[\-.\s]?[0-9]{{3}}[\-.\s]?[0-9]{{4}}{EDGE}"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
IPV4 = rf"{EDGE}(?:{OCTET}\.){{3}}{OCTET}{EDGE}"
SECRET = r"(?:[a-zA-Z0-9]{1,12}[_\-])[A-Za-z0-9+/]{20,}|[A-Za-z0-9]{32,}"
CAMEL = rf"{EDGE}[A-Z][a-z]{{2,}}[A-Z][a-zA-Z]+{EDGE}"
# Technical terms that are no entities; more can be given.
TECH_TERMS = ("JavaScript", "TypeScript", "PostgreSQL", "FileSystem", "FormData", "WebSocket", "DataFrame", "PySpark", "GraphQL", "AbortController", "TypeError", "ArrayBuffer")

#: What a text must hold for a pattern to match at all, a plain string or a pattern that is quick to look for.
NEEDS = {URL: "://", EMAIL: "@", DOMAIN: r"\.(?:com|io|ai|dev|app|net|org|co)", HANDLE: "@", PHONE: r"[0-9][0-9]{3}(?![A-Za-z_])", IPV4: r"[0-9]\.[0-9]", SECRET: r"[A-Za-z0-9+/]{20}", CAMEL: r"[a-z][A-Z]"}

#: Kinds of velum.operators.lexicon.
NAMES = ("PERSON", "PLACE", "ORG")
SPAN = "array<struct<start:int,text:string,kind:string>>"
_MARK, _HIT = "\x01", "\x02"


def spans(text: Column, pattern: str, kind: str) -> Column:
    """Matches of `pattern` with their places, code points from 0, found in the JVM.

    Matches are wrapped in control characters, the text is split at them, and places follow from the lengths. The two
    control characters count as spaces where the text has them itself.
    """
    clean = F.translate(F.coalesce(text, F.lit("")), _MARK + _HIT, "  ")
    pieces = F.split(F.regexp_replace(clean, pattern, f"{_MARK}{_HIT}$0{_MARK}"), _MARK)
    step = lambda acc, p: F.struct(
        (acc["at"] + F.char_length(p) - F.startswith(p, F.lit(_HIT)).cast("int")).alias("at"),
        F.when(F.startswith(p, F.lit(_HIT)), F.array_append(acc["out"], F.struct(acc["at"].alias("start"), F.substring(p, F.lit(2), F.char_length(p)).alias("text"), F.lit(kind).alias("kind")))).otherwise(acc["out"]).alias("out"),
    )
    found = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")), step, lambda acc: acc["out"])
    need = NEEDS.get(pattern)
    if need is None:
        return found
    likely = F.contains(text, F.lit(need)) if need in ("@", "://") else text.rlike(need)
    return F.when(likely, found).otherwise(F.array().cast(SPAN))


def _free(found: Column, taken: Column) -> Column:
    """Spans that don't start inside `taken`."""
    return F.filter(found, lambda s: ~F.exists(taken, lambda t: (s["start"] >= t["start"]) & (s["start"] < t["start"] + F.char_length(t["text"]))))


def first_of_each(df: DataFrame, found: str, out: str) -> DataFrame:
    """`df` with `out`: trimmed spans of column `found` with three bytes or more (names: two), the first of each text whatever its case.

    The steps are columns of their own, since what a lambda holds is evaluated again for each element.
    """
    df = df.withColumn("_big", F.filter(found, lambda s: F.octet_length(F.trim(s["text"])) >= F.when(s["kind"].isin(*NAMES), 2).otherwise(3)))
    df = df.withColumn("_keys", F.transform("_big", lambda s: F.lower(s["text"])))
    return df.withColumn(out, F.filter("_big", lambda s, i: F.array_position("_keys", F.lower(s["text"])) == i + 1)).drop("_big", "_keys")


def raw_spans(df: DataFrame, text: str = "text", terms: tuple[str, ...] = TECH_TERMS) -> DataFrame:
    """`df` with `found`: spans of all classes after the rule of places, repeats included.

    All matches cover their places, also repeated ones. Columns build on each other by name, so that no pattern is
    matched twice.
    """
    t = F.col(text)
    out = df.withColumns({"_url": spans(t, URL, "URL"), "_mail": spans(t, EMAIL, "EMAIL")})
    out = out.withColumn("_taken", F.concat("_url", "_mail")).withColumn("_domain", _free(spans(t, DOMAIN, "URL"), F.col("_taken")))
    out = out.withColumn("_taken", F.concat("_taken", "_domain")).withColumn("_handle", _free(spans(t, HANDLE, "HANDLE"), F.col("_taken")))
    out = out.withColumn("_phone", spans(t, PHONE, "PHONE")).withColumn("_taken", F.concat("_taken", "_handle", "_phone"))
    out = out.withColumn("_ip", _free(spans(t, IPV4, "IP"), F.col("_taken"))).withColumn("_taken", F.concat("_taken", "_ip"))
    secret = F.filter(_free(spans(t, SECRET, "SECRET"), F.col("_taken")), lambda s: s["text"].rlike("[0-9]") & s["text"].rlike("[A-Za-z]") & ~s["text"].isin(*terms))
    out = out.withColumn("found", F.concat("_url", "_mail", "_domain", "_handle", "_phone", "_ip", secret))
    return out.drop("_url", "_mail", "_domain", "_handle", "_phone", "_ip", "_taken")


def camel_case(text: Column, terms: tuple[str, ...] = TECH_TERMS) -> Column:
    """Compound CamelCase names as PROJECT, technical terms left out."""
    return F.filter(spans(text, CAMEL, "PROJECT"), lambda s: ~s["text"].isin(*terms))


def entities(df: DataFrame, text: str = "text", terms: tuple[str, ...] = TECH_TERMS, custom: Column | None = None, allowed: tuple[str, ...] = (), names: Column | None = None) -> DataFrame:
    """`df` with `entities`: classes, then `names` that are no `custom` texts, then `custom` spans, then CamelCase; each
    text once, `allowed` words dropped.
    """
    if names is not None and custom is not None:
        names = F.filter(names, lambda s: ~F.exists(custom, lambda c: F.lower(c["text"]) == F.lower(s["text"])))
    every = F.concat("found", *(x for x in (names, custom) if x is not None), "_camel")
    found = raw_spans(df, text, terms).withColumn("_camel", camel_case(F.col(text), terms)).withColumn("_every", every)
    out = first_of_each(found, "_every", "entities").drop("found", "_camel", "_every")
    drop = [a.lower() for a in allowed]
    return out.withColumn("entities", F.filter("entities", lambda s: ~F.lower(s["text"]).isin(*drop))) if drop else out


def term_spans(text: Column, terms: Column) -> Column:
    """First places, case aside, of the `terms` (array<struct<text string, kind string>>) that a text holds."""
    low = F.lower(F.coalesce(text, F.lit("")))
    held = F.filter(F.coalesce(terms, F.array().cast("array<struct<text:string,kind:string>>")), lambda t: F.contains(low, F.lower(t["text"])) & (t["text"] != ""))
    place = lambda t: F.call_function("locate", F.lower(t["text"]), low)
    return F.transform(held, lambda t: F.struct((place(t) - 1).alias("start"), F.substring(text, place(t), F.char_length(t["text"])).alias("text"), t["kind"].alias("kind")))


def detections(df: DataFrame, id_cols: list[str], text: str = "text", **options) -> DataFrame:
    """(*id_cols, ord, start, text, kind): one row per detected entity, `ord` counting from 0 in a document."""
    found = entities(df.select(*id_cols, F.col(text).alias("_body")), "_body", **options)
    # An outer explode: a plain one is guarded by a filter on the array, for which Spark would make the array twice.
    rows = found.select(*id_cols, F.posexplode_outer("entities").alias("ord", "e")).where("ord IS NOT NULL")
    return rows.select(*id_cols, "ord", "e.start", "e.text", "e.kind")


def fact_terms(facts: DataFrame, terms: tuple[str, ...] = TECH_TERMS, skip: tuple[str, ...] = ()) -> DataFrame:
    """(text, kind): custom entities named in facts (content, category).

    Terms in back quotes (first path segment, leading @ stripped, four letters or more, not all lower case) are
    PROJECT; quoted names of at most two words and CamelCase names are PROJECT for the category `project`, else ORG;
    addresses are EMAIL. Of equal texts the first by that order stays; quoted terms of `skip` go.
    """
    by_category = F.when(F.coalesce(F.col("category"), F.lit("context")) == "project", "PROJECT").otherwise("ORG")
    content = F.coalesce(F.col("content"), F.lit(""))
    ticked = F.transform(F.regexp_extract_all(content, F.lit("`([^`]+)`"), 1), lambda x: F.regexp_replace(F.substring_index(x, "/", 1), "^@", ""))
    ticked = F.filter(ticked, lambda x: ~x.isin(*skip) & (F.octet_length(x) >= 4) & (x != F.lower(x)) & ~x.isin(*terms))
    quoted = F.concat(*(F.regexp_extract_all(content, F.lit(p), 1) for p in (r"'([A-Z][a-zA-Z0-9 ._\-]{2,})'", r'"([A-Z][a-zA-Z0-9 ._\-]{2,})"')))
    quoted = F.filter(F.transform(quoted, lambda x: F.trim(x)), lambda x: (F.size(F.split(x, r"\s+")) <= 2) & ~x.isin(*terms))
    camel = F.filter(F.regexp_extract_all(content, F.lit(f"({CAMEL})"), 1), lambda x: ~x.isin(*terms))
    mail = F.regexp_extract_all(content, F.lit(f"({EMAIL})"), 1)
    tagged = lambda values, kind, rank: F.transform(values, lambda x: F.struct(F.lit(rank).alias("rank"), x.alias("text"), kind.alias("kind")))
    rows = facts.select(F.explode(F.concat(tagged(ticked, F.lit("PROJECT"), 0), tagged(quoted, by_category, 1), tagged(camel, by_category, 2), tagged(mail, F.lit("EMAIL"), 3))).alias("x"))
    return rows.groupBy(F.lower("x.text").alias("key")).agg(F.min("x").alias("x")).select("x.text", "x.kind")


# Fenced blocks (three back quotes or tildes or more, up to the same fence or the end) and inline code.
FENCE = r"(?m)^ {0,3}(`{3,}|~{3,})[^\n]*(?:\n[\s\S]*?)?(?:^ {0,3}\1[`~]*[ \t]*$|\z)"
INLINE = r"(?<![\\`])(`+)(?!`)[^\n]*?[^`\n](?<![\\])\2(?!`)"
CODE = f"(?:{FENCE})|(?:{INLINE})"


def code_regions(text: Column) -> Column:
    """Spans of fenced blocks and inline code."""
    return spans(text, CODE, "CODE")


def outside_code(text: Column, change) -> Column:
    """`text` with `change` applied to what lies outside of code regions; the regions stay as they are."""
    whole = F.coalesce(text, F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    between = lambda acc, end: change(F.substring(whole, acc["at"] + 1, end - acc["at"]))
    step = lambda acc, r: F.struct(
        (r["start"] + F.char_length(r["text"])).alias("at"), F.concat(acc["out"], between(acc, r["start"]), F.substring(whole, r["start"] + 1, F.char_length(r["text"]))).alias("out")
    )
    return F.aggregate(code_regions(text), start, step, lambda acc: F.concat(acc["out"], between(acc, F.char_length(whole))))
