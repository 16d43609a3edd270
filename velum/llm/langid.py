"""Language of web pages by Bayesian evidence fusion.

The log-posterior of a language adds up: the n-gram likelihood of the visible text, the language that the markup
declares, the address suffix, and the prior of the host. Declarations and suffixes get conditional tables, hosts get
priors smoothed towards their domain and those towards the whole corpus; all come from grouped sums of the text
evidence over every page, and what a page itself added to its host is taken out again when it is judged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velum.llm.common import blocks, flat, map_batches, mix, prefix_hash, span_hash, stored, utf8, words_of
from velum.llm.samples import bounded

BITS = 16
#: Labelled documents that the n-gram likelihoods are counted on at most.
MOST_TRAIN = 4000
#: N-grams of one text depend on each other; at most so many count as independent evidence.
EVIDENCE = 40.0
#: Pseudo-pages of smoothing: domain by corpus, host by domain, cells of the conditional tables.
DOMAIN_PSEUDO, HOST_PSEUDO, CELL_PSEUDO = 10.0, 5.0, 1.0
_HIDDEN = re.compile(rb"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")


def grams(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, document index): character trigrams within documents, and words."""
    if len(raw) > 2:
        wide = raw.astype(np.uint64)
        packed = wide[:-2] | wide[1:-1] << np.uint64(8) | wide[2:] << np.uint64(16)
        owner = np.searchsorted(offsets, np.arange(len(packed)), "right") - 1
        fits = np.flatnonzero(np.arange(2, len(raw)) < offsets[owner + 1])
        yield (mix(packed[fits] | np.uint64(1 << 40)) >> np.uint64(64 - BITS)).astype(np.int64), owner[fits]
    start, end, of = words_of(raw, offsets)
    yield (span_hash(prefix_hash(raw), start, end) >> np.uint64(64 - BITS)).astype(np.int64), of


def visible(html: bytes) -> bytes:
    """The text between tags, without scripts, styles and comments; character references stay as they are."""
    return b" ".join(_HIDDEN.sub(b" ", html).split())


def train(docs: DataFrame, most: int = MOST_TRAIN) -> tuple[list[str], np.ndarray]:
    """(languages, log-likelihood of each bucket and language) counted on at most `most` labelled documents."""
    rows = bounded(docs.where("doc_id IS NOT NULL AND lang IS NOT NULL").select("doc_id").distinct(), "doc_id", most)
    joined = docs.where("lang IS NOT NULL").join(F.broadcast(rows), "doc_id").select("lang", utf8(lower=True).alias("_text"))  # at most `most` ids

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for i, raw, offsets in blocks(*flat(batch.column(1))):
                names, index = np.unique(langs[i : i + len(offsets) - 1].astype(str), return_inverse=True)
                for bucket, owner in grams(raw, offsets):
                    sums = np.bincount(index[owner] << BITS | bucket, minlength=len(names) << BITS).reshape(len(names), -1)
                    for name, row in zip(names, sums, strict=True):
                        total[name] = total.get(name, 0) + row
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.astype("<i8").tobytes() for v in total.values()], pa.binary())], names=["lang", "counts"])

    sums: dict[str, np.ndarray] = {}
    for row in map_batches(joined.repartition(8), work, "lang string, counts binary").collect():  # 8 tables of counts
        sums[row.lang] = sums.get(row.lang, 0) + np.frombuffer(row.counts, "<i8")
    names = sorted(sums)
    if not names:
        return ["und"], np.zeros((1 << BITS, 1), np.float32)
    table = np.stack([sums[n] + 0.5 for n in names], 1)
    return names, np.log(table / table.sum(0)).astype(np.float32)


def _address(url):
    """(host, domain, suffix) of a url column: the suffix is the last host label and a two-letter first path segment."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    domain = F.array_join(F.slice(F.reverse(F.slice(F.reverse(F.split(host, r"\.")), 1, 2)), 1, 2), ".")
    path = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*?//[^/?#]*/([A-Za-z]{2})(?:[/?#]|$)", 1))
    return host, domain, F.concat(F.substring_index(host, ".", -1), F.lit("/"), path)


def identify(pages: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """(page_id, lang, confidence, text_lang, declared, host, n_grams): one row per row of `pages` (page_id, url, html).

    Shuffles hold one small row a page, never its html. Host sums are combined before the shuffle and the join back to
    the pages of a host has one row a host on its other side, which adaptive execution can split. Null or empty html has
    no text evidence, null or odd addresses share the empty host, other declared codes than known ones count as `?`, no
    declaration as the empty string. Ties go to the first language by name. Extra columns are dropped.
    """
    names, table = model
    spark = pages.sparkSession
    shared = spark.sparkContext.broadcast(table)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = shared.value.astype(np.float64)
        for batch in batches:
            texts = pa.array([visible(x).lower() for x in batch.column(4).to_pylist()], pa.binary())
            likely, count = np.zeros((len(texts), len(names))), np.zeros(len(texts))
            for i, raw, offsets in blocks(*flat(texts)):
                n = len(offsets) - 1
                for bucket, owner in grams(raw, offsets):
                    count[i : i + n] += np.bincount(owner, minlength=n)
                    for k in range(len(names)):
                        likely[i : i + n, k] += np.bincount(owner, values[bucket, k], n)
            likely *= (np.minimum(count, EVIDENCE) / np.maximum(count, 1))[:, None]
            posterior = np.exp(likely - likely.max(1, keepdims=True))
            posterior /= posterior.sum(1, keepdims=True)
            listed = lambda m: pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), len(names)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], batch.column(5), listed(likely), listed(posterior), pa.array(count.astype(np.int64))], names=["page_id", "host", "domain", "suffix", "declared", "likely", "soft", "n_grams"])

    host, domain, suffix = _address(F.col("url"))
    said = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]+)""", 1))
    declared = F.when(said.isin(*names, ""), said).otherwise("?")
    kind = pages.schema["page_id"].dataType.simpleString()
    source = pages.select("page_id", host.alias("host"), domain.alias("domain"), suffix.alias("suffix"), utf8("html", lower=False).alias("_html"), declared.alias("declared"))
    seen = stored(map_batches(source, work, f"page_id {kind}, host string, domain string, suffix string, declared string, likely array<double>, soft array<double>, n_grams long"), "pages")

    soft = [F.sum(F.col("soft")[k]).alias(f"s{k}") for k in range(len(names))]
    sums = lambda c: F.array(*(F.col(f"s{k}") for k in range(len(names)))).alias(c)
    whole = [float(x or 0) for x in seen.agg(*soft).first()]
    flat_prior = [(x + 1) / (sum(whole) + len(names)) for x in whole]
    # Conditional tables: declared codes are bounded by the languages; suffixes stay distributed.
    cells = {r["declared"]: [float(r[f"s{k}"]) for k in range(len(names))] for r in seen.groupBy("declared").agg(*soft).collect()}
    log_said = {d: [float(np.log((v[k] + CELL_PSEUDO) / (whole[k] + CELL_PSEUDO * (len(names) + 2)))) for k in range(len(names))] for d, v in cells.items()}
    suffixes = seen.groupBy("suffix").agg(*soft).select("suffix", sums("by_suffix"))
    hosts = seen.groupBy("host", "domain").agg(*soft).select("host", "domain", sums("by_host"))
    domains = seen.groupBy("domain").agg(*soft).select("domain", sums("by_domain"))
    joined = seen.join(hosts.drop("domain"), "host", "left").join(domains, "domain", "left").join(suffixes, "suffix", "left")

    scores = []
    for k in range(len(names)):
        mine = F.col("soft")[k]
        total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
        by_domain = (F.greatest(F.col("by_domain")[k] - mine, F.lit(0.0)) + DOMAIN_PSEUDO * flat_prior[k]) / (total("by_domain") - 1 + DOMAIN_PSEUDO)
        by_host = (F.greatest(F.col("by_host")[k] - mine, F.lit(0.0)) + HOST_PSEUDO * by_domain) / (total("by_host") - 1 + HOST_PSEUDO)
        by_suffix = (F.greatest(F.col("by_suffix")[k] - mine, F.lit(0.0)) + CELL_PSEUDO * flat_prior[k]) / (whole[k] + CELL_PSEUDO)
        by_said = F.lit(0.0)
        for d, v in sorted(log_said.items()):
            by_said = F.when(F.col("declared") == d, v[k]).otherwise(by_said)
        scores.append(F.col("likely")[k] + by_said + F.log(by_suffix) + F.log(by_host))
    fused = joined.withColumn("score", F.array(*scores)).withColumn("best", F.array_max("score"))
    name = F.array(*map(F.lit, names))
    return fused.select(
        "page_id", F.get(name, F.array_position("score", F.col("best")).cast("int") - 1).alias("lang"),
        (1 / F.aggregate("score", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("best")))).alias("confidence"),
        F.get(name, F.array_position("likely", F.array_max("likely")).cast("int") - 1).alias("text_lang"), "declared", "host", "n_grams",
    )
