"""Five stages from raw documents to tokens; each stage works on all that the one before kept.

quality classifier -> n-gram Jaccard join -> suffix-array dedup -> benchmark decontamination -> BPE.
All stages but the last return the columns of `documents` (doc_id, text, lang, source, n_chars).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.io import table
from velum.llm import bpe, decontaminate, jaccard, quality, suffix_dedup
from velum.llm.common import stored
from velum.llm.queries import TOKENIZER

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Repeated passages: fewer words are left alone; the bytes are what 99 of 100 passages of so many words exceed in each
#: language of the corpus (measured: 201 Spanish, 203 French, 224 English, 258 German), the q-grams a quarter of them.
PASSAGE_WORDS, PASSAGE_BYTES = 51, 200


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects."""
    model = quality.train(docs, quality.graded(table(spark, sf_dir, "labels")))
    return quality.score(docs, model, carry=COLUMNS[1:]).where("kept").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of every class of near-duplicates one text of the smallest id; rows equal in all columns leave one.

    Rows are judged by id and text, so different texts under one id don't touch each other. A row without an id or
    without words is near to no other and stays.
    """
    dropped = jaccard.join(docs, by_row=True).where("NOT first").select("doc_id", "_t").distinct()
    kept = docs.select(*COLUMNS, jaccard.text_key().alias("_t")).join(dropped, ["doc_id", "_t"], "left_anti")
    return kept.select(*COLUMNS).distinct()


def repeated_string_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of PASSAGE_WORDS words that stand elsewhere too out of texts (n_chars follows).

    They are found as repeated strings of PASSAGE_BYTES bytes. Documents that consist of them go.
    """
    cut = suffix_dedup.cut_texts(docs, PASSAGE_BYTES, ("lang", "source"), PASSAGE_BYTES // 4, PASSAGE_WORDS)
    return cut.where("n_removed = 0 OR n_chars > 0").select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a benchmark item occurs."""
    found = decontaminate.find(docs, table(spark, sf_dir, "benchmark"), carry=COLUMNS[1:])
    return found.where("NOT contaminated").select(*COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the texts that are left."""
    return bpe.digests(docs, TOKENIZER)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_strings", repeated_string_stage),
    ("decontamination", decontamination_stage),
    ("tokens", token_stage),
]

#: Classifier, joins on hashed sets and token merges have no SQL form; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
