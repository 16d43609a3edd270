"""Sources and sinks beside Spark's own: conversation exports, JSON lines, NumPy files, backups and digests."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXPORT = "array<struct<uuid:string,name:string,created_at:string,chat_messages:array<struct<uuid:string,sender:string,text:string,created_at:string,content:array<struct<type:string,text:string>>>>>>"
LEAST_CHARS = 30


def conversation_export(spark: SparkSession, path: str, least: int = LEAST_CHARS) -> DataFrame:
    """(conv_id, title, message_id, content, occurred_at): texts of people in exported conversations (JSON arrays)."""
    files = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", EXPORT)).alias("c"))
    said = files.select("c.uuid", "c.name", F.explode("c.chat_messages").alias("m")).where("m.sender = 'human'")
    blocks = F.array_join(F.transform(F.filter("m.content", lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")
    text = F.trim(F.coalesce(F.when(F.col("m.text") != "", F.col("m.text")), blocks, F.lit("")))
    out = said.select(F.col("uuid").alias("conv_id"), F.col("name").alias("title"), F.col("m.uuid").alias("message_id"), text.alias("content"), F.try_to_timestamp("m.created_at").alias("occurred_at"))
    return out.where(F.char_length("content") >= least)


def labelled_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text, entities) of JSON lines."""
    return spark.read.schema("doc_id string, text string, entities array<struct<start:int,end:int,type:string,text:string>>").json(path)


def npy_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(path, index, vector array<double>) of two-dimensional .npy files; each file is read by one task."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                rows = np.load(io.BytesIO(content), allow_pickle=False).astype(np.float64)
                yield pd.DataFrame({"path": name, "index": np.arange(len(rows)), "vector": list(rows)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(work, "path string, index long, vector array<double>")


#: Relations between tables: table -> [(column, table whose id it holds)].
Relations = dict[str, list[tuple[str, str]]]


def dependency_order(tables: list[str], relations: Relations) -> list[str]:
    """`tables` so that each comes behind those it refers to (itself aside), else by name; a loop is an error."""
    left, out = sorted(tables), []
    while left:
        free = [t for t in left if all(p == t or p not in left for _, p in relations.get(t, []))]
        if not free:
            raise ValueError(f"tables refer to each other: {', '.join(left)}")
        out += free
        left = [t for t in left if t not in free]
    return out


def backup(tables: dict[str, DataFrame], path: str, created: str = "created_at") -> None:
    """Each table as JSON lines below `path`, in the order of `created` where a table has it; refuses folders that exist."""
    for name, df in tables.items():
        rows = df.orderBy(created, *(["id"] if "id" in df.columns else [])) if created in df.columns else df
        rows.write.mode("errorifexists").option("ignoreNullFields", "false").json(f"{path}/{name}")


def restored(spark: SparkSession, path: str, current: dict[str, DataFrame], force: bool = False, relations: Relations | None = None) -> dict[str, DataFrame]:
    """Tables of a backup joined to the current ones, in dependency order: rows whose id is there already are ignored.

    With `relations` so are rows that refer to a row which is neither there nor restored; references that are null, and
    those of a table to itself, are not looked at. Tables that aren't empty raise an error unless `force` is set.
    Schemas are those of the current tables.
    """
    relations, out = relations or {}, {}
    for name in dependency_order(list(current), relations):
        df = current[name]
        if not force and not df.isEmpty():
            raise ValueError(f"{name} isn't empty")
        saved = spark.read.schema(df.schema).json(f"{path}/{name}").join(df.select("id"), "id", "left_anti")
        for column, parent in relations.get(name, []):
            if parent != name and parent in out:
                there = out[parent].select(F.col("id").alias(column)).distinct().withColumn("_there", F.lit(True))
                saved = saved.join(there, column, "left").where(F.col(column).isNull() | F.col("_there")).drop("_there")
        out[name] = df.unionByName(saved)
    return out


def jdbc(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int) -> DataFrame:
    """A database table read in ranges of its integer key."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts)).load()


def write_digest(lines: DataFrame, path: str) -> None:
    """Digest lines (line), in order, as one text file below `path`; a digest is a few lines."""
    lines.select("line").coalesce(1).write.mode("overwrite").text(path)
