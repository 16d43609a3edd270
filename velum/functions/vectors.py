"""Vector functions over array columns, as Catalyst expressions and as SQL functions of the session."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _same_length(a: Column, b: Column, out: Column) -> Column:
    return F.when(F.size(a) == F.size(b), out).otherwise(F.raise_error(F.lit("vectors of different lengths")))


def _double(a: Column) -> Column:
    return a.cast("array<double>")


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    return _same_length(a, b, F.sqrt(_sum(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)))))


def l1(a: Column, b: Column) -> Column:
    """Sum of absolute differences."""
    return _same_length(a, b, _sum(F.zip_with(_double(a), _double(b), lambda x, y: F.abs(x - y))))


def dot(a: Column, b: Column) -> Column:
    return _same_length(a, b, _sum(F.zip_with(_double(a), _double(b), lambda x, y: x * y)))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(_double(a), lambda x: x * x)))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; NaN with a zero vector."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(float("nan"))).otherwise(1 - F.try_divide(dot(a, b), size))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of bit vectors held as array<tinyint>."""
    return _same_length(a, b, F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y).cast("int").bitwiseAND(255))), F.lit(0), lambda acc, x: acc + x))


def length(a: Column) -> Column:
    return F.size(a)


def kind(a: Column) -> Column:
    """float32, int8 or the type's own name."""
    name = F.typeof(a)
    return F.when(name.isin("array<float>", "array<double>"), "float32").when(name == "array<tinyint>", "int8").otherwise(name)


def add(a: Column, b: Column) -> Column:
    return _same_length(a, b, F.zip_with(a, b, lambda x, y: x + y))


def sub(a: Column, b: Column) -> Column:
    return _same_length(a, b, F.zip_with(a, b, lambda x, y: x - y))


def cut(a: Column, start: int, end: int) -> Column:
    """Elements start to end - 1; raises an error unless 0 <= start < end <= length."""
    if start < 0 or start >= end:
        raise ValueError("0 <= start < end is needed")
    return F.when(F.size(a) >= end, F.slice(a, start + 1, end - start)).otherwise(F.raise_error(F.lit("slice beyond the vector")))


def normalize(a: Column) -> Column:
    """Divided by its length (zero vectors: null)."""
    size = norm(a)
    return F.when(size > 0, F.transform(_double(a), lambda x: x / size))


def to_json(a: Column) -> Column:
    """`[...]` with six decimals an element, NaN as null."""
    return F.concat(F.lit("["), F.array_join(F.transform(_double(a), lambda x: F.when(F.isnan(x), "null").otherwise(F.format_string("%.6f", x))), ","), F.lit("]"))


def from_json(text: Column, element: str = "float") -> Column:
    """An array from its JSON text; null where it isn't one."""
    return F.from_json(text, f"array<{element}>")


def quantize_binary(a: Column) -> Column:
    """Bit i of byte j is set where element 8 * j + i is positive; the length must be a multiple of eight."""
    byte = lambda j: F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0), lambda acc, i: acc + F.when(F.get(a, j * 8 + i) > 0, F.shiftleft(F.lit(1), 0) * F.pow(F.lit(2), i)).otherwise(0).cast("int"))
    made = F.transform(F.sequence(F.lit(0), (F.size(a) / 8).cast("int") - 1), lambda j: F.when(byte(j) > 127, byte(j) - 256).otherwise(byte(j)).cast("tinyint"))
    return F.when(F.size(a) % 8 == 0, made).otherwise(F.raise_error(F.lit("a multiple of eight elements is needed")))


def quantize_int8(a: Column) -> Column:
    """Unit range to int8: trunc((x + 1) / (2 / 255) - 128) held to -128..127."""
    return F.transform(_double(a), lambda x: F.least(F.greatest((x + 1) / (2.0 / 255) - 128, F.lit(-128.0)), F.lit(127.0)).cast("int").cast("tinyint"))


def each(df: DataFrame, vector: str, *keep: str) -> DataFrame:
    """(*keep, index, value): one row per element."""
    return df.select(*keep, F.posexplode(vector).alias("index", "value"))


def register(spark: SparkSession) -> list[str]:
    """Declares the functions for SQL text of this session, as SQL functions that Catalyst inlines; returns their names."""
    v = "ARRAY<DOUBLE>"
    total = lambda e: f"aggregate({e}, CAST(0 AS DOUBLE), (s, x) -> s + x)"
    norm_of = lambda a: f"sqrt({total(f'transform({a}, x -> x * x)')})"
    bodies = {
        "vec_distance_l2": (f"a {v}, b {v}", "DOUBLE", f"sqrt({total('zip_with(a, b, (x, y) -> (x - y) * (x - y))')})"),
        "vec_distance_l1": (f"a {v}, b {v}", "DOUBLE", total("zip_with(a, b, (x, y) -> abs(x - y))")),
        "vec_distance_cosine": (f"a {v}, b {v}", "DOUBLE", f"1 - {total('zip_with(a, b, (x, y) -> x * y)')} / ({norm_of('a')} * {norm_of('b')})"),
        "vec_length": (f"a {v}", "INT", "size(a)"),
        "vec_add": (f"a {v}, b {v}", v, "zip_with(a, b, (x, y) -> x + y)"),
        "vec_sub": (f"a {v}, b {v}", v, "zip_with(a, b, (x, y) -> x - y)"),
        "vec_slice": (f"a {v}, s INT, e INT", v, "slice(a, s + 1, e - s)"),
        "vec_normalize": (f"a {v}", v, f"transform(a, y -> y / {norm_of('a')})"),
        "vec_to_json": (f"a {v}", "STRING", "concat('[', array_join(transform(a, x -> CASE WHEN isnan(x) THEN 'null' ELSE format_string('%.6f', x) END), ','), ']')"),
        "vec_f32": ("t STRING", "ARRAY<FLOAT>", "from_json(t, 'array<float>')"),
        "vec_int8": ("t STRING", "ARRAY<TINYINT>", "from_json(t, 'array<tinyint>')"),
        "vec_quantize_int8": (f"a {v}", "ARRAY<TINYINT>", "transform(a, x -> CAST(CAST(least(greatest((x + 1) / (2.0D / 255) - 128, -128.0D), 127.0D) AS INT) AS TINYINT))"),
    }
    bits = "aggregate(zip_with(a, b, (x, y) -> bit_count(CAST(x ^ y AS INT) & 255)), 0, (s, x) -> s + x)"
    byte = "aggregate(sequence(0, 7), 0, (s, i) -> s + IF(get(a, j * 8 + i) > 0, CAST(pow(2, i) AS INT), 0))"
    bodies |= {
        "vec_distance_hamming": ("a ARRAY<TINYINT>, b ARRAY<TINYINT>", "INT", bits),
        "vec_bit": ("t STRING", "ARRAY<TINYINT>", "from_json(t, 'array<tinyint>')"),
        "vec_quantize_binary": (f"a {v}", "ARRAY<TINYINT>", f"transform(sequence(0, CAST(size(a) / 8 AS INT) - 1), j -> CAST({byte} - IF({byte} > 127, 256, 0) AS TINYINT))"),
        "vec_each": (f"a {v}", "TABLE(index INT, value DOUBLE)", "SELECT pos, col FROM posexplode(a)"),
    }
    for name, (args, out, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {out} RETURN {body}")
    return sorted(bodies)


def from_blob(df: DataFrame, blob: str, out: str, dims: int | None = None) -> DataFrame:
    """`df` with `out`: array<float> of little-endian 32-bit floats; null for null or odd lengths, checked against `dims`."""
    @F.pandas_udf("array<float>")
    def unpack(values: pd.Series) -> pd.Series:
        return values.map(lambda b: np.frombuffer(b, "<f4") if b is not None and len(b) % 4 == 0 else None)

    got = unpack(F.col(blob))
    return df.withColumn(out, got if dims is None else F.when(F.octet_length(blob) == 4 * dims, got).when(F.col(blob).isNotNull(), F.raise_error(F.lit("vector of another length"))))


def to_blob(df: DataFrame, vector: str, out: str) -> DataFrame:
    """`df` with `out`: the vector as little-endian 32-bit floats."""
    @F.pandas_udf("binary")
    def pack(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return df.withColumn(out, pack(F.col(vector)))
