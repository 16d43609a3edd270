"""NumPy files as a Spark data source that reads one file in many tasks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a file that a task reads, and rows of a batch that it gives out.
TASK_BYTES, BATCH_ROWS = 64 << 20, 4096


@dataclass
class Rows(InputPartition):
    """Rows [start, end) of a file."""

    path: str
    start: int
    end: int


@dataclass
class Header:
    """What stands in front of the numbers: shape as (rows, columns), order of axes, type, and where they begin."""

    rows: int
    columns: int
    by_column: bool
    dtype: np.dtype
    offset: int


def header(file) -> Header:
    """The header of an open file of one or two dimensions and a plain number type; ValueError for any other."""
    version = np.lib.format.read_magic(file)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, by_column, dtype = read(file)
    if len(shape) not in (1, 2) or dtype.kind not in "fiub":
        raise ValueError(f"an array of one or two dimensions of numbers is needed, not {dtype} {shape}")
    return Header(shape[0], shape[1] if len(shape) == 2 else 1, by_column and len(shape) == 2, dtype, file.tell())


class NpyReader(DataSourceReader):
    """Deals the rows of all files to tasks of about `task_bytes`."""

    def __init__(self, path: str, task_bytes: int):
        self.path, self.task_bytes = path, task_bytes

    def partitions(self) -> list[Rows]:
        store, path = fs.FileSystem.from_uri(self.path)
        info = store.get_file_info(path)
        files = [info] if info.is_file else store.get_file_info(fs.FileSelector(path, recursive=True))
        out = []
        for f in sorted((f.path for f in files if f.is_file and f.path.endswith(".npy"))):
            with store.open_input_file(f) as file:
                head = header(file)
            step = max(1, self.task_bytes // max(1, head.columns * head.dtype.itemsize))
            out += [Rows(f, a, min(a + step, head.rows)) for a in range(0, head.rows, step)]
        return out or [Rows("", 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if partition.start == partition.end:
            return
        store, _ = fs.FileSystem.from_uri(self.path)
        with store.open_input_file(partition.path) as file:
            head = header(file)
            size = head.dtype.itemsize
            for a in range(partition.start, partition.end, BATCH_ROWS):
                b = min(a + BATCH_ROWS, partition.end)
                if head.by_column:  # each column is a piece of the file
                    parts = [np.frombuffer(file.read_at(size * (b - a), head.offset + size * (c * head.rows + a)), head.dtype) for c in range(head.columns)]
                    x = np.stack(parts, 1) if parts else np.zeros((b - a, 0))
                else:
                    x = np.frombuffer(file.read_at(size * head.columns * (b - a), head.offset + size * head.columns * a), head.dtype)
                numbers = pa.array(x.astype(np.float64).ravel())
                at = pa.array(np.arange(0, head.columns * (b - a) + 1, max(1, head.columns)) if head.columns else np.zeros(b - a + 1), pa.int32())
                vectors = pa.ListArray.from_arrays(at, numbers)
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * (b - a)), pa.array(np.arange(a, b)), vectors], names=["path", "index", "vector"])


class NpyDataSource(DataSource):
    """`spark.read.format("npy").load(path)`: (path, index, vector) of a file or of all .npy files of a folder."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "path string, index long, vector array<double>"

    def reader(self, schema) -> NpyReader:
        return NpyReader(self.options["path"], int(self.options.get("task_bytes", TASK_BYTES)))


def npy_rows(spark: SparkSession, path: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(path, index, vector array<double>): rows of .npy files, read in pieces of about `task_bytes` by ranges of bytes.

    Any number type and either order of axes; an array of one dimension gives vectors of length one. `path` is a local
    path or a URI of a store that Arrow opens on all workers; velum.sources.formats.npy_vectors() reads any store that
    Spark does, a file a task.
    """
    spark.dataSource.register(NpyDataSource)
    return spark.read.format("npy").option("task_bytes", str(task_bytes)).load(path)
