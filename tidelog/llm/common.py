"""What the operators of this subpackage share: reading tables, shared folders, Arrow helpers."""

from __future__ import annotations

import ctypes
import os
import uuid
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Used only where the session names no checkpoint folder and runs on one machine, as in tests.
LOCAL_CHECKPOINT_DIR = "/tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share for tables in between: spark.checkpoint.dir, or what
    the context was given as such. A cluster without either is refused, not written to one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = given.get() if given.isDefined() else None
    if not named:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = LOCAL_CHECKPOINT_DIR
    return named.rstrip("/")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Spark then deletes a query's shuffle files when the query ends, not when the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Bytes of rows that a worker holds before it writes them.
_GROUP_BYTES = 8 << 20


def trim() -> None:
    """Gives a worker's free memory back: it waits for further tasks, and what it once held would count
    while others run. Where the C library can't, nothing happens."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


_LIBC = ctypes.CDLL(None)


def _to_file(folder: str, make):
    """For mapInArrow: writes what make makes of a task's rows, or the rows, to one file, which appears once it
    is whole; a task that runs again replaces it by equal rows."""

    def run(batches):
        from pyspark import TaskContext

        name = f"part-{TaskContext.get().partitionId():05d}.parquet"
        hidden, writer, held, size, rows = f"{folder}/.{name}-{uuid.uuid4().hex}", None, [], 0, 0
        for batch in chain(make(batches) if make else batches, [None]):
            if batch is not None and batch.num_rows:
                held.append(batch)
                size += batch.nbytes
                rows += batch.num_rows
            if held and (batch is None or size >= _GROUP_BYTES):
                writer = writer or pq.ParquetWriter(hidden, held[0].schema)
                writer.write_table(pa.Table.from_batches(held))
                held, size = [], 0
        if writer:
            writer.close()
            os.replace(hidden, f"{folder}/{name}")
        writer = None
        trim()
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64())], names=["rows"])

    return run


def _plain(kind: T.DataType) -> bool:
    """Whether Arrow's files hold the type as Spark's do."""
    if isinstance(kind, T.StructType):
        return all(_plain(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return _plain(kind.elementType)
    return isinstance(kind, (T.IntegralType, T.StringType))


class Scratch:
    """Parquet tables in a folder of their own below spark.checkpoint.dir, which driver and executors
    share. Writing cuts lineage and survives lost executors. Tables go when they are dropped, or
    else when the session's process ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/tidelog-{uuid.uuid4().hex}"
        self.paths: dict[int, tuple[DataFrame, str]] = {}
        self._path(self.folder)[1].deleteOnExit(self._path(self.folder)[0])

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def write(self, df: DataFrame) -> DataFrame:
        """df as a table. What its computation shuffled is gone afterwards."""
        path = f"{self.folder}/{len(self.paths)}"
        # the setting is read where a query is planned
        self._cleaning(lambda: df.select("*").write.parquet(path))
        return self._written(path, df.schema)

    def write_numbers(self, df: DataFrame, make=None, ddl: str | None = None) -> DataFrame:
        """df, or what make makes of it for mapInArrow, of integers, strings, arrays and structs of them, as a
        table. Where the folder is mounted, the workers write the files: Hadoop's file system forks chmod for each
        file, its checksums and its task's folder if it lacks its native library, and until such a child is
        chmod it shares the executor's memory. Other stores and types are written to by Spark."""
        path = f"{self.folder}/{len(self.paths)}"
        folder, fs = self._path(path)
        made = df.mapInArrow(make, ddl) if make else df
        if fs.getScheme() != "file" or not _plain(made.schema):
            return self.write(made)
        folder = folder.toUri().getPath()
        os.makedirs(folder)
        self._cleaning(lambda: df.mapInArrow(_to_file(folder, make), "rows long").collect())
        return self._written(path, made.schema)

    def _cleaning(self, run) -> None:
        before = self.spark.conf.get(_CLEANUP)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            run()
        finally:
            self.spark.conf.set(_CLEANUP, before)

    def _written(self, path: str, schema) -> DataFrame:
        out = self.spark.read.schema(schema).parquet(path)
        self.paths[len(self.paths)] = (out, path)
        return out

    def size(self, *tables: DataFrame) -> int:
        """Bytes of tables' files."""
        found = [self._path(name) for out, name in self.paths.values() if any(out is t for t in tables)]
        return sum(fs.getContentSummary(path).getLength() for path, fs in found)

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing still to be computed reads."""
        for out, name in self.paths.values():
            if any(out is t for t in tables):
                path, fs = self._path(name)
                fs.delete(path, True)


def written(df: DataFrame) -> DataFrame:
    return Scratch(df.sparkSession).write(df)


#: Bytes of files that one task reads or writes where they are dealt out by size.
TASK_BYTES = 8 << 20


def by_size(df: DataFrame, read: DataFrame) -> DataFrame:
    """df in no more tasks than the size of read, a table in files, asks for, and two for each core at least:
    however many files or shuffle partitions there are, each file that a task writes costs its executor
    processes (see write_numbers). Where the size isn't known, the tasks stay as they are."""
    size = read._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.coalesce(min(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES)), 1 << 30))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts of a column as one byte array and the len + 1 offsets into it; null texts are empty."""
    column = pa.array([], pa.large_string()) if len(column) == 0 else column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, most_bytes: int):
    """Parts of a batch of about most_bytes of text each; a longer text is a part of its own."""
    _, offsets = utf8_buffer(batch.column(text))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + most_bytes, "right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end
