"""What the operators of this subpackage share: scratch tables on shared storage and slicing of Arrow batches."""

from __future__ import annotations

import ctypes
import sys
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions.scratch import scratch_root

#: Characters of text that one slice of a batch holds at most (one document may be longer).
SLICE_CHARS = 2_000_000

#: A word is a run of characters other than these: exactly what ``bytes.split()`` splits at.
WORD = r"[^\x20\x09-\x0D]+"


class Scratch:
    """Named Parquet tables under one new folder of the shared storage; they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` and returns a frame that reads it back."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Removes tables that no later step reads."""
        jvm, jsc = self.spark._jvm, self.spark._jsc
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(jsc.hadoopConfiguration()).delete(path, True)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the text in each piece stays under ``chars`` bytes, whatever the session's batch size is."""
    for batch in batches:
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(lengths):
            if held and held + n > chars:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column as strings, null as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def raw(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column as UTF-8 bytes, null as empty."""
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def narrow(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that extra columns of the input never clash with those an operator adds."""
    return docs.select(*(F.col(c) for c in columns))


def unused(name: str, df: DataFrame) -> str:
    """The name, with underscores before it if the table has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def release() -> None:
    """Gives memory back that a worker keeps from tasks of the token operators: called by tasks of the others, which need none of it."""
    for module in ("encoding", "wordpiece"):
        if loaded := sys.modules.get(f"{__package__}.{module}"):
            loaded.forget()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)
