"""Intermediate tables in the cluster's shared folder, and packing of documents into blocks."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reliq.session import run_dir

T = TypeVar("T")

#: Text bytes after which a block of documents is closed.
BLOCK_BYTES = 8 << 20


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written once to the shared folder and read back: cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def id_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, under names of its own: extra columns cannot clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with as many underscores in front as make it no column of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def slices(batch: pa.RecordBatch, text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of ``batch`` in parts of about ``limit`` text bytes; a longer row is a part of its own.

    Between parts, what the work on them has freed goes back to the machine.
    """
    start = size = 0
    for i, n in enumerate(pc.binary_length(batch.column(text)).to_pylist()):
        size += n or 0
        if size >= limit:
            yield batch.slice(start, i + 1 - start)
            give_back()
            start, size = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)
        give_back()


def packing(block_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What a task of ``pack`` does, for operators that read the blocks in the same Python worker."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = 0

        def close():
            nonlocal number, size
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(pa.Table.from_batches(held).combine_chunks())
            row = pa.RecordBatch.from_pydict({"block": pa.array([number], pa.int64()), "data": pa.array([sink.getvalue().to_pybytes()], pa.binary())})
            held.clear()
            number, size = number + 1, 0
            return row

        for batch in batches:
            for part in slices(batch, "text", block_bytes):
                held.append(part)
                size += part.column("text").nbytes
                if size >= block_bytes:
                    yield close()
        if held:
            yield close()

    return run


def pack(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, data): rows of ``docs`` (doc_id, text, ...) in compressed blocks of whole documents, without a shuffle.

    Blocks are numbered by task and order, so store the result before reading it twice.
    """
    return docs.mapInArrow(packing(block_bytes), "block long, data binary")


def unpack(data: bytes) -> pa.Table:
    """The rows of one block."""
    with pa.ipc.open_stream(data) as stream:
        return stream.read_all()


def utf8(column) -> list[bytes]:
    """Texts as UTF-8 bytes; null reads as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


_HELD: dict = {}
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only


def give_back() -> None:
    """Freed memory goes back to the machine; Arrow and the C library keep it for the worker's next task otherwise."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def worker_drops() -> None:
    """For tasks of operators that keep nothing: what an earlier operator left in this worker goes."""
    _HELD.clear()
    give_back()


def worker_keeps(key, make: Callable[[], T]) -> T:
    """What a Python worker keeps between tasks: ``make()`` under ``key``; only the last key is kept, whichever operator it is of."""
    if key not in _HELD:
        worker_drops()
        _HELD[key] = make()
    return _HELD[key]


def words_of(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text in UTF-8; ``bytes.split`` cuts at exactly these bytes."""
    return text.split()
