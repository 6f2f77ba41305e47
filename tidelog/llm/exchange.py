"""Blocks of documents that keep their state in place, and compact requests between blocks and buckets.

A block is a run of documents of one input partition with its state in a few binary columns.  Blocks are
written once as a table bucketed by block, so that later joins by block move the answers and not the texts.
A bucket owns a share of all keys: blocks send it sorted, packed key lists, one row a block and bucket, and it
answers every block in the order of its list.  Buckets are as many as keep each of them to a fixed number of
keys, whatever the input's size; a key comes once a block, however frequent it is.

Requests and answers are written as Parquet under the shared folder, so a lost executor costs its own tasks.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store, workers

ROW = "bucket int, block long, kind string, payload binary"
#: Text that a block holds, unless one document has more.
BLOCK_BYTES = 12 << 20


def pack(*arrays: np.ndarray) -> bytes:
    """Integer or float arrays as compressed byte planes."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1, write_checksum=False).compress
    out = [len(arrays).to_bytes(2, "little")]
    for a in arrays:
        if a.dtype.kind in "iu" and a.dtype.itemsize > 1 and len(a):
            top = int(a.max()) if a.min() >= 0 else 1 << 63
            a = a.astype(next(t for t in ("<u1", "<u2", "<u4", "<u8") if top < 1 << (8 * np.dtype(t).itemsize)) if top < 1 << 63 or a.dtype.kind == "u" else "<i8")
        a = np.ascontiguousarray(a)
        data = squeeze(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.dtype.itemsize).T).tobytes() if len(a) else b"")
        kind = a.dtype.str.encode()
        out += [bytes([len(kind)]), kind, len(a).to_bytes(8, "little"), len(data).to_bytes(8, "little"), data]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    import zstandard

    expand, at, out = zstandard.ZstdDecompressor().decompress, 2, []
    for _ in range(int.from_bytes(data[:2], "little")):
        kind = np.dtype(data[at + 1 : at + 1 + data[at]].decode())
        at += 1 + data[at]
        n, size = int.from_bytes(data[at : at + 8], "little"), int.from_bytes(data[at + 8 : at + 16], "little")
        raw = expand(data[at + 16 : at + 16 + size]) if n else b""
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, n).T).view(kind).reshape(-1))
        at += 16 + size
    return out


def gaps(sorted_: np.ndarray) -> np.ndarray:
    """Differences of a non-decreasing unsigned array, the first value first; :func:`sums` undoes it."""
    return np.diff(sorted_, prepend=sorted_.dtype.type(0)) if len(sorted_) else sorted_


def sums(differences: np.ndarray) -> np.ndarray:
    return np.cumsum(differences.astype(np.uint64), dtype=np.uint64)


def slices(buckets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, start, end) of each run of a non-decreasing array."""
    edges = np.concatenate(([0], np.flatnonzero(np.diff(buckets)) + 1, [len(buckets)])) if len(buckets) else [0]
    for s, e in zip(edges[:-1], edges[1:], strict=True):
        yield int(buckets[s]), int(s), int(e)


def rows(items: list[tuple]) -> pa.Table:
    """Rows of :data:`ROW`."""
    return pa.table({"bucket": pa.array([x[0] for x in items], pa.int32()), "block": pa.array([x[1] for x in items], pa.int64()), "kind": pa.array([x[2] for x in items], pa.string()), "payload": pa.array([x[3] for x in items], pa.binary())})


def blocks(docs: DataFrame, build: Callable[[list, list[bytes]], tuple], columns: str, name: str) -> DataFrame:
    """The table (block, *columns) of ``build(keys, texts)`` over runs of rows (key, text); null texts are empty.

    It is bucketed by block in the warehouse, in as many buckets as there are shuffle partitions.
    """
    spark = docs.sparkSession
    workers.small_batches(spark)
    schema = spark.createDataFrame([], f"block long, {columns}").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, keys, texts, held = TaskContext.get().partitionId() << 24, [], [], 0

        def done() -> pa.RecordBatch:
            nonlocal number, keys, texts, held
            row = (number, *build(keys, texts))
            number, keys, texts, held = number + 1, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([x]) if isinstance(x, bytes) else pa.array([x], pa.int64()) for x in row], schema.names)

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
                text = text.as_py() or b""
                if texts and held + len(text) > BLOCK_BYTES:
                    yield done()
                keys.append(key)
                texts.append(text)
                held += len(text)
        if texts:
            yield done()

    table = f"tidelog_{name}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs.mapInArrow(workers.tidy(run), schema).write.bucketBy(n, "block").option("compression", "uncompressed").saveAsTable(table)
    return spark.table(table)


def ask(df: DataFrame, request: Callable[..., list[tuple]], answer: Callable[[int, list[tuple[int, bytes]]], list[tuple]], name: str) -> DataFrame:
    """Requests of each row of ``df`` go to their buckets; what the buckets answer is written and read back.

    ``request(*row)`` gives rows of :data:`ROW`, as does ``answer(bucket, [(block, payload), ...])``, which gets
    all requests to one bucket.  The written table is partitioned by kind.
    """
    spark = df.sparkSession

    def requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from rows(request(*(c[i].as_py() for c in batch.columns))).to_batches()

    def answers(group: pa.Table) -> pa.Table:
        group = group.sort_by("block")
        return rows(answer(group["bucket"][0].as_py(), list(zip(group["block"].to_pylist(), group["payload"].to_pylist(), strict=True))))

    path = store.scratch(spark, name)
    df.mapInArrow(workers.tidy(requests), ROW).groupBy("bucket").applyInArrow(workers.tidy_group(answers), ROW).write.partitionBy("kind").option("compression", "uncompressed").parquet(path)
    return spark.read.schema(ROW).option("basePath", path).parquet(path)


def by_block(answers: DataFrame, column: str, kind: str = "answer") -> DataFrame:
    """(block, column): all answers to a block, as many as there are buckets at the most."""
    return answers.where(F.col("kind") == kind).groupBy("block").agg(F.collect_list(F.struct("bucket", "payload")).alias(column))
