"""Documents in compressed blocks, and small answers about their items by hash bucket.

An operator that must know something about each of millions of items (who else has it, how
often it occurs) sends a block's items, packed into one row per bucket, to the bucket of
their hashes, and gets one packed answer back per row, so that shuffles carry a few bytes
an item rather than a row."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 2_000_000
SENT = "block string, bucket long, sent binary"


@functools.cache
def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    """A task's own, kept, as most messages are small."""
    return zstandard.ZstdCompressor(1), zstandard.ZstdDecompressor()


def pack(*arrays: np.ndarray) -> bytes:
    return _zstd()[0].compress(b"".join(a.tobytes() for a in arrays))


def unpack(blob: bytes) -> bytes:
    return _zstd()[1].decompress(blob)


def blocks(docs: DataFrame, size: int = BLOCK_BYTES, nulls: bool = False) -> DataFrame:
    """Rows ``(block, n, head, body)``: about ``size`` bytes of documents a block, with ``nulls``
    also those without an id; ``head`` holds ids, byte lengths and which ids are null, ``body``
    the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, named = TaskContext.get().partitionId(), 0  # names by place: a task that is run again names its blocks as before
        for batch in batches:
            ids, texts, total = [], [], 0
            out = []
            for k, (i, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                ids.append(i)
                texts.append((t or "").encode("utf-8", "surrogatepass"))
                total += len(texts[-1])
                if total >= size or k + 1 == batch.num_rows:
                    head = np.array([[i or 0 for i in ids], [len(t) for t in texts], [i is None for i in ids]], np.int64).tobytes()
                    out.append((f"{task}-{named}", len(ids), head, pack(np.frombuffer(b"".join(texts), np.uint8))))
                    ids, texts, total, named = [], [], 0, named + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["block", "n", "head", "body"])

    rows = (docs if nulls else docs.where("doc_id is not null")).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "block string, n long, head binary, body binary")


def opened(row: dict) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Ids, byte lengths and the texts, strung together, of a block."""
    ids, sizes, _ = np.frombuffer(row["head"], np.int64).reshape(3, -1)
    return ids, sizes, unpack(row["body"])


def ids_of(row: dict) -> list[int | None]:
    """The ids of a block, nulls as they were."""
    ids, _, null = np.frombuffer(row["head"], np.int64).reshape(3, -1)
    return [None if n else i for i, n in zip(ids.tolist(), null.tolist(), strict=True)]


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def by_bucket(values: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of hashes by bucket, the bucket of each in that order, and 32 bits of what is left of it."""
    bucket = (values % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, bucket[order], (values // np.uint64(buckets) >> np.uint64(8)).astype(np.uint32)[order]


def runs(x: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """``(value, start, stop)`` of each run of equal values."""
    edges = np.flatnonzero(np.r_[True, x[1:] != x[:-1], True]) if len(x) else np.zeros(1, np.int64)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(x[a]), a, b


def answers(sent: DataFrame, parts: int, compare: Callable[[list[dict]], list[tuple]]) -> DataFrame:
    """Rows ``(block, bucket, answer)``: ``compare`` gets all rows of a bucket at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        out: list[tuple] = []
        for row in _and_none(rows_of(batches)):
            if held and (row is None or row["bucket"] != held[0]["bucket"]):
                out += compare(held)
                held = []
            if row is not None:
                held.append(row)
            if out and (row is None or len(out) >= 500):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["block", "bucket", "answer"])
                out = []

    rows = sent.repartition(parts, "bucket").sortWithinPartitions("bucket").select("block", "bucket", "sent")
    return rows.mapInArrow(run, "block string, bucket long, answer binary")


def _and_none(rows: Iterator[dict]) -> Iterator[dict | None]:
    yield from rows
    yield None


def answered(table: DataFrame, got: DataFrame, name: str) -> DataFrame:
    """``table`` with all answers of a block in the column ``name``."""
    each = got.groupBy("block").agg(F.collect_list(F.struct("bucket", "answer")).alias(name))
    return table.join(each, "block", "left")
