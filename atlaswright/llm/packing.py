"""Sequence packing by shortest-pack-first over the length histogram.

Documents become token ids (a public byte-level BPE, then id 0) and are cut into pieces
of at most ``size`` ids. Only the histogram of piece lengths (at most ``size`` rows)
reaches the driver, where lengths are placed longest first into the pack with the most
room, counts of equal packs moving together. The resulting patterns are joined back to
the pieces by the rank of a piece among those of its length.

Edge cases: a null or empty text is one piece holding id 0; repeated rows are packed as
often as they occur; a null ``doc_id`` stays null; an empty table gives no rows. Columns
other than ``doc_id`` and ``text`` are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import functools
import heapq
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SIZE = 1024

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: The pattern of the tokenizer without its two alternatives for runs of white space.
_LONE = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
#: White space other than the space and the line feed.
_OTHER = re.compile(r"[^\S \n]")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Text to the little-endian uint32 ids of the byte-level BPE.

    Runs the rank file's BPE, which gives the ids of its tokenizers file. Where no two
    white-space characters meet, the pattern needs no look-ahead, and the form without
    it, which cuts alike there, is much faster."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        special = {"<|endoftext|>": len(ranks)}
        self._bpe = tiktoken.Encoding("any", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self._lone = tiktoken.Encoding("lone", pat_str=_LONE, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary

    def __call__(self, text: str) -> bytes:
        if "<|endoftext|>" in text:
            ids = self._bpe.encode(text, allowed_special="all")
        elif "  " in text or " \n" in text or "\n " in text or "\n\n" in text or _OTHER.search(text):
            ids = self._bpe.encode_ordinary(text)
        else:
            ids = self._lone(text)
        return array("I", ids).tobytes()


@functools.cache
def encoder(path: str) -> Encoder:
    """One per Python worker, kept from task to task."""
    return Encoder(path)


def pieces(docs: DataFrame, size: int = SIZE, path: str | None = None) -> DataFrame:
    """Rows ``(doc_id, start, length, ids_crc32, doc_tokens)``: every document's ids cut
    at multiples of ``size``."""
    path = path or tokenizer_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = (encode(text) if text else b"") + b"\0\0\0\0"
                n = len(ids) // 4
                rows += [(doc_id, at, min(size, n - at), zlib.crc32(ids[4 * at : 4 * (at + size)]), n) for at in range(0, n, size)]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _PIECES)


def shortest_pack_first(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns and how many sequences follow each.

    Lengths go longest first into the open pack with the least in it, if it fits there
    (else it fits nowhere); a pack's count is split when fewer pieces are left."""
    open_: list[tuple[int, tuple[int, ...], int]] = []  # (sum, pattern, count): least sum first
    done: list[tuple[tuple[int, ...], int]] = []
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if open_ and open_[0][0] + length <= size:
                total, pattern, n = heapq.heappop(open_)
                use = min(n, left)
                if n > use:
                    heapq.heappush(open_, (total, pattern, n - use))
                left -= use
                opened = [(total + length, (*pattern, length), use)]
            else:  # the pack just opened is the one with least in it, until it is full
                most = size // length
                full, rest = divmod(left, most)
                opened = [(m * length, (length,) * m, n) for m, n in ((most, full), (rest, 1)) if m and n]
                left = 0
            for item in opened:
                if item[0] < size:
                    heapq.heappush(open_, item)
                else:
                    done.append(item[1:])
    return done + [(p, n) for _, p, n in sorted(open_)]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """For each place of a pattern: (length, first rank, sequence of that rank, offset),
    sorted by length and rank; ranks of a length run on from place to place."""
    taken: dict[int, int] = {}
    out, base = [], 0
    for pattern, n in patterns:
        offset = 0
        for length in pattern:
            out.append((length, taken.get(length, 0), base, offset))
            taken[length] = taken.get(length, 0) + n
            offset += length
        base += n
    out.sort()
    return tuple(np.array(c, np.int64) for c in (zip(*out, strict=True) if out else [[]] * 4))


def ranked(rows: DataFrame, buckets: int) -> DataFrame:
    """``rows`` with ``rank`` from 0 among the rows of a length, in two levels: inside a
    hash bucket by a window, buckets by a running sum over their counts, so that no
    length has to be sorted in one task."""
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    counts = rows.groupBy("length", "bucket").count()
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("skip"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    return rows.withColumn("place", F.row_number().over(inside)).join(counts, ["length", "bucket"]).withColumn("rank", F.col("skip") + F.col("place") - 1).drop("bucket", "skip", "place")


def pack(docs: DataFrame, size: int = SIZE, path: str | None = None, buckets: int | None = None) -> DataFrame:
    """One row per piece with its ``sequence_id`` and ``offset``; each sequence is filled
    gaplessly from 0 to at most ``size`` ids."""
    spark = docs.sparkSession
    buckets = buckets or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cutting = cut(pieces(docs, size, path))
    counts = {r[0]: r[1] for r in cutting.groupBy("length").count().collect()}  # at most ``size`` rows
    lengths, ranks, bases, offsets = slots(shortest_pack_first(counts, size))
    keys = lengths * (1 << 42) + ranks

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, length * (1 << 42) + rank, "right") - 1
            found = [pa.array(bases[at] + rank - ranks[at]), pa.array(offsets[at])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *found], [*batch.schema.names[:5], "sequence_id", "offset"])

    columns = [c.split()[0] for c in _PIECES.split(", ")]
    return ranked(cutting, buckets).select(*columns, "rank").mapInArrow(place, _PIECES + ", sequence_id long, offset long")
