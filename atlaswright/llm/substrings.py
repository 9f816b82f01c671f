"""Exact substring dedup: bytes of 50-byte strings that an earlier document also has.

Every 50-byte window has one *anchor*, the 24-byte string in it of the least hash, so that
equal windows have equal anchors. Three passes over blocks of documents:

1. Each block's distinct anchors go, four bytes each, to the bucket of their hash, which
   answers two bits for each: whether another block (or another document of the block) has it, and whether more than ``HOT`` blocks do.
2. Of the shared anchors' surroundings (the union of the windows that belong to one
   anchor), a block sends each different one once, with the least document that holds it.
   A bucket finds all equal 50-byte windows among its surroundings with a Burrows-Wheeler
   transform: intervals of equal prefixes are extended backwards, breadth first, which
   yields common-prefix lengths by increasing value; at the window length it stops, and the
   boundaries found so far part the windows into classes. The answer is a bit per window:
   whether a lesser document has it. The windows of an anchor that very many blocks have are told apart further: by the ``SIDE`` bytes before the anchor
   where a window has so many there, else by those behind it, so that equal windows still meet, but not all of an anchor's.
3. The block marks the bytes of those windows, and of the windows whose surroundings an
   earlier document of the block shares.

So a string of any number of copies is sent once per block and pass, and no task sees more
than its block or bucket.

Matches are on UTF-8 bytes. Edge cases: null and empty texts have no windows and are kept
as they are; documents of under 50 bytes neither lose nor take anything; rows without
``doc_id`` are left out; rows that repeat a ``doc_id`` do not take from each other (neither
id is smaller); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks, hashing
from .common import cut

LENGTH = 50
ANCHOR = 24
#: A window has so many bytes before its anchor, or else behind it.
SIDE = (LENGTH - ANCHOR) // 2
#: Blocks that may share an anchor before its windows are told apart by the bytes at its side.
HOT = 100


class Block:
    """Documents of a block as one byte array, with the anchors of their windows."""

    def __init__(self, ids: np.ndarray, texts: bytes, sizes: np.ndarray, length: int = LENGTH):
        self.ids, self.sizes, self.raw, self.length = ids, sizes, texts, length
        self.stops = np.cumsum(sizes)
        self.starts = self.stops - sizes
        x = np.frombuffer(texts, np.uint8)
        self.first = self.last = self.at = self.doc = np.zeros(0, np.int64)
        self.hash = np.zeros(0, np.uint64)
        if len(x) < length:
            return
        h = hashing.of_length(x, ANCHOR)
        # the least hash, leftmost of equals, among the anchors of a window
        key = h & np.uint64(0xFFFFFFFF00000000)
        key |= np.arange(len(h), dtype=np.uint64)
        span, width = length - ANCHOR + 1, 1
        while width * 2 <= span:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        if width < span:
            key = np.minimum(key[: width - span], key[span - width :])
        anchor = key.view(np.uint32)[::2] if np.little_endian else key.astype(np.uint32)
        inside = np.ones(len(anchor), bool)  # windows that end in the document they start in
        for a, b in zip(np.maximum(self.starts, self.stops - length + 1).tolist(), self.stops.tolist(), strict=True):
            inside[a:b] = False
        change = anchor[1:] != anchor[:-1]
        first, last = inside.copy(), inside.copy()
        first[1:] &= change | ~inside[:-1]
        last[:-1] &= change | ~inside[1:]
        # windows ``first .. last`` of document ``doc`` belong to the anchor at ``at``
        self.first, self.last = np.flatnonzero(first), np.flatnonzero(last)
        self.at, self.doc = anchor[self.first].astype(np.int64), np.searchsorted(self.stops, self.first, "right")
        self.hash = h[self.at]

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct anchor hashes, which of them two documents have, and each anchor's number among them."""
        values, number = np.unique(self.hash, return_inverse=True)
        low = np.full(len(values), len(self.ids))
        high = np.full(len(values), -1)
        np.minimum.at(low, number, self.doc)
        np.maximum.at(high, number, self.doc)
        return values, low < high, number

    def pieces(self, flags: np.ndarray, hot: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the anchors flagged: runs ``first .. last`` of windows, the document of each, and the hash they meet under. Those of a hot anchor are
        parted where the bytes before it become too few."""
        pick = np.flatnonzero(flags[number])
        first, last, doc, key = self.first[pick], self.last[pick], self.doc[pick], self.hash[pick]
        often = hot[number[pick]]
        if not often.any():
            return first, last, doc, key
        x, at = np.frombuffer(self.raw, np.uint8), self.at[pick]
        out = [(first[~often], last[~often], doc[~often], key[~often])]
        for before in (True, False):
            lo, hi = (first, np.minimum(last, at - SIDE)) if before else (np.maximum(first, at - SIDE + 1), last)
            some = np.flatnonzero(often & (lo <= hi))
            side = at[some] - SIDE if before else at[some] + ANCHOR
            out.append((lo[some], hi[some], doc[some], hashing.mixed(key[some] * np.uint64(hashing.BASE) + hashing.of_ranges(x, side, side + SIDE) + np.uint64(before))))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def shared(self, flags: np.ndarray, hot: np.ndarray, number: np.ndarray) -> tuple[list[bytes], np.ndarray, tuple[np.ndarray, ...], np.ndarray]:
        """The different texts of the ``pieces``, the least id that has each, the pieces, and
        the number of each one's text."""
        pieces = first, last, doc, _ = self.pieces(flags, hot, number)
        raw, known = self.raw, {}
        of = np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(first.tolist(), (last + self.length).tolist(), strict=True)], np.int64)
        least = np.full(len(known), np.iinfo(np.int64).max)
        np.minimum.at(least, of, self.ids[doc])
        return list(known), least, pieces, of

    def digests(self, removed: np.ndarray) -> Iterator[tuple]:
        """``(n_removed, n_spans, kept_sha256)`` of each document; ``removed`` flags bytes."""
        x = np.frombuffer(self.raw, np.uint8)
        for a, b in zip(self.starts.tolist(), self.stops.tolist(), strict=True):
            gone = removed[a:b]
            n = int(gone.sum())
            kept = self.raw[a:b] if not n else x[a:b][~gone].tobytes()
            spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            yield n, spans, hashlib.sha256(kept).hexdigest()


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``text`` by the ``depth`` bytes that follow, and their ranks, by doubling."""
    n = len(text)
    padded = np.r_[text.astype(np.uint64), np.zeros(8, np.uint64)]
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = key << np.uint64(8) | padded[k : k + n]
    reach = min(8, depth)
    if depth < 8:
        key >>= np.uint64(8 * (8 - depth))
    while True:
        order = np.argsort(key)
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[0, sorted_key[1:] != sorted_key[:-1]])
        if reach >= depth:
            return order, rank
        step = min(reach, depth - reach)
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = (rank * (n + 2) + after).astype(np.uint64)
        reach += step


def window_classes(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """``(order, begins)``: places of ``text`` in suffix order, and where in it a new class of
    places with equal next ``length`` bytes begins.

    The common prefix of neighbours in suffix order gets its value when an interval of
    suffixes with a common prefix is first seen to end between them. Intervals are extended
    backwards by the letters that precede their suffixes (their part of the transform),
    level by level, and only those that found a new boundary go on; after ``length`` levels
    every boundary that is not set yet lies inside a class."""
    n = len(text)
    order, _ = suffix_order(text, length)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    before = text[order - 1].astype(np.int64)  # the transform; the text closes on itself
    back = place[order - 1]  # where the suffix that starts one byte earlier stands
    begins = np.zeros(n + 1, bool)
    begins[0] = begins[n] = True
    left, right = np.array([0]), np.array([n])
    for _level in range(length):
        width = right - left
        own = np.repeat(np.arange(len(left)), width)
        at = np.arange(len(own)) + np.repeat(left - (np.cumsum(width) - width), width)
        to = back[at]
        label = own * 256 + before[at]
        o = np.argsort(to)
        to, label = to[o], label[o]
        # extensions are runs of neighbours that come from one interval by one letter
        end = np.flatnonzero(np.r_[label[1:] != label[:-1], True])
        stop = to[end] + 1
        start = to[np.r_[0, end[:-1] + 1]]
        new = ~begins[stop]
        begins[stop] = True
        left, right = start[new], stop[new]
        if not len(left):
            break
    return order, begins[:n]


def least_owner(strings: list[bytes], owner: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For every window of every string, one after another: the least owner of a string that has it."""
    sizes = np.array([len(s) for s in strings])
    # a byte that UTF-8 does not have parts the strings
    text = np.frombuffer(b"\xff".join(strings) + b"\xff", np.uint8)
    starts = np.cumsum(sizes + 1) - sizes - 1
    windows = sizes - length + 1
    at = np.arange(int(windows.sum())) + np.repeat(starts - (np.cumsum(windows) - windows), windows)
    who = np.full(len(text), np.iinfo(np.int64).max)
    who[at] = np.repeat(owner, windows)
    order, begins = window_classes(text, length)
    first = np.flatnonzero(begins)
    least = np.minimum.reduceat(who[order], first)
    out = np.empty(len(text), np.int64)
    out[order] = np.repeat(least, np.diff(np.r_[first, len(text)]))
    return out[at]


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8), count=n).astype(bool)


def _opened(row: dict) -> Block:
    ids, sizes, raw = blocks.opened(row)
    return Block(ids, raw, sizes)


def _shared_flags(block: Block, answers: list[dict] | None, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which distinct anchors are shared, which are hot, and each anchor's number."""
    values, flags, number = block.distinct()
    hot = np.zeros(len(flags), bool)
    order, bucket, _ = blocks.by_bucket(values, buckets)
    of = {a["bucket"]: a["answer"] for a in answers or []}
    for b, lo, hi in blocks.runs(bucket):
        n = hi - lo
        flags[order[lo:hi]] |= _flags(of[b], n)
        hot[order[lo:hi]] = _flags(of[b][-(-n // 8) :], n)
    return flags, hot, number


def remove(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Rows ``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)``."""
    spark = docs.sparkSession
    table = cut(blocks.blocks(docs))
    n_blocks = table.count()
    buckets = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_blocks)

    def send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in blocks.rows_of(batches):
            values, _, _ = _opened(row).distinct()
            _, bucket, rest = blocks.by_bucket(values, buckets)
            out = [(row["block"], b, rest[lo:hi].tobytes()) for b, lo, hi in blocks.runs(bucket)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["block", "bucket", "sent"])

    def compare_anchors(rows: list[dict]) -> list[tuple]:
        sent = [np.frombuffer(r["sent"], np.uint32) for r in rows]
        values, number, counts = np.unique(np.concatenate(sent), return_inverse=True, return_counts=True)
        flags, hot = counts[number] > 1, counts[number] > HOT
        ends = np.cumsum([0, *map(len, sent)])
        return [(r["block"], r["bucket"], _bits(flags[a:b]) + _bits(hot[a:b])) for r, a, b in zip(rows, ends[:-1], ends[1:], strict=True)]

    def send_surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in blocks.rows_of(batches):
            block = _opened(row)
            strings, least, pieces, of = block.shared(*_shared_flags(block, row["anchors"], buckets))
            hashes = np.zeros(len(strings), np.uint64)
            hashes[of] = pieces[3]
            order, bucket, rest = blocks.by_bucket(hashes, buckets)
            out = []
            for b, lo, hi in blocks.runs(bucket):
                chosen = [strings[k] for k in order[lo:hi].tolist()]
                out.append((row["block"], b, blocks.pack(np.array([hi - lo], np.int64), least[order[lo:hi]], rest[lo:hi], np.array([len(s) for s in chosen], np.uint32), np.frombuffer(b"".join(chosen), np.uint8))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["block", "bucket", "sent"])

    def compare_surroundings(rows: list[dict]) -> list[tuple]:
        known: dict[bytes, int] = {}
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        groups = []
        for r in rows:
            raw = blocks.unpack(r["sent"])
            n = int(np.frombuffer(raw, np.int64, 1)[0])
            least = np.frombuffer(raw, np.int64, n, 8)
            rest = np.frombuffer(raw, np.uint32, n, 8 + 8 * n)
            sizes = np.frombuffer(raw, np.uint32, n, 8 + 12 * n)
            stops = (8 + 16 * n + np.cumsum(sizes.astype(np.int64))).tolist()
            of = np.array([known.setdefault(raw[b - a : b], len(known)) for a, b in zip(sizes.tolist(), stops, strict=True)], np.int64)
            parts.append((least, of))
            groups.append(rest)
        strings = list(known)
        number = np.concatenate([of for _, of in parts])
        owner = np.full(len(strings), np.iinfo(np.int64).max)
        np.minimum.at(owner, number, np.concatenate([x for x, _ in parts]))
        group = np.zeros(len(strings), np.uint32)
        group[number] = np.concatenate(groups)
        # an anchor with one kind of surroundings has nothing to compare
        _, same, times = np.unique(group, return_inverse=True, return_counts=True)
        many = np.flatnonzero(times[same] > 1)
        width = LENGTH - ANCHOR + 1
        found = np.repeat(owner[:, None], width, 1)
        if len(many):
            chosen = [strings[k] for k in many.tolist()]
            windows = np.array([len(s) for s in chosen]) - LENGTH + 1
            row = np.repeat(many, windows)
            column = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
            found[row, column] = least_owner(chosen, owner[many])
        return [(r["block"], r["bucket"], blocks.pack(np.packbits(found[of] < least[:, None], axis=1))) for r, (least, of) in zip(rows, parts, strict=True)]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = LENGTH - ANCHOR + 1
        for row in blocks.rows_of(batches):
            block = _opened(row)
            removed = np.zeros(len(block.raw) + 1, np.int32)
            strings, least, (first, last, doc, key), of = block.shared(*_shared_flags(block, row["anchors"], buckets))
            if len(strings):
                hashes = np.zeros(len(strings), np.uint64)
                hashes[of] = key
                order, bucket, _ = blocks.by_bucket(hashes, buckets)
                lesser = np.zeros((len(strings), width), bool)
                answers = {a["bucket"]: a["answer"] for a in row["windows"] or []}
                for b, lo, hi in blocks.runs(bucket):
                    got = np.frombuffer(blocks.unpack(answers[b]), np.uint8).reshape(hi - lo, -1)
                    lesser[order[lo:hi]] = np.unpackbits(got, axis=1, count=width)
                gone = lesser[of] | (block.ids[doc] > least[of])[:, None]
                windows = last - first + 1
                gone &= np.arange(width)[None] < windows[:, None]
                k, shift = np.nonzero(gone)
                start = first[k] + shift
                np.add.at(removed, start, 1)
                np.add.at(removed, start + LENGTH, -1)
            digests = list(block.digests(np.cumsum(removed[:-1]) > 0))
            columns = [pa.array(c) for c in zip(*digests, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(block.ids), pa.array(block.sizes), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    anchors = blocks.answers(table.mapInArrow(send_anchors, blocks.SENT), buckets, compare_anchors)
    known = cut(blocks.answered(table.select("block"), anchors, "anchors"))
    full = table.join(known, "block")
    windows = blocks.answers(full.mapInArrow(send_surroundings, blocks.SENT), buckets, compare_surroundings)
    done = blocks.answered(full, windows, "windows")
    return done.mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
