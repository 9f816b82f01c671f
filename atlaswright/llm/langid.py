"""Language identification by cross-parsing against suffix automata of labelled text.

For every language, pieces of labelled training documents, ``SAMPLE_BYTES`` bytes together
(or, of more than six languages, an even share of ``ALL_BYTES``: at least 1,600 bytes), are strung into one text whose
suffix automaton accepts exactly its substrings. Documents of any length take part in the
order of their hashes, each with a piece (of up to a ``SAMPLE_DOCS``-th of these bytes) from
a hashed place of its text; further pieces of the same documents follow only where that
does not fill the bytes. A document is parsed against each automaton into longest matches,
every phrase ending where no transition goes on; the language with the fewest phrases,
weighted by the bits that name a place in its training text, wins. NumPy moves all segments
of ``SEGMENT`` bytes of a batch one byte at a time, each as if a phrase began with it; then
every segment is entered again in the state in which the one before it ends, until that
makes no difference, so the phrases are those of the whole text.

Edge cases: null text, or text without a letter, is ``und`` with score 0; ties go to the
language first in the alphabet; labels that are null are not learned; where
there are more than ``MOST_LABELS`` labels, those of the most training texts are learned as languages (of equals the first
in the alphabet), as the bytes of all automata are bounded; the others are never predicted; without any learned language everything
is ``und``; very long texts are parsed whole; repeated rows give repeated rows; an empty table
gives none. Only ``doc_id``, ``text`` and, for learning, ``lang`` are read.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_DOCS = 60
SAMPLE_BYTES = 60_000
#: Bytes that all automata are built from: what bounds their tables, which go to every task.
ALL_BYTES = 400_000
MOST_LABELS = 250
SEGMENT = 512
_ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str | None) -> bool:
    return bool(text) and (_ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def folded(text: str) -> bytes:
    """Lower-cased UTF-8 with every run of white space and digits made one blank."""
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_BLANK).split())


_BLANK = bytes(32 if chr(b).isspace() and b < 128 or 48 <= b <= 57 else b for b in range(256))


class Automaton:
    """The suffix automaton of a text as one transition table: ``table[state, symbol]``,
    where -1 means no transition. Symbols are the text's distinct bytes and, last, one for
    all others."""

    def __init__(self, text: bytes):
        symbols = sorted(set(text))
        self.symbol = np.full(256, len(symbols), np.int64)
        self.symbol[symbols] = range(len(symbols))
        width = len(symbols) + 1
        nexts: list[dict[int, int]] = [{}]
        links, lengths, last = [-1], [0], 0
        for b in text:
            cur = len(nexts)
            nexts.append({})
            lengths.append(lengths[last] + 1)
            links.append(0)
            p = last
            while p >= 0 and b not in nexts[p]:
                nexts[p][b] = cur
                p = links[p]
            if p >= 0:
                q = nexts[p][b]
                if lengths[q] == lengths[p] + 1:
                    links[cur] = q
                else:
                    copy = len(nexts)
                    nexts.append(dict(nexts[q]))
                    lengths.append(lengths[p] + 1)
                    links.append(links[q])
                    while p >= 0 and nexts[p].get(b) == q:
                        nexts[p][b] = copy
                        p = links[p]
                    links[q] = links[cur] = copy
            last = cur
        table = np.full((len(nexts), width), -1, np.int32)
        for s, out in enumerate(nexts):
            if out:
                table[s, self.symbol[list(out)]] = list(out.values())
        self.width, self.bits = width, float(np.log2(len(text) + 2))
        self.table = np.where(table < 0, -1, table * width).ravel()  # states are row offsets

    def _step(self, state: np.ndarray, symbols: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The states after one more byte each; ``count`` grows by the phrases that end."""
        to = self.table[state + symbols]
        stuck = np.flatnonzero(to < 0)
        if len(stuck):
            # a phrase ends before this byte, unless it is empty: then the byte is one itself
            fresh = self.table[symbols[stuck]]
            count[stuck] += (state[stuck] > 0) + (fresh < 0).astype(np.int32)
            to[stuck] = np.maximum(fresh, 0)
        return to

    def phrases(self, block: np.ndarray, lengths: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Phrases of each row of ``block`` (rows by falling ``lengths``), the first ``lengths``
        bytes of it; where ``before`` names a row rather than -1, the text goes on from that."""
        size = block.shape[1]
        symbols = self.symbol.astype(np.int32)[block.T]  # one row per byte position
        live = np.searchsorted(-lengths, -np.arange(size), "left")  # rows longer than the position
        states, counts = np.zeros((size, len(lengths)), np.int32), np.zeros((size, len(lengths)), np.int32)
        state, count = np.zeros(len(lengths), np.int32), np.zeros(len(lengths), np.int32)
        for at in range(size):
            n = live[at]
            if not n:
                break
            state[:n] = self._step(state[:n], symbols[at, :n], count[:n])
            states[at], counts[at] = state, count
        alone = count.copy()  # phrases that end in a row entered at the start of a phrase
        after = np.full(len(lengths), -1)
        after[before[before >= 0]] = np.flatnonzero(before >= 0)
        todo = np.flatnonzero(before >= 0)
        while len(todo):
            now, ended = state[before[todo]], np.zeros(len(todo), np.int32)
            rows, which = todo, np.arange(len(todo))
            end, total = states[lengths[todo] - 1, todo], alone[todo]
            for at in range(size):
                on = lengths[rows] > at
                if not on.all():  # rows that end without meeting their first parse
                    end[which[~on]], total[which[~on]] = now[~on], ended[~on]
                    now, ended, rows, which = now[on], ended[on], rows[on], which[on]
                now = self._step(now, symbols[at, rows], ended)
                met = now == states[at, rows]
                if met.any():
                    total[which[met]] = ended[met] + alone[rows[met]] - counts[at, rows[met]]
                    now, ended, rows, which = now[~met], ended[~met], rows[~met], which[~met]
                if not len(rows):
                    break
            end[which], total[which] = now, ended
            other = end != state[todo]
            state[todo], count[todo] = end, total
            todo = after[todo[other]]  # those were entered in another state
            todo = todo[todo >= 0]
        return count + ((after < 0) & (state > 0))


def fit(sample: list[tuple[str, bytes]]) -> dict[str, Automaton]:
    texts: dict[str, list[bytes]] = {}
    for lang, text in sample:
        texts.setdefault(lang, []).append(text)
    return {lang: Automaton(b"\0".join(texts[lang])[: bytes_each(len(texts))]) for lang in sorted(texts)}


def bytes_each(labels: int) -> int:
    return min(SAMPLE_BYTES, ALL_BYTES // max(1, labels))


def rates(models: dict[str, Automaton], texts: list[bytes]) -> np.ndarray:
    """``(text, language)``: bits a byte of the parse; texts must not be empty."""
    owner = np.repeat(np.arange(len(texts)), [-(-len(t) // SEGMENT) for t in texts])
    parts = [t[a : a + SEGMENT] for t in texts for a in range(0, len(t), SEGMENT)]
    lengths = np.array([len(p) for p in parts])
    order = np.argsort(-lengths, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    goes_on = np.r_[False, owner[1:] == owner[:-1]]
    before = np.where(goes_on, np.r_[-1, place[:-1]], -1)[order]
    block = np.frombuffer(b"".join(parts[k].ljust(SEGMENT, b"\0") for k in order), np.uint8).reshape(-1, SEGMENT)
    size = np.array([len(t) for t in texts])
    out = np.zeros((len(texts), len(models)))
    for k, m in enumerate(models.values()):
        out[:, k] = np.bincount(owner[order], m.phrases(block, lengths[order], before), len(texts)) * m.bits / size
    return out


def _groups(texts: dict[int, bytes], most: int = 8_000_000) -> Iterator[list[int]]:
    """Keys by and by, each group of about ``most`` bytes."""
    group, size = [], 0
    for k, t in texts.items():
        if group and size + len(t) > most:
            yield group
            group, size = [], 0
        group.append(k)
        size += len(t)
    if group:
        yield group


def is_held_out(doc_id: Column, mod: int = 3, remainder: int = 1) -> Column:
    """Whether crc32 of the id's text, modulo ``mod``, is ``remainder``; null counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(mod)) == remainder


class _Sample:
    """Of each language the pieces of the smallest ``(draw, hash)`` that fill ``most`` bytes."""

    def __init__(self, most: int):
        self.most = most
        self.kept: dict[str, list[tuple[int, int, bytes]]] = {}  # heaps, the largest key first
        self.size: dict[str, int] = {}

    def wants(self, lang: str, draw: int, h: int) -> bool:
        return self.size.get(lang, 0) < self.most or (-draw, -h) > self.kept[lang][0][:2]

    def add(self, lang: str, draw: int, h: int, piece: bytes) -> None:
        heap = self.kept.setdefault(lang, [])
        heapq.heappush(heap, (-draw, -h, piece))
        size = self.size.get(lang, 0) + len(piece) + 1  # a zero byte between pieces
        while size - len(heap[0][2]) - 1 >= self.most:
            size -= len(heapq.heappop(heap)[2]) + 1
        self.size[lang] = size

    def rows(self) -> pa.RecordBatch:
        out = [(lang, -d, -h, piece) for lang, heap in self.kept.items() for d, h, piece in heap]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int64(), pa.binary()))], ["lang", "draw", "h", "piece"])


def training_sample(docs: DataFrame, per_lang: int = SAMPLE_DOCS) -> list[tuple[str, bytes]]:
    """Folded pieces of each label's training texts, of at most a
    ``per_lang``-th of a label's bytes each, until they fill those or the texts end: a bounded
    sample, the same for the same rows. A text's pieces are drawn from a hashed one on."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null")
    rows = rows.where(~is_held_out(F.col("doc_id"))).select("lang", F.xxhash64("doc_id", "text").alias("h"), "text")
    counts = rows.groupBy("lang").count()
    labels = [r["lang"] for r in counts.orderBy(F.desc("count"), "lang").limit(MOST_LABELS).collect()]
    rows = rows.where(F.col("lang").isin(labels)) if len(labels) == MOST_LABELS else rows
    most = bytes_each(len(labels))
    each = max(1, most // per_lang)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = _Sample(most)
        for batch in batches:
            texts = batch.column(2)
            for k, (lang, h) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if not sample.wants(lang, 0, h):
                    continue
                raw = folded(texts[k].as_py())
                pieces = -(-len(raw) // each)
                for turn in range(pieces):
                    if not sample.wants(lang, turn, h):
                        break
                    # not the order's hash itself, of which the sample holds the smallest
                    at = (zlib.crc32(str(h).encode()) + turn) % pieces * each
                    sample.add(lang, turn, h, raw[at : at + each])
        yield sample.rows()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = _Sample(most)
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sample.wants(*row[:3]):
                    sample.add(*row)
        yield sample.rows()

    # every task of the scan sends a full sample at most, and so does every share of a label's rows
    schema = "lang string, draw int, h long, piece binary"
    parts = rows.mapInArrow(draw, schema).repartition("lang", F.pmod("h", F.lit(16))).mapInArrow(merge, schema)
    got = parts.repartition("lang").mapInArrow(merge, schema).collect()
    return [(r["lang"], bytes(r["piece"])) for r in sorted(got, key=lambda r: (r["lang"], r["draw"], r["h"], bytes(r["piece"])))]


def identify(docs: DataFrame, models: dict[str, Automaton], keep: list[str] = ()) -> DataFrame:
    """``docs`` rows ``(doc_id, *keep, lang_pred, score, bits_per_byte)``; ``score`` is the
    share of the winner when languages weigh in by the inverse 8th power of their bits."""
    schema = docs.select("doc_id", *keep).schema
    names = list(models)
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(models)  # tables of a bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                yield predict(models, batch.slice(at, 2048))

    def predict(models, part: pa.RecordBatch) -> pa.RecordBatch:
        lang, score, bits = ["und"] * part.num_rows, np.zeros(part.num_rows), np.zeros(part.num_rows)
        column = part.column(part.num_columns - 1).to_pylist()
        texts = {k: b for k, t in enumerate(column) if models and has_letter(t) and (b := folded(t))}
        for group in _groups(texts):
            r = np.maximum(rates(models, [texts[g] for g in group]), 1e-9)
            best = r.argmin(1)
            low = r[np.arange(len(group)), best]
            share = 1 / ((low[:, None] / r) ** 8).sum(1)
            for g, b, s, x in zip(group, best, share, low, strict=True):
                lang[g], score[g], bits[g] = names[b], s, x
        return pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(lang), pa.array(score), pa.array(bits)], [*schema.names, "lang_pred", "score", "bits_per_byte"])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return docs.select("doc_id", *keep, F.col("text").cast("string").alias("__text")).mapInArrow(run, out + ", lang_pred string, score double, bits_per_byte double")


def accepted(docs: DataFrame, models: dict[str, Automaton]) -> DataFrame:
    """The rows of ``docs``, with their own columns, whose language is not ``und``."""
    names = {c: f"__{k}" for k, c in enumerate(docs.columns)}
    inner = docs.select("doc_id", "text", *(docs[c].alias(n) for c, n in names.items()))
    return identify(inner, models, list(names.values())).where("lang_pred <> 'und'").select(*(F.col(n).alias(c) for c, n in names.items()))
