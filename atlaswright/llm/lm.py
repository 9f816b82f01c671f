"""Language-model scores: a causal self-attention model over subword ids, trained in NumPy.

Tokens are lower-cased byte runs (words) and the end of a text. A word is, with a blank
before it, cut by the first ``SUBWORDS`` merges of a public byte-level BPE (words of more
than 64 bytes every 64 bytes); ``END`` is the id of the end.

A token attends to the tokens before it: its query, made of the first and last subword ids
of the token before it, meets the keys (of the same kind) of the places before it, with a
bias by distance. Each of those places votes for the token that stood there; one more slot,
with a logit by the same two ids and by how often their word was seen, votes for every token
as it is spelled: a first id after the last one, further ids, and the end of the word, by
the counts of how words begin (of the ``FREQUENT`` most frequent words of up to ``WORD_BYTES`` bytes,
which is the model's lexicon: its size is bounded, as it goes to every task),
backing off to pairs of ids, which all words are counted in. All slots are weighed together (by ``(1 + x/8)**8``, close to
``exp(x)`` and much cheaper) and mixed, so the probabilities of all tokens add to one. Texts
are scored in windows of two blocks of ``BLOCK`` tokens that overlap by one: the tokens of
the second block are scored, once each, with those of the first as context, in batches
under a mask that hides the place itself, later ones, and what lies before a text.

What follows the same ``MEMORY`` words anywhere in the training texts outweighs all that: a
token seen ``c`` of ``n`` times after the three words before it has the probability
``(c + w p) / (n + w)``, where ``p`` is the model's. These counts grow with the corpus; every
block of documents asks for those it needs by hash.

All counts, and the attention weights, learn from all training documents. Documents fall by
the hash of their id into ``CLASSES`` classes; each class is one step of gradient ascent
(Adam), its gradient summed over all its documents on the executors, so that the weights
do not depend on how the table is split. In training every token's own occurrence is taken
off the counts; in scoring a document that the counts hold, its own occurrence of a word, and all that the
document itself has put into the memory. Words are told apart by 64 bits of hash.

The counts of words come by the same messages: a block sends its different words, as ids, to
the buckets of their hashes, and gets back how often the training texts hold each. Every bucket also
names its most frequent words, from which the lexicon is made.

Edge cases: a null or empty text is its end alone; a null ``doc_id`` counts as empty text for
the split and stays null; repeated rows are scored as often as they occur and learned from
as often; very long texts are scored in as many windows as it takes; an empty table, or one
without training rows, has zero counts: every score is then finite, from the uniform model.
Columns other than ``doc_id`` and ``text`` are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import functools
import itertools
import math
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, hashing
from .blocks import pack, unpack
from .common import crc_mod, cut, shared_path, tidy, words_of
from .packing import tokenizer_file

SUBWORDS = 1023
VOCAB = SUBWORDS + 1
END = SUBWORDS
BLOCK = 16
WIDTH = 8
HELD_OUT = (7, 2)
CLASSES = 24
FREQUENT = 200_000
WORD_BYTES = 48
BATCH = 512  # blocks
MEMORY = 3  # words
MEMORY_WEIGHT = 0.25
#: Packed bytes of blocks whose contexts, on average, one bucket compares.
BUCKET_BYTES = 4_000_000
#: Packed bytes of a class that a task trains on; every task reads its pages from many files.
STEP_BYTES = 1_000_000
#: Parts in which counts of pairs travel, and tasks that add up gradients.
RANGES = 8


class Subwords:
    """Words to runs of subword ids, each distinct word cut once while it is remembered."""

    LIMIT = 200_000

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {t: r for a, b in map(bytes.split, f) if (r := int(b)) < SUBWORDS for t in [base64.b64decode(a)]}
        self._cut = tiktoken.Encoding("subwords", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.bytes = np.zeros(VOCAB, np.int64)  # that an id stands for
        self.bytes[list(ranks.values())] = list(map(len, ranks))
        self.starts = np.zeros(VOCAB, bool)  # ids that begin a word, or end a text
        self.starts[[r for t, r in ranks.items() if t[:1] == b" "] + [END]] = True
        self._forget()

    def _forget(self) -> None:
        self._known = _Numbers(self)
        self._flat, self._ends = array("H"), array("q", [0])

    def add(self, word: bytes) -> int:
        if len(word) <= 64:
            self._flat.extend(self._cut(b" " + word))
        else:  # the merge loop's cost grows with the square of a word
            for at in range(0, len(word), 64):
                self._flat.extend(self._cut(b" " + word[:64] if not at else word[at : at + 64]))
        self._ends.append(len(self._flat))
        return len(self._ends) - 2

    def numbers(self, ws: Iterable[bytes]) -> np.ndarray:
        """The words' numbers, good for ``arrays()`` as it is now; with more
        than ``LIMIT`` words known, the memory starts anew first."""
        if len(self._known) > self.LIMIT:
            self._forget()
        return np.fromiter(map(self._known.__getitem__, ws), np.int64)

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the known words, strung together, and where each one's start and end."""
        return np.array(self._flat, np.uint16), np.array(self._ends, np.int64)


class _Numbers(dict):
    def __init__(self, owner: Subwords):
        self.owner = owner

    def __missing__(self, word: bytes) -> int:
        n = self[word] = self.owner.add(word)
        return n


@functools.cache
def subwords(path: str) -> Subwords:
    return Subwords(path)


def strung(flat: np.ndarray, ends: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of ``some`` of the words, strung together, and how many each has."""
    size = ends[some + 1] - ends[some]
    at = np.repeat(ends[some] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    return flat[at], size


class Texts:
    """Texts as tokens: ``lengths`` counts each one's words, ``token`` says of every token (the
    words and the ``end`` of one text after another) which of the different words it is; of those
    there are the ids strung together in ``flat``, where they start and end (``ends``), the hashes of
    their beginnings in ``begun``, and of the whole words in ``hashes``."""

    def __init__(self, lengths: np.ndarray, which: np.ndarray, flat: np.ndarray, ends: np.ndarray):
        self.lengths, self.which, self.flat, self.ends = lengths, which, flat, ends
        self.sizes = lengths + 1
        self.end = len(ends) - 1  # stands for the end of a text
        self.token = np.insert(which, np.cumsum(lengths), self.end)

    @functools.cached_property
    def begun(self) -> np.ndarray:
        return beginnings(self.flat, self.ends)

    @functools.cached_property
    def hashes(self) -> np.ndarray:
        return closed(self.begun[self.ends[1:] - 1])

    @property
    def ids_of(self) -> np.ndarray:
        """How many ids each text has, with its end."""
        return np.bincount(np.repeat(np.arange(len(self.lengths)), self.lengths), np.diff(self.ends)[self.which], len(self.lengths)).astype(np.int64) + 1

    @staticmethod
    def of(numbers: np.ndarray, lengths: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> Texts:
        flat, ends = known
        used = np.zeros(len(ends) - 1, bool)
        used[numbers] = True
        mine, size = strung(flat, ends, np.flatnonzero(used))
        return Texts(lengths, (np.cumsum(used) - 1)[numbers], mine, np.r_[0, np.cumsum(size)])

    def packed(self) -> bytes:
        n = np.array([len(self.lengths), len(self.which), len(self.ends) - 1, len(self.flat)], np.int64)
        return pack(n, self.lengths.astype(np.uint32), self.which.astype(np.uint32), np.diff(self.ends).astype(np.uint32), self.flat)

    @staticmethod
    def unpacked(blob: bytes) -> Texts:
        raw, at, out = unpack(blob), 32, []
        for size, kind in zip(np.frombuffer(raw, np.int64, 4).tolist(), (np.uint32, np.uint32, np.uint32, np.uint16), strict=True):
            out.append(np.frombuffer(raw, kind, size, at))
            at += out[-1].nbytes
        lengths, which, sizes, flat = out
        return Texts(lengths.astype(np.int64), which.astype(np.int64), flat, np.r_[0, np.cumsum(sizes, dtype=np.int64)])


def cut_texts(texts: list[str | None], cutter: Subwords) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all words, and how many words each text has."""
    lengths = []

    def words() -> Iterator[list[bytes]]:
        for t in texts:  # one text's words at a time
            ws = words_of(t)
            lengths.append(len(ws))
            yield ws

    return cutter.numbers(itertools.chain.from_iterable(words())), np.array(lengths, np.int64)


# counts of words


def beginnings(flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of every beginning of words of ids, strung together; a word spans ``ends[k]`` to ``ends[k + 1]``."""
    up, down = hashing.powers(len(flat) + 1)
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum((flat.astype(np.uint64) * np.uint64(hashing.BASE) + np.uint64(1)) * up[: len(flat)], out=sums[1:])
    first = np.repeat(ends[:-1], np.diff(ends))
    return hashing.mixed((sums[1:] - sums[first]) * down[first])


def closed(h: np.ndarray) -> np.ndarray:
    """The hash of a whole word, by that of its ids as a beginning."""
    return hashing.mixed(h ^ np.uint64(hashing.BASE))


def whole(flat: np.ndarray, ends: np.ndarray, words: int = 50_000) -> np.ndarray:
    """The hashes of whole words, of so many at a time."""
    out = [np.zeros(0, np.uint64)]
    for k in range(0, len(ends) - 1, words):
        some = ends[k : k + words + 1]
        out.append(closed(beginnings(flat[some[0] : some[-1]], some - some[0])[some[1:] - some[0] - 1]))
    return np.concatenate(out)


class Counts:
    """How words are spelled: how often words begin with given ids (by the hash of those), and
    how often an id follows another in the texts."""

    WEIGHTS = np.float64(2), np.float64(8), np.float64(0.5)  # of what a count backs off to

    def __init__(self, pairs: np.ndarray, flat: np.ndarray, ends: np.ndarray, counts: np.ndarray, texts: int, starts: np.ndarray):
        h = beginnings(flat, ends)
        keys, at = np.unique(np.r_[h, closed(h[ends[1:] - 1])], return_inverse=True)
        self.bits = max(1, int(len(keys)).bit_length() + 1)
        self.table = np.searchsorted(keys, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits))
        self.table = np.r_[self.table, len(keys)].astype(np.int32)
        self.keys, self.counts = keys, np.bincount(at, np.r_[np.repeat(counts, np.diff(ends)), counts], len(keys))
        self.firsts = np.bincount(flat[ends[:-1]], counts, VOCAB)
        self.firsts[END] = texts
        self.starts, table = starts, pairs.reshape(VOCAB, VOCAB).astype(np.float64)
        self.alone, self.sums = table.sum(0), table.sum(1)
        a, b, c = self.WEIGHTS
        self.alone = (self.alone + c) / (self.alone.sum() + c * VOCAB)
        #: The next id after an id, a start of a word or not.
        self.pair = ((table + b * self.alone) / (self.sums + b)[:, None]).astype(np.float32)
        self.stop = self.pair[:, starts].sum(1, dtype=np.float64)
        #: Logs of the first id of a token after the last id of the one before.
        first = (self.firsts + c * starts) / (self.firsts + c * starts).sum()
        known = table[:, starts].sum(1)
        after = (np.where(starts, table, 0) + b * first) / (known + b)[:, None]
        with np.errstate(divide="ignore"):
            self.first = np.log(after).astype(np.float32).ravel()

    def _of(self, h: np.ndarray) -> np.ndarray:
        """The counts of hashes; those with the same first bits as a key lie together."""
        out = np.zeros(len(h))
        first = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at, stop = self.table[first], self.table[first + 1]
        left = np.flatnonzero(at < stop)
        while len(left):
            k = at[left]
            met = self.keys[k] == h[left]
            out[left[met]] = self.counts[k[met]]
            left = left[~met]
            at[left] += 1
            left = left[at[left] < stop[left]]
        return out

    def spelled(self, texts: Texts, own: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the different words, the log probability of all but the first id, and of the end
        after them, with ``own`` occurrences taken off; and how often the word was seen."""
        flat, ends = texts.flat, texts.ends
        if not len(flat):
            return np.zeros(0), np.zeros(0)
        begun, whole = self._of(texts.begun), self._of(texts.hashes)
        less = lambda x: np.maximum(x - own, 0)
        a = self.WEIGHTS[0]
        p = (less(begun[1:]) + a * self.pair[flat[:-1], flat[1:]]) / (less(begun[:-1]) + a)
        steps = np.r_[0.0, np.log(p)]
        steps[ends[:-1]] = 0
        last = ends[1:] - 1
        stop = (less(whole) + a * self.stop[flat[last]]) / (less(begun[last]) + a)
        return np.add.reduceat(steps, ends[:-1]) + np.log(stop), whole


# the model


class Blocks:
    """Tokens of texts in rows of ``BLOCK``: the ``target`` tokens, the token ``before`` each,
    the log probability ``spelled``, which targets are ``valid``, and which rows ``begin`` a text.
    Of the different tokens, ``first`` and ``last`` hold their ids, ``seen`` how well known they are."""

    def __init__(self, texts: Texts, counts: Counts, own: int = 0):
        sizes, token = texts.sizes, texts.token
        rest, seen = counts.spelled(texts, own)
        self.first = np.r_[texts.flat[texts.ends[:-1]], END].astype(np.int64)
        self.last = np.r_[texts.flat[texts.ends[1:] - 1], END].astype(np.int64)
        self.seen = (np.log1p(np.r_[seen, counts.firsts[END]]) / 10).astype(np.float32)
        before = np.r_[texts.end, token[:-1]]  # every text closes with an end
        spelled = np.r_[rest, 0.0][token] + counts.first[self.last[before] * VOCAB + self.first[token]]
        count = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(sizes)), count)
        first = np.cumsum(count) - count
        self.slot = np.arange(len(token)) + np.repeat(first * BLOCK - (np.cumsum(sizes) - sizes), sizes)

        def laid(values: np.ndarray, empty: float) -> np.ndarray:
            out = np.full(len(owner) * BLOCK, empty, values.dtype)
            out[self.slot] = values
            return out.reshape(-1, BLOCK)

        self.target, self.before = laid(token.astype(np.int32), -2), laid(before, texts.end)
        self.spelled = laid(spelled, 0.0)
        self.begins = np.zeros(len(owner), bool)
        self.begins[first] = True

    def batches(self, rows: int = BATCH) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
        """Runs of rows, each after the row before it, its context; and how many rows that is."""
        for at in range(0, len(self.begins), rows):
            lead = min(1, at)
            yield lead, {name: getattr(self, name)[at - lead : at + rows] for name in ("target", "before", "spelled", "begins")}


_BEFORE = np.arange(2 * BLOCK)[None] < np.arange(BLOCK)[:, None] + BLOCK
_COLUMNS = 2 * WIDTH + 1
#: By first and last id of the token before: query, key, and the logit of the spelled slot; by distance; by how well known that token is.
SHAPES = {"first": (VOCAB, _COLUMNS), "last": (VOCAB, _COLUMNS), "place": (BLOCK, 2 * BLOCK), "seen": (1,)}
LENGTH = sum(math.prod(s) for s in SHAPES.values())
_SCALE = np.float32(WIDTH**-0.5 / 8)
_LEAST = np.float32(0.05)
_ONES = np.ones(2 * BLOCK, np.float32)


def start() -> np.ndarray:
    """Weights at first: places after the same word attract."""
    rng = np.random.default_rng(11)
    flat = np.zeros(LENGTH, np.float32)
    for table in map(weights(flat).get, ("first", "last")):
        table[:, :WIDTH] = table[:, WIDTH : 2 * WIDTH] = rng.normal(0, 1.0, (VOCAB, WIDTH))
        table[:, 2 * WIDTH] = 4.0
    return flat


def weights(flat: np.ndarray) -> dict[str, np.ndarray]:
    """Views of the flat weight vector."""
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = math.prod(shape)
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def forward(w: dict[str, np.ndarray], rows: Blocks, part: dict[str, np.ndarray], lead: int, train: bool = False):
    """Natural-log probabilities of a batch's targets (of what is no token, 0); in training, the
    flat gradient of their sum as well."""
    target, before = part["target"], part["before"]
    valid = target >= 0
    valid[:lead] = False
    n = len(target)
    first, last = rows.first[before], rows.last[before]
    of = np.take(w["first"], first, 0)
    of += np.take(w["last"], last, 0)
    q = of[..., :WIDTH] * _SCALE
    k, there = np.zeros((n, WIDTH, 2 * BLOCK), np.float32), np.full((n, 2 * BLOCK), -1, np.int32)
    k[:, :, BLOCK:] = of[..., WIDTH : 2 * WIDTH].transpose(0, 2, 1)
    k[1:, :, :BLOCK] = k[:-1, :, BLOCK:]
    there[:, BLOCK:], there[1:, :BLOCK] = target, target[:-1]
    x = q @ k
    x += np.where(_BEFORE, 1 + w["place"] / 8, np.float32(-1e9))
    alone = part["begins"].copy()
    alone[0] = True
    x[alone, :, :BLOCK] = -1  # a text's first block has no block before it
    np.maximum(x, 0, out=x)
    known = rows.seen[before]
    y = np.maximum(1 + (of[..., 2 * WIDTH] + known * w["seen"][0]) / 8, _LEAST)
    s = x * x
    s *= s
    s *= s
    g = ((y * y) ** 2) ** 2
    whole = s @ _ONES + g
    hit = there[:, None, :] == target[:, :, None]
    copied = (hit * s) @ _ONES
    by_spelling = np.log(g) + part["spelled"]
    with np.errstate(divide="ignore"):
        mine = np.logaddexp(np.log(copied), by_spelling)
    log_p = np.where(valid, mine - np.log(whole), 0.0)
    if not train:
        return log_p

    on = valid.astype(np.float32)
    less = on / whole
    more = on * np.where(copied > 0, np.exp(-mine), 0).astype(np.float32)
    ds = hit * more[..., None]
    ds -= less[..., None]
    ds *= s
    ds /= np.maximum(x, np.float32(1e-6))
    dg = ((on * np.exp(by_spelling - mine)).astype(np.float32) - g * less) / y * (y > _LEAST)
    grad = np.zeros(LENGTH, np.float32)
    d = weights(grad)
    d["place"] += ds.sum(0)
    d["seen"] += (known * dg).sum()
    dk = (8 * q).transpose(0, 2, 1) @ ds
    dk[:-1, :, BLOCK:] += dk[1:, :, :BLOCK]
    dof = np.concatenate([(ds @ k.transpose(0, 2, 1)) * (8 * _SCALE), dk[:, :, BLOCK:].transpose(0, 2, 1), dg[..., None]], -1).reshape(-1, _COLUMNS)
    _scatter(d["first"], first.ravel(), dof)
    _scatter(d["last"], last.ravel(), dof)
    return log_p, grad


def _scatter(table: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Adds ``rows`` to the rows ``at`` of ``table``."""
    order = np.argsort(at.astype(np.uint16), kind="stable")
    at = at[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    table[at[first]] += np.add.reduceat(rows[order], first, axis=0)


class Adam:
    """Steps of gradient ascent on the mean log probability."""

    def __init__(self, flat: np.ndarray, rate: float = 0.2):
        self.flat, self.rate, self.step = flat.astype(np.float64), rate, 0
        self.m, self.v = np.zeros(len(flat)), np.zeros(len(flat))

    def __call__(self, gradient: np.ndarray) -> np.ndarray:
        self.step += 1
        self.m = 0.8 * self.m + 0.2 * gradient
        self.v = 0.95 * self.v + 0.05 * gradient**2
        # gradients too small to tell from rounding do not move a weight
        self.flat = self.flat + self.rate * self.step**-0.3 * (self.m / (1 - 0.8**self.step)) / (np.sqrt(self.v / (1 - 0.95**self.step)) + 1e-6)
        return self.flat.astype(np.float32)


# on Spark


def _slices(batch: pa.RecordBatch, characters: int) -> Iterator[pa.RecordBatch]:
    """``batch`` (of ``doc_id, text``) in runs of about so many characters."""
    at, size = 0, 0
    for k, n in enumerate(pc.binary_length(batch.column(1)).to_pylist()):
        size += n or 0
        if size >= characters:
            yield batch.slice(at, k + 1 - at)
            at, size = k + 1, 0
    if at < batch.num_rows:
        yield batch.slice(at)


def class_of(doc_id) -> int:
    """The step that a document trains, -1 for those held out."""
    if crc_mod(doc_id, HELD_OUT[0]) == HELD_OUT[1]:
        return -1
    return zlib.crc32(b"class" + (b"" if doc_id is None else str(doc_id).encode())) % CLASSES


#: Blocks have a ``class`` above ``WORD``, counts of pairs of ids have ``PAIRS``.
WORD, PAIRS = -2, -3
_SCHEMA = "class int, part int, blob binary, block string, head binary, body binary"
_TYPES = {"int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
_GATHERED = pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in _SCHEMA.split(", ")])
_SPAN = VOCAB**2 // RANGES


def _gathered(kind: list[int], **columns) -> pa.RecordBatch:
    columns |= {"class": kind}
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(len(kind), f.type) for f in _GATHERED], schema=_GATHERED)


def gathered(docs: DataFrame, path: str) -> DataFrame:
    """In one pass, ``block`` rows of all documents, cut and dealt by class, and of those that
    train packed counts of pairs of ids in ``RANGES`` parts. Every task writes its own rows, sorted by class, so that a step reads only the pages of its
    class, and nothing is shuffled."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = subwords(path)
        pairs = np.zeros(VOCAB**2, np.int64)
        # names by place: a task that is run again deals its blocks as before
        task, named = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in _slices(batch, 8_000_000):
                ids = part.column(0).to_pylist()
                numbers, lengths = cut_texts(part.column(1).to_pylist(), cutter)
                known = cutter.arrays()
                klass = np.array([class_of(i) for i in ids])
                owner = np.repeat(np.arange(len(ids)), lengths)
                rows, met = [], []
                for c in np.unique(klass).tolist():
                    mine = klass == c
                    got = Texts.of(numbers[mine[owner]], lengths[mine], known)
                    head = np.array([[(i or 0, i is None) for i, m in zip(ids, mine, strict=True) if m]], np.int64).tobytes()
                    rows.append((c, f"{task}-{named}", head, got.packed()))
                    named += 1
                    if c >= 0:
                        flat, at = got.flat.astype(np.int64), got.ends
                        times = np.bincount(got.which, minlength=got.end)
                        inner = np.repeat(times, np.diff(at))[1:]
                        inner[at[1:-1] - 1] = 0
                        met.append((flat[:-1] * VOCAB + flat[1:], inner))
                        first, last = np.r_[flat[at[:-1]], END], np.r_[flat[at[1:] - 1], END]
                        met.append((last[np.r_[got.end, got.token[:-1]]] * VOCAB + first[got.token], np.ones(len(got.token))))
                    if met and (c == klass.max() or sum(len(x) for x, _ in met) > 300_000):
                        pairs += np.bincount(*(np.concatenate(x) for x in zip(*met, strict=True)), minlength=VOCAB**2).astype(np.int64)
                        met = []
                kinds, names, heads, bodies = zip(*rows, strict=True)
                yield _gathered(list(kinds), block=names, head=heads, body=bodies)
        cutter._forget()  # its words are not held while other stages run
        for k in range(RANGES):
            at = np.flatnonzero(pairs[k * _SPAN : (k + 1) * _SPAN])
            if len(at):
                yield _gathered([PAIRS], part=[k], blob=[pack(at, pairs[k * _SPAN + at])])

    at = shared_path(spark)
    with tidy(spark):
        sizes = {"parquet.block.size": 16 << 20, "parquet.page.size": 1 << 18, "parquet.enable.dictionary": "false"}  # rows are large
        docs.mapInArrow(run, _SCHEMA).sortWithinPartitions("class").write.options(**sizes).parquet(at)
    return spark.read.schema(_SCHEMA).parquet(at)


def pair_counts(parts: DataFrame) -> np.ndarray:
    """The sum of all packed counts ``(part, blob)``: added up part by part on the executors."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at, n = np.frombuffer(unpack(blob), np.int64).reshape(2, -1)
                total.setdefault(part, np.zeros(_SPAN, np.int64))[at] += n
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([pack(x) for x in total.values()], pa.binary())], ["part", "blob"])

    out = np.zeros(VOCAB**2, np.int64)
    with tidy(parts.sparkSession):
        got = parts.select("part", "blob").repartition(RANGES, "part").mapInArrow(add, "part int, blob binary").collect()  # VOCAB**2 numbers
    for part, blob in got:
        out[part * _SPAN : (part + 1) * _SPAN] = np.frombuffer(unpack(blob), np.int64)
    return out


def train(table: DataFrame, counts: Broadcast, tasks: int | None = None) -> np.ndarray:
    """The weights after a step for each class of the blocks, in no more than so many ``tasks`` a step."""
    schema = "blob binary, n long"

    def packed(total: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary()), pa.array([n])], ["blob", "n"])

    def gradient(batches: Iterator[pa.RecordBatch], flat: np.ndarray) -> Iterator[pa.RecordBatch]:
        w, total, n = weights(flat), np.zeros(LENGTH), 0
        for batch in batches:
            for body in batch.column(0):
                got = Texts.unpacked(body.as_py())
                rows = Blocks(got, counts.value, 1)
                for lead, part in rows.batches():
                    total += forward(w, rows, part, lead, train=True)[1]
                n += len(got.token)
        yield from packed(total, n)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(LENGTH), 0
        for batch in batches:
            for blob, k in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                total, n = total + np.frombuffer(blob.as_py(), np.float32), n + k
        yield from packed(total, n)

    adam, flat = Adam(start()), start()
    for c in range(CLASSES):
        mine = table.where(F.col("class") == c).select("body")
        sums = (mine.coalesce(tasks) if tasks else mine).mapInArrow(functools.partial(gradient, flat=flat), schema)
        with tidy(table.sparkSession):
            got = sums.repartition(RANGES).mapInArrow(add, schema).collect()  # RANGES rows at most
        if got:
            flat = adam(sum(np.frombuffer(r["blob"], np.float32).astype(np.float64) for r in got) / sum(r["n"] for r in got))
    return flat


# memory


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different values, sorted, a place of each, and which of them stands where; without the stable sort of ``np.unique``."""
    order = np.argsort(x)
    x = x[order]
    new = np.r_[True, x[1:] != x[:-1]][: len(x)]
    which = np.empty(len(x), np.int64)
    which[order] = np.cumsum(new) - 1
    return x[new], order[new], which


class Contexts:
    """The different (``MEMORY`` words, next token) of texts: hashes of the ``context`` and 16 bits
    of the ``token``, and which of them stands at which of the ``places``."""

    def __init__(self, texts: Texts):
        words = np.r_[texts.hashes, np.uint64(0)][texts.token]
        self.text = np.repeat(np.arange(len(texts.sizes)), texts.sizes)
        self.places = np.flatnonzero(np.arange(len(words)) - np.repeat(np.cumsum(texts.sizes) - texts.sizes, texts.sizes) >= MEMORY)
        context = np.zeros(len(self.places), np.uint64)
        for k in range(1, MEMORY + 1):
            context = hashing.mixed(context * np.uint64(hashing.BASE) + words[self.places - k])
        word = words[self.places]
        _, first, self.which = _distinct(hashing.mixed(context * np.uint64(hashing.BASE) + word))
        self.context, self.token = context[first], (word[first] >> np.uint64(48)).astype(np.uint16)

    def own(self, kind: np.ndarray) -> np.ndarray:
        """How often what is of a place's ``kind`` stands in the text of the place."""
        out = np.bincount(kind, minlength=1)[kind]
        some = np.flatnonzero(out > 1)  # what stands once in all texts needs no sorting
        key = self.text[self.places[some]].astype(np.int64) * (int(kind.max(initial=0)) + 1) + kind[some]
        _, at, n = np.unique(key, return_inverse=True, return_counts=True)
        out[some] = n[at]
        return out


def _by_context(items: Contexts, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the items by bucket and what is left of the hash; both in that order."""
    bucket, rest = items.context % np.uint64(buckets), items.context // np.uint64(buckets) & np.uint64(0xFFFFFFFF)
    key = bucket << np.uint64(32) | rest
    order = np.argsort(key)
    return order, bucket[order].astype(np.int64), rest[order].astype(np.uint32)


class Messages:
    """What a block sends: its ``Contexts`` (``order``) and its different words (``words``), both in the order of the
    buckets; ``parts`` has for each bucket where those of either kind start and end."""

    def __init__(self, texts: Texts, items: Contexts, buckets: int):
        self.order, self.bucket, self.rest = _by_context(items, buckets)
        bucket = texts.hashes % np.uint64(buckets)
        self.words = np.argsort(bucket.astype(np.min_scalar_type(buckets)), kind="stable")
        sizes = [np.bincount(x.astype(np.int64), minlength=buckets) for x in (self.bucket, bucket)]
        each = np.flatnonzero(sizes[0] + sizes[1])
        edges = [x[each].tolist() for n in sizes for x in (np.cumsum(n) - n, np.cumsum(n))]
        self.parts = list(zip(each.tolist(), *edges, strict=True))

    def sent(self, texts: Texts, items: Contexts, trains: bool) -> Iterator[tuple[int, bytes]]:
        """Per bucket the contexts with their tokens, and the words as ids, with how often each stands here (held out: 0)."""
        times = lambda which, n: np.bincount(which, minlength=n).astype(np.uint32) * np.uint32(trains)
        token, n = items.token[self.order], times(items.which, len(items.token))[self.order]
        seen = times(texts.which, texts.end)[self.words]
        flat, sizes = strung(texts.flat, texts.ends, self.words)
        at, sizes = np.r_[0, np.cumsum(sizes)].tolist(), sizes.astype(np.uint32)
        for b, lo, hi, start, stop in self.parts:
            steps = np.diff(self.rest[lo:hi], prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T  # byte by byte, the high ones mostly zeros
            yield b, pack(np.array([hi - lo, stop - start]), np.ascontiguousarray(steps), n[lo:hi], seen[start:stop], sizes[start:stop], token[lo:hi], flat[at[start] : at[stop]])

    def answered(self, said: list[dict] | None) -> tuple[np.ndarray, np.ndarray]:
        """How often each context was seen with its token and at all, and how often each word."""
        contexts, words = np.zeros((2, len(self.order))), np.zeros(len(self.words), np.int64)
        of = {a["bucket"]: a["answer"] for a in said or []}
        for b, lo, hi, start, stop in self.parts:
            raw = unpack(of[b])
            contexts[:, self.order[lo:hi]] = np.frombuffer(raw, np.uint32, 2 * (hi - lo)).reshape(2, -1)
            words[self.words[start:stop]] = np.frombuffer(raw, np.int64, stop - start, 8 * (hi - lo))
        return contexts, words


def _received(raw: bytes) -> list[np.ndarray]:
    """Contexts, their counts, the words' counts, their numbers of ids, the contexts' tokens, the words' ids."""
    n, m = np.frombuffer(raw, np.int64, 2).tolist()
    steps = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, 16).reshape(4, n).T).view(np.uint32).ravel()
    counts, rest = np.frombuffer(raw, np.uint32, n + 2 * m, 16 + 4 * n), np.frombuffer(raw, np.uint16, -1, 16 + 8 * (n + m))
    return [np.cumsum(steps, dtype=np.uint32), *np.split(counts, [n, n + m]), *np.split(rest, [n])]


def _told(h: np.ndarray, counts: np.ndarray, at: np.ndarray, flat: np.ndarray, sizes: np.ndarray, most: int) -> bytes:
    """The number of all tokens of a bucket and of its different words that training texts hold; of the ``most`` frequent of those
    hashes, counts, numbers of ids, and ids. ``at`` says where in ``sizes`` a word is."""
    known = np.flatnonzero(counts)
    n = len(known)
    if n > most:
        known = known[counts[known] >= np.partition(counts[known], n - most)[n - most]]
        known = known[np.lexsort((h[known], -counts[known]))[:most]]
    ids, size = strung(flat, np.r_[0, np.cumsum(sizes, dtype=np.int64)], at[known])
    return pack(np.array([counts.sum(), n, len(known)]), h[known], counts[known], size, ids)


def remembered(table: DataFrame, buckets: int) -> DataFrame:
    """Rows ``(block, bucket, answer)`` with how often each of the block's ``Contexts`` occurs in training texts,
    and how often its words do; and of every bucket a row without a block, what it has ``_told``."""
    most = int(FREQUENT / buckets + 6 * (FREQUENT / buckets) ** 0.5) + 100  # the most frequent words fall into buckets by hash

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in blocks.rows_of(batches):
            texts = Texts.unpacked(row["body"])
            items = Contexts(texts)
            out = [(row["block"], b, sent) for b, sent in Messages(texts, items, buckets).sent(texts, items, row["class"] >= 0)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["block", "bucket", "sent"])

    def seen_with(context: np.ndarray, token: np.ndarray, n: np.ndarray) -> np.ndarray:
        key = context.astype(np.uint64) << np.uint64(16) | token
        order = np.argsort(key)
        key, n = key[order], n[order].astype(np.int64)
        out = np.empty((2, len(key)), np.uint32)
        for k, x in enumerate((key, key >> np.uint64(16)) if len(key) else ()):
            first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
            out[k, order] = np.repeat(np.add.reduceat(n, first), np.diff(np.r_[first, len(x)]))
        return out

    def compare(rows: list[dict]) -> list[tuple]:
        sent = [_received(unpack(r["sent"])) for r in rows]
        ends = [np.cumsum([0, *(len(x[k]) for x in sent)]).tolist() for k in (0, 3)]
        context, n, seen, sizes, token, flat = (np.concatenate(x) for x in zip(*sent, strict=True))
        del sent
        out = seen_with(context, token, n)
        del context, token, n
        h, at, which = _distinct(whole(flat, np.r_[0, np.cumsum(sizes, dtype=np.int64)]))
        counts = np.bincount(which, seen, len(h)).astype(np.int64)
        told = [(None, rows[0]["bucket"], _told(h, counts, at, flat, sizes, most))]
        words = counts[which]
        cuts = zip(rows, *(x for e in ends for x in (e[:-1], e[1:])), strict=True)
        return told + [(r["block"], r["bucket"], pack(out[0, a:b], out[1, a:b], words[c:d])) for r, a, b, c, d in cuts]

    return cut(blocks.answers(table.mapInArrow(send, blocks.SENT), buckets, compare))


def by_memory(log_p: np.ndarray, items: Contexts, sent: Messages, said: np.ndarray, trains: bool) -> np.ndarray:
    """Natural-log probabilities of tokens, those of the model mixed with the memory's."""
    c, n = said[:, items.which]
    if trains:  # the document's own share of what its block has sent
        alike, bucket, rest = np.zeros(len(sent.order), np.int64), sent.bucket, sent.rest
        alike[sent.order] = np.cumsum(np.r_[False, (bucket[1:] != bucket[:-1]) | (rest[1:] != rest[:-1])][: len(bucket)])
        c, n = c - items.own(items.which), n - items.own(alike[items.which])
    out = log_p.copy()
    with np.errstate(divide="ignore"):
        out[items.places] = np.logaddexp(np.log(c), math.log(MEMORY_WEIGHT) + log_p[items.places]) - np.log(n + MEMORY_WEIGHT)
    return out


def lexicon(told: list[bytes], pairs: np.ndarray, texts: int, path: str) -> tuple[Counts, int, int]:
    """The counts of the most frequent words, by what all buckets have ``_told``, and the numbers of words, all and different ones."""
    cutter, every, total, distinct = Subwords(path), [], 0, 0
    for raw in map(unpack, told):
        a, b, n = np.frombuffer(raw, np.int64, 3).tolist()
        total, distinct = total + a, distinct + b
        every.append((np.frombuffer(raw, np.uint64, n, 24), *np.frombuffer(raw, np.int64, 2 * n, 24 + 8 * n).reshape(2, n), np.frombuffer(raw, np.uint16, -1, 24 + 24 * n)))
    h, counts, sizes, flat = (np.concatenate(x) for x in zip((np.zeros(0, np.uint64), *np.zeros((2, 0), np.int64), np.zeros(0, np.uint16)), *every, strict=True))
    ends = np.r_[0, np.cumsum(sizes)]
    some = np.lexsort((h, -counts))[:FREQUENT]
    length = np.r_[0, np.cumsum(cutter.bytes[flat])]
    some = some[length[ends[some + 1]] - length[ends[some]] - 1 <= WORD_BYTES]  # without the blank before it
    flat, sizes = strung(flat, ends, some)
    return Counts(pairs, flat, np.r_[0, np.cumsum(sizes)], counts[some], texts, cutter.starts), total, distinct


def spelling(pairs: np.ndarray, frequent: dict[bytes, int], texts: int, path: str) -> Counts:
    cutter = Subwords(path)
    cutter.numbers(list(frequent))
    flat, ends = cutter.arrays()
    return Counts(pairs, flat, ends, np.array(list(frequent.values()), np.int64), texts, cutter.starts)


def score(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Rows ``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_subwords)``."""
    path = path or tokenizer_file()
    spark = docs.sparkSession
    raw = gathered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), path)
    table = raw.where(F.col("class") > WORD).select("block", "head", "body", "class")
    trains = F.when(F.col("class") >= 0, F.length("head") / 16)
    size, end = (int(x) for x in table.agg(F.coalesce(F.sum(F.length("body")), F.lit(0)), F.coalesce(F.sum(trains), F.lit(0))).first())
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    said = remembered(table, buckets)
    told = [r[0] for r in said.where("block is null").select("answer").collect()]  # little more than FREQUENT words
    learned, n_all, n_words = lexicon(told, pair_counts(raw.where(F.col("class") == PAIRS)), end, path)
    n_all, less = n_all + end, math.log10(n_all + end + n_words + (end > 0) + 1)
    counts = spark.sparkContext.broadcast(learned)  # of bounded size
    tasks = max(spark.sparkContext.defaultParallelism, -(-size // (CLASSES * STEP_BYTES)))
    trained = spark.sparkContext.broadcast(train(table, counts, tasks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights(trained.value)
        for row in blocks.rows_of(batches):
            got, own = Texts.unpacked(row["body"]), row["class"] >= 0
            ids, null = np.frombuffer(row["head"], np.int64).reshape(-1, 2).T.tolist()
            rows = Blocks(got, counts.value, int(own))
            log_p = np.concatenate([forward(w, rows, part, lead)[lead:] for lead, part in rows.batches()]).ravel()[rows.slot]
            items = Contexts(got)
            sent = Messages(got, items, buckets)
            seen, c = sent.answered(row["said"])
            total = np.bincount(items.text, by_memory(log_p, items, sent, seen, own), len(ids))
            of = np.repeat(np.arange(len(ids)), got.lengths)
            base = np.bincount(of, np.log10(c + 1.0)[got.which], len(ids)) + math.log10(end + 1) - got.sizes * less
            known = np.bincount(of, (c > 0)[got.which], len(ids)).astype(np.int64) + (end > 0)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64(), mask=np.array(null, bool)), pa.array([not own] * len(ids)), pa.array(got.sizes), pa.array(known), pa.array([n_all] * len(ids), pa.int64()),
                    pa.array(base), pa.array(total / math.log(10)), pa.array(got.ids_of),
                ],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_subwords"],
            )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_subwords long"
    return cut(blocks.answered(table, said.where("block is not null"), "said").mapInArrow(run, schema))
