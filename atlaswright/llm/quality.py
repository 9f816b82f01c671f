"""Quality classification by co-training of two views.

The text view sees a document's hashed words; the page view sees metadata: source,
language label, length, and the layout (line counts and lengths, shares of letters,
digits, signs, capitals and blanks). Each view's logistic regression is fitted on the
labelled sample; in each of ``ROUNDS`` rounds both score all unlabelled documents, and each
hands the ``2 * GROW`` it is most confident of to the other to learn from. Last, both margins
are calibrated on a fold held out from all of this, and their combination scores every
document. The same is done for two targets, quality and toxicity; ``keep`` asks for a good
and non-toxic document.

Fitting takes a bounded sample of labelled documents, the ``SAMPLE`` of the smallest hashes,
and what the views hand over; everything else covers all documents, whole.

Edge cases: a null text is empty; null or unknown sources and languages are a value of
their own; labels that are null, or not 0 or 1, or of documents that do not exist, are left
out, of repeated labels the largest counts; with labels of one kind only (or none) the score
is the share of positive labels (0.5 without any); repeated documents are scored as often
as they occur, and handed over once; very long texts are read whole; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

SAMPLE = 4000
ROUNDS = 3
SURE = 3.5  # deviations from chance at which a feature counts
GROW = 100  # half of the pseudo-labels that a view hands over in a round
BITS = 18
META = 512  # hashed metadata features
_SIGNS = bytes(b for b in range(128) if not bytes([b]).isalnum())
#: Tasks that merge what views are confident of before one does.
MERGES = 8


class _Features(dict):
    """A word's hashed features: itself without trailing signs, and those signs."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) > 400_000:
            self.clear()
        bare = word.rstrip(_SIGNS)
        tail = word[len(bare) :]
        out = self[word] = (zlib.crc32(bare) & (1 << BITS) - 1, zlib.crc32(b"\0" + tail) & (1 << BITS) - 1)
        return out


_features = _Features()


def text_view(text: str | None) -> np.ndarray:
    """The distinct hashed features of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.array(sorted({f for w in set(words) for f in _features[w]}), np.int64)


_LETTER, _DIGIT, _UPPER, _BLANK = (np.array([bool(re.match(p, bytes([b]))) for b in range(256)]) for p in (rb"[A-Za-z\x80-\xff]", rb"\d", rb"[A-Z]", rb"\s"))


def page_view(text: str | None, lang: str | None, source: str | None) -> np.ndarray:
    """Hashed metadata features; numbers count by their step on a scale."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size, lines = max(1, len(raw)), raw.count(b"\n") + 1
    share = lambda which: int(40 * n[which].sum() / size)
    named = {
        "lang": lang, "source": source, "size": int(2 * math.log2(size)), "lines": int(2 * math.log2(lines)), "line": int(2 * math.log2(size / lines)),
        "letters": share(_LETTER), "digits": share(_DIGIT), "capitals": share(_UPPER), "blanks": share(_BLANK), "signs": share(~(_LETTER | _DIGIT | _BLANK)),
    }
    return np.unique([zlib.crc32(f"{k}={v}".encode()) % META for k, v in named.items()]).astype(np.int64)


class Sparse:
    """Binary features of documents, row by row."""

    def __init__(self, rows: list[np.ndarray], width: int):
        self.width, self.n = width, len(rows)
        self.at = np.concatenate([*rows, np.zeros(0, np.int64)])
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.at], self.n)

    def sums(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, x[self.row], self.width)


def fit(x: Sparse, y: np.ndarray, weight: np.ndarray, prior: float = 20.0, steps: int = 60) -> tuple[np.ndarray, float]:
    """Logistic regression in the log-ratio direction: features start from how their rates
    differ between the classes, shrunk to no difference when rare, then a few hundred
    gradient steps scale and correct them. Returns weights and intercept."""
    pos, neg = x.sums(weight * y), x.sums(weight * (1 - y))
    n1, n0 = (weight * y).sum() + 1, (weight * (1 - y)).sum() + 1
    rate = (pos + neg) / (n1 + n0)
    ratio = np.log((pos + prior * rate + 1e-6) / (n1 + prior)) - np.log((neg + prior * rate + 1e-6) / (n0 + prior))
    # how far the positives that have a feature are from what chance gives them
    apart = (pos - n1 * rate) / np.sqrt(n1 * rate * (1 - np.minimum(rate, 0.999)) + 1e-6)
    ratio[(pos + neg == 0) | (np.abs(apart) < SURE)] = 0
    w, bias = 0.2 * ratio, math.log(n1 / n0)
    m, v = np.zeros(x.width + 1), np.zeros(x.width + 1)
    balance = weight * np.where(y > 0, (n0 + n1) / (2 * n1), (n0 + n1) / (2 * n0))
    balance /= balance.sum()
    for k in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x.dot(w) + bias, -30, 30)))
        e = balance * (p - y)
        g = np.r_[x.sums(e) * np.abs(ratio) + 1e-4 * w, e.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-7)
        w, bias = w - step[:-1] * np.minimum(1, np.abs(ratio)), bias - step[-1]
    return w, bias


def calibrated(margins: np.ndarray, y: np.ndarray, steps: int = 400) -> np.ndarray:
    """Weights (one a view, and an intercept) that turn margins into a probability."""
    x = np.c_[np.clip(margins, -20, 20), np.ones(len(y))]
    w = np.r_[np.full(margins.shape[1], 0.5), 0.0]
    for _ in range(steps):  # Newton steps, slightly damped towards small weights
        p = 1 / (1 + np.exp(-x @ w))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (p - y) + 1e-2 * w)
        w = w - step * min(1.0, 2 / (1e-9 + np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    """Both views and their calibration for one target."""

    def __init__(self, views: list[tuple[np.ndarray, float]], combine: np.ndarray, share: float | None = None):
        self.views, self.combine, self.share = views, combine, share

    def margins(self, feats: list[Sparse]) -> np.ndarray:
        return np.stack([x.dot(w) + b for x, (w, b) in zip(feats, self.views, strict=True)], 1)

    def __call__(self, feats: list[Sparse]) -> tuple[np.ndarray, np.ndarray]:
        if self.share is not None:
            return np.full(feats[0].n, self.share), np.zeros((feats[0].n, 2))
        m = self.margins(feats)
        z = np.c_[np.clip(m, -20, 20), np.ones(len(m))] @ self.combine
        return 1 / (1 + np.exp(-np.clip(z, -40, 40))), m


_WIDTHS = (1 << BITS, META)
_KINDS = (np.int32, np.int16)  # of packed features of the two views


def _inputs(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("text", "lang", "source")))


def featured(docs: DataFrame, labels: DataFrame, targets: list[str]) -> DataFrame:
    """Rows ``(doc_id, key, words, page, *targets)``: packed features of both views, a hash of
    the row, and the labels, null where there are none."""
    labels = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*(F.max(F.when(F.col(t).isin(0, 1), F.col(t).cast("int"))).alias(t) for t in targets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = list(zip(*(part.column(c).to_pylist() for c in ("text", "lang", "source")), strict=True))
                views = [text_view(t).astype(_KINDS[0]).tobytes() for t, _, _ in rows], [page_view(*r).astype(_KINDS[1]).tobytes() for r in rows]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), *(pa.array(v, pa.binary()) for v in views)], ["doc_id", "key", "words", "page"])

    keyed = _inputs(docs).withColumn("key", F.xxhash64("doc_id", "text", "lang", "source"))
    return cut(keyed.mapInArrow(run, "doc_id long, key long, words binary, page binary").join(labels, "doc_id", "left"))


def _sparse(columns: list[list[bytes]]) -> list[Sparse]:
    return [Sparse([np.frombuffer(b, kind).astype(np.int64) for b in column], width) for column, kind, width in zip(columns, _KINDS, _WIDTHS, strict=True)]


class Pupil:
    """Both views of one target while they teach each other."""

    def __init__(self, columns: list[list[bytes]], labels: list[int | None], fold: np.ndarray):
        known = np.array([y is not None for y in labels], bool)
        y = np.array([y or 0 for y in labels])
        self.share = float(y[known].mean()) if known.any() else 0.5
        self.able = all(len(set(y[known & f])) == 2 for f in (fold, ~fold))
        pick = lambda which: ([[c[k] for k in np.flatnonzero(which)] for c in columns], y[which].astype(float))
        self.taught = [[*pick(known & ~fold), np.ones(int((known & ~fold).sum()))] for _ in _WIDTHS]
        self.kept_back = pick(known & fold)
        self.seen: list[set[int]] = [set(), set()]  # keys of what a view was handed
        self.models: list[tuple[np.ndarray, float]] = []

    def fit(self) -> None:
        self.models = [fit(_sparse(columns)[k], y, weight) for k, (columns, y, weight) in enumerate(self.taught)]

    def wants(self) -> dict[int, int]:
        """How many of each kind a view hands over."""
        many = min(2 * GROW - 1, max(1, round(2 * GROW * self.share)))
        return {1: many, 0: 2 * GROW - many}

    def learn(self, view: int, rows: list[tuple]) -> None:
        """``view`` learns from rows ``(y, key, words, page)``."""
        columns, y, weight = self.taught[view]
        columns = [c + [r[k] for r in rows] for c, k in zip(columns, (2, 3), strict=True)]
        self.taught[view] = [columns, np.r_[y, [r[0] for r in rows]], np.r_[weight, np.full(len(rows), 0.5)]]
        self.seen[view].update(r[1] for r in rows)

    def model(self) -> Model:
        if not self.able:
            return Model([], np.zeros(3), self.share)
        model = Model(self.models, np.zeros(3))
        columns, y = self.kept_back
        model.combine = calibrated(model.margins(_sparse(columns)), y)
        return model


_SURE = "target string, view int, y int, sure double, key long, words binary, page binary"


def _surest(rows: Iterator[tuple], wants: dict[tuple[str, int], int]) -> list[tuple]:
    """Of rows ``(target, view, y, sure, key, words, page)``, as many of each target, view and y as are wanted."""
    best: dict[tuple, list[tuple]] = {}
    for r in sorted(rows, key=lambda r: (-r[3], r[4])):
        mine = best.setdefault(r[:3], [])
        if len(mine) < wants[r[0], r[2]] and (not mine or r[4] != mine[-1][4]):  # copies follow each other
            mine.append(r)
    return [r for mine in best.values() for r in mine]


def handed_over(feats: DataFrame, pupils: dict[str, Pupil]) -> list[tuple]:
    """What each view is surest of among all documents without a label: ``_SURE`` rows."""
    wants = {(t, y): n for t, p in pupils.items() for y, n in p.wants().items()}
    sent = feats.sparkSession.sparkContext.broadcast({t: (p.models, p.seen) for t, p in pupils.items()})  # of fixed size

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], [c.split()[0] for c in _SURE.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple] = []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("words", "page")]
            keys, views = batch.column("key").to_numpy(), _sparse(columns)
            for t, (models, seen) in sent.value.items():
                free = batch.column(t).is_null().to_numpy(zero_copy_only=False)
                for view, (w, b) in enumerate(models):
                    margin = views[view].dot(w) + b
                    for y in (0, 1):
                        sure = margin if y else -margin
                        at = np.flatnonzero(free & (sure > 1))
                        at = at[np.lexsort((keys[at], -sure[at]))]
                        at = at[np.sort(np.unique(keys[at], return_index=True)[1])]  # one of each copy
                        some = [k for k in at[: wants[t, y] + len(seen[1 - view])].tolist() if int(keys[k]) not in seen[1 - view]]
                        best += [(t, view, y, float(sure[k]), int(keys[k]), columns[0][k], columns[1][k]) for k in some]
            best = _surest(best, wants)
        yield batch_of(best)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple] = []
        for batch in batches:
            best = _surest([*best, *zip(*(c.to_pylist() for c in batch.columns), strict=True)], wants)
        yield batch_of(best)

    found = feats.mapInArrow(run, _SURE).repartition(MERGES).mapInArrow(merge, _SURE).repartition(1).mapInArrow(merge, _SURE)
    return [tuple(r) for r in found.collect()]  # 2 * GROW rows a target and view


def learn(feats: DataFrame, targets: list[str]) -> dict[str, Model]:
    """Models of ``featured`` documents."""
    labelled = feats.where(F.greatest(*(F.col(t).isNotNull() for t in [*targets, targets[0]]))).where("doc_id is not null")
    table = labelled.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id", "key").limit(SAMPLE).toArrow()
    columns = [table.column(c).to_pylist() for c in ("words", "page")]
    fold = np.array([zlib.crc32(f"fold{i}".encode()) % 4 == 0 for i in table.column("doc_id").to_pylist()], bool)
    pupils = {t: Pupil(columns, table.column(t).to_pylist(), fold) for t in targets}
    able = {t: p for t, p in pupils.items() if p.able}
    for turn in range(ROUNDS + 1 if able else 0):
        for p in able.values():
            p.fit()
        if turn < ROUNDS:
            rows = handed_over(feats, able)
            for t, p in able.items():
                for view in (0, 1):
                    p.learn(1 - view, [(r[2], *r[4:]) for r in rows if r[:2] == (t, view)])
    return {t: p.model() for t, p in pupils.items()}


def score(feats: DataFrame, models: dict[str, Model], good: str = "quality", bad: str = "toxic") -> DataFrame:
    """Rows ``(doc_id, keep, <target>, <target>_by_text, <target>_by_page ...)`` of ``featured`` documents."""
    sent = feats.sparkSession.sparkContext.broadcast(models)  # of fixed size: 2**BITS weights a target
    names = [f"{t}{s}" for t in models for s in ("", "_by_text", "_by_page")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = sent.value
        for batch in batches:
            got = {t: m(_sparse([batch.column(c).to_pylist() for c in ("words", "page")])) for t, m in models.items()}
            keep = np.ones(batch.num_rows, bool)
            if good in got:
                keep &= got[good][0] >= 0.5
            if bad in got:
                keep &= got[bad][0] < 0.5
            columns = [c for p, m in got.values() for c in (p, m[:, 0], m[:, 1])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keep), *map(pa.array, columns)], ["doc_id", "keep", *names])

    return feats.select("doc_id", "words", "page").mapInArrow(run, "doc_id long, keep boolean, " + ", ".join(f"{n} double" for n in names))
