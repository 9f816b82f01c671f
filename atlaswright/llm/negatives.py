"""Hard negatives by an inverted multi-index.

For an anchor, its positives are the best other rows of its label, and a positive's hard negatives
the best rows of other labels whose score lies in a window below the positive's own. Scores
are integer inner products.

Every row is indexed: its vector is cut in two halves, each half goes to the nearest centroid of its own
codebook, and the pair of centroids names the row's cell. The codebooks are fitted on a bounded sample;
radii (the farthest member of each half's cluster) come from all rows. For an anchor, a half's cluster
bounds the half's share of any member's score by centroid product plus anchor length times radius.
A heap walks the pairs of clusters by falling sum of both bounds (the multi-sequence order), past
empty cells. An anchor's cells are visited until its answer is certified: no unvisited cell's bound
reaches the last score that counts. The first round visits cells of some ``START`` rows; what it
found sets the bound down to which the next visits, and the loop ends when all anchors are certified, which is exact
however well or badly the codebooks fit. Positives come first; their scores give the windows for negatives.

A round sends anchors, as rows, to the blocks of the cells they visit; a block (at most some ``BLOCK`` rows)
meets the anchors in a stream, some hundreds at a time, and answers each with its best few rows.

Of rows with the same vector and label all but the first few by id are left out of the index (one more than the
answers asked for): their scores are equal and their ids larger, so none can come before those. That is decided by a
ranked window that Spark cuts before its shuffle. All anchors, copies or not, are searched.

Edge cases: rows with a null id, label or vector, or with any null, NaN or infinite component take no part; of rows that
repeat a ``vec_id`` the least (by label, then vector) counts; a vector shorter than the longest counts as
ending in zeros, an empty one as all zeros; ties go by smaller id; labels with too few rows give
fewer positives; anchors without positives or with negative positive scores give no rows for them; an empty table
gives no rows. Vectors whose scores may pass 55 bits are an error. Columns other than ``vec_id``,
``embedding`` and ``label`` are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: The codebooks are fitted on so many rows at most, chosen by hash, in so many rounds.
SAMPLE, FITS = 20_000, 8
#: Rows a cell holds on average; most centroids a half.
CELL, CODES = 256, 256
#: Rows that a first visit takes in; rows of a block; anchors that meet a block at a time.
START, BLOCK, AT_ONCE = 2_000, 4_096, 256

_SCORED = "array<struct<score:long,id:long>>"


def whole_vectors(rows: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """Rows ``(vec_id, label, v)`` that take part: components times 256 rounded down, and every ``every``-th id's label moved on by one."""
    x = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall(x, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    moved = F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")).cast("long")
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    v = F.transform(x, lambda x: F.floor(256 * x))
    return rows.select(F.col("vec_id").cast("long"), moved.alias("label"), v.alias("v"))


class Codebooks:
    """Two half-space codebooks with, once all rows are assigned, radii and the sizes of cells."""

    def __init__(self, sample: np.ndarray, codes: int, rounds: int = FITS):
        self.width = sample.shape[1]
        self.cut = self.width // 2
        self.centres = [self._fit(half, codes, rounds) for half in (sample[:, : self.cut], sample[:, self.cut :])]

    @staticmethod
    def _fit(x: np.ndarray, codes: int, rounds: int) -> np.ndarray:
        """Lloyd's rounds from rows spread over the sample; a cluster that loses all its rows keeps its centre."""
        centres = np.unique(x[np.arange(codes) * len(x) // codes], axis=0) if len(x) else np.zeros((1, x.shape[1]))
        for _ in range(rounds):
            near = Codebooks._nearest(x, centres)[0]
            n = np.bincount(near, minlength=len(centres))
            sums = np.zeros_like(centres)
            np.add.at(sums, near, x)
            centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        return centres

    @staticmethod
    def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = np.argmin((centres**2).sum(1) - 2 * (x @ centres.T), axis=1) if len(x) else np.zeros(0, np.int64)
        return near, np.sqrt(((x - centres[near]) ** 2).sum(1))

    def halves(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, : self.cut], x[:, self.cut :]]

    def assign(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each half the cluster and the distance from its centre."""
        return [self._nearest(half, c) for half, c in zip(self.halves(x), self.centres, strict=True)]

    def know(self, cells: list[tuple[int, int, int, float, float]]) -> None:
        """Take sizes of cells, and radii from the farthest rows in them."""
        self.sizes = {(i, j): n for i, j, n, _, _ in cells}
        self.radii = [np.zeros(len(c)) for c in self.centres]
        for i, j, _, far, also in cells:
            self.radii[0][i] = max(self.radii[0][i], far)
            self.radii[1][j] = max(self.radii[1][j], also)

    def walk(self, q: np.ndarray) -> Iterator[tuple[float, int, int]]:
        """``(bound, i, j)`` of the cells that hold rows, by falling bound: at least the score of any row in them."""
        orders, bounds = [], []
        for half, centres, radii in zip(self.halves(q[None, :]), self.centres, self.radii, strict=True):
            bound = centres @ half[0] + np.sqrt((half[0] ** 2).sum()) * radii
            order = np.argsort(-bound, kind="stable")
            orders.append(order.tolist())
            bounds.append(bound[order].tolist())
        (left, right), (above, beside) = orders, bounds
        heap = [(-above[0] - beside[0], 0, 0)]
        while heap:
            bound, a, b = heapq.heappop(heap)
            if b == 0 and a + 1 < len(left):  # the next row opens when the head of this one is taken
                heapq.heappush(heap, (-above[a + 1] - beside[0], a + 1, 0))
            if b + 1 < len(right):
                heapq.heappush(heap, (-above[a] - beside[b + 1], a, b + 1))
            if (left[a], right[b]) in self.sizes:
                yield -bound + 1e-9 * abs(bound) + 0.5, left[a], right[b]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of a list column as rows of exact doubles or, where these would not do, of integers; short ones end in zeros."""
    out = np.zeros((len(column), width), np.int64)
    sizes = np.diff(column.offsets.to_numpy())
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices: in doubles while these hold them, else in integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most >= 2**55:
        raise ValueError("scores of over 55 bits")
    return a @ b.T


class Index:
    """All rows by cell: ``table(cell, part, vec_id, label, v)`` in the shared folder, and the codebooks."""

    def __init__(self, rows: DataFrame, copies: int, width: int, n: int):
        spark = rows.sparkSession
        sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
        codes = int(min(CODES, max(2, round((n / CELL) ** 0.5))))
        self.books = books = Codebooks(_matrix(sample, width).astype(np.float64), codes)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                (i, far), (j, also) = books.assign(_matrix(batch.column("v"), width).astype(np.float64))
                new = [pa.array(i.astype(np.int64)), pa.array(j.astype(np.int64)), pa.array(far), pa.array(also)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "i", "j", "far", "also"])

        # a window with a rank below a bound is cut in every task before its shuffle
        same = Window.partitionBy("v", "label").orderBy("vec_id")
        distinct = rows.withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= copies).select("vec_id", "label", "v")
        table = cut(distinct.mapInArrow(assign, "vec_id long, label long, v array<long>, i long, j long, far double, also double"))
        cells = table.groupBy("i", "j").agg(F.count("*"), F.max("far"), F.max("also")).collect()  # at most CODES squared
        books.know([tuple(r) for r in cells])
        self.parts = {(i, j): -(-n // BLOCK) for (i, j), n in books.sizes.items()}
        sizes = spark.createDataFrame([(i, j, n) for (i, j), n in self.parts.items()], "i long, j long, parts long")
        part = F.pmod(F.xxhash64("vec_id"), F.col("parts"))
        self.width, self.codes = width, codes
        self.table = table.join(F.broadcast(sizes), ["i", "j"]).select((F.col("i") * CODES + F.col("j")).alias("cell"), part.alias("part"), "vec_id", "label", "v")

    def visits(self, anchors: DataFrame, schema: str) -> DataFrame:
        """``anchors(vec_id, label, v, seen, least, ...)`` with ``cells``, the (cell, part) pairs to visit after the first ``seen`` of
        the walk, down to the bound ``least`` (none: those of ``START`` rows), and ``left``, the bound of the first cell that is not visited."""
        books, parts, width = self.books, self.parts, self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cells, seen, left = [], [], []
                for q, before, least in zip(_matrix(batch.column("v"), width).astype(np.float64), batch.column("seen").to_pylist(), batch.column("least").to_pylist(), strict=True):
                    visit, at, rows, rest = [], 0, 0, None
                    for bound, i, j in books.walk(q):
                        if at >= before and (rows >= START if least is None else bound < least):
                            rest = bound
                            break
                        if at >= before:
                            visit += [{"cell": i * CODES + j, "part": p} for p in range(parts[i, j])]
                            rows += books.sizes[i, j]
                        at += 1
                    cells.append(visit)
                    seen.append(at)
                    left.append(rest)
                kind = pa.list_(pa.struct([("cell", pa.int64()), ("part", pa.int64())]))
                kept = [k for k, name in enumerate(batch.schema.names) if name != "seen"]
                new = [pa.array(seen, pa.int64()), pa.array(left, pa.float64()), pa.array(cells, kind)]
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept], *new], [*[batch.schema.names[k] for k in kept], "seen", "left", "cells"])

        return anchors.mapInArrow(run, f"{schema}, seen long, left double, cells array<struct<cell:long,part:long>>")

    def meet(self, visits: DataFrame, best) -> DataFrame:
        """Rows ``(vec_id, window, found)``: ``best(scores, ids, labels, anchors)`` of every visit's block. A block's rows come first in their
        partition, then the anchors that visit it, in a stream."""
        width = self.width
        own = self.table.select("cell", "part", F.lit(0).alias("kind"), "vec_id", "label", "v", F.lit(None).cast("array<long>").alias("tops"))
        asked = visits.select(F.explode("cells").alias("at"), "vec_id", "label", "v", "tops").select("at.cell", "at.part", F.lit(1).alias("kind"), "vec_id", "label", "v", "tops")

        def answer(block: list, asked: list) -> pa.RecordBatch:
            rows, anchors = (pa.Table.from_batches(x).combine_chunks() for x in (block, asked))
            order = np.argsort(rows["vec_id"].to_numpy(), kind="stable")
            ids, labels = rows["vec_id"].to_numpy()[order], rows["label"].to_numpy()[order]
            scores = _products(_matrix(anchors["v"].combine_chunks(), width), _matrix(rows["v"].combine_chunks(), width)[order])
            scores_of = best(scores, ids, labels, anchors)
            found = pa.array([f for _, _, f in scores_of], pa.list_(pa.struct([("score", pa.int64()), ("id", pa.int64())])))
            return pa.RecordBatch.from_arrays([pa.array([q for q, _, _ in scores_of], pa.int64()), pa.array([w for _, w, _ in scores_of], pa.int32()), found], ["vec_id", "window", "found"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, block, waiting, n = None, [], [], 0
            for batch in batches:
                keys = np.stack([batch.column(c).to_numpy() for c in ("cell", "part", "kind")])
                edges = np.r_[0, np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1, batch.num_rows] if batch.num_rows else np.zeros(1, np.int64)
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    key, kind, rows = tuple(keys[:2, a].tolist()), keys[2, a], batch.slice(a, b - a)
                    if key != at:
                        if waiting:
                            yield answer(block, waiting)
                        at, block, waiting, n = key, [], [], 0
                    if kind == 0:
                        block.append(rows)
                        continue
                    for k in range(0, rows.num_rows, AT_ONCE):
                        waiting.append(rows.slice(k, AT_ONCE))
                        n += waiting[-1].num_rows
                        if n >= AT_ONCE:
                            yield answer(block, waiting)
                            waiting, n = [], 0
            if waiting:
                yield answer(block, waiting)

        dealt = own.unionByName(asked).repartition("cell", "part").sortWithinPartitions("cell", "part", "kind")
        return dealt.mapInArrow(run, f"vec_id long, window int, found {_SCORED}")


def _first(scores: np.ndarray, ids: np.ndarray, most: int) -> list[dict]:
    """The ``most`` first by falling score, then by id (``ids`` ascend)."""
    if len(scores) > 4 * most:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - most)[len(scores) - most])
        scores, ids = scores[near], ids[near]
    order = np.argsort(-scores, kind="stable")[:most]
    return [{"score": s, "id": i} for s, i in zip(scores[order].tolist(), ids[order].tolist(), strict=True)]


def _sorted(found: Column) -> Column:
    """Scored rows by falling score, then id."""
    return F.transform(F.array_sort(F.transform(found, lambda f: F.struct((-f.score).alias("k"), f.id.alias("id")))), lambda f: F.struct((-f.k).alias("score"), f.id.alias("id")))


def _search(index: Index, anchors: DataFrame, best, windows: Column, most: int, threshold) -> DataFrame:
    """``anchors`` with ``found``, an array of the ``most`` first rows of each window. ``threshold(found)`` is the score below which
    nothing unvisited counts; null while anything may."""
    schema = ", ".join(f"{c} {t}" for c, t in anchors.dtypes if c not in ("seen",))
    empty = F.transform(windows, lambda w: F.array().cast(_SCORED))
    state = anchors.withColumns({"seen": F.lit(0).cast("long"), "least": F.lit(None).cast("double"), "found": empty})
    done = None
    while True:
        visits = cut(index.visits(state, f"{schema}, least double, found array<{_SCORED}>"))
        got = index.meet(visits, best).select("vec_id", "window", F.explode("found").alias("f"))
        # all but the first of a window go in every task, then again behind the shuffle
        place = F.row_number().over(Window.partitionBy("vec_id", "window").orderBy(F.desc("f.score"), "f.id"))
        got = got.withColumn("place", place).where(F.col("place") <= most).groupBy("vec_id").agg(F.collect_list(F.struct("window", "f")).alias("new"))
        joined = visits.join(got, "vec_id", "left")
        new = lambda k: F.transform(F.filter(F.coalesce("new", F.array()), lambda x: x.window == k), lambda x: x.f)
        found = F.transform("found", lambda old, k: F.slice(_sorted(F.concat(old, new(k))), 1, most))
        state = cut(joined.withColumn("found", found).withColumn("least", threshold(F.col("found"))).drop("new", "cells"))
        over = F.col("left").isNull() | F.coalesce(F.col("left") < F.col("least"), F.lit(False))
        certified = state.where(over).drop("seen", "least", "left")
        done = certified if done is None else done.unionByName(certified)
        state = state.where(~over).withColumn("least", F.coalesce("least", F.lit(float("-inf")))).drop("left")
        if state.isEmpty():
            return done


def mine(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """Rows ``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` for the anchors among ``rows(vec_id, label, v)``,
    those with an id divisible by ``every``: for each of an anchor's first ``positives`` rows of its label, the first ``negatives`` rows of other
    labels with ``low * positive_score <= 100 * negative_score <= high * positive_score``."""
    rows = cut(rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.*"))
    width, n = rows.agg(F.max(F.size("v")), F.count("*")).first()
    index = Index(rows, max(positives + 1, negatives), width or 0, n)
    anchors = rows.where(F.col("vec_id") % every == 0)

    def best_positives(scores: np.ndarray, ids: np.ndarray, labels: np.ndarray, asked: pa.Table) -> list[tuple]:
        out = []
        for q, label, row in zip(asked["vec_id"].to_pylist(), asked["label"].to_pylist(), scores, strict=True):
            own = np.flatnonzero((labels == label) & (ids != q))
            if len(own):
                out.append((q, 0, _first(row[own], ids[own], positives)))
        return out

    def best_negatives(scores: np.ndarray, ids: np.ndarray, labels: np.ndarray, asked: pa.Table) -> list[tuple]:
        out = []
        for q, label, tops, row in zip(asked["vec_id"].to_pylist(), asked["label"].to_pylist(), asked["tops"].to_pylist(), scores, strict=True):
            other = np.flatnonzero((labels != label) & (100 * row >= low * min(tops)) & (100 * row <= high * max(tops)))
            own, names = row[other], ids[other]
            for w, top in enumerate(tops):
                fit = np.flatnonzero((100 * own >= low * top) & (100 * own <= high * top))
                if len(fit):
                    out.append((q, w, _first(own[fit], names[fit], negatives)))
        return out

    none = F.lit(None).cast("array<long>").alias("tops")
    last = lambda f, k: F.when(F.size(f) >= k, F.element_at(f, k).score.cast("double"))
    first = _search(index, anchors.select("vec_id", "label", "v", none), best_positives, F.array(F.lit(0)), positives, lambda found: last(found[0], positives))
    own = first.select("vec_id", "label", "v", F.col("found")[0].alias("own")).select("*", F.array_distinct(F.transform("own", lambda p: p.score)).alias("tops"))
    own = cut(own.withColumn("tops", F.filter("tops", lambda s: low * s <= high * s)))

    def threshold(found: Column) -> Column:
        """The least, over the windows, of the last score that counts: the window's foot while it is not full."""
        each = F.zip_with("tops", found, lambda top, f: F.coalesce(last(f, negatives), F.ceil(low * top / F.lit(100)).cast("double")))
        return F.array_min(each)

    asked = own.where(F.size("tops") > 0).select("vec_id", "label", "v", "tops")
    below = _search(index, asked, best_negatives, F.col("tops"), negatives, threshold)
    pairs = own.select("vec_id", F.explode("own").alias("p")).join(below.select("vec_id", "tops", "found"), "vec_id")
    at = F.nullif(F.array_position("tops", F.col("p.score")), F.lit(0))  # 0: the score is negative and has no window
    lists = pairs.select("vec_id", "p", F.try_element_at("found", at.cast("int")).alias("n"))
    ranked = lists.where("n is not null").select("vec_id", "p", F.posexplode("n").alias("at", "n"))
    return ranked.select(
        F.col("vec_id").alias("anchor_id"), F.col("p.id").alias("positive_id"), (F.col("at") + 1).cast("int").alias("rank"),
        F.col("n.id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("n.score").alias("negative_score"),
    )


SQL = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS own, list_inner_product(a.v, b.v)::BIGINT AS s FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), pos AS (
    SELECT a, b AS p, s AS ps FROM scored WHERE own QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5
), neg AS (
    SELECT pos.a, p, ps, n.b AS n, n.s AS ns, row_number() OVER (PARTITION BY pos.a, p ORDER BY n.s DESC, n.b) AS r
    FROM pos JOIN scored n ON n.a = pos.a AND NOT n.own AND 80 * ps <= 100 * n.s AND 100 * n.s <= 100 * ps
)
SELECT a AS anchor_id, p AS positive_id, r::INTEGER AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM neg WHERE r <= 5
"""
