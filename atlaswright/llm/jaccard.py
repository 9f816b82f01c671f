"""Exact Jaccard self-join of word n-gram sets, to connected components.

Set relations do the skipping. Equal sets are one set. The others are indexed under their
prefixes (the ``n - ceil(t n) + 1`` first of their ``n`` shingles, of which any linked pair
shares one) in an order that puts the rarest shingles first. A short posting list is
skipped through by position: a pair survives only if what both sets hold behind its two
positions can still reach the overlap that the threshold asks for. The members of a long
list become a family. In a family, answers come from those of highly similar sets: all
members are first held against a pivot block; whoever is linked, directly or through
others, to the family's largest component needs no comparison inside it any more, and only
the rest are compared with every member of near enough size. Either way only links that
join something go out, so no group emits all its pairs.

Shingles are 64-bit hashes, set identities 128-bit ones.

Edge cases: a null or empty text, or one without words, has an empty set and is linked
with nothing; a text of fewer words than ``width`` is one shingle; rows without ``doc_id``
are left out; rows that repeat a ``doc_id`` are rows of one document, linked through it;
an empty table gives no rows; other columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, hashing
from .common import cut, join_copies, min_label

WIDTH = 4
THRESHOLD = (85, 100)
#: Posting lists up to this length are paired, longer ones make families.
SHORT = 8
#: Members of a block of a family.
BLOCK = 256


_BLANK = np.isin(np.arange(256), [32, *range(9, 14)])


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of ``raw``, and where it starts."""
    x = np.frombuffer(raw, np.uint8)
    word = np.r_[False, ~_BLANK[x], False]
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edges[::2], edges[1::2]
    return hashing.of_ranges(x, starts, ends), starts


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, as int64; about a megabyte at a time."""
    return _in_parts([(t or "").encode("utf-8", "surrogatepass") for t in texts], width)


def _in_parts(texts: list[bytes], width: int) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    first, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text)
        if size > 1_000_000 or k + 1 == len(texts):
            out += _sets(texts[first : k + 1], width)
            first, size = k + 1, 0
    return out


def _sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    h, starts = word_hashes(b"\n".join(texts).lower())
    ends = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))  # words before each text's end
    rolled = np.full(max(0, len(h) - width + 1), width, np.uint64)
    for k in range(width):
        rolled = hashing.mixed(rolled * np.uint64(hashing.BASE) + h[k : k + len(rolled)])
    out, a = [], 0
    for b in ends.tolist():
        if b - a >= width:
            grams = rolled[a : b - width + 1]
        else:  # fewer words than a shingle has: all of them are one
            grams = np.zeros(min(1, b - a), np.uint64)
            for k in range(a, b):
                grams = hashing.mixed(grams * np.uint64(hashing.BASE) + h[k] + np.uint64(b - a))
        out.append(np.unique(grams.view(np.int64)))
        a = b
    return out


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    return shingle_sets([text], width)[0]


def _identity(grams: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    raw = grams.tobytes()
    return tuple(int(np.uint64(xxhash.xxh64_intdigest(raw, k)).astype(np.int64)) if raw else 0 for k in (1, 2))


def prefix_size(n: int, threshold: tuple[int, int] = THRESHOLD) -> int:
    return n + (-threshold[0] * n // threshold[1]) + 1


def _texts(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def set_table(docs: DataFrame, width: int, threshold: tuple[int, int]) -> DataFrame:
    """Rows ``(doc_id, n, s, t, prefix)``: a set's size and identity, and those shingles of its
    prefix that another set has too, each with its place.

    Prefixes are in order of how many documents have a shingle (up to 255), then of hash;
    the counts come from all documents, by 32 bits of hash and the bucket: whatever falls
    together there counts together, so that the order is the same everywhere."""
    spark = docs.sparkSession
    table = cut(blocks.blocks(docs))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table.count() // 8))

    def distinct(row: dict) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        ids, sizes, raw = blocks.opened(row)
        stops = np.cumsum(sizes).tolist()
        sets = _in_parts([raw[b - a : b] for a, b in zip(sizes.tolist(), stops, strict=True)], width)
        values, number, counts = np.unique(np.concatenate([*sets, np.zeros(0, np.int64)]), return_inverse=True, return_counts=True)
        return ids, sets, values.view(np.uint64), number, counts

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in blocks.rows_of(batches):
            _, _, values, _, counts = distinct(row)
            order, bucket, rest = blocks.by_bucket(values, parts)
            counts = np.minimum(counts, 255).astype(np.uint8)[order]
            out = [(row["block"], b, rest[lo:hi].tobytes() + counts[lo:hi].tobytes()) for b, lo, hi in blocks.runs(bucket)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["block", "bucket", "sent"])

    def compare(rows: list[dict]) -> list[tuple]:
        size = [len(r["sent"]) // 5 for r in rows]
        rest = np.concatenate([np.frombuffer(r["sent"], np.uint32, n) for r, n in zip(rows, size, strict=True)])
        counts = np.concatenate([np.frombuffer(r["sent"], np.uint8, n, 4 * n) for r, n in zip(rows, size, strict=True)])
        order = np.argsort(rest)
        first = np.flatnonzero(np.r_[True, rest[order][1:] != rest[order][:-1]])
        total = np.minimum(np.add.reduceat(counts[order].astype(np.int64), first), 255).astype(np.uint8)
        known = np.empty(len(rest), np.uint8)
        known[order] = np.repeat(total, np.diff(np.r_[first, len(rest)]))
        ends = np.cumsum([0, *size])
        return [(r["block"], r["bucket"], blocks.pack(known[a:b])) for r, a, b in zip(rows, ends[:-1], ends[1:], strict=True)]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in blocks.rows_of(batches):
            ids, sets, values, number, _ = distinct(row)
            order, bucket, _ = blocks.by_bucket(values, parts)
            counts = np.ones(len(values), np.uint8)
            of = {a["bucket"]: a["answer"] for a in row["counts"] or []}
            for b, lo, hi in blocks.runs(bucket):
                counts[order[lo:hi]] = np.frombuffer(blocks.unpack(of[b]), np.uint8)
            out: list[list] = [[], [], []]
            found, at = [], 0
            for g in sets:
                n = len(g)
                for x, column in zip((n, *_identity(g)), out, strict=True):
                    column.append(x)
                c = counts[number[at : at + n]]
                at += n
                places = np.lexsort((g, c))[: prefix_size(n, threshold)] if n else np.zeros(0, np.int64)
                shared = np.flatnonzero(c[places] > 1)
                found.append((g[places[shared]], shared))
            ends = np.cumsum([0, *(len(p) for p, _ in found)]).astype(np.int32)
            items = pa.StructArray.from_arrays([pa.array(np.concatenate([f[k] for f in found])) for k in (0, 1)], ["g", "pos"])
            yield pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(np.array(c, np.int64)) for c in out), pa.ListArray.from_arrays(pa.array(ends), items)], ["doc_id", "n", "s", "t", "prefix"])

    counted = blocks.answers(table.mapInArrow(send, blocks.SENT), parts, compare)
    return blocks.answered(table, counted, "counts").mapInArrow(build, "doc_id long, n long, s long, t long, prefix array<struct<g:long,pos:long>>")


def candidates(postings: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Edges ``(a, b, family)`` of ``postings(g, rep, n, pos)``: pairs of short lists that
    length and position allow; for long ones a star for each run of near sizes."""
    num, den = threshold

    def short(rep: np.ndarray, n: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i, j = np.triu_indices(len(rep), 1)  # sizes rise
        need = -(-num * (n[i] + n[j]) // (num + den))
        reach = np.minimum(n[i] - pos[i], n[j] - pos[j])  # from its position on, counting from 0
        ok = (den * n[i] >= num * n[j]) & (reach >= need) & (rep[i] != rep[j])
        return rep[i][ok], rep[j][ok]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: tuple[np.ndarray, ...] = tuple(np.zeros(0, np.int64) for _ in range(4))
        star: tuple[int, int, int] | None = None  # shingle, head and last size of a long list that goes on
        seen: set[tuple[int, int]] = set()
        for batch in _and_end(batches):
            cols = rest if batch is None else tuple(np.concatenate([r, batch.column(k).to_numpy()]) for k, r in enumerate(rest))
            g, rep, n, pos = cols
            starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
            ends = np.r_[starts[1:], len(g)][: len(starts)]
            last = len(starts) - 1
            out: list[tuple[int, int, bool]] = []
            rest = tuple(c[:0] for c in cols)
            for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
                going = star is not None and star[0] == g[a]
                if not going and b - a <= SHORT:
                    if k == last and batch is not None:
                        rest = tuple(c[a:b] for c in cols)  # may go on in the next batch
                    elif b - a > 1:
                        x, y = short(rep[a:b], n[a:b], pos[a:b])
                        out += [(int(min(p, q)), int(max(p, q)), False) for p, q in zip(x, y, strict=True)]
                    continue
                head, size = (star[1], star[2]) if going else (int(rep[a]), int(n[a]))
                for r, m in zip(rep[a:b].tolist(), n[a:b].tolist(), strict=True):
                    if num * m > den * size:  # nothing before is large enough for what follows
                        head = r
                    size = m
                    if r != head:
                        out.append((min(r, head), max(r, head), True))
                star = (int(g[a]), head, size)
            fresh = [e for e in dict.fromkeys(out) if (e[0], e[1]) not in seen or e[2]]
            seen.update((e[0], e[1]) for e in fresh)
            if len(seen) > 1_000_000:
                seen.clear()
            if fresh:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*fresh, strict=True)], ["a", "b", "family"])

    return postings.repartition("g").sortWithinPartitions("g", "n", "rep").select("g", "rep", "n", "pos").mapInArrow(run, "a long, b long, family boolean")


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, label: np.ndarray, threshold: tuple[int, int]) -> list[tuple[int, int]]:
    """Index pairs of a forest that joins the linked sets: ``left`` against ``right``, pairs
    of one label left out."""
    num, den = threshold
    size = np.array([len(s) for s in sets])
    a, b = np.flatnonzero(left), np.flatnonzero(right)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)
    values, column, counts = np.unique(flat, return_inverse=True, return_counts=True)
    shared = counts[column] > 1
    number = np.cumsum(counts > 1) - 1
    owner, column, width = owner[shared], number[column[shared]], int((counts > 1).sum())
    inter = np.zeros((len(a), len(b)), np.float32)
    step = max(1, 4_000_000 // max(1, len(sets)))
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for at in range(0, width, step):
        lo, hi = np.searchsorted(column, [at, at + step])
        m = np.zeros((len(sets), min(step, width - at)), np.float32)
        m[owner[lo:hi], column[lo:hi] - at] = 1
        inter += m[a] @ m[b].T
    inter = inter.astype(np.float64)
    union = size[a][:, None] + size[b][None, :] - inter
    i, j = np.nonzero((den * inter >= num * union) & (label[a][:, None] != label[b][None, :]))
    root = list(range(len(sets)))
    by_label: dict[int, int] = {}
    for k, x in enumerate(label.tolist()):
        root[k] = by_label.setdefault(x, k)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(a[i].tolist(), b[j].tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def verify(tasks: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Links ``(a, b)`` of ``tasks(task, rep, label, left, right, grams)``: each task's left
    members against its right ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> list[tuple[int, int]]:
            table = pa.Table.from_batches(held).combine_chunks()
            rep = table.column("rep").to_numpy()
            sets = [np.frombuffer(x, np.int64) for x in table.column("grams").to_pylist()]
            flags = [np.array(table.column(c).to_pylist(), bool) for c in ("left", "right")]
            return [(int(rep[i]), int(rep[j])) for i, j in _links(sets, *flags, table.column("label").to_numpy(), threshold)]

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("task").to_numpy(zero_copy_only=False)
            starts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            out = []
            for a, b in zip(starts, starts[1:], strict=False):
                if held and held[0].column("task")[0].as_py() != key[a]:
                    out += flush()
                    held.clear()
                held.append(batch.slice(a, b - a))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])
        if held and (out := flush()):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    return tasks.repartition("task").sortWithinPartitions("task", "rep").select("task", "rep", "label", "left", "right", "grams").mapInArrow(run, "a long, b long")


def _family_links(families: DataFrame, grams: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Links inside ``families(rep, label)``, whose sets are ``grams(rep, n, grams)``."""
    num, den = threshold
    # members of linked sizes are in the same size class or in neighbouring ones
    klass = F.floor(F.log(F.col("n")) / float(np.log(den / num)) + 1e-9)
    members = families.withColumnRenamed("label", "family").join(grams.select("rep", "n"), "rep").withColumn("class", klass)
    total = members.groupBy("family").agg(F.count("*").alias("total"))
    cells = members.groupBy("family", "class").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    members = members.join(total, "family").join(cells, ["family", "class"])
    members = cut(members.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks"))))
    yes, no = F.lit(True), F.lit(False)

    def sent(tasks: DataFrame) -> DataFrame:
        return tasks.groupBy("task", "rep", "label").agg(F.bool_or("left").alias("left"), F.bool_or("right").alias("right")).join(grams.select("rep", "grams"), "rep")

    one = members.where(F.col("total") <= BLOCK).select(F.concat_ws("/", F.lit("all"), "family").alias("task"), "rep", F.col("rep").alias("label"), yes.alias("left"), yes.alias("right"))
    big = members.where(F.col("total") > BLOCK)
    cells_of = big.select("family", "class", "block").distinct()
    name = F.concat_ws("/", "family", "of", "from", "class", "block")

    def against(chosen: DataFrame, whole: DataFrame) -> DataFrame:
        """A task for each block of ``chosen(family, class, block, rep, label)`` and each near block of all."""
        pairs = chosen.select("family", F.col("class").alias("of"), F.col("block").alias("from")).distinct()
        pairs = pairs.select("family", "of", "from", F.explode(F.array(*[F.col("of") + k for k in (-1, 0, 1)])).alias("class")).join(cells_of, ["family", "class"])
        left = pairs.join(chosen.select("family", F.col("class").alias("of"), F.col("block").alias("from"), "rep", "label"), ["family", "of", "from"]).select(name.alias("task"), "rep", "label", yes.alias("left"), no.alias("right"))
        right = pairs.join(whole.select("family", "class", "block", "rep", "label"), ["family", "class", "block"]).select(name.alias("task"), "rep", "label", no.alias("left"), yes.alias("right"))
        return left.unionByName(right)

    alone = big.withColumn("label", F.col("rep"))
    pivots = alone.where("block = 0")
    first = cut(verify(sent(one.unionByName(against(pivots, alone))), threshold))
    labels = min_label(first).withColumnRenamed("id", "rep")
    known = big.join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    sizes = known.groupBy("family", "label").count().groupBy("family").agg(F.max(F.struct("count", "label")).alias("m")).select("family", F.col("m.label").alias("core"))
    known = cut(known.join(sizes, "family"))
    rest = known.where("label <> core").select("family", "class", "rep", "label")
    counts = rest.groupBy("family", "class").agg(F.ceil(F.count("*") / BLOCK).alias("k"))
    rest = rest.join(counts, ["family", "class"]).select("family", "class", F.pmod(F.xxhash64("rep"), F.col("k")).alias("block"), "rep", "label")
    return first.union(verify(sent(against(rest, known)), threshold))


#: Further sets of a ``doc_id`` that several rows with different texts have get ids from here downwards.
_FURTHER = (1 << 63) - 1


def _members(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The non-empty sets with a ``member`` id: their ``doc_id``, but for the further sets of an
    id that has several (which are returned too), so that every id names one set."""
    full = sets.where("n > 0")
    first = full.groupBy("doc_id").agg(F.min(F.struct("s", "t")).alias("first"), F.max(F.struct("s", "t")).alias("last")).where("first <> last").select("doc_id", "first")
    further = full.join(first, "doc_id").where(F.struct("s", "t") != F.col("first")).select("doc_id", "s", "t").distinct()
    further = cut(further.withColumn("member", F.lit(_FURTHER) - F.monotonically_increasing_id()))
    return full.join(further, ["doc_id", "s", "t"], "left").withColumn("member", F.coalesce("member", "doc_id")), further


def join(docs: DataFrame, width: int = WIDTH, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """Rows ``(doc_id, n_shingles, component_id)``, one per row of ``docs`` with an id."""
    sets = cut(set_table(docs, width, threshold))
    members, further = _members(sets)
    least = F.min(F.struct("member", "doc_id"))
    classes = cut(members.groupBy("s", "t", "n").agg(least.alias("m"), F.count("*").alias("copies")).select("s", "t", "n", F.col("m.member").alias("rep"), F.col("m.doc_id").alias("of"), "copies"))
    full = sets.where("n > 0").select("doc_id", "s", "t", "n")
    of = cut(join_copies(full, classes.select("s", "t", "n", "rep", "copies"), ["s", "t", "n"], "copies", full.count()).select("doc_id", "rep").distinct())
    heads = classes.select(F.col("of").alias("doc_id"), "s", "t", "n", "rep")
    postings = sets.join(heads, ["doc_id", "s", "t", "n"]).dropDuplicates(["rep"]).select("rep", "n", F.inline("prefix"))
    edges = cut(candidates(postings, threshold))
    families = cut(min_label(edges.where("family").select("a", "b")))
    of_a, of_b = (families.select(F.col("id").alias(c), F.col("label").alias(f"f{c}")) for c in "ab")
    pairs = edges.where("not family").select("a", "b").distinct().join(of_a, "a", "left").join(of_b, "b", "left").where("fa is null or fb is null or fa <> fb").select("a", "b")
    pairs = cut(pairs)
    needed = families.select(F.col("id").alias("rep")).union(pairs.select("a")).union(pairs.select("b")).distinct()
    needed = cut(heads.join(needed, "rep"))

    def grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = shingle_sets(batch.column(1).to_pylist(), width)
            names = [[_identity(g)[k] for g in got] for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in names), pa.array([g.tobytes() for g in got], pa.binary())], ["doc_id", "s", "t", "grams"])

    sent = _texts(docs).join(needed.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(grams_of, "doc_id long, s long, t long, grams binary")
    grams = cut(sent.join(needed, ["doc_id", "s", "t"]).select("rep", "n", "grams").dropDuplicates(["rep"]))
    task = F.concat_ws("-", "a", "b").alias("task")
    both = pairs.select(task, F.explode(F.array("a", "b")).alias("rep"))
    both = both.select("task", "rep", F.col("rep").alias("label"), F.lit(True).alias("left"), F.lit(True).alias("right")).join(grams.select("rep", "grams"), "rep")
    links = verify(both, threshold).union(_family_links(families.withColumnRenamed("id", "rep"), grams, threshold))
    # rows that repeat a doc_id with other texts tie their classes together
    several = of.join(further.select("doc_id").distinct(), "doc_id")
    twice = several.join(several.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").select("a", F.col("rep").alias("b")).where("a <> b")
    labels = min_label(links.union(twice))
    named = of.join(labels.withColumnRenamed("id", "rep"), "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("label", "rep")).alias("component_id"))
    return sets.select("doc_id", F.col("n").alias("n_shingles")).join(named, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
