"""Benchmark decontamination in DataFrame functions alone.

A document is read in windows of as many words as a benchmark item has. The 64-bit SimHash
of such a window is kept up as it slides: every five-word shingle adds its bits, packed into
lanes of a few longs, at its own place and takes them off a window later, so that running
sums give every window's counts. A window of ``n`` words is looked up among all items of
``n`` words through eight one-byte blocks: fingerprints within ``RADIUS`` = 23 bits differ by
at most two bits in some block, and the index holds every item block with up to two bits
flipped. Of the pairs within the radius, those whose shingles, weighted by how often they
occur, have at least ``SIMILARITY`` of the union's weight in common are matches.

Two counts come before that, and lose no match whatever its order of words: a match of
similarity 4/5 has 4/5 of the item's shingles in it, so only documents with that many
places at which a shingle of some item of ``n`` words stands are fingerprinted, and of
their windows only those that hold enough such places are looked up.

A pair at similarity 0.8 exactly lies beyond the radius with a chance of about one in a
hundred thousand, any closer one with less.

Words are lower-cased runs without white space. An item of fewer than five words is one
shingle; a document shorter than an item is one window. Edge cases: null or empty texts and
items match nothing; documents without ``doc_id`` and items without ``item_id`` are left
out; rows that repeat an id are taken for one document (or item) whose matches are those of
any of them, the most similar window counting, the first of equals; empty tables give no
rows; very long texts are rows of a window function, one a word; other columns are ignored
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

WIDTH = 5
RADIUS = 23
BLOCKS = 8
FLIPS = RADIUS // BLOCKS
SIMILARITY = (4, 5)
#: Up to so many rows of item shingles or blocks (about 40 bytes each) are broadcast; more are shuffled.
BROADCAST_ROWS = 500_000
_BLANKS = " \t\n\r\f\x0b"


def words(text: Column) -> Column:
    text = F.trim(F.lower(text), F.lit(_BLANKS))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, r"[ \t\n\r\f\x0B]+"))


def shingles(ws: Column, width: int = WIDTH) -> Column:
    """The shingles of an array of words in order; fewer words than ``width`` are one; none have none."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(ws) - (width - 1), F.lit(1)))
    return F.when(F.size(ws) > 0, F.transform(starts, lambda i: F.array_join(F.slice(ws, i, width), " "))).otherwise(F.array().cast("array<string>"))


def _run_hash(ws: Column, at: Column, width: int) -> Column:
    """A hash of the ``width`` words of ``ws`` from ``at`` (from 0) on."""
    return F.xxhash64(F.lit(width), *[F.get(ws, at + k) for k in range(width)])


def placed(rows: DataFrame, widths: list[int], keep: list[str]) -> DataFrame:
    """Rows ``(*keep, width, at, h)``: the hash of every run of each width in ``ws``."""
    each = rows.select(*keep, "ws", F.posexplode("ws").alias("at", "word"))
    runs = [F.when(F.col("at") + w <= F.size("ws"), F.struct(F.lit(w).alias("width"), _run_hash(F.col("ws"), F.col("at"), w).alias("h"))) for w in widths]
    if len(widths) == 1:
        each = each.where(F.col("at") + widths[0] <= F.size("ws"))
        return each.select(*keep, F.lit(widths[0]).alias("width"), "at", _run_hash(F.col("ws"), F.col("at"), widths[0]).alias("h"))
    return each.select(*keep, "at", F.inline(F.array_compact(F.array(*runs)))).select(*keep, "width", "at", "h")


class Lanes:
    """64 counters in longs: ``per`` lanes of ``bits`` bits each, so that packed counts add and
    subtract as plain longs. The upper half of a lane is kept free for comparing."""

    def __init__(self, largest: int):
        self.bits = next(b for b in (10, 21, 31) if largest < 1 << b - 1)
        self.per = 63 // self.bits
        self.names = [f"lane{k}" for k in range(-(-64 // self.per))]

    def _bits_of(self, k: int) -> list[tuple[int, int]]:
        """``(bit of the hash, place in the long)`` of the lanes of long ``k``."""
        return [(b, (b - k * self.per) * self.bits) for b in range(k * self.per, min(64, (k + 1) * self.per))]

    def spread(self, h: Column) -> list[Column]:
        """The bits of a hash, each in a lane of its own."""
        out = []
        for k, name in enumerate(self.names):
            x = F.lit(0).cast("long")
            for b, to in self._bits_of(k):
                x = x.bitwiseOR(F.shiftleft(F.shiftrightunsigned(h, b).bitwiseAND(F.lit(1).cast("long")), to))
            out.append(x.alias(name))
        return out

    def above_half(self, size: Column) -> Column:
        """The fingerprint: bits whose lane counts more than half of ``size``."""
        fp = F.lit(0).cast("long")
        for k, name in enumerate(self.names):
            ones = sum(1 << to for _, to in self._bits_of(k))
            carried = F.col(name) + F.lit(ones) * (F.lit((1 << self.bits - 1) - 1) - F.floor(size / 2))
            for b, to in self._bits_of(k):
                fp = fp.bitwiseOR(F.shiftleft(F.shiftrightunsigned(carried, to + self.bits - 1).bitwiseAND(F.lit(1).cast("long")), b))
        return fp


def block(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * k).bitwiseAND(F.lit(255)).cast("int")


def masks() -> list[int]:
    """Every byte of at most ``FLIPS`` set bits."""
    return [m for m in range(256) if m.bit_count() <= FLIPS]


def weight_in_common(a: Column, b: Column) -> Column:
    """Occurrences that two arrays of shingles have in common; where one repeats none, as most
    do, those are the different ones in common."""
    times = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    once = lambda xs: F.size(F.array_distinct(xs)) == F.size(xs)
    both = F.array_intersect(a, b)
    return F.when(once(a) | once(b), F.size(both)).otherwise(F.aggregate(both, F.lit(0), lambda n, x: n + F.least(times(a, x), times(b, x))))


def _sized(rows: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(rows) if few else rows.hint("merge")


def windows(texts: DataFrame, sizes: DataFrame, known: DataFrame, widths: list[int], lanes: Lanes) -> DataFrame:
    """Rows ``(doc_id, th, n, window_start, fp)``: the windows of ``n`` words of
    ``texts(doc_id, th, ws)``, for the ``n`` that ``sizes(doc_id, th, n, width, m)`` names, which hold
    enough places of ``known(h, n)``."""
    num, den = SIMILARITY
    keep = ["doc_id", "th", "n", "m", "grams"]
    each = texts.join(sizes, ["doc_id", "th"]).withColumn("grams", F.size("ws") - F.col("width") + 1).where("grams > 0")
    at = placed(each.select("doc_id", "th", "n", "m", "grams", F.col("width").alias("own"), "ws"), widths, [*keep, "own"]).where("width = own")
    at = at.join(known.withColumn("hit", F.lit(1)), ["h", "n"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    # what comes in at its place goes out a window later
    moves = at.select(*keep, "hit", *lanes.spread(F.col("h")), F.explode(F.array(F.struct("at", F.lit(1).alias("sign")), F.struct((F.col("at") + F.col("m")).alias("at"), F.lit(-1).alias("sign")))).alias("e"))
    moves = moves.select(*keep, "e.at", "e.sign", *[(F.col(c) * F.col("e.sign")).alias(c) for c in ("hit", *lanes.names)]).where("at < grams")
    so_far = Window.partitionBy("doc_id", "th", "n").orderBy("at")
    sums = moves.select(*keep, "at", "sign", *[F.coalesce(F.sum(c).over(so_far), F.lit(0)).alias(c) for c in ("hit", *lanes.names)])
    size = F.least("m", "grams")
    full = sums.where((F.col("sign") == 1) & (F.col("at") >= size - 1) & (F.col("hit") * (num + den) >= num * (size + F.col("m"))))
    return full.select("doc_id", "th", "n", (F.col("at") - size + 1).alias("window_start"), lanes.above_half(size).alias("fp"))


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows ``(doc_id, item_id, window_start, in_common, in_union)``: for each document and
    item the most similar window, the first of equals; ``window_start`` counts words from 0."""
    num, den = SIMILARITY
    items = items.where("item_id is not null").select("item_id", words(F.col("text").cast("string")).alias("ws")).where("size(ws) > 0").distinct()
    items = items.select("item_id", F.monotonically_increasing_id().alias("row"), "ws", F.size("ws").alias("n"), F.least(F.size("ws"), F.lit(WIDTH)).alias("width"))
    items = cut(items.withColumn("m", F.col("n") - F.col("width") + 1))
    widths = [r[0] for r in items.select("width").distinct().orderBy("width").collect()] or [WIDTH]  # at most five
    n_items, largest = items.agg(F.count("*"), F.coalesce(F.max("m"), F.lit(1))).first()
    lanes = Lanes(largest)

    grams = placed(items.withColumnRenamed("width", "own"), widths, ["row", "item_id", "n", "m", "own"]).where("width = own")
    known = grams.select("h", "n", "m").distinct()
    few = known.count() <= BROADCAST_ROWS

    docs = docs.where("doc_id is not null").select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("th"), words(F.col("text").cast("string")).alias("ws")).where("size(ws) > 0")
    hits = placed(docs, widths, ["doc_id", "th"]).join(_sized(known, few), "h").groupBy("doc_id", "th", "n", "m").agg(F.countDistinct("at").alias("hits") if len(widths) > 1 else F.count("*").alias("hits"))
    sizes = cut(hits.where(F.col("hits") * den >= F.col("m") * num).select("doc_id", "th", "n", "m", F.least("n", F.lit(WIDTH)).alias("width")))
    texts = cut(docs.join(sizes.select("doc_id", "th").distinct(), ["doc_id", "th"], "left_semi").dropDuplicates(["doc_id", "th"]))
    found = cut(windows(texts, sizes, _sized(known.select("h", "n"), few), widths, lanes))

    prints = grams.select("row", "m", *lanes.spread(F.col("h"))).groupBy("row", "m").agg(*[F.sum(c).alias(c) for c in lanes.names])
    items = cut(items.join(prints.select("row", lanes.above_half(F.col("m")).alias("item_fp")), "row"))
    byte = lambda fp: F.posexplode(F.array(*[block(F.col(fp), k) for k in range(BLOCKS)])).alias("k", "byte")
    index = items.select("row", "n", "item_fp", byte("item_fp"))
    index = index.select("row", "n", "item_fp", "k", F.explode(F.transform(F.array(*map(F.lit, masks())), lambda x: F.col("byte").bitwiseXOR(x))).alias("byte"))
    probes = found.select("*", byte("fp")).join(_sized(index, n_items * BLOCKS * len(masks()) <= BROADCAST_ROWS), ["n", "k", "byte"])
    near = probes.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS).select("doc_id", "th", "row", "window_start").distinct()

    near = near.join(items.select("row", "item_id", "n", shingles(F.col("ws")).alias("item_grams")), "row").join(texts, ["doc_id", "th"])
    near = near.withColumn("grams", shingles(F.slice("ws", F.col("window_start") + 1, F.col("n"))))
    near = near.withColumn("in_common", weight_in_common(F.col("grams"), F.col("item_grams")).cast("long"))
    near = near.withColumn("in_union", F.size("grams") + F.size("item_grams") - F.col("in_common"))
    good = near.where(F.col("in_common") * den >= F.col("in_union") * num)
    best = F.max(F.struct((F.col("in_common") / F.col("in_union")).alias("s"), (-F.col("window_start")).alias("from"), "in_common", "in_union"))
    return good.groupBy("doc_id", "item_id").agg(best.alias("m")).select("doc_id", "item_id", (-F.col("m.from")).cast("long").alias("window_start"), "m.in_common", F.col("m.in_union").cast("long").alias("in_union"))


#: All windows that share a shingle with an item (any other has similarity 0).
SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \t\n\r\f\x0B]+'), lambda x: x <> '') AS ws FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[ \t\n\r\f\x0B]+'), lambda x: x <> '') AS ws FROM benchmark WHERE item_id IS NOT NULL),
i AS (SELECT item_id, len(ws) AS n, least(len(ws), 5) AS width, list_transform(range(0, greatest(len(ws) - 4, 1)), lambda k: array_to_string(ws[k + 1 : k + 5], ' ')) AS grams FROM b WHERE len(ws) > 0),
a AS (SELECT DISTINCT item_id, n, width, len(grams) AS m, unnest(grams) AS g FROM i),
e AS (SELECT doc_id, w.width, len(ws) AS total, unnest(list_transform(range(0, len(ws) - w.width + 1), lambda k: array_to_string(ws[k + 1 : k + w.width], ' '))) AS g,
             unnest(range(0, len(ws) - w.width + 1)) AS doc_at
      FROM d, (SELECT DISTINCT width FROM i) w WHERE len(ws) >= w.width),
h AS (SELECT doc_id, item_id, n, total, unnest(range(greatest(least(doc_at - m + 1, total - n), 0), least(doc_at, greatest(total - n, 0)) + 1)) AS window_start
      FROM e JOIN a USING (width, g)),
w AS (SELECT doc_id, item_id, n, window_start FROM h GROUP BY ALL HAVING 5 * count(*) >= 4 * greatest(least(n, any_value(total)) - 4, 1)),
x AS (SELECT doc_id, item_id, window_start, ws[window_start + 1 : window_start + n] AS v FROM w JOIN d USING (doc_id)),
y AS (SELECT doc_id, item_id, window_start, list_transform(range(0, greatest(len(v) - 4, 1)), lambda k: array_to_string(v[k + 1 : k + 5], ' ')) AS vg FROM x),
z AS (SELECT doc_id, y.item_id, window_start, len(vg) + len(i.grams) AS total,
             list_sum(list_transform(list_distinct(vg), lambda t: least(len(list_filter(vg, lambda u: u = t)), len(list_filter(i.grams, lambda u: u = t))))) AS c
      FROM y JOIN i ON y.item_id = i.item_id)
SELECT doc_id, item_id, window_start::BIGINT AS window_start, c::BIGINT AS in_common, (total - c)::BIGINT AS in_union
FROM z WHERE 5 * c >= 4 * (total - c)
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY c / (total - c) DESC, window_start) = 1
"""
