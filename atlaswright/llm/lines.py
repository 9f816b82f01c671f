"""Line dedup by a segment-partition edit join, in DataFrame functions alone.

A line goes when an earlier line (of a smaller ``doc_id``, or further up in the same
document) equals it or, if it has at least ``MIN_CHARS`` characters, is within ``DISTANCE``
edits of it, judged on the input. Candidates come from the pigeonhole on segments: a line
cut into ``DISTANCE + 1`` even segments shares at least one whole segment with any line that
near, at a place shifted by no more than the edits allow. So every line is indexed under
(length, segment number, segment), and probes, for each length from ``DISTANCE`` shorter to
its own, the substrings that can be the segment (multi-match-aware windows). Lines alone
under all their keys, most of them, drop out there. The others meet only if their counts of
sixteen letters are no further apart than the edits allow, and are then verified by a banded
bit-parallel automaton.

Line copies share one hash and meet once per task before they are shuffled, so a line of
millions of copies is a single row of the join. The first places of the most frequent lines
are sent to every task, those of the others are joined; a key under which very many lines
meet is left to adaptive execution, which splits such partitions of the join.

Edge cases: null and empty texts have no lines; lines of blanks alone are never removed;
documents without ``doc_id`` are left out; rows that repeat a ``doc_id`` count as one
document, so a line does not remove its own copy at the same place there; lines of any
length are compared whole; an empty table gives no rows; other columns are ignored whatever
their names. ``without`` keeps rows without ``doc_id`` as they are, and takes the same lines out of
all rows that repeat an id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_copies, unused

DISTANCE = 2
#: Shorter lines go as copies only: two edits make another word of them.
MIN_CHARS = 20


def lines_of(docs: DataFrame) -> DataFrame:
    """Rows ``(doc_id, line_no, line)`` of the lines that are not blank; numbers from 0."""
    lines = docs.where("doc_id is not null").select("doc_id", F.posexplode(F.split(F.col("text").cast("string"), "\n", -1)).alias("line_no", "line"))
    return lines.where(F.col("line").rlike(r"[^ \t\n\x0B\f\r]"))


def _segments(length: Column, parts: int) -> list[tuple[Column, Column]]:
    """Start (from 0) and length of even segments; the last ones are a character longer."""
    short = F.floor(length / parts).cast("int")
    longer = length % parts
    out = []
    for k in range(parts):
        # the first ``parts - longer`` have ``short`` characters
        extra = F.greatest(F.lit(k) - (F.lit(parts) - longer), F.lit(0))
        size = short + F.when(F.lit(k) >= F.lit(parts) - longer, 1).otherwise(0)
        out.append((short * k + extra, size))
    return out


def _key(length: Column, part: int, line: Column, start: Column, size: Column) -> Column:
    return F.xxhash64(length, F.lit(part), F.substring(line, start + 1, size))


def index_keys(line: Column, n: Column, distance: int) -> Column:
    """Keys of the even segments of a line of ``n`` characters."""
    return F.array(*[_key(n, k, line, s, z) for k, (s, z) in enumerate(_segments(n, distance + 1))])


def probe_keys(line: Column, n: Column, distance: int) -> Column:
    """Keys under which other lines up to ``distance`` characters shorter, or as long, may
    lie, without those of the line's own segments."""
    out = []
    for less in range(distance + 1):
        for k, (s, z) in enumerate(_segments(n - less, distance + 1)):
            # shifts by which both what is left and what is right of the segment stay within the edits
            low, high = max(-k, less - (distance - k)), min(k, less + (distance - k))
            for shift in range(low, high + 1):
                if less or shift:
                    out.append(F.when((s + shift >= 0) & (s + shift + z <= n), _key(n - less, k, line, s + shift, z)))
    return F.array_compact(F.array(*out))


#: Characters whose counts tell lines apart before they are paired.
SIGNED = "etanorishdluwbcm"


def signature(line: Column, n: Column) -> Column:
    """How often each of ``SIGNED`` occurs, four bits each (modulo 16)."""
    out = F.lit(0).cast("long")
    for k, c in enumerate(SIGNED):
        count = (n - F.length(F.replace(line, F.lit(c), F.lit("")))).bitwiseAND(F.lit(15)).cast("long")
        out = out.bitwiseOR(F.shiftleft(count, 4 * k))
    return out


def may_be_near(a: Column, b: Column, distance: int) -> Column:
    """Whether two signatures can be ``distance`` edits apart: an edit adds one character at
    most and takes one away at most, so neither the gains nor the losses exceed it."""
    gains, losses = F.lit(0), F.lit(0)
    for k in range(len(SIGNED)):
        x, y = (F.shiftrightunsigned(s, 4 * k).bitwiseAND(F.lit(15)).cast("int") for s in (a, b))
        d = (x - y + 8).bitwiseAND(F.lit(15)) - 8
        gains, losses = gains + F.greatest(d, F.lit(0)), losses + F.greatest(-d, F.lit(0))
    return (gains <= distance) & (losses <= distance)


def within(a: Column, b: Column, distance: int) -> Column:
    """Whether two strings are at most ``distance`` edits apart.

    The edit automaton runs on one integer: bit ``e * width + d`` is set when ``e`` edits
    turn the characters of ``a`` read so far into as many of ``b``, shifted by ``d``;
    shifts beyond the distance cannot end well, so a band of ``2 * distance + 1`` does. A
    common head is skipped first, by halving steps."""
    width = 2 * distance + 1
    band = (1 << width) - 1
    low = lambda x: x.bitwiseAND(F.lit(band))
    row = lambda s, e: low(F.shiftright(s, e * width))

    def close(rows: list[Column]) -> Column:
        """The rows of one edit more and more, packed; a character of ``b`` alone costs an edit."""
        packed = rows[0]
        for e in range(1, len(rows)):
            rows[e] = rows[e].bitwiseOR(low(F.shiftleft(rows[e - 1], 1)))
            packed = packed.bitwiseOR(F.shiftleft(rows[e], e * width))
        return packed

    start = 0
    for e in range(distance + 1):
        for d in range(e + 1):
            start |= 1 << (e * width + distance + d)

    def step(s: Column, i: Column, xs: Column, ys: Column) -> Column:
        same = F.lit(0)
        for d in range(-distance, distance + 1):
            hit = F.coalesce(F.get(xs, i) == F.get(ys, i + d), F.lit(False))
            same = same.bitwiseOR(F.when(hit, 1 << (d + distance)).otherwise(0))
        return F.struct(s.alias("s"), same.alias("m"))

    def advance(met: Column) -> Column:
        s, m = met["s"], met["m"]
        rows = [row(s, 0).bitwiseAND(m)]
        for e in range(1, distance + 1):
            before = row(s, e - 1)
            rows.append(row(s, e).bitwiseAND(m).bitwiseOR(before).bitwiseOR(F.shiftright(before, 1)))
        return close(rows)

    def run(pair: Column) -> Column:
        xs, ys = pair["xs"], pair["ys"]
        gap = F.size(ys) - F.size(xs)

        def fold(s: Column, i: Column) -> Column:
            # a one-element transform names the matches, so that they are worked out once
            nxt = F.element_at(F.transform(F.array(step(s, i, xs, ys)), advance), 1)
            return F.when(s == 0, F.lit(0)).otherwise(nxt)

        steps = F.when(F.size(xs) > 0, F.sequence(F.lit(0), F.size(xs) - 1)).otherwise(F.array().cast("array<int>"))
        end = F.aggregate(steps, F.lit(start), fold)
        return (F.abs(gap) <= distance) & (F.call_function("shiftright", end, distance * width + distance + F.least(F.greatest(gap, F.lit(-distance)), F.lit(distance))).bitwiseAND(F.lit(1)) == 1)

    head = F.aggregate(
        F.array(*[F.lit(1 << k) for k in range(20, -1, -1)]),
        F.lit(0),
        lambda at, more: F.when((at + more <= F.least(F.length(a), F.length(b))) & (F.substring(a, at + 1, more) == F.substring(b, at + 1, more)), at + more).otherwise(at),
    )
    chars = lambda x, at: F.filter(F.split(F.substring(x, at + 1, F.length(x)), ""), lambda c: c != "")
    pair = F.transform(F.array(head), lambda at: F.struct(chars(a, at).alias("xs"), chars(b, at).alias("ys")))
    return F.element_at(F.transform(pair, run), 1)


#: Up to so many hashes (of 8 bytes) are broadcast to find their lines; more are shuffled.
BROADCAST_ROWS = 1_000_000


def _hashes() -> tuple[Column, Column]:
    """128 bits that tell lines apart; the first 64 serve as a handle."""
    return F.xxhash64("line").alias("h"), F.xxhash64(F.lit(7), "line").alias("i")


def met(lines: DataFrame, distance: int) -> DataFrame:
    """Rows ``(key, h, own)`` of the keys under which a line indexed there meets another one."""
    own = distance + 1
    once = lines.select(*_hashes(), "line").groupBy("h", "i").agg(F.first("line").alias("line"))  # copies fall together before keys are made
    once = once.select("h", "line", F.length("line").alias("n"))
    keyed = once.select("h", F.posexplode(F.concat(index_keys(F.col("line"), F.col("n"), distance), probe_keys(F.col("line"), F.col("n"), distance))).alias("pos", "key"))
    under = Window.partitionBy("key")
    keyed = keyed.select("key", "h", (F.col("pos") < own).alias("own"), F.min("h").over(under).alias("least"), F.max("h").over(under).alias("most"), F.max(F.col("pos") < own).over(under).alias("indexed"))
    return keyed.where("indexed and least <> most").select("key", "h", "own")


def near_lines(lines: DataFrame, distance: int = DISTANCE, min_chars: int = MIN_CHARS) -> tuple[DataFrame, DataFrame]:
    """Verified pairs ``(line, near)`` of different lines, both ways, and the first place of
    each line that meets another under a key: ``(line, first)``."""
    lines = lines.where(F.length("line") >= min_chars)
    keys = cut(met(lines, distance))
    wanted = cut(keys.select("h").distinct())
    few = wanted.count() <= BROADCAST_ROWS
    texts = lines.select(_hashes()[0], "line", "doc_id", "line_no").join(F.broadcast(wanted) if few else wanted, "h", "left_semi")
    texts = texts.groupBy("h", "line").agg(F.min(F.struct("doc_id", "line_no")).alias("first"))
    texts = cut(texts.withColumn("sig", signature(F.col("line"), F.length("line"))))
    signed = keys.join(texts.select("h", "sig"), "h")
    index = signed.where("own").select("h", "sig", "key")
    probes = signed.select(F.col("h").alias("g"), F.col("sig").alias("gsig"), "key")
    near = (F.col("h") != F.col("g")) & may_be_near(F.col("sig"), F.col("gsig"), distance)
    pairs = cut(index.join(probes, (index["key"] == probes["key"]) & near).select(F.least("h", "g").alias("h"), F.greatest("h", "g").alias("g")).distinct())
    both = pairs.join(texts.select("h", "line"), "h").join(texts.select(F.col("h").alias("g"), F.col("line").alias("near")), "g")
    both = both.where(F.abs(F.length("line") - F.length("near")) <= distance).where(within(F.col("line"), F.col("near"), distance))
    both = cut(both.select("line", "near"))
    return both.union(both.select("near", "line")), texts.select("line", "first")


def removals(docs: DataFrame, distance: int = DISTANCE, min_chars: int = MIN_CHARS) -> DataFrame:
    """Rows ``(doc_id, line_no, kind)`` of the lines to remove: ``copy`` where an earlier line
    equals it, else ``near``."""
    lines = lines_of(docs)
    place = F.struct("doc_id", "line_no")
    near, firsts = near_lines(lines, distance, min_chars)
    # of a line's neighbours, the one that comes first
    earlier = near.join(firsts.withColumnRenamed("line", "near"), "near").groupBy("line").agg(F.min("first").alias("before"))
    beaten = earlier.join(firsts, "line").where("before < first").select("line", "first.doc_id", "first.line_no")
    every = cut(lines.select("doc_id", "line_no", *_hashes()))
    first = cut(every.groupBy("h", "i").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"))
    copies = join_copies(every, first, ["h", "i"], "n", every.count())
    copies = copies.where(place != F.col("first")).select("doc_id", "line_no", F.lit("copy").alias("kind")).distinct()
    return copies.unionByName(beaten.select("doc_id", "line_no", F.lit("near").alias("kind")))


def per_document(docs: DataFrame, distance: int = DISTANCE, min_chars: int = MIN_CHARS) -> DataFrame:
    """Per document: its lines, how many go as copies and as near copies, and their numbers."""
    gone = removals(docs, distance, min_chars).groupBy("doc_id").agg(F.count(F.when(F.col("kind") == "copy", 1)).alias("n_copies"), F.count(F.when(F.col("kind") == "near", 1)).alias("n_near"), F.array_sort(F.collect_set("line_no")).alias("removed"))
    ids = docs.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.size(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n", -1))).cast("long").alias("n_lines"))
    return ids.join(gone, "doc_id", "left").select("doc_id", "n_lines", F.coalesce("n_copies", F.lit(0)).alias("n_copies"), F.coalesce("n_near", F.lit(0)).alias("n_near"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def without(docs: DataFrame, distance: int = DISTANCE, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the lines removed from ``text``; documents of which no line that holds a
    word is left, though they had some, go."""
    own, numbers, cleaned = unused(docs, "own", "numbers", "cleaned")
    gone = removals(docs, distance, min_chars).groupBy(F.col("doc_id").alias(own)).agg(F.collect_set("line_no").alias(numbers))
    left = docs.join(gone, docs["doc_id"] == F.col(own), "left")
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda line, k: ~F.array_contains(numbers, k)), "\n")
    kept = F.when(F.col(numbers).isNull(), F.col("text")).otherwise(kept)
    left = left.withColumn(cleaned, kept).where(F.col(numbers).isNull() | F.col(cleaned).rlike(r"\S"))
    return left.select(*[F.col(cleaned).alias("text") if c == "text" else docs[c] for c in docs.columns])


_LETTERS = "etanhosri"  # an edit changes the count of any letter by one at most
_PAIRS = "\n  UNION ALL ".join(
    f"SELECT b.line FROM near a JOIN near b ON b.n = a.n + ({d}) WHERE a.first < b.first AND {' AND '.join(f'abs(a.c{i} - b.c{i}) <= {DISTANCE}' for i in range(len(_LETTERS)))} AND levenshtein(a.line, b.line) <= {DISTANCE}"
    for d in range(-DISTANCE, DISTANCE + 1)
)
SQL = f"""
WITH l AS (
  SELECT doc_id, unnest(range(0, len(s))) AS line_no, unnest(s) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents WHERE doc_id IS NOT NULL)),
k AS (SELECT * FROM l WHERE regexp_matches(line, '[^ \\t\\n\\x0B\\f\\r]')),
f AS (SELECT line, min((doc_id, line_no)) AS first FROM k GROUP BY line),
near AS (
  SELECT line, first, length(line) AS n,
         {", ".join(f"length(line) - length(replace(line, '{c}', '')) AS c{i}" for i, c in enumerate(_LETTERS))}
  FROM f WHERE length(line) >= {MIN_CHARS}),
p AS ({_PAIRS}),
r AS (
  SELECT k.doc_id, k.line_no, (k.doc_id, k.line_no) <> f.first AS copied
  FROM k JOIN f USING (line) WHERE (k.doc_id, k.line_no) <> f.first OR line IN (SELECT line FROM p))
SELECT doc_id, any_value(n) AS n_lines, count(*) FILTER (WHERE copied) AS n_copies,
       count(*) FILTER (WHERE NOT copied) AS n_near,
       coalesce(string_agg(line_no::VARCHAR, ',' ORDER BY line_no), '') AS removed
FROM (SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) AS n FROM documents WHERE doc_id IS NOT NULL) LEFT JOIN r USING (doc_id)
GROUP BY doc_id
"""
