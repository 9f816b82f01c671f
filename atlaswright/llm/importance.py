"""Importance resampling towards a target: hashed n-gram features, log ratios, Gumbel top-k.

A text's features are its runs of 1 to ``width`` words. Words are found by one scan: the text's
UTF-8 bytes are lower-cased (A-Z), every byte that belongs to no word becomes a space and runs
of spaces become one, and for each n an overlapped regular expression with look-arounds at word
boundaries emits the spans of n consecutive words, whose bytes go to the CRC as they stand.
A feature's bucket is its crc32 modulo ``buckets``. Bucket counts of all documents and of all
target texts give each bucket a gain; a document's weight is the sum of its features' gains;
adding Gumbel noise drawn from a hash of its id and keeping the highest scores samples without
replacement in proportion to the importance.

Texts are scanned once: a document's distinct buckets and their counts are written to the shared
folder; corpus counts, weights and scores come from there. Only the gains (one number a bucket)
pass through the driver.

Edge cases: a null or empty text, or one without a word, has no features and weight 0; a null
``doc_id`` draws its noise from the empty text and comes last among ties; repeated rows are
documents of their own; without any document that has enough words nothing is drawn; an empty
table gives no rows; an empty target is allowed (all its counts are 0). Columns other than
``doc_id`` and ``text`` are ignored, whatever their names. Texts of any length are scanned whole,
one in memory at a time.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, placed

BUCKETS, WIDTH, SEED = 10_000, 1, "2024"
#: Documents of fewer words are scored, never drawn; of the others so many percent are.
LEAST, PERCENT = 20, 10

#: Bytes outside words, after lower-casing: \x00-\x2F, \x3A-\x60 and \x7B-\x7F.
_APART = bytes(32 if b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256))
_GAP = regex.compile(rb"  +")


def patterns(width: int) -> list[regex.Pattern]:
    """For each n up to ``width`` what finds n words, one space between them."""
    return [regex.compile(rb"(?<![^ ])[^ ]+(?: [^ ]+){%d}(?![^ ])" % (n - 1)) for n in range(1, width + 1)]


def features(text: str | None, found: list[regex.Pattern]) -> tuple[int, Counter]:
    """How many words ``text`` has, and how often each of its features occurs in it."""
    if not text:
        return 0, Counter()
    data = _GAP.sub(b" ", text.encode("utf-8", "surrogatepass").lower().translate(_APART))
    n_words, counts = 0, Counter()
    for n, pattern in enumerate(found):
        spans = Counter(m[0] for m in pattern.finditer(data, overlapped=True))
        n_words = n_words or spans.total()
        counts += spans
    return n_words, counts


def counted(texts: DataFrame, width: int = WIDTH, buckets: int = BUCKETS) -> DataFrame:
    """Rows ``(doc_id, n_words, n_features, held)`` of ``texts(doc_id, text)``; ``held`` packs
    distinct buckets, ascending, and their counts as two arrays of unsigned 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = patterns(width)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                n_words, counts = features(text.as_py(), found)
                into: Counter = Counter()
                for feature, n in counts.items():
                    into[zlib.crc32(feature) % buckets] += n
                held = np.array(sorted(into.items()), np.uint32).reshape(-1, 2).T
                out.append((doc_id.as_py(), n_words, int(held[1].sum(dtype=np.int64)), held.tobytes()))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_words", "n_features", "held"])

    rows = texts.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, held binary")


def _held(blob: pa.Scalar) -> np.ndarray:
    return np.frombuffer(blob.as_buffer(), np.uint32).reshape(2, -1).astype(np.int64)


def totals(table: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of a ``counted`` table each bucket holds: summed in every task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for blob in batch.column(0):
                at, n = _held(blob)
                total[at] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in table.select("held").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of each bucket's smoothed share in the target over that in the corpus."""
    S, T, buckets = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def score(docs: DataFrame, target: DataFrame, width: int = WIDTH, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """Rows ``(doc_id, n_words, n_features, weight, score)``, one per row of ``docs``; ``target`` has a
    column ``text``."""
    table = cut(counted(docs, width, buckets))
    gain = gains(totals(table, buckets), totals(counted(target.select(F.lit(0).alias("doc_id"), "text"), width, buckets), buckets))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = [int(gain[at] @ n) for at, n in map(_held, batch.column(3))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weights, pa.int64())], [*batch.schema.names[:3], "weight"])

    weighed = table.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return weighed.withColumn("score", F.col("weight") + noise)


def draw(scored: DataFrame, least: int = LEAST, percent: int = PERCENT) -> DataFrame:
    """``scored`` rows with ``rank``: 1, 2, 3 … for the drawn, by falling score; null for the others."""
    scored = cut(scored)
    enough = F.col("n_words") >= least
    wanted = percent * scored.where(enough).count() // 100
    ranked = placed(scored.where(enough), F.desc("score"), F.asc_nulls_last("doc_id"))
    drawn = ranked.withColumn("rank", F.when(F.col("place") <= wanted, F.col("place"))).drop("place")
    return drawn.unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, width: int = WIDTH, buckets: int = BUCKETS, seed: str = SEED, least: int = LEAST, percent: int = PERCENT) -> DataFrame:
    """Every document's score, and the rank of those that are drawn."""
    return draw(score(docs, target, width, buckets, seed), least, percent)


#: The same for one-word features; crc32 runs over a table that is built from its polynomial. Whole numbers that may be null are
#: doubles here, as which pandas shows those of Spark, too.
SQL = r"""
WITH steps AS (
    SELECT list(list_reduce([k, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY k) AS t
    FROM range(256) AS r(k)
), texts AS (
    SELECT row_number() OVER () AS row_id, doc_id, text, true AS corpus FROM documents UNION ALL SELECT 0, NULL, text, false FROM benchmark
), split AS (
    SELECT row_id, doc_id, corpus,
           coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words
    FROM texts
), used AS (
    SELECT row_id, corpus, w FROM (SELECT row_id, corpus, unnest(words) AS w FROM split)
), coded AS (
    SELECT w, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT)),
           lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) % 10000 AS bucket
    FROM (SELECT DISTINCT w FROM used), steps
), each AS (
    SELECT row_id, corpus, bucket, count(*) AS n FROM used JOIN coded USING (w) GROUP BY ALL
), tallied AS (
    SELECT bucket, coalesce(sum(n) FILTER (corpus), 0) AS s, coalesce(sum(n) FILTER (NOT corpus), 0) AS t FROM each GROUP BY bucket
), whole AS (SELECT sum(s) AS S_all, sum(t) AS T_all FROM tallied),
gain AS (
    SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (T.S_all + 10000) / ((s + 1)::DOUBLE * (T.T_all + 10000))))::BIGINT AS g FROM tallied, whole AS T
), weighed AS (
    SELECT row_id, sum(g * n)::BIGINT AS weight FROM each JOIN gain USING (bucket) WHERE corpus GROUP BY row_id
), scored AS (
    SELECT doc_id, len(words) AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score
    FROM split LEFT JOIN weighed USING (row_id) WHERE corpus
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) FILTER (n_features >= 20) OVER () AS n FROM scored
)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, (CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END)::DOUBLE AS rank FROM placed
"""
