"""Importance resampling, WARC and hard negatives against brute force and round trips."""

import collections
import gzip
import hashlib
import io
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from atlaswright.llm import common, importance, negatives, warc

CLASH = ["rank", "score", "n", "key", "held", "weight", "place", "task", "in_task", "same", "kept", "_key", "_hot", "_rare", "shard", "digest", "cell", "part", "v", "tops", "copies"]


def widened(df):
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASH if c not in df.columns])


# importance resampling


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_resample(texts, target, width=1, buckets=10_000, least=20, percent=10):
    def grams(ws):
        return [" ".join(ws[k : k + n]).encode() for n in range(1, width + 1) for k in range(len(ws) - n + 1)]

    corpus, wanted = collections.Counter(), collections.Counter()
    for into, rows in ((corpus, [t for _, t in texts]), (wanted, target)):
        for t in rows:
            into.update(zlib.crc32(g) % buckets for g in grams(words(t)))
    S, T = corpus.total(), wanted.total()
    out = []
    for i, t in texts:
        fs = grams(words(t))
        weight = sum(math.floor(1000 * math.log((wanted[b] + 1) * (S + buckets) / ((corpus[b] + 1) * (T + buckets)))) for b in (zlib.crc32(g) % buckets for g in fs))
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(t))])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return sorted(([*r[:4], rank.get(id(r))] for r in out), key=repr)


@pytest.mark.parametrize("width", [1, 3])
def test_resampling_equals_brute_force(spark, width):
    rng = random.Random(4)
    vocabulary = ["Ärger", "straße", "alpha", "BETA", "x1", "漢字", "İx", "no break", "don't", "a_b", "é"]
    texts = [(k, "".join(rng.choice(vocabulary) + rng.choice([" ", "  ", "\n", "--", "\x00", "/", "`"]) for _ in range(rng.randrange(60)))) for k in range(120)]
    texts += [(500, None), (501, ""), (502, " \x7f.,"), (503, "ß" * 50_000), (504, "word " * 30_000), (3, texts[3][1]), (None, "alpha " * 25), (505, texts[7][1]), (506, texts[7][1])]
    target = ["alpha beta x1", None, "", "STRASSE straße alpha"]
    df = widened(spark.createDataFrame(texts, "doc_id long, text string")).repartition(5)
    got = importance.resample(df, widened(spark.createDataFrame([(t,) for t in target], "text string")), width=width)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    rows = sorted(([r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]] for r in got.collect()), key=repr)
    assert rows == brute_resample(texts, target, width)
    assert sum(r[4] is not None for r in rows) > 5


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(none, none).count() == 0
    few = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert [r["rank"] for r in importance.resample(few, none).collect()] == [None, None]


def test_overlapped_spans_are_all_runs():
    found = importance.patterns(2)
    assert importance.features("A b  a-b", found) == (4, collections.Counter({b"a": 2, b"b": 2, b"a b": 2, b"b a": 1}))


def test_places_are_a_gapless_order(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("a"), "id").repartition(9)
    got = common.placed(rows, F.desc("a"), F.asc("id")).orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(1, 1001))
    assert [(r["a"], r["id"]) for r in got] == sorted(((k % 7, k) for k in range(1000)), key=lambda x: (-x[0], x[1]))


# WARC


def pages(spark, rows, parts=4):
    return widened(spark.createDataFrame(rows, "page_id long, url string, html string")).repartition(parts)


def brute_warc(rows, least=1000):
    kept = {}
    for i, _, html in rows:
        p = (html or "").encode()
        if len(p) >= least and i is not None:
            kept[p] = max(kept.get(p, i), i)
    out = []
    for i, _, html in rows:
        p = (html or "").encode()
        to = kept.get(p) if i is not None and kept.get(p, i) != i else None
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=repr)


ROWS = [(k, f"http://h{k % 3}.org/ä {k}", f"<p>{k % 40}</p>" * (150 if k % 2 else 3)) for k in range(400)]
ROWS += [(900, None, "x" * 999), (901, "u", "x" * 999), (902, "u", "y" * 1000), (903, "u\r\nX: 1", "y" * 1000), (904, "u", None), (905, "u", ""), (906, "é\r\n\r\n", "ß漢\r\n\r\n" * 50_000)]
ROWS += [(907, "u", "z" * 1200), (907, "u", "z" * 1200), (5, "u", ROWS[5][2]), (None, "u", "y" * 1000), (None, None, None)]


def test_archives_give_back_what_was_written(spark):
    files = warc.write(pages(spark, ROWS), file_bytes=4_000, range_bytes=60_000)
    listed = files.collect()
    assert len({r["shard"] for r in listed}) > 3 and max(r["part"] for r in listed) > 0
    records = warc.read(files)
    assert sorted(map(tuple, warc.digests(records).collect()), key=repr) == brute_warc(ROWS)
    whole = {r["page_id"]: bytes(r["payload"]).decode() for r in records.where("record_type = 'response'").collect()}
    assert whole[906] == ROWS[406][2] and whole[904] == ""
    assert sum(r["records"] for r in listed) == records.count() == len(ROWS) + len(listed)
    for r in listed[:5]:
        data = open(r["path"].removeprefix("file:"), "rb").read()
        assert len(data) == r["bytes"] and hashlib.sha256(data).hexdigest() == r["sha256"]


def test_archives_do_not_depend_on_the_layout(spark):
    a, b = (sorted((r["name"], r["sha256"]) for r in warc.write(pages(spark, rows, n), file_bytes=4_000, range_bytes=60_000).collect()) for rows, n in ((ROWS, 2), (ROWS[::-1], 7)))
    assert a == b


def test_manifest_lists_only_what_is_there_and_temporary_names_go(spark, tmp_path):
    files = warc.write(pages(spark, ROWS[:50]), out=str(tmp_path / "a"))
    left = {p.name for p in (tmp_path / "a").iterdir()}
    assert left == {r["name"] for r in files.collect()} | {"_manifest"}


def test_publishing_again_is_harmless(tmp_path):
    import pyarrow as pa

    (tmp_path / "_temporary").mkdir()
    (tmp_path / "_temporary/t").write_bytes(b"abc")
    batch = pa.RecordBatch.from_pydict({"name": ["n"], "written": ["_temporary/t"], "bytes": [3]})
    for _ in range(2):
        list(warc._publish(iter([batch]), str(tmp_path)))
    assert (tmp_path / "n").read_bytes() == b"abc"
    (tmp_path / "n").write_bytes(b"ab")
    with pytest.raises(OSError, match="not all of it"):
        list(warc._publish(iter([batch]), str(tmp_path)))


def test_no_pages_no_records(spark):
    files = warc.write(pages(spark, []))
    assert files.count() == 0 and warc.digests(warc.read(files)).count() == 0


def test_damaged_archives_tell(spark, tmp_path):
    files = warc.write(pages(spark, ROWS[:30]), out=str(tmp_path / "a"))
    path = files.first()["path"]
    data = open(path, "rb").read()
    plain = gzip.decompress(data)
    changed = plain.replace(b"<p>1</p>", b"<p>2</p>", 1)
    for name, content in {"cut.gz": data[: len(data) // 2], "cut": plain[:-40], "other": b"GIF89a", "changed": changed, "folded": plain.replace(b"WARC-Date: ", b"WARC-Date:\r\n ")}.items():
        (tmp_path / name).write_bytes(content)
    listed = spark.createDataFrame([(str(tmp_path / n),) for n in ("cut.gz", "cut", "other", "changed", "folded", "none")], "path string")
    got = warc.read(listed).collect()
    errors = {r["name"]: r["error"] for r in got if r["error"]}
    assert set(errors) == {"cut.gz", "cut", "other", "changed", "none"} and errors["changed"] == "block digest differs"
    assert sum(r["name"] == "folded" for r in got) == 31 == sum(r["name"] == "cut" for r in got)
    with pytest.raises(Exception, match="differs|early|begin|error|Error"):
        warc.digests(warc.read(listed)).collect()


def test_records_hold_what_the_format_asks_for(spark):
    path = warc.write(pages(spark, [(1, "http://a/", "q" * 1000), (2, "http://b/", "q" * 1000)])).first()["path"]
    info, one, two = warc.parse(io.BytesIO(gzip.decompress(open(path.removeprefix("file:"), "rb").read())))
    assert (info["warc-type"], one["warc-type"], two["warc-type"]) == ("warcinfo", "revisit", "response")
    assert one["warc-refers-to"] == two["warc-record-id"] and one["warc-refers-to-target-uri"] == "http://b/" and one["warc-payload-digest"] == two["warc-payload-digest"]
    assert one["block"].endswith(b"\r\n\r\n") and two["block"].endswith(b"\r\n\r\n" + b"q" * 1000)


# hard negatives


def brute_mine(rows, every=100, positives=5, negatives_=5):
    """``rows``: (id, label, integer vector)."""
    width = max((len(v) for _, _, v in rows), default=0)
    rows = [(i, lab, np.array([*v, *[0] * (width - len(v))], object)) for i, lab, v in rows]
    out = []
    for a, label, q in rows:
        if a % every:
            continue
        scored = sorted((-int(q @ v) if width else 0, i, lab) for i, lab, v in rows if i != a)
        for ps, p, _ in [x for x in scored if x[2] == label][:positives]:
            fit = [(s, i) for s, i, lab in scored if lab != label and 80 * -ps <= 100 * -s <= 100 * -ps][:negatives_]
            out += [(a, p, k + 1, i, -ps, -s) for k, (s, i) in enumerate(fit)]
    return sorted(out)


def vectors(spark, rows):
    return widened(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).repartition(3)


def whole(rows):
    out = {}
    for i, x, label in rows:
        if i is None or x is None or label is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        v = [math.floor(256 * float(np.float32(c))) for c in x]
        row = ((label + 1) % 10 if i % 7 == 0 else label, v)
        out[i] = min(out.get(i, row), row)
    return [(i, *r) for i, r in out.items()]


@pytest.fixture
def small(monkeypatch):
    """Visits of a few rows at a time, so that all rounds are needed."""
    for name, value in (("START", 20), ("BLOCK", 16), ("AT_ONCE", 3), ("CELL", 8)):
        monkeypatch.setattr(negatives, name, value)


def test_negatives_equal_brute_force(spark, small):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(10, 9))
    rows = [(k, (centres[k % 10] + 0.6 * rng.normal(size=9)).tolist(), int(rng.integers(0, 10)) if k % 3 else k % 10) for k in range(900)]
    rows += [(1000 + k, [0.5] * 9, k % 4) for k in range(300)]  # one vector a quarter of all rows have
    rows += [(2000, None, 1), (2001, [0.1] * 8 + [None], 1), (2100, [float("nan")] * 9, 2), (2101, [float("inf")] * 9, 2), (2200, [1.0] * 9, None), (None, [1.0] * 9, 3)]
    rows += [(2300, [], 4), (2301, [0.25] * 5, 4), (2400, [0.5, 0.5], 4), (5, rows[5][1], rows[5][2]), (6, [0.0] * 9, 9), (2500, [0.3] * 9, 77)]
    got = sorted(map(tuple, negatives.mine(negatives.whole_vectors(vectors(spark, rows))).collect()))
    assert got == brute_mine(whole(rows)) and len(got) > 200


def test_negatives_of_large_components(spark, small):
    rng = np.random.default_rng(6)
    rows = [(k, [float(x) for x in rng.integers(-(1 << 17), 1 << 17, 4)], k % 3) for k in range(150)]
    assert sorted(map(tuple, negatives.mine(negatives.whole_vectors(vectors(spark, rows)), every=10).collect())) == brute_mine(whole(rows), every=10)


def test_positives_with_negative_scores_have_no_negatives(spark):
    """Of an anchor's positives one has a window, the other a score below 0."""
    rows = [(0, [1.0, 0.0], 0), (1, [2.0, 0.0], 1), (2, [-1.0, 0.0], 1), (3, [1.75, 1.0], 2), (4, [-1.0, 1.0], 2)]
    got = negatives.mine(negatives.whole_vectors(vectors(spark, rows))).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 3, 256 * 512, 256 * 448)]


def test_no_vectors_no_negatives(spark):
    assert negatives.mine(negatives.whole_vectors(vectors(spark, []))).count() == 0
    assert negatives.mine(negatives.whole_vectors(vectors(spark, [(0, [1.0], 1)]))).count() == 0


def test_the_walk_visits_all_cells_by_falling_bounds():
    rng = np.random.default_rng(7)
    x = rng.integers(-50, 50, (400, 6)).astype(float)
    books = negatives.Codebooks(x, 5)
    (i, far), (j, also) = books.assign(x)
    cells = collections.defaultdict(lambda: [0, 0.0, 0.0])
    for a, b, f, g in zip(i.tolist(), j.tolist(), far.tolist(), also.tolist(), strict=True):
        c = cells[a, b]
        cells[a, b] = [c[0] + 1, max(c[1], f), max(c[2], g)]
    books.know([(*k, *v) for k, v in cells.items()])
    q = rng.integers(-50, 50, 6).astype(float)
    walk = list(books.walk(q))
    assert sorted((a, b) for _, a, b in walk) == sorted(cells)
    assert [w[0] for w in walk] == sorted((w[0] for w in walk), reverse=True)
    bound = {(a, b): w for w, a, b in walk}
    assert all(x[k] @ q <= bound[i[k], j[k]] for k in range(len(x)))
