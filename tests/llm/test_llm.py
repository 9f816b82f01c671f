"""The training-data operators against brute force, round trips and held-out accuracy."""

import collections
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from atlaswright.llm import blocks, chat, common, decontam, jaccard, langid, lines, lm, media, packing, quality, substrings

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, extra=False):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in (texts.items() if isinstance(texts, dict) else enumerate(texts))]
    df = spark.createDataFrame(rows, DOC).repartition(3)
    return df.select("*", *[F.lit("clash").alias(c) for c in ("h", "g", "rep", "n", "label", "key", "block", "score", "line", "rank")]) if extra else df


ODD = [None, "", " \n\t ", "x", "x", "one two", "ÄÖ ß 漢字 é", "a " * 4000, "b" * 30_000, "same line of twenty chars\nsame line of twenty chars"]


# packing


def test_ids_equal_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(1)
    texts = [x for x in ODD if x] + ["a  b", "a \n b", "  x", "<|endoftext|> x", "a'll b's 12 x_y ...q"] + ["".join(rng.choices(" \n\té1_.'sß 　x", k=9)) for _ in range(3000)]
    encode = packing.encoder(packing.tokenizer_file())
    for text, e in zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(encode(text), "<u4").tolist() == e.ids, text


@pytest.mark.parametrize("size", [16, 1024])
def test_packing_holds_each_id_once(spark, size):
    texts = ODD + ["word " * k for k in range(40)]
    got = packing.pack(docs(spark, texts, extra=True), size=size).collect()
    encode = packing.encoder(packing.tokenizer_file())
    spans, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        ids = (encode(texts[r["doc_id"]]) if texts[r["doc_id"]] else b"") + b"\0" * 4
        assert r["doc_tokens"] == len(ids) // 4 and r["ids_crc32"] == zlib.crc32(ids[4 * r["start"] : 4 * (r["start"] + r["length"])])
        spans[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for k, t in enumerate(texts):
        assert sum(n for _, n in spans[k]) == (len(encode(t)) // 4 if t else 0) + 1
    for parts in itertools.chain(spans.values(), sequences.values()):
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
    assert all(sum(n for _, n in p) <= size for p in sequences.values())


def test_shortest_pack_first():
    patterns = packing.shortest_pack_first({8: 2, 5: 3, 3: 2, 2: 4}, 8)
    counts = collections.Counter()
    for p, n in patterns:
        assert sum(p) <= 8
        counts.update({k: v * n for k, v in collections.Counter(p).items()})
    assert counts == {8: 2, 5: 3, 3: 2, 2: 4} and sum(n for _, n in patterns) == 6


# media


def test_media_round_trip(spark):
    got = {r["doc_id"]: r for r in media.digests(media.media(docs(spark, ODD))).collect()}
    for k, t in enumerate(ODD):
        payload, n = media.payload_of(t)
        assert len(payload) % 192 == 0 and payload[:n] == (t or "").encode() and not payload[n:].strip(b" ")
        assert (got[k]["n_bytes"], got[k]["payload_sha256"], got[k]["tail_crc32"]) == (n, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert got[3]["feature"] == got[4]["feature"] and got[3]["media_sha256"] == got[4]["media_sha256"]


def test_packet_table(spark):
    table = media.packets(media.media(docs(spark, {7: "z" * 20_000}))).orderBy("packet").collect()
    assert len(table) == 105 and [r["timestamp_ms"] for r in table] == [24.0 * k for k in range(105)] and all(r["stop"] - r["start"] == 192 for r in table)


def test_all_lacings_are_read():
    frames = [b"a" * 300, b"b" * 5, b"c" * 260]
    xiph = bytes([2]) + b"\xff\x2d" + b"\x05" + b"".join(frames)
    ebml = bytes([2]) + media.vint(300) + ((5 - 300) + (1 << 13) - 1 | 1 << 14).to_bytes(2, "big") + b"".join(frames)
    for body, kind in ((xiph, media.XIPH), (ebml, media.EBML_LACING)):
        assert [body[a:b] for a, b in media.laced(body, 0, len(body), kind)] == frames


def test_clusters_of_unknown_size_end_at_the_next():
    data = media.mux(b"ab" * 96 * 3000)
    (segment,) = (e for e in media.children(data, 0, len(data)) if e.name == media.SEGMENT)
    parts = list(media.children(data, segment.start, segment.stop))
    open_ = lambda e: media._id(e.name) + b"\xff" + data[e.start : e.stop] if e.name == media.CLUSTER else data[e.head : e.stop]
    assert sum(e.name == media.CLUSTER for e in parts) == 3
    streamed = data[: segment.head] + media._id(media.SEGMENT) + b"\x01" + b"\xff" * 7 + b"".join(open_(e) for e in parts if e.name != media.CUES)
    tracks, packets = media.demux(streamed)
    assert b"".join(streamed[p.start : p.stop] for p in packets) == b"ab" * 96 * 3000 and tracks[1]["rate"] == 8000
    assert [p.timestamp_ms for p in packets] == [24.0 * k for k in range(3000)]


def test_damaged_files_and_odd_rows(spark):
    good = media.mux(b"x" * 192)
    bad = [good[:-40], b"\x00" * 9, good.replace(media._id(media.SIMPLE_BLOCK) + media.vint(196), media._id(media.SIMPLE_BLOCK) + media.vint(250)), None]
    files = spark.createDataFrame([(k, bytearray(x) if x is not None else None) for k, x in enumerate([*bad, good])], "doc_id long, media binary")
    got = {k: [(r["packet"], r["error"] is None) for r in rows] for k, rows in itertools.groupby(sorted(media.packets(files).collect(), key=lambda r: r["doc_id"]), lambda r: r["doc_id"])}
    assert got == {0: [(None, False)], 1: [(None, False)], 2: [(None, False)], 4: [(0, True)]}
    with pytest.raises(ValueError):
        media.laced(b"\x02abcd", 0, 5, media.FIXED)
    rows = spark.createDataFrame([(None, "a", "en", "s", 0), (1, "b", "en", "s", 0), (1, "b", "en", "s", 0)], DOC)
    assert sorted(str(r["doc_id"]) for r in media.digests(media.media(rows.withColumn("media", F.lit("clash")).withColumn("n_bytes", F.lit(0)))).collect()) == ["1", "1", "None"]
    assert media.digests(media.media(rows.where("false"))).count() == 0


def test_features_by_hand(spark):
    (r,) = media.digests(media.media(docs(spark, ["ab" * 96]))).collect()
    x = [97, 98] * 96
    rms = (sum(v * v for v in x) / 192) ** 0.5
    assert r["feature"] == f"tracks=1;packets=1;ms=24;mean=97.5000;rms={rms:.4f};step={191 / 192:.4f};distinct=2"
    data = media.mux(b"ab" * 96)
    assert (r["media_bytes"], r["media_sha256"]) == (len(data), hashlib.sha256(data).hexdigest()) and data.count(b"ab" * 96) == 1


# chat


def test_rotation(spark):
    rows = [(1, 0, "system", "S"), (1, 1, "user", "hi"), (1, 2, "assistant", None), (1, 3, None, "x<|end|>"), (None, 0, "user", "lost"), (2, 0, "system", "only"), (3, 300, "user", "late"), (3, 1, "user", "a"), (3, 1, "user", "a"), (3, None, "u|>", "first")]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", *[F.lit("clash").alias(c) for c in ("part", "head", "said", "k", "at", "perspective", "mask")])
    got = {(r["conv_id"], r["perspective"]): r for r in chat.rotate(t).collect()}
    assert set(got) == {(1, "user"), (1, "assistant"), (1, "unknown"), (3, "user"), (3, "u| >")}
    r = got[1, "user"]
    assert r["text"] == "<|system|>\nS<|end|>\n<|assistant|>\nhi<|end|>\n<|user name=assistant|>\n<|end|>\n<|user name=unknown|>\nx< |end|><|end|>\n"
    assert [r["text"][m["start"] : m["stop"]] for m in r["mask"]] == ["hi<|end|>\n"]
    assert got[3, "user"]["n_turns"] == 4 and got[3, "user"]["text"].startswith("<|user name=u| >|>\nfirst") and chat.rotate(t.where("false")).count() == 0
    parts = {(r["perspective"], r["part"]): r["n_turns"] for r in chat.rotate(t.where("conv_id = 3"), part=256).collect()}
    assert parts == {("user", 0): 3, ("user", 1): 1, ("u| >", 0): 3, ("u| >", 1): 1}
    long = spark.createDataFrame([(1, k, "ab"[k % 2], "w " * (k % 7) if k else "z" * 50_000) for k in range(1500)], "conv_id long, turn long, role string, text string")
    for r in chat.rotate(long).collect():
        assert r["n_turns"] == 1500 and r["n_own_turns"] == 750 and "".join(r["text"][m["start"] : m["stop"]] for m in r["mask"]).count(chat.END) == 750


# lines


def test_within_is_edit_distance(spark):
    rng = random.Random(3)
    pairs = []
    for _ in range(400):
        a = "".join(rng.choices("ab", k=rng.randint(0, 12)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b"])
        pairs.append((a, "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    for d in (1, 2, 3):
        assert df.where(lines.within(F.col("a"), F.col("b"), d) != (F.levenshtein("a", "b") <= d)).count() == 0


@pytest.mark.parametrize("frequent", [100_000, 1])
def test_lines_against_all_pairs(spark, monkeypatch, frequent):
    rng = random.Random(4)
    texts = []
    for _ in range(30):
        ls = ["".join(rng.choices("abcdé ", k=rng.randint(18, 26))) for _ in range(3)]
        if texts:
            b = list(rng.choice(rng.choice(texts).split("\n")))
            for _ in range(rng.randint(0, 3)):
                at = rng.randint(0, len(b))
                b[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "c"])
            ls.append("".join(b))
        texts.append("\n".join(ls))
    texts += [None, "", "short\nshort", " \n \n\t", "z" * 1500, "z" * 1501, "short"]
    monkeypatch.setattr(common, "FREQUENT", frequent)
    got = {r["doc_id"]: r for r in lines.per_document(docs(spark, texts, extra=True)).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    seen = []
    for k, t in enumerate(texts):
        gone = []
        for n, line in enumerate((t or "").split("\n")):
            if line.strip():
                near = len(line) >= lines.MIN_CHARS
                if line in seen or near and any(len(o) >= lines.MIN_CHARS and abs(len(o) - len(line)) <= 2 and distance(o, line) <= 2 for o in seen):
                    gone.append(n)
                seen.append(line)
        assert got[k]["removed"] == gone, (k, t)
    assert lines.per_document(docs(spark, texts).where("false")).count() == 0


# n-gram Jaccard


def _components(sets):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a, b in itertools.combinations(ids, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize(("short", "block"), [(8, 256), (1, 3)])
def test_jaccard_against_all_pairs(spark, monkeypatch, short, block):
    monkeypatch.setattr(jaccard, "SHORT", short)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(3000)]
    texts = list(ODD)
    for _ in range(4):
        base = rng.choices(vocabulary, k=100)
        for _ in range(10):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(docs(spark, texts, extra=True)).collect()}
    sets = {}
    for i, t in enumerate(texts):
        w = common.words_of(t)
        sets[i] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
    want = _components(sets)
    assert got == {i: (len(sets[i]), want[i]) for i in sets}


def test_jaccard_of_repeated_ids_does_not_depend_on_order(spark):
    w = [f"w{k}" for k in range(60)]
    a, b, c = " ".join(w[:20]), " ".join(w[20:40]), " ".join(w[40:])
    rows = [(1, a), (1, b), (1, c), (2, f"{b} more"), (3, f"{c} more"), (4, "alone in its set of words"), (5, None), (5, a), (6, a)]
    want = {1: 1, 2: 1, 3: 1, 4: 4, 5: 1, 6: 1}
    for order in (rows, rows[::-1], [*rows[3:], *rows[:3]]):
        got = jaccard.join(spark.createDataFrame(order, "doc_id long, text string").coalesce(1), threshold=(4, 5)).collect()
        assert len(got) == len(rows) and {r["doc_id"]: r["component_id"] for r in got} == want
    assert jaccard.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("edges_per_task", [300_000, 4])
def test_min_label(spark, monkeypatch, edges_per_task):
    monkeypatch.setattr(common, "EDGES", edges_per_task)
    edges = spark.createDataFrame([(k, k + 1) for k in range(20) if k != 9] + [(30, 25), (3, 3)], "a long, b long")
    got = {r["id"]: r["label"] for r in common.min_label(edges).collect()}
    assert got == {**{k: 0 for k in range(10)}, **{k: 10 for k in range(10, 21)}, 30: 25, 25: 25}
    assert common.min_label(edges.where("false")).count() == 0


# decontamination


def test_decontamination(spark):
    item = " ".join(f"i{k}" for k in range(30))
    changed = item.replace("i29", "zz")
    texts = [f"a b c {item} d e", item.upper(), f"x {changed}", "i1 i2 i3 i4 i5 i6 and no more of it", None, "", "tiny item", "the TINY item here"]
    items = spark.createDataFrame([(1, item), (2, "tiny item"), (3, None), (None, "a b c"), (4, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["window_start"], r["in_common"], r["in_union"]) for r in decontam.matches(docs(spark, texts, extra=True), items).collect()}
    assert got == {(0, 1): (3, 26, 26), (1, 1): (0, 26, 26), (2, 1): (0, 25, 27), (6, 2): (0, 1, 1), (7, 2): (1, 1, 1)}
    assert decontam.matches(docs(spark, texts), items.where("false")).count() == 0
    assert decontam.matches(docs(spark, texts).where("false"), items).count() == 0


def _windows(text, item):
    """The best window of ``text`` for ``item`` over all windows: (start, in common, in union)."""
    grams = lambda ws: collections.Counter(tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4)))
    ws, want, best = text.lower().split(), item.lower().split(), None
    for k in range(max(0, len(ws) - len(want)) + 1 if ws and want else 0):
        a, b = grams(ws[k : k + len(want)]), grams(want)
        both = sum((a & b).values())
        either = sum(a.values()) + sum(b.values()) - both
        if 5 * both >= 4 * either and (best is None or both / either > best[1] / best[2]):
            best = (k, both, either)
    return best


def test_decontamination_against_all_windows(spark):
    rng = random.Random(12)
    word = lambda: rng.choice("abcdefgh") * rng.randint(1, 4)
    items = [[word() for _ in range(n)] for n in (60, 60, 25, 3, 4, 5, 600)] + [["x"] * 30]
    items.append([*items[0][:50], *[word() for _ in range(10)]])
    texts = []
    for ws in items * 6:
        ws = list(ws)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(ws))
            ws[at : at + rng.randint(0, 1)] = [word()] * rng.randint(0, 2)
        half = len(ws) // 2 if rng.random() < 0.3 else 0
        ws = ws[half:] + ws[:half]
        texts.append(" ".join([word() for _ in range(rng.randint(0, 20))] + ws + [word() for _ in range(rng.randint(0, 20))]))
    texts += ["x " * 40, " ".join(items[1][:50]), " ".join(f"{' '.join(items[2])} y" for _ in range(3))]
    table = spark.createDataFrame([(k, " ".join(ws)) for k, ws in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["window_start"], r["in_common"], r["in_union"]) for r in decontam.matches(docs(spark, texts), table).collect()}
    want = {(i, k): m for i, t in enumerate(texts) for k, ws in enumerate(items) if (m := _windows(t, " ".join(ws)))}
    assert got == want and any(m[0] for m in want.values())


def test_swapped_halves_are_found(spark):
    item = [f"w{k}" for k in range(60)]
    text = " ".join(item[30:] + item[:30])
    got = decontam.matches(docs(spark, [text, text]).unionByName(docs(spark, ["other words of the same document"])), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["in_common"], r["in_union"]) for r in got) == [(0, 52, 60), (1, 52, 60)]


def test_hamming_blocks_reach_the_radius():
    rng = random.Random(6)
    masks = set(decontam.masks())
    for _ in range(500):
        a = rng.getrandbits(64)
        b = a
        for k in rng.sample(range(64), decontam.RADIUS):
            b ^= 1 << k
        assert any((a ^ b) >> 8 * k & 255 in masks for k in range(8))


# substrings


def test_window_classes():
    rng = np.random.default_rng(0)
    for _ in range(150):
        x = np.r_[rng.integers(97, 97 + rng.integers(1, 4), rng.integers(5, 150)), 255].astype(np.uint8)
        n = int(rng.integers(1, 14))
        order, begins = substrings.window_classes(x, n)
        number, seen = dict(zip(order.tolist(), np.cumsum(begins).tolist(), strict=True)), {}
        for p in range(len(x) - n + 1):
            assert seen.setdefault(x[p : p + n].tobytes(), number[p]) == number[p]
        assert len(set(seen.values())) == len(seen)


def test_substrings_against_brute_force(spark):
    rng = random.Random(7)
    passages = ["".join(rng.choices("abcdefgh é", k=rng.randint(40, 160))) for _ in range(6)]
    texts = dict(enumerate(ODD))
    for k in range(40):
        texts[100 + k] = "".join(rng.choice([*passages, "".join(rng.choices("ijklmnop ", k=rng.randint(0, 60)))]) for _ in range(rng.randint(0, 4)))
    got = {r["doc_id"]: r for r in substrings.remove(docs(spark, texts, extra=True)).collect()}
    first = {}
    for i in sorted(texts):
        x = (texts[i] or "").encode()
        gone = bytearray(len(x))
        for p in range(len(x) - 49):
            if first.setdefault(x[p : p + 50], i) < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(x, gone, strict=True) if not g)
        spans = sum(1 for _ in filter(None, (k for k, _ in itertools.groupby(gone))))
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest()), i
    assert substrings.remove(docs(spark, texts).where("false")).count() == 0


def test_blocks_hold_every_document(spark):
    rows = [blocks.opened(r.asDict()) for r in blocks.blocks(docs(spark, ODD), size=50).collect()]
    got = {}
    for ids, sizes, raw in rows:
        stops = np.cumsum(sizes).tolist()
        got |= {i: raw[b - a : b].decode() for i, a, b in zip(ids.tolist(), sizes.tolist(), stops, strict=True)}
    assert got == {k: t or "" for k, t in enumerate(ODD)}


# language


def test_phrases_are_greedy_longest_matches(monkeypatch):
    text = b"abracadabra banana"
    a = langid.Automaton(text)

    def parse(s):
        n = at = 0
        while at < len(s):
            k = at
            while k < len(s) and s[at : k + 1] in text:
                k += 1
            at, n = max(k, at + 1), n + 1
        return n

    rng = random.Random(8)
    texts = [("".join(rng.choices(["abracadabra banana", "a", "b", "cadabra", "n", "x"], k=rng.randint(1, 60)))).encode() for _ in range(80)]
    for size in (7, 30, 4000):
        monkeypatch.setattr(langid, "SEGMENT", size)
        got = langid.rates({"a": a}, texts)[:, 0] * [len(t) for t in texts] / a.bits
        assert got.tolist() == pytest.approx([parse(t) for t in texts])


def test_language_accuracy_and_edges(spark):
    d = common.documents(spark, "/root/testdata/sf0.01")
    models = langid.fit(langid.training_sample(d))
    got = d.select("doc_id", F.col("lang").alias("said")).join(langid.identify(d, models).where(langid.is_held_out(F.col("doc_id"))), "doc_id")
    n, hit = got.count(), got.where("said = lang_pred").count()
    assert hit / n > 0.95
    odd = {r["doc_id"]: r for r in langid.identify(docs(spark, [None, "", "123 ...", "é", "word"]), models).collect()}
    assert [odd[k]["lang_pred"] == "und" for k in range(5)] == [True, True, True, False, False] and all(0 <= r["score"] <= 1 for r in odd.values())
    assert langid.identify(docs(spark, ["word"]), {}).first()["lang_pred"] == "und"
    again = langid.identify(docs(spark, ["word", "word", "one very long text " * 40_000]).unionByName(docs(spark, ["word"])), models).collect()
    assert len({(r["lang_pred"], r["score"]) for r in again if r["doc_id"] < 2}) == 1 and len(again) == 4
    assert langid.identify(docs(spark, ["word"]).where("false"), models).count() == 0
    tie = langid.fit([("b", b"abc abc"), ("a", b"abc abc")])
    assert langid.identify(docs(spark, ["abc"]), tie).first()["lang_pred"] == "a"
    nulls = d.withColumn("lang", F.when(F.col("lang") == "de", None).otherwise(F.col("lang")))
    assert {lang for lang, _ in langid.training_sample(nulls)} == {"en", "es", "fr"}
    kept = langid.accepted(docs(spark, ["word", "12"], extra=True), models)
    assert kept.columns == docs(spark, [], extra=True).columns and kept.count() == 1


def test_language_sample_takes_short_texts_and_whole_ones(spark):
    short = [(k, f"kurz und gut {k}", "de", "s", 0) for k in range(40)]
    head = "the same boilerplate head " * 100
    long = [(100 + k, head + " ".join(f"body{'abcdefghij'[k % 10]}x{j}" for j in range(800)), "en", "s", 0) for k in range(90)]
    d = spark.createDataFrame(short + long, DOC).repartition(3)
    sample = langid.training_sample(d)
    size = {lang: sum(len(t) + 1 for x, t in sample if x == lang) for lang in ("de", "en")}
    want = sorted(langid.folded(t) for i, t, *_ in short if zlib.crc32(str(i).encode()) % 3 != 1)
    assert sorted(t for lang, t in sample if lang == "de") == want
    assert langid.SAMPLE_BYTES <= size["en"] < langid.SAMPLE_BYTES + 1001
    english = [t for lang, t in sample if lang == "en"]
    assert sum(b"body" in t for t in english) > len(english) / 2
    few = langid.training_sample(d.where("doc_id in (100, 101, 102)"))
    assert sum(len(t) for _, t in few) == sum(len(langid.folded(t)) for i, t, *_ in long if i in (100, 101, 102) and zlib.crc32(str(i).encode()) % 3 != 1)
    models = langid.fit(langid.training_sample(d.where("lang = 'de'")))
    assert langid.identify(d, models).where("lang_pred = 'und'").count() == 0
    assert sorted(sample) == sorted(langid.training_sample(d.repartition(7)))


# language model


def _model(texts, seed=0):
    """Counts of ``texts``, all of which train, and weights away from the first ones."""
    path = packing.tokenizer_file()
    cutter = lm.subwords(path)
    numbers, lengths = lm.cut_texts(texts, cutter)
    got = lm.Texts.of(numbers, lengths, cutter.arrays())
    often = collections.Counter(w for t in texts for w in common.words_of(t))
    pairs = np.zeros((lm.VOCAB, lm.VOCAB), np.int64)
    for t in texts:
        np.add.at(pairs, tuple(np.array(list(itertools.pairwise([lm.END, *_ids(t), lm.END]))).T), 1)
    flat = lm.start() + np.random.default_rng(seed).normal(0, 0.2, lm.LENGTH).astype(np.float32)
    return got, lm.spelling(pairs.ravel(), often, len(texts), path), flat


def _cut(word):
    cutter = lm.subwords(packing.tokenizer_file())
    (n,) = cutter.numbers([word]).tolist()
    flat, ends = cutter.arrays()
    return tuple(flat[ends[n] : ends[n + 1]].tolist())


def _ids(text):
    return [y for word in common.words_of(text) for y in _cut(word)]


def _some_texts(n=40, seed=5):
    rng = random.Random(seed)
    return [" ".join(rng.choices(["the", "cat", "satisfied", "zwölf", "unbelievably", "on", f"w{k}", "the the"], k=rng.randint(0, 40))) for k in range(n)]


def test_packed_texts_come_back():
    for texts in (["", None], [], ["a"], _some_texts()):
        got, _, _ = _model(texts)
        again = lm.Texts.unpacked(got.packed())
        assert all(np.array_equal(getattr(got, k), getattr(again, k)) for k in ("lengths", "which", "hashes", "begun", "flat", "ends", "token"))
        assert got.ids_of.tolist() == [len(_ids(t)) + 1 for t in texts]


def test_gradient():
    got, counts, flat = _model(_some_texts())
    rows = lm.Blocks(got, counts, 1)
    total = lambda f: sum(lm.forward(lm.weights(f), rows, p, k, True)[0].sum() for k, p in rows.batches(7))
    g = sum(lm.forward(lm.weights(flat), rows, p, k, True)[1].astype(float) for k, p in rows.batches(7))
    parts = np.cumsum([0, *(np.prod(shape) for shape in lm.SHAPES.values())])
    for a, b in itertools.pairwise(parts):
        for k in a + np.argsort(-abs(g[a:b]))[:4]:
            step = np.zeros(lm.LENGTH, np.float32)
            step[k] = 2e-2
            assert (total(flat + step) - total(flat - step)) / 4e-2 == pytest.approx(g[k], rel=0.03, abs=0.02)


def _runs(text, more=1):
    """Three words and what follows them (or not), at every place."""
    ws = [*common.words_of(text), b""]
    return collections.Counter(tuple(ws[k - 3 : k + more]) for k in range(3, len(ws)))


def _plain(texts, trains, flat):
    """Every text's log10 probability, one token after another."""
    w, c = lm.weights(flat.astype(float)), collections.Counter
    starts = lm.subwords(packing.tokenizer_file()).starts
    begin, whole, firsts, pair, memory, context = c(), c(), c(), c(), c(), c()
    for t in itertools.compress(texts, trains):
        for word in common.words_of(t):
            if len(word) > lm.WORD_BYTES:
                continue
            ids = _cut(word)
            begin.update(ids[:k] for k in range(1, len(ids) + 1))
            whole[ids] += 1
            firsts[ids[0]] += 1
        firsts[lm.END] += 1
        pair.update(itertools.pairwise([lm.END, *_ids(t), lm.END]))
        for m, x in ((memory, _runs(t)), (context, _runs(t, 0))):
            m.update(x)
    alone, after, known = c(), c(), c()
    for (a, b), n in pair.items():
        alone[b] += n
        after[a] += n
        known[a] += n if starts[b] else 0
    every, begun = sum(alone.values()), sum(firsts.values()) + 0.5 * starts.sum()
    one = lambda y: (alone[y] + 0.5) / (every + 0.5 * lm.VOCAB)
    two = lambda a, y: (pair[a, y] + 8 * one(y)) / (after[a] + 8)
    stop = {}

    def spelled(before, ids, own):
        a, y = before[-1], ids[0]
        p = (pair[a, y] + 8 * (firsts[y] + 0.5) / begun) / (known[a] + 8)
        if ids == (lm.END,):
            return p
        for k in range(1, len(ids)):
            p *= (max(begin[ids[: k + 1]] - own, 0) + 2 * two(ids[k - 1], ids[k])) / (max(begin[ids[:k]] - own, 0) + 2)
        if ids[-1] not in stop:
            stop[ids[-1]] = sum(two(ids[-1], y) for y in np.flatnonzero(starts).tolist())
        return p * (max(whole[ids] - own, 0) + 2 * stop[ids[-1]]) / (max(begin[ids] - own, 0) + 2)

    def row(ids):
        return w["first"][ids[0]] + w["last"][ids[-1]]

    def model(tokens, t, own):
        of = lambda j: tokens[j - 1] if j else (lm.END,)
        seen = np.log1p(whole[of(t)] if of(t) != (lm.END,) else firsts[lm.END]) / 10
        slots = [(max(0.05, 1 + (row(of(t))[-1] + seen * w["seen"][0]) / 8) ** 8, spelled(of(t), tokens[t], own))]
        for j in range(max(0, t // lm.BLOCK - 1) * lm.BLOCK, t):
            x = 1 + w["place"][t % lm.BLOCK, j - (t // lm.BLOCK - 1) * lm.BLOCK] / 8
            x += row(of(t))[: lm.WIDTH] @ row(of(j))[lm.WIDTH : 2 * lm.WIDTH] * lm.WIDTH**-0.5 / 8
            slots.append((max(0, x) ** 8, float(tokens[j] == tokens[t])))
        return sum(a * p for a, p in slots) / sum(a for a, _ in slots)

    out = []
    for text, own in zip(texts, trains, strict=True):
        ws = [*common.words_of(text), b""]
        tokens = [_cut(x) for x in ws[:-1]] + [(lm.END,)]
        mine, around = (_runs(text), _runs(text, 0)) if own else (c(), c())
        total = 0.0
        for k in range(len(ws)):
            p, at = model(tokens, k, int(own)), tuple(ws[k - 3 : k]) if k >= 3 else ()
            n = context[at] - around[at] if k >= 3 else 0
            total += math.log10((memory[(*at, ws[k])] - mine[(*at, ws[k])] + 0.25 * p) / (n + 0.25) if n else p)
        out.append(total)
    return out


def test_scores_equal_those_of_one_token_after_another(spark, monkeypatch):
    texts = [*ODD[:7], *_some_texts(30), "same three words here again and same three words here too " * 3, "x" * 200]
    _, _, flat = _model(["x"], 3)
    monkeypatch.setattr(lm, "train", lambda *_: flat)
    got = {r["doc_id"]: r["score"] for r in lm.score(docs(spark, texts, extra=True)).collect()}
    want = _plain(texts, [zlib.crc32(str(i).encode()) % 7 != 2 for i in range(len(texts))], flat)
    assert [got[i] for i in range(len(texts))] == pytest.approx(want, rel=1e-4)


def test_spelling_is_a_distribution():
    _, counts, _ = _model(_some_texts())
    first = np.exp(counts.first.reshape(lm.VOCAB, lm.VOCAB).astype(float))
    assert first.sum(1) == pytest.approx(np.ones(lm.VOCAB), rel=1e-4) and not first[:, ~counts.starts].any()
    known = _cut(b"unbelievably")
    for some in (known[:1], known[:2], known, _cut(b"never") + (5,)):
        ids = [*some]
        more = [[*ids, y] for y in range(lm.VOCAB) if not counts.starts[y]]
        every = [ids, *more]
        got = lm.Texts(np.array([len(every)]), np.arange(len(every)), np.array([y for x in every for y in x], np.uint16), np.cumsum([0, *map(len, every)]))
        at = got.ends[1:] - 1
        begun, last = counts._of(got.begun)[at], got.flat[at]
        a = float(counts.WEIGHTS[0])
        go_on = (begun[1:] + a * counts.pair[ids[-1], last[1:]]) / (begun[0] + a)
        over = (counts._of(got.hashes[:1])[0] + a * counts.stop[ids[-1]]) / (begun[0] + a)
        assert go_on.sum() + over == pytest.approx(1, rel=1e-4)


def test_base_scores(spark, monkeypatch):
    monkeypatch.setattr(lm, "train", lambda *_: lm.start())
    texts = [*ODD, *(f"a b c w{k} {'x ' * k}" for k in range(30))]
    got = {r["doc_id"]: r for r in lm.score(docs(spark, texts, extra=True)).collect()}
    c = collections.Counter()
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update([*common.words_of(t), b""])
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(texts):
        w = [*common.words_of(t), b""]
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)
        assert got[i]["score"] < 0 and math.isfinite(got[i]["score"])
    assert lm.score(docs(spark, texts).where("false")).count() == 0


def test_weights_learn_from_every_training_document(spark):
    texts = _some_texts(300)
    table = lm.gathered(docs(spark, texts), packing.tokenizer_file()).where(F.col("class") > lm.WORD)
    rows = [(r["class"], [i for i, _ in np.frombuffer(r["head"], np.int64).reshape(-1, 2).tolist()]) for r in table.collect()]
    assert sorted(i for k, ids in rows if k >= 0 for i in ids) == [i for i in range(300) if zlib.crc32(str(i).encode()) % 7 != 2]
    assert sorted(i for _, ids in rows for i in ids) == list(range(300))
    _, counts, _ = _model(texts)
    adam, flat = lm.Adam(lm.start()), lm.start()
    for c in range(lm.CLASSES):
        if some := [texts[i] for k, ids in rows if k == c for i in ids]:
            got, _, _ = _model(some)
            blocked = lm.Blocks(got, counts, 1)
            flat = adam(sum(lm.forward(lm.weights(flat), blocked, p, k, True)[1].astype(float) for k, p in blocked.batches()) / len(got.token))
    got = lm.train(table, spark.sparkContext.broadcast(counts))
    assert np.abs(got - flat).max() < 1e-2 and np.abs(got - lm.start()).max() > 0.1


def test_no_row_for_every_different_word(spark):
    """A task holds its rows until they are sorted: one a word took more memory than an executor has."""
    rows = lm.gathered(docs(spark, [" ".join(f"w{k}x{j}" for j in range(100)) for k in range(200)]).repartition(1), packing.tokenizer_file())
    assert rows.where(F.col("class") <= lm.WORD).count() <= lm.RANGES and rows.count() <= lm.RANGES + lm.CLASSES + 1


def test_scores_do_not_depend_on_the_layout(spark):
    texts = [*_some_texts(200), *_some_texts(20)]
    one, many = ({r["doc_id"]: r["score"] for r in lm.score(docs(spark, texts).repartition(n)).collect()} for n in (1, 7))
    assert all(many[i] == pytest.approx(one[i], rel=1e-4) for i in one)


def test_rows_with_null_ids_and_repeated_rows_are_scored(spark, monkeypatch):
    monkeypatch.setattr(lm, "train", lambda *_: lm.start())
    rows = [(None, "null id here", "en", "s", 0), (None, None, "en", "s", 0), (1, "twice the same row", "en", "s", 0), (1, "twice the same row", "en", "s", 0)]
    got = [(r["doc_id"], r["n_tokens"], r["train_tokens"]) for r in lm.score(spark.createDataFrame(rows, DOC)).collect()]
    n = sum(k for i, k in ((None, 4), (None, 1), (1, 5), (1, 5)) if common.crc_mod(i, 7) != 2)
    assert sorted(got, key=str) == sorted([(None, 4, n), (None, 1, n), (1, 5, n), (1, 5, n)], key=str)


def test_held_out_scores_beat_word_counts(spark):
    got = lm.score(common.documents(spark, "/root/testdata/sf0.001")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


# quality


def _scored(d, labels, targets=("quality", "toxic")):
    feats = quality.featured(d, labels, list(targets))
    return quality.score(feats, quality.learn(feats, list(targets)))


def test_quality_on_held_back_labels(spark):
    d = common.documents(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = _scored(d, labels.where("doc_id % 2 = 0")).withColumnsRenamed({"quality": "q", "toxic": "t"}).join(labels.where("doc_id % 2 = 1"), "doc_id")
    n = got.count()
    assert got.where("(q >= 0.5) = (quality = 1)").count() / n > 0.95 and got.where("(t >= 0.5) = (toxic = 1)").count() / n > 0.96


def test_quality_edges(spark):
    d = docs(spark, ODD, extra=True)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = _scored(d, none).collect()
    assert len(got) == len(ODD) and {r["quality"] for r in got} == {0.5}
    assert _scored(d.where("false"), none, ["quality"]).count() == 0
    labels = spark.createDataFrame([(0, None, None, "x"), (1, 7, 0, "x"), (2, 0, 0, "x"), (2, 1, 0, "x"), (None, 1, 1, "x"), (99, 1, 1, "x")], "doc_id long, quality int, toxic int, text string")
    rows = {r["doc_id"]: (r["quality"], r["toxic"]) for r in _scored(d, labels).collect()}
    assert set(rows.values()) == {(1.0, 0.0)}  # one kind of label each, of documents that exist


def test_views_hand_over_the_surest_of_all_documents(spark, monkeypatch):
    monkeypatch.setattr(quality, "GROW", 4)
    rng = random.Random(3)
    rows = []
    for k in range(600):
        good = k % 2
        words = rng.choices(["fine", "clear", "sound"] if good else ["junk", "spam", "trash"], k=rng.randint(1, 30)) + rng.choices(["and", "the", "of"], k=20)
        rows.append((k, " ".join(words), "en", "good" if good else "bad", 0))
    d = spark.createDataFrame([*rows, *rows[-20:]], DOC).repartition(5)
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, quality int")
    feats = quality.featured(d, labels, ["quality"])
    seen = []
    monkeypatch.setattr(quality.Pupil, "learn", lambda self, view, some, before=quality.Pupil.learn: (seen.append((view, some, self.models[1 - view])), before(self, view, some)))
    models = quality.learn(feats, ["quality"])
    every = [r for r in feats.collect() if r["quality"] is None]
    taught = [set(), set()]
    assert len(seen) == 2 * quality.ROUNDS
    for view, some, (w, b) in seen:
        margin = {r["key"]: quality._sparse([[r["words"]], [r["page"]]])[1 - view].dot(w)[0] + b for r in every}
        want = set()
        for y in (0, 1):
            sure = sorted((-(m if y else -m), k) for k, m in margin.items() if k not in taught[view] and (m if y else -m) > 1)
            want |= {(y, k) for _, k in sure[:4]}
        assert {(r[0], r[1]) for r in some} == want and len(some) == len(want)
        taught[view] |= {r[1] for r in some}
    got = quality.score(feats, models).where("doc_id >= 200").collect()
    assert len(got) == 420 and sum((r["quality"] >= 0.5) == (r["doc_id"] % 2 == 1) for r in got) > 400
