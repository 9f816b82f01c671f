"""The pipeline, stage by stage, on a small table with one case of each kind."""

import collections
import itertools
import random

import numpy as np
import pytest

from atlaswright.llm import packing

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_keep_columns_and_clean_documents(spark, tmp_path):
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    base.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, counts = base, [base.count()]
    for name, stage in pipeline.STAGES[:-1]:
        out = pipeline.cut(stage(spark, docs, str(tmp_path)))
        assert out.columns == base.columns and out.dtypes == base.dtypes, name
        assert out.join(docs, "doc_id", "left_anti").count() == 0
        docs = out
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.7 * counts[0]
    pieces = pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    per = collections.Counter()
    for r in pieces:
        per[r["doc_id"]] += r["length"]
    assert {r["doc_id"]: r["doc_tokens"] for r in pieces} == dict(per) and len(per) == counts[-1]


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def _shingles(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def _alike(a, b):
    """Similarity of two texts' sets of five-word shingles."""
    a, b = _shingles(a), _shingles(b)
    return len(a & b) / len(a | b)


def _brute(texts, items):
    """The five stages on ``{doc_id: text}``: ids of every document left."""
    left = {i: t for i, t in sorted(texts.items()) if t and any(map(str.isalpha, t))}
    seen, kept = [], {}
    for i, t in left.items():
        good = []
        for line in t.split("\n"):
            near = line.strip() and (line in seen or len(line) >= 20 and any(len(o) >= 20 and abs(len(o) - len(line)) <= 2 and _distance(o, line) <= 2 for o in seen))
            seen.append(line)
            good += [] if near else [line]
        if len(good) == len(t.split("\n")) or "".join(good).strip():
            kept[i] = "\n".join(good)
    label = {i: i for i in kept}
    for a, b in itertools.combinations(kept, 2):
        if _alike(kept[a], kept[b]) >= 0.8:
            low, high = sorted((label[a], label[b]))
            label = {i: low if x == high else x for i, x in label.items()}
    kept = {i: t for i, t in kept.items() if label[i] == i}
    windows = lambda t, n: (" ".join(t.lower().split()[k : k + n]) for k in range(len(t.split()) - n + 1))
    kept = {i: t for i, t in kept.items() if not any(_alike(w, item) >= 0.8 for item in items for w in windows(t, len(item.split())))}
    encode = packing.encoder(packing.tokenizer_file())
    return {i: np.frombuffer(encode(t), "<u4").tolist() for i, t in kept.items()}


def test_run_against_brute_force(spark, tmp_path):
    rng = random.Random(7)
    fresh = itertools.count()
    words = lambda n: [f"w{next(fresh)}{rng.choice('abcdefg') * 3}" for _ in range(n)]
    text = lambda w: " ".join(w)
    base, cut, far, line, item = words(120), words(120), words(120), text(words(8)), words(30)
    texts = {
        1: text(base), 2: text(base + words(24)), 3: text(cut), 4: text(cut[:98]), 5: text(far), 6: text(far + words(40)),
        7: f"{text(words(9))}\n{line}", 8: f"{line}x\n{text(words(9))}", 9: f"{line}\n", 10: text(words(10) + item + words(10)), 11: None, 12: "123 456", 13: text(words(50)),
    }
    assert all(0.8 <= _alike(texts[a], texts[b]) < 0.85 for a, b in ((1, 2), (3, 4))) and _alike(texts[5], texts[6]) < 0.8
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, text(item))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = _brute(texts, [text(item)])
    assert sorted(want) == [1, 3, 5, 6, 7, 8, 13]
    got = {r["doc_id"]: r["doc_tokens"] for r in pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {i: len(ids) + 1 for i, ids in want.items()}
