"""Further cases of the training-data operators: clashing names, many labels, ids that are null or repeat."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from atlaswright.llm import common, decontam, jaccard, langid, lines, packing, substrings

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOC).repartition(3)


def test_unused_names(spark):
    df = spark.range(1).select("id", F.lit(1).alias("own"), F.lit(2).alias("_OWN"))
    assert common.unused(df, "own", "other", "other") == ["__own", "other", "_other"]


@pytest.mark.parametrize("name", ["__text", "__gone", "__id", "own", "numbers", "cleaned", "_own", "line", "line_no", "h"])
def test_columns_of_any_name_pass_the_line_stage(spark, name):
    d = docs(spark, [(1, "a line of some length here\nx"), (2, "a line of some length here\ny"), (None, "a line of some length here"), (3, "a line of some length here")])
    got = lines.without(d.withColumn(name, F.lit("kept")))
    assert got.columns == [*d.columns, name]
    assert sorted(((r["doc_id"], r["text"], r[name]) for r in got.collect()), key=str) == sorted([(1, "a line of some length here\nx", "kept"), (2, "y", "kept"), (None, "a line of some length here", "kept")], key=str)


def test_repeated_ids_lose_the_same_lines(spark):
    d = docs(spark, [(1, "one line of twenty characters\nz"), (2, "one line of twenty characters\na"), (2, "one line of twenty characters\na")])
    assert sorted((r["doc_id"], r["text"]) for r in lines.without(d).collect()) == [(1, "one line of twenty characters\nz"), (2, "a"), (2, "a")]


def test_many_labels_are_no_error(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LABELS", 3)
    rows = [(k, t, lang, "s", 1) for k, (t, lang) in enumerate([("the cat and the dog", "en")] * 9 + [("der hund und die katze", "de")] * 8 + [("le chien et le chat", "fr")] * 7)]
    rows += [(100 + k, "noise", f"label{k}", "s", 1) for k in range(5000)]
    sample = langid.training_sample(spark.createDataFrame(rows, DOC))
    assert {lang for lang, _ in sample} == {"en", "de", "fr"}
    models = langid.fit(sample)
    got = langid.identify(docs(spark, [(1, "the dog"), (None, "die katze"), (2, None)]), models).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in got} == {1: "en", None: "de", 2: "und"}


ODD = [(None, "one two three four five six seven"), (None, None), (1, ""), (1, "one two three four five six seven"), (2, "one two three four five six seven"), (2, "one two three four five six seven"), (3, "x " * 30_000)]


def test_null_and_repeated_ids_in_jaccard(spark):
    got = jaccard.join(docs(spark, ODD)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == {1: 1, 2: 1, 3: 3}


def test_null_and_repeated_ids_in_substrings(spark):
    text = "a passage of text that is well over fifty bytes long, and then some more of it"
    got = substrings.remove(docs(spark, [(1, text), (2, text), (None, text), (3, None)])).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in got if r["doc_id"] is not None) == [(1, 0), (2, len(text)), (3, 0)]


def brute_removed(texts, length=50):
    """Removed bytes of each document, by every window's least holder."""
    first = {}
    for i, t in sorted(texts.items()):
        for k in range(len(t) - length + 1):
            first.setdefault(t[k : k + length], i)
    out = {}
    for i, t in texts.items():
        gone = [False] * len(t)
        for k in range(len(t) - length + 1):
            if first[t[k : k + length]] < i:
                gone[k : k + length] = [True] * length
        out[i] = sum(gone)
    return out


def test_one_anchor_in_many_contexts(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda n: bytes(rng.choices(b"abcdefgh", k=n))
    middle = b"the same passage of thirty"
    around = [word(40) for _ in range(40)]
    texts = {k: word(rng.randrange(5)) + rng.choice(around)[-rng.randrange(1, 40) :] + middle + rng.choice(around)[: rng.randrange(1, 40)] for k in range(10_000)}
    want = brute_removed(texts)
    d = docs(spark, [(i, t.decode()) for i, t in texts.items()])
    for hot in (0, 3, 10**9):  # every shared anchor, some, none
        monkeypatch.setattr(substrings, "HOT", hot)
        monkeypatch.setattr(substrings.blocks, "BLOCK_BYTES", 20_000)
        monkeypatch.setattr(substrings.blocks.blocks, "__defaults__", (20_000, False))
        got = {r["doc_id"]: r["n_removed"] for r in substrings.remove(d, buckets=5).collect()}
        assert got == want and sum(want.values()) > 100_000


def test_null_ids_and_items_in_decontamination(spark):
    item = " ".join(f"word{k}" for k in range(30))
    bench = spark.createDataFrame([(1, item), (None, "other " * 20), (2, None)], "item_id long, text string")
    got = decontam.matches(docs(spark, [(1, f"before {item} after"), (None, item), (2, None), (3, "clean text " * 50), (4, f"{'filler ' * 60_000}{item}")]), bench)
    assert sorted(r["doc_id"] for r in got.collect() if r["doc_id"] is not None) == [1, 4]


def test_packing_of_odd_tables(spark):
    assert packing.pack(docs(spark, [])).count() == 0
    got = packing.pack(docs(spark, [(None, "a b"), (1, "a b"), (1, "a b"), (2, None)])).collect()
    assert sorted((r["doc_id"] or 0, r["doc_tokens"]) for r in got) == [(0, 3), (1, 3), (1, 3), (2, 1)]


def test_every_stage_of_the_pipeline_takes_odd_tables(spark, tmp_path):
    bench = " ".join(f"item{k}" for k in range(30))
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    plain = [(k, " ".join(f"w{k}x{j}" for j in range(40)) + f"\na shared line of the corpus {k}", "en", "s", 1) for k in range(20)]
    odd = [(None, "some text without an id", "en", "s", 1), (3, plain[3][1], "en", "s", 1), (50, None, "en", "s", 0), (51, "", None, "s", 0), (52, "12 34", "en", "s", 5), (53, "long " * 50_000, "en", "s", 1), (54, f"x {bench} y", "en", "s", 1)]
    for rows in ([], [*plain, *odd]):
        d = spark.createDataFrame(rows, DOC).select("*", *[F.lit("clash").alias(c) for c in ("__text", "own", "h", "key", "component_id", "lang_pred", "block", "rank", "__0")])
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, d, str(tmp_path))
            if name != "packing":
                assert after.columns == d.columns
                d = common.cut(after)
        if not rows:
            assert after.count() == 0
            continue
        kept = sorted(r["doc_id"] for r in d.collect() if r["doc_id"] is not None)
        assert kept == sorted([*range(20), 3, 53]) or kept == sorted([*range(20), 53])
        assert {r["doc_id"] for r in after.collect()} >= set(range(20))
