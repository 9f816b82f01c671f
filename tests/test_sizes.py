"""Operators on keys that many rows share: what they return does not grow with the pairs of these, nor may their work."""

import random
from collections import Counter
from itertools import product

from pyspark.sql import functions as F

from atlaswright.operators import details, routing


def test_many_centrelines_between_the_same_nodes(spark):
    """2,000,000,000 pairs of a path and a centreline; a long path goes out from the centrelines."""
    lines = spark.range(100_000).select("id", F.lit(1).cast("long").alias("start"), F.lit(2).cast("long").alias("stop"))
    nodes = spark.range(20_000).select(F.col("id").alias("path"), F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("node"))
    nodes = nodes.union(spark.range(100).select(F.lit(-1).cast("long"), "id"))
    got = routing.completing(nodes, lines, spark.createDataFrame([(3, 2, 1)], "path long, src long, dst long"))
    assert got.agg(F.count("*"), F.max("centreline"), F.count_if(F.col("path") == 3)).first() == (20_000, 0, 0)


def test_many_features_open_one_layer(spark):
    """400,000,000 pairs of a feature and an associated one."""
    features = spark.range(20_000).select("id", F.lit("D").alias("details"))
    layer = spark.range(20_000).agg(F.lit("D").alias("layer"), F.collect_list("id").alias("associated"))
    opened, tagged = details.attached_details(features, layer, spark.range(30_000).select("id", (F.col("id") % 7).alias("connection")))
    assert opened.count() == 20_000 and {r["connection"]: r["layers"] for r in tagged.collect()} == {k: ["D"] for k in range(7)}


def test_many_paths_share_a_node(spark):
    """400,000,000 pairs of paths."""
    paths = spark.range(40_000).select(F.lit(0).alias("source"), F.lit(0).alias("type"), F.col("id").alias("path"), F.when(F.col("id") < 20_000, "pre").otherwise("post").alias("order"), F.lit(5).cast("long").alias("node"))
    assert [tuple(r) for r in routing.paired_paths(paths).collect()] == [(0, 0, 0, 20_000, 5)]


def test_pairs_are_those_of_all_paths(spark):
    rnd = random.Random(3)
    rows = {(rnd.randrange(2), 0, path, "pre" if path % 2 else "post", rnd.randrange(12)) for path in range(120) for _ in range(rnd.randrange(1, 9))}
    shared = Counter((s, a, b) for (s, _, a, x, m), (t, _, b, y, n) in product(rows, rows) if s == t and m == n and x == "pre" and y == "post")
    first = {}
    for (s, a, b), n in sorted(shared.items()):
        if n == 1:
            first.setdefault((s, a), b)
    best = {}
    for (s, a), b in sorted(first.items()):
        best.setdefault((s, b), a)
    got = routing.paired_paths(spark.createDataFrame(list(rows), "source int, type int, path long, order string, node long"))
    assert {(r["source"], r["post"]): r["pre"] for r in got.collect()} == best


def test_lines_that_ask_the_same(spark):
    """3,000 lines ask the same of 30,000 paths, which answers both tiers for all of them at once."""
    from atlaswright.operators import assembly

    cols = "type int, a long, a_organ long, b long, b_organ long"
    lines = spark.range(3_000).select(F.col("id").alias("line"), F.from_csv(F.lit("0,1,,2,9"), cols).alias("l")).select("line", "l.*").union(spark.createDataFrame([(5_000, 0, 1, None, 3, None)], "line long, " + cols))
    nodes = spark.range(30_000).select(F.col("id").alias("path"), F.lit(0).alias("type"), F.explode(F.array(*[F.array(*[F.lit(t).cast("long") for t in ts]) for ts in ((1,), (2, 9), (3, 8))])).alias("terms"))
    ends = nodes.withColumn("is_end", F.col("path") == 7).where("path < 3 or path = 7 or terms[0] <> 3")
    got = assembly.validated_by_terms(lines, ends.where("path < 8"))
    assert got.groupBy("line").agg(F.sum("tier"), F.min("path")).groupBy("sum(tier)", "min(path)").count().collect() == [(1, 7, 3_001)]
    plain = lines.select("line", "type", "a", "b").where("line < 3000")
    flat = ends.select("type", "path", F.col("terms")[0].alias("node"), "is_end")
    got = assembly.validated(plain, flat.where("path < 5"))
    assert got.agg(F.count("*"), F.min("tier"), F.max("tier")).first() == (15_000, 2, 2)


def test_hosts_of_the_same_proxies(spark):
    """Numbers are those of a host's models, worked out once; a host with two models has one row of numbers."""
    from atlaswright.operators import terms

    made = spark.createDataFrame([(10, 0, 1), (11, 0, 1), (11, 1, 2), (1, 0, 2)], "feature long, ord int, proxy long")
    drawn = spark.createDataFrame([(1, 100), (1, 101), (2, 101), (2, 102)], "model long, id long")
    got = terms.proxy_features(made, drawn)
    assert sorted(map(tuple, got.collect())) == [(10, 100, 0), (10, 101, 0), (11, 100, 1), (11, 101, 1), (11, 101, 2), (11, 102, 0)]


def test_nearest_terms_in_matrices(spark):
    """As the expression has them; 2,000 queries against 20,000 terms of 64 numbers take matrices. What lacks a number comes last."""
    from pyspark.sql import Window

    from atlaswright.operators import rollups

    vector = lambda n, seed: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.pmod(F.hash("id", k, F.lit(seed)), F.lit(1000)).cast("float") - 300)
    terms = spark.range(300).select(F.col("id").alias("term"), vector(5, 1).alias("vector"))
    queries = spark.range(20).select(F.col("id").alias("query"), vector(5, 2).alias("vector"))
    score = F.round(rollups.cosine(F.col("vector"), F.col("qv")), 6).alias("score")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "term"))
    want = terms.crossJoin(queries.withColumnRenamed("vector", "qv")).select("query", "term", score).withColumn("rank", rank).where("rank <= 4")
    assert sorted(map(tuple, rollups.top_k(queries, terms, 4).collect())) == sorted(map(tuple, want.collect()))
    odd = terms.where("term < 2").union(spark.createDataFrame([(7, None), (5, [1.0]), (6, [1.0, None, 2.0, 3.0, 4.0])], "term long, vector array<float>"))
    got = rollups.top_k(queries.where("query = 3"), odd, 4).orderBy("rank").collect()
    assert [r["term"] for r in got][2:] == [5, 6] and [r["score"] is None for r in got] == [False, False, True, True]
    many = lambda n, name, seed: spark.range(n).select(F.col("id").alias(name), vector(64, seed).alias("vector"))
    assert rollups.top_k(many(2_000, "query", 3), many(20_000, "term", 4), 5).count() == 10_000


def test_walks_of_more_than_thirteen_steps(spark):
    """The SQL of GR-9 and GR-21 stops after 13 steps, the operators do not."""
    from atlaswright.operators import assembly, graph

    edges = spark.range(19).select(F.lit(1).cast("long").alias("path"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert graph.between(edges, graph.terminals(edges)).count() == 19
    ends = spark.createDataFrame([(1, 0)], "path long, node long")
    got = assembly.upstream(edges, ends, spark.createDataFrame([(19,)], "node long"), spark.createDataFrame([(50,)], "node long"))
    assert [tuple(r) for r in got.collect()] == [(1, 0, 19, 19)]
