"""Routes, loops and chains against cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from atlaswright.operators import assembly, graph, routes


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_routes_worked_out_by_hand(spark):
    connected = {1: [(1, 2), (2, 3), (3, 4)], 2: [(5, 6)], 3: [(7, 8), (8, 9)], 4: [(10, 11), (11, 12)], 5: [(1, 2), (2, 3)], 6: [(13, 14), (14, 15), (15, 16)]}
    edges = frame(spark, [(p, a, b) for p, es in connected.items() for a, b in es], "path long, src long, dst long")
    own = {1: [10], 2: [20, 21], 3: [30], 4: [40], 5: [50, 51], 6: [60], 7: [70], 8: [80], 9: [90], 10: [100], 12: [120], 13: [130], 14: [140], 15: [150], 16: [160]}
    features = frame(spark, [(n, f) for n, fs in own.items() for f in fs], "node long, feature long")
    ids = sorted({f for fs in own.values() for f in fs} | {110, 111})
    places = frame(spark, [(f, float(f), 0.0) for f in ids], "id long, x double, y double")
    # 1: between features of neighbours; 2: of node 11; 3: contains nodes 14 and 15, between 13 and 16
    lines = frame(spark, [(1, 20, 30, []), (2, 110, 111, []), (3, 130, 160, [140, 150])], "id long, start long, stop long, containers array<long>")
    models = frame(spark, [(11, 2)], "node long, centreline long")
    within = frame(spark, [(3, 8, 7)], "path long, outer long, inner long")
    roles = frame(spark, [(1, 1, "source"), (5, 99, "source")], "path long, node long, role string")
    got = sorted(tuple(r) for r in routes.assembled(edges, features, places, models, lines, within, roles).select("path", "a", "b", "type", "centreline").collect())
    assert got == [
        (1, 10, 20, "upstream", None), (1, 20, 30, "centreline", 1), (1, 30, 40, "upstream", None),
        (2, 50, 60, "terminal", None), (2, 51, 60, "terminal", None),  # both features of a terminal with two
        (3, 70, 90, "terminal", None),  # past the unused node that contains the terminal
        (4, 100, 110, "upstream", None), (4, 110, 111, "segment", 2), (4, 111, 120, "upstream", None),  # at the nearest end of the segment
        (6, 130, 160, "contained", 3),  # the ends are on the route by the centreline
    ]


def test_shared_use_orders_the_walks(spark):
    """A node that one walk has visited is no start of another, and terminals with two features come first."""
    edges = frame(spark, [(1, 1, 2), (1, 2, 3), (1, 2, 4)], "path long, src long, dst long")
    nodes = frame(spark, [(1, n, "feature") for n in (1, 2, 3, 4)], "path long, node long, kind string")
    features = frame(spark, [(1, 1, 10, 0.0, 0.0), (1, 2, 20, 5.0, 0.0), (1, 2, 21, 50.0, 0.0), (1, 3, 30, 6.0, 1.0), (1, 3, 31, 49.0, 1.0), (1, 4, 40, 7.0, 0.0)], "path long, node long, feature long, x double, y double")
    empty = lambda schema: frame(spark, [], schema)
    got = routes.walked(nodes, edges, features, empty("path long, feature long, x double, y double, part long"), empty("path long, node long, feature long"), empty("path long, node long, feature long"), empty("path long, outer long, inner long"))
    # the walk from node 3 draws both features of node 2, so both go on from there
    assert sorted((r["src"], r["dst"]) for r in got.collect()) == [(20, 10), (20, 40), (21, 10), (21, 40), (30, 20), (31, 21)]


def test_loops_that_connectivity_does_not_have_go(spark):
    route = frame(spark, [(p, *e) for p in (1, 2) for e in ((1, 2), (2, 3), (1, 3))], "path long, src long, dst long")
    completing = frame(spark, [(1, 1, 3), (2, 1, 3)], "path long, a long, b long")
    connectivity = frame(spark, [(1, 7, 8), (2, 7, 8), (2, 8, 9), (2, 7, 9)], "path long, src long, dst long")
    features = frame(spark, [(1, 7, 1), (1, 8, 3), (2, 7, 1), (2, 8, 3)], "path long, node long, feature long")
    gone = [tuple(r) for r in graph.loop_edges(route, completing, connectivity, features).collect()]
    assert gone == [(1, 1, 3)]  # the second connectivity has two ways between the nodes as well


def test_simple_paths_raise_beyond_their_bound(spark):
    line = frame(spark, [(1, k, k + 1) for k in range(6)], "path long, src long, dst long")
    pairs = frame(spark, [(1, 0, 6)], "path long, a long, b long")
    assert graph.simple_paths(line, pairs).first()["nodes"] == list(range(7))
    with pytest.raises(ValueError, match="steps"):
        graph.simple_paths(line, pairs, bound=4)
    full = frame(spark, [(1, a, b) for a in range(7) for b in range(a)], "path long, src long, dst long")
    assert graph.simple_paths(full, pairs).count() == 326
    with pytest.raises(ValueError, match="walks"):
        graph.simple_paths(full, pairs, most=20)


def test_long_lists_are_ranked_in_a_few_rounds(spark, monkeypatch):
    cuts, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: cuts.append(1) or cut(df))
    links = spark.range(1000).select(F.col("id").alias("key"), F.when(F.col("id") < 999, F.col("id") + 1).alias("next"))
    circle = frame(spark, [(2000, 2001), (2001, 2000)], "key long, next long")
    got = graph.to_ends(links.union(circle)).collect()
    assert sorted(tuple(r) for r in got) == [(k, 999, 999 - k) for k in range(1000)] and len(cuts) <= 13


def test_chains_keep_parallel_runs_apart(spark):
    edges = [(1, 2), (2, 3), (1, 4), (4, 3), (3, 5), (3, 6), (1, 7), (7, 8), (8, 1), (20, 21), (21, 22), (22, 20)]
    got = graph.chains(frame(spark, [(1, *e) for e in edges], "path long, src long, dst long")).collect()
    assert sorted((r["a"], r["b"], r["inner"]) for r in got) == [(1, 1, [7, 8]), (1, 3, [2]), (1, 3, [4]), (3, 5, []), (3, 6, [])]


def test_end_chains_are_ordered_and_closed(spark):
    rows = [(1, 0, 0, 10, 0), (2, 20, 0, 11, 0), (3, 20, 1, 30, 5)]  # 1, then 2 the other way round, then 3
    rows += [(4, 100, 0, 110, 0), (5, 110, 1, 105, 9), (6, 105, 9, 100, 1), (7, 500, 500, 600, 600)]
    got = assembly.end_chains(frame(spark, rows, "id long, x0 long, y0 long, x1 long, y1 long"), 3).orderBy("chain", "place").collect()
    assert [tuple(r) for r in got] == [(1, 1, 0, False, False), (2, 1, 1, True, False), (3, 1, 2, False, False), (4, 4, 0, False, True), (5, 4, 1, False, True), (6, 4, 2, False, True), (7, 7, 0, False, False)]
