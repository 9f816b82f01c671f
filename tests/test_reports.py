"""Checks, numbers and documents against small cases."""

import json

import pytest
from pyspark.sql import functions as F

from atlaswright.operators import assembly, checks, details, rollups
from atlaswright.sources import documents, scans, sinks


def found(df):
    return sorted((r["location"], r["issue"]) for r in df.collect())


def test_centreline_checks(spark):
    rows = [
        (0, None, None, [1, 2], []), (1, "a", "M", [1, 2, 3], [10, 11, 12, 13]), (2, "a", "M", [4, 5], []), (3, "b", None, [7], []), (4, "c", "N", [3, 2, 8], [1]), (5, "d", "N", [2, 9], []),
    ]
    lines = spark.createDataFrame(rows, "seq long, id string, models string, nodes array<long>, containers array<long>")
    terms = spark.createDataFrame([("a", "X"), ("c", "N"), ("10", "T"), ("11", "T"), ("12", "T"), ("1", "T")], "feature string, models string")
    nerves = spark.createDataFrame([("11", "M"), ("12", "Z")], "feature string, models string")
    text = lambda c: F.transform(c, lambda x: x.cast("string"))
    got = found(checks.centreline_checks(lines.withColumns({"nodes": text("nodes"), "containers": text("containers")}), terms, nerves))
    assert got == sorted([
        ("0", "Centreline has no id"), ("a/2", "Centreline has a duplicate id"), ("b", "Centreline has too few nodes"), ("a", "Centreline models two entities: M, X"),
        ("a/13", "Container has no anatomical term"), ("a/12", "Container models a different nerve"), ("c/1", "Container is also an end node"),
        ("2", "Node is inside several centrelines: a, c"),
    ])


def test_layer_and_proxy_checks(spark):
    layers = spark.createDataFrame([(1, 0, "a", "details", "f", 2), (1, 1, "a", "functional", "g", 0), (1, 2, "b", "base", None, None), (2, 0, "a", "base", None, None), (2, 1, "c", "anatomical", None, 3), (2, 2, "d", "image", None, None)], "map_id long, seq long, id string, kind string, feature string, zoom int")
    got = sorted((r["map_id"], r["location"], r["issue"]) for r in checks.layer_checks(layers, spark.createDataFrame([(1, "f"), (2, "g")], "map_id long, id string")).collect())
    assert got == [(1, "a", "Details layer cannot be the base map"), (1, "a", "Details need a zoom"), (1, "a", "Duplicate layer id"), (1, "a", "Unknown source feature: g"), (1, "b", "Can only have a single base map"), (2, "c", "Details need a feature")]
    proxies = spark.createDataFrame([("A", "B"), ("P", "B"), ("P", "C"), ("P", "Q")], "models string, host string")
    features = spark.createDataFrame([(1, "A", "Polygon"), (2, "B", "Polygon"), (3, "C", "LineString")], "id long, models string, geometry string")
    assert found(checks.proxy_checks(proxies, features)) == [("A", "Proxied feature is already on the map"), ("P/3", "Proxy feature must have a polygon shape"), ("P/Q", "Proxy is missing from the map")]


def test_numbers_and_names_do_not_depend_on_the_layout(spark):
    rows = spark.range(500).select(F.when(F.col("id") % 5 < 3, "big").otherwise(F.concat(F.lit("c"), F.col("id") % 7)).alias("g"), "id")
    got = [sorted(map(tuple, rollups.numbered(rows.repartition(n), ["g"], ["id"]).collect())) for n in (1, 9)]
    assert got[0] == got[1]
    seen = {}
    for g, i, n in got[0]:
        assert n == seen.get(g, 0) + 1, (g, i)
        seen[g] = n
    named = rollups.unique_names(spark.createDataFrame([(k, "a") for k in range(4)] + [(9, "b")], "id long, class string"), spark.createDataFrame([("a-1",), ("a-3",), ("a-4",), ("c-1",)], "name string"))
    assert sorted((r["id"], r["name"]) for r in named.collect()) == [(0, "a-2"), (1, "a-5"), (2, "a-6"), (3, "a-7"), (9, "b-1")]


def test_whole_knowledge_goes_to_maps_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(scans, "MAPS", 2)
    sources = spark.createDataFrame([(k, "NPO") for k in range(5)] + [(0, "NPO"), (7, "u1")], "map_id long, uri string")
    paths = spark.createDataFrame([("u1", "p"), ("u2", "q")], "uri string, path string")
    assert sorted(map(tuple, scans.resolved(sources, paths).collect())) == sorted([(k, p) for k in range(5) for p in "pq"] + [(7, "p")])
    assert scans.resolved(sources.where("uri = 'u1'"), paths).count() == 1


def test_circles_of_components_are_noticed_early(spark):
    chain = [(k, k + 1) for k in range(30)]
    kinds = spark.createDataFrame([(30, "system")], "id long, kind string")
    assert details.ensured_systems(spark.createDataFrame(chain, "id long, parent long"), kinds).count() == 30
    with pytest.raises(ValueError, match="circle"):
        details.ensured_systems(spark.createDataFrame([*chain, (40, 41), (41, 42), (42, 41)], "id long, parent long"), kinds)


def test_terms_match_by_layer_or_organ(spark):
    nodes = spark.createDataFrame([("p", "t", ["x", "l1", "o1"], True), ("p", "t", ["y"], True), ("q", "t", ["x", "l2"], True), ("q", "t", ["o2"], True), ("q", "t", ["y"], False)], "path string, type string, terms array<string>, is_end boolean")
    lines = spark.createDataFrame([(1, "t", "x", "o1", "y", None), (2, "t", "x", None, "y", "o2"), (3, "t", "x", "zz", "y", None), (4, "t", "x", None, "y", None)], "line long, type string, a string, a_organ string, b string, b_organ string")
    got = sorted(map(tuple, assembly.validated_by_terms(lines, nodes).collect()))
    # 1: by the layer, at p's ends; 2: y bare at p, the organ itself at q; 3: nowhere; 4: p by its ends
    assert got == [(1, "p", 1), (2, "p", 1), (2, "q", 1), (4, "p", 1)]


def test_connectivity_documents_in_all_their_forms(spark, tmp_path):
    paths = [
        {"id": "a", "models": "M", "path": "l1, l2", "route": "n1, n2, (n3, n4)", "nerves": "v:1"}, {"id": "b", "route": ["n1", ["n2", "n3"]], "path": ["l1"], "type": "motor"},
        {"id": "c", "connects": ["x", "y"]}, {"id": "d", "path": "l1,", "route": "(n1", "nerves": "a b"}, {"id": "e", "nodes": ["n1"]}, {"id": "e", "nodes": ["n2", "n3"]},
    ]
    (tmp_path / "m.json").write_text(json.dumps({"id": "m", "source": "s", "traced-paths": ["c"], "paths": paths}))
    good, errors = scans.model_paths(spark, str(tmp_path))
    got = {r["path"]: (r["lines"], r["route"], r["nerves"], r["connects"], r["nodes"], r["traced"]) for r in good.collect()}
    assert got == {
        "a": (["l1", "l2"], [["n1"], ["n2"], ["n3", "n4"]], ["v:1"], None, None, False), "b": (["l1"], [["n1"], ["n2", "n3"]], None, None, None, False),
        "c": (None, None, None, ["x", "y"], None, True), "d": (None, None, None, None, None, False), "e": (None, None, None, None, ["n2", "n3"], False),
    }
    assert sorted(r["error"] for r in errors.collect()) == ["Syntax error in nerve list: a b", "Syntax error in path lines list: l1,", "Syntax error in route node list: (n1"]


def test_drawings_as_trees(spark):
    xml = '<svg xmlns="http://www.w3.org/2000/svg"><g id="a"><rect id="r" style="fill: none;stroke:#f00" fill="red"><title>.id(X)</title></rect></g><g/></svg>'
    rows = documents.drawing_tree(spark.createDataFrame([("d", xml), ("e", "<svg"), ("f", None)], "doc string, xml string")).collect()
    got = [(r["doc"], r["seq"], r["tag"], r["id"], r["title"], r["depth"], r["group"], r["fill"], r["stroke"]) for r in rows if r["doc"] == "d"]
    assert got == [("d", 0, "svg", None, None, 0, None, None, None), ("d", 1, "g", "a", None, 1, None, None, None), ("d", 2, "rect", "r", ".id(X)", 2, "a", None, "#f00"), ("d", 3, "g", None, None, 1, None, None, None)]
    assert all(r["tag"].startswith("error") for r in rows if r["doc"] != "d") and len(rows) == 6


def test_encoded_properties_and_excluded_features(spark):
    rows = [(1, "l", [(0.0, 0.0)], False, False, "t", "one", ""), (2, "l", [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0)], False, False, "t", None, "x"), (3, "l", [(0.0, 0.0)], False, True, "t", None, "x")]
    f = spark.createDataFrame(rows, "id long, layer string, points array<struct<x:double,y:double>>, open boolean, exclude boolean, `tile-layer` string, `associated-details` string, label string")
    got = {r["id"]: json.loads(r["annotation"]) for r in sinks.feature_annotations(f, spark.createDataFrame([(2, '["T",[]]')], "id long, node string")).collect()}
    assert set(got) == {1, 2} and got[1]["associated-details"] == '"one"' and "label" not in got[1] and got[2]["anatomical-nodes"] == [["T", []]] and got[2]["geometry"] == "Polygon"
    made = {r["id"]: json.loads(r["feature"]) for r in sinks.feature_documents(f, 2.0 * 4**7).collect()}
    assert made[2]["properties"]["area"] == 2.0 and made[2]["properties"]["scale"] == 7.0 and made[2]["tippecanoe"] == {"layer": "l_t", "minzoom": 4} and made[1]["properties"]["scale"] == 10.0
    assert made[2]["geometry"]["coordinates"][0][0] == made[2]["geometry"]["coordinates"][0][-1]
