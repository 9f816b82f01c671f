"""Small hand-made fixtures for operators whose meaning the driver tables do not show."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from atlaswright.functions import colour, geometry, markup, pathtype, text
from atlaswright.operators import classify, details, enrich, graph, rollups, spatial
from atlaswright.sources import documents, sinks
from atlaswright.streaming import monitor


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_markup(spark):
    p = markup.parsed(F.lit(".id(UBERON:1) class(x-1) name(Left lung) details(d1, 4) node boundary marker"))
    row = one(spark, *[c.alias(k) for k, c in p.items()])
    assert (row["id"], row["class"], row["name"], row["details"], row["maxzoom"]) == ("UBERON:1", "x-1", "Left lung", "d1", 3)
    assert row["flags"] == ["boundary", "marker", "node"] and row["warning"] == "Deprecated `marker`" and row["error"] is None
    assert one(spark, markup.parsed(F.lit("Lung"))["error"])[0] == "Syntax error"


def test_colours(spark):
    lab = lambda c: colour.lab(F.lit(c))
    same, far = one(spark, colour.delta_e(lab("#F00"), lab("#ff0000")), colour.delta_e(lab("#FF0000"), lab("#548235")))
    assert same == pytest.approx(0, abs=1e-9) and far > 20
    # a published pair of the CIEDE2000 test data
    p, q = (F.struct(*[F.lit(float(v)).alias(k) for k, v in zip("lab", c, strict=True)]) for c in ((50, 2.6772, -79.7751), (50, 0, -82.7485)))
    assert one(spark, colour.delta_e(p, q))[0] == pytest.approx(2.0425, abs=1e-4)


def test_palette_takes_the_first_near_entry(spark):
    shapes = spark.createDataFrame([(1, "#FF0101"), (2, "#123"), (3, None)], "id int, colour string")
    palette = spark.createDataFrame([(0, "#FF0000", "a"), (1, "#FF0001", "b")], "ord int, colour string, kind string")
    assert {r["id"]: r["kind"] for r in classify.palette_join(shapes, palette, "other").collect()} == {1: "a", 2: "other", 3: "other"}


def test_path_types(spark):
    row = one(spark, pathtype.from_phenotypes(F.array(F.lit("ilxtr:PreGanglionicPhenotype"), F.lit("ilxtr:ParasympatheticPhenotype"))), pathtype.viewer_kind(F.lit(72)), pathtype.name(F.lit(44)), pathtype.from_phenotypes(F.array(F.lit("x"))))
    assert tuple(row) == (72, "para-pre", "post-ganglionic sympathetic", 1)


def test_geometry(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 2), (0, 2))])
    row = one(spark, geometry.ring_area(ring), geometry.contains_point(ring, F.lit(1.0), F.lit(1.0)), geometry.contains_point(ring, F.lit(5.0), F.lit(1.0)), geometry.path_length(ring))
    assert tuple(row) == (8.0, True, False, 10.0)


def test_uuid(spark):
    import uuid

    ns = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
    assert one(spark, text.uuid5(ns, F.lit("map")))[0] == str(uuid.uuid5(uuid.UUID(ns), "map"))


def test_text_clusters_anchor_at_their_head(spark):
    rows = spark.createDataFrame([(0, k, b) for k, b in enumerate([10.0, 10.5, 12.0, 14.0, 14.9, 15.2])], "group int, seq long, baseline double")
    got = rollups.text_clusters(rows, 1.0).orderBy("seq").collect()
    assert [r["cluster"] for r in got] == [1, 1, 2, 3, 3, 4]


def test_prune_and_chains(spark):
    edges = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 3, 4), (1, 3, 5), (1, 5, 6)], "path long, src long, dst long")
    keep = spark.createDataFrame([(4,), (5,)], "node long")
    assert {tuple(r) for r in graph.pruned(edges, keep).collect()} == {(1, 3, 4), (1, 3, 5)}
    assert {(r["a"], r["b"], tuple(r["inner"])) for r in graph.chains(edges).collect()} == {(1, 3, (2,)), (3, 4, ()), (3, 6, (5,))}


def test_bypass_joins_what_is_left(spark):
    edges = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (2, 7, 8), (2, 7, 9)], "path long, src long, dst long")
    gone = spark.createDataFrame([(2,), (7,)], "node long")
    assert {(*r[:4], *r["missing"]) for r in graph.bypassed(edges, gone).collect()} == {(1, 1, 3, False, 2), (2, 8, 9, False, 7)}


def _bypassed_one_by_one(edges, gone):
    now = {(a, b): (True, frozenset()) for a, b in edges if a != b}
    while at := {n for e in now for n in e} & gone:
        x = min(at)
        before, after = {a for a, b in now if b == x}, {b for a, b in now if a == x}
        made = {(a, b) for a in before for b in after} if before and after else {(a, b) for a in before | after for b in before | after if a < b}
        over = lambda n: now.get((n, x), (0, frozenset()))[1] | now.get((x, n), (0, frozenset()))[1]  # noqa: B023, E731
        through = bool(before and after)
        kept = {e: c for e, c in now.items() if x not in e}
        for a, b in made:
            if a != b and x not in (a, b):
                gone_by = (now[a, x][1] | now[x, b][1] if through else over(a) | over(b)) | {x}
                complete, known = kept.get((a, b), (False, frozenset()))
                kept[a, b] = complete, known | gone_by
        now = kept
    return {(*e, c, *sorted(m)) for e, (c, m) in now.items()}


def test_long_runs_of_missing_nodes_are_bypassed(spark, monkeypatch):
    monkeypatch.setattr(graph, "PLAIN", 1)
    rng = random.Random(1)
    paths = {1: [(0, 4), *((k, k + 1) for k in range(4, 106))]}
    for p in range(2, 12):
        paths[p] = [(rng.randrange(14), rng.randrange(14)) for _ in range(16)]
    missing = set(range(4, 106))
    edges = spark.createDataFrame([(p, *e) for p, es in paths.items() for e in es], "path long, src long, dst long")
    got = graph.bypassed(edges, spark.createDataFrame([(k,) for k in missing], "node long")).collect()
    want = {(p, *e) for p, es in paths.items() for e in _bypassed_one_by_one(es, missing)}
    assert {(*r[:4], *r["missing"]) for r in got} == want and (1, 0, 106, False, *range(4, 106)) in want


def test_long_undrawn_chains_are_pruned(spark):
    chain = [(1, k, k + 1) for k in range(250)] + [(2, k, k + 1) for k in range(230)] + [(2, 0, 300)]
    keep = spark.createDataFrame([(300,), (3,)], "node long")
    edges = spark.createDataFrame(chain, "path long, src long, dst long")
    assert {tuple(r) for r in graph.pruned(edges, keep).collect()} == {(2, 0, 300), (2, 0, 1), (2, 1, 2), (2, 2, 3)}


def test_filtered_paths_without_lists_keeps_all(spark):
    p = spark.createDataFrame([(1,), (2,)], "path long")
    none = p.where("false")
    assert enrich.filtered_paths(p, none, none, p.where("path = 2")).collect()[0]["path"] == 1


def test_inherited_properties(spark):
    rows = spark.createDataFrame([("g", None, {"a": "1", "name": "n", "b": "2"}), ("s", "g", {"b": "3"})], "id string, parent string, props map<string,string>")
    assert {r["id"]: r["props"] for r in enrich.inherited(rows).collect()}["s"] == {"a": "1", "b": "3"}


def test_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"id": " m1 ", "kind": "functional", "sources": [{"id": "s", "href": "x.svg", "kind": "layer"}, {"id": "b", "href": "b.svg", "kind": "base"}]}))
    (tmp_path / "b.json").write_text(json.dumps({"id": "m2", "sources": []}))
    good, bad = documents.manifests(spark, str(tmp_path))
    assert [(r["id"], r["map_kind"]) for r in good.collect()] == [("m1", "functional")] and [r["error"] for r in bad.collect()] == ["No sources"]
    assert [r["id"] for r in documents.ordered_sources(good).orderBy("ordinal").collect()] == ["b", "s"]


def test_property_rules_in_both_layouts(spark):
    new = json.dumps({"features": {"a b": {"label": "x"}}, "classes": {"c": {"label": "y"}}})
    old = json.dumps({"features": [{"id": "a_b", "properties": {"label": "z"}}, {"class": "c", "properties": {"colour": "red"}}]})
    got = documents.property_rules(spark.createDataFrame([(1, 0, new), (1, 1, old)], "map_id long, seq long, json string"))
    assert {(r["scope"], r["key"], r["prop"], r["value"]) for r in got.collect()} == {("id", "a_b", "label", "z"), ("class", "c", "label", "y"), ("class", "c", "colour", "red")}


def test_basic_shapes(spark):
    names = ["x", "y", "width", "height", "r", "rx", "ry", "cx", "cy", "x1", "y1", "x2", "y2", "points"]
    rows = [("rect", {"width": "2", "height": "1"}), ("rect", {"width": "-2", "height": "1"}), ("polygon", {"points": "0,0 1,0 1,1"}), ("circle", {"r": "2"})]
    df = spark.createDataFrame([(t, *[a.get(n) for n in names]) for t, a in rows], "tag string, " + ", ".join(f"{n} string" for n in names))
    got = [r[0] for r in df.select(documents.basic_shape(F.col("tag"), {n: F.col(n) for n in names})).collect()]
    assert len(got[0]) == 5 and got[1] is None and len(got[2]) == 4 and got[2][0] == got[2][3]
    assert math.hypot(got[3][7]["x"], got[3][7]["y"]) == pytest.approx(2)


def test_streams(spark, tmp_path):
    log = tmp_path / "in"
    log.mkdir()
    rows = [{"map_id": 1, "seq": k, "ts": f"2026-01-01T0{k}:00:00", "level": "error", "msg": "Cannot find feature for node", "type": "e", "node": k // 2, "path": 0} for k in range(6)]
    (log / "a.json").write_text("\n".join(map(json.dumps, rows)))
    q = monitor.keep_missing_nodes(monitor.read(spark, str(log)), str(tmp_path / "out"), str(tmp_path / "cp"), "1 day")
    q.awaitTermination()
    assert sorted(r["node"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2]
    w = monitor.monitor(monitor.read(spark, str(log))).writeStream.format("memory").queryName("w").trigger(availableNow=True).start()
    w.awaitTermination()
    assert spark.table("w").count() >= 4


def test_triples(spark):
    rows = spark.createDataFrame([("a", "K", "L", "l", None, "t")], "id string, kind string, label string, name string, source string, target string")
    assert {(r["p"], r["o"]) for r in sinks.shape_triples(rows).collect()} == {("type", "K"), ("label", "L"), ("hasTarget", "t")}


def test_boxes_of_any_size_meet_once_and_are_dealt_to_few_cells(spark):
    rng = random.Random(1)
    def box(k):
        x, y = rng.randint(-2000, 2000), rng.randint(-2000, 2000)
        size = rng.choice([0, 3, 40, 400, 5000, 300_000])
        return k, x, y, x + rng.randint(0, size), y + rng.randint(0, size)
    left, right = [box(k) for k in range(60)], [box(k) for k in range(80)]
    left.append((60, -10_000_000, -10_000_000, 10_000_000, 10_000_000))
    a, b = (spark.createDataFrame(rows, "id int, x0 long, y0 long, x1 long, y1 long") for rows in (left, right))
    got = sorted((r["a_id"], r["b_id"]) for r in spatial.box_pairs(a, b).collect())
    assert got == sorted((p[0], q[0]) for p in left for q in right if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4])
    huge, points = a.where("id = 60"), b.where("x1 - x0 < 5 and y1 - y0 < 5")
    dealt = spatial._dealt(points.withColumn("own", spatial._level(100)).crossJoin(huge.select(spatial._level(100).alias("level"))), 100, "b_")
    assert dealt.count() <= 4 * points.count() and spatial._dealt(huge.withColumn("level", spatial._level(100)), 100, "a_").count() <= 49


def test_rings_inside_rings(spark):
    ring = lambda *points: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])
    bay = ring((0, 0), (10, 0), (10, 10), (6, 10), (6, 4), (4, 4), (4, 10), (0, 10))  # open between two arms
    inside, across, touching = ring((1, 1), (3, 1), (3, 9), (1, 9)), ring((1, 5), (9, 5), (9, 6), (1, 6)), ring((0, 0), (4, 0), (4, 4), (0, 4))
    found = one(spark, *[geometry.ring_inside(r, bay, proper) for r in (inside, across, touching) for proper in (False, True)])
    assert list(found) == [True, True, False, False, True, False]


def test_chains_against_a_walk(spark):
    rng = random.Random(2)
    edges = {(path, *sorted(rng.sample(range(14), 2))) for path in range(12) for _ in range(13)}
    want = set()
    for path in range(12):
        near = {n: {b if a == n else a for p, a, b in edges if p == path and n in (a, b)} for n in range(14)}
        for start in (n for n in near if near[n] and len(near[n]) != 2):
            for at in near[start]:
                last, via = start, []
                while len(near[at]) == 2:
                    via.append(at)
                    last, at = at, next(iter(near[at] - {last}))
                forms = ((start, at, tuple(via)), (at, start, tuple(reversed(via))))
                want.add((path, *min(forms)))
    got = graph.chains(spark.createDataFrame(sorted(edges), "path int, src long, dst long")).collect()
    assert {(r["path"], *min(((r["a"], r["b"], tuple(r["inner"])), (r["b"], r["a"], tuple(reversed(r["inner"])))))) for r in got} == want
    assert len(got) == len(want)


def test_a_circle_of_components_is_an_error(spark):
    parents = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "id int, parent int")
    with pytest.raises(ValueError):
        details.ensured_systems(parents, spark.createDataFrame([(9, "system")], "id int, kind string"))
