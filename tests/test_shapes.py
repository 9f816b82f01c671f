"""Shapes, scales and streams with numbers worked out by hand."""

import json
import math

import pytest
from pyspark.sql import functions as F

from atlaswright.functions import geometry as g
from atlaswright.operators import assembly, details, exports, spatial, tiling
from atlaswright.streaming import monitor


def ring(*points):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


SQUARE = [(0, 0), (4, 0), (4, 4), (0, 4)]


@pytest.mark.parametrize(
    ("other", "area"),
    [
        ([(2, 2), (6, 2), (6, 6), (2, 6)], 4), ([(2, 6), (6, 6), (6, 2), (2, 2)], 4),  # either way round
        ([(0, 0), (4, 0), (0, 4)], 8), ([(2, -2), (6, 2), (2, 6), (-2, 2)], 16), ([(2, -1), (5, 2), (2, 5), (-1, 2)], 14),
        ([(5, 5), (6, 5), (6, 6)], 0), ([(4, 0), (8, 0), (8, 4), (4, 4)], 0),
        ([(1, -1), (2, -1), (2, 3), (3, 3), (3, -1), (5, -1), (5, 5), (1, 5)], 9),  # a U upside down
    ],
)
def test_overlap_of_rings(spark, other, area):
    assert value(spark, g.ring_overlap(ring(*SQUARE), ring(*other))) == pytest.approx(area)
    assert value(spark, g.ring_overlap(ring(*other), ring(*SQUARE))) == pytest.approx(area)


def test_rings_that_only_touch_meet(spark):
    assert value(spark, g.rings_meet(ring(*SQUARE), ring((4, 0), (8, 0), (8, 4), (4, 4))))
    assert not value(spark, g.rings_meet(ring(*SQUARE), ring((5, 0), (8, 0), (8, 4), (5, 4))))
    assert value(spark, g.rings_meet(ring(*SQUARE), ring((1, -1), (2, -1), (2, 9), (1, 9))))  # no corner of one is in the other


@pytest.mark.parametrize(
    ("points", "length"),
    [([(-1, 1), (9, 1)], 4), ([(1, 1), (1, 3), (9, 3)], 5), ([(-1, 4), (9, 4)], 4), ([(0, 0), (4, 4)], math.sqrt(32)), ([(5, 0), (9, 9)], 0), ([(1, 1), (1, 1), (2, 1)], 1), ([(-1, -1), (5, 5), (5, -1), (-1, -1)], math.sqrt(32))],
)
def test_length_of_a_line_in_a_ring(spark, points, length):
    assert value(spark, g.length_inside(ring(*points), ring(*SQUARE))) == pytest.approx(length)


def test_a_line_in_and_out_of_a_notch(spark):
    u = ring((0, 0), (6, 0), (6, 4), (4, 4), (4, 2), (2, 2), (2, 4), (0, 4))
    assert value(spark, g.length_inside(ring((-1, 3), (7, 3)), u)) == pytest.approx(4)


def test_representative_points_lie_inside(spark):
    u = ring((0, 0), (6, 0), (6, 4), (4, 4), (4, 2), (2, 2), (2, 4), (0, 4))
    p = value(spark, g.representative_point(u))
    assert (p["x"], p["y"]) == (1.0, 3.0)  # two runs of equal width halfway between 2 and 4: the first
    assert tuple(value(spark, g.representative_point(ring(*SQUARE)))) == (2.0, 2.0)
    assert value(spark, g.representative_point(ring((0, 1), (5, 1)))) is None


def test_nearest_time_is_refined(spark):
    line = F.array(F.struct(*[F.lit(v).alias(k) for k, v in {"x0": 0.0, "y0": 0.0, "x1": 1.0, "y1": 0.0, "x2": 2.0, "y2": 0.0, "x3": 3.0, "y3": 0.0}.items()]))
    n = value(spark, g.nearest_time(line, F.lit(1.23456), F.lit(2.0)))
    assert n["t"] == pytest.approx(1.23456 / 3, abs=1e-6) and n["d2"] == pytest.approx(4.0)
    assert value(spark, g.nearest_time(line, F.lit(9.0), F.lit(0.0)))["t"] == 1.0


def test_scales_follow_the_steps(spark):
    got = [value(spark, details.metres_per_pixel(F.lit(w), F.lit(h))) for w, h in ((400, 170), (500, 499), (49, 3), (9999, 1), (10_000, 1), (50_000, 1))]
    assert got == [10_000, 5_000, 100_000, 500, 250, 250]  # 5,000,000 over 500, 1000, 50, 10,000, 20,000, 20,000
    fit = lambda rule: value(spark, details.fitted_scale(F.lit(rule).cast("string"), F.lit(6.0), F.lit(8.0), F.lit(2.0), F.lit(2.0)))
    assert [fit(r) for r in ("width", "height", "mean", "smallest", "largest", None)] == [3, 4, 5, 3, 4, 4]


def test_margins_of_functional_layers(spark):
    layers = spark.createDataFrame([("a", "functional", 2.0, 0.0, 0.0, 1000.0, 500.0), ("b", "anatomical", 2.0, 0.0, 0.0, 1.0, 1.0)], "layer string, kind string, metres double, x0 double, y0 double, x1 double, y1 double")
    assert [tuple(r) for r in details.margin_boxes(layers).collect()] == [("a", -100.0, -300.0, 1100.0, 600.0)]


def test_zoom_hints(spark):
    f = spark.createDataFrame([(1, "a", 1.0, None, 3, 9), (2, "a", 1.0, None, None, None), (3, "b", 1.0, None, None, None), (4, "b", 1.0, "g", None, None), (5, "b", 4096.0, None, None, None), (6, "c", 0.0, None, None, None)], "id long, layer string, area double, group string, minzoom int, maxzoom int")
    layers = spark.createDataFrame([("a", 5, True, False), ("b", None, False, False), ("c", 0, False, True)], "layer string, minzoom int, detail boolean, based boolean")
    got = {r["id"]: tuple(r)[1:] for r in exports.zoom_hints(f, layers, 4.0**7).collect()}
    assert got == {1: (7.0, 3, 9, 6), 2: (7.0, 4, None, 6), 3: (7.0, 4, None, None), 4: (7.0, None, None, None), 5: (1.0, None, None, None), 6: (10.0, 0, None, -2)}


def test_details_open_details_to_the_end(spark):
    box = "x0 double, y0 double, x1 double, y1 double"
    hosts = spark.createDataFrame([(1, "a", 100.0, 100.0, 120.0, 140.0)], f"host long, layer string, {box}")
    edges = spark.createDataFrame([(k, 0.0, 0.0, 10.0, 10.0) for k in "abcdefgh"], f"layer string, {box}")
    chain = [(k, n, "abcdefgh"[n + 1] if n < 7 else None, 0.0, 0.0, 5.0, 5.0) for n, k in enumerate("abcdefgh")]
    member = lambda rows: spark.createDataFrame(rows, f"layer string, id long, details string, {box}")
    got = {r["path"]: tuple(r)[3:] for r in details.replicated(hosts, edges, member(chain)).collect()}
    assert len(got) == 8 and got["/0"] == (100.0, 100.0, 110.0, 120.0) and got["/0/1"] == (100.0, 100.0, 105.0, 110.0)
    assert got["/0/1/2/3/4/5/6/7"] == (100.0, 100.0, 100 + 20 / 256, 100 + 40 / 256)
    with pytest.raises(ValueError, match="circle"):
        details.replicated(hosts, edges, member([("a", 1, "b", 0.0, 0.0, 5.0, 5.0), ("b", 2, "a", 0.0, 0.0, 5.0, 5.0)]))


def test_texts_and_classes_of_parents(spark):
    rows = [(1, "component", False, 0, 0, 100, 100), (2, "component", True, 10, 10, 90, 90), (3, "component", True, 85, 20, 103, 30), (4, "component", False, 20, 20, 30, 30)]
    shapes = spark.createDataFrame(rows, "id long, kind string, text boolean, x0 long, y0 long, x1 long, y1 long")
    assert {r["id"]: r["parent"] for r in spatial.smallest_parent(shapes, shapes).collect()} == {2: 1, 3: 1, 4: 1}  # 3 is out by 3 of 18; 4 is not in the text
    rows = [(1, "system", 0, 0, 100, 100), (2, "component", 10, 10, 50, 50), (3, "connector", 12, 12, 14, 14), (4, "annotation", 11, 11, 20, 20), (5, "connector", 200, 0, 201, 1), (6, "component", 60, 60, 70, 70)]
    got = spatial.classified_parents(spark.createDataFrame(rows, "id long, kind string, x0 long, y0 long, x1 long, y1 long"))
    assert {r["id"]: (r["containing"], r["parent"]) for r in got.collect()} == {2: ([1], None), 3: ([4, 2, 1], 2), 4: ([2, 1], None), 5: (None, None), 6: ([1], None)}


def test_lines_merge_in_the_direction_they_were_drawn(spark):
    p = lambda *xs: [(float(x), 0.0) for x in xs]
    rows = [(1, "a", [None, 7], p(0, 5, 10)), (2, "a", [8, 7], p(20, 15, 10)), (3, "a", [8, None], p(20, 25)), (4, "b", [8, None], p(20, 30)), (5, "a", [9, None], p(0, 1)), (6, "a", [9, None], [(0.0, 0.0), (0.0, 1.0)])]
    lines = spark.createDataFrame(rows, "id long, type string, joiners array<long>, points array<struct<x:double,y:double>>")
    got = {r["id"]: (r["members"], r["joiners"], [q["x"] for q in r["points"]]) for r in assembly.merged_lines(lines).collect()}
    assert got == {1: ([1, 2, 3], [7, 8], [0, 5, 10, 10, 15, 20, 20, 25]), 4: ([4], [], [20, 30]), 5: ([5], [], [0, 1]), 6: ([6], [], [0, 0])}  # 5 and 6 meet at a right angle


def test_tiles_of_rings_and_extents(spark):
    low = ring((0, 0), (0.5, 0), (0, 0.5))
    got = tiling.ring_tiles(spark.range(1).select("id", low.alias("ring")), 2)
    assert sorted((r["x"], r["y"]) for r in got.collect()) == [(0, 0), (0, 1), (1, 0)]  # (1, 1) only touches
    world = spark.createDataFrame([(1, -180.0, -85.0, 180.0, 85.0)], "id long, west double, south double, east double, north double")
    r = tiling.extents(world, 2).first()
    assert (r["x0"], r["y0"], r["x1"], r["y1"], r["tiles"]) == (0, 0, 3, 3, 16) and r["left"] == pytest.approx(0) and r["right"] == pytest.approx(2048)
    assert tiling.cover(world, 2).count() == 16


def test_late_rows_of_the_live_monitor_go(spark, tmp_path):
    def put(name, rows):
        (tmp_path / "logs").mkdir(exist_ok=True)
        (tmp_path / "logs" / name).write_text("\n".join(json.dumps({"map_id": 1, "seq": n, "ts": f"2024-01-01T{h:02d}:30:00", "level": "error", "msg": "m", "type": "t", "node": 1, "path": 1}) for n, h in enumerate(rows)))

    def run():
        monitor.keep_windows(monitor.read(spark, str(tmp_path / "logs")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        return sorted((r["start"].hour, r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    put("a.json", [1, 1, 2, 5])
    assert run() == [(1, 2), (2, 1)]  # the watermark is 04:30
    put("b.json", [1, 4, 5, 9])
    assert run() == [(1, 2), (2, 1), (4, 1), (5, 2)]  # the row of one o'clock is late, that of four is not
