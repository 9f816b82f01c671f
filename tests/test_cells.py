"""Joins decided in cells against the expressions of ``geometry`` over all pairs, on rings of all kinds and sizes."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from atlaswright import plans
from atlaswright.functions import geometry as g
from atlaswright.operators import assembly, spatial

SF = "/root/testdata/sf0.001"
COLUMNS = "id long, x0 double, y0 double, x1 double, y1 double, ring array<struct<x:double,y:double>>, name string, text boolean"


def _shape(rnd, k):
    """Stars and convex rings, closed or not, either way round."""
    x, y, r, n, star = rnd.randrange(900), rnd.randrange(900), rnd.choice([3, 10, 30, 100, 400]), rnd.choice([3, 4, 5, 8, 13]), rnd.random() < 0.5
    at = lambda c, f, t: float(round(c + r * (rnd.choice([0.4, 1]) if star else 1) * f(2 * math.pi * t / n)))
    points = [(at(x, math.cos, t), at(y, math.sin, t)) for t in range(n)][:: rnd.choice([1, -1])]
    points += points[:1] if rnd.random() < 0.3 else []
    xs, ys = zip(*points, strict=True)
    return k, min(xs), min(ys), max(xs), max(ys), points, rnd.choice("abc"), rnd.random() < 0.2


@pytest.fixture(scope="module")
def drawn(spark):
    rnd = random.Random(5)
    a, b = (spark.createDataFrame([_shape(rnd, k) for k in keys], COLUMNS).cache() for keys in (range(120), range(1000, 1080)))
    return a, b, _pairs(a, b).cache()


def _pairs(a, b):
    named = lambda df, p: df.select([F.col(c).alias(p + c) for c in df.columns])
    return named(a, "a_").crossJoin(named(b, "b_")).where(g.meets("a_", "b_"))


def _same(got, want):
    got, want = (sorted(map(tuple, df.collect()), key=repr) for df in (got, want))
    assert got == want and got


def _sizes():
    """Areas of both rings of a pair, and the common one."""
    a, b = F.col("a_ring"), F.col("b_ring")
    return F.abs(g.ring_area(a)), F.abs(g.ring_area(b)), g.ring_overlap(a, b)


def _in(proper):
    return g.inside("a_", "b_", proper=proper) & g.ring_inside(F.col("a_ring"), F.col("b_ring"), proper)


def test_rings_in_rings(drawn):
    area, other, common = _sizes()
    a, b, pairs = drawn
    _same(spatial.inside(b, a).select("id", "feature"), pairs.where(_in(False)).select("b_id", "a_id"))
    found = F.array_sort(F.collect_list(F.struct(other.alias("area"), "b_id")))
    _same(spatial.covering(a, b), pairs.where(_in(False)).groupBy("a_id").agg(found.alias("c")).select("a_id", "c.b_id"))


def test_texts_and_parents(drawn):
    area, other, common = _sizes()
    a, b, pairs = drawn
    held = F.when(F.col("a_text"), _in(True) | (common > 0.8 * area)).otherwise(_in(True))
    _same(spatial.smallest_parent(a, b), pairs.where("not b_text").where(held).groupBy("a_id").agg(F.min_by("b_id", F.struct(other.alias("z"), "b_id"))))


def test_overlaps(drawn):
    area, other, common = _sizes()
    a, b, pairs = drawn
    _same(spatial.overlap_parents(a, b).select("id", F.explode("parents")), pairs.where((other > area) & (common >= 0.2 * area)).select("a_id", "b_id"))
    _same(spatial.nearly_inside(a, b), pairs.where(area - common <= 0.1 * area).select("a_id", "b_id"))


def test_classified(drawn):
    area, other, common = _sizes()
    kinds = drawn[0].withColumn("kind", F.element_at(F.array(*map(F.lit, ("component", "connector", "system", "other"))), (F.col("id") % 4 + 1).cast("int")))
    found = F.array_sort(F.collect_list(F.struct(other.alias("area"), F.col("b_id"), F.col("b_kind")))).alias("c")
    want = _pairs(kinds, kinds).where("a_kind <> 'system'").where((other > area) & (common >= 0.2 * area)).groupBy("a_id", "a_kind").agg(found)
    solid = F.filter("c", lambda s: s["b_kind"].isin("component", "system"))
    parent = F.when(F.col("a_kind") == "component", F.when(F.col("c")[0]["b_kind"] != "system", F.col("c")[0]["b_id"])).when(F.col("a_kind") == "connector", F.coalesce(F.try_element_at(solid, F.lit(1))["b_id"], F.try_element_at("c", F.lit(-1))["b_id"]))
    _same(spatial.classified_parents(kinds).where("containing is not null"), want.select("a_id", "c.b_id", parent))


def test_near_duplicates(drawn):
    area, other, common = _sizes()
    a, b, pairs = drawn
    both = F.least(common / area, common / other)
    tier = F.when(both >= 0.98, 1).when(both >= 0.8, 2).when((F.col("a_name") == F.col("b_name")) & g.rings_meet(F.col("a_ring"), F.col("b_ring")), 3)
    want = pairs.where((area > 0) & (other > 0)).select("a_id", tier.alias("t"), (-common).alias("c"), "b_id").where("t is not null").groupBy("a_id").agg(F.min(F.struct("t", "c", "b_id")).alias("m"))
    _same(spatial.near_duplicates(a, b).select("id", "base_id", "tier"), want.select("a_id", "m.b_id", "m.t"))


def test_lines_and_points(drawn):
    a, b, pairs = drawn
    lines = b.select("id", F.col("name").alias("class"), F.col("ring").alias("points"))
    length = g.length_inside(F.col("b_ring"), F.col("a_ring"))
    _same(spatial.crossed(lines, a.withColumn("class", F.col("name"))), pairs.where("a_name = b_name").where(length > F.sqrt(g.area("a_"))).select("b_id", "a_id"))
    best = pairs.where("a_name = b_name").groupBy("a_id").agg(F.min(F.struct((-F.round(length, 6)).alias("less"), "b_id")).alias("m")).select("a_id", "m.b_id", -F.col("m.less"))
    _same(assembly.container_segments(a.withColumn("centreline", F.col("name")), lines.withColumnRenamed("class", "centreline"), 0), best)
    points = b.select(F.explode("ring").alias("p")).select(F.monotonically_increasing_id().alias("id"), (F.col("p.x") + 0.25).alias("x"), (F.col("p.y") + 0.3).alias("y"))
    in_ = points.crossJoin(a.select(F.col("id").alias("region"), "ring", "name")).where(g.contains_point(F.col("ring"), F.col("x"), F.col("y")))
    _same(spatial.smallest_container_of_points(points, a, ("name",)), in_.groupBy("id").agg(F.min(F.struct("region", "name")).alias("m")).select("id", "m.region", "m.name"))


def test_nearest(drawn):
    of = lambda df: df.select("id", F.explode("ring").alias("p")).select("id", "p.x", "p.y")
    ends, places = of(drawn[1]).select(F.monotonically_increasing_id().alias("id"), "x", "y"), of(drawn[0])
    d2 = F.pow(F.col("x") - F.col("u"), F.lit(2)) + F.pow(F.col("y") - F.col("v"), F.lit(2))
    near = ends.crossJoin(places.toDF("c", "u", "v")).withColumn("d2", d2).where("d2 < 900")
    _same(spatial.nearest(ends, places, 30).where("connector is not null").select("id", "connector"), near.groupBy("id").agg(F.min(F.struct("d2", "c")).alias("m")).select("id", "m.c"))
    every = near.join(near.groupBy("id").agg(F.min("d2").alias("d2")), ["id", "d2"]).groupBy("id").agg(F.array_sort(F.collect_set("c")))
    _same(spatial.all_nearest(ends, places, 30).select("id", "connectors"), every)


def test_repeated_ids_have_one_row(spark):
    """A shape drawn twice is one shape: its lists are put together."""
    a = spark.createDataFrame([(1, 0, 0, 4, 4), (1, 500, 500, 504, 504)], "id long, x0 long, y0 long, x1 long, y1 long")
    b = spark.createDataFrame([(7, 0, 0, 9, 9), (8, 490, 490, 510, 510)], a.schema)
    assert [tuple(r) for r in spatial.covering(a, b).collect()] == [(1, [7, 8])]


@pytest.mark.parametrize("name", ["jn10_covering", "jn10_rings", "jn11_inside", "jn12_parents", "jn12_texts", "jn13_classified", "jn13_overlaps", "jn14_nearly_inside", "jn14_rings", "jn15_near_duplicates", "jn15_rings", "jn16_nearest", "jn17_all_nearest", "jn19_crossed", "jn19_polylines", "jn25_lines", "jn34_regions", "jn34_rings"])
def test_pairs_of_shapes_are_not_rows(spark, name):
    """Pairs grow with the square of what is drawn in a place: none may be a row of a join."""
    plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and not re.search(r"Join \[(level|gx)#", plan)
