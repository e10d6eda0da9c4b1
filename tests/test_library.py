"""Exact values worked out by hand, and properties, for the library's operators."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meadowline.functions import columns as C
from meadowline.functions import grid as G
from meadowline.operators import folds, models, sampling, scoring, temporal, weighted, zones
from meadowline.operators.distance import nearest_flagged
from meadowline.operators.lookup import point_values
from meadowline.plans import bands, stages
from meadowline.sources import config, provenance, tables
from meadowline.streaming.incremental import monthly_statistics, process_new_tiles


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0].x


# Columns


def test_binary_mask(spark):
    rng = random.Random(21)
    tests = {">": lambda x, v: x > v, ">=": lambda x, v: x >= v, "<": lambda x, v: x < v, "<=": lambda x, v: x <= v, "==": lambda x, v: x == v}
    values = [None, math.nan, math.inf, -math.inf, 6.5, -6.5] + [rng.choice([-6.5, 6.5, 0.0, rng.uniform(-20, 20)]) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    for sign, test in tests.items():
        for limit in (6.5, -6.5, 0.0):
            got = [r.m for r in df.select("i", C.binary_mask(F.col("v"), f"{sign}{limit}").alias("m")).orderBy("i").collect()]
            assert got == [int(v is not None and math.isfinite(v) and test(v, limit)) for v in values]


def test_comparisons_are_one_sign_and_one_number(spark):
    for blank in ("", " "):
        for sign in ("<", "<=", "==", ">=", ">"):
            for number in ("7", "-7.25", "+3.", ".125", "6e2", "-1E-4"):
                C.comparison(blank + sign + blank + number + blank)
                for bad in (number, number + sign, sign + sign + number, sign + number + blank + "x", "=" + number, "<>" + number):
                    with pytest.raises(ValueError):
                        C.comparison(bad)
            for word in ("", "infinity", "NaN", "1_0", "2 3", "1e400", "ten"):
                with pytest.raises(ValueError):
                    C.comparison(sign + word)


def test_null_strict_logic_and_classes(spark):
    null = F.lit(None).cast("boolean")
    assert one(spark, C.strict_and(F.lit(False), null)) is None and one(spark, C.strict_or(F.lit(True), null)) is None
    assert [one(spark, C.similarity_class(F.lit(1 - s))) for s in (0.0, 0.25, 0.5, 0.75, 1.0)] == [0, 1, 2, 3, 4]
    assert one(spark, C.similarity_class(F.lit(None).cast("double"))) is None
    assert one(spark, C.slug(F.lit("  The Great--Plains & Co. "))) == "the_great_plains_co"
    assert one(spark, C.title(F.lit("sands_of_time-and_TIDE.geojson"))) == "Sands of Time and Tide Geojson"
    assert one(spark, C.day_of_year_offset(F.lit(17532), 2018)) == 0
    assert one(spark, C.lenient_number(F.lit("x1"))) is None
    assert one(spark, C.compact_number(F.lit(0.5))) == "0p5"


# Grid


def test_blocks_round_down(spark):
    assert one(spark, G.block_index(F.lit(-7.0), 4)) == -2 and one(spark, G.parent_block(F.lit(-1), 4)) == -1
    assert one(spark, G.tile_id(F.lit(0), F.lit(-3))) == "x+000000_y-000003"


def test_points_take_the_pixel_they_lie_in(spark):
    pixels = spark.createDataFrame([(0, 0, 1.234), (0, 1, None), (2, 1, 7.0)], "row long, col long, v double")
    points = spark.createDataFrame([("corner", 10.0, 90.0), ("inside", 29.0, 71.5), ("missing", 30.0, 90.0), ("below", 31.0, 50.0), ("off", 9.5, 90.0), ("none", None, 3.0)], "name string, x double, y double")
    got = point_values(points, F.col("x"), F.col("y"), pixels, ["v"], 10, 90, 20).collect()
    assert {r.name: (r.row, r.col, r.v) for r in got} == {"corner": (0, 0, 1.23), "inside": (0, 0, 1.23), "missing": (0, 1, None), "below": (2, 1, 7.0), "off": (0, -1, None), "none": (4, None, None)}


def test_tiles_of_an_area(spark):
    box = lambda a, b, c, d: [[(a, b), (c, b), (c, d), (a, d), (a, b)]]
    tiles = lambda area, size: zones.polygon_tiles(zones.tile_index(zones.features_of(spark, [area]), size), size)
    ids = lambda area, size: [r.t for r in tiles(area, size).select(G.tile_id(F.col("tile_col"), F.col("tile_row")).alias("t")).collect()]
    assert ids([box(-30, 20, 70, 90)], 50) == [f"x{c:+07d}_y{r:+07d}" for r in (1, 0) for c in (-1, 0, 1)]
    assert ids([box(50, 50, 100, 150)], 50) == ["x+000001_y+000002", "x+000001_y+000001"]  # edges that touch do not count
    assert ids([box(10, 10, 60, 60), box(40, 40, 110, 60)], 50) == [f"x{c:+07d}_y{r:+07d}" for r in (1, 0) for c in (0, 1, 2)]
    assert ids([box(10, 10, 400, 400)], 50) == [f"x{c:+07d}_y{r:+07d}" for r in range(7, -1, -1) for c in range(8)]  # also those that no edge passes
    triangle = [[(0, 0), (8000, 8000), (0, 8000), (0, 0)]]
    assert set(ids([triangle], 4000)) == {"x+000000_y+000001", "x+000001_y+000001", "x+000000_y+000000"}


def crossings(x, y, polygon):
    sides = [(a, b) for ring in polygon for a, b in zip(ring, [*ring[1:], ring[0]])]
    return sum(((a[1] > y) != (b[1] > y)) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in sides)


@pytest.mark.parametrize("size", [0.7, 3.0, 40.0])
def test_points_in_many_polygons_equal_brute_force(spark, size):
    """Rings of any shape, also ones that cross themselves, with holes, horizontal edges, several polygons, in tiles of any size."""
    rng = random.Random(17)
    star = lambda x, y, n, far: [(x + (d := rng.uniform(0.2, far)) * math.cos(2 * math.pi * i / n), y + d * math.sin(2 * math.pi * i / n)) for i in range(n)]
    close = lambda ring: [*ring, ring[0]]
    areas = [[[close(star(rng.uniform(-9, 9), rng.uniform(-9, 9), rng.randrange(3, 30), rng.choice([1, 4, 12])))] for _ in range(rng.choice([1, 1, 3]))] for _ in range(40)]
    areas.append([[[(-8, -8), (8, -8), (8, 8), (-8, 8), (-8, -8)], [(-4, -4), (4, -4), (4, 4), (-4, 4), (-4, -4)]], [[(-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1)]]])
    areas.append([[close([(rng.choice([-6, -2, 0, 3, 7]), rng.choice([-6, -2, 0, 3, 7])) for _ in range(12)])]])
    points = [(i, rng.choice([float(rng.randrange(-9, 9)), rng.uniform(-10, 10)]), rng.choice([float(rng.randrange(-9, 9)), rng.uniform(-10, 10)])) for i in range(500)] + [(900, None, 1.0)]
    df = zones.with_tiles(spark.createDataFrame(points, "i int, x double, y double"), "x", "y", size)
    index = zones.tile_index(zones.features_of(spark, areas), size)
    want = {(i, k) for i, x, y in points[:-1] for k, area in enumerate(areas) if any(crossings(x, y, p) % 2 for p in area)}
    got = [(r.i, r.feature) for r in zones.features_at(df, index, "x", "y").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    inside = {i for i, _ in want}
    assert sorted(r.i for r in zones.within(df, index, "x", "y").collect()) == sorted(inside)
    assert {r.i: r.inside for r in zones.within(df, index, "x", "y", "inside").collect()} == {i: i in inside for i, *_ in points}
    if size < 1:
        assert index.where("NOT cut").count() > 100


def test_features_by_area(spark):
    box = lambda a, b, c, d: [(a, b), (c, b), (c, d), (a, d), (a, b)]
    areas = [[[box(0, 0, 10, 10), box(1, 1, 3, 2)]], [[box(0, 0, 2, 3)[::-1]]], [[box(0, 0, 1, 1)], [box(5, 5, 7, 8)]], [[box(0, 0, 2, 3)]]]
    got = zones.by_area(zones.features_of(spark, areas)).orderBy("number").collect()
    assert [(r.feature, r.area, r.number) for r in got] == [(1, 6.0, 1), (3, 6.0, 2), (2, 7.0, 3), (0, 98.0, 4)]


def test_index_puts_no_edge_into_the_plan(spark):
    ring = [(1234.5 * math.cos(k / 50), 1234.5 * math.sin(k / 50)) for k in range(315)]
    points = zones.with_tiles(spark.range(10).selectExpr("id * 1.0D AS x", "id * 1.0D AS y"), "x", "y", 100)
    plan = zones.within(points, zones.tile_index(zones.features_of(spark, [[[[*ring, ring[0]]]]]), 100), "x", "y")._jdf.queryExecution().toString()
    assert "1234.5" not in plan and str(ring[7][0]) not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_projections_there_and_back(spark):
    places = [(float(lon), float(lat)) for lon in (-179.5, -20, 0, 25, 179.9) for lat in (-89.5, -60, -30, 0, 12, 60, 84)]
    df = spark.createDataFrame(places, "lon double, lat double")
    for crs in ("EPSG:6933", "EPSG:8857", "EPSG:3857", "urn:ogc:def:crs:OGC:1.3:CRS84"):
        x, y = G.project(F.col("lon"), F.col("lat"), "EPSG:4326", crs)
        moved = df.select("lon", "lat", x.alias("x"), y.alias("y"))
        lon, lat = G.project(F.col("x"), F.col("y"), crs, "EPSG:4326")
        for r in moved.select("lon", "lat", lon.alias("a"), lat.alias("b")).collect():
            assert (r.a, r.b) == (pytest.approx(r.lon, abs=1e-6), pytest.approx(r.lat, abs=1e-6)), crs
    # From one equal-area system to the other directly, and through degrees.
    x, y = G.project(F.col("lon"), F.col("lat"), "EPSG:4326", "EPSG:6933")
    a, b = G.cylindrical_to_equal_earth(x, y)
    c, d = G.project(F.col("lon"), F.col("lat"), "EPSG:4326", "EPSG:8857")
    for r in df.select(a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d")).collect():
        assert (r.a, r.b) == (pytest.approx(r.c, abs=1e-3), pytest.approx(r.d, abs=1e-3))
    lon, lat = G.equal_earth_to_lonlat(F.lit(17243959.06), F.lit(0.0))  # the easternmost point of the equator
    assert (one(spark, lon), one(spark, lat)) == (pytest.approx(180, abs=1e-5), pytest.approx(0, abs=1e-9))
    assert one(spark, G.equal_earth_to_lonlat(F.lit(0.0), F.lit(9e6))[1]) is None
    with pytest.raises(ValueError):
        G.epsg("EPSG:32633")


def test_steps_of_the_inverse_do_not_grow_the_expression(spark):
    lon, _ = G.equal_earth_to_lonlat(F.col("x"), F.col("y"))
    assert len(spark.createDataFrame([(1.0, 2.0)], "x double, y double").select(lon)._jdf.queryExecution().optimizedPlan().toString()) < 15000


def test_projections_return_and_keep_areas(spark):
    assert one(spark, G.lonlat_to_cylindrical(F.lit(180.0), F.lit(0.0))[0]) == pytest.approx(17367530.445, abs=1e-3)
    df = spark.createDataFrame([(float(lon), float(lat)) for lon in (-179, -20, 25, 120) for lat in (-85, -30, 0, 12, 60)], "lon double, lat double")
    x, y = G.lonlat_to_cylindrical(F.col("lon"), F.col("lat"))
    df = df.select("lon", "lat", x.alias("x"), y.alias("y"))
    lon, lat = G.cylindrical_to_lonlat(F.col("x"), F.col("y"))
    for r in df.select("lon", "lat", lon.alias("a"), lat.alias("b")).collect():
        assert (r.a, r.b) == (pytest.approx(r.lon, abs=1e-7), pytest.approx(r.lat, abs=1e-7))
    h = 50.0
    at = lambda dx, dy: G.cylindrical_to_equal_earth(F.col("x") + dx, F.col("y") + dy)
    (ax, ay), (bx, by), (cx, cy), (dx, dy) = at(h, 0), at(-h, 0), at(0, h), at(0, -h)
    jacobian = ((ax - bx) * (cy - dy) - (ay - by) * (cx - dx)) / (4 * h * h)
    assert all(r.j == pytest.approx(1, abs=1e-6) for r in df.where("abs(lat) < 80").select(jacobian.alias("j")).collect())


def test_bounds_windows_and_overlap(spark):
    assert G.output_bounds((100, 100, 1900, 1900), 1000) == (-2, 0, 0, 2)
    assert G.output_bounds((0, 0, 2000 + 1e-7, 1000), 1000) == (-1, 0, 0, 2)
    assert sorted((r.row_off, r.col_off, r.rows, r.cols) for r in G.windows(spark, 5, 3, 2).collect()) == [(0, 0, 2, 2), (0, 2, 2, 1), (2, 0, 2, 2), (2, 2, 2, 1), (4, 0, 1, 2), (4, 2, 1, 1)]
    low, size = G.overlap(F.lit(0), F.lit(4), F.lit(3), F.lit(9))
    assert (one(spark, low), one(spark, size)) == (3, 1) and one(spark, G.overlap(F.lit(0), F.lit(1), F.lit(5), F.lit(6))[1]) == 0
    assert G.locator_bounds((170, 80, 179, 89), 40) == (140, 50, 180, 90)


# Temporal


def test_persistence(spark):
    df = spark.createDataFrame([("a", y, v) for y, v in enumerate([1, 0, 1, 0, 1])] + [("b", y, v) for y, v in enumerate([1, 0, 0, 1])] + [("c", 0, 0)], "k string, y int, v int")
    assert {r.k: r.persistent for r in temporal.never_fails_twice(df, ["k"], "y", F.col("v") == 1).collect()} == {"a": 1, "b": 0, "c": 0}


def test_variation_and_positive_mean(spark):
    df = spark.createDataFrame([("a", 2009, 1.0), ("a", 2009, 2.0), ("a", 2010, 5.0), ("a", 2005, 99.0), ("z", 2010, 0.0)], "k string, y int, v double")
    got = {r.k: r.cv_percent for r in temporal.variation_of_totals(df, ["k"], "y", F.col("v"), 2010, 2, 1979).collect()}
    assert got == {"a": pytest.approx(25.0), "z": None}
    assert df.agg(temporal.positive_mean(F.col("v") - 2).alias("m")).collect()[0].m == pytest.approx(50.0)
    assert df.agg(temporal.indicator_stddev(F.lit(0), 2).alias("m")).collect()[0].m is None


# Weighted statistics


def test_weighted_quantiles_step(spark):
    rng = random.Random(31)
    rows = [(g, rng.choice([None, float(rng.randint(0, 40))]), rng.choice([0.0, None, rng.uniform(0.1, 9)])) for g in range(3) for _ in range(300)]
    steps = [0.02, 0.35, 0.5, 0.77, 1.0]
    got = weighted.weighted_quantiles(spark.createDataFrame(rows, "g int, v double, w double"), ["g"], F.col("v"), F.col("w"), steps).collect()
    for r in got:
        mine = sorted((v, w) for g, v, w in rows if g == r.g and v is not None and w)
        total, run, want = sum(w for _, w in mine), 0.0, []
        for q in steps:
            run = 0.0
            want.append(next(v for v, w in mine if (run := run + w) >= q * total * (1 - 1e-12)))
        assert list(r)[1:] == want


@pytest.mark.parametrize("range_rows", [1, 7, 10**6])
def test_running_sums_in_any_ranges(spark, monkeypatch, range_rows):
    monkeypatch.setattr(weighted, "RANGE_ROWS", range_rows)
    rng = random.Random(36)
    rows = [(g, v, rng.randint(0, 9), rng.uniform(0, 2)) for g, n in ((None, 30), ("a", 1), ("b", 300)) for v in rng.sample(range(-999, 999), n)]
    got = weighted.with_running_sums(spark.createDataFrame(rows, "g string, v int, n int, w double"), ["g"], "v", {"n": ("rn", "tn"), "w": ("rw", "tw")}).collect()
    assert len(got) == len(rows)
    for r in got:
        mine = [x for x in rows if x[0] == r.g]
        assert (r.rn, r.tn) == (sum(n for _, v, n, _ in mine if v <= r.v), sum(n for _, _, n, _ in mine))
        assert r.rw == pytest.approx(sum(w for _, v, _, w in mine if v <= r.v)) and r.tw == pytest.approx(sum(w for *_, w in mine))
    assert weighted.with_running_sums(spark.createDataFrame([], "v int, n int"), [], "v", {"n": ("rn", "tn")}).columns == ["v", "n", "rn", "tn"]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_running_sums_meet_no_edges_row_by_row(spark, monkeypatch):
    monkeypatch.setattr(weighted, "RANGE_ROWS", 10)
    rows = spark.range(400).selectExpr("id % 3 AS g", "id AS v", "1L AS n")
    got = weighted.with_running_sums(rows, ["g"], "v", {"n": ("run", "all")})
    assert "lambda" not in _plan(got) and "percentile_approx" not in _plan(got)
    assert all((r.run, r.all) == (r.v // 3 + 1, 134 if r.g == 0 else 133) for r in got.collect())


def test_running_sums_cut_a_group_into_ranges_of_its_own_values(spark, monkeypatch):
    monkeypatch.setattr(weighted, "RANGE_ROWS", 10)
    written, keep = [], weighted.kept
    monkeypatch.setattr(weighted, "kept", lambda df: written.append(keep(df)) or written[-1])
    values = spark.range(400).selectExpr("double(id * 37 % 401) AS v", "double(id % 5 + 1) AS w")
    assert weighted.ecdf(values, "v", F.col("w")).count() == 400
    ranges = [r for df in written if "_range" in df.columns and "v" in df.columns for r in df.groupBy("_range").agg(F.count("v").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).orderBy("a").collect()]
    assert len(ranges) > 20 and max(r.n for r in ranges) <= 40 and all(x.b < y.a for x, y in zip(ranges, ranges[1:]))


@pytest.mark.parametrize("quantiles", [[0.05, 0.95], [0.5]])
def test_quantiles_of_one_group_pass_each_distinct_value_in_a_range(spark, monkeypatch, quantiles):
    monkeypatch.setattr(weighted, "RANGE_ROWS", 10)
    got = weighted.weighted_quantiles(spark.range(1, 401).selectExpr("1 AS g", "id"), ["g"], F.col("id"), F.lit(2.0), quantiles)
    assert list(got.collect()[0])[1:] == [400 * q for q in quantiles] and "lambda" not in _plan(got)


def test_average_ranks_meet_no_edges_row_by_row(spark, monkeypatch):
    monkeypatch.setattr(weighted, "RANGE_ROWS", 10)
    got = weighted.with_average_ranks(spark.range(300).selectExpr("id % 2 AS g", "id div 4 AS v"), ["g"], {"v": "k"})
    assert "lambda" not in _plan(got)
    assert all(r.k == 2 * r.v + 1.5 for r in got.collect())


def _watched(monkeypatch):
    """Rows given to running sums, call by call."""
    given, sums = [], weighted.with_running_sums
    monkeypatch.setattr(weighted, "with_running_sums", lambda df, *a: given.append(df.count()) or sums(df, *a))
    return given


def test_quantiles_put_only_their_cells_in_order(spark, monkeypatch):
    monkeypatch.setattr(weighted, "RANGE_ROWS", 50)
    given = _watched(monkeypatch)
    values = spark.range(4000).selectExpr("id % 2 AS g", "id * 1231 % 4001 AS v")
    got = weighted.weighted_quantiles(values, ["g"], F.col("v"), F.lit(2.0), [0.05, 0.95]).collect()
    assert sum(given) < 100 and len(got) == 2
    for r in got:
        mine = sorted(i * 1231 % 4001 for i in range(4000) if i % 2 == r.g)
        assert (r.q0, r.q1) == (mine[99], mine[1899])


@pytest.mark.parametrize("range_rows", [1, 5, 20, 10**6])
def test_quantiles_in_any_cells(spark, monkeypatch, range_rows):
    monkeypatch.setattr(weighted, "RANGE_ROWS", range_rows)
    rng, steps, inf = random.Random(37), [0.0, 0.02, 0.35, 0.5, 0.77, 0.97, 1.0], math.inf
    draw = {
        None: lambda: rng.uniform(-5, 5), "near": lambda: rng.choice([1e300, 1 + rng.random() * 1e-9, rng.expovariate(1)]), "few": lambda: rng.choice([-0.0, 0.0, 7.0]),
        "ends": lambda: rng.choice([-inf, inf, math.nan, None, rng.gauss(0, 1)]), "wide": lambda: rng.choice([-1.7e308, 1.7e308, rng.random()]), "inf": lambda: inf, "one": lambda: 3.0,
    }
    rows = [(g, f(), rng.choice([0.0, None, float(rng.randint(1, 9))])) for g, f in draw.items() for _ in range(3 if g == "one" else 150)] + [("one", 3.0, 1.0)]
    got = weighted.weighted_quantiles(spark.createDataFrame(rows, "g string, v double, w double"), ["g"], F.col("v"), F.col("w"), steps).collect()
    assert {r.g for r in got} == set(draw) and len(got) == len(draw)
    for r in got:
        mine = sorted((v, w) for g, v, w in rows if g == r.g and v is not None and v == v and w)
        upto = [sum(w for _, w in mine[: k + 1]) for k in range(len(mine))]
        assert list(r)[1:] == [next(v for (v, _), run in zip(mine, upto) if run / upto[-1] >= q - 1e-12) for q in steps]
    whole = weighted.weighted_quantiles(spark.range(1, 101), [], F.col("id"), F.lit(1.0), [0.5, 1.0])
    assert whole.columns == ["q0", "q1"] and [tuple(r) for r in whole.collect()] == [(50.0, 100.0)]


def test_average_ranks_sum_no_distinct_values(spark, monkeypatch):
    monkeypatch.setattr(weighted, "RANGE_ROWS", 50)
    given = _watched(monkeypatch)
    values = spark.range(4000).selectExpr("id % 2 AS g", "id * 1231 % 4001 AS v", "id % 10 AS f")
    got = weighted.with_average_ranks(values, ["g"], {"v": "k", "f": "kf"}).collect()
    assert not given and len(got) == 4000
    place = {g: {v: k for k, v in enumerate(sorted(i * 1231 % 4001 for i in range(4000) if i % 2 == g), 1)} for g in (0, 1)}
    assert all((r.k, r.kf) == (place[r.g][r.v], 400 * (r.f // 2) + 200.5) for r in got)


@pytest.mark.parametrize("range_rows", [1, 5, 20, 10**6])
def test_average_ranks_in_any_cells(spark, monkeypatch, range_rows):
    monkeypatch.setattr(weighted, "RANGE_ROWS", range_rows)
    rng, inf = random.Random(38), math.inf
    draw = {
        None: lambda: rng.uniform(-5, 5), "near": lambda: rng.choice([1e300, 1 + rng.randrange(60) * 1e-9, rng.expovariate(1)]), "few": lambda: rng.choice([-0.0, 0.0, 7.0]),
        "ends": lambda: rng.choice([-inf, inf, math.nan, None, rng.gauss(0, 1)]), "wide": lambda: rng.choice([-1.7e308, 1.7e308, rng.random()]), "inf": lambda: inf, "none": lambda: None, "one": lambda: 3.0,
    }
    rows = [(i, g, f(), rng.choice([None, "a", "b", "c", f"x{i % 70}"]), rng.randrange(4)) for g, f in draw.items() for i in range(1 if g == "one" else 150)]
    df = spark.createDataFrame(rows, "i int, g string, v double, s string, n int")
    out = weighted.with_average_ranks(df, ["g"], {"n": "kn", "v": "kv", "s": "ks"})
    got = out.collect()
    assert out.columns == [*df.columns, "kn", "kv", "ks"] and len(got) == len(rows)
    order = lambda x: (x != x, x)
    for r in got:
        for c, at, rank in (("v", 2, r.kv), ("s", 3, r.ks), ("n", 4, r.kn)):
            mine = [order(x[at]) if x[at] == x[at] else (True, 0) for x in rows if x[1] == r.g and x[at] is not None]
            own = r[c] if r[c] is None else order(r[c]) if r[c] == r[c] else (True, 0)
            assert rank == (None if own is None else sum(x < own for x in mine) + (sum(x == own for x in mine) + 1) / 2)
    whole = weighted.with_average_ranks(spark.range(100).selectExpr("id", "id div 2 AS v"), [], {"v": "k"})
    assert all(r.k == 2 * r.v + 1.5 for r in whole.collect()) and whole.columns == ["id", "v", "k"]


def test_asof_passes_each_edge_once(spark, monkeypatch):
    monkeypatch.setattr(weighted, "RANGE_ROWS", 2)
    table = spark.range(300).selectExpr("double(id * id) AS d", "double(id) AS f")
    got = weighted.asof(spark.range(90_000).selectExpr("double(id) AS v"), "v", table, "d", "f", "got")
    # Values are compared with marks, with the edges after one and with a cell's rows, which were gathered before.
    assert _plan(got).count("<= v#") == 3 and "collect_list" not in _plan(got)
    assert got.where("got <> floor(sqrt(v))").count() == 0 and got.where("got IS NULL").count() == 0


def test_regression_metrics(spark):
    rng = random.Random(32)
    maybe = lambda x: rng.choice([x, x, x, None])
    cases = [[(rng.gauss(5, 2), rng.gauss(4, 2), rng.choice([0.0, None, rng.uniform(0.5, 3)])) for _ in range(40)], [(7.0, rng.gauss(0, 1), 1.5) for _ in range(6)], [(1.0, 4.0, 2.0)], []]
    cases[0] += [(maybe(3.0), maybe(6.0), 1.0) for _ in range(20)]
    m = weighted.regression_metrics(F.col("o"), F.col("e"), F.col("w"))
    for rows in cases:
        got = spark.createDataFrame(rows, "o double, e double, w double").agg(*(c.alias(n) for n, c in m.items())).collect()[0]
        mine = [x for x in rows if None not in x and x[2] > 0]
        total = sum(w for *_, w in mine)
        mean = lambda f: sum(w * f(o, e) for o, e, w in mine) / total if len(mine) > 1 else None
        middle = mean(lambda o, e: o)
        spread = mean(lambda o, e: (o - middle) ** 2)
        lost = mean(lambda o, e: (o - e) ** 2)
        want = {"mae": mean(lambda o, e: abs(o - e)), "bias": mean(lambda o, e: o - e), "rmse": lost and math.sqrt(lost), "r2": 1 - lost / spread if spread else None}
        assert {n: got[n] for n in want} == {n: None if v is None else pytest.approx(v) for n, v in want.items()}


def test_imputation(spark):
    rows = [(3.5, 4.0, 1.0), (6.5, 4.0, 2.0), (8.0, 2.0, 2.5), (None, 2.0, 0.25), (9.0, None, 0.0)]
    df = spark.createDataFrame(rows, "p double, landform double, w double")
    # Half of 5.5 is reached at 6.5; the weights of 4 and 2 are 3 and 2.75.
    assert models.imputation_values(df, ["p"], "landform", F.col("w")) == {"p": 6.5, "landform": 4.0}


@pytest.mark.parametrize("range_rows", [1, 7, 50_000])
def test_asof_equals_brute_force(spark, monkeypatch, range_rows):
    monkeypatch.setattr(weighted, "RANGE_ROWS", range_rows)
    monkeypatch.setattr(weighted, "CELLS", 16)
    rng = random.Random(33)
    known = sorted({rng.choice([round(rng.uniform(0, 5), 2), 1.25 + rng.random() * 1e-9, rng.expovariate(1) * 1000]) for _ in range(300)})
    table = spark.createDataFrame([(v, float(k)) for k, v in enumerate(known)] + [(None, 5.0)], "d double, f double")
    probes = [*known[::3], *(v - 1e-12 for v in known[::5]), -1.0, 1e9, None, None] + [rng.uniform(0, 6) for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(probes)), "i int, v double")
    for r in weighted.asof(rows, "v", table, "d", "f", "got").collect():
        below = [k for k, d in enumerate(known) if r.v is not None and d <= r.v]
        assert r.got == (below[-1] if below else None)
    for few in ([], [(2.0, 0.5)], [(2.0, 0.5), (3.0, 1.0)]):
        got = weighted.asof(rows.where("i < 5").select("i", F.lit(2.5).alias("v")), "v", spark.createDataFrame(few, "d double, f double"), "d", "f", "got").collect()
        assert {r.got for r in got} == {0.5 if few else None}


def test_ecdf_and_its_quantiles(spark):
    rng = random.Random(34)
    rows = [(rng.choice([None, round(rng.uniform(0, 5), 1)]), rng.choice([None, 0.0, float(rng.randrange(1, 4))])) for _ in range(400)]
    steps = weighted.ecdf(spark.createDataFrame(rows, "v double, w double"), "v", F.col("w"))
    known = sorted({v for v, w in rows if v is not None and w})
    total = sum(w for v, w in rows if v is not None and w)
    share = {v: sum(w for u, w in rows if u is not None and w and u <= v) / total for v in known}
    assert {r.v: pytest.approx(r.fraction) for r in steps.collect()} == share and max(share.values()) == 1
    got = weighted.ecdf_quantiles(steps, "v", "fraction", (0.5, 0.9, 1.0)).collect()[0]
    assert [got.p50, got.p90, got.p100] == [min(v for v in known if share[v] >= q) for q in (0.5, 0.9, 1.0)]


def test_average_rank_and_correlation(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (1, 3.0), (1, 9.0)], "g int, v double")
    assert sorted(r.k for r in weighted.with_average_ranks(df, ["g"], {"v": "k"}).collect()) == [1, 2.5, 2.5, 4]
    assert df.agg(weighted.correlation(F.col("v"), F.lit(1.0), F.lit(1.0)).alias("c")).collect()[0].c is None


# Sampling and folds


def test_sample_is_capped_and_repeatable(spark):
    df = spark.range(4000).select((F.col("id") % 3).alias("block_col"), (F.col("id") % 2).alias("block_row"), F.when(F.col("id") % 7 == 0, 1).otherwise(0).alias("cls"), "id")
    draw = lambda d: sampling.stratified_sample(d, ["block_col", "block_row", "cls"], [sampling.priority(17, F.col("id")), "id"], 5)
    a, b = draw(df).toPandas(), draw(df.repartition(7)).toPandas()
    assert sorted(a.id) == sorted(b.id) and (a.groupby(["block_col", "block_row", "cls"]).size() == 5).all()
    assert a.weight.sum() == pytest.approx(4000) and (a.probability * a.weight).round(12).eq(1).all()
    assert "WindowGroupLimit" in draw(df)._jdf.queryExecution().executedPlan().toString()
    empty = sampling.class_summary(draw(df).where("cls = 0"), "cls", F.lit(1.0)).orderBy("cls").collect()
    assert [(r.cls, r.sampled_rows, r.weight_min is None) for r in empty] == [(0, 30, False), (1, 0, True)]


def test_block_ratio():
    assert folds.block_ratio(100000, 25000) == 4
    with pytest.raises(ValueError):
        folds.block_ratio(90000, 25000)


# Models


def test_spline_basis_is_a_partition_and_lines_stay_lines():
    knots = [0.0, 1.0, 1.5, 4.0, 7.0, 10.0]
    x = np.linspace(0, 10, 101)
    full = models.spline_basis(x, models.basis_knots(knots))
    assert full.shape[1] == len(knots) + 2 and np.allclose(full.sum(axis=1), 1)
    inside, outside = models.spline_columns(x, knots), models.spline_columns(np.linspace(-5, 15, 41), knots)
    design = np.column_stack((np.ones(101), inside))
    b = np.linalg.lstsq(design, 3 * x - 2, rcond=None)[0]
    assert np.allclose(np.column_stack((np.ones(41), outside)) @ b, 3 * np.linspace(-5, 15, 41) - 2, atol=1e-8)


def test_ridge_equals_the_closed_form(spark):
    rng = np.random.default_rng(3)
    n = 300
    x, c, w = rng.normal(size=n), rng.integers(1, 4, n).astype(float), rng.uniform(1, 5, n)
    y = np.sin(x) + c + rng.normal(0, 0.1, n)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(x, c, w, y)], "x double, c double, area_weight_m2 double, y double").repartition(5)
    m = models.fit_models(df, ["y"], ["x"], "c", knots=5, alpha=0.7)[0]
    design = m.design.matrix({"x": x, "c": c})
    assert m.design.categories == [1, 2, 3] and np.allclose(m.design.knots["x"], np.quantile(x, np.linspace(0, 1, 5)))
    s = w * n / w.sum()
    mean, y_mean = (design * s[:, None]).sum(0) / n, (y * s).sum() / n
    z, t = (design - mean) * np.sqrt(s)[:, None], (y - y_mean) * np.sqrt(s)
    b = np.linalg.solve(z.T @ z + 0.7 * np.eye(z.shape[1]), z.T @ t)
    assert np.allclose(m.coefficients, b, atol=1e-7) and m.intercept == pytest.approx(y_mean - mean @ b, abs=1e-7)
    back = models.ResponseModel.from_json(m.to_json())
    got = models.predict(df, [back]).toPandas()
    assert np.allclose(got.y_expected, m.predict({"x": got.x.to_numpy(), "c": got.c.to_numpy()}))
    unseen = m.predict({"x": np.array([np.nan]), "c": np.array([9.0])})
    assert np.isfinite(unseen).all()


def test_designs_equal_those_of_each_split_alone(spark):
    """Medians, knots, categories and expectations of all folds at once, with missing values in every column."""
    rng = np.random.default_rng(37)
    n = 240
    hole = lambda v, share: np.where(rng.random(n) < share, np.nan, v)
    fold, w = rng.integers(0, 3, n), np.where(rng.random(n) < 0.1, 0.0, rng.uniform(1, 4, n))
    x, empty, c, y = hole(np.round(rng.normal(size=n), 1), 0.3), np.full(n, np.nan), hole(rng.integers(1, 4, n).astype(float), 0.2), rng.normal(size=n)
    part = hole(y * 2, 0.4)
    none = lambda v: None if np.isnan(v) else float(v)
    df = spark.createDataFrame([(i, int(fold[i]), float(w[i]), *map(none, (x[i], empty[i], c[i], y[i], part[i]))) for i in range(n)], "i int, fold int, area_weight_m2 double, x double, empty double, c double, y double, part double")
    fitted = models.fit_splits(df, F.col("fold"), range(3), ["y", "part"], ["x", "empty"], "c", knots=5)
    scored = models.cross_validate(df, "fold", 3, ["y", "part"], ["x", "empty"], "c", knots=5).toPandas().set_index("i").sort_index()
    assert len(scored) == n
    for k in range(3):
        for m, there in zip(fitted[k], (~np.isnan(y), ~np.isnan(part))):
            use = (fold != k) & there
            known = use & ~np.isnan(x) & (w > 0)
            order = known.nonzero()[0][np.argsort(x[known], kind="stable")]
            median = x[order][np.searchsorted(np.cumsum(w[order]), w[order].sum() / 2 - 1e-9)]
            usual = max((1.0, 2.0, 3.0), key=lambda v: w[use & (c == v)].sum())
            assert m.design.imputation == {"x": median, "empty": 0.0, "c": usual} and m.design.categories == [1, 2, 3]
            assert np.allclose(m.design.knots["x"], np.quantile(np.where(np.isnan(x), median, x)[use], np.linspace(0, 1, 5))) and m.design.knots["empty"] == [0.0] * 5
            alone = models.fit_models(df.where(F.col("fold") != k), [m.response], ["x", "empty"], "c", knots=5)[0]
            assert np.allclose(m.coefficients, alone.coefficients) and m.intercept == pytest.approx(alone.intercept)
            held = fold == k
            assert np.allclose(scored[f"{m.response}_expected_reference_oof"].to_numpy()[held], m.predict({"x": x[held], "empty": empty[held], "c": c[held]}))


def test_a_response_without_rows_has_no_model(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0, 1.0, 2.0, None), (1, 2.0, 2.0, 1.0, 3.0, 4.0)], "fold int, x double, c double, area_weight_m2 double, y double, z double")
    got = {r.fold: r for r in models.cross_validate(df, "fold", 2, ["y", "z"], ["x"], "c", knots=3).collect()}
    assert got[1].z_expected_reference_oof is None and got[0].z_expected_reference_oof == pytest.approx(4.0) and got[1].y_expected_reference_oof == pytest.approx(2.0)
    assert models.cross_validate(df.where("false"), "fold", 2, ["y"], ["x"], "c", knots=3).count() == 0


# Scoring


def test_calibration(spark):
    rng = np.random.default_rng(34)
    n = 80
    a, b = rng.normal(2, 1.5, n), rng.normal(-1, 0.5, n)
    b += 0.4 * a
    w, site = rng.uniform(1, 4, n), (rng.random(n) < 0.7).astype(int)
    df = spark.createDataFrame([(int(s), *map(float, x)) for s, *x in zip(site, w, a, b)] + [(1, 3.0, None, 1.0)], "reference_site int, area_weight_m2 double, a double, b double")
    c, table = scoring.calibrate(df.where("reference_site = 1"), ["a", "b"], "area_weight_m2", 0.25)
    z, v = np.column_stack((a, b))[site == 1], w[site == 1]
    mean = (z * v[:, None]).sum(0) / v.sum()
    cov = ((z - mean) * v[:, None]).T @ (z - mean) / v.sum()
    assert np.allclose(c.mean, mean) and np.allclose(c.covariance, cov) and c.rows == len(z) and c.weight == pytest.approx(v.sum())
    shrunken = 0.75 * cov + 0.25 * np.diag(np.diag(cov))
    assert c.condition == pytest.approx(np.linalg.cond(cov)) and c.shrunken_condition == pytest.approx(np.linalg.cond(shrunken)) and c.shrunken_condition < c.condition
    inverse = np.linalg.inv(shrunken)
    far = lambda x: float(np.sqrt((x - mean) @ inverse @ (x - mean)))
    c = scoring.Calibration.from_json(c.to_json())
    probes = [(2.0, -1.0), (0.0, 0.0), (9.0, 9.0), (None, 1.0)]
    got = spark.createDataFrame(probes, "a double, b double").withColumn("d", c.distance([F.col("a"), F.col("b")]))
    got = sorted(scoring.with_percentile(got, "d", table, "p").collect(), key=lambda r: probes.index((r.a, r.b)))
    near = np.array([far(x) for x in z])
    for r in got[:3]:
        d = far(np.array([r.a, r.b]))
        assert (r.d, r.p) == (pytest.approx(d), pytest.approx(v[near <= d].sum() / v.sum()))
    assert got[3].d is None and got[3].p is None


def test_distance_equals_brute_force(spark):
    rng = random.Random(1)
    cells = [(i, j, rng.random() < 0.03) for i in range(40) for j in range(30)]
    flagged = [(i, j) for i, j, f in cells if f]
    got = nearest_flagged(spark.createDataFrame(cells, "row int, col int, f boolean"), "f", pixel=2.0).collect()
    assert len(got) == len(cells)
    for r in got:
        assert r.distance == pytest.approx(2 * min(math.hypot(r.row - i, r.col - j) for i, j in flagged))
    none = nearest_flagged(spark.createDataFrame([(0, 0, False)], "row int, col int, f boolean"), "f").collect()
    assert none[0].distance is None or math.isnan(none[0].distance)


# Configuration

TOML = """
[analysis]
name = "small"
display_name = "Small"
year = 2018
[stack]
name = "stack"
version = 1
minimum_year = 2017
maximum_year = 2020
reference_start_year = 2016
reference_end_year = 2018
era5_start_year = 1979
interannual_rainfall_window_years = 10
stream_upstream_area_threshold_km2 = 25
[grid]
crs = "EPSG:6933"
pixel_size_meters = 1000
tile_size_pixels = 4
origin_x = 0
origin_y = 0
[reference]
grassland_probability = 80
human_modification = 0.1
human_influence = 0.08
[datasets]
ndvi = "A"
era5 = "B"
land = "C"
ref = "D"
[sampling]
block_size_meters = 10000
samples_per_class_per_block = 3
random_seed = 17
[model]
fold_count = 2
validation_block_size_meters = 20000
minimum_predictor_coverage = 0.8
maximum_row_missing_fraction = 0.2
minimum_response_coverage = 0.5
spline_knot_count = 4
ridge_alpha = 1.0
responses = []
[inference]
worker_count = 1
window_size_pixels = 4
covariance_shrinkage = 0.1
""" + "".join(f"""
[[bands]]
id = "{i}"
computation = "{c}"
suffix = "{s}"
display_name = "{s}"
role = "{role}"
data_type = "{kind}"
sources = ["{src}"]
""" for i, c, s, role, kind, src in (
    ("d01", "grassland_reference_sites", "reference", "reference", "binary", "ref"), ("d02", "ndvi_95th_percentile", "ndvi", "response", "continuous", "ndvi"),
    ("d24", "annual_precipitation", "rain", "predictor", "continuous", "era5"), ("d35", "landform_type", "landform", "predictor", "categorical", "land"),
))


@pytest.fixture
def analysis(tmp_path):
    (tmp_path / "a.toml").write_text(TOML)
    return config.load_analysis(tmp_path / "a.toml")


def test_configuration(tmp_path, analysis, spark):
    assert analysis.band_names() == ["y2018_d01_reference", "y2018_d02_ndvi", "y2018_d24_rain", "y2018_d35_landform"]
    columns = ["y2019_d02_ndvi", *analysis.band_names(), "y2019_d24_rain"]
    assert analysis.columns_with_role(columns, "predictor") == {"d24": "y2018_d24_rain", "d35": "y2018_d35_landform"}
    assert analysis.resolve_responses(columns, ["2", "d02", "y2018_d02_ndvi"]) == ["y2018_d02_ndvi"]
    with pytest.raises(KeyError):
        analysis.resolve_responses(columns, ["d77"])
    assert analysis.band_table(spark).count() == 4
    changed = lambda old, new: config_of(tmp_path, TOML.replace(old, new))
    assert changed("ridge_alpha = 1.0", "ridge_alpha = 2.0").raster_fingerprint() == analysis.raster_fingerprint()
    assert changed("ridge_alpha = 1.0", "ridge_alpha = 2.0").fingerprint() != analysis.fingerprint()
    assert changed('display_name = "ndvi"', 'display_name = "NDVI"').raster_fingerprint() != analysis.raster_fingerprint()
    for old, new in (("year = 2018", "year = 2030"), ('sources = ["ndvi"]', 'sources = ["lost"]'), ("minimum_response_coverage = 0.5", "minimum_response_coverage = 1.0"), ('data_type = "categorical"', 'data_type = "continuous"'), ('id = "d24"', 'id = "d02"'), ("validation_block_size_meters = 20000", "validation_block_size_meters = 15000")):
        with pytest.raises(config.ConfigurationError):
            changed(old, new)


def config_of(tmp_path, text):
    (tmp_path / "b.toml").write_text(text)
    return config.load_analysis(tmp_path / "b.toml")


# Stages


def test_sampling_stage(spark, analysis):
    """Two tiles of 4 x 4 pixels in one block: at most three rows of each class, whose weights give the populations back."""
    cells = [(t, 0, i, j, float((t * 4 + j + i) % 3 == 0), 0.1 * (t * 4 + j) + 0.01 * i, 5.0 + i, float(i % 2)) for t in (0, 1) for i in range(4) for j in range(4)]
    pixels = spark.createDataFrame(cells, "tile_col int, tile_row int, local_row int, local_col int, " + ", ".join(f"{c} double" for c in analysis.band_names()))
    area = lambda x, y: zones.features_of(spark, [[[[(100.0, 100.0), (x, 100.0), (x, y), (100.0, y), (100.0, 100.0)]]]])
    sample = stages.build_sample(pixels, analysis, area(7900.0, 3900.0))
    got = sample.toPandas()
    assert len(got) == 6 and (got.groupby("reference_site").size() == 3).all()
    assert got.sampling_weight.sum() == pytest.approx(32) and "y2018_d01_reference" not in got
    assert stages.build_sample(pixels, analysis, area(1900.0, 1900.0)).toPandas().sampling_weight.sum() == pytest.approx(4)
    full = {(r.tile_col, r.local_row, r.local_col): r for r in pixels.collect()}
    for r in got.itertuples():
        pixel = full[r.tile_col, r.local_row, r.local_col]
        assert (r.y2018_d02_ndvi, r.y2018_d24_rain, r.y2018_d35_landform, r.reference_site) == (pixel.y2018_d02_ndvi, pixel.y2018_d24_rain, pixel.y2018_d35_landform, pixel.y2018_d01_reference)


def test_sample_ranks_keys_and_reads_chosen_tiles(spark, analysis, tmp_path, monkeypatch):
    """No band is shuffled for the ranks, and of the cache only tiles with chosen pixels are read again."""
    bands = [f"double({k} + local_row) AS {c}" for k, c in enumerate(analysis.band_names())]
    cells = spark.range(4 * 16).selectExpr("id div 16 AS tile_col", "0L AS tile_row", "id div 4 % 4 AS local_row", "id % 4 AS local_col").selectExpr("*", *bands)
    tables.write_pixels(cells, f"file://{tmp_path}/tiles")
    plans, was = [], stages.kept
    monkeypatch.setattr(stages, "kept", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or was(df))
    pixels = tables.read_pixels(spark, f"file://{tmp_path}/tiles")
    one_tile = zones.features_of(spark, [[[[(100.0, 100.0), (3900.0, 100.0), (3900.0, 3900.0), (100.0, 3900.0), (100.0, 100.0)]]]])
    sample = stages.build_sample(pixels, analysis, one_tile)
    assert {r.tile_col for r in sample.collect()} == {0}
    for line in plans[0].splitlines():
        if "Exchange" in line or "Window" in line:
            assert not any(c in line for c in analysis.band_names()), line
    assert "dynamicpruning" in sample._jdf.queryExecution().executedPlan().toString().lower()


def test_fit_and_apply(spark, analysis):
    rng = np.random.default_rng(5)
    rows = []
    for b in range(8):
        for k in range(24):
            rain, land, ref = float(rng.normal(10, 3)), float(rng.integers(1, 4)), int(k < 12)
            rows.append((b * 2 + k % 2, k % 2, ref, 1e6 + k, 2 * rain + land + float(rng.normal(0, 0.2)) + (0 if ref else 4), rain, land))
    names = ("y2018_d02_ndvi", "y2018_d24_rain", "y2018_d35_landform")
    sample = spark.createDataFrame(rows, f"sampling_block_column long, sampling_block_row long, reference_site int, area_weight_m2 double, {', '.join(f'{n} double' for n in names)}")
    prepared = stages.prepare(sample, analysis)
    coverage = {r.response: r.status for r in stages.response_coverage(prepared, analysis).collect()}
    assert coverage == {"y2018_d02_ndvi": "fit"}
    per_block = prepared.rows.groupBy("validation_block_id").agg(F.count_distinct("spatial_fold").alias("n")).collect()
    assert all(r.n == 1 for r in per_block)
    fitted = stages.fit(prepared, analysis, ["y2018_d02_ndvi"])
    assert fitted.models[0].rmse < 3 and fitted.metrics.count() == 2 and stages.fold_rollup(fitted.metrics).count() == 1
    deviation = fitted.scored.where("reference_site = 0").agg(F.median("y2018_d02_ndvi_observed_minus_expected_oof").alias("m")).collect()[0].m
    assert deviation > 2
    calibration, distances = scoring.calibrate(fitted.scored.where("reference_site = 1").withColumnRenamed("y2018_d02_ndvi_standardized_deviation_oof", "z"), ["z"], "area_weight_m2", 0.1)
    pixels = sample.withColumn("y2018_d01_reference", F.col("reference_site").cast("double")).withColumn("y2018_d24_rain", F.when(F.col("area_weight_m2") > 1e6, F.col("y2018_d24_rain")))
    out = stages.score_pixels(pixels, fitted.models, calibration, distances, analysis).toPandas()
    assert set(out.status) == {1, 2} and (out[out.status == 1].missing_predictors > 0).all()
    assert out[(out.status == 2) & (out.reference_site == 0)].percentile.mean() > 0.9 > out[(out.status == 2) & (out.reference_site == 1)].percentile.mean()


def test_band_registry(spark, analysis, tmp_path):
    day = lambda s: s
    ndvi = spark.createDataFrame([(1, day("2018-02-01"), 0.2), (1, day("2018-03-01"), 0.8), (1, day("2019-01-01"), 9.0), (2, day("2018-05-01"), float("nan"))], "pixel long, ts string, NDVI double").withColumn("ts", F.to_timestamp("ts"))
    era = spark.createDataFrame([(1, "2018-01-01", 0.001), (1, "2018-12-31", 0.002)], "pixel long, ts string, total_precipitation double").withColumn("ts", F.to_timestamp("ts"))
    land = spark.createDataFrame([(1, 3.0), (2, 4.0)], "pixel long, constant double")
    yearly = lambda name, a, b: spark.createDataFrame([(p, f"{y}-06-01", v) for p, vs in ((1, a), (2, b)) for y, v in zip((2016, 2017, 2018), vs)], f"pixel long, ts string, {name} double").withColumn("ts", F.to_timestamp("ts"))
    sources = {"landsat_ndvi": ndvi, "era5_daily": era, "srtm_landforms": land, "grassland_probability": yearly("probability", [90.0, 10.0, 80.0], [90.0, 10.0, 10.0]), "human_influence": yearly("hii", [70.0, 70.0, 7000.0], [1.0, 1.0, 1.0]), "human_modification": land.select("pixel", F.lit(0.1).alias("constant"))}
    got = {r.pixel: r for r in bands.build_stack(spark.createDataFrame([(1,), (2,)], "pixel long"), sources, analysis).collect()}
    assert got[1].y2018_d02_ndvi == pytest.approx(0.77) and got[2].y2018_d02_ndvi is None
    assert got[1].y2018_d24_rain == pytest.approx(3.0) and got[2].y2018_d24_rain is None
    assert (got[1].y2018_d01_reference, got[2].y2018_d01_reference) == (1.0, None)
    assert (got[1].y2018_d35_landform, got[2].y2018_d35_landform) == (3.0, 4.0)


# Sources and sinks


def test_tiles_manifest_and_resume(spark, tmp_path):
    cells = [(t, 0, i, j, float(i + j)) for t in range(4) for i in range(2) for j in range(2)]
    pixels = spark.createDataFrame(cells, "tile_col int, tile_row int, local_row int, local_col int, v double")
    path = f"file://{tmp_path}/tiles"
    tables.write_pixels(pixels.where("tile_col < 3"), path)
    manifest = tables.manifest_of(pixels.where("tile_col < 3"), "s", ["v"])
    required = pixels.select("tile_col", "tile_row").distinct()
    assert [r.tile_col for r in tables.missing_tiles(required, manifest, "s").collect()] == [3]
    with pytest.raises(ValueError, match="1 tiles fail.*not in the manifest"):
        tables.check_tiles(required, tables.read_pixels(spark, path), manifest, "s", ["v"])
    tables.write_pixels(pixels.where("tile_col = 3"), path)  # only that tile is added
    full = tables.manifest_of(tables.read_pixels(spark, path), "s", ["v"])
    assert tables.check_tiles(required, pixels, full, "s", ["v"]).count() == 4
    with pytest.raises(ValueError, match="other content"):
        tables.check_tiles(required, pixels.withColumn("v", F.col("v") + 1), full, "s", ["v"])


def test_provenance_and_models(spark, tmp_path):
    df = spark.range(10).withColumn("v", F.col("id") * 2)
    out = tables.write_with_provenance(df, f"file://{tmp_path}/sample", {"seed": 42})
    assert out.rows == 10 and out.provenance["seed"] == 42 and tables.read_provenance(spark, f"file://{tmp_path}/sample")["columns"] == ["id", "v"]
    design = models.Design(["x"], "c", {"x": 0.0, "c": 1.0}, {"x": [0.0, 1.0, 2.0]}, [1.0])
    tables.write_models(spark, [models.ResponseModel("y", design, [0.0] * 5, 1.0, 2.0)], f"file://{tmp_path}/models")
    assert tables.read_models(spark, f"file://{tmp_path}/models")[0].rmse == 2.0
    tables.write_models(spark, [models.ResponseModel("y", design, [0.0] * 5, 1.0, 0.0)], f"file://{tmp_path}/bad")
    with pytest.raises(ValueError):
        tables.read_models(spark, f"file://{tmp_path}/bad")


def test_fingerprints_and_resume(spark, analysis, tmp_path):
    pixels = spark.createDataFrame([(t, u, i, 0, float(i)) for t in (0, 1) for u in (0, 1) for i in range(3)], "tile_col int, tile_row int, local_row int, local_col int, v double")
    tiles = provenance.tile_set_fingerprint(tables.manifest_of(pixels.repartition(3), "s", ["v"]))
    assert tiles == provenance.tile_set_fingerprint(tables.manifest_of(pixels, "s", ["v"])) != provenance.tile_set_fingerprint(tables.manifest_of(pixels.where("tile_col = 0"), "s", ["v"]))
    assert provenance.content_fingerprint(pixels) == provenance.content_fingerprint(pixels.repartition(5)) != provenance.content_fingerprint(pixels.union(pixels.limit(1)))
    c = scoring.Calibration(["y"], [0.0], [[1.0]], [[1.0]], 2, 2.0, 1.0, 1.0)
    run = provenance.inference_fingerprint(analysis, tiles, [], c, "d")
    assert run not in {provenance.inference_fingerprint(analysis, tiles, [], c, "d", mask="m"), provenance.inference_fingerprint(analysis, tiles, [], c, "e")}
    out = f"file://{tmp_path}/map"
    assert provenance.done_tiles(spark, out, run, ["v"]) is None
    provenance.start_run(spark, out, run)
    tables.write_pixels(pixels.where("tile_col = 1"), f"{out}/pixels")
    assert sorted(tuple(r) for r in provenance.done_tiles(spark, out, run, ["v"]).collect()) == [(1, 0), (1, 1)]
    assert provenance.done_tiles(spark, out, "other", ["v"]) is None and provenance.done_tiles(spark, out, run, ["w"]) is None
    for k in range(2):
        provenance.log_event(spark, f"{out}/history", tiles=k)
    assert spark.read.parquet(f"{out}/history").count() == 2


def test_feature_reader(spark, tmp_path):
    ring, hole = [[0, 0], [4, 0], [4, 4], [0, 0]], [[1, 0.5], [2, 0.5], [2, 1], [1, 0.5]]
    shapes = [{"type": "Polygon", "coordinates": [ring, hole]}, {"type": "MultiPolygon", "coordinates": [[ring], [[[5, 5, 9], [6, 5, 9], [6, 6, 9], [5, 5, 9]]]]}]
    shapes.append({"type": "GeometryCollection", "geometries": shapes[:2]})
    names = [{"ECO_NAME": "a", "n": 3}, None, {}]
    put = lambda name, doc: (tmp_path / name).write_text(doc if isinstance(doc, str) else json.dumps(doc)) and f"file://{tmp_path}/{name}"
    features = [{"type": "Feature", "properties": p, "geometry": g} for p, g in zip(names, shapes)]
    collection = put("a.geojson", {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::6933"}}, "features": features})
    got = tables.read_features(spark, collection, "EPSG:6933").orderBy("feature").collect()
    assert [len(r.polygons) for r in got] == [1, 2, 3] and [len(r.polygons[0]) for r in got] == [2, 1, 2] and got[0].properties == {"ECO_NAME": "a", "n": "3"}
    assert [(q.x, q.y) for q in got[1].polygons[1][0]] == [(5, 5), (6, 5), (6, 6), (5, 5)]
    lines = put("b.geojsonl", "\n".join(json.dumps(f) for f in features) + "\n")
    assert sorted(len(r.polygons) for r in tables.read_features(spark, lines, "EPSG:4326", whole=False).collect()) == [1, 2, 3]
    for bare in (shapes[0], features[0]):
        assert tables.read_features(spark, put("c.geojson", bare), "EPSG:4326").count() == 1
    for bad in ({"type": "Point", "coordinates": [0, 0]}, {"type": "Polygon", "coordinates": [ring[:3]]}, {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [2, 2]]]}, {"type": "FeatureCollection", "features": []}, "nothing", {"type": "Polygon", "coordinates": [ring], "crs": {"properties": {"name": "EPSG:32633"}}}):
        with pytest.raises(ValueError):
            tables.read_features(spark, put("d.geojson", bad), "EPSG:4326")


def test_area_in_degrees_takes_the_same_pixels(spark, tmp_path, analysis):
    ring = [[100, 100], [7900, 300], [6900, 3900], [200, 3500], [100, 100]]
    (tmp_path / "grid.geojson").write_text(json.dumps({"type": "Polygon", "crs": {"properties": {"name": "EPSG:6933"}}, "coordinates": [ring]}))
    corners = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(ring)], "i int, x double, y double")
    lon, lat = G.cylindrical_to_lonlat(F.col("x"), F.col("y"))
    degrees = [[r.lon, r.lat] for r in corners.select("i", lon.alias("lon"), lat.alias("lat")).orderBy("i").collect()]
    (tmp_path / "degrees.geojson").write_text(json.dumps({"type": "Polygon", "coordinates": [degrees]}))
    pixels = spark.range(2 * 16).selectExpr("id div 16 AS tile_col", "0L AS tile_row", "id div 4 % 4 AS local_row", "id % 4 AS local_col")
    found = []
    for name in ("grid", "degrees"):
        index = stages.area_index(tables.read_features(spark, f"file://{tmp_path}/{name}.geojson", "EPSG:6933"), analysis)
        found.append({tuple(r) for r in stages.in_area(stages.locate(pixels, analysis), index, analysis).select(*stages.PIXEL).collect()})
    assert found[0] == found[1] and 10 < len(found[0]) < 32


def test_months_are_one_row_each(spark, tmp_path):
    import datetime

    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    at = lambda m, d: datetime.datetime(2024, m, d, 12)
    rows = [(at(m, d), k, float(m * d)) for m in (1, 2, 3) for d in (1, 2, 15, 28) for k in "ab"]
    spark.createDataFrame(rows, "ts timestamp, k string, v double").write.parquet(source)
    stream = spark.readStream.schema("ts timestamp, k string, v double").parquet(source)
    monthly_statistics(stream, "ts", "k", "v").writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.parquet(f"{out}/{n}")).option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.option("recursiveFileLookup", "true").parquet(out).collect()
    assert sorted((r.month.month, r.k, r.sum, r["count"]) for r in got) == [(m, k, float(m * 46), 4) for m in (1, 2, 3) for k in "ab"]


def test_repeated_rows_and_damage_show_in_the_manifest(spark, tmp_path):
    rows = [(0, 0, i, 0, float(i)) for i in range(4)] + [(1, 0, i, 0, float(i)) for i in range(4)]
    schema = "tile_col long, tile_row long, local_row long, local_col long, v double"
    pixels = spark.createDataFrame(rows, schema)
    first = tables.manifest_of(pixels, "s", ["v"]).withColumn("written", F.current_timestamp())
    first.write.parquet(f"file://{tmp_path}/m")
    twice = tables.manifest_of(pixels.unionByName(pixels), "s", ["v"])
    assert not {r.sha for r in twice.collect()} & {r.sha for r in first.collect()}
    damaged = pixels.where("NOT (tile_col = 1 AND local_row = 2)").unionByName(spark.createDataFrame([(1, 0, 2, 0, 9.5)], schema))
    kept = spark.read.parquet(f"file://{tmp_path}/m")
    assert [r.tile_col for r in tables.sound_entries(tables.newest(kept), damaged, "s", ["v"]).collect()] == [0]
    tables.manifest_of(damaged, "s", ["v"]).withColumn("written", F.current_timestamp()).write.mode("append").parquet(f"file://{tmp_path}/m")
    required = pixels.select("tile_col", "tile_row").distinct()
    tables.check_tiles(required, damaged, tables.newest(spark.read.parquet(f"file://{tmp_path}/m")), "s", ["v"])


def test_incremental_processing_resumes(spark, tmp_path):
    source, schema = f"file://{tmp_path}/in", "tile int, v int"
    add = lambda t: spark.createDataFrame([(t, t * 10)], schema).coalesce(1).write.mode("append").parquet(source)
    run = lambda: process_new_tiles(spark, source, schema, lambda d: d.withColumn("v", F.col("v") + 1), f"file://{tmp_path}/out", f"file://{tmp_path}/state", 2)
    for t in range(3):
        add(t)
    run()
    add(9)
    run()
    assert sorted((r.tile, r.v) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == [(0, 1), (1, 11), (2, 21), (9, 91)]
