"""Counts and quantiles by feature against pairs of points and features."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from meadowline import queries
from meadowline.operators import zones


def _stars(rng):
    """Areas of several polygons that overlap, cross themselves, have holes and horizontal edges."""
    areas = []
    for _ in range(60):
        polygons = []
        for _ in range(rng.choice([1, 1, 2, 3])):
            ring = [(float(rng.randrange(-30, 60)), rng.choice([float(rng.randrange(-20, 40)), 7.0])) for _ in range(rng.randrange(3, 8))]
            polygons.append([[*ring, ring[0]], [(0.0, 0.0), (9.5, 0.0), (9.5, 5.0), (0.0, 5.0), (0.0, 0.0)]][: rng.choice([1, 2])])
        areas.append(polygons)
    return areas


@pytest.mark.parametrize("kinds", [5, 10_000])
def test_tallies_equal_pairs(spark, monkeypatch, kinds):
    rng = random.Random(kinds)
    monkeypatch.setattr(zones, "FEATURES_AT_ONCE", 20)
    monkeypatch.setattr(zones, "POINTS_AT_ONCE", 300)
    points = [(i, rng.choice([float(rng.randrange(-30, 60)), rng.uniform(-30, 60)]), rng.choice([7.0, float(rng.randrange(-20, 40)), rng.uniform(-20, 40)]), rng.choice([None, rng.randrange(kinds), rng.randrange(kinds)])) for i in range(1500)]
    df = zones.with_tiles(spark.createDataFrame(points, "id long, x double, y double, v int"), "x", "y", 25.0, 16.0)
    index = zones.tile_index(zones.features_of(spark, _stars(rng)), 25.0, 16.0)
    want = Counter((r.feature, r.v) for r in zones.features_at(df, index, "x", "y").collect())
    got = {(r.feature, r.v): r.n for r in zones.tallies(df, index, "x", "y", "v").collect()}
    assert got == want and sum(want.values()) > 5000
    assert zones.tallies(df.limit(0), index, "x", "y", "v").count() == 0


def test_queries_by_feature_do_not_pair_points_with_features(spark, data, monkeypatch):
    monkeypatch.setattr(zones, "features_at", lambda *_: pytest.fail("pairs"))
    assert queries.pixels_by_feature(spark, data).agg(F.sum("pixels")).collect()[0][0] > 0
    assert queries.zonal_range(spark, data).count() > 0


def test_zonal_range_is_exact(spark):
    df = spark.range(30_000).selectExpr("id % 2 AS feature", "double(id) AS v")
    assert {(r.feature, r.n, r.low, r.high) for r in zones.zonal_range(df, F.col("v")).collect()} == {(0, 15_000, 2998.0, 26998.0), (1, 15_000, 2999.0, 26999.0)}
    few = spark.createDataFrame([(1, 1.0, 2), (1, 2.0, 1), (1, 5.0, 3), (1, None, 4), (2, None, 1)], "feature long, v double, n long")
    got = {r.feature: (r.n, r.low, r.high) for r in zones.zonal_range(few, F.col("v"), 0.3, 0.6, n=F.col("n"), between=True).collect()}
    assert got == {1: (6, 1.5, 5.0), 2: (0, None, None)}
    got = {r.feature: (r.n, r.low, r.high) for r in zones.zonal_range(few, F.col("v"), 0.3, 0.6, n=F.col("n")).collect()}
    assert got == {1: (6, 1.0, 5.0), 2: (0, None, None)}


def test_region_range_lies_between_ranks_of_large_regions(spark, tmp_path):
    n = 60_000
    spark.range(1).selectExpr("1 AS n_nationkey", "4 AS n_regionkey").union(spark.sql("SELECT 2, 3")).write.parquet(f"{tmp_path}/nation.parquet")
    spark.range(n).selectExpr("id AS c_custkey", "1 AS c_nationkey", "double(id * id) AS c_acctbal").write.parquet(f"{tmp_path}/customer.parquet")
    at = lambda q: (lambda p, i: i * i + (p - i) * (2 * i + 1))(q * (n - 1), int(q * (n - 1)))
    got = {r.n_regionkey: (r.low, r.high) for r in queries.region_range(spark, str(tmp_path)).collect()}
    assert got == {4: (pytest.approx(at(0.1), abs=1e-4), pytest.approx(at(0.9), abs=1e-4)), 3: (0.0, 1.0)}
