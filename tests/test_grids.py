"""Correlation matrices, regions, other grids and exports against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meadowline import queries
from meadowline.functions import grid as G
from meadowline.operators import coverage, weighted, zones
from meadowline.plans import export
from meadowline.sources import tables


def test_correlation_matrix_equals_numpy(spark):
    rng = random.Random(4)
    names = [f"c{i}" for i in range(6)]
    rows = [[rng.choice([None, 0.0, -1.0, rng.uniform(0.5, 3)])] + [rng.choice([None, float("nan"), rng.gauss(0, 1)]) if i < 4 else (2.0 if i == 4 else None) for i in range(6)] for _ in range(300)]
    df = spark.createDataFrame(rows, "w double, " + ", ".join(f"{n} double" for n in names)).repartition(5)
    got = {(r.x, r.y): (r.rows, r.correlation) for r in weighted.correlation_matrix(df, names, "w").collect()}
    assert len(got) == 36 and all(got[a, b] == got[b, a] for a, b in got) and all(got[n, n][1] == 1 for n in names)
    w = np.array([r[0] or 0.0 for r in rows])
    v = np.array([[math.nan if x is None else x for x in r[1:]] for r in rows])
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            ok = (w > 0) & ~np.isnan(v[:, i]) & ~np.isnan(v[:, j])
            assert got[a, b][0] == ok.sum()
            if i != j and max(i, j) < 4:
                x, y, u = v[ok, i], v[ok, j], w[ok]
                mx, my = np.average(x, weights=u), np.average(y, weights=u)
                assert got[a, b][1] == pytest.approx(np.average((x - mx) * (y - my), weights=u) / math.sqrt(np.average((x - mx) ** 2, weights=u) * np.average((y - my) ** 2, weights=u)))
            elif i != j:
                assert got[a, b][1] is None
    assert weighted.correlation_matrix(df.limit(0), names[:2], "w").where("x <> y").select("rows", "correlation").distinct().collect() in ([(0, None)], [])


def test_predictor_coverage(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (3.0, None, None), (4.0, 0.0, None)], "area double, p double, q double")
    got = {r.predictor: tuple(r)[1:] for r in coverage.predictor_coverage(df, ["p", "q"], "area").collect()}
    assert got == {"p": (2, pytest.approx(2 / 3), 5.0, 0.625), "q": (0, 0.0, 0.0, 0.0)}


def test_zonal_range_and_its_fallback(spark):
    rows = [(1, float(i)) for i in range(101)] + [(2, 5.0)] * 9 + [(3, None)]
    got = {r.feature: (r.n, r.low, r.high) for r in zones.zonal_range(spark.createDataFrame(rows, "feature long, v double"), F.col("v")).collect()}
    assert got == {1: (101, pytest.approx(10, abs=1), pytest.approx(90, abs=1)), 2: (9, None, None), 3: (0, None, None)}


def test_regrid_equals_plain_python(spark, tmp_path):
    rng = random.Random(8)
    source, target = G.Grid("EPSG:4326", -3.0, 2.0, 0.5, 0.25), G.Grid("EPSG:6933", -1000.0, 700.0, 9000.0, 7000.0)
    cells = [(i, j, float(rng.randrange(100)), rng.choice([None, 1.5])) for i in range(16) for j in range(12) if rng.random() < 0.8]
    raster = spark.createDataFrame(cells, "row long, col long, a double, b double")
    star = lambda x, y, n: [(x + (d := rng.uniform(2e4, 1.5e5)) * math.cos(2 * math.pi * k / n), y + d * math.sin(2 * math.pi * k / n)) for k in range(n)]
    areas = [[[[*ring, ring[0]]] for ring in [star(rng.uniform(-2e5, 2e5), rng.uniform(-1e5, 1e5), rng.randrange(3, 9)) for _ in range(rng.choice([1, 2]))]] for _ in range(6)]
    got = {(r.region, r.row, r.col): (r.a, r.b) for r in export.regrid(raster, source, ["a", "b"], zones.features_of(spark, areas), target, 8).collect()}
    centres = {(i, j): (target.left + (j + 0.5) * target.width, target.top - (i + 0.5) * target.height) for i in range(-60, 60) for j in range(-60, 60)}
    points = spark.createDataFrame([(*k, *v) for k, v in centres.items()], "i long, j long, x double, y double")
    lon, lat = G.cylindrical_to_lonlat(F.col("x"), F.col("y"))
    degrees = {(r.i, r.j): (r.lon, r.lat) for r in points.select("i", "j", lon.alias("lon"), lat.alias("lat")).collect()}
    values, want = {(i, j): (a, b) for i, j, a, b in cells}, {}

    def odd(x, y, polygon):
        return sum(((a[1] > y) != (b[1] > y)) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for ring in polygon for a, b in zip(ring, ring[1:])) % 2

    # The index keeps polygons from the grid's corner, as the library does.
    moved = [[[[(x - target.left, y - target.top) for x, y in ring] for ring in polygon] for polygon in area] for area in areas]
    for k, area in enumerate(moved):
        for (i, j), (x, y) in centres.items():
            if any(odd((j + 0.5) * target.width, -(i + 0.5) * target.height, p) for p in area):
                lo, la = degrees[i, j]
                want[k, i, j] = values.get((math.floor((source.top - la) / source.height), math.floor((lo - source.left) / source.width)), (None, None))
    assert got == want and len(want) > 100
    path = f"file://{tmp_path}/out"
    export.write_regions(export.regrid(raster, source, ["a", "b"], zones.features_of(spark, areas), target, 8), path)
    assert {f.name for f in (tmp_path / "out").iterdir() if f.is_dir()} == {f"region={k}" for k in {k for k, *_ in want}}
    assert spark.read.parquet(path).count() == len(want)


def test_many_regions_share_folders_and_are_read_one_by_one(spark, tmp_path):
    path, schema = f"file://{tmp_path}/out", "region long, row long, col long, v float"
    cells = spark.range(300 * 40).selectExpr("id div 40 - 5 AS region", "id % 40 * 100 AS row", "id % 7 AS col", "float(if(id % 3 = 0, NULL, id)) AS v")
    export.write_region_parts(cells, path)
    assert len([f for f in (tmp_path / "out").iterdir() if f.is_dir()]) == export.PARTS < 300
    order = ["region", "row", "col"]
    assert export.read_region(spark, path, schema).orderBy(*order).collect() == cells.orderBy(*order).collect()
    for region in (-5, 0, 65, 294, 1000):
        one = export.read_region(spark, path, schema, region)
        assert one.orderBy(*order).collect() == cells.where(f"region = {region}").orderBy(*order).collect()
        assert "PartitionFilters: [isnotnull(part" in one._jdf.queryExecution().executedPlan().toString()


def test_export_of_many_regions_makes_no_folder_for_each(spark, data, monkeypatch):
    paths, scratch = [], queries.scratch_dir
    monkeypatch.setattr(queries, "scratch_dir", lambda spark: paths.append(scratch(spark)) or paths[-1])
    regions = 90  # of one place each, more than there are folders
    monkeypatch.setattr(queries, "table", lambda spark, sf, name, table=queries.table: table(spark, sf, name) if name != "supplier" else spark.range(regions).selectExpr("id AS s_suppkey", "int(id % 25) AS s_nationkey", "double(id * 97 % 9000) AS s_acctbal"))
    got = queries.region_export(spark, data)
    assert got.select("region").distinct().count() == regions
    files = {f.split("/export/")[1].split("/")[0] for f in got.inputFiles()}
    assert len(files) <= export.PARTS


def test_crossings_decide_as_edges(spark):
    ring = [(0.0, 0.0), (9.0, 1.0), (4.0, 4.0), (9.5, 8.0), (1.0, 9.0), (3.0, 5.0), (0.0, 0.0)]
    index = zones.tile_index(zones.features_of(spark, [[[ring], [[(2.0, 2.0), (6.0, 2.0), (6.0, 7.0), (2.0, 2.0)]]]]), 4.0)
    points = index.selectExpr("*", "explode(sequence(0, 15)) AS i").selectExpr("*", "explode(sequence(0, 15)) AS j").selectExpr("*", "tile_col * 4 + i / 4.0D AS x", "tile_row * 4 + j / 4.0D AS y")
    both = points.withColumn("crossings", zones.crossings(F.col("y"))).select(zones.inside(F.col("x"), F.col("y")).alias("a"), zones.inside_row(F.col("x")).alias("b"))
    assert both.where("a <> b").count() == 0 and both.where("a").count() > 100 and both.where("NOT a").count() > 100


def test_export_names(spark):
    box = lambda n: [[[(0, 0), (n, 0), (n, n), (0, n), (0, 0)]]]
    rows = [(0, {"ECO_NAME": "Highveld Grasslands & Hills"}, 3.0), (1, {"NAME": " "}, 1.0), (2, {"NAME": "Ü"}, 2.0)]
    features = zones.features_of(spark, [box(n) for *_, n in rows]).drop("properties").join(spark.createDataFrame([(i, p) for i, p, _ in rows], "feature long, properties map<string,string>"), "feature")
    got = {r.feature: (r.number, r.area, r.name) for r in export.export_names(features, [2018, 2020], ["ECO_NAME", "NAME"]).collect()}
    assert got == {1: (1, 1.0, "unnamed_1_e0001_response_variables_years_2018_2020"), 2: (2, 4.0, "unnamed_region_e0002_response_variables_years_2018_2020"), 0: (3, 9.0, "highveld_grasslands_hills_e0003_response_variables_years_2018_2020")}


def test_masks_and_their_grids(spark, tmp_path):
    mask = spark.createDataFrame([(0, 0, 1)], "row long, col long, mask int")
    path = f"file://{tmp_path}/m"
    tables.write_mask(mask, path, G.Grid("EPSG:3857", 0, 0, 10, 20))
    back, grid = tables.read_mask(spark, path)
    assert back.collect() == mask.collect() and grid == G.Grid("EPSG:3857", 0.0, 0.0, 10.0, 20.0)
    tables.write_mask(mask, path, G.Grid("EPSG:3857", 0, 0, 0, 20))
    with pytest.raises(ValueError):
        tables.read_mask(spark, path)
    pixels = spark.createDataFrame([(0, 0, 1, 1, 1)], "tile_col long, tile_row long, local_row long, local_col long, mask int")
    pixels.write.parquet(f"file://{tmp_path}/p")
    assert tables.read_mask(spark, f"file://{tmp_path}/p")[1] is None


def test_files_of_tiles_tell_what_is_sound(spark, tmp_path):
    pixels = spark.range(3 * 4).selectExpr("id div 4 AS tile_col", "0L AS tile_row", "id div 2 % 2 AS local_row", "id % 2 AS local_col", "double(id) AS v")
    path, tiles = f"file://{tmp_path}/tiles", pixels.select("tile_col", "tile_row").distinct()
    assert tables.tile_files(spark, path, tiles).count() == 0 and tables.cached_pixels(spark, path, ["v"], tiles).count() == 0
    tables.write_pixels(pixels, path)
    entries = tables.manifest_of(pixels, "s", ["v"]).join(tables.file_digests(tables.tile_files(spark, path, tiles)), ["tile_col", "tile_row"]).collect()
    manifest = spark.createDataFrame([tuple(r[c] for c in ("stack", "tile_col", "tile_row", "rows", "sha", "bands", "files")) for r in entries], tables.MANIFEST)
    sound = lambda bands=("v",): sorted(r.tile_col for r in tables.sound_tiles(manifest, tables.tile_files(spark, path, tiles), list(bands)).collect())
    assert sound() == [0, 1, 2] and sound(("u",)) == []
    f = next((tmp_path / "tiles" / "tile_col=1").rglob("*.parquet"))
    f.write_bytes(b"PAR1")
    (tmp_path / "tiles" / "tile_col=2" / "tile_row=0" / "more.parquet").write_bytes(b"x")
    assert sound() == [0]
    assert tables.cached_pixels(spark, path, ["v"], tiles.where("tile_col = 0")).count() == 4  # the broken ones are not opened
