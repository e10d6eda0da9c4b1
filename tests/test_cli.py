"""The stages from the command line, on the smallest inputs that have all of them."""

import json
import math
import random
import shutil

import pytest

from meadowline.plans import cli
from tests.test_library import TOML


def test_mask_command(spark, tmp_path, capsys):
    spark.createDataFrame([(1, 90.0), (2, 10.0), (3, None)], "pixel long, p double").write.parquet(f"file://{tmp_path}/in")
    cli.main(["mask", f"file://{tmp_path}/in", f"file://{tmp_path}/out", "p", ">=80"])
    assert sorted((r.pixel, r["mask"]) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == [(1, 1), (2, 0), (3, 0)]
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {"1": 1, "0": 2}


def test_all_stages(spark, tmp_path, monkeypatch):
    root, rng = f"file://{tmp_path}", random.Random(3)
    text = TOML.replace("samples_per_class_per_block = 3", "samples_per_class_per_block = 8").replace("ridge_alpha = 1.0", "ridge_alpha = 0.1").replace("tile_size_pixels = 4", "tile_size_pixels = 20")
    names = {"ndvi": "landsat_ndvi", "era5": "era5_daily", "land": "srtm_landforms", "ref": "grassland_probability"}
    for old, new in names.items():
        text = text.replace(f'{old} = "', f'{new} = "').replace(f'sources = ["{old}"]', f'sources = ["{new}"]')
    text = text.replace("[sampling]", 'human_influence = "E"\nhuman_modification = "F"\n[sampling]')
    (tmp_path / "a.toml").write_text(text)
    crs = {"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::6933"}}
    ring = [[0, 0], [39999, 0], [39999, 39999], [0, 39999], [0, 0]]
    (tmp_path / "area.geojson").write_text(json.dumps({"type": "Polygon", "crs": crs, "coordinates": [ring]}))
    cells = [(t, u, i, j, ((t * 2 + u) * 20 + i) * 20 + j) for t in (0, 1) for u in (0, 1) for i in range(20) for j in range(20)]
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{root}/sources/{name}")
    put("spine", cells, "tile_col long, tile_row long, local_row long, local_col long, pixel long")
    good = {p: rng.random() < 0.5 for *_, p in cells}
    rain = {p: rng.gauss(1, 0.2) for *_, p in cells}
    from pyspark.sql import functions as F

    def dated(name, rows, band):
        spark.createDataFrame(rows, f"pixel long, ts string, {band} double").withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{root}/sources/{name}")

    dated("landsat_ndvi", [(p, "2018-03-01", rain[p] + (0.0 if good[p] else 1.0) + rng.gauss(0, 0.02)) for *_, p in cells], "NDVI")
    dated("era5_daily", [(p, "2018-03-01", rain[p]) for *_, p in cells], "total_precipitation")
    dated("grassland_probability", [(p, f"{y}-01-01", 90.0 if good[p] else 5.0) for *_, p in cells for y in (2016, 2017, 2018)], "probability")
    dated("human_influence", [(p, f"{y}-01-01", 1.0) for *_, p in cells for y in (2016, 2017, 2018)], "hii")
    put("human_modification", [(p, 0.0) for *_, p in cells], "pixel long, constant double")
    put("srtm_landforms", [(p, float(p % 3)) for *_, p in cells], "pixel long, constant double")
    definition = str(tmp_path / "a.toml")
    for _ in range(2):  # the second run finds every tile in the cache
        cli.main(["fetch", definition, "--area", f"{root}/area.geojson", "--sources", f"{root}/sources", "--cache", f"{root}/cache"])
    cli.main(["sample", definition, "--area", f"{root}/area.geojson", "--cache", f"{root}/cache", "--output", f"{root}/sample"])
    cli.main(["fit", definition, f"{root}/sample", "--output", f"{root}/run"])
    for _ in range(2):  # the second run finds all tiles scored
        cli.main(["apply", definition, f"{root}/run", "--cache", f"{root}/cache", "--output", f"{root}/map"])
    out = spark.read.parquet(f"{root}/map/pixels").toPandas()
    assert len(out) == len(cells) and (out.status == 2).all()
    reference = out.y2018_d01_reference == 1
    assert out[~reference].percentile.mean() > 0.95 and math.isclose(out[reference].percentile.mean(), 0.5, abs_tol=0.25)
    told = lambda name: spark.read.option("header", True).option("inferSchema", True).csv(f"{root}/sample.{name}").collect()
    found, classes, whole_rows = told("footprint")[0], {r.reference_site: r for r in told("classes")}, told("completeness")[0]
    assert (found.area_pixels, found.excluded_reference_pixels) == (1600, 0) and found.background_pixels + found.reference_pixels == 1600 and found.reference_pixels == sum(good.values())
    assert classes[1].represented_rows == found.reference_pixels and classes[0].represented_rows == found.background_pixels
    assert whole_rows.rows == whole_rows.complete_rows == classes[0].sampled_rows + classes[1].sampled_rows and whole_rows.missing_bands == 0 and len(told("bands")) == 3
    read = lambda name: spark.read.option("header", True).option("inferSchema", True).csv(f"{root}/run/{name}").collect()
    response = "y2018_d02_ndvi"
    assert [(r.x, r.y, r.correlation) for r in read("deviation_correlation")] == [(response, response, 1.0)]
    covered = {r.predictor: r for r in read("predictor_coverage")}
    assert set(covered) == {"y2018_d24_rain", "y2018_d35_landform"} and all(r.retained and r.row_fraction == 1 and r.area_fraction == 1 and r.rows > 0 and r.area > 0 for r in covered.values())
    partial = read("partial_responses")
    rain_points = sorted(r.value for r in partial if r.predictor == "y2018_d24_rain")
    assert len(rain_points) == 100 and sorted({r.value for r in partial if r.predictor == "y2018_d35_landform"}) == [0.0, 1.0, 2.0]
    along = sorted((r.value, r.expected) for r in partial if r.predictor == "y2018_d24_rain")
    assert along[-1][1] - along[0][1] > 0.5 * (along[-1][0] - along[0][0]) / 1000  # rain in millimetres
    record = json.loads(spark.read.text(f"{root}/run/metadata").collect()[0].value)
    assert record["fitted_responses"] == [response] and record["excluded_predictors"] == [] and record["sampled_rows"] >= record["reference_rows"] > 0
    # A damaged tile is made again, and a refresh leaves one entry a tile that counts.
    stack = next(x for x in (tmp_path / "cache").iterdir() if x.is_dir())
    from meadowline.sources import tables

    whole = spark.read.parquet(f"file://{stack}/tiles").count()
    for f in (stack / "tiles" / "tile_col=0" / "tile_row=1").glob("*.parquet"):
        f.unlink()
    for more in ([], ["--refresh"]):
        cli.main(["fetch", definition, "--area", f"{root}/area.geojson", "--sources", f"{root}/sources", "--cache", f"{root}/cache", *more])
        assert spark.read.parquet(f"file://{stack}/tiles").count() == whole
    assert tables.newest(spark.read.parquet(f"file://{stack}/manifest")).count() == 4
    # A tile that is no Parquet at all is replaced and nothing else is; so is a cache whose folder of tiles is lost.
    fetch = lambda *more: cli.main(["fetch", definition, "--area", f"{root}/area.geojson", "--sources", f"{root}/sources", "--cache", f"{root}/cache", *more])
    requests = lambda: [r.event for r in spark.read.parquet(f"file://{stack}/requests").orderBy("at").collect()]
    before = {f: f.read_bytes() for f in (stack / "tiles").rglob("*.parquet")}
    broken = next(f for f in before if "tile_col=1/tile_row=0" in str(f))
    broken.write_bytes(b"not a tile")
    known = len(requests())
    fetch()
    after = {f: f.read_bytes() for f in (stack / "tiles").rglob("*.parquet")}
    assert {f for f in before if f not in after} <= {broken} and all(after[f] == b for f, b in before.items() if f != broken)
    assert spark.read.parquet(f"file://{stack}/tiles").count() == whole
    assert [(r["todo"], r["made"], r["failed"]) for r in requests()[known:]] == [("1", "1", "0")]
    shutil.rmtree(stack / "tiles")
    fetch()
    assert requests()[-1]["made"] == "4" and spark.read.parquet(f"file://{stack}/tiles").count() == whole
    # What fails is logged with its tiles; those before it stay, and the next run goes on from there.
    monkeypatch.setattr(cli, "TILES_PER_BATCH", 1)
    shutil.rmtree(stack / "tiles")
    calls, was = [], cli.write_pixels

    def fails(*x):
        calls.append(1)
        if len(calls) == 2:
            raise TimeoutError("no network")
        return was(*x)

    monkeypatch.setattr(cli, "write_pixels", fails)
    with pytest.raises(RuntimeError, match="goes on from there"):
        fetch()
    failed = requests()[-1]
    assert (failed["todo"], failed["made"], failed["failed"], failed["error"], failed["message"]) == ("4", "1", "1", "TimeoutError", "no network") and failed["failed_tiles"].startswith("x")
    fetch()
    assert (requests()[-1]["todo"], requests()[-1]["made"]) == ("3", "3") and spark.read.parquet(f"file://{stack}/tiles").count() == whole
    monkeypatch.undo()
    # A cache of another layout is refused.
    for f in (stack / "cache").iterdir():
        f.unlink()
    (stack / "cache" / "part-0.txt").write_text(json.dumps({"version": 1}))
    with pytest.raises(ValueError, match="another version"):
        fetch()
    shutil.rmtree(stack / "cache")
    fetch()
    # An area with a hole and a mask take targets away.
    hole = [[5000, 5000], [5000, 9000], [9000, 9000], [9000, 5000], [5000, 5000]]
    (tmp_path / "part.geojson").write_text(json.dumps({"type": "Polygon", "crs": crs, "coordinates": [ring, hole]}))
    keys = ["tile_col", "tile_row", "local_row", "local_col"]
    spark.read.parquet(f"{root}/map/pixels").select(*keys, F.when(F.col("local_col") == 3, 0).otherwise(1).alias("mask")).write.parquet(f"{root}/mask")
    (tmp_path / "b.toml").write_text(text.replace("[inference]", '[inference]\napplication_mask_path = "mask"\napplication_mask_label = "open land"'))
    cli.main(["apply", str(tmp_path / "b.toml"), f"{root}/run", "--cache", f"{root}/cache", "--output", f"{root}/part", "--area", f"{root}/part.geojson"])
    part = spark.read.parquet(f"{root}/part/pixels").toPandas()
    masked = part.local_col == 3
    outside = part.status == 255
    assert len(part) == len(cells) and outside.sum() == 16 and (part[masked & ~outside].status == 0).all() and part[part.status != 2].missing_predictors.isna().all()
    assert (part[~masked & ~outside].status == 2).all() and part[part.status == 2].percentile.notna().all() and part[part.status != 2].percentile.isna().all()
    summary = spark.read.option("header", True).csv(f"{root}/part/response_statistics").collect()
    assert {int(r.expected) for r in summary} == {(part.status == 2).sum()}
    counts = spark.read.option("header", True).csv(f"{root}/part/status").collect()[0]
    assert [int(counts[k]) for k in ("area", "outside_target", "target", "predicted")] == [len(cells) - 16, (part.status == 0).sum(), (part.status == 2).sum(), (part.status == 2).sum()]
    quantiles = spark.read.option("header", True).csv(f"{root}/part/distance_quantiles").collect()[0]
    assert 0 < float(quantiles.p50) < float(quantiles.p90) <= float(quantiles.p99)
    assert spark.read.parquet(f"{root}/part/display").agg(F.sum("value_count").alias("n")).collect()[0].n == (part.status == 2).sum()
    # A coarse mask on a grid in degrees: of its cells, half a degree wide, one holds all pixels.
    from meadowline.functions.grid import Grid

    put_mask = lambda rows, name: tables.write_mask(spark.createDataFrame(rows, "row long, col long, mask int"), f"{root}/{name}", Grid("EPSG:4326", -0.25, 0.75, 0.5, 0.5))
    put_mask([(0, 0, 1), (1, 0, 1), (0, 1, 1), (1, 1, 0)], "coarse")
    (tmp_path / "c.toml").write_text(text.replace("[inference]", '[inference]\napplication_mask_path = "coarse"\napplication_mask_label = "open land"'))
    cli.main(["apply", str(tmp_path / "c.toml"), f"{root}/run", "--cache", f"{root}/cache", "--output", f"{root}/coarse_map"])
    coarse = spark.read.parquet(f"{root}/coarse_map/pixels").selectExpr("status", "(tile_col * 20 + local_col + 0.5) * 1000 AS x", "-(-(tile_row + 1) * 20 + local_row + 0.5) * 1000 AS y").toPandas()
    east, south = coarse.x > 0.25 * 111319.49 * 0.8676, coarse.y < 0.25 * 110574 * 1.1507
    assert set(coarse[east & south].status) == {0} and set(coarse[~(east & south)].status) == {2}
