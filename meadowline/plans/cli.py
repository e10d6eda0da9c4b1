"""``python -m meadowline STAGE definition.toml ...``: the stages from the command line."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meadowline.functions.columns import SIMILARITY_LIMITS, binary_mask, similarity_class
from meadowline.functions.grid import display_cell, global_row, tile_id
from meadowline.operators.sampling import class_summary, dense_block_numbers, scan_statistics
from meadowline.operators.scoring import Calibration, calibrate, cell_spread, display_summary, mean_abs, percentile_statistics
from meadowline.operators.weighted import ecdf_quantiles
from meadowline.operators.zones import polygon_tiles
from meadowline.plans.bands import build_stack
from meadowline.plans.report import report
from meadowline.plans.stages import AREA, area_index, build_sample, class_areas, completeness, deviation_correlation, fit, fold_rollup, footprint, partial_responses, prepare, response_coverage, response_summary, score_pixels, status_counts
from meadowline.sources.config import digest, load_analysis
from meadowline.sources.provenance import content_fingerprint, done_tiles, inference_fingerprint, log_event, start_run, tile_set_fingerprint
from meadowline.sources.scratch import kept
from meadowline.sources.tables import MANIFEST, cached_pixels, check_cache, check_tiles, file_digests, manifest_of, newest, read_features, read_mask, read_models, read_pixels, sound_tiles, tile_files, write_models, write_pixels, write_with_provenance


def _text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _area(spark: SparkSession, path: str, analysis) -> DataFrame:
    return read_features(spark, path, analysis.section("grid")["crs"])


def _csv(small: DataFrame, path: str) -> None:
    small.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def fetch(spark: SparkSession, a) -> None:
    """Pixels of the tiles that the area needs and the cache lacks, from tables of dated observations."""
    analysis = load_analysis(a.definition)
    size = float(analysis.section("grid")["pixel_size_meters"]) * int(analysis.section("grid")["tile_size_pixels"])
    required, stack = kept(polygon_tiles(area_index(_area(spark, a.area, analysis), analysis), size)), analysis.stack_id()
    root = f"{a.cache}/{stack}"
    cache, bands = f"{root}/tiles", analysis.band_names()
    check_cache(spark, root, analysis)
    known = newest(_or_empty(spark, f"{root}/manifest", f"{MANIFEST}, written timestamp"))
    # What is in the cache is told by its files' contents, before any of them is taken for Parquet.
    sound = sound_tiles(known.where(F.col("stack") == stack), tile_files(spark, cache, required), bands) if not a.refresh else known.limit(0)
    todo = required.join(sound.select("tile_col", "tile_row"), ["tile_col", "tile_row"], "left_anti")
    todo = kept(dense_block_numbers(todo, ["tile_row", "tile_col"], "number").select("tile_col", "tile_row", F.floor((F.col("number") - 1) / TILES_PER_BATCH).cast("int").alias("batch")))
    total, batches = todo.agg(F.count(F.lit(1)), F.coalesce(F.max("batch") + 1, F.lit(0))).collect()[0]
    sources = {name: spark.read.parquet(f"{a.sources}/{name}") for name in analysis.section("datasets")}
    made, asked = 0, {"required": required.count(), "todo": total}
    for number in range(batches):  # a batch that fails leaves those before it in the cache
        mine = todo.where(F.col("batch") == number).select("tile_col", "tile_row")
        try:
            spine = spark.read.parquet(f"{a.sources}/spine").join(F.broadcast(mine), ["tile_col", "tile_row"], "left_semi")
            write_pixels(build_stack(spine, sources, analysis), cache)
            fresh = manifest_of(cached_pixels(spark, cache, bands, mine), stack, bands).join(file_digests(tile_files(spark, cache, mine)), ["tile_col", "tile_row"], "left")
            fresh.withColumn("written", F.current_timestamp()).write.mode("append").parquet(f"{root}/manifest")
        except Exception as e:
            first = [r.t for r in mine.orderBy(F.desc("tile_row"), "tile_col").limit(LOGGED_TILES).select(tile_id(F.col("tile_col"), F.col("tile_row")).alias("t")).collect()]
            log_event(spark, f"{root}/requests", **asked, made=made, failed=mine.count(), failed_tiles=",".join(first), error=type(e).__name__, message=str(e)[:500])
            raise RuntimeError(f"{mine.count()} tiles failed; tiles that are done stay in the cache, the same command goes on from there") from e
        made += mine.count()
    log_event(spark, f"{root}/requests", **asked, made=made, failed=0)
    check_tiles(required, cached_pixels(spark, cache, bands, required), newest(spark.read.parquet(f"{root}/manifest")), stack, bands)


#: Tiles that are made by one job, and ids of failed ones that a log entry names.
TILES_PER_BATCH, LOGGED_TILES = 16_384, 100


def _or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def sample(spark: SparkSession, a) -> None:
    analysis = load_analysis(a.definition)
    pixels = read_pixels(spark, f"{a.cache}/{analysis.stack_id()}/tiles")
    area = _area(spark, a.area, analysis)
    made = build_sample(pixels, analysis, area)
    write_with_provenance(made, a.output, {"analysis": analysis.fingerprint(), "raster": analysis.raster_fingerprint(), "seed": analysis.section("sampling")["random_seed"]})
    rows = spark.read.parquet(a.output)
    bands = [c for c in rows.columns if c in analysis.band_names()]
    weights = rows.withColumnsRenamed({"sampling_weight": "weight", "sampling_block_column": "block_col", "sampling_block_row": "block_row"})
    sections = {
        "Footprint": footprint(pixels, analysis, area), "Classes": class_summary(weights, "reference_site", F.col("pixel_area_m2")),
        "Rows complete across every band": completeness(rows, bands), "Bands": scan_statistics(rows, bands, F.col(AREA)),
    }
    for name, small in zip(("footprint", "classes", "completeness", "bands"), sections.values()):
        _csv(small, f"{a.output}.{name}")
    _text(spark, report("Spatial sample", sections), f"{a.output}.report")


def fit_models(spark: SparkSession, a) -> None:
    analysis = load_analysis(a.definition)
    prepared = prepare(spark.read.parquet(a.sample), analysis)
    wanted = analysis.resolve_responses(prepared.rows.columns, a.responses or analysis.section("model")["responses"])
    coverage = response_coverage(prepared, analysis, wanted)
    fitted = fit(prepared, analysis, [r.response for r in coverage.where("status = 'fit'").select("response").collect()])
    write_with_provenance(fitted.scored, f"{a.output}/scored", {"analysis": analysis.fingerprint()})
    write_models(spark, fitted.models, f"{a.output}/models")
    predictors = spark.createDataFrame(prepared.coverage, "predictor string, rows long, row_fraction double, area double, area_fraction double, retained boolean")
    matrix, rollup = kept(deviation_correlation(fitted)), fold_rollup(fitted.metrics)
    tables = {"predictor_coverage": predictors, "response_coverage": coverage, "fold_metrics": fitted.metrics, "response_metrics": rollup, "deviation_correlation": matrix, "partial_responses": partial_responses(prepared, fitted.models)}
    for name, small in tables.items():
        _csv(small, f"{a.output}/{name}")
    counts = prepared.rows.agg(F.count(F.lit(1)).alias("sampled_rows"), F.count_if("usable_for_gam").alias("usable_rows"), F.count_if(F.col("reference_site") == 1).alias("reference_rows"), F.count_distinct("validation_block_id").alias("validation_blocks")).collect()[0].asDict()
    record = counts | {"analysis": analysis.fingerprint(), "selected_responses": wanted, "fitted_responses": [m.response for m in fitted.models], "retained_predictors": [*prepared.continuous, prepared.categorical], "excluded_predictors": [c["predictor"] for c in prepared.coverage if not c["retained"]], "artifacts": sorted(tables)}
    _text(spark, json.dumps(record, sort_keys=True), f"{a.output}/metadata")
    strongest = matrix.where("x < y AND correlation IS NOT NULL").orderBy(F.desc(F.abs("correlation")), "x", "y").limit(10)
    _text(spark, report("Reference-condition models", {"Responses": coverage, "Folds": rollup, "Predictors": predictors, "Strongest correlations of deviations": strongest}), f"{a.output}/report")


def apply_models(spark: SparkSession, a) -> None:
    analysis = load_analysis(a.definition)
    models, scored = read_models(spark, f"{a.run}/models"), spark.read.parquet(f"{a.run}/scored")
    z = [f"{m.response}_standardized_deviation_oof" for m in models]
    c, table = calibrate(scored.where("reference_site = 1"), z, AREA, analysis.section("inference")["covariance_shrinkage"])
    calibration = Calibration(**(c.__dict__ | {"responses": [m.response for m in models]}))
    table.write.mode("overwrite").parquet(f"{a.output}.distances")
    distances = spark.read.parquet(f"{a.output}.distances")
    pixels = read_pixels(spark, f"{a.cache}/{analysis.stack_id()}/tiles")
    tiles = tile_set_fingerprint(newest(spark.read.parquet(f"{a.cache}/{analysis.stack_id()}/manifest")))
    area, applied = (_area(spark, a.area, analysis) if a.area else None), analysis.section("inference").get("application_mask_path")
    only, grid = read_mask(spark, applied if "://" in applied else f"file://{analysis.path(applied)}") if applied else (None, None)
    limits = digest({"area": content_fingerprint(area.select(F.to_json("polygons").alias("p"))) if a.area else None, "mask": content_fingerprint(only) if applied else None, "grid": grid.__dict__ if grid else None})
    run = inference_fingerprint(analysis, tiles, models, calibration, content_fingerprint(distances), limits)
    score = lambda rows: score_pixels(rows, models, calibration, distances, analysis, area=area, mask=only, mask_grid=grid)
    out = score(pixels)
    done = done_tiles(spark, a.output, run, out.columns)
    if done is None:
        start_run(spark, a.output, run)
    else:  # go on from the tiles that are there
        out = score(pixels.join(done, ["tile_col", "tile_row"], "left_anti"))
    write_pixels(out, f"{a.output}/pixels")
    log_event(spark, f"{a.output}/history", stage="apply", fingerprint=run, resumed=done is not None)
    _text(spark, calibration.to_json(), f"{a.output}/calibration")
    result = spark.read.parquet(f"{a.output}/pixels")
    stats = result.agg(*(x.alias(n) for n, x in percentile_statistics(F.col("percentile")).items()))
    responses = response_summary(result, [m.response for m in models])
    classes = class_areas(result, float(analysis.section("grid")["pixel_size_meters"]) ** 2)
    counts, quantiles = status_counts(result), ecdf_quantiles(distances, "distance", "fraction", (0.5, 0.9, 0.95, 0.99))
    grid_cells = _display(result, analysis, models)
    grid_cells.write.mode("overwrite").parquet(f"{a.output}/display")
    spread = cell_spread(spark.read.parquet(f"{a.output}/display"))
    for name, small in (("response_statistics", responses), ("classes", classes), ("status", counts), ("distance_quantiles", quantiles), ("display_spread", spread)):
        _csv(small, f"{a.output}/{name}")
    _text(spark, report("Departure from the reference condition", {"Status": counts, "Percentile": stats, "Reference distances": quantiles, "Covariance": f"Condition number {calibration.condition:.6g}, {calibration.shrunken_condition:.6g} after shrinkage", "Responses": responses, "Classes": classes, "Display grid": spread}), f"{a.output}/report")


#: Cells of the display grid along its longer side, at most.
DISPLAY = 700


def _display(scored: DataFrame, analysis, models) -> DataFrame:
    """Mean absolute deviation and most frequent similarity class by cells of a coarser grid over the scored pixels."""
    tile = int(analysis.section("grid")["tile_size_pixels"])
    rows = scored.withColumns({"_row": global_row(F.col("tile_row"), F.col("local_row"), tile), "_col": F.col("tile_col") * tile + F.col("local_col")})
    top, bottom, left, right = rows.agg(F.min("_row"), F.max("_row"), F.min("_col"), F.max("_col")).collect()[0]
    high, wide = bottom - top + 1, right - left + 1
    scale = max(1, -(-max(high, wide) // DISPLAY))
    row, col = display_cell(F.col("_row") - top, F.col("_col") - left, high, wide, -(-high // scale), -(-wide // scale))
    return display_summary(rows, row, col, mean_abs([F.col(f"{m.response}_z").cast("double") for m in models]), similarity_class(F.col("percentile")), len(SIMILARITY_LIMITS) + 1)


def mask(spark: SparkSession, a) -> None:
    """A 0/1 layer from a comparison such as ``>=80``."""
    rows = spark.read.parquet(a.input)
    keys = [c for c in rows.columns if c != a.band]
    rows.select(*keys, binary_mask(F.col(a.band), a.comparison).alias("mask")).write.mode("overwrite").parquet(a.output)
    back = spark.read.parquet(a.output)
    if back.where("mask NOT IN (0, 1) OR mask IS NULL").take(1):
        raise OSError("the mask holds other values than 0 and 1")
    print(json.dumps({str(r["mask"]): r["count"] for r in back.groupBy("mask").count().collect()}))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="python -m meadowline")
    stages = p.add_subparsers(dest="stage", required=True)

    def stage(name: str, run, *options: str, **flags) -> argparse.ArgumentParser:
        s = stages.add_parser(name, help=(run.__doc__ or name).strip().splitlines()[0])
        for o in options:
            s.add_argument(o, **({"required": True} if o.startswith("--") else {}))
        s.set_defaults(handler=run)
        return s

    stage("fetch", fetch, "definition", "--area", "--sources", "--cache").add_argument("--refresh", action="store_true")
    stage("sample", sample, "definition", "--area", "--cache", "--output")
    stage("fit", fit_models, "definition", "sample", "--output").add_argument("--responses", nargs="*", default=[])
    stage("apply", apply_models, "definition", "run", "--cache", "--output").add_argument("--area")
    stage("mask", mask, "input", "output", "band", "comparison")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"meadowline-{a.stage}").getOrCreate()
    a.handler(spark, a)
