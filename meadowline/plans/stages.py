"""The four stages: observations to pixels, pixels to a sample, the sample to models, models to scored pixels."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meadowline.functions.columns import INSUFFICIENT, OUTSIDE_AREA, OUTSIDE_TARGET, PREDICTED, all_defined, any_defined, in_reference_map, in_reference_sample, missing_count, similarity_class, status, target_pixels, usable
from meadowline.functions.grid import Grid, block_index, cylindrical_to_equal_earth, cylindrical_to_lonlat, global_row, pixel_centre, project, source_cell, tile_id
from meadowline.operators import folds, models, scoring, zones
from meadowline.operators.coverage import predictor_coverage, response_status
from meadowline.operators.sampling import priority, stratified_sample
from meadowline.operators.weighted import correlation, correlation_matrix, regression_metrics, weighted_quantiles, with_average_ranks
from meadowline.sources.config import Analysis
from meadowline.sources.scratch import kept

AREA = "area_weight_m2"


def locate(pixels: DataFrame, analysis: Analysis) -> DataFrame:
    """Pixel centres on the grid, their coordinates and their sampling block."""
    grid, block = analysis.section("grid"), analysis.section("sampling")["block_size_meters"]
    size, tile = float(grid["pixel_size_meters"]), int(grid["tile_size_pixels"])
    rows = pixels.withColumns({"row": global_row(F.col("tile_row"), F.col("local_row"), tile), "column": F.col("tile_col") * tile + F.col("local_col")})
    x, y = pixel_centre(F.col("row"), F.col("column"), grid["origin_x"], grid["origin_y"], size)
    rows = rows.withColumns({"x": x, "y": y})
    lon, lat = cylindrical_to_lonlat(F.col("x"), F.col("y"))
    ex, ey = cylindrical_to_equal_earth(F.col("x"), F.col("y"))
    return rows.withColumns({"longitude": lon, "latitude": lat, "block_col": block_index(ex, block), "block_row": block_index(ey, block), "cache_tile_id": tile_id(F.col("tile_col"), F.col("tile_row"))})


PIXEL = ("tile_col", "tile_row", "local_row", "local_col")


def area_index(area: DataFrame, analysis: Analysis) -> DataFrame:
    """Index of features, given in the grid's coordinates, by the grid's tiles."""
    grid = analysis.section("grid")
    dx, dy = float(grid["origin_x"]), float(grid["origin_y"])
    moved = F.transform("polygons", lambda p: F.transform(p, lambda ring: F.transform(ring, lambda q: F.struct((q.x - dx).alias("x"), (q.y - dy).alias("y")))))
    return zones.tile_index(area.withColumn("polygons", moved), float(grid["pixel_size_meters"]) * int(grid["tile_size_pixels"]))


def in_area(rows: DataFrame, index: DataFrame, analysis: Analysis, name: str | None = None) -> DataFrame:
    """Located pixels whose centre lies in the index's features; with ``name`` all of them and whether it does."""
    grid = analysis.section("grid")
    shifted = rows.withColumns({"_gx": F.col("x") - float(grid["origin_x"]), "_gy": F.col("y") - float(grid["origin_y"])})
    return zones.within(shifted, index, "_gx", "_gy", name).drop("_gx", "_gy")


def build_sample(pixels: DataFrame, analysis: Analysis, area: DataFrame) -> DataFrame:
    """At most the capped number of pixels of each class and block, with design weights. ``area``: features on the grid.

    Keys first: what is ranked and shuffled is the pixels' keys, strata and priorities. The bands of those that are chosen are
    read afterwards from their tiles alone, which are partitions of the cache."""
    bands = analysis.columns_with_role(pixels.columns, "response") | analysis.columns_with_role(pixels.columns, "predictor")
    reference = next(iter(analysis.columns_with_role(pixels.columns, "reference").values()))
    settings = analysis.section("sampling")
    there = pixels.select(*PIXEL, in_reference_sample(F.col(reference)).cast("short").alias("reference_site"), any_defined([F.col(c) for c in bands.values()]).alias("_any")).where("_any").drop("_any")
    rows = in_area(locate(there, analysis), area_index(area, analysis), analysis).select(*PIXEL, "block_col", "block_row", "cache_tile_id", "reference_site")
    rank = [priority(settings["random_seed"], F.col("cache_tile_id"), F.col("local_row"), F.col("local_col")), "tile_row", "tile_col", "local_row", "local_col"]
    chosen = kept(stratified_sample(rows, ["block_col", "block_row", "reference_site"], rank, settings["samples_per_class_per_block"]).drop("block_col", "block_row", "cache_tile_id"))
    tiles = chosen.where("sampled > 0").select("tile_col", "tile_row").distinct()  # with a condition on it Spark prunes partitions by this side
    fetched = pixels.drop(reference).join(tiles, ["tile_col", "tile_row"], "left_semi").join(chosen, list(PIXEL))
    pixel_area = float(analysis.section("grid")["pixel_size_meters"]) ** 2
    return locate(fetched, analysis).withColumns({"pixel_area_m2": F.lit(pixel_area), AREA: F.lit(pixel_area) * F.col("weight")}).withColumnsRenamed(
        {"available": "available_pixels_in_block_class", "sampled": "sampled_pixels_in_block_class", "probability": "sampling_probability", "weight": "sampling_weight", "block_col": "sampling_block_column", "block_row": "sampling_block_row"}
    )


def footprint(pixels: DataFrame, analysis: Analysis, area: DataFrame) -> DataFrame:
    """One row over the area's pixels: how many there are, those of either class that have any predictor or response and so can
    be sampled, and reference pixels left out for having none."""
    bands = analysis.columns_with_role(pixels.columns, "response") | analysis.columns_with_role(pixels.columns, "predictor")
    reference = next(iter(analysis.columns_with_role(pixels.columns, "reference").values()))
    flags = pixels.select(*PIXEL, in_reference_sample(F.col(reference)).alias("_ref"), any_defined([F.col(c) for c in bands.values()]).alias("_any"))
    rows = in_area(locate(flags, analysis), area_index(area, analysis), analysis)
    return rows.agg(
        F.count(F.lit(1)).alias("area_pixels"), F.count_if(F.col("_any") & ~F.col("_ref")).alias("background_pixels"), F.count_if(F.col("_any") & F.col("_ref")).alias("reference_pixels"), F.count_if(~F.col("_any") & F.col("_ref")).alias("excluded_reference_pixels")
    )


def completeness(sample: DataFrame, bands: Sequence[str]) -> DataFrame:
    """One row: sampled rows, those with every band, their percentage, and bands without any value."""
    complete = F.count_if(all_defined([F.col(b) for b in bands]))
    lost = sum((F.when(F.count(F.col(b)) == 0, 1).otherwise(0) for b in bands), F.lit(0))
    return sample.agg(F.count(F.lit(1)).alias("rows"), complete.alias("complete_rows"), F.try_divide(complete * 100.0, F.count(F.lit(1))).alias("complete_percent"), lost.alias("missing_bands"))


@dataclass
class Prepared:
    rows: DataFrame
    continuous: list[str]
    categorical: str
    coverage: list
    fold_count: int


def prepare(sample: DataFrame, analysis: Analysis) -> Prepared:
    """Folds, retained predictors and usable rows."""
    m, s = analysis.section("model"), analysis.section("sampling")
    predictors = analysis.columns_with_role(sample.columns, "predictor")
    found = {r.predictor: r for r in predictor_coverage(sample, list(predictors.values()), AREA).collect()}  # a row for each predictor
    coverage = [{**found[c].asDict(), "retained": (found[c].area_fraction or 0.0) >= m["minimum_predictor_coverage"]} for c in predictors.values()]
    kept = [c["predictor"] for c in coverage if c["retained"]]
    categorical = next(b.column(analysis.year) if b.column(analysis.year) in predictors.values() else predictors[b.id] for b in analysis.bands if b.role == "predictor" and b.data_type == "categorical")
    if categorical not in kept:
        raise ValueError("the categorical predictor has too little coverage")
    continuous = [c for c in kept if c != categorical]
    ratio = folds.block_ratio(m["validation_block_size_meters"], s["block_size_meters"])
    rows = folds.with_validation_blocks(sample, ratio)
    blocks = folds.validation_blocks(rows, F.col("reference_site") == 1, F.col(AREA))
    rows = folds.with_folds(rows, blocks, folds.assign_folds(blocks, m["fold_count"]))
    missing = missing_count([F.col(c) for c in kept])
    rows = rows.withColumns({"imputed_predictor_count": missing.cast("short"), "missing_predictor_fraction": missing / float(len(kept)), "usable_for_gam": usable([F.col(c) for c in kept], m["maximum_row_missing_fraction"])})
    return Prepared(rows, continuous, categorical, coverage, m["fold_count"])


def response_coverage(prepared: Prepared, analysis: Analysis, selected: Sequence[str] | None = None) -> DataFrame:
    """One row for each response: coverage, spread, least fold support, and whether it is fitted or why not."""
    m, rows = analysis.section("model"), prepared.rows
    responses = list(analysis.columns_with_role(rows.columns, "response").values())
    chosen = set(responses if selected is None else selected)
    return response_status(rows.where("usable_for_gam AND reference_site = 1"), responses, AREA, "spatial_fold", prepared.fold_count, chosen, m["minimum_response_coverage"])


@dataclass
class Fitted:
    scored: DataFrame
    models: list[models.ResponseModel]
    metrics: DataFrame


def fit(prepared: Prepared, analysis: Analysis, responses: Sequence[str]) -> Fitted:
    """Out-of-fold scores of all usable rows, and final models with their pooled error."""
    m = analysis.section("model")
    use = prepared.rows.where("usable_for_gam")
    settings = {"continuous": prepared.continuous, "categorical": prepared.categorical, "area": AREA, "knots": m["spline_knot_count"], "alpha": m["ridge_alpha"]}
    scored = models.cross_validate(use, "spatial_fold", prepared.fold_count, responses, reference=F.col("reference_site") == 1, **settings)
    expected = lambda r: F.col(f"{r}_expected_reference_oof")
    held = scored.where("reference_site = 1")
    rmse = held.agg(*(regression_metrics(F.col(r).cast("double"), expected(r), F.col(AREA))["rmse"].alias(r) for r in responses)).collect()[0]
    final = models.fit_models(use.where("reference_site = 1"), responses, **settings)
    for f in final:
        f.rmse = rmse[f.response]
    for r in responses:
        d = scoring.deviation(F.col(r).cast("double"), expected(r))
        scored = scored.withColumns({f"{r}_observed_minus_expected_oof": d, f"{r}_standardized_deviation_oof": scoring.standardised(d, rmse[r] or 0.0)})
    long = held.select("spatial_fold", AREA, F.explode(F.array(*(F.struct(F.lit(r).alias("response"), F.col(r).cast("double").alias("o"), expected(r).alias("e")) for r in responses))).alias("s")).select("spatial_fold", AREA, "s.*")
    ranked = with_average_ranks(long.where("o IS NOT NULL AND e IS NOT NULL"), ["response", "spatial_fold"], {"o": "ro", "e": "re"})
    numbers = regression_metrics(F.col("o"), F.col("e"), F.col(AREA)) | {"spearman": correlation(F.col("ro"), F.col("re"), F.col(AREA))}
    return Fitted(scored, final, ranked.groupBy("response", "spatial_fold").agg(*(c.alias(n) for n, c in numbers.items())))


def deviation_correlation(fitted: Fitted) -> DataFrame:
    """x, y, rows and correlation of the standardised deviations of all pairs of fitted responses, over all scored rows."""
    responses = [f.response for f in fitted.models]
    short = fitted.scored.select(AREA, *(F.col(f"{x}_standardized_deviation_oof").alias(x) for x in responses))
    return correlation_matrix(short, responses, AREA)


#: Points along a continuous predictor, between the weighted quantiles of the reference rows.
POINTS, SPAN = 100, (0.05, 0.95)


def partial_responses(prepared: Prepared, fitted: Sequence[models.ResponseModel]) -> DataFrame:
    """response, predictor, value, expected: the expectation along each predictor, the others at their imputed baseline, at a
    hundred points or at every category. The grid's size is models times predictors times points."""
    use = prepared.rows.where("usable_for_gam AND reference_site = 1")
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("predictor"), F.col(c).cast("double").alias("v")) for c in prepared.continuous))).alias("s")
    ends = {r.predictor: (r.q0, r.q1) for r in weighted_quantiles(use.select(AREA, each).select(AREA, "s.*"), ["predictor"], F.col("v"), F.col(AREA), SPAN).collect()} if prepared.continuous else {}
    rows = []
    for m in fitted:
        for c in (*prepared.continuous, prepared.categorical):
            if c == prepared.categorical:
                values = m.design.categories
            elif c not in ends:
                continue
            else:
                low, high = ends[c]
                values = [low] if math.isclose(low, high) else [low + (high - low) * i / (POINTS - 1) for i in range(POINTS)]
            rows += [(m.response, c, float(v), float(e)) for v, e in zip(values, models.partial_response(m, values, c))]
    return use.sparkSession.createDataFrame(rows, "response string, predictor string, value double, expected double")


def fold_rollup(metrics: DataFrame) -> DataFrame:
    """Mean, sample standard deviation and range over folds of each metric."""
    names = ("r2", "rmse", "mae", "bias", "spearman")
    return metrics.groupBy("response").agg(*(f(n).alias(f"{n}_{k}") for n in names for k, f in (("mean", F.avg), ("sd", F.stddev_samp), ("min", F.min), ("max", F.max))))


def with_mask(rows: DataFrame, mask: DataFrame, grid: Grid | None, analysis: Analysis, name: str) -> DataFrame:
    """Located pixels with the value of a mask: a pixel table of the same grid or, with ``grid``, a raster of another one, of which
    each pixel takes the cell that its centre lies in; NULL where the mask has none. A column of cells is what is joined, so a
    coarse mask, being small, is sent to the pixels."""
    if grid is None:
        return rows.join(mask.select(*PIXEL, F.col("mask").alias(name)), list(PIXEL), "left")
    x, y = project(F.col("x"), F.col("y"), analysis.section("grid")["crs"], grid.crs)
    row, col = source_cell(x, y, grid.left, grid.top, grid.width, grid.height)
    cells = mask.select(F.col("row").cast("long").alias("_mask_row"), F.col("col").cast("long").alias("_mask_col"), F.col("mask").alias(name))
    return rows.withColumns({"_mask_row": row, "_mask_col": col}).join(cells, ["_mask_row", "_mask_col"], "left").drop("_mask_row", "_mask_col")


def score_pixels(pixels: DataFrame, fitted: Sequence[models.ResponseModel], calibration: scoring.Calibration, distances: DataFrame, analysis: Analysis, area: DataFrame | None = None, mask: DataFrame | None = None, mask_grid: Grid | None = None) -> DataFrame:
    """All pixels with status, expectations, deviations, distance, percentile and similarity.

    ``area``: features on the grid. ``mask``: see ``with_mask``; where it is exactly 1 the area's pixels are targets, even those
    without a predictor. ``distances`` is the calibration's table. The models are small and travel with the plan; the pixels are
    not shuffled unless the area's index, the mask or the table of distances is too large to be sent to all tasks."""
    responses = [m.response for m in fitted]
    predictors = [*fitted[0].design.continuous, fitted[0].design.categorical]
    columns = [F.col(c) for c in predictors]
    names = pixels.columns
    if area is not None or mask_grid is not None:
        pixels = locate(pixels, analysis)
    if mask is not None:
        pixels = with_mask(pixels, mask, mask_grid, analysis, "_mask")
    pixels = pixels.withColumn("_inside", F.lit(True)) if area is None else in_area(pixels, area_index(area, analysis), analysis, "_inside")
    target = target_pixels(F.col("_inside"), columns, F.col("_mask") if mask is not None else None)
    enough = usable(columns, analysis.section("model")["maximum_row_missing_fraction"])
    rows = pixels.withColumn("target", target)
    rows = rows.withColumns({"missing_predictors": F.when(F.col("target"), missing_count(columns)), "status": status(F.col("_inside"), F.col("target"), enough)})
    reference = next(iter(analysis.columns_with_role(names, "reference").values()), None)
    if reference:
        rows = rows.withColumn("is_reference", F.col("_inside") & in_reference_map(F.col(reference)))
    rows = models.predict(rows.select(*names, "target", "missing_predictors", "status", *(["is_reference"] if reference else [])), fitted)
    on = F.col("status") == PREDICTED
    for m in fitted:
        d, z = scoring.map_deviation(F.col(m.response), F.col(f"{m.response}_expected"), m.rmse or 0.0)
        rows = rows.withColumns({f"{m.response}_deviation": F.when(on, d), f"{m.response}_z": F.when(on, z), f"{m.response}_expected": F.when(on, F.col(f"{m.response}_expected").cast("float"))})
    z = [F.col(f"{r}_z") for r in responses]
    rows = rows.withColumn("distance", F.when(all_defined(z), calibration.distance(z)))
    return scoring.with_percentile(rows, "distance", distances).withColumn("similarity", 1 - F.col("percentile"))


def status_counts(scored: DataFrame) -> DataFrame:
    """One row: pixels of the area, targets, those with too few predictors, predicted and imputed ones, and what is scored whole."""
    s = F.col("status")
    return scored.agg(
        F.count_if(s != OUTSIDE_AREA).alias("area"), F.count_if(s == OUTSIDE_TARGET).alias("outside_target"), F.count_if(s.isin(INSUFFICIENT, PREDICTED)).alias("target"),
        F.count_if(s == INSUFFICIENT).alias("insufficient"), F.count_if(s == PREDICTED).alias("predicted"), F.count_if((s == PREDICTED) & (F.col("missing_predictors") > 0)).alias("imputed"),
        F.count("distance").alias("scored"),
    )


def response_summary(scored: DataFrame, responses: Sequence[str]) -> DataFrame:
    """One row for each response: what ``score_pixels`` expected and scored, and how the standardised deviations lie."""
    each = F.array(*(F.struct(F.lit(x).alias("response"), F.col(f"{x}_z").cast("double").alias("z"), F.col(f"{x}_expected").alias("e")) for x in responses))
    rows = scored.select(F.explode(each).alias("s")).select("s.*")
    return rows.groupBy("response").agg(*(c.alias(n) for n, c in scoring.response_statistics(F.col("z"), F.col("e")).items()))


def class_areas(scored: DataFrame, pixel_area: float) -> DataFrame:
    """Pixels, area and share of each similarity class."""
    counts = scored.where("percentile IS NOT NULL").groupBy(similarity_class(F.col("percentile")).alias("class")).agg(F.count(F.lit(1)).alias("pixels"))
    total = counts.agg(F.sum("pixels").alias("_all"))  # one row
    return counts.join(F.broadcast(total)).select("class", "pixels", (F.col("pixels") * float(pixel_area)).alias("area_m2"), (F.col("pixels") / F.col("_all")).alias("share"))
