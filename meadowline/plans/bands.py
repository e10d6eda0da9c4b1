"""The registry of band computations: dated observations to one wide row per pixel.

A source is a DataFrame with ``pixel`` and, unless it is static, ``ts``, and its bands as columns. Each computation gives
``pixel`` and ``value``. Computations that aggregate the same source over the same period are merged into one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meadowline.functions.columns import day_of_year_offset, self_mask, strict_and, valid
from meadowline.operators import temporal
from meadowline.operators.distance import nearest_flagged
from meadowline.sources.config import Analysis

Sources = Mapping[str, DataFrame]


@dataclass(frozen=True)
class Aggregate:
    """A reduction over the analysis year's observations of one source."""

    source: str
    make: Callable[[], Column]
    season: bool = False


@dataclass(frozen=True)
class First:
    """An expression on the year's first image of a source."""

    source: str
    make: Callable[[Analysis], Column]


@dataclass(frozen=True)
class Static:
    source: str
    make: Callable[[], Column]


@dataclass(frozen=True)
class Custom:
    make: Callable[[Sources, Analysis], DataFrame]


def _v(name: str) -> Column:
    return valid(F.col(name).cast("double"))


def _percentile(name: str, p: float) -> Callable[[], Column]:
    return lambda: F.percentile(_v(name), F.lit(p))


def _season_days(cycle: int) -> Callable[[Analysis], Column]:
    return lambda a: _v(f"Senescence_{cycle}") - _v(f"Greenup_{cycle}")


def _greenup(cycle: int) -> Callable[[Analysis], Column]:
    return lambda a: day_of_year_offset(_v(f"Greenup_{cycle}"), a.year)


def _reference_sites(sources: Sources, a: Analysis) -> DataFrame:
    """1 where grassland persists under low influence and modification, else NULL."""
    first, last, limits = a.section("stack")["reference_start_year"], a.section("stack")["reference_end_year"], a.section("reference")

    def persistent(source: str, x: Column, test: Callable[[Column], Column], name: str) -> DataFrame:
        yearly = temporal.in_years(sources[source], "ts", first, last).groupBy("pixel", F.year("ts").alias("year")).agg(x.alias("x"))
        return temporal.never_fails_twice(yearly.where("x IS NOT NULL"), ["pixel"], "year", test(F.col("x"))).select("pixel", (F.col("persistent") == 1).alias(name))

    probability = persistent("grassland_probability", F.avg(_v("probability")), lambda x: x >= limits["grassland_probability"], "grass")
    influence = persistent("human_influence", F.avg(_v("hii")) / 7000, lambda x: x < limits["human_influence"], "calm")
    modification = sources["human_modification"].select("pixel", (_v("constant") <= limits["human_modification"]).alias("wild"))
    joined = probability.join(influence, "pixel").join(modification, "pixel")
    keep = strict_and(strict_and(F.col("grass"), F.col("calm")), F.col("wild"))
    return joined.select("pixel", self_mask(keep.cast("int").cast("double")).alias("value"))


def _rain_variation(sources: Sources, a: Analysis) -> DataFrame:
    s = a.section("stack")
    daily = sources["era5_daily"].withColumn("year", F.year("ts"))
    return temporal.variation_of_totals(daily, ["pixel"], "year", _v("total_precipitation"), a.year, s["interannual_rainfall_window_years"], s["era5_start_year"]).select("pixel", F.col("cv_percent").alias("value"))


def _stream_distance(sources: Sources, a: Analysis) -> DataFrame:
    limit = a.section("stack")["stream_upstream_area_threshold_km2"]
    cells = sources["merit_hydro"].withColumn("_stream", F.coalesce(_v("upa") >= limit, F.lit(False)))
    return nearest_flagged(cells.select("pixel", "row", "col", "_stream"), "_stream", pixel=float(a.section("grid")["pixel_size_meters"])).select("pixel", F.col("distance").alias("value"))


def _smap_snow(sources: Sources, a: Analysis) -> DataFrame:
    year = temporal.in_years(sources["smap"], "ts", a.year)
    return temporal.positive_mean_by_month(year, ["pixel"], "ts", _v("snow_depth")).select("pixel", F.col("positive_mean").alias("value"))


#: Computation by name, as definitions refer to it (the names are fixed values). More can be added under new names.
REGISTRY: dict[str, Aggregate | First | Static | Custom] = {
    "grassland_reference_sites": Custom(_reference_sites),
    "ndvi_95th_percentile": Aggregate("landsat_ndvi", _percentile("NDVI", 0.95)),
    "ndvi_median": Aggregate("landsat_ndvi", _percentile("NDVI", 0.5)),
    "growing_season_length_1": First("modis_phenology", _season_days(1)),
    "growing_season_length_2": First("modis_phenology", _season_days(2)),
    "greenup_timing_1": First("modis_phenology", _greenup(1)),
    "greenup_timing_2": First("modis_phenology", _greenup(2)),
    "short_vegetation_height": First("short_vegetation_height", lambda a: _v("height") * 0.1),
    "tree_cover": First("modis_vegetation_cover", lambda a: _v("Percent_Tree_Cover")),
    "non_tree_vegetation_cover": First("modis_vegetation_cover", lambda a: _v("Percent_NonTree_Vegetation")),
    "bare_ground": First("modis_vegetation_cover", lambda a: _v("Percent_NonVegetated")),
    "maximum_lai": Aggregate("modis_lai_fpar", lambda: F.max(_v("Lai_500m") * 0.1)),
    "lai_variability": Aggregate("modis_lai_fpar", lambda: F.stddev_pop(_v("Lai_500m") * 0.1)),
    "mean_fpar": Aggregate("modis_lai_fpar", lambda: F.avg(_v("Fpar_500m") * 0.01)),
    "fpar_variability": Aggregate("modis_lai_fpar", lambda: F.stddev_pop(_v("Fpar_500m") * 0.01)),
    "maximum_fpar_variability": Aggregate("modis_lai_fpar", lambda: F.max(_v("FparStdDev_500m") * 0.01)),
    "growing_season_count": First("modis_phenology", lambda a: _v("NumCycles")),
    "npp": First("modis_productivity", lambda a: _v("Npp") * 0.0001),
    "gpp": First("modis_productivity", lambda a: _v("Gpp") * 0.0001),
    "maximum_annual_temperature": Aggregate("era5_daily", lambda: F.max(_v("maximum_2m_air_temperature")) - 273.15),
    "mean_annual_temperature": Aggregate("era5_monthly", lambda: F.avg(_v("mean_2m_air_temperature")) - 273.15),
    "median_annual_temperature": Aggregate("era5_monthly", lambda: F.median(_v("mean_2m_air_temperature")) - 273.15),
    "minimum_annual_temperature": Aggregate("era5_daily", lambda: F.min(_v("minimum_2m_air_temperature")) - 273.15),
    "annual_precipitation": Aggregate("era5_daily", lambda: F.sum(_v("total_precipitation")) * 1000),
    "growing_season_temperature": Aggregate("era5_daily", lambda: F.avg(_v("mean_2m_air_temperature")) - 273.15, season=True),
    "growing_season_precipitation": Aggregate("era5_daily", lambda: F.avg(_v("total_precipitation")) * 1000, season=True),
    "interannual_rainfall_variability": Custom(_rain_variation),
    "mean_drought": Aggregate("gridmet_drought", lambda: F.avg(_v("spi30d"))),
    "drought_fifth_percentile": Aggregate("gridmet_drought", _percentile("spi30d", 0.05)),
    "burned_month_count": Aggregate("viirs_burned_area", lambda: temporal.months_with(_v("Burn_Date") > 0)),
    "water_presence_variation": Aggregate("jrc_monthly_water", lambda: temporal.indicator_stddev(_v("water"), 2)),
    "distance_to_streams": Custom(_stream_distance),
    "soil_organic_carbon": Static("isric_soil_organic_carbon", lambda: _v("soc") / 10),
    "soil_moisture": Aggregate("gldas", lambda: F.avg(_v("SoilMoi0_10cm_inst"))),
    "landform_type": Static("srtm_landforms", lambda: _v("constant")),
    "topographic_diversity": Static("alos_topographic_diversity", lambda: _v("constant")),
    "annual_evapotranspiration": Aggregate("modis_evapotranspiration", lambda: F.sum(_v("ET") * 0.1)),
    "gldas_snow_depth": Aggregate("gldas", lambda: temporal.positive_mean(_v("SnowDepth_inst"))),
    "smap_snow_depth": Custom(_smap_snow),
}


def build_stack(spine: DataFrame, sources: Sources, analysis: Analysis, registry: Mapping[str, Aggregate | First | Static | Custom] = REGISTRY) -> DataFrame:
    """``pixel`` and one float column per band of the definition, in its order, for every pixel of the spine.

    All partial results are keyed by pixel, so their joins can share one partitioning."""
    unknown = sorted({b.computation for b in analysis.bands} - set(registry))
    if unknown:
        raise KeyError(f"no such computations: {', '.join(unknown)}")
    plans = [(b.column(analysis.year), registry[b.computation]) for b in analysis.bands]
    parts: list[DataFrame] = []
    year = analysis.year
    passes: dict[tuple, list[tuple[str, Column]]] = {}
    for name, p in plans:
        if isinstance(p, Aggregate):
            passes.setdefault(("aggregate", p.source, p.season), []).append((name, p.make()))
        elif isinstance(p, First):
            passes.setdefault(("first", p.source, False), []).append((name, p.make(analysis)))
        elif isinstance(p, Static):
            parts.append(sources[p.source].select("pixel", p.make().alias(name)))
        else:
            parts.append(p.make(sources, analysis).select("pixel", F.col("value").alias(name)))
    for (kind, source, season), columns in passes.items():
        df = temporal.in_years(sources[source], "ts", year)
        if kind == "first":
            bands = [c for c in df.columns if c not in ("pixel", "ts", "image_id")]
            tie = "image_id" if "image_id" in df.columns else "ts"
            first = df.groupBy("pixel").agg(F.min_by(F.struct(*bands), F.struct("ts", tie)).alias("_i")).select("pixel", "_i.*")
            parts.append(first.select("pixel", *(c.alias(n) for n, c in columns)))
            continue
        if season:
            days = lambda c: F.col(c).cast("double")
            phenology = temporal.in_years(sources["modis_phenology"], "ts", year).groupBy("pixel").agg(F.min_by(F.struct("Greenup_1", "Senescence_1"), "ts").alias("_s"))
            seasons = phenology.select("pixel", days("_s.Greenup_1").alias("_from"), days("_s.Senescence_1").alias("_to"))
            df = temporal.in_season(df.withColumn("_day", F.datediff("ts", F.lit("1970-01-01"))), seasons, ["pixel"], "_day", "_from", "_to")
        parts.append(df.groupBy("pixel").agg(*(c.alias(n) for n, c in columns)))
    wide = reduce(lambda a, b: a.join(b, "pixel", "left"), parts, spine)
    return wide.select(*spine.columns, *(F.col(n).cast("float").alias(n) for n, _ in plans))
