"""Identity of inputs and runs: fingerprints, whether a run can go on, and a log of what was done."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meadowline.operators.models import ResponseModel
from meadowline.operators.scoring import Calibration
from meadowline.sources.config import Analysis, digest


def tile_set_fingerprint(manifest: DataFrame) -> str:
    """Of the tiles and their contents, in grid order: first of each row of tiles, then of the rows."""
    row = F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("tile_col", "sha"))), lambda t: F.concat_ws(":", t.tile_col.cast("string"), t.sha)), ","), 256)
    rows = manifest.groupBy("tile_row").agg(row.alias("h"))
    return digest([(r.tile_row, r.h) for r in rows.orderBy("tile_row").collect()])  # one line for each row of tiles


def content_fingerprint(df: DataFrame) -> str:
    """Of a table's rows, in any order: their number and two sums of hashes."""
    whole = F.struct(*sorted(df.columns))
    h = lambda seed: F.sum(F.xxhash64(F.lit(seed), F.to_json(whole)).cast("decimal(38,0)"))
    r = df.agg(F.count(F.lit(1)).alias("n"), h(1).alias("a"), h(2).alias("b")).collect()[0]
    return digest([r.n, str(r.a), str(r.b)])


def inference_fingerprint(analysis: Analysis, tiles: str, models: Sequence[ResponseModel], calibration: Calibration, distances: str, mask: str | None = None) -> str:
    """Of all that changes scored pixels; worker and window settings do not. Distances, area and mask count by their content."""
    return digest({"distances": distances, "raster": analysis.raster_fingerprint(), "tiles": tiles, "models": [m.to_json() for m in models], "calibration": calibration.to_json(), "mask": mask, "missing": analysis.section("model")["maximum_row_missing_fraction"]})


def done_tiles(spark: SparkSession, output: str, fingerprint: str, columns: Sequence[str]) -> DataFrame | None:
    """Tiles that an earlier run of the same fingerprint and columns has left, or None if there is nothing to go on from."""
    try:
        kept = [r.value for r in spark.read.text(f"{output}/fingerprint").collect()]
        pixels = spark.read.parquet(f"{output}/pixels")
    except AnalysisException:
        return None
    if kept != [fingerprint] or set(columns) - set(pixels.columns):
        return None
    return pixels.select("tile_col", "tile_row").distinct()


def start_run(spark: SparkSession, output: str, fingerprint: str) -> None:
    spark.createDataFrame([(fingerprint,)], "value string").coalesce(1).write.mode("overwrite").text(f"{output}/fingerprint")


def log_event(spark: SparkSession, path: str, **event) -> None:
    """One more row of the history, with the time in UTC."""
    now = datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds")
    spark.createDataFrame([(now, {k: str(v) for k, v in event.items()})], "at string, event map<string,string>").coalesce(1).write.mode("append").parquet(path)
