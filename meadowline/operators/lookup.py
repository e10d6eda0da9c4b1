"""Values of pixels at given points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meadowline.functions.grid import pixel_at


def point_values(points: DataFrame, x: Column, y: Column, pixels: DataFrame, bands: Sequence[str], left: float, top: float, pixel: float, digits: int = 2) -> DataFrame:
    """Each point with row and col of the pixel it lies in and that pixel's rounded bands, NULL where there is no such pixel.

    An equality join on row and col, of which ``pixels`` has one row each; which side is small is Spark's to find out."""
    row, col = pixel_at(x, y, left, top, pixel)
    values = pixels.select("row", "col", *(F.round(b, digits).alias(b) for b in bands))
    return points.withColumns({"row": row, "col": col}).join(values, ["row", "col"], "left")
