"""Distance to the nearest flagged cell of a grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def nearest_flagged(cells: DataFrame, flag: str, row: str = "row", col: str = "col", pixel: float = 1.0) -> DataFrame:
    """Cells with ``distance`` to the nearest flagged one (Euclidean, in pixels times ``pixel``); NULL where there is none.

    Exact in two one-dimensional passes, without pairing cells with all others. First the gap to the nearest flagged cell of
    the same column is found by running windows. Then a row's cells need the minimum over the row of (gap^2 + offset^2),
    which is a lower envelope of parabolas: those that attain it anywhere are few, and are found for each row."""
    up = W.partitionBy(col).orderBy(row).rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy(col).orderBy(F.desc(row)).rowsBetween(W.unboundedPreceding, 0)
    mark = F.when(F.col(flag), F.col(row))
    gaps = cells.withColumns({"_a": F.max(mark).over(up), "_b": F.min(mark).over(down)}).withColumn("_gap", F.least(F.col(row) - F.col("_a"), F.col("_b") - F.col(row)).cast("double"))
    kept = [c for c in cells.columns]

    def envelope(pdf):
        import numpy as np

        pdf = pdf.sort_values(col)
        x, g = pdf[col].to_numpy(float), pdf["_gap"].to_numpy(float)
        ok = ~np.isnan(g)
        if not ok.any():
            return pdf.assign(distance=np.nan)[[*kept, "distance"]]
        v, f = x[ok], g[ok] ** 2
        hull, starts = [0], [-np.inf]
        for i in range(1, len(v)):
            while True:
                k = hull[-1]
                s = ((f[i] + v[i] ** 2) - (f[k] + v[k] ** 2)) / (2 * (v[i] - v[k]))
                if s > starts[-1] or len(hull) == 1:
                    break
                hull.pop()
                starts.pop()
            if s <= starts[-1]:
                hull, starts = [i], [-np.inf]
            else:
                hull.append(i)
                starts.append(s)
        pick = np.array(hull)[np.searchsorted(np.array(starts), x, side="right") - 1]
        return pdf.assign(distance=np.sqrt((x - v[pick]) ** 2 + f[pick]) * pixel)[[*kept, "distance"]]

    schema = gaps.select(*kept).withColumn("distance", F.lit(0.0)).schema
    schema["distance"].nullable = True
    return gaps.groupBy(row).applyInPandas(envelope, schema)
