"""Deviation from the expected condition, multivariate distance, its percentile among reference sites, and map summaries."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meadowline.operators.weighted import asof, covariance, ecdf


def deviation(observed: Column, expected: Column) -> Column:
    return observed - expected


def standardised(d: Column, rmse: float) -> Column:
    return d / F.lit(float(rmse)) if rmse > 0 else F.lit(None).cast("double")


def map_deviation(observed: Column, expected: Column, rmse: float) -> tuple[Column, Column]:
    """As maps hold them: the expectation is rounded to 32 bits first, and so are the results."""
    d = (observed.cast("double") - expected.cast("float").cast("double")).cast("float")
    return d, standardised(d.cast("double"), rmse).cast("float")


@dataclass
class Calibration:
    """Mean and precision of the reference sites. The distribution of their distances is a table of its own."""

    responses: list[str]
    mean: list[float]
    covariance: list[list[float]]
    precision: list[list[float]]
    rows: int
    weight: float
    condition: float
    shrunken_condition: float

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Calibration:
        return cls(**json.loads(text))

    def distance(self, z: Sequence[Column]) -> Column:
        """sqrt(max((z - m)' P (z - m), 0)) as one unrolled expression; NULL when a response is missing."""
        c = [x.cast("double") - F.lit(m) for x, m in zip(z, self.mean)]
        terms = [c[i] * c[j] * F.lit(self.precision[i][j] * (1 if i == j else 2)) for i in range(len(c)) for j in range(i + 1)]
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        return F.when(total.isNotNull(), F.sqrt(F.greatest(total, F.lit(0.0))))  # greatest() alone would pass over a NULL


def centre(reference: DataFrame, responses: Sequence[str], weight: str, shrinkage: float = 0.1) -> Calibration:
    """Mean and shrunken precision of the reference rows: enough for distances."""
    w = F.col(weight)
    r = covariance(reference, responses, w).collect()[0]
    k = len(responses)
    if r["rows"] <= k:
        raise ValueError("the calibration needs more complete reference rows than responses")
    mean = [r[f"m_{x}"] for x in responses]
    c = np.array([[r[f"c_{responses[max(i, j)]}_{responses[min(i, j)]}"] for j in range(k)] for i in range(k)])
    if not (np.isfinite(c).all() and (np.diag(c) > 0).all()):
        raise ValueError("each response needs a positive variance among the reference rows")
    shrunken = (1 - shrinkage) * c + shrinkage * np.diag(np.diag(c))
    condition = lambda m: float(np.linalg.cond(m))
    return Calibration(list(responses), mean, c.tolist(), np.linalg.inv(shrunken).tolist(), r["rows"], r["weight"], condition(c), condition(shrunken))


def calibrate(reference: DataFrame, responses: Sequence[str], weight: str, shrinkage: float = 0.1) -> tuple[Calibration, DataFrame]:
    """The calibration, and the distances of the complete reference rows as a table: distance and fraction, the share of the
    weight at distances of at most this one."""
    w, out = F.col(weight), centre(reference, responses, weight, shrinkage)
    complete = reference.where(" AND ".join(f"`{x}` IS NOT NULL" for x in responses))
    return out, ecdf(complete.select(out.distance([F.col(x) for x in responses]).alias("distance"), w.alias(weight)), "distance", w)


def with_percentile(df: DataFrame, distance: str, table: DataFrame, name: str = "percentile") -> DataFrame:
    """Each row with the share of the reference weight at distances of at most its own."""
    out = asof(df, distance, table, "distance", "fraction", name)
    return out.withColumn(name, F.when(F.col(distance).isNotNull(), F.coalesce(name, F.lit(0.0))))


def response_statistics(z: Column, expected: Column) -> dict[str, Column]:
    """Counts, mean, standard deviation, range and shares beyond 1, 2, 3 of a standardised deviation."""
    n = F.count(z)
    beyond = {f"percent_abs_over_{t}": F.try_divide(F.count_if(F.abs(z) > t) * 100.0, n) for t in (1, 2, 3)}
    return {"expected": F.count(expected), "scored": n, "missing": F.count_if(expected.isNotNull() & z.isNull()), "mean": F.avg(z), "stddev": F.stddev_pop(z), "min": F.min(z), "max": F.max(z)} | beyond


def percentile_statistics(p: Column) -> dict[str, Column]:
    n = F.count(p)
    beyond = {f"percent_from_{round(t * 100)}": F.try_divide(F.count_if(p >= t) * 100.0, n) for t in (0.90, 0.95, 0.99)}
    return {"scored": n, "mean": F.avg(p), "stddev": F.stddev_pop(p), "min": F.min(p), "max": F.max(p)} | beyond


def mean_abs(z: Sequence[Column]) -> Column:
    total = F.abs(z[0])
    for x in z[1:]:
        total = total + F.abs(x)
    return total / float(len(z))


def display_summary(df: DataFrame, cell_row: Column, cell_col: Column, value: Column, cls: Column, classes: int) -> DataFrame:
    """Cells of a coarser grid: sum, count, mean and the number of pixels of each class, with the most frequent one (ties: first)."""
    counts = {f"class_{i}": F.count_if(cls == i) for i in range(classes)}
    out = df.groupBy(cell_row.alias("cell_row"), cell_col.alias("cell_col")).agg(F.sum(value).alias("value_sum"), F.count(value).alias("value_count"), *(c.alias(n) for n, c in counts.items()))
    most = F.greatest(*(F.col(n) for n in counts)) if classes > 1 else F.col("class_0")
    dominant = F.lit(None).cast("int")
    for i in reversed(range(classes)):
        dominant = F.when((F.col(f"class_{i}") == most) & (most > 0), i).otherwise(dominant)
    return out.withColumns({"value_mean": F.try_divide(F.col("value_sum"), F.col("value_count")), "dominant": dominant})


def cell_spread(cells: DataFrame, value: str = "value_mean", cap: float = 3.0) -> DataFrame:
    """One row over the cells of a display grid: how many have a value, least, middle and largest, and the share at or above the
    cap of the colours. The grid's size is a parameter, not the map's."""
    v = F.col(value)
    return cells.agg(F.count(v).alias("cells"), F.min(v).alias("least"), F.median(v).alias("median"), F.max(v).alias("most"), F.try_divide(F.count_if(v >= cap), F.count(v)).alias("share_at_cap"))
