"""How much of the rows and of the area has each predictor and response, and which responses can be fitted."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meadowline.operators.weighted import moments


def _long(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str) -> DataFrame:
    each = F.array(*(F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias("_v")) for c in columns))
    return rows.select(*(F.col(k).alias(f"_{i}") for i, k in enumerate(keys)), F.explode(each).alias("_s")).select("*", "_s.*").drop("_s")


def predictor_coverage(rows: DataFrame, predictors: Sequence[str], area: str) -> DataFrame:
    """predictor, rows, row_fraction, area, area_fraction: what has a value, and its share of all rows and of all area."""
    there = F.sum(F.when(F.col("_v").isNotNull(), F.col("_0")).otherwise(0.0))
    return _long(rows, [area], predictors, "predictor").groupBy("predictor").agg(
        F.count("_v").alias("rows"), (F.count("_v") / F.count(F.lit(1))).alias("row_fraction"), there.alias("area"), F.try_divide(there, F.sum("_0")).alias("area_fraction")
    )


def response_status(rows: DataFrame, responses: Sequence[str], area: str, fold: str, folds: int, chosen: Collection[str], least_coverage: float) -> DataFrame:
    """One row for each response: coverage, spread, least fold support, and whether it is fitted or why not. ``rows`` are the
    reference rows; the folds are numbered from 0."""
    held = [F.count_if(F.col("_v").isNotNull() & (F.col("_1") == k)) for k in range(folds)]
    stats = _long(rows, [area, fold], responses, "response").groupBy("response").agg(
        F.count("_v").alias("reference_count"), F.try_divide(F.sum(F.when(F.col("_v").isNotNull(), F.col("_0"))), F.sum("_0")).alias("area_fraction"), moments(F.col("_v"), F.col("_0"))["stddev"].alias("stddev"),
        F.count_distinct("_v").alias("distinct_values"), F.least(*held).alias("least_validation"), F.least(*(F.count("_v") - h for h in held)).alias("least_training"),
    )
    why = (
        F.when(~F.col("response").isin(*chosen) if chosen else F.lit(True), "not_selected").when(F.col("reference_count") == 0, "no_reference_values")
        .when(F.col("area_fraction") < least_coverage, "insufficient_reference_coverage").when((F.col("distinct_values") < 2) | (F.col("stddev") <= 0), "no_reference_variation")
        .when((F.col("least_validation") < 2) | (F.col("least_training") < 2), "insufficient_spatial_fold_support").otherwise("fit")
    )
    return stats.withColumn("status", why)
