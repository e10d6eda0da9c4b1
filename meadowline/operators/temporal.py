"""Reductions of dated observations to one row per pixel (and year)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def in_years(df: DataFrame, ts: str, first: int, last: int | None = None) -> DataFrame:
    """Observations from 1 January of the first year to before 1 January after the last one, as a range that is pushed down."""
    kind = df.schema[ts].dataType.simpleString()
    day = lambda y: F.lit(f"{y}-01-01 00:00:00").cast(kind)
    return df.where((F.col(ts) >= day(first)) & (F.col(ts) < day((last or first) + 1)))


def annual_first(df: DataFrame, keys: Sequence[str], ts: str, tie: str, values: Sequence[str], year: str = "year") -> DataFrame:
    """The first image of each year, ties broken by its id."""
    first = F.min_by(F.struct(*values), F.struct(ts, tie)).alias("first")
    return df.withColumn(year, F.year(ts)).groupBy(*keys, year).agg(first).select(*keys, year, *(F.col(f"first.{v}").alias(v) for v in values))


def reducers(x: Column, percentiles: Sequence[float] = (0.05, 0.95)) -> dict[str, Column]:
    """The temporal reducers of a band."""
    out = {"mean": F.avg(x), "median": F.median(x), "min": F.min(x), "max": F.max(x), "sum": F.sum(x), "count": F.count(x), "stddev": F.stddev_pop(x)}
    return out | {f"p{round(p * 100)}": F.percentile(x, F.lit(float(p))) for p in percentiles}


def never_fails_twice(df: DataFrame, keys: Sequence[str], order: str, ok: Column) -> DataFrame:
    """Whether no two neighbouring periods fail: the minimum over neighbours of (this or the one before). One period counts by itself."""
    w = W.partitionBy(*keys).orderBy(order)
    rows = df.withColumn("_ok", ok.cast("int")).withColumn("_before", F.lag("_ok").over(w))
    pair = F.when(F.col("_before").isNotNull(), F.greatest("_ok", "_before"))
    return rows.groupBy(*keys).agg(F.coalesce(F.min(pair), F.min("_ok")).alias("persistent"), F.count(F.lit(1)).alias("periods"))


def variation_of_totals(df: DataFrame, keys: Sequence[str], year: str, x: Column, last: int, window: int, earliest: int) -> DataFrame:
    """Coefficient of variation, in percent, of the yearly totals in the trailing window; NULL where their mean is 0."""
    first = max(last - window + 1, earliest)
    totals = df.where(F.col(year).between(first, last)).groupBy(*keys, year).agg(F.sum(x).alias("_total"))
    out = totals.groupBy(*keys).agg(F.avg("_total").alias("mean_total"), F.stddev_pop("_total").alias("sd_total"), F.count(F.lit(1)).alias("years"))
    return out.withColumn("cv_percent", F.when(F.col("mean_total") != 0, F.col("sd_total") / F.col("mean_total") * 100))


def months_with(flag: Column) -> Column:
    """Number of months in which something occurred; missing counts as no."""
    return F.sum(F.coalesce(flag.cast("int"), F.lit(0)))


def indicator_stddev(code: Column, on: int, masked: int = 0) -> Column:
    """Population standard deviation of (code = on) over observations whose code is not the masked one."""
    return F.stddev_pop(F.when(code != masked, (code == on).cast("double")))


def positive_mean(x: Column) -> Column:
    return F.avg(F.when(x > 0, x))


def positive_mean_by_month(df: DataFrame, keys: Sequence[str], ts: str, x: Column) -> DataFrame:
    """The same from monthly sums and counts: what a bounded-memory pass keeps of each month."""
    monthly = df.groupBy(*keys, F.date_trunc("month", ts).alias("_month")).agg(F.sum(F.when(x > 0, x)).alias("_s"), F.count(F.when(x > 0, x)).alias("_c"))
    return monthly.groupBy(*keys).agg(F.sum("_s").alias("_s"), F.sum("_c").alias("positives")).select(*keys, F.when(F.col("positives") > 0, F.col("_s") / F.col("positives")).alias("positive_mean"), "positives")


def in_season(daily: DataFrame, seasons: DataFrame, keys: Sequence[str], day: str, start: str, end: str) -> DataFrame:
    """Daily rows within their pixel's season, both ends included: an equi-join on the pixel with a range condition."""
    return daily.join(seasons, list(keys)).where(F.col(day).between(F.col(start), F.col(end)))
