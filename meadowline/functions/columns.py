"""Column expressions on pixels: validity, masks, null-strict logic, unit changes, classes. A missing value is NULL."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid(x: Column) -> Column:
    """NULL for NaN and infinities, which Spark would treat as large values."""
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x)


def mask_if(keep: Column, x: Column) -> Column:
    """The value where the condition holds, else NULL."""
    return F.when(keep, x)


def self_mask(x: Column) -> Column:
    """NULL for zeros."""
    return F.nullif(x, F.lit(0).cast("double"))


def unmask(x: Column, value: float = 0.0) -> Column:
    return F.coalesce(x, F.lit(value))


def strict_and(a: Column, b: Column) -> Column:
    """NULL as soon as either side is NULL, unlike SQL's AND."""
    return F.when(a.isNotNull() & b.isNotNull(), a & b)


def strict_or(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), a | b)


def linear(x: Column, factor: float = 1.0, offset: float = 0.0) -> Column:
    return x * F.lit(float(factor)) + F.lit(float(offset))


def day_of_year_offset(epoch_day: Column, year: Column | int) -> Column:
    """Days since 1 January of the year, from days since 1970-01-01."""
    year = F.lit(year) if isinstance(year, int) else year
    return epoch_day - F.datediff(F.make_date(year, F.lit(1), F.lit(1)), F.lit("1970-01-01").cast("date"))


def any_defined(columns: Sequence[Column]) -> Column:
    return F.coalesce(*columns).isNotNull()


def all_defined(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, (c.isNotNull() for c in columns))


def missing_count(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, (c.isNull().cast("int") for c in columns))


def usable(columns: Sequence[Column], most_missing: float) -> Column:
    """Whether at most this fraction of the predictors is missing (the limit itself is usable)."""
    return missing_count(columns) / F.lit(float(len(columns))) <= most_missing


def in_reference_sample(flag: Column) -> Column:
    """Reference class of sampling: exactly 1; missing is not reference."""
    return F.coalesce(flag == 1, F.lit(False))


def in_reference_map(flag: Column) -> Column:
    """Reference class of inference: anything but 0; missing is not reference."""
    return F.coalesce(flag != 0, F.lit(False))


def comparison(text: str) -> Callable[[Column], Column]:
    """Predicate of a text such as ``>=80``; rejects whatever is not one operator and one finite number."""
    name = text.strip()[:2]
    name = name if name[1:] == "=" else name[:1]
    tests = {">": Column.__gt__, ">=": Column.__ge__, "<": Column.__lt__, "<=": Column.__le__, "==": Column.__eq__}
    try:
        test, value = tests[name], float(text.strip()[len(name) :])
    except (KeyError, ValueError):
        value = math.nan
    if not math.isfinite(value) or "_" in text:
        raise ValueError(f"not a comparison: {text!r}")
    return lambda x: test(x, F.lit(value))


def binary_mask(x: Column, text: str) -> Column:
    """1 where the comparison holds, 0 elsewhere, also for missing and non-finite values."""
    ok = valid(x.cast("double"))
    return F.coalesce(F.when(ok.isNotNull(), comparison(text)(ok)), F.lit(False)).cast("tinyint")


#: Upper limits of the similarity classes, each limit belonging to the class below it.
SIMILARITY_LIMITS = (0.2, 0.4, 0.6, 0.8)


def similarity_class(percentile: Column, limits: Sequence[float] = SIMILARITY_LIMITS) -> Column:
    """Class 0.. of S = 1 - P, with limit[i-1] < S <= limit[i]."""
    s = 1 - percentile
    out = F.lit(len(limits))
    for i, limit in reversed(list(enumerate(limits))):
        out = F.when(s <= limit, i).otherwise(out)
    return F.when(percentile.isNotNull(), out)


#: Fixed values of the status layer.
OUTSIDE_AREA, OUTSIDE_TARGET, INSUFFICIENT, PREDICTED = 255, 0, 1, 2


def target_pixels(inside: Column, predictors: Sequence[Column], mask: Column | None = None) -> Column:
    """Pixels to be predicted: those of the area where a mask is exactly 1 or, without a mask, that have any predictor."""
    applies = any_defined(predictors) if mask is None else F.coalesce(mask == 1, F.lit(False))
    return F.coalesce(inside, F.lit(False)) & applies


def status(inside: Column, target: Column, enough: Column) -> Column:
    """Layer of area, target, targets with too few predictors, and predicted pixels. What is imputed is a layer of its own."""
    return F.when(~F.coalesce(inside, F.lit(False)), OUTSIDE_AREA).when(~F.coalesce(target, F.lit(False)), OUTSIDE_TARGET).when(~enough, INSUFFICIENT).otherwise(PREDICTED)


def slug(text: Column, most: int | None = None) -> Column:
    out = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_"))
    return out if most is None else F.trim(F.substring(out, 1, most), F.lit("_"))


def title(name: Column) -> Column:
    """Words of a file-like name in title case, small conjunctions kept low."""
    words = F.initcap(F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " ")))
    return F.regexp_replace(F.regexp_replace(words, "\\bAnd\\b", "and"), "\\bOf\\b", "of")


def compact_number(x: Column) -> Column:
    """Number in shortest form with ``p`` for the point, as in identifiers."""
    return F.replace(F.regexp_replace(x.cast("string"), "\\.0$", ""), F.lit("."), F.lit("p"))


def first_property(properties: Column, names: Sequence[str], fallback: str) -> Column:
    return F.coalesce(*(properties[n] for n in names), F.lit(fallback))


def lenient_number(text: Column) -> Column:
    return text.try_cast("double")
