"""Spatially balanced sampling with design weights, and what is reported on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meadowline.sources.scratch import kept


def priority(seed: int, *key: Column) -> Column:
    """Reproducible random priority of a row, from its key alone and so independent of how rows are partitioned."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in key)), 256)


def uniform(seed: int, *key: Column) -> Column:
    """A number in (0, 1) from the first 32 bits of the priority."""
    return (F.conv(F.substring(priority(seed, *key), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def stratified_sample(df: DataFrame, strata: Sequence[str], rank: Sequence[Column | str], cap: int) -> DataFrame:
    """At most ``cap`` rows of each stratum, those that rank lowest, with population, probability and weight.

    The window has only the rank, so that Spark limits groups before and after the exchange; the populations come from a
    partial aggregate of their own and are joined back, one row per stratum."""
    w = W.partitionBy(*strata).orderBy(*rank)
    chosen = df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= cap).drop("_rank")
    population = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("available"))
    sampled = F.least(F.col("available"), F.lit(cap).cast("long"))
    return chosen.join(population, list(strata)).withColumns({"sampled": sampled, "probability": sampled / F.col("available"), "weight": F.col("available") / sampled})


def class_summary(sample: DataFrame, cls: str, area: Column, classes: Sequence[int] = (0, 1)) -> DataFrame:
    """One row for each class, also for one that has no rows."""
    spark = sample.sparkSession
    weighted = sample.groupBy(cls).agg(
        F.count(F.lit(1)).alias("sampled_rows"), F.sum("weight").alias("represented_rows"), F.sum(area).alias("sampled_area"), F.sum(area * F.col("weight")).alias("represented_area"),
        F.count_distinct("block_col", "block_row").alias("blocks"), F.min("weight").alias("weight_min"), F.max("weight").alias("weight_max"),
    )
    every = spark.createDataFrame([(c,) for c in classes], f"{cls} int")
    return every.join(weighted, cls, "left").withColumns({"sampled_rows": F.coalesce("sampled_rows", F.lit(0)), "blocks": F.coalesce("blocks", F.lit(0))})


#: Ranges in which blocks are numbered, and how many keys are looked at to place their edges.
RANGES, EDGE_SAMPLE = 32, 2000


def dense_block_numbers(df: DataFrame, keys: Sequence[str], name: str = "block_id") -> DataFrame:
    """Blocks numbered from 1 in key order."""
    return with_numbers(kept(df.select(*keys).distinct()), keys, name)


def with_numbers(blocks: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Rows, of which no two have the same keys, numbered from 1 in key order. They are read several times. A window over all of
    them would run in one task: they are cut at the edges of a bounded sample into ranges of keys, numbered within each, and the
    numbers before a range are added."""
    some = blocks.select(*keys).orderBy(F.xxhash64(*keys), *keys).limit(EDGE_SAMPLE).orderBy(*keys).collect()
    ranges = RANGES if len(some) == EDGE_SAMPLE else 1  # so few are numbered in one task
    step = -(-len(some) // ranges) or 1
    edges = [F.struct(*(F.lit(e[k]).cast(blocks.schema[k].dataType).alias(k) for k in keys)) for e in some[step::step]]
    at = F.size(F.filter(F.array(*edges), lambda e: e <= F.struct(*keys))) if edges else F.lit(0)
    blocks = blocks.withColumn("_range", at)
    counts = {r["_range"]: r["count"] for r in blocks.groupBy("_range").count().collect()} if edges else {}
    before = F.array(*(F.lit(sum(n for k, n in counts.items() if k < i)).cast("long") for i in range(len(edges) + 1)))
    return blocks.withColumn(name, F.row_number().over(W.partitionBy("_range").orderBy(*keys)) + F.get(before, F.col("_range"))).drop("_range")


def scan_statistics(df: DataFrame, bands: Sequence[str], area: Column | None = None) -> DataFrame:
    """band, defined, percent, min, mean, max (and area) of every band in one pass over the rows."""
    area = F.lit(1.0) if area is None else area
    pairs = F.explode(F.array(*(F.struct(F.lit(b).alias("band"), F.col(b).cast("double").alias("v"), area.alias("a")) for b in bands))).alias("s")
    return df.select(pairs).select("s.*").groupBy("band").agg(
        F.count("v").alias("defined"), (F.count("v") / F.count(F.lit(1)) * 100).alias("percent"), F.sum(F.when(F.col("v").isNotNull(), F.col("a"))).alias("area"),
        F.min("v").alias("min"), F.avg("v").alias("mean"), F.max("v").alias("max"),
    )


def weighted_without_replacement(df: DataFrame, u: Column, weight: Column, n: int, tie: Sequence[str]) -> DataFrame:
    """``n`` rows drawn with probability by weight: the smallest of -ln(u) / w."""
    return df.where(weight > 0).withColumn("key", -F.ln(u) / weight).orderBy("key", *tie).limit(n)
