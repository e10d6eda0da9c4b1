"""Points and tiles in polygons, for any number of features.

Features are a table: ``feature`` (its number), ``properties`` (map of texts) and ``polygons``, lists of rings of points; the even-odd rule
holds within a polygon, and a feature is the union of its polygons, which may overlap.

Points do not meet polygons pair by pair. An index keyed by tile says which features a tile lies in whole, and which of a
polygon's edges matter to a tile that some of them pass; points are joined with it by their tile. What an edge right of a tile adds
to all of the tile's rays alike is a number. So the plan holds no coordinates, points of inner tiles are not tested at all, and
others only against the edges of their row of tiles.

What is only counted is not paired at all: ``tallies`` decides runs of a tile's points by one of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meadowline.operators.sampling import dense_block_numbers
from meadowline.operators.weighted import with_running_sums
from meadowline.shipping import ship
from meadowline.sources.scratch import kept

FEATURES = "feature long, properties map<string,string>, polygons array<array<array<struct<x:double,y:double>>>>"


def features_of(spark: SparkSession, areas: Sequence[Sequence]) -> DataFrame:
    """Features from lists of polygons in memory."""
    rows = [(i, {}, [[[(float(x), float(y)) for x, y in ring] for ring in polygon] for polygon in area]) for i, area in enumerate(areas)]
    return spark.createDataFrame(rows, FEATURES)


def _closed(ring: Column) -> Column:
    return F.when(F.element_at(ring, 1) == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))


def _ring_area(ring: Column) -> Column:
    """Shoelace, from the ring's first point."""
    c, o = _closed(ring), F.element_at(ring, 1)
    part = lambda i: (F.get(c, i - 1).x - o.x) * (F.get(c, i).y - o.y) - (F.get(c, i).x - o.x) * (F.get(c, i - 1).y - o.y)
    return F.abs(F.aggregate(F.sequence(F.lit(1), F.size(c) - 1), F.lit(0.0), lambda a, i: a + part(i))) / 2


def shoelace(polygons: Column) -> Column:
    """Area of polygons: outer rings, the first of each, less their holes."""
    one = lambda p: F.aggregate(p, F.lit(0.0), lambda a, ring: a - _ring_area(ring)) + 2 * _ring_area(F.element_at(p, 1))
    return F.aggregate(polygons, F.lit(0.0), lambda a, p: a + one(p))


def by_area(features: DataFrame) -> DataFrame:
    """Features with their area and ``number``, from 1 for the smallest; equal ones in the order of ``feature``."""
    sized = features.withColumn("area", shoelace(F.col("polygons")))
    return sized.join(dense_block_numbers(sized, ["area", "feature"], "number"), ["area", "feature"])


def edges(features: DataFrame) -> DataFrame:
    """feature, polygon, ax, ay, bx, by of every edge of every ring."""
    rings = features.select("feature", F.posexplode("polygons").alias("polygon", "_p")).select("feature", "polygon", F.explode("_p").alias("_ring"))
    closed = rings.where(F.size("_ring") > 1).withColumn("_ring", _closed(F.col("_ring")))
    at = lambda i: F.get("_ring", i)
    sides = F.transform(F.sequence(F.lit(1), F.size("_ring") - 1), lambda i: F.struct(at(i - 1).x.alias("ax"), at(i - 1).y.alias("ay"), at(i).x.alias("bx"), at(i).y.alias("by")))
    return closed.select("feature", "polygon", F.explode(sides).alias("e")).select("feature", "polygon", "e.*")


def _crosses(e: Column, y: Column) -> Column:
    return (e.ay > y) != (e.by > y)


def _crossing(e: Column, y: Column) -> Column:
    return (e.bx - e.ax) * (y - e.ay) / (e.by - e.ay) + e.ax


def tile_index(features: DataFrame, width: float, height: float | None = None) -> DataFrame:
    """feature, tile_col, tile_row, ``cut`` (whether an edge may pass the tile) and ``parts``: for each polygon that has to do with
    the tile the edges to test and how many more lie right of the whole tile. Written, so that Spark knows its size."""
    w, h = float(width), float(height or width)
    lower, upper = F.least("ay", "by"), F.greatest("ay", "by")
    row = F.col("tile_row")
    low, high = row * h, (row + 1) * h
    along = lambda y: F.when(F.col("ay") == F.col("by"), F.lit(None).cast("double")).otherwise((F.col("bx") - F.col("ax")) * (y - F.col("ay")) / (F.col("by") - F.col("ay")) + F.col("ax"))
    clipped = lambda y, x: F.coalesce(along(F.least(F.greatest(y, low), high)), x)
    bands = edges(features).withColumn("tile_row", F.explode(F.sequence(F.floor(lower / h).cast("long"), F.floor(upper / h).cast("long"))))
    bands = bands.withColumns({"_a": clipped(F.col("ay"), F.col("ax")), "_b": clipped(F.col("by"), F.col("bx"))})
    column = lambda x: F.floor(x / w).cast("long")
    margin = w * 1e-6  # an edge that only touches a tile's border may count as passing it: the tile is then tested, not wrong
    side = F.struct(column(F.least("_a", "_b") - margin).alias("c0"), column(F.greatest("_a", "_b") + margin).alias("c1"), ((lower <= low) & (upper >= high)).alias("spans"), "ax", "ay", "bx", "by")
    grouped = bands.groupBy("feature", "polygon", "tile_row").agg(F.collect_list(side).alias("_e"))
    middle = (row + 0.5) * h
    xs = F.array_sort(F.transform(F.filter("_e", lambda e: _crosses(e, middle)), lambda e: _crossing(e, middle)))
    grouped = grouped.withColumns({"_xs": xs, "_cut": F.array_distinct(F.flatten(F.transform("_e", lambda e: F.sequence(e.c0, e.c1))))})
    first, last = (lambda k: F.ceil(F.get("_xs", 2 * k) / w - 0.5).cast("long")), (lambda k: (F.ceil(F.get("_xs", 2 * k + 1) / w - 0.5) - 1).cast("long"))
    pairs = F.when(F.size("_xs") > 1, F.sequence(F.lit(0), F.floor(F.size("_xs") / 2).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    runs = F.flatten(F.transform(pairs, lambda k: F.when(first(k) <= last(k), F.sequence(first(k), last(k))).otherwise(F.array().cast("array<bigint>"))))
    cells = F.concat(F.transform("_cut", lambda c: F.struct(c.alias("c"), F.lit(True).alias("cut"))), F.transform(F.array_except(runs, "_cut"), lambda c: F.struct(c.alias("c"), F.lit(False).alias("cut"))))
    tiles = grouped.select("feature", "tile_row", "_e", F.explode(cells).alias("_t")).select("feature", "tile_row", "_e", F.col("_t.c").alias("tile_col"), "_t.cut")
    whole = lambda e: e.spans & (e.c0 > F.col("tile_col") + 1)  # noqa: E731  right of the tile for each of its rays
    near = F.transform(F.filter("_e", lambda e: (e.c1 >= F.col("tile_col")) & ~whole(e)), lambda e: F.struct(e.ax.alias("ax"), e.ay.alias("ay"), e.bx.alias("bx"), e.by.alias("by")))
    part = F.struct(F.when(F.col("cut"), F.size(F.filter("_e", whole))).otherwise(1).alias("base"), F.when(F.col("cut"), near).otherwise(F.slice(near, 1, 0)).alias("edges"))
    return kept(tiles.groupBy("feature", "tile_col", "tile_row").agg(F.bool_or("cut").alias("cut"), F.collect_list(part).alias("parts")))


def inside(x: Column, y: Column) -> Column:
    """Whether a point lies in the ``parts`` of its tile."""
    odd = lambda p: (p.base + F.size(F.filter(p.edges, lambda e: _crosses(e, y) & (x < _crossing(e, y))))) % 2 == 1
    return F.exists("parts", odd)


def crossings(y: Column) -> Column:
    """What ``parts`` are to all points of one y: for each its base and where its edges cross that y."""
    return F.transform("parts", lambda p: F.struct(p.base.alias("base"), F.transform(F.filter(p.edges, lambda e: _crosses(e, y)), lambda e: _crossing(e, y)).alias("xs")))


def inside_row(x: Column) -> Column:
    """Whether a point of that y lies in the ``crossings``: as ``inside``."""
    return F.exists("crossings", lambda p: (p.base + F.size(F.filter(p.xs, lambda c: x < c))) % 2 == 1)


def with_tiles(points: DataFrame, x: str, y: str, width: float, height: float | None = None) -> DataFrame:
    return points.withColumns({"tile_col": F.floor(F.col(x) / float(width)).cast("long"), "tile_row": F.floor(F.col(y) / float(height or width)).cast("long")})


def features_at(points: DataFrame, index: DataFrame, x: str, y: str) -> DataFrame:
    """One row for each point and feature that it lies in. ``points`` have tile_col and tile_row on the index's tiles."""
    return points.join(index, ["tile_col", "tile_row"]).where(inside(F.col(x), F.col(y))).select(*(points[c] for c in points.columns), "feature")


def within(points: DataFrame, index: DataFrame, x: str, y: str, name: str | None = None) -> DataFrame:
    """The points that lie in any feature, each once; with ``name`` all points and whether they do. For that the index is
    gathered by tile."""
    any_feature = index.groupBy("tile_col", "tile_row").agg(F.flatten(F.collect_list("parts")).alias("parts"))
    if name is None:
        return points.join(any_feature, ["tile_col", "tile_row"]).where(inside(F.col(x), F.col(y))).select(*(points[c] for c in points.columns))
    return points.join(any_feature, ["tile_col", "tile_row"], "left").select(*(points[c] for c in points.columns), (F.col("parts").isNotNull() & F.coalesce(inside(F.col(x), F.col(y)), F.lit(False))).alias(name))


def polygon_tiles(index: DataFrame, width: float, height: float | None = None) -> DataFrame:
    """Tiles that share an area with a feature, north to south and west to east: tile_col, tile_row.

    A tile that edges pass shares an area when an edge enters it or its centre lies in the feature; one that is only touched
    does not."""
    w, h = float(width), float(height or width)
    x0, y0 = F.col("tile_col") * w, F.col("tile_row") * h
    x1, y1 = x0 + w, y0 + h

    def enters(e: Column) -> Column:
        """Clips an edge to the open tile by its parameter range."""
        lo, hi = F.lit(0.0), F.lit(1.0)
        for d, a, near, far in ((e.bx - e.ax, e.ax, x0, x1), (e.by - e.ay, e.ay, y0, y1)):
            t0, t1 = F.try_divide(near - a, d), F.try_divide(far - a, d)
            lo = F.when(d == 0, F.when((a > near) & (a < far), lo).otherwise(F.lit(2.0))).otherwise(F.greatest(lo, F.least(t0, t1)))
            hi = F.when(d == 0, hi).otherwise(F.least(hi, F.greatest(t0, t1)))
        return lo < hi

    hit = ~F.col("cut") | F.exists("parts", lambda p: F.exists(p.edges, enters)) | inside((x0 + x1) / 2, (y0 + y1) / 2)
    return index.where(hit).select("tile_col", "tile_row").distinct().orderBy(F.desc("tile_row"), "tile_col")


#: Features and points of a tile that meet in one task, features that are counted at a time, and the most distinct values that are
#: counted by prefix sums.
FEATURES_AT_ONCE, POINTS_AT_ONCE, BLOCK, VALUES = 8192, 262_144, 512, 256


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of so many repeats its owner and its place among the owner's."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


class _Bands:
    """A tile's points by bands of equal count in y, by x within each."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        n, order = len(x), np.argsort(y, kind="stable")
        self.count = max(1, isqrt(n))
        band = np.arange(n) * self.count // n
        self.ends = np.searchsorted(band, np.arange(self.count + 1))
        self.low, self.high = y[order][self.ends[:-1]], y[order][self.ends[1:] - 1]
        self.order = order[np.lexsort((x[order], band))]
        self.x, self.y = x[self.order], y[self.order]
        self.left, self.span = x.min(), x.max() - x.min()
        self.margin = self.span * 1e-6 + max(1.0, np.abs(x).max()) * 1e-9  # wider than what rounding moves a crossing
        self.key = band * (self.span + 4 * self.margin) + (self.x - self.left)

    def place(self, band: np.ndarray, x: np.ndarray, side: str) -> np.ndarray:
        """Where x comes among the points of its band."""
        at = np.clip(x - self.left, -self.margin, self.span + 2 * self.margin)
        return np.searchsorted(self.key, band * (self.span + 4 * self.margin) + at, side)

    def runs(self, base: np.ndarray, unit: np.ndarray, part: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """unit, start and end of runs of points that lie in a unit. ``base`` has a row of parts for each unit, ``edges`` are
        ax, ay, bx, by with their unit and part. An edge takes up a stretch of x in each band that it passes. Between these
        stretches all points of a band lie on the same side of every edge, so one of them is tested; within them, each."""
        ax, ay, bx, by = edges
        low, high = np.minimum(ay, by), np.maximum(ay, by)
        first = np.searchsorted(self.high, low, "left")
        e, k = _spread(np.maximum(np.searchsorted(self.low, high, "right") - first, 0))
        band = first[e] + k
        flat = low[e] == high[e]
        slope = np.divide(bx[e] - ax[e], by[e] - ay[e], out=np.zeros(len(e)), where=~flat)
        at = lambda y, x: np.where(flat, x[e], slope * (y - ay[e]) + ax[e])
        a, b = at(np.maximum(self.low[band], low[e]), ax), at(np.minimum(self.high[band], high[e]), bx)
        start, end = self.place(band, np.minimum(a, b) - self.margin, "left"), self.place(band, np.maximum(a, b) + self.margin, "right")
        group, n = unit[e] * self.count + band, len(self.x)
        sort = np.argsort(group * (n + 1) + start, kind="stable")
        e, group, start, end = e[sort], group[sort], start[sort], end[sort]
        # Stretches of a unit and band that overlap are one.
        reach = np.maximum.accumulate(group * (n + 1) + end) - group * (n + 1)
        fresh = np.append(True, group[1:] != group[:-1])[: len(group)]
        new = fresh | (start > np.append(0, reach[:-1])[: len(group)])
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(group))[: len(heads)] - 1
        zone, z0, z1 = group[heads], start[heads], reach[tails]
        last = np.append(zone[1:] != zone[:-1], True)[: len(zone)]
        before = np.where(fresh[heads], self.ends[zone % self.count], np.append(0, z1[:-1])[: len(zone)])
        owner, k = _spread(z1 - z0)
        after = self.ends[zone[last] % self.count + 1]
        g = np.concatenate([zone, zone[last], zone[owner]])
        s = np.concatenate([before, z1[last], z0[owner] + k])
        t = np.concatenate([z0, after, z0[owner] + k + 1])
        some = s < t
        g, s, t = g[some], s[some], t[some]
        # The test of `inside`, on the edges of the unit and band.
        g0 = np.searchsorted(group, g, "left")
        c, k = _spread(np.searchsorted(group, g, "right") - g0)
        i = e[g0[c] + k]
        x, y = self.x[s[c]], self.y[s[c]]
        with np.errstate(divide="ignore", invalid="ignore"):
            crossed = ((ay[i] > y) != (by[i] > y)) & (x < (bx[i] - ax[i]) * (y - ay[i]) / (by[i] - ay[i]) + ax[i])
        parts = base.shape[1]
        crossings = np.bincount(c * parts + part[i], weights=crossed, minlength=len(g) * parts).reshape(len(g), parts)
        ok = ((crossings + base[g // self.count]) % 2 == 1).any(axis=1)
        # Bands that no edge of the unit passes.
        free = np.repeat((base % 2 == 1).any(axis=1)[:, None], self.count, axis=1)
        free[zone // self.count, zone % self.count] = False
        u, b = np.nonzero(free)
        return np.concatenate([g[ok] // self.count, u]), np.concatenate([s[ok], self.ends[b]]), np.concatenate([t[ok], self.ends[b + 1]])


def _tile_tallies(index: pa.Table, points: pa.Table) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
    """Features, values and counts of a tile."""
    bands = _Bands(*(points.column(c).to_numpy() for c in ("_x", "_y")))
    coded = points.column("_v").combine_chunks().dictionary_encode(null_encoding="encode")
    code, kinds, n = coded.indices.to_numpy(zero_copy_only=False)[bands.order], len(coded.dictionary), len(bands.x)
    few = kinds <= VALUES
    if few:
        sums = np.zeros((n + 1, kinds), np.int32)
        sums[np.arange(1, n + 1), code] = 1
        np.cumsum(sums, axis=0, out=sums)
    for at in range(0, index.num_rows, BLOCK):
        rows = index.slice(at, BLOCK)
        feature, lists = rows.column("feature").to_numpy(), rows.column("parts").combine_chunks()
        structs = lists.flatten()
        unit, local = _spread(lists.value_lengths().to_numpy())
        base = np.zeros((len(feature), max(1, int(local.max(initial=0)) + 1)))
        base[unit, local] = structs.field("base").to_numpy()
        sides = structs.field("edges")
        owner, _ = _spread(sides.value_lengths().to_numpy())
        edge = sides.flatten()
        u, s, t = bands.runs(base, unit[owner], local[owner], np.stack([edge.field(c).to_numpy() for c in ("ax", "ay", "bx", "by")]))
        if few:
            sort = np.argsort(u, kind="stable")
            u, s, t = u[sort], s[sort], t[sort]
            heads = np.flatnonzero(np.append(True, u[1:] != u[:-1])[: len(u)])
            if not len(heads):
                continue
            found = np.add.reduceat(sums[t] - sums[s], heads, axis=0, dtype=np.int64)
            i, v = np.nonzero(found)
            yield feature[u[heads[i]]], coded.dictionary.take(pa.array(v)), found[i, v]
        else:
            owner, k = _spread(t - s)
            pair, count = np.unique(u[owner] * kinds + code[s[owner] + k], return_counts=True)
            yield feature[pair // kinds], coded.dictionary.take(pa.array(pair % kinds)), count


def tallies(points: DataFrame, index: DataFrame, x: str, y: str, value: str) -> DataFrame:
    """feature, ``value`` and ``n``: how many of the points in each feature have the value, or have none.

    Points and features do not meet in pairs. The tile's points lie in bands, about as many as a band has points; an edge passes
    few points of a band, and the runs of points between edges are tested by one of their points and counted by prefix sums. So
    a feature asks for about the square root of the tile's points and not for each point. Values of more than ``VALUES`` kinds
    in a tile are listed point by point. A tile's features and points are dealt to as many tasks as they ask for."""
    tile, kind = ["tile_col", "tile_row"], points.schema[value].dataType
    ship(points.sparkSession)
    rows = points.select(*tile, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), F.col(value).alias("_v"), F.xxhash64(*points.columns).alias("_h"))
    rows = rows.where(~F.isnan("_x") & ~F.isnan("_y"))
    parts = lambda df, most, name: df.groupBy(*tile).agg(F.ceil(F.count(F.lit(1)) / most).alias(name))
    sizes = kept(parts(index, FEATURES_AT_ONCE, "_fs").join(parts(rows, POINTS_AT_ONCE, "_ps"), tile))
    each = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    keys = [*tile, "_f", "_p"]
    left = index.join(sizes, tile).withColumns({"_f": F.pmod(F.xxhash64("feature"), "_fs"), "_p": each("_ps")}).select(*keys, "feature", "parts")
    right = rows.join(sizes, tile).withColumns({"_p": F.pmod("_h", "_ps"), "_f": each("_fs")}).select(*keys, "_x", "_y", "_v")
    schema = T.StructType([T.StructField("feature", T.LongType()), T.StructField("_v", kind), T.StructField("_n", T.LongType())])

    def run(features: pa.Table, points: pa.Table) -> pa.Table:
        if not (features.num_rows and points.num_rows):
            return pa.table({"feature": pa.array([], pa.int64()), "_v": points.column("_v").slice(0, 0), "_n": pa.array([], pa.int64())})
        kind = points.schema.field("_v").type
        found = [pa.table({"feature": pa.array(f), "_v": v.cast(kind), "_n": pa.array(n.astype(np.int64))}) for f, v, n in _tile_tallies(features, points)]
        return pa.concat_tables(found) if found else run(features.slice(0, 0), points)

    counted = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)
    return counted.groupBy("feature", "_v").agg(F.sum("_n").alias("n")).withColumnRenamed("_v", value)


def zonal_range(values: DataFrame, value: Column, low: float = 0.1, high: float = 0.9, n: Column | None = None, between: bool = False) -> DataFrame:
    """feature with the ``low`` and ``high`` quantiles of what lies in it; a feature whose quantiles are equal has none. ``n``: how
    often a row counts. A quantile is the value at its rank, or lies ``between`` two ranks. Exact: ranks come from running sums
    over the distinct values of each feature."""
    counts = values.groupBy("feature", value.alias("_v")).agg(F.sum(F.when(value.isNotNull(), F.lit(1) if n is None else n).otherwise(0)).cast("long").alias("_n"))
    summed = with_running_sums(counts, ["feature"], "_v", {"_n": ("_run", "_all")})
    ranked = lambda rank: F.min(F.when((F.col("_n") > 0) & (F.col("_run") >= rank), F.col("_v")))

    def quantile(q: float) -> Column:
        if not between:
            return ranked(F.greatest(F.lit(1), F.ceil(q * F.col("_all"))))
        at = q * (F.max("_all") - 1)
        below, above = ranked(F.floor(q * (F.col("_all") - 1)) + 1), ranked(F.ceil(q * (F.col("_all") - 1)) + 1)
        return below + (above - below) * (at - F.floor(at))

    q = summed.groupBy("feature").agg(F.max("_all").alias("n"), quantile(low).alias("_low"), quantile(high).alias("_high"))
    there = F.col("_low") != F.col("_high")
    return q.select("feature", "n", F.when(there, F.col("_low")).alias("low"), F.when(there, F.col("_high")).alias("high"))
