"""Weighted statistics. Rows with a missing value or a weight that is missing or not positive do not count."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from meadowline.shipping import ship
from meadowline.sources.scratch import kept

#: Rows of a range into which rows are cut for running sums, and the most ranges.
RANGE_ROWS = 50_000
RANGES = 1024


def with_running_sums(df: DataFrame, by: Sequence[str], order: str, amounts: dict[str, tuple[str, str]]) -> DataFrame:
    """For each amount its running sum by ``order`` within each group, this row included, and the group's total, under the
    two names given for it.

    A window over a whole group would sort it in one task. All rows are cut along group and order into as many ranges of about
    equal size as they ask for, by the edges that Spark samples for a repartition; a large group has many ranges and small ones
    share theirs. What a range holds of each group is summed first, the running sums of these are a small table, and windows
    only run within a range. Where no group has more rows than a range, one window does. ``order`` must be unique in its group.
    The rows, which are mostly sums themselves, are written once and once more with their range, which is not to be drawn again."""
    keys = list(by) or ["_all"]
    # Two structs of keys are equal also where a key is missing, and joins keep the partitioning by them.
    rows = kept((df if by else df.withColumn("_all", F.lit(1))).withColumn("_key", F.struct(*keys)).drop(*keys))
    most, count = rows.groupBy("_key").count().agg(F.coalesce(F.max("count"), F.lit(0)), F.coalesce(F.sum("count"), F.lit(0))).collect()[0]
    shown = [*(F.col("_key").getField(k).alias(k) for k in by), *(c for c in df.columns if c not in by), *(n for names in amounts.values() for n in names)]
    if most <= RANGE_ROWS:
        upto, whole = W.partitionBy("_key").orderBy(order).rowsBetween(W.unboundedPreceding, 0), W.partitionBy("_key")
        return rows.withColumns({name: F.sum(a).over(w) for a, (run, total) in amounts.items() for name, w in ((run, upto), (total, whole))}).select(*shown)
    cut = kept(rows.repartitionByRange(min(RANGES, -(-count // RANGE_ROWS)), "_key", order).withColumn("_range", F.spark_partition_id()))
    parts = cut.groupBy("_key", "_range").agg(*(F.sum(a).alias(f"_s{i}") for i, a in enumerate(amounts)))
    upto = W.partitionBy("_key").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    before = kept(parts.select("_key", "_range", *(c for i, (_, total) in enumerate(amounts.values()) for c in (F.sum(f"_s{i}").over(upto).alias(f"_b{i}"), F.sum(f"_s{i}").over(W.partitionBy("_key")).alias(total)))))
    within = W.partitionBy("_key", "_range").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    run = cut.withColumns({name: F.sum(a).over(within) for a, (name, _) in amounts.items()}).join(before, ["_key", "_range"])
    return run.withColumns({name: F.when(F.col(f"_b{i}").isNull(), F.col(name)).otherwise(F.col(f"_b{i}") + F.coalesce(name, F.lit(0))) for i, (name, _) in enumerate(amounts.values())}).select(*shown)


def _group(by: Sequence[str]) -> Column:
    """The group as one struct: two are equal also where a column is missing."""
    return F.struct(*(by or [F.lit(1).alias("_all")])).alias("_group")


def _cell(x: Column, n: Column, low: Column, high: Column) -> Column:
    """Number of the cell, of equal width between a group's bounds, that holds a value; 0 without bounds. It never falls as the
    value rises, NaN being the largest, so that all of a cell's values come before all of the next one's."""
    wide, cells = high - low, F.ceil(n / max(1, RANGE_ROWS // 5))
    at = F.floor(F.greatest(F.lit(0.0), F.least(F.try_divide(x - low, wide) * cells, (cells - 1).cast("double"))))
    return F.when((wide > 0) & (wide < float("inf")), at).otherwise(F.lit(0)).cast("long")


def _bounds(x: Column) -> tuple[Column, Column]:
    """Smallest and largest finite value."""
    finite = F.when(F.abs(x) < float("inf"), x)
    return F.min(finite), F.max(finite)


def weighted_quantiles(df: DataFrame, by: Sequence[str], value: Column, weight: Column, quantiles: Sequence[float]) -> DataFrame:
    """First value whose cumulative share of the weight reaches the quantile; no interpolation. One row per group, q0, q1, ...

    Weights of equal values are added up first, so that running sums have one row per distinct value. Groups of more distinct
    values than a range has rows are cut into cells of values: weights of all cells, a small table, tell in which cell each
    quantile lies, and only values of these cells are added up and put in order. Rows are written once where there are such."""
    rows = df.select(_group(by), value.cast("double").alias("_v"), weight.cast("double").alias("_w")).where("_v IS NOT NULL AND NOT isnan(_v) AND _w > 0")
    low, high = _bounds(F.col("_v"))
    bounds = rows.groupBy("_group").agg(F.count(F.lit(1)).alias("_rows"), low.alias("_low"), high.alias("_high"), F.approx_count_distinct("_v").alias("_distinct"))
    large = kept(bounds.where(F.col("_distinct") > RANGE_ROWS).drop("_distinct"))
    shown = [F.col("_group").getField(k).alias(k) for k in by]
    reached = [F.col("_share") >= q - 1e-12 for q in quantiles]
    if large.isEmpty():
        sums = rows.groupBy("_group", "_v").agg(F.sum("_w").alias("_w"))
        shared = with_running_sums(sums, ["_group"], "_v", {"_w": ("_run", "_sum")}).withColumn("_share", F.col("_run") / F.col("_sum"))
        found = (shared.groupBy("_group") if by else shared.groupBy()).agg(*(F.coalesce(F.min(F.when(x, F.col("_v"))), F.max("_v")).alias(f"q{i}") for i, x in enumerate(reached)))
        return found.select(*shown, *(f"q{i}" for i in range(len(quantiles))))
    celled = kept(rows).join(F.broadcast(large), "_group", "left").select("_group", "_v", "_w", _cell(*map(F.col, ("_v", "_rows", "_low", "_high"))).alias("_cell"))
    upto = W.partitionBy("_group").orderBy("_cell")
    cells = kept(celled.groupBy("_group", "_cell").agg(F.sum("_w").alias("_in"))).select(
        "_group", "_cell", F.coalesce(F.sum("_in").over(upto.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("_before"),
        F.sum("_in").over(W.partitionBy("_group")).alias("_sum"), (F.sum("_in").over(upto.rowsBetween(W.unboundedPreceding, 0)) / F.col("_sum")).alias("_share"),
    )
    place = cells.groupBy("_group").agg(F.array(*(F.coalesce(F.min(F.when(x, F.col("_cell"))), F.max("_cell")) for x in reached)).alias("_cells"))
    wanted = kept(cells.drop("_share").join(place, "_group").where(F.array_contains("_cells", F.col("_cell"))))
    sums = celled.join(wanted, ["_group", "_cell"]).groupBy("_group", "_cell", "_before", "_sum", "_cells", "_v").agg(F.sum("_w").alias("_w"))
    shared = with_running_sums(sums, ["_group", "_cell"], "_v", {"_w": ("_run", "_all_w")}).withColumn("_share", (F.col("_before") + F.col("_run")) / F.col("_sum"))
    at = [F.col("_cells")[i] == F.col("_cell") for i in range(len(quantiles))]
    found = shared.groupBy("_group").agg(*(F.coalesce(F.min(F.when(here & x, F.col("_v"))), F.max(F.when(here, F.col("_v")))).alias(f"q{i}") for i, (here, x) in enumerate(zip(at, reached, strict=True))))
    return found.select(*shown, *(f"q{i}" for i in range(len(quantiles))))


def weighted_mode(df: DataFrame, by: Sequence[str], category: str, weight: Column) -> DataFrame:
    """Category of the largest total weight; of equal ones the smallest."""
    sums = df.where(F.col(category).isNotNull() & (weight > 0)).groupBy(*by, category).agg(F.sum(weight).alias("_w"))
    top = W.partitionBy(*by).orderBy(F.desc("_w"), category)
    return sums.withColumn("_r", F.row_number().over(top)).where("_r = 1").select(*by, F.col(category).alias("mode"), F.col("_w").alias("mode_weight"))


def _kept(ok: Column, x: Column) -> Column:
    return F.sum(F.when(ok, x))


def moments(x: Column, w: Column) -> dict[str, Column]:
    """Weighted mean and population standard deviation."""
    ok = x.isNotNull() & (w > 0)
    total, s1, s2 = _kept(ok, w), _kept(ok, w * x), _kept(ok, w * x * x)
    mean = F.try_divide(s1, total)
    return {"mean": mean, "stddev": F.when(total > 0, F.sqrt(F.greatest(F.try_divide(s2, total) - mean * mean, F.lit(0.0))))}


def correlation(a: Column, b: Column, w: Column) -> Column:
    """Weighted Pearson correlation; NULL with fewer than two pairs or without variance."""
    ok = a.isNotNull() & b.isNotNull() & (w > 0)
    total = _kept(ok, w)
    ma, mb = F.try_divide(_kept(ok, w * a), total), F.try_divide(_kept(ok, w * b), total)
    cov = F.try_divide(_kept(ok, w * a * b), total) - ma * mb
    va, vb = F.try_divide(_kept(ok, w * a * a), total) - ma * ma, F.try_divide(_kept(ok, w * b * b), total) - mb * mb
    return F.when((F.count_if(ok) >= 2) & (va > 0) & (vb > 0), cov / F.sqrt(va * vb))


def with_average_ranks(df: DataFrame, by: Sequence[str], names: dict[str, str]) -> DataFrame:
    """For each column its rank, under the name given for it, that equal values share as their mean; missing values have none.

    Groups of more rows than a range are cut into cells of values. What lies before a cell comes from a small table of the
    cells' rows, and only a cell's own rows are put in order: each row is sent once, to its cell. A full cell of one value needs
    no order, so columns of few values send nothing. Cells that stay too full (values close together beside far ones, and
    columns of no numbers) take running sums over their distinct values. Rows are written once where a group is cut."""
    rows = df.withColumn("_group", _group(by))
    double = {c: (F.col(c) if isinstance(df.schema[c].dataType, NumericType) else F.lit(None)).cast("double") for c in names}
    ends = {c: _bounds(x) for c, x in double.items()}
    bounds = rows.groupBy("_group").agg(F.count(F.lit(1)).alias("_rows"), *(x.alias(f"_{k}{i}") for i, c in enumerate(names) for k, x in zip(("low", "high"), ends[c], strict=True)))
    large = kept(bounds.where(F.col("_rows") > RANGE_ROWS))
    cut = not large.isEmpty()
    out = rows = kept(rows) if cut else rows
    split = False
    for i, (column, name) in enumerate(names.items()):
        there, shown = F.col(column).isNotNull(), [*out.columns, name]

        def placed(rows: DataFrame, i: int = i, column: str = column) -> DataFrame:
            """Rows of groups that are cut with their _cell, others without; missing values are dealt out and meet nothing."""
            near = rows.join(F.broadcast(large), "_group", "left")
            cell = F.when(F.col("_rows").isNotNull(), _cell(double[column], *map(F.col, ("_rows", f"_low{i}", f"_high{i}"))))
            return near.withColumn("_cell", F.when(F.col(column).isNull(), -1 - F.spark_partition_id()).otherwise(cell)).drop(*(c for c in large.columns if c != "_group"))

        def ordered(rows: DataFrame, column: str = column, there: Column = there, name: str = name, shown: Sequence[str] = shown) -> DataFrame:
            within = W.partitionBy("_cell", "_group").orderBy(column)
            mean = (F.rank().over(within) + F.count(F.lit(1)).over(within)) / 2.0  # the first and the last of equal ones
            return rows.withColumn(name, F.when(there, mean + F.coalesce("_before", F.lit(0)))).select(*shown)

        if not cut:
            out = ordered(placed(out).withColumn("_before", F.lit(0)))
            continue
        found = kept(placed(rows).where("_cell >= 0").groupBy("_group", "_cell").agg(F.count(F.lit(1)).alias("_n"), (F.min(column) == F.max(column)).alias("_one")))
        earlier = W.partitionBy("_group").orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
        kind = F.when(F.col("_one") & (F.col("_n") >= RANGE_ROWS // 5), "one").when(F.col("_n") > 4 * RANGE_ROWS, "many").otherwise("few")
        cells = kept(found.select("_group", "_cell", "_n", kind.alias("_kind"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")))
        held = {r["_kind"]: r["n"] for r in cells.groupBy("_kind").agg(F.sum("_n").alias("n")).collect()}
        kinds = [k for k in ("one", "many") if k in held]
        if sum(held[k] for k in kinds) < rows.count():
            kinds.append("few")
        if split and len(kinds) > 1:
            out = kept(out)  # its parts are not to be made anew for each of these
        split = True
        near = placed(out).join(F.broadcast(cells), ["_group", "_cell"], "left").withColumn("_kind", F.coalesce("_kind", F.lit("few")))
        parts = []
        for k in kinds:
            some = near.where(F.col("_kind") == k)
            if k == "one":
                parts.append(some.withColumn(name, F.col("_before") + (F.col("_n") + 1) / 2.0).select(*shown))
            elif k == "few":
                parts.append(ordered(some))
            else:
                counts = placed(rows).join(F.broadcast(cells.where("_kind = 'many'")), ["_group", "_cell"]).groupBy("_group", "_cell", column).agg(F.count(F.lit(1)).alias("_c"))
                ranks = with_running_sums(counts, ["_group", "_cell"], column, {"_c": ("_run", "_all_c")}).select("_group", "_cell", column, (F.col("_run") - (F.col("_c") - 1) / 2.0).alias("_rank"))
                parts.append(some.join(ranks, ["_group", "_cell", column]).withColumn(name, F.col("_before") + F.col("_rank")).select(*shown))
        out = reduce(DataFrame.union, parts)
    return out.drop("_group")


def regression_metrics(o: Column, e: Column, w: Column) -> dict[str, Column]:
    """Weighted R2, RMSE, MAE and bias (mean of observed minus expected); NULL with fewer than two pairs, R2 also where the observed is constant."""
    ok = o.isNotNull() & e.isNotNull() & (w > 0)
    enough = F.count_if(ok) >= 2
    total, mean = _kept(ok, w), F.try_divide(_kept(ok, w * o), _kept(ok, w))
    spread = _kept(ok, w * o * o) - total * mean * mean
    lost = _kept(ok, w * (o - e) * (o - e))
    per = lambda x: F.when(enough, F.try_divide(x, total))
    return {
        "r2": F.when(enough & (F.min(F.when(ok, o)) < F.max(F.when(ok, o))), 1 - F.try_divide(lost, spread)),
        "rmse": F.sqrt(per(lost)), "mae": per(_kept(ok, w * F.abs(o - e))), "bias": per(_kept(ok, w * (o - e))),
    }


def pair_sums(df: DataFrame, columns: Sequence[str], weight: str) -> DataFrame:
    """i, j (i <= j) and the sums over rows that have both columns: rows, w, wx, wy, wxx, wyy, wxy. Products of batches as
    matrices, a row for each pair and task, added up in Spark: one pass however many columns there are."""
    ship(df.sparkSession)
    k, names = len(columns), ("w", "wx", "wy", "wxx", "wyy", "wxy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros((k, k), np.int64), np.zeros((6, k, k))
        for batch in batches:
            w = np.nan_to_num(np.asarray(batch.column(k).to_numpy(zero_copy_only=False), float))
            v = np.column_stack([np.asarray(batch.column(i).to_numpy(zero_copy_only=False), float) for i in range(k)]) if k else np.zeros((len(w), 0))
            v, w = v[w > 0], w[w > 0]
            there = np.isfinite(v)
            v, m = np.where(there, v, 0.0), there.astype(float)
            wm, wv = m * w[:, None], v * w[:, None]
            n += there.T.astype(np.int64) @ there
            for s, x in zip(sums, (wm.T @ m, wv.T @ m, m.T @ wv, (wv * v).T @ m, m.T @ (wv * v), wv.T @ v)):
                s += x
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(n[i, j]), *(pa.array(s[i, j]) for s in sums)], names=["i", "j", "rows", *names])

    rows = df.select(*(F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)), F.col(weight).cast("double").alias("_w"))
    parts = rows.mapInArrow(run, "i int, j int, rows long, " + ", ".join(f"{x} double" for x in names))
    return parts.groupBy("i", "j").agg(*(F.sum(x).alias(x) for x in ("rows", *names)))


def correlation_matrix(df: DataFrame, columns: Sequence[str], weight: str) -> DataFrame:
    """x, y, rows and the weighted correlation over the rows that have both: every pair in both orders and each column with
    itself (1). Otherwise NULL with fewer than two rows or without variance."""
    mean = lambda c: F.try_divide(F.col(c), F.col("w"))
    vx, vy, cov = mean("wxx") - mean("wx") * mean("wx"), mean("wyy") - mean("wy") * mean("wy"), mean("wxy") - mean("wx") * mean("wy")
    known = (F.col("rows") >= 2) & (vx > 0) & (vy > 0)
    found = F.when(F.col("i") == F.col("j"), 1.0).when(known, cov / F.sqrt(vx * vy))
    names = F.array(*map(F.lit, columns))
    half = pair_sums(df, columns, weight).select("i", "j", "rows", found.alias("correlation"))
    both = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    cells = half.select(F.explode(both).alias("p"), "rows", "correlation")
    return cells.select(F.get(names, F.col("p.i")).alias("x"), F.get(names, F.col("p.j")).alias("y"), "rows", "correlation")


def covariance(df: DataFrame, responses: Sequence[str], w: Column) -> DataFrame:
    """One row: rows, weight, means (m_x) and covariances (c_x_y) over rows complete in all responses, divided by the total weight."""
    rows = df.where(" AND ".join(f"`{r}` IS NOT NULL" for r in responses)).where(w > 0)
    total = F.sum(w)
    out = {"rows": F.count(F.lit(1)), "weight": total}
    mean = {r: F.sum(w * F.col(r)) / total for r in responses}
    out |= {f"m_{r}": m for r, m in mean.items()}
    for i, a in enumerate(responses):
        out |= {f"c_{a}_{b}": F.sum(w * F.col(a) * F.col(b)) / total - mean[a] * mean[b] for b in responses[: i + 1]}
    return rows.agg(*(c.alias(n) for n, c in out.items()))


def ecdf(df: DataFrame, value: str, weight: Column) -> DataFrame:
    """value and fraction: weighted share of rows with at most this value, one row per distinct value, the last one 1."""
    sums = df.where(F.col(value).isNotNull() & (weight > 0)).groupBy(value).agg(F.sum(weight).alias("_w"))
    top = sums.agg(F.max(value).alias("_top"))  # one row
    shared = with_running_sums(sums, [], value, {"_w": ("_run", "_sum")}).join(F.broadcast(top))
    return shared.select(value, F.when(F.col(value) == F.col("_top"), 1.0).otherwise(F.col("_run") / F.col("_sum")).alias("fraction"))


#: Cells of equal width into which each range of an as-of table is cut, and edges of ranges that are passed over at a time.
CELLS, STEP = 4096, 32


def asof(df: DataFrame, value: str, table: DataFrame, at: str, result: str, name: str) -> DataFrame:
    """Each row with the ``result`` of the last row of ``table`` whose ``at`` is not above its ``value``, under ``name``: NULL below
    the first and for missing values. ``at`` is unique, and ``result`` does not fall as it rises, as a cumulative share's does.

    An as-of join by common ranges of values: the table is cut at approximate quantiles into ranges, these into cells of equal
    width, and a cell's few rows are kept together as a sorted array with the result before them. Rows find their cell by
    arithmetic, so that the join is one on equal keys: nothing is sorted, Spark sends the cells to all tasks where their size
    permits, and splits frequent ones otherwise. The plan holds the edges of the ranges, ``RANGES`` at most; values find theirs by
    every ``STEP``-th edge first. The table, mostly a result itself, is written once and read by every step."""
    known = kept(table.where(F.col(at).isNotNull() & F.col(result).isNotNull()).select(F.col(at).cast("double").alias("_at"), F.col(result).alias("_result")))
    found = known.agg(F.count(F.lit(1)), F.min("_at"), F.max("_at"), F.percentile_approx("_at", F.expr(f"array({', '.join(f'{i / RANGES}D' for i in range(1, RANGES))})"), 4 * RANGES)).collect()[0]
    rows, low, high, marks = found
    if not rows:
        return df.withColumn(name, F.lit(None).cast(table.schema[result].dataType))
    n = min(RANGES, -(-rows // RANGE_ROWS))
    inner = sorted({marks[i * RANGES // n - 1] for i in range(1, n)} - {low, high})
    starts, ends = [low, *inner], [*inner, high]
    array = lambda xs: F.array(*(F.lit(float(x)) for x in xs))

    def placed(rows: DataFrame, x: Column) -> DataFrame:
        """Rows with their _span and _cell, one column after the other, so that no edge is passed twice."""
        upto = lambda edges: F.size(F.filter(edges, lambda e: e <= x))
        out = rows.withColumn("_coarse", STEP * upto(array(inner[STEP - 1 :: STEP])) if len(inner) >= STEP else F.lit(0))
        out = out.withColumn("_span", F.col("_coarse") + upto(F.slice(array(inner), F.col("_coarse") + 1, STEP - 1)) if inner else F.lit(0))
        a, b = F.get(array(starts), "_span"), F.get(array(ends), "_span")
        cell = F.when(b > a, F.floor((x - a) / (b - a) * CELLS)).otherwise(F.lit(0))
        return out.withColumn("_cell", F.least(F.greatest(cell, F.lit(0)), F.lit(CELLS - 1)).cast("int")).drop("_coarse")

    filled = kept(placed(known, F.col("_at")).groupBy("_span", "_cell").agg(F.array_sort(F.collect_list(F.struct("_at", "_result"))).alias("_rows"), F.max("_result").alias("_top")))
    every = df.sparkSession.range(len(starts)).select(F.col("id").cast("int").alias("_span"), F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1))).alias("_cell"))
    tops = filled.groupBy("_span").agg(F.max("_top").alias("_most"))  # a row for each range
    lower = tops.alias("a").join(tops.alias("b"), F.col("b._span") < F.col("a._span"), "left").groupBy("a._span").agg(F.max("b._most").alias("_lower"))
    earlier = W.partitionBy("_span").orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    cells = every.join(filled, ["_span", "_cell"], "left").withColumn("_before", F.max("_top").over(earlier)).join(lower, "_span", "left")
    cells = cells.select("_span", "_cell", "_rows", F.coalesce("_before", "_lower").alias("_before"))
    x = F.col(value).cast("double")
    # Missing values are set aside: their keys meet nothing, and they do not share one.
    keyed = placed(df, x).withColumns({"_span": F.when(x.isNull(), F.lit(-1)).otherwise(F.col("_span")), "_cell": F.when(x.isNull(), F.spark_partition_id()).otherwise(F.col("_cell"))})
    within = F.array_max(F.transform(F.filter("_rows", lambda e: e["_at"] <= x), lambda e: e["_result"]))
    return keyed.join(cells, ["_span", "_cell"], "left").select(*df.columns, F.coalesce(within, F.col("_before")).alias(name))


def ecdf_quantiles(table: DataFrame, value: str, fraction: str, shares: Sequence[float]) -> DataFrame:
    """One row: for each share the first value whose cumulative fraction reaches it, as p50, p90, ..."""
    return table.agg(*(F.min(F.when(F.col(fraction) >= q, F.col(value))).alias(f"p{round(q * 100):02d}") for q in shares))
