"""Additive reference-condition models: cubic splines and categories, ridge regression, spatial cross-validation.

The rows stay in Spark. What reaches the driver is knots, imputation values, the categories and, for each fold and response,
one Gram matrix of the design (some 130 columns), to which each task adds its rows' part. All folds are fitted in the same passes.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meadowline.shipping import ship
from meadowline.operators.weighted import with_running_sums
from meadowline.sources.scratch import kept as written

DEGREE = 3


def basis_knots(quantile_knots: Sequence[float]) -> np.ndarray:
    """The knots with three more on either side, spaced as the first and the last interval."""
    k = np.asarray(quantile_knots, dtype=float)
    low, high = k[1] - k[0], k[-1] - k[-2]
    return np.concatenate((k[0] - low * np.arange(DEGREE, 0, -1), k, k[-1] + high * np.arange(1, DEGREE + 1)))


def spline_basis(x: np.ndarray, knots: np.ndarray, derivative: int = 0) -> np.ndarray:
    """Values (or first derivatives) of the cubic B-splines at x within the inner knots, by the usual recursion."""
    n = len(knots) - DEGREE - 1
    at = np.clip(np.searchsorted(knots, x, side="right") - 1, DEGREE, n - 1)
    out = np.zeros((len(x), len(knots) - 1))
    out[np.arange(len(x)), at] = 1.0
    ratio = lambda a, b: np.divide(a, b, out=np.zeros_like(a), where=b != 0)
    for d in range(1, DEGREE + 1):
        if derivative and d == DEGREE:
            gap = np.broadcast_to(knots[d : len(knots) - 1] - knots[: len(knots) - 1 - d], (len(x), len(knots) - 1 - d))
            next_gap = np.broadcast_to(knots[d + 1 :] - knots[1 : len(knots) - d], (len(x), len(knots) - 1 - d))
            return d * (ratio(out[:, : n], gap) - ratio(out[:, 1 : n + 1], next_gap))
        k = len(knots) - 1 - d
        left = ratio(np.subtract.outer(x, knots[:k]), np.broadcast_to(knots[d : d + k] - knots[:k], (len(x), k)))
        right = ratio(np.subtract(knots[d + 1 : d + 1 + k], x[:, None]), np.broadcast_to(knots[d + 1 : d + 1 + k] - knots[1 : 1 + k], (len(x), k)))
        out = left * out[:, :k] + right * out[:, 1 : k + 1]
    return out


def spline_columns(x: np.ndarray, quantile_knots: Sequence[float]) -> np.ndarray:
    """Design columns of one predictor: the basis without its last member, straight lines beyond the outer knots."""
    knots = basis_knots(quantile_knots)
    low, high = knots[DEGREE], knots[-DEGREE - 1]
    if high <= low:  # a constant predictor has no shape
        return np.zeros((len(x), len(knots) - DEGREE - 2))
    inside = np.clip(x, low, high)
    out = spline_basis(inside, knots)
    beyond = x != inside
    if beyond.any():
        out[beyond] += spline_basis(inside[beyond], knots, 1) * (x[beyond] - inside[beyond])[:, None]
    return out[:, :-1]


@dataclass
class Design:
    """What turns predictors into design columns; fitted on the training rows alone."""

    continuous: list[str]
    categorical: str
    imputation: dict[str, float]
    knots: dict[str, list[float]]
    categories: list[float]

    def matrix(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        filled = {c: np.where(np.isnan(columns[c]), self.imputation[c], columns[c]) for c in (*self.continuous, self.categorical)}
        parts = [spline_columns(filled[c], self.knots[c]) for c in self.continuous]
        codes = filled[self.categorical]
        return np.column_stack([*parts, *((codes == k).astype(float) for k in self.categories)])


@dataclass
class ResponseModel:
    response: str
    design: Design
    coefficients: list[float]
    intercept: float
    rmse: float | None = None

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> ResponseModel:
        d = json.loads(text)
        return cls(d["response"], Design(**d["design"]), d["coefficients"], d["intercept"], d["rmse"])

    def predict(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        return self.design.matrix(columns) @ np.asarray(self.coefficients) + self.intercept


def fit_designs(rows: DataFrame, fold: Column, splits: Sequence[int], kept: Sequence[Column], continuous: Sequence[str], categorical: str, area: Column, knots: int) -> dict[tuple[int, int], Design]:
    """For each split and each condition in ``kept`` the design of the rows outside of that fold that meet the condition.

    Imputation is the weighted median of a continuous predictor and the weighted mode of the categorical one, knots are quantiles
    of the imputed values. All of them come from counts and weights of distinct values, made once for every fold: each value has
    one row with its sums over all rows and over each split's own fold, and what lies outside of a fold is their difference. Two
    jobs however many folds there are, and no task holds a predictor's values. The driver gets one row for each predictor, split
    and condition, and one for each category."""
    w = F.when(area > 0, area.cast("double")).otherwise(0.0)
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))

    def counts(bands: Sequence[str]) -> DataFrame:
        """g, band, v and the number and weight of its rows, in all (n, w) and in each split's fold (n0, w0, ...)."""
        long = [F.when(ok, F.struct(F.lit(g).alias("g"), F.lit(b).alias("band"), number(c).alias("v"))) for g, ok in enumerate(kept) for b, c in enumerate(bands)]
        each = rows.select(fold.alias("f"), w.alias("w"), F.explode(F.array_compact(F.array(*long))).alias("s")).where("f IS NOT NULL").select("f", "w", "s.*")
        own = [x for i, s in enumerate(splits) for x in (F.count_if(F.col("f") == s).alias(f"n{i}"), F.sum(F.when(F.col("f") == s, F.col("w")).otherwise(0.0)).alias(f"w{i}"))]
        return each.groupBy("g", "band", "v").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), *own)

    def by_split(sums: DataFrame, *columns: str) -> DataFrame:
        """A row for each split that has any rows, with these sums over the rows outside of its fold."""
        each = F.array(*(F.struct(F.lit(s).alias("split"), *((F.col(c) - F.col(f"{c}{i}")).alias(c) for c in columns)) for i, s in enumerate(splits)))
        return sums.select("g", "band", "v", F.explode(each).alias("_s")).select("g", "band", "v", "_s.*")

    mode, codes = {}, {}
    for x in sorted(by_split(counts([categorical]), "n", "w").where("n > 0").collect(), key=lambda x: (x.v is None, x.v or 0.0)):
        key = (x.split, x.g)
        if x.v is not None and x.w > mode.get(key, (0.0, 0.0))[0]:
            mode[key] = (x.w, x.v)
        codes.setdefault(key, set()).add(x.v)

    by = ["split", "g", "band"]
    values = written(counts(continuous))
    sums = [x + str(i) for x in "nw" for i in ("", *range(len(splits)))]
    run = with_running_sums(values.where("v IS NOT NULL"), ["g", "band"], "v", {x: (f"run_{x}", f"all_{x}") for x in sums})
    run = by_split(run, "n", "run_n", "all_n", "run_w", "all_w").where("all_n > 0")
    lost = by_split(values.where("v IS NULL"), "n").where("n > 0").select(*by, F.col("n").alias("z"))  # a row for each predictor, split and condition
    run = run.join(F.broadcast(lost), by, "left").na.fill(0, ["z"])
    half = F.try_divide("run_w", "all_w") >= 0.5 - 1e-12
    share = [i / (knots - 1) for i in range(knots)]
    rank = lambda k: F.min(F.when(F.col("run_n") > k, F.col("v")))
    ends = {}
    for i, p in enumerate(share):
        at = p * (F.col("all_n") + F.col("z") - 1)
        for name, k in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            ends |= {f"{name}{i}": rank(k), f"{name}{i}_z": rank(k - F.col("z"))}
    found = run.groupBy(*by).agg(F.max("all_n").alias("n"), F.max("z").alias("z"), F.min(F.when(half, F.col("v"))).alias("median"), F.min(F.when(half, F.col("run_n"))).alias("upto"), F.sum(F.when(F.col("v") <= 0, F.col("n"))).alias("upto_0"), *(c.alias(n) for n, c in ends.items()))
    numbers = {(x.split, x.g, x.band): x for x in found.collect()}

    def settled(x) -> tuple[float, list[float]]:
        """Median, and knots with the imputed rows among the others at the place of the median."""
        if x is None:
            return 0.0, [0.0] * knots
        median, upto = (0.0, x.upto_0 or 0) if x.median is None else (x.median, x.upto)
        out = []
        for i, p in enumerate(share):
            at = p * (x.n + x.z - 1)
            lo, hi = (x[f"{e}{i}"] if k < upto else median if k < upto + x.z else x[f"{e}{i}_z"] for e, k in (("lo", math.floor(at)), ("hi", math.ceil(at))))
            out.append(lo + (hi - lo) * (at - math.floor(at)))
        return median, out

    designs = {}
    for key, seen in codes.items():
        usual = mode[key][1] if key in mode else 0.0
        each = {c: settled(numbers.get((*key, b))) for b, c in enumerate(continuous)}
        designs[key] = Design(list(continuous), categorical, {c: m for c, (m, _) in each.items()} | {categorical: usual}, {c: k for c, (_, k) in each.items()}, sorted({usual if v is None else v for v in seen}))
    return designs


def imputation_values(rows: DataFrame, continuous: Sequence[str], categorical: str, area: Column) -> dict[str, float]:
    """Weighted median of each continuous predictor and weighted mode of the categorical one; 0 where there is none."""
    found = fit_designs(rows, F.lit(-1), [0], [F.lit(True)], continuous, categorical, area, 2)
    return found[0, 0].imputation if found else {c: 0.0 for c in (*continuous, categorical)}


def _arrays(batch: pa.RecordBatch, names: Sequence[str]) -> dict[str, np.ndarray]:
    return {n: np.asarray(batch.column(n).cast(pa.float64()).fill_null(float("nan"))) for n in names}


def grams(rows: DataFrame, fold: Column, parts: Sequence[tuple[int, Design, str]], area: str) -> dict[int, np.ndarray]:
    """For each part (split, design, response) the weighted Gram matrix of (1, design, response) over the rows outside of the
    fold that have the response, and their number below it. One pass for all parts.

    A task sends the upper half of each matrix as numbered cells; Spark adds the cells up."""
    ship(rows.sparkSession)
    names = list(dict.fromkeys(c for _, d, r in parts for c in (*d.continuous, d.categorical, r))) + [area]
    shared: dict[tuple[int, int], list[int]] = {}
    for i, (split, design, _) in enumerate(parts):
        shared.setdefault((split, id(design)), []).append(i)
    groups = [(split, parts[own[0]][1], own) for (split, _), own in shared.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            columns, own = _arrays(batch, names), np.asarray(batch.column("_fold"))
            for split, design, members in groups:
                use = {c: v[own != split] for c, v in columns.items()}
                x = np.column_stack((np.ones(len(use[area])), design.matrix(use)))
                for i in members:
                    y, w = use[parts[i][2]], use[area]
                    ok = ~np.isnan(y) & (w > 0)
                    z = np.column_stack((x[ok], y[ok]))
                    g = (z * w[ok][:, None]).T @ z
                    total[i] = total.get(i, 0) + np.append(g[np.triu_indices(len(g))], ok.sum())
        for i, cells in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), i, np.int32)), pa.array(np.arange(len(cells), dtype=np.int32)), pa.array(cells)], names=["part", "i", "v"])

    sums = rows.select(fold.cast("int").alias("_fold"), *names).where("_fold IS NOT NULL").mapInArrow(run, "part int, i int, v double").groupBy("part", "i").agg(F.sum("v").alias("v")).toPandas()
    out = {}
    for i, cells in sums.groupby("part"):
        flat = cells.sort_values("i").v.to_numpy()
        width = int(((8 * (len(flat) - 1) + 1) ** 0.5 - 1) / 2)
        half = np.zeros((width, width))
        half[np.triu_indices(width)] = flat[:-1]
        out[int(i)] = np.concatenate((half + np.triu(half, 1).T, np.full((1, width), flat[-1])))
    return out


def ridge(g: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    """Coefficients and intercept from a Gram matrix; weights are scaled to mean 1 and the intercept is not penalised."""
    n, g = g[-1, 0], g[:-1]
    g = g * (n / g[0, 0])
    mean = g[0, 1:-1] / n
    y_mean = g[0, -1] / n
    xx = g[1:-1, 1:-1] - n * np.outer(mean, mean)
    xy = g[1:-1, -1] - n * mean * y_mean
    b = np.linalg.solve(xx + alpha * np.eye(len(xx)), xy)
    return b, float(y_mean - mean @ b)


def fit_splits(rows: DataFrame, fold: Column, splits: Sequence[int], responses: Sequence[str], continuous: Sequence[str], categorical: str, area: str = "area_weight_m2", knots: int = 6, alpha: float = 1.0) -> dict[int, list[ResponseModel]]:
    """For each split one model per response, fitted on the rows outside of that fold that have the response; a response
    without any such row of positive weight has none.

    Four jobs, whatever the number of folds. Responses without missing values share their design."""
    there = {r: F.col(r).isNotNull() & ~F.isnan(F.col(r).cast("double")) for r in responses}
    counts = rows.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(r) for r, c in there.items())).collect()[0]
    full = [r for r in responses if counts[r] == counts["n"]]
    groups = ([full] if full else []) + [[r] for r in responses if r not in full]
    kept = [F.lit(True) if g == full else there[g[0]] for g in groups]
    designs = fit_designs(rows, fold, splits, kept, continuous, categorical, F.col(area), knots)
    parts = [(split, design, r) for (split, g), design in sorted(designs.items(), key=lambda x: x[0]) for r in groups[g]]
    out: dict[int, list[ResponseModel]] = {s: [] for s in splits}
    for i, g in (grams(rows, fold, parts, area) if parts else {}).items():
        split, design, r = parts[i]
        if g[-1, 0] > 0:
            b, intercept = ridge(g, alpha)
            out[split].append(ResponseModel(r, design, b.tolist(), intercept))
    return {s: sorted(m, key=lambda m: list(responses).index(m.response)) for s, m in out.items()}


def fit_models(rows: DataFrame, responses: Sequence[str], continuous: Sequence[str], categorical: str, area: str = "area_weight_m2", knots: int = 6, alpha: float = 1.0) -> list[ResponseModel]:
    """One model per response, each on the rows that have it."""
    return fit_splits(rows, F.lit(-1), [0], responses, continuous, categorical, area, knots, alpha)[0]


def predict(rows: DataFrame, models: Sequence[ResponseModel], suffix: str = "_expected") -> DataFrame:
    """Rows with one expected column for each model. The models are small and travel with the function."""
    return predict_splits(rows, None, {0: list(models)}, [m.response for m in models], suffix)


def predict_splits(rows: DataFrame, fold: str | None, models: dict[int, list[ResponseModel]], responses: Sequence[str], suffix: str) -> DataFrame:
    """Rows with one expected column for each response, by the models of the row's own fold; NULL where that fold has no
    such model. One pass; without a fold all rows take the models under 0."""
    ship(rows.sparkSession)
    names = sorted({c for ms in models.values() for m in ms for c in (*m.design.continuous, m.design.categorical)})
    schema = rows.withColumns({r + suffix: F.lit(0.0).cast("double") for r in responses}).schema if responses else rows.schema
    for r in responses:
        schema[r + suffix].nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = _arrays(batch, names)
            own = np.zeros(batch.num_rows) if fold is None else _arrays(batch, [fold])[fold]
            out = {r: np.full(batch.num_rows, np.nan) for r in responses}
            for split, ms in models.items():
                mine = own == split
                if mine.any():
                    use = {c: v[mine] for c, v in columns.items()}
                    for m in ms:
                        out[m.response][mine] = m.predict(use)
            for r in responses:
                batch = batch.append_column(r + suffix, pa.array(out[r], mask=np.isnan(out[r])))
            yield batch

    return rows.mapInArrow(run, schema)


def cross_validate(rows: DataFrame, fold: str, folds: int, responses: Sequence[str], continuous: Sequence[str], categorical: str, area: str = "area_weight_m2", knots: int = 6, alpha: float = 1.0, reference: Column | None = None) -> DataFrame:
    """Out-of-fold expectations: models fitted on reference rows outside a fold, applied to all rows inside it."""
    used = rows if reference is None else rows.where(reference)
    models = fit_splits(used, F.col(fold), range(folds), responses, continuous, categorical, area, knots, alpha)
    return predict_splits(rows.where(F.col(fold).isin(list(range(folds)))), fold, models, responses, "_expected_reference_oof")


def partial_response(model: ResponseModel, values: Sequence[float], predictor: str) -> np.ndarray:
    """Expectation along one predictor, the others at their imputed baseline."""
    columns = {c: np.full(len(values), model.design.imputation[c]) for c in (*model.design.continuous, model.design.categorical)}
    columns[predictor] = np.asarray(values, dtype=float)
    return model.predict(columns)
