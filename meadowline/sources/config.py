"""The analysis definition: a TOML document, checked as a whole and read into plain records."""

from __future__ import annotations

import hashlib
import json
import re
import tomllib
from collections.abc import Iterable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROLES, KINDS = ("reference", "response", "predictor"), ("binary", "continuous", "categorical")
#: Names of analyses and stacks.
_TITLE = re.compile(r"[a-z0-9][a-z0-9_-]*")
_NAME, _BAND = re.compile(r"[a-z][a-z0-9_]*"), re.compile(r"d\d{2,}")
_COLUMN = re.compile(r"y(\d{4})_(d\d+)_")


class ConfigurationError(ValueError):
    """All that is wrong with a definition, one line each."""


@dataclass(frozen=True)
class Band:
    id: str
    computation: str
    suffix: str
    display_name: str
    role: str
    data_type: str
    sources: tuple[str, ...]

    def column(self, year: int) -> str:
        return f"y{year}_{self.id}_{self.suffix}"


@dataclass(frozen=True)
class Analysis:
    raw: dict
    folder: Path
    bands: tuple[Band, ...]

    @property
    def year(self) -> int:
        return self.raw["analysis"]["year"]

    @property
    def name(self) -> str:
        return self.raw["analysis"]["name"]

    def section(self, name: str) -> dict:
        return self.raw[name]

    def path(self, text: str) -> Path:
        """Paths count from the definition's folder."""
        return (self.folder / text).resolve()

    def band_names(self, year: int | None = None) -> list[str]:
        return [b.column(year or self.year) for b in self.bands]

    def columns_with_role(self, columns: Iterable[str], role: str) -> dict[str, str]:
        """Band id to column, of the earliest year among columns with that role, in band order."""
        wanted = {b.id for b in self.bands if b.role == role}
        found = [(int(m[1]), m[2], c) for c in columns if (m := _COLUMN.match(c)) and m[2] in wanted]
        if not found:
            raise KeyError(f"no column has the role {role}")
        first = min(y for y, _, _ in found)
        by_id = {i: c for y, i, c in found if y == first}
        return {b.id: by_id[b.id] for b in self.bands if b.id in by_id}

    def band_for_column(self, column: str) -> Band:
        m = _COLUMN.match(column)
        for b in self.bands:
            if m and b.id == m[2]:
                return b
        raise KeyError(column)

    def resolve_responses(self, columns: Iterable[str], requested: Iterable[str] = ()) -> list[str]:
        """Response columns by ``d02``, ``d2``, ``02``, ``2`` or full name, in any case and with blanks around, each once, in the order asked for; all without a request."""
        known = self.columns_with_role(columns, "response")
        out, unknown = [], []
        for r in requested or known:
            asked = r.strip().lower()
            hit = known.get(short_id(asked)) or next((c for c in known.values() if c.lower() == asked), None)
            if hit is None:
                unknown.append(r)
            elif hit not in out:
                out.append(hit)
        if unknown:
            raise KeyError(f"unknown responses: {', '.join(unknown)}")
        return out

    def band_table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, b.id, b.column(self.year), b.display_name, b.role, b.data_type, list(b.sources)) for i, b in enumerate(self.bands, 1)]
        return spark.createDataFrame(rows, "position int, id string, column string, display_name string, role string, data_type string, sources array<string>")

    def fingerprint(self) -> str:
        """Of the whole definition."""
        return digest(self.raw)

    def raster_fingerprint(self) -> str:
        """Of what changes pixel values or their names: year, stack, grid, reference, datasets and bands."""
        return digest({"year": self.year} | {k: self.raw[k] for k in ("stack", "grid", "reference", "datasets", "bands")})

    def stack_id(self) -> str:
        """Namespace of cached tiles."""
        stack, grid = self.raw["stack"], self.raw["grid"]
        number = lambda x: f"{x:g}".replace(".", "p").replace("-", "m")
        crs = re.sub(r"[^a-z0-9]+", "", grid["crs"].lower())
        return f"{stack['name']}_v{stack['version']}_y{self.year}_{crs}_{number(grid['pixel_size_meters'])}m_t{grid['tile_size_pixels']}_{self.raster_fingerprint()[:12]}"


def canonical(value) -> str:
    """JSON with sorted keys and no blanks."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def digest(value) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


#: Settings with their tests: (section, key, what it must be).
_RULES = [
    *(("stack", k, "year") for k in ("minimum_year", "maximum_year", "reference_start_year", "reference_end_year", "era5_start_year")),
    *(("stack", k, "positive") for k in ("version", "interannual_rainfall_window_years", "stream_upstream_area_threshold_km2")),
    *(("grid", k, "positive") for k in ("pixel_size_meters", "tile_size_pixels")),
    *(("grid", k, "number") for k in ("origin_x", "origin_y")),
    *(("reference", k, "number") for k in ("grassland_probability", "human_modification", "human_influence")),
    *(("sampling", k, "positive") for k in ("block_size_meters", "samples_per_class_per_block")),
    ("sampling", "random_seed", "number"),
    *(("model", k, "positive") for k in ("fold_count", "validation_block_size_meters", "spline_knot_count")), ("model", "ridge_alpha", "not negative"),
    *(("model", k, "fraction") for k in ("minimum_predictor_coverage", "maximum_row_missing_fraction", "minimum_response_coverage")),
    *(("inference", k, "positive") for k in ("worker_count", "window_size_pixels")),
    ("inference", "covariance_shrinkage", "fraction"),
]


def _is(value, what: str) -> bool:
    if isinstance(value, bool) or not isinstance(value, int | float):
        return False
    return {"number": True, "positive": value > 0, "not negative": value >= 0, "fraction": 0 < value < 1, "year": isinstance(value, int) and 1900 <= value <= 2200}[what]


def short_id(text: str) -> str:
    """The id of a band given as a number, with or without its letter; any other text as it is."""
    number = text.removeprefix("d")
    return f"d{int(number):02d}" if number.isascii() and number.isdigit() else text


def load_analysis(path: str | Path) -> Analysis:
    path = Path(path)
    raw = tomllib.loads(path.read_text(encoding="utf-8"))
    wrong: list[str] = []
    need = lambda ok, text: None if ok else wrong.append(text)
    for name in ("analysis", "stack", "grid", "reference", "datasets", "sampling", "model", "inference"):
        need(isinstance(raw.get(name), dict), f"[{name}] is missing")
    need(isinstance(raw.get("bands"), list) and raw.get("bands"), "[[bands]] is missing")
    if wrong:
        raise ConfigurationError("\n".join(wrong))
    for section, key, what in _RULES:
        need(_is(raw[section].get(key), what), f"[{section}] {key} must be {what if what in ('positive', 'not negative') else 'a ' + what}")
    for section in ("analysis", "stack"):
        need(bool(_TITLE.fullmatch(str(raw[section].get("name")))), f"[{section}] name must be lower-case letters, digits, hyphens and underscores")
    if not wrong:
        stack, model, sampling = raw["stack"], raw["model"], raw["sampling"]
        need(stack["minimum_year"] <= raw["analysis"].get("year", 0) <= stack["maximum_year"], "[analysis] year is outside of the stack's years")
        need(stack["reference_start_year"] < stack["reference_end_year"], "[stack] the reference period needs two years at least")
        need(model["fold_count"] >= 2, "[model] fold_count must be 2 at least")
        need(model["spline_knot_count"] >= 2, "[model] spline_knot_count must be 2 at least")
        ratio = model["validation_block_size_meters"] / sampling["block_size_meters"]
        need(ratio >= 1 and ratio == int(ratio), "[model] validation_block_size_meters must be a whole multiple of the sampling block")
    inference = raw["inference"]
    need(("application_mask_path" in inference) == ("application_mask_label" in inference), "[inference] a mask needs a path and a label")
    fields = Band.__dataclass_fields__
    bands = []
    for i, b in enumerate(raw["bands"], 1):
        lost = [f for f in fields if f not in b]
        need(not lost, f"band {i} has no {', '.join(lost)}")
        if not lost:
            bands.append(Band(**{f: tuple(b[f]) if f == "sources" else b[f] for f in fields}))
    for b in bands:
        need(bool(_BAND.fullmatch(b.id)), f"band id {b.id!r} must be d and digits")
        need(bool(_NAME.fullmatch(b.computation)) and bool(_NAME.fullmatch(b.suffix)), f"{b.id}: computation and suffix must be names")
        need(b.role in ROLES, f"{b.id}: role must be one of {', '.join(ROLES)}")
        need(b.data_type in KINDS, f"{b.id}: data_type must be one of {', '.join(KINDS)}")
        lost = sorted(set(b.sources) - set(raw["datasets"]))
        need(not lost, f"{b.id}: undefined datasets {', '.join(lost)}")
    need(len({b.id for b in bands}) == len(bands), "band ids must be unique")
    need(sum(b.role == "reference" for b in bands) == 1, "exactly one band has the role reference")
    need(sum(b.role == "predictor" and b.data_type == "categorical" for b in bands) == 1, "exactly one predictor is categorical")
    known = {b.id for b in bands if b.role == "response"}
    asked = [short_id(str(r).strip().lower()) for r in raw["model"].get("responses", [])]
    need(not (lost := sorted(set(asked) - known)), f"[model] unknown responses {', '.join(lost)}")
    if wrong:
        raise ConfigurationError("\n".join(wrong))
    return Analysis(raw, path.parent, tuple(bands))
