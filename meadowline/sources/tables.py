"""Readers and writers: pixel tables, areas of interest, model tables, manifests, and writes with provenance."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meadowline.functions.columns import valid
from meadowline.functions.grid import Grid, epsg, project, tile_id
from meadowline.operators.models import ResponseModel
from meadowline.sources.config import Analysis

_GEOMETRY = "type: string, coordinates: string"
_COLLECTION = f"type string, crs struct<properties:struct<name:string>>, properties map<string,string>, coordinates string, geometry struct<{_GEOMETRY}, geometries:array<struct<{_GEOMETRY}>>>, geometries array<struct<{_GEOMETRY}>>, features array<struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string,geometries:array<struct<{_GEOMETRY}>>>>>"
_RING = "array<array<double>>"


def read_features(spark: SparkSession, path: str, target: str, whole: bool = True) -> DataFrame:
    """feature, properties and polygons of a GeoJSON file, in the coordinates of ``target``; each feature in one row.

    Coordinates are degrees unless the file's ``crs`` names another system; the points of rings are projected, and edges are
    straight between them. With ``whole`` false the file has a feature on each line, so that it is read in parts. Anything but
    closed rings of four points at least raises."""
    lines = spark.read.text(path, wholetext=whole).where(F.length(F.trim("value")) > 0)
    doc = lines.select(F.from_json("value", _COLLECTION).alias("d")).select("d.*")
    own = F.struct(F.lit("Feature").alias("type"), "properties", F.struct(F.coalesce("geometry.type", "type").alias("type"), F.coalesce("geometry.coordinates", "coordinates").alias("coordinates"), F.coalesce("geometry.geometries", "geometries").alias("geometries")).alias("geometry"))
    rows = doc.select(F.coalesce("crs.properties.name", F.lit("EPSG:4326")).alias("crs"), F.posexplode(F.coalesce("features", F.array(own))).alias("_at", "_f"))
    shapes = F.when(F.col("_f.geometry.type") == "GeometryCollection", F.col("_f.geometry.geometries")).otherwise(F.array(F.struct("_f.geometry.type", "_f.geometry.coordinates")))
    single, many = (lambda g: F.array(F.from_json(g.coordinates, f"array<{_RING}>"))), (lambda g: F.from_json(g.coordinates, f"array<array<{_RING}>>"))
    rings = F.flatten(F.transform(shapes, lambda g: F.when(g.type == "Polygon", single(g)).when(g.type == "MultiPolygon", many(g))))
    found = rows.select("crs", (F.monotonically_increasing_id() if not whole else F.col("_at").cast("long")).alias("feature"), F.coalesce("_f.properties", F.create_map().cast("map<string,string>")).alias("properties"), rings.alias("_rings"))
    bad = F.exists("_rings", lambda p: (F.size(p) < 1) | F.exists(p, lambda ring: (F.size(ring) < 4) | (F.element_at(ring, 1) != F.element_at(ring, -1)) | F.exists(ring, lambda q: F.coalesce(F.size(q) < 2, F.lit(True)))))
    seen = found.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce((F.size("_rings") < 1) | bad, F.lit(True))).alias("bad"), F.collect_set("crs").alias("crs")).collect()[0]
    if not seen.n or seen.bad or len(seen.crs) != 1:
        raise ValueError("an area needs polygons only, with closed rings of four points at least, in one coordinate system")

    def moved(q: Column) -> Column:
        x, y = project(F.get(q, 0), F.get(q, 1), seen.crs[0], target)
        return F.struct(x.alias("x"), y.alias("y"))

    return found.select("feature", "properties", F.transform("_rings", lambda p: F.transform(p, lambda ring: F.transform(ring, moved))).alias("polygons"))


def read_pixels(spark: SparkSession, path: str, bands: Sequence[str] | None = None, keys: Sequence[str] = ("tile_col", "tile_row", "local_row", "local_col")) -> DataFrame:
    """A pixel table with only the bands asked for, invalid values as NULL."""
    df = spark.read.parquet(path)
    bands = [c for c in df.columns if c not in keys] if bands is None else list(bands)
    return df.select(*keys, *(valid(F.col(b).cast("double")).alias(b) for b in bands))


def read_mask(spark: SparkSession, path: str) -> tuple[DataFrame, Grid | None]:
    """A mask and its grid: a pixel table, whose grid is the analysis' own (None), or a table of row, col and mask whose grid is
    described in a JSON record beside it."""
    df = spark.read.parquet(path)
    if {"row", "col"} <= set(df.columns):
        record = json.loads("".join(r.value for r in spark.read.text(f"{path}.grid").collect()))
        grid = Grid(record["crs"], *(float(record[k]) for k in ("left", "top", "width", "height")))
        epsg(grid.crs)
        if not (grid.width > 0 and grid.height > 0):
            raise ValueError(f"{path}: cells need a positive size")
        return df.select("row", "col", "mask"), grid
    return df.select("tile_col", "tile_row", "local_row", "local_col", "mask"), None


def write_mask(mask: DataFrame, path: str, grid: Grid) -> None:
    """A mask on a grid of its own: row, col, mask, and the grid's record."""
    mask.select("row", "col", "mask").write.mode("overwrite").parquet(path)
    mask.sparkSession.createDataFrame([(json.dumps(asdict(grid), sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.grid")


def write_pixels(df: DataFrame, path: str) -> None:
    """One folder per tile; writing a tile again replaces just that one."""
    df.repartition("tile_col", "tile_row").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("tile_col", "tile_row").parquet(path)


@dataclass
class Verified:
    rows: int
    columns: list[str]
    provenance: dict


def write_with_provenance(df: DataFrame, path: str, provenance: dict) -> Verified:
    """Parquet with a JSON record beside it, read back: rows, columns and record must be what was written."""
    spark = df.sparkSession
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    record = json.dumps(provenance | {"columns": df.columns}, sort_keys=True)
    spark.createDataFrame([(record,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.provenance")
    back = spark.read.parquet(path)
    kept = json.loads("".join(r.value for r in spark.read.text(f"{path}.provenance").collect()))
    if back.columns != df.columns or kept != json.loads(record):
        raise OSError(f"{path} does not hold what was written")
    return Verified(back.count(), back.columns, kept)


def read_provenance(spark: SparkSession, path: str) -> dict:
    return json.loads("".join(r.value for r in spark.read.text(f"{path}.provenance").collect()))


def write_models(spark: SparkSession, models: Sequence[ResponseModel], path: str) -> None:
    spark.createDataFrame([(m.response, m.to_json()) for m in models], "response string, model string").coalesce(1).write.mode("overwrite").parquet(path)


def read_models(spark: SparkSession, path: str) -> list[ResponseModel]:
    """Models by response; each needs a positive out-of-fold error, and all the same predictors in the same order."""
    models = [ResponseModel.from_json(r.model) for r in spark.read.parquet(path).orderBy("response").collect()]
    if not models or any(not m.rmse or not 0 < m.rmse < float("inf") for m in models):
        raise ValueError("models need a finite, positive error")
    if len({(tuple(m.design.continuous), m.design.categorical) for m in models}) > 1:
        raise ValueError("models differ in their predictors")
    return models


# The manifest: one row for each tile that is in the cache.

MANIFEST = "stack string, tile_col long, tile_row long, rows long, sha string, bands array<string>, files string"
#: Of the cache's layout; a cache of another version is not read.
CACHE_VERSION = 2


def check_cache(spark: SparkSession, root: str, analysis: Analysis) -> None:
    """Write the cache's record of version and grid, or compare it."""
    record = {"version": CACHE_VERSION, "grid": analysis.section("grid"), "bands": analysis.band_names()}
    try:
        was = json.loads("".join(r.value for r in spark.read.text(f"{root}/cache").collect()))
    except AnalysisException:
        spark.createDataFrame([(json.dumps(record, sort_keys=True),)], "value string").coalesce(1).write.text(f"{root}/cache")
        return
    for what in ("version", "grid", "bands"):
        if was.get(what) != json.loads(json.dumps(record[what])):
            raise ValueError(f"the cache {root} has another {what}: {was.get(what)!r}")


def tile_files(spark: SparkSession, path: str, tiles: DataFrame) -> DataFrame:
    """tile_col, tile_row, file, length and sha of the files of these tiles, read as bytes: whether they are Parquet at all does
    not matter, and one that cannot be read is left out. Nothing where there is no such folder."""
    schema = "path string, modificationTime timestamp, length long, content binary, tile_col long, tile_row long"
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("ignoreCorruptFiles", "true").load(path)
    except AnalysisException:
        files = spark.createDataFrame([], schema)
    if "tile_col" not in files.columns:  # an empty folder
        files = spark.createDataFrame([], schema)
    found = files.join(F.broadcast(tiles.where("tile_col IS NOT NULL")), ["tile_col", "tile_row"], "left_semi")
    return found.select(F.col("tile_col").cast("long").alias("tile_col"), F.col("tile_row").cast("long").alias("tile_row"), F.col("path").alias("file"), "length", F.sha2("content", 256).alias("sha"))


def file_digests(files: DataFrame) -> DataFrame:
    """tile_col, tile_row and ``files``: one digest over the contents of a tile's files, which are few."""
    return files.groupBy("tile_col", "tile_row").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("sha")), ","), 256).alias("files"))


def sound_tiles(manifest: DataFrame, files: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Entries whose tile has the very files that were written for these bands; the others' tiles have to be made again."""
    now = file_digests(files).withColumnRenamed("files", "_files")
    return manifest.join(now, ["tile_col", "tile_row"]).where((F.col("files") == F.col("_files")) & (F.col("bands") == F.array(*map(F.lit, bands)))).drop("_files")


def cached_pixels(spark: SparkSession, path: str, bands: Sequence[str], tiles: DataFrame) -> DataFrame:
    """Pixels of these tiles of a cache. Its files are not looked at to find the columns, and those of other tiles are not
    opened, so that it does not matter what they hold."""
    schema = "local_row long, local_col long, " + ", ".join(f"{b} double" for b in bands) + ", tile_col long, tile_row long"
    try:
        df = spark.read.schema(schema).parquet(path)
    except AnalysisException:
        df = spark.createDataFrame([], schema)
    mine = df.join(F.broadcast(tiles.select("tile_col", "tile_row").where("tile_col > -9223372036854775807")), ["tile_col", "tile_row"], "left_semi")
    return mine.select("tile_col", "tile_row", "local_row", "local_col", *(valid(F.col(b)).alias(b) for b in bands))



def manifest_of(pixels: DataFrame, stack: str, bands: Sequence[str]) -> DataFrame:
    """Rows and an order-independent content hash of each tile: a sum, in which repeated rows count."""
    content = F.sha2(F.to_json(F.struct("local_row", "local_col", *bands)), 256)
    tiles = pixels.groupBy("tile_col", "tile_row").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.conv(F.substring(content, 1, 15), 16, 10).cast("decimal(20,0)")).alias("x"))
    return tiles.select(F.lit(stack).alias("stack"), "tile_col", "tile_row", "rows", F.col("x").cast("string").alias("sha"), F.array(*map(F.lit, bands)).alias("bands"))


def stack_totals(manifest: DataFrame) -> DataFrame:
    """Tiles, pixels and bytes (four for each pixel and band) of every stack."""
    return manifest.groupBy("stack").agg(F.count(F.lit(1)).alias("tiles"), F.sum("rows").alias("pixels"), F.sum(F.col("rows") * F.size("bands") * 4).alias("bytes"))


def newest(manifest: DataFrame) -> DataFrame:
    """The last entry of each tile; entries are only ever added, with the time in ``written``."""
    rest = [c for c in manifest.columns if c not in ("stack", "tile_col", "tile_row", "written")]
    last = manifest.groupBy("stack", "tile_col", "tile_row").agg(F.max_by(F.struct(*rest), "written").alias("s"))
    return last.select("stack", "tile_col", "tile_row", "s.*")


def sound_entries(manifest: DataFrame, pixels: DataFrame, stack: str, bands: Sequence[str]) -> DataFrame:
    """Entries of a stack whose tile is in the cache with the very content; the others' tiles have to be made again."""
    found = manifest_of(pixels, stack, bands).select("tile_col", "tile_row", F.col("rows").alias("_rows"), F.col("sha").alias("_sha"))
    same = (F.col("rows") == F.col("_rows")) & (F.col("sha") == F.col("_sha")) & (F.col("bands") == F.array(*map(F.lit, bands)))
    return manifest.where(F.col("stack") == stack).join(found, ["tile_col", "tile_row"]).where(same).drop("_rows", "_sha")


def missing_tiles(required: DataFrame, manifest: DataFrame, stack: str) -> DataFrame:
    return required.join(manifest.where(F.col("stack") == stack), ["tile_col", "tile_row"], "left_anti")


def check_tiles(required: DataFrame, pixels: DataFrame, manifest: DataFrame, stack: str, bands: Sequence[str], show: int = 5) -> DataFrame:
    """The required tiles with their manifest entries; raises with the number of failures and the first of them."""
    found = manifest_of(pixels, stack, bands).select("tile_col", "tile_row", F.col("rows").alias("_rows"), F.col("sha").alias("_sha"))
    joined = required.join(manifest.where(F.col("stack") == stack), ["tile_col", "tile_row"], "left").join(found, ["tile_col", "tile_row"], "left")
    why = (
        F.when(F.col("rows").isNull(), "not in the manifest").when(F.col("_rows").isNull(), "no pixels").when(F.col("rows") != F.col("_rows"), "other number of pixels")
        .when(F.col("bands") != F.array(*map(F.lit, bands)), "other bands").when(F.col("sha") != F.col("_sha"), "other content")
    )
    bad = joined.withColumn("why", why).where("why IS NOT NULL")
    first = bad.orderBy(F.desc("tile_row"), "tile_col").select(tile_id(F.col("tile_col"), F.col("tile_row")).alias("tile"), "why").limit(show).collect()
    if first:
        raise ValueError(f"{bad.count()} tiles fail: " + "; ".join(f"{r.tile}: {r.why}" for r in first))
    return joined.drop("_rows", "_sha")
