"""Centroid clustering: Lloyd's iterations in exact integers, sharded by dimension.

Vectors are cut into chunks of rows and blocks of columns; a record is one chunk's block as a matrix, and each block of columns
is a shard with its slice of the centroids. In a round the shards' tasks compute the partial squared distances of their columns
(chunk by centroids), which are added by chunk, and the smallest of each row is its cluster. The labels, a few bytes a vector, go
back to the shards, which sum their columns by cluster within a task, then across tasks, and divide: each shard makes its own
slice of the new centroids. Nothing depends on how often a vector occurs or how large a cluster is: chunks have equal size, and
a task sends one row of sums for each of its shards.

What passes through the driver is the centroids: clusters times dimensions, both parameters.

Defined results: vectors that are null, of another length, or with a null or non-finite component are left out. Components are
floor(64 x), held to +-2**27, so that every distance fits a long. Ties of distance go to the smaller number; ties of seeds (rows
that share an id) to the smaller vector; a null id comes last among the seeds. With fewer vectors than clusters there are as
many centroids as vectors. Repeated rows are clustered each. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meadowline.llm.common import materialize, ship

DIMENSIONS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 16, 3, 64, 1
BLOCK, CHUNK, MOST = 16, 4096, 1 << 27


def quantised(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id and the integer vector ``v`` of each row that is kept."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    finite = F.forall("_x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("_x")).where((F.size("_x") == dimensions) & finite)
    bound = float(MOST)
    return rows.select("vec_id", F.transform("_x", lambda e: F.floor(F.least(F.greatest(e * float(scale), F.lit(-bound)), F.lit(bound))).cast("long")).alias("v"))


def _as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(list(zip(*rows)) or [[]] * len(schema), schema)], schema=schema)


def sharded(kept: DataFrame, dimensions: int, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """chunk, shard, rows, data: one matrix of longs for each chunk and block of columns; shard -1 has the ids. Written, for
    chunk names are drawn by the attempt that is committed."""
    schema = pa.schema([("chunk", pa.string()), ("shard", pa.int32()), ("rows", pa.int32()), ("data", pa.binary()), ("ids", pa.list_(pa.int64()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, chunk):
                piece, name = batch.slice(start, chunk), uuid.uuid4().hex
                matrix = piece.column("v").flatten().to_numpy().reshape(-1, dimensions)
                out = [(name, -1, len(matrix), None, piece.column("vec_id").to_pylist())]
                out += [(name, s, len(matrix), np.ascontiguousarray(matrix[:, at : at + block]).tobytes(), None) for s, at in enumerate(range(0, dimensions, block))]
                yield _as_batch(out, schema)

    return materialize(kept.mapInArrow(cut, "chunk string, shard int, rows int, data binary, ids array<long>"))


def assign(shards: DataFrame, slices: list[np.ndarray]) -> DataFrame:
    """chunk, labels and distances (longs) of its rows, written: partial distances by shard, added up by chunk."""
    k = len(slices[0])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, shard, rows, data in zip(*(b.column(c).to_pylist() for c in ("chunk", "shard", "rows", "data"))):
                x, c = np.frombuffer(data, np.int64).reshape(rows, -1), slices[shard]
                d = np.empty((rows, k), np.int64)
                for j in range(k):
                    d[:, j] = np.square(x - c[j]).sum(axis=1)
                yield _as_batch([(chunk, rows, d.tobytes())], pa.schema([("chunk", pa.string()), ("rows", pa.int32()), ("d", pa.binary())]))

    def nearest(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(d.as_py(), np.int64).reshape(-1, k) for d in table.column("d"))  # a chunk's blocks: as many as shards
        labels = total.argmin(axis=1)
        return pa.table({"chunk": [key[0].as_py()], "labels": [labels.astype(np.int32).tobytes()], "distances": [total[np.arange(len(total)), labels].tobytes()]}, pa.schema([("chunk", pa.string()), ("labels", pa.binary()), ("distances", pa.binary())]))

    parts = shards.where("shard >= 0").mapInArrow(partial, "chunk string, rows int, d binary")
    return materialize(parts.groupBy("chunk").applyInArrow(nearest, "chunk string, labels binary, distances binary"))


def update(shards: DataFrame, assigned: DataFrame, slices: list[np.ndarray]) -> list[np.ndarray]:
    """The shards' new slices: floor of the mean of each cluster's rows, the old row where a cluster is empty."""
    k = len(slices[0])
    sums_schema = pa.schema([("shard", pa.int32()), ("sums", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        counts: dict[int, np.ndarray] = {}
        for b in batches:
            for shard, rows, data, labels in zip(*(b.column(c).to_pylist() for c in ("shard", "rows", "data", "labels"))):
                x, at = np.frombuffer(data, np.int64).reshape(rows, -1), np.frombuffer(labels, np.int32)
                s = sums.setdefault(shard, np.zeros((k, x.shape[1]), np.int64))
                for j in range(k):
                    s[j] += x[at == j].sum(axis=0)
                counts[shard] = counts.get(shard, 0) + np.bincount(at, minlength=k)
        yield _as_batch([(i, s.ravel().tolist(), counts[i].tolist()) for i, s in sums.items()], sums_schema)

    def divide(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        old, width = slices[shard], slices[shard].shape[1]
        counts, sums = [0] * k, [0] * (k * width)  # Python's integers: exact for any number of rows
        for row in table.to_pylist():  # one for each task
            counts, sums = [a + b for a, b in zip(counts, row["counts"])], [a + b for a, b in zip(sums, row["sums"])]
        new = [s // counts[i // width] if counts[i // width] else int(old[i // width, i % width]) for i, s in enumerate(sums)]
        return pa.table({"shard": [shard], "slice": [new]}, pa.schema([("shard", pa.int32()), ("slice", pa.list_(pa.int64()))]))

    labelled = shards.where("shard >= 0").join(assigned.select("chunk", "labels"), "chunk")
    made = labelled.select("shard", "rows", "data", "labels").mapInArrow(add, "shard int, sums array<long>, counts array<long>").groupBy("shard").applyInArrow(divide, "shard int, slice array<long>")
    found = {r.shard: np.array(r.slice, np.int64).reshape(k, -1) for r in made.collect()}  # the centroids
    return [found.get(i, old) for i, old in enumerate(slices)]


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, block: int = BLOCK, chunk: int = CHUNK) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster and squared distance of each kept vector, and the final centroids."""
    kept = quantised(vectors, dimensions)
    seed = F.sha2(F.concat(F.lit(f"{SEED}:"), F.col("vec_id").cast("string")), 256)
    seeds = [r.v for r in kept.orderBy(seed.asc_nulls_last(), "v").limit(clusters).collect()]
    if not seeds:
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), np.zeros((0, dimensions), np.int64)
    shards = sharded(kept, dimensions, block, chunk)
    centroids = np.array(seeds, np.int64)
    slices = [centroids[:, at : at + block] for at in range(0, dimensions, block)]
    assigned = assign(shards, slices)
    for _ in range(rounds):
        slices = update(shards, assigned, slices)
        assigned = assign(shards, slices)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                labels, distances = (np.frombuffer(b.column(c)[i].as_py(), t) for c, t in (("labels", np.int32), ("distances", np.int64)))
                yield pa.RecordBatch.from_arrays([b.column("ids")[i].values, pa.array(labels), pa.array(distances)], names=["vec_id", "cluster", "distance"])

    named = shards.where("shard = -1").select("chunk", "ids").join(assigned, "chunk").select("ids", "labels", "distances")
    return named.mapInArrow(rows, "vec_id long, cluster int, distance long"), np.concatenate(slices, axis=1)


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    found, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    found = materialize(found)
    sums = dict(found.groupBy("cluster").agg(F.sum("distance")).collect())  # a row for each cluster
    total = sum(sums.values())
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    known = spark.createDataFrame([(i, s, total, hashes[i]) for i, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    parts = [
        f"""k AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS})""",
        f"c0 AS (SELECT (row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), v) - 1)::INT AS c, v FROM k QUALIFY c < {CLUSTERS})",
    ]
    for i in range(ROUNDS + 1):
        parts.append(f"""a{i} AS (SELECT r, min(struct_pack(d := list_sum(list_transform(list_zip(k.v, c{i}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, c := c)) AS best FROM k, c{i} GROUP BY r)""")
        if i < ROUNDS:
            parts.append(f"""c{i + 1} AS (SELECT o.c, coalesce(m.v, o.v) AS v FROM c{i} o LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS v FROM
  (SELECT best.c AS c, j, sum(v[j]) AS s, count(*) AS n FROM k JOIN a{i} USING (r), (SELECT unnest(range(1, {DIMENSIONS + 1})) AS j) GROUP BY 1, 2) GROUP BY c) m ON m.c = o.c)""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, best.c AS cluster, best.d AS distance, sum(best.d) OVER (PARTITION BY best.c)::BIGINT AS cluster_inertia, sum(best.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c{ROUNDS}.v, ',')) AS centroid_sha256
FROM k JOIN a{ROUNDS} USING (r) JOIN c{ROUNDS} ON c{ROUNDS}.c = best.c"""


OP13_SQL = _sql()
