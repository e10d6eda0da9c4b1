"""Near-duplicate groups by fast similarity sketching, banding and exact verification.

Sketch: in round i every shingle is placed in one hashed bin with a value in [i, i+1), bins keep their minimum, and the
rounds end when all bins are full; after as many rounds as there are bins the bin follows from the round, so every
coordinate fills. The sketch agrees in each coordinate with the probability of the similarity, with concentration bounds,
in time near linear in the shingles. Bands of coordinates name the buckets. With 44 bands of 8 a pair of
similarity 0.85 shares no bucket with a probability of 1e-6; for 0.8 66 bands are taken, with 5e-6.

Documents with equal shingle sets form a class and only one of each class goes on. Buckets are not expanded into pairs:

1. In every bucket each class is compared with one leader, the class that shares the most buckets (a star, linear in the
   bucket). Confirmed links give components.
2. Buckets that hold more than one component may hide further links. Their classes go through an exact prefix filter: with
   shingles ordered from rare to common, two sets that reach the similarity share a shingle of their prefixes, and have
   enough shingles that occur elsewhere at all. Shingles whose holders form one component are dropped, and of the others only
   classes outside of the largest component are compared with what stands across, first by a bound on what they can share
   that the counts of their shingles in hash cells give.
3. Components over all confirmed links.

Every link is confirmed on the full sets of 64-bit shingle hashes.

Defined results: null and empty texts have no shingles and are linked with nothing; a text of fewer words than a shingle is
one shingle. Rows with a null ``doc_id`` are not linked: their component is null and they are kept. Repeated rows share
their class. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meadowline.llm.common import as_bytes, blank_words, documents, located, materialize, rows_at, ship, side, slices

_U = np.uint64
_EMPTY = np.iinfo(np.uint64).max
_VALUE_BITS = 40
#: Hash cells of the bound on what two sets share.
CELLS = 64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    w = blank_words(text)
    if not w:
        return np.empty(0, dtype=np.uint64)
    h = np.array([xxhash.xxh3_64_intdigest(x) for x in w], dtype=np.uint64)
    if len(w) < words:  # the whole sequence is one shingle
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(w), seed=len(w))], dtype=np.uint64)
    n = len(w) - words + 1
    with np.errstate(over="ignore"):
        out = np.zeros(n, dtype=np.uint64)
        for k in range(words):
            out = _mix((out ^ h[k : k + n]) * _U(0x9E3779B97F4A7C15) + _U(k + 1))
    return np.unique(out)


def sketches(sets: list[np.ndarray], size: int) -> np.ndarray:
    """Fast similarity sketches of non-empty sets, one row each."""
    docs = len(sets)
    out = np.full(docs * size, _EMPTY, dtype=np.uint64)
    if not docs:
        return out.reshape(0, size)
    owner = np.repeat(np.arange(docs), [len(s) for s in sets])
    element = np.concatenate(sets)
    with np.errstate(over="ignore"):
        for i in range(2 * size):
            x = _mix(element ^ _mix(np.array([i + 1], dtype=np.uint64) * _U(0xD6E8FEB86659FD93)))
            place = ((x >> _U(_VALUE_BITS)) * _U(size) >> _U(64 - _VALUE_BITS)).astype(np.int64) if i < size else i - size
            value = (_U(i) << _U(_VALUE_BITS)) | (x & _U((1 << _VALUE_BITS) - 1))
            np.minimum.at(out, owner * size + place, value)
            open_docs = (out.reshape(docs, size) == _EMPTY).any(axis=1)
            keep = open_docs[owner]
            if not keep.all():
                owner, element = owner[keep], element[keep]
                if not len(owner):
                    break
    return out.reshape(docs, size)


def band_keys(sketch: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit bucket key for each band of each sketch."""
    n, size = sketch.shape
    rows = size // bands
    parts = sketch.reshape(n, bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (n, bands)).copy()
    with np.errstate(over="ignore"):
        for k in range(rows):
            out = _mix((out ^ parts[:, :, k]) * _U(0x9E3779B97F4A7C15) + _U(k + 1))
    return out


def _summaries(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """key, n (shingles), k (digest of the set), the bucket keys and the place of ``docs`` (key, text, file, position)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = [shingles(t, words) for t in as_bytes(part.column("text"))]
                full = [i for i, s in enumerate(sets) if len(s)]
                keys = band_keys(sketches([sets[i] for i in full], bands * rows), bands).view(np.int64)
                of = dict(zip(full, keys))
                digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                cells = [part.column("key"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array([of.get(i) for i in range(len(sets))], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*cells, part.column("file"), part.column("position")], names=["key", "n", "k", "buckets", "file", "position"])

    return docs.mapInArrow(run, f"key {docs.schema['key'].dataType.simpleString()}, n long, k binary, buckets array<long>, file string, position long")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """k and the sorted shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = [shingles(t, words) for t in as_bytes(part.column("text"))]
                cells = [pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cells, names=["k", "s"])

    return docs.select("text").mapInArrow(run, "k binary, s array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct pairs (x, y) whose sets reach the similarity."""
    a, b = sets.select(F.col("k").alias("x"), F.col("s").alias("xs")), sets.select(F.col("k").alias("y"), F.col("s").alias("ys"))
    met = pairs.join(a, "x").join(b, "y").select("x", "y", F.size("xs").alias("nx"), F.size("ys").alias("ny"), F.size(F.array_intersect("xs", "ys")).alias("both"))
    return met.where(f"100L * both >= {percent}L * (nx + ny - both)").select("x", "y")


def components(links: DataFrame) -> DataFrame:
    """k and root (the smallest k reachable) for every k in ``links`` (x, y), by alternating large and small stars.

    Each round cuts its lineage with a written table; what reaches the driver is two numbers a round."""
    both = lambda e: e.select(F.col("x").alias("u"), F.col("y").alias("v")).unionByName(e.select(F.col("y").alias("u"), F.col("x").alias("v")))
    edges = materialize(links.where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct())
    before = None
    while True:
        # Large star: what is larger than u among its neighbours hangs on the smallest of u and its neighbours.
        near = both(edges)
        low = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = near.where("v > u").join(low, "u").select(F.col("v").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        # Small star: u and its smaller neighbours hang on the smallest of them.
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(low, "x").select(F.when(F.col("y") == F.col("m"), F.col("x")).otherwise(F.col("y")).alias("x"), F.col("m").alias("y")).distinct()
        edges = materialize(small)
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)")).alias("h")).collect()[0]
        if now == before:
            break
        before = now
    return edges.select(F.col("x").alias("k"), F.col("y").alias("root")).unionByName(edges.select(F.col("y").alias("k"), F.col("y").alias("root")).distinct())


def _rest(held: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs that buckets with several components may hide, by the exact prefix filter. ``held``: bucket, k, n."""
    root = F.coalesce("root", "k").alias("root")
    marked = held.join(roots, "k", "left").select("bucket", "k", root)
    mixed = marked.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("bucket")
    active = materialize(marked.join(mixed, "bucket", "left_semi").select("k", "root").distinct())
    tokens = active.join(sets, "k").select("k", "root", F.size("s").cast("long").alias("n"), F.explode("s").alias("t"))
    # Written first, so that the join's two sides are dealt by themselves and a hot shingle's rows can be split among tasks.
    count = materialize(tokens.groupBy("t").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    shared = tokens.join(count, "t")
    # Per class: shingles that occur elsewhere, from rare to common; those of the prefix that are left after the unique ones.
    own = shared.groupBy("k", "root", "n").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("ts")).withColumn("m", F.size("ts").cast("long"))
    prefix = f"n - cast(ceil({percent} * n / 100.0) AS long) + 1 - (n - m)"
    able = materialize(own.where(f"100 * m >= {percent} * n AND {prefix} > 0").select("k", "root", "n", "m", F.expr(f"transform(slice(ts, 1, int(least(m, {prefix}))), x -> x.t)").alias("first"), F.expr(f"transform(ts, x -> int(pmod(x.t, {CELLS})))").alias("cells")))
    rows = able.select("k", "root", "n", "m", F.explode("first").alias("t"))
    by_root = rows.groupBy("t", "root").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("low"))
    tops = by_root.groupBy("t").agg(F.max(F.struct("c", "root")).alias("top"), F.count(F.lit(1)).alias("roots"), F.min("low").alias("low")).where("roots > 1").select("t", F.col("top.root").alias("top"), "low")
    tops = side(materialize(tops))
    # inter >= p/(100+p) * (n + n'), and inter is at most the number of shingles that occur elsewhere.
    enough = lambda m, n, other: f"{100 + percent} * {m} >= {percent} * ({n} + {other})"
    live = materialize(rows.join(tops, "t").where(enough("m", "n", "low")))
    # How many of a class' shingles fall into each of a number of hash cells: two sets share at most the sum of the minima.
    counts = able.join(live.select("k").distinct(), "k", "left_semi").select("k", F.expr(f"transform(sequence(0, {CELLS - 1}), c -> size(filter(cells, x -> x = c)))").alias("v"))
    live = live.join(counts, "k")
    out = live.where("root <> top").select("t", F.col("k").alias("x"), F.col("root").alias("xr"), F.col("n").alias("xn"), F.col("m").alias("xm"), F.col("v").alias("xv"))
    across = live.select("t", F.col("k").alias("y"), F.col("root").alias("yr"), F.col("n").alias("yn"), F.col("m").alias("ym"), F.col("v").alias("yv"), "top")
    most = "aggregate(zip_with(xv, yv, (a, b) -> least(a, b)), 0, (s, a) -> s + a)"
    fits = " AND ".join(["xr <> yr", "(yr = top OR x < y)", enough("xm", "xn", "yn"), enough("ym", "xn", "yn"), f"100 * least(xn, yn) >= {percent} * greatest(xn, yn)", enough(most, "xn", "yn")])
    pairs = out.join(across, "t").where(fits)
    return pairs.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()


def groups(docs: DataFrame, key, words: int = 5, percent: int = 80, bands: int = 66, rows: int = 8) -> DataFrame:
    """key, n, component (smallest key reachable, null where the row is linked with nothing) and place of each row of ``docs``,
    whose rows are told apart by ``key``; null keys take no part."""
    ship(docs.sparkSession)
    docs, file, position = located(docs)
    key = key(file, position)
    base = materialize(_summaries(docs.select(key.alias("key"), "text", file.alias("file"), position.alias("position")), words, bands, rows))
    filled = base.where("k IS NOT NULL AND key IS NOT NULL")
    classes = materialize(filled.groupBy("k").agg(F.min("key").alias("rep"), F.min(F.struct("file", "position")).alias("place"), F.count(F.lit(1)).alias("size"), F.first("n").alias("n"), F.first("buckets").alias("buckets")))
    spread = classes.select(F.explode("buckets").alias("bucket"), "k", "n")
    common = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    held = materialize(spread.join(common, "bucket"))
    # The class that shares the most buckets leads.
    weight = held.groupBy("k").agg(F.sum("c").alias("w"))
    led = held.join(weight, "k").groupBy("bucket").agg(F.max(F.struct("w", "k", "n")).alias("lead"))
    stars = held.join(led, "bucket").where("k <> lead.k").where(f"100 * least(n, lead.n) >= {percent} * greatest(n, lead.n)")
    pairs = stars.select(F.col("k").alias("x"), F.col("lead.k").alias("y")).distinct()
    # One text of each class that shares a bucket, fetched by its place.
    reps = classes.join(held.select("k").distinct(), "k", "left_semi").select("place.*")
    sets = materialize(_sets(rows_at(docs, file, position, reps, [F.col("text")]), words).dropDuplicates(["k"]))
    links = materialize(_confirmed(pairs, sets, percent))
    roots = materialize(components(links))
    more = _confirmed(_rest(held, roots, sets, percent), sets, percent)
    roots = materialize(components(links.unionByName(more)))
    # Rows of linked classes get the smallest key of their component, those of larger classes that of their class.
    named = classes.join(roots, "k", "left").where("root IS NOT NULL OR size > 1").select("k", "rep", F.coalesce("root", "k").alias("root"))
    lowest = named.groupBy("root").agg(F.min("rep").alias("component"))
    map_ = side(materialize(named.join(lowest, "root").select("k", "component")))
    return base.join(map_, "k", "left").select("key", "n", F.when(F.col("key").isNotNull(), F.col("component")).alias("component"), "file", "position")


def near_dedup(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 66, rows: int = 8) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept: one row per document."""
    found = groups(docs.selectExpr("cast(doc_id AS long) doc_id", "text"), lambda *_: F.col("doc_id"), words, percent, bands, rows)
    component = F.coalesce("component", "key")
    return found.select(F.col("key").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("key").isNull() | (F.col("key") == component)).alias("kept"))


def stay(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 66, rows: int = 8) -> DataFrame:
    """One row of each group, with all columns. Rows are told apart by where they lie, so null and repeated ids make no difference."""
    docs, file, position = located(docs)
    found = groups(docs.select("text"), lambda f, p: F.concat(f, F.lit(":"), p), words, percent, bands, rows)
    gone = found.where("key <> component").select("file", "position")
    return rows_at(docs, file, position, gone, [docs[c] for c in docs.columns], inside=False)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir).select("doc_id", "text"), words=3, percent=85, bands=44)
