"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]): all pairs of features interact
through vectors of low rank, at a cost linear in a document's features.

Features are whether a hashed word occurs (scaled so that a document's words have unit length together), binned structure
statistics of the text, and the document's length as metadata, counted from the text. Labels, language, source and ``doc_id`` are no features.

The machine is fitted on at most ``sample_rows`` labelled documents, those whose ids hash lowest; documents whose
crc32(doc_id as text) is divisible by 5 are held out. Everything else reads all documents.

Defined results: null and empty texts are scored from their statistics (all zero). With fewer than 20 labelled documents or
one label only, every score is the mean label, 0.5 without any. Rows with null or repeated ``doc_id`` are each scored; a
null id is not held out. A document with several labels is learnt from each; of documents that share an id one is learnt
from. Other columns are ignored, and kept by ``with_score`` and ``accepted``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meadowline.llm.common import as_bytes, ascii_words, documents, lowest, ship, slices

WORD_SPACE = 1 << 15
BINS = 12
STATS = 14
SPACE = WORD_SPACE + STATS * BINS
SAMPLE_ROWS = 8000

_CODES = np.arange(256)
_UPPER, _LOWER, _DIGIT = (_CODES >= 65) & (_CODES <= 90), (_CODES >= 97) & (_CODES <= 122), (_CODES >= 48) & (_CODES <= 57)
_BLANK, _WIDE = (_CODES == 32) | ((_CODES >= 9) & (_CODES <= 13)), _CODES >= 128
_MARK = ~(_UPPER | _LOWER | _DIGIT | _BLANK | _WIDE)


def statistics(text: bytes, hashes: np.ndarray, n_chars: int) -> np.ndarray:
    """Structure statistics in [0, 1]."""
    out = np.zeros(STATS)
    out[13] = min(1.0, np.log2(1 + max(0, n_chars)) / 20)
    if not text:
        return out
    data = np.frombuffer(text, dtype=np.uint8)
    counts = np.bincount(data, minlength=256)
    n, words, letters = len(data), len(hashes), int(counts[_UPPER | _LOWER | _WIDE].sum())
    same = data[1:] == data[:-1]
    lines = [x for x in text.split(b"\n") if x]
    marks = counts[_MARK].sum()
    out[0] = marks / n
    out[1] = counts[_DIGIT].sum() / n
    out[2] = counts[_UPPER].sum() / max(1, letters)
    out[3] = counts[_BLANK].sum() / n
    out[4] = min(1.0, letters / max(1, words) / 20)
    out[5] = (same & _MARK[data[1:]]).sum() / n * 4
    out[6] = len(np.unique(hashes)) / max(1, words)
    out[7] = (hashes[1:] == hashes[:-1]).mean() if words > 1 else 0.0
    out[8] = 1 - len(set(lines)) / len(lines) if lines else 0.0
    out[9] = min(1.0, words / max(1, len(lines)) / 100)
    out[10] = counts[_MARK].max() / n * 4
    out[11] = (counts[[44, 46]].sum() / max(1, marks)) if marks else 0.0
    out[12] = min(1.0, np.log2(1 + words) / 16)
    return np.minimum(out, 1.0)


def features(texts: list[bytes], lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, feature numbers and values of a number of documents."""
    hashes = [np.array([zlib.crc32(w) for w in ascii_words(t)], dtype=np.int64) for t in texts]
    sizes = np.array([len(h) for h in hashes], dtype=np.int64)
    key = np.unique(np.repeat(np.arange(len(texts)), sizes) * WORD_SPACE + (np.concatenate(hashes) if hashes else np.empty(0, np.int64)) % WORD_SPACE)
    rows, cols = key // WORD_SPACE, key % WORD_SPACE
    distinct = np.bincount(rows, minlength=len(texts))
    values = 1.0 / np.sqrt(np.maximum(distinct[rows], 1))
    stats = np.array([statistics(t, h, n) for t, h, n in zip(texts, hashes, lengths)]).reshape(len(texts), STATS)
    bins = np.minimum((np.sqrt(stats) * BINS).astype(np.int64), BINS - 1) + np.arange(STATS) * BINS + WORD_SPACE
    rows = np.concatenate((rows, np.repeat(np.arange(len(texts)), STATS)))
    return rows, np.concatenate((cols, bins.ravel())), np.concatenate((values, np.full(bins.size, 0.5)))


@dataclass
class FactorisationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margin(self, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        out = self.bias + np.bincount(rows, self.linear[cols] * values, minlength=n)
        for f in range(self.factors.shape[1]):
            vx = self.factors[cols, f] * values
            out += 0.5 * (np.bincount(rows, vx, minlength=n) ** 2 - np.bincount(rows, vx * vx, minlength=n))
        return out

    def score(self, rows, cols, values, n: int) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(rows, cols, values, n), -30, 30)))


def learn(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, labels: np.ndarray, rank: int = 6, epochs: int = 12, steps: int = 400, rate: float = 0.15, decay: float = 2e-5, seed: int = 5) -> FactorisationMachine:
    """Logistic loss by mini-batches, ``epochs`` times over the rows and ``steps`` batches at least; each weight's step
    follows its past gradients."""
    rng = np.random.default_rng(seed)
    fm = FactorisationMachine(float(np.log((labels.mean() + 1e-3) / (1 - labels.mean() + 1e-3))), np.zeros(SPACE), rng.normal(0, 0.02, (SPACE, rank)))
    order = np.argsort(rows, kind="stable")
    rows, cols, values = rows[order], cols[order], values[order]
    starts = np.searchsorted(rows, np.arange(len(labels) + 1))
    g_linear, g_factors, g_bias, size = np.full(SPACE, 1e-3), np.full((SPACE, rank), 1e-3), 1e-3, 64
    for _ in range(max(epochs, -(-steps * size // len(labels)))):
        shuffled = rng.permutation(len(labels))
        for b in range(0, len(labels), size):
            docs = shuffled[b : b + size]
            take = np.concatenate([np.arange(starts[d], starts[d + 1]) for d in docs])
            r, c, x = np.repeat(np.arange(len(docs)), starts[docs + 1] - starts[docs]), cols[take], values[take]
            error = fm.score(r, c, x, len(docs)) - labels[docs]
            used, at = np.unique(c, return_inverse=True)
            gradient = np.bincount(at, error[r] * x) / len(docs) + decay * fm.linear[used]
            g_linear[used] += gradient**2
            moves = [(fm.linear, used, rate * gradient / np.sqrt(g_linear[used]))]
            for f in range(rank):
                v = fm.factors[c, f]
                total = np.bincount(r, v * x, minlength=len(docs))
                gradient = np.bincount(at, error[r] * x * (total[r] - v * x)) / len(docs) + decay * fm.factors[used, f]
                g_factors[used, f] += gradient**2
                moves.append((fm.factors[:, f], used, 0.3 * rate * gradient / np.sqrt(g_factors[used, f])))
            for weights, which, step in moves:
                weights[which] -= step
            g_bias += error.mean() ** 2
            fm.bias -= rate * error.mean() / np.sqrt(g_bias)
    return fm


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def _features_of(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of a slice of documents."""
    lengths = pc.utf8_length(part.column("text")).cast(pa.int64())
    return features(as_bytes(part.column("text")), lengths.fill_null(0).to_pylist())


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> FactorisationMachine:
    """Fit on a bounded sample of the labelled documents that are not held out."""
    ship(docs.sparkSession)
    known = labels.selectExpr("cast(doc_id AS long) doc_id", "double(quality) label").where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    some = lowest(known.groupBy("doc_id", "label").count().drop("count"), sample_rows, F.xxhash64("doc_id"), "doc_id", "label")  # at most sample_rows small rows: safe to broadcast
    met = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some), "doc_id")
    # Of documents that share an id one is taken, so that what is learnt from, and reaches the driver, has sample_rows rows at most.
    one = met.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("r"))
    rows = one.select("r.text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                r, c, x = _features_of(part)
                order = np.argsort(r, kind="stable")
                cuts = np.searchsorted(r[order], np.arange(part.num_rows + 1)).astype(np.int32)
                cells = [part.column("label"), pa.ListArray.from_arrays(pa.array(cuts), pa.array(c[order].astype(np.int32))), pa.ListArray.from_arrays(pa.array(cuts), pa.array(x[order].astype(np.float32)))]
                yield pa.RecordBatch.from_arrays(cells, names=["label", "c", "x"])

    table = rows.mapInArrow(run, "label double, c array<int>, x array<float>").toArrow().combine_chunks()
    y = np.asarray(table.column("label")) if table.num_rows else np.empty(0)
    if len(y) < 20 or len(np.unique(y)) < 2:
        mean = float(y.mean()) if len(y) else 0.5
        return FactorisationMachine(float(np.log((mean + 1e-9) / (1 - mean + 1e-9))), np.zeros(SPACE), np.zeros((SPACE, 1)))
    c, x = table.column("c").combine_chunks(), table.column("x").combine_chunks()
    c, x = (a.chunk(0) if isinstance(a, pa.ChunkedArray) else a for a in (c, x))
    sizes = np.diff(np.asarray(c.offsets))
    return learn(np.repeat(np.arange(len(y)), sizes), np.asarray(c.flatten()).astype(np.int64), np.asarray(x.flatten()).astype(np.float64), y)


def with_score(docs: DataFrame, model: FactorisationMachine, name: str = "_score") -> DataFrame:
    """The documents with their score in a further column."""
    if name in docs.columns:
        raise ValueError(f"there is a column {name} already")
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                score = sent.value.score(*_features_of(part), part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], names=[*part.schema.names, name])

    return docs.mapInArrow(run, docs.withColumn(name, F.lit(0.0)).schema)


def accepted(docs: DataFrame, model: FactorisationMachine, threshold: float = 0.3) -> DataFrame:
    """The documents whose score reaches the threshold, with their columns and no other."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(sent.value.score(*_features_of(part), part.num_rows) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = with_score(docs.select("doc_id", "text"), fit(docs, labels, sample_rows))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
