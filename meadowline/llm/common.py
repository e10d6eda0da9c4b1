"""What the text operators share: the shared scratch folder, bounded Arrow slices and two byte-level tokenisers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meadowline.shipping import ship

#: The largest piece of text, in bytes, that one pass of a Python task holds besides a single longer document.
SLICE_BYTES = 2 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Fixed values of the word definition: digits, letters and everything beyond ASCII belong to words.
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def ascii_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of UTF-8 text after lower-casing A-Z."""
    return text.translate(_WORD).split()


def blank_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 text after lower-casing A-Z."""
    return text.translate(_LOWER).split()


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the cluster's ``spark.checkpoint.dir``. Where none is named a temporary one is set if everything runs
    on this machine; on a cluster, whose executors would not see it, that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/meadowline/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a lineage cut that survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Narrow rows that are broadcast at most; a larger side is joined by a shuffle.
BROADCAST_ROWS = 200_000


def side(df: DataFrame) -> DataFrame:
    """A written table of narrow rows as one side of a join: broadcast if it has at most ``BROADCAST_ROWS`` rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def lowest(df: DataFrame, n: int, *columns) -> DataFrame:
    """The ``n`` lowest rows by ``columns``. They are found within groups of tasks first, so that no task sees ``n`` rows of each."""
    order = [F.col(c) if isinstance(c, str) else c for c in columns]
    near = df.withColumn("_group", F.spark_partition_id() % 256).withColumn("_rank", F.row_number().over(Window.partitionBy("_group").orderBy(*order)))
    return near.where(F.col("_rank") <= n).drop("_group", "_rank").orderBy(*order).limit(n)


def located(docs: DataFrame) -> tuple[DataFrame, Column, Column]:
    """``docs`` as read from Parquet files, and columns of the file and the position in it that tell each row from all others.
    What is not read from files is written first. Columns of ``docs`` may have any name, that of Spark's hidden one as well."""
    try:
        hidden = docs.metadataColumn("_metadata")
        docs.select(hidden["file_path"], hidden["row_index"]).schema
    except AnalysisException:
        docs = materialize(docs)
        hidden = docs.metadataColumn("_metadata")
    return docs, hidden["file_path"], hidden["row_index"]


#: Entries of 64 rows each that are sent to a scan at once: some 100 MB in a task's memory.
PLACE_WORDS = 1 << 20


def rows_at(docs: DataFrame, file: Column, position: Column, places: DataFrame, columns: list[Column], inside: bool = True) -> DataFrame:
    """``columns`` of the rows of ``docs`` (see ``located``) that lie at ``places`` (file, position) or, with ``inside`` false, of all others.

    No row of ``docs`` is shuffled, however many places there are: they become bits, one entry for 64 rows of a file, and are sent
    to the scans. Where there are more than ``PLACE_WORDS`` entries, files are dealt into groups by hash, and each group's scan,
    which reads its files alone, gets its own entries; within a group rows are dealt in the same way, should one file ask for it.
    Files are told apart by 96 bits of hash."""
    name = lambda f: (F.xxhash64(f), F.crc32(f.cast("binary")))
    h, crc = name(F.col("file"))
    words = places.select(h.alias("_h"), crc.alias("_crc"), F.shiftright("position", 6).alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("position").bitwiseAND(F.lit(63)).cast("int")).alias("_bit"))
    words = materialize(words.groupBy("_h", "_crc", "_word").agg(F.bit_or("_bit").alias("_bits")))
    groups = max(1, -(-words.count() // PLACE_WORDS))
    counts = {r["_g"]: r["count"] for r in words.groupBy(F.pmod(F.col("_h"), F.lit(groups)).alias("_g")).count().collect()}  # as many as groups
    fh, fcrc = name(file)
    word, found = F.shiftright(position, 6), []
    for g in range(groups):
        splits = max(1, -(-counts.get(g, 0) // PLACE_WORDS))
        for k in range(splits):
            scan, mine = docs, words
            if groups > 1:
                scan, mine = scan.where(F.pmod(fh, F.lit(groups)) == g), mine.where(F.pmod(F.col("_h"), F.lit(groups)) == g)
            if splits > 1:
                scan, mine = scan.where(F.pmod(word, F.lit(splits)) == k), mine.where(F.pmod(F.col("_word"), F.lit(splits)) == k)
            rows = scan.select(F.struct(*columns).alias("_row"), fh.alias("_h"), fcrc.alias("_crc"), word.alias("_word"), position.bitwiseAND(F.lit(63)).cast("int").alias("_at"))
            joined = rows.join(F.broadcast(mine), ["_h", "_crc", "_word"], "inner" if inside else "left")
            hit = F.getbit("_bits", "_at") == 1
            found.append(joined.where(hit if inside else F.coalesce(~hit, F.lit(True))).select("_row.*"))
    return reduce(DataFrame.unionAll, found)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece has at most ``limit`` bytes of text, or one row."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).tolist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def give_back() -> None:
    """Return to the system what finished batches have left in this Python worker, which lives on beside others."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library is another one
        ctypes.CDLL(None).malloc_trim(0)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file is; ``PUBLIC_TOKENIZERS`` names another folder."""
    folder = os.environ.get("PUBLIC_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
