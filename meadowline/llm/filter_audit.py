"""Filter interaction audit: which documents five filters remove, in every order in which they can be applied.

Words and documents form a sparse matrix. Each task cuts its documents into blocks of bounded size and writes a block as one
compressed sparse row (CSR) shard over a dictionary of its own words, in which a word occurs once whatever its frequency. The
blocks' dictionaries are then unified: words are dealt to buckets by hash, a shard's words of a bucket travel as one row, and a
bucket's task numbers them in the order of the shards. The ids go back and rename the shards' columns. So no word is shuffled for
each of its occurrences, a frequent word has one entry a shard, and all buckets are alike. A bucket's task holds its own
words; ``buckets`` bounds them. Row sums and numbers of nonzero cells of the global shards are the words and distinct words
of a document and decide filters A and B; C and D come with the shard; E asks for the smallest ``doc_id`` of each text's digest.

The audit then needs only counts by part and set of failed filters, at most 32 of them a part: a filter removes in an order
what fails it and none before it.

Filters, as conditions of failure: A under 200 words; B 100 * distinct words < 50 * words; C 100 * ``[A-Z]`` characters >
3 * code points; D any of ``#$%&*|``; E a text identical to that of any smaller ``doc_id``, by SHA-256. Words are maximal runs
of ``[^\\x20\\x09-\\x0D]``, case-sensitive.

Defined results: null text counts as empty: it fails A and, but for the smallest ``doc_id``, E. A row with a null ``doc_id`` is
never a copy and makes none; of rows that share an id none is a copy of the other. Null and empty ``lang`` are one part. A
document counts as good or toxic when any of its label rows says so; without labels it is neither. A text longer than a block
is a block of its own. Empty tables give no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meadowline.llm.common import as_bytes, documents, materialize, ship, slices

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_UPPER_PERCENT, SPECIAL = 200, 50, 3, b"#$%&*|"

_UPPER = np.array([65 <= c <= 90 for c in range(256)])
_ODD = np.array([c in SPECIAL for c in range(256)])
_STARTS = np.array([c & 0xC0 != 0x80 for c in range(256)])  # bytes that begin a code point
#: Bytes of text of a block, besides a single longer document.
BLOCK_BYTES = 8 << 20
#: A shard: parallel lists of its documents, cells of row i from indptr[i] to indptr[i + 1]. ``cells`` packs differences of the
#: columns and then the counts; columns are ordered by bucket, and ``words`` has each bucket's, joined by blanks.
_DOCS = "shard string, doc_id array<long>, part array<string>, digest array<string>, n_chars array<long>, n_upper array<long>, special array<boolean>, indptr array<int>"
_ARROW = pa.schema([
    ("shard", pa.string()), ("doc_id", pa.list_(pa.int64())), ("part", pa.list_(pa.string())), ("digest", pa.list_(pa.string())), ("n_chars", pa.list_(pa.int64())),
    ("n_upper", pa.list_(pa.int64())), ("special", pa.list_(pa.bool_())), ("indptr", pa.list_(pa.int32())), ("cells", pa.binary()), ("words", pa.list_(pa.string())),
])


def _one(value, kind: pa.DataType) -> pa.Array:
    """A column of one row."""
    if not pa.types.is_list(kind):
        return pa.array([value], kind)
    values = value.cast(kind.value_type) if isinstance(value, pa.Array) else pa.array(value, kind.value_type)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _shard(piece: pa.RecordBatch, buckets: int) -> pa.RecordBatch:
    texts = as_bytes(piece.column("text"))
    edges = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)

    def within(table: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
        return upto[edges[1:]] - upto[edges[:-1]]

    words = [t.split() for t in texts]
    coded = pa.array(itertools.chain.from_iterable(words), pa.large_binary()).dictionary_encode()
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    del words
    names = coded.dictionary.to_pylist()
    bucket = np.fromiter((zlib.crc32(w) % buckets for w in names), np.int64, len(names))
    order = np.argsort(bucket, kind="stable")
    column = np.empty_like(order)
    column[order] = np.arange(len(order))
    width = max(1, len(names))
    cells, counts = np.unique(row * width + column[coded.indices.to_numpy()], return_counts=True)
    ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
    packed = np.concatenate([np.diff(cells % width, prepend=0), counts]).astype(np.int32).tobytes()
    values = [
        uuid.uuid4().hex, piece.column("doc_id"), piece.column("part"), [hashlib.sha256(t).hexdigest() for t in texts], within(_STARTS), within(_UPPER), within(_ODD) > 0,
        np.searchsorted(cells, np.arange(len(texts) + 1) * width), pa.compress(packed, "zstd", asbytes=True), [b" ".join([names[i] for i in order[a:b]]).decode() for a, b in zip(ends, ends[1:])],
    ]
    return pa.RecordBatch.from_arrays([_one(v, t.type) for v, t in zip(values, _ARROW)], schema=_ARROW)


def local_shards(docs: DataFrame, part: Column, buckets: int) -> DataFrame:
    """CSR shards over dictionaries of their own, written: shard names are drawn by the attempt that is committed."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, limit=BLOCK_BYTES):
                yield _shard(piece, buckets)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(part.cast("string"), F.lit("")).alias("part"), F.col("text"))
    return materialize(rows.mapInArrow(cut, f"{_DOCS}, cells binary, words array<string>"))


def unified(shards: DataFrame, buckets: int, listing: bool = False) -> DataFrame:
    """shard, bucket and ``ranks``: the places of the shard's words in their bucket's list of distinct words, as packed ints; with
    ``listing`` the dictionary itself, word and id. The order of the shards decides, so a task that is run again finds the same."""

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known = None, {}
        for batch in batches:
            out = []
            for shard, bucket, words in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != at:
                    at, known = bucket, {}
                size = len(known)
                ranks = [known.setdefault(w, len(known)) for w in words.split(" ")]
                if listing:
                    out += [(w, k * buckets + bucket) for w, k in itertools.islice(known.items(), size, None)]
                else:
                    out.append((shard, bucket, np.array(ranks, np.int32).tobytes()))
            names, kinds = (("word", "id"), (pa.string(), pa.int64())) if listing else (("shard", "bucket", "ranks"), (pa.string(), pa.int32(), pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * len(kinds), kinds)], names=list(names))

    entries = shards.select("shard", F.posexplode("words").alias("bucket", "words")).where("words <> ''")
    dealt = entries.repartition(buckets, "bucket").sortWithinPartitions("bucket", "shard")
    return dealt.mapInArrow(rank, "word string, id long" if listing else "shard string, bucket int, ranks binary")


def bucket_count(spark: SparkSession) -> int:
    """Buckets of the dictionary: as many as shuffles have partitions, within bounds."""
    return max(16, min(4096, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def csr_shards(docs: DataFrame, part: Column | None = None, buckets: int | None = None) -> DataFrame:
    """The corpus as CSR shards over one dictionary, written: the documents' own columns, indptr, indices (word ids), counts."""
    buckets = buckets or bucket_count(docs.sparkSession)
    shards = local_shards(docs, F.lit("") if part is None else part, buckets)
    ids = unified(shards, buckets).groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("bucket", "ranks"))).alias("_ids"))

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                n = one.column("indptr")[0].values[-1].as_py()
                packed = np.frombuffer(pa.decompress(one.column("cells")[0].as_py(), 8 * n, "zstd", asbytes=True), np.int32)
                columns = [np.frombuffer(e["ranks"], np.int32).astype(np.int64) * buckets + e["bucket"] for e in one.column("_ids")[0].as_py() or []]
                indices = np.concatenate(columns)[np.cumsum(packed[:n])] if n else np.zeros(0, np.int64)
                own = [one.column(t.name) for t in list(_ARROW)[:8]]
                yield pa.RecordBatch.from_arrays([*own, _one(indices, pa.list_(pa.int64())), _one(packed[n:], pa.list_(pa.int32()))], names=[*(t.name for t in list(_ARROW)[:8]), "indices", "counts"])

    return materialize(shards.drop("words").join(ids, "shard", "left").mapInArrow(rename, f"{_DOCS}, indices array<long>, counts array<int>"))


def flags(shards: DataFrame) -> DataFrame:
    """One row per document of global shards: doc_id, part, n_words, n_distinct, and whether it fails A, B, C, D and E."""
    at = F.sequence(F.lit(0), F.size("doc_id") - 1)
    cells = lambda i: F.slice("counts", F.get("indptr", i) + 1, F.get("indptr", i + 1) - F.get("indptr", i))
    row = lambda i: F.struct(
        *(F.get(c, i).alias(c) for c in ("doc_id", "part", "digest", "n_chars", "n_upper", "special")),
        F.aggregate(cells(i), F.lit(0).cast("long"), lambda a, x: a + x).alias("n_words"),
        (F.get("indptr", i + 1) - F.get("indptr", i)).cast("long").alias("n_distinct"),
    )
    rows = shards.select(F.inline(F.transform(at, row)))
    # Texts that occur once need no look-up; a frequent text's rows are split by the skew join, its group is summed before the shuffle.
    first = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("_copies"), F.min("doc_id").alias("_first")).where("_copies > 1").select("digest", "_first")
    return rows.join(first, "digest", "left").select(
        "doc_id", "part", "n_words", "n_distinct", (F.col("n_words") < LEAST_WORDS).alias("A"), (100 * F.col("n_distinct") < LEAST_DISTINCT_PERCENT * F.col("n_words")).alias("B"),
        (100 * F.col("n_upper") > MOST_UPPER_PERCENT * F.col("n_chars")).alias("C"), F.col("special").alias("D"), F.coalesce(F.col("doc_id") > F.col("_first"), F.lit(False)).alias("E"),
    )


def audit(flagged: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of that step, for every part and all orders of the filters."""
    says = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    mask = sum((F.col(f).cast("int") * (1 << i) for i, f in enumerate(FILTERS)), F.lit(0)).alias("mask")
    each = flagged.select("doc_id", "part", mask).join(says, "doc_id", "left")
    sums = each.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    parts = sums.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("_m"))  # at most 32 of each part
    value = lambda letter: F.call_function("shiftleft", F.lit(1), F.instr(F.lit(FILTERS), letter) - 1)
    letter = lambda k: F.substring("filter_order", k, F.lit(1))
    rows = parts.select("part", "_m", F.explode(F.array(*map(F.lit, ORDERS))).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    earlier = F.aggregate(F.sequence(F.lit(1), F.lit(len(FILTERS))), F.lit(0), lambda a, k: a + F.when(k < F.col("step"), value(letter(k))).otherwise(0))
    rows = rows.select("*", value(letter(F.col("step"))).alias("bit"), earlier.alias("before"))

    def total(condition, of: str = "n", share=None) -> Column:
        return F.aggregate("_m", F.lit(0).cast("long"), lambda a, m: a + F.when(condition(m.mask), m[of] * (F.lit(1) if share is None else share(m.mask))).otherwise(F.lit(0)))

    bit, before = F.col("bit"), F.col("before")
    fails, there = (lambda m: m.bitwiseAND(bit) != 0), (lambda m: m.bitwiseAND(before) == 0)
    here = lambda m: fails(m) & there(m)
    return rows.select(
        "part", "filter_order", "step",
        total(lambda m: there(m) & ~fails(m)).alias("kept"), total(here).alias("removed"), total(lambda m: fails(m) & ~there(m)).alias("redundant"), total(lambda m: m == bit).alias("unique_fails"),
        total(here, "good").alias("good_lost"), total(here, "toxic").alias("toxic_lost"),
        # Of the failed filters of a document each comes first in as many of the orders.
        total(fails, share=lambda m: (F.lit(len(ORDERS)) / F.bit_count(m)).cast("long")).alias("shapley"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return audit(flags(csr_shards(documents(spark, sf_dir), F.col("lang"))), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP11_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c,
  regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM t),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM f LEFT JOIN l USING (doc_id)),
n AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY 1, 2),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x),
s AS (SELECT filter_order, step, x.bit, (SELECT coalesce(sum(y.bit), 0)::INT FROM x y WHERE instr(substr(filter_order, 1, step - 1), y.x) > 0) AS before
  FROM o, (SELECT unnest(range(1, 6))::INT AS step) JOIN x ON x.x = substr(filter_order, step, 1)),
r AS (SELECT part, filter_order, step, bit,
  coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS toxic_lost
  FROM n, s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM r
"""
