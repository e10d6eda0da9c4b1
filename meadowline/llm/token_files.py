"""Token ids in files, with a minimal perfect hash index for keyed access.

A dataset has three tables in the shared folder. ``shards``: documents in ascending key order, cut into shards of bounded
size whose ``payload`` is nothing but the ids, little-endian unsigned 32-bit integers; the files are bucketed by the part
that wrote them. ``index``: the keys, dealt to buckets by a hash; each bucket row holds a minimal perfect hash of its keys
(one pilot for each small group of keys), and for each slot a 32-bit fingerprint and the place (part, shard, first id, number
of ids). ``parts``: one row for each part written. A lookup reads one index row, computes one slot, compares the fingerprint
and slices one payload: constant time, however large the dataset. For a few keys (``FEW_KEYS``) the buckets and shards they
name are pushed down to the scans, so that files and row groups without them are not read; for more keys the places are
dealt by part to where the payloads lie, which stay unshuffled.

The key is ``(doc_id, ordinal)``: the ordinal numbers rows that share a ``doc_id`` and is 0 where ids are unique.

Defined results: null text counts as empty and has only the end id. Null ids sort first and are keyed like any other;
repeated ids get ordinals in the order in which the table is read, and may lie in several parts, so no task has to hold all
rows of one id. An empty table gives an empty dataset. Long texts are encoded whole; a document with more ids than a shard
holds gets a shard of its own. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meadowline.llm.common import documents, give_back, shared_dir, slices, tokenizer_path
from meadowline.llm.token_counts import byte_alphabet

SHARD_IDS = 1 << 18
#: Keys for each index row, on average, and keys for each pilot.
BUCKET_KEYS, GROUP_KEYS = 1024, 4
#: Text, in bytes, that is split into chunks at a time.
ENCODE_BYTES = 2 << 20
#: So many keys at most are looked up by pushing their places down to the scans.
FEW_KEYS = 1000
#: Row groups of a shard file: a shard has 1 MB.
GROUP_BYTES = 2 << 20
#: Fixed value: the pieces of tokenizer files whose chunks between blanks can be encoded on their own.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_MARKS = string.punctuation
#: Lower-case Latin letters whose capitals, if they have one, are single letters of the same block.
_SMALL = string.ascii_lowercase + "".join(map(chr, [0xDF, *range(0xE0, 0xF7), *range(0xF8, 0xFF)]))
_U = np.uint64


def _mix(x: np.ndarray, seed) -> np.ndarray:
    """A finaliser of multiply-shift rounds on unsigned 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ _U(seed)) * _U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(32))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


class MinimalPerfectHash:
    """Maps n distinct 64-bit hashes to 0..n-1 by one pilot for each group of about four."""

    def __init__(self, n: int, pilots: np.ndarray):
        self.n, self.pilots = n, pilots

    @classmethod
    def build(cls, keys: np.ndarray) -> MinimalPerfectHash:
        n = len(keys)
        if len(np.unique(keys)) < n:
            raise ValueError("two keys of one bucket have the same hash")
        groups = max(1, n // GROUP_KEYS)
        group = (_mix(keys, 11) % _U(groups)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        starts = np.searchsorted(group[order], np.arange(groups + 1))
        pilots, taken = np.zeros(groups, dtype=np.int64), np.zeros(n, dtype=bool)
        for g in np.argsort(-(starts[1:] - starts[:-1]), kind="stable"):
            mine = keys[order[starts[g] : starts[g + 1]]]
            if not len(mine):
                break
            low, step = 0, 32
            while True:
                tries = np.arange(low, low + step)
                at = cls._slots(mine[None, :], tries[:, None], n)
                free = ~taken[at].any(axis=1)
                if len(mine) > 1 and free.any():
                    s = np.sort(at, axis=1)
                    free &= (s[:, 1:] != s[:, :-1]).all(axis=1)
                if free.any():
                    i = int(free.argmax())
                    pilots[g], taken[at[i]] = tries[i], True
                    break
                low, step = low + step, min(step * 2, 4096)
        return cls(n, pilots)

    @staticmethod
    def _slots(keys: np.ndarray, pilots: np.ndarray, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            salted = keys ^ _mix(pilots.astype(np.uint64), 23)
        return (_mix(salted, 37) % _U(n)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        group = (_mix(keys, 11) % _U(len(self.pilots))).astype(np.int64)
        return self._slots(keys, self.pilots[group], self.n)


def drops_blanks(spec: dict) -> bool:
    """Whether a tokenizer file declares NFC, blanks as one, lower case, and pieces that never hold a blank."""
    normal, pieces = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps, cuts = normal.get("normalizers", [normal]), pieces.get("pretokenizers", [pieces])
    if [x.get("type") for x in steps] != ["NFC", "Replace", "Lowercase"] or [x.get("type") for x in cuts] != ["Split", "ByteLevel"]:
        return False
    blanks = (steps[1]["pattern"], steps[1]["content"]) == ({"Regex": r"\s+"}, " ")
    cut = cuts[0]["pattern"].get("Regex") == PIECES and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"]
    return blanks and cut and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"]


def _symbols() -> tuple[dict[int, str], dict[int, str]]:
    """An ASCII stand-in for every UTF-8 byte of lower-case Latin-1 letters, and another one for it at the end of a word."""
    used = sorted({b for c in _SMALL for b in c.encode()})
    return {b: chr(i) for i, b in enumerate(used)}, {b: chr(64 + i) for i, b in enumerate(used)}


def letter_ranks(path: str) -> dict[str, int]:
    """Tokens of Latin letters, in stand-ins, numbered in the order of their merges.

    Merging whatever joins into the entry of lowest rank is then the same as the file's merges, as long as each entry is what
    the merges make of its own letters; entries of which that is not so never come up, and are left out."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    (inner, last), table = _symbols(), byte_alphabet()

    def short(t: str) -> str | None:
        body = [table.get(c) for c in t.removesuffix("</w>")]
        if not body or not inner.keys() >= set(body):
            return None
        tail = last if t.endswith("</w>") else inner
        return "".join([inner[b] for b in body[:-1]]) + tail[body[-1]]

    pairs: dict[tuple[str, str], int] = {}
    for i, m in enumerate(model["merges"]):
        a, b = (short(x) for x in (m.split(" ") if isinstance(m, str) else m))
        if a and b and a[-1] < "@":
            pairs.setdefault((a, b), i)

    def merged(t: str) -> bool:
        parts = list(t)
        while len(parts) > 1:
            rank, at = min((pairs.get(x, 1 << 40), i) for i, x in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 40:
                return False
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return True

    out = {chr(c): c for c in range(128)}
    for a, b in pairs:
        if a + b not in out and merged(a + b):
            out[a + b] = len(out)
    return out


def _gather(data: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs that ``codes`` name, one after the other, and the size of each. ``data`` holds the runs in their order."""
    n = sizes[codes]
    ends = np.cumsum(n)
    at = np.repeat((np.cumsum(sizes) - sizes)[codes] - ends + n, n)
    at += np.arange(len(at))
    return data[at], n


class WordEncoder:
    """Encodes texts by the distinct chunks between ASCII blanks that a slice of them holds.

    A chunk of Latin letters, perhaps with marks at its end, is one piece and the pieces of the marks; all such words of a
    slice go through the merges in one call. Other chunks are encoded by the library. That is right for files whose pieces
    never hold a blank; with any other file texts are encoded whole by the library."""

    def __init__(self, path: str, ranks: dict[str, int] | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_chunks, self.special = drops_blanks(spec), [x["content"] for x in spec["added_tokens"]]
        if not self.by_chunks:
            return
        ranks = ranks or letter_ranks(path)
        (inner, last), vocabulary = _symbols(), spec["model"]["vocab"]
        shown = {b: c for c, b in byte_alphabet().items()}
        name = {c: shown[b] for b, c in inner.items()} | {c: shown[b] + "</w>" for b, c in last.items()}
        self.letters = tiktoken.Encoding("letters", pat_str="[\\x00-\\x3f]*[\\x40-\\x7f]", mergeable_ranks={t.encode(): r for t, r in ranks.items()}, special_tokens={})
        self.ids = np.array([vocabulary.get("".join([name.get(c, "?") for c in t]), 0) for t in ranks], dtype="<u4")
        self.closes = np.array([t[-1] >= "@" for t in ranks])
        self.inner, self.last = (np.array([ord(t.get(b, "?")) for b in range(256)], dtype=np.uint8) for t in (inner, last))

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []
        return np.array([i for x in ids for i in x], dtype="<u4"), np.array([len(x) for x in ids], dtype=np.int64)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of lower-case Latin letters."""
        if not len(words):
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        _, offsets, data = words.buffers()
        ends = np.frombuffer(offsets, np.int64, len(words) + 1, words.offset * 8)
        raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
        ends = ends[1:] - ends[0] - 1
        marked = self.inner[raw]
        marked[ends] = self.last[raw[ends]]
        got = self.letters.encode_to_numpy(marked.tobytes().decode("ascii"), disallowed_special=())
        return self.ids[got], np.diff(np.flatnonzero(self.closes[got]), prepend=-1)

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks, one after the other, and how many each has."""
        base = pc.ascii_rtrim(chunks, characters=_MARKS)
        plain = np.asarray(pc.match_substring_regex(base, f"^[{_SMALL}{_SMALL.upper().replace('SS', '')}]+$"))
        words = pc.utf8_lower(base.filter(pa.array(plain))).dictionary_encode()
        marks = pc.utf8_ltrim(chunks.filter(pa.array(plain)), characters=_SMALL + _SMALL.upper()).dictionary_encode()
        found = [self._words(words.dictionary), self._library(marks.dictionary.to_pylist()), self._library(chunks.filter(pa.array(~plain)).to_pylist())]
        data, sizes = (np.concatenate(x) for x in zip(*found))
        # Each chunk is two runs: its word and its marks, or what the library made of it and an empty run.
        sizes = np.append(sizes, 0)
        runs = np.full((len(chunks), 2), len(sizes) - 1)
        at = np.flatnonzero(plain)
        runs[at, 0] = np.asarray(words.indices)
        runs[at, 1] = len(words.dictionary) + np.asarray(marks.indices)
        runs[~plain, 0] = len(words.dictionary) + len(marks.dictionary) + np.arange(len(chunks) - len(at))
        data, n = _gather(data, sizes, runs.ravel())
        return data, n.reshape(-1, 2).sum(axis=1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has; null counts as empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if not self.by_chunks:
            return self._library(texts.to_pylist())
        texts = pa.concat_arrays([texts, pa.array([], pa.large_string())])  # a copy: ascii_lower misreads slices
        # The file lower-cases in any case, but for the strings of its special tokens.
        if not any(pc.any(pc.match_substring(texts, x, ignore_case=True)).as_py() for x in self.special):
            texts = pc.ascii_lower(texts)
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        data, n = _gather(*self._chunks(coded.dictionary), np.asarray(coded.indices))
        ends, offsets = np.concatenate(([0], np.cumsum(n))), np.asarray(lists.offsets)
        return data, ends[offsets[1:] - offsets[0]] - ends[offsets[:-1] - offsets[0]]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str, ranks: dict[str, int] | None = None) -> WordEncoder:
    """One instance for each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path, ranks)
    return _ENCODERS[path]


def key_hashes(ids: np.ndarray, null: np.ndarray, ordinals: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of keys, and 64-bit hashes that do not depend on the buckets: keys meet only if they agree in both."""
    one, two = ids.astype(np.int64).view(np.uint64), ordinals.astype(np.uint64) * _U(2) + null.astype(np.uint64)
    with np.errstate(over="ignore"):
        bucket, h = (_mix(_mix(one, a) + two * _U(0xD6E8FEB86659FD93), a + 4) for a in (3, 13))
    return (bucket % _U(buckets)).astype(np.int64), h


_SHARD = "part int, shard int, part_start long, doc_ids array<long>, ordinals array<long>, lengths array<long>, payload binary"
_INDEX = "bucket long, pilots array<long>, fingerprints array<long>, part array<int>, shard array<int>, first array<long>, n array<long>"
_PARTS = "part int, ids_before long, first_id long, carry long, buckets long, files int"


def _declared(spark: SparkSession, folder: str, files: int) -> str:
    """A name under which the session knows the shards of a folder, for their bucketing to count."""
    name = f"meadowline_{hashlib.md5(folder.encode()).hexdigest()}"
    if not spark.catalog.tableExists(name):
        spark.sql(f"CREATE TABLE {name} ({_SHARD}) USING parquet CLUSTERED BY (part) INTO {files} BUCKETS LOCATION '{folder}/shards'")
    return name


def _shards(spark: SparkSession, folder: str, files: int) -> DataFrame:
    """The table of shards. What was resolved keeps its bucketing, and the files are the folder's own, so the name is given up
    at once and none is left in the catalog."""
    name = _declared(spark, folder, files)
    shards = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return shards


class _Part:
    """Documents of one part on their way into shards."""

    def __init__(self, part: int):
        self.part, self.shard, self.start, self.held = part, 0, 0, 0
        self.cells: list[tuple] = []  # arrays of ids, whether null, ordinals, lengths, payload
        self.last: tuple = ()
        self.ordinal = -1

    def flush(self) -> pa.RecordBatch:
        ids, null, ordinals, lengths, body = (np.concatenate(x) for x in zip(*self.cells))
        lists = [pa.array(ids, mask=null), pa.array(ordinals), pa.array(lengths)]
        ends = pa.array([0, len(ids)], pa.int32())
        cells = [pa.array([self.part], pa.int32()), pa.array([self.shard], pa.int32()), pa.array([self.start], pa.int64()), *(pa.ListArray.from_arrays(ends, x) for x in lists), pa.array([body.tobytes()], pa.binary())]
        self.shard, self.start, self.held, self.cells = self.shard + 1, self.start + self.held, 0, []
        return pa.RecordBatch.from_arrays(cells, names=[x.split()[0] for x in _SHARD.split(", ")])

    def add(self, ids: pa.Array, body: np.ndarray, lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Take documents in key order; shards that are full."""
        null, ids = np.asarray(ids.is_null()), np.asarray(ids.fill_null(0))
        if not len(ids):
            return
        at = np.arange(len(ids))
        fresh = np.concatenate(([self.last != (bool(null[0]), int(ids[0]))], (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])))
        run = np.maximum.accumulate(np.where(fresh, at, -1))
        ordinals = np.where(run >= 0, at - run, at + self.ordinal + 1)
        self.last, self.ordinal = (bool(null[-1]), int(ids[-1])), int(ordinals[-1])
        ends, low = np.cumsum(lengths), 0
        while low < len(ids):
            before = ends[low] - lengths[low]
            high = int(np.searchsorted(ends, before + SHARD_IDS - self.held, side="right"))
            if high <= low:
                if self.held:
                    yield self.flush()
                    continue
                high = low + 1  # a document that is longer than a shard
            self.cells.append((ids[low:high], null[low:high], ordinals[low:high], lengths[low:high], body[before : ends[high - 1]]))
            self.held += int(ends[high - 1] - before)
            low = high


def write_dataset(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> str:
    """Encode ``docs`` and write them with their index; the folder's name."""
    spark = docs.sparkSession
    folder, ranks = folder or shared_dir(spark), spark.sparkContext.broadcast(letter_ranks(tokenizer))  # one entry for each token at most

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer, ranks.value), _Part(TaskContext.get().partitionId())
        for batch in batches:
            for piece in slices(batch, limit=ENCODE_BYTES):
                ids, n = enc.encode(piece.column("text"))
                yield from part.add(piece.column("doc_id"), np.insert(ids, np.cumsum(n), end_id).astype("<u4"), n + 1)
                del ids, n, piece
            del batch
            give_back()
        if part.held:
            yield part.flush()

    # The number of the row as read keeps rows of one id apart in the ranges.
    rows = docs.selectExpr("cast(doc_id AS long) doc_id", "text", "monotonically_increasing_id() AS m").repartitionByRange("doc_id", "m").sortWithinPartitions("doc_id", "m")
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = _declared(spark, folder, files)
    written = rows.select("doc_id", "text").mapInArrow(encode, _SHARD).write.option("compression", "zstd").option("parquet.block.size", GROUP_BYTES)
    written.format("parquet").mode("append").bucketBy(files, "part").saveAsTable(name)
    shards = _shards(spark, folder, files)
    # One row for each part that was written reaches the driver.
    ends = F.struct("shard", F.element_at("doc_ids", -1).alias("id"), F.element_at("ordinals", -1).alias("ordinal"))
    parts = shards.groupBy("part").agg(
        F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, b: a + b)).alias("n"), F.sum(F.size("doc_ids")).alias("docs"),
        F.min(F.struct("shard", F.element_at("doc_ids", 1).alias("id"))).alias("first"), F.max(ends).alias("last"),
    ).orderBy("part").collect()
    buckets = max(1, sum(r.docs for r in parts) // BUCKET_KEYS)
    before, rows, last, seen = 0, [], None, 0
    for r in parts:
        # Rows of the id with which the part before ended go on from its ordinals.
        carry = seen if last is not None and last.id == r.first.id else 0
        rows.append((r.part, before, r.first.id, carry, buckets, files))
        before, last, seen = before + r.n, r.last, r.last.ordinal + 1 + (carry if r.last.ordinal + 1 == r.docs else 0)
    spark.createDataFrame(rows, _PARTS).coalesce(1).write.parquet(f"{folder}/parts")
    carried = {r[0]: (r[2], r[3]) for r in rows if r[3]}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda c, i=i, batch=batch: batch.column(c)[i].values
                part, ids, n, ordinals = batch.column("part")[i].as_py(), get("doc_ids"), np.asarray(get("lengths")), np.asarray(get("ordinals"))
                if part in carried:
                    first, carry = carried[part]
                    ordinals = ordinals + carry * np.asarray(ids.is_null() if first is None else pc.equal(ids, first).fill_null(False))
                bucket, h = key_hashes(np.asarray(ids.fill_null(0)), np.asarray(ids.is_null()), ordinals, buckets)
                same = lambda x, k=len(h): np.full(k, x, dtype=np.int32)
                cells = [bucket, h.view(np.int64), same(part), same(batch.column("shard")[i].as_py()), np.cumsum(n) - n, n]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], names=["bucket", "h", "part", "shard", "first", "n"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(rows: pa.Table) -> pa.RecordBatch:
            h = np.asarray(rows.column("h").combine_chunks()).view(np.uint64)
            mph = MinimalPerfectHash.build(h)
            slot = mph.slots(h)
            order = np.empty(len(h), dtype=np.int64)
            order[slot] = np.arange(len(h))
            col = lambda c: np.asarray(rows.column(c).combine_chunks())[order]
            lists = [mph.pilots, (_mix(h, 43)[order] >> _U(32)).astype(np.int64), col("part"), col("shard"), col("first"), col("n")]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            names = ["bucket", "pilots", "fingerprints", "part", "shard", "first", "n"]
            return pa.RecordBatch.from_arrays([pa.array([rows.column("bucket")[0].as_py()], pa.int64()), *(pa.array([x], pa.list_(k)) for x, k in zip(lists, kinds))], names=names)

        held: list[pa.RecordBatch] = []  # the rows of one bucket, which the hash keeps near BUCKET_KEYS
        for batch in batches:
            b = np.asarray(batch.column("bucket"))
            edges = [0, *(np.flatnonzero(b[1:] != b[:-1]) + 1).tolist(), len(b)]
            for lo, hi in zip(edges, edges[1:]):
                if hi == lo:
                    continue
                if held and held[0].column("bucket")[0].as_py() != b[lo]:
                    yield row(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield row(pa.Table.from_batches(held))

    placed = shards.select("part", "shard", "doc_ids", "ordinals", "lengths").mapInArrow(place, "bucket long, h long, part int, shard int, first long, n long")
    index = placed.repartitionByRange("bucket").sortWithinPartitions("bucket").mapInArrow(build, _INDEX)
    index.write.option("parquet.block.size", GROUP_BYTES).parquet(f"{folder}/index")
    return folder


def _parts(spark: SparkSession, folder: str) -> list:
    """One row for each part of a dataset."""
    return spark.read.schema(_PARTS).parquet(f"{folder}/parts").collect()


def lookup(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """Read documents by key. ``keys``: doc_id, ordinal. One row for each key that is found: doc_id, ordinal, start, n_tokens, ids_crc32, ids."""
    parts = _parts(spark, folder)
    buckets, files = (parts[0].buckets, parts[0].files) if parts else (1, 1)
    starts = {r.part: r.ids_before for r in parts}
    index, shards = spark.read.schema(_INDEX).parquet(f"{folder}/index"), _shards(spark, folder, files)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            bucket, _ = key_hashes(np.asarray(ids.fill_null(0)), np.asarray(ids.is_null()), np.asarray(batch.column("ordinal")), buckets)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), *batch.columns], names=["bucket", "doc_id", "ordinal"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda c, i=i, batch=batch: batch.column(c)[i].values
                wanted = get("keys")
                ids, ordinals = wanted.field("doc_id"), wanted.field("ordinal")
                _, h = key_hashes(np.asarray(ids.fill_null(0)), np.asarray(ids.is_null()), np.asarray(ordinals), buckets)
                prints = np.asarray(get("fingerprints"))
                slot = MinimalPerfectHash(len(prints), np.asarray(get("pilots"))).slots(h)
                ok = pa.array(prints[slot] == (_mix(h, 43) >> _U(32)).astype(np.int64))
                take = pa.array(slot)
                cells = [get("part").take(take), get("shard").take(take), ids, ordinals, get("first").take(take), get("n").take(take)]
                yield pa.RecordBatch.from_arrays([c.filter(ok) for c in cells], names=["part", "shard", "doc_id", "ordinal", "first", "n"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                docs = batch.column("docs")[i].values
                body = memoryview(batch.column("payload")[i].as_buffer())
                base = starts[batch.column("part")[i].as_py()] + batch.column("part_start")[i].as_py()
                first, n = np.asarray(docs.field("first")), np.asarray(docs.field("n"))
                ids = [body[4 * a : 4 * (a + k)] for a, k in zip(first.tolist(), n.tolist())]
                crc = pa.array([zlib.crc32(x) for x in ids], pa.int64())
                cells = [docs.field("doc_id"), docs.field("ordinal"), pa.array(base + first), pa.array(n), crc, pa.array([bytes(x) for x in ids], pa.binary())]
                yield pa.RecordBatch.from_arrays(cells, names=["doc_id", "ordinal", "start", "n_tokens", "ids_crc32", "ids"])
                del docs, body, ids, cells
            del batch
            give_back()

    dealt = keys.selectExpr("cast(doc_id AS long) doc_id", "cast(ordinal AS long) ordinal").mapInArrow(deal, "bucket long, doc_id long, ordinal long")
    place = "part int, shard int, doc_id long, ordinal long, first long, n long"
    few = dealt.take(FEW_KEYS + 1)
    if len(few) <= FEW_KEYS:  # the buckets, then the shards, are named in the scans' filters
        dealt = spark.createDataFrame(few, "bucket long, doc_id long, ordinal long")
        index = index.where(F.col("bucket").isin(sorted({r.bucket for r in few})))
    wanted = dealt.groupBy("bucket").agg(F.collect_set(F.struct("doc_id", "ordinal")).alias("keys"))
    places = wanted.join(index, "bucket").drop("bucket").mapInArrow(find, place)
    if len(few) <= FEW_KEYS:
        found = places.collect()
        places = spark.createDataFrame(found, place)
        shards = shards.where(F.col("part").isin(sorted({r.part for r in found})) & F.col("shard").isin(sorted({r.shard for r in found})))
    # Dealt by part to the buckets in which the payloads lie: a part is what one task wrote, and its places are narrow.
    by_shard = places.groupBy("part", "shard").agg(F.collect_list(F.struct("doc_id", "ordinal", "first", "n")).alias("docs"))
    by_part = by_shard.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("shard", "docs"))).alias("docs"))
    joined = shards.select("part", "shard", "part_start", "payload").join(by_part.hint("shuffle_hash"), "part")
    joined = joined.where("map_contains_key(docs, shard)").select("part", F.col("docs")[F.col("shard")].alias("docs"), "part_start", "payload")
    return joined.mapInArrow(read, "doc_id long, ordinal long, start long, n_tokens long, ids_crc32 long, ids binary")


def keys_of(spark: SparkSession, folder: str) -> DataFrame:
    """All keys of a dataset."""
    parts = _parts(spark, folder)
    if not parts:
        return spark.createDataFrame([], "doc_id long, ordinal long")
    carried = [r for r in parts if r.carry]
    keys = _shards(spark, folder, parts[0].files).select("part", F.explode(F.arrays_zip("doc_ids", "ordinals")).alias("k")).select("part", F.col("k.doc_ids").alias("doc_id"), F.col("k.ordinals").alias("ordinal"))
    if not carried:
        return keys.drop("part")
    more = spark.createDataFrame([(r.part, r.first_id, r.carry) for r in carried], "part int, first_id long, carry long")  # at most one row for each part
    keys = keys.join(F.broadcast(more), "part", "left")
    return keys.select("doc_id", (F.col("ordinal") + F.when(F.col("carry").isNotNull() & F.col("doc_id").eqNullSafe(F.col("first_id")), F.col("carry")).otherwise(0)).alias("ordinal"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    folder = write_dataset(docs, tokenizer_path("word_bpe_49k.json"), end_id=2)
    return lookup(spark, folder, keys_of(spark, folder)).select("doc_id", "start", "n_tokens", "ids_crc32")
