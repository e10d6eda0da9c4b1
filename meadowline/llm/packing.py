"""Best-fit packing into bins of several permitted lengths.

Documents are dealt by a hash to blocks of bounded size, which are packed independently, each in one task's bounded memory.
Within a block pieces are taken from long to short. A piece goes to the open bin in which least room is left over; where none
has room a bin is opened, of the permitted length that costs least for what it would hold: for each length the pieces left
are tried from long to short until the bin is full, the bin is downsized to them, and the cost (its tokens, padding included,
and ``bin_cost``) is divided by the tokens held. In the end every bin is downsized to the smallest permitted length that holds
its contents. As the choice by one bin is not always the best for all, the rules "open at least length L" are tried for the
block, too, and the packing of the lowest cost stays.

Documents longer than the largest length are cut into pieces of that length and a rest; nothing is dropped.

Defined results: a document without tokens has one row with no bin (null ``bin``, capacity 0). Rows with null or repeated
``doc_id`` are packed each on their own, and spread over the blocks as any others. Ties go by ``doc_id`` and piece. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meadowline.llm.common import documents, materialize, ship, slices, tokenizer_path
from meadowline.llm.token_counts import PATTERN

CAPACITIES = (512, 1024, 2048, 4096, 8192)
BIN_COST = 16
BLOCK_DOCS = 8192


class Left:
    """The pieces that are left, by length, and the longest one that is not longer than a given length."""

    def __init__(self, lengths: list[int], top: int):
        self.count = np.bincount(lengths, minlength=top + 1).tolist()
        self.down = list(range(top + 1))  # where to look on from a length of which none is left

    def longest(self, most: int) -> int:
        """0 if there is none."""
        down, n = self.down, most
        while n and not self.count[n]:
            n = down[n] if down[n] != n else n - 1
        while most > n:  # shorten the way for the next time
            down[most], most = n, down[most] if down[most] != most else most - 1
        return n

    def take(self, n: int) -> None:
        self.count[n] -= 1

    def fill(self, room: int) -> int:
        """What a bin would hold if the pieces left went into it from long to short."""
        held, n = 0, self.longest(room)
        while n:
            k = min(self.count[n], (room - held) // n)
            held += k * n
            n = self.longest(min(n - 1, room - held))
        return held

    def cheapest(self, n: int, capacities: tuple[int, ...], bin_cost: int) -> int:
        """The length of a bin for a piece of ``n`` that costs least for each token held; of equal ones the longest."""
        best = None
        for c in capacities:
            if c >= n:
                held = n + self.fill(c - n)
                size = next(x for x in capacities if x >= held)
                price = (size + bin_cost) / held
                if best is None or price <= best[0]:
                    best = (price, c)
        return best[1]


def best_fit(lengths: list[int], capacities: tuple[int, ...], open_at: int | None, bin_cost: int = BIN_COST) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each length (given from long to short), and the contents of each bin. A bin is opened at least at
    ``open_at``, or at the length that costs least."""
    left_over = Left(lengths, capacities[-1]) if open_at is None else None
    top = capacities[-1]
    room: list[list[int]] = [[] for _ in range(top + 1)]  # open bins by the room that is left
    filled = np.zeros(top + 1, dtype=bool)  # which amounts of room there are
    bins, offsets, contents = [], [], []
    low = top + 1  # no open bin has less room than this, or the array tells
    for n in lengths:
        if left_over:
            left_over.take(n)
        at = -1
        if low <= top:
            found = int(filled[n:].argmax()) + n
            at = found if filled[found] else -1
        if at < 0:
            size = left_over.cheapest(n, capacities, bin_cost) if left_over else next(c for c in capacities if c >= max(n, open_at))
            b, left = len(contents), size
            contents.append(0)
        else:
            b, left = room[at].pop(), at
            filled[at] = bool(room[at])
        bins.append(b)
        offsets.append(contents[b])
        contents[b] += n
        left -= n
        if left:
            room[left].append(b)
            filled[left] = True
            low = min(low, left)
    return bins, offsets, contents


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, bin_cost: int = BIN_COST) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each length, and each bin's length: the cheapest of the packings tried."""
    best = None
    for open_at in (None, *capacities):
        bins, offsets, contents = best_fit(lengths, capacities, open_at, bin_cost)
        sizes = [next(c for c in capacities if c >= x) for x in contents]
        cost = sum(sizes) + bin_cost * len(sizes)
        if best is None or cost < best[0]:
            best = (cost, bins, offsets, sizes)
    return best[1:] if best else ([], [], [])


_ROW = "doc_id long, piece int, start long, n_tokens long, block long, bin long, capacity int, offset int"


def pack_lengths(lengths: DataFrame, capacities: tuple[int, ...] = CAPACITIES, bin_cost: int = BIN_COST, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """``lengths``: doc_id and n_tokens. One row for each piece of a document: where it starts, and its block, bin, offset and the bin's capacity."""
    ship(lengths.sparkSession)
    capacities = tuple(sorted(capacities))
    top = capacities[-1]
    blocks = -(-lengths.count() // block_docs) or 1

    def flush(block: int, ids: list, sizes: list[int], first_bin: int) -> tuple[pa.RecordBatch, int]:
        pieces = []
        for i, (doc, n) in enumerate(zip(ids, sizes)):
            for piece, start in enumerate(range(0, n, top)):
                pieces.append((-min(top, n - start), doc is None, doc or 0, i, piece, start))
        pieces.sort()
        bins, offsets, size = pack([-p[0] for p in pieces], capacities, bin_cost)
        rows = [(ids[p[3]], p[4], p[5], -p[0], block, first_bin + b, size[b], o) for p, b, o in zip(pieces, bins, offsets)]
        rows += [(doc, 0, 0, 0, block, None, 0, 0) for doc, n in zip(ids, sizes) if n == 0]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        columns = list(zip(*rows)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in _ROW.split(", ")]), first_bin + len(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, bins, ids, sizes = None, 0, [], []
        for batch in batches:
            for b, doc, n in zip(*(batch.column(c).to_pylist() for c in ("block", "doc_id", "n_tokens"))):
                if ids and b != block:
                    out, bins = flush(block, ids, sizes, bins)
                    yield out
                    ids, sizes = [], []
                if b != block:
                    block, bins = b, 0
                ids.append(doc)
                sizes.append(n)
        if ids:
            yield flush(block, ids, sizes, bins)[0]

    rows = lengths.selectExpr("cast(doc_id AS long) doc_id", "coalesce(cast(n_tokens AS long), 0L) n_tokens", "monotonically_increasing_id() AS m")
    # The number of the row as read spreads rows of one id.
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "m"), F.lit(blocks)))
    dealt = rows.repartition("block").sortWithinPartitions("block", "doc_id", "n_tokens").select("block", "doc_id", "n_tokens")
    return dealt.mapInArrow(run, _ROW)


_ENCODINGS: dict = {}


def encoding(path: str):
    """The tokenizer of a file of ranks, once for each Python worker."""
    if path not in _ENCODINGS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def token_lengths(docs: DataFrame, ranks: str) -> DataFrame:
    """doc_id and n_tokens; strings of special tokens in a text are ordinary text."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(ranks).encode_ordinary
        for batch in batches:
            for part in slices(batch):
                n = [len(encode(t)) if t else 0 for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.selectExpr("cast(doc_id AS long) doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long")


def pack_documents(docs: DataFrame, ranks: str, capacities: tuple[int, ...] = CAPACITIES, bin_cost: int = BIN_COST, block_docs: int = BLOCK_DOCS) -> DataFrame:
    return pack_lengths(materialize(token_lengths(docs, ranks)), capacities, bin_cost, block_docs)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.tiktoken"))
