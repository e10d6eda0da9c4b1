"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The automaton is built over the words of all items of a block and sent to the tasks; a block holds a bounded number of words
(``block_words``), and a benchmark with more is taken in several blocks, each reading the documents and writing hits alone. A document's words
stream through the automaton, which tracks the longest suffix read so far that some item contains. Where that suffix has at
least ``window`` words, the last ``window`` of them are hit; an item of fewer words is hit where it occurs as a whole.

Before words are streamed, a filter on word triples tells which stretches could reach the shortest window at all; it never
drops a stretch that could.

Defined results: null and empty texts have no words and no hits; null and empty items are no windows. Rows with null or
repeated ``doc_id`` are each answered on their own; items with equal texts are all counted, a repeated item id once. Null
item ids are left out. Empty tables on either side give no rows, or rows without hits. Other columns are kept by
``decontaminate`` and ignored by the query.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meadowline.llm.common import as_bytes, ascii_words, documents, located, materialize, ship, side, slices

#: Words of test items that one automaton holds. 400,000 words were measured to take 305 MB in a Python worker; this is about a half.
BLOCK_WORDS = 200_000


class SuffixAutomaton:
    """All substrings of all items, as a minimal automaton over word numbers."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window, self.numbers = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.names = [name for name, _ in items]
        sequences = []
        for _, words in items:
            seq = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words]
            sequences.append(seq)
            last = 0
            for c in seq:
                last = self._extend(last, c)
        self.shortest = min([window, *(len(s) for s in sequences if s)])
        self._mark(sequences)
        self._triples(sequences)

    def _extend(self, last: int, c: int) -> int:
        """The state of the sequence read so far and ``c``; a state that is there already is used again."""
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
        new = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = copy
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _mark(self, sequences: list[list[int]]) -> None:
        """Which items have a window that ends in a state, kept at the state that stands for the window."""
        self.items: dict[int, set[int]] = {}
        for i, seq in enumerate(sequences):
            size = min(self.window, len(seq))
            state = held = 0
            for c in seq:
                state, held = self.step(state, held, c)
                if held >= size and size:
                    self.items.setdefault(self.cut(state, size), set()).add(i)
        self.least = {state: min(len(sequences[i]) for i in there) for state, there in self.items.items()}
        self.short = sorted({len(s) for s in sequences if 0 < len(s) < self.window})

    def step(self, state: int, held: int, c: int) -> tuple[int, int]:
        """State and length of the longest suffix that some item contains, after one more word."""
        while state and c not in self.next[state]:
            state = self.link[state]
            held = self.length[state]
        if c in self.next[state]:
            return self.next[state][c], held + 1
        return 0, 0

    def cut(self, state: int, size: int) -> int:
        """The state of the last ``size`` words."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def _triples(self, sequences: list[list[int]]) -> None:
        self.gram = min(3, self.shortest)
        keys = {hash_gram(s[i : i + self.gram]) for s in sequences for i in range(len(s) - self.gram + 1)}
        bits = max(16, int(np.ceil(np.log2(max(1, len(keys))))) + 5)
        self.mask = np.uint64((1 << bits) - 1)
        self.filter = np.zeros(1 << bits, dtype=bool)
        self.filter[np.fromiter(keys, dtype=np.uint64, count=len(keys)) & self.mask] = True

    def stretches(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Stretches of word numbers all of whose triples may stand in items, long enough for a window."""
        n = len(ids) - self.gram + 1
        if n <= 0:
            return []
        h = np.zeros(n, dtype=np.uint64)
        known = np.ones(n, dtype=bool)
        with np.errstate(over="ignore"):
            for k in range(self.gram):
                h = (h ^ ids[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                known &= ids[k : k + n] > 0
        h ^= h >> np.uint64(32)
        ok = self.filter[h & self.mask] & known
        edge = np.flatnonzero(np.diff(np.concatenate(([False], ok, [False])).astype(np.int8)))
        lows, highs = edge[::2], edge[1::2] + self.gram - 1
        long = highs - lows >= self.shortest
        return list(zip(lows[long].tolist(), highs[long].tolist()))

    def hits(self, ids: np.ndarray) -> tuple[list[tuple[int, int, int]], set[int]]:
        """Hit ranges of words (end exclusive, possibly overlapping), each with the words of the shortest item hit there, and
        the items found."""
        ranges, found = [], set()
        window, short, items = self.window, self.short, self.items
        for low, high in self.stretches(ids):
            state = held = 0
            for at, c in enumerate(ids[low:high].tolist(), low + 1):
                state, held = self.step(state, held, c)
                if held >= window:
                    at_state = self.cut(state, window)
                    there = items.get(at_state)
                    if there:
                        found |= there
                        ranges.append((at - window, at, self.least[at_state]))
                for size in short:
                    if held >= size and (there := items.get(self.cut(state, size))):
                        mine = {i for i in there if self.sizes[i] == size}
                        if mine:
                            found |= mine
                            ranges.append((at - size, at, size))
        return ranges, found

    @property
    def sizes(self) -> list[int]:
        return self._sizes


def hash_gram(ids: list[int]) -> int:
    h = 0
    for c in ids:
        h = ((h ^ c) * 0x9E3779B97F4A7C15) & (1 << 64) - 1
    return h ^ (h >> 32)


def build(items: list[tuple[str, list[bytes]]], window: int) -> SuffixAutomaton:
    automaton = SuffixAutomaton(items, window)
    automaton._sizes = [len(w) for _, w in items]
    return automaton


def merged(ranges: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Ranges that overlap or touch become one, which keeps the least item."""
    out: list[list[int]] = []
    for a, b, least in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1:] = max(out[-1][1], b), min(out[-1][2], least)
        else:
            out.append([a, b, least])
    return [(a, b, least) for a, b, least in out]


_HITS = "_n_words long, _ranges array<struct<a:int,b:int,least:int>>, _items array<string>"


def blocks_of(benchmark: DataFrame, block_words: int) -> list[DataFrame]:
    """The items in blocks of a bounded number of words each, by a hash of the item."""
    rows = benchmark.selectExpr("cast(item_id AS string) item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    # A word and the blank after it take two bytes at least.
    size = rows.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    n = -(-size // (block_words * 2)) or 1
    return [rows.where(F.expr(f"pmod(xxhash64(item_id, text), {n}) = {k}")) for k in range(n)] if n > 1 else [rows]


def scan(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = BLOCK_WORDS, limits: tuple[int, float] | None = None) -> DataFrame:
    """The documents with ``_n_words``, ``_ranges`` (hit words, and the words of the shortest item hit there) and ``_items``.

    With ``limits``, the longest span that stays and the largest share of hit words, the last pass cleans instead: texts lose
    their spans, documents beyond the share go, and ``_changed`` tells which texts are new."""
    spark = docs.sparkSession
    ship(spark)
    empty = {"_n_words": "0L", "_ranges": "cast(array() AS array<struct<a:int,b:int,least:int>>)", "_items": "cast(array() AS array<string>)"}
    blocks, hits = blocks_of(benchmark, block_words), []
    if len(blocks) > 1:
        docs, file, position = located(docs)
        keyed = docs.select(F.struct(file.alias("file"), position.alias("position")).alias("_key"), *docs.columns)
    for k, block in enumerate(blocks):
        if len(blocks) == 1:
            rows = docs.select("*", *(F.expr(x).alias(c) for c, x in empty.items()))
        elif k + 1 < len(blocks):
            rows = keyed.select("_key", "text", *(F.expr(x).alias(c) for c, x in empty.items()))
        else:  # the last block's pass carries the rows, with what the others found
            before = hits[0]
            for x in hits[1:]:
                before = before.unionByName(x)
            before = materialize(before.groupBy("_key").agg(F.flatten(F.collect_list("_ranges")).alias("_ranges"), F.flatten(F.collect_list("_items")).alias("_items")))
            rows = keyed.join(side(before), "_key", "left").select(*docs.columns, F.expr("0L").alias("_n_words"), *(F.coalesce(F.col(c), F.expr(empty[c])).alias(c) for c in ("_ranges", "_items")))
        items = sorted((r.item_id, ascii_words(r.text.encode())) for r in block.collect())  # of bounded size
        automaton = spark.sparkContext.broadcast(build([x for x in items if x[1]], window))

        clean = limits if k + 1 == len(blocks) else None

        def run(batches: Iterator[pa.RecordBatch], automaton=automaton, clean=clean) -> Iterator[pa.RecordBatch]:
            machine = automaton.value
            number = machine.numbers.get
            for batch in batches:
                for part in slices(batch):
                    words = [ascii_words(t) for t in as_bytes(part.column("text"))]
                    sizes = np.array([len(w) for w in words], dtype=np.int64)
                    ends = np.cumsum(sizes)
                    # All documents of the slice in one sequence, with the number 0 between them.
                    flat: list = []
                    for w in words:
                        flat += w
                        flat.append(b"")
                    ids = np.array([number(w, 0) for w in flat], dtype=np.int64)
                    ranges, items = part.column("_ranges").to_pylist(), part.column("_items").to_pylist()
                    starts = np.concatenate(([0], ends[:-1])) + np.arange(len(words)) if len(words) else ends
                    touched = {d for d, r in enumerate(ranges) if r} | {int(np.searchsorted(starts, low, side="right")) - 1 for low, _ in machine.stretches(ids)}
                    for d in touched:
                        got, found = machine.hits(ids[starts[d] : starts[d] + sizes[d]])
                        if got or ranges[d]:
                            old = [(r["a"], r["b"], r["least"]) for r in ranges[d]]
                            ranges[d] = [{"a": a, "b": b, "least": least} for a, b, least in merged(old + got)]
                            items[d] = sorted({*items[d], *(machine.names[i] for i in found)})
                    if clean:
                        yield cleaned(part, ranges, sizes, *clean)
                        continue
                    kept = [c for c in part.schema.names if c not in ("_n_words", "_ranges", "_items")]
                    cells = [part.column(c) for c in kept] + [pa.array(sizes), pa.array(ranges, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("least", pa.int32())]))), pa.array(items, pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(cells, names=[*kept, "_n_words", "_ranges", "_items"])

        out = rows.mapInArrow(run, docs.withColumn("_changed", F.lit(True)).schema if clean else rows.schema)
        if k + 1 < len(blocks):  # one automaton at a time in a task
            hits.append(materialize(out.where(F.size("_ranges") > 0).select("_key", "_ranges", "_items")))
    return out


def cleaned(part: pa.RecordBatch, ranges: list, sizes: np.ndarray, max_span: int, max_coverage: float) -> pa.RecordBatch:
    """A slice without the spans that are too long and the documents that are hit for too large a share."""
    hits = np.array([sum(r["b"] - r["a"] for r in x) for x in ranges], dtype=np.int64)
    keep, texts, fresh = hits <= max_coverage * sizes, part.column("text"), {}
    for d in np.flatnonzero(keep & (hits > 0)).tolist():
        spans = [(r["a"], r["b"]) for r in ranges[d] if r["b"] - r["a"] >= min(max_span, r["least"])]
        if spans:
            fresh[d] = without(texts[d].as_py(), spans)
    if fresh:
        texts = pa.array([fresh.get(d, t) for d, t in enumerate(texts.to_pylist())], texts.type)
    names = [c for c in part.schema.names if c not in ("_n_words", "_ranges", "_items")]
    cells = [texts if c == "text" else part.column(c) for c in names] + [pa.array([d in fresh for d in range(part.num_rows)], pa.bool_())]
    return pa.RecordBatch.from_arrays(cells, names=[*names, "_changed"]).filter(pa.array(keep))


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = scan(docs.select("doc_id", "text"), benchmark, window, block_words)
    return found.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.expr("aggregate(_ranges, 0L, (n, r) -> n + r.b - r.a)").alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
        (F.size("_ranges") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_span: int = 10, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents without their hit spans of ``max_span`` words or more, or, where an item hit there has fewer, of as many
    words as it has; documents of which more than ``max_coverage`` is hit go as a whole. Columns stay; ``n_chars``, where there is one, follows the new text."""
    names = docs.columns
    rest = F.struct(F.lit(0).alias("_"), *(F.col(c) for c in names if c != "text")).alias("_row")
    found = scan(docs.select(rest, "text"), benchmark, window, block_words, (max_span, max_coverage))
    fresh = {"text": F.col("text"), "n_chars": F.when(F.col("_changed"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))} if "n_chars" in names else {"text": F.col("text")}
    return found.select(*(fresh[c].alias(c) if c in fresh else F.col(f"_row.`{c}`").alias(c) for c in names))


_WORD_BYTES = frozenset([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of each span and what stands between them."""
    if not spans:
        return text
    data, places, start = text.encode(), [], None
    for i, c in enumerate(data):
        if c in _WORD_BYTES:
            start = i if start is None else start
        elif start is not None:
            places.append((start, i))
            start = None
    if start is not None:
        places.append((start, len(data)))
    out, at = [], 0
    for a, b in spans:
        out.append(data[at : places[a][0]])
        at = places[b - 1][1]
    return (b"".join(out) + data[at:]).decode()


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
