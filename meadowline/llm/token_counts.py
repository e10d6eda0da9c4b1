"""Token counts of byte-level BPE by dynamic programming over prefixes.

The encoding of a piece of text ends in a token whose predecessor encodes the prefix before it. So for every prefix of a
piece the last token is found among the vocabulary entries that end there: the one that, put after the last token of the
shorter prefix, is left as it is by the merges. The number of tokens of every prefix follows from the shorter one's, which
gives counts, truncation points and budgets without encoding anything again.

Pieces are what the pre-tokeniser's pattern cuts out; tokens never cross them. A blank between two non-blank characters
always begins a new piece, so texts are cut there into units, and a task keeps the counts of units it has met.

Defined results: null and empty texts have 0 tokens. Rows with null or repeated ``doc_id`` are each answered on their own.
The string of a special token inside a text is that token, as is the library's default. Empty tables give no rows, very long
texts are processed whole. Other columns are ignored.
"""

from __future__ import annotations

import json
import string
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from meadowline.llm.common import documents, slices, tokenizer_path

#: Fixed value: the pre-tokeniser's public pattern for byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Units a task remembers; when it has met that many, it starts anew. This bounds memory and changes no result.
REMEMBER = 400_000
#: Longer pieces, and what of a piece is longer, are not remembered.
SHARED = 200


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: bytes that print stand for themselves, the others follow from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in shown}
    for b in range(256):
        if b not in shown:
            table[chr(256 + len(table) - len(shown))] = b
    return table


class PrefixBpe:
    """Counts tokens of every prefix of a piece."""

    #: Fixed value: what the pattern's ``\\s`` matches.
    BLANK = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B))))

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        back = byte_alphabet()
        raw = lambda s: bytes(back[c] for c in s)
        self.ids = {raw(k): v for k, v in spec["model"]["vocab"].items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        self.halves = {a + b: (a, b, r) for (a, b), r in self.rank.items()}
        self.tails = {t[i:] for t in self.ids for i in range(len(t))}
        self.edges: tuple[dict, dict] = ({}, {})
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.pieces = regex.compile(PATTERN).findall
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.alone: dict[bytes, bool] = {}
        self.piece_counts: dict[str, int] = {}
        self.units: dict[str, int] = {}
        self.child: dict[int, int] = {}
        self.node_counts, self.node_lasts = [0], [0]

    def merge(self, data: bytes) -> list[bytes]:
        """Merges of the lowest rank first, leftmost first: the definition, used on two tokens at a time."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min((self.rank.get((a, b), 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == 1 << 40:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _edge(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """The parts that stand at a token's right (1) or left (0) edge while it is put together, with the rank that ends each."""
        edge = self.edges[side].get(token)
        if edge is None:
            edge, part = [(token, 1 << 40)], token
            while part in self.halves:
                left, right, rank = self.halves[part]
                part = right if side else left
                edge.append((part, rank))
            self.edges[side][token] = edge
        return edge

    def _follows(self, a: bytes, b: bytes) -> bool:
        """Whether the merges leave ``a`` and ``b`` apart: no pair across the border comes up before one of its parts has
        gone into a larger one (of equal ranks the left pair goes first). Pairs have later ranks than their parts."""
        rank = self.rank
        for left, left_ends in self._edge(a, 1):
            for right, right_ends in self._edge(b, 0):
                r = rank.get((left, right))
                if r is not None and r < left_ends and r <= right_ends:
                    return False
        return True

    def _token(self, t: bytes) -> bool:
        """Whether ``t`` is in the vocabulary and the merges do arrive at it."""
        ok = self.alone.get(t)
        if ok is None:
            ok = self.alone[t] = t in self.ids and len(self.merge(t)) == 1
        return ok

    def prefixes(self, piece: bytes) -> array:
        """Token counts of the prefixes of 0, 1, 2, ... bytes of one piece.

        Prefixes that pieces have in common are worked out once: they are nodes of a tree, each with its count and last token."""
        child, node_counts, node_lasts = self.child, self.node_counts, self.node_lasts
        if len(node_counts) > REMEMBER:
            child.clear()
            del node_counts[1:], node_lasts[1:]
        # Numbers only, so that a piece of millions of letters stays small; the tree ends at SHARED bytes.
        counts, sizes, node = array("i", [0]), array("i", [0]), 0
        for byte in piece[:SHARED]:
            at = child.get(node << 8 | byte)
            if at is None:
                break
            node = at
            counts.append(node_counts[at])
            sizes.append(node_lasts[at])
        alone, tails, fits = self.alone, self.tails, self.fits
        for end in range(len(counts), len(piece) + 1):
            start, found = end - 1, []
            while start >= 0 and (t := piece[start:end]) in tails:
                ok = alone.get(t)
                if self._token(t) if ok is None else ok:
                    found.append((start, t))
                start -= 1
            for start, t in reversed(found):
                if start:
                    pair = (piece[start - sizes[start] : start], t)
                    ok = fits.get(pair)
                    if ok is None:
                        if len(fits) > REMEMBER:
                            fits.clear()
                        ok = fits[pair] = self._follows(*pair)
                    if not ok:
                        continue
                counts.append(counts[start] + 1)
                sizes.append(len(t))
                break
            if end <= SHARED:
                child[node << 8 | piece[end - 1]] = node = len(node_counts)
                node_counts.append(counts[end])
                node_lasts.append(sizes[end])
        return counts

    def piece(self, piece: str) -> int:
        n = self.piece_counts.get(piece)
        if n is None:
            if len(self.piece_counts) > REMEMBER // 2:
                self.piece_counts.clear()
            n = self.prefixes(piece.encode())[-1]
            if len(piece) < SHARED:
                self.piece_counts[piece] = n
        return n

    def plain(self, text: str) -> int:
        """Tokens of text in which no special token stands."""
        head, *rest = text.split(" ")
        units, total, open_unit = self.units, 0, head
        if not rest:
            return sum(map(self.piece, self.pieces(head)))
        # A unit is closed where the blank stands between non-blank characters.
        try:
            counts = [units[u] for u in rest]
        except KeyError:
            counts = [units[u] if u in units else self._unit(u) for u in rest]
        if head and not head[-1].isspace() and min(counts) >= 0:
            return sum(map(self.piece, self.pieces(head))) + sum(counts)
        out: list[str] = []
        for u, n in zip(rest, counts):
            if n >= 0 and open_unit and not open_unit[-1].isspace():
                out.append(open_unit)
                open_unit = " " + u
            elif u and not u[0].isspace() and open_unit and not open_unit[-1].isspace():
                out.append(open_unit)
                open_unit = " " + u
            else:
                open_unit += " " + u
        out.append(open_unit)
        for u in out:
            total += sum(map(self.piece, self.pieces(u)))
        return total

    def _unit(self, u: str) -> int:
        """Count of a unit and its blank, or -1 where blanks stand at its edges."""
        units = self.units
        if len(units) > 2 * REMEMBER:
            units.clear()
        word = u.rstrip(string.punctuation)
        if word.isalpha() and max(word) < "\u0250":  # one piece of letters, and perhaps one of marks
            n = units.get(word)
            if n is None:
                n = self.prefixes(b" " + word.encode())[-1]
                if len(word) < SHARED:
                    units[word] = n
            if len(word) == len(u):
                return n
            n += self.piece(u[len(word) :])
        elif not u or u[0].isspace() or u[-1].isspace():
            n = -1
        else:
            n = sum(map(self.piece, self.pieces(" " + u)))
        if len(u) < SHARED:
            units[u] = n
        return n

    def count(self, text: str) -> int:
        if self.split_special is None or not any(s in text for s in self.special):
            return self.plain(text)
        parts = self.split_special.split(text)
        return len(parts) - 1 + sum(self.plain(p) for p in parts if p)

    def prefix_counts(self, text: str) -> np.ndarray:
        """Token counts of the prefixes of 0, 1, 2, ... code points of the text, as each would be encoded on its own."""
        out = [0]
        at, base = 0, 0
        found = list(self.split_special.finditer(text)) if self.split_special else []
        for start, end in [(m.start(), m.end()) for m in found] + [(len(text), None)]:
            base = self._plain_prefixes(text[at:start], base, out)
            if end is not None:
                tail: list[int] = []
                # Inside a special token the prefix holds a part of its string, which is ordinary text after what stands before.
                for cut in range(start + 1, end):
                    tail.append(self._recount(text, at, cut, out))
                base += 1
                out += [*tail, base]
                at = end
        return np.array(out, dtype=np.int32)

    def _recount(self, text: str, low: int, cut: int, out: list[int]) -> int:
        """Count at ``cut`` by encoding anew from the last place between non-blank characters where a piece surely begins."""
        start = cut
        while start > low and not (text[start : start + 1] == " " and start + 1 < cut and not text[start + 1].isspace() and not text[start - 1].isspace()):
            start -= 1
        return out[start] + sum(map(self.piece, self.pieces(text[start:cut])))

    def _plain_prefixes(self, text: str, base: int, out: list[int]) -> int:
        run = None  # tokens before the run of blanks that ends here, and the run
        for piece in self.pieces(text):
            before = base
            if self.BLANK.issuperset(piece):
                run = (run[0], run[1] + piece) if run else (before, piece)
                counts = self.prefixes(run[1].encode())
                size = len(run[1]) - len(piece)
                for i in range(1, len(piece) + 1):
                    out.append(run[0] + counts[len(run[1][: size + i].encode())])
                base = before + self.piece(piece)
                continue
            counts = self.prefixes(piece.encode())
            if piece[0] == "'" and len(piece) > 1 and piece[1].isalpha():  # cut short, "'ll" is a mark and letters
                mark = self.piece("'")
                cuts = [mark] + [mark + self.piece(piece[1:i]) for i in range(2, len(piece))] + [counts[-1]]
            else:
                cuts, size = [], 0
                for c in piece:
                    size += len(c.encode())
                    cuts.append(counts[size])
            if run and piece[0] in self.BLANK:  # a prefix that ends in this blank has it in the run
                cuts[0] = run[0] + self.prefixes((run[1] + piece[0]).encode())[-1] - before
            out += [before + c for c in cuts]
            base, run = before + counts[-1], None
        return base


_LOADED: dict[str, PrefixBpe] = {}


def load(path: str) -> PrefixBpe:
    """One instance for each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = PrefixBpe(path)
    return _LOADED[path]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        for batch in batches:
            for part in slices(batch):
                texts = [t or "" for t in part.column("text").to_pylist()]
                n = np.array([bpe.count(t) for t in texts], dtype=np.int64)
                sizes = pa.array([len(t.encode()) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), sizes, pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.selectExpr("cast(doc_id AS long) doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def prefix_token_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and ``prefix_tokens``: the token count of every prefix, by code points, from the empty one to the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        for batch in batches:
            for part in slices(batch, limit=256 << 10):
                rows = [bpe.prefix_counts(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, pa.list_(pa.int32()))], names=["doc_id", "prefix_tokens"])

    return docs.selectExpr("cast(doc_id AS long) doc_id", "text").mapInArrow(run, "doc_id long, prefix_tokens array<int>")


def truncate_to_budget(docs: DataFrame, tokenizer: str, budget: int) -> DataFrame:
    """doc_id and the longest prefix whose every shorter prefix, too, has at most ``budget`` tokens."""
    counts = prefix_token_counts(docs.selectExpr("struct(doc_id, text) AS r", "doc_id", "text").select("doc_id", "text"), tokenizer)
    cut = counts.selectExpr("doc_id", f"coalesce(array_position(transform(prefix_tokens, x -> x > {int(budget)}), true) - 2, -1) AS at", "size(prefix_tokens) - 1 AS n")
    return cut.selectExpr("doc_id", "if(at < 0, n, at) AS n_chars")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir).select("doc_id", "text"), tokenizer_path("byte_bpe_50k.json"))
