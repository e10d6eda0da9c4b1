"""Secret scan: wide candidates, and a random forest that takes false positives out.

Candidates are provider formats, values assigned to key-like names (quoted ones up to the closing quote, with whatever they hold),
passwords in addresses, and long unbroken runs of key characters. The forest looks
at a candidate's length, its character classes, how likely its character transitions are in the corpus' own words, how much
of it dictionary words cover, the document's path or source, and the neighbouring words. A candidate may have any length; of
one of more than ``FEATURE_CHARS`` characters the features see the first ones, and findings give the whole span. Dictionary and transitions are
counted over all documents (the dictionary is their ``dictionary_words`` most frequent words).

Labelled findings for training are planted: into contexts cut from a bounded sample of documents go secrets (provider formats,
random values under secret-like names, random key runs) and hard negatives (digests and identifiers under their names,
placeholders, values made of the corpus' words, paths, numbers, joined words). The label says what was planted and follows
from no feature. A quarter of the documents is held out, and precision and recall of what was planted there are measured.
``labels`` may be given instead: candidate rows (label, f, and held, which keeps a row out of fitting).

Defined results: null and empty texts have no candidates. Rows with null or repeated ``doc_id`` are each answered on their
own. Where candidates overlap provider formats come first, then longer ones, and of the others the parts that are left stay if
they are long enough by themselves. With too few labelled candidates (as
in an empty table) all candidates but runs count as findings. A missing ``source`` counts as an
empty path. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meadowline.llm.common import _WORD, as_bytes, ascii_words, documents, lowest, materialize, ship, slices

#: Public formats of keys, and names that go before secrets, digests and placeholders.
PROVIDERS = (
    r"AKIA[0-9A-Z]{16}", r"gh[pousr]_[A-Za-z0-9]{36}", r"xox[abprs]-[A-Za-z0-9-]{10,}+", r"AIza[0-9A-Za-z_-]{35}", r"sk_live_[0-9a-zA-Z]{16,}+",
    r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+",
    r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:(?:[A-Za-z0-9+/=\s,:]|-(?!----))*+-----END [A-Z ]{0,20}PRIVATE KEY-----)?",
)
SECRET_NAMES = ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "access_key", "auth", "credential", "private_key")
DIGEST_NAMES = ("commit", "sha1", "sha256", "md5", "checksum", "digest", "revision", "uuid", "etag", "integrity")
PLACEHOLDERS = ("your_token_goes_here", "changeme_changeme", "xxxxxxxxxxxxxxxxxxxxxxxx", "example_example_example", "insert_password_here", "0000000000000000000000")
KINDS = ("provider", "assignment", "run", "address")
#: A candidate, or what others leave of it, has so many characters at least.
LEAST = (8, 8, 20, 4)
#: Assigned values and runs have no upper length; possessive quantifiers keep the search linear.
_PATTERNS = (
    re.compile(r"(?<![A-Za-z0-9])(" + "|".join(PROVIDERS) + r")(?![A-Za-z0-9])"),
    re.compile(r"(?i)(?:" + "|".join((*SECRET_NAMES, *DIGEST_NAMES)) + r")[\"']?\s{0,3}(?:=>|:=|[:=])\s{0,3}"
               r"(?:\"((?:[^\"\\\n]|\\.)++)\"|'((?:[^'\\\n]|\\.)++)'|[\"']?([^\s\"'`<>,;(){}\[\]]{8,}+))"),
    re.compile(r"(?<![A-Za-z0-9+/_=-])([A-Za-z0-9+/_=-]{20,}+)"),
    re.compile(r"[A-Za-z0-9+.]://[^\s/@:'\"]{0,256}+:([^\s/'\"]{4,})@(?=[A-Za-z0-9\[])"),
)
#: Features other than the length are computed from so many characters of a candidate at most; its span is never cut.
FEATURE_CHARS = 512
_MARKS = ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "AIza", "sk_live_", "eyJ", "-----BEGIN")


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of non-overlapping candidates, by code points: provider formats first, then longer spans."""
    found = []
    # What a pattern cannot match without is looked for first.
    there = (any(x in text for x in _MARKS), "=" in text or ":" in text, True, "://" in text)
    for kind, pattern in enumerate(_PATTERNS):
        if not there[kind]:
            continue
        for m in pattern.finditer(text):
            start, end = m.span(m.lastindex or 1)
            while start < end and text[start].isspace():
                start += 1
            while start < end and text[end - 1].isspace():
                end -= 1
            if end - start >= LEAST[kind]:
                found.append((start, end, kind))
    starts: list[int] = []
    taken: list[tuple[int, int, int]] = []
    for start, end, kind in sorted(found, key=lambda s: (s[2] != 0, s[0] - s[1], s[2], s[0])):
        i = bisect.bisect_right(starts, start)
        if i and taken[i - 1][1] > start:
            start = taken[i - 1][1]
        while start < end:  # the parts between what is taken
            stop = min(end, taken[i][0]) if i < len(taken) else end
            a, b = start, stop
            while a < b and text[a].isspace():
                a += 1
            while a < b and text[b - 1].isspace():
                b -= 1
            if b - a >= LEAST[kind]:
                starts.insert(i, a)
                taken.insert(i, (a, b, kind))
                i += 1
            if stop == end:
                break
            start, i = taken[i][1], i + 1
    return taken


@dataclass
class Corpus:
    """Counts over all documents: frequent words and the log likelihood of letter pairs in all words."""

    words: frozenset[str]
    pairs: dict[str, float]
    floor: float

    def likelihood(self, s: str) -> float:
        s = s.lower()
        return sum(self.pairs.get(s[i : i + 2], self.floor) for i in range(len(s) - 1)) / max(1, len(s) - 1)

    def coverage(self, s: str) -> float:
        """Share of the characters that dictionary words of at least four letters cover, from the left, longest first."""
        s, at, hit = s.lower(), 0, 0
        while at < len(s):
            size = next((k for k in range(min(16, len(s) - at), 3, -1) if s[at : at + k] in self.words), 0)
            hit, at = hit + size, at + (size or 1)
        return hit / max(1, len(s))


_ALNUM = np.array([48 <= c <= 57 or 97 <= c <= 122 for c in range(256)])


def pair_counts(texts: list[bytes]) -> dict[str, int]:
    """Pairs of neighbouring characters within the texts' words. Pairs that hold a character beyond ASCII, which no candidate
    has, count together as the empty string: at most 36 x 36 + 1 keys."""
    b = np.frombuffer(b" ".join(texts).translate(_WORD) + b" ", dtype=np.uint8)
    words = np.count_nonzero((b[:-1] != 32) & (b[1:] == 32))
    characters = np.count_nonzero((b != 32) & (b & 0xC0 != 0x80))
    both = _ALNUM[b[:-1]] & _ALNUM[b[1:]]
    n = np.bincount(b[:-1][both].astype(np.int64) << 8 | b[1:][both], minlength=1)
    out = {chr(k >> 8) + chr(k & 255): int(n[k]) for k in np.flatnonzero(n).tolist()}
    return {"": int(characters - words - n.sum()), **out}


def corpus_counts(docs: DataFrame, dictionary_words: int = 5000) -> Corpus:
    """Word and letter pair counts of all documents in one pass. What reaches the driver is of bounded size: the pairs' sums
    over all words, and the most frequent words (of 2 to 24 bytes), which are the dictionary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = as_bytes(part.column("text"))
                pairs, n = pair_counts(texts), Counter()
                for t in texts:
                    n.update(ascii_words(t))
                n = {k: v for k, v in n.items() if 2 <= len(k) <= 24}
                cells = [pa.array([False] * len(pairs) + [True] * len(n)), pa.array([*pairs, *(k.decode() for k in n)], pa.string()), pa.array([*pairs.values(), *n.values()], pa.int64())]
                yield pa.RecordBatch.from_arrays(cells, names=["is_word", "key", "n"])

    counted = docs.select("text").mapInArrow(run, "is_word boolean, key string, n long").groupBy("is_word", "key").agg(F.sum("n").alias("n"))
    top = lowest(counted, 36 * 36 + 1 + dictionary_words, "is_word", F.desc("n"), "key").collect()
    pairs = {r.key: r.n for r in top if not r.is_word}
    total = sum(pairs.values()) + 1
    return Corpus(frozenset([r.key for r in top if r.is_word][:dictionary_words]), {k: math.log(v / total) for k, v in pairs.items() if k}, math.log(0.5 / total))


def features(text: str, start: int, end: int, kind: int, path: str, corpus: Corpus, value: str | None = None, name: str | None = None) -> list[float]:
    """Features of the candidate at (start, end); ``value`` and ``name`` put another value there, or another name before it."""
    size = end - start if value is None else len(value)
    s = (text[start : min(end, start + FEATURE_CHARS)] if value is None else value)[:FEATURE_CHARS]
    before = (text[max(0, start - 40) : start] if name is None else name).lower()
    after = text[end : end + 24].lower()
    n = len(s)
    counts = Counter(s)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    changes = sum((a.isdigit() != b.isdigit()) or (a.isupper() != b.isupper()) for a, b in zip(s, s[1:]))
    place = path.lower()
    return [
        float(kind), min(size, 200) / 10.0, entropy, changes / n, sum(c.isdigit() for c in s) / n, sum(c.isupper() for c in s) / n,
        sum(not c.isalnum() for c in s) / n, float(bool(re.fullmatch(r"[0-9a-fA-F]+", s))), corpus.likelihood(s), corpus.coverage(s),
        float(any(w in before for w in SECRET_NAMES)), float(any(w in before for w in DIGEST_NAMES)), float(before[-1:] in ("'", '"')),
        float(any(w in place for w in ("test", "example", "doc", "sample", "fixture"))), float("example" in after or "placeholder" in after), len(counts) / n,
    ]


def _trees(model) -> list:
    """The forest as nested tuples (feature, limit, left, right) or leaves (share of findings)."""

    def node(n):
        if n.numDescendants() == 0:
            stats = list(n.impurityStats().stats())
            return stats[1] / max(1e-9, sum(stats))
        split = n.split()
        return (split.featureIndex(), split.threshold(), node(n.leftChild()), node(n.rightChild()))

    return [node(t._call_java("rootNode")) for t in model.trees]


def probability(trees: list, x: list[float]) -> float:
    total = 0.0
    for t in trees:
        while isinstance(t, tuple):
            t = t[2] if x[t[0]] <= t[1] else t[3]
        total += t
    return total / len(trees)


_MARKED = "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789!@#$%^&*+-_=?."
_HEX, _B64 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def plant(rng: random.Random, words: list[str]) -> tuple[str, str, str, float]:
    """What goes before a value, the value, what goes after it, and whether it is a secret."""
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    value = lambda: some(rng.choice((_HEX, _B64, _B64[:62])), rng.choice((16, 20, 24, 32, 40, 48, 64)))
    word = lambda: rng.choice(words) if words else some("etaoin", 6)
    joined = lambda: rng.choice("_-./").join(word() for _ in range(rng.randint(3, 6)))
    quote = rng.choice(("", '"', "'"))
    under = lambda names: rng.choice(names) + rng.choice((" = ", "=", ": ", ":")) + quote
    url = lambda: rng.choice(("postgres", "https", "redis", "amqp", "mongodb+srv", "ftp")) + "://" + word() + ":"
    kind = rng.randrange(15)
    if kind == 10:
        return under(SECRET_NAMES), some(_MARKED, rng.randint(9, 28)), quote or " ", 1.0
    if kind == 11:
        q = rng.choice("\"'")
        return rng.choice(SECRET_NAMES) + rng.choice((" = ", "=", ": ", q + ": ")) + q, some(_MARKED, rng.randint(9, 40)), q, 1.0
    if kind == 12:
        return url(), some(_MARKED[:-16] + "!$^*_-", rng.randint(8, 24)), "@" + word() + "." + rng.choice(("net", "local/db", "io:5432")), 1.0
    if kind == 13:
        return url(), rng.choice(("password", "pass", word(), "<password>", "${PASSWORD}", "user", "secret", "changeme")), "@" + word() + ".net", 0.0
    if kind == 14:
        q = rng.choice("\"'")
        code = ("os.environ['TOKEN']", "process.env.API_KEY", "config.get_secret_value", "getpass.getpass", "${SECRET_TOKEN}", "$PASSWORD_FILE", "settings.auth_token", "None_or_empty_value")
        return under(SECRET_NAMES) if rng.random() < 0.5 else rng.choice(SECRET_NAMES) + ": " + q, rng.choice((" ".join(word() for _ in range(rng.randint(2, 7))), rng.choice(code))), q, 0.0
    if kind == 0:
        token = rng.choice(("AKIA" + some(_B64[:26] + "0123456789", 16), "ghp_" + some(_B64[:62], 36), "xoxb-" + some("0123456789", 11) + "-" + some(_B64[:62], 24), "AIza" + some(_B64[:62] + "_-", 35), "sk_live_" + some(_B64[:62], 24)))
        return rng.choice(("", under(SECRET_NAMES), "key ")), token, rng.choice((quote, " ")), 1.0
    if kind <= 3:
        return under(SECRET_NAMES), value(), quote, 1.0
    if kind == 4:
        return rng.choice(("key ", "use ", "with ", quote)), some(_B64, rng.choice((32, 40, 64))), " ", 1.0
    if kind == 5:
        return under(DIGEST_NAMES), some(_HEX, rng.choice((32, 40, 64))), quote, 0.0
    if kind == 6:
        return rng.choice(("", under(DIGEST_NAMES), "id ")), "-".join(some(_HEX, n) for n in (8, 4, 4, 4, 12)), quote, 0.0
    if kind == 7:
        return under(SECRET_NAMES), rng.choice((*PLACEHOLDERS, "x" * rng.randint(8, 30), "*" * 3 + "_" * 8)), quote, 0.0
    if kind == 8:
        return under(SECRET_NAMES), joined(), quote, 0.0
    return rng.choice(("", "see ", "the ")), rng.choice((joined(), "".join(word().capitalize() for _ in range(5)), some("0123456789", rng.randint(20, 30)), "=" * 30)), " ", 0.0


def labelled(docs: DataFrame, corpus: Corpus, sample_docs: int = 3000, each: int = 6) -> DataFrame:
    """Training rows (label, f, held, item) from the ``sample_docs`` documents that hash lowest, ``each`` values planted in every
    one: a row for each candidate at a value, whose label says what was planted, and one without features for a secret that no
    candidate covers by four fifths. ``item`` numbers the secrets planted."""
    rows = docs.select("text", "source").withColumn("h", F.xxhash64("text", "source"))
    chosen = materialize(lowest(rows.where("text IS NOT NULL").select("h"), sample_docs, "h").distinct())
    some = rows.join(F.broadcast(chosen), "h").dropDuplicates(["h"])  # of repeated rows one
    words = sorted(w for w in corpus.words if len(w) >= 4 and w.isascii())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                y, x, held, item = [], [], [], []
                for text, path, h in zip(*(part.column(c).to_pylist() for c in ("text", "source", "h"))):
                    rng = random.Random(h)
                    for k in range(each):
                        at = rng.randint(0, len(text))
                        head, value, tail, label = plant(rng, words)
                        before = text[max(0, at - 60) : at] + " " + head
                        context = before + value + tail + " " + text[at : at + 40]
                        start, end = len(before), len(before) + len(value)
                        met = [c for c in candidates(context) if c[0] < end and start < c[1]]
                        proposed = [features(context, *c, path or "", corpus) for c in met]
                        if label and not any(5 * (min(e, end) - max(s, start)) >= 4 * (end - start) for s, e, _ in met):
                            proposed.append(None)
                        for f in proposed:
                            y.append(label)
                            x.append(f)
                            held.append(h % 4 == 0)
                            item.append(f"{h}:{k}")
                cells = [pa.array(y, pa.float64()), pa.array(x, pa.list_(pa.float64())), pa.array(held, pa.bool_()), pa.array(item, pa.string())]
                yield pa.RecordBatch.from_arrays(cells, names=["label", "f", "held", "item"])

    return some.mapInArrow(run, "label double, f array<double>, held boolean, item string")


@dataclass
class Forest:
    """Trees, and on what was held out the precision of candidates and the recall of secrets (None without any)."""

    trees: list
    precision: float | None = None
    recall: float | None = None
    held_out: int = 0


def fit(docs: DataFrame, corpus: Corpus, labels: DataFrame | None = None, trees: int = 16, seed: int = 3, threshold: float = 0.5) -> Forest | None:
    rows = materialize(labels if labels is not None else labelled(docs, corpus))
    train = rows.where("NOT held AND f IS NOT NULL")
    counts = {r.label: r.n for r in train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if min(counts.get(0.0, 0), counts.get(1.0, 0)) < 10:
        return None
    forest = RandomForestClassifier(numTrees=trees, maxDepth=10, seed=seed, minInstancesPerNode=2)
    model = Forest(_trees(forest.fit(train.select("label", array_to_vector("f").alias("features")).coalesce(2))))
    item = F.col("item") if "item" in rows.columns else F.monotonically_increasing_id().cast("string")
    test = rows.where("held").select("label", "f", item.alias("item")).collect()  # of bounded number, as the sample is
    if test:
        sure = [r.f is not None and probability(model.trees, r.f) >= threshold for r in test]
        secrets = {r.item for r in test if r.label}
        missed = {r.item for r in test if r.label and r.f is None}  # not covered, whatever part of them was found
        caught = {r.item for r, yes in zip(test, sure) if r.label and yes} - missed
        model.precision, model.recall, model.held_out = sum(r.label for r, yes in zip(test, sure) if yes) / max(1, sum(sure)), len(caught) / max(1, len(secrets)), len(test)
    return model


def scan_secrets(docs: DataFrame, corpus: Corpus, forest: Forest | None, threshold: float = 0.5) -> DataFrame:
    """doc_id, n_candidates, n_findings, findings ("kind:start:end", comma-joined, by start), score (of the surest one)."""
    trees = forest.trees if forest else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = []
                for text, path in zip(part.column("text").to_pylist(), part.column("source").to_pylist()):
                    text, found, best = text or "", [], 0.0
                    spans = candidates(text)
                    for s, e, kind in spans:
                        p = float(kind != 2) if trees is None else probability(trees, features(text, s, e, kind, path or "", corpus))
                        best = max(best, p)
                        if p >= threshold:
                            found.append(f"{KINDS[kind]}:{s}:{e}")
                    out.append((len(spans), len(found), ",".join(found), best))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.float64()]
                cells = [pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 4, kinds)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *cells], names=["doc_id", "n_candidates", "n_findings", "findings", "score"])

    return docs.select("doc_id", "text", "source").mapInArrow(run, "doc_id long, n_candidates long, n_findings long, findings string, score double")


def find_secrets(docs: DataFrame) -> DataFrame:
    ship(docs.sparkSession)
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", source.alias("source"))
    corpus = corpus_counts(rows)
    return scan_secrets(rows, corpus, fit(rows, corpus))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(documents(spark, sf_dir))
