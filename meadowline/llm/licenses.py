"""License detection by a positional index of rare words.

Templates are licence notices and base phrases; every word of a template that stands at few places of all templates has
postings (template, position) in the index. Over the whole corpus the document frequency of each template word gives its IDF.
A file's own highest-IDF licence words are looked up, together with the two highest-IDF words of each mandatory phrase that it
holds, so that no place of a phrase depends on how many words are looked up. Each posting shifted by its position names a
place where the template would begin; a place that two words agree on is verified word by word on the mandatory phrases. The
score is the share of the template's IDF that stands in its place there. All of it are array functions inside the row: no
shuffle but the one of the word counts, which has one row per template word.

Defined results: null and empty texts have no words, no labels and score 0. Rows with null or repeated ``doc_id`` are each
answered on their own. Equal labels found in several places count once in ``labels``. Words of equal IDF go by their
spelling. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meadowline.llm.common import documents
from meadowline.llm.notices import BASE, NOTICES

#: Licence words that are looked up for a file besides those of its phrases.
FILE_WORDS = 8
#: A word at more places of the templates than this says little about where it stands; it has postings for its phrases only.
MAX_POSTINGS = 12
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A place is kept as one number, template * _SPAN + _FIRST + place in the text. Places before the text are those of notices
#: whose beginning is cut off.
_SPAN, _FIRST = 1 << 32, 1 << 20


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    base: bool = False

    @cached_property
    def _parts(self) -> list[tuple[bool, list[str]]]:
        pieces = re.split(r"\[(.*?)\]", self.text, flags=re.S)
        return [(i % 2 == 1, re.findall("[0-9a-z]+", piece.lower())) for i, piece in enumerate(pieces)]

    @cached_property
    def words(self) -> list[str]:
        return [w for _, ws in self._parts for w in ws]

    @cached_property
    def phrases(self) -> list[tuple[int, list[str]]]:
        """Mandatory phrases with their positions in the template."""
        out, at = [], 0
        for mandatory, ws in self._parts:
            if mandatory:
                out.append((at, ws))
            at += len(ws)
        return out


TEMPLATES = [Template(label, f"[{phrase}]", True) for label, phrase in BASE.items()] + [Template(*x) for x in NOTICES]
VOCABULARY = sorted({w for t in TEMPLATES for w in t.words})


def words(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z only."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _words(values) -> Column:
    """An array of words, which hold no blanks, as one literal."""
    return F.split(F.lit(" ".join(values)), " ") if values else F.array().cast("array<string>")


def _numbers(values, kind: str) -> Column:
    return _words([repr(v) for v in values]).cast(f"array<{kind}>")


def word_idf(docs: DataFrame) -> dict[str, float]:
    """IDF of every template word over all documents. What reaches the driver has one row per template word."""
    seen = docs.select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect(_words(VOCABULARY), words(F.col("text"))))).alias("w"))
    n = {r.w: r.n for r in seen.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = n.get("", 0)  # the empty word stands once for every document
    return {w: math.log((total + 1) / (n.get(w, 0) + 1)) for w in VOCABULARY}


def rarest(idf: dict[str, float], phrase: list[str], n: int = 2) -> list[str]:
    """The phrase's ``n`` different words of highest IDF; of equal ones the longer, then the first by spelling."""
    return sorted(set(phrase), key=lambda w: (-idf[w], -len(w), w))[:n]


def build_index(idf: dict[str, float]) -> dict[str, list[tuple[int, int]]]:
    """Postings (template, position) of the words of all templates. Words at many places keep those in which they are among
    the rarest of a mandatory phrase."""
    index: dict[str, list[tuple[int, int]]] = {}
    for t, template in enumerate(TEMPLATES):
        for at, w in enumerate(template.words):
            index.setdefault(w, []).append((t, at))
    asked = {(w, t, at + i) for t, x in enumerate(TEMPLATES) for at, phrase in x.phrases for w in rarest(idf, phrase) for i, v in enumerate(phrase) if v == w}
    few = {w: posts if len(posts) <= MAX_POSTINGS else [p for p in posts if (w, *p) in asked] for w, posts in index.items()}
    return {w: posts for w, posts in few.items() if posts}


def find_licenses(docs: DataFrame, idf: dict[str, float]) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and the ``places`` found
    (label, start of the template; below 0 where its beginning is cut off)."""
    index = build_index(idf)
    by_idf = sorted(index, key=lambda w: (-idf[w], w))
    of_phrases = sorted({w for x in TEMPLATES for _, phrase in x.phrases for w in rarest(idf, phrase)})
    # A place needs the rarest word of a mandatory phrase, so a file without any of these has none.
    gate = sorted({rarest(idf, x.phrases[0][1], 1)[0] for x in TEMPLATES})
    postings = F.create_map(*(x for w in by_idf for x in (F.lit(w), _numbers([t * _SPAN + _FIRST - at for t, at in index[w]], "bigint"))))

    rows = docs.select("doc_id", words(F.col("text")).alias("w"))
    held = lambda of: F.array_intersect(_words(of), F.col("w"))  # noqa: E731 - in the order of the literal
    looked_up = F.array_union(F.slice(held(by_idf), 1, FILE_WORDS), held(of_phrases))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    rows = rows.withColumn("rare", F.when(F.arrays_overlap("w", _words(gate)), looked_up).otherwise(none("string")))
    rows = rows.withColumn("posts", F.transform("rare", lambda w: postings[w]))
    hits = F.filter(F.transform("w", lambda w, i: F.struct(F.array_position("rare", w).cast("int").alias("r"), i.cast("bigint").alias("i"))), lambda h: h.r > 0)
    starts = F.flatten(F.transform(hits, lambda h: F.transform(F.get("posts", h.r - 1), lambda p: p + h.i)))
    rows = rows.withColumn("starts", F.when(F.size("rare") > 0, F.sort_array(starts)).otherwise(none("bigint")))
    # Sorted, places on which words agree are runs of equal numbers; the second of a run stands for it.
    second = lambda x, i: (i > 0) & (F.get("starts", i - 1) == x) & ~((i > 1) & F.coalesce(F.get("starts", i - 2) == x, F.lit(False)))
    place = lambda x: F.struct(F.floor(x / _SPAN).cast("int").alias("t"), (F.pmod(x, F.lit(_SPAN)) - _FIRST).cast("int").alias("s"))
    agreed = F.transform(F.filter("starts", second), place)

    phrases = F.array(*(F.array(*(F.struct(F.lit(at).alias("at"), _words(p).alias("p")) for at, p in x.phrases)) for x in TEMPLATES))
    begins = lambda x, m: x.s + m["at"]
    at_phrase = lambda x, m: (begins(x, m) >= 0) & (F.slice("w", F.greatest(begins(x, m), F.lit(0)) + 1, F.size(m["p"])) == m["p"])
    stands = lambda x: F.forall(phrases[x.t], lambda m: at_phrase(x, m))
    rows = rows.withColumn("places", F.filter(agreed, stands))

    # What each word of a template weighs: its share of the template's IDF. All have a little, or words in every file had none.
    mass = [sum(idf[w] + 0.01 for w in x.words) for x in TEMPLATES]
    texts = F.array(*(_words(x.words) for x in TEMPLATES))
    weights = F.array(*(_numbers([(idf[w] + 0.01) / m for w in x.words], "double") for x, m in zip(TEMPLATES, mass)))

    def strength(x: Column) -> Column:
        shares = F.transform(texts[x.t], lambda w, i: F.when((x.s + i >= 0) & (F.get("w", x.s + i) == w), F.get(weights[x.t], i)).otherwise(0.0))
        return F.aggregate(shares, F.lit(0.0), lambda a, b: a + b)

    label = _words([x.label for x in TEMPLATES])
    base = F.transform(F.filter("places", lambda x: x.t < len(BASE)), lambda x: x.s)
    named = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda x: label[x.t]))), ",")
    score = F.array_max(F.transform("places", strength))
    return rows.withColumn("base", base).select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base").cast("long").alias("first_word"),
        F.array_max("base").cast("long").alias("last_word"),
        named(F.filter("places", lambda x: x.t < len(BASE))).alias("base_labels"),
        named(F.col("places")).alias("labels"),
        F.when(F.size("places") > 0, F.least(score, F.lit(1.0))).otherwise(0.0).alias("score"),
        F.transform("places", lambda x: F.struct(label[x.t].alias("label"), x.s.alias("start"))).alias("places"),
    )


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return find_licenses(docs, word_idf(docs)).drop("places")
