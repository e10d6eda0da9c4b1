"""Personal data: base patterns, wide candidate generators, boosted trees over format and context, calibrated thresholds.

Everything runs as DataFrame and SQL functions. A text is cut at a pattern's matches (``split``) and the matches themselves
are extracted, so that the code-point positions follow from running sums inside the row: no row is exploded and nothing is
shuffled. The trees are fitted with ``GBTClassifier`` on a bounded sample of candidates, then written out as SQL.

Base spans are always kept. Candidates of the wide generators that overlap no base span of their kind are added when their
score reaches their kind's threshold, set on held-out candidates so that precision is at least ``min_precision``. A kind with
fewer than five such candidates has no threshold, and its base spans alone are returned.

Training labels are derived from the corpus: base spans found in a bounded sample of documents, each also rewritten the way
people obscure them ("at", "dot", without "+", other separators), are findings; candidates outside of base spans, and base
spans spoiled (wrong check digit, octet beyond 255, no top-level domain, glued to letters), are not.

Defined results: null and empty texts have no spans (``base_sha256`` of the empty string, ``spans`` empty). Rows with null
or repeated ``doc_id`` are each answered on their own. Of spans that start together the kinds stand in the order email, ip,
card, phone. With too few findings to fit and calibrate on (as in an empty table) only base spans are returned. Other
columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meadowline.llm.common import documents, lowest, materialize

#: The kinds in their order, and the base patterns. Possessive forms and the look-behind only keep the
#: matcher from trying starts inside a run that has failed as a whole; what they match is the same.
KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wide generators: written-out or bracketed signs in any case, other brackets, missing "+", other separators. No part of them
#: has an upper length where what is looked for has none; possessive quantifiers keep them linear.
WIDE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?[\[({<]\x20?(?:at|@)\x20?[\])}>]\x20?|\x20at\x20|\x20?@\x20?)[A-Za-z0-9-]++(?:(?:\x20?[\[({<]\x20?(?:dot|[.])\x20?[\])}>]\x20?|\x20dot\x20|[.])[A-Za-z0-9-]{2,}+)++",
    "ip": r"(?i)(?<![0-9.])[0-9]{1,3}+(?:(?:\x20?[\[({<]\x20?(?:dot|[.])\x20?[\])}>]\x20?|\x20dot\x20|\x20?[.]\x20?)[0-9]{1,3}+){3}+(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}+(?:[\x20./_,:-]{1,3}+[0-9]{4,6}+){2,3}+(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+|00)?+\(?[0-9]{2,4}+\)?+(?:[\x20./-]{1,2}+\(?[0-9]{2,4}+\)?+){2,4}+(?![0-9])",
}
#: What a text must hold for a pattern to match at all, looked for first. A base pattern's hint is implied by that pattern.
_BASE_HINT = {"email": "text LIKE '%@%'", "ip": "text rlike '[0-9]'", "card": "text rlike '[0-9]'", "phone": "text LIKE '%+%'"}
_WIDE_HINT = {"email": "(text LIKE '%@%' OR text rlike '(?i)[\\\\x20(\\\\[{<]at[\\\\x20)\\\\]}>]')", "ip": "text rlike '[0-9]'", "card": "text rlike '[0-9]{4}'", "phone": "text rlike '[0-9]{2}'"}
CONTEXT = 32
_SPAN = "array<struct<start:int,kind:int,end:int,m:string>>"


def _quote(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _luhn(m: str) -> str:
    d = _digits(m)
    return f"(aggregate(sequence(1, length({d})), 0, (s, i) -> s + if(i % 2 = 1, 1, 2) * int(substring({d}, -i, 1)) - if(i % 2 = 0 AND substring({d}, -i, 1) > '4', 9, 0)) % 10 = 0)"


_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"


def _valid(kind: str, m: str) -> str:
    if kind == "ip":
        return f"{m} rlike '^{_OCTET}(?:[.]{_OCTET}){{3}}$'"
    if kind == "card":
        return f"(length({_digits(m)}) BETWEEN 14 AND 19 AND {_luhn(m)})"
    if kind == "phone":
        return f"length({_digits(m)}) BETWEEN 10 AND 15"
    return "true"


def _find(pattern: str, kind: int, hint: str, valid: str) -> str:
    """SQL for the spans of one pattern in ``text``: leftmost, non-overlapping, those that fail ``valid`` dropped."""
    p = _quote(pattern)
    return f"""if({hint} AND text rlike {p}, aggregate(
      zip_with(split(text, {p}, -1), regexp_extract_all(text, {p}, 0), (gap, hit) -> named_struct('gap', length(gap), 'm', hit)),
      named_struct('at', 0, 'found', cast(array() AS {_SPAN})),
      (acc, x) -> named_struct('at', acc.at + x.gap + coalesce(length(x.m), 0), 'found',
        if(x.m IS NULL OR NOT {valid}, acc.found, concat(acc.found, array(named_struct('start', acc.at + x.gap, 'kind', {kind}, 'end', acc.at + x.gap + length(x.m), 'm', x.m))))),
      acc -> acc.found), cast(array() AS {_SPAN}))"""


def base_spans() -> str:
    found = [_find(BASE[k], i, _BASE_HINT[k], _valid(k, "x.m")) for i, k in enumerate(KINDS)]
    return f"concat({', '.join(found)})"


def wide_spans() -> str:
    found = [_find(WIDE[k], i, _WIDE_HINT[k], "true") for i, k in enumerate(KINDS)]
    return f"concat({', '.join(found)})"


def _features(kind: str, m: str, before: str, after: str) -> str:
    """Format and context of a candidate as an array of doubles."""
    plain = f"regexp_replace({m}, '(?i)\\\\x20?[\\\\[({{<]\\\\x20?(?:at|dot|@|[.])\\\\x20?[\\\\])}}>]\\\\x20?|\\\\x20(?:at|dot)\\\\x20|\\\\x20?[.]\\\\x20?', '.')"
    d = _digits(m)
    return f"""array(double({kind}), double(length({m})), double(length({d})), length({d}) / length({m}),
      double(length({d}) > 0 AND {_luhn(m)}), double({plain} rlike '^{_OCTET}(?:[.]{_OCTET}){{3}}$'),
      double({m} LIKE '+%' OR {m} LIKE '00%'), double({m} LIKE '%@%'),
      double({m} rlike '(?i)[\\\\[({{<]\\\\x20?(?:at|dot|@|[.])\\\\x20?[\\\\])}}>]'), double({m} rlike '(?i)\\\\x20(?:at|dot)\\\\x20'),
      double(length(regexp_replace({m}, '[A-Za-z0-9]', ''))), double({before} rlike '[A-Za-z0-9]$'), double({after} rlike '^[A-Za-z0-9]'),
      double(lower({before}) rlike 'mail|phone|tel|call|card|pay|address|contact|fax|mobile|whats|host|server|login'),
      double(size(array_distinct(split({d}, '')))), double({d} rlike '^(?:1|001)?[2-9][0-9]{{9}}$'),
      double({m} rlike '(?i)(?:com|org|net|edu|gov|info|io|de|fr|es|uk)$'), double(length(regexp_extract({m}, '[0-9]+', 0))))"""


_ADDED = f"""transform(wide, c -> named_struct('start', c.start, 'kind', c.kind, 'end', c.end, 'm', c.m, 'f',
  {_features('c.kind', 'c.m', f'substring(text, greatest(c.start - {CONTEXT}, 0) + 1, least({CONTEXT}, c.start))', 'substring(text, c.end + 1, 8)')}))"""


@dataclass
class PiiModel:
    """Trees as SQL over the feature array ``f``, and the margin from which a kind's candidates count."""

    margin: str | None = None
    thresholds: dict[int, float] = field(default_factory=dict)
    #: Of candidates that took no part in fitting and calibration, by kind: precision, recall, number of candidates.
    measured: dict[str, tuple[float, float, int]] = field(default_factory=dict)


def _tree_sql(lines: list[str]) -> str:
    head = lines.pop(0).strip()
    if head.startswith("Predict:"):
        return f"{float(head.split(':')[1])!r}D"
    at, op, limit = re.match(r"If \(feature (\d+) (<=|>) ([-0-9.E]+)\)", head).groups()
    yes = _tree_sql(lines)
    lines.pop(0)  # its Else
    return f"if(c.f[{at}] {op} {float(limit)!r}D, {yes}, {_tree_sql(lines)})"


def trees_sql(model) -> str:
    """A fitted GBTClassificationModel as one SQL expression over ``c.f``."""
    parts = []
    for weight, tree in zip(model.treeWeights, model.trees):
        lines = [x for x in tree.toDebugString.splitlines()[1:] if x.strip()]
        parts.append(f"{float(weight)!r}D * {_tree_sql(lines)}")
    return " + ".join(parts)


#: How findings are rewritten, and how they are spoiled, for training: (kind, label, SQL of the new text of span ``m``).
REWRITES = (
    (0, 1, "replace(replace(m, '@', ' at '), '.', ' dot ')"), (0, 1, "replace(m, '@', ' [at] ')"), (0, 1, "replace(replace(m, '@', '(at)'), '.', '(dot)')"),
    (0, 0, "regexp_replace(replace(m, '@', ' at '), '[.].*$', '.it')"), (0, 0, "concat(regexp_replace(m, '@.*$', ''), ' at the.inner')"),
    (1, 1, "replace(m, '.', '[.]')"), (1, 1, "replace(m, '.', ' dot ')"), (1, 0, "regexp_replace(m, '^[0-9]+', '999')"), (1, 0, "concat('3', lpad(m, 9, '7'), '.400')"),
    (2, 1, "regexp_replace(regexp_replace(m, '[^0-9]', ''), '^(....)(....)(....)(....)$', '$1.$2.$3.$4')"), (2, 1, "regexp_replace(regexp_replace(m, '[^0-9]', ''), '^(....)(....)(....)(....)$', '$1/$2/$3/$4')"),
    (2, 0, "regexp_replace(translate(regexp_replace(m, '[^0-9]', ''), '0123456789', '3141592653'), '^(....)(....)(....)(....)$', '$1.$2.$3.$4')"),
    (3, 1, "replace(regexp_replace(m, '^[+][0-9]+ ', ''), '-', '.')"), (3, 1, "concat('00', substring(m, 2))"), (3, 1, "regexp_replace(m, '^[+][0-9]+ ', '')"),
    (3, 0, "substring(regexp_replace(m, '[()]', ''), -8)"), (3, 0, "regexp_replace(m, '^.*?([0-9]{3})-([0-9]{4})$', '20$1.$2.01')"),
)


def fit(docs: DataFrame, sample_docs: int = 2000, trees: int = 12, min_precision: float = 0.98, seed: int = 7) -> PiiModel:
    """Fit on the ``sample_docs`` documents with base spans that hash lowest: the bound of the sample. Half of them teach the
    trees, a quarter sets the thresholds and a quarter measures what comes of it. Thresholds are set and measured on what they
    decide: candidates of the wide generators that are no base spans."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("doc_id", "text"))
    found = rows.where(" OR ".join(f"({_BASE_HINT[k]} AND text rlike {_quote(BASE[k])})" for k in KINDS))
    # Hashes are sorted, not texts; of repeated rows one is taken, so the bound holds for the rows, too.
    chosen = materialize(lowest(found.select("h"), sample_docs, "h").distinct())
    some = rows.join(F.broadcast(chosen), "h").dropDuplicates(["h"]).coalesce(4)  # of bounded size from here on
    some = materialize(some.withColumn("base", F.expr(base_spans())).withColumn("wide", F.expr(wide_spans())))
    around = (f"substring(text, greatest(s.start - {CONTEXT}, 0) + 1, least({CONTEXT}, s.start)) AS before", "substring(text, s.end + 1, 8) AS after")
    real = some.selectExpr("h", "text", "explode(base) AS s").selectExpr("h", "s.kind AS kind", "s.m AS m", *around)
    outside = some.selectExpr("h", "text", "explode(filter(wide, c -> NOT exists(base, b -> b.kind = c.kind AND b.start < c.end AND c.start < b.end))) AS s").selectExpr("h", "s.kind AS kind", "s.m AS m", *around, "0.0D AS label", "true AS decided")
    glued = real.selectExpr("h", "kind", "m", "concat(before, 'x9') AS before", "concat('7q', after) AS after", "0.0D AS label", "false AS decided")
    rows = real.selectExpr("*", "1.0D AS label", "false AS decided").unionByName(outside).unionByName(glued)
    for k, label, sql in REWRITES:
        kind = KINDS[k]
        wide, plain = _quote(f"^(?:{WIDE[kind]})$"), _quote(f"^(?:{BASE[kind]})$")
        made = real.where(f"kind = {k}").selectExpr("h", "kind", f"{sql} AS m", "before", "after", f"double({label}) AS label")
        rows = rows.unionByName(made.selectExpr("*", f"m rlike {wide} AND NOT (m rlike {plain} AND {_valid(kind, 'm')}) AS decided"))
    rows = materialize(rows.where("length(m) > 0").selectExpr("h", "kind", "label", "decided", f"{_features('kind', 'm', 'before', 'after')} AS f").coalesce(4))
    counts = {r.label: r.n for r in rows.where("pmod(h, 4) > 1").groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if min(counts.get(0.0, 0), counts.get(1.0, 0)) < 10:
        return PiiModel()
    learn = rows.where("pmod(h, 4) > 1").select("label", array_to_vector("f").alias("features")).coalesce(2)
    model = GBTClassifier(maxIter=trees, maxDepth=4, stepSize=0.3, seed=seed, maxBins=24, minInstancesPerNode=3).fit(learn)
    margin = trees_sql(model)
    # Of bounded number, as the sample is.
    scored = rows.where("decided AND pmod(h, 4) <= 1").selectExpr("pmod(h, 4) = 1 AS test", "kind", "label", "named_struct('f', f) AS c").selectExpr("test", "kind", "label", f"{margin} AS margin").collect()
    thresholds, measured = {}, {}
    for kind in range(len(KINDS)):
        mine = [r for r in scored if r.kind == kind]
        right = total = 0
        ranked = sorted((r for r in mine if not r.test), key=lambda r: (-r.margin, r.label))
        for i, r in enumerate(ranked):
            right, total = right + int(r.label), total + 1
            # The lowest margin at which all candidates of that margin and above have the wanted precision: halfway to the next.
            below = max(0.0, ranked[i + 1].margin) if i + 1 < len(ranked) else 0.0
            if r.margin > below and right >= min_precision * total and total >= 5:
                thresholds[kind] = (r.margin + below) / 2
        test = [r for r in mine if r.test]
        taken = [r for r in test if kind in thresholds and r.margin >= thresholds[kind]]
        hits = sum(r.label for r in taken)
        measured[KINDS[kind]] = (hits / len(taken) if taken else 1.0, hits / max(1.0, sum(r.label for r in test)), len(test))
    return PiiModel(margin, thresholds, measured)


def find_pii(docs: DataFrame, model: PiiModel) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, and ``redactions`` as structs (start, end, kind)."""
    names = "array('email', 'ip', 'card', 'phone')"
    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("base", F.expr(base_spans()))
    if model.margin and model.thresholds:
        enough = " OR ".join(f"(c.kind = {k} AND {model.margin} >= {t!r}D)" for k, t in model.thresholds.items())
        out = out.withColumn("wide", F.expr(f"filter({wide_spans()}, c -> NOT exists(base, b -> b.kind = c.kind AND b.start < c.end AND c.start < b.end))"))
        added = f"if(size(wide) = 0, cast(array() AS {_SPAN}), transform(filter({_ADDED}, c -> {enough}), c -> named_struct('start', c.start, 'kind', c.kind, 'end', c.end, 'm', c.m)))"
        out = out.withColumn("found", F.expr(f"array_sort(concat(base, {added}))"))
    else:
        out = out.withColumn("found", F.expr("array_sort(base)"))
    text_of = lambda a: f"array_join(transform({a}, s -> concat({names}[s.kind], ':', s.start, ':', s.end)), ',')"
    return out.select(
        "doc_id",
        *(F.expr(f"bigint(size(filter(base, s -> s.kind = {i})))").alias(f"n_{k}") for i, k in enumerate(KINDS)),
        F.sha2(F.expr(text_of("array_sort(base)")), 256).alias("base_sha256"),
        F.expr(text_of("found")).alias("spans"),
        F.expr(f"transform(found, s -> named_struct('start', s.start, 'end', s.end, 'kind', {names}[s.kind]))").alias("redactions"),
    )


def redact(docs: DataFrame, model: PiiModel) -> DataFrame:
    """The documents with every found span replaced by ``[KIND]``; overlapping spans become one."""
    keep = docs.columns
    rows = docs.withColumn("_row", F.struct(*(F.col(c) for c in keep)))
    found = find_pii(rows.select(F.col("_row").alias("doc_id"), F.col("text")), model)
    cut = """aggregate(redactions, named_struct('at', 0, 'out', ''), (a, s) -> if(s.end <= a.at, a, named_struct('at', s.end, 'out',
      concat(a.out, if(s.start >= a.at, concat(substring(t, a.at + 1, s.start - a.at), '[', upper(s.kind), ']'), '')))), a -> concat(a.out, substring(t, a.at + 1)))"""
    found = found.withColumn("t", F.coalesce(F.col("doc_id.text"), F.lit("")))
    return found.select(*(F.expr(cut).alias("text") if c == "text" else F.col(f"doc_id.{c}").alias(c) for c in keep))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return find_pii(docs, fit(docs)).drop("redactions")
