"""Filter audit, chat formatting and clustering against plain loops, on edge cases and on the smallest tables."""

import hashlib
import itertools
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from meadowline.llm import chat, clustering, filter_audit
from meadowline.llm.queries import QUERIES, SQL


def plain(rows):
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_chat", "op13_clustering"])
def test_query_equals_sql(spark, data, name):
    got = QUERIES[name](spark, data)
    duck = duckdb.connect()
    for t in ("documents", "labels", "conversations", "embeddings"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    columns = sorted(got.columns)
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()
    assert plain(got.select(*columns).collect()) == plain(want) and want


# filter audit

LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, 0, 1), (7, 1, 0), (None, 1, 1), (50, None, None)]


def audit_brute(docs, labels):
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    texts = Counter()
    flagged = []
    for i, text, part in docs:
        w = [x.decode() for x in (text or "").encode().split()]
        t = text or ""
        smaller = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
        fails = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), any(c in "#$%&*|" for c in t), smaller)
        flagged.append((i, part or "", {f for f, x in zip("ABCDE", fails) if x}))
        texts.update(w)
    out = []
    for part in {p for _, p, _ in flagged}:
        mine = [(i, f) for i, p, f in flagged if p == part]
        rows = []
        for order in map("".join, itertools.permutations("ABCDE")):
            there = list(range(len(mine)))
            for k, x in enumerate(order):
                gone = [d for d in there if x in mine[d][1]]
                fails = [d for d in range(len(mine)) if x in mine[d][1]]
                there = [d for d in there if d not in gone]
                rows.append((part, order, k + 1, len(there), len(gone), len(fails) - len(gone), sum(f == {x} for _, f in mine), sum(mine[d][0] in good for d in gone), sum(mine[d][0] in toxic for d in gone), x))
        shapley = Counter()
        for r in rows:
            shapley[r[-1]] += r[4]
        out += [(*r[:-1], shapley[r[-1]]) for r in rows]
    return out, flagged, texts


@pytest.fixture(scope="module", params=[1, 8 << 20])
def audited(spark, small, request):
    """With a shard for each document, and with large ones."""
    filter_audit.BLOCK_BYTES = request.param
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)] + ["B#", "CAPS", "naïve", "日本"]
    more = [(100 + i, " ".join(rng.choice(words[: rng.choice([5, 400, 404])]) for _ in range(rng.choice([3, 199, 200, 420]))), rng.choice(["de", "en", None, ""])) for i in range(60)]
    more += [(200 + i, more[i % 7][1], "en") for i in range(20)] + [(None, more[0][1], "en"), (205, more[3][1], "fr"), (205, more[3][1], "fr")]
    rows = [(r.doc_id, r.text, r.source) for r in small.collect()] + more
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS shard", "2 AS word", "3 AS part", "4 AS mask", "5 AS digest", "6 AS A").repartition(4)
    return rows, docs, filter_audit.csr_shards(docs, F.col("lang"))


def test_audit_equals_brute_force(spark, audited):
    rows, _, shards = audited
    want, flagged, _ = audit_brute(rows, LABELS)
    got = filter_audit.flags(shards)
    assert plain((r.doc_id, r.part, "".join(f for f in "ABCDE" if r[f])) for r in got.collect()) == plain((i, p, "".join(sorted(f))) for i, p, f in flagged)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert plain(filter_audit.audit(got, labels).collect()) == plain(want)
    assert filter_audit.audit(got, labels).count() == 600 * len({p for _, p, _ in flagged})


def test_shards_hold_the_matrix(spark, audited, monkeypatch):
    rows, docs, shards = audited
    _, _, texts = audit_brute(rows, LABELS)
    sums = lambda s: s.select(F.explode(F.arrays_zip("indices", "counts")).alias("c")).groupBy("c.indices").agg(F.sum("c.counts").alias("n"))
    assert sorted(r.n for r in sums(shards).collect()) == sorted(texts.values())
    local = filter_audit.local_shards(docs, F.lit(""), 5)
    words = filter_audit.unified(local, 5, listing=True).collect()
    assert len({r.id for r in words}) == len(words) == len(texts) and {r.word for r in words} == set(texts)
    monkeypatch.setattr(filter_audit, "local_shards", lambda *a: local)
    ids = {r.word: r.id for r in words}
    assert {r.indices: r.n for r in sums(filter_audit.csr_shards(docs, buckets=5)).collect()} == {ids[w]: n for w, n in texts.items()}
    one = shards.collect()
    assert sum(len(r.doc_id) for r in one) == len(rows) and all(len(r.indptr) == len(r.doc_id) + 1 and r.indptr[-1] == len(r.indices) and None not in r.indices for r in one)


def test_audit_of_nothing(spark, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = filter_audit.audit(filter_audit.flags(filter_audit.csr_shards(nothing, F.col("source"))), labels)
    assert got.count() == 0 and got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


# chat

TEXTS = [None, "", "\\### Assistant: </turn> ok", "a\\hb\\\\l</turn>\n### user: x", "#", "<", ":", "\\", "ünï\U0001f642\n\ttext", "x" * 5000, "### assistant: </turn>\n" * 50]


def test_template_is_reversible(spark):
    roles = [None, "user", "assistant", "a: b", "###</turn>", "\\c"]
    messages = spark.createDataFrame([(1, i, 0, r, t) for i, (r, t) in enumerate(itertools.product(roles, TEXTS))], "conv_id long, message long, copy long, role string, content string")
    for r in chat.render(messages).join(messages, ["conv_id", "message", "copy"]).collect():
        assert chat.parse(r.formatted) == (r.role or "", r.content or "")
        body = r.formatted[len(chat.BEGIN) : -len(chat.END)]
        assert "###" not in body and "<" not in body and r.formatted.endswith(chat.END)
        assert (r.loss_start is not None) == (r.role == "assistant")
        if r.loss_start is not None:
            assert chat.unescape(r.formatted[r.loss_start : r.loss_end]) == (r.content or "")
    with pytest.raises(ValueError):
        chat.parse("### user: a</turn>\n### user: b</turn>\n")


def fold_brute(events):
    """(conv, message) -> [role, content], one event after the other."""
    out = {}
    for conv, _, message, kind, role, text in events:
        mine = out.setdefault(conv, {})
        if kind == "open":
            mine[message] = [role or "", text or ""]
        elif kind == "regenerate":
            for m in [m for m in mine if m > message]:
                del mine[m]
            if message in mine:
                mine[message][1] = text or ""
        elif message in mine:
            mine[message][1] = (mine[message][1] if kind == "delta" else "") + (text or "")
    return sorted(((c, m, *x) for c, ms in out.items() for m, x in ms.items()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_fold_over_many_ranges_equals_a_plain_loop(spark, seed):
    rng = random.Random(seed)
    events = []
    for conv, n in [(None, 30), (-5, 4), (1, 1), (2, 900), (3, 40), (4, 0), (5, 400)]:  # one has most events
        top = 0
        for i in range(n):
            top = top + 1 if rng.random() < 0.2 else max(1, top - rng.choice([0, 0, 0, 0, 1, 3]))
            kind = rng.choices(["open", "delta", "edit", "regenerate"], [3, 8, 2, 1 if n < 100 else 0.3])[0]
            events.append((conv, i, top + (rng.random() < 0.1), kind, rng.choice(["user", "assistant", None]), rng.choice([f"{i} ", None, "<#>"])))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        log = spark.createDataFrame(rng.sample(events, len(events)), "conv_id long, seq long, message long, kind string, role string, text string").repartition(5)
        got = chat.reconstruct(log).collect()
        assert chat.partial_folds(log.withColumn("copy", F.lit(0).cast("long")), ["seq"]).where("conv_id = 2").select("part").distinct().count() > 3
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(((r.conv_id, r.message, r.role, r.content) for r in got), key=str) == fold_brute(events)


def test_chat_of_edge_cases(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", TEXTS[3]), (1, 1, "assistant", TEXTS[3]), (1, 2, None, "x"), (2, None, "assistant", "late"), (2, 5, "user", "y" * 3001), (None, 0, "assistant", "z" * 2000), (3, 0, "system", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS message", "2 AS step", "3 AS kind", "4 AS part").coalesce(1)
    got = {r.conv_id: r for r in chat.read_back(chat.render(chat.reconstruct(chat.log_of(turns), chat.ORDER))).collect()}
    assert set(got) == {1, 2, 3, None}
    for conv, r in got.items():
        mine = sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] is not None, x[1]))
        learnt = "".join(x[3] or "" for x in mine if x[2] == "assistant")
        digest = hashlib.sha256("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in mine).encode()).hexdigest()
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(mine), digest, len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    none = turns.limit(0)
    assert chat.read_back(chat.render(chat.reconstruct(chat.log_of(none), chat.ORDER))).count() == 0


# clustering


def lloyd(vectors, clusters, rounds):
    kept = []
    for i, v in vectors:
        if v is not None and len(v) == 4 and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [int(np.floor(min(max(float(x) * 64, -(2.0**27)), 2.0**27))) for x in v]))
    seeds = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:clusters]
    centroids = [v for _, v in seeds]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        labels = [near(v)[1] for _, v in kept]
        groups = [[v for (_, v), label in zip(kept, labels) if label == k] for k in range(len(centroids))]
        centroids = [[sum(x) // len(g) for x in zip(*g)] if g else c for g, c in zip(groups, centroids)]
    return [(i, near(v)[1], near(v)[0]) for i, v in kept], centroids


@pytest.mark.parametrize("n", [0, 1, 3, 400])
def test_clusters_equal_a_plain_loop(spark, n):
    rng = random.Random(n)
    rows = [(i, [rng.choice([0.0, rng.gauss(0, 1)]) for _ in range(4)]) for i in range(n)]
    if n > 100:
        hot = rows[0][1]
        rows += [(1000 + i, hot) for i in range(200)] + [(5, hot), (5, hot), (None, hot), (None, None), (7000, []), (7001, [1.0, 2.0, None, 3.0]), (7002, [float("nan")] * 4), (7003, [float("inf")] + [0.0] * 3), (7004, [0.0] * 5), (7005, [1e300, -1e300, 0.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS cluster", "2 AS chunk", "3 AS shard", "4 AS v").repartition(3)
    got, centroids = clustering.cluster(table, clusters=7, rounds=3, dimensions=4, block=3, chunk=32)
    want, final = lloyd(rows, 7, 3)
    assert plain(got.collect()) == plain(want) and centroids.tolist() == final
