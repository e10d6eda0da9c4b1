"""Rows fetched by their places, duplicates without size switches, and the pipeline as a whole against plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from meadowline.llm import common, exact_dedup, near_dedup, quality
from meadowline.llm.common import blank_words, located, rows_at, tokenizer_path
from meadowline.llm.packing import CAPACITIES, encoding
from tests.llm.test_text_operators import contaminated


@pytest.fixture
def files(spark, tmp_path):
    """A table of several files, with columns that an operator might use itself."""
    rng = random.Random(2)
    rows = [(i, rng.choice(["one text", "another text", f"text {i}", None, f" text {i % 60}"]), i % 7) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _metadata int").selectExpr("*", "1 AS _row", "2 AS _h", "3 AS file", "4 AS position", "5 AS digest", "6 AS key", "7 AS _bits", "8 AS _changed", "9 AS `a b`")
    df.repartition(5).write.parquet(f"file://{tmp_path}/t")
    return spark.read.parquet(f"file://{tmp_path}/t")


@pytest.mark.parametrize("limit", [1, 3, 1 << 20])
def test_rows_at_places(spark, files, monkeypatch, limit):
    monkeypatch.setattr(common, "PLACE_WORDS", limit)
    docs, file, position = located(files)
    assert docs.select(file).distinct().count() == 5
    chosen = docs.select("doc_id", file.alias("file"), position.alias("position")).where("doc_id % 3 = 0")
    columns = [docs[c] for c in ("doc_id", "text", "_metadata", "a b")]
    inside = rows_at(docs, file, position, chosen.select("file", "position"), columns)
    outside = rows_at(docs, file, position, chosen.select("file", "position"), columns, inside=False)
    assert sorted(r.doc_id for r in inside.collect()) == list(range(0, 400, 3)) and sorted(r.doc_id for r in outside.collect()) == [i for i in range(400) if i % 3]
    assert inside.columns == ["doc_id", "text", "_metadata", "a b"] and {r["_metadata"] for r in inside.collect()} == set(range(7))
    assert rows_at(docs, file, position, chosen.select("file", "position").limit(0), columns).count() == 0
    assert rows_at(docs, file, position, chosen.select("file", "position").limit(0), columns, inside=False).count() == 400
    plan = outside._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "BroadcastExchange" in plan  # whatever the number of places, no row is shuffled


@pytest.mark.parametrize("limit", [1, 1 << 20])
def test_duplicates_alike_at_every_size(spark, files, monkeypatch, limit):
    monkeypatch.setattr(common, "PLACE_WORDS", limit)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    rows = files.collect()
    bare = lambda r: (r.text or "").replace(" ", "")
    groups = {}
    for r in rows:
        groups.setdefault(bare(r), []).append((-len(r.text or ""), r.doc_id))
    want = {i: (min(g)[1], len(g)) for g in groups.values() for _, i in g}
    got = exact_dedup.exact_dedup(files).collect()
    assert {r.doc_id: (r.keep_id, r.group_size) for r in got} == want and all(r.kept == (r.doc_id == r.keep_id) for r in got)
    kept = exact_dedup.stay(files)
    assert kept.columns == files.columns and sorted(r.doc_id for r in kept.collect()) == sorted({k for k, _ in want.values()})
    stayed = near_dedup.stay(files)
    assert stayed.columns == files.columns
    # Texts of fewer than five words are one shingle each, case and blanks aside; null and blank texts are linked with nothing.
    words = Counter(" ".join(x.decode() for x in blank_words((r.text or "").encode())) for r in rows)
    assert Counter(" ".join(x.decode() for x in blank_words((r.text or "").encode())) for r in stayed.collect()) == {k: (1 if k else n) for k, n in words.items()}


def test_no_body_without_a_copy_is_shuffled(spark, tmp_path, monkeypatch):
    """The exchange that brings hits' bodies together gets no row of a text that occurs once."""
    rows = [(i, f"text {i}") for i in range(3000)] + [(9000 + i, f"text {i}") for i in range(5)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"file://{tmp_path}/t")
    docs = spark.read.parquet(f"file://{tmp_path}/t")
    state, bodies = exact_dedup.StreamingDeduplicator(spark), []
    was = exact_dedup.StreamingDeduplicator._bodies
    monkeypatch.setattr(exact_dedup.StreamingDeduplicator, "_bodies", lambda self, d, r: bodies.append(was(self, d, r)) or bodies[-1])
    state.add(docs)
    assert state.collisions(docs).count() == 0 and bodies[0].count() == 10
    assert "hashpartitioning" not in bodies[0]._jdf.queryExecution().executedPlan().toString()


def test_quality_counts_lengths_itself(spark):
    texts = [("clean words here " * 9, 1), ("#!x 7 ", 0)]
    docs = spark.createDataFrame([(i, texts[i % 2][0] + str(i), "many") for i in range(60)], "doc_id long, text string, n_chars string")
    labels = spark.createDataFrame([(i, texts[i % 2][1], 0) for i in range(60)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    assert {r.doc_id % 2 for r in quality.accepted(docs, model).collect()} == {0}


# The pipeline


def similar(a, b):
    def shingles(t):
        w = blank_words((t or "").encode())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    x, y = shingles(a), shingles(b)
    return bool(x and y) and 100 * len(x & y) >= 80 * len(x | y)


def test_pipeline_equals_plain_python(spark, tmp_path):
    """Null and repeated ids, null and blank texts, copies, near copies, benchmark passages, very long texts, clashing names."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(1, prose(14)), (2, prose(5)), (3, None), (4, "")]
    base = [prose(rng.choice([3, 30, 80])) for _ in range(40)]
    texts = base + [base[0], base[1] + "  ", base[2].upper(), None, None, "", " \n", base[3] + " extra", "more " + base[4], prose(40000)]
    texts += [base[5][:40] + " " + items[0][1] + " " + prose(30), items[0][1] + " a", prose(20) + " " + items[1][1] + " " + prose(20)]
    junk = ["#@! 7 %% && $$ " * rng.randint(2, 9) for _ in range(12)]
    ids = [rng.choice([i, i, None, 7]) for i in range(len(texts))]
    rows = [(i, t, "en", "s", len(t or ""), k) for k, (i, t) in enumerate(zip(ids, texts))] + [(1000 + i, t, "en", "j", 1, 500 + i) for i, t in enumerate(junk)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, at long").selectExpr("*", "1 AS _metadata", "2 AS _row", "3 AS _changed", "4 AS h", "5 AS key", "6 AS n_tokens", "7 AS _ranges", "8 AS file", "array(1) AS bin")
    docs.repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(2000 + i, i % 2, 0) for i in range(40)] + [(1000 + i, 0, 0) for i in range(12)] + [(i, 1, 0) for i in ids if i is not None and i != 7], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    sf = f"file://{tmp_path}"
    out, stages = spark.read.parquet(f"{sf}/documents.parquet"), {}
    columns = out.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.materialize(stage(spark, out, sf))
        assert out.columns == columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes], name
        stages[name] = {r["at"]: r for r in out.collect()}
        assert len(stages[name]) == out.count()
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert set(stages["quality"]) == {r["at"] for r in quality.with_score(docs.select("at", "text"), model).where("_score >= 0.3").collect()}
    assert all(a not in stages["quality"] for a in range(500, 512)) and len(stages["quality"]) > 40
    # Exact: of equal texts the longest row, then the smallest id.
    bare = lambda t: "".join((t or "").split())
    groups = {}
    for r in stages["quality"].values():
        groups.setdefault(bare(r.text), []).append((-len(r.text or ""), r.doc_id is None, r.doc_id or 0, r["at"]))
    assert Counter(bare(r.text) for r in stages["exact_dedup"].values()) == Counter(groups.keys())
    assert all((-len(r.text or ""), r.doc_id is None, r.doc_id or 0) == min(groups[bare(r.text)])[:3] for r in stages["exact_dedup"].values())
    # Near: one of each component.
    left = list(stages["exact_dedup"].values())
    root = {r["at"]: r["at"] for r in left}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, r in enumerate(left):
        for other in left[:i]:
            if similar(r.text, other.text):
                root[find(r["at"])] = find(other["at"])
    assert Counter(find(a) for a in stages["near_dedup"]) == Counter({find(r["at"]): 1 for r in left}) and len(stages["near_dedup"]) < len(left)
    # Benchmark: no window is left, documents of which more than half was hit are gone, all others stay as they were.
    after = stages["decontaminate"]
    for r, (_, n, hit, *_) in zip(stages["near_dedup"].values(), [contaminated([(r["at"], r.text)], items)[0] for r in stages["near_dedup"].values()]):
        assert (r["at"] in after) == (2 * hit <= n)
        if r["at"] in after:
            assert (after[r["at"]].text == r.text) == (hit == 0) and after[r["at"]].n_chars == (r.n_chars if hit == 0 else len(after[r["at"]].text))
    assert not any(h for _, _, h, *_ in contaminated([(a, r.text) for a, r in after.items()], items))
    # Packing: pieces cover each document's tokens and do not overlap within a bin.
    packed = corpus_pipeline.run(spark, sf).collect()
    tokens = Counter()
    for r in after.values():
        tokens[r.doc_id] += len(encoding(tokenizer_path("byte_bpe_50k.tiktoken")).encode_ordinary(r.text or ""))
    got, bins = Counter(), {}
    for r in packed:
        got[r.doc_id] += r.n_tokens
        if r.bin is not None:
            bins.setdefault((r.block, r.bin, r.capacity), []).append((r.offset, r.n_tokens))
    assert +got == +tokens and set(got) == set(tokens)
    for (_, _, capacity), pieces in bins.items():
        ends = 0
        for offset, n in sorted(pieces):
            assert offset >= ends
            ends = offset + n
        assert ends <= capacity in CAPACITIES


def test_pipeline_of_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"file://{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
