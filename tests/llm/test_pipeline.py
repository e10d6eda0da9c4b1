"""The pipeline's stages against what the operators' brute-force tests establish, on the smallest tables."""

import corpus_pipeline


def test_stages_keep_columns_and_take_effect(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, data))
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[1] < counts[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    rows = corpus_pipeline.run(spark, data)
    assert sorted(map(str, rows.collect())) == sorted(map(str, packed.collect()))
