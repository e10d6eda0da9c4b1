"""Every query with SQL against DuckDB on the smallest tables; the others against plain loops and closed forms."""

import os

import duckdb
import numpy as np
import pytest

from meadowline import queries
from meadowline.operators import folds, sampling


def rows(frame, columns):
    plain = [tuple(None if v is None or v != v else v if isinstance(v, str) else float(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False)]
    return sorted(plain, key=lambda r: [(v is None, str(type(v)), v or 0) for v in r])


@pytest.fixture(scope="session")
def duck(data):
    connection = duckdb.connect()
    for name in os.listdir(data):
        connection.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{data}/{name}')")
    return connection


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, data, duck, name):
    mine, theirs = queries.QUERIES[name](spark, data).toPandas(), duck.sql(queries.SQL[name]).df()
    columns = sorted(theirs.columns)
    assert sorted(mine.columns) == columns
    assert rows(mine, columns) == rows(theirs, columns)


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_folds_equal_a_plain_loop(spark, data):
    blocks = queries._blocks(spark, data)
    table = blocks.toPandas().sort_values("validation_block_id")
    state, want = np.zeros((5, 3)), {}
    first = table[table.reference_area > 0].sort_values(["reference_area", "area", "validation_block_id"], ascending=[False, False, True])
    rest = table[table.reference_area <= 0].sort_values(["area", "validation_block_id"], ascending=[False, True])
    for part, order in ((first, (0, 1, 2)), (rest, (1, 2))):
        for b in part.itertuples():
            k = min(range(5), key=lambda k: (*(state[k, i] for i in order), k))
            state[k] += (b.reference_area, b.area, 1)
            want[b.validation_block_id] = k
    assert {r.validation_block_id: r.spatial_fold for r in folds.assign_folds(blocks, 5).collect()} == want
    assert queries.spatial_folds(spark, data).count() == 5


def test_folds_in_chunks_keep_blocks_off_the_driver(spark, monkeypatch):
    blocks = spark.range(300).selectExpr("id % 20 AS validation_block_column", "id div 20 AS validation_block_row", "double(id * 37 % 101) AS area", "double(if(id % 4 = 0, id * 11 % 17, 0)) AS reference_area")
    keys = ["validation_block_column", "validation_block_row"]
    monkeypatch.setattr(folds, "CHUNK", 70, raising=False)
    monkeypatch.setattr(sampling, "EDGE_SAMPLE", 64, raising=False)
    taken, collect = [], type(blocks).collect
    monkeypatch.setattr(type(blocks), "collect", lambda self: taken.append(collect(self)) or taken[-1])
    numbers = sampling.dense_block_numbers(blocks, keys, "validation_block_id")
    got = folds.assign_folds(blocks.join(numbers, keys), 5)
    assert max(map(len, taken)) <= 64
    monkeypatch.undo()
    assert [r.validation_block_id for r in numbers.orderBy(*keys).collect()] == list(range(1, 301))
    table = blocks.join(numbers, keys).collect()
    state, want = [[0, 0, 0] for _ in range(5)], {}
    for late, b in sorted(((b.reference_area <= 0, b) for b in table), key=lambda x: (x[0], -x[1].reference_area, -x[1].area, x[1].validation_block_id)):
        k = min(range(5), key=lambda k: (state[k][late:], k))
        state[k] = [state[k][0] + b.reference_area, state[k][1] + b.area, state[k][2] + 1]
        want[b.validation_block_id] = k
    assert {r.validation_block_id: r.spatial_fold for r in got.collect()} == want


def test_folds_are_read_as_one_table_and_blocks_sorted_once(spark, monkeypatch):
    blocks = spark.range(400).selectExpr("id + 1 AS validation_block_id", "double(id * 37 % 101) AS area", "double(if(id % 4 = 0, id * 11 % 17, 0)) AS reference_area")
    want = {r.validation_block_id: r.spatial_fold for r in folds.assign_folds(blocks, 5).collect()}
    monkeypatch.setattr(folds, "CHUNK", 20)
    got = folds.assign_folds(blocks, 5)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "Union" not in plan
    assert {r.validation_block_id: r.spatial_fold for r in got.collect()} == want and len(want) == 400


def test_ridge_cv_scores_every_row(spark, data):
    out = queries.ridge_cv(spark, data).collect()
    assert sum(r.rows for r in out) == spark.read.parquet(f"{data}/lineitem.parquet").count() and all(r.rmse > 0 for r in out)
