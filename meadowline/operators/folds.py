"""Validation blocks and balanced spatial folds."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meadowline.functions.grid import parent_block
from meadowline.operators.sampling import with_numbers
from meadowline.sources.scratch import kept, scratch_dir


def block_ratio(validation_size: float, sampling_size: float) -> int:
    """How many sampling blocks a validation block has a side; it must be a whole number."""
    ratio = validation_size / sampling_size
    if ratio < 1 or abs(ratio - round(ratio)) > 1e-9:
        raise ValueError("the validation block must be a whole multiple of the sampling block")
    return round(ratio)


def with_validation_blocks(rows: DataFrame, ratio: int, col: str = "sampling_block_column", row: str = "sampling_block_row") -> DataFrame:
    return rows.withColumns({"validation_block_column": parent_block(F.col(col), ratio), "validation_block_row": parent_block(F.col(row), ratio)})


def validation_blocks(rows: DataFrame, reference: Column, area: Column) -> DataFrame:
    """One row for each block: number, rows, reference rows, area, reference area."""
    keys = ["validation_block_column", "validation_block_row"]
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if(reference).alias("reference_count"), F.sum(area).alias("area"), F.sum(F.when(reference, area).otherwise(0.0)).alias("reference_area")
    )
    return kept(with_numbers(kept(sums), keys, "validation_block_id").select(*keys, *sums.columns[2:], "validation_block_id"))


#: Blocks that one task deals to folds, about.
CHUNK = 1_000_000


def assign_folds(blocks: DataFrame, folds: int) -> DataFrame:
    """validation_block_id and spatial_fold (from 0).

    Whole blocks go, largest first, to the fold that is furthest behind: blocks with reference area by (reference area, area),
    then the others by area; ties go to the lower block number and fold. Each step depends on all before it, so Spark cuts blocks
    into ranges of that order, of about ``CHUNK`` each, and these are dealt one task after the other; only what each fold holds
    goes through the driver from one to the next. A range is one file, so that its task reads its own blocks alone, and all
    results are read as one table."""
    area = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    table = blocks.select(F.col("validation_block_id").cast("long").alias("id"), area("reference_area").alias("r"), area("area").alias("a"))
    table = kept(table.select((F.col("r") <= 0).alias("late"), F.when(F.col("r") > 0, -F.col("r")).otherwise(0.0).alias("by_r"), (-F.col("a")).alias("by_a"), "id", "r", "a"))
    total, enough = table.agg(F.count(F.lit(1)), F.count_if(~F.col("late"))).collect()[0]
    if enough < folds:
        raise ValueError(f"{folds} folds need as many blocks with reference area, there are {enough}")
    order = ["late", "by_r", "by_a", "id"]
    chunks = -(-total // CHUNK)
    ranges = table.repartitionByRange(chunks, *order) if chunks > 1 else table.coalesce(1)
    table = kept(ranges.withColumn("chunk", F.spark_partition_id()), "chunk")
    path = scratch_dir(blocks.sparkSession)
    schema = "id long, fold short, r double, a double, n long"
    state = [[0.0, 0.0, 0] for _ in range(folds)]
    for number in range(chunks):

        def deal(batches: Iterator[pa.RecordBatch], state=state) -> Iterator[pa.RecordBatch]:
            fields = pa.schema([("id", pa.int64()), ("fold", pa.int16()), ("r", pa.float64()), ("a", pa.float64()), ("n", pa.int64())])
            state, heap, was = [list(s) for s in state], [], None
            for batch in batches:
                chosen = []
                for late, r, a in zip(batch.column("late").to_pylist(), batch.column("r").to_pylist(), batch.column("a").to_pylist()):
                    if late != was:
                        was, heap = late, [((s[1:] if late else list(s)), f) for f, s in enumerate(state)]
                        heapq.heapify(heap)
                    fold = heap[0][1]
                    s = state[fold]
                    s[0], s[1], s[2] = s[0] + r, s[1] + a, s[2] + 1
                    chosen.append(fold)
                    heapq.heapreplace(heap, ((s[1:] if late else list(s)), fold))
                empty = [None] * len(chosen)
                yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(x, t.type) for x, t in zip((chosen, empty, empty, empty), list(fields)[1:]))], schema=fields)
            # What the folds hold at the end of the chunk, in rows without a block.
            cells = ([None] * len(state), list(range(len(state))), *zip(*state))
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(cells, fields)], schema=fields)

        chunk = table.where(F.col("chunk") == number).coalesce(1).sortWithinPartitions(*order).select("late", "id", "r", "a")
        chunk.mapInArrow(deal, schema).write.parquet(f"{path}/chunk={number}")
        if number + 1 < chunks:
            done = blocks.sparkSession.read.schema(schema).parquet(f"{path}/chunk={number}").where("id IS NULL")
            state = [[x.r, x.a, x.n] for x in sorted(done.collect(), key=lambda x: x.fold)]
    dealt = blocks.sparkSession.read.schema(schema + ", chunk int").parquet(path)
    return dealt.where("id IS NOT NULL").selectExpr("id AS validation_block_id", "fold AS spatial_fold")


def with_folds(rows: DataFrame, blocks: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows with their block number and fold: many-to-one lookups in tables of one row per block, checked to be so."""
    keys = ["validation_block_column", "validation_block_row"]
    lookup = blocks.select(*keys, "validation_block_id").join(folds, "validation_block_id")
    if lookup.groupBy(*keys).count().where("count > 1").take(1):
        raise ValueError("a block occurs twice")
    return rows.join(lookup, keys, "left")
