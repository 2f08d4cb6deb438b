"""Global order without a global sort in one task: running sums, ranks and shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import shuffle_width, stage_table


def _running(distinct: bool):
    """Sums before each row of a sorted partition, kept across its batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, last = 0, None
        for batch in batches:
            if distinct and batch.num_rows:
                key = batch.column(0).to_pylist()
                batch = batch.filter(pa.array([k != before for k, before in zip(key, [last, *key])]))
                last = key[-1]
            size = np.asarray(batch.column(1), np.int64)
            upto = np.cumsum(size) + total
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(upto - size)], [*batch.schema.names, "here"])
            total = int(upto[-1]) if len(upto) else total

    return run


def running_offsets(rows: DataFrame, key: str, size: str | Column, name: str = "start", carry: tuple[str, ...] = (), distinct: bool = False) -> DataFrame:
    """(key, size, `name`, carry...): for each row the sum of the sizes before it in the order of `key`.

    One shuffle puts the rows, with the columns to `carry`, in ranges of the key; each sorted range
    is summed up in one pass over its batches and written once. The ranges' totals (one row per
    range) are summed up in order and added. `key` must be unique, or with `distinct` one row of
    each is taken; null sizes count as 0.
    """
    spark = rows.sparkSession
    size = F.col(size) if isinstance(size, str) else size
    narrow = rows.select(key, F.coalesce(size, F.lit(0)).cast("long").alias("size"), *carry)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema) + ", here long"
    ranged = narrow.repartitionByRange(shuffle_width(spark), key).sortWithinPartitions(key)
    ranged = stage_table(ranged.mapInArrow(_running(distinct), schema).withColumn("part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("part").agg(F.sum("size").alias("total"))
    totals = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return ranged.join(F.broadcast(totals), "part").select(key, "size", (F.col("base") + F.col("here")).alias(name), *carry)


def hash_rank(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """(key, rank): ranks from 1 in the order of md5(key:seed), then key.

    The first four hex digits of the hash cut the order into 65,536 even buckets, whose counts
    are summed up; ranks are then given within buckets.
    """
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    hashed = rows.select(key, h.alias("h"), F.substring(h, 1, 4).alias("bucket"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = hashed.groupBy("bucket").count()
    counts = counts.select("bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("bucket").orderBy("h", key)
    ranked = hashed.withColumn("here", F.row_number().over(within)).join(F.broadcast(counts), "bucket")
    return ranked.select(key, (F.col("base") + F.col("here")).cast("long").alias("rank"))


def contiguous_shards(rows: DataFrame, key: str, shards: int) -> DataFrame:
    """(key, shard): order kept, sizes differing by one at most, the larger shards first."""
    placed = running_offsets(rows, key, F.lit(1), "at")
    n = rows.agg(F.count("*").alias("n"))
    out = placed.join(F.broadcast(n))  # one row
    small, more = F.floor(F.col("n") / shards), F.col("n") % shards
    edge = more * (small + 1)
    shard = F.when(F.col("at") < edge, F.floor(F.col("at") / (small + 1))).otherwise(more + F.floor((F.col("at") - edge) / F.greatest(small, F.lit(1))))
    return out.select(key, shard.cast("long").alias("shard"))
