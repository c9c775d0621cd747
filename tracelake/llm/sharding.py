"""Contiguous shards of near equal bytes, from global prefix sums over per-partition totals.

Ids, sizes and checksums (never texts) are put into one global order by a range partitioning; each partition sums its
sizes as it streams by. The totals of the partitions, a row each, give where each partition begins; a document's shard
is the one in whose equal part of all bytes its middle byte lies. Nothing is gathered in one task.

Law: `bytes`. Order: doc_id (nulls first), then size, then checksum, then place in the written table, so that no number of
equal rows (of null ids, say) has to lie in one range; repeated rows follow each other. A null text has no
bytes (size 1, checksum 0); empty shards are possible where single documents exceed a shard's part; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import work_dir, written

SHARDS = 8


def _prefix_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, size_so_far, rows_so_far = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        sizes = batch.column("size").to_numpy(zero_copy_only=False).astype(np.int64)
        ends = size_so_far + np.cumsum(sizes)
        places = np.arange(rows_so_far, rows_so_far + len(sizes), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(sizes), part, np.int64)), pa.array(ends - sizes), pa.array(places)], [*batch.schema.names, "part", "before", "place"])
        size_so_far, rows_so_far = int(ends[-1]) if len(ends) else size_so_far, rows_so_far + len(sizes)


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each row of docs."""
    spark = docs.sparkSession
    at = work_dir(spark, "sharding")
    body = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    small = written(docs.select("doc_id", (F.octet_length(body) + 1).cast("bigint").alias("size"), F.crc32(body).alias("text_crc32"), F.monotonically_increasing_id().alias("row")), f"{at}/sizes")
    keys = [F.col("doc_id").asc_nulls_first(), F.col("size"), F.col("text_crc32"), F.col("row")]
    kind = small.schema["doc_id"].dataType.simpleString()
    summed = small.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_prefix_sums, f"doc_id {kind}, size bigint, text_crc32 bigint, row bigint, part bigint, before bigint, place bigint")
    summed = written(summed, f"{at}/summed")

    # A row for each partition; their running totals are plain sums on the driver.
    totals = sorted(summed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect())
    starts, size, rows = [], 0, 0
    for part, more, n in totals:
        starts.append((part, size, rows))
        size, rows = size + more, rows + n
    offsets = F.broadcast(spark.createDataFrame(starts, "part bigint, byte0 bigint, row0 bigint"))
    # Twice the middle, so that all stays whole numbers.
    middle = 2 * (F.col("byte0") + F.col("before")) + F.col("size")
    cut = summed.join(offsets, "part").withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(max(2 * size, 1)))).cast("int")).withColumn("row", F.col("row0") + F.col("place"))  # from now on its place in the whole order
    firsts = F.broadcast(spark.createDataFrame([tuple(r) for r in cut.groupBy("shard").agg(F.min("row")).collect()], "shard int, first bigint"))
    return cut.join(firsts, "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
