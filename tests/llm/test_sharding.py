import zlib

from pyspark.sql import functions as F

from tracelake.llm import sharding


def brute(rows, shards):
    rows = sorted(((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows), key=lambda x: (x[0] is not None, x))
    total, done, slots, out = sum(x[1] for x in rows), 0, [0] * shards, []
    for doc, size, crc in rows:
        shard = min(shards - 1, (2 * done + size) * shards // (2 * total))
        out.append((doc, size, crc, "bytes", shard, slots[shard], None))
        slots[shard] += 1
        done += size
    return out


def test_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(None, None), (None, ""), (3, None), (3, "é" * 9), (9999, "x" * 70_000)], "doc_id bigint, text string")
    docs = docs.union(odd).union(docs.limit(9)).repartition(5)
    got = sharding.assign(docs.withColumn("shard", F.lit("clash")).withColumn("part", F.lit(0))).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(docs.collect(), 8), key=str)
    sizes = [sum(r.size for r in got if r.shard == k) for k in range(8)]
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in got)


def test_empty_and_one(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    assert sharding.assign(docs.limit(0)).count() == 0
    assert [(r.shard, r.slot) for r in sharding.assign(docs).collect()] == [(4, 0)]
