import hashlib

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracelake.llm import chat_format

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def test_against_the_rows(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = [(5000, None, "assistant", "x"), (5000, 0, None, None), (5001, 1, "a:b\n### </turn>", "\\"), (5001, 1, "assistant", "\n</turn>\n### user:\n"), (5001, 1, "assistant", "\n</turn>\n### user:\n"), (None, 0, "user", "😀"), (None, 1, "assistant", "é" * 70_000), (5002, 0, "assistant", "\n")]
    rows = chat_format.with_control_strings(rows.union(spark.createDataFrame(odd, rows.schema))).withColumn("scored", F.lit("clash"))
    by = {}
    for r in rows.collect():
        by.setdefault(r.conv_id, []).append(((r.turn is not None, r.turn or 0), (r.role is not None, r.role or ""), (r.text is not None, r.text or "")))
    got = {r.conv_id: r for r in chat_format.digest(rows).collect()}
    assert got.keys() == by.keys() and -7 in got
    for conv, own in by.items():
        own = [(r or "", t or "") for _, (_, r), (_, t) in sorted(own)]
        loss = "".join(t for r, t in own if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), sha("".join(f"{a}\n{b}\n" for a, b in own)), len(loss), sha(loss))
        assert r.formatted_chars >= sum(len(a) + len(b) for a, b in own)


def test_a_hot_conversation_is_spread(spark):
    """One conversation holds nearly all rows: formatting has it in many partitions, in order, and the digest is the same."""
    rows = spark.range(4000).selectExpr("if(id % 100 = 0, id, -1) AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('text ', id) AS text")
    made = chat_format.formatted(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else small partitions are read as one
    try:
        assert made.where("conv_id = -1").selectExpr("spark_partition_id() AS p").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    hot = [r.formatted for r in made.where("conv_id = -1").orderBy("place").collect()]
    want = [("user" if i % 2 == 0 else "assistant", f"text {i}") for i in range(4000) if i % 100]
    assert chat_format.parse("".join(hot)) == want
    (row,) = chat_format.digest(rows).where("conv_id = -1").collect()
    assert row.turns_sha256 == sha("".join(f"{a}\n{b}\n" for a, b in want)) and row.formatted_chars == sum(map(len, hot))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(st.sampled_from("\\#:\n</turn> é"), max_size=12), st.text(st.sampled_from("\\#:\n</turn> é😀"), max_size=30)), min_size=1, max_size=6))
def test_exact_round_trip(turns):
    out, at, size = chat_format.assemble(pa.array([r for r, _ in turns]), pa.array([t for _, t in turns]))
    segments = out.to_pylist()
    assert chat_format.parse("".join(segments)) == turns
    assert [chat_format.unescaped(s.encode()[a : a + n].decode()) for s, a, n in zip(segments, at, size, strict=True)] == [t for _, t in turns]


def test_empty(spark):
    assert chat_format.digest(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0
