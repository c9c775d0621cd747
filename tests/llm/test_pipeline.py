import os

import public_tokenizers
from pyspark.sql import functions as F
from test_decontamination import brute as contamination
from test_near_dedup import brute as groups
from test_secrets import RULES
from tokenizers import Tokenizer

import corpus_pipeline
from tracelake.llm._shared import shared_root


def redacted(text):
    spans = sorted((m.start(), m.end()) for _, pattern, keep in RULES for m in pattern.finditer(text or "") if keep(m))
    out, at = "", 0
    for start, end in spans:
        if start >= at:
            out += text[at:start] + "[secret]"
        at = max(at, end)
    return out + text[at:] if spans else text


def test_stages_against_plain_ones(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("extra", F.lit(1))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    done = []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, sf_dir)
        if number < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"file://{tmp_path}/{number}")
        docs = spark.read.parquet(f"file://{tmp_path}/{number}")
        after = docs.collect()
        done.append((before, after))
    before, after = done[0]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {r.doc_id for r in after}
    assert all(r == before[r.doc_id] for r in after)
    assert sum(d in kept for d, q in labels.items() if q == 1) >= 0.97 * sum(q == 1 for q in labels.values())
    assert sum(d not in kept for d, q in labels.items() if q == 0) >= 0.5 * sum(q == 0 for q in labels.values()) > 0
    before, after = done[1]
    assert {r.doc_id for r in after} == {d for d, *_, kept in groups([(r.doc_id, r.text) for r in before.values()], 5, 80) if kept}
    before, after = done[2]
    assert {r.doc_id for r in after} == {d for d, r in before.items() if not contamination(r.text, items)[4]}
    before, after = done[3]
    assert {r.doc_id: (r.text, r.n_chars) for r in after} == {d: (redacted(r.text), len(redacted(r.text)) if redacted(r.text) != r.text else r.n_chars) for d, r in before.items()}
    before, after = done[4]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes = {d: len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for d, r in before.items()}
    found = {}
    for r in after:
        found[r.doc_id] = found.get(r.doc_id, 0) + r.length
    assert found == sizes
    assert len({r.sequence_id for r in after}) <= -(-sum(sizes.values()) // 4096) + 1


ODD_ROWS = [(None, "one two three four five six seven"), (None, "one two three four five six seven"), (None, "eight nine ten eleven twelve"), (7, "one two three four five six seven"), (7, "one two three four five six seven"), (8, None), (8, ""), (9, "x " * 150_000)]


def test_rows_are_judged_one_by_one(spark, sf_dir, tmp_path):
    """Null and repeated ids, null and empty texts, a long one, clashing columns: each stage has a row of its own for each."""
    docs = spark.createDataFrame(ODD_ROWS, "doc_id bigint, text string")
    for name in ("row", "kept", "findings", "key", "bucket", "number", "size"):
        docs = docs.withColumn(name, F.lit("clash"))
    items = spark.createDataFrame([(1, "one two three four five six seven")], "item_id bigint, text string")
    labels = spark.createDataFrame([(7, 1, 0), (8, 1, 0), (None, 0, 1)], "doc_id bigint, quality int, toxic int")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)
    texts = lambda df: sorted((str(r.doc_id), (r.text or "-")[:9]) for r in df.collect())
    for name in list(stage)[:-1]:
        out = stage[name](spark, docs, str(tmp_path))
        assert out.columns == docs.columns and {r.row for r in out.select("row").collect()} <= {"clash"}
        assert stage[name](spark, docs.limit(0), str(tmp_path)).count() == 0
    # One copy stays, under its least id; texts without words are no copies of each other.
    assert texts(stage["near-duplicates"](spark, docs, str(tmp_path))) == sorted([("7", "one two t"), ("None", "eight nin"), ("8", "-"), ("8", "-"), ("9", "x x x x x")])
    # A contaminated row with a null id takes no other of null id along.
    assert texts(stage["benchmark decontamination"](spark, docs, str(tmp_path))) == sorted([("None", "eight nin"), ("8", "-"), ("8", "-"), ("9", "x x x x x")])
    assert stage["secret scans"](spark, docs, str(tmp_path)).count() == len(ODD_ROWS)
    packed = stage["best-fit packing"](spark, docs, str(tmp_path))
    assert packed.where("piece = 0").count() == len(ODD_ROWS) and stage["best-fit packing"](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_a_run_leaves_only_its_stages(spark, tmp_path):
    """The folders that stages write on their way are gone when run() returns."""
    docs = spark.createDataFrame([(i, f"w{i} and some other words {i % 3}") for i in range(20)], "doc_id bigint, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "never said here")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    root = shared_root(spark).removeprefix("file://")
    before = set(os.listdir(root))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() > 0
    assert [n.split("-")[0] for n in set(os.listdir(root)) - before] == ["pipeline"]
