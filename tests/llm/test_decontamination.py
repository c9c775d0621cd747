import hashlib
import re

from pyspark.sql import functions as F

from tracelake.llm import decontamination

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(AZ))


def brute(text, items, width=13):
    own, hit, found = words(text), set(), set()
    for item, body in items:
        w = words(body)
        for i in range(max(len(w) - width + 1, 1 if w else 0)):
            gram = w[i : i + width]
            for at in range(len(own) - len(gram) + 1):
                if own[at : at + len(gram)] == gram:
                    hit |= set(range(at, at + len(gram)))
                    found |= {str(item)} if item is not None else set()
    return len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(own)


def check(spark, docs, items):
    got = sorted(map(tuple, decontamination.digest(docs, items).collect()), key=str)
    pairs = [(r.item_id, r.text) for r in items.collect()]
    cache = {}
    want = []
    for r in docs.collect():
        if r.text not in cache:
            cache[r.text] = brute(r.text, pairs)
        want.append((r.doc_id, *cache[r.text]))
    assert got == sorted(want, key=str)
    return want


def test_sf(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(120)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert any(x[2] for x in check(spark, docs, items))


def test_odd_cases(spark):
    body = " ".join(f"w{i}" for i in range(20))
    items = spark.createDataFrame([(1, body), (2, "Short ITEM"), (3, None), (4, "..."), (5, "É x"), (6, body), (None, "Short item"), (7, "a a a a a a a a a a a a a a")], "item_id bigint, text string")
    rows = [
        (1, body), (1, body), (2, None), (3, ""), (4, "short, item!"), (5, "x short item short item"), (6, "é x"), (7, "É X"), (None, body.upper()),
        (8, "pre " + " ".join(f"w{i}" for i in range(5, 18)) + " post"), (9, " ".join(f"w{i}" for i in range(12))), (10, "a " * 40), (11, "w0 " * 30_000 + body), (12, "..short item.."),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("row", F.lit("x")).withColumn("word", F.lit(1))
    check(spark, docs, items)
    kept = decontamination.drop_contaminated(docs, items)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [2, 3, 6, 9, 11] and kept.columns == docs.columns


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id bigint, text string")
    items = spark.createDataFrame([], "item_id bigint, text string")
    check(spark, docs, items)
    check(spark, docs.limit(0), items)


def test_marked_slots_let_through_no_other_words(spark, monkeypatch):
    """Words of one slot: the table of marks passes them all, the join only the benchmark's own."""
    monkeypatch.setattr(decontamination, "INLINE_WORDS", 1)
    monkeypatch.setattr(decontamination, "SLOTS", 2)
    items = spark.createDataFrame([(1, "a b c"), (2, " ".join(f"w{i}" for i in range(30))), (3, None)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "x a b c y"), (2, "a b d"), (3, " ".join(f"w{i}" for i in range(5, 25))), (None, "q r s t u v")], "doc_id bigint, text string")
    check(spark, docs, items)


def test_wide_vocabulary_takes_the_joined_way(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(decontamination, "INLINE_WORDS", 3)
    check(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").limit(20), spark.read.parquet(f"{sf_dir}/benchmark.parquet").limit(10))
