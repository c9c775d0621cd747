import functools
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tracelake.llm import quality, tokens

PIECE = re.compile(rb"[!-/:-@\[-^`{-~]+|[^!-/:-@\[-^`{-~\x20\x09-\x0D]+")


@functools.cache
def buckets(text):
    """The buckets of a text's n-grams, one after another."""
    h = [int(tokens.hash_words(np.frombuffer(w, np.uint8))[0][0]) for w in PIECE.findall((text or "").encode())]
    pairs = [int(quality._AGAIN) if a == b else int(tokens.mix(np.array([(a * 3 + b) % 2**64], np.uint64))[0]) for a, b in zip(h, h[1:], strict=False)]
    return [x % quality.BUCKETS for x in h + pairs]


def counted(texts):
    out = np.zeros(quality.BUCKETS)
    for t in texts:
        for b in buckets(t):
            out[b] += 1
    return out


def sampled(rows, labels, noise, keep=quality.KEEP, k=None):
    """(id, text) rows that a plain importance sampler draws: their ids, by key."""
    good = {i for i in {d for d, _ in labels} if all(q == 1 for d, q in labels if d == i)}
    halves = [[t for i, t in rows if i in good and half[i] is side] for half in [noise["half"]] for side in (True, False)]
    raw = counted(t for _, t in rows)

    def weigher(target):
        ratio = [math.log((c + quality.SMOOTH) / (target.sum() * r / raw.sum() + quality.SMOOTH)) if target.sum() else 0.0 for c, r in zip(target, raw, strict=True)]
        return lambda text: sum(ratio[b] for b in buckets(text))

    targets = [counted(h) for h in halves]
    held = [weigher(other)(t) for half, other in zip(halves, reversed(targets), strict=True) if other.sum() for t in half]
    weigh = weigher(targets[0] + targets[1])
    weights = [weigh(t) for _, t in rows]
    if k is None:
        chance = lambda w, at: 1 - math.exp(-math.exp(max(-700, min(700, w - at))))
        low, high = min(held) - 60, max(held) + 60
        for _ in range(100):
            middle = (low + high) / 2
            low, high = (middle, high) if sum(chance(w, middle) for w in held) >= keep * len(held) else (low, middle)
        k = round(sum(chance(w, low) for w in weights))
    keys = sorted(((w + noise["gumbel"][i], i) for (i, _), w in zip(rows, weights, strict=True)), reverse=True)
    return [i for _, i in keys[:k]]


def noise_of(docs, seed=quality.SEED):
    rows = docs.select("doc_id", quality.gumbel(F.col("doc_id"), seed).alias("g"), (F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(2)) == 0).alias("h")).collect()
    return {"gumbel": {r.doc_id: r.g for r in rows}, "half": {r.doc_id: r.h for r in rows}}


def test_against_a_plain_sampler(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("length(text) < 1000").orderBy("doc_id").limit(60)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows, marks = [tuple(r) for r in docs.collect()], [(r.doc_id, r.quality) for r in labels.collect()]
    drawn = {}
    for seed, keep, k in ((quality.SEED, 0.9, None), (3, quality.KEEP, 20), (4, quality.KEEP, 20)):
        got = quality.resampled(docs, labels, k, keep, seed).collect()
        want = sampled(rows, marks, noise_of(docs, seed), keep, k)
        assert [r.doc_id for r in sorted(got, key=lambda r: -r.key)] == want
        drawn[seed, keep] = set(want)
    assert drawn[3, quality.KEEP] != drawn[4, quality.KEEP] and len(drawn[3, quality.KEEP]) == 20


def test_noise_is_gumbel(spark):
    g = np.array([r[0] for r in spark.range(20_000).select(quality.gumbel(F.col("id"))).collect()])
    assert abs(g.mean() - 0.5772) < 0.03 and abs(g.std() - math.pi / 6**0.5) < 0.03
    held = np.array([0.0, 1.0, 5.0, -3.0])
    at = quality.threshold_of(held, 0.7)
    assert abs(quality.passing(held, at).mean() - 0.7) < 1e-9
    assert abs(np.mean([(h + g >= at).mean() for h in held]) - 0.7) < 0.01


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    fit = labels.where("doc_id % 2 = 0")
    kept = {r.doc_id for r in quality.resampled(docs, fit).collect()}
    test = labels.where("doc_id % 2 = 1").collect()
    good, bad = [r.doc_id for r in test if r.quality == 1], [r.doc_id for r in test if r.quality == 0]
    assert sum(d in kept for d in good) >= 0.99 * len(good)
    assert sum(d not in kept for d in bad) >= 0.95 * len(bad)
    whole = quality.keep_good(docs.withColumn("key", F.lit(1)), fit)
    assert {r.doc_id for r in whole.select("doc_id").collect()} == kept and whole.columns == [*docs.columns, "key"]


def test_few_labels_keep_good_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    kept = {r.doc_id for r in quality.resampled(docs, labels.where("doc_id % 2 = 0")).collect()}
    test = labels.where("doc_id % 2 = 1").collect()
    good, bad = [r.doc_id for r in test if r.quality == 1], [r.doc_id for r in test if r.quality == 0]
    assert sum(d in kept for d in good) >= 0.97 * len(good)
    assert sum(d not in kept for d in bad) >= 0.8 * len(bad)


def test_blocks_do_not_matter(monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab !.$\né_") for _ in range(rng.randint(0, 60))) for _ in range(50)] + ["Te Te Te te", "", None, "x" * 500 + " $$$ y"]
    for block in (5, 64, tokens.BLOCK):
        monkeypatch.setattr(tokens, "BLOCK", block)
        found = [[] for _ in texts]
        for own, owner in quality.grams(pa.array(texts, pa.string())):
            for b, i in zip(own.tolist(), owner.tolist(), strict=True):
                found[i].append(b)
        assert [sorted(f) for f in found] == [sorted(buckets(t and re.sub("[A-Z]", lambda m: m[0].lower(), t))) for t in texts]


def test_the_cut_is_exact(spark):
    rng = random.Random(3)
    values = [rng.choice([rng.randrange(2**62), rng.randrange(2**16), 77, 2**62 - 1]) for _ in range(500)]
    keys = spark.createDataFrame([(v,) for v in values], "_tl_fixed bigint")
    for k in (1, 2, 250, 499, 500):
        assert quality.cut_of(keys, k) == sorted(values, reverse=True)[k - 1]
    assert quality.cut_of(keys, 501) == 0


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "x"), (2, None), (3, ""), (4, "y " * 700_000)], "doc_id bigint, text string")
    docs = docs.withColumn("bucket", F.lit("clash")).withColumn("log_weight", F.lit(None).cast("string"))
    none = spark.createDataFrame([(None, 1), (9, None)], "doc_id bigint, quality int")
    assert quality.resampled(docs, none).count() == 6 == quality.keep_good(docs, none).count()
    assert quality.resampled(docs.limit(0), none).count() == 0 == quality.keep_good(docs.limit(0), none).count()
    some = spark.createDataFrame([(1, 1), (3, 1), (3, 0), (2, 1)], "doc_id bigint, quality int")
    out = quality.keep_good(docs, some)
    assert out.columns == docs.columns and {r.doc_id for r in out.select("doc_id").collect()} <= {None, 1, 2, 3, 4}
    assert quality.keep_good(docs, some, k=0).count() == 0
    # A drawn row with a null id doesn't take others of null id along: rows are judged by their own keys.
    two = spark.createDataFrame([(None, "a a a a $$$ $$$ $$$"), (None, "b c d e f"), (1, "b c d e"), (2, "b c e d")], "doc_id bigint, text string")
    assert quality.keep_good(two, some, k=3).count() == 3
