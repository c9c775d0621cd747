import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracelake.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def whole(got, length):
    """Every sequence is filled without gaps, up to its length."""
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert 0 < at <= length
    return len(by)


def test_pieces_are_those_of_the_tokenizer(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(60)
    odd = ["", None, "  ", "it's  we'll x y źé É ſ <|endoftext|>x ΑΣ ΑΣ. 12 3٣ \x1c a\x0bb", "x" * 9000, "word " * 9000]
    docs = docs.union(spark.createDataFrame([(i - 50, t) for i, t in enumerate(odd)], "doc_id bigint, text string"))
    docs = docs.union(docs.limit(5)).withColumn("length", F.lit("clash")).withColumn("block", F.lit(0))
    got = packing.packed(docs, PATH).collect()
    tokenizer, want = Tokenizer.from_file(PATH), []
    for r in docs.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            own = np.array(ids[at : at + 4096], "<u4")
            want.append((r.doc_id, k, at, len(own), zlib.crc32(own.tobytes())))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    n = whole(got, 4096)
    assert n <= -(-sum(w[3] for w in want) // 4096) + 1


def test_blocks_meet_again(spark):
    docs = spark.createDataFrame([(i, "a " * (1 + i * 37 % 900)) for i in range(400)], "doc_id bigint, text string")
    got = packing.packed(docs, PATH, length=1000, block=60).collect()
    assert len(got) == 400
    assert whole(got, 1000) <= 1.03 * sum(r.length for r in got) / 1000 + 1


def test_operators_keep_every_item_once():
    rng = random.Random(5)
    sizes = [rng.randint(1, 700) for _ in range(300)]
    order = list(range(300))
    one, other = packing.pack(sizes, order, 1000), packing.pack(sizes, order[::-1], 1000)
    for bins in (one, other, packing.crossover(one, other, sizes, 1000, rng), packing.mutate(one, sizes, 1000, rng), packing.evolve(sizes, 1000, 3, [one])[0]):
        assert sorted(i for b in bins for i in b) == order
        assert all(sum(sizes[i] for i in b) <= 1000 for b in bins)
    assert len(packing.evolve(sizes, 1000, 3, [one])[0]) <= len(one)
    # Halves that only fit in pairs: the optimum is known.
    pairs = [k for k in range(300, 500) for _ in (0, 1)] + [1000 - k for k in range(300, 500) for _ in (0, 1)]
    assert len(packing.evolve(pairs, 1000, 1)[0]) == 400


def triples(n, seed, capacity=1000):
    """Items that fill n sequences exactly, three to each."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        a, b = rng.randint(250, 450), rng.randint(200, 330)
        out += [a, b, capacity - a - b]
    rng.shuffle(out)
    return out


def best_fit_decreasing(sizes, capacity=1000):
    return packing.pack(sizes, sorted(range(len(sizes)), key=lambda i: -sizes[i]), capacity)


def test_crossover_finds_what_best_fit_misses():
    better = 0
    for seed in range(12):
        sizes = triples(20, seed)
        plain = len(best_fit_decreasing(sizes))
        first = len(packing.evolve(sizes, 1000, 1, generations=0)[0])
        bred, generations = packing.evolve(sizes, 1000, 1, generations=400)
        assert len(bred) <= first and len(bred) <= plain
        better += len(bred) < min(first, plain) and generations > 0
    assert better >= 3  # no member of the first population had that few, nor had best fit decreasing


def test_islands_breed_in_epochs(spark, tmp_path):
    """Blocks that no first population solves: elites move on, and each block keeps its best island."""
    rows = [(b, 1000 * b + i, s) for b in range(3) for i, s in enumerate(triples(20, b))]
    got = packing.evolved(spark.createDataFrame(rows, "block long, number long, size long"), f"file://{tmp_path}/w", 1000).collect()
    assert sorted((r.block, r.number, r["size"]) for r in got) == rows
    for b in range(3):
        bins = {}
        for r in got:
            if r.block == b:
                bins[r.bin] = bins.get(r.bin, 0) + r["size"]
        assert max(bins.values()) <= 1000 and len(bins) <= len(best_fit_decreasing(triples(20, b)))
    assert max(r.generations for r in got) > 0


def test_as_few_as_best_fit_decreasing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    for length, block in ((4096, 4000), (1000, 100)):
        got = packing.packed(docs, PATH, length=length, block=block).collect()
        plain = len(best_fit_decreasing([r.length for r in got], length))  # over all pieces at once
        assert whole(got, length) <= (plain if block == 4000 else 1.01 * plain)


def test_empty(spark):
    assert packing.packed(spark.createDataFrame([], "doc_id bigint, text string"), PATH).count() == 0
