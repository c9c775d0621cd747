import os
import random
import re
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.llm import near_dedup

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(AZ))
    return frozenset(tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1 if w else 0)))


def brute(rows, k, percent):
    sets = {}
    for doc, text in rows:
        sets.setdefault(shingles(text, k), []).append(doc)
    keys = [s for s in sets if s]
    up = {s: s for s in keys}

    def find(s):
        while up[s] is not s:
            s = up[s]
        return s

    by = {}
    for s in keys:
        for x in s:
            by.setdefault(x, []).append(s)
    for s in keys:
        for t in {t for x in s for t in by[x]}:
            both = len(s & t)
            if 100 * both >= percent * (len(s) + len(t) - both):
                up[find(s)] = find(t)
    least = {}
    for s in keys:
        ids = [d for d in sets[s] if d is not None]
        least[find(s)] = min([*ids, *([least[find(s)]] if least.get(find(s)) is not None else [])], default=None)
    out = []
    for doc, text in rows:
        s = shingles(text, k)
        c = least[find(s)] if s else doc
        out.append((doc, len(s), c, doc is not None and doc == c))
    return out


def check(docs, k, percent):
    got = sorted(map(tuple, near_dedup.group(docs, k, percent).collect()), key=str)
    want = sorted(brute([(r.doc_id, r.text) for r in docs.collect()], k, percent), key=str)
    assert got == want
    return got


def test_sf_and_odd_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = [(None, "null id text one two three"), (5000, "null id text one two three"), (5001, None), (5002, ""), (5003, "one"), (5004, "ONE"), (5005, "one two"), (5006, "w " * 40_000), (5007, None), (5001, None), (5008, "a b c d e"), (5008, "x y z u v w")]
    docs = docs.union(spark.createDataFrame(odd, "doc_id bigint, text string")).withColumn("node", F.lit("clash")).withColumn("bands", F.lit(1))
    got = check(docs, 3, 85)
    assert sum(not kept for *_, kept in got) > 10
    kept = near_dedup.deduplicated(docs, 3, 85)
    assert kept.columns == docs.columns


@pytest.mark.parametrize("block", [2048, 8])
def test_edited_copies_lose_no_link(spark, monkeypatch, block):
    # Chains and crowds around the threshold: many pairs of a group are linked only through others.
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(1)
    rows, doc = [], 0
    for _ in range(6):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
        for _ in range(25):
            own = list(base)
            for _ in range(rng.randint(0, 5)):
                own[rng.randrange(len(own))] = f"x{rng.randint(0, 10**6)}"
            if rng.random() < 0.3:
                base = own
            rows.append((doc, " ".join(own)))
            doc += 1
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = check(docs, 3, 85)
    assert len({c for _, _, c, _ in got}) > 6


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(60):
        pool = rng.integers(0, 2**63, 400, dtype=np.uint64)
        a, b = np.unique(pool[:300]), np.unique(pool[100:])
        s = near_dedup.super_minhash(np.concatenate([a, b]), np.array([len(a), len(b)]), 128)
        errors.append((s[0] == s[1]).mean() - 0.5)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05
    one = near_dedup.super_minhash(np.arange(1, 200_001, dtype=np.uint64), np.array([200_000]), 64)
    assert np.isfinite(one.view(float)).all()


KEEPS = """
import re, sys
import pyarrow as pa
from tracelake.llm import near_dedup
def own():
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024
texts = [" ".join(f"w{i * 7919 % 100_003 + k}" for k in range(300)) for i in range(8000)]
batch = lambda: pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
before = own()
for run in (near_dedup._signatures(5, 128, 4), near_dedup._sets(5)):
    for _ in run(batch() for _ in range(2)):
        pass
print(own() - before)
"""


def test_workers_keep_little_when_a_task_has_ended():
    """Freed memory that allocators keep would count for the executor, whatever its workers do next (91 MB before, 9 now)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(near_dedup.__file__)))
    done = subprocess.run([sys.executable, "-c", KEEPS], cwd=os.path.dirname(root), capture_output=True, text=True, check=True, timeout=120)
    assert float(done.stdout) < 60


def test_empty(spark):
    assert near_dedup.group(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
