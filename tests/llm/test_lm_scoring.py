import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tracelake.llm import lm_scoring, tokens

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(AZ)), "</>"]


class Brute:
    """Modified Kneser-Ney from the textbook, on dictionaries."""

    def __init__(self, texts, order):
        self.order, self.values = order, [Counter() for _ in range(order + 1)]
        for t in texts:
            seq = ["<>"] * (order - 1) + words(t)
            for i in range(order - 1, len(seq)):
                self.values[order][tuple(seq[i - order + 1 : i + 1])] += 1
        for k in range(order - 1, 0, -1):
            for g, n in self.values[k + 1].items():
                self.values[k][g[1:]] += n if g[1] == "<>" else 1
        self.counts = Counter(w for t in texts for w in words(t))
        self.n, self.v = sum(self.counts.values()), len(self.counts)
        self.contexts = [defaultdict(list) for _ in range(order + 1)]
        for k in range(1, order + 1):
            for g, n in self.values[k].items():
                self.contexts[k][g[:-1]].append(n)
        self.sums = [{}] * (order + 1)
        self.cuts = [None] + [lm_scoring.discounts(*(sum(n == i for n in self.values[k].values()) for i in (1, 2, 3, 4))) for k in range(1, order + 1)]

        for k in range(1, order + 1):
            self.sums[k] = {g: (sum(own), sum(self.cuts[k][min(x, 3) - 1] for x in own)) for g, own in self.contexts[k].items()}

    def p(self, gram):
        p = 1 / (self.v + 1)
        for k in range(1, self.order + 1):
            if gram[len(gram) - k : -1] in self.sums[k]:
                total, saved = self.sums[k][gram[len(gram) - k : -1]]
                d = self.cuts[k]
                c = self.values[k][gram[len(gram) - k :]]
                p = (max(0, c - (d[min(c, 3) - 1] if c else 0)) + saved * p) / total
        return p

    def scores(self, text):
        seq = ["<>"] * (self.order - 1) + words(text)
        score = sum(math.log10(self.p(tuple(seq[i - self.order + 1 : i + 1]))) for i in range(self.order - 1, len(seq)))
        base = sum(math.log10((self.counts[w] + 0.1) / (self.n + 0.1 * (self.v + 1))) for w in words(text))
        return len(words(text)), sum(self.counts[w] > 0 for w in words(text)), self.n, base, score


@pytest.mark.parametrize(("order", "few", "id_kind"), [(1, 1024, None), (2, 1024, None), (3, 1024, None), (2, 2, None), (3, 4, "u8")])
def test_against_brute_force(spark, sf_dir, order, few, id_kind, monkeypatch):
    """Few ranges or many (dealt in two passes), short ids or long: the same scores."""
    monkeypatch.setattr(lm_scoring, "HELD", 3000)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(70)
    odd = spark.createDataFrame([(None, "null id"), (901, None), (902, ""), (903, "unseen zzz AND é"), (904, " x" * 300)], "doc_id bigint, text string")
    docs = docs.union(odd).union(docs.limit(3)).withColumn("range", F.lit("clash"))
    rows = docs.collect()
    out = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    brute = Brute([r.text for r in rows if not out(r.doc_id)], order)
    got = sorted(map(tuple, lm_scoring.scored(docs, order, 20_000, few, id_kind).drop("perplexity").collect()), key=lambda r: (str(r[0]), r[2]))
    want = sorted(((r.doc_id, out(r.doc_id), *brute.scores(r.text)) for r in rows), key=lambda r: (str(r[0]), r[2]))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)
    context = ("<>",) * (order - 1)
    assert sum(brute.p((*context, w)) for w in [*brute.counts, "never"]) == pytest.approx(1)


def test_a_text_longer_than_a_block(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d " * 50), (2, "b c a"), (3, "x y " * 9)], "doc_id bigint, text string")
    model = lm_scoring.train(docs, 3)
    want = [r.score for r in lm_scoring.score(docs, model).collect()]
    import pyarrow as pa

    old, tokens.BLOCK = tokens.BLOCK, 7
    try:
        batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([False] * 3), pa.array([r.text for r in docs.collect()])], ["doc_id", "held_out", "text"])
        (got,) = lm_scoring._score(model)(iter([batch]))
        assert got.column("score").to_pylist() == pytest.approx(want)
    finally:
        tokens.BLOCK = old


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(None, "a b")], "doc_id bigint, text string")
    (row,) = lm_scoring.scored(docs).collect()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (True, 3, 0, 0, 0, 0)
    assert lm_scoring.scored(docs.limit(0)).count() == 0
