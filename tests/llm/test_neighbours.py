import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.llm import neighbours


def brute(rows, every, k=5):
    ids = [r[0] for r in rows]
    v = np.array([r[1] for r in rows], float)
    size = np.sqrt((v * v).sum(1))
    out = {}
    for i, q in enumerate(ids):
        if q % every == 0:
            s = (v * v[i]).sum(1) / (size * size[i])
            out[q] = sorted((-x, d) for x, d in zip(s.tolist(), ids, strict=True) if d != q)[:k]
    return out


def test_recall_on_all_vectors(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    rows = rows.withColumn("rank", F.lit("clash")).withColumn("cell", F.lit(1))
    got = neighbours.search(rows, rows.where("vec_id % 5 = 0")).collect()
    want = brute([(r.vec_id, r.embedding) for r in rows.collect()], 5)
    by = {}
    for r in sorted(got, key=lambda r: r.rank):
        by.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    hits = sum(len({d for _, d in by.get(q, [])} & {d for _, d in near}) for q, near in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))
    for own in by.values():
        assert own == sorted(own) and len(own) <= 5


def test_odd_rows_and_equal_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CHUNK", 5)
    monkeypatch.setattr(neighbours, "QUERIES", 3)
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 2.0, 0.5]) for i in range(40)] + [(i, rng.normal(size=3).tolist()) for i in range(40, 80)]
    rows += [(100, [2.0, 4.0, 1.0])]
    good = list(rows)
    bad = [(150, None), (200, [0.0, 0.0, 0.0]), (250, [float("nan"), 1.0, 1.0]), (300, [float("inf"), 1.0, 1.0]), (350, [None, 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (400, []), (450, [1.0, 1.0])]
    df = spark.createDataFrame(rows + rows[:3] + bad, "vec_id bigint, embedding array<float>")
    got = neighbours.search(df, df.where("vec_id % 50 = 0"), target=0.9999).collect()
    want = brute([(i, np.float32(v)) for i, v in good], 50)
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert by.keys() == want.keys()
    for q, near in want.items():
        assert [(r, d) for r, d, _ in by[q]] == [(n + 1, d) for n, (_, d) in enumerate(near)]
        assert [s for *_, s in by[q]] == pytest.approx([-s for s, _ in near], rel=1e-14)


def test_empty_and_alone(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0])], "vec_id bigint, embedding array<float>")
    assert neighbours.search(df, df).count() == 0
    assert neighbours.search(df.limit(0), df.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["small", "clustered"])
def test_far_neighbours_are_found(spark, kind):
    """Production parameters: few vectors, and vectors far from all others beside tight clusters that set the expected cosine."""
    rng = np.random.default_rng(5)
    if kind == "small":
        rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(8, 64)))]
    else:
        near = np.repeat(rng.normal(size=(60, 64)), 20, axis=0) + 0.1 * rng.normal(size=(1200, 64))
        rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate((rng.normal(size=(40, 64)), near)))]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    by = {}
    for r in sorted(neighbours.search(df, df.where("vec_id < 40")).collect(), key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append(r.vec_id)
    assert by == {q: [d for _, d in near] for q, near in brute(rows, 1).items() if q < 40}
    few = df.where("vec_id < 3")
    assert neighbours.search(few, few).count() == 6
