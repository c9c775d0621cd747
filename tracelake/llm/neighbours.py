"""Approximate nearest neighbours by cosine: multiprobe p-stable hashing with exact reranking.

Unit vectors are projected on `hashes` normal directions a table and cut into steps of `width`: the p-stable hash. A
query's neighbour at the cosine that a bounded sample shows (the lower quartile of k-th neighbours within it) has
normally distributed projections around the query's own, which gives each bucket an estimated chance to hold it. Buckets
are visited in that order until their chances add up to `target`: the threshold that does so is found by drawing
neighbours from the estimate. What any table's visited buckets hold is merged and reranked by exact cosines in double
precision.

A query is settled where k of its own found neighbours are at least as near as that expected cosine. All others (buckets
that hold too few, neighbours farther than expected) are compared with every vector, exactly.

Buckets lie in cells (the first few hash values; as many as the number of vectors asks for). A cell is one or more
bounded chunks of vectors, and each chunk meets the queries that visit its cell in bounded blocks; no pair of query and
candidate is ever a row. Equal vectors are one candidate that stands for its k + 1 least ids, which is exact: of equal
vectors only the least ids can be among the nearest.

Defined results: null vectors, zero vectors and those with null or non-finite components take no part, nor do rows with
a null id; vectors of different lengths are never neighbours; a repeated row counts once, and rows with the query's id
are never its neighbours; a query with several vectors gets the neighbours of each, ranked as one list; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import bounded_broadcast, work_dir, written

TABLES, HASHES, WIDTH, TARGET = 2, 12, 1.5, 0.8
#: Rows of the sample that sets the expected cosine.
SAMPLE = 4000
#: Vectors of a chunk, queries of a block, vectors that a cell should hold.
CHUNK, QUERIES, CELL = 8192, 4096, 20_000
#: Hash values lie within this many steps of 0; a unit vector's projection beyond has no measurable chance.
REACH = 8


@dataclass(frozen=True)
class Plan:
    tables: int
    hashes: int
    width: float
    target: float
    cosine: float
    lead: int  # hash values that name a cell
    k: int

    def directions(self, table: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng([table, dim, 20240501])
        return rng.normal(size=(dim, self.hashes)), rng.uniform(0, self.width, self.hashes)

    def codes(self, unit: np.ndarray, table: int) -> np.ndarray:
        a, b = self.directions(table, unit.shape[1])
        return np.clip(np.floor((unit @ a + b) / self.width), -REACH, REACH).astype(np.int64) + REACH

    def cells(self, codes: np.ndarray) -> np.ndarray:
        cell = np.zeros(len(codes), np.int64)
        for i in range(self.lead):
            cell = cell * (2 * REACH + 1) + codes[:, i]
        return cell

    def chances(self, unit: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """Log chances (queries x hashes x steps) that a neighbour's hash has each value, and each query's threshold."""
        a, b = self.directions(table, unit.shape[1])
        centre, spread = self.cosine * (unit @ a) + b, np.sqrt(1 - self.cosine**2)
        edges = np.arange(-REACH, REACH + 2) * self.width
        edges[0], edges[-1] = -1e9, 1e9
        below = _normal((edges - centre[:, :, None]) / spread)
        logs = np.log(np.maximum(np.diff(below, axis=2), 1e-12))
        draws = np.random.default_rng(7).normal(size=(400, self.hashes))
        limits = np.empty(len(unit))
        for i in range(len(unit)):
            near = np.clip(np.floor((centre[i] + spread * draws) / self.width), -REACH, REACH).astype(np.int64) + REACH
            limits[i] = np.quantile(logs[i][np.arange(self.hashes), near].sum(1), 1 - self.target)
        return logs, limits


def _normal(x: np.ndarray) -> np.ndarray:
    """The normal distribution function, to 1e-7 (a rational approximation of erf)."""
    z = np.abs(x) / np.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    erf = 1 - t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-np.minimum(z * z, 700))
    return np.where(x < 0, (1 - erf) / 2, (1 + erf) / 2)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims):
        own = batch.filter(pa.array(dims == dim))
        v = _matrix(own.column("v"))
        yield int(dim), own, v / _norms(v)[:, None]


def _norms(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v * v).sum(1))


def _index(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, own, unit in _by_length(batch):
                for table in range(plan.tables):
                    cell = plan.cells(plan.codes(unit, table))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), table, np.int64)), pa.array(cell), *(own.column(c) for c in ("dim", "h1", "h2", "v", "ids"))], ["tab", "cell", "dim", "h1", "h2", "v", "ids"])

    return run


def _probe(plan: Plan):
    steps = 2 * REACH + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, own, unit in _by_length(batch):
                for table in range(plan.tables):
                    logs, limits = plan.chances(unit, table)
                    rest = logs[:, plan.lead :].max(axis=2).sum(1)
                    which, cells = [], []
                    for i in range(len(own)):
                        # Cells whose best bucket could still be visited.
                        found = [(0.0, 0)]
                        ahead = np.concatenate((np.cumsum(logs[i, : plan.lead].max(axis=1)[::-1])[::-1], [0.0]))
                        for d in range(plan.lead):
                            found = [(s + x, c * steps + j) for (s, c), (j, x) in itertools.product(found, enumerate(logs[i, d])) if s + x + ahead[d + 1] + rest[i] >= limits[i]]
                        which += [i] * len(found)
                        cells += [c for _, c in found]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(which), table, np.int64)), pa.array(cells, pa.int64()), *(own.column(c).take(pa.array(which, pa.int64())) for c in ("dim", "h1", "h2", "v"))], ["tab", "cell", "dim", "h1", "h2", "v"])

    return run


def _meet(plan: Plan, every: bool = False):
    """One chunk of vectors and one block of queries: each query's best ids of the buckets that it visits, or of all."""

    def run(key: tuple, index: pa.Table, queries: pa.Table) -> pa.Table:
        out: dict[str, list] = {"h1": [], "h2": [], "vec_id": [], "score": []}
        if len(index) and len(queries):
            v, q = _matrix(index.column("v")), _matrix(queries.column("v"))
            v_size, q_size = _norms(v), _norms(q)
            if not every:
                table = key[0].as_py()
                codes = plan.codes(v / v_size[:, None], table)
                buckets, member, sizes = np.unique(codes, axis=0, return_inverse=True, return_counts=True)
                members, begin = np.argsort(member.reshape(-1), kind="stable"), np.cumsum(sizes) - sizes
                logs, limits = plan.chances(q / q_size[:, None], table)
            ids = index.column("ids").to_pylist()
            h1, h2 = queries.column("h1").to_pylist(), queries.column("h2").to_pylist()
            take = plan.k + 1
            for i in range(len(q)):
                if every:
                    near = np.arange(len(v))
                else:
                    # The probe sequence: this chunk's buckets by estimated success, until all that are left lie beyond the target.
                    success = logs[i][np.arange(plan.hashes), buckets].sum(1)
                    sequence = np.argsort(-success, kind="stable")
                    sequence = sequence[: np.searchsorted(-success[sequence], -limits[i], "right")]
                    n = sizes[sequence]
                    near = members[np.repeat(begin[sequence] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                if not len(near):
                    continue
                rough = (v[near] @ q[i]) / (v_size[near] * q_size[i])
                if len(near) > take + 10:
                    cut = np.partition(rough, -take - 10)[-take - 10]
                    near = near[rough >= cut - 1e-12]
                exact = (v[near] * q[i]).sum(1) / (v_size[near] * q_size[i])
                best = sorted((-s, x) for s, j in zip(exact.tolist(), near.tolist(), strict=True) for x in ids[j])[:take]
                out["h1"] += [h1[i]] * len(best)
                out["h2"] += [h2[i]] * len(best)
                out["vec_id"] += [x for _, x in best]
                out["score"] += [-s for s, _ in best]
        return pa.table({"h1": pa.array(out["h1"], pa.int64()), "h2": pa.array(out["h2"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    return run


def expected_cosine(sample: np.ndarray, k: int) -> float:
    """The lower quartile of the k-th nearest cosine of up to 200 vectors among the sample."""
    if len(sample) < 2:
        return 0.5
    unit = sample / _norms(sample)[:, None]
    found = unit[:200] @ unit.T
    found.sort(axis=1)
    return float(np.clip(np.quantile(found[:, max(0, found.shape[1] - 1 - k)], 0.25), 0.05, 0.99))


def usable(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found of each row of queries among the rows of vectors (both: vec_id, embedding)."""
    spark = vectors.sparkSession
    at = work_dir(spark, "neighbours")
    v = F.col("embedding")

    def named(df: DataFrame) -> DataFrame:
        good = df.select(F.col("vec_id").cast("long").alias("vec_id"), v).where(F.col("vec_id").isNotNull() & F.coalesce(usable(v), F.lit(False)))
        return good.select("vec_id", F.size(v).cast("long").alias("dim"), F.xxhash64(v).alias("h1"), F.xxhash64(F.lit(1), v).alias("h2"), v.alias("v"))

    # Equal vectors: the k + 1 least ids of each.
    first = Window.partitionBy("h1", "h2", "dim").orderBy("vec_id")
    ranked = named(vectors).dropDuplicates(["vec_id", "h1", "h2", "dim"]).withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    classes = written(ranked.groupBy("h1", "h2", "dim").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("vec_id")).alias("ids")), f"{at}/classes")
    asked = written(named(queries).dropDuplicates(["vec_id", "h1", "h2", "dim"]), f"{at}/queries")

    # A bounded sample: the least hashes, whatever the order of rows. Of the commonest length.
    total = classes.count()
    taken = classes.orderBy("h1", "h2").limit(SAMPLE).select("dim", "v").collect()
    dims = [r.dim for r in taken]
    common = max(set(dims), key=lambda d: (dims.count(d), d)) if dims else 0
    cosine = expected_cosine(np.array([r.v for r in taken if r.dim == common], float), k) if dims else 0.5
    lead = int(np.clip(np.ceil(np.log(max(total, 1) / CELL) / np.log(4)), 1, hashes))
    plan = Plan(tables, hashes, width, target, cosine, lead, k)

    kind = classes.schema["v"].dataType.simpleString()
    index = written(classes.mapInArrow(_index(plan), f"tab long, cell long, dim long, h1 long, h2 long, v {kind}, ids array<long>"), f"{at}/index")
    distinct = asked.dropDuplicates(["h1", "h2", "dim"]).select("dim", "h1", "h2", "v")
    kind = asked.schema["v"].dataType.simpleString()
    probes = written(distinct.mapInArrow(_probe(plan), f"tab long, cell long, dim long, h1 long, h2 long, v {kind}"), f"{at}/probes")

    def met(left: DataFrame, right: DataFrame, place: list[str], run, name: str) -> DataFrame:
        """k + 1 candidates for each distinct query vector, from chunks of left and blocks of right that share a place."""
        sizes = left.groupBy(*place).count().join(right.groupBy(*place).agg(F.count("*").alias("asked")), place)
        sizes = written(sizes.select(*place, F.ceil(F.col("count") / CHUNK).alias("chunks"), F.ceil(F.col("asked") / QUERIES).alias("blocks")), f"{at}/{name}_sizes")
        known = bounded_broadcast(sizes)
        count = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        left = left.join(known, place).withColumn("chunk", F.pmod("h2", "chunks")).withColumn("block", count("blocks")).select(*place, "chunk", "block", "v", "ids")
        right = right.join(known, place).withColumn("block", F.pmod("h2", "blocks")).withColumn("chunk", count("chunks")).select(*place, "chunk", "block", "h1", "h2", "v")
        keys = [*place, "chunk", "block"]
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "h1 long, h2 long, vec_id long, score double")
        merged = found.groupBy("h1", "h2", "vec_id").agg(F.max("score").alias("score"))
        nearest = Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "vec_id")
        return written(merged.withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= k + 1).drop("n"), f"{at}/{name}")

    best = met(index, probes, ["tab", "cell", "dim"], _meet(plan), "probed")

    # Without k neighbours at the expected cosine, the buckets were too few for a query: all vectors answer.
    vector = ["h1", "h2"]
    near = asked.select(F.col("vec_id").alias("query_id"), *vector).join(best.where(F.col("score") >= cosine), vector).where(F.col("query_id") != F.col("vec_id"))
    settled = near.groupBy("query_id", *vector).count().where(F.col("count") >= k).select(F.col("query_id").alias("vec_id"), *vector)
    open_ = written(asked.join(settled, ["vec_id", *vector], "left_anti").dropDuplicates([*vector, "dim"]).select("dim", *vector, "v"), f"{at}/open")
    best = best.join(open_.select(*vector), vector, "left_anti").unionByName(met(classes, open_, ["dim"], _meet(plan, every=True), "scanned"))

    # Each query's own id goes.
    mine = asked.select(F.col("vec_id").alias("query_id"), "h1", "h2").join(best, ["h1", "h2"]).where(F.col("query_id") != F.col("vec_id"))
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    each = mine.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return each.withColumn("rank", F.row_number().over(own).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
