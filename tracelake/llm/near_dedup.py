"""Near-duplicates by SuperMinHash signatures, banding, exact verification and union-find grouping.

1. One pass over the texts: each document's set of word shingles gives a digest of the set and, by SuperMinHash, a
   signature. Equal sets (copies) meet in one row for each digest before anything else is shuffled.
2. Signatures are cut into bands; digests that share a band value are candidates. A bucket of n members gives n - 1
   pairs with its first member, never all pairs.
3. Candidates' sets are made again from one document each and compared in full. Linked digests are grouped by
   union-find within tasks and star contractions between them.
4. A bucket whose members are still in several groups may hide links that no first member saw: its members are compared
   across groups, set by set, in blocks of bounded size, until no pair of different groups is left unseen.

The digest is 128 bits of the sorted 64-bit shingle hashes, which are 64 bits of the words; sets are compared by those.

Defined results: null texts and texts without words have empty sets and link with nothing (each is its own group);
repeated rows and equal ids follow their sets: every row of an id gets the least id that its set reaches; a null id is
never a group's least id unless the group has no other; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from ._shared import bounded_broadcast, gives_back, keyed, work_dir, written

WORDS = 5
PERCENT = 80
HASHES = 128
#: Rows of a band: a pair at 0.8 shares none of 32 bands of 4 with a chance of 5e-8, at 0.85 of 6e-11.
ROWS = 4
#: Most digests compared in one task.
BLOCK = 2048
_U = np.uint64
_STEP = 0x9E3779B97F4A7C15


def shingle_sets(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted within the text, and how many each text has.

    A text with fewer than k words has one shingle, all of its words."""
    docs = np.repeat(np.arange(len(counts)), counts)
    ends = np.cumsum(counts)
    n = len(hashes)
    mixed = tokens.mix(hashes)
    out = mixed.copy()
    with np.errstate(over="ignore"):
        for step in range(1, min(k, n)):
            out[: n - step] = tokens.mix(out[: n - step] * _U(3) + mixed[step:] + _U(step))
    whole = np.arange(n) + k <= ends[docs] if n else np.zeros(0, bool)
    found, owner = out[whole], docs[whole]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        starts = ends - counts
        for i, d in enumerate(short):
            x = np.zeros(1, np.uint64)  # arrays of one: they wrap around without a warning
            for h in mixed[starts[d] : ends[d]]:
                x = tokens.mix(x * _U(5) + h + _U(11))
            extra[i] = x[0]
        found, owner = np.concatenate([found, extra]), np.concatenate([owner, short])
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    if len(found):
        new = np.concatenate(([True], (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])))
        found, owner = found[new], owner[new]
    return found, np.bincount(owner, minlength=len(counts)).astype(np.int64)


def super_minhash(items: np.ndarray, sizes: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash signatures (texts x m, bits of doubles as uint64) of sets laid end to end.

    Each element walks through its own random permutation of the m places, one step for each level: at level j it offers
    j + r to one place. Places take the least offer, so once a set has filled all of its places with levels up to j, no
    later level can matter and the set's elements stop."""
    out = np.full((len(sizes), m), np.inf)
    starts = np.cumsum(sizes) - sizes
    first = 0
    while first < len(sizes):
        # Runs of whole sets of about 64k elements; a longer set goes piece by piece, as minima can be taken piecewise.
        stop = first + 1
        while stop < len(sizes) and starts[stop] + sizes[stop] - starts[first] <= 65_536:
            stop += 1
        begin, end = int(starts[first]), int(starts[stop - 1] + sizes[stop - 1])
        for at in range(begin, end, 65_536):
            part = items[at : min(end, at + 65_536)]
            owner = np.repeat(np.arange(first, stop), sizes[first:stop])[at - begin : at - begin + len(part)]
            _fill(out, part, owner, m)
        first = stop
    return out.view(np.uint64)


def _fill(out: np.ndarray, items: np.ndarray, owner: np.ndarray, m: int) -> None:
    places = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(items), 1))
    rows = np.arange(len(items))
    flat = out.reshape(-1)
    base = owner * m
    for j in range(m):
        with np.errstate(over="ignore"):
            x = tokens.mix(items + _U((2 * j + 1) * _STEP & (1 << 64) - 1))
            y = tokens.mix(x + _U(_STEP))
        r = (x >> _U(11)).astype(np.float64) * 2.0**-53
        pick = j + (y % _U(m - j)).astype(np.int64)
        place = places[rows, pick]
        places[rows, pick] = places[rows, j]
        np.minimum.at(flat, base + place, j + r)
        worst = out[owner[0] : owner[-1] + 1].max(axis=1) if len(owner) else np.zeros(0)
        active = worst[owner - owner[0]] > j + 1
        if not active.any():
            break
        if active.mean() < 0.7:
            items, owner, base, places = items[active], owner[active], base[active], places[active]
            rows = np.arange(len(items))


def _digests(items: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set: two sums of differently mixed elements."""
    if not len(items):
        return np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    ends = np.cumsum(sizes)
    sums = []
    with np.errstate(over="ignore"):
        for salt in (0x1234567, 0x89ABCDEF01):
            total = np.concatenate(([_U(0)], np.cumsum(tokens.mix(items ^ tokens.mix(np.array([salt], np.uint64))))))
            sums.append(tokens.mix(total[ends] - total[ends - sizes] + sizes.astype(np.uint64)).view(np.int64))
    return sums[0], sums[1]


def _signatures(k: int, m: int, rows: int):
    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stop, hashes, counts in tokens.per_text(batch.column("text")):
                items, sizes = shingle_sets(hashes, counts, k)
                high, low = _digests(items, sizes)
                signature = super_minhash(items, sizes, m)
                bands = signature.reshape(len(sizes), m // rows, rows)
                value = np.zeros(bands.shape[:2], np.uint64)
                with np.errstate(over="ignore"):
                    for i in range(rows):
                        value = tokens.mix(value * _U(3) + bands[:, :, i])
                keep = np.where(sizes > 0, m // rows, 0)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(keep))).astype(np.int32)), pa.array(value[sizes > 0].reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, stop - first), pa.array(sizes), pa.array(high), pa.array(low), lists], ["doc_id", "n_shingles", "high", "low", "bands"])

    return run


def _sets(k: int):
    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, stop, hashes, counts in tokens.per_text(batch.column("text")):
                items, sizes = shingle_sets(hashes, counts, k)
                high, low = _digests(items, sizes)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(items.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(high), pa.array(low), lists], ["high", "low", "items"])

    return run


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


class Union:
    def __init__(self) -> None:
        self.up: dict = {}

    def find(self, x):
        root = x
        while (above := self.up.get(root, root)) != root:
            root = above
        while x != root:
            self.up[x], x = root, self.up.get(x, x)
        return root

    def join(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


@gives_back
def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task as stars: each node with the least node of its group, as far as this task sees.

    Links are taken a bounded number at a time, so a task's memory doesn't follow its input."""
    union: Union = Union()

    def stars() -> pa.RecordBatch:
        pairs = [(x, union.find(x)) for x in union.up]
        return pa.RecordBatch.from_arrays([pa.array([x for x, r in pairs if x != r], pa.binary()), pa.array([r for x, r in pairs if x != r], pa.binary())], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            union.join(a, b)
        if len(union.up) > 500_000:
            yield stars()
            union = Union()
    yield stars()


def components(links: DataFrame, at: str) -> DataFrame:
    """node, root (its group's least node) of all nodes of the links (a, b: binary); roots are left out.

    Links shrink to stars within tasks; then large-star and small-star steps in turn until no link changes. Each step is
    a written table, of fewer files than a shuffle has partitions, as its rows are few and short."""
    files = max(12, int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)
    edges = written(links.select("a", "b").mapInArrow(_forest, "a binary, b binary").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().coalesce(files), f"{at}/forest")
    mark = None
    for step in itertools.count():  # a logarithmic number of steps, whatever the links
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: each node's larger neighbours link to its least neighbour (or itself).
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: each node and its smaller neighbours link to the least of them.
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        edges = written(small.coalesce(files), f"{at}/step{step}")
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _verify(percent: int):
    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [[x.values.to_numpy(zero_copy_only=False) for x in batch.column(c)] for c in ("first_items", "other_items")]
            keep = pa.array([_linked(a, b, percent) for a, b in zip(*sets, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(keep)

    return run


def _across(percent: int):
    """Links between members of different groups in one pair of blocks of a bucket.

    Each group pair is compared until one link joins it; an inverted list of the other side's elements gives the sizes
    of all intersections with one set at once."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node").reset_index(drop=True)
        union, found = Union(), []
        nodes, roots, sides = rows["node"].tolist(), rows["root"].tolist(), rows["side"].tolist()
        sets = [np.asarray(x) for x in rows["items"]]
        sizes = np.array([len(x) for x in sets])
        values = np.concatenate(sets)
        owners = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(values, kind="stable")
        values, owners = values[order], owners[order]
        crowd = rows["root"].map(rows["root"].value_counts()).to_numpy()
        for i in sorted(range(len(sets)), key=lambda i: crowd[i]):
            # Members of the largest group are only looked at from the other side.
            if crowd[i] == crowd.max() and roots[i] == roots[int(np.argmax(crowd))]:
                continue
            low, high = np.searchsorted(values, sets[i], "left"), np.searchsorted(values, sets[i], "right")
            n = high - low
            at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
            shared = np.bincount(owners[at], minlength=len(sets))
            hits = np.flatnonzero(100 * shared >= percent * (sizes + sizes[i] - shared))
            for j in hits:
                if j != i and (sides[i] != sides[j] or sides[i] == 0 == sides[j]) and union.find(roots[i]) != union.find(roots[j]):
                    union.join(roots[i], roots[j])
                    found.append((max(nodes[i], nodes[j]), min(nodes[i], nodes[j])))
        return pd.DataFrame(found, columns=["a", "b"])

    return run


def _hidden(members: DataFrame, groups: DataFrame, sets: DataFrame, percent: int, at: str) -> DataFrame:
    """Links across groups within buckets that the stars left in several groups."""
    grouped = members.join(groups, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    # Several bands often hold the same members: one bucket for each set of members is enough.
    shape = grouped.groupBy("bucket").agg(F.count("*").alias("n"), F.min("root").alias("r0"), F.max("root").alias("r1"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64(F.lit(7), "node")).alias("x"))
    mixed = shape.where((F.col("n") > 2) & (F.col("r0") != F.col("r1"))).groupBy("n", "s", "x").agg(F.min("bucket").alias("bucket"))
    # A large bucket is cut into blocks, and each pair of its blocks is a task of its own.
    parts = F.ceil(F.col("n") / (BLOCK // 2)).cast("int")
    cut = grouped.join(mixed.select("bucket", F.when(F.col("n") <= BLOCK, 1).otherwise(parts).alias("parts")), "bucket")
    cut = cut.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda other: F.struct(F.least("part", other).alias("one"), F.greatest("part", other).alias("two"), F.when(other == F.col("part"), 0).when(F.col("part") < other, 1).otherwise(2).alias("side")))
    # Side 0: the block against itself. It also stands on its side in the pairs with other blocks.
    dealt = cut.select("bucket", "node", "root", F.explode(pairs).alias("p")).select("bucket", "node", "root", "p.*")
    return written(dealt.join(sets, "node").groupBy("bucket", "one", "two").applyInPandas(_across(percent), "a binary, b binary").distinct(), f"{at}/hidden")


def group(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, hashes: int = HASHES, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of docs."""
    spark = docs.sparkSession
    at = work_dir(spark, "near-dedup")
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", "text")
    signed = written(texts.mapInArrow(_signatures(words, hashes, rows), f"doc_id {kind}, n_shingles long, high long, low long, bands array<long>"), f"{at}/signatures")
    node = F.unhex(F.concat(*(F.lpad(F.hex(half), 16, "0") for half in ("high", "low"))))  # 16 bytes: every shuffle carries them
    ids = signed.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, node).alias("node"))

    # One row for each digest; copies go no further.
    classes = written(signed.where(F.col("n_shingles") > 0).groupBy(node.alias("node")).agg(F.min("doc_id").alias("doc_id"), F.any_value("bands").alias("bands")), f"{at}/classes")
    each = classes.select("node", F.posexplode("bands").alias("band", "value")).select(F.xxhash64("band", "value").alias("bucket"), "node")
    crowded = each.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("first")).where(F.col("n") > 1)
    members = written(each.join(crowded, "bucket").select("bucket", "node", "first"), f"{at}/members")
    stars = members.where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")).distinct()

    # The sets of candidates, from one document each.
    candidates = written(members.select("node").distinct().join(classes.select("node", "doc_id"), "node").select("node", F.col("doc_id").alias("_tl_id")), f"{at}/candidates")
    chosen = texts.join(bounded_broadcast(candidates.select("_tl_id").distinct()), F.col("doc_id").eqNullSafe(F.col("_tl_id")), "left_semi")
    made = chosen.select("text").mapInArrow(_sets(words), "high long, low long, items array<long>").select(node.alias("node"), "items")
    sets = written(made.join(bounded_broadcast(candidates.select("node")), "node", "left_semi").dropDuplicates(["node"]), f"{at}/sets")

    first_sets = sets.select(F.col("node").alias("b"), F.col("items").alias("first_items"))
    other_sets = sets.select(F.col("node").alias("a"), F.col("items").alias("other_items"))
    # The lesser of the two sizes bounds the intersection: pairs of too different sizes go before their sets are read.
    links = written(stars.join(other_sets, "a").join(first_sets, "b").mapInArrow(_verify(percent), "a binary, b binary"), f"{at}/links0")
    groups = components(links, f"{at}/components0")
    more = _hidden(members.select("bucket", "node"), groups, sets, percent, at)
    if not more.isEmpty():
        groups = components(links.union(more), f"{at}/components1")

    rooted = classes.select("node", "doc_id").join(groups, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = rooted.join(least, "root").select("node", "component_id")
    out = ids.join(named, "node", "left").select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def deduplicated(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of docs of each group, whole: that of the least id (null after all others), the first in the table of equal ones.

    Rows without words are groups of their own."""
    rows = keyed(docs, "copies")
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_tl_row").alias("row"))
    grouped = group(rows.select(key.alias("doc_id"), "text"), words, percent)
    gone = written(grouped.where(~F.col("kept")).select(F.col("doc_id.row").alias("_tl_gone")), work_dir(docs.sparkSession, "copies"))
    return rows.join(bounded_broadcast(gone), F.col("_tl_row") == F.col("_tl_gone"), "left_anti").select(*docs.columns)
