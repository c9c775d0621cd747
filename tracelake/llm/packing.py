"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Documents are tokenized whole; those longer than a sequence are cut into full pieces and a last one. Full pieces fill a
sequence alone. All others go to blocks of about `block` pieces, and each block is packed by several islands. An island
breeds its own population, whose first members are best fits of differently disturbed orders: crossover injects whole
well-filled bins of one parent into the other, removes what is then there twice, and best-fits the displaced pieces.
After each epoch its elite moves to the next island, which breeds on. A block whose packing meets the lower bound (its
tokens over the sequence length, rounded up) is done: nothing can be fewer.

The poorly filled sequences of all blocks are then packed once more, in fewer blocks, until one block is left or a round
saves less than one in a hundred of the sequences that it takes up. Where pieces fill sequences well, rounding up thus
costs one sequence in all and not one a block.

Blocks are dealt by a hash of a running number, so a hot key does not make a block large.

Defined results: a null text is the empty text, one piece of the end token alone; repeated rows are packed as often as
they come; null ids stay; an empty table gives no rows; other columns are not read; a text of any length is tokenized in
blocks and cut as it comes, so no task holds more of it than a block.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import wordpieces
from ._shared import gives_back, work_dir, written

LENGTH = 4096
END = 1
BLOCK = 4000
ISLANDS = 3
POPULATION = 8
GENERATIONS = 40
#: Times that islands breed, with a migration before each but the first.
EPOCHS = 3
#: A bin that is filled so far is worth keeping whole.
WELL = 0.98


def _pieces(path: str, length: int, end: int):
    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, row = wordpieces.encoder(path), TaskContext.get().partitionId(), 0
        tail = np.array([end], "<u4")
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("at", "piece", "start", "length", "ids_crc32", "number")}
            held: list[np.ndarray] = []
            size, piece, start = 0, 0, 0
            for text, ids, ends in encode(batch.column("text")):
                held.append(tail if ends else ids.astype("<u4", copy=False))
                size += len(held[-1])
                if size < length and not ends:
                    continue
                whole = held[0] if len(held) == 1 else np.concatenate(held)
                stop = size if ends else size - size % length
                for at in range(0, stop, length):
                    own = whole[at : min(at + length, stop)]
                    for key, value in zip(out, (text, piece, start, len(own), zlib.crc32(own), (part << 33) + row), strict=True):
                        out[key].append(value)
                    piece, start, row = piece + 1, start + len(own), row + 1
                held, size = ([], 0) if stop == size else ([whole[stop:]], size - stop)
                if ends:
                    piece, start = 0, 0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(out.pop("at"), pa.int64())), pa.array(out["piece"], pa.int32()), *(pa.array(out[k], pa.int64()) for k in ("start", "length", "ids_crc32", "number"))], ["doc_id", "piece", "start", "length", "ids_crc32", "number"])

    return run


class Bins:
    """Bins under best fit: a bit for each free length that some bin has makes the tightest bin one shift away."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.items, self.free, self.by_free, self.bits = capacity, [], [], {}, 0

    def _place(self, b: int) -> None:
        f = self.free[b]
        if f:
            self.by_free.setdefault(f, []).append(b)
            self.bits |= 1 << f

    def open(self, items: list[int], free: int) -> None:
        self.items.append(items)
        self.free.append(free)
        self._place(len(self.items) - 1)

    def fit(self, item: int, size: int) -> None:
        over = self.bits >> size
        if not over:
            self.open([item], self.capacity - size)
            return
        f = size + (over & -over).bit_length() - 1
        own = self.by_free[f]
        b = own.pop()
        if not own:
            self.bits ^= 1 << f
        self.items[b].append(item)
        self.free[b] = f - size
        self._place(b)


def fill(bins: list[list[int]], sizes: list[int]) -> list[int]:
    return [sum([sizes[i] for i in b]) for b in bins]


def pack(sizes: list[int], order: list[int], capacity: int, whole: list[list[int]] = ()) -> list[list[int]]:
    """Best fit of the items in this order, into the whole bins given and new ones."""
    bins = Bins(capacity)
    for items, used in zip(whole, fill(whole, sizes), strict=True):
        bins.open(list(items), capacity - used)
    for i in order:
        bins.fit(i, sizes[i])
    return bins.items


def value(bins: list[list[int]], sizes: list[int]) -> tuple[int, int]:
    """Fewer bins first; among equals, fuller ones beside emptier ones (the sum of squared fillings)."""
    return -len(bins), sum([f * f for f in fill(bins, sizes)])


def crossover(one: list[list[int]], other: list[list[int]], sizes: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """Whole well-filled bins of `other` enter `one`; bins that would hold an item twice go, and their other items are best-fitted again."""
    filled = fill(other, sizes)
    well = [k for k in range(len(other)) if filled[k] >= WELL * capacity] or [max(range(len(other)), key=filled.__getitem__)]
    injected = [other[k] for k in rng.sample(well, rng.randint((len(well) + 1) // 2, len(well)))]
    there = {i for b in injected for i in b}
    kept, displaced = list(injected), []
    for b in one:
        if there.isdisjoint(b):
            kept.append(b)
        else:
            displaced += [i for i in b if i not in there]
    displaced.sort(key=sizes.__getitem__, reverse=True)
    return pack(sizes, displaced, capacity, kept)


def mutate(bins: list[list[int]], sizes: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """The emptiest bins and a few others are opened and their items best-fitted again."""
    filled = fill(bins, sizes)
    some = max(1, len(bins) // 20)
    opened = set(sorted(range(len(bins)), key=filled.__getitem__)[:some]) | set(rng.sample(range(len(bins)), some))
    items = sorted((i for k in opened for i in bins[k]), key=lambda i: sizes[i] * (1 + 0.05 * rng.random()), reverse=True)
    return pack(sizes, items, capacity, [b for k, b in enumerate(bins) if k not in opened])


def evolve(sizes: list[int], capacity: int, seed: int, elites: list[list[list[int]]] = (), generations: int = GENERATIONS, population: int = POPULATION) -> tuple[list[list[int]], int]:
    """The best packing that one island finds, and the generations that it took. Elites of islands are part of its first population."""
    rng, least = random.Random(seed), -(-sum(sizes) // capacity)
    people = [(value(p, sizes), p) for p in elites]
    while len(people) < population and (not people or len(people[-1][1]) > least):
        noisy = sorted(range(len(sizes)), key=[s * (1 + 0.2 * rng.random()) for s in sizes].__getitem__, reverse=True)
        made = pack(sizes, noisy, capacity)
        people.append((value(made, sizes), made))
    people.sort(key=lambda p: p[0], reverse=True)
    for done in range(generations):
        if -people[0][0][0] <= least:
            return people[0][1], done
        # The better half breeds with any other member.
        one, other = rng.sample(people[: max(2, len(people) // 2)], 1)[0], rng.choice(people)
        if one is other:
            other = people[0] if one is not people[0] else people[-1]
        child = crossover(one[1], other[1], sizes, capacity, rng)
        if rng.random() < 0.5:
            child = mutate(child, sizes, capacity, rng)
        people.append((value(child, sizes), child))
        people.sort(key=lambda p: p[0], reverse=True)
        del people[population:]
    return people[0][1], generations


_PACKED = "block long, island long, number long, size long, bin long, generations long"


def _island(capacity: int, islands: int, epoch: int):
    """One island of one block. After the first epoch its rows are its own elite's and those of the island before it."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        block, island = int(key[0]), int(key[1])
        items = (rows[rows["elite"] == island] if epoch else rows).sort_values("number", kind="stable")
        sizes, elites = items["size"].tolist(), []
        if epoch:
            place = dict(zip(items["number"].tolist(), range(len(items)), strict=True))
            for _, own in rows.groupby("elite"):
                bins: dict[int, list[int]] = {}
                for n, b in zip(own["number"].tolist(), own["bin"].tolist(), strict=True):
                    bins.setdefault(b, []).append(place[n])
                elites.append(list(bins.values()))
        found, generations = evolve(sizes, capacity, (block * EPOCHS + epoch) * islands + island, elites)
        own_bin = [0] * len(sizes)
        for b, members in enumerate(found):
            for i in members:
                own_bin[i] = b
        return pd.DataFrame({"block": block, "island": island, "number": items["number"].to_numpy(), "size": sizes, "bin": own_bin, "generations": generations})

    return run


def evolved(items: DataFrame, at: str, capacity: int, islands: int = ISLANDS) -> DataFrame:
    """block, number, size, bin, generations of every item (block, number, size): the best packing of the block's islands."""
    spark = items.sparkSession
    every = items.withColumn("island", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(islands - 1).cast("long"))))
    now = written(every.groupBy("block", "island").applyInPandas(_island(capacity, islands, 0), _PACKED), f"{at}/epoch0")
    settled = now.limit(0)
    for epoch in range(1, EPOCHS):
        # Blocks that an island has packed as well as can be are done; in the others, each elite moves to the next island.
        scores = now.groupBy("block", "island").agg((F.max("bin") + 1).alias("bins"), F.sum("size").alias("tokens"))
        best = scores.groupBy("block").agg(F.min("bins").alias("bins"), F.max("tokens").alias("tokens"))
        open_blocks = written(best.where(F.col("bins") > F.ceil(F.col("tokens") / capacity)).select("block"), f"{at}/open{epoch}")
        if open_blocks.isEmpty():
            break
        going = now.join(open_blocks, "block", "left_semi").select("block", "number", "size", "bin", F.col("island").alias("elite"))
        stays = going.withColumn("island", F.col("elite"))
        bred = stays.union(going.withColumn("island", (F.col("elite") + 1) % islands)) if islands > 1 else stays
        settled = settled.union(now.join(open_blocks, "block", "left_anti"))
        now = written(bred.groupBy("block", "island").applyInPandas(_island(capacity, islands, epoch), _PACKED), f"{at}/epoch{epoch}")
    done = settled.union(now)
    ranks = done.groupBy("block", "island").agg((F.max("bin") + 1).alias("bins"))
    best = ranks.groupBy("block").agg(F.min(F.struct("bins", "island"))["island"].alias("island"))
    return written(done.join(best, ["block", "island"]).select("block", "number", "size", "bin", "generations"), f"{at}/best")


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and a running number of each piece."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer, length, end), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, number long")


def packed(docs: DataFrame, tokenizer: str, length: int = LENGTH, block: int = BLOCK, islands: int = ISLANDS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece of docs."""
    spark = docs.sparkSession
    at = work_dir(spark, "packing")
    cut = written(pieces(docs, tokenizer, length), f"{at}/pieces")
    rest = cut.where(F.col("length") < length).select("number", F.col("length").alias("size"))
    placed, k, taken_up = None, 0, 0
    while n := rest.count():
        blocks = -(-n // block)
        # Neighbours in one task are dealt to different blocks, each block gets about as many from each task.
        dealt = rest.select(F.pmod(F.xxhash64(F.lit(k), "number"), F.lit(blocks)).alias("block"), "number", "size")
        done = evolved(dealt, f"{at}/round{k}", length, islands)
        bins = done.groupBy("block", "bin").agg(F.sum("size").alias("filled"))
        made, n_poor = bins.agg(F.count("*"), F.count_if(_poor(length))).first()
        last = blocks == 1 or not n_poor or (k > 0 and 100 * (taken_up - made) < taken_up)
        poor = bins.where(_poor(length)).select("block", "bin")
        own = (done if last else done.join(poor, ["block", "bin"], "left_anti")).select("number", F.lit(k).alias("round"), "block", "bin")
        placed = own if placed is None else placed.union(own)
        if last:
            break
        rest = written(done.join(poor, ["block", "bin"], "left_semi").select("number", "size"), f"{at}/rest{k}")
        k, taken_up = k + 1, n_poor
    # Sequence numbers: a full piece has its own number; packed ones are told apart by round, block and bin.
    full = cut.where(F.col("length") == length).withColumn("sequence_id", -1 - F.col("number")).withColumn("offset", F.lit(0).cast("long")).drop("number")
    if placed is None:
        return full
    ids = F.shiftleft(F.col("round").cast("long"), 56) + F.shiftleft("block", 20) + F.col("bin")
    both = cut.where(F.col("length") < length).join(placed.select("number", ids.alias("sequence_id")), "number")
    before = Window.partitionBy("sequence_id").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")).drop("number")
    return full.unionByName(both)


def _poor(length: int):
    return F.col("filled") < 0.97 * length
