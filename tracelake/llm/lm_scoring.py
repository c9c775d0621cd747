"""Interpolated modified Kneser-Ney language model: counted in Spark, kept as sorted hash arrays, mapped by workers.

Counting. Each task makes sorted, compressed blobs of distinct words (then n-grams) and their counts for each range of
hash values; one group for each range merges its blobs and writes sorted arrays to the shared folder. Ranges are as many
as the input asks for (one for `range_bytes` of text), so a group stays small at any size, and a hot word or n-gram is
one entry of each blob. Lower orders are counted from the distinct n-grams of the order above: their value is the number
of different words before them (for those that begin a text, how often they do). Each order also sums, for every
context, its values and how many are 1, 2 and more: all that the discounts and back-off weights need.

Up to `FEW` ranges, each flush of a task makes a blob for each range. Beyond, that would be as many blobs as the square of
the input: there it makes one for each of about sqrt(ranges) runs of ranges, and a second pass over slices of each run, none
larger than a range, deals them to the ranges. The arrays are the same either way.

Scoring. Workers map the arrays (8-byte keys with one-byte counts and a table for larger ones), look up all n-grams of a
block of texts in sorted order, and sum logarithms for each text. The sizes of ranges are mapped arrays too: tasks carry
paths and a few numbers. A row for each range comes to the driver.

Keys of words are 64-bit hashes; ids are places in the sorted words, of 32 bits as long as these are enough, else of 64;
n-grams of two 32-bit ids have keys of their own, all others 64-bit hashes.

Defined results: a null text has no words, only its end; a null id counts as held out (its text form is empty); repeated
rows are trained on and scored as often as they come; without any training text all scores are 0; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _files, tokens
from ._shared import work_dir, written

#: Two words: longer orders are counted and scored by the same code, but their arrays take more disk than the input.
ORDER = 2
RANGE_BYTES = 24 << 20
#: Words or n-grams that a task holds before it writes its blobs.
HELD = 2_000_000
#: Ranges up to which a flush makes a blob for each.
FEW = 1024
END = np.uint64(0xE3D0F7E2C9B1A586)
_U = np.uint64
NARROW, WIDE = "u4", "u8"


def _begin(kind: str) -> np.uint64:
    """The id that stands before a text."""
    return _U((1 << 8 * int(kind[1])) - 1)


def _unknown(kind: str) -> np.uint64:
    """The id of words that the training texts don't have."""
    return _begin(kind) - _U(1)


# Blobs: columns of numbers, bytes of equal weight side by side, compressed.
def _pack(columns: list[np.ndarray]) -> bytes:
    n = len(columns[0])
    body = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(n, -1).T.tobytes() for c in columns)
    return np.array([n], "<u4").tobytes() + zstandard.ZstdCompressor(level=1).compress(body)


def _unpack(blob: bytes, kinds: list[str]) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, "<u4", 1)[0])
    body, out, at = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[4:]), np.uint8), [], 0
    for kind in kinds:
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(body[at : at + n * width].reshape(width, n).T).view(kind).reshape(-1))
        at += n * width
    return out


def _width(ranges: int) -> int:
    return (1 << 64) // ranges + 1


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1]))) if len(sorted_values) else np.zeros(0, np.int64)


def _gram_key(ids: list[np.ndarray], kind: str) -> np.ndarray:
    with np.errstate(over="ignore"):
        if kind == NARROW and len(ids) > 1:
            key, rest = (ids[0].astype(np.uint64) << _U(32)) | ids[1].astype(np.uint64), ids[2:]
        else:
            key, rest = ids[0].astype(np.uint64), ids[1:]
        key = tokens.mix(key + _U(1))
        for more in rest:
            key = tokens.mix(key * _U(3) + more.astype(np.uint64))
    return key


def _reduced(ids: list[np.ndarray], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct tuples of ids in order, and the sums of their values."""
    if len(ids) == 1 or (len(ids) == 2 and ids[0].dtype == np.uint32):
        packed = ids[0].astype(np.uint64) if len(ids) == 1 else (ids[0].astype(np.uint64) << _U(32)) | ids[1].astype(np.uint64)
        order = np.argsort(packed)
        first = _runs(packed[order])
    else:
        order = np.lexsort(ids[::-1])
        same = np.ones(max(len(order) - 1, 0), bool)
        for c in ids:
            same &= c[order][1:] == c[order][:-1]
        first = np.flatnonzero(np.concatenate(([True], ~same))) if len(order) else np.zeros(0, np.int64)
    sums = [np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values]
    return [c[order[first]] for c in ids], sums


def _blobs(ids: list[np.ndarray], values: list[np.ndarray], ranges: int, run: int, kind: str) -> Iterator[tuple[int, bytes]]:
    """A blob for each range of keys (or run of ranges) that these distinct, ordered tuples fall into."""
    part = (_gram_key(ids, kind) // _U(_width(ranges)) // _U(run)).astype(np.uint32)
    order = np.argsort(part, kind="stable")
    first = _runs(part[order])
    for at, stop in zip(first, [*first[1:], len(order)], strict=True):
        own = order[at:stop]
        yield int(part[own[0]]), _pack([c[own].astype(kind) for c in ids] + [v[own].astype(np.uint64) for v in values])


_BLOB = "range long, blob binary"


def _run_of(ranges: int, few: int) -> int:
    """How many ranges one blob of the first pass takes in."""
    return 1 if ranges <= few else int(np.ceil(np.sqrt(ranges)))


def _dealt(blobs: DataFrame, ranges: int, run: int, split) -> DataFrame:
    """Blobs (range, kind, blob) of single ranges, from those of runs of ranges.

    Each run is cut into as many slices as it has ranges, by the blobs themselves, so none is larger than a range."""
    if run == 1:
        return blobs
    sliced = blobs.withColumn("slice", F.pmod(F.xxhash64("blob"), F.lit(run)))
    return sliced.groupBy("range", "kind", "slice").applyInArrow(split, "range long, blob binary, kind string")


def _blob_table(pairs: list[tuple[int, bytes]], kind: str) -> pa.Table:
    return pa.table({"range": pa.array([r for r, _ in pairs], pa.int64()), "blob": pa.array([b for _, b in pairs], pa.binary()), "kind": pa.array([kind] * len(pairs), pa.string())})


def _blob_batch(pairs: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r for r, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.binary())], ["range", "blob"])


# Words.
def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    order = np.argsort(keys)
    first = _runs(keys[order])
    return keys[order[first]], np.add.reduceat(counts[order], first)


def _word_blobs(keys: np.ndarray, counts: np.ndarray, ranges: int, run: int) -> list[tuple[int, bytes]]:
    part = keys // _U(_width(ranges)) // _U(run)
    first = _runs(part)
    return [(int(part[at]), _pack([keys[at:stop], counts[at:stop]])) for at, stop in zip(first, [*first[1:], len(part)], strict=True)]


def _split_words(ranges: int):
    def split(key: tuple, table: pa.Table) -> pa.Table:
        parts = [_unpack(b.as_py(), ["u8", "u8"]) for b in table.column("blob")]
        keys, counts = _summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))
        return _blob_table(_word_blobs(keys, counts, ranges, 1), "value")

    return split


def _count_words(ranges: int, ranges_in_blob: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size, texts = 0, 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            return _summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))

        def flush() -> pa.RecordBatch:
            return _blob_batch(_word_blobs(*merged(), ranges, ranges_in_blob))

        for batch in batches:
            texts += len(batch)
            for hashes, _, _ in tokens.blocks(batch.column("text")):
                held.append(np.unique(hashes, return_counts=True))
                held[-1] = (held[-1][0], held[-1][1].astype(np.uint64))
                size += len(held[-1][0])
                if size > HELD:
                    held[:] = [merged()]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield flush()
                        held, size = [], 0
        if texts:
            held.append((np.array([END]), np.array([texts], np.uint64)))
            yield flush()

    return run


def _merge_words(path: str):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        at = key[0].as_py()
        parts = [_unpack(b.as_py(), ["u8", "u8"]) for b in table.column("blob")]
        keys, counts = _summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))
        _files.save(f"{path}/{at}.key", keys)
        _files.save(f"{path}/{at}.count", counts)
        return pa.table({"range": pa.array([at], pa.int64()), "n": pa.array([len(keys)], pa.int64()), "total": pa.array([int(counts.sum())], pa.int64())})

    return run


def _save_sizes(path: str, name: str, found: list[tuple[int, int]], ranges: int) -> np.ndarray:
    """The size of each range (0: no such range) as an array in the shared folder."""
    sizes = np.zeros(ranges, np.uint64)
    for r, n in found:
        sizes[r] = n
    _files.save(f"{path}/{name}", sizes)
    return sizes


@dataclass(frozen=True)
class Words:
    """The training words: ranges of keys, where each range's ids begin, and how many there are."""

    path: str
    width: int
    ranges: int
    total: int
    kind: str

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of sorted keys; the unknown id and 0 for others."""
        unknown = _unknown(self.kind)
        ids, counts = np.full(len(keys), unknown), np.zeros(len(keys), np.uint64)
        sizes, starts = (_mapped(f"{self.path}/{n}", "u8", self.ranges) for n in ("sizes", "starts"))
        for r, lo, hi in _segments(keys, self.width, sizes):
            n = int(sizes[r])
            own, count = _mapped(f"{self.path}/{r}.key", "u8", n), _mapped(f"{self.path}/{r}.count", "u8", n)
            at = np.searchsorted(own, keys[lo:hi])
            at[at == len(own)] = 0
            hit = own[at] == keys[lo:hi]
            ids[lo:hi] = np.where(hit, at.astype(np.uint64) + starts[r], unknown)
            counts[lo:hi] = np.where(hit, count[at], 0)
        return ids, counts


def _segments(keys: np.ndarray, width: int, sizes: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(range, start, stop) of the ranges that sorted keys fall into, of those that hold any."""
    if not len(keys):
        return
    part = keys // _U(width)
    first = _runs(part)
    for lo, hi in zip(first, [*first[1:], len(keys)], strict=True):
        if sizes[int(part[lo])]:
            yield int(part[lo]), int(lo), int(hi)


_maps: dict[tuple, np.ndarray] = {}


def _mapped(path: str, kind: str, n: int) -> np.ndarray:
    """The array, mapped once by each worker. Maps of models no longer used go when there are many."""
    if (path, kind) not in _maps:
        if len(_maps) > 50_000:
            _maps.clear()
        _maps[path, kind] = _files.load(path, kind, n)
    return _maps[path, kind]


# Texts as ids with their contexts.
def sequences(texts: pa.Array, words: Words, order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids with order - 1 before each run, places of the predicted tokens, their texts, their counts) of successive blocks.

    A text that goes on in the next block takes its last ids along as context."""
    before = order - 1
    end_id, end_count = (x[0] for x in words.find(np.array([END])))
    begin = _begin(words.kind)
    start, tail = 0, np.full(before, begin)

    def laid(first: int, last: int, ids: np.ndarray, counts: np.ndarray, sizes: np.ndarray, closes: np.ndarray) -> tuple:
        lengths = before + sizes + closes
        ends = np.cumsum(lengths)
        flat, known = np.full(int(ends[-1]), begin), np.zeros(int(ends[-1]), np.uint64)
        flat[:before] = tail
        owner = np.repeat(np.arange(first, last + 1), lengths)
        inner = np.ones(len(flat), bool)
        for i in range(before):
            inner[ends - lengths + i] = False
        word = inner.copy()
        final = (ends - 1)[closes.astype(bool)]
        word[final] = False
        flat[word], known[word] = ids, counts
        flat[final], known[final] = end_id, end_count
        places = np.flatnonzero(inner)
        return flat, places, owner[places], known[places]

    # Larger blocks than elsewhere: more of their n-grams are equal and are looked up once.
    for hashes, index, _ in tokens.blocks(texts, 2 * tokens.BLOCK):
        if not len(hashes):
            continue
        distinct, back = np.unique(hashes, return_inverse=True)
        ids, counts = words.find(distinct)
        last = int(index[-1])
        sizes = np.bincount(index - start, minlength=last - start + 1).astype(np.int64)
        closes = np.ones(len(sizes), np.int64)
        closes[-1] = 0
        out = laid(start, last, ids[back], counts[back], sizes, closes)
        start, tail = last, out[0][len(out[0]) - before :] if before else tail
        yield out
    if len(texts):
        n = len(texts) - start
        yield laid(start, len(texts) - 1, np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(n, np.int64), np.ones(n, np.int64))


def _merged_blobs(blobs: pa.ChunkedArray, kinds: list[str]) -> list[np.ndarray]:
    parts = [_unpack(b.as_py(), kinds) for b in blobs]
    return [np.concatenate([p[i] for p in parts]) for i in range(len(kinds))]


def _split_grams(level: int, ranges: int, kind: str):
    def split(key: tuple, table: pa.Table) -> pa.Table:
        what = key[1].as_py()
        columns = _merged_blobs(table.column("blob"), [kind] * level + ["u8"] * (1 if what == "value" else 4))
        return _blob_table(list(_blobs(*_reduced(columns[:level], columns[level:]), ranges, 1, kind)), what)

    return split


def _count_grams(words: Words, order: int, ranges: int, ranges_in_blob: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ids = [np.concatenate([h[i] for h in held]) for i in range(order)]
            return _blob_batch(list(_blobs(*_reduced(ids, [np.ones(len(ids[0]), np.uint64)]), ranges, ranges_in_blob, words.kind)))

        for batch in batches:
            for flat, places, _, _ in sequences(batch.column("text"), words, order):
                held.append([flat[places - order + 1 + i].astype(words.kind) for i in range(order)])
                size += len(places)
                if size > HELD:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return run


_MERGED = "range long, level int, kind string, blob binary, n long, over long, total long, c1 long, c2 long, c3 long, c4 long, c5 long"


def _merge_grams(path: str, level: int, top: bool, ranges: int, ranges_in_blob: int, id_kind: str):
    """Merges a range of one order: writes its arrays, passes what the order below needs, and describes the range."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        at = key[0].as_py()
        ids_kinds = [id_kind] * level
        value, context = [], []
        for kind, blob in zip(table.column("kind").to_pylist(), table.column("blob"), strict=True):
            (value if kind == "value" else context).append(_unpack(blob.as_py(), ids_kinds + ["u8"] * (1 if kind == "value" else 4)))
        columns = [np.concatenate([np.concatenate([p[i] for p in value + context])]) for i in range(level)]
        n_value, n_context = sum(len(p[0]) for p in value), sum(len(p[0]) for p in context)
        sums = [np.concatenate([*(p[level] for p in value), np.zeros(n_context, np.uint64)])]
        if not top:
            sums += [np.concatenate([np.zeros(n_value, np.uint64), *(p[level + i] for p in context)]) for i in range(4)]
        ids, sums = _reduced(columns, sums)
        keys = _gram_key(ids, id_kind)
        order = np.argsort(keys)
        count = sums[0]
        over = np.flatnonzero(count[order] >= 255)
        _files.save(f"{path}/{at}.key", keys[order])
        _files.save(f"{path}/{at}.small", np.minimum(count[order], 255).astype(np.uint8))
        _files.save(f"{path}/{at}.place", over.astype(np.uint64))
        _files.save(f"{path}/{at}.large", count[order][over])
        if not top:
            for name, x in zip(("total", "n1", "n2", "n3"), sums[1:], strict=True):
                _files.save(f"{path}/{at}.{name}", x[order])
        there = count > 0
        rows = [(at, "range", b"", len(keys), len(over), int(count.sum()), *(int((count == i).sum()) for i in (1, 2, 3, 4)), int((count > 2).sum()))]
        if level > 1 and there.any():
            own, c = [x[there] for x in ids], count[there]
            passed = np.where(own[1] == own[1].dtype.type(_begin(id_kind)), c, _U(1))
            rows += [(r, "value", b, 0, 0, 0, 0, 0, 0, 0, 0) for r, b in _blobs(*_reduced(own[1:], [passed]), ranges, ranges_in_blob, id_kind)]
            kinds = [c, (c == 1).astype(np.uint64), (c == 2).astype(np.uint64), (c > 2).astype(np.uint64)]
            rows += [(r, "context", b, 0, 0, 0, 0, 0, 0, 0, 0) for r, b in _blobs(*_reduced(own[:-1], kinds), ranges, ranges_in_blob, id_kind)]
        cols = list(zip(*rows, strict=True))
        whole = pa.int64()
        return pa.table({"range": pa.array(cols[0], whole), "level": pa.array([level] * len(rows), pa.int32()), "kind": pa.array(cols[1], pa.string()), "blob": pa.array(cols[2], pa.binary()), **{n: pa.array(c, whole) for n, c in zip(("n", "over", "total", "c1", "c2", "c3", "c4", "c5"), cols[3:], strict=True)}})

    return run


@dataclass(frozen=True)
class Level:
    path: str
    width: int
    ranges: int

    def find(self, keys: np.ndarray, contexts: bool) -> list[np.ndarray]:
        """The values of sorted keys (0 if they aren't there), or as contexts their totals and counts of 1, 2 and more."""
        names = ("total", "n1", "n2", "n3") if contexts else ("small",)
        out = [np.zeros(len(keys)) for _ in names]
        sizes, overs = (_mapped(f"{self.path}/{n}", "u8", self.ranges) for n in ("sizes", "overs"))
        for r, lo, hi in _segments(keys, self.width, sizes):
            n, over = int(sizes[r]), int(overs[r])
            own = _mapped(f"{self.path}/{r}.key", "u8", n)
            at = np.searchsorted(own, keys[lo:hi])
            at[at == n] = 0
            hit = own[at] == keys[lo:hi]
            for o, name in zip(out, names, strict=True):
                found = _mapped(f"{self.path}/{r}.{name}", "u1" if name == "small" else "u8", n)[at].astype(float)
                if name == "small" and over:
                    big = np.flatnonzero(found == 255)
                    found[big] = _mapped(f"{self.path}/{r}.large", "u8", over)[np.searchsorted(_mapped(f"{self.path}/{r}.place", "u8", over), at[big].astype(np.uint64))]
                o[lo:hi] = np.where(hit, found, 0)
        return out


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three discounts from counts of counts; where one of those is 0 (a few texts), 0.5, 1 and 1.5."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return 1 - 2 * y * n2 / n1, max(0.0, 2 - 3 * y * n3 / n2), max(0.0, 3 - 4 * y * n4 / n3)


@dataclass(frozen=True)
class Model:
    order: int
    tokens: int
    words: Words
    levels: tuple[Level, ...]
    cuts: tuple[tuple[float, float, float], ...]
    root: tuple[float, float, float, float]

    @property
    def n_words(self) -> int:
        return self.words.total

    def log10(self, flat: np.ndarray, places: np.ndarray) -> np.ndarray:
        """log10 of the probability of the token at each place, given those before it."""
        p = np.full(len(places), 1 / (self.n_words + 1))
        for k in range(1, self.order + 1):
            ids = [flat[places - k + 1 + i] for i in range(k)]
            value = self._looked_up(k, ids, False)[0]
            total, n1, n2, n3 = (np.full(len(p), x) for x in self.root) if k == 1 else self._looked_up(k - 1, ids[:-1], True)
            d1, d2, d3 = self.cuts[k - 1]
            cut = np.where(value == 0, 0, np.where(value == 1, d1, np.where(value == 2, d2, d3)))
            with np.errstate(divide="ignore", invalid="ignore"):
                p = np.where(total > 0, (np.maximum(value - cut, 0) + (d1 * n1 + d2 * n2 + d3 * n3) * p) / total, p)
        return np.log10(p)

    def _looked_up(self, k: int, ids: list[np.ndarray], contexts: bool) -> list[np.ndarray]:
        distinct, back = np.unique(_gram_key(ids, self.words.kind), return_inverse=True)
        return [x[back] for x in self.levels[k - 1].find(distinct, contexts)]


def train(docs: DataFrame, order: int = ORDER, range_bytes: int = RANGE_BYTES, at: str | None = None, few: int = FEW, id_kind: str | None = None) -> Model:
    """The model of all texts of docs."""
    spark = docs.sparkSession
    at = at or work_dir(spark, "language-model")
    texts = docs.select("text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(4, -(-size // range_bytes))
    width, run = _width(ranges), _run_of(ranges, few)
    blobs = _dealt(texts.mapInArrow(_count_words(ranges, run), _BLOB).withColumn("kind", F.lit("value")), ranges, run, _split_words(ranges))
    merged = blobs.groupBy("range").applyInArrow(_merge_words(f"{at}/words"), "range long, n long, total long").collect()
    sizes = _save_sizes(f"{at}/words", "sizes", [(r["range"], r["n"]) for r in merged], ranges)
    _files.save(f"{at}/words/starts", np.cumsum(sizes) - sizes)
    n_words = int(sizes.sum())
    kind = id_kind or (NARROW if n_words < int(_unknown(NARROW)) else WIDE)
    words = Words(f"{at}/words", width, ranges, n_words, kind)
    blobs = texts.mapInArrow(_count_grams(words, order, ranges, run), _BLOB).withColumn("kind", F.lit("value"))
    levels: list[Level] = []
    cuts, root = [], (0.0, 0.0, 0.0, 0.0)
    for k in range(order, 0, -1):
        path = f"{at}/level{k}"
        own = _dealt(blobs, ranges, run, _split_grams(k, ranges, kind))
        done = written(own.groupBy("range").applyInArrow(_merge_grams(path, k, k == order, ranges, run, kind), _MERGED), f"{at}/merged{k}")
        own = done.where("kind = 'range'").drop("blob").collect()
        for name, column in (("sizes", "n"), ("overs", "over")):
            _save_sizes(path, name, [(r["range"], r[column]) for r in own], ranges)
        levels.insert(0, Level(path, width, ranges))
        c1, c2, c3, c4, c5, total = (sum(r[n] for r in own) for n in ("c1", "c2", "c3", "c4", "c5", "total"))
        cuts.insert(0, discounts(c1, c2, c3, c4))
        if k == 1:
            root = (float(total), float(c1), float(c2), float(c5))
        blobs = done.where("kind <> 'range'").select("range", "blob", "kind")
    return Model(order, sum(r["total"] for r in merged), words, tuple(levels), tuple(cuts), root)


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = model.tokens + 0.1 * (model.n_words + 1)
        for batch in batches:
            n = len(batch)
            size, known, base, score = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
            for flat, places, owner, counts in sequences(batch.column("text"), model.words, model.order):
                size += np.bincount(owner, minlength=n)
                known += np.bincount(owner[counts > 0], minlength=n)
                base += np.bincount(owner, np.log10((counts.astype(float) + 0.1) / floor), n)
                score += np.bincount(owner, model.log10(flat, places), n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(size), pa.array(known), pa.array(np.full(n, model.tokens)), pa.array(base), pa.array(score), pa.array(10 ** np.minimum(300, -score / np.maximum(size, 1)))], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return run


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 10 == 0


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of each row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(_score(model), schema)


def scored(docs: DataFrame, order: int = ORDER, range_bytes: int = RANGE_BYTES, few: int = FEW, id_kind: str | None = None) -> DataFrame:
    """All rows of docs, scored by the model of those that are not held out."""
    return score(docs, train(docs.where(~held_out(F.col("doc_id"))), order, range_bytes, few=few, id_kind=id_kind))
