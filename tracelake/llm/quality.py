"""Quality by importance resampling: hashed n-gram models of good and of all text, sampled by Gumbel top-k.

1. N-grams are words and marks (runs of ASCII punctuation and what stands between them) and pairs of them within a text;
   a pair of equal ones is one n-gram of its own, "once more". All are hashed to `BUCKETS` buckets.
2. All documents give the raw model. Labelled good documents give the target model. The labelled sample is bounded: the
   `LABELS` documents with the least hashes of their ids. All of it fits the model; to set k, each half of it is weighed
   by a model of the other half, so none is weighed by a model that has seen it.
3. A document's log importance weight is the sum over its n-grams of the log ratio of both models.
4. Log weight plus standard Gumbel noise is its key; the k greatest keys are a sample of k documents without replacement
   by importance. The noise comes from id and seed, so a task that runs again draws the same; the cut is found exactly
   from counts of the keys' digits.
5. k is a parameter. Without it, k is the number of documents that keys above a threshold are expected to give, where
   the threshold is the one that a share `KEEP` of the held-back good documents is expected to pass.

Defined results: null and empty texts have weight 0; repeated rows and rows of one id share their noise, and all keys
equal to the cut stay; a null id draws noise like any other; labels that are null or of unknown documents are not used
(a document with several labels is good if all are); without any good label all documents stay; an empty table gives no
rows; a text of any length is read in blocks. `keep_good` decides row by row and passes all columns through, whatever
their names (its own begin with _tl_).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import tokens
from ._shared import gives_back, work_dir, written

BUCKETS = 1 << 15
LABELS = 20_000
#: N-grams added to each bucket of the target model, and to what the raw model lets expect there.
SMOOTH = 100.0
KEEP = 0.998
SEED = 17
#: Keys as whole numbers: bits before and after the point, and how many one round of counting looks at.
WHOLE, POINT, DIGIT = 30, 32, 16
_MARKS = np.zeros(256, bool)
_MARKS[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) != "_"]] = True
_AGAIN = np.uint64(0x5851F42D4C957F2D)


def grams(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of n-grams, and the index of the text of each, of successive blocks."""
    before, before_owner = None, -1
    for data, first, bounds, _ in tokens.cuts(texts):
        inner, mark = ~tokens._SPACE[data], _MARKS[data]
        new = inner.copy()
        new[1:] &= (mark[1:] != mark[:-1]) | ~inner[:-1]
        last = inner
        last[:-1] &= ~inner[1:] | new[1:]
        starts, ends = np.flatnonzero(new), np.flatnonzero(last) + 1
        if not len(starts):
            continue
        hashes, owner = tokens.hash_spans(tokens._VALUES[data], starts, ends), first + np.searchsorted(bounds, starts, "right")
        every, owners = (hashes, owner) if before is None else (np.append(before, hashes), np.append(before_owner, owner))
        with np.errstate(over="ignore"):
            pairs = tokens.mix(every[:-1] * np.uint64(3) + every[1:])
        pairs[every[:-1] == every[1:]] = _AGAIN
        inside = owners[:-1] == owners[1:]
        yield (np.concatenate((hashes, pairs[inside])) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate((owner, owners[:-1][inside]))
        before, before_owner = hashes[-1], owner[-1]


@gives_back
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for buckets, _ in grams(batch.column("text")):
            total += np.bincount(buckets, minlength=BUCKETS)
    there = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["bucket", "n"])


def ngram_counts(texts: DataFrame) -> np.ndarray:
    """Counts of all buckets: at most BUCKETS rows from each task, and to the driver."""
    out = np.zeros(BUCKETS)
    for r in texts.select("text").mapInArrow(_count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log ratio of the models, bucket by bucket, to 24 binary places: sums of them are exact in any order."""
    if not target.sum():
        return np.zeros(len(raw))
    ratio = np.log((target + SMOOTH) / (target.sum() * raw / raw.sum() + SMOOTH))
    return np.round(ratio * (1 << 24)) / (1 << 24)


def _weigh(ratio: np.ndarray):
    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = np.zeros(len(batch))
            for buckets, owner in grams(batch.column("text")):
                weights += np.bincount(owner, ratio[buckets], len(batch))
            yield batch.append_column("_tl_weight", pa.array(weights))

    return run


def weighed(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """docs (with a column text) and _tl_weight, the log importance weight."""
    return docs.mapInArrow(_weigh(ratio), StructType([*docs.schema.fields, StructField("_tl_weight", DoubleType())]))


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Standard Gumbel noise that the id and the seed decide."""
    u = (F.xxhash64(F.lit(seed), doc_id).bitwiseAND(F.lit((1 << 52) - 1)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(-F.log(u))


def cut_of(keys: DataFrame, k: int) -> int:
    """The k-th greatest of the column `_tl_fixed` (whole numbers from 0 to 2^62), or 0 if there are fewer."""
    prefix, left = 0, k
    for shift in range(WHOLE + POINT + 2 - DIGIT, -1, -DIGIT):
        own = keys.where(F.shiftright("_tl_fixed", shift + DIGIT) == prefix) if shift + DIGIT < 64 else keys
        counts = sorted(((r.digit, r["count"]) for r in own.groupBy(F.shiftright("_tl_fixed", shift).alias("digit")).count().collect()), reverse=True)
        for digit, n in counts:
            if n >= left:
                prefix = digit
                break
            left -= n
        else:
            return 0
    return prefix


def passing(weight, threshold: float):
    """The chance that a weight plus Gumbel noise reaches the threshold (numbers, or a Column)."""
    if isinstance(weight, Column):
        return 1 - F.exp(-F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), weight - F.lit(threshold)))))
    return -np.expm1(-np.exp(np.clip(np.asarray(weight) - threshold, -700, 700)))


def threshold_of(held: np.ndarray, keep: float = KEEP) -> float:
    """The threshold that a share `keep` of these weights is expected to pass, by bisection."""
    low, high = float(np.min(held)) - 60, float(np.max(held)) + 60
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if passing(held, middle).mean() >= keep else (low, middle)
    return low


def models(docs: DataFrame, labels: DataFrame, at: str) -> tuple[np.ndarray, np.ndarray]:
    """The log ratios of all buckets, and the weights of the held-back good documents, each by the other half's model."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = written(known.orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id").limit(LABELS).select(F.col("doc_id").alias("_tl_id"), F.col("quality").alias("_tl_quality"), (F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(2)) == 0).alias("_tl_fit")), f"{at}/labels")
    good = F.broadcast(sample.where("_tl_quality = 1"))  # LABELS rows at most
    shown = written(docs.select("doc_id", "text").join(good, F.col("doc_id") == F.col("_tl_id")).select("text", "_tl_fit"), f"{at}/good")
    halves = [shown.where("_tl_fit"), shown.where("NOT _tl_fit")]
    counts, raw = [ngram_counts(half) for half in halves], ngram_counts(docs)
    held = [r[0] for half, other in zip(halves, reversed(counts), strict=True) if other.sum() for r in weighed(half.select("text"), log_ratio(other, raw)).select("_tl_weight").collect()]
    return log_ratio(counts[0] + counts[1], raw), np.array(held)


def _drawn(rows: DataFrame, held: np.ndarray, k: int | None, keep: float, seed: int) -> DataFrame:
    """The rows of a written table (doc_id, _tl_weight and others) that Gumbel top-k draws, with _tl_key."""
    keys = rows.withColumn("_tl_key", F.col("_tl_weight") + gumbel(F.col("doc_id"), seed))
    if k is None:
        if not len(held):
            return keys
        # As decimals, the chances add up to the same in any order.
        share = passing(F.col("_tl_weight"), threshold_of(held, keep)).cast("decimal(28,12)")
        k = round(rows.agg(F.coalesce(F.sum(share), F.lit(0))).first()[0])
    if k <= 0:
        return keys.limit(0)
    # Fixed point: keys are compared as whole numbers, exactly and alike everywhere.
    fixed = F.greatest(F.lit(0), F.least(F.lit((1 << WHOLE + POINT) - 1), F.floor((F.col("_tl_key") + F.lit(float(1 << WHOLE - 1))) * F.lit(float(1 << POINT))))).cast("bigint")
    keys = keys.withColumn("_tl_fixed", fixed)
    return keys.where(F.col("_tl_fixed") >= cut_of(keys, k)).drop("_tl_fixed")


def resampled(docs: DataFrame, labels: DataFrame, k: int | None = None, keep: float = KEEP, seed: int = SEED) -> DataFrame:
    """doc_id, log_weight and key of each row of docs that the resampling draws."""
    at = work_dir(docs.sparkSession, "quality")
    ratio, held = models(docs, labels, at)
    rows = written(weighed(docs.select("doc_id", "text"), ratio).drop("text"), f"{at}/weights")
    return _drawn(rows, held, k, keep, seed).select("doc_id", F.col("_tl_weight").alias("log_weight"), F.col("_tl_key").alias("key"))


def keep_good(docs: DataFrame, labels: DataFrame, k: int | None = None, keep: float = KEEP, seed: int = SEED) -> DataFrame:
    """The rows of docs that the resampling draws, whole."""
    at = work_dir(docs.sparkSession, "quality")
    ratio, held = models(docs, labels, at)
    return _drawn(written(weighed(docs, ratio), f"{at}/weighed"), held, k, keep, seed).select(*docs.columns)
