"""The corpus pipeline: quality, near-duplicates, benchmark passages, secrets, packing, in this order.

Defined results: stages that drop documents judge row by row, so null and repeated ids neither save nor doom other rows;
null and empty texts are kept (they hold no n-grams, words, windows or secrets) and packed as one end token each; repeated
rows are copies, of which the first stays; empty tables give empty tables; other columns pass through all stages but the
last, whatever their names (those of the stages begin with _tl_)."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracelake.llm import decontamination, near_dedup, packing, quality, secrets
from tracelake.llm._shared import made_folders, remove, table, work_dir
from tracelake.llm.queries import vocabulary


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: The folders that the last stage wrote on its way.
_left: list[str] = []


def _tidy(stage: Stage) -> Stage:
    """The stage, which first removes what the stage before it wrote on its way.

    By the pipeline's contract a stage's result is written before the next stage begins: nobody needs those folders then."""

    @functools.wraps(stage)
    def tidied(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        remove(spark, _left)
        before = set(made_folders())
        out = stage(spark, docs, sf_dir)
        _left[:] = [path for path in made_folders() if path not in before]
        return out

    return tidied


@_tidy
def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling draws; the others go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


@_tidy
def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: five-word shingles, a similarity of 0.8 or more."""
    return near_dedup.deduplicated(docs)


@_tidy
def without_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


@_tidy
def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a mark."""
    return secrets.redact(docs)


@_tidy
def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    return packing.packed(docs, vocabulary())


STAGES = [
    ("quality classifier", good_documents),
    ("near-duplicates", without_near_duplicates),
    ("benchmark decontamination", without_benchmark_passages),
    ("secret scans", without_secrets),
    ("best-fit packing", packed_sequences),
]

#: Hashed models, signatures and the tokenizer have no SQL form; tests hold the stages against plain ones.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    at = work_dir(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{at}/{number}")
        docs = spark.read.parquet(f"{at}/{number}")
    remove(spark, _left)
    _left.clear()
    return docs
