"""From raw documents to token files: five stages, each on all that the one before it kept.

A stage's result is written as Parquet and read again by the next, which then removes what its
predecessor had put aside in the shared folder.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskfeat.llm import decontaminate, jaccard, language, mixing, quality, token_files
from riskfeat.llm.base import load
from riskfeat.llm.plans import tokenizer_file
from riskfeat.runtime import drop_folder, new_folders, shared_folder

#: SQL cannot express the classifier and the tokenizer; tests/llm compares the stages with plain versions.
ORACLE_SQL = None

#: Portions in which texts pass to Python and back.  Five stages share the executors, whose Python processes keep the
#: memory of the largest portion they have seen.
PORTIONS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "250", "spark.sql.execution.arrow.maxBytesPerBatch": "2m"}

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_put_aside: list[str] = []


def _tidy(stage: Stage) -> Stage:
    """Remove what the stage before has put aside: its result is in files of its own by now.

    What the last stage returns is read from the token files, so these stay.
    """

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _put_aside:
            drop_folder(spark, _put_aside.pop())
        before = len(new_folders())
        out = stage(spark, docs, sf_dir)
        if stage.__name__ != "write_tokens":
            _put_aside.extend(new_folders(before))
        return out

    return run_stage


@_tidy
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    A null or empty text is scored like any other; equal texts stay or go together, repeated rows each; an empty
    table stays empty.
    """
    return quality.accepted(docs, load(spark, sf_dir, "labels"), language.held_out(0, 5))


@_tidy
def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near copies.

    Rows without id give way to any other; rows that share an id are judged by their own texts; texts without words
    are copies of nothing; of rows with the same id and text one stays.
    """
    return jaccard.one_of_each(docs)


@_tidy
def drop_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no phrase of a benchmark item occurs; a null or empty text holds none, repeated
    rows are judged alike, and without items all documents stay."""
    return decontaminate.clean(docs, load(spark, sf_dir, "benchmark"))


@_tidy
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it.

    A null source is a source, the last in order; texts without words weigh nothing; rows with the same id are
    drawn alike.
    """
    return mixing.emit(docs)


@_tidy
def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and what they hold of each document: doc_id, start, n_tokens, ids_crc32.

    A null or empty text is its end mark alone; copies and rows with the same id follow each other; an empty table
    gives no rows.
    """
    path = f"{shared_folder(spark, 'token-files')}/orc"
    token_files.write(docs, path, tokenizer_file())
    return token_files.digests(token_files.read(spark, path))


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", keep_good),
    ("near_copies", keep_one_of_near_copies),
    ("decontamination", drop_test_items),
    ("source_mix", mix_sources),
    ("token_files", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    for name, value in PORTIONS.items():
        spark.conf.set(name, value)
    docs = load(spark, sf_dir, "documents")
    folder = shared_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.schema(docs.schema).parquet(f"{folder}/{name}")
        if 0 < k < len(STAGES) - 1:
            drop_folder(spark, f"{folder}/{STAGES[k - 1][0]}")
    return docs
