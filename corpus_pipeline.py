"""The corpus pipeline: stages over `documents`, each written as Parquet and read again by the next.

Quality rules drop what the base rule or the learned decision list rejects; SimHash near-dedup keeps one document of
each component of five-word Jaccard similarity 0.8 or more; decontamination drops documents that hold a benchmark item;
mixing takes words of each source towards its target (a document comes once for each pass over its source that takes
words of it, in the order of the mix); token ids are written as Simple-8b files and read back. No stage can be said in SQL as a whole; tests/llm
recomputes near-dedup, decontamination, the mix by source and token ids in plain Python, and holds the quality stage against operator 6's own verdicts.

Null texts, ids and sources, empty and very long texts, ties, repeated rows and columns of clashing names go through as each operator says;
an empty table gives an empty result; a row without a source is of a source of its own.

A stage's result reads tables in a work folder of the stage's own. It must be written before the next stage begins, as
run() does: then the folder is cleared, so that no more than one stage's tables are on disk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wardflow.llm import decontaminate, mixing, near_dedup as near_copies, quality_rules, token_ids
from wardflow.llm._util import Workspace
from wardflow.llm.queries import tokenizer_file


_open: list[Workspace] = []


def _fresh(spark: SparkSession) -> Workspace:
    """A work folder for the stage that begins; those of earlier stages are cleared."""
    while _open:
        _open.pop().clear()
    _open.append(Workspace(spark))
    return _open[0]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), _fresh(spark))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.one_of_each(docs, _fresh(spark))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _fresh(spark)
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs, _fresh(spark))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_ids.read_ids(token_ids.write_ids(docs, tokenizer_file(), _fresh(spark)))


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixture), ("token_ids", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs, space = spark.read.parquet(f"{sf_dir}/documents.parquet"), Workspace(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = space.save(stage(spark, docs, sf_dir), name)
        if k:
            space.drop(STAGES[k - 1][0])
    _fresh(spark)
    return docs
