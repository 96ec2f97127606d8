"""The corpus pipeline: documents in, the clean and tokenised corpus out.

Every stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a DataFrame that is written as Parquet
and read again for the next one.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm import bpe, decontaminate, jaccard, pii, quality_rules
from tracefold.llm.common import table
from tracefold.session import discard, materialize, recorded, release_shuffles, remove, tune


_made: list[str] = []


def stage(fn):
    """A stage that first deletes the tables the stage before it needed: its result has been written and read again."""
    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        remove(spark, _made)
        _made.clear()
        release_shuffles(spark)
        with recorded() as made:
            result = fn(spark, docs, sf_dir)
        _made.extend(made)
        return result
    return run_stage


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, similarity 0.8 or more."""
    return jaccard.keep_one(docs, words=5, percent=80)


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


@stage
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars follows the new text."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


@stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with n_tokens, token_ids and decoded_text."""
    return bpe.encode(docs, forget=True)


STAGES = [("quality_rules", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("personal_data", personal_data), ("tokens", tokens)]

#: Outlier estimates, trees and BPE merges have no SQL form; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, one in STAGES[:-1]:
        after = materialize(one(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        docs = before = after
    return STAGES[-1][1](spark, docs, sf_dir)
