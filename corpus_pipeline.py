"""A corpus pipeline of five of the operators: documents in, the mix of what is kept out.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the columns
of documents. run() writes each stage's rows to the folder that the cluster shares and reads them again for the next.

Edge cases: a null or empty text is scored like any other by the classifier, is no copy of anything, has no benchmark
words and no personal data, and is never taken by the mix, so it is not in the result; rows with equal doc_id are separate
documents, but of near copies one row stays, repeated rows included; a null source is a source of its own; columns beside
those of documents, whatever their names, go through all stages but the last; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivel.llm import decontaminate, minhash, mixing, pii_semicrf, quality_fm
from scrivel.llm.common import Workspace, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects."""
    return quality_fm.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest doc_id."""
    return minhash.without_copies(docs, k=2)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out of texts, and drops texts that are little else."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in texts."""
    return pii_semicrf.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str, mix_path: str | None = None) -> DataFrame:
    """Writes the mix's shards and texts to mix_path, or to the shared folder, and returns how many words of each document
    they hold; documents that the mix doesn't take at all go."""
    return mixing.mix(docs, mix_path).where(F.col("taken") > 0)


STAGES = [
    ("quality classifier", quality),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("personal data", personal_data),
    ("mixing", mixture),
]

#: a factorisation machine and a random field can't be expressed in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, mix_path: str | None = None) -> DataFrame:
    space = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = space.write(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            space.drop(f"stage{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir, mix_path)
