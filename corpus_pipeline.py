"""Corpus pipeline: language ID, near duplicates, decontamination, secrets, pieces.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame.  ``run`` writes each stage's result as parquet into the shared folder of
``spark.checkpoint.dir`` and rereads it as the next stage's documents, so a lost
executor never costs more than the running stage.  All stages but the last return the
columns of ``documents``; the last adds the piece ids.

``ORACLE_SQL`` is None: SQL cannot express the trained stages; the tests hold the
pipeline against brute-force versions instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recordaudit.llm import common, decontam, langid, neardup, pieces, secrets

STAGES = [
    ("language_id", langid.stage_language),
    ("near_duplicates", neardup.stage_near_duplicates),
    ("decontamination", decontam.stage_decontamination),
    ("secrets", secrets.stage_secrets),
    ("sentencepiece", pieces.stage_pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last one."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
