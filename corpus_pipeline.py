"""The corpus pipeline: language ID, near duplicates, decontamination, PII and BPE over documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from skein.llm import _text, bpe, decontam, jaccard, langid, pii

#: Each function takes (spark, docs, sf_dir); what it returns is written and read again as the next one's docs.
STAGES = [
    ("language_id", langid.stage),
    ("ngram_jaccard", jaccard.stage),
    ("decontamination", decontam.stage),
    ("pii", pii.stage),
    ("bpe", bpe.stage),
]

#: The stages are trained models, a sketch join and a tokenizer, which SQL can't express; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens of the documents that the stages leave.

    The tables between the stages go to a folder of their own in the shared
    checkpoint folder, so a lost executor never costs more than a stage.
    """
    _text.checkpoint_dir(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
