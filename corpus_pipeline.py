"""A training corpus from documents, in stages: each is a query of its own whose rows are written as Parquet and reread by the next.

``run`` keeps the stages' tables in the folder that driver and executors share, so a lost
executor costs no more than the tasks it ran. SQL can't express the learned first stage, so
there is none for the whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, line_dedup, mixing, near_dedup, toxicity
from tessera.llm._common import stored

STAGES = [
    ("toxicity", toxicity.stage),
    ("line_dedup", line_dedup.stage),
    ("near_dedup", near_dedup.stage),
    ("mixing", mixing.stage),
    ("bpe", bpe.stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir: doc_id, n_tokens, ids_sha256, decoded_sha256 and ids for each copy that the mix takes.

    Null and empty texts are clean and, as they are alike, one of them passes the near-duplicates; having no words it is taken no time. Ties,
    repeated rows and columns of other names are as the stages state. No documents make no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
