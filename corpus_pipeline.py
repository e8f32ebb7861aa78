"""A training corpus from raw documents, in stages that each read what the one before has written."""

from __future__ import annotations

from siltstone.llm import stages
from siltstone.llm.common import written

#: (name, function of spark, documents and the folder of the tables); all but the last return columns of documents.
STAGES = [
    ("quality classifier", stages.trusted_style),
    ("line dedup", stages.first_lines),
    ("n-gram Jaccard join", stages.one_of_each),
    ("benchmark decontamination", stages.unseen_benchmark),
    ("best-fit packing", stages.sequences),
]

#: None: the stages' models and tokens are not expressible in SQL; tests/llm holds them against plain versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Packed sequences of all documents under ``sf_dir`` that the stages keep."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, "stage")
    return docs
