"""A corpus pipeline of five stages, each of which calls one operator of ``opsloom.llm``.

Every stage works on all that the one before kept; between stages the documents are written as Parquet and read again,
so a lost executor costs one stage's tasks at most. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from opsloom.llm.bpe import encode_stage
from opsloom.llm.common import table, written
from opsloom.llm.jaccard import keep_one
from opsloom.llm.langid import reject_unknown
from opsloom.llm.mixing import mix_stage
from opsloom.llm.secrets import redact

STAGES = [
    ("language ID", reject_unknown),
    ("n-gram Jaccard join", keep_one),
    ("secret scans", redact),
    ("mixing sources to target weights", mix_stage),
    ("BPE encoding and decoding", encode_stage),
]

#: The language model, the randomness battery and the encoder have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The encoded corpus: doc_id, n_tokens, ids, decoded."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
