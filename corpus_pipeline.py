"""A corpus pipeline of five stages: rules, boilerplate, near copies, benchmark leaks, pieces.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; what it returns is written as Parquet
and read again. All but the last return the columns of ``documents``; the last adds ``piece_ids`` and ``n_pieces``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from segloom.llm import decontaminate, line_dedup, piece_coding, quality_rules, simhash
from segloom.llm.common import table

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("line_dedup", line_dedup.stage),
    ("simhash", simhash.stage),
    ("decontaminate", decontaminate.stage),
    ("piece_coding", piece_coding.stage),
]

#: SQL has neither SimHash nor piece coding; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir))
    return docs
