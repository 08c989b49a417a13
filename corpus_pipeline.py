"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns the
columns of documents; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixframe.llm import bagminhash, langid, mixing, packing, secrets
from helixframe.llm.common import cut, table

STAGES = [
    ("language id", langid.stage),
    ("minhash near-dedup", bagminhash.stage),
    ("secret scan", secrets.stage),
    ("source mixing", mixing.stage),
    ("best-fit packing", packing.stage),
]

#: Language models and MinHash groups are not expressible in SQL; tests/llm compares stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
