"""The corpus pipeline: quality classifier, quality rules, line dedup, near-dedup, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's documents. Stages have no SQL twin (tokenizers, a fitted model, hashes), so
each is tested against a brute-force version in `tests/llm`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tractlens.llm import fertility, gam, linededup, minhash, packing
from tractlens.session import scratch_folder


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, with their ids, in sequences along the curve."""
    return packing.packed(docs, packing.byte_bpe_path())


STAGES = [
    ("quality classifier", gam.stage),
    ("quality rules", fertility.stage),
    ("line dedup", linededup.stage),
    ("near-dedup", minhash.stage),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        folder = scratch_folder(spark, name.replace(" ", "_"))
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
