"""The corpus pipeline: filtering, line dedup, near-duplicate removal, mixing and packing of documents.

Each stage takes (spark, docs, folder) and returns a DataFrame, which is written as Parquet in the shared folder
and read again as the next stage's documents.  The first four return the columns of documents; the last returns
the packed pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from wonted.llm import line_dedup, mixing, near_dup, packing, quality
from wonted.session import work_folder

STAGES = [
    ("quality", quality.stage),
    ("line_dedup", line_dedup.stage),
    ("near_dup", near_dup.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]

#: A trained classifier and random rounding have no SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{work_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        place = f"{base}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    return docs
