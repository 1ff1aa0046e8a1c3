"""The corpus pipeline: quality rules, line dedup, near-duplicate dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's docs.

Defined results: texts that are null, empty or without words are rejected by the quality rules, as is
what each stage's own module says; repeated rows and rows of equal id and text count as copies,
of which one stays; null ids are kept like others; very long texts are worked through whole;
ties fall as each stage's module says; an empty table gives no windows.  Extra columns, whatever their
names, pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vexel.llm.common import read, scratch
from vexel.llm.decontaminate import decontaminate_stage
from vexel.llm.line_dedup import line_dedup_stage
from vexel.llm.near_dedup import near_dedup_stage
from vexel.llm.packing import packing_stage
from vexel.llm.quality import quality_stage

STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontaminate_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the estimates nor the clusters nor the edit distances; the tests hold each stage against brute force on what the stage before kept.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of the documents that pass all stages."""
    docs = read(spark, sf_dir, "documents")
    base = scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
