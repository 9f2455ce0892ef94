"""The corpus pipeline: a list of stages, each one operator of the llm subpackage applied to what its predecessor kept.

Edge cases: a document whose text is null, empty or has under 20 words fails the quality rules' limits and goes; of repeated rows, the
near-dedup stage keeps one; a null id or source is a value like any other; a label of a document that is not there
changes nothing, and without labels the fixed limits alone decide; columns beyond those of ``documents`` pass all stages but the last
untouched, whatever their names; empty tables give an empty result with the same columns. Very long texts are cut by the last stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recvfund.llm import mixing, packing, quality, secret_scans, simhash
from recvfund.llm.common import table
from recvfund.session import work_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the fixed limits or look anomalous go."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return simhash.deduplicated(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; all documents stay."""
    return secret_scans.without_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix takes it; a document at a budget's end stays whole."""
    return mixing.mixed(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their texts, in bins without conflicts."""
    return packing.pack(docs, with_text=True)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_near_dedup),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", best_fit_packing),
]
#: A forest learned from labels and 64-bit hashes that DuckDB lacks: not SQL. Tested against plain versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    base = work_dir(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
    return docs
