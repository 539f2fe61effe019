"""The corpus pipeline: documents in, packed pieces out. Each stage is one operator of ``fleetlens.llm``."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from fleetlens.llm import op1_simhash, op3_decontaminate, op6_pack, op9_secrets, op10_quality
from fleetlens.llm.common import staged
from fleetlens.session import configure


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects."""
    return op10_quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: shingles of five words, similarity 0.8 or more."""
    return op1_simhash.keep_one(docs, shingle=5, similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item, however short."""
    return op3_decontaminate.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), short=True)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts and keeps every document."""
    return op9_secrets.redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 ids, one row per piece."""
    return op6_pack.piece_digests(docs)


STAGES = [("quality classifier", quality), ("SimHash near-dedup", near_dedup),
          ("benchmark decontamination", decontaminate), ("secret scans", secrets), ("packing", packing)]

#: SimHash, token ids and the spans of secrets can't be expressed in SQL; a brute-force version is in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each written and read again before the next."""
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    done = reduce(lambda d, stage: staged(stage[1](spark, d, sf_dir), "stage"), STAGES[:-1], docs)
    return STAGES[-1][1](spark, done, sf_dir)
