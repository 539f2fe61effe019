"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import configure
from . import (op1_simhash, op2_language, op3_decontaminate, op4_syncmers, op5_url_filters, op6_pack, op7_substrings,
               op8_warc, op9_secrets, op10_quality, op11_chat, op12_runs, op13_spelling)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(_table(spark, sf_dir, "documents"))


QUERIES["op1_simhash_near_dedup"] = _documents(op1_simhash.classes)
QUERIES["op3_benchmark_decontamination"] = lambda spark, sf_dir: op3_decontaminate.leaks(
    _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
ORACLES["op3_benchmark_decontamination"] = op3_decontaminate.ORACLE_SQL
QUERIES["op6_packing"] = _documents(op6_pack.piece_digests)
QUERIES["op9_secret_scans"] = _documents(op9_secrets.span_digests)
QUERIES["op10_quality_classifier"] = lambda spark, sf_dir: op10_quality.scores(
    _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
ORACLES["op10_quality_classifier"] = op10_quality.ORACLE_SQL
QUERIES["op2_language_id"] = _documents(op2_language.predictions)
QUERIES["op4_document_fingerprints"] = _documents(op4_syncmers.compare_next)
QUERIES["op5_url_filters"] = lambda spark, sf_dir: op5_url_filters.verdicts(_table(spark, sf_dir, "pages"))
ORACLES["op5_url_filters"] = op5_url_filters.ORACLE_SQL
QUERIES["op7_substring_dedup"] = _documents(op7_substrings.removals)
ORACLES["op7_substring_dedup"] = op7_substrings.ORACLE_SQL
QUERIES["op8_warc"] = lambda spark, sf_dir: op8_warc.round_trip(_table(spark, sf_dir, "pages"))
ORACLES["op8_warc"] = op8_warc.ORACLE_SQL
QUERIES["op11_chat_formatting"] = lambda spark, sf_dir: op11_chat.formatted(_table(spark, sf_dir, "conversations"))
ORACLES["op11_chat_formatting"] = op11_chat.ORACLE_SQL
QUERIES["op12_periodic_runs"] = _documents(op12_runs.run_digests)
QUERIES["op13_spelling_variants"] = _documents(op13_spelling.forms)
