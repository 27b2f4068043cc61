"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import annsearch, decontaminate, exactdedup, htmltext, language, linededup, merkle, neardup, packing, prefixtrie, quality, secretscan, warc
from docloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    groups = neardup.grouped(table(spark, sf_dir, "documents"), width=3, radius=2)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of the secrets in every whole text."""
    return secretscan.digest(secretscan.scan(table(spark, sf_dir, "documents")))


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without the lines of repeated three-line windows."""
    cleaned = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "lines_total", "lines_removed", "text")


ORACLE_SQL["op1_secret_scan"] = secretscan.ORACLE_SQL
ORACLE_SQL["op3_line_dedup"] = linededup.ORACLE_SQL


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence of at most 2048 tokens."""
    return packing.packed_pieces(table(spark, sf_dir, "documents"))


@query
def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item and how they overlap."""
    found = decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_hash")


@query
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every whole text."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text."""
    return language.identify(table(spark, sf_dir, "documents"))


@query
def op10_permutation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors found for every vector whose id is divisible by 50."""
    return annsearch.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, written to archives and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


ORACLE_SQL["op6_warc_round_trip"] = warc.ORACLE_SQL


@query
def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every whole page."""
    return htmltext.extract(table(spark, sf_dir, "pages"))


@query
def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one of its equal texts that stays."""
    return exactdedup.digest(exactdedup.deduplicated(spark, f"{sf_dir}/documents.parquet"))


ORACLE_SQL["op12_exact_dedup"] = exactdedup.ORACLE_SQL


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, proof and folded root in the Merkle manifest of the table."""
    return merkle.digest(merkle.document_manifest(table(spark, sf_dir, "documents")))


ORACLE_SQL["op13_merkle_manifest"] = merkle.ORACLE_SQL


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all conversations' turns."""
    return prefixtrie.digest(prefixtrie.nodes(table(spark, sf_dir, "conversations")))


ORACLE_SQL["op11_prefix_trie"] = prefixtrie.ORACLE_SQL
