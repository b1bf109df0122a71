"""The queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import collocations, url_filter
from tessella.llm.common import default_tokenizer, small_batches
from tessella.llm.common import table as _table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return _table(spark, sf_dir, name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.packing import packed_pieces

    return packed_pieces(table(spark, sf_dir, "documents"), default_tokenizer("word_bpe_49k.json"), 1)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.simhash import simhash_components

    return simhash_components(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.toxicity import toxicity_report

    return toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.wavelet import tokens_read_back

    return tokens_read_back(table(spark, sf_dir, "documents"), default_tokenizer("byte_bpe_50k.json"), 2)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the quality label of the document with its number, where there is one."""
    from pyspark.sql import functions as F

    from tessella.llm.url_filter import RULES, url_verdicts

    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("outcome"))
    return url_verdicts(table(spark, sf_dir, "pages").select("page_id", "url"), outcomes, RULES)


def op7_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessella.llm.prefix_bpe import token_digests

    return token_digests(table(spark, sf_dir, "documents"), default_tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.fingerprint import fingerprint_report

    return fingerprint_report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.suffix_dedup import removal_report

    return removal_report(table(spark, sf_dir, "documents"), plain_scan=True)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), default_tokenizer("piece_bpe_32k.model"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.repair import damaged, repair_report

    return repair_report(damaged(table(spark, sf_dir, "conversations")), present_col="present")


def op12_stream_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.stream_bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), default_tokenizer("byte_bpe_50k.json"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_simhash": op2_simhash,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_wavelet": op5_wavelet,
    "op6_url_filter": op6_url_filter,
    "op7_prefix_bpe": op7_prefix_bpe,
    "op8_fingerprints": op8_fingerprints,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_token_counts": op10_token_counts,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_stream_bpe": op12_stream_bpe,
    "op13_collocations": op13_collocations,
}

OP3 = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t.norm) AS text_sha256 FROM t JOIN g ON t.norm = g.norm
"""

ORACLE_SQL: dict[str, str] = {"op3_exact_dedup": OP3, "op6_url_filter": url_filter.ORACLE, "op13_collocations": collocations.ORACLE}
