"""A training corpus from ``documents``: each stage is written as Parquet and read again as the next one's input.

Every stage decides on all rows that its predecessor kept.  All but the last
return the columns of ``documents``.

Null texts count as empty and stay null.  Of equal texts, null and empty ones
alike, one row stays: exact dedup keeps that with the largest id, or one with a
null id only where all are null.  Rows of the same id and text are copies of each
other.  Very long texts are treated whole in every stage.  Extra columns are
handed through, whatever their names, up to packing, which doesn't read them.
An empty table gives no rows.

A stage's result is to be written before the next stage is called on what was
written: the tables that it reads go then, so that disk holds those of one stage.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import default_tokenizer, fresh, let_go, made_before, new_path, remove, small_batches, staying, table
from tessella.llm.exact_dedup import without_copies
from tessella.llm.near_copies import without_similar
from tessella.llm.packing import packed_pieces
from tessella.llm.suffix_dedup import suffix_dedup
from tessella.llm.toxicity import learnt_scores
from tessella.session import ship

#: Documents with at least this toxicity score go.
TOXIC = 0.3
#: Bytes of a worker's pre-tokens in packing: executors have grown by the stages before.
WORD_BYTES = 24_000_000


#: By application, the tables that the results of its stages read.
_LEFT: dict[str, list[str]] = {}


def _stage(f):
    """Before ``f``, delete what earlier stages left, where its input was written after that; note what it leaves itself."""

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        small_batches(spark)
        left = _LEFT.setdefault(spark.sparkContext.applicationId, [])
        for path in made_before(left, docs):
            remove(spark, path)
            left.remove(path)
        let_go(spark)
        with staying() as paths:
            out = f(spark, docs, sf_dir)
        left += paths
        return out

    return run


@_stage
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labelled ones that aren't held out."""
    scored = learnt_scores(docs, table(spark, sf_dir, "labels"))
    return scored.filter(F.col(scored.columns[-1]) < TOXIC).select(*docs.columns)


@_stage
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return without_copies(docs)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are linked at a five-word similarity of 0.8; of each group the document with the least id stays."""
    return without_similar(docs)


@_stage
def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that a document of smaller id has are taken out; a text that is then blank goes."""
    null = fresh(docs, "__null")
    out = suffix_dedup(docs.withColumn(null, F.col("text").isNull()), as_text=True)
    removed, left = F.col(out.columns[-3]), F.col(out.columns[-1])
    out = out.filter((removed == 0) | left.rlike(r"[^\x20\x09-\x0D]"))
    kept = {"text": F.when(~F.col(null), left), "n_chars": F.when(removed > 0, F.char_length(left).cast("long")).otherwise(F.col("n_chars"))}
    return out.select(*[kept[c].alias(c) if c in kept else F.col(c) for c in docs.columns])


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return packed_pieces(docs, default_tokenizer("word_bpe_49k.json"), 1, word_bytes=WORD_BYTES)


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact_dedup),
    ("near-dedup", near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("packing", packing),
]

#: SQL can express neither the classifier nor the tokenizer.  Exact dedup, near-dedup, the suffix stage and packing are held against brute force in the tests, toxicity against planted words.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        path = new_path(spark, "stage")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:  # nothing reads the stage's input any more
            remove(spark, before)
        before = path
    return docs
