"""Exact deduplication with a heavy-hitter split.

Rows are grouped by the SHA-256 of their normalised text (A-Z lower-cased).
Misra-Gries summaries, one for each task, find every digest that can hold more
than a share of 1/k of all rows; an exact count verifies them.  The winners, k
at most, are broadcast and settle their rows on the map side, so that a digest
held by a third of all rows is never shuffled; the others are grouped by an
ordinary shuffle of digests, never of texts.

Of equal texts the row with the largest doc_id stays; a null doc_id is smaller
than any other, and of rows with equal doc_ids the last in scan order stays.
Null and empty texts are equal.  A very long text is hashed as a whole, like any
other.  An empty table gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import binary, column, fresh, id_and_text, if_small, kept, numbered, written

#: Counters of a summary, and so the most digests that are broadcast.
COUNTERS = 512

#: Candidates, k for each task at most, that are broadcast to be counted; beyond that they are joined by a shuffle.
MOST_CANDIDATES = 200_000

DIGESTS = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("digest", pa.binary())])
SUMMARY = pa.schema([("digest", pa.binary())])


def _digests(batches):
    kept("exact_dedup")
    for batch in batches:
        out = [hashlib.sha256(x.lower()).digest() for x in binary(batch, "text")]  # bytes.lower: A-Z alone
        yield pa.RecordBatch.from_arrays([column(batch, "row"), column(batch, "id"), pa.array(out, pa.binary())], schema=DIGESTS)


def misra_gries(counts: dict[bytes, int], values: list[bytes], k: int) -> dict[bytes, int]:
    """Add values to a summary of k counters: whatever fills more than 1/(k+1) of all values has one in the end."""
    for v in values:
        if v in counts:
            counts[v] += 1
        elif len(counts) < k:
            counts[v] = 1
        else:
            for x in [x for x, n in counts.items() if n == 1]:
                del counts[x]
            for x in counts:
                counts[x] -= 1
    return counts


def _summaries(k: int):
    def run(batches):
        counts: dict[bytes, int] = {}
        for batch in batches:
            misra_gries(counts, column(batch, "digest").to_pylist(), k)
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary())], schema=SUMMARY)

    return run


def frequent_digests(digests: DataFrame, k: int = COUNTERS) -> list:
    """The digests, k at most, with at least 1/k of all rows, as rows (digest, top, n), counted exactly."""
    total = digests.count()
    if not total:
        return []
    candidates = written(digests.select("digest").mapInArrow(_summaries(k), "digest binary").distinct(), "candidates")
    if candidates.count() <= MOST_CANDIDATES:
        candidates = F.broadcast(candidates)
    counted = digests.join(candidates, "digest", "left_semi").groupBy("digest").agg(F.max(_order()).alias("top"), F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") * k >= total).filter(F.col("n") > 1).collect()


def _order():
    """What decides which row of a group stays, by its maximum."""
    return F.struct(F.coalesce(F.col("id"), F.lit(-(2**63))).alias("o"), F.col("row").alias("row"), F.col("id").alias("id"))


def exact_groups(rows: DataFrame, k: int = COUNTERS) -> DataFrame:
    """Columns row, id and text to row, id, digest, keep_id, keep_row, n: one row for each, dropped ones too."""
    spark = rows.sparkSession
    digests = written(rows.mapInArrow(_digests, "row long, id long, digest binary"), "digests")
    heavy = spark.createDataFrame(frequent_digests(digests, k), "digest binary, top struct<o: bigint, row: bigint, id: bigint>, n bigint")
    heavy = F.broadcast(heavy)  # k rows of 60 bytes at most
    settled = digests.join(heavy, "digest")
    others = digests.join(heavy, "digest", "left_anti")
    tops = others.groupBy("digest").agg(F.max(_order()).alias("top"), F.count(F.lit(1)).alias("n"))  # summed up before the shuffle
    others = others.join(tops, "digest")
    return settled.unionByName(others).select("row", "id", "digest", F.col("top.id").alias("keep_id"), F.col("top.row").alias("keep_row"), "n")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = COUNTERS) -> DataFrame:
    """A row for each document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = id_and_text(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    return exact_groups(rows, k).select(
        F.col("id").alias("doc_id"), "keep_id", F.col("n").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever ``docs`` is made of."""
    row = fresh(docs, "__row")
    all_rows = numbered(docs, row)
    rows = all_rows.select(F.col(row).alias("row"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    goes = written(exact_groups(rows, k).filter(F.col("row") != F.col("keep_row")).select(F.col("row").alias(row)), "goes")
    return all_rows.join(if_small(goes), row, "left_anti").select(*docs.columns)
