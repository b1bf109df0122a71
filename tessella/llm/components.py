"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import new_path, remove, write

EDGES = "a long, b long"


def _large(edges: DataFrame) -> DataFrame:
    """Each node points its larger neighbours at its least neighbour or itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node points its smaller neighbours and itself at the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """Columns a, b (long) to node, root: every node of an edge whose component's least node isn't itself.

    Each round's edges are a written table, so nothing is recomputed from the
    start when an executor is lost.  A node with very many neighbours meets
    only sums and joins, never a collected list.
    """
    spark = edges.sparkSession
    path = new_path(spark, "edges")
    write(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), path)
    now = spark.read.schema(EDGES).parquet(path)
    mark = _mark(now)
    while mark[0]:
        last, path = path, new_path(spark, "edges")
        write(_small(_large(now)), path)
        remove(spark, last)
        now = spark.read.schema(EDGES).parquet(path)
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
