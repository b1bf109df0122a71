"""Ranks and running sums over a whole table, cut into bands so that no task walks more than one of them.

Bounds between bands are places of a sample's order.  They decide which task
sorts a row and never its rank: bands are counted exactly, a band's offset is
the sum of those before it, and rows are sorted inside their band alone.  The
order may have several columns, so a value that a third of all rows have is cut
by the next column; rows that are equal in all of them have no order at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of the sample that the bounds come from; bands.
SAMPLE, BANDS = 8192, 256


def with_band(df: DataFrame, order: list[Column], bands: int = BANDS, name: str = "__band") -> DataFrame:
    """``df`` with the number of its band in an ascending order; nulls come first.  Fewer than SAMPLE rows are one band."""
    mine = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    keys = df.select(mine.alias("k"))
    some = keys.orderBy(F.xxhash64("k"), "k").limit(SAMPLE).collect()  # the same on every run
    if len(some) < SAMPLE:
        return df.withColumn(name, F.lit(0))
    spark = df.sparkSession
    first = spark.createDataFrame(some, keys.schema).sort("k").agg(F.collect_list("k").alias("all")).first()[0]
    cuts = [first[len(first) * i // bands] for i in range(1, bands)]
    bounds = spark.createDataFrame([([tuple(c) for c in cuts],)], T.StructType([T.StructField("__bounds", T.ArrayType(keys.schema["k"].dataType))]))
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))])
    search = lambda at, step: F.when((at + step <= len(cuts)) & F.coalesce(F.get("__bounds", at + step - 1) <= mine, F.lit(False)), at + step).otherwise(at)
    return df.crossJoin(F.broadcast(bounds)).withColumn(name, F.aggregate(steps, F.lit(0), search)).drop("__bounds")  # one row


def running_sum(df: DataFrame, order: list[Column], weight: Column, by: list[str] = (), name: str = "running", bands: int = BANDS) -> DataFrame:
    """``df`` with the sum of a weight over rows up to this one, in an order that tells rows of a group apart."""
    by = list(by)
    placed = with_band(df, order, bands).withColumn("__w", weight)
    sums = placed.groupBy(*by, "__band").agg(F.sum("__w").alias("__s"))
    before = F.sum("__s").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("__band").rowsBetween(Window.unboundedPreceding, -1))  # a row for each band
    sums = sums.select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], F.col("__band").alias("__b"), F.coalesce(before, F.lit(0)).alias("__before"))
    here = F.sum("__w").over(Window.partitionBy(*by, "__band").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    placed = placed.withColumn("__here", here)
    same = F.col("__band") == F.col("__b")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__by{i}"))
    return placed.join(sums if by else F.broadcast(sums), same).select(*df.columns, (F.col("__before") + F.col("__here")).alias(name))  # BANDS rows without groups


def ranked(df: DataFrame, order: list[Column], by: list[str] = (), name: str = "rank", bands: int = BANDS) -> DataFrame:
    """``df`` with each row's number in its group, from 1."""
    return running_sum(df, order, F.lit(1).cast("long"), by, name, bands)
